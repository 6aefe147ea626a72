import hashlib
import random
import re

from offerloom.llm.credentials import BASE, KINDS, ROLE, SCOPE, WEAK, digest, scan

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def brute_base(text):
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    return out + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]


def brute(text):
    text = text or ""
    base = brute_base(text)
    weak = []
    for kind, (pattern, group, least) in WEAK.items():
        for m in re.finditer(pattern.replace("(?i:", "(?ai:"), text):
            span = (m.start(), KINDS.index(kind), m.end())
            if len(m[group]) >= least and not (kind == "mixed" and any(s < span[2] and span[0] < e for s, _, e in base)):
                weak.append(span)

    def beside(span, role):
        return any(ROLE[KINDS[k]] == role and abs(s - span[0]) <= SCOPE for s, k, _ in base + weak)

    kept = []
    for span in weak:
        role = ROLE[KINDS[span[1]]]
        need = {"secret": ["identifier"], "identifier": ["secret"], "endpoint": ["identifier", "secret"]}[role]
        if all(beside(span, r) for r in need):
            kept.append(span)
    return sorted(base + kept), sorted(base)


def text_of(rng):
    bits = ["lorem ipsum", "password = hunter2hunter2", "PassWd:'abc", "token=secret=ABCDEFGHIJKLMNOP", "password=token: abcdefghijklmnop", 'api_key": "' + "Zx9" * 8, "AKIA" + "Q7" * 8, "AKIAAKIA" + "9" * 10, "AKIAXX",
            "0123456789abcdef0", "deadbeef" * 3, "user=bob", "login: alice.b", "https://db.example.org:5432/x?y=1", "postgres://h/x", "k" * 19 + "7", "A1b2C3d4E5f6G7h8I9j0K1", "é\U0001f600ü", "secret  :  ", "apikey=a.b.c.d.e.f.g", "x" * 150, "\n\n"]
    return " ".join(rng.choice(bits) for _ in range(rng.choice([0, 1, 5, 40])))


def test_same_as_brute_force(spark):
    rng = random.Random(2)
    texts = [text_of(rng) for _ in range(150)] + [None, "", "AKIA" + "B" * 16, "A1b2C3d4E5f6G7h8I9j0K1", "user=bob " + "y" * (SCOPE - 9) + " A1b2C3d4E5f6G7h8I9j0K1", "user=bob " + "y " * (SCOPE // 2 - 4) + "A1b2C3d4E5f6G7h8I9j0K1", "user=bob " + "y " * (SCOPE // 2 - 5) + " A1b2C3d4E5f6G7h8I9j0K1"]
    rows = [(i, t, "s") for i, t in enumerate(texts)] + [(3, texts[3], "s"), (None, texts[4], "s")]
    got = digest(scan(spark.createDataFrame(rows, "doc_id long, text string, spans string").repartition(3))).collect()

    def line(doc, text):
        spans, base = brute(text)
        name = lambda found: ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in found)
        return (doc, *[sum(k == i for _, k, _ in base) for i in range(3)], hashlib.sha256(name(base).encode()).hexdigest(), name(spans))

    assert sorted(map(tuple, got), key=str) == sorted((line(d, t) for d, t, _ in rows), key=str)
    assert any("mixed" in r.spans for r in got) and any("endpoint" in r.spans for r in got)


def test_whole_table_and_empty_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r.doc_id: r for r in digest(scan(docs)).collect()}
    rows = docs.collect()
    assert len(got) == len(rows)
    for r in rows:
        base = sorted(brute_base(r.text or ""))
        assert [got[r.doc_id].n_assign, got[r.doc_id].n_access, got[r.doc_id].n_hex] == [sum(k == i for _, k, _ in base) for i in range(3)]
        assert got[r.doc_id].base_sha256 == hashlib.sha256(",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in base).encode()).hexdigest()
    assert scan(docs.limit(0)).collect() == [] and list(BASE) == ["assign", "access", "hex"]
