"""Secret scans with multipart credential linking, in Spark expressions alone.

Strong findings (an assignment to a secret's name, an access key, a long hex
run) are reported as they are. Weak parts - a mixed token that may be a secret,
a user name, an endpoint - mean little alone; they are reported only when the
parts that complete a credential stand within the same scope of SCOPE
characters: a secret needs an identifier (access key or user name), a user name
a secret, an endpoint both.

The interval join runs on buckets as wide as the scope. Parts of one bucket
always share a scope; of a neighbouring bucket only the nearest part matters.
So each bucket shrinks to its first and last part of each role before the
equi-join, and a text full of parts never pairs them all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from offerloom.llm.shared import stash

SCOPE = 400

# kind -> pattern, group that must have a length, least length; kinds in the order in which spans are listed
NAMES = r"(?i:password|passwd|secret|token|api_?key)"
BASE = {
    "assign": (NAMES + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 12),
    "access": (r"AKIA[A-Z0-9]{14,}", 0, 18),  # the run after the first AKIA is the longest, so a least length may stand in the pattern
    "hex": (r"[0-9a-f]{16,}", 0, 16),
}
WEAK = {
    "mixed": (r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_-]*[0-9])(?=[0-9+/_-]*[A-Za-z])[A-Za-z0-9+/_-]{20,}={0,2}", 0, 20),
    "user": (r"""(?i:\b(?:user(?:_?name)?|login|client_?id|account))["']?\x20*[:=]\x20*["']?([A-Za-z0-9_.@-]+)""", 1, 3),
    "endpoint": (r"(?i:\b(?:https?|ftp|ssh|postgres(?:ql)?|mysql|redis|mongodb|amqp))://[A-Za-z0-9._~:/?#@%&=+-]+", 0, 8),
}
KINDS = [*BASE, *WEAK]
ROLE = {"access": "identifier", "user": "identifier", "assign": "secret", "hex": "secret", "mixed": "secret", "endpoint": "endpoint"}


def found(text: Column, pattern: str, group: int) -> tuple[Column, Column, Column]:
    """Of all leftmost, non-overlapping matches: characters before each (since the last one), its length, its group's length."""
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    before = F.when(F.size(whole) > 0, F.transform(F.split(text, pattern, -1), F.length)).otherwise(F.array().cast("array<int>"))
    length = F.transform(whole, F.length)
    inner = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), F.length) if group else length
    return before, length, inner


def _parts(texts: DataFrame) -> DataFrame:
    """(row, text, ...) -> (row, text, ..., matches): per kind the three arrays of found(); rows without matches too."""
    columns = []
    for kind, (pattern, group, _) in (BASE | WEAK).items():
        before, length, inner = found(F.col("text"), pattern, group)
        columns.append(F.struct(F.lit(KINDS.index(kind)).alias("kind"), before.alias("before"), length.alias("length"), inner.alias("inner")))
    return texts.select("*", F.filter(F.array(*columns), lambda m: F.size(m["length"]) > 0).alias("matches"))


def _spans(parts: DataFrame) -> DataFrame:
    """(row, kind, start, end) of all matches that are long enough."""
    each = parts.select("row", F.explode("matches").alias("m")).select("row", "m.kind", F.posexplode(F.arrays_zip("m.before", "m.length", "m.inner")).alias("i", "z"))
    each = each.filter("z.length is not null")  # what follows the last match
    upto = Window.partitionBy("row", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.sum(F.col("z.before").cast("long") + F.col("z.length")).over(upto)
    each = each.select("row", "kind", (end - F.col("z.length")).alias("start"), end.alias("end"), F.col("z.inner").alias("inner"))
    least = F.element_at(F.array(*[F.lit(n) for _, _, n in (BASE | WEAK).values()]), F.col("kind") + 1)
    return each.filter(F.col("inner") >= least).drop("inner")


def _free(spans: DataFrame) -> DataFrame:
    """Spans without the mixed tokens that overlap a strong one."""
    strong = F.col("kind") < len(BASE)
    order = Window.partitionBy("row").orderBy("start", "kind")
    reach = F.max(F.when(strong, F.col("end"))).over(order.rowsBetween(Window.unboundedPreceding, -1))
    coming = F.min(F.when(strong, F.col("start"))).over(order.rowsBetween(1, Window.unboundedFollowing))
    hidden = (F.col("kind") == KINDS.index("mixed")) & (F.coalesce(reach > F.col("start"), F.lit(False)) | F.coalesce(coming < F.col("end"), F.lit(False)))
    return spans.withColumn("hidden", hidden).filter(~F.col("hidden")).drop("hidden")


def _linked(spans: DataFrame) -> DataFrame:
    """Weak spans whose complementary parts stand within SCOPE characters."""
    role = F.element_at(F.array(*[F.lit(ROLE[k]) for k in KINDS]), F.col("kind") + 1)
    spans = spans.withColumn("role", role).withColumn("bucket", F.expr(f"start div {SCOPE}"))
    ends = [f(F.when(F.col("role") == r, F.col("start"))).alias(f"{n}_{r}") for r in ("identifier", "secret", "endpoint") for n, f in (("first", F.min), ("last", F.max))]
    scopes = spans.groupBy("row", "bucket").agg(*ends).withColumnRenamed("bucket", "near")
    weak = spans.filter(F.col("kind") >= len(BASE)).withColumn("near", F.explode(F.array(F.col("bucket") - 1, F.col("bucket"), F.col("bucket") + 1)))
    met = weak.join(scopes, ["row", "near"])

    def beside(r: str) -> Column:
        near = F.when(F.col("near") < F.col("bucket"), F.col("start") - F.col(f"last_{r}")).when(F.col("near") > F.col("bucket"), F.col(f"first_{r}") - F.col("start")).otherwise(F.when(F.col(f"first_{r}").isNotNull(), F.lit(0)))
        return F.max(F.coalesce(near <= SCOPE, F.lit(False))).alias(r)

    met = met.groupBy("row", "kind", "start", "end", "role").agg(beside("identifier"), beside("secret"))
    whole = F.when(F.col("role") == "secret", F.col("identifier")).when(F.col("role") == "identifier", F.col("secret")).otherwise(F.col("identifier") & F.col("secret"))
    return met.filter(whole).select("row", "kind", "start", "end")


def _scanned(rows: DataFrame) -> DataFrame:
    """rows(row, matches, ...) of a shared table -> the same rows with spans for matches."""
    spans = stash(_free(_spans(rows.filter(F.size("matches") > 0).select("row", "matches"))))
    all_spans = spans.filter(F.col("kind") < len(BASE)).union(_linked(spans))
    listed = all_spans.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("start", "kind", "end"))).alias("spans"))
    empty = F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>")
    # only rows with matches meet their spans; the others, most of them, stay where they are
    found = rows.filter(F.size("matches") > 0).drop("matches").join(listed, "row", "left")
    rest = rows.filter(F.size("matches") == 0).drop("matches").withColumn("spans", empty)
    return found.withColumn("spans", F.coalesce("spans", empty)).unionByName(rest)


def scan(docs: DataFrame) -> DataFrame:
    """Per row of docs(doc_id, text, ...): doc_id, spans (start, kind, end; kind is a place in KINDS),
    ordered by start and kind; starts and ends count code points.

    A null or empty text has none. Repeated rows and null ids keep their rows.
    Other columns are not looked at. An empty table gives an empty result.
    """
    texts = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    parts = stash(_parts(texts).drop("text"))  # row numbers stay as they are from here on
    return _scanned(parts).select("doc_id", "spans")


MASK = "[secret]"


def redact(docs: DataFrame) -> DataFrame:
    """The rows of docs(text, ...), all columns, with each stretch that spans of scan() cover replaced by MASK."""
    inner = docs.select(F.monotonically_increasing_id().alias("row"), F.coalesce("text", F.lit("")).alias("text"), F.struct("*").alias("own"))
    found = _scanned(stash(_parts(inner).drop("text"))).withColumn("text", F.coalesce("own.text", F.lit("")))

    def step(state: Column, span: Column) -> Column:
        gap = F.substring(F.col("text"), (state["at"] + 1).cast("int"), (span["start"] - state["at"]).cast("int"))
        text = F.when(span["start"] < state["at"], state["text"]).otherwise(F.concat(state["text"], gap, F.lit(MASK)))
        return F.struct(F.greatest(state["at"], span["end"]).alias("at"), text.alias("text"))

    rest = F.substring(F.col("text"), (F.col("masked.at") + 1).cast("int"), F.lit(2**31 - 1))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("text"))
    found = found.withColumn("masked", F.when(F.size("spans") > 0, F.aggregate("spans", start, step)))
    clean = F.when(F.size("spans") > 0, F.concat("masked.text", rest)).otherwise(F.col("own.text"))
    return found.select(*[clean.alias(c) if c == "text" else F.col(f"own.`{c}`") for c in docs.columns])


def named(spans: Column) -> Column:
    """kind:start:end of spans, joined by commas."""
    name = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(name, s["kind"] + 1), s["start"], s["end"])), ",")


def digest(found: DataFrame) -> DataFrame:
    """scan() as counts, the hash of the strong spans, and all spans as text."""

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == KINDS.index(kind))).cast("long").alias(f"n_{kind}")

    strong = F.filter("spans", lambda s: s["kind"] < len(BASE))
    return found.select("doc_id", *[count(k) for k in BASE], F.sha2(named(strong), 256).alias("base_sha256"), named(F.col("spans")).alias("spans"))
