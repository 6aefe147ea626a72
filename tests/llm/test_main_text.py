import itertools
import random
import re

import pytest

from offerloom.llm.labelled_pages import PAGES, named_parts
from offerloom.llm.main_text import HINTS, Model, extract, features, holder, labels, parse, train


def plain(page):
    return re.sub(r' data-y="[01]"', "", page)


def test_marginals_equal_the_sum_over_all_labellings():
    model = train()
    rng = random.Random(1)
    told = [t for page in PAGES for t in features(*parse(page))]
    for _ in range(20):
        n = rng.randint(1, 9)
        parents = [-1] + [rng.randrange(i) for i in range(1, n)]
        own = [rng.choice(told) for _ in range(n)]
        weight, total = [0.0] * n, 0.0
        for labels in itertools.product((0, 1), repeat=n):
            p = model.prior[labels[0]]
            for i, y in enumerate(labels):
                for f in own[i]:
                    p *= model.own.get(f, (1.0, 1.0))[y]
                if i:
                    p *= model.pair.get(holder(own[parents[i]]), model.pair["any"])[labels[parents[i]]][y]
            total += p
            for i, y in enumerate(labels):
                weight[i] += p * y
        assert model.marginals(parents, own) == pytest.approx([w / total for w in weight])


@pytest.mark.parametrize("left_out", range(len(PAGES)))
def test_held_out_labelled_page(left_out):
    aside = {hint: words for hint, words in HINTS.items() if hint != "content"}
    model = Model([p for i, p in enumerate(PAGES) if i != left_out] + named_parts(aside, HINTS["content"]))
    page = PAGES[left_out]
    parents, tags, attributes, chunks = parse(page)
    label = labels(parents, attributes)
    got = model.marginals(parents, features(*parse(plain(page))))
    right = sum(len(t) for node, t, _ in chunks if (got[node] > 0.5) == label[node])
    assert right >= 0.9 * sum(len(t) for _, t, _ in chunks)


def test_broken_markup_references_and_white_space():
    text = train().text
    page = "<html><body><nav><a href='/'>Home</a></nav><article><h1>A &amp; B&nbsp;&eacute;</h1><p>one\n two<br>three<p><b>four<!-- x <p> --> &lt;five&gt;<script>var a='</p>'</script><p>six<ul><li>seven<li>eight</ul></article><footer>bye</footer>"
    assert text(page) == "A & B é\none two three\nfour <five>\nsix\nseven\neight"
    assert text(None) == text("") == text("<script>never closed") == ""
    assert text("<div>" * 3000 + "x") in ("x", "")
    assert "<" in text("<article><p>a < b and more words of a paragraph here</p></article>")


def test_whole_table_against_the_articles(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r.page_id: r for r in extract(pages.withColumn("text", pages.url)).collect()}
    rows = pages.collect()
    assert len(got) == len(rows)
    import html

    for r in rows:
        inside = r.html[r.html.index("<article>") + 9 : r.html.index("</article>")]
        blocks = [" ".join(html.unescape(re.sub("<br>", " ", re.sub("</?b>", "", b))).split()) for b in re.split(r"</?(?:p|h1)>", inside)]
        assert got[r.page_id].text == "\n".join(b for b in blocks if b) and got[r.page_id].url == r.url


def test_odd_rows_and_empty_table(spark):
    rows = [(1, None, None), (None, "u", "<p>" + "long words " * 30), (1, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert sorted((r.page_id or 0, r.text[:4]) for r in extract(pages).collect()) == [(0, "long"), (1, ""), (1, "")]
    assert extract(pages.limit(0)).collect() == []
