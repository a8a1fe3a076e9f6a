import html
import random
import re

import pytest

from rimeweave.llm import template
from rimeweave.llm.queries import op4_html_text

PARTS = (
    '<header><h1>Site</h1><nav><ul><li><a href="/x">Menu &gt; x</a></ul></nav></header>',
    '<div class="cookie-notice"><p>We use cookies.</p></div>', "<style>p{}</style><script>var t='</p><p>no</p>';</script>",
    '<div id="sidebar"><p>Side text</p></div>', "<aside>aside</aside>", '<form action="/q"><input><p>Search</p></form>',
    '<section class="reader-comments"><p>First comment!</p></section>', "<footer>&copy; all</footer>", "<!-- <p>gone</p> -->",
    '<div class="advert">Buy</div>', '<p style="display: none">hidden</p>', "<noscript>turn on</noscript>",
)


def page(rng, container):
    blocks = [" ".join(rng.choice(["one", "two &amp; x", "<i>th</i>ree", "é", "a  b\n", "&lt;p&gt;"]) for _ in range(8)) for _ in range(4)]
    body = "".join(f"<p>{b}" + rng.choice(["</p>", ""]) for b in blocks[1:])
    inner = f"<h1>{blocks[0]}</h1>" + rng.choice(PARTS[2:3] + PARTS[5:7] + PARTS[8:]) + body
    start, end = {"article": ("<article>", "</article>"), "div": ('<div class="post-content">', "</div>"), "plain": ("<div>", "</div>")}[container]
    around = rng.sample(PARTS, 5)
    source = f"<html><head><title>t</title></head><body>{''.join(around[:3])}{start}{inner}{end}{''.join(around[3:])}"
    plain = [" ".join(html.unescape(re.sub("</?i>", "", b)).split()) for b in blocks]
    return source, "\n".join(plain)


@pytest.mark.parametrize("most_bytes", [1 << 20, 0])
def test_main_text(spark, most_bytes):
    rng = random.Random(12)
    rows, want = [], {}
    for key in range(90):
        source, want[key] = page(rng, rng.choice(["article", "div", "plain"]))
        rows.append((key, f"http://host{key % 4}.org/{key}", source, "clash"))
    rows += [(100, None, rows[0][2], "z"), (101, "http://host1.org/", None, "z"), (102, "", "", "z"), (103, "http://x.net", "<p", "z")]
    rows += [(104, "http://x.net", "plain &amp; text", "z"), (104, "http://x.net", "plain &amp; text", "z"), (105, "http://host1.org", "<b>" * 3000 + "x" * 90_000, "z")]
    want |= {100: want[0], 101: "", 102: "", 103: "<p", 104: "plain & text", 105: "x" * 90_000}
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string").repartition(3)
    out = template.main_texts(df, most_bytes=most_bytes).collect()
    assert len(out) == len(rows)
    for row in out:
        assert row.text == want[row.page_id] and row.n_chars == len(row.text)
    assert template.main_texts(df.limit(0)).count() == 0


def test_template_text_outside_articles_goes(spark):
    """Without any name to go by, texts that the pages of a host share are template, the others fill its slots."""
    rows = [
        (k, "http://h.org/", f"<div><b>Our site</b></div><div><p>Story {k} tells {k * k}</p><p>More of {k}</p></div><div>Call us</div>")
        for k in range(12)
    ]
    out = template.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r.page_id: r.text for r in out} == {k: f"Story {k} tells {k * k}\nMore of {k}" for k in range(12)}


@pytest.mark.parametrize("copies, around", [(25, "article"), (4, "section")])
def test_copies_of_a_page_count_once(spark, copies, around):
    """Copies of a page, in repeated rows and under different URLs, do not make its texts a template."""
    article = f"<{around}><h1>Head</h1><p>Many copies of this</p></{around}>"
    rows = [(k, f"http://h.org/{k % 20}", article) for k in range(copies)]
    rows += [(100 + k, f"http://h.org/o{k}", f"<{around}><p>Other {k}</p></{around}>") for k in range(2)]
    out = template.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    want = {k: "Head\nMany copies of this" if k < 100 else f"Other {k - 100}" for k, _, _ in rows}
    assert {r.page_id: r.text for r in out} == want


def test_texts_with_the_same_start_and_length_differ(spark):
    start = "A long block of words that every page of this host has before the part of it that differs: " + "x" * 20
    rows = [(k, f"http://h.org/{k}", f"<article><p>{start} {k:04}</p></article>") for k in range(24)]
    out = template.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r.page_id: r.text for r in out} == {k: f"{start} {k:04}" for k in range(24)}


def test_classes_have_equal_vectors(spark):
    rows = [("h", k, f"<div><ul>{'<li>x</li>' * (k % 3)}</ul></div>") for k in range(9)]
    found = template.templates(spark.createDataFrame(rows, "host string, page long, html string")).first()
    classes = template.template_of(found.pages, [tuple(t) for t in found.tokens]).classes
    assert len({classes[t] for t in ("div", "/div", "ul", "/ul")}) == 1 and classes["li"] == classes["/li"] != classes["ul"]


def test_given_pages(spark):
    sf = "/root/testdata/sf0.01"
    sources = {r.page_id: r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    for row in op4_html_text(spark, sf).collect():
        inside = re.search("<article>(.*?)</article>", sources[row.page_id], re.DOTALL).group(1)
        blocks = re.split("</?p>|</?h1>", inside)
        plain = [" ".join(html.unescape(re.sub("</?b>", "", b).replace("<br>", " ")).split()) for b in blocks]
        assert row.text == "\n".join(b for b in plain if b)
