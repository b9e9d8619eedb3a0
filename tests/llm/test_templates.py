"""Main text of pages against a plain reader of articles, and templates of made hosts."""

import html
import random
import re

import pytest
from pyspark.sql import functions as F

from logtide.llm import markup, templates
from samples import SF

SCHEMA = "page_id long, url string, html string, text string, host string, token long"


def plain_article(source):
    """Main text of a page whose article holds headings and paragraphs only."""
    inner = re.search(r"<article>(.*?)</article>", source, re.S)[1]
    parts = [html.unescape(re.sub(r"<[^>]*>", "", p.replace("<br>", " ")))
             for p in re.split(r"</?(?:p|h1)>", inner)]
    return "\n".join(t for p in parts if (t := " ".join(p.split())))


def test_pages_of_the_table(spark):
    pages = spark.read.parquet(f"{SF.replace('0.001', '0.01')}/pages.parquet")
    got = {r.page_id: r for r in templates.extract(pages).collect()}
    rows = pages.collect()
    assert len(got) == len(rows)
    for r in rows:
        assert got[r.page_id].text == plain_article(r.html)
        assert got[r.page_id].n_chars == len(got[r.page_id].text) and got[r.page_id].url == r.url


def sentence(rng):
    return " ".join(rng.choice("silver river stone cloud letter window garden answer morning".split())
                    for _ in range(rng.randrange(6, 14))) + "."


def made_pages(rng):
    """Hosts without landmarks or names that tell: only what repeats gives the template away."""
    rows, truth = [], {}
    for h in range(3):
        for i in range(8):
            body = [sentence(rng) for _ in range(rng.randrange(3, 9))]
            slots = [f"<p>{b}" for b in body]
            if h == 0:  # a flat body; a line above the text on every page
                page = f"<body><p>All rights are ours alone</p>{''.join(slots)}<p>Call us on Monday</p></body>"
            elif h == 1:  # nested boxes; links around the text
                page = ("<body><div class=x1><a href=/>Home</a> <a href=/b>Other things</a></div><div class=x2>"
                        f"<div class=x3>{''.join(slots)}</div><div class=x4>Made by hand {i}</div></div></body>")
            else:  # a landmark, with what it must not hold
                page = (f"<header><h2>Site</h2></header><main><article><header><h1>Title {i}</h1></header>"
                        f"{''.join(slots)}<aside>More</aside><div class='ad-box'>Buy</div>"
                        f"<form><input><label>Name</label></form></article><section id=comments>"
                        f"<article class=comment><p>First!</article></section></main><footer>End</footer>")
                body = [f"Title {i}", *body]
            rows.append((100 * h + i, f"http://h{h}.example/{i}", page, "t", "h", 1))
            truth[100 * h + i] = "\n".join(body)
    return rows, truth


@pytest.mark.parametrize("limit", [1 << 25, 0])
def test_templates_are_deduced(spark, monkeypatch, limit):
    monkeypatch.setattr(templates, "BROADCAST_BYTES", limit)
    monkeypatch.setattr(templates, "_SALT_PAGES", 3)
    rows, truth = made_pages(random.Random(5))
    odd = [(900, None, "<p>No host</p>", "t", "h", 1), (901, "http://h0.example/x", None, "t", "h", 1),
           (902, "http://h1.example/x", "", "t", "h", 1), (None, "http://one.example/", "<p>a &amp b&lt;i>"
            "&nbsp; c<script>x<p>y</script><!-- z --><ul><li>d<li>e</ul>", "t", "h", 1)]
    truth |= {900: "No host", 901: "", 902: "", None: "a & b<i> c\nd\ne"}
    odd.append(odd[-1])
    got = templates.extract(spark.createDataFrame(rows + odd, SCHEMA).repartition(4))
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    found = got.collect()
    assert len(found) == len(rows + odd)
    for r in found:
        assert r.text == truth[r.page_id], r.page_id
    assert templates.extract(spark.createDataFrame([], SCHEMA)).count() == 0


def test_classes_need_one_order(spark):
    """Two texts on every page form a class only if they keep their order."""
    for swapped in (False, True):
        rows = []
        for i in range(6):
            a, b = "<p>first constant</p>", "<p>second constant</p>"
            both = b + a if swapped and i == 5 else a + b
            rows.append((i, "http://a.example/", f"<body>{both}<p>own text {i}</body>", "", "", 0))
        pages = spark.createDataFrame(rows, SCHEMA).withColumn("host", F.lit("a.example"))
        seen = templates.observed(pages).cache()
        found = templates.classes(templates.vectors(seen))
        texts = templates.valid_classes(seen, found).where("kind = 1 and members > 1").count()
        assert texts == (0 if swapped else 2)


def test_vectors_equal_plain_counts(spark):
    rows, _ = made_pages(random.Random(8))
    pages = spark.createDataFrame(rows, SCHEMA).withColumn("host", F.regexp_extract("url", "//([^/]+)", 1))
    counts = {}
    for _, url, source, *_ in rows:
        order, _ = templates.tokens(markup.Reader().read(source))
        for token in order:
            counts.setdefault((url.split("/")[2], token), {}).setdefault(url, 0)
            counts[url.split("/")[2], token][url] += 1
    expected = {}
    for (host, token), vector in counts.items():
        if len(vector) >= 4:
            expected.setdefault((host, tuple(sorted(vector.items()))), set()).add(token)
    got = {}
    for r in templates.vectors(templates.observed(pages)).collect():
        got.setdefault((r.host, r.pages, r.total, r.vector), set()).add(r.token)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, expected.values()))


def text_of(source):
    page = markup.Reader().read(source)
    return templates.main_text(page, set(), set())


@pytest.mark.parametrize("source,text", [
    ("<article>a<b>b</b>c <i>d</i></article>", "abc d"),
    ("<article><p>one<p>two<div>three</div>four</article>", "one\ntwo\nthree\nfour"),
    ("<article><p class='x>y'>quoted > sign</p></article>", "quoted > sign"),
    ("<article>1 < 2 &lt; 3 <3</article>", "1 < 2 < 3 <3"),
    ("<article><p>a<!-- <p>b</p> -->c</p></article>", "ac"),
    ("<article><script>if (a</b) '</p>'</script><p>x</article>", "x"),
    ("<article><SCRIPT>a</SCRIPT ><P>x</ARTICLE>", "x"),
    ("<article><p>a<br>b<br/>c</article>", "a b c"),
    ("<article><table><tr><td>a<td>b<tr><td>c</table></article>", "a b\nc"),
    ("<article><p><b>bold.<br><p>next</article> after", "bold.\nnext"),
    ("<article>&#233;&eacute;&#x1F642;&unknown; &amp;lt;</article>", "éé🙂&unknown; &lt;"),
    ("<nav>menu</nav><article>a</article><footer>f</footer>", "a"),
    ("<article>open to the end", "open to the end"),
    ("<article><p>cut &am", "cut &am"), ("<article>x</article", "x"), ("plain text", "plain text"),
    ("<body class='has-sidebar'><div id=content><p>Long enough text</p></div><div class=sidebar>s</div>",
     "Long enough text"),
    ("", ""), ("<", "<"), ("<article></article>", ""), ("<p title=a\"b>x</p>", "x"),
])
def test_reading(source, text):
    assert text_of(source) == text


@pytest.mark.parametrize("source", ["<div>" * 30_000 + "x", "<b>x" * 30_000, "<p>" * 50_000, "<a b=\"" * 30_000,
                                    "<!--" * 50_000, "</p>" * 50_000, "x" * 5_000_000, "<" * 100_000,
                                    "<ul><li>" * 20_000 + "</div>" * 20_000])
def test_long_and_deep_pages_take_linear_time(source):
    import time
    start = time.time()
    text_of(source)
    assert time.time() - start < 10
