import html
import re

import pytest
from pyspark.sql import functions as F

from tidemark.llm.chat import conversations_of, format_preferences, with_truncated_answer
from tidemark.llm.html import extract_main_text, main_text
from tidemark.llm.warc import FILE, audit, leaves, warc_record

BODY = " ".join(["A paragraph of the article, long enough to matter."] * 5)


@pytest.mark.parametrize("page,text", [
    (None, ""), ("", ""), ("   ", ""), ("plain words", "plain words"),
    (f"<article><h1>T</h1><p>{BODY}</p></article>", f"T {BODY}"),
    (f"<nav><a>Menu</a></nav><article><p>{BODY}</article><footer>F</footer>", BODY),
    ("<article><p>Short.</p><aside>Side</aside><p>Tail.</p></article>", "Short. Tail."),
    ("<article>a<b>b</b>c &amp; &eacute;&#233;&nbsp;d<br>e</article>", "abc & éé d e"),
    ("<article><p>one<p class=ad>buy<p>two<div class='comments'><article>c</article></div><p>three<script>var a='</p>'</script> four", "one two three four"),
    ("<article><p>x</p><form><input><label>Name</label></form><style>p{}</style><noscript>n</noscript><p>y</p></article>", "x y"),
    (f"<div class='cookie-notice'>We use cookies</div><div id='main'><p>{BODY}</p><p>End.</p></div><div class='sidebar'>S</div><div class='advert'>Buy</div>", f"{BODY} End."),
    (f"<body><header><h1>Site</h1></header><main><p>{BODY}</p></main><section class='comments'><p>{BODY}</p></section></body>", BODY),
    (f"<ul><li><a href='/a'>one</a></li><li><a href='/b'>two</a></li></ul><div><p>{BODY}</p></div>", None),
    ("<article><p>a < b and c > d</p><!-- <p>no</p> --><p>cut <a hre", "a < b and c > d cut"),
    ("<article><p title='x > y'>quoted</p><p data-x=\"it's\">fine</p></article>", "quoted fine"),
    (f"<div class='content with-sidebar'><p>{BODY}</p></div><p><a href='/n'>Next</a></p><p><a href='/p'>Back</a></p>", BODY),
    (f"<div class='article-text'><p>{BODY}</p></div><div class='article-footer'>Foot</div><p class='post-meta share-links'>Share it</p>", BODY),
    ("<article><table><tr><td>1</td><td>2</td></tr></table><ul><li>i<li>j</ul></article>", "1 2 i j"),
    ("<div class=ad>never closed <article><p>still here</p></article>", "still here"),
])
def test_pages(page, text):
    got = main_text(page)
    assert got == text if text is not None else BODY in got


def test_generated_pages_give_their_article(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    rows = extract_main_text(pages).collect()
    source = {r.page_id: r.html for r in pages.collect()}
    assert len(rows) == len(source)
    for r in rows:
        own = re.search(r"<article>(.*?)(?:</article>|\Z)", source[r.page_id], re.S)[1]
        own = re.sub(r"<[^>]*(>|\Z)", "", re.sub(r"</?(p|h1|br)>", " ", re.sub(r'<div class="ad">.*?</div>', "", own)))
        assert r.text == " ".join(html.unescape(own).split()) and r.n_chars == len(r.text)


def test_odd_pages(spark, clashing):
    rows = [(None, None, None), (1, None, ""), (1, "u", "<p>\U0001f600 long " + "word " * 200_000), (1, "u", "<" * 20_000), (2, "u", "<div>" * 5_000 + "deep enough to be read"), (3, "u", "<a '" * 3000)]
    got = extract_main_text(clashing(spark.createDataFrame(rows, "page_id long, url string, html string"))).collect()
    assert len(got) == 6 and [r.n_chars for r in got][:3] == [0, 0, len("\U0001f600 long " + "word " * 200_000) - 1]
    assert got[4].text == "deep enough to be read"
    assert extract_main_text(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def turns(*pairs):
    return [{"role": r, "text": t} for r, t in pairs]


PAIRS = "pair_id long, chosen array<struct<role:string,text:string>>, rejected array<struct<role:string,text:string>>"


def test_preferences(spark):
    u, a, b = ("user", "hi \U0001f600"), ("assistant", "good"), ("assistant", "bad!")
    rows = [(1, turns(u, a), turns(u, b)), (2, turns(u, a, u), turns(u, a, u, b)), (3, turns(u), turns(u)), (4, None, turns(u, a)), (5, turns(("user", None), (None, "x"), a), turns(("user", None), (None, "x"), b)), (6, turns(a), turns(b, a))]
    out = {r.pair_id: r for r in format_preferences(spark.createDataFrame(rows, PAIRS).withColumn("prompt", F.lit(1))).collect()}
    r = out[1]
    assert (r.n_shared, r.prompt, r.chosen_text, r.rejected_text) == (1, "<|user|>\nhi \U0001f600<|end|>\n", "<|assistant|>\ngood<|end|>\n", "<|assistant|>\nbad!<|end|>\n")
    assert [r.chosen_text[s.start : s.end] for s in r.chosen_mask] == ["good<|end|>"]
    assert (out[2].n_shared, out[2].chosen_text, out[2].chosen_mask) == (3, "", []) and len(out[2].rejected_mask) == 1
    assert (out[3].n_shared, out[3].chosen_text, out[3].rejected_text) == (1, "", "")
    assert (out[4].n_shared, out[4].prompt, out[4].chosen_text) == (0, "", "")
    assert (out[5].n_shared, out[5].prompt) == (2, "<|user|>\n<|end|>\n<||>\nx<|end|>\n")
    assert [out[6].rejected_text[s.start : s.end] for s in out[6].rejected_mask] == ["bad!<|end|>", "good<|end|>"]
    assert format_preferences(spark.createDataFrame([], PAIRS)).collect() == []


def test_conversations(spark):
    rows = [(1, 1, "assistant", "abcde"), (1, 0, "user", "q"), (2, 0, "user", "only"), (None, 3, None, None), (None, None, "user", "x"), (3, 0, "assistant", ""), (3, 0, "assistant", "")]
    out = {r.conv_id: r for r in with_truncated_answer(conversations_of(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).collect()}
    assert [tuple(t) for t in out[1].rejected] == [("user", "q"), ("assistant", "ab")]
    assert out[2].chosen == out[2].rejected and len(out[3].chosen) == 2 and [t.text for t in out[None].chosen] == ["x", None]


@pytest.fixture(scope="module")
def records(spark):
    return spark.range(10_000).select("id", F.concat(F.lit("record "), "id").alias("record")).cache()


def kinds(df):
    return {(r.id, r.kind) for r in df.collect()}


def test_audit_finds_exactly_the_faults(spark, records):
    replica = records.where("id not in (5, 4097)").withColumn("record", F.when(F.col("id").isin(77, 9999), F.concat("record", F.lit("x"))).otherwise(F.col("record")))
    replica = replica.union(spark.createDataFrame([(20_000, "new"), (88, "second")], "id long, record string"))
    got = audit(records, replica)
    assert kinds(got) == {(5, "missing"), (4097, "missing"), (77, "changed"), (9999, "changed"), (88, "changed"), (20_000, "extra")}
    row = got.where("id = 77").first()
    assert row.file == 0 and row.offset == sum(len(f"record {i}") for i in range(77)) and row.length == len("record 77")
    assert got.where("id = 4097").first().offset == len(f"record {FILE}")
    assert audit(records, records.repartition(5)).collect() == []


def test_audit_of_odd_rows(spark, records):
    odd = spark.createDataFrame([(None, None), (None, "a"), (1, None), (1, "x"), (1, "x"), (-5, "neg")], "id long, record string")
    none = odd.limit(0)
    assert audit(odd.withColumns({c: F.lit("x") for c in ("hash", "file", "offset", "node")}), odd).collect() == [] and audit(none, none).collect() == []
    assert kinds(audit(odd, none)) == {(None, "missing"), (1, "missing"), (-5, "missing")}
    assert kinds(audit(odd, odd.dropDuplicates())) == {(1, "changed")}
    hot = spark.range(5000).select(F.lit(7).cast("long").alias("id"), F.col("id").cast("string").alias("record"))
    assert leaves(hot).count() == 1 and kinds(audit(hot, hot.where("record <> '17'"))) == {(7, "changed")}


def test_record(spark):
    row = spark.createDataFrame([(1, "http://x", "hé")], "i long, u string, p string").select(warc_record(F.col("i"), F.col("u"), F.col("p")).alias("r")).first()
    head, body = row.r.split("\r\n\r\n", 1)
    assert head.startswith("WARC/1.0\r\n") and "Content-Length: 3" in head and body == "hé\r\n\r\n"


def paragraphs(rng, n):
    """Paragraphs of the article, some short, and its text."""
    parts = [" ".join(rng.choice(["harbour", "light", "the", "of", "winter", "a&amp;b", "m\xe9t\xe9o", "&lt;tag&gt;"]) for _ in range(rng.choice([2, 9, 30, 60]))) for _ in range(n)]
    return parts, " ".join(html.unescape(p) for p in parts)


MENU = "<ul>" + "".join(f"<li><a href='/{i}'>section number {i}</a></li>" for i in range(12)) + "</ul>"
FOOT = "<footer><p>Imprint and contact of the publisher, all rights reserved, and so on and on.</p></footer>"
ASIDE = "<div class='sidebar-left'><p>" + "Something about another topic entirely. " * 4 + "</p></div>"
REMARKS = "<section id='comments'><article><p>" + "I beg to differ with all of it. " * 9 + "</p></article></section>"
TEMPLATES = {
    "article": "<html><head><title>T</title></head><body><nav>{menu}</nav><article>{body}</article>{aside}{remarks}{foot}</body></html>",
    "post": "<html><body>{menu}<hr><div class='post'>{body}</div>{aside}{remarks}{foot}</body></html>",
    "teaser": "<html><body>{menu}<div class=post>{body}</div><article><p>Read more of us.</p></article>{aside}{foot}</body></html>",
    "teaser first": "<body><nav>{menu}</nav><article><h2>A teaser of some words</h2></article><div id=page>{body}</div>{foot}</body>",
    "table": "<table><tr><td class='nav-left'>{menu}</td><td>{body}</td><td id='ads'>Buy now, buy here, buy more, buy again, buy all.</td></tr></table>{foot}",
    "topics": "<main><section class='tags-history'>{body}</section></main>{remarks}{foot}",
    "search": "<main><div id='search-results-explained' class='social-contract header-history'>{body}</div></main><div class='search-box'>Search for something here</div>{foot}",
    "plain": "{body}",
}


@pytest.mark.parametrize("template", TEMPLATES)
def test_templates_give_their_body(template):
    import random

    rng = random.Random(template)
    for n in (4, 12, 40):
        parts, text = paragraphs(rng, n)
        body = "".join(f"<p>{p}</p>\n" for p in ["the " * 40 + "opening", *parts, "closing " * 30])
        text = f"{'the ' * 40}opening {text} {'closing ' * 30}".strip()
        page = TEMPLATES[template].format(menu=MENU, body=body, aside=ASIDE, remarks=REMARKS, foot=FOOT)
        assert main_text(page) == text


def test_windows_decide_where_nothing_is_marked():
    body = "<p>" + "A sentence that belongs to the text of this page. " * 3 + "</p>"
    assert main_text(f"<p>Stray</p><ul><li><a>x</a></li><li><a>y</a></li><li><a>z</a></li></ul>{body * 4}") == " ".join([html.unescape(body[3:-4]).strip()] * 4)


@pytest.mark.parametrize("page", ["<a " * 60_000 + ">", "<title " * 40_000 + "/>", "<script " * 40_000, "<a '" * 60_000 + ">", "<!" * 60_000 + ">", "<p>" * 60_000, "&" * 60_000, "<a title='" + "x>" * 60_000])
def test_odd_markup_takes_time_in_proportion(page):
    import time

    began = time.process_time()
    main_text(page)
    assert time.process_time() - began < 4
