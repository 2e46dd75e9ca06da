import base64
import hashlib
import json
import os
import random
from html.parser import HTMLParser

import pytest

from trailmill.llm.html import BLOCK, parse
from trailmill.llm.warc import derive, op8_warc, read_warc, responses, write_warc
from trailmill.llm.wrappers import Reader, different, extract_main_text, infer, read_back, size_of, sketch, united, written

PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var a = "</p>";</script></head><body class="has-sidebar">
<header><h1>Site</h1></header><nav><ul><li><a href="/a">A</a></ul></nav><div class="cookie-notice">we use</div>
<article><header><h1>Head {n}</h1><span>by me</span></header><p>One &amp; <b>two</b>
 three {n}<p>four&nbsp;five<br>six{extra}<form><input></form><div class="ad">buy</div></article>
<section id="comments"><p>a very long reader comment that is longer than all of the text there is in this article</p></section>
<aside>side</aside><footer>&copy; us</footer></body></html>"""
NO_ARTICLE = '<html><body><div class="menu">m</div><div id="main-{n}"><div class="post"><h2>H{n}</h2><p>{t}</p></div><div class="share">s</div></div></body>'


def texts_of(*pages):
    """Main texts of pages read through the wrapper of all of them."""
    reader = Reader(read_back(written(infer([parse(p) for p in pages]))))
    return [reader.main_text(parse(p)) for p in pages]


def alone(page):
    return texts_of(page)[0]


def story(k, n=30):
    rng = random.Random(k)
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(n))


def test_main_text_of_one_page():
    assert alone(PAGE.format(n=1, extra="")) == "Head 1\nOne & two three 1\nfour five\nsix"


def test_wrapper_has_slots_and_groups():
    pages = [PAGE.format(n=n, extra="<p>more" * n) for n in (1, 2)]
    wrapper = str(infer([parse(p) for p in pages]))
    assert "(<p>" in wrapper and ")+" in wrapper and "#" in wrapper and "=" in wrapper
    one, two = (parse(f"<div><h2>a</h2><p>{t}</p>{x}</div>") for t, x in (("b", ""), ("c", "<ul><li>d</li><li>e</li></ul><p>f</p>")))
    assert str(infer([one, two])) == "<#root><div><h2>=</>((<p>#</>)+(<ul>(<li>#</>)+</>)?)*</></>"


def test_wrapper_against_brute_force():
    """Quantifiers and constants are those that counting over all pages gives, in any order of alignment."""
    rng = random.Random(3)
    for _ in range(60):
        pages = [[(rng.choice("abc"), rng.choice("xyz")) for _ in range(rng.randint(0, 4))] for _ in range(rng.randint(1, 6))]
        trees = [parse("<section>" + "".join(f"<span class={k}>{t}</span>" for k, t in p) + "</section>") for p in pages]
        whole = infer(trees).parts["section"]
        rng.shuffle(trees)
        half = len(trees) // 2
        other = united(infer(trees[half:]), infer(trees[:half])) if half else infer(trees)
        assert str(other.parts["section"]) == str(whole)
        for k in "abc":
            having = [[t for key, t in p if key == k] for p in pages if any(key == k for key, _ in p)]
            part = whole.parts.get(f"span.{k}")
            assert (part is None) == (not having)
            if part:
                assert part.pages == len(having) and part.repeated == any(len(x) > 1 for x in having)
                assert len(part.lines) == len(set.intersection(*map(set, having))) and part.slot == (len(set(map(frozenset, having))) > 1 or part.repeated and any(len(set(x)) > 1 for x in having))


def test_region_without_article():
    pages = [NO_ARTICLE.format(n=n, t="long text " * 9) for n in (1, 22)]
    assert texts_of(*pages)[1] == "H22\n" + " ".join(["long text"] * 9)


def test_page_wide_form():
    assert alone(f"<body><form action=x><div class=menu>m</div><article><h1>H</h1><p>{story(1)}</p></article><input></form></body>") == f"H\n{story(1)}"
    assert alone(f"<body><form><div id=main><p>{story(1)}</p></div></form><form><p>your name</p></form></body>") == story(1)
    assert alone(f"<body><article><p>{story(1)}</p><form><p>your name</p></form></article></body>") == story(1)


def test_sibling_articles():
    pages = [f"<body><article class=a><p>{story(k)}</p></article><article class=b><p>{story(k + 50, 4)}</p></article></body>" for k in range(5)]
    expected = [f"{story(k)}\n{story(k + 50, 4)}" for k in range(5)]
    assert texts_of(*pages) == expected and list(map(alone, pages)) == expected


def test_sections_of_an_article_stay():
    page = f"<body><article><p>{story(1)}</p><section class=related-work><p>earlier work</p></section><section class='share-price'><p>up</p></section><div class=share-buttons>s</div><div class='relatedPosts'>r</div></article></body>"
    assert alone(page) == f"{story(1)}\nearlier work\nup"


def test_lines_of_a_host_go():
    page = "<body><div class=x><h2>Summary</h2><p>{t}</p><p>All rights reserved</p></div><div class=y>Call us now</div></body>"
    pages = [page.format(t=story(k)) for k in range(5)]
    assert texts_of(*pages) == [f"Summary\n{story(k)}" for k in range(5)]
    assert alone(pages[0]) == f"Summary\n{story(0)}\nAll rights reserved"


def test_near_copies_are_no_template():
    words = story(7, 60).split()
    pages = []
    for k in range(12):
        words[k * 3] = "edited"
        pages.append(f"<body><article><p>{' '.join(words)}</p><p>Every copy says so</p></article></body>")
    assert all(t.endswith("\nEvery copy says so") for t in texts_of(*pages))


def test_templates_of_one_host():
    box = "<div class=content><p>short box {k}</p></div>"
    first = [f"<body><div class=content><p>{story(k)}</p></div></body>" for k in range(9)]
    second = f"<body>{box.format(k=1)}<div class=story><p>{story(99, 80)}</p></div></body>"
    assert texts_of(*first, second) == [*(story(k) for k in range(9)), story(99, 80)]


def test_deep_elements():
    page = f"{'<div>' * 5000}<nav>menu</nav><p>{story(1)}</p>"
    assert alone(page) == story(1)
    assert alone("<b>" * 3000 + "deep") == "deep"


def test_many_kinds_become_one():
    pages = [f"<body><div class=main><p>{story(k)}</p></div>" + "".join(f"<i class=q{chr(97 + k)}{chr(97 + n)}>x</i><u class=u{chr(97 + k)}{chr(97 + n)}>y</u>" for n in range(9)) for k in range(12)]
    wrapper = infer([parse(p) for p in pages])
    assert size_of(wrapper) < 20 and "u.*" in wrapper.parts["body"].parts
    assert [t.split("\n")[0] for t in texts_of(*pages)] == [story(k) for k in range(12)]


def test_repeats_in_order():
    assert different([(1, 2, 3), (1, 5, 6), (7, 8, 3), (9, 9, 9)]) == 2
    near, far = story(1, 50), story(2, 50)
    assert different([sketch(near), sketch(near.replace(" ", " x ", 1))]) == 1 and different([sketch(near), sketch(far)]) == 2


def test_extract(spark):
    rows = [(k, f"http://u@Host{k % 3}.org:80/{k}", PAGE.format(n=k, extra="")) for k in range(40)]
    rows += [(40, None, "<p>x"), (41, "http://a.b/", None), (42, "bad url", ""), (43, "http://a.b/", "a < b &lt; c <p unfinished"), (None, "http://host1.org", PAGE.format(n=9, extra="")), (1, *rows[1][1:]), (44, "http://deep", "<div>" * 3000 + "deep")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'x' as host", "1 as salt", "2 as n", "'t' as text", "3 as at")
    found = {}
    for r in extract_main_text(pages).collect():
        assert r.n_chars == len(r.text)
        found.setdefault(r.page_id, []).append(r.text)
    assert sum(map(len, found.values())) == len(rows)
    assert all(found[k][0] == f"Head {k}\nOne & two three {k}\nfour five\nsix" for k in range(40))
    assert (found[40], found[41], found[42], found[43], found[44]) == (["x"], [""], [""], ["a < b < c"], ["deep"])
    assert extract_main_text(pages.filter("page_id < 0")).count() == 0
    typed = extract_main_text(pages.filter("page_id = 7").withColumn("page_id", pages["page_id"].cast("short")))
    assert typed.schema["page_id"].dataType.simpleString() == "smallint" and [r.page_id for r in typed.collect()] == [7]
    for salted in (pages.withColumn("page_id", pages["page_id"].cast("decimal(20,0)")), pages.repartition(7)):
        assert sorted((-1 if r.page_id is None else int(r.page_id), r.text) for r in extract_main_text(salted).collect()) == sorted((-1 if k is None else k, t) for k, v in found.items() for t in v)



def test_warc_round_trip(spark, tmp_path):
    rows = [(1, "http://a.b/é", "<title>T &amp; U</title><a href='/x'>link</a><p>text"), (2, None, None), (None, "u", ""), (1, "http://a.b/é", "same id"), (3, "v", "has\r\n\r\nblank lines")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'x' as key", "'y' as fields")
    source = responses(pages)
    made = derive(source)
    assert made.count() == 2 * len(rows)
    ids = {r.record_id for r in source.collect()}
    for r in made.collect():
        assert r.refers_to in ids
        fields = dict(map(tuple, r.fields))
        assert fields["WARC-Refers-To"] == r.refers_to and int(fields["Content-Length"]) == len(r.block) and fields["WARC-Payload-Digest"].startswith("sha1:")
        if r.warc_type == "metadata":
            told = json.loads(bytes(r.block))
            assert told["source"]["WARC-Record-ID"] == r.refers_to and told["payload"]["digest_matches"]
    first = json.loads(bytes(made.filter("warc_type = 'metadata'").collect()[0].block))
    assert first["html"] == {"title": "T & U", "links": [{"path": "a@/href", "url": "/x"}]}
    every = source.unionByName(made)
    write_warc(every, f"file://{tmp_path}/w")
    back = read_warc(spark, f"file://{tmp_path}/w")
    assert back.filter("not complete").count() == 0
    key = lambda r: (r.record_id, r.warc_type, r.refers_to or "", bytes(r.block), tuple(map(tuple, r.fields)))
    assert sorted(map(key, every.collect())) == sorted(map(key, back.collect()))
    assert derive(responses(pages.filter("page_id < 0"))).count() == 0


def test_blocks_that_hold_the_version_line(spark, tmp_path):
    inside = "WARC/1.1\r\nWARC-Type: fake\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    texts = [f"<p>before {inside} after", "plain", inside * 3, "WARC/1.1\r\nWARC/1.1\r\n", "x" * 300_000 + inside]
    pages = spark.createDataFrame([(k, f"http://h/{k}", t) for k, t in enumerate(texts)], "page_id long, url string, html string")
    source = responses(pages)
    write_warc(source.coalesce(2), f"file://{tmp_path}/w")
    back = read_warc(spark, f"file://{tmp_path}/w").collect()
    key = lambda r: (r.record_id, r.warc_type, bytes(r.block), tuple(map(tuple, r.fields)))
    assert all(r.complete for r in back) and sorted(map(key, back)) == sorted(map(key, source.collect()))
    cut = b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 99\r\n\r\nshort\r\n\r\n"
    (tmp_path / "cut").mkdir()
    (tmp_path / "cut" / "a").write_bytes(cut)
    (tmp_path / "cut" / "b").write_bytes(b"WARC/1.1\r\nno length\r\n\r\nx\r\n\r\n")
    assert sorted((r.warc_type or "", bytes(r.block), r.complete) for r in read_warc(spark, f"file://{tmp_path}/cut").collect()) == [("", b"x", None), ("response", b"short", False)]


class PlainText(HTMLParser):
    """Text by the standard library's parser: a line for each block."""

    def __init__(self):
        super().__init__()
        self.lines, self.now, self.skip, self.links = [], [], 0, []

    def handle_starttag(self, tag, attrs):
        self.skip += tag in ("script", "style", "head")
        if tag in BLOCK:
            self.end()
        name = {"a": "href", "img": "src", "script": "src", "form": "action", "link": "href"}.get(tag)
        if name in dict(attrs):
            self.links.append({"path": f"{tag}@/{name}", "url": dict(attrs)[name]})

    def handle_endtag(self, tag):
        self.skip -= tag in ("script", "style", "head")
        if tag in BLOCK:
            self.end()

    def handle_data(self, data):
        if not self.skip:
            self.now.append(data)

    def end(self):
        if line := " ".join("".join(self.now).split()):
            self.lines.append(line)
        self.now = []


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test data")
def test_derivatives_against_plain_parser(spark):
    """All pages of the test tables: texts, links, digests and references by the standard library."""
    b32 = lambda data: "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    html = {r.url: r.html for r in pages.collect()}
    source = {r.record_id: dict(map(tuple, r.fields)) for r in responses(pages).collect()}
    made = derive(responses(pages)).collect()
    assert len(made) == 2 * pages.count() and len(source) == pages.count()
    for r in made:
        fields, block = dict(map(tuple, r.fields)), bytes(r.block)
        url = source[r.refers_to]["WARC-Target-URI"]
        plain = PlainText()
        plain.feed(html[url])
        plain.end()
        assert fields["WARC-Target-URI"] == url and fields["WARC-Payload-Digest"] == b32(html[url].encode()) and fields["WARC-Block-Digest"] == b32(block)
        if r.warc_type == "conversion":
            assert block.decode() == "\n".join(plain.lines)
        else:
            assert json.loads(block)["html"]["links"] == plain.links and json.loads(block)["payload"]["length"] == len(html[url].encode())
    table = {(r.warc_type, r.refers_to): r for r in op8_warc(spark, "/root/testdata/sf0.01").collect()}
    assert {(r.warc_type, r.refers_to): (len(r.block), b32(bytes(r.block))) for r in made} == {k: (r.content_length, r.block_digest) for k, r in table.items()}
