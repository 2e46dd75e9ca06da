"""Articles below layout names, and samples of bounded size."""

import random

import pytest
from pyspark.sql import functions as F

from trailmill.llm.langid import LANGUAGE_CHARS, LanguageModel, identify, sample_texts
from trailmill.llm.wrappers import extract_main_text


def story(k, n=60):
    rng = random.Random(k)
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(n))


NAMES = ["page right-sidebar", "sidebar-right", "content-sidebar", "menu-left", "left-menu wrapper", "comment-article", "navigation-top", "reply-box"]


@pytest.mark.parametrize("tag", ["div", "article"])
def test_no_name_takes_a_whole_article(spark, tag):
    names = NAMES + ["post sidebar-right", "comment post", "post-comment"]
    pages = [
        (k * 10 + n, f"http://h{k}.org/{n}", f'<html><body><nav>menu</nav><{tag} class="{name}"><h1>Head {n}</h1><p>{story(k * 10 + n)}</p><p>{story(n + 777)}</p></{tag}><footer>us</footer></body></html>')
        for k, name in enumerate(names)
        for n in range(6)
    ]
    found = {r.page_id: r.text for r in extract_main_text(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    for k in range(len(names)):
        for n in range(6):
            assert found[k * 10 + n] == "\n".join([f"Head {n}", story(k * 10 + n), story(n + 777)]), names[k]


def test_marked_parts_beside_an_article_still_go(spark):
    comments = "".join(f'<div class="comment-body"><p>{story(900 + k)}</p></div>' for k in range(9))
    html = f'<html><body><div class="page right-sidebar"><h1>T</h1><p>{story(1)}</p><div class="sidebar"><p>{story(2, 9)}</p></div><div class="comments">{comments}</div></div></body></html>'
    found = extract_main_text(spark.createDataFrame([(1, "http://a.org", html)], "page_id long, url string, html string")).first()
    assert story(1) in found.text and story(2, 9) not in found.text and story(900) not in found.text


def test_sample_is_bounded_in_characters(spark):
    long = "the of and " * 40_000
    rows = [(k, long if k % 2 else f"der und die {k}", "en" if k % 2 else "de") for k in range(60)]
    samples = sample_texts(spark.createDataFrame(rows, "doc_id long, text string, lang string"), F.lit(True))
    assert set(samples) == {"en", "de"} and LANGUAGE_CHARS <= len(samples["en"]) <= 2 * LANGUAGE_CHARS + 64
    assert "der und die 0" in samples["de"] or len(samples["de"]) > 100


def test_ties_between_languages_and_long_texts(spark):
    same = "one two three four five six seven"
    rows = [(k, same, "b" if k % 2 else "a") for k in range(12)] + [(99, same * 500, None)]
    found = {r.doc_id: r for r in identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert {r.lang_pred for r in found.values()} == {"a"} and found[99].score == pytest.approx(0.5)
    model = LanguageModel({"a": same, "b": "x y z"})
    assert model.predict([same * 2000])[0][0] == "a"
