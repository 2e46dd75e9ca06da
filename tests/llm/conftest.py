import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def make_docs():
    """Small documents with copies, near copies, nulls, empty and long texts, repeated rows, hot sources."""
    rng = random.Random(5)
    words = {"en": "the of and with this from that here".split(), "de": "der und die nicht das ist mit zur".split()}
    syllables = {"en": "th er on ing at tion ea".split(), "de": "ge sch ung ver ein lich be".split()}

    def word(lang):
        return rng.choice(words[lang]) if rng.random() < 0.3 else "".join(rng.choice(syllables[lang]) for _ in range(rng.randint(1, 4)))

    rows = []
    for k in range(120):
        lang = "de" if k % 3 == 0 else "en"
        text = " ".join(word(lang) for _ in range(rng.randint(3, 120)))
        rows.append((k, text, lang, f"s{0 if k % 3 else k % 7}", len(text)))
    for k in range(120, 150):  # copies with other white space
        rows.append((k, rows[k - 120][1].replace(" ", "\t\n", 1), None, "s0", 1))
    for k in range(150, 170):  # near copies: one word more
        rows.append((k, rows[k - 100][1] + " more", "en", None, 1))
    rows += [(170, None, None, None, None), (171, "", "en", "s1", 0), (172, " \n ", "de", "s1", 3), (173, "12 !!", "en", "s2", 5), (174, "ab " * 40_000, "en", "s2", 120_000)]
    rows += [(175, "<|endoftext|> ünï\x85   😀 x", "en", "é", 3), (5, rows[5][1], "en", "s0", 1), (5, rows[5][1], "en", "s0", 1), (None, "no id here", "en", "s3", 1), (None, None, None, None, None)]
    return rows


@pytest.fixture(scope="session")
def rows():
    return make_docs()


@pytest.fixture(scope="session")
def docs(spark, rows):
    """The rows, with columns whose names clash with those that operators make."""
    from pyspark.sql import functions as F

    clash = ["shard", "slot", "part", "guest", "fp", "key", "norm", "copies", "size", "kept", "lang_pred", "host", "score", "quality", "component_id", "atom", "keep_id"]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).withColumns({c: F.lit("x") for c in clash})


@pytest.fixture(scope="session")
def empty(docs):
    return docs.filter("doc_id < -1")
