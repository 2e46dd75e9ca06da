import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_near import alike, least_of_groups, roots, shingles
from trailmill.llm.bpe import ByteBpe, public_vocabulary


def norm(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def test_pipeline_against_brute_force(spark, rows, tmp_path):
    unique = list({r[0]: r for r in rows if r[0] is not None}.values())
    path = f"file://{tmp_path}/sf"
    spark.createDataFrame(unique, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    docs = spark.read.parquet(f"{path}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, path)
        if name != "tokens":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        kept[name] = docs.collect()
    with_letters = {d: t for d, t, *_ in unique if t and any(map(str.isalpha, t))}
    assert {r.doc_id for r in kept["language_id"]} == set(with_letters) and all(r.lang for r in kept["language_id"])
    least = {}
    for d in sorted(with_letters):
        least.setdefault(norm(with_letters[d]), d)
    assert sorted(r.doc_id for r in kept["exact_dedup"]) == sorted(least.values())
    texts = {d: with_letters[d] for d in least.values()}
    first = set(least_of_groups(list(texts.items())).values())
    assert sorted(r.doc_id for r in kept["near_dedup"]) == sorted(first)
    assert {r.doc_id for r in kept["mixing"]} <= first
    with open(public_vocabulary()) as f:
        bpe = ByteBpe(f.read())
    assert len(kept["tokens"]) == len(kept["mixing"])
    for r in kept["tokens"]:
        assert bpe.decode(np.array(r.ids, "<u4").tobytes()) == with_letters[r.doc_id]
    assert corpus_pipeline.run(spark, path).count() == len(kept["tokens"])


def test_pipeline_of_nothing(spark, tmp_path):
    path = f"file://{tmp_path}/none"
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    assert corpus_pipeline.run(spark, path).count() == 0


def test_pipeline_of_null_and_repeated_ids(spark, rows, tmp_path):
    """Rows, not ids, through all stages: null and shared ids, repeated rows, columns whose names clash."""
    odd = rows + [(None, t, lang, s, n) for _, t, lang, s, n in rows[:20]] + [(7, t + " under a shared id", lang, None, n) for _, t, lang, s, n in rows[20:40]] + [(None, f"a text of its own {k} " * 3, None, "s9", 1) for k in range(15)]
    path = f"file://{tmp_path}/odd"
    clash = {c: F.lit("x") for c in ("key", "n", "chain", "band", "copies", "fp", "sha", "root")}
    spark.createDataFrame(odd, "doc_id long, text string, lang string, source string, n_chars long").withColumns(clash).write.parquet(f"{path}/documents.parquet")
    docs = spark.read.parquet(f"{path}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, path)
        assert docs.columns == columns
        docs.write.parquet(f"{path}/{name}")
        docs = spark.read.parquet(f"{path}/{name}")
        kept[name] = Counter((r.doc_id, r.text) for r in docs.collect())
    told = [(d, t) for d, t, *_ in odd if t and any(map(str.isalpha, t))]
    assert kept["language_id"] == Counter(told)
    order = lambda d: (d is None, d or 0)
    first = {}
    for d, t in told:
        if norm(t) not in first or order(d) < order(first[norm(t)][0]):
            first[norm(t)] = (d, t)
    assert Counter((d, norm(t)) for d, t in kept["exact_dedup"]) == Counter((d, n) for n, (d, _) in first.items()) and set(kept["exact_dedup"].values()) == {1}
    texts = list(kept["exact_dedup"])
    sets = [shingles(t) for _, t in texts]
    root = roots(range(len(sets)), [(i, j) for i in range(len(sets)) for j in range(i) if alike(sets[i], sets[j])])
    groups = {}
    for k, r in root.items():
        groups.setdefault(r, []).append(texts[k])
    near = list(kept["near_dedup"])
    assert set(kept["near_dedup"].values()) == {1} and len(near) == len(groups) and set(near) <= set(texts)
    for group in groups.values():
        stays = [x for x in group if x in kept["near_dedup"]]
        assert len(stays) == 1 and order(stays[0][0]) == min(order(d) for d, _ in group)
    assert set(kept["mixing"]) <= set(near) and max(kept["mixing"].values()) <= 3
