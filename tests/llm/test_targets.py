"""Centroid clustering, importance resampling and license scans against plain versions."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from trailmill.llm.centroids import LONG_MAX, cluster, nearest, scaled
from trailmill.llm.licenses import DRIFT, GRAM, REACH, SHARE, scan_licenses, template_words
from trailmill.llm.resample import gains, resample

VECTORS = "vec_id long, embedding array<float>, cluster string, distance string"


def plain_clusters(vectors, k=8, rounds=10, seed=3):
    """Exact clustering, one distance after the other."""
    kept = [(i, [math.floor(1024 * float(np.float32(x))) for x in v]) for i, v in vectors if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    key = lambda i: hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()
    centroids = [list(v) for _, v in sorted(kept, key=lambda r: (key(r[0]), r[1]))[:k]]

    def assign():
        out = []
        for _, v in kept:
            d = [sum((a - b) ** 2 for a, b in zip(v, c)) for c in centroids]
            out.append((d.index(min(d)), min(d)))
        return out

    for _ in range(rounds):
        groups = defaultdict(list)
        for (c, _), (_, v) in zip(assign(), kept):
            groups[c].append(v)
        for c, members in groups.items():
            centroids[c] = [sum(x) // len(members) for x in zip(*members)]
    told = assign()
    inertia = Counter()
    for c, d in told:
        inertia[c] += d
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted((i is None, i or 0, c, d, min(inertia[c], LONG_MAX), min(sum(inertia.values()), LONG_MAX), digest[c]) for (i, _), (c, d) in zip(kept, told))


def found_clusters(df):
    return sorted((r.vec_id is None, r.vec_id or 0, r["cluster"], r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in df.collect())


def make_vectors(n, scale=1.0):
    rng = random.Random(3)
    middles = [[rng.gauss(0, scale) for _ in range(64)] for _ in range(5)]
    rows = [(k, [x + rng.gauss(0, scale / 4) for x in rng.choice(middles)]) for k in range(n)]
    return rows + [(n, rows[0][1]), (0, rows[0][1]), (None, rows[1][1]), (n + 1, None), (n + 2, rows[2][1][:63]), (n + 3, [*rows[2][1][:63], None]), (n + 4, [*rows[2][1][:63], float("nan")]), (n + 5, [*rows[2][1][:63], float("-inf")]), (n + 6, []), (n + 7, rows[2][1] + [1.0])]


@pytest.mark.parametrize(("n", "scale"), [(150, 0.2), (3, 1.0), (60, 3e5)])
def test_clusters_are_exact(spark, n, scale):
    rows = make_vectors(n, scale)
    df = spark.createDataFrame([(i, v, "x", "y") for i, v in rows], VECTORS).repartition(3)
    assert found_clusters(cluster(df)) == plain_clusters(rows)


def test_clusters_of_equal_and_of_no_vectors(spark):
    one = [0.5] * 64
    rows = [(k, one) for k in range(20)]
    df = spark.createDataFrame([(i, v, "x", "y") for i, v in rows], VECTORS)
    told = found_clusters(cluster(df))
    assert told == plain_clusters(rows) and {r[2] for r in told} == {0}  # ties: the smaller number; empty centroids stay
    assert cluster(df.filter("vec_id < 0")).collect() == []


def test_huge_components_are_bounded(spark):
    rows = [(k, [(-1) ** k * 3e38] + [0.0] * 63) for k in range(4)]
    told = cluster(spark.createDataFrame([(i, v, "x", "y") for i, v in rows], VECTORS)).collect()
    assert len(told) == 4 and all(0 <= r.distance <= (1 << 63) - 1 for r in told)


def test_abandoned_centroids_change_nothing():
    rng = np.random.default_rng(1)
    vectors = scaled(rng.normal(size=(500, 64)), False)
    centroids = vectors[:9].copy()
    centroids[8] = centroids[2]  # a tie on all
    d = ((vectors[:, None] - centroids[None]) ** 2).sum(axis=2)
    for order in (np.arange(64), rng.permutation(64)):
        best, least = nearest(vectors, centroids, order)
        assert (best == d.argmin(axis=1)).all() and (least == d.min(axis=1)).all()


def plain_words(text):
    low = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def plain_sample(docs, targets, longest=1, least_words=20, percent=10, buckets=10_000, seed=2024):
    runs = lambda ws: [zlib.crc32(" ".join(ws[i : i + n]).encode()) % buckets for n in range(1, longest + 1) for i in range(len(ws) - n + 1)]
    listed = [(d, plain_words(t)) for d, t in docs]
    s, t = Counter(b for _, ws in listed for b in runs(ws)), Counter(b for x in targets for b in runs(plain_words(x)))
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s.total() + buckets) / ((s[b] + 1) * (t.total() + buckets)))) for b in range(buckets)]
    out = []
    for d, ws in listed:
        found = runs(ws)
        weight = sum(gain[b] for b in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"{seed}:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        out.append([d, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(ws)])
    able = sorted((r for r in out if r[4] >= least_words), key=lambda r: (-r[3], r[0] is not None, r[0], r[1], r[2]))
    drawn = percent * len(able) // 100
    told = [(*r[:4], k + 1 if k < drawn else None) for k, r in enumerate(able)] + [(*r[:4], None) for r in out if r[4] < least_words]
    return sorted(told, key=repr)


@pytest.mark.parametrize("longest", [1, 2])
def test_resample(spark, docs, rows, longest):
    texts = [r[1] for r in rows[:12]] + [None, ""]
    targets = spark.createDataFrame([(t, "x") for t in texts], "text string, score string")
    found = resample(docs, targets, longest=longest)
    assert found.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted(map(tuple, found.collect()), key=repr) == plain_sample([(r[0], r[1]) for r in rows], texts, longest)


def test_resample_of_and_towards_nothing(spark, docs, empty, rows):
    targets = spark.createDataFrame([("the of",)], "text string")
    assert resample(empty, targets).collect() == []
    found = resample(docs, targets.filter("text = ''"))
    assert sorted(map(tuple, found.collect()), key=repr) == plain_sample([(r[0], r[1]) for r in rows], [])


def test_scoring_shuffles_nothing(docs):
    from trailmill.llm.resample import scored

    exchanges = lambda df: df._jdf.queryExecution().executedPlan().toString().count("Exchange")
    assert exchanges(scored(docs, gains([1] * 10_000, [2] * 10_000), 1, 2024)) == exchanges(docs)


def plain_scan(text):
    """All equal runs of text and templates, by two loops."""
    ws = plain_words(text)
    base, best, names, places = set(), 0.0, set(), []
    for _, is_base, label, ts, must, without in template_words():
        if is_base:
            at = [i for i in range(len(ws)) if ws[i : i + len(ts)] == ts]
            places += at
            base |= {label} if at else set()
            continue
        lines = defaultdict(list)
        for i in range(len(ws) - GRAM + 1):
            for t in range(len(ts) - GRAM + 1):
                if ws[i : i + GRAM] == ts[t : t + GRAM]:
                    lines[i - t].append((i, t))
        groups = []
        for d in sorted(lines):
            if groups and d - groups[-1][-1] <= DRIFT:
                groups[-1].append(d)
            else:
                groups.append([d])
        for group in groups:
            hits = [(i, t) for d in group for i, t in lines[d]]
            held = {x for i, t in hits for x in range(max(0, t - REACH), min(len(ts), t + GRAM + REACH)) if 0 <= x + i - t < len(ws) and ws[x + i - t] == ts[x]}
            around = {w for i, _ in hits for w in ws[max(0, i - REACH) : i + GRAM + REACH]}
            share = len(held) / len(ts)
            best = max(best, share)
            stretched = max(i for i, _ in hits) + GRAM - min(i for i, _ in hits) > 2 * len(ts)
            if share >= SHARE and set(must) <= held and not around & set(without) and not stretched:
                names.add(label)
    return (len(ws), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(base | names)), 1.0 if places else best)


def license_texts():
    rng = random.Random(9)
    noise = lambda n: " ".join(rng.choice("the of and in software license this permission copy under terms public".split()) for _ in range(n))
    texts = [None, "", "mit", "Under the MIT License", "under the mit license under the mit license", "CC BY-NC, cc by nc 4.0", "Apache License, Version 2.0", "the apache  license\nVERSION 2", "ünder the mit licensé", noise(400), noise(3000)]
    for _, _, _, words, _, _ in template_words():
        whole = " ".join(words)
        texts += [whole, noise(30) + " " + whole.upper() + ". " + noise(30)]
        edited = words.copy()
        if len(edited) > 12:
            edited[len(edited) // 2] = "changed"  # another word
            edited.insert(len(edited) // 3, "inserted")  # one more
            del edited[-5]  # one less
        texts += [noise(5) + " " + " ".join(edited), " ".join(words[: len(words) // 2]), f"{whole} {noise(8)} {whole}"]
    texts.append("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.")
    texts.append(" ".join([whole, noise(20)] * 300))
    return texts


def test_licenses(spark):
    texts = license_texts()
    df = spark.createDataFrame([(k // 2, t, "x", "y") for k, t in enumerate(texts)], "doc_id long, text string, labels string, row string").repartition(3)
    told = Counter((r.doc_id, *r[1:8]) for r in scan_licenses(df).collect())
    assert told == Counter((k // 2, *plain_scan(t)) for k, t in enumerate(texts))


def test_licenses_tell_alike_ones_apart(spark):
    cases = {
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.": "gpl-3",
        "Licensed under the GNU General Public License, version 2": "gpl-2",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.": "cc-by-sa",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.": "cc-by",
        "Permission to deal in the software was the talk of the town": "",
    }
    df = spark.createDataFrame(list(enumerate(cases)), "doc_id long, text string")
    assert {r.doc_id: r.labels for r in scan_licenses(df).collect()} == dict(enumerate(cases.values()))


def test_licenses_of_nothing(empty):
    assert scan_licenses(empty).collect() == []


def test_spans_of_licenses(spark):
    words = template_words()[-7][3]
    text = " ".join(["word"] * 10 + words + ["word"] * 10)
    spans = scan_licenses(spark.createDataFrame([(1, text)], "doc_id long, text string")).select(F.explode("spans").alias("s")).select("s.*").collect()
    assert [(r["from"], r["to"], r["share"]) for r in spans] == [(10, 10 + len(words), 1.0)]


def test_licenses_are_few_files(spark, tmp_path):
    """Small results are not dealt to more files than cores, whatever the number of shuffle partitions."""
    df = spark.createDataFrame(list(enumerate(license_texts())), "doc_id long, text string")
    expected = Counter((r.doc_id, *r[1:8], str(r.spans)) for r in scan_licenses(df).collect())
    held = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "23")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        scan_licenses(df).write.parquet(f"file://{tmp_path}/found")
        assert len(list((tmp_path / "found").glob("part-*"))) <= spark.sparkContext.defaultParallelism
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)
    assert Counter((r.doc_id, *r[1:8], str(r.spans)) for r in spark.read.parquet(f"file://{tmp_path}/found").collect()) == expected
