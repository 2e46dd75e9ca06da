import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash

from trailmill.llm.graph import components
from trailmill.llm.neardup import PIVOTS, band_keys, bucket_pairs, candidate_pairs, cell_links, drop_near_copies, near_components, shingle_hashes
from trailmill.llm.simhash import agreeing_masks, fingerprint, join_labels, link_bucket, link_sorted, links, majority, simhash_components, within


def plain_fingerprint(text, words):
    found = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not found:
        return 0
    shingles = [" ".join(found[i : i + words]) for i in range(len(found) - words + 1)] or [" ".join(found)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots(nodes, pairs):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("radius", range(6))
def test_within(radius):
    rng = np.random.default_rng(radius)
    x = np.array([sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 9), replace=False)) for _ in range(1000)], dtype=np.uint64)
    assert (within(x, radius) == (np.bitwise_count(x) <= radius)).all()


def near_prints(n, seed=1):
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 1 << 63, 12, dtype=np.uint64)
    flips = np.array([sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 6), replace=False)) for _ in range(n)], dtype=np.uint64)
    return np.unique(base[rng.integers(0, 12, n)] ^ flips)


def brute_pairs(fps, radius):
    return [(int(a), int(b)) for k, a in enumerate(fps) for b in fps[k + 1 :][np.bitwise_count(fps[k + 1 :] ^ a) <= radius]]


def test_blocks_lose_no_link(monkeypatch):
    fps = near_prints(600)
    masks = np.array(agreeing_masks(4), dtype=np.uint64)
    pairs = []
    for direct in (4096, 8):  # the smaller one deals overfull buckets afresh
        monkeypatch.setattr("trailmill.llm.simhash.DIRECT", direct)
        pairs = []
        for combo, mask in enumerate(masks):
            order = np.argsort(fps & mask, kind="stable")
            a, b = link_sorted(masks, np.full(len(fps), combo), fps[order], 4)
            pairs += zip(a.tolist(), b.tolist())
        nodes = fps.tolist()
        assert roots(nodes, pairs) == roots(nodes, brute_pairs(fps, 4))


def test_link_bucket_and_labels():
    labels = np.arange(6)
    join_labels(labels, np.array([0, 4, 2]), np.array([2, 5, 4]))
    assert labels.tolist() == [0, 1, 0, 3, 0, 0]
    labels = np.arange(3)
    link_bucket(np.array([0, 1, 1 << 40], dtype=np.uint64), np.arange(3), labels, (1 << 64) - 1, 1)
    assert labels.tolist() == [0, 0, 0]


def test_components(spark):
    edges = [(k, k + 1) for k in range(0, 40)] + [(100, k) for k in range(101, 700)] + [(100, 101), (5, 5)]
    found = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect()))
    expected = {k: 0 for k in range(1, 41)} | {k: 100 for k in range(101, 700)}
    assert found == expected
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_simhash(docs, rows, empty):
    for words in (4, 5):
        prints = [(d, plain_fingerprint(t, words)) for d, t, *_ in rows]
        assert all(fingerprint(None if t is None else t.encode(), words) == fp for (_, t, *_), (_, fp) in zip(rows, prints))
        fps = np.unique(np.array([fp for _, fp in prints], dtype=np.uint64))
        root = roots(fps.tolist(), brute_pairs(fps, 4))
        least = {}
        for d, fp in prints:
            if d is not None:
                least[root[fp]] = min(least.get(root[fp], d), d)
        expected = Counter((d, fp, least.get(root[fp])) for d, fp in prints)
        found = Counter((r.doc_id, r.fp % (1 << 64), r.component_id) for r in simhash_components(docs, words).collect())
        assert found == expected
    assert simhash_components(empty).count() == 0


def test_hot_buckets_are_dealt_afresh(spark, monkeypatch):
    fps = near_prints(500, seed=4)
    expected = roots(range(len(fps)), [(i, j) for i in range(len(fps)) for j in range(i) if int(fps[i] ^ fps[j]).bit_count() <= 4])
    prints = spark.createDataFrame([(int(f.astype(np.int64)),) for f in fps], "fp long").repartition(3)
    at = {int(f.astype(np.int64)): k for k, f in enumerate(fps)}
    for direct in (4096, 6):
        monkeypatch.setattr("trailmill.llm.simhash.DIRECT", direct)
        found = links(prints, 4).collect()
        assert roots(range(len(fps)), [(at[r.a], at[r.b]) for r in found]) == expected


def shingles(text, words=5):
    found = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(found[i : i + words]) for i in range(max(1, len(found) - words + 1))) if found else frozenset()


def alike(a, b):
    return a == b or len(a & b) >= 0.8 * len(a | b)


def least_of_groups(rows):
    """For each (doc_id, shingles) the smallest doc_id that links of 0.8 reach."""
    sets = sorted({shingles(t) for _, t in rows}, key=lambda s: sorted(s))
    root = roots(range(len(sets)), [(i, j) for i in range(len(sets)) for j in range(i) if alike(sets[i], sets[j])])
    number, least = {s: k for k, s in enumerate(sets)}, {}
    for d, t in rows:
        r = root[number[shingles(t)]]
        if d is not None:
            least[r] = min(least.get(r, d), d)
    return {s: least.get(root[k]) for s, k in number.items()}


def test_near_duplicates(spark, docs, rows, empty):
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    more = []
    for g in range(6):  # originals that come late, copies of them with a few words changed, and copies of copies
        base = [word() for _ in range(120)]
        for k in range(25 if g == 0 else 5):
            copy = list(base if k % 3 else (more[-1][1].split() if k else base))
            for _ in range(rng.randint(0, 4)):
                copy[rng.randrange(len(copy))] = word()
            more.append((1000 + g * 100 + k, " ".join(copy)))
        more.append((1000 + g * 100 + 99, " ".join(base)))
    added = docs.select("doc_id", "text").unionByName(spark.createDataFrame(more, "doc_id long, text string"))
    plain = [(d, t) for d, t, *_ in rows] + more
    least = least_of_groups([(d, t) for d, t in plain if d is not None])
    found = Counter((r.doc_id, r.component_id) for r in near_components(added).collect())
    expected = Counter((d, least.get(shingles(t))) for d, t in plain)
    assert found == expected
    kept = drop_near_copies(docs)
    assert kept.columns == docs.columns
    own = least_of_groups([(d, t) for d, t, *_ in rows if d is not None])
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted({v for v in own.values() if v is not None})
    assert near_components(empty).count() == 0


def copies_of_one(n, words=120, seed=5):
    """Texts made from one by a few changed words each, so that some are near each other and others only through a third."""
    rng = random.Random(seed)
    base = [f"w{rng.randrange(10**6)}" for _ in range(words)]
    out = []
    for k in range(n):
        own = list(out[rng.randrange(k)]) if k and rng.random() < 0.5 else list(base)
        for _ in range(rng.randrange(4)):
            own[rng.randrange(words)] = f"x{k}{rng.randrange(10**6)}"
        out.append(own)
    return [" ".join(x) for x in out]


def similar_pairs(sets, similarity=0.8):
    return [(a, b) for a in range(len(sets)) for b in range(a) if len(sets[a] & sets[b]) >= similarity * len(sets[a] | sets[b])]


def test_buckets_cover_all_pairs():
    hashes = [shingle_hashes(t.encode(), 5) for t in copies_of_one(150)]
    sets, fps = [np.unique(h) for h in hashes], np.array([majority(h) for h in hashes], np.uint64)
    plain = [set(s.tolist()) for s in sets]
    expected = roots(range(len(sets)), similar_pairs(plain))
    assert len(set(expected.values())) > 1
    i, j = bucket_pairs(fps, np.array([len(s) for s in sets]), 0.8)
    assert len(i) <= PIVOTS * len(fps) and (np.bitwise_count(fps[i] ^ fps[j]) <= 22).all()
    first = [(a, b) for a, b in zip(i.tolist(), j.tolist()) if len(plain[a] & plain[b]) >= 0.8 * len(plain[a] | plain[b])]
    labels = np.array([v for _, v in sorted(roots(range(len(sets)), first).items())])
    asked = labels != np.bincount(labels).argmax()
    a, b = cell_links(sets, labels.copy(), asked, 0.8)
    assert len(a) == len(set(labels.tolist())) - len(set(expected.values()))  # a spanning link for each two that meet
    assert roots(range(len(sets)), first + list(zip(a, b))) == expected
    assert cell_links(sets, labels * 0, asked, 0.8) == ([], [])


def test_cells_cover_large_buckets(spark, monkeypatch):
    texts = copies_of_one(80, seed=9)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    expected = roots(range(len(texts)), similar_pairs([set(shingle_hashes(t.encode(), 5).tolist()) for t in texts]))
    monkeypatch.setattr("trailmill.llm.neardup.CELL_ROWS", 7)
    for hot in (512, 5):  # with the smaller one all large buckets are hot
        monkeypatch.setattr("trailmill.llm.neardup.HOT_ROWS", hot)
        assert {r.doc_id: r.component_id for r in near_components(docs).collect()} == expected


def test_repeated_lines_hide_no_near_copy(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    texts = []
    for _ in range(12):  # 0.9 alike as sets, but one copy has a line 50 times
        body, line = [word() for _ in range(200)], [word() for _ in range(5)]
        texts += [" ".join(body + line), " ".join(body[:100] + [word()] + body[101:] + line * 50)]
    sets = [set(shingle_hashes(t.encode(), 5).tolist()) for t in texts]
    expected = roots(range(len(texts)), similar_pairs(sets))
    assert len(set(expected.values())) == 12
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in near_components(docs).collect()} == expected


def test_texts_without_or_with_shared_ids_stay(spark):
    base = " ".join(f"w{k}" for k in range(60))
    rows = [(None, "first text without id"), (None, "second text without id"), (None, "first text without id"), (None, None), (7, base), (7, "another text under that id"), (9, base + " more")]
    kept = drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter(map(tuple, kept)) == Counter(set(rows) - {(9, base + " more")})


def test_fingerprints_link_what_no_band_shares(spark):
    rng = random.Random(106928)
    base = [f"w{rng.randrange(10**6)}" for _ in range(84)]
    texts = [" ".join(base), " ".join(base + [f"x{rng.randrange(10**6)}" for _ in range(20)])]
    a, b = (np.unique(shingle_hashes(t.encode(), 5)) for t in texts)
    assert not set(band_keys(a)) & set(band_keys(b)) and (majority(a) ^ majority(b)).bit_count() <= 4 and similar_pairs([set(a.tolist()), set(b.tolist())])
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert [r.component_id for r in near_components(docs).collect()] == [0, 0]
    assert [r.doc_id for r in drop_near_copies(docs).collect()] == [0]


def test_fingerprints_alone_link_nothing(spark, monkeypatch):
    """Sets of fingerprints near each other are settled by their similarity like all candidates."""
    monkeypatch.setattr("trailmill.llm.neardup.RADIUS", 5)
    texts = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(n)) for rng in [random.Random(8)] for n in (1, 2, 3, 30, 30)] + ["", None, "...", "one", "one two"]
    sets = [set(shingle_hashes((t or "").encode(), 5).tolist()) for t in texts]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    expected = roots(range(len(texts)), similar_pairs(sets) + [(6, 5)])
    assert {r.doc_id: r.component_id for r in near_components(docs).collect()} == expected


def test_buckets_are_made_once(spark, docs, monkeypatch):
    plans = []

    def seen(rows, *rest):
        plans.append(rows._jdf.queryExecution().optimizedPlan().toString())
        return candidate_pairs(rows, *rest)

    monkeypatch.setattr("trailmill.llm.neardup.candidate_pairs", seen)
    near_components(docs).count()
    assert len(plans) == 1 and "Generate" not in plans[0]


@pytest.mark.parametrize("few", [0, 100_000])
def test_components_with_and_without_hubs(spark, monkeypatch, few):
    monkeypatch.setattr("trailmill.llm.graph.FEW", few)
    monkeypatch.setattr("trailmill.scratch.ROWS_A_FILE", 50)
    edges = [(k, k + 1) for k in range(0, 30)] + [(100, k) for k in range(101, 400)] + [(400 + k, 400) for k in range(1, 200)] + [(5, 5)]
    found = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert found == {b: r for nodes, r in ((range(31), 0), (range(100, 400), 100), (range(400, 600), 400)) for b in nodes if b != r}


def test_components_are_few_files(spark):
    cores = spark.sparkContext.defaultParallelism
    held = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "23")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        found = components(spark.createDataFrame([(k, k + 1) for k in range(0, 300, 2)], "a long, b long"))
        assert found.count() == 150 and len(found.inputFiles()) <= cores
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)
