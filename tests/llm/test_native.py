import hashlib
import itertools
import re
import zlib
from collections import Counter, defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st

from trailmill.llm.exact import directory_of, drop_exact_copies, exact_dedup, owners_of, split_buckets
from trailmill.llm.shards import cut, plan_shards, shard_documents, smallest_capacity


def norm(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 50), min_size=1, max_size=9), st.integers(1, 5))
def test_cut_is_minimax(sizes, shards):
    best = min(max(sum(sizes[a:b]) for a, b in itertools.pairwise([0, *cuts, len(sizes)])) for cuts in itertools.combinations_with_replacement(range(len(sizes) + 1), shards - 1))
    assert smallest_capacity(sizes, shards) == best
    cuts = cut(sizes, shards)
    assert len(cuts) == shards - 1 and cuts == sorted(cuts)
    assert max(sum(sizes[a:b]) for a, b in itertools.pairwise([0, *cuts, len(sizes)])) == best


def test_hot_atom_gets_its_own_shard():
    sizes = {k: 10 for k in range(100)} | {7: 900}
    plan = plan_shards(sizes, 10, 100)
    assert plan.hot == [7] and len(plan.cuts) == 8


def test_shards(docs, rows):
    found = shard_documents(docs, 8).collect()
    assert len(found) == len(rows)
    text = defaultdict(list)
    for d, t, *_ in rows:
        text[d].append(t)
    for r in found:
        assert any(r.size == len((t or "").encode()) + 16 and r.text_crc32 == zlib.crc32((t or "").encode()) for t in text[r.doc_id])
    for shard in range(8):
        assert sorted(r.slot for r in found if r.shard == shard) == list(range(sum(r.shard == shard for r in found)))
    of_text = defaultdict(set)
    for r in found:
        of_text[r.text_crc32].add(r.shard)
    assert all(len(s) == 1 for s in of_text.values())
    sizes = Counter()
    for r in found:
        sizes[r.shard] += r.size
    rest = sorted(sizes.values())[:-1]  # the long text has a shard of its own
    assert max(rest) < 2 * min(rest)


def test_shards_of_nothing(empty):
    assert shard_documents(empty).count() == 0


@given(st.dictionaries(st.integers(0, 255), st.integers(1, 90), max_size=60))
@settings(max_examples=60, deadline=None)
def test_directory_covers_all_prefixes(counts):
    buckets = split_buckets(counts, 100, 8)
    depth, slots = directory_of(buckets)
    assert len(slots) == 1 << depth and slots == sorted(slots)
    held = Counter()
    for prefix, n in counts.items():
        held[slots[prefix >> (8 - depth)]] += n
    assert all(n <= 100 or buckets[b][1] == 8 for b, n in held.items())


def test_owners_have_even_ranges():
    counts = {k: 1 + k % 3 for k in range(0, 1 << 16, 7)}
    buckets = split_buckets(counts, 40)
    owners = owners_of(buckets, counts, 13)
    assert owners == sorted(owners) and set(owners) == set(range(13))
    held = Counter()
    for prefix, n in counts.items():
        held[owners[next(k for k, (p, d) in enumerate(buckets) if prefix >> (16 - d) == p)]] += n if prefix % 91 == 0 else 0
    assert max(held.values()) < 1.3 * sum(held.values()) / 13


def test_exact(docs, rows):
    groups = defaultdict(list)
    for d, t, *_ in rows:
        groups[norm(t)].append(d)
    expected = Counter()
    for d, t, *_ in rows:
        ids = [x for x in groups[norm(t)] if x is not None]
        keep = min(ids) if ids else None
        expected[d, keep, len(groups[norm(t)]), d == keep, hashlib.sha256(norm(t).encode()).hexdigest()] += 1
    for capacity, key_bits in ((4096, 64), (3, 64), (2, 3), (1, 1)):
        found = exact_dedup(docs, capacity, key_bits).collect()
        assert Counter(tuple(r)[:5] for r in found) == expected
        # every text is one link of the chain under its key, without gaps
        chains = defaultdict(dict)
        for r in found:
            chains[r.bucket].setdefault(r.text_sha256, r.chain)
        if key_bits == 1:
            assert len(chains) == 2 and all(sorted(c.values()) == list(range(len(c))) for c in chains.values())


def test_hot_keys_are_combined(docs, rows, monkeypatch):
    monkeypatch.setattr("trailmill.llm.exact.HOT_ROWS", 1)
    found = Counter(tuple(r)[:5] for r in exact_dedup(docs).collect())
    monkeypatch.setattr("trailmill.llm.exact.HOT_ROWS", 1000)
    assert found == Counter(tuple(r)[:5] for r in exact_dedup(docs).collect())


def test_exact_copies_drop(docs, rows, empty):
    kept = drop_exact_copies(docs)
    assert kept.columns == docs.columns
    assert Counter(norm(r.text) for r in kept.collect()) == Counter({norm(t) for _, t, *_ in rows})
    assert exact_dedup(empty).count() == 0 and drop_exact_copies(empty).count() == 0
