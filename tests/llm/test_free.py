import hashlib
import math
import os
import random
import re
import struct
from collections import Counter
from difflib import SequenceMatcher

import numpy as np
import pytest
from pyspark.sql import functions as F

from trailmill.llm.bpe import ByteBpe, bpe_round_trip, public_vocabulary
from trailmill.llm.langid import Automaton, LanguageModel, drop_unknown_language, identify, sample_texts
from trailmill.llm.mixing import mix, round_run, source_recipe, take_mix
from trailmill.llm.neardup import near_components
from trailmill.llm.polyhash import PrefixHash, common_blocks, common_extension, common_extension_back, edited, estimated_likeness, fingerprint, fingerprint_edits, in_descending_order, likeness, parse, spans_equal
from trailmill.llm.quality import BUCKETS, features, fitted, gaps, score_quality
from trailmill.llm.simhash import simhash_components


def words_of(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def test_bpe_is_the_librarys(docs, rows, empty):
    tokenizers = pytest.importorskip("tokenizers")
    library = tokenizers.Tokenizer.from_file(public_vocabulary())
    found = Counter(tuple(r) for r in bpe_round_trip(docs, public_vocabulary()).collect())
    expected = Counter()
    for d, t, *_ in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        expected[d, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()] += 1
    assert found == expected
    assert bpe_round_trip(empty, public_vocabulary()).count() == 0


def test_bpe_on_odd_texts():
    tokenizers = pytest.importorskip("tokenizers")
    library = tokenizers.Tokenizer.from_file(public_vocabulary())
    with open(public_vocabulary()) as f:
        bpe = ByteBpe(f.read())
    rng = random.Random(3)
    texts = ["".join(rng.choice("aeth 's\n\t'llé😀  <|endoftext|>12३") for _ in range(60)) for _ in range(500)] + ["<|endoftext|>" * 3, "x" * 5000]
    for t in texts:
        ids = library.encode(t, add_special_tokens=False).ids
        assert bpe.encode(t) == struct.pack(f"<{len(ids)}I", *ids)
        assert bpe.decode(bpe.encode(t)) == t
    cut = bpe.encode("😀")[:4]
    assert bpe.decode(cut) == library.decode(list(struct.unpack("<I", cut)), skip_special_tokens=False)


def brute_targets(sizes, weights):
    left, targets, open_ = float(sum(sizes)), [0.0] * len(sizes), [i for i, s in enumerate(sizes) if s]
    while open_:
        w = sum(weights[i] for i in open_)
        over = [i for i in open_ if left * weights[i] / w > 3 * sizes[i] + 1e-9]
        for i in over or open_:
            targets[i] = 3.0 * sizes[i] if over else left * weights[i] / w
        left -= sum(3 * sizes[i] for i in over)
        open_ = [i for i in open_ if i not in over] if over else []
    return targets


def test_targets(spark):
    rng = random.Random(1)
    for n in (1, 3, 9, 300):
        sizes = [rng.choice((0, 5, 100, 4000)) for _ in range(n)]
        names = sorted(chr(rng.randint(33, 50000)) + str(k) for k in range(n - 1)) + [None]
        rows = spark.createDataFrame([(a, size) for a, size in zip(names, sizes)], "source string, size long").repartition(3)
        found = sorted(source_recipe(rows).collect(), key=lambda r: r.source_no)
        assert [r.of_source for r in found] == names and [r.source_no for r in found] == list(range(n))
        assert [r.target for r in found] == pytest.approx(brute_targets(sizes, [1 + k % 3 for k in range(n)]))
        assert sum(r.target for r in found) == pytest.approx(sum(sizes))


def test_rounding_keeps_sums_and_expectations():
    rng = np.random.default_rng(2)
    size = np.array([5000, 400, 300, 200, 100, *[10] * 60])
    chance = rng.uniform(0, 1, len(size))
    runs = []
    for _ in range(3000):
        p, held = round_run(chance, size, rng.uniform(size=len(size)))
        assert sum(0 < x < 1 for x in p) == (held >= 0)
        assert abs((p * size).sum() - (chance * size).sum()) < 1e-6 * size.sum() + (0 if held < 0 else 0) + 1e-3
        runs.append(p)
    assert np.abs(np.mean(runs, axis=0) - chance).max() < 0.06


def test_mix(docs, rows, empty, monkeypatch):
    monkeypatch.setattr("trailmill.llm.mixing.CHUNK_ROWS", 20)
    found = mix(docs).collect()
    assert len(found) == len(rows)
    sources = sorted({s for *_, s, _ in rows}, key=lambda s: (s is None, s or ""))
    sizes = [sum(words_of(t) for _, t, _, s, _ in rows if s == x) for x in sources]
    targets = dict(zip(sources, brute_targets(sizes, [1 + k % 3 for k in range(len(sources))])))
    for s, total in zip(sources, sizes):
        own = [r for r in found if r.source == s]
        assert all(r.source_size == total and r.target == pytest.approx(targets[s]) and r.taken == r.copies * r.size and 0 <= r.copies <= 3 for r in own)
        assert abs(sum(r.taken for r in own) - targets[s]) <= max(r.size for r in own)
    assert Counter(map(tuple, found)) == Counter(map(tuple, mix(docs.repartition(5)).collect()))
    assert mix(empty).count() == 0
    wide = docs.withColumn("n", F.lit("x"))
    assert take_mix(wide).columns == wide.columns
    taken, copies = Counter((r.doc_id, r.source, words_of(r.text)) for r in take_mix(wide).collect()), Counter()
    for r in found:
        copies[r.doc_id, r.source, r.size] += r.copies
    assert taken == Counter({k: v for k, v in copies.items() if v})


def test_take_mix_of_repeated_ids(spark, monkeypatch):
    """The words taken come near the target whatever rows share an id or are equal; equal rows are spread in blocks."""
    monkeypatch.setattr("trailmill.llm.mixing.BLOCK_ROWS", 50)
    rng = random.Random(4)
    for ids in ((lambda k: None), (lambda k: k % 7), (lambda k: k)):
        rows = [(ids(k), " ".join("w" * rng.randint(1, 30)), rng.choice(("a", "b", None))) for k in range(300)] + [(1, "one and the same text", "b")] * 400
        docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
        taken, told = take_mix(docs).collect(), mix(docs).collect()
        assert len(told) == len(rows) and all(0 <= r.copies <= 3 for r in told)
        for source in ("a", "b", None):
            target = next(r.target for r in told if r.source == source)
            words = sum(words_of(r.text) for r in taken if r.source == source)
            assert abs(words - target) <= 30 and words == sum(r.taken for r in told if r.source == source)


def phrases(text, sample):
    count, at = 0, 0
    while at < len(text):
        n = 0
        while at + n < len(text) and text[at : at + n + 1] in sample:
            n += 1
        if at + n == len(text):
            break
        count += 1
        at += max(n, 1) if text[at] not in sample else n
    return count


def test_cross_parsing():
    rng = random.Random(4)
    sample = [rng.randint(1, 4) for _ in range(300)]
    automaton = Automaton(sample, 6)
    as_text = "".join(map(str, sample))
    texts = sorted(([rng.randint(1, 4) for _ in range(n)] for n in (90, 50, 7)), key=len, reverse=True)
    steps = np.zeros((90, 3), np.int32)
    for k, t in enumerate(texts):
        steps[: len(t), k] = t
    found = automaton.phrases(steps, np.array([len(t) for t in texts]))
    assert found.tolist() == [phrases("".join(map(str, t)), as_text) for t in texts]


def test_languages(docs, rows, empty):
    found = identify(docs).collect()
    assert len(found) == len(rows)
    lang = {d: x for d, _, x, *_ in rows}
    told = [r for r in found if r.doc_id is not None and r.doc_id < 120 and r.held_out]
    assert told and sum(r.lang_pred == lang[r.doc_id] for r in told) >= 0.9 * len(told)
    by_id = {r.doc_id: r for r in found}
    assert all(by_id[d].lang_pred == "und" and by_id[d].score == 0 for d in (170, 171, 172, 173))
    assert all(0 <= r.score <= 1 for r in found)
    assert identify(empty).count() == 0
    kept = drop_unknown_language(docs)
    assert kept.columns == docs.columns and {d for d, *_ in rows} - {r.doc_id for r in kept.collect()} == {170, 171, 172, 173}


def test_nothing_is_dropped_where_nothing_is_learned(spark):
    rows = [(1, "some words", None), (2, "12 !", None), (3, None, None), (4, "其他", None)]
    kept = drop_unknown_language(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    assert sorted(map(tuple, kept)) == [(1, "some words", "und"), (4, "其他", "und")]


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test data")
def test_held_out_documents(spark):
    """Held-out accuracy of languages and held-out ranking by quality on the test tables."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    lang = {r.doc_id: r.lang for r in docs.collect()}
    told = [r for r in identify(docs).collect() if r.held_out and lang[r.doc_id] and r.lang_pred != "und"]
    assert len(told) > 200 and sum(r.lang_pred == lang[r.doc_id] for r in told) >= 0.97 * len(told)
    quality = {r.doc_id: r.quality for r in labels.collect()}
    scored = [(r.score, quality[r.doc_id]) for r in score_quality(docs, labels).collect() if r.held_out and quality.get(r.doc_id) is not None]
    good, bad = ([s for s, q in scored if q == k] for k in (1, 0))
    assert len(good) > 20 and len(bad) > 5
    assert sum((g > b) + 0.5 * (g == b) for g in good for b in bad) >= 0.95 * len(good) * len(bad)


def test_only_so_many_languages(spark, monkeypatch):
    monkeypatch.setattr("trailmill.llm.langid.LANGUAGES", 2)
    rows = [(k, "some text", lang) for k, lang in enumerate(["en"] * 9 + ["de"] * 5 + ["fr"] * 3 + ["es"])]
    assert sorted(sample_texts(spark.createDataFrame(rows, "doc_id long, text string, lang string"), F.lit(True))) == ["de", "en"]


def test_quality_of_odd_rows(spark):
    """Very long texts and words, ids that rows or labels repeat, clashing names, against plain sums."""
    rng = random.Random(2)
    good, bad = "river stone walk under green hills".split(), "buy now win".split()
    rows = [(k % 40, " ".join(rng.choice(good if k % 40 % 3 else bad) for _ in range(20))) for k in range(120)] + [(50, "river " * 100_000), (51, "x" * 300_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("y") for c in ("score", "held_out", "quality", "predicted", "label_id")})
    labels = spark.createDataFrame([(k, int(k % 3 > 0)) for k in range(40)] * 2, "doc_id long, quality int")
    found = {(r.doc_id, r.score) for r in score_quality(docs, labels).collect()}
    model = fitted(docs, labels)
    expected = set()
    for d, t in rows:
        used = [x for w in t.split() for x in features(w)] + [BUCKETS + k for k, n in enumerate(gaps(t.split())) for _ in range(n)]
        expected.add((d, 1 / (1 + math.exp(-min(30, max(-30, model[used].mean() + model[-1]))))))
    assert len(found) == len(expected)
    assert all(abs(a[1] - b[1]) < 1e-6 for a, b in zip(sorted(found), sorted(expected)))


def test_gaps():
    assert gaps("a a b a c d e f g a".split()) == [1, 1, 1, 0, 0, 0, 0, 7]


def test_session_settings_stay(spark, docs):
    """Building and running operators changes no setting of the session."""
    before = {r[0]: r[1] for r in spark.sql("set").collect()}
    built = bpe_round_trip(docs, public_vocabulary())
    simhash_components(docs).count()
    near_components(docs.limit(20)).count()
    assert built.count() == docs.count()
    assert {r[0]: r[1] for r in spark.sql("set").collect()} == before


def test_model_without_samples():
    assert LanguageModel({}).predict(["abc", None, "1"]) == [("und", 0.0)] * 3


def test_all_letters_have_classes():
    latin, greek, cyrillic, han, kana, hangul = (range(a, a + 24) for a in (0x61, 0x3B1, 0x430, 0x4E00, 0x3042, 0xAC00))
    rng = random.Random(8)
    text = lambda alphabet, n: " ".join("".join(chr(rng.choice(alphabet)) for _ in range(6)) for _ in range(n))
    alphabets = {"la": latin, "el": greek, "ru": cyrillic, "zh": han, "ja": kana, "ko": hangul}
    samples = {k: text(v, 2000 if k == "la" else 100) for k, v in alphabets.items()}
    model = LanguageModel(samples)
    assert all(model.table[ord(c)] > 1 for v in samples.values() for c in v if c != " ")
    assert len({int(model.table[ord(c)]) for v in samples.values() for c in v}) == len(set("".join(samples.values())))
    assert model.table[ord("Я")] == model.table[ord("я")] and model.table[ord("1")] == model.table[0x10FFFF] == 0
    assert [x for x, _ in model.predict([text(v, 20) for v in alphabets.values()])] == list(alphabets)


def test_whole_texts_are_sampled(spark):
    texts = {k: f"{k} " + "word " * 2000 + f"end{k}" for k in range(40)}
    rows = [(k, t, "en") for k, t in texts.items()] + [(40, f"same id {k}", "de") for k in range(9)]
    samples = sample_texts(spark.createDataFrame(rows, "doc_id long, text string, lang string"), F.lit(True))
    taken = samples["en"].split("\n")[:-1]
    assert len(taken) > 15 and set(taken) <= set(texts.values())
    assert samples["de"] == "same id 0\n"


def test_prefix_hashes():
    rng = random.Random(6)
    a, b = "".join(rng.choice("ab") for _ in range(300)), "".join(rng.choice("ab") for _ in range(300))
    b = b[:50] + a[100:220] + b[50:]
    pa_, pb = PrefixHash(a), PrefixHash(b)
    for i, j in [(100, 50), (101, 51), (0, 0), (299, 419), (300, 3), *((rng.randint(0, 300), rng.randint(0, 420)) for _ in range(200))]:
        n = 0
        while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n]:
            n += 1
        assert common_extension(pa_, i, pb, j) == n
        back = 0
        while back < min(i, j) and a[i - back - 1] == b[j - back - 1]:
            back += 1
        assert common_extension_back(pa_, i, pb, j) == back
        assert spans_equal(pa_, i, pb, j, 3) == (a[i : i + 3] == b[j : j + 3] and i + 3 <= 300 and j + 3 <= 420)


def test_fingerprint_edits(docs, rows, empty):
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))
    found = fingerprint_edits(docs).collect()
    assert len(found) == len(rows)
    by_id = {}
    for r in found:
        by_id.setdefault(r.doc_id, []).append(r)
    for row, after in zip(order, order[1:] + order[:1]):
        if row[0] is None or after[0] is None or 5 in (row[0], after[0]):
            continue
        text, nxt, r = row[1] or "", after[1] or "", by_id[row[0]][0]
        changed = edited(text, nxt)
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(changed.encode()).hexdigest())
        own, other = fingerprint(text), fingerprint(changed)
        assert (r.fingerprint, r.edited_fingerprint) == (str(own), str(other))
        assert r.near_edited == likeness(own, other) and r.near_next == likeness(own, fingerprint(nxt))
    assert fingerprint_edits(empty).count() == 0
    one = fingerprint_edits(docs.filter("doc_id = 7")).collect()
    assert len(one) == 1 and one[0].near_next == 1.0


def test_ranges_hold_hot_ids(spark):
    """Null and repeated ids are cut by their texts, and each range ends with the first row of the next."""
    rows = [(None, f"n{k}") for k in range(300)] + [(7, f"s{k}") for k in range(300)] + [(k, f"t{k}" * (k % 5)) for k in range(100, 400)]
    found = in_descending_order(spark.createDataFrame(rows, "doc_id long, text string"))
    parts = {}
    for r in found.collect():
        parts.setdefault(r.part, []).append(r)
    own = [[r for r in parts[k] if not r.guest] for k in sorted(parts)]
    assert len(own) >= 4 and max(map(len, own)) < 500 and sum(map(len, own)) == len(rows)
    order = [r for p in own for r in p]
    assert [r.doc_id for r in order] == sorted((r[0] for r in rows), key=lambda d: (d is None, -(d or 0)))
    for p, after in zip(sorted(parts), own[1:] + own[:1]):
        assert [(r.doc_id, r.text) for r in parts[p] if r.guest] == [(after[0].doc_id, after[0].text)]


def test_likeness():
    rng = random.Random(8)
    a = "".join(rng.choice("abcdefgh ") for _ in range(3000))
    assert likeness(fingerprint(a), fingerprint(a)) == 1 and likeness(fingerprint(""), fingerprint("")) == 1 and likeness(fingerprint(""), fingerprint(a)) == 0
    assert 0.4 < likeness(fingerprint(a), fingerprint(edited(a, a[::-1]))) < 0.9
    assert estimated_likeness(parse(str(fingerprint(a))), fingerprint(a)) == 1 and abs(estimated_likeness(fingerprint(a), fingerprint(edited(a, a[::-1]))) - 2 / 3) < 0.2
    assert likeness(fingerprint(a), fingerprint(edited(a, a[::-1]))) == pytest.approx(2 / 3, abs=0.01)
    for _ in range(30):  # against a plain comparison of all blocks
        x = "".join(rng.choice("abcdefgh ") for _ in range(rng.randint(100, 400)))
        y = list(x)
        for _ in range(rng.randint(0, 4)):
            y.insert(rng.randint(0, len(y)), rng.choice(("#", "a##b", x[:40])))
        y = "".join(y)
        for i, j, n in common_blocks(fingerprint(x), fingerprint(y)) if x and y else []:
            assert x[i : i + n] == y[j : j + n] and x[i - 1 : i] + "<" != y[j - 1 : j] + "<" * (i * j > 0) and x[i + n : i + n + 1] != (y[j + n : j + n + 1] or "<")
        plain = SequenceMatcher(None, x, y, autojunk=False).ratio() if x or y else 1
        assert likeness(fingerprint(x), fingerprint(y)) >= plain - 0.2
    again = parse(str(fingerprint(a)))
    assert again.whole == fingerprint(a).whole and np.array_equal(again.sketch, fingerprint(a).sketch)


def test_quality(spark, empty):
    rng = random.Random(9)
    good, bad = "river stone walk under green hills".split(), "CLICK!! BUY!! NOW!! WIN!!".split()
    rows = [(k, " ".join(rng.choice(good if k % 4 else bad) for _ in range(30))) for k in range(300)] + [(300, None), (301, ""), (None, "stone"), (7, "river")]
    labels = [(k, int(k % 4 > 0), 0) for k in range(300)] + [(None, 1, 0), (3, None, 0), (4, 9, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    told = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    found = score_quality(docs, told).collect()
    assert len(found) == len(rows)
    held = [r for r in found if r.held_out and r.doc_id is not None and r.doc_id < 300]
    assert held and all(r.predicted == int(r.doc_id % 4 > 0) for r in held if r.doc_id != 7)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in found)
    assert score_quality(empty, told).count() == 0
    assert {r.score for r in score_quality(docs, told.limit(0)).collect()} == {0.5}
