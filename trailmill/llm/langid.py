"""Language identification by cross-parsing entropy.

Each language has a suffix automaton of the texts of a sample of its labelled documents, bounded in documents and characters. A text is parsed from left to
right into the longest phrases that occur in the sample, which is a walk through the automaton; a phrase
ends where no transition goes on. The language that needs the fewest phrases for a letter wins. Many
texts are walked abreast: each step looks up the next states of all of them in a table of transitions.
Texts are parsed whole, in segments of ``SEGMENT`` characters whose ends also end a phrase.
"""

from __future__ import annotations

import hashlib
import unicodedata
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..scratch import saved
from .text import crc_share, kept_in_worker, slices

#: Bounds of the labelled sample: documents of a language, languages (those of most documents), and characters, of one language and of all.
SAMPLE_DOCS, LANGUAGES, LANGUAGE_CHARS, SAMPLE_CHARS = 64, 200, 1 << 18, 1 << 20
SEGMENT = 1024
#: Odd factor that spreads transitions over the slots.
_SPREAD = np.uint64(0x9E3779B97F4A7C15)


class Automaton:
    """Suffix automaton over classes 1 to ``size - 1``, of any number; state 0 is the root, -1 none.

    Transitions stand in an open-addressing table of at least twice as many slots, by state and class; only the root has a dense row.
    """

    def __init__(self, text: list[int], size: int) -> None:
        # nearly all states have one transition: it stands in ``only`` and ``goes``, further ones of a state in ``more``
        links, lengths, only, goes = array("i", [-1]), array("i", [0]), array("i", [-1]), array("i", [-1])
        more: dict[int, dict[int, int]] = {}
        last = 0
        for c in text:
            here = len(links)
            links.append(0)
            lengths.append(lengths[last] + 1)
            only.append(-1)
            goes.append(-1)
            at, to = last, -1
            while at >= 0:
                if only[at] == c:
                    to = goes[at]
                    break
                if only[at] < 0:
                    only[at], goes[at] = c, here
                else:
                    others = more.setdefault(at, {})
                    if c in others:
                        to = others[c]
                        break
                    others[c] = here
                at = links[at]
            if to >= 0:
                if lengths[to] == lengths[at] + 1:
                    links[here] = to
                else:
                    twin = len(links)
                    links.append(links[to])
                    lengths.append(lengths[at] + 1)
                    only.append(only[to])
                    goes.append(goes[to])
                    if to in more:
                        more[twin] = dict(more[to])
                    while at >= 0:
                        if only[at] == c:
                            if goes[at] != to:
                                break
                            goes[at] = twin
                        elif more[at][c] == to:
                            more[at][c] = twin
                        else:
                            break
                        at = links[at]
                    links[to] = links[here] = twin
            last = here
        states, n = np.flatnonzero(np.array(only, np.int64) >= 0), sum(map(len, more.values()))
        owner = np.concatenate((states, np.fromiter((k for k, others in more.items() for _ in others), np.int64, n)))
        classes = np.concatenate((np.array(only, np.int64)[states], np.fromiter((c for others in more.values() for c in others), np.int64, n)))
        to = np.concatenate((np.array(goes, np.int64)[states], np.fromiter((t for others in more.values() for t in others.values()), np.int64, n)))
        keys, known = owner * size + classes, classes > 0
        self.root = np.full(size, -1, np.int64)
        self.root[classes[owner == 0]] = to[owner == 0] * size
        self.root[0] = -1
        offsets = to[known] * size  # states as offsets
        self.place(keys[known], offsets.astype(np.int32) if len(links) * size < 1 << 31 else offsets)

    def place(self, keys: np.ndarray, to: np.ndarray) -> None:
        """Put all transitions in the first free slots from their own on."""
        bits = max(1, int(2 * len(keys)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.to = np.full(1 << bits, -1, np.int64), np.full(1 << bits, -1, to.dtype)
        slots = self.slots(keys)
        while len(keys):
            free = np.flatnonzero(self.keys[slots] < 0)
            taken, first = np.unique(slots[free], return_index=True)
            put = free[first]
            self.keys[taken], self.to[taken] = keys[put], to[put]
            left = np.ones(len(keys), bool)
            left[put] = False
            keys, to, slots = keys[left], to[left], (slots[left] + 1) & self.mask

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """Where the search for each transition begins."""
        return (keys.view(np.uint64) * _SPREAD >> self.shift).view(np.int64)

    def step(self, keys: np.ndarray) -> np.ndarray:
        """Next state, as an offset, of each state and class; negative for none."""
        slots = self.slots(keys)
        held = self.keys[slots]
        out = np.where(held == keys, self.to[slots], -1)
        at = np.flatnonzero((held != keys) & (held >= 0))
        slots = slots[at]
        while len(at):
            slots = (slots + 1) & self.mask
            held = self.keys[slots]
            same = held == keys[at]
            out[at[same]] = self.to[slots[same]]
            on = ~same & (held >= 0)
            at, slots = at[on], slots[on]
        return out

    def phrases(self, classes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Phrases of each row of ``classes`` (steps, rows); rows are sorted by length, longest first."""
        root = np.maximum(self.root, 0)
        count = np.zeros(classes.shape[1], np.int32)
        state = np.zeros(classes.shape[1], np.int64)
        active = np.searchsorted(-lengths, -np.arange(1, len(classes) + 1), side="right")
        for step, n in enumerate(active):
            c = classes[step, :n]
            to = self.step(state[:n] + c)
            ended = to < 0
            count[:n] += ended
            state[:n] = np.where(ended, root[c], to)
        return count


def is_letter(c: str) -> bool:
    """Is the character a letter, or a mark that belongs to one?"""
    return unicodedata.category(c)[0] in "LM"


def classes_of(texts: list[str], table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Character classes of all texts one after another, and where each begins."""
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    return table[points], np.concatenate(([0], np.cumsum([len(t) for t in texts])))


class LanguageModel:
    """Automata by language and the characters that they tell apart.

    Each letter and mark of any sample has a class of its own, white space is class 1; class 0 stands for all others and ends a phrase.
    """

    def __init__(self, samples: dict[str, str]) -> None:
        self.languages = sorted(samples)
        lowered = {k: v.lower() for k, v in samples.items()}
        kept = sorted(c for c in set().union(*lowered.values()) if is_letter(c))
        number = {c: k + 2 for k, c in enumerate(kept)} | dict.fromkeys(" \t\n\r\x0b\x0c", 1)
        self.table = np.fromiter((number.get(c.lower(), 0) for c in map(chr, range(0x110000))), np.int32, 0x110000)
        self.automata = [Automaton(classes_of([lowered[k]], self.table)[0].tolist(), len(kept) + 2) for k in self.languages]

    def rates(self, texts: list[str]) -> np.ndarray:
        """Phrases for each character, by text and language."""
        classes, starts = classes_of(texts, self.table)
        owner, begins, lengths = [], [], []
        for k in range(len(texts)):
            cuts = np.arange(starts[k], starts[k + 1], SEGMENT)
            owner.append(np.full(len(cuts), k))
            begins.append(cuts)
            lengths.append(np.minimum(SEGMENT, starts[k + 1] - cuts))
        owner, begins, lengths = map(np.concatenate, (owner, begins, lengths))
        order = np.argsort(-lengths, kind="stable")
        owner, begins, lengths = owner[order], begins[order], lengths[order]
        padded = np.concatenate((classes, np.zeros(SEGMENT, classes.dtype)))
        steps = padded[np.minimum(begins[None, :] + np.arange(lengths.max(initial=0))[:, None], len(padded) - 1)]
        sizes = np.maximum(np.diff(starts), 1)
        found = [np.bincount(owner, weights=a.phrases(steps, lengths), minlength=len(texts)) for a in self.automata]
        return (np.array(found).T + 1) / sizes[:, None]

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """Language and score of each text; ``und`` without a letter or without a learned language."""
        out: list[tuple[str, float]] = [("und", 0.0)] * len(texts)
        told = [k for k, t in enumerate(texts) if t and self.languages and any(map(str.isalpha, t))]
        at = 0
        while at < len(told):  # so many texts at a time that the steps stay in a few MB
            stop, chars = at, 0
            while stop < len(told) and (stop == at or chars < 1 << 21):
                chars += len(texts[told[stop]])
                stop += 1
            rates = self.rates([texts[k] for k in told[at:stop]])
            weight = (rates.min(axis=1, keepdims=True) / rates) ** 4
            best = np.argmin(rates, axis=1)
            scores = 1 / weight.sum(axis=1)
            for k, b, s in zip(told[at:stop], best, scores):
                out[k] = (self.languages[b], float(s))
            at = stop
        return out


def sample_texts(docs: DataFrame, trained: object) -> dict[str, str]:
    """For each of at most LANGUAGES languages, the texts of at most SAMPLE_DOCS labelled rows, those least in hash buckets.

    Texts are taken until a language has its share of characters (LANGUAGE_CHARS, or less where many languages share SAMPLE_CHARS), and no
    text gives more than that, so the model has a bounded size whatever the texts. Only ids and labels are grouped over the
    whole table; texts of the chosen rows alone are read again.
    """
    rows = docs.select(docs["doc_id"].alias("doc_id"), docs["lang"].cast("string").alias("lang"), docs["text"].cast("string").alias("text"))
    order = F.xxhash64("doc_id", F.lit("sample"))
    picked = (
        rows.filter(trained & F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.length("text") > 0))
        .withColumns({"at": F.pmod(order, F.lit(SAMPLE_DOCS)), "order": order})
        .groupBy("lang", "at")
        .agg(F.min(F.struct("order", "doc_id")).alias("least"), F.count("*").alias("n"))
        .select("lang", "at", F.col("least.doc_id").alias("pick_id"), "n")
    )
    told = saved(picked, "langid-ids")
    most = told.groupBy("lang").agg(F.sum("n").alias("rows")).orderBy(F.desc("rows"), "lang").limit(LANGUAGES)
    ids = told.join(F.broadcast(most.select("lang")), "lang", "left_semi").drop("n")
    chosen = rows.withColumnRenamed("lang", "text_lang").join(F.broadcast(ids), (F.col("doc_id") == F.col("pick_id")) & (F.col("text_lang") == F.col("lang")))
    share = max(1, min(LANGUAGE_CHARS, SAMPLE_CHARS // max(1, most.count())))
    texts = chosen.groupBy("lang", "at").agg(F.min(F.substring("text", 1, share)).alias("text"))  # one text for a bucket, also where rows share an id
    before = F.sum(F.length("text")).over(W.partitionBy("lang").orderBy("at").rowsBetween(W.unboundedPreceding, -1))  # at most SAMPLE_DOCS rows a language
    found = texts.withColumn("before", before).filter(F.coalesce("before", F.lit(0)) < share).select("lang", "at", "text").collect()
    samples: dict[str, str] = {}
    for lang, _, text in sorted(found, key=lambda r: (r[0], r[1], r[2])):
        samples[lang] = samples.get(lang, "") + text + "\n"
    return samples


def ready(samples: dict[str, str]) -> LanguageModel:
    """The model of given samples, made once in each worker."""
    key = hashlib.sha256(repr(sorted(samples.items())).encode()).hexdigest()
    return kept_in_worker(f"languages {key}", lambda: LanguageModel(samples))


def predict_languages(docs: DataFrame, samples: dict[str, str]) -> DataFrame:
    """All columns of ``docs``, and __lang_pred, __lang_score and __has_letter."""
    sent = docs.sparkSession.sparkContext.broadcast(samples)
    at = docs.columns.index("text")

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = ready(sent.value)
        for batch in slices(it):
            texts = batch.column(at).cast(pa.string()).to_pylist()
            told = model.predict(texts)
            letters = [bool(t) and any(map(str.isalpha, t)) for t in texts]
            columns = [pa.array([x for x, _ in told], pa.string()), pa.array([x for _, x in told], pa.float64()), pa.array(letters, pa.bool_())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*batch.schema.names, "__lang_pred", "__lang_score", "__has_letter"])

    schema = T.StructType([*docs.schema.fields, T.StructField("__lang_pred", T.StringType()), T.StructField("__lang_score", T.DoubleType()), T.StructField("__has_letter", T.BooleanType())])
    return docs.mapInArrow(batches, schema)


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score of each row of ``docs``.

    Learns from rows with a label whose crc32(doc_id) mod 3 is not 1; ids, labels and sources are no inputs of a
    prediction. ``und`` with score 0 where the text is null or has no letter, or nothing could be
    learned. Of languages that need as few phrases, the first by name wins. Repeated rows stay repeated; an empty table
    gives no rows; columns of other names are not read.
    """
    held_out = crc_share(docs["doc_id"], 3) == 1
    samples = sample_texts(docs, ~held_out)
    rows = docs.select(docs["doc_id"].alias("doc_id"), held_out.alias("held_out"), docs["text"].alias("text"))
    return predict_languages(rows, samples).select("doc_id", "held_out", F.col("__lang_pred").alias("lang_pred"), F.col("__lang_score").alias("score"))


def drop_unknown_language(docs: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose text has a letter, with their columns; a missing label is filled in, as ``und`` where nothing could be learned."""
    told = predict_languages(docs, sample_texts(docs, crc_share(docs["doc_id"], 3) != 1)).filter("__has_letter")
    return told.withColumn("lang", F.coalesce("lang", "__lang_pred")).drop("__lang_pred", "__lang_score", "__has_letter")


def op7_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document."""
    return identify(spark.read.parquet(f"{sf_dir}/documents.parquet"))
