"""Quality scores from supervised subword embeddings.

Words and their character n-grams have learned vectors in hashed rows, and so has how far back a word's like stands; a text
is the average of all these vectors, and a softmax over two classes gives the probability of label 1.
Vectors and output are trained by numpy stochastic gradient descent on a bounded sample of labelled rows.
The output is linear in the average, so each hashed row counts by one number once training is
over; a worker sums these numbers a word and remembers words that recur.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from operator import mul
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import saved
from .text import crc_share, kept_in_worker, slices, text_or_empty

#: Bounds of the training sample: about so many rows of each label.
SAMPLE_ROWS = 1500
BUCKETS, WIDTH, GRAMS = 1 << 17, 12, (3, 4)
EPOCHS, RATE = 4, 2.0
#: Words that a worker remembers in each of two generations, and how long they may be.
REMEMBERED, LONGEST = 200_000, 64
#: Rows for how far back the like of a word stands, beside the hashed rows.
GAPS = 8
THRESHOLD = 0.3


def features(word: str) -> list[int]:
    """Hashed rows of a word: the word itself and its character n-grams with marked ends."""
    points = f"<{word}>".encode("utf-32-le", "surrogatepass")  # four bytes a character
    grams = [points[k : k + 4 * n] for n in GRAMS for k in range(0, len(points) - 4 * n + 1, 4)]
    return [crc32(g) % BUCKETS for g in [points, *grams]]


def gaps(words: list[str]) -> list[int]:
    """How many words stand 1, 2 to 3, 4 to 7, ... places after their like, up to 64 and more; last, how many stand there first."""
    last: dict[str, int] = {}
    counts = [0] * GAPS
    for at, word in enumerate(words):
        before = last.get(word)
        counts[-1 if before is None else min(GAPS - 1, (at - before).bit_length()) - 1] += 1
        last[word] = at
    return counts


class Remembered(dict):
    """What a function gives for a word; when full, only words met again stay, and long words never do."""

    def __init__(self, make) -> None:
        super().__init__()
        self.make, self.older = make, {}

    def __missing__(self, word: str):
        if len(word) > LONGEST:
            return self.make(word)
        if len(self) >= REMEMBERED:
            self.older = dict(self)
            self.clear()
        found = self.older.get(word)
        found = self[word] = self.make(word) if found is None else found
        return found


def train(texts: list[str], labels: list[int], epochs: int = EPOCHS, rate: float = RATE, seed: int = 7) -> np.ndarray:
    """What each hashed row adds to the log odds of label 1; the last number is the bias.

    Classes weigh alike in training.
    """
    random = np.random.default_rng(seed)
    known = Remembered(lambda w: np.array(features(w), np.int64))
    docs = []
    for text in texts:
        words = text.split()
        rows = np.concatenate([known[w] for w in words] + [np.repeat(np.arange(BUCKETS, BUCKETS + GAPS), gaps(words))]) if words else np.zeros(0, np.int64)
        ids, counts = np.unique(rows, return_counts=True)
        docs.append((ids, (counts / max(1, len(rows))).astype(np.float32)))
    table = random.uniform(-1 / WIDTH, 1 / WIDTH, (BUCKETS + GAPS, WIDTH)).astype(np.float32)
    output = np.zeros((2, WIDTH), np.float32)
    bias = np.zeros(2, np.float32)
    share = np.bincount(labels, minlength=2) / max(1, len(labels))
    weights = np.where(share > 0, 0.5 / np.maximum(share, 1e-9), 0)
    steps, step = epochs * len(docs), 0
    for _ in range(epochs):
        for k in random.permutation(len(docs)):
            ids, shares = docs[k]
            lr = rate * (1 - step / steps) * min(weights[labels[k]], 4)
            step += 1
            hidden = shares @ table[ids]
            logits = output @ hidden + bias
            p = np.exp(logits - logits.max())
            p /= p.sum()
            p[labels[k]] -= 1
            back = output.T @ p
            output -= lr * np.outer(p, hidden)
            bias -= lr * 0.1 * p
            table[ids] -= (lr * shares)[:, None] * back[None, :]
    return np.append(table @ (output[1] - output[0]), bias[1] - bias[0]).astype(np.float64)


def labelled_sample(docs: DataFrame, labels: DataFrame, sample_rows: int) -> tuple[DataFrame, dict[int, int]]:
    """doc_id, quality and text of about ``sample_rows`` rows of each label, chosen by a hash of their ids; counts of all labels.

    Of documents that share an id the least text is taken.
    The choice reads ids and labels alone; its size is bounded, so it is broadcast to fetch the texts.
    """
    told = labels.select(labels["doc_id"].alias("label_id"), labels["quality"].cast("int").alias("quality")).filter("label_id is not null and quality in (0, 1)")
    told = told.filter(crc_share(F.col("label_id"), 5) != 0)
    counts = {r[0]: r[1] for r in told.groupBy("quality").count().collect()}
    spot = F.pmod(F.xxhash64("label_id", F.lit("quality")), F.lit(1 << 30))
    limit = F.when(F.col("quality") == 1, int(sample_rows / max(1, counts.get(1, 1)) * (1 << 30))).otherwise(int(sample_rows / max(1, counts.get(0, 1)) * (1 << 30)))
    chosen = saved(told.filter(spot < limit).distinct(), "quality-sample")
    return docs.select(docs["doc_id"].alias("doc_id"), text_or_empty(docs["text"]).alias("text")).join(F.broadcast(chosen), F.col("doc_id") == F.col("label_id")).groupBy("doc_id", "quality").agg(F.min("text").alias("text")), counts


def fitted(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> np.ndarray | None:
    """The trained numbers of each hashed row, or None without a labelled text. One task trains on the bounded sample."""
    sample, counts = labelled_sample(docs, labels, sample_rows)

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "quality", "text"])
        return pd.DataFrame({"model": [train(pdf["text"].tolist(), pdf["quality"].tolist()).astype("<f4").tobytes()]})

    found = sample.withColumn("all", F.lit(1)).groupBy("all").applyInPandas(fit, "model binary").collect()
    if not found:
        return None
    model = np.frombuffer(bytes(found[0][0]), "<f4").astype(np.float64)
    if counts.get(0) and counts.get(1):  # the classes weighed alike; give back how often they occur
        model[-1] += np.log(counts[1] / counts[0])
    return model


def word_sums(model: np.ndarray) -> Remembered:
    """For each word the sum over its hashed rows, and their number as the imaginary part."""
    numbers = model.tolist()
    key = hashlib.sha256(model.tobytes()).hexdigest()
    return kept_in_worker(f"quality {key}", lambda: Remembered(lambda w: complex(sum(map(numbers.__getitem__, rows := features(w))), len(rows))))


def log_odds(words: list[str], sums: Remembered, back: list[float]) -> float:
    """Average over all rows of the words and of how far back their like stand."""
    total = sum(map(sums.__getitem__, words), complex(sum(map(mul, gaps(words), back)), len(words)))
    return total.real / max(1.0, total.imag)


def score_quality(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted of each row of ``docs``.

    Learns from labelled rows whose crc32(doc_id) mod 5 is not 0. Null and blank texts score by the bias
    alone; without any label all score 0.5. Repeated rows stay repeated; an empty table gives no rows.
    """
    spark = docs.sparkSession
    model = fitted(docs, labels, sample_rows)
    sent = spark.sparkContext.broadcast(np.zeros(BUCKETS + GAPS + 1) if model is None else model)
    rows = docs.select(docs["doc_id"].alias("doc_id"), (crc_share(docs["doc_id"], 5) == 0).alias("held_out"), text_or_empty(docs["text"]).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = word_sums(sent.value)
        back = sent.value[BUCKETS:-1].tolist()
        for batch in slices(it):
            texts = map(str.split, batch.column(2).to_pylist())
            odds = np.array([log_odds(words, sums, back) for words in texts]) + sent.value[-1]
            score = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return rows.mapInArrow(batches, f"doc_id {kind}, held_out boolean, score double, predicted int")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality of every document."""
    return score_quality(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
