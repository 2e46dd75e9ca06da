"""Byte-level BPE: encoding by a priority queue of merge ranks, decoding by joining vocabulary strings.

A text is split at the added tokens, the rest into pieces by the vocabulary's pattern. Each piece is a doubly
linked list of symbols; the queue holds adjacent pairs by merge rank and position, and a pair that an
earlier merge has changed is stale and skipped. Pieces recur, so each worker keeps a bounded table of
pieces it has encoded. The vocabulary file is read by the driver and sent to the executors once.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from .text import kept_in_worker, slices, text_or_empty

#: Fixed value: the pattern of byte-level vocabularies that ask for it by ``use_regex``.
PIECES = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pieces that a worker remembers in each of two generations, and how long they may be.
REMEMBERED, LONGEST = 250_000, 64


def byte_symbols() -> dict[int, str]:
    """The character that stands for each byte: itself if it prints, else the next one from U+0100."""
    prints = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(prints)]
    return {b: chr(b) for b in prints} | {b: chr(256 + k) for k, b in enumerate(rest)}


class Pieces(dict):
    """Encoded pieces, as little-endian 32-bit ids; when full, only pieces met again stay, and long ones never do."""

    def __init__(self, encode) -> None:
        super().__init__()
        self.encode, self.older = encode, {}

    def __missing__(self, piece: str) -> bytes:
        if len(piece) > LONGEST:
            return self.packed(piece)
        if len(self) >= REMEMBERED:
            self.older = dict(self)
            self.clear()
        ids = self.older.get(piece)
        ids = self[piece] = self.packed(piece) if ids is None else ids
        return ids

    def packed(self, piece: str) -> bytes:
        """Ids of a piece that is not remembered."""
        found = self.encode(piece.encode())
        return struct.pack(f"<{len(found)}I", *found)


class ByteBpe:
    """A vocabulary with its merges and added tokens, from the JSON text of a tokenizer file."""

    def __init__(self, text: str) -> None:
        spec = json.loads(text)
        vocab, symbols = spec["model"]["vocab"], byte_symbols()
        self.of_byte = [vocab[symbols[b]] for b in range(256)]
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.merges.setdefault((vocab[a], vocab[b]), (rank, vocab[a + b]))
        byte_of = {c: b for b, c in symbols.items()}
        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.added = {content: np.array([i], "<u4").tobytes() for content, i in added.items()}
        self.strings = [b""] * (1 + max([*vocab.values(), *added.values()]))
        for token, i in vocab.items():
            self.strings[i] = bytes(byte_of[c] for c in token)
        for token, i in added.items():
            self.strings[i] = token.encode()
        longest = sorted(added, key=len, reverse=True)
        self.split = regex.compile("(" + "|".join(map(regex.escape, longest)) + ")").split if added else lambda s: [s]
        self.pieces = regex.compile(PIECES).findall
        self.known = Pieces(self.merge)

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one piece."""
        ids = [self.of_byte[b] for b in piece]
        n, merges = len(ids), self.merges
        after, before, queue = list(range(1, n + 1)), list(range(-1, n - 1)), []
        for at in range(n - 1):
            if found := merges.get((ids[at], ids[at + 1])):
                queue.append((found[0], at, ids[at], ids[at + 1], found[1]))
        heapq.heapify(queue)
        while queue:
            _, at, left, right, made = heapq.heappop(queue)
            nxt = after[at]
            if ids[at] != left or nxt >= n or ids[nxt] != right:
                continue  # stale: a merge has changed one of the two
            ids[at], ids[nxt] = made, -1
            end = after[at] = after[nxt]
            if end < n:
                before[end] = at
                if found := merges.get((made, ids[end])):
                    heapq.heappush(queue, (found[0], at, made, ids[end], found[1]))
            if (start := before[at]) >= 0 and (found := merges.get((ids[start], made))):
                heapq.heappush(queue, (found[0], start, ids[start], made, found[1]))
        return [i for i in ids if i >= 0]

    def encode(self, text: str) -> bytes:
        """Ids of a text, as little-endian 32-bit numbers."""
        known, added = self.known.__getitem__, self.added
        return b"".join(added[part] if part in added else b"".join(map(known, self.pieces(part))) for part in self.split(text))

    def decode(self, ids: bytes) -> str:
        """The text of ids; bytes that are no UTF-8 become U+FFFD."""
        return b"".join(map(self.strings.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


def ready(text: str) -> ByteBpe:
    """The vocabulary of a file's text, made once in each worker."""
    key = hashlib.sha256(text.encode()).hexdigest()
    return kept_in_worker(f"bpe {key}", lambda: ByteBpe(text))


def bpe_round_trip(docs: DataFrame, vocabulary: str, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 (and, if asked for, ids and decoded) of each row.

    ``vocabulary`` is the path of a byte-level BPE file on the driver. Null texts count as empty
    and give no tokens; texts are encoded whole, whatever their length; repeated rows stay repeated;
    an empty table gives no rows; other columns are not read.
    """
    spark = docs.sparkSession
    with open(vocabulary, encoding="utf-8") as f:
        sent = spark.sparkContext.broadcast(f.read())
    rows = docs.select(docs["doc_id"].alias("doc_id"), text_or_empty(docs["text"]).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * with_ids

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = ready(sent.value)
        for batch in slices(it):
            ids = [bpe.encode(t) for t in batch.column(1).to_pylist()]
            texts = [bpe.decode(i) for i in ids]
            columns = [
                batch.column(0),
                pa.array([len(i) // 4 for i in ids], pa.int64()),
                pa.array([hashlib.sha256(i).hexdigest() for i in ids], pa.string()),
                pa.array([hashlib.sha256(t.encode()).hexdigest() for t in texts], pa.string()),
            ]
            if with_ids:
                columns += [pa.array([np.frombuffer(i, "<i4") for i in ids], pa.list_(pa.int32())), pa.array(texts, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"][: len(columns)])

    return rows.mapInArrow(batches, schema)


def public_vocabulary(name: str = "byte_bpe_50k.json") -> str:
    """Path of an installed public vocabulary."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of documents, encoded and decoded."""
    return bpe_round_trip(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_vocabulary())
