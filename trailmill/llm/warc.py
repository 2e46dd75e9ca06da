"""WARC derivatives: responses become linked metadata and plain-text conversion records.

A record is a row: type, id, the id it refers to, its named fields in order, and its block. From each
response come a metadata record (source headers, HTTP headers, digests, title and links as JSON) and a
conversion record (its plain text); both name the response in WARC-Refers-To and keep its target URI, date
and payload digest. Records are written as WARC text, whose record separator is the line
separator of Spark's text files, so that both ways run in parallel by splits.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..scratch import saved
from .html import Element, blocks, parse
from .text import partitions, slices, text_or_empty

VERSION = "WARC/1.1"
RECORD = T.StructType(
    [
        T.StructField("record_id", T.StringType()),
        T.StructField("warc_type", T.StringType()),
        T.StructField("refers_to", T.StringType()),
        T.StructField("fields", T.ArrayType(T.StructType([T.StructField("name", T.StringType()), T.StructField("value", T.StringType())]))),
        T.StructField("block", T.BinaryType()),
    ]
)
FIELDS = pa.list_(pa.struct([("name", pa.string()), ("value", pa.string())]))
NO_TEXT = set("script style noscript template head svg iframe object".split())
LINKS = {"a": "href", "area": "href", "img": "src", "link": "href", "script": "src", "iframe": "src", "form": "action", "source": "src"}


def digest(data: bytes) -> str:
    """SHA-1 as WARC writes it."""
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(*parts: str) -> str:
    """An id that a rerun gives again."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, chr(0).join(parts))}>"


def value_of(fields: list[tuple[str, str]], name: str) -> str | None:
    """The first field of a name, in any case of letters."""
    return next((v for k, v in fields if k.lower() == name.lower()), None)


def http_parts(block: bytes) -> tuple[str, list[tuple[str, str]], bytes]:
    """Status line, header fields and payload of an HTTP response; all is payload if there is no head."""
    head, found, payload = block.partition(b"\r\n\r\n")
    if not found or not head.startswith(b"HTTP/"):
        return "", [], block
    lines = head.decode("utf-8", "replace").split("\r\n")
    return lines[0], [(k.strip(), v.strip()) for k, _, v in (x.partition(":") for x in lines[1:])], payload


def response_record(page_key: str, url: str, page: str, date: str) -> tuple:
    """The response record of one page."""
    payload = page.encode("utf-8", "surrogatepass")
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload) + payload
    own = record_id("response", page_key, url, digest(payload))
    fields = [
        ("WARC-Type", "response"),
        ("WARC-Record-ID", own),
        ("WARC-Date", date),
        ("WARC-Target-URI", url),
        ("WARC-Payload-Digest", digest(payload)),
        ("WARC-Block-Digest", digest(block)),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    return own, "response", None, fields, block


def plain(tree: Element) -> str:
    """All text of a page, a line for each block."""
    return "\n".join(blocks(tree, lambda e: e.tag in NO_TEXT))


def derived_records(own: str, fields: list[tuple[str, str]], block: bytes) -> list[tuple]:
    """The metadata and conversion records of one response."""
    status, http, payload = http_parts(block)
    charset = re.search(r"charset=[\"']?([\w-]+)", value_of(http, "Content-Type") or "")
    try:
        page = payload.decode(charset[1] if charset else "utf-8", "replace")
    except LookupError:
        page = payload.decode("utf-8", "replace")
    tree = parse(page)
    title = next((" ".join(e.text().split()) for e in tree.walk() if e.tag == "title"), "")
    links = [{"path": f"{e.tag}@/{LINKS[e.tag]}", "url": e.attrs[LINKS[e.tag]]} for e in tree.walk() if e.tag in LINKS and LINKS[e.tag] in e.attrs]
    told = {
        "source": dict(fields),
        "http": {"status": status, "headers": [list(x) for x in http]},
        "payload": {"digest": digest(payload), "length": len(payload), "digest_matches": value_of(fields, "WARC-Payload-Digest") in (None, digest(payload))},
        "html": {"title": title, "links": links},
    }
    out = []
    for kind, content_type, content in (
        ("metadata", "application/json", json.dumps(told, ensure_ascii=False, sort_keys=True).encode("utf-8", "surrogatepass")),
        ("conversion", "text/plain; charset=utf-8", plain(tree).encode("utf-8", "surrogatepass")),
    ):
        new = record_id(kind, own)
        kept = [(name, value_of(fields, name)) for name in ("WARC-Date", "WARC-Target-URI", "WARC-Payload-Digest")]
        made = [
            ("WARC-Type", kind),
            ("WARC-Record-ID", new),
            ("WARC-Refers-To", own),
            *[(k, v) for k, v in kept if v is not None],
            ("WARC-Block-Digest", digest(content)),
            ("Content-Type", content_type),
            ("Content-Length", str(len(content))),
        ]
        out.append((new, kind, own, made, content))
    return out


def record_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.string(), pa.string(), FIELDS, pa.binary())
    columns = [[{"name": a, "value": b} for a, b in r[3]] for r in rows]
    return pa.RecordBatch.from_arrays([pa.array(columns if k == 3 else [r[k] for r in rows], t) for k, t in enumerate(kinds)], names=RECORD.names)


def responses(pages: DataFrame, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Response records of pages (page_id, url, html); null html is an empty payload, a null url an empty URI."""
    rows = pages.select(F.coalesce(pages["page_id"].cast("string"), F.lit("")), F.coalesce(pages["url"].cast("string"), F.lit("")), text_or_empty(pages["html"]))

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(it):
            yield record_batch([response_record(k, u, p, date) for k, u, p in zip(*(c.to_pylist() for c in batch.columns))])

    return rows.toDF("key", "url", "html").mapInArrow(batches, RECORD)


def derive(records: DataFrame) -> DataFrame:
    """Metadata and conversion records of all response records; other types give none.

    Ids of derived records follow from the response's id, so that reruns and repeated rows agree. Empty
    payloads give an empty text; an empty table gives no rows.
    """

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(it):
            rows: list[tuple] = []
            for own, fields, block in zip(*(batch.column(n).to_pylist() for n in ("record_id", "fields", "block"))):
                rows += derived_records(own, [(f["name"], f["value"]) for f in fields or []], block or b"")
            yield record_batch(rows)

    return records.filter("warc_type = 'response'").mapInArrow(batches, RECORD)


def write_warc(records: DataFrame, path: str, compression: str = "none") -> None:
    """Write records as WARC files, one for each partition."""
    head = F.concat_ws("\r\n", F.transform("fields", lambda f: F.concat(f["name"], F.lit(": "), f["value"])))
    text = F.concat(F.lit(VERSION + "\r\n"), head, F.lit("\r\n\r\n"), F.col("block").cast("string"), F.lit("\r\n"))
    records.select(text.alias("value")).write.option("lineSep", "\r\n").option("compression", compression).text(path)


def joined_records(pieces: DataFrame, version: str) -> DataFrame:
    """value: records of files whose blocks hold the version line, put together again by Content-Length.

    ``pieces`` are (file, start, at, value) of whole files; each file is read in order by one task, which holds one record at a time.
    """
    line = version.encode() + b"\r\n"
    dealt = pieces.select("file", "start", "at", F.col("value").cast("binary").alias("value")).repartition(partitions(pieces.sparkSession), "file").sortWithinPartitions("file", "start", "at")

    def length(record: bytes) -> int:
        """How long the record should be; 0 if it does not say."""
        head, found, _ = record.partition(b"\r\n\r\n")
        said = re.search(rb"(?im)^content-length:[ \t]*([0-9]+)[ \t]*\r?$", head) if found else None
        return len(head) + 8 + int(said[1]) if said else 0

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, held, need = None, None, 0
        for batch in slices(it, 100):
            done: list[bytes] = []
            for now, piece in zip(batch.column("file").to_pylist(), batch.column("value").to_pylist()):
                if now != file and held is not None:
                    done.append(b"".join(held))  # cut off by the end of its file
                    held = None
                file = now
                if held is not None:
                    held += [line, piece]
                elif piece:
                    held, need = [piece], length(piece)
                if held is not None and sum(map(len, held)) >= need:
                    done.append(b"".join(held))
                    held = None
            yield pa.RecordBatch.from_arrays([pa.array(done, pa.binary())], names=["value"])
        if held is not None:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], names=["value"])

    return dealt.mapInArrow(batches, "value binary").select(F.col("value").cast("string").alias("value"))


def read_warc(spark: SparkSession, path: str, version: str = VERSION) -> DataFrame:
    """Records of WARC files, with ``complete``: is the block as long as Content-Length says?

    Files are split at lines that hold the version alone, which is bytewise and so works for any block, and pieces
    as long as they say are records. Files in which a piece is not, as where a block holds such a line itself, are
    read in order, and pieces are joined until the record is as long as it says. A record that is cut off or names no length is
    never dropped; it shows as incomplete.
    """
    pieces = spark.read.option("lineSep", version + "\r\n").text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("at"))
    single = parsed(pieces.filter("value <> ''"))
    broken = saved(single.filter("not coalesce(complete, false)").select("file").distinct(), "warc-broken")
    whole = single.join(broken, "file", "left_anti").drop("file")
    return whole.unionByName(parsed(joined_records(pieces.join(broken, "file", "left_semi"), version).withColumn("file", F.lit(""))).drop("file"))


def parsed(raw: DataFrame) -> DataFrame:
    """Fields and block of each record (file, value)."""
    head = F.substring_index("value", "\r\n\r\n", 1)
    fields = F.transform(F.split(head, "\r\n"), lambda line: F.struct(F.substring_index(line, ": ", 1).alias("name"), F.substr(line, F.instr(line, ": ") + 2).alias("value")))
    of = lambda name: F.get(F.filter("fields", lambda f: F.lower(f["name"]) == name.lower()), F.lit(0))["value"]
    data = F.expr("substr(cast(value as binary), octet_length(head) + 5)")
    length = F.octet_length("data") - 4
    return (
        raw.withColumn("head", head)
        .withColumn("fields", fields)
        .withColumn("data", data)
        .select(
            "file",
            of("WARC-Record-ID").alias("record_id"),
            of("WARC-Type").alias("warc_type"),
            of("WARC-Refers-To").alias("refers_to"),
            "fields",
            F.expr("substr(data, 1, octet_length(data) - 4)").alias("block"),
            (length == of("Content-Length").cast("int")).alias("complete"),
        )
    )


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Derived records of every page: ids, links to the response, digests and lengths."""
    made = derive(responses(spark.read.parquet(f"{sf_dir}/pages.parquet")))
    field = lambda name: F.get(F.filter("fields", lambda f: f["name"] == name), F.lit(0))["value"]
    return made.select("record_id", "warc_type", "refers_to", field("WARC-Target-URI").alias("target_uri"), field("WARC-Payload-Digest").alias("payload_digest"), field("WARC-Block-Digest").alias("block_digest"), F.octet_length("block").cast("long").alias("content_length"))
