"""WARC archives: records written with payload de-duplication, and read back by boundary-chain verification.

Writing.  Each page is an HTTP response record; of pages with equal payloads of at
least ``least`` bytes those with the smallest id are responses and the others
revisit records that refer to it, without the payload.  Spark's text sink writes
the records (its line separator is the two line ends that close a record).

Reading.  Spark's text source cuts the archives at every ``WARC/1.0`` line, also at
those inside payloads.  Each piece that reads as a record header is a candidate and
names its successor's offset.  Within a split (a piece of a file for one task)
candidates pass their exit on to the front, across splits the entries reached from
the start of the file double their jumps each round, and the records are those on
the way.  Magic inside a payload is skipped, as no chain reaches it; records in
which it stood are put together from their pieces.

Rows: a null payload is empty; null ids and urls are written as missing and read as
null; line ends in urls become spaces; repeated pages with the smallest id are all
responses; with no id in the group all are; very long payloads are records like others;
other columns, whatever their names, are not written; an empty table gives an empty archive.
Broken archives: where a chain stops before the end of its file, what stands behind
is not read and the file is named by ``broken``.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import written

#: Fixed values of the format.
MAGIC = b"WARC/1.0\r\n"
END = "\r\n\r\n"
BASE32_FROM, BASE32_TO = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"

PIECE = "file string, split long, piece long, at long, size long, length long, kind string, id string, refers_to string, url string, digest string, payload_bytes long, whole boolean"


def digest_column(payload: Column) -> Column:
    """Bare upper-case base32 SHA-1: eight groups of five hexadecimal digits give four digits each."""
    hexed = F.sha1(payload)
    groups = [F.lpad(F.conv(F.substring(hexed, 1 + 5 * k, 5), 16, 32), 4, "0") for k in range(8)]
    return F.translate(F.upper(F.concat(*groups)), BASE32_FROM, BASE32_TO)


def digest_bytes(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


# -- writing ------------------------------------------------------------------
def typed(pages: DataFrame, id_col: str = "page_id", payload_col: str = "html", least: int = 0) -> DataFrame:
    """page_id, payload_digest, payload_bytes, record_type, refers_to: a row for each distinct (id, payload digest)."""
    payload = F.coalesce(F.col(payload_col), F.lit("")).cast("binary")
    narrow = written(pages.select(F.col(id_col).alias("page_id"), digest_column(payload).alias("payload_digest"), F.octet_length(payload).cast("long").alias("payload_bytes")).distinct(), "payloads")
    first = written(narrow.where(F.col("payload_bytes") >= least).groupBy("payload_digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n"), "first-pages")
    joined = narrow.join(first, "payload_digest", "left")
    again = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return joined.select("page_id", "payload_digest", "payload_bytes", F.when(again, "revisit").otherwise("response").alias("record_type"), F.when(again, F.col("first")).alias("refers_to"))


def write(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = 0, date: str = "2020-01-01T00:00:00Z", records_a_file: int = 100_000) -> None:
    """Writes the archives.  Only pages that revisit others are looked up by id and digest, so payloads are not shuffled
    while those fit a broadcast by Spark's own threshold."""
    text = F.coalesce(F.col(payload_col), F.lit(""))
    again = written(typed(pages, id_col, payload_col, least).where("record_type = 'revisit'").select(F.col("page_id").alias("_page"), F.col("payload_digest").alias("_digest"), "refers_to"), "revisits")
    rows = pages.select(F.col(id_col).alias("id"), F.regexp_replace(F.col(url_col), "[\r\n]+", " ").alias("url"), text.alias("payload"), digest_column(text.cast("binary")).alias("digest"))
    rows = rows.join(again, F.col("id").eqNullSafe(F.col("_page")) & (F.col("digest") == F.col("_digest")), "left")
    revisit = F.col("_digest").isNotNull()
    body = F.when(revisit, "").otherwise(F.col("payload"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length("payload").cast("string"), F.lit(END))
    head = F.concat_ws(
        "\r\n",
        F.concat(F.lit("WARC/1.0\r\nWARC-Type: "), F.when(revisit, "revisit").otherwise("response")),
        F.concat(F.lit("WARC-Record-ID: <urn:page:"), F.coalesce(F.col("id").cast("string"), F.lit("")), F.lit(">")),
        F.lit(f"WARC-Date: {date}"),
        F.concat(F.lit("WARC-Target-URI: "), F.col("url")),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("digest")),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: <urn:page:"), F.col("refers_to").cast("string"), F.lit(">\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), (F.octet_length(http) + F.octet_length(body)).cast("string")),
    )
    record = F.concat(head, F.lit(END), http, body)
    rows.select(record.alias("value")).write.option("lineSep", END).option("maxRecordsPerFile", records_a_file).text(path)


# -- reading ------------------------------------------------------------------
_FIELD = re.compile(rb"^([\w-]+):[ \t]*(.*?)\r?$", re.M)
_PAGE = re.compile(r"<urn:page:(.+)>$")


def parse(piece: bytes) -> dict[str, Any] | None:
    """A record header behind the magic; None if the piece doesn't read as one."""
    head, mark, block = piece.partition(b"\r\n\r\n")
    fields = {k.lower(): v for k, v in _FIELD.findall(head)}
    if not mark or b"warc-type" not in fields or not fields.get(b"content-length", b"x").isdigit():
        return None
    text = {k: v.decode("utf-8", "replace") for k, v in fields.items()}
    page = {k: (m[1] if (m := _PAGE.match(text.get(f, ""))) else None) for k, f in (("id", b"warc-record-id"), ("refers_to", b"warc-refers-to"))}
    return page | {"kind": text[b"warc-type"], "url": text.get(b"warc-target-uri"), "digest": text.get(b"warc-payload-digest", "").removeprefix("sha1:") or None, "length": len(MAGIC) + len(head) + 4 + int(text[b"content-length"]) + 4, "head": len(head) + 4, "block": int(text[b"content-length"])}


def payload_of(block: bytes) -> tuple[bytes, int | None]:
    """The body of an HTTP message and the length that its header gives."""
    head, mark, body = block.partition(b"\r\n\r\n")
    if not mark or not head.startswith(b"HTTP/"):
        return block, None
    told = re.search(rb"(?im)^content-length:[ \t]*(\d+)", head)
    return body, int(told[1]) if told else None


def _finish(found: dict[str, Any], block: bytes) -> dict[str, Any]:
    body, told = payload_of(block)
    if found["kind"] == "revisit":
        return {"digest": found["digest"], "payload_bytes": told}
    return {"digest": digest_bytes(body), "payload_bytes": len(body)}


def pieces(spark: SparkSession, path: str) -> DataFrame:
    """file, split, value: what stands between magic lines, in the order of the file within each split."""
    lines = spark.read.option("lineSep", MAGIC.decode()).text(path)
    return lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.col("value").cast("binary").alias("value"))


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, int, int, bytes]]:
    """file, split, number in the split, bytes before it in the split, piece."""
    now, number, at = None, 0, 0
    for batch in batches:
        for file, split, value in zip(*(batch.column(c).to_pylist() for c in ("file", "split", "value"))):
            if (file, split) != now:
                now, number, at = (file, split), 0, 0
            yield file, split, number, at, value
            number, at = number + 1, at + len(value) + len(MAGIC)


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("file", pa.string()), ("split", pa.int64()), ("piece", pa.int64()), ("at", pa.int64()), ("size", pa.int64()), ("length", pa.int64()), ("kind", pa.string()), ("id", pa.string()), ("refers_to", pa.string()), ("url", pa.string()), ("digest", pa.string()), ("payload_bytes", pa.int64()), ("whole", pa.bool_())])
    rows: list[dict[str, Any]] = []
    for file, split, number, at, value in _numbered(batches):
        row: dict[str, Any] = {"file": file, "split": split, "piece": number, "at": at, "size": len(value) + len(MAGIC), "whole": False}
        if (found := parse(value)) is not None:
            row |= {k: found[k] for k in ("length", "kind", "id", "refers_to", "url", "digest")}
            if row["size"] >= found["length"]:
                row |= {"whole": True} | _finish(found, value[found["head"] : found["head"] + found["block"]])
        rows.append(row)
        if len(rows) >= 5000:
            yield pa.RecordBatch.from_pylist(rows, schema)
            rows = []
    if rows:
        yield pa.RecordBatch.from_pylist(rows, schema)


def located(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Pieces with the absolute offset of their magic and of their successor; splits with their first offset."""
    found = written(pieces(spark, path).mapInArrow(_candidates, PIECE), "candidates")
    spans = found.groupBy("file", "split").agg(F.sum("size").alias("bytes"))
    before = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)  # rows are splits of one file
    starts = written(spans.select("file", "split", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("start"), "bytes"), "splits")
    # the bytes before a file's first magic are a piece of their own, so piece k begins behind magic k
    offset = (F.col("start") + F.col("at") - len(MAGIC)).alias("offset")
    joined = found.join(starts.select("file", "split", "start"), ["file", "split"])
    return written(joined.select("*", offset, (offset + F.col("length")).alias("next")), "located"), starts


def _exits(rows: pd.DataFrame) -> pd.DataFrame:
    """For each candidate of a split the first offset on its chain that no candidate of the split has."""
    at: dict[int, int] = {}
    for offset, nxt in sorted(zip(rows.offset.tolist(), rows.next.tolist()), reverse=True):
        at[offset] = at.get(nxt, nxt)
    return pd.DataFrame({"file": rows.file.iloc[0], "offset": list(at), "jump": list(at.values())})


def _on_chain(rows: pd.DataFrame) -> pd.DataFrame:
    """The candidates of a split that its entries reach; rows with next null are entries."""
    records = rows[rows.next.notna()]
    following = dict(zip(records.offset.tolist(), records.next.astype("int64").tolist()))
    reached: set[int] = set()
    for offset in rows.offset[rows.next.isna()].tolist():
        while offset in following and offset not in reached:
            reached.add(offset)
            offset = following[offset]
    return records.loc[records.offset.isin(reached), ["file", "split", "piece"]]


def chain(candidates: DataFrame) -> DataFrame:
    """file, split, piece of the records that the start of their file reaches."""
    narrow = candidates.where("next IS NOT NULL").select("file", "split", "piece", "offset", "next")
    jumps = written(narrow.groupBy("file", "split").applyInPandas(_exits, "file string, offset long, jump long"), "jumps")
    reached = written(candidates.select("file").distinct().select("file", F.lit(0).cast("long").alias("offset")), "entries")
    hops = jumps
    while True:  # every round the entries reached and the length of a hop double
        further = reached.join(hops, ["file", "offset"]).select("file", F.col("jump").alias("offset"))
        more = written(reached.union(further).distinct(), "entries")
        if more.count() == reached.count():
            break
        reached = more
        onward = hops.select("file", F.col("offset").alias("jump"), F.col("jump").alias("onward"))
        hops = written(hops.join(onward, ["file", "jump"]).select("file", "offset", F.col("onward").alias("jump")), "hops")
    entries = reached.join(narrow, ["file", "offset"]).select("file", "split", F.lit(None).cast("long").alias("piece"), "offset", F.lit(None).cast("long").alias("next"))
    return narrow.unionByName(entries).groupBy("file", "split").applyInPandas(_on_chain, "file string, split long, piece long")


def read(spark: SparkSession, path: str) -> DataFrame:
    """A row for each verified record: file, offset, kind, id, refers_to, url, digest (of the bytes read; a revisit's as told), payload_bytes."""
    candidates, starts = located(spark, path)
    good = written(chain(candidates), "chain")
    records = candidates.join(good, ["file", "split", "piece"])
    out = ["file", "offset", "kind", "id", "refers_to", "url", "digest", "payload_bytes"]
    torn = written(records.where("NOT whole").select("file", "offset", "next"), "torn")
    done = records.where("whole").select(*out)
    if torn.isEmpty():
        return done
    # records with magic inside: their pieces, in the order of the file, are read once more.  A record is marked in each split
    # that it reaches into, and a piece belongs to the last record marked before it if it begins before that one's end
    near = torn.join(starts, "file").where((F.col("start") - 2 * len(MAGIC) <= F.col("next")) & (F.col("start") + F.col("bytes") >= F.col("offset")))
    none = F.lit(None)
    marks = near.select("file", "split", F.col("offset").alias("part"), F.struct("offset", "next").alias("record"), none.cast("long").alias("piece"))
    own = candidates.select("file", "split", F.col("offset").alias("part"), none.cast("struct<offset:bigint,next:bigint>").alias("record"), "piece")
    along = Window.partitionBy("file", "split").orderBy("part", F.col("record").isNull())  # rows are pieces of one split
    held = marks.union(own).withColumn("inside", F.last("record", ignorenulls=True).over(along)).where(F.col("piece").isNotNull() & (F.col("part") < F.col("inside.next")))
    parts = written(held.select("file", "split", "piece", "part", F.col("inside.offset").alias("offset")), "parts")

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for file, split, number, _, value in _numbered(batches):
            yield pa.RecordBatch.from_pydict({"file": pa.array([file]), "split": pa.array([split], pa.int64()), "piece": pa.array([number], pa.int64()), "value": pa.array([value], pa.binary())})

    values = pieces(spark, path).mapInArrow(again, "file string, split long, piece long, value binary").join(parts, ["file", "split", "piece"])

    def join(rows: pd.DataFrame) -> pd.DataFrame:
        data = MAGIC.join(rows.sort_values("part").value.tolist())
        found = parse(data)
        row = {"file": rows.file.iloc[0], "offset": rows.offset.iloc[0]} | {k: found[k] for k in ("kind", "id", "refers_to", "url")}
        return pd.DataFrame([row | _finish(found, data[found["head"] : found["head"] + found["block"]])])[out]

    mended = values.groupBy("file", "offset").applyInPandas(join, "file string, offset long, kind string, id string, refers_to string, url string, digest string, payload_bytes long")
    return done.unionByName(mended)


def broken(spark: SparkSession, path: str) -> DataFrame:
    """Files whose chain of records does not end at the end of the file: file, reached, bytes."""
    candidates, starts = located(spark, path)
    ends = candidates.join(chain(candidates), ["file", "split", "piece"]).groupBy("file").agg(F.max("next").alias("reached"))
    sizes = starts.groupBy("file").agg((F.sum("bytes") - len(MAGIC)).alias("bytes"))  # no magic stands behind the last piece
    return sizes.join(ends, "file", "left").where("reached IS NULL OR reached != bytes")


def round_trip(pages: DataFrame, path: str) -> DataFrame:
    """Writes pages to path and reads them back: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    write(pages, path)
    back = read(pages.sparkSession, path)
    return back.select(F.col("id").cast("long").alias("page_id"), "payload_bytes", F.col("digest").alias("payload_digest"), F.col("kind").alias("record_type"), F.col("refers_to").cast("long").alias("refers_to"))
