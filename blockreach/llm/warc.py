"""WARC records and a Merkle fixity audit of replicas.

Every stored record has a digest. Its archive file is cut into offset ranges of growing size (64 KiB,
1 MiB, 16 MiB, the file), and each range has the hash of what begins in it, in order of offset: records
with their offsets and digests on the lowest level, smaller ranges above. Replicas are compared from the
roots; only ranges whose hashes differ are opened, down to the records that differ or are gone.

Ranges hold a bounded number of children (16 per level; as many records as begin in 64 KiB). Null url or
html count as empty; null page ids are written as an empty id; repeated pages are records of their own.
Empty tables have no files and no differences. Only the named columns are read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from blockreach.llm.common import open_folder, written
from blockreach.llm.sharding import leading_bits

RANGE_BITS = (16, 20, 24)  # offset ranges of the inner levels
FILE_RECORDS = 1000
HEADER_END = b"\r\n\r\n"
VERSION = b"WARC/1.0\r\n"


def record(page_id: Column, url: Column, html: Column) -> Column:
    """A WARC resource record as text."""
    body = F.coalesce(html, F.lit(""))
    return F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:"), F.coalesce(page_id.cast("string"), F.lit("")),
        F.lit(">\r\nWARC-Target-URI: "), F.coalesce(url, F.lit("")), F.lit("\r\nContent-Type: text/html\r\nContent-Length: "),
        F.octet_length(body).cast("string"), F.lit("\r\n\r\n"), body, F.lit("\r\n\r\n"),
    )


def archived(pages: DataFrame, with_record: bool = False, **more: Column) -> DataFrame:
    """Place and digest of every page's record: ``file, start, end, page_id, digest``, and columns ``more`` made from ``record`` (with ``with_record`` also its text).

    Pages are dealt to files of about ``FILE_RECORDS`` records by a hash of the id, in order of id (a null id last) and digest.
    """
    files = max(1, math.ceil(pages.count() / FILE_RECORDS))
    kept = [*more, *(["record"] if with_record else [])]
    rows = pages.select("page_id", record(F.col("page_id"), F.col("url"), F.col("html")).alias("record")).withColumns(more).select(
        (leading_bits(F.coalesce(F.col("page_id").cast("string"), F.lit(""))) % files).alias("file"), "page_id",
        F.octet_length("record").cast("bigint").alias("size"), F.sha2("record", 256).alias("digest"), *kept,
    )
    # A file is of bounded size, so its window is too.
    order = Window.partitionBy("file").orderBy(F.asc_nulls_last("page_id"), "digest").rowsBetween(Window.unboundedPreceding, 0)
    placed = rows.withColumn("end", F.sum("size").over(order)).withColumn("start", F.col("end") - F.col("size"))
    return placed.select("file", "start", "end", "page_id", "digest", *kept)


def write_warc(records: DataFrame, folder: str) -> None:
    """Write ``records (file, start, record)`` (texts or bytes) as one WARC file per number, into a folder all executors reach."""
    fs, path = open_folder(folder)
    fs.create_dir(path, recursive=True)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = open_folder(folder)
        number, out = None, None
        for batch in batches:
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if name != number:
                    if out is not None:
                        out.close()
                    # The bytes of a file are always the same, so a task run twice does no harm.
                    number, out = name, fs.open_output_stream(f"{path}/{name:06d}.warc")
                out.write(text)
        if out is not None:
            out.close()
        yield from ()

    ordered = records.repartition("file").sortWithinPartitions("file", "start").select("file", F.col("record").cast("binary"))
    ordered.mapInArrow(write, "done int").count()


def read_warc(spark: SparkSession, folder: str) -> DataFrame:
    """Records of all WARC files in a folder: ``file, start, end, page_id, digest``.

    Bytes that are no whole record are passed over up to the next place where a record can start.
    """

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows, at = [], 0
                while at < len(content):
                    head = content.find(HEADER_END, at)
                    fields = dict(line.split(b": ", 1) for line in content[at:head].split(b"\r\n")[1:] if b": " in line)
                    size = fields.get(b"Content-Length", b"")
                    end = head + 4 + int(size) + 4 if head >= 0 and size.isdigit() else 0
                    if content[at:at + len(VERSION)] != VERSION or not at < end <= len(content):
                        found = content.find(b"\r\n\r\n" + VERSION, at)
                        at = found + 4 if found >= 0 else len(content)
                        continue
                    page = fields.get(b"WARC-Record-ID", b"").removeprefix(b"<urn:page:").removesuffix(b">").decode("ascii", "ignore")
                    rows.append((int(name.rpartition("/")[2].removesuffix(".warc")), at, end, int(page) if page.lstrip("-").isdigit() else None, hashlib.sha256(content[at:end]).hexdigest()))
                    at = end
                yield pa.RecordBatch.from_pydict({n: pa.array([r[i] for r in rows], t) for i, (n, t) in enumerate((("file", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("page_id", pa.int64()), ("digest", pa.string())))})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc").load(folder).select("path", "content")
    return files.mapInArrow(parse, "file bigint, start bigint, end bigint, page_id bigint, digest string")


def damaged(record: Column, flipped: Column, lost: Column) -> Column:
    """Bytes of a record: with its last byte before the closing line ends replaced, or with an unreadable first line."""
    held, place = record.cast("binary"), F.octet_length(record) - 4
    own = F.substring(held, place, F.lit(1))
    other = F.when(own == F.lit(b"#"), F.lit(b"@")).otherwise(F.lit(b"#"))
    return F.when(lost, F.overlay(held, F.lit(b"????"), F.lit(1))).when(flipped, F.overlay(held, other, place)).otherwise(held)


def ordered_hash(number: str, *values: str) -> Column:
    """sha256 of ``number:value…`` of all children in order of their number."""
    children = F.array_sort(F.collect_list(F.struct(F.col(number).alias("n"), F.concat_ws(":", number, *values).alias("v"))))
    return F.sha2(F.array_join(F.transform(children, lambda c: c["v"]), ","), 256).alias("hash")


def tree(records: DataFrame) -> list[DataFrame]:
    """Levels ``file, node, hash`` from the smallest ranges up to the roots (node 0)."""
    levels, low, values = [], records.select("file", F.col("start").alias("child"), "end", "digest"), ("end", "digest")
    for i, bits in enumerate(RANGE_BITS):
        step = bits - RANGE_BITS[i - 1] if i else bits
        level = low.groupBy("file", F.shiftright("child", step).alias("node")).agg(ordered_hash("child", *values))
        levels.append(written(level, f"merkle-{bits}"))
        low, values = levels[-1].select("file", F.col("node").alias("child"), F.col("hash").alias("digest")), ("digest",)
    levels.append(written(low.groupBy("file").agg(ordered_hash("child", "digest")).select("file", F.lit(0).cast("bigint").alias("node"), "hash"), "merkle-roots"))
    return levels


def differing(a: DataFrame, b: DataFrame) -> DataFrame:
    """``file, node`` of nodes that differ or stand on one side only."""
    both = a.join(b.withColumnRenamed("hash", "other"), ["file", "node"], "full")
    return both.where(~F.col("hash").eqNullSafe(F.col("other"))).select("file", "node")


def audit(a: DataFrame, b: DataFrame) -> DataFrame:
    """Records of ``a`` and ``b`` (written tables of records) that differ: ``file, start, status``.

    ``corrupt``: other bytes or another end; ``missing``: only in ``a``; ``extra``: only in ``b``.
    """
    return differing_records(a, b, tree(a), tree(b))


def differing_records(a: DataFrame, b: DataFrame, *trees: list[DataFrame]) -> DataFrame:
    """As :func:`audit`, with the trees of both sides."""
    suspects = differing(trees[0][-1], trees[1][-1])
    for i in range(len(RANGE_BITS) - 1, -1, -1):
        # Children of suspects only. All children of a root are its own; below, ranges nest by bits.
        step = RANGE_BITS[i + 1] - RANGE_BITS[i] if i + 1 < len(RANGE_BITS) else 63
        above = suspects.withColumnRenamed("node", "parent")
        opened = [t[i].withColumn("parent", F.shiftright("node", step)).join(above, ["file", "parent"], "left_semi").drop("parent") for t in trees]
        # Used twice on the next level; written, it is computed once.
        suspects = written(differing(*opened), "merkle-suspects")
    ranges = suspects.withColumnRenamed("node", "range")
    sides = [
        r.withColumn("range", F.shiftright("start", RANGE_BITS[0])).join(ranges, ["file", "range"], "left_semi").select("file", "start", F.struct("end", "digest").alias(name))
        for r, name in ((a, "a"), (b, "b"))
    ]
    status = F.when(F.col("b").isNull(), "missing").when(F.col("a").isNull(), "extra").when(F.col("a") != F.col("b"), "corrupt")
    return sides[0].join(sides[1], ["file", "start"], "full").select("file", "start", status.alias("status")).where("status IS NOT NULL")
