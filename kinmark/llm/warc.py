"""WARC records, and a Merkle fixity audit of their replicas.

Records are encoded into numbered WARC files of bounded size, each with its offset. The audit hashes every
stored record, then ordered ranges of offsets, then files and groups of files, up to one root. Two
replicas with equal roots are equal. Where they differ, only the children of differing nodes are compared
on the next level down, so what is read of the trees follows the damage, not the archive. The hashes are
built by Spark's own functions; each node gathers a bounded number of children.
"""

from __future__ import annotations

import gzip
import io
import zlib
from collections.abc import Callable, Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinmark.llm.common import cut, drop_table, small_batches

FILE_BYTES = 64 << 20
_RANGES = (14, 18, 22)  # bits of the offset that a node of each level covers, up from 16 KB
_GROUP_BITS = 10  # files of a group, groups of a larger group: 1,024 each
_GROUP_LEVELS = 5
_NUMBER_BITS = 20  # of a file's number within its task
#: Differing nodes of a level whose children are looked up by their range of the stored table, not by a join alone.
_HINTS = 200


def encode_record(uri: str | None, record_id: str, body: bytes) -> bytes:
    """One ``resource`` record. Line ends within the uri are percent-encoded, so that the header stays whole."""
    uri = (uri or "").replace("\r", "%0D").replace("\n", "%0A")
    head = (
        f"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <{record_id}>\r\nWARC-Target-URI: {uri}\r\n"
        f"Content-Type: text/html\r\nContent-Length: {len(body)}\r\n\r\n"
    )
    return head.encode() + body + b"\r\n\r\n"


_LINE = 1 << 20
_CHUNK = 4 << 20


class _Source:
    """Lines and bodies of a stream of bytes, plain or of gzip members, and the place reached in its plain bytes. A
    broken gzip member ends it."""

    def __init__(self, data: bytes | BinaryIO):
        stream = io.BytesIO(data) if isinstance(data, bytes) else data
        packed = stream.read(2) == b"\x1f\x8b"
        stream.seek(0)
        self.stream = gzip.GzipFile(fileobj=stream) if packed else stream
        self.at, self.broken = 0, False

    def line(self) -> bytes:
        return self._got(lambda: self.stream.readline(_LINE))

    def body(self, size: int) -> bytes:
        parts, left = [], size
        while left > 0 and (part := self._got(lambda: self.stream.read(min(left, _CHUNK)))):
            parts.append(part)
            left -= len(part)
        return b"".join(parts)

    def _got(self, read: Callable[[], bytes]) -> bytes:
        if self.broken:
            return b""
        try:
            data = read()
        except (OSError, EOFError, zlib.error):
            self.broken = True
            return b""
        self.at += len(data)
        return data


def parse_records(data: bytes | BinaryIO) -> Iterator[tuple[int, dict[str, str], bytes, str | None]]:
    """Offset, header fields, body and fault of every record of a WARC file, plain or gzipped, one at a time.

    Whole records have no fault. ``header`` (it ends early), ``length`` (none, or no whole number) and ``body`` (it ends
    early) are records with damage; ``lost`` stands for bytes that belong to no record, up to the next line that begins
    one; ``gzip`` for a member that cannot be read on. An empty file has no records.
    """
    source, lost = _Source(data), None
    begin, line = 0, source.line()
    while line:
        if not line.startswith(b"WARC/"):
            if lost is None and line.strip():
                lost = begin
            begin, line = source.at, source.line()
            continue
        if lost is not None:
            yield lost, {}, b"", "lost"
            lost = None
        fields: dict[str, str] = {}
        while (head := source.line()).endswith(b"\n") and head.strip():
            key, _, value = head.decode("utf-8", "replace").partition(":")
            fields[key.strip().lower()] = value.strip()
        length = fields.get("content-length", "")
        if not head.endswith(b"\n"):
            yield begin, fields, b"", "header"
        elif not (length.isascii() and length.isdigit()):
            yield begin, fields, b"", "length"
        else:
            body = source.body(int(length))
            yield begin, fields, body, None if len(body) == int(length) else "body"
        begin, line = source.at, source.line()
    if lost is not None:
        yield lost, {}, b"", "lost"
    if source.broken:
        yield source.at, {}, b"", "gzip"


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """``(file, offset, uri, record_type, body, fault)`` of WARC files, plain or gzipped, through Spark's reader.

    Records come one by one off the stream, so what a worker holds beside a file's own bytes is a batch of records.
    Damage gives rows with a ``fault`` (see :func:`parse_records`); an empty file gives none. Offsets are of plain bytes.
    """
    small_batches(spark)
    kinds = {"file": pa.string(), "offset": pa.int64(), "uri": pa.string(), "record_type": pa.string(), "body": pa.binary(), "fault": pa.string()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                rows, size = [], 0
                for at, f, body, fault in parse_records(io.BytesIO(content.as_buffer())):
                    rows.append((name, at, f.get("warc-target-uri"), f.get("warc-type"), body, fault))
                    size += len(body)
                    if size > _CHUNK or len(rows) == 1000:
                        yield _batch(rows, kinds)
                        rows, size = [], 0
                if rows:
                    yield _batch(rows, kinds)

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(run, "file string, offset long, uri string, record_type string, body binary, fault string")


def _batch(rows: list[tuple], kinds: dict[str, pa.DataType]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True)
    return pa.RecordBatch.from_pydict({k: pa.array(c, t) for (k, t), c in zip(kinds.items(), columns, strict=True)})


def encode_pages(pages: DataFrame, file_bytes: int = FILE_BYTES) -> DataFrame:
    """``(file, offset, page_id, record)``: every row of ``pages`` as a WARC record at its place.

    A task opens a new file whenever ``file_bytes`` would be passed; a longer record is a file of its own. Null
    urls and bodies are empty; null ids and repeated rows are records of their own; other columns, whatever
    their names, are ignored; an empty table gives no record. No shuffle.
    """
    small_batches(pages.sparkSession)
    source = pages.select("page_id", "url", F.col("html").cast("binary").alias("html"), F.spark_partition_id().alias("part"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, offset = 0, 0
        for batch in batches:
            files, offsets, records = [], [], []
            part = batch.column("part")[0].as_py() if batch.num_rows else 0
            for i, url, html in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html")), strict=True):
                record = encode_record(url, f"urn:page:{i}", html or b"")
                if offset and offset + len(record) > file_bytes:
                    number, offset = number + 1, 0
                files.append((part << _NUMBER_BITS) + number)
                offsets.append(offset)
                records.append(record)
                offset += len(record)
            yield pa.RecordBatch.from_pydict(
                {"file": pa.array(files, pa.int64()), "offset": pa.array(offsets, pa.int64()), "page_id": batch.column("page_id"), "record": pa.array(records, pa.binary())}
            )

    id_type = pages.schema["page_id"].dataType.simpleString()
    return source.mapInArrow(run, f"file long, offset long, page_id {id_type}, record binary")


class MerkleTree:
    """Levels of a replica's hashes, from records (level 0) to the root, each a stored table ``(a, b, hash)`` sorted
    by its keys, so that the children of one node are one range of it."""

    def __init__(self, records: DataFrame):
        leaves = records.select(F.col("file").alias("a"), F.col("offset").alias("b"), F.sha2("record", 256).alias("hash"))
        self.levels = [_stored(leaves)]
        for k in range(1, level_count()):
            below = self.levels[-1]
            a, b = parent(k, F.col("a"), F.col("b"))
            node = F.sha2(
                F.array_join(
                    F.transform(
                        F.sort_array(F.collect_list(F.struct("a", "b", "hash"))),
                        lambda c: F.concat_ws(":", c["a"], c["b"], c["hash"]),
                    ),
                    "\n",
                ),
                256,
            )
            nodes = below.groupBy(a.alias("pa"), b.alias("pb")).agg(node.alias("hash"))
            self.levels.append(_stored(nodes.select(F.col("pa").alias("a"), F.col("pb").alias("b"), "hash")))

    def root(self) -> str | None:
        """Hash of the whole replica; None if it is empty."""
        top = self.levels[-1].first()
        return top["hash"] if top else None

    def drop(self) -> None:
        """Remove the stored levels."""
        for level in self.levels:
            drop_table(level)


def _stored(level: DataFrame) -> DataFrame:
    return cut(level.sortWithinPartitions("a", "b"))


def level_count() -> int:
    return 1 + len(_RANGES) + 1 + _GROUP_LEVELS + 1


def parent(level: int, a: Column, b: Column) -> tuple[Column, Column]:
    """Key at ``level`` of the node above a node of the level below."""
    ranges = len(_RANGES)
    if level <= ranges:
        step = _RANGES[level - 1] - (_RANGES[level - 2] if level > 1 else 0)
        return a, F.shiftright(b, step)
    if level == ranges + 1:
        return a, F.lit(0).cast("long")
    if level <= ranges + 1 + _GROUP_LEVELS:
        return F.shiftright(a, _GROUP_BITS), F.lit(0).cast("long")
    return F.lit(0).cast("long"), F.lit(0).cast("long")


def differing_records(left: MerkleTree, right: MerkleTree) -> DataFrame:
    """``(file, offset, status)`` of the records that differ: ``altered``, ``missing`` (in ``right``) or ``extra``
    (only there). Levels are compared from the root down, each only below differing nodes; equal roots end it.
    Where few nodes differ, the ranges of their children are filters on the stored tables, which skip the rest."""
    if left.root() == right.root():
        return left.levels[0].select(F.col("a").alias("file"), F.col("b").alias("offset"), F.lit("").alias("status")).where("false")
    bad = None
    for k in reversed(range(level_count())):
        sides = []
        near = _children(k, bad)
        for tree, name in ((left, "x"), (right, "y")):
            level = tree.levels[k].withColumnRenamed("hash", name).where(near)
            if bad is not None:
                pa_, pb_ = parent(k + 1, F.col("a"), F.col("b"))
                level = level.withColumns({"pa": pa_, "pb": pb_}).join(bad, ["pa", "pb"], "left_semi").select("a", "b", name)
            sides.append(level)
        compared = sides[0].join(sides[1], ["a", "b"], "full_outer").where("not (x <=> y)")
        if k == 0:
            return compared.select(
                F.col("a").alias("file"),
                F.col("b").alias("offset"),
                F.when(F.col("y").isNull(), "missing").when(F.col("x").isNull(), "extra").otherwise("altered").alias("status"),
            )
        bad = cut(compared.select(F.col("a").alias("pa"), F.col("b").alias("pb")))
    raise AssertionError("a tree has at least its records")


def _children(level: int, bad: DataFrame | None) -> Column:
    """The ranges of keys at ``level`` below the nodes of ``bad``, where these are few; else everything."""
    found = bad.select("pa").distinct().limit(_HINTS + 1).collect() if bad is not None else None
    if not found or len(found) > _HINTS:
        return F.lit(True)
    grouped = level + 1 > len(_RANGES) + 1
    top = level + 1 > len(_RANGES) + 1 + _GROUP_LEVELS
    if top:
        return F.lit(True)
    shift = _GROUP_BITS if grouped else 0
    out = F.lit(False)
    for row in found:
        out |= F.col("a").between(row["pa"] << shift, ((row["pa"] + 1) << shift) - 1)
    return out


def audit(primary: DataFrame, replica: DataFrame) -> DataFrame:
    """Every record of ``primary`` and every extra one of ``replica`` with its ``status``.

    Both are tables ``(file, offset, page_id, record)``, as :func:`encode_pages` makes them. Returns ``(page_id,
    file, offset, length, sha256, status)``; extra records have no id, length and hash. Offsets of one file must
    not repeat. Null ids and repeated pages are records like any other; a null record hashes as none; other
    columns are ignored; two empty tables give an empty result.
    """
    left, right = MerkleTree(primary), MerkleTree(replica)
    found = cut(differing_records(left, right))
    known = primary.select("file", "offset", "page_id", F.octet_length("record").cast("long").alias("length")).join(
        left.levels[0].select(F.col("a").alias("file"), F.col("b").alias("offset"), F.col("hash").alias("sha256")),
        ["file", "offset"],
    )
    return known.join(found, ["file", "offset"], "full_outer").select(
        "page_id", "file", "offset", "length", "sha256", F.coalesce("status", F.lit("intact")).alias("status")
    )


def with_faults(records: DataFrame) -> DataFrame:
    """A copy of a replica with planted damage, by the number of the page: every 101st record altered in one
    byte, every 211th missing, every 307th cut short. A null id counts as 1; equal ids are damaged alike."""
    n = F.coalesce(F.col("page_id"), F.lit(1))
    record = F.col("record")
    damaged = (
        F.when(n % 101 == 7, F.expr("overlay(record placing encode('#', 'UTF-8') from 20)"))
        .when(n % 307 == 11, F.expr("substring(record, 1, octet_length(record) - 10)"))
        .otherwise(record)
    )
    return records.where(n % 211 != 5).withColumn("record", damaged)
