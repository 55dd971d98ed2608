"""Reproducible sharding: a Feistel permutation with cycle walking over global row numbers.

Rows get a global number by their order of (id, text checksum, size), which does not depend on how the
input is split into files or tasks. A keyed Feistel network permutes ``0 .. n-1``; a row whose permuted
number is ``p`` lies in shard ``p mod shards`` at slot ``p div shards``. Both directions are computable
without a table: :meth:`FeistelPermutation.forward` and :meth:`FeistelPermutation.backward`.

The law that holds is ``rows``: counts of any two shards differ by at most one.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinmark.llm.common import arrow_map, cut

_U = np.uint64


@dataclass(frozen=True)
class FeistelPermutation:
    """A permutation of ``0 .. n-1`` fixed by ``key``; the network works on two halves of equal width and
    walks along its cycle until it is back inside the range."""

    n: int
    key: int = 20240607
    rounds: int = 6

    @property
    def half_bits(self) -> int:
        return max(1, (max(self.n - 1, 1).bit_length() + 1) // 2)

    def _round_keys(self) -> np.ndarray:
        return _mix(np.arange(1, self.rounds + 1, dtype=_U) + _U(self.key % 2**64))

    def _once(self, x: np.ndarray, keys: np.ndarray) -> np.ndarray:
        bits, mask = _U(self.half_bits), _U((1 << self.half_bits) - 1)
        left, right = x >> bits, x & mask
        for k in keys:
            left, right = right, left ^ (_mix(right ^ k) & mask)
        return (left << bits) | right

    def _once_back(self, x: np.ndarray, keys: np.ndarray) -> np.ndarray:
        bits, mask = _U(self.half_bits), _U((1 << self.half_bits) - 1)
        left, right = x >> bits, x & mask
        for k in keys[::-1]:
            left, right = right ^ (_mix(left ^ k) & mask), left
        return (left << bits) | right

    def _walk(self, numbers: np.ndarray, step) -> np.ndarray:
        out = np.asarray(numbers).astype(_U)
        keys, todo = self._round_keys(), np.arange(len(out))
        while len(todo):
            out[todo] = step(out[todo], keys)
            todo = todo[out[todo] >= _U(self.n)]
        return out.astype(np.int64)

    def forward(self, numbers: np.ndarray) -> np.ndarray:
        return self._walk(numbers, self._once)

    def backward(self, numbers: np.ndarray) -> np.ndarray:
        return self._walk(numbers, self._once_back)


def _mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of the splitmix64 generator (fixed public constants)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
        return x ^ (x >> _U(31))


def number_rows(rows: DataFrame, order: list[str]) -> tuple[DataFrame, int]:
    """``rows`` with a gapless ``global_row`` in the order of ``order``, and their count.

    A range shuffle sorts; each sorted part then needs only the count of the parts before it, a table of
    one row per part. Rows equal in every ordering column are dealt over parts by a tie-breaker, so
    copies of one row never have to meet in one task.
    """
    tied = rows.withColumn("__tie", F.monotonically_increasing_id())
    sorted_rows = cut(
        tied.repartitionByRange(*[F.col(c).asc_nulls_first() for c in order], F.col("__tie"))
        .sortWithinPartitions(*[F.col(c).asc_nulls_first() for c in order], "__tie")
        .select(
            *rows.columns,
            F.spark_partition_id().alias("__part"),
            F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("__within"),
        )
    )
    counts = sorted_rows.groupBy("__part").agg(F.count("*").alias("n")).collect()  # one row per part
    starts, total = {}, 0
    for part, n in sorted((r["__part"], r["n"]) for r in counts):
        starts[part] = total
        total += n
    spark = rows.sparkSession
    offsets = spark.createDataFrame(list(starts.items()) or [(-1, 0)], "__part int, __start long")
    numbered = sorted_rows.join(F.broadcast(offsets), "__part").select(
        *rows.columns, (F.col("__start") + F.col("__within")).alias("global_row")
    )
    return numbered, total


def assign_shards(
    docs: DataFrame, shards: int, key: int = 20240607, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per row of ``docs``: ``(doc_id, size, text_crc32, global_row, permuted_row, law, shard, slot,
    grown_shard)``.

    ``size`` is the text's UTF-8 bytes plus 1 (null text: 1, checksum of the empty text). Null ids sort
    first. Repeated rows are interchangeable: each takes one of their slots. An empty table gives an
    empty result. Only ids, sizes and checksums are shuffled, never texts; other columns are ignored.
    """
    narrow = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.coalesce(F.octet_length(text_col), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col(text_col), F.lit("")).cast("binary")).alias("text_crc32"),
    )
    numbered, total = number_rows(narrow, ["doc_id", "text_crc32", "size"])
    permutation = FeistelPermutation(total, key)

    def place(batch: pa.RecordBatch) -> dict:
        permuted = permutation.forward(batch.column("global_row").to_numpy(zero_copy_only=False))
        return {
            **{c: batch.column(c) for c in ("doc_id", "size", "text_crc32", "global_row")},
            "permuted_row": pa.array(permuted),
            "shard": pa.array((permuted % shards).astype(np.int32)),
            "slot": pa.array(permuted // shards),
        }

    id_type = docs.schema[id_col].dataType.simpleString()
    placed = arrow_map(
        numbered,
        place,
        f"doc_id {id_type}, size long, text_crc32 long, global_row long, permuted_row long, shard int, slot long",
    )
    return placed.withColumns({"law": F.lit("rows"), "grown_shard": F.lit(None).cast("int")})


def write_shards(docs: DataFrame, path: str, shards: int, key: int = 20240607) -> None:
    """Write whole documents into ``path/shard=k``, each shard in the order of its slots.

    Rows are dealt by (shard, slot block), so that one shard of a large corpus is written by many tasks.
    """
    keyed = docs.withColumns(
        {
            "__size": (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long"),
            "__crc": F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")),
        }
    )
    numbered, total = number_rows(keyed, ["doc_id", "__crc", "__size"])
    permutation = FeistelPermutation(total, key)

    def permute(batch: pa.RecordBatch) -> pa.RecordBatch:
        p = permutation.forward(batch.column("global_row").to_numpy(zero_copy_only=False))
        out = batch.append_column("shard", pa.array((p % shards).astype(np.int32)))
        return out.append_column("slot", pa.array(p // shards))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in numbered.schema)
    (
        arrow_map(numbered, permute, f"{schema}, shard int, slot long")
        .drop("__size", "__crc", "global_row")
        .repartitionByRange("shard", "slot")
        .sortWithinPartitions("shard", "slot")
        .write.partitionBy("shard")
        .parquet(path)
    )
