"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import gc
import math
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.session import clear_scratch, delete_path, discard, materialise, scratch_path, shared_dir

__all__ = ["clear_scratch", "delete_path", "discard", "materialise", "scratch_path", "shared_dir"]  # the session's, under the names used here
SHARES = 1 << 30
ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(col: str | Column = "text") -> Column:
    """The text, with null read as the empty text."""
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit("")).cast("string")


def ascii_lower(col: Column) -> Column:
    return F.translate(col, ASCII_UPPER, ASCII_UPPER.lower())


def hashed_sample(rows: DataFrame, key: str, most: int) -> DataFrame:
    """At most ``most`` rows, those of smallest hash of ``key`` (then key), so the choice is repeatable.

    Where there are more, only a share of the hashes that holds some more than
    ``most`` is sorted, so what each task sends on is its part of them.
    """
    count = rows.count()
    if count > most:
        rows = rows.where(F.pmod(F.xxhash64(key), F.lit(SHARES)) < min(SHARES, math.ceil((most + 6 * math.sqrt(most) + 10) / count * SHARES)))
    return rows.orderBy(F.pmod(F.xxhash64(key), F.lit(SHARES)), F.xxhash64(key), key).limit(most)


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Keep Arrow batches of whole texts small: memory of Python workers follows the batch, not the partition.

    Sets a session setting that holds until the (lazy) plan has run; a smaller one is left alone.
    """
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(setting, "10000"))
    if now <= 0 or now > rows:
        spark.conf.set(setting, str(rows))


def give_back() -> None:
    """Return this process's free memory to the system; allocators keep what is freed, and workers outlive stages."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's
    if trim is not None:
        trim(0)


_HELD: dict[str, dict] = {}


def worker_cache(operator: str) -> dict:
    """What this Python worker process holds for one operator; what it held for others goes.

    Workers outlive stages, so a cache left behind would count against the next stage's memory.
    """
    for other in [name for name in _HELD if name != operator]:
        del _HELD[other]
    gc.collect()
    give_back()
    return _HELD.setdefault(operator, {})


def release_shuffles(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of frames that are no longer referred to; it does so as the driver collects garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once.

    An expression named inside a lambda is evaluated again at every element; as
    the variable of an enclosing one-element transform it is a plain reference.
    """
    return F.element_at(F.transform(F.array(value), use), 1)


def exclusive_scan(values: Column, start: int, join: Callable[[Column, Column], Column], block: int = 256) -> Column:
    """``[start, join(start, v0), join(.., v1), ...]`` of an array of numbers, as array<bigint>; ``join`` is associative.

    Appending to an array copies it, so scans run inside blocks of ``block``
    elements whose own totals are scanned first; work is n*block rather than n*n.
    """
    empty = F.array().cast("array<bigint>")

    def scan(items: Column, first: Column) -> Column:
        return F.aggregate(
            items,
            F.struct(empty.alias("out"), first.cast("bigint").alias("at")),
            lambda acc, x: F.struct(F.concat(acc["out"], F.array(acc["at"])).alias("out"), join(acc["at"], x).cast("bigint").alias("at")),
            lambda acc: acc["out"],
        )

    def cut(items: Column) -> Column:
        last = F.floor(F.greatest(F.size(items) - 1, F.lit(0)) / block).cast("int")
        return F.transform(F.sequence(F.lit(0), last), lambda b: F.slice(items, b * block + 1, block))

    zero = F.lit(start).cast("bigint")
    totals = lambda blocks: F.transform(blocks, lambda part: F.aggregate(part, zero, lambda a, x: join(a, x)))
    return bound(
        F.transform(values, lambda x: x.cast("bigint")),
        lambda items: bound(cut(items), lambda blocks: F.flatten(F.zip_with(blocks, scan(totals(blocks), zero), scan))),
    )


def exclusive_prefix_sums(values: Column, block: int = 256) -> Column:
    """``[0, v0, v0+v1, ...]`` of an array of numbers, as array<bigint>."""
    return exclusive_scan(values, 0, lambda a, x: a + x, block)
