"""Nearest neighbours by shifted space-filling curves.

Vectors are projected to a few dimensions by several random rotations, shifted,
and put in order along a Hilbert curve, once for each rotation.  Spark range
partitions and sorts each order; a row's place in it comes from its partition's
offset.  A query looks at a window of places around its own, in every order; the
windows' rows are ranked by exact distance and merged.

Orders carry hashes, not vectors.  Equal vectors are one row of the index, which
keeps as many of its smallest ids as an answer can hold.  Neighbours on a curve
are only likely to be near, so the number of curves and the windows' share of
the places are fitted: on a bounded sample, the least work that reaches
``recall`` against brute force.  Vectors of low intrinsic dimension need a small
share; vectors without structure need most of the rows, as for any index.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleaner.llm.common import materialise

LEAST_CURVES, CURVES = 3, 6
DIMENSIONS, BITS = 8, 7  # 56-bit keys
SAMPLE_ROWS, SAMPLE_QUERIES = 4096, 256
RECALL = 0.97  # on the sample, to stay above 0.9 on the whole
BLOCK = 8192  # places searched at a time
QUERY_PART = 8192  # queries that meet a block at a time
SHARES = (0.001, 0.002, 0.005, 0.01, 0.02, 0.04, 0.08, 0.12, 0.18, 0.25, 0.32, 0.4, 0.5, 0.6, 0.75, 1.0)


def rotations(size: int, curves: int, seed: int = 7) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each curve an orthonormal projection and a shift (as a share of the cell)."""
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(curves):
        q, _ = np.linalg.qr(rng.standard_normal((size, min(size, DIMENSIONS))))
        out.append((q, rng.random(q.shape[1])))
    return out


def hilbert_keys(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Place along the Hilbert curve of each row of small non-negative integers.

    The cells' bits are untangled level by level from the top: where a
    coordinate's bit is set the first coordinate's lower bits are inverted,
    else they are exchanged with that coordinate's; a Gray code over all bits,
    interleaved, is the place.
    """
    x = [cells[:, k].astype(np.int64).copy() for k in range(cells.shape[1])]
    n = len(x)
    level = 1 << (bits - 1)
    while level > 1:
        below = level - 1
        for k in range(n):
            is_set = (x[k] & level) != 0
            swap = np.where(is_set, 0, (x[0] ^ x[k]) & below)
            x[0] ^= np.where(is_set, below, swap)
            x[k] ^= swap
        level >>= 1
    for k in range(1, n):
        x[k] ^= x[k - 1]
    carry, level = np.zeros_like(x[0]), 1 << (bits - 1)
    while level > 1:
        carry ^= np.where((x[-1] & level) != 0, level - 1, 0)
        level >>= 1
    key = np.zeros_like(x[0])
    for bit in range(bits - 1, -1, -1):
        for k in range(n):
            key = (key << 1) | (((x[k] ^ carry) >> bit) & 1)
    return key


class Curves:
    """Projections with the range of each coordinate, taken from the sample; beyond it coordinates are clipped."""

    def __init__(self, sample: np.ndarray, curves: int = CURVES):
        self.turns = rotations(sample.shape[1], curves)
        self.low, self.high = [], []
        for q, _ in self.turns:
            p = sample @ q
            self.low.append(p.min(0))
            self.high.append(p.max(0))

    def first(self, n: int) -> Curves:
        """The first ``n`` curves."""
        out = object.__new__(Curves)
        out.turns, out.low, out.high = self.turns[:n], self.low[:n], self.high[:n]
        return out

    def keys(self, x: np.ndarray) -> list[np.ndarray]:
        out, cells = [], (1 << BITS) - 1
        for (q, shift), low, high in zip(self.turns, self.low, self.high, strict=True):
            place = ((x @ q) - low) / np.where(high > low, high - low, 1.0)
            out.append(hilbert_keys(np.clip(np.floor(place * (cells - 1) + shift), 0, cells).astype(np.int64)))
        return out


def fitted_windows(sample: np.ndarray, curves: Curves, k: int, recall: float) -> tuple[int, float]:
    """How many curves, and which share of all places in each: the least work that finds ``recall`` of the sample's true neighbours."""
    rows, n_curves = len(sample), len(curves.turns)
    if rows < 4 * k:
        return n_curves, 1.0
    asked = np.linspace(0, rows - 1, min(SAMPLE_QUERIES, rows)).astype(int)
    near = np.empty((len(asked), k), np.int64)
    for i, q in enumerate(asked):
        far = ((sample - sample[q]) ** 2).sum(1)
        far[q] = np.inf
        near[i] = np.argpartition(far, k - 1)[:k]
    needed = np.full(near.shape, np.inf)  # the share whose window reaches the neighbour, in any curve so far
    best = (math.inf, n_curves, 1.0)
    for c, key in enumerate(curves.keys(sample), 1):
        place = np.empty(rows, np.int64)
        place[np.lexsort((np.arange(rows), key))] = np.arange(rows)
        at, there = place[asked][:, None], place[near]
        # a window keeps its width at the ends: it reaches ``there`` once its half is the gap, or its whole all up to that end
        needed = np.minimum(needed, np.minimum(2 * np.abs(there - at), np.where(there < at, rows - there, there + 1)) / rows)
        if c >= min(LEAST_CURVES, n_curves):
            share = next((s for s in SHARES if (needed <= s).mean() >= recall), 1.0)
            best = min(best, (c * share, c, share))
    return best[1:]


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``id, v`` without null, empty, zero or non-finite vectors, and without null ids; floats stay, other numbers become doubles."""
    kind = "array<float>" if vectors.schema[vector_col].dataType.simpleString() == "array<float>" else "array<double>"
    v = F.col(vector_col).cast(kind)
    return (
        vectors.select(F.col(id_col).cast("bigint").alias("id"), v.alias("v"))
        .where(F.col("id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0))
        .where(~F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))) & F.exists("v", lambda c: c != 0))
    )


NODE = ["h1", "h2"]  # 128 bits that stand for a vector


def search(
    vectors: DataFrame,
    every: int = 100,
    k: int = 10,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    recall: float = RECALL,
    curves: int = CURVES,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each row whose id is divisible by ``every``, its ``k`` nearest found.

    ``score`` is the Euclidean distance in double precision; ties go to the
    smaller id; a query is no answer to itself, though another row with an equal
    vector is, at distance 0.  Rows that repeat an id and a vector count once;
    vectors of different length never meet.  An empty table gives no rows.
    """
    rows = usable(vectors, id_col, vector_col).withColumns({"h1": F.xxhash64("v"), "h2": F.xxhash64(F.lit("second"), F.col("v"))})
    once = rows.groupBy(*NODE).agg(F.first("v").alias("v"))
    distinct = materialise(once.join(smallest_ids(rows, k + 1), NODE).select(*NODE, "ids", "v", F.size("v").alias("size")), "ann-distinct")
    sizes = distinct.groupBy("size").count().orderBy("size").collect()  # two numbers for each length of vector
    found = [
        _search_one_size(distinct.where(F.col("size") == r["size"]), rows.where(F.size("v") == r["size"]), r["size"], r["count"], every, k, recall, curves)
        for r in sizes
    ]
    if not found:
        return rows.sparkSession.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def smallest_ids(rows: DataFrame, n: int) -> DataFrame:
    """``h1, h2, ids``: each distinct vector's ``n`` smallest ids.

    Copies are cut to ``n`` for each of 64 hash parts first, so a vector that a
    third of all rows share is not gathered in one task.
    """
    part = rows.select(*NODE, "id", F.pmod(F.xxhash64("id"), F.lit(64)).alias("part")).distinct()
    inner = Window.partitionBy(*NODE, "part").orderBy("id")
    few = part.withColumn("r", F.row_number().over(inner)).where(F.col("r") <= n)
    return few.groupBy(*NODE).agg(F.slice(F.array_sort(F.collect_list("id")), 1, n).alias("ids"))


def nearest(asked: np.ndarray, there: np.ndarray, allowed: np.ndarray, least: np.ndarray, n: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each row of ``asked``: its number, and the columns and distances of the ``n`` nearest of ``there`` that are allowed.

    A matrix product, of vectors moved to the mean of ``there``, rules out what
    is farther than the ``n``-th by more than the product's rounding can be; the
    rest is measured by differences.  Ties go to the smaller of ``least``.
    """
    centre = there.mean(0)
    x, y = there - centre, asked - centre
    xx, yy = (x**2).sum(1), (y**2).sum(1)
    far = yy[:, None] + xx[None, :] - 2 * (y @ x.T)
    far[~allowed] = np.inf
    m = min(n, far.shape[1])
    limit = np.partition(far, m - 1, axis=1)[:, m - 1]
    slack = 4 * (x.shape[1] + 8) * np.finfo(np.float64).eps * (np.sqrt(yy) + math.sqrt(xx.max(initial=0.0))) ** 2
    for row in range(len(asked)):
        cols = np.flatnonzero((far[row] <= limit[row] + 2 * slack[row]) & allowed[row])
        exact = np.concatenate([np.sqrt(((there[part] - asked[row]) ** 2).sum(1)) for part in np.array_split(cols, len(cols) // 4096 + 1)])
        order = np.lexsort((least[cols], exact))[:n]
        yield row, cols[order], exact[order]


def _search_one_size(distinct: DataFrame, rows: DataFrame, size: int, total: int, every: int, k: int, recall: float, n_curves: int) -> DataFrame:
    spark = distinct.sparkSession
    # a share of the hashes that holds some more than the sample, so that few rows come to the driver
    drawn = distinct if total <= SAMPLE_ROWS else distinct.where(F.pmod("h2", F.lit(1 << 30)) < math.ceil(1.25 * SAMPLE_ROWS / total * (1 << 30)))
    sample = drawn.orderBy(*NODE).limit(SAMPLE_ROWS).select("v").toPandas()
    sample = np.array(sample["v"].tolist(), np.float64).reshape(-1, size)
    curves = Curves(sample, n_curves)
    used, share = fitted_windows(sample, curves, k, recall)
    curves = curves.first(used)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = batch.column(2).flatten().to_numpy(zero_copy_only=False)
            for c, key in enumerate(curves.keys(flat.astype(np.float64).reshape(-1, size))):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(key), c), pa.int32()), pa.array(key, pa.int64()), batch.column(0), batch.column(1)], names=["curve", "key", *NODE]
                )

    keyed = distinct.select(*NODE, "v").mapInArrow(place, "curve int, key bigint, h1 bigint, h2 bigint")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = keyed.repartitionByRange(parts, "curve", "key", *NODE).sortWithinPartitions("curve", "key", *NODE)
    ordered = materialise(
        ordered.withColumn("m", F.monotonically_increasing_id())
        .select("curve", F.shiftright("m", 33).cast("int").alias("part"), F.col("m").bitwiseAND((1 << 33) - 1).alias("at"), *NODE),
        "ann-order",
    )
    counts = ordered.groupBy("curve", "part").agg(F.count("*").alias("n"), F.min("at").alias("low")).toPandas()  # partitions x curves numbers
    counts = counts.sort_values(["curve", "part"])
    counts["offset"] = counts.groupby("curve")["n"].cumsum() - counts["n"] - counts["low"]
    offsets = spark.createDataFrame(counts[["curve", "part", "offset"]].astype({"offset": "int64"}), "curve int, part int, offset bigint")
    half = max(4 * k, math.ceil(share * total / 2))
    places = (
        ordered.join(F.broadcast(offsets), ["curve", "part"])
        .groupBy(*NODE)
        .agg(F.collect_list(F.struct("curve", (F.col("at") + F.col("offset")).alias("place"))).alias("places"))  # one for each curve
    )
    placed = materialise(
        distinct.join(places, NODE).select(*NODE, "v", F.col("ids")[0].alias("least"), F.explode("places").alias("p")).select(*NODE, "v", "least", "p.curve", "p.place"),
        "ann-placed",
    )
    # queries: every distinct vector that an id divisible by `every` has, expanded to those ids at the end
    asking = rows.where(F.col("id") % every == 0).select("id", *NODE).distinct()
    queries = asking.select(*NODE).distinct()
    meeting = queries.count() * min(1.0, (2 * half + BLOCK) / total)  # queries that look at a block
    parts_of_queries = max(1, math.ceil(meeting / QUERY_PART))
    low = F.greatest(F.lit(0), F.least(F.col("place") - half, F.lit(total - 1 - 2 * half)))
    spread = (
        placed.join(queries, NODE, "left_semi")
        .select("curve", *NODE, "v", low.alias("low"), F.least(F.lit(total - 1), low + 2 * half).alias("high"), F.pmod("h1", F.lit(parts_of_queries)).alias("part"))
        .withColumn("block", F.explode(F.sequence(F.floor(F.col("low") / BLOCK), F.floor(F.col("high") / BLOCK))))
    )
    base = placed.select(
        "curve", "place", *NODE, "v", "least", F.floor(F.col("place") / BLOCK).alias("block"),
        F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(parts_of_queries - 1).cast("bigint"))).alias("part"),
    )

    def meet(asked: pd.DataFrame, there: pd.DataFrame) -> pd.DataFrame:
        which, cols, far = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0)]
        if len(there):
            x = np.array(there["v"].tolist(), np.float64)
            at, least = there["place"].to_numpy(), there["least"].to_numpy()
            for start in range(0, len(asked), 256):
                part = asked.iloc[start : start + 256]
                allowed = (part["q_low"].to_numpy()[:, None] <= at) & (at <= part["q_high"].to_numpy()[:, None])
                for row, found, score in nearest(np.array(part["q_v"].tolist(), np.float64), x, allowed, least, k + 1):
                    which.append(np.full(len(found), start + row))
                    cols.append(found)
                    far.append(score)
        q, c = asked.iloc[np.concatenate(which)], there.iloc[np.concatenate(cols)]
        return pd.DataFrame({
            "q1": q["q_h1"].to_numpy(), "q2": q["q_h2"].to_numpy(), "h1": c["h1"].to_numpy(), "h2": c["h2"].to_numpy(),
            "least": c["least"].to_numpy(), "score": np.concatenate(far),
        })

    group = ["curve", "block", "part"]
    spread = spread.toDF(*(f"q_{c}" for c in spread.columns))  # both come from one table: names tell their columns apart
    met = spread.groupBy(*(f"q_{c}" for c in group)).cogroup(base.groupBy(*group)).applyInPandas(meet, "q1 bigint, q2 bigint, h1 bigint, h2 bigint, least bigint, score double")
    best = Window.partitionBy("q1", "q2").orderBy("score", "least")
    once = met.groupBy("q1", "q2", *NODE, "least").agg(F.min("score").alias("score"))
    few = once.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k + 1).drop("r")  # own vector and k others hold k answers
    answers = few.join(distinct.select(*NODE, "ids"), NODE).select("q1", "q2", F.explode("ids").alias("vec_id"), "score")
    asking = asking.select(F.col("id").alias("query_id"), F.col("h1").alias("q1"), F.col("h2").alias("q2"))
    rank = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return (
        asking.join(answers, ["q1", "q2"])
        .where("query_id <> vec_id")
        .withColumn("rank", F.row_number().over(rank).cast("int"))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
