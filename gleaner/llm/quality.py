"""Quality classifier: a generalised additive model with pairwise interactions.

Each feature is cut into bins at quantiles of the training sample.  Boosting
goes round the features in turn; each step fits a shallow tree on one feature's
bins to the logistic loss's gradient and adds a fraction of it to that
feature's lookup table.  Then the pairs whose residuals a grid explains best
get tables over two features in the same way.  A score is the sum of table
entries through the logistic function, so scoring is one vectorised addition
for each table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import hashed_sample, materialise, small_batches, text_of, worker_cache

FEATURES = (
    "log_chars", "log_words", "mean_word", "longest_word", "upper", "lower", "digit", "space", "newline",
    "punctuation", "symbol", "rare_symbol", "pipe", "bang", "high", "entropy", "distinct_words", "repeated_next",
    "distinct_lines", "mean_line", "upper_words_like", "symbol_per_word", "digit_per_word", "top_byte",
)

MAX_TRAINING_ROWS = 20_000
REJECT_BELOW = 0.3

_GROUP = np.zeros(256, np.int64)  # 0: other
for _chars, _group in ((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", 1), (b"abcdefghijklmnopqrstuvwxyz", 2), (b"0123456789", 3), (b" \t\r\x0b\x0c", 4),
                       (b"\n", 5), (b".,;:'\"?()-", 6), (b"#$%&*@^~<>=+/\\_`{}[]", 7), (b"|", 8), (b"!", 9), (bytes(range(128, 256)), 10)):
    _GROUP[np.frombuffer(_chars, np.uint8)] = _group


def text_features(text: str) -> list[float]:
    """``FEATURES`` of a whole text; all zero for the empty one."""
    raw = text.encode("utf-8", "surrogatepass")
    if not raw:
        return [0.0] * len(FEATURES)
    by_byte = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    n = float(len(raw))
    group = np.bincount(_GROUP, weights=by_byte, minlength=11) / n
    words = raw.split()
    w = float(max(1, len(words)))
    lengths = list(map(len, words)) or [0]
    lines = raw.split(b"\n")
    p = by_byte[by_byte > 0] / n
    repeated = sum(map(eq, words, words[1:]))
    letters = group[1] + group[2] + group[10]
    return [
        np.log1p(n), np.log1p(len(words)), sum(lengths) / w, float(min(200, max(lengths))), *group[[1, 2, 3, 4, 5, 6]].tolist(),
        group[7] + group[8] + group[9], group[7], group[8], group[9], group[10], float(-(p * np.log2(p)).sum()),
        len(set(words)) / w, repeated / w, len(set(lines)) / len(lines), float(np.log1p(n / len(lines))),
        group[1] / letters if letters else 0.0, (group[7] + group[8] + group[9]) * n / w, group[3] * n / w, float(by_byte.max() / n),
    ]


def feature_matrix(texts: list[str | None]) -> np.ndarray:
    return np.array([text_features(t or "") for t in texts], np.float64).reshape(len(texts), len(FEATURES))


@dataclass
class AdditiveModel:
    intercept: float
    cuts: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)

    def margin(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.intercept)
        for k, table in enumerate(self.tables):
            total += table[np.searchsorted(self.cuts[k], x[:, k], side="right")]
        for i, j, ci, cj, table in self.pairs:
            total += table[np.searchsorted(ci, x[:, i], side="right"), np.searchsorted(cj, x[:, j], side="right")]
        return total

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.margin(x), -30, 30)))


def _quantile_cuts(column: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(column, np.linspace(0, 1, bins + 1)[1:-1])) if len(column) else np.zeros(0)


def _shallow_tree(g: np.ndarray, h: np.ndarray, leaves: int, penalty: float) -> np.ndarray:
    """Best-first splits of the bins into at most ``leaves`` runs; the Newton value of each bin's run."""
    cg, ch = np.concatenate([[0], np.cumsum(g)]), np.concatenate([[0], np.cumsum(h)])

    def worth(a, b):
        return (cg[b] - cg[a]) ** 2 / (ch[b] - ch[a] + penalty)

    def best(a: int, b: int) -> tuple[float, int]:
        if b - a < 2:
            return 0.0, a
        mid = np.arange(a + 1, b)
        gain = worth(a, mid) + worth(mid, b) - worth(a, b)
        k = int(gain.argmax())
        return float(gain[k]), int(mid[k])

    runs = [(0, len(g), *best(0, len(g)))]
    while len(runs) < leaves:
        k = max(range(len(runs)), key=lambda r: runs[r][2])
        a, b, gain, mid = runs[k]
        if gain <= 1e-9:
            break
        runs[k : k + 1] = [(a, mid, *best(a, mid)), (mid, b, *best(mid, b))]
    out = np.empty(len(g))
    for a, b, _, _ in runs:
        out[a:b] = (cg[b] - cg[a]) / (ch[b] - ch[a] + penalty)
    return out


def fit_additive(
    x: np.ndarray,
    y: np.ndarray,
    bins: int = 32,
    rounds: int = 120,
    rate: float = 0.15,
    leaves: int = 4,
    penalty: float = 2.0,
    interactions: int = 6,
    pair_bins: int = 8,
    pair_rounds: int = 60,
) -> AdditiveModel:
    """Cyclic boosting on the sample.  Without rows the score is 0.5; with one class, near that class."""
    if not len(y):
        return AdditiveModel(0.0)
    mean = (y.sum() + 0.5) / (len(y) + 1.0)
    model = AdditiveModel(float(np.log(mean / (1 - mean))))
    if y.min() == y.max():
        return model
    model.cuts = [_quantile_cuts(x[:, k], bins) for k in range(x.shape[1])]
    binned = [np.searchsorted(c, x[:, k], side="right") for k, c in enumerate(model.cuts)]
    sizes = [len(c) + 1 for c in model.cuts]
    model.tables = [np.zeros(s) for s in sizes]
    margin = np.full(len(y), model.intercept)

    def gradients() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-np.clip(margin, -30, 30)))
        return y - p, p * (1 - p)

    for _ in range(rounds):
        for k, b in enumerate(binned):
            g, h = gradients()
            step = rate * _shallow_tree(np.bincount(b, g, sizes[k]), np.bincount(b, h, sizes[k]), leaves, penalty)
            model.tables[k] += step
            margin += step[b]
    for k, b in enumerate(binned):  # each table has mean zero over the sample; the intercept takes the rest
        shift = float(model.tables[k][b].mean())
        model.tables[k] -= shift
        model.intercept += shift

    coarse = [_quantile_cuts(x[:, k], pair_bins) for k in range(x.shape[1])]
    grid = [np.searchsorted(c, x[:, k], side="right") for k, c in enumerate(coarse)]
    g, h = gradients()
    gains = []
    for i in range(x.shape[1]):
        for j in range(i + 1, x.shape[1]):
            wide = len(coarse[j]) + 1
            cell, cells = grid[i] * wide + grid[j], (len(coarse[i]) + 1) * wide
            gains.append((float((np.bincount(cell, g, cells) ** 2 / (np.bincount(cell, h, cells) + penalty)).sum()), i, j))
    chosen = sorted(gains, reverse=True)[:interactions]
    pair_tables = [np.zeros((len(coarse[i]) + 1, len(coarse[j]) + 1)) for _, i, j in chosen]
    for _ in range(pair_rounds):
        for table, (_, i, j) in zip(pair_tables, chosen, strict=True):
            g, h = gradients()
            step = rate * _quadrants(grid[i], grid[j], g, h, table.shape, penalty)
            table += step
            margin += step[grid[i], grid[j]]
    model.pairs = [(i, j, coarse[i], coarse[j], t) for (_, i, j), t in zip(chosen, pair_tables, strict=True)]
    return model


def _quadrants(a: np.ndarray, b: np.ndarray, g: np.ndarray, h: np.ndarray, shape: tuple[int, int], penalty: float) -> np.ndarray:
    """A depth-two tree on two features: the cut of each axis whose four quadrants explain most."""
    cell = a * shape[1] + b
    sums = []
    for v in (g, h):
        box = np.bincount(cell, v, shape[0] * shape[1]).reshape(shape)
        sums.append(np.pad(box.cumsum(0).cumsum(1), ((1, 0), (1, 0))))
    cg, ch = sums

    def quarter(c: np.ndarray) -> list[np.ndarray]:
        top, left, inner, all_ = c[1:-1, -1:], c[-1:, 1:-1], c[1:-1, 1:-1], c[-1, -1]
        return [inner, top - inner, left - inner, all_ - top - left + inner]

    if shape[0] < 2 or shape[1] < 2:
        return np.zeros(shape)
    parts = list(zip(quarter(cg), quarter(ch), strict=True))
    worth = sum(x**2 / (z + penalty) for x, z in parts)
    i, j = np.unravel_index(int(worth.argmax()), worth.shape)
    values = [float(x[i, j] / (z[i, j] + penalty)) for x, z in parts]
    out = np.empty(shape)
    out[: i + 1, : j + 1], out[: i + 1, j + 1 :], out[i + 1 :, : j + 1], out[i + 1 :, j + 1 :] = values
    return out


def with_fold(df: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Adds ``held_out``: crc32 of the id as text, modulo 5, is 0 (a null id counts as text '')."""
    return df.withColumn("held_out", F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 5 == 0)


def training_labels(labels: DataFrame, target: str, max_rows: int, id_col: str = "doc_id") -> DataFrame:
    """At most ``max_rows`` labelled ids outside the held-out fold: those of smallest hash, so the choice is repeatable.

    Null labels do not count; several labels of one id are averaged.
    """
    known = with_fold(labels.select(id_col, F.col(target).cast("double").alias("__y")), id_col)
    known = known.where(f"not held_out and __y is not null and {id_col} is not null")
    return hashed_sample(known.groupBy(id_col).agg((F.avg("__y") >= 0.5).cast("double").alias("__y")), id_col, max_rows)


def fit_quality(
    docs: DataFrame, labels: DataFrame, target: str = "quality", max_rows: int = MAX_TRAINING_ROWS, id_col: str = "doc_id", text_col: str = "text"
) -> AdditiveModel:
    """A model from a bounded sample (``max_rows`` labelled documents).

    Only the sample's features reach the driver: one short vector for each of
    ``max_rows`` ids.  Where several documents have an id, the smallest of their
    vectors stands for it.
    """
    small_batches(docs.sparkSession)
    chosen = materialise(training_labels(labels, target, max_rows, id_col), "quality-labels")
    # at most max_rows pairs of numbers
    sample = docs.select(docs[id_col].alias(id_col), text_of(docs[text_col]).alias("__text")).join(F.broadcast(chosen), id_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache("quality")
        for batch in batches:
            x = feature_matrix(batch.column("__text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("__y"), pa.array(x.tolist(), pa.list_(pa.float64()))], names=["id", "y", "x"])

    kind = sample.schema[id_col].dataType.simpleString()
    found = sample.select(F.col(id_col).alias("id"), "__text", "__y").mapInArrow(run, f"id {kind}, y double, x array<double>")
    got = found.groupBy("id").agg(F.min("y").alias("y"), F.min("x").alias("x")).select("y", "x").toPandas()
    x = np.array(got["x"].tolist(), np.float64).reshape(len(got), len(FEATURES))
    order = np.lexsort((*x.T, got["y"].to_numpy()))  # rows arrive in any order; sums should not depend on it
    return fit_additive(x[order], got["y"].to_numpy(np.float64)[order])


def score_documents(docs: DataFrame, model: AdditiveModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, score``: every row, with the probability that its label is 1.

    Null and empty texts have the all-zero features' score; repeated rows repeat.
    """
    small_batches(docs.sparkSession)
    source = docs.select(docs[id_col].alias("id"), text_of(docs[text_col]).alias("body"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache("quality")
        for batch in batches:
            scores = model.score(feature_matrix(batch.column(1).to_pylist()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], names=["id", "score"])

    return source.mapInArrow(run, f"id {source.schema['id'].dataType.simpleString()}, score double").withColumnRenamed("id", id_col)


def keep_good(docs: DataFrame, model: AdditiveModel, text_col: str = "text", least: float = REJECT_BELOW) -> DataFrame:
    """The rows of ``docs`` that score ``least`` or more, all columns as they were."""
    small_batches(docs.sparkSession)
    schema, at = docs.schema, docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache("quality")
        for batch in batches:
            yield batch.filter(pa.array(model.score(feature_matrix(batch.column(at).to_pylist())) >= least))

    return docs.mapInArrow(run, schema)


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The query's columns: fold, score and prediction of every document."""
    scored = with_fold(score_documents(docs, fit_quality(docs, labels)))
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= REJECT_BELOW).cast("int").alias("predicted"))
