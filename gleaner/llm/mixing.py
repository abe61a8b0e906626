"""Mixing to target weights with soft membership.

A softmax classifier trained on a labelled table gives each document posterior
probabilities over domains.  Rates r (expected copies) then solve

    minimise || sum_d r_d t_d p_d - T ||^2   over  r >= least

where t_d are a document's tokens, p_d its posterior and T the domain totals
wanted.  Projected gradient steps, in the metric that weights documents by
tokens, change r_d by -p_d . g for a short vector g that is the same for all
documents.  So the solver keeps no rate column between steps: the rates after
k steps are a fold over k vectors, and the fitted mix is the classifier with
that list of vectors.  Steps are implicit (the gradient is taken where the step
ends), so they may be long; the vector of each is found by a damped Newton
search for which every trial is one aggregate over (tokens, posterior) rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import hashed_sample, materialise, small_batches, text_of, worker_cache
from gleaner.llm.quality import FEATURES, text_features

MAX_TRAINING_ROWS = 8_000
KEYWORDS = 64


def _words(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().split()


@dataclass
class DomainModel:
    domains: list[str]
    keywords: list[bytes] = field(default_factory=list)
    centre: np.ndarray | None = None
    scale: np.ndarray | None = None
    weights: np.ndarray | None = None

    def posterior(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Tokens (words) of each text and its posterior over ``domains``."""
        tokens, x = domain_features(texts, self.keywords)
        if self.weights is None:
            return tokens, np.full((len(texts), len(self.domains)), 1.0 / max(1, len(self.domains)))
        z = np.hstack([np.ones((len(x), 1)), np.clip((x - self.centre) / self.scale, -8, 8)]) @ self.weights
        z -= z.max(axis=1, keepdims=True)
        e = np.exp(z)
        return tokens, e / e.sum(axis=1, keepdims=True)


def domain_features(texts: list[str], keywords: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    place, wanted = {k: i for i, k in enumerate(keywords)}, frozenset(keywords)
    tokens = np.zeros(len(texts), np.int64)
    x = np.zeros((len(texts), len(FEATURES) + len(keywords)))
    for row, text in enumerate(texts):
        words = _words(text)
        tokens[row] = len(words)
        x[row, : len(FEATURES)] = text_features(text)
        for word in wanted.intersection(words):
            x[row, len(FEATURES) + place[word]] = 1.0
    return tokens, x


def _softmax_fit(x: np.ndarray, y: np.ndarray, classes: int, steps: int = 300, ridge: float = 1e-3) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    centre, scale = x.mean(0), x.std(0) + 1e-6
    z = np.hstack([np.ones((len(x), 1)), np.clip((x - centre) / scale, -8, 8)])
    onehot = np.eye(classes)[y]
    w, moved, spread = np.zeros((z.shape[1], classes)), 0.0, 0.0
    for step in range(1, steps + 1):  # Adam on the full sample
        s = z @ w
        s -= s.max(1, keepdims=True)
        p = np.exp(s)
        p /= p.sum(1, keepdims=True)
        g = z.T @ (p - onehot) / len(x) + ridge * w
        moved, spread = 0.9 * moved + 0.1 * g, 0.999 * spread + 0.001 * g * g
        w -= 0.05 * (moved / (1 - 0.9**step)) / (np.sqrt(spread / (1 - 0.999**step)) + 1e-8)
    return w, centre, scale


def labelled_domains(labels: DataFrame) -> DataFrame:
    """The labelled table's domains: toxic, low (quality 0) and good; unlabelled values count as 0 and 1."""
    return labels.select(
        "doc_id",
        F.when(F.coalesce("toxic", F.lit(0)) > 0, 2).when(F.coalesce("quality", F.lit(1)) < 1, 1).otherwise(0).alias("domain"),
    )


DOMAINS = ["good", "low", "toxic"]


def fit_domains(
    docs: DataFrame, labelled: DataFrame, domains: list[str], max_rows: int = MAX_TRAINING_ROWS, keywords: int = KEYWORDS
) -> DomainModel:
    """A classifier from at most ``max_rows`` labelled documents (``doc_id, domain`` numbers).

    Keywords are the words whose presence differs most between a domain and
    the rest of the sample, counted in Spark; the driver receives ``keywords``
    words and ``max_rows`` feature vectors.  Where several documents have an id,
    one of them (of smallest hash) stands for it.
    """
    small_batches(docs.sparkSession)
    known = labelled.where("doc_id is not null and domain is not null").groupBy("doc_id").agg(F.max("domain").alias("__domain"))
    chosen = materialise(hashed_sample(known, "doc_id", max_rows), "mix-labels")
    sample = docs.select(docs["doc_id"], text_of(docs["text"]).alias("__text")).join(F.broadcast(chosen), "doc_id")
    one = F.min_by("__text", F.xxhash64("__text"))  # where several documents have an id; combined before the shuffle
    sample = materialise(sample.groupBy("doc_id").agg(one.alias("__text"), F.min("__domain").alias("__domain")), "mix-sample")
    words = F.array_distinct(F.split(F.lower("__text"), r"[\x20\x09-\x0D]+"))
    counts = (
        sample.select("__domain", F.explode(words).alias("word")).where("word <> ''")
        .groupBy("word").agg(*(F.sum((F.col("__domain") == k).cast("long")).alias(f"n{k}") for k in range(len(domains))))
    )
    totals = {r[0]: r[1] for r in sample.groupBy("__domain").count().collect()}
    everything = sum(totals.values())
    merit: Column = F.lit(0.0)
    for k in range(len(domains)):
        inside, outside = totals.get(k, 0), everything - totals.get(k, 0)
        if inside and outside:
            rest = sum((F.col(f"n{j}") for j in range(len(domains)) if j != k), F.lit(0))
            merit = F.greatest(merit, F.abs(F.col(f"n{k}") / F.lit(float(inside)) - rest / F.lit(float(outside))))
    best = counts.select("word", merit.alias("merit")).orderBy(F.desc("merit"), "word").limit(keywords)
    model = DomainModel(list(domains), sorted(r["word"].encode() for r in best.collect()))
    picked = model.keywords

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache("mixing")
        for batch in batches:
            _, x = domain_features(batch.column(0).to_pylist(), picked)
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(x.tolist(), pa.list_(pa.float64()))], names=["y", "x"])

    got = sample.select("__text", F.col("__domain").cast("int")).mapInArrow(run, "y int, x array<double>").toPandas()
    if len(got):
        x, y = np.array(got["x"].tolist(), np.float64), got["y"].to_numpy(np.int64)
        order = np.lexsort((*x.T[:8], y))
        model.weights, model.centre, model.scale = _softmax_fit(x[order], y[order], len(domains))
    return model


def memberships(docs: DataFrame, model: DomainModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, tokens, p array<double>`` of every row."""
    small_batches(docs.sparkSession)
    source = docs.select(docs[id_col].alias("id"), text_of(docs[text_col]).alias("body"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache("mixing")
        for batch in batches:
            tokens, p = model.posterior(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(tokens, pa.int64()), pa.array(p.round(9).tolist(), pa.list_(pa.float64()))], names=["id", "tokens", "p"]
            )

    return source.mapInArrow(run, f"id {source.schema['id'].dataType.simpleString()}, tokens bigint, p array<double>")


@dataclass
class Mix:
    model: DomainModel
    least: float
    steps: list[list[float]] = field(default_factory=list)
    wanted: list[float] = field(default_factory=list)
    reached: list[float] = field(default_factory=list)  # by the steps kept
    converged: bool = False  # within the tolerance, or as near as least squares comes

    def rate(self, p: Column) -> Column:
        """The fold of all steps, as a column."""
        steps = F.array(*(F.array(*map(F.lit, g)) for g in self.steps)) if self.steps else F.array().cast("array<array<double>>")
        return F.aggregate(
            steps,
            F.lit(max(1.0, self.least)),
            lambda r, g: F.greatest(
                F.lit(self.least), r - F.aggregate(F.zip_with(p, g, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
            ),
        )

    def rates(self, p: np.ndarray) -> np.ndarray:
        return folded(p, self.steps, self.least)


def folded(p: np.ndarray, steps: list[list[float]], least: float) -> np.ndarray:
    r = np.full(len(p), max(1.0, least))
    for g in steps:
        r = np.maximum(least, r - p @ np.array(g))
    return r


def trial_sums(members: DataFrame, steps: list[list[float]], trial: list[float], least: float) -> np.ndarray:
    """Sums over all rows, for the rates r after ``steps`` and then ``trial``: the tokens, t*r*p (a domain each),
    t*(r - r before the trial)^2, t*p.p, and t*p*p^T of the rows off the bound."""
    k = len(trial)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(3 + k + k * k)
        for batch in batches:
            t = batch.column(0).to_numpy(zero_copy_only=False).astype(np.float64)
            p = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(t), k)
            before = folded(p, steps, least)
            r = np.maximum(least, before - p @ np.array(trial))
            free = np.where(r > least, t, 0.0)
            sums += np.concatenate([[t.sum()], (t * r) @ p, [(t * (r - before) ** 2).sum(), (t[:, None] * p * p).sum()], (p.T @ (free[:, None] * p)).ravel()])
        yield pa.RecordBatch.from_arrays([pa.array([sums.tolist()], pa.list_(pa.float64()))], names=["sums"])

    found = members.select("tokens", "p").mapInArrow(run, "sums array<double>")
    return np.array([float(v or 0.0) for v in found.agg(*(F.sum(F.col("sums")[i]) for i in range(3 + k + k * k))).first()])


def fit_rates(
    members: DataFrame, model: DomainModel, weights: list[float], growth: float = 1.0, least: float = 0.0, max_steps: int = 8, tolerance: float = 1e-4
) -> Mix:
    """Projected gradient over all rows of ``members``; ``weights`` is each domain's share of ``growth`` times all tokens.

    A step from rates r goes to max(least, r - p.g) with g the gradient at its
    end over ``damping``: the minimum of the least squares plus ``damping`` times
    the squared move (less with each step).  Its dual is a smooth concave function of g, climbed by
    Newton's method with halved moves.  Stops when each total is within
    ``tolerance`` of all tokens, or when a step's end is a minimum to within that
    (``converged``), or after ``max_steps``.  A target that cannot be reached is
    approached as nearly as least squares does.
    """
    k = len(model.domains)
    mix = Mix(model, least)
    nothing = [0.0] * k
    sums = trial_sums(members, [], nothing, least)
    total = sums[0]
    if not total:
        return mix
    wanted = np.array(weights, float) / sum(weights) * growth
    mix.wanted = (wanted * total).tolist()
    scale = sums[2 + k] / total

    def dual(g: np.ndarray, sums: np.ndarray, damping: float) -> float:
        reached, moved = sums[1 : 1 + k] / total, sums[1 + k] / total
        return float(damping * g @ (reached - wanted) + damping * moved / 2 - damping**2 * g @ g / 2)

    for step in range(max_steps + 1):
        reached = sums[1 : 1 + k] / total
        mix.reached = (reached * total).tolist()
        damping = scale * max(1e-6, 1e-4 / 3**step)
        still = step > 0 and 3 * damping * math.sqrt(sums[1 + k] / total) <= tolerance / 10
        mix.converged = bool(still or np.abs(reached - wanted).max() <= tolerance)
        if mix.converged or step == max_steps:
            break
        g, sums = np.zeros(k), sums if step == 0 else trial_sums(members, mix.steps, nothing, least)
        for _ in range(20):
            slope = sums[1 : 1 + k] / total - wanted - damping * g
            if np.abs(slope).max() <= tolerance / 20:
                break
            move = np.linalg.solve(sums[3 + k :].reshape(k, k) / total + damping * np.eye(k), slope)
            height, length = dual(g, sums, damping), 1.0
            while length > 1e-3:
                tried = np.array([float(f"{v:.12g}") for v in g + length * move])
                there = trial_sums(members, mix.steps, tried.tolist(), least)
                if dual(tried, there, damping) >= height + 1e-4 * length * damping * float(slope @ move):
                    break
                length /= 2
            g, sums = tried, there
        mix.steps.append(g.tolist())
    return mix


def copies_of(rate: Column, *identity: Column) -> Column:
    """The rate rounded up or down by a hash of the row, so that copies are expected to equal it."""
    draw = F.pmod(F.xxhash64(*identity), F.lit(1 << 30)) / float(1 << 30)
    return F.floor(rate + draw).cast("bigint")


def mixed_rates(docs: DataFrame, labels: DataFrame, weights: list[float], growth: float = 1.0, least: float = 0.0) -> tuple[DataFrame, Mix]:
    """Each row's ``doc_id, tokens, p_<domain>, rate, copies`` and the fitted mix.

    Null and empty texts have no tokens: they get a posterior and a rate, but do
    not bear on the totals.  Repeated rows are separate documents of equal rate.
    """
    model = fit_domains(docs, labelled_domains(labels), DOMAINS)
    members = materialise(memberships(docs, model), "mix-members")
    mix = fit_rates(members, model, weights, growth, least)
    rated = members.withColumn("rate", F.round(mix.rate(F.col("p")), 6))
    out = rated.select(
        F.col("id").alias("doc_id"),
        "tokens",
        *(F.col("p")[i].alias(f"p_{name}") for i, name in enumerate(DOMAINS)),
        "rate",
        copies_of(F.col("rate"), F.col("id")).alias("copies"),
    )
    return out, mix


def apply_mix(docs: DataFrame, mix: Mix, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, each as often as its copies say; all columns as they were.  One pass, no join."""
    small_batches(docs.sparkSession)
    body = docs.columns.index(text_col)
    marked = docs.withColumn("__draw", F.pmod(F.xxhash64(F.col(id_col)), F.lit(1 << 30)) / float(1 << 30))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache("mixing")
        for batch in batches:
            texts = [t or "" for t in batch.column(body).to_pylist()]
            _, p = mix.model.posterior(texts)
            rate = mix.rates(p.round(9)).round(6)
            copies = np.floor(rate + batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False)).astype(np.int64)
            rows = np.repeat(np.arange(batch.num_rows), copies)
            plain = batch.select(list(range(batch.num_columns - 1)))
            for part in range(0, len(rows), 4096):
                yield plain.take(pa.array(rows[part : part + 4096]))

    return marked.mapInArrow(run, docs.schema)


TARGETS = [0.90, 0.08, 0.02]  # good, low, toxic


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return mixed_rates(docs, labels, TARGETS)[0]
