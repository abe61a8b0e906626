"""Queries whose work is to grow as their input: what is computed once, and right where it is cut to pieces."""

from __future__ import annotations

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F
from twins import DATA

from gleaner import catalog
from gleaner.operators import evaluate as E
from gleaner.operators import history as H
from gleaner.operators import recall as R
from gleaner.operators import segment as S
from gleaner.plans import query as Q


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def scans(df, table: str) -> int:
    return sum(path.endswith(f"/{table}.parquet") for leaf in leaves(df._jdf.queryExecution().optimizedPlan()) for path in leaf)


def leaves(node) -> list[list[str]]:
    """The files of each relation of a plan, as often as it is read."""
    children = node.children()
    if children.isEmpty():
        relation = getattr(node, "relation", None)
        return [list(relation().location().inputFiles())] if relation is not None and "parquet" in node.toString() else []
    return [x for i in range(children.size()) for x in leaves(children.apply(i))]


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(11)
    words = ["the", "thing", "otherThing", "and_then", "tion", "with", "running", "other", "rare1", "rare2", "caching", "zebra"]
    files = {f"f{k}": [" ".join(rng.choices(words, k=rng.randrange(0, 6))) for _ in range(rng.choice([1, 30, 61, 150, 205]))] for k in range(14)}
    files["copy"] = files["f3"]
    return files, spark.createDataFrame(list(files.items()), "file string, lines array<string>")


def blocks(files: dict[str, list[str]]) -> dict[tuple[str, int, int], Counter]:
    found = {}
    for file, lines in files.items():
        for lo in range(0, len(lines), 40):
            if lo == 0 or lo + 20 < len(lines):
                counts = Counter(Q.sem_tokens("\n".join(lines[lo : lo + 60])))
                if counts:
                    found[file, lo, min(lo + 60, len(lines))] = counts
    return found


def test_bm25_of_overlapping_windows(corpus):
    files, df = corpus
    weights = {"thing": 2, "rare1": 1, "absent": 3}
    rated = R.bm25(S.sliding_spans(df), weights)
    assert "lines" not in plan(rated)  # only counts are read again, no text
    windows = blocks(files)
    n, average = len(windows), sum(c.total() for c in windows.values()) / len(windows)
    wanted = {}
    for at, c in windows.items():
        s = 0.0
        for w, qw in weights.items():
            df_w = sum(w in x for x in windows.values())
            if c[w]:
                s += qw * math.log(1 + (n - df_w + 0.5) / (df_w + 0.5)) * c[w] * 2.2 / (c[w] + 1.2 * (0.25 + 0.75 * c.total() / average))
        if s > 0:
            wanted[at] = s
    assert {(r.file, r.lo, r.hi): r.s for r in rated.collect()} == pytest.approx(wanted)


@pytest.mark.parametrize("frequent", [0, 3, 50_000])
def test_tfidf_whatever_share_of_the_idf_tasks_hold(corpus, frequent):
    files, df = corpus
    weights = {"thing": 1, "with": 1, "absent": 1}
    got = {(r.file, r.lo, r.hi): r.s for r in R.tfidf(S.sliding_spans(df), weights, frequent=frequent).collect()}
    windows = blocks(files)
    n, df_of = len(windows), Counter(t for c in windows.values() for t in c)
    idf = {t: math.log(1 + n / (1 + k)) for t, k in df_of.items()}
    q = {t: w * idf[t] for t, w in weights.items() if t in idf}
    wanted = {}
    for at, c in windows.items():
        dot = sum(c[t] * idf[t] * q[t] for t in q)
        if dot > 0:
            wanted[at] = dot / math.sqrt(sum((k * idf[t]) ** 2 for t, k in c.items())) / math.sqrt(sum(v * v for v in q.values()))
    assert got == pytest.approx(wanted)
    assert all(s == got["copy", lo, hi] for (file, lo, hi), s in got.items() if file == "f3")  # copies tie to the last bit


def test_blocks_of_a_long_file_are_counted_once(spark):
    n = 20_000
    df = spark.createDataFrame([("long.py", [x for i in range(n) for x in (f"def part_{i}(size):", "    return total")])], "file string, lines array<string>")
    rows = R.bm25(S.definition_spans(df), {"total": 1}).agg(F.count("*").alias("n"), F.max("hi").alias("hi")).first()
    assert (rows.n, rows.hi) == (n, 2 * n)


@pytest.mark.parametrize("name, times", [("i_tfidf_window_topk", 0), ("i_bm25_topk", 0), ("i_fused_topk", 0), ("h_tfidf_rerank", 0), ("r_router_logistic", 0), ("r_tfidf_budget", 1), ("k_pack_hybrid", 2), ("k_pack_vague", 2)])
def test_documents_are_read_again_only_for_the_best(spark, name, times):
    """What passes over all documents is written; the result reads them for the text of the best, and for packing's lexical side."""
    assert scans(catalog.queries()[name](spark, DATA), "documents") == times


def test_semantic_tokens_cut_each_word_once(spark):
    above, _, below = plan(catalog.queries()["e_semantic_tokens"](spark, DATA)).partition("Aggregate [word")
    assert below and "_extract_all" in below and "endswith" not in below.lower()  # stems are of distinct words
    assert "transform" in above


def test_comprehension_tasks_neither_sort_nor_join_lines(spark):
    lines = ["def load_thing(a):", '    """Reads every other thing from tables."""', "", "class Later:", "def last_one():"]
    df = spark.createDataFrame([("a.py", lines), ("b.py", lines[4:] + ["# never again another"])], "file string, lines array<string>")
    found = E.comprehension_tasks(df)
    assert sorted(tuple(r) for r in found.collect()) == [("a.py", 0, "load_thing", "reads|every|other"), ("b.py", 0, "last_one", "never|again|another")]
    query = plan(catalog.queries()["r_comprehension_tasks"](spark, DATA))
    assert "Window" not in query and "Join" not in query and "Sort [" not in query


def test_router_fits_weighted_rows(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").where("trim(coalesce(text, '')) <> ''")
    assert docs.count() > 100
    row = catalog.queries()["r_router_logistic"](spark, DATA)
    assert "Join" not in plan(row) and row.first().n == spark.read.parquet(f"{DATA}/documents.parquet").count()


def test_page_rank_in_blocks_of_commits(spark, monkeypatch):
    rng = random.Random(12)
    commits = [(c, rng.sample([f"f{i}" for i in range(15)], rng.randrange(1, 8))) for c in range(80)]
    df = spark.createDataFrame([(c, f) for c, fs in commits for f in fs], "commit_id int, file string")
    pers = {f"f{i}": float(1 + i % 3) for i in range(14)} | {"alone": 1.0}  # f14 is no node
    nodes = spark.createDataFrame(list(pers.items()), "node string, pers double")
    weight = Counter((a, b) for _, fs in commits if len(fs) > 1 for a in fs for b in fs if a != b)
    out = Counter()
    for (a, _), n in weight.items():
        out[a] += n
    p = {f: v / sum(pers.values()) for f, v in pers.items()}
    rank = dict(p)
    for _ in range(7):
        rank = {f: 0.15 * p[f] + 0.85 * sum(rank[a] * n / out[a] for (a, b), n in weight.items() if b == f and a in rank) for f in p}
    monkeypatch.setattr(E, "BLOCK_MEMBERS", 20)
    got = {r.node: r["rank"] for r in E.page_rank(H.member_sets(df), nodes, rounds=7).collect()}
    assert got == pytest.approx(rank, rel=1e-9)
