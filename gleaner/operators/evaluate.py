"""Retrieval baselines, task generators and scores of the evaluation suites."""

from __future__ import annotations

import ast
import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel, TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.functions import fixed
from gleaner.functions import text as X
from gleaner.operators import pack as P
from gleaner.operators import recall as R
from gleaner.operators import segment as S
from gleaner.plans import query as Q
from gleaner.session import discard, materialise, shared_dir

CONTEXT_TOKENS, RETRIEVER_TOKENS = 8000, 2000


def raw_grep(corpus: DataFrame, patterns: list[str]) -> DataFrame:
    """``file, line_no, shown`` of ``path:line: text``; lines from 1."""
    lines = S.exploded(corpus).where(Q.any_of(F.col("line"), patterns))
    number = (F.col("line_no") + 1).cast("bigint")
    return lines.select("file", number.alias("line_no"), F.concat_ws(":", "file", number.cast("string"), F.concat(F.lit(" "), F.trim("line"))).alias("shown"))


def whole_files(corpus: DataFrame, patterns: list[str]) -> DataFrame:
    return corpus.where(F.exists("lines", lambda x: Q.any_of(x, patterns)))


def ranked_files(corpus: DataFrame, query: Q.CompiledQuery, budget: int = CONTEXT_TOKENS) -> DataFrame:
    """``file, score, tokens``: matching files best first, until the budget is crossed.

    Only file-level sums are sorted, and only as many of the best as could fit
    the budget at one token each.
    """
    tokens = re.findall(r"[a-z0-9]{3,}", query.text.lower())
    name = F.lower(X.basename(F.col("file")))
    named = F.lit(False)
    for t in tokens:
        named = named | name.contains(t)
    hits = F.size(F.filter("lines", lambda x: Q.any_of(x, query.patterns)))
    rows = corpus.withColumn("hits", hits).where("hits > 0")
    score = F.col("hits") + F.when(named, 10).otherwise(0) - F.when(F.lower("file").contains("test"), 5).otherwise(0)
    scored = rows.select("file", score.cast("bigint").alias("score"), X.estimated_tokens(F.array_join("lines", "\n")).alias("tokens"))
    best = scored.orderBy(F.desc("score"), "file").limit(budget)
    return P.running_cap(best.withColumn("one", F.lit(0)), budget, ["one"], [F.desc("score"), F.col("file")]).drop("one")


PLAIN = R.Tokens("[a-z0-9_]{2,}", lambda word: [word], lower=True)


def bm25_windows(corpus: DataFrame, query: Q.CompiledQuery, limit: int = 50) -> DataFrame:
    """``file, lo, hi, s`` of the best line windows by BM25 with the usual library's constants (k1 1.5, b 0.75)."""
    words = re.findall(r"[a-z0-9_]{2,}", query.text.replace("\\", "").replace("|", " ").lower())
    return R.top(R.bm25(S.sliding_spans(corpus), {w: words.count(w) for w in words}, PLAIN, 1.5, 0.75), "s", limit)


def syntax_chunks(corpus: DataFrame) -> DataFrame:
    """``file, lo, hi``: top-level functions and classes of Python files by their syntax trees, else the first 120 lines."""
    source = corpus.select("file", F.array_join("lines", "\n").alias("text"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for file, text in zip(batch["file"], batch["text"], strict=True):
                spans = []
                if file.endswith(".py"):
                    try:
                        spans = [(n.lineno - 1, n.end_lineno) for n in ast.walk(ast.parse(text)) if isinstance(n, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef)]
                    except (SyntaxError, ValueError):
                        spans = []
                rows += [(file, lo, hi) for lo, hi in spans or [(0, min(120, text.count("\n") + 1))]]
            yield pd.DataFrame(rows, columns=["file", "lo", "hi"])

    return source.mapInPandas(run, "file string, lo int, hi int")


#: Members of commits that one block of them holds, so that a task's arrays stay in memory.
BLOCK_MEMBERS = 4_000_000


def _member_blocks(members: DataFrame) -> DataFrame:
    """``block, files, degrees, idx, sizes`` of ``commit_id, all``: commits near each other as one row of arrays.

    ``files`` are a block's distinct members, ``degrees`` their pairs, ``idx`` (32-bit numbers of files) and ``sizes`` its commits.
    """
    spark = members.sparkSession
    element = members.schema["all"].dataType.elementType.simpleString()
    sets = materialise(members, "rank-sets")  # read twice, for ranges and for blocks
    count = sets.agg(F.sum(F.size("all"))).first()[0] or 0
    lots = max(spark.sparkContext.defaultParallelism, math.ceil(count / BLOCK_MEMBERS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists = [b.column(0) for b in batches if b.num_rows]
        if not lists:
            return
        flat = pa.chunked_array([x.flatten() for x in lists]).combine_chunks().dictionary_encode()
        idx = flat.indices.to_numpy(zero_copy_only=False).astype(np.int32)
        sizes = np.concatenate([x.value_lengths().to_numpy(zero_copy_only=False) for x in lists]).astype(np.int32)
        degrees = np.bincount(idx, weights=np.repeat(sizes - 1, sizes), minlength=len(flat.dictionary)).astype(np.int64)
        columns = [pa.array([TaskContext.get().partitionId()], pa.int32())]
        columns += [pa.ListArray.from_arrays(pa.array([0, len(flat.dictionary)], pa.int32()), x) for x in (flat.dictionary, pa.array(degrees))]
        columns += [pa.array([x.tobytes()], pa.binary()) for x in (idx, sizes)]
        yield pa.RecordBatch.from_arrays(columns, ["block", "files", "degrees", "idx", "sizes"])

    dealt = sets.repartitionByRange(lots, "commit_id").select("all")
    blocks = materialise(dealt.mapInArrow(run, f"block int, files array<{element}>, degrees array<bigint>, idx binary, sizes binary"), "rank-blocks")
    discard(sets)
    return blocks


def _flows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``files, flow`` of blocks with ``need array<struct<pos, r>>``: what each file gets from the others of its commits."""
    for batch in batches:
        for k in range(batch.num_rows):
            row = batch.slice(k, 1)
            files, need = row.column(0), row.column(3).flatten()
            idx, sizes = (np.frombuffer(row.column(c)[0].as_py(), np.int32) for c in (1, 2))
            r = np.zeros(len(files.flatten()))
            r[need.field(0).to_numpy(zero_copy_only=False)] = need.field(1).to_numpy(zero_copy_only=False)
            commit = np.repeat(np.arange(len(sizes)), sizes)
            sums = np.bincount(commit, weights=r[idx], minlength=len(sizes))
            flow = np.bincount(idx, weights=sums[commit] - r[idx], minlength=len(r))
            yield pa.RecordBatch.from_arrays([files, pa.ListArray.from_arrays(pa.array([0, len(r)], pa.int32()), pa.array(flow))], ["files", "flow"])


def page_rank(members: DataFrame, nodes: DataFrame, rounds: int = 15, damping: float = 0.85, cut_every: int = 5) -> DataFrame:
    """``node, rank`` of ``nodes (node, pers)``, personalised, over the pairs in sets ``commit_id, all``; no redistribution from sinks.

    A pair's weight is the number of sets with both, so what a node gets is, for
    each of its sets, the set's sum without the node's own share: pairs are never
    made.  Sets lie in blocks that stay where they are; a round moves one number
    for each file of a block, there and back.  Lineage is cut by a reliable
    checkpoint every few rounds.
    """
    spark = nodes.sparkSession
    shared_dir(spark)
    lots = int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks = _member_blocks(members)
    kept = blocks.select("block", "files", "idx", "sizes").repartition(lots, "block").persist(StorageLevel.DISK_ONLY)
    places = blocks.select("block", F.posexplode("files").alias("pos", "node")).repartition(lots, "node").persist(StorageLevel.DISK_ONLY)
    out = blocks.select(F.explode(F.arrays_zip("files", "degrees")).alias("f")).groupBy(F.col("f.files").alias("node")).agg(F.sum("f.degrees").alias("out"))
    total = nodes.agg(F.sum("pers").alias("t"))
    base = nodes.crossJoin(F.broadcast(total)).select("node", (F.col("pers") / F.col("t")).alias("p")).join(out, "node", "left").checkpoint()
    rank = base.withColumn("rank", F.col("p"))
    for k in range(1, rounds + 1):
        need = places.join(rank.where("out > 0").select("node", (F.col("rank") / F.col("out")).alias("r")), "node")
        gathered = need.groupBy("block").agg(F.collect_list(F.struct("pos", "r")).alias("need"))
        files = kept.schema["files"].dataType.simpleString()
        flows = kept.join(gathered.hint("shuffle_merge"), "block").select("files", "idx", "sizes", "need").mapInArrow(_flows, f"files {files}, flow array<double>")
        flow = flows.select(F.explode(F.arrays_zip("files", "flow")).alias("f")).groupBy(F.col("f.files").alias("node")).agg(F.sum("f.flow").alias("in"))
        rank = base.join(flow, "node", "left").select("node", "p", "out", ((1 - damping) * F.col("p") + damping * F.coalesce("in", F.lit(0.0))).alias("rank"))
        if k % cut_every == 0 and k < rounds:
            rank = rank.checkpoint()
    ranked = materialise(rank.select("node", "rank"), "rank")
    kept.unpersist()
    places.unpersist()
    discard(blocks)
    return ranked


def containment(truth: DataFrame, context: DataFrame) -> DataFrame:
    """``task, found, wanted, hit``: how many of a task's truth lines are lines of its context; both ``task, line``."""
    have = context.select("task", "line").distinct().withColumn("__in", F.lit(1))
    rows = truth.select("task", "line").distinct().join(have, ["task", "line"], "left")
    return rows.groupBy("task").agg(F.count("__in").alias("found"), F.count("*").alias("wanted")).withColumn("hit", F.col("found") == F.col("wanted"))


def grep_windows(corpus: DataFrame, patterns: list[str], around: int = 60) -> DataFrame:
    """``file, lo, hi, code``: matching lines with so many lines on either side, as text; windows that touch are one."""
    rows = S.windows(S.with_hits(corpus, patterns), 2 * around + 1, around, around)
    return rows.select("file", "lo", "hi", S.as_text(F.col("code_lines")).alias("code"))


def context_scores(spans: DataFrame, contexts: DataFrame, limit: int = CONTEXT_TOKENS) -> DataFrame:
    """``task, hit, coverage, relevant, tokens, irrelevant`` of ``spans (task, text)`` and ``contexts (task, text)``.

    A context is cut at the limit.  A span is covered if all its stripped lines
    are lines of its task's context; the task is a hit if all spans are.
    ``relevant`` are tokens of span lines found, ``irrelevant`` the share of the
    context's tokens beyond them.  Tasks without a context are left out.
    """
    cut = F.when(X.estimated_tokens(F.col("text")) > limit, F.substring("text", 1, 4 * limit)).otherwise(F.col("text"))
    have = contexts.select("task", X.line_set(X.lines_of(cut)).alias("have"), X.estimated_tokens(cut).alias("tokens"))
    rows = spans.select("task", X.line_set(X.lines_of(F.col("text"))).alias("want")).join(have, "task")
    covered = (F.size(F.array_except("want", "have")) == 0).cast("double")
    chars = F.aggregate(F.array_intersect("want", "have"), F.lit(0), lambda n, x: n + F.length(x))
    sums = rows.groupBy("task").agg(
        (F.min(covered) == 1).alias("hit"), F.avg(covered).alias("coverage"), F.floor(F.sum(chars) / 4).alias("relevant"), F.first("tokens").alias("tokens")
    )
    return sums.withColumn("irrelevant", F.greatest(F.lit(0.0), 1 - F.col("relevant") / F.col("tokens")))


def refine_terms(text: DataFrame, asked: str, limit: int = 4, stop: list[str] | None = None) -> DataFrame:
    """``term, n``: identifiers of a context to search next: shaped ones first, then by count.

    ``text`` has ``text``; a term that is in the query is not new.
    """
    words = text.select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z_][A-Za-z0-9_]{4,}"), F.lit(0))).alias("term"))
    fresh = words.where(~F.lit(asked.lower()).contains(F.lower("term")) & ~F.lower("term").isin(*(stop or [""])))
    counts = fresh.groupBy("term").agg(F.count("*").alias("n"))
    shaped = F.col("term").contains("_") | F.col("term").rlike("^[a-z].*[A-Z]")
    return counts.orderBy(F.desc(F.when(shaped, 100).otherwise(0) + F.col("n")), "term").limit(limit)


def file_recall(answers: DataFrame) -> DataFrame:
    """Adds ``file_recall, correct`` to ``named, gt_files`` arrays."""
    share = F.size(F.array_intersect("named", "gt_files")) / F.greatest(F.size("gt_files"), F.lit(1))
    return answers.withColumn("file_recall", share).withColumn("correct", share >= 0.5)


def strategy_summary(cells: DataFrame) -> DataFrame:
    """``strategy, tasks, hit_rate, tokens, latency_ms``: rates, and medians, of result cells."""
    return cells.groupBy("strategy").agg(
        F.count("*").alias("tasks"), F.avg(F.col("included").cast("double")).alias("hit_rate"),
        F.percentile("tokens", 0.5).alias("tokens"), F.percentile("latency_ms", 0.5).alias("latency_ms"),
    )


def family_matrix(cells: DataFrame, families: list[str]) -> DataFrame:
    return cells.groupBy("strategy").pivot("family", families).agg(F.avg(F.col("included").cast("double")))


def session_commits(log: DataFrame) -> DataFrame:
    """Commits (``commit_id, subject, files, changed``) fit for a session: a telling subject, few files, a modest change."""
    dull = r"(?i)^(?:merge|revert|bump|release|version|typo|lint|format)"
    return log.where((F.length("subject") >= 20) & ~F.col("subject").rlike(dull) & F.col("files").between(1, 3) & F.col("changed").between(5, 80))


def query_from_message(subject: Column) -> Column:
    """Up to four distinct words of a subject, as alternatives; null for fewer than two."""
    words = F.slice(F.array_distinct(F.regexp_extract_all(F.lower(subject), F.lit("[a-z_]{4,}"), F.lit(0))), 1, 4)
    return F.when(F.size(words) >= 2, F.array_join(words, "|"))


def seeded(tasks: DataFrame, seed: int, key: str, limit: int) -> DataFrame:
    """A repeatable choice: the smallest hashes of seed and key."""
    return tasks.orderBy(F.xxhash64(F.lit(seed), key), key).limit(limit)


def symbol_tasks(lines: DataFrame) -> DataFrame:
    """``file, line_no, name, query`` for each definition with a name of four or more characters."""
    name = F.regexp_extract("line", r"^\s*(?:async\s+)?(?:def|class)\s+([A-Za-z_]\w{3,})", 1)
    return lines.withColumn("name", name).where("name <> ''").select("file", "line_no", "name", F.col("name").alias("query"))


def comprehension_tasks(corpus: DataFrame) -> DataFrame:
    """A definition asked for by up to three words of the comment or docstring line after it; ``corpus`` has ``file, lines``.

    The next line is looked up in the file's own row, so lines are neither sorted nor joined.
    """
    named = r"^\s*(?:async\s+)?(?:def|class)\s+([A-Za-z_]\w{3,})"
    at = F.transform("lines", lambda x, i: F.struct(i.cast("bigint").alias("line_no"), F.regexp_extract(x, named, 1).alias("name"), F.get("lines", i + 1).alias("next")))
    defined = corpus.select("file", F.explode(F.filter(at, lambda d: d["name"] != "")).alias("d")).select("file", "d.*")
    words = F.filter(F.array_distinct(F.regexp_extract_all(F.lower("next"), F.lit("[a-z]{5,}"), F.lit(0))), lambda w: ~F.col("name").contains(w))
    return defined.withColumn("words", F.slice(words, 1, 3)).where(F.size("words") >= 2).select("file", "line_no", "name", F.array_join("words", "|").alias("query"))


def call_tasks(lines: DataFrame) -> DataFrame:
    """``name, def_file, file, line_no``: the first call of each definition from another file that is no test.

    Called names are cut out of lines and joined to definitions, so no line is
    held against every name.
    """
    defs = symbol_tasks(lines).groupBy("name").agg(F.min("file").alias("def_file"))
    calls = lines.where(~X.is_definition(F.col("line")) & ~F.lower("file").contains("test")).select(
        "file", "line_no", F.explode(F.regexp_extract_all("line", F.lit(r"(\w+)\("), F.lit(1))).alias("name")
    )
    used = calls.join(defs, "name").where("file <> def_file")
    return used.groupBy("name", "def_file").agg(F.min(F.struct("file", "line_no")).alias("at")).select("name", "def_file", "at.file", "at.line_no")


def error_tasks(lines: DataFrame) -> DataFrame:
    """``file, line_no, query``: each file's first raise with a message of twelve or more characters."""
    message = F.regexp_extract("line", r"[\"']([^\"'{}]{12,})[\"']", 1)
    rows = lines.where(F.col("line").rlike(r"\braise\s+\w+") & ~F.lower("file").contains("test")).withColumn("query", F.trim(message)).where("query <> ''")
    return rows.groupBy("file").agg(F.min(F.struct("line_no", "query")).alias("at")).select("file", "at.line_no", "at.query")


def config_tasks(lines: DataFrame) -> DataFrame:
    """``key, file, line_no``: the first place of each constant or environment name."""
    constant = F.regexp_extract("line", r"^([A-Z][A-Z0-9_]{3,})\s*(?::[^=]+)?=\s*\S", 1)
    environment = F.regexp_extract("line", r"(?:environ(?:\.get)?|getenv)\(\s*[\"']([A-Z0-9_]{3,})[\"']", 1)
    key = F.coalesce(F.when(constant != "", constant), F.when(environment != "", environment))
    rows = lines.where(~F.lower("file").contains("test")).withColumn("key", key).where("key is not null")
    return rows.groupBy("key").agg(F.min(F.struct("file", "line_no")).alias("at")).select("key", "at.file", "at.line_no")


def test_tasks(lines: DataFrame) -> DataFrame:
    """``name, def_file, file, line_no``: each definition's first mention in a test file."""
    defs = symbol_tasks(lines).groupBy("name").agg(F.min("file").alias("def_file"))
    words = lines.where(F.lower("file").contains("test")).select("file", "line_no", F.explode(F.array_distinct(F.regexp_extract_all("line", F.lit(r"\w+"), F.lit(0)))).alias("name"))
    return words.join(defs, "name").groupBy("name", "def_file").agg(F.min(F.struct("file", "line_no")).alias("at")).select("name", "def_file", "at.file", "at.line_no")


# Definitions in other languages (fixed values): extension and pattern.
CROSS_LANGUAGE = {
    "typescript": (r"\.tsx?$", r"^\s*(?:export\s+)?(?:abstract\s+)?(?:function|class|interface|type|enum)\s+([A-Za-z_]\w{3,})"),
    "rust": (r"\.rs$", r"^\s*(?:pub(?:\(\w+\))?\s+)?(?:fn|struct|enum|trait|macro_rules!)\s+([A-Za-z_]\w{3,})"),
    "python": (r"\.py$", r"^\s*(?:def|class)\s+([A-Za-z_]\w{3,})"),
}


def cross_language_tasks(lines: DataFrame, language: str) -> DataFrame:
    extension, pattern = CROSS_LANGUAGE[language]
    rows = lines.where(F.col("file").rlike(extension)).withColumn("name", F.regexp_extract("line", pattern, 1)).where("name <> ''")
    return rows.groupBy("name").agg(F.min(F.struct("file", "line_no")).alias("at")).select("name", "at.file", "at.line_no")


def router_features(queries: DataFrame) -> DataFrame:
    """``query_id, features array<double>, margin``: the seven features of ``patterns`` and the trained router's sum."""
    p = F.col("patterns")
    n = F.size(p)
    features = F.array(
        F.lit(1.0), n.cast("double"), F.size(F.filter(p, lambda x: x.rlike("^[a-z][a-z0-9]{3,}$"))) / n,
        F.exists(p, lambda x: x.contains("_")).cast("double"), F.exists(p, lambda x: x.rlike("[A-Z]")).cast("double"),
        F.exists(p, lambda x: x.contains("\\")).cast("double"), F.aggregate(p, F.lit(0.0), lambda s, x: s + F.length(x)) / (4.0 * n),
    )
    rows = queries.where(n > 0).select("query_id", features.alias("features"))
    weights = F.array(*map(F.lit, fixed.ROUTER_WEIGHTS))
    margin = F.aggregate(F.zip_with("features", weights, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    return rows.withColumn("margin", margin)
