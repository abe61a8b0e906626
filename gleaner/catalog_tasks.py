"""Queries of regions in code, task generators and scores, each with its SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner import catalog_sql as SQL
from gleaner.functions import text as X
from gleaner.operators import evaluate as E
from gleaner.operators import segment as S
from gleaner.plans import query as Q
from gleaner.sources import tables as T


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.with_lines(T.document_corpus(spark, sf_dir))


def d_function_regions(spark, sf_dir):
    hits = S.with_hits(T.code_corpus(spark, sf_dir), ["return", "size"])
    return S.function_regions(hits, 1, code=False).select("file", *(F.col(c).cast("bigint").alias(c) for c in ("first", "last", "lo", "hi")), "symbol")


def e_relative_paths(spark, sf_dir):
    paths = T.table(spark, sf_dir, "documents").select(F.concat(F.lit("\\data\\"), "source", F.lit("\\"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), "doc_id")
    return paths.select("doc_id", X.relative_path(F.col("path"), "/data/").alias("relative"))


def r_grep_windows(spark, sf_dir):
    rows = E.grep_windows(_documents(spark, sf_dir), ["ing"], 2)
    return rows.select("file", F.col("lo").cast("bigint").alias("lo"), F.col("hi").cast("bigint").alias("hi"), X.content_hash(F.col("code")).alias("hash"), X.estimated_tokens(F.col("code")).alias("tokens"))


def r_context_scores(spark, sf_dir):
    """Each document is the context of a task: its first line, its whole text, and a benchmark item's text are the spans."""
    docs = T.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("task"), F.coalesce("text", F.lit("")).alias("text"))
    items = T.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("task"), F.coalesce("text", F.lit("")).alias("text"))
    first = docs.select("task", F.substring_index("text", "\n", 1).alias("text"))
    rows = E.context_scores(first.unionByName(docs).unionByName(items), docs)
    return rows.select("task", "hit", F.round("coverage", 6).alias("coverage"), "relevant", "tokens", F.round("irrelevant", 6).alias("irrelevant"))


def r_family_matrix(spark, sf_dir):
    families = ["f0", "f1", "f2"]
    family = F.concat(F.lit("f"), (F.col("user_id") % 3).cast("string"))
    cells = T.table(spark, sf_dir, "events").select(F.col("event_type").alias("strategy"), family.alias("family"), (F.col("value") > 50).alias("included"))
    return E.family_matrix(cells, families).select("strategy", *(F.round(f, 6).alias(f) for f in families))


def r_session_commits(spark, sf_dir):
    """Orders as commits: subject out of customer, priority and status, files the order's lines, change its quantity."""
    items = T.table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("commit_id")).agg(F.count("*").alias("files"), F.sum("l_quantity").cast("bigint").alias("changed"))
    subject = F.concat(F.when(F.col("o_orderkey") % 4 == 0, "Merge ").otherwise("Handle "), F.col("o_orderpriority"), F.lit(" parcels of customer_"), F.col("o_custkey").cast("string"))
    log = T.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("commit_id"), subject.alias("subject")).join(items, "commit_id")
    return E.session_commits(log).select("commit_id", "files", "changed", E.query_from_message(F.col("subject")).alias("query"))


def r_file_recall(spark, sf_dir):
    """Files named: an order's parts of odd number; truth: its parts sold in lots of more than 20."""
    items = T.table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        F.collect_set(F.when(F.col("l_partkey") % 2 == 1, F.col("l_partkey"))).alias("named"), F.collect_set(F.when(F.col("l_quantity") > 20, F.col("l_partkey"))).alias("gt_files")
    )
    return E.file_recall(items).select(F.col("l_orderkey").alias("task"), F.round("file_recall", 6).alias("file_recall"), "correct")


def task_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``file, line_no, line``: for each part a definition, a call, an error, a constant and an environment name, by a fixed rule."""
    key = F.col("p_partkey")
    lines = F.array(
        F.format_string("def part_%d(size):", key),
        F.format_string("    return part_%d(size)", F.floor(key / 2)),
        F.format_string('    raise ValueError("no part of size %d is left")', F.col("p_size")),
        F.format_string("LIMIT_%d = 3", F.col("p_size")),
        F.format_string("x = os.environ.get('SIZE_%d')", key % 10),
    )
    file = F.concat(F.when(key % 7 == 0, "tests/test_").otherwise("src/mod_"), (key % 50).cast("string"), F.when(key % 50 == 3, ".rs").otherwise(".py"))
    rows = T.table(spark, sf_dir, "part").select("p_partkey", file.alias("file"), F.posexplode(lines).alias("k", "line"))
    return rows.select("file", (F.col("p_partkey") * 5 + F.col("k")).alias("line_no"), "line")


def r_call_tasks(spark, sf_dir):
    return E.call_tasks(task_lines(spark, sf_dir))


def r_test_tasks(spark, sf_dir):
    return E.test_tasks(task_lines(spark, sf_dir))


def r_error_tasks(spark, sf_dir):
    return E.error_tasks(task_lines(spark, sf_dir))


def r_config_tasks(spark, sf_dir):
    return E.config_tasks(task_lines(spark, sf_dir))


def r_language_tasks(spark, sf_dir):
    return E.cross_language_tasks(task_lines(spark, sf_dir), "python")


def _matching(patterns: list[str]) -> Column:
    return F.size(F.filter("lines", lambda x: Q.any_of(x, patterns)))


def q_compiled(spark, sf_dir):
    """Lines that compiled queries find: alternation, a bar inside brackets, a nested quantifier (none), expansion, anchors."""
    parts = []
    for i, text in enumerate(["the|and", "(th|an)[ei]", "(a+)+b", "other thing matter", r"tion\b|^th"]):
        try:
            patterns = Q.compile_query(text).patterns
        except ValueError:
            patterns = []
        parts.append(F.struct(F.lit(i).alias("query"), _matching(patterns).alias("n")))
    rows = _documents(spark, sf_dir).select(F.explode(F.array(*parts)).alias("p"))
    return rows.groupBy(F.col("p.query").cast("bigint").alias("query")).agg(F.sum("p.n").alias("n"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        d_function_regions, e_relative_paths, r_grep_windows, r_context_scores, r_family_matrix, r_session_commits, r_file_recall, r_call_tasks, r_test_tasks,
        r_error_tasks, r_config_tasks, r_language_tasks, q_compiled,
    )
}

TASKS = r"""
tasks AS (SELECT CASE WHEN p_partkey % 7 = 0 THEN 'tests/test_' ELSE 'src/mod_' END || (p_partkey % 50) || CASE WHEN p_partkey % 50 = 3 THEN '.rs' ELSE '.py' END AS file, p_partkey * 5 + unnest([0, 1, 2, 3, 4]) AS line_no,
  unnest(['def part_' || p_partkey || '(size):', '    return part_' || (p_partkey // 2) || '(size)', '    raise ValueError("no part of size ' || p_size || ' is left")', 'LIMIT_' || p_size || ' = 3', 'x = os.environ.get(' || chr(39) || 'SIZE_' || (p_partkey % 10) || chr(39) || ')']) AS line FROM part),
defs AS (SELECT name, min(file) AS def_file FROM (SELECT file, regexp_extract(line, '^def (\w+)', 1) AS name FROM tasks) WHERE name <> '' GROUP BY name)"""

_WANT = "list_distinct(list_filter(list_transform(string_split({0}, chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(13))), lambda x: x <> ''))"

ORACLES = {
    "d_function_regions": f"""
WITH {SQL.CODE}, {SQL._hits('code', ['return', 'size'])}, {SQL._groups(1)}, heads AS (SELECT file, line_no, {SQL.SYMBOL} AS symbol FROM code WHERE starts_with(line, 'def '))
SELECT g.file, first, last, h.line_no AS lo, coalesce((SELECT min(line_no) FROM heads x WHERE x.file = g.file AND x.line_no > g.last), n) AS hi, h.symbol
FROM groups g ASOF JOIN heads h ON h.file = g.file AND g.first >= h.line_no""",
    "e_relative_paths": "SELECT doc_id, source || '/' || doc_id || '.txt' AS relative FROM documents",
    "r_grep_windows": f"WITH {SQL.LINES}, {SQL._hits('lines', ['ing'])}, {SQL._groups(5)}, {SQL._chunks('lines', 2, 2)}, c AS (SELECT file, lo, hi, string_agg(line || chr(10), '' ORDER BY line_no) AS code FROM chunk_lines GROUP BY file, gid, lo, hi) SELECT file, lo, hi, substr(md5(code), 1, 8) AS hash, greatest(1, length(code) // 4) AS tokens FROM c",
    "r_context_scores": f"""
WITH d AS (SELECT doc_id AS task, coalesce(text, '') AS text FROM documents), cut AS (SELECT task, CASE WHEN length(text) // 4 > 8000 THEN left(text, 32000) ELSE text END AS body FROM d),
have AS (SELECT task, {_WANT.format('body')} AS have, greatest(1, length(body) // 4) AS tokens FROM cut),
spans AS (SELECT task, string_split(text, chr(10))[1] AS text FROM d UNION ALL SELECT * FROM d UNION ALL SELECT item_id, coalesce(text, '') FROM benchmark),
s AS (SELECT task, {_WANT.format('text')} AS want FROM spans),
j AS (SELECT task, tokens, len(list_filter(want, lambda x: NOT list_contains(have, x))) = 0 AS covered, coalesce(list_sum(list_transform(list_filter(want, lambda x: list_contains(have, x)), lambda x: length(x))), 0) AS chars FROM s JOIN have USING (task)),
t AS (SELECT task, bool_and(covered) AS hit, avg(CASE WHEN covered THEN 1.0 ELSE 0.0 END) AS coverage, CAST(sum(chars) AS BIGINT) // 4 AS relevant, any_value(tokens) AS tokens FROM j GROUP BY task)
SELECT task, hit, round(coverage, 6) AS coverage, relevant, tokens, round(greatest(0.0, 1 - relevant / tokens), 6) AS irrelevant FROM t""",
    "r_family_matrix": "SELECT event_type AS strategy, "
    + ", ".join(f"round(avg(CASE WHEN value > 50 THEN 1.0 ELSE 0.0 END) FILTER (WHERE user_id % 3 = {k}), 6) AS f{k}" for k in range(3))
    + " FROM events GROUP BY event_type",
    "r_session_commits": """
WITH i AS (SELECT l_orderkey AS commit_id, count(*) AS files, CAST(sum(l_quantity) AS BIGINT) AS changed FROM lineitem GROUP BY ALL),
s AS (SELECT o_orderkey AS commit_id, CASE WHEN o_orderkey % 4 = 0 THEN 'Merge ' ELSE 'Handle ' END || o_orderpriority || ' parcels of customer_' || o_custkey AS subject FROM orders),
w AS (SELECT commit_id, files, changed, regexp_extract_all(lower(subject), '[a-z_]{4,}') AS w FROM s JOIN i USING (commit_id) WHERE length(subject) >= 20 AND NOT starts_with(subject, 'Merge') AND files BETWEEN 1 AND 3 AND changed BETWEEN 5 AND 80)
SELECT commit_id, files, changed, array_to_string(list_filter(w, lambda x, k: list_position(w, x) = k)[:4], '|') AS query FROM w""",
    "r_file_recall": """
WITH i AS (SELECT l_orderkey AS task, coalesce(list(DISTINCT l_partkey) FILTER (WHERE l_partkey % 2 = 1), []) AS named, coalesce(list(DISTINCT l_partkey) FILTER (WHERE l_quantity > 20), []) AS gt FROM lineitem GROUP BY l_orderkey),
r AS (SELECT task, len(list_intersect(named, gt)) / greatest(len(gt), 1) AS share FROM i) SELECT task, round(share, 6) AS file_recall, share >= 0.5 AS correct FROM r""",
    "r_call_tasks": rf"WITH {TASKS}, c AS (SELECT file, line_no, regexp_extract(line, 'return (\w+)', 1) AS name FROM tasks WHERE starts_with(file, 'src/')), u AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY file, line_no) AS r FROM c JOIN defs USING (name) WHERE file <> def_file) SELECT name, def_file, file, line_no FROM u WHERE r = 1",
    "r_test_tasks": rf"WITH {TASKS}, c AS (SELECT file, line_no, regexp_extract(line, '(part_\w+)', 1) AS name FROM tasks WHERE starts_with(file, 'tests/')), u AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY file, line_no) AS r FROM c JOIN defs USING (name)) SELECT name, def_file, file, line_no FROM u WHERE r = 1",
    "r_error_tasks": f"WITH {TASKS}, u AS (SELECT file, line_no, regexp_extract(line, '\"([^\"]*)\"', 1) AS query, row_number() OVER (PARTITION BY file ORDER BY line_no) AS r FROM tasks WHERE starts_with(file, 'src/') AND contains(line, 'raise ')) SELECT file, line_no, query FROM u WHERE r = 1",
    "r_config_tasks": rf"WITH {TASKS}, c AS (SELECT file, line_no, coalesce(nullif(regexp_extract(line, '^(LIMIT_\w+)', 1), ''), regexp_extract(line, '(SIZE_\w+)', 1)) AS key FROM tasks WHERE starts_with(file, 'src/') AND (contains(line, 'LIMIT_') OR contains(line, 'SIZE_'))), u AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY file, line_no) AS r FROM c) SELECT key, file, line_no FROM u WHERE r = 1",
    "r_language_tasks": rf"WITH {TASKS}, c AS (SELECT file, line_no, regexp_extract(line, '^def (\w+)', 1) AS name FROM tasks WHERE ends_with(file, '.py')), u AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY file, line_no) AS r FROM c WHERE name <> '') SELECT name, file, line_no FROM u WHERE r = 1",
    "q_compiled": rf"""
WITH {SQL.LINES}, q(query, p) AS (VALUES (0, 'the|and'), (1, '(th|an)[ei]'), (3, 'other|thing|matter|other_thing|thing_matter'), (4, 'tion([^\pL\pN_]|$)|^th'))
SELECT CAST(query AS BIGINT) AS query, CAST(sum(CASE WHEN regexp_matches(line, '(?i)' || p) THEN 1 ELSE 0 END) AS BIGINT) AS n FROM lines CROSS JOIN q GROUP BY query
UNION ALL SELECT 2, 0""",
}
