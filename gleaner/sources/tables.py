"""Frames in the engine's shapes, from tables and from a directory tree."""

from __future__ import annotations

import os
import re
import subprocess

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleaner.functions import fixed


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Deals rows out if the scan has fewer tasks than there are cores, as a small file of one row group does; else the scan as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def document_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``file, text`` with a path made of source, language and id."""
    docs = spread(table(spark, sf_dir, "documents").select("source", "lang", "doc_id", "text"))
    return docs.select(F.concat("source", F.lit("/"), "lang", F.lit("/"), "doc_id", F.lit(".txt")).alias("file"), "text")


def _code_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``file, p_partkey, five``: five lines of Python for each part, by a fixed rule, in files by type and brand."""
    key = F.col("p_partkey").cast("string")
    head = F.when(F.col("p_partkey") % 5 == 0, "tests/test_").otherwise("src/")
    name = F.replace(F.replace(F.lower("p_name"), F.lit(" "), F.lit("_")), F.lit("#"), F.lit("_"))
    return table(spark, sf_dir, "part").select(
        F.concat(head, F.replace(F.lower("p_type"), F.lit(" "), F.lit("_")), F.lit("_"), F.replace("p_brand", F.lit("#"), F.lit("")), F.lit(".py")).alias("file"),
        "p_partkey",
        F.array(
            F.concat(F.lit("def "), name, F.lit("_"), key, F.lit("(size):")),
            F.concat(F.lit("    # "), "p_type", F.lit(" "), "p_brand"),
            F.concat(F.lit("    total = size * "), F.col("p_size").cast("string")),
            F.lit("    return total"),
            F.lit(""),
        ).alias("five"),
    )


def code_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``file, line_no, line`` of the generated code; parts are numbered, not their lines, so five times fewer rows are sorted."""
    order = Window.partitionBy("file").orderBy("p_partkey")
    rows = _code_parts(spark, sf_dir).withColumn("r", F.row_number().over(order) - 1)
    return rows.select("file", "r", F.posexplode("five").alias("k", "line")).select("file", (F.col("r") * 5 + F.col("k")).cast("bigint").alias("line_no"), "line")


def code_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``file, lines``: the generated code, one row for each file."""
    ordered = F.sort_array(F.collect_list(F.struct("p_partkey", "five")))
    return _code_parts(spark, sf_dir).groupBy("file").agg(F.flatten(F.transform(ordered, lambda x: x["five"])).alias("lines"))


def commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``commit_id, ts, file, changed``: an order is a commit, its parts are files, quantities are changed lines.

    Lines are dealt by order once; sums, the join and whatever groups by commit need no other shuffle.
    """
    orders, items = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    per_file = items.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "l_orderkey").groupBy("l_orderkey", "l_partkey").agg(F.sum("l_quantity").alias("changed"))
    return per_file.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("o_orderkey").alias("commit_id"), F.unix_timestamp(F.col("o_orderdate").cast("timestamp")).alias("ts"), F.col("l_partkey").alias("file"), F.col("changed").cast("bigint").alias("changed")
    )


def scan_tree(spark: SparkSession, root: str) -> DataFrame:
    """``file, text, size, mtime`` of a directory's files, or of one file; an absent path gives no rows.

    Extension and size filters reach the scan; names of skipped directories
    count below the root only.  Bytes that are not UTF-8 become U+FFFD, and all
    line ends a newline.
    """
    schema = "file string, text string, size bigint, mtime timestamp"
    if not os.path.exists(root):
        return spark.createDataFrame([], schema)
    single = os.path.isfile(root)
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(not single).lower())
    files = reader.load(root).withColumn("file", F.regexp_replace("path", "^file:/*", "/"))
    if not single:
        top = os.path.abspath(root).rstrip("/") + "/"
        below = F.substring("file", len(top) + 1, 1 << 30)
        skipped = "(?:^|/)(?:" + "|".join(re.escape(d) for d in fixed.SKIPPED_DIRECTORIES) + ")/"
        wanted = "(?i)(?:" + "|".join(re.escape(e) for e in fixed.SEARCHED_EXTENSIONS) + ")$"
        files = files.where(F.col("length") <= fixed.MAX_FILE_BYTES).where(below.rlike(wanted) & ~below.rlike(skipped))
    text = F.regexp_replace(F.decode("content", "UTF-8"), "\r\n?", "\n")
    return files.select("file", text.alias("text"), F.col("length").alias("size"), F.col("modificationTime").alias("mtime"))


def git_commits(spark: SparkSession, root: str, limit: int = 600, timeout: int = 30) -> DataFrame:
    """``commit_id, ts, file, changed`` of a repository's newest commits; no rows where there is no history."""
    schema = "commit_id string, ts bigint, file string, changed int"
    try:
        out = subprocess.run(
            ["git", "-C", root, "log", f"-{limit}", "--numstat", "--format=%x01%H %ct"], capture_output=True, text=True, timeout=timeout, check=True
        ).stdout
    except (OSError, subprocess.SubprocessError):
        return spark.createDataFrame([], schema)
    rows = []
    for record in out.split("\x01")[1:]:
        head, _, body = record.partition("\n")
        commit, ts = head.split()
        for added, removed, name in (line.split("\t", 2) for line in body.splitlines() if line.count("\t") >= 2):
            rows.append((commit, int(ts), name, sum(int(v) for v in (added, removed) if v.isdigit())))
    return spark.createDataFrame(rows, schema)


def git_hunks(spark: SparkSession, root: str, limit: int = 200, timeout: int = 60) -> DataFrame:
    """``commit_id, context``: what each hunk's header says it is in."""
    schema = "commit_id string, context string"
    try:
        out = subprocess.run(["git", "-C", root, "log", f"-{limit}", "-p", "-U0", "--format=%x01%H"], capture_output=True, text=True, errors="replace", timeout=timeout, check=True).stdout
    except (OSError, subprocess.SubprocessError):
        return spark.createDataFrame([], schema)
    rows = []
    for record in out.split("\x01")[1:]:
        commit, _, body = record.partition("\n")
        rows += [(commit.strip(), m.group(1)) for m in re.finditer(r"^@@[^@]*@@\s*(.*)$", body, re.M)]
    return spark.createDataFrame(rows, schema)


def transcript(spark: SparkSession, path: str) -> DataFrame:
    """``turn, role, text`` of a JSON-lines transcript's user and assistant messages, whose content is text or parts."""
    raw = spark.read.text(path).withColumn("turn", F.monotonically_increasing_id())
    plain = F.get_json_object("value", "$.message.content")
    parts = F.from_json(plain, "array<struct<type:string,text:string>>")
    text = F.when(plain.startswith("["), F.array_join(F.transform(F.filter(parts, lambda p: p["type"] == "text"), lambda p: p["text"]), "\n")).otherwise(plain)
    out = raw.select("turn", F.get_json_object("value", "$.message.role").alias("role"), text.alias("text"))
    return out.where(F.col("role").isin("user", "assistant") & (F.trim("text") != ""))
