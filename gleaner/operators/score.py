"""Additive relevance of a region, exact duplicates, near duplicates, TF-IDF reranking."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.functions import fixed
from gleaner.functions import text as X
from gleaner.operators import segment as S
from gleaner.plans import query as Q
from gleaner.session import materialise


def regions(groups: DataFrame) -> DataFrame:
    """``file, line_start, line_end, code_lines, found, symbol`` of groups with ``lo, hi, code_lines``."""
    symbol = F.col("symbol") if "symbol" in groups.columns else F.lit(None).cast("string")
    return groups.select(
        "file", (F.col("lo") + 1).alias("line_start"), F.col("hi").alias("line_end"), "code_lines", "found", symbol.alias("symbol")
    )


def _defines(line: Column, symbol: Column) -> Column:
    keyword = F.lit(False)
    for word in fixed.DEFINING_SUBSTRINGS:
        keyword = keyword | line.contains(word)
    return line.contains(symbol) & keyword


def _some_line(lines: Column, pattern: str) -> Column:
    return F.exists(lines, lambda x: Q.matches(x, pattern))


def scored(chunks: DataFrame, patterns: list[str]) -> DataFrame:
    """Adds ``matches, code, tokens, hash, score, rank_reason``.  Every feature is an expression on the row."""
    lines = F.col("code_lines")
    rows = chunks.withColumn("matches", F.size("found")).withColumn("code", S.as_text(lines))
    rows = rows.withColumn("__hits", F.filter(lines, lambda x: (F.length(x) <= fixed.MAX_LINE_CHARS) & Q.any_of(x, patterns)))
    hits = F.col("__hits")
    rows = rows.withColumn("__seen", F.filter(F.array(*(F.when(_some_line(hits, p), F.lit(i)) for i, p in enumerate(patterns))), lambda i: i.isNotNull()))
    rows = rows.withColumn("__rare", F.size(F.flatten(F.transform(hits, X.rare_terms))))
    seen, rare, symbol = F.size("__seen"), F.col("__rare"), F.col("symbol")
    on_line = F.exists(hits, X.is_definition)
    near = ~on_line & symbol.isNotNull() & F.exists(lines, lambda x: _defines(x, symbol))
    bodiless = symbol.isNotNull() & ~F.exists(lines, lambda x: x.contains("{") | x.contains(":")) & F.col("code").contains(symbol)
    test = X.is_test_path(F.col("file")) & F.lit("test" not in " ".join(patterns).lower())
    comments = F.size(F.filter(lines, X.is_comment))
    features = [
        (F.lit(True), F.least(F.col("matches") * 5, F.lit(25)), None),
        (F.col("matches") >= 3, F.lit(0), F.concat(F.lit("multi_match("), F.col("matches").cast("string"), F.lit(")"))),
        (seen >= 2, F.lit(15), F.lit("co_occurrence")),
        (F.lit(len(patterns) > 1) & (seen == len(patterns)), F.lit(10), F.lit("all_patterns")),
        (rare > 0, F.least(rare * 3, F.lit(15)), F.lit("rare_terms")),
        (on_line, F.lit(25), F.lit("definition")),
        (near, F.lit(12), F.lit("definition")),
        (bodiless, F.lit(-5), F.lit("declaration_only")),
        (test, F.lit(-8), F.lit("test_demoted")),
        (X.is_vendored(F.col("file")), F.lit(-15), F.lit("vendor_demoted")),
        ((F.size(lines) > 0) & (comments > 0.7 * F.size(lines)), F.lit(-10), F.lit("mostly_comments")),
    ]
    total: Column = F.lit(0)
    for when, points, _ in features:
        total = total + F.when(when, points).otherwise(F.lit(0))
    reasons = F.filter(F.array(*(F.when(when, tag) for when, _, tag in features if tag is not None)), lambda r: r.isNotNull())
    return (
        rows.withColumn("score", F.greatest(F.lit(0), total).cast("double"))
        .withColumn("rank_reason", reasons)
        .withColumn("tokens", X.estimated_tokens(F.col("code")))
        .withColumn("hash", X.content_hash(F.col("code")))
        .withColumn("patterns", F.transform("found", lambda i: F.element_at(F.array(*map(F.lit, patterns)), i + 1)))
        .drop("__hits", "__seen", "__rare")
    )


def without_exact_duplicates(chunks: DataFrame) -> DataFrame:
    """The best scored of the chunks with one hash in one file."""
    order = Window.partitionBy("file", "hash").orderBy(F.desc("score"), "line_start")
    return chunks.withColumn("__r", F.row_number().over(order)).where("__r = 1").drop("__r")


def without_near_duplicates(chunks: DataFrame, threshold: float = 0.7) -> DataFrame:
    """Greedy, file by file, in order of score: a chunk goes if its line set is like that of one kept.

    The fold runs over one file's chunks, which the file's own lines bound.
    """
    if threshold > 1:
        return without_exact_duplicates(chunks)
    fields = chunks.columns
    rows = chunks.withColumn("__c", F.struct((-F.col("score")).alias("order"), F.col("line_start").alias("at"), F.col("hash").alias("h"), X.line_set(F.col("code_lines")).alias("set")))
    gathered = rows.groupBy("file").agg(F.array_sort(F.collect_list("__c")).alias("all"))
    kept = F.aggregate(
        "all",
        F.slice("all", 1, 0),
        lambda out, c: F.when(
            F.exists(out, lambda k: (k["h"] == c["h"]) | (X.jaccard(k["set"], c["set"]) >= threshold)), out
        ).otherwise(F.concat(out, F.array(c))),
    )
    best = gathered.select(F.col("file").alias("__f"), F.explode(kept).alias("k")).select("__f", F.col("k.at").alias("__at"), F.col("k.h").alias("__h"))
    return chunks.join(best, (F.col("file") == F.col("__f")) & (F.col("line_start") == F.col("__at")) & (F.col("hash") == F.col("__h")), "left_semi").select(*fields)


def line_set_classes(docs: DataFrame) -> DataFrame:
    """``class_id, lines, n``: one row for each distinct set of lines of ``file, code_lines``, named by its smallest file."""
    sets = docs.select("file", F.array_sort(X.line_set(F.col("code_lines"))).alias("lines"))
    return (
        sets.withColumn("key", F.md5(F.array_join("lines", "\n")))
        .groupBy("key").agg(F.min("file").alias("class_id"), F.first("lines").alias("lines"))
        .withColumn("n", F.size("lines"))
    )


def near_duplicate_pairs(classes: DataFrame, threshold: float = 0.7) -> DataFrame:
    """``a < b, similarity`` of the classes whose sets of lines have a Jaccard similarity of ``threshold`` or more.

    Candidates share a line among the rarest of either: sets alike by t share
    more than n - t*n of n lines, so some of the n - ceil(t*n) + 1 rarest.  A line
    that most documents have is looked at only where a set has little else.  The
    sets themselves decide.
    """
    lines = classes.select("class_id", "n", F.explode("lines").alias("line")).select("class_id", "n", F.xxhash64("line").alias("l"))
    known = lines.join(lines.groupBy("l").agg(F.count("*").alias("df")), "l")
    rarest = known.groupBy("class_id", "n").agg(F.array_sort(F.collect_list(F.struct("df", "l"))).alias("by"))  # one set's lines
    head = F.slice("by", 1, F.col("n") - F.ceil(threshold * F.col("n") - 1e-9).cast("int") + 1)
    marks = rarest.select("class_id", "n", F.explode(F.transform(head, lambda x: x["l"])).alias("l"))
    left, right = marks.toDF("a", "n_a", "l"), marks.toDF("b", "n_b", "l")
    size = (F.col("n_a") >= threshold * F.col("n_b") - 1e-9) & (F.col("n_b") >= threshold * F.col("n_a") - 1e-9)
    met = left.join(right, "l").where((F.col("a") < F.col("b")) & size).select("a", "b").distinct()
    ends = [classes.select(F.col("class_id").alias(x), F.col("lines").alias(f"lines_{x}")) for x in "ab"]
    both = met.join(ends[0], "a").join(ends[1], "b").withColumn("similarity", X.jaccard(F.col("lines_a"), F.col("lines_b")))
    return both.where(F.col("similarity") >= threshold - 1e-12).select("a", "b", "similarity")


def near_duplicate_links(docs: DataFrame, threshold: float = 0.7) -> DataFrame:
    """``file, class_id, links`` of every document: its class and how many other classes are similar to it."""
    classes = line_set_classes(docs)
    pairs = near_duplicate_pairs(classes, threshold)
    ends = pairs.select(F.explode(F.array("a", "b")).alias("class_id")).groupBy("class_id").agg(F.count("*").alias("links"))
    counted = classes.join(ends, "class_id", "left").select("key", "class_id", F.coalesce("links", F.lit(0).cast("bigint")).alias("links"))
    keyed = docs.select("file", F.md5(F.array_join(F.array_sort(X.line_set(F.col("code_lines"))), "\n")).alias("key"))
    return keyed.join(counted, "key").select("file", "class_id", "links")


def tfidf_cosine(chunks: DataFrame, id_col: str, text_col: str, words: list[str]) -> DataFrame:
    """``id_col, cosine`` of the candidates that share a word with the query; idf from the candidates alone.

    Query words that no candidate has weigh ln(1 + n) in the query's norm.  The
    candidates are written to the shared folder first, for they are read several
    times and are the best of a ranking of everything.
    """
    spark = chunks.sparkSession
    chunks = materialise(chunks.select(id_col, text_col), "rerank")
    tf = chunks.select(id_col, F.explode(X.exact_tokens(F.col(text_col))).alias("token")).groupBy(id_col, "token").agg(F.count("*").alias("tf"))
    n = chunks.agg(F.count("*").alias("n"))
    vocabulary = tf.groupBy("token").agg(F.count("*").alias("df")).crossJoin(F.broadcast(n)).withColumn("idf", X.idf_smooth(F.col("n"), F.col("df")))  # n is one row
    asked = spark.createDataFrame([(w, words.count(w)) for w in sorted(set(words))], "token string, qtf int")  # one query's words
    weights = (
        F.broadcast(asked).join(vocabulary.select("token", "idf"), "token", "left").crossJoin(F.broadcast(n))
        .select("token", (F.col("qtf") * F.coalesce("idf", F.log(1 + F.col("n")))).alias("q"))
    )
    norm_q = weights.agg(F.sqrt(F.sum(F.col("q") * F.col("q"))).alias("norm_q"))
    weighted = tf.join(vocabulary.select("token", "idf"), "token").withColumn("w", F.col("tf") * F.col("idf"))
    scored = weighted.join(F.broadcast(weights), "token", "left").groupBy(id_col).agg(
        F.sum(F.coalesce(F.col("w") * F.col("q"), F.lit(0.0))).alias("dot"), F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm")
    )
    norm = F.col("norm") * F.col("norm_q")
    cosines = scored.crossJoin(F.broadcast(norm_q)).where("dot > 0").select(id_col, (F.col("dot") / F.when(norm == 0, F.lit(1.0)).otherwise(norm)).alias("cosine"))
    cosines._gleaner_scratch = chunks._gleaner_scratch
    return cosines


def reranked(chunks: DataFrame, query: Q.CompiledQuery, head: int = fixed.RERANK_HEAD) -> DataFrame:
    """The best ``head`` chunks gain round(12 * cosine); tagged ``semantic`` at 4 or more."""
    top = chunks.orderBy(F.desc("score"), "file", "line_start").limit(head)
    bonus = tfidf_cosine(top.withColumn("__id", F.concat_ws(":", "file", "line_start")), "__id", "code", re_words(query))
    few = F.broadcast(bonus.select("__id", F.bround(12 * F.col("cosine"), 0).cast("int").alias("__bonus")))  # at most `head` rows
    joined = chunks.withColumn("__id", F.concat_ws(":", "file", "line_start")).join(few, "__id", "left")
    plus = F.coalesce("__bonus", F.lit(0))
    tagged = F.when(plus >= 4, F.concat("rank_reason", F.array(F.lit("semantic")))).otherwise(F.col("rank_reason"))
    out = joined.withColumn("score", F.col("score") + plus).withColumn("rank_reason", tagged).drop("__id", "__bonus")
    out._gleaner_scratch = bonus._gleaner_scratch
    return out


def re_words(query: Q.CompiledQuery) -> list[str]:
    return re.findall(r"[a-z0-9_]{3,}", query.text.lower())
