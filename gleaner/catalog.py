"""Registry of the engine's queries and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleaner import catalog_sql as SQL
from gleaner import catalog_tasks
from gleaner.functions import fixed
from gleaner.functions import text as X
from gleaner.operators import evaluate as E
from gleaner.operators import history as H
from gleaner.operators import pack as P
from gleaner.operators import recall as R
from gleaner.operators import score as C
from gleaner.operators import segment as S
from gleaner.plans import query as Q
from gleaner.session import materialise
from gleaner.sources import tables as T
from gleaner.streaming import sessions as ST

Query = Callable[[SparkSession, str], DataFrame]
WORDS = "the|and|tion"
CODE = "total|size|return"


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.with_lines(T.document_corpus(spark, sf_dir))


def _long(*names: str) -> list:
    return [F.col(n).cast("bigint").alias(n) for n in names]


def c_line_split_stats(spark, sf_dir):
    lines = S.exploded(_documents(spark, sf_dir))
    return lines.groupBy("file").agg(
        F.count("*").alias("n_lines"),
        F.sum(F.length("line")).alias("n_chars"),
        F.sum((F.length("line") + 1 > 5000).cast("bigint")).alias("n_long"),
        F.sum(X.estimated_tokens(F.col("line"))).alias("tokens"),
    )


def c_match_lines(spark, sf_dir):
    hits = S.with_hits(_documents(spark, sf_dir), Q.compile_query(WORDS).patterns)
    return hits.select("file", F.explode("hits").alias("h")).select(
        "file", F.col("h.no").cast("bigint").alias("line_no"), F.array_join(F.transform("h.found", lambda i: i.cast("string")), ",").alias("found")
    )


def _hits(spark, sf_dir):
    return S.with_hits(_documents(spark, sf_dir), Q.compile_query(WORDS).patterns)


def d_match_groups(spark, sf_dir):
    return S.with_groups(_hits(spark, sf_dir), 2).select("file", *_long("first", "last"), F.size("targets").cast("bigint").alias("hits"), F.size("found").cast("bigint").alias("matches"))


def d_context_windows(spark, sf_dir):
    rows = S.windows(_hits(spark, sf_dir), 2, 1, 1)
    return rows.select("file", *_long("lo", "hi"), S.as_text(F.col("code_lines")).alias("code")).select("file", "lo", "hi", X.content_hash(F.col("code")).alias("hash"), X.estimated_tokens(F.col("code")).alias("tokens"))


def d_merged_windows(spark, sf_dir):
    hits = S.with_hits(_documents(spark, sf_dir), ["ing"])
    return S.windows(hits, 2 * 2 + 1, 2, 2).select("file", *_long("lo", "hi"))


def d_sliding_windows(spark, sf_dir):
    return S.sliding_windows(_documents(spark, sf_dir)).select("file", *_long("lo", "hi"))


def e_semantic_tokens(spark, sf_dir):
    text = T.table(spark, sf_dir, "documents").select("text").unionByName(T.code_lines(spark, sf_dir).select(F.col("line").alias("text")))
    words = text.select(F.explode(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(R.SEM.pattern), F.lit(0))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    return words.select(F.explode(X.sem_tokens(F.col("word"))).alias("token"), "n").groupBy("token").agg(F.sum("n").alias("n"))  # each distinct word is cut once


def e_exact_token_df(spark, sf_dir):
    docs = T.document_corpus(spark, sf_dir)
    tokens = docs.select("file", F.explode(X.exact_tokens(F.coalesce("text", F.lit("")))).alias("token"))
    return tokens.groupBy("file", "token").agg(F.count("*").alias("tf")).groupBy("token").agg(F.count("*").alias("df"), F.sum("tf").alias("tf"))


def e_scalar_functions(spark, sf_dir):
    p = T.code_lines(spark, sf_dir)
    return p.select(
        "file", "line_no", X.basename(F.col("file")).alias("name"), X.language(F.col("file")).alias("language"), X.is_test_path(F.col("file")).alias("test"),
        X.is_vendored(F.col("file")).alias("vendored"), X.is_comment(F.col("line")).alias("comment"), F.size(X.rare_terms(F.col("line"))).cast("bigint").alias("rare"),
        X.safe_name(F.col("line")).alias("safe"), X.content_hash(F.col("line")).alias("hash"),
    )


def c_definition_lines(spark, sf_dir):
    return T.code_lines(spark, sf_dir).where(X.is_definition(F.col("line"))).select("file", "line_no", X.symbol_of(F.col("line")).alias("symbol"))


def c_symbols(spark, sf_dir):
    found = T.code_lines(spark, sf_dir).select(X.symbol_of(F.col("line")).alias("symbol")).where("symbol is not null")
    return found.groupBy("symbol").agg(F.count("*").alias("n"))


def c_file_map(spark, sf_dir):
    lines = T.code_lines(spark, sf_dir).where(F.col("line").rlike(fixed.MAP_LINE) & (F.length("line") <= 200))
    shown = lines.withColumn("r", F.row_number().over(Window.partitionBy("file").orderBy("line_no"))).where("r <= 60")
    body = F.rtrim("line")
    cut = F.when(F.length(body) > 110, F.concat(F.substring(body, 1, 110), F.lit(" ..."))).otherwise(body)
    return shown.select("file", "line_no", F.concat(F.lpad((F.col("line_no") + 1).cast("string"), 6, " "), F.lit("  "), cut).alias("shown"))


def d_definition_blocks(spark, sf_dir):
    return S.definition_blocks(T.code_corpus(spark, sf_dir)).select("file", *_long("lo", "hi"))


def d_python_blocks(spark, sf_dir):
    return S.python_blocks(T.code_corpus(spark, sf_dir)).select("file", *_long("line_no", "lo", "hi"))


def _scored(corpus, pattern, before, after):
    query = Q.compile_query(pattern)
    return C.scored(C.regions(S.windows(S.with_hits(corpus, query.patterns), before + after, before, after)), query.patterns)


def f_chunk_scores(spark, sf_dir):
    rows = _scored(_documents(spark, sf_dir), WORDS, 1, 1)
    return rows.select("file", *_long("line_start", "line_end", "matches"), F.col("score").cast("bigint").alias("score"), F.array_join("rank_reason", ",").alias("reasons"), "tokens")


def _code_scored(spark, sf_dir):
    return _scored(T.code_corpus(spark, sf_dir), CODE, 1, 1)


def f_chunk_scores_code(spark, sf_dir):
    rows = _code_scored(spark, sf_dir)
    return rows.select("file", *_long("line_start", "line_end", "matches"), F.col("score").cast("bigint").alias("score"), F.array_join("rank_reason", ",").alias("reasons"))


def g_exact_dups(spark, sf_dir):
    rows = _scored(_documents(spark, sf_dir), WORDS, 1, 1)
    return C.without_exact_duplicates(rows).select("file", "hash", *_long("line_start"))


def g_near_dups(spark, sf_dir):
    rows = _scored(_documents(spark, sf_dir), WORDS, 0, 0)
    return C.without_near_duplicates(rows).select("file", "hash", *_long("line_start"))


def g_near_dup_links(spark, sf_dir):
    docs = T.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("file"), X.lines_of(F.col("text")).alias("code_lines"))
    return C.near_duplicate_links(docs).withColumnRenamed("file", "doc_id")


def h_tfidf_rerank(spark, sf_dir):
    rows = _scored(_documents(spark, sf_dir), WORDS, 1, 1).orderBy(F.desc("score"), "file", "line_start").limit(250)
    cos = C.tfidf_cosine(rows.withColumn("id", F.concat_ws(":", "file", "line_start")), "id", "code", ["the", "and", "tion", "with", "zzzz"])
    return cos.select("id", F.round("cosine", 6).alias("cosine"))


QUESTION = "the thing and other then with tion"
BUDGET = 400


def _windows(spark, sf_dir):
    return S.sliding_spans(_documents(spark, sf_dir))


def i_bm25_topk(spark, sf_dir):
    best = R.top(R.bm25(_windows(spark, sf_dir), Q.query_tokens(QUESTION)), "s")
    return best.select("file", *_long("lo", "hi"), F.round("s", 6).alias("s"))


def i_recall_code(spark, sf_dir):
    chunks = R.recall(T.code_corpus(spark, sf_dir), Q.compile_query("return the total size of a part"))
    return chunks.select("file", *_long("line_start", "line_end"), "score", "tokens")


def i_tfidf_window_topk(spark, sf_dir):
    best = R.top(R.tfidf(_windows(spark, sf_dir), {w: 1 for w in Q.sem_tokens(QUESTION)}), "s")
    return best.select("file", *_long("lo", "hi"), F.round("s", 6).alias("s"))


def i_dense_topk(spark, sf_dir):
    sims = R.dense(T.table(spark, sf_dir, "embeddings"), 7).where("sim > 0")
    return sims.orderBy(F.desc("sim"), "vec_id").limit(40).select("vec_id", F.round("sim", 6).alias("sim"))


def _fused(spark, sf_dir):
    docs = T.table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("file"), X.lines_of(F.col("text")).alias("lines"))
    whole = docs.where(F.size("lines") > 0).withColumn("spans", F.array(F.struct(F.lit(0).alias("lo"), F.size("lines").alias("hi"))))
    lexical = R.bm25(whole, Q.query_tokens("the thing and")).select(F.col("file").cast("bigint").alias("id"), "s")
    sims = R.dense(T.table(spark, sf_dir, "embeddings"), 7).select(F.col("vec_id").alias("id"), "sim")
    return R.fused(lexical.join(sims.select("id"), "id", "left_semi"), sims, "id")


def i_fused_topk(spark, sf_dir):
    return R.both_tops(_fused(spark, sf_dir), "id").select("id", F.round("fused", 6).alias("fused"), F.round("fd", 6).alias("fd"))


def j_churn(spark, sf_dir):
    return H.churn(T.commits(spark, sf_dir)).select("file", F.round("w", 6).alias("w"))


def j_cochange_pairs(spark, sf_dir):
    return H.pairs(T.commits(spark, sf_dir))


def _text_scores(spark, sf_dir):
    return T.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("file"), F.col("p_size").cast("double").alias("s"))


def j_anchor_lift(spark, sf_dir):
    commits = T.commits(spark, sf_dir)
    return H.cochange_scores(commits, H.softmax_anchors(_text_scores(spark, sf_dir))).select("file", F.round("c", 6).alias("c"))


def j_file_fusion(spark, sf_dir):
    commits, text = T.commits(spark, sf_dir), _text_scores(spark, sf_dir)
    fused = H.fused_files(text, H.churn(commits), H.cochange_scores(commits, H.softmax_anchors(text)))
    return fused.select("file", F.round("s", 6).alias("s"))


def j_symbol_graph(spark, sf_dir):
    items = T.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("commit_id"), F.concat(F.lit("def part_"), F.col("l_partkey").cast("string"), F.lit("(size):")).alias("context"))
    symbols = H.hunk_symbols(items)
    anchors = spark.createDataFrame([("part_1",), ("part_2",), ("part_3",)], "anchor string")
    return H.symbol_expansions(symbols, anchors).select("symbol", F.round("w", 6).alias("w"))


def j_shuffled_churn(spark, sf_dir):
    return H.churn(H.shuffled(T.commits(spark, sf_dir))).select("file", F.round("w", 6).alias("w"))


def k_guaranteed_slots(spark, sf_dir):
    rows = _scored(T.code_corpus(spark, sf_dir), "def", 1, 1).withColumn("query_id", F.lit("q"))
    return P.reserved_slots(rows).select("slot", "file", *_long("line_start"))


def k_running_cap(spark, sf_dir):
    rows = _scored(_documents(spark, sf_dir), WORDS, 1, 1)
    return P.running_cap(rows, 200, ["file"], [F.desc("score"), F.col("line_start")]).select("file", *_long("line_start"), "tokens")


def k_overlap_anti(spark, sf_dir):
    rows = S.windows(_hits(spark, sf_dir), 2, 1, 1)
    chosen = S.sliding_windows(_documents(spark, sf_dir)).where(F.col("lo") % 80 == 0).select("file", (F.col("lo") + 1).alias("line_start"), (F.col("lo") + 3).alias("line_end"))
    left = P.without_overlaps(rows.select("file", (F.col("lo") + 1).alias("line_start"), F.col("hi").alias("line_end")), chosen)
    return left.select("file", *_long("line_start", "line_end"))


def _candidates(spark, sf_dir):
    """Candidates of one query for each source: its documents' best chunks and recall windows."""
    query = F.split("file", "/")[0]
    fields = ["query_id", "origin", "file", "line_start", "line_end", "score", "tokens", "code", "rank_reason"]
    chunks = _scored(_documents(spark, sf_dir), WORDS, 1, 1).withColumn("query_id", query).withColumn("origin", F.lit("lexical"))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "file", "line_start")
    lexical = chunks.withColumn("r", F.row_number().over(best)).where(F.col("r") <= fixed.RERANK_HEAD).select(*fields)
    found = R.bm25(_windows(spark, sf_dir), Q.query_tokens(QUESTION)).withColumn("query_id", query)
    top = Window.partitionBy("query_id").orderBy(F.desc(F.round("s", 9)), F.desc("file"), F.desc("lo"))
    peaks = found.groupBy("query_id").agg(F.max("s").alias("top"))  # one row for each source, as 40 of the blocks
    few = found.withColumn("r", F.row_number().over(top)).where(F.col("r") <= fixed.RECALL_LIMIT).join(F.broadcast(peaks), "query_id")
    rows = F.broadcast(few).join(_documents(spark, sf_dir), "file").withColumn("code", S.as_text(S.code_of(F.col("lines"), F.col("lo"), F.col("hi"))))
    recalled = (
        rows.withColumn("origin", F.lit("recall")).withColumn("line_start", F.col("lo") + 1).withColumn("line_end", F.col("hi"))
        .withColumn("score", (5 + F.floor(30 * F.col("s") / F.col("top"))).cast("double")).withColumn("tokens", X.estimated_tokens(F.col("code")))
        .withColumn("rank_reason", F.array(F.lit("semantic-recall"))).select(*fields)
    )
    return lexical.unionByName(recalled)


def _packed(spark, sf_dir, vague):
    out = P.pack_queries(_candidates(spark, sf_dir), BUDGET, "auto", vague)
    return out.select("query_id", "file", *_long("line_start", "line_end"), "score", "tokens", "why")


def k_pack_hybrid(spark, sf_dir):
    return _packed(spark, sf_dir, False)


def k_pack_vague(spark, sf_dir):
    return _packed(spark, sf_dir, True)


def l_coverage(spark, sf_dir):
    rows = _scored(_documents(spark, sf_dir), WORDS, 1, 1)
    kept = P.running_cap(rows, 60, ["file"], [F.desc("score"), F.col("line_start")]).select("file", "line_start").withColumn("kept", F.lit(1))
    both = rows.join(kept, ["file", "line_start"], "left")
    shown = F.sum(F.when(F.col("kept") == 1, F.col("tokens")).otherwise(0))
    return both.groupBy("file").agg(shown.alias("shown"), (F.sum("tokens") - shown).alias("omitted"), F.round(shown / F.sum("tokens"), 6).alias("coverage"))


def l_negative_patterns(spark, sf_dir):
    patterns = ["the", "tion", "zzzz", "qqqq", "ing"]
    corpus = _documents(spark, sf_dir)
    kept = S.windows(S.with_hits(corpus, ["tion"]), 2, 0, 0).select("file", F.explode("code_lines").alias("line"))
    inside = kept.agg(*(F.max(Q.matches(F.col("line"), p)).alias(f"i{k}") for k, p in enumerate(patterns)))
    anywhere = S.exploded(corpus).agg(*(F.max(Q.matches(F.col("line"), p)).alias(f"a{k}") for k, p in enumerate(patterns)))
    status = [
        F.struct(F.lit(p).alias("pattern"), F.when(F.col(f"i{k}"), "found").when(F.col(f"a{k}"), "outside").otherwise("absent").alias("status"))
        for k, p in enumerate(patterns)
    ]
    return inside.crossJoin(F.broadcast(anywhere)).select(F.explode(F.array(*status)).alias("s")).select("s.pattern", "s.status")


def l_summary(spark, sf_dir):
    corpus = _documents(spark, sf_dir)
    hits = S.with_hits(corpus, Q.compile_query(WORDS).patterns)
    return hits.agg(F.count("*").alias("files_searched"), F.sum((F.size("hits") > 0).cast("bigint")).alias("files_matched"))


def p_focus_terms(spark, sf_dir):
    rows = T.table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session"), "turn", "role", "text")
    return ST.focus_terms(rows).select("session", "term", F.round("weight", 6).alias("weight"))


def p_first_seen(spark, sf_dir):
    requests = T.table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("session"), ST.path_key(F.get_json_object("props", "$.k")).alias("path"))
    return ST.first_seen(requests, ["session", "path"], "event_id").select("event_id", "session", "path", "intercepted")


def p_intercepts(spark, sf_dir):
    docs = T.table(spark, sf_dir, "documents")
    requests = docs.select(
        "doc_id", F.when(F.col("doc_id") % 7 == 0, "Grep").otherwise("Read").alias("tool_name"), F.concat("source", F.lit("/"), "doc_id", F.when(F.col("doc_id") % 3 == 0, ".md").otherwise(".py")).alias("path"),
        F.when(F.col("doc_id") % 5 == 0, F.lit(1)).alias("offset"), F.lit(None).cast("int").alias("limit"), F.octet_length("text").alias("size"), F.length("text").alias("chars"),
    )
    return ST.intercepts(requests).select("doc_id", "path")


def r_raw_grep(spark, sf_dir):
    return E.raw_grep(_documents(spark, sf_dir), ["tion"])


def r_whole_files(spark, sf_dir):
    return E.whole_files(_documents(spark, sf_dir), ["tionn"]).select("file", F.size("lines").cast("bigint").alias("n"))


def r_file_rank(spark, sf_dir):
    return E.ranked_files(_documents(spark, sf_dir), Q.compile_query("src1|tion"))


def r_bm25_windows(spark, sf_dir):
    return E.bm25_windows(_documents(spark, sf_dir), Q.compile_query("the|and|with")).select("file", *_long("lo", "hi"), F.round("s", 6).alias("s"))


def r_tfidf_budget(spark, sf_dir):
    found = R.tfidf(_windows(spark, sf_dir), {w: 1 for w in Q.sem_tokens(QUESTION)}, X.idf_plain)
    best = found.orderBy(F.desc(F.round("s", 9)), F.desc("file"), F.desc("lo")).limit(50)
    rows = F.broadcast(best).join(_documents(spark, sf_dir), "file").withColumn("tokens", X.estimated_tokens(S.as_text(S.code_of(F.col("lines"), F.col("lo"), F.col("hi"))))).withColumn("one", F.lit(0))
    kept = P.running_cap(rows, E.RETRIEVER_TOKENS, ["one"], [F.desc(F.round("s", 9)), F.desc("file"), F.desc("lo")])
    return kept.select("file", *_long("lo", "hi"), "tokens")


def r_syntax_chunks(spark, sf_dir):
    return E.syntax_chunks(T.code_corpus(spark, sf_dir)).select("file", *_long("lo", "hi"))


def r_hit_rate(spark, sf_dir):
    truth = T.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("task"), F.explode(X.line_set(X.lines_of(F.col("text")))).alias("line"))
    lines = T.table(spark, sf_dir, "documents").select(F.explode(X.line_set(X.lines_of(F.col("text")))).alias("line")).distinct()
    context = truth.join(lines, "line").select("task", "line")
    return E.containment(truth, context)


def r_refine_terms(spark, sf_dir):
    return E.refine_terms(T.table(spark, sf_dir, "documents").select(F.coalesce("text", F.lit("")).alias("text")), "the|ention")


def r_repomap_pagerank(spark, sf_dir):
    nodes = T.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("node"), F.when(F.col("p_size") > 40, 1.0).otherwise(0.05).alias("pers"))
    return E.page_rank(H.member_sets(T.commits(spark, sf_dir)), nodes).select("node", F.round("rank", 9).alias("rank"))


def r_router_margin(spark, sf_dir):
    rows = T.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("query_id"), F.split(F.lower("p_type"), " ").alias("patterns"))
    return E.router_features(rows).select("query_id", F.round("margin", 6).alias("margin"), (F.col("margin") > 0).alias("vague"))


def r_router_logistic(spark, sf_dir):
    """Training accuracy of a logistic model over the router's seven features; the label is the plain router's verdict.

    Queries are the first one to five words of each document.  Those alike in
    label and features are one weighted row, so each of the fit's many passes is
    over these few.
    """
    words = F.split(F.coalesce("text", F.lit("")), r"\s+", 6)
    rows = T.table(spark, sf_dir, "documents").select("doc_id", F.slice(words, 1, (F.col("doc_id") % 5 + 1).cast("int")).alias("patterns"))
    plain = (F.size("patterns") >= 3) & F.forall("patterns", lambda x: x.rlike("^[a-z][a-z0-9]{3,}$"))
    labelled = rows.select("patterns", F.struct("doc_id", plain.cast("double").alias("label")).alias("query_id"))
    alike = E.router_features(labelled).groupBy("features", "query_id.label").agg(F.count("*").cast("double").alias("weight"))
    x = materialise(alike.select("label", "features", "weight"), "router").withColumn("features", array_to_vector("features"))
    model = LogisticRegression(maxIter=400, regParam=1e-4, fitIntercept=False, standardization=False, weightCol="weight").fit(x)
    right = F.sum(F.when(F.col("label") == F.col("prediction"), F.col("weight")).otherwise(0.0))
    return model.transform(x).agg(F.sum("weight").cast("bigint").alias("n"), F.round(right / F.sum("weight"), 2).alias("accuracy"))


def r_symbol_tasks(spark, sf_dir):
    return E.symbol_tasks(T.code_lines(spark, sf_dir))


def r_comprehension_tasks(spark, sf_dir):
    return E.comprehension_tasks(T.code_corpus(spark, sf_dir))


def r_summary(spark, sf_dir):
    cells = T.table(spark, sf_dir, "events").select(F.col("event_type").alias("strategy"), (F.col("value") > 50).alias("included"), F.col("user_id").alias("tokens"), F.col("value").alias("latency_ms"))
    rows = E.strategy_summary(cells)
    return rows.select("strategy", "tasks", F.round("hit_rate", 6).alias("hit_rate"), F.round("tokens", 6).alias("tokens"), F.round("latency_ms", 6).alias("latency_ms"))


def x_event_windows(spark, sf_dir):
    rows = ST.event_windows(T.table(spark, sf_dir, "events"), "6 hours", "3 hours")
    return rows.select(F.unix_timestamp(F.col("start").cast("timestamp")).alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


def x_session_windows(spark, sf_dir):
    rows = ST.session_windows(T.table(spark, sf_dir, "events"), "2 hours")
    return rows.select("user_id", F.unix_timestamp(F.col("start").cast("timestamp")).alias("start"), "n")


def x_rollup(spark, sf_dir):
    items = T.table(spark, sf_dir, "lineitem")
    return items.rollup("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


def x_cube(spark, sf_dir):
    events = T.table(spark, sf_dir, "events").withColumn("big", F.col("value") > 50)
    return events.cube("event_type", "big").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words query: match, group, window, score, rank; the report's first twenty rows."""
    rows = _scored(_documents(spark, sf_dir), WORDS, 2, 2)
    best = rows.orderBy(F.desc("score"), "file", "line_start").limit(20)
    return best.select("file", *_long("line_start", "line_end", "matches"), F.col("score").cast("bigint").alias("score"), F.array_join("rank_reason", ",").alias("reasons"), "hash")


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        flagship, c_line_split_stats, c_match_lines, c_definition_lines, c_symbols, c_file_map, d_match_groups, d_context_windows, d_merged_windows,
        d_sliding_windows, d_definition_blocks, d_python_blocks, e_semantic_tokens, e_exact_token_df, e_scalar_functions, f_chunk_scores,
        f_chunk_scores_code, g_exact_dups, g_near_dups, g_near_dup_links, h_tfidf_rerank, i_bm25_topk, i_recall_code, i_tfidf_window_topk,
        i_dense_topk, i_fused_topk, j_churn, j_cochange_pairs, j_anchor_lift, j_file_fusion, j_symbol_graph, j_shuffled_churn,
        k_guaranteed_slots, k_running_cap, k_overlap_anti, k_pack_hybrid, k_pack_vague, l_coverage, l_negative_patterns, l_summary,
        p_focus_terms, p_first_seen, p_intercepts, r_raw_grep, r_whole_files, r_file_rank, r_bm25_windows, r_tfidf_budget, r_syntax_chunks,
        r_hit_rate, r_refine_terms, r_repomap_pagerank, r_router_margin, r_router_logistic, r_symbol_tasks, r_comprehension_tasks,
        r_summary, x_event_windows, x_session_windows, x_rollup, x_cube,
    )
}


def queries() -> dict[str, Query]:
    return QUERIES | catalog_tasks.QUERIES


def oracle_sql() -> dict[str, str]:
    return SQL.ORACLES | catalog_tasks.ORACLES
