"""One query end to end: ``focused_read`` over a corpus of any size."""

from __future__ import annotations

import json
import os
import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.functions import fixed
from gleaner.functions import text as X
from gleaner.operators import history as H
from gleaner.operators import pack as P
from gleaner.operators import recall as R
from gleaner.operators import score as C
from gleaner.operators import segment as S
from gleaner.plans import query as Q
from gleaner.session import discard
from gleaner.sources import tables as T

CANDIDATE_LIMIT = 2000  # scored chunks whose text packing under a budget looks at; of the rest only the places are listed


@dataclass
class Result:
    query: list[str]
    chunks: list[P.Slice]
    omitted: list[P.Omission]
    negative_evidence: list[str]
    files_searched: int
    files_matched: int
    budget: int
    dropped_by_budget: int = 0
    cuts: list[P.Omission] = field(default_factory=list)

    @property
    def total_tokens(self) -> int:
        return sum(c.tokens for c in self.chunks)

    @property
    def omitted_tokens(self) -> int:
        return sum(o.tokens for o in self.omitted)

    @property
    def coverage(self) -> float:
        return P.coverage(self.chunks, self.omitted)

    def to_dict(self) -> dict:
        return {
            "query": self.query,
            "budget": self.budget,
            "total_tokens": self.total_tokens,
            "files_searched": self.files_searched,
            "files_matched": self.files_matched,
            "deduped": self.dropped_by_budget,
            "coverage": round(self.coverage, 3),
            "omitted_tokens": self.omitted_tokens,
            "omitted": [vars(o) for o in self.omitted],
            "negative_evidence": self.negative_evidence,
            "chunks": [
                {
                    "file": c.file, "line_start": c.line_start, "line_end": c.line_end, "symbol": c.symbol or None, "patterns": c.patterns,
                    "matches": c.matches, "score": int(c.score), "rank_reason": c.rank_reason, "hash": c.hash, "tokens": c.tokens, "code": c.code,
                }
                for c in self.chunks
            ],
        }

    def to_json(self, indent: int | None = None) -> str:
        return json.dumps(self.to_dict(), indent=indent)

    def render(self) -> str:
        many = self.files_searched > 1
        head = f"=== {'tree' if many else 'file'}: {len(self.chunks)} slice(s), ~{self.total_tokens} tokens"
        head += f" / {self.budget} budget" if self.budget else ""
        head += f", {self.files_searched} files searched, {self.files_matched} matched" if many else ""
        out = [head + " ===", "\nQUERY:\n" + "|".join(self.query)]
        if len(self.chunks) > 1:
            out.append("\nRANKING:")
            for i, c in enumerate(self.chunks[:10], 1):
                out.append(f"  {i}. {_name(c.file)}:{c.line_start}{_symbol(c)} - {', '.join(c.rank_reason) or 'direct_match'}")
        out.append("\n---")
        for c in self.chunks:
            about = f"[{_name(c.file)}:{c.line_start}-{c.line_end}{_symbol(c)} matches={c.matches} patterns={','.join(c.patterns[:5])} hash={c.hash} score={int(c.score)}]"
            out.append(f"\n{about}\n{c.code}")
        if self.dropped_by_budget:
            out.append(f"\n[DROPPED BY BUDGET: {self.dropped_by_budget}]")
        if self.omitted:
            out.append(f"\nOMITTED: {len(self.omitted)} matching region(s), ~{self.omitted_tokens} tokens not returned ({self.coverage:.0%} of matched material shown):")
            out += [f"  {_name(o.file)}:{o.line_start}-{o.line_end}  ~{o.tokens} tok  score={o.score}  ({', '.join(o.reason) or 'match'})" for o in self.omitted[:8]]
            if len(self.omitted) > 8:
                out.append(f"  ... and {len(self.omitted) - 8} more")
            out.append("  -> raise the budget, or read these ranges directly.")
        if self.negative_evidence:
            out.append("\nNEGATIVE EVIDENCE:")
            out += [f"  - {a}" for a in self.negative_evidence]
        return "\n".join(out)


def _name(path: str) -> str:
    return path.replace("\\", "/").rsplit("/", 1)[-1]


def _symbol(c: P.Slice) -> str:
    return f" fn={c.symbol}" if c.symbol else ""


def lexical_chunks(corpus: DataFrame, query: Q.CompiledQuery) -> DataFrame:
    """Matching, grouping, bounding, scoring and deduplication; ``corpus`` has ``file, lines``."""
    o = query.options
    hits, gap = S.with_hits(corpus, query.patterns), o.before + o.after
    bounded = S.function_regions(hits, gap) if o.boundary == "fn" else S.windows(hits, gap, o.before, o.after)
    return C.without_near_duplicates(C.scored(C.regions(bounded), query.patterns), 0.7 if o.dedupe else 2.0)


FIELDS = ["file", "line_start", "line_end", "score", "tokens", "code", "rank_reason", "patterns", "matches", "symbol", "hash"]


def to_slices(rows: list, origin: str) -> list[P.Slice]:
    return [
        P.Slice(r["file"], int(r["line_start"]), int(r["line_end"]), float(r["score"]), int(r["tokens"]), r["code"], list(r["rank_reason"]), list(r["patterns"]), int(r["matches"]), r["symbol"], r["hash"], origin)
        for r in rows
    ]


def focused_read(
    spark: SparkSession, source: DataFrame | str, pattern: str, options: Q.Options | None = None, commits: DataFrame | None = None, symbols: DataFrame | None = None,
    vectors: DataFrame | None = None, asked: list[float] | None = None, **changes,
) -> Result:
    """Ranked slices of a corpus under a token budget.

    ``source`` is ``file, text`` rows or a path.  Recall, history and routing
    run for corpora with a budget; a single file gets negative evidence.
    ``commits`` (``commit_id, ts, file, changed``) and ``symbols``
    (``commit_id, symbol``) give history; without them it has no say.
    ``vectors`` (``file, lo, vector`` of the definition blocks) and the query's
    own vector ``asked`` give dense recall to vague queries, fused with BM25 by
    ``dense_weight``.  Without a budget everything that matched is returned.
    """
    options = options or Q.Options(**changes)
    query = Q.compile_query(pattern, options)
    single = False
    if isinstance(source, str):
        single = not os.path.isdir(source)
        source = T.scan_tree(spark, source)
    corpus = S.with_lines(source)
    chunks = C.reranked(lexical_chunks(corpus, query), query).persist()
    try:
        ranked = chunks.orderBy(F.desc("score"), "file", "line_start").select(*FIELDS)
        head = to_slices((ranked.limit(CANDIDATE_LIMIT) if options.budget > 0 else ranked).collect(), "lexical")
        matched = chunks.select("file").distinct().count()
        beyond = []
        if options.budget > 0 and len(head) == CANDIDATE_LIMIT:
            beyond = ranked.select("file", "line_start", "line_end", "tokens", "score", "rank_reason").offset(CANDIDATE_LIMIT).collect()
        searched = max(1, source.count()) if not single else 1
    finally:
        chunks.unpersist()
        discard(chunks)
    recalled: list[P.Slice] = []
    file_scores = None
    if not single and options.semantic and options.budget > 0:
        dense = vectors if query.vague and asked is not None else None
        rows = R.recall(corpus, query, dense, asked).orderBy(F.desc("score"), "file", "line_start").collect()  # at most the recall limit
        for r in rows:
            recalled.append(P.Slice(r["file"], r["line_start"], r["line_end"], r["score"], r["tokens"], r["code"], ["semantic-recall"], hash="", origin="recall"))
        if commits is not None and options.history != "off" and (head or recalled):
            if symbols is not None and options.history == "full":
                recalled += _history_expansion(corpus, symbols, head, recalled)
            file_scores = _history_scores(spark, commits, [*head, *recalled], options.history)
    before = [*head, *recalled]
    if query.vague and recalled:
        packing = P.pack_vague(head, recalled, options.budget, options.objective)
    elif recalled and options.budget > 0:
        packing = P.pack_hybrid(head, recalled, options.budget, options.objective, file_scores)
    else:
        packing = P.pack(before, options.budget, options.objective)
    left = P.omissions(before, packing)
    left += [P.Omission(r["file"], int(r["line_start"]), int(r["line_end"]), int(r["tokens"]), float(r["score"]), list(r["rank_reason"]), "budget") for r in beyond]
    left.sort(key=lambda o: -o.score)
    negatives = negative_evidence(corpus, query.patterns, packing.kept) if single else []
    dropped = max(0, len(head) - len(packing.kept)) if single and options.budget else 0
    return Result(query.patterns, packing.kept, left, negatives, searched, matched, options.budget, dropped)


def _history_scores(spark: SparkSession, commits: DataFrame, slices: list[P.Slice], mode: str) -> dict[str, float]:
    sums: dict[str, float] = {}
    for c in slices:
        sums[c.file] = sums.get(c.file, 0.0) + c.score
    scores = spark.createDataFrame(sorted(sums.items()), "file string, s double")  # files of one query's candidates
    none = spark.createDataFrame([], "file string, w double, c double")
    churned = H.churn(commits) if mode != "cochange-only" else none.select("file", "w")
    changed = H.cochange_scores(commits, H.softmax_anchors(scores)) if mode != "churn-only" else none.select("file", "c")
    fused = H.fused_files(scores, churned.join(F.broadcast(scores.select("file")), "file", "left_semi"), changed.join(F.broadcast(scores.select("file")), "file", "left_semi"))
    return {r["file"]: r["s"] for r in fused.collect()}


def _history_expansion(corpus: DataFrame, symbols: DataFrame, head: list[P.Slice], recalled: list[P.Slice]) -> list[P.Slice]:
    """Boosts slices that define a coupled symbol, in place, and finds windows for the four most coupled."""
    spark = corpus.sparkSession
    defines = re.compile(fixed.DEFINITION_LINE)

    def symbol(line: str) -> str | None:
        m = re.search(fixed.SYMBOL_AFTER_KEYWORD, line) or re.search(fixed.SYMBOL_CALLED, line)
        return m.group(1) if m else None

    anchors = dict.fromkeys(s for c in head[:5] for line in c.code.splitlines() if defines.match(line) and (s := symbol(line)) and len(s) >= 4)
    if not anchors:
        return []
    coupled = H.symbol_expansions(symbols, spark.createDataFrame([(a,) for a in anchors], "anchor string"))
    lift = {r["symbol"]: r["w"] for r in coupled.collect()}
    for c in [*head, *recalled]:
        first = c.code.split("\n", 1)[0]
        weight = lift.get(symbol(first) or "") if defines.match(first) else None
        if weight:
            c.score += round(8 * weight)
            c.rank_reason.append("region-history")
    best = sorted(lift.items(), key=lambda kv: (-kv[1], kv[0]))[:4]
    if not best:
        return []
    known = {(c.file, c.line_start) for c in [*head, *recalled]}
    found = definition_windows(corpus, [s for s, _ in best]).collect()  # one row for each symbol
    weights = dict(best)
    return [
        P.Slice(r["file"], r["line_start"], r["line_end"], 12 + int(14 * weights[r["symbol"]]), r["tokens"], r["code"], ["history-expansion"], symbol=r["symbol"], origin="recall")
        for r in found
        if (r["file"], r["line_start"]) not in known
    ]


def definition_windows(corpus: DataFrame, symbols: list[str], size: int = 30) -> DataFrame:
    """``symbol, file, line_start, line_end, code, tokens``: lines from each symbol's first definition."""
    wanted = "|".join(re.escape(s) for s in symbols)
    pattern = rf"^\s*(?:async\s+)?(?:def|class|fn|func|function)\s+({wanted})"
    lines = S.exploded(corpus).withColumn("symbol", F.regexp_extract("line", pattern, 1)).where("symbol <> ''")
    first = lines.groupBy("symbol").agg(F.min(F.struct("file", "line_no")).alias("at")).select("symbol", "at.file", F.col("at.line_no").alias("lo"))
    rows = corpus.join(F.broadcast(first), "file").withColumn("hi", F.least(F.size("lines"), F.col("lo") + size))
    code = S.as_text(S.code_of(F.col("lines"), F.col("lo"), F.col("hi")))
    return rows.select("symbol", "file", (F.col("lo") + 1).alias("line_start"), F.col("hi").alias("line_end"), code.alias("code")).withColumn("tokens", X.estimated_tokens(F.col("code")))


def negative_evidence(corpus: DataFrame, patterns: list[str], kept: list[P.Slice]) -> list[str]:
    """What was not found: definitions of slices' symbols, and patterns, in the whole corpus or only in the slices."""
    out = []
    for name in dict.fromkeys(c.symbol for c in kept if c.symbol):
        lines = [line for c in kept if c.symbol == name for line in c.code.splitlines()]
        if not any(name in line and any(k in line for k in fixed.DEFINING_SUBSTRINGS) for line in lines):
            out.append(f"No definition found for '{name}'")
    whole = F.array_join("lines", "\n")
    row = corpus.agg(*(F.max(Q.matches(whole, p)).alias(f"p{i}") for i, p in enumerate(patterns))).first() if patterns else []
    for p, anywhere in zip(patterns, row, strict=True):
        rx = re.compile(Q.portable(p), re.IGNORECASE)
        if any(rx.search(c.code) for c in kept):
            continue
        out.append(f"Pattern '{p}' is there, but outside the slices returned" if anywhere else f"Pattern '{p}' not found")
    return out
