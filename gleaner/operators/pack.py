"""Packing under a token budget, and the account of what was left out.

Candidates of one query are bounded (a few hundred), and choices depend on the
ones before, so a query packs in plain Python: on the driver for one query, in
``applyInPandas`` by query for many.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleaner.functions import fixed
from gleaner.functions import text as X


@dataclass
class Slice:
    file: str
    line_start: int
    line_end: int
    score: float
    tokens: int
    code: str = ""
    rank_reason: list[str] = field(default_factory=list)
    patterns: list[str] = field(default_factory=list)
    matches: int = 0
    symbol: str | None = None
    hash: str = ""
    origin: str = "lexical"


@dataclass
class Omission:
    file: str
    line_start: int
    line_end: int
    tokens: int
    score: float
    reason: list[str]
    why: str


def is_test(file: str) -> bool:
    low = file.replace("\\", "/").lower()
    return "test" in low.rsplit("/", 1)[-1] or "/tests/" in low or low.startswith("tests/")


def overlaps(a: Slice, chosen: list[Slice]) -> bool:
    return any(a.file == b.file and a.line_start <= b.line_end and b.line_start <= a.line_end for b in chosen)


def reserved(chunks: list[Slice], objective: str) -> list[Slice]:
    """Slots kept for a definition, a use in another file and a test, as the objective wants; first in rank wins."""
    if objective == "single" or not chunks:
        return []
    defining = [c for c in chunks if "definition" in c.rank_reason]
    slots = [c for c in defining if not is_test(c.file)][:1] or defining[:1]
    home = slots[0].file if slots else chunks[0].file
    wanted = []
    if objective in ("auto", "def+caller"):
        wanted.append(lambda c: c.file != home and not is_test(c.file))
    if objective in ("auto", "def+test"):
        wanted.append(lambda c: is_test(c.file))
    for fits in wanted:
        slots += [c for c in chunks if fits(c) and not any(c is s for s in slots)][:1]
    return slots


def by_score(chunks: list[Slice]) -> list[Slice]:
    return sorted(chunks, key=lambda c: -c.score)


def truncated(chunk: Slice, budget: int) -> tuple[Slice, Omission | None]:
    """The chunk cut to the budget (200 characters at least) and what the cut lost."""
    code = chunk.code[: max(200, 4 * budget)]
    shown = code.count("\n") + 1
    marked = code + "\n... (truncated to budget)"
    cut = replace(chunk, code=marked, tokens=max(1, len(marked) // 4))
    lost = chunk.line_start + shown
    if lost > chunk.line_end:
        return cut, None
    cut.line_end = lost - 1
    return cut, Omission(chunk.file, lost, chunk.line_end, max(0, chunk.tokens - cut.tokens), chunk.score, list(chunk.rank_reason), "truncated")


class Packing:
    """What a packer returns: kept slices by score, and where a kept slice was cut."""

    def __init__(self, kept: list[Slice], cuts: list[Omission] | None = None, replaced: list[Slice] | None = None):
        self.kept, self.cuts, self.replaced = kept, cuts or [], replaced or []


def pack(chunks: list[Slice], budget: int, objective: str = "auto") -> Packing:
    """Reserved slots, then the best by score less a penalty for files taken already.

    Candidates stand in one queue for each file, since only a file's count
    changes what its chunks are worth.
    """
    if budget <= 0 or not chunks:
        return Packing(list(chunks))
    kept: list[Slice] = []
    room = budget
    for c in reserved(chunks, objective):
        if c.tokens <= room:
            kept.append(c)
            room -= c.tokens
    taken: dict[str, int] = {}
    for c in kept:
        taken[c.file] = taken.get(c.file, 0) + 1
    waiting: dict[str, list[tuple[float, int, Slice]]] = {}
    for place, c in enumerate(chunks):
        if not any(c is k for k in kept):
            waiting.setdefault(c.file, []).append((-c.score, place, c))
    for queue in waiting.values():
        queue.sort(key=lambda e: e[:2])
    while True:
        best = None
        for file, queue in waiting.items():
            while queue and queue[0][2].tokens > room:
                queue.pop(0)  # room only shrinks
            if queue:
                worth = (queue[0][0] + fixed.SAME_FILE_PENALTY * taken.get(file, 0), queue[0][1], file)
                best = min(best, worth) if best else worth
        if best is None:
            break
        c = waiting[best[2]].pop(0)[2]
        kept.append(c)
        taken[c.file] = taken.get(c.file, 0) + 1
        room -= c.tokens
    if kept:
        return Packing(by_score(kept))
    cut, lost = truncated(chunks[0], budget)
    return Packing([cut], [lost] if lost else [], [chunks[0]])


def _fill(chosen: list[Slice], more: list[Slice], budget: int) -> None:
    used = sum(c.tokens for c in chosen)
    for c in more:
        if used + c.tokens <= budget and not any(c is k for k in chosen) and not overlaps(c, chosen):
            chosen.append(c)
            used += c.tokens


def pack_vague(lexical: list[Slice], recalled: list[Slice], budget: int, objective: str = "auto") -> Packing:
    first = pack(lexical, max(1, int(budget * fixed.VAGUE_SHARE)), objective)
    chosen = list(first.kept)
    _fill(chosen, by_score(recalled), budget)
    return Packing(by_score(chosen), first.cuts, first.replaced)


def pack_hybrid(lexical: list[Slice], recalled: list[Slice], budget: int, objective: str = "auto", file_scores: dict[str, float] | None = None) -> Packing:
    """A dominant file first, then lexical slices on a share of the rest, then recall; nothing overlaps.

    ``file_scores`` replaces the sums of slice scores, where history has a say.
    """
    if not recalled:
        return pack(lexical, budget, objective)
    if not lexical:
        return pack(recalled, budget, "single")
    if file_scores is None:
        file_scores = {}
        for c in [*lexical, *recalled]:
            file_scores[c.file] = file_scores.get(c.file, 0.0) + c.score
    ranked = sorted(file_scores.values(), reverse=True)
    chosen: list[Slice] = []
    if len(ranked) == 1 or ranked[0] >= fixed.DOMINANCE * ranked[1]:
        home = max(file_scores, key=file_scores.__getitem__)
        _fill(chosen, by_score([c for c in [*lexical, *recalled] if c.file == home]), int(budget * fixed.DOMINANT_SHARE))
    used = sum(c.tokens for c in chosen)
    rest = [c for c in lexical if not any(c is k for k in chosen)]
    part = pack(rest, max(1, int((budget - used) * fixed.LEXICAL_SHARE)), objective)
    _fill(chosen, part.kept, budget)
    _fill(chosen, by_score(recalled), budget)
    cuts = part.cuts if any(c is k for k in part.kept for c in chosen) else []
    return Packing(by_score(chosen), cuts, part.replaced)


def omissions(before: list[Slice], packing: Packing) -> list[Omission]:
    """Candidates that were not kept, and the lost ends of those that were cut, best first."""
    held = [*packing.kept, *(packing.replaced if packing.cuts or packing.replaced else [])]
    left = [
        Omission(c.file, c.line_start, c.line_end, c.tokens, c.score, list(c.rank_reason), "budget") for c in before if not any(c is k for k in held)
    ]
    return sorted([*packing.cuts, *left], key=lambda o: -o.score)


def coverage(kept: list[Slice], left: list[Omission]) -> float:
    shown, lost = sum(c.tokens for c in kept), sum(o.tokens for o in left)
    return shown / (shown + lost) if shown + lost else 1.0


PACKED = "query_id string, file string, line_start int, line_end int, score double, tokens bigint, why string"


def pack_queries(candidates: DataFrame, budget: int, objective: str = "auto", vague: bool = False) -> DataFrame:
    """Packs many queries: ``query_id, file, line_start, line_end, score, tokens, why`` (kept, budget or truncated).

    ``candidates`` has ``query_id, origin, file, line_start, line_end, score,
    tokens, code, rank_reason``; a query's candidates are bounded by the rerank
    head and the recall limit, so a group fits a task.
    """

    def one(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["score", "file", "line_start"], ascending=[False, True, True], kind="stable")
        slices = [
            Slice(r.file, int(r.line_start), int(r.line_end), float(r.score), int(r.tokens), r.code, list(r.rank_reason), origin=r.origin)
            for r in frame.itertuples()
        ]
        lexical, recalled = [s for s in slices if s.origin == "lexical"], [s for s in slices if s.origin != "lexical"]
        packing = (pack_vague if vague else pack_hybrid)(lexical, recalled, budget, objective)
        rows = [(c.file, c.line_start, c.line_end, c.score, c.tokens, "kept") for c in packing.kept]
        rows += [(o.file, o.line_start, o.line_end, o.score, o.tokens, o.why) for o in omissions(slices, packing)]
        out = pd.DataFrame(rows, columns=["file", "line_start", "line_end", "score", "tokens", "why"])
        out.insert(0, "query_id", frame["query_id"].iloc[0])
        return out

    return candidates.groupBy("query_id").applyInPandas(one, PACKED)


def running_cap(rows: DataFrame, budget: int, partition: list[str], order: list) -> DataFrame:
    """Rows in order until the budget is crossed; the crossing row stays."""
    w = Window.partitionBy(*partition).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("__sum", F.sum("tokens").over(w)).where(F.col("__sum") - F.col("tokens") < budget).drop("__sum")


def without_overlaps(candidates: DataFrame, chosen: DataFrame) -> DataFrame:
    """Candidates that touch no chosen range of their file (closed ranges)."""
    c = chosen.select(F.col("file").alias("__f"), F.col("line_start").alias("__lo"), F.col("line_end").alias("__hi"))
    return candidates.join(c, (F.col("file") == F.col("__f")) & (F.col("line_start") <= F.col("__hi")) & (F.col("__lo") <= F.col("line_end")), "left_anti")


def reserved_slots(chunks: DataFrame, objective: str = "auto") -> DataFrame:
    """``query_id, slot, file, line_start``: the reserved slots of many queries, as aggregates (``chunks`` has ``query_id``)."""
    rank = F.struct((-F.col("score")).alias("o"), F.col("file"), F.col("line_start"))
    defining, test = F.array_contains("rank_reason", "definition"), X.is_test_path(F.col("file"))
    first = chunks.groupBy("query_id").agg(
        F.coalesce(F.min(F.when(defining & ~test, rank)), F.min(F.when(defining, rank))).alias("definition"), F.min(rank).alias("top")
    )
    parts = [first.where("definition is not null").select("query_id", F.lit("definition").alias("slot"), "definition.file", "definition.line_start")]
    rest = chunks.join(F.broadcast(first), "query_id").where(~F.coalesce((F.col("file") == F.col("definition.file")) & (F.col("line_start") == F.col("definition.line_start")), F.lit(False)))
    home = F.coalesce(F.col("definition.file"), F.col("top.file"))
    if objective in ("auto", "def+caller"):
        caller = rest.where((F.col("file") != home) & ~test).groupBy("query_id").agg(F.min(rank).alias("r"))
        parts.append(caller.select("query_id", F.lit("caller").alias("slot"), "r.file", "r.line_start"))
    if objective in ("auto", "def+test"):
        tests = rest.where(test).groupBy("query_id").agg(F.min(rank).alias("r"))
        parts.append(tests.select("query_id", F.lit("test").alias("slot"), "r.file", "r.line_start"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out if objective != "single" else out.limit(0)
