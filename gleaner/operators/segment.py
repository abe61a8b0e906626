"""Lines to regions.  A file's lines stay one array, so segmentation needs no shuffle."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions import fixed
from gleaner.functions import text as X
from gleaner.plans import query as Q


def with_lines(corpus: DataFrame) -> DataFrame:
    """``file, lines`` of ``file, text``."""
    return corpus.select("file", X.lines_of(F.col("text")).alias("lines"))


def exploded(corpus: DataFrame) -> DataFrame:
    """``file, line_no, line``; numbers from 0."""
    return corpus.select("file", F.posexplode("lines").alias("line_no", "line"))


def with_hits(corpus: DataFrame, patterns: list[str]) -> DataFrame:
    """Adds ``hits array<struct<no, found array<int>>>``: matching lines and the numbers of the patterns found.

    Lines of more than 5,000 characters, their end counted, are not searched.
    """

    def hit(line: Column, no: Column) -> Column:
        found = F.array(*(F.when(Q.matches(line, p), F.lit(i)) for i, p in enumerate(patterns)))
        return F.struct(no.cast("int").alias("no"), F.filter(found, lambda f: f.isNotNull()).alias("found"))

    hits = F.transform("lines", lambda line, no: F.when((F.length(line) + 1 <= fixed.MAX_LINE_CHARS), hit(line, no)))
    return corpus.withColumn("hits", F.filter(hits, lambda h: h.isNotNull() & (F.size(h["found"]) > 0)))


def _runs(hits: DataFrame, gap: int) -> DataFrame:
    """``hits`` with ``__runs array<struct<first, last, found, targets>>``: runs of matches at most ``gap`` lines apart; files without a match go.

    Works on the row's own array: starts of runs first, then each run's slice.
    """
    starts = F.filter(
        F.sequence(F.lit(0), F.size("hits") - 1),
        lambda i: (i == 0) | (F.element_at("hits", i + 1)["no"] - F.element_at("hits", F.greatest(i, F.lit(1)))["no"] > gap),
    )
    rows = hits.where(F.size("hits") > 0).withColumn("__starts", starts)
    runs = F.transform(
        "__starts",
        lambda s, k: F.slice(
            F.col("hits"), s + 1, F.when(k + 1 < F.size("__starts"), F.element_at("__starts", F.least(k + 2, F.size("__starts")))).otherwise(F.size("hits")) - s
        ),
    )
    run = F.transform(
        runs,
        lambda r: F.struct(
            r[0]["no"].alias("first"),
            F.element_at(r, -1)["no"].alias("last"),
            F.array_distinct(F.flatten(F.transform(r, lambda h: h["found"]))).alias("found"),
            F.transform(r, lambda h: h["no"]).alias("targets"),
        ),
    )
    return rows.withColumn("__runs", run).drop("hits", "__starts")


def with_groups(hits: DataFrame, gap: int) -> DataFrame:
    """``file, first, last, found, targets`` for each run of matches."""
    rows = _runs(hits, gap)
    return rows.select(*(c for c in rows.columns if c not in ("lines", "__runs")), F.explode("__runs").alias("__g")).select("*", "__g.*").drop("__g")


def windows(hits: DataFrame, gap: int, before: int, after: int) -> DataFrame:
    """``with_groups`` with ``lo, hi`` (exclusive) and ``code_lines``: the lines around each run.

    They are cut inside the file's row, so that no run carries its whole file.
    """
    rows = _runs(hits, gap)

    def around(r: Column) -> Column:
        lo, hi = F.greatest(F.lit(0), r["first"] - before), F.least(F.size("lines"), r["last"] + after + 1)
        return F.struct(r["first"].alias("first"), r["last"].alias("last"), r["found"].alias("found"), r["targets"].alias("targets"), lo.alias("lo"), hi.alias("hi"), code_of(F.col("lines"), lo, hi).alias("code_lines"))

    return rows.select(*(c for c in rows.columns if c not in ("lines", "__runs")), F.explode(F.transform("__runs", around)).alias("__g")).select("*", "__g.*").drop("__g")


def code_of(lines: Column, lo: Column, hi: Column) -> Column:
    return F.slice(lines, lo + 1, F.greatest(hi - lo, F.lit(0)))


def as_text(lines: Column) -> Column:
    """Lines with their ends."""
    return F.array_join(F.transform(lines, lambda x: F.concat(x, F.lit("\n"))), "")


def each_span(spans: DataFrame) -> DataFrame:
    """``file, lo, hi`` of ``file, spans array<struct<lo, hi>>``."""
    return spans.select("file", F.explode("spans").alias("b")).select("file", "b.lo", "b.hi")


def sliding_spans(corpus: DataFrame, size: int = fixed.WINDOW_LINES, stride: int = fixed.WINDOW_STRIDE) -> DataFrame:
    """``file, lines, spans``: windows up to the first that reaches the end; a file stays one row."""
    n = F.size("lines")
    starts = F.filter(F.sequence(F.lit(0), n - 1, F.lit(stride)), lambda s: (s == 0) | (s - stride + size < n))
    return corpus.where(n > 0).select("file", "lines", F.transform(starts, lambda s: F.struct(s.alias("lo"), F.least(s + size, n).alias("hi"))).alias("spans"))


def sliding_windows(corpus: DataFrame, size: int = fixed.WINDOW_LINES, stride: int = fixed.WINDOW_STRIDE) -> DataFrame:
    """``file, lo, hi`` of the windows."""
    return each_span(sliding_spans(corpus, size, stride))


def definition_blocks(corpus: DataFrame) -> DataFrame:
    """``file, lo, hi`` of the blocks that begin at definition lines."""
    return each_span(definition_spans(corpus))


def definition_spans(corpus: DataFrame) -> DataFrame:
    """``file, lines, spans``: blocks that begin at definition lines of little indent.

    Blocks of more than 90 lines are cut to windows of 70 lines 60 apart, until
    90 or fewer are left; a file without definitions gets windows of 60 lines
    40 apart over its whole length.
    """
    n = F.size("lines")
    starts = F.filter(
        F.transform("lines", lambda line, i: F.when(X.is_definition(line) & (X.indent_of(line) <= 4), i)), lambda i: i.isNotNull()
    )
    marked = corpus.where(n > 0).withColumn("__starts", starts)
    begin = F.when(F.col("__starts")[0] > 0, F.concat(F.array(F.lit(0)), "__starts")).otherwise(F.col("__starts"))
    marked = marked.withColumn("__begin", F.when(F.size("__starts") > 0, begin).otherwise(F.array().cast("array<int>")))

    def cut(lo: Column, k: Column) -> Column:
        hi = F.when(k + 1 < F.size("__begin"), F.element_at("__begin", F.least(k + 2, F.size("__begin")))).otherwise(n)
        over = hi - lo - fixed.BLOCK_SPLIT_OVER
        pieces = F.greatest(F.ceil(over / fixed.BLOCK_STRIDE), F.lit(0)).cast("int")  # windows before the tail
        return F.transform(
            F.sequence(F.lit(0), pieces),
            lambda p: F.struct(
                (lo + p * fixed.BLOCK_STRIDE).alias("lo"),
                F.when(p < pieces, lo + p * fixed.BLOCK_STRIDE + fixed.BLOCK_LINES).otherwise(hi).alias("hi"),
            ),
        )

    aligned = F.flatten(F.transform("__begin", cut))
    plain = F.transform(
        F.sequence(F.lit(0), n - 1, F.lit(fixed.WINDOW_STRIDE)),
        lambda s: F.struct(s.alias("lo"), F.least(s + fixed.WINDOW_LINES, n).alias("hi")),
    )
    return marked.select("file", "lines", F.when(F.size("__begin") > 0, aligned).otherwise(plain).alias("spans"))


def _block_spans(heads: list[int], indents: list[int], skips: list[bool]) -> tuple[list[int | None], list[int | None]]:
    """Each line's header line and the header's end, in one pass; -1 marks no header, or a blank line.

    Headers above that can still be the last with a smaller indent form a stack
    of rising indents, and so do headers whose end has not come yet.
    """
    above: list[int] = []  # lines of headers
    unended: list[int] = []
    ends: dict[int, int] = {}
    owners: list[int | None] = []
    depth = -1
    for i, (head, indent, skip) in enumerate(zip(heads, indents, skips, strict=True)):
        depth = indent if indent >= 0 else depth
        while not skip and unended and indent <= heads[unended[-1]]:
            ends[unended.pop()] = i
        if head < 0:
            place = bisect_left(above, depth, key=heads.__getitem__)
            owners.append(above[place - 1] if place else None)
            continue
        while above and heads[above[-1]] >= head:
            above.pop()
        above.append(i)
        unended.append(i)
        owners.append(i)
    return owners, [None if h is None else ends.get(h, len(heads)) for h in owners]


def python_blocks(corpus: DataFrame) -> DataFrame:
    """``file, line_no, lo, hi``: each line's innermost def or class, by indent, ``hi`` exclusive; null outside any.

    An as-of search with a condition: the last header above with a smaller
    indent, and the first later line, blank and comment lines apart, that is not
    deeper than the header.  Lines are judged by column expressions; only their
    indents go through Python, once, in time linear in the file.
    """
    facts = corpus.select(
        "file",
        F.transform("lines", lambda x: F.when(x.rlike(fixed.PYTHON_HEADER), F.length(F.regexp_extract(x, fixed.PYTHON_HEADER, 1))).otherwise(-1)).alias("heads"),
        F.transform("lines", lambda x: F.when(F.trim(x) != "", X.indent_of(x)).otherwise(-1)).alias("indents"),
        F.transform("lines", lambda x: (F.trim(x) == "") | F.ltrim(x).startswith("#")).alias("skips"),
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [_block_spans(*map(list, row)) for row in zip(batch["heads"], batch["indents"], batch["skips"], strict=True)]
            yield pd.DataFrame({"file": batch["file"], "los": [f[0] for f in found], "his": [f[1] for f in found]})

    spans = facts.mapInPandas(run, "file string, los array<int>, his array<int>")
    rows = spans.select("file", F.posexplode(F.arrays_zip("los", "his")).alias("line_no", "b"))
    return rows.select("file", "line_no", F.col("b.los").alias("lo"), F.col("b.his").alias("hi"))


def enclosing_block(lines: list[str], target: int, language: str) -> tuple[int, int, int | None]:
    """``lo, hi, header line or None`` around one line; 20 lines on either side if nothing encloses it."""
    around = (max(0, target - 20), min(len(lines), target + 21), None)
    if language == "python":
        return _python_block(lines, target) or around
    opens = re.compile(fixed.C_LIKE_OPEN if language == "c_like" else r"\{")
    closes = re.compile(fixed.C_LIKE_CLOSE if language == "c_like" else r"\}")
    depth = 0
    for begin in range(target, -1, -1):
        found = len(opens.findall(lines[begin]))
        depth += len(closes.findall(lines[begin])) - found
        if found and depth <= 0:
            balance, end = 0, begin
            for j, line in enumerate(lines[begin : begin + 500], begin):
                balance += line.count("{") - line.count("}")
                if balance <= 0 and j > begin:
                    end = j
                    break
            return begin, max(min(end, target + 100), begin + 1), begin
    return around


def _python_block(lines: list[str], target: int) -> tuple[int, int, int] | None:
    header = re.compile(fixed.PYTHON_HEADER)

    def indent(s: str) -> int:
        return len(s) - len(s.lstrip())

    if header.match(lines[target]):
        begin = target
    else:
        solid = next((i for i in range(target, -1, -1) if lines[i].strip()), None)
        if solid is None:
            return None
        depth = indent(lines[solid])
        begin = next((i for i in range(target - 1, -1, -1) if (m := header.match(lines[i])) and len(m.group(1)) < depth), None)
        if begin is None:
            return None
    base = len(header.match(lines[begin]).group(1))
    later = range(begin + 1, len(lines))
    end = next((j for j in later if lines[j].strip() and not lines[j].strip().startswith("#") and indent(lines[j]) <= base), len(lines))
    return begin, end, begin


def _python_spans(lines: list[str], targets: list[int]) -> list[tuple[int, int, int | None]]:
    """``enclosing_block`` of many lines of one Python file, in one pass over it."""
    header = re.compile(fixed.PYTHON_HEADER)
    found = [header.match(x) for x in lines]
    bare = [x.strip() for x in lines]
    indents = [len(x) - len(x.lstrip()) if b else -1 for x, b in zip(lines, bare, strict=True)]
    owners, ends = _block_spans([len(m.group(1)) if m else -1 for m in found], indents, [not b or b.startswith("#") for b in bare])
    return [(owners[t], ends[t], owners[t]) if owners[t] is not None else (max(0, t - 20), min(len(lines), t + 21), None) for t in targets]


def _brace_spans(lines: list[str], targets: list[int], language: str) -> list[tuple[int, int, int | None]]:
    """``enclosing_block`` of many lines (rising) of one file with braces, in one pass over it.

    Going up from a line, the block is the first opening line that leaves no
    closing mark over: one with as many net closings before it as the line has
    up to itself, or more.  Opening lines that a later one outdoes are dropped,
    so those left fall, and the nearest that fits is found by bisection.
    """
    opens = re.compile(fixed.C_LIKE_OPEN if language == "c_like" else r"\{")
    closes = re.compile(fixed.C_LIKE_CLOSE if language == "c_like" else r"\}")
    wanted, spans = set(targets), {}
    starts: list[int] = []
    below: list[int] = []  # net closings before each of these, negated: rising
    ends: dict[int, int] = {}
    total = 0
    for i, line in enumerate(lines):
        found = len(opens.findall(line))
        if found:
            while below and below[-1] >= -total:
                starts.pop()
                below.pop()
            starts.append(i)
            below.append(-total)
        total += len(closes.findall(line)) - found
        if i in wanted:
            place = bisect_right(below, -total)
            if not place:
                spans[i] = (max(0, i - 20), min(len(lines), i + 21), None)
                continue
            begin = starts[place - 1]
            if begin not in ends:
                balance, ends[begin] = 0, begin
                for j in range(begin, min(begin + 500, len(lines))):
                    balance += lines[j].count("{") - lines[j].count("}")
                    if balance <= 0 and j > begin:
                        ends[begin] = j
                        break
            spans[i] = (begin, max(min(ends[begin], i + 100), begin + 1), begin)
    return [spans[t] for t in targets]


def enclosing_blocks(lines: list[str], targets: list[int], language: str) -> list[tuple[int, int, int | None]]:
    """``enclosing_block`` of each of the lines (rising), in time linear in the file."""
    return _python_spans(lines, targets) if language == "python" else _brace_spans(lines, targets, language)


def function_regions(hits: DataFrame, gap: int, code: bool = True) -> DataFrame:
    """``file, first, last, found, targets, lo, hi, symbol`` and, if asked for, ``code_lines``.

    A region is the union of the blocks around a run's matches; the symbol is
    the first match's.  Order-dependent scanning of one file's lines, so Arrow
    batches of Python; a file is one row until its runs are known.
    """
    source = _runs(hits, gap).select("file", "lines", "__runs", X.language(F.col("file")).alias("language"))
    names = ["file", "first", "last", "found", "targets", "lo", "hi", "header", *(["code_lines"] if code else [])]
    schema = "file string, first int, last int, found array<int>, targets array<int>, lo int, hi int, header string" + ", code_lines array<string>" * code

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows, held = [], 0
            for file, lines, runs, language in zip(batch["file"], batch["lines"], batch["__runs"], batch["language"], strict=True):
                lines, targets = list(lines), [list(r["targets"]) for r in runs]
                spans = iter(enclosing_blocks(lines, [t for ts in targets for t in ts], language))
                for r, ts in zip(runs, targets, strict=True):
                    found = [next(spans) for _ in ts]
                    lo, hi, head = min(b[0] for b in found), max(b[1] for b in found), found[0][2]
                    row = (file, r["first"], r["last"], r["found"], ts, lo, hi, lines[head] if head is not None else None)
                    rows.append((*row, lines[lo:hi]) if code else row)
                    held += 1 + code * (hi - lo)
                    if held >= 50_000:
                        yield pd.DataFrame(rows, columns=names)
                        rows, held = [], 0
            if rows:
                yield pd.DataFrame(rows, columns=names)

    return source.mapInPandas(run, schema).withColumn("symbol", X.symbol_of(F.col("header"))).drop("header")
