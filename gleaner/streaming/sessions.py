"""Session state: first requests, focus terms, and the read-replacement adapter."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleaner.functions import fixed
from gleaner.functions import text as X
from gleaner.operators import pack as P
from gleaner.plans import query as Q
from gleaner.plans.api import Result, focused_read

MIN_TOKENS, MAX_BYTES, START_BUDGET, MOST_BUDGET, ENOUGH = 2000, 5_000_000, 1200, 4000, 0.55


def path_key(path: Column) -> Column:
    return F.lower(F.replace(path, F.lit("\\"), F.lit("/")))


def first_seen(requests: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Adds ``intercepted``: whether a row is the first of its keys; ties in ``order`` are all first by the smaller row hash."""
    first = requests.groupBy(*keys).agg(F.min(order).alias("__first"))
    return requests.join(first, keys).withColumn("intercepted", F.col(order) == F.col("__first")).drop("__first")


def first_seen_stream(requests: DataFrame, keys: list[str], event_time: str, keep: str = "1 hour") -> DataFrame:
    """The first request of each key in a stream; the state of a key goes ``keep`` after it was last in time."""
    return requests.withWatermark(event_time, keep).dropDuplicatesWithinWatermark(keys)


def event_windows(events: DataFrame, size: str = "1 day", slide: str | None = None, late: str | None = None) -> DataFrame:
    """``start, event_type, n, total`` in tumbling or sliding windows; ``late`` sets a watermark for streams."""
    rows = events.withWatermark("ts", late) if late else events
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    return rows.groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def session_windows(events: DataFrame, gap: str = "30 minutes", late: str | None = None) -> DataFrame:
    rows = events.withWatermark("ts", late) if late else events
    return rows.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def focus_terms(messages: DataFrame, newest: int = 6, limit: int = 8) -> DataFrame:
    """``session, term, weight``: what the newest messages of each session are about.

    ``messages`` is ``session, turn, role, text``; only user and assistant
    messages with text count.  A word weighs 3 (user) or 1, over its message's
    place from the end, and twice that if it looks like an identifier.
    """
    order = Window.partitionBy("session").orderBy(F.desc("turn"))
    rows = messages.where(F.col("role").isin("user", "assistant") & (F.coalesce("text", F.lit("")) != ""))
    rows = rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= newest)
    words = F.regexp_extract_all(F.substring("text", 1, 4000), F.lit("[A-Za-z_][A-Za-z0-9_]{3,}"), F.lit(0))
    terms = rows.select("session", "place", "role", F.explode(words).alias("term")).where(~F.lower("term").isin(*fixed.FOCUS_STOP))
    shaped = F.when(F.col("term").contains("_") | (F.col("term") != F.lower("term")), 2.0).otherwise(1.0)
    weight = F.when(F.col("role") == "user", 3.0).otherwise(1.0) / F.col("place") * shaped
    scored = terms.groupBy("session", "term").agg(F.sum(weight).alias("weight"))
    best = Window.partitionBy("session").orderBy(F.desc(F.round("weight", 9)), "term")
    return scored.withColumn("r", F.row_number().over(best)).where(F.col("r") <= limit).select("session", "term", "weight")


FOCUS_STATE = "recent array<string>"


def focus_stream(messages: DataFrame) -> DataFrame:
    """The same for a stream: each session keeps its newest six messages as state, and emits its terms on new ones."""

    def update(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        recent = list(state.get[0]) if state.exists else []
        for batch in batches:
            for row in batch.sort_values("turn").itertuples():
                if row.role in ("user", "assistant") and row.text:
                    recent.append(json.dumps([row.role, row.text[:4000]]))
        recent = recent[-6:]
        state.update((recent,))
        weights: dict[str, float] = {}
        stop = set(fixed.FOCUS_STOP)
        for place, (role, text) in enumerate(map(json.loads, reversed(recent)), 1):
            for word in re.findall(r"[A-Za-z_][A-Za-z0-9_]{3,}", text):
                if word.lower() not in stop:
                    shaped = 2.0 if "_" in word or word != word.lower() else 1.0
                    weights[word] = weights.get(word, 0.0) + (3.0 if role == "user" else 1.0) / place * shaped
        best = sorted(weights.items(), key=lambda kv: (-round(kv[1], 9), kv[0]))[:8]
        yield pd.DataFrame([(key[0], t, w) for t, w in best], columns=["session", "term", "weight"])

    return messages.groupBy("session").applyInPandasWithState(update, "session bigint, term string, weight double", FOCUS_STATE, "update", "NoTimeout")


def intercepts(requests: DataFrame) -> DataFrame:
    """Requests (``tool_name, path, offset, limit, size, chars``) whose reads would be replaced."""
    suffix = F.lower(F.regexp_extract("path", r"(\.[^./\\]+)$", 1))
    return requests.where(
        (F.col("tool_name") == "Read") & F.col("offset").isNull() & F.col("limit").isNull() & suffix.isin(*fixed.CODE_SUFFIXES)
        & (F.floor(F.col("size") / 4) >= MIN_TOKENS) & (F.col("size") <= MAX_BYTES) & (F.floor(F.col("chars") / 4) >= MIN_TOKENS)
    )


def file_map(text: str, most: int = 60) -> str:
    wanted, out = re.compile(fixed.MAP_LINE), []
    for number, line in enumerate(text.splitlines(), 1):
        if len(line) <= 200 and wanted.match(line):
            body = line.rstrip()
            out.append(f"{number:6d}  {body if len(body) <= 110 else body[:110] + ' ...'}")
            if len(out) >= most:
                out.append("       ... (definition list truncated)")
                break
    return "\n".join(out)


def escalated(spark: SparkSession, source, terms: list[str], start: int = START_BUDGET, most: int = MOST_BUDGET, enough: float = ENOUGH) -> tuple[Result, int, int]:
    """Slices for the terms, doubling the budget while too little of what matched is shown: result, budget, raises."""
    pattern, budget, raised = "|".join(map(re.escape, terms)), start, 0
    while True:
        result = focused_read(spark, source, pattern, Q.Options(budget=budget, boundary="fn"))
        if result.coverage >= enough or budget >= most or not result.omitted:
            return result, budget, raised
        budget, raised = min(most, 2 * budget), raised + 1


def replacement(spark: SparkSession, path: str, text: str, terms: list[str]) -> str | None:
    """What a large read is replaced with, or None if there is nothing of use (the read then goes through)."""
    try:
        result, budget, raised = escalated(spark, path, terms)
    except Exception:
        return None
    shown = file_map(text)
    if not result.chunks and not shown:
        return None
    parts = [f"Read of {path} ({text.count(chr(10)) + 1} lines) replaced by a map and slices (~{budget} tokens" + (f", raised {raised}x" if raised else "") + ")."]
    if shown:
        parts += ["", "FILE MAP", shown]
    if result.chunks:
        parts += ["", f"SLICES for {', '.join(terms[:5])}:", result.render()]
    if result.omitted:
        parts += ["", f"STILL NOT SHOWN ({result.coverage:.0%} of matched material above):", *still_hidden(result.omitted)]
    return "\n".join([*parts, "", "Read the file again for all of it, or a range with offset and limit."])


def still_hidden(omitted: list[P.Omission], most: int = 6) -> list[str]:
    out = [f"  offset={o.line_start} limit={o.line_end - o.line_start + 1}   (~{o.tokens} tok, score={o.score})" for o in omitted[:most]]
    return out + ([f"  ... and {len(omitted) - most} more region(s)"] if len(omitted) > most else [])
