"""Secret scans: known forms, and high entropy in a sliding window.

Everything is a column expression.  Known forms come from regular expressions;
their places follow from what lies between matches.  Other candidates are runs
of a character class (hex digits, or the base64 alphabet) that mix letters and
digits.  Over each candidate a window of ``WINDOW`` characters slides; the
state holds a count for each character of the class (packed, a few bits each)
and the sum of c*log2(c), and entering and leaving characters change one count
each.  The windows whose Shannon entropy reaches the class's threshold make one
span.  Known forms and the delimited parts that hold an allow-listed word are
blanked out before, so what stands beside them is judged by itself; candidates
that an allow-list entry fits as a whole are suppressed.

Work is linear in the text: whatever a lambda uses is bound once, texts are cut
by blocks, running sums and maxima go by blocks, and no pattern repeats a group
in a way that recurses.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import bound, exclusive_prefix_sums, exclusive_scan, text_of

WINDOW = 20

# Known forms, in the order that breaks ties (fixed values).
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
ASSIGN_LEAST = 6
KNOWN = f"(?:{ASSIGN[:-2]}{{{ASSIGN_LEAST},}}))|{ACCESS}|{HEX}"

# Entropy classes: name, candidate pattern, threshold in bits; and all characters that candidates have.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-="
CLASSES = (
    ("enthex", r"(?<![A-Za-z0-9+/_-])(?=[0-9A-Fa-f]*[0-9])(?=[0-9A-Fa-f]*[A-Fa-f])[0-9A-Fa-f]{20,}(?![A-Za-z0-9+/_-])", 3.0),
    (
        "entb64",
        r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z0-9+/_-]*[0-9])(?=[A-Za-z0-9+/_-]*[A-Z])(?=[A-Za-z0-9+/_-]*[a-z])[A-Za-z0-9+/_-]{20,}={0,2}",
        3.6,
    ),
    ("entlow", r"(?<![A-Za-z0-9+])(?=[a-z]*[0-9])(?=[0-9]*[a-z])(?![0-9a-f]+(?![A-Za-z0-9+]))[a-z0-9]{20,}(?![A-Za-z0-9+])", 3.6),
    ("entup", r"(?<![A-Za-z0-9+])(?=[A-Z]*[0-9])(?=[0-9]*[A-Z])(?![0-9A-F]+(?![A-Za-z0-9+]))[A-Z0-9]{20,}(?![A-Za-z0-9+])", 3.6),
)

# Words that only look like secrets: they clear the part (between / _ -) that holds them, with a delimiter on either side.
ALLOWED_PART = r"[/_-]?(?<![A-Za-z0-9+=])[A-Za-z0-9+=]*?(?i:example|sample|placeholder|changeme|dummy|xxxx|123456789|abcdefgh|qwerty)[A-Za-z0-9+=]*[/_-]?"

# Candidates that only look like secrets as a whole.
ALLOW = (
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    r"^(?:[A-Za-z]++[0-9]{0,4}[/_-])++[A-Za-z]*+[0-9]{0,4}$",
)

# A text without a run as long as the window holds no candidate.
RUN = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20}"
CUT = 1024  # code points in a block of a text that is cut at given places


def _cut(text: Column, pattern: str) -> tuple[Column, Column]:
    """``pieces``, what lies between the matches, and ``matches``."""
    return F.split(text, pattern, -1).alias("pieces"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("matches")


def _spans(cut: Column) -> Column:
    """``array<struct<start, rank, stop, kind, value>>`` from what lies between matches and the matches."""
    gaps = F.zip_with(
        F.slice(cut["pieces"], 1, F.size(cut["matches"])),
        cut["matches"],
        lambda p, m: F.struct(F.length(p).alias("gap"), F.length(m).alias("size"), m.alias("value")),
    )

    def placed(gaps: Column) -> Column:
        return F.zip_with(
            gaps,
            exclusive_prefix_sums(F.transform(gaps, lambda g: g["gap"] + g["size"])),
            lambda g, at: F.struct(
                (at + g["gap"]).cast("bigint").alias("start"),
                cut["rank"].alias("rank"),
                (at + g["gap"] + g["size"]).cast("bigint").alias("stop"),
                cut["kind"].alias("kind"),
                g["value"].alias("value"),
            ),
        )

    return bound(gaps, placed)


def _found(text: Column, forms: list[tuple[int, str, str]]) -> Column:
    """Spans of the ``(rank, kind, pattern)`` given, kind by kind."""
    cuts = (
        F.when(text.rlike(pattern), F.struct(*_cut(text, pattern), F.lit(rank).alias("rank"), F.lit(kind).alias("kind")))
        for rank, kind, pattern in forms
    )
    return F.flatten(F.transform(F.filter(F.array(*cuts), lambda c: c.isNotNull()), _spans))


SPANS = "array<struct<start:bigint,rank:int,stop:bigint,kind:string,value:string>>"


def _hot_windows(value: Column, threshold: Column, window: int, alphabet: str = ALPHABET) -> Column:
    """``struct<first, last>``: the first and last window of high entropy, -1 if none.

    Counts take ``window.bit_length()`` bits each, so many to a number; a
    character that enters or leaves adds or takes one unit of one number.
    """
    most = window * (math.log2(window) - threshold) + 1e-9  # entropy >= threshold iff sum of c*log2(c) <= most
    bits = window.bit_length()
    each = 62 // bits
    numbers = -(-len(alphabet) // each)
    term = [n * math.log2(n) if n > 1 else 0.0 for n in range(window + 2)]
    gain = F.array(*(F.lit(term[n + 1] - term[n]) for n in range(window + 1)))  # of the sum, when a count goes from n to n + 1
    units = F.array(*(F.lit(1 << (bits * k)).cast("bigint") for k in range(each)))
    codes = F.filter(F.transform(F.split(value, ""), lambda c: F.instr(F.lit(alphabet), c) - 1), lambda c: c >= 0)
    chars = F.transform(
        codes,
        lambda c: F.struct(
            F.floor(c / each).cast("int").alias("number"),
            F.element_at(units, (c % each + 1).cast("int")).alias("unit"),
            (c % each * bits).cast("int").alias("shift"),
        ),
    )
    state = F.struct(
        F.array_repeat(F.lit(0).cast("bigint"), numbers).alias("counts"),
        F.lit(0.0).alias("sum"),
        F.lit(0).alias("at"),
        F.lit(-1).alias("first"),
        F.lit(-1).alias("last"),
    )

    def count(counts: Column, char: Column) -> Column:
        return F.call_function("shiftright", F.element_at(counts, char["number"] + 1), char["shift"]).bitwiseAND(F.lit((1 << bits) - 1)).cast("int")

    def changed(counts: Column, char: Column, sign: int) -> Column:
        return F.transform(counts, lambda n, i: F.when(i == char["number"], n + sign * char["unit"]).otherwise(n))

    def slide(chars: Column) -> Column:
        def left(s: Column) -> Column:
            """The state without the character that leaves."""
            out = F.element_at(chars, F.greatest(s["at"] - window + 1, F.lit(1)))
            gone = F.struct(changed(s["counts"], out, -1).alias("counts"), (s["sum"] - F.element_at(gain, count(s["counts"], out))).alias("sum"))
            return F.when(s["at"] >= window, gone).otherwise(F.struct(s["counts"].alias("counts"), s["sum"].alias("sum")))

        def step(s: Column, char: Column) -> Column:
            def entered(rest: Column) -> Column:
                total = rest["sum"] + F.element_at(gain, count(rest["counts"], char) + 1)
                hot = (s["at"] + 1 >= window) & (total <= most)
                return F.struct(
                    changed(rest["counts"], char, 1).alias("counts"),
                    total.alias("sum"),
                    (s["at"] + 1).alias("at"),
                    F.when(hot & (s["first"] < 0), s["at"] + 1 - window).otherwise(s["first"]).alias("first"),
                    F.when(hot, s["at"] + 1 - window).otherwise(s["last"]).alias("last"),
                )

            return bound(left(s), entered)

        return F.aggregate(chars, state, step, lambda s: F.struct(s["first"].alias("first"), s["last"].alias("last")))

    return bound(chars, slide)


def _entropy_spans(text: Column, first_rank: int, window: int) -> Column:
    thresholds = F.array(*(F.lit(least) for _, _, least in CLASSES))
    judged = F.transform(
        F.filter(_found(text, [(first_rank + i, kind, pattern) for i, (kind, pattern, _) in enumerate(CLASSES)]), lambda s: ~_any(s["value"], ALLOW)),
        lambda s: F.struct(s.alias("span"), _hot_windows(s["value"], F.element_at(thresholds, s["rank"] - first_rank + 1), window).alias("hot")),
    )
    return F.transform(
        F.filter(judged, lambda j: j["hot"]["first"] >= 0),
        lambda j: F.struct(
            (j["span"]["start"] + j["hot"]["first"]).alias("start"),
            j["span"]["rank"].alias("rank"),
            (j["span"]["start"] + j["hot"]["last"] + window).alias("stop"),
            j["span"]["kind"].alias("kind"),
            F.substring(j["span"]["value"], j["hot"]["first"] + 1, j["hot"]["last"] - j["hot"]["first"] + window).alias("value"),
        ),
    )


def _blanked(text: Column, pattern: str) -> Column:
    """The text with as many blanks in place of each match."""

    def joined(cut: Column) -> Column:
        blanks = F.concat(F.transform(cut["matches"], lambda m: F.repeat(F.lit(" "), F.length(m))), F.array(F.lit("")))
        return F.array_join(F.zip_with(cut["pieces"], blanks, lambda p, m: F.concat(p, m)), "")

    return F.when(text.rlike(pattern), bound(F.struct(*_cut(text, pattern)), joined)).otherwise(text)


def _any(value: Column, patterns: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for p in patterns:
        out = out | value.rlike(p)
    return out


def _outermost(spans: Column, ranks: int) -> Column:
    """``spans`` (sorted, of ``ranks`` ranks) but those inside a span of smaller rank.

    Such a span comes before in the order, so the greatest end so far, for each
    smaller rank, tells.
    """

    def ends(spans: Column) -> Column:
        """For each rank, where its spans before each span end at the latest."""
        return F.transform(
            F.sequence(F.lit(0), F.lit(ranks - 1)),
            lambda rank: exclusive_scan(
                F.transform(spans, lambda s: F.when(s["rank"] == rank, s["stop"]).otherwise(F.lit(0))), 0, lambda a, x: F.greatest(a, x)
            ),
        )

    def among(given: Column) -> Column:
        reached = lambda s, i: F.aggregate(F.slice(given["ends"], 1, s["rank"]), F.lit(0).cast("bigint"), lambda a, e: F.greatest(a, F.element_at(e, i + 1)))
        return F.filter(given["spans"], lambda s, i: reached(s, i) < s["stop"])

    return F.when(F.size(spans) > 1, bound(F.struct(spans.alias("spans"), ends(spans).alias("ends")), among)).otherwise(spans)


def scan(docs: DataFrame, text_col: str = "text", out_col: str = "secret_spans", window: int = WINDOW) -> DataFrame:
    """``docs`` with one more column: its spans by start, then kind.

    ``out_col`` is ``array<struct<start, rank, stop, kind, value>>`` in code
    points, the end exclusive; kinds are assign, access and hex (rank 0 to 2),
    then enthex, entb64, entlow and entup.  A span of high entropy inside a known
    one, or inside one of an earlier class, is not added.  A null or empty text
    has no span; rows repeat as they do in the input, and all other columns pass
    through.  ``window`` is at most 20, the least length of a candidate.  No shuffle.
    """
    text = text_of(F.col(text_col))
    found = _found(text, [(0, "assign", ASSIGN), (1, "access", ACCESS), (2, "hex", HEX)])
    base = F.filter(found, lambda s: (s["rank"] > 0) | (F.length(F.regexp_extract(s["value"], ASSIGN, 1)) >= ASSIGN_LEAST))
    named = docs.withColumn("__secret_base", base)
    named = named.withColumn("__secret_rest", F.when(text.rlike(RUN), _blanked(text, KNOWN)))
    named = named.withColumn("__secret_rest", F.when(F.col("__secret_rest").rlike(RUN), _blanked(F.col("__secret_rest"), ALLOWED_PART)))
    rest = F.col("__secret_rest")
    named = named.withColumn("__secret_more", F.when(rest.rlike(RUN), _entropy_spans(rest, 3, window)).otherwise(F.array().cast(SPANS)))
    named = named.withColumn("__secret_all", F.array_sort(F.concat("__secret_base", "__secret_more")))
    # known forms stay whatever they lie in
    added = F.filter(_outermost(F.col("__secret_all"), 3 + len(CLASSES)), lambda s: s["rank"] >= 3)
    spans = F.when(F.size("__secret_more") > 0, F.array_sort(F.concat("__secret_base", added))).otherwise(F.col("__secret_all"))
    return named.withColumn(out_col, spans).drop("__secret_base", "__secret_rest", "__secret_more", "__secret_all")


def listed(spans: Column) -> Column:
    """``kind:start:stop``, comma-joined."""
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ","
    )


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with each secret replaced by ``[REDACTED:kind]``; overlapping spans become one.

    Columns stay as they are (``n_chars``, if present, follows the new text).
    A null text stays null; a text without secrets is left alone.
    """
    found = scan(docs, text_col, "__secret_spans")
    spans, text = F.col("__secret_spans"), F.col(text_col)

    def cut_out(blocks: Column, start: Column, stop: Column) -> Column:
        """Code points from ``start`` to ``stop`` of a text in blocks."""
        first = F.floor(start / CUT).cast("int")
        held = F.slice(blocks, first + 1, F.greatest(F.ceil(stop / CUT).cast("int") - first, F.lit(0)))
        return F.substring(F.array_join(held, ""), (start - first * CUT + 1).cast("int"), (stop - start).cast("int"))

    def cleaned(given: Column) -> Column:
        # a span that starts where all before it have ended opens a new place; those before end at ``ended``
        spans, blocks = given["spans"], given["blocks"]
        both = F.zip_with(spans, given["ended"], lambda s, ended: F.struct(s.alias("span"), ended.alias("ended")))
        opened = F.filter(both, lambda z: z["span"]["start"] >= z["ended"])
        pieces = F.transform(opened, lambda z: F.concat(cut_out(blocks, z["ended"], z["span"]["start"]), F.lit("[REDACTED:"), z["span"]["kind"], F.lit("]")))
        end = F.aggregate(spans, F.lit(0).cast("bigint"), lambda a, s: F.greatest(a, s["stop"]))
        return F.concat(F.array_join(pieces, ""), bound(end, lambda e: cut_out(blocks, e, given["size"])))

    given = F.struct(
        spans.alias("spans"),
        F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CUT}}}"), F.lit(0)).alias("blocks"),
        exclusive_scan(F.transform(spans, lambda s: s["stop"]), 0, lambda a, x: F.greatest(a, x)).alias("ended"),
        F.length(text).cast("bigint").alias("size"),
    )
    clean = F.when(F.size(spans) > 0, bound(given, cleaned)).otherwise(text)
    out = found.withColumn(text_col, clean)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(F.size(spans) > 0, F.length(text_col)).otherwise(F.col("n_chars")).cast(kind))
    return out.select(*docs.columns)


def count_kind(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("bigint")


def digest(docs: DataFrame) -> DataFrame:
    """The query's columns: counts of the known forms, the digest of their list, and all spans."""
    spans = F.col("secret_spans")
    base = F.filter(spans, lambda s: s["rank"] < 3)
    return scan(docs.select("doc_id", "text")).select(
        "doc_id",
        count_kind(spans, "assign").alias("n_assign"),
        count_kind(spans, "access").alias("n_access"),
        count_kind(spans, "hex").alias("n_hex"),
        F.sha2(listed(base), 256).alias("base_sha256"),
        listed(spans).alias("spans"),
    )
