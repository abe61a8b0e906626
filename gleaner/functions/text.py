"""Text expressions over columns.  No UDFs; regular expressions are the JVM's."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from gleaner.functions import fixed

LINE_BREAK = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x85\u2028\u2029]"


def _words(items: list[str]) -> str:
    return "(?:" + "|".join(re.escape(i) for i in items) + ")"


def lines_of(text: Column) -> Column:
    """Lines without their ends; no line after a final line end, and none for an empty or null text."""
    parts = F.split(F.coalesce(text, F.lit("")), LINE_BREAK, -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def estimated_tokens(text: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4)).cast("bigint")


def content_hash(text: Column) -> Column:
    return F.substring(F.md5(text.cast("binary")), 1, 8)


def is_definition(line: Column) -> Column:
    return line.rlike(fixed.DEFINITION_LINE)


def basename(path: Column) -> Column:
    return F.element_at(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), -1)


def is_test_path(path: Column) -> Column:
    low = F.lower(F.replace(path, F.lit("\\"), F.lit("/")))
    return basename(low).contains("test") | low.contains("/tests/") | low.startswith("tests/")


def is_vendored(path: Column) -> Column:
    return F.lower(path).rlike(_words(fixed.VENDORED_SUBSTRINGS))


def is_comment(line: Column) -> Column:
    return F.ltrim(line).rlike("^(?://|/\\*|\\*|#|--)")


def language(path: Column) -> Column:
    suffix = F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))
    return F.when(suffix.isin(*fixed.PYTHON_EXTENSIONS), "python").when(suffix.isin(*fixed.C_LIKE_EXTENSIONS), "c_like").otherwise("brace")


def symbol_of(line: Column) -> Column:
    """The name after the first keyword, else the first that is called, else null."""
    named = F.regexp_extract(line, fixed.SYMBOL_AFTER_KEYWORD, 1)
    called = F.regexp_extract(line, fixed.SYMBOL_CALLED, 1)
    return F.coalesce(F.when(named != "", named), F.when(called != "", called))


def indent_of(line: Column) -> Column:
    return F.length(line) - F.length(F.ltrim(line))


def stem(token: Column) -> Column:
    out = token
    for suffix in reversed(fixed.STEM_SUFFIXES):
        out = F.when(
            token.endswith(suffix) & (F.length(token) - len(suffix) >= 4), F.substring(token, F.lit(1), F.length(token) - len(suffix))
        ).otherwise(out)
    return out


def sem_tokens(text: Column) -> Column:
    """Stemmed sub-words of snake_case and camelCase words; a word of two or more also whole."""

    def of_word(word: Column) -> Column:
        parts = F.flatten(F.transform(F.split(word, "_"), lambda p: F.split(p, "(?<=[a-z0-9])(?=[A-Z])")))
        kept = F.filter(F.transform(parts, F.lower), lambda p: F.length(p) >= 3)
        stems = F.transform(kept, stem)
        return F.when(F.size(kept) > 1, F.concat(stems, F.array(F.lower(word)))).otherwise(stems)

    return F.flatten(F.transform(F.regexp_extract_all(text, F.lit("[A-Za-z0-9_]{3,}"), F.lit(0)), of_word))


def exact_tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9_]{3,}"), F.lit(0))


def rare_terms(line: Column) -> Column:
    """Words of five or more characters with an underscore that are not common."""
    words = F.regexp_extract_all(line, F.lit(r"(?U)\w+"), F.lit(0))
    return F.filter(words, lambda w: (F.length(w) >= 5) & w.contains("_") & ~F.lower(w).isin(*sorted(set(fixed.COMMON_TERMS))))


def line_set(lines: Column) -> Column:
    """Distinct stripped lines that are not blank."""
    return F.array_distinct(F.filter(F.transform(lines, lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != ""))


def jaccard(a: Column, b: Column) -> Column:
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(both / (F.size(a) + F.size(b) - both))


def relative_path(path: Column, root: str) -> Column:
    clean = F.replace(path, F.lit("\\"), F.lit("/"))
    head = root.replace("\\", "/").rstrip("/") + "/"
    return F.when(clean.startswith(head), F.substring(clean, len(head) + 1, 1 << 30)).otherwise(clean)


def safe_name(name: Column) -> Column:
    clean = F.substring(F.regexp_replace(F.coalesce(name, F.lit("")), "[^A-Za-z0-9_-]", ""), 1, 64)
    return F.when(clean == "", F.lit("nosession")).otherwise(clean)


def idf_smooth(n: Column, df: Column) -> Column:
    return F.log(1 + n / (1 + df))


def idf_bm25(n: Column, df: Column) -> Column:
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


def idf_plain(n: Column, df: Column) -> Column:
    return F.log(n / (1 + df))


def cosine(a: Column, b: Column) -> Column:
    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)

    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return dot(a, b) / F.when(norm == 0, F.lit(1.0)).otherwise(norm)
