"""The queries again, as SQL over the same tables."""

from __future__ import annotations

from gleaner.functions import fixed
from gleaner.plans.query import query_tokens, sem_tokens

# lines(file, line_no, line, n): documents cut at line ends
LINES = """
raw AS (SELECT source || '/' || lang || '/' || doc_id || '.txt' AS file, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents),
cut AS (SELECT file, CASE WHEN parts[-1] = '' THEN parts[:-2] ELSE parts END AS parts FROM raw),
lines AS (SELECT file, unnest(parts) AS line, generate_subscripts(parts, 1) - 1 AS line_no, len(parts) AS n FROM cut)"""

# code(file, line_no, line, n): five lines for each part
CODE = """
five AS (
  SELECT CASE WHEN p_partkey % 5 = 0 THEN 'tests/test_' ELSE 'src/' END || replace(lower(p_type), ' ', '_') || '_' || replace(p_brand, '#', '') || '.py' AS file,
    p_partkey, unnest(['def ' || replace(replace(lower(p_name), ' ', '_'), '#', '_') || '_' || p_partkey || '(size):', '    # ' || p_type || ' ' || p_brand,
    '    total = size * ' || p_size, '    return total', '']) AS line, unnest([0, 1, 2, 3, 4]) AS k FROM part),
code AS (SELECT file, line, row_number() OVER (PARTITION BY file ORDER BY p_partkey, k) - 1 AS line_no, count(*) OVER (PARTITION BY file) AS n FROM five)"""

DEFINES = r"^\s*(export\s+)?(pub\s+)?(static\s+)?(async\s+)?(def|class|fn|func|function|impl|trait|interface|struct|enum|type)\b"
NAMED = r"(?:class|struct|enum|def|fn|func|function|proc|method|impl|trait|interface|void|int|char|bool|auto|static|virtual|const)\s+(\w+)"
TEST = "(contains(string_split(lower(file), '/')[-1], 'test') OR contains(lower(file), '/tests/') OR starts_with(lower(file), 'tests/'))"
VENDORED = "(" + " OR ".join(f"contains(lower(file), '{s}')" for s in fixed.VENDORED_SUBSTRINGS) + ")"
SYMBOL = rf"coalesce(nullif(regexp_extract(line, '{NAMED}', 1), ''), nullif(regexp_extract(line, '\b(\w+)\s*\(', 1), ''))"


def _hits(lines: str, patterns: list[str]) -> str:
    found = ", ".join(f"CASE WHEN regexp_matches(line, '(?i){p}') THEN {i} END" for i, p in enumerate(patterns))
    return f"hits AS (SELECT * FROM (SELECT file, line_no, n, line, list_filter([{found}], lambda x: x IS NOT NULL) AS found FROM {lines} WHERE length(line) + 1 <= 5000) WHERE len(found) > 0)"


def _groups(gap: int) -> str:
    return f"""marked AS (SELECT *, CASE WHEN line_no - lag(line_no) OVER (PARTITION BY file ORDER BY line_no) <= {gap} THEN 0 ELSE 1 END AS fresh FROM hits),
numbered AS (SELECT *, sum(fresh) OVER (PARTITION BY file ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS gid FROM marked),
groups AS (SELECT file, gid, any_value(n) AS n, min(line_no) AS first, max(line_no) AS last, count(*) AS hits, len(list_distinct(flatten(list(found)))) AS matches FROM numbered GROUP BY file, gid)"""


def _chunks(lines: str, before: int, after: int) -> str:
    return f"""chunk_lines AS (
  SELECT g.file, g.gid, g.matches, greatest(0, first - {before}) AS lo, least(g.n, last + {after} + 1) AS hi, l.line_no, l.line
  FROM groups g JOIN {lines} l ON l.file = g.file AND l.line_no >= greatest(0, first - {before}) AND l.line_no < least(g.n, last + {after} + 1))"""


def _rare(col: str) -> str:
    common = ", ".join(f"'{t}'" for t in sorted(set(fixed.COMMON_TERMS)))
    return rf"len(list_filter(regexp_extract_all({col}, '\w+'), lambda w: length(w) >= 5 AND contains(w, '_') AND lower(w) NOT IN ({common})))"


def _scores(lines: str, patterns: list[str], before: int, after: int) -> str:
    each = ", ".join(f"bool_or(ok AND regexp_matches(line, '(?i){p}')) AS p{i}" for i, p in enumerate(patterns))
    seen = " + ".join(f"CAST(p{i} AS INT)" for i in range(len(patterns)))
    anyp = " OR ".join(f"regexp_matches(line, '(?i){p}')" for p in patterns)
    test = "false" if "test" in " ".join(patterns) else TEST
    return f"""{_hits(lines, patterns)}, {_groups(before + after)}, {_chunks(lines, before, after)},
facts AS (
  SELECT file, gid, any_value(matches) AS matches, any_value(lo) AS lo, any_value(hi) AS hi, {each},
    sum(CASE WHEN ok AND ({anyp}) THEN {_rare('line')} ELSE 0 END) AS rare, bool_or(ok AND ({anyp}) AND regexp_matches(line, '{DEFINES}')) AS defines,
    sum(CASE WHEN regexp_matches(ltrim(line), '^(//|/\\*|\\*|#|--)') THEN 1 ELSE 0 END) AS comments, count(*) AS total,
    string_agg(line || chr(10), '' ORDER BY line_no) AS code
  FROM (SELECT *, length(line) <= 5000 AS ok FROM chunk_lines) GROUP BY file, gid),
judged AS (SELECT *, {seen} AS seen, {test} AS test, {VENDORED} AS vendored FROM facts),
scored AS (SELECT *, lo + 1 AS line_start, hi AS line_end, greatest(0, least(matches * 5, 25) + CASE WHEN seen >= 2 THEN 15 ELSE 0 END + CASE WHEN {len(patterns)} > 1 AND seen = {len(patterns)} THEN 10 ELSE 0 END
    + CASE WHEN rare > 0 THEN least(rare * 3, 15) ELSE 0 END + CASE WHEN defines THEN 25 ELSE 0 END - CASE WHEN test THEN 8 ELSE 0 END
    - CASE WHEN vendored THEN 15 ELSE 0 END - CASE WHEN comments > 0.7 * total THEN 10 ELSE 0 END) AS score,
  array_to_string(list_filter([CASE WHEN matches >= 3 THEN 'multi_match(' || matches || ')' END, CASE WHEN seen >= 2 THEN 'co_occurrence' END,
    CASE WHEN {len(patterns)} > 1 AND seen = {len(patterns)} THEN 'all_patterns' END, CASE WHEN rare > 0 THEN 'rare_terms' END, CASE WHEN defines THEN 'definition' END,
    CASE WHEN test THEN 'test_demoted' END, CASE WHEN vendored THEN 'vendor_demoted' END, CASE WHEN comments > 0.7 * total THEN 'mostly_comments' END], lambda x: x IS NOT NULL), ',') AS reasons,
  greatest(1, length(code) // 4) AS tokens, substr(md5(code), 1, 8) AS hash FROM judged)"""


def _stem(col: str) -> str:
    cases = " ".join(f"WHEN ends_with({col}, '{s}') AND length({col}) - {len(s)} >= 4 THEN left({col}, length({col}) - {len(s)})" for s in fixed.STEM_SUFFIXES)
    return f"CASE {cases} ELSE {col} END"


# words(w) -> token
SEM = f"""
subs AS (SELECT *, list_filter(flatten(list_transform(string_split(w, '_'), lambda p: string_split(regexp_replace(p, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), ' '))), lambda s: length(s) >= 3) AS kept FROM words),
sem AS (SELECT * EXCLUDE (kept, w), unnest(list_concat(list_transform(kept, lambda s: {_stem('lower(s)')}), CASE WHEN len(kept) > 1 THEN [lower(w)] ELSE [] END)) AS token FROM subs)"""

WORDS = ["the", "and", "tion"]
CODEWORDS = ["total", "size", "return"]

COMMITS = """
commits AS (SELECT o_orderkey AS commit_id, CAST(epoch(o_orderdate) AS BIGINT) AS ts, l_partkey AS file, CAST(changed AS BIGINT) AS changed
  FROM (SELECT l_orderkey, l_partkey, sum(l_quantity) AS changed FROM lineitem GROUP BY ALL) JOIN orders ON l_orderkey = o_orderkey),
churned AS (SELECT file, ln(1 + sum(ln(1 + changed) / sqrt(files) * exp(-greatest(0, now - ts) / 7776000.0))) AS raw
  FROM (SELECT *, count(*) OVER (PARTITION BY commit_id) AS files, max(ts) OVER () AS now FROM commits) GROUP BY file),
churn AS (SELECT file, raw / (SELECT max(raw) FROM churned) AS w FROM churned)"""


def _pairs(most: int) -> str:
    return f"""sized AS (SELECT commit_id, file, count(*) OVER (PARTITION BY commit_id) AS files FROM commits),
pairs AS (SELECT a.file AS a, b.file AS b, count(*) AS n FROM sized a JOIN sized b ON a.commit_id = b.commit_id AND a.file <> b.file WHERE a.files BETWEEN 2 AND {most} GROUP BY ALL)"""


LIFT = """
freq AS (SELECT file, count(*) AS n FROM commits GROUP BY file), total AS (SELECT count(DISTINCT commit_id) AS t FROM commits),
best AS (SELECT p_partkey AS anchor, CAST(p_size AS DOUBLE) AS s FROM part ORDER BY s DESC, anchor LIMIT 3),
e AS (SELECT anchor, exp(2 * s / (SELECT max(s) FROM best)) AS e FROM best), anchors AS (SELECT anchor, e / (SELECT sum(e) FROM e) AS weight FROM e),
lifted AS (SELECT p.b, weight, ln((p.n / t + 1 / (4 * t)) / ((fa.n / t) * (fb.n / t) + 1 / (4 * t))) AS lift
  FROM pairs p JOIN anchors ON p.a = anchor JOIN freq fa ON fa.file = p.a JOIN freq fb ON fb.file = p.b, total),
raw AS (SELECT b AS file, sum(weight * lift) AS raw FROM lifted WHERE lift > 0 GROUP BY b), coch AS (SELECT file, raw / (SELECT max(raw) FROM raw) AS c FROM raw)"""

WINDOWS = f"""{LINES}, files AS (SELECT file, any_value(n) AS n FROM lines GROUP BY file), starts AS (SELECT file, n, unnest(range(0, n, 40)) AS lo FROM files),
wins AS (SELECT file, lo, least(lo + 60, n) AS hi FROM starts WHERE lo = 0 OR lo - 40 + 60 < n)"""


def _index(regex: str, sem: bool) -> str:
    line = "line" if sem else "lower(line)"
    words = f"words AS (SELECT w.file, lo, hi, unnest(regexp_extract_all({line}, '{regex}')) AS w FROM wins w JOIN lines l ON l.file = w.file AND l.line_no >= lo AND l.line_no < hi)"
    tokens = SEM if sem else "sem AS (SELECT file, lo, hi, w AS token FROM words)"
    return f"""{words}, {tokens}, tf AS (SELECT file, lo, hi, token, count(*) AS tf FROM sem GROUP BY ALL),
blocks AS (SELECT file, lo, hi, CAST(sum(tf) AS BIGINT) AS dl FROM tf GROUP BY ALL), df AS (SELECT token, count(*) AS df FROM tf GROUP BY token),
tot AS (SELECT count(*) AS n, sum(dl) / count(*) AS avgdl FROM blocks)"""


def _asked(weights: dict[str, int]) -> str:
    return "q AS (SELECT unnest([" + ", ".join(f"'{w}'" for w in sorted(weights)) + "]) AS token, unnest([" + ", ".join(str(weights[w]) for w in sorted(weights)) + "]) AS qw)"


def _bm25(weights: dict[str, int], k1: float) -> str:
    return f"""{_asked(weights)}, rated AS (SELECT tf.file, tf.lo, tf.hi, sum(qw * ln(1 + (n - df + 0.5) / (df + 0.5)) * (tf * ({k1} + 1)) / (tf + {k1} * (1 - 0.75 + 0.75 * dl / avgdl))) AS s
  FROM tf JOIN q USING (token) JOIN df USING (token) JOIN blocks b ON b.file = tf.file AND b.lo = tf.lo, tot GROUP BY ALL)"""


def _tfidf(idf: str) -> str:
    ones = {w: 1 for w in sem_tokens(QUESTION)}
    return f"""{_asked(ones)}, v AS (SELECT token, {idf} AS idf FROM df, tot), qv AS (SELECT token, qw * idf AS q FROM q JOIN v USING (token)),
rated AS (SELECT file, lo, hi, sum(coalesce(tf * idf * q, 0)) / (sqrt(sum((tf * idf) * (tf * idf))) * (SELECT sqrt(sum(q * q)) FROM qv)) AS s
  FROM tf JOIN v USING (token) LEFT JOIN qv USING (token) GROUP BY ALL HAVING sum(coalesce(tf * idf * q, 0)) > 0)"""


SEM_WORDS = "[A-Za-z0-9_]{3,}"
QUESTION = "the thing and other then with tion"
DENSE = "sims AS (SELECT e.vec_id AS id, list_dot_product(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) / (sqrt(list_dot_product(CAST(e.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[]))) * sqrt(list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])))) AS sim FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 7) q)"
FOCUS = ", ".join("'" + w.replace("'", "''") + "'" for w in fixed.FOCUS_STOP)
CODE_EXT = ", ".join(f"'{e}'" for e in fixed.CODE_SUFFIXES)
ROUTER = " + ".join(f"({w}) * f[{i + 1}]" for i, w in enumerate(fixed.ROUTER_WEIGHTS))


def _pagerank(rounds: int) -> str:
    steps = ["r0 AS (SELECT node, p AS rank FROM base)"]
    for k in range(1, rounds + 1):
        steps.append(f"r{k} AS MATERIALIZED (SELECT b.node, 0.15 * p + 0.85 * coalesce(f, 0) AS rank FROM base b LEFT JOIN (SELECT dst, sum(rank * share) AS f FROM share JOIN r{k - 1} ON node = src GROUP BY dst) x ON x.dst = b.node)")
    return f"""WITH {COMMITS}, {_pairs(10)}, nodes AS (SELECT p_partkey AS node, CASE WHEN p_size > 40 THEN 1.0 ELSE 0.05 END AS pers FROM part),
base AS (SELECT node, pers / (SELECT sum(pers) FROM nodes) AS p FROM nodes), share AS MATERIALIZED (SELECT a AS src, b AS dst, n / sum(n) OVER (PARTITION BY a) AS share FROM pairs),
{', '.join(steps)} SELECT node, round(rank, 9) AS rank FROM r{rounds}"""


ORACLES = {
    "flagship": f"WITH {LINES}, {_scores('lines', WORDS, 2, 2)} SELECT file, line_start, line_end, matches, CAST(score AS BIGINT) AS score, reasons, hash FROM scored ORDER BY score DESC, file, line_start LIMIT 20",
    "c_line_split_stats": f"WITH {LINES} SELECT file, count(*) AS n_lines, CAST(sum(length(line)) AS BIGINT) AS n_chars, CAST(sum(CASE WHEN length(line) + 1 > 5000 THEN 1 ELSE 0 END) AS BIGINT) AS n_long, CAST(sum(greatest(1, length(line) // 4)) AS BIGINT) AS tokens FROM lines GROUP BY file",
    "c_match_lines": f"WITH {LINES}, {_hits('lines', WORDS)} SELECT file, line_no, array_to_string(found, ',') AS found FROM hits",
    "c_definition_lines": f"WITH {CODE} SELECT file, line_no, {SYMBOL} AS symbol FROM code WHERE regexp_matches(line, '{DEFINES}')",
    "c_symbols": f"WITH {CODE} SELECT symbol, count(*) AS n FROM (SELECT {SYMBOL} AS symbol FROM code) WHERE symbol IS NOT NULL GROUP BY symbol",
    "c_file_map": f"WITH {CODE}, shown AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY line_no) AS r FROM code WHERE regexp_matches(line, '^\\s*(def|class)\\s') AND length(line) <= 200) SELECT file, line_no, lpad(CAST(line_no + 1 AS VARCHAR), 6, ' ') || '  ' || CASE WHEN length(rtrim(line)) > 110 THEN left(rtrim(line), 110) || ' ...' ELSE rtrim(line) END AS shown FROM shown WHERE r <= 60",
    "d_match_groups": f"WITH {LINES}, {_hits('lines', WORDS)}, {_groups(2)} SELECT file, first, last, hits, matches FROM groups",
    "d_context_windows": f"WITH {LINES}, {_hits('lines', WORDS)}, {_groups(2)}, {_chunks('lines', 1, 1)} SELECT file, lo, hi, substr(md5(string_agg(line || chr(10), '' ORDER BY line_no)), 1, 8) AS hash, greatest(1, length(string_agg(line || chr(10), '' ORDER BY line_no)) // 4) AS tokens FROM chunk_lines GROUP BY file, gid, lo, hi",
    "d_merged_windows": f"WITH {LINES}, {_hits('lines', ['ing'])}, {_groups(5)} SELECT file, greatest(0, first - 2) AS lo, least(n, last + 3) AS hi FROM groups",
    "d_sliding_windows": f"WITH {LINES}, files AS (SELECT file, any_value(n) AS n FROM lines GROUP BY file), starts AS (SELECT file, n, unnest(range(0, n, 40)) AS lo FROM files) SELECT file, lo, least(lo + 60, n) AS hi FROM starts WHERE lo = 0 OR lo - 40 + 60 < n",
    "d_definition_blocks": f"WITH {CODE} SELECT file, line_no AS lo, coalesce(lead(line_no) OVER (PARTITION BY file ORDER BY line_no), n) AS hi FROM code WHERE regexp_matches(line, '{DEFINES}')",
    "d_python_blocks": f"WITH {CODE}, h AS (SELECT *, max(CASE WHEN starts_with(line, 'def ') THEN line_no END) OVER (PARTITION BY file ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS lo FROM code) SELECT file, line_no, lo, coalesce((SELECT min(c.line_no) FROM code c WHERE c.file = h.file AND c.line_no > h.lo AND starts_with(c.line, 'def ')), n) AS hi FROM h",
    "e_semantic_tokens": f"WITH {CODE}, words AS (SELECT unnest(regexp_extract_all(t, '[A-Za-z0-9_]{{3,}}')) AS w FROM (SELECT text AS t FROM documents UNION ALL SELECT line FROM code)), {SEM} SELECT token, count(*) AS n FROM sem GROUP BY token",
    "e_exact_token_df": "WITH t AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9_]{3,}')) AS token FROM documents), tf AS (SELECT doc_id, token, count(*) AS tf FROM t GROUP BY ALL) SELECT token, count(*) AS df, CAST(sum(tf) AS BIGINT) AS tf FROM tf GROUP BY token",
    "e_scalar_functions": f"WITH {CODE} SELECT file, line_no, string_split(file, '/')[-1] AS name, 'python' AS language, {TEST} AS test, {VENDORED} AS vendored, regexp_matches(ltrim(line), '^(//|/\\*|\\*|#|--)') AS comment, {_rare('line')} AS rare, CASE WHEN regexp_replace(line, '[^A-Za-z0-9_-]', '', 'g') = '' THEN 'nosession' ELSE left(regexp_replace(line, '[^A-Za-z0-9_-]', '', 'g'), 64) END AS safe, substr(md5(line), 1, 8) AS hash FROM code",
    "f_chunk_scores": f"WITH {LINES}, {_scores('lines', WORDS, 1, 1)} SELECT file, line_start, line_end, matches, CAST(score AS BIGINT) AS score, reasons, tokens FROM scored",
    "f_chunk_scores_code": f"WITH {CODE}, {_scores('code', CODEWORDS, 1, 1)} SELECT file, line_start, line_end, matches, CAST(score AS BIGINT) AS score, reasons FROM scored",
    "g_exact_dups": f"WITH {LINES}, {_scores('lines', WORDS, 1, 1)}, r AS (SELECT *, row_number() OVER (PARTITION BY file, hash ORDER BY score DESC, line_start) AS r FROM scored) SELECT file, hash, line_start FROM r WHERE r = 1",
    "g_near_dup_links": """
WITH d AS (SELECT doc_id AS file, list_sort(list_distinct(list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))), lambda x: x <> ''))) AS s FROM documents),
c AS (SELECT s, min(file) AS class_id, len(s) AS n FROM d GROUP BY s), l AS (SELECT class_id, n, unnest(s) AS line FROM c),
p AS (SELECT a.class_id AS a, b.class_id AS b FROM l a JOIN l b ON a.line = b.line AND a.class_id < b.class_id GROUP BY a.class_id, b.class_id, a.n, b.n HAVING count(*) / (a.n + b.n - count(*)) >= 0.7),
e AS (SELECT class_id, count(*) AS links FROM (SELECT a AS class_id FROM p UNION ALL SELECT b FROM p) GROUP BY class_id)
SELECT d.file AS doc_id, c.class_id, coalesce(e.links, 0) AS links FROM d JOIN c ON d.s = c.s LEFT JOIN e ON e.class_id = c.class_id""",
    "h_tfidf_rerank": f"""
WITH {LINES}, {_scores('lines', WORDS, 1, 1)}, head AS (SELECT file || ':' || line_start AS id, code FROM scored ORDER BY score DESC, file, line_start LIMIT 250),
t AS (SELECT id, unnest(regexp_extract_all(lower(code), '[a-z0-9_]{{3,}}')) AS token FROM head), tf AS (SELECT id, token, count(*) AS tf FROM t GROUP BY ALL),
v AS (SELECT token, ln(1 + (SELECT count(*) FROM head) / (1 + count(*))) AS idf FROM tf GROUP BY token),
q AS (SELECT w.token, coalesce(idf, ln(1 + (SELECT count(*) FROM head))) AS q FROM (SELECT unnest(['the', 'and', 'tion', 'with', 'zzzz']) AS token) w LEFT JOIN v ON v.token = w.token)
SELECT id, round(sum(coalesce(tf * idf * q, 0)) / (sqrt(sum((tf * idf) * (tf * idf))) * (SELECT sqrt(sum(q * q)) FROM q)), 6) AS cosine
FROM tf JOIN v USING (token) LEFT JOIN q USING (token) GROUP BY id HAVING sum(coalesce(tf * idf * q, 0)) > 0""",
    "i_bm25_topk": f"WITH {WINDOWS}, {_index(SEM_WORDS, True)}, {_bm25(query_tokens(QUESTION), 1.2)} SELECT file, lo, hi, round(s, 6) AS s FROM rated ORDER BY rated.s DESC, file DESC, lo DESC LIMIT 40",
    "i_tfidf_window_topk": f"WITH {WINDOWS}, {_index(SEM_WORDS, True)}, {_tfidf('ln(1 + n / (1 + df))')} SELECT file, lo, hi, round(s, 6) AS s FROM rated ORDER BY rated.s DESC, file DESC, lo DESC LIMIT 40",
    "i_dense_topk": f"WITH {DENSE} SELECT id AS vec_id, round(sim, 6) AS sim FROM sims WHERE sim > 0 ORDER BY sims.sim DESC, id LIMIT 40",
    "i_fused_topk": f"""
WITH words AS (SELECT doc_id AS file, 0 AS lo, 0 AS hi, unnest(regexp_extract_all(text, '{SEM_WORDS}')) AS w FROM documents), {SEM}, tf AS (SELECT file, lo, hi, token, count(*) AS tf FROM sem GROUP BY ALL),
blocks AS (SELECT file, lo, hi, CAST(sum(tf) AS BIGINT) AS dl FROM tf GROUP BY ALL), df AS (SELECT token, count(*) AS df FROM tf GROUP BY token), tot AS (SELECT count(*) AS n, sum(dl) / count(*) AS avgdl FROM blocks),
{_bm25(query_tokens('the thing and'), 1.2)}, {DENSE}, lex AS (SELECT file AS id, s FROM rated WHERE file IN (SELECT id FROM sims)),
ids AS (SELECT id FROM lex UNION SELECT id FROM (SELECT id, sim FROM sims ORDER BY sim DESC, id LIMIT 40) WHERE sim > 0),
f AS (SELECT ids.id, greatest(0, coalesce(sim / (SELECT max(sim) FROM sims), 0)) AS fd, coalesce(s / (SELECT max(s) FROM lex), 0) AS fb FROM ids LEFT JOIN lex ON lex.id = ids.id LEFT JOIN sims ON sims.id = ids.id),
g AS (SELECT id, (fb + fd) / 2 AS fused, fd FROM f WHERE fb + fd > 0)
SELECT id, round(fused, 6) AS fused, round(fd, 6) AS fd FROM (SELECT * FROM (SELECT * FROM g ORDER BY fused DESC, id DESC LIMIT 40) UNION SELECT * FROM (SELECT * FROM g ORDER BY fd DESC, fused DESC, id DESC LIMIT 40))""",
    "j_churn": f"WITH {COMMITS} SELECT file, round(w, 6) AS w FROM churn",
    "j_cochange_pairs": f"WITH {COMMITS}, {_pairs(10)} SELECT a, b, n FROM pairs",
    "j_anchor_lift": f"WITH {COMMITS}, {_pairs(10)}, {LIFT} SELECT file, round(c, 6) AS c FROM coch",
    "j_file_fusion": f"WITH {COMMITS}, {_pairs(10)}, {LIFT}, t AS (SELECT p_partkey AS file, CAST(p_size AS DOUBLE) AS s FROM part), peak AS (SELECT max(s) AS peak FROM t) SELECT t.file, round((s / peak + 0.3 * coalesce(w, 0) + 0.5 * coalesce(c, 0)) * peak, 6) AS s FROM t CROSS JOIN peak LEFT JOIN churn ON churn.file = t.file LEFT JOIN coch ON coch.file = t.file",
    "j_symbol_graph": f"""
WITH commits AS (SELECT DISTINCT l_orderkey AS commit_id, 'part_' || l_partkey AS file FROM lineitem), {_pairs(12)}, freq AS (SELECT file, count(*) AS n FROM commits GROUP BY file), total AS (SELECT count(DISTINCT commit_id) AS t FROM commits),
l AS (SELECT b, max(ln((p.n / t + 1 / (4 * t)) / ((fa.n / t) * (fb.n / t) + 1 / (4 * t)))) AS l FROM pairs p JOIN freq fa ON fa.file = p.a JOIN freq fb ON fb.file = p.b, total
  WHERE a IN ('part_1', 'part_2', 'part_3') AND b NOT IN ('part_1', 'part_2', 'part_3') GROUP BY b), best AS (SELECT * FROM l WHERE l > 0 ORDER BY l DESC, b LIMIT 16)
SELECT b AS symbol, round(l / (SELECT max(l) FROM best), 6) AS w FROM best""",
    "k_guaranteed_slots": f"""
WITH {CODE}, {_scores('code', ['def'], 1, 1)}, d AS (SELECT file, line_start FROM scored WHERE defines ORDER BY test, score DESC, file, line_start LIMIT 1),
rest AS (SELECT * FROM scored s WHERE NOT EXISTS (SELECT 1 FROM d WHERE d.file = s.file AND d.line_start = s.line_start))
SELECT 'definition' AS slot, file, line_start FROM d
UNION ALL SELECT * FROM (SELECT 'caller', file, line_start FROM rest WHERE NOT test AND file <> (SELECT file FROM d) ORDER BY score DESC, file, line_start LIMIT 1)
UNION ALL SELECT * FROM (SELECT 'test', file, line_start FROM rest WHERE test ORDER BY score DESC, file, line_start LIMIT 1)""",
    "k_running_cap": f"WITH {LINES}, {_scores('lines', WORDS, 1, 1)}, r AS (SELECT *, sum(tokens) OVER (PARTITION BY file ORDER BY score DESC, line_start ROWS UNBOUNDED PRECEDING) AS upto FROM scored) SELECT file, line_start, tokens FROM r WHERE upto - tokens < 200",
    "k_overlap_anti": f"WITH {WINDOWS}, {_hits('lines', WORDS)}, {_groups(2)}, c AS (SELECT file, greatest(0, first - 1) + 1 AS line_start, least(n, last + 2) AS line_end FROM groups), k AS (SELECT file, lo + 1 AS a, lo + 3 AS b FROM wins WHERE lo % 80 = 0) SELECT * FROM c WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.file = c.file AND line_start <= b AND a <= line_end)",
    "l_coverage": f"WITH {LINES}, {_scores('lines', WORDS, 1, 1)}, r AS (SELECT *, sum(tokens) OVER (PARTITION BY file ORDER BY score DESC, line_start ROWS UNBOUNDED PRECEDING) - tokens < 60 AS kept FROM scored) SELECT file, CAST(sum(CASE WHEN kept THEN tokens ELSE 0 END) AS BIGINT) AS shown, CAST(sum(CASE WHEN kept THEN 0 ELSE tokens END) AS BIGINT) AS omitted, round(sum(CASE WHEN kept THEN tokens ELSE 0 END) / sum(tokens), 6) AS coverage FROM r GROUP BY file",
    "l_negative_patterns": f"WITH {LINES}, {_hits('lines', ['tion'])}, {_groups(2)}, {_chunks('lines', 0, 0)}, p AS (SELECT unnest(['the', 'tion', 'zzzz', 'qqqq', 'ing']) AS pattern) SELECT pattern, CASE WHEN EXISTS (SELECT 1 FROM chunk_lines WHERE regexp_matches(line, '(?i)' || pattern)) THEN 'found' WHEN EXISTS (SELECT 1 FROM lines WHERE regexp_matches(line, '(?i)' || pattern)) THEN 'outside' ELSE 'absent' END AS status FROM p",
    "l_summary": f"WITH {LINES}, {_hits('lines', WORDS)} SELECT (SELECT count(*) FROM documents) AS files_searched, count(DISTINCT file) AS files_matched FROM hits",
    "p_focus_terms": f"""
WITH m AS (SELECT conv_id AS session, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS place FROM conversations WHERE role IN ('user', 'assistant') AND coalesce(text, '') <> ''),
t AS (SELECT session, role, place, unnest(regexp_extract_all(substr(text, 1, 4000), '[A-Za-z_][A-Za-z0-9_]{{3,}}')) AS term FROM m WHERE place <= 6),
s AS (SELECT session, term, sum(CASE WHEN role = 'user' THEN 3.0 ELSE 1.0 END::DOUBLE / place * CASE WHEN contains(term, '_') OR term <> lower(term) THEN 2 ELSE 1 END) AS weight FROM t WHERE lower(term) NOT IN ({FOCUS}) GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY round(weight, 9) DESC, term) AS r FROM s) SELECT session, term, round(weight, 6) AS weight FROM r WHERE r <= 8""",
    "p_first_seen": "WITH e AS (SELECT event_id, user_id AS session, lower(json_extract_string(props, '$.k')) AS path FROM events) SELECT *, event_id = min(event_id) OVER (PARTITION BY session, path) AS intercepted FROM e",
    "p_intercepts": f"WITH r AS (SELECT doc_id, source || '/' || doc_id || CASE WHEN doc_id % 3 = 0 THEN '.md' ELSE '.py' END AS path, text FROM documents WHERE doc_id % 7 <> 0 AND doc_id % 5 <> 0) SELECT doc_id, path FROM r WHERE lower(regexp_extract(path, '(\\.[^./]+)$', 1)) IN ({CODE_EXT}) AND strlen(text) // 4 >= 2000 AND strlen(text) <= 5000000 AND length(text) // 4 >= 2000",
    "r_raw_grep": f"WITH {LINES} SELECT file, line_no + 1 AS line_no, file || ':' || (line_no + 1) || ': ' || trim(line) AS shown FROM lines WHERE regexp_matches(line, '(?i)tion')",
    "r_whole_files": f"WITH {LINES} SELECT file, any_value(n) AS n FROM lines GROUP BY file HAVING bool_or(regexp_matches(line, '(?i)tionn'))",
    "r_file_rank": f"WITH {LINES}, f AS (SELECT file, sum(CASE WHEN regexp_matches(line, '(?i)src1|tion') THEN 1 ELSE 0 END) AS hits, greatest(1, length(string_agg(line, chr(10) ORDER BY line_no)) // 4) AS tokens FROM lines GROUP BY file), s AS (SELECT file, CAST(hits + CASE WHEN regexp_matches(lower(string_split(file, '/')[-1]), 'src1|tion') THEN 10 ELSE 0 END - CASE WHEN contains(lower(file), 'test') THEN 5 ELSE 0 END AS BIGINT) AS score, tokens FROM f WHERE hits > 0), r AS (SELECT *, sum(tokens) OVER (ORDER BY score DESC, file ROWS UNBOUNDED PRECEDING) AS upto FROM s) SELECT file, score, tokens FROM r WHERE upto - tokens < 8000",
    "r_bm25_windows": f"WITH {WINDOWS}, {_index('[a-z0-9_]{2,}', False)}, {_bm25({'the': 1, 'and': 1, 'with': 1}, 1.5)} SELECT file, lo, hi, round(s, 6) AS s FROM rated WHERE rated.s > 0 ORDER BY rated.s DESC, file DESC, lo DESC LIMIT 50",
    "r_tfidf_budget": f"WITH {WINDOWS}, {_index(SEM_WORDS, True)}, {_tfidf('ln(n / (1 + df))')}, best AS (SELECT * FROM rated ORDER BY round(rated.s, 9) DESC, file DESC, lo DESC LIMIT 50), sized AS (SELECT b.file, b.lo, b.hi, b.s, greatest(1, sum(length(line) + 1) // 4) AS tokens FROM best b JOIN lines l ON l.file = b.file AND l.line_no >= b.lo AND l.line_no < b.hi GROUP BY ALL), r AS (SELECT *, sum(tokens) OVER (ORDER BY round(s, 9) DESC, file DESC, lo DESC ROWS UNBOUNDED PRECEDING) AS upto FROM sized) SELECT file, lo, hi, CAST(tokens AS BIGINT) AS tokens FROM r WHERE upto - tokens < 2000",
    "r_syntax_chunks": f"WITH {CODE} SELECT file, line_no AS lo, line_no + 4 AS hi FROM code WHERE starts_with(line, 'def ')",
    "r_hit_rate": """
WITH t AS (SELECT DISTINCT item_id AS task, unnest(list_transform(string_split(text, chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(13)))) AS line FROM benchmark),
d AS (SELECT DISTINCT unnest(list_transform(string_split(text, chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(13)))) AS line FROM documents)
SELECT task, count(d.line) AS found, count(*) AS wanted, count(d.line) = count(*) AS hit FROM t LEFT JOIN d ON d.line = t.line WHERE t.line <> '' GROUP BY task""",
    "r_refine_terms": "WITH t AS (SELECT unnest(regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_]{4,}')) AS term FROM documents), c AS (SELECT term, count(*) AS n FROM t WHERE NOT contains('the|ention', lower(term)) GROUP BY term) SELECT term, n FROM c ORDER BY CASE WHEN contains(term, '_') OR regexp_matches(term, '^[a-z].*[A-Z]') THEN 100 ELSE 0 END + n DESC, term LIMIT 4",
    "r_repomap_pagerank": _pagerank(15),
    "r_router_margin": f"WITH p AS (SELECT p_partkey AS query_id, string_split(lower(p_type), ' ') AS a FROM part), x AS (SELECT query_id, [1.0::DOUBLE, len(a), len(list_filter(a, lambda w: regexp_full_match(w, '[a-z][a-z0-9]{{3,}}'))) / len(a), CASE WHEN contains(list_aggregate(a, 'string_agg', ' '), '_') THEN 1 ELSE 0 END, 0, 0, list_sum(list_transform(a, lambda w: length(w))) / (4.0 * len(a))] AS f FROM p) SELECT query_id, round({ROUTER}, 6) AS margin, {ROUTER} > 0 AS vague FROM x",
    "r_symbol_tasks": f"WITH {CODE}, t AS (SELECT file, line_no, regexp_extract(line, '^\\s*(?:async\\s+)?(?:def|class)\\s+([A-Za-z_]\\w{{3,}})', 1) AS name FROM code) SELECT *, name AS query FROM t WHERE name <> ''",
    "r_comprehension_tasks": f"WITH {CODE}, t AS (SELECT file, line_no, regexp_extract(line, '^\\s*(?:async\\s+)?(?:def|class)\\s+([A-Za-z_]\\w{{3,}})', 1) AS name, lead(line) OVER (PARTITION BY file ORDER BY line_no) AS nxt FROM code), w AS (SELECT file, line_no, name, list_filter(regexp_extract_all(lower(nxt), '[a-z]{{5,}}'), lambda x: NOT contains(name, x)) AS raw FROM t WHERE name <> ''), o AS (SELECT file, line_no, name, list_filter(raw, lambda x, i: list_position(raw, x) = i)[:3] AS words FROM w) SELECT file, line_no, name, array_to_string(words, '|') AS query FROM o WHERE len(words) >= 2",
    "r_summary": "SELECT event_type AS strategy, count(*) AS tasks, round(avg(CASE WHEN value > 50 THEN 1.0 ELSE 0.0 END), 6) AS hit_rate, round(quantile_cont(CAST(user_id AS DOUBLE), 0.5), 6) AS tokens, round(quantile_cont(value, 0.5), 6) AS latency_ms FROM events GROUP BY event_type",
    "x_event_windows": "WITH s AS (SELECT CAST(floor(epoch(ts) / 10800) AS BIGINT) * 10800 - 10800 * k AS start, event_type, value FROM events, (SELECT unnest([0, 1]) AS k)) SELECT start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM s GROUP BY ALL",
    "x_session_windows": "WITH m AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 2 HOUR THEN 0 ELSE 1 END AS fresh FROM events), g AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM m) SELECT user_id, CAST(floor(epoch(min(ts))) AS BIGINT) AS start, count(*) AS n FROM g GROUP BY user_id, k",
    "x_rollup": "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)",
    "x_cube": "SELECT event_type, value > 50 AS big, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY CUBE (event_type, big)",
}
