from __future__ import annotations

import math
import random
import re
import subprocess
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from gleaner.functions import text as X
from gleaner.operators import evaluate as E
from gleaner.operators import history as H
from gleaner.operators import pack as P
from gleaner.operators import score as C
from gleaner.operators import segment as S
from gleaner.plans import query as Q
from gleaner.plans.api import focused_read
from gleaner.sources import tables as T
from gleaner.streaming import sessions as ST

MODULE = '''import os


class Basket:
    """Holds items."""

    def add_item(self, item):
        self.items.append(item)
        return item

    def total_price(self, rate):
        return sum(i.price for i in self.items) * rate


def unrelated(value):
    return value + 1


def load_config(path):
    # retry until the config parses
    for attempt in range(3):
        try:
            with open(path) as handle:
                retry = attempt
                return parse(handle.read(), retry)
        except ValueError:
            continue
    return None
'''


@pytest.fixture()
def tree(tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "tests").mkdir()
    (tmp_path / "node_modules").mkdir()
    pad = "".join(f"# note {i}\n" for i in range(40))
    (tmp_path / "src" / "basket.py").write_text(MODULE)
    (tmp_path / "src" / "caller.py").write_text(pad + "from basket import load_config\nsettings = load_config('a')\n" + pad)
    (tmp_path / "tests" / "test_basket.py").write_text(pad + "def test_load_config():\n    assert load_config('x') is None\n" + pad)
    (tmp_path / "node_modules" / "skipped.py").write_text("def load_config(): pass\n")
    (tmp_path / "src" / "image.bin").write_bytes(b"load_config")
    return tmp_path


def test_tree_scan(spark, tree):
    files = sorted(r.file.rsplit("/", 1)[-1] for r in T.scan_tree(spark, str(tree)).collect())
    assert files == ["basket.py", "caller.py", "test_basket.py"]
    assert T.scan_tree(spark, str(tree / "absent")).count() == 0


def test_definition_found_in_one_file(spark, tree):
    r = focused_read(spark, str(tree / "src" / "basket.py"), "def add_item", before=1, after=3)
    assert any("def add_item" in c.code for c in r.chunks) and r.negative_evidence == []


def test_absence_is_reported(spark, tree):
    r = focused_read(spark, str(tree / "src" / "basket.py"), "zebra_stripe")
    assert r.chunks == [] and "not found" in r.negative_evidence[0]


def test_function_boundary_and_co_occurrence(spark, tree):
    path = str(tree / "src" / "basket.py")
    r = focused_read(spark, path, "attempt|retry|parse", before=6, after=6, boundary="fn")
    assert "co_occurrence" in r.chunks[0].rank_reason
    code = focused_read(spark, path, "retry = attempt", boundary="fn").chunks[0].code
    assert "def load_config" in code and "return None" in code


def test_budgets(spark, tree):
    path = str(tree / "src" / "basket.py")
    r = focused_read(spark, path, "def", budget=5)
    assert len(r.chunks) == 1 and "truncated" in r.chunks[0].code and r.omitted and 0 < r.coverage < 1
    r = focused_read(spark, path, "def", before=2, after=2, budget=60)
    assert r.total_tokens <= 60 or len(r.chunks) == 1
    assert focused_read(spark, path, "def", budget=0).coverage == 1.0


def test_directory_objectives(spark, tree):
    r = focused_read(spark, str(tree), "load_config", budget=600, before=3, after=3)
    names = {c.file.rsplit("/", 1)[-1] for c in r.chunks}
    assert names == {"basket.py", "caller.py", "test_basket.py"} and r.files_searched == 3
    assert "RANKING" in r.render() and set(r.to_dict()) >= {"chunks", "coverage", "omitted"}
    kept = {(c.file, c.line_start) for c in r.chunks}
    assert len(kept) == len(r.chunks)


def test_missing_path_and_bad_regex(spark, tree):
    assert focused_read(spark, str(tree / "nothing.py"), "x").chunks == []
    assert focused_read(spark, str(tree / "src" / "basket.py"), "open(path").chunks


def test_long_lines_are_skipped(spark):
    df = spark.createDataFrame([("a.py", "def needle():\n" + "a" * 20_000 + "\n")], "file string, text string")
    r = focused_read(spark, df, "needle|a+b")
    assert len(r.chunks) == 1 and "def needle" in r.chunks[0].code


def test_expanded_question_finds_the_identifier(spark):
    df = spark.createDataFrame([("a.py", "x = 1\ncache_invalidation_delay = 3\ny = 2\n")], "file string, text string")
    assert focused_read(spark, df, "what is the cache invalidation delay value", budget=400).chunks


def test_nulls_and_empty_corpora(spark):
    df = spark.createDataFrame([("a", None), ("b", ""), (None, "the\n")], "file string, text string")
    assert focused_read(spark, df, "the", budget=100).files_searched == 3
    assert focused_read(spark, df.limit(0), "the").chunks == []


def brute_lines(text):
    return text.splitlines()


@pytest.mark.parametrize("text", ["", "a", "a\n", "a\n\nb", "\n", "a\r\nb\rc\n", "a\x0bb\x0cc\x1cd\x85e f g"])
def test_line_split(spark, text):
    assert spark.createDataFrame([(text,)], "t string").select(X.lines_of(F.col("t")).alias("l")).first().l == brute_lines(text)


def test_sem_tokens_and_stems(spark):
    words = ["CacheInvalidator", "snake_case_name", "invalidation invalidating", "HTTPServer x1 ab", "__init__"]
    rows = spark.createDataFrame([(w,) for w in words], "t string").select("t", X.sem_tokens(F.col("t")).alias("s")).collect()
    assert all(r.s == Q.sem_tokens(r.t) for r in rows)


def test_python_blocks_agree_with_the_procedure(spark):
    rng = random.Random(3)
    kinds = ["def f{i}():", "class C{i}:", "x = {i}", "# note", "", "async def g{i}():", "return {i}"]
    files = {f"f{k}.py": [" " * 4 * rng.randrange(4) + rng.choice(kinds).format(i=i) for i in range(rng.randrange(1, 40))] for k in range(25)}
    df = spark.createDataFrame([(f, lines) for f, lines in files.items()], "file string, lines array<string>")
    got = {(r.file, r.line_no): (r.lo, r.hi) for r in S.python_blocks(df).collect()}
    for f, lines in files.items():
        for i in range(len(lines)):
            found = S._python_block(lines, i)
            assert got[f, i] == ((found[0], found[1]) if found else (None, None)), (f, i, lines)


def test_brace_blocks():
    lines = ["int f(int a) {", "  if (a) {", "    g();", "  }", "  return a;", "}", "class Last {"]
    assert S.enclosing_block(lines, 2, "c_like")[0] == 1
    assert S.enclosing_block(lines, 4, "brace")[0] == 1  # the nearest opening line whose balance is even
    lo, hi, _ = S.enclosing_block(lines, 6, "c_like")
    assert (lo, hi) == (6, 7)  # a header on the last line is not an empty slice
    assert S.enclosing_block(["a", "b"], 1, "c_like") == (0, 2, None)


def test_definition_blocks_cut_long_ones(spark):
    long = ["def a():"] + ["    x"] * 199 + ["def b():", "    y"]
    plain = ["text"] * 95
    df = spark.createDataFrame([("a.py", long), ("b.py", plain)], "file string, lines array<string>")
    got = {f: sorted((r.lo, r.hi) for r in S.definition_blocks(df).collect() if r.file == f) for f in ("a.py", "b.py")}
    assert got["a.py"] == [(0, 70), (60, 130), (120, 200), (200, 202)]
    assert got["b.py"] == [(0, 60), (40, 95), (80, 95)]


def test_near_duplicates_are_greedy_within_a_file(spark):
    lines = [[f"l{i}" for i in range(10)], [f"l{i}" for i in range(9)] + ["new"], ["p", "q"], ["p", "q"]]
    rows = [("f", i, float(10 - i), [*ls], "\n".join(ls)) for i, ls in enumerate(lines)] + [("g", 9, 1.0, lines[0], "\n".join(lines[0]))]
    df = spark.createDataFrame(rows, "file string, line_start int, score double, code_lines array<string>, code string").withColumn("hash", X.content_hash(F.col("code")))
    assert sorted((r.file, r.line_start) for r in C.without_near_duplicates(df).collect()) == [("f", 0), ("f", 2), ("g", 9)]
    assert sorted((r.file, r.line_start) for r in C.without_near_duplicates(df, 2.0).collect()) == [("f", 0), ("f", 1), ("f", 2), ("g", 9)]


def naive_pack(chunks, budget, objective):
    """The packer by its description, quadratic."""
    kept = [c for c in P.reserved(chunks, objective)]
    fitted, used = [], 0
    for c in kept:
        if used + c.tokens <= budget:
            fitted.append(c)
            used += c.tokens
    rest = [c for c in chunks if not any(c is f for f in fitted)]
    while True:
        able = [(c.score - 6 * sum(f.file == c.file for f in fitted), -i, c) for i, c in enumerate(rest) if used + c.tokens <= budget]
        if not able:
            break
        best = max(able, key=lambda t: t[:2])[2]
        fitted.append(best)
        used += best.tokens
        rest = [c for c in rest if c is not best]
    return sorted(fitted, key=lambda c: -c.score)


@pytest.mark.parametrize("seed", range(30))
def test_packing(seed):
    rng = random.Random(seed)
    files = ["a.py", "b.py", "tests/test_c.py", "d.py"]
    chunks = [
        P.Slice(rng.choice(files), s := rng.randrange(1, 400), s + rng.randrange(30), float(rng.randrange(60)), rng.randrange(1, 90), "x\n" * 40, ["definition"] if rng.random() < 0.2 else [])
        for _ in range(rng.randrange(1, 40))
    ]
    chunks.sort(key=lambda c: -c.score)
    budget, objective = rng.choice([50, 200, 900]), rng.choice(["auto", "single", "def+caller", "def+test"])
    packed = P.pack(chunks, budget, objective)
    wanted = naive_pack(chunks, budget, objective)
    if wanted:
        assert [id(c) for c in packed.kept] == [id(c) for c in wanted]
    lexical, recalled = chunks[::2], chunks[1::2]
    for result in (P.pack_hybrid(lexical, recalled, budget, objective), P.pack_vague(lexical, recalled, budget, objective)):
        left = P.omissions(chunks, result)
        assert sum(c.tokens for c in result.kept) <= budget or len(result.kept) == 1
        assert not {id(c) for c in result.kept} & {id(o) for o in left}
        assert 0 <= P.coverage(result.kept, left) <= 1


def test_history_needs_five_commits(spark):
    df = spark.createDataFrame([(i, 1000 * i, f, 5) for i in range(4) for f in ("a", "b")], "commit_id int, ts bigint, file string, changed int")
    assert H.churn(df).count() == 0
    more = df.unionByName(df.withColumn("commit_id", F.col("commit_id") + 10))
    assert {r.file: r.w for r in H.churn(more).collect()} == {"a": 1.0, "b": 1.0}


def test_large_commits_make_no_pairs(spark):
    rows = [(1, f"f{i}") for i in range(11)] + [(2, "a"), (2, "b"), (3, "c")]
    df = spark.createDataFrame(rows, "commit_id int, file string")
    assert sorted((r.a, r.b, r.n) for r in H.pairs(df).collect()) == [("a", "b", 1), ("b", "a", 1)]


def test_git_sources(spark, tmp_path):
    def git(*args):
        subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=n", "-c", "user.email=e", *args], check=True, capture_output=True)

    git("init", "-q")
    for i in range(3):
        (tmp_path / "a.py").write_text("def work(x):\n    pass\n\n\n" + "    y = 1\n" * (i + 1))
        git("add", "-A")
        git("commit", "-qm", f"change number {i}")
    commits = T.git_commits(spark, str(tmp_path))
    assert commits.select("commit_id").distinct().count() == 3 and commits.first().file == "a.py"
    assert T.git_commits(spark, str(tmp_path / "none")).count() == 0
    assert T.git_hunks(spark, str(tmp_path)).count() >= 3


def test_history_changes_packing_only_with_commits(spark, tree):
    corpus = T.scan_tree(spark, str(tree))
    files = [r.file for r in corpus.collect()]
    commits = spark.createDataFrame([(i, i, f, 10) for i in range(6) for f in files[:2]], "commit_id int, ts bigint, file string, changed int")
    symbols = spark.createDataFrame([(i, s) for i in range(6) for s in (["load_config", "add_item"] if i < 3 else ["other_one"])], "commit_id int, symbol string")
    r = focused_read(spark, corpus, "load_config", budget=500, commits=commits, symbols=symbols)
    assert r.chunks and any("history-expansion" in c.rank_reason for c in r.chunks) or r.omitted


def test_syntax_chunks(spark):
    df = spark.createDataFrame([("a.py", MODULE.splitlines()), ("b.txt", ["x"] * 5), ("c.py", ["def ("])], "file string, lines array<string>")
    got = {(r.file, r.lo) for r in E.syntax_chunks(df).collect()}
    assert ("a.py", 3) in got and ("b.txt", 0) in got and ("c.py", 0) in got


def test_task_generators(spark):
    lines = ["LIMIT_VALUE = 3", "def load_things(path):", "    raise ValueError('the path is not readable')", "", "x = os.getenv('HOME_DIR')"]
    rows = [("src/a.py", i, x) for i, x in enumerate(lines)] + [("src/b.py", 0, "y = load_things(1)"), ("tests/test_a.py", 0, "load_things(2)"), ("z.rs", 0, "pub fn crate_it() {")]
    df = spark.createDataFrame(rows, "file string, line_no int, line string")
    assert [r.name for r in E.symbol_tasks(df).collect()] == ["load_things"]
    assert [r.file for r in E.call_tasks(df).collect()] == ["src/b.py"]
    assert [r.query for r in E.error_tasks(df).collect()] == ["the path is not readable"]
    assert {r.key for r in E.config_tasks(df).collect()} == {"LIMIT_VALUE", "HOME_DIR"}
    assert [r.file for r in E.test_tasks(df).collect()] == ["tests/test_a.py"]
    assert [r.name for r in E.cross_language_tasks(df, "rust").collect()] == ["crate_it"]


def test_file_recall_and_messages(spark):
    df = spark.createDataFrame([(["a"], ["a", "b"]), ([], ["c"])], "named array<string>, gt_files array<string>")
    assert [(r.file_recall, r.correct) for r in E.file_recall(df).collect()] == [(0.5, True), (0.0, False)]
    log = spark.createDataFrame([(1, "Fix the parser of dates in tables", 2, 20), (2, "Merge branch of long names here", 1, 9), (3, "short", 1, 9)], "commit_id int, subject string, files int, changed int")
    kept = E.session_commits(log).select(E.query_from_message(F.col("subject")).alias("q")).collect()
    assert [r.q for r in kept] == ["parser|dates|tables"]


def test_replacement_escalates_and_fails_open(spark, tmp_path):
    body = "".join(f"def handler_{i}(event):\n" + "".join(f"    step_{j} = event.value + {i}\n" for j in range(10)) + "\n" for i in range(60))
    path = tmp_path / "big.py"
    path.write_text(body)
    result, budget, raised = ST.escalated(spark, str(path), ["handler", "event"], start=150, most=600)
    assert raised >= 1 and budget <= 600
    text = ST.replacement(spark, str(path), body, ["handler_7"])
    assert "FILE MAP" in text and "handler_7" in text
    assert ST.replacement(spark, str(path), "", []) is None


def test_first_seen_stream(spark, tmp_path):
    rows = [(1, "a", "2024-01-01 00:00:00"), (1, "a", "2024-01-01 00:00:05"), (2, "a", "2024-01-01 00:00:06")]
    df = spark.createDataFrame(rows, "session int, path string, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = ST.first_seen_stream(stream, ["session", "path"], "ts").writeStream.format("memory").queryName("firsts").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("firsts").count() == 2


def test_focus_stream(spark, tmp_path):
    rows = [(1, 0, "user", "please fix parse_config soon"), (1, 1, "assistant", "reading parse_config"), (1, 2, "system", "ignored_thing")]
    df = spark.createDataFrame(rows, "session bigint, turn bigint, role string, text string")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = ST.focus_stream(stream).writeStream.format("memory").queryName("focus").outputMode("update").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {r.term: r.weight for r in spark.table("focus").collect()}
    batch = {r.term: r.weight for r in ST.focus_terms(df).collect()}
    assert got == batch and max(got, key=got.get) == "parse_config"


def test_transcript(spark, tmp_path):
    (tmp_path / "t.jsonl").write_text('{"message":{"role":"user","content":"hello"}}\n{"message":{"role":"assistant","content":[{"type":"text","text":"a"},{"type":"tool"}]}}\nbroken\n')
    assert [(r.role, r.text) for r in T.transcript(spark, str(tmp_path / "t.jsonl")).orderBy("turn").collect()] == [("user", "hello"), ("assistant", "a")]


def test_everything_is_returned_without_a_budget(spark):
    rows = [(f"f{i:04}.py", "needle here\n") for i in range(3000)]
    source = spark.createDataFrame(rows, "file string, text string")
    whole = focused_read(spark, source, "needle", semantic=False)
    assert len(whole.chunks) == 3000 and whole.omitted == [] and whole.coverage == 1.0
    some = focused_read(spark, source, "needle", budget=40, semantic=False)
    places = {(c.file, c.line_start) for c in [*some.chunks, *some.omitted]}
    assert len(places) == 3000 and len(some.chunks) + len(some.omitted) == 3000
    assert all(o.file for o in some.omitted)


def test_dense_recall_joins_a_vague_query(spark):
    rows = [("a.py", "def alpha_one():\n    pass\n"), ("b.py", "def other():\n    return 1\n"), ("c.py", "def third():\n    return 2\n")]
    source = spark.createDataFrame(rows, "file string, text string")
    vectors = spark.createDataFrame([("a.py", 0, [0.1, 1.0]), ("b.py", 0, [1.0, 0.1]), ("c.py", 0, [-1.0, 0.0])], "file string, lo int, vector array<double>")
    plain = focused_read(spark, source, "alpha|beta1|gamma", budget=500)
    dense = focused_read(spark, source, "alpha|beta1|gamma", budget=500, vectors=vectors, asked=[1.0, 0.0])
    assert "b.py" not in {c.file for c in plain.chunks}
    found = {c.file: c.rank_reason for c in dense.chunks}
    assert found["b.py"] == ["semantic-recall"] and "a.py" in found and "c.py" not in found
    precise = focused_read(spark, source, "alpha_one", budget=500, vectors=vectors, asked=[1.0, 0.0])
    assert "b.py" not in {c.file for c in precise.chunks}


def test_links_of_similar_documents_by_brute_force(spark):
    rng = random.Random(3)
    pool = [f"line {i}" for i in range(30)]
    sets = [[rng.choice(pool) for _ in range(rng.randrange(0, 8))] for _ in range(120)] + [["common"] + [f"own {i}"] for i in range(40)] + [["common"]] * 30
    sets += [[*s, " "] for s in sets[:20]] + [[s, "x", "y", "z"] for s in pool[:10]]
    docs = spark.createDataFrame(list(enumerate(sets)), "file long, code_lines array<string>")
    got = {r.file: (r.class_id, r.links) for r in C.near_duplicate_links(docs, 0.5).collect()}
    plain = [frozenset(x.strip() for x in s if x.strip()) for s in sets]
    first = {s: i for i, s in reversed(list(enumerate(plain)))}
    links = {s: sum(1 for t in first if t != s and s & t and len(s & t) / len(s | t) >= 0.5) for s in first}
    assert got == {i: (first[s], links[s]) for i, s in enumerate(plain)}


def test_blocks_of_many_lines_agree_with_the_procedure():
    rng = random.Random(5)
    kinds = ["def f{i}():", "class C{i} {", "if (a{i}) {", "} else {", "}", "", "# note", "x{i} = {{}}", "fn g{i}() {{ a }}", "    return {i}", "}}", "{{"]
    for _ in range(300):
        lines = [" " * 4 * rng.randrange(3) + rng.choice(kinds).replace("{i}", str(i)) for i in range(rng.randrange(1, 50))]
        targets = sorted(rng.sample(range(len(lines)), rng.randrange(1, len(lines) + 1)))
        for language in ("python", "c_like", "brace"):
            assert S.enclosing_blocks(lines, targets, language) == [S.enclosing_block(lines, t, language) for t in targets], (language, lines)


def test_regions_of_a_long_file_take_linear_time(spark):
    n = 8000
    lines = [x for i in range(n) for x in (f"def part_{i}(size):", "    # note", "    total = size", "    return total", "")]
    hits = S.with_hits(spark.createDataFrame([("long.py", lines)], "file string, lines array<string>"), ["return", "size"])
    began = time.monotonic()
    rows = S.function_regions(hits, 1, code=False).collect()
    around = S.windows(hits, 1, 1, 1)
    assert "lines" not in around.columns
    wide = around.select("first", "lo", "hi", "code_lines").collect()
    assert time.monotonic() - began < 40  # each run carried its whole file: 16,000 copies of 40,000 lines
    assert sorted((r["first"], r["last"], r["lo"], r["hi"], r["symbol"]) for r in rows) == sorted(
        (5 * i + a, 5 * i + b, 5 * i, 5 * i + 5, f"part_{i}") for i in range(n) for a, b in ((0, 0), (2, 3))
    )
    assert all(r["code_lines"] == lines[r["lo"] : r["hi"]] and r["lo"] == max(0, r["first"] - 1) for r in wide) and len(wide) == 2 * n


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def _history(spark, commits: int, seed: int):
    rng = random.Random(seed)
    rows = [(c, 86400 * c, f"f{f}", rng.randrange(1, 9)) for c in range(commits) for f in rng.sample(range(12), rng.randrange(1, 13))]
    return rows, spark.createDataFrame(rows, "commit_id int, ts long, file string, changed int")


def test_pairs_go_through_the_shuffle_once_and_unpacked(spark):
    rows, df = _history(spark, 60, 7)
    members = {}
    for c, _, f, _ in rows:
        members.setdefault(c, set()).add(f)
    wanted = Counter((a, b) for m in members.values() if 2 <= len(m) <= 10 for a in m for b in m if a != b)
    found = H.pairs(df.unionByName(df))  # a file twice in a commit counts once
    assert {(r.a, r.b): r.n for r in found.collect()} == wanted
    plan = _plan(found)
    assert "REPARTITION_BY_NUM" in plan and "ENSURE_REQUIREMENTS" not in plan.split("REPARTITION_BY_NUM")[0]  # counted where they are dealt
    assert re.search(r"Filter[^\n]*a#\d+ < b#\d+", plan)


def test_only_the_anchors_commits_make_pairs(spark):
    rows, df = _history(spark, 60, 8)
    anchors = spark.createDataFrame([("f1", 0.75), ("f5", 0.25)], "anchor string, weight double")
    wanted = {(r.a, r.b, r.n) for r in H.pairs(df).collect() if r.a in ("f1", "f5")}
    found = H.anchored_pairs(df, anchors)
    assert {tuple(r) for r in found.collect()} == wanted and wanted
    plan = _plan(H.cochange_scores(df, anchors))
    assert "REPARTITION_BY_NUM" not in plan and re.search(r"BroadcastHashJoin \[a#\d+\], \[a#\d+\], LeftSemi", plan)  # before b is made
    total = len({c for c, *_ in rows})
    raw = {}
    times = Counter(f for _, _, f, _ in rows)
    weights = {"f1": 0.75, "f5": 0.25}
    for a, b, n in wanted:
        lift = math.log((n / total + 1 / (4 * total)) / (times[a] / total * times[b] / total + 1 / (4 * total)))
        if lift > 0:
            raw[b] = raw.get(b, 0) + weights[a] * lift
    got = {r.file: r.c for r in H.cochange_scores(df, anchors).collect()}
    assert got == pytest.approx({f: v / max(raw.values()) for f, v in raw.items()})


def test_churn_counts_a_commits_files_without_meeting_itself(spark):
    rows, df = _history(spark, 20, 9)
    found = H.churn(df)
    assert "SortMergeJoin" not in _plan(found) and "BroadcastHashJoin" not in _plan(found)
    files = Counter(c for c, *_ in rows)
    now = max(ts for _, ts, _, _ in rows)
    sums = {}
    for c, ts, f, changed in rows:
        sums[f] = sums.get(f, 0) + math.log(1 + changed) / math.sqrt(files[c]) * math.exp(-(now - ts) / (90 * 86400))
    raw = {f: math.log(1 + s) for f, s in sums.items()}
    assert {r.file: r.w for r in found.collect()} == pytest.approx({f: v / max(raw.values()) for f, v in raw.items()})


def test_a_hunks_symbol_is_found_once(spark):
    contexts = ["def part_1(size):", "def _x12(a):", "import foo", "def abc(x)", "self.call_me(x)", None, "class print:"]
    df = spark.createDataFrame([(1, c) for c in contexts * 2], "commit_id int, context string")
    found = H.hunk_symbols(df)
    assert sorted(r.symbol for r in found.collect()) == ["call_me", "part_1"]
    assert _plan(found).count("regexp_extract(context") <= 8  # of the partial plan's one generator; conditions repeated it
