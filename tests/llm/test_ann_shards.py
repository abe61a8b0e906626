from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleaner.llm import ann, shards


def brute(ids, x, every, k):
    out = {}
    for i, v in zip(ids, x, strict=True):
        if i % every == 0:
            far = np.sqrt(((x - v) ** 2).sum(1))
            order = [j for j in np.lexsort((ids, far)) if ids[j] != i][:k]
            out[i] = [(int(ids[j]), far[j]) for j in order]
    return out


def test_hilbert_neighbours_touch():
    side = np.stack(np.meshgrid(*[np.arange(8)] * 3, indexing="ij"), -1).reshape(-1, 3)
    keys = ann.hilbert_keys(side, 3)
    assert sorted(keys) == list(range(512))
    walk = side[np.argsort(keys)]
    assert (np.abs(np.diff(walk, axis=0)).sum(1) == 1).all()


@pytest.mark.parametrize("spread", [0.05, 5.0])
def test_recall_against_brute_force(spark, spread):
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((12, 16))
    x = (centres[rng.integers(0, 12, 2500)] + spread * rng.standard_normal((2500, 16))).astype(np.float32)
    ids = rng.permutation(2500)
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x, strict=True)], "vec_id long, embedding array<float>")
    got = ann.search(df, every=25).toPandas()
    want = brute(ids, x.astype(float), 25, 10)
    hits = sum(len({j for j, _ in want[q]} & set(g.vec_id)) for q, g in got.groupby("query_id"))
    assert got.query_id.nunique() == 100 and hits / 1000 >= 0.9
    place = {int(i): v for i, v in zip(ids, x.astype(float), strict=True)}
    exact = [np.sqrt(((place[r.query_id] - place[r.vec_id]) ** 2).sum()) for r in got.itertuples()]
    assert np.allclose(got.score, exact, atol=1e-12)


@pytest.mark.parametrize("clusters", [1, 2])
def test_vectors_far_from_the_origin(spark, clusters):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((800, 8)) + 1e8 * (1 + rng.integers(0, clusters, (800, 1)))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = ann.search(df, every=20).toPandas()
    want = brute(np.arange(800), x, 20, 10)
    hits = sum(len({j for j, _ in want[q]} & set(g.vec_id)) for q, g in got.groupby("query_id"))
    assert got.query_id.nunique() == 40 and hits / 400 >= 0.9


def test_nearest_is_exact_where_products_round():
    rng = np.random.default_rng(6)
    for scale in (1.0, 1e8):
        x = rng.standard_normal((500, 8)) + scale * rng.integers(0, 2, (500, 1))
        least = rng.permutation(500)
        allowed = rng.random((20, 500)) < 0.9
        for row, cols, far in ann.nearest(x[:20], x, allowed, least, 11):
            exact = np.sqrt(((x - x[row]) ** 2).sum(1))
            want = [j for j in np.lexsort((least, exact)) if allowed[row, j]][:11]
            assert cols.tolist() == want and (far == exact[want]).all()


def test_recall_on_the_embeddings(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    got = ann.search(table).toPandas()
    all_rows = table.select("vec_id", "embedding").toPandas()
    x = np.array(all_rows.embedding.tolist(), float)
    want = brute(all_rows.vec_id.to_numpy(), x, 100, 10)
    hits = sum(len({j for j, _ in want[q]} & set(g.vec_id)) for q, g in got.groupby("query_id"))
    assert hits >= 0.9 * sum(len(w) for w in want.values()) and got.query_id.nunique() == len(want)


def test_windows_of_structured_vectors_are_small():
    rng = np.random.default_rng(1)
    sample = rng.standard_normal((4096, 3)) @ rng.standard_normal((3, 32))
    used, share = ann.fitted_windows(sample, ann.Curves(sample), 10, 0.97)
    assert used >= ann.LEAST_CURVES and used * share <= 0.6


def test_ties_copies_and_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(i, [1.0, 2.0]) for i in range(0, 40)] + [(i, [float(i), 0.5]) for i in range(100, 130)]
    rows += [(200, None), (300, [0.0, 0.0]), (400, [1.0, None]), (500, [nan, 1.0]), (600, [inf, 1.0]), (None, [1.0, 2.0]), (700, []), (800, [1.0, 2.0, 3.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("rank", F.lit(1)).withColumn("score", F.lit("x"))
    got = ann.search(df, every=100).toPandas()
    by = {q: g.sort_values("rank") for q, g in got.groupby("query_id")}
    assert set(by) == {0, 100}
    assert by[0].vec_id.tolist() == list(range(1, 11)) and (by[0].score == 0).all()
    ids = np.array([r[0] for r in rows[:70]])
    x = np.array([r[1] for r in rows[:70]])
    assert by[100].vec_id.tolist() == [j for j, _ in brute(ids, x, 100, 10)[100]]
    assert ann.search(df.limit(0)).count() == 0


def test_fewer_than_ten(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [0.0, 3.0])], "vec_id long, embedding array<double>")
    assert [(r.rank, r.vec_id) for r in ann.search(df).orderBy("rank").collect()] == [(1, 1), (2, 2)]


@pytest.fixture()
def store(spark, tmp_path):
    return shards.ShardStore(spark, str(tmp_path / "store"))


def rows(spark, start, n):
    return spark.range(start, start + n, numPartitions=2).select("id", F.repeat(F.sha2(F.col("id").cast("string"), 256), 4).alias("text"))


def test_arrivals_compaction_and_versions(spark, store):
    assert store.manifest() == (0, []) and store.read() is None
    for k in range(6):
        assert store.append(rows(spark, 100 * k, 100)) == k + 1
    before = store.manifest()
    last = store.compact(target=60_000, fan_in=4, base=4_000)
    version, after = store.manifest()
    assert version == last > 6 and len(after) < len(before[1])
    assert all(s.bytes <= 90_000 for s in after)
    assert sorted(r.id for r in store.read().collect()) == list(range(600))
    assert sorted(r.id for r in store.read(3).collect()) == list(range(300))  # older versions stay readable
    assert store.compact(target=60_000, fan_in=4, base=4_000) == last
    store.vacuum(grace_seconds=0)
    assert store.versions() == [last] and store.read().count() == 600


def test_a_second_writer_conflicts(spark, store):
    store.append(rows(spark, 0, 10))
    version, live = store.manifest()
    store.commit(version, live)
    with pytest.raises(shards.Conflict):
        store.commit(version, live)
    assert store.manifest()[0] == version + 1


def test_unnamed_files_are_not_read(spark, store):
    store.append(rows(spark, 0, 10))
    store._write(rows(spark, 1000, 10), "lost")
    assert store.read().count() == 10
    assert store.vacuum() == 0  # too young: its writer may still commit
    assert store.vacuum(grace_seconds=0) >= 1


def test_tiers_group_like_sizes(store):
    def s(n, size):
        return shards.Shard(f"p{n}", size, 1, 0)

    plan = store.plan([*(s(i, 100) for i in range(5)), *(s(10 + i, 1500) for i in range(4)), s(20, 30_000)], 10_000, 4, 100)
    assert sorted(len(r) for r in plan) == [4, 5]
    assert store.plan([s(i, 100) for i in range(3)], 10_000, 4, 100) == []


def test_nulls_and_empty_arrivals(spark, store):
    df = spark.createDataFrame([(None, None), (1, "")], "id long, text string")
    store.append(df)
    store.append(df.limit(0))
    store.append(df)
    store.compact(fan_in=2, base=10_000)
    assert store.read().count() == 4


def test_vacuum_spares_an_arrival_that_is_being_committed(spark, store):
    store.append(rows(spark, 0, 10))
    written = store._write(rows(spark, 10, 10), "arrival")
    store.vacuum()
    store._add(written)
    assert store.read().count() == 20


def test_arrivals_and_compactions_interleave(spark, store, monkeypatch):
    for k in range(5):
        store.append(rows(spark, 100 * k, 100))
    late = shards.ShardStore(spark, store.root)
    write = store._write

    def interrupted(df, label, *by):
        written = write(df, label, *by)
        if label == "merged" and late is not None:
            late.append(rows(spark, 500, 100))  # between the merge and its commit
        return written

    monkeypatch.setattr(store, "_write", interrupted)
    store.compact(fan_in=4, base=1 << 20, max_rounds=1)
    assert sorted(r.id for r in store.read().collect()) == list(range(600))
    assert len(store.manifest()[1]) < 2 + 5 * 2
    late.vacuum(grace_seconds=0)
    assert store.read().count() == 600


def test_a_merge_of_replaced_shards_is_left_out(spark, store, monkeypatch):
    for k in range(5):
        store.append(rows(spark, 100 * k, 100))
    other = shards.ShardStore(spark, store.root)
    write = store._write

    def overtaken(df, label, *by):
        written = write(df, label, *by)
        if len(other.versions()) == 5:
            other.compact(fan_in=4)
        return written

    monkeypatch.setattr(store, "_write", overtaken)
    store.compact(fan_in=4)
    assert sorted(r.id for r in store.read().collect()) == list(range(500))


def test_lots_arrive_in_one_pass(spark, store):
    df = rows(spark, 0, 100).withColumn("lot", F.lit("kept as it is"))
    assert store.append_lots(df, F.col("id") % 3) == [1, 2, 3]
    assert sorted(r.id for r in store.read(1).collect()) == list(range(0, 100, 3))
    assert store.read().columns == df.columns and store.read().count() == 100
    assert store.append_lots(df.limit(0), F.col("id") % 3) == []
