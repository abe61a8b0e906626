"""SimHash near-duplicates by meet-in-the-middle ball hashing.

A fingerprint's bit is set if it is set in more than half of its shingles'
64-bit hashes.  Two fingerprints within distance 2r both lie within r of some
middle value, so each distinct fingerprint emits every value within r of
itself; a shuffle brings together those that share a value.  By the triangle
inequality whatever meets is within 2r, which is verified all the same.  With
distinct fingerprints and r = 1 a value has at most ``bits + 1`` fingerprints,
and a fingerprint meets at most ``bits * (bits + 1) / 2`` others, so neither
grows with a group of copies.

``near_duplicate_classes`` (whole documents, small changes) uses one 64-bit
fingerprint.  ``sketch_classes`` (similarity 0.8 on five-word shingles, whose
fingerprints differ in more bits) cuts a longer fingerprint into sections, ball
hashes each section by itself, and compares the shingle sets of what meets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import discard, materialise, release_shuffles, small_batches, text_of, worker_cache

SEED = 42
SECTIONS_AT_A_TIME = 3  # whose variants are on disk together
BLOCK = 2_040  # shingles hashed and counted at a time (eight times 255), so memory does not follow the text
_MIX = 0x9E3779B97F4A7C15


def word_list(text: str) -> list[bytes]:
    """A-Z lower-cased, cut at ASCII white space (9-13 and 32), as bytes.split does."""
    return text.encode("utf-8", "surrogatepass").lower().split()


def shingle_hashes(words: list[bytes], width: int) -> Iterator[np.ndarray]:
    """XXH64 of each shingle, in blocks; one shingle of all words if there are fewer than ``width``."""
    if not words:
        return
    count = max(1, len(words) - width + 1)
    digest = xxhash.xxh64_intdigest
    for start in range(0, count, BLOCK):
        stop = min(count, start + BLOCK)
        columns = [words[start + k : stop + k] for k in range(min(width, len(words)))]
        shingles = map(b" ".join, zip(*columns, strict=False))
        yield np.fromiter(map(digest, shingles, repeat(SEED)), np.uint64, stop - start)


def widen(hashes: np.ndarray, lanes: int) -> np.ndarray:
    """``lanes`` well mixed 64-bit values of each hash; the first is the hash itself."""
    x = hashes[:, None] + np.uint64(_MIX) * np.arange(lanes, dtype=np.uint64)
    if lanes > 1:
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
        x[:, 0] = hashes
    return x


def votes_of(hashes: np.ndarray, lanes: int) -> np.ndarray:
    """How many of the hashes set each bit, in the order of the bytes in memory (the least significant byte of a lane first)."""
    bits = np.unpackbits(widen(hashes, lanes).astype("<u8", copy=False).view(np.uint8).reshape(len(hashes), 8 * lanes), axis=1)
    votes = np.zeros(64 * lanes, np.int64)
    for part in range(0, len(bits), 255):  # sums of 255 bits fit the narrow type, which is much faster
        votes += np.add.reduce(bits[part : part + 255], axis=0, dtype=np.uint8)
    return votes


def majority(votes: np.ndarray, total: int) -> bytes:
    """The bits set in more than half, the most significant byte of each lane first."""
    return np.packbits(2 * votes > total).view("<u8").astype(">u8").tobytes()


def fingerprint(text: str, width: int, lanes: int = 1) -> bytes:
    """``8 * lanes`` bytes, the most significant first; zeros for a text without words."""
    votes, total = np.zeros(64 * lanes, np.int64), 0
    for hashes in shingle_hashes(word_list(text), width):
        votes += votes_of(hashes, lanes)
        total += len(hashes)
    return majority(votes, total)


def fingerprints(docs: DataFrame, width: int, lanes: int, id_col: str, text_col: str) -> DataFrame:
    """``id, fp`` (binary): one row for each row."""
    small_batches(docs.sparkSession)
    source = docs.select(docs[id_col].alias("id"), text_of(docs[text_col]).alias("body"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache("simhash")
        for batch in batches:
            found = [fingerprint(text, width, lanes) for text in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], names=["id", "fp"])

    return source.mapInArrow(run, f"id {source.schema['id'].dataType.simpleString()}, fp binary")


def as_long(fp: Column, first_byte: int = 0, size: int = 8) -> Column:
    """A big-endian signed number out of some bytes of a binary column."""
    digits = F.hex(F.substring(fp, first_byte + 1, size))
    return F.conv(digits, 16, -10).cast("bigint")


def near_keys(keys: DataFrame, bits: int) -> DataFrame:
    """``k1 < k2``: all pairs of distinct keys within distance 2.

    ``keys`` has ``key`` (a number), whose low ``bits`` bits count; what stands
    above them must be equal.  Each key emits the values within distance 1 of
    itself, and two keys meet at a value.  A value where just two meet, as nearly
    all do, gives them by its least and greatest key; the members of others are
    looked up from the value.  The partitions are set beforehand, for what is
    read grows by the number of variants.
    """
    parts = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    flips = [0, *(-(2**63) if i == 63 else 2**i for i in range(bits))]
    masks = F.array(*(F.lit(m).cast("bigint") for m in flips))
    each = keys.select("key").repartition(parts, "key").distinct()
    variants = each.select("key", F.explode(masks).alias("mask")).select(F.col("key").bitwiseXOR(F.col("mask")).alias("value"), "key")
    met = materialise(
        variants.repartition(parts, "value").groupBy("value").agg(F.min("key").alias("k1"), F.max("key").alias("k2"), F.count("*").alias("n")).where("n > 1"), "met"
    )
    members = (
        met.where("n > 2").select("value", F.explode(masks).alias("mask"))
        .select("value", F.col("value").bitwiseXOR(F.col("mask")).alias("key"))
        .join(each, "key").groupBy("value").agg(F.collect_list("key").alias("met"))  # at most bits + 1
    )
    rest = members.select("met", F.explode("met").alias("k1")).select("k1", F.explode("met").alias("k2")).where("k1 < k2")
    return met.where("n = 2").select("k1", "k2").unionByName(rest).distinct()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``node, root``: the smallest node reachable over ``edges (a, b)``; only nodes with an edge appear.

    Alternating large-star and small-star rounds.  Every round is written to
    the shared folder, so lineage stays short and a lost executor costs one
    round; only a count and a checksum reach the driver.
    """
    pairs = materialise(
        edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "cc"
    )
    seen = None
    for _ in range(max_rounds):
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        floor = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            large.join(floor, "a")
            .select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e"))
            .select("e.a", "e.b")
            .where("a <> b")
            .distinct()
        )
        settled = materialise(small, "cc")
        discard(pairs)
        pairs = settled
        now = pairs.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(now) == seen:
            break
        seen = tuple(now)
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return pairs.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        pairs.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )


def near_duplicate_classes(
    docs: DataFrame, words: int = 3, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``id_col, fingerprint, component_id`` for each row; links at distance 2 or less.

    ``fingerprint`` is 16 lower-case hex digits.  ``component_id`` is the
    smallest id reachable over links, the row's own id included.  Null and
    empty texts have the zero fingerprint, which links like any other.  Repeated
    rows repeat; a null id takes its component from the others (null if there
    are none).  Columns other than the two named are not read.
    """
    found = materialise(
        fingerprints(docs, words, 1, id_col, text_col).select("id", as_long(F.col("fp")).alias("key")), "simhash"
    )
    nodes = found.groupBy("key").agg(F.min("id").alias("least"))
    edges = near_keys(nodes, 64).where(F.bit_count(F.col("k1").bitwiseXOR(F.col("k2"))) <= 2)
    linked = components(edges.select(F.col("k1").alias("a"), F.col("k2").alias("b")))
    rooted = nodes.join(linked, nodes["key"] == linked["node"], "left").select(
        "key", "least", F.coalesce("root", "key").alias("root")
    )
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = rooted.join(named, "root").select("key", "component_id")
    return found.join(classes, "key").select(
        F.col("id").alias(id_col), F.lower(F.lpad(F.hex("key"), 16, "0")).alias("fingerprint"), "component_id"
    )


def bit_limit(similarity: float, bits: int, deviations: float = 5.0) -> int:
    """Differing bits up to which two shingle sets may have this Jaccard similarity.

    Shared shingles are 2J/(1+J) of either of two equal sets, which is their
    cosine c (sets of unequal size have a greater one); a bit differs with
    probability p = arccos(c)/pi.  The limit is the expected number plus so many
    standard deviations, for it only chooses what is compared by its shingles.
    """
    cosine = 2 * similarity / (1 + similarity)
    differs = math.acos(cosine) / math.pi
    return min(bits, math.floor(bits * differs + deviations * math.sqrt(bits * differs * (1 - differs))))


def sketch(text: str, width: int, lanes: int) -> tuple[int, bytes, np.ndarray]:
    """A number for the text's set of shingles, the set's fingerprint, and the set (sorted hashes)."""
    grams = np.unique(np.concatenate([np.empty(0, np.uint64), *shingle_hashes(word_list(text), width)]))
    votes = np.zeros(64 * lanes, np.int64)
    for start in range(0, len(grams), BLOCK):
        votes += votes_of(grams[start : start + BLOCK], lanes)
    node = xxhash.xxh64_intdigest(grams.tobytes(), seed=SEED)
    return node - (1 << 64 if node >> 63 else 0), majority(votes, len(grams)), grams.view(np.int64)


def sketches(docs: DataFrame, width: int, lanes: int, id_col: str, text_col: str) -> DataFrame:
    """``id, node, fp, grams``: one row for each row; equal sets of shingles have equal nodes."""
    small_batches(docs.sparkSession)
    source = docs.select(docs[id_col].alias("id"), text_of(docs[text_col]).alias("body"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache("simhash")
        for batch in batches:
            found = [sketch(text, width, lanes) for text in batch.column(1).to_pylist()]
            node, fp, grams = zip(*found, strict=True) if found else ((), (), ())
            columns = [batch.column(0), pa.array(node, pa.int64()), pa.array(fp, pa.binary()), pa.array(grams, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "node", "fp", "grams"])

    return source.mapInArrow(run, f"id {source.schema['id'].dataType.simpleString()}, node bigint, fp binary, grams array<bigint>")


def star_edges(keys: DataFrame, near: DataFrame) -> DataFrame:
    """``a, b``: each node to the smallest of its key, and that one to the smallest of the keys near."""
    leaders = keys.groupBy("key").agg(F.min("node").alias("leader"))
    same = keys.join(leaders, "key").where("node <> leader").select(F.col("node").alias("a"), F.col("leader").alias("b"))
    one = leaders.select(F.col("key").alias("k1"), F.col("leader").alias("l1"))
    two = leaders.select(F.col("key").alias("k2"), F.col("leader").alias("l2"))
    met = near.join(one, "k1").join(two, "k2").select(F.greatest("l1", "l2").alias("a"), F.least("l1", "l2").alias("b"))
    return same.unionByName(met.where("a <> b").groupBy("a").agg(F.min("b").alias("b")))


def apart(keys: DataFrame, near: DataFrame) -> DataFrame:
    """``a, b``: all pairs of nodes of different ``root`` whose keys are equal or near.

    Keys that hold one root only, alone or with all keys near, are left out
    before nodes are paired, so a group that is one class already makes no pairs.
    """
    held = keys.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"))
    one = held.select(F.col("key").alias("k1"), F.col("low").alias("low1"), F.col("high").alias("high1"))
    two = held.select(F.col("key").alias("k2"), F.col("low").alias("low2"), F.col("high").alias("high2"))
    mixed = near.join(one, "k1").join(two, "k2").where("low1 <> high1 or low2 <> high2 or low1 <> low2").select("k1", "k2")
    mixed = mixed.unionByName(held.where("low <> high").select(F.col("key").alias("k1"), F.col("key").alias("k2")))
    left = keys.select(F.col("key").alias("k1"), F.col("node").alias("n1"), F.col("root").alias("r1"), F.col("size").alias("s1"), F.col("fp").alias("f1"))
    right = keys.select(F.col("key").alias("k2"), F.col("node").alias("n2"), F.col("root").alias("r2"), F.col("size").alias("s2"), F.col("fp").alias("f2"))
    return mixed.join(left, "k1").join(right, "k2").where("r1 <> r2 and (k1 < k2 or n1 < n2)")


def sketch_classes(
    docs: DataFrame,
    id_col: str,
    text_col: str,
    words: int = 5,
    similarity: float = 0.8,
    lanes: int = 16,
    section_bits: int = 32,
) -> DataFrame:
    """``id, fp, root`` (root: smallest id of the class); links at Jaccard similarity ``similarity`` or more.

    ``id`` must be distinct.  Rows with equal sets of shingles are one node, so
    a group of copies costs one.  Each of the ``2 * lanes`` sections is ball
    hashed at distance 2.  What meets is first put in stars; a pair is compared
    by its distinct shingles if its bits allow it.  Whatever met and is not in
    one class after that is compared pair by pair, members of equal sections
    too.  Meeting is a matter of chance that falls with the distance: see the
    README's figures.  Sections go through a few at a time, so that disk holds
    few variants at once.
    """
    spark = docs.sparkSession
    found = materialise(sketches(docs, words, lanes, id_col, text_col), "sketch")
    nodes = found.groupBy("node").agg(F.min("id").alias("least"), F.first("fp").alias("fp"), F.first(F.size("grams")).alias("size"))
    nodes = materialise(nodes, "nodes")
    width, total, limit = section_bits // 8, 8 * lanes // (section_bits // 8), bit_limit(similarity, 64 * lanes)
    groups = [range(start, min(total, start + SECTIONS_AT_A_TIME)) for start in range(0, total, SECTIONS_AT_A_TIME)]

    def keyed(frame: DataFrame, group: range) -> DataFrame:
        sections = F.array(*(as_long(F.col("fp"), i * width, width) + F.lit(i << section_bits) for i in group))
        return frame.select("*", F.explode(sections).alias("key"))

    def allowed(pairs: DataFrame) -> DataFrame:
        """Of ``n1, f1, s1, n2, f2, s2`` the pairs that sizes and bits allow: ``a, b, d``."""
        differ = sum(F.bit_count(as_long(F.col("f1"), 8 * i).bitwiseXOR(as_long(F.col("f2"), 8 * i))) for i in range(lanes))
        sized = F.least("s1", "s2") / F.greatest("s1", "s2") >= similarity
        return pairs.where(sized).select(F.greatest("n1", "n2").alias("a"), F.least("n1", "n2").alias("b"), differ.alias("d")).where(F.col("d") <= limit)

    def similar(pairs: DataFrame) -> DataFrame:
        """Of ``a, b`` those whose sets of shingles have the similarity."""
        ends = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        owners = nodes.join(ends, "node", "left_semi").select(F.col("least").alias("id"))
        sets = materialise(found.join(owners, "id").select("node", "grams"), "sets")
        shared = F.size(F.array_intersect("ga", "gb"))
        both = pairs.join(sets.select(F.col("node").alias("a"), F.col("grams").alias("ga")), "a").join(
            sets.select(F.col("node").alias("b"), F.col("grams").alias("gb")), "b"
        )
        linked = materialise(both.where(shared / (F.size("ga") + F.size("gb") - shared) >= similarity).select("a", "b"), "links")
        discard(sets)
        return linked

    def classed(links: DataFrame) -> DataFrame:
        linked = components(links)
        return materialise(nodes.join(linked, "node", "left").withColumn("root", F.coalesce("root", "node")), "classes")

    ends = [nodes.select(F.col("node").alias(f"n{k}"), F.col("fp").alias(f"f{k}"), F.col("size").alias(f"s{k}")) for k in (1, 2)]
    nears, rounds = [], []
    for group in groups:
        keys = keyed(nodes, group).select("node", "key")
        nears.append(materialise(near_keys(keys, section_bits), "near"))
        stars = star_edges(keys, nears[-1]).distinct().select(F.col("a").alias("n1"), F.col("b").alias("n2"))
        rounds.append(materialise(allowed(stars.join(ends[0], "n1").join(ends[1], "n2")), "stars"))
        del keys, stars
        release_shuffles(spark)
    stars = materialise(reduce(DataFrame.unionByName, rounds).distinct(), "stars")
    discard(*rounds)

    # The smallest and the nearest star of each node make most classes; the other stars are tried where classes still differ.
    first = stars.groupBy("a").agg(F.min("b").alias("b"), F.min_by("b", F.struct("d", "b")).alias("c"))
    links = similar(first.select("a", F.explode(F.array_distinct(F.array("b", "c"))).alias("b")))
    rooted = classed(links)
    roots = [rooted.select(F.col("node").alias(x), F.col("root").alias(f"r{x}")) for x in "ab"]
    links = links.unionByName(similar(stars.join(roots[0], "a").join(roots[1], "b").where("ra <> rb").select("a", "b")))
    rooted = classed(links)

    rounds = []
    for group, near in zip(groups, nears, strict=True):
        keys = keyed(rooted, group).select("node", "root", "size", "fp", "key")
        rounds.append(materialise(allowed(apart(keys, near)).select("a", "b").distinct(), "apart"))
        discard(near)
        del keys
        release_shuffles(spark)
    rest = reduce(DataFrame.unionByName, rounds).distinct().join(stars, ["a", "b"], "left_anti")
    rooted = classed(links.unionByName(similar(rest)))
    named = rooted.groupBy("root").agg(F.min("least").alias("first"))
    classes = rooted.join(named, "root").select("node", F.col("first").alias("root"))
    return found.select("id", "fp", "node").join(classes, "node").select("id", "fp", "root")


def keep_one(docs: DataFrame, words: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each class of similar documents, all columns as they were.

    The row kept is the one of smallest id.  Rows are told apart by id and
    text, so rows that repeat both, or have no id, count as copies too.  Texts
    without a word are copies of each other.
    """
    docs = docs.withColumn("__row", F.struct(F.coalesce(F.col(id_col).cast("bigint"), F.lit(2**63 - 1)).alias("id"), F.xxhash64(text_of(text_col)).alias("h")))
    found = sketch_classes(docs, "__row", text_col, words, similarity)
    kept = found.where("id = root").select(F.col("id").alias("__kept")).distinct()
    return docs.join(kept, F.col("__row") == F.col("__kept"), "left_semi").dropDuplicates(["__row"]).drop("__row")
