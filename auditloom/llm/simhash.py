"""SimHash fingerprints and near-duplicate groups by covering locality-sensitive hashing.

``masks(radius)`` is a covering family: bit i of a fingerprint gets a non-zero vector of ``radius + 1`` bits, and each
non-zero vector v makes a mask of the bits whose vector has odd parity with v. At most ``radius`` differing bits span
less than the whole space, so some v is orthogonal to all of them: every pair within the radius agrees under one mask.

Defined cases: null and empty texts have no words, fingerprint zero, and link like any other; repeated rows give
repeated results; rows without doc_id take part but never name a group; near duplicates are found
by the text with the smallest md5 where a doc_id has several. No table is collected.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditloom.llm.common import components, cut, fresh, one_text, stored, texts, words

SEED = 42
#: Buckets up to this size are compared pair by pair, larger ones over shared neighbours.
SMALL_BUCKET = 64
SIGNED = np.int64


def masks(radius: int, bits: int = 64) -> list[int]:
    """The covering masks for pairs with at most ``radius`` differing bits, as signed 64-bit numbers."""
    space = (1 << (radius + 1)) - 1
    out = []
    for v in range(1, space + 1):
        mask = sum(1 << i for i in range(bits) if ((i % space + 1) & v).bit_count() & 1)
        out.append(mask - (1 << 64) if mask >> 63 else mask)
    return out


def shingle_hashes(tokens: list[bytes], size: int) -> np.ndarray:
    """XXH64 of every run of ``size`` space-joined words; the whole sequence if it is shorter; none without words."""
    if not tokens:
        return np.zeros(0, np.uint64)
    if len(tokens) < size:
        runs = iter([b" ".join(tokens)])
    else:
        runs = map(b" ".join, zip(*(tokens[i:] for i in range(size)), strict=False))
    return np.fromiter(map(xxhash.xxh64_intdigest, runs, repeat(SEED)), np.uint64)


def fingerprint(hashes: np.ndarray) -> np.uint64:
    """64 bits; a bit is set if it is set in more than half of the hashes."""
    votes = np.zeros(64, np.int64)
    for lo in range(0, len(hashes), 1 << 18):
        part = hashes[lo : lo + (1 << 18)]
        votes += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(votes * 2 > len(hashes), bitorder="little").view(np.uint64)[0]


def fingerprints(docs: DataFrame, size: int = 3) -> DataFrame:
    """``doc_id`` and ``fp`` (long) of every row, from shingles of ``size`` words, repeats included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(shingle_hashes(words(t), size)) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.array(found, np.uint64).view(SIGNED))], ["doc_id", "fp"]
            )

    return texts(docs).mapInArrow(run, "doc_id long, fp long")


def differing(a: Column | str, b: Column | str) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)) if isinstance(a, str) else a.bitwiseXOR(b))


def links(fps: DataFrame, radius: int = 2) -> DataFrame:
    """Edges (``u``, ``v``) between distinct fingerprints that connect exactly those with <= ``radius`` differing bits.

    Buckets of the covering tables with few fingerprints are compared pair by pair. A large bucket is linked in linear
    work: two fingerprints differ in at most 2 bits exactly if flipping at most one bit of each gives the same value,
    so all members that share such a value are tied to the smallest of them.
    """
    if radius > 2:
        raise ValueError("links are built for a radius of 1 or 2")
    family = masks(radius)
    keyed = fps.select("fp").distinct().select(
        "fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in family])).alias("table", "key")
    )
    sizes = keyed.groupBy("table", "key").agg(F.count("*").alias("_n")).where("_n > 1")
    shared = cut(keyed.join(sizes, ["table", "key"]))
    small = shared.where(F.col("_n") <= SMALL_BUCKET)
    pairs = (
        small.select("table", "key", F.col("fp").alias("u"))
        .join(small.select("table", "key", F.col("fp").alias("v")), ["table", "key"])
        .where((F.col("u") < F.col("v")) & (differing("u", "v") <= radius))
        .select("u", "v")
    )
    flips = [F.lit(0).cast("long")] + [F.lit(1 << i if i < 63 else -(1 << 63)).cast("long") for i in range(64)]
    spread = shared.where(F.col("_n") > SMALL_BUCKET).select(
        "fp", "table", "key", F.explode(F.transform(F.array(*flips[: 65 if radius == 2 else 1]), lambda b: F.col("fp").bitwiseXOR(b))).alias("near")
    )
    # a pair of this bucket agrees on the mask, so only flips outside it can meet
    mask = F.element_at(F.array(*[F.lit(m) for m in family]), F.col("table") + 1)
    spread = spread.where(F.col("near").bitwiseAND(mask) == F.col("key"))
    hubs = spread.groupBy("table", "near").agg(F.min("fp").alias("u"), F.count("*").alias("_c")).where("_c > 1")
    tied = spread.join(hubs.select("table", "near", "u"), ["table", "near"]).select("u", F.col("fp").alias("v")).where("u < v")
    return pairs.unionByName(tied).distinct()


def groups(docs: DataFrame, size: int = 3, radius: int = 2) -> DataFrame:
    """Per row: ``doc_id``, ``fingerprint`` (16 hex digits) and ``component_id``, the smallest doc_id of its group."""
    fps = cut(fingerprints(docs, size))
    reach = cut(components(links(fps, radius)).select(F.col("node").alias("fp"), F.col("component").alias("root")))
    first = fps.groupBy("fp").agg(F.min("doc_id").alias("first")).join(reach, "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    named = first.join(first.groupBy("root").agg(F.min("first").alias("component_id")), "root").select("fp", "component_id")
    hexed = F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint")
    return fps.join(named, "fp").select("doc_id", hexed, "component_id")


# ---- near duplicates by shingle similarity --------------------------------------------------------
WIDE = 8  # 64-bit words of the wide fingerprint
PARTS = 8  # parts of a document with fingerprints of their own
#: Odd multipliers that derive further hashes from one.
MULTIPLIERS = np.array([(2 * i + 1) * 0x9E3779B97F4A7C15 % (1 << 64) | 1 for i in range(WIDE)], np.uint64)
ALL_PAIRS = 16  # buckets up to this size are compared pair by pair
LEADERS = 8  # of a larger bucket in the first round after its first members; four times as many in each further one


def mixed(hashes: np.ndarray, i: int) -> np.ndarray:
    x = hashes * MULTIPLIERS[i]
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def sketch(text: str, size: int) -> tuple[str, list[int], list[int]]:
    """(digest of the words, wide fingerprint, covering keys) of one text.

    Besides the fingerprint of the whole set of shingles there are fingerprints of PARTS small parts of it, chosen by
    shingle hash and holding 2 to 4 shingles on average. A similar document has many of the parts unchanged, so its
    keys meet although edits move more bits of the whole fingerprint than a covering family could span.
    """
    tokens = words(text)
    digest = xxhash.xxh3_128_hexdigest(b" ".join(tokens))
    hashes = np.unique(shingle_hashes(tokens, size))
    wide = [fingerprint(mixed(hashes, i)) for i in range(WIDE)]
    keys = [(0, t, int(wide[0]) & m) for t, m in enumerate(masks(2))]
    n = len(hashes)
    if n:
        ratio = n / 3
        exact = np.log2(ratio) if ratio > 1 else 0.0
        scales = {int(exact)} | {max(0, int(exact - 0.33))} | {int(exact + 0.33)}
        scattered = mixed(hashes, 3)
        for scale in sorted(scales):
            slot = scattered & np.uint64((1 << scale) - 1)
            for p in range(min(PARTS, 1 << scale)):
                part = hashes[slot == np.uint64(p)]
                if len(part):
                    fp = int(fingerprint(part))
                    keys += [(1 + scale * PARTS + p, t, fp & m) for t, m in enumerate(masks(1))]
    hashed = [xxhash.xxh64_intdigest(b"%d %d %d" % k) for k in keys]
    return digest, np.array(wide, np.uint64).view(SIGNED).tolist(), np.array(hashed, np.uint64).view(SIGNED).tolist()


def jaccard(a: str, b: str, size: int) -> float:
    x, y = set(shingle_hashes(words(a), size).tolist()), set(shingle_hashes(words(b), size).tolist())
    return len(x & y) / len(x | y) if x or y else 1.0


def _linked(large: DataFrame, reach: DataFrame, similar: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``reach`` (``node``, ``component``) closed over the buckets ``large`` (``key``, ``rep``), as if all pairs were compared.

    Each round takes leaders in every bucket whose members still lie in different components and compares them with all
    members outside their own component, in all such buckets. Members of the largest component lead first: what links
    many documents is in it. A bucket is closed once the members that have not led are in one component, since any other
    pair has been compared or is linked. Copies of one text close in the first rounds; a bucket of documents that only
    share a part costs all its pairs.
    """
    led, most = None, LEADERS
    while True:
        reach = cut(reach)
        state = large.join(reach.withColumnRenamed("node", "rep"), "rep", "left").select("key", "rep", F.coalesce("component", "rep").alias("root"))
        state = state.withColumn("led", F.lit(False)) if led is None else state.join(led.withColumn("_l", F.lit(True)), "rep", "left").select("key", "rep", "root", F.col("_l").isNotNull().alias("led"))
        still = state.where("NOT led").groupBy("key").agg(F.min("root").alias("_a"), F.max("root").alias("_b")).where("_a < _b").select("key")
        state = stored(state.join(still, "key"), "open-buckets")
        if state.isEmpty():
            return reach
        large = state.select("key", "rep")  # a closed bucket stays closed, as components only grow
        weights = state.groupBy("key", "root").agg(F.count("*").alias("_w"))
        order = Window.partitionBy("key").orderBy(F.desc("_w"), "rep")
        ranked = state.where("NOT led").join(weights, ["key", "root"]).withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= most)
        chosen = cut(ranked.select("rep").distinct())
        leads = state.join(chosen, "rep").select("key", F.col("rep").alias("u"), F.col("root").alias("_u"))
        pairs = leads.join(state.where("NOT led"), "key").where(F.col("_u") != F.col("root"))
        found = similar(pairs.select(F.least("u", "rep").alias("u"), F.greatest("u", "rep").alias("v")).distinct())
        reach = components(reach.select(F.col("node").alias("u"), F.col("component").alias("v")).unionByName(found))
        led = chosen if led is None else cut(led.unionByName(chosen))
        most *= 4


def near_duplicates(docs: DataFrame, size: int = 5, similarity: float = 0.8) -> DataFrame:
    """``doc_id`` and ``component_id`` of every document that shares a group with a smaller or larger doc_id.

    Documents with the same words are one class. Class representatives whose covering keys meet are compared: all of
    them in small buckets; in large ones each first with the first member of the bucket and with the first member that
    agrees on one byte of the wide fingerprint, then what is in different groups with further leaders until no pair of
    a bucket is left open (see ``_linked``). A pair's similarity is first estimated on the wide fingerprint; where the
    estimate is not clear it is counted exactly.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sketch(t, size) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([x[0] for x in found], pa.string()),
                    pa.array([x[1] for x in found], pa.list_(pa.int64())),
                    pa.array([x[2] for x in found], pa.list_(pa.int64())),
                ],
                ["doc_id", "digest", "wide", "keys"],
            )

    plain = one_text(texts(docs).where("doc_id IS NOT NULL"))
    sketches = cut(plain.mapInArrow(run, "doc_id long, digest string, wide array<long>, keys array<long>"))
    classes = cut(sketches.groupBy("digest").agg(F.min("doc_id").alias("rep")))
    reps = sketches.join(classes.select(F.col("rep").alias("doc_id"), "digest"), ["doc_id", "digest"]).dropDuplicates(["doc_id"])
    reps = cut(reps.select(F.col("doc_id").alias("rep"), "wide", "keys"))
    keyed = reps.select(
        "rep", F.col("wide"), F.explode(F.array_distinct("keys")).alias("key")
    ).select("rep", "key", F.shiftrightunsigned(F.get("wide", F.pmod("key", F.lit(WIDE)).cast("int")), 56).alias("byte"))
    leaders = keyed.groupBy("key").agg(F.min("rep").alias("lead"), F.count("*").alias("_n")).where("_n > 1")
    shared = cut(keyed.join(leaders, "key"))
    small = shared.where(F.col("_n") <= ALL_PAIRS).select("key", "rep")
    large = shared.where(F.col("_n") > ALL_PAIRS)
    second = large.groupBy("key", "byte").agg(F.min("rep").alias("lead"))
    candidates = (
        small.select("key", F.col("rep").alias("u")).join(small.select("key", F.col("rep").alias("v")), "key").select("u", "v")
        .unionByName(large.select(F.col("lead").alias("u"), F.col("rep").alias("v")))
        .unionByName(large.select("key", "byte", "rep").join(second, ["key", "byte"]).select(F.col("lead").alias("u"), F.col("rep").alias("v")))
        .where("u < v")
        .distinct()
    )
    wide = reps.select(F.col("rep"), "wide")
    expected = 64 * WIDE * np.arccos(2 * similarity / (1 + similarity)) / np.pi
    spread = np.sqrt(expected)

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            near = [jaccard(x, y, size) >= similarity for x, y in zip(a, b, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["u", "v"]).filter(pa.array(near))

    own = plain.join(reps.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi").groupBy("doc_id").agg(F.min("text").alias("text"))

    def similar(candidates: DataFrame) -> DataFrame:
        measured = candidates.join(wide.select(F.col("rep").alias("u"), F.col("wide").alias("_a")), "u").join(
            wide.select(F.col("rep").alias("v"), F.col("wide").alias("_b")), "v"
        )
        apart = sum((F.bit_count(F.get("_a", F.lit(i)).bitwiseXOR(F.get("_b", F.lit(i)))) for i in range(WIDE)), F.lit(0))
        measured = cut(measured.select("u", "v", apart.alias("apart")).where(F.col("apart") <= float(expected + 4 * spread)))
        sure = measured.where(F.col("apart") <= float(expected - 4 * spread)).select("u", "v")
        unsure = measured.where(F.col("apart") > float(expected - 4 * spread)).select("u", "v")
        exact = (
            unsure.join(own.select(F.col("doc_id").alias("u"), F.col("text").alias("_a")), "u")
            .join(own.select(F.col("doc_id").alias("v"), F.col("text").alias("_b")), "v")
            .select("u", "v", "_a", "_b")
            .mapInArrow(check, "u long, v long")
        )
        return sure.unionByName(exact)

    reach = _linked(large.select("key", "rep"), components(similar(candidates)), similar)
    named = classes.join(reach.select(F.col("node").alias("rep"), "component"), "rep", "left").select(
        "digest", F.coalesce("component", "rep").alias("component_id")
    )
    found = sketches.select("doc_id", "digest").join(named, "digest").groupBy("doc_id").agg(F.min("component_id").alias("component_id"))
    return found


def keep_one(docs: DataFrame, size: int = 5, similarity: float = 0.8) -> DataFrame:
    """``docs`` without the documents whose group has a smaller doc_id. Rows without doc_id stay."""
    group = near_duplicates(docs, size, similarity)
    name = fresh(docs, "_gone")
    gone = group.where("component_id <> doc_id").select(F.col("doc_id").alias(name))
    return docs.join(gone, F.col("doc_id") == F.col(name), "left_anti")
