"""Hashed maximum-entropy language model over words, with a class-factored softmax.

log P(word | history) = log P(class | history) + log P(word | class). The class softmax has hashed features: the previous
word, the word before it (skip) and both together (n-gram). The most frequent words are classes of their own, all others
fall into classes by a hash of their last two characters; inside a class the only feature is the word, whose
maximum-entropy solution is its smoothed share, with one slot for all unknown words of the class.

Word counts are a Spark aggregation and grow with the corpus. The class weights are trained in rounds over disjoint
slices of the training documents: every task runs AdaGrad steps on its rows from the common weights, the tasks' updates
are averaged feature by feature, in two steps of blocks so that no group grows with the number of tasks.

Counts of frequent words (at most ``head`` of them) go to the tasks as a dictionary; all other words of a document are
joined with the table of counts, combined per document first.

Defined cases: null and empty texts have the end token alone; without training documents every class is equally likely
and all words are unknown; rows repeated under one doc_id are scored one by one; rows without doc_id are training rows.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditloom.llm.common import byte_slices, cut, texts, words

END = b""  # no word is empty
BUCKETS, SINGLE, SHARED = 1 << 13, 32, 48
CLASSES = SINGLE + SHARED
FEATURES = 3
ROWS = FEATURES * BUCKETS + 1  # the last row is the bias
BLOCK = 32  # rows in a block of updates
STEP, RATE = 4096, 0.2
KNOWN_WORDS = 500_000
LN10 = math.log(10)


def suffix_class(word: Column | str) -> Column:
    """Class of a word that is not a class of its own."""
    return F.lit(SINGLE) + F.pmod(F.crc32(F.encode(F.right(word, F.lit(2)), "UTF-8")), F.lit(SHARED))


class Vocabulary(dict):
    """word -> hash (32 bits), class (8 bits) and position in the head plus one, packed; filled on demand, bounded."""

    def __init__(self, head: list[bytes]):
        super().__init__()
        self.head = head
        self.reset()

    def reset(self) -> None:
        self.clear()
        for i, w in enumerate(self.head):
            self[w] = crc32(w) | (i if i < SINGLE else self.shared(w)) << 32 | (i + 1) << 40

    @staticmethod
    def shared(word: bytes) -> int:
        return SINGLE + crc32(word.decode()[-2:].encode()) % SHARED

    def __missing__(self, word: bytes) -> int:
        if len(self) > KNOWN_WORDS:
            self.reset()
        packed = crc32(word) | self.shared(word) << 32
        if len(word) <= 64:
            self[word] = packed
        return packed


@dataclass
class Model:
    head: list[bytes]
    head_counts: np.ndarray
    class_mass: np.ndarray
    tokens: int
    types: int
    weights: np.ndarray
    counts: DataFrame

    @property
    def floor(self) -> float:
        """log10 of the base model's denominator."""
        return math.log10(self.tokens + 0.5 * (self.types + 1))


def contexts(packed: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Rows of the weight table for every token: previous word, the one before it, both. ``starts``: first tokens."""
    h = (packed & 0xFFFFFFFF).astype(np.uint64)
    first = np.zeros(len(h) + 2, bool)
    first[starts] = True
    prev = np.concatenate((np.zeros(1, np.uint64), h[:-1] + np.uint64(1)))
    prev[starts] = 0
    skip = np.concatenate((np.zeros(1, np.uint64), prev[:-1]))
    skip[starts] = 0
    mix = np.uint64(0x9E3779B97F4A7C15)
    shift, size = np.uint64(40), np.uint64(BUCKETS - 1)
    rows = np.empty((FEATURES, len(h)), np.int64)
    rows[0] = ((prev * mix) >> shift) & size
    rows[1] = (((skip * mix + np.uint64(12345)) * mix) >> shift) & size
    rows[2] = (((prev * np.uint64(0xC2B2AE3D27D4EB4F)) ^ (skip * mix)) * mix >> shift) & size
    rows += (np.arange(FEATURES) * BUCKETS)[:, None]
    return rows


def class_logits(weights: np.ndarray, rows: np.ndarray) -> np.ndarray:
    out = weights[rows[0]]
    for r in rows[1:]:
        out += weights[r]
    out += weights[ROWS - 1]
    out -= out.max(axis=1, keepdims=True)
    return out


def class_shares(weights: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Logits of every token up to a constant of its own, their exponentials, and the sums of these."""
    bias = weights[ROWS - 1]
    out = weights[rows[0]]
    for r in rows[1:]:
        out += weights[r]
    out += bias - bias.max()
    shares = np.exp(out)
    totals = shares.sum(axis=1, keepdims=True)
    if not (totals.min(initial=1) > 1e-20 and totals.max(initial=1) < 1e30):  # far from the bias: by the largest logit of each token
        out = class_logits(weights, rows)
        shares = np.exp(out)
        totals = shares.sum(axis=1, keepdims=True)
    return out, shares, totals


LAYERS = 12  # occurrences of a feature that are added for all features at once


def feature_sums(p: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct numbers in ``rows``, for each the sum of the rows of ``p`` at the tokens that have it)."""
    flat = rows.ravel().astype(np.int16 if ROWS < 1 << 15 else np.int64)
    order = np.argsort(flat, kind="stable")
    flat = flat[order]
    order %= len(p)
    at = np.flatnonzero(np.concatenate(([True], flat[1:] != flat[:-1])))
    size = np.diff(np.append(at, len(flat)))
    by_size = np.argsort(-size, kind="stable")
    at, size = at[by_size], size[by_size]
    g = p[order[at]]
    for k in range(1, LAYERS):
        n = np.searchsorted(-size, -k)  # those that occur more than k times come first
        if not n:
            break
        g[:n] += p[order[at[:n] + k]]
    for i in range(np.searchsorted(-size, -LAYERS)):
        g[i] += p[order[at[i] + LAYERS : at[i] + size[i]]].sum(axis=0)
    return flat[at].astype(np.int64), g


def train_step(weights: np.ndarray, squares: np.ndarray, rows: np.ndarray, classes: np.ndarray) -> None:
    """One AdaGrad step on a batch of tokens."""
    _, p, totals = class_shares(weights, rows)
    p /= totals
    p[np.arange(len(classes)), classes] -= 1
    ids, g = feature_sums(p, rows)
    total = squares[ids]
    total += g * g
    squares[ids] = total
    g *= RATE
    g /= np.sqrt(total, out=total)
    weights[ids] -= g
    g = p.sum(axis=0)
    squares[-1] += g * g
    weights[-1] -= RATE * g / np.sqrt(squares[-1])


def token_slices(bodies: list[str], vocabulary: Vocabulary) -> Iterator[tuple[int, int, list[list[bytes]], np.ndarray, np.ndarray]]:
    """Ranges of texts with their tokens, the packed tokens of all, and where each text starts."""
    for lo, hi in byte_slices(bodies, 1 << 20):
        tokens = [[*words(t), END] for t in bodies[lo:hi]]
        packed = np.fromiter((vocabulary[w] for t in tokens for w in t), np.int64)
        sizes = np.fromiter(map(len, tokens), np.int64)
        yield lo, hi, tokens, packed, np.cumsum(sizes) - sizes


def word_counts(docs: DataFrame) -> DataFrame:
    """``word`` and ``n`` over all rows; the end token is the empty word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def out() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays(
                [pa.array([w.decode() for w in counts], pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"]
            )
            counts.clear()
            return made

        for batch in batches:
            for text in batch.column(1).to_pylist():
                counts.update(words(text))
                counts[END] += 1
                if len(counts) > KNOWN_WORDS:
                    yield out()
        yield out()

    return texts(docs).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _most_frequent(counts: DataFrame, head: int) -> list:
    """At most ``head`` rows with the largest counts, in order: those above the smallest power of 1.1 that so few exceed.

    Only a histogram of the counts' magnitudes and the chosen rows reach the driver.
    """
    power = F.floor(F.log("n") / math.log(1.1) + 1e-9).cast("int")
    sizes = sorted(((r["p"], r["count"]) for r in counts.groupBy(power.alias("p")).count().collect()), reverse=True)
    least, total = None, 0
    for p, n in sizes:
        if total + n > head:
            break
        least, total = p, total + n
    if least is None:
        return []
    return sorted(counts.where(power >= least).collect(), key=lambda r: (-r["n"], r["word"]))


def train(docs: DataFrame, *, head: int = 65_536, rounds: int = 2) -> Model:
    """A model of all rows of ``docs``."""
    spark = docs.sparkSession
    counts = cut(word_counts(docs))
    top = _most_frequent(counts, head)
    head_words = [r["word"].encode() for r in top]
    single = [r["word"] for r in top[:SINGLE]]
    totals = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    mass = np.full(CLASSES, 0.5)
    by_class = counts.where(~F.col("word").isin(single)) if single else counts
    for r in by_class.groupBy(suffix_class("word").alias("k")).agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect():
        mass[r["k"]] += r["n"] + 0.5 * r["v"]
    start = np.zeros((ROWS, CLASSES), np.float32)
    for i, r in enumerate(top[:SINGLE]):
        start[-1, i] = math.log(r["n"])
    start[-1, SINGLE:] = np.log(mass[SINGLE:])
    weights = start
    shared = spark.sparkContext.broadcast(head_words)
    slices = texts(docs).withColumn("_slice", F.pmod(F.xxhash64("doc_id", "text"), F.lit(rounds)))
    for r in range(rounds):
        weights = _round(slices.where(F.col("_slice") == r).select("doc_id", "text"), weights, shared)
    return Model(head_words, np.array([r["n"] for r in top], np.int64), mass, int(totals["n"]), int(totals["v"]), weights, counts)


def _round(docs: DataFrame, weights: np.ndarray, head) -> np.ndarray:
    """The weights after one pass over ``docs``; what reaches the driver has the size of the model."""
    sent = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, vocabulary, part = sent.value, Vocabulary(head.value), TaskContext.get().partitionId()
        own, squares = base.copy(), np.full(base.shape, 1.0, np.float32)
        seen = np.zeros(ROWS, np.int64)
        for batch in batches:
            for _, _, _, packed, starts in token_slices(batch.column(1).to_pylist(), vocabulary):
                rows, classes = contexts(packed, starts), (packed >> 32) & 0xFF
                for at in range(0, len(packed), STEP):
                    train_step(own, squares, rows[:, at : at + STEP], classes[at : at + STEP])
                seen += np.bincount(rows.ravel(), minlength=ROWS)
                seen[-1] += len(packed)
        touched = seen > 0
        update = (own - base) * np.sqrt(seen, dtype=np.float32)[:, None]
        blocks = [b for b in range(-(-ROWS // BLOCK)) if touched[b * BLOCK : (b + 1) * BLOCK].any()]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(blocks, pa.int32()),
                pa.array([part % 64] * len(blocks), pa.int32()),
                pa.array([update[b * BLOCK : (b + 1) * BLOCK].tobytes() for b in blocks], pa.binary()),
                pa.array([np.sqrt(seen[b * BLOCK : (b + 1) * BLOCK], dtype=np.float32).tobytes() for b in blocks], pa.binary()),
            ],
            ["block", "salt", "update", "share"],
        )

    def add(table: pa.Table) -> pa.Table:
        summed = [pa.array([sum(np.frombuffer(x.as_py(), np.float32) for x in table[c]).astype(np.float32).tobytes()], pa.binary()) for c in ("update", "share")]
        return pa.table([table["block"][:1], table["salt"][:1], *summed], ["block", "salt", "update", "share"])

    schema = "block int, salt int, update binary, share binary"
    # every task sends an update of the model's size: their number follows the cores, not the partitions
    tasks = docs.coalesce(max(1, 2 * docs.sparkSession.sparkContext.defaultParallelism))
    partial = tasks.mapInArrow(run, schema).groupBy("block", "salt").applyInArrow(add, schema)
    total = partial.groupBy("block").applyInArrow(add, schema).collect()
    out = weights.copy()
    for r in total:
        share = np.frombuffer(r["share"], np.float32)
        update = np.frombuffer(r["update"], np.float32).reshape(len(share), CLASSES)
        out[r["block"] * BLOCK : r["block"] * BLOCK + len(share)] += update / np.maximum(share, 1e-9)[:, None]
    sent.unpersist()
    return out


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Per row: ``doc_id``, ``n_tokens``, ``n_known``, ``base_score`` (unigrams) and ``score`` (the model), log10."""
    context = docs.sparkSession.sparkContext
    head, sent = context.broadcast(model.head), context.broadcast(model.weights)
    head_log = np.concatenate(([0.0], np.log10(model.head_counts + 0.5)))
    mass_log = np.log10(model.class_mass)
    mass_log[:SINGLE] = 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, vocabulary, part, row = sent.value, Vocabulary(head.value), TaskContext.get().partitionId(), 0
        for batch in batches:
            keys, bodies = batch.column(0), batch.column(1).to_pylist()
            for lo, hi, tokens, packed, starts in token_slices(bodies, vocabulary):
                rows, classes, rank = contexts(packed, starts), (packed >> 32) & 0xFF, packed >> 40
                log_class = np.empty(len(packed))
                for at in range(0, len(packed), STEP):
                    logits, _, totals = class_shares(weights, rows[:, at : at + STEP])
                    own = logits[np.arange(len(logits)), classes[at : at + STEP]].astype(np.float64)
                    log_class[at : at + STEP] = own - np.log(totals[:, 0].astype(np.float64))
                in_class = np.where(classes < SINGLE, 0.0, head_log[rank] - mass_log[classes])
                scores = np.add.reduceat(log_class / LN10 + in_class, starts)
                bases = np.add.reduceat(head_log[rank], starts)
                known = np.add.reduceat(rank > 0, starts, dtype=np.int64)
                tails = []
                for t, s in zip(tokens, starts.tolist(), strict=True):
                    tails.append(Counter([t[i] for i in np.flatnonzero(rank[s : s + len(t)] == 0)]))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array((part << 33) + row + np.arange(hi - lo)),
                        keys.slice(lo, hi - lo),
                        pa.array([len(t) for t in tokens], pa.int64()),
                        pa.array(known),
                        pa.array(bases),
                        pa.array(scores),
                        pa.array([[w.decode() for w in t] for t in tails], pa.list_(pa.string())),
                        pa.array([list(t.values()) for t in tails], pa.list_(pa.int64())),
                    ],
                    ["row", "doc_id", "n_tokens", "n_known", "base", "score", "words", "times"],
                )
                row += hi - lo

    schema = "row long, doc_id long, n_tokens long, n_known long, base double, score double, words array<string>, times array<long>"
    first = cut(texts(docs).mapInArrow(run, schema))
    rare = first.select("row", F.explode(F.arrays_zip("words", "times")).alias("_w")).select("row", F.col("_w.words").alias("word"), F.col("_w.times").alias("times"))
    found = rare.join(model.counts, "word", "left").groupBy("row").agg(
        F.sum(F.col("times") * F.log10(F.coalesce("n", F.lit(0)) + 0.5)).alias("logs"),
        F.sum(F.when(F.col("n").isNotNull(), F.col("times")).otherwise(0)).alias("known"),
    )
    logs, known = F.coalesce("logs", F.lit(0.0)), F.coalesce("known", F.lit(0))
    return first.drop("words", "times").join(found, "row", "left").select(
        "doc_id",
        "n_tokens",
        (F.col("n_known") + known).alias("n_known"),
        (F.col("base") + logs - F.col("n_tokens") * F.lit(model.floor)).alias("base_score"),
        (F.col("score") + logs).alias("score"),
    )


def held_out(folds: int = 5, fold: int = 1) -> Column:
    """Whether a row is held out: crc32 of its doc_id as text, modulo the number of folds."""
    return F.coalesce(F.pmod(F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")), F.lit(folds)) == fold, F.lit(False))
