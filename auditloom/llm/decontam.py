"""Benchmark items inside documents, up to a share of word edits.

An item of m words with at most k edits keeps one of k + 1 disjoint pieces unchanged, so the first words of all pieces of
all items are looked up in every text, and every hit proposes a window of the item's size. Windows are embedded by the
CGK random walk, which maps edit distance to Hamming distance: an output position repeats the current word, and a random
bit of the word decides whether the walk moves on. Sampled positions of several walks make the keys of the hash tables;
their number follows from the target recall. Windows that meet items of their size in a table are verified by the exact
edit distance of the item to the best matching run of words around the window.

The items are a stated query set: blocks of at most ``block`` items are sent to the tasks, each block against all rows.

Defined cases: null texts have no words; words are runs of letters, digits and underscores in lower case; items under
``min_words`` words can't be told from common phrases and match nothing; equal items are reported each under its own
id; a text with several matches of an item is reported once, with the fewest edits, first of ties; rows repeated under
one doc_id count as one document.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditloom.llm.common import fresh, texts

WORD = re.compile(r"\w+")
ANCHOR = 3  # words of a piece that are looked up
STRETCH = 3  # output positions of a walk for each word
SAMPLED = 3  # positions in a key
WALKS = 5
#: Share of equal positions that two embeddings at the largest accepted distance have at least, as measured.
AGREEMENT = 0.5


def spoken(text: str) -> list[str]:
    return WORD.findall(text.lower())


class Walk:
    """One random walk: its bits for each word and its sampled positions for each window size."""

    def __init__(self, number: int):
        self.number = number
        self.bits: dict[str, int] = {}
        self.samples: dict[tuple[int, int], np.ndarray] = {}

    def embed(self, window: list[str]) -> list[int]:
        """Positions of the window's words in the output; the window's size stands for the padding."""
        out, at, size = [], 0, len(window)
        moves = [self._moves(w) for w in window]
        for step in range(STRETCH * size):
            out.append(at)
            if at < size:
                at += moves[at] >> (step & 255) & 1
        return out

    def _moves(self, word: str) -> int:
        known = self.bits.get(word)
        if known is None:
            if len(self.bits) > 100_000:
                self.bits.clear()
            raw = word.encode()
            known = 0
            for k in range(4):
                known |= xxhash.xxh64_intdigest(raw, self.number * 4 + k) << (64 * k)
            self.bits[word] = known
        return known

    def keys(self, window: list[str], tables: int) -> list[tuple]:
        """A key for each table that samples a word of the window."""
        out, places = [], self.embed(window)
        size = len(window)
        for t in range(tables):
            chosen = self.samples.get((size, t))
            if chosen is None:
                chosen = self.samples[size, t] = np.random.default_rng([self.number, t, size]).integers(0, STRETCH * size, SAMPLED)
            symbols = [window[places[i]] if places[i] < size else "" for i in chosen.tolist()]
            if any(symbols):  # what lies past the end of the walk is the same in all windows of a size
                out.append((self.number, t, size, *symbols))
        return out


def tables_for(recall: float) -> int:
    """Tables per walk so that a pair at the largest accepted distance meets with this probability."""
    meet = AGREEMENT**SAMPLED
    return max(1, math.ceil(math.log(max(1 - recall, 1e-9)) / math.log(1 - meet) / WALKS))


def fewest_edits(pattern: list[str], words: list[str]) -> tuple[int, int]:
    """(edits, end) of the run of ``words`` that is closest to ``pattern``; first of ties. Bit-parallel over the pattern."""
    m = len(pattern)
    masks: dict[str, int] = defaultdict(int)
    for i, w in enumerate(pattern):
        masks[w] |= 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score = full, 0, m
    best, end = m, 0
    for j, w in enumerate(words):
        eq = masks.get(w, 0)
        diagonal = ((((eq & plus) + plus) ^ plus) | eq | minus) & full
        h_plus = (minus | ~(diagonal | plus)) & full
        h_minus = plus & diagonal
        if h_plus & top:
            score += 1
        elif h_minus & top:
            score -= 1
        h_plus, h_minus = (h_plus << 1) & full, (h_minus << 1) & full
        plus = (h_minus | ~(diagonal | h_plus)) & full
        minus = h_plus & diagonal
        if score < best:
            best, end = score, j + 1
    return best, end


def grams(codes: np.ndarray) -> np.ndarray:
    """Hashes of every three neighbours. Two that differ may share one; what they propose is verified."""
    return (codes[:-2] * np.uint64(0x9E3779B97F4A7C15) + codes[1:-1]) * np.uint64(0xC2B2AE3D27D4EB4F) + codes[2:]


class Index:
    """Anchors and hash tables of a block of items."""

    def __init__(self, items: list[tuple[int, str]], edit_share: float, min_words: int, recall: float):
        self.tables = tables_for(recall)
        self.walks = [Walk(i) for i in range(WALKS)]
        self.items = [(i, w) for i, w in ((i, spoken(t)) for i, t in items) if len(w) >= min_words]
        self.edits = [int(edit_share * len(w)) for _, w in self.items]
        self.codes: dict[str, int] = {}
        anchors = []
        self.buckets: dict[tuple, set[int]] = defaultdict(set)
        for n, ((_, w), k) in enumerate(zip(self.items, self.edits, strict=True)):
            cuts = [len(w) * p // (k + 1) for p in range(k + 1)]
            for c in cuts:
                a = [self.codes.setdefault(x, len(self.codes) + 1) for x in w[c : c + ANCHOR]]
                anchors.append((a, n, c))
            for walk in self.walks:
                for key in walk.keys(w, self.tables):
                    self.buckets[key].add(n)
        self.at: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for (a, b, c), n, place in anchors:
            gram = int(grams(np.array([a, b, c], np.uint64))[0])
            self.at[gram].append((len(self.items[n][1]), place))
        self.known = np.array(sorted(self.at), np.uint64)

    def search(self, text: str) -> list[tuple[int, int, int, int]]:
        """(item id, start word, words, edits) of every item found in a text."""
        w = spoken(text)
        if len(w) < ANCHOR or not len(self.known):
            return []
        get = self.codes.get
        codes = np.fromiter((get(x, 0) for x in w), np.uint64, len(w))
        found = grams(codes)
        slot = np.minimum(np.searchsorted(self.known, found), len(self.known) - 1)
        hits = np.flatnonzero((self.known[slot] == found) & (codes[:-2] > 0) & (codes[1:-1] > 0) & (codes[2:] > 0))
        windows = {(max(0, p - place), size) for p in hits.tolist() for size, place in self.at[int(found[p])]}
        proposed = set()
        for start, size in windows:
            window = w[start : start + size]
            window += [""] * (size - len(window))
            for walk in self.walks:
                for key in walk.keys(window, self.tables):
                    proposed.update((n, start) for n in self.buckets.get(key, ()))
        best: dict[int, tuple[int, int, int]] = {}
        for n, start in sorted(proposed):
            item, most = self.items[n][1], self.edits[n]
            lo = max(0, start - most)
            near = w[lo : start + len(item) + most]
            edits, end = fewest_edits(item, near)
            if edits <= most:
                _, back = fewest_edits(item[::-1], near[:end][::-1])
                found = (edits, lo + end - back, back)
                if n not in best or found < best[n]:
                    best[n] = found
        return [(self.items[n][0], start, size, edits) for n, (edits, start, size) in sorted(best.items())]


def contaminated(
    docs: DataFrame, items: DataFrame, *, edit_share: float = 0.2, min_words: int = 8, recall: float = 0.99, block: int = 20_000
) -> DataFrame:
    """Pairs of a document and an item found in it: ``doc_id``, ``item_id``, ``start_word``, ``n_words``, ``edits``."""
    spark = docs.sparkSession
    plain = texts(docs)
    named = items.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce("text", F.lit("")).alias("text")).distinct()
    blocks = max(1, math.ceil(named.count() / block * 1.25)) if named.count() > block else 1
    schema = "doc_id long, item_id long, start_word long, n_words long, edits long"
    found = None
    for b in range(blocks):
        part = named.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b) if blocks > 1 else named
        rows = [(r["item_id"], r["text"]) for r in part.orderBy("item_id", "text").collect()]
        sent = spark.sparkContext.broadcast(rows)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            index = Index(sent.value, edit_share, min_words, recall)
            for batch in batches:
                out = [(k, *hit) for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for hit in index.search(t)]
                columns = list(zip(*out, strict=True)) or [()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["doc_id", "item_id", "start_word", "n_words", "edits"])

        one = plain.mapInArrow(run, schema)
        found = one if found is None else found.unionByName(one)
    best = F.min(F.struct("edits", "start_word", "n_words")).alias("_b")
    return found.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "_b.start_word", "_b.n_words", "_b.edits")


def clean(docs: DataFrame, items: DataFrame, **limits) -> DataFrame:
    """``docs`` without the documents in which an item is found. Rows without doc_id go if one of them has an item."""
    name = fresh(docs, "_bad")
    bad = contaminated(docs, items, **limits).select(F.col("doc_id").alias(name)).distinct()
    return docs.join(bad, F.col("doc_id").eqNullSafe(F.col(name)), "left_anti")
