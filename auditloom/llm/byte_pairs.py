"""Byte-level BPE: ranked merges folded over the bytes of distinct words, ids joined and decoded by higher-order functions.

An Arrow step cuts texts into the words of the tokenizer's pattern, packs documents up to PACK characters and keeps every
distinct word of a pack once, as bytes. A fold merges, again and again, the pair of lowest rank until no pair has a rank; the
documents of a pack then take the ids of their words by position, so nothing is shuffled. Decoding looks up the bytes of every
id and concatenates them; pieces are held as hex digits, because Spark joins strings in linear time.

The fold exists twice with equal results. ``fold="spark"`` runs it per word in the JVM, as an aggregate over the steps with
the ranks as a literal hash table; interpreted lambdas make that some 400 microseconds a word. ``fold="arrays"``, the
default, takes the step of all words of a pack at once on whole arrays inside the Arrow step. Both merge all places of the
lowest pair of a long word together, which is the same as one by one for ranks whose tokens each merge to themselves;
``read_ranks`` checks that.

Defined cases: a null text is empty and has no ids; repeated rows give repeated results; special strings are ordinary text.
"""

from __future__ import annotations

import base64
import functools
import random
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditloom.llm.common import texts

PACK = 12 << 20  # characters of the documents whose words are held together
LONG = 1 << 14
NONE = (1 << 31) - 1  # rank of a pair that never merges
SHIFT = 20
LETTER, NUMBER, SPACE, OTHER, END = range(5)


# ---- ranks ----------------------------------------------------------------------------------------
@functools.lru_cache(maxsize=2)
def read_ranks(path: str) -> dict[bytes, int]:
    """Rank, which is also the id, of every token of a rank file."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    if sorted(ranks.values()) != list(range(len(ranks))) or len(ranks) >= 1 << SHIFT:
        raise ValueError("ids must be 0 to n - 1")
    tokens = sorted(ranks, key=ranks.get)
    ids, sizes = MergeArrays(ranks).fold(np.frombuffer(b"".join(tokens), np.uint8), np.array([len(t) for t in tokens]))
    if not (np.all(sizes == 1) and np.array_equal(ids, np.arange(len(tokens)))):
        raise ValueError("a token is not what its own bytes merge to")
    return ranks


def merges(ranks: dict[bytes, int]) -> dict[int, dict[int, int]]:
    """Left id -> right id -> id of the token that both make."""
    out: dict[int, dict[int, int]] = {}
    for token, rank in ranks.items():
        for i in range(1, len(token)):
            left, right = ranks.get(token[:i]), ranks.get(token[i:])
            if left is not None and right is not None:
                out.setdefault(left, {})[right] = rank
    return out


class MergeArrays:
    """The fold on whole arrays: pairs of ids are looked up in an open hash table."""

    FACTOR = np.uint64(0x9E3779B97F4A7C15)

    def __init__(self, ranks: dict[bytes, int]):
        self.single = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        found = [(a << SHIFT | b, rank) for a, partners in merges(ranks).items() for b, rank in partners.items()]
        bits = max(8, len(found).bit_length() + 2)
        self.down, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.ranks = np.full(1 << bits, -1, np.int64), np.full(1 << bits, NONE, np.int64)
        keys = np.array([k for k, _ in found], np.int64)
        for key, place, (_, rank) in zip(keys.tolist(), self._place(keys).tolist(), found, strict=True):
            while self.keys[place] >= 0:
                place = place + 1 & self.mask
            self.keys[place], self.ranks[place] = key, rank

    def _place(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * self.FACTOR >> self.down).astype(np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, NONE where there is none."""
        keys = left << SHIFT | right
        place = self._place(keys)
        held, out = self.keys[place], self.ranks[place]
        open_ = np.flatnonzero((held != keys) & (held >= 0))
        while len(open_):
            place[open_] = place[open_] + 1 & self.mask
            held[open_], out[open_] = self.keys[place[open_]], self.ranks[place[open_]]
            open_ = open_[(held[open_] != keys[open_]) & (held[open_] >= 0)]
        out[held != keys] = NONE
        return out

    def fold(self, raw: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words in order, how many each has) of words given as joined bytes and sizes (above 0)."""
        word = np.repeat(np.arange(len(sizes)), sizes)
        parts = self.single[raw]
        done_words, done_parts = [], []
        pairs = np.full(len(parts), NONE, np.int64)  # rank of a part with the next one of its word
        inner = np.flatnonzero(word[1:] == word[:-1])
        pairs[inner] = self.rank(parts[inner], parts[inner + 1])
        while len(parts):
            first = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            low = np.minimum.reduceat(pairs, first)
            size = np.diff(np.append(first, len(parts)))
            if (ended := low == NONE).any():
                gone = np.repeat(ended, size)
                done_words.append(word[gone])
                done_parts.append(parts[gone])
                word, parts, pairs = word[~gone], parts[~gone], pairs[~gone]
                low, size = low[~ended], size[~ended]
                if not len(parts):
                    break
            at = np.flatnonzero(pairs == np.repeat(low, size))
            # of touching pairs, which are of equal parts, every other one from the left
            new = np.append(True, np.diff(at) > 1)
            run = np.flatnonzero(new)
            at = at[(np.arange(len(at)) - np.repeat(run, np.diff(np.append(run, len(at))))) % 2 == 0]
            parts[at] = pairs[at]
            keep = np.ones(len(parts), bool)
            keep[at + 1] = False
            moved = at - np.arange(len(at))  # where the merged parts end up
            word, parts, pairs = word[keep], parts[keep], pairs[keep]
            touched = np.zeros(len(parts), bool)
            touched[moved] = touched[np.maximum(moved - 1, 0)] = True
            again = np.flatnonzero(touched)
            follows = again[again + 1 < len(parts)]
            follows = follows[word[follows] == word[follows + 1]]
            pairs[again] = NONE
            pairs[follows] = self.rank(parts[follows], parts[follows + 1])
        if not done_words:
            return np.zeros(0, np.int64), np.zeros(len(sizes), np.int64)
        word, parts = np.concatenate(done_words), np.concatenate(done_parts)
        order = np.argsort(word, kind="stable")
        return parts[order], np.bincount(word, minlength=len(sizes))


def hashed(key: int, factor: int, n: int) -> int:
    """A place below ``n``, a power of two: Spark's xxhash64 of both numbers."""
    seed = 42
    for x in (key, factor):
        seed = xxhash.xxh64_intdigest(struct.pack("<q", x), seed)
    return seed & n - 1


@functools.lru_cache(maxsize=2)
def rank_table(path: str) -> tuple[list[int], list[int]]:
    """A perfect hash table of the pairs: (factor of every bucket, slots).

    The pair (a, b) is ``key = a << SHIFT | b``; its slot, found by its bucket's factor, holds ``key << SHIFT | id``. Others hold -1.
    """
    ranks = read_ranks(path)
    keys = [(a << SHIFT | b, rank) for a, partners in merges(ranks).items() for b, rank in partners.items()]
    size = 2 << max(4, len(keys)).bit_length()
    buckets: list[list[tuple[int, int]]] = [[] for _ in range(size // 4)]
    for key in keys:
        buckets[hashed(key[0], 0, len(buckets))].append(key)
    factors, slots, draw = [1] * len(buckets), [-1] * size, random.Random(0)
    for i in sorted(range(len(buckets)), key=lambda i: (-len(buckets[i]), i)):
        while True:
            at = {hashed(key, factors[i], size) for key, _ in buckets[i]}
            if len(at) == len(buckets[i]) and all(slots[x] < 0 for x in at):
                break
            factors[i] = draw.randrange(1, 1 << SHIFT)
        for key, rank in buckets[i]:
            slots[hashed(key, factors[i], size)] = key << SHIFT | rank
    return factors, slots


def literal(values: list, kind: str) -> Column:
    """An array literal: one string that the optimizer splits and casts once."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast(f"array<{kind}>")


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def merged_words(words: Column, path: str) -> Column:
    """Ids of every word of an array of byte arrays."""
    ranks = read_ranks(path)
    factors, slots = rank_table(path)
    n_factors, n_slots = len(factors), len(slots)
    single = literal([ranks[bytes([b])] for b in range(256)], "long")
    edge = F.array(F.lit(-1).cast("long"))

    def fold(bytes_: Column, single: Column, factors: Column, slots: Column) -> Column:
        def rank(a: Column, b: Column) -> Column:
            def there(key: Column) -> Column:
                place = lambda factor, n: F.xxhash64(key, factor).bitwiseAND(F.lit(n - 1)).cast("int")
                found = F.get(slots, place(F.get(factors, place(F.lit(0).cast("long"), n_factors)), n_slots))
                return F.when(F.shiftright(found, SHIFT) == key, found.bitwiseAND(F.lit((1 << SHIFT) - 1)))

            key = a * (1 << SHIFT) + b
            return F.coalesce(there(key), F.lit(NONE).cast("long"))

        def ranks_of(parts: Column) -> Column:
            return F.transform(F.slice(parts, F.lit(1), F.size(parts) - 1), lambda a, i: rank(a, F.get(parts, i + 1)))

        def one(state: Column, _: Column) -> Column:
            """Merge the leftmost pair of lowest rank; only the two pairs around it get new ranks."""
            parts, pairs = state["parts"], state["pairs"]

            def at(low: Column) -> Column:
                return bound(
                    F.array_position(pairs, low).cast("int"),
                    lambda k: F.struct(
                        F.concat(F.slice(parts, F.lit(1), k - 1), F.array(low), F.slice(parts, k + 2, F.size(parts))).alias("parts"),
                        F.concat(
                            F.slice(pairs, F.lit(1), k - 2),
                            F.array(rank(F.get(parts, k - 2), low), rank(low, F.get(parts, k + 1))),
                            F.slice(pairs, k + 2, F.size(pairs)),
                        ).alias("pairs"),
                    ),
                )

            return bound(F.array_min(pairs), lambda low: F.when(low == NONE, state).otherwise(at(low)))

        def every(state: Column, _: Column) -> Column:
            """Merge all pairs of the lowest rank, from the left; ids are characters, so that this is a replacement."""
            parts, pairs = state["parts"], state["pairs"]
            mark = lambda x: F.decode(F.unhex(F.lpad(F.hex(x + 65536), 8, "0")), "utf-32")

            def at(low: Column) -> Column:
                k = F.array_position(pairs, low).cast("int")
                inner = F.array_join(F.transform(F.slice(parts, F.lit(2), F.size(parts) - 2), mark), "")
                swapped = F.replace(inner, F.concat(mark(F.get(parts, k - 1)), mark(F.get(parts, k))), mark(low))
                ids = F.transform(F.split(swapped, ""), lambda c: (F.ascii(c) - 65536).cast("long"))
                return bound(F.concat(edge, ids, edge), lambda p: F.struct(p.alias("parts"), ranks_of(p).alias("pairs")))

            return bound(F.array_min(pairs), lambda low: F.when(low == NONE, state).otherwise(at(low)))

        start = F.concat(edge, F.transform(bytes_, lambda b: F.get(single, b)), edge)
        state = bound(start, lambda p: F.struct(p.alias("parts"), ranks_of(p).alias("pairs")))
        inside = lambda s: F.slice(s["parts"], F.lit(2), F.size(s["parts"]) - 2)
        steps = F.sequence(F.lit(1), F.size(bytes_) - 1)
        merged = F.when(F.size(bytes_) > LONG, F.aggregate(steps, state, every, inside)).otherwise(F.aggregate(steps, state, one, inside))
        return F.when(F.size(bytes_) < 2, F.transform(bytes_, lambda b: F.get(single, b))).otherwise(merged)

    tables = F.struct(single.alias("single"), literal(factors, "long").alias("factors"), literal(slots, "long").alias("slots"))
    return bound(tables, lambda t: F.transform(words, lambda w: fold(w, t["single"], t["factors"], t["slots"])))


# ---- words ----------------------------------------------------------------------------------------
@functools.lru_cache(maxsize=1)
def character_kinds() -> bytes:
    """Kind of every code point as the tokenizer's own pattern engine sees it; surrogates count as OTHER."""
    import tiktoken

    everything = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    kinds = np.full(0x110000, OTHER, np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (SPACE, r"\s")):
        engine = tiktoken.Encoding("kinds", pat_str=pattern, mergeable_ranks={bytes([b]): b for b in range(256)}, special_tokens={})
        found = bytes(engine.encode_ordinary(everything)).decode()
        kinds[np.frombuffer(found.encode("utf-32-le"), "<u4")] = kind
    return kinds.tobytes()


def word_starts(points: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """Whether a word begins at each code point. ``kind`` is END before and after every text.

    Words are: an apostrophe with s, t, re, ve, m, ll or d; letters, numbers or other characters, each with one space before
    them; white space, without its last character where something else follows.
    """
    n = len(points)
    starts = np.ones(n, bool)
    starts[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == END)
    last = np.flatnonzero((kind[:-1] == SPACE) & (kind[1:] != SPACE) & (kind[1:] != END))
    starts[last] = True
    starts[last[points[last] == 32] + 1] = False
    quote = np.flatnonzero((points == 39) & starts & (kind == OTHER))
    quote = quote[kind[np.minimum(quote + 1, n - 1)] == LETTER]
    one = points[np.minimum(quote + 1, n - 1)]
    two = points[np.minimum(quote + 2, n - 1)] * (kind[np.minimum(quote + 2, n - 1)] == LETTER)
    short = np.isin(one, [ord(c) for c in "stmd"])
    double = ((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
    for some, size in ((quote[short], 2), (quote[double], 3)):
        starts[some + 1] = False
        starts[some + size] = True  # there is an END at least
    return starts


def packed(bodies: list[str], kinds: np.ndarray) -> tuple[pa.BinaryArray, list[np.ndarray]]:
    """(distinct words, their numbers in each text in order)."""
    joined = "\0" + "\0".join(bodies) + "\0"
    points = np.frombuffer(joined.encode("utf-32-le"), "<u4")
    kind = kinds[points]
    ends = np.cumsum([0, *(len(b) + 1 for b in bodies)])
    kind[ends] = END
    starts = word_starts(points, kind)
    width = 1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF)
    at = np.flatnonzero(starts)
    offsets = np.append((np.cumsum(width, dtype=np.int64) - width)[at], int(width.sum())).astype(np.int32)
    data = joined.encode()
    found = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data)]).dictionary_encode()
    numbers, borders = found.indices.to_numpy(), np.flatnonzero(kind[at] == END)
    return found.dictionary, [numbers[a + 1 : b] for a, b in zip(borders[:-1], borders[1:], strict=True)]


def _lists(flat: np.ndarray, sizes: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), pa.int32()), pa.array(flat, pa.int32()))


def _packs(batches: Iterator[pa.RecordBatch], kinds: np.ndarray, size: int) -> Iterator[tuple[list, np.ndarray, np.ndarray, list[np.ndarray]]]:
    """Of documents that go together: their ids, the joined bytes and the sizes of their distinct words, and the words of each."""

    def pack() -> tuple[list, np.ndarray, np.ndarray, list[np.ndarray]]:
        words, at = packed(bodies, kinds)
        _, offsets, data = words.buffers()
        ends = np.frombuffer(offsets, np.int32)[words.offset : words.offset + len(words) + 1]
        return keys, np.frombuffer(data or b"", np.uint8)[ends[0] : ends[-1]], np.diff(ends), at

    keys, bodies, held = [], [], 0
    for batch in batches:
        for key, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if held and held + len(body) > size:
                yield pack()
                keys, bodies, held = [], [], 0
            keys.append(key)
            bodies.append(body)
            held += len(body) + 1
    if keys:
        yield pack()


PACKED = pa.schema(
    [("words", pa.list_(pa.list_(pa.int32()))), ("docs", pa.list_(pa.struct([("doc_id", pa.int64()), ("at", pa.list_(pa.int32()))])))]
)


def packs(docs: DataFrame, size: int = PACK) -> DataFrame:
    """Rows of many documents: ``words`` (distinct, as bytes) and ``docs`` (``doc_id`` and the numbers of its words)."""
    table = character_kinds()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, raw, sizes, at in _packs(batches, np.frombuffer(table, np.uint8), size):
            numbers = _lists(np.concatenate(at), np.array([len(x) for x in at]))
            rows = pa.StructArray.from_arrays([pa.array(keys, pa.int64()), numbers], fields=list(PACKED.field("docs").type.value_type))
            one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
            yield pa.RecordBatch.from_arrays([one(_lists(raw.astype(np.int32), sizes)), one(rows)], schema=PACKED)

    return texts(docs).mapInArrow(run, "words array<array<int>>, docs array<struct<doc_id:long,at:array<int>>>")


# ---- encoding and decoding ------------------------------------------------------------------------
IDS = 1 << 22  # ids of a batch of results


def encode(docs: DataFrame, path: str, size: int = PACK, fold: str = "arrays") -> DataFrame:
    """Per row: ``doc_id`` and ``ids`` (array of int)."""
    if fold == "spark":

        def named(ids: Column) -> Column:
            own = lambda d: F.flatten(F.transform(d["at"], lambda i: F.get(ids, i))).cast("array<int>")
            return F.transform("docs", lambda d: F.struct(d["doc_id"].alias("doc_id"), own(d).alias("ids")))

        return packs(docs, size).select(F.inline(bound(merged_words(F.col("words"), path), named)))
    table, arrays = character_kinds(), MergeArrays(read_ranks(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, raw, sizes, at in _packs(batches, np.frombuffer(table, np.uint8), size):
            ids, counts = arrays.fold(raw, sizes)
            begin, ids = np.cumsum(counts) - counts, ids.astype(np.int32)
            lengths = np.array([len(x) for x in at])
            total = np.array([int(counts[x].sum()) for x in at])
            for rows in np.split(np.arange(len(at)), np.flatnonzero(np.diff(np.cumsum(total) // IDS)) + 1):
                words = np.concatenate([at[i] for i in rows]) if lengths[rows].any() else np.zeros(0, np.int32)
                n = counts[words]
                places = np.repeat(begin[words] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
                yield pa.RecordBatch.from_arrays([pa.array([keys[i] for i in rows], pa.int64()), _lists(ids[places], total[rows])], ["doc_id", "ids"])

    return texts(docs).mapInArrow(run, "doc_id long, ids array<int>")


def joined_hex(ids: Column, pieces: list[str]) -> Column:
    """The bytes whose hex digits ``pieces`` holds for each id, concatenated."""
    return F.unhex(bound(literal(pieces, "string"), lambda p: F.array_join(F.transform(ids, lambda i: F.get(p, i)), "")))


def decoded(ids: Column, path: str) -> Column:
    """Bytes of an array of ids."""
    ranks = read_ranks(path)
    return joined_hex(ids, [token.hex() for token in sorted(ranks, key=ranks.get)])


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """Per row: ``doc_id``, ``n_tokens``, ``ids_sha256`` (ids as little-endian 32-bit numbers) and ``decoded_sha256``."""
    ids = F.col("ids")
    little = joined_hex(ids, [i.to_bytes(4, "little").hex() for i in range(len(read_ranks(path)))])
    return encode(docs, path).select(
        "doc_id", F.size(ids).cast("long").alias("n_tokens"), F.sha2(little, 256).alias("ids_sha256"), F.sha2(decoded(ids, path), 256).alias("decoded_sha256")
    )
