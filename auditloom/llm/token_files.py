"""Token ids in binary files: patched frame-of-reference blocks inside pages of whole documents.

A block holds up to BLOCK ids less their minimum, packed at the width that a given percentile of them needs; the rest
are exceptions, stored with their position and their high bits. A page holds consecutive documents, its index of
document lengths and the byte offset of every block, so a document can be read without unpacking what precedes it.
Pages lie in Parquet files in ascending doc_id order, written by Spark into any folder that its file systems reach.

Defined cases: a null text is empty, so it holds the end id alone; equal doc_ids follow in the order of their texts and
null ones come first; a document longer than a page has a page of its own; empty tables give an empty folder that reads
back as no rows.
"""

from __future__ import annotations

import functools
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from auditloom.llm.common import LOWER, WHITE_SPACE, Memo, byte_slices, texts
from auditloom.llm.token_counts import tokenizer

MAGIC = b"PFR1"
BLOCK, PAGE_IDS, PERCENTILE = 4096, 1 << 16, 95
LETTERS = "[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]"
MARKS = np.array([ord(c) for c in ".,;:!?"], np.uint32)
HEAD = struct.Struct("<4sIQI")  # magic, documents, ids, blocks
BLOCK_HEAD = struct.Struct("<IIBI")  # minimum, ids, width, exceptions


# ---- blocks ---------------------------------------------------------------------------------------
def pack_block(ids: np.ndarray, percentile: int = PERCENTILE) -> bytes:
    """One block of unsigned 32-bit ids."""
    low = int(ids.min())
    rest = ids - np.uint32(low)
    chosen = int(np.partition(rest, k := min(len(rest) - 1, len(rest) * percentile // 100))[k])
    width = max(chosen.bit_length(), int(rest.max()).bit_length() - 16)  # the high bits of an exception fit two bytes
    over = np.flatnonzero(rest >> np.uint32(width)) if width < 32 else np.zeros(0, np.int64)
    bits = np.unpackbits(rest.astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")[:, :width]
    high = (rest[over] >> np.uint32(width)).astype("<u2")
    return b"".join(
        (
            BLOCK_HEAD.pack(low, len(ids), width, len(over)),
            np.packbits(bits, bitorder="little").tobytes(),
            over.astype("<u2").tobytes(),
            high.tobytes(),
        )
    )


def unpack_block(data: memoryview) -> np.ndarray:
    low, n, width, n_over = BLOCK_HEAD.unpack_from(data)
    at = BLOCK_HEAD.size
    size = (n * width + 7) // 8
    bits = np.unpackbits(np.frombuffer(data, np.uint8, size, at), count=n * width, bitorder="little").reshape(n, width)
    at += size
    full = np.zeros((n, 32), np.uint8)
    full[:, :width] = bits
    out = np.packbits(full, axis=1, bitorder="little").view("<u4").reshape(n).copy()
    over = np.frombuffer(data, "<u2", n_over, at)
    high = np.frombuffer(data, "<u2", n_over, at + 2 * n_over).astype(np.uint32)
    out[over] |= high << np.uint32(width)
    return out + np.uint32(low)


# ---- pages ----------------------------------------------------------------------------------------
def pack_page(lengths: list[int], ids: np.ndarray) -> bytes:
    blocks = [pack_block(ids[i : i + BLOCK]) for i in range(0, len(ids), BLOCK)]
    starts = np.cumsum([0, *map(len, blocks)]).astype("<u8")
    head = HEAD.pack(MAGIC, len(lengths), len(ids), len(blocks))
    return b"".join((head, np.array(lengths, "<u4").tobytes(), starts.tobytes(), *blocks))


def page_index(page: bytes) -> tuple[np.ndarray, np.ndarray, int]:
    """Lengths of the page's documents, start of each block, and where the blocks begin."""
    magic, n_docs, _, n_blocks = HEAD.unpack_from(page)
    if magic != MAGIC:
        raise ValueError("not a page of token ids")
    lengths = np.frombuffer(page, "<u4", n_docs, HEAD.size)
    starts = np.frombuffer(page, "<u8", n_blocks + 1, HEAD.size + 4 * n_docs)
    return lengths, starts, HEAD.size + 4 * n_docs + 8 * (n_blocks + 1)


def read_ids(page: bytes, start: int, stop: int) -> np.ndarray:
    """Ids ``start`` to ``stop`` of a page, unpacking only the blocks that hold them."""
    _, starts, base = page_index(page)
    view, out = memoryview(page), []
    for b in range(start // BLOCK, -(-stop // BLOCK)):
        out.append(unpack_block(view[base + int(starts[b]) : base + int(starts[b + 1])]))
    whole = np.concatenate(out) if out else np.zeros(0, np.uint32)
    skip = start // BLOCK * BLOCK
    return whole[start - skip : stop - skip]


# ---- encoding -------------------------------------------------------------------------------------
GROUP = 1000  # pieces encoded in one call


@functools.lru_cache(maxsize=4)
def id_memo(path: str) -> Memo:
    """Ids of single pieces as little-endian bytes.

    Many pieces go to the library as one text with a special string between them, which it encodes apart from what is around.
    """
    library = tokenizer(path)
    special = next((t.content for t in library.get_added_tokens_decoder().values() if t.special and not t.normalized), None)
    border = library.token_to_id(special) if special else None

    def groups(pieces: list[str]) -> Iterator[bytes]:
        for lo in range(0, len(pieces), GROUP):
            group = pieces[lo : lo + GROUP]
            if special and not any("<|" in x for x in group):
                ids = np.array(library.encode_batch_fast([special.join(group)], add_special_tokens=False)[0].ids, "<u4")
                cuts = np.flatnonzero(ids == border)
                raw, begin, end = ids.tobytes(), [0, *(4 * cuts + 4).tolist()], [*(4 * cuts).tolist(), 4 * len(ids)]
                yield from (raw[a:b] for a, b in zip(begin, end, strict=True))
            else:
                yield from (np.array(e.ids, "<u4").tobytes() for e in library.encode_batch_fast(group, add_special_tokens=False))

    return Memo(lambda pieces: list(groups(pieces)), limit=400_000)


def _kinds() -> tuple[np.ndarray, np.ndarray]:
    """Of code points up to the last white space: whether it is white space, and whether it is a letter marks part from."""
    last = 0x3001
    space, letter = np.zeros(last + 1, bool), np.zeros(last + 1, bool)
    blank, single = re.compile(f"[{WHITE_SPACE}]"), re.compile(LETTERS)
    for c in range(last + 1):
        space[c], letter[c] = bool(blank.match(chr(c))), bool(single.match(chr(c)))
    return space, letter


SPACES, PARTED = _kinds()


def split_words(bodies: list[str]) -> tuple[pa.BinaryArray, np.ndarray, np.ndarray]:
    """(distinct pieces, the number of every piece of all texts in order, how many each text has).

    Pieces lie between white space, and before a mark that ends a sentence or part of one after a letter. The tokenizer starts
    a new token there anyway, and there are far fewer different words without such marks.
    """
    joined = "\0" + "\0".join(bodies) + "\0"
    points = np.frombuffer(joined.encode("utf-32-le"), "<u4")
    low = np.minimum(points, len(SPACES) - 1)
    ends = np.cumsum([0, *(len(x) + 1 for x in bodies)])
    kind = SPACES[low].astype(np.uint8)  # 0 a piece, 1 white space, 2 between texts
    kind[ends] = 2
    starts = np.ones(len(points), bool)
    starts[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == 2)
    starts[1:] |= np.isin(points[1:], MARKS) & PARTED[low[:-1]] & (kind[:-1] == 0)
    width = 1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF)
    at = np.flatnonzero(starts)
    offsets = np.append((np.cumsum(width, dtype=np.int64) - width)[at], int(width.sum())).astype(np.int32)
    found = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(joined.encode())]).dictionary_encode()
    numbers, of = found.indices.to_numpy(), kind[at]
    counts = np.diff(np.cumsum(of == 0)[of == 2], prepend=0)[1:]
    numbers = numbers[of == 0]
    # white space and borders are no pieces
    used = np.zeros(len(found.dictionary), bool)
    used[numbers] = True
    return found.dictionary.filter(pa.array(used)), (np.cumsum(used) - 1)[numbers], counts


def word_ids(bodies: list[str], memo: Memo) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all texts in order, how many each has). Distinct pieces alone are encoded; ids are laid out on arrays."""
    pieces, numbers, counts = split_words(bodies)
    (known,) = memo.lookup([[x.decode() for x in pieces.to_pylist()]])
    sizes = np.array([len(x) // 4 for x in known], np.int64)
    flat, begin, n = np.frombuffer(b"".join(known), "<u4"), np.cumsum(sizes) - sizes, sizes[numbers]
    places = np.repeat(begin[numbers] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
    ends = np.cumsum(counts)
    reach = np.append(0, np.cumsum(n))
    return flat[places], reach[ends] - reach[ends - counts]


def encoded(bodies: list[str], memo: Memo) -> Iterator[np.ndarray]:
    """Ids of each text. A-Z is lowered first, as the tokenizer does, unless there may be a special string in a text."""
    lowered = [None if "<|" in x else x.encode().translate(LOWER).decode() for x in bodies]
    plain, special = [x for x in lowered if x is not None], [x for x, y in zip(bodies, lowered, strict=True) if y is None]
    parts = [iter(np.split(ids, np.cumsum(sizes)[:-1]) if len(sizes) else ()) for ids, sizes in (word_ids(plain, memo), word_ids(special, memo))]
    for x in lowered:
        yield next(parts[x is None])


def write_token_files(docs: DataFrame, folder: str, path: str, end_id: int) -> None:
    """Encode every text, append ``end_id``, and write pages and the sizes of their parts below ``folder``.

    For tokenizers that drop white space and never join what it separates. Texts, which compress better than ids, are
    range-partitioned by doc_id once; each task then encodes, packs and writes its own range.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, part, first = id_memo(path), TaskContext.get().partitionId(), 0
        end = np.array([end_id], "<u4")
        names: list = []
        parts: list[np.ndarray] = []
        size = number = 0

        def page() -> pa.RecordBatch:
            nonlocal first, number, size, names, parts
            body = pack_page([len(x) for x in parts], np.concatenate(parts))
            columns = [[part], [number], [first], [size], [names], [body]]
            out = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, PAGE, strict=True)], schema=PAGE)
            first, number, size, names, parts = first + size, number + 1, 0, [], []
            return out

        for batch in batches:
            keys, bodies = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for lo, hi in byte_slices(bodies):
                for key, ids in zip(keys[lo:hi], encoded(bodies[lo:hi], memo), strict=True):
                    if size and size + len(ids) + 1 > PAGE_IDS:
                        yield page()
                    names.append(key)
                    parts.append(np.append(ids, end))
                    size += len(ids) + 1
        if size:
            yield page()

    spark = docs.sparkSession
    ordered = texts(docs).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(run, PAGE_DDL).write.option("compression", "uncompressed").parquet(f"{folder}/pages")
    pages = spark.read.schema(PAGE_DDL).parquet(f"{folder}/pages")
    pages.groupBy("part").agg(F.sum("n_ids").alias("n_ids")).write.parquet(f"{folder}/parts")


PAGE = pa.schema(
    [("part", pa.int32()), ("page", pa.int32()), ("first", pa.int64()), ("n_ids", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("body", pa.binary())]
)
PAGE_DDL = "part int, page int, first long, n_ids long, doc_ids array<long>, body binary"


def read_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Per document, from the files: ``doc_id``, ``start`` (ids before it), ``n_tokens`` and ``ids_crc32``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, first, names, body in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                lengths, _, _ = page_index(body)
                ends = np.cumsum(lengths, dtype=np.int64)
                ids = read_ids(body, 0, int(ends[-1]) if len(ends) else 0).astype("<u4")
                starts = ends - lengths
                sums = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(starts, ends, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([part] * len(names), pa.int32()),
                        pa.array(names, pa.int64()),
                        pa.array(first + starts),
                        pa.array(lengths.astype(np.int64)),
                        pa.array(sums, pa.int64()),
                    ],
                    ["part", "doc_id", "local", "n_tokens", "ids_crc32"],
                )

    pages = spark.read.schema(PAGE_DDL).parquet(f"{folder}/pages").select("part", "first", "doc_ids", "body")
    local = pages.mapInArrow(run, "part int, doc_id long, local long, n_tokens long, ids_crc32 long")
    # one row a part: the window sorts as many rows as there were write tasks
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = spark.read.schema("part int, n_ids long").parquet(f"{folder}/parts")
    bases = parts.select("part", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("base"))
    return local.join(bases, "part").select("doc_id", (F.col("base") + F.col("local")).alias("start"), "n_tokens", "ids_crc32")
