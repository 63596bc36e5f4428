"""Shared helpers: table access, lineage cuts, words, byte-balanced slices, memoised pieces, components."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditloom.session import cut, stored

#: ASCII upper to lower case, all other bytes unchanged.
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
#: Characters with the Unicode property White_Space, as the body of a character class.
WHITE_SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``text`` alone; a null text counts as empty."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))


def fresh(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def one_text(plain: DataFrame) -> DataFrame:
    """``plain`` (``doc_id``, ``text``) with one text for each doc_id: of different ones that with the smallest md5.

    Equal rows stay. Rows are joined only if there is such a doc_id at all.
    """
    digests = plain.groupBy("doc_id").agg(F.min(F.md5("text")).alias("_least"), F.max(F.md5("text")).alias("_most"))
    several = stored(digests.where("_least < _most").select("doc_id", "_least"), "several-texts")
    if several.isEmpty():
        return plain
    kept = plain.join(several, "doc_id", "left").where(F.col("_least").isNull() | (F.md5("text") == F.col("_least")))
    return kept.select("doc_id", "text")


def words(text: str) -> list[bytes]:
    """ASCII-lower-cased words: maximal runs without space, tab, line feed, vertical tab, form feed, return."""
    return text.encode("utf-8").translate(LOWER).split()


def byte_slices(items: list[str], most: int = 1 << 22) -> Iterator[tuple[int, int]]:
    """Consecutive index ranges of about ``most`` characters; an item longer than that is alone in its range."""
    start, size = 0, 0
    for i, item in enumerate(items):
        if size and size + len(item) > most:
            yield start, i
            start, size = i, 0
        size += len(item)
    if start < len(items):
        yield start, len(items)


class Memo:
    """Values of short strings, computed in batches and kept in two generations of ``limit`` entries per Python worker.

    A full young generation becomes the old one, and what is met again moves back, so frequent strings stay and memory is
    bounded; longer strings are not kept. Results do not depend on what it holds.
    """

    def __init__(self, compute: Callable[[list[str]], list], limit: int = 250_000, longest: int = 48):
        self.compute, self.limit, self.longest = compute, limit, longest
        self.young: dict[str, object] = {}
        self.old: dict[str, object] = {}

    def lookup(self, lists: list[list[str]]) -> list[list]:
        """The values of every string of every list."""
        met = set().union(*lists)
        if len(self.young) > self.limit:
            self.old, self.young = self.young, {}
        young, old = self.young, self.old
        missing = met - young.keys()
        for x in missing & old.keys():
            young[x] = old[x]
        missing = sorted(missing - young.keys())
        for lo, hi in byte_slices(missing):
            young.update(zip(missing[lo:hi], self.compute(missing[lo:hi]), strict=True))
        found = [list(map(young.__getitem__, x)) for x in lists]
        for x in missing:
            if len(x) > self.longest:
                del young[x]
        return found


def components(edges: DataFrame) -> DataFrame:
    """Connected components of (``u``, ``v``): every linked node with the smallest node it can reach.

    Alternating large and small stars: each round re-hangs the neighbours of a node on the smallest of them. The
    minimum per node is combined before the shuffle, and the join with it is a plain equi-join that adaptive
    execution splits for hubs. One checkpoint per round; ends when a round changes nothing.
    """
    edges = cut(
        edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()
    )
    state = None
    while True:
        now = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.col("v").cast("decimal(38,0)"))).first()
        if now == state or not now[0]:
            break
        state = now
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("_m")).select("u", F.least("u", "_m").alias("_m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("_m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("_m"))
        rehung = large.join(least, "u")
        edges = cut(
            rehung.select(F.explode(F.array(F.struct("u", F.col("_m").alias("v")), F.struct(F.col("v").alias("u"), F.col("_m").alias("v")))).alias("_e"))
            .select("_e.u", "_e.v")
            .where("u <> v")
            .distinct()
        )
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
