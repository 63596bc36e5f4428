"""Exact top-k search and threshold joins on sparse vectors ``id, feature, weight`` with weights of at least 0.

Vectors that are equal are searched once. Posting lists hold the weights of the searched side in blocks
of like weights; a block knows its largest weight. A search without a floor works in three steps:

1. Seeds: the best entries in the lists of the rarest features of each query give partial scores. The k best seeds are scored
   in full; the lowest of these scores is a lower bound of the query's k-th best score and becomes its threshold.
2. Candidates: with the features of a query in order of frequency, the common rest is left out from where all of it together
   can add less than the threshold. Of the other lists only blocks are opened whose best entry, with everything that the
   other features can add, reaches the threshold. So the long lists of common features are skipped where they cannot matter.
3. Scores: the k-th best sum raises the threshold again, and the features left out are added for what still reaches it.

No floor is needed and no pair of a result is missed. A given floor takes the place of the threshold in a threshold join.

A top k in a library of up to BLOCKS blocks of BLOCK_ENTRIES entries needs no candidates: a block leads the queries of its cell
through a task, all their scores with it are products of arrays, and only the k best of a query leave the task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from auditloom.operators.ranking import top_per_group
from auditloom.session import cut, stored

BLOCK = 64  # postings of a block
SHORT = 1024  # queries with fewer than SHORT * k entries in all their lists are scored against all of these
OWN = 32  # entries of a candidate's own vector, for the choice of lists to leave out
SEEDS = 4  # seeds are looked for in lists of up to SEEDS * k entries together
MARGIN = 2e-9  # scores are compared after rounding to 9 places
BLOCK_ENTRIES = 1 << 22  # entries of the searched vectors that a task holds at once
BLOCKS = 64  # queries are repeated for every block; larger libraries are searched by their posting lists
LONG = 4096  # and so are vectors with more entries than that on average
SCORES = 1 << 21  # scores and products that a task works out at once


# ---- vectors --------------------------------------------------------------------------------------
def _packed(vectors: DataFrame) -> DataFrame:
    """``id, v``: the entries of each vector, zero weights left out, in order of their features."""
    kept = vectors.filter(F.col("weight") != 0)
    entry = F.struct("feature", F.col("weight").cast("double").alias("weight"))
    return kept.groupBy("id").agg(F.sort_array(F.collect_list(entry)).alias("v"))


def _norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, e: s + e["weight"] * e["weight"]))


def normalised(vectors: DataFrame) -> DataFrame:
    """Unit-length vectors; zero weights are dropped."""
    packed = _packed(vectors).withColumn("_n", _norm(F.col("v")))
    return packed.select("id", "_n", F.inline("v")).select("id", "feature", (F.col("weight") / F.col("_n")).alias("weight"))


def _classes(vectors: DataFrame, unit: bool, only: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(``id, sig`` of every vector, ``sig, feature, weight`` of every distinct one); ``sig`` is the smallest id of equal vectors.

    With ``only`` just the entries of its features are kept; what is left out counts in the norm all the same.
    """
    kept = vectors.filter(F.col("weight") != 0)
    known = F.lit(True)
    if only is not None:
        kept = kept.join(only.select("feature").distinct().withColumn("_known", F.lit(True)), "feature", "left")
        known = F.coalesce("_known", F.lit(False))
    entry = F.struct("feature", F.col("weight").cast("double").alias("weight"), known.alias("known"))
    packed = kept.groupBy("id").agg(F.sort_array(F.collect_list(entry)).alias("v"))
    packed = packed.withColumn("_n", _norm(F.col("v")) if unit else F.lit(1.0))
    entries = F.transform(F.filter("v", lambda e: e["known"]), lambda e: F.struct(e["feature"].alias("feature"), e["weight"].alias("weight")))
    packed = packed.select("id", "_n", entries.alias("v"))
    digest = F.concat(F.hex(F.xxhash64("v", "_n")), F.lit("-"), F.hex(F.xxhash64(F.lit(1), "v", "_n")), F.lit("-"), F.size("v").cast("string"))
    packed = stored(packed.withColumn("_digest", digest), "vectors")
    first = cut(packed.groupBy("_digest").agg(F.min("id").alias("sig")))
    ids = cut(packed.select("id", "_digest").join(first, "_digest").select("id", "sig"))
    one = packed.join(first.select(F.col("sig").alias("id")), "id", "left_semi")
    entries = one.select(F.col("id").alias("sig"), "_n", F.inline("v")).select("sig", "feature", (F.col("weight") / F.col("_n")).alias("weight"))
    return ids, entries


# ---- products -------------------------------------------------------------------------------------
def packed(vectors: DataFrame, unit: bool = True, only: DataFrame | None = None) -> DataFrame:
    """``id, v``: the entries of each vector, scaled to length 1 with ``unit``, in order of their features.

    With ``only`` just the entries of its features are kept; what is left out counts in the norm all the same.
    """
    kept = vectors.filter((F.col("weight") != 0) & F.col("id").isNotNull()).withColumn("weight", F.col("weight").cast("double"))
    entry = F.struct("feature", "weight")
    if only is not None:
        kept = kept.join(only.select("feature").distinct().withColumn("_known", F.lit(True)), "feature", "left")
        entry = F.when(F.col("_known"), entry)
    norm = F.sqrt(F.sum(F.col("weight") * F.col("weight"))) if unit else F.lit(1.0)
    rows = kept.groupBy("id").agg(norm.alias("_n"), F.sort_array(F.collect_list(entry)).alias("v"))
    scaled = F.transform("v", lambda e: F.struct(e["feature"].alias("feature"), (e["weight"] / F.col("_n")).alias("weight")))
    return rows.select("id", scaled.alias("v"))


def block_count(library: DataFrame) -> int | None:
    """Blocks of a packed library, or nothing if it is too large for products or its features are no plain values."""
    if library.schema["v"].dataType.elementType["feature"].dataType.simpleString() not in ("string", "int", "bigint"):
        return None
    n, entries = library.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("v")), F.lit(0))).first()
    if entries > BLOCKS * BLOCK_ENTRIES or entries > LONG * n:
        return None
    return max(1, -(-entries // BLOCK_ENTRIES))


def first_copies(library: DataFrame, k: int) -> DataFrame:
    """Of equal packed vectors the ``k`` with the smallest ids; no others can be in a top k."""
    return top_per_group(library, ["v"], [F.col("id")], k, "_r").drop("_r")


def top_products(queries: DataFrame, library: DataFrame, k: int, blocks: int) -> DataFrame:
    """Top ``k`` of a packed library per packed query by (inner product rounded to 9 places, id): ``a, b, sim, rank``."""
    cores = queries.sparkSession.sparkContext.defaultParallelism
    parts = -(-cores // blocks)  # every part gets all blocks, so no more of them than keep the cores busy
    kind = lambda df: df.schema["id"].dataType.simpleString()
    arrays = [F.col("v.feature").alias("features"), F.col("v.weight").alias("weights")]
    cell = lambda block, part: (block * parts + part).cast("int").alias("_cell")
    block, part = F.pmod(F.xxhash64("id"), F.lit(blocks)), F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    heads = library.withColumn("_p", part).select(
        cell(block, F.col("_p")), F.lit(0).alias("_side"), F.lit(None).cast(kind(queries)).alias("a"), F.col("id").alias("b"), *arrays
    )
    rows = queries.withColumn("_b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).select(
        cell(F.col("_b"), F.pmod(F.xxhash64("id"), F.lit(parts))), F.lit(1).alias("_side"), F.col("id").alias("a"),
        F.lit(None).cast(kind(library)).alias("b"), *arrays,
    )
    placed = rows.unionByName(heads).repartitionById(blocks * parts, F.col("_cell")).sortWithinPartitions("_cell", "_side")
    found = placed.mapInArrow(_best_products(k), f"a {kind(queries)}, b {kind(library)}, sim double, score long, rank int")
    if blocks > 1:
        found = top_per_group(found.drop("rank"), ["a"], [F.desc("score"), F.col("b")], k)
    return found.drop("score")


def _best_products(k: int):
    """Arrow function that gathers the block of a cell and gives the ``k`` best entries of it for every query."""

    def run(batches):
        import numpy as np

        cell, heads, block = None, [], None
        for batch in batches:
            marks = np.asarray(batch.column(0)).astype(np.int64) * 2 + np.asarray(batch.column(1))
            cuts = [0, *(np.flatnonzero(np.diff(marks)) + 1), len(marks)]
            for low, high in zip(cuts[:-1], cuts[1:], strict=True):
                if low == high:
                    continue
                if cell != marks[low] // 2:
                    cell, heads, block = marks[low] // 2, [], None
                piece = batch.slice(low, high - low)
                if marks[low] % 2 == 0:
                    heads.append(piece)
                elif block is not None or heads:
                    block = block or _Block(heads)
                    yield from block.best(piece, k)

    return run


class _Block:
    """Vectors of a library: lists that reach a quarter of them as rows of a matrix, the others one after another."""

    def __init__(self, heads: list):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        table = pa.Table.from_batches(heads).combine_chunks()
        ids = table["b"].combine_chunks()
        order = pc.array_sort_indices(ids)
        self.ids, self.n = ids.take(order), len(ids)
        place = np.empty(self.n, np.int64)
        place[np.asarray(order)] = np.arange(self.n)
        features, weights, rows = _flat(table["features"].combine_chunks(), table["weights"].combine_chunks())
        coded = features.dictionary_encode()
        self.names, code, column = coded.dictionary, np.asarray(coded.indices), place[rows]
        common = np.bincount(code, minlength=len(self.names)) * 4 >= self.n
        self.slot = np.where(common, np.cumsum(common) - 1, -1)
        self.matrix = np.zeros((int(common.sum()), self.n))
        dense = common[code]
        np.add.at(self.matrix, (self.slot[code[dense]], column[dense]), weights[dense])
        code, column, weights = code[~dense], column[~dense], weights[~dense]
        order = np.argsort(code, kind="stable")
        self.start = np.searchsorted(code[order], np.arange(len(self.names) + 1))
        self.columns, self.weights = column[order], weights[order]

    def scores(self, n: int, row, code, weight):
        """Inner products of ``n`` queries with all vectors of the block."""
        import numpy as np

        slot = self.slot[code]
        dense = slot >= 0
        query = np.zeros((n, len(self.matrix)))
        np.add.at(query, (row[dense], slot[dense]), weight[dense])
        out = query @ self.matrix
        flat = out.reshape(-1)
        row, code, weight = row[~dense], code[~dense], weight[~dense]
        size = self.start[code + 1] - self.start[code]
        upto = np.cumsum(size)
        cuts = np.searchsorted(upto, np.arange(SCORES, (upto[-1] if len(upto) else 0) + SCORES, SCORES), side="right")
        low = 0
        for high in [*cuts, len(size)]:
            high = min(max(high, low + 1), len(size))
            if low >= len(size):
                break
            count = size[low:high]
            at = np.repeat(self.start[code[low:high]] - (np.cumsum(count) - count), count) + np.arange(count.sum())
            target = np.repeat(row[low:high] * self.n, count) + self.columns[at]
            np.add.at(flat, target, np.repeat(weight[low:high], count) * self.weights[at])
            low = high
        return out

    def best(self, piece, k: int):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        names = ["a", "b", "sim", "score", "rank"]
        features, weight, row = _flat(piece.column("features"), piece.column("weights"))
        code = np.asarray(pc.fill_null(pc.index_in(features, value_set=self.names), -1))
        row, code, weight = row[code >= 0], code[code >= 0], weight[code >= 0]
        k, step = min(k, self.n), max(1, SCORES // self.n)
        for low in range(0, len(piece), step):
            n = min(step, len(piece) - low)
            first, last = np.searchsorted(row, [low, low + n])
            sims = self.scores(n, row[first:last] - low, code[first:last], weight[first:last])
            places = np.floor(sims * 1e9 + 0.5).astype(np.int64)
            if places.max(initial=0) < (1 << 62) // self.n:
                key = places * self.n + np.arange(self.n - 1, -1, -1)
                top = np.argpartition(key, self.n - k, axis=1)[:, self.n - k :]
                top = np.take_along_axis(top, np.argsort(-np.take_along_axis(key, top, 1), axis=1), 1)
            else:
                top = np.argsort(-places, axis=1, kind="stable")[:, :k]
            owner = piece.column("a").slice(low, n).take(pa.array(np.repeat(np.arange(n), k)))
            values = [np.take_along_axis(m, top, 1).reshape(-1) for m in (sims, places)]
            rank = np.tile(np.arange(1, k + 1, dtype=np.int32), n)
            yield pa.RecordBatch.from_arrays([owner, self.ids.take(pa.array(top.reshape(-1))), *map(pa.array, values), pa.array(rank)], names=names)


def _flat(features, weights):
    """All entries of a column of lists: features, weights, number of the row."""
    import numpy as np
    import pyarrow.compute as pc

    sizes = np.asarray(pc.list_value_length(features))
    return features.flatten(), np.asarray(weights.flatten()), np.repeat(np.arange(len(sizes)), sizes)


# ---- search ---------------------------------------------------------------------------------------
def _postings(right: DataFrame) -> DataFrame:
    """``feature, b, wl``: the posting lists."""
    return right.select("feature", F.col("sig").alias("b"), F.col("weight").alias("wl"))


def _blocks(postings: DataFrame) -> DataFrame:
    """``feature, top, items``: the lists in blocks of about BLOCK entries of like weight; ``top`` is the largest of a block.

    A list is cut by weight and, as far as it is long, by salt, so that no list is sorted or gathered in one place.
    """
    sizes = postings.groupBy("feature").agg(F.count(F.lit(1)).alias("_df"))
    level = F.floor(F.log2("wl") * 4).cast("int")
    salt = F.pmod(F.xxhash64("b"), F.ceil(F.col("_df") / BLOCK))
    rows = postings.join(sizes, "feature").select("feature", level.alias("_level"), salt.alias("_salt"), "b", "wl")
    return rows.groupBy("feature", "_level", "_salt").agg(F.max("wl").alias("top"), F.collect_list(F.struct("b", "wl")).alias("items"))


def _listed(left: DataFrame, postings: DataFrame) -> DataFrame:
    """Entries of the queries whose feature has a list, with the length of the list and its largest weight, and the length of
    all lists of the query together (``work``): ``a, feature, wq, df, top, work``."""
    stats = postings.groupBy("feature").agg(F.count(F.lit(1)).alias("df"), F.max("wl").alias("top"))
    rows = left.join(stats, "feature").select(F.col("sig").alias("a"), "feature", F.col("weight").alias("wq"), "df", "top")
    return rows.withColumn("work", F.sum("df").over(W.partitionBy("a")))


def _bounded(listed: DataFrame, postings: DataFrame) -> DataFrame:
    """``a, feature, wq`` with what all other features of the query can add (``others``), what it and all more frequent ones
    can (``rest``), the entries in the lists of rarer ones (``seen``) and those in its own (``df``)."""
    longest = postings.groupBy("b").agg(F.sum(F.col("wl") * F.col("wl")).alias("_n")).agg(F.sqrt(F.max("_n"))).scalar()
    rows = listed.withColumn("ub", F.col("wq") * F.col("top"))
    common_first = W.partitionBy("a").orderBy(F.desc("df"), "feature").rowsBetween(W.unboundedPreceding, W.currentRow)
    by_sum = F.sum("ub").over(common_first)
    by_norm = F.sqrt(F.sum(F.col("wq") * F.col("wq")).over(common_first)) * F.coalesce(longest, F.lit(0.0))
    return rows.select(
        "a", "feature", "wq", "df",
        (F.sum("ub").over(W.partitionBy("a")) - F.col("ub")).alias("others"),
        F.least(by_sum, by_norm).alias("rest"),
        (F.col("work") - F.sum("df").over(common_first)).alias("seen"),
    )


def _threshold(entries: DataFrame, postings: DataFrame, k: int) -> DataFrame:
    """``a, tau``: the lowest whole score among the k best seeds; queries without k seeds have none."""
    seeds = entries.filter(F.col("seen") < SEEDS * k).select("a", "feature", "wq")
    heads = top_per_group(postings, ["feature"], [F.desc("wl"), F.col("b")], SEEDS * k, "_r").drop("_r")
    partial = seeds.join(heads, "feature").groupBy("a", "b").agg(F.sum(F.col("wq") * F.col("wl")).alias("_p"))
    best = top_per_group(partial, ["a"], [F.desc("_p"), F.col("b")], k, "_r").select("a", "b")
    scored = best.join(postings, "b").join(entries.select("a", "feature", "wq"), ["a", "feature"]).groupBy("a", "b").agg(F.sum(F.col("wq") * F.col("wl")).alias("_s"))
    return scored.groupBy("a").agg(F.count(F.lit(1)).alias("_n"), F.min("_s").alias("tau")).filter(F.col("_n") == k).select("a", "tau")


def _search(entries: DataFrame, postings: DataFrame, tau: DataFrame, k: int | None = None) -> DataFrame:
    """``a, b, sim`` of all pairs that reach the threshold of ``a``; with ``k`` of those only that can be in a top k."""
    known = entries.join(tau, "a", "left").withColumn("tau", F.coalesce("tau", F.lit(0.0)))
    below = F.col("rest") < F.col("tau") - MARGIN
    # leaving lists out pays where they are longer than what the candidates' own vectors cost afterwards
    spared = F.sum(F.when(below, F.col("df")).otherwise(F.lit(0))).over(W.partitionBy("a"))
    opened_ = F.sum(F.when(below, F.lit(0)).otherwise(F.col("df"))).over(W.partitionBy("a"))
    known = stored(known.withColumn("left_out", below & (spared > OWN * opened_)), "opened")
    left_out = F.col("left_out")
    kept = known.filter(~left_out).select("a", "feature", "wq", "others", "tau")
    opened = kept.join(_blocks(postings), "feature").filter(F.col("wq") * F.col("top") + F.col("others") >= F.col("tau") - MARGIN)
    sums = opened.select("a", "wq", F.inline("items")).groupBy("a", "b").agg(F.sum(F.col("wq") * F.col("wl")).alias("_p"))
    missing = known.filter(left_out).groupBy("a").agg(F.max("rest").alias("missing"))
    sums = sums.join(tau, "a", "left").join(missing, "a", "left")
    can_reach = F.col("_p") + F.coalesce("missing", F.lit(0.0)) >= F.coalesce("tau", F.lit(0.0)) - MARGIN
    sums = stored(sums.filter(can_reach).drop("tau"), "sums")
    if k is not None:
        best = top_per_group(sums, ["a"], [F.desc("_p"), F.col("b")], k, "_r").filter(F.col("_r") == k)
        sums = sums.join(best.select("a", F.col("_p").alias("tau")), "a", "left").filter(can_reach).drop("tau")
    dropped = known.filter(left_out).select("a", "feature", "wq")
    open_pairs = sums.filter(F.col("missing").isNotNull()).select("a", "b")
    more = open_pairs.join(postings.select("b", "feature", "wl"), "b").join(dropped, ["a", "feature"])
    more = more.groupBy("a", "b").agg(F.sum(F.col("wq") * F.col("wl")).alias("_m"))
    total = F.col("_p") + F.coalesce("_m", F.lit(0.0))
    return sums.join(more, ["a", "b"], "left").select("a", "b", total.alias("sim"))


def _top(left: DataFrame, postings: DataFrame, k: int) -> DataFrame:
    """``a, b, sim`` over distinct vectors: at least the top k of every query among what shares a feature with it.

    Queries whose lists are short altogether need no threshold.
    """
    listed = stored(_listed(left, postings), "listed")
    short = F.col("work") <= SHORT * k
    plain = listed.filter(short).join(postings, "feature").groupBy("a", "b").agg(F.sum(F.col("wq") * F.col("wl")).alias("sim"))
    long = listed.filter(~short)
    if long.isEmpty():
        return plain
    entries = stored(_bounded(long, postings), "entries")
    return plain.unionByName(_search(entries, postings, cut(_threshold(entries, postings, k)), k))


def _sides(left: DataFrame, right: DataFrame, unit: bool) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Classes and posting lists of the searched side, then classes and entries of the queries, as far as they have a list."""
    ids_b, vb = _classes(right, unit)
    postings = stored(_postings(vb), "postings")
    return ids_b, postings, *_classes(left, unit, postings)


def top_similar(left: DataFrame, right: DataFrame, k: int, unit: bool = True) -> DataFrame:
    """Top ``k`` right ids per left id by (similarity rounded to 9 places, id): ``a, b, sim, rank``.

    Every left id that has an entry gets k rows, or as many as there are right ids; what shares nothing has similarity 0 and
    follows in order of id. ``unit``: cosine; otherwise plain inner products. Of right vectors that are equal only the ``k``
    smallest ids can be in a top k, so a huge group of copies costs k rows and not its square; the search by posting lists also
    ranks equal left vectors once.
    """
    library = stored(first_copies(packed(right, unit), k), "library")
    blocks = block_count(library)
    if blocks is not None:
        return top_products(packed(left, unit, library.select(F.explode("v.feature").alias("feature"))), library, k, blocks)
    ids_b, postings, ids_a, va = _sides(left, right, unit)
    few = top_per_group(ids_b, ["sig"], [F.col("id")], k, "_r").select(F.col("id").alias("_ib"), F.col("sig").alias("b"))
    order = [F.desc(F.round("sim", 9)), F.col("_ib")]
    ranked = top_per_group(_top(va, postings, k).join(few, "b"), ["a"], order, k).select("a", "_ib", "sim", "rank")
    ranked = cut(ranked)
    # at most k of the first 2 k ids share a feature with a query that has fewer than k matches
    first = [r["id"] for r in ids_b.select("id").orderBy("id").limit(2 * k).collect()]
    if first:
        found = ranked.groupBy("a").agg(F.count(F.lit(1)).alias("_n"), F.collect_list("_ib").alias("_have"))
        short = ids_a.select(F.col("sig").alias("a")).distinct().join(found, "a", "left").filter(F.coalesce("_n", F.lit(0)) < k)
        kind = f"array<{ids_b.schema['id'].dataType.simpleString()}>"
        spare = F.array_except(F.array(*[F.lit(i) for i in first]).cast(kind), F.coalesce("_have", F.array().cast(kind)))
        spare = F.slice(spare, F.lit(1), k - F.coalesce("_n", F.lit(0)).cast("int"))
        filled = short.select("a", F.coalesce("_n", F.lit(0)).cast("int").alias("_n"), F.posexplode(spare).alias("_p", "_ib"))
        ranked = ranked.unionByName(filled.select("a", "_ib", F.lit(0.0).alias("sim"), (F.col("_n") + F.col("_p") + 1).alias("rank")))
    owners = ids_a.select(F.col("id").alias("_ia"), F.col("sig").alias("a"))
    return ranked.join(owners, "a").select(F.col("_ia").alias("a"), F.col("_ib").alias("b"), "sim", "rank")


def similar_pairs(left: DataFrame, right: DataFrame, min_sim: float) -> DataFrame:
    """All pairs of ids that share a feature and have a cosine of at least ``min_sim``, which may be 0: ``a, b, sim``."""
    ids_b, postings, ids_a, va = _sides(left, right, True)
    entries = stored(_bounded(_listed(va, postings), postings), "entries")
    floor = entries.select("a").distinct().withColumn("tau", F.lit(float(min_sim)))
    pairs = _search(entries, postings, floor).filter(F.col("sim") >= F.lit(min_sim - 1e-9))
    return pairs.join(ids_a.select(F.col("id").alias("_ia"), F.col("sig").alias("a")), "a").join(
        ids_b.select(F.col("id").alias("_ib"), F.col("sig").alias("b")), "b"
    ).select(F.col("_ia").alias("a"), F.col("_ib").alias("b"), "sim")


def score_pairs(left: DataFrame, right: DataFrame, pairs: DataFrame) -> DataFrame:
    """Cosine of given pairs ``a, b``; 0 when a vector is missing or nothing is shared."""
    wanted = pairs.select("a", "b").distinct()
    a = normalised(left).select(F.col("id").alias("a"), "feature", F.col("weight").alias("_wa"))
    b = normalised(right).select(F.col("id").alias("b"), "feature", F.col("weight").alias("_wb"))
    dots = wanted.join(b, "b").join(a, ["a", "feature"]).groupBy("a", "b").agg(F.sum(F.col("_wa") * F.col("_wb")).alias("dot"))
    return wanted.join(dots, ["a", "b"], "left").select("a", "b", F.coalesce("dot", F.lit(0.0)).alias("sim"))


def ranks_of(left: DataFrame, right: DataFrame, pairs: DataFrame) -> DataFrame:
    """``a, b, rank``: 1 + the number of right ids that are more similar to ``a`` than ``b`` is, by 9 places.

    The lowest score asked for is the threshold of a query, so only what scores higher is worked out.
    """
    ids_b, postings, ids_a, va = _sides(left, right, True)
    entries = stored(_bounded(_listed(va, postings), postings), "entries")
    named = pairs.select("a", "b").distinct().join(ids_a.select(F.col("id").alias("a"), "sig"), "a")
    named = named.join(ids_b.select(F.col("id").alias("b"), F.col("sig").alias("_sb")), "b", "left")
    asked = named.select(F.col("sig").alias("a"), F.col("_sb").alias("b")).distinct()
    dots = asked.join(postings, "b").join(entries.select("a", "feature", "wq"), ["a", "feature"])
    dots = dots.groupBy(F.col("a").alias("sig"), F.col("b").alias("_sb")).agg(F.sum(F.col("wq") * F.col("wl")).alias("_dot"))
    scored = cut(named.join(dots, ["sig", "_sb"], "left").select("a", "b", "sig", F.coalesce("_dot", F.lit(0.0)).alias("sim")))
    floors = scored.groupBy(F.col("sig").alias("a")).agg(F.min("sim").alias("tau"))
    asked = entries.join(floors.select("a"), "a", "left_semi")
    copies = ids_b.groupBy(F.col("sig").alias("b")).agg(F.count(F.lit(1)).alias("_c"))
    better = _search(asked, postings, floors).join(copies, "b").groupBy("a", F.round("sim", 9).alias("_s")).agg(F.sum("_c").alias("_c"))
    # positions among the distinct scores of a query, then the scores asked for
    above = F.sum("_c").over(W.partitionBy("a").orderBy(F.desc("_s")).rowsBetween(W.unboundedPreceding, W.currentRow))
    levels = better.withColumn("_upto", above).select("a", "_s", (F.col("_upto") - F.col("_c")).alias("_above"), "_upto")
    wanted = scored.select("a", "b", "sig", F.round("sim", 9).alias("_s"))
    last = levels.filter("_s > 0").groupBy("a").agg(F.max("_upto").alias("_all"))
    hit = wanted.join(levels.select(F.col("a").alias("sig"), "_s", "_above"), ["sig", "_s"], "left").join(last.withColumnRenamed("a", "sig"), "sig", "left")
    found = F.when(F.col("_s") > 0, F.col("_above")).otherwise(F.col("_all"))
    return hit.select("a", "b", (F.coalesce(found, F.lit(0)) + 1).cast("bigint").alias("rank"))


# ---- text vectors -------------------------------------------------------------------------------
def term_counts(texts: DataFrame, tokens: str = "tokens") -> DataFrame:
    """``id, feature, tf``: how often each token occurs in a text."""
    # a plain explode would have Spark filter empty arrays first, for which it works out the tokens two more times
    terms = texts.select("id", F.explode_outer(tokens).alias("feature")).filter(F.col("feature").isNotNull())
    return terms.groupBy("id", "feature").agg(F.count(F.lit(1)).alias("tf"))


def tfidf(texts: DataFrame, library: DataFrame, tokens: str = "tokens") -> DataFrame:
    """``id, feature, weight``: term count times log((n + 1) / (df + 1)) + 1, with n and df of the library."""
    return weighted_terms(term_counts(texts, tokens), library, tokens)


def weighted_terms(terms: DataFrame, library: DataFrame, tokens: str = "tokens") -> DataFrame:
    """``tfidf`` from counted terms, for texts that are weighted by several libraries."""
    lib = library.select("id", F.explode(F.array_distinct(tokens)).alias("feature"))
    df = lib.groupBy("feature").agg(F.count(F.lit(1)).alias("_df"))
    joined = terms.join(df, "feature", "left").withColumn("_n", library.agg(F.count(F.lit(1))).scalar())
    idf = F.log((F.col("_n") + 1.0) / (F.coalesce("_df", F.lit(0)) + 1.0)) + 1.0
    return joined.select("id", "feature", (F.col("tf") * idf).alias("weight"))
