"""Hard negatives by a spanning tree over the anchors.

Anchors are cut into blocks of TREE; a task joins the anchors of each block into a minimum spanning tree of their distances.
A pass takes PASS such trees, which is a bounded amount, over all rows: the score of a row with the root is counted, and with
every other anchor it lies within the score (or bound) at the parent, plus or minus the length of the edge times the norm of
the row. Only rows whose bounds overlap the window that an anchor still needs are scored anew; the rest keep their bounds, which
widen down the tree. A first round finds the positives, a second one the negatives, whose windows follow from the positives'
scores. Every task keeps the best few of each anchor, so that what is shuffled does not depend on how many rows tie.

Scores are exact integers: floating-point products are used only where they cannot round.

Defined cases: rows without id, label or vector, or with a component that is null or not finite, take no part; rows repeated
under one id count as the one with the smallest (label, vector); vectors of different lengths have no score with each other;
anchors without positives or negatives have no rows; no rows give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditloom.llm.common import stored
from auditloom.operators.ranking import ordered_positions

TREE, PASS = 1024, 8  # anchors of a tree, trees of a pass: at most 8,192 vectors are broadcast at a time
ROWS = 1024  # rows scored at a time
EXACT = float(1 << 53)


# ---- vectors --------------------------------------------------------------------------------------
def usable(rows: DataFrame, label: Column, scale: int = 256) -> DataFrame:
    """``vec_id``, ``label`` and ``vector`` (array of long, floor(scale * x)) of the rows that take part."""
    wide = F.transform("embedding", lambda x: x.cast("double"))
    finite = F.forall(wide, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    vector = F.transform("_wide", lambda x: F.floor(x * float(scale)))
    kept = rows.select(F.col("vec_id").cast("long").alias("vec_id"), label.cast("long").alias("label"), wide.alias("_wide"), finite.alias("_ok"))
    kept = kept.where("vec_id IS NOT NULL AND label IS NOT NULL AND _wide IS NOT NULL AND _ok").select("vec_id", "label", vector.alias("vector"))
    return kept.groupBy("vec_id").agg(F.min(F.struct("label", "vector")).alias("_m")).select("vec_id", "_m.label", "_m.vector")


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of all rows of two integer matrices."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(1, a.shape[1])
    if most < EXACT:
        return np.rint(a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


def matrix(column: pa.ListArray, size: int) -> np.ndarray:
    """The vectors of a column, all of length ``size``."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), size)


# ---- trees ----------------------------------------------------------------------------------------
def spanning_tree(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, parent, edge) of a minimum spanning tree: anchors in the order in which they join, from the first on, the
    place in that order of the one they join (-1 for the root), and their distance to it."""
    n, real = len(vectors), vectors.astype(np.float64)
    order, parent, edge = np.zeros(n, np.int64), np.full(n, -1, np.int64), np.zeros(n)
    nearest, near_to, left = np.full(n, np.inf), np.zeros(n, np.int64), np.ones(n, bool)
    at = 0
    for k in range(n):
        order[k], left[at] = at, False
        if k:
            parent[k], edge[k] = near_to[at], nearest[at]
        far = np.sqrt(((real - real[at]) ** 2).sum(axis=1))
        closer = left & (far < nearest)
        nearest[closer], near_to[closer] = far[closer], k
        at = int(np.argmin(np.where(left, nearest, np.inf)))
    return order, parent, edge


TREES = "tree long, size int, vec_id array<long>, label array<long>, vectors array<long>, parent array<int>, edge array<double>"
TREES_ARROW = pa.schema(
    [("tree", pa.int64()), ("size", pa.int32()), *((c, pa.list_(pa.int64())) for c in ("vec_id", "label", "vectors")), ("parent", pa.list_(pa.int32())), ("edge", pa.list_(pa.float64()))]
)


def _plant(group: pa.Table) -> pa.Table:
    group = group.sort_by("vec_id")
    size = group["size"][0].as_py()
    vectors = matrix(group["vector"].combine_chunks(), size)
    order, parent, edge = spanning_tree(vectors)
    ids, labels = (group[c].to_numpy()[order] for c in ("vec_id", "label"))
    row = (group["tree"][0].as_py(), size, ids, labels, vectors[order].ravel(), parent.astype(np.int32), edge)
    return pa.table([pa.array([x], f.type) for x, f in zip(row, TREES_ARROW, strict=True)], schema=TREES_ARROW)


def plant(anchors: DataFrame, most: int = TREE) -> DataFrame:
    """One row per tree over at most ``most`` anchors of one vector length; neighbours by label are put together."""
    placed = ordered_positions(anchors.withColumn("size", F.size("vector")), ["size"], [F.col("label"), F.col("vec_id")])
    blocks = placed.withColumn("tree", F.expr(f"(position - 1) div {most}")).select("tree", "size", "vec_id", "label", "vector")
    return stored(blocks.groupBy("size", "tree").applyInArrow(_plant, TREES), "anchor-trees")


class Tree:
    """The anchors of one tree, with what an anchor still needs: for each slot the lowest and the highest score."""

    def __init__(self, row: dict, low: np.ndarray, high: np.ndarray, keep: int):
        self.ids, self.labels = np.array(row["vec_id"], np.int64), np.array(row["label"], np.int64)
        self.vectors = np.array(row["vectors"], np.int64).reshape(len(self.ids), row["size"])
        self.parent, self.edge = np.array(row["parent"]), np.array(row["edge"])
        self.low, self.high, self.keep = low, high, keep  # anchors x slots
        n, slots = low.shape
        self.best = [[(np.zeros(0, np.int64), np.zeros(0, np.int64))] * slots for _ in range(n)]
        self.need = low.copy()  # rises once a slot is full
        depth = np.zeros(n, np.int64)
        for k in range(1, n):
            depth[k] = depth[self.parent[k]] + 1
        self.levels = [np.flatnonzero(depth == d) for d in range(int(depth.max(initial=0)) + 1)]
        self.counted = 0

    def take(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, same: bool) -> None:
        """Offer rows to all anchors; ``same``: those of the anchor's label, else those of the others."""
        n = len(ids)
        norms = np.sqrt((vectors.astype(np.float64) ** 2).sum(axis=1))
        centre, radius = np.zeros((len(self.ids), n)), np.zeros((len(self.ids), n))
        scores = np.zeros((len(self.ids), n), np.int64)
        open_ = (self.need <= self.high).any(axis=1)
        need = np.where(self.need <= self.high, self.need, np.iinfo(np.int64).max).min(axis=1)
        most = np.where(self.need <= self.high, self.high, np.iinfo(np.int64).min).max(axis=1)
        for depth, at in enumerate(self.levels):
            fits = (self.labels[at][:, None] == labels[None, :]) == same
            if depth:
                up = self.parent[at]
                centre[at] = centre[up]
                radius[at] = radius[up] + self.edge[at][:, None] * norms[None, :] * (1 + 1e-9) + 1e-3
                wanted = fits & open_[at][:, None] & (centre[at] + radius[at] >= need[at][:, None]) & (centre[at] - radius[at] <= most[at][:, None])
            else:
                wanted = np.ones((len(at), n), bool)  # the root's scores are the start of all bounds
            lines = wanted.any(axis=1)
            if not lines.any():
                continue
            rows = np.flatnonzero(wanted.any(axis=0))
            some = at[lines]
            found = products(self.vectors[some], vectors[rows])
            chosen = wanted[lines][:, rows]
            a, x = np.nonzero(chosen)
            scores[some[a], rows[x]] = found[a, x]
            centre[some[a], rows[x]], radius[some[a], rows[x]] = found[a, x], 0
            self.counted += len(a)
            inside = chosen & fits[lines][:, rows] & open_[some][:, None] & (found >= need[some][:, None]) & (found <= most[some][:, None])
            for i in np.flatnonzero(inside.any(axis=1)).tolist():
                pick = rows[inside[i]]
                self._offer(int(some[i]), ids[pick], scores[some[i], pick])

    def _offer(self, anchor: int, ids: np.ndarray, scores: np.ndarray) -> None:
        other = ids != self.ids[anchor]
        ids, scores = ids[other], scores[other]
        for slot in range(self.low.shape[1]):
            fits = (scores >= self.need[anchor, slot]) & (scores <= self.high[anchor, slot])
            if fits.any():
                have, points = self.best[anchor][slot]
                have, points = np.concatenate((have, ids[fits])), np.concatenate((points, scores[fits]))
                first = np.lexsort((have, -points))[: self.keep]
                self.best[anchor][slot] = have[first], points[first]
                if len(first) == self.keep:  # ties may have smaller ids
                    self.need[anchor, slot] = max(self.low[anchor, slot], points[first[-1]])

    def results(self) -> list[tuple[np.ndarray, ...]]:
        out = []
        for k, slots in enumerate(self.best):
            for slot, (ids, scores) in enumerate(slots):
                out.append((np.full(len(ids), self.ids[k]), np.full(len(ids), slot), ids, scores))
        return out


# ---- passes ---------------------------------------------------------------------------------------
FOUND = "anchor_id long, slot int, vec_id long, score long"


def _pass(rows: DataFrame, trees: list[dict], windows: dict[int, list[tuple[int, int]]] | None, keep: int) -> DataFrame:
    """The best ``keep`` rows of every task for each slot of the anchors of a pass.

    Without ``windows`` there is one slot, for all rows of the anchor's label; else a slot per window, for the other labels.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planted: list[Tree] = []
        for row in trees:
            slots = 1 if windows is None else max([1, *(len(windows.get(i, ())) for i in row["vec_id"])])
            low, high = np.ones((len(row["vec_id"]), slots), np.int64), np.zeros((len(row["vec_id"]), slots), np.int64)
            if windows is None:
                low[:], high[:] = np.iinfo(np.int64).min, np.iinfo(np.int64).max
            else:
                for k, i in enumerate(row["vec_id"]):
                    for slot, window in enumerate(windows.get(i, ())):
                        low[k, slot], high[k, slot] = window
            planted.append(Tree(row, low, high, keep))
        for batch in batches:
            sizes = np.diff(batch.column(2).offsets.to_numpy())
            for size in {t.vectors.shape[1] for t in planted}:
                here = batch.filter(pa.array(sizes == size))
                for lo in range(0, len(here), ROWS):
                    part = here.slice(lo, ROWS)
                    ids, labels = (part.column(i).to_numpy() for i in (0, 1))
                    vectors = matrix(part.column(2), size)
                    for tree in planted:
                        if tree.vectors.shape[1] == size:
                            tree.take(ids, labels, vectors, windows is None)
        for tree in planted:
            columns = [np.concatenate(x) for x in zip(*tree.results(), strict=True)]
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["anchor_id", "slot", "vec_id", "score"])

    return rows.select("vec_id", "label", "vector").mapInArrow(run, FOUND)


def _first(found: DataFrame, keys: list[str], keep: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= keep)


def hard_negatives(
    rows: DataFrame, anchors: Column, positives: int = 5, negatives: int = 3, least: int = 50, most: int = 95, tree: int = TREE, trees: int = PASS
) -> DataFrame:
    """``anchor_id``, ``positive_id``, ``rank``, ``negative_id``, ``positive_score``, ``negative_score``.

    ``rows`` as ``usable`` gives them; ``anchors`` tells which are anchors. A negative of a positive has another label than
    the anchor and a score between ``least`` and ``most`` percent of the positive's.
    """
    rows = stored(rows, "vectors")
    planted = plant(rows.where(anchors), tree)
    numbers = sorted((r["size"], r["tree"]) for r in planted.select("size", "tree").collect())  # a pair for each tree
    out = None
    for i in range(0, len(numbers), trees):
        chosen = numbers[i : i + trees]
        wanted = [(F.col("size") == s) & (F.col("tree") == t) for s, t in chosen]
        condition = wanted[0]
        for w in wanted[1:]:
            condition = condition | w
        held = [r.asDict() for r in planted.where(condition).collect()]  # at most ``tree * trees`` anchors
        near = stored(_first(_pass(rows, held, None, positives), ["anchor_id"], positives), "positives")
        windows: dict[int, list[tuple[int, int]]] = {}
        for r in near.orderBy("anchor_id", "rank").collect():  # at most ``positives`` an anchor
            windows.setdefault(r["anchor_id"], []).append((-(-least * r["score"] // 100), most * r["score"] // 100))
        far = _first(_pass(rows, held, windows, negatives), ["anchor_id", "slot"], negatives)
        near = near.select("anchor_id", (F.col("rank") - 1).alias("slot"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
        far = far.select("anchor_id", "slot", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
        found = stored(near.join(far, ["anchor_id", "slot"]).drop("slot"), "negatives")
        out = found if out is None else out.unionByName(found)
    names = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    if out is None:
        return rows.sparkSession.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    return out.select(*names)
