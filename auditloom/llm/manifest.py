"""Merkle manifest of a dataset: a ternary hash tree per source and one over the sources, as a postorder append log.

Leaves of a source are put in order of doc_id by ranges and cut into aligned blocks of ARITY ** HEIGHT. A builder hashes one
block and writes its nodes in the order in which they are completed, which is postorder; block roots are the leaves of the
next round until a source has one node left, and the sources' roots go through the same rounds. Where a node stands in its
block's part of the log follows from the sizes of the subtrees before it (``place``), so proofs are read from the log by
position: no node is searched for and nothing is hashed again.

Every round is one grouping by (tree, block) with at most ARITY ** HEIGHT rows in a group, however large a source is.

Defined cases: null values are hashed as ``-``; a null source is a source of its own and the first one; rows without doc_id
come first in their source and are never tampered with; rows with equal doc_id follow in the order of their digests, and
equal rows are separate leaves; no documents give no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditloom.llm.common import stored
from auditloom.operators.ranking import ordered_positions

ARITY, HEIGHT = 3, 6
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


# ---- leaves ---------------------------------------------------------------------------------------
def field(value: Column) -> Column:
    """``-`` for null, else the number of its UTF-8 bytes, ``:`` and the value."""
    value = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def leaf(**changed: Column) -> Column:
    """Digest of a row; ``changed`` replaces columns."""
    return F.sha2(F.concat(*[field(changed.get(c, F.col(c))) for c in FIELDS]), 256)


# ---- one block ------------------------------------------------------------------------------------
def widths(leaves: int, height: int) -> list[int]:
    """Nodes of every level of a block, from the leaves up."""
    out = [leaves]
    for _ in range(height):
        out.append(-(-out[-1] // ARITY))
    return out


def height_of(leaves: int) -> int:
    """Levels above the leaves of a tree that ends in one node."""
    return next(h for h in range(99) if ARITY**h >= leaves)


def place(level: int, index: np.ndarray | int, leaves: int, height: int) -> np.ndarray | int:
    """Position in postorder of the node ``index`` of a level.

    Before it are, of its own level and below, all nodes up to the end of its subtree, and of the levels above those whose
    subtrees ended before it began.
    """
    end = np.minimum((np.asarray(index) + 1) * ARITY**level, leaves)
    below = sum(-(-end // ARITY**k) for k in range(level + 1))
    above = sum(np.asarray(index) // ARITY ** (k - level) for k in range(level + 1, height + 1))
    return below + above - 1


def build(leaves: list[str], height: int) -> list[str]:
    """All nodes of a block in postorder."""
    log: list[str] = []
    runs: list[list[str]] = [[] for _ in range(height + 1)]

    def add(level: int, node: str) -> None:
        log.append(node)
        if level < height:
            runs[level].append(node)
            if len(runs[level]) == ARITY:
                close(level)

    def close(level: int) -> None:
        run, runs[level] = runs[level], []
        add(level + 1, digest("".join(run)))

    for node in leaves:
        add(0, node)
    for level in range(height):
        if runs[level]:
            close(level)
    return log


def siblings(log: list[str], leaves: int, height: int) -> list[list[tuple[str, str]]]:
    """For every leaf of a block, level by level, what stands left and right of its ancestor in the run, read from the log."""
    paths: list[list[tuple[str, str]]] = [[] for _ in range(leaves)]
    for level, width in enumerate(widths(leaves, height)[:-1]):
        nodes = [log[p] for p in place(level, np.arange(width), leaves, height).tolist()]
        beside = []
        for i in range(width):
            run = i - i % ARITY
            beside.append(("".join(nodes[run:i]), "".join(nodes[i + 1 : run + ARITY])))
        for i in range(leaves):
            paths[i].append(beside[i // ARITY**level])
    return paths


def folded(node: str, path: list[tuple[str, str]]) -> str:
    """The root that a leaf and its siblings lead to."""
    for left, right in path:
        node = digest(left + node + right)
    return node


# ---- trees ----------------------------------------------------------------------------------------
LOG = pa.schema(
    [("tree", pa.string()), ("round", pa.int32()), ("block", pa.int64()), ("leaves", pa.int32()), ("height", pa.int32()), ("nodes", pa.list_(pa.string())), ("root", pa.string())]
)
LOG_DDL = "tree string, round int, block long, leaves int, height int, nodes array<string>, root string"
STEP = "struct<left:string,right:string>"


def _builder(level: int, most: int):
    """The builder of a round: from a block's rows (``tree``, ``block``, ``position``, ``node``, and ``n``, the nodes of the
    whole tree) its row of the log."""

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by("position")
        nodes, n = group["node"].to_pylist(), group["n"][0].as_py()
        height = height_of(len(nodes)) if n <= ARITY**most else most
        log = build(nodes, height)
        row = (group["tree"][0].as_py(), level, group["block"][0].as_py(), len(nodes), height, log, log[-1])
        return pa.table([pa.array([x], f.type) for x, f in zip(row, LOG, strict=True)], schema=LOG)

    return run


def build_log(nodes: DataFrame, height: int = HEIGHT) -> list[DataFrame]:
    """The log of many trees, round by round. ``nodes`` has ``tree``, ``position`` (from 0) and ``node``."""
    rounds: list[DataFrame] = []
    while True:
        sizes = nodes.groupBy("tree").agg(F.count("*").alias("n"))
        rows = nodes.join(sizes, nodes["tree"].eqNullSafe(sizes["tree"])).drop(sizes["tree"])
        rows = rows.withColumn("block", F.expr(f"position div {ARITY**height}"))
        blocks = rows.select("tree", "block", "position", "node", "n").groupBy("tree", "block")
        log = stored(blocks.applyInArrow(_builder(len(rounds), height), LOG_DDL), "merkle-log")
        rounds.append(log)
        if log.where("block > 0").isEmpty():
            return rounds
        many = log.groupBy("tree").agg(F.max("block").alias("_b")).where("_b > 0").select("tree")
        nodes = log.join(many, log["tree"].eqNullSafe(many["tree"]), "left_semi").select("tree", F.col("block").alias("position"), F.col("root").alias("node"))


def tree_roots(rounds: list[DataFrame]) -> DataFrame:
    """``tree``, ``root``: of every tree the last node."""
    out = None
    for k, log in enumerate(rounds):
        last = log.groupBy("tree").agg(F.max("block").alias("_b"), F.min("root").alias("root")).where("_b = 0").select("tree", "root")
        out = last if out is None else out.unionByName(last)
    return out


def _inner_paths(blocks: DataFrame, height: int) -> DataFrame:
    """``tree``, ``position``, ``path`` of the leaves of blocks: within a block as the log tells, then as ``above`` says."""

    def run(group: pa.Table) -> pa.Table:
        row = {c: group[c][0].as_py() for c in group.column_names}
        above = [(x["left"], x["right"]) for x in row["above"]]
        own = siblings(row["nodes"], row["leaves"], row["height"])
        paths = [[{"left": a, "right": b} for a, b in path + above] for path in own]
        start = row["block"] * ARITY**height
        columns = [[row["tree"]] * len(own), list(range(start, start + len(own))), paths]
        kinds = [pa.string(), pa.int64(), pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))]
        return pa.table([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["tree", "position", "path"])

    return blocks.groupBy("tree", "block").applyInArrow(run, f"tree string, position long, path array<{STEP}>")


def block_paths(rounds: list[DataFrame], above: DataFrame, height: int = HEIGHT) -> DataFrame:
    """The blocks of the first round with ``above``: the siblings between a block's root and the very top.

    ``above`` has ``tree`` and ``path`` of the trees' own roots. From the last round down, the paths of a round's leaves are
    what stands above the blocks of the round before.
    """
    given = above.select("tree", F.lit(0).cast("long").alias("position"), "path")
    for k in range(len(rounds) - 1, -1, -1):
        log, paths = rounds[k], given.withColumnRenamed("tree", "_tree").withColumnRenamed("path", "above")
        # a tree that ended in this round gets its path from above, others from the round after
        blocks = log.join(paths, log["tree"].eqNullSafe(F.col("_tree")) & (F.col("block") == F.col("position"))).select(*log.columns, "above")
        if k == 0:
            return blocks
        ended = rounds[k - 1].groupBy("tree").agg(F.max("block").alias("_b")).where("_b = 0").select("tree")
        inner = _inner_paths(blocks, height)
        roots = above.join(ended, above["tree"].eqNullSafe(ended["tree"]), "left_semi").select("tree", F.lit(0).cast("long").alias("position"), "path")
        given = stored(inner.unionByName(roots), "merkle-paths")
    return None


def _prover(top: str):
    """Proofs of one block's leaves, and the roots that their digests as found (``now``) lead to."""

    def run(leaves: pa.Table, blocks: pa.Table) -> pa.Table:
        leaves = leaves.sort_by("position")
        row = {c: blocks[c][0].as_py() for c in blocks.column_names}
        above = [(x["left"], x["right"]) for x in row["above"]]
        paths = [path + above for path in siblings(row["nodes"], row["leaves"], row["height"])]
        proofs = [digest("".join(a + b for a, b in path)) for path in paths]
        found = [folded(now, path) for now, path in zip(leaves["now"].to_pylist(), paths, strict=True)]
        done = leaves.select(["doc_id", "leaf", "tree"]).append_column("proof_sha256", pa.array(proofs))
        return done.append_column("folded_root", pa.array(found)).append_column("root", pa.array([top] * len(found)))

    return run


def manifest(docs: DataFrame, now: Column, height: int = HEIGHT) -> DataFrame:
    """Per row: ``doc_id``, ``leaf``, ``subroot``, ``root``, ``proof_sha256``, ``folded_root``, ``verified``.

    ``now`` is the text as it is found when proofs are checked; a row is verified if its digest with that text and the
    original siblings still lead to the root.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").alias("tree"), leaf().alias("leaf"), leaf(text=now).alias("now"))
    placed = ordered_positions(rows, ["tree"], [F.col("doc_id").asc_nulls_first(), F.col("leaf"), F.col("now")])
    leaves = stored(placed.withColumn("position", F.col("position") - 1), "merkle-leaves")
    rounds = build_log(leaves.select("tree", "position", F.col("leaf").alias("node")), height)
    roots = stored(tree_roots(rounds), "merkle-roots")

    # the tree over the sources: one unnamed tree whose leaves are the sources' roots
    ordered = ordered_positions(roots, [], [F.col("tree").asc_nulls_first()])
    ordered = stored(ordered.select(F.col("tree").alias("source"), "root", (F.col("position") - 1).alias("position")), "merkle-sources")
    top_rounds = build_log(ordered.select(F.lit(None).cast("string").alias("tree"), "position", F.col("root").alias("node")), height)
    top = tree_roots(top_rounds).first()
    top = top["root"] if top else ""
    nothing = top_rounds[0].sparkSession.createDataFrame([(None, [])], f"tree string, path array<{STEP}>")
    top_paths = _inner_paths(block_paths(top_rounds, nothing, height), height)
    above = stored(ordered.join(top_paths.drop("tree"), "position").select(F.col("source").alias("tree"), "path"), "merkle-top")

    blocks = block_paths(rounds, above, height)
    leaves = leaves.withColumn("block", F.expr(f"position div {ARITY**height}"))
    proved = leaves.groupBy("tree", "block").cogroup(blocks.groupBy("tree", "block")).applyInArrow(
        _prover(top), "doc_id long, leaf string, tree string, proof_sha256 string, folded_root string, root string"
    )
    named = roots.select(F.col("tree").alias("_tree"), F.col("root").alias("subroot"))
    return proved.join(named, proved["tree"].eqNullSafe(F.col("_tree"))).select(
        "doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified")
    )


def without_line_feeds() -> Column:
    """Texts whose doc_id has an even crc32 lose their line feeds; the others, and nulls, stay."""
    even = F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary")) % 2 == 0
    return F.when(even, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
