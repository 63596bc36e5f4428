"""Training-set builders: drops, masks, injections, fused negatives, verification.

Random draws are md5 draws on (key, seed), so every result can be reproduced on any partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from auditloom.functions import fixed_values as V
from auditloom.functions import text as T
from auditloom.functions.hashing import any_of, hash60, unit_draw
from auditloom.operators.features import token_mean
from auditloom.operators.graph import degrees
from auditloom.operators.ranking import ordered_positions

GRAPH = ["snapshot_id"]


# ---- edge drops and feature masks -----------------------------------------------------------------
def _keep_some(scored: DataFrame, by: list[str]) -> DataFrame:
    """Keep edges whose draw exceeds their drop chance; a graph that would lose all keeps its highest draw."""
    best = scored.groupBy(*by).agg(
        F.max(F.struct("_draw", "src", "dst")).alias("_best"), F.max((F.col("_draw") > F.col("_p")).cast("int")).alias("_any")
    )
    joined = scored.join(best, by)
    is_best = (F.col("src") == F.col("_best.src")) & (F.col("dst") == F.col("_best.dst"))
    kept = (F.col("_draw") > F.col("_p")) | ((F.col("_any") == 0) & is_best)
    return joined.filter(kept).drop("_draw", "_p", "_best", "_any")


def drop_edges(edges: DataFrame, p: float, seed: int, by: list[str] = GRAPH) -> DataFrame:
    draw = unit_draw(*[F.col(c) for c in (*by, "src", "dst")], seed)
    return _keep_some(edges.withColumn("_draw", draw).withColumn("_p", F.lit(p)), by)


def drop_edges_by_degree(edges: DataFrame, p: float, seed: int, by: list[str] = GRAPH) -> DataFrame:
    """Drop chance p/2 * (normalised degree of both ends): edges between busy nodes go first."""
    norm = degrees(edges, by).select(*by, "node", "degree_norm")
    a = norm.select(*by, F.col("node").alias("src"), F.col("degree_norm").alias("_a"))
    b = norm.select(*by, F.col("node").alias("dst"), F.col("degree_norm").alias("_b"))
    chance = F.least(F.greatest(F.lit(p * 0.5) * (F.col("_a") + F.col("_b")), F.lit(0.0)), F.lit(1.0))
    draw = unit_draw(*[F.col(c) for c in (*by, "src", "dst")], seed)
    scored = edges.join(a, [*by, "src"]).join(b, [*by, "dst"]).withColumn("_draw", draw).withColumn("_p", chance)
    return _keep_some(scored.drop("_a", "_b"), by)


def mask_features(df: DataFrame, vec: str, key: list[str], p: float, seed: int) -> DataFrame:
    cols = [F.col(k) for k in key]
    masked = F.transform(vec, lambda x, i: F.when(unit_draw(*cols, i, seed) < p, F.lit(0.0)).otherwise(x))
    return df.withColumn(vec, masked)


def mask_features_by_degree(vectors: DataFrame, kept_edges: DataFrame, p: float, seed: int, by: list[str] = GRAPH):
    """Mask chance p * (1 - normalised degree) on the edges that are left; nodes without edges have degree 0."""
    deg = degrees(kept_edges, by).select(*by, F.col("node").alias("name"), "degree")
    sized = vectors.join(deg, [*by, "name"], "left").withColumn("_d", F.coalesce("degree", F.lit(0)))
    span = sized.groupBy(*by).agg(F.min("_d").alias("_lo"), F.max("_d").alias("_hi"))
    width = F.col("_hi") - F.col("_lo")
    normed = F.when(width == 0, F.lit(0.0)).otherwise((F.col("_d") - F.col("_lo")) / width)
    joined = sized.join(span, by).withColumn("_p", F.lit(p) * (1.0 - normed))
    cols = [F.col(c) for c in (*by, "name")]
    masked = F.transform("vec", lambda x, i: F.when(unit_draw(*cols, i, seed) < F.col("_p"), F.lit(0.0)).otherwise(x))
    return joined.select(*by, "name", masked.alias("vec"))


# ---- pools ----------------------------------------------------------------------------------------
def numbered_pool(pool: DataFrame, key: list[str], seed: int, by: list[str] | None = None) -> DataFrame:
    """``pool_idx`` 0..n-1 in hash order (per ``by`` group) and the pool size ``pool_n``."""
    group = by or []
    order = [hash60(*[F.col(k) for k in key], seed), *[F.col(k) for k in key]]
    placed = ordered_positions(pool, group, order, "_p").withColumn("pool_idx", F.col("_p") - 1).drop("_p")
    if group:
        return placed.join(pool.groupBy(*group).agg(F.count(F.lit(1)).alias("pool_n")), group)
    return placed.withColumn("pool_n", pool.agg(F.count(F.lit(1))).scalar())


def pool_sample(pool: DataFrame, key: list[str], size: int, seed: int) -> DataFrame:
    """``size`` rows of the pool in hash order, starting over when the pool is short: ``draw`` 0..size-1."""
    numbered = numbered_pool(pool, key, seed)
    repeats = F.expr(f"({size - 1} - pool_idx) div pool_n")
    taken = numbered.filter(F.col("pool_idx") < size)
    draws = F.transform(F.sequence(F.lit(0), repeats), lambda i: F.col("pool_idx") + i * F.col("pool_n"))
    return taken.withColumn("draw", F.explode(draws)).drop("pool_idx", "pool_n")


def balanced(df: DataFrame, label: str, key: list[str], seed: int, ratio: int = 10, least: int = 500) -> DataFrame:
    """Benign rows capped at max(ratio * attack, least) in hash order, attack rows repeated to match: ``copy``."""
    counts = df.agg(F.count_if(F.col(label) == 1).alias("a"), F.count_if(F.col(label) == 0).alias("b"))
    attack, benign = counts.select("a").scalar(), counts.select("b").scalar()
    placed = ordered_positions(df, [label], [hash60(*[F.col(k) for k in key], seed), *[F.col(k) for k in key]], "_pos")
    placed = placed.withColumns({"_a": attack, "_b": benign})
    target = F.least(F.col("_b"), F.greatest(F.col("_a") * ratio, F.lit(least)))
    placed = placed.withColumn("_target", target)
    copies = F.when(
        F.col(label) == 0, F.when(F.col("_pos") <= F.col("_target"), F.lit(1)).otherwise(F.lit(0))
    ).otherwise(F.when(F.col("_pos") <= F.col("_target"), F.expr("(_target - _pos) div _a + 1")).otherwise(F.lit(0)))
    repeated = placed.withColumn("_n", copies.cast("int")).filter(F.col("_n") > 0)
    return repeated.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("_n")))).drop("_pos", "_a", "_b", "_target", "_n")


def origin_share(rows: DataFrame, origin: str) -> DataFrame:
    """Rows per origin and their percent of all rows."""
    counts = rows.groupBy(origin).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("_t", rows.agg(F.count(F.lit(1))).scalar()).select(
        origin, "n", (100.0 * F.col("n") / F.col("_t")).alias("share")
    )


# ---- injections -------------------------------------------------------------------------------------
def inject_features(attack: DataFrame, benign: DataFrame, share: float, seed: int, by: list[str] = GRAPH) -> DataFrame:
    """Replace max(1, floor(share * n)) node vectors of each attack graph by vectors of the benign pool."""
    order = [hash60(*[F.col(c) for c in (*by, "name")], seed), F.col("name")]
    placed = ordered_positions(attack, by, order, "_pos")
    sizes = attack.groupBy(*by).agg(F.greatest(F.lit(1), F.floor(F.count(F.lit(1)) * share)).alias("_k"))
    placed = placed.join(sizes, by).withColumn("_swap", F.col("_pos") <= F.col("_k"))
    pool = numbered_pool(benign.select("vec", *[F.col(c).alias(f"_{c}") for c in (*by, "name")]), [f"_{c}" for c in (*by, "name")], seed)
    n = benign.agg(F.count(F.lit(1))).scalar()
    picked = placed.withColumn("_n", n).withColumn("pool_idx", hash60(*[F.col(c) for c in (*by, "name")], seed + 1) % F.col("_n"))
    swap = picked.filter("_swap").drop("vec").join(pool.select("pool_idx", "vec"), "pool_idx")
    out = swap.select(*by, "name", "vec", F.lit(1).alias("replaced"))
    return out.unionByName(picked.filter("NOT _swap").select(*by, "name", "vec", F.lit(0).alias("replaced")))


def inject_edges(nodes: DataFrame, edges: DataFrame, share: float, seed: int, by: list[str] = GRAPH) -> DataFrame:
    """max(1, floor(share * edges)) extra edges between hash-drawn nodes of each graph, in both directions."""
    indexed = ordered_positions(nodes.select(*by, "name"), by, [F.col("name")], "_i")
    sizes = nodes.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    wanted = edges.groupBy(*by).agg(F.greatest(F.lit(1), F.floor(F.count(F.lit(1)) * share)).alias("_k")).join(sizes, by)
    draws = wanted.withColumn("draw", F.explode(F.sequence(F.lit(1), F.col("_k").cast("int"))))
    cols = [F.col(c) for c in by]
    draws = draws.withColumns(
        {
            "_s": hash60(*cols, F.col("draw"), seed) % F.col("_n") + 1,
            "_d": hash60(*cols, F.col("draw"), seed + 1) % F.col("_n") + 1,
        }
    )
    a = indexed.select(*by, F.col("_i").alias("_s"), F.col("name").alias("src"))
    b = indexed.select(*by, F.col("_i").alias("_d"), F.col("name").alias("dst"))
    made = draws.join(a, [*by, "_s"]).join(b, [*by, "_d"])
    ends = F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return made.select(*by, "draw", F.inline(ends))


def corrupt_with_tokens(
    vectors: DataFrame, token_pool: DataFrame, words: DataFrame, dim: int, ratio: float, lists: int, seed: int, by=GRAPH
) -> DataFrame:
    """With chance ``ratio`` a node's vector becomes the mean vector of ``lists`` drawn malicious token lists.

    ``token_pool(origin, tokens)``: one row per malicious node.
    """
    key = [*by, "name"]
    cols = [F.col(c) for c in key]
    n = token_pool.agg(F.count(F.lit(1))).scalar()
    pool = numbered_pool(token_pool, ["origin"], seed)
    chosen = vectors.select(*key, (unit_draw(*cols, seed) < ratio).alias("_hit")).filter("_hit")
    drawn = chosen.withColumn("_n", n).withColumn("_i", F.explode(F.sequence(F.lit(1), F.lit(lists))))
    drawn = drawn.withColumn("pool_idx", hash60(*cols, F.col("_i"), seed + 1) % F.col("_n"))
    tokens = drawn.join(pool.select("pool_idx", "tokens"), "pool_idx").select(*key, "tokens")
    fresh = token_mean(tokens, key, "tokens", words, dim).withColumnRenamed("vec", "_fresh")
    joined = vectors.join(fresh, key, "left")
    return joined.select(*key, F.coalesce("_fresh", "vec").alias("vec"), F.col("_fresh").isNotNull().cast("int").alias("corrupted"))


# ---- fused negatives ------------------------------------------------------------------------------
def fused_negatives(
    benign_nodes: DataFrame, benign_edges: DataFrame, attack_nodes: DataFrame, attack_edges: DataFrame,
    seed: int, ratio: float = 0.5, cross_ratio: float = 0.2, cross_max: int = 8,
):
    """Every attack ego joined to the first half of a hash-drawn benign ego plus a few cross edges.

    Node tables are ``ego_id, pos`` (0-based order in the ego), edge tables ``ego_id, src_pos, dst_pos``.
    Returns (nodes, edges): positions of the attack part follow those of the benign part.
    """
    attacks = attack_nodes.groupBy("ego_id").agg(F.count(F.lit(1)).alias("n_attack"))
    benign = benign_nodes.groupBy("ego_id").agg(F.count(F.lit(1)).alias("n_benign"))
    pool = numbered_pool(benign, ["ego_id"], seed).select(F.col("ego_id").alias("benign_id"), "n_benign", "pool_idx")
    n = benign.agg(F.count(F.lit(1))).scalar()
    plan = attacks.withColumn("_n", n).withColumn("pool_idx", hash60(F.col("ego_id"), seed + 1) % F.col("_n"))
    plan = plan.join(pool, "pool_idx").drop("_n", "pool_idx")
    k = F.least(F.greatest(F.lit(1), F.bround(F.col("n_benign") * F.lit(ratio)).cast("bigint")), F.col("n_benign"))
    plan = plan.withColumn("k", k)
    base = F.least("k", "n_attack")
    cross = F.greatest(F.lit(1), F.least(base, F.lit(cross_max), F.bround(base * F.lit(cross_ratio)).cast("bigint")))
    plan = plan.withColumn("n_cross", cross)
    b = benign_nodes.select(F.col("ego_id").alias("benign_id"), "pos")
    left = plan.join(b, "benign_id").filter(F.col("pos") < F.col("k")).select("ego_id", F.lit("benign").alias("part"), "pos")
    right = plan.join(attack_nodes.select("ego_id", "pos"), "ego_id").select(
        "ego_id", F.lit("attack").alias("part"), (F.col("pos") + F.col("k")).alias("pos")
    )
    be = benign_edges.select(F.col("ego_id").alias("benign_id"), "src_pos", "dst_pos")
    inner = plan.join(be, "benign_id").filter((F.col("src_pos") < F.col("k")) & (F.col("dst_pos") < F.col("k")))
    inner = inner.select("ego_id", F.lit("benign").alias("part"), "src_pos", "dst_pos")
    shifted = plan.join(attack_edges.select("ego_id", "src_pos", "dst_pos"), "ego_id").select(
        "ego_id", F.lit("attack").alias("part"), (F.col("src_pos") + F.col("k")).alias("src_pos"),
        (F.col("dst_pos") + F.col("k")).alias("dst_pos"),
    )
    draws = plan.withColumn("_i", F.explode(F.sequence(F.lit(1), F.col("n_cross").cast("int"))))
    p = hash60(F.col("ego_id"), F.col("_i"), seed + 2) % F.col("k")
    q = hash60(F.col("ego_id"), F.col("_i"), seed + 3) % F.col("n_attack") + F.col("k")
    both = F.array(F.struct(p.alias("src_pos"), q.alias("dst_pos")), F.struct(q.alias("src_pos"), p.alias("dst_pos")))
    crossing = draws.select("ego_id", F.lit("cross").alias("part"), F.inline(both))
    return left.unionByName(right), inner.unionByName(shifted).unionByName(crossing)


def replace_nodes(b_nodes: DataFrame, a_nodes: DataFrame, mapping: DataFrame) -> DataFrame:
    """Benign nodes with everything but the name taken from the mapped attack node.

    Tables carry ``pair_id, name, type, prop, frequency, label``; ``mapping(pair_id, a_node, b_node)``.
    """
    fields = ("type", "prop", "frequency", "label")
    donor = mapping.join(a_nodes.withColumnRenamed("name", "a_node"), ["pair_id", "a_node"])
    donor = donor.select("pair_id", F.col("b_node").alias("name"), *[F.col(c).alias(f"_{c}") for c in fields])
    joined = b_nodes.join(donor.withColumn("_r", F.lit(1)), ["pair_id", "name"], "left")
    cols = [F.when(F.col("_r") == 1, F.col(f"_{c}")).otherwise(F.col(c)).alias(c) for c in fields]
    return joined.select("pair_id", "name", *cols, F.coalesce("_r", F.lit(0)).alias("replaced"))


def replace_edges(b_edges: DataFrame, a_edges: DataFrame, mapping: DataFrame) -> DataFrame:
    """Benign edges without those inside the region, plus the mapped attack edges."""
    inside = mapping.select("pair_id", F.col("b_node").alias("node"))
    s = inside.select("pair_id", F.col("node").alias("src"), F.lit(1).alias("_s")).distinct()
    d = inside.select("pair_id", F.col("node").alias("dst"), F.lit(1).alias("_d")).distinct()
    kept = b_edges.join(s, ["pair_id", "src"], "left").join(d, ["pair_id", "dst"], "left")
    kept = kept.filter(F.col("_s").isNull() | F.col("_d").isNull()).select("pair_id", "src", "dst", "actions_str")
    ms = mapping.select("pair_id", F.col("a_node").alias("src"), F.col("b_node").alias("_src"))
    md = mapping.select("pair_id", F.col("a_node").alias("dst"), F.col("b_node").alias("_dst"))
    moved = a_edges.join(ms, ["pair_id", "src"]).join(md, ["pair_id", "dst"])
    return kept.unionByName(moved.select("pair_id", F.col("_src").alias("src"), F.col("_dst").alias("dst"), "actions_str"))


# ---- corpus, tags, substitution -----------------------------------------------------------------------
def command_words(prop: Column) -> Column:
    """Words of the command line of a process property."""
    return F.filter(F.split(T.process_fields(prop)[0], r"\s+"), lambda w: w != "")


def benign_corpus(nodes: DataFrame) -> DataFrame:
    """Distinct ``kind, item``: commands and arguments of processes, paths of files."""
    props = nodes.select("type", "prop").distinct()
    words = command_words(F.col("prop"))
    procs = props.filter(T.is_process(F.col("type"))).select(F.posexplode(words).alias("_i", "item"))
    kind = F.when(F.col("_i") == 0, "command").otherwise("argument")
    files = props.filter(T.is_file(F.col("type")) & (F.col("prop") != "")).select(F.lit("file").alias("kind"), F.col("prop").alias("item"))
    return procs.select(kind.alias("kind"), "item").unionByName(files).distinct()


def profiles(nodes: DataFrame, edges: DataFrame, by: list[str] = GRAPH) -> tuple[DataFrame, DataFrame]:
    """(source property, operation) and (node type, property) pairs seen in the given graphs."""
    source = nodes.select(*by, F.col("name").alias("src"), "prop")
    ops = edges.join(source, [*by, "src"]).select("prop", F.col("actions_str").alias("operation")).distinct()
    return ops, nodes.select(F.lower("type").alias("type"), "prop").distinct()


def _known_parts(nodes: DataFrame, corpus: DataFrame) -> DataFrame:
    """Per distinct process property: is the command known, are all arguments known."""
    words = command_words(F.col("prop"))
    props = nodes.select("type", "prop").distinct().withColumn("_w", words)
    rows = props.select("type", "prop", F.posexplode("_w").alias("_i", "item"))
    rows = rows.withColumn("kind", F.when(F.col("_i") == 0, "command").otherwise("argument"))
    hits = rows.join(corpus.withColumn("_hit", F.lit(1)), ["kind", "item"], "left")
    known = hits.groupBy("type", "prop").agg(
        F.max(F.when(F.col("_i") == 0, F.coalesce("_hit", F.lit(0)))).alias("command_known"),
        F.min(F.when(F.col("_i") > 0, F.coalesce("_hit", F.lit(0)))).alias("arguments_known"),
    )
    joined = props.join(known, ["type", "prop"], "left")
    return joined.withColumns(
        {"command_known": F.coalesce("command_known", F.lit(0)), "arguments_known": F.coalesce("arguments_known", F.lit(0))}
    )


def strategy_tags(nodes: DataFrame, corpus: DataFrame) -> DataFrame:
    """``strategy`` per node: processes by what the benign corpus knows of them, others replacement."""
    known = _known_parts(nodes.filter(T.is_process(F.col("type"))), corpus)
    tag = (
        F.when(F.size("_w") == 0, "extension")
        .when((F.col("command_known") == 1) & (F.col("arguments_known") == 1), "rewriting")
        .when(F.col("command_known") == 1, "replacement")
        .otherwise("extension")
    )
    tags = known.select("type", "prop", tag.alias("_tag"))
    joined = nodes.join(tags, ["type", "prop"], "left")
    return joined.withColumn("strategy", F.coalesce("_tag", F.lit("replacement"))).drop("_tag")


def novel_parts(nodes: DataFrame, corpus: DataFrame) -> DataFrame:
    """Per distinct process property: the parts unknown to the benign corpus and the known ones."""
    known = _known_parts(nodes.filter(T.is_process(F.col("type"))), corpus)
    words = F.col("_w")
    command = F.coalesce(F.get(words, F.lit(0)), F.lit(""))
    args = F.array_join(F.slice(words, F.lit(2), F.greatest(F.size(words) - 1, F.lit(0))), " ")
    cmd_in, args_in = F.col("command_known") == 1, F.col("arguments_known") == 1
    whole = F.when(args != "", F.concat_ws(" ", command, args)).otherwise(command)
    novel = F.when(~cmd_in, whole).when(~args_in & (args != ""), args).otherwise("")
    usual = F.concat_ws(" ", F.when(cmd_in & (command != ""), command), F.when(args_in & (args != ""), args))
    return known.select("type", "prop", novel.alias("novel"), usual.alias("known"))


# fixed values: substitutes used when a graph has no benign file, ports and address range of substituted flows
_FILE_DEFAULTS = ("/tmp/data.log", "/var/log/syslog", "/etc/hosts")
_SOURCE_PORTS = (1024, 2048, 4096, 8080)
_TARGET_PORTS = (80, 443, 8080, 22, 53, 8443)
_OCTETS = (10, 200)


def _choice(values, key: Column) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in values]), (key % len(values) + 1).cast("int"))


def substitute_attributes(nodes: DataFrame, seed: int, by: list[str] = GRAPH) -> DataFrame:
    """File and network nodes labelled 1 get a property drawn from the benign files of their graph, or a drawn flow.

    Process command lines are left as they are.
    """
    files = nodes.filter(T.is_file(F.col("type")) & (F.col("label") != 1) & (F.col("prop") != ""))
    pool = numbered_pool(files.select(*by, F.col("prop").alias("_file")).distinct(), ["_file"], seed, by)
    sizes = pool.groupBy(*by).agg(F.max("pool_n").alias("_size"))
    key = [F.col(c) for c in (*by, "name")]
    picked = nodes.join(sizes, by, "left").withColumn("pool_idx", hash60(*key, seed) % F.col("_size"))
    joined = picked.join(pool.select(*by, "pool_idx", "_file"), [*by, "pool_idx"], "left")
    low, high = _OCTETS
    octet = lambda i: (hash60(*key, seed, i) % (high - low + 1) + low).cast("string")
    address = lambda start: F.concat_ws(".", *[octet(start + i) for i in range(4)])
    flow = F.concat_ws(
        ",", address(1), _choice(_SOURCE_PORTS, hash60(*key, seed, 20)).cast("string"), address(10),
        _choice(_TARGET_PORTS, hash60(*key, seed, 21)).cast("string"),
    )
    file = F.coalesce("_file", _choice(_FILE_DEFAULTS, hash60(*key, seed)))
    target = F.col("label") == 1
    new = F.when(target & T.is_file(F.col("type")), file).when(target & T.is_network(F.col("type")), flow).otherwise(F.col("prop"))
    return joined.withColumn("prop", new).drop("_size", "pool_idx", "_file")


# ---- verification and reports ---------------------------------------------------------------------------
def noticeable(nodes: DataFrame, edges: DataFrame, by: list[str]) -> DataFrame:
    """Graphs with a noticeable operation on an edge that touches a replaced node."""
    src = nodes.select(*by, F.col("name").alias("src"), F.lower("type").alias("_t"), F.col("replaced").alias("_rs"))
    dst = nodes.select(*by, F.col("name").alias("dst"), F.col("replaced").alias("_rd"))
    joined = edges.join(src, [*by, "src"]).join(dst, [*by, "dst"]).filter("_rs = 1 OR _rd = 1")
    bad = any_of([F.col("_t").contains(t) & F.lower("actions_str").contains(op) for t, op in V.NOTICEABLE_OPERATIONS])
    return joined.filter(bad).select(*by).distinct()


def verified(candidates: DataFrame, bad: DataFrame, sims: DataFrame, by: list[str], low: float = 0.3, high: float = 0.95):
    """``passed`` and the failed checks: nothing noticeable, and a similarity to the anchor in [low, high]."""
    joined = candidates.join(bad.withColumn("_bad", F.lit(1)), by, "left").join(sims, by, "left")
    seen = F.col("_bad").isNotNull()
    easy = ~F.coalesce(F.col("sim").between(low, high), F.lit(False))
    failed = F.concat_ws(",", F.when(seen, "imperceptibility"), F.when(easy, "hardness"))
    return joined.withColumn("failed", failed).withColumn("passed", (failed == "").cast("int")).drop("_bad")


def quality_report(nodes: DataFrame, originals: DataFrame, by: list[str]) -> DataFrame:
    """Shares of attack process nodes that are unchanged, well-formed, leak keys, keep keywords or patterns."""
    procs = nodes.filter(T.is_process(F.col("type")) & (F.col("label") == 1))
    known = originals.select("prop").distinct().withColumn("_same", F.lit(1))
    joined = procs.join(known, "prop", "left")
    has = lambda words: any_of([F.col("prop").contains(w) for w in words])
    return joined.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.count("_same").alias("unchanged"),
        F.count_if(well_formed(F.col("prop"))).alias("format_ok"),
        F.count_if(has(V.LEAKED_KEYS)).alias("leaks"),
        F.count_if(has(V.ATTACK_KEYWORDS)).alias("keyword_kept"),
        F.count_if(has(V.ATTACK_PATTERNS)).alias("pattern_kept"),
    )


def well_formed(prop: Column) -> Column:
    """At least three fields and a numeric field after the first."""
    parts = F.split(prop, ",")
    rest = F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0)))
    return (F.size(parts) >= 3) & F.exists(rest, lambda p: F.trim(p).rlike(r"^\d+$"))


def robustness_set(synthetic: DataFrame, benign: DataFrame, key: list[str], seed: int, ratio: int = 10, most: int = 3000):
    """Every synthetic attack ego as 1, benign egos sampled to min(ratio * attacks, ``most``) as 0."""
    n = synthetic.agg(F.count(F.lit(1))).scalar()
    order = [hash60(*[F.col(k) for k in key], seed), *[F.col(k) for k in key]]
    placed = ordered_positions(benign.select(*key), [], order, "_pos").withColumn("_n", n)
    kept = placed.filter(F.col("_pos") <= F.least(F.col("_n") * ratio, F.lit(most)))
    return synthetic.select(*key, F.lit(1).alias("label")).unionByName(kept.select(*key, F.lit(0).alias("label")))


# fixed values: parameters of the training-set strategies
PRESETS = {
    "none": (0.0, 0.0, False, False, False),
    "uniform": (0.2, 0.2, False, False, False),
    "degree_aware": (0.2, 0.2, True, False, False),
    "benign_injection": (0.2, 0.2, False, True, False),
    "structural": (0.2, 0.2, True, False, True),
}


def presets(spark: SparkSession) -> DataFrame:
    """One row per strategy with its parameters."""
    schema = "strategy string, drop_p double, mask_p double, by_degree boolean, inject boolean, mutate boolean"
    return spark.createDataFrame([(k, *p) for k, p in PRESETS.items()], schema)


def apply_preset(strategy: str, vectors: DataFrame, edges: DataFrame, benign: DataFrame, seed: int, by: list[str] = GRAPH):
    """(vectors, edges) after the drops, masks and injections of one strategy."""
    drop_p, mask_p, by_degree, inject, _ = PRESETS[strategy]
    kept = edges
    if drop_p > 0:
        kept = (drop_edges_by_degree if by_degree else drop_edges)(edges, drop_p, seed, by)
    if mask_p > 0 and by_degree:
        vectors = mask_features_by_degree(vectors, kept, mask_p, seed, by)
    elif mask_p > 0:
        vectors = mask_features(vectors, "vec", [*by, "name"], mask_p, seed).select(*by, "name", "vec")
    if inject:
        extra = inject_edges(vectors, kept, 0.2, seed, by).select(*by, "src", "dst", F.lit("injected").alias("actions_str"))
        kept = kept.select(*by, "src", "dst", "actions_str").unionByName(extra)
        vectors = inject_features(vectors, benign, 0.3, seed, by).select(*by, "name", "vec")
    return vectors, kept

