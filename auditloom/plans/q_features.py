"""Token features, word vectors and snapshot vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from auditloom.functions import text as T
from auditloom.functions.hashing import hash60
from auditloom.operators import features, graph
from auditloom.plans import q_graph as g
from auditloom.plans import views as v
from auditloom.plans.registry import query

TOK = r"regexp_extract_all(prop, '[A-Za-z0-9_\-./:\\]+')"


@query(
    "sf4_neighbour_tokens",
    v.with_ctes(
        v.GRAPH,
        g.ADJ,
        f"""tk AS (SELECT snapshot_id, name, unnest({TOK}) AS t, unnest(range(len({TOK}))) AS i FROM nodes),
            al AS (SELECT snapshot_id, name, '' AS nbr, i, t FROM tk
              UNION ALL SELECT a.snapshot_id, a.node, a.nbr, k.i, k.t FROM adj a JOIN tk k ON k.snapshot_id = a.snapshot_id AND k.name = a.nbr),
            rk AS (SELECT *, row_number() OVER (PARTITION BY snapshot_id, name ORDER BY nbr, i) AS p FROM al)""",
        "SELECT snapshot_id, name, md5(string_agg(t, ' ' ORDER BY p)) AS digest, count(*) AS n FROM rk WHERE p <= 10 GROUP BY 1, 2",
    ),
)
def sf4_neighbour_tokens(spark, sf):
    out = features.neighbour_tokens(v.nodes(spark, sf), v.edges(spark, sf), cap=10)
    return out.select("snapshot_id", "name", F.md5(F.array_join("tokens", " ")).alias("digest"), F.size("tokens").cast("bigint").alias("n"))


@query(
    "fe1_word_corpus",
    v.with_ctes(v.GRAPH, f"SELECT prop, len({TOK}) AS n FROM (SELECT DISTINCT prop FROM node_props) WHERE len({TOK}) > 0"),
)
def fe1_word_corpus(spark, sf):
    corpus = features.word_corpus(v.nodes(spark, sf))
    return corpus.select("prop", F.size("tokens").alias("n"))


@query("fe2_word_vectors")
def fe2_word_vectors(spark, sf):
    model = features.train_words(features.word_corpus(v.nodes(spark, sf)), dim=16)
    words = features.word_table(model)
    return words.select(F.length("token").alias("n_chars"), F.size("vec").alias("dim")).groupBy("n_chars", "dim").count()


@query("fe4_phrase_vectors")
def fe4_phrase_vectors(spark, sf):
    triples = features.text_triples(v.nodes(spark, sf), v.edges(spark, sf))
    sentences = triples.select("head", "relation", "tail").distinct()
    text = F.concat_ws(" ", "head", "relation", "tail")
    model = features.train_words(sentences.select(T.property_tokens(text).alias("tokens")), dim=16)
    out = features.phrase_vectors(sentences, features.word_table(model), 16)
    return out.select("text", F.size("vec").alias("dim"))


def words(spark, sf):
    """A vector per token of the properties."""
    tokens = v.nodes(spark, sf).select(F.explode(T.property_tokens(F.col("prop"))).alias("token")).distinct()
    bucket = hash60(F.col("token")) % 400
    e = v.vectors(spark, sf).select(F.col("vec_id").alias("_b"), "vec")
    return tokens.withColumn("_b", bucket).join(e, "_b").select("token", "vec")


WORDS = f"""wt AS (SELECT DISTINCT unnest({TOK}) AS token FROM nodes),
wv AS (SELECT token, unnest(range(64)) AS i, unnest(embedding)::DOUBLE AS x FROM (
  SELECT token, ('0x' || substring(md5(token), 1, 15))::BIGINT % 400 AS b FROM wt) t JOIN embeddings e ON e.vec_id = t.b)"""

DIGEST = """round(coalesce(sum(x), 0), 6) AS s, round(coalesce(sum(x * x), 0), 6) AS q, round(coalesce(sum(x * i), 0), 5) AS w, 64::BIGINT AS n"""


@query(
    "fe3_token_mean",
    v.with_ctes(
        v.GRAPH,
        WORDS,
        f"""pt AS (SELECT prop, unnest({TOK}) AS token FROM (SELECT DISTINCT prop FROM nodes)),
            m AS (SELECT prop, i, avg(x) AS x FROM pt JOIN wv USING (token) GROUP BY 1, 2),
            u AS (SELECT prop, i, x / (sqrt(sum(x * x) OVER (PARTITION BY prop)) + 1e-12) AS x FROM m)""",
        f"SELECT p.prop, {DIGEST} FROM (SELECT DISTINCT prop FROM nodes) p LEFT JOIN u USING (prop) GROUP BY 1",
    ),
)
def fe3_token_mean(spark, sf):
    props = v.nodes(spark, sf).select("prop").distinct().withColumn("tokens", T.property_tokens(F.col("prop")))
    out = features.token_mean(props, ["prop"], "tokens", words(spark, sf), v.DIM)
    return g.vec_digest(out, ["prop"])


BLEND = """bl AS (SELECT snapshot_id, name, frequency::DOUBLE AS f, properties FROM nodes),
pw AS (SELECT snapshot_id, properties, sum(f) AS pw FROM bl GROUP BY 1, 2),
px AS (SELECT *, 1 - pw / max(pw) OVER (PARTITION BY snapshot_id) AS a FROM pw),
wt2 AS (SELECT b.snapshot_id, b.name, greatest(0.7 * f / (avg(f) OVER (PARTITION BY b.snapshot_id) + 1e-12)
  + 0.3 * a / (avg(a) OVER (PARTITION BY b.snapshot_id) + 1e-12), 0) AS w FROM bl b JOIN px p ON p.snapshot_id = b.snapshot_id
  AND p.properties = b.properties)"""


@query(
    "fe6_blended_snapshot",
    v.with_ctes(
        v.GRAPH,
        g.NV,
        BLEND,
        """t AS (SELECT snapshot_id, sum(w) AS tw FROM wt2 GROUP BY 1),
           r AS (SELECT w.snapshot_id, nv.i, sum(w.w * nv.x) / (max(t.tw) + 1e-12) AS x FROM wt2 w JOIN t USING (snapshot_id)
             JOIN nv ON nv.snapshot_id = w.snapshot_id AND nv.name = w.name GROUP BY 1, 2)""",
        f"SELECT snapshot_id, {DIGEST} FROM r GROUP BY 1",
    ),
)
def fe6_blended_snapshot(spark, sf):
    keys, table = g.node_keys(spark, sf)
    out = features.blended_snapshot(v.nodes(spark, sf), keys, v.DIM, table=table)
    return g.vec_digest(out, ["snapshot_id"])


UNIT = """r AS (SELECT w.snapshot_id, nv.i, sum(w.w * nv.x) / sum(w.w) AS x FROM w JOIN nv ON nv.snapshot_id = w.snapshot_id
  AND nv.name = w.name GROUP BY 1, 2), u AS (SELECT snapshot_id, i, x / sqrt(sum(x * x) OVER (PARTITION BY snapshot_id)) AS x FROM r)"""


@query(
    "fe7_frequency_snapshot",
    v.with_ctes(
        v.GRAPH, g.NV, "w AS (SELECT snapshot_id, name, frequency AS w FROM nodes)", UNIT, f"SELECT snapshot_id, {DIGEST} FROM u GROUP BY 1"
    ),
)
def fe7_frequency_snapshot(spark, sf):
    keys, table = g.node_keys(spark, sf)
    out = features.frequency_snapshot(v.nodes(spark, sf), v.edges(spark, sf), keys, v.DIM, table)
    return g.vec_digest(out, ["snapshot_id"])


@query(
    "fe8_degree_snapshot",
    v.with_ctes(
        v.GRAPH, g.NV, g.DEG, "w AS (SELECT snapshot_id, node AS name, degree AS w FROM deg)", UNIT, f"SELECT snapshot_id, {DIGEST} FROM u GROUP BY 1"
    ),
)
def fe8_degree_snapshot(spark, sf):
    keys, table = g.node_keys(spark, sf)
    out = features.degree_snapshot(v.nodes(spark, sf), v.edges(spark, sf), keys, v.DIM, table)
    return g.vec_digest(out, ["snapshot_id"])


@query(
    "fe9_ego_vector",
    v.with_ctes(
        v.GRAPH,
        g.ADJ,
        g.NV,
        g.ego_sql(g.CAP),
        """m AS (SELECT e.snapshot_id, e.center, 64 + nv.i AS i, avg(nv.x) AS x FROM ego e JOIN nv ON nv.snapshot_id = e.snapshot_id
             AND nv.name = e.node GROUP BY 1, 2, 3),
           c AS (SELECT DISTINCT e.snapshot_id, e.center FROM m e JOIN nv ON nv.snapshot_id = e.snapshot_id AND nv.name = e.center),
           z AS (SELECT c.snapshot_id, c.center, m.i, m.x FROM c JOIN m USING (snapshot_id, center)
             UNION ALL SELECT c.snapshot_id, c.center, nv.i, nv.x FROM c JOIN nv ON nv.snapshot_id = c.snapshot_id AND nv.name = c.center)""",
        """SELECT snapshot_id, center, round(sum(x), 6) AS s, round(sum(x * x), 6) AS q, round(sum(x * i), 5) AS w, 128::BIGINT AS n
           FROM z GROUP BY 1, 2""",
    ),
)
def fe9_ego_vector(spark, sf):
    keys, table = g.node_keys(spark, sf)
    out = features.ego_vector(g.egos(spark, sf), keys, v.DIM, table=table)
    return g.vec_digest(out, ["snapshot_id", "center"])


@query(
    "fe11_ego_stats",
    v.with_ctes(
        v.GRAPH,
        g.ADJ,
        g.ego_sql(g.CAP),
        g.EGO_EDGES,
        """sz AS (SELECT snapshot_id, center, count(*) AS n_nodes FROM ego GROUP BY 1, 2),
           ct AS (SELECT snapshot_id, center, CASE regexp_extract(actions_str, 'EVENT_(READ|WRITE|OPEN|FORK|SENDTO)', 1) WHEN 'FORK' THEN 0
             WHEN 'SENDTO' THEN 2 ELSE 1 END AS cat FROM ego_e)""",
        """SELECT s.snapshot_id, s.center, s.n_nodes, count(c.cat) AS n_edges, count(*) FILTER (WHERE cat = 0) AS n_proc,
             count(*) FILTER (WHERE cat = 1) AS n_file, count(*) FILTER (WHERE cat = 2) AS n_net, count(*) FILTER (WHERE cat = 3) AS n_mem
           FROM sz s LEFT JOIN ct c ON c.snapshot_id = s.snapshot_id AND c.center = s.center GROUP BY 1, 2, 3""",
    ),
)
def fe11_ego_stats(spark, sf):
    egos = g.egos(spark, sf)
    return features.ego_stats(egos, graph.ego_edges(v.edges(spark, sf), egos))
