"""Behaviour texts, technique matching and alignment.

``documents`` are the queries, ``benchmark`` the technique library (some documents contain its passages).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from auditloom.functions import fixed_values as V
from auditloom.functions import text as T
from auditloom.operators import events as ev_ops
from auditloom.operators import interpret, snapshots
from auditloom.operators import similarity as sim
from auditloom.plans import views as v
from auditloom.plans.q_text import EXT_SQL, INTENT, NAME_SQL, VERB_SQL, intent_triples, sql_words
from auditloom.plans.registry import query
from auditloom.session import cut, stored

# ---- behaviour texts ------------------------------------------------------------------------------
BARE_GRAPH = v.GRAPH.replace("'proc' || (user_id % 7) AS exec", "'' AS exec").replace(
    "FROM ent WHERE props <> ''", "FROM ent WHERE props <> '' AND kind = 'net'"
)
LOW_SQL = " OR ".join(f"starts_with(phrase, '{p}')" for p in V.LOW_INFORMATION_VERBS)


@query(
    "in1_snapshot_text",
    v.with_ctes(
        BARE_GRAPH,
        """rk AS (SELECT snapshot_id, name, properties, row_number() OVER (PARTITION BY snapshot_id ORDER BY frequency DESC, name) AS rank
             FROM nodes WHERE label = 1 AND type = 'SUBJECT_PROCESS'),
           it AS (SELECT snapshot_id, rank, unnest(string_split(properties, '|')) AS item, unnest(range(len(string_split(properties, '|')))) AS i FROM rk),
           sp AS (SELECT snapshot_id, rank, i, split_part(item, ' ', 1) AS action, CASE WHEN contains(item, ' ')
             THEN substring(item, strpos(item, ' ') + 1) ELSE '' END AS path FROM it)""",
        f"""ph AS (SELECT snapshot_id, rank, i, CASE WHEN verb IS NULL THEN '' WHEN contains(verb, ' ') OR path = '' THEN verb ELSE verb || ' ' || path ||
              CASE WHEN {EXT_SQL} = '' THEN '' ELSE ' ' || {EXT_SQL} END END AS phrase FROM (SELECT *, {VERB_SQL} AS verb FROM sp)),
            st AS (SELECT snapshot_id, 'process ' || phrase AS sentence, min(rank * 100000 + i) AS o FROM ph
              WHERE phrase <> '' AND NOT ({LOW_SQL}) GROUP BY 1, 2)""",
        "SELECT snapshot_id, string_agg(sentence, '. ' ORDER BY o) AS text FROM st GROUP BY 1",
    ),
)
def in1_snapshot_text(spark, sf):
    """Events without command, so that a process lists its events as properties."""
    bare = v.hourly(spark, sf).withColumn("exec", F.lit(""))
    nodes = snapshots.node_table(bare, v.entities(spark, sf).filter("kind = 'net'"), v.labelled_entities(spark, sf))
    return interpret.snapshot_text(nodes)


SIDES = """sd AS (
  SELECT l.label_id AS entity, 0 AS role, e.ts_us, e.event_id, e.actor_type, coalesce(a.props, '') AS ap, e.action, e.object_type,
    coalesce(o.props, '') AS op FROM ev e JOIN lab l ON l.label_id = e.actor_id LEFT JOIN best_ent a ON a.name = e.actor_id
    LEFT JOIN best_ent o ON o.name = e.object_id
  UNION ALL SELECT l.label_id, 1, e.ts_us, e.event_id, e.actor_type, coalesce(a.props, ''), e.action, e.object_type, coalesce(o.props, '')
    FROM ev e JOIN lab l ON l.label_id = e.object_id LEFT JOIN best_ent a ON a.name = e.actor_id LEFT JOIN best_ent o ON o.name = e.object_id)"""


def ordered_text(sentence: str, out: str, extra: str = "") -> str:
    return f"""st AS (SELECT entity, sentence, min(role * 10000000000000000 + ts_us) AS o FROM (SELECT *, {sentence} AS sentence FROM sd) {extra}
  GROUP BY 1, 2),
rk AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY o, sentence) AS r FROM st)
SELECT entity, string_agg(sentence, '. ' ORDER BY r) AS {out} FROM rk WHERE r <= 30 GROUP BY 1"""


RAW_SQL = """trim(CASE role WHEN 0 THEN actor_type || ' ' || action || ' ' || object_type || ' ' || op
  ELSE actor_type || ' ' || ap || ' ' || action || ' ' || object_type || ' ' || op END)"""


#: The entities to interpret: those that the labels table names.
NAMED = "lab AS (SELECT DISTINCT 'u' || doc_id AS label_id FROM labels)"


def sides(spark, sf):
    wanted = v.table(spark, sf, "labels").select(F.concat(F.lit("u"), "doc_id").alias("entity")).distinct()
    best = ev_ops.preferred_entities(v.entities(spark, sf))
    return interpret.event_sides(v.audit_events(spark, sf), best, wanted)


@query("in2_raw_query", v.with_ctes(v.EV, v.ENT, NAMED, SIDES + ",\n" + ordered_text(RAW_SQL, "raw_query").rsplit("\nSELECT", 1)[0], "SELECT" + ordered_text(RAW_SQL, "raw_query").rsplit("\nSELECT", 1)[1]))
def in2_raw_query(spark, sf):
    return interpret.raw_queries(sides(spark, sf))


_NAME = NAME_SQL.replace("props", "ap")
SUBJ_SQL = f"""(CASE WHEN {_NAME} = '' THEN 'process' ELSE {v.case_sql(f'lower({_NAME})', V.PROCESS_ROLES, f"CASE WHEN lower({_NAME}) = {_NAME} THEN 'process' ELSE lower({_NAME}) END")} END)"""
_KIND = EXT_SQL.replace("path", "op")
OBJ_SQL = f"""(CASE WHEN contains(object_type, 'FILE') AND op <> '' THEN CASE WHEN contains(op, '/proc/') THEN 'process information'
  WHEN {_KIND} = '' THEN 'file' ELSE {_KIND} END ELSE {v.case_sql('object_type', V.TYPE_NOUNS, 'object_type')} END)"""
ENH_SQL = f"trim({SUBJ_SQL} || ' ' || {VERB_SQL} || CASE WHEN contains({VERB_SQL}, ' ') THEN '' ELSE ' ' || {OBJ_SQL} END)"
ENH = ordered_text(ENH_SQL, "query", f"WHERE NOT ({LOW_SQL.replace('phrase', VERB_SQL)})")


@query("in3_translated_query", v.with_ctes(v.EV, v.ENT, NAMED, SIDES + ",\n" + ENH.rsplit("\nSELECT", 1)[0], "SELECT" + ENH.rsplit("\nSELECT", 1)[1]))
def in3_translated_query(spark, sf):
    return interpret.translated_queries(sides(spark, sf))


@query(
    "in4_technique_text",
    f"WITH {INTENT} SELECT tech_id, string_agg(subject || ' ' || verb || ' ' || object, '. ' ORDER BY subject, verb, object) AS text FROM tri GROUP BY 1",
)
def in4_technique_text(spark, sf):
    """Triples written as JSON objects, read back and joined to a text."""
    from auditloom.session import scratch_path
    from auditloom.sources import techniques

    triple = F.struct("subject", "verb", "object")
    packed = intent_triples(spark, sf).groupBy("tech_id").agg(F.sort_array(F.collect_list(triple)).alias("t"))
    path = scratch_path(spark, "triples")
    packed.select(F.to_json(F.create_map("tech_id", "t")).alias("value")).write.text(path)
    back = techniques.read_triples(spark, path, whole=False)
    return back.select("tech_id", techniques.triples_text(F.col("triples")).alias("text"))


@query(
    "in5_operational_triples",
    f"""WITH {INTENT} SELECT DISTINCT tech_id, sys_subject || ' ' || op || ' ' || sys_object AS sentence FROM (
          SELECT tech_id, sys_subject, sys_object, unnest(string_split(ops, ',')) AS op FROM mapped WHERE ops IS NOT NULL)""",
)
def in5_operational_triples(spark, sf):
    return interpret.operational_triples(intent_triples(spark, sf))


# ---- matching -------------------------------------------------------------------------------------
GAMMA = 0.30


def tfidf_sql(name: str, source: str, key: str, body: str, lib: str) -> str:
    """CTEs <name> (id, t, w): unit tf-idf vectors against the document frequencies of <lib>_df."""
    return f"""{name}_tf AS (SELECT {key} AS id, t, count(*) AS tf FROM (SELECT {key}, unnest({sql_words(body)}) AS t FROM {source}) GROUP BY 1, 2),
{name}_w AS (SELECT id, f.t, tf * (ln((n + 1.0) / (coalesce(df, 0) + 1.0)) + 1) AS w FROM {name}_tf f LEFT JOIN {lib}_df d ON d.t = f.t, {lib}_n),
{name} AS (SELECT id, t, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS w FROM {name}_w)"""


def df_sql(lib: str, source: str, key: str, body: str) -> str:
    return f"""{lib}_df AS (SELECT t, count(*) AS df FROM (SELECT DISTINCT {key}, unnest({sql_words(body)}) AS t FROM {source}) GROUP BY 1),
{lib}_n AS (SELECT count(*) AS n FROM {source})"""


MATCH = ",\n".join(
    [
        df_sql("lib", "benchmark", "item_id", "text"),
        tfidf_sql("lv", "benchmark", "item_id", "text", "lib"),
        tfidf_sql("qv", "documents", "doc_id", "text", "lib"),
        "sc AS (SELECT q.id AS a, l.id AS b, sum(q.w * l.w) AS sim FROM qv q JOIN lv l ON q.t = l.t GROUP BY 1, 2)",
        """al AS (SELECT a, b, coalesce(sim, 0) AS sim FROM (SELECT DISTINCT id AS a FROM qv) CROSS JOIN (SELECT DISTINCT id AS b FROM lv) LEFT JOIN sc USING (a, b))""",
        "tk AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY round(sim, 9) DESC, b)::INT AS rank FROM al) WHERE rank <= 10)",
    ]
)


def library(spark, sf):
    return v.table(spark, sf, "benchmark").select(F.col("item_id").alias("id"), T.word_tokens(F.col("text")).alias("tokens"))


def query_texts(spark, sf):
    docs = v.table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text").repartition("id")
    return docs.select("id", T.word_tokens(F.col("text")).alias("tokens"))


def match_vectors(spark, sf):
    lib = library(spark, sf)
    return sim.tfidf(query_texts(spark, sf), lib), sim.tfidf(lib, lib)


def top_matches(spark, sf, k=10):
    q, lib = match_vectors(spark, sf)
    return sim.top_similar(q, lib, k)


@query("in6_text_vectors", f"WITH {MATCH} SELECT id, t AS feature, round(w, 6) AS weight FROM lv")
def in6_text_vectors(spark, sf):
    lib = library(spark, sf)
    out = sim.normalised(sim.tfidf(lib, lib))
    return out.withColumn("weight", F.round("weight", 6))


@query("jn7_technique_join", f"WITH {MATCH} SELECT a, b, round(sim, 6) AS sim, rank FROM tk")
def jn7_technique_join(spark, sf):
    return top_matches(spark, sf).withColumn("sim", F.round("sim", 6))


AUX = ",\n".join(
    [
        df_sql("aux", "conversations", "conv_id || '/' || turn", "text"),
        """aux_src AS (SELECT conv_id, text FROM conversations)""",
        tfidf_sql("xv", "aux_src", "conv_id", "text", "aux"),
        tfidf_sql("xq", "documents", "doc_id", "text", "aux"),
        "sx AS (SELECT q.id AS a, l.id AS b, sum(q.w * l.w) AS sim FROM xq q JOIN xv l ON q.t = l.t GROUP BY 1, 2)",
    ]
)


def aux_library(spark, sf):
    """Second library: all turns of the conversation with the technique's number."""
    conv = v.table(spark, sf, "conversations")
    tokens = T.word_tokens(F.col("text"))
    turns = conv.select(F.concat_ws("/", "conv_id", "turn").alias("id"), tokens.alias("tokens"))
    whole = conv.select(F.col("conv_id").alias("id"), tokens.alias("tokens"))
    return turns, whole


@query(
    "in7_hybrid_score",
    f"""WITH {MATCH}, {AUX}, ids AS (SELECT id AS b FROM lv UNION SELECT id FROM xv),
        mx AS (SELECT q.id AS a, ids.b, 0.7 * coalesce(s.sim, 0) + 0.3 * coalesce(x.sim, 0) AS sim FROM (SELECT id FROM qv UNION SELECT id FROM xq) q
          CROSS JOIN ids LEFT JOIN sc s ON s.a = q.id AND s.b = ids.b LEFT JOIN sx x ON x.a = q.id AND x.b = ids.b)
        SELECT a, b, round(sim, 6) AS sim, rank FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY round(sim, 9) DESC, b)::INT AS rank FROM mx) WHERE rank <= 10""",
)
def in7_hybrid_score(spark, sf):
    q, lib = match_vectors(spark, sf)
    turns, whole = aux_library(spark, sf)
    out = interpret.hybrid(q, lib, sim.tfidf(whole, turns), sim.tfidf(query_texts(spark, sf), turns), 0.3, 10)
    return out.withColumn("sim", F.round("sim", 6))


@query(
    "in8_best_code",
    f"""WITH {MATCH} SELECT d.doc_id AS id, coalesce(CASE WHEN t.sim >= {GAMMA} THEN 'T' || t.b END, 'UNKNOWN') AS code,
          round(coalesce(CASE WHEN t.sim >= {GAMMA} THEN t.sim END, 0), 6) AS score FROM documents d LEFT JOIN tk t ON t.a = d.doc_id AND t.rank = 1""",
)
def in8_best_code(spark, sf):
    return best_codes(spark, sf).withColumn("score", F.round("score", 6))


def best_codes(spark, sf):
    top = top_matches(spark, sf, 1).select("a", F.concat(F.lit("T"), "b").alias("b"), "sim")
    return interpret.best_codes(query_texts(spark, sf), top, GAMMA)


@query("in9_topk_techniques", f"WITH {MATCH} SELECT a, b, round(sim, 6) AS sim, rank, text FROM tk JOIN benchmark ON item_id = b")
def in9_topk_techniques(spark, sf):
    texts = v.table(spark, sf, "benchmark").select(F.col("item_id").alias("b"), "text")
    return top_matches(spark, sf).join(texts, "b").withColumn("sim", F.round("sim", 6))


@query(
    "wf8_score_gap",
    f"""WITH {MATCH} SELECT a, round(max(CASE WHEN rank = 1 THEN sim END), 6) AS first, round(max(CASE WHEN rank = 2 THEN sim END), 6) AS second,
          round(max(CASE WHEN rank = 1 THEN sim END) - coalesce(max(CASE WHEN rank = 2 THEN sim END), 0), 6) AS gap FROM tk WHERE rank <= 2 GROUP BY 1""",
)
def wf8_score_gap(spark, sf):
    out = interpret.score_gap(top_matches(spark, sf))
    return out.withColumns({c: F.round(c, 6) for c in ("first", "second", "gap")})


HIT = f"""gt AS (SELECT doc_id AS id, 'T' || (doc_id % 40) AS gt FROM documents),
hit AS (SELECT g.id, g.gt, CASE WHEN coalesce(c.sim, 0) < {GAMMA} THEN 'unmapped' WHEN min(CASE WHEN 'T' || t.b = g.gt THEN t.rank END) IS NOT NULL
    THEN 'correct' ELSE 'incorrect' END AS status, CASE WHEN coalesce(c.sim, 0) < {GAMMA} THEN -1 ELSE
    coalesce(min(CASE WHEN 'T' || t.b = g.gt THEN t.rank END), -1) END AS match_rank
  FROM gt g LEFT JOIN tk t ON t.a = g.id LEFT JOIN tk c ON c.a = g.id AND c.rank = 1 GROUP BY g.id, g.gt, c.sim)"""


def hits(spark, sf):
    truth = v.table(spark, sf, "documents").select(
        F.col("doc_id").alias("id"), F.concat(F.lit("T"), F.col("doc_id") % 40, F.lit(".001")).alias("technique")
    )
    top = cut(top_matches(spark, sf).select("a", F.concat(F.lit("T"), "b").alias("b"), "sim", "rank"))
    confidence = top.filter("rank = 1").select(F.col("a").alias("id"), F.col("sim").alias("confidence"))
    return interpret.hit_at_k(truth, top, confidence, 10, GAMMA)


@query("in10_hit_at_k", f"WITH {MATCH}, {HIT} SELECT id, gt, status, match_rank::INT AS match_rank FROM hit")
def in10_hit_at_k(spark, sf):
    return hits(spark, sf)


@query("wf7_first_match_rank", f"WITH {MATCH}, {HIT} SELECT match_rank::INT AS match_rank, count(*) AS n FROM hit WHERE match_rank > 0 GROUP BY 1")
def wf7_first_match_rank(spark, sf):
    found = hits(spark, sf).filter("match_rank > 0")
    return found.groupBy("match_rank").agg(F.count(F.lit(1)).alias("n"))


@query(
    "in11_expected_rank",
    f"""WITH {MATCH} SELECT s.a, s.b, 1 + (SELECT count(*) FROM al o WHERE o.a = s.a AND round(o.sim, 9) > round(s.sim, 9)) AS rank
        FROM al s WHERE s.b = s.a % 40""",
)
def in11_expected_rank(spark, sf):
    q, lib = match_vectors(spark, sf)
    known = lib.select(F.col("id").alias("b")).distinct()
    expected = v.table(spark, sf, "documents").select(F.col("doc_id").alias("a"), (F.col("doc_id") % 40).alias("b"))
    return sim.ranks_of(q, lib, expected.join(known, "b", "left_semi"))


@query(
    "in14_drop_uncertain",
    f"""WITH {MATCH} SELECT a AS id, 'T' || b AS code FROM tk WHERE rank = 1 AND sim >= 0.35""",
)
def in14_drop_uncertain(spark, sf):
    return interpret.drop_uncertain(best_codes(spark, sf), 0.35).select("id", "code")


def methods(spark, sf):
    """Four methods: raw or shortened query against the plain or the mixed library."""
    docs = query_texts(spark, sf)
    lib = library(spark, sf)
    short = docs.withColumn("tokens", F.array_distinct("tokens"))
    truth = docs.select("id", F.concat(F.lit("T"), F.col("id") % 40).alias("technique"))
    lib_vec = sim.tfidf(lib, lib)
    flat = lib.withColumn("tokens", F.array_distinct("tokens"))
    flat_vec = sim.tfidf(flat, lib)
    named = lambda t: cut(t.select("a", F.concat(F.lit("T"), "b").alias("b"), "sim", "rank"))
    runs = {
        "direct": (docs, lib_vec), "library": (docs, flat_vec), "query": (short, lib_vec), "both": (short, flat_vec),
    }
    tops = {name: named(sim.top_similar(sim.tfidf(q, lib), vec, 10)) for name, (q, vec) in runs.items()}
    sure = tops["query"].filter("rank = 1").select(F.col("a").alias("id"), F.col("sim").alias("confidence"))
    out = None
    for name, top in tops.items():
        rows = interpret.hit_at_k(truth, top, sure, 10, GAMMA).withColumn("method", F.lit(name))
        out = rows if out is None else out.unionByName(rows)
    return out


def _method_sql() -> str:
    uniq = lambda src, key: f"(SELECT {key}, array_to_string(list_distinct({sql_words('text')}), ' ') AS text FROM {src})"
    parts = [
        df_sql("lib", "benchmark", "item_id", "text"),
        tfidf_sql("l1", "benchmark", "item_id", "text", "lib"),
        tfidf_sql("l2", uniq("benchmark", "item_id"), "item_id", "text", "lib"),
        tfidf_sql("q1", "documents", "doc_id", "text", "lib"),
        tfidf_sql("q2", uniq("documents", "doc_id"), "doc_id", "text", "lib"),
    ]
    for name, q, lib in (("direct", "q1", "l1"), ("library", "q1", "l2"), ("query", "q2", "l1"), ("both", "q2", "l2")):
        parts.append(
            f"""t_{name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY round(sim, 9) DESC, b) AS rank FROM (
              SELECT a, b, coalesce(sim, 0) AS sim FROM (SELECT DISTINCT id AS a FROM {q}) CROSS JOIN (SELECT DISTINCT id AS b FROM {lib})
              LEFT JOIN (SELECT q.id AS a, l.id AS b, sum(q.w * l.w) AS sim FROM {q} q JOIN {lib} l ON q.t = l.t GROUP BY 1, 2) USING (a, b))) WHERE rank <= 10)"""
        )
    tops = " UNION ALL ".join(f"SELECT '{m}' AS method, a, b, rank FROM t_{m}" for m in ("direct", "library", "query", "both"))
    parts.append(f"tops AS ({tops})")
    parts.append("ms AS (SELECT unnest(['direct', 'library', 'query', 'both']) AS method)")
    parts.append(
        f"""det AS (SELECT d.doc_id, m.method, CASE WHEN coalesce(max(c.sim), 0) < {GAMMA} OR count(t.b) = 0 THEN 'unmapped'
          WHEN max(CASE WHEN t.b = d.doc_id % 40 THEN 1 ELSE 0 END) = 1 THEN 'correct' ELSE 'incorrect' END AS status
          FROM ms m, documents d LEFT JOIN tops t ON t.a = d.doc_id AND t.method = m.method LEFT JOIN t_query c ON c.a = d.doc_id AND c.rank = 1
          GROUP BY 1, 2)"""
    )
    return "WITH " + ",\n".join(parts) + "\nSELECT method, status, count(*) AS n FROM det GROUP BY 1, 2"


@query("in18_method_comparison", _method_sql())
def in18_method_comparison(spark, sf):
    return methods(spark, sf).groupBy("method", "status").agg(F.count(F.lit(1)).alias("n"))


# ---- from events to techniques ---------------------------------------------------------------------
def _entity_sql(name: str, sentence: str, extra: str = "") -> str:
    """CTE <name> (entity, text): the first 30 distinct sentences of every entity."""
    return f"""{name}_st AS (SELECT entity, sentence, min(role * 10000000000000000 + ts_us) AS o FROM (SELECT *, {sentence} AS sentence FROM sd) {extra} GROUP BY 1, 2),
{name}_rk AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY o, sentence) AS r FROM {name}_st),
{name} AS (SELECT entity, string_agg(sentence, '. ' ORDER BY r) AS text FROM {name}_rk WHERE r <= 30 GROUP BY 1)"""


def _method_scores(name: str, queries: str, library: str) -> str:
    return f"""{name}_sc AS (SELECT q.id AS a, l.id AS b, sum(q.w * l.w) AS sim FROM {queries} q JOIN {library} l ON q.t = l.t GROUP BY 1, 2),
{name}_al AS (SELECT a, b, coalesce(sim, 0) AS sim FROM (SELECT DISTINCT id AS a FROM {queries}) CROSS JOIN (SELECT DISTINCT id AS b FROM {library})
  LEFT JOIN {name}_sc USING (a, b))"""


ENTITY_METHODS = ("direct", "technique", "log", "full", "hybrid")
_TOP10 = "(SELECT a, b, sim, row_number() OVER (PARTITION BY a ORDER BY round(sim, 9) DESC, b) AS rank FROM {}_al QUALIFY rank <= 10)"


def _chain_sql() -> str:
    parts = [
        v.EV, v.ENT, NAMED, SIDES, INTENT,
        _entity_sql("raw_q", RAW_SQL),
        _entity_sql("tr_q", ENH_SQL, f"WHERE NOT ({LOW_SQL.replace('phrase', VERB_SQL)})"),
        "raw_t AS (SELECT tech_id, string_agg(subject || ' ' || verb || ' ' || object, '. ') AS text FROM tri GROUP BY 1)",
        """ops_t AS (SELECT tech_id, string_agg(sentence, '. ') AS text FROM (SELECT DISTINCT tech_id, sys_subject || ' ' || op || ' ' || sys_object AS sentence
          FROM (SELECT *, unnest(string_split(ops, ',')) AS op FROM mapped WHERE ops IS NOT NULL)) GROUP BY 1)""",
    ]
    for lib in ("raw", "ops"):
        parts += [df_sql(f"{lib}_l", f"{lib}_t", "tech_id", "text"), tfidf_sql(f"{lib}_v", f"{lib}_t", "tech_id", "text", f"{lib}_l")]
        parts += [tfidf_sql(f"{q}_{lib}", f"{q}_q", "entity", "text", f"{lib}_l") for q in ("raw", "tr")]
    parts += [
        _method_scores("direct", "raw_raw", "raw_v"), _method_scores("technique", "raw_ops", "ops_v"),
        _method_scores("log", "tr_raw", "raw_v"), _method_scores("full", "tr_ops", "ops_v"),
        """hybrid_al AS (SELECT a, b, 0.7 * coalesce(m.sim, 0) + 0.3 * coalesce(x.sim, 0) AS sim FROM (SELECT a FROM full_al UNION SELECT a FROM direct_al)
          CROSS JOIN (SELECT b FROM full_al UNION SELECT b FROM direct_al) LEFT JOIN full_sc m USING (a, b) LEFT JOIN direct_sc x USING (a, b))""",
        "tops AS (" + " UNION ALL ".join(f"SELECT '{m}' AS method, a, b, sim, rank FROM {_TOP10.format(m)}" for m in ENTITY_METHODS) + ")",
        "conf AS (SELECT a, max(sim) AS sim FROM log_al GROUP BY 1)",
        f"ms AS (SELECT unnest({list(ENTITY_METHODS)}) AS method)",
        f"""det AS (SELECT e.label_id, m.method, CASE WHEN coalesce(max(c.sim), 0) < {GAMMA} OR count(t.b) = 0 THEN 'unmapped'
          WHEN max(CASE WHEN t.b = 'T' || (1000 + substring(e.label_id, 2)::BIGINT % 40) THEN 1 ELSE 0 END) = 1 THEN 'correct' ELSE 'incorrect' END AS status,
            max(CASE WHEN t.rank = 1 THEN t.b END) AS best, round(max(CASE WHEN t.rank = 1 THEN t.sim END), 6) AS score
          FROM ms m CROSS JOIN lab e LEFT JOIN tops t ON t.a = e.label_id AND t.method = m.method LEFT JOIN conf c ON c.a = e.label_id GROUP BY 1, 2)""",
    ]
    return "WITH " + ",\n".join(p.removeprefix("WITH ") for p in parts) + "\nSELECT label_id AS id, method, status, best, score FROM det"


@query("in18_entity_methods", _chain_sql())
def in18_entity_methods(spark, sf):
    """Events to entity texts to vectors to techniques: raw and translated texts against raw and translated techniques.

    The confidence is always that of the translated text against the raw techniques.
    """
    said = cut(sides(spark, sf))
    words = lambda df, key, text: df.select(F.col(key).alias("id"), T.word_tokens(F.col(text)).alias("tokens"))
    texts = {"raw": words(interpret.raw_queries(said), "entity", "raw_query"), "translated": words(interpret.translated_queries(said), "entity", "query")}
    triples = intent_triples(spark, sf)
    plain = triples.select("tech_id", F.concat_ws(" ", "subject", "verb", "object").alias("sentence"))
    joined = lambda df: df.groupBy("tech_id").agg(F.concat_ws(". ", F.collect_list("sentence")).alias("text"))
    library = {k: cut(words(joined(t), "tech_id", "text")) for k, t in (("raw", plain), ("translated", interpret.operational_triples(triples)))}
    lib = {k: cut(sim.tfidf(t, t)) for k, t in library.items()}
    terms = {q: stored(sim.term_counts(t), "terms") for q, t in texts.items()}
    vectors = {(q, k): sim.weighted_terms(terms[q], library[k]) for q in texts for k in library}
    pairs = {"direct": ("raw", "raw"), "technique": ("raw", "translated"), "log": ("translated", "raw"), "full": ("translated", "translated")}
    tops = {m: cut(sim.top_similar(vectors[x], lib[x[1]], 10)) for m, x in pairs.items()}
    tops["hybrid"] = cut(interpret.hybrid(vectors[pairs["full"]], lib["translated"], lib["raw"], vectors[pairs["direct"]], 0.3, 10))
    sure = tops["log"].filter("rank = 1").select(F.col("a").alias("id"), F.col("sim").alias("confidence"))
    entities = v.table(spark, sf, "labels").select("doc_id").distinct()
    truth = entities.select(F.concat(F.lit("u"), "doc_id").alias("id"), F.concat(F.lit("T"), 1000 + F.col("doc_id") % 40).alias("technique"))
    every = None
    for m, top in tops.items():
        best = top.filter("rank = 1").select(F.col("a").alias("id"), F.col("b").alias("best"), F.round("sim", 6).alias("score"))
        hits = interpret.hit_at_k(truth, top, sure, 10, GAMMA).select("id", F.lit(m).alias("method"), "status").join(best, "id", "left")
        every = hits if every is None else every.unionByName(hits)
    return every


# ---- alignment ------------------------------------------------------------------------------------
def step_sequences(spark, sf, snapshots=True):
    """Per customer: sizes of the ordered parts in order of time, with ``snapshots`` also the numbers of their lines."""
    li, o, p = (v.table(spark, sf, t) for t in ("lineitem", "orders", "part"))
    size = 1000 + F.col("p_size")
    rows = li.join(p, li["l_partkey"] == p["p_partkey"]).join(o, li["l_orderkey"] == o["o_orderkey"])
    # the parts of an order in one row, where the join has them already, so that a part doesn't travel by itself
    step = F.struct("l_linenumber", "l_partkey", "l_suppkey", F.concat(F.lit("T"), size).alias("code"), size.alias("size"))
    packed = rows.groupBy("o_orderkey", "o_custkey", "o_orderdate").agg(F.sort_array(F.collect_list(step)).alias("_s"))
    columns = {"steps": F.transform("_s", lambda s: s["size"])}
    if snapshots:
        columns["snapshots"] = F.transform("_s", lambda s: F.col("o_orderkey") * 10 + s["l_linenumber"])
    order = F.struct("o_orderdate", "o_orderkey", *(x.alias(k) for k, x in columns.items()))
    packed = packed.groupBy(F.col("o_custkey").cast("string").alias("owner")).agg(F.sort_array(F.collect_list(order)).alias("_s"))
    found = packed.select("owner", *(F.flatten(f"_s.{k}").alias(k) for k in columns))
    return found.withColumn("steps", F.transform("steps", lambda x: F.concat(F.lit("T"), x)))


def sequence_library(spark, sf):
    """Per brand and type: part sizes in part order."""
    part = v.table(spark, sf, "part")
    code = F.concat(F.lit("T"), 1000 + F.col("p_size"))
    key = F.concat_ws("/", "p_brand", "p_type")
    packed = part.groupBy(key.alias("seq_id")).agg(F.sort_array(F.collect_list(F.struct("p_partkey", code.alias("code")))).alias("_s"))
    return packed.select("seq_id", F.transform("_s", lambda s: s["code"]).alias("steps"))


@query("in12_best_alignment")
def in12_best_alignment(spark, sf):
    out = interpret.best_alignment(step_sequences(spark, sf, False), sequence_library(spark, sf))
    return out.select("owner", "lib_id", "length", "lib_len", F.size(F.filter("mask", lambda m: m)).alias("n_kept"))


@query("in13_alignment_filter")
def in13_alignment_filter(spark, sf):
    kept = interpret.filter_by_alignment(step_sequences(spark, sf), sequence_library(spark, sf), ["owner"], 0.3)
    return kept.groupBy("owner").agg(F.count(F.lit(1)).alias("n_kept"), F.min("snapshot_id").alias("first"))


@query("in15_sequence_ratio")
def in15_sequence_ratio(spark, sf):
    pairs = interpret.aligned(step_sequences(spark, sf, False), sequence_library(spark, sf), ("seq_id", "lib_len", "seq_len", "length"))
    best = interpret.sequence_ratio(pairs)
    return best.groupBy("seq_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.max("ratio"), 6).alias("best_ratio"))


@query(
    "in16_technique_sequence",
    v.with_ctes(
        v.GRAPH,
        """al AS (SELECT snapshot_id, snapshot_id // 24 AS day, 'T' || (1000 + count(*) % 17) AS code FROM nodes GROUP BY 1 HAVING max(label) = 1)""",
        "SELECT day, string_agg(code, ' ' ORDER BY snapshot_id) AS steps, count(*) AS n FROM al GROUP BY 1",
    ),
)
def in16_technique_sequence(spark, sf):
    per = v.nodes(spark, sf).groupBy("snapshot_id").agg(F.max("label").alias("l"), F.count(F.lit(1)).alias("n")).filter("l = 1")
    alerts = per.select("snapshot_id", F.expr("snapshot_id div 24").alias("day"), F.concat(F.lit("T"), 1000 + F.col("n") % 17).alias("code"))
    out = interpret.technique_sequences(alerts, ["day"])
    return out.select("day", F.array_join("steps", " ").alias("steps"), F.size("snapshots").cast("bigint").alias("n"))


@query("in17_phrase_types")
def in17_phrase_types(spark, sf):
    part = v.table(spark, sf, "part")
    phrases = part.select(F.lower(F.concat_ws(" ", "p_name", "p_type")).alias("phrase"))
    out = interpret.phrase_types(phrases)
    return out.groupBy("cluster", "name").agg(F.count(F.lit(1)).alias("n"))


