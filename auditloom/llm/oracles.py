"""Oracle SQL for the queries that SQL can express."""

from __future__ import annotations

from auditloom.llm.quality import CLASSES, COMMON_WORDS, SYMBOLS

_WORD = r"[^\x20\x09-\x0D]+"


def _quality_sql() -> str:
    """The rules of ``quality.judge`` with its default limits."""
    # a class is counted in what the classes before it have left
    cleaned, counts, before = [], [], "t"
    for name, pattern in CLASSES:
        ranges = pattern.replace("\\u00C0-\\u024F", "\\x{00C0}-\\x{024F}").replace("'", "''")
        cleaned.append((f"r_{name}", f"regexp_replace({before}, '{ranges}', '', 'g')"))
        counts.append(f"length({before}) - length(r_{name})")
        before = f"r_{name}"
    counts.append(f"length({before})")
    steps, source = [], "base"
    for i, (name, expr) in enumerate(cleaned):
        steps.append(f"s{i} AS MATERIALIZED (SELECT *, {expr} AS {name} FROM {source})")
        source = f"s{i}"
    common = ", ".join(f"'{w}'" for w in COMMON_WORDS)
    per_word = ", ".join(f"len(list_filter(cw, lambda x: x = '{w}'))" for w in COMMON_WORDS)
    sizes = {"chars": len(CLASSES) + 1, "common": len(COMMON_WORDS) + 1}
    sums = ", ".join(f"[{', '.join(f'sum({c}[{i + 1}])' for i in range(n))}] AS {c}" for c, n in sizes.items())
    share = "list_transform({0}, lambda x: CASE WHEN list_sum({0}) > 0 THEN x / list_sum({0})::DOUBLE ELSE 0.0 END)"
    part = "CASE WHEN {a} > 0 THEN {a} * log2({a} * 2 / ({a} + {b})) ELSE 0 END"
    p, q = "d.p_{c}[i]", "r.p_{c}[i]"
    distance = (
        "sqrt(greatest(list_sum(list_transform(range(1, {n} + 1), lambda i: " + part.format(a=p, b=q) + " + " + part.format(a=q, b=p) + ")) / 2, 0))"
    )
    chars, words = (distance.format(c=c, n=n) for c, n in sizes.items())
    return rf"""WITH base AS (
  SELECT doc_id, lang, coalesce(text, '') AS t FROM documents
), {", ".join(steps)}, described AS MATERIALIZED (
  SELECT doc_id, lang, regexp_extract_all(t, '{_WORD}') AS w,
    length(t) - (length(r_lower) - length(r_space)) AS word_chars,
    length({before}) - length(translate({before}, '{SYMBOLS}', '')) AS n_symbols,
    list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines,
    [{", ".join(counts)}] AS chars,
    list_filter(string_split(lower(regexp_replace(t, '[^\p{{L}}]+', ' ', 'g')), ' '), lambda x: x IN ({common})) AS cw
  FROM {source}
), wins AS (
  SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM described WHERE len(w) >= 3)
), twice AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM wins) WHERE n > 1
), repeats AS (
  SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM twice, (VALUES (0), (1), (2)) v(k) GROUP BY doc_id
), counted AS MATERIALIZED (
  SELECT doc_id, lang, len(w)::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
    chars, list_append([{per_word}], greatest(0, len(w) - len(cw))) AS common
  FROM described LEFT JOIN repeats USING (doc_id)
), refs AS (
  SELECT {sums} FROM counted
  UNION ALL
  SELECT * EXCLUDE (lang, n) FROM (SELECT lang, count(*) AS n, {sums} FROM counted WHERE lang IS NOT NULL
    GROUP BY lang HAVING count(*) >= 20 ORDER BY n DESC, lang LIMIT 64)
), r AS (SELECT {share.format("chars")} AS p_chars, {share.format("common")} AS p_common FROM refs
), d AS (SELECT *, {share.format("chars")} AS p_chars, {share.format("common")} AS p_common FROM counted
), judged AS (
  SELECT d.doc_id, min({chars}) AS char_distance, min({words}) AS word_distance FROM d, r GROUP BY d.doc_id
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 50 OR n_repeat_words * 100 > n_words * 50 AS base_failed,
  NOT (n_words < 50 OR n_repeat_words * 100 > n_words * 50
    OR (word_chars >= 200 AND char_distance > 0.28) OR (n_words >= 50 AND word_distance > 0.42)) AS kept
FROM counted JOIN judged USING (doc_id)"""


QUALITY_SQL = _quality_sql()

_CONTROL = r"### [A-Za-z0-9_.%~-]*: |</turn>"
CHAT_SQL = rf"""WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length('### : ') + length(role) + length(text) + length(regexp_extract_all(text, '{_CONTROL}'))
    + length(chr(10) || '</turn>' || chr(10)))::BIGINT AS formatted_chars
FROM rows GROUP BY conv_id"""

NEGATIVES_SQL = """WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END::BIGINT AS label,
    list_transform(embedding, lambda x: floor(x::DOUBLE * 256)) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (SELECT a.vec_id AS anchor_id, v.vec_id, a.label = v.label AS same, list_sum(list_transform(list_zip(a.q, v.q), lambda x: x[1] * x[2]))::BIGINT AS score
  FROM v a JOIN v ON a.vec_id % 50 = 0 AND a.vec_id <> v.vec_id AND len(a.q) = len(v.q)),
near AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id AS negative_id,
  positive_score, score AS negative_score
FROM near JOIN scored USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY rank <= 3"""


def _tree_sql(name: str, nodes: str) -> str:
    """CTEs of ternary trees over ``nodes`` (tree, i, node): <name> (all nodes by level, n of the level) and <name>_side."""
    return f"""{name} AS (SELECT tree, 0 AS lvl, i, node, count(*) OVER (PARTITION BY tree) AS n FROM {nodes}
  UNION ALL SELECT tree, lvl + 1, i // 3, sha256(string_agg(node, '' ORDER BY i)), (n + 2) // 3 FROM {name} WHERE n > 1 GROUP BY tree, lvl, i // 3, n),
{name}_side AS (SELECT t.tree, t.lvl, t.i, coalesce(string_agg(o.node, '' ORDER BY o.i) FILTER (o.i < t.i), '') AS l,
    coalesce(string_agg(o.node, '' ORDER BY o.i) FILTER (o.i > t.i), '') AS r
  FROM {name} t JOIN {name} o ON t.tree IS NOT DISTINCT FROM o.tree AND t.lvl = o.lvl AND t.i // 3 = o.i // 3 WHERE t.n > 1 GROUP BY 1, 2, 3)"""


def _walk_sql(name: str, start: str, tree: str) -> str:
    """CTE <name>: from ``start`` (uid, tree, i, own, proof) upwards, level by level."""
    return f"""{name} AS (SELECT uid, tree, 0 AS lvl, i, own, proof FROM {start}
  UNION ALL SELECT uid, w.tree, w.lvl + 1, w.i // 3, sha256(l || own || r), proof || l || r
  FROM {name} w JOIN {tree}_side s ON s.tree IS NOT DISTINCT FROM w.tree AND s.lvl = w.lvl AND s.i = w.i)"""


def _leaf_sql(text: str) -> str:
    parts = [f"coalesce(strlen({c}::VARCHAR)::VARCHAR || ':' || {c}::VARCHAR, '-')" for c in ("doc_id", "source", "lang", "n_chars", text)]
    return f"sha256({' || '.join(parts)})"


_CRC32 = """list_reduce(list_prepend(4294967295, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ord(c)::BIGINT)),
    lambda c, b: list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda x, y: xor(x >> 1, 3988292384 * (x & 1))))"""

MANIFEST_SQL = f"""WITH RECURSIVE found AS (SELECT *, CASE WHEN xor({_CRC32}, 4294967295) % 2 = 0 THEN replace(text, chr(10), '') ELSE text END AS later FROM documents),
rows AS (SELECT doc_id, source AS tree, {_leaf_sql("text")} AS node, {_leaf_sql("later")} AS own FROM found),
leaves AS (SELECT *, '' AS proof, row_number() OVER () AS uid,
    row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, node, own) - 1 AS i FROM rows),
{_tree_sql("low", "leaves")},
subs AS (SELECT tree AS source, node AS subroot, row_number() OVER (ORDER BY tree NULLS FIRST) - 1 AS i FROM low WHERE n = 1),
tops AS (SELECT 'top' AS tree, i, subroot AS node FROM subs),
{_tree_sql("high", "tops")},
{_walk_sql("climb", "leaves", "low")},
upper_start AS (SELECT uid, 'top' AS tree, s.i, own, proof, subroot FROM climb c JOIN subs s ON s.source IS NOT DISTINCT FROM c.tree
  QUALIFY row_number() OVER (PARTITION BY uid ORDER BY lvl DESC) = 1),
{_walk_sql("summit", "upper_start", "high")},
ends AS (SELECT * FROM summit QUALIFY row_number() OVER (PARTITION BY uid ORDER BY lvl DESC) = 1)
SELECT doc_id, l.node AS leaf, subroot, t.node AS root, sha256(e.proof) AS proof_sha256, e.own AS folded_root, e.own = t.node AS verified
FROM leaves l JOIN ends e USING (uid) JOIN upper_start u USING (uid) CROSS JOIN (SELECT node FROM high WHERE n = 1) t"""
