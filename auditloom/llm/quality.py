"""Quality rules: word and line counts, and Jensen-Shannon distance of a document to its language.

Only DataFrame functions. A document is described by two histograms, the classes of its characters and its common
words. The same histograms summed over all documents of a language are that language's reference. A document is
rejected when one of its histograms lies too far from the reference, unless it is too short to tell.

Defined cases: a null text is empty; a language with few documents, or none, has no reference of its own; without any
documents there is nothing to compare. Rows are judged one by one, repeated rows alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditloom.llm.common import cut, fresh

SPACE = "[\\x20\\x09-\\x0D]+"
SYMBOLS = "#*$%&|<>"
#: Frequent function words of English, French, German and Spanish.
COMMON_WORDS = (
    "a and as by for from in is it of on that the this to was with "
    "avec dans de des du elle est et la le les par pour que qui un une "
    "auf das der die ein eine für ist mit nicht und von zu "
    "como con del el en las los no para por se su y"
).split()
#: Runs taken out of the text one class after the other; what is left is counted as the last class.
CLASSES = (
    ("lower", "[a-z]+"),
    ("space", SPACE),
    ("accented", "[\\u00C0-\\u024F]+"),
    ("stop", "[.,;:!?'\"()\\-]+"),
    ("upper", "[A-Z]+"),
    ("digit", "[0-9]+"),
)
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50


def base_columns(docs: DataFrame) -> DataFrame:
    """``docs`` with ``_q`` (struct of base counts, character classes and common words) for every row."""
    df = docs.withColumn("_text", F.coalesce("text", F.lit("")))
    df = df.withColumn("_words", F.filter(F.split("_text", SPACE), lambda x: x != ""))
    df = df.withColumn("_lines", F.filter(F.split("_text", "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]")))
    rest, counts = "_text", []
    for name, pattern in CLASSES:
        df = df.withColumn(f"_r_{name}", F.regexp_replace(rest, pattern, ""))
        counts.append((F.char_length(rest) - F.char_length(f"_r_{name}")).cast("long").alias(name))
        rest = f"_r_{name}"
    counts.append(F.char_length(rest).cast("long").alias("other"))
    symbols = F.char_length(rest) - F.char_length(F.translate(rest, SYMBOLS, ""))
    df = df.withColumn("_windows", _window_hashes("_words"))
    df = df.withColumn("_sorted", _sorted_windows("_windows"))
    df = df.withColumn("_twice", _repeated_starts("_sorted"))
    letters = F.split(F.lower(F.regexp_replace("_text", "[^\\p{L}]+", " ")), " ")
    df = df.withColumn("_common", F.filter(letters, lambda x: x.isin(COMMON_WORDS)))
    df = df.withColumn("_joined", F.concat(F.lit(" "), F.array_join("_common", "  "), F.lit(" ")))
    n_words = F.size("_words").cast("long")
    counted = [
        ((F.char_length("_joined") - F.char_length(F.replace("_joined", F.lit(f" {w} "), F.lit("")))) / F.lit(len(w) + 2)).cast("long")
        for w in COMMON_WORDS
    ]
    described = F.struct(
        n_words.alias("n_words"),
        (F.char_length("_text") - (F.char_length("_r_lower") - F.char_length("_r_space"))).cast("long").alias("word_chars"),
        symbols.cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        _covered("_twice").alias("n_repeat_words"),
        F.array(*counts).alias("chars"),
        F.array(*counted, F.greatest(F.lit(0), n_words - F.size("_common"))).alias("common"),
    )
    return df.select(*docs.columns, described.alias("_q"))


def _window_hashes(name: str) -> Column:
    """64-bit hashes of all windows of three words."""
    return F.when(
        F.size(name) >= 3,
        F.transform(F.sequence(F.lit(0), F.greatest(F.size(name) - 3, F.lit(0))), lambda i: F.xxhash64(F.get(name, i), F.get(name, i + 1), F.get(name, i + 2))),
    ).otherwise(F.array().cast("array<bigint>"))


def _sorted_windows(name: str) -> Column:
    """(hash, position) in order, only for texts in which a hash occurs twice."""
    paired = F.transform(name, lambda x, i: F.struct(x.alias("h"), i.alias("i")))
    return F.when(F.size(F.array_distinct(name)) < F.size(name), F.sort_array(paired)).otherwise(
        F.array().cast("array<struct<h:bigint,i:int>>")
    )


def _repeated_starts(name: str) -> Column:
    """Positions whose hash is also that of a neighbour in the sorted list."""

    def twice(x: Column, i: Column) -> Column:
        before = F.get(name, i - 1).getField("h")
        after = F.get(name, i + 1).getField("h")
        return F.coalesce(x.getField("h") == before, F.lit(False)) | F.coalesce(x.getField("h") == after, F.lit(False))

    return F.sort_array(F.transform(F.filter(name, twice), lambda x: x.getField("i")))


def _covered(name: str) -> Column:
    """Words under windows of three that start at the given positions."""
    steps = F.transform(name, lambda x, i: F.least(F.lit(3), F.coalesce(F.get(name, i + 1) - x, F.lit(3))))
    return F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x)


def shares(counts: Column) -> Column:
    """Counts as shares of their sum; all zeros when there are none."""
    total = F.aggregate(counts, F.lit(0).cast("double"), lambda a, x: a + x)
    return F.transform(counts, lambda x: F.when(total > 0, x / total).otherwise(F.lit(0.0)))


def divergence(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance (square root, base 2) of two arrays of shares."""

    def part(a: Column, b: Column) -> Column:
        return F.when(a > 0, a * F.log2(a * 2 / (a + b))).otherwise(F.lit(0.0))

    terms = F.zip_with(p, q, lambda a, b: part(a, b) + part(b, a))
    total = F.aggregate(terms, F.lit(0.0), lambda a, x: a + x)
    return F.sqrt(F.greatest(total / 2, F.lit(0.0)))


def judge(
    docs: DataFrame,
    *,
    max_char_distance: float = 0.28,
    max_word_distance: float = 0.42,
    min_chars: int = 200,
    min_words: int = 50,
    min_reference_docs: int = 20,
    max_references: int = 64,
) -> DataFrame:
    """Per row of ``docs``: doc_id, the base counts, both distances, ``base_failed`` and ``kept``.

    The histograms of all rows are written once (a few hundred bytes a row) and summed per language with map-side
    combining. The references are one row of numbers for each of the ``max_references`` most frequent languages with
    at least ``min_reference_docs`` documents, and one for the whole corpus; a document is held against the nearest
    of them, so that a wrong or missing language name does no harm.
    """
    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    described = cut(base_columns(docs.select("doc_id", lang.alias("lang"), "text")).select("doc_id", "lang", "_q.*"))
    sizes = {"chars": len(CLASSES) + 1, "common": len(COMMON_WORDS) + 1}
    sums = [F.sum(F.get(c, F.lit(i))).alias(f"{c}{i}") for c, n in sizes.items() for i in range(n)]
    by_lang = cut(described.groupBy("lang").agg(F.count("*").alias("n"), *sums))
    totals = [F.sum(F.col(f"{c}{i}")).alias(f"{c}{i}") for c, n in sizes.items() for i in range(n)]
    rows = [by_lang.agg(*totals).first()]
    named = by_lang.where((F.col("n") >= min_reference_docs) & F.col("lang").isNotNull())
    rows += named.orderBy(F.desc("n"), "lang").limit(max_references).collect()
    references = {c: [[int(r[f"{c}{i}"] or 0) for i in range(n)] for r in rows] for c, n in sizes.items()}

    def nearest(c: str) -> Column:
        own = F.array(*[F.array(*[F.lit(x / max(1, sum(ref))) for x in ref]) for ref in references[c]])
        return F.get(F.transform(F.array(shares(F.col(c))), lambda p: F.array_min(F.transform(own, lambda q: divergence(p, q)))), F.lit(0))

    judged = described.withColumns(
        {
            "char_distance": nearest("chars"),
            "word_distance": nearest("common"),
            "base_failed": (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT),
        }
    )
    too_far = ((F.col("word_chars") >= min_chars) & (F.col("char_distance") > max_char_distance)) | (
        (F.col("n_words") >= min_words) & (F.col("word_distance") > max_word_distance)
    )
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & ~too_far).alias("kept"), "char_distance", "word_distance",
    )


def keep_good(docs: DataFrame, **limits) -> DataFrame:
    """The rows of ``docs`` that pass. Rows under one doc_id go together, and only if all of them fail."""
    verdict, name = judge(docs, **limits), fresh(docs, "_bad")
    bad = verdict.groupBy("doc_id").agg(F.max("kept").alias("_kept")).where("NOT _kept").select(F.col("doc_id").alias(name))
    return docs.join(bad, F.col("doc_id").eqNullSafe(F.col(name)), "left_anti")
