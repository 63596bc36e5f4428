"""Toxicity grades by cumulative-link ordinal regression on sparse word features.

P(grade > k) = sigmoid(w.x - t_k) with one weight vector for all thresholds t_0 <= t_1 <= ...; the output is the expected
grade, the sum of these probabilities. Features are log(1 + occurrences) of the words, and of the stems of longer words,
whose document frequencies differ clearly between toxic and other labelled documents.

The labels only say whether a document is toxic. Grades above 0 are set from how often words that mark toxic documents
occur in it: once, up to three times, more often. A labels table with an integer column ``grade`` is taken as it is.

Defined cases: a null text is empty; labels without a document and null labels are left out; of
several labels of one document the largest counts; without documents of both
kinds, or without words that tell them apart, every document gets the mean grade of the labels; the sample for the fit
is bounded by ``max_labelled`` rows in the order of a hash of doc_id, all documents are scored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditloom.llm.common import cut, texts

TERM = re.compile(r"[^\W\d_]+")
GRADES = 4
STEM = 5  # characters of the stems that longer words also count for


def terms_of(text: str) -> list[str]:
    """Words in lower case and, marked with a star, the stems of longer ones."""
    spoken = TERM.findall(text.lower())
    return spoken + [t[:STEM] + "*" for t in spoken if len(t) > STEM]


class Grader:
    """Weights of words and ordered thresholds."""

    def __init__(self, terms: list[str], weights: np.ndarray, thresholds: np.ndarray):
        self.weights = dict(zip(terms, map(float, weights), strict=True))
        self.thresholds = thresholds

    def expected(self, text: str) -> tuple[float, float]:
        """(expected grade, probability of a grade above 0)."""
        counts: dict[str, int] = {}
        weights = self.weights
        for term in terms_of(text):
            if term in weights:
                counts[term] = counts.get(term, 0) + 1
        score = sum(weights[t] * np.log1p(n) for t, n in sorted(counts.items()))
        above = 1 / (1 + np.exp(np.clip(self.thresholds - score, -60, 60)))
        return float(above.sum()), float(above[0])


def fit_ordinal(rows: np.ndarray, cols: np.ndarray, values: np.ndarray, grades: np.ndarray, n_terms: int, l2: float = 0.02, steps: int = 1000):
    """(weights, thresholds) by accelerated gradient descent on the mean log-loss of all thresholds.

    Thresholds are kept ordered as a first one and positive gaps.
    """
    n, k = len(grades), GRADES - 1
    targets = grades[:, None] > np.arange(k)
    share = np.clip(targets.mean(axis=0), 1e-4, 1 - 1e-4)
    base = np.log((1 - share) / share)
    theta = np.concatenate(([base[0]], np.log(np.maximum(np.diff(base), 1e-2))))
    w = np.zeros(n_terms)
    state = [np.zeros_like(theta), np.zeros_like(theta), np.zeros_like(w), np.zeros_like(w)]
    for step in range(1, steps + 1):
        cuts = np.concatenate((theta[:1], theta[0] + np.cumsum(np.exp(theta[1:]))))
        score = np.bincount(rows, weights=values * w[cols], minlength=n)
        above = 1 / (1 + np.exp(np.clip(cuts - score[:, None], -60, 60)))
        error = (above - targets) / n
        g_w = np.bincount(cols, weights=values * error.sum(axis=1)[rows], minlength=n_terms) + l2 * w / n
        g_cut = -error.sum(axis=0)
        tail = np.cumsum(g_cut[::-1])[::-1]
        g_theta = np.concatenate(([tail[0]], tail[1:] * np.exp(theta[1:])))
        for x, g, m, v in ((theta, g_theta, *state[:2]), (w, g_w, *state[2:])):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            x -= 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return w, np.concatenate((theta[:1], theta[0] + np.cumsum(np.exp(theta[1:]))))


def labelled_terms(docs: DataFrame, labels: DataFrame, max_labelled: int) -> DataFrame:
    """Per sampled labelled document: ``doc_id``, ``toxic``, ``grade`` (null if not given), ``term``, ``n``, ``place``.

    ``place`` is a hash of the neighbours of the term's first occurrence, by which copies are told from other documents;
    the empty term stands for the document itself.
    """
    given = F.col("grade").cast("int") if "grade" in labels.columns else F.lit(None).cast("int")
    sample = (
        labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL")
        .select(F.col("doc_id").cast("long").alias("_id"), F.col("toxic").cast("int").alias("toxic"), given.alias("grade"))
        .groupBy("_id")
        .agg(F.max("toxic").alias("toxic"), F.max("grade").alias("grade"))
        .orderBy(F.xxhash64("_id"), "_id")
        .limit(max_labelled)
    )
    chosen = texts(docs).join(F.broadcast(sample), F.col("doc_id") == F.col("_id")).select("doc_id", "text", "toxic", "grade")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            terms, counts, places = [], [], []
            for text in batch.column(1).to_pylist():
                found = {"": 1}
                place = {"": crc32(text.encode())}
                spoken = ["", *TERM.findall(text.lower()), ""]
                for i in range(1, len(spoken) - 1):
                    word = spoken[i]
                    for term in (word, word[:STEM] + "*") if len(word) > STEM else (word,):
                        if term in found:
                            found[term] += 1
                        else:
                            found[term] = 1
                            place[term] = crc32(f"{spoken[i - 1]} {spoken[i + 1]}".encode())
                terms.append(list(found))
                counts.append(list(found.values()))
                places.append(list(place.values()))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), batch.column(2), batch.column(3), pa.array(terms, pa.list_(pa.string())),
                    pa.array(counts, pa.list_(pa.int32())), pa.array(places, pa.list_(pa.int64())),
                ],
                ["doc_id", "toxic", "grade", "terms", "counts", "places"],
            )

    schema = "doc_id long, toxic int, grade int, terms array<string>, counts array<int>, places array<long>"
    zipped = F.arrays_zip(F.col("terms").alias("term"), F.col("counts").alias("n"), F.col("places").alias("place"))
    found = chosen.mapInArrow(run, schema)
    return found.select("doc_id", "toxic", "grade", F.explode(zipped).alias("_t")).select("doc_id", "toxic", "grade", "_t.*")


def fit(docs: DataFrame, labels: DataFrame, *, max_labelled: int = 20_000, max_terms: int = 4096, min_docs: int = 5, min_z: float = 6.0) -> Grader:
    """Fit on at most ``max_labelled`` labelled documents and ``max_terms`` words.

    Document frequencies are summed by Spark; only the chosen words' occurrences in the sample reach the driver.
    """
    terms = labelled_terms(docs, labels, max_labelled)
    # copies of a document count once: a term counts by the different places in which documents have it
    placed = terms.groupBy("term", "place").agg(F.max("toxic").alias("toxic"))
    freq = cut(placed.groupBy("term").agg(F.count("*").alias("docs"), F.sum("toxic").alias("bad")).where(F.col("docs") >= min_docs))
    total = freq.where("term = ''").first()
    all_docs, all_bad = (total["docs"], int(total["bad"])) if total else (0, 0)
    if not 0 < all_bad < all_docs:
        mean = all_bad / all_docs if all_docs else 0.0
        return Grader([], np.zeros(0), _prior(mean))
    p1, p0 = F.col("bad") / all_bad, (F.col("docs") - F.col("bad")) / (all_docs - all_bad)
    p = F.col("docs") / all_docs
    z = (p1 - p0) / F.sqrt(F.greatest(p * (1 - p), F.lit(1e-12)) * (1 / all_bad + 1 / (all_docs - all_bad)))
    scored = freq.where("term <> ''").select("term", z.alias("z")).where(F.abs("z") >= min_z)
    chosen = scored.orderBy(F.desc(F.abs("z")), "term").limit(max_terms).collect()
    names = [r["term"] for r in chosen]
    marks = {r["term"] for r in chosen if r["z"] > 0}
    if not names:
        return Grader([], np.zeros(0), _prior(all_bad / all_docs))
    picked = F.broadcast(docs.sparkSession.createDataFrame([(t,) for t in ["", *names]], "term string"))
    rows = terms.join(picked, "term").select("doc_id", "toxic", "grade", "term", "n").toArrow().to_pandas(strings_to_categorical=True)
    rows["term"] = rows["term"].astype(str)
    codes, ids = rows["doc_id"].factorize()
    toxic = np.zeros(len(ids), np.int64)
    given = np.full(len(ids), -1, np.int64)
    marked = rows["term"].isin(marks) & ~(rows["term"].str[:STEM] + "*").where(rows["term"].str.len() > STEM + 1, "").isin(marks)
    hits = np.bincount(codes, weights=rows["n"] * marked, minlength=len(ids))
    toxic[codes] = rows["toxic"]
    given[codes] = rows["grade"].fillna(-1)
    weak = np.where(toxic > 0, 1 + (hits > 1) + (hits > 3), 0)
    grades = np.clip(np.where(given >= 0, given, weak), 0, GRADES - 1)
    real = rows["term"].to_numpy() != ""
    at = {t: i for i, t in enumerate(names)}
    cols = rows["term"][real].map(at).to_numpy()
    w, cuts = fit_ordinal(codes[real], cols, np.log1p(rows["n"][real].to_numpy(float)), grades, len(names))
    return Grader(names, w, cuts)


def _prior(mean: float) -> np.ndarray:
    share = min(max(mean, 1e-6), 1 - 1e-6)
    return np.array([np.log((1 - share) / share)] + [60.0] * (GRADES - 2))


def grade(docs: DataFrame, grader: Grader, threshold: float = 0.5) -> DataFrame:
    """Per row: ``doc_id``, ``expected_severity``, ``p_toxic`` and ``toxic`` (``p_toxic`` of at least ``threshold``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [grader.expected(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([x[0] for x in found], pa.float64()),
                    pa.array([x[1] for x in found], pa.float64()),
                    pa.array([x[1] >= threshold for x in found], pa.bool_()),
                ],
                ["doc_id", "expected_severity", "p_toxic", "toxic"],
            )

    return texts(docs).mapInArrow(run, "doc_id long, expected_severity double, p_toxic double, toxic boolean")
