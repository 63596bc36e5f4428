"""Operators 11 to 13 against brute force, the library and plain trees, on small tables with odd rows."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from auditloom.llm import byte_pairs, manifest, negatives
from auditloom.session import ship_package

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
BITS = ["'s", "'t", "'re", "'ve", "'m", "'ll", "'d", "'", "''", " ", "  ", "\n", "\t", "\r\n", "a", "é", "é", "中文", "1", "½", "٣", ".", "!?", "👍🏽", " ", "　", "\u0085", "l", "re", "<|endoftext|>", "\0", "Ᲊ", "𞤀", "word", " the", "�"]


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_pairs.read_ranks(RANKS), special_tokens={})


@pytest.fixture(scope="module", autouse=True)
def shipped(spark):
    ship_package(spark)


# ---- 11 -------------------------------------------------------------------------------------------
KINDS = "vec_id long, embedding array<float>, label int, tree int, size int, score long, slot int"


def vectors(seed, n, dim=8):
    rnd = random.Random(seed)
    centres = [[rnd.gauss(0, 1) for _ in range(dim)] for _ in range(5)]
    out = [(i, [c + rnd.gauss(0, 0.4) for c in centres[i % 5]], rnd.randrange(4)) for i in range(n)]
    out += [(n + k, list(out[3][1]), out[3][2]) for k in range(60)]  # copies: ties by vec_id
    odd = [(900, None, 1), (950, [1.0, None] + [0.0] * 6, 1), (901, [float("nan")] * dim, 2), (902, [float("inf")] * dim, 2), (903, [1.0] * dim, None)]
    odd += [(None, [1.0] * dim, 1), (905, [], 1), (910, [0.5, 1.5], 1), (1000, [0.25, 0.5], 1), (920, [1.0, 2.0], 2), (930, [0.0] * dim, 3), (1050, [0.0] * dim, 3)]
    return out + odd + [out[5], (5, [9.0] * dim, 3)]


def mined(rows):
    """Plain nested loops."""
    best = {}
    for i, x, label in rows:
        if i is None or x is None or label is None or any(c is None or not np.isfinite(c) for c in x):
            continue
        mine = (label, [int(np.floor(256 * float(np.float32(c)))) for c in x])
        best[i] = min(best.get(i, mine), mine)
    out = set()
    for a, (label, x) in best.items():
        if a % 50:
            continue
        scored = [(-sum(p * q for p, q in zip(x, y, strict=True)), b, k == label) for b, (k, y) in best.items() if b != a and len(y) == len(x)]
        for s, p, _ in sorted(t for t in scored if t[2])[:5]:
            fits = sorted((t, b) for t, b, same in scored if not same and -50 * s <= -100 * t <= -95 * s)[:3]
            out |= {(a, p, r + 1, b, -s, -t) for r, (t, b) in enumerate(fits)}
    return out


def test_hard_negatives_against_brute_force(spark):
    rows = vectors(1, 400)
    table = spark.createDataFrame([(*r, 1, 2, 3, 4) for r in rows], KINDS).repartition(5)
    expected = mined(rows)
    usable = negatives.usable(table, F.col("label"))
    for tree, trees in ((3, 2), (1024, 8)):
        got = [tuple(r) for r in negatives.hard_negatives(usable, F.col("vec_id") % 50 == 0, tree=tree, trees=trees).collect()]
        assert len(got) == len(set(got)) and set(got) == expected and len(expected) > 40
    assert negatives.hard_negatives(usable.limit(0), F.col("vec_id") % 50 == 0).count() == 0
    assert negatives.hard_negatives(usable, F.col("vec_id") < 0).count() == 0


def test_bounds_spare_scores_and_lose_none():
    rnd = np.random.default_rng(3)
    centres = rnd.normal(0, 800, (6, 16))
    points = np.rint(centres[np.arange(600) % 6] + rnd.normal(0, 30, (600, 16))).astype(np.int64)
    anchors = points[:60]
    order, parent, edge = negatives.spanning_tree(anchors)
    assert sorted(order.tolist()) == list(range(60)) and parent[0] == -1 and (parent[1:] < np.arange(1, 60)).all()
    for k in range(1, 60):
        assert np.isclose(edge[k], np.sqrt(((anchors[order[k]] - anchors[order[parent[k]]]) ** 2).sum()))
    high = np.full((60, 1), np.iinfo(np.int64).max)
    top = np.sort(points @ anchors[order].T, axis=0)[-20:].min(axis=0)
    row = {"vec_id": (10_000 + order).tolist(), "label": [0] * 60, "vectors": anchors[order].ravel().tolist(), "size": 16, "parent": parent.tolist(), "edge": edge.tolist()}
    tree = negatives.Tree(row, top[:, None].copy(), high, 30)
    tree.take(np.arange(600), np.ones(600, np.int64), points, False)
    assert tree.counted < 0.5 * 600 * 60
    for k in range(60):
        scores = points @ anchors[order[k]]
        assert set(tree.best[k][0][0].tolist()) == set(np.lexsort((np.arange(600), -scores))[: min(30, int((scores >= top[k]).sum()))].tolist())


def test_products_do_not_round():
    a = np.array([[3_037_000_499, 1], [94_906_267, -5]], np.int64)
    assert negatives.products(a, a).tolist() == [[int(x) * int(u) + int(y) * int(v) for u, v in a] for x, y in a]


# ---- 12 -------------------------------------------------------------------------------------------
def test_character_kinds_and_words(library):
    rnd = random.Random(7)
    kinds = np.frombuffer(byte_pairs.character_kinds(), np.uint8)
    words = tiktoken.Encoding("w", pat_str=public_tokenizers.PATTERN, mergeable_ranks={bytes([i]): i for i in range(256)}, special_tokens={})
    texts = ["".join(rnd.choice(BITS) for _ in range(rnd.randint(0, 14))) for _ in range(4000)] + ["", ""]
    found, at = byte_pairs.packed(texts, kinds)
    found = found.to_pylist()
    for text, numbers in zip(texts, at, strict=True):
        assert b"".join(found[i] for i in numbers) == text.encode()
        # the library encodes each word by itself, so its tokens end where words end
        assert bytes(words.encode_ordinary(text)) == text.encode()
        assert [i for k in numbers for i in library._core_bpe.encode_single_piece(found[k])] == library.encode_ordinary(text)


def test_encoding_equals_the_library(spark, library):
    rnd = random.Random(8)
    texts = ["".join(rnd.choice(BITS) for _ in range(rnd.randint(0, 30))) for _ in range(300)]
    texts += ["", None, "x" * 40_000, "ab" * 9_000, "".join(rnd.choice("abcdefgh") for _ in range(3_000)), "word " * 20_000, " " * 5_000, "中" * 3_000]
    rows = list(enumerate(texts)) + [(None, "no id"), (3, texts[3])]
    docs = spark.createDataFrame([(i, t, "ids", 1) for i, t in rows], "doc_id long, text string, ids string, words int").repartition(3)
    expected = sorted(((i, library.encode_ordinary(t or "")) for i, t in rows), key=str)
    assert sorted(((r[0], r[1]) for r in byte_pairs.encode(docs, RANKS).collect()), key=str) == expected
    assert sorted(((r[0], r[1]) for r in byte_pairs.encode(docs, RANKS, size=40).collect()), key=str) == expected
    trip = {(r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in byte_pairs.round_trip(docs, RANKS).collect()}
    sha = lambda b: hashlib.sha256(b).hexdigest()
    assert trip == {(i, len(x), sha(np.array(x, "<u4").tobytes()), sha(library.decode_bytes(x))) for i, x in expected}
    assert byte_pairs.round_trip(docs.limit(0), RANKS).count() == 0


def test_both_folds_agree(spark):
    rnd = random.Random(9)
    texts = ["".join(rnd.choice(BITS) for _ in range(25)) for _ in range(40)] + ["x" * 20_000 + " " + "x" * 700, None, "", "abc" * 300]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    assert sorted(map(tuple, byte_pairs.encode(docs, RANKS, fold="spark").collect()), key=str) == sorted(map(tuple, byte_pairs.encode(docs, RANKS).collect()), key=str)


# ---- 13 -------------------------------------------------------------------------------------------
def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_tree(nodes):
    """(root, siblings of every leaf level by level)."""
    paths, under = [[] for _ in nodes], [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        above, wider = [], []
        for k in range(0, len(nodes), 3):
            run = nodes[k : k + 3]
            for j in range(len(run)):
                for x in under[k + j]:
                    paths[x].append((run[:j], run[j + 1 :]))
            above.append(h(*run))
            wider.append(sum(under[k : k + 3], []))
        nodes, under = above, wider
    return nodes[0], paths


def plain_manifest(rows):
    part = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r, text: h(*map(part, (r[0], r[1], r[2], r[3], text)))

    def later(r):
        even = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0
        return r[4].replace("\n", "") if even and r[4] is not None else r[4]

    by = defaultdict(list)
    for r in rows:
        by[r[1]].append(r)
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    done = {s: sorted(((r[0], leaf(r, r[4]), leaf(r, later(r))) for r in by[s]), key=lambda x: (x[0] is not None, x)) for s in names}
    low = {s: plain_tree([x[1] for x in done[s]]) for s in names}
    root, top = plain_tree([low[s][0] for s in names])
    out = []
    for i, s in enumerate(names):
        for (doc, own, now), path in zip(done[s], low[s][1], strict=True):
            for a, b in path + top[i]:
                now = h(*a, now, *b)
            out.append((doc, own, low[s][0], root, h(*[x for a, b in path + top[i] for x in a + b]), now, now == root))
    return out


def test_positions_are_postorder():
    for leaves in (1, 2, 3, 4, 8, 9, 10, 26, 27, 28, 80):
        for height in range(manifest.height_of(leaves), 5):
            names = [str(i) for i in range(leaves)]
            log, level = manifest.build(names, height), names
            for k, width in enumerate(manifest.widths(leaves, height)):
                assert len(level) == width and [log[manifest.place(k, i, leaves, height)] for i in range(width)] == level
                level = [h(*level[i : i + 3]) for i in range(0, width, 3)]
            assert len(log) == sum(manifest.widths(leaves, height))


@pytest.mark.parametrize("height", [1, 2, 6])
def test_manifest_against_plain_trees(spark, height):
    rnd = random.Random(height)
    rows = [(i, rnd.choice(["hot", "hot", "hot", "a", "é", ""]), "en", i, "line\n" * (i % 4) + str(i)) for i in range(100)]
    rows += [(200, None, None, None, None), (201, None, "de", 2, "x\ny"), (202, "single", "en", 1, ""), (None, "a", "en", 1, "q\n"), (7, "a", "en", 7, "again"), (7, "a", "en", 7, "again")]
    rows += [(204, "-", "en", 1, "\n" * 3000), (205, "null", "en", 1, "z")]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, source string, lang string, n_chars long, text string, tree int, leaf string").repartition(4)
    got = [tuple(r) for r in manifest.manifest(docs, manifest.without_line_feeds(), height).collect()]
    assert sorted(got, key=str) == sorted(plain_manifest(rows), key=str)
    assert 0 < sum(r[-1] for r in got) < len(got)


def test_manifest_of_one_and_none(spark):
    kinds = "doc_id long, source string, lang string, n_chars long, text string"
    one = [(5, "s", "en", 1, "a\nb")]
    assert [tuple(r) for r in manifest.manifest(spark.createDataFrame(one, kinds), manifest.without_line_feeds()).collect()] == plain_manifest(one)
    assert manifest.manifest(spark.createDataFrame([], kinds), manifest.without_line_feeds()).count() == 0
