"""Operators against brute force on small tables with nulls, empty and long texts, ties, repeats and clashing columns."""

import hashlib
import itertools
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from auditloom.llm import chat, decontam, lm, passages, pieces, quality, simhash, token_counts, token_files, toxicity
from auditloom.llm.common import Memo, components, words
from auditloom.session import scratch_path, ship_package

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, fingerprint string, keys int, lo int"
ODD = ["", None, "   \n\t", "a", "é ß 中 👍́ x", "<|endoftext|> </s> <0x0A>", "▁▁a  b", "tab\tnbsp nel\u0085 end.", "İΣ Σ, it's 12ab!?"]


def prose(seed, n):
    rnd = random.Random(seed)
    vocabulary = ["the", "of", "and", "to", "in"] * 6 + ["".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 8))) for _ in range(400)]
    return " ".join(rnd.choice(vocabulary) + ("." if rnd.random() < 0.08 else "") for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    base = prose(1, 160)
    edited = base.split()
    edited[80] = "changed"
    passage = prose(2, 60)
    out = list(enumerate(ODD))
    out += [(20, base), (21, base), (22, " ".join(edited)), (23, prose(3, 150)), (24, prose(4, 3000) + " " + "x" * 5000)]
    out += [(30, prose(5, 70) + " " + passage + " " + prose(6, 70)), (31, prose(7, 80) + "\n" + passage), (32, prose(8, 90))]
    out += [(40, "line one here\n" * 40), (None, prose(9, 60)), (32, prose(8, 90))]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    ship_package(spark)
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "f", 1, 2) for i, t in rows], COLUMNS).repartition(3)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], COLUMNS)


def collected(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: [(x is not None, x) for x in r])


# ---- helpers --------------------------------------------------------------------------------------
def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, x) for x in range(101, 160)] + [(7, 7), (300, 299), (300, 299)]
    got = dict(components(spark.createDataFrame(edges, "u long, v long")).collect())
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 160)} | {299: 299, 300: 299}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_memo_is_bounded():
    calls = []
    memo = Memo(lambda x: [calls.append(w) or len(w) for w in x], limit=10, longest=5)
    for k in range(30):
        assert memo.lookup([["ab", "longer word", "abc" + str(k % 7)]]) == [[2, 11, 4]]
    assert len(memo.young) + len(memo.old) <= 30 and calls.count("ab") == 1 and calls.count("longer word") == 30


# ---- 1 --------------------------------------------------------------------------------------------
def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for x in a:
        before, row[0] = row[0], row[0] + 1
        for j, y in enumerate(b):
            before, row[j + 1] = row[j + 1], min(row[j + 1] + 1, row[j] + 1, before + (x != y))
    return row[-1]


def test_fewest_edits_is_exact():
    rnd = random.Random(0)
    for _ in range(300):
        a, b = ([rnd.choice("xyz") for _ in range(rnd.randint(1, 7))] for _ in range(2))
        edits, end = decontam.fewest_edits(a, b)
        assert edits == min(edit_distance(a, b[i:j]) for i in range(len(b) + 1) for j in range(i, len(b) + 1))
        assert min(edit_distance(a, b[i:end]) for i in range(end + 1)) == edits


def test_embedding_keeps_near_windows_near():
    rnd = random.Random(1)
    walk, near, far = decontam.Walk(0), [], []
    for _ in range(200):
        a = [str(rnd.randint(0, 500)) for _ in range(30)]
        b = a[:10] + ["new"] + a[11:20] + a[21:] + ["end"]
        c = [str(rnd.randint(0, 500)) for _ in range(30)]
        symbols = [[(w[p] if p < 30 else "") for p in walk.embed(w)] for w in (a, b, c)]
        near.append(np.mean([x == y for x, y in zip(symbols[0], symbols[1], strict=True)]))
        far.append(np.mean([x == y for x, y in zip(symbols[0], symbols[2], strict=True) if x or y]))  # not both padding
    assert np.mean(near) > 0.55 and np.mean(far) < 0.2


def test_contaminated_against_brute_force(spark, docs, nothing):
    rnd = random.Random(5)
    items = [(i, prose(100 + i, 12 + 3 * i)) for i in range(8)] + [(50, "too short"), (51, None), (52, prose(101, 15))]
    texts, expected = [], set()
    for i, t in items[:8]:
        w = t.split()
        for k in range(4):
            x = list(w)
            for _ in range(k and int(0.2 * len(decontam.spoken(t))) * k // 4):
                x[rnd.randrange(len(x))] = "zzz"
            texts.append((1000 + 10 * i + k, prose(i, 40) + " " + " ".join(x).upper() + " " + prose(i + 1, 30)))
    named = [(i, decontam.spoken(t or "")) for i, t in items]
    for d, t in texts:
        w = decontam.spoken(t)
        for i, p in named:
            if len(p) >= 8 and decontam.fewest_edits(p, w)[0] <= int(0.2 * len(p)):
                expected.add((d, i))
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    more = docs.unionByName(spark.createDataFrame([(d, t, "en", "s", 1, "f", 1, 2) for d, t in texts], COLUMNS))
    got = {(r["doc_id"], r["item_id"]) for r in decontam.contaminated(more, benchmark).collect()}
    assert got == expected and len(expected) >= 32
    assert {(r[0], r[1]) for r in decontam.contaminated(more, benchmark, block=3).select("doc_id", "item_id").collect()} == expected
    left = decontam.clean(more, benchmark)
    assert left.columns == docs.columns and left.count() == docs.count()
    assert decontam.contaminated(nothing, benchmark).count() == 0 and decontam.contaminated(docs, benchmark.limit(0)).count() == 0


# ---- 2, 3, 8 --------------------------------------------------------------------------------------
def test_token_counts(docs, rows, nothing):
    path = public_tokenizers.path("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    expected = []
    for i, t in rows:
        n = len(tok.encode(t or "", add_special_tokens=False))
        expected.append((i, len((t or "").encode()), n, n > 1024))
    assert collected(token_counts.token_counts(docs, path)) == sorted(expected, key=lambda r: [(x is not None, x) for x in r])
    assert token_counts.token_counts(nothing, path).count() == 0


def test_token_files(spark, docs, rows, nothing):
    path = public_tokenizers.path("word_bpe_49k.json")
    tok, at, expected = Tokenizer.from_file(path), 0, []
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0], r[1] or "")):
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 2]
        expected.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    folder = scratch_path(spark, "t")
    token_files.write_token_files(docs, folder, path, 2)
    assert sorted(map(tuple, token_files.read_documents(spark, folder).collect()), key=lambda r: r[1]) == expected
    empty = scratch_path(spark, "t")
    token_files.write_token_files(nothing, empty, path, 2)
    assert token_files.read_documents(spark, empty).count() == 0


def test_blocks_round_trip():
    rnd = np.random.default_rng(0)
    for ids in ([0], [7] * 9, [0, 2**32 - 1], rnd.integers(0, 50, 5000), np.concatenate((rnd.integers(0, 99, 9000), [2**31, 70000, 2**32 - 1]))):
        ids = np.array(ids, np.uint64).astype("<u4")
        page = token_files.pack_page([len(ids)], ids)
        assert (token_files.read_ids(page, 0, len(ids)) == ids).all()
        assert (token_files.read_ids(page, len(ids) // 2, len(ids)) == ids[len(ids) // 2 :]).all()


def test_merge_codec_is_exact(docs, rows, nothing):
    path = public_tokenizers.path("piece_bpe_32k.model")
    library, own = sentencepiece.SentencePieceProcessor(model_file=path), pieces.codec(path)
    rnd = random.Random(3)
    marks = ["a", " ", "  ", "\n", "é", "中", "👍", "▁", "the", "Ing", "'s", "<s>", "!!", "́", "1", "\0", "aaaa", "ab"]
    for t in ["".join(rnd.choice(marks) for _ in range(rnd.randint(0, 25))) for _ in range(1500)] + ["a" * 700, " " * 200]:
        ids = library.encode(t)
        assert own.encode(t) == ids and own.decode(ids) == library.decode(ids), t
    for ids in ([259, 200, 201, 3], [230, 150, 29871, 5, 1], [0, 29871], [29871, 29871]):
        assert own.decode(ids) == library.decode(ids)
    expected = []
    for i, t in rows:
        ids = [*library.encode(t or ""), 2]
        expected.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()))
    assert collected(pieces.round_trip(docs, path)) == sorted(expected, key=lambda r: [(x is not None, x) for x in r])
    assert pieces.round_trip(nothing, path).count() == 0 and pieces.encode_documents(nothing, path).count() == 0


# ---- 4 --------------------------------------------------------------------------------------------
def test_compact_windows_cover_every_run():
    rnd = np.random.default_rng(1)
    for n in (3, 9, 40, 200):
        values = rnd.integers(0, 12, n).astype(np.uint64)
        l, c, r = passages.compact_windows(values, 5)
        for start in range(n - 4):
            for end in range(start + 4, n):
                low = start + int(values[start : end + 1].argmin())
                inside = [k for a, k, b in zip(l, c, r, strict=True) if a <= start <= k <= end <= b]
                assert inside.count(low) == 1 and all(values[k] == values[low] for k in inside)


def test_repeated_passages(docs, rows, nothing):
    found = defaultdict(set)
    for r in passages.repeated(docs).collect():
        found[r["doc_id"]] |= set(range(r["start_word"], r["start_word"] + r["n_words"]))
    where, own = defaultdict(set), {i: words(t or "") for i, t in rows if i is not None}
    for i, w in own.items():
        for j in range(len(w) - 49):
            where[tuple(w[j : j + 50])].add(i)
    for i, w in own.items():
        wanted = {k for j in range(len(w) - 49) if len(where[tuple(w[j : j + 50])]) > 1 for k in range(j, j + 50)}
        assert wanted <= found[i], i
    assert {i for i, x in found.items() if x} == {20, 21, 22, 30, 31}
    left = passages.keep_first(docs)
    texts = {r["doc_id"]: r["text"] for r in left.collect()}
    assert left.columns == docs.columns and 21 not in texts and len(words(texts[31])) == 80 and texts[30] == dict(rows)[30]
    assert passages.keep_first(nothing).count() == 0


def found_words(spark, rows):
    found = defaultdict(set)
    for r in passages.repeated(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect():
        found[r["doc_id"]] |= set(range(r["start_word"], r["start_word"] + r["n_words"]))
    return found


def near_starts(a, b):
    """Starts of b whose run resembles that at the same place of a, by brute force."""
    tokens = [[tuple(x[k : k + 5]) for k in range(len(x) - 4)] for x in (a, b)]
    runs = [[set(t[k : k + 46]) for k in range(len(t) - 45)] for t in tokens]
    return [k for k, (x, y) in enumerate(zip(*runs, strict=True)) if len(x & y) >= 0.8 * len(x | y)]


def test_edited_passages_are_found(spark):
    """Passages of 50 words with one changed word in the middle, at a similarity of exactly 0.8."""
    rows, n = [], 200
    for i in range(n):
        w = prose(3000 + i, 50).split()
        x = w[:25] + ["changed"] + w[26:]
        assert near_starts(w, x) == [0]
        rows += [(i, prose(4000 + i, 30) + " " + " ".join(w)), (1000 + i, prose(5000 + i, 20) + " " + " ".join(x) + " " + prose(6000 + i, 30))]
    found = found_words(spark, rows)
    assert sum(set(range(25, 65)) <= found[1000 + i] for i in range(n)) >= 0.97 * n


def test_drifting_versions_are_found(spark):
    """B and C differ in a word here and there, the older A, which has most signatures first, in more."""
    rows, wanted = [], {}
    for i in range(40):
        b = prose(7000 + i, 200).split()
        a = [f"old{i}x{k}" if k % 22 == 10 else w for k, w in enumerate(b)]
        c = [f"new{i}x{k}" if k % 90 == 45 else w for k, w in enumerate(b)]
        assert not near_starts(a, b) and not near_starts(a, c)
        rows += [(i, " ".join(a)), (1000 + i, " ".join(b)), (2000 + i, " ".join(c))]
        wanted[2000 + i] = near_starts(b, c)
    found = found_words(spark, rows)
    hits = [set(range(k + 5, k + 45)) <= found[i] for i, x in wanted.items() for k in x]
    assert len(hits) > 2000 and sum(hits) >= 0.97 * len(hits)


# ---- 5 --------------------------------------------------------------------------------------------
def test_quality_base_counts(docs, rows, nothing):
    got = {(r["doc_id"], r["n_words"]): r for r in quality.judge(docs).collect()}
    for i, t in rows:
        w, t = words(t or ""), t or ""
        case = t.split(None) and [x for x in t.replace(" ", "_").replace("\u0085", "_").split()]
        grams = Counter(zip(case, case[1:], case[2:], strict=False))
        twice = {k + d for k in range(len(case) - 2) if grams[tuple(case[k : k + 3])] > 1 for d in range(3)}
        lines = [x for x in t.split("\n") if x.encode().split()]
        r = got[i, len(w)]
        assert r["word_chars"] == len("".join(case)) and r["n_symbols"] == sum(c in "#*$%&|<>" for c in t)
        assert r["n_dup_lines"] == len(lines) - len(set(lines)) and r["n_repeat_words"] == len(twice)
        assert r["base_failed"] == (len(w) < 50 or 100 * len(twice) > 50 * len(w))
    assert quality.judge(nothing).count() == 0 and quality.keep_good(nothing).columns == nothing.columns


def test_quality_distance(spark):
    p, q = [0.5, 0.5, 0.0], [0.1, 0.2, 0.7]
    m = [(a + b) / 2 for a, b in zip(p, q, strict=True)]
    kl = lambda a: sum(x * math.log2(x / y) for x, y in zip(a, m, strict=True) if x)
    row = spark.range(1).select(quality.divergence(F.array(*map(F.lit, p)), F.array(*map(F.lit, q)))).first()[0]
    assert abs(row - math.sqrt((kl(p) + kl(q)) / 2)) < 1e-12
    good = [(i, prose(i, 120), "en") for i in range(60)] + [(90, "THE!!! BUY $$$ NOW### " * 4 + " ".join(f"{i}$$$ %%%{i}" for i in range(80)), "en")]
    kept = {r["doc_id"] for r in quality.keep_good(spark.createDataFrame(good, "doc_id long, text string, lang string")).collect()}
    assert kept == set(range(60))


# ---- 6 --------------------------------------------------------------------------------------------
def test_masks_cover_every_pair():
    for radius in (1, 2, 3):
        family = simhash.masks(radius)
        for bits in itertools.combinations(range(0, 64, 3), radius):
            change = sum(1 << b for b in bits)
            assert any(change & m & (1 << 64) - 1 == 0 for m in family)


def brute_groups(rows):
    fps = []
    for _, t in rows:
        w = words(t or "")
        runs = [b" ".join(w[k : k + 3]) for k in range(max(1, len(w) - 2))] if w else []
        h = [xxhash.xxh64_intdigest(x, seed=42) for x in runs]
        fps.append(sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h)))
    root = list(range(len(rows)))
    for _ in rows:
        for a in range(len(rows)):
            for b in range(len(rows)):
                if (fps[a] ^ fps[b]).bit_count() <= 2:
                    root[a] = root[b] = min(root[a], root[b])
    named = {g: min((rows[k][0] for k in range(len(rows)) if root[k] == g and rows[k][0] is not None), default=None) for g in set(root)}
    return [(rows[k][0], f"{fps[k]:016x}", named[root[k]]) for k in range(len(rows))]


def test_simhash_groups(docs, rows, nothing):
    assert collected(simhash.groups(docs)) == sorted(brute_groups(rows), key=lambda r: [(x is not None, x) for x in r])
    assert simhash.groups(nothing).count() == 0


@pytest.mark.parametrize("small", [1, 64])
def test_links_connect_all_near_fingerprints(spark, monkeypatch, small):
    """Both ways of linking, the pairs of small buckets and the shared neighbours of large ones, against all pairs."""
    monkeypatch.setattr(simhash, "SMALL_BUCKET", small)
    rnd, fps = random.Random(4), set()
    for _ in range(12):
        x = rnd.getrandbits(64)
        for _ in range(25):
            fps.add(x)
            for _ in range(rnd.randint(0, 3)):
                x ^= 1 << rnd.randrange(64)
    fps = sorted(x - (1 << 64) if x >> 63 else x for x in fps)
    got = dict(components(simhash.links(spark.createDataFrame([(x,) for x in fps], "fp long"))).collect())
    root = {x: x for x in fps}
    changed = True
    while changed:
        changed = False
        for a, b in itertools.combinations(fps, 2):
            if ((a ^ b) & (1 << 64) - 1).bit_count() <= 2 and root[a] != root[b]:
                root[a] = root[b] = min(root[a], root[b])
                changed = True
    assert {x: got.get(x, x) for x in fps} == root


def test_keep_one(spark, docs, nothing):
    rnd, rows, near = random.Random(6), [], []
    for g in range(12):
        base = prose(500 + g, 150).split()
        for k in range(4):
            x = list(base)
            for _ in range(k):
                x[rnd.randrange(len(x))] = f"w{rnd.randrange(9999)}"
            rows.append((g * 10 + k, " ".join(x)))
    near = [(a, b) for (a, s), (b, t) in itertools.combinations(rows, 2) if simhash.jaccard(s, t, 5) >= 0.8]
    found = dict(simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    joined = sum(found[a] == found[b] for a, b in near)
    assert near and joined >= 0.97 * len(near) and all(found[i] // 10 == i // 10 for i in found)
    left = simhash.keep_one(docs)
    ids = Counter(r["doc_id"] for r in left.collect())
    assert left.columns == docs.columns and 21 not in ids and ids[None] == 1 and ids[32] == 2 and 20 in ids and 2 not in ids
    assert simhash.keep_one(nothing).count() == 0


@pytest.mark.parametrize("centre", [150, 299])
def test_large_bucket_links_a_star(spark, centre):
    """Copies that resemble one text with a middle or the largest id, but not each other, against all pairs that share a key."""
    rnd, base = random.Random(8), [f"v{i}" for i in range(154)]
    rows = []
    for i in range(300):
        x = list(base)
        for at in rnd.sample(range(5, 149), 3 if i != centre else 0):
            x[at] = f"w{rnd.randrange(10**9)}"
        rows.append((i, " ".join(x)))
    found = dict(simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect())
    keys = {i: set(simhash.sketch(t, 5)[2]) for i, t in rows}
    sets = {i: set(simhash.shingle_hashes(words(t), 5).tolist()) for i, t in rows}
    near = [(a, b) for a, b in itertools.combinations(keys, 2) if keys[a] & keys[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    assert sum(centre in x for x in near) > 280 and len(near) < 1000
    assert all(found[a] == found[b] for a, b in near)


# ---- 7 --------------------------------------------------------------------------------------------
def test_toxicity(spark, docs, nothing):
    rnd, rows, labels = random.Random(7), [], []
    for i in range(400):
        toxic = i % 5 == 0
        w = prose(2000 + i, 40).split()
        for _ in range(rnd.randint(1, 5) if toxic else 0):
            w.insert(rnd.randrange(40), rnd.choice(["Vile,", "nastiest", "nastier."]))
        rows.append((i, " ".join(w), toxic))
        labels.append((i, int(toxic), 9) if i < 300 else (i, None, 9))
    data = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    known = spark.createDataFrame(labels, "doc_id long, toxic int, text int")
    grader = toxicity.fit(data, known)
    assert (np.diff(grader.thresholds) > 0).all()
    got = {r["doc_id"]: r for r in toxicity.grade(data, grader).collect()}
    assert all(got[i]["toxic"] == toxic for i, _, toxic in rows)
    many = np.mean([got[i]["expected_severity"] for i, t, x in rows if x and len(t.split()) >= 44])
    few = np.mean([got[i]["expected_severity"] for i, t, x in rows if x and len(t.split()) == 41])
    assert many > few + 0.5
    assert toxicity.grade(docs, grader).where("toxic").count() == 0
    blank = toxicity.fit(nothing, known.limit(0))
    assert toxicity.grade(docs, blank).where("toxic").count() == 0


# ---- 9 --------------------------------------------------------------------------------------------
def test_language_model(spark, docs, rows, nothing):
    many = [(i, prose(i, 60) if i % 2 else "le la les " + " ".join(f"mot{(i * k) % 97}" for k in range(60))) for i in range(300)]
    data = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(1000 + i, t) for i, t in many], "doc_id long, text string"))
    train = data.where(~lm.held_out())
    model = lm.train(train, head=50)
    everything = rows + [(1000 + i, t) for i, t in many]
    out = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    tokens = {i: [*words(t or ""), b""] for i, t in everything if i is not None}
    counts = Counter(w for i, t in everything if not out(i) for w in [*words(t or ""), b""])
    n, v = sum(counts.values()), len(counts)
    assert (model.tokens, model.types) == (n, v)
    scored = lm.score(data, model).collect()
    assert len(scored) == len(everything)
    gain = 0.0
    for r in scored:
        if r["doc_id"] is not None:
            own = tokens[r["doc_id"]]
            base = sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in own)
            assert r["n_tokens"] == len(own) and r["n_known"] == sum(w in counts for w in own) and abs(r["base_score"] - base) < 1e-6
            gain += (r["score"] - base) * out(r["doc_id"])
    assert gain > 0.02 * sum(len(t) for i, t in tokens.items() if out(i))
    # the classes, and the words of each class with its unknown one, sum to one
    logits = lm.class_logits(model.weights, np.zeros((lm.FEATURES, 1), np.int64))
    assert abs(np.exp(logits - np.log(np.exp(logits).sum())).sum() - 1) < 1e-5
    vocabulary = lm.Vocabulary(model.head)
    share = Counter()
    for w, c in counts.items():
        k = vocabulary[w] >> 32 & 0xFF
        share[k] += 1 if k < lm.SINGLE else (c + 0.5) / model.class_mass[k]
    for k in range(lm.SINGLE, lm.CLASSES):
        assert abs(share[k] + 0.5 / model.class_mass[k] - 1) < 1e-9
    empty = lm.train(nothing)
    assert lm.score(docs, empty).count() == len(rows) and lm.score(nothing, empty).count() == 0


# ---- 10 -------------------------------------------------------------------------------------------
def test_chat_round_trip(spark):
    rnd = random.Random(8)
    marks = ["\\", "### ", "Assistant", ": ", "</turn>", "\n", "x", "%", " ", "é"]
    roles = ["user", "assistant", "system", "Assistant", None, "tool x", "%41"]
    rows = [(c, t, rnd.choice(roles), "".join(rnd.choice(marks) for _ in range(rnd.randint(0, 8)))) for c in range(60) for t in range(rnd.randint(1, 6))]
    rows += [(None, 1, "user", None), (None, None, "assistant", ""), (5, 0, "user", "tie"), (5, 0, "user", "tie")]
    data = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, formatted int")
    by_conv = defaultdict(list)
    for c, t, r, x in rows:
        by_conv[c].append(((t is not None, t or 0), r or "", x or ""))
    for r in chat.read_back(chat.format_turns(data)).collect():
        turns = sorted(by_conv.pop(r["conv_id"]))
        target = "".join(x for _, role, x in turns if role == "assistant")
        assert r["n_turns"] == len(turns) and r["loss_chars"] == len(target)
        assert r["turns_sha256"] == hashlib.sha256("".join(f"{role}\n{x}\n" for _, role, x in turns).encode()).hexdigest()
        assert r["loss_sha256"] == hashlib.sha256(target.encode()).hexdigest()
        whole = "".join(chat.render(role, x)[0] for _, role, x in turns)
        assert r["formatted_chars"] == len(whole) and [y[:2] for y in chat.parse(whole)] == [(role, x) for _, role, x in turns]
    assert not by_conv
    assert chat.read_back(chat.format_turns(data.limit(0))).count() == 0


# ---- pipeline -------------------------------------------------------------------------------------
def test_pipeline(spark, tmp_path):
    clean = [(i, prose(3000 + i, 130)) for i in range(40)]
    item = prose(4000, 25)
    near = clean[1][1].split()
    near[60] = "edited"
    passage = " ".join(clean[2][1].split()[20:90])
    added = [(100, clean[0][1]), (101, " ".join(near)), (102, "too short"), (103, None)]
    added += [(104, prose(5000, 80) + " " + passage), (105, prose(5001, 60) + " " + item + " " + prose(5002, 60))]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in clean + added]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert set(got) == set(range(40)) | {104}
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    for i, t in clean:
        assert got[i]["decoded"] == t and got[i]["ids"] == [*library.encode(t), 2]
    assert got[104]["decoded"].strip() == prose(5000, 80)
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_rules", "simhash_dedup", "substring_dedup", "decontamination", "encoding"]


def test_array_steps_of_passages():
    values = np.array([5, 9, 3, 3, 8, 3, 7], np.uint64)
    l, c, r = passages.compact_windows(values, 3)
    assert all(r - l + 1 >= 3)
    rng = np.random.default_rng(4)
    lo = rng.integers(0, 60, 40)
    hi, of = lo + rng.integers(0, 20, 40), rng.integers(0, 3, 40)
    got = {(int(d), i) for d, a, b in zip(*passages.covered_starts(of, lo, hi, 2), strict=True) for i in range(a, b + 1)}
    assert got == {(d, i) for d in range(3) for i in range(100) if ((of == d) & (lo <= i) & (i <= hi)).sum() >= 2}
    order, begin, end = passages.joined_ranges((of,), lo, hi + 1)
    got = {(int(of[order[k]]), i) for k, e in zip(begin, end, strict=True) for i in range(lo[order[k]], e)}
    assert got == {(int(d), i) for d, a, b in zip(of, lo, hi, strict=True) for i in range(a, b + 1)}
    own = rng.integers(1, 1 << 32, 300, dtype=np.uint32)
    other = np.concatenate((own[250:], own[20:120], rng.integers(1, 1 << 32, 50, dtype=np.uint32)))
    place, first, last, a, b = passages.near_ranges(own, other, np.array([[0], [200], [30], [0], [0], [len(other)]]))
    assert list(place) == [0] and (a[0], b[0]) == (20, 119 + passages.SIZE)
    assert first[0] < 20 and last[0] > 120 - passages.WIDTH


def test_feature_sums_and_shares_agree_with_plain_sums():
    from auditloom.llm import lm

    chance = np.random.default_rng(4)
    rows = np.minimum(chance.zipf(1.4, (lm.FEATURES, 700)), lm.BUCKETS - 1).astype(np.int64) + (np.arange(lm.FEATURES) * lm.BUCKETS)[:, None]
    p = chance.normal(size=(700, 5)).astype(np.float32)
    ids, sums = lm.feature_sums(p, rows)
    wanted = np.zeros((lm.ROWS, 5))
    np.add.at(wanted, rows.ravel(), np.tile(p, (lm.FEATURES, 1)).astype(np.float64))
    assert sorted(ids) == sorted(set(rows.ravel().tolist()))
    assert np.allclose(sums, wanted[ids], atol=1e-4)
    weights = chance.normal(size=(lm.ROWS, lm.CLASSES)).astype(np.float32)
    for scale in (1, 400):  # the larger weights would overflow without the largest logit of each token
        logits, shares, totals = lm.class_shares(weights * np.float32(scale), rows)
        plain = lm.class_logits(weights * np.float32(scale), rows).astype(np.float64)
        wanted = np.exp(plain) / np.exp(plain).sum(axis=1, keepdims=True)
        assert np.allclose(shares / totals, wanted, atol=1e-4)
