"""Alignment over blocks of the library: all pairs, and no row that holds the steps of both sides."""

import random

import pyarrow as pa
import pytest
from test_text_and_alignment import lcs_length

from auditloom.operators import interpret


def test_blocks_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(interpret, "LIBRARY_STEPS", 12)
    rng = random.Random(8)
    draw = lambda: [rng.choice("ABCDEFGH") for _ in range(rng.randrange(0, 9))]
    seqs, libs = {f"s{i}": draw() for i in range(20)}, {i: draw() for i in range(15)}
    seqs["copy"], seqs["glued"], seqs["apart"], libs[99] = seqs["s3"], ["A B"], ["A", "B"], ["A", "B"]
    s = spark.createDataFrame(list(seqs.items()), "owner string, steps array<string>")
    lib = spark.createDataFrame(list(libs.items()), "seq_id int, steps array<string>")
    lengths = {(a, b): lcs_length(tuple(x), tuple(y)) for a, x in seqs.items() for b, y in libs.items()}

    got = {r.owner: r for r in interpret.best_alignment(s, lib).collect()}
    assert set(got) == set(seqs)
    for owner in seqs:
        found = [(-lengths[owner, b], b) for b in libs if lengths[owner, b]]
        want = min(found) if found else (0, None)
        assert (got[owner].length, got[owner].lib_id) == (-want[0], want[1])
        assert sum(got[owner].mask or []) == got[owner].length

    keys = s.select("owner", interpret.sequence_key().alias("seq_key"))
    pairs = interpret.aligned(s, lib)
    assert not {"steps", "lib"} & set(pairs.columns)
    assert {(r.owner, r.seq_id): r.length for r in pairs.join(keys, "seq_key").collect()} == {k: n for k, n in lengths.items() if n}


@pytest.mark.parametrize(("longest", "words", "marks"), [(60, 1 << 14, 1 << 22), (400, 8, 1 << 22), (400, 64, 40)])
def test_many_sequences_are_aligned_at_once(longest, words, marks, monkeypatch):
    monkeypatch.setattr(interpret, "WORDS", words)
    monkeypatch.setattr(interpret, "MARKS", marks)
    calls, one = [], interpret._lcs_lengths
    monkeypatch.setattr(interpret, "_lcs_lengths", lambda steps, marks: calls.append(1) or one(steps, marks))
    rng = random.Random(longest + words)
    draw = lambda most, kinds: [f"T{rng.randrange(kinds)}" for _ in range(rng.randrange(1, most))]
    libs = [draw(80, 12) for _ in range(12)] + [["only"]]
    seqs = [draw(longest, 14) for _ in range(90)] + [["none"], libs[3], ["T1"] * 64, ["T1"] * 65, ["T2", "T1"] * 64]
    kind = [("seq_key", pa.string()), ("seq_id", pa.int32()), ("lib_key", pa.string()), ("steps", pa.list_(pa.string()))]
    table = lambda rows: pa.RecordBatch.from_pylist(rows, pa.schema(kind))
    entries = interpret._Entries([table([{"seq_id": i, "lib_key": f"l{i}", "steps": x}]) for i, x in reversed(list(enumerate(libs)))])
    batch = table([{"seq_key": f"s{i}", "steps": x} for i, x in enumerate(seqs)])
    want = {(f"s{i}", j): interpret._lcs_length(x, interpret._places(y), len(y)) for i, x in enumerate(seqs) for j, y in enumerate(libs)}
    found = [r for b in interpret._all_lengths(list(interpret.PAIR))(entries, batch) for r in b.to_pylist()]
    assert {(r["seq_key"], r["seq_id"]): r["length"] for r in found} == {k: n for k, n in want.items() if n}
    assert {(r["seq_key"], r["seq_len"]) for r in found} == {(f"s{i}", len(x)) for i, x in enumerate(seqs) if "none" not in x}
    assert {(r["seq_id"], r["lib_len"]) for r in found} == {(i, len(x)) for i, x in enumerate(libs) if "only" not in x}
    if words == 1 << 14:
        assert len(calls) < len(seqs) * len(libs) / 10
    best = {r["seq_key"]: (-r["length"], r["seq_id"], r["lib_key"]) for b in interpret._best_entry(entries, batch) for r in b.to_pylist()}
    assert best == {f"s{i}": min((-want[f"s{i}", j], j, f"l{j}") for j in range(len(libs))) for i, x in enumerate(seqs) if "none" not in x}
