"""Behaviour texts, technique matching, sequence alignment and alert filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from auditloom.functions import fixed_values as V
from auditloom.functions import text as T
from auditloom.operators.ranking import salted_join, top_per_group
from auditloom.operators.similarity import block_count, first_copies, normalised, packed, top_products, top_similar
from auditloom.session import cut, stored

UNKNOWN = "UNKNOWN"


# ---- behaviour texts ------------------------------------------------------------------------------
def _joined_in_order(rows: DataFrame, by: list[str], sentence: str, order: str, limit: int | None, out: str) -> DataFrame:
    """Distinct sentences per group in order of first appearance, joined by '. '."""
    first = rows.groupBy(*by, sentence).agg(F.min(order).alias("_o"))
    if limit is not None:
        first = top_per_group(first, by, [F.col("_o"), F.col(sentence)], limit, "_r").drop("_r")
    packed = first.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("_o", sentence))).alias("_s"))
    return packed.select(*by, F.array_join(F.transform("_s", lambda s: s[sentence]), ". ").alias(out))


def snapshot_text(nodes: DataFrame, only_malicious: bool = True, max_nodes: int = 200) -> DataFrame:
    """Literal snapshot text: events listed in the properties of the most frequent process nodes.

    Properties without event items give no sentence, so such snapshots are missing from the result.
    """
    kept = nodes.filter("label = 1") if only_malicious else nodes
    top = top_per_group(kept, ["snapshot_id"], [F.desc("frequency"), F.col("name")], max_nodes)
    procs = top.filter(F.col("type") == V.PROCESS_TYPE)
    name = T.quoted_name(F.concat(F.lit("{"), F.array_join("properties", ", "), F.lit("}")))
    subject = F.when(name != "", T.process_role(name)).otherwise("process")
    items = F.flatten(F.transform("properties", lambda p: F.split(p, ",")))
    rows = procs.select("snapshot_id", "rank", subject.alias("_subject"), F.posexplode(items).alias("_i", "_item"))
    phrase = T.event_phrase(F.btrim(F.col("_item"), F.lit(" '\"")))
    said = rows.withColumn("_p", phrase).filter((F.col("_p") != "") & ~T.low_information(F.col("_p")))
    said = said.withColumn("sentence", F.concat_ws(" ", "_subject", "_p")).withColumn("_order", F.struct("rank", "_i"))
    return _joined_in_order(said, ["snapshot_id"], "sentence", "_order", None, "text")


def event_sides(events: DataFrame, entities: DataFrame, wanted: DataFrame) -> DataFrame:
    """Events of the wanted entities, once per role: ``entity, role, ts_us, ...`` with both property texts."""
    ends = F.array(
        F.struct(F.col("actor_id").alias("entity"), F.lit(0).alias("role")),
        F.struct(F.col("object_id").alias("entity"), F.lit(1).alias("role")),
    )
    rows = events.select("*", F.inline(ends)).join(wanted.select("entity").distinct(), "entity", "left_semi")
    # one row per distinct sentence source: repeated events are folded before the property joins
    folded = rows.groupBy("entity", "role", "actor_id", "actor_type", "object_id", "object_type", "action").agg(
        F.min(F.struct("ts_us", "event_id")).alias("_first")
    )
    folded = stored(folded, "folded-sides")  # read by the two joins and the counts of their keys
    for end in ("actor", "object"):
        side = entities.select(F.col("name").alias(f"{end}_id"), F.col("props").alias(f"{end}_prop"))
        folded = salted_join(folded, side, [f"{end}_id"], "left")
        folded = folded.withColumn(f"{end}_prop", F.coalesce(f"{end}_prop", F.lit("")))
    return folded


def raw_queries(sides: DataFrame, limit: int = 30) -> DataFrame:
    """Untranslated entity text, first ``limit`` distinct sentences (the limit is the feature)."""
    as_actor = F.concat_ws(" ", "actor_type", "action", "object_type", "object_prop")
    as_object = F.concat_ws(" ", "actor_type", "actor_prop", "action", "object_type", "object_prop")
    said = sides.withColumn("sentence", F.trim(F.when(F.col("role") == 0, as_actor).otherwise(as_object)))
    said = said.withColumn("_order", F.struct("role", "_first"))
    return _joined_in_order(said, ["entity"], "sentence", "_order", limit, "raw_query")


def subject_of(node_type: Column, name: Column, role: Column) -> Column:
    # a name without a role is just a process, unless its spelling changed on the way
    words = F.when((name == "") | (role == name), "process").otherwise(role)
    return F.when(node_type == V.PROCESS_TYPE, words).otherwise(T.type_noun(node_type))


def object_words(node_type: Column, prop: Column, action: Column) -> Column:
    noun = T.lookup(V.TYPE_NOUNS, node_type)
    kind = T.file_kind(prop)
    in_file = F.when(prop.contains("/proc/"), "process information").otherwise(F.when(kind != "", kind).otherwise("file"))
    mapped = F.when(node_type.contains("FILE") & (prop != ""), in_file).otherwise(noun)
    return (
        F.when(action.isin("EVENT_EXECUTE", "EVENT_LOADLIBRARY"), "executable")
        .when(noun.isNotNull(), mapped)
        .when(node_type == "MemoryObject", "process memory")
        .otherwise(node_type)
    )


def translated_queries(sides: DataFrame, limit: int = 30) -> DataFrame:
    """Translated entity text: role, verb, kind; verbs of low information are left out."""
    verb = F.coalesce(T.event_verb(F.col("action")), F.col("action"))
    said = sides.filter(~T.low_information(verb)).withColumn("_verb", verb)
    # columns of their own, so that no row works out a name or role more than once
    said = said.withColumn("_name", T.process_name(F.col("actor_prop"))).withColumn("_role", T.process_role(F.col("_name")))
    subject = subject_of(F.col("actor_type"), F.col("_name"), F.col("_role"))
    target = object_words(F.col("object_type"), F.col("object_prop"), F.col("action"))
    target = F.when(~F.col("_verb").contains(" "), target)
    said = said.withColumn("sentence", F.trim(F.concat_ws(" ", subject, "_verb", target)))
    said = said.withColumn("_order", F.struct("role", "_first"))
    return _joined_in_order(said, ["entity"], "sentence", "_order", limit, "query")


def operational_triples(triples: DataFrame) -> DataFrame:
    """Intent triples ``tech_id, subject, verb, object`` -> distinct ``tech_id, sentence`` of operations.

    Triples whose verb is not covered are dropped.
    """
    ops = T.intent_operations(F.col("verb"))
    rows = triples.withColumn("_op", F.explode(ops))
    sentence = F.concat_ws(" ", T.intent_subject(F.col("subject")), F.col("_op"), T.intent_object(F.col("object")))
    return rows.select("tech_id", sentence.alias("sentence")).distinct()


# ---- matching -------------------------------------------------------------------------------------
def hybrid(queries: DataFrame, main: DataFrame, aux: DataFrame, aux_queries: DataFrame, weight: float, k: int) -> DataFrame:
    """Top ``k`` per query by (1 - weight) * main + weight * aux cosine: ``a, b, sim, rank``.

    The mixture is one inner product of vectors that hold both parts side by side, so it is searched like a single
    library. A technique missing in one library counts as 0 there.
    """

    def both(first: DataFrame, second: DataFrame, shares: tuple[float, float]) -> DataFrame:
        parts = [
            normalised(v).select("id", F.concat(F.lit(f"{name}:"), "feature").alias("feature"), (F.col("weight") * share).alias("weight"))
            for name, v, share in zip(("main", "aux"), (first, second), shares, strict=True)
        ]
        return parts[0].unionByName(parts[1])

    library = stored(first_copies(packed(both(main, aux, (1.0, 1.0)), unit=False), k), "library")
    blocks = block_count(library)
    if blocks is None:
        return top_similar(both(queries, aux_queries, (1 - weight, weight)), both(main, aux, (1.0, 1.0)), k, unit=False)
    # only entries that a library knows are put side by side
    sides = []
    for name, v, share in (("main", queries, 1 - weight), ("aux", aux_queries, weight)):
        known = library.select(F.explode("v.feature").alias("_f")).filter(F.col("_f").startswith(f"{name}:"))
        known = known.select(F.substring("_f", len(name) + 2, 1 << 30).alias("feature"))
        mixed = F.transform("v", lambda e: F.struct(F.concat(F.lit(f"{name}:"), e["feature"]).alias("feature"), (e["weight"] * share).alias("weight")))  # noqa: B023
        sides.append(packed(v, True, known).select("id", mixed.alias(name)))
    # one row of a query from each side meets, instead of gathering its lists
    none = F.array().cast(sides[0].schema["main"].dataType)
    rows = sides[0].join(sides[1], "id", "full").select("id", F.concat(F.coalesce("main", none), F.coalesce("aux", none)).alias("v"))
    return top_products(rows, library, k, blocks)


def best_codes(queries: DataFrame, scores: DataFrame, threshold: float) -> DataFrame:
    """Best technique per query at or above the threshold, else UNKNOWN (also for empty queries)."""
    best = scores.groupBy("a").agg(F.min_by("b", F.struct(-F.round("sim", 9), F.col("b"))).alias("_b"), F.max("sim").alias("_s"))
    joined = queries.select(F.col("id").alias("a")).join(best, "a", "left")
    known = F.col("_s") >= threshold
    return joined.select(
        F.col("a").alias("id"), F.coalesce(F.when(known, F.col("_b")), F.lit(UNKNOWN)).alias("code"),
        F.coalesce(F.when(known, F.col("_s")), F.lit(0.0)).alias("score"),
    )


def hit_at_k(truth: DataFrame, top: DataFrame, confidence: DataFrame, k: int = 10, gamma: float = 0.40) -> DataFrame:
    """Status per entity: unmapped below the confidence, correct when a parent in the top k fits.

    ``truth(id, technique)``, ``top(a, b, sim, rank)``, ``confidence(id, confidence)``.
    """
    gold = truth.select("id", T.parent_technique(F.col("technique")).alias("gt"))
    near = top.filter(F.col("rank") <= k).select(F.col("a").alias("id"), T.parent_technique(F.col("b")).alias("_p"), "rank")
    hits = near.join(gold, "id").groupBy("id").agg(
        F.min(F.when(F.col("_p") == F.col("gt"), F.col("rank"))).alias("match_rank"), F.count(F.lit(1)).alias("_n")
    )
    joined = gold.join(hits, "id", "left").join(confidence, "id", "left")
    sure = (F.coalesce("confidence", F.lit(0.0)) >= gamma) & F.col("_n").isNotNull()
    status = F.when(~sure, "unmapped").when(F.col("match_rank").isNotNull(), "correct").otherwise("incorrect")
    rank = F.when(sure, F.coalesce("match_rank", F.lit(-1))).otherwise(F.lit(-1))
    return joined.select("id", "gt", status.alias("status"), rank.alias("match_rank"))


def score_gap(top: DataFrame) -> DataFrame:
    """Gap between the first and second score of each query."""
    two = top.filter("rank <= 2").groupBy("a").agg(
        F.max(F.when(F.col("rank") == 1, F.col("sim"))).alias("first"), F.max(F.when(F.col("rank") == 2, F.col("sim"))).alias("second")
    )
    return two.withColumn("gap", F.col("first") - F.coalesce("second", F.lit(0.0)))


# ---- sequence alignment -----------------------------------------------------------------------------
def _places(b) -> dict:
    """The positions of every item of ``b`` as bits."""
    places: dict = {}
    for i, item in enumerate(b):
        places[item] = places.get(item, 0) | (1 << i)
    return places


def _lcs(a: list, b: list) -> tuple[int, list[bool]]:
    """Longest common subsequence: its length and which positions of ``a`` belong to it.

    Of every row of the table only one bit per position of ``b`` is kept, that tells where the length grows, so two sequences
    of 10,000 steps need 12 MB. Of equally long choices the one that matches late in ``a`` is taken.
    """
    mask = [False] * len(a)
    places, full = _places(b), (1 << len(b)) - 1
    rows = [full]
    for item in a:
        row = rows[-1]
        hit = row & places.get(item, 0)
        rows.append(((row + hit) | (row - hit)) & full)
    grown = lambda row, size: size - (row & ((1 << size) - 1)).bit_count()
    left, right = len(a), len(b)
    while left and right:
        if a[left - 1] == b[right - 1]:
            left, right = left - 1, right - 1
            mask[left] = True
        elif grown(rows[left - 1], right) >= grown(rows[left], right - 1):
            left -= 1
        else:
            right -= 1
    return grown(rows[-1], len(b)), mask


def _lcs_length(a: list, places: dict, size: int) -> int:
    """Length only, for one pair, with one machine-integer step per item of ``a``: the bits of ``row`` that turned zero
    mark the ends of matched prefixes of the other sequence, whose item positions are in ``places``."""
    full = (1 << size) - 1
    row = full
    for item in a:
        hit = row & places.get(item, 0)
        row = ((row + hit) | (row - hit)) & full
    return size - row.bit_count()


def _tasks(df: DataFrame) -> int:
    """Enough tasks for a step that costs processor time rather than bytes."""
    conf = df.sparkSession.conf.get("spark.sql.shuffle.partitions")
    return max(int(conf), df.sparkSession.sparkContext.defaultParallelism)


def _clean_steps(steps: str) -> Column:
    return F.filter(F.transform(steps, lambda s: F.upper(F.trim(s))), lambda s: s != "")


def sequence_key(steps: str = "steps") -> Column:
    """Digest of the cleaned steps; equal sequences have the same."""
    return F.md5(F.to_json(_clean_steps(steps)))


LIBRARY_STEPS = 1 << 22  # steps of the library entries that a task holds at once, as numbers
WORDS = 1 << 14  # sequences of up to 64 steps that are aligned with an entry at a time; of longer ones up to 4 times as many words
MARKS = 1 << 22  # words that tell where these have each step of the library


def _library_blocks(library: DataFrame) -> tuple[DataFrame, Column]:
    """(``seq_id, lib_key, steps, _lb`` of the library entries, the number of blocks ``_lb``)."""
    libs = library.select("seq_id", sequence_key("steps").alias("lib_key"), _clean_steps("steps").alias("steps"))
    libs = stored(libs.filter((F.size("steps") > 0) & F.col("seq_id").isNotNull()).distinct(), "library")
    total = F.coalesce(libs.agg(F.sum(F.size("steps"))).scalar(), F.lit(0))
    blocks = F.greatest(F.ceil(total / LIBRARY_STEPS), F.lit(1)).cast("int")
    return libs.withColumn("_lb", F.pmod(F.xxhash64("lib_key", "seq_id"), blocks).cast("int")), blocks


def _met(sequences: DataFrame, library: DataFrame, align, schema: str) -> DataFrame:
    """``align`` over cells, each a part of the sequences and a block of the library.

    The block is repeated for every part and leads the sequences of its cell through a task, so no pair carries the steps of both
    sides. ``sequences`` has ``seq_key, steps, _lb`` and the columns of a chosen entry or nulls there.
    """
    n = _tasks(sequences)
    part = F.pmod(F.xxhash64("seq_key"), F.lit(n)).cast("int")
    rows = sequences.select("_lb", part.alias("_sb"), F.lit(1).alias("_side"), "seq_key", "seq_id", "lib_key", "steps")
    parts = F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("_sb")
    heads = library.select("_lb", parts, F.lit(0).alias("_side"), F.lit(None).cast("string").alias("seq_key"), "seq_id", "lib_key", "steps")
    placed = rows.unionByName(heads).repartitionById(n, F.col("_sb")).sortWithinPartitions("_lb", "_side")
    return placed.mapInArrow(_in_cells(align), schema)


def _in_cells(align):
    """Arrow function that gathers the library of a cell and gives the batches of ``align(entries, sequences)``."""

    def run(batches):
        import numpy as np

        cell, heads, entries = None, [], None
        for batch in batches:
            marks = np.asarray(batch.column(0)).astype(np.int64) * 2 + np.asarray(batch.column(2))
            cuts = [0, *(np.flatnonzero(np.diff(marks)) + 1), len(marks)]
            for low, high in zip(cuts[:-1], cuts[1:], strict=True):
                if low == high:
                    continue
                if cell != marks[low] // 2:
                    cell, heads, entries = marks[low] // 2, [], None
                if marks[low] % 2 == 0:
                    heads.append(batch.slice(low, high - low))
                elif heads:
                    entries = entries or _Entries(heads)
                    yield from align(entries, batch.slice(low, high - low))

    return run


class _Entries:
    """The library entries of a block in order of their id, with steps as numbers."""

    def __init__(self, heads: list):
        import numpy as np
        import pyarrow as pa

        table = pa.Table.from_batches(heads).select(["seq_id", "lib_key", "steps"])
        table = table.sort_by([("seq_id", "ascending"), ("lib_key", "ascending")]).combine_chunks()
        self.ids, self.keys, steps = (table[c].combine_chunks() for c in ("seq_id", "lib_key", "steps"))
        self.names, self.codes, self.at = _coded(steps, None)
        self.sizes = np.diff(self.at)

    def chunks(self, batch):
        """``(places, sizes, marks, steps)`` of sequences with a step in the library, as many at a time as ``WORDS`` allows.

        ``places`` are their rows in the batch, ``sizes`` their known steps, ``marks[c]`` the bits where they have the step ``c``
        and ``steps`` the numbers ``c`` of all entries one after another, -1 for steps that none of them has.
        """
        import numpy as np

        _, codes, at = _coded(batch.column("steps"), self.names)
        owner = np.repeat(np.arange(len(batch)), np.diff(at))[codes >= 0]
        codes = codes[codes >= 0]
        sizes = np.bincount(owner, minlength=len(batch))
        start = np.cumsum(sizes) - sizes
        order = np.argsort(sizes, kind="stable")
        order = order[sizes[order] > 0]
        low = 0
        while low < len(order):
            # of equally many words; the longest of a chunk is its last one
            words = -(-int(sizes[order[low]]) // 64)
            high = int(np.searchsorted(sizes[order], words * 64, side="right"))
            high = min(high, low + max(1, WORDS * min(words, 4) // words), low + max(1, MARKS // (words * min(len(self.names), words * 64))))
            rows = order[low:high]
            size = sizes[rows]
            which = np.repeat(np.arange(len(rows)), size)
            inside = np.arange(len(which)) - np.repeat(np.cumsum(size) - size, size)
            own = codes[np.repeat(start[rows], size) + inside]
            met, code = np.unique(own, return_inverse=True)
            if len(met) * len(rows) * words > 2 * MARKS and len(rows) > 1:
                high = low + max(1, len(rows) * MARKS // (len(met) * len(rows) * words))
                rows, size = order[low:high], sizes[order[low:high]]
                keep = which < len(rows)
                which, inside = which[keep], inside[keep]
                met, code = np.unique(own[keep], return_inverse=True)
            marks = np.zeros((len(met), words, len(rows)), np.uint64)
            np.bitwise_or.at(marks, (code, inside // 64, which), np.uint64(1) << (inside % 64).astype(np.uint64))
            number = np.full(len(self.names) + 1, -1, np.int64)
            number[met] = np.arange(len(met))
            yield rows, size, marks, number[self.codes]
            low = high

    def known(self, steps, i: int) -> list:
        """Those steps of an entry that some sequence of the chunk has."""
        own = steps[self.at[i] : self.at[i + 1]]
        return own[own >= 0].tolist()


def _coded(steps, names):
    """(names, number of every step in them or -1, where the steps of each row begin and those of the last end)."""
    import numpy as np
    import pyarrow.compute as pc

    at = np.concatenate(([0], np.cumsum(np.asarray(pc.fill_null(pc.list_value_length(steps), 0)))))
    flat = steps.flatten()
    names = pc.unique(flat) if names is None else names
    return names, np.asarray(pc.fill_null(pc.index_in(flat, value_set=names), -1)).astype(np.int64), at


def _lcs_lengths(steps: list, marks):
    """Lengths of the longest common subsequences of an entry and all sequences behind ``marks``.

    The bits of a row that turned zero mark the ends of matched prefixes of the entry; each step of it costs a few operations on
    machine words, which hold 64 steps of a sequence, and carries go on from word to word.
    """
    import numpy as np

    words, n = marks.shape[1:]
    row = np.full((words, n), ~np.uint64(0))
    hit, total = np.empty_like(row), np.empty_like(row)
    if words == 1:
        row, hit, total, marks = row[0], hit[0], total[0], marks[:, 0]
        for c in steps:
            np.bitwise_and(row, marks[c], out=hit)
            np.add(row, hit, out=total)
            np.bitwise_xor(row, hit, out=row)
            np.bitwise_or(row, total, out=row)
        return 64 - np.bitwise_count(row).astype(np.int32)
    for c in steps:
        np.bitwise_and(row, marks[c], out=hit)
        np.add(row, hit, out=total)
        over = total[:-1] < hit[:-1]
        for w in range(1, words):
            carry = over[w - 1]
            np.add(total[w], carry, out=total[w])
            if w < words - 1:
                over[w] |= carry & (total[w] == 0)
        np.bitwise_xor(row, hit, out=row)
        np.bitwise_or(row, total, out=row)
    return 64 * words - np.bitwise_count(row).sum(axis=0, dtype=np.int32)


def _all_lengths(names: list[str]):
    """The columns ``names`` for all entries that share a step with a sequence."""

    def align(entries: _Entries, batch):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        whole = np.asarray(pc.list_value_length(batch.column("steps")))
        for rows, _, marks, steps in entries.chunks(batch):
            step = max(1, (1 << 16) // len(rows))
            for low in range(0, len(entries.ids), step):
                found = np.array([_lcs_lengths(entries.known(steps, i), marks) for i in range(low, min(low + step, len(entries.ids)))])
                entry, place = np.nonzero(found)
                if len(entry):
                    columns = {
                        "seq_key": lambda: batch.column("seq_key").take(pa.array(rows[place])), "seq_id": lambda: entries.ids.take(pa.array(entry + low)),  # noqa: B023
                        "lib_len": lambda: pa.array(entries.sizes[entry + low], pa.int32()), "seq_len": lambda: pa.array(whole[rows[place]], pa.int32()),  # noqa: B023
                        "length": lambda: pa.array(found[entry, place], pa.int32()),  # noqa: B023
                    }
                    yield pa.RecordBatch.from_arrays([columns[c]() for c in names], names=names)

    return align


def _best_entry(entries: _Entries, batch):
    """The longest alignment of a block, by the smallest id."""
    import numpy as np
    import pyarrow as pa

    for rows, sizes, marks, steps in entries.chunks(batch):
        length, best = np.zeros(len(rows), np.int32), np.zeros(len(rows), np.int64)
        open_, own = np.arange(len(rows)), marks
        for i in range(len(entries.ids)):
            known = entries.known(steps, i)
            # a later entry has to be longer; who is matched whole needs no more
            if not len(open_) or len(known) <= length[open_].min():
                continue
            found = _lcs_lengths(known, own)
            longer = np.flatnonzero(found > length[open_])
            length[open_[longer]], best[open_[longer]] = found[longer], i
            left = length[open_] < sizes[open_]
            if left.sum() <= len(open_) * 3 // 4:
                open_, own = open_[left], np.ascontiguousarray(own[:, :, left])
        some = np.flatnonzero(length)
        taken = pa.array(best[some])
        columns = [batch.column("seq_key").take(pa.array(rows[some])), entries.ids.take(taken), entries.keys.take(taken)]
        columns += [pa.array(x, pa.int32()) for x in (entries.sizes[best[some]], length[some])]
        yield pa.RecordBatch.from_arrays(columns, names=["seq_key", "seq_id", "lib_key", "lib_len", "length"])


def _chosen_mask(entries: _Entries, batch):
    """Which steps of a sequence belong to its alignment with the chosen entry."""
    import pyarrow as pa

    if not hasattr(entries, "where"):
        entries.where = {x: i for i, x in enumerate(zip(entries.ids.to_pylist(), entries.keys.to_pylist(), strict=True))}
    _, codes, at = _coded(batch.column("steps"), entries.names)
    masks = []
    for k, chosen in enumerate(zip(batch.column("seq_id").to_pylist(), batch.column("lib_key").to_pylist(), strict=True)):
        i = entries.where[chosen]
        masks.append(_lcs(codes[at[k] : at[k + 1]].tolist(), entries.codes[entries.at[i] : entries.at[i + 1]].tolist())[1])
    yield pa.RecordBatch.from_arrays([batch.column("seq_key"), pa.array(masks, pa.list_(pa.bool_()))], names=["seq_key", "mask"])


def _distinct_sequences(sequences: DataFrame) -> DataFrame:
    rows = sequences.select(sequence_key("steps").alias("seq_key"), _clean_steps("steps").alias("steps")).filter(F.size("steps") > 0)
    return stored(rows.groupBy("seq_key").agg(F.first("steps").alias("steps")), "sequences")


def _for_every_block(distinct: DataFrame, libs: DataFrame, blocks: Column) -> DataFrame:
    none = {c: F.lit(None).cast(libs.schema[c].dataType) for c in ("seq_id", "lib_key")}
    return distinct.withColumn("_lb", F.explode(F.sequence(F.lit(0), blocks - 1))).withColumns(none)


PAIR = ("seq_key", "seq_id", "lib_len", "seq_len", "length")


def aligned(sequences: DataFrame, library: DataFrame, columns: tuple[str, ...] = PAIR) -> DataFrame:
    """LCS length of every (sequence, library entry) that share a step: ``seq_key, seq_id, lib_len, seq_len, length``.

    Equal sequences are aligned once, under their ``sequence_key``; pairs without a common step have length 0 and are left out.
    Every pair is a row; ``columns`` are those wanted of it.
    """
    libs, blocks = _library_blocks(library)
    kinds = {"seq_key": "string", "seq_id": libs.schema["seq_id"].dataType.simpleString()}
    rows = _for_every_block(_distinct_sequences(sequences), libs, blocks)
    return _met(rows, libs, _all_lengths(list(columns)), ", ".join(f"{c} {kinds.get(c, 'int')}" for c in columns))


def best_alignment(sequences: DataFrame, library: DataFrame) -> DataFrame:
    """Longest alignment per sequence; ties go to the smallest library id: ``lib_id, length, lib_len, mask``.

    The mask of matched positions is worked out for the best pair only.
    """
    libs, blocks = _library_blocks(library)
    kind = libs.schema["seq_id"].dataType.simpleString()
    sequences = stored(sequences, "owners")  # read for the distinct sequences and for the result
    distinct = _distinct_sequences(sequences)
    lengths = f"seq_key string, seq_id {kind}, lib_key string, lib_len int, length int"
    found = _met(_for_every_block(distinct, libs, blocks), libs, _best_entry, lengths)
    order = F.struct(-F.col("length"), F.col("seq_id"), F.col("lib_key"))
    best = found.groupBy("seq_key").agg(F.min_by(F.struct("seq_id", "lib_key", "lib_len", "length"), order).alias("_b"))
    best = stored(best.select("seq_key", "_b.*"), "best")
    block = F.pmod(F.xxhash64("lib_key", "seq_id"), blocks).cast("int").alias("_lb")
    chosen = distinct.join(best, "seq_key").select("seq_key", "seq_id", "lib_key", "steps", block)
    masks = _met(chosen, libs, _chosen_mask, "seq_key string, mask array<boolean>")
    joined = sequences.withColumn("seq_key", sequence_key("steps")).join(stored(best.join(masks, "seq_key"), "alignments"), "seq_key", "left")
    return joined.select(
        *sequences.columns, F.col("seq_id").alias("lib_id"), F.coalesce("length", F.lit(0)).alias("length"),
        F.coalesce("lib_len", F.lit(0)).alias("lib_len"), "mask",
    )


def technique_sequences(alerts: DataFrame, by: list[str], limit_hint: str = "snapshot_id") -> DataFrame:
    """Positive snapshots in order as arrays ``steps`` and ``snapshots``; group by a bounded span such as
    (host, day), so that an array holds at most the windows of one span."""
    packed = alerts.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct(limit_hint, "code"))).alias("_s"))
    return packed.select(
        *by, F.transform("_s", lambda s: s["code"]).alias("steps"), F.transform("_s", lambda s: s[limit_hint]).alias("snapshots")
    )


def filter_by_alignment(sequences: DataFrame, library: DataFrame, by: list[str], min_ratio: float = 0.6) -> DataFrame:
    """Alerts kept by the alignment: members of the LCS when it covers enough of the library entry, else none."""
    best = best_alignment(sequences, library)
    ratio = F.when(F.col("lib_len") > 0, F.col("length") / F.col("lib_len")).otherwise(F.lit(0.0))
    kept = best.filter((F.col("length") > 0) & (ratio >= min_ratio))
    zipped = kept.select(*by, F.explode(F.arrays_zip("snapshots", "steps", "mask")).alias("z"))
    return zipped.filter("z.mask").select(*by, F.col("z.snapshots").alias("snapshot_id"), F.col("z.steps").alias("code"))


def drop_uncertain(alerts: DataFrame, least: float = 0.35) -> DataFrame:
    """Drop alerts without technique or below the confidence; the truth label plays no part."""
    return alerts.filter((F.col("code") != UNKNOWN) & (F.col("score") >= least))


def sequence_ratio(pairs: DataFrame) -> DataFrame:
    """2 * LCS / (both lengths) of aligned pairs."""
    return pairs.withColumn("ratio", 2.0 * F.col("length") / (F.col("seq_len") + F.col("lib_len")))


# ---- phrase types -----------------------------------------------------------------------------------
def phrase_types(phrases: DataFrame, k: int = 17, dim: int = 256, seed: int = 7) -> DataFrame:
    """``phrase, cluster, name``: phrases clustered on hashed term vectors, clusters named by short members."""
    from pyspark.ml.clustering import BisectingKMeans
    from pyspark.ml.feature import IDF, HashingTF, Normalizer

    base = phrases.select("phrase").distinct().withColumn("tokens", T.word_tokens(F.col("phrase"))).filter(F.size("tokens") > 0)
    tf = HashingTF(inputCol="tokens", outputCol="tf", numFeatures=dim).transform(base)
    weighted = IDF(inputCol="tf", outputCol="w").fit(tf).transform(tf)
    unit = Normalizer(inputCol="w", outputCol="features").transform(weighted)
    model = BisectingKMeans(k=k, seed=seed).fit(unit)
    out = model.transform(unit).select("phrase", F.col("prediction").alias("cluster"))
    short = top_per_group(out, ["cluster"], [F.length("phrase"), F.col("phrase")], 3, "_r").groupBy("cluster").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_r", "phrase"))), lambda s: s["phrase"]), " / ").alias("name")
    )
    return out.join(short, "cluster")
