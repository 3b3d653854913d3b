"""Removal of near-equal paragraphs and of passages that documents share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import PLACE, RADIX, RADIX_INV, arrow_rows, cut, kept, listed, mix, powers, raw_bytes, shingle_hashes, signed, sliding_min, text_slices, winnow, word_hashes, written
from .jaccard import similar
from .linking import link_by_keys, shared_keys

#: Words of a shingle; of a paragraph at least where nothing else is said, and of a passage that two places share.
SHINGLE, LEAST, PASSAGE = 5, 50, 50
#: Bands of ROWS minima each: two paragraphs with Jaccard similarity 0.8 miss each other with a chance of 0.003.
BANDS, ROWS = 8, 3
#: Shingles of a window that picks one; PASSAGE words hold so many windows that three picks in a row are common.
WINDOW = 14
SALTS = mix(np.arange(51, 51 + BANDS * ROWS, dtype=np.uint64))
NEVER = np.uint64(0xFFFFFFFFFFFFFFFF)
#: Rows that a task hands to Python at once, and bytes of text that are hashed at once: about a hundred bytes of arrays for each.
ROWS_AT_ONCE, SLICE = 500, 1 << 19
#: Runs of words that a task hands back at once.
RUNS_AT_ONCE = 1 << 15


def line_ids(words: np.ndarray, first: np.ndarray) -> np.ndarray:
    """64 bits that stand for each line's words; lines are words[first[k]:first[k + 1]], none of them empty."""
    if len(first) < 2:
        return np.zeros(0, np.uint64)
    sizes = np.diff(first)
    place = np.arange(len(words)) - np.repeat(first[:-1], sizes)
    return mix(np.add.reduceat(mix(words) * powers(RADIX, int(sizes.max()))[place], first[:-1]) + sizes.astype(np.uint64))


def line_bands(words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bands (lines, BANDS), hashes of ROWS minima each over the shingles of every line, and distinct shingles; all lines at once."""
    sizes = np.diff(first)
    if not len(sizes):
        return np.zeros((0, BANDS), np.uint64), np.zeros(0, np.int64)
    shingles = np.full(len(words), NEVER)
    for k in range(1, SHINGLE + 1):
        # lines of fewer words are one shingle
        lines = np.flatnonzero(sizes >= SHINGLE) if k == SHINGLE else np.flatnonzero(sizes == k)
        count = sizes[lines] - k + 1
        at = np.repeat(first[:-1][lines], count) + np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
        total = np.full(len(at), k, dtype=np.uint64)
        for j in range(k):
            total += words[at + j] * PLACE[j]
        shingles[at] = mix(total)
    none = shingles == NEVER
    out = np.zeros((len(sizes), BANDS), np.uint64)
    for k, salt in enumerate(SALTS):
        value = shingles ^ salt
        value[none] = NEVER
        out[:, k // ROWS] += np.minimum.reduceat(value, first[:-1]) * PLACE[k % ROWS]
    # equal shingles lie side by side, in the order of their places
    line, order = np.repeat(np.arange(len(sizes)), sizes), np.argsort(shingles, kind="stable")
    again = (shingles[order][1:] == shingles[order][:-1]) & (line[order][1:] == line[order][:-1]) & ~none[order][1:]
    distinct = np.bincount(line[~none], minlength=len(sizes)) - np.bincount(line[order][1:][again], minlength=len(sizes))
    return mix(out + SALTS[:BANDS]), distinct


def _lines(batches, least: int) -> Iterator[tuple]:
    """(rows, first line by row, bytes, line begins and ends, word hashes, first word of each line) of slices of Arrow batches.

    Only lines of `least` words or more are told; row and line numbers of these come as (row, line in it).
    """
    for batch in batches:
        column = batch.column("text")
        for a, b in text_slices(column, SLICE):
            data, ends = raw_bytes(column.slice(a, b - a))
            # a line is a row of its own for the words' hashes
            cuts = np.unique(np.concatenate([ends, np.flatnonzero(data == 10) + 1]))
            hashes, _, _, first = word_hashes(data, cuts)
            sizes = np.diff(first)
            kept = np.flatnonzero(sizes >= max(least, 1))
            row = np.searchsorted(ends, cuts[:-1], side="right")[kept] - 1 if len(kept) else kept
            line = kept - np.searchsorted(cuts, ends[row])
            words = hashes if len(kept) == len(sizes) else hashes[np.repeat(sizes >= max(least, 1), sizes)]
            own = np.concatenate([[0], np.cumsum(sizes[kept])]).astype(np.int64)
            yield batch.slice(a, b - a), data, row, line, cuts[kept], cuts[kept + 1], ends, words, own


def _paragraphs(docs: DataFrame, least: int) -> DataFrame:
    """Lines of `least` words or more: doc_id, paragraph, begin, end (bytes), n_words, pid, d (distinct shingles), keys (the bands)."""

    def run(batches) -> Iterator:
        import pyarrow as pa

        seen: set[int] = set()
        for part, _, row, line, begin, end, ends, words, first in _lines(batches, least):
            bands, distinct = line_bands(words, first)
            pid = signed(line_ids(words, first))
            # copies that a task meets again bring no keys
            new = np.array([not (k in seen or seen.add(k)) for k in pid.tolist()], dtype=bool)
            if len(seen) > 1 << 20:
                seen.clear()
            bands = signed(bands[new])
            places = np.concatenate([[0], np.cumsum(np.where(new, BANDS, 0))]).astype(np.int32)
            arrays = [
                part.column("doc_id").take(pa.array(row)), pa.array(line.astype(np.int32)), pa.array(begin - ends[row]), pa.array(end - ends[row]),
                pa.array(np.diff(first).astype(np.int32)), pa.array(pid), pa.array(distinct.astype(np.int32)),
                pa.ListArray.from_arrays(pa.array(places), pa.array(bands.ravel())),
            ]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "paragraph", "begin", "end", "n_words", "pid", "d", "keys"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"doc_id {kind}, paragraph int, begin long, end long, n_words int, pid long, d int, keys array<long>")


def _line_texts(docs: DataFrame, least: int, wanted: DataFrame) -> DataFrame:
    """(id, z): the bytes of the wanted lines (id), one each."""

    def run(batches) -> Iterator:
        import pyarrow as pa

        for _, data, _, _, begin, end, _, words, first in _lines(batches, least):
            # lines and what lies between them, as they are in the slice's bytes
            places = np.append(np.column_stack([begin, end]).ravel(), len(data)).astype(np.int32)
            cuts = pa.BinaryArray.from_buffers(pa.binary(), len(places) - 1, [None, pa.py_buffer(places), pa.py_buffer(data)])
            yield pa.RecordBatch.from_arrays([pa.array(signed(line_ids(words, first))), cuts.take(pa.array(np.arange(0, len(places) - 1, 2)))], names=["id", "z"])

    lines = docs.select("text").mapInArrow(run, "id long, z binary")
    return cut(listed(lines, wanted, "id").groupBy("id").agg(F.first("z").alias("z")))


def _set_of(z) -> np.ndarray:
    raw = np.frombuffer(z.as_py(), dtype=np.uint8)
    return np.unique(shingle_hashes(word_hashes(raw, np.array([0, len(raw)]))[0], SHINGLE))


def _elements(texts: DataFrame):
    def elements(ids: DataFrame) -> DataFrame:
        names = ids.columns

        def run(batches) -> Iterator:
            import pyarrow as pa

            for batch in batches:
                sets = [_set_of(z) for z in batch.column("z")]
                at = pa.array(np.repeat(np.arange(len(sets)), [len(s) for s in sets]))
                yield pa.RecordBatch.from_arrays([*[batch.column(c).take(at) for c in names], pa.array(signed(np.concatenate([*sets, np.zeros(0, np.uint64)])))], names=[*names, "e"])

        return texts.join(ids, "id").select(*names, "z").mapInArrow(run, ", ".join(f"{c} long" for c in names) + ", e long")

    return elements


def _verify(texts: DataFrame, sizes: DataFrame):
    def verify(pairs: DataFrame) -> DataFrame:
        def run(batches) -> Iterator:
            import pyarrow as pa

            cache: dict = {}

            def made(key, value):
                if key not in cache:
                    if len(cache) > 512:
                        cache.clear()
                    cache[key] = _set_of(value)
                return cache[key]

            for batch in batches:
                a, b, za, zb = (batch.column(c) for c in ("a", "b", "za", "zb"))
                ka, kb = a.to_pylist(), b.to_pylist()
                keep = [similar(made(ka[i], za[i]), made(kb[i], zb[i])) for i in range(len(ka))]
                yield pa.RecordBatch.from_arrays([a, b], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

        size = lambda s: sizes.select(F.col("id").alias(s), F.col("d").alias(f"d{s}"))
        pairs = pairs.join(size("a"), "a").join(size("b"), "b").filter(F.least("da", "db") * 100 >= F.greatest("da", "db") * 80).select("a", "b")
        both = pairs.join(texts.select(F.col("id").alias("a"), F.col("z").alias("za")), "a").join(texts.select(F.col("id").alias("b"), F.col("z").alias("zb")), "b")
        return both.select("a", "b", "za", "zb").mapInArrow(run, "a long, b long")

    return verify


def repeated_paragraphs(docs: DataFrame, text: str = "text", least: int = LEAST) -> DataFrame:
    """(doc_id, paragraph, begin, end, n_words, component_id, kept): the paragraphs that have a relative elsewhere.

    Paragraphs are lines of `least` words or more (white-space separated, A-Z as a-z); paragraph counts a document's lines
    from 0, begin and end are bytes. Two are relatives if 80 percent of their distinct SHINGLE-word shingles are common;
    a passage that they quote makes no relatives of lines with text of their own, see repeated_passages. Of each
    component, the first paragraph by doc_id and place is kept, once; component_id is its doc_id. Documents without such
    a paragraph have no row. Lines of any length are compared whole. Null or empty texts have no paragraphs;
    null ids come last, and of these and of repeated rows each is a document of its own; an empty table gives an empty
    result; other columns are not looked at.

    Equal paragraphs are one class. Bands of minima find similar ones, which are verified exactly; see link_by_keys for
    how keys that very many paragraphs have are worked through. Texts move only for paragraphs that share a band.
    """
    docs = docs.select("doc_id", F.col(text).alias("text"))
    occ = written(_paragraphs(docs, least).withColumn("oid", F.monotonically_increasing_id()))
    spark = docs.sparkSession
    members = kept(spark, lambda: shared_keys(occ.select(F.explode("keys").alias("key"), F.col("pid").alias("id"))))
    wanted = written(members.select("id").distinct())
    sizes = written(listed(occ.select(F.col("pid").alias("id"), "d"), wanted, "id").groupBy("id").agg(F.first("d").alias("d")))
    texts = _line_texts(docs, least, wanted)
    comps = kept(spark, lambda: link_by_keys(members, _verify(texts, sizes), _elements(texts)))
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "paragraph", "oid")
    own = occ.groupBy("pid").agg(F.count("*").alias("m"), F.min(place).alias("first"))
    named = written(own.join(comps.select(F.col("id").alias("pid"), "comp"), "pid", "left").filter("m > 1 or comp is not null").select("pid", F.coalesce("comp", "pid").alias("comp"), "first"))
    firsts = named.groupBy("comp").agg(F.min("first").alias("kept"))
    rows = occ.join(written(named.join(firsts, "comp").select("pid", "kept")), "pid")
    return rows.select("doc_id", "paragraph", "begin", "end", "n_words", F.col("kept.doc_id").alias("component_id"), (F.col("kept.oid") == F.col("oid")).alias("kept"))


def passage_hashes(words: np.ndarray) -> np.ndarray:
    """Hashes of all runs of PASSAGE words, from sums over all words before."""
    n = len(words)
    if n < PASSAGE:
        return np.zeros(0, np.uint64)
    sums = np.concatenate([[np.uint64(0)], np.cumsum(mix(words) * powers(RADIX, n), dtype=np.uint64)])
    return mix((sums[PASSAGE:] - sums[: n - PASSAGE + 1]) * powers(RADIX_INV, n)[: n - PASSAGE + 1])


def _all_spots(words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of the spots of all rows at once, as _spots for each row words[first[k]:first[k + 1]]."""
    n = len(words)
    if n < PASSAGE:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    total = np.full(n - SHINGLE + 1, SHINGLE, dtype=np.uint64)
    for j in range(SHINGLE):
        total += words[j : n - SHINGLE + 1 + j] * PLACE[j]
    shingles = mix(total)
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    low = sliding_min((shingles & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(shingles), dtype=np.uint64), WINDOW)
    begin = np.flatnonzero(row[: len(low)] == row[WINDOW + SHINGLE - 2 : WINDOW + SHINGLE - 2 + len(low)])
    low, own = low[begin], row[begin]
    new = np.concatenate([[True], (low[1:] != low[:-1]) | (own[1:] != own[:-1])])[: len(low)]
    at, own = (low[new] & np.uint64(0xFFFFFFFF)).astype(np.int64), own[new]
    picks = shingles[at]
    # a passage of the row must hold all three
    start, stop = first[own], first[own + 1]
    fits = (own[2:] == own[:-2]) & (np.maximum(at[2:] + SHINGLE - PASSAGE, start[2:]) <= np.minimum(at[:-2], stop[2:] - PASSAGE))
    return own[2:][fits], mix(picks[:-2] * np.uint64(9) + picks[1:-1] * np.uint64(3) + picks[2:])[fits]


def _spots(words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of three neighbouring picks of a text, the first and the last passage (by its first word) that holds them."""
    shingles = shingle_hashes(words, SHINGLE)
    at = winnow(shingles, WINDOW)
    picks = shingles[at]
    keys = mix(picks[:-2] * np.uint64(9) + picks[1:-1] * np.uint64(3) + picks[2:])
    low, high = np.maximum(at[2:] + SHINGLE - PASSAGE, 0), np.minimum(at[:-2], len(words) - PASSAGE)
    fits = low <= high
    return keys[fits], low[fits], high[fits]


def _spot_keys(docs: DataFrame) -> DataFrame:
    """(key, tid, again) for texts of PASSAGE words or more: the distinct keys of their spots, and whether one is there twice.

    Copies that a task meets again are passed over.
    """

    def run(batches) -> Iterator:
        import pyarrow as pa

        seen: set[int] = set()
        for batch in batches:
            tids, column = np.asarray(batch.column("tid")), batch.column("text")
            new = np.zeros(len(tids), bool)
            for i, t in enumerate(tids.tolist()):
                if t not in seen:
                    new[i] = True
                    seen.add(t)
            if len(seen) > 1 << 20:
                seen.clear()
            tids, column = tids[new], column.filter(pa.array(new))
            for a, b in text_slices(column, SLICE):
                hashes, _, _, first = word_hashes(*raw_bytes(column.slice(a, b - a)))
                row, key = _all_spots(hashes, first)
                order = np.lexsort((key, row))
                row, key = row[order], key[order]
                same = (row[1:] == row[:-1]) & (key[1:] == key[:-1])
                one = np.concatenate([[True], ~same])[: len(row)]
                again = np.concatenate([same, [False]])[: len(row)][one]
                yield pa.RecordBatch.from_arrays([pa.array(signed(key[one])), pa.array(tids[a:b][row[one]]), pa.array(again)], names=["key", "tid", "again"])

    return docs.mapInArrow(run, "key long, tid long, again boolean")


def _windows(texts: DataFrame) -> DataFrame:
    """(tid, i, w, m, lead): hash of the PASSAGE words from word i on, wherever they hold one of the text's keys; all of them if keys is null; m and lead as in texts."""
    kind = texts.schema["lead"].dataType.simpleString()

    def made(batch, hashes: list, places: list, rows: list):
        import pyarrow as pa

        own = pa.array(np.concatenate(rows))
        return pa.RecordBatch.from_arrays([batch.column("tid").take(own), pa.array(np.concatenate(places)), pa.array(signed(np.concatenate(hashes))), batch.column("m").take(own), batch.column("lead").take(own)], names=["tid", "i", "w", "m", "lead"])

    def run(batches) -> Iterator:
        for batch in batches:
            hashes, places, rows = [], [], []
            for r, (text, keys) in enumerate(zip(batch.column("text"), batch.column("keys"), strict=True)):
                raw = np.frombuffer(text.as_py().encode(), dtype=np.uint8)
                words = word_hashes(raw, np.array([0, len(raw)]))[0]
                if len(words) < PASSAGE:
                    continue
                w = passage_hashes(words)
                i = np.arange(len(w))
                if keys.is_valid:
                    have, low, high = _spots(words)
                    hit = np.isin(signed(have), keys.values.to_numpy())
                    change = np.zeros(len(w) + 1, dtype=np.int64)
                    np.add.at(change, low[hit], 1)
                    np.add.at(change, high[hit] + 1, -1)
                    i = np.flatnonzero(np.cumsum(change[:-1]) > 0)
                hashes.append(w[i])
                places.append(i)
                rows.append(np.full(len(i), r))
                if sum(map(len, places)) > RUNS_AT_ONCE:
                    yield made(batch, hashes, places, rows)
                    hashes, places, rows = [], [], []
            if rows:
                yield made(batch, hashes, places, rows)

    return texts.select("tid", "text", "keys", "m", "lead").mapInArrow(run, f"tid long, i long, w long, m long, lead {kind}")


def passage_runs(docs: DataFrame) -> DataFrame:
    """(tid, i, doc_id, kept): all runs of PASSAGE words that stand in several places. docs: (doc_id, text).

    doc_id: of the first place by doc_id and place, null ids last; kept: whether this is it. Equal texts are one (tid)
    with its least doc_id. Three neighbouring winnowed shingles, which every passage holds, find where texts may agree; only there all
    runs are hashed and counted, map-side first.
    """
    lead = docs.filter("text is not null").groupBy(F.xxhash64("text").alias("tid")).agg(F.count("*").alias("m"), F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id")).alias("lead"))
    docs = docs.select(F.xxhash64("text").alias("tid"), "text").filter("text is not null")
    spark = docs.sparkSession

    def make() -> DataFrame:
        pairs = written(_spot_keys(docs))
        several = pairs.groupBy("key").agg(F.min("tid").alias("t0"), F.max("tid").alias("t1"), F.max("again").alias("again")).filter("t0 < t1 or again")
        keys = pairs.join(several.select("key"), "key").groupBy("tid").agg(F.collect_set("key").alias("keys"))
        return lead.join(keys, "tid", "left").filter("m > 1 or keys is not null").select("tid", "m", "lead", F.when(F.col("m") == 1, F.col("keys")).alias("keys"))

    # each step's shuffles are off the disk before the next begins
    marked = kept(spark, make)
    runs = kept(spark, lambda: _windows(listed(docs, marked, "tid").groupBy("tid").agg(F.first("text").alias("text")).join(marked, "tid")))
    place = F.struct("lead.none", "lead.doc_id", "tid", "i")
    first = kept(spark, lambda: runs.groupBy("w").agg(F.min(place).alias("first"), F.sum("m").alias("times")).filter("times > 1").drop("times"))
    found = runs.select("tid", "i", "w").join(first, "w")
    one = (F.col("first.tid") == F.col("tid")) & (F.col("first.i") == F.col("i"))
    return found.select("tid", "i", F.col("first.doc_id").alias("doc_id"), one.alias("kept"))


def _spans(texts: DataFrame, kind: str) -> DataFrame:
    """Rows (tid, text, found) to spans: neighbours in found (i, doc_id, kept) with the same doc_id and kept are one."""

    def run(batches) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            lists = batch.column("found")
            flat, ends = lists.flatten(), lists.offsets.to_numpy() - lists.offsets[0].as_py()
            i, kept = flat.field("i").to_numpy(), flat.field("kept").to_numpy(zero_copy_only=False)
            first = flat.field("doc_id").dictionary_encode(null_encoding="encode").indices.to_numpy()
            row = np.repeat(np.arange(batch.num_rows), np.diff(ends))
            new = np.ones(len(i), dtype=bool)
            new[1:] = (row[1:] != row[:-1]) | (i[1:] != i[:-1] + 1) | (first[1:] != first[:-1]) | (kept[1:] != kept[:-1])
            at = np.flatnonzero(new)
            last = np.append(at[1:], len(i))[: len(at)] - 1
            own = np.searchsorted(row[at], np.arange(batch.num_rows + 1))
            places = []
            for r, text in enumerate(batch.column("text").to_pylist()):
                raw = np.frombuffer(text.encode(), dtype=np.uint8)
                _, starts, stops, _ = word_hashes(raw, np.array([0, len(raw)]))
                a, b = i[at[own[r] : own[r + 1]]], i[last[own[r] : own[r + 1]]] + PASSAGE
                places.append((np.searchsorted(np.flatnonzero(raw == 10), starts[a]), starts[a], stops[b - 1], b - a))
            line, begin, end, n = (np.concatenate(x) if places else np.zeros(0, np.int64) for x in (zip(*places, strict=True) if places else [()] * 4))
            tid = batch.column("tid").take(pa.array(row[at]))
            cols = [tid, pa.array(line.astype(np.int32)), pa.array(begin.astype(np.int64)), pa.array(end.astype(np.int64)), pa.array(n.astype(np.int32)), flat.field("doc_id").take(pa.array(at)), pa.array(kept[at])]
            yield pa.RecordBatch.from_arrays(cols, names=["tid", "paragraph", "begin", "end", "n_words", "component_id", "kept"])

    return texts.select("tid", "text", "found").mapInArrow(run, f"tid long, paragraph int, begin long, end long, n_words int, component_id {kind}, kept boolean")


def repeated_passages(docs: DataFrame, text: str = "text", runs: DataFrame | None = None) -> DataFrame:
    """(doc_id, paragraph, begin, end, n_words, component_id, kept): all passages of PASSAGE words or more that stand in several places.

    Words are as in repeated_paragraphs, but a passage may cross line breaks. Of each run of PASSAGE words the first by
    doc_id and place is kept and all later ones are not; neighbouring runs with the same kept and the same document of the
    first (component_id) are one span, from the first byte of its first word to the end of its last (paragraph: the line
    where it begins). Null ids come last; of these and of repeated rows each is a document of its own, and one alone is
    kept; null and empty texts have no passages; an empty table gives an empty result. runs: see passage_runs.
    """
    docs = docs.select("doc_id", F.col(text).alias("text")).filter("text is not null")
    kind = docs.schema["doc_id"].dataType.simpleString()
    tid = F.xxhash64("text").alias("tid")
    occ = written(docs.select(tid, "doc_id").withColumn("oid", F.monotonically_increasing_id()))
    classes = written(occ.groupBy("tid").agg(F.count("*").alias("m"), F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "oid")).alias("lead")))

    def make() -> DataFrame:
        # moved as plain columns first: lists of structs built before would be several times as large
        rows = (passage_runs(docs) if runs is None else runs).select("tid", "i", "doc_id", "kept").repartition("tid")
        return rows.groupBy("tid").agg(F.sort_array(F.collect_list(F.struct("i", "doc_id", "kept"))).alias("found"))

    found = kept(docs.sparkSession, make)
    texts = listed(docs.select(tid, "text"), found, "tid").groupBy("tid").agg(F.first("text").alias("text"))
    spans = _spans(texts.join(found, "tid"), kind)
    rows = occ.join(classes.select("tid", F.col("lead.oid").alias("one")), "tid")
    return rows.join(spans, "tid").select("doc_id", "paragraph", "begin", "end", "n_words", "component_id", (F.col("kept") & (F.col("oid") == F.col("one"))).alias("kept"))


def op7_substring_dedup(spark, sf_dir: str) -> DataFrame:
    """Lines of any length that have a relative, and passages of whole documents that stand in several places (unit: line, passage)."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    spark = docs.sparkSession
    # what finds the lines is off the disk when passages are looked for; texts reach Python a few at a time, as workers hold batches outside the heap
    with arrow_rows(spark, ROWS_AT_ONCE):
        lines = kept(spark, lambda: repeated_paragraphs(docs, least=1))
        passages = kept(spark, lambda: repeated_passages(docs))
    return lines.withColumn("unit", F.lit("line")).unionByName(passages.withColumn("unit", F.lit("passage")))
