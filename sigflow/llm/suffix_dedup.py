"""Removal of long repeated substrings over sampled suffixes.

Merging the suffix orders of shards byte by byte takes as many passes over all
suffixes as the match is long. Here only sampled suffixes are merged, one for
each run of windows (see ``anchors``): equal windows hold the same sample at
the same place, so no repeat is lost. The merge refines blocks of suffixes
that agree so far and never re-sorts the rest:

1. Shards give the block (hash) of each sampled suffix's first ``gram`` bytes.
   Blocks held once anywhere are settled: none of their windows repeats.
2. The others are refined by all bytes that their windows cover. Suffixes that
   still share a block repeat with all their windows; copies, however many,
   are settled here by counts alone.
3. What is left are the rims of repeats, where windows of one suffix agree with
   others and some do not. One suffix of every remaining block brings its
   bytes, and all its windows are interleaved with the others' of its first
   block and refined by the next eight bytes a round; a window alone in its
   block leaves, and blocks of two after ``length`` bytes are repeats, compared
   byte by byte. Blocks too large for a task meet by the windows' hashes.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigflow.llm.anchors import block, rolling, sampled, span_hash
from sigflow.llm.common import discard, fix_splits, materialise, text_of
from sigflow.llm.textbatch import MASKS, mix, padded, ragged, slices, texts, word_view
from sigflow.operators.components import HEAVY_ROWS, HEAVY_SHARE, lookup

GRAM = 64
SCAN_BYTES = 1 << 20         # texts hashed at once
TASK_SUFFIXES = 20_000       # suffixes refined in a task, on average
BLOCK_SUFFIXES = 100_000     # larger blocks meet by window hashes


def _few(counts: DataFrame, keys: list[str], total: int) -> DataFrame | None:
    """Heavy keys read off a table of (keys, n): at most HEAVY_SHARE rows."""
    found = counts.where(F.col("n") > max(HEAVY_ROWS, total // HEAVY_SHARE)).select(*keys)
    return None if found.isEmpty() else found


def refine(data: np.ndarray, offsets: np.ndarray, first: np.ndarray, far: np.ndarray, near: np.ndarray,
           length: int) -> tuple[np.ndarray, np.ndarray]:
    """(suffix, distance of the window's start before its sample) of all
    windows that two suffixes share. Suffix i's bytes cover its windows, whose
    starts lie ``far[i]`` to ``near[i]`` bytes before the sample."""
    count = far - near + 1
    who = np.repeat(np.arange(len(far)), count)
    step = ragged(np.zeros(len(far), np.int64), count)
    start, back = offsets[:-1][who] + step, far[who] - step
    words = word_view(padded(data))
    at = pd.factorize(first)[0][who] * (int(far.max(initial=0)) + 1) + back      # block: first block and distance
    for done in range(-8, length, 8):
        if done >= 0:
            word = words[start + done] & MASKS[min(8, length - done)]
            code, distinct = pd.factorize(word)
            at = at * max(1, len(distinct)) + code
        at, distinct = pd.factorize(at)
        alone = np.bincount(at, minlength=len(distinct)) < 2
        keep = ~alone[at]
        at, who, start, back = at[keep], who[keep], start[keep], back[keep]
        if not len(at):
            break
    return who, back


def _runs(who: np.ndarray, place: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(suffix, start, end) of maximal runs of adjacent windows."""
    if not len(who):
        return who, place, place
    order = np.lexsort((place, who))
    who, place = who[order], place[order]
    lead = np.concatenate([[True], (who[1:] != who[:-1]) | (place[1:] != place[:-1] + 1)])
    first = np.flatnonzero(lead)
    last = np.append(first[1:], len(who)) - 1
    return who[first], place[first], place[last] + length


SPANS = "row long, start long, end long"


def _sampled_suffixes(rows: DataFrame, length: int, gram: int) -> DataFrame:
    def run(batches):
        for batch, data, offsets in slices(batches, limit=SCAN_BYTES):
            text, place, first, last, start, whole = sampled(data, offsets, length, gram)
            yield pa.RecordBatch.from_arrays([
                batch.column(0).take(pa.array(text)), pa.array(place), pa.array((place - first).astype(np.int32)),
                pa.array((place - last).astype(np.int32)), pa.array(start.view(np.int64)), pa.array(whole.view(np.int64))],
                ["row", "place", "far", "near", "first", "whole"])

    return rows.select("row", "text").mapInArrow(run, "row long, place long, far int, near int, first long, whole long")


def _bytes_of(rows: DataFrame, asked: DataFrame, length: int) -> DataFrame:
    """The bytes that the windows of the asked suffixes cover."""
    lists = asked.groupBy("row").agg(F.collect_list(F.struct("place", "far", "near", "first", "single", "large")).alias("asked"))
    both = rows.join(lists, "row").select("row", "text", "asked")     # a list is bounded by its text

    def run(batches):
        for batch, data, offsets in slices(batches):
            lists = batch.column(2)
            flat, size = lists.flatten(), lists.value_lengths().to_numpy(zero_copy_only=False)
            col = {f.name: flat.field(i) for i, f in enumerate(flat.type)}
            place, far, near = (col[k].to_numpy(zero_copy_only=False).astype(np.int64) for k in ("place", "far", "near"))
            text = np.repeat(np.arange(batch.num_rows), size)
            start, n = offsets[text] + place - far, far - near + length
            raw = data[ragged(start, n)].tobytes()
            ends = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
            cover = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(ends), pa.py_buffer(raw)])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(text)), *(col[k] for k in ("place", "far", "near", "first", "single", "large")),
                 cover], ["row", "place", "far", "near", "first", "single", "large", "bytes"])

    return both.mapInArrow(run, "row long, place long, far int, near int, first long, single boolean, large boolean, bytes binary")


def _columns(table) -> tuple:
    data, offsets = texts(table.column(table.schema.get_field_index("bytes")))
    number = lambda k: table.column(k).to_numpy(zero_copy_only=False).astype(np.int64)
    return data, offsets, number("row"), number("place"), number("far"), number("near"), number("first"), \
        table.column("single").to_numpy(zero_copy_only=False).astype(bool)


def _rims(suffixes: DataFrame, length: int, count: int) -> DataFrame:
    """Spans of single suffixes, found inside tasks that hold whole blocks."""
    def run(table: pa.Table) -> pa.Table:
        data, offsets, row, place, far, near, first, single = _columns(table.combine_chunks().to_batches()[0])
        who, back = refine(data, offsets, first, far, near, length)
        who, back = who[single[who]], back[single[who]]
        who, start, end = _runs(who, place[who] - back, length)
        return pa.table({"row": row[who], "start": start, "end": end})

    tasks = max(1, -(-count // TASK_SUFFIXES))
    return (suffixes.withColumn("task", F.pmod(F.xxhash64("first"), F.lit(tasks)))
            .groupBy("task").applyInArrow(run, SPANS))


def _rims_of_large(suffixes: DataFrame, length: int) -> DataFrame:
    """The same for blocks of any size: a row per window, counted by hash."""
    unit = block(length)

    def run(batches):
        for batch in batches:
            data, offsets, row, place, far, near, first, single = _columns(batch)
            count = far - near + 1
            who = np.repeat(np.arange(len(far)), count)
            step = ragged(np.zeros(len(far), np.int64), count)
            runs = rolling(data, [unit])[unit]
            start, back = offsets[:-1][who] + step, far[who] - step
            window = span_hash(runs, unit, start, np.full(len(start), length), length)
            name = mix(first[who].view(np.uint64) + back.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            yield pa.RecordBatch.from_arrays(
                [pa.array(row[who]), pa.array(place[who] - back), pa.array(single[who]),
                 pa.array(name.view(np.int64)), pa.array(window.view(np.int64))], ["row", "start", "single", "name", "window"])

    windows = materialise(suffixes.mapInArrow(run, "row long, start long, single boolean, name long, window long"), "windows")
    shared = materialise(windows.groupBy("name", "window").agg(F.count("*").alias("n")).where("n > 1"), "shared")
    few = _few(shared, ["name", "window"], windows.count())
    return (lookup(windows.where("single"), shared.select("name", "window"), ["name", "window"], heavy=few)
            .select("row", "start", (F.col("start") + length).alias("end")))


def repeated_spans(rows: DataFrame, length: int, gram: int = GRAM) -> DataFrame:
    """(row, start, end) spans whose union is every byte covered by a string of
    ``length`` bytes that also starts anywhere else. ``rows``: row, text."""
    every = materialise(_sampled_suffixes(rows, length, gram), "suffixes")
    total = every.count()
    # 1. blocks by the first bytes
    blocks = materialise(every.groupBy("first").agg(F.count("*").alias("n")).where("n > 1"), "blocks")
    held = materialise(lookup(every, blocks.select("first"), ["first"], heavy=_few(blocks, ["first"], total)), "held")
    discard(every)
    # 2. refined by all covered bytes
    key = ["first", "far", "near", "whole"]
    refined = materialise(held.groupBy(*key).agg(F.count("*").alias("n"), F.min(F.struct("row", "place")).alias("lead")),
                          "refined")
    again = refined.where("n > 1").select(*key, "n")
    whole = (lookup(held, again.drop("n"), key, heavy=_few(again, key, total))
             .select("row", (F.col("place") - F.col("far")).alias("start"),
                     (F.col("place") - F.col("near") + length).alias("end")))
    # 3. rims: blocks with several refined ones, of which one at least is single
    mixed = (refined.groupBy("first").agg(F.count("*").alias("n"), F.sum((F.col("n") == 1).cast("long")).alias("singles"))
             .where("n > 1 and singles > 0"))
    mixed = materialise(mixed, "mixed")
    asked = lookup(refined.select("first", "far", "near", "lead", (F.col("n") == 1).alias("single")),
                   mixed.select("first", (F.col("n") > BLOCK_SUFFIXES).alias("large")), ["first"],
                   heavy=_few(mixed, ["first"], total))
    asked = asked.select("lead.row", "lead.place", "far", "near", "first", "single", "large")
    cover = materialise(_bytes_of(rows, asked, length), "covers")
    small, large = cover.where("not large"), cover.where("large")
    found = whole.unionByName(_rims(small, length, small.count()))
    return found if large.isEmpty() else found.unionByName(_rims_of_large(large, length))


def _merged(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of the union of spans."""
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate(end[order])
    lead = np.concatenate([[True], start[1:] > end[:-1]])
    return start[lead], end[np.append(np.flatnonzero(lead)[1:], len(start)) - 1]


def cut_repeats(df: DataFrame, length: int = 200, id_col: str = "doc_id", text_col: str = "text", gram: int = GRAM,
                keep: list[str] = ()) -> DataFrame:
    """One row per row of ``df``: doc_id, the columns ``keep``, n_bytes,
    n_removed, n_spans (maximal removed runs), kept_sha256, of the remaining
    bytes, and kept_text, the remaining text without characters that lost some
    of their bytes.

    Texts are compared as UTF-8 bytes, never across texts; a NULL text is empty
    and a text shorter than ``length`` keeps all. Repeated rows are separate
    texts, so they remove each other's bytes. A NULL id stays NULL. An empty
    table gives an empty result; other columns are not read. ``df`` is read
    three times and must give the same rows in the same partitions, as a table
    scan does."""
    if block(gram) != gram or not 2 * gram <= length:
        raise ValueError("gram must be a power of two up to half the length")
    fix_splits(df.sparkSession)
    rows = df.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"), *keep) \
        .withColumn("row", F.monotonically_increasing_id())
    spans = repeated_spans(rows.select("row", "text"), length, gram)
    # a list is bounded by its text: spans of one sample each
    lists = spans.groupBy("row").agg(F.collect_set(F.struct("start", "end")).alias("spans"))
    both = rows.join(lists, "row", "left").select("text", "spans", "doc_id", *keep)

    def run(batches):
        for batch, data, offsets in slices(batches):
            spans = batch.column(1)
            size = spans.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            flat = spans.flatten()
            start, end = (flat.field(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            at = np.concatenate([[0], np.cumsum(size)])
            raw, kept, removed, runs = data.tobytes(), [], [], []
            for i in range(batch.num_rows):
                a, b = offsets[i], offsets[i + 1]
                text = raw[a:b]
                if size[i]:
                    s, e = _merged(start[at[i]:at[i + 1]], end[at[i]:at[i + 1]])
                    inner = zip(np.concatenate([[0], e]).tolist(), np.append(s, b - a).tolist())
                    text = b"".join(text[x:y] for x, y in inner)
                    runs.append(len(s))
                else:
                    runs.append(0)
                kept.append(text)
                removed.append(int(b - a) - len(text))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[2:], pa.array(np.diff(offsets)), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()),
                 pa.array([hashlib.sha256(k).hexdigest() for k in kept]),
                 pa.array([k.decode("utf-8", "ignore") for k in kept], pa.string())],
                [*batch.schema.names[2:], "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text"])

    schema = rows.select("doc_id", *keep).schema
    for name, kind in (("n_bytes", "long"), ("n_removed", "long"), ("n_spans", "long"), ("kept_sha256", "string"),
                       ("kept_text", "string")):
        schema = schema.add(name, kind)
    return both.mapInArrow(run, schema)
