"""Hard-negative mining by a secondary sort.

Pair scores are packed into keys (anchor, descending score, positive before
negative, id) of one binary column, dealt by anchor and sorted within the
partitions. A streaming iterator then reads each anchor's records in order: a
positive opens a window of its own, a negative is given to the open windows
that it lies in, a full or outrun window closes. No anchor's records are ever
held together.

Tasks score their rows against blocks of anchors with matrix products and emit
only what can count, as a map-side combine would: in every batch the first
positives of an anchor, then, once the anchor's positives are known, the first
negatives of each of their windows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sigflow.llm.common import materialise

ANCHORS = 4096               # anchors dealt to the tasks at once
CELLS = 1 << 22              # scores held at once
KEY = np.dtype([("anchor", ">u8"), ("score", ">u8"), ("kind", "u1"), ("none", "u1"), ("id", ">u8"), ("row", ">u8")])
SIGN = np.uint64(1 << 63)
POSITIVE, NEGATIVE = 0, 1


def whole_vector(vector: str, scale: int) -> Column:
    """floor(scale * x) of every component as a long; NULL where the vector or
    a component is NULL or not finite."""
    x = F.col(vector).cast("array<double>")
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.when(x.isNotNull() & fine, F.transform(x, lambda v: F.floor(v * scale)))


def matrix(column: pa.Array, width: int = 0) -> np.ndarray:
    """The rows of a list column; shorter ones end in zeros."""
    offsets = column.offsets.to_numpy().astype(np.int64)
    flat = column.values.to_numpy(zero_copy_only=False)[offsets[0]:offsets[-1]].astype(np.int64)
    size = np.diff(offsets)
    out = np.zeros((len(size), max(width, int(size.max(initial=0)))), np.int64)
    out[np.arange(out.shape[1]) < size[:, None]] = flat
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of all rows of ``a`` and ``b``."""
    width = max(a.shape[1], b.shape[1])
    a, b = (np.pad(m, ((0, 0), (0, width - m.shape[1]))) for m in (a, b))
    most = int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0)) * max(width, 1)
    if most >= 1 << 55:
        raise ValueError("scores do not fit into 55 bits")
    if most < 1 << 53:                                   # whole numbers, exact in doubles
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    return a @ b.T


def pack(anchor: np.ndarray, score: np.ndarray, kind: int, none: np.ndarray, ids: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Keys whose bytes are in order of (anchor, falling score, kind, id with
    NULL last, row)."""
    out = np.zeros(len(anchor), KEY)
    out["anchor"] = anchor.astype(np.int64).view(np.uint64) ^ SIGN
    out["score"] = ~(score.astype(np.int64).view(np.uint64) ^ SIGN)
    out["kind"], out["none"] = kind, none
    out["id"] = ids.astype(np.int64).view(np.uint64) ^ SIGN
    out["row"] = row.astype(np.int64).view(np.uint64) ^ SIGN
    return out


def unpack(keys: np.ndarray) -> dict[str, np.ndarray]:
    out = {n: (keys[n].astype(np.uint64) ^ SIGN).view(np.int64) for n in ("anchor", "id", "row")}
    out["score"] = (~keys["score"].astype(np.uint64) ^ SIGN).view(np.int64)
    return out | {"kind": keys["kind"], "none": keys["none"].astype(bool)}


def _records(keys: np.ndarray) -> pa.RecordBatch:
    keys = keys.astype(KEY)                              # numpy joins arrays in native byte order
    whole = pa.Array.from_buffers(pa.binary(KEY.itemsize), len(keys), [None, pa.py_buffer(keys.tobytes())])
    return pa.RecordBatch.from_arrays(
        [pa.array((keys["anchor"].astype(np.uint64) ^ SIGN).view(np.int64)), whole.cast(pa.binary())], ["anchor", "key"])


def _keys(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), KEY)


def _block(batch: pa.RecordBatch):
    """(row, id, whether it is NULL, label, vectors) in order of id, row."""
    row, ids, label = (batch.column(batch.schema.get_field_index(n)) for n in ("row", "id", "label"))
    none = ids.is_null().to_numpy(zero_copy_only=False)
    row, ids, label = row.to_numpy(), ids.fill_null(0).to_numpy(), label.to_numpy()
    order = np.lexsort((row, ids, none))
    x = matrix(batch.column(batch.schema.get_field_index("x")))
    return row[order], ids[order], none[order], label[order], x[order]


def _first(batch: pa.RecordBatch, anchors: dict, k: int):
    """Keys of the ``k`` first positives of every anchor in a batch."""
    row, ids, none, label, x = _block(batch)
    for value in np.intersect1d(anchors["label"], label):
        own = np.flatnonzero(anchors["label"] == value)
        near = np.flatnonzero(label == value)
        for part in np.array_split(own, -(-len(own) * len(near) // CELLS)):
            s = products(anchors["x"][part], x[near])
            s[anchors["row"][part][:, None] == row[near]] = np.iinfo(np.int64).min       # an anchor is no positive of its own
            top = np.argsort(-s.astype(np.float64) if abs(s).max() < 1 << 53 else ~s, axis=1, kind="stable")[:, :k]
            score = np.take_along_axis(s, top, 1)
            i, j = np.nonzero(score > np.iinfo(np.int64).min)
            at = near[top[i, j]]
            yield pack(anchors["row"][part][i], score[i, j], POSITIVE, none[at], ids[at], row[at])


def _within(batch: pa.RecordBatch, anchors: dict, windows: np.ndarray, open_: np.ndarray, k: int, low: int, high: int):
    """Keys of the first ``k`` negatives of every window in a batch.
    ``windows``: (anchors, positives) positive scores, those ``open_`` count."""
    row, ids, none, label, x = _block(batch)
    lowest = np.iinfo(np.int64).min
    many = len(anchors["row"])
    for part in np.array_split(np.arange(many), -(-many * len(row) // CELLS)) if len(row) else ():
        s = products(anchors["x"][part], x)
        s[anchors["label"][part][:, None] == label] = lowest
        order = np.argsort(~s, axis=1, kind="stable")
        s = np.take_along_axis(s, order, 1)
        take = np.zeros(s.shape, bool)
        for p in range(windows.shape[1]):
            score = windows[part, p]
            begin = (100 * np.maximum(s, lowest // 128) > high * score[:, None]).sum(1)
            for step in range(k):
                at = np.minimum(begin + step, s.shape[1] - 1)
                found = s[np.arange(len(part)), at]
                good = open_[part, p] & (begin + step < s.shape[1]) & (found > lowest) & \
                    (100 * np.maximum(found, lowest // 128) >= low * score)
                take[np.flatnonzero(good), at[good]] = True
        i, j = np.nonzero(take)
        at = order[i, j]
        yield pack(anchors["row"][part][i], s[i, j], NEGATIVE, none[at], ids[at], row[at])


def _least(keys: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` first keys of every anchor."""
    keys = keys[np.argsort(keys, order=("anchor", "score", "none", "id", "row"), kind="stable")]
    lead = np.flatnonzero(np.diff(keys["anchor"], prepend=keys["anchor"][:1] + np.uint64(1)) != 0)
    place = np.arange(len(keys)) - np.repeat(lead, np.diff(np.append(lead, len(keys))))
    return keys[place < k]


def hard_negatives(df: DataFrame, is_anchor: Column, k_positive: int = 5, k_negative: int = 5, low: int = 80,
                   high: int = 100, scale: int = 256, id_col: str = "id", label_col: str = "label",
                   vec_col: str = "vector") -> DataFrame:
    """For every anchor and each of its ``k_positive`` best rows of the same
    label, the first ``k_negative`` rows of another label whose score lies from
    ``low`` to ``high`` percent of the positive's: anchor_id, positive_id, rank,
    negative_id, positive_score, negative_score. A score is the inner product
    of the vectors' floor(scale * x); higher ones come first, then smaller ids
    (NULL last), then earlier rows.

    Rows with a NULL label, a NULL vector or a NULL or non-finite component
    take no part. Shorter vectors count as ending in zeros. A row whose
    ``is_anchor`` is NULL is no anchor. Repeated rows are rows of their own,
    also as anchors; a row is never its own positive. A positive without any
    negative in its window has no rows; an empty table gives an empty result.
    Scores must fit into 55 bits, otherwise the job fails. Other columns are
    read only by ``is_anchor``. Anchors are dealt in blocks of about
    ``ANCHORS``, each two passes over the vectors."""
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"),
                     whole_vector(vec_col, scale).alias("x"), F.coalesce(is_anchor, F.lit(False)).alias("asks"))
    rows = materialise(rows.where(F.col("label").isNotNull() & F.col("x").isNotNull())
                       .withColumn("row", F.monotonically_increasing_id()), "vectors")
    asked = rows.where("asks")
    blocks = max(1, -(-asked.count() // ANCHORS))
    data = rows.select("row", "id", "label", "x")
    found = None
    for b in range(blocks):
        part = asked.where(F.pmod(F.xxhash64("row"), F.lit(blocks)) == b).select("row", "id", "label", "x").collect()
        if part:
            made = _mine(data, part, k_positive, k_negative, low, high)
            made = materialise(made, "negatives") if blocks > 1 else made
            found = made if found is None else found.unionByName(made)
    if found is None:
        schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
        return df.sparkSession.createDataFrame([], schema)
    return found


def _mine(data: DataFrame, part: list, k_positive: int, k_negative: int, low: int, high: int) -> DataFrame:
    anchors = {"row": np.array([r["row"] for r in part], np.int64), "label": np.array([r["label"] for r in part], np.int64),
               "x": matrix(pa.array([r["x"] for r in part], pa.list_(pa.int64())))}
    names = {r["row"]: r["id"] for r in part}

    def first(batches):
        held = np.zeros(0, KEY)
        for batch in batches:
            held = _least(np.concatenate([held, *_first(batch, anchors, k_positive)]), k_positive)
        yield _records(held)

    by_key = Window.partitionBy("anchor").orderBy("key")
    positives = materialise(data.mapInArrow(first, "anchor long, key binary")
                            .withColumn("place", F.row_number().over(by_key)).where(F.col("place") <= k_positive), "positives")
    index = {r: i for i, r in enumerate(anchors["row"].tolist())}
    windows, open_ = (np.zeros((len(part), k_positive), t) for t in (np.int64, bool))
    known = positives.collect()                                        # at most k_positive rows an anchor of the block
    scores = unpack(_keys(pa.array([bytes(r["key"]) for r in known], pa.binary())))["score"]
    for r, score in zip(known, scores):
        at = index[r["anchor"]], r["place"] - 1
        windows[at], open_[at] = score, True

    def within(batches):
        for batch in batches:
            for keys in _within(batch, anchors, windows, open_, k_negative, low, high):
                yield _records(keys)

    def stream(batches):
        anchor, going = None, []                        # open windows: [positive id, score, negatives so far]
        for batch in batches:
            f = unpack(_keys(batch.column(batch.schema.get_field_index("key"))))
            ids = [None if n else i for i, n in zip(f["id"].tolist(), f["none"].tolist())]
            out = []
            for a, s, kind, i in zip(f["anchor"].tolist(), f["score"].tolist(), f["kind"].tolist(), ids):
                if a != anchor:
                    anchor, going = a, []
                if kind == POSITIVE:
                    going.append([i, s, 0])
                    continue
                for w in going:
                    if w[2] < k_negative and low * w[1] <= 100 * s <= high * w[1]:
                        w[2] += 1
                        out.append((names[a], w[0], w[2], i, w[1], s))
                going = [w for w in going if w[2] < k_negative and low * w[1] <= 100 * s]
            columns = list(zip(*out)) if out else [[]] * 6
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, [pa.int64()] * 2 + [pa.int32()] + [pa.int64()] * 3)],
                ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"])

    records = data.mapInArrow(within, "anchor long, key binary").unionByName(positives.select("anchor", "key"))
    return records.repartition("anchor").sortWithinPartitions("key").mapInArrow(
        stream, "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
