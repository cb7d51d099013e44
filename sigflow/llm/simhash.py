"""SimHash near-duplicates linked through BK-trees.

Fingerprints are computed from whole texts with array operations. Distinct
fingerprints are then dealt to shards: two that differ in at most ``radius``
bits agree in at least ``agree`` of ``radius + agree`` bit blocks, so every
choice of ``agree`` blocks is a key, and linked fingerprints meet under one
key at least. The shards of a task form a forest of BK-trees: a node's
children are keyed by their integer Hamming distance to it, and a search
follows only the edges within the radius of the distance found. Trees go to
the tasks that need them by their key: broadcasting all shards would grow with
the data. A shard beyond ``SHARD`` fingerprints is split, and its parts meet
pairwise. A task reports the components it finds (an edge per member), never
its pairs; a join loop merges them over all shards.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigflow.llm.common import fix_splits, materialise, text_of
from sigflow.llm.textbatch import SPACE, lower_bytes, padded, ragged, slices, word_view, words_of
from sigflow.operators.components import connected_components, heavy_keys, lookup

SHARD = 4096                 # fingerprints in one tree at most
TASK_ROWS = 200_000          # (key, fingerprint) rows of a task, on average
FRONTIER = 1 << 20           # (query, node) pairs held at once

# fixed values of XXH64
_P1, _P2, _P3, _P4, _P5 = (np.uint64(p) for p in (
    0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _rotl(x: np.ndarray, k: int) -> np.ndarray:
    return (x << np.uint64(k)) | (x >> np.uint64(64 - k))


def _lane(acc, word):
    return _rotl(acc + word * _P2, 31) * _P1


def xxh64(buf: np.ndarray, starts: np.ndarray, lens: np.ndarray, seed: int = 42) -> np.ndarray:
    """XXH64 of every span of a padded buffer."""
    words, n = word_view(buf), len(starts)
    wrap = lambda x: np.uint64(x % 2**64)
    h = np.full(n, wrap(seed + int(_P5)))
    left = np.flatnonzero(lens >= 32)
    if len(left):
        begin = seed + int(_P1) + int(_P2), seed + int(_P2), seed, seed - int(_P1)
        v = [np.full(len(left), wrap(x)) for x in begin]
        at, go, stripes = starts[left].copy(), np.arange(len(left)), lens[left] // 32
        done = 0
        while len(go):
            for k in range(4):
                v[k][go] = _lane(v[k][go], words[at[go] + 8 * k])
            at[go] += 32
            done += 1
            go = go[stripes[go] > done]
        x = _rotl(v[0], 1) + _rotl(v[1], 7) + _rotl(v[2], 12) + _rotl(v[3], 18)
        for k in range(4):
            x = (x ^ _lane(np.uint64(0), v[k])) * _P1 + _P4
        h[left] = x
    h += lens.astype(np.uint64)
    at, rest = starts + (lens & ~31), lens & 31
    for k in range(3):
        go = np.flatnonzero(rest >= 8 * (k + 1))
        x = h[go] ^ _lane(np.uint64(0), words[at[go] + 8 * k])
        h[go] = _rotl(x, 27) * _P1 + _P4
    at, rest = at + (rest & ~7), rest & 7
    go = np.flatnonzero(rest >= 4)
    x = h[go] ^ ((words[at[go]] & np.uint64(0xFFFFFFFF)) * _P1)
    h[go] = _rotl(x, 23) * _P2 + _P3
    at, rest = at + (rest & 4), rest & 3
    for k in range(3):
        go = np.flatnonzero(rest > k)
        x = h[go] ^ (buf[at[go] + k].astype(np.uint64) * _P5)
        h[go] = _rotl(x, 11) * _P1
    h = (h ^ (h >> np.uint64(33))) * _P2
    h = (h ^ (h >> np.uint64(29))) * _P3
    return h ^ (h >> np.uint64(32))


def shingles(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(buffer, starts, lengths, shingles per text) of the space-joined word
    ``k``-grams; a text of fewer words has its whole sequence."""
    data = lower_bytes(data)
    starts, lens, of = words_of(data, offsets)
    keep = ~SPACE[data]
    lead = starts[starts > 0] - 1
    keep[lead[SPACE[data[lead]]]] = True             # the one space before a word
    buf = data[keep]
    buf[SPACE[buf]] = 0x20
    at = (np.cumsum(keep) - 1)[starts] if len(starts) else starts
    words = np.diff(of)
    count = np.where(words > 0, np.maximum(words - k + 1, 1), 0)
    first = ragged(of[:-1], count)
    last = np.minimum(first + k - 1, np.repeat(of[1:], count) - 1)
    return padded(buf), at[first], at[last] + lens[last] - at[first], count


def _bit_counts(h: np.ndarray, count: np.ndarray) -> np.ndarray:
    """How many hashes of every text have each bit. Eight counters of a byte
    are added up in one 64-bit word, at most 255 hashes at a time."""
    out = np.zeros((len(count), 64), np.int64)
    some = np.flatnonzero(count)
    if not len(some):
        return out
    first = (np.cumsum(count) - count)[some]
    runs = -(-count[some] // 255)
    at = np.repeat(first, runs) + ragged(np.zeros(len(some), np.int64), runs) * 255
    parts = np.zeros((len(at), 64), np.int64)
    lanes = np.uint64(0x0101010101010101)
    for j in range(8):
        sums = np.add.reduceat((h >> np.uint64(j)) & lanes, at)
        parts[:, j::8] = sums.view(np.uint8).reshape(-1, 8)
    out[some] = np.add.reduceat(parts, np.cumsum(runs) - runs, axis=0)
    return out


def fingerprints(data: np.ndarray, offsets: np.ndarray, k: int) -> np.ndarray:
    """A text's bit is 1 if set in over half of its shingles' hashes."""
    buf, starts, lens, count = shingles(data, offsets, k)
    h = np.empty(len(starts), np.uint64)
    for a in range(0, len(starts), 1 << 16):
        h[a:a + (1 << 16)] = xxh64(buf, starts[a:a + (1 << 16)], lens[a:a + (1 << 16)])
    bits = 2 * _bit_counts(h, count) > count[:, None]
    return np.packbits(bits, axis=1, bitorder="little").view("<u8").reshape(-1)


# ------------------------------------------------------------------ BK-trees
def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).astype(np.int64)


def grow(prints: np.ndarray, shard: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A BK-tree for every shard, grown level by level: (root of every shard
    number, edge keys in order, children in that order). An edge key is
    node * 65 + distance; of the fingerprints that share one, the first is the
    child and the others go on below it."""
    n = len(prints)
    _, roots, of = np.unique(shard, return_index=True, return_inverse=True)
    node = roots[of]
    rest = np.setdiff1d(np.arange(n), roots, assume_unique=True)
    node = node[rest]
    keys, children = [], []
    while len(rest):
        key = node * 65 + distance(prints[rest], prints[node])
        edge, lead, group = np.unique(key, return_index=True, return_inverse=True)
        keys.append(edge)
        children.append(rest[lead])
        below = np.ones(len(rest), bool)
        below[lead] = False
        node, rest = rest[lead][group][below], rest[below]
    key = np.concatenate(keys) if keys else np.zeros(0, np.int64)
    child = np.concatenate(children) if children else key
    order = np.argsort(key)
    return roots, key[order], child[order]


def search(prints: np.ndarray, queries: np.ndarray, start: np.ndarray, keys: np.ndarray, children: np.ndarray,
           radius: int):
    """Blocks of (query, node) within the radius, found by following only the
    edges whose distance differs from the query's by at most the radius."""
    todo = [(np.arange(a, min(a + FRONTIER, len(queries))), start[a:a + FRONTIER])
            for a in range(0, len(queries), FRONTIER)]
    while todo:
        q, node = todo.pop()
        d = distance(queries[q], prints[node])
        near = d <= radius
        if near.any():
            yield q[near], node[near]
        low = np.searchsorted(keys, node * 65 + np.maximum(d - radius, 0))
        many = np.searchsorted(keys, node * 65 + np.minimum(d + radius, 64), "right") - low
        go = many > 0
        q, low, many = q[go], low[go], many[go]
        while len(q):
            cut = max(1, int(np.searchsorted(np.cumsum(many), FRONTIER, "right")))
            todo.append((np.repeat(q[:cut], many[:cut]), children[ragged(low[:cut], many[:cut])]))
            q, low, many = q[cut:], low[cut:], many[cut:]


def union(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels (each item's smallest known companion) after linking a and b."""
    while True:
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            return label
        a, b = a[apart], b[apart]
        np.minimum.at(label, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up


def linked(prints: np.ndarray, shard: np.ndarray, asks: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(fingerprint, companion) edges that span the components of every
    shard. Rows with ``asks`` below 2 stand in the trees; those with 0 or 2
    are looked up."""
    tree = np.flatnonzero(asks < 2)
    roots, keys, children = grow(prints[tree], shard[tree])
    names = shard[tree][roots]
    q = np.flatnonzero(asks != 1)
    place = np.searchsorted(names, shard[q])
    label = np.arange(len(prints))
    for i, node in search(prints[tree], prints[q], roots[place], keys, children, radius):
        label = union(label, q[i], tree[node])
    out = np.flatnonzero(label != np.arange(len(label)))
    return prints[out], prints[label[out]]


def block_keys(radius: int, agree: int) -> list[int]:
    """Bit masks of every choice of ``agree`` among ``radius + agree`` blocks
    of the 64 bits."""
    n = radius + agree
    edges = [64 * i // n for i in range(n + 1)]
    block = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:])]
    return [sum(c) for c in combinations(block, agree)]


def fingerprint_components(prints: DataFrame, radius: int, agree: int = 2) -> DataFrame:
    """(print, component) for the distinct longs ``print`` that have a link."""
    masks = block_keys(radius, agree)
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    keyed = prints.select("print", F.explode(F.array(*[
        F.struct(F.lit(i).alias("choice"), F.col("print").bitwiseAND(F.lit(m).cast("long")).alias("key"))
        for i, m in enumerate(signed)])).alias("k")).select("print", "k.choice", "k.key")
    sizes = keyed.groupBy("choice", "key").agg(F.count("*").alias("n")).where("n > 1")
    parts = F.ceil(F.col("n") / SHARD).cast("int")
    mine = F.pmod(F.xxhash64("print"), F.col("parts")).cast("int")
    met = (keyed.join(sizes, ["choice", "key"])
           .withColumn("parts", parts).withColumn("mine", mine)
           # parts meet pairwise: (low, high), each in a tree of its own when low = high
           .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
           .select("print", F.when(F.col("mine") == F.col("other"), 0)
                   .when(F.col("mine") < F.col("other"), 1).otherwise(2).alias("asks"),
                   F.xxhash64("choice", "key", F.least("mine", "other"), F.greatest("mine", "other")).alias("shard")))
    met = materialise(met, "shards")
    tasks = max(1, -(-met.count() // TASK_ROWS))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["shard", "print"], ignore_index=True)
        a, b = linked(pdf["print"].to_numpy().view(np.uint64), pdf["shard"].to_numpy(), pdf["asks"].to_numpy(), radius)
        return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)}).drop_duplicates()

    edges = materialise(met.withColumn("task", F.pmod(F.col("shard"), F.lit(tasks)))
                        .groupBy("task").applyInPandas(run, "a long, b long"), "edges")
    nodes = edges.select(F.col("a").alias("print")).union(edges.select("b")).distinct()
    return connected_components(nodes, edges, "print")


def grouped(df: DataFrame, shingle: int = 4, radius: int = 4, id_col: str = "doc_id",
            text_col: str = "text", agree: int = 2) -> DataFrame:
    """The result of ``simhash_groups`` with row, the number of the row, and
    stays, whether it is the component's first by id (NULL last), then row."""
    rows = df.select(F.col(id_col).alias("doc_id"), F.monotonically_increasing_id().alias("row"),
                     text_of(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch, data, offsets in slices(batches):
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(fingerprints(data, offsets, shingle).view(np.int64))],
                ["doc_id", "row", "print"])

    docs = materialise(rows.mapInArrow(run, f"doc_id {kind}, row long, print long"), "fingerprints")
    lead = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("lead")
    prints = materialise(docs.groupBy("print").agg(lead), "prints")
    named = prints.join(fingerprint_components(prints.select("print"), radius, agree), "print", "left") \
        .withColumn("component", F.coalesce("component", "print"))
    named = materialise(named, "named")
    leads = named.groupBy("component").agg(F.min("lead").alias("lead"))
    heavy = heavy_keys(named, ["component"], named.count())
    names = materialise(lookup(named.select("print", "component"), leads, ["component"], heavy=heavy)
                        .select("print", F.col("lead.doc_id").alias("component_id"), F.col("lead.row").alias("lead_row")),
                        "components")
    return (lookup(docs, names, ["print"], heavy=heavy_keys(docs, ["print"], docs.count()))
            .select("doc_id", F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint"), "component_id",
                    "row", (F.col("row") == F.col("lead_row")).alias("stays")))


def simhash_groups(df: DataFrame, shingle: int = 4, radius: int = 4, id_col: str = "doc_id",
                   text_col: str = "text", agree: int = 2) -> DataFrame:
    """One row per row of ``df``: doc_id, fingerprint (16 hex digits) and
    component_id, the smallest id reachable over links of at most ``radius``
    differing bits.

    A NULL, empty or blank text has the fingerprint zero and is linked like
    any other. Repeated rows share a fingerprint and thus a component. A NULL
    id never names a component unless all its members have NULL ids. An empty
    table gives an empty result; other columns are not read. ``agree`` more
    blocks give longer, rarer keys, for more fingerprints."""
    return grouped(df, shingle, radius, id_col, text_col, agree).drop("row", "stays")


def distinct_near(df: DataFrame, shingle: int = 4, radius: int = 4, id_col: str = "doc_id",
                  text_col: str = "text") -> DataFrame:
    """One row of every component, with all its columns. ``df`` is read more
    than once and must give the same rows in the same partitions, as a table
    scan does."""
    fix_splits(df.sparkSession)
    stays = grouped(df, shingle, radius, id_col, text_col).where("stays").select(F.col("row").alias("_sigflow_row"))
    return df.withColumn("_sigflow_row", F.monotonically_increasing_id()).join(stays, "_sigflow_row", "left_semi").drop("_sigflow_row")
