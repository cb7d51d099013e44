"""Near-duplicate vectors by random hyperplanes.

Every table has hyperplanes of its own; the signs of a vector's products with
them are its bucket there. Vectors that meet in a bucket are compared by exact
cosine, in blocks, and a pair counts in the first table where it meets. A task
reports how many vectors each of its own links to and a spanning forest of the
links, never the pairs. Components come from alternating star contractions of
that forest, distributed.

Equal vectors are one class with a weight. Planes in a table are chosen so that
a bucket holds about ``BUCKET`` classes, and tables so that a pair at the
threshold itself is met with probability ``recall``; closer pairs are met more
often. A bucket of more than ``PART`` classes is split, and its parts meet
pairwise in tasks of their own.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigflow.llm.common import discard, materialise
from sigflow.llm.simhash import union
from sigflow.operators.components import heavy_keys, lookup

BUCKET = 1024                # classes in a bucket, on average
PART = 16_384                # classes of a bucket that one task compares with as many others
TILE = 1024                  # rows and columns of a block of cosines
BATCH = 4096                 # classes hashed at once
SEED = 13


# ------------------------------------------------------------------ vectors
def usable(vector: str) -> Column:
    """Whether a vector can link: not NULL, all components finite, one not zero."""
    fine = F.forall(F.col(vector), lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.coalesce(fine & F.exists(F.col(vector), lambda v: v != 0), F.lit(False))


def unit(x: np.ndarray) -> np.ndarray:
    """Rows in double precision, scaled to length one without overflow."""
    x = x.astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def plan(n: int, threshold: float, recall: float) -> tuple[int, int]:
    """(planes of a table, tables)."""
    planes = max(1, min(30, math.ceil(math.log2(max(n, 2) / BUCKET))))
    alike = (1 - math.acos(max(-1.0, min(1.0, threshold))) / math.pi) ** planes
    tables = 1 if alike >= recall else math.ceil(math.log(1 - recall) / math.log(1 - alike))
    return planes, tables


def bucket_keys(x: np.ndarray, planes: int, tables: int, seed: int) -> np.ndarray:
    """The bucket of every row in every table, (rows, tables)."""
    normals = np.random.default_rng([seed, x.shape[1]]).standard_normal((x.shape[1], planes * tables))
    signs = (x @ normals > 0).reshape(len(x), tables, planes)
    return (signs * (1 << np.arange(planes, dtype=np.int64))).sum(2).astype(np.uint32)


def deal(classes: DataFrame, planes: int, tables: int, seed: int) -> DataFrame:
    """A row for every class and table: (width, place: table and bucket, class,
    n, keys: the buckets of all tables, x)."""
    kind = np.float32 if classes.schema["vec"].dataType.elementType.simpleString() == "float" else np.float64

    def run(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, BATCH):
                part = batch.slice(a, BATCH)
                vec = part.column(part.schema.get_field_index("vec"))
                size = np.diff(vec.offsets.to_numpy())
                flat = vec.flatten().to_numpy(zero_copy_only=False)
                at = np.cumsum(size) - size
                for width in np.unique(size):
                    rows = np.flatnonzero(size == width)
                    x = flat[at[rows][:, None] + np.arange(width)].astype(kind)
                    keys = bucket_keys(unit(x), planes, tables, seed)
                    place = (np.arange(tables, dtype=np.int64) << planes) + keys
                    take = pa.array(np.repeat(rows, tables))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(rows) * tables, width, np.int32)), pa.array(place.reshape(-1)),
                         part.column(part.schema.get_field_index("class")).take(take),
                         part.column(part.schema.get_field_index("n")).take(take),
                         _blobs(keys).take(pa.array(np.repeat(np.arange(len(rows)), tables))),
                         _blobs(x).take(pa.array(np.repeat(np.arange(len(rows)), tables)))],
                        ["width", "place", "class", "n", "keys", "x"])

    return classes.select("class", "n", "vec").mapInArrow(run, "width int, place long, class long, n long, keys binary, x binary")


def _blobs(rows: np.ndarray) -> pa.Array:
    """Every row of a matrix as bytes."""
    flat = np.ascontiguousarray(rows)
    fixed = pa.Array.from_buffers(pa.binary(flat.dtype.itemsize * flat.shape[1]), len(flat), [None, pa.py_buffer(flat.tobytes())])
    return fixed.cast(pa.binary())


def _rows(column: pa.Array, kind) -> np.ndarray:
    n = len(column)
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(n, -1)


def split_hot(met: DataFrame, part: int) -> DataFrame:
    """``met`` with (low, high, side): the parts of a bucket meet pairwise, a
    row standing on side 0 (low), 1 (high) or 2 (both). Buckets of up to
    ``part`` rows are one part."""
    hot = materialise(met.groupBy("width", "place").agg(F.count("*").alias("rows")).where(F.col("rows") > part), "hot")
    whole = [F.lit(0).alias("low"), F.lit(0).alias("high"), F.lit(2).alias("side")]
    if hot.isEmpty():
        return met.select("*", *whole)
    mine = F.pmod(F.xxhash64("class"), F.col("parts")).cast("int")
    few = hot.select("width", "place", F.ceil(F.col("rows") / part).cast("int").alias("parts"))
    cold = met.join(few, ["width", "place"], "left_anti").select("*", *whole)
    pairs = (met.join(few, ["width", "place"]).withColumn("mine", mine)
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
             .select(*met.columns, F.least("mine", "other").alias("low"), F.greatest("mine", "other").alias("high"),
                     F.when(F.col("mine") == F.col("other"), 2).when(F.col("mine") < F.col("other"), 0).otherwise(1).alias("side")))
    return cold.unionByName(pairs)


def runs(batches, names: list[str]):
    """Rows of sorted Arrow batches that agree in ``names``, as one table at a time."""
    held, last = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        key = np.stack([batch.column(batch.schema.get_field_index(n)).to_numpy() for n in names])
        cut = [0, *(np.flatnonzero((key[:, 1:] != key[:, :-1]).any(0)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cut, cut[1:]):
            now = tuple(key[:, a].tolist())
            if held and now != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = now
    if held:
        yield pa.Table.from_batches(held)


def tiles(side: np.ndarray):
    """Blocks (rows, columns) that hold every pair to compare once or, within
    one block, twice: low with high, and pairs of rows on both sides."""
    low, high, both = (np.flatnonzero(side == s) for s in (0, 1, 2))
    cut = lambda at: [at[a:a + TILE] for a in range(0, len(at), TILE)]
    yield from ((a, b) for a in cut(low) for b in cut(high))
    own = cut(both)
    yield from ((a, b) for i, a in enumerate(own) for b in own[i:])


def compare(table: pa.Table, threshold: float, planes: int, kind) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(classes, their links first met in this bucket's table, members, companions) of one bucket."""
    c = table.column("class").to_numpy()
    weight = table.column("n").to_numpy()
    x = unit(_rows(table.column("x").combine_chunks(), kind))
    keys = _rows(table.column("keys").combine_chunks(), np.uint32)
    at = int(table.column("place")[0].as_py()) >> planes
    links, label = np.zeros(len(c), np.int64), np.arange(len(c))
    for a, b in tiles(table.column("side").to_numpy()):
        near = x[a] @ x[b].T >= threshold
        if a[0] == b[0]:
            near = np.triu(near, 1)
        i, j = np.nonzero(near)
        if not len(i):
            continue
        i, j = a[i], b[j]
        label = union(label, i, j)
        fresh = np.ones(len(i), bool)
        for t in range(at):
            fresh &= keys[i, t] != keys[j, t]
        i, j = i[fresh], j[fresh]
        np.add.at(links, i, weight[j])
        np.add.at(links, j, weight[i])
    some, out = np.flatnonzero(links), np.flatnonzero(label != np.arange(len(c)))
    return c[some], links[some], c[out], c[label[out]]


# ------------------------------------------------------------------ components
def star_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for the nodes of ``edges`` (longs), the component
    being its smallest node. Large stars tie every node's larger neighbours to
    its smallest one, small stars the others; each pair of steps is written
    out, and edges never grow in number. Hubs are joined apart."""
    edge = lambda u, v: (F.greatest(u, v).alias("u"), F.least(u, v).alias("v"))
    now = materialise(edges.select(*edge(F.col(a), F.col(b))).where("u > v").distinct(), "edges")
    state = None
    while True:
        stand = now.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("h")).first()
        if (stand["n"], stand["h"]) == state or not stand["n"]:
            break
        state = stand["n"], stand["h"]
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        larger = lookup(both.where("v > u"), least, ["u"], heavy=heavy_keys(both, ["u"], 2 * stand["n"]))
        large = materialise(larger.select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        smaller = lookup(large, least, ["u"], heavy=heavy_keys(large, ["u"], large.count()))
        small = smaller.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").unionByName(
            least.select("u", F.col("m").alias("v")))
        old, now = now, materialise(small.distinct(), "edges")
        discard(old)
        discard(large)
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()


# ------------------------------------------------------------------ operator
def near_vectors(df: DataFrame, threshold: float = 0.9, recall: float = 0.99, id_col: str = "vec_id",
                 vec_col: str = "embedding", seed: int = SEED) -> DataFrame:
    """One row per row of ``df``: vec_id, n_links (other rows within the
    threshold that were found), component_id (smallest id reachable over
    links, itself included) and kept (vec_id = component_id).

    Vectors that are NULL, empty, zero or hold NULL or non-finite components
    link with nothing, nor do vectors of different lengths. No link is below
    the threshold, which must be above 0; one just at it is found with
    probability ``recall``, equal vectors always. Repeated rows are rows of
    their own and link. A NULL id is left out when the smallest is taken; a
    component of NULL ids only has a NULL id and its rows are kept. An empty
    table gives an empty result; other columns are not read."""
    wide = df.schema[vec_col].dataType.elementType.simpleString()
    rows = df.select(F.col(id_col).alias("vec_id"),
                     F.col(vec_col).cast("array<float>" if wide == "float" else "array<double>").alias("vec"))
    good = rows.where(usable("vec"))
    kind = np.float32 if wide == "float" else np.float64
    classes = materialise(good.groupBy("vec").agg(F.count("*").alias("n"), F.min("vec_id").alias("least"))
                          .withColumn("class", F.monotonically_increasing_id()), "classes")
    planes, tables = plan(classes.count(), threshold, recall)
    met = deal(classes, planes, tables, seed)
    shard = ["width", "place", "low", "high"]

    def run(batches):
        for bucket in runs(batches, shard):
            c, links, member, companion = compare(bucket, threshold, planes, kind)
            n, m = len(c), len(member)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([c, member])), pa.array(np.concatenate([links, np.zeros(m, np.int64)])),
                 pa.array(np.concatenate([np.zeros(n, np.int64), companion]), mask=np.arange(n + m) < n)],
                ["class", "links", "companion"])

    found = materialise(split_hot(met, PART).repartition(*shard).sortWithinPartitions(*shard)
                        .mapInArrow(run, "class long, links long, companion long"), "links")
    parts = star_components(found.where("companion IS NOT NULL").select("class", "companion"), "class", "companion")
    links = found.groupBy("class").agg(F.sum("links").alias("links"))
    named = materialise(classes.join(links, "class", "left")
                        .join(parts.select(F.col("node").alias("class"), "component"), "class", "left")
                        .select("vec", "least", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"),
                                F.coalesce("component", "class").alias("component")), "named")
    leads = named.groupBy("component").agg(F.min("least").alias("component_id"))
    known = lookup(named.select("vec", "n_links", "component"), leads, ["component"],
                   heavy=heavy_keys(named, ["component"], named.count())).drop("component")
    heavy = heavy_keys(good, ["vec"], good.count())
    out = lookup(good, known, ["vec"], heavy=heavy).select("vec_id", "n_links", "component_id")
    rest = rows.where(~usable("vec")).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.unionByName(rest).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
