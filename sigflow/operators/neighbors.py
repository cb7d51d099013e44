"""Exact k-nearest neighbours and neighbour-label purity (ANA6-ANA8, AGG16,
AGG17).

Blocks have ``block_rows`` rows, or what makes ``BLOCKS`` of them of the largest
group up to ``MOST`` times as many: so long as they can grow, a row meets no more
blocks however many rows there are. A group (the whole input, or one cell line)
of no more rows is one block: one ``applyInPandas`` task compares it with itself. A larger group
gets a pivot index, and two blocks meet only where the triangle inequality
leaves room for a neighbour:

* up to ``PIVOTS`` rows of the group are its pivots; every row knows its
  distance to all of them and belongs to the cell of the nearest. Cells are cut
  into rings by that distance, and rows that no ring can part (copies) by hash,
  so a block has about ``block_rows`` rows whatever the data;
* a block keeps the smallest and largest distance of its rows to each pivot,
  and each row the distance of its k-th neighbour inside its own block, an upper
  bound of the true one;
* ``|d(q, p) - d(x, p)| <= d(q, x)`` for every pivot p bounds the distance from
  a row, or a block, to a block from below. Pairs of blocks are tested first,
  then every row against the blocks left to it; only rows that may find a
  neighbour in a block are shipped to it, with one copy of the block for the
  rows of up to ``SPAN`` others.

All copies of a vector have the same neighbours, and only their first k ids can
be anyone's: one row of a vector asks, k of it are candidates, and the lists are
then given to every copy. Where the bounds rule out nothing (vectors without any
structure) the shuffle falls back to a copy of a row for every block. The lists of the blocks are
merged by a per-query ``row_number``; nothing all-pairs is emitted.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sigflow.functions.vectors import attach_group_values, standardize
from sigflow.session import cut_lineage

PIVOTS = 64        # pivots of a group
BLOCKS = 32        # blocks of the largest group before they hold more rows
MOST = 8           # times the given rows that a block may hold
CELLS = 1 << 22    # distances held at once in a task
SPAN = 4           # blocks whose rows share one copy of a candidate block
SUMMARIES = 1024   # block bounds compared in one task
SLACK = 1e-9       # share of the distances by which a bound is loosened for round-off


def _matrix(rows: pd.Series) -> np.ndarray:
    return np.vstack(rows.to_numpy()).astype(np.float64)


def _squares(Q: np.ndarray, C: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Squared distances by one matrix product, and their round-off bound by row."""
    qq, cc = np.einsum("ij,ij->i", Q, Q), np.einsum("ij,ij->i", C, C)
    slack = 4 * (Q.shape[1] + 8) * np.finfo(np.float64).eps * (qq + cc.max())
    return qq[:, None] + cc[None, :] - 2.0 * Q @ C.T, slack


def _nearest(q: pd.DataFrame, c: pd.DataFrame, k: int, key_names: list[str], id_name: str, carry: list[str]) -> pd.DataFrame:
    """The k nearest rows of ``c`` for every row of ``q``."""
    C = _matrix(c["_v"])
    cid = c[id_name].to_numpy()
    keep = min(k, len(c))
    out = []
    step = max(1, CELLS // len(c))
    for at in range(0, len(q), step):
        part = q.iloc[at:at + step]
        Q = _matrix(part["_v"])
        d2, slack = _squares(Q, C)
        # every candidate whose d2 is within twice the round-off bound of the
        # k-th smallest may be among the k nearest: all of them are compared
        # exactly, so ties are decided by id whatever the blocks are
        bound = np.partition(d2, keep - 1, axis=1)[:, keep - 1] + 2 * slack
        rows_c, rows_d = [], []
        for i in range(len(part)):
            cand = np.flatnonzero(d2[i] <= bound[i])
            diff = C[cand] - Q[i]                         # one query at a time
            exact = np.sqrt(np.einsum("ij,ij->i", diff, diff))
            o = np.lexsort((cid[cand], exact))[:keep]
            rows_c.append(cand[o])
            rows_d.append(exact[o])
        qi, ci = np.repeat(np.arange(len(part)), keep), np.concatenate(rows_c)
        cols = {x: part[x].to_numpy()[qi] for x in key_names}
        cols |= {"q_id": part[id_name].to_numpy()[qi], "c_id": cid[ci], "dist": np.concatenate(rows_d)}
        cols |= {f"q_{x}": part[x].to_numpy()[qi] for x in carry}
        cols |= {f"c_{x}": c[x].to_numpy()[ci] for x in carry}
        out.append(pd.DataFrame(cols))
    return pd.concat(out, ignore_index=True)


def _measured(base: DataFrame, g: list[str], id_col: str) -> DataFrame:
    """Rows with their distances to the group's pivots (``_pd``). Pivots are the
    first rows by hash, at most as many as the group has blocks; each part of a
    group gets its own copy of them."""
    order = Window.partitionBy(*g).orderBy(F.xxhash64(F.col(id_col), F.lit(1)), id_col)
    pivots = (base.select(*g, id_col, "_v", "_nb").withColumn("_j", F.row_number().over(order))
              .where((F.col("_j") <= PIVOTS) & (F.col("_j") <= F.col("_nb")))
              .select(*g, F.col("_v").alias("_pivot"), "_j", F.explode(F.sequence(F.lit(0), F.col("_nb") - 1)).alias("_part")))
    parts = base.withColumn("_part", F.pmod(F.xxhash64(F.col(id_col)), F.col("_nb")).cast("int"))

    def fn(rows: pd.DataFrame, piv: pd.DataFrame) -> pd.DataFrame:
        if not len(rows):
            return rows.assign(_pd=pd.Series([], dtype=object))
        V = _matrix(rows["_v"])
        P = _matrix(piv.sort_values("_j")["_pivot"])
        far = np.stack([np.sqrt(np.square(V - p).sum(axis=1)) for p in P], axis=1)
        return rows.assign(_pd=list(far))

    schema = T.StructType(list(parts.schema.fields) + [T.StructField("_pd", T.ArrayType(T.DoubleType()))])
    keys = [*g, "_part"]
    return parts.groupBy(*keys).cogroup(pivots.groupBy(*keys)).applyInPandas(fn, schema).drop("_part")


def _blocked(rows: DataFrame, g: list[str], id_col: str, block_rows: int) -> DataFrame:
    """Rows with their block ``_b``. A cell below a quarter of the mean block is
    dissolved into the others; cells are cut into rings from counts by radius
    (256 steps an octave), a step of more than ``block_rows`` rows by hash."""
    def nearest(kept=None):
        at = F.transform("_pd", lambda d, i: F.struct(d.alias("d"), i.alias("i")))
        return F.array_min(at if kept is None else F.filter(at, lambda s: F.array_contains(kept, s["i"])))

    first = rows.select(*g, "_nb", nearest()["i"].alias("_cell")).groupBy(*g, "_nb", "_cell").agg(F.count("*").alias("_n"))
    cells = first.groupBy(*g, "_nb").agg(F.collect_list(F.struct("_cell", "_n")).alias("_l"))     # at most PIVOTS entries
    total = F.aggregate("_l", F.lit(0).cast("long"), lambda a, s: a + s["_n"])
    kept = cells.select(*g, F.transform(F.filter("_l", lambda s: s["_n"] * F.col("_nb") * 4 >= total),
                                        lambda s: s["_cell"]).alias("_kept"))
    x = attach_group_values(rows, kept, g, ["_kept"])
    x = x.withColumn("_at", nearest(F.col("_kept"))).drop("_kept")
    x = (x.withColumn("_cell", F.col("_at.i"))
         .withColumn("_step", F.when(F.col("_at.d") > 0, F.floor(F.log2(F.col("_at.d")) * 256)).otherwise(F.lit(-(1 << 20))))
         .drop("_at"))
    size, keys = F.lit(block_rows), [*g, "_cell"]
    steps = x.groupBy(*keys, "_step").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*keys).orderBy("_step")) - F.col("_n")
    last = F.greatest(F.floor(F.sum("_n").over(Window.partitionBy(*keys)) / size) - 1, F.lit(0))
    steps = steps.select(*keys, "_step", F.least(F.floor(before / size), last).alias("_ring"),
                         F.ceil(F.col("_n") / size).alias("_cuts"))
    x = x.join(steps, [*keys, "_step"])
    part = F.pmod(F.xxhash64(F.col(id_col), F.lit(2)), F.col("_cuts"))
    block = F.shiftleft(F.col("_cell").cast("long"), 56) + F.shiftleft(F.col("_ring").cast("long"), 28) + part
    return x.withColumn("_b", block).drop("_cell", "_step", "_ring", "_cuts")


def _bounded(rows: DataFrame, g: list[str], k: int) -> DataFrame:
    """Rows with ``_u``, an upper bound of the k-th distance from their own block;
    the first row of a block also carries its bounds ``_lo``, ``_hi`` by pivot, its
    size ``_n`` and its largest ``_u``, ``_tau``."""
    def fn(pdf: pd.DataFrame) -> pd.DataFrame:
        V = _matrix(pdf["_v"])
        if len(pdf) < k:
            u = np.full(len(pdf), np.inf)
        else:
            u, step = [], max(1, CELLS // len(V))
            for at in range(0, len(V), step):
                d2, slack = _squares(V[at:at + step], V)
                u.append(np.sqrt(np.maximum(np.partition(d2, k - 1, axis=1)[:, k - 1] + 2 * slack, 0)))
            u = np.concatenate(u)
        D = _matrix(pdf["_pd"])
        none = [None] * (len(pdf) - 1)
        return pdf.assign(_u=u, _lo=[D.min(axis=0)] + none, _hi=[D.max(axis=0)] + none,
                          _n=pd.array([len(pdf)] + none, dtype="Int64"), _tau=[float(u.max())] + none)

    arr = T.ArrayType(T.DoubleType())
    schema = T.StructType(list(rows.schema.fields) + [
        T.StructField("_u", T.DoubleType()), T.StructField("_lo", arr), T.StructField("_hi", arr),
        T.StructField("_n", T.LongType()), T.StructField("_tau", T.DoubleType())])
    return rows.groupBy(*g, "_b").applyInPandas(fn, schema)


def _block_pairs(blocks: DataFrame, g: list[str]) -> DataFrame:
    """(group, _a, _b): blocks _b that may hold a neighbour of a row of block _a,
    from chunks of ``SUMMARIES`` block bounds against each other."""
    chunks = blocks.groupBy(*g).agg(F.ceil(F.count("*") / SUMMARIES).cast("int").alias("_nc"))
    x = attach_group_values(blocks, chunks, g, ["_nc"]).withColumn("_c", F.pmod(F.xxhash64("_b"), F.col("_nc")).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.col("_nc") - 1))
    cols = [*g, "_b", "_lo", "_hi", "_tau"]
    both = (x.select(*cols, F.col("_c").alias("_ca"), every.alias("_cb"), F.lit(0).alias("_role"))
            .unionByName(x.select(*cols, every.alias("_ca"), F.col("_c").alias("_cb"), F.lit(1).alias("_role"))))

    def fn(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = pdf[pdf["_role"] == 0], pdf[pdf["_role"] == 1]
        found = []
        if len(a) and len(b):
            lo, hi = _matrix(b["_lo"]), _matrix(b["_hi"])
            for i, (la, ha, tau) in enumerate(zip(a["_lo"], a["_hi"], a["_tau"])):
                gap = np.maximum(lo - ha, la - hi).max(axis=1)
                found.append((i, np.flatnonzero(gap - SLACK * (np.max(ha) + hi.max(axis=1)) <= tau)))
        at = np.concatenate([np.full(len(f), i) for i, f in found]) if found else np.array([], dtype=int)
        to = np.concatenate([f for _, f in found]) if found else at
        return pd.DataFrame({**{x: a[x].to_numpy()[at] for x in g}, "_a": a["_b"].to_numpy()[at], "_b": b["_b"].to_numpy()[to]})

    schema = T.StructType([blocks.schema[x] for x in g] + [T.StructField("_a", T.LongType()), T.StructField("_b", T.LongType())])
    return both.groupBy(*g, "_ca", "_cb").applyInPandas(fn, schema)


def _needed(rows: DataFrame, blocks: DataFrame, pairs: DataFrame, g: list[str], k: int) -> DataFrame:
    """Rows with ``_need``: the (block, tile) pairs they must be compared with.
    A row's blocks are tested in slices of 4 * ``SUMMARIES``."""
    span = F.floor((F.row_number().over(Window.partitionBy(*g, "_b").orderBy("_a")) - 1) / SPAN)
    piece = F.floor((F.row_number().over(Window.partitionBy(*g, "_a").orderBy("_b")) - 1) / (4 * SUMMARIES))
    pairs = cut_lineage(pairs.withColumn("_tile", span).withColumn("_slice", piece))
    sides = pairs.join(blocks.select(*g, "_b", "_lo", "_hi", "_n"), [*g, "_b"])
    slices = pairs.groupBy(*g, F.col("_a").alias("_b")).agg(F.max("_slice").alias("_last"))
    x = (rows.drop("_lo", "_hi", "_n", "_tau", "_nb").join(slices, [*g, "_b"])
         .withColumn("_slice", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_last")))).drop("_last"))
    x = x.withColumnRenamed("_b", "_a")

    def fn(q: pd.DataFrame, to: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(to):
            return q.iloc[:0].drop(columns=["_pd", "_u"]).assign(_need=pd.Series([], dtype=object))
        D, u, most = _matrix(q["_pd"]), q["_u"].to_numpy().copy(), _matrix(q["_pd"]).max(axis=1)
        lo, hi, n = _matrix(to["_lo"]), _matrix(to["_hi"]), to["_n"].to_numpy()
        # a block of k rows lies wholly within its upper bound
        for j in np.flatnonzero(n >= k):
            u = np.minimum(u, (D + hi[j]).min(axis=1) * (1 + SLACK))
        keep = np.stack([np.maximum(lo[j] - D, D - hi[j]).max(axis=1) - SLACK * (most + hi[j].max()) <= u
                         for j in range(len(to))], axis=1)
        block, tile = to["_b"].to_numpy(), to["_tile"].to_numpy()
        need = [[{"_b": int(block[j]), "_tile": int(tile[j])} for j in np.flatnonzero(r)] for r in keep]
        return q.drop(columns=["_pd", "_u"]).assign(_need=need)

    entry = T.StructType([T.StructField("_b", T.LongType()), T.StructField("_tile", T.LongType())])
    fields = [f for f in x.schema.fields if f.name not in ("_pd", "_u")]
    schema = T.StructType(fields + [T.StructField("_need", T.ArrayType(entry))])
    keys = [*g, "_a", "_slice"]
    return x.groupBy(*keys).cogroup(sides.groupBy(*keys)).applyInPandas(fn, schema)


def indexed_tiles(base: DataFrame, id_col: str, k: int, g: list[str], carry: list[str], block_rows: int) -> DataFrame:
    """Rows to compare, by (group, ``_b``, ``_tile``): queries (``_role`` 0) and
    the rows of block ``_b`` (``_role`` 1). ``base`` holds ``_v``, ``_nb`` and
    ``_asks``, true for queries."""
    rows = _blocked(cut_lineage(_measured(cut_lineage(base), g, id_col)), g, id_col, block_rows)
    rows = cut_lineage(_bounded(rows, g, k))
    blocks = rows.where(F.col("_lo").isNotNull()).select(*g, "_b", "_lo", "_hi", "_n", "_tau")
    asked = cut_lineage(_needed(rows, blocks, _block_pairs(blocks, g), g, k).where("_asks"))
    cols = [*g, id_col, "_v", *carry, "_b", "_tile"]
    queries = asked.withColumn("_e", F.explode("_need")).select(*g, id_col, "_v", *carry, "_e._b", "_e._tile")
    tiles = asked.select(*g, F.explode("_need").alias("_e")).select(*g, "_e._b", "_e._tile").distinct()
    cands = rows.select(*g, id_col, "_v", *carry, "_b").join(tiles, [*g, "_b"])
    return (queries.select(*cols, F.lit(0).alias("_role"))
            .unionByName(cands.select(*cols, F.lit(1).alias("_role"))))


def knn(df: DataFrame, id_col: str, vec_col: str, k: int = 5,
        group_cols: Sequence[str] = (), carry: Sequence[str] = (),
        scale: bool = True, block_rows: int = 2048) -> DataFrame:
    """Exact Euclidean k nearest neighbours of every row among the rows of
    its group (self included, as the reference's ``kneighbors`` on the fitted
    data). With ``scale`` the vectors are standardised first (population std,
    fitted per group). Ties are broken by candidate id.

    Returns (group..., q_id, c_id, dist, rank, q_<carry>, c_<carry>).
    """
    g = list(group_cols)
    carry = list(carry)
    base = df.select(*g, id_col, vec_col, *carry)
    if scale:
        base = standardize(base, vec_col, g, out_col="_v").drop(vec_col)
    else:
        base = base.withColumn("_v", F.transform(vec_col, lambda x: x.cast("double"))).drop(vec_col)
    largest = df.groupBy(*g).agg(F.count("*").alias("_n")).agg(F.max("_n")).first()[0] or 0
    block_rows = min(max(block_rows, -(-largest // BLOCKS)), MOST * block_rows)

    def blocks_of(x: DataFrame) -> DataFrame:
        return x.groupBy(*g).agg(F.greatest(F.lit(1), F.ceil(F.count("*") / F.lit(block_rows))).cast("int").alias("_nb"))

    fields = {f.name: f.dataType for f in base.schema.fields}
    schema = T.StructType(
        [T.StructField(x, fields[x]) for x in g]
        + [T.StructField("q_id", fields[id_col]), T.StructField("c_id", fields[id_col]),
           T.StructField("dist", T.DoubleType())]
        + [T.StructField(f"q_{x}", fields[x]) for x in carry]
        + [T.StructField(f"c_{x}", fields[x]) for x in carry])
    columns = schema.fieldNames()
    w = Window.partitionBy(*g, "q_id").orderBy("dist", "c_id")

    def first_k(local: DataFrame) -> DataFrame:
        return local.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)

    if largest <= block_rows:
        # every group is one block: each row's list is whole
        alone = base if g else base.withColumn("_one", F.lit(0))
        return first_k(alone.groupBy(*(g or ["_one"])).applyInPandas(
            lambda p: _nearest(p, p, k, g, id_col, carry)[columns], schema))

    def fn(pdf: pd.DataFrame) -> pd.DataFrame:
        q, c = pdf[pdf["_role"] == 0], pdf[pdf["_role"] == 1]
        if not len(q) or not len(c):
            return pd.DataFrame({x: [] for x in columns})
        return _nearest(q, c, k, g, id_col, carry)[columns]

    base = cut_lineage(base)
    copies = Window.partitionBy(*g, "_v")
    few = base.withColumn("_place", F.row_number().over(copies.orderBy(id_col))).where(F.col("_place") <= k)
    few = cut_lineage(few.withColumn("_asks", F.col("_place") == 1).drop("_place"))
    tiles = indexed_tiles(attach_group_values(few, blocks_of(few), g, ["_nb"]), id_col, k, g, carry, block_rows)
    near = first_k(tiles.groupBy(*g, "_b", "_tile").applyInPandas(fn, schema))
    if few.where("_asks").count() == base.count():
        return near
    asking = few.where("_asks").select(*g, "_v", F.col(id_col).alias("_asker"))
    members = base.join(asking, [*g, "_v"]).select(
        *g, "_asker", F.col(id_col).alias("q_id"), *[F.col(x).alias(f"q_{x}") for x in carry])
    lists = near.drop(*[f"q_{x}" for x in carry]).withColumnRenamed("q_id", "_asker")
    return members.join(lists, [*g, "_asker"]).select(*columns, "rank")


def label_key(c) -> F.Column:
    """Label as compared by purity: string, NULL -> 'unknown'."""
    return F.coalesce(F.col(c).cast("string") if isinstance(c, str) else c.cast("string"),
                      F.lit("unknown"))


def neighbor_purity(df: DataFrame, id_col: str, vec_col: str, label_col: str, k: int = 5,
                    group_cols: Sequence[str] = (), scale: bool = True,
                    block_rows: int = 2048) -> DataFrame:
    """ANA7: share of the non-self neighbours among the k nearest (self
    included in k, as in the reference) that carry the query's label.
    Self is excluded by id, not by position. Returns (group..., id, label,
    nn_purity)."""
    g = list(group_cols)
    nn = knn(df, id_col, vec_col, k, g, carry=[label_col], scale=scale, block_rows=block_rows)
    same = (label_key(f"q_{label_col}") == label_key(f"c_{label_col}")).cast("double")
    return (nn.where(F.col("q_id") != F.col("c_id"))
            .groupBy(*g, "q_id", f"q_{label_col}")
            .agg(F.avg(same).alias("nn_purity"))
            .withColumnRenamed("q_id", id_col)
            .withColumnRenamed(f"q_{label_col}", label_col))


def class_purity_stats(sample_stats: DataFrame, label_col: str,
                       group_cols: Sequence[str] = ()) -> DataFrame:
    """AGG16: per class mean/std(ddof 1)/count of nn_purity, the 1/n_classes
    baseline and lift = mean / baseline; also the class-frequency baseline.
    Null labels form no class (pandas groupby drops them). The samples are
    written once: they are read twice, and neighbours stand behind them."""
    g = list(group_cols)
    lab = cut_lineage(sample_stats.where(F.col(label_col).isNotNull()))
    per = lab.groupBy(*g, label_col).agg(
        F.avg("nn_purity").alias("mean"), F.stddev_samp("nn_purity").alias("std"),
        F.count("nn_purity").alias("count"))
    tot = lab.groupBy(*g).agg(F.count_distinct(label_col).alias("_ncls"),
                              F.count("*").alias("_ntot"))
    per = attach_group_values(per, tot, g, ["_ncls", "_ntot"])
    return (per.withColumn("random_baseline", 1.0 / F.col("_ncls"))
            .withColumn("lift", F.col("mean") / F.col("random_baseline"))
            .withColumn("freq_baseline", F.col("count") / F.col("_ntot"))
            .drop("_ncls", "_ntot"))


def global_purity(sample_stats: DataFrame, label_col: str,
                  group_cols: Sequence[str] = ()) -> DataFrame:
    """AGG16 summary: global mean purity, baseline and lift."""
    g = list(group_cols)
    return (sample_stats.groupBy(*g).agg(
        F.avg("nn_purity").alias("global_purity"),
        F.count_distinct(label_col).alias("n_classes"))
        .withColumn("random_baseline", 1.0 / F.col("n_classes"))
        .withColumn("lift", F.col("global_purity") / F.col("random_baseline")))


def median_across_groups(class_stats: DataFrame, label_col: str,
                         cols: Sequence[str] = ("mean", "std", "count", "random_baseline", "lift")
                         ) -> DataFrame:
    """AGG17: median of the per-group class statistics for each label."""
    return class_stats.groupBy(label_col).agg(
        *[F.median(F.col(c).cast("double")).alias(c) for c in cols])
