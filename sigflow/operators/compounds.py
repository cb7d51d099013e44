"""Compounds as bit sets: featurisation, Tanimoto similarity join,
hierarchical clustering per group, connected components, silhouette and
drug encodings (CHM1-CHM8, FLT11).

* Featurisation (CHM1) is an Arrow-batched function: hashed character n-grams
  of the whole string (md5 of each n-gram modulo ``n_bits``), or a caller
  function run with ``mapInPandas`` (e.g. a chemistry toolkit). The default
  is **not** a Morgan fingerprint.
* The similarity join (CHM3) is an inverted index on bits. With a threshold
  t > 0 it uses prefix filtering (tokens ordered rare-first, each set
  indexed on its first |A| - ceil(t |A|) + 1 tokens, a length filter, then
  exact verification): exact for every pair with similarity >= t, without
  generating the pairs that cannot reach t. Where the index would list a large
  share of all pairs (few bits, each held by many sets), blocks of rows meet in
  matrix products instead, and no candidate leaves a task. Pairs sharing no
  bit are implicit zeros.
* Average / complete / ward linkage (CHM4) is sequential by nature, but a
  merge at a height up to the cutoff needs a pair of rows at most that far
  apart, so no cluster crosses a connected component of those pairs: the
  components are found by distributed label propagation and only the linkage
  inside one component runs in a task (quadratic in that component).
* Silhouettes (CHM6) come from sums over the pairs that share a bit; a pair
  that shares none has distance 1 and needs no row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Sequence
from typing import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sigflow.operators.components import connected_components
from sigflow.session import cut_lineage

LINKAGE_ROWS = 4096       # rows of a component whose distances are a matrix
LINKAGE_BYTES = 128 << 20 # similarity sums of clusters that a larger one remembers
LENIENT = 1.0 - 1e-9      # filters before the exact test allow for round-off
TANIMOTO_ROWS = 4096      # rows of a block of a similarity join
TANIMOTO_PAIRS = 1 << 20  # pairs of two blocks that a task holds at once
DENSE_BITS = 4096         # different bits of a group that is compared in blocks
HASHED_GRAMS = 1 << 18    # n-grams whose bit a batch remembers


# ------------------------------------------------------------------ CHM1 / CHM2
def ngram_bits(text_col: str, n: int = 5, n_bits: int = 2048) -> F.Column:
    """Sorted distinct on-bits of the hashed character n-grams of the whole
    string (empty for NULL and strings shorter than n): md5 of the n-gram
    (UTF-8), first 8 hex digits as an integer, modulo n_bits. Arrow-batched; only
    the n-grams of one string and a bounded table of hashed ones are held."""

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def bits_udf(s: pd.Series) -> pd.Series:
        return pd.Series(_hashed_bits(s, n, n_bits), index=s.index, dtype=object)

    return bits_udf(F.col(text_col))


def _hashed_bits(texts: pd.Series, n: int, n_bits: int) -> list[np.ndarray]:
    bit: dict[str, int] = {}
    out = []
    for t in texts:
        grams = set() if t is None else {t[i:i + n] for i in range(len(t) - n + 1)}
        on = {bit[g] for g in grams if g in bit}
        hashed = {g: int(hashlib.md5(g.encode()).hexdigest()[:8], 16) % n_bits for g in grams if g not in bit}
        on.update(hashed.values())
        if len(bit) + len(hashed) > HASHED_GRAMS:
            bit.clear()
        if len(hashed) <= HASHED_GRAMS:
            bit.update(hashed)
        out.append(np.array(sorted(on), dtype=np.int32))
    return out


def dense_bits(bits_col: str, n_bits: int) -> F.Column:
    """On-bit list -> dense 0/1 vector (O(bits) per row), written straight into
    the Arrow buffer of the batch."""

    @F.arrow_udf(T.ArrayType(T.DoubleType()))
    def dense_udf(s: pa.Array) -> pa.Array:
        held = pc.fill_null(pc.list_value_length(s), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        on = pc.list_flatten(s).to_numpy(zero_copy_only=False).astype(np.int64)
        out = np.zeros((len(s), n_bits))
        out[np.repeat(np.arange(len(s)), held), on] = 1.0
        ends = np.arange(len(s) + 1, dtype=np.int32) * np.int32(n_bits)
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(out.reshape(-1)))

    return dense_udf(F.col(bits_col))


def featurize(df: DataFrame, key: str, text: str, n: int = 5, n_bits: int = 2048,
              fn: Callable[[str], Sequence[int] | None] | None = None) -> DataFrame:
    """CHM1: one row per key with its on-bit set; strings that give no bit
    (or that ``fn`` rejects with None) are dropped."""
    base = df.where(F.col(text).isNotNull()).select(key, text)
    if fn is None:
        out = base.select(key, ngram_bits(text, n, n_bits).alias("bits"))
    else:
        ktype = df.schema[key].dataType.simpleString()

        def run(it):
            for pdf in it:
                bits = pdf[text].map(lambda s: None if s is None else fn(s))
                bits = bits.map(lambda b: None if b is None else sorted({int(x) % n_bits for x in b}))
                yield pd.DataFrame({key: pdf[key], "bits": bits})

        out = base.mapInPandas(run, f"{key} {ktype}, bits array<int>")
    return out.where(F.col("bits").isNotNull() & (F.size("bits") > 0))


def descriptors(df: DataFrame, key: str, text: str,
                fn: Callable[[str], Sequence[float]] | None = None) -> DataFrame:
    """CHM2: numeric descriptor vector per string; non-finite values -> 0.
    The default descriptors are simple string statistics (length, character
    class counts, ring-digit and bracket counts); pass ``fn`` for real
    chemistry descriptors."""
    if fn is None:
        t = F.col(text)
        vec = F.array(*[c.cast("double") for c in (
            F.length(t),
            F.length(F.regexp_replace(t, "[^A-Z]", "")),
            F.length(F.regexp_replace(t, "[^a-z]", "")),
            F.length(F.regexp_replace(t, "[^0-9]", "")),
            F.length(F.regexp_replace(t, "[^\\[\\]()]", "")),
            F.length(F.regexp_replace(t, "[^=#]", "")),
        )])
        out = df.where(t.isNotNull()).select(key, vec.alias("desc"))
    else:
        ktype = df.schema[key].dataType.simpleString()

        def run(it):
            for pdf in it:
                vals = pdf[text].map(lambda s: None if s is None else [float(v) for v in fn(s)])
                yield pd.DataFrame({key: pdf[key], "desc": vals})

        out = df.select(key, text).mapInPandas(run, f"{key} {ktype}, desc array<double>")
    clean = F.transform("desc", lambda x: F.when(F.isnan(x) | (F.abs(x) == float("inf")), F.lit(0.0))
                        .otherwise(x))
    return out.where(F.col("desc").isNotNull()).withColumn("desc", clean)


SILHOUETTE_ROWS = 4096       # rows of a block in a silhouette
SMALL_COMPONENT = 256        # rows of a component that shares a task with others
COMPONENT_SHARES = 64        # tasks that a group's small components are dealt to


# ------------------------------------------------------------------ CHM3
def _salted_self_join(tok: DataFrame, g: list[str], salt_rows: int, also: F.Column | None = None) -> DataFrame:
    """Pairs (a, b, na, nb), a < b, of the rows (_k, _n) of a token. A token
    held by very many sets is salted: its rows are split into S sub-buckets (S
    grows with the token's frequency) and every (bucket, bucket) pair is its
    own join key, so one hot token becomes S^2 balanced tasks."""
    freq = tok.groupBy(*g, "_t").agg(
        F.greatest(F.lit(1), F.ceil(F.sqrt(F.count("*") / F.lit(float(salt_rows))))).cast("int").alias("_nsalt"))
    ts = tok.join(freq, g + ["_t"]).withColumn("_salt", F.pmod(F.xxhash64("_k"), F.col("_nsalt")).cast("int"))
    seq = F.sequence(F.lit(0), F.col("_nsalt") - 1)
    a = ts.select(*g, F.col("_k").alias("a"), F.col("_n").alias("na"), "_t",
                  F.col("_salt").alias("_sa"), F.explode(seq).alias("_sb"))
    b = ts.select(*g, F.col("_k").alias("b"), F.col("_n").alias("nb"), "_t",
                  F.explode(seq).alias("_sa"), F.col("_salt").alias("_sb"))
    on = F.col("a") < F.col("b")
    return a.join(b, g + ["_t", "_sa", "_sb"]).where(on if also is None else on & also)


def tanimoto_pairs(sets: DataFrame, key: str, bits: str = "bits", threshold: float = 0.0,
                   group_cols: Sequence[str] = (), salt_rows: int = 4096, block_rows: int = TANIMOTO_ROWS,
                   forest: bool = False, carry: Sequence[str] = (), sum_by: tuple[str, str] | None = None) -> DataFrame:
    """CHM3: (group..., a, b, inter, sim) for a < b in the same group with
    |A^B| > 0 and sim >= threshold; sim = |A^B| / (|A| + |B| - |A^B|).

    A group of up to ``DENSE_BITS`` different bits whose index would list a
    large share of its pairs is compared in blocks of ``block_rows`` rows by
    matrix products, and only pairs of the result leave a task; the others go
    through the index (all of them with ``block_rows`` 0). With ``forest`` a
    block gives no more links than its rows need to stay connected: enough for
    components, with at most two rows' worth of links a row and block. Columns
    ``carry`` come as ``a_<name>`` and ``b_<name>``. With ``sum_by``, (label,
    weight) of the columns of ``carry``, the pairs are added up where they are
    made: (group..., x, y, s) for labels x < y, s the sum of sim times both rows'
    weights."""
    g, carry = list(group_cols), list(carry)
    s = (sets.select(*g, F.col(key).alias("_k"), F.col(bits).alias("_b"), *carry)
         .withColumn("_n", F.size("_b")).withColumn("_one", F.lit(0)))
    for c in [*g, "_k"]:
        s = s.where(F.col(c).isNotNull())              # a NULL group or key has no pairs
    s = cut_lineage(s.where(F.col("_n") > 0))
    tok = s.select(*g, "_one", "_k", "_n", F.explode("_b").alias("_t"))
    freq = tok.groupBy(*g, "_t").agg(F.count("*").alias("_f"))
    listed, t = tok, float(threshold) * LENIENT
    if threshold > 0:
        wp = Window.partitionBy(*g, "_k", "_n").orderBy("_f", "_t")    # rare tokens first; a row that stands twice counts once
        pref = (tok.join(freq, g + ["_t"]).withColumn("_pos", F.dense_rank().over(wp))
                .where(F.col("_pos") <= F.col("_n") - F.ceil(F.col("_n") * t) + 1))
        listed = pref.select(*g, "_one", "_k", "_n", "_t")
    dense, indexed = None, s
    if block_rows:
        of = [*g, "_one"]
        number = F.count("*").cast("double")
        plan = (s.groupBy(*of).agg(number.alias("_rows"))
                .join(tok.groupBy(*of, "_t").agg(F.lit(1)).groupBy(*of).agg(number.alias("_width")), of)
                .join(listed.groupBy(*of, "_t").agg(number.alias("_f"))
                      .groupBy(*of).agg(F.sum(F.col("_f") * F.col("_f")).alias("_listed")), of))
        many = (F.col("_rows") <= block_rows) | (F.col("_listed") * 16 >= F.col("_rows") * F.col("_rows"))
        plan = cut_lineage(plan.select(*of, "_rows", ((F.col("_width") <= DENSE_BITS) & many).alias("_dense")))
        if not plan.where("_dense").isEmpty():
            dense = _tanimoto_blocks(s.join(plan.where("_dense").drop("_dense"), of), g, carry, threshold, block_rows, forest, sum_by)
        rest = plan.where(~F.col("_dense")).select(*of)
        indexed = None if rest.isEmpty() else s.join(rest, of, "left_semi")
        listed = listed.join(rest, of, "left_semi")
    sides = [F.col(f"{x}_{c}") for x in "ab" for c in carry]
    sim = F.col("inter") / (F.col("na") + F.col("nb") - F.col("inter"))
    parts = [] if dense is None else [dense if sum_by else dense.select(*g, "a", "b", "inter", (F.col("inter") / F.col("both")).alias("sim"), *sides)]
    if indexed is not None or dense is None:
        indexed = s if indexed is None else indexed
        listed = listed.select(*g, "_k", "_n", "_t")
        if threshold <= 0:
            # every pair sharing a bit is output
            pairs = (_salted_self_join(listed, g, salt_rows)
                     .groupBy(*g, "a", "b", "na", "nb").agg(F.count("*").alias("inter")))
        else:
            cand = (_salted_self_join(listed, g, salt_rows,
                                      (F.col("nb") >= F.col("na") * t) & (F.col("na") >= F.col("nb") * t))
                    .select(*g, "a", "b", "na", "nb").distinct())
            sa = indexed.select(*g, F.col("_k").alias("a"), F.col("_b").alias("_ba"))
            sb = indexed.select(*g, F.col("_k").alias("b"), F.col("_b").alias("_bb"))
            pairs = (cand.join(sa, g + ["a"]).join(sb, g + ["b"])
                     .withColumn("inter", F.size(F.array_intersect("_ba", "_bb")).cast("bigint"))
                     .drop("_ba", "_bb"))
        out = pairs.withColumn("sim", sim).select(*g, "a", "b", "inter", "sim")
        if threshold > 0:
            out = out.where(F.col("sim") >= F.lit(float(threshold)))
        for x in "ab" if carry else "":
            out = out.join(indexed.select(*g, F.col("_k").alias(x), *[F.col(c).alias(f"{x}_{c}") for c in carry]).distinct(), g + [x])
        if sum_by:
            (xa, xb), (wa, wb) = ([F.col(f"{v}_{c}") for v in "ab"] for c in sum_by)
            out = out.where(xa != xb).select(*g, F.least(xa, xb).alias("x"), F.greatest(xa, xb).alias("y"),
                                             (F.col("sim") * wa * wb).alias("s"))
        parts.append(out if sum_by else out.select(*g, "a", "b", "inter", "sim", *sides))
    out = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return out.groupBy(*g, "x", "y").agg(F.sum("s").alias("s")) if sum_by else out


def _many_tasks(df: DataFrame) -> int:
    """Tasks for groups of few bytes and much work, which Spark would otherwise
    put into a handful of tasks for their size."""
    return 16 * df.sparkSession.sparkContext.defaultParallelism


def _tanimoto_blocks(rows: DataFrame, g: list[str], carry: list[str], threshold: float, block_rows: int,
                     forest: bool, sum_by: tuple[str, str] | None) -> DataFrame:
    """(group..., a, b, inter, both) of groups (``_rows`` rows each), both the size
    of two sets together less what they share, from blocks
    of rows compared with each other. A block is packed into one row of bits, so
    that a task gets two of them and holds ``TANIMOTO_PAIRS`` pairs. Without a
    threshold the rows of one key (and size and ``carry``) add up to one set with
    repeats, as in the index. ``sum_by``: (group..., x, y, s), where a label of at
    most ``block_rows`` rows lies in one block."""
    merge = threshold <= 0
    kind = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    at = F.xxhash64("_k")
    if sum_by:
        size = rows.groupBy(*g, sum_by[0]).agg(F.count("*").alias("_held"))
        rows = rows.join(size, [*g, sum_by[0]])
        at = F.when(F.col("_held") > block_rows, at).otherwise(F.xxhash64(F.col(sum_by[0])))
    number = F.ceil(F.col("_rows") / F.lit(block_rows)).cast("int")
    rows = (rows.withColumn("_nb", number).withColumn("_blk", F.pmod(at, F.col("_nb")).cast("int"))
            .withColumn("_b", F.filter("_b", lambda v: v.isNotNull()))
            .select(*g, "_one", "_nb", "_blk", "_k", "_n", "_b", *carry))

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        held = pdf["_b"].map(len).to_numpy()
        names, of = np.unique(np.concatenate(list(pdf["_b"])), return_inverse=True)
        _, place = np.unique(pdf["_k"].to_numpy(), return_inverse=True)
        row, lead = np.arange(len(pdf)), np.arange(len(pdf))
        if merge:
            _, lead, row = np.unique(np.stack([place, pdf["_n"].to_numpy(), *[pd.factorize(pdf[c])[0] for c in carry]]),
                                     axis=1, return_index=True, return_inverse=True)
        on = np.zeros((len(lead), len(names)), np.int32)
        if merge:
            np.add.at(on, (np.repeat(row.ravel(), held), of), 1)
        else:
            on[np.repeat(row, held), of] = 1
        order = np.lexsort([place[lead], *([pd.factorize(pdf[sum_by[0]], sort=True)[0][lead]] if sum_by else [])])
        on, lead = on[order], lead[order]
        planes = max(1, int(on.max(initial=0)).bit_length())
        cells = b"".join(np.packbits((on >> p & 1).astype(np.uint8), axis=1).tobytes() for p in range(planes))
        first = {c: [pdf[c].iloc[0]] for c in [*g, "_one", "_nb", "_blk"]}
        return pd.DataFrame(first | {f"_all{c}": [pdf[c].to_numpy()[lead]] for c in ["_k", "_n", *carry]}
                            | {"_names": [names], "_planes": [planes], "_cells": [cells]})

    lists = ", ".join(f"`_all{c}` array<{kind[c]}>" for c in ["_k", "_n", *carry])
    same = ", ".join([*[f"`{c}` {kind[c]}" for c in g], "_one int, _nb int, _blk int"])
    blocks = rows.groupBy(*g, "_one", "_nb", "_blk").applyInPandas(
        pack, f"{same}, {lists}, _names {kind['_b']}, _planes int, _cells binary")
    side = (blocks.withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_nb") - 1)))
            .withColumn("_x", F.least("_blk", "_o")).withColumn("_y", F.greatest("_blk", "_o")).drop("_nb", "_o")
            .repartition(_many_tasks(rows), *g, "_one", "_x", "_y"))

    def fn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(batches), ignore_index=True)
        x, y = pdf["_x"].iloc[0], pdf["_y"].iloc[0]
        two = {r["_blk"]: r for r in pdf.to_dict("records")}
        if x not in two or y not in two:               # a block without rows
            return
        names = np.unique(np.concatenate([r["_names"] for r in two.values()]))
        sides = [_Side(two[v], names, carry) for v in ((x,) if x == y else (x, y))]
        left, right = sides[0], sides[-1]
        if sum_by:
            yield from _summed(left, right, sum_by, pdf[g].iloc[0].to_dict())
            return
        rank = np.unique(left.key, return_inverse=True)[1] if x == y else None
        # inter - c (na + nb) >= 0 is sim >= threshold: two more columns of the product
        c = threshold / (1 + threshold)
        lean = 0.01 + 1e-5 * max(left.n.max(), right.n.max())             # the exact test follows
        lhs, rhs = left.on, right.on
        if threshold > 0:
            one = lambda v: np.ones((len(v.n), 1), np.float32)
            part = lambda v: (-c * v.n[:, None]).astype(np.float32)
            lhs, rhs = np.hstack([lhs, part(left), one(left)]), np.hstack([rhs, one(right), part(right)])
        links = np.zeros((len(left.n), len(right.n)) if forest else (0, 0), bool)
        step = max(1, TANIMOTO_PAIRS // max(1, len(right.n)))
        for at in range(0, len(left.n), step):
            skip = at if x == y and not forest else 0  # a block with itself: rows in order of keys, so pairs come later
            inter = lhs[at:at + step] @ rhs[skip:].T
            hit = inter >= -lean if threshold > 0 else inter > 0
            if x == y:
                hit &= rank[at:at + step, None] != rank[None, :] if forest else rank[at:at + step, None] < rank[None, skip:]
            i, j = np.nonzero(hit)
            inter = inter[i, j]
            i, j = i + at, j + skip
            both = left.n[i] + right.n[j]
            if threshold > 0:
                inter = np.rint(inter + c * both)
            inter = inter.astype(np.int64)
            both -= inter
            if threshold > 0:
                good = inter > 0
                good[good] = inter[good] / both[good] >= threshold
                i, j, inter, both = i[good], j[good], inter[good], both[good]
            if forest:
                links[i, j] = True
            elif len(i):
                yield found(left, right, i, j, inter, both, pdf)
        if forest:
            i, j = _spanning_links(links)
            if len(i):
                inter = np.einsum("ij,ij->i", left.on[i], right.on[j]).astype(np.int64)
                yield found(left, right, i, j, inter, left.n[i] + right.n[j] - inter, pdf)

    def found(left: _Side, right: _Side, i: np.ndarray, j: np.ndarray, inter: np.ndarray, both: np.ndarray,
              pdf: pd.DataFrame) -> pd.DataFrame:
        swap = left.key[i] > right.key[j]
        pair = lambda u, v: (np.where(swap, v, u), np.where(swap, u, v))
        a, b = pair(left.key[i], right.key[j])
        cols = {c: pdf[c].to_numpy()[np.zeros(len(i), np.int64)] for c in g} | {"a": a, "b": b, "inter": inter, "both": both}
        more = {c: pair(left.more[c][i], right.more[c][j]) for c in carry}
        return pd.DataFrame(cols | {f"{s}_{c}": v[k] for k, s in enumerate("ab") for c, v in more.items()})

    groups = "".join(f"`{c}` {kind[c]}, " for c in g)
    if sum_by:
        schema = f"{groups}x {kind[sum_by[0]]}, y {kind[sum_by[0]]}, s double"
    else:
        schema = ", ".join([f"{groups}a {kind['_k']}, b {kind['_k']}, inter bigint, both bigint",
                            *[f"`{x}_{c}` {kind[c]}" for x in "ab" for c in carry]])
    return side.groupBy(*g, "_one", "_x", "_y").applyInPandas(fn, schema)


class _Side:
    """A packed block: keys, sizes, carried columns and the matrix of its bits."""

    def __init__(self, r: dict, names: np.ndarray, carry: list[str]):
        self.key, self.n = np.asarray(r["_all_k"]), np.asarray(r["_all_n"], np.int64)
        self.more = {c: np.asarray(r[f"_all{c}"]) for c in carry}
        own, rows = np.asarray(r["_names"]), len(self.n)
        cells = np.frombuffer(r["_cells"], np.uint8).reshape(r["_planes"], rows, -1)
        self.on = np.zeros((rows, len(names)), np.float32)
        at = np.searchsorted(names, own)
        for p in range(r["_planes"]):
            self.on[:, at] += np.unpackbits(cells[p], axis=1, count=len(own)) * np.float32(1 << p)


def _summed(left: _Side, right: _Side, sum_by: tuple[str, str], group: dict) -> Iterator[pd.DataFrame]:
    """(group..., x, y, s) of two blocks: the similarities of different keys,
    times both weights, added up by their labels."""
    label, weight = sum_by
    la, lb = left.more[label], right.more[label]                          # in order
    lead = np.flatnonzero(np.concatenate([[True], lb[1:] != lb[:-1]]))
    wa, wb = left.more[weight].astype(np.float64), right.more[weight].astype(np.float64)
    _, code = np.unique(np.concatenate([left.key, right.key]), return_inverse=True)
    ka, kb = code[:len(la)], code[len(la):]
    again = left is right or len(np.intersect1d(ka, kb)) > 0
    kinds, begin = np.unique(la, return_index=True)
    edges = np.append(begin, len(la))
    step = max(1, TANIMOTO_PAIRS // max(1, len(lb)))
    for k, name in enumerate(kinds):
        total = np.zeros(len(lead))
        for at in range(edges[k], edges[k + 1], step):
            end = min(at + step, edges[k + 1])
            inter = (left.on[at:end] @ right.on.T).astype(np.float64)
            both = left.n[at:end, None] + right.n[None, :] - inter        # 0 or below only for sets with repeats
            sim = np.divide(inter, both, out=np.zeros_like(inter), where=both != 0)
            if again:
                sim[ka[at:end, None] == kb[None, :]] = 0.0
            total += np.add.reduceat((wa[at:end] @ sim) * wb, lead)
        on = (total != 0) & ((lb[lead] > name) if left is right else (lb[lead] != name))
        other = lb[lead][on]
        if len(other):
            yield pd.DataFrame({c: [v] * len(other) for c, v in group.items()}
                               | {"x": np.minimum(other, name), "y": np.maximum(other, name), "s": total[on]})


def _spanning_links(links: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest (rows, columns) of the links between two sides; every
    row and column is looked at once."""
    rows_left, cols_left = links.any(1), links.any(0)
    out: list[tuple[np.ndarray, np.ndarray]] = []
    for first in np.flatnonzero(rows_left):
        if not rows_left[first]:
            continue
        rows = np.array([first])
        rows_left[first] = False
        while len(rows):
            part = links[rows]
            cols = np.flatnonzero(part.any(0) & cols_left)
            cols_left[cols] = False
            out.append((rows[part[:, cols].argmax(0)], cols))
            part = links[:, cols]
            rows = np.flatnonzero(part.any(1) & rows_left)
            rows_left[rows] = False
            out.append((rows, cols[part[rows].argmax(1)] if len(rows) else rows))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(v) for v in zip(*out))


# ------------------------------------------------------------------ linkage
def _tanimoto_dense(bit_lists: Sequence[Sequence[int]], n_bits: int) -> np.ndarray:
    n = len(bit_lists)
    M = np.zeros((n, n_bits), dtype=np.float64)
    for i, b in enumerate(bit_lists):
        M[i, np.asarray(b, dtype=np.int64)] = 1.0
    sim = M @ M.T                                     # one matrix of n x n: rows by hundreds in place
    cnt = M.sum(axis=1)
    for a in range(0, n, 256):
        inter = sim[a:a + 256]
        union = cnt[a:a + 256, None] + cnt[None, :] - inter
        sim[a:a + 256] = np.divide(inter, union, out=np.zeros_like(inter), where=union > 0)
    np.fill_diagonal(sim, 1.0)
    return sim


def linkage_clusters(D: np.ndarray, cutoff: float, method: str = "average", overwrite: bool = False) -> np.ndarray:
    """Flat clusters of agglomerative clustering cut at ``cutoff`` (every
    merge with height <= cutoff applied; heights are monotone for these
    methods). Lance-Williams updates; nearest neighbours cached per row.
    Returns 0-based cluster number per row (clusters numbered by their
    smallest row). ``overwrite``: ``D`` may be used as scratch."""
    n = len(D)
    if n == 0:
        return np.zeros(0, dtype=np.int64)
    D = np.asarray(D, dtype=np.float64) if overwrite else np.array(D, dtype=np.float64, copy=True)
    np.fill_diagonal(D, np.inf)
    size = np.ones(n)
    active = np.ones(n, dtype=bool)
    parent = np.arange(n)
    nn = D.argmin(axis=1)
    nd = D[np.arange(n), nn]
    for _ in range(n - 1):
        cand = np.where(active, nd, np.inf)
        i = int(np.argmin(cand))
        h = cand[i]
        if not np.isfinite(h) or h > cutoff:
            break
        j = int(nn[i])
        if j < i:
            i, j = j, i
        si, sj, sk = size[i], size[j], size
        di, dj = D[i], D[j]
        if method == "average":
            new = (si * di + sj * dj) / (si + sj)
        elif method == "complete":
            new = np.maximum(di, dj)
        elif method == "single":
            new = np.minimum(di, dj)
        elif method == "ward":
            dij = D[i, j]
            with np.errstate(invalid="ignore"):
                new = np.sqrt(np.maximum(((sk + si) * di ** 2 + (sk + sj) * dj ** 2 - sk * dij ** 2)
                                         / (sk + si + sj), 0.0))
        else:
            raise ValueError(f"unknown linkage {method!r}")
        new[~active] = np.inf
        D[i, :] = new
        D[:, i] = new
        D[i, i] = np.inf
        D[j, :] = np.inf
        D[:, j] = np.inf
        active[j] = False
        size[i] = si + sj
        parent[parent == j] = i
        # refresh cached nearest neighbours touched by the merge
        stale = active & ((nn == i) | (nn == j))
        stale[i] = True
        for r in np.flatnonzero(stale):
            nn[r] = int(np.argmin(D[r]))
            nd[r] = D[r, nn[r]]
        better = active & (new < nd)
        better[i] = False
        nn[better] = i
        nd[better] = new[better]
    roots = parent
    first = {}
    out = np.empty(n, dtype=np.int64)
    for r in range(n):
        c = roots[r]
        if c not in first:
            first[c] = len(first)
        out[r] = first[c]
    return out


class _Sums:
    """Sums of the similarities of clusters with every row of a component, from
    packed bits: no matrix of pairs. What clusters had last is remembered up to
    ``LINKAGE_BYTES``, the largest first, as it costs most to make again."""

    def __init__(self, bit_lists: Sequence[np.ndarray], n_bits: int, sim_threshold: float | None):
        self.n, words = len(bit_lists), max(1, -(-n_bits // 64))
        bits = np.zeros((self.n, words * 8), np.uint8)
        for i, b in enumerate(bit_lists):
            np.bitwise_or.at(bits[i], b >> 3, (1 << (b & 7)).astype(np.uint8))
        self.words = np.ascontiguousarray(bits.view("<u8").T)             # by word, so that rows lie together
        self.count = np.bitwise_count(self.words).sum(0, dtype=np.int64)
        self.low = sim_threshold
        self.held: dict[int, np.ndarray] = {}
        self.most = max(2, LINKAGE_BYTES // (8 * self.n))

    def row(self, r: int) -> np.ndarray:
        inter = np.zeros(self.n, np.int64)
        for w in self.words:
            inter += np.bitwise_count(w & w[r])
        both = self.count + self.count[r] - inter
        sim = np.divide(inter, both, out=np.zeros(self.n), where=both > 0)
        if self.low is not None:
            sim[sim < self.low] = 0.0
        return sim

    def of(self, cluster: int, members: list[int]) -> np.ndarray:
        if cluster not in self.held:
            total = self.row(members[0])
            for r in members[1:]:
                total += self.row(r)
            return total
        return self.held[cluster]

    def keep(self, cluster: int, total: np.ndarray, size: np.ndarray) -> None:
        self.held[cluster] = total
        if len(self.held) > self.most:
            del self.held[min(self.held, key=lambda c: size[c])]


def average_linkage(bit_lists: Sequence[np.ndarray], n_bits: int, cutoff: float,
                    sim_threshold: float | None = None) -> np.ndarray:
    """``linkage_clusters`` with average linkage on 1 - Tanimoto of on-bit
    lists, in memory that grows with the rows: the distances of a cluster are
    summed from its rows whenever they are needed. The same merges in the same
    order, but for distances that are equal up to round-off."""
    sums = _Sums(bit_lists, n_bits, sim_threshold)
    n = sums.n
    members = {i: [i] for i in range(n)}
    size, active, of = np.ones(n), np.ones(n, bool), np.arange(n)

    def distances(c: int, total: np.ndarray) -> np.ndarray:
        d = 1.0 - np.bincount(of, total, n) / (size * size[c])
        d[~active] = np.inf
        d[c] = np.inf
        return d

    nn, nd = np.zeros(n, np.int64), np.full(n, np.inf)
    for r in range(n):
        d = 1.0 - sums.row(r)
        d[r] = np.inf
        nn[r] = d.argmin()
        nd[r] = d[nn[r]]
    while True:
        i = int(np.argmin(nd))
        if not np.isfinite(nd[i]) or nd[i] > cutoff:
            break
        i, j = sorted((i, int(nn[i])))
        total = sums.of(i, members[i]) + sums.of(j, members[j])
        sums.held.pop(j, None)
        members[i] += members[j]
        of[members.pop(j)] = i
        size[i] += size[j]
        active[j], nd[j] = False, np.inf
        sums.keep(i, total, size)
        new = distances(i, total)
        stale = active & ((nn == i) | (nn == j))
        stale[i] = False
        nn[i] = new.argmin()
        nd[i] = new[nn[i]]
        for r in np.flatnonzero(stale):
            # beyond the cutoff a cluster is never merged, nor are later ones nearer: averages only lie between
            if nd[r] > cutoff:
                continue
            d = distances(r, sums.of(r, members[r]))
            nn[r] = d.argmin()
            nd[r] = d[nn[r]]
        better = active & (new < nd)
        better[i] = False
        nn[better] = i
        nd[better] = new[better]
    return np.unique(of, return_inverse=True)[1]                          # a cluster's number is its smallest row


def silhouette(D: np.ndarray, labels: np.ndarray) -> float | None:
    """Mean silhouette from a distance matrix (singletons score 0); None when
    there is one cluster or every row is its own cluster."""
    n = len(labels)
    uniq = np.unique(labels)
    if len(uniq) < 2 or len(uniq) >= n:
        return None
    s = np.zeros(n)
    for r in range(n):
        own = labels == labels[r]
        if own.sum() <= 1:
            continue
        a = D[r, own & (np.arange(n) != r)].mean()
        b = min(D[r, labels == c].mean() for c in uniq if c != labels[r])
        m = max(a, b)
        s[r] = 0.0 if m == 0 else (b - a) / m
    return float(s.mean())


def cluster_groups(sets: DataFrame, key: str, group_col: str, bits: str = "bits",
                   n_bits: int = 2048, cutoff: float = 0.6, method: str = "average",
                   sim_threshold: float | None = None) -> DataFrame:
    """CHM4 (+CHM5/CHM6 parts): per group, distance 1 - Tanimoto (values
    below ``sim_threshold`` set to 0 first, FLT11), linkage cut at
    ``cutoff`` < 1. Returns (group, key, cluster_id (1-based, by smallest
    key), n_clusters, silhouette)."""
    if not 0 <= cutoff < 1:
        raise ValueError("cutoff must be at least 0 and below 1")
    gtype = sets.schema[group_col].dataType
    ktype = sets.schema[key].dataType
    rows = sets.select(group_col, key, bits)
    near = max((1.0 - cutoff) * LENIENT, sim_threshold or 0.0)
    edges = tanimoto_pairs(rows, key, bits, threshold=near, group_cols=[group_col], forest=True)
    comp = connected_components(rows, edges, key, group_cols=[group_col])
    several = comp.groupBy(group_col, "component").agg(F.count("*").alias("_size"))
    rows = rows.join(comp, [group_col, key]).join(several, [group_col, "component"])
    schema = T.StructType([T.StructField(group_col, gtype), T.StructField(key, ktype), T.StructField("_first", ktype)])

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(key).reset_index(drop=True)
        used, at = np.unique(np.concatenate([*pdf[bits], np.zeros(1, np.int64)]), return_inverse=True)
        ends = np.cumsum(pdf[bits].map(len))                  # only the bits in use: the same similarities
        lists = np.split(at[:-1], ends[:-1])
        if len(pdf) > LINKAGE_ROWS and method == "average":
            lab = average_linkage(lists, len(used), cutoff, sim_threshold)
        else:
            sim = _tanimoto_dense(lists, len(used))
            if sim_threshold is not None:
                sim[sim < sim_threshold] = 0.0
                np.fill_diagonal(sim, 1.0)
            lab = linkage_clusters(np.subtract(1.0, sim, out=sim), cutoff, method, overwrite=True)
        lead = np.unique(lab, return_index=True)[1]
        return pd.DataFrame({group_col: pdf[group_col], key: pdf[key],
                             "_first": pdf[key].to_numpy()[lead[lab]]})

    def fn(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.concat([one(part) for _, part in pdf.groupby("component", sort=False)], ignore_index=True)

    # small components are dealt to a task several at a time, a larger one has its own
    small = F.col("_size") <= SMALL_COMPONENT
    several_at_once = [F.when(small, F.pmod(F.xxhash64("component"), F.lit(COMPONENT_SHARES))),
                       F.when(~small, F.col("component"))]
    alone = rows.where(F.col("_size") == 1).select(group_col, key, F.col(key).alias("_first"))
    dealt = rows.where(F.col("_size") > 1).withColumns({"_share": several_at_once[0], "_alone": several_at_once[1]})
    dealt = dealt.repartition(_many_tasks(rows), group_col, "_share", "_alone")
    joined = dealt.groupBy(group_col, "_share", "_alone").applyInPandas(fn, schema).unionByName(alone)
    joined = cut_lineage(joined)                     # used by every step below
    first = joined.select(group_col, "_first").distinct()
    number = F.row_number().over(Window.partitionBy(group_col).orderBy("_first")).cast("bigint")
    sil = silhouette_groups(sets.join(joined, [group_col, key]), key, group_col, "_first", bits, sim_threshold)
    counts = first.groupBy(group_col).agg(F.count("*").alias("n_clusters"))
    return (joined.join(first.withColumn("cluster_id", number), [group_col, "_first"])
            .join(counts, group_col).join(sil, group_col)
            .select(group_col, key, "cluster_id", "n_clusters", "silhouette"))


def silhouette_groups(sets: DataFrame, key: str, group_col: str, label_col: str, bits: str = "bits",
                      sim_threshold: float | None = None) -> DataFrame:
    """CHM6 for given labels: per group, mean silhouette of ``label_col`` on
    1 - Tanimoto distances (NULL for 1 or n clusters). Rows with a NULL label
    are a cluster of their own.

    Rows meet in blocks of ``SILHOUETTE_ROWS``; a task adds up similarities by
    cluster with a matrix product and no pair leaves it. A cluster of at most
    that many rows lies in one block, whose task takes the nearest of them; for
    larger ones, at most one a block, the sums of each row are added up."""
    lab = sets.select(group_col, F.col(key).alias("_i"), F.col(label_col).alias("_l"), F.col(bits).alias("_b"))
    lab = cut_lineage(lab)
    size = lab.groupBy(group_col, "_l").agg(F.count("*").alias("_m"))
    group = size.groupBy(group_col).agg(F.count("*").alias("_k"), F.sum("_m").alias("_n"))
    held = size.select(F.col(group_col).alias("_g2"), F.col("_l").alias("_l2"), "_m")
    rows = (lab.join(held, (F.col(group_col) == F.col("_g2")) & F.col("_l").eqNullSafe(F.col("_l2")))
            .drop("_g2", "_l2").join(group, group_col))
    parts = F.ceil(F.col("_n") / F.lit(SILHOUETTE_ROWS)).cast("int")
    big = F.col("_m") > SILHOUETTE_ROWS
    rows = rows.withColumn("_nb", parts).withColumn("_blk", F.pmod(F.when(big, F.xxhash64("_i")).otherwise(
        F.xxhash64("_l")), F.col("_nb")).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.col("_nb") - 1))
    side = rows.select(group_col, "_i", "_l", "_b", "_m", F.col("_blk").alias("_cb"), every.alias("_qb"), F.lit(1).alias("_role")) \
        .unionByName(rows.select(group_col, "_i", "_l", "_b", "_m", every.alias("_cb"),
                                 F.pmod(F.xxhash64("_i"), F.col("_nb")).cast("int").alias("_qb"), F.lit(0).alias("_role")))

    def fn(pdf: pd.DataFrame) -> pd.DataFrame:
        q, c = pdf[pdf["_role"] == 0], pdf[pdf["_role"] == 1].sort_values("_i")
        if not len(q) or not len(c):
            return pd.DataFrame({x: [] for x in (group_col, "_i", "_own", "_near", "_lj", "_s")})
        names, of = np.unique(np.concatenate([*q["_b"], *c["_b"], np.zeros(1, np.int64)]), return_inverse=True)
        n = np.concatenate([q["_b"].map(len), c["_b"].map(len)]).astype(np.int64)
        on = np.zeros((len(n), len(names)), np.float32)
        on[np.repeat(np.arange(len(n)), n), of[:-1]] = 1
        code, kinds = pd.factorize(pd.Series([*q["_l"], *c["_l"]], dtype=object), use_na_sentinel=False)
        mine, theirs = code[:len(q)], code[len(q):]
        members = pd.Series(c["_m"].to_numpy()).groupby(theirs).first().reindex(range(len(kinds)), fill_value=0).to_numpy()
        own, near, far = np.zeros(len(q)), np.full(len(q), np.inf), []
        order = np.argsort(theirs, kind="stable")
        here, lead = np.unique(theirs[order], return_index=True)
        small = (members[here] <= SILHOUETTE_ROWS)
        step = max(1, (1 << 22) // len(c))
        for a in range(0, len(q), step):
            inter = (on[a:a + step][:len(q) - a] @ on[len(q):].T).astype(np.float64)
            some = inter.shape[0]
            both = n[a:a + some, None] + n[None, len(q):] - inter
            sim = np.divide(inter, both, out=np.zeros_like(inter), where=both > 0)
            if sim_threshold is not None:
                sim[sim < sim_threshold] = 0.0
            sim[q["_i"].to_numpy()[a:a + some, None] == c["_i"].to_numpy()[None, :]] = 0.0
            sums = np.add.reduceat(sim[:, order], lead, axis=1)
            is_own = here[None, :] == mine[a:a + some, None]
            own[a:a + some] = np.where(is_own, sums, 0.0).sum(1)
            reach = np.where(small & ~is_own, 1.0 - sums / members[here], np.inf)
            near[a:a + some] = reach.min(1)
            i, j = np.nonzero(~is_own & ~small)
            far.append((i + a, here[j], sums[i, j]))
        i, j, v = (np.concatenate(x) for x in zip(*far))
        ids, group_value = q["_i"].to_numpy(), pdf[group_col].iloc[0]
        return pd.DataFrame({group_col: [group_value] * (len(q) + len(i)), "_i": np.concatenate([ids, ids[i]]),
                             "_own": np.concatenate([own, np.zeros(len(i))]), "_near": np.concatenate([near, np.full(len(i), np.inf)]),
                             "_lj": [None] * len(q) + [kinds[x] for x in j], "_s": np.concatenate([np.full(len(q), np.nan), v])})      # NaN arrives as NULL

    kind = {f.name: f.dataType.simpleString() for f in lab.schema.fields}
    found = side.repartition(_many_tasks(side), group_col, "_qb", "_cb").groupBy(group_col, "_qb", "_cb").applyInPandas(
        fn, f"`{group_col}` {kind[group_col]}, _i {kind['_i']}, _own double, _near double, _lj {kind['_l']}, _s double")
    large = size.where(big).select(group_col, F.col("_l").alias("_lj"), F.col("_m").alias("_mj"))
    found = cut_lineage(found)
    sums = (found.where(F.col("_s").isNotNull()).groupBy(group_col, "_i", "_lj").agg(F.sum("_s").alias("_s"))
            .join(large, [group_col, "_lj"]).groupBy(group_col, "_i").agg(F.min(1.0 - F.col("_s") / F.col("_mj")).alias("_far")))
    near = found.where(F.col("_s").isNull()).groupBy(group_col, "_i").agg(F.sum("_own").alias("_own"), F.min("_near").alias("_near"))
    per = (rows.select(group_col, "_i", "_m", "_k", "_n").join(near, [group_col, "_i"]).join(sums, [group_col, "_i"], "left"))
    a = F.when(F.col("_m") > 1, 1.0 - F.try_divide(F.col("_own"), F.col("_m") - 1))
    b = F.least(F.col("_near"), F.coalesce("_far", F.lit(float("inf"))))
    per = per.withColumn("_a", a).withColumn("_b", b)
    high = F.greatest("_a", "_b")
    s = F.when(F.col("_a").isNull() | (high == 0), 0.0).otherwise(F.try_divide(F.col("_b") - F.col("_a"), high))
    return (per.groupBy(group_col, "_k", "_n").agg(F.avg(s).alias("_s"))
            .select(group_col, F.when((F.col("_k") >= 2) & (F.col("_k") < F.col("_n")), F.col("_s")).alias("silhouette")))


# ------------------------------------------------------------------ CHM7 / CHM8
def category_index(train: DataFrame, col: str) -> DataFrame:
    """Sorted distinct categories of the training rows with their 0-based
    index (the table has one row per category)."""
    d = cut_lineage(train.select(col).where(F.col(col).isNotNull()).distinct())
    # sorted ranges, counted, then numbered within: no task holds all categories
    ranged = cut_lineage(d.repartitionByRange(col).sortWithinPartitions(col)
                         .withColumn("_id", F.monotonically_increasing_id()))
    part = F.shiftright("_id", 33)                     # ranges in rising order, rows numbered within
    counts = ranged.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_at"))   # a row a range
    return (ranged.withColumn("_part", part).join(F.broadcast(starts), "_part")
            .select(col, (F.col("_at") + F.col("_id") - F.shiftleft(F.col("_part"), 33)).cast("int").alias("_index")))


def label_encode(df: DataFrame, index: DataFrame, col: str, out: str = "label_code") -> DataFrame:
    """CHM8: sorted class index (NULL for classes unseen in training)."""
    return df.join(index, col, "left").withColumnRenamed("_index", out)


def one_hot(df: DataFrame, index: DataFrame, col: str, out: str = "onehot") -> DataFrame:
    """CHM7: dense 0/1 vector over the training categories; unseen
    categories give the zero vector (unknowns ignored)."""
    n = index.count()   # number of categories
    j = df.join(index, col, "left")
    vec = F.transform(F.sequence(F.lit(0), F.lit(max(n, 1) - 1)),
                      lambda i: F.when(i == F.col("_index"), 1.0).otherwise(0.0))
    return j.withColumn(out, vec if n > 0 else F.array().cast("array<double>")).drop("_index")
