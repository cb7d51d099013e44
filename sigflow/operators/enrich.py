"""Pre-ranked enrichment (ANA9) and single-sample variation scores (ANA10).

Both use the closed form of the running-sum walk on hits only: for a set
with H members at 1-based ranks r_1 < ... < r_H among N ranked genes, with
hit weights w, W = sum w, C_i = w_1 + ... + w_i,

    after_i  = C_i / W       - (r_i - i) / (N - H)    (walk just after hit i)
    before_i = (C_i - w_i)/W - (r_i - i) / (N - H)    (walk just before hit i)

the walk's maximum is max(after_i) and its minimum min(before_i); no
gene x set table is ever built. ``ES`` (pre-ranked) is the extreme with the
larger magnitude (a tie goes to the minimum); the max-diff score is
max(0, hi) + min(0, lo). H = N or W = 0 -> NULL.

Two plans compute the same numbers:

* ``*_long``: long form (signature, gene, value) with windows partitioned
  per signature and per (signature, set) -- plain DataFrame code, used as
  the SQL-checkable form;
* ``enrichment_vectors``: one signature per row, ``mapInPandas`` with the
  set membership shipped to the tasks (its size is bounded by the pathway
  collection, checked below), ranks by ``argsort`` -- no shuffle at all.
"""

from __future__ import annotations

from functools import lru_cache, reduce
from math import erf, exp, gamma, lgamma, pi, sqrt

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Prerank size limits applied after intersecting sets with the ranked genes
# (library defaults of the reference's call).
MIN_SIZE, MAX_SIZE = 15, 500
MEMBERSHIP_ROWS = 5_000_000       # membership rows shipped to tasks at once


def _walk_stats(hits: DataFrame, keys: list[str], rank: str, weight: str, n_col: str) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(rank)
    wa = Window.partitionBy(*keys)
    x = (hits.withColumn("_i", F.row_number().over(w))
         .withColumn("_csum", F.sum(weight).over(w.rowsBetween(Window.unboundedPreceding, 0)))
         .withColumn("_nhit", F.count("*").over(wa))
         .withColumn("_wsum", F.sum(weight).over(wa)))
    # H = N or W = 0 make the walk undefined: NULL (try_divide), not an error
    miss = F.try_divide((F.col(rank) - F.col("_i")).cast("double"), (F.col(n_col) - F.col("_nhit")).cast("double"))
    x = (x.withColumn("_after", F.try_divide(F.col("_csum"), F.col("_wsum")) - miss)
         .withColumn("_before", F.try_divide(F.col("_csum") - F.col(weight), F.col("_wsum")) - miss))
    return x.groupBy(*keys).agg(F.max("_after").alias("hi"), F.min("_before").alias("lo"),
                                F.first("_nhit").alias("n_hits"), F.first(n_col).alias("n_ranked"),
                                F.first("_wsum").alias("_wsum"))


def prerank_long(long_df: DataFrame, membership: DataFrame, key: str = "sig_id", gene: str = "gene",
                 value: str = "v", set_col: str = "pathway_id", weight_p: float = 1.0,
                 min_size: int = MIN_SIZE, max_size: int = MAX_SIZE) -> DataFrame:
    """ANA9 in long form: (key, set, es, n_hits)."""
    lv = long_df.where(F.col(value).isNotNull())
    w = Window.partitionBy(key).orderBy(F.col(value).desc(), F.col(gene))
    ranked = (lv.withColumn("_r", F.row_number().over(w))
              .withColumn("_N", F.count("*").over(Window.partitionBy(key))))
    hits = (ranked.join(membership.select(set_col, gene), gene)
            .withColumn("_w", F.pow(F.abs(value), F.lit(weight_p))))
    st = _walk_stats(hits, [key, set_col], "_r", "_w", "_N")
    es = (F.when((F.col("n_hits") < F.col("n_ranked")) & (F.col("_wsum") > 0),
                 F.when(F.abs("hi") > F.abs("lo"), F.col("hi")).otherwise(F.col("lo"))))
    return (st.where((F.col("n_hits") >= min_size) & (F.col("n_hits") <= max_size))
            .select(key, set_col, es.alias("es"), "n_hits"))


def _es_block(mat: np.ndarray, members: dict, weight_p: float, min_size: int, max_size: int,
              max_diff: bool = False, rank_weights: np.ndarray | None = None):
    """ES of every row of ``mat`` (B x d, descending-rank order by value,
    ties by position) for every set. Yields (row, set, es, H)."""
    B, d = mat.shape
    order = np.argsort(-mat, axis=1, kind="stable")
    pos = np.empty_like(order)
    np.put_along_axis(pos, order, np.arange(d)[None, :].repeat(B, 0), axis=1)
    for sid, m in members.items():
        m = m[m < d]
        H = len(m)
        if H < min_size or H > max_size:
            continue
        r = pos[:, m] + 1
        w = (np.abs(mat[:, m]) ** weight_p) if rank_weights is None else rank_weights[:, m]
        o = np.argsort(r, axis=1, kind="stable")
        r = np.take_along_axis(r, o, 1)
        w = np.take_along_axis(w, o, 1)
        C = np.cumsum(w, axis=1)
        W = C[:, -1]
        i = np.arange(1, H + 1)[None, :]
        with np.errstate(invalid="ignore", divide="ignore"):
            miss = (r - i) / (d - H) if d > H else np.full_like(r, np.nan, dtype=float)
            after = C / W[:, None] - miss
            before = (C - w) / W[:, None] - miss
        hi, lo = after.max(axis=1), before.min(axis=1)
        if max_diff:
            es = np.maximum(hi, 0) + np.minimum(lo, 0)
        else:
            es = np.where(np.abs(hi) > np.abs(lo), hi, lo)
        es = np.where((W > 0) & (d > H), es, np.nan)
        yield sid, es, H


def enrichment_vectors(df: DataFrame, membership: DataFrame, key: str = "sig_id",
                       vec_col: str = "features", set_col: str = "pathway_id", gene: str = "gene",
                       weight_p: float = 1.0, min_size: int = MIN_SIZE,
                       max_size: int = MAX_SIZE) -> DataFrame:
    """ANA9 at scale: one signature per row, gene = vector position. A
    collection of more than ``MEMBERSHIP_ROWS`` distinct members is dealt by set
    into parts of about half that size, each its own pass over the signatures."""
    held = membership.select(set_col, gene).distinct()
    n_mem = held.count()
    if n_mem > MEMBERSHIP_ROWS:
        # the size rule is on members in the matrix: others can go, and so can a set that is
        # beyond max_size in every vector; a part then cannot be much larger than its share
        n = F.array_size(vec_col)
        short, wide = df.agg(F.min(n), F.max(n)).first()
        held = held.where(F.col(gene) < F.lit(wide))
        sizes = (held.groupBy(set_col).agg(F.count("*").alias("_n"), F.count_if(F.col(gene) < F.lit(short)).alias("_in"))
                 .where(F.col("_in") <= max_size))
        n_mem = sizes.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]
        held = held.join(sizes.select(set_col), set_col, "left_semi")
    if n_mem <= MEMBERSHIP_ROWS:
        return _score_part(df, held, key, vec_col, set_col, gene, weight_p, min_size, max_size)
    parts = -(-2 * n_mem // MEMBERSHIP_ROWS)
    part = F.pmod(F.xxhash64(F.col(set_col)), F.lit(parts))
    return reduce(DataFrame.unionByName, [
        _score_part(df, held.where(part == i), key, vec_col, set_col, gene, weight_p, min_size, max_size)
        for i in range(parts)])


def _score_part(df: DataFrame, held: DataFrame, key: str, vec_col: str, set_col: str, gene: str, weight_p: float,
                min_size: int, max_size: int) -> DataFrame:
    rows = held.select(set_col, gene).collect()
    members: dict = {}
    for r in rows:
        members.setdefault(r[0], []).append(int(r[1]))
    members = {k: np.array(sorted(set(v)), dtype=np.int64) for k, v in members.items()}
    key_type = df.schema[key].dataType.simpleString()
    set_type = held.schema[set_col].dataType.simpleString()

    def fn(it):
        for pdf in it:
            if len(pdf) == 0:
                continue
            mat = np.vstack(pdf[vec_col].map(lambda a: np.asarray(a, dtype=np.float64)).to_numpy())
            keys = pdf[key].to_numpy()
            out_k, out_s, out_e, out_h = [], [], [], []
            for sid, es, H in _es_block(mat, members, weight_p, min_size, max_size):
                out_k.append(keys)
                out_s.append(np.full(len(keys), sid))
                out_e.append(es)
                out_h.append(np.full(len(keys), H))
            if out_k:
                yield pd.DataFrame({key: np.concatenate(out_k), set_col: np.concatenate(out_s),
                                    "es": np.concatenate(out_e), "n_hits": np.concatenate(out_h)})

    schema = f"{key} {key_type}, {set_col} {set_type}, es double, n_hits bigint"
    out = df.select(key, vec_col).mapInPandas(fn, schema)
    return out.withColumn("es", F.when(~F.isnan("es"), F.col("es")))


# ------------------------------------------------------------------ ANA10
@lru_cache(1)
def _erf_table() -> np.ndarray:
    """Taylor coefficients of erf at 0, 1/32, ..., 6: nine terms leave an
    error under 1e-17 half a step away."""
    rows = []
    for i in range(193):
        x = i / 32
        # derivatives of erf: c exp(-x^2) times Hermite polynomials, by recurrence
        d = [2 / sqrt(pi) * exp(-x * x)]
        d.append(-2 * x * d[0])
        for n in range(2, 9):
            d.append(-2 * x * d[n - 1] - 2 * (n - 1) * d[n - 2])
        rows.append([erf(x)] + [v / gamma(n + 2) for n, v in enumerate(d)])
    return np.array(rows)


def _erf(x: np.ndarray) -> np.ndarray:
    size = np.minimum(np.abs(x), 6.0)
    at = np.rint(size * 32).astype(np.int64)
    t, c = size - at / 32, _erf_table()
    out = c[at, 9]
    for n in range(8, -1, -1):
        out = out * t + c[at, n]
    return np.copysign(out, x)


def _norm_cdf(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1.0 + _erf(z / np.sqrt(2.0)))


@lru_cache(1)
def _temme() -> list[np.ndarray]:
    """Taylor coefficients in eta of the first terms of Temme's uniform
    expansion of the incomplete gamma function, from its own recurrence:
    eta^2 / 2 = mu - log(1 + mu) is inverted as a series, and
    C0 = 1 / mu - 1 / eta, C_k = C_{k-1}' / eta + (-1)^k g_k / mu, with g_k the
    coefficients of Stirling's series; the poles cancel."""
    from fractions import Fraction as Q
    n = 30
    # mu = sum a_i eta^i with a_1 = 1 from mu' mu = eta (1 + mu)
    a = [Q(0), Q(1)]
    for m in range(2, n):
        inner = sum((j * a[j] * a[m + 1 - j] for j in range(2, m)), Q(0))
        a.append((a[m - 1] - inner) / (m + 1))
    # 1 / mu = (1 / eta) * 1 / (1 + a_2 eta + ...)
    inv = [Q(1)]
    for m in range(1, n - 1):
        inv.append(-sum((a[j + 1] * inv[m - j] for j in range(1, m + 1)), Q(0)))
    stirling = [Q(1), Q(1, 12), Q(1, 288), Q(-139, 51840)]
    terms = [inv[1:]]
    for k in range(1, 4):
        before = terms[-1]
        slope = [(j + 1) * before[j + 1] for j in range(len(before) - 1)]          # slope[0] / eta cancels
        step = [slope[j + 1] + (-1) ** k * stirling[k] * inv[j + 1] for j in range(min(len(slope), len(inv)) - 1)]
        terms.append(step)
    return [np.array([float(v) for v in t]) for t in terms]


SUMMED = 300     # counts below this add up their own terms; others use Temme's expansion


def _poisson_cdf(k: np.ndarray, lam: np.ndarray) -> np.ndarray:
    """P(X <= k) for X ~ Poisson(lam) = Q(floor(k) + 1, lam), the regularised
    incomplete gamma function; k (m,), lam (r,) -> (m, r). Each cell depends
    on its own k and lam alone, whatever the others are."""
    k = np.floor(k)
    out = np.zeros((len(k), len(lam)))
    low = np.flatnonzero((k >= 0) & (k < SUMMED))
    if len(low):
        i = np.arange(SUMMED)
        lg = np.array([lgamma(v + 1.0) for v in i])
        pmf = np.exp(-lam[None, :] + i[:, None] * np.log(lam)[None, :] - lg[:, None])
        out[low] = np.cumsum(pmf, axis=0)[k[low].astype(np.int64)]
    high = np.flatnonzero(k >= SUMMED)
    if len(high):
        out[high] = _poisson_pairs(k[high][:, None], lam[None, :])[0]
    return np.clip(out, 0.0, 1.0)


def _poisson_pairs(k: np.ndarray, lam: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """P(X <= k) and P(X = k) for X ~ Poisson(lam), pair by pair; k >= SUMMED."""
    a = k + 1.0
    mu = lam / a - 1.0
    half = np.maximum(mu - np.log1p(mu), 0.0)                       # eta^2 / 2
    eta = np.copysign(np.sqrt(2.0 * half), mu)
    tail = 0.5 * (1.0 - _erf(eta * np.sqrt(a / 2.0)))
    # the expansion matters only near eta = 0: its factor is below 1e-17 where |eta| > 0.6
    e = np.clip(eta, -0.6, 0.6)
    rest = sum(np.polynomial.polynomial.polyval(e, c) / a**j for j, c in enumerate(_temme()))
    cdf = tail + np.exp(-a * half) / np.sqrt(2.0 * pi * a) * rest
    mu = lam / k - 1.0
    stirling = 1 / (12 * k) - 1 / (360 * k**3) + 1 / (1260 * k**5)
    return cdf, np.exp(-k * (mu - np.log1p(mu)) - stirling) / np.sqrt(2.0 * pi * k)


# Reference values are kept as counts and moments of cells; a kernel summed over a
# cell is its Taylor series around the cell's centre. Cells are 1/8 of a standard
# deviation of the kernel wide (for Poisson: 1/16 in the square root of the mean),
# so TERMS terms leave an error near 1e-15.
TERMS = 8
GAUSS_CELLS, GAUSS_BAND = 8, 8         # cells to a bandwidth; bandwidths beyond which the kernel is 0 or 1
ROOT_CELLS, ROOT_BAND = 16, 7          # cells to a unit of the root; units beyond which it is 0 or 1


def _gauss_sums(t: np.ndarray, cell: np.ndarray, moments: np.ndarray) -> np.ndarray:
    """Sum over the reference values of Phi(t - value), values and t in bandwidths;
    ``moments[i]`` holds count and moments of cell ``cell[i]`` (ascending)."""
    centre = (cell + 0.5) / GAUSS_CELLS
    before = np.concatenate([[0.0], np.cumsum(moments[:, 0])])
    lo = np.searchsorted(centre, t - GAUSS_BAND)
    hi = np.searchsorted(centre, t + GAUSS_BAND, side="right")
    out = before[lo]
    for step in range(int((hi - lo).max(initial=0))):
        on = np.flatnonzero(lo + step < hi)
        m = moments[lo[on] + step]
        z = t[on] - centre[lo[on] + step]
        # derivatives of Phi are Hermite polynomials times its density
        older, newer, factor = np.zeros(len(z)), np.ones(len(z)), 1.0
        series = np.zeros(len(z))
        for j in range(1, TERMS + 1):
            factor *= j
            series += newer * m[:, j] / factor
            older, newer = newer, z * newer - (j - 1) * older
        out[on] += _norm_cdf(z) * m[:, 0] - np.exp(-0.5 * z * z) / sqrt(2.0 * pi) * series
    return out


def _poisson_sums(k: np.ndarray, cell: np.ndarray, moments: np.ndarray) -> np.ndarray:
    """Sum over the reference means of P(X <= k), k >= 0 whole."""
    root = (cell + 0.5) / ROOT_CELLS
    lam, width = root * root, root / ROOT_CELLS
    before = np.concatenate([[0.0], np.cumsum(moments[:, 0])])
    lo = np.searchsorted(root, np.sqrt(k + 1.0) - ROOT_BAND)
    hi = np.searchsorted(root, np.sqrt(k + 1.0) + ROOT_BAND, side="right")
    out = before[lo]
    # counts below SUMMED add up their own terms, for the few cells in their reach
    reach = int(np.searchsorted(root, np.sqrt(SUMMED) + ROOT_BAND, side="right")) if (k < SUMMED).any() else 0
    i = np.arange(SUMMED)[:, None]
    lg = np.array([lgamma(v + 1.0) for v in range(SUMMED)])[:, None]
    own = np.exp(-lam[None, :reach] + i * np.log(lam[None, :reach]) - lg)
    summed = np.cumsum(own, axis=0)
    for step in range(int((hi - lo).max(initial=0))):
        on = np.flatnonzero(lo + step < hi)
        at, kk = lo[on] + step, k[on]
        cdf, pmf = np.empty(len(on)), np.empty(len(on))
        low = kk < SUMMED
        rows = kk[low].astype(np.int64)
        cdf[low], pmf[low] = summed[rows, at[low]], own[rows, at[low]]
        cdf[~low], pmf[~low] = _poisson_pairs(kk[~low], lam[at[~low]])
        m, w, c = moments[at], width[at], lam[at]
        # derivatives by the mean: -P(X = k) times polynomials with a three-term recurrence
        older, newer, factor = np.zeros(len(on)), np.ones(len(on)), 1.0
        series = np.zeros(len(on))
        for j in range(1, TERMS + 1):
            factor *= j
            series += newer * m[:, j] / factor
            older, newer = newer, w * ((kk - c - (j - 1)) * newer - (j - 1) * w * older) / c
        out[on] += cdf * m[:, 0] - pmf * w * series
    return out


def kernel_cdf(long_df: DataFrame, sample: str, gene: str, value: str, kernel: str = "gaussian",
               part_rows: int = 65536) -> DataFrame:
    """ANA10 stage 1: per gene, the kernel estimate of the CDF of each
    sample's value over all samples of that gene.

    Gaussian: F_ij = mean_k Phi((x_ij - x_ik) / h_i), h_i = sd_i / 4;
    Poisson:  F_ij = mean_k P(X <= x_ij; x_ik + 0.5), means below 0 taken as 0.
    Genes that are constant (sd = 0) or hold a NaN or infinite value are dropped.

    No pairs of values are formed. The values of a gene are added up in cells
    (count and ``TERMS`` moments, partial sums on the map side); a value meets the
    cells near it by their Taylor series, counts all cells far below it as 1 and
    none far above. A gene has about the cube root of its values, times some
    hundreds, in cells; its values are dealt into parts of ``part_rows``, each with
    a copy of the cells. The result is within 1e-12 of the plain sum."""
    if kernel not in ("gaussian", "poisson"):
        raise ValueError(f"unknown kernel {kernel!r}")
    x = long_df.select(sample, gene, F.col(value).cast("double").alias("_x")).where(F.col("_x").isNotNull())
    st = x.groupBy(gene).agg(F.count("*").alias("_n"), F.avg("_x").alias("_m"), F.stddev_samp("_x").alias("_sd"))
    st = st.where((F.col("_sd") > 0) & (F.col("_sd") < float("inf")))
    x = x.join(st.withColumn("_np", F.ceil(F.col("_n") / F.lit(part_rows)).cast("int")), gene)
    if kernel == "gaussian":
        point = (F.col("_x") - F.col("_m")) / (F.col("_sd") / 4)
        cell = F.floor(point * GAUSS_CELLS)
        off = point - (F.col("_cell") + 0.5) / GAUSS_CELLS
    else:
        point = F.greatest(F.col("_x") + 0.5, F.lit(0.0))
        cell = F.floor(F.sqrt(point) * ROOT_CELLS)
        root = (F.col("_cell") + 0.5) / ROOT_CELLS
        off = (point - root * root) / (root / ROOT_CELLS)
    names = [f"_m{j}" for j in range(1, TERMS + 1)]
    cells = (x.withColumn("_cell", cell).withColumn("_off", off).groupBy(gene, "_np", "_cell")
             .agg(F.count("*").cast("double").alias("_m0"),
                  *[F.sum(F.pow("_off", F.lit(float(j)))).alias(f"_m{j}") for j in range(1, TERMS + 1)])
             .withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_np") - 1)))
             .select(F.col(gene).alias("_of"), F.col("_part").alias("_to"), "_cell", "_m0", *names))
    asked = x.select(sample, gene, "_n", (point if kernel == "gaussian" else F.floor("_x").cast("double")).alias("_p"),
                     F.pmod(F.xxhash64(F.col(sample)), F.col("_np")).cast("int").alias("_part"))
    schema = T.StructType([long_df.schema[sample], long_df.schema[gene], T.StructField("cdf", T.DoubleType())])

    def fn(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        if not len(q):
            return pd.DataFrame({sample: [], gene: [], "cdf": []})
        c = c.sort_values("_cell")
        index, moments = c["_cell"].to_numpy(), c[["_m0", *names]].to_numpy(dtype=np.float64)
        point, back = np.unique(q["_p"].to_numpy(), return_inverse=True)
        if kernel == "gaussian":
            sums = _gauss_sums(point, index, moments)
        else:
            sums = np.zeros(len(point))
            sums[point >= 0] = _poisson_sums(point[point >= 0], index, moments)
        return pd.DataFrame({sample: q[sample].to_numpy(), gene: q[gene].to_numpy(),
                             "cdf": np.clip(sums[back] / q["_n"].to_numpy(), 0.0, 1.0)})

    return asked.groupBy(gene, "_part").cogroup(cells.groupBy("_of", "_to")).applyInPandas(fn, schema)


def gsva(long_df: DataFrame, membership: DataFrame, sample: str = "sample", gene: str = "gene",
         value: str = "value", set_col: str = "pathway_id", kernel: str = "gaussian",
         min_size: int = 1, max_size: int = 100000, tau: float = 1.0) -> DataFrame:
    """ANA10 (GSVA, Haenzelmann et al. 2013, max-diff score): kernel CDF per
    gene (stage 1), genes ranked inside each sample by decreasing CDF with
    symmetric weights |p/2 - rank|^tau (stage 2), hits-only walk per
    (sample, set) with ES = max(0, max) + min(0, min) (stage 3). Sets are
    intersected with the genes of the matrix, then filtered by that size
    (``set_size``); ``n_hits`` counts the members measured in the sample."""
    # values equal to 9 decimals are ties, which go by gene: the order does not hang on round-off
    cdf = kernel_cdf(long_df, sample, gene, value, kernel).withColumn("cdf", F.round("cdf", 9))
    # set sizes after intersecting with the genes of the matrix (one row per set)
    mem = membership.select(set_col, gene).distinct()
    sizes = (mem.join(long_df.select(gene).distinct(), gene).groupBy(set_col)
             .agg(F.count("*").alias("set_size"))
             .where((F.col("set_size") >= min_size) & (F.col("set_size") <= max_size)))
    w = Window.partitionBy(sample).orderBy(F.col("cdf").desc(), F.col(gene))
    ranked = (cdf.withColumn("_r", F.row_number().over(w))
              .withColumn("_N", F.count("*").over(Window.partitionBy(sample))))
    hits = (ranked.join(mem.join(sizes.select(set_col), set_col), gene)
            .withColumn("_w", F.pow(F.abs(F.col("_N") / 2.0 - F.col("_r")), F.lit(tau))))
    stt = _walk_stats(hits, [sample, set_col], "_r", "_w", "_N")
    es = F.when((F.col("n_hits") < F.col("n_ranked")) & (F.col("_wsum") > 0),
                F.greatest(F.col("hi"), F.lit(0.0)) + F.least(F.col("lo"), F.lit(0.0)))
    return (stt.join(sizes, set_col)
            .select(sample, set_col, es.alias("es"), "n_hits", "set_size"))
