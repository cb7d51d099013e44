"""Dimension reduction data stages (ANA11, ANA12).

* PCA: block Krylov iteration. A pass over the rows multiplies the centred
  matrix's d x d scatter with a thin block of directions, as partial sums of
  (d, block) in the tasks; no d x d matrix exists anywhere. The driver holds at
  most ``BASIS`` directions of d values. Component signs are fixed so that the
  largest-magnitude loading of each component is positive.
* Neighbour-graph weights (the data stage of UMAP, McInnes et al. 2018):
  exact k-NN (blocked, see ``neighbors.knn``), per-row local scale
  (rho = nearest positive distance, sigma by bisection so that
  sum_j exp(-max(0, d_ij - rho) / sigma) = log2(k)), then the fuzzy union
  w = a + b - a b of the two directions. The layout optimisation is not
  built.
"""

from __future__ import annotations

import warnings
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sigflow.functions.vectors import feature_stats, standardize
from sigflow.operators.ml import _block_sums
from sigflow.operators.neighbors import knn
from sigflow.session import cut_lineage


BASIS = 256       # directions kept at once (at least four times the components)
BLOCK = 16        # directions multiplied in a pass, beyond the components asked for


def _scatter(df: DataFrame, vec_col: str, directions: np.ndarray, mean: np.ndarray | None) -> tuple[np.ndarray, float]:
    """(S W, trace S) for the scatter S of the rows less ``mean`` and directions
    W (d, b): one pass."""
    def part(it):
        from pyspark import TaskContext
        total, trace = np.zeros(directions.shape), 0.0
        for pdf in it:
            if len(pdf):
                X = np.vstack(pdf[vec_col].to_numpy()).astype(np.float64)
                X = X if mean is None else X - mean
                total += X.T @ (X @ directions)
                trace += float(np.einsum("ij,ij->", X, X))
        sums = np.concatenate([total.ravel(), [trace]])
        yield pd.DataFrame({"block": [0], "task": [TaskContext.get().partitionId()], "sums": [sums.tobytes()]})

    rows = df.select(vec_col).mapInPandas(part, "block long, task long, sums binary")
    flat = np.frombuffer(_block_sums(rows, df.rdd.getNumPartitions()).first()["sums"], np.float64)
    return flat[:-1].reshape(directions.shape), float(flat[-1])


def _fresh(block: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """Orthonormal directions of ``block`` outside ``basis``; those within round-off of it go."""
    size = np.maximum(np.linalg.norm(block, axis=0), 1e-300)
    for _ in range(2):
        block = block - basis @ (basis.T @ block)
    block = block[:, np.linalg.norm(block, axis=0) > 1e-10 * size]
    if not block.shape[1]:
        return block
    q, r = np.linalg.qr(block / np.linalg.norm(block, axis=0))
    q = q[:, np.abs(np.diag(r)) > 1e-8]
    q = q - basis @ (basis.T @ q)
    return np.linalg.qr(q)[0]


def _components(df: DataFrame, vec_col: str, d: int, k: int, mean: np.ndarray | None, tol: float,
                max_passes: int) -> tuple[np.ndarray, np.ndarray]:
    """Leading k unit eigenvectors (d, k) of the scatter and their shares of its
    trace. Every pass widens the basis by the image of its last block; the k best
    combinations are done when each is an eigenvector to ``tol`` of the largest
    eigenvalue. A full basis keeps its best 2 k combinations and goes on."""
    rng = np.random.default_rng(0)
    width = min(d, k + BLOCK)
    room = max(BASIS, 4 * width)
    new = np.linalg.qr(rng.normal(size=(d, width)))[0]
    basis, image = np.zeros((d, 0)), np.zeros((d, 0))
    for _ in range(max_passes):
        out, trace = _scatter(df, vec_col, new, mean)
        basis, image = np.hstack([basis, new]), np.hstack([image, out])
        h = basis.T @ image
        value, turn = np.linalg.eigh((h + h.T) / 2)
        value, turn = value[::-1], turn[:, ::-1]
        off = image @ turn[:, :k] - (basis @ turn[:, :k]) * value[:k]
        if basis.shape[1] >= d or np.linalg.norm(off, axis=0).max() <= tol * max(value[0], 1e-300):
            break
        if basis.shape[1] + width > room:
            keep = turn[:, :2 * width]
            basis, image, turn = basis @ keep, image @ keep, np.eye(2 * width)
            new = _fresh(off, basis)
        else:
            new = _fresh(out, basis)
        if not new.shape[1]:
            # the basis is closed under the scatter: what is outside has to be looked for
            new = _fresh(rng.normal(size=(d, min(width, d - basis.shape[1]))), basis)
    else:
        warnings.warn(f"PCA stopped after {max_passes} passes before reaching its tolerance")
    share = value[:k] / trace if trace > 0 else np.zeros(k)
    return basis @ turn[:, :k], np.maximum(share, 0.0)


def pca(df: DataFrame, id_col: str, vec_col: str, k: int = 10, scale: bool = True,
        carry: Sequence[str] = (), tol: float = 1e-11, max_passes: int = 300) -> tuple[DataFrame, DataFrame]:
    """ANA11: (scores(id, carry..., pc1..pck), explained-variance ratios) of the
    standardised (``scale``) or centred vectors. Rows without a vector take no
    part and have NULL scores; an empty input gives no scores and no ratios."""
    base = df.select(id_col, *carry, vec_col)
    if scale:
        base = standardize(base, vec_col)
    base = cut_lineage(base)
    spark, mean = df.sparkSession, None
    used = base.where(F.col(vec_col).isNotNull())
    d = used.select(F.size(vec_col)).first()
    fields = [f"pc{i + 1}" for i in range(k)]
    ratio_type = "component int, explained_variance_ratio double"
    if d is None:
        return (base.select(id_col, *carry, *[F.lit(None).cast("double").alias(c) for c in fields]),
                spark.createDataFrame([], ratio_type))
    if k > d[0]:
        raise ValueError(f"{k} components of vectors of {d[0]} elements")
    if not scale:
        mean = np.array(feature_stats(used, vec_col).first()["_mean"])
    vectors, shares = _components(used, vec_col, d[0], k, mean, tol, max_passes)
    vectors = vectors * np.where(vectors[np.argmax(np.abs(vectors), axis=0), np.arange(k)] < 0, -1.0, 1.0)

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def project(s: pd.Series) -> pd.Series:
        out = pd.Series([None] * len(s), index=s.index, dtype=object)
        on = np.flatnonzero(s.notna().to_numpy())
        if len(on):
            X = np.vstack(s.iloc[on].to_numpy()).astype(np.float64)
            for i, row in zip(on, (X if mean is None else X - mean) @ vectors):
                out.iloc[i] = row
        return out

    scores = (base.select(id_col, *carry, project(vec_col).alias("_s"))
              .select(id_col, *carry, *[F.col("_s")[i].alias(c) for i, c in enumerate(fields)]))
    return scores, spark.createDataFrame([(i + 1, float(v)) for i, v in enumerate(shares)], ratio_type)


def _sigma_rows(dists: np.ndarray, target: float, n_iter: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """rho and sigma per row of a (m, k) distance matrix (NaN = missing)."""
    d = np.where(np.isnan(dists), np.inf, dists)
    pos = np.where(d > 0, d, np.inf)
    rho = pos.min(axis=1)
    rho[~np.isfinite(rho)] = 0.0
    lo = np.zeros(len(d))
    hi = np.full(len(d), np.inf)
    sig = np.ones(len(d))
    for _ in range(n_iter):
        val = np.where(np.isfinite(d), np.exp(-np.maximum(d - rho[:, None], 0.0) / sig[:, None]), 0.0).sum(1)
        over = val > target
        hi = np.where(over, sig, hi)
        lo = np.where(over, lo, sig)
        sig = np.where(np.isfinite(hi), (lo + hi) / 2.0, sig * 2.0)
    return rho, sig


def neighbor_graph(df: DataFrame, id_col: str, vec_col: str, k: int = 15, scale: bool = True,
                   block_rows: int = 2048) -> DataFrame:
    """ANA12: symmetric edge weights in (0, 1] of the k-neighbour graph
    (self excluded from the edges, included in k as the library does).
    Returns (a, b, weight) with a < b."""
    nn = knn(df, id_col, vec_col, k, scale=scale, block_rows=block_rows)
    nn = nn.where(F.col("q_id") != F.col("c_id"))
    per = nn.groupBy("q_id").agg(F.array_sort(F.collect_list(F.struct("dist", "c_id"))).alias("_l"))
    target = float(np.log2(k))

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def weights(s: pd.Series) -> pd.Series:
        if len(s) == 0:
            return pd.Series([], dtype=object)
        m = max(len(x) for x in s)
        D = np.full((len(s), m), np.nan)
        for r, x in enumerate(s):
            D[r, :len(x)] = [e["dist"] for e in x]
        rho, sig = _sigma_rows(D, target)
        W = np.exp(-np.maximum(D - rho[:, None], 0.0) / sig[:, None])
        return pd.Series([list(W[r, :len(x)]) for r, x in enumerate(s)], index=s.index)

    directed = (per.withColumn("_w", weights("_l"))
                .select("q_id", F.posexplode("_l").alias("_p", "_e"), "_w")
                .select(F.col("q_id").alias("i"), F.col("_e.c_id").alias("j"),
                        F.element_at("_w", F.col("_p") + 1).alias("w")))
    a = directed.select(F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b"),
                        F.when(F.col("i") < F.col("j"), F.col("w")).alias("w_ab"),
                        F.when(F.col("i") > F.col("j"), F.col("w")).alias("w_ba"))
    both = a.groupBy("a", "b").agg(F.coalesce(F.max("w_ab"), F.lit(0.0)).alias("x"),
                                   F.coalesce(F.max("w_ba"), F.lit(0.0)).alias("y"))
    return both.select("a", "b", (F.col("x") + F.col("y") - F.col("x") * F.col("y")).alias("weight"))
