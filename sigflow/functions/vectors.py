"""Column expressions and small DataFrame steps over vector columns
(``array<float|double>``): JVM higher-order functions (interpreted, not
code-generated), and two Arrow-batched functions for ranks and unit vectors."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# sklearn-style zero-variance rule: a scale below 10 machine epsilons is 1.
_ZERO_SCALE = 10 * 2.220446049250313e-16


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def vsum(v) -> Column:
    """Sum of the elements (as double)."""
    return F.aggregate(_c(v), F.lit(0.0).cast("double"), lambda acc, x: acc + x.cast("double"))


def dot(a, b) -> Column:
    """Dot product of two equally long vectors."""
    return vsum(F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double")))


def norm(v) -> Column:
    """Euclidean norm."""
    return F.sqrt(dot(v, v))


def _unit_rows(mat: np.ndarray) -> np.ndarray:
    """Centre each row and scale it to unit norm; constant rows -> NaN."""
    c = mat - mat.mean(axis=1, keepdims=True)
    n = np.sqrt(np.einsum("ij,ij->i", c, c))
    with np.errstate(invalid="ignore", divide="ignore"):
        out = c / n[:, None]
    out[n == 0] = np.nan
    return out


def _map_rows(s: pd.Series, fn) -> pd.Series:
    """Apply a row-matrix function to a Series of equal-length arrays,
    batch-wise (rows of other lengths or NULL handled one by one)."""
    out = [None] * len(s)
    lens = s.map(lambda a: -1 if a is None else len(a)).to_numpy()
    for L in np.unique(lens):
        if L < 0:
            continue
        idx = np.flatnonzero(lens == L)
        mat = np.vstack([np.asarray(s.iloc[i], dtype=np.float64) for i in idx]) if L > 0 \
            else np.zeros((len(idx), 0))
        res = fn(mat)
        for r, i in enumerate(idx):
            row = res[r]
            out[i] = None if (L == 0 or np.isnan(row).any()) else row
    return pd.Series(out, index=s.index, dtype=object)


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def unit_centered_udf(s: pd.Series) -> pd.Series:
    """Arrow-batched unit-centred vectors (NULL for constant vectors)."""
    return _map_rows(s, _unit_rows)


def unit_centered(v) -> Column:
    """Centre then divide by the norm: the dot product of two such vectors is
    their Pearson correlation. NULL for a constant vector (undefined r).

    One vectorised pass per Arrow batch; the equivalent higher-order-function
    expression re-evaluates the mean and norm per element."""
    return unit_centered_udf(_c(v))


def _avg_ranks_np(x: np.ndarray) -> np.ndarray:
    """Average 1-based ranks of one vector (ties share their mean rank)."""
    order = np.argsort(x, kind="mergesort")
    xs = x[order]
    n = len(xs)
    ranks = np.empty(n, dtype=np.float64)
    if n == 0:
        return ranks
    starts = np.flatnonzero(np.r_[True, xs[1:] != xs[:-1]])
    ends = np.r_[starts[1:], n]
    avg = (starts + 1 + ends) / 2.0
    ranks[order] = np.repeat(avg, ends - starts)
    return ranks


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def average_ranks_udf(s: pd.Series) -> pd.Series:
    """Arrow-batched average ranks of each vector (O(d log d) per row)."""
    return s.map(lambda a: None if a is None else _avg_ranks_np(np.asarray(a, dtype=np.float64)))


def average_ranks(v) -> Column:
    """Average ranks of the elements of each vector (Spearman input)."""
    return average_ranks_udf(_c(v))


def feature_stats(df: DataFrame, vec_col: str, group_cols: Sequence[str] = ()) -> DataFrame:
    """Per group: ``_mean`` and ``_scale`` arrays (population std, zero -> 1).

    The matrix is exploded only inside the map side; the partial aggregate
    per (group, position) keeps the shuffle at groups x d rows."""
    g = list(group_cols)
    st = (df.select(*g, F.posexplode(vec_col).alias("_pos", "_x"))
          .groupBy(*g, "_pos")
          .agg(F.avg("_x").alias("m"), F.stddev_pop("_x").alias("s")))
    per = st.groupBy(*g).agg(F.array_sort(F.collect_list(F.struct("_pos", "m", "s"))).alias("_st"))
    return per.select(
        *g,
        F.transform("_st", lambda t: t["m"]).alias("_mean"),
        F.transform("_st", lambda t: F.when(t["s"] < _ZERO_SCALE, F.lit(1.0))
                    .otherwise(t["s"])).alias("_scale"))


def attach_group_values(df: DataFrame, per_group: DataFrame, group_cols: Sequence[str],
                        cols: Sequence[str]) -> DataFrame:
    """Add columns of a one-row-per-group table. With no groups the table has
    one row and its values enter as scalar subqueries (no join)."""
    g = list(group_cols)
    if g:
        return df.join(per_group.select(*g, *cols), g)
    # one scalar subquery carrying every value (a subquery per column would
    # run the aggregation once per column)
    packed = per_group.select(F.struct(*cols).alias("_vals")).scalar()
    return df.withColumn("_vals", packed).select(
        *[c for c in df.columns], *[F.col("_vals")[c].alias(c) for c in cols])


def standardize(df: DataFrame, vec_col: str, group_cols: Sequence[str] = (),
                out_col: str | None = None) -> DataFrame:
    """z = (x - mean) / std_pop per position, statistics fitted per group
    (or on the whole input)."""
    out = out_col or vec_col
    stats = feature_stats(df, vec_col, group_cols)
    joined = attach_group_values(df, stats, group_cols, ["_mean", "_scale"])
    z = F.zip_with(F.zip_with(F.col(vec_col), F.col("_mean"), lambda x, m: x.cast("double") - m),
                   F.col("_scale"), lambda d, s: d / s)
    return joined.withColumn(out, z).drop("_mean", "_scale")
