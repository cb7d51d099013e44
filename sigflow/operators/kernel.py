"""Exact RBF kernel ridge (ML6): (K + alpha I) c = y for all targets.

Rows with equal features (replicates of a drug in a cell) enter once: m of them
with mean target y have the summed coefficient s of (K + alpha / m I) s = y over
the distinct rows, and only that sum is ever used. Up to ``DENSE_ROWS`` distinct
rows one task solves the system directly. Beyond that conjugate gradients, scaled
by the diagonal, run over a table of rows: each carries its part of the
coefficients, residuals and directions, and a kernel product is one pass over
the rows for every block of them, whose features and directions are dealt to
the tasks. No kernel matrix is stored, and the driver holds one block at a time.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigflow.session import cut_lineage

DENSE_ROWS = 4096            # distinct rows solved in one task
BLOCK_BYTES = 64 << 20       # features and directions dealt to the tasks at once
CELLS = 1 << 21              # kernel values held at once in a task
TOLERANCE = 1e-10            # residual over the targets' norm at which a target is solved


@dataclass
class KernelModel:
    """Distinct training rows with their summed coefficients: (block, x, c)."""
    rows: DataFrame
    blocks: int
    gamma: float
    targets: int


def _matrix(values) -> np.ndarray:
    return np.vstack([np.asarray(v, np.float64) for v in values])


def rbf(a: np.ndarray, b: np.ndarray, gamma: float) -> np.ndarray:
    """exp(-gamma ||x - z||^2) of all rows."""
    square = (a * a).sum(1)[:, None] + (b * b).sum(1) - 2 * (a @ b.T)
    return np.exp(-gamma * np.maximum(square, 0.0))


def _blocks_of(n: int, width: int, targets: int) -> int:
    return max(1, -(-n * 8 * (width + targets) // BLOCK_BYTES))


def distinct_rows(df: DataFrame, x_col: str, v_col: str, targets: int) -> DataFrame:
    """(x, v, m): the distinct feature vectors, the sums of ``v_col`` over their
    rows and how many those are."""
    sums = [F.sum(F.col(v_col)[j].cast("double")).alias(f"_v{j}") for j in range(targets)]
    x = F.col(x_col).cast("array<double>").alias("x")
    return (df.groupBy(x).agg(F.count("*").alias("m"), *sums)
            .select("x", F.array(*[F.col(f"_v{j}") for j in range(targets)]).cast("array<double>").alias("v"), "m"))


def in_blocks(rows: DataFrame, width: int, targets: int) -> tuple[DataFrame, int]:
    """Rows with their ``block``, and the number of blocks."""
    blocks = _blocks_of(rows.count(), width, targets)
    return cut_lineage(rows.withColumn("block", F.pmod(F.monotonically_increasing_id(), F.lit(blocks)).cast("int"))), blocks


def kernel_product(df: DataFrame, x_col: str, rows: DataFrame, blocks: int, c_col: str, gamma: float,
                   targets: int, out: str) -> DataFrame:
    """``df`` with ``out``: the sum of kernel values with all of ``rows``
    (block, x) times their ``c_col``."""
    result = df.withColumn(out, F.array_repeat(F.lit(0.0), targets))
    for b in range(blocks):
        part = rows.where(F.col("block") == b).select("x", c_col).toPandas()      # about BLOCK_BYTES
        if not len(part):
            continue
        z, c = _matrix(part["x"]), _matrix(part[c_col])

        @F.pandas_udf("array<double>")
        def add(xs: pd.Series, sums: pd.Series) -> pd.Series:
            if not len(xs):
                return pd.Series([], dtype=object)
            done, step = [], max(1, CELLS // len(z))
            for a in range(0, len(xs), step):
                done.extend(_matrix(sums.iloc[a:a + step]) + rbf(_matrix(xs.iloc[a:a + step]), z, gamma) @ c)
            return pd.Series(done)

        result = result.withColumn(out, add(F.col(x_col), F.col(out)))
        if blocks > 1:
            result = cut_lineage(result)
    return result


def _dots(df: DataFrame, a: str, b: str, targets: int) -> np.ndarray:
    """Sums over rows of the products of two array columns, by target."""
    found = df.select(F.posexplode(F.zip_with(a, b, lambda u, v: u * v)).alias("t", "v")).groupBy("t").agg(F.sum("v").alias("v")).collect()
    out = np.zeros(targets)
    for r in found:
        out[r["t"]] = r["v"]
    return out


def _step(a: str, b: str, scale: np.ndarray):
    """a + scale * b by target."""
    s = F.array(*[F.lit(float(v)) for v in scale])
    return F.zip_with(a, F.zip_with(b, s, lambda v, w: v * w), lambda u, v: u + v)


def fit_kernel_ridge(train: DataFrame, alpha: float = 1.0, gamma: float = 1.0 / 200, x_col: str = "features",
                     y_col: str = "y", max_iter: int = 500) -> KernelModel:
    """The dual coefficients of every target."""
    shape = train.agg(F.max(F.size(x_col)).alias("d"), F.max(F.size(y_col)).alias("t")).first()
    if shape["d"] is None:
        raise ValueError("no training rows")
    targets = shape["t"]
    rows = distinct_rows(train, x_col, y_col, targets)
    rows, blocks = in_blocks(cut_lineage(rows.select("x", F.transform("v", lambda v: v / F.col("m")).alias("y"), "m")),
                             shape["d"], targets)
    if rows.count() <= DENSE_ROWS:
        def solve(pdf: pd.DataFrame) -> pd.DataFrame:
            x, y = _matrix(pdf["x"]), _matrix(pdf["y"])
            k = rbf(x, x, gamma)
            k[np.diag_indices(len(x))] += alpha / pdf["m"].to_numpy()
            return pd.DataFrame({"block": pdf["block"], "x": list(x), "c": list(np.linalg.solve(k, y))})

        whole = rows.withColumn("all", F.lit(0)).groupBy("all")                   # at most DENSE_ROWS rows
        return KernelModel(cut_lineage(whole.applyInPandas(solve, "block int, x array<double>, c array<double>")),
                           blocks, gamma, targets)
    zero = F.array_repeat(F.lit(0.0), targets)
    ridge = F.lit(float(alpha)) / F.col("m")
    scaled = lambda r: F.transform(r, lambda v: v / (1 + ridge))
    state = cut_lineage(rows.select("block", "x", "m", zero.alias("c"), F.col("y").alias("r"), scaled("y").alias("p"))
                        .withColumn("z", F.col("p")))
    goal = TOLERANCE**2 * _dots(state, "r", "r", targets)
    old, left = _dots(state, "r", "z", targets), goal / TOLERANCE**2
    for _ in range(max_iter):
        if (left <= goal).all():
            break
        q = cut_lineage(kernel_product(state, "x", state, blocks, "p", gamma, targets, "q")
                        .withColumn("q", F.zip_with("q", "p", lambda u, v: u + ridge * v)))
        slope = _dots(q, "p", "q", targets)
        size = np.where(left > goal, old / np.where(slope > 0, slope, 1), 0.0)   # solved targets stand still
        moved = q.select("block", "x", "m", _step("c", "p", size).alias("c"), _step("r", "q", -size).alias("r"), "p")
        moved = cut_lineage(moved.withColumn("z", scaled("r")))
        left = np.where(left > goal, _dots(moved, "r", "r", targets), left)
        new = _dots(moved, "r", "z", targets)
        state = cut_lineage(moved.select("block", "x", "m", "c", "r", "z", _step("z", "p", new / np.where(old > 0, old, 1)).alias("p")))
        old = new
    return KernelModel(state.select("block", "x", "c"), blocks, gamma, targets)


def predict_kernel(df: DataFrame, model: KernelModel, x_col: str = "features", out: str = "pred") -> DataFrame:
    return kernel_product(df, x_col, model.rows, model.blocks, "c", model.gamma, model.targets, out)
