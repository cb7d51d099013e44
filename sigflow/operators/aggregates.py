"""Label, compound and distribution statistics (AGG2-AGG7, AGG18-AGG22,
TOP1-TOP3, WIN2, WIN3, WIN6).

All are hash aggregations with map-side partial aggregation; rankings are
windows partitioned by one signature (bounded by the feature count) or
global top-n (``TakeOrderedAndProject``: each task keeps only n rows).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sigflow.operators.quantiles import quantiles


def compound_stats(compounds: DataFrame, label: str = "moa", name: str = "cmap_name") -> DataFrame:
    """AGG2: distinct drugs, distinct labelled drugs, distinct labels, share
    of rows with a label (computed before dropping NULLs) and mean number of
    rows per label."""
    per_label = (compounds.where(F.col(label).isNotNull()).groupBy(label)
                 .agg(F.count(name).alias("_n")))
    return compounds.agg(
        F.count_distinct(name).alias("n_drugs"),
        F.count_distinct(F.when(F.col(label).isNotNull(), F.col(name))).alias("n_drugs_labelled"),
        F.count_distinct(label).alias("n_labels"),
        (F.count(label) / F.count("*")).alias("labelled_fraction"),
    ).select("*", per_label.select(F.avg("_n")).scalar().alias("mean_group_size"))


def value_counts(df: DataFrame, col: str, name: str = "count") -> DataFrame:
    """AGG3/AGG22: rows per value (NULL keys dropped, as pandas)."""
    return df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count("*").alias(name))


def histogram(values: DataFrame, col: str, edges: Sequence[float], labels: Sequence[str] | None = None
              ) -> DataFrame:
    """AGG5: ``np.histogram`` with fixed edges (bins half-open, last one
    closed, values outside dropped) plus each bin's share in percent. All
    bins are reported, empty ones with 0."""
    edges = [float(e) for e in edges]
    nb = len(edges) - 1
    labels = list(labels) if labels else [str(i) for i in range(nb)]
    v = F.col(col).cast("double")
    bin_expr = None
    for i in range(nb):
        lo, hi = edges[i], edges[i + 1]
        cond = (v >= lo) & ((v <= hi) if i == nb - 1 else (v < hi))
        bin_expr = F.when(cond, F.lit(i)) if bin_expr is None else bin_expr.when(cond, F.lit(i))
    counted = (values.select(bin_expr.alias("bin")).where(F.col("bin").isNotNull())
               .groupBy("bin").agg(F.count("*").alias("count")))
    # the bin list is a parameter (a handful of rows), not data
    spark = values.sparkSession
    bins = spark.createDataFrame([(i, labels[i], edges[i], edges[i + 1]) for i in range(nb)],
                                 "bin int, label string, lo double, hi double")
    out = bins.join(counted, "bin", "left").withColumn("count", F.coalesce("count", F.lit(0)))
    total = counted.select(F.sum("count")).scalar()
    return out.withColumn("pct", F.col("count") * 100.0 / total)


def pair_counts(annotated: DataFrame, cell: str = "cell_iname", label: str = "moa") -> DataFrame:
    """AGG6: n(n-1)/2 pairs per (cell, label), then the mean per cell."""
    per = (annotated.where(F.col(cell).isNotNull() & F.col(label).isNotNull())
           .groupBy(cell, label).agg(F.count("*").alias("n_pert"))
           .withColumn("n_pairs", F.expr("(n_pert * (n_pert - 1)) div 2")))
    return per.groupBy(cell).agg(F.avg("n_pairs").alias("mean_pairs"))


def describe(df: DataFrame, col: str) -> DataFrame:
    """AGG7: count/mean/std/min/quartiles/max (linear interpolation) and the
    smallest most frequent value (mode). Quartiles come from range counts, so
    no task holds the column."""
    c = F.col(col).cast("double")
    stats = df.agg(F.count(c).alias("count"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"),
                   F.min(c).alias("min"), F.max(c).alias("max"))
    parts = quantiles(df, [], col, [0.25, 0.5, 0.75], ["q25", "q50", "q75"])       # one row
    quarters = parts.select(F.struct("q25", "q50", "q75")).scalar()
    stats = stats.withColumn("_q", quarters).select("count", "mean", "std", "min", "_q.q25", "_q.q50", "_q.q75", "max")
    freq = df.where(F.col(col).isNotNull()).groupBy(c.alias("_v")).agg(F.count("*").alias("_n"))
    mode = freq.orderBy(F.col("_n").desc(), F.col("_v").asc()).limit(1).select("_v")
    return stats.select("*", mode.scalar().alias("mode"))


def group_centroids(df: DataFrame, hue: str, x: str, y: str) -> DataFrame:
    """AGG18: centroid and one-std extent of two components per group."""
    return df.groupBy(hue).agg(F.avg(x).alias("mean_x"), F.avg(y).alias("mean_y"),
                               F.stddev_samp(x).alias("std_x"), F.stddev_samp(y).alias("std_y"),
                               F.count("*").alias("n"))


def value_histogram(long_values: DataFrame, col: str, n_bins: int = 20) -> DataFrame:
    """AGG19: histogram of every value of a matrix (already long, or the
    exploded vector), equal-width bins between the global min and max."""
    v = F.col(col).cast("double")
    rng = long_values.agg(F.min(v).alias("lo"), F.max(v).alias("hi"))
    lo, hi = rng.select("lo").scalar(), rng.select("hi").scalar()
    width = (hi - lo) / n_bins
    b = F.least(F.floor((v - lo) / width), F.lit(n_bins - 1)).cast("int")
    return (long_values.where(v.isNotNull()).select(b.alias("bin"))
            .groupBy("bin").agg(F.count("*").alias("count"))
            .select("bin", (lo + F.col("bin") * width).alias("lo"),
                    (lo + (F.col("bin") + 1) * width).alias("hi"), "count"))


def compounds_per_label_cluster(compounds: DataFrame, label: str = "moa",
                                cluster: str = "cluster_id") -> DataFrame:
    """AGG20: group sizes per (label, cluster), NULL keys removed."""
    return (compounds.where(F.col(label).isNotNull() & F.col(cluster).isNotNull())
            .groupBy(label, cluster).agg(F.count("*").alias("n_compounds")))


def distinct_per_label(compounds: DataFrame, label: str = "moa",
                       what: str = "canonical_smiles") -> DataFrame:
    """AGG21: distinct structures per label."""
    return (compounds.where(F.col(label).isNotNull()).groupBy(label)
            .agg(F.count_distinct(what).alias(f"n_{what}")))


def label_summary(compounds: DataFrame, sig_info: DataFrame, label: str = "moa",
                  name: str = "cmap_name", top: int | None = 30) -> DataFrame:
    """AGG4: drugs (first row per name, NULLs counted like pandas ``size``),
    signatures and distinct cells per label, outer-aligned, largest first."""
    first = compounds.groupBy(name).agg(
        F.min_by(F.struct(*[c for c in compounds.columns if c != name]), F.col("_ord")).alias("_r")
    ).select(name, F.col(f"_r.{label}").alias(label))
    drugs = first.where(F.col(label).isNotNull()).groupBy(label).agg(F.count("*").alias("n_drugs"))
    sig = sig_info.join(first.where(F.col(label).isNotNull()), name, "left")
    sigs = sig.where(F.col(label).isNotNull()).groupBy(label).agg(
        F.count("sig_id").alias("n_sigs"), F.count_distinct("cell_iname").alias("n_cell_lines"))
    out = drugs.join(sigs, label, "full")
    if top:
        out = out.orderBy(F.col("n_drugs").desc_nulls_last(), F.col(label)).limit(top)
    return out


def rank_desc(long_df: DataFrame, key: str, item: str, value: str, out: str = "rank") -> DataFrame:
    """WIN2: 1-based position of each item in its signature, by value
    descending (ties by item id)."""
    w = Window.partitionBy(key).orderBy(F.col(value).desc(), F.col(item))
    return long_df.withColumn(out, F.row_number().over(w))


def average_rank_long(long_df: DataFrame, key: str, value: str, out: str = "avg_rank") -> DataFrame:
    """WIN3: ascending average rank with ties, in long form."""
    w = Window.partitionBy(key).orderBy(F.col(value))
    wt = Window.partitionBy(key, value)
    return long_df.withColumn(out, F.rank().over(w) + (F.count("*").over(wt) - 1) / 2.0)


def running_sum(long_df: DataFrame, key: str, order_cols: Sequence, value, out: str = "running"
                ) -> DataFrame:
    """WIN6: ordered running sum inside each key."""
    w = (Window.partitionBy(key).orderBy(*order_cols)
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    v = F.col(value) if isinstance(value, str) else value
    return long_df.withColumn(out, F.sum(v).over(w))


def smallest(df: DataFrame, n: int, by: str, tie: str) -> DataFrame:
    """TOP1/TOP2: n smallest rows (ties by ``tie``)."""
    return df.orderBy(F.col(by).asc(), F.col(tie).asc()).limit(n)


def largest(df: DataFrame, n: int, by: str, tie: str) -> DataFrame:
    return df.orderBy(F.col(by).desc(), F.col(tie).asc()).limit(n)
