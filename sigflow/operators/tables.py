"""Table-level operators: keep-first/last dedup, filters, column profile,
null-feature pruning, metabolite column pruning (WIN1, FLT1-FLT11, AGG1,
SET1-SET3).

Dedup uses ``min_by``/``max_by`` aggregation rather than a window: the hash
aggregate combines map-side, so one key holding a third of the rows is
reduced inside every input partition before the shuffle instead of being
sorted in a single task.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigflow.functions.vectors import vsum


def keep_first(df: DataFrame, keys: Sequence[str], order_col: str = "_ord",
               last: bool = False) -> DataFrame:
    """pandas ``drop_duplicates(subset=keys, keep='first'|'last')`` with the
    file order made explicit in ``order_col``."""
    keys = list(keys)
    rest = [c for c in df.columns if c not in keys]
    pick = F.max_by if last else F.min_by
    agg = df.groupBy(*keys).agg(pick(F.struct(*rest), F.col(order_col)).alias("_r"))
    return agg.select(*keys, *[F.col("_r")[c].alias(c) for c in rest])


def last_wins_map(df: DataFrame, key: str, value: str, order_col: str = "_ord") -> DataFrame:
    """``dict(zip(keys, values))``: the last occurrence of a key wins, even if
    its value is NULL."""
    return df.groupBy(key).agg(F.max_by(F.col(value), F.col(order_col)).alias(value))


def activity_filter(sig_info: DataFrame, available: DataFrame, threshold: float,
                    pert_type: str = "trt_cp", id_col: str = "sig_id") -> DataFrame:
    """FLT1 ``tas_filtering``: ``tas > threshold`` (exclusive) and the wanted
    perturbation type, restricted to ids present in the matrix."""
    cand = sig_info.where((F.col("tas") > F.lit(threshold)) & (F.col("pert_type") == pert_type))
    return cand.join(available.select(id_col), id_col, "left_semi")


def activity_report(sig_info: DataFrame, available: DataFrame, threshold: float,
                    pert_type: str = "trt_cp", drug_col: str = "pert_id") -> DataFrame:
    """FLT1 report in one pass: candidates, found, dropped, distinct cells and
    drugs among the kept rows."""
    cand = sig_info.where((F.col("tas") > F.lit(threshold)) & (F.col("pert_type") == pert_type))
    flagged = cand.join(available.select("sig_id").distinct().withColumn("_found", F.lit(True)),
                        "sig_id", "left")
    found = F.col("_found").isNotNull()
    return flagged.agg(
        F.count("*").alias("n_candidates"),
        F.count_if(found).alias("n_found"),
        F.count_if(~found).alias("n_dropped"),
        F.count_distinct(F.when(found, F.col("cell_iname"))).alias("n_cells"),
        F.count_distinct(F.when(found, F.col(drug_col))).alias("n_drugs"))


def null_feature_mask(df: DataFrame, vec_col: str) -> DataFrame:
    """One row: ``_keep`` boolean array, True where no row has a NULL at that
    position (pandas ``dropna(axis=1)``). Tasks count whole Arrow batches, so the
    matrix is never exploded; NULL rows count nowhere."""
    def count(batches):
        total = np.zeros(0, np.int64)                # per position; its length is that of the longest row
        for batch in batches:
            rows = batch.column(0).drop_null()
            flat, lens = rows.flatten(), pc.list_value_length(rows).to_numpy()
            pos = np.arange(len(flat)) - np.repeat(np.cumsum(lens) - lens, lens)
            absent = pc.is_null(flat, nan_is_null=True).to_numpy(zero_copy_only=False)
            total = np.pad(total, (0, max(0, int(lens.max(initial=0)) - len(total))))
            total += np.bincount(pos[absent], minlength=len(total))
        yield pa.RecordBatch.from_arrays([pa.array([total], pa.list_(pa.int64()))], ["_counts"])

    per = (df.select(vec_col).mapInArrow(count, "_counts array<long>")          # a row a task
           .select(F.posexplode("_counts").alias("_pos", "_x"))
           .groupBy("_pos").agg(F.sum("_x").alias("_nulls")))
    return per.agg(F.transform(F.array_sort(F.collect_list(F.struct("_pos", "_nulls"))),
                               lambda t: t["_nulls"] == 0).alias("_keep"))


def drop_null_features(df: DataFrame, vec_col: str, mask_from: DataFrame | None = None) -> DataFrame:
    """FLT2: drop every feature position holding a NULL/NaN in any row. The
    mask is computed on ``mask_from`` (default: ``df`` itself), which lets a
    caller choose the reference's two orders (before or after filtering)."""
    mask = null_feature_mask(mask_from if mask_from is not None else df, vec_col)
    # one boolean per feature position: bounded by the schema width, not rows
    row = mask.first()
    keep = [i for i, k in enumerate(row["_keep"] if row else []) if k]
    positions = F.array(*[F.lit(i + 1) for i in keep]) if keep else F.array().cast("array<int>")
    return df.withColumn(vec_col, F.transform(positions, lambda p: F.element_at(vec_col, p)))


def to_float32(df: DataFrame) -> DataFrame:
    """FLT9: cast double columns and double arrays to float (storage type)."""
    from pyspark.sql import types as T
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, T.DoubleType):
            cols.append(F.col(f.name).cast("float").alias(f.name))
        elif isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.DoubleType):
            cols.append(F.col(f.name).cast("array<float>").alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


def usable_encoding(df: DataFrame, vec_col: str) -> DataFrame:
    """FLT10: keep rows whose vector sums to more than zero."""
    return df.where(vsum(vec_col) > 0)


def sparsify(edges: DataFrame, threshold: float, sim_col: str = "sim") -> DataFrame:
    """FLT11: similarities below the threshold become (implicit) zeros."""
    return edges.where(F.col(sim_col) >= F.lit(threshold))


def valid_registry_id(c: str, prefix: str = "CVCL_") -> F.Column:
    """FLT6: non-null, starts with the prefix, non-empty."""
    return F.col(c).isNotNull() & F.col(c).startswith(prefix) & (F.length(c) > 0)


def column_profile(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """AGG1: distinct count per column, in long form (column, n_distinct).
    Columns are unpivoted to strings so one aggregation covers them all."""
    cols = list(cols or df.columns)
    long = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in cols
    ])).alias("_p")).select("_p.column", "_p.value")
    return long.groupBy("column").agg(F.count_distinct("value").alias("n_distinct"))


def column_values(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """AGG1 companion: the distinct values of every column, long form
    (column, value) -- never collected into one row."""
    cols = list(cols or df.columns)
    long = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in cols
    ])).alias("_p")).select("_p.column", "_p.value")
    return long.where(F.col("value").isNotNull()).distinct()


def prune_metabolites(metab_long: DataFrame, mapping: DataFrame, remove_unmapped: bool = True,
                      split_lipids: bool = True, convert_ids: bool = True,
                      name_col: str = "metabolite") -> tuple[DataFrame, DataFrame]:
    """FLT7 ``preprocess_metabolomics`` on the long matrix
    (cell, metabolite, value). ``mapping`` is (Query, KEGG, _ord); the name
    map is last-wins like ``dict(zip())``. Returns (kept, lipids)."""
    name_map = last_wins_map(mapping, "Query", "KEGG")
    kept = metab_long
    if remove_unmapped:
        unmapped = name_map.where(F.col("KEGG").isNull()).select(F.col("Query").alias(name_col))
        kept = kept.join(unmapped, name_col, "left_anti")
    lipids = kept.limit(0)
    if split_lipids:
        known = (mapping.select(F.col("Query").alias(name_col))
                 .unionByName(mapping.where(F.col("KEGG").isNotNull()).select(F.col("KEGG").alias(name_col)))
                 .distinct())
        lipids = kept.join(known, name_col, "left_anti")
        kept = kept.join(known, name_col, "left_semi")
    if convert_ids:
        kept = (kept.join(name_map.withColumnRenamed("Query", name_col), name_col, "left")
                .withColumn(name_col, F.coalesce(F.col("KEGG"), F.col(name_col))).drop("KEGG"))
    return kept, lipids
