"""Annotation joins and identifier harmonisation (JN1-JN14, AGG23).

Dimension tables (compounds, cells, id maps) are small per key but are not
hinted: AQE measures them at run time and broadcasts only below
``spark.sql.autoBroadcastJoinThreshold``, falling back to a sort-merge join
otherwise, so no side is broadcast without a size check.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigflow.operators.tables import keep_first, last_wins_map, valid_registry_id


def first_compound_row(compounds: DataFrame, key: str = "pert_id", order_col: str = "_ord",
                       drop: Sequence[str] = ("target",)) -> DataFrame:
    """Drop per-target columns, then the first row per compound (file order),
    even when that row's label is NULL and a later one's is not."""
    c = compounds.drop(*drop)
    return keep_first(c, [key], order_col)


def annotate_drug(perturbations: DataFrame, sig_info: DataFrame, compounds: DataFrame,
                  label: str = "moa", id_col: str = "sig_id") -> DataFrame:
    """JN1 ``annotate_drug_info``: sig_info LEFT JOIN first compound row,
    drop NULL labels, keep signatures present in both, attach the label."""
    comp = first_compound_row(compounds).select("pert_id", label)
    meta = (sig_info.select(id_col, "pert_id").join(comp, "pert_id", "left")
            .where(F.col(label).isNotNull()).select(id_col, label))
    return perturbations.join(meta, id_col, "inner")


def annotate_cell(df: DataFrame, sig_info: DataFrame, cell_info: DataFrame,
                  cells: Sequence | str | None = None, id_col: str = "sig_id") -> DataFrame:
    """JN2 ``annotate_cell_info``: sig_info INNER JOIN cell_info on
    cell_iname, then LEFT onto ``df`` by id; optional cell filter (a list or
    a single name)."""
    ann = (sig_info.select(id_col, "cell_iname")
           .join(cell_info.select("cell_iname"), "cell_iname", "inner")
           .where(F.col("cell_iname").isNotNull()))
    out = df.join(ann, id_col, "left")
    if cells is not None:
        cells = [cells] if isinstance(cells, (str, int)) else list(cells)
        out = out.where(F.col("cell_iname").isin(cells))
    return out


def ccle_to_registry(depmap: DataFrame, name_col: str = "CCLEName", id_col: str = "RRID",
                     order_col: str = "_ord") -> DataFrame:
    """JN3: CCLE name -> registry id; both non-null, valid prefix, non-empty
    name, first occurrence per name wins."""
    dm = (depmap.select(name_col, id_col, order_col)
          .where(F.col(name_col).isNotNull() & F.col(id_col).isNotNull())
          .where(valid_registry_id(id_col)).where(F.length(name_col) > 0))
    return keep_first(dm, [name_col], order_col).select(name_col, id_col)


def sig_to_registry(sig_info: DataFrame, cell_info: DataFrame,
                    drug_cols: Sequence[str] = ("pert_id", "cmap_name")) -> DataFrame:
    """JN4: every signature with its cell's registry id (NULL if none);
    drug columns carried when present."""
    have = [c for c in drug_cols if c in sig_info.columns]
    meta = sig_info.select("sig_id", "cell_iname", *have)
    cmap = (cell_info.where(valid_registry_id("cellosaurus_id"))
            .select("cell_iname", "cellosaurus_id", "_ord"))
    cmap = keep_first(cmap, ["cell_iname"], "_ord").select("cell_iname", "cellosaurus_id")
    return meta.join(cmap, "cell_iname", "left")


def rekey_cells(long_df: DataFrame, mapping: DataFrame, cell_col: str = "ccle_name",
                name_col: str = "CCLEName", id_col: str = "RRID",
                order_col: str = "_cell_ord") -> DataFrame:
    """JN5 step: re-key a (cell, feature, value) matrix to the registry id;
    unmapped cells dropped; when two source cells map to the same id the
    first source cell (by ``order_col``) wins."""
    cells = (long_df.select(cell_col, order_col).distinct()
             .join(mapping.withColumnRenamed(name_col, cell_col), cell_col, "inner"))
    chosen = (cells.groupBy(id_col).agg(F.min_by(F.col(cell_col), F.col(order_col)).alias(cell_col))
              .select(cell_col, F.col(id_col).alias("cell_id")))
    # chosen has one row per cell: a small dimension joined to the matrix
    return long_df.join(chosen, cell_col, "inner").drop(cell_col, order_col)


def harmonize(trans_long: DataFrame, metab_long: DataFrame, signatures: DataFrame,
              sig_info: DataFrame, cell_info: DataFrame, depmap: DataFrame):
    """JN5 ``harmonize_ids``: returns (trans, metab, l1000) keyed by the
    registry id plus the statistics row. ``drug_id`` is ``pert_id``."""
    cmap = ccle_to_registry(depmap)
    trans_h = rekey_cells(trans_long, cmap)
    metab_h = rekey_cells(metab_long, cmap)
    meta = sig_to_registry(sig_info, cell_info)
    l1000 = (signatures.join(meta.select("sig_id", "pert_id", "cellosaurus_id"), "sig_id", "left"))
    l1000_h = (l1000.where(F.col("cellosaurus_id").isNotNull())
               .withColumnRenamed("cellosaurus_id", "cell_id")
               .withColumnRenamed("pert_id", "drug_id"))
    return trans_h, metab_h, l1000_h, cmap, l1000


def overlap_report(trans_h: DataFrame, metab_h: DataFrame, l1000_h: DataFrame) -> DataFrame:
    """AGG23: |T|, |M|, |L|, |T^L|, |M^L|, |T^M^L| from presence flags of a
    FULL OUTER join of the three distinct cell-id sets (one pass)."""
    t = trans_h.select("cell_id").distinct().withColumn("_t", F.lit(1))
    m = metab_h.select("cell_id").distinct().withColumn("_m", F.lit(1))
    l_ = l1000_h.select("cell_id").distinct().withColumn("_l", F.lit(1))
    allc = t.join(m, "cell_id", "full").join(l_, "cell_id", "full")
    T_, M_, L_ = (F.col(x).isNotNull() for x in ("_t", "_m", "_l"))
    return allc.agg(F.count_if(T_).alias("n_trans"), F.count_if(M_).alias("n_metab"),
                    F.count_if(L_).alias("n_l1000"), F.count_if(T_ & L_).alias("n_trans_l1000"),
                    F.count_if(M_ & L_).alias("n_metab_l1000"),
                    F.count_if(T_ & M_ & L_).alias("n_all"))


def strip_version(c: str) -> F.Column:
    """FN1: versioned id -> id before the first '.'."""
    return F.substring_index(F.col(c), ".", 1)


def convert_gene_ids(long_df: DataFrame, mapping: DataFrame, gene_col: str = "gene",
                     query_col: str = "query", symbol_col: str = "symbol") -> DataFrame:
    """JN6: strip the version, map through a supplied table (last hit wins),
    drop unmapped genes."""
    m = last_wins_map(mapping, query_col, symbol_col).where(F.col(symbol_col).isNotNull())
    return (long_df.withColumn(query_col, strip_version(gene_col))
            .join(m, query_col, "inner").drop(gene_col, query_col)
            .withColumnRenamed(symbol_col, gene_col))


def lookup_vectors(keys: DataFrame, encoding: DataFrame, key: str, vec_col: str, dim: int) -> DataFrame:
    """JN9: drug vector per row; a missing drug gets the zero vector and
    ``_missing`` = True (the reference's report)."""
    out = keys.join(encoding.select(key, vec_col), key, "left")
    return (out.withColumn("_missing", F.col(vec_col).isNull())
            .withColumn(vec_col, F.coalesce(F.col(vec_col),
                                            F.array_repeat(F.lit(0.0).cast("double"), dim))))


def hybrid_encoding(a: DataFrame, b: DataFrame, key: str, vec_a: str, vec_b: str,
                    out: str = "vec") -> DataFrame:
    """JN10: drugs present in both encoders, vectors concatenated."""
    return (a.select(key, F.col(vec_a).alias("_a")).join(b.select(key, F.col(vec_b).alias("_b")), key)
            .select(key, F.concat(F.col("_a").cast("array<double>"),
                                  F.col("_b").cast("array<double>")).alias(out)))
