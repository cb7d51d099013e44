"""Proxy views: the reference's inputs (signature matrix, sig_info, compound
and cell tables, pathway membership, ...) expressed over the driver tables.

Every view is a lazy DataFrame derived from the given parquet tables, so the
work of any query built on them grows with the tables. The same definitions
are written as DuckDB SQL in ``sigflow.plans.oracles`` for the oracle check.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigflow.operators.quantiles import quantiles
from sigflow.sources.tables import table

# Fixed values of the proxy mapping (shared with the oracle SQL).
N_CELLS = 4                 # v_signatures: cell = sig_id % 4
N_PATHWAYS = 6              # v_pathways: pathway ids 0..5
ACTIVITY_THRESHOLD = 20.0   # FLT1 on v_sig_info (median value is ~35)


def signatures(spark: SparkSession, sf: str) -> DataFrame:
    """v_signatures(sig_id, features array<float>, moa, cell)."""
    return (table(spark, sf, "embeddings")
            .select(F.col("vec_id").alias("sig_id"),
                    F.col("embedding").alias("features"),
                    F.col("label").alias("moa"),
                    (F.col("vec_id") % N_CELLS).alias("cell")))


def signatures_long(spark: SparkSession, sf: str) -> DataFrame:
    """v_signatures_long(sig_id, gene, v double): one row per matrix cell."""
    return (table(spark, sf, "embeddings")
            .select(F.col("vec_id").alias("sig_id"),
                    F.posexplode("embedding").alias("gene", "v"))
            .withColumn("v", F.col("v").cast("double")))


def signatures_with_nulls(spark: SparkSession, sf: str) -> DataFrame:
    """v_signatures_null: vector form with NULL where gene % 16 = 0 and
    sig_id % 50 = 0 (missing measurements)."""
    s = signatures(spark, sf)
    return s.withColumn(
        "features",
        F.transform("features", lambda x, i: F.when(
            ((i % 16) == 0) & ((F.col("sig_id") % 50) == 0), F.lit(None)).otherwise(x)))


def sig_info(spark: SparkSession, sf: str) -> DataFrame:
    """v_sig_info(sig_id, cell_iname, pert_type, tas, pert_id)."""
    return (table(spark, sf, "events")
            .select(F.col("event_id").alias("sig_id"),
                    F.col("user_id").alias("cell_iname"),
                    F.col("event_type").alias("pert_type"),
                    F.col("value").alias("tas"),
                    F.get_json_object("props", "$.k").cast("bigint").alias("pert_id")))


def available_ids(spark: SparkSession, sf: str) -> DataFrame:
    """v_available(sig_id): ids present in the matrix."""
    return (table(spark, sf, "events").select(F.col("event_id").alias("sig_id"))
            .where(F.col("sig_id") % 10 != 0))


def compounds(spark: SparkSession, sf: str) -> DataFrame:
    """v_compounds(pert_id, cmap_name, moa, cluster_id, target,
    canonical_smiles, _ord): several rows per pert_id, ``_ord`` is the file
    order; the structure string stands in for a SMILES."""
    p = table(spark, sf, "part")
    smiles = F.when(F.col("p_partkey") % 17 == 0, F.lit(None).cast("string")).otherwise(
        F.concat(F.upper(F.regexp_replace("p_name", " ", "")), F.lit("-"),
                 (F.col("p_size") % 9).cast("string")))
    first = p.select(
        F.col("p_partkey").alias("pert_id"), F.col("p_name").alias("cmap_name"),
        F.when(F.col("p_partkey") % 7 == 0, F.lit(None)).otherwise(F.col("p_brand")).alias("moa"),
        F.col("p_type").alias("cluster_id"), F.col("p_size").alias("target"),
        smiles.alias("canonical_smiles"), (F.col("p_partkey") * 2).alias("_ord"))
    second = p.where(F.col("p_partkey") % 3 == 0).select(
        F.col("p_partkey").alias("pert_id"), F.col("p_name").alias("cmap_name"),
        F.concat(F.col("p_brand"), F.lit("_alt")).alias("moa"),
        F.col("p_type").alias("cluster_id"), (F.col("p_size") + 100).alias("target"),
        smiles.alias("canonical_smiles"), (F.col("p_partkey") * 2 + 1).alias("_ord"))
    return first.unionByName(second)


def cells(spark: SparkSession, sf: str) -> DataFrame:
    """v_cells(cell_iname, cellosaurus_id, _ord)."""
    return (table(spark, sf, "customer")
            .select(F.col("c_custkey").alias("cell_iname"),
                    F.when(F.col("c_custkey") % 5 == 0, F.lit("N/A"))
                    .otherwise(F.concat(F.lit("CVCL_"), F.col("c_nationkey").cast("string")))
                    .alias("cellosaurus_id"),
                    F.col("c_custkey").alias("_ord")))


def genes(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct feature positions of the matrix (the gene universe)."""
    return (table(spark, sf, "embeddings")
            .select(F.explode(F.sequence(F.lit(0), F.size("embedding") - 1)).alias("gene"))
            .distinct())


def pathways(spark: SparkSession, sf: str) -> DataFrame:
    """v_pathways(pathway_id, gene): membership rule over the gene universe."""
    g = genes(spark, sf)
    return (g.select(F.explode(F.sequence(F.lit(0), F.lit(N_PATHWAYS - 1))).alias("pathway_id"),
                     "gene")
            .where(((F.col("gene") * 7 + F.col("pathway_id") * 3) % 5) == (F.col("pathway_id") % 5)))


def pathway_names(spark: SparkSession, sf: str) -> DataFrame:
    """pathway_id -> name; pathway 5 has no name (TOP1 default 'Unknown')."""
    return (pathways(spark, sf).select("pathway_id").distinct()
            .where(F.col("pathway_id") < N_PATHWAYS - 1)
            .select("pathway_id",
                    F.concat(F.lit("pathway_"), F.col("pathway_id").cast("string")).alias("name")))


def measured(spark: SparkSession, sf: str) -> DataFrame:
    """v_measured(gene): molecules the assay measures."""
    return genes(spark, sf).where(F.col("gene") % 3 != 0)


def fingerprints(spark: SparkSession, sf: str, threshold: float = 0.0) -> DataFrame:
    """v_fingerprints(drug_id, moa, bits array<int>): on-bit sets."""
    e = table(spark, sf, "embeddings")
    return e.select(
        F.col("vec_id").alias("drug_id"), F.col("label").alias("moa"),
        F.filter(F.sequence(F.lit(0), F.size("embedding") - 1),
                 lambda i: F.element_at("embedding", i + 1) > F.lit(threshold)).alias("bits"))


def regression(spark: SparkSession, sf: str) -> DataFrame:
    """v_regression: lineitem as an ML table with two groupings; row_id is
    (order, line, part, supplier, price in cents), unique in every table."""
    li = table(spark, sf, "lineitem")
    return li.select(
        F.concat_ws("-", *[F.col(c).cast("string") for c in
                           ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")],
                    F.round(F.col("l_extendedprice") * 100).cast("bigint").cast("string")).alias("row_id"),
        F.col("l_suppkey").alias("cell_id"), F.col("l_partkey").alias("drug_id"),
        F.array(F.col("l_quantity"), F.col("l_discount"), F.col("l_tax")).alias("features"),
        F.array(F.col("l_extendedprice"),
                F.col("l_quantity") * F.col("l_discount")).alias("y"))


def results_long(spark: SparkSession, sf: str) -> DataFrame:
    """v_results(cor_type, cell, moa, r): long correlation results; the null
    sample of each (cor_type, cell) is the label ``__inter_moa__``."""
    ev = table(spark, sf, "events").select(
        F.when(F.col("event_id") % 2 == 0, F.lit("pearson")).otherwise(F.lit("spearman")).alias("cor_type"),
        F.col("user_id").alias("cell"), F.col("event_type").alias("moa"), "value")
    per_label = quantiles(ev, ["cor_type", "cell", "moa"], "value", [0.5], ["r"])
    null = (quantiles(ev, ["cor_type", "cell"], "value", [0.5], ["r"])
            .select("cor_type", "cell", F.lit("__inter_moa__").alias("moa"), "r"))
    return per_label.unionByName(null)


def depmap(spark: SparkSession, sf: str) -> DataFrame:
    """v_depmap(CCLEName, RRID, _ord): CCLE name -> registry id, with
    duplicate names, 'N/A' and NULL ids."""
    c = table(spark, sf, "customer")
    return c.select(
        F.concat(F.lit("CELL_"), (F.col("c_custkey") % 700).cast("string")).alias("CCLEName"),
        F.when(F.col("c_custkey") % 5 == 0, F.lit("N/A"))
        .when(F.col("c_custkey") % 11 == 0, F.lit(None).cast("string"))
        .otherwise(F.concat(F.lit("CVCL_"), (F.col("c_custkey") % 40).cast("string"))).alias("RRID"),
        F.col("c_custkey").alias("_ord"))


def transcriptomics(spark: SparkSession, sf: str) -> DataFrame:
    """v_trans(ccle_name, gene, value, _cell_ord): cell x gene in long form,
    versioned gene ids."""
    o = table(spark, sf, "orders")
    return (o.select(
        F.concat(F.lit("CELL_"), (F.col("o_custkey") % 900).cast("string")).alias("ccle_name"),
        F.concat(F.lit("ENSG"), (F.col("o_orderkey") % 50).cast("string"), F.lit("."),
                 (F.col("o_orderkey") % 3).cast("string")).alias("gene"),
        F.col("o_totalprice").alias("value"),
        (F.col("o_custkey") % 900).alias("_cell_ord"))
        .groupBy("ccle_name", "gene", "_cell_ord").agg(F.avg("value").alias("value")))


def metabolomics(spark: SparkSession, sf: str) -> DataFrame:
    """v_metab(ccle_name, metabolite, value, _cell_ord): cell x metabolite."""
    li = table(spark, sf, "lineitem")
    return (li.select(
        F.concat(F.lit("CELL_"), (F.col("l_orderkey") % 800).cast("string")).alias("ccle_name"),
        F.concat(F.lit("M"), (F.col("l_partkey") % 40).cast("string")).alias("metabolite"),
        F.col("l_extendedprice").alias("value"),
        (F.col("l_orderkey") % 800).alias("_cell_ord"))
        .groupBy("ccle_name", "metabolite", "_cell_ord").agg(F.avg("value").alias("value")))


def metabolite_map(spark: SparkSession, sf: str) -> DataFrame:
    """v_metab_map(Query, KEGG, _ord): metabolite name -> KEGG id."""
    p = table(spark, sf, "part")
    return p.select(
        F.concat(F.lit("M"), (F.col("p_partkey") % 36).cast("string")).alias("Query"),
        F.when(F.col("p_partkey") % 4 == 0, F.lit(None).cast("string"))
        .otherwise(F.concat(F.lit("C"), (F.col("p_partkey") % 30).cast("string"))).alias("KEGG"),
        F.col("p_partkey").alias("_ord"))


def gene_map(spark: SparkSession, sf: str) -> DataFrame:
    """v_gene_map(query, symbol, _ord): unversioned gene id -> symbol."""
    p = table(spark, sf, "part")
    return p.select(
        F.concat(F.lit("ENSG"), (F.col("p_partkey") % 60).cast("string")).alias("query"),
        F.when(F.col("p_partkey") % 13 == 0, F.lit(None).cast("string"))
        .otherwise(F.concat(F.lit("SYM"), (F.col("p_partkey") % 37).cast("string"))).alias("symbol"),
        F.col("p_partkey").alias("_ord"))
