"""Registered queries: sources and sinks as write-then-read round trips on
data derived from the driver tables (SRC5-SRC12, SNK1-SNK7). Files go to a
fresh folder under the shared checkpoint folder."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from sigflow.functions.common import rounded

from sigflow.operators import neighbors as nb
from sigflow.plans import q_compounds, q_ml, q_neighbors
from sigflow.plans.oracles_base import with_views
from sigflow.plans.q_correlations import pathway_matrix
from sigflow.sources import formats as FM
from sigflow.sources import proxies as px

NO_REF_PATHWAY = 5   # its record has no REFERENCE line and must yield nothing


def src5_pathway_parquet(spark, sf):
    path = FM.scratch_path(spark, "pathway_scores")
    pm = pathway_matrix(spark, sf).select("sig_id", F.posexplode("features").alias("pathway_id", "score"))
    FM.write_table(pm, path)
    return rounded(spark.read.parquet(path))


def src6_tsv_gzip(spark, sf):
    path = FM.scratch_path(spark, "sig_info_tsv")
    si = px.sig_info(spark, sf)
    si.write.mode("overwrite").option("header", True).option("sep", "\t").option(
        "compression", "gzip").csv(path)
    schema = T.StructType([T.StructField("sig_id", T.LongType()), T.StructField("cell_iname", T.LongType()),
                           T.StructField("pert_type", T.StringType()), T.StructField("tas", T.DoubleType()),
                           T.StructField("pert_id", T.LongType())])
    return FM.read_delimited(spark, path, schema, "\t")


def src7_csv_wide(spark, sf):
    path = FM.scratch_path(spark, "metabolomics_csv")
    m = px.metabolomics(spark, sf)
    names = sorted(r[0] for r in m.select("metabolite").distinct().collect())   # column list
    wide = (m.groupBy("ccle_name").pivot("metabolite", names).agg(F.first("value"))
            .withColumn("DepMap_ID", F.concat(F.lit("ACH-"), F.col("ccle_name"))))
    FM.write_table(wide, path, "csv")
    schema = T.StructType([T.StructField("ccle_name", T.StringType())]
                          + [T.StructField(n, T.DoubleType()) for n in names]
                          + [T.StructField("DepMap_ID", T.StringType())])
    back = FM.read_delimited(spark, path, schema, ",", drop=["DepMap_ID"])
    long = FM.unpivot_wide(back, "ccle_name", "metabolite", "value").where(F.col("value").isNotNull())
    return rounded(long)


def src8_gct(spark, sf):
    path = FM.scratch_path(spark, "trans_gct")
    t = px.transcriptomics(spark, sf)
    FM.write_gct(t, "gene", "ccle_name", "value", path)
    return rounded(FM.read_gct(spark, path, "gene", "ccle_name").where(F.col("value").isNotNull()))


def _gmt_round_trip(spark, sf):
    path = FM.scratch_path(spark, "pathways_gmt")
    mem = px.pathways(spark, sf).select(F.col("pathway_id").cast("string").alias("pathway_id"),
                                        F.col("gene").cast("string").alias("member"))
    names = px.pathway_names(spark, sf).select(F.col("pathway_id").cast("string").alias("pathway_id"), "name")
    FM.write_gmt(mem, names, path)
    return path


def src9_gmt(spark, sf):
    path = _gmt_round_trip(spark, sf)
    mem, _ = FM.read_gmt(spark, path, "metabolomics")
    return mem


def snk6_gmt_lines(spark, sf):
    path = _gmt_round_trip(spark, sf)
    return spark.read.text(path)


def _keyed_results(spark, sf):
    path = FM.scratch_path(spark, "correlation_results")
    r = px.results_long(spark, sf)
    named = r.withColumn("_file", F.concat(F.lit("correlations_moa_"), F.col("cor_type"), F.lit("_"),
                                           F.col("cell").cast("string"), F.lit("_raw_pert")))
    stray = r.limit(1).withColumn("_file", F.lit("notes_unparsed"))   # a file the pattern must skip
    FM.write_table(named.unionByName(stray).select("_file", "moa", "r"), path, "csv", ["_file"])
    return path


SETUP_RE = r"_file=correlations_([A-Za-z]+)_(pearson|spearman)_(\d+)_(raw_pert|pathway_pert)/[^/]*$"


def src10_keyed_files(spark, sf):
    path = _keyed_results(spark, sf)
    schema = T.StructType([T.StructField("moa", T.StringType()), T.StructField("r", T.DoubleType())])
    df = FM.read_keyed_csv(spark, path, SETUP_RE,
                           ["outname", "cor_type", "cell", "pert_type"], schema)
    return rounded(df.withColumn("cell", F.col("cell").cast("bigint")))


def src11_setups(spark, sf):
    path = _keyed_results(spark, sf)
    schema = T.StructType([T.StructField("moa", T.StringType()), T.StructField("r", T.DoubleType())])
    df = FM.read_keyed_csv(spark, path, SETUP_RE,
                           ["outname", "cor_type", "cell", "pert_type"], schema)
    return df.select("outname", "cor_type", "pert_type").distinct()


def _records(spark, sf):
    """Flat pathway records generated from the pathway membership."""
    pw = px.pathways(spark, sf)
    per = pw.groupBy("pathway_id").agg(F.array_sort(F.collect_list("gene")).alias("g"))

    def block(tag, items):
        return F.concat_ws("\n", F.transform(items, lambda x, i: F.concat(
            F.when(i == 0, F.lit(tag.ljust(12))).otherwise(F.lit(" " * 12)),
            x.cast("string"), F.lit("  item"))))

    comp = F.transform("g", lambda x: F.concat(F.lit("C"), ((x * 7) % 11).cast("string")))
    ref = F.when(F.col("pathway_id") != NO_REF_PATHWAY, F.concat(F.lit("REFERENCE   r"),
                                                                 F.col("pathway_id").cast("string")))
    text = F.concat(F.concat_ws("\n", F.concat(F.lit("ENTRY       map0000"), F.col("pathway_id").cast("string")),
                                F.concat(F.lit("NAME        pathway_"), F.col("pathway_id").cast("string")),
                                block("GENE", F.col("g")), block("COMPOUND", comp), ref), F.lit("\n"))
    path = FM.scratch_path(spark, "records")
    FM.write_records(per.select(text.alias("text")), path)
    return FM.read_records(spark, path)


def _src12(mode):
    def q(spark, sf):
        return FM.parse_records(_records(spark, sf), mode)
    return q


def snk1_csv(spark, sf):
    path = FM.scratch_path(spark, "harmonized_csv")
    t = px.transcriptomics(spark, sf).select("ccle_name", "gene", "value")
    FM.write_table(t, path, "csv")
    schema = "ccle_name string, gene string, value double"
    return rounded(spark.read.option("header", True).schema(schema).csv(path))


def snk2_stats(spark, sf):
    path = FM.scratch_path(spark, "knn_stats")
    s = px.signatures(spark, sf)
    samples = nb.neighbor_purity(s, "sig_id", "features", "moa", q_neighbors.K)
    FM.write_table(samples, f"{path}/samples")
    stats = nb.class_purity_stats(spark.read.parquet(f"{path}/samples"), "moa")
    FM.write_table(stats, f"{path}/classes", "csv")
    schema = "moa int, mean double, std double, count bigint, random_baseline double, lift double, " \
             "freq_baseline double"
    return rounded(spark.read.option("header", True).schema(schema).csv(f"{path}/classes"))


def snk3_partitioned(spark, sf):
    path = FM.scratch_path(spark, "per_cell")
    FM.write_table(px.results_long(spark, sf), path, partition_by=["cor_type", "cell"])
    # partition discovery infers key types: restore the written ones
    return rounded(spark.read.parquet(path).withColumn("cell", F.col("cell").cast("bigint")))


def snk5_distinct_text(spark, sf):
    path = FM.scratch_path(spark, "moa_list")
    FM.write_distinct_values(px.compounds(spark, sf), "moa", path)
    return spark.read.text(path)


def snk7_clusters(spark, sf):
    path = FM.scratch_path(spark, "clusters")
    FM.write_table(q_compounds.chm4_single_linkage(spark, sf), path, partition_by=["moa"])
    return spark.read.parquet(path).select("moa", "drug_id", "component")


def snk4_ml_summary(spark, sf):
    """The model summary, best R2 first, written as CSV and read again."""
    path = FM.scratch_path(spark, "ml_summary")
    FM.write_table(q_ml.ml10_own_models(spark, sf), path, "csv")
    return spark.read.option("header", True).schema("model string, r2 double, mse double, mae double").csv(path)


def snk4_encoding_comparison(spark, sf):
    """R2 and MSE of the linear models for every encoding and split, written
    as CSV and read again."""
    path = FM.scratch_path(spark, "encoding_comparison")
    FM.write_table(q_ml.grid(spark, sf, ("Ridge", "ElasticNet")).drop("mae"), path, "csv")
    return spark.read.option("header", True).schema("encoding string, split string, model string, r2 double, mse double").csv(path)


QUERIES = {
    "SNK4_encoding_comparison": snk4_encoding_comparison,
    "SRC5_pathway_parquet": src5_pathway_parquet, "SRC6_tsv_gzip": src6_tsv_gzip,
    "SRC7_csv_wide": src7_csv_wide, "SRC8_gct": src8_gct, "SRC9_gmt": src9_gmt,
    "SRC10_keyed_files": src10_keyed_files, "SRC11_setups": src11_setups,
    "SRC12_records_compounds": _src12("metabolomics"), "SRC12_records_genes": _src12("transcriptomics"),
    "SRC12_records_both": _src12("multiomics"),
    "SNK1_csv": snk1_csv, "SNK2_stats": snk2_stats, "SNK3_partitioned": snk3_partitioned,
    "SNK4_ml_summary": snk4_ml_summary, "SNK5_distinct_text": snk5_distinct_text,
    "SNK6_gmt_lines": snk6_gmt_lines, "SNK7_clusters": snk7_clusters,
}

_REC = f"""rec AS (SELECT 'map0000' || CAST(pathway_id AS VARCHAR) AS record_id, gene FROM v_pathways
                WHERE pathway_id <> {NO_REF_PATHWAY}),
recs AS (SELECT DISTINCT record_id, 'compound' AS kind, 'C' || CAST((gene * 7) % 11 AS VARCHAR) AS member FROM rec
         UNION SELECT DISTINCT record_id, 'gene', CAST(gene AS VARCHAR) FROM rec)"""

ORACLES = {
    "SNK4_ml_summary": q_ml.ORACLES["ML10_own_models"],
    "SRC5_pathway_parquet": with_views("""
        SELECT l.sig_id, CAST(p.pathway_id AS INTEGER) AS pathway_id, round(avg(l.v), 6) AS score
        FROM v_signatures_long l JOIN v_pathways p USING (gene) GROUP BY ALL"""),
    "SRC6_tsv_gzip": with_views("SELECT * FROM v_sig_info"),
    "SRC7_csv_wide": with_views("SELECT ccle_name, metabolite, round(value, 6) AS value FROM v_metab"),
    "SRC8_gct": with_views("SELECT gene, ccle_name, round(value, 6) AS value FROM v_trans"),
    "SRC9_gmt": with_views("""
        SELECT CAST(pathway_id AS VARCHAR) AS pathway_id, CAST(gene AS VARCHAR) AS member FROM v_pathways"""),
    "SNK6_gmt_lines": with_views("""
        SELECT CAST(p.pathway_id AS VARCHAR) || chr(9) || coalesce(n.name, '') || chr(9)
               || string_agg(CAST(p.gene AS VARCHAR), chr(9) ORDER BY CAST(p.gene AS VARCHAR)) AS value
        FROM v_pathways p LEFT JOIN v_pathway_names n USING (pathway_id) GROUP BY p.pathway_id, n.name"""),
    "SRC10_keyed_files": with_views("""
        SELECT 'moa' AS outname, cor_type, cell, 'raw_pert' AS pert_type, moa, round(r, 6) AS r
        FROM v_results"""),
    "SRC11_setups": with_views("""
        SELECT DISTINCT 'moa' AS outname, cor_type, 'raw_pert' AS pert_type FROM v_results"""),
    "SRC12_records_compounds": with_views("WITH " + _REC + " SELECT * FROM recs WHERE kind = 'compound'"),
    "SRC12_records_genes": with_views("WITH " + _REC + " SELECT * FROM recs WHERE kind = 'gene'"),
    "SRC12_records_both": with_views("WITH " + _REC + " SELECT * FROM recs"),
    "SNK1_csv": with_views("SELECT ccle_name, gene, round(value, 6) AS value FROM v_trans"),
    "SNK2_stats": q_neighbors.ORACLES["ANA7_class_purity"],
    "SNK3_partitioned": with_views("SELECT moa, round(r, 6) AS r, cor_type, cell FROM v_results"),
    "SNK5_distinct_text": with_views("""
        SELECT DISTINCT moa AS value FROM v_compounds WHERE moa IS NOT NULL AND moa <> 'nan'"""),
    "SNK7_clusters": q_compounds.ORACLES["CHM4_single_linkage"],
}

