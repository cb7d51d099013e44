"""Registered queries: sources, filters, dedup, joins, sets and scalar
functions (SRC1-4, WIN1, FLT1-10, JN1-7, JN9-14, AGG1, AGG23, SET1-3,
FN1-4)."""

from __future__ import annotations

from pyspark.sql import functions as F

from sigflow.functions import vectors as V
from sigflow.functions.common import rounded
from sigflow.operators import annotate as A
from sigflow.operators import tables as TB
from sigflow.plans.oracles_base import with_views
from sigflow.sources import proxies as px

T_ACT = px.ACTIVITY_THRESHOLD
ACTIVE_TYPE = "purchase"   # plays the reference's 'trt_cp'


# ------------------------------------------------------------------ sources
def src1_matrix(spark, sf):
    s = px.signatures(spark, sf)
    return rounded(s.select("sig_id", F.size("features").alias("n_features"),
                            V.vsum("features").alias("feature_sum")))


def src2_first_n(spark, sf):
    """First n samples of the matrix (n is the feature)."""
    s = px.signatures(spark, sf)
    return s.orderBy("sig_id").limit(100).select("sig_id", "moa")


def src3_by_ids(spark, sf):
    s = px.signatures(spark, sf)
    return s.join(px.available_ids(spark, sf), "sig_id", "left_semi").select("sig_id", "moa")


def src4_ids_only(spark, sf):
    return px.signatures(spark, sf).select("sig_id")


# ------------------------------------------------------------------ dedup
def win1_keep_first(spark, sf):
    return A.first_compound_row(px.compounds(spark, sf))


def win1_keep_last(spark, sf):
    return TB.last_wins_map(px.metabolite_map(spark, sf), "Query", "KEGG")


# ------------------------------------------------------------------ filters
def flt1_activity(spark, sf):
    return TB.activity_filter(px.sig_info(spark, sf), px.available_ids(spark, sf), T_ACT, ACTIVE_TYPE)


def flt1_report(spark, sf):
    return TB.activity_report(px.sig_info(spark, sf), px.available_ids(spark, sf), T_ACT, ACTIVE_TYPE)


def _null_feature_summary(df):
    return rounded(df.select("sig_id", F.size("features").alias("n_features"),
                             V.vsum("features").alias("feature_sum")))


def flt2_drop_null_features(spark, sf):
    s = px.signatures_with_nulls(spark, sf)
    return _null_feature_summary(TB.drop_null_features(s, "features"))


def flt2_drop_after_filter(spark, sf):
    """Mask taken after filtering (moa < 5), as in the ML entry point."""
    s = px.signatures_with_nulls(spark, sf).where(F.col("moa") < 5)
    return _null_feature_summary(TB.drop_null_features(s, "features"))


def flt3_keep_in_set(spark, sf):
    return px.sig_info(spark, sf).join(px.signatures(spark, sf).select("sig_id"), "sig_id", "left_semi")


def flt4_filter_cells(spark, sf):
    return px.signatures(spark, sf).where(F.col("cell").isin([1, 3])).select("sig_id", "cell")


def flt5_label_notnull(spark, sf):
    return px.compounds(spark, sf).dropna(subset=["moa"]).select("pert_id", "moa", "_ord")


def flt6_valid_ids(spark, sf):
    return px.cells(spark, sf).where(TB.valid_registry_id("cellosaurus_id"))


def flt7_metab_kept(spark, sf):
    kept, _ = TB.prune_metabolites(px.metabolomics(spark, sf), px.metabolite_map(spark, sf))
    return rounded(kept.select("ccle_name", "metabolite", "value"))


def flt7_metab_lipids(spark, sf):
    _, lip = TB.prune_metabolites(px.metabolomics(spark, sf), px.metabolite_map(spark, sf))
    return rounded(lip.select("ccle_name", "metabolite", "value"))


def flt8_project(spark, sf):
    si = px.sig_info(spark, sf)
    return (si.drop("tas").withColumnRenamed("pert_id", "drug_id")
            .select("sig_id", "drug_id", "cell_iname"))


def flt9_float32(spark, sf):
    r = px.regression(spark, sf).select("row_id", F.col("features").cast("array<double>").alias("f"))
    r = TB.to_float32(r)
    return rounded(r.select("row_id", *[F.col("f")[i].cast("double").alias(f"f{i}") for i in range(3)]))


def flt10_usable(spark, sf):
    return TB.usable_encoding(px.signatures(spark, sf), "features").select("sig_id")


# ------------------------------------------------------------------ joins
def jn1_annotate_drug(spark, sf):
    s = px.signatures(spark, sf).select("sig_id")
    return A.annotate_drug(s, px.sig_info(spark, sf), px.compounds(spark, sf))


def jn2_annotate_cell(spark, sf):
    s = px.signatures(spark, sf).select("sig_id")
    d = A.annotate_drug(s, px.sig_info(spark, sf), px.compounds(spark, sf))
    return A.annotate_cell(d, px.sig_info(spark, sf), px.cells(spark, sf))


def jn2_annotate_cell_filtered(spark, sf):
    s = px.signatures(spark, sf).select("sig_id")
    d = A.annotate_drug(s, px.sig_info(spark, sf), px.compounds(spark, sf))
    return A.annotate_cell(d, px.sig_info(spark, sf), px.cells(spark, sf), cells=[3, 7, 11, 19])


def jn3_ccle_registry(spark, sf):
    return A.ccle_to_registry(px.depmap(spark, sf))


def jn4_sig_registry(spark, sf):
    return A.sig_to_registry(px.sig_info(spark, sf), px.cells(spark, sf))


def _harmonized(spark, sf):
    return A.harmonize(px.transcriptomics(spark, sf), px.metabolomics(spark, sf),
                       px.signatures(spark, sf).select("sig_id", "features"),
                       px.sig_info(spark, sf), px.cells(spark, sf), px.depmap(spark, sf))


def jn5_harmonized_trans(spark, sf):
    th, _, _, _, _ = _harmonized(spark, sf)
    return rounded(th.select("cell_id", "gene", "value"))


def jn5_harmonized_l1000(spark, sf):
    _, _, lh, _, _ = _harmonized(spark, sf)
    return lh.select("sig_id", "cell_id", "drug_id")


def jn5_stats(spark, sf):
    th, mh, lh, cmap, l1000 = _harmonized(spark, sf)
    tr, me = px.transcriptomics(spark, sf), px.metabolomics(spark, sf)

    def mapped(long_df):
        cells = long_df.select(F.col("ccle_name").alias("CCLEName")).distinct()
        return cells.join(cmap, "CCLEName", "left").agg(
            F.count_if(F.col("RRID").isNotNull()).alias("mapped"), F.count("*").alias("total"))

    t, m = mapped(tr), mapped(me)
    lstat = l1000.agg(F.count_if(F.col("cellosaurus_id").isNotNull()).alias("l1000_mapped"),
                      F.count("*").alias("l1000_total"))
    # one-row aggregates combined as scalar subqueries (no join)
    return lstat.select(
        t.select("mapped").scalar().alias("ccle_trans_mapped"),
        t.select("total").scalar().alias("ccle_trans_total"),
        m.select("mapped").scalar().alias("ccle_metab_mapped"),
        m.select("total").scalar().alias("ccle_metab_total"),
        "l1000_mapped", "l1000_total")


def agg23_overlap(spark, sf):
    th, mh, lh, _, _ = _harmonized(spark, sf)
    return A.overlap_report(th, mh, lh)


def jn6_gene_ids(spark, sf):
    out = A.convert_gene_ids(px.transcriptomics(spark, sf).select("ccle_name", "gene", "value"),
                             px.gene_map(spark, sf))
    return rounded(out)


def jn7_attach_hue(spark, sf):
    s = px.signatures(spark, sf).select("sig_id")
    return s.join(px.sig_info(spark, sf).select("sig_id", "pert_type"), "sig_id", "left")


def _dense(bits, n):
    """On-bit list -> dense 0/1 vector of length n."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)),
                       lambda i: F.when(F.array_contains(bits, i), 1.0).otherwise(0.0))


def jn9_lookup_vectors(spark, sf):
    """Drug vectors for every signature's drug; drugs with no vector get 0s."""
    enc = (px.fingerprints(spark, sf).where(F.col("drug_id") % 3 != 0)
           .select(F.col("drug_id").alias("pert_id"),
                   _dense("bits", 64).alias("vec")))
    keys = px.sig_info(spark, sf).select("sig_id", "pert_id")
    out = A.lookup_vectors(keys, enc, "pert_id", "vec", 64)
    return rounded(out.select("sig_id", "pert_id", "_missing", V.vsum("vec").alias("vec_sum"),
                              F.size("vec").alias("dim")))


def jn10_hybrid(spark, sf):
    fp = px.fingerprints(spark, sf)
    a = fp.where(F.col("drug_id") % 2 == 0).select("drug_id", _dense("bits", 64).alias("a"))
    b = px.signatures(spark, sf).where(F.col("sig_id") % 3 != 0).select(
        F.col("sig_id").alias("drug_id"), F.col("features").alias("b"))
    h = A.hybrid_encoding(a, b, "drug_id", "a", "b")
    return rounded(h.select("drug_id", F.size("vec").alias("dim"), V.vsum("vec").alias("vec_sum")))


def jn11_pathway_measured(spark, sf):
    pw = px.pathways(spark, sf)
    m = px.measured(spark, sf).withColumn("_m", F.lit(True))
    return (pw.join(m, "gene", "left").groupBy("pathway_id")
            .agg(F.count("*").alias("n_members"), F.count_if(F.col("_m").isNotNull()).alias("n_found")))


def _label_counts(spark, sf):
    comp = A.first_compound_row(px.compounds(spark, sf)).where(F.col("moa").isNotNull())
    drugs = comp.groupBy("moa").agg(F.count("*").alias("n_drugs"))
    s = px.signatures(spark, sf).select("sig_id")
    ann = A.annotate_cell(A.annotate_drug(s, px.sig_info(spark, sf), px.compounds(spark, sf)),
                          px.sig_info(spark, sf), px.cells(spark, sf))
    sigs = ann.groupBy("moa").agg(F.count("*").alias("n_signatures"))
    cells = ann.groupBy("moa").agg(F.count_distinct("cell_iname").alias("n_cells"))
    return drugs, sigs, cells


def jn12_outer_aligned(spark, sf):
    drugs, sigs, cells = _label_counts(spark, sf)
    return drugs.join(sigs, "moa", "full").join(cells, "moa", "full")


def jn13_by_name(spark, sf):
    comp = A.first_compound_row(px.compounds(spark, sf))
    si = px.sig_info(spark, sf).join(comp.select("pert_id", "cmap_name"), "pert_id", "inner")
    clusters = px.compounds(spark, sf).select("cmap_name", "cluster_id").distinct()
    return si.join(clusters, "cmap_name", "left").select("sig_id", "cmap_name", "cluster_id")


def jn14_semi_anti(spark, sf):
    si = px.sig_info(spark, sf)
    av = px.available_ids(spark, sf)
    semi = si.join(av, "sig_id", "left_semi").select("sig_id", F.lit("in").alias("side"))
    anti = si.join(av, "sig_id", "left_anti").select("sig_id", F.lit("out").alias("side"))
    return semi.unionByName(anti)


# ------------------------------------------------------------------ profile, sets, scalar fns
def agg1_profile(spark, sf):
    return TB.column_profile(px.sig_info(spark, sf))


def agg1_values(spark, sf):
    return TB.column_values(px.sig_info(spark, sf), ["cell_iname", "pert_type", "pert_id"])


def set1_intersect(spark, sf):
    a = px.sig_info(spark, sf).select("sig_id")
    b = px.signatures(spark, sf).select("sig_id")
    c = px.available_ids(spark, sf)
    return a.intersect(b).intersect(c)


def set2_union(spark, sf):
    r = px.results_long(spark, sf)
    a = r.where(F.col("cor_type") == "pearson").select("cell", "moa", "r")
    b = (r.where(F.col("cor_type") == "spearman")
         .select("cell", "moa", "r", F.lit("spearman").alias("extra")))
    return rounded(a.unionByName(b, allowMissingColumns=True))


def set3_difference(spark, sf):
    return px.sig_info(spark, sf).select("sig_id").exceptAll(px.available_ids(spark, sf))


def fn1_strings(spark, sf):
    t = px.transcriptomics(spark, sf).select("ccle_name", "gene").distinct()
    return t.select(
        "ccle_name", "gene",
        A.strip_version("gene").alias("gene_base"),
        F.trim(F.concat(F.lit("  "), F.col("gene"), F.lit(" "))).alias("trimmed"),
        F.col("ccle_name").startswith("CELL_1").alias("is_cell_1"),
        F.length("gene").alias("len"),
        F.regexp_extract("gene", r"^ENSG(\d+)\.(\d)$", 1).alias("num"),
        F.replace(F.col("ccle_name"), F.lit("CELL_"), F.lit("C")).alias("short"),
        F.concat_ws("|", "ccle_name", "gene").alias("joined"))


def fn2_numeric(spark, sf):
    si = px.sig_info(spark, sf)
    return rounded(si.select(
        "sig_id", F.abs(F.col("tas") - 35.0).alias("abs_dev"), F.round("tas", 4).alias("tas_r4"),
        F.expr("(sig_id * (sig_id - 1)) div 2").alias("pairs"),
        F.try_divide(F.col("tas"), F.col("pert_id") * 3).alias("ratio"),
        F.col("tas").cast("bigint").cast("string").alias("tas_str")))


def fn3_nulls(spark, sf):
    s = px.signatures_with_nulls(spark, sf)
    filled = F.transform("features", lambda x: F.when(
        x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), F.lit(0.0)).otherwise(x.cast("double")))
    return rounded(s.select(
        "sig_id", F.size(F.filter("features", lambda x: x.isNull())).alias("n_null"),
        V.vsum(filled).alias("filled_sum")))


def fn4_vectors(spark, sf):
    s = px.signatures(spark, sf)
    a = s.select("sig_id", F.col("features").alias("a"))
    b = s.select((F.col("sig_id") - 1).alias("sig_id"), F.col("features").alias("b"))
    j = a.join(b, "sig_id")
    return rounded(j.select(
        "sig_id", V.dot("a", "b").alias("dot"), V.norm("a").alias("norm_a"),
        F.size(F.concat("a", "b")).alias("concat_len"),
        F.aggregate(F.zip_with("a", "b", lambda x, y: (F.signum(x) == F.signum(y)).cast("double")),
                    F.lit(0.0), lambda acc, x: acc + x).__truediv__(F.size("a")).alias("sign_agree")))


QUERIES = {
    "SRC1_matrix": src1_matrix, "SRC2_first_n": src2_first_n, "SRC3_by_ids": src3_by_ids,
    "SRC4_ids_only": src4_ids_only,
    "WIN1_keep_first": win1_keep_first, "WIN1_keep_last": win1_keep_last,
    "FLT1_activity": flt1_activity, "FLT1_report": flt1_report,
    "FLT2_drop_null_features": flt2_drop_null_features, "FLT2_drop_after_filter": flt2_drop_after_filter,
    "FLT3_keep_in_set": flt3_keep_in_set, "FLT4_filter_cells": flt4_filter_cells,
    "FLT5_label_notnull": flt5_label_notnull, "FLT6_valid_ids": flt6_valid_ids,
    "FLT7_metab_kept": flt7_metab_kept, "FLT7_metab_lipids": flt7_metab_lipids,
    "FLT8_project": flt8_project, "FLT9_float32": flt9_float32, "FLT10_usable": flt10_usable,
    "JN1_annotate_drug": jn1_annotate_drug, "JN2_annotate_cell": jn2_annotate_cell,
    "JN2_annotate_cell_filtered": jn2_annotate_cell_filtered,
    "JN3_ccle_registry": jn3_ccle_registry, "JN4_sig_registry": jn4_sig_registry,
    "JN5_harmonized_trans": jn5_harmonized_trans, "JN5_harmonized_l1000": jn5_harmonized_l1000,
    "JN5_stats": jn5_stats, "AGG23_overlap": agg23_overlap, "JN6_gene_ids": jn6_gene_ids,
    "JN7_attach_hue": jn7_attach_hue, "JN9_lookup_vectors": jn9_lookup_vectors,
    "JN10_hybrid": jn10_hybrid, "JN11_pathway_measured": jn11_pathway_measured,
    "JN12_outer_aligned": jn12_outer_aligned, "JN13_by_name": jn13_by_name,
    "JN14_semi_anti": jn14_semi_anti,
    "AGG1_profile": agg1_profile, "AGG1_values": agg1_values,
    "SET1_intersect": set1_intersect, "SET2_union": set2_union, "SET3_difference": set3_difference,
    "FN1_strings": fn1_strings, "FN2_numeric": fn2_numeric, "FN3_nulls": fn3_nulls,
    "FN4_vectors": fn4_vectors,
}

# ---------------------------------------------------------------- oracles
_FIRST_COMP = """first_comp AS (
    SELECT pert_id, cmap_name, moa, cluster_id, canonical_smiles, _ord FROM v_compounds
    QUALIFY row_number() OVER (PARTITION BY pert_id ORDER BY _ord) = 1)"""
_JN1 = _FIRST_COMP + """,
jn1 AS (SELECT s.sig_id, m.moa FROM v_signatures s JOIN (
          SELECT si.sig_id, c.moa FROM v_sig_info si LEFT JOIN first_comp c USING (pert_id)
          WHERE c.moa IS NOT NULL) m USING (sig_id)),
cellann AS (SELECT si.sig_id, si.cell_iname FROM v_sig_info si JOIN v_cells c USING (cell_iname)
            WHERE si.cell_iname IS NOT NULL),
jn2 AS (SELECT jn1.sig_id, jn1.moa, cellann.cell_iname FROM jn1 LEFT JOIN cellann USING (sig_id))"""
_CMAP = """cmap AS (
    SELECT CCLEName, RRID FROM v_depmap
    WHERE CCLEName IS NOT NULL AND RRID IS NOT NULL AND starts_with(RRID, 'CVCL_') AND length(CCLEName) > 0
    QUALIFY row_number() OVER (PARTITION BY CCLEName ORDER BY _ord) = 1),
sigmap AS (
    SELECT si.sig_id, si.cell_iname, si.pert_id, c.cellosaurus_id FROM v_sig_info si LEFT JOIN (
        SELECT cell_iname, cellosaurus_id FROM v_cells
        WHERE cellosaurus_id IS NOT NULL AND starts_with(cellosaurus_id, 'CVCL_') AND length(cellosaurus_id) > 0
        QUALIFY row_number() OVER (PARTITION BY cell_iname ORDER BY _ord) = 1) c USING (cell_iname)),
trans_h AS (
    SELECT t.gene, t.value, ch.RRID AS cell_id FROM v_trans t JOIN (
        SELECT RRID, arg_min(ccle_name, _cell_ord) AS ccle_name FROM (
            SELECT DISTINCT t.ccle_name, t._cell_ord, cmap.RRID FROM v_trans t
            JOIN cmap ON cmap.CCLEName = t.ccle_name) GROUP BY RRID) ch USING (ccle_name)),
metab_h AS (
    SELECT t.metabolite, t.value, ch.RRID AS cell_id FROM v_metab t JOIN (
        SELECT RRID, arg_min(ccle_name, _cell_ord) AS ccle_name FROM (
            SELECT DISTINCT t.ccle_name, t._cell_ord, cmap.RRID FROM v_metab t
            JOIN cmap ON cmap.CCLEName = t.ccle_name) GROUP BY RRID) ch USING (ccle_name)),
l1000 AS (SELECT s.sig_id, m.pert_id, m.cellosaurus_id FROM v_signatures s LEFT JOIN sigmap m USING (sig_id)),
l1000_h AS (SELECT sig_id, cellosaurus_id AS cell_id, pert_id AS drug_id FROM l1000
            WHERE cellosaurus_id IS NOT NULL)"""
_METAB = """namemap AS (
    SELECT Query, KEGG FROM v_metab_map
    QUALIFY row_number() OVER (PARTITION BY Query ORDER BY _ord DESC) = 1),
known AS (SELECT Query AS metabolite FROM v_metab_map
          UNION SELECT KEGG FROM v_metab_map WHERE KEGG IS NOT NULL),
step1 AS (SELECT * FROM v_metab WHERE metabolite NOT IN (
            SELECT Query FROM namemap WHERE KEGG IS NULL))"""

ORACLES = {
    "SRC1_matrix": with_views("""
        SELECT sig_id, CAST(len(features) AS INTEGER) AS n_features,
               round(list_sum(CAST(features AS DOUBLE[])), 6) AS feature_sum
        FROM v_signatures"""),
    "SRC2_first_n": with_views("SELECT sig_id, moa FROM v_signatures ORDER BY sig_id LIMIT 100"),
    "SRC3_by_ids": with_views("""
        SELECT sig_id, moa FROM v_signatures WHERE sig_id IN (SELECT sig_id FROM v_available)"""),
    "SRC4_ids_only": with_views("SELECT sig_id FROM v_signatures"),
    "WIN1_keep_first": with_views("WITH " + _FIRST_COMP + " SELECT * FROM first_comp"),
    "WIN1_keep_last": with_views("""
        SELECT Query, KEGG FROM v_metab_map
        QUALIFY row_number() OVER (PARTITION BY Query ORDER BY _ord DESC) = 1"""),
    "FLT1_activity": with_views(f"""
        SELECT * FROM v_sig_info WHERE tas > CAST({T_ACT} AS DOUBLE) AND pert_type = '{ACTIVE_TYPE}'
        AND sig_id IN (SELECT sig_id FROM v_available)"""),
    "FLT1_report": with_views(f"""
        WITH c AS (SELECT *, sig_id IN (SELECT sig_id FROM v_available) AS found FROM v_sig_info
                   WHERE tas > CAST({T_ACT} AS DOUBLE) AND pert_type = '{ACTIVE_TYPE}')
        SELECT count(*) AS n_candidates, CAST(count_if(found) AS BIGINT) AS n_found,
               CAST(count_if(NOT found) AS BIGINT) AS n_dropped,
               count(DISTINCT CASE WHEN found THEN cell_iname END) AS n_cells,
               count(DISTINCT CASE WHEN found THEN pert_id END) AS n_drugs FROM c"""),
    "FLT2_drop_null_features": with_views("""
        WITH keep AS (SELECT gene FROM v_signatures_null GROUP BY gene HAVING count_if(v IS NULL) = 0)
        SELECT sig_id, CAST(count(*) AS INTEGER) AS n_features, round(sum(v), 6) AS feature_sum
        FROM v_signatures_null WHERE gene IN (SELECT gene FROM keep) GROUP BY sig_id"""),
    "FLT2_drop_after_filter": with_views("""
        WITH f AS (SELECT n.* FROM v_signatures_null n JOIN v_signatures s USING (sig_id) WHERE s.moa < 5),
        keep AS (SELECT gene FROM f GROUP BY gene HAVING count_if(v IS NULL) = 0)
        SELECT sig_id, CAST(count(*) AS INTEGER) AS n_features, round(sum(v), 6) AS feature_sum
        FROM f WHERE gene IN (SELECT gene FROM keep) GROUP BY sig_id"""),
    "FLT3_keep_in_set": with_views("""
        SELECT * FROM v_sig_info WHERE sig_id IN (SELECT sig_id FROM v_signatures)"""),
    "FLT4_filter_cells": with_views("SELECT sig_id, cell FROM v_signatures WHERE cell IN (1, 3)"),
    "FLT5_label_notnull": with_views("SELECT pert_id, moa, _ord FROM v_compounds WHERE moa IS NOT NULL"),
    "FLT6_valid_ids": with_views("""
        SELECT * FROM v_cells WHERE cellosaurus_id IS NOT NULL AND starts_with(cellosaurus_id, 'CVCL_')
        AND length(cellosaurus_id) > 0"""),
    "FLT7_metab_kept": with_views("WITH " + _METAB + """
        SELECT s.ccle_name, coalesce(n.KEGG, s.metabolite) AS metabolite, round(s.value, 6) AS value
        FROM step1 s LEFT JOIN namemap n ON n.Query = s.metabolite
        WHERE s.metabolite IN (SELECT metabolite FROM known)"""),
    "FLT7_metab_lipids": with_views("WITH " + _METAB + """
        SELECT ccle_name, metabolite, round(value, 6) AS value FROM step1
        WHERE metabolite NOT IN (SELECT metabolite FROM known)"""),
    "FLT8_project": with_views("SELECT sig_id, pert_id AS drug_id, cell_iname FROM v_sig_info"),
    "FLT9_float32": with_views("""
        SELECT CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) || '-' || CAST(l_partkey AS VARCHAR) || '-' || CAST(l_suppkey AS VARCHAR) || '-' || CAST(CAST(round(l_extendedprice * 100) AS BIGINT) AS VARCHAR) AS row_id,
               round(CAST(CAST(l_quantity AS FLOAT) AS DOUBLE), 6) AS f0,
               round(CAST(CAST(l_discount AS FLOAT) AS DOUBLE), 6) AS f1,
               round(CAST(CAST(l_tax AS FLOAT) AS DOUBLE), 6) AS f2 FROM lineitem"""),
    "FLT10_usable": with_views("""
        SELECT sig_id FROM v_signatures_long GROUP BY sig_id HAVING sum(v) > 0"""),
    "JN1_annotate_drug": with_views("WITH " + _JN1 + " SELECT * FROM jn1"),
    "JN2_annotate_cell": with_views("WITH " + _JN1 + " SELECT * FROM jn2"),
    "JN2_annotate_cell_filtered": with_views(
        "WITH " + _JN1 + " SELECT * FROM jn2 WHERE cell_iname IN (3, 7, 11, 19)"),
    "JN3_ccle_registry": with_views("WITH " + _CMAP + " SELECT * FROM cmap"),
    "JN4_sig_registry": with_views("WITH " + _CMAP + " SELECT * FROM sigmap"),
    "JN5_harmonized_trans": with_views(
        "WITH " + _CMAP + " SELECT cell_id, gene, round(value, 6) AS value FROM trans_h"),
    "JN5_harmonized_l1000": with_views("WITH " + _CMAP + " SELECT * FROM l1000_h"),
    "JN5_stats": with_views("WITH " + _CMAP + """
        SELECT (SELECT count(*) FILTER (WHERE RRID IS NOT NULL) FROM (SELECT DISTINCT ccle_name FROM v_trans) t
                    LEFT JOIN cmap ON cmap.CCLEName = t.ccle_name) AS ccle_trans_mapped,
               (SELECT count(DISTINCT ccle_name) FROM v_trans) AS ccle_trans_total,
               (SELECT count(*) FILTER (WHERE RRID IS NOT NULL) FROM (SELECT DISTINCT ccle_name FROM v_metab) t
                    LEFT JOIN cmap ON cmap.CCLEName = t.ccle_name) AS ccle_metab_mapped,
               (SELECT count(DISTINCT ccle_name) FROM v_metab) AS ccle_metab_total,
               (SELECT count(cellosaurus_id) FROM l1000) AS l1000_mapped,
               (SELECT count(*) FROM l1000) AS l1000_total"""),
    "AGG23_overlap": with_views("WITH " + _CMAP + """,
        t AS (SELECT DISTINCT cell_id FROM trans_h), m AS (SELECT DISTINCT cell_id FROM metab_h),
        l AS (SELECT DISTINCT cell_id FROM l1000_h)
        SELECT (SELECT count(*) FROM t) AS n_trans, (SELECT count(*) FROM m) AS n_metab,
               (SELECT count(*) FROM l) AS n_l1000,
               (SELECT count(*) FROM t JOIN l USING (cell_id)) AS n_trans_l1000,
               (SELECT count(*) FROM m JOIN l USING (cell_id)) AS n_metab_l1000,
               (SELECT count(*) FROM t JOIN l USING (cell_id) JOIN m USING (cell_id)) AS n_all"""),
    "JN6_gene_ids": with_views("""
        WITH gm AS (SELECT query, symbol FROM v_gene_map
                    QUALIFY row_number() OVER (PARTITION BY query ORDER BY _ord DESC) = 1)
        SELECT t.ccle_name, round(t.value, 6) AS value, gm.symbol AS gene FROM v_trans t
        JOIN gm ON gm.query = split_part(t.gene, '.', 1) WHERE gm.symbol IS NOT NULL"""),
    "JN7_attach_hue": with_views("""
        SELECT s.sig_id, si.pert_type FROM v_signatures s LEFT JOIN v_sig_info si USING (sig_id)"""),
    "JN9_lookup_vectors": with_views("""
        WITH enc AS (SELECT drug_id AS pert_id, len(bits) AS bsum FROM v_fingerprints WHERE drug_id % 3 <> 0)
        SELECT si.sig_id, si.pert_id, enc.pert_id IS NULL AS _missing,
               round(coalesce(CAST(enc.bsum AS DOUBLE), 0.0), 6) AS vec_sum, 64 AS dim
        FROM v_sig_info si LEFT JOIN enc USING (pert_id)"""),
    "JN10_hybrid": with_views("""
        WITH a AS (SELECT drug_id, bits FROM v_fingerprints WHERE drug_id % 2 = 0),
        b AS (SELECT sig_id AS drug_id, features FROM v_signatures WHERE sig_id % 3 <> 0)
        SELECT drug_id, CAST(64 + len(features) AS INTEGER) AS dim,
               round(CAST(len(bits) AS DOUBLE) + list_sum(CAST(features AS DOUBLE[])), 6) AS vec_sum
        FROM a JOIN b USING (drug_id)"""),
    "JN11_pathway_measured": with_views("""
        SELECT p.pathway_id, count(*) AS n_members, count(m.gene) AS n_found
        FROM v_pathways p LEFT JOIN v_measured m USING (gene) GROUP BY p.pathway_id"""),
    "JN12_outer_aligned": with_views("WITH " + _JN1 + """,
        drugs AS (SELECT moa, count(*) AS n_drugs FROM first_comp WHERE moa IS NOT NULL GROUP BY moa),
        sigs AS (SELECT moa, count(*) AS n_signatures FROM jn2 GROUP BY moa),
        cells AS (SELECT moa, count(DISTINCT cell_iname) AS n_cells FROM jn2 GROUP BY moa)
        SELECT coalesce(d.moa, s.moa, c.moa) AS moa, n_drugs, n_signatures, n_cells
        FROM drugs d FULL JOIN sigs s ON d.moa = s.moa FULL JOIN cells c ON c.moa = coalesce(d.moa, s.moa)"""),
    "JN13_by_name": with_views("WITH " + _FIRST_COMP + """
        SELECT si.sig_id, fc.cmap_name, cl.cluster_id FROM v_sig_info si JOIN first_comp fc USING (pert_id)
        LEFT JOIN (SELECT DISTINCT cmap_name, cluster_id FROM v_compounds) cl USING (cmap_name)"""),
    "JN14_semi_anti": with_views("""
        SELECT sig_id, CASE WHEN sig_id IN (SELECT sig_id FROM v_available) THEN 'in' ELSE 'out' END AS side
        FROM v_sig_info"""),
    "AGG1_profile": with_views("""
        SELECT 'sig_id' AS column, count(DISTINCT sig_id) AS n_distinct FROM v_sig_info
        UNION ALL SELECT 'cell_iname', count(DISTINCT cell_iname) FROM v_sig_info
        UNION ALL SELECT 'pert_type', count(DISTINCT pert_type) FROM v_sig_info
        UNION ALL SELECT 'tas', count(DISTINCT CAST(tas AS VARCHAR)) FROM v_sig_info
        UNION ALL SELECT 'pert_id', count(DISTINCT pert_id) FROM v_sig_info"""),
    "AGG1_values": with_views("""
        SELECT DISTINCT 'cell_iname' AS column, CAST(cell_iname AS VARCHAR) AS value FROM v_sig_info
        UNION SELECT DISTINCT 'pert_type', pert_type FROM v_sig_info
        UNION SELECT DISTINCT 'pert_id', CAST(pert_id AS VARCHAR) FROM v_sig_info WHERE pert_id IS NOT NULL"""),
    "SET1_intersect": with_views("""
        SELECT sig_id FROM v_sig_info INTERSECT SELECT sig_id FROM v_signatures
        INTERSECT SELECT sig_id FROM v_available"""),
    "SET2_union": with_views("""
        SELECT cell, moa, round(r, 6) AS r, NULL::VARCHAR AS extra FROM v_results WHERE cor_type = 'pearson'
        UNION ALL
        SELECT cell, moa, round(r, 6), 'spearman' FROM v_results WHERE cor_type = 'spearman'"""),
    "SET3_difference": with_views("""
        SELECT sig_id FROM v_sig_info EXCEPT ALL SELECT sig_id FROM v_available"""),
    "FN1_strings": with_views(r"""
        SELECT DISTINCT ccle_name, gene, split_part(gene, '.', 1) AS gene_base,
               trim('  ' || gene || ' ') AS trimmed, starts_with(ccle_name, 'CELL_1') AS is_cell_1,
               CAST(length(gene) AS INTEGER) AS len,
               regexp_extract(gene, '^ENSG(\d+)\.(\d)$', 1) AS num,
               replace(ccle_name, 'CELL_', 'C') AS short, ccle_name || '|' || gene AS joined
        FROM v_trans"""),
    "FN2_numeric": with_views("""
        SELECT sig_id, round(abs(tas - CAST(35.0 AS DOUBLE)), 6) AS abs_dev, round(round(tas, 4), 6) AS tas_r4,
               (sig_id * (sig_id - 1)) // 2 AS pairs,
               round(CASE WHEN pert_id = 0 THEN NULL ELSE tas / (pert_id * 3) END, 6) AS ratio,
               CAST(CAST(trunc(tas) AS BIGINT) AS VARCHAR) AS tas_str
        FROM v_sig_info"""),
    "FN3_nulls": with_views("""
        SELECT sig_id, CAST(count_if(v IS NULL) AS INTEGER) AS n_null,
               round(sum(coalesce(CASE WHEN isnan(v) OR isinf(v) THEN 0.0 ELSE v END, 0.0)), 6) AS filled_sum
        FROM v_signatures_null GROUP BY sig_id"""),
    "FN4_vectors": with_views("""
        SELECT a.sig_id, round(sum(a.v * b.v), 6) AS dot, round(sqrt(sum(a.v * a.v)), 6) AS norm_a,
               CAST(2 * count(*) AS INTEGER) AS concat_len,
               round(avg(CASE WHEN sign(a.v) = sign(b.v) THEN 1.0 ELSE 0.0 END), 6) AS sign_agree
        FROM v_signatures_long a JOIN v_signatures_long b ON b.sig_id = a.sig_id + 1 AND a.gene = b.gene
        GROUP BY a.sig_id"""),
}
