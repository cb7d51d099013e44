"""Registered queries: label/compound statistics, histograms, describe,
rankings, pathway coverage and intersections (AGG2-9, AGG18-22, WIN2, WIN3,
WIN6, TOP1-3)."""

from __future__ import annotations

from pyspark.sql import functions as F

from sigflow.functions import vectors as V
from sigflow.functions.common import rounded
from sigflow.operators import aggregates as G
from sigflow.operators import annotate as A
from sigflow.operators import pathways as P
from sigflow.plans.oracles_base import with_views
from sigflow.plans.q_tables import _FIRST_COMP, _JN1
from sigflow.sources import proxies as px

# Group-size histogram edges and labels of the reference's
# compound notebook (the last edge is the largest group + 1).
SIZE_EDGES = [0.5, 1.5, 2.5, 5.5, 10.5, 50.5]
SIZE_LABELS = ["1", "2", "3-5", "6-10", "11-50", "51+"]
RNA_MIN = 8                  # genes per pathway (the reference uses 15 on real pathways)
MET_THRESHOLDS = [1, 3, 5, 8, 10]
N_VALUE_BINS = 20


def _jn2(spark, sf):
    s = px.signatures(spark, sf).select("sig_id")
    d = A.annotate_drug(s, px.sig_info(spark, sf), px.compounds(spark, sf))
    return A.annotate_cell(d, px.sig_info(spark, sf), px.cells(spark, sf))


def _sig_info_named(spark, sf):
    comp = A.first_compound_row(px.compounds(spark, sf)).select("pert_id", "cmap_name")
    return px.sig_info(spark, sf).join(comp, "pert_id", "inner")


def agg2_compound_stats(spark, sf):
    return rounded(G.compound_stats(px.compounds(spark, sf)))


def agg3_sigs_per_label(spark, sf):
    return G.value_counts(_jn2(spark, sf), "moa", "n_signatures")


def agg4_label_summary(spark, sf):
    return G.label_summary(px.compounds(spark, sf), _sig_info_named(spark, sf), top=30)


def _drugs_per_label(spark, sf):
    comp = px.compounds(spark, sf)
    first = comp.groupBy("cmap_name").agg(F.min_by("moa", "_ord").alias("moa"))
    return first.where(F.col("moa").isNotNull()).groupBy("moa").agg(F.count("*").alias("size"))


def agg5_size_histogram(spark, sf):
    sizes = _drugs_per_label(spark, sf)
    top = sizes.agg(F.max("size")).first()[0]          # one scalar: the last edge
    return rounded(G.histogram(sizes, "size", SIZE_EDGES + [top + 1], SIZE_LABELS))


def agg6_pair_counts(spark, sf):
    return rounded(G.pair_counts(_jn2(spark, sf)))


def agg7_describe(spark, sf):
    return rounded(G.describe(G.pair_counts(_jn2(spark, sf)), "mean_pairs"))


def agg18_centroids(spark, sf):
    s = px.signatures(spark, sf).select("moa", F.col("features")[0].cast("double").alias("c1"),
                                        F.col("features")[1].cast("double").alias("c2"))
    return rounded(G.group_centroids(s, "moa", "c1", "c2"))


def agg19_value_histogram(spark, sf):
    return rounded(G.value_histogram(px.signatures_long(spark, sf), "v", N_VALUE_BINS))


def agg20_label_cluster(spark, sf):
    return G.compounds_per_label_cluster(px.compounds(spark, sf))


def agg21_structures(spark, sf):
    return G.distinct_per_label(px.compounds(spark, sf))


def agg22_rows_per_cluster(spark, sf):
    comp = A.first_compound_row(px.compounds(spark, sf))
    t = px.sig_info(spark, sf).join(comp.select("pert_id", "cluster_id"), "pert_id", "inner")
    return G.value_counts(t, "cluster_id", "n_rows")


def win2_rank_desc(spark, sf):
    return G.rank_desc(px.signatures_long(spark, sf), "sig_id", "gene", "v").select("sig_id", "gene", "rank")


def win3_avg_rank(spark, sf):
    return G.average_rank_long(px.signatures_long(spark, sf), "sig_id", "v").select(
        "sig_id", "gene", "avg_rank")


def win3_avg_rank_vector(spark, sf):
    s = px.signatures(spark, sf)
    return s.select("sig_id", F.posexplode(V.average_ranks("features")).alias("gene", "avg_rank"))


def win6_running_sum(spark, sf):
    r = G.running_sum(px.signatures_long(spark, sf), "sig_id", [F.col("v").desc(), F.col("gene")],
                      F.abs("v"))
    return rounded(r.select("sig_id", "gene", "running"))


def _coverage(spark, sf):
    return P.coverage(px.pathways(spark, sf), px.measured(spark, sf))


def agg8_coverage(spark, sf):
    return rounded(_coverage(spark, sf))


def agg8_coverage_stats(spark, sf):
    return rounded(P.coverage_stats(_coverage(spark, sf)))


def _met_measured(spark, sf):
    return px.genes(spark, sf).where(F.col("gene") % 4 != 1)


def _intersections(spark, sf):
    return P.intersections(px.pathways(spark, sf), px.measured(spark, sf),
                           px.pathways(spark, sf), _met_measured(spark, sf),
                           px.pathway_names(spark, sf), MET_THRESHOLDS, rna_threshold=RNA_MIN)


def agg9_intersections(spark, sf):
    return _intersections(spark, sf)[0]


def agg9_intersection_members(spark, sf):
    return _intersections(spark, sf)[1]


def top1_least_covered(spark, sf):
    return rounded(P.least_covered(_coverage(spark, sf), px.pathway_names(spark, sf), 5))


def top2_top_labels(spark, sf):
    return G.largest(G.value_counts(_jn2(spark, sf), "moa", "n_signatures"), 5, "n_signatures", "moa")


def top3_sorted(spark, sf):
    return G.value_counts(_jn2(spark, sf), "cell_iname", "n").orderBy(F.col("n").desc(), "cell_iname")


QUERIES = {
    "AGG2_compound_stats": agg2_compound_stats, "AGG3_sigs_per_label": agg3_sigs_per_label,
    "AGG4_label_summary": agg4_label_summary, "AGG5_size_histogram": agg5_size_histogram,
    "AGG6_pair_counts": agg6_pair_counts, "AGG7_describe": agg7_describe,
    "AGG18_centroids": agg18_centroids, "AGG19_value_histogram": agg19_value_histogram,
    "AGG20_label_cluster": agg20_label_cluster, "AGG21_structures": agg21_structures,
    "AGG22_rows_per_cluster": agg22_rows_per_cluster,
    "WIN2_rank_desc": win2_rank_desc, "WIN3_avg_rank": win3_avg_rank,
    "WIN3_avg_rank_vector": win3_avg_rank_vector, "WIN6_running_sum": win6_running_sum,
    "AGG8_coverage": agg8_coverage, "AGG8_coverage_stats": agg8_coverage_stats,
    "AGG9_intersections": agg9_intersections, "AGG9_intersection_members": agg9_intersection_members,
    "TOP1_least_covered": top1_least_covered, "TOP2_top_labels": top2_top_labels,
    "TOP3_sorted": top3_sorted,
}

# ---------------------------------------------------------------- oracles
_COV = """cov AS (
    SELECT p.pathway_id, count(*) AS n_total, count(m.gene) AS n_found,
           count(m.gene) / count(*) AS coverage
    FROM v_pathways p LEFT JOIN v_measured m USING (gene) GROUP BY p.pathway_id)"""
_SIZES = """sizes AS (
    SELECT moa, count(*) AS size FROM (
        SELECT cmap_name, moa FROM v_compounds
        QUALIFY row_number() OVER (PARTITION BY cmap_name ORDER BY _ord) = 1)
    WHERE moa IS NOT NULL GROUP BY moa)"""
_PAIRS = _JN1 + """,
pairs AS (SELECT cell_iname, avg(CAST((n * (n - 1)) // 2 AS DOUBLE)) AS mean_pairs FROM (
            SELECT cell_iname, moa, count(*) AS n FROM jn2
            WHERE cell_iname IS NOT NULL AND moa IS NOT NULL GROUP BY ALL) GROUP BY cell_iname)"""
_INTER = f"""rna AS (SELECT p.pathway_id FROM v_pathways p LEFT JOIN v_measured m USING (gene)
                GROUP BY p.pathway_id HAVING count(m.gene) >= {RNA_MIN}),
met AS (SELECT p.pathway_id, count(m.gene) AS n_measured FROM v_pathways p
        LEFT JOIN (SELECT gene FROM v_genes WHERE gene % 4 <> 1) m USING (gene) GROUP BY p.pathway_id),
ts AS (SELECT unnest([{', '.join(str(t) for t in MET_THRESHOLDS)}]) AS threshold),
flags AS (SELECT ts.threshold, met.pathway_id, rna.pathway_id IS NOT NULL AS in_rna,
                 nm.pathway_id IS NOT NULL AS in_l1000
          FROM met JOIN ts ON met.n_measured >= ts.threshold
          LEFT JOIN rna USING (pathway_id) LEFT JOIN (SELECT DISTINCT pathway_id FROM v_pathway_names) nm
          USING (pathway_id))"""


def _hist_sql():
    cases = []
    edges = SIZE_EDGES
    rows = []
    for i, lab in enumerate(SIZE_LABELS):
        lo = f"CAST({edges[i]} AS DOUBLE)"
        if i + 1 < len(edges):
            hi = f"CAST({edges[i + 1]} AS DOUBLE)"
            cases.append(f"WHEN size >= {lo} AND size < {hi} THEN {i}")
        else:
            hi = "(SELECT max(size) + 1 FROM sizes)"
            cases.append(f"WHEN size >= {lo} AND size <= {hi} THEN {i}")
        rows.append(f"SELECT {i} AS bin, '{lab}' AS label, {lo} AS lo, CAST({hi} AS DOUBLE) AS hi")
    return ("WITH " + _SIZES + ",\nbins AS (" + " UNION ALL ".join(rows) + "),\n"
            "counted AS (SELECT bin, count(*) AS count FROM (SELECT CASE " + " ".join(cases)
            + " END AS bin FROM sizes) WHERE bin IS NOT NULL GROUP BY bin)\n"
            "SELECT b.bin, b.label, round(b.lo, 6) AS lo, round(b.hi, 6) AS hi, "
            "coalesce(c.count, 0) AS count, "
            "round(coalesce(c.count, 0) * 100.0 / (SELECT sum(count) FROM counted), 6) AS pct "
            "FROM bins b LEFT JOIN counted c USING (bin)")


ORACLES = {
    "AGG2_compound_stats": with_views("""
        SELECT count(DISTINCT cmap_name) AS n_drugs,
               count(DISTINCT CASE WHEN moa IS NOT NULL THEN cmap_name END) AS n_drugs_labelled,
               count(DISTINCT moa) AS n_labels, round(count(moa) / count(*), 6) AS labelled_fraction,
               round((SELECT avg(n) FROM (SELECT count(cmap_name) AS n FROM v_compounds
                                          WHERE moa IS NOT NULL GROUP BY moa)), 6) AS mean_group_size
        FROM v_compounds"""),
    "AGG3_sigs_per_label": with_views("WITH " + _JN1 + """
        SELECT moa, count(*) AS n_signatures FROM jn2 WHERE moa IS NOT NULL GROUP BY moa"""),
    "AGG4_label_summary": with_views(
        """WITH first AS (SELECT cmap_name, moa FROM v_compounds
                       QUALIFY row_number() OVER (PARTITION BY cmap_name ORDER BY _ord) = 1),
        """ + _FIRST_COMP + """,
        si AS (SELECT s.*, fc.cmap_name FROM v_sig_info s JOIN first_comp fc USING (pert_id)),
        drugs AS (SELECT moa, count(*) AS n_drugs FROM first WHERE moa IS NOT NULL GROUP BY moa),
        sigs AS (SELECT f.moa, count(si.sig_id) AS n_sigs, count(DISTINCT si.cell_iname) AS n_cell_lines
                 FROM si JOIN first f USING (cmap_name) WHERE f.moa IS NOT NULL GROUP BY f.moa)
        SELECT coalesce(d.moa, s.moa) AS moa, n_drugs, n_sigs, n_cell_lines
        FROM drugs d FULL JOIN sigs s ON d.moa = s.moa
        ORDER BY n_drugs DESC NULLS LAST, moa LIMIT 30"""),
    "AGG5_size_histogram": with_views(_hist_sql()),
    "AGG6_pair_counts": with_views("WITH " + _PAIRS + """
        SELECT cell_iname, round(mean_pairs, 6) AS mean_pairs FROM pairs"""),
    "AGG7_describe": with_views("WITH " + _PAIRS + """
        SELECT count(mean_pairs) AS count, round(avg(mean_pairs), 6) AS mean,
               round(stddev_samp(mean_pairs), 6) AS std, round(min(mean_pairs), 6) AS min,
               round(quantile_cont(mean_pairs, 0.25), 6) AS q25, round(median(mean_pairs), 6) AS q50,
               round(quantile_cont(mean_pairs, 0.75), 6) AS q75, round(max(mean_pairs), 6) AS max,
               round((SELECT v FROM (SELECT mean_pairs AS v, count(*) AS n FROM pairs GROUP BY 1)
                      ORDER BY n DESC, v ASC LIMIT 1), 6) AS mode
        FROM pairs"""),
    "AGG18_centroids": with_views("""
        SELECT moa, round(avg(CAST(features[1] AS DOUBLE)), 6) AS mean_x,
               round(avg(CAST(features[2] AS DOUBLE)), 6) AS mean_y,
               round(stddev_samp(CAST(features[1] AS DOUBLE)), 6) AS std_x,
               round(stddev_samp(CAST(features[2] AS DOUBLE)), 6) AS std_y, count(*) AS n
        FROM v_signatures GROUP BY moa"""),
    "AGG19_value_histogram": with_views(f"""
        WITH r AS (SELECT min(v) AS lo, max(v) AS hi FROM v_signatures_long),
        b AS (SELECT CAST(least(floor((v - lo) / ((hi - lo) / {N_VALUE_BINS})), {N_VALUE_BINS - 1}) AS INTEGER)
                     AS bin FROM v_signatures_long, r WHERE v IS NOT NULL)
        SELECT bin, round(lo + bin * ((hi - lo) / {N_VALUE_BINS}), 6) AS lo,
               round(lo + (bin + 1) * ((hi - lo) / {N_VALUE_BINS}), 6) AS hi, count(*) AS count
        FROM b, r GROUP BY bin, r.lo, r.hi"""),
    "AGG20_label_cluster": with_views("""
        SELECT moa, cluster_id, count(*) AS n_compounds FROM v_compounds
        WHERE moa IS NOT NULL AND cluster_id IS NOT NULL GROUP BY ALL"""),
    "AGG21_structures": with_views("""
        SELECT moa, count(DISTINCT canonical_smiles) AS n_canonical_smiles FROM v_compounds
        WHERE moa IS NOT NULL GROUP BY moa"""),
    "AGG22_rows_per_cluster": with_views("WITH " + _FIRST_COMP + """
        SELECT cluster_id, count(*) AS n_rows FROM v_sig_info JOIN first_comp USING (pert_id)
        WHERE cluster_id IS NOT NULL GROUP BY cluster_id"""),
    "WIN2_rank_desc": with_views("""
        SELECT sig_id, gene, CAST(row_number() OVER (PARTITION BY sig_id ORDER BY v DESC, gene) AS INTEGER) AS rank
        FROM v_signatures_long"""),
    "WIN3_avg_rank": with_views("""
        SELECT sig_id, gene, rank() OVER (PARTITION BY sig_id ORDER BY v)
               + (count(*) OVER (PARTITION BY sig_id, v) - 1) / 2.0 AS avg_rank
        FROM v_signatures_long"""),
    "WIN3_avg_rank_vector": with_views("""
        SELECT sig_id, gene, rank() OVER (PARTITION BY sig_id ORDER BY v)
               + (count(*) OVER (PARTITION BY sig_id, v) - 1) / 2.0 AS avg_rank
        FROM v_signatures_long"""),
    "WIN6_running_sum": with_views("""
        SELECT sig_id, gene, round(sum(abs(v)) OVER (PARTITION BY sig_id ORDER BY v DESC, gene
                                   ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 6) AS running
        FROM v_signatures_long"""),
    "AGG8_coverage": with_views("WITH " + _COV + """
        SELECT pathway_id, n_total, n_found, round(coverage, 6) AS coverage FROM cov"""),
    "AGG8_coverage_stats": with_views("WITH " + _COV + """
        SELECT round(avg(coverage), 6) AS mean, round(median(coverage), 6) AS median,
               round(stddev_samp(coverage), 6) AS std, round(min(coverage), 6) AS min,
               round(max(coverage), 6) AS max, CAST(count_if(coverage = 1.0) AS BIGINT) AS pathways_full_coverage,
               CAST(count_if(coverage > 0 AND coverage < 1.0) AS BIGINT) AS pathways_partial_coverage,
               CAST(count_if(coverage = 0) AS BIGINT) AS pathways_no_coverage, count(*) AS n_pathways_total
        FROM cov"""),
    "AGG9_intersections": with_views("WITH " + _INTER + """
        SELECT ts.threshold, coalesce(c.met_pathways_count, 0) AS met_pathways_count,
               coalesce(c.met_and_rna_count, 0) AS met_and_rna_count, coalesce(c.count, 0) AS count
        FROM ts LEFT JOIN (SELECT threshold, count(*) AS met_pathways_count,
                                  CAST(count_if(in_rna) AS BIGINT) AS met_and_rna_count,
                                  CAST(count_if(in_rna AND in_l1000) AS BIGINT) AS count
                           FROM flags GROUP BY threshold) c USING (threshold)"""),
    "AGG9_intersection_members": with_views("WITH " + _INTER + """
        SELECT threshold, pathway_id FROM flags WHERE in_rna AND in_l1000"""),
    "TOP1_least_covered": with_views("WITH " + _COV + """
        SELECT c.pathway_id, round(c.coverage, 6) AS coverage, coalesce(n.name, 'Unknown') AS name
        FROM (SELECT * FROM cov ORDER BY coverage, pathway_id LIMIT 5) c
        LEFT JOIN v_pathway_names n USING (pathway_id)"""),
    "TOP2_top_labels": with_views("WITH " + _JN1 + """
        SELECT moa, count(*) AS n_signatures FROM jn2 WHERE moa IS NOT NULL GROUP BY moa
        ORDER BY n_signatures DESC, moa LIMIT 5"""),
    "TOP3_sorted": with_views("WITH " + _JN1 + """
        SELECT cell_iname, count(*) AS n FROM jn2 WHERE cell_iname IS NOT NULL GROUP BY cell_iname
        ORDER BY n DESC, cell_iname"""),
}
