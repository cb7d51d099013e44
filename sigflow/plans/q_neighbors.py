"""Registered queries: k-NN label purity study (ANA6-ANA8, AGG16, AGG17,
WIN5)."""

from __future__ import annotations

from pyspark.sql import functions as F

from sigflow.functions.common import rounded
from sigflow.operators import neighbors as nb
from sigflow.plans.oracles_base import with_views
from sigflow.session import cut_lineage
from sigflow.sources import proxies as px

K = 5  # neighbours incl. self (fixed value of the reference study)


def ana6_knn(spark, sf):
    """Exact k-NN on standardised signatures: one row per (query, neighbour)."""
    s = px.signatures(spark, sf)
    nn = nb.knn(s, "sig_id", "features", K)
    return rounded(nn.select("q_id", "c_id", "rank", "dist"))


def ana7_class_purity(spark, sf):
    """Flagship: neighbour-label purity per class with baseline and lift."""
    s = px.signatures(spark, sf)
    samples = nb.neighbor_purity(s, "sig_id", "features", "moa", K)
    return rounded(nb.class_purity_stats(samples, "moa"))


def agg16_global_purity(spark, sf):
    s = px.signatures(spark, sf)
    samples = nb.neighbor_purity(s, "sig_id", "features", "moa", K)
    return rounded(nb.global_purity(samples, "moa"))


def ana8_cell_purity(spark, sf):
    """k-NN purity inside every cell line (scaler fitted per cell)."""
    s = px.signatures(spark, sf)
    samples = nb.neighbor_purity(s, "sig_id", "features", "moa", K, group_cols=["cell"])
    return rounded(nb.class_purity_stats(samples, "moa", ["cell"]))


def agg17_median_over_cells(spark, sf):
    s = px.signatures(spark, sf)
    samples = nb.neighbor_purity(s, "sig_id", "features", "moa", K, group_cols=["cell"])
    stats = nb.class_purity_stats(samples, "moa", ["cell"])
    return rounded(nb.median_across_groups(stats, "moa"))


def _pathway_matrix(spark, sf):
    """The signature x pathway matrix as vectors, with both labels."""
    mem = px.pathways(spark, sf)
    scores = (px.signatures_long(spark, sf).join(mem, "gene").groupBy("sig_id", "pathway_id").agg(F.avg("v").alias("v")))
    vec = scores.groupBy("sig_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pathway_id", "v"))), lambda x: x["v"])
                                       .alias("features"))
    return vec.join(px.signatures(spark, sf).select("sig_id", "cell", "moa"), "sig_id")


def _labelled(df):
    """The study's labels: the mechanism, and a structural cluster (NULL for some)."""
    return df.withColumn("cluster", F.when(F.col("sig_id") % 11 != 0, F.col("sig_id") % 6).cast("int"))


def ana7_all_studies(spark, sf):
    """Neighbour purity for both labels on both matrices: the neighbours of a
    matrix are found once and compared under every label."""
    out = None
    for name, m in (("raw", px.signatures(spark, sf)), ("pathways", _pathway_matrix(spark, sf))):
        nn = nb.knn(_labelled(m), "sig_id", "features", K, carry=["moa", "cluster"]).where(F.col("q_id") != F.col("c_id"))
        nn = cut_lineage(nn)
        for label in ("moa", "cluster"):
            same = (nb.label_key(f"q_{label}") == nb.label_key(f"c_{label}")).cast("double")
            samples = nn.groupBy("q_id", F.col(f"q_{label}").alias(label)).agg(F.avg(same).alias("nn_purity"))
            stats = nb.class_purity_stats(samples, label).select(
                F.lit(name).alias("matrix"), F.lit(label).alias("label"), F.col(label).alias("class"), "mean", "std", "count",
                "random_baseline", "lift")
            out = stats if out is None else out.unionByName(stats)
    return rounded(out)


QUERIES = {
    "ANA7_all_studies": ana7_all_studies,
    "ANA6_knn": ana6_knn,
    "WIN5_knn_rank": ana6_knn,
    "ANA7_class_purity": ana7_class_purity,
    "AGG16_global_purity": agg16_global_purity,
    "ANA8_cell_purity": ana8_cell_purity,
    "AGG17_median_over_cells": agg17_median_over_cells,
}

# ---------------------------------------------------------------- oracles
_Z = """
z_stats AS (
    SELECT {g} gene, avg(v) AS m,
           CASE WHEN stddev_pop(v) < 2.220446049250313e-15 THEN 1.0 ELSE stddev_pop(v) END AS s
    FROM sl GROUP BY ALL),
z AS (SELECT sl.sig_id, sl.cell, sl.moa, sl.gene, (sl.v - z_stats.m) / z_stats.s AS z
      FROM sl JOIN z_stats USING ({gj}gene)),
dd AS (SELECT a.sig_id AS q_id, b.sig_id AS c_id, a.cell, a.moa AS q_moa, b.moa AS c_moa,
              sqrt(sum((a.z - b.z) * (a.z - b.z))) AS dist
       FROM z a JOIN z b ON a.gene = b.gene {gon}
       GROUP BY ALL),
nn AS (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY dist, c_id) AS rank
       FROM dd QUALIFY rank <= 5),
pur AS (SELECT cell, q_id AS sig_id, q_moa AS moa,
               avg(CASE WHEN coalesce(CAST(q_moa AS VARCHAR), 'unknown')
                           = coalesce(CAST(c_moa AS VARCHAR), 'unknown') THEN 1.0 ELSE 0.0 END)
                   AS nn_purity
        FROM nn WHERE q_id <> c_id GROUP BY ALL),
cls AS (SELECT {g} moa, avg(nn_purity) AS mean, stddev_samp(nn_purity) AS std,
               count(nn_purity) AS count
        FROM pur WHERE moa IS NOT NULL GROUP BY ALL),
tot AS (SELECT {g} count(DISTINCT moa) AS ncls, count(*) AS ntot
        FROM pur WHERE moa IS NOT NULL GROUP BY ALL),
cstats AS (SELECT cls.*, 1.0 / ncls AS random_baseline, mean / (1.0 / ncls) AS lift,
                  CAST(count AS DOUBLE) / ntot AS freq_baseline
           FROM cls {tot_join})
"""


def _knn_ctes(per_cell: bool) -> str:
    g = "cell," if per_cell else ""
    return ("WITH sl AS (SELECT l.sig_id, s.cell, s.moa, l.gene, l.v FROM v_signatures_long l "
            "JOIN v_signatures s USING (sig_id)),"
            + _Z.format(g=g, gj="cell, " if per_cell else "",
                        gon="AND a.cell = b.cell" if per_cell else "",
                        tot_join="JOIN tot USING (cell)" if per_cell else ", tot"))


def _study_sql() -> str:
    """Both matrices, both labels."""
    label = {"moa": "s.moa", "cluster": "CASE WHEN l.sig_id % 11 <> 0 THEN CAST(l.sig_id % 6 AS INTEGER) END"}
    matrix = {"raw": "SELECT sig_id, gene, v FROM v_signatures_long",
              "pathways": "SELECT l.sig_id, p.pathway_id AS gene, avg(l.v) AS v FROM v_signatures_long l "
                          "JOIN v_pathways p USING (gene) GROUP BY l.sig_id, p.pathway_id"}
    parts = []
    for m, rows in matrix.items():
        for name, c in label.items():
            parts.append("SELECT * FROM (WITH sl AS (SELECT l.sig_id, s.cell, " + c + " AS moa, l.gene, l.v FROM (" + rows
                         + ") l JOIN v_signatures s USING (sig_id))," + _Z.format(g="", gj="", gon="", tot_join=", tot")
                         + f"""SELECT '{m}' AS matrix, '{name}' AS label, moa AS class, round(mean, 6) AS mean, round(std, 6) AS std,
                         count, round(random_baseline, 6) AS random_baseline, round(lift, 6) AS lift FROM cstats)""")
    return with_views(" UNION ALL ".join(parts))


ORACLES = {
    "ANA7_all_studies": _study_sql(),
    "ANA6_knn": with_views(_knn_ctes(False) + """
        SELECT q_id, c_id, CAST(rank AS INTEGER) AS rank, round(dist, 6) AS dist FROM nn"""),
    "WIN5_knn_rank": with_views(_knn_ctes(False) + """
        SELECT q_id, c_id, CAST(rank AS INTEGER) AS rank, round(dist, 6) AS dist FROM nn"""),
    "ANA7_class_purity": with_views(_knn_ctes(False) + """
        SELECT moa, round(mean, 6) AS mean, round(std, 6) AS std, count,
               round(random_baseline, 6) AS random_baseline, round(lift, 6) AS lift,
               round(freq_baseline, 6) AS freq_baseline FROM cstats"""),
    "AGG16_global_purity": with_views(_knn_ctes(False) + """
        SELECT round(avg(nn_purity), 6) AS global_purity, count(DISTINCT moa) AS n_classes,
               round(1.0 / count(DISTINCT moa), 6) AS random_baseline,
               round(avg(nn_purity) / (1.0 / count(DISTINCT moa)), 6) AS lift
        FROM pur"""),
    "ANA8_cell_purity": with_views(_knn_ctes(True) + """
        SELECT cell, moa, round(mean, 6) AS mean, round(std, 6) AS std, count,
               round(random_baseline, 6) AS random_baseline, round(lift, 6) AS lift,
               round(freq_baseline, 6) AS freq_baseline FROM cstats"""),
    "AGG17_median_over_cells": with_views(_knn_ctes(True) + """
        SELECT moa, round(median(mean), 6) AS mean, round(median(std), 6) AS std,
               round(median(CAST(count AS DOUBLE)), 6) AS count,
               round(median(random_baseline), 6) AS random_baseline,
               round(median(lift), 6) AS lift
        FROM cstats GROUP BY moa"""),
}
