"""Registered queries: intra- vs inter-label correlation study (ANA1-ANA5,
ANA14, WIN4, AGG10-AGG15)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from sigflow.functions.common import rounded
from sigflow.operators import annotate as A
from sigflow.operators import correlations as C
from sigflow.plans.oracles_base import with_views
from sigflow.sources import proxies as px

# Fixed values of the study: the reference's driver caps pairs at 50 per
# (cell, label); our draws use seed 42.
MAX_PAIRS = 50
SEED = 42
SETUP = ["cor_type"]


def pathway_matrix(spark, sf):
    """Signature x pathway scores (D2): mean of the member genes' values,
    vector ordered by pathway id."""
    long = px.signatures_long(spark, sf).join(px.pathways(spark, sf), "gene")
    per = long.groupBy("sig_id", "pathway_id").agg(F.avg("v").alias("score"))
    vec = per.groupBy("sig_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pathway_id", "score"))),
                    lambda t: t["score"]).alias("features"))
    return px.signatures(spark, sf).drop("features").join(vec, "sig_id")


def _pairs(spark, sf, cor_type, matrix="raw"):
    s = px.signatures(spark, sf) if matrix == "raw" else pathway_matrix(spark, sf)
    return C.pair_correlations(s, "sig_id", "features", "cell", "moa", cor_type, MAX_PAIRS, SEED)


def ana1_pearson(spark, sf):
    """Pearson r of each signature with the next one (run_cor / _fast_cor)."""
    s = C.correlation_ready(px.signatures(spark, sf), "features", "pearson")
    a = s.select("sig_id", F.col("_u").alias("_ua"))
    b = s.select((F.col("sig_id") - 1).alias("sig_id"), F.col("_u").alias("_ub"))
    return rounded(a.join(b, "sig_id").select("sig_id", C.correlation("_ua", "_ub").alias("r")))


def ana2_spearman(spark, sf):
    s = C.correlation_ready(px.signatures(spark, sf), "features", "spearman")
    a = s.select("sig_id", F.col("_u").alias("_ua"))
    b = s.select((F.col("sig_id") - 1).alias("sig_id"), F.col("_u").alias("_ub"))
    return rounded(a.join(b, "sig_id").select("sig_id", C.correlation("_ua", "_ub").alias("r")))


def ana3_intra_pairs(spark, sf):
    return rounded(_pairs(spark, sf, "pearson").where(F.col("kind") == "intra"))


def ana4_null_sample(spark, sf):
    return rounded(_pairs(spark, sf, "pearson").where(F.col("kind") == "inter"))


def ana2_spearman_pairs(spark, sf):
    return rounded(_pairs(spark, sf, "spearman"))


def win4_pair_cap(spark, sf):
    p = _pairs(spark, sf, "pearson").where(F.col("kind") == "intra")
    return p.groupBy("cell", "label").agg(F.count("*").alias("n_pairs"))


def with_cluster(spark, sf, sigs):
    """Signatures with the structure cluster of their drug; those without go."""
    drug = A.first_compound_row(px.compounds(spark, sf))
    ids = px.sig_info(spark, sf).select("sig_id", "pert_id").join(drug.select("pert_id", "cluster_id"), "pert_id")
    return sigs.join(ids.select("sig_id", "cluster_id"), "sig_id").where(F.col("cluster_id").isNotNull())


def _study(spark, sf, label="moa"):
    """All four setups of a label share ids, cells and labels, hence one set
    of draws; the four prepared vector tables meet the endpoints in one join."""
    raw, pathway = px.signatures(spark, sf), pathway_matrix(spark, sf)
    if label == "cluster_id":
        raw, pathway = with_cluster(spark, sf, raw), with_cluster(spark, sf, pathway)
    ends = C.draw_pair_endpoints(raw, "sig_id", "cell", label, MAX_PAIRS, SEED)
    parts = []
    for matrix, m in (("raw", raw), ("pathway", pathway)):
        for cor in ("pearson", "spearman"):
            v = C.correlation_ready(m.select(F.col("sig_id").alias("_id"), "features"), "features", cor)
            parts.append(v.select("_id", F.lit(matrix).alias("matrix"), F.lit(cor).alias("cor_type"), "_u"))
    vecs = reduce(lambda a, b: a.unionByName(b), parts)
    return C.correlate_endpoints(ends, vecs, ["matrix", "cor_type"])


def ana5_full_study(spark, sf):
    return rounded(C.label_medians(_study(spark, sf), ["matrix", "cor_type"]))


def ana5_all_setups(spark, sf):
    """2 labels x 2 matrices x 2 correlations."""
    parts = [C.label_medians(_study(spark, sf, label), ["matrix", "cor_type"]).withColumn("outname", F.lit(label))
             for label in ("moa", "cluster_id")]
    return rounded(parts[0].unionByName(parts[1]))


def ana14_compare_setups(spark, sf):
    med = C.label_medians(_study(spark, sf), ["matrix", "cor_type"])
    res = med.select("matrix", "cor_type", "cell", F.col("label").alias("moa"),
                     F.col("median_abs_r").alias("r"))
    summ = C.delta_summary(res, ["matrix", "cor_type"])
    return C.setup_medians(summ, ["matrix", "cor_type"])


def agg10_label_medians(spark, sf):
    return rounded(C.label_medians(_pairs(spark, sf, "pearson")))


def agg11_share_above_null(spark, sf):
    return rounded(C.share_above_null(C.label_medians(_pairs(spark, sf, "pearson"))))


def _delta(spark, sf):
    return C.delta_summary(px.results_long(spark, sf), SETUP)


def agg12_delta_summary(spark, sf):
    return rounded(_delta(spark, sf))


def agg13_setup_medians(spark, sf):
    return rounded(C.setup_medians(_delta(spark, sf), SETUP))


def agg14_pivot(spark, sf):
    d = _delta(spark, sf).withColumn("outname", F.lit("moa"))
    return rounded(C.pivot_setups(d, ["outname", "cor_type"], ["moa|pearson", "moa|spearman"]))


def agg15_metric_vs_obs(spark, sf):
    res = px.results_long(spark, sf).where(F.col("cor_type") == "spearman").drop("cor_type")
    s = px.signatures(spark, sf).select("sig_id")
    ann = A.annotate_cell(A.annotate_drug(s, px.sig_info(spark, sf), px.compounds(spark, sf)),
                          px.sig_info(spark, sf), px.cells(spark, sf))
    obs = ann.where(F.col("cell_iname").isNotNull()).groupBy(F.col("cell_iname").alias("cell")).agg(
        F.count("*").alias("n_obs"))
    return rounded(C.metric_vs_observations(res, obs))


QUERIES = {
    "ANA1_pearson": ana1_pearson, "ANA2_spearman": ana2_spearman,
    "ANA3_intra_pairs": ana3_intra_pairs, "ANA4_null_sample": ana4_null_sample,
    "ANA2_spearman_pairs": ana2_spearman_pairs, "WIN4_pair_cap": win4_pair_cap,
    "ANA5_full_study": ana5_full_study, "ANA5_all_setups": ana5_all_setups, "ANA14_compare_setups": ana14_compare_setups,
    "AGG10_label_medians": agg10_label_medians, "AGG11_share_above_null": agg11_share_above_null,
    "AGG12_delta_summary": agg12_delta_summary, "AGG13_setup_medians": agg13_setup_medians,
    "AGG14_pivot": agg14_pivot, "AGG15_metric_vs_obs": agg15_metric_vs_obs,
}

# ---------------------------------------------------------------- oracles
_RAW = """SELECT l.sig_id, s.cell, CAST(s.moa AS VARCHAR) AS label, l.gene, l.v
          FROM v_signatures_long l JOIN v_signatures s USING (sig_id)"""
_PATHWAY = """SELECT l.sig_id, s.cell, CAST(s.moa AS VARCHAR) AS label, p.pathway_id AS gene, avg(l.v) AS v
              FROM v_signatures_long l JOIN v_pathways p USING (gene) JOIN v_signatures s USING (sig_id)
              GROUP BY ALL"""


_CLUSTER = """(SELECT si.sig_id, CAST(c.cluster_id AS VARCHAR) AS cluster FROM v_sig_info si JOIN (
               SELECT pert_id, cluster_id FROM v_compounds
               QUALIFY row_number() OVER (PARTITION BY pert_id ORDER BY _ord) = 1) c USING (pert_id)
           WHERE c.cluster_id IS NOT NULL)"""


def _by_cluster(src: str) -> str:
    return f"SELECT x.sig_id, x.cell, k.cluster AS label, x.gene, x.v FROM ({src}) x JOIN {_CLUSTER} k USING (sig_id)"


def _prep(src: str, cor: str, p: str) -> str:
    x = ("v" if cor == "pearson" else
         "rank() OVER (PARTITION BY sig_id ORDER BY v) + (count(*) OVER (PARTITION BY sig_id, v) - 1) / 2.0")
    return f"""{p}sl AS ({src}),
{p}prep AS (SELECT sig_id, cell, label, gene, {x} AS x FROM {p}sl),
{p}cen AS (SELECT sig_id, gene, x - avg(x) OVER (PARTITION BY sig_id) AS c FROM {p}prep),
{p}nrm AS (SELECT sig_id, sqrt(sum(c * c)) AS nn FROM {p}cen GROUP BY sig_id),
{p}u AS (SELECT c.sig_id, c.gene, CASE WHEN nn > 0 THEN c.c / nn END AS u
         FROM {p}cen c JOIN {p}nrm USING (sig_id))"""


def _pairs_sql(src: str, cor: str, p: str = "") -> str:
    """CTEs ending in {p}res(cell, label, kind, a_id, b_id, r)."""
    s = SEED
    return _prep(src, cor, p) + f""",
{p}mem AS (SELECT sig_id, cell, label,
               row_number() OVER (PARTITION BY cell, label ORDER BY md5('{s}:' || CAST(sig_id AS VARCHAR)), sig_id) - 1
               AS idx
           FROM (SELECT DISTINCT sig_id, cell, label FROM {p}sl)),
{p}grp AS (SELECT cell, label, count(*) AS n FROM {p}mem GROUP BY ALL),
{p}gp AS (SELECT cell, label, n * (n - 1) // 2 AS C, least(n * (n - 1) // 2, {MAX_PAIRS}) AS P
          FROM {p}grp WHERE n >= 2),
{p}ks AS (SELECT cell, label, C, P, unnest(range(CASE WHEN C <= {4 * MAX_PAIRS} THEN C ELSE {4 * MAX_PAIRS + 64} END)) AS k
          FROM {p}gp),
{p}kh AS (SELECT *, md5('{s}:' || CAST(cell AS VARCHAR) || ':' || label || ':' || CAST(k AS VARCHAR)) AS h FROM {p}ks),
{p}dq AS (SELECT cell, label, P, k AS q, row_number() OVER (PARTITION BY cell, label ORDER BY h, k) AS pos
          FROM {p}kh WHERE C <= {4 * MAX_PAIRS}
          UNION ALL
          SELECT cell, label, P, q, row_number() OVER (PARTITION BY cell, label ORDER BY k) AS pos FROM (
              SELECT cell, label, P, CAST(('0x' || substr(h, 1, 15)) AS BIGINT) % C AS q, min(k) AS k
              FROM {p}kh WHERE C > {4 * MAX_PAIRS} GROUP BY ALL)),
{p}qs AS (SELECT cell, label, q FROM {p}dq WHERE pos <= P),
{p}dj AS (SELECT cell, label, q, CAST(floor((1 + sqrt(1 + 8.0 * q)) / 2) AS BIGINT) AS j0 FROM {p}qs),
{p}pj AS (SELECT cell, label, q, CASE WHEN j0 * (j0 - 1) // 2 > q THEN j0 - 1
                                      WHEN (j0 + 1) * j0 // 2 <= q THEN j0 + 1 ELSE j0 END AS j FROM {p}dj),
{p}pairs AS (SELECT cell, label, q, q - j * (j - 1) // 2 AS i, j FROM {p}pj),
{p}intra AS (SELECT pr.cell, pr.label, 'intra' AS kind, pr.q AS dk, ma.sig_id AS a_id, mb.sig_id AS b_id
             FROM {p}pairs pr
             JOIN {p}mem ma ON ma.cell = pr.cell AND ma.label = pr.label AND ma.idx = pr.i
             JOIN {p}mem mb ON mb.cell = pr.cell AND mb.label = pr.label AND mb.idx = pr.j),
{p}nint AS (SELECT cell, count(*) AS N FROM {p}pairs GROUP BY cell),
{p}lab AS (SELECT cell, label, n, row_number() OVER (PARTITION BY cell
               ORDER BY md5('{s}:' || CAST(cell AS VARCHAR) || ':' || label), label) - 1 AS lidx FROM {p}grp),
{p}nlab AS (SELECT cell, count(*) AS L FROM {p}lab GROUP BY cell),
{p}dr AS (SELECT cell, L, unnest(range(N)) AS k FROM {p}nint JOIN {p}nlab USING (cell) WHERE L >= 2),
{p}dh AS (SELECT cell, L, k, md5('{s}:null:' || CAST(cell AS VARCHAR) || ':' || CAST(k AS VARCHAR)) AS h
          FROM {p}dr),
{p}dd AS (SELECT cell, k, h, CAST(('0x' || substr(h, 1, 8)) AS BIGINT) % L AS la,
                 CAST(('0x' || substr(h, 9, 8)) AS BIGINT) % (L - 1) AS ub FROM {p}dh),
{p}de AS (SELECT cell, k, h, la, CASE WHEN ub >= la THEN ub + 1 ELSE ub END AS lb FROM {p}dd),
{p}dl AS (SELECT de.cell, de.k, de.h, la.label AS label_a, la.n AS na, lb.label AS label_b, lb.n AS nb
          FROM {p}de de JOIN {p}lab la ON la.cell = de.cell AND la.lidx = de.la
          JOIN {p}lab lb ON lb.cell = de.cell AND lb.lidx = de.lb),
{p}inter AS (SELECT dl.cell, '__inter_moa__' AS label, 'inter' AS kind, dl.k AS dk,
                    ma.sig_id AS a_id, mb.sig_id AS b_id FROM {p}dl dl
             JOIN {p}mem ma ON ma.cell = dl.cell AND ma.label = dl.label_a
                  AND ma.idx = CAST(('0x' || substr(dl.h, 17, 8)) AS BIGINT) % dl.na
             JOIN {p}mem mb ON mb.cell = dl.cell AND mb.label = dl.label_b
                  AND mb.idx = CAST(('0x' || substr(dl.h, 25, 8)) AS BIGINT) % dl.nb),
{p}allp AS (SELECT * FROM {p}intra UNION ALL SELECT * FROM {p}inter),
{p}res AS (SELECT ap.cell, ap.label, ap.kind, ap.dk, ap.a_id, ap.b_id, round(sum(ua.u * ub.u), 12) AS r
           FROM {p}allp ap JOIN {p}u ua ON ua.sig_id = ap.a_id
           JOIN {p}u ub ON ub.sig_id = ap.b_id AND ub.gene = ua.gene
           GROUP BY ALL)"""


def _next_sql(cor: str) -> str:
    return "WITH " + _prep(_RAW, cor, "") + """
        SELECT a.sig_id, round(round(sum(a.u * b.u), 12), 6) AS r FROM u a JOIN u b
        ON b.sig_id = a.sig_id + 1 AND a.gene = b.gene GROUP BY a.sig_id"""


def _study_sql(label: str = "moa") -> str:
    parts, unions = [], []
    for m, src in (("raw", _RAW), ("pathway", _PATHWAY)):
        for cor in ("pearson", "spearman"):
            p = f"{m}_{cor}_"
            parts.append(_pairs_sql(src if label == "moa" else _by_cluster(src), cor, p))
            unions.append(f"SELECT '{m}' AS matrix, '{cor}' AS cor_type, * FROM {p}res")
    return ("WITH " + ",\n".join(parts) + ",\nstudy AS (" + " UNION ALL ".join(unions) + "),\n"
            "med AS (SELECT matrix, cor_type, cell, label, CASE WHEN count(r) = count(*) THEN "
            "median(abs(r)) END AS median_abs_r, count(*) AS n_pairs FROM study GROUP BY ALL)")


_MED = """,
med AS (SELECT cell, label, CASE WHEN count(r) = count(*) THEN median(abs(r)) END AS median_abs_r,
               count(*) AS n_pairs FROM res GROUP BY ALL)"""
_DELTA = """WITH nul AS (SELECT cor_type, cell, r AS inter_moa FROM v_results WHERE moa = '__inter_moa__'),
d AS (SELECT x.cor_type, x.cell, n.inter_moa, x.r - n.inter_moa AS delta
      FROM v_results x JOIN nul n USING (cor_type, cell)
      WHERE x.moa <> '__inter_moa__' AND x.r - n.inter_moa IS NOT NULL),
summ AS (SELECT cor_type, cell, any_value(inter_moa) AS inter_moa, avg(delta) AS mean_delta,
                median(delta) AS median_delta, avg(CASE WHEN delta > 0 THEN 1.0 ELSE 0.0 END) AS frac_above_null,
                count(*) AS n_moas FROM d GROUP BY cor_type, cell)"""

ORACLES = {
    "ANA1_pearson": with_views(_next_sql("pearson")),
    "ANA2_spearman": with_views(_next_sql("spearman")),
    "ANA3_intra_pairs": with_views("WITH " + _pairs_sql(_RAW, "pearson") + """
        SELECT cell, label, kind, a_id, b_id, round(r, 6) AS r FROM res WHERE kind = 'intra'"""),
    "ANA4_null_sample": with_views("WITH " + _pairs_sql(_RAW, "pearson") + """
        SELECT cell, label, kind, a_id, b_id, round(r, 6) AS r FROM res WHERE kind = 'inter'"""),
    "ANA2_spearman_pairs": with_views("WITH " + _pairs_sql(_RAW, "spearman") + """
        SELECT cell, label, kind, a_id, b_id, round(r, 6) AS r FROM res"""),
    "WIN4_pair_cap": with_views("WITH " + _pairs_sql(_RAW, "pearson") + """
        SELECT cell, label, count(*) AS n_pairs FROM res WHERE kind = 'intra' GROUP BY ALL"""),
    "ANA5_full_study": with_views(_study_sql() + """
        SELECT matrix, cor_type, cell, label, round(median_abs_r, 6) AS median_abs_r, n_pairs FROM med"""),
    "ANA5_all_setups": with_views(" UNION ALL ".join(
        f"SELECT '{label}' AS outname, * FROM ({_study_sql(label)} SELECT matrix, cor_type, cell, label, "
        "round(median_abs_r, 6) AS median_abs_r, n_pairs FROM med)" for label in ("moa", "cluster_id"))),
    "ANA14_compare_setups": with_views(_study_sql() + """,
        nul AS (SELECT matrix, cor_type, cell, median_abs_r AS inter_moa FROM med WHERE label = '__inter_moa__'),
        d AS (SELECT x.matrix, x.cor_type, x.cell, n.inter_moa, x.median_abs_r - n.inter_moa AS delta
              FROM med x JOIN nul n USING (matrix, cor_type, cell)
              WHERE x.label <> '__inter_moa__' AND x.median_abs_r - n.inter_moa IS NOT NULL),
        summ AS (SELECT matrix, cor_type, cell, any_value(inter_moa) AS inter_moa,
                        median(delta) AS median_delta,
                        avg(CASE WHEN delta > 0 THEN 1.0 ELSE 0.0 END) AS frac_above_null
                 FROM d GROUP BY ALL)
        SELECT matrix, cor_type, round(median(median_delta), 4) AS median_delta,
               round(median(frac_above_null), 4) AS frac_above_null, round(median(inter_moa), 4) AS inter_moa
        FROM summ GROUP BY ALL"""),
    "AGG10_label_medians": with_views("WITH " + _pairs_sql(_RAW, "pearson") + _MED + """
        SELECT cell, label, round(median_abs_r, 6) AS median_abs_r, n_pairs FROM med"""),
    "AGG11_share_above_null": with_views("WITH " + _pairs_sql(_RAW, "pearson") + _MED + """
        SELECT m.cell, round(count_if(m.median_abs_r > n.median_abs_r) / count(*), 6) AS frac_above_null,
               count(*) AS n_labels
        FROM med m LEFT JOIN (SELECT cell, median_abs_r FROM med WHERE label = '__inter_moa__') n USING (cell)
        WHERE m.label <> '__inter_moa__' GROUP BY m.cell"""),
    "AGG12_delta_summary": with_views(_DELTA + """
        SELECT cor_type, cell, round(inter_moa, 6) AS inter_moa, round(mean_delta, 6) AS mean_delta,
               round(median_delta, 6) AS median_delta, round(frac_above_null, 6) AS frac_above_null, n_moas
        FROM summ"""),
    "AGG13_setup_medians": with_views(_DELTA + """
        SELECT cor_type, round(round(median(median_delta), 4), 6) AS median_delta,
               round(round(median(frac_above_null), 4), 6) AS frac_above_null,
               round(round(median(inter_moa), 4), 6) AS inter_moa FROM summ GROUP BY cor_type"""),
    "AGG14_pivot": with_views(_DELTA + """
        SELECT cell, round(avg(CASE WHEN cor_type = 'pearson' THEN median_delta END), 6) AS "moa|pearson",
               round(avg(CASE WHEN cor_type = 'spearman' THEN median_delta END), 6) AS "moa|spearman"
        FROM summ GROUP BY cell"""),
    "AGG15_metric_vs_obs": with_views("""WITH first_comp AS (
            SELECT pert_id, moa FROM v_compounds
            QUALIFY row_number() OVER (PARTITION BY pert_id ORDER BY _ord) = 1),
        jn1 AS (SELECT s.sig_id, m.moa FROM v_signatures s JOIN (
                  SELECT si.sig_id, c.moa FROM v_sig_info si LEFT JOIN first_comp c USING (pert_id)
                  WHERE c.moa IS NOT NULL) m USING (sig_id)),
        cellann AS (SELECT si.sig_id, si.cell_iname FROM v_sig_info si JOIN v_cells c USING (cell_iname)),
        obs AS (SELECT ca.cell_iname AS cell, count(*) AS n_obs FROM jn1 LEFT JOIN cellann ca USING (sig_id)
                WHERE ca.cell_iname IS NOT NULL GROUP BY ca.cell_iname),
        r AS (SELECT * FROM v_results WHERE cor_type = 'spearman'),
        met AS (SELECT x.cell, median(x.r) - any_value(n.r) AS metric FROM r x
                JOIN (SELECT cell, r FROM r WHERE moa = '__inter_moa__') n USING (cell)
                WHERE x.moa <> '__inter_moa__' GROUP BY x.cell)
        SELECT cell, round(metric, 6) AS metric, n_obs FROM met JOIN obs USING (cell)
        WHERE metric IS NOT NULL"""),
}
