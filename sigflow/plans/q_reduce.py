"""Registered queries: GSVA scores, PCA, neighbour-graph weights and the
pathway study over thresholds (ANA10-ANA13). The SQL of ANA10 adds up the
kernels pair by pair, from series of their own; PCA has no SQL (it needs an
eigen-solver) and is tested against one."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from sigflow.functions.common import rounded
from sigflow.operators import aggregates as G
from sigflow.operators import enrich as E
from sigflow.operators import ml as M
from sigflow.operators import reduce as R
from sigflow.plans.oracles_base import with_views
from sigflow.plans.q_ml import N_PW, _harm
from sigflow.plans.q_neighbors import _knn_ctes
from sigflow.plans.q_tables import _CMAP
from sigflow.session import cut_lineage
from sigflow.sources import proxies as px

# Fixed values of the reference's GSVA calls: metabolomics Gaussian kernel,
# sets of 3..1000 members; transcriptomics Poisson kernel, 15..1000.
MET_MIN, RNA_MIN, SET_MAX = 3, 15, 1000
STUDY_THRESHOLDS = (1, 3)


def _metab(spark, sf):
    _, mh, _, _, _ = _harm(spark, sf)
    long = mh.select(F.col("cell_id").alias("sample"), F.col("metabolite").alias("gene"), "value")
    mem = (long.select("gene").distinct()
           .select((F.substring("gene", 2, 10).cast("int") % N_PW).alias("pathway_id"), "gene"))
    return long, mem


def _trans(spark, sf):
    th, _, _, _, _ = _harm(spark, sf)
    long = th.select(F.col("cell_id").alias("sample"), "gene", "value")
    mem = (long.select("gene").distinct()
           .select((F.regexp_extract("gene", r"^ENSG(\d+)", 1).cast("int") % N_PW).alias("pathway_id"),
                   "gene"))
    return long, mem


def ana10_gsva_metabolomics(spark, sf):
    long, mem = _metab(spark, sf)
    return rounded(E.gsva(long, mem, kernel="gaussian", min_size=MET_MIN, max_size=SET_MAX))


def ana10_gsva_transcriptomics(spark, sf):
    long, mem = _trans(spark, sf)
    return rounded(E.gsva(long, mem, kernel="poisson", min_size=RNA_MIN, max_size=SET_MAX))


def ana11_pca_scores(spark, sf):
    scores, _ = R.pca(px.signatures(spark, sf), "sig_id", "features", k=10, carry=["moa"])
    return rounded(scores)


def ana11_pca_ratios(spark, sf):
    _, ratios = R.pca(px.signatures(spark, sf), "sig_id", "features", k=10)
    return rounded(ratios)


def ana11_pca_norms(spark, sf):
    """With as many components as features the scores are a rotation: each
    signature keeps its squared length, and so the variances their sum."""
    d = px.signatures(spark, sf).select(F.size("features")).first()[0]
    scores, _ = R.pca(px.signatures(spark, sf), "sig_id", "features", k=d)
    square = reduce(lambda a, b: a + b, [F.col(f"pc{i + 1}") ** 2 for i in range(d)])
    return rounded(scores.select("sig_id", square.alias("square")))


def agg18_pca_centroids(spark, sf):
    scores, _ = R.pca(px.signatures(spark, sf), "sig_id", "features", k=2, carry=["moa"])
    return rounded(G.group_centroids(scores, "moa", "pc1", "pc2"))


def ana12_neighbor_graph(spark, sf):
    return rounded(R.neighbor_graph(px.signatures(spark, sf), "sig_id", "features", k=GRAPH_K))


def ana13_threshold_study(spark, sf):
    """For each metabolite threshold: pathways with enough measured members in
    both omics -> GSVA scores of both (computed once, restricted per
    threshold) -> one vector per cell line -> PCA(2) -> centroids per hue."""
    ml, mm = _metab(spark, sf)
    tl, tm = _trans(spark, sf)
    gm = cut_lineage(E.gsva(ml, mm, kernel="gaussian", min_size=1, max_size=SET_MAX))
    gt = cut_lineage(E.gsva(tl, tm, kernel="poisson", min_size=1, max_size=SET_MAX))
    outs = []
    for t in STUDY_THRESHOLDS:
        keep = (gm.where(F.col("set_size") >= t).select("pathway_id").distinct()
                .join(gt.where(F.col("set_size") >= RNA_MIN).select("pathway_id").distinct(), "pathway_id"))
        both = (gm.join(keep, "pathway_id").select("sample", F.concat(F.lit("metab_"),
                                                   F.col("pathway_id").cast("string")).alias("k"), "es")
                .unionByName(gt.join(keep, "pathway_id").select(
                    "sample", F.concat(F.lit("trans_"), F.col("pathway_id").cast("string")).alias("k"), "es")))
        pw = sorted(r[0] for r in keep.collect())          # kept pathway ids: bounded
        if not pw:
            continue
        items = [f"metab_{p}" for p in pw] + [f"trans_{p}" for p in pw]
        vec = M._ordered_vector(both.where(F.col("es").isNotNull()), ["sample"], "k", "es", items,
                                "features")
        hue = F.substring(F.col("sample"), 6, 1)          # registry-id digit as hue
        scores, _ = R.pca(vec.withColumn("hue", hue), "sample", "features", k=2, carry=["hue"])
        outs.append(G.group_centroids(scores, "hue", "pc1", "pc2").withColumn("threshold", F.lit(t)))
    if not outs:
        return spark.createDataFrame([], "hue string, mean_x double, mean_y double, std_x double, "
                                         "std_y double, n bigint, threshold int")
    return rounded(reduce(lambda a, b: a.unionByName(b), outs))


QUERIES = {
    "ANA10_gsva_metabolomics": ana10_gsva_metabolomics,
    "ANA10_gsva_transcriptomics": ana10_gsva_transcriptomics,
    "ANA11_pca_scores": ana11_pca_scores, "ANA11_pca_ratios": ana11_pca_ratios,
    "ANA11_pca_norms": ana11_pca_norms,
    "AGG18_pca_centroids": agg18_pca_centroids,
    "ANA12_neighbor_graph": ana12_neighbor_graph,
    "ANA13_threshold_study": ana13_threshold_study,
}
# the normal CDF: 1/2 plus density times the sum of z^(2n+1) / (2n+1)!!
_NORMAL = """CASE WHEN z > 8 THEN 1.0 WHEN z < -8 THEN 0.0 WHEN z = 0 THEN 0.5 ELSE
    0.5 + sign(z) * exp(-z * z / 2) / sqrt(2 * pi()) * list_sum(list_transform(range(0, 160), lambda n:
        exp((2 * n + 1) * ln(abs(z)) - (n + 1) * ln(2.0) - lgamma(n + 1.5) + ln(pi()) / 2))) END"""
# the Poisson CDF: its terms from far below the mean on, large ones by Stirling's series
_POISSON = """CASE WHEN k < 0 THEN 0.0 WHEN abs(sqrt(lam) - sqrt(k + 1)) > 7 THEN (CASE WHEN lam < k + 1 THEN 1.0 ELSE 0.0 END) ELSE
    coalesce(list_sum(list_transform(range(greatest(0, CAST(floor(lam - 15 * sqrt(lam) - 30) AS BIGINT)), CAST(k AS BIGINT) + 1), lambda i:
        CASE WHEN i < 300 THEN exp(-lam + i * ln(lam) - lgamma(i + 1.0))
        ELSE exp(-i * (lam / i - 1 - ln(lam / i)) - 1.0 / (12.0 * i) + 1.0 / (360.0 * i * i * i)) / sqrt(2 * pi() * i) END)), 0.0) END"""


def _gsva_sql(source: str, pathway: str, kernel: str, min_size: int) -> str:
    pair = {"gaussian": ("(a.v - b.v) / (a.sd / 4) AS z", _NORMAL),
            "poisson": ("floor(a.v) AS k, b.v + 0.5 AS lam", _POISSON)}[kernel]
    return with_views("WITH " + _CMAP + f""",
        raw AS ({source}),
        x AS (SELECT sample, gene, v, n, sd FROM (SELECT *, count(*) OVER g AS n, stddev_samp(v) OVER g AS sd FROM raw
              WHERE v IS NOT NULL WINDOW g AS (PARTITION BY gene)) WHERE sd > 0),
        pairs AS (SELECT a.sample, a.gene, a.n, {pair[0]} FROM x a JOIN x b ON a.gene = b.gene),
        cdf AS (SELECT sample, gene, round(least(greatest(sum({pair[1]}) / n, 0), 1), 9) AS cdf
                FROM pairs GROUP BY sample, gene, n),
        mem AS (SELECT DISTINCT gene, {pathway} AS pathway_id FROM raw),
        sizes AS (SELECT pathway_id, count(*) AS set_size FROM mem GROUP BY pathway_id
                  HAVING count(*) BETWEEN {min_size} AND {SET_MAX}),
        ranked AS (SELECT sample, gene, row_number() OVER (PARTITION BY sample ORDER BY cdf DESC, gene) AS r,
                          count(*) OVER (PARTITION BY sample) AS total FROM cdf),
        hits AS (SELECT sample, pathway_id, r, total, set_size, abs(total / 2.0 - r) AS w FROM ranked
                 JOIN mem USING (gene) JOIN sizes USING (pathway_id)),
        steps AS (SELECT *, row_number() OVER s AS i, sum(w) OVER s AS c, count(*) OVER p AS h, sum(w) OVER p AS wsum
                  FROM hits WINDOW s AS (PARTITION BY sample, pathway_id ORDER BY r), p AS (PARTITION BY sample, pathway_id)),
        walk AS (SELECT *, c / nullif(wsum, 0) - CAST(r - i AS DOUBLE) / nullif(total - h, 0) AS after,
                        (c - w) / nullif(wsum, 0) - CAST(r - i AS DOUBLE) / nullif(total - h, 0) AS before FROM steps)
        SELECT sample, pathway_id, round(CASE WHEN h < total AND wsum > 0 THEN greatest(max(after), 0) + least(min(before), 0) END, 6) AS es,
               h AS n_hits, set_size FROM walk GROUP BY sample, pathway_id, h, total, wsum, set_size""")


GRAPH_K, BISECTIONS = 15, 64           # fixed values of the graph's data stage

# sigma by bisection: doubled until the sum is over its target, then halved
_GRAPH = with_views("WITH RECURSIVE " + _knn_ctes(False)[5:].replace("rank <= 5", f"rank <= {GRAPH_K}") + f""",
    near AS (SELECT q_id, c_id, dist FROM nn WHERE q_id <> c_id),
    lists AS (SELECT q_id, list(dist) AS ds, coalesce(min(dist) FILTER (WHERE dist > 0), 0.0) AS rho FROM near GROUP BY q_id),
    bis AS (SELECT q_id, ds, rho, CAST(0 AS DOUBLE) AS lo, CAST('inf' AS DOUBLE) AS hi, CAST(1 AS DOUBLE) AS sig, 0 AS step FROM lists
            UNION ALL
            SELECT q_id, ds, rho, lo2, hi2, CASE WHEN isfinite(hi2) THEN (lo2 + hi2) / 2 ELSE sig * 2 END, step + 1 FROM (
                SELECT *, CASE WHEN over THEN lo ELSE sig END AS lo2, CASE WHEN over THEN sig ELSE hi END AS hi2 FROM (
                    SELECT *, list_sum(list_transform(ds, lambda x: exp(-greatest(x - rho, 0.0) / sig))) > log2({GRAPH_K}) AS over
                    FROM bis WHERE step < {BISECTIONS}))),
    one AS (SELECT n.q_id AS i, n.c_id AS j, exp(-greatest(n.dist - b.rho, 0.0) / b.sig) AS w
            FROM near n JOIN bis b USING (q_id) WHERE b.step = {BISECTIONS}),
    edges AS (SELECT least(i, j) AS a, greatest(i, j) AS b, coalesce(max(w) FILTER (WHERE i < j), 0.0) AS x,
                    coalesce(max(w) FILTER (WHERE i > j), 0.0) AS y FROM one GROUP BY ALL)
    SELECT a, b, round(x + y - x * y, 6) AS weight FROM edges""")

ORACLES = {
    "ANA12_neighbor_graph": _GRAPH,
    "ANA10_gsva_metabolomics": _gsva_sql(
        "SELECT cell_id AS sample, metabolite AS gene, CAST(value AS DOUBLE) AS v FROM metab_h",
        f"CAST(substring(gene, 2) AS INTEGER) % {N_PW}", "gaussian", MET_MIN),
    "ANA10_gsva_transcriptomics": _gsva_sql(
        "SELECT cell_id AS sample, gene, CAST(value AS DOUBLE) AS v FROM trans_h",
        f"CAST(regexp_extract(gene, '^ENSG([0-9]+)', 1) AS INTEGER) % {N_PW}", "poisson", RNA_MIN),
    "ANA11_pca_norms": with_views("""
        WITH st AS (SELECT gene, avg(v) AS m, stddev_pop(v) AS s FROM v_signatures_long GROUP BY gene)
        SELECT sig_id, round(sum(power((v - m) / CASE WHEN s < 2.220446049250313e-15 THEN 1.0 ELSE s END, 2)), 6) AS square
        FROM v_signatures_long JOIN st USING (gene) GROUP BY sig_id"""),
}
