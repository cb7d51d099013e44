"""Registered queries: response prediction (ML1-ML15)."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from sigflow.functions.common import rounded
from sigflow.operators import annotate as A
from sigflow.operators import compounds as CH
from sigflow.operators import ml as M
from sigflow.plans.oracles_base import with_views
from sigflow.plans.q_tables import _CMAP
from sigflow.session import cut_lineage
from sigflow.sources import proxies as px

# Fixed values of the reference's pipeline: test share 0.2, seed 42,
# 5 folds, 2048-bit fingerprints; encodings x splits x models grid.
TEST_SIZE, SEED, N_FOLDS, FP_BITS = 0.2, 42, 5, 2048
N_PW = 6
ENCODINGS = ("fingerprint", "descriptor", "hybrid", "onehot")
SPLITS = ("random", "cell_line", "drug")


# ------------------------------------------------------------------ ML inputs
def _harm(spark, sf):
    return A.harmonize(px.transcriptomics(spark, sf), px.metabolomics(spark, sf),
                       px.signatures(spark, sf).select("sig_id"),
                       px.sig_info(spark, sf), px.cells(spark, sf), px.depmap(spark, sf))


def ml_inputs(spark, sf):
    """(obs, y_long, trans_long, metab_long): harmonised signatures, their
    pathway scores, and pathway-level basal scores of each cell line."""
    th, mh, lh, _, _ = _harm(spark, sf)
    obs = lh.select(F.col("sig_id").alias("row_id"), "cell_id", "drug_id")
    y = (px.signatures_long(spark, sf).join(px.pathways(spark, sf), "gene")
         .groupBy(F.col("sig_id").alias("row_id"), "pathway_id").agg(F.avg("v").alias("value"))
         .select("row_id", F.concat(F.lit("P"), F.col("pathway_id").cast("string")).alias("pathway"), "value"))
    gnum = F.regexp_extract("gene", r"^ENSG(\d+)", 1).cast("int")
    trans = (th.groupBy("cell_id", F.concat(F.lit("P"), (gnum % N_PW).cast("string")).alias("pathway"))
             .agg(F.avg("value").alias("value")))
    mnum = F.substring("metabolite", 2, 10).cast("int")
    metab = (mh.groupBy("cell_id", F.concat(F.lit("P"), (mnum % N_PW).cast("string")).alias("pathway"))
             .agg(F.avg("value").alias("value")))
    # each input is read several times while the feature table is built
    # (pathway names, common cells, vectors): materialise them once
    return tuple(cut_lineage(d) for d in (obs, y, trans, metab))


def drug_vectors(spark, sf, encoding="fingerprint", drugs=None):
    """Drug encodings; with ``drugs`` only those drugs are encoded (the
    filter runs before the Python featuriser, which Spark cannot push a join
    through)."""
    comp = A.first_compound_row(px.compounds(spark, sf)).where(F.col("canonical_smiles").isNotNull())
    comp = comp.select(F.col("pert_id").alias("drug_id"), "canonical_smiles")
    if drugs is not None:
        comp = comp.join(drugs.select("drug_id").distinct(), "drug_id", "left_semi")
    fp = CH.featurize(comp, "drug_id", "canonical_smiles", 3, FP_BITS)
    dense = fp.select("drug_id", CH.dense_bits("bits", FP_BITS).alias("vec"))
    if encoding == "fingerprint":
        return dense
    desc = CH.descriptors(comp, "drug_id", "canonical_smiles").select("drug_id", F.col("desc").alias("vec"))
    if encoding == "descriptor":
        return desc
    return A.hybrid_encoding(dense, desc, "drug_id", "vec", "vec")


def ml_table(spark, sf, encoding="fingerprint", inputs=None):
    """The feature table, written once to the shared checkpoint folder: every
    fit, split and fold below reads it instead of re-running the joins."""
    obs, y, trans, metab = inputs or ml_inputs(spark, sf)
    if encoding in ("onehot", "label"):
        idx = CH.category_index(obs, "drug_id")
        t, pws, names = M.prepare_features(obs, y, trans, metab, drug_index=idx, encoding=encoding)
    else:
        t, pws, names = M.prepare_features(obs, y, trans, metab, drug_vectors(spark, sf, encoding, obs),
                                           encoding=encoding,
                                           drug_dim=FP_BITS if encoding == "fingerprint" else None)
    return cut_lineage(t), pws, names


def regression(spark, sf):
    return px.regression(spark, sf)


# ------------------------------------------------------------------ S-checked queries
def ml1_prepare_features(spark, sf):
    t, _, _ = ml_table(spark, sf)
    s = F.aggregate("features", F.lit(0.0), lambda a, x: a + x)
    return rounded(t.select("row_id", "cell_id", "drug_id", F.size("features").alias("n_features"),
                            s.alias("feature_sum"),
                            F.aggregate("y", F.lit(0.0), lambda a, x: a + x).alias("y_sum")))


def jn8_basal_features(spark, sf):
    """Basal blocks (transcriptomic, metabolomic pathway scores of the
    signature's cell line) attached to every harmonised signature."""
    obs, y, trans, metab = ml_inputs(spark, sf)
    idx = CH.category_index(obs, "drug_id")
    t, pws, _ = M.prepare_features(obs, y, trans, metab, drug_index=idx, encoding="label")
    basal = F.slice("features", 1, 2 * len(pws))
    return rounded(t.select("row_id", "cell_id", F.size(basal).alias("n_basal"),
                            F.aggregate(basal, F.lit(0.0), lambda a, x: a + x).alias("basal_sum")))


def _split_q(strategy):
    def q(spark, sf):
        return M.split(regression(spark, sf), strategy, TEST_SIZE, SEED).select(
            "row_id", "cell_id", "drug_id", "is_test")
    return q


def ml3_scale_train(spark, sf):
    d = M.scale_train(M.split(regression(spark, sf), "random", TEST_SIZE, SEED))
    return rounded(d.select("row_id", *[F.col("features")[i].alias(f"f{i}") for i in range(3)]))


def _one_feature(spark, sf):
    d = M.split(regression(spark, sf), "random", TEST_SIZE, SEED)
    return cut_lineage(d.withColumn("features", F.array(F.col("features")[0])))


def ml4_ridge_1feature(spark, sf):
    d = _one_feature(spark, sf)
    m = M.ridge_fit(d.where(~F.col("is_test")), alpha=1.0)
    rows = [(j, float(m.coef[0, j]), float(m.intercept[j])) for j in range(m.coef.shape[1])]
    return rounded(spark.createDataFrame(rows, "target int, coef double, intercept double"))


def _ridge_pred(spark, sf):
    d = _one_feature(spark, sf)
    m = M.ridge_fit(d.where(~F.col("is_test")), alpha=1.0)
    return M.predict(d.where(F.col("is_test")), m)


# squared errors of prices are ~1e9: reported to 3 decimals (15 significant
# digits is below the summation-order noise of doubles)
def ml8_metrics_per_target(spark, sf):
    return rounded(M.metrics(_ridge_pred(spark, sf))[1]).withColumn("mse", F.round("mse", 3))


def ml8_metrics_global(spark, sf):
    return rounded(M.metrics(_ridge_pred(spark, sf))[0]).withColumn("mse", F.round("mse", 3))


def ml13_kfold(spark, sf):
    return M.kfold(regression(spark, sf), N_FOLDS, SEED).select("row_id", "fold")


# ------------------------------------------------------------------ property-checked queries
def _ml_split(spark, sf, strategy="random", encoding="fingerprint"):
    t, pws, names = ml_table(spark, sf, encoding)
    return cut_lineage(M.scale_train(M.split(t, strategy, TEST_SIZE, SEED))), pws, names


def _model_metrics(name):
    def q(spark, sf):
        d, _, _ = _ml_split(spark, sf)
        pred, _ = M.fit_predict(name, d.where(~F.col("is_test")), d.where(F.col("is_test")))
        return rounded(M.metrics(pred)[1])
    return q


def ml9_train_evaluate(spark, sf):
    d, _, _ = _ml_split(spark, sf)
    summary, _, _ = M.train_and_evaluate(d)
    return rounded(M.summarize(spark, summary).drop("train_time_s"))


def ml10_summary(spark, sf):
    d, _, _ = _ml_split(spark, sf)
    summary, _, _ = M.train_and_evaluate(d, models=("Ridge", "ElasticNet", "KernelRidge"))
    return rounded(M.summarize(spark, summary).drop("train_time_s"))


def ml11_per_target(spark, sf):
    d, pws, _ = _ml_split(spark, sf)
    _, per, _ = M.train_and_evaluate(d, models=("Ridge", "ElasticNet", "KernelRidge"))
    return rounded(M.per_target_table(spark, per, pws))


def _ridge_of(alpha):
    """A caller's own model: ridge with another penalty."""
    return lambda train, test: (M.predict(test, M.ridge_fit(train, alpha)), None)


OWN_MODELS = {"Ridge1": _ridge_of(1.0), "Ridge1e6": _ridge_of(1e6)}


def own_models(spark, sf):
    """(summary, per-target) rows of two caller-supplied models."""
    return M.train_and_evaluate(_one_feature(spark, sf), models=OWN_MODELS)[:2]


def ml10_own_models(spark, sf):
    return rounded(M.summarize(spark, own_models(spark, sf)[0]).drop("train_time_s")).withColumn("mse", F.round("mse", 3))


def ml11_own_models(spark, sf):
    return rounded(M.per_target_table(spark, own_models(spark, sf)[1], ["price", "discounted"]))


def ml4_ridge_3feature(spark, sf):
    d = cut_lineage(M.split(regression(spark, sf), "random", TEST_SIZE, SEED).where(~F.col("is_test")))
    m = M.ridge_fit(d, alpha=1.0)
    rows = [(j, *map(float, m.coef[:, j])) for j in range(m.coef.shape[1])]
    return rounded(spark.createDataFrame(rows, "target int, w0 double, w1 double, w2 double"))


def ml12_importances(spark, sf):
    d, _, names = _ml_split(spark, sf)
    _, _, imps = M.train_and_evaluate(d, models=("RandomForest",))
    return rounded(M.top_importances(spark, imps["RandomForest"], names, 20))


def ml13_cv_scores(spark, sf):
    t, _, _ = ml_table(spark, sf)
    rows = []
    for label, grp in (("kfold", None), ("group_kfold_cell", "cell_id")):
        res = M.cross_validate(t, N_FOLDS, grp, "r2", "Ridge", SEED)
        rows += [(label, i, float(s)) for i, s in enumerate(res["per_fold"])]
        rows.append((label, -1, res["mean"]))
    return rounded(spark.createDataFrame(rows, "cv string, fold int, score double"))


def ml13_group_folds(spark, sf):
    return M.group_kfold(regression(spark, sf), "cell_id", N_FOLDS).select("row_id", "cell_id", "fold")


def ml14_full_pipeline(spark, sf):
    d, _, _ = _ml_split(spark, sf, "cell_line")
    summary, _, _ = M.train_and_evaluate(d, models=("Ridge", "ElasticNet", "KernelRidge", "RandomForest"))
    return rounded(M.summarize(spark, summary).drop("train_time_s"))


PARALLEL_SETUPS = 4          # grid setups fitted at once: each is many small Spark jobs


def grid(spark, sf, models=M.MODELS):
    """(encoding, split, model, r2, mse, mae) of every encoding and split."""
    from concurrent.futures import ThreadPoolExecutor
    inputs = ml_inputs(spark, sf)                    # shared by all encodings
    tables = {enc: ml_table(spark, sf, enc, inputs)[0] for enc in ENCODINGS}

    def setup(key):
        enc, strat = key
        d = cut_lineage(M.scale_train(M.split(tables[enc], strat, TEST_SIZE, SEED)))
        summary, _, _ = M.train_and_evaluate(d, models)
        return [(enc, strat) + tuple(r[:4]) for r in summary]

    with ThreadPoolExecutor(PARALLEL_SETUPS) as pool:
        found = list(pool.map(setup, [(enc, strat) for enc in ENCODINGS for strat in SPLITS]))
    return rounded(spark.createDataFrame(
        [r for rows in found for r in rows],
        "encoding string, split string, model string, r2 double, mse double, mae double"))


def ml15_grid(spark, sf):
    return grid(spark, sf)


ELASTIC = (0.1, 0.5)         # fixed values of the reference: penalty and share of its absolute part


def ml5_optimality(spark, sf):
    """How far the elastic net of every target is from its optimality
    conditions, over the largest slope: 0 for an exact solution."""
    d = cut_lineage(M.split(regression(spark, sf), "random", TEST_SIZE, SEED).where(~F.col("is_test")))
    alpha, share = ELASTIC
    m = M.elastic_net_fit(d, alpha, share)
    p = M.predict(d, m)
    mean = d.agg(*[F.avg(F.col("features")[i]).alias(f"m{i}") for i in range(3)]).first()
    centred = [F.col("features")[i] - F.lit(mean[i]) for i in range(3)]
    sums = p.agg(*[F.avg(centred[i] * (F.col("y")[j] - F.col("pred")[j])).alias(f"s{i}{j}") for i in range(3) for j in range(2)],
                 *[F.abs(F.avg(centred[i] * F.col("y")[j])).alias(f"b{i}{j}") for i in range(3) for j in range(2)]).first()
    rows = []
    for j in range(2):
        off = []
        for i in range(3):
            w = m.coef[i, j]
            slope = sums[f"s{i}{j}"] - alpha * (1 - share) * w
            off.append(abs(slope - alpha * share * math.copysign(1, w)) if w else max(abs(slope) - alpha * share, 0.0))
        rows.append((j, int((m.coef[:, j] != 0).sum()) > 0, float(max(off) / max(sums[f"b{i}{j}"] for i in range(3)))))
    return rounded(spark.createDataFrame(rows, "target int, fitted boolean, worst double"))


def ml6_fixed_point(spark, sf):
    """Kernel ridge predictions p on the training rows satisfy
    K (y - p) / alpha = p: the largest difference, with alpha = 1."""
    d, _, _ = _ml_split(spark, sf)
    train = cut_lineage(d.where(~F.col("is_test")))
    m = M.fit_kernel_ridge(train)
    p = cut_lineage(M.predict_kernel(train, m))
    left = M.distinct_rows(p.withColumn("c", F.zip_with("y", "pred", lambda a, b: a - b)), "features", "c", m.targets)
    dual, blocks = M.in_blocks(cut_lineage(left.select("x", F.col("v").alias("c"))), len(p.first()["features"]), m.targets)
    again = M.kernel_product(p, "features", dual, blocks, "c", m.gamma, m.targets, "again")
    off = F.array_max(F.transform(F.arrays_zip("pred", "again"), lambda v: F.abs(v["pred"] - v["again"])))
    moved = F.array_max(F.transform("pred", lambda v: F.abs(v)))
    return rounded(again.agg(F.max(off).alias("worst"), (F.max(moved) > 0).alias("fitted")))


def ml14_own_models(spark, sf):
    """The pipeline with whole cells held out and two models of the caller."""
    d = M.split(regression(spark, sf), "cell_line", TEST_SIZE, SEED)
    d = cut_lineage(d.withColumn("features", F.array(F.col("features")[0])))
    return rounded(M.summarize(spark, M.train_and_evaluate(d, models=OWN_MODELS)[0]).drop("train_time_s")) \
        .withColumn("mse", F.round("mse", 3))


QUERIES = {
    "ML1_prepare_features": ml1_prepare_features, "JN8_basal_features": jn8_basal_features,
    "ML2_split_random": _split_q("random"), "ML2_split_cell_line": _split_q("cell_line"),
    "ML2_split_drug": _split_q("drug"),
    "ML3_scale_train": ml3_scale_train, "ML4_ridge_1feature": ml4_ridge_1feature,
    "ML8_metrics_per_target": ml8_metrics_per_target, "ML8_metrics_global": ml8_metrics_global,
    "ML13_kfold": ml13_kfold,
    "ML4_ridge": _model_metrics("Ridge"), "ML5_elastic_net": _model_metrics("ElasticNet"),
    "ML6_kernel_ridge": _model_metrics("KernelRidge"), "ML7_random_forest": _model_metrics("RandomForest"),
    "ML9_train_evaluate": ml9_train_evaluate, "ML10_summary": ml10_summary,
    "ML11_per_target": ml11_per_target, "ML12_importances": ml12_importances,
    "ML13_cv_scores": ml13_cv_scores, "ML13_group_folds": ml13_group_folds,
    "ML4_ridge_3feature": ml4_ridge_3feature, "ML10_own_models": ml10_own_models,
    "ML11_own_models": ml11_own_models,
    "ML14_full_pipeline": ml14_full_pipeline, "ML15_grid": ml15_grid,
    "ML5_optimality": ml5_optimality, "ML6_fixed_point": ml6_fixed_point, "ML14_own_models": ml14_own_models,
}

# ---------------------------------------------------------------- oracles
_REG = """reg AS (
    SELECT CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) || '-' || CAST(l_partkey AS VARCHAR) || '-' || CAST(l_suppkey AS VARCHAR) || '-' || CAST(CAST(round(l_extendedprice * 100) AS BIGINT) AS VARCHAR) AS row_id,
           l_suppkey AS cell_id, l_partkey AS drug_id, l_quantity AS x0, l_discount AS x1, l_tax AS x2,
           l_extendedprice AS y0, l_quantity * l_discount AS y1 FROM lineitem)"""


def _flags(col: str) -> str:
    return f"""keys AS (SELECT DISTINCT {col} AS k FROM reg),
    ranked AS (SELECT k, row_number() OVER (ORDER BY md5('{SEED}:' || CAST(k AS VARCHAR)), k) - 1 AS r
               FROM keys),
    flags AS (SELECT k, r < CAST(ceil({TEST_SIZE} * (SELECT count(*) FROM keys)) AS BIGINT) AS is_test
              FROM ranked)"""


def _split_sql(col: str) -> str:
    return with_views("WITH " + _REG + ",\n" + _flags(col) + f"""
        SELECT row_id, cell_id, drug_id, is_test FROM reg JOIN flags ON flags.k = reg.{col}""")


_TRAIN = "WITH " + _REG + ",\n" + _flags("row_id") + """,
    d AS (SELECT reg.*, is_test FROM reg JOIN flags ON flags.k = reg.row_id)"""
_RIDGE1 = _TRAIN + """,
    tr AS (SELECT * FROM d WHERE NOT is_test),
    mom AS (SELECT avg(x0) AS mx, avg(y0) AS my0, avg(y1) AS my1 FROM tr),
    co AS (SELECT sum((x0 - mx) * (y0 - my0)) / (sum((x0 - mx) * (x0 - mx)) + 1.0) AS w0,
                  sum((x0 - mx) * (y1 - my1)) / (sum((x0 - mx) * (x0 - mx)) + 1.0) AS w1,
                  any_value(mx) AS mx, any_value(my0) AS my0, any_value(my1) AS my1 FROM tr, mom),
    coef AS (SELECT w0, my0 - mx * w0 AS b0, w1, my1 - mx * w1 AS b1 FROM co),
    pred AS (SELECT y0, y1, x0 * w0 + b0 AS p0, x0 * w1 + b1 AS p1 FROM d, coef WHERE is_test),
    long AS (SELECT 0 AS target, y0 AS y, p0 AS p FROM pred UNION ALL SELECT 1, y1, p1 FROM pred),
    per AS (SELECT target, avg((y - p) * (y - p)) AS mse, avg(abs(y - p)) AS mae,
                   1 - sum((y - p) * (y - p)) / sum((y - (SELECT avg(y) FROM long l2 WHERE l2.target = long.target))
                                                    * (y - (SELECT avg(y) FROM long l2 WHERE l2.target = long.target)))
                       AS r2
            FROM long GROUP BY target)"""

def _ridge1_per(alpha: float) -> str:
    return _RIDGE1.replace("+ 1.0)", f"+ {alpha!r})")


def _own_sql(tail: str) -> str:
    """Both models' per-target metrics, then ``tail``."""
    parts = [f"SELECT '{name}' AS model, target, mse, mae, r2 FROM ({_ridge1_per(alpha)} SELECT * FROM per)"
             for name, alpha in (("Ridge1", 1.0), ("Ridge1e6", 1e6))]
    return with_views("WITH own AS (" + " UNION ALL ".join(parts) + ")" + tail)


# closed form for three centred features: Cramer's rule on (G + I) w = r
def _ridge3_sql() -> str:
    g = {(i, j): f"sum((x{i} - m{i}) * (x{j} - m{j}))" + (" + 1.0" if i == j else "") for i in range(3) for j in range(i, 3)}
    cols = [f"{v} AS g{i}{j}" for (i, j), v in g.items()]
    cols += [f"sum((x{i} - m{i}) * (y{k} - n{k})) AS r{k}{i}" for k in range(2) for i in range(3)]
    at = lambda i, j: f"g{min(i, j)}{max(i, j)}"

    def det(m):
        return (f"({m[0][0]} * ({m[1][1]} * {m[2][2]} - {m[1][2]} * {m[2][1]}) - {m[0][1]} * ({m[1][0]} * {m[2][2]} - "
                f"{m[1][2]} * {m[2][0]}) + {m[0][2]} * ({m[1][0]} * {m[2][1]} - {m[1][1]} * {m[2][0]}))")

    base = [[at(i, j) for j in range(3)] for i in range(3)]
    out = []
    for k in range(2):
        w = []
        for c in range(3):
            m = [[f"r{k}{i}" if j == c else base[i][j] for j in range(3)] for i in range(3)]
            w.append(f"round({det(m)} / {det(base)}, 6) AS w{c}")
        out.append(f"SELECT {k} AS target, {', '.join(w)} FROM s")
    return with_views(_TRAIN + f""",
    tr AS (SELECT * FROM d WHERE NOT is_test),
    mom AS (SELECT avg(x0) AS m0, avg(x1) AS m1, avg(x2) AS m2, avg(y0) AS n0, avg(y1) AS n1 FROM tr),
    s AS (SELECT {', '.join(cols)} FROM tr, mom)
    {' UNION ALL '.join(out)}""")


ORACLES = {
    "ML4_ridge_3feature": _ridge3_sql(),
    "ML10_own_models": _own_sql("""
        SELECT model, round(avg(r2), 6) AS r2, round(avg(mse), 3) AS mse, round(avg(mae), 6) AS mae FROM own GROUP BY model"""),
    "ML11_own_models": _own_sql("""
        SELECT target, CASE target WHEN 0 THEN 'price' ELSE 'discounted' END AS pathway,
               round(max(CASE WHEN model = 'Ridge1' THEN r2 END), 6) AS "Ridge1",
               round(max(CASE WHEN model = 'Ridge1e6' THEN r2 END), 6) AS "Ridge1e6" FROM own GROUP BY target"""),
    "ML5_optimality": "SELECT target, true AS fitted, CAST(0 AS DOUBLE) AS worst FROM (VALUES (0), (1)) AS t(target)",
    "ML6_fixed_point": "SELECT CAST(0 AS DOUBLE) AS worst, true AS fitted",
    "ML14_own_models": _own_sql("""
        SELECT model, round(avg(r2), 6) AS r2, round(avg(mse), 3) AS mse, round(avg(mae), 6) AS mae FROM own GROUP BY model""")
        .replace(_flags("row_id"), _flags("cell_id")).replace("flags.k = reg.row_id", "flags.k = reg.cell_id"),
    "ML13_group_folds": with_views("WITH RECURSIVE " + _REG + f""",
        g AS (SELECT cell_id, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, cell_id DESC) AS i FROM reg GROUP BY cell_id),
        run AS (SELECT CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS fold, list_transform(range({N_FOLDS}), lambda x: CAST(0 AS BIGINT)) AS load
                UNION ALL
                SELECT r.i + 1, list_position(r.load, list_min(r.load)) - 1,
                       list_transform(r.load, lambda v, k: CASE WHEN k = list_position(r.load, list_min(r.load)) THEN v + g.n ELSE v END)
                FROM run r JOIN g ON g.i = r.i + 1)
        SELECT row_id, reg.cell_id, CAST(fold AS INTEGER) AS fold FROM reg JOIN g USING (cell_id) JOIN run ON run.i = g.i"""),
    "ML1_prepare_features": with_views("WITH " + _CMAP + f""",
        y AS (SELECT l.sig_id AS row_id, p.pathway_id, avg(l.v) AS v FROM v_signatures_long l
              JOIN v_pathways p USING (gene) GROUP BY ALL),
        ys AS (SELECT row_id, sum(v) AS y_sum FROM y GROUP BY row_id),
        tb AS (SELECT cell_id, CAST(regexp_extract(gene, '^ENSG(\\d+)', 1) AS INTEGER) % {N_PW} AS pw,
                      avg(value) AS v FROM trans_h GROUP BY ALL),
        mb AS (SELECT cell_id, CAST(substr(metabolite, 2) AS INTEGER) % {N_PW} AS pw, avg(value) AS v
               FROM metab_h GROUP BY ALL),
        tbs AS (SELECT cell_id, sum(v) AS s FROM tb GROUP BY cell_id),
        mbs AS (SELECT cell_id, sum(v) AS s FROM mb GROUP BY cell_id),
        fc AS (SELECT pert_id, canonical_smiles FROM v_compounds
               QUALIFY row_number() OVER (PARTITION BY pert_id ORDER BY _ord) = 1),
        g AS (SELECT pert_id, canonical_smiles AS t, unnest(range(1, length(canonical_smiles) - 3 + 2)) AS i
              FROM fc WHERE canonical_smiles IS NOT NULL AND length(canonical_smiles) >= 3),
        bits AS (SELECT pert_id, count(DISTINCT CAST(('0x' || substr(md5(substr(t, i, 3)), 1, 8)) AS BIGINT)
                                           % {FP_BITS}) AS n_on FROM g GROUP BY pert_id)
        SELECT l.sig_id AS row_id, l.cell_id, l.drug_id, {2 * N_PW + FP_BITS} AS n_features,
               round(tbs.s + mbs.s + bits.n_on, 6) AS feature_sum, round(ys.y_sum, 6) AS y_sum
        FROM l1000_h l JOIN tbs USING (cell_id) JOIN mbs USING (cell_id) JOIN ys ON ys.row_id = l.sig_id
        JOIN bits ON bits.pert_id = l.drug_id WHERE bits.n_on > 0"""),
    "JN8_basal_features": with_views("WITH " + _CMAP + f""",
        tb AS (SELECT cell_id, CAST(regexp_extract(gene, '^ENSG(\\d+)', 1) AS INTEGER) % {N_PW} AS pw,
                      avg(value) AS v FROM trans_h GROUP BY ALL),
        mb AS (SELECT cell_id, CAST(substr(metabolite, 2) AS INTEGER) % {N_PW} AS pw, avg(value) AS v
               FROM metab_h GROUP BY ALL),
        tbs AS (SELECT cell_id, sum(v) AS s FROM tb GROUP BY cell_id),
        mbs AS (SELECT cell_id, sum(v) AS s FROM mb GROUP BY cell_id),
        ys AS (SELECT DISTINCT sig_id FROM v_signatures_long)
        SELECT l.sig_id AS row_id, l.cell_id, {2 * N_PW} AS n_basal, round(tbs.s + mbs.s, 6) AS basal_sum
        FROM l1000_h l JOIN tbs USING (cell_id) JOIN mbs USING (cell_id) JOIN ys USING (sig_id)"""),
    "ML2_split_random": _split_sql("row_id"),
    "ML2_split_cell_line": _split_sql("cell_id"),
    "ML2_split_drug": _split_sql("drug_id"),
    "ML3_scale_train": with_views(_TRAIN + """,
        st AS (SELECT avg(x0) AS m0, stddev_pop(x0) AS s0, avg(x1) AS m1, stddev_pop(x1) AS s1,
                      avg(x2) AS m2, stddev_pop(x2) AS s2 FROM d WHERE NOT is_test)
        SELECT row_id, round((x0 - m0) / CASE WHEN s0 < 2.220446049250313e-15 THEN 1.0 ELSE s0 END, 6) AS f0,
               round((x1 - m1) / CASE WHEN s1 < 2.220446049250313e-15 THEN 1.0 ELSE s1 END, 6) AS f1,
               round((x2 - m2) / CASE WHEN s2 < 2.220446049250313e-15 THEN 1.0 ELSE s2 END, 6) AS f2
        FROM d, st"""),
    "ML4_ridge_1feature": with_views(_RIDGE1 + """
        SELECT 0 AS target, round(w0, 6) AS coef, round(b0, 6) AS intercept FROM coef
        UNION ALL SELECT 1, round(w1, 6), round(b1, 6) FROM coef"""),
    "ML8_metrics_per_target": with_views(_RIDGE1 + """
        SELECT target, round(mse, 3) AS mse, round(mae, 6) AS mae, round(r2, 6) AS r2 FROM per"""),
    "ML8_metrics_global": with_views(_RIDGE1 + """
        SELECT round(avg(mse), 3) AS mse, round(avg(mae), 6) AS mae, round(avg(r2), 6) AS r2 FROM per"""),
    "ML13_kfold": with_views("WITH " + _REG + f""",
        n AS (SELECT count(*) AS n FROM reg),
        r AS (SELECT row_id, row_number() OVER (ORDER BY md5('{SEED}:' || row_id), row_id) - 1 AS r FROM reg),
        qm AS (SELECT n // {N_FOLDS} AS q, n % {N_FOLDS} AS m FROM n)
        SELECT row_id, CAST(CASE WHEN r < (q + 1) * m THEN r // (q + 1)
                                 ELSE m + (r - (q + 1) * m) // q END AS INTEGER) AS fold
        FROM r, qm"""),
}
