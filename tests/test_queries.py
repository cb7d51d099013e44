"""Selected registered queries against their DuckDB oracles at sf0.001,
partition invariance, the histogram edges rule and the entry point."""

import math

import duckdb
import pytest

from conftest import SF001
from sigflow.plans import registry
from sigflow.sources.tables import TABLES

CORE = ["ANA7_class_purity", "ANA8_cell_purity", "ANA3_intra_pairs", "ANA4_null_sample",
        "ANA9_enrichment", "ANA9_enrichment_vectors", "CHM3_tanimoto", "CHM3_tanimoto_threshold",
        "CHM4_single_linkage", "CHM6_silhouette", "JN1_annotate_drug", "JN5_stats", "FLT2_drop_null_features",
        "AGG5_size_histogram", "AGG8_coverage_stats", "AGG9_intersections", "WIN3_avg_rank_vector",
        "ML2_split_cell_line", "ML13_kfold", "SRC12_records_both", "SRC8_gct"]


def _norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, int) and not isinstance(v, bool):
        return float(v)
    return v


def _canon(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return [cols[i] for i in order], sorted((tuple(_norm(r[i]) for i in order) for r in rows), key=repr)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF001}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", CORE)
def test_oracle(spark, duck, name):
    df = registry.queries()[name](spark, SF001)
    cur = duck.execute(registry.oracle_sql()[name])
    a = _canon(df.columns, [tuple(r) for r in df.collect()])
    b = _canon([d[0] for d in cur.description], cur.fetchall())
    assert a == b


def test_partition_invariance(spark):
    from sigflow.operators import neighbors as nb
    from sigflow.sources import proxies as px
    s = px.signatures(spark, SF001)
    one = nb.class_purity_stats(nb.neighbor_purity(s.repartition(1), "sig_id", "features", "moa"), "moa")
    many = nb.class_purity_stats(nb.neighbor_purity(s.repartition(8), "sig_id", "features", "moa"), "moa")
    assert one.exceptAll(many).count() == 0 and many.exceptAll(one).count() == 0


def test_histogram_edges(spark):
    from sigflow.operators.aggregates import histogram
    df = spark.createDataFrame([(v,) for v in [1, 2, 2, 5, 10, 11]], "size int")
    edges = [0.5, 1.5, 2.5, 5.5, 10.5, 11 + 1]
    got = {r.bin: (r["count"], r.pct) for r in histogram(df, "size", edges).collect()}
    assert [got[i][0] for i in range(5)] == [1, 2, 1, 1, 1]
    assert abs(got[1][1] - 100 * 2 / 6) < 1e-12


def test_entry(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    assert df.count() > 0 and "lift" in df.columns
    assert set(E.oracle_sql()) <= set(E.queries())
