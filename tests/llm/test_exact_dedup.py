import hashlib
import re

from pyspark.sql import functions as F

from sigflow.llm import exact_dedup as X

ROWS = [(0, "a b", "k"), (1, "ab", "k"), (2, "a  b\t", None), (3, None, "k"), (4, "", "k"), (5, " \r\n", "k"), (6, "Ab", "k"),
        (7, "a b", "k"), (8, "é" * 30000, "k"), (9, "é " * 30000, "k"), (None, "z", "k"), (10, "z", "k"), (10, "z", "k"),
        (11, "a b ", "k"), (12, "w", "k"), (None, "w", "k")]


def brute(rows):
    norm = [re.sub(r"[\x20\x09-\x0D]", "", t or "") for _, t, _ in rows]
    out = []
    for (i, t, _), n in zip(rows, norm):
        group = [r for r, m in zip(rows, norm) if m == n]
        best = min(group, key=lambda r: (-len(r[1] or ""), r[0] is None, r[0]))
        out.append((i, best[0], len(group), hashlib.sha256(n.encode()).hexdigest()))
    return sorted(map(repr, out))


def check(df, **options):
    got = X.exact_dedup(df, **options).collect()
    assert sorted(repr((r.doc_id, r.keep_id, r.group_size, r.text_sha256)) for r in got) == brute(ROWS)
    groups = {}
    for r in got:
        groups.setdefault(r.text_sha256, []).append(r.kept)
    assert all(sum(g) == 1 for g in groups.values())
    return got


def test_against_brute_force(spark):
    # clashing names of other columns are not read
    df = spark.createDataFrame(ROWS, "doc_id long, text string, `key` string").withColumn("chain", F.lit("x"))
    check(df)


def test_chains_compare_bytes(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, other string")
    got = check(df, key=lambda c: F.lit(7).cast("long"), digest=lambda c: F.length(c).cast("string"))
    assert len({r.chain for r in got}) > 1


def test_overfull_buckets_split(spark):
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.col("id").cast("string").alias("text"))
    got = X.exact_dedup(df, capacity=100, max_depth=8).groupBy("bucket", "bucket_depth").count().collect()
    assert all(r["count"] <= 100 for r in got) and sum(r["count"] for r in got) == 3000
    assert sum(2.0 ** -r.bucket_depth for r in got) == 1        # the buckets tile the key space


def test_directory_doubles_on_and_hot_texts(spark, monkeypatch):
    """Ranges of few bits overflow, so the directory grows; a text of a third
    of the rows has few index entries and is looked up apart."""
    from sigflow.operators import components
    monkeypatch.setattr(components, "HEAVY_ROWS", 100)
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "same").otherwise(
        F.col("id").cast("string")).alias("text"))
    got = X.exact_dedup(df, capacity=20, max_depth=3)
    rows = {r.doc_id: r for r in got.collect()}
    assert len(rows) == 3000 and rows[3].group_size == 1000 and rows[3].keep_id == 0 and rows[4].group_size == 1
    texts = got.select("bucket", "bucket_depth", "text_sha256").distinct().groupBy("bucket", "bucket_depth").count().collect()
    assert all(r["count"] <= 20 for r in texts) and max(r.bucket_depth for r in texts) > 3


def test_empty_and_documents(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert X.exact_dedup(df).collect() == []
    rows = spark.createDataFrame(ROWS, "doc_id long, text string, kept string")
    stays = X.distinct_documents(rows)
    assert stays.columns == rows.columns and stays.count() == len({r[3] for r in map(eval, brute(ROWS))})
