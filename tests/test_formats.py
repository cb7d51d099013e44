"""Inline cases for the text formats (FIXTURES part C)."""

import pytest

from pyspark.sql import functions as F

from sigflow.sources import formats as FM


def _write(tmp_path, name, text):
    p = tmp_path / name
    p.write_text(text)
    return str(p)


def test_gmt_ragged_blanks_and_normalisation(spark, tmp_path):
    text = ("P1\tGlycolysis\tC00031 \t C00022\t\t\n"
            "P2\tTCA\tC00036\n"
            "P3\tEmpty\t\t\n")
    path = _write(tmp_path, "m.gmt", text)
    mem, names = FM.read_gmt(spark, path, "metabolomics")
    got = sorted((r.pathway_id, r.member) for r in mem.collect())
    assert got == [("P1", "C00022"), ("P1", "C00031"), ("P2", "C00036")]
    assert {r.pathway_id: r.name for r in names.collect()}["P3"] == "Empty"

    gtext = "G1\tgenes\t10.0\t7157\t\n"
    gpath = _write(tmp_path, "g.gmt", gtext)
    idmap = spark.createDataFrame([("10", "NAT2"), ("7157", None)], "query string, symbol string")
    mem, _ = FM.read_gmt(spark, gpath, "transcriptomics", idmap)
    assert [(r.pathway_id, r.member) for r in mem.collect()] == [("G1", "NAT2")]


def test_gct_round_shape(spark, tmp_path):
    text = ("#1.2\n3\t4\n"
            "Name\tDescription\tS1\tS2\tS3\tS4\n"
            "g1\tna\t1\t2\t3\t4\n"
            "g2\tna\t5\tnan\t7\t8\n"
            "g3\tna\t9\t10\t11\t12\n")
    path = _write(tmp_path, "m.gct", text)
    long = FM.read_gct(spark, path)
    rows = {(r.gene, r.sample): r.value for r in long.collect()}
    assert len(rows) == 12
    assert rows[("g2", "S2")] is None and rows[("g3", "S4")] == 12.0


def test_gct_rows_that_look_like_the_preamble(spark, tmp_path):
    text = ("#1.2\n3\t2\nName\tDescription\tS1\tS2\n"
            "1000\t5\t3\t7\nName\tna\t1\t2\n7\t8\t9\t10\n")
    path = _write(tmp_path, "m.gct", text)
    want = {("1000", "S1", 3.0), ("1000", "S2", 7.0), ("Name", "S1", 1.0), ("Name", "S2", 2.0), ("7", "S1", 9.0), ("7", "S2", 10.0)}
    assert {tuple(r) for r in FM.read_gct(spark, path).collect()} == want
    # a folder of part files
    long = spark.createDataFrame(sorted(want), "gene string, sample string, value double").repartition(5)
    FM.write_gct(long, "gene", "sample", "value", str(tmp_path / "parts"))
    assert {tuple(r) for r in FM.read_gct(spark, str(tmp_path / "parts")).collect()} == want


def test_gct_files_of_one_folder_keep_their_own_columns(spark, tmp_path):
    folder = tmp_path / "two"
    folder.mkdir()
    _write(folder, "a.gct", "#1.2\n2\t2\nName\tDescription\tS1\tS2\ng1\tna\t1\t2\ng2\tna\t3\tnan\n")
    _write(folder, "b.gct", "#1.3\n1\t2\nName\tDescription\tT1\tT2\ng1\tna\t5\t6\n")
    want = {("g1", "S1", 1.0), ("g1", "S2", 2.0), ("g2", "S1", 3.0), ("g2", "S2", None), ("g1", "T1", 5.0), ("g1", "T2", 6.0)}
    got = [tuple(r) for r in FM.read_gct(spark, str(folder)).collect()]
    assert len(got) == 6 and set(got) == want
    _write(folder, "c.gct", "g3\tna\t7\t8\n")                # whose columns?
    with pytest.raises(Exception, match="no column names"):
        FM.read_gct(spark, str(folder)).collect()


def test_flat_records_sections(spark):
    recs = [
        ("A", "ENTRY A\nGENE        1  a\n            2  b\nCOMPOUND    C1  x\n            C2  y\n"
              "            C1  z\nREFERENCE   r\n"),
        ("B", "ENTRY B\nGENE        3  a\nREFERENCE   r\n"),                    # no COMPOUND
        ("C", "ENTRY C\nCOMPOUND    C9  x\nREL_PATHWAY  p\n"),                 # REL_PATHWAY stops
        ("D", "ENTRY D\nCOMPOUND    C5  x\n"),                                 # no boundary
    ]
    df = spark.createDataFrame(recs, "record_id string, text string")
    comp = {(r.record_id, r.member) for r in FM.parse_records(df, "metabolomics").collect()}
    assert comp == {("A", "C1"), ("A", "C2"), ("C", "C9")}
    genes = {(r.record_id, r.member) for r in FM.parse_records(df, "transcriptomics").collect()}
    assert genes == {("A", "1"), ("A", "2")}
    both = FM.parse_records(df, "multiomics").collect()
    assert {r.record_id for r in both} == {"A"} and len(both) == 4


def test_keyed_file_names(spark, tmp_path):
    for name in ("correlations_moa_pearson_A375_raw_pert.csv",
                 "correlations_moa_spearman_HT_29_pathway_pert.csv",
                 "summary_notes.csv"):
        (tmp_path / name).write_text("moa,r\nm1,0.5\n")
    pat = r"correlations_([A-Za-z]+)_(pearson|spearman)_(.+)_(raw_pert|pathway_pert)\.csv$"
    df = FM.read_keyed_csv(spark, str(tmp_path / "*.csv"), pat, ["outname", "cor_type", "cell", "pert"])
    got = sorted((r.cor_type, r.cell, r.pert) for r in df.collect())
    assert got == [("pearson", "A375", "raw_pert"), ("spearman", "HT_29", "pathway_pert")]
    assert df.where(F.col("cell") == "").count() == 0


def test_a_folder_holds_one_file_and_is_read_back(spark, tmp_path):
    """Rows of a key in many tasks used to give one file each."""
    from sigflow.sources import formats as FM
    df = spark.range(600).repartition(6).selectExpr("concat('correlations_moa_pearson_', id % 5, '_raw_pert') AS _file", "id AS moa", "id / 7 AS r")
    path = str(tmp_path / "keyed")
    FM.write_table(df, path, "csv", ["_file"])
    folders = [d for d in (tmp_path / "keyed").iterdir() if d.is_dir()]
    assert len(folders) == 5 and all(len(list(d.glob("*.csv"))) == 1 for d in folders)
    from pyspark.sql import types as T
    schema = T.StructType([T.StructField("moa", T.LongType()), T.StructField("r", T.DoubleType())])
    from sigflow.plans.q_io import SETUP_RE
    names = ["outname", "cor_type", "cell", "pert_type"]
    back = FM.read_keyed_csv(spark, path, SETUP_RE, names, schema)
    by_glob = FM.read_keyed_csv(spark, f"{path}/*/*.csv", SETUP_RE, names, schema)
    assert back.count() == 600 and sorted(back.collect()) == sorted(by_glob.collect())


def test_tasks_write_the_files_that_spark_writes(spark, tmp_path):
    """Hadoop's local file system starts a process for every file (and leaves a
    checksum file beside it); keys and contents are those of Spark's own writes."""
    rows = [("a/b=c%", 1, "x,\"y\"", 1e10), ("", 1, "", 0.1), (None, 1, None, None), ("a", None, " z ", -0.0),
            ("a", None, "two\nlines", float("nan")), ("ä b", 2, "ü", 1.5), ("a", 2, "'", 2.5)]
    df = spark.createDataFrame(rows, "k string, n int, t string, v double").repartition(3)
    for fmt in ("csv", "parquet"):
        ours, theirs = tmp_path / f"ours-{fmt}", tmp_path / f"theirs-{fmt}"
        FM.write_table(df, str(ours), fmt, ["k", "n"])
        df.repartition(4, "k", "n").write.partitionBy("k", "n").option("header", True).format(fmt).save(str(theirs))
        folders = lambda top: {str(p.parent.relative_to(top)) for p in top.rglob(f"*.{fmt}")}
        assert folders(ours) == folders(theirs) and len(folders(ours)) == 5
        files = [p for p in ours.rglob("*") if p.is_file()]
        assert len(files) == 5 and all(p.suffix == f".{fmt}" for p in files)        # one a key, nothing beside it
        if fmt == "csv":
            lines = lambda top, f: sorted(x for p in (top / f).glob("*.csv") for x in p.read_text().split("\n"))
            for f in folders(ours) - {"k=__HIVE_DEFAULT_PARTITION__/n=1"}:
                assert lines(ours, f) == lines(theirs, f)
        read = lambda top: sorted(map(str, spark.read.option("header", True).format(fmt).load(str(top)).collect()))
        assert read(ours) == read(theirs)
    FM.write_table(df.where("n = 2"), str(ours), "parquet", ["k", "n"])              # overwritten, not added to
    assert spark.read.parquet(str(ours)).count() == 2
