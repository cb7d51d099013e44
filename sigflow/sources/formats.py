"""Readers and writers for the reference's file formats (SRC1-SRC12,
SNK1-SNK7), all as Spark reads/writes that split across tasks.

* GMT (ragged tab-separated pathway lists) and GCT (expression matrix text)
  are read with ``spark.read.text`` and parsed with column functions.
* Flat pathway records (entries separated by ``///`` lines) are read with
  that separator as the record delimiter, so each record is one row however
  the files are split; sections are located by line position.
* Result files carry their key in the file name: ``_metadata.file_path``
  plus an anchored ``regexp_extract`` replaces the reference's glob loop.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

RECORD_SEP = "///\n"


# ------------------------------------------------------------------ GMT
def read_gmt(spark: SparkSession, path: str, omics: str = "metabolomics",
             id_map: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """SRC9: GMT -> (membership(pathway_id, member), names(pathway_id, name)).

    Fields are tab-separated: id, name, members; empty fields are dropped.
    'metabolomics': members stripped. 'transcriptomics': members are Entrez
    ids normalised as integers ("10.0" -> "10"), mapped to symbols through
    ``id_map(query, symbol)`` when given (unmapped dropped, pathways left
    without a member disappear). Names: the last line of an id wins, files in
    name order."""
    lines = spark.read.text(path).where(F.length("value") > 0)
    arr = F.split(F.col("value"), "\t")
    # line order: file, place of the split in it, line in the split
    rows = lines.select(arr.alias("_a"), F.struct(
        F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"),
        F.monotonically_increasing_id().alias("i")).alias("_ord"))
    names = (rows.select(F.col("_a")[0].alias("pathway_id"),
                         F.try_element_at("_a", F.lit(2)).alias("name"), "_ord")
             .groupBy("pathway_id").agg(F.max_by("name", "_ord").alias("name")))
    mem = rows.select(F.col("_a")[0].alias("pathway_id"),
                      F.explode(F.slice("_a", 3, F.greatest(F.size("_a") - 2, F.lit(1)))).alias("member"))
    mem = mem.where(F.col("member").isNotNull() & (F.length("member") > 0))
    if omics == "metabolomics":
        mem = mem.withColumn("member", F.trim("member"))
    elif omics == "transcriptomics":
        mem = mem.withColumn("member", F.col("member").cast("double").cast("bigint").cast("string"))
        mem = mem.where(F.col("member").isNotNull())
        if id_map is not None:
            mem = (mem.join(id_map.where(F.col("symbol").isNotNull())
                            .withColumnRenamed("query", "member"), "member")
                   .select("pathway_id", F.col("symbol").alias("member")))
    else:
        raise ValueError(f"unknown omics {omics!r}")
    return mem, names


def write_gmt(membership: DataFrame, names: DataFrame, path: str) -> None:
    """SNK6: one line per pathway: id TAB name TAB members (no header)."""
    lines = (membership.groupBy("pathway_id")
             .agg(F.array_sort(F.collect_list(F.col("member").cast("string"))).alias("_m"))
             .join(names, "pathway_id", "left")
             .select(F.concat_ws("\t", F.col("pathway_id").cast("string"),
                                 F.coalesce(F.col("name"), F.lit("")), F.concat_ws("\t", "_m")).alias("value")))
    lines.write.mode("overwrite").text(path)


# ------------------------------------------------------------------ GCT
def write_gct(long_df: DataFrame, row: str, col: str, value: str, path: str) -> None:
    """Write a (row, col, value) matrix as GCT 1.2 text lines: '#1.2',
    dimensions, header 'Name<TAB>Description<TAB>samples...', one line per
    row (a folder of part files). The column list travels in the header line
    (bounded by the column count)."""
    cols = sorted(r[0] for r in long_df.select(col).distinct().collect())
    n_rows = long_df.select(row).distinct().count()
    spark = long_df.sparkSession
    head = spark.createDataFrame(
        [("\n".join(["#1.2", f"{n_rows}\t{len(cols)}", "\t".join(["Name", "Description"] + cols)]),)], "value string")
    order = spark.createDataFrame([(c, i) for i, c in enumerate(cols)], "_c string, _p int")
    body = (long_df.select(F.col(row).cast("string").alias("_r"), F.col(col).cast("string").alias("_c"),
                           F.col(value).cast("string").alias("_v"))
            .join(order, "_c").groupBy("_r")
            .agg(F.map_from_entries(F.collect_list(F.struct("_p", "_v"))).alias("_m"))
            .select(F.concat_ws("\t", F.col("_r"), F.lit("na"),
                                F.concat_ws("\t", F.transform(F.sequence(F.lit(0), F.lit(len(cols) - 1)),
                                                              lambda i: F.coalesce(F.element_at("_m", i),
                                                                                   F.lit("nan"))))).alias("value")))
    # the first three lines are one row, so they begin one part file; the others
    # hold body lines only, and no single-task write is needed
    head.unionByName(body).write.mode("overwrite").text(path)


def read_gct(spark: SparkSession, path: str, row_name: str = "gene", col_name: str = "sample"
             ) -> DataFrame:
    """SRC8: GCT text -> long (row, col, value). Lines are told by position: a
    file that begins with a version line has the dimensions in its second and
    the column names in its third line, and these names hold for that file. A
    file without a version line holds rows only and takes the names of its
    folder's one file that has them; where there is none or more than one, the
    job fails. Column names are joined by position (the transpose of the
    reference is free in long form). 'nan' / empty cells become NULL."""
    lines = spark.read.text(path).select(
        "value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start"),
        F.monotonically_increasing_id().alias("_id"))
    # a row a file: its first line, whose number the preamble is counted from
    first = lines.where(F.col("_start") == 0).groupBy("_file").agg(F.min(F.struct("_id", "value")).alias("_first"))
    first = first.select("_file", F.col("_first._id").alias("_least"), F.col("_first.value").alias("_top"),
                         F.col("_first.value").rlike(r"^#1\.\d+\s*$").alias("_gct"),
                         F.regexp_replace("_file", "[^/]*$", "").alias("_folder"))
    told = lines.join(first.select("_file", "_folder", "_gct", "_least", "_top"), "_file")
    line = F.col("_id") - F.col("_least")
    moved = (F.col("_start") == 0) & (line == 0) & (F.col("value") != F.col("_top"))
    told = told.withColumn("_line", F.when(moved, F.raise_error(F.lit("the files changed while they were read")).cast("long"))
                           .when(F.col("_gct") & (F.col("_start") == 0), line))
    arr = F.split("value", "\t")
    values = lambda a: F.slice(a, F.lit(3), F.greatest(F.size(a) - 2, F.lit(0)))
    names = told.where(F.col("_line") == 2).select("_file", "_folder", F.posexplode(values(arr)).alias("_p", col_name))
    folders = first.groupBy("_folder").agg(F.count_if("_gct").alias("_heads"))
    header = names.select(F.col("_file").alias("_names"), "_p", col_name).unionByName(
        names.select(F.col("_folder").alias("_names"), "_p", col_name))
    of = F.when(F.col("_gct"), F.col("_file")).when(F.col("_heads") == 1, F.col("_folder")) \
        .otherwise(F.raise_error(F.concat(F.lit("no column names for "), "_file")))
    body = (told.where(F.col("_line").isNull() | (F.col("_line") > 2)).join(folders, "_folder")
            .select(of.alias("_names"), arr.alias("_a")).where(F.size("_a") >= 3)
            .select("_names", F.col("_a")[0].alias(row_name), F.posexplode(values(F.col("_a"))).alias("_p", "_v")))
    val = F.when(F.lower(F.col("_v")).isin("nan", ""), F.lit(None)).otherwise(F.col("_v").cast("double"))
    return body.join(header, ["_names", "_p"]).select(row_name, col_name, val.alias("value"))


# ------------------------------------------------------------------ flat records
def write_records(records: DataFrame, path: str) -> None:
    """Write (text) records separated by '///' lines."""
    records.select("text").write.mode("overwrite").option("lineSep", RECORD_SEP).text(path)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """One row per flat record (the '///' line is the record delimiter)."""
    return (spark.read.option("lineSep", RECORD_SEP).text(path)
            .where(F.length(F.trim("value")) > 0)
            .select(F.regexp_extract("value", r"(?m)^ENTRY\s+(\S+)", 1).alias("record_id"),
                    F.col("value").alias("text")))


def parse_records(records: DataFrame, mode: str = "metabolomics", key: str = "record_id") -> DataFrame:
    """SRC12: members of the COMPOUND and/or GENE sections of each record.

    A section runs from its line to the line before the next boundary
    (GENE -> COMPOUND -> first REFERENCE / REL_PATHWAY line). The first line
    contributes its second token, every other line its first token; members
    are de-duplicated. A record missing a needed boundary, with an empty
    section, or with a token-less line inside a section yields nothing.
    Modes: 'metabolomics' (compounds), 'transcriptomics' (genes; COMPOUND
    and REFERENCE must exist), 'multiomics' (both). Returns (key, kind,
    member)."""
    lines = records.select(key, F.posexplode(F.split("text", "\n")).alias("_pos", "_line"))
    bounds = lines.groupBy(key).agg(
        F.min(F.when(F.col("_line").startswith("GENE"), F.col("_pos"))).alias("_g"),
        F.min(F.when(F.col("_line").startswith("COMPOUND"), F.col("_pos"))).alias("_c"),
        F.min(F.when(F.col("_line").startswith("REFERENCE") | F.col("_line").startswith("REL_PATHWAY"),
                     F.col("_pos"))).alias("_r"))
    toks = F.split(F.trim("_line"), r"\s+")
    x = lines.join(bounds, key).withColumn("_t", F.filter(toks, lambda t: F.length(t) > 0))
    comp = (x.where((F.col("_pos") >= F.col("_c")) & (F.col("_pos") < F.col("_r")))
            .select(key, F.lit("compound").alias("kind"),
                    F.when(F.col("_pos") == F.col("_c"), F.try_element_at("_t", F.lit(2)))
                    .otherwise(F.try_element_at("_t", F.lit(1))).alias("member")))
    gene = (x.where((F.col("_pos") >= F.col("_g")) & (F.col("_pos") < F.col("_c")) & F.col("_r").isNotNull())
            .select(key, F.lit("gene").alias("kind"),
                    F.when(F.col("_pos") == F.col("_g"), F.try_element_at("_t", F.lit(2)))
                    .otherwise(F.try_element_at("_t", F.lit(1))).alias("member")))
    need = {"metabolomics": ["compound"], "transcriptomics": ["gene"],
            "multiomics": ["compound", "gene"]}.get(mode)
    if need is None:
        raise ValueError(f"unknown mode {mode!r}")
    parts = {"compound": comp, "gene": gene}
    allm = None
    for k in need:
        allm = parts[k] if allm is None else allm.unionByName(parts[k])
    # a record is valid only if every needed section exists and has no token-less line
    ok = allm.groupBy(key).agg(*[F.count_if(F.col("kind") == k).alias(f"_n_{k}") for k in need],
                               F.count_if(F.col("member").isNull()).alias("_bad"))
    cond = F.col("_bad") == 0
    for k in need:
        cond = cond & (F.col(f"_n_{k}") > 0)
    good = ok.where(cond).select(key)
    return allm.join(good, key, "left_semi").distinct()


# ------------------------------------------------------------------ keyed result files
def read_keyed_csv(spark: SparkSession, path: str, pattern: str, groups: Sequence[str],
                   schema: T.StructType | None = None) -> DataFrame:
    """SRC10/SRC11: read many CSV results at once; key columns come from the
    file path through an anchored regular expression (one group per key).
    Files whose path does not match are dropped (the reference reports
    them). Given a folder, its CSV files are listed by tasks, at any depth."""
    r = spark.read.option("header", True)
    if not any(c in path for c in "*?[{") and not path.endswith(".csv"):
        r = r.option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv")
    if schema is not None:
        r = r.schema(schema)
    df = r.csv(path).select("*", F.col("_metadata.file_path").alias("_path"))
    for i, g in enumerate(groups, start=1):
        df = df.withColumn(g, F.regexp_extract("_path", pattern, i))
    return df.where(F.col(groups[0]) != "").drop("_path")


# ------------------------------------------------------------------ delimited tables
def read_delimited(spark: SparkSession, path: str, schema: T.StructType, sep: str = "\t",
                   drop: Sequence[str] = ()) -> DataFrame:
    """SRC6/SRC7: TSV/CSV (gzip too) with an explicit schema (no inference);
    compressed files are not splittable, so rewrite them to Parquet once."""
    df = spark.read.option("header", True).option("sep", sep).schema(schema).csv(path)
    return df.drop(*drop)


def unpivot_wide(df: DataFrame, key: str, name: str = "feature", value: str = "value") -> DataFrame:
    """Wide (key, f1, f2, ...) -> long (key, feature, value)."""
    cols = [c for c in df.columns if c != key]
    return df.unpivot([key], cols, name, value)


def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by: Sequence[str] = (),
                sep: str = ",") -> None:
    """SNK1-SNK3, SNK7: write a result table (Parquet by default; CSV for
    narrow tables), optionally one folder per key value. A key's rows meet in
    one task, so its folder holds one file; tasks put their files in place
    themselves, since there may be many."""
    if fmt not in ("parquet", "csv"):
        raise ValueError(fmt)
    if not partition_by:
        w = df.write.mode("overwrite")
        w.parquet(path) if fmt == "parquet" else w.option("header", True).option("sep", sep).csv(path)
        return
    spark = df.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = jpath.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.getScheme() == "file" and len(df.columns) > len(partition_by):
        fs.delete(jpath, True)
        fs.mkdirs(jpath)
        folder = jpath.toUri().getPath()
        _write_local(df, folder, fmt, list(partition_by), sep, tasks)
        return
    w = (df.repartition(tasks, *partition_by).write.mode("overwrite").partitionBy(*partition_by)
         .option("mapreduce.fileoutputcommitter.algorithm.version", "2"))
    w.parquet(path) if fmt == "parquet" else w.option("header", True).option("sep", sep).csv(path)


# characters that Spark writes as %XX in the folder of a key
ESCAPED = frozenset([*map(chr, range(1, 0x20)), *"\"#%'*/:=?\\\x7f{[]^"])


def key_folder(names: Sequence[str], values: Sequence[str | None]) -> str:
    """The folder of a key as Spark's partitioned writes name it."""
    escape = lambda s: "".join(f"%{ord(c):02X}" if c in ESCAPED else c for c in s)
    return "/".join(f"{escape(n)}={escape(v) if v else '__HIVE_DEFAULT_PARTITION__'}" for n, v in zip(names, values))


def _write_local(df: DataFrame, folder: str, fmt: str, keys: list[str], sep: str, tasks: int) -> None:
    """Partitioned write to a (shared) folder of the ``file`` file system, where
    Hadoop starts a process for the permissions of every file it creates: the
    tasks create the files. Names and contents are those of Spark's writes: the
    lines of CSV files are made by ``to_csv``. A file gets its name when it is
    whole, so tasks that run twice do no harm."""
    import os
    import uuid

    import pyarrow as pa
    import pyarrow.compute as pc
    import pyarrow.parquet as pq

    data = [c for c in df.columns if c not in keys]
    # an empty text and NULL are one key
    named = [F.nullif(F.col(f"`{k}`").cast("string"), F.lit("")).alias(f"_key{i}") for i, k in enumerate(keys)]
    own = [f"_key{i}" for i in range(len(keys))]
    if fmt == "csv":
        line = lambda cols: F.to_csv(F.struct(*cols), {"sep": sep})
        head = df.sparkSession.range(1).select(line([F.lit(c).alias(f"c{i}") for i, c in enumerate(data)])).first()[0]
        rows = df.select(*named, line([F.col(f"`{c}`") for c in data]).alias("_line"))
    else:
        rows = df.select(*named, *[F.col(f"`{c}`") for c in data])
    name = f"part-00000-{uuid.uuid4()}.{'csv' if fmt == 'csv' else 'snappy.parquet'}"

    def run(batches):
        held, made, n = None, None, 0                  # the key at hand, its file, files put in place

        def done():
            if made[3] is not None:
                made[3].close()
            made[0].close()
            os.replace(made[1], made[2])

        for batch in batches:
            if not batch.num_rows:
                continue
            key = [batch.column(i) for i in range(len(own))]
            new = pa.array([False] * (batch.num_rows - 1), pa.bool_())
            for k in key:                              # rows come in order of their keys
                a, b = k.slice(1), k.slice(0, len(k) - 1)
                differ = pc.fill_null(pc.not_equal(a, b), pc.not_equal(pc.is_null(a), pc.is_null(b)))
                new = pc.or_(new, pc.fill_null(differ, True))
            at = [0, *(i + 1 for i, x in enumerate(new.to_pylist()) if x), batch.num_rows]
            for lo, hi in zip(at, at[1:]):
                now = tuple(k[lo].as_py() for k in key)
                if made is None or now != held:
                    if made is not None:
                        done()
                        n += 1
                    held, to = now, os.path.join(folder, key_folder(keys, now), name)
                    os.makedirs(os.path.dirname(to), exist_ok=True)
                    begun = os.path.join(os.path.dirname(to), f".{uuid.uuid4().hex}")
                    made = [open(begun, "wb"), begun, to, None]
                    if fmt == "csv":
                        made[0].write(head.encode() + b"\n")
                part = batch.slice(lo, hi - lo)
                if fmt == "csv":
                    made[0].write("".join(f"{x}\n" for x in part.column(len(own)).to_pylist()).encode())
                else:
                    part = part.select(range(len(own), batch.num_columns))
                    if made[3] is None:
                        made[3] = pq.ParquetWriter(made[0], part.schema, compression="snappy")
                    made[3].write_batch(part)
        if made is not None:
            done()
            n += 1
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["files"])

    rows.repartition(tasks, *own).sortWithinPartitions(*own).mapInArrow(run, "files long").agg(F.sum("files")).collect()


def write_distinct_values(df: DataFrame, col: str, path: str) -> None:
    """SNK5: distinct non-null values of a column (not the string 'nan'),
    one per line."""
    (df.select(F.col(col).cast("string").alias("value")).where(F.col("value").isNotNull())
     .where(F.col("value") != "nan").distinct().write.mode("overwrite").text(path))


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint folder for written results."""
    import uuid
    from sigflow.session import ensure_checkpoint_dir
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/sigflow-out/{name}-{uuid.uuid4().hex[:12]}"

