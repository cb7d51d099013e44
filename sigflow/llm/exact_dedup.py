"""Exact deduplication over an extendible-hash index, DataFrame functions only.

Rows are hashed to a 64-bit key and written to shared files (``entries``).
Copies are added up by address (key, digest, chain) within ``SALTS`` shares of
the rows, so that an address has at most that many index entries however often
its text occurs. The directory is doubled until its buckets fit: starting with
one bucket, a bucket holding more than ``capacity`` index entries is split on
its next key bit. A bucket is therefore a contiguous range of keys with its own
local depth; all its entries are sent to the bucket's owner task, which puts
the chains together and writes the index file. Every row's group, and the row
that stays, is read from the index by bucket and address.

Entries with equal key form a chain. Rows belong to the same chain link only
if their normalised bytes are equal: one aggregation groups the texts
themselves (copies collapse inside every map task before the shuffle, so a
text held by a third of all rows crosses the network once per map task) and
reports the (key, digest) pairs shared by different texts. Those few are
numbered by their SHA-256; everywhere else the link number is 0.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sigflow.llm.common import fix_splits, materialise, strip_spaces, text_of
from sigflow.operators.components import heavy_keys, lookup

DIRECTORY_BITS = 16          # key bits of a directory: at most 2**16 slots
MOST_BITS = 22               # to which it is doubled while a bucket is overfull
BUCKET_CAPACITY = 50_000     # index entries in a bucket before it splits
SALTS = 16                   # index entries of one address at most


def directory(held: DataFrame, key: str = "key", capacity: int = BUCKET_CAPACITY,
              max_depth: int = DIRECTORY_BITS) -> tuple[DataFrame, int]:
    """(slots, their number of key bits) after all doublings: one row per used
    ``prefix`` of that many bits with the ``depth`` and ``bucket`` it points to.

    The entries of every prefix are counted and added up level by level; a
    prefix's local depth is the smallest d whose d-bit range holds at most
    ``capacity`` entries. Where ranges of ``max_depth`` bits hold more, the
    directory is doubled on, up to ``MOST_BITS`` bits. At most 2**bits rows, so
    it may be broadcast."""
    while True:
        cells = materialise(held.groupBy(F.shiftrightunsigned(F.col(key), 64 - max_depth).alias("prefix"))
                            .agg(F.count("*").alias("n")), "cells")
        if max_depth >= MOST_BITS or not (cells.agg(F.max("n")).first()[0] or 0) > capacity:
            break
        max_depth += 1
    levels = (cells.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(max_depth))))
              .withColumn("range", F.expr(f"shiftright(prefix, {max_depth} - level)")))
    fits = (levels.groupBy("level", "range").agg(F.sum("n").alias("held"))
            .where((F.col("held") <= capacity) | (F.col("level") == max_depth)).select("level", "range"))
    # at most twice the slots
    found = levels.join(F.broadcast(fits), ["level", "range"], "left_semi").groupBy("prefix").agg(F.min("level").alias("depth"))
    # a bucket is named by its depth and its range, the range being `depth` bits long
    return found.withColumn(
        "bucket", F.expr(f"shiftleft(depth, {max_depth + 1}) + shiftright(prefix, {max_depth} - depth)")), max_depth


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                key: Callable[[Column], Column] = F.xxhash64,
                digest: Callable[[Column], Column] = lambda c: F.sha2(c, 256),
                capacity: int = BUCKET_CAPACITY, max_depth: int = DIRECTORY_BITS) -> DataFrame:
    """The result of ``indexed`` without its row numbers."""
    return indexed(df, id_col, text_col, key, digest, capacity, max_depth).drop("row")


def distinct_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df`` that stay, with all their columns. ``df`` is read
    more than once and must give the same rows in the same partitions, as a
    table scan does."""
    fix_splits(df.sparkSession)
    stays = indexed(df, id_col, text_col).where("kept").select(F.col("row").alias("_sigflow_row"))
    return df.withColumn("_sigflow_row", F.monotonically_increasing_id()).join(stays, "_sigflow_row", "left_semi").drop("_sigflow_row")


def indexed(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
            key: Callable[[Column], Column] = F.xxhash64,
            digest: Callable[[Column], Column] = lambda c: F.sha2(c, 256),
            capacity: int = BUCKET_CAPACITY, max_depth: int = DIRECTORY_BITS) -> DataFrame:
    """One row per row of ``df``: doc_id, keep_id, group_size, kept,
    text_sha256, the index address (bucket, bucket_depth, chain) and row, the
    number of the row.

    Texts are equal when they are identical after deleting ASCII white space;
    a NULL text is empty. Of equal texts the row with the most code points in
    the original text stays, then the smallest id (a NULL id counts as larger
    than any). Repeated rows with the same id and length are separate rows; one
    of them is kept. An empty table gives an empty result; other columns of
    ``df`` are not read, so their names cannot clash. ``key`` must give a long.
    """
    norm = strip_spaces(F.col("text"))
    rows = (df.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))
            .select("doc_id", F.char_length("text").alias("n_chars"), norm.alias("norm"))
            .withColumn("key", key(F.col("norm"))).withColumn("digest", digest(F.col("norm")))
            .withColumn("sha", F.sha2("norm", 256)))
    entries = materialise(
        rows.drop("norm").withColumn("row", F.monotonically_increasing_id()), "entries")

    # bytes compared: (key, digest) pairs that different texts share
    clashing = materialise(
        rows.groupBy("key", "digest", "norm").agg(F.count("*").alias("n"))
        .groupBy("key", "digest").agg(F.count("*").alias("links")).where("links > 1")
        .select("key", "digest"), "clashing")
    entries = entries.withColumn("chain", F.lit(0))
    if not clashing.isEmpty():
        link = F.dense_rank().over(Window.partitionBy("key", "digest").orderBy("sha"))
        again = entries.join(clashing, ["key", "digest"], "left_semi").withColumn("chain", link)
        entries = (entries.join(clashing, ["key", "digest"], "left_anti").unionByName(again))

    address = ["key", "digest", "chain"]
    best = F.min(F.struct((-F.col("n_chars")).alias("short"), F.col("doc_id").isNull().alias("none"),
                          F.col("doc_id").alias("keep_id"), F.col("row").alias("keep_row")))
    salt = F.pmod(F.xxhash64("row"), F.lit(SALTS)).alias("salt")
    held = materialise(entries.groupBy(salt, *address).agg(best.alias("best"), F.count("*").alias("copies")).drop("salt"), "held")

    slots, bits = directory(held, "key", capacity, max_depth)
    slots = F.broadcast(materialise(slots, "directory"))                # <= 2**bits rows
    prefix = F.shiftrightunsigned(F.col("key"), 64 - bits).alias("prefix")
    # a bucket's entries meet in its owner task, where chains are put together without another shuffle
    owned = held.withColumn("prefix", prefix).join(slots, "prefix").repartition("bucket")
    index = materialise(
        owned.groupBy("bucket", "depth", *address).agg(F.min("best").alias("best"), F.sum("copies").alias("group_size"))
        .select("bucket", "depth", *address, "group_size", "best.keep_id", "best.keep_row"), "index")
    place = ["bucket", *address]
    filed = entries.withColumn("prefix", prefix).join(slots.select("prefix", "bucket"), "prefix").drop("prefix")
    heavy = heavy_keys(filed, place, filed.count())
    return (lookup(filed, index, place, heavy=heavy)
            .select("doc_id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"),
                    F.col("sha").alias("text_sha256"), "bucket", F.col("depth").alias("bucket_depth"), "chain", "row"))
