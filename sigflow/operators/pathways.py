"""Pathway membership against measured molecules: coverage, coverage
statistics, threshold intersections, least-covered pathways (JN11, AGG8,
AGG9, TOP1).

Membership is a bridge table (pathway_id, member); the measured set is a
one-column table. Everything is a join plus grouped counts; the threshold
sweep of AGG9 counts members once and evaluates all thresholds in one
conditional aggregation instead of recomputing per threshold.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def coverage(membership: DataFrame, measured: DataFrame, pathway: str = "pathway_id",
             member: str = "gene") -> DataFrame:
    """AGG8 per pathway: found / total (members counted as listed, so a
    duplicate counts twice; pathways without members do not appear)."""
    m = measured.select(F.col(member)).distinct().withColumn("_found", F.lit(1))
    j = membership.join(m, member, "left")
    return (j.groupBy(pathway)
            .agg(F.count("*").alias("n_total"), F.count("_found").alias("n_found"))
            .withColumn("coverage", F.col("n_found") / F.col("n_total")))


def coverage_stats(cov: DataFrame) -> DataFrame:
    """AGG8 summary: mean, median, std (ddof 1), min, max, number of pathways
    fully / partly / not covered, number of pathways."""
    c = F.col("coverage")
    return cov.agg(F.avg(c).alias("mean"), F.median(c).alias("median"),
                   F.stddev_samp(c).alias("std"), F.min(c).alias("min"), F.max(c).alias("max"),
                   F.count_if(c == 1.0).alias("pathways_full_coverage"),
                   F.count_if((c > 0) & (c < 1.0)).alias("pathways_partial_coverage"),
                   F.count_if(c == 0).alias("pathways_no_coverage"),
                   F.count("*").alias("n_pathways_total"))


def measured_counts(membership: DataFrame, measured: DataFrame, pathway: str = "pathway_id",
                    member: str = "gene") -> DataFrame:
    """Members of each pathway that are measured (pathways with none kept,
    with count 0)."""
    m = measured.select(member).distinct().withColumn("_found", F.lit(1))
    return (membership.join(m, member, "left").groupBy(pathway)
            .agg(F.count("_found").alias("n_measured")))


def intersections(rna_membership: DataFrame, rna_measured: DataFrame,
                  met_membership: DataFrame, met_measured: DataFrame,
                  scored_pathways: DataFrame, thresholds: Sequence[int],
                  rna_threshold: int = 15, pathway: str = "pathway_id",
                  member: str = "gene") -> tuple[DataFrame, DataFrame]:
    """AGG9: for every metabolite threshold t, the pathways with >= t
    measured metabolites, >= ``rna_threshold`` measured genes and a score.
    Returns (counts per threshold, pathway list per threshold in long form).
    """
    rna = (measured_counts(rna_membership, rna_measured, pathway, member)
           .where(F.col("n_measured") >= rna_threshold).select(pathway).withColumn("_rna", F.lit(1)))
    met = measured_counts(met_membership, met_measured, pathway, member)
    scored = scored_pathways.select(pathway).distinct().withColumn("_l1000", F.lit(1))
    spark = met.sparkSession
    ts = spark.createDataFrame([(int(t),) for t in thresholds], "threshold int")
    # thresholds x pathways: a handful of thresholds, one row per pathway
    flags = (met.join(ts, F.col("n_measured") >= F.col("threshold"), "inner")
             .join(rna, pathway, "left").join(scored, pathway, "left"))
    counts = (ts.join(flags.groupBy("threshold").agg(
        F.count("*").alias("met_pathways_count"),
        F.count("_rna").alias("met_and_rna_count"),
        F.count_if(F.col("_rna").isNotNull() & F.col("_l1000").isNotNull()).alias("count")),
        "threshold", "left").fillna(0))
    members = (flags.where(F.col("_rna").isNotNull() & F.col("_l1000").isNotNull())
               .select("threshold", pathway))
    return counts, members


def least_covered(cov: DataFrame, names: DataFrame, n: int = 5, pathway: str = "pathway_id"
                  ) -> DataFrame:
    """TOP1: the n least-covered pathways with their names ('Unknown' when
    the pathway has no name)."""
    low = cov.orderBy(F.col("coverage").asc(), F.col(pathway).asc()).limit(n)
    return (low.join(names, pathway, "left")
            .select(pathway, "coverage", F.coalesce(F.col("name"), F.lit("Unknown")).alias("name")))
