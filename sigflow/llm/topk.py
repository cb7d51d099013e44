"""Exact top-k search over binary codes by incremental multi-index hashing.

Codes are cut into segments of at most log2(n) bits; an index holds every
distinct code under each of its segment values. Queries probe all values
within a segment radius that grows by one a round. After radius r in all m
segments every code within m * (r + 1) - 1 bits has been met, since a code
further off in every segment would differ in more. A query ends when its k-th
verified distance is covered by that bound; the others go on. Copies of a code
are one index entry with its k smallest ids.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sigflow.llm.common import materialise
from sigflow.operators.components import heavy_keys, lookup
from sigflow.session import cut_lineage

BITS = 64


def sign_code(vector: str) -> Column:
    """Bit i is set where element i is positive; NULL elements, missing ones
    and a NULL vector give 0. A vector of more than 64 elements has no such
    code: the job fails."""
    code = F.coalesce(F.expr(
        f"aggregate(sequence(0, {BITS - 1}), 0L, (acc, i) -> acc | if(coalesce(get({vector}, i), 0) > 0, "
        "shiftleft(1L, i), 0L))"), F.lit(0).cast("long"))
    return F.when(F.size(vector) > BITS, F.raise_error(F.lit(f"vectors have at most {BITS} elements")).cast("long")).otherwise(code)


def segments(n: int) -> list[tuple[int, int]]:
    """(first bit, width) of each segment, at most log2(n) bits wide: a probe
    then meets a code on average, and few probes find an empty value."""
    m = max(3, min(16, math.ceil(BITS / max(4.0, math.log2(max(n, 2))))))
    edges = [BITS * j // m for j in range(m + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def segment(code: Column, first: int, width: int) -> Column:
    return F.shiftrightunsigned(code, first).bitwiseAND(F.lit((1 << width) - 1).cast("long"))


def top_k(codes: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """The ``k`` rows of ``codes`` (id, code) nearest to every row of
    ``queries`` (id, code), by Hamming distance, then id: query_id, rank,
    neighbour_id, distance. A row that is also a query finds itself. Repeated
    rows are separate neighbours and, as queries, separate answers; NULL ids
    come first among ties. With fewer than k rows all are returned; an empty
    table gives an empty result."""
    # the k smallest ids of a code; ranks are cut inside every task before the shuffle
    by_id = Window.partitionBy("code").orderBy("id")
    ids = materialise(codes.select("id", "code").withColumn("place", F.row_number().over(by_id))
                      .where(F.col("place") <= k), "ids")
    entries = materialise(ids.groupBy("code").agg(F.count("*").alias("n"), F.min(F.struct("place", "id"))["id"].alias("least")),
                          "entries")
    asked = materialise(queries.select(F.col("id").alias("query_id"), F.col("code").alias("query")), "queries")
    cuts = segments(entries.count())
    m = len(cuts)
    key = lambda c: F.explode(F.array(*[
        F.struct(F.lit(j).alias("segment"), segment(F.col(c), a, w).alias("value")) for j, (a, w) in enumerate(cuts)]))
    index = materialise(entries.select("code", "n", "least", key("code").alias("s")).select(
        "code", "n", "least", "s.segment", "s.value"), "index")
    spark = codes.sparkSession
    differ = F.col("query").bitwiseXOR(F.col("code"))
    # the first (radius, segment) at which a pair meets: it counts there only
    meets = reduce(F.least, [F.bit_count(segment(differ, a, w)) * m + j for j, (a, w) in enumerate(cuts)])
    order = Window.partitionBy("query").orderBy("distance", "least", "code")
    # ids of codes at the same distance interleave: only those strictly nearer come before all of a code's
    nearer = Window.partitionBy("query").orderBy("distance").rangeBetween(Window.unboundedPreceding, -1)
    open_ = cut_lineage(asked.select("query").distinct().withColumn("bound", F.lit(BITS + 1)))
    best, done = None, []
    for radius in range(max(w for _, w in cuts) + 1):
        # at most 2**width masks of this weight in a segment: bounded by the index, not the data
        masks = reduce(DataFrame.unionByName, [
            spark.range(1 << w).where(F.bit_count("id") == radius).select(F.lit(j).alias("segment"), F.col("id").alias("mask"))
            for j, (_, w) in enumerate(cuts)])
        probes = (open_.select("query", "bound", key("query").alias("s"))
                  .select("query", "bound", "s.segment", F.col("s.value").alias("own"))
                  .join(F.broadcast(masks), "segment")
                  .select("query", "bound", "segment", F.col("own").bitwiseXOR(F.col("mask")).alias("value")))
        met = (probes.join(index, ["segment", "value"])
               .where(meets == F.lit(radius * m) + F.col("segment"))
               .withColumn("distance", F.bit_count(differ)).where(F.col("distance") <= F.col("bound"))
               .select("query", "code", "n", "least", "distance"))
        if best is not None:
            met = met.unionByName(best.join(open_.select("query"), "query", "left_semi"))
        near = met.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k).drop("place")
        near = near.withColumn("before", F.coalesce(F.sum("n").over(nearer), F.lit(0))).where(F.col("before") < k).drop("before")
        best = cut_lineage(near)
        bounds = best.groupBy("query").agg(F.when(F.sum("n") >= k, F.max("distance")).otherwise(BITS + 1).alias("bound"))
        covered = m * (radius + 1) - 1
        after = cut_lineage(open_.select("query").join(bounds, "query", "left")
                            .withColumn("bound", F.coalesce("bound", F.lit(BITS + 1))))
        over = F.lit(covered >= BITS) | (F.col("bound") <= covered)
        done.append(best.join(after.where(over), "query", "left_semi"))
        open_ = after.where(~over)
        if open_.isEmpty():
            break
    found = materialise(reduce(DataFrame.unionByName, done), "found")
    spread = lookup(found.select("query", "code", "distance"), ids.select("code", F.col("id").alias("neighbour_id")),
                    ["code"], heavy=heavy_keys(found, ["code"], found.count()))
    ranked = (spread.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy("distance", "neighbour_id")))
              .where(F.col("rank") <= k).select("query", "rank", "neighbour_id", "distance"))
    return (lookup(asked, ranked, ["query"], heavy=heavy_keys(asked, ["query"], asked.count()))
            .select("query_id", "rank", "neighbour_id", F.col("distance").cast("int").alias("distance")))
