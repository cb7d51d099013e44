"""Deterministic sampling primitives shared by the correlation study, the
ML splits and fold assignment.

All randomness is ``md5(seed ':' key...)``: identical in Spark SQL and
DuckDB, independent of partitioning, so reruns after executor loss give the
same rows and an SQL oracle can repeat every draw.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Draws per wanted pair where a group has more than this many pairs for each
# wanted one, and draws on top: fewer distinct ones than wanted are then as
# unlikely as an md5 collision.
DRAWS_PER_PAIR, MORE_DRAWS = 4, 64


def md5_hex(seed, *parts) -> Column:
    cols = [F.lit(str(seed))] + [F.col(p).cast("string") if isinstance(p, str) else p.cast("string")
                                 for p in parts]
    return F.md5(F.concat_ws(":", *cols))


def hex_int(h: Column, start: int, length: int) -> Column:
    """Unsigned integer from ``length`` hex digits of ``h`` (1-based start)."""
    return F.conv(F.substring(h, start, length), 16, 10).cast("bigint")


def dense_index(df: DataFrame, keys: Sequence[str], order_col: str, tie_col: str,
                out: str = "_idx", prefix_len: int = 2) -> DataFrame:
    """0-based position of each row inside its key group when ordered by
    ``order_col`` (an md5 hex string), then ``tie_col``.

    Equal to ``row_number() over (partition by keys order by order_col) - 1``
    but skew-safe: rows are split into 16^prefix_len sub-groups (256 by
    default; 65536 for a global numbering) by the first hex digits of the md5, sub-group sizes are counted (a table of at most 256
    rows per key), and their running offsets added to a row_number taken
    inside each sub-group. A key holding a third of all rows is therefore
    sorted by 256 tasks, not one.
    """
    keys = list(keys)
    b = F.substring(F.col(order_col), 1, prefix_len)
    x = df.withColumn("_bkt", b)
    counts = x.groupBy(*keys, "_bkt").agg(F.count("*").alias("_cnt"))
    wo = Window.partitionBy(*keys).orderBy("_bkt")
    offsets = counts.withColumn("_off", F.sum("_cnt").over(wo) - F.col("_cnt")).drop("_cnt")
    wi = Window.partitionBy(*keys, "_bkt").orderBy(order_col, tie_col)
    return (x.join(offsets, keys + ["_bkt"])
            .withColumn(out, F.col("_off") + F.row_number().over(wi) - 1)
            .drop("_bkt", "_off"))


def hash_cuts(df: DataFrame, order_col: str, ranks: Callable[[int], Sequence[int]],
              distinct: bool = False) -> list[str]:
    """For each rank a string with exactly that many md5 values of ``order_col``
    below it; equal values lie on one side, so a rank inside a run of them is
    moved to its start. ``ranks`` is given the number of (``distinct``) values.

    Values are counted by their first four digits, then only those that share
    their digits with a cut by the next four, and so on: two or three passes, each
    of at most 65,536 rows a rank on the driver, and no row is numbered."""
    h = F.col(order_col)

    def count(rows: DataFrame, digits: int) -> list[tuple[str, int]]:
        rows = rows.select(order_col).distinct() if distinct else rows
        return sorted(tuple(r) for r in rows.groupBy(F.substring(h, 1, digits).alias("p")).agg(F.count("*")).collect())

    def place(cells: list[tuple[str, int]], rank: int) -> tuple[str, int]:
        for prefix, n in cells:
            if rank < n:
                return prefix, rank
            rank -= n
        return "g", 0                                # above every hex digit

    cells = count(df, 4)
    found = [place(cells, k) for k in ranks(sum(n for _, n in cells))]
    for digits in range(8, 33, 4):
        todo = sorted({p for p, left in found if left})
        if not todo:
            break
        cells = count(df.where(F.substring(h, 1, digits - 4).isin(todo)), digits)
        found = [place([c for c in cells if c[0].startswith(p)], left) if left else (p, left) for p, left in found]
    return [p for p, _ in found]


def decode_pair(q: Column) -> tuple[Column, Column]:
    """Pair number q -> (i, j), i < j, in the order (0,1),(0,2),(1,2),(0,3)...
    j is the triangular root, corrected by one step against round-off."""
    j0 = F.floor((F.lit(1.0) + F.sqrt(F.lit(1.0) + q.cast("double") * 8.0)) / 2.0).cast("bigint")

    def tri(x):  # x (x - 1) / 2 in exact integer arithmetic (the product is even)
        return F.shiftright(x * (x - 1), 1)

    j = (F.when(tri(j0) > q, j0 - 1)
         .when(tri(j0 + 1) <= q, j0 + 1).otherwise(j0))
    i = q - tri(j)
    return i, j


def sample_pairs(groups: DataFrame, keys: Sequence[str], n_col: str, max_pairs: int,
                 seed) -> DataFrame:
    """For each group with n members, up to ``max_pairs`` distinct member
    pairs drawn without replacement (all pairs when there are fewer).

    A group of at most 4 * max_pairs pairs sorts its pair numbers by their md5
    and takes the first; a larger one draws numbers (md5 modulo the number of
    pairs) and takes the first distinct ones. Either way every set of pairs is
    equally likely over seeds, and a group's row makes its own draw: at most
    ``max_pairs`` rows a group leave, whatever its size.
    Returns (keys..., _i, _j)."""
    if max_pairs is None or max_pairs < 1:
        # every pair of a group is quadratic in its size; the reference's
        # studies always cap (50 in its driver script, 500 by default)
        raise ValueError("max_pairs must be a positive cap")
    keys = list(keys)
    n = F.col(n_col).cast("bigint")
    c = F.shiftright(n * (n - 1), 1)
    p = F.least(c, F.lit(int(max_pairs)).cast("bigint"))
    few = F.lit(DRAWS_PER_PAIR * int(max_pairs)).cast("bigint")
    parts = [F.lit(str(seed))] + [F.col(x).cast("string") for x in keys]
    digest = lambda x: F.md5(F.concat_ws(":", *parts, x.cast("string")))
    upto = lambda last: F.sequence(F.lit(0).cast("bigint"), last)
    by_digest = F.transform(F.array_sort(F.transform(upto(F.col("_C") - 1), lambda x: F.struct(
        digest(x).alias("h"), x.alias("q")))), lambda x: x["q"])
    drawn = F.array_distinct(F.transform(upto(few + (MORE_DRAWS - 1)), lambda x: F.pmod(
        hex_int(digest(x), 1, 15), F.col("_C"))))
    g = groups.where(n >= 2).select(*keys, c.alias("_C"), p.cast("int").alias("_P"))
    k = g.select(*keys, F.explode(F.slice(F.when(F.col("_C") <= few, by_digest).otherwise(drawn),
                                          F.lit(1), F.col("_P"))).alias("_q"))
    i, j = decode_pair(F.col("_q"))
    return k.select(*keys, i.alias("_i"), j.alias("_j"))
