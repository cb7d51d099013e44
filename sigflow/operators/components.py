"""Connected components as a loop of DataFrame joins, safe for hub nodes and
giant components."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigflow.session import cut_lineage

HEAVY_ROWS = 20_000          # a key is heavy with more rows than this and
LOCAL_EDGES = 200_000        # edges of a group whose components one task finds
HEAVY_SHARE = 1000           # more than 1/HEAVY_SHARE of all: at most HEAVY_SHARE keys are


def heavy_keys(df: DataFrame, keys: Sequence[str], total: int) -> DataFrame | None:
    """The keys that hold a large share of ``df``: at most ``HEAVY_SHARE``
    rows whatever the data, or None where no key can be heavy."""
    bound = max(HEAVY_ROWS, total // HEAVY_SHARE)
    if total <= bound:
        return None
    found = cut_lineage(df.groupBy(*keys).count().where(F.col("count") > bound).select(*keys))
    return None if found.isEmpty() else found


def lookup(big: DataFrame, small: DataFrame, keys: Sequence[str], how: str = "inner",
           heavy: DataFrame | None = None) -> DataFrame:
    """``big`` joined to ``small`` (one row per key). Rows of the given heavy
    keys are joined by broadcasting those few rows of ``small``; the others by
    an ordinary join, whose partitions then hold no large group."""
    keys = list(keys)
    if heavy is None:
        return big.join(small, keys, how)
    few = F.broadcast(small.join(F.broadcast(heavy), keys, "left_semi"))    # <= HEAVY_SHARE rows
    hot = big.join(F.broadcast(heavy), keys, "left_semi").join(few, keys, how)
    cold = big.join(F.broadcast(heavy), keys, "left_anti").join(small, keys, how)
    return cold.unionByName(hot)


def _local(edges: DataFrame, g: list[str]) -> DataFrame:
    """(groups..., _v, _c) of the nodes of groups with few edges (_x, _y): one task a group."""
    import numpy as np
    import pandas as pd

    def fn(pdf):
        names, at = np.unique(np.concatenate([pdf["_x"], pdf["_y"]]), return_inverse=True)
        a, b = at[:len(pdf)], at[len(pdf):]
        label = np.arange(len(names))
        while True:
            low = np.minimum(label[a], label[b])
            new = label.copy()
            np.minimum.at(new, a, low)
            np.minimum.at(new, b, low)
            np.minimum.at(new, label[a], low)
            np.minimum.at(new, label[b], low)
            new = new[new]
            if (new == label).all():
                break
            label = new
        return pd.DataFrame({**{k: [pdf[k].iloc[0]] * len(names) for k in g}, "_v": names, "_c": names[label]})

    kind = {f.name: f.dataType.simpleString() for f in edges.schema.fields}
    schema = ", ".join([*[f"`{k}` {kind[k]}" for k in g], f"_v {kind['_x']}", f"_c {kind['_x']}"])
    return edges.groupBy(*g).applyInPandas(fn, schema)


def connected_components(nodes: DataFrame, edges: DataFrame, node: str = "id", src: str = "a",
                         dst: str = "b", group_cols: Sequence[str] = ()) -> DataFrame:
    """Single-linkage flat clusters = connected components: every node gets
    the smallest node id of its component, as column ``component``.

    Each round propagates the minimum label over the edges and then jumps
    pointers (label <- label of label), so labels travel exponentially far;
    each round's labels are written as a reliable checkpoint (short lineage,
    survives executor loss). The loop ends when no label changes. Hub nodes and
    the label of a giant component are looked up apart from the other keys.
    With groups, those of at most ``LOCAL_EDGES`` edges are settled by one task
    each and only the others take part in the rounds."""
    g = list(group_cols)
    if g:
        pairs = cut_lineage(edges.select(*g, F.col(src).alias("_x"), F.col(dst).alias("_y")))
        many = cut_lineage(pairs.groupBy(*g).count().where(F.col("count") > LOCAL_EDGES).select(*g))
        if many.isEmpty():
            found, large = _local(pairs, g), None
        else:
            found, large = _local(pairs.join(many, g, "left_anti"), g), pairs.join(many, g, "left_semi")
        if large is not None:
            own = large.select(*g, F.col("_x").alias("_v")).union(large.select(*g, "_y")).distinct()
            found = found.unionByName(_rounds(own, large, "_v", "_x", "_y", g).withColumnRenamed("component", "_c"))
        plain = nodes.select(*g, F.col(node).alias("_v")).distinct()
        return (plain.join(found, g + ["_v"], "left")
                .select(*g, F.col("_v").alias(node), F.coalesce("_c", "_v").alias("component")))
    return _rounds(nodes, edges, node, src, dst, g)


def _rounds(nodes: DataFrame, edges: DataFrame, node: str, src: str, dst: str, g: list[str]) -> DataFrame:
    lab = cut_lineage(nodes.select(*g, F.col(node).alias("_v")).distinct().withColumn("_c", F.col("_v")))
    # the edge list is read every round: materialise it once
    und = cut_lineage(edges.select(*g, F.col(src).alias("_x"), F.col(dst).alias("_y"))
                      .unionByName(edges.select(*g, F.col(dst).alias("_x"), F.col(src).alias("_y"))).distinct())
    n_nodes, n_edges = lab.count(), und.count()
    hubs = heavy_keys(und, g + ["_x"], n_edges)
    while n_edges:
        prop = (lookup(und, lab.withColumnRenamed("_v", "_x"), g + ["_x"], heavy=hubs)
                .groupBy(*g, F.col("_y").alias("_v")).agg(F.min("_c").alias("_m")))
        step = (lab.join(prop, g + ["_v"], "left")
                .select(*g, "_v", F.col("_c").alias("_old"),
                        F.least(F.col("_c"), F.coalesce(F.col("_m"), F.col("_c"))).alias("_c1")))
        if n_nodes > HEAVY_ROWS:
            step = cut_lineage(step)
        hop = step.select(*g, F.col("_v").alias("_c1"), F.col("_c1").alias("_c2"))
        nxt = (lookup(step, hop, g + ["_c1"], "left", heavy_keys(step, g + ["_c1"], n_nodes))
               .select(*g, "_v", "_old",
                       F.least(F.col("_c1"), F.coalesce(F.col("_c2"), F.col("_c1"))).alias("_c")))
        nxt = cut_lineage(nxt)
        settled = nxt.where(F.col("_c") != F.col("_old")).isEmpty()
        lab = nxt.drop("_old")
        if settled:
            break
    return lab.withColumnRenamed("_v", node).withColumnRenamed("_c", "component")
