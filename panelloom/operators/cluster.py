"""Correlation clustering and cluster representatives."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelloom.config import TOLERANCE, validate
from panelloom.functions.scalars import ratio
from panelloom.operators.universe import largest_by


def correlation_pairs(returns: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, code_a, code_b, corr, dist) with code_a < code_b: Pearson over shared dates; null where a side does not vary."""
    a = returns.select(*keys, "return_date", F.col("index_code").alias("code_a"), F.col("daily_return").alias("x"))
    b = returns.select(*keys, "return_date", F.col("index_code").alias("code_b"), F.col("daily_return").alias("y"))
    both = a.join(b, [*keys, "return_date"]).where("code_a < code_b")
    corr = ratio(F.covar_samp("x", "y"), F.stddev_samp("x") * F.stddev_samp("y"))
    return both.groupBy(*keys, "code_a", "code_b").agg(corr.alias("corr")).withColumn("dist", 1 - F.col("corr"))


def merges(dist: np.ndarray) -> list[tuple[int, int, float]]:
    """(i, j, height) of complete linkage, by rising height: the clusters whose smallest members are i < j become one.

    Nearest-neighbour chain: from a cluster to its nearest and on, until two are each
    other's nearest; they are merged, and the chain goes on from what is left of it. Each
    step looks at one row, so n members take n squared. Pairs are ordered by distance, then
    members, and compared by their places in that order, so that ties have one outcome
    whatever the chain starts from. Pairs without a distance are never merged."""
    n = len(dist)
    upper = np.triu_indices(n, 1)
    d = np.array(dist, dtype=float)[upper]
    known = ~np.isnan(d)
    order = np.lexsort((upper[1][known], upper[0][known], d[known]))
    heights = d[known][order]
    place = np.full((n, n), np.iinfo(np.int64).max)
    i, j = upper[0][known][order], upper[1][known][order]
    place[i, j] = place[j, i] = np.arange(len(order))
    alive = np.ones(n, dtype=bool)
    found, chain = [], []
    apart = np.iinfo(np.int64).max
    while True:
        if not chain:
            left = np.flatnonzero(alive & (place.min(axis=1, initial=apart) < apart))
            if not len(left):
                break
            chain.append(int(left[0]))
        at = chain[-1]
        near = int(np.argmin(place[at]))
        if len(chain) > 1 and place[at, chain[-2]] == place[at, near]:
            near = chain[-2]
        if place[at, near] == apart:
            chain.pop()
            continue
        if len(chain) > 1 and near == chain[-2]:
            low, high = sorted((at, near))
            found.append((int(place[low, high]), low, high))
            del chain[-2:]
            place[low] = np.maximum(place[low], place[high])
            place[:, low] = place[low]
            place[low, low] = apart
            place[high] = place[:, high] = apart
            alive[high] = False
        else:
            chain.append(near)
    return [(low, high, float(heights[k])) for k, low, high in sorted(found)]


def cut(codes: list[str], steps: list[tuple[int, int, float]], threshold: float) -> dict[str, int]:
    """Clusters of the merges up to the height 1 - threshold, numbered from 1 by their smallest member (codes in order)."""
    top = list(range(len(codes)))
    for i, j, height in steps:
        if height <= 1 - threshold + TOLERANCE:
            top[j] = i
    for k in range(len(top)):  # a smaller one is settled before
        top[k] = top[top[k]]
    number = {t: n for n, t in enumerate(sorted(set(top)), 1)}
    return {c: number[top[k]] for k, c in enumerate(codes)}


def linkage(codes: list[str], dist: np.ndarray, threshold: float) -> dict[str, int]:
    """Complete linkage cut at 1 - threshold."""
    order = sorted(range(len(codes)), key=lambda i: codes[i])
    return cut([codes[i] for i in order], merges(np.array(dist, dtype=float)[np.ix_(order, order)]), threshold)


def complete_linkage(codes: DataFrame, pairs: DataFrame, thresholds: tuple[float, ...], keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, corr_threshold, index_code, cluster_id). One task for each selection, a matrix of some fifty indexes, whose merges serve all thresholds.

    Thresholds other than the configured ones are an error."""
    for t in thresholds:
        validate(correlation_threshold=t)
    one = F.lit(0.0).alias("dist")
    full = pairs.select(*keys, F.col("code_a").alias("a"), F.col("code_b").alias("b"), "dist").unionByName(codes.select(*keys, F.col("index_code").alias("a"), F.col("index_code").alias("b"), one))

    def run(group: pd.DataFrame) -> pd.DataFrame:
        names = sorted(group.loc[group.a == group.b, "a"])
        at = {c: i for i, c in enumerate(names)}
        d = np.full((len(names), len(names)), np.nan)
        for a, b, x in zip(group.a, group.b, group.dist, strict=True):
            d[at[a], at[b]] = d[at[b], at[a]] = x
        steps = merges(d)
        out = pd.concat([pd.DataFrame({"corr_threshold": float(t), "index_code": names, "cluster_id": [found[c] for c in names]}) for t in thresholds for found in [cut(names, steps, t)]])
        for k in keys:
            out[k] = group[k].iloc[0]
        return out[[*keys, "corr_threshold", "index_code", "cluster_id"]]

    types = dict(codes.dtypes)
    schema = ", ".join([*(f"{k} {types[k]}" for k in keys), "corr_threshold double", "index_code string", "cluster_id int"])
    return full.groupBy(*keys).applyInPandas(run, schema)


def representatives(clusters: DataFrame, turnover: DataFrame) -> DataFrame:
    """(cluster_id, cluster_size, index_code, etf_code, avg_turnover_20d): the member with the largest turnover, ties to the smallest instrument code."""
    joined = clusters.join(turnover, "index_code").withColumn("cluster_size", F.count("*").over(Window.partitionBy("cluster_id")))
    key = F.round("avg_turnover_20d", 6)
    return largest_by(joined, ["cluster_id"], [key.desc(), F.col("etf_code")], "cluster_id", "cluster_size", "index_code", "etf_code", "avg_turnover_20d")


def min_correlation(clusters: DataFrame, pairs: DataFrame) -> DataFrame:
    """(cluster_id, min_corr_in_cluster), null for a cluster of one."""
    a = clusters.select(F.col("index_code").alias("code_a"), "cluster_id")
    b = clusters.select(F.col("index_code").alias("code_b"), F.col("cluster_id").alias("other"))
    inside = pairs.join(a, "code_a").join(b, "code_b").where("cluster_id = other").groupBy("cluster_id").agg(F.min("corr").alias("min_corr_in_cluster"))
    return clusters.select("cluster_id").distinct().join(inside, "cluster_id", "left")


#: Columns of the detail of clusters, in order.
DETAIL_COLUMNS = ("cluster_id", "is_representative", "etf_code", "etf_name", "category", "index_code", "index_name", "avg_turnover_20d", "corr_to_representative", "min_corr_in_cluster", "corr_threshold", "dist_threshold")


def snapshot_detail(clusters: DataFrame, pairs: DataFrame, names: DataFrame, keys: tuple[str, ...] = ("selection_date", "corr_threshold")) -> DataFrame:
    """The twelve DETAIL_COLUMNS of every index of every snapshot and threshold, behind selection_date.

    clusters: (selection_date, corr_threshold, index_code, cluster_id, etf_code, avg_turnover_20d); pairs:
    (selection_date, code_a, code_b, corr); names: (etf_code, etf_name, category, index_name)."""
    of = Window.partitionBy(*keys, "cluster_id")
    best = F.row_number().over(of.orderBy(F.round("avg_turnover_20d", 6).desc(), "etf_code"))
    rows = clusters.withColumn("place", best).withColumn("rep", F.max(F.when(F.col("place") == 1, F.col("index_code"))).over(of))
    both = pairs.select("selection_date", "code_a", "code_b", "corr").unionByName(pairs.select("selection_date", F.col("code_b").alias("code_a"), F.col("code_a").alias("code_b"), "corr"))
    member = rows.select(*keys, "cluster_id", F.col("index_code").alias("code_a"))
    inside = member.join(pairs.select("selection_date", "code_a", "code_b", "corr"), ["selection_date", "code_a"])
    inside = inside.join(member.withColumnsRenamed({"code_a": "code_b", "cluster_id": "other"}), [*keys, "code_b"]).where("cluster_id = other")
    low = inside.groupBy(*keys, "cluster_id").agg(F.min("corr").alias("min_corr_in_cluster"))
    to_rep = both.select("selection_date", F.col("code_a").alias("index_code"), F.col("code_b").alias("rep"), "corr")
    found = rows.join(to_rep, ["selection_date", "index_code", "rep"], "left").join(low, [*keys, "cluster_id"], "left").join(names, "etf_code", "left")
    me = F.col("place") == 1
    found = found.withColumn("is_representative", me).withColumn("corr_to_representative", F.when(me, F.lit(1.0)).otherwise(F.col("corr"))).withColumn("dist_threshold", F.round(1 - F.col("corr_threshold"), 10))
    return found.select("selection_date", *DETAIL_COLUMNS)


def cluster_detail(clusters: DataFrame, turnover: DataFrame, pairs: DataFrame, threshold: float) -> DataFrame:
    """A row for each index: its cluster, whether it represents it, and its correlation to the representative."""
    rep = representatives(clusters, turnover).select("cluster_id", F.col("index_code").alias("rep"))
    both = pairs.select("code_a", "code_b", "corr").unionByName(pairs.select(F.col("code_b").alias("code_a"), F.col("code_a").alias("code_b"), "corr"))
    rows = clusters.join(turnover, "index_code").join(rep, "cluster_id").join(min_correlation(clusters, pairs), "cluster_id")
    rows = rows.join(both, (F.col("index_code") == F.col("code_a")) & (F.col("rep") == F.col("code_b")), "left")
    me = F.col("index_code") == F.col("rep")
    return rows.select("cluster_id", me.alias("is_representative"), "etf_code", "index_code", "avg_turnover_20d", F.when(me, F.lit(1.0)).otherwise(F.col("corr")).alias("corr_to_representative"), "min_corr_in_cluster", F.lit(threshold).alias("corr_threshold"), F.lit(round(1 - threshold, 10)).alias("dist_threshold"))
