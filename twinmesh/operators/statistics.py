"""Counts, activity and statistics per project and recipe."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinmesh.functions import hashing, scalars
from twinmesh.operators import exact

SCOPE = ["project_id", "algorithm_id"]


def assets_per_project(assets: DataFrame) -> DataFrame:
    return assets.groupBy("project_id").agg(F.count(F.lit(1)).alias("assets"))


def pairs_per_project(edges: DataFrame) -> DataFrame:
    """Undirected edges per project over all algorithms, configured or not."""
    return edges.where("asset_id < other_asset_id").groupBy("project_id").agg(F.count(F.lit(1)).alias("duplicate_pairs"))


def edge_counts(edges: DataFrame, threshold: float) -> DataFrame:
    """Qualifying undirected edges per scope."""
    return edges.where((F.col("similarity") >= threshold) & (F.col("asset_id") < F.col("other_asset_id"))).groupBy(*SCOPE).agg(F.count(F.lit(1)).alias("edge_count"))


def ranked_counts(edges: DataFrame, threshold: float) -> DataFrame:
    """Assets with a match per scope."""
    return edges.where(F.col("similarity") >= threshold).groupBy(*SCOPE).agg(F.countDistinct("asset_id").alias("ranked_assets"))


def assets_per_recipe(hashes: DataFrame, algorithms: DataFrame) -> DataFrame:
    """Distinct assets, not hash rows, per project and recipe. The distinct pairs are aggregated
    before the eight-row dimension is joined."""
    n = hashes.select(*SCOPE, "asset_id").distinct().groupBy(*SCOPE).agg(F.count(F.lit(1)).alias("asset_count"))
    return n.join(F.broadcast(algorithms.select("algorithm_id", "recipe")), "algorithm_id").select("project_id", "recipe", "asset_count")


def recipes_of_assets(hashes: DataFrame, algorithms: DataFrame) -> DataFrame:
    """(asset_id, recipe) pairs that have a hash."""
    return hashes.select("asset_id", "algorithm_id").distinct().join(F.broadcast(algorithms.select("algorithm_id", "recipe")), "algorithm_id").select("asset_id", "recipe")


def activity(assets: DataFrame, projects: DataFrame, as_of: dt.datetime) -> DataFrame:
    """Per project: the latest creation and the assets created in the 7 and 30 days before as_of;
    null and 0 for a project without assets."""
    since = lambda days: F.count_if(F.col("created_at") >= F.lit(as_of) - F.make_dt_interval(F.lit(days)))
    per = assets.groupBy("project_id").agg(F.max("created_at").alias("last_added_at"), since(7).alias("added_last_7d"), since(30).alias("added_last_30d"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return projects.select("project_id").join(per, "project_id", "left").select("project_id", "last_added_at", zero("added_last_7d"), zero("added_last_30d"))


def overview(projects: DataFrame, assets: DataFrame, edges: DataFrame) -> DataFrame:
    """One row per project: slug, name, assets, duplicate pairs."""
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    out = projects.select("project_id", "slug", "name").join(assets_per_project(assets), "project_id", "left").join(pairs_per_project(edges), "project_id", "left")
    return out.select("slug", "name", zero("assets"), zero("duplicate_pairs"))


def thresholds(projects: DataFrame, default: float) -> DataFrame:
    """(project_id, threshold): the project's own threshold, else the default, rounded to one decimal
    as cluster reads do."""
    t = F.coalesce(F.col("hamming_threshold").cast("double"), F.lit(float(default)))
    return projects.select("project_id", hashing.half_up(t).alias("threshold"))


def scope_edges(edges: DataFrame, projects: DataFrame, default: float) -> DataFrame:
    """Edges that reach their own project's threshold; projects are a small table."""
    return edges.join(F.broadcast(thresholds(projects, default)), "project_id").where("similarity >= threshold").drop("threshold")


def duplicates_per_recipe(projects: DataFrame, algorithms: DataFrame, hashes: DataFrame, edges: DataFrame, members: DataFrame, default: float, cap: int | None = None) -> DataFrame:
    """Per project and configured recipe: assets, clusters, edges, assets with a duplicate and their
    percentage, degraded. Exact recipes come from their hash classes; Hamming recipes from
    clusters at the project's threshold (``members``); a recipe that was never hashed is zero; a
    comparison without an edge list is degraded: its numbers are null. So is, where a ``cap`` is given, a
    scope of more edges."""
    configured = projects.select("project_id", F.explode(F.array_distinct("recipes")).alias("recipe")).join(F.broadcast(algorithms.select("recipe", "algorithm_id", "comparison")), "recipe", "left")
    of_exact = exact.stats(hashes.join(F.broadcast(algorithms.where("comparison = 'exact'").select("algorithm_id")), "algorithm_id", "left_semi"))
    e = scope_edges(edges, projects, default).where("asset_id < other_asset_id").groupBy(*SCOPE).agg(F.count(F.lit(1)).alias("edge_count"))
    c = members.groupBy(*SCOPE).agg(F.countDistinct("cluster_id").alias("cluster_count"), F.count(F.lit(1)).alias("assets_with_duplicate_count"))
    of_near = c.join(e, SCOPE, "left").join(F.broadcast(algorithms.where("comparison = 'hamming'").select("algorithm_id")), "algorithm_id", "left_semi")
    cols = [*SCOPE, "cluster_count", "edge_count", "assets_with_duplicate_count"]
    stats = of_exact.select(cols).unionByName(of_near.select(cols))
    counts = assets_per_recipe(hashes, algorithms)
    out = configured.join(stats, SCOPE, "left").join(counts, ["project_id", "recipe"], "left")
    # a left join with nothing found is zero; the comparison decides what can be reported at all
    degraded = F.coalesce(F.col("comparison") == "cosine", F.lit(False))
    if cap is not None:
        degraded = degraded | (F.coalesce(F.col("comparison") == "hamming", F.lit(False)) & (F.coalesce("edge_count", F.lit(0)) > cap))
    number = lambda c: F.when(~degraded, F.coalesce(c, F.lit(0))).cast("bigint").alias(c)
    out = out.select("project_id", "recipe", F.coalesce("asset_count", F.lit(0)).alias("asset_count"), number("cluster_count"), number("edge_count"), number("assets_with_duplicate_count"), degraded.alias("degraded"))
    return out.withColumn("assets_with_duplicate_pct", F.when(~F.col("degraded"), scalars.percent(F.col("assets_with_duplicate_count"), F.col("asset_count"))))
