"""The registry's reads: matches, ranking, clusters, edge lists, pages.

Edges are ``current_edges`` (one row per algorithm and direction). Attributes of assets are joined after
filters, aggregations and paging. Orders that are pages have a total order; where the registry leaves
ties open, the other asset's id decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from twinmesh.functions import hashing, scalars
from twinmesh.functions.parsing import PageInfo

SCOPE = ["project_id", "algorithm_id"]


def in_scope(df: DataFrame, project_id: str | None = None, algorithm_id: int | None = None) -> DataFrame:
    """Rows of one project and recipe; None leaves that part open."""
    if project_id is not None:
        df = df.where(F.col("project_id") == project_id)
    return df if algorithm_id is None else df.where(F.col("algorithm_id") == algorithm_id)


def at_least(edges: DataFrame, threshold: float) -> DataFrame:
    """Edges whose similarity reaches the threshold, as it is given (not rounded)."""
    return edges.where(F.col("similarity") >= float(threshold))


def canonical(edges: DataFrame) -> DataFrame:
    """One row per undirected edge that is stored with the smaller asset first."""
    return edges.where("asset_id < other_asset_id")


def named(assets: DataFrame, prefix: str = "") -> DataFrame:
    """(asset_id, identity_id, identity_path), each with the prefix."""
    return assets.select(*[F.col(c).alias(f"{prefix}{c}") for c in ("asset_id", "identity_id", "identity_path")])


def identity_filter(assets: DataFrame, id_: str | None = None, path: str | None = None) -> DataFrame:
    """Assets of one identity: by id where it is given, else by path."""
    if id_:
        return assets.where(F.col("identity_id") == id_)
    return assets.where(F.col("identity_path") == path) if path else assets.where("false")


def find_assets(assets: DataFrame, wanted: DataFrame) -> DataFrame:
    """(project_id, identity_id, identity_path, asset_id) of the identities in ``wanted``, each once: the asset of the id
    where one is given, else of the path, in the project; the smallest of several, null where there is none."""
    key = ["project_id", "identity_id", "identity_path"]
    wanted = wanted.select(*key).distinct()
    given = F.coalesce(F.col("identity_id") != "", F.lit(False))
    least = lambda c: assets.where(F.col(c).isNotNull()).groupBy("project_id", c).agg(F.min("asset_id").alias("asset_id"))
    by_id = wanted.where(given).join(least("identity_id"), ["project_id", "identity_id"], "left")
    by_path = wanted.where(~given).join(least("identity_path"), ["project_id", "identity_path"], "left")
    return by_id.select(*key, "asset_id").unionByName(by_path.select(*key, "asset_id"))


def search_filter(id_: str | None = None, path_term: str | None = None) -> Column:
    """An asset satisfies id and path term together; a missing one is always satisfied."""
    out = F.lit(True)
    if id_ is not None:
        out = out & F.coalesce(F.col("identity_id") == id_, F.lit(False))
    if path_term is not None:
        out = out & F.coalesce(scalars.path_term(F.col("identity_path"), path_term), F.lit(False))
    return out


def hash_at(hashes: DataFrame, asset_id: str, algorithm_id: int, sequence_index: int) -> DataFrame:
    """The hash row of an asset at one place of a recipe, if there is one."""
    return hashes.where((F.col("asset_id") == asset_id) & (F.col("algorithm_id") == algorithm_id) & (F.col("sequence_index") == sequence_index))


def hashes_at(hashes: DataFrame, places: DataFrame) -> DataFrame:
    """The hash rows at the given places (asset_id, algorithm_id, sequence_index)."""
    at = ["asset_id", "algorithm_id", "sequence_index"]
    return hashes.join(places.select(*at).distinct(), at, "left_semi")


def hashes_of(hashes: DataFrame, asset_id: str, algorithm_id: int | None = None) -> DataFrame:
    """All hash rows of an asset, of one recipe or of all, in order."""
    mine = hashes.where(F.col("asset_id") == asset_id)
    return (mine if algorithm_id is None else mine.where(F.col("algorithm_id") == algorithm_id)).orderBy("algorithm_id", "sequence_index")


def edges_by_project(edges: DataFrame, assets: DataFrame, threshold: float) -> DataFrame:
    """One row per undirected edge with both identities."""
    e = canonical(at_least(edges, threshold)).select(*SCOPE, "asset_id", "other_asset_id", "distance", "similarity")
    return e.join(named(assets), "asset_id").join(named(assets, "other_"), "other_asset_id")


def edges_by_assets(edges: DataFrame, assets: DataFrame, wanted: DataFrame, threshold: float) -> DataFrame:
    """Directional edges of the assets in ``wanted`` (asset_id); no wanted asset, no rows."""
    e = at_least(edges, threshold).join(wanted.select("asset_id").distinct(), "asset_id", "left_semi").select(*SCOPE, "asset_id", "other_asset_id", "distance", "similarity")
    return e.join(named(assets), "asset_id").join(named(assets, "other_"), "other_asset_id")


def match_order() -> list[Column]:
    return [F.col("similarity").desc(), F.col("other_asset_id").asc()]


def matches(edges: DataFrame, assets: DataFrame, asset_id: str, threshold: float) -> DataFrame:
    """Matches of one asset with their identities, closest first."""
    e = at_least(edges, threshold).where(F.col("asset_id") == asset_id).select(*SCOPE, "asset_id", "other_asset_id", "distance", "similarity")
    return e.join(named(assets, "other_"), "other_asset_id").orderBy(*match_order())


def ranking(edges: DataFrame, assets: DataFrame, threshold: float, id_: str | None = None, path_term: str | None = None) -> DataFrame:
    """(project, algorithm, asset, duplicate_count, identity): assets by number of matches. The count
    is taken before identities are joined; a filter keeps the assets that satisfy it."""
    counted = at_least(edges, threshold).groupBy(*SCOPE, "asset_id").agg(F.count(F.lit(1)).alias("duplicate_count"))
    return counted.join(named(assets.where(search_filter(id_, path_term))), "asset_id")


def ranking_order() -> list[Column]:
    return [F.col("duplicate_count").desc(), F.col("identity_id").asc_nulls_last(), F.col("identity_path").asc_nulls_last(), F.col("asset_id").asc()]


def top_matches(edges: DataFrame, threshold: float, limit: int) -> DataFrame:
    """The first ``limit`` matches of every asset. The window's group limit runs in each map task
    first, so an asset with very many matches sends ``limit`` rows per task and no more."""
    w = Window.partitionBy(*SCOPE, "asset_id").orderBy(*match_order())
    e = at_least(edges, threshold).select(*SCOPE, "asset_id", "other_asset_id", "distance", "similarity")
    return e.withColumn("match_no", F.row_number().over(w)).where(F.col("match_no") <= limit)


def with_matches(ranked: DataFrame, edges: DataFrame, assets: DataFrame, threshold: float, limit: int) -> DataFrame:
    """Ranked assets (a page of them, say) with an array of each one's first matches; only their edges
    are read, and duplicate_count isn't capped."""
    mine = edges.join(ranked.select(*SCOPE, "asset_id"), [*SCOPE, "asset_id"], "left_semi")
    top = top_matches(mine, threshold, limit).join(named(assets, "other_"), "other_asset_id")
    match = F.struct("match_no", scalars.identity("other_").alias("identity"), "distance", "similarity")
    lists = top.groupBy(*SCOPE, "asset_id").agg(F.transform(F.sort_array(F.collect_list(match)), lambda m: m.dropFields("match_no")).alias("matches"))
    return ranked.join(lists, [*SCOPE, "asset_id"], "left")


def ranking_with_matches(edges: DataFrame, assets: DataFrame, threshold: float, limit: int, **filters: str) -> DataFrame:
    """The whole ranking, each asset with its first ``limit`` matches."""
    return with_matches(ranking(edges, assets, threshold, **filters), edges, assets, threshold, limit)


def paged(df: DataFrame, order: list[Column], page: int, size: int) -> tuple[DataFrame, PageInfo]:
    """One page in the given total order, and its numbers; a page beyond the end is empty."""
    total = df.count()
    rows = df.orderBy(*order).offset((page - 1) * size).limit(size)
    return rows, PageInfo(total, max(0, min(size, total - (page - 1) * size)), page, size)


def head(df: DataFrame, order: list[Column], n: int) -> DataFrame:
    """The first n rows in the order, without counting them all."""
    return df.orderBy(*order).limit(n)


def every(df: DataFrame, order: list[Column]) -> DataFrame:
    """All rows in the order, as one table that is never collected here."""
    return df.orderBy(*order)


def keyset(assets: DataFrame, hashes: DataFrame, after: str | None, limit: int) -> DataFrame:
    """The next ``limit`` asset ids after ``after`` that have a hash in the scope."""
    ids = assets.select("asset_id").join(hashes.select("asset_id"), "asset_id", "left_semi")
    return (ids if after is None else ids.where(F.col("asset_id") > after)).orderBy("asset_id").limit(limit)


def cluster_summary(members: DataFrame, edges: DataFrame, threshold: float, compat_cross_algorithm: bool = False) -> DataFrame:
    """(project, algorithm, cluster, size, max_similarity). Only edges of the cluster's own algorithm
    count, unless ``compat_cross_algorithm``."""
    on = ["asset_id"] if compat_cross_algorithm else [*SCOPE, "asset_id"]
    e = at_least(edges, hashing.round_threshold(threshold)).groupBy(*on).agg(F.max("similarity").alias("similarity"))
    best = members.join(e, on).groupBy(*SCOPE, "cluster_id").agg(F.max("similarity").alias("max_similarity"))
    size = members.groupBy(*SCOPE, "cluster_id").agg(F.count(F.lit(1)).alias("size"))
    return best.join(size, [*SCOPE, "cluster_id"])


def cluster_members(members: DataFrame, edges: DataFrame, threshold: float, compat_cross_algorithm: bool = False) -> DataFrame:
    """(project, algorithm, cluster, asset, avg_similarity): a member's mean similarity over its
    edges that reach the threshold, one decimal, half up."""
    on = ["asset_id"] if compat_cross_algorithm else [*SCOPE, "asset_id"]
    e = at_least(edges, hashing.round_threshold(threshold)).select(*on, "similarity")
    # similarities have one decimal: summed in tenths, the mean doesn't depend on the order of rows
    tenths = F.sum(F.round(F.col("similarity") * 10).cast("bigint"))
    per = e.groupBy(*on).agg((tenths / F.count(F.lit(1))).alias("mean"))
    return members.join(per, on).withColumn("avg_similarity", F.floor(F.col("mean") + F.lit(0.5)) / F.lit(10.0)).drop("mean")


def matching_clusters(members: DataFrame, assets: DataFrame, id_: str | None = None, path_term: str | None = None) -> DataFrame:
    """Clusters of which one member satisfies id and path term together."""
    hits = assets.where(search_filter(id_, path_term)).select("asset_id")
    return members.join(hits, "asset_id", "left_semi").select(*SCOPE, "cluster_id").distinct()


def cluster_order() -> list[Column]:
    return [F.col("max_similarity").desc(), F.col("cluster_id").asc()]
