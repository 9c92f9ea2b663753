"""Exact duplicates: assets that share a hash within a project and recipe.

Copies are kept as classes. A class of n assets stands for n(n-1)/2 links, of which only the n-1 to
its smallest asset are ever written as rows; so a hash that a third of all rows share costs as many rows
as it has assets. All aggregations combine before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCOPE = ["project_id", "algorithm_id"]
CLASS = [*SCOPE, "hash"]


def holders(hashes: DataFrame) -> DataFrame:
    """Distinct (project, algorithm, hash, asset): at whichever sequence index an asset has the hash.
    Rows with a null in one of them are no holders."""
    return hashes.select(*CLASS, "asset_id").dropna().distinct()


def classes(hashes: DataFrame) -> DataFrame:
    """Classes of two or more assets: hash, smallest asset, members, links between them."""
    n = F.count(F.lit(1))
    return holders(hashes).groupBy(*CLASS).agg(F.min("asset_id").alias("class_id"), n.alias("members")).where("members > 1").withColumn("links", F.expr("members * (members - 1) div 2"))


def memberships(hashes: DataFrame) -> DataFrame:
    """One row per asset and class it is in, with the class and the asset's links in it.

    The holders are joined with one row per class; a class that holds a large share of all holders is
    spread by the runtime's skew join, and classes are joined after the aggregation only."""
    of = classes(hashes).select(*CLASS, "class_id", (F.col("members") - 1).alias("links"))
    return holders(hashes).join(of, CLASS).select(*CLASS, "asset_id", "class_id", "links")


def star_edges(hashes: DataFrame) -> DataFrame:
    """Directional links of each member with its class's smallest asset, distance 0, similarity 100:
    with ``both_ways`` semantics they connect exactly what all pairs of the class connect."""
    m = memberships(hashes).where("asset_id <> class_id").select(*SCOPE, "asset_id", F.col("class_id").alias("other_asset_id")).distinct()
    return both_ways(m).withColumns({"distance": F.lit(0), "similarity": F.lit(100.0)})


def both_ways(edges: DataFrame) -> DataFrame:
    """Rows (x, y) and (y, x); other columns are kept."""
    swapped = edges.withColumns({"asset_id": F.col("other_asset_id"), "other_asset_id": F.col("asset_id")})
    return edges.unionByName(swapped.select(edges.columns))


def matches_of(hashes: DataFrame, queries: DataFrame) -> DataFrame:
    """Exact matches of the assets in ``queries`` (project, algorithm, asset): each other asset of the
    scope that shares any hash, distance 0, similarity 100, in both directions. The work follows
    the query assets and their matches."""
    have = holders(hashes)
    mine = have.join(queries.select(*SCOPE, "asset_id").distinct(), [*SCOPE, "asset_id"], "left_semi")
    other = have.select(*CLASS, F.col("asset_id").alias("other_asset_id"))
    pairs = mine.join(other, CLASS).where("asset_id <> other_asset_id").select(*SCOPE, "asset_id", "other_asset_id")
    return both_ways(pairs).distinct().withColumns({"distance": F.lit(0), "similarity": F.lit(100.0)})


def match_classes(hashes: DataFrame, queries: DataFrame) -> DataFrame:
    """Exact matches of the assets in ``queries`` (project, algorithm, asset) without a row per pair: each
    class that a query asset is in, with its smallest asset, members and the number of query assets, and one
    row per asset of the class, ``wanted`` where it is a query asset. A query asset matches all other assets of
    its class, so the rows follow the classes' sizes, however many of their assets are asked for."""
    asked = queries.select(*SCOPE, "asset_id").dropna().distinct()
    have = holders(hashes)
    # classes that a query asset is in; only their members go on
    hit = have.join(asked, [*SCOPE, "asset_id"], "left_semi").groupBy(*CLASS).agg(F.count(F.lit(1)).alias("queries"))
    mine = have.join(hit, CLASS)
    of = mine.groupBy(*CLASS).agg(F.min("asset_id").alias("class_id"), F.count(F.lit(1)).alias("members")).where("members > 1")
    out = mine.join(of, CLASS).join(asked.withColumn("asked", F.lit(True)), [*SCOPE, "asset_id"], "left")
    return out.select(*CLASS, "class_id", "members", "queries", "asset_id", F.coalesce("asked", F.lit(False)).alias("wanted"))


def match_counts(hashes: DataFrame) -> DataFrame:
    """(project, algorithm, asset, duplicate_count): how many other assets share a hash with each asset, once each.

    Assets with the same set of classes are one kind, with a count, so copies by the million are one row. A kind
    has all members of its largest class, which are counted and not looked at, and those of its other classes
    that aren't in the largest: only these are brought together, kind by kind. So a class that most assets share
    makes no pairs; kinds that share several large classes do."""
    m = memberships(hashes).select(*SCOPE, "asset_id", F.xxhash64("hash").alias("c"))
    sets = m.groupBy(*SCOPE, "asset_id").agg(F.sort_array(F.collect_set("c")).alias("set")).withColumn("kind", F.xxhash64("set"))  # an asset's own hashes
    kinds = sets.groupBy(*SCOPE, "kind").agg(F.first("set").alias("set"), F.count(F.lit(1)).alias("n"))
    of = kinds.select(*SCOPE, "kind", "n", F.explode("set").alias("c"))
    sized = of.join(of.groupBy(*SCOPE, "c").agg(F.sum("n").alias("size")), [*SCOPE, "c"])
    largest = sized.groupBy(*SCOPE, "kind").agg(F.max(F.struct("size", "c")).alias("top")).select(*SCOPE, "kind", "top.*").withColumnRenamed("c", "top")
    rest = of.select(*SCOPE, "kind", "c").join(largest, [*SCOPE, "kind"]).where("c <> top").select(*SCOPE, "kind", "c", "top")
    other = kinds.select(*SCOPE, F.col("kind").alias("other"), "n", "set", F.explode("set").alias("c"))
    outside = rest.join(other, [*SCOPE, "c"]).where(~F.array_contains("set", F.col("top"))).select(*SCOPE, "kind", "other", "n").distinct()
    more = outside.groupBy(*SCOPE, "kind").agg(F.sum("n").alias("more"))
    counts = largest.join(more, [*SCOPE, "kind"], "left").select(*SCOPE, "kind", (F.col("size") - 1 + F.coalesce("more", F.lit(0))).alias("duplicate_count"))
    return sets.join(counts, [*SCOPE, "kind"]).select(*SCOPE, "asset_id", "duplicate_count")


def stats(hashes: DataFrame, once: bool = False) -> DataFrame:
    """Per project and recipe: duplicate groups, links and assets with a duplicate.

    As the registry defines it, an asset counts once per shared hash; with ``once`` it counts once.
    Scopes without a duplicate have no row; they are zero-filled where they are read."""
    agg = classes(hashes).groupBy(*SCOPE).agg(F.count(F.lit(1)).alias("cluster_count"), F.sum("links").alias("edge_count"), F.sum("members").alias("assets_with_duplicate_count"))
    if not once:
        return agg
    each = memberships(hashes).select(*SCOPE, "asset_id").distinct().groupBy(*SCOPE).agg(F.count(F.lit(1)).alias("assets_with_duplicate_count"))
    return agg.drop("assets_with_duplicate_count").join(each, SCOPE)
