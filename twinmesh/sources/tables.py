"""The registry's tables as delivered, and the cleaned views the operators work on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A base table of the data folder."""
    return spark.read.parquet(f"{root}/{name}.parquet")


def plain_hash(col: Column | str = "hash") -> Column:
    """A hash trimmed, in lower case, without a leading 0x; null stays null."""
    return F.regexp_replace(F.lower(F.trim(col)), "^0x", "")


def usable_edge() -> Column:
    """Similarity neither null nor NaN and within 0 to 100, and two different assets."""
    s = F.col("similarity")
    return s.isNotNull() & ~F.isnan(s) & s.between(0.0, 100.0) & (F.col("asset_id") != F.col("other_asset_id")) & F.col("algorithm_id").isNotNull()


def current_edges(edges: DataFrame) -> DataFrame:
    """Of the usable rows with the same (algorithm_id, asset_id, other_asset_id), the latest by
    computed_at, then edge_id; a null computed_at is older than any other.

    The aggregation is keyed on the pair, so an asset that holds a tenth of all rows still
    spreads over every partition, and repeated deliveries are combined before the shuffle."""
    last = F.max(F.struct("computed_at", "edge_id", "distance", "similarity", "project_id")).alias("last")
    return (
        edges.where(usable_edge())
        .groupBy("algorithm_id", "asset_id", "other_asset_id")
        .agg(last)
        .select("last.project_id", "algorithm_id", "asset_id", "other_asset_id", "last.distance", "last.similarity", "last.computed_at", "last.edge_id")
    )


def current_assets(assets: DataFrame) -> DataFrame:
    """One row per asset_id: the latest by updated_at, then created_at, identity_id, identity_path; nulls are
    older than any value. Repeated rows are combined before the shuffle."""
    order = ["updated_at", "created_at", "identity_id", "identity_path", "project_id"]
    rest = [c for c in assets.columns if c not in (*order, "asset_id")]
    last = assets.where(F.col("asset_id").isNotNull()).groupBy("asset_id").agg(F.max(F.struct(*order, *rest)).alias("last"))
    return last.select(*[F.col("asset_id") if c == "asset_id" else F.col(f"last.{c}") for c in assets.columns])


def current_hashes(hashes: DataFrame) -> DataFrame:
    """One row per (asset_id, algorithm_id, sequence_index), the latest by updated_at, then hash_id,
    with the plain hash; rows whose plain hash is empty or not hexadecimal are rejected."""
    plain = hashes.withColumn("hash", plain_hash()).where(F.col("hash").rlike("^[0-9a-f]+$") & F.col("asset_id").isNotNull())
    place, order = ["asset_id", "algorithm_id", "sequence_index"], ["updated_at", "hash_id"]
    rest = [c for c in plain.columns if c not in (*order, *place)]
    last = plain.groupBy(*place).agg(F.max(F.struct(*order, *rest)).alias("last"))
    return last.select(*[F.col(c) if c in place else F.col(f"last.{c}") for c in plain.columns])
