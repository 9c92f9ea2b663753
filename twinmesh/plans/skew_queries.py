"""Per-key results over skewed keys (problem 3), with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinmesh.operators.skew import heavy_keys, key_states
from twinmesh.session import Scratch
from twinmesh.sources.tables import plain_hash, table

HEAVY_SHARE = 0.02
PLAIN_SQL = "regexp_replace(lower(trim(hash)), '^0x', '')"


def hash_states(spark: SparkSession, root: str, scratch: Scratch) -> DataFrame:
    rows = table(spark, root, "asset_hash").select(plain_hash().alias("hash"), "asset_id", "created_at")
    return key_states(rows, "hash", "asset_id", "created_at", scratch)


def asset_states(spark: SparkSession, root: str, scratch: Scratch) -> DataFrame:
    return key_states(table(spark, root, "asset_hash_duplicate"), "asset_id", "other_asset_id", "computed_at", scratch)


def p3_found(spark: SparkSession, root: str) -> DataFrame:
    """Keys that hold at least 2 % of the rows of their table."""
    scratch = Scratch(spark, "p3")
    named = lambda states, field: heavy_keys(states, HEAVY_SHARE).select(F.lit(field).alias("field_name"), F.col("key").alias("key_value"))
    return named(hash_states(spark, root, scratch), "asset_hash.hash").unionByName(named(asset_states(spark, root, scratch), "asset_hash_duplicate.asset_id"))


P3_FOUND_SQL = f"""
SELECT 'asset_hash.hash' AS field_name, h AS key_value FROM (SELECT {PLAIN_SQL} AS h FROM asset_hash) WHERE h IS NOT NULL GROUP BY h HAVING count(*) >= 0.02 * (SELECT count(*) FROM asset_hash)
UNION ALL
SELECT 'asset_hash_duplicate.asset_id', asset_id FROM asset_hash_duplicate WHERE asset_id IS NOT NULL GROUP BY asset_id HAVING count(*) >= 0.02 * (SELECT count(*) FROM asset_hash_duplicate)"""


def p3_hash_results(spark: SparkSession, root: str) -> DataFrame:
    """For each plain hash: rows, distinct assets, first and last created_at."""
    s = hash_states(spark, root, Scratch(spark, "p3"))
    return s.select(F.col("key").alias("hash"), "n_rows", F.col("n_second").alias("n_assets"), F.col("min_value").alias("first_at"), F.col("max_value").alias("last_at"))


def p3_asset_results(spark: SparkSession, root: str) -> DataFrame:
    """For each asset: rows, distinct partners, first and last computed_at."""
    s = asset_states(spark, root, Scratch(spark, "p3"))
    return s.select(F.col("key").alias("asset_id"), "n_rows", F.col("n_second").alias("n_partners"), F.col("min_value").alias("first_at"), F.col("max_value").alias("last_at"))


def queries() -> dict:
    return {"p3_found": p3_found, "p3_hash_results": p3_hash_results, "p3_asset_results": p3_asset_results}


def oracle_sql() -> dict[str, str]:
    return {
        "p3_found": P3_FOUND_SQL,
        "p3_hash_results": f"SELECT {PLAIN_SQL} AS hash, count(*) AS n_rows, count(DISTINCT asset_id) AS n_assets, min(created_at) AS first_at, max(created_at) AS last_at FROM asset_hash GROUP BY 1",
        "p3_asset_results": "SELECT asset_id, count(*) AS n_rows, count(DISTINCT other_asset_id) AS n_partners, min(computed_at) AS first_at, max(computed_at) AS last_at FROM asset_hash_duplicate GROUP BY 1",
    }
