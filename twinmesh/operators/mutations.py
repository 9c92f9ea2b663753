"""Changes of the registry as pure functions from tables to tables.

A batch is applied as a whole: joins and anti-joins instead of row-at-a-time upserts. State that changes
is rewritten by scope (project, algorithm), see ``plans.state``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinmesh.functions import scalars
from twinmesh.schema import CREATED, UNCHANGED, UPDATED

SCOPE = ["project_id", "algorithm_id"]


def upsert(base: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """base with the rows of new in place of those with the same key; keys of new are unique."""
    return base.join(new.select(*key), key, "left_anti").select(base.columns).unionByName(new.select(base.columns))


def insert_absent(base: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """base and the rows of new whose key it doesn't have."""
    return base.unionByName(new.join(base.select(*key), key, "left_anti").select(base.columns))


def delete_asset_edges(edges: DataFrame, assets: DataFrame) -> DataFrame:
    """Edges without those that touch an asset of ``assets`` (algorithm_id, asset_id) on either side."""
    gone = assets.select("algorithm_id", "asset_id").distinct()
    left = edges.join(gone, ["algorithm_id", "asset_id"], "left_anti")
    return left.join(gone.withColumnRenamed("asset_id", "other_asset_id"), ["algorithm_id", "other_asset_id"], "left_anti").select(edges.columns)


def delete_scope(df: DataFrame, project_id: str, algorithm_id: int) -> DataFrame:
    """df without one scope: with state partitioned by scope, a partition is dropped."""
    return df.where(~F.coalesce((F.col("project_id") == project_id) & (F.col("algorithm_id") == algorithm_id), F.lit(False)))


def delete_project(df: DataFrame, project_id: str) -> DataFrame:
    """df without the rows of a project; rows of no project stay."""
    return df.where(~F.coalesce(F.col("project_id") == project_id, F.lit(False)))


def delete_assets(gone: DataFrame, assets: DataFrame, hashes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The tables without the assets in ``gone`` (asset_id), with everything that refers to them.
    Deleting an asset that isn't there changes nothing."""
    ids = gone.select("asset_id").distinct()
    other = ids.withColumnRenamed("asset_id", "other_asset_id")
    kept = edges.join(ids, "asset_id", "left_anti").join(other, "other_asset_id", "left_anti").select(edges.columns)
    return assets.join(ids, "asset_id", "left_anti").select(assets.columns), hashes.join(ids, "asset_id", "left_anti").select(hashes.columns), kept


def patch_identities(assets: DataFrame, batch: DataFrame) -> DataFrame:
    """What a batch of identities (project_id, identity_id, identity_path) does to the assets: one row
    per row of the batch with asset_id (null: a new asset), the identity after the patch, and status
    created, patched or conflict.

    The previous asset is found by id, else by path; if both find one and they differ, it is a
    conflict. Null keeps a field, an empty string clears it; an identity without either field is a conflict,
    too, as are two rows of one batch that touch the same asset. Several current assets with one
    identity count as the one with the smallest asset_id."""
    keyed = batch.select("project_id", "identity_id", "identity_path").withColumn("_row", F.monotonically_increasing_id())

    def found(field: str) -> DataFrame:
        have = assets.where(F.col(field).isNotNull() & (F.col(field) != ""))
        one = have.groupBy("project_id", field).agg(F.min_by(F.struct("asset_id", "identity_id", "identity_path"), "asset_id").alias(f"by_{field}"))
        return keyed.select("_row", "project_id", field).join(one, ["project_id", field]).select("_row", f"by_{field}")

    both = keyed.join(found("identity_id"), "_row", "left").join(found("identity_path"), "_row", "left")
    prev = F.coalesce("by_identity_id", "by_identity_path")
    out = both.withColumn("prev", prev)
    clash = F.coalesce(F.col("by_identity_id.asset_id") != F.col("by_identity_path.asset_id"), F.lit(False))
    new_id, new_path = scalars.patched(F.col("identity_id"), F.col("prev.identity_id")), scalars.patched(F.col("identity_path"), F.col("prev.identity_path"))
    out = out.select("_row", "project_id", F.col("prev.asset_id").alias("asset_id"), new_id.alias("identity_id"), new_path.alias("identity_path"), clash.alias("clash"))
    times = out.where("asset_id is not null").groupBy("asset_id").agg(F.count(F.lit(1)).alias("times"))
    out = out.join(times, "asset_id", "left")
    for field in ("identity_id", "identity_path"):
        again = keyed.where(F.col(field).isNotNull() & (F.col(field) != "")).groupBy("project_id", field).agg(F.count(F.lit(1)).alias(f"n_{field}"))
        twice = keyed.join(again.where(f"n_{field} > 1"), ["project_id", field]).select("_row", f"n_{field}")
        out = out.join(twice, "_row", "left")
    bad = F.col("n_identity_id").isNotNull() | F.col("n_identity_path").isNotNull() | F.col("clash") | (F.coalesce("times", F.lit(1)) > 1) | (F.col("identity_id").isNull() & F.col("identity_path").isNull())
    status = F.when(bad, F.lit("conflict")).when(F.col("asset_id").isNull(), F.lit(CREATED)).otherwise(F.lit("patched"))
    return out.select("project_id", "asset_id", "identity_id", "identity_path", status.alias("status"))


def hash_statuses(stored: DataFrame, answers: DataFrame) -> DataFrame:
    """(asset_id, algorithm_id, status) of hashing answers (asset_id, algorithm_id, hashes) against the stored
    hash rows: created where nothing is stored, unchanged where the same hashes are stored at the same
    places, else updated. A null list counts as an empty one."""
    of = ["asset_id", "algorithm_id"]
    want = answers.select(*of, F.posexplode_outer("hashes").alias("sequence_index", "want"))
    place = [*of, "sequence_index"]
    # compared place by place, so an asset's hashes are never gathered in one list
    both = want.where("sequence_index is not null").join(stored.select(*place, F.col("hash").alias("have"), F.lit(True).alias("stored")), place, "full")
    per = both.groupBy(*of).agg(F.max(F.coalesce("stored", F.lit(False))).alias("stored"), F.max(~F.col("want").eqNullSafe(F.col("have"))).alias("differs"))
    status = F.when(F.col("stored").isNull() | (~F.col("stored") & ~F.col("differs")), UNCHANGED).when(~F.col("stored"), CREATED).when(F.col("differs"), UPDATED).otherwise(UNCHANGED)
    return answers.select(*of).join(per, of, "left").select(*of, status.alias("status"))


def replace_hashes(stored: DataFrame, answers: DataFrame) -> DataFrame:
    """Stored hash rows with those of each answered (asset, algorithm) replaced; an empty list clears.
    ``answers`` has project_id, too, and one row per (asset, algorithm)."""
    kept = stored.join(answers.select("asset_id", "algorithm_id"), ["asset_id", "algorithm_id"], "left_anti").select(stored.columns)
    new = answers.select("project_id", "algorithm_id", "asset_id", F.posexplode("hashes").alias("sequence_index", "hash"))
    return kept.unionByName(new, allowMissingColumns=True)


def file_statuses(statuses: DataFrame) -> DataFrame:
    """Of the recipes of each asset, the strongest status: created, then updated, then unchanged."""
    rank = F.when(F.col("status") == CREATED, 2).when(F.col("status") == UPDATED, 1).otherwise(0)
    return statuses.groupBy("asset_id").agg(F.max(rank).alias("r")).select("asset_id", F.element_at(F.array(F.lit(UNCHANGED), F.lit(UPDATED), F.lit(CREATED)), F.col("r") + 1).alias("status"))


def failures(answers: DataFrame) -> DataFrame:
    """(asset_id, error) of ``normalised_answers``: the assets with an unusable answer, each with its first problem."""
    return answers.where("problem is not null").groupBy("asset_id").agg(F.min("problem").alias("error"))


def scan_summary(files: DataFrame) -> DataFrame:
    """total, created, updated, unchanged, failed of (asset_id, status, error): one row."""
    n = lambda s: F.count_if((F.col("status") == s) & F.col("error").isNull()).alias(s)
    return files.agg(F.count(F.lit(1)).alias("total"), n(CREATED), n(UPDATED), n(UNCHANGED), F.count("error").alias("failed"))


def normalised_answers(results: DataFrame, algorithms: DataFrame) -> DataFrame:
    """Answers of the hashing service as (asset_id, algorithm_id, hashes, problem), the latest per asset and
    recipe: recipes are compared trimmed and in lower case; problem is "vectors" where vectors came
    instead of hashes, "malformed" where neither did, "unknown recipe" where the catalogue has
    none, else null."""
    recipe = F.lower(F.trim("recipe"))
    last = results.select("asset_id", recipe.alias("recipe"), "hashes", F.col("vectors").isNotNull().alias("has_vectors"), "received_at", "result_id").where("asset_id is not null")
    best = F.max_by(F.struct("hashes", "has_vectors"), F.struct("received_at", "result_id")).alias("b")
    one = last.groupBy("asset_id", "recipe").agg(best).select("asset_id", "recipe", "b.*")
    cat = F.broadcast(algorithms.select("recipe", "algorithm_id"))
    problem = F.when(F.col("algorithm_id").isNull(), "unknown recipe").when(F.col("hashes").isNull() & F.col("has_vectors"), "vectors").when(F.col("hashes").isNull(), "malformed")
    return one.join(cat, "recipe", "left").select("asset_id", "algorithm_id", "hashes", problem.alias("problem"))
