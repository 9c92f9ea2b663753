"""More of the registry's registered queries: lookups, counts over classes, versioned state and changes, each with
its SQL. All run over whole tables; where a query is about one scope or some assets, that is its feature."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinmesh.functions import scalars
from twinmesh.operators import exact, hamming, mutations, reads
from twinmesh.plans import queries as base
from twinmesh.plans.queries import AS_OF, AS_OF_SQL, NEAR_SQL, Base, T
from twinmesh.plans.state import EdgeState
from twinmesh.schema import EDGES
from twinmesh.session import Scratch, shared_folder

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}
#: The similarity of the Hamming queries of one recipe, and of the recipe with several frames an asset.
FRAMES, IMAGES = 4, 3


def query(sql: str, *views: str, recursive: bool = False):
    """Registers a query under its function's name, with the SQL after the cleaned views."""

    def add(f):
        _QUERIES[f.__name__] = f
        _SQL[f.__name__] = base._sql(sql, *views, recursive=recursive)
        return f

    return add


# --- lookups --------------------------------------------------------------------------------------


@query(
    """SELECT w.project_id, w.identity_id, w.identity_path, min(a.asset_id) AS asset_id FROM wanted w
LEFT JOIN asset a ON a.project_id = w.project_id AND CASE WHEN w.identity_id <> '' THEN a.identity_id = w.identity_id ELSE a.identity_path = w.identity_path END GROUP BY 1, 2, 3""",
    "wanted AS (SELECT DISTINCT project_id, identity_id, identity_path FROM shared_asset UNION SELECT DISTINCT project_id, NULL, identity_path FROM shared_asset UNION SELECT DISTINCT project_id, 'no-' || identity_id, identity_path FROM shared_asset)",
)
def identity_lookup(spark, root):
    """Assets of identities: by id where there is one, else by path; null where there is no such asset."""
    b = Base(spark, root)
    s = b.raw("shared_asset")
    no = F.concat(F.lit("no-"), F.col("identity_id"))
    wanted = s.select("project_id", "identity_id", "identity_path").unionByName(s.select("project_id", F.lit(None).cast("string").alias("identity_id"), "identity_path")).unionByName(s.select("project_id", no.alias("identity_id"), "identity_path"))
    return reads.find_assets(b.assets, wanted)


@query("SELECT asset_id, algorithm_id, sequence_index, hash_id, hash FROM hashes h WHERE EXISTS (SELECT 1 FROM asset_hash p WHERE p.hash_id % 100 = 0 AND p.asset_id = h.asset_id AND p.algorithm_id = h.algorithm_id AND p.sequence_index = h.sequence_index)")
def hash_lookup(spark, root):
    """The current hash rows at the places that the delivered rows with a hash_id divisible by 100 name."""
    b = Base(spark, root)
    places = b.raw("asset_hash").where("hash_id % 100 = 0")
    return reads.hashes_at(b.hashes, places).select("asset_id", "algorithm_id", "sequence_index", "hash_id", "hash")


@query("SELECT h.asset_id, h.algorithm_id, h.sequence_index, h.hash_id, h.hash FROM hashes h WHERE h.asset_id = (SELECT asset_id FROM hashes GROUP BY 1 ORDER BY count(*) DESC, asset_id LIMIT 1)")
def hashes_of_asset(spark, root):
    """All hash rows of the asset with the most, over all recipes."""
    b = Base(spark, root)
    most = b.hashes.groupBy("asset_id").count().orderBy(F.desc("count"), "asset_id").first()
    return reads.hashes_of(b.hashes, most.asset_id if most else "").select("asset_id", "algorithm_id", "sequence_index", "hash_id", "hash")


FIRST = "(SELECT project_id FROM projects ORDER BY slug LIMIT 1)"


@query(f"SELECT algorithm_id, asset_id, other_asset_id, distance, similarity FROM edges WHERE project_id = {FIRST} AND algorithm_id = 3")
def scope_edges(spark, root):
    """Edges of one scope: the first project by slug, image hashes."""
    b = Base(spark, root)
    first = b.projects.orderBy("slug").select("project_id").first()
    return reads.in_scope(b.edges, first and first[0], IMAGES).select("algorithm_id", "asset_id", "other_asset_id", "distance", "similarity")


@query("SELECT asset_id, sha256(identity_path) AS path_sha256, substr(m, 1, 8) || '-' || substr(m, 9, 4) || '-' || substr(m, 13, 4) || '-' || substr(m, 17, 4) || '-' || substr(m, 21, 12) AS asset_key FROM (SELECT *, md5(concat_ws(chr(1), project_id, identity_id)) AS m FROM asset)")
def asset_keys(spark, root):
    """Deterministic ids and digests of every asset's identity."""
    a = Base(spark, root).assets
    return a.select("asset_id", F.sha2("identity_path", 256).alias("path_sha256"), scalars.asset_key(F.col("project_id"), F.col("identity_id")).alias("asset_key"))


@query(
    """SELECT project_id, given[1] AS first_given, array_to_string(list_sort(list_distinct(given)), ',') AS recipes, n FROM (
  SELECT project_id, len(recipes) AS n, [trim(x) FOR x IN string_split(array_to_string(list_concat(recipes, recipes), ' ,, '), ',') IF trim(x) <> ''] AS given FROM projects)"""
)
def recipe_lists(spark, root):
    """Recipe lists read from comma-separated text, with blanks, empty parts and repeats."""
    p = Base(spark, root).projects
    given = scalars.comma_list(F.array_join(F.concat("recipes", "recipes"), " ,, "))
    return p.select("project_id", F.try_element_at(given, F.lit(1)).alias("first_given"), F.array_join(F.array_sort(scalars.deduped(given)), ",").alias("recipes"), F.size("recipes").cast("bigint").alias("n"))


@query(
    f"SELECT r.project_id, r.algorithm_id, r.asset_id, r.duplicate_count, t.match_no, t.similarity, t.distance, o.identity_id AS other_identity_id, o.identity_path AS other_identity_path FROM ranked r JOIN asset a ON a.asset_id = r.asset_id JOIN top t ON t.project_id = r.project_id AND t.algorithm_id = r.algorithm_id AND t.asset_id = r.asset_id JOIN asset o ON o.asset_id = t.other_asset_id",
    base.RANK,
    f"top AS (SELECT e.*, row_number() OVER (PARTITION BY project_id, algorithm_id, asset_id ORDER BY similarity DESC, other_asset_id) - 1 AS match_no FROM (SELECT *, row_number() OVER (PARTITION BY project_id, algorithm_id, asset_id ORDER BY similarity DESC, other_asset_id) AS rn FROM edges WHERE similarity >= {T}) e WHERE rn <= 3 AND other_asset_id IN (SELECT asset_id FROM asset))",
)
def ranking_nested_flat(spark, root):
    """The ranking with its nested matches, a row for each match."""
    b = Base(spark, root)
    nested = reads.ranking_with_matches(b.edges, b.assets, T, 3)
    flat = nested.select("project_id", "algorithm_id", "asset_id", "duplicate_count", F.posexplode("matches").alias("match_no", "m"))
    return flat.select("project_id", "algorithm_id", "asset_id", "duplicate_count", F.col("match_no").cast("bigint"), "m.similarity", "m.distance", F.col("m.identity.id").alias("other_identity_id"), F.col("m.identity.path").alias("other_identity_path"))


# --- duplicates -----------------------------------------------------------------------------------

COUNTS = "SELECT a.project_id, a.algorithm_id, a.asset_id, count(DISTINCT b.asset_id) AS duplicate_count FROM holder a JOIN holder b ON b.project_id = a.project_id AND b.algorithm_id = a.algorithm_id AND b.hash = a.hash AND b.asset_id <> a.asset_id WHERE a.algorithm_id IN ({}) GROUP BY 1, 2, 3"


@query(COUNTS.format("1, 8"))
def exact_pairs(spark, root):
    """For the recipes of one hash an asset, how many other assets share it."""
    return exact.match_counts(Base(spark, root).hashes.where("algorithm_id in (1, 8)"))


@query(COUNTS.format("2"))
def multi_hash_exact_edges(spark, root):
    """For the recipe of many hashes an asset, how many other assets share one or more, each once."""
    return exact.match_counts(Base(spark, root).hashes.where("algorithm_id = 2"))


def near_one(of: dict[int, float]) -> str:
    cases = " ".join(f"WHEN {a} THEN {t}" for a, t in of.items())
    return f"one AS (SELECT DISTINCT h.project_id, h.algorithm_id, hash, bits, CASE h.algorithm_id {cases} END AS least_similarity FROM hashes h JOIN algorithms a ON a.algorithm_id = h.algorithm_id WHERE comparison = 'hamming' AND 4 * length(hash) = bits AND h.algorithm_id IN ({', '.join(map(str, of))}))"


@query(NEAR_SQL, near_one({3: 90.0, 4: 90.0}))
def hamming_edges_90(spark, root):
    """Pairs of distinct 256-bit hashes of one project and recipe, similarity 90 or more."""
    return base._class_edges(spark, root, {3: (256, 90.0), 4: (256, 90.0)})


@query(NEAR_SQL, near_one({3: 85.0, 4: 85.0}))
def hamming_edges_85(spark, root):
    """As hamming_edges_90, at the engine's default threshold."""
    return base._class_edges(spark, root, {3: (256, 85.0), 4: (256, 85.0)})


@query(NEAR_SQL, near_one({5: 68.0, 6: 51.0}))
def text_and_audio_edges(spark, root):
    """Pairs of distinct 64-bit text hashes of similarity 68 or more, and of 2,048-bit audio hashes of 51 or more,
    which is as near as these unrelated hashes come."""
    return base._class_edges(spark, root, {5: (64, 68.0), 6: (2048, 51.0)})


@query(
    """SELECT project_id, algorithm_id, asset_id, min(distance)::INTEGER AS distance, max(similarity) AS similarity FROM (
  SELECT h.project_id, h.algorithm_id, h.asset_id, 0 AS distance, 100.0::DOUBLE AS similarity FROM frame h JOIN frames c ON c.project_id = h.project_id AND c.hash = h.hash WHERE c.low <> c.high
  UNION ALL SELECT h.project_id, h.algorithm_id, h.asset_id, n.distance, n.similarity FROM frame h JOIN both_ n ON n.project_id = h.project_id AND n.hash = h.hash JOIN frames c ON c.project_id = n.project_id AND c.hash = n.other_hash WHERE c.low <> h.asset_id OR c.high <> h.asset_id)
GROUP BY 1, 2, 3""",
    near_one({FRAMES: 95.0}),
    "near_ AS (" + NEAR_SQL + ")",
    "both_ AS (SELECT * FROM near_ UNION ALL SELECT project_id, algorithm_id, other_hash, hash, distance, similarity FROM near_)",
    f"frame AS (SELECT * FROM holder WHERE algorithm_id = {FRAMES} AND regexp_full_match(hash, '[0-9a-f]{{64}}'))",
    "frames AS (SELECT project_id, hash, min(asset_id) AS low, max(asset_id) AS high FROM frame GROUP BY 1, 2)",
)
def hamming_best_frame(spark, root):
    """For each asset of the recipe with several frames, its best frame pair with any other asset, similarity 95 or more."""
    h = Base(spark, root).hashes.where(F.col("algorithm_id") == FRAMES).where(F.col("hash").rlike("^[0-9a-f]{64}$"))
    return hamming.best_frames(h, hamming.class_edges(h, 256, 95.0, Scratch(spark, "near")))


@query(
    """SELECT project_id, algorithm_id, asset_id, other_asset_id, min(d)::INTEGER AS distance, max((2000 * (256 - d) + 256) // 512 / 10.0::DOUBLE) AS similarity FROM (
  SELECT a.project_id, a.algorithm_id, a.asset_id, b.asset_id AS other_asset_id, list_sum([bit_count(xor(('0x' || substr(a.hash, 1 + 16 * i, 16))::UBIGINT, ('0x' || substr(b.hash, 1 + 16 * i, 16))::UBIGINT))::INTEGER FOR i IN range(4)]) AS d
  FROM image a JOIN image b ON b.project_id = a.project_id AND b.asset_id <> a.asset_id WHERE a.asset_id IN (SELECT asset_id FROM wanted) OR b.asset_id IN (SELECT asset_id FROM wanted))
WHERE (2000 * (256 - d) + 256) // 512 >= 900 GROUP BY 1, 2, 3, 4""",
    f"wanted AS (SELECT asset_id FROM hashes WHERE hash_id % 100 = 0 AND algorithm_id = {IMAGES})",
    f"image AS (SELECT * FROM holder WHERE algorithm_id = {IMAGES} AND regexp_full_match(hash, '[0-9a-f]{{64}}'))",
)
def recompute_assets(spark, root):
    """The edges of the assets with an image hash whose hash_id is divisible by 100, recomputed against all assets of
    their scope, similarity 90 or more."""
    h = Base(spark, root).hashes.where(F.col("algorithm_id") == IMAGES)
    return hamming.edges_of(h, h.where("hash_id % 100 = 0").select("asset_id"), 256, 90.0)


# --- versions and changes -------------------------------------------------------------------------


@query(
    "SELECT project_id, algorithm_id, asset_id, cluster_id, 1::INTEGER AS generation FROM member",
    f"scope_ AS (SELECT project_id FROM edges WHERE algorithm_id = {IMAGES} AND project_id IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, project_id LIMIT 1)",
    base.REACH.format(where=f"similarity >= {T} AND algorithm_id = {IMAGES} AND project_id = (SELECT project_id FROM scope_) AND computed_at < {AS_OF_SQL} - INTERVAL 180 DAY"),
    recursive=True,
)
def generation_pinned_read(spark, root):
    """Clusters of the scope with most image edges as they were half a year ago: that version is stored and read, the
    newest one follows as the next generation, and the first is read again, pinned."""
    b = Base(spark, root)
    e = b.edges.where(F.col("algorithm_id") == IMAGES)
    top = e.where("project_id is not null").groupBy("project_id").count().orderBy(F.desc("count"), "project_id").first()
    project = top.project_id if top else ""
    e = exact.both_ways(e.select([f.name for f in EDGES.fields])).dropDuplicates(["project_id", "asset_id", "other_asset_id"])  # as the registry stores them
    state = EdgeState(spark, f"{shared_folder(spark)}/pinned-{uuid.uuid4().hex}")
    one = state.replace(project, IMAGES, e.where(F.col("computed_at") < F.lit(AS_OF) - F.expr("INTERVAL 180 DAYS")))
    state.clusters(project, IMAGES, T)
    state.replace(project, IMAGES, e)
    members, generation = state.clusters(project, IMAGES, T, generation=one)
    return members.select("project_id", "algorithm_id", "asset_id", "cluster_id", F.lit(generation).alias("generation"))


@query(
    """SELECT w.project_id, w.identity_id, w.identity_path, CASE WHEN i.asset_id <> p.asset_id THEN 'conflict' ELSE 'patched' END AS status FROM wanted w
JOIN (SELECT project_id, identity_id, min(asset_id) AS asset_id FROM asset WHERE identity_id <> '' GROUP BY 1, 2) i ON i.project_id = w.project_id AND i.identity_id = w.identity_id
JOIN (SELECT project_id, identity_path, min(asset_id) AS asset_id FROM asset WHERE identity_path <> '' GROUP BY 1, 2) p ON p.project_id = w.project_id AND p.identity_path = w.identity_path""",
    "wanted AS (SELECT i.project_id, identity_id, identity_path FROM (SELECT project_id, min(identity_id) AS identity_id FROM asset WHERE identity_id <> '' GROUP BY 1) i JOIN (SELECT project_id, max(identity_path) AS identity_path FROM asset WHERE identity_path <> '' GROUP BY 1) p ON p.project_id = i.project_id)",
)
def identity_conflicts(spark, root):
    """Identities whose id belongs to one asset and whose path to another, one for each project."""
    a = Base(spark, root).assets
    ids = a.where("identity_id <> ''").groupBy("project_id").agg(F.min("identity_id").alias("identity_id"))
    paths = a.where("identity_path <> ''").groupBy("project_id").agg(F.max("identity_path").alias("identity_path"))
    return mutations.patch_identities(a, ids.join(paths, "project_id")).select("project_id", "identity_id", "identity_path", "status")


@query(f"SELECT 'assets' AS tbl, count(*) AS n FROM asset WHERE project_id IS DISTINCT FROM {FIRST} UNION ALL SELECT 'hashes', count(*) FROM hashes WHERE project_id IS DISTINCT FROM {FIRST} UNION ALL SELECT 'edges', count(*) FROM edges WHERE project_id IS DISTINCT FROM {FIRST} UNION ALL SELECT 'projects', count(*) FROM projects WHERE project_id IS DISTINCT FROM {FIRST}")
def delete_project(spark, root):
    """Rows left in each table after a project was deleted with all that belongs to it."""
    b = Base(spark, root)
    first = b.projects.orderBy("slug").select("project_id").first()
    out = None
    for name, df in (("assets", b.assets), ("hashes", b.hashes), ("edges", b.edges), ("projects", b.projects)):
        n = mutations.delete_project(df, first[0] if first else "").agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("tbl"), "n")
        out = n if out is None else out.unionByName(n)
    return out


@query("SELECT recipe, 'added' AS status FROM (SELECT DISTINCT lower(trim(recipe)) AS recipe FROM core_hash_result WHERE recipe IS NOT NULL) WHERE recipe NOT IN (SELECT recipe FROM algorithms) UNION ALL SELECT recipe, 'known' FROM algorithms")
def algorithms_with_new_recipes(spark, root):
    """The catalogue with the recipes that answers name and it doesn't have inserted."""
    b = Base(spark, root)
    known = b.algorithms.select("recipe", F.lit("known").alias("status"))
    named = b.raw("core_hash_result").select(F.lower(F.trim("recipe")).alias("recipe")).where("recipe is not null").distinct().withColumn("status", F.lit("added"))
    return mutations.insert_absent(known, named, ["recipe"])


@query(
    "SELECT count(*) AS total, count(*) FILTER (error IS NULL AND status = 'created') AS created, count(*) FILTER (error IS NULL AND status = 'updated') AS updated, count(*) FILTER (error IS NULL AND status = 'unchanged') AS unchanged, count(error) AS failed FROM file_",
    base.ANSWERS,
    """file_ AS (SELECT coalesce(s.asset_id, f.asset_id) AS asset_id, s.status, f.error FROM (SELECT asset_id, CASE max(CASE status WHEN 'created' THEN 2 WHEN 'updated' THEN 1 ELSE 0 END) WHEN 2 THEN 'created' WHEN 1 THEN 'updated' ELSE 'unchanged' END AS status FROM status GROUP BY 1) s
FULL JOIN (SELECT asset_id, min(problem) AS error FROM answered WHERE problem IS NOT NULL GROUP BY 1) f ON f.asset_id = s.asset_id)""",
)
def scan_summary_with_failures(spark, root):
    """The summary of a scan in which every asset with an unusable answer failed."""
    b = Base(spark, root)
    answers = mutations.normalised_answers(b.raw("core_hash_result"), b.algorithms)
    return mutations.scan_summary(_files(b, answers))


def _files(b: Base, answers: DataFrame) -> DataFrame:
    ok = mutations.file_statuses(mutations.hash_statuses(b.hashes, answers.where("problem is null")))
    return ok.join(mutations.failures(answers), "asset_id", "full")


@query("SELECT asset_id, min(problem) AS error FROM answered WHERE problem IS NOT NULL GROUP BY 1", base.ANSWERS)
def scan_failures(spark, root):
    """The assets that failed, with the first of their problems."""
    b = Base(spark, root)
    return mutations.failures(mutations.normalised_answers(b.raw("core_hash_result"), b.algorithms))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
