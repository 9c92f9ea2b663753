"""The registry's registered queries over the test tables, each with its SQL where SQL can run it on whole
tables. Thresholds and dates are fixed parameters; nothing is sampled or cut."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinmesh.functions import hashing, scalars
from twinmesh.operators import exact, hamming, mutations, reads, statistics
from twinmesh.operators.components import components
from twinmesh.session import Scratch
from twinmesh.sources.tables import current_assets, current_edges, current_hashes, plain_hash, table

DEFAULT_THRESHOLD = 85.0
T = 90.0
AS_OF = dt.datetime(2026, 4, 1, tzinfo=dt.timezone.utc)
PATH_TERM = "*/scans/*"
ID_WANTED = "SHARED-00"

#: SQL of the cleaned views.
BASE = """
edges AS (SELECT * EXCLUDE (rn) FROM (
  SELECT *, row_number() OVER (PARTITION BY algorithm_id, asset_id, other_asset_id ORDER BY computed_at DESC NULLS LAST, edge_id DESC NULLS LAST) AS rn FROM asset_hash_duplicate
  WHERE similarity IS NOT NULL AND NOT isnan(similarity) AND similarity BETWEEN 0 AND 100 AND asset_id <> other_asset_id AND algorithm_id IS NOT NULL) WHERE rn = 1),
asset AS (SELECT * EXCLUDE (rn) FROM (
  SELECT *, row_number() OVER (PARTITION BY asset_id ORDER BY updated_at DESC NULLS LAST, created_at DESC NULLS LAST, identity_id DESC NULLS LAST, identity_path DESC NULLS LAST, project_id DESC NULLS LAST) AS rn FROM assets
  WHERE asset_id IS NOT NULL) WHERE rn = 1),
hashes AS (SELECT * EXCLUDE (rn) FROM (
  SELECT *, row_number() OVER (PARTITION BY asset_id, algorithm_id, sequence_index ORDER BY updated_at DESC NULLS LAST, hash_id DESC NULLS LAST) AS rn FROM (
    SELECT * EXCLUDE (hash), regexp_replace(lower(trim(hash)), '^0x', '') AS hash FROM asset_hash) WHERE regexp_full_match(hash, '[0-9a-f]+') AND asset_id IS NOT NULL) WHERE rn = 1),
holder AS (SELECT DISTINCT project_id, algorithm_id, hash, asset_id FROM hashes WHERE project_id IS NOT NULL AND algorithm_id IS NOT NULL),
class AS (SELECT project_id, algorithm_id, hash, min(asset_id) AS class_id, count(*) AS members, count(*) * (count(*) - 1) // 2 AS links FROM holder GROUP BY 1, 2, 3 HAVING count(*) > 1)"""

REACH = """
link AS (SELECT DISTINCT project_id, algorithm_id, asset_id AS x, other_asset_id AS y FROM edges WHERE {where} UNION SELECT DISTINCT project_id, algorithm_id, other_asset_id, asset_id FROM edges WHERE {where}),
reach AS (SELECT project_id, algorithm_id, x, x AS y FROM link UNION SELECT r.project_id, r.algorithm_id, r.x, l.y FROM reach r JOIN link l ON r.project_id = l.project_id AND r.algorithm_id = l.algorithm_id AND r.y = l.x),
member AS (SELECT project_id, algorithm_id, x AS asset_id, min(y) AS cluster_id FROM reach GROUP BY 1, 2, 3)"""
AT_T = REACH.format(where=f"similarity >= {T}")

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def _sql(body: str, *views: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join([BASE, *views]) + "\n" + body


def query(sql: str | None = None, *views: str, recursive: bool = False):
    """Registers a query under its function's name, with the SQL after the cleaned views."""

    def add(f):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = _sql(sql, *views, recursive=recursive)
        return f

    return add


class Base:
    """The tables of a data folder, cleaned."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.raw = lambda name: table(spark, root, name)

    @property
    def edges(self) -> DataFrame:
        return current_edges(self.raw("asset_hash_duplicate"))

    @property
    def assets(self) -> DataFrame:
        return current_assets(self.raw("assets"))

    @property
    def hashes(self) -> DataFrame:
        return current_hashes(self.raw("asset_hash"))

    @property
    def algorithms(self) -> DataFrame:
        return self.raw("algorithms")

    @property
    def projects(self) -> DataFrame:
        return self.raw("projects")


def _members(b: Base, spark: SparkSession, name: str) -> DataFrame:
    return components(reads.at_least(b.edges, T), ["project_id", "algorithm_id"], Scratch(spark, name))


# --- cleaned tables -------------------------------------------------------------------------------


@query("SELECT project_id, algorithm_id, asset_id, other_asset_id, distance, similarity, computed_at, edge_id FROM edges")
def latest_edges(spark, root):
    """Usable edges, the latest version of each."""
    return Base(spark, root).edges


@query("SELECT asset_id, project_id, identity_id, identity_path, created_at, updated_at FROM asset")
def latest_assets(spark, root):
    return Base(spark, root).assets


@query("SELECT hash_id, project_id, algorithm_id, asset_id, sequence_index, hash FROM hashes")
def valid_hashes(spark, root):
    """Plain hexadecimal hashes, the latest of each place."""
    return Base(spark, root).hashes.select("hash_id", "project_id", "algorithm_id", "asset_id", "sequence_index", "hash")


@query("""SELECT h.algorithm_id, count(*) AS n_rows, count(*) FILTER (hash IS NULL OR plain = '') AS n_empty, count(*) FILTER (hash IS NOT NULL AND plain <> '' AND NOT regexp_full_match(plain, '[0-9a-f]+')) AS n_not_hex,
  count(*) FILTER (regexp_full_match(plain, '[0-9a-f]+') AND 4 * length(plain) <> bits) AS n_wrong_length
FROM (SELECT *, regexp_replace(lower(trim(hash)), '^0x', '') AS plain FROM asset_hash) h JOIN algorithms a ON a.algorithm_id = h.algorithm_id GROUP BY h.algorithm_id""")
def hash_validation(spark, root):
    """Rows per recipe whose hash can't be compared, and why."""
    b = Base(spark, root)
    h = b.raw("asset_hash").select("algorithm_id", plain_hash().alias("plain")).join(F.broadcast(b.algorithms.select("algorithm_id", "bits")), "algorithm_id")
    hexa = F.col("plain").rlike("^[0-9a-f]+$")
    empty = F.col("plain").isNull() | (F.col("plain") == "")
    return h.groupBy("algorithm_id").agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(empty).alias("n_empty"), F.count_if(~empty & ~hexa).alias("n_not_hex"), F.count_if(hexa & (4 * F.length("plain") != F.col("bits"))).alias("n_wrong_length"))


@query("""SELECT DISTINCT e.algorithm_id, distance, (2000 * (bits - distance) + bits) // (2 * bits) / 10.0::DOUBLE AS score
FROM edges e JOIN algorithms a ON a.algorithm_id = e.algorithm_id WHERE bits IS NOT NULL AND distance BETWEEN 0 AND bits""")
def similarity_scores(spark, root):
    """The score of every distance that occurs, recomputed in integers."""
    b = Base(spark, root)
    e = b.edges.select("algorithm_id", "distance").join(F.broadcast(b.algorithms.select("algorithm_id", "bits")), "algorithm_id").where("bits is not null and distance between 0 and bits")
    return e.distinct().select("algorithm_id", "distance", hashing.similarity(F.col("distance"), F.col("bits")).alias("score"))


# --- exact and near duplicates --------------------------------------------------------------------


@query("SELECT project_id, algorithm_id, hash, class_id, members, links FROM class")
def exact_classes(spark, root):
    return exact.classes(Base(spark, root).hashes)


@query("SELECT h.project_id, h.algorithm_id, h.hash, h.asset_id, c.class_id, c.members - 1 AS links FROM holder h JOIN class c ON c.project_id = h.project_id AND c.algorithm_id = h.algorithm_id AND c.hash = h.hash")
def exact_memberships(spark, root):
    """One row per asset and class, with the asset's links in it."""
    return exact.memberships(Base(spark, root).hashes)


@query("""SELECT project_id, algorithm_id, asset_id, other_asset_id, 0::INTEGER AS distance, 100.0::DOUBLE AS similarity FROM star UNION ALL SELECT project_id, algorithm_id, other_asset_id, asset_id, 0::INTEGER, 100.0::DOUBLE FROM star""",
       "star AS (SELECT DISTINCT h.project_id, h.algorithm_id, h.asset_id, c.class_id AS other_asset_id FROM holder h JOIN class c ON c.project_id = h.project_id AND c.algorithm_id = h.algorithm_id AND c.hash = h.hash WHERE h.asset_id <> c.class_id)")
def exact_star_edges(spark, root):
    return exact.star_edges(Base(spark, root).hashes)


@query("SELECT project_id, algorithm_id, count(*) AS cluster_count, sum(links)::BIGINT AS edge_count, sum(members)::BIGINT AS assets_with_duplicate_count FROM class GROUP BY 1, 2")
def exact_stats(spark, root):
    return exact.stats(Base(spark, root).hashes)


@query("""SELECT c.project_id, c.algorithm_id, count(*) AS cluster_count, sum(links)::BIGINT AS edge_count, any_value(n) AS assets_with_duplicate_count FROM class c JOIN each_ e ON e.project_id = c.project_id AND e.algorithm_id = c.algorithm_id GROUP BY 1, 2""",
       "each_ AS (SELECT h.project_id, h.algorithm_id, count(DISTINCT h.asset_id) AS n FROM holder h JOIN class c ON c.project_id = h.project_id AND c.algorithm_id = h.algorithm_id AND c.hash = h.hash GROUP BY 1, 2)")
def exact_stats_once(spark, root):
    """As exact_stats, each asset counted once."""
    return exact.stats(Base(spark, root).hashes, once=True)


@query("""SELECT DISTINCT project_id, algorithm_id, asset_id, other_asset_id, 0::INTEGER AS distance, 100.0::DOUBLE AS similarity FROM (SELECT * FROM pair UNION ALL SELECT project_id, algorithm_id, other_asset_id, asset_id FROM pair)""",
       """wanted AS (SELECT DISTINCT project_id, algorithm_id, asset_id FROM hashes WHERE hash_id % 100 = 0 AND algorithm_id = 1),
pair AS (SELECT a.project_id, a.algorithm_id, a.asset_id, b.asset_id AS other_asset_id FROM holder a JOIN wanted w ON w.project_id = a.project_id AND w.algorithm_id = a.algorithm_id AND w.asset_id = a.asset_id
  JOIN holder b ON b.project_id = a.project_id AND b.algorithm_id = a.algorithm_id AND b.hash = a.hash AND a.asset_id <> b.asset_id)""")  # fmt: skip
def exact_matches(spark, root):
    """Exact matches of the binary hashes whose hash_id is divisible by 100, against all rows."""
    h = Base(spark, root).hashes
    return exact.matches_of(h, h.where("hash_id % 100 = 0 and algorithm_id = 1"))


@query("SELECT h.project_id, h.algorithm_id, h.hash, c.class_id, c.members, c.queries, h.asset_id, w.asset_id IS NOT NULL AS wanted FROM holder h JOIN hit c ON c.project_id = h.project_id AND c.algorithm_id = h.algorithm_id AND c.hash = h.hash LEFT JOIN wanted w ON w.project_id = h.project_id AND w.algorithm_id = h.algorithm_id AND w.asset_id = h.asset_id WHERE h.algorithm_id IN (SELECT algorithm_id FROM algorithms WHERE comparison = 'exact')",
       "wanted AS (SELECT DISTINCT project_id, algorithm_id, asset_id FROM hashes WHERE hash_id % 100 = 0 AND algorithm_id IN (SELECT algorithm_id FROM algorithms WHERE comparison = 'exact'))",
       """hit AS (SELECT c.project_id, c.algorithm_id, c.hash, c.class_id, c.members, count(*) AS queries FROM class c JOIN holder h ON h.project_id = c.project_id AND h.algorithm_id = c.algorithm_id AND h.hash = c.hash
  JOIN wanted w ON w.project_id = h.project_id AND w.algorithm_id = h.algorithm_id AND w.asset_id = h.asset_id GROUP BY 1, 2, 3, 4, 5)""")  # fmt: skip
def exact_match_classes(spark, root):
    """Exact matches of the hashes of all exact recipes whose hash_id is divisible by 100, against all rows,
    as classes and their members."""
    b = Base(spark, root)
    h = b.hashes.join(F.broadcast(b.algorithms.where("comparison = 'exact'").select("algorithm_id")), "algorithm_id", "left_semi")
    return exact.match_classes(h, h.where("hash_id % 100 = 0"))


NEAR_SQL = """
SELECT a.project_id, a.algorithm_id, a.hash, b.hash AS other_hash, d.distance::INTEGER AS distance, (2000 * (a.bits - d.distance) + a.bits) // (2 * a.bits) / 10.0::DOUBLE AS similarity
FROM one a JOIN one b ON a.project_id = b.project_id AND a.algorithm_id = b.algorithm_id AND a.hash < b.hash AND length(a.hash) = length(b.hash),
LATERAL (SELECT list_sum([bit_count(xor(('0x' || substr(a.hash, 1 + 16 * i, 16))::UBIGINT, ('0x' || substr(b.hash, 1 + 16 * i, 16))::UBIGINT))::INTEGER FOR i IN range(length(a.hash) // 16)]) AS distance) d
WHERE (2000 * (a.bits - d.distance) + a.bits) // (2 * a.bits) >= 10 * a.least_similarity"""
NEAR_ONE = "one AS (SELECT DISTINCT h.project_id, h.algorithm_id, hash, bits, CASE WHEN h.algorithm_id = 6 THEN 98 ELSE 95 END AS least_similarity FROM hashes h JOIN algorithms a ON a.algorithm_id = h.algorithm_id WHERE comparison = 'hamming' AND 4 * length(hash) = bits AND h.algorithm_id IN ({}))"


def _class_edges(spark, root, of: dict[int, tuple[int, float]]) -> DataFrame:
    h = Base(spark, root).hashes
    out = None
    for bits, threshold in dict.fromkeys(of.values()):  # recipes of the same length and threshold go together
        same = [algorithm for algorithm, x in of.items() if x == (bits, threshold)]
        e = hamming.class_edges(h.where(F.col("algorithm_id").isin(same)), bits, threshold, Scratch(spark, "near"))
        out = e if out is None else out.unionByName(e)
    return out


@query(NEAR_SQL, NEAR_ONE.format("3, 4"))
def hamming_class_edges(spark, root):
    """Pairs of distinct 256-bit hashes of one project and recipe, similarity 95 or more."""
    return _class_edges(spark, root, {3: (256, 95.0), 4: (256, 95.0)})


@query(NEAR_SQL, NEAR_ONE.format("5"))
def simhash_class_edges(spark, root):
    """Pairs of distinct 64-bit hashes, similarity 95 or more."""
    return _class_edges(spark, root, {5: (64, 95.0)})


@query(NEAR_SQL, NEAR_ONE.format("6"))
def audio_class_edges(spark, root):
    """Pairs of distinct 2,048-bit hashes, similarity 98 or more."""
    return _class_edges(spark, root, {6: (2048, 98.0)})


@query(NEAR_SQL, f"goal AS (SELECT DISTINCT project_id, floor(coalesce(hamming_threshold, {DEFAULT_THRESHOLD})::DOUBLE * 10 + 0.5) / 10 AS least_similarity FROM projects)",
       "one AS (SELECT DISTINCT h.project_id, h.algorithm_id, hash, bits, least_similarity FROM hashes h JOIN algorithms a ON a.algorithm_id = h.algorithm_id JOIN goal g ON g.project_id = h.project_id WHERE comparison = 'hamming' AND 4 * length(hash) = bits)")
def project_class_edges(spark, root):
    """Pairs of distinct hashes of all Hamming recipes at each project's effective threshold."""
    b = Base(spark, root)
    return hamming.project_edges(b.hashes, b.algorithms, b.projects, DEFAULT_THRESHOLD, Scratch(spark, "near"))


@query("""SELECT project_id, algorithm_id, asset_id, other_asset_id, min(distance)::INTEGER AS distance, max(similarity) AS similarity FROM (
  SELECT p.project_id, p.algorithm_id, a.asset_id, b.asset_id AS other_asset_id, p.distance, p.similarity FROM both_ p JOIN holder a ON a.project_id = p.project_id AND a.algorithm_id = p.algorithm_id AND a.hash = p.hash JOIN holder b ON b.project_id = p.project_id AND b.algorithm_id = p.algorithm_id AND b.hash = p.other_hash
  UNION ALL SELECT a.project_id, a.algorithm_id, a.asset_id, b.asset_id, 0, 100.0 FROM holder a JOIN holder b ON a.project_id = b.project_id AND a.algorithm_id = b.algorithm_id AND a.hash = b.hash WHERE a.algorithm_id = 3 AND regexp_full_match(a.hash, '[0-9a-f]{64}'))
WHERE asset_id <> other_asset_id GROUP BY 1, 2, 3, 4""", NEAR_ONE.format("3"), "near_ AS (" + NEAR_SQL + ")", "both_ AS (SELECT * FROM near_ UNION ALL SELECT project_id, algorithm_id, other_hash, hash, distance, similarity FROM near_)")  # fmt: skip
def hamming_edges(spark, root):
    """Directional edges of assets by image.phash16, best frame pair, similarity 95 or more."""
    h = Base(spark, root).hashes.where(F.col("algorithm_id") == 3).where(F.col("hash").rlike("^[0-9a-f]{64}$"))
    return hamming.asset_edges(h, hamming.class_edges(h, 256, 95.0, Scratch(spark, "near")))


# --- reads ----------------------------------------------------------------------------------------

NAMES = "a.identity_id, a.identity_path, o.identity_id AS other_identity_id, o.identity_path AS other_identity_path"
EDGE_JOIN = "FROM edges e JOIN asset a ON a.asset_id = e.asset_id JOIN asset o ON o.asset_id = e.other_asset_id"


@query(f"SELECT e.project_id, e.algorithm_id, e.asset_id, e.other_asset_id, e.distance, e.similarity, {NAMES} {EDGE_JOIN} WHERE e.similarity >= {T} AND e.asset_id < e.other_asset_id")
def edges_by_project(spark, root):
    b = Base(spark, root)
    return reads.edges_by_project(b.edges, b.assets, T)


@query(f"SELECT e.project_id, e.algorithm_id, e.asset_id, e.other_asset_id, e.distance, e.similarity, {NAMES} {EDGE_JOIN} WHERE e.similarity >= {T} AND e.asset_id IN (SELECT asset_id FROM shared_asset)")
def edges_by_assets(spark, root):
    """Edges of the shared templates."""
    b = Base(spark, root)
    return reads.edges_by_assets(b.edges, b.assets, b.raw("shared_asset"), T)


def _busiest(b: Base) -> str | None:
    row = b.edges.where(F.col("similarity") >= T).groupBy("asset_id").count().orderBy(F.desc("count"), "asset_id").first()
    return row and row.asset_id


BUSIEST = f"busiest AS (SELECT asset_id FROM edges WHERE similarity >= {T} GROUP BY 1 ORDER BY count(*) DESC, asset_id LIMIT 1)"


@query(f"SELECT e.project_id, e.algorithm_id, e.asset_id, e.other_asset_id, e.distance, e.similarity, o.identity_id AS other_identity_id, o.identity_path AS other_identity_path FROM edges e JOIN asset o ON o.asset_id = e.other_asset_id WHERE e.similarity >= {T} AND e.asset_id = (SELECT asset_id FROM busiest)", BUSIEST)
def matches(spark, root):
    """All matches of the asset with the most."""
    b = Base(spark, root)
    return reads.matches(b.edges, b.assets, _busiest(b) or "", T)


@query(f"SELECT e.other_asset_id, e.algorithm_id, e.similarity FROM edges e JOIN asset o ON o.asset_id = e.other_asset_id WHERE e.similarity >= {T} AND e.asset_id = (SELECT asset_id FROM busiest) ORDER BY e.similarity DESC, e.other_asset_id, e.algorithm_id LIMIT 20 OFFSET 20", BUSIEST)
def matches_page(spark, root):
    """The second page of 20 of these matches."""
    b = Base(spark, root)
    m = reads.matches(b.edges, b.assets, _busiest(b) or "", T).select("other_asset_id", "algorithm_id", "similarity")
    return reads.paged(m, [*reads.match_order(), F.col("algorithm_id").asc()], 2, 20)[0]


RANK = f"ranked AS (SELECT e.project_id, e.algorithm_id, e.asset_id, count(*) AS duplicate_count FROM edges e WHERE similarity >= {T} GROUP BY 1, 2, 3)"
RANK_SQL = "SELECT r.project_id, r.algorithm_id, r.asset_id, duplicate_count, identity_id, identity_path FROM ranked r JOIN asset a ON a.asset_id = r.asset_id"


@query(RANK_SQL, RANK)
def ranking(spark, root):
    b = Base(spark, root)
    return reads.ranking(b.edges, b.assets, T)


@query(RANK_SQL + f" WHERE identity_id = '{ID_WANTED}'", RANK)
def ranking_filtered_id(spark, root):
    b = Base(spark, root)
    return reads.ranking(b.edges, b.assets, T, id_=ID_WANTED)


@query(RANK_SQL + " WHERE identity_path ILIKE '%/scans/%'", RANK)
def ranking_filtered_path(spark, root):
    b = Base(spark, root)
    return reads.ranking(b.edges, b.assets, T, path_term=PATH_TERM)


@query(RANK_SQL + " ORDER BY duplicate_count DESC, identity_id NULLS LAST, identity_path NULLS LAST, r.asset_id, r.algorithm_id LIMIT 20", RANK)
def ranking_page(spark, root):
    """The first page of the ranking over all scopes."""
    b = Base(spark, root)
    return reads.paged(reads.ranking(b.edges, b.assets, T), [*reads.ranking_order(), F.col("algorithm_id").asc()], 1, 20)[0]


@query(f"SELECT project_id, algorithm_id, asset_id, other_asset_id, distance, similarity, match_no::INTEGER AS match_no FROM (SELECT *, row_number() OVER (PARTITION BY project_id, algorithm_id, asset_id ORDER BY similarity DESC, other_asset_id) AS match_no FROM edges WHERE similarity >= {T}) WHERE match_no <= 3")
def ranking_topk(spark, root):
    """The first three matches of every ranked asset, flat."""
    return reads.top_matches(Base(spark, root).edges, T, 3)


@query()
def ranking_nested(spark, root):
    """The ranking with its nested matches."""
    b = Base(spark, root)
    return reads.ranking_with_matches(b.edges, b.assets, T, 3)


@query(f"SELECT project_id, algorithm_id, count(DISTINCT asset_id) AS ranked_assets FROM edges WHERE similarity >= {T} GROUP BY 1, 2")
def ranking_count(spark, root):
    return statistics.ranked_counts(Base(spark, root).edges, T)


@query(f"SELECT project_id, algorithm_id, count(*) AS edge_count FROM edges WHERE similarity >= {T} AND asset_id < other_asset_id GROUP BY 1, 2")
def edge_count(spark, root):
    return statistics.edge_counts(Base(spark, root).edges, T)


@query("SELECT project_id, count(*) AS duplicate_pairs FROM edges WHERE asset_id < other_asset_id GROUP BY 1")
def pair_count_by_project(spark, root):
    return statistics.pairs_per_project(Base(spark, root).edges)


@query("SELECT asset_id FROM asset WHERE asset_id > '8' AND asset_id IN (SELECT asset_id FROM hashes WHERE algorithm_id = 3) ORDER BY asset_id LIMIT 200")
def assets_with_hash_keyset(spark, root):
    """A keyset page of 200 assets with an image hash."""
    b = Base(spark, root)
    return reads.keyset(b.assets, b.hashes.where("algorithm_id = 3"), "8", 200)


@query("SELECT asset_id, project_id, identity_id, identity_path FROM asset WHERE identity_path ILIKE '%/scans/%'")
def path_search(spark, root):
    return Base(spark, root).assets.where(reads.search_filter(path_term=PATH_TERM)).select("asset_id", "project_id", "identity_id", "identity_path")


@query("SELECT asset_id, concat_ws(', ', 'id=' || identity_id, 'path=' || identity_path) AS identity, CASE WHEN regexp_extract(identity_path, '\\.([^./]+)$', 1) <> '' THEN lower(regexp_extract(identity_path, '\\.([^./]+)$', 1)) END AS mime_hint FROM asset")
def identities(spark, root):
    """The printed identity and the mime hint of every asset."""
    return Base(spark, root).assets.select("asset_id", scalars.identity_text(F.col("identity_id"), F.col("identity_path")).alias("identity"), scalars.mime_hint(F.col("identity_path")).alias("mime_hint"))


# --- clusters -------------------------------------------------------------------------------------


@query("SELECT * FROM member", AT_T, recursive=True)
def clusters_membership(spark, root):
    return _members(Base(spark, root), spark, "clusters")


SUMMARY = f"best AS (SELECT m.project_id, m.algorithm_id, m.cluster_id, max(similarity) AS max_similarity FROM member m JOIN edges e ON e.project_id = m.project_id AND e.algorithm_id = m.algorithm_id AND e.asset_id = m.asset_id AND e.similarity >= {T} GROUP BY 1, 2, 3), size_ AS (SELECT project_id, algorithm_id, cluster_id, count(*) AS size FROM member GROUP BY 1, 2, 3), summary AS (SELECT * FROM best JOIN size_ USING (project_id, algorithm_id, cluster_id))"


@query("SELECT * FROM summary", AT_T, SUMMARY, recursive=True)
def clusters_summary(spark, root):
    b = Base(spark, root)
    return reads.cluster_summary(_members(b, spark, "clusters"), b.edges, T)


@query("SELECT * FROM summary ORDER BY max_similarity DESC, cluster_id, algorithm_id LIMIT 20", AT_T, SUMMARY, recursive=True)
def clusters_page(spark, root):
    b = Base(spark, root)
    return reads.paged(reads.cluster_summary(_members(b, spark, "clusters"), b.edges, T), [*reads.cluster_order(), F.col("algorithm_id").asc()], 1, 20)[0]


@query(f"SELECT m.project_id, m.algorithm_id, m.cluster_id, m.asset_id, floor(sum(round(similarity * 10)::BIGINT) / count(*) + 0.5) / 10.0::DOUBLE AS avg_similarity FROM member m JOIN edges e ON e.project_id = m.project_id AND e.algorithm_id = m.algorithm_id AND e.asset_id = m.asset_id AND e.similarity >= {T} GROUP BY 1, 2, 3, 4", AT_T, recursive=True)
def clusters_members(spark, root):
    """Members with their mean similarity."""
    b = Base(spark, root)
    return reads.cluster_members(_members(b, spark, "clusters"), b.edges, T)


@query(f"SELECT m.project_id, m.algorithm_id, m.cluster_id, m.asset_id, floor(sum(round(similarity * 10)::BIGINT) / count(*) + 0.5) / 10.0::DOUBLE AS avg_similarity FROM member m JOIN edges e ON e.asset_id = m.asset_id AND e.similarity >= {T} GROUP BY 1, 2, 3, 4", AT_T, recursive=True)
def clusters_members_compat(spark, root):
    """As clusters_members, with edges of all recipes counted."""
    b = Base(spark, root)
    return reads.cluster_members(_members(b, spark, "clusters"), b.edges, T, compat_cross_algorithm=True)


FILTERED = "SELECT DISTINCT m.project_id, m.algorithm_id, m.cluster_id FROM member m JOIN asset a ON a.asset_id = m.asset_id WHERE "


@query(FILTERED + f"identity_id = '{ID_WANTED}'", AT_T, recursive=True)
def clusters_filtered(spark, root):
    b = Base(spark, root)
    return reads.matching_clusters(_members(b, spark, "clusters"), b.assets, id_=ID_WANTED)


@query(FILTERED + "identity_path ILIKE '%/scans/%'", AT_T, recursive=True)
def clusters_filtered_path(spark, root):
    b = Base(spark, root)
    return reads.matching_clusters(_members(b, spark, "clusters"), b.assets, path_term=PATH_TERM)


@query("SELECT project_id, algorithm_id, count(DISTINCT cluster_id) AS cluster_count, count(*) AS member_count FROM member GROUP BY 1, 2", AT_T, recursive=True)
def cluster_stats(spark, root):
    return _members(Base(spark, root), spark, "clusters").groupBy("project_id", "algorithm_id").agg(F.countDistinct("cluster_id").alias("cluster_count"), F.count(F.lit(1)).alias("member_count"))


# --- statistics -----------------------------------------------------------------------------------


@query("SELECT project_id, recipe, count(DISTINCT asset_id) AS asset_count FROM hashes JOIN algorithms USING (algorithm_id) GROUP BY 1, 2")
def assets_per_recipe(spark, root):
    b = Base(spark, root)
    return statistics.assets_per_recipe(b.hashes, b.algorithms)


@query("SELECT DISTINCT asset_id, recipe FROM hashes JOIN algorithms USING (algorithm_id)")
def recipes_of_asset(spark, root):
    b = Base(spark, root)
    return statistics.recipes_of_assets(b.hashes, b.algorithms)


@query("SELECT project_id, count(*) AS assets FROM asset GROUP BY 1")
def asset_count(spark, root):
    return statistics.assets_per_project(Base(spark, root).assets)


AS_OF_SQL = f"TIMESTAMPTZ '{AS_OF:%Y-%m-%d %H:%M:%S}+00'"


@query(f"SELECT p.project_id, max(created_at) AS last_added_at, count(*) FILTER (created_at >= {AS_OF_SQL} - INTERVAL 7 DAY) AS added_last_7d, count(*) FILTER (created_at >= {AS_OF_SQL} - INTERVAL 30 DAY) AS added_last_30d FROM projects p LEFT JOIN asset a ON a.project_id = p.project_id GROUP BY 1")
def activity_summary(spark, root):
    """Activity per project as of 1 April 2026."""
    b = Base(spark, root)
    return statistics.activity(b.assets, b.projects, AS_OF)


@query("""SELECT slug, name, coalesce(a.n, 0) AS assets, coalesce(e.n, 0) AS duplicate_pairs FROM projects p LEFT JOIN (SELECT project_id, count(*) AS n FROM asset GROUP BY 1) a ON a.project_id = p.project_id
LEFT JOIN (SELECT project_id, count(*) AS n FROM edges WHERE asset_id < other_asset_id GROUP BY 1) e ON e.project_id = p.project_id""")
def project_overview(spark, root):
    b = Base(spark, root)
    return statistics.overview(b.projects, b.assets, b.edges)


LIMITS = f"bound AS (SELECT project_id, floor(coalesce(hamming_threshold, {DEFAULT_THRESHOLD})::DOUBLE * 10 + 0.5) / 10 AS threshold FROM projects), over_ AS (SELECT e.* FROM edges e JOIN bound b ON b.project_id = e.project_id AND e.similarity >= b.threshold)"


@query("SELECT project_id, threshold FROM bound", LIMITS)
def effective_thresholds(spark, root):
    return statistics.thresholds(Base(spark, root).projects, DEFAULT_THRESHOLD)


@query(
    """SELECT c.project_id, c.recipe, coalesce(n.asset_count, 0) AS asset_count, CASE WHEN NOT degraded THEN coalesce(s.cluster_count, 0) END AS cluster_count, CASE WHEN NOT degraded THEN coalesce(s.edge_count, 0) END AS edge_count,
  CASE WHEN NOT degraded THEN coalesce(s.assets_with_duplicate_count, 0) END AS assets_with_duplicate_count, degraded, CASE WHEN NOT degraded THEN CASE WHEN coalesce(n.asset_count, 0) > 0 THEN floor(coalesce(s.assets_with_duplicate_count, 0) * 10000.0::DOUBLE / n.asset_count + 0.5) / 100.0::DOUBLE ELSE 0.0 END END AS assets_with_duplicate_pct
FROM (SELECT c.*, s.cluster_count, s.edge_count, s.assets_with_duplicate_count, coalesce(c.comparison = 'cosine', false) AS degraded FROM configured c LEFT JOIN stat s ON s.project_id = c.project_id AND s.algorithm_id = c.algorithm_id) c
LEFT JOIN stat s ON s.project_id = c.project_id AND s.algorithm_id = c.algorithm_id
LEFT JOIN (SELECT project_id, recipe, count(DISTINCT asset_id) AS asset_count FROM hashes JOIN algorithms USING (algorithm_id) GROUP BY 1, 2) n ON n.project_id = c.project_id AND n.recipe = c.recipe""",
    LIMITS,
    REACH.replace("FROM edges WHERE {where}", "FROM over_"),
    """configured AS (SELECT DISTINCT p.project_id, r.recipe, a.algorithm_id, a.comparison FROM projects p, LATERAL (SELECT unnest(recipes) AS recipe) r LEFT JOIN algorithms a ON a.recipe = r.recipe),
stat AS (SELECT project_id, algorithm_id, count(*) AS cluster_count, sum(links)::BIGINT AS edge_count, sum(members)::BIGINT AS assets_with_duplicate_count FROM class WHERE algorithm_id IN (SELECT algorithm_id FROM algorithms WHERE comparison = 'exact') GROUP BY 1, 2
  UNION ALL SELECT m.project_id, m.algorithm_id, count(DISTINCT cluster_id), any_value(n), count(*) FROM member m LEFT JOIN (SELECT project_id, algorithm_id, count(*) AS n FROM over_ WHERE asset_id < other_asset_id GROUP BY 1, 2) e ON e.project_id = m.project_id AND e.algorithm_id = m.algorithm_id
  WHERE m.algorithm_id IN (SELECT algorithm_id FROM algorithms WHERE comparison = 'hamming') GROUP BY 1, 2)""",
    recursive=True,
)
def project_stats(spark, root):
    """Duplicates per project and configured recipe, at each project's threshold."""
    b = Base(spark, root)
    over = statistics.scope_edges(b.edges, b.projects, DEFAULT_THRESHOLD)
    members = components(over, ["project_id", "algorithm_id"], Scratch(spark, "stats"))
    return statistics.duplicates_per_recipe(b.projects, b.algorithms, b.hashes, b.edges, members, DEFAULT_THRESHOLD)


@query("SELECT p.project_id, a.recipe, list_contains(p.recipes, a.recipe) AS configured, EXISTS (SELECT 1 FROM hashes h WHERE h.algorithm_id = a.algorithm_id) AS hashed FROM projects p CROSS JOIN algorithms a")
def scope_check(spark, root):
    """For each project and recipe of the catalogue: configured, and ever hashed."""
    b = Base(spark, root)
    hashed = b.hashes.select("algorithm_id").distinct().withColumn("_h", F.lit(True))
    a = b.algorithms.select("algorithm_id", "recipe").join(F.broadcast(hashed), "algorithm_id", "left")
    # every project with every recipe: two fixed tables of 40 and 8 rows
    out = b.projects.select("project_id", "recipes").withColumn("_k", F.lit(1)).join(F.broadcast(a.withColumn("_k", F.lit(1))), "_k")
    return out.select("project_id", "recipe", F.array_contains("recipes", F.col("recipe")).alias("configured"), F.coalesce("_h", F.lit(False)).alias("hashed"))


# --- mutations ------------------------------------------------------------------------------------

ANSWERS = """answer AS (SELECT asset_id, recipe, hashes, vectors IS NOT NULL AS has_vectors FROM (
  SELECT *, row_number() OVER (PARTITION BY asset_id, recipe ORDER BY received_at DESC NULLS LAST, result_id DESC NULLS LAST) AS rn FROM (SELECT * EXCLUDE (recipe), lower(trim(recipe)) AS recipe FROM core_hash_result) WHERE asset_id IS NOT NULL) WHERE rn = 1),
answered AS (SELECT r.asset_id, a.algorithm_id, r.hashes, CASE WHEN a.algorithm_id IS NULL THEN 'unknown recipe' WHEN hashes IS NULL AND has_vectors THEN 'vectors' WHEN hashes IS NULL THEN 'malformed' END AS problem FROM answer r LEFT JOIN algorithms a ON a.recipe = r.recipe),
stored AS (SELECT asset_id, algorithm_id, list([sequence_index::VARCHAR, hash] ORDER BY sequence_index) AS have FROM hashes GROUP BY 1, 2),
status AS (SELECT w.asset_id, w.algorithm_id, CASE WHEN s.have IS NULL THEN CASE WHEN len(w.hashes) = 0 THEN 'unchanged' ELSE 'created' END WHEN s.have = [[i::VARCHAR, w.hashes[i + 1]] FOR i IN range(len(w.hashes))] THEN 'unchanged' ELSE 'updated' END AS status
  FROM answered w LEFT JOIN stored s ON s.asset_id = w.asset_id AND s.algorithm_id = w.algorithm_id WHERE problem IS NULL)"""


@query("SELECT coalesce(problem, 'usable') AS outcome, count(*) AS n FROM answered GROUP BY 1", ANSWERS)
def answer_outcomes(spark, root):
    """Answers of the hashing service by usability."""
    b = Base(spark, root)
    return mutations.normalised_answers(b.raw("core_hash_result"), b.algorithms).groupBy(F.coalesce("problem", F.lit("usable")).alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


def _statuses(b: Base) -> DataFrame:
    answers = mutations.normalised_answers(b.raw("core_hash_result"), b.algorithms).where("problem is null")
    return mutations.hash_statuses(b.hashes, answers)


@query("SELECT * FROM status", ANSWERS)
def unchanged_detection(spark, root):
    """created, updated or unchanged, for each answer of the hashing service."""
    return _statuses(Base(spark, root))


@query("SELECT count(*) AS total, count(*) FILTER (status = 'created') AS created, count(*) FILTER (status = 'updated') AS updated, count(*) FILTER (status = 'unchanged') AS unchanged, 0::BIGINT AS failed FROM (SELECT asset_id, CASE max(CASE status WHEN 'created' THEN 2 WHEN 'updated' THEN 1 ELSE 0 END) WHEN 2 THEN 'created' WHEN 1 THEN 'updated' ELSE 'unchanged' END AS status FROM status GROUP BY 1)", ANSWERS)
def scan_status_summary(spark, root):
    files = mutations.file_statuses(_statuses(Base(spark, root)))
    return mutations.scan_summary(files.withColumn("error", F.lit(None).cast("string")))


@query("""SELECT project_id, algorithm_id, asset_id, sequence_index, hash FROM hashes h WHERE NOT EXISTS (SELECT 1 FROM answered w WHERE w.problem IS NULL AND w.asset_id = h.asset_id AND w.algorithm_id = h.algorithm_id)
UNION ALL SELECT a.project_id, w.algorithm_id, w.asset_id, i::INTEGER AS sequence_index, w.hashes[i + 1] AS hash FROM answered w JOIN asset a ON a.asset_id = w.asset_id, LATERAL (SELECT unnest(range(len(w.hashes))) AS i) WHERE w.problem IS NULL""", ANSWERS)
def replaced_hashes(spark, root):
    """The hash rows after the answers of the hashing service took the place of older ones."""
    b = Base(spark, root)
    answers = mutations.normalised_answers(b.raw("core_hash_result"), b.algorithms).where("problem is null")
    stored = b.hashes.select("project_id", "algorithm_id", "asset_id", "sequence_index", "hash")
    # an answer for an asset that isn't registered clears nothing and adds nothing new
    known = answers.join(b.assets.select("asset_id", "project_id"), "asset_id", "left")
    kept = mutations.replace_hashes(stored, known)
    return kept.where("project_id is not null")


def _patch_batch(b: Base) -> DataFrame:
    s = b.raw("shared_asset")
    moved = s.select("project_id", F.concat(F.lit("X-"), F.col("identity_id")).alias("identity_id"), "identity_path")
    return moved


@query("""SELECT b.project_id, coalesce(i.asset_id, p.asset_id) AS asset_id, CASE WHEN b.identity_id IS NULL THEN coalesce(i.identity_id, p.identity_id) WHEN b.identity_id = '' THEN NULL ELSE b.identity_id END AS identity_id,
  CASE WHEN b.identity_path IS NULL THEN CASE WHEN i.asset_id IS NOT NULL THEN i.identity_path ELSE p.identity_path END WHEN b.identity_path = '' THEN NULL ELSE b.identity_path END AS identity_path, CASE WHEN i.asset_id <> p.asset_id THEN 'conflict' WHEN coalesce(i.asset_id, p.asset_id) IS NULL THEN CASE WHEN b.identity_id IS NULL AND b.identity_path IS NULL THEN 'conflict' ELSE 'created' END
  WHEN count(*) OVER (PARTITION BY coalesce(i.asset_id, p.asset_id)) > 1 THEN 'conflict' ELSE 'patched' END AS status
FROM (SELECT project_id, 'X-' || identity_id AS identity_id, identity_path FROM shared_asset) b
LEFT JOIN (SELECT project_id, identity_id, min(asset_id) AS asset_id, arg_min(identity_path, asset_id) AS identity_path FROM asset WHERE identity_id <> '' GROUP BY 1, 2) i ON i.project_id = b.project_id AND i.identity_id = b.identity_id
LEFT JOIN (SELECT project_id, identity_path, min(asset_id) AS asset_id, arg_min(identity_id, asset_id) AS identity_id FROM asset WHERE identity_path <> '' GROUP BY 1, 2) p ON p.project_id = b.project_id AND p.identity_path = b.identity_path""")
def identity_patch(spark, root):
    """The shared templates delivered again under new ids: found by path and patched, or created."""
    b = Base(spark, root)
    return mutations.patch_identities(b.assets, _patch_batch(b))


KEY = "algorithm_id, asset_id, other_asset_id"


@query(f"""SELECT project_id, {KEY}, distance, similarity FROM newer UNION ALL SELECT project_id, {KEY}, distance, similarity FROM older o WHERE NOT EXISTS (SELECT 1 FROM newer n WHERE n.algorithm_id = o.algorithm_id AND n.asset_id = o.asset_id AND n.other_asset_id = o.other_asset_id)""",
       f"older AS (SELECT * FROM edges WHERE computed_at < {AS_OF_SQL} - INTERVAL 180 DAY), newer AS (SELECT * FROM edges WHERE similarity >= {T})")
def upsert_edges(spark, root):
    """Edges of half a year ago, with those that qualify now upserted."""
    e = Base(spark, root).edges.select("project_id", "algorithm_id", "asset_id", "other_asset_id", "distance", "similarity", "computed_at")
    half_a_year = F.lit(AS_OF) - F.expr("INTERVAL 180 DAYS")
    return mutations.upsert(e.where(F.col("computed_at") < half_a_year), e.where(F.col("similarity") >= T), ["algorithm_id", "asset_id", "other_asset_id"]).drop("computed_at")


@query(f"SELECT project_id, {KEY}, distance, similarity FROM edges WHERE NOT (algorithm_id = 3 AND (asset_id IN (SELECT asset_id FROM shared_asset) OR other_asset_id IN (SELECT asset_id FROM shared_asset)))")
def delete_asset_edges(spark, root):
    """Edges without those of the shared templates in one recipe."""
    b = Base(spark, root)
    e = b.edges.select("project_id", "algorithm_id", "asset_id", "other_asset_id", "distance", "similarity")
    return mutations.delete_asset_edges(e, b.raw("shared_asset").select(F.lit(3).alias("algorithm_id"), "asset_id"))


FIRST_PROJECT = "(SELECT min(project_id) FROM projects)"


@query(f"SELECT project_id, {KEY}, distance, similarity FROM edges WHERE NOT coalesce(project_id = {FIRST_PROJECT} AND algorithm_id = 5, false)")
def delete_project_edges(spark, root):
    b = Base(spark, root)
    first = b.projects.agg(F.min("project_id")).first()[0]
    return mutations.delete_scope(b.edges.select("project_id", "algorithm_id", "asset_id", "other_asset_id", "distance", "similarity"), first or "", 5)


@query("SELECT 'assets' AS tbl, count(*) AS n FROM asset WHERE asset_id NOT IN (SELECT asset_id FROM shared_asset) UNION ALL SELECT 'hashes', count(*) FROM hashes WHERE asset_id NOT IN (SELECT asset_id FROM shared_asset) UNION ALL SELECT 'edges', count(*) FROM edges WHERE asset_id NOT IN (SELECT asset_id FROM shared_asset) AND other_asset_id NOT IN (SELECT asset_id FROM shared_asset)")
def delete_assets(spark, root):
    """Rows left in each table after the shared templates were deleted."""
    b = Base(spark, root)
    left = mutations.delete_assets(b.raw("shared_asset"), b.assets, b.hashes, b.edges)
    out = None
    for name, df in zip(("assets", "hashes", "edges"), left):
        n = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("tbl"), "n")
        out = n if out is None else out.unionByName(n)
    return out


@query(f"SELECT e.project_id, {KEY}, distance, similarity FROM over_ e", LIMITS)
def recompute_threshold(spark, root):
    """Edges that a recompute at each project's threshold would keep."""
    b = Base(spark, root)
    return statistics.scope_edges(b.edges, b.projects, DEFAULT_THRESHOLD).select("project_id", "algorithm_id", "asset_id", "other_asset_id", "distance", "similarity")


@query("SELECT edge_id, algorithm_id, CASE WHEN similarity IS NULL THEN 'null' WHEN isnan(similarity) THEN 'nan' WHEN similarity NOT BETWEEN 0 AND 100 THEN 'range' ELSE 'self' END AS reason FROM asset_hash_duplicate WHERE similarity IS NULL OR isnan(similarity) OR similarity NOT BETWEEN 0 AND 100 OR asset_id = other_asset_id")
def rejected_edges(spark, root):
    """Rows that aren't usable as edges, and why."""
    e = Base(spark, root).raw("asset_hash_duplicate")
    s = F.col("similarity")
    reason = F.when(s.isNull(), "null").when(F.isnan(s), "nan").when(~s.between(0, 100), "range").when(F.col("asset_id") == F.col("other_asset_id"), "self")
    return e.select("edge_id", "algorithm_id", reason.alias("reason")).where("reason is not null")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
