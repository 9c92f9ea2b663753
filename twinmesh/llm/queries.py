"""The pN_ queries of this subpackage, and their SQL where whole tables allow it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinmesh.llm.abuse import FOUND_AT, score_documents, source_rates
from twinmesh.llm.groups import groups
from twinmesh.llm.history import HistoryIndex, fingerprint, members_of, unrecorded
from twinmesh.llm.mixing import Mix
from twinmesh.llm.packing import CAPACITY, pack
from twinmesh.llm.similar import COSINE, HAMMING, as_pairs, closest, hash_items, vector_items
from twinmesh.llm.topn import top_matches
from twinmesh.session import Scratch
from twinmesh.sources.tables import current_edges, table

NEAR_BITS = 12
LINK_SIMILARITY = 90.0
CURRENT_SQL = """
SELECT * FROM (
  SELECT *, row_number() OVER (PARTITION BY algorithm_id, asset_id, other_asset_id ORDER BY computed_at DESC NULLS LAST, edge_id DESC NULLS LAST) AS rn
  FROM asset_hash_duplicate
  WHERE similarity IS NOT NULL AND NOT isnan(similarity) AND similarity BETWEEN 0 AND 100 AND asset_id <> other_asset_id AND algorithm_id IS NOT NULL)
WHERE rn = 1"""
PLAIN_SQL = "regexp_replace(lower(trim(hash)), '^0x', '')"


def p1_found(spark: SparkSession, root: str) -> DataFrame:
    """Pairs of which one is among the five closest of the other, for hashes and for vectors."""
    scratch = Scratch(spark, "p1")
    near = closest(spark, hash_items(table(spark, root, "asset_hash")), HAMMING, 5, scratch)
    like = closest(spark, vector_items(table(spark, root, "core_hash_result")), COSINE, 5, scratch)
    return as_pairs(near, 3).unionByName(as_pairs(like, 7))


def p2_found(spark: SparkSession, root: str) -> DataFrame:
    """Group identifiers over all current edges of similarity 90 or more."""
    links = current_edges(table(spark, root, "asset_hash_duplicate")).where(F.col("similarity") >= LINK_SIMILARITY)
    return groups(links, Scratch(spark, "p2"))


P2_SQL = f"""
WITH RECURSIVE cur AS ({CURRENT_SQL}),
link AS (SELECT DISTINCT algorithm_id, asset_id AS x, other_asset_id AS y FROM cur WHERE similarity >= 90
         UNION SELECT DISTINCT algorithm_id, other_asset_id, asset_id FROM cur WHERE similarity >= 90),
reach AS (SELECT algorithm_id, x, x AS y FROM link UNION SELECT r.algorithm_id, r.x, l.y FROM reach r JOIN link l ON r.algorithm_id = l.algorithm_id AND r.y = l.x)
SELECT algorithm_id, x AS asset_id, min(y) AS group_id FROM reach GROUP BY algorithm_id, x"""


def p4_found(spark: SparkSession, root: str) -> DataFrame:
    """Unrecorded pairs of equal or nearly equal assets of which one came in batch 1 or later.

    The batches are accepted one after the other into an index that is named after the input's files, so a later
    run over the same files only reads what each batch matched. Assets created after the last batch belong to it."""
    hashes, batches = f"{root}/asset_hash.parquet", f"{root}/ingest_batch.parquet"
    opened = [r[0] for r in table(spark, root, "ingest_batch").where("batch_id > 0").select("opened_at").orderBy("batch_id").collect()]  # a fixed table of seven rows
    index = HistoryIndex(spark, fingerprint(spark, [hashes, batches], NEAR_BITS), exact=1, near=3, d_max=NEAR_BITS)
    if len(index.segments) <= len(opened):
        number = sum((F.coalesce(F.col("created_at") >= F.lit(t), F.lit(False)).cast("int") for t in opened), F.lit(0))
        members = members_of(table(spark, root, "asset_hash"), exact=1, near=3).withColumn("batch", number)
        index.accept_all(list(range(len(opened) + 1)), members, match_from=1)
    return unrecorded(index.pairs(since=1), table(spark, root, "asset_hash_duplicate").where(F.col("algorithm_id").isin(1, 3)))


P4_SQL = f"""
WITH rows_ AS (SELECT algorithm_id, project_id, asset_id, created_at, {PLAIN_SQL} AS h FROM asset_hash WHERE algorithm_id IN (1, 3)),
made AS (SELECT algorithm_id, asset_id, max(created_at) AS created_at FROM rows_ GROUP BY 1, 2),
usable AS (SELECT DISTINCT algorithm_id, project_id, asset_id, h FROM rows_ WHERE regexp_full_match(h, '[0-9a-f]{{64}}')),
word AS (SELECT *, ('0x' || substr(h, 1, 16))::UBIGINT AS w0, ('0x' || substr(h, 17, 16))::UBIGINT AS w1, ('0x' || substr(h, 33, 16))::UBIGINT AS w2, ('0x' || substr(h, 49, 16))::UBIGINT AS w3 FROM usable),
pair AS (
  SELECT DISTINCT a.algorithm_id, a.asset_id AS x, b.asset_id AS y FROM word a JOIN word b ON a.algorithm_id = b.algorithm_id AND a.project_id = b.project_id AND a.asset_id < b.asset_id
  WHERE (a.algorithm_id = 1 AND a.h = b.h) OR (a.algorithm_id = 3 AND bit_count(xor(a.w0, b.w0))::INTEGER + bit_count(xor(a.w1, b.w1))::INTEGER + bit_count(xor(a.w2, b.w2))::INTEGER + bit_count(xor(a.w3, b.w3))::INTEGER <= 12)),
late AS (SELECT p.*, greatest(m.created_at, n.created_at) AS later FROM pair p JOIN made m ON m.algorithm_id = p.algorithm_id AND m.asset_id = p.x JOIN made n ON n.algorithm_id = p.algorithm_id AND n.asset_id = p.y),
seen AS (SELECT algorithm_id, least(asset_id, other_asset_id) AS x, greatest(asset_id, other_asset_id) AS y, max(computed_at) AS computed_at FROM asset_hash_duplicate
         WHERE similarity IS NOT NULL AND NOT isnan(similarity) AND similarity BETWEEN 0 AND 100 AND asset_id <> other_asset_id GROUP BY 1, 2, 3)
SELECT l.algorithm_id, l.x AS asset_id, l.y AS other_asset_id FROM late l LEFT JOIN seen s ON s.algorithm_id = l.algorithm_id AND s.x = l.x AND s.y = l.y
WHERE l.later >= (SELECT min(opened_at) FROM ingest_batch WHERE batch_id = 1) AND (s.computed_at IS NULL OR s.computed_at < l.later)"""


def p5_found(spark: SparkSession, root: str) -> DataFrame:
    """The first three current edges of each asset and algorithm."""
    top = top_matches(current_edges(table(spark, root, "asset_hash_duplicate")), 3, Scratch(spark, "p5"))
    return top.select("algorithm_id", "asset_id", "rank_no", "other_asset_id")


P5_SQL = f"""
SELECT algorithm_id, asset_id, rank_no::INTEGER AS rank_no, other_asset_id FROM (
  SELECT algorithm_id, asset_id, other_asset_id, row_number() OVER (PARTITION BY algorithm_id, asset_id ORDER BY similarity DESC, distance ASC NULLS LAST, other_asset_id) AS rank_no
  FROM ({CURRENT_SQL})) WHERE rank_no <= 3"""


def p6_containers(spark: SparkSession, root: str) -> DataFrame:
    """Every document with its container, position and the container's unused tokens."""
    return pack(spark, table(spark, root, "documents"), Scratch(spark, "p6"))


def p6_summary(spark: SparkSession, root: str) -> DataFrame:
    """Containers, tokens and unused space of the packing, and the share of the tokens that patterns placed."""
    placed = p6_containers(spark, root).where("container_id is not null")
    each = placed.groupBy("container_id").agg(F.sum("n_tokens").alias("tokens"), F.max("unused").alias("unused"), F.sum(F.when(F.col("by_pattern"), F.col("n_tokens")).otherwise(0)).alias("by_pattern"))
    full = each.agg(F.count(F.lit(1)).alias("containers"), F.sum("tokens").alias("tokens"), F.sum("unused").alias("unused"), F.sum("by_pattern").alias("by_pattern"))
    return full.withColumn("unused_share", F.col("unused") / (F.col("containers") * CAPACITY)).withColumn("pattern_share", F.col("by_pattern") / F.col("tokens")).drop("by_pattern")


def p7_chosen(spark: SparkSession, root: str) -> DataFrame:
    """The document parts chosen for each slot of the mix."""
    return Mix(spark, table(spark, root, "documents"), table(spark, root, "mix_target"), Scratch(spark, "p7")).chosen


def p7_shares(spark: SparkSession, root: str) -> DataFrame:
    """Target and actual shares per source."""
    return Mix(spark, table(spark, root, "documents"), table(spark, root, "mix_target"), Scratch(spark, "p7")).shares()


def p8_found(spark: SparkSession, root: str) -> DataFrame:
    """Documents with abusive, hateful or sexual wording."""
    return score_documents(table(spark, root, "documents")).where(F.col("score") >= FOUND_AT).select("doc_id").distinct()


def p8_scores(spark: SparkSession, root: str) -> DataFrame:
    """The scores of every document."""
    return score_documents(table(spark, root, "documents"))


def p8_source_rates(spark: SparkSession, root: str) -> DataFrame:
    """Rates of flagged documents per source."""
    return source_rates(score_documents(table(spark, root, "documents")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"p1_found": p1_found, "p2_found": p2_found, "p4_found": p4_found, "p5_found": p5_found, "p6_containers": p6_containers, "p6_summary": p6_summary, "p7_chosen": p7_chosen, "p7_shares": p7_shares, "p8_found": p8_found, "p8_scores": p8_scores, "p8_source_rates": p8_source_rates}


def oracle_sql() -> dict[str, str]:
    return {"p2_found": P2_SQL, "p4_found": P4_SQL, "p5_found": P5_SQL}
