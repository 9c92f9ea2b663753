"""One group identifier for everything linked directly or indirectly.

Vertices get 64-bit pseudorandom names (checked to be unique), so the iterations move longs, and
"minimum" means the minimum of random names: no order of the ids, such as a long chain in id order,
can slow the propagation down.

1. Peel: breadth-first joins from the vertices of highest degree (the highest of each algorithm and
   any with a hundredth of all links: at most 200 and one per algorithm, so they are broadcast).
   A vertex takes the least source that reaches it. The search ends when its frontier is small.
   The links inside the peeled part disappear (both ends have the same source); links that leave it, or
   join two sources, stay as links of the source, since a search that ends early leaves a tail.
2. The rest: every vertex takes the least name next to it, these choices are followed twice (four
   steps), and the links are contracted to the chosen names, until none is left. Each round shrinks
   the graph by a constant factor in expectation, whatever the diameter. The last LAST_LINKS links go to
   one task, which propagates minima until nothing changes, in place of many rounds of small jobs.
3. The choices are composed from the last round to the first, and each group is named by its
   smallest asset id.

All state between rounds is a written table in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinmesh.operators.components import LAST_LINKS, clean_links, contract, name_vertices
from twinmesh.session import Scratch

HEAVY_SHARE = 0.01
#: The breadth-first search goes on while its frontier has at least this share of all vertices.
FRONTIER_SHARE = 0.02


def _peel(vertices: DataFrame, links: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Peeled vertices (name, source), and the links that are left once each peeled vertex is
    replaced by its source."""
    best = vertices.groupBy("algorithm_id").agg(F.max("degree").alias("top"), F.sum("degree").alias("total"), F.count(F.lit(1)).alias("n"))
    stats = best.agg(F.sum("total").alias("total"), F.sum("n").alias("n")).first()
    heavy = vertices.join(F.broadcast(best.select("algorithm_id", "top")), "algorithm_id").where((F.col("degree") >= stats.total * HEAVY_SHARE) | (F.col("degree") == F.col("top")))
    # of several vertices that tie for the highest degree, one is enough
    roots = heavy.where(F.col("degree") >= stats.total * HEAVY_SHARE).select("name").unionAll(heavy.groupBy("algorithm_id").agg(F.min_by("name", -F.col("degree")).alias("name")).select("name")).distinct()
    sources = scratch.store(roots.select("name", F.col("name").alias("source")), "sources")
    small = F.broadcast(sources)  # at most 2 / HEAVY_SHARE and one per algorithm
    marked = links.join(small.select(F.col("name").alias("u"), F.col("source").alias("su")), "u", "left").join(small.select(F.col("name").alias("v"), F.col("source").alias("sv")), "v", "left")
    marked = scratch.store(marked.select("u", "v", "su", "sv"), "marked")
    light = marked.where("su is null and sv is null").select("u", "v")
    light = light.unionAll(light.select("v", "u"))
    spokes = marked.where("su is not null or sv is not null").select(F.coalesce("su", "sv").alias("s"), F.when(F.col("su").isNotNull(), F.col("v")).otherwise(F.col("u")).alias("v"))
    reached = [sources, scratch.store(spokes.join(small, F.col("v") == F.col("name"), "left_anti").groupBy(F.col("v").alias("name")).agg(F.min("s").alias("source")), "reached")]
    while reached[-1].count() > stats.n * FRONTIER_SHARE:
        step = light.join(reached[-1].withColumnRenamed("name", "u"), "u").groupBy(F.col("v").alias("name")).agg(F.min("source").alias("source"))
        for seen in reached[-2:]:  # a neighbour of the last level is in it, in the one before, or new
            step = step.join(seen, "name", "left_anti")
        reached.append(scratch.store(step, "reached"))
    peeled = reached[0]
    for level in reached[1:]:
        peeled = peeled.unionAll(level)
    inner = marked.where("su is null and sv is null").select("u", "v")
    of = lambda c, s: peeled.select(F.col("name").alias(c), F.col("source").alias(s))
    rest = inner.join(of("u", "a"), "u", "left").join(of("v", "b"), "v", "left").select(F.coalesce("a", "u").alias("u"), F.coalesce("b", "v").alias("v"))
    across = spokes.join(of("v", "b"), "v").select(F.col("s").alias("u"), F.col("b").alias("v"))
    return peeled, rest.unionAll(across).where("u <> v")


def groups(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(algorithm_id, asset_id, group_id) for every asset of the links (algorithm_id, asset_id,
    other_asset_id), which count in both directions within their algorithm.

    Rows with a null id or algorithm are ignored, as are repeated rows and rows that link an asset
    with itself (an asset with no other link is in no group); an empty table gives no rows."""
    scope = ["algorithm_id"]
    clean = scratch.store(clean_links(links, scope), "clean")
    vertices, named = name_vertices(clean, scope, scratch)
    if vertices.isEmpty():
        return vertices.select("algorithm_id", "asset_id", F.col("asset_id").alias("group_id"))
    peeled, rest = _peel(vertices, named, scratch)
    final = contract(rest, scratch, LAST_LINKS)
    of = vertices.select("algorithm_id", "asset_id", "name").join(peeled, "name", "left")
    if final is None:
        labelled = of.withColumn("label", F.coalesce("source", "name"))
    else:  # a source may have been merged further, so its vertices look up the source; sources are few
        labels = final.withColumnRenamed("name", "key")
        of = of.withColumn("key", F.coalesce("source", "name"))
        few = labels.join(F.broadcast(peeled.select(F.col("source").alias("key")).distinct()), "key", "left_semi")
        inside = of.where("source is not null").join(F.broadcast(few), "key", "left")
        outside = of.where("source is null").join(labels, "key", "left")
        labelled = inside.unionByName(outside).withColumn("label", F.coalesce("label", "key"))
    labelled = scratch.store(labelled.select("algorithm_id", "asset_id", "label", "source"), "labelled")
    least = scratch.store(labelled.groupBy("label").agg(F.min("asset_id").alias("group_id")), "least")
    # the groups of the sources are few and hold most rows: broadcast; all others by a shuffle
    few = least.join(F.broadcast(labelled.where("source is not null").select("label").distinct()), "label", "left_semi")
    inside = labelled.where("source is not null").join(F.broadcast(few), "label")
    outside = labelled.where("source is null").join(least, "label")
    return inside.unionByName(outside).select("algorithm_id", "asset_id", "group_id")
