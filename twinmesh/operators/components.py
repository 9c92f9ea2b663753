"""Connected components by contraction under random names.

Vertices are named by 64-bit hashes, checked to be unique, so rounds move longs and no order of the
ids (a long chain in id order, say) makes a round useless. In a round each vertex chooses the least
name next to it, choices are followed for four steps, and links are contracted to the chosen
names. The graph shrinks by a constant factor a round in expectation, whatever its diameter.
Vertices with a hundredth of all links, 200 at most, are relabelled by broadcast, so a hub is no hot key.
What is left once few links are left is labelled by one task, in place of many small rounds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinmesh.session import Scratch


def name_vertices(links: DataFrame, scope: list[str], scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Vertices (scope, asset_id, name, degree), as a written table, and links (u, v) by name."""
    both = links.select(*scope, "asset_id").unionAll(links.select(*scope, F.col("other_asset_id").alias("asset_id")))
    degrees = both.groupBy(*scope, "asset_id").agg(F.count(F.lit(1)).alias("degree"))
    for seed in range(4):
        name = lambda c: F.xxhash64(F.lit(seed), *scope, c)  # noqa: B023, E731
        vertices = scratch.store(degrees.withColumn("name", name("asset_id")), "vertices")
        if vertices.groupBy("name").count().where("count > 1").isEmpty():
            return vertices, links.select(name("asset_id").alias("u"), name("other_asset_id").alias("v"))
        scratch.drop(vertices)
    # so many vertices that 64-bit names collide under each seed: number them instead
    vertices = scratch.store(degrees.withColumn("name", F.monotonically_increasing_id()), "vertices")
    one = links.join(vertices.select(*scope, "asset_id", F.col("name").alias("u")), [*scope, "asset_id"])
    two = one.join(vertices.select(*scope, F.col("asset_id").alias("other_asset_id"), F.col("name").alias("v")), [*scope, "other_asset_id"])
    return vertices, two.select("u", "v")


#: Links that one task labels at most (16 bytes each), the share of all links that makes a hub, and the links from which
#: hubs are looked for (below, a hot key is small).
LAST_LINKS, HUB_SHARE, HUBS_FROM = 200_000, 0.01, 1_000_000


def _local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Labels of a small graph: the least vertex of each component, by hooking and pointer jumping."""
    held = [np.stack([b.column(0).to_numpy(), b.column(1).to_numpy()]) for b in batches if b.num_rows]
    if held:
        names, at = np.unique(np.concatenate(held, 1), return_inverse=True)
        u, v = at.reshape(2, -1)
        label = np.arange(len(names))
        while (label[u] != label[v]).any():
            a, b = label[u], label[v]
            np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
            while (label != label[label]).any():
                label = label[label]
        yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(names[label])], names=["name", "label"])


def _relabel(links: DataFrame, end: str, to: str, labels: DataFrame, hubs: DataFrame | None) -> DataFrame:
    """Links with the label of the vertex at one end. A hub takes its label from the broadcast rows, and its links are
    spread over all partitions."""
    if hubs is None:
        return links.join(labels.select(F.col("name").alias(end), F.col("label").alias(to)), end)
    x = links.join(F.broadcast(hubs.select(F.col("name").alias(end), F.col("label").alias("_hub"))), end, "left")
    x = x.withColumn("_key", F.when(F.col("_hub").isNull(), F.col(end)).otherwise(F.xxhash64("u", "v")))
    found = labels.select(F.col("name").alias("_key"), F.col("label").alias("_label"))
    return x.join(found, "_key", "left").withColumn(to, F.coalesce("_hub", "_label")).drop("_key", "_hub", "_label")


def contract(links: DataFrame, scratch: Scratch, last: int = 0) -> DataFrame | None:
    """(name, label) for every vertex of the links (u, v): equal labels within a component and
    different ones otherwise. None if there are no links. Once ``last`` links are left, one task labels them."""
    rounds = []
    links = scratch.store(links.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).where("u <> v").distinct(), "links")
    while n := links.count():
        if n <= last:
            rounds.append(scratch.store(links.coalesce(1).mapInArrow(_local, "name bigint, label bigint"), "choice"))
            break
        both = links.unionAll(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        chosen = scratch.store(both.groupBy(F.col("u").alias("name")).agg(F.least(F.min("v"), F.col("u")).alias("label"), F.count(F.lit(1)).alias("degree")), "choice")
        choice, hubs = chosen.select("name", "label"), chosen.where(F.col("degree") >= n * HUB_SHARE).select("name")
        hop = lambda x: x.join(x.select(F.col("name").alias("label"), F.col("label").alias("next")), "label").select("name", F.col("next").alias("label"))
        rounds.append(scratch.store(hop(hop(choice)), "choice"))
        few = None
        if n >= HUBS_FROM:
            few = scratch.store(rounds[-1].join(F.broadcast(hubs), "name", "left_semi"), "hubs")  # 2 / HUB_SHARE at most
        scratch.drop(chosen)
        new = _relabel(_relabel(links, "u", "a", rounds[-1], few), "v", "b", rounds[-1], few).where("a <> b").select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct()
        old, links = links, scratch.store(new, "links")
        scratch.drop(old)
    final = None
    for choice in reversed(rounds):  # composed from the last round, which is the smallest, to the first
        if final is not None:
            later = final.select(F.col("name").alias("label"), F.col("label").alias("next"))
            choice = choice.join(later, "label", "left").select("name", F.coalesce("next", "label").alias("label"))
        final = choice
    return None if final is None else scratch.store(final, "final")


def clean_links(links: DataFrame, scope: list[str]) -> DataFrame:
    """Links with a complete scope between two different assets."""
    known = F.lit(True)
    for c in scope:
        known = known & F.col(c).isNotNull()
    return links.select(*scope, "asset_id", "other_asset_id").where(known & (F.col("asset_id") != F.col("other_asset_id")))


def components(links: DataFrame, scope: list[str], scratch: Scratch) -> DataFrame:
    """(scope, asset_id, cluster_id): cluster_id is the least asset id linked directly or indirectly
    within the scope. Assets without a link to another one are in no cluster; null ids and repeated
    rows are ignored; an empty table gives no rows."""
    links = scratch.store(clean_links(links, scope), "clean")
    vertices, named = name_vertices(links, scope, scratch)
    labels = contract(named, scratch, LAST_LINKS)
    if labels is None:
        return vertices.select(*scope, "asset_id", F.col("asset_id").alias("cluster_id"))
    labelled = scratch.store(vertices.select(*scope, "asset_id", "name").join(labels, "name").select(*scope, "asset_id", "label"), "labelled")
    least = labelled.groupBy("label").agg(F.min("asset_id").alias("cluster_id"), F.count(F.lit(1)).alias("n"))
    n = labelled.count()
    if n < HUBS_FROM:
        return labelled.join(least, "label").select(*scope, "asset_id", "cluster_id")
    # components with a hundredth of all vertices, a hundred at most, are named by broadcast
    least = scratch.store(least, "least")
    big = F.broadcast(least.where(F.col("n") >= n * HUB_SHARE).select("label", F.col("cluster_id").alias("_big")))
    x = labelled.join(big, "label", "left").withColumn("_key", F.when(F.col("_big").isNull(), F.col("label")).otherwise(F.xxhash64("asset_id")))
    x = x.join(least.select(F.col("label").alias("_key"), "cluster_id"), "_key", "left")
    return x.select(*scope, "asset_id", F.coalesce("_big", "cluster_id").alias("cluster_id"))
