"""The k most similar assets of every asset: adaptive dimension scan over probed lists.

Items are unit vectors (cosine) or 256-bit hashes (Hamming), both brought into a rotated form: vectors
by a fixed random orthogonal matrix, hashes by a fixed random order of their bits, which is the
rotation that keeps Hamming distance. After it, any block of columns is a fair sample of the distance.

1. Copies are collapsed: one item row keeps its first k + 1 assets, which is all that can be
   among the k closest of anything (ties go to the smaller id); further copies are linked to the first k.
2. Lists: centroids are fitted on a bounded sample (SAMPLE rows, drawn from all items by a hash); their
   number follows the square root of the items, up to a list per sampled hash and one per four sampled
   vectors. Each item is stored in, and probes, its few nearest lists, which for hashes grow in
   number with the lists, since two near hashes share a list of many less often.
   A list of more than BLOCK expected items is cut into blocks, and its queries into parts, and each block
   meets each part in a task of its own.
3. In a list, items lie in column blocks. Distances grow block by block for all candidates of a
   chunk of queries; a hypothesis test on the partial distance abandons pairs that can't reach the
   threshold or the query's current last place, and the rest is computed for survivors only. Places
   are of different assets, k + 1 of them, since one may be the query's own; an asset takes one
   place however many items it has.
4. The results of all lists are merged per asset.

Nothing is dropped but by the approximation of 2 and 3; recall is measured against brute force.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from twinmesh.session import Scratch, ship

#: The sample the centroids are fitted on has at most this many rows, whatever the table's size.
SAMPLE = 65_536
BLOCK = 8_192
#: Blocks of a list for each part of its queries: a task has about BLOCK stored items and PARTS * BLOCK queries.
PARTS = 4
QUERIES = 256
SEED = 20_260
#: Slices of the copies of an item.
SLICES = 32


@dataclass(frozen=True)
class Metric:
    """Everything that differs between the two kinds of items. limit is the greatest distance that
    counts; margin the largest distance to the border of another list that is still probed; growth the power of
    the lists by which the probes grow beyond 2,000 lists; per_list the sampled rows of a list at least."""

    name: str
    bytes: int
    limit: float
    lists_per_root: float
    probes: int
    margin: float
    growth: float
    per_list: int

    @property
    def cosine(self) -> bool:
        return self.name == "cosine"


COSINE = Metric("cosine", 256, 0.2 + 1e-7, 1.0, 8, 0.08, 0.0, 4)
HAMMING = Metric("hamming", 32, 38.0, 5.8, 12, 2.0, 0.23, 1)


def rotation(dim: int = 64) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(SEED).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def bit_order() -> np.ndarray:
    return np.random.default_rng(SEED).permutation(256)


def unit_items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(asset_id, list of vectors) to (asset_id, item): each usable vector (64 finite numbers, not all
    zero) scaled to length 1, rotated, as bytes of 32-bit floats."""
    turn = rotation()
    for b in batches:
        lists = b.column(1)
        parents, inner = pc.list_parent_indices(lists), lists.flatten()
        ok = pc.fill_null(pc.equal(pc.list_value_length(inner), 64), False)
        parents, inner = parents.filter(ok), inner.filter(ok)
        v = inner.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, 64)
        good = np.isfinite(v).all(1) & (v != 0).any(1)
        v, parents = v[good], parents.filter(pa.array(good))
        v = v / np.abs(v).max(1, keepdims=True)  # so that no square over- or underflows
        v = (v / np.linalg.norm(v, axis=1, keepdims=True)) @ turn
        v = np.ascontiguousarray(v, np.float32) + np.float32(0)
        yield pa.RecordBatch.from_arrays([b.column(0).take(parents), _binary(v)], names=["asset_id", "item"])


def turned_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(asset_id, 32 bytes) with the bits in the fixed random order."""
    order = bit_order()
    for b in batches:
        if b.num_rows:
            bits = np.unpackbits(_matrix(b.column(1), np.uint8), axis=1)[:, order]
            yield pa.RecordBatch.from_arrays([b.column(0), _binary(np.packbits(bits, axis=1))], names=["asset_id", "item"])


def _binary(x: np.ndarray) -> pa.Array:
    width = x.shape[1] * x.itemsize
    offsets = np.arange(len(x) + 1, dtype=np.int32) * width
    return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(offsets), pa.py_buffer(x.tobytes())])


def _matrix(column: pa.Array, dtype: type) -> np.ndarray:
    """A binary column of equal widths as a matrix."""
    if not len(column):
        return np.empty((0, 1), dtype)
    offsets = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, column.offset * 4)
    data = np.frombuffer(column.buffers()[2], np.uint8, offsets[-1] - offsets[0], offsets[0])
    return data.reshape(len(column), -1).view(dtype)


def points(metric: Metric, items: np.ndarray) -> np.ndarray:
    """Items as unit vectors, for the assignment to lists."""
    if metric.cosine:
        return items
    return (np.unpackbits(items.view(np.uint8), axis=1).astype(np.float32) * 2 - 1) / np.float32(16)


def fit(metric: Metric, sample: np.ndarray, k: int) -> np.ndarray:
    """Centroids of length 1: k-means for vectors; for hashes, whose clusters are small and many,
    random hashes of the sample serve as well."""
    rng = np.random.default_rng(SEED)
    p = points(metric, sample)
    c = p[rng.choice(len(p), min(k, len(p)), replace=False)].copy()
    for _ in range(4 if metric.cosine else 0):
        near = np.concatenate([(p[i : i + 4096] @ c.T).argmax(1) for i in range(0, len(p), 4096)])
        sums = np.zeros_like(c)
        np.add.at(sums, near, p)
        length = np.linalg.norm(sums, axis=1)
        c = np.where(length[:, None] > 1e-6, sums / np.maximum(length, 1e-6)[:, None], c).astype(np.float32)
    return c


def nearest_lists(metric: Metric, p: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, list) of the lists that each point is stored in and probes: of the nearest
    ``probes`` lists (more, where there are many lists) those whose border with the nearest one is within the margin."""
    s = p @ c.T
    m = min(int(np.ceil(metric.probes * max(1.0, len(c) / 2_000) ** metric.growth)), c.shape[0])
    top = np.argpartition(-s, m - 1, axis=1)[:, :m] if m < c.shape[0] else np.broadcast_to(np.arange(m), (len(p), m))
    st = np.take_along_axis(s, top, 1)
    order = np.argsort(-st, axis=1, kind="stable")
    top, st = np.take_along_axis(top, order, 1), np.take_along_axis(st, order, 1)
    gap = np.linalg.norm(c[top] - c[top[:, :1]], axis=2)
    keep = (st[:, :1] - st) <= metric.margin * gap
    return np.nonzero(keep)[0], top[keep]


def _assign(metric: Metric, centroids, blocks):
    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, per = centroids.value, blocks.value
        for b in batches:
            vid = b.column(0).to_numpy()
            items = _matrix(b.column(1), np.float32 if metric.cosine else np.uint8)
            for i in range(0, len(vid), 1024):
                v, x = vid[i : i + 1024], items[i : i + 1024]
                row, at = nearest_lists(metric, points(metric, x), c)
                n = per[at]  # blocks of the list, and parts of its queries
                parts = -(-n // PARTS)
                own, part = (v[row] * 2654435761 >> 7) % n, (v[row] * 2246822519 >> 9) % parts
                rep = np.repeat(np.arange(len(row)), n)  # as a query, an item visits every block of the list
                other = np.repeat(np.arange(len(row)), parts)  # as a stored item, it meets every part of the queries
                block = np.r_[_places(n), own[other]]
                meets = np.r_[part[rep], _places(parts)]
                asks = np.arange(len(block)) < len(rep)
                rep = np.r_[rep, other]
                stored = own[rep] == block
                keep = asks | (meets != part[rep])  # where it is both, it is one row
                rep, block, meets, asks, stored = rep[keep], block[keep], meets[keep], asks[keep], stored[keep]
                assets = b.column(2).take(pa.array(i + row[rep], mask=~stored))  # null where the item only probes
                task = (block * parts[rep] + meets).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(at[rep].astype(np.int32)), pa.array(task), pa.array(stored), pa.array(v[row[rep]]), _binary(x[row[rep]]), assets, pa.array(asks)], names=["list", "block", "stored", "vid", "item", "assets", "asks"]
                )

    return assign


def _places(n: np.ndarray) -> np.ndarray:
    """0, 1, ... within each group of groups of n."""
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)


class ColumnBlocks:
    """The stored items of a list in column blocks, and the tests that abandon candidates."""

    def __init__(self, metric: Metric, items: np.ndarray) -> None:
        self.metric = metric
        if metric.cosine:
            self.cuts = [(0, 16), (16, 32), (32, 64)]
            self.blocks = [np.ascontiguousarray(items[:, a:b]) for a, b in self.cuts]
            self.squares = (self.blocks[0] ** 2).sum(1)
        else:
            words = np.ascontiguousarray(items).view(np.uint64)
            self.cuts = [(0, 64), (64, 128), (128, 256)]
            self.blocks = [np.ascontiguousarray(words[:, a // 64 : b // 64]) for a, b in self.cuts]

    def bound(self, limit: np.ndarray, dims: int) -> np.ndarray:
        """The partial distance over dims columns that a pair within the limit exceeds with a
        probability of some thousandths only."""
        if self.metric.cosine:
            return limit * (dims / 64) * (1 + 2.6 / np.sqrt(dims)) ** 2
        share = np.clip(limit / 256, 1e-6, 1)
        return limit * (dims / 256) + 3.0 * np.sqrt(dims * share * (1 - share) * (1 - dims / 256)) + 0.5

    def first(self, q: np.ndarray) -> np.ndarray:
        if self.metric.cosine:
            return (q[:, :16] ** 2).sum(1)[:, None] + self.squares - 2 * (q[:, :16] @ self.blocks[0].T)
        return np.bitwise_count(q.view(np.uint64)[:, :1] ^ self.blocks[0][:, 0])

    def more(self, k: int, q: np.ndarray, row: np.ndarray, col: np.ndarray) -> np.ndarray:
        a, b = self.cuts[k]
        if self.metric.cosine:
            d = q[row, a:b].astype(np.float64) - self.blocks[k][col]
            return (d * d).sum(1)
        return np.bitwise_count(q.view(np.uint64)[row, a // 64 : b // 64] ^ self.blocks[k][col]).sum(1)

    def search(self, q: np.ndarray, qid: np.ndarray, vid: np.ndarray, k: int, starts: np.ndarray | None = None, assets: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query row, entry, distance) of the k closest different assets of each query within the limit;
        ties by asset; an item isn't its own match. Entries are (stored row, asset): those of row i are
        assets[starts[i] : starts[i + 1]]; without assets each row is one, of the asset vid[i]. Candidates come in
        chunks, and the k-th best asset so far of a query tightens its tests in the next chunk."""
        if starts is None or assets is None:
            starts, assets = np.arange(len(vid) + 1), vid
        limit = np.full(len(q), self.metric.limit)
        rows, entries, dist = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        for at in range(0, len(vid), 4096):
            part = self if len(vid) <= 4096 else ColumnBlocks.__new__(ColumnBlocks)._slice(self, at)
            row, col = np.nonzero(part.first(q) <= part.bound(limit, part.cuts[0][1])[:, None])
            other = qid[row] != vid[at + col]
            row, col = row[other], col[other]
            d = part.more(0, q, row, col).astype(np.float64)
            for j, (_, dims) in enumerate(part.cuts[1:], 1):
                d += part.more(j, q, row, col)
                keep = d <= (part.bound(limit, dims)[row] if j + 1 < len(part.cuts) else limit[row])
                row, col, d = row[keep], col[keep], d[keep]
            if self.metric.cosine:
                d = np.round(d, 7)
            n = starts[at + col + 1] - starts[at + col]
            entry = np.repeat(starts[at + col], n) + _places(n)
            rows, entries, dist = np.append(rows, np.repeat(row, n)), np.append(entries, entry), np.append(dist, np.repeat(d, n))
            order = np.lexsort((dist, assets[entries], rows))  # the closest item of each asset
            rows, entries, dist = rows[order], entries[order], dist[order]
            once = np.r_[True, (rows[1:] != rows[:-1]) | (assets[entries[1:]] != assets[entries[:-1]])][: len(rows)]
            rows, entries, dist = rows[once], entries[once], dist[once]
            order = np.lexsort((assets[entries], dist, rows))
            rows, entries, dist = rows[order], entries[order], dist[order]
            rank = _places(np.bincount(rows, minlength=len(q)))
            full = rank == k - 1
            limit[rows[full]] = np.minimum(limit[rows[full]], dist[full])
            rows, entries, dist = rows[rank < k], entries[rank < k], dist[rank < k]
        return rows, entries, dist

    def _slice(self, whole: ColumnBlocks, at: int) -> ColumnBlocks:
        self.metric, self.cuts = whole.metric, whole.cuts
        self.blocks = [x[at : at + 4096] for x in whole.blocks]
        if self.metric.cosine:
            self.squares = whole.squares[at : at + 4096]
        return self


def _scan(metric: Metric, k: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        key = None

        def run() -> Iterator[pa.RecordBatch]:
            stored, vid, items = (np.concatenate(x) for x in list(zip(*held))[:3])
            asks = np.concatenate([x[4] for x in held])
            if stored.sum() and asks.sum() and len(vid) > 1:
                blocks, ids = ColumnBlocks(metric, items[stored]), vid[stored]
                lists = pa.concat_arrays([x[3] for x in held]).filter(pa.array(stored))
                starts, assets = np.r_[0, np.cumsum(pc.list_value_length(lists).to_numpy())], lists.flatten().to_numpy()
                vid, items = vid[asks], items[asks]
                for i in range(0, len(vid), QUERIES):
                    row, entry, d = blocks.search(items[i : i + QUERIES], vid[i : i + QUERIES], ids, k, starts, assets)
                    if len(row):
                        yield pa.RecordBatch.from_arrays([pa.array(vid[i + row]), pa.array(assets[entry]), pa.array(d)], names=["vid", "other_asset", "distance"])

        for b in batches:
            if not b.num_rows:
                continue
            at = b.column(0).to_numpy().astype(np.int64) << 32 | b.column(1).to_numpy()
            asks = b.column(6).to_numpy(zero_copy_only=False)
            cols = (b.column(2).to_numpy(zero_copy_only=False), b.column(3).to_numpy(), _matrix(b.column(4), np.float32 if metric.cosine else np.uint8))
            cuts = [0, *(np.flatnonzero(np.diff(at)) + 1).tolist(), len(at)]
            for i, j in zip(cuts, cuts[1:]):
                if held and at[i] != key:
                    yield from run()
                    held = []
                key = at[i]
                held.append((*(c[i:j].copy() for c in cols), b.column(5).slice(i, j - i), asks[i:j].copy()))
        if held:
            yield from run()

    return scan


def closest(spark: SparkSession, items: DataFrame, metric: Metric, k: int, scratch: Scratch) -> DataFrame:
    """(asset_id, other_asset_id, rank_no) of the k closest other assets of every asset within the
    metric's limit; the distance of two assets is the least over their items; ties go to the
    smaller id. ``items`` has (asset_id, item), in the rotated form.

    Rows with a null asset or item are ignored, repeated rows count once, an empty table gives
    no rows."""
    pairs = items.where(F.col("asset_id").isNotNull() & F.col("item").isNotNull()).distinct()
    # assets by number, in the order of their ids
    names = pairs.select("asset_id").distinct().repartitionByRange("asset_id").sortWithinPartitions("asset_id")
    names = scratch.store(names.select(F.monotonically_increasing_id().alias("asset"), "asset_id"), "names")
    pairs = pairs.join(names, "asset_id").select("asset", "item")
    w = Window.partitionBy("item").orderBy("asset")
    first = pairs.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= k + 1)
    reps = first.groupBy("item").agg(F.sort_array(F.collect_list("asset")).alias("assets"))
    reps = scratch.store(reps.select(F.monotonically_increasing_id().alias("vid"), "item", "assets"), "items")
    facts = reps.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.size("assets") > k).alias("full")).first()
    if not facts.n:
        return names.select("asset_id", F.col("asset_id").alias("other_asset_id"), F.lit(1).alias("rank_no")).where("false")
    lists = max(1, min(int(metric.lists_per_root * facts.n**0.5), SAMPLE // metric.per_list))
    rows = min(SAMPLE, max(64 * lists, 4096) if metric.cosine else 8 * lists)
    # items by their hash: each has the same chance, wherever it lies, and their number is close to rows
    share = int(min(1.0, rows / facts.n) * 2**31)
    sample = reps.select("item").where(F.pmod(F.xxhash64(F.lit(SEED), "item"), F.lit(2**31)) < F.lit(share)).toArrow().column(0).combine_chunks()
    sample = _matrix(sample if len(sample) else reps.select("item").limit(1).toArrow().column(0).combine_chunks(), np.float32 if metric.cosine else np.uint8)
    c = fit(metric, sample, lists)
    seen = np.bincount(np.concatenate([nearest_lists(metric, points(metric, sample[i : i + 2048]), c)[1] for i in range(0, len(sample), 2048)]), minlength=len(c))
    blocks = np.maximum(1, np.ceil(seen * (facts.n / len(sample)) / BLOCK)).astype(np.int64)
    sc = spark.sparkContext
    spread = reps.select("vid", "item", "assets").mapInArrow(_assign(metric, sc.broadcast(c), sc.broadcast(blocks)), "list int, block int, stored boolean, vid bigint, item binary, assets array<bigint>, asks boolean")
    spread = spread.repartition("list", "block").sortWithinPartitions("list", "block")
    found = spread.mapInArrow(_scan(metric, k + 1), "vid bigint, other_asset bigint, distance double")  # one may be the query's own asset
    found = found.groupBy("vid", "other_asset").agg(F.min("distance").alias("distance"))
    both = found.join(reps.select("vid", F.explode("assets").alias("asset")), "vid").select("asset", "other_asset", "distance")
    copies = reps.where(F.size("assets") > 1).select(F.explode("assets").alias("asset"), "assets").select("asset", F.explode("assets").alias("other_asset"), F.lit(0.0).alias("distance"))
    both = both.unionByName(copies)
    if facts.full:  # copies beyond the first k + 1 assets of their item
        full = reps.where(F.size("assets") > k).select("item", "assets")
        # the copies of an item that many assets have are dealt into slices
        full = full.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(SLICES - 1))))
        more = pairs.withColumn("slice", F.pmod("asset", F.lit(SLICES)).cast("int")).join(full, ["item", "slice"]).where(~F.array_contains("assets", F.col("asset")))
        both = both.unionByName(more.select("asset", F.explode("assets").alias("other_asset"), F.lit(0.0).alias("distance")))
    both = both.where("asset <> other_asset").groupBy("asset", "other_asset").agg(F.min("distance").alias("distance"))
    best = Window.partitionBy("asset").orderBy("distance", "other_asset")
    ranked = both.withColumn("rank_no", F.row_number().over(best)).where(F.col("rank_no") <= k)
    theirs = names.select(F.col("asset").alias("other_asset"), F.col("asset_id").alias("other_asset_id"))
    return ranked.join(names, "asset").join(theirs, "other_asset").select("asset_id", "other_asset_id", "rank_no")


def vector_items(results: DataFrame) -> DataFrame:
    """(asset_id, item) of the usable vectors of recipe image.embed64."""
    ship(results.sparkSession)
    rows = results.where((F.lower(F.trim("recipe")) == "image.embed64") & F.col("vectors").isNotNull() & F.col("asset_id").isNotNull())
    return rows.select("asset_id", "vectors").mapInArrow(unit_items, "asset_id string, item binary")


def hash_items(hashes: DataFrame) -> DataFrame:
    """(asset_id, item) of the usable hashes of algorithm 3."""
    from twinmesh.sources.tables import plain_hash

    ship(hashes.sparkSession)
    rows = hashes.where((F.col("algorithm_id") == 3) & F.col("asset_id").isNotNull()).select("asset_id", plain_hash().alias("h")).where(F.col("h").rlike("^[0-9a-f]{64}$"))
    return rows.select("asset_id", F.unhex("h").alias("item")).mapInArrow(turned_hashes, "asset_id string, item binary")


def as_pairs(closest_: DataFrame, algorithm_id: int) -> DataFrame:
    return closest_.select(F.lit(algorithm_id).alias("algorithm_id"), F.least("asset_id", "other_asset_id").alias("asset_id"), F.greatest("asset_id", "other_asset_id").alias("other_asset_id")).distinct()
