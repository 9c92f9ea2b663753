"""Near duplicates by Hamming distance, within a project and recipe.

Equal hashes are one class, so only distinct hashes are compared. Three ways give the same pairs, and none loses one:

- bands: bits are cut into d_max + 1 bands, of which two hashes within d_max share one (pigeonhole);
  an equi-join on (scope, band, value) finds all candidates, and the exact distance is checked in the
  join. A band value that very many hashes share is cut again by the other bits;
- balls: with m bands, fewer than that, two hashes within d_max differ by at most d_max div m bits in one of them, so
  each hash probes the values of its bands with up to so many bits flipped. This pays where a scope has so many
  hashes that the probes cost less than the comparisons that they save;
- blocks: hashes of a scope are dealt into blocks whose number follows its size, and every pair of blocks is
  one bucket: all pairs, evenly spread, compared as arrays of words, and no broadcast.

``plan`` chooses by bits, distance and the scope's size: at the thresholds of the projects (80 to 92) long
hashes are within reach of so many values that comparing all pairs is cheapest up to millions of hashes in a scope.
"""

from __future__ import annotations

import itertools
import math
import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinmesh.functions import hashing
from twinmesh.operators import statistics
from twinmesh.session import Scratch

SCOPE = ["project_id", "algorithm_id"]
#: Bands of fewer bits than this select too little.
LEAST_BAND = 10
#: Band values shared by more hashes than this are cut again.
WIDE = 1_000
#: Hashes of a block, and about the pairs that a task compares, where all pairs of a scope are compared.
BLOCK = 4_096
TASK_PAIRS = 50_000_000
#: Rough costs in nanoseconds, for the choice between the ways: a word compared in a block, a probed or candidate row.
WORD_NS, ROW_NS = 1, 1_500
#: Probed values of a hash at most: their masks are a broadcast table.
MOST_PROBES = 40_000


def _cuts(positions: list[int], parts: int, seed: int) -> list[list[int]]:
    order = list(positions)
    random.Random(seed).shuffle(order)
    return [sorted(order[len(order) * i // parts : len(order) * (i + 1) // parts]) for i in range(parts)]


def _masks(positions: list[int], bits: int) -> list[int]:
    """For each word, the mask of the positions, as a signed 64-bit integer. The last word of a hash may
    have fewer than 64 bits."""
    out = []
    for w in range(-(-bits // 64)):
        width = min(64, bits - 64 * w)
        mask = sum(1 << (width - 1 - p % 64) for p in positions if p // 64 == w)
        out.append(mask - (1 << 64) if mask >= 1 << 63 else mask)
    return out


def plan(bits: int, d_max: int, n: int) -> int | None:
    """The bands to use for a scope of n hashes of so many bits: d_max + 1 (no bit flipped) while they have
    LEAST_BAND bits, else the number whose probes and candidates cost least, or None where comparing all
    pairs costs less."""
    if bits // (d_max + 1) >= LEAST_BAND:
        return d_max + 1
    best, bands = n / 2 * -(-bits // 64) * WORD_NS, None
    for m in range(1, min(d_max + 1, bits) + 1):
        width = bits // m
        probes = m * sum(math.comb(width + 1, i) for i in range(d_max // m + 1))
        if probes <= MOST_PROBES and (cost := probes * (1 + n * 0.5 ** min(width, 1_000)) * ROW_NS) < best:
            best, bands = cost, m
    return bands


def least_for_balls(bits: int, d_max: int) -> int:
    """The size, as a power of two, from which a scope goes by bands or balls."""
    n = 1
    while plan(bits, d_max, n) is None and n < 1 << 62:
        n *= 2
    return n


def _keyed(rows: DataFrame, masks: DataFrame, bits: int, *also: str) -> DataFrame:
    """(scope, hid, band, key) for each row of ``masks`` of the row's band: key is the hash of scope, band
    numbers and masked words. The masks are a parameter-sized table (bands, or bands squared), so the
    plan stays small for hashes of many words, too."""
    array = F.array(*[f"w{i}" for i in range(-(-bits // 64))])
    masked = F.zip_with(array, F.col("mask"), lambda w, m: w.bitwiseAND(m))
    return rows.join(F.broadcast(masks), "band").select(*SCOPE, "hid", "band", F.xxhash64(*SCOPE, *also, "band", "part", masked).alias("key"))


def _candidates(keys: DataFrame) -> DataFrame:
    other = keys.select(*SCOPE, "key", F.col("hid").alias("other_hid"))
    return keys.join(other, [*SCOPE, "key"]).where("hid < other_hid").select("hid", "other_hid")


def _in_reach(words: DataFrame, keys: DataFrame, cuts: list[list[int]], bits: int, radius: int) -> DataFrame:
    """Candidates whose band values differ by at most ``radius`` bits in some band. A value that very many
    hashes share is dealt into slices that each probe visits."""
    spark = words.sparkSession
    flips = [(i, 0, _masks(c, bits), [_masks(list(f), bits) for r in range(radius + 1) for f in itertools.combinations(c, r)]) for i, c in enumerate(cuts)]
    table = spark.createDataFrame(flips, "band int, part int, mask array<bigint>, flips array<array<bigint>>")
    array = F.array(*[f"w{i}" for i in range(-(-bits // 64))])
    probes = words.crossJoin(F.broadcast(table)).withColumn("flip", F.explode("flips"))  # each hash with its bands: a parameter-sized table
    value = F.zip_with(F.zip_with(array, F.col("mask"), lambda w, m: w.bitwiseAND(m)), F.col("flip"), lambda w, f: w.bitwiseXOR(f))
    probes = probes.select("hid", F.xxhash64(*SCOPE, "band", "part", value).alias("key"))
    slices = F.broadcast(keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > WIDE).select("key", F.ceil(F.col("n") / WIDE).cast("int").alias("slices")).limit(BLOCK))
    sliced = lambda x: x.join(slices, "key", "left").withColumn("slices", F.coalesce("slices", F.lit(1)))
    probes = sliced(probes).withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
    stored = sliced(keys.select("key", F.col("hid").alias("other_hid"))).withColumn("slice", F.pmod("other_hid", "slices").cast("int"))
    return probes.join(stored, ["key", "slice"]).where("hid < other_hid").select("hid", "other_hid")


def by_bands(distinct: DataFrame, bits: int, d_max: int, scratch: Scratch, bands: int | None = None, seed: int = 1) -> DataFrame:
    """Pairs of distinct hashes within d_max by bands, d_max + 1 of them or fewer with flipped bits; each pair once.

    Keys are written without the words, as numbers, and the words are joined to the candidates, since a
    long hash has many bands and few candidates."""
    spark, n = distinct.sparkSession, -(-bits // 64)
    names = [f"w{i}" for i in range(n)]
    bands = min(bands or d_max + 1, bits)
    radius = d_max // bands
    cuts = _cuts(list(range(bits)), bands, seed)
    first = spark.createDataFrame([(i, 0, _masks(c, bits)) for i, c in enumerate(cuts)], "band int, part int, mask array<bigint>")
    words = scratch.store(distinct.select(*SCOPE, F.monotonically_increasing_id().alias("hid"), "hash", *hashing.words("hash", bits)), "words")
    keys = scratch.store(_keyed(words.withColumn("band", F.explode(F.sequence(F.lit(0), F.lit(bands - 1)))), first, bits), "keys")
    wide = scratch.store(keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > WIDE).select("key"), "wide")
    if radius:
        found = _in_reach(words, keys, cuts, bits, radius)
    elif wide.isEmpty():
        found = _candidates(keys)
    else:
        subs = [(i, j, _masks(s, bits)) for i, c in enumerate(cuts) for j, s in enumerate(_cuts([p for p in range(bits) if p not in set(c)], d_max + 1, seed + 1 + i))]
        second = spark.createDataFrame(subs, "band int, part int, mask array<bigint>")
        shared = keys.join(wide, "key", "left_semi").select("hid", "band", F.col("key").alias("outer")).join(words.drop("hash"), "hid")
        found = _candidates(keys.join(wide, "key", "left_anti")).unionByName(_candidates(_keyed(shared, second, bits, "outer")))
    theirs = words.select(F.col("hid").alias("other_hid"), F.col("hash").alias("oh"), *[F.col(w).alias(f"o_{w}") for w in names])
    both = found.distinct().join(words, "hid").join(theirs, "other_hid")
    d = hashing.distance([F.col(w) for w in names], [F.col(f"o_{w}") for w in names])
    return both.select(*SCOPE, F.least("hash", "oh").alias("hash"), F.greatest("hash", "oh").alias("other_hash"), d.alias("distance")).where(F.col("distance") <= d_max)


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(scope, lo, hi, b, d_max, item), by bucket (scope, lo, hi), to the pairs (scope, item, other, distance)
    of block lo with block hi, or within one block, that are within d_max."""
    held: list[pa.RecordBatch] = []
    key = None

    def run() -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(held).combine_chunks()
        items = rows.column("item").to_pylist()
        x = np.frombuffer(b"".join(items), np.uint8).reshape(len(items), -1)
        x = np.pad(x, ((0, 0), (0, -x.shape[1] % 8))).view(np.uint64)
        b = rows.column("b").to_numpy()
        scope, lo, hi = key
        d_max = rows.column("d_max")[0].as_py()
        left, right = np.flatnonzero(b == lo), np.flatnonzero(b == hi)
        words = [np.ascontiguousarray(x[right, w]) for w in range(x.shape[1])]
        for i in range(0, len(left), 64):
            part = left[i : i + 64]
            d = np.zeros((len(part), len(right)), np.uint16)
            for w, other in enumerate(words):
                d += np.bitwise_count(x[part, w][:, None] ^ other)
            row, col = np.nonzero(d <= d_max)
            if lo == hi:
                row, col = row[part[row] < right[col]], col[part[row] < right[col]]
            if len(row):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(row), scope)), pa.array([items[j] for j in part[row]], pa.binary()), pa.array([items[j] for j in right[col]], pa.binary()), pa.array(d[row, col].astype(np.int32))], names=["scope", "item", "other", "distance"]
                )

    for batch in batches:
        at = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in range(3)], 1)
        cuts = [0, *(np.flatnonzero((at[1:] != at[:-1]).any(1)) + 1).tolist(), len(at)] if len(at) else []
        for i, j in zip(cuts, cuts[1:]):
            if held and tuple(at[i].tolist()) != key:
                yield from run()
                held = []
            key = tuple(at[i].tolist())
            held.append(batch.slice(i, j - i))
    if held:
        yield from run()


def by_blocks(distinct: DataFrame, scopes: DataFrame, scratch: Scratch, block: int = BLOCK) -> DataFrame:
    """Pairs of distinct hashes (SCOPE, hash) within the d_max of their scope by comparing every pair of blocks.

    ``scopes`` has SCOPE, bits, d_max and n, the number of hashes. A scope has one block for each ``block``
    hashes, and each pair of blocks is a bucket, so buckets stay of one size; tasks follow the number of pairs."""
    spark = distinct.sparkSession
    scopes = scratch.store(scopes.select(F.monotonically_increasing_id().alias("scope"), *SCOPE, "bits", "d_max", "n", F.ceil(F.col("n") / F.lit(block)).cast("int").alias("blocks")), "scopes")
    pairs = scopes.agg(F.sum(F.col("n").cast("double") * F.col("n") / 2)).first()[0] or 0
    tasks = int(min(max(int(spark.conf.get("spark.sql.shuffle.partitions")), pairs // TASK_PAIRS), 20_000))
    rows = distinct.join(F.broadcast(scopes.drop("bits", "n")), SCOPE).withColumn("b", F.pmod(F.xxhash64("hash"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("scope", F.least("b", "o").alias("lo"), F.greatest("b", "o").alias("hi"), "b", "d_max", F.unhex("hash").alias("item"))
    found = rows.repartition(tasks, "scope", "lo", "hi").sortWithinPartitions("scope", "lo", "hi").mapInArrow(_compare, "scope bigint, item binary, other binary, distance int")
    found = found.join(F.broadcast(scopes.select("scope", *SCOPE)), "scope").withColumns({"x": F.lower(F.hex("item")), "y": F.lower(F.hex("other"))})
    return found.select(*SCOPE, F.least("x", "y").alias("hash"), F.greatest("x", "y").alias("other_hash"), "distance")


def _scored(pairs: DataFrame, bits: Column | int) -> DataFrame:
    d = F.col("distance").cast("int")
    return pairs.select(*SCOPE, "hash", "other_hash", d.alias("distance"), hashing.similarity(d, bits).alias("similarity"))


def class_edges(hashes: DataFrame, bits: int, threshold: float, scratch: Scratch, bands: int | None = None, block: int = BLOCK) -> DataFrame:
    """Pairs of distinct hashes of ``bits`` bits whose similarity reaches the threshold:
    (project_id, algorithm_id, hash, other_hash, distance, similarity), smaller hash first.

    Hashes of another length or with other than hexadecimal digits, and nulls, take no part; a
    threshold above 100 gives no rows. ``bands`` is their number, 0 for blocks; by default ``plan`` says, by the
    largest scope."""
    d_max = hashing.max_distance(bits, threshold)
    distinct = hashes.select(*SCOPE, "hash").where(F.col("hash").rlike(f"^[0-9a-f]{{{bits // 4}}}$")).dropna().distinct()
    if d_max < 0:
        distinct = distinct.where("false")
    d_max = max(d_max, 0)
    if bands is None and bits // (d_max + 1) >= LEAST_BAND:
        bands = d_max + 1
    if bands:
        return _scored(by_bands(distinct, bits, d_max, scratch, bands), bits)
    distinct = scratch.store(distinct, "distinct")
    scopes = distinct.groupBy(*SCOPE).agg(F.count(F.lit(1)).alias("n")).withColumns({"bits": F.lit(bits), "d_max": F.lit(d_max)})
    if bands is None and (bands := plan(bits, d_max, scopes.agg(F.max("n")).first()[0] or 0)):
        return _scored(by_bands(distinct, bits, d_max, scratch, bands), bits)
    return _scored(by_blocks(distinct, scopes, scratch, block), bits)


def project_edges(hashes: DataFrame, algorithms: DataFrame, projects: DataFrame, default: float, scratch: Scratch, block: int = BLOCK) -> DataFrame:
    """Pairs of distinct hashes whose similarity reaches their project's effective threshold, for all Hamming
    recipes: (project_id, algorithm_id, hash, other_hash, distance, similarity), smaller hash first.

    Scopes of a size at which ``plan`` prefers bands or balls go that way, all others by blocks.
    Hashes of another length than the recipe's, nulls and projects without a row take no part."""
    spark = hashes.sparkSession
    recipes = algorithms.where("comparison = 'hamming' and bits is not null").select("algorithm_id", "bits")
    tenths = F.round(F.greatest(F.col("threshold"), F.lit(0.0)) * 10).cast("int").alias("tenths")
    sizes = sorted({r.bits for r in recipes.select("bits").distinct().collect()})
    reach = spark.createDataFrame([(n, t, hashing.max_distance(n, t / 10)) for n in sizes for t in range(1001)], "bits int, tenths int, d_max int")
    distinct = hashes.join(F.broadcast(recipes), "algorithm_id").where(F.col("hash").rlike("^[0-9a-f]+$") & (4 * F.length("hash") == F.col("bits"))).select(*SCOPE, "hash", "bits").dropna().distinct()
    distinct = scratch.store(distinct, "distinct")
    goal = statistics.thresholds(projects, default).select("project_id", tenths)
    scopes = distinct.groupBy(*SCOPE, "bits").agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(goal), "project_id").join(F.broadcast(reach), ["bits", "tenths"]).where("d_max >= 0")
    scopes = scratch.store(scopes.drop("tenths"), "sizes")
    largest = scopes.groupBy("bits", "d_max").agg(F.max("n").alias("n")).collect()  # a row for each recipe length and threshold
    banded = [(r.bits, r.d_max, least_for_balls(r.bits, r.d_max), plan(r.bits, r.d_max, r.n)) for r in largest if r.bits // (r.d_max + 1) < LEAST_BAND and plan(r.bits, r.d_max, r.n)]
    out, rest = None, scopes
    for bits, d_max, least, bands in banded:
        mine = (F.col("bits") == bits) & (F.col("d_max") == d_max) & (F.col("n") >= least)
        some = _scored(by_bands(distinct.join(F.broadcast(scopes.where(mine).select(*SCOPE)), SCOPE, "left_semi"), bits, d_max, scratch, bands), bits)
        out, rest = some if out is None else out.unionByName(some), rest.where(~mine)
    blocks = by_blocks(distinct.drop("bits"), rest, scratch, block).join(F.broadcast(recipes), "algorithm_id")
    blocks = _scored(blocks, F.col("bits"))
    return blocks if out is None else out.unionByName(blocks)


def asset_edges(hashes: DataFrame, pairs: DataFrame) -> DataFrame:
    """Directional edges of assets from pairs of hashes: the best frame pair of each two assets, equal
    hashes included (distance 0). Every link is a row, so this is for the hashes of a batch or of recipes
    without large classes; large classes stay classes in ``class_edges`` and ``exact``."""
    have = hashes.select(*SCOPE, "hash", "asset_id").dropna().distinct()
    theirs = have.select(*SCOPE, F.col("hash").alias("other_hash"), F.col("asset_id").alias("other_asset_id"))
    near = have.join(pairs, [*SCOPE, "hash"]).join(theirs, [*SCOPE, "other_hash"]).select(*SCOPE, "asset_id", "other_asset_id", "distance", "similarity")
    same = have.join(theirs.withColumnRenamed("other_hash", "hash"), [*SCOPE, "hash"]).select(*SCOPE, "asset_id", "other_asset_id", F.lit(0).alias("distance"), F.lit(100.0).alias("similarity"))
    swapped = near.select(*SCOPE, F.col("other_asset_id").alias("asset_id"), F.col("asset_id").alias("other_asset_id"), "distance", "similarity")
    all_ = near.unionByName(swapped).unionByName(same).where("asset_id <> other_asset_id")
    return all_.groupBy(*SCOPE, "asset_id", "other_asset_id").agg(F.min("distance").alias("distance"), F.max("similarity").alias("similarity"))


def best_frames(hashes: DataFrame, pairs: DataFrame) -> DataFrame:
    """(SCOPE, asset_id, distance, similarity): each asset's best frame pair with any other asset, of equal hashes and of
    the pairs (SCOPE, hash, other_hash, distance, similarity); assets without one have no row. A hash stands for all its
    assets by the smallest and the greatest of them, so a shared frame makes no pairs of assets."""
    have = hashes.select(*SCOPE, "hash", "asset_id").dropna().distinct()
    frames = have.groupBy(*SCOPE, "hash").agg(F.min("asset_id").alias("low"), F.max("asset_id").alias("high"))
    same = have.join(frames.where("low <> high"), [*SCOPE, "hash"]).select(*SCOPE, "asset_id", F.lit(0).alias("distance"), F.lit(100.0).alias("similarity"))
    both = pairs.select(*SCOPE, "hash", "other_hash", "distance", "similarity")
    both = both.unionByName(both.select(*SCOPE, F.col("other_hash").alias("hash"), F.col("hash").alias("other_hash"), "distance", "similarity"))
    near = have.join(both, [*SCOPE, "hash"]).join(frames.withColumnRenamed("hash", "other_hash"), [*SCOPE, "other_hash"])
    near = near.where("low <> asset_id or high <> asset_id").select(*SCOPE, "asset_id", "distance", "similarity")
    return same.unionByName(near).groupBy(*SCOPE, "asset_id").agg(F.min("distance").alias("distance"), F.max("similarity").alias("similarity"))


def edges_of(hashes: DataFrame, assets: DataFrame, bits: int, threshold: float) -> DataFrame:
    """Directional edges between the given assets (asset_id; some thousands, since their hashes are broadcast) and all
    assets of their scope: best frame pairs, as ``asset_edges`` gives them. Only pairs with a given asset are
    compared."""
    d_max, n = hashing.max_distance(bits, threshold), -(-bits // 64)
    have = hashes.select(*SCOPE, "asset_id", "hash").where(F.col("hash").rlike(f"^[0-9a-f]{{{bits // 4}}}$")).dropna().distinct()
    words = have.select(*SCOPE, "asset_id", *hashing.words("hash", bits))
    mine = words.join(F.broadcast(assets.select("asset_id").distinct()), "asset_id", "left_semi")
    theirs = words.select(*SCOPE, F.col("asset_id").alias("other_asset_id"), *[F.col(f"w{i}").alias(f"o{i}") for i in range(n)])
    d = hashing.distance([F.col(f"w{i}") for i in range(n)], [F.col(f"o{i}") for i in range(n)])
    near = theirs.join(F.broadcast(mine), SCOPE).where((F.col("asset_id") != F.col("other_asset_id")) & (d <= d_max)).select(*SCOPE, "asset_id", "other_asset_id", d.alias("distance"))
    swapped = near.select(*SCOPE, F.col("other_asset_id").alias("asset_id"), F.col("asset_id").alias("other_asset_id"), "distance")
    best = near.unionByName(swapped).groupBy(*SCOPE, "asset_id", "other_asset_id").agg(F.min("distance").alias("distance"))
    return best.withColumn("similarity", hashing.similarity(F.col("distance"), bits))
