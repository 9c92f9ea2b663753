"""Mixing sources to target shares of the tokens, repeating no document more often than allowed.

1. The documents of a source are put in a pseudorandom order and their tokens laid end to end; the
   stream is cut into blocks of a fixed length (the last block of a source may be shorter).
   Offsets come from a range partitioning whose partitions report one sum per source.
2. The size of the mix is the greatest for which no source needs more than max_repeats passes.
   Every source gets its share as a number of slots, and the slots are dealt to output shards by
   multinomial draws from the slots still to deal, so that the totals come out exactly.
3. Slot k of a source is block perm(k mod blocks) of pass k div blocks; perm is a keyed
   pseudorandom permutation of the block numbers, another in each pass, computed per slot.
4. Slots and the blocks' documents are joined by (source, block).

The driver sees one sum per source and partition, and one count per source and shard (4,096 at most).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinmesh.llm.tokens import TOKENIZER, with_tokens
from twinmesh.session import Scratch

BLOCK = 2_048
SHARD_SLOTS, MOST_SHARDS = 256, 4_096
SEED = 11

SLOTS = "shard int, position bigint, source string, block bigint, pass int"


def permute(x: np.ndarray, n: np.ndarray, key: np.ndarray) -> np.ndarray:
    """A keyed pseudorandom permutation of 0..n-1 at each x: four Feistel rounds over the least even
    number of bits, walked until the value is below n again."""
    half = np.maximum(1, (np.ceil(np.log2(np.maximum(n, 2))).astype(np.int64) + 1) // 2).astype(np.uint64)
    mask = (np.uint64(1) << half) - np.uint64(1)
    out, todo = x.astype(np.uint64), np.ones(len(x), bool)
    k = key.astype(np.uint64)
    while todo.any():
        left, right = out[todo] >> half[todo], out[todo] & mask[todo]
        for r in range(4):
            f = (right + k[todo] * np.uint64(0x9E3779B97F4A7C15) + np.uint64(r)) * np.uint64(0xBF58476D1CE4E5B9)
            f ^= f >> np.uint64(29)
            f *= np.uint64(0x94D049BB133111EB)
            f ^= f >> np.uint64(32)
            left, right = right, left ^ (f & mask[todo])
        out[todo] = (left << half[todo]) | right
        todo = out >= n.astype(np.uint64)
    return out.astype(np.int64)


def quotas(share: dict[str, float], tokens: dict[str, int], repeats: dict[str, int]) -> dict[str, int]:
    """Slots per source: the greatest mix in which each source with tokens has its share of the tokens
    (shares of sources without any are spread over the others) and needs at most repeats passes.
    A slot counts with the mean size of its source's blocks, since the last block is shorter."""
    usable = {s: share[s] for s in sorted(share) if tokens.get(s) and share[s] > 0 and repeats[s] > 0}
    if not usable:
        return {}
    total = sum(usable.values())
    size = min(repeats[s] * tokens[s] * total / usable[s] for s in usable)
    out = {}
    for s in usable:
        blocks = -(-tokens[s] // BLOCK)
        out[s] = min(repeats[s] * blocks, max(1, round(size * usable[s] / total / (tokens[s] / blocks))))
    return out


def deal(quota: dict[str, int], seed: int = SEED) -> list[tuple[int, str, int, int]]:
    """(shard, source, first slot, slots): multinomial draws per shard by what is left of the quotas."""
    names, left = sorted(quota), np.array([quota[s] for s in sorted(quota)], np.int64)
    total, done = int(left.sum()), np.zeros(len(left), np.int64)
    size = max(SHARD_SLOTS, -(-total // MOST_SHARDS))
    rng, out = np.random.default_rng(seed), []
    for shard in range(-(-total // size) if total else 0):
        need = min(size, int(left.sum()))
        take = np.zeros(len(left), np.int64)
        while need:
            rest = left - take
            draw = np.minimum(rng.multinomial(need, rest / rest.sum()), rest)
            take, need = take + draw, need - int(draw.sum())
        out += [(shard, names[i], int(done[i]), int(take[i])) for i in range(len(names)) if take[i]]
        left, done = left - take, done + take
    return out


def _offsets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the partition, and the tokens before a document among those of its source in it."""
    part, last, seen = TaskContext.get().partitionId(), None, 0
    for b in batches:
        if not b.num_rows:
            continue
        s, n = b.column(0), b.column(2).to_numpy().astype(np.int64)
        new = np.ones(len(n), bool)
        new[1:] = pc.not_equal(s.slice(1), s.slice(0, len(s) - 1)).to_numpy(zero_copy_only=False)
        starts = np.flatnonzero(new)
        before = np.cumsum(n) - n
        before -= np.repeat(before[starts], np.diff(np.append(starts, len(n))))
        if s[0].as_py() == last:
            before[: starts[1] if len(starts) > 1 else len(n)] += seen
        last, seen = s[len(n) - 1].as_py(), int(before[-1] + n[-1])
        yield pa.RecordBatch.from_arrays([s, b.column(1), b.column(2), pa.array(np.full(len(n), part, np.int32)), pa.array(before)], names=["source", "doc_id", "n_tokens", "part", "before"])


def _slots(blocks: dict[str, int], names: list[str]):
    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            shard, k, at, size = (b.column(i).to_numpy().astype(np.int64) for i in (0, 2, 3, 4))
            source = b.column(1).to_pylist()
            n = np.array([blocks[s] for s in source], np.int64)
            number = np.array([names.index(s) for s in source], np.int64)
            turn = k // n
            block = permute(k % n, n, (number << 20) + turn + SEED)
            place = permute(at, size, shard + (1 << 40))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(place), b.column(1), pa.array(block), pa.array(turn.astype(np.int32))], names=["shard", "position", "source", "block", "pass"])

    return slots


class Mix:
    """The mix of a set of documents: ``slots`` (one row per block used), ``chosen`` (one row per
    document part used) and ``shares`` (one row per source).

    Sources are compared trimmed, in lower case, with blanks and hyphens as underscores. Documents
    without text, or of a null source or one that isn't in ``targets``, aren't used. A source without
    documents gets no slots and is reported with an actual share of 0; a null share counts as 0, a
    null max_repeats as 1. Without any document all tables are empty but the shares."""

    def __init__(self, spark: SparkSession, documents: DataFrame, targets: DataFrame, scratch: Scratch, tokenizer: str = TOKENIZER) -> None:
        plain = F.regexp_replace(F.lower(F.trim("source")), "[ -]+", "_")
        self.targets = targets.select(plain.alias("source"), F.coalesce("target_share", F.lit(0.0)).alias("target_share"), F.coalesce("max_repeats", F.lit(1)).alias("max_repeats")).where("source is not null")
        wanted = {r.source: r for r in self.targets.collect()}  # a fixed table: one row per source
        texts = documents.select(plain.alias("source"), F.col("doc_id").cast("bigint"), "text").where(F.col("source").isin(list(wanted)))
        # written, since the range partitioning reads it twice and texts are only to be tokenized once
        counted = scratch.store(with_tokens(texts, "source string, doc_id bigint", tokenizer).where("n_tokens > 0"), "counted")
        order = ["source", "h", "doc_id"]
        ranged = counted.withColumn("h", F.xxhash64(F.lit(SEED), "doc_id")).repartitionByRange(*order).sortWithinPartitions(*order)
        laid = scratch.store(ranged.select("source", "doc_id", "n_tokens").mapInArrow(_offsets, "source string, doc_id bigint, n_tokens int, part int, before bigint"), "laid")
        # one row per source and partition border
        sums = laid.groupBy("source", "part").agg(F.sum("n_tokens").alias("n")).orderBy("source", "part").collect()
        self.tokens: dict[str, int] = {}
        starts = []
        for r in sums:
            starts.append((r.source, r.part, self.tokens.get(r.source, 0)))
            self.tokens[r.source] = self.tokens.get(r.source, 0) + r.n
        self.blocks = {s: -(-n // BLOCK) for s, n in self.tokens.items()}
        offsets = spark.createDataFrame(starts, "source string, part int, start bigint")
        begin = F.col("start") + F.col("before")
        docs = laid.join(F.broadcast(offsets), ["source", "part"]).select("source", "doc_id", "n_tokens", begin.alias("begin"))
        block = F.explode(F.sequence(F.expr(f"begin div {BLOCK}"), F.expr(f"(begin + n_tokens - 1) div {BLOCK}")))
        docs = docs.withColumn("block", block)
        low, high = F.greatest(F.lit(0), F.col("block") * BLOCK - F.col("begin")), F.least(F.col("n_tokens").cast("bigint"), (F.col("block") + 1) * BLOCK - F.col("begin"))
        docs = docs.select("source", "block", "doc_id", low.alias("token_start"), high.alias("token_end"))
        quota = quotas({s: float(r.target_share) for s, r in wanted.items()}, self.tokens, {s: r.max_repeats for s, r in wanted.items()})
        dealt, sizes, at = deal(quota), {}, []
        for shard, source, first, n in dealt:
            at.append((shard, source, first, n, sizes.get(shard, 0)))
            sizes[shard] = sizes.get(shard, 0) + n
        rows = spark.createDataFrame([(*r, sizes[r[0]]) for r in at], "shard int, source string, first bigint, n bigint, at bigint, size bigint")
        i = rows.repartition("shard").withColumn("i", F.explode(F.expr("sequence(0L, n - 1)")))
        each = i.select("shard", "source", (F.col("first") + F.col("i")).alias("k"), (F.col("at") + F.col("i")).alias("at"), "size")
        names = sorted(wanted)
        self.slots = scratch.store(each.mapInArrow(_slots(self.blocks, names), SLOTS), "slots")
        self.chosen = self.slots.join(docs, ["source", "block"]).select("shard", "position", "source", "block", "pass", "doc_id", "token_start", "token_end")

    def shares(self) -> DataFrame:
        spark = self.slots.sparkSession
        have = spark.createDataFrame([(s, n, self.blocks[s]) for s, n in self.tokens.items()], "source string, available_tokens bigint, blocks bigint")
        size = F.least(F.lit(BLOCK), F.col("available_tokens") - F.col("block") * BLOCK)
        used = self.slots.join(F.broadcast(have), "source").groupBy("source").agg(F.sum(size).alias("used_tokens"), F.count(F.lit(1)).alias("slots"), (F.max("pass") + 1).alias("passes"))
        total = used.agg(F.sum("used_tokens").alias("total"))
        out = self.targets.join(F.broadcast(have), "source", "left").join(F.broadcast(used), "source", "left").crossJoin(F.broadcast(total))
        number = lambda c, kind="bigint": F.coalesce(c, F.lit(0)).cast(kind).alias(c)
        return out.select("source", "target_share", "max_repeats", number("available_tokens"), number("used_tokens"), number("slots"), number("passes", "int"), F.coalesce(F.col("used_tokens") / F.col("total"), F.lit(0.0)).alias("actual_share"))
