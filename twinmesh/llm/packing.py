"""Filling containers of a fixed capacity with whole documents.

Only the histogram of lengths is planned (at most ``capacity`` numbers, whatever the corpus):

1. Patterns of at most three documents that fill a container to within a few tokens are
   enumerated over the lengths that occur.
2. Non-negative least squares fits how often each pattern is used to the histogram; the counts are
   rounded up so that no length is used more often than it occurs. At most PATTERNS patterns are fitted at once, those
   that can be used most often; what they leave is enumerated and fitted again, until a round fills few containers.
3. The residual lengths, mostly short ones, go best fit, longest first, into the space left and into
   new containers, again by counts and not by documents.

The plan is a list of slots: "the documents of length L with ranks r to r + n go to containers c to
c + n, at position p". A document's rank among those of its length comes from a range partitioning
on (length, document), whose partitions each need their offsets only, so a length that a third of all
documents share is ranked in parallel; the slot is found by binary search.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinmesh.llm.tokens import TOKENIZER, with_tokens
from twinmesh.session import Scratch

CAPACITY = 2_048
#: Patterns fitted at once, the unused tokens allowed in one, and the share of all containers that a round must fill to be
#: followed by another; fitted counts of more than ROUND_UP are rounded up.
PATTERNS, SLACK, AGAIN, ROUND_UP = 30_000, 2, 0.002, 0.02


@dataclass
class Plan:
    """slots: rows (length, first rank, documents, first container, position, 1 where a pattern placed them),
    sorted by length and rank; groups: rows (first container, containers, unused), sorted."""

    slots: np.ndarray
    groups: np.ndarray


def patterns(counts: np.ndarray, capacity: int) -> np.ndarray:
    """Rows of up to three lengths (0: none), longest first, that sum to capacity or SLACK less."""
    have = np.flatnonzero(counts)
    have = have[have > 0]
    # fits[x]: the greatest length that occurs and is at most x, 0 if there is none
    fits = np.zeros(capacity + 1, np.int64)
    fits[have] = have
    fits = np.maximum.accumulate(fits)
    out = [np.stack([have[have >= capacity - SLACK], *[np.zeros((have >= capacity - SLACK).sum(), np.int64)] * 2], 1)]
    a, b = (x.ravel() for x in np.meshgrid(have, have, indexing="ij"))
    keep = (a >= b) & (a + b <= capacity)
    a, b = a[keep], b[keep]
    c = np.minimum(fits[capacity - a - b], np.where(fits[capacity - a - b] <= b, capacity, 0))
    ok = capacity - a - b - c <= SLACK
    out.append(np.stack([a[ok], b[ok], c[ok]], 1))
    p = np.concatenate(out)
    rare = np.where(p > 0, counts[p], np.iinfo(np.int64).max).min(1)  # how often a pattern can be used at most
    order = np.lexsort((p[:, 2], p[:, 1], -p[:, 0], -rare))[:PATTERNS]
    return p[order]


def fit_counts(p: np.ndarray, counts: np.ndarray, steps: int = 400) -> np.ndarray:
    """x >= 0 that makes the lengths used by x patterns least-squares close to the counts; short lengths
    weigh less, since what is left of them still fits anywhere. Accelerated projected gradient."""
    if not len(p):
        return np.zeros(0)
    n = len(counts)
    weight = np.clip(np.arange(n) / (n / 4), 0.1, 1.0)
    used = p > 0
    forward = lambda x: np.bincount(p[used], np.repeat(x[:, None], 3, 1)[used], n) * weight
    back = lambda r: ((r * weight)[p] * used).sum(1)
    v = np.ones(len(p))
    for _ in range(30):
        v = back(forward(v))
        norm = np.linalg.norm(v)
        v /= norm
    step, target = 1 / (norm * 1.02), counts * weight
    x = y = np.zeros(len(p))
    t = 1.0
    for _ in range(steps):
        new = np.maximum(0, y - step * back(forward(y) - target))
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y, x, t = new + (t - 1) / t_new * (new - x), new, t_new
    return x


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> Plan:
    """The slots of all documents of a histogram of lengths (1 to capacity)."""
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in histogram.items():
        counts[length] = n
    left, taken = counts.copy(), np.zeros(capacity + 1, np.int64)
    slots: list[tuple[int, int, int, int, int, int]] = []
    # open containers: by space left, stacks of (first container, containers, documents in each)
    space: dict[int, list[tuple[int, int, int]]] = {}
    containers = 0

    def put(length: int, n: int, first: int, position: int, by_pattern: int = 0) -> None:
        slots.append((length, int(taken[length]), n, first, position, by_pattern))
        taken[length] += n
        left[length] -= n

    more = True
    while more:
        p, before = patterns(left, capacity), containers
        x = fit_counts(p, left.astype(float))
        x = np.where(x > ROUND_UP, np.ceil(x), 0).astype(np.int64)  # many lengths are rare, so many counts are below a half
        for i in np.argsort(-x, kind="stable"):
            lengths = [int(v) for v in p[i] if v]
            n = int(min([x[i], *(left[v] // lengths.count(v) for v in set(lengths))]))
            if n <= 0:
                continue
            for at, v in enumerate(lengths):
                put(v, n, containers, at, 1)
            space.setdefault(capacity - sum(lengths), []).append((containers, n, len(lengths)))
            containers += n
        more = containers - before > AGAIN * containers
    for length in range(capacity, 0, -1):
        while left[length]:
            room = min((s for s in space if s >= length), default=None)
            if room is None:
                each = min(capacity // length, int(left[length]))
                n = int(left[length]) // each
                for at in range(each):
                    put(length, n, containers, at)
                space.setdefault(capacity - each * length, []).append((containers, n, each))
                containers += n
                continue
            first, n, held = space[room].pop()
            if not space[room]:
                del space[room]
            m = min(n, int(left[length]))
            put(length, m, first, held)
            space.setdefault(room - length, []).append((first, m, held + 1))
            if m < n:
                space.setdefault(room, []).append((first + m, n - m, held))
    groups = sorted((f, n, s) for s, stack in space.items() for f, n, _ in stack)
    return Plan(np.array(sorted(slots), np.int64).reshape(-1, 6), np.array(groups, np.int64).reshape(-1, 3))


def _rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the partition and the index of a piece among those of its length in the sorted partition."""
    part, last, seen = TaskContext.get().partitionId(), None, 0
    for b in batches:
        if not b.num_rows:
            continue
        n = b.column(3).to_numpy()
        starts = np.flatnonzero(np.r_[True, n[1:] != n[:-1]])
        index = np.arange(len(n)) - np.repeat(starts, np.diff(np.append(starts, len(n))))
        if n[0] == last:
            index[: starts[1] if len(starts) > 1 else len(n)] += seen
        last, seen = n[-1], int(index[-1]) + 1
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(len(n), part, np.int32)), pa.array(index.astype(np.int64))], names=[*b.schema.names, "part", "i"])


def _place(planned, offsets):
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p: Plan = planned.value
        shift = 44
        keys = (p.slots[:, 0] << shift) + p.slots[:, 1]
        for b in batches:
            if not b.num_rows:
                continue
            n, part = b.column(3).to_numpy(), b.column(4).to_numpy()
            pairs, inverse = np.unique(np.stack([part, n], 1), axis=0, return_inverse=True)
            rank = b.column(5).to_numpy() + np.array([offsets.value[int(x), int(y)] for x, y in pairs], np.int64)[inverse.ravel()]
            slot = p.slots[np.searchsorted(keys, (n.astype(np.int64) << shift) + rank, "right") - 1]
            container = slot[:, 3] + rank - slot[:, 1]
            unused = p.groups[np.searchsorted(p.groups[:, 0], container, "right") - 1, 2]
            yield pa.RecordBatch.from_arrays([pa.array(container), pa.array(slot[:, 4].astype(np.int32)), b.column(0), b.column(1), b.column(2), b.column(3), pa.array(unused.astype(np.int32)), pa.array(slot[:, 5] == 1)], names=["container_id", "position", "doc_id", "piece_no", "token_start", "n_tokens", "unused", "by_pattern"])

    return place


def pack(spark: SparkSession, documents: DataFrame, scratch: Scratch, capacity: int = CAPACITY, tokenizer: str = TOKENIZER) -> DataFrame:
    """(container_id, position, doc_id, piece_no, token_start, n_tokens, unused, by_pattern): every document in a
    container, at a position from 0, with the container's unused tokens, and whether a pattern placed it.

    A document of more than ``capacity`` tokens is cut into full pieces and a rest, numbered from 0;
    all others are one piece. Documents without tokens (null or empty text) need no container: they
    are rows with a null container_id, position, unused and by_pattern. A repeated or null doc_id is packed
    like any other; an empty table gives no rows."""
    counted = scratch.store(with_tokens(documents.select(F.col("doc_id").cast("bigint"), "text"), "doc_id bigint", tokenizer), "counted")
    last = F.expr(f"cast((n_tokens - 1) div {capacity} as int)")
    pieces = counted.where("n_tokens > 0").withColumn("piece_no", F.explode(F.sequence(F.lit(0), last)))
    pieces = pieces.select("doc_id", "piece_no", (F.col("piece_no") * capacity).alias("token_start"), F.least(F.lit(capacity), F.col("n_tokens") - F.col("piece_no") * capacity).alias("n_tokens"))
    # doc_id is unique, so (length, document, piece) cuts any length over several partitions
    ranged = pieces.repartitionByRange("n_tokens", "doc_id", "piece_no").sortWithinPartitions("n_tokens", "doc_id", "piece_no")
    ranked = scratch.store(ranged.mapInArrow(_rank, "doc_id bigint, piece_no int, token_start int, n_tokens int, part int, i bigint"), "ranked")
    # at most one row per length and partition border
    sizes = ranked.groupBy("n_tokens", "part").count().orderBy("n_tokens", "part").collect()
    histogram: dict[int, int] = {}
    offsets = {}
    for r in sizes:
        offsets[r.part, r.n_tokens] = histogram.get(r.n_tokens, 0)
        histogram[r.n_tokens] = histogram.get(r.n_tokens, 0) + r["count"]
    empty = counted.where("n_tokens = 0").select(F.lit(None).cast("bigint").alias("container_id"), F.lit(None).cast("int").alias("position"), "doc_id", F.lit(0).alias("piece_no"), F.lit(0).alias("token_start"), "n_tokens", F.lit(None).cast("int").alias("unused"), F.lit(None).cast("boolean").alias("by_pattern"))
    sc = spark.sparkContext
    placed = ranked.mapInArrow(_place(sc.broadcast(plan(histogram, capacity)), sc.broadcast(offsets)), "container_id bigint, position int, doc_id bigint, piece_no int, token_start int, n_tokens int, unused int, by_pattern boolean")
    return placed.unionByName(empty)
