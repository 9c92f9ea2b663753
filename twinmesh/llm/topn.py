"""Top N items of every group by merging stored sorted runs.

1. Rows are deduplicated by pair, so a group of any size lies spread over all partitions.
2. Each partition is sorted by (bucket of the group, group, score) and becomes a run; only the first N of a
   group in a run can be among its first N overall, so a run keeps no more.
3. Runs are stored in the shared folder, one Parquet file each, in small row groups whose statistics say which
   buckets they hold: an index by bucket without runs x buckets files.
4. A task merges its bucket of all runs with a loser tree over cursors. A cursor reads the row groups of
   its bucket a few rows at a time, so a task's memory is that of its cursors' batches, whatever a bucket or
   a group holds. After N outputs every run is sought to its next group: in the batch by
   the known start of the next group, beyond it batch by batch.
5. More than FAN_IN runs are merged in passes, FAN_IN at a time, each into one longer run a bucket.

Runs are in the shared folder, so a lost executor costs a task. The folder must be one that Arrow's file systems
can read as well (a mounted path, HDFS, S3 or GCS).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinmesh.session import Scratch

KEYS = ["algorithm_id", "asset_id"]
RUN = "bucket int, algorithm_id int, asset_id string, similarity double, distance int, other_asset_id string"
RUN_ARROW = pa.schema([("bucket", pa.int32()), ("algorithm_id", pa.int32()), ("asset_id", pa.string()), ("similarity", pa.float64()), ("distance", pa.int32()), ("other_asset_id", pa.string())])
RESULT = "algorithm_id int, asset_id string, rank_no int, other_asset_id string, similarity double, distance int"
OUT = pa.schema([("algorithm_id", pa.int32()), ("asset_id", pa.string()), ("rank_no", pa.int32()), ("other_asset_id", pa.string()), ("similarity", pa.float64()), ("distance", pa.int32())])
NO_DISTANCE = np.iinfo(np.int64).max
#: Runs that a task merges at once, rows that all its cursors hold together, bytes of a run's row group, and rows of a bucket
#: for which a further bucket is opened (up to spark.sql.shuffle.partitions).
FAN_IN, HELD_ROWS, ROW_GROUP_BYTES, BUCKET_ROWS = 512, 262_144, 4 << 20, 20_000


class LoserTree:
    """Tournament tree over k cursors: ``winner`` is the cursor with the least head. Inner nodes
    hold the loser of their match, so after the winner moves only its path is played again."""

    def __init__(self, heads: list) -> None:
        self.k = len(heads)
        self.heads = heads
        self.losers = [-1] * self.k
        self.winner = self._play(1) if self.k > 1 else 0

    def _less(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        if y is None:
            return x is not None or a < b
        return x is not None and (x, a) < (y, b)

    def _play(self, node: int) -> int:
        if node >= self.k:
            return node - self.k
        a, b = self._play(2 * node), self._play(2 * node + 1)
        win, lose = (a, b) if self._less(a, b) else (b, a)
        self.losers[node] = lose
        return win

    def replace(self, head: object) -> None:
        """Gives the winner's cursor its next head (None at its end) and finds the new winner."""
        win = self.winner
        self.heads[win] = head
        node = (win + self.k) // 2
        while node >= 1:
            other = self.losers[node]
            if self._less(other, win):
                self.losers[node], win = win, other
            node //= 2
        self.winner = win


class Run:
    """A cursor over a sorted run that comes in batches of rows (tuples that begin with bucket and the group's two keys)."""

    def __init__(self, batches: Iterator[list[tuple]]) -> None:
        self.batches = batches
        self.rows: list[tuple] = []
        self.at = 0
        self._load()

    def _load(self) -> None:
        self.rows, self.at = next(self.batches, []), 0
        # for every row, where the next group starts in this batch
        self.next_group, end = [0] * len(self.rows), len(self.rows)
        for i in range(len(self.rows) - 1, -1, -1):
            if i + 1 < len(self.rows) and self.rows[i][:3] != self.rows[i + 1][:3]:
                end = i + 1
            self.next_group[i] = end

    def head(self) -> tuple | None:
        return self.rows[self.at] if self.at < len(self.rows) else None

    def advance(self) -> None:
        self.at += 1
        if self.at == len(self.rows):
            self._load()

    def seek(self) -> None:
        """To the next group."""
        group = self.rows[self.at][:3]
        while self.rows and self.rows[self.at][:3] == group:
            self.at = self.next_group[self.at]
            if self.at == len(self.rows):
                self._load()


def merge_runs(runs: list[Iterator[list[tuple]]], n: int) -> Iterator[tuple]:
    """The first n rows of each group, of runs of (bucket, algorithm, asset, -similarity, distance, item)
    sorted ascending, each in batches; yields (rank, row)."""
    cursors = [c for c in map(Run, runs) if c.rows]
    if not cursors:
        return
    tree = LoserTree([c.head() for c in cursors])
    group, out = None, 0
    while (row := tree.heads[tree.winner]) is not None:
        c = cursors[tree.winner]
        if row[:3] != group:
            group, out = row[:3], 0
        if out < n:
            out += 1
            yield out, row
            c.advance()
        else:
            c.seek()
        tree.replace(c.head())


def _cut(n: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, seen = None, 0
        for b in batches:
            if not b.num_rows:
                continue
            a, x = b.column(1), b.column(2)
            new = np.ones(b.num_rows, bool)
            new[1:] = pc.or_(pc.not_equal(a.slice(1), a.slice(0, len(a) - 1)), pc.not_equal(x.slice(1), x.slice(0, len(x) - 1))).to_numpy(zero_copy_only=False)
            first = (a[0].as_py(), x[0].as_py())
            starts = np.flatnonzero(new)
            rank = np.arange(b.num_rows) - np.repeat(starts, np.diff(np.append(starts, b.num_rows)))
            if first == last:
                rank[: starts[1] if len(starts) > 1 else b.num_rows] += seen
            last, seen = (a[b.num_rows - 1].as_py(), x[b.num_rows - 1].as_py()), int(rank[-1]) + 1
            yield b.filter(pa.array(rank < n))

    return cut


def _open(path: str) -> pq.ParquetFile:
    path = path.replace("s3a://", "s3://", 1)
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    fs, name = (pyarrow.fs.LocalFileSystem(), path) if path.startswith("/") else pyarrow.fs.FileSystem.from_uri(path)
    return pq.ParquetFile(fs.open_input_file(name), pre_buffer=False)


def _cursor(path: str, low: int, high: int, rows: int) -> Iterator[list[tuple]]:
    """The rows of buckets low to high of a stored run, in batches: only row groups whose statistics reach into
    them are read."""
    file = _open(path)
    try:
        at = file.schema_arrow.get_field_index("bucket")
        groups = []
        for i in range(file.metadata.num_row_groups):
            s = file.metadata.row_group(i).column(at).statistics
            if s is None or not s.has_min_max or (s.min <= high and low <= s.max):
                groups.append(i)
        for b in file.iter_batches(batch_size=rows, row_groups=groups) if groups else ():
            b = b.filter(pc.and_(pc.greater_equal(b.column(at), low), pc.less_equal(b.column(at), high)))
            if b.num_rows:
                bucket, alg, asset, sim, dist, item = b.columns
                yield list(zip(bucket.to_pylist(), alg.to_pylist(), asset.to_pylist(), pc.negate(sim).to_pylist(), pc.fill_null(dist.cast(pa.int64()), NO_DISTANCE).to_pylist(), item.to_pylist()))
    finally:
        file.close()


def _merge(n: int, paths, ranked: bool):
    """Merges, for each task (low, high, first, last), the buckets low to high of the runs paths[first:last]: to
    results, or to a longer run."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for low, high, first, last in zip(*[c.to_pylist() for c in b.columns]):
                size, out = max(16, HELD_ROWS // max(1, last - first)), []
                for row in merge_runs([_cursor(p, low, high, size) for p in paths.value[first:last]], n):
                    out.append(row)
                    if len(out) == 10_000:
                        yield _batch(out, ranked)
                        out.clear()
                if out:
                    yield _batch(out, ranked)

    return merge


def _batch(rows: list[tuple[int, tuple]], ranked: bool) -> pa.RecordBatch:
    bucket, alg, asset, sim, dist, item = zip(*[r for _, r in rows])
    sim, dist = [-s for s in sim], [None if d == NO_DISTANCE else d for d in dist]
    columns, schema = ([alg, asset, [k for k, _ in rows], item, sim, dist], OUT) if ranked else ([bucket, alg, asset, sim, dist, item], RUN_ARROW)
    return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(columns, schema)], schema=schema)


def _store(runs: DataFrame, scratch: Scratch) -> tuple[dict[int, str], int]:
    """Writes one file per task; their paths by task, and their rows. Tasks without rows have no file, or an empty one."""
    written = scratch.store(runs, "runs", options={"parquet.block.size": ROW_GROUP_BYTES, "parquet.page.size": 1 << 16})
    return {int(re.search(r"part-(\d+)-[^/]*$", f)[1]): f for f in scratch.files(written)}, written.count()


def _tasks(spark: SparkSession, tasks: list[tuple[int, int, int, int]]) -> DataFrame:
    """One partition for each task."""
    rows = spark.createDataFrame([(i, *t) for i, t in enumerate(tasks)], "i int, low int, high int, first int, last int")
    return rows.repartitionById(max(1, len(tasks)), "i").select("low", "high", "first", "last")


def top_matches(edges: DataFrame, n: int, scratch: Scratch) -> DataFrame:
    """The first n of each (algorithm_id, asset_id) by similarity descending, distance ascending
    (null last), other_asset_id ascending, numbered from 1.

    ``edges`` has one row per (algorithm_id, asset_id, other_asset_id), as ``current_edges`` gives
    it: no null in these columns or in similarity. Groups of fewer rows give what they have; an
    empty table gives no rows; other columns are ignored."""
    spark = edges.sparkSession
    buckets = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    lean = edges.select(F.pmod(F.xxhash64(*KEYS), F.lit(buckets)).cast("int").alias("bucket"), *KEYS, "similarity", "distance", "other_asset_id")
    runs = lean.sortWithinPartitions("bucket", *KEYS, F.desc("similarity"), F.col("distance").asc_nulls_last(), "other_asset_id").mapInArrow(_cut(n), RUN)
    files, rows = _store(runs, scratch)
    # small tables take several buckets to a task
    parts = max(1, min(buckets, -(-rows // BUCKET_ROWS)))
    ranges = [(buckets * i // parts, buckets * (i + 1) // parts - 1) for i in range(parts)]
    paths = list(files.values())
    tasks = [(lo, hi, 0, len(paths)) for lo, hi in ranges]
    while any(t[3] - t[2] > FAN_IN for t in tasks):
        cut = [[(lo, hi, i, min(last, i + FAN_IN)) for i in range(first, last, FAN_IN)] for lo, hi, first, last in tasks]
        files, _ = _store(_tasks(spark, [t for of in cut for t in of]).mapInArrow(_merge(n, spark.sparkContext.broadcast(paths), False), RUN), scratch)
        paths, tasks, number = [], [], 0
        for (lo, hi), of in zip(ranges, cut):
            first = len(paths)
            paths += [files[i] for i in range(number, number + len(of)) if i in files]
            tasks.append((lo, hi, first, len(paths)))
            number += len(of)
    return _tasks(spark, tasks).mapInArrow(_merge(n, spark.sparkContext.broadcast(paths), True), RESULT)
