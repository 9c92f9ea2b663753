"""Groups, history and top-N against plain versions on small fixtures."""

from __future__ import annotations

import datetime as dt
import random
import uuid

import pytest

from tests import oracle
from twinmesh.llm import groups as G
from twinmesh.llm import history as H
from twinmesh.llm import queries as Q
from twinmesh.llm import topn as N
from twinmesh.session import Scratch

LINK = "algorithm_id int, asset_id string, other_asset_id string, key string"


def union_find(pairs):
    par = {}

    def f(x):
        par.setdefault(x, x)
        while par[x] != x:
            x = par[x]
        return x

    for a, b in pairs:
        x, y = sorted((f(a), f(b)))
        par[y] = x
    return {x: f(x) for x in par}


def test_groups_of_giants_chains_and_ties(spark):
    rng = random.Random(4)
    pairs = [("hub", f"s{i:03}") for i in range(200)] + [(f"s{i:03}", f"t{i:03}") for i in range(60)] + [("t000", "zub")] + [("zub", f"z{i:03}") for i in range(150)]
    pairs += [(f"c{i:03}", f"c{i + 1:03}") for i in range(120)] + [(f"r{rng.randint(0, 80):02}", f"r{rng.randint(0, 80):02}") for _ in range(60)]
    rows = [(1, a, b, "x") for a, b in pairs] + [(2, "a", "b", None), (2, "b", "c", None), (2, "d", "d", None), (None, "a", "z", None), (2, None, "a", None), (2, "a", "b", None)]
    got = {(r.algorithm_id, r.asset_id): r.group_id for r in G.groups(spark.createDataFrame(rows, LINK), Scratch(spark, "t")).collect()}
    want = {(1, k): v for k, v in union_find([p for p in pairs if p[0] != p[1]]).items()} | {(2, x): "a" for x in "abc"}
    assert got == want
    assert G.groups(spark.createDataFrame([], LINK), Scratch(spark, "t")).count() == 0


def in_batches(rows, size):
    return iter([rows[i : i + size] for i in range(0, len(rows), size)])


@pytest.mark.parametrize("size", [1, 4, 1000])
def test_loser_tree_merges_and_seeks(size):
    rng = random.Random(7)
    for k in (1, 2, 3, 5, 8, 13):
        runs = [sorted((0, 1, rng.choice("abcd"), -rng.randint(90, 99) / 1.0, rng.randint(0, 3), f"i{rng.randint(0, 10**6)}") for _ in range(rng.randint(0, 60))) for _ in range(k)]
        want = []
        for g in "abcd":
            want += list(enumerate(sorted(r for run in runs for r in run if r[2] == g)[:3], 1))
        assert list(N.merge_runs([in_batches(r, size) for r in runs], 3)) == want
    assert list(N.merge_runs([], 3)) == []


def test_top_matches_against_sorting(spark, monkeypatch):
    rng = random.Random(8)
    rows = {(1, "hot" if i % 2 else f"g{rng.randint(0, 40)}", f"o{i:05}"): (rng.choice([90.0, 95.5, 100.0]), rng.choice([None, 0, 1, 2])) for i in range(6000)}
    df = spark.createDataFrame([(*k, *v, "x", 1) for k, v in rows.items()], "algorithm_id int, asset_id string, other_asset_id string, similarity double, distance int, run string, bucket int")
    want = set()
    for g in {k[1] for k in rows}:
        mine = sorted((-v[0], 10**9 if v[1] is None else v[1], k[2]) for k, v in rows.items() if k[1] == g)[:3]
        want |= {(1, g, i + 1, x[2]) for i, x in enumerate(mine)}
    for fan_in, held, rows_ in ((512, 262_144, 20_000), (512, 16, 40), (3, 64, 10)):  # one pass; small batches and several tasks; several passes
        monkeypatch.setattr(N, "FAN_IN", fan_in)
        monkeypatch.setattr(N, "HELD_ROWS", held)
        monkeypatch.setattr(N, "BUCKET_ROWS", rows_)
        got = [(r.algorithm_id, r.asset_id, r.rank_no, r.other_asset_id) for r in N.top_matches(df.repartition(11), 3, Scratch(spark, "t")).collect()]
        assert set(got) == want and len(got) == len(want)
    assert N.top_matches(df.where("false"), 3, Scratch(spark, "t")).count() == 0


def test_memory_of_a_merge_is_that_of_its_cursors(tmp_path, monkeypatch):
    """A run ten times as long takes no more memory."""
    import tracemalloc

    import pyarrow as pa
    import pyarrow.parquet as pq

    monkeypatch.setattr(N, "HELD_ROWS", 800)
    peaks = []
    for rows in (4_000, 40_000):
        paths = []
        for run in range(4):
            keys = sorted(f"g{i:07}" for i in range(rows))
            t = pa.table([[0] * rows, [1] * rows, keys, [90.0] * rows, [run] * rows, [f"o{run}"] * rows], schema=N.RUN_ARROW)
            pq.write_table(t, tmp_path / f"{rows}-{run}.parquet", row_group_size=2_000)
            paths.append(str(tmp_path / f"{rows}-{run}.parquet"))
        tracemalloc.start()
        n = sum(1 for _ in N.merge_runs([N._cursor(p, 0, 0, N.HELD_ROWS // 4) for p in paths], 2))
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
        assert n == 2 * rows
    assert peaks[1] < 1.3 * peaks[0]


def test_history_in_batches_equals_one_batch(spark, monkeypatch):
    rng = random.Random(9)
    base = [rng.getrandbits(256) for _ in range(20)]
    near = [b ^ sum(1 << p for p in rng.sample(range(256), d)) for b in base for d in (0, 5, 12, 13)]
    day = dt.datetime(2026, 1, 1)
    rows = [(("p" if i % 5 else "q"), 3, f"a{i:03}", f"{v:064x}", day + dt.timedelta(days=rng.randint(0, 40))) for i, v in enumerate(base + near)]
    rows += [("p", 1, f"e{i}", f"{i % 3:064x}", day + dt.timedelta(days=i)) for i in range(9)]
    rows += [("p", 3, "bad", "xx", day), ("p", 3, None, f"{base[0]:064x}", day), (None, 3, "np", f"{base[0]:064x}", day), ("p", 3, "nodate", f"{base[0]:064x}", None), ("p", 3, "empty", "", day), ("p", 3, "null", None, day), rows[0]]
    df = spark.createDataFrame(rows, "project_id string, algorithm_id int, asset_id string, hash string, created_at timestamp")
    members = Scratch(spark, "t").store(H.members_of(df, exact=1, near=3)).cache()
    cuts = [day + dt.timedelta(days=x) for x in (10, 20, 30)]
    from pyspark.sql import functions as F

    def found(width, name):
        monkeypatch.setattr(H, "WIDE_KEY", width)
        monkeypatch.setattr(H, "FOLDER_ROWS", 100)
        c = F.coalesce("created_at", F.lit(day))
        ends = [*cuts, day + dt.timedelta(days=99)]
        for i, (lo, hi) in enumerate(zip([day - dt.timedelta(days=9), *ends], ends)):
            index = H.HistoryIndex(spark, name, exact=1, near=3, d_max=12)  # opened again for every batch
            index.accept(i, members.where((c >= lo) & (c < hi)), match=i > 0)
            index.accept(i, members, match=i > 0)  # a batch that is there already stays as it is
        pairs = index.pairs(since=1).collect()
        return {(r.algorithm_id, *sorted((r.asset_id, r.o_asset))) for r in pairs}

    usable = {(r[0], r[1], r[2], int(r[3], 16), r[4]) for r in rows if r[0] and r[2] and r[3] and len(r[3]) == 64}
    want = set()
    for x in usable:
        for y in usable:
            if x[2] < y[2] and x[:2] == y[:2] and (x[3] ^ y[3]).bit_count() <= (12 if x[1] == 3 else 0) and max(x[4] or day, y[4] or day) >= cuts[0]:
                want.add((x[1], x[2], y[2]))
    assert found(1_000, uuid.uuid4().hex) == want and want
    assert found(1, uuid.uuid4().hex) == want


def test_a_probe_reads_its_own_folders_only(spark, monkeypatch):
    monkeypatch.setattr(H, "FOLDER_ROWS", 128)
    rng = random.Random(3)
    rows = lambda n, tag: [(3, "p", f"{tag}{i}", None, 5, *[rng.getrandbits(64) - 2**63 for _ in range(4)]) for i in range(n)]
    index = H.HistoryIndex(spark, uuid.uuid4().hex, exact=1, near=3, d_max=12)
    first = rows(400, "a")
    index.accept(0, spark.createDataFrame(first, H.MEMBER), match=False)
    index.accept(1, spark.createDataFrame(rows(3200, "b"), H.MEMBER), match=False)
    batch = spark.createDataFrame([(*first[7][:2], "c", None, 5, first[7][5] ^ 0b111, *first[7][6:])], H.MEMBER)
    read = index.hits(index.band_keys(batch.select(*H.SIGNATURE)), index.segments)[1]
    # one signature has 13 keys: 13 folders at most, while the folders follow the history
    assert read[0][0] <= 13 and read[1][0] <= 13 and read[0][1] == 64 and read[1][1] == 512
    index.accept(2, batch)
    assert {(r.asset_id, r.o_asset) for r in index.pairs(since=2).collect()} == {("c", "a7")}


def test_a_batch_that_was_cut_off_is_accepted_again(spark, monkeypatch):
    name = uuid.uuid4().hex
    index = H.HistoryIndex(spark, name, exact=1, near=3, d_max=12)
    members = spark.createDataFrame([(1, "p", x, None, 5, 1, 2, 3, 4) for x in "ab"], H.MEMBER)
    monkeypatch.setattr(index, "_publish", lambda m: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        index.accept(0, members)
    again = H.HistoryIndex(spark, name, exact=1, near=3, d_max=12)
    assert not again.segments
    again.accept(0, members)
    assert {(r.asset_id, r.o_asset) for r in again.pairs(since=0).collect()} == {("a", "b"), ("b", "a")}
    assert again.pairs(since=1).count() == 0


def test_found_queries_against_sql(spark):
    con = oracle.connect("sf0.001")
    for name, sql in Q.oracle_sql().items():
        assert oracle.spark_rows(Q.queries()[name](spark, f"{oracle.DATA}/sf0.001")) == oracle.sql_rows(con, sql), name
