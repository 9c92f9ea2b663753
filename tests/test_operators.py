from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from twinmesh.functions import hashing
from twinmesh.operators import exact, hamming, mutations, reads, skew
from twinmesh.operators import components as components_module
from twinmesh.operators.components import components
from twinmesh.session import Scratch

EDGE = "project_id string, algorithm_id int, asset_id string, other_asset_id string, distance int, similarity double"
HASH = "project_id string, algorithm_id int, asset_id string, sequence_index int, hash string"


def edges(spark, pairs, alg=1):
    return spark.createDataFrame([("p", alg, a, b, 0, s) for a, b, s in pairs], EDGE)


def test_exact_stats(spark):
    rows = [("p", 1, a, 0, h) for h, many in (("aa", "abc"), ("bb", "de"), ("cc", "f")) for a in many] + [("q", 1, "z", 0, "aa"), (None, 1, "n", 0, "aa"), ("p", 1, "a", 1, "aa")]
    h = spark.createDataFrame(rows, HASH)
    s = exact.stats(h).collect()
    assert [(r.project_id, r.cluster_count, r.edge_count, r.assets_with_duplicate_count) for r in s] == [("p", 2, 4, 5)]
    assert exact.matches_of(h, h.where("asset_id = 'a'")).count() == 4
    assert exact.stats(h.where("false")).count() == 0
    assert {(r.asset_id, r.links) for r in exact.memberships(h).collect()} == {("a", 2), ("b", 2), ("c", 2), ("d", 1), ("e", 1)}


@pytest.mark.parametrize(("bits", "d_max"), [(64, 3), (256, 12), (144, 8), (2048, 4)])
def test_near_ways_agree(spark, bits, d_max):
    rng = random.Random(bits)
    base = [rng.getrandbits(bits) for _ in range(12)]
    values = base + [b ^ sum(1 << p for p in rng.sample(range(bits), rng.randint(0, d_max + 3))) for b in base for _ in range(4)]
    rows = [("p" if i % 3 else "q", 3, f"a{i}", 0, f"{v:0{bits // 4}x}") for i, v in enumerate(values)] + [("p", 3, "bad", 0, "xyz"), ("p", 3, "null", 0, None), ("p", 3, "short", 0, "ff")]
    h = spark.createDataFrame(rows, HASH)
    t = 100 - 100 * d_max / bits
    got = {w: {(r.project_id, r.hash, r.other_hash, r.distance) for r in hamming.class_edges(h, bits, t, Scratch(spark, "t"), bands=w, block=16).collect()} for w in (0, None, d_max // 2, d_max + 1)}
    from twinmesh.functions.hashing import similarity_of

    want = set()
    for p in "pq":
        mine = sorted({r[4] for r in rows if r[0] == p and r[4] and len(r[4]) == bits // 4})
        want |= {(p, a, b, d) for a in mine for b in mine if a < b and similarity_of(d := (int(a, 16) ^ int(b, 16)).bit_count(), bits) >= round(t, 6)}
    assert all(x == want for x in got.values()) and want


def test_wide_band_values_are_refined(spark, monkeypatch):
    monkeypatch.setattr(hamming, "WIDE", 3)
    rng = random.Random(5)
    # all share the first 200 bits, so most bands are wide
    values = {(1 << 255) | rng.getrandbits(40) for _ in range(60)}
    h = spark.createDataFrame([("p", 3, f"a{i}", 0, f"{v:064x}") for i, v in enumerate(sorted(values))], HASH)
    got = {(r.hash, r.other_hash) for r in hamming.class_edges(h, 256, 95.0, Scratch(spark, "t"), bands=13).collect()}
    hs = [f"{v:064x}" for v in values]
    assert got == {(a, b) for a in hs for b in hs if a < b and (int(a, 16) ^ int(b, 16)).bit_count() <= 12}


def test_balls_lose_nothing_in_wide_values(spark, monkeypatch):
    monkeypatch.setattr(hamming, "WIDE", 3)
    rng = random.Random(8)
    values = sorted({(1 << 63) | rng.getrandbits(18) for _ in range(150)})  # the high bands are the same for all
    h = spark.createDataFrame([("p", 5, f"a{i}", 0, f"{v:016x}") for i, v in enumerate(values)], HASH)
    got = [(r.hash, r.other_hash, r.distance) for r in hamming.class_edges(h, 64, 90.0, Scratch(spark, "t"), bands=4).collect()]
    hs = [f"{v:016x}" for v in values]
    want = {(a, b, d) for a in hs for b in hs if a < b and (d := (int(a, 16) ^ int(b, 16)).bit_count()) <= 6}
    assert set(got) == want and len(got) == len(want) and want


def test_plans_by_bits_distance_and_size():
    assert hamming.plan(256, 12, 10) == 13 and hamming.plan(64, 3, 10) == 4
    assert hamming.plan(256, 25, 100_000) is None and 1 < hamming.plan(256, 25, 10**8) < 26
    assert hamming.plan(256, 25, hamming.least_for_balls(256, 25)) and hamming.plan(256, 25, hamming.least_for_balls(256, 25) // 4) is None


def test_large_scopes_go_by_balls(spark, monkeypatch):
    monkeypatch.setattr(hamming, "ROW_NS", 0.001)  # so that any scope is large enough
    rng = random.Random(9)
    base = [rng.getrandbits(64) for _ in range(30)]
    rows = [(p, 5, f"{b ^ sum(1 << i for i in rng.sample(range(64), d)):016x}") for p in "pq" for b in base for d in (0, 4, 6, 7)]
    hashes = spark.createDataFrame(rows, "project_id string, algorithm_id int, hash string")
    algorithms = spark.createDataFrame([(5, "hamming", 64)], "algorithm_id int, comparison string, bits int")
    projects = spark.createDataFrame([("p", 90.0), ("q", 80.0)], "project_id string, hamming_threshold double")
    got = {(r.project_id, r.hash, r.other_hash) for r in hamming.project_edges(hashes, algorithms, projects, 85.0, Scratch(spark, "t")).collect()}
    want = set()
    for p, t in (("p", 90.0), ("q", 80.0)):
        mine = sorted({r[2] for r in rows if r[0] == p})
        want |= {(p, a, b) for a in mine for b in mine if a < b and hashing.similarity_of((int(a, 16) ^ int(b, 16)).bit_count(), 64) >= t}
    assert got == want and want


def test_edges_of_some_assets(spark):
    rng = random.Random(10)
    rows = [(p, 5, f"{p}{i}", k, f"{rng.choice([0, 7, 255, 2**40]) ^ rng.getrandbits(3):016x}") for p in "pq" for i in range(20) for k in range(2)]
    h = spark.createDataFrame([*rows, ("p", 5, "bad", 0, "zz")], HASH)
    ids = spark.createDataFrame([("p1",), ("q2",), ("bad",), ("none",)], "asset_id string")
    whole = {tuple(r) for r in hamming.asset_edges(h, hamming.class_edges(h, 64, 90.0, Scratch(spark, "t"))).collect()}
    got = [tuple(r) for r in hamming.edges_of(h, ids, 64, 90.0).select(*EDGE.replace(" string", "").replace(" int", "").replace(" double", "").split(", ")).collect()]
    assert set(got) == {r for r in whole if {"p1", "q2"} & {r[2], r[3]}} and len(got) == len(set(got)) > 0


def test_match_counts(spark):
    rng = random.Random(11)
    rows = [("p", 2, f"a{i:02}", k, rng.choice(["hot"] * 3 + [f"h{j}" for j in range(12)])) for i in range(60) for k in range(3)] + [("p", 2, f"c{i}", 0, "copy") for i in range(9)] + [("q", 2, "z", 0, "hot"), ("p", 8, "a00", 0, "hot"), ("p", 2, "n", 0, None)]
    h = spark.createDataFrame(rows, HASH)
    got = {(r.project_id, r.algorithm_id, r.asset_id): r.duplicate_count for r in exact.match_counts(h).collect()}
    want: dict = {}
    for a in rows:
        for b in rows:
            if a[:2] == b[:2] and a[4] is not None and a[4] == b[4] and a[2] != b[2]:
                want.setdefault(a[:3], set()).add(b[2])
    assert got == {k: len(v) for k, v in want.items()}
    assert exact.match_counts(h.where("false")).count() == 0


def test_best_frame(spark):
    z, d1, d8 = "0" * 16, "0" * 15 + "1", "0" * 14 + "ff"
    h = spark.createDataFrame([("p", 5, "a", 0, z), ("p", 5, "a", 1, d8), ("p", 5, "b", 0, d1)], HASH)
    e = hamming.asset_edges(h, hamming.class_edges(h, 64, 85, Scratch(spark, "t"))).orderBy("asset_id").collect()
    assert [(r.asset_id, r.other_asset_id, r.distance, r.similarity) for r in e] == [("a", "b", 1, 98.4), ("b", "a", 1, 98.4)]
    assert hamming.class_edges(h, 64, 100.1, Scratch(spark, "t")).count() == 0


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


def test_components_of_chains_stars_and_noise(spark, monkeypatch):
    rng = random.Random(3)
    pairs = [(f"c{i:03}", f"c{i + 1:03}") for i in range(150)] + [("hub", f"s{i:03}") for i in range(300)] + [(f"r{rng.randint(0, 99):02}", f"r{rng.randint(0, 99):02}") for _ in range(70)]
    df = edges(spark, [(a, b, 95.0) for a, b in pairs] + [("x", "x", 99.0), (None, "y", 99.0)])
    got = {r.asset_id: r.cluster_id for r in components(df, ["project_id", "algorithm_id"], Scratch(spark, "t")).collect()}
    assert got == union_find([p for p in pairs if p[0] != p[1]])
    monkeypatch.setattr(components_module, "LAST_LINKS", 0)  # by rounds alone, and with hubs apart
    for hubs in (10**6, 0):
        monkeypatch.setattr(components_module, "HUBS_FROM", hubs)
        assert got == {r.asset_id: r.cluster_id for r in components(df, ["project_id", "algorithm_id"], Scratch(spark, "t")).collect()}
    assert components(df.where("false"), ["project_id"], Scratch(spark, "t")).count() == 0


def test_ranking_and_pages(spark):
    assets = spark.createDataFrame([(x, "p", x.upper() if x != "c" else None, f"/library/{'invoice-2024' if x == 'a' else 'photo'}.pdf") for x in "abcd"], "asset_id string, project_id string, identity_id string, identity_path string")
    e = exact.both_ways(edges(spark, [("a", "b", 98.4), ("a", "c", 87.5)]))
    r, info = reads.paged(reads.ranking(e, assets, 80), reads.ranking_order(), 1, 2)
    assert [x.asset_id for x in r.collect()] == ["a", "b"] and (info.total_count, info.has_next_page, info.page_count) == (3, True, 2)
    assert [x.asset_id for x in reads.ranking(e, assets, 80, path_term="*invoice*").collect()] == ["a"]
    nested = reads.ranking_with_matches(e, assets, 80, 1).where("asset_id = 'a'").first()
    assert nested.duplicate_count == 2 and [m.identity.id for m in nested.matches] == ["B"]
    assert reads.edges_by_project(e, assets, 80).count() == 2
    assert reads.edges_by_assets(e, assets, assets.where("false"), 80).count() == 0
    assert reads.paged(reads.ranking(e, assets, 80), reads.ranking_order(), 9, 2)[0].count() == 0


def test_identity_patches(spark):
    assets = spark.createDataFrame([("1", "p", "a", "/a"), ("2", "p", None, "/b"), ("3", "p", "c", None)], "asset_id string, project_id string, identity_id string, identity_path string")
    rows = [("p", "a", None), ("p", None, "/b"), ("p", "n", "/n"), ("q", "a", None), ("p", "c", "/a"), ("p", None, None)]
    got = {(r.project_id, r.identity_id, r.identity_path): (r.asset_id, r.status) for r in mutations.patch_identities(assets, spark.createDataFrame(rows, "project_id string, identity_id string, identity_path string")).collect()}
    assert got[("p", None, "/b")] == ("2", "patched") and got[("p", "n", "/n")] == (None, "created") and got[("q", "a", None)] == (None, "created")
    assert got[("p", "c", "/a")][1] == "conflict" and got[("p", None, None)][1] == "conflict" and got[("p", "a", "/a")] == ("1", "patched")
    cleared = mutations.patch_identities(assets, spark.createDataFrame([("p", "a", "")], "project_id string, identity_id string, identity_path string")).first()
    assert (cleared.asset_id, cleared.identity_id, cleared.identity_path) == ("1", "a", None)


def test_hash_statuses_and_replacement(spark):
    stored = spark.createDataFrame([("p", 1, "a", 0, "x"), ("p", 1, "b", 0, "x"), ("p", 1, "b", 1, "y")], HASH)
    answers = spark.createDataFrame([("p", "a", 1, ["x"]), ("p", "b", 1, ["y", "x"]), ("p", "c", 1, ["z"]), ("p", "d", 1, [])], "project_id string, asset_id string, algorithm_id int, hashes array<string>")
    got = {r.asset_id: r.status for r in mutations.hash_statuses(stored, answers).collect()}
    assert got == {"a": "unchanged", "b": "updated", "c": "created", "d": "unchanged"}
    after = {(r.asset_id, r.sequence_index, r.hash) for r in mutations.replace_hashes(stored, answers).collect()}
    assert after == {("a", 0, "x"), ("b", 0, "y"), ("b", 1, "x"), ("c", 0, "z")}


def test_key_states_split_heavy_keys(spark):
    rng = random.Random(1)
    rows = [("hot" if i % 3 == 0 else rng.choice(["a", "b", None, ""]), f"s{rng.randint(0, 400)}" if i % 7 else None, i) for i in range(4000)]
    df = spark.createDataFrame(rows, "k string, s string, v long").select("k", "s", F.timestamp_seconds("v").alias("v"), F.lit(1).alias("key"), F.lit(2).alias("part"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {r.key: (r.n_rows, r.n_second, r.min_value.timestamp(), r.max_value.timestamp()) for r in skew.key_states(df, "k", "s", "v", Scratch(spark, "t")).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    for k in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == k]
        assert got[k] == (len(mine), len({r[1] for r in mine}), min(r[2] for r in mine), max(r[2] for r in mine))
    states = skew.key_states(df, "k", "s", "v", Scratch(spark, "t"))
    assert [r.key for r in skew.heavy_keys(states, 0.3).collect()] == ["hot"]
    assert skew.key_states(df.where("false"), "k", "s", "v", Scratch(spark, "t")).count() == 0


def test_class_edges_at_project_thresholds(spark):
    rng = random.Random(5)
    flip = lambda h, n: f"{int(h, 16) ^ sum(1 << p for p in rng.sample(range(256), n)):064x}"
    rows = []
    for project in ("p80", "p90", "none", "unlisted"):
        base = [f"{rng.getrandbits(256):064x}" for _ in range(40)]
        rows += [(project, 3, h) for h in base + [flip(h, 5 + i) for i, h in enumerate(base)] + [flip(base[0], 51), flip(base[0], 52)]]
    rows += [("p80", 3, "ff"), ("p80", 3, None), rows[0], ("p80", 1, rows[0][2])]
    hashes = spark.createDataFrame(rows, "project_id string, algorithm_id int, hash string")
    algorithms = spark.createDataFrame([(3, "hamming", 256), (1, "exact", None)], "algorithm_id int, comparison string, bits int")
    projects = spark.createDataFrame([("p80", 80.0), ("p90", 90.0), ("none", None)], "project_id string, hamming_threshold double")
    want = set()
    for project, threshold in (("p80", 80.0), ("p90", 90.0), ("none", 85.0)):
        mine = sorted({h for p, a, h in rows if p == project and a == 3 and h and len(h) == 64})
        for i, x in enumerate(mine):
            for y in mine[i + 1 :]:
                d = (int(x, 16) ^ int(y, 16)).bit_count()
                if hashing.similarity_of(d, 256) >= threshold:
                    want.add((project, 3, x, y, d, hashing.similarity_of(d, 256)))
    assert len(want) > 90
    for block in (16, 4096):  # several blocks a scope, and one
        got = [tuple(r) for r in hamming.project_edges(hashes, algorithms, projects, 85.0, Scratch(spark, "t"), block).collect()]
        assert set(got) == want and len(got) == len(want)


def test_match_classes_stand_for_all_matches(spark):
    rng = random.Random(6)
    rows = [("p", 2, f"a{i:03}", k, "big" if k == 0 and i % 3 else f"h{rng.randrange(60)}") for i in range(120) for k in range(2)] + [("p", 8, "a000", 0, "x"), ("p", 8, "a001", 0, "x"), ("q", 2, "a001", 0, "big"), ("p", 2, "a002", 0, None)]
    hashes = spark.createDataFrame(rows, HASH)
    queries = hashes.where("asset_id in ('a000', 'a001', 'a002', 'a050')")
    got = exact.match_classes(hashes, queries).collect()
    classes: dict = {}
    for r in got:
        classes.setdefault((r.project_id, r.algorithm_id, r.hash), []).append(r)
    pairs = set()
    for (project, algorithm, _), mine in classes.items():
        assert {(r.members, r.class_id, r.queries) for r in mine} == {(len(mine), min(r.asset_id for r in mine), sum(r.wanted for r in mine))}
        for x in mine:
            pairs |= {(project, algorithm, x.asset_id, y.asset_id) for y in mine if x.wanted and y.asset_id != x.asset_id}
    want = {(r.project_id, r.algorithm_id, r.asset_id, r.other_asset_id) for r in exact.matches_of(hashes, queries).collect()}
    assert pairs | {(p, a, y, x) for p, a, x, y in pairs} == want and ("p", 8, "a000", "a001") in want
    assert max(len(m) for m in classes.values()) >= 80 and len(got) < len(want)
