from __future__ import annotations

import numpy as np
import pytest

from twinmesh.llm import similar as S
from twinmesh.session import Scratch


def brute(names, distances, limit, k):
    best: dict[str, dict[str, float]] = {}
    for i, a in enumerate(names):
        for j, b in enumerate(names):
            if a != b and distances[i, j] <= limit:
                best.setdefault(a, {})
                best[a][b] = min(best[a].get(b, np.inf), distances[i, j])
    out = set()
    for a, m in best.items():
        out |= {(min(a, b), max(a, b)) for _, b in sorted((d, b) for b, d in m.items())[:k]}
    return out


def pairs_of(df):
    return {(r.asset_id, r.other_asset_id) for r in S.as_pairs(df, 0).collect()}


def test_vectors_against_brute_force(spark):
    rng = np.random.default_rng(0)
    base = rng.standard_normal((150, 64))
    v = np.concatenate([base, base[:100] + 0.15 * rng.standard_normal((100, 64)), np.repeat(base[:1], 12, 0), 2 * base[1:3]])
    names = [f"a{i:04}" for i in range(len(v))]
    names[10] = names[11]  # one asset with two vectors
    rows = [(n, [list(map(float, x))]) for n, x in zip(names, v)]
    rows += [("bad1", [[1.0] * 63]), ("bad2", [[0.0] * 64]), ("bad3", [[float("nan")] * 64]), ("bad4", [None]), ("bad5", None), ("bad6", []), (None, [[1.0] * 64]), ("bad7", [[None] * 64]), rows[0]]
    df = spark.createDataFrame([(a, " Image.Embed64", x) for a, x in rows], "asset_id string, recipe string, vectors array<array<float>>")
    u = v.astype(np.float32).astype(float)
    u /= np.linalg.norm(u, axis=1)[:, None]
    want = brute(names, np.round(2 - 2 * u @ u.T, 7), S.COSINE.limit, 5)
    got = pairs_of(S.closest(spark, S.vector_items(df), S.COSINE, 5, Scratch(spark, "t")))
    assert len(got & want) >= 0.97 * len(want) and got <= want
    assert S.closest(spark, S.vector_items(df.where("false")), S.COSINE, 5, Scratch(spark, "t")).count() == 0


def test_hashes_against_brute_force(spark):
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2, (120, 256))
    near = base[:90].copy()
    for i, row in enumerate(near):
        row[rng.choice(256, 3 + i % 40, replace=False)] ^= 1
    bits = np.concatenate([base, near, np.repeat(base[:1], 10, 0)])
    names = [f"a{i:04}" for i in range(len(bits))]
    hexes = [bytes(np.packbits(b)).hex() for b in bits]
    rows = [(n, 3, (h.upper() if i % 2 else f" 0x{h} ")) for i, (n, h) in enumerate(zip(names, hexes))] + [("x", 3, "zz"), ("y", 3, None), ("z", 3, ""), (None, 3, hexes[0]), ("other", 1, hexes[0])]
    df = spark.createDataFrame(rows, "asset_id string, algorithm_id int, hash string")
    d = (bits[:, None, :] != bits[None, :, :]).sum(2)
    want = brute(names, d, 38, 5)
    got = pairs_of(S.closest(spark, S.hash_items(df), S.HAMMING, 5, Scratch(spark, "t")))
    assert len(got & want) >= 0.95 * len(want) and len(got - want) <= 0.03 * len(want)


def test_places_go_to_different_assets(spark):
    # 12 assets of one group, each with 4 nearly equal vectors: the 9 closest items are of 3 assets
    rng = np.random.default_rng(3)
    centre = rng.standard_normal(64)
    v = np.repeat(centre + 0.1 * rng.standard_normal((12, 64)), 4, 0)
    v = v + 0.001 * rng.standard_normal(v.shape)
    names = [f"a{i // 4:04}" for i in range(len(v))]
    df = spark.createDataFrame([(names[i], "image.embed64", [list(map(float, x)) for x in v[i : i + 4]]) for i in range(0, len(v), 4)], "asset_id string, recipe string, vectors array<array<float>>")
    u = v.astype(np.float32).astype(float)
    u /= np.linalg.norm(u, axis=1)[:, None]
    best = S.closest(spark, S.vector_items(df), S.COSINE, 5, Scratch(spark, "t"))
    assert {r["count"] for r in best.groupBy("asset_id").count().collect()} == {5} and best.select("asset_id").distinct().count() == 12
    assert pairs_of(best) == brute(names, np.round(2 - 2 * u @ u.T, 7), S.COSINE.limit, 5)


def test_shared_items_count_once_per_asset(spark):
    # frames that several assets share: places are of assets, not of items or of sets of assets
    rng = np.random.default_rng(4)
    base = rng.integers(0, 2, 256)
    bits = np.array([base] * 30)
    for i, row in enumerate(bits):
        row[rng.choice(256, 1 + i % 15, replace=False)] ^= 1
    rows = [(f"a{a:02}", bits[i]) for i in range(30) for a in {i % 9, i % 4, i // 6}]
    df = spark.createDataFrame([(a, 3, bytes(np.packbits(b)).hex()) for a, b in rows], "asset_id string, algorithm_id int, hash string")
    x = np.array([b for _, b in rows])
    want = brute([a for a, _ in rows], (x[:, None, :] != x[None, :, :]).sum(2), 38, 5)
    assert pairs_of(S.closest(spark, S.hash_items(df), S.HAMMING, 5, Scratch(spark, "t"))) == want


def test_early_abandoning_equals_full_scan():
    rng = np.random.default_rng(2)
    x = rng.standard_normal((5000, 64)).astype(np.float32)
    x[2500:] = x[:2500] + 0.1 * rng.standard_normal((2500, 64)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1)[:, None]
    x = (x @ S.rotation()).astype(np.float32)
    ids = np.arange(5000)
    row, col, dist = S.ColumnBlocks(S.COSINE, x).search(x[:200], ids[:200], ids, 3)
    full = 2 - 2 * x[:200].astype(float) @ x.T.astype(float)
    full[np.arange(200), np.arange(200)] = 9
    want = {(i, int(j)) for i in range(200) for j in np.argsort(full[i])[:3] if full[i, j] <= S.COSINE.limit}
    got = set(zip(row.tolist(), col.tolist()))
    assert len(got & want) >= 0.97 * len(want)
    assert np.allclose(dist, full[row, col], atol=1e-5)


@pytest.mark.parametrize("n", [1, 2, 3, 7, 64, 1000])
def test_lists_cover_every_point(n):
    rng = np.random.default_rng(n)
    p = rng.standard_normal((50, 64)).astype(np.float32)
    p /= np.linalg.norm(p, axis=1)[:, None]
    c = S.fit(S.COSINE, p, min(n, 50))
    row, at = S.nearest_lists(S.COSINE, p, c)
    assert set(row.tolist()) == set(range(50)) and at.max() < len(c)
    assert (at[np.unique(row, return_index=True)[1]] == (p @ c.T).argmax(1)).all()


def test_blocks_and_parts_of_a_list_meet_once(spark, monkeypatch):
    # lists of several blocks, whose queries are cut into parts: the same pairs as in one task
    rng = np.random.default_rng(6)
    base = rng.standard_normal((40, 64))
    v = np.concatenate([base + 0.1 * rng.standard_normal(base.shape) for _ in range(8)])
    df = spark.createDataFrame([(f"a{i:04}", "image.embed64", [list(map(float, x))]) for i, x in enumerate(v)], "asset_id string, recipe string, vectors array<array<float>>")
    whole = pairs_of(S.closest(spark, S.vector_items(df), S.COSINE, 5, Scratch(spark, "t")))
    monkeypatch.setattr(S, "BLOCK", 16)
    monkeypatch.setattr(S, "PARTS", 2)
    cut = S.closest(spark, S.vector_items(df), S.COSINE, 5, Scratch(spark, "t"))
    assert pairs_of(cut) == whole and len(whole) > 500
    assert cut.groupBy("asset_id", "other_asset_id").count().where("count > 1").count() == 0


def test_copies_of_a_heavy_item(spark):
    rows = [(f"a{i:03}", 3, f"{7:064x}") for i in range(40)] + [(f"b{i:03}", 3, f"{1 << 200 | i:064x}") for i in range(3)] + [(f"c{i:03}", 3, f"{3 << 90:064x}") for i in range(9)]
    df = spark.createDataFrame(rows, "asset_id string, algorithm_id int, hash string")
    bits = np.array([[int(b) for b in f"{int(h, 16):0256b}"] for _, _, h in rows])
    want = brute([a for a, _, _ in rows], (bits[:, None, :] != bits[None, :, :]).sum(2), 38, 5)
    assert pairs_of(S.closest(spark, S.hash_items(df), S.HAMMING, 5, Scratch(spark, "t"))) == want


def test_probes_grow_with_the_lists():
    rng = np.random.default_rng(0)
    for n, m in ((500, 12), (2_000, 12), (6_485, 16), (20_000, 21)):
        c = S.points(S.HAMMING, rng.integers(0, 256, (n, 32), np.uint8))
        row, _ = S.nearest_lists(S.HAMMING, S.points(S.HAMMING, rng.integers(0, 256, (5, 32), np.uint8)), c)
        assert np.bincount(row).max() <= m and np.bincount(row).mean() > 0.8 * m
