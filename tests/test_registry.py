from __future__ import annotations

import datetime as dt
import random

import pytest

from twinmesh.errors import AlgorithmContract, AlreadyExists, Conflict, Forbidden, Invalid, NotFound, Unauthorized
from twinmesh.plans.registry import Catalogue, Registry
from twinmesh.plans.state import EdgeState
from twinmesh.schema import EDGES
from twinmesh.sources import files

NOW = dt.datetime(2026, 1, 31, tzinfo=dt.timezone.utc)
ANSWERS = "identity_id string, identity_path string, recipe string, hashes array<string>"
Z, D1, D4, D8 = "0" * 16, "0" * 15 + "1", "0" * 15 + "f", "0" * 14 + "ff"


@pytest.fixture
def registry(spark, tmp_path):
    c = Catalogue()
    c.create_project("demo", "Demo", ["binary.sha256", "text.simhash64", "image.embed64"], 85.0, project_id="p")
    c.algorithm("binary.sha256", "exact")
    c.algorithm("text.simhash64", "hamming", 64)
    return Registry(spark, str(tmp_path), c)


def test_ingest_reads_and_delete(spark, registry):
    rows = [("a", "/x/a.txt", "text.simhash64", [Z]), ("b", None, "text.simhash64", [D1]), (None, "/x/c.txt", "text.simhash64", [D4]), ("d", None, "text.simhash64", ["f" * 16]), ("a", "/x/a.txt", "binary.sha256", ["11"]), ("b", None, "binary.sha256", ["11"])]
    first = registry.ingest("p", spark.createDataFrame(rows, ANSWERS), NOW).collect()
    assert {r.status for r in first} == {"created"} and len(first) == 6
    page, info = registry.matches("p", "text.simhash64", id_="a")
    assert [(r.identity.id, r.distance, r.similarity) for r in page.collect()] == [("b", 1, 98.4), (None, 4, 93.8)] and info.total_count == 2
    ranked, _ = registry.ranking("p", "text.simhash64", match_limit="1")
    got = ranked.collect()
    assert [(r.identity_id, r.duplicate_count, len(r.matches)) for r in got] == [("a", 2, 1), ("b", 2, 1), (None, 2, 1)]
    clusters, info, g = registry.clusters("p", "text.simhash64", path="*c.txt")
    (one,) = clusters.collect()
    assert len(one.assets) == 3 and one.max_similarity == 98.4 and g == 1
    stats = registry.stats("p", NOW)
    by = {s["recipe"]: s for s in stats["duplicates_per_recipe"]}
    assert by["binary.sha256"]["edge_count"] == 1 and by["text.simhash64"]["cluster_count"] == 1 and by["text.simhash64"]["assets_with_duplicate_pct"] == 75.0
    assert by["image.embed64"]["cluster_count"] == 0 and not by["image.embed64"]["degraded"]
    assert registry.recipes("p", id_="a") == ["binary.sha256", "text.simhash64"]
    again = registry.ingest("p", spark.createDataFrame([rows[0], ("b", None, "text.simhash64", [D8])], ANSWERS), NOW)
    assert {r.identity_id: r.status for r in again.collect()} == {"a": "unchanged", "b": "updated"}
    registry.delete_asset("p", id_="a")
    registry.delete_asset("p", id_="a")
    with pytest.raises(NotFound):
        registry.matches("p", "text.simhash64", id_="a")
    assert registry.state.edges("p", 1).count() == 0
    with pytest.raises(AlgorithmContract):
        registry.ingest("p", spark.createDataFrame([("z", None, "no.such", ["1"])], ANSWERS), NOW)


def test_identity_conflict_refuses_the_batch(spark, registry):
    registry.ingest("p", spark.createDataFrame([("a", None, "binary.sha256", ["1"]), (None, "/b", "binary.sha256", ["2"])], ANSWERS), NOW)
    with pytest.raises(AlreadyExists):
        registry.ingest("p", spark.createDataFrame([("a", "/b", "binary.sha256", ["1"])], ANSWERS), NOW)
    assert registry.assets.count() == 2


def test_scopes_and_clients(registry):
    with pytest.raises(Invalid):
        registry.scope("p", "audio.chroma45")
    with pytest.raises(Invalid):
        registry.scope("p", "image.embed64")
    assert registry.scope("p", "binary.sha256", "50")[2:] == (50.0, True)
    c = registry.catalogue
    client, key = c.create_client("p", "reader", ["read"], NOW)
    assert c.authenticate(key, "read").slug == "demo"
    with pytest.raises(Forbidden):
        c.authenticate(key, "write")
    with pytest.raises(AlreadyExists):
        c.create_client("p", "reader", ["read"], NOW)
    c.revoke_client(client.client_id, NOW)
    with pytest.raises(Unauthorized):
        c.authenticate(key, "read")
    c.create_client("p", "reader", ["*"], NOW)
    with pytest.raises(AlgorithmContract):
        c.algorithm("binary.sha256", "hamming")
    with pytest.raises(AlreadyExists):
        c.create_project("demo", "x", ["binary.sha256"])


def test_generations_pins_and_retention(spark, tmp_path):
    now = [0.0]
    state = EdgeState(spark, str(tmp_path), clock=lambda: now[0])
    rows = lambda *pairs: spark.createDataFrame([("p", 3, x, y, 1, 98.4, None) for a, b in pairs for x, y in ((a, b), (b, a))], "project_id string, algorithm_id int, asset_id string, other_asset_id string, distance int, similarity double, computed_at timestamp")
    assert state.generation("p", 3) == 0 and state.clusters("p", 3, 90)[0].count() == 0
    g = state.replace("p", 3, rows(("a", "b")))
    members, at = state.clusters("p", 3, 90.04)
    assert at == g and {(r.asset_id, r.cluster_id, r.avg_similarity) for r in members.collect()} == {("a", "a", 98.4), ("b", "a", 98.4)}
    g2 = state.replace("p", 3, rows(("a", "b"), ("b", "c")))
    assert g2 > g and state.clusters("p", 3, 90, generation=g)[0].count() == 2 and state.clusters("p", 3, 90)[0].count() == 3
    with pytest.raises(NotFound):
        state.clusters("p", 3, 90, generation=999)
    now[0] = 7200.0
    state.vacuum("p", 3)
    with pytest.raises(NotFound):
        state.clusters("p", 3, 90, generation=g)
    assert state.clusters("p", 3, 90)[0].count() == 3
    capped = EdgeState(spark, str(tmp_path), cap=1)
    assert capped.stats("p", 3, 98.4) is None
    with pytest.raises(Invalid):
        capped.clusters("p", 3, 50)


def test_file_scan(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "a.txt").write_bytes(b"one\n\ntwo\n")
    (tmp_path / "b.txt").write_bytes(b"one\n\ntwo\n")
    (tmp_path / "noext").write_bytes(b"x")
    (tmp_path / ".hidden.txt").write_bytes(b"x")
    found = files.scan(spark, str(tmp_path))
    assert {(r.identity_path.rsplit("/", 1)[1], r.mime_hint, r.error is None) for r in found.collect()} == {("a.txt", "txt", True), ("b.txt", "txt", True), ("noext", None, False)}
    rows = files.hashed(found, ["binary.sha256", "text.line_sha256"]).collect()
    assert len(rows) == 4 and len({tuple(r.hashes) for r in rows if r.recipe == "binary.sha256"}) == 1
    assert {len(r.hashes) for r in rows if r.recipe == "text.line_sha256"} == {2}
    with pytest.raises(Invalid):
        files.hashed(found, ["nope"])


def test_streaming_ingest(spark, registry, tmp_path):
    from twinmesh.streaming.ingest import ingest_stream

    spark.createDataFrame([("s", None, "binary.sha256", ["9"]), ("t", None, "binary.sha256", ["9"])], ANSWERS).write.parquet(str(tmp_path / "in"))
    q = ingest_stream(registry, "p", spark.readStream.schema(ANSWERS).parquet(str(tmp_path / "in")), str(tmp_path / "cp"))
    q.awaitTermination(120)
    assert registry.matches("p", "binary.sha256", id_="s")[1].total_count == 1


def test_a_registry_is_opened_again(spark, registry, tmp_path):
    rows = [("a", "/x/a.txt", "text.simhash64", [Z]), ("b", None, "text.simhash64", [D1]), ("a", "/x/a.txt", "binary.sha256", ["11"]), ("b", None, "binary.sha256", ["11"])]
    registry.ingest("p", spark.createDataFrame(rows, ANSWERS), NOW)
    client, key = registry.catalogue.create_client("p", "reader", ["read"], NOW)
    registry.save()
    again = Registry(spark, str(tmp_path))
    assert again.catalogue == registry.catalogue and again.catalogue.authenticate(key, "read").slug == "demo"
    assert again.assets.count() == 2 and again.hashes.count() == 4
    assert again.matches("p", "text.simhash64", id_="a")[1].total_count == 1
    assert [r.hash for r in again.hash_rows("p", "text.simhash64", id_="a").collect()] == [Z]
    assert again.healthy() == {"spark": True, "storage": True}
    again.catalogue.create_project("other", "Other", ["binary.sha256"], project_id="q")
    again.ingest("q", spark.createDataFrame([("a", None, "binary.sha256", ["11"])], ANSWERS), NOW)
    with pytest.raises(Conflict):  # the first one goes on from an older version
        registry.save()
    again.delete_project("p")
    assert [p.slug for p in again.catalogue.list_projects()] == ["other"] and again.state.algorithms("p") == []
    assert {r.project_id for r in again.assets.collect()} == {"q"} == {r.project_id for r in again.hashes.collect()}
    again.delete_project("p")


def test_an_exact_class_is_stored_as_one(spark, registry):
    n = 10_000
    answers = spark.range(n).selectExpr("concat('a', id) as identity_id", "cast(null as string) as identity_path", "'binary.sha256' as recipe", "array(if(id < 9990, 'same', concat('h', id))) as hashes")
    registry.ingest("p", answers, NOW)
    assert registry.state.edges("p", 1).count() == 2 * 9_989
    assert registry.matches("p", "binary.sha256", id_="a5")[1].total_count == 9_989
    ranked, info = registry.ranking("p", "binary.sha256", match_limit="2", page_size="3")
    assert info.total_count == 9_990 and [(r.duplicate_count, len(r.matches)) for r in ranked.collect()] == [(9_989, 2)] * 3
    clusters, info, _ = registry.clusters("p", "binary.sha256")
    assert info.total_count == 1


def test_recomputed_assets_equal_a_rebuild(spark, registry):
    rng = random.Random(2)
    value = lambda: f"{rng.choice([0, 2**20, 2**63]) ^ sum(1 << rng.randrange(64) for _ in range(3)):016x}"
    rows = [(f"a{i}", None, "text.simhash64", [value() for _ in range(1 + i % 2)]) for i in range(30)]
    registry.ingest("p", spark.createDataFrame(rows, ANSWERS), NOW)
    registry.ingest("p", spark.createDataFrame([(f"a{i}", None, "text.simhash64", [value()]) for i in (3, 4, 77)], ANSWERS), NOW)
    found = lambda: {(r.asset_id, r.other_asset_id, r.distance, r.similarity) for r in registry.state.edges("p", 2).collect()}
    one = found()
    assert registry.recompute_project("p", "text.simhash64") == {"text.simhash64": 3}
    assert found() == one and one


def test_a_crash_leaves_the_version_before(spark, tmp_path, monkeypatch):
    state = EdgeState(spark, str(tmp_path))
    rows = lambda *pairs: spark.createDataFrame([("p", 3, a, b, 1, 98.4, None) for a, b in pairs], EDGES)
    state.replace("p", 3, rows(("a", "b"), ("b", "a")))
    held = state.edges("p", 3)
    monkeypatch.setattr(state.store, "publish", lambda *a: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        state.replace("p", 3, rows())
    assert EdgeState(spark, str(tmp_path)).generation("p", 3) == 1
    monkeypatch.undo()
    state.replace("p", 3, rows(("c", "d"), ("d", "c")))
    assert held.count() == 2 and {r.asset_id for r in state.edges("p", 3).collect()} == {"c", "d"}  # readers keep what they hold
    n, m = state.store.newest("edges/p/3")
    state.store.publish("edges/p/3", n, m)
    with pytest.raises(Conflict):
        state.store.publish("edges/p/3", n, m)
