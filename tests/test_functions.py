from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from twinmesh.errors import ConfigError, Invalid
from twinmesh.functions import hashing, parsing, scalars
from twinmesh.operators import reads
from twinmesh.sources import config, files

ZERO, D1, D4, D8, ONES = "0" * 16, "0" * 15 + "1", "0" * 15 + "f", "0" * 14 + "ff", "f" * 16


def test_distance_and_similarity(spark):
    rows = [(ZERO, D1, 1, 98.4), (ZERO, D4, 4, 93.8), (ZERO, D8, 8, 87.5), (ZERO, ONES, 64, 0.0), (ONES, "f" * 15 + "e", 1, 98.4), (ZERO, "f" * 15 + "e", 63, 1.6)]
    df = spark.createDataFrame(rows, "a string, b string, d int, s double")
    d = hashing.distance([hashing.word("a", 0)], [hashing.word("b", 0)])
    for r in df.select("d", "s", d.alias("got"), hashing.similarity(d, 64).alias("score")).collect():
        assert (r.got, r.score) == (r.d, r.s)
    assert [hashing.similarity_of(d, 256) for d in (4, 46, 120)] == [98.4, 82.0, 53.1]


def test_max_distance_is_the_exact_bound():
    for bits in (12, 32, 64, 128, 256, 2048):
        for t in (0, 40, 80.1, 85, 93.8, 95, 98, 100):
            d = hashing.max_distance(bits, t)
            assert hashing.similarity_of(d, bits) >= t
            assert d == bits or hashing.similarity_of(d + 1, bits) < t
    assert hashing.max_distance(256, 80.1) == 51
    assert hashing.max_distance(64, 100.1) == -1
    assert hashing.round_threshold(84.25) == 84.3


def test_scalars(spark):
    row = spark.createDataFrame([(None, "", "x", "p", "a, b,,c ", "/a/B.JPG", "/a/b")], "n string, e string, x string, p string, l string, f string, g string").select(
        scalars.patched(F.col("n"), F.col("p")).alias("kept"), scalars.patched(F.col("e"), F.col("p")).alias("cleared"), scalars.patched(F.col("x"), F.col("p")).alias("set"),
        scalars.comma_list(F.col("l")).alias("list"), scalars.mime_hint(F.col("f")).alias("hint"), scalars.mime_hint(F.col("g")).alias("none"),
        scalars.path_term(F.col("f"), "*b.jpg").alias("like"), scalars.path_term(F.col("f"), "_a*").alias("literal"), scalars.percent(F.lit(2), F.lit(6)).alias("pct"), scalars.percent(F.lit(0), F.lit(0)).alias("zero"),
    ).first()
    assert (row.kept, row.cleared, row["set"], row.list, row.hint, row.none) == ("p", None, "x", ["a", "b", "c"], "jpg", None)
    assert (row.like, row.literal, row.pct, row.zero) == (True, False, 33.33, 0.0)


def test_parsing():
    assert parsing.page_of(None, None) == (1, 20) and parsing.page_of("2", "7x") == (2, 7)
    assert parsing.percentage("12.5%", 1) == 12.5 and parsing.percentage(None, 80) == 80
    for bad in (lambda: parsing.page_of("0", None), lambda: parsing.page_of("1", "101"), lambda: parsing.percentage("101", 1), lambda: parsing.percentage("x", 1), lambda: parsing.valid_recipes([]), lambda: parsing.valid_recipes(["image.phash16"]), lambda: parsing.strict_threshold("1.234", 1)):
        with pytest.raises(Invalid):
            bad()
    assert parsing.valid_recipes(["binary.a", "x", "binary.a"]) == ["binary.a", "x"]
    assert parsing.has_scope(["*"], "write") and not parsing.has_scope(["read"], "write")
    info = parsing.PageInfo(0, 0, 1, 20)
    assert (info.page_count, info.has_next_page, info.has_previous_page) == (0, False, False)


def test_configurations(tmp_path, monkeypatch):
    import json

    good = {"core_base_url": "http://core:8000", "default_hamming_threshold": 80}
    p = tmp_path / "c.json"
    p.write_text(json.dumps(good))
    monkeypatch.setenv("CONFIG_PATH", str(p))
    c = config.load()
    assert (c.default_hamming_threshold, c.core_timeout_ms, c.default_rate_limit_per_minute, c.pool_size) == (80.0, 10_000, 300, 10)
    assert config.parse(json.dumps({**good, "database": {"pool_size": 3}})).pool_size == 3
    for bad in ({**good, "core_base_url": "no"}, {**good, "default_hamming_threshold": 101}, {**good, "core_timeout_ms": 0}, {**good, "database": 4}, {}, []):
        with pytest.raises(ConfigError):
            config.parse(json.dumps(bad))
    monkeypatch.delenv("CONFIG_PATH")
    with pytest.raises(ConfigError):
        config.load()
    with pytest.raises(ConfigError):
        config.load(str(tmp_path / "missing.json"))


def test_globs_pages_and_tables(spark, tmp_path):
    for name in ("a/one.jpg", "a/b/two.jpg", "a/b/three.png", "x/four.jpg", "x/.five.jpg", "six"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"1")
    names = lambda include: {r.identity_path.rsplit("/", 1)[1] for r in files.scan(spark, str(tmp_path), include).collect()}
    assert names("*.jpg") == {"one.jpg", "two.jpg", "four.jpg"} and names(["a/*.jpg", "**/b/*.png"]) == {"one.jpg", "three.png"}
    assert names("a/**") == {"one.jpg", "two.jpg", "three.png"} and names(None) == {"one.jpg", "two.jpg", "three.png", "four.jpg", "six"}
    assert [r.identity_path.rsplit("/", 1)[1] for r in files.failures(files.scan(spark, str(tmp_path))).collect()] == ["six"]
    df = spark.createDataFrame([(3, "c"), (1, "a"), (2, None)], "id int, name string")
    assert [r.id for r in reads.head(df, [F.col("id").desc()], 2).collect()] == [3, 2] and [r.id for r in reads.every(df, [F.col("id").asc()]).collect()] == [1, 2, 3]
    rows, info = reads.paged(df, [F.col("id").asc()], 1, 2)
    assert files.text_table(rows, ["id", "name"]) == "id  name\n1   a\n2"
    page = files.page_json(rows, info)
    assert (page["total_count"], page["has_next_page"], page["data"][0]) == (3, True, {"id": 1, "name": "a"})
    assert files.page_json(rows, info, camel=True)["hasNextPage"] is True and "totalCount" in files.page_json(rows, info, camel=True)
