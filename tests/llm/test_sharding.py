import zlib

import pytest

from quillspark.llm import sharding
from quillspark.llm.sharding import SlotMap, shard


def test_bytes_are_near_equal_and_places_gapless(sample):
    rows = shard(sample, 10).collect()
    assert len(rows) == sample.count()
    load, places = [0] * 10, {}
    for r in rows:
        load[r["shard"]] += r["size"]
        places.setdefault(r["shard"], []).append(r["slot"])
    assert max(load) - min(load) < 0.02 * sum(load) / 10
    assert all(sorted(p) == list(range(len(p))) for p in places.values())
    texts = {r["doc_id"]: r["text"] or "" for r in sample.collect()}
    for r in rows:
        raw = texts[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"]) == (len(raw) + 16, zlib.crc32(raw))


def test_map_versions(spark, tmp_path):
    first = SlotMap.initial(64, 4)
    second = first.rebalance({s: 100 if s % 4 == 0 else 1 for s in range(64)})
    third = second.rebalance(dict.fromkeys(range(64), 1), n_shards=5)
    path = str(tmp_path / "map")
    for m in (first, second, third):
        m.save(spark, path)
    assert SlotMap.load(spark, path) == third and SlotMap.load(spark, path, 1) == first
    moved = sum(a != b for a, b in zip(second.shards, third.shards, strict=True))
    assert moved < 40 and set(third.shards) == set(range(5))


def test_odd_rows(odd_docs, no_docs):
    rows = shard(odd_docs, 3).collect()
    assert len(rows) == odd_docs.count()
    assert {r["size"] for r in rows if r["doc_id"] in (3, 4)} == {16}
    for s in range(3):
        places = sorted(r["slot"] for r in rows if r["shard"] == s)
        assert places == list(range(len(places)))
    assert shard(no_docs, 3).count() == 0


def test_a_stored_map_is_edited(spark, tmp_path):
    path = str(tmp_path / "map")
    docs = spark.createDataFrame([(i, "x" * (i % 50)) for i in range(3000)], "doc_id long, text string")
    first = {r["doc_id"]: r for r in sharding.shard(docs, 8, n_slots=512, map_path=path).collect()}
    again = {r["doc_id"]: r for r in sharding.shard(docs, 8, n_slots=512, map_path=path).collect()}
    assert {r["shard"] for r in again.values()} == set(range(8))
    versions = sorted(r["version"] for r in spark.read.parquet(path).select("version").distinct().collect())
    assert versions[:2] == [1, 2] and max(r["map_version"] for r in again.values()) in versions
    more = docs.unionByName(spark.createDataFrame([(i, "y" * 400) for i in range(5000, 5040)], "doc_id long, text string"))
    grown = {r["doc_id"]: r for r in sharding.shard(more, 9, n_slots=512, map_path=path).collect()}
    assert {r["shard"] for r in grown.values()} == set(range(9))
    assert all(grown[d]["virtual_slot"] == r["virtual_slot"] for d, r in first.items())
    assert sum(grown[d]["shard"] == r["shard"] for d, r in again.items()) > 1500  # most slots stay
    with pytest.raises(ValueError, match="slots"):
        sharding.shard(docs, 8, n_slots=256, map_path=path)


def test_rows_without_an_id_and_of_one_id_spread(spark):
    docs = spark.createDataFrame([(None if i % 2 else 7, f"text {i}") for i in range(2000)], "doc_id long, text string")
    rows = sharding.shard(docs, 4, n_slots=256).collect()
    sizes = [sum(r["size"] for r in rows if r["shard"] == k) for k in range(4)]
    assert len(rows) == 2000 and max(sizes) < 1.02 * min(sizes)
    for k in range(4):
        assert sorted(r["slot"] for r in rows if r["shard"] == k) == list(range(sum(r["shard"] == k for r in rows)))
