import zlib
from collections import Counter

from lithos.llm import sharding


def test_sizes_places_and_balance(docs, texts):
    rows = sharding.shard(docs, n_shards=4, n_slots=64).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in texts)
    load = Counter()
    for r in rows:
        load[r.shard] += r["size"]
        assert 0 <= r.shard < 4
    for s in load:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))
    assert max(load.values()) - min(load.values()) <= max(r["size"] for r in rows)


def test_map_is_edited_and_versioned(spark, docs, tmp_path):
    path = str(tmp_path / "maps")
    sharding.shard(docs, n_shards=4, n_slots=64, store=path)
    one = sharding.load_map(spark, path)
    again = sharding.shard(docs, n_shards=4, n_slots=64, slot_map=one, store=path)
    two = sharding.load_map(spark, path)
    assert (one.version, two.version) == (1, 2) and two.shards == one.shards  # nothing to move
    assert {r.map_version for r in again.collect()} == {2}
    grown = two.rebalanced({i: 10 for i in range(len(two.shards))}, 5)
    assert all(b in (a, 4) for a, b in zip(two.shards, grown.shards)) or len(set(grown.shards)) == 5
    assert sharding.load_map(spark, path, 1) == one


def test_empty_table(no_docs):
    assert sharding.shard(no_docs, n_shards=4, n_slots=64).count() == 0


def test_repeated_rows_are_split(spark, tmp_path):
    rows = [(7, "same " * 30)] * 3000 + [(i, f"own {i} " * 20) for i in range(2000)] + [(-1, "long " * 4000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    path = str(tmp_path / "maps")
    got = sharding.shard(df, n_shards=8, n_slots=256, store=path).collect()
    assert Counter((r.doc_id, r.text_crc32) for r in got) == Counter((i, zlib.crc32(t.encode())) for i, t in rows)
    load, places = Counter(), {}
    for r in got:
        load[r.shard] += r["size"]
        places.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(p) == list(range(len(p))) for p in places.values())
    assert len(load) == 8 and max(load.values()) < 1.05 * min(load.values())
    kept = sharding.load_map(spark, path)
    assert kept.parts and kept.n_hashed == 256 and sharding.load_map(spark, path, 0) == sharding.SlotMap.first(8, 256)
    # a split stays, and a further version only moves slots
    sharding.shard(df, n_shards=9, n_slots=256, slot_map=kept, store=path)
    grown = sharding.load_map(spark, path)
    assert grown.version == 2 and grown.n_shards == 9 and grown.parts == kept.parts
