"""Virtual slots, the slot map and its rebalancing."""

import zlib
from collections import Counter

import xxhash
from edges import documents, nothing
from graphloom.llm.sharding import SlotMap, assign_shards, place, slot_loads, slotted


def test_rows_sizes_and_slots(spark):
    df = documents(spark)
    texts = sorted((r["doc_id"] is None, r["doc_id"] or 0, (r["text"] or "").encode()) for r in df.select("doc_id", "text").collect())
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["size"], r["text_crc32"]) for r in assign_shards(df, shards=4).collect())
    assert got == sorted((n, i, len(t) + 16, zlib.crc32(t)) for n, i, t in texts)


def test_slots_are_gapless_and_shards_near_equal(spark, sf_dir):
    out = assign_shards(spark.read.parquet(f"{sf_dir}/documents.parquet"), shards=5).collect()
    for shard in range(5):
        assert sorted(r["slot"] for r in out if r["shard"] == shard) == list(range(sum(r["shard"] == shard for r in out)))
    load = Counter()
    for r in out:
        load[r["shard"]] += r["size"]
    biggest = max(r["size"] for r in out)
    assert max(load.values()) - min(load.values()) <= 2 * biggest and {r["law"] for r in out} == {"bytes"}


def test_placement_against_an_independent_count(spark, sf_dir, tmp_path):
    """Slots by the library's own hash, shards by the stored map, places by counting."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").unionByName(documents(spark).select("doc_id", "text"))
    path = f"file://{tmp_path}/map"
    got = sorted((tuple(r) for r in assign_shards(docs, shards=7, slots=256, map_path=path).select("doc_id", "size", "text_crc32", "virtual_slot", "shard", "slot").collect()), key=repr)
    assert SlotMap.load(spark, path, 1).owner == tuple(k % 7 for k in range(256))
    owner = SlotMap.load(spark, path, 2).owner
    rows = []
    for r in docs.collect():
        text = (r["text"] or "").encode()
        key = "" if r["doc_id"] is None else str(r["doc_id"])
        rows.append((r["doc_id"], len(text) + 16, zlib.crc32(text), xxhash.xxh64_intdigest(key.encode(), 42)))
    rows = [(i, n, c, (h - (1 << 64) if h >> 63 else h) % 256) for i, n, c, h in rows]
    want, seen = [], Counter()
    for i, n, c, v in sorted(rows, key=lambda r: (r[3], r[0] is not None, r[0] or 0, r[1], r[2])):
        want.append((i, n, c, v, owner[v], seen[owner[v]]))
        seen[owner[v]] += 1
    assert got == sorted(want, key=repr)
    again = {r["map_version"] for r in assign_shards(docs, shards=8, slots=256, map_path=path).collect()}
    assert again == {3} and len(set(SlotMap.load(spark, path).owner)) == 8


def test_placement_does_not_depend_on_partitions(spark):
    a, b = documents(spark), documents(spark).coalesce(1)
    key = lambda df: sorted((tuple(r) for r in assign_shards(df).collect()), key=repr)
    assert key(a) == key(b)


def test_rebalancing_moves_few_slots_and_keeps_versions(spark, tmp_path):
    rows = slotted(documents(spark), slots=64)
    size, n = slot_loads(rows, 64)
    first = SlotMap.even(64, 6).rebalanced(size, n, tolerance=0)
    assert max(first.loads()) - min(first.loads()) <= max(size)
    size[first.owner.index(2)] += 1 << 20
    second = first.rebalanced(size, n)
    assert second.version == 3 and max(second.loads()) <= max(first.rebalanced(size, n, tolerance=0).loads()) * 1.5
    grown = second.rebalanced(size, n, shards=7)
    moved = sum(a != b for a, b in zip(second.owner, grown.owner))
    assert 0 < moved < 32 and set(grown.owner) == set(range(7))
    shrunk = grown.rebalanced(size, n, shards=5)
    assert set(shrunk.owner) <= set(range(5)) and sum(shrunk.loads()) == sum(size)
    path = f"file://{tmp_path}/map"
    for m in (first, second, grown):
        m.save(spark, path)
    assert SlotMap.load(spark, path) == grown and SlotMap.load(spark, path, 2) == first
    assert place(rows, grown).select("shard", "slot").distinct().count() == rows.count()


def test_the_plan_is_native(spark):
    plan = assign_shards(documents(spark))._jdf.queryExecution().executedPlan().toString()
    assert not any(w in plan for w in ("Python", "Arrow", "Pandas"))


def test_empty_table(spark):
    assert assign_shards(nothing(spark)).collect() == []
