"""Virtual slots and their map against the law they promise."""

import random
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from depotcast.llm import sharding
from depotcast.llm.common import scratch_folder

DOCS = "doc_id long, text string, slot string, shard string, size double"


def texts(n, seed=1):
    rng = random.Random(seed)
    return [(i, rng.choice([None, "", "naïve 日本 "]) if i % 50 == 0 else "x" * rng.randrange(2000), "a", "b", 0.5) for i in range(n)]


def sharded(spark, rows, shards=5, uri=None):
    docs = spark.createDataFrame(rows, DOCS).repartition(4)
    return sharding.shard_documents(docs, shards, uri or scratch_folder(spark, "map")).collect()


def loads_of(out, shards):
    bytes_of = Counter()
    for r in out:
        bytes_of[r.shard] += r.size
    return [bytes_of[s] for s in range(shards)]


def without_gaps(out):
    places = defaultdict(list)
    for r in out:
        places[r.shard].append(r.slot)
    return all(sorted(x) == list(range(len(x))) for x in places.values())


def test_sizes_are_near_equal_and_places_have_no_gaps(spark):
    rows = texts(4000)
    out = sharded(spark, rows)
    want = Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t, *_ in rows)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in out) == want
    loads = loads_of(out, 5)
    assert sum(loads) == sum(r.size for r in out) and max(loads) - min(loads) <= 2016
    assert without_gaps(out)
    slots = {}
    assert all(slots.setdefault(r.virtual_slot, r.shard) == r.shard for r in out)


def test_the_map_is_the_greedy_one(spark):
    out = sharded(spark, texts(3000, 2), 7)
    bytes_of, shard_of = Counter(), {}
    for r in out:
        bytes_of[r.virtual_slot] += r.size
        shard_of[r.virtual_slot] = r.shard
    loads, want = [0] * 7, {}
    for slot, size in sorted(bytes_of.items(), key=lambda x: (-x[1], x[0])):
        least = loads.index(min(loads))
        want[slot] = least
        loads[least] += size
    assert shard_of == want


def test_rows_alike_are_a_third_of_all(spark):
    rows = texts(1000, 3) + [(None, "copy " * 200, "", "", 0.0)] * 250 + [(7, "same key and text", "", "", 0.0)] * 500
    out = sharded(spark, rows)
    assert len(out) == len(rows) and without_gaps(out)
    loads = loads_of(out, 5)
    assert max(loads) - min(loads) <= 3 * 2016
    assert len({r.virtual_slot for r in out if r.doc_id is None}) > 100


def test_a_document_larger_than_a_shard_stands_alone(spark):
    out = sharded(spark, [(0, "y" * 3_000_000, "", "", 0.0), *texts(50)[1:]], 4)
    assert [r.doc_id for r in out if r.shard == next(x.shard for x in out if x.doc_id == 0)] == [0] and without_gaps(out)


def test_an_empty_table_and_no_shards(spark):
    uri = scratch_folder(spark, "map")
    assert sharded(spark, [], 3, uri) == []
    kept = sharding.SlotMaps(spark, uri).load()
    assert kept.count() == sharding.SLOTS and kept.agg(F.sum("bytes")).first()[0] == 0
    with pytest.raises(ValueError, match="a shard at least"):
        sharded(spark, [], 0)


def test_later_versions_move_only_what_is_too_much(spark):
    uri, rows = scratch_folder(spark, "map"), texts(4000, 4)
    maps = sharding.SlotMaps(spark, uri)
    assert maps.versions() == []
    with pytest.raises(ValueError, match="no such version"):
        maps.load()
    first = {r.virtual_slot: r.shard for r in sharded(spark, rows, 5, uri)}
    same = {r.virtual_slot: r.shard for r in sharded(spark, rows, 5, uri)}
    assert same == first  # in balance: nothing moves
    out = sharded(spark, rows, 6, uri)
    grown = {r.virtual_slot: r.shard for r in out}
    moved = {s for s in grown if grown[s] != first[s]}
    loads = loads_of(out, 6)
    # a sixth of the bytes goes to the new shard, and no more
    assert 0 < sum(r.size for r in out if r.virtual_slot in moved) <= sum(loads) / 6 + 2016 and without_gaps(out)
    assert max(loads) <= (1 + sharding.SLACK) * sum(loads) / 6 + 2016
    fewer = sharded(spark, rows, 4, uri)
    assert {r.shard for r in fewer} == {0, 1, 2, 3} and without_gaps(fewer)
    assert all(r.shard == grown[r.virtual_slot] for r in fewer if grown[r.virtual_slot] < 4)
    assert maps.versions() == [0, 1, 2, 3]
    assert {r.slot: r.shard for r in maps.load(0).collect() if r.records} == first
