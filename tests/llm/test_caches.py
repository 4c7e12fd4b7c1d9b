"""What workers keep: bounded, and one operator's at a time."""

from __future__ import annotations

import pyarrow as pa

from depotcast.llm import caches


def test_a_cache_keeps_what_is_wanted_again_and_stays_in_bounds():
    cache = caches.PieceCache(50 * (caches.ENTRY_BYTES + 8))
    for group in range(200):
        pieces = {b"often%d" % i for i in range(5)} | {b"once%d-%d" % (group, i) for i in range(10)}
        unknown = cache.missing(pieces)
        cache.add(unknown, [x[::-1] for x in unknown])
        assert all(cache.young[x] == x[::-1] for x in pieces)
        assert group == 0 or not any(x.startswith(b"often") for x in unknown)
        cache.end_group()
        assert len(cache.young) + len(cache.old) <= 2 * (50 + 15)


def test_one_object_is_held_at_a_time():
    made = []
    make = lambda name: (lambda: made.append(name) or [name])
    first = caches.held("a", make("a"))
    assert caches.held("a", make("a")) is first and made == ["a"]
    assert caches.held("b", make("b")) == ["b"] and caches.held("a", make("a")) is not first and made == ["a", "b", "a"]


def test_slices_hold_all_rows_in_order():
    values = [None, "", "abc", "d" * 50, "é" * 5, None, "x"] * 9
    batch = pa.RecordBatch.from_pydict({"n": list(range(len(values))), "text": values})
    for most in (1, 7, 60, 10_000):
        slices = list(caches.in_slices([batch, batch.slice(0, 0), batch], "text", most))
        assert [x for s in slices for x in s.column("n").to_pylist()] == [*range(len(values))] * 2
        for s in slices:
            sizes = [len((x or "").encode()) for x in s.column("text").to_pylist()]
            assert sum(sizes) <= most or sum(x > 0 for x in sizes) == 1


def test_a_lookup_goes_by_the_pieces_asked_for():
    class Old(dict):
        def __iter__(self):
            raise AssertionError("all of the old generation was gone through")

    cache = caches.PieceCache(1)
    cache.add(["a", "b", "c"], [b"1", b"2", b"3"])
    cache.end_group()
    cache.old = Old(cache.old)
    assert cache.missing({"b", "x"}) == ["x"]
    assert cache.young == {"b": b"2"}
