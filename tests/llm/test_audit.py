"""Filter audit against a walk over documents one by one."""

import random
from collections import defaultdict
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from depotcast.llm import filter_audit

DOCS = "doc_id long, text string, source string, part string, mask int, digest string"
LABELS = "doc_id long, quality int, toxic int"


def fails(text):
    words = [w for w in "".join(" " if c in " \t\n\x0b\x0c\r" else c for c in text).split(" ") if w]
    return {
        "A": len(words) < 50,
        "B": 100 * len(set(words)) < 65 * len(words),
        "C": 100 * sum("A" <= c <= "Z" for c in text) > 5 * len(text),
        "D": any(c in "#$%&*|" for c in text),
    }


def by_hand(docs, labels):
    least = {}
    for key, text, *_ in docs:
        if key is not None:
            least[text or ""] = min(least.get(text or "", key), key)
    good = {k for k, q, _ in labels if q == 1 and k is not None}
    toxic = {k for k, _, t in labels if t == 1 and k is not None}
    seen = [
        (source or "", key, {**fails(text or ""), "E": key is not None and key > least[text or ""]})
        for key, text, source, *_ in docs
    ]
    want = {}
    for part in {p for p, *_ in seen}:
        own = [(k, f) for p, k, f in seen if p == part]
        removed_in_all = defaultdict(int)
        for order in permutations("ABCDE"):
            left = own
            for step, name in enumerate(order, 1):
                gone = [x for x in left if x[1][name]]
                before, left = left, [x for x in left if not x[1][name]]
                removed_in_all[name] += len(gone)
                want[part, "".join(order), step] = [
                    len(left), len(gone), sum(f[name] for _, f in own) - len(gone),
                    sum(f[name] and sum(f.values()) == 1 for _, f in own),
                    sum(k in good for k, _ in gone), sum(k in toxic for k, _ in gone),
                ]
        for (p, order, step), row in want.items():
            if p == part:
                row.append(removed_in_all[order[step - 1]])
    return want


def audited(spark, docs, labels):
    out = filter_audit.audit(spark.createDataFrame(docs, DOCS).repartition(5), spark.createDataFrame(labels, LABELS)).collect()
    found = {(r.part, r.filter_order, r.step): list(r)[3:] for r in out}
    assert len(found) == len(out)
    return found


def test_every_order_equals_the_walk_over_documents(spark):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(40)] + ["ABC", "naïve", "日本", "a#b", "x|y", " ", " "]
    texts = [None, "", " \t\r\n", "A", "é" * 60, "word " * 50, "\x0b".join(vocabulary * 2)]
    texts += [rng.choice([" ", "\n", "  "]).join(rng.choices(vocabulary[: rng.choice([5, 40, 47])], k=rng.randrange(120))) for _ in range(40)]
    docs = []
    for key in range(150):
        docs.append((key, rng.choice(texts), rng.choice(["a", "b", None, "", "c"]), "x", 1, "y"))
    docs += docs[:20] + [(None, rng.choice(texts), "a", None, None, None) for _ in range(10)]  # repeated rows, rows without a key
    docs += [(3, "one key", "b", "x", 1, "y"), (3, "two texts", "c", "x", 1, "y"), (200, "", None, "x", 1, "y")]
    labels = [(rng.randrange(220), rng.choice([0, 1, None]), rng.choice([0, 1, None])) for _ in range(120)] + [(None, 1, 1), (3, 1, 0), (3, 0, 1)]
    assert audited(spark, docs, labels) == by_hand(docs, labels)


def test_a_third_in_one_group_of_copies_and_a_very_long_text(spark):
    docs = [(i, "copied text " * 9, "hot", "", 0, "") for i in range(400)]
    docs += [(1000 + i, f"own {i}", f"s{i % 50}", "", 0, "") for i in range(200)] + [(-5, "long word " * 300_000, "hot", "", 0, "")]
    found = audited(spark, docs, [(7, 1, 1)])
    assert found == by_hand(docs, [(7, 1, 1)])
    assert found["hot", "EABCD", 1] == [2, 399, 0, 0, 1, 1, found["hot", "EABCD", 1][6]]


def test_empty_tables(spark):
    assert audited(spark, [], [(1, 1, 1)]) == {}
    assert audited(spark, [(1, None, None, "", 0, "")], [])["", "ABCDE", 1] == [0, 1, 0, 1, 0, 0, 120]


def test_other_filters_and_none_for_copies(spark):
    docs = spark.createDataFrame([(1, "ab", "s"), (2, "abc", "s"), (3, None, "s"), (3, "abc", "s")], "doc_id int, text string, source string")
    labels = spark.createDataFrame([(2, 1, 0)], LABELS)
    size = {"S": F.length("text") < 3, "L": F.length("text") > 2}  # null for a null text: does not fail
    out = {(r.filter_order, r.step): r for r in filter_audit.audit(docs, labels, size, None).collect()}
    assert len(out) == 4 and out["SL", 1].removed == 1 and out["SL", 2].kept == 1 and out["LS", 1].good_lost == 1
    for wrong in ({}, {"AB": F.lit(True)}):
        with pytest.raises(ValueError, match="one letter"):
            filter_audit.audit(docs, labels, wrong, None)


def test_walk_equals_counting_every_subset():
    cells = np.random.default_rng(1).integers(0, 9, (3, 32, 2))
    states = filter_audit.subset_survivors(cells)
    for subset in range(32):
        assert (states[:, subset] == cells[:, [m for m in range(32) if not m & subset]].sum(axis=1)).all()
