"""Operators on texts against brute-force versions."""

from __future__ import annotations

import hashlib
import itertools
import math
import random
import re
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from depotcast.llm import decontaminate, language_id, license_scan, registry, simhash, substring_dedup
from depotcast.llm.components import connected_components

from .conftest import ODD, docs_of


def lower(text: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def normal_words(text: str | None) -> list[str]:
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text or ""))


def plain_words(text: str | None) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


# --- 2 decontamination ----------------------------------------------------------------


def leaks(texts, items, window):
    out = []
    for text in texts:
        words, hit, of = normal_words(text), set(), set()
        for item, body in items:
            w = normal_words(body)
            size = min(window, len(w))
            for i in range(len(w) - size + 1 if w else 0):
                for k in range(len(words) - size + 1):
                    if words[k : k + size] == w[i : i + size]:
                        hit.update(range(k, k + size))
                        of.add(str(item))
        out.append((len(words), len(hit), sorted(of)))
    return out


@pytest.mark.parametrize("item_bytes", [1 << 20, 20])
def test_leaks_equal_brute_force_with_one_or_many_automata(spark, item_bytes):
    rng = random.Random(2)
    vocabulary = ["a", "b", "É", "c1"]
    line = lambda n: rng.choice([" ", ", ", "\n"]).join(rng.choices(vocabulary, k=n))
    items = [(i, line(rng.randint(1, 9))) for i in range(8)] + [(8, None), (9, " .. "), (1, "a b")]
    texts = [line(rng.randint(0, 40)) for _ in range(40)] + ODD
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.find_leaks(docs_of(spark, texts), benchmark, window=4, item_bytes=item_bytes, into="leak")
    got = {r.doc_id: r.leak for r in found.collect()}
    for i, want in enumerate(leaks(texts, items, 4)):
        assert (got[i].n_words, got[i].n_hit, got[i]["items"]) == want
        for s in got[i].spans:  # the original text under a span has just its words
            assert normal_words(texts[i][s.start : s.end]) == normal_words(texts[i])[s.first_word : s.end_word]


def test_clean_documents_stay_as_they_are(spark):
    rows = docs_of(spark, ["one two three four", "nothing here", None, ""])
    benchmark = spark.createDataFrame([(1, "One, two; THREE four")], "item_id long, text string")
    kept = decontaminate.without_leaks(rows, benchmark)
    assert kept.columns == rows.columns and [r.text for r in kept.orderBy("doc_id").collect()] == ["nothing here", None, ""]
    assert decontaminate.without_leaks(rows, benchmark.limit(0)).count() == 4
    assert decontaminate.without_leaks(rows.limit(0), benchmark).count() == 0
    with pytest.raises(ValueError):
        decontaminate.find_leaks(rows, benchmark, into="leaks")


# --- 4 SimHash ------------------------------------------------------------------------


def slow_fingerprint(text, size=3):
    words = plain_words(lower(text or ""))
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + size]).encode(), 42) for i in range(max(1, len(words) - size + 1))]
    value = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    return value - (1 << 64) if value >> 63 else value


def grouped(nodes, links) -> dict:
    """The smallest node that each can reach."""
    up = {n: n for n in nodes}

    def top(n):
        while up[n] != n:
            n = up[n]
        return n

    for a, b in links:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    return {n: top(n) for n in nodes}


def test_fingerprints_equal_counting_bits():
    for text in ODD + ["a b c d", "A B c", "b " * 400]:
        assert simhash.fingerprint(None if text is None else text.encode()) == slow_fingerprint(text)


@pytest.mark.parametrize("crowd", [0, 3, 48])
def test_links_of_fingerprints_equal_all_pairs(spark, crowd):
    rng = np.random.default_rng(crowd)
    values = {int(x) for x in rng.integers(0, 2**64, 60, dtype=np.uint64)} | {0, 2**64 - 1}
    for value in sorted(values)[:6]:
        for _ in range(40):
            values.add(value ^ sum(1 << int(b) for b in rng.choice(20 if rng.random() < 0.5 else 64, rng.integers(1, 5), replace=False)))
    signed = {v: v - (1 << 64) if v >> 63 else v for v in values}
    want = {tuple(sorted((signed[a], signed[b]))) for a, b in combinations(sorted(values), 2) if (a ^ b).bit_count() <= 3}
    rows = spark.createDataFrame([(v,) for v in signed.values()], "fingerprint long")
    links = simhash.link_fingerprints(rows, crowd=crowd)
    assert {tuple(sorted(r)) for r in links.collect()} == want
    got = {r.node: r.component for r in connected_components(links, "a", "b").collect()}
    assert got == grouped({x for pair in want for x in pair}, want)


def test_components_of_awkward_links(spark):
    links = [(5, 4), (4, 3), (3, 2), (2, 1), (9, 9), (7, 8), (8, 7), (7, 8), (None, 3)] + [(100, x) for x in range(101, 140)]
    rows = spark.createDataFrame(links, "x long, y long")
    got = {r.node: r.component for r in connected_components(rows, "x", "y").collect()}
    assert got == {**dict.fromkeys((1, 2, 3, 4, 5), 1), 9: 9, 7: 7, 8: 7, **dict.fromkeys(range(100, 140), 100)}
    assert connected_components(rows.limit(0), "x", "y").collect() == []


def test_near_duplicates_and_who_stays(spark):
    body = " ".join(f"w{i}" for i in range(400))
    texts = [body, "other text altogether here", body.upper(), None, "", body + " end", "   ", "short", "short"]
    rows = docs_of(spark, texts, first=10)
    marks = [slow_fingerprint(t) for t in texts]
    links = [(a + 10, b + 10) for a, b in combinations(range(len(texts)), 2) if ((marks[a] ^ marks[b]) & (2**64 - 1)).bit_count() <= 3]
    want = grouped(range(10, 10 + len(texts)), links)
    got = simhash.near_duplicates(rows).collect()
    assert {r.doc_id: r.component_id for r in got} == want and {r.doc_id: r.fingerprint for r in got} == {10 + i: m for i, m in enumerate(marks)}
    twice = rows.union(rows).union(rows.where("doc_id = 11").withColumn("doc_id", F.lit(None).cast("long")))
    kept = simhash.one_of_each_group(twice)
    assert kept.columns == rows.columns and sorted(r.doc_id for r in kept.collect()) == sorted(set(want.values()))
    assert simhash.near_duplicates(rows.limit(0)).collect() == [] and simhash.one_of_each_group(rows.limit(0)).collect() == []


def test_op4_equals_all_pairs(spark, small):
    texts = {r.doc_id: slow_fingerprint(r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    links = [(a, b) for a, b in combinations(sorted(texts), 2) if ((texts[a] ^ texts[b]) & (2**64 - 1)).bit_count() <= 3]
    want = grouped(texts, links)
    for r in registry.op4_simhash(spark, small).collect():
        assert (r.fingerprint, r.component_id) == (f"{texts[r.doc_id] & (2**64 - 1):016x}", want[r.doc_id])


# --- 7 substring dedup ----------------------------------------------------------------


def without_repeats(rows, size):
    """rows: (key, text); per row (words, removed, kept)."""
    first = {}
    for key, text in rows:
        words = plain_words(text)
        for i in range(len(words) - size + 1):
            w = tuple(words[i : i + size])
            if key is not None:
                first[w] = min(first.get(w, key), key)
    out = []
    for key, text in rows:
        words, gone = plain_words(text), set()
        for i in range(len(words) - size + 1):
            source = first.get(tuple(words[i : i + size]))
            if source is not None and (key is None or source < key):
                gone.update(range(i, i + size))
        out.append((len(words), len(gone), " ".join(w for i, w in enumerate(words) if i not in gone)))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_repeats_equal_brute_force(spark, seed):
    rng = random.Random(seed)
    passages = [" ".join(f"p{k}x{i}" for i in range(rng.randint(3, 40))) for k in range(8)]
    texts = [" ".join(rng.choice([*passages, "a a a a a a a", "b", f"u{rng.random()}"]) for _ in range(rng.randint(0, 12))) for _ in range(60)]
    texts += ODD + ["word " * 3000 + "z", "one two three"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(5, texts[7]), (5, texts[5]), (None, texts[3]), (None, texts[3])]
    table = docs_of(spark, [t for _, t in rows]).withColumn("row", F.col("doc_id"))
    keys = spark.createDataFrame([(i, k) for i, (k, _) in enumerate(rows)], "row long, new long")
    table = table.join(keys, "row").withColumn("doc_id", F.col("new")).drop("new")
    for size, anchor in ((5, 2), (13, 6)):
        got = {r.row: r.cut for r in substring_dedup.remove_repeats(table, window=size, anchor=anchor, into="cut").collect()}
        assert [tuple(got[i]) for i in range(len(rows))] == without_repeats(rows, size)


def test_a_much_quoted_source_and_one_key_for_many_rows(spark, monkeypatch):
    """Very many different cuts of one document are asked for in slices; a third of the rows share a key, another has none."""
    monkeypatch.setattr(substring_dedup, "ASKED", 7)
    rng = random.Random(4)
    source = [f"s{i}" for i in range(400)]
    cut = lambda: (lambda a, n: " ".join(source[a : a + n]))(rng.randrange(380), rng.randrange(5, 60))
    rows = [(0, " ".join(source))] + [(i, f"own{i} {cut()} mid{i} {cut()} end") for i in range(1, 60)]
    rows += [(70, f"{cut()} same key {i}") for i in range(40)] + [(None, f"{cut()} no key {i}") for i in range(40)]
    table = spark.createDataFrame([(i, k, t) for i, (k, t) in enumerate(rows)], "row long, doc_id long, text string").repartition(5)
    got = {r.row: r.cut for r in substring_dedup.remove_repeats(table, window=5, anchor=2, into="cut").collect()}
    assert [tuple(got[i]) for i in range(len(rows))] == without_repeats(rows, 5)
    # the anchors of rows that share a key, or have none, stay apart
    narrow = table.select(F.col("doc_id").alias("key"), F.xxhash64("text").alias("tid"), F.col("text").cast("binary").alias("text"))
    per_row = substring_dedup._anchor_rows(narrow, 5, 2).groupBy("key", "tid").agg(F.countDistinct("anchor").alias("n"))
    assert per_row.agg(F.max("n")).first()[0] <= 400 and per_row.count() == len(rows)


def test_texts_that_lose_nothing_stay_as_they_are(spark):
    body = " ".join(f"w{i}" for i in range(20))
    rows = docs_of(spark, [body + "  own", body, "x  y\n" + body + "  z", None, ""])
    kept = substring_dedup.without_repeats(rows).orderBy("doc_id")
    assert kept.columns == rows.columns
    assert [(r.doc_id, r.text, r.n_chars) for r in kept.collect()] == [(0, body + "  own", len(body) + 5), (2, "x y z", 5), (3, None, None), (4, "", 0)]
    assert substring_dedup.without_repeats(rows.limit(0)).collect() == []


def test_word_hashes_do_not_depend_on_the_parts_of_a_text(monkeypatch):
    text = ("ab  cde\tf " * 50 + "x" * 300 + " end").encode()
    whole = substring_dedup.word_hashes(text)
    monkeypatch.setattr(substring_dedup, "STEP", 64)
    assert (substring_dedup.word_hashes(text) == whole).all() and len(whole) == len(text.split())
    by_word = defaultdict(set)
    for word, value in zip(text.split(), whole, strict=True):
        by_word[word].add(int(value))
    assert all(len(v) == 1 for v in by_word.values()) and len({v.pop() for v in by_word.values()}) == len(by_word)


# --- 9 language -----------------------------------------------------------------------


def best_path(scores, penalty):
    value = scores[0].copy()
    for row in scores[1:]:
        value = np.maximum(value, value.max() - penalty) + row
    return value.max()


def test_viterbi_is_optimal():
    rng = np.random.default_rng(0)
    for _ in range(400):
        scores = rng.normal(size=(rng.integers(1, 14), rng.integers(1, 5))) * 4
        scores[:, 0] += rng.choice([0, 3])
        penalty = float(rng.uniform(0, 9))
        path = language_id.viterbi(scores, penalty)
        got = scores[np.arange(len(path)), path].sum() - penalty * (np.diff(path) != 0).sum()
        assert got == pytest.approx(best_path(scores, penalty))


@pytest.fixture(scope="module")
def model(spark):
    greek, latin = "καλημέρα κόσμε φίλε μου ", "good morning dear world "
    rows = [("en", latin + f"the {w}") for w in ("house", "garden", "thing")] + [("el", greek), ("fr", "bonjour le monde quelle belle journée "), (None, "x"), ("en", None)]
    return language_id.fit(spark.createDataFrame(rows, "lang string, text string"))


def test_scripts_and_spans_of_mixed_text(spark, model):
    assert model.languages == ("el", "en", "fr") and model.scripts["greek"] == (True, False, False)
    texts = ["good morning the house dear world the thing", "καλημέρα κόσμε", "good morning the garden dear καλημέρα κόσμε φίλε", "12 ... !", None, "", "привет"]
    got = [r.found for r in language_id.identify(docs_of(spark, texts), model, into="found").orderBy("doc_id").collect()]
    assert [r.lang for r in got[:3]] == ["en", "el", "en"] and [r.lang for r in got[3:6]] == ["und"] * 3
    assert [(s.lang, s.first_word, s.n_words) for s in got[2].spans] == [("en", 0, 5), ("el", 5, 3)]
    assert all(0 <= r.score <= 1 for r in got) and got[6].lang in model.languages and got[4].score == 0
    kept = language_id.in_known_language(docs_of(spark, texts), model)
    assert kept.columns == docs_of(spark, []).columns and sorted(r.doc_id for r in kept.collect()) == [0, 1, 2, 6]


def plain_scores(rows, word):
    """A word's scores by language, letter sequence by letter sequence, from the labelled texts themselves."""
    grams, scripts = {}, {}
    for lang, text in rows:
        for w in "".join(c if c.isalpha() else " " for c in text.lower()).split():
            scripts.setdefault(language_id.script_of(w), set()).add(lang)
            for g in language_id.grams_of(w):
                grams.setdefault(lang, []).append(g)
    langs = sorted(grams)
    kinds = len({g for x in grams.values() for g in x}) + 1
    allowed = scripts.get(language_id.script_of(word), set())
    if not allowed:
        return [0.0] * len(langs)
    sums = {x: sum(math.log2((grams[x].count(g) + 0.5) / (len(grams[x]) + 0.5 * kinds)) for g in language_id.grams_of(word)) for x in allowed}
    return [max(sums[x] - max(sums.values()), -language_id.WORD_BOUND) if x in allowed else language_id.EXCLUDED for x in langs]


def test_word_scores_labels_and_spans_equal_brute_force(spark):
    rows = [("en", "the quiet garden and a house, the thing"), ("en", "good morning dear world"), ("fr", "bonjour le monde, une belle journée"),
            ("el", "καλημέρα κόσμε φίλε"), ("ru", "привет дорогой мир и мир"), ("ru", "ok")]
    model = language_id.fit(spark.createDataFrame(rows * 3, "lang string, text string"))  # copies teach once
    words = ["garden", "monde", "journée", "κόσμε", "мир", "ok", "zzz", "日本", "gardenмир"]
    got = model.scores(words)
    assert np.allclose(got, [plain_scores(rows, w) for w in words])
    # one foreign word among others has a span of its own, and excluded languages never win
    texts = ["the quiet garden мир and the house", "привет мир κόσμε дорогой мир", "日本 the garden 日本"]
    for r in language_id.identify(docs_of(spark, texts), model, into="found").collect():
        own = [plain_scores(rows, w) for w in texts[r.doc_id].split()]
        best = max(
            itertools.product(range(4), repeat=len(own)),
            key=lambda path: sum(s[p] for s, p in zip(own, path)) - language_id.SWITCH * sum(a != b for a, b in zip(path, path[1:])),
        )
        path = [lang for s in r.found.spans for lang in [s.lang] * s.n_words]
        assert path == [model.languages[p] for p in best]
        letters = Counter()
        for lang, w in zip(path, texts[r.doc_id].split()):
            letters[lang] += len(w)
        assert r.found.lang == max(letters, key=letters.get)


def test_training_draws_exactly_and_keeps_every_language(spark):
    rows = [("hot", f"copy of one of few texts {i % 3}") for i in range(3000)] + [("en", f"text {i}") for i in range(700)] + [("rare", "una parola")]
    labelled = spark.createDataFrame(rows, "lang string, text string").repartition(6)
    drawn = language_id._drawn(labelled, 50).collect()
    assert Counter(r.lang for r in drawn) == {"hot": 3, "en": 50, "rare": 1} and len({(r.lang, r.text) for r in drawn}) == len(drawn)
    smallest = labelled.where("lang = 'en'").orderBy(F.xxhash64("text")).limit(50).collect()
    assert {r.text for r in drawn if r.lang == "en"} == {r.text for r in smallest}


def test_script_of_a_long_word_is_that_of_all_its_letters():
    assert language_id.script_of("a" * 64 + "日" * 100) == "han" and language_id.script_of("ab日本") == "latin"


def test_odd_texts_and_no_training_rows(spark, model):
    assert language_id.identify(docs_of(spark, ODD), model).count() == len(ODD)
    nothing = language_id.fit(docs_of(spark, ["x"]).limit(0))
    assert nothing.languages == ()
    assert {r.language.lang for r in language_id.identify(docs_of(spark, ODD), nothing).collect()} == {"und"}


def test_op9_is_right_on_held_out_documents(spark):
    import zlib

    folder = "/root/testdata/sf0.01"
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    got = registry.op9_language_id(spark, folder).collect()
    assert len(got) == len(lang) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    held = [r for r in got if r.held_out]
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.98 * len(held)


# --- 10 licenses ----------------------------------------------------------------------


def test_templates_take_optional_and_replaceable_wording():
    t = license_scan.Template("t", "alpha <<beginOptional>>beta <<beginOptional>>gamma<<endOptional>><<endOptional>> <<var;match=2>> delta")
    ends = lambda text: t.end(text.split(), 0)
    assert [ends(x) for x in ("alpha delta", "alpha beta delta", "alpha beta gamma delta", "alpha x y delta z")] == [2, 3, 4, 4]
    assert [ends(x) for x in ("alpha x y z delta", "alpha gamma beta q delta", "beta delta", "alpha")] == [None] * 4
    for wrong in ("<<beginOptional>>a<<endOptional>>", "<<var;match=1>> a", "a <<beginOptional>> b"):
        with pytest.raises(ValueError):
            license_scan.Template("w", wrong)


def test_base_places_equal_brute_force(spark, small):
    texts = [r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()] + ODD
    texts += ["Released UNDER the mit license, under the MIT License", "cc by nc cc by nc", "Apache License, Version 2.0"]
    rows = license_scan.find_licenses(docs_of(spark, texts)).collect()
    for r in rows:
        words = normal_words(texts[r.doc_id])
        want = [(i, label) for phrase, label in license_scan.PHRASES for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
        got = r.licenses
        assert (got.n_words, got.n_base) == (len(words), len(want)) and got.base_labels == sorted({x for _, x in want})
        assert (got.first_word, got.last_word) == (min((i for i, _ in want), default=None), max((i for i, _ in want), default=None))
        assert set(got.base_labels) <= set(got.labels) and 0 <= got.score <= 1
        for m in got.matches:
            assert normal_words(texts[r.doc_id][m.start : m.end]) == words[m.first_word : m.end_word]


def test_public_notices_are_found(spark):
    notices = {
        "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including",
        "gpl,gpl-3": "This work is licensed under the GNU General Public License, version 3.",
        "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "all-rights-reserved": "Copyright (c) 2020 The Authors. All rights reserved.",
        "": "Permission is not granted to any person",
    }
    rows = license_scan.find_licenses(docs_of(spark, list(notices.values())), into="found").orderBy("doc_id").collect()
    assert [",".join(r.found.labels) for r in rows] == list(notices)
    assert license_scan.find_licenses(docs_of(spark, []).limit(0)).collect() == []


def plain_text(source, words=("The", "Authors")):
    """A license text as one of its accepted wordings: optional regions in, replaceable ones filled."""
    return re.sub(r"<<var;match=\d+>>", " ".join(words), re.sub(r"<<(begin|end)Optional>>", "", source))


def test_whole_texts_score_most_and_altered_ones_do_not(spark):
    texts, want = [], []
    for label, source in license_scan.TEXTS:
        whole = plain_text(source)
        optional_out = re.sub(r"<<beginOptional>>.*?<<endOptional>>", "", source, flags=re.S)
        for body in (whole, "Copyright 2020 X\n" + whole.upper() + ". The end", plain_text(optional_out, ["X"])):
            texts.append(body)
            want.append((label, True))
        words = whole.split()
        for at in (3, 12, len(words) - 2):  # mandatory ones: a word more, a word less, another word
            texts += [" ".join([*words[:at], "never", *words[at:]]), " ".join(words[:at] + words[at + 1 :]), " ".join([*words[:at], "qqq", *words[at + 1 :]])]
            want += [(label, False)] * 3
    texts.append("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
                 "(the \"Software\"), to deal in the Software without restriction, except that nobody may use it commercially")  # fmt: skip
    want.append(("mit", False))
    got = {r.doc_id: r.licenses for r in license_scan.find_licenses(docs_of(spark, texts)).collect()}
    for i, (label, real) in enumerate(want):
        full = {m.label for m in got[i].matches if m.score == license_scan.TEXT_SCORE}
        assert (got[i].score == 1.0) == real and full == ({label} if real else set()), (i, label)


def accepted(source, words, at):
    """All ends of runs from ``at``, by trying every way through the markup."""
    parts = license_scan._MARKUP.split(source)

    def run(k, at, skipping):
        if k == len(parts):
            yield at
        elif k % 2 and parts[k] == "beginOptional":
            yield from run(k + 1, at, skipping)
            depth, j = 1, k + 2
            while depth:
                depth += {"beginOptional": 1, "endOptional": -1}.get(parts[j], 0)
                j += 2
            yield from run(j - 1, at, skipping)
        elif k % 2 and parts[k].startswith("var"):
            for n in range(int(parts[k].rpartition("=")[2]) + 1):
                if at + n <= len(words):
                    yield from run(k + 1, at + n, skipping)
        elif k % 2:
            yield from run(k + 1, at, skipping)
        else:
            own = normal_words(parts[k])
            if words[at : at + len(own)] == own:
                yield from run(k + 1, at + len(own), skipping)

    return run(0, at, False)


def test_templates_equal_trying_every_way_through(spark):
    rng = random.Random(6)
    marks = ["<<beginOptional>>a<<endOptional>>", "<<beginOptional>>b <<beginOptional>>a<<endOptional>> c<<endOptional>>", "<<var;match=2>>", "a", "b", "c b"]
    for _ in range(300):
        source = " ".join(["a", *rng.choices(marks, k=rng.randint(1, 4)), rng.choice("abc")])
        template, words = license_scan.Template("t", source), rng.choices("abcd", k=12)
        for at in range(12):
            assert template.end(words, at) == min(accepted(source, words, at), default=None)


def test_a_very_long_text_of_phrases_takes_time_in_proportion():
    import time

    scanner = license_scan.Scanner()
    seconds = []
    for times in (20_000, 200_000):
        text = b"under the mit license " * times  # 0.4 and 4.4 MB
        start = time.process_time()
        n, places, matches = scanner.scan(text)
        seconds.append(time.process_time() - start)
        assert n == 4 * times and [p for p, _ in places] == list(range(0, n, 4)) and len(matches) == times
    assert seconds[1] < 30 * max(seconds[0], 0.05)


def test_two_benchmarks_in_one_session_do_not_mix(spark):
    docs = docs_of(spark, [f"alpha beta gamma {x}" for x in ("one two three", "four five six")] * 20).repartition(2)
    for _ in range(3):
        for words, other in (("one two three", "four five six"), ("four five six", "one two three")):
            benchmark = spark.createDataFrame([(words, words)], "item_id string, text string")
            got = decontaminate.find_leaks(docs, benchmark, window=3, into="found").collect()
            assert all((r.found["items"] == [words]) == (words in r.text) and (r.found["n_hit"] == 0) == (other in r.text) for r in got)


def test_digest_of_no_items(spark, small):
    r = registry.op2_decontamination(spark, small).where("n_items = 0").first()
    assert r.items_sha256 == hashlib.sha256(b"").hexdigest() and not r.contaminated
