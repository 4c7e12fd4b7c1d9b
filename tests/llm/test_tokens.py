"""Token files, byte-level BPE and token counts against the libraries themselves."""

from __future__ import annotations

import base64
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import regex
import tiktoken
from tokenizers import Tokenizer

from depotcast.llm import byte_bpe, registry, token_counts, token_files
from depotcast.llm.common import scratch_folder

from .conftest import ODD, docs_of

WORDS = public_tokenizers.path("word_bpe_49k.json")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    with open(RANKS, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def coder():
    return byte_bpe.ByteBPE.from_file(RANKS, public_tokenizers.PATTERN)


def crc(ids) -> int:
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_token_files_equal_the_library(spark):
    texts = ODD + ["", None]
    rows = docs_of(spark, texts, first=5)
    folder = scratch_folder(spark, "test")
    manifest = token_files.write_token_files(rows.repartition(3), folder, WORDS, end_id=1)
    assert manifest["dtype"] == "<u2" and sum(p["docs"] for p in manifest["parts"]) == len(texts)
    tokenizer = Tokenizer.from_file(WORDS)
    got = {r.doc_id: r for r in token_files.read_token_files(spark, folder, with_ids=True).collect()}
    start = 0
    for i, text in enumerate(texts):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        r = got[5 + i]
        assert (r.position, r.start, r.n_tokens, r.ids_crc32, r.ids) == (i, start, len(ids), crc(ids), ids)
        start += len(ids)


def test_token_files_with_ties_nulls_and_text_keys(spark):
    rows = spark.createDataFrame([("b", "x y"), ("a", "z"), ("a", "z"), (None, "q"), ("a", None)], "name string, body string")
    folder = scratch_folder(spark, "test")
    token_files.write_token_files(rows, folder, WORDS, key="name", text="body")
    got = token_files.read_token_files(spark, folder, key="name").orderBy("position").collect()
    assert [r.name for r in got] == [None, "a", "a", "a", "b"] and [r.n_tokens for r in got][-1] == 2
    assert [r.start for r in got] == [sum(x.n_tokens for x in got[:i]) for i in range(5)]


def test_token_files_of_an_empty_table(spark):
    folder = scratch_folder(spark, "test")
    assert token_files.write_token_files(docs_of(spark, ["x"]).limit(0), folder, WORDS)["parts"] == []
    assert token_files.read_token_files(spark, folder).collect() == []


def test_op1_equals_the_library(spark, small):
    tokenizer = Tokenizer.from_file(WORDS)
    got = {r.doc_id: r for r in registry.op1_token_files(spark, small).collect()}
    start = 0
    for r in spark.read.parquet(f"{small}/documents.parquet").orderBy("doc_id").collect():
        ids = [*tokenizer.encode(r.text, add_special_tokens=False).ids, 1]
        assert (got[r.doc_id].start, got[r.doc_id].n_tokens, got[r.doc_id].ids_crc32) == (start, len(ids), crc(ids))
        start += len(ids)


def test_bpe_equals_the_library_on_random_text(coder, library):
    decoder = byte_bpe.Decoder(byte_bpe.read_ranks(RANKS))
    rng = random.Random(1)
    parts = [" ", "  ", "\n", "\t", "a", "b", "the", "é", "ß", "中", "😀", "'s", "'ll", "1", "23", "...", "!", "\x1c", "\x85", "\xa0", "　", "İ", "ab" * 30]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(4000)] + [x or "" for x in ODD]
    texts += ["'sthe x", "'the", "a" * 3000, " " * 500 + "x", "ab" * 3000, "中" * 500]
    for text, ids in zip(texts, coder.encode(texts), strict=True):
        ids = np.frombuffer(ids, "<u4")
        assert ids.tolist() == library.encode_ordinary(text)
        assert decoder.decode(ids.tobytes()) == text.encode()


def test_other_patterns_make_other_pre_tokens():
    pattern = r"[A-Z]?[a-z]+|\s+|."
    with open(RANKS, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    own = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    texts = ["x helloWorld", "the  quick brownFox", "", "A1 b"]
    coded = byte_bpe.ByteBPE(ranks, pattern).encode(texts)
    assert [np.frombuffer(x, "<u4").tolist() for x in coded] == [own.encode_ordinary(x) for x in texts]
    assert byte_bpe.WORDS == public_tokenizers.PATTERN


def test_pieces_that_hold_the_mark_and_tokenizers_that_join_pieces():
    encoder = token_files.PieceEncoder(WORDS)
    assert encoder.mark is not None
    texts = ["a \x01 b", "\x01", "x\x01y \x01\x01 z", "plain words", "", None, "!\x01 ?"]
    want = [Tokenizer.from_file(WORDS).encode(x or "", add_special_tokens=False).ids for x in texts]
    coded = encoder.encode([None if x is None else x.encode() for x in texts])
    assert [np.frombuffer(x, encoder.dtype).tolist() for x in coded] == want
    joined = token_files.PieceEncoder(public_tokenizers.path("byte_bpe_50k.json"))  # blanks belong to its tokens
    assert joined.mark is None
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["two  words here", "", None]
    coded = joined.encode([None if x is None else x.encode() for x in texts])
    assert [np.frombuffer(x, joined.dtype).tolist() for x in coded] == [tokenizer.encode(x or "", add_special_tokens=False).ids for x in texts]


def test_a_smaller_rank_that_comes_up_goes_first():
    """Ranks in which a merge makes a pair of a smaller rank than its own, against the plain loop."""
    rng = random.Random(3)
    for _ in range(200):
        words = {bytes(rng.choices(b"abc", k=rng.randint(2, 5))) for _ in range(12)}
        ranks = {bytes([b]): 1000 + b for b in range(256)} | {w: i for i, w in enumerate(rng.sample(sorted(words), len(words)))}
        coder = byte_bpe.ByteBPE(ranks, r"\S+")
        tokens = [bytes(rng.choices(b"abc", k=rng.randint(2, 12))) for _ in range(20)]
        for token, got in zip(tokens, coder.merge(tokens), strict=True):
            parts = [bytes([b]) for b in token]
            while True:
                due = [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks]
                if not due:
                    break
                i = min(due)[1]
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
            assert got == [ranks[p] for p in parts]


def test_tables_of_ids_keep_columns_and_rows(spark, library):
    rows = docs_of(spark, ODD)
    coded = byte_bpe.encode_table(rows, RANKS, public_tokenizers.PATTERN)
    back = byte_bpe.digests(byte_bpe.decode_table(coded, RANKS))
    got = {r.doc_id: r for r in back.collect()}
    assert set(rows.columns) <= set(back.columns) and len(got) == len(ODD)
    for i, text in enumerate(ODD):
        assert np.frombuffer(got[i].token_ids, "<u4").tolist() == library.encode_ordinary(text or "")
        assert bytes(got[i].decoded) == (text or "").encode() and got[i].n_tokens == len(got[i].token_ids) // 4
    assert byte_bpe.encode_table(rows.limit(0), RANKS, public_tokenizers.PATTERN).collect() == []


def test_op3_equals_the_library(spark, small, library):
    import hashlib

    got = {r.doc_id: r for r in registry.op3_byte_bpe(spark, small).collect()}
    rows = spark.read.parquet(f"{small}/documents.parquet").collect()
    assert len(got) == len(rows)
    for r in rows:
        ids = library.encode_ordinary(r.text)
        assert got[r.doc_id].n_tokens == len(ids)
        assert got[r.doc_id].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[r.doc_id].decoded_sha256 == hashlib.sha256(r.text.encode()).hexdigest()


def counted(spark, *rows):
    return spark.createDataFrame(rows, "source string, lang string, tokenizer string, n_tokens long")


def totals(rollup) -> dict:
    return {(r.source, r.lang, r.tokenizer): (r.n_docs, r.n_tokens) for r in rollup.totals().collect()}


def test_deltas_add_up_and_batches_count_once(spark):
    rollup = token_counts.Rollup(spark, scratch_folder(spark, "test"))
    assert totals(rollup) == {}
    load = counted(spark, ("s", "en", "v1", 5), ("s", "en", "v1", 7), (None, None, "v1", 1), ("t", "de", "v1", 0))
    assert rollup.commit("load", token_counts.inserts(load)) and not rollup.commit("load", token_counts.inserts(load))
    assert totals(rollup) == {("s", "en", "v1"): (2, 12), (None, None, "v1"): (1, 1), ("t", "de", "v1"): (1, 0)}
    gone = counted(spark, ("s", "en", "v1", 5))
    assert rollup.commit("delete", token_counts.deletes(gone))
    moved = token_counts.revisions(counted(spark, ("s", "en", "v1", 7)), counted(spark, ("s", "en", "v2", 9)))
    assert rollup.commit("revise", moved)
    want = {(None, None, "v1"): (1, 1), ("t", "de", "v1"): (1, 0), ("s", "en", "v2"): (1, 9)}
    assert totals(rollup) == want
    rollup.compact("1")
    rollup.compact("1")
    assert totals(rollup) == want
    assert not rollup.commit("load", token_counts.inserts(load)) and totals(rollup) == want
    assert rollup.commit("more", token_counts.inserts(gone)) and totals(rollup)["s", "en", "v1"] == (1, 5)
    rollup.compact("2")
    assert totals(rollup) == want | {("s", "en", "v1"): (1, 5)}
    assert rollup.commit("nothing", token_counts.inserts(load.limit(0))) and totals(rollup) == want | {("s", "en", "v1"): (1, 5)}


def test_a_batch_that_broke_off_is_written_anew(spark):
    rollup = token_counts.Rollup(spark, scratch_folder(spark, "test"))
    load = token_counts.inserts(counted(spark, ("s", "en", "v1", 5)))
    load.write.parquet(f"{rollup.folder}/load")
    fs, marker = rollup._fs(f"{rollup.folder}/load/_SUCCESS")
    fs.delete(marker, False)
    assert totals(rollup) == {}
    assert rollup.commit("load", load) and totals(rollup) == {("s", "en", "v1"): (1, 5)}


def test_what_is_folded_can_be_purged_and_stays_on_record(spark):
    rollup = token_counts.Rollup(spark, scratch_folder(spark, "test"))
    row = token_counts.inserts(counted(spark, ("s", "en", "v1", 5)))
    for name in ("a", "b"):
        rollup.commit(name, row)
    rollup.compact("1")
    rollup.commit("c", row)
    rollup.compact("2")
    assert rollup.purge() == ["a", "b", "c", "compact-1"] and rollup.batches() == ["compact-2"] and rollup.purge() == []
    assert not any(rollup.commit(name, row) for name in ("a", "b", "c")) and totals(rollup) == {("s", "en", "v1"): (3, 15)}
    rollup.compact("1")  # that name is folded: nothing happens
    assert rollup.batches() == ["compact-2"]
    with pytest.raises(ValueError, match="does not begin with compact-"):
        rollup.commit("compact-3", row)


def test_a_batch_committed_during_compaction_counts_once(spark, monkeypatch):
    rollup = token_counts.Rollup(spark, scratch_folder(spark, "test"))
    row = token_counts.inserts(counted(spark, ("s", "en", "v1", 5)))
    rollup.commit("a", row)
    plain = rollup._sums

    def late(names):
        monkeypatch.setattr(rollup, "_sums", plain)
        rollup.commit("b", row)  # someone else's, after the list was made
        return plain(names)

    monkeypatch.setattr(rollup, "_sums", late)
    rollup.compact("1")
    assert totals(rollup) == {("s", "en", "v1"): (2, 10)} and rollup._current() == ["b", "compact-1"]


def test_kept_columns_must_have_other_names(spark):
    with pytest.raises(ValueError, match="named like the result's own"):
        token_counts.count_tokens(docs_of(spark, ["x"]), registry.TOKENIZERS, keep=["doc_id", "Source"])


def test_op6_equals_counting_with_the_libraries(spark, small, library):
    """Signed batches come to the totals of the documents that are left: all but the toxic ones that are not good."""
    labels = spark.read.parquet(f"{small}/labels.parquet").collect()
    gone = {r.doc_id for r in labels if r.toxic == 1} - {r.doc_id for r in labels if r.toxic == 1 and r.quality == 1}
    assert gone
    want: dict = {}
    for r in spark.read.parquet(f"{small}/documents.parquet").collect():
        if r.doc_id not in gone:
            for version, n in (("byte_bpe_50k", len(library.encode_ordinary(r.text))), ("words-2", len(regex.findall(r"[\p{L}\p{N}]+", r.text)))):
                want.setdefault((r.source, r.lang, version), Counter()).update(docs=1, tokens=n)
    got = {(r.source, r.lang, r.tokenizer): (r.n_docs, r.n_tokens) for r in registry.op6_token_counts(spark, small).collect()}
    assert got == {k: (v["docs"], v["tokens"]) for k, v in want.items()}


def test_counts_of_odd_texts(spark, library):
    got = token_counts.count_tokens(docs_of(spark, ODD), registry.TOKENIZERS, keep=["doc_id"]).collect()
    assert len(got) == 3 * len(ODD)
    for r in got:
        text = ODD[r.doc_id] or ""
        want = {"byte_bpe_50k": len(library.encode_ordinary(text)), "words-1": len(text.encode().split()), "words-2": len(regex.findall(r"[\p{L}\p{N}]+", text))}
        assert r.n_tokens == want[r.tokenizer]


def test_decoding_with_and_without_gaps_in_the_ranks():
    ranks = {bytes([b]): b for b in range(256)} | {b"ab": 256, b"abc": 257}
    gaps = byte_bpe.Decoder({**ranks, b"far": 4_000_000_000})
    whole = byte_bpe.Decoder(ranks)
    assert whole.table is not None and gaps.table is None
    ids = [257, 0, 256, 255, 97] * 50
    for decoder in (whole, gaps):
        for n in (0, 1, 2, 3, 250):
            want = b"".join(decoder.bytes_of[i] for i in ids[:n])
            assert decoder.decode(np.array(ids[:n], "<u4").tobytes()) == want
        assert decoder.decode(None) == b""
        with pytest.raises(KeyError):
            decoder.decode(np.array([258], "<u4").tobytes())
    assert gaps.decode(np.array([4_000_000_000], "<u4").tobytes()) == b"far"
