"""Language identification (operator 9) with spans for mixed text.

A word is a longest run of letters. The script of its letters narrows the languages it can be in;
each of those scores the word by the letter sequences of one to three letters in it (naive Bayes,
in bits per word and bounded, so no single word decides). A text's labels are the best path over its
words: the scores' sum less a penalty for every change of language (Viterbi). A language's share is
the letters of its words; the text's language is the one with the largest share.

The classifier is counted by Spark over labelled rows: only counts by language and letter sequence
come to the driver, for the ``TRAIN_DOCS`` different texts of each language with the smallest hashes.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from depotcast.llm.caches import held, in_slices
from depotcast.llm.common import forget, fresh, ship_package, stored

#: Different labelled texts of each language that the classifier is fitted on.
TRAIN_DOCS = 1000
#: Longest letter sequence; three code points fit a key of 63 bits.
LETTERS = 3
#: What a change of language costs.
SWITCH = 12.0
#: Bound of a word's advantage for one language over another.
WORD_BOUND = 8.0
#: Score of a word for a language that its script rules out: no path goes there while another way is open.
EXCLUDED = -1e6
#: Words whose scores a worker keeps (some 150 bytes each).
WORDS_KEPT = 250_000
#: Words, or parts of long ones, that are scored at a time.
PARTS_AT_ONCE = 4096
#: Words that a path is followed over at a time.
WORDS_AT_ONCE = 4096
#: Longer words are scored by parts of this many letters.
LONG_WORD = 64

#: First code points of letter blocks that tell a script, up to the next one. Fixed values.
SCRIPTS = (
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"),
    (0x0600, "arabic"), (0x0700, "other"), (0x0900, "devanagari"), (0x0980, "indic"), (0x0E00, "thai"), (0x0E80, "other"),
    (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "other"), (0x1C80, "cyrillic"), (0x1C90, "georgian"), (0x1CC0, "other"),
    (0x1D00, "latin"), (0x1F00, "greek"), (0x2000, "latin"), (0x2C80, "other"), (0x2DE0, "cyrillic"), (0x2E00, "han"),
    (0x3040, "kana"), (0x3100, "han"), (0x3130, "hangul"), (0x3190, "han"), (0x31F0, "kana"), (0x3200, "han"), (0xA000, "other"),
    (0xA720, "latin"), (0xA800, "other"), (0xAB30, "latin"), (0xAB70, "other"), (0xAC00, "hangul"), (0xD800, "other"),
    (0xF900, "han"), (0xFB00, "latin"), (0xFB07, "other"), (0xFB50, "arabic"), (0xFE70, "arabic"), (0xFF00, "latin"),
    (0xFF66, "kana"), (0xFFA0, "hangul"), (0x10000, "other"), (0x20000, "han"),
)
_STARTS = np.array([s for s, _ in SCRIPTS])

#: ASCII bytes that are not letters become blanks, A-Z become lower case; other bytes stay.
_TEXT = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_LETTER_RUNS = re.compile(r"[^\W\d_]+")


@lru_cache(maxsize=1 << 14)
def script_of_letter(letter: str) -> str:
    return SCRIPTS[int(np.searchsorted(_STARTS, ord(letter), "right")) - 1][1]


def script_of(word: str) -> str:
    """The script of most of a word's letters; the first of equals."""
    return Counter(map(script_of_letter, word)).most_common(1)[0][0]


def letter_runs(piece: bytes) -> list[str]:
    """The words in what stands between blanks."""
    return [piece.decode()] if piece.isalpha() else _LETTER_RUNS.findall(piece.decode().lower())


def grams_of(word: str, letters: int = LETTERS) -> list[str]:
    marked = f"^{word}$"
    return [marked[i : i + n] for n in range(1, letters + 1) for i in range(len(marked) - n + 1) if n > 1 or 0 < i <= len(word)]


def gram_key(gram: str) -> int:
    """A sequence of up to three letters as one number, 21 bits a letter."""
    return sum(ord(c) << 21 * i for i, c in enumerate(gram))


@dataclass(frozen=True, eq=False)
class Model:
    """Log probabilities (base 2) by letter sequence and language, and the languages of each script.

    ``keys`` has the sequences' numbers, ascending. ``rows`` has a row of zeros, then what a sequence
    that was not seen scores, then a row for each key.
    """

    languages: tuple[str, ...]
    keys: np.ndarray
    rows: np.ndarray
    scripts: dict[str, tuple[bool, ...]]

    def scores(self, words: list[str]) -> np.ndarray:
        """The words' scores by language: 0 for the best, not under -WORD_BOUND, and ``EXCLUDED`` for
        languages that the word's script rules out. A word in a script that no learned language has
        scores 0 for all, and so is left to its neighbours."""
        n = len(self.languages)
        out = np.zeros((len(words), n))
        if n < 2:
            return out
        scripts = [self.scripts.get("latin" if word.isascii() else script_of(word)) for word in words]
        parts = [
            (i, f"^{word[at : at + LONG_WORD]}$")
            for i, word in enumerate(words) if scripts[i] is not None for at in range(0, len(word), LONG_WORD)
        ]
        for first in range(0, len(parts), PARTS_AT_ONCE):
            owners, marked = zip(*parts[first : first + PARTS_AT_ONCE], strict=True)
            np.add.at(out, list(owners), self._sums(marked))
        allowed = np.array([x or (True,) * n for x in scripts], bool).reshape(-1, n)
        best = np.where(allowed, out, -np.inf).max(axis=1, keepdims=True, initial=-np.inf)
        return np.where(allowed, np.maximum(out - best, -WORD_BOUND), EXCLUDED)

    def _sums(self, marked: tuple[str, ...]) -> np.ndarray:
        """The summed scores of the letter sequences of each marked word."""
        keys, rows = self.keys, self.rows
        codes = np.frombuffer("".join(marked).encode("utf-32-le"), "<u4").astype(np.int64)
        sizes = np.array([len(x) for x in marked])
        starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
        left = np.repeat(starts + sizes, sizes) - np.arange(len(codes))  # letters up to the word's end
        inside = left > 1
        inside[starts] = False
        places = np.where(inside, self._place(keys, codes), 0)
        total = rows[places]
        key = codes
        for size in range(2, LETTERS + 1):
            key = key[:-1] | codes[size - 1 :] << 21 * (size - 1)
            total[: len(key)] += rows[np.where(left[: len(key)] >= size, self._place(keys, key), 0)]
        return np.add.reduceat(total, starts)

    @staticmethod
    def _place(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        """Rows of the scores; 1 for sequences that are not among ``keys``."""
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        return np.where(keys[at] == wanted, at + 2, 1) if len(keys) else np.ones(len(wanted), np.int64)


def _drawn(labelled: DataFrame, per_language: int) -> DataFrame:
    """The ``per_language`` different texts of each language with the smallest hashes, once each.

    Hashes and languages alone are counted and compared. The bound of a language's hashes is looked
    for among those under a share of all that holds twice as many as needed, so that no task
    orders more; should a share turn out to hold too few, it is doubled.
    """
    hashed = labelled.withColumn("h", F.xxhash64("text"))
    different = stored(hashed.select("lang", "h").distinct(), "hashes")
    sizes = {r.lang: r["count"] for r in different.groupBy("lang").count().collect()}  # one row per language
    bounds: dict[str, int] = {lang: (1 << 63) - 1 for lang, n in sizes.items() if n <= per_language}
    share = 2 * per_language
    while len(bounds) < len(sizes):
        open_ones = {lang: -(1 << 63) + min((share << 64) // n, (1 << 64) - 1) for lang, n in sizes.items() if lang not in bounds}
        under = different.where(F.col("h") <= _by_language(open_ones))
        order = Window.partitionBy("lang").orderBy("h")
        last = under.withColumn("rank", F.row_number().over(order)).where(F.col("rank") == per_language)
        bounds |= {r.lang: r.h for r in last.collect()}
        share *= 2
    forget(different)
    if not bounds:
        return labelled
    return hashed.where(F.col("h") <= _by_language(bounds)).dropDuplicates(["lang", "h"]).drop("h")


def _by_language(values: dict[str, int]) -> Column:
    """A number for each language; null for others."""
    return F.try_element_at(F.create_map(*[F.lit(x) for lang in sorted(values) for x in (lang, values[lang])]), F.col("lang"))


def fit(docs: DataFrame, *, lang: str = "lang", text: str = "text", per_language: int = TRAIN_DOCS) -> Model:
    """A model of the languages in ``docs``. Rows without a language or text teach nothing; without
    any such row the model has no languages. Copies of a text teach once, and every language that
    has a text is learned. A language is a candidate for the scripts that its texts have words in."""
    ship_package(docs.sparkSession)
    labelled = docs.select(F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("text")).where("lang is not null and text is not null")
    sample = _drawn(labelled, per_language)
    schema = "lang string, gram string, script string, n long"

    def count(batches):
        totals: dict[tuple, int] = {}
        for batch in in_slices(batches, "text"):
            pieces: dict[str, Counter] = {}
            for language, body in zip(batch.column("lang").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist(), strict=True):
                pieces.setdefault(language, Counter()).update(body.translate(_TEXT).split())
            for language, counted in pieces.items():
                for piece, n in counted.items():
                    for word in letter_runs(piece):
                        script = (language, None, script_of(word))
                        totals[script] = totals.get(script, 0) + n
                        for at in range(0, len(word), LONG_WORD):
                            for gram in grams_of(word[at : at + LONG_WORD]):
                                totals[language, gram, None] = totals.get((language, gram, None), 0) + n
            if len(totals) > 200_000:
                yield _count_rows(totals)
                totals = {}
        yield _count_rows(totals)

    def _count_rows(totals):
        keys = list(totals)
        return pa.RecordBatch.from_arrays(
            [pa.array([k[i] for k in keys], pa.string()) for i in range(3)] + [pa.array(list(totals.values()), pa.int64())], names=["lang", "gram", "script", "n"]
        )

    counts = sample.mapInArrow(count, schema).groupBy("lang", "gram", "script").agg(F.sum("n").alias("n")).collect()  # of TRAIN_DOCS texts
    words: dict[str, dict[str, int]] = {}
    grams: dict[str, dict[str, int]] = {}
    for r in counts:
        if r.gram is None:
            words.setdefault(r.script, {})[r.lang] = r.n
        else:
            grams.setdefault(r.gram, {})[r.lang] = r.n
    totals = Counter()
    for seen in grams.values():
        totals.update(seen)
    languages = tuple(sorted(totals))
    # half a count more for every sequence, seen or not
    size = np.array([totals[x] for x in languages]) + 0.5 * (len(grams) + 1)
    numbered = sorted((gram_key(gram), gram) for gram in grams)
    seen = np.array([[grams[gram].get(x, 0) for x in languages] for _, gram in numbered]).reshape(len(grams), len(languages))
    rows = np.log2((np.vstack((np.zeros(len(languages)), seen)) + 0.5) / size) if languages else np.empty((1, 0))
    return Model(
        languages, np.array([key for key, _ in numbered], np.int64), np.vstack((np.zeros(len(languages)), rows)),
        {script: tuple(x in by for x in languages) for script, by in words.items()},
    )


def viterbi(scores: np.ndarray, penalty: float) -> np.ndarray:
    """The state of every row on the path with the largest sum less ``penalty`` per change; of equal
    ways the one that stays, and of equal states the first."""
    n, k = scores.shape
    if not n:
        return np.empty(0, np.int64)
    total = scores.sum(0)
    best = int(total.argmax())
    if steady(scores, best, penalty):
        return np.full(n, best)
    value = scores[0].tolist()
    came = np.empty((n, k), np.uint8 if k <= 256 else np.uint32)
    for first in range(1, n, WORDS_AT_ONCE):
        rows = scores[first : first + WORDS_AT_ONCE].tolist()
        before = []
        for row in rows:
            before.append(value)
            jump = max(value) - penalty
            value = [(v if v >= jump else jump) + x for v, x in zip(value, row, strict=True)]
        held = np.array(before)
        stays = held >= held.max(axis=1, keepdims=True) - penalty
        came[first : first + len(rows)] = np.where(stays, np.arange(k), held.argmax(axis=1)[:, None])
    path = np.empty(n, np.int64)
    state = value.index(max(value))
    origins = memoryview(came.reshape(-1))
    for t in range(n - 1, 0, -1):
        path[t] = state
        state = origins[t * k + state]
    path[0] = state
    return path


def steady(scores: np.ndarray, best: int, penalty: float) -> bool:
    """Whether staying in ``best`` throughout is surely a best path.

    A detour over a stretch gains at most the largest sum of the difference to ``best`` over any
    stretch; if for every language that is no more than one penalty, and the largest gains at
    the two ends together are no more than one, no set of changes pays.
    """
    gain = np.cumsum(np.vstack((np.zeros(scores.shape[1]), scores - scores[:, best : best + 1])), axis=0)
    stretch = (gain - np.minimum.accumulate(gain, axis=0)).max()
    start = gain.max()
    end = (gain[-1] - gain).max()
    return stretch <= penalty and start + end <= penalty


class Labeller:
    """Labels texts; keeps the scores of words it has seen."""

    def __init__(self, model: Model, penalty: float = SWITCH):
        self.model, self.penalty = model, penalty
        self.clear()

    def clear(self) -> None:
        self.known = 0
        self.scores = np.zeros((1024, len(self.model.languages)), np.float32)
        self.letters = np.zeros(1024, np.float32)
        self.at: dict[bytes, int] = {}
        self.several: dict[bytes, range] = {}

    def _learn(self, pieces: set[bytes]) -> None:
        """Score the words of new pieces; ``at`` has the place of a piece's only word, or -1."""
        words: list[str] = []
        for piece in pieces:
            first = self.known + len(words)
            found = letter_runs(piece)
            words += found
            self.at[piece] = first if len(found) == 1 else -1
            if len(found) != 1:
                self.several[piece] = range(first, first + len(found))
        need = self.known + len(words)
        if need > len(self.letters):
            more = max(need, 2 * len(self.letters)) - len(self.letters)
            self.scores = np.pad(self.scores, ((0, more), (0, 0)))
            self.letters = np.pad(self.letters, (0, more))
        self.scores[self.known : need] = self.model.scores(words)
        self.letters[self.known : need] = [len(word) for word in words]
        self.known = need

    def label(self, text: bytes | None):
        """(spans, language, score): spans of (language, first word, words); None without a letter."""
        pieces = text.translate(_TEXT).split() if text else []
        if self.known > WORDS_KEPT:
            self.clear()
        new = set(pieces).difference(self.at)
        if new:
            self._learn(new)
        if not pieces:
            return [], None, 0.0
        places = np.fromiter(map(self.at.__getitem__, pieces), np.int64, len(pieces))
        if (places < 0).any():  # pieces of no word or of several
            places = np.array([p for piece, at in zip(pieces, places.tolist(), strict=True) for p in (self.several[piece] if at < 0 else (at,))], np.int64)
        if not len(places) or not self.model.languages:
            return [], None, 0.0
        scores, letters = self.scores[places].astype(np.float64), self.letters[places]
        path = viterbi(scores, self.penalty)
        k = len(self.model.languages)
        share = np.bincount(path, letters, k)
        chosen = int(share.argmax())
        # how far the words of the chosen language stand above the next one, times its share
        own = scores[path == chosen]
        lead = np.delete(own.sum(0)[chosen] - own.sum(0), chosen)
        margin = float(lead.min()) / len(own) if k > 1 else 1.0
        score = share[chosen] / share.sum() * (1 - 0.5 ** (1 + max(0.0, margin) * min(len(own), 20)))
        edges = np.flatnonzero(np.diff(path)) + 1
        first = np.concatenate(([0], edges))
        size = np.diff(np.append(first, len(path)))
        spans = [(self.model.languages[path[f]], int(f), int(s)) for f, s in zip(first, size, strict=True)]
        return spans, self.model.languages[chosen], float(min(1.0, max(0.0, score)))


RESULT = T.StructType(
    [
        T.StructField("lang", T.StringType()), T.StructField("score", T.DoubleType()),
        T.StructField("spans", T.ArrayType(T.StructType([
            T.StructField("lang", T.StringType()), T.StructField("first_word", T.LongType()), T.StructField("n_words", T.LongType()),
        ]))),
    ]
)


def identify(docs: DataFrame, model: Model, *, text: str = "text", into: str = "language", penalty: float = SWITCH) -> DataFrame:
    """``docs`` with a struct ``into``: lang, score (0 to 1) and the spans (lang, first_word, n_words).

    Null texts and texts without a letter, and all texts under a model without languages, are
    ``und`` with score 0 and no spans. Words without a script of any learned language go with their
    neighbours. All columns and repeated rows stay; ``into`` must be a new name.
    """
    if into in docs.columns:
        raise ValueError(f"the documents already have a column {into}")
    ship_package(docs.sparkSession)
    work = fresh(docs.columns, "language_work")
    shared, name = docs.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex  # bounded by TRAIN_DOCS per language
    schema = T.StructType([*docs.schema.fields, T.StructField(work, RESULT)])

    def label(batches):
        from pyspark.sql.pandas.types import to_arrow_type

        kind = to_arrow_type(RESULT)
        labeller = held(("language", name), lambda: Labeller(shared.value, penalty))
        for batch in in_slices(batches, text):
            rows = []
            for x in batch.column(batch.schema.names.index(text)).cast(pa.binary()).to_pylist():
                spans, lang, score = labeller.label(x)
                rows.append({"lang": lang or "und", "score": score, "spans": [{"lang": a, "first_word": b, "n_words": c} for a, b, c in spans]})
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rows, kind)], names=[*batch.schema.names, work])

    return docs.mapInArrow(label, schema).withColumnRenamed(work, into)


def held_out(key: str = "doc_id"):
    """Rows that teach nothing: a quarter of the keys by their CRC-32."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def in_known_language(docs: DataFrame, model: Model, *, text: str = "text", **options) -> DataFrame:
    """The documents that are in one of the model's languages; columns as before."""
    mark = fresh(docs.columns, "language")
    return identify(docs, model, text=text, into=mark, **options).where(F.col(mark)["lang"] != "und").drop(mark)
