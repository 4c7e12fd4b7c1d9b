from __future__ import annotations

import pytest

from depotcast.llm.common import ship_package

#: Documents with what the operators must survive; ``extra`` columns are named like their own.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, text_1 string, fingerprint string, leaks int"


@pytest.fixture(scope="session", autouse=True)
def shipped(spark):
    ship_package(spark)


def docs_of(spark, texts, first: int = 0):
    """One row per text, with clashing extra columns."""
    return spark.createDataFrame(
        [(first + i, x, "en", "s", None if x is None else len(x), "k", "t", "f", 7) for i, x in enumerate(texts)], SCHEMA
    )


#: Nulls, blanks, repeated rows, odd characters, and a long text.
ODD = [
    None, "", "   ", "\n\t", "a", "A b", "one two three", "one two three", "é ß İ 中文 😀 \u0085 x\xa0y", "<|endoftext|> </s>[INST]",
    "tab\tand\x0bother\x0cblanks\r\n", "it's  two  blanks ", "word " * 3000, "x" * 20000, "1234567890 !!?? ...",
]
