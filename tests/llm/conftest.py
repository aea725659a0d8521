"""A small table of documents with every odd case, and one without rows."""

import pytest

LONG = " ".join(f"w{k % 977}" for k in range(30_000))
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, n_tokens string, size string, score string, spans string, kept string, row string, h string"


@pytest.fixture(scope="session")
def odd(spark):
    texts = ["The quick brown fox jumps over the lazy dog again and again today", "the  quick brown\tfox jumps over the lazy dog again and again today", None, "", "   ", "one", "two words", LONG, LONG, "x" * 30_000, "é ñ 中文 😀 <|endoftext|> tail", "the quick brown fox jumps over the lazy dog again and again tonight"]
    rows = [(k, t, None if k % 3 == 0 else "en", None if k == 4 else f"s{k % 2}", None, "clash", "clash", "clash", "clash", "clash", "clash", "clash") for k, t in enumerate(texts)]
    rows += [rows[0], (None, "a row without an id", None, None, None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
