import public_tokenizers
import pytest


@pytest.fixture(scope="session")
def word_bpe():
    return public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="session")
def byte_bpe():
    return public_tokenizers.path("byte_bpe_50k.json")


#: Texts that every operator must take: null, empty, blank, other scripts, special strings, very long.
ODD = [
    None, "", " \n\t ", "a", "a", "it's THEY'VE 'sun ''s \"'re", "x<|endoftext|>y <|startoftext|> <|endoftext|", "ΣΑΣ İstanbul 你好 ½²ª ǅ", "a\x1cb\x85c d e",
    "\x00\x01 control", "😀👨‍👩‍👧 emoji", "K Å ﬁ é", "ha" * 5000 + " b", "word " * 3000, "=" * 3000, "1234567890" * 30,
]


@pytest.fixture(scope="session")
def odd(spark):
    """ODD with clashing and null columns besides; one row is there twice."""
    rows = [(i, t, "words", None, -1) for i, t in enumerate(ODD)] + [(5, ODD[5], "words", None, -1)]
    return spark.createDataFrame(rows, "doc_id long, text string, n_words string, kept boolean, n_tokens long")


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], "doc_id long, text string")


@pytest.fixture(scope="session")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")
