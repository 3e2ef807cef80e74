import pytest

SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"

#: Rows that every operator on documents must survive: nulls in any column,
#: empty, blank and very long texts, ties and repeated rows, odd characters.
ODD_TEXTS = [
    None, "", " ", "\n", "\n\n a", "one", "  two  spaces ", "a\nb\n\nc", "tab\tand\x0bother\x1cmarks",
    "It's the dog's; they'll go -- UPPER.\nUPPER. 12345 3.14", "é" * 50 + " naïve café́ ﬁ", "日本語 テキスト",
    "x" * 30_000, "long word list " * 4_000, "<|endoftext|> and <s> </s> ▁ mark", "zero\x00byte", "repeat me\nrepeat me\nrepeat me",
    "emoji 😀😀 text", " nbsp wide", "a" * 5 + "\r\n" + "b",
]


@pytest.fixture(scope="session")
def odd_docs(spark):
    rows = [(i, t, [None, "en", "fr"][i % 3], [None, "src0"][i % 2], 0, "clash", 7) for i, t in enumerate(ODD_TEXTS)]
    rows += [(None, "no id here", "en", "src0", None, None, 1), (5, "one", "en", "src0", 3, "x", 1), (5, "one", "en", "src0", 3, "x", 1)]
    # columns besides the documented ones, with names that operators use themselves
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, k string, n_tokens int")


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SF001}/documents.parquet")
