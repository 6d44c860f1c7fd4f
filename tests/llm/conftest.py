import pytest

#: Texts at the edges: none, empty, white space alone, odd white space, special strings, marks that
#: combine over a cut, long words, long texts, repeated texts.
EDGES = [
    None, "", " ", "  \n\t ", "a", "one  two   three", " lead", "trail ", "tab\tand\nline\n\nend",
    "don't we'll I'M it's", "x<|endoftext|>y <|startoftext|>", "caf́e e ́x é",
    "no break and wide\x1cfile\x85next", "ÉCOLE Straße İstanbul ΣΑΣ", "日本語 テキスト",
    "THE!! OF!! a*** b%%% c$$$ d&&& e### <b>|x|</b>", "w" * 5000, "mot " * 3000, "mot " * 3000,
    "12 345 6.7e8 ½ ²", "a\n b \n c", "emoji 😀😀 ok", "\u0000 nul \u0001",
]


@pytest.fixture(scope="session")
def edges(spark):
    """The edge texts as documents with a null id, a repeated row and columns whose names clash with
    those of results."""
    rows = [(i, t, "en", "s", 0, 1.0, True) for i, t in enumerate(EDGES)]
    rows += [(None, "no id here", "en", None, None, None, None), rows[5], rows[5]]
    return spark.createDataFrame(
        rows, "doc_id long, text string, lang string, source string, n_chars long, "
              "n_words double, kept boolean").repartition(3)


@pytest.fixture(scope="session")
def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="session")
def nothing(documents):
    return documents.limit(0)
