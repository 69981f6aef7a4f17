import pytest

#: Texts that every operator on texts has to bear: null, empty, blank, one character, odd white space, controls, long ones, copies.
ODD_TEXTS = [
    None, "", " ", "\n", "\n\n", "a", "É", "\x1c\x1fx\x00y", "</s>[INST] \\ <s>", "don't STOP 123 ½ ٣ ² ǅ ß İ ΑΣ", "<|endoftext|> a<|startoftext|>b", "é 한국어 🎉👍🏽 ​", "word " * 30000,
    "x" * 20000, "A line that is long enough to count\nshort", "a line that is long enough to count  \nshort", "\tA LINE that is long enough to count", "same same same same same", "same same same same same",
]


@pytest.fixture(scope="session")
def docs(spark):
    """Odd texts with a null id, a repeated row and columns of clashing names."""
    rows = [(i, t, i % 2, "k", 1.0) for i, t in enumerate(ODD_TEXTS)] + [(3, ODD_TEXTS[3], 1, "k", 1.0), (None, "no id at all here", 0, "k", 1.0)]
    return spark.createDataFrame(rows, "doc_id long, text string, n_tokens long, lang string, score double")


@pytest.fixture(scope="session")
def no_docs(docs):
    return docs.where("false")
