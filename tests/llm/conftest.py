import pytest

#: Texts that ask for care: empty, null, white space of many kinds, very long, repeated, not ASCII.
ODD_TEXTS = [
    None, "", " ", "\n", "a", "  two  spaces ", "tab\there", "line\nline\n\nline", "end. \nNext", "x\x1cy z", "café über naïve 　wide", "it's we'll DON'T",
    "<|endoftext|> plain", "a <|endoftext|> b", "x<|startoftext|> y", "Straße ŒUVRE ﬁ Ünï µm ªº", "a, b. c!\nD e1 22 3", "\nopens", "closes\n", "a\0b c", "12 345 6a7", "###$$$ a%%% b", "A B C " * 3000, "word " * 9000, "é ́x", "ΣΑΣ Σ", "no-break line", "a" * 5000,
]


@pytest.fixture(scope="session")
def odd_docs(spark):
    rows = [(i, t, "en", "s", 1) for i, t in enumerate(ODD_TEXTS)] + [(None, "null id", None, None, None), (3, "\n", "en", "s", 1), (3, "again", "en", "s", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)
