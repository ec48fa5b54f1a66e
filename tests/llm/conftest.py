import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp long, key string, spans string, row long, ids string, held_out string, word string, `_t` string"


@pytest.fixture(scope="session")
def messy(spark):
    """Null ids and texts, empty and very long texts, ties, repeated rows, and further columns whose names the operators use themselves."""
    word = "the red ring of thontion and erst inges was"
    long = " ".join(f"{word} {i * 7919 % 100_003}" for i in range(3_000))
    texts = [
        (1, "One two three four five six seven eight nine ten"), (2, "one two three four five six seven eight nine TEN"), (3, None), (4, ""), (5, " \t\n "), (6, long), (6, long), (None, "no id here a@b.cd"), (None, None),
        (7, "x" * 50_000), (8, 'token = "0123456789abcdef0123456789abcdef" mail z.z@ex.org, +1 (555) 555-1234 or 10.0.0.1'), (9, "\x00 odd \x01 \x1c\x1f  　 ßÉ日本語 <|endoftext|> <|startoftext|> 🙂"), (10, "a  b\n\n c \n"), (11, "one"), (12, "one"),
    ]
    rows = [(i, t, None, "s", None if t is None else len(t), 1, "k", "s", 2, "i", "h", "w", "t") for i, t in texts]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def empty(messy):
    return messy.limit(0)
