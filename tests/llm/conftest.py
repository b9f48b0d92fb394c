import pytest

LONG = " ".join(f"w{i % 977}x{i % 13}" for i in range(30_000))


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and blank texts, one very long text, ties, repeated rows, and odd characters."""
    passage = " ".join(f"p{i}" for i in range(60))
    return [
        (1, None), (2, ""), (3, " \t\n "), (4, "one"), (5, "three little words"), (6, LONG), (7, passage + " tail a"), (8, "head " + passage),
        (9, passage + " tail a"), (9, passage + " tail a"), (None, "a row without an id " + passage), (None, None), (12, "日本語 テキスト 🙂 naïve space wide é\n\n\nend "),
        (13, "x<|endoftext|>y <|endoftext|>"), (14, "Same Line\nSame Line\nOther\n"),
    ]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    """The rows above with columns whose names operators use themselves."""
    rows = [(i, t, "en", None, 5, 0.5, 1, "k", b"v", True, "x", *range(10, 20)) for i, t in odd_rows]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score double, n_words long, key string, values binary, _copy boolean, kept_text string, _row long, _n long, rank long, _salt long, _before long, _inner long, row long, held long, part long, sequence_id long").repartition(3)


@pytest.fixture(scope="session")
def empty(odd):
    return odd.where("false")


@pytest.fixture(scope="session")
def odd_labels(spark):
    return spark.createDataFrame([(4, 1, 0), (5, 0, 1), (6, 1, None), (None, 1, 1), (7, None, 0), (8, 1, 0), (8, 1, 0), (99, 0, 1)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="session")
def no_labels(odd_labels):
    return odd_labels.where("false")
