import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns that operators use inside, so that a clash would show.
CLASHING = ("id", "h", "size", "block", "target", "keep", "score", "fp", "ids", "chunk", "n", "words", "_hash", "_text_hash", "_row_hash", "_quality", "_kept_id", "_kept_hash", "_id", "_h", "_y", "_source", "_cut", "_cut_id", "_cut_hash", "_text", "_q", "_qid", "_QHash", "k", "root", "row")

LONG = ("lorem ipsum dolor sit amet consectetur " * 3000).strip()


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in any column, empty and very long texts, ties, repeated rows."""
    passage = " ".join(f"w{k}" for k in range(60))
    return [
        (1, None, None, None, None),
        (2, "", "en", "a", 0),
        (3, "   \n\t ", "en", "a", 6),
        (4, "one", "en", "a", 3),
        (5, "One two THREE four five", "en", "a", 23),
        (6, "one two three four five", "en", "b", 23),
        (6, "one two three four five", "en", "b", 23),
        (6, "one two three four five", "en", "b", 23),
        (7, LONG, "de", "b", len(LONG)),
        (8, LONG + " extra", "de", None, len(LONG) + 6),
        (9, "x" * 50_000, "fr", "c", 50_000),
        (10, "naïve café ÀÉÎ — “quotes” 12½ 日本語 İΣ 😀<|endoftext|>it's", "fr", "c", 40),
        (11, "first\n" + passage + "\nlast", "en", "a", None),
        (12, "other\n" + passage + "\nend", "en", None, 5),
        (None, "no id here at all", "en", "a", 17),
        (None, None, "en", "a", None),
    ]


@pytest.fixture
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, SCHEMA)


@pytest.fixture
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture
def clashing(spark, odd_rows):
    """The same rows with further columns under names that the operators use, each holding 7."""
    return spark.createDataFrame([(*r, *[7] * len(CLASHING)) for r in odd_rows], ", ".join([SCHEMA, *(f"{c} long" for c in CLASHING)]))


@pytest.fixture
def unharmed():
    """Whether a result has the columns of ``clashing``, the further ones unchanged, and returns it without them."""

    def check(df):
        assert df.columns == [c.split()[0] for c in SCHEMA.split(", ")] + list(CLASHING)
        for r in df.collect():
            assert tuple(r)[5:] == (7,) * len(CLASHING)
        return df.select(*df.columns[:5])

    return check


@pytest.fixture
def documents(spark, small):
    return spark.read.parquet(f"{small}/documents.parquet")


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture
def same_rows():
    return lambda a, b: rows(a) == rows(b)
