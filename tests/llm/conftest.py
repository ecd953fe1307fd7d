import pytest


@pytest.fixture
def frame(spark):
    def make(rows, schema="doc_id long, text string, lang string, source string"):
        width = len(schema.split(","))
        return spark.createDataFrame([tuple(r) + (None,) * (width - len(r)) for r in rows], schema)

    return make


@pytest.fixture
def odd(frame):
    """Nulls, empty and very long texts, ties, repeated rows, and columns whose names the operators use themselves."""
    rows = [
        (1, None), (2, ""), (3, "same text here of five words"), (4, "same text here of five words"), (4, "same text here of five words"), (None, "same text here of five words"), (None, None),
        (5, "x" * 200_000), (6, "lorem ipsum " * 30_000), (7, " \n\t "), (8, "é漢字 😀 ½ token=abcdefgh12"), (9, "0123456789abcdef" * 4),
    ]
    names = ("row", "body", "key", "head", "keep_id", "component_id", "n", "kept", "s", "place", "rep", "hub", "queue", "slot", "words")
    df = frame(rows)
    for n in names:
        df = df.selectExpr("*", f"'clash' as `{n}`")
    return df


@pytest.fixture
def none(frame):
    return frame([])
