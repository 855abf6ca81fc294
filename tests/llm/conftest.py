import pytest


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls, empty, repeated and long texts, and columns whose names the operators use themselves."""
    rows = [
        (1, "The cat sat on the mat, and the dog saw it.", "en", "a", 1, 0.5, "x"),
        (2, "The cat  sat on the mat,\nand the dog saw it.", "en", "a", 1, 0.5, "x"),
        (2, "The cat  sat on the mat,\nand the dog saw it.", "en", "a", 1, 0.5, "x"),
        (3, None, None, None, None, None, None),
        (4, "", "en", "b", 0, None, None),
        (5, " \t\n", "en", "b", 3, None, None),
        (None, "no id here", "de", "b", 3, None, None),
        (None, None, None, None, None, None, None),
        (6, "wörter und zeichen äöü ß 中文 😀 +1 (555) 123-4567 a@b.co", "de", "b", 3, 1.0, "z"),
        (7, "x" * 30000, "en", "c", 30000, None, None),
        (8, "word " * 20000, "en", "c", 100000, None, None),
        (9, "<|endoftext|> it's <|startoftext|>", "en", "c", 5, None, None),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score double, fp string")


@pytest.fixture(scope="session")
def nothing(odd):
    return odd.limit(0)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(k, k % 2, k % 3 == 0) for k in range(1, 10)] + [(1, 1, True), (None, 1, None)], "doc_id long, quality int, toxic boolean").selectExpr(
        "doc_id", "quality", "CAST(toxic AS int) AS toxic"
    )
