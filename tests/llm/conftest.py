import pytest


def edge_rows():
    """Documents with nulls in any column, empty and long texts, ties, repeats; the last columns clash with outputs' names."""
    long = " ".join(f"w{i % 977} thing{i % 13}" for i in range(30_000))
    passage = " ".join(f"common{i}" for i in range(40))
    texts = [
        (1, f"A first line of text\n{passage}\nend one"),
        (2, f"Another opening here\n{passage}\nend two"),
        (2, f"Another opening here\n{passage}\nend two"),
        (3, None),
        (4, ""),
        (5, long),
        (6, long),
        (7, " \n\t\n"),
        (8, f"x {passage} y {passage} z"),
        (9, "short"),
        (10, "short"),
        (None, f"{passage} without an id"),
        (None, None),
        (11, f"A FIRST LINE of text  \nÉté İstanbul ΣΑΣ <|endoftext|> ▁a  b"),
    ]
    return [(i, t, None if k % 3 else "en", "s", k, "extra") for k, (i, t) in enumerate(texts)]


SCHEMA = "doc_id bigint, text string, lang string, source string, n_words bigint, _drops string"


@pytest.fixture(scope="session")
def edge(spark):
    return spark.createDataFrame(edge_rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
