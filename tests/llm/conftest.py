import random

import pytest

#: Rows that every operator must take: nulls, empty, blank and very long texts, ties, repeated rows.
LONG = " ".join(f"w{i % 977}x{i}" for i in range(60_000))


def odd_rows():
    random.seed(5)
    words = ["the", "cat", "sat", "on", "ñandú", "über", "été", "mat", "and", "ran", "home", "42", "go!", "世界", "dog's"]
    base = [" ".join(random.choice(words) for _ in range(random.randint(1, 60))) for _ in range(60)]
    rows = list(enumerate(base))
    rows += [(100, None), (101, ""), (102, " \n\t "), (103, "a"), (104, "A"), (105, "one two"), (106, LONG), (107, "x" * 5000), (108, "😀 é́ \x00 end")]
    rows += [(200 + i, base[0]) for i in range(30)] + [(300, base[1] + " "), (301, base[1].replace(" ", "\n")), (7, base[7]), (None, "no id here"), (None, None)]
    rows += [(400 + i, base[3] + f" tail{i}") for i in range(5)]
    return rows


@pytest.fixture(scope="session")
def odd(spark):
    """The odd rows with columns whose names operators use inside."""
    data = [(i, t, "en" if (i or 0) % 2 else None, t, i) for i, t in odd_rows()]
    schema = "doc_id long, text string, lang string, row string, id long"
    return spark.createDataFrame(data, schema).withColumnRenamed("row", "raw").repartition(5).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
