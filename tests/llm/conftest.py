import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng, n, words=None):
    words = words or ["the", "river", "stone", "walks", "under", "seven", "bright", "moons", "and", "sings", "of", "old", "paper", "ships", "that", "never", "came", "home", "again", "today"]
    return " ".join(rng.choice(words) + rng.choice(["", "", "", "s", "ing"]) for _ in range(n))


def odd_rows():
    """Nulls in each column, empty and blank texts, odd white space, a long text, ties and repeated rows."""
    rng = random.Random(5)
    long = prose(rng, 6000)
    shared = prose(rng, 70)
    rows = [
        (1, prose(rng, 80) + "\n" + shared, "en", "a"),
        (2, None, "en", "a"),
        (3, "", "fr", "b"),
        (4, " \t\n\x0b\x0c\r ", "fr", "b"),
        (5, long, None, "b"),
        (6, "x" * 50_000, "de", None),
        (7, shared + " " + prose(rng, 60), "en", "a"),
        (8, "one two three", "en", "a"),
        (8, "one two three", "en", "a"),
        (None, shared + " end", "en", "a"),
        (None, None, None, None),
        (9, "nb\xa0sp\x85 É日本   " + shared.upper(), "en", "a"),
        (10, long, "en", "a"),
        (11, shared, "en", "a"),
    ]
    return [(*r, None if r[1] is None else len(r[1])) for r in rows]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def clashing(odd):
    """More columns, named like those that operators use or return."""
    from pyspark.sql import functions as F

    names = ["row", "h", "c", "fp", "root", "component_id", "kept", "n_words", "words", "spans", "found", "pairs", "start", "length", "piece", "part", "ids", "hot", "runs", "w", "item", "size", "lines", "path", "given", "id", "of", "other", "every", "now", "reading", "quote", "__row", "__id", "__found", "__bad"]
    return odd.select("*", *[F.lit(i).alias(n) for i, n in enumerate(names)])


def rows_of(df, *order):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: tuple((x is not None, str(x)) for x in r))
