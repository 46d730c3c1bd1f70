import random

import pytest

from docloom.llm.secrets import mask_secrets, secret_report

from .conftest import prose

ALNUM = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"


def planted(rng, alphabet, length, form):
    """Rows of prose with one key each, and doc_id to key."""
    rows, keys = [], {}
    for d in range(60):
        w = prose(rng, 40).split()
        keys[d] = "".join(rng.choice(alphabet) for _ in range(length))
        w.insert(rng.randrange(1, len(w)), form.replace("VALUE", keys[d]))
        w.insert(0, "/usr/share/walks/under/stones/and/rivers")
        rows.append((d, " ".join(w)))
    return rows, keys


@pytest.mark.parametrize("form", ["AWS_SECRET_ACCESS_KEY=VALUE", "SECRET_KEY=VALUE", "auth=VALUE", "sig=VALUE==", "https://example.org/a?id=7&key=VALUE&x=1"])
def test_values_of_assignments(spark, form):
    rows, keys = planted(random.Random(7), ALNUM, 40, form)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = 0
    for r in secret_report(docs).collect():
        at = rows[r.doc_id][1].index(keys[r.doc_id])
        found += any(int(a) == at for _, a, _ in (x.split(":") for x in r.spans.split(",") if x))
    assert found >= 54
    assert sum(keys[d] not in t for d, t in mask_secrets(docs).collect()) >= 54


@pytest.mark.parametrize("length", [24, 32, 40, 64, 128])
def test_upper_case_hex_keys(spark, length):
    rows, keys = planted(random.Random(length), "0123456789ABCDEF", length, "VALUE")
    found = 0
    for r in secret_report(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        at = rows[r.doc_id][1].index(keys[r.doc_id])
        found += f"random:{at}:{at + length}" in r.spans.split(",")
    assert found >= 48
