import hashlib
import random

import pytest

from docloom.llm.substrings import SuffixAutomaton, substring_dedup, substring_report

from .conftest import prose, rows_of


def brute(rows, length=50):
    words = [(d, (t or "").encode().split()) for d, t in rows]
    first = {}
    for d, w in words:
        for i in range(len(w) - length + 1):
            k = tuple(w[i : i + length])
            if d is not None and (k not in first or d < first[k]):
                first[k] = d
    out = []
    for d, w in words:
        gone = set()
        for i in range(len(w) - length + 1):
            if d is not None and first[tuple(w[i : i + length])] < d:
                gone.update(range(i, i + length))
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=lambda r: tuple((x is not None, str(x)) for x in r))


@pytest.mark.parametrize("bound", [1, 2000])
def test_against_brute_force(spark, bound):
    rng = random.Random(bound)
    base = [prose(rng, 120).split() for _ in range(6)]
    rows = []
    for d in range(60):
        w = []
        for _ in range(3):
            part = list(rng.choice(base)) if rng.random() < 0.6 else prose(rng, 40).split()
            for _ in range(rng.choice([0, 0, 1, 3])):
                part[rng.randrange(len(part))] = "edit" + str(rng.randrange(9))
            w += part[rng.randrange(20) :]
        rows.append((d, rng.choice([" ", "\n", " \t"]).join(w)))
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = substring_dedup(df, bound=bound).selectExpr("doc_id", "n_words", "n_removed", "sha2(kept, 256)")
    assert rows_of(got) == brute(rows)
    assert sum(r[2] for r in brute(rows)) > 0


def test_odd_rows(odd, clashing):
    want = brute([(r.doc_id, r.text) for r in odd.collect()])
    assert rows_of(substring_report(odd)) == want
    assert rows_of(substring_report(clashing)) == want


def test_empty(nothing):
    assert substring_report(nothing).collect() == []


def test_automaton_matches():
    rng = random.Random(3)
    a = SuffixAutomaton()
    known = ["".join(rng.choice("ab") for _ in range(rng.randrange(1, 30))) for _ in range(30)]
    for k in known:
        a.add(list(k))
    for _ in range(50):
        q = "".join(rng.choice("ab") for _ in range(40))
        want = [max((n for n in range(i + 2) if any(q[i + 1 - n : i + 1] in k for k in known)), default=0) for i in range(len(q))]
        assert a.matches(list(q)) == want


def thue_morse(bits):
    out = "a"
    for _ in range(bits):
        out += out.translate(str.maketrans("ab", "ba"))
    return out


def test_words_that_collide_under_polynomial_hashes(spark):
    """Two words of 1,024 letters whose difference every polynomial hash modulo 2^64 maps to zero are different words."""
    one = thue_morse(10)
    other = one.translate(str.maketrans("ab", "ba"))
    words = [f"w{i}" for i in range(30)]
    rows = [(1, " ".join([*words, one, *words])), (2, " ".join([*words, other, *words]))]
    got = substring_report(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.doc_id: (r.n_words, r.n_removed) for r in got.collect()} == {1: (61, 0), 2: (61, 0)}


def test_windows_of_two_words_in_every_order(spark):
    """The same for windows: sequences of two words in the order of the Thue-Morse pattern and its inverse."""
    one = " ".join(thue_morse(6))
    rows = [(1, one), (2, one.translate(str.maketrans("ab", "ba"))), (3, one + " c")]
    got = substring_report(spark.createDataFrame(rows, "doc_id long, text string"))
    assert rows_of(got) == brute(rows)


def test_a_long_text_of_one_word(spark):
    rows = [(1, "same " * 200_000), (2, "same " * 60 + "end")]
    got = substring_report(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.doc_id: (r.n_words, r.n_removed) for r in got.collect()} == {1: (200_000, 0), 2: (61, 60)}
