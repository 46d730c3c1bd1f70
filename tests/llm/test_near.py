import random

import numpy as np
import pytest

from docloom.llm.near import _SEEDS, _pairs_of, _shingles, near_candidates, near_components, near_dedup
from docloom.llm.shingles import mix

from .conftest import rows_of
from .test_simhash import closed


def shingles(text, size=5):
    w = bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode()).split()
    return {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))}


def copies(rng):
    """Texts of 60 to 200 words and copies in which some words differ, at similarities around 0.8."""
    rows = []
    for _ in range(60):
        w = [f"w{rng.randrange(4000)}" for _ in range(rng.randrange(60, 200))]
        rows.append(" ".join(w))
        for _ in range(rng.randrange(4)):
            v = list(w)
            for _ in range(rng.choice([0, 1, 1, 2, 3, 4])):
                v[rng.randrange(len(v))] = "other"
            rows.append(" ".join(v).replace("w1", rng.choice(["w1", "W1"])))
    rng.shuffle(rows)
    return [(3 * d + 5, t) for d, t in enumerate(rows)]


def groups(rows, similarity=0.8):
    sets = [shingles(t) for _, t in rows]
    links = [(i, j) for i in range(len(rows)) for j in range(i) if len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= similarity]
    return closed(links, range(len(rows))), links, sets


def test_pairs_of_sets(monkeypatch):
    monkeypatch.setattr("docloom.llm.near.CELLS", 64)
    rng = np.random.default_rng(2)
    for m in (2, 3, 20):
        sets = [np.unique(rng.integers(0, 60, 90).astype(np.uint64)) for _ in range(m)]
        want = [(i, j) for i in range(m) for j in range(i + 1, m) if len(np.intersect1d(sets[i], sets[j])) / len(np.union1d(sets[i], sets[j])) >= 0.65]
        assert sorted(zip(*(x.tolist() for x in _pairs_of(sets, 0.65)), strict=True)) == want


@pytest.mark.parametrize(("bound", "members"), [(2_000_000, 2000), (600, 3)])
def test_a_group_that_is_apart(spark, bound, members):
    """Many copies of one text, each with words changed, mostly less similar to each other than the bound: groups as by brute force, whole and in blocks."""
    rng = random.Random(6)
    base = [f"w{rng.randrange(4000)}" for _ in range(120)]
    rows = []
    for d in range(150):
        w = list(base)
        for _ in range(rng.choice([1, 2, 3, 4])):
            w[rng.randrange(120)] = f"x{rng.randrange(5)}"
        rows.append((d, " ".join(w)))
    group, _, _ = groups(rows)
    got = near_components(spark.createDataFrame(rows, "doc_id long, text string"), bound=bound, members=members).collect()
    root = {r.doc_id: r.root for r in got}
    assert {(i, j) for i in range(150) for j in range(i) if root[i] == root[j]} == {(i, j) for i in range(150) for j in range(i) if group[i] == group[j]}
    assert len(set(group.values())) > 1


def test_memberships_of_overlapping_groups_are_not_carried_on(spark, monkeypatch):
    """Copies below the similarity meet at most anchors, each time in other company: groups as by brute force, and behind the candidates no table has a row for each membership."""
    from docloom.llm import near

    rng = random.Random(9)
    base = [f"w{rng.randrange(4000)}" for _ in range(120)]
    rows = []
    for d in range(200):
        w = list(base)
        for _ in range(rng.choice([3, 4, 5, 6])):
            w[rng.randrange(120)] = f"x{rng.randrange(400)}"
        rows.append((d, " ".join(w)))
    group, _, _ = groups(rows)
    seen, write = {}, near.stored

    def counted(df, name):
        out = write(df, name)
        seen[name] = max(seen.get(name, 0), out.count())
        return out

    monkeypatch.setattr(near, "stored", counted)
    root = {r.doc_id: r.root for r in near_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {(i, j) for i in range(200) for j in range(i) if root[i] == root[j]} == {(i, j) for i in range(200) for j in range(i) if group[i] == group[j]}
    assert 1 < len(set(group.values())) and seen["candidates"] > 30 * len(rows)
    assert {name for name, n in seen.items() if n > len(rows)} <= {"candidates", "met"}
    assert seen["met"] < 0.7 * seen["candidates"]


def test_against_brute_force(spark):
    rows = copies(random.Random(3))
    group, links, sets = groups(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    root = {r.doc_id: r.root for r in near_components(docs).collect()}
    together = {(i, j) for i in range(len(rows)) for j in range(i) if group[i] == group[j]}
    assert {(i, j) for i in range(len(rows)) for j in range(i) if root[rows[i][0]] == root[rows[j][0]]} == together
    assert sum(sets[i] != sets[j] for i, j in links) > 40 and len(together) > 40
    lows = {g: min(d for (d, _), h in zip(rows, group.values(), strict=True) if h == g) for g in group.values()}
    assert {r.doc_id for r in near_dedup(docs).collect()} == set(lows.values())


def test_the_stage_removes_copies_with_a_changed_word(spark):
    import corpus_pipeline

    rng = random.Random(4)
    rows = []
    for d in range(40):
        w = [f"w{rng.randrange(4000)}" for _ in range(100)]
        rows += [(2 * d, " ".join(w)), (2 * d + 1, " ".join([*w[:50], "other", *w[51:]]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r.doc_id for r in dict(corpus_pipeline.STAGES)["near_dedup"](spark, docs, "").collect()}
    assert kept == {2 * d for d in range(40)}


def test_odd_rows(odd, clashing, nothing):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    group, _, _ = groups(rows)
    kept = near_dedup(odd)
    assert kept.columns == odd.columns and kept.count() == len(set(group.values()))
    assert near_dedup(clashing).columns == clashing.columns
    assert rows_of(near_dedup(nothing)) == []


@pytest.mark.parametrize("bound", [20_000, 6])
def test_candidates_meet_at_code_words(spark, bound):
    """Fingerprints are majorities of the shingles' hashes, and candidates are what shares the nearest code word of a part within 40 of 128 bits, all by brute force."""
    code = [w for w in range(128) if not (w & 1) * 1 ^ (w >> 1 & 1) * 2 ^ (w >> 2 & 1) * 3 ^ (w >> 3 & 1) * 4 ^ (w >> 4 & 1) * 5 ^ (w >> 5 & 1) * 6 ^ (w >> 6 & 1) * 7]
    sets = [_shingles(t.encode(), 5) for _, t in copies(random.Random(8))[:70]]
    one, parts = {}, {}
    for i, x in enumerate(sets):
        h = [mix(x ^ seed).tolist() for seed in _SEEDS[:37]]
        one[i] = [sum((2 * sum(v >> (8 * (b % 8) + b // 8) & 1 for v in w) > len(w)) << b for b in range(64)) for w in h]
        cut = [w >> 21 * p & (1 << 21) - 1 for w in one[i] for p in range(3)]
        parts[i] = [(p >> 14, *(next(c for c in code if (c ^ p >> k & 127).bit_count() < 2) for k in (0, 7))) for p in cut]
    near = lambda i, j: sum((one[i][k] ^ one[j][k]).bit_count() for k in (0, 1)) <= 40
    want = [(i, j) for i in one for j in range(i) if near(i, j) and any(a == b for a, b in zip(parts[i], parts[j], strict=True))]
    rows = [(i, len(sets[i]), np.array(w, np.uint64).view(np.int64).tolist()) for i, w in one.items()]
    found = {}
    for r in near_candidates(spark.createDataFrame(rows, "s long, n long, fp array<long>"), 2, bound).collect():
        found.setdefault(r.key, []).append(r.s)
    assert {(i, j) for g in found.values() for i in g for j in g if i > j} >= set(want) and len(want) > 10
    assert closed([(g[0], s) for g in found.values() for s in g], range(len(sets))) == closed(want, range(len(sets)))


def test_similar_texts_differ_in_few_enough_bits():
    """Of pairs at a similarity of 0.8 at least 99 in 100 share an anchor and stay within the bits compared."""
    from docloom.llm import near
    from docloom.llm.simhash import _home, code_words

    rng, home = np.random.default_rng(4), _home().astype(np.uint64)
    for blocks, words in near.WORDS.items():
        met = 0
        for _ in range(300):
            x = rng.integers(0, 2**64, 160, np.uint64, endpoint=False)
            f, g = (near._fingerprint(y, words) for y in (x[:144], x[16:]))
            a, b = (code_words(y[:, None] >> np.array([0, 21, 42], np.uint64) & np.uint64((1 << 21) - 1), blocks, home) for y in (f, g))
            met += bool((a == b).any()) and int(np.bitwise_count(f[:2] ^ g[:2]).sum()) <= near.BITS
        assert met >= 297
