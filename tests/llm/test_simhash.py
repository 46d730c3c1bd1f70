import random

import numpy as np
import pytest
import xxhash

from docloom.llm import simhash
from docloom.llm.components import components

from .conftest import prose, rows_of


def fingerprint(text):
    w = bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode()).split()
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 4]), 42) for i in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def closed(links, nodes):
    low = {n: n for n in nodes}
    moved = True
    while moved:
        moved = False
        for a, b in links:
            m = min(low[a], low[b])
            if low[a] != m or low[b] != m:
                low[a] = low[b] = m
                moved = True
    return low


def brute(rows):
    fp = [fingerprint(t) for _, t in rows]
    links = [(i, j) for i in range(len(fp)) for j in range(i) if bin(fp[i] ^ fp[j]).count("1") <= 4]
    group = closed(links, range(len(fp)))
    lows = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            lows[group[i]] = min(d, lows.get(group[i], d))
    return sorted(((d, f"{fp[i]:016x}", lows.get(group[i])) for i, (d, _) in enumerate(rows)), key=lambda r: tuple((x is not None, str(x)) for x in r))


@pytest.mark.parametrize("bound", [2, 20_000])
def test_against_brute_force(spark, bound):
    rng = random.Random(1)
    base = [prose(rng, 300) for _ in range(8)]
    rows = []
    for d in range(80):
        w = rng.choice(base).split()
        for _ in range(rng.choice([0, 0, 1, 2, 60])):
            w[rng.randrange(len(w))] = "q" + str(rng.randrange(50))
        rows.append((d * 3 + 5, " ".join(w)))
    rng.shuffle(rows)
    got = rows_of(simhash.simhash_components(spark.createDataFrame(rows, "doc_id long, text string"), bound=bound))
    assert got == brute(rows)
    assert len({r[2] for r in got}) < len(rows)


@pytest.mark.parametrize("blocks", [1, 2, 4])
def test_links_cover_every_near_pair(spark, blocks):
    rng = np.random.default_rng(0)
    base = rng.integers(0, 2**63, 200, np.uint64)
    near = [int(x) ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 5), replace=False)) for x in base for _ in range(3)]
    every = sorted({*map(int, base), *near})
    signed = [(x - (1 << 64) if x >> 63 else x,) for x in every]
    links = simhash.fingerprint_links(spark.createDataFrame(signed, "fp long"), blocks=blocks).collect()
    got = closed([(a, b) for a, b in links], [x for (x,) in signed])
    want = closed([(signed[i][0], signed[j][0]) for i in range(len(every)) for j in range(i) if bin(every[i] ^ every[j]).count("1") <= 4], [x for (x,) in signed])
    assert got == want


def test_odd_rows(odd, clashing):
    want = brute([(r.doc_id, r.text) for r in odd.collect()])
    assert rows_of(simhash.simhash_components(odd)) == want
    assert rows_of(simhash.simhash_components(clashing)) == want


def test_dedup_keeps_one_row_a_component(odd, clashing):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    groups = {}
    for d, f, c in brute(rows):
        groups.setdefault(f if c is None else c, set()).add((d, f))
    kept = simhash.simhash_dedup(odd)
    assert kept.columns == odd.columns
    assert kept.count() == len(groups)
    ids = {r.doc_id for r in kept.collect()}
    assert ids == {min((d for d, _ in g if d is not None), default=None) for g in groups.values()}
    assert simhash.simhash_dedup(clashing).columns == clashing.columns


def test_empty(nothing):
    assert simhash.simhash_components(nothing).collect() == []
    assert simhash.simhash_dedup(nothing).collect() == []


def test_components_of_a_long_chain(spark):
    links = [(i, i + 1) for i in range(200)] + [(500, 500), (1000, 1001)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(201)}, 1000: 1000, 1001: 1000}
