"""Decontamination and the randomness battery against plain Python versions of themselves."""

import math
import random
import re
from collections import Counter, defaultdict

import pytest
import regex
from pyspark.sql.functions import col

from docloom.llm.decontamination import JOIN, NAME, NUMBER, NUMBER_WORDS, UNIT, UNITS, benchmark_matches
from docloom.llm.secrets import BINS, COLLISIONS, ENCODINGS, GATE, PROSE_COLLISION, STRATA, mask_secrets, secret_report

from .conftest import prose
from .test_native import base_spans, in_order

SPACE = r"[ \t-\r]"


def pairs(text, named):
    """Template words, each with its filler or None."""
    out = []
    for token in regex.split(SPACE, regex.sub(r"(?<![^ \t-\r\p{P}])(\p{Lu}[\p{L}'’-]*+)[ \t-\r](?=\p{Lu})", "\\1" + JOIN, text or "") if named else text or ""):
        w = regex.sub(rf"(?<![^\p{{P}}])\p{{Lu}}[\p{{L}}{JOIN}'’-]*+(?![^\p{{P}}])", NAME, token) if named else token
        w = regex.sub(rf"[^\p{{L}}\p{{N}}{NUMBER}-{UNIT}]", "", w.lower())
        if w:
            out.append([NUMBER if regex.search("[0-9]", w) or w in NUMBER_WORDS else w, token])
    for (a, _), b in zip(out, out[1:], strict=False):
        if a == NUMBER and b[0] in UNITS:
            b[0] = UNIT
    clean = [(w, regex.sub(r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "", t.split(JOIN)[-1].lower())) for w, t in out]
    return [(w, t if regex.search(f"[{NUMBER}-{UNIT}]", w) else None) for w, t in clean]


def judged(doc, item, size, share, agreement):
    """windows, matched, slots and changed slots of each stretch of a document that holds an item."""
    n = min(size, len(item))
    if not n or not doc:
        return
    total = len(item) - n + 1
    places = defaultdict(list)
    for i in range(len(doc) - n + 1):
        places[tuple(w for w, _ in doc[i : i + n])].append(i)
    at = defaultdict(set)
    for i in range(total):
        for d in places.get(tuple(w for w, _ in item[i : i + n]), ()):
            at[d - i].add(i)
    stretches = []
    for shift in sorted(at):
        if not stretches or shift - stretches[-1][-1] >= total:
            stretches.append([])
        stretches[-1].append(shift)
    for shifts in stretches:
        where = {i: max((len(at[s]), -s) for s in shifts if i in at[s]) for i in set().union(*(at[s] for s in shifts))}
        said = defaultdict(set)
        for i, (_, back) in where.items():
            for p in range(i, i + n):
                (kind, filler), (word, now) = item[p], doc[p - back]
                if filler is not None and now is not None and word == kind:
                    said[kind, filler, now].add(p)
        count = {k: len(v) for k, v in said.items()}
        every = sum(count.values())
        agree = sum(c for (k, f, g), c in count.items() if (c, g) == max((x, b) for (k2, a, b), x in count.items() if (k2, a) == (k, f)) and (c, f) == max((x, a) for (k2, a, b), x in count.items() if (k2, b) == (k, g)))
        changed = sum(c for (_, f, g), c in count.items() if f != g)
        if len(where) >= share * total and agree >= agreement * every and (n >= size or not changed):
            yield total, len(where), every, changed


def contained(doc, item, size=5, share=0.5, agreement=0.8):
    best = max(((m, -c, -r, t, e) for r in (0, 1) for t, m, e, c in judged(pairs(doc, r == 0), pairs(item, r == 0), size, share, agreement)), default=None)
    return best and (best[3], best[0], best[4], -best[1])


def test_decontamination(spark):
    rng = random.Random(13)
    names, units = ["Anna", "Bob", "Maria", "Tom", "Zoë"], ["kg", "km", "dollars", "apples", "Hours"]
    templates = [prose(rng, 18).split() for _ in range(8)]

    def question(t):
        w = list(t)
        a, b = rng.choice(names), rng.choice(names)
        w[2:2], w[8:8], w[14:14] = [a], [str(rng.randrange(90)), rng.choice(units)], [b + rng.choice(["", ",", "'s"])]
        return " ".join(w).capitalize() + "."

    items = [(i, question(rng.choice(templates))) for i in range(12)] + [(50, "just three words"), (51, ""), (52, None)]
    docs = []
    for d in range(150):
        parts = [prose(rng, rng.randrange(40))]
        for _ in range(rng.randrange(3)):
            q = question(rng.choice(templates)).split()
            if rng.random() < 0.4:
                q[rng.randrange(len(q))] = "other"
            parts += [rng.choice([" ", "\n", ", "]).join([" ".join(q), prose(rng, 9)])]
        docs.append((d, rng.choice([" ", "\n\n", " \t"]).join(parts)))
    docs += [(900, None), (901, ""), (902, "Just three, words")]
    got = benchmark_matches(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    want = []
    for d, t in docs:
        for i, q in items:
            found = contained(t, q)
            if found:
                want.append((d, i, *found))
    assert len(want) > 40 and len({w[1] for w in want}) > 8
    assert in_order(tuple(r) for r in got.drop("row").collect()) == in_order(want)


def upper(z):
    return math.erfc(z / math.sqrt(2)) / 2


def p_value(token):
    """The chance under prose, or None if the tests speak against a random key."""
    core = token.rstrip("=")
    name, alphabet = next(((e, a) for e, a in ENCODINGS if all(c in a for c in core)), (None, None))
    if alphabet is None or len(core) < STRATA[0]:
        return None
    n, k, rate = len(core), len(alphabet), COLLISIONS.get(name, PROSE_COLLISION)
    chi = k / n * sum(v * v for v in Counter(core).values()) - n
    codes = [alphabet.index(c) + 1 - (k + 1) / 2 for c in core]
    df = k - 1
    even = ((max(chi, 1e-9) / df) ** (1 / 3) - (1 - 2 / (9 * df))) / math.sqrt(2 / (9 * df))
    high = sum(c > 0 for c in codes)
    mean = 2 * high * (n - high) / n + 1
    turns = 1 + sum((a > 0) != (b > 0) for a, b in zip(codes, codes[1:], strict=False))
    runs = (turns - mean) / math.sqrt(max((mean - 1) * (mean - 2) / (n - 1), 0.25))
    serial = sum(a * b for a, b in zip(codes, codes[1:], strict=False)) / max(sum(c * c for c in codes), 1e-9) * math.sqrt(n)
    half = -sum(math.log(max(p, 1e-300)) for p in (upper(even), 2 * upper(abs(runs)), 2 * upper(abs(serial))))
    z = (chi - df - (n - 1) * (k * rate - 1)) / math.sqrt(2 * df + 4 * (n - 1) * k * rate)
    return max(upper(-z), 1e-300) if math.exp(-half) * (1 + half + half * half / 2) >= GATE else None


def test_error_function(spark):
    from docloom.llm.secrets import _upper

    zs = [i / 4 for i in range(-40, 60)] + [20.0, 30.0]
    for r in spark.createDataFrame([(z,) for z in zs], "z double").select("z", _upper(col("z")).alias("p")).collect():
        assert r.p == pytest.approx(upper(r.z), rel=3e-7)


@pytest.mark.parametrize("seed", [1, 2])
def test_battery(spark, seed):
    rng = random.Random(seed)
    alphabets = ["0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", "abcdefghijklmnopqrstuvwxyz"]
    rows = []
    for d in range(250):
        w = prose(rng, 40).split()
        for _ in range(rng.randrange(4)):
            a = rng.choice(alphabets)
            w.insert(rng.randrange(len(w)), "".join(rng.choice(a) for _ in range(rng.randrange(15, 90))) + rng.choice(["", "", "=", "=="]))
        w.insert(5, "".join(rng.choice(["walk", "ing", "stone", "river"]) for _ in range(rng.randrange(3, 9))))
        rows.append((d, " ".join(w)))
    rate = 0.01
    candidates = []
    for d, t in rows:
        base = [(int(a), int(z)) for _, a, z in (x.split(":") for x in base_spans(t))]
        for m in re.finditer("[A-Za-z0-9+/_-]{20,}={0,2}", t):
            if any(x < m.end() and m.start() < y for x, y in base):
                continue
            candidates.append((d, m.start(), m.end(), sum(m.end() - m.start() >= s for s in STRATA[1:]), p_value(m[0])))
    cuts = {}
    for s in {c[3] for c in candidates}:
        here = [c[4] for c in candidates if c[3] == s]
        steps = [min(math.floor(-10 * math.log10(p)), BINS - 1) for p in here if p is not None]
        cuts[s] = max((10 ** (-b / 10) for b in range(BINS) if (k := sum(x >= b for x in steps)) and 10 ** (-b / 10) * len(here) <= rate * k), default=-1.0)
    order = ["assign", "access", "hex", "random"]
    found = 0
    for r in secret_report(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        base = [(int(a), order.index(k), int(z)) for k, a, z in (x.split(":") for x in base_spans(rows[r.doc_id][1]))]
        own = [(a, 3, z) for d, a, z, s, p in candidates if d == r.doc_id and p is not None and p <= cuts[s]]
        found += len(own)
        assert r.spans == ",".join(f"{order[k]}:{a}:{z}" for a, k, z in sorted(base + own))
        assert r.n_random == len(own)
    assert found > 50


WORDS = "the of and to in is that for it as was with be by on not he this are or his from at which but have an had they you were their one all we can her has there been if more when will would who".split()


def ordinary(rng):
    """Words run together in the ways of prose, programs and paths."""
    out, n, style = "", rng.randrange(20, 60), rng.randrange(4)
    while len(out) < n:
        w = rng.choice(WORDS)
        out += [w, w.capitalize(), w + "_", w + rng.choice("/-")][style] if rng.random() < 0.95 else str(rng.randrange(100))
    return out


def test_false_discoveries(spark):
    """Among 3,000 ordinary runs and 600 keys at most one in a hundred of the runs found is no key, and most keys of 32 characters or more are found."""
    rng = random.Random(5)
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    keys = {d: "".join(rng.choice(alphabet) for _ in range(rng.choice([32, 40, 48, 64]))) for d in range(0, 3600, 6)}
    rows = [(d, f"see {keys.get(d) or ordinary(rng)} there") for d in range(3600)]
    found = {r.doc_id for r in secret_report(spark.createDataFrame(rows, "doc_id long, text string")).collect() if r.n_random}
    false, true = len(found - set(keys)), len(found & set(keys))
    assert false <= 0.01 * len(found)
    assert true >= 0.6 * len(keys)


def test_many_runs_in_one_text(spark):
    """Places of 30,000 matches, of signs beyond one byte between them, and the masked text."""
    rng = random.Random(6)
    parts = [(f"{rng.getrandbits(64):016x}", rng.choice([" ", " é ", "日", "; token=abcdefghijkl "])) for _ in range(30_000)]
    text = "".join(a + b for a, b in parts)
    docs = spark.createDataFrame([(1, text, len(text), 7, 8)], "doc_id long, text string, n_chars long, spans int, given int")
    got = secret_report(docs).first()
    assert got.spans == ",".join(base_spans(text))
    out = mask_secrets(docs).first()
    want = re.sub("(\\[secret\\])+", "[secret]", re.sub("[0-9a-f]{16,}", "[secret]", re.sub("token=[A-Za-z0-9]+", "[secret]", text)))
    assert out.text == want and out.n_chars == len(want) and (out.spans, out.given) == (7, 8)
