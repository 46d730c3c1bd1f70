import random
import zlib
from itertools import product

import numpy as np
import pytest

from docloom.llm import language as L

PATH = "piece_bpe_32k.model"
SYLLABLES = {"aa": ["ba", "no", "ri", "tu", "sel"], "bb": ["kor", "ge", "mi", "shan", "o"], "cc": ["zu", "pla", "ne", "vé", "ix"]}


def text(rng, lang, n):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(8)
    return [(i, text(rng, lang, rng.randrange(5, 60)), lang) for i, lang in enumerate(rng.choice(list(SYLLABLES)) for _ in range(400))]


def test_held_out_accuracy(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in L.identify_language(df, per_language=60).collect()}
    held = [(i, lang) for i, _, lang in rows if got[i].held_out]
    assert 40 < len(held) < 130
    assert sum(got[i].lang_pred == lang for i, lang in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 for r in got.values())
    # what a text is called depends on its words alone
    blind = df.selectExpr("doc_id", "text", "CASE WHEN crc32(CAST(doc_id AS STRING)) % 5 <> 0 THEN lang END AS lang", "'x' AS source")
    assert {r.doc_id: r.lang_pred for r in L.identify_language(blind, per_language=60).collect()} == {i: r.lang_pred for i, r in got.items()}


def test_odd_rows(odd, clashing, nothing, spark):
    for docs in (odd, clashing):
        got = L.identify_language(docs).collect()
        assert len(got) == docs.count()
        by = {r.doc_id: r for r in got}
        assert by[2].lang_pred == by[3].lang_pred == by[4].lang_pred == "und" and by[2].score == 0
        assert by[1].lang_pred in ("en", "fr", "de")
    assert L.identify_language(nothing).collect() == []
    unlabelled = spark.createDataFrame([(1, "some text", None), (None, "more", "en")], "doc_id long, text string, lang string")
    assert {r.lang_pred for r in L.identify_language(unlabelled).collect()} == {"und"}


def segmentations(word, known):
    for cuts in product([0, 1], repeat=len(word) - 1):
        edges = [0, *(i + 1 for i, c in enumerate(cuts) if c), len(word)]
        parts = [word[a:z] for a, z in zip(edges, edges[1:], strict=False)]
        if all(x in known for x in parts):
            yield [known[x] for x in parts]


@pytest.fixture(scope="module")
def known():
    return {p: i for i, p in enumerate(L.pieces(PATH).every)}


def test_the_whole_vocabulary_is_used(known):
    import sentencepiece
    from docloom.llm.tokens import vocabulary

    model = sentencepiece.SentencePieceProcessor(model_file=vocabulary(PATH))
    for i in range(model.get_piece_size()):
        p = model.id_to_piece(i).lower().replace("▁", " ")
        if p.removeprefix(" ").isalpha():
            assert p.encode() in known
    found = L.lattice([b" internationale", "страница".encode(), b"x"], PATH)
    assert found[14, 13 - 1, 0] == known.get(b"international", found.max()) or b"international" not in known


def test_forward_sums_all_segmentations(known):
    rng = np.random.default_rng(0)
    n = L.pieces(PATH).n
    p = rng.random((n, 2)) / n
    words = [b" the", " été".encode(), b" walking", b"x", b" ab", b" international", " страна".encode()]
    want = [np.log(sum(np.prod([p[i] for i in s], axis=0) for s in segmentations(w, known))) for w in words]
    assert np.allclose(L.word_scores(words, p, PATH), want)


def test_fit_against_all_segmentations(known):
    """Expectation maximisation as its definition says, over every segmentation of every word."""
    counts = {b" the": 7, b" them": 2, "é".encode(): 3, b" walking": 1, b" internatio": 2}
    n = L.pieces(PATH).n
    p = np.full(n, 1 / n)
    for _ in range(3):
        expected = np.zeros(n)
        for w, k in counts.items():
            every = list(segmentations(w, known))
            chance = np.array([np.prod(p[s]) for s in every])
            for s, c in zip(every, chance / chance.sum(), strict=True):
                np.add.at(expected, s, k * c)
        p = (expected + 0.05) / (expected.sum() + 0.05 * n)
    assert np.allclose(L.fit(counts, PATH), p)


def test_long_words_score_alike(monkeypatch):
    n = L.pieces(PATH).n
    rng = np.random.default_rng(1)
    p = rng.random((n, 2)) / n
    words = [b" " + b"walking" * k for k in (4, 5, 40, 3000)]
    scores = L.word_scores(words, p, PATH)
    assert np.isfinite(scores).all() and (np.diff(scores[:, 0]) < 0).all()
    monkeypatch.setattr(L, "CELLS", 64)  # many parts, and words one by one
    assert np.allclose(L.word_scores(words, p, PATH), scores)
    some = {w: 2 for w in words[:3]}
    few = L.fit(some, PATH)
    monkeypatch.undo()
    assert np.allclose(L.fit(some, PATH), few)


def test_scripts_without_blanks(spark):
    """Two languages of one script whose words run together, alphabets half in common: held-out documents are told apart."""
    rng = random.Random(4)
    letters = [chr(0x0E01 + i) for i in range(40)]
    alphabets = {"xa": letters[:26], "xb": letters[13:39]}
    lexicon = {k: ["".join(rng.choice(a) for _ in range(rng.randrange(2, 6))) for _ in range(150)] for k, a in alphabets.items()}
    rows = []
    for i in range(300):
        lang = rng.choice(list(lexicon))
        rows.append((i, " ".join("".join(rng.choice(lexicon[lang]) for _ in range(rng.randrange(8, 30))) for _ in range(rng.randrange(1, 4))), lang))
    got = {r.doc_id: r for r in L.identify_language(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    held = [(i, lang) for i, _, lang in rows if got[i].held_out]
    assert len(held) > 30 and sum(got[i].lang_pred == lang for i, lang in held) >= 0.9 * len(held)


def test_letters(spark):
    rows = [(i, f"some plain words {i}", "en") for i in range(20)] + [(100, "²", None), (101, "²³ ¼ ⅷ 12 _", None), (102, "\u0301\u0e34", None), (103, "٣٤", None), (104, "a", None), (105, "ิกิ", None)]
    got = {r.doc_id: r.lang_pred for r in L.identify_language(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert [got[i] for i in range(100, 106)] == ["und", "und", "und", "und", "en", "en"]
    assert L._words("กิน İs") == ["กิน", "i̇s"]


def test_bounds_of_the_sample(spark):
    rows = [(i, "word " * 50, f"l{i % 3}") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    langs, p = L.learn(docs, "doc_id", "text", "lang", PATH, 5, 300, 3)
    assert langs == ["l0", "l1", "l2"] and np.allclose(p.sum(axis=0), 1, atol=1e-3)
    with pytest.raises(ValueError, match="more than 2"):
        L.learn(docs, "doc_id", "text", "lang", PATH, 5, 300, 2)


def test_prediction_against_all_segmentations(spark, known):
    """A whole query against counts, fit and scores that enumerate segmentations."""
    rng = random.Random(3)
    words = {"aa": ["the", "then", "in"], "bb": ["die", "der", "in"]}
    rows = [(i, " ".join(rng.choice(words[lang]) for _ in range(4)), lang) for i, lang in enumerate(rng.choice(list(words)) for _ in range(40))]
    n, p = L.pieces(PATH).n, {}
    for lang in words:
        counts: dict = {}
        for i, t, k in rows:
            if k == lang and zlib.crc32(str(i).encode()) % 5:
                for w in t.split():
                    counts[b" " + w.encode()] = counts.get(b" " + w.encode(), 0) + 1
        p[lang] = L.fit(counts, PATH)
    for r in L.identify_language(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect():
        total = [sum(np.log(sum(np.prod(p[lang][s]) for s in segmentations(b" " + w.encode(), known))) for w in rows[r.doc_id][1].split()) for lang in ("aa", "bb")]
        assert r.lang_pred == ("aa", "bb")[int(np.argmax(total))]
        assert r.score == pytest.approx(1 / np.exp(np.array(total) - max(total)).sum(), rel=1e-3)
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
