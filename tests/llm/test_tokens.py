import random
import zlib
from collections import Counter
from functools import cache

import numpy as np
import pytest
from tokenizers import Tokenizer

from docloom.llm.common import shared_path
from docloom.llm.packing import best_fit_packing, pack
from docloom.llm.token_counts import token_counts
from docloom.llm.token_files import read_token_files, token_index, write_token_files
from docloom.llm.tokens import ByteLevelEncoder, PieceCounter, vocabulary

from .conftest import rows_of

ODD = list("ab'sTé 12²\t\n\r\x0b\x85\xa0\x1b\x1c_-.,!?€“Éßğˁ日́Σİ﻿") + ["<|endoftext|>", "'re", " 's", "  ", "<|startoftext|>"]


@pytest.fixture(scope="module")
def strings():
    rng = random.Random(2)
    return ["".join(rng.choice(ODD) for _ in range(rng.randrange(50))) for _ in range(4000)]


def test_encoder_gives_the_library_s_ids(strings, monkeypatch):
    monkeypatch.setattr("docloom.llm.tokens.CACHE", 500)
    e = ByteLevelEncoder("byte_bpe_50k.json")
    want = [x.ids for x in e.tok.encode_batch(strings, add_special_tokens=False)]
    assert [np.frombuffer(x, "<u4").tolist() for x in e.encode(strings)] == want
    assert sum(e.plain(s) is not None for s in strings) > 100
    rng = random.Random(4)
    words = ["the", "it's", "'re", "end.\nNext", "a\n\nb", "x\n", "\ny", "", "12", "--", "é", "\t", "B\x85", "\xa0c", "!!!'s"]
    texts = [" ".join(rng.choice(words[:5] + words[8:11] if k % 2 else words) for _ in range(rng.randrange(12))) for k in range(3000)]
    assert [np.frombuffer(x, "<u4").tolist() for x in e.encode(texts)] == [x.ids for x in e.tok.encode_batch(texts, add_special_tokens=False)]


def test_counter_gives_the_library_s_counts(strings):
    c = PieceCounter("word_bpe_49k.json")
    words = sorted({w for s in strings for w in s.encode().split()})
    pieces = dict(zip(words, c.count(words), strict=True))
    assert [sum(n * pieces[w] for w, n in Counter(s.encode().split()).items()) for s in strings] == [len(x.ids) for x in c.tok.encode_batch(strings, add_special_tokens=False)]


@pytest.mark.parametrize(("head", "flush"), [(0, 200_000), (40, 10), (200_000, 200_000)])
def test_every_part_of_the_join(spark, strings, head, flush, monkeypatch):
    """No word, some words and all words in the table that tasks hold, and distinct words passed on early."""
    monkeypatch.setattr("docloom.llm.token_counts.FLUSH", flush)
    tok = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    rng = random.Random(9)
    texts = strings[:300] + [" ".join(rng.choice(strings[:20]) for _ in range(rng.randrange(90))) for _ in range(100)] + ["x" * 9000 + " " + "y" * 9000] * 3
    rows = [(d // 2, t) for d, t in enumerate(texts)]
    got = token_counts(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), head=head, limit=50)
    want = sorted((d, len(t.encode()), n := len(tok.encode(t, add_special_tokens=False).ids), n > 50) for d, t in rows)
    assert sorted(tuple(r) for r in got.collect()) == want


def test_token_counts(odd, clashing, nothing):
    tok = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    want = []
    for r in odd.collect():
        t = r.text or ""
        n = len(tok.encode(t, add_special_tokens=False).ids)
        want.append((r.doc_id, len(t.encode()), n, n > 2048))
    want.sort(key=lambda r: tuple((x is not None, str(x)) for x in r))
    assert rows_of(token_counts(odd)) == want
    assert rows_of(token_counts(clashing)) == want
    assert token_counts(nothing).collect() == []


@cache
def tokenizer(name):
    return Tokenizer.from_file(vocabulary(name))


def ids_of(text):
    tok = tokenizer("byte_bpe_50k.json")
    return [*tok.encode(text or "", add_special_tokens=False).ids, 2]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_token_files(spark, odd, clashing, nothing):
    for docs in (odd, clashing):
        path = shared_path(spark, "test")
        write_token_files(docs, path)
        got = token_index(spark, path).collect()
        assert sum(r.n_tokens for r in got) == sum(len(ids_of(r.text)) for r in docs.collect())
        at = 0
        order = sorted(got, key=lambda r: r.start)
        assert [r.doc_id for r in order] == sorted((r.doc_id for r in got), key=lambda d: (d is not None, d or 0))
        for r in order:
            assert r.start == at
            at += r.n_tokens
        want = sorted((str(r.doc_id), len(ids_of(r.text)), crc(ids_of(r.text))) for r in docs.collect())
        assert sorted((str(r.doc_id), r.n_tokens, r.ids_crc32) for r in got) == want
        one = read_token_files(spark, path).filter("doc_id = 5").collect()
        assert [r.ids for r in one] == [ids_of(next(r.text for r in docs.collect() if r.doc_id == 5))]
        assert "PushedFilters: [IsNotNull(doc_id), EqualTo(doc_id,5)]" in read_token_files(spark, path).filter("doc_id = 5")._jdf.queryExecution().toString()
    path = shared_path(spark, "test")
    write_token_files(nothing, path)
    assert token_index(spark, path).collect() == []


def test_null_and_frequent_ids_are_spread(spark):
    """Two thirds of all rows with one id or none: several ranges hold them, and the order of ids over files and places stays right."""
    rng = random.Random(4)
    rows = [(None, f"none {i}") for i in range(300)] + [(7, f"seven {i}") for i in range(300)] + [(d, f"text {d}") for d in range(300)]
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    try:
        path = shared_path(spark, "test")
        write_token_files(docs, path)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    got = read_token_files(spark, path).select("doc_id", "part").collect()
    parts = {d: {r.part for r in got if r.doc_id == d} for d in (None, 7)}
    assert len(parts[None]) > 1 and len(parts[7]) > 1
    order = token_index(spark, path).orderBy("start").collect()
    assert [r.doc_id for r in order] == [None] * 300 + sorted(d for d, _ in rows if d is not None)
    assert [r.start for r in order] == np.cumsum([0, *(r.n_tokens for r in order)])[:-1].tolist()
    texts = Counter((d, crc(ids_of(t))) for d, t in rows)
    assert Counter((r.doc_id, r.ids_crc32) for r in order) == texts


def test_orc_files_hold_what_their_options_say(spark):
    """From the files' own footers: several stripes, integers in the second run-length encoding, row indexes and Bloom filters on ids; and a filter on an id reads few rows."""
    docs = spark.range(60_000).selectExpr("id * 3 AS doc_id", "concat(repeat(concat('word ', id % 97, ' '), 40), id) AS text")
    path = shared_path(spark, "test")
    write_token_files(docs, path, stripe_bytes=1 << 18)
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    files = [f.getPath() for f in jvm.org.apache.hadoop.fs.Path(path).getFileSystem(conf).listStatus(jvm.org.apache.hadoop.fs.Path(path)) if f.getPath().getName().startswith("part-")]
    stripes, kinds, encodings = 0, set(), set()
    for f in files:
        reader = jvm.org.apache.orc.OrcFile.createReader(f, jvm.org.apache.orc.OrcFile.readerOptions(conf))
        assert reader.getRowIndexStride() == 1000 and str(reader.getCompressionKind()) == "NONE"
        names = list(reader.getSchema().getFieldNames())
        assert names == ["doc_id", "part", "part_start", "n_tokens", "ids"]
        stripes += reader.getStripes().size()
        rows = reader.rows()
        for stripe in reader.getStripes():
            footer = rows.readStripeFooter(stripe)
            kinds |= {(str(x.getKind()), x.getColumn()) for x in footer.getStreamsList()}
            encodings |= {(i, str(x.getKind())) for i, x in enumerate(footer.getColumnsList())}
        rows.close()
    assert len(files) > 1 and stripes > len(files)
    ids = 6  # the elements of the list in column 5
    assert {("ROW_INDEX", 1), ("BLOOM_FILTER_UTF8", 1), ("ROW_INDEX", ids)} <= kinds and ("BLOOM_FILTER_UTF8", ids) not in kinds
    assert {(1, "DIRECT_V2"), (5, "DIRECT_V2"), (ids, "DIRECT_V2")} <= encodings
    for wanted, most in ((3 * 41_234, 4096), (3 * 41_234 + 1, 0)):  # an id that is there, and one between two that are
        got = read_token_files(spark, path).filter(f"doc_id = {wanted}")
        assert got.count() == (most > 0)
        plan = got.select("doc_id")
        plan.collect()
        nodes, read = [plan._jdf.queryExecution().executedPlan()], 0
        while nodes:
            node = nodes.pop()
            nodes += [node.children().apply(i) for i in range(node.children().size())]
            if "Scan" in node.nodeName():
                read += node.metrics().apply("numOutputRows").value()
        assert read <= most


def check_packing(docs, got, capacity=1024):
    pieces = {}
    for r in got:
        pieces.setdefault(r.doc_id, []).append(r)
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in bins.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= capacity
    texts = {}
    for r in docs.collect():
        texts.setdefault(r.doc_id, []).append(ids_of(r.text))
    for d, lists in texts.items():
        want = []
        for ids in lists:
            first = len(ids) % capacity or capacity
            for k, a in enumerate([0, *range(first, len(ids), capacity)]):
                z = first if k == 0 else a + capacity
                want.append((k, a, z - a, crc(ids[a:z])))
        assert sorted((r.piece, r.start, r.length, r.ids_crc32) for r in pieces.pop(d)) == sorted(want)
    assert not pieces
    return len(bins)


def test_packing(odd, clashing, nothing):
    for docs in (odd, clashing):
        for per_task in (200_000, 4):
            check_packing(docs, best_fit_packing(docs, per_task=per_task).collect())
    assert best_fit_packing(nothing).collect() == []


def test_packing_is_near_the_least(spark):
    rng = np.random.default_rng(1)
    lengths = np.sort(rng.integers(1, 1025, 5000))[::-1]
    where, offset = pack(lengths, 1024)
    used = where.max() + 1
    assert used <= 1.005 * -(-lengths.sum() // 1024)
    for b in range(used):
        at = np.flatnonzero(where == b)
        at = at[np.argsort(offset[at])]
        assert (offset[at] == np.cumsum(lengths[at]) - lengths[at]).all()
        assert lengths[at].sum() <= 1024


def test_sum_of_squares_rule():
    """Each placement has the least sum of squares among all that are possible."""
    rng = np.random.default_rng(4)
    lengths = rng.integers(1, 20, 300)
    where, _ = pack(lengths, 20)
    gap: dict[int, int] = {}

    def squares(g):
        counts = Counter(x for x in g.values() if 0 < x < 20)
        return sum(n * n for n in counts.values())

    for s, b in zip(lengths, where, strict=True):
        options = [squares({**gap, k: g - s}) for k, g in gap.items() if g >= s] or [squares({**gap, -1: 20 - s})]
        gap[int(b)] = gap.get(int(b), 20) - int(s)
        assert gap[int(b)] >= 0
        assert squares(gap) == min(options)
