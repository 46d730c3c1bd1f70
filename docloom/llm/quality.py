"""Quality rules as a short-circuit cascade: rules ordered by rejection per cost, both estimated on a sample."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Mapping, Sequence
from typing import NamedTuple

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, once, words

SYMBOLS = "#*$%&|<>"


class Work(NamedTuple):
    """What a rule's metrics take of a text: steps for each character, word, word times the binary logarithm of their number, and line.

    The step is what one pass over a character takes; the figures are measured once, not by run, so that an order can be repeated.
    """

    chars: float = 0.0
    words: float = 0.0
    sorted_words: float = 0.0
    lines: float = 0.0


class Rule(NamedTuple):
    """fails: from the metrics of a document to the Column that is true where the rule rejects it."""

    name: str
    fails: Callable[[Mapping[str, Column]], Column]
    work: Work


#: What every document must pass; integers only, so that any engine gives the same verdict.
RULES = (
    Rule("few_words", lambda m: m["n_words"] < 50, Work(chars=1, words=0.2)),
    Rule("repeated_words", lambda m: 100 * m["n_repeat_words"] > 50 * m["n_words"], Work(chars=2, words=0.4, sorted_words=2.5)),
    Rule("symbols", lambda m: 10 * m["n_symbols"] > m["n_words"], Work(chars=2, words=0.2)),
    Rule("word_length", lambda m: (m["word_chars"] < 2 * m["n_words"]) | (m["word_chars"] > 20 * m["n_words"]), Work(chars=3, words=0.4)),
    Rule("repeated_lines", lambda m: 10 * m["n_dup_lines"] > 3 * m["n_lines"], Work(chars=1.6, lines=2)),
)
#: Files of a larger input that the sample comes from.
FILES = 16


def _repeat_words(w: Column) -> Column:
    """Words in three-word windows that the text has twice or more: equal windows meet by sorting (hash, position)."""
    n = F.size(w)
    two = F.zip_with(w, F.slice(w, F.lit(2), n), lambda a, b: F.xxhash64(a, b))
    three = F.slice(F.zip_with(two, F.slice(w, F.lit(3), n), lambda h, c: F.xxhash64(h, c)), F.lit(1), F.greatest(n - 2, F.lit(0)))
    placed = F.sort_array(F.transform(three, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def counted(s: Column) -> Column:
        twice = F.filter(F.zip_with(s, F.slice(s, F.lit(2), n), lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"]))), lambda x: x.isNotNull())
        at = F.sort_array(F.array_distinct(F.flatten(twice)))
        return once(at, lambda p: F.aggregate(F.zip_with(p, F.slice(p, F.lit(2), n), lambda a, b: F.least(F.lit(3), F.coalesce(b - a, F.lit(3)))), F.lit(0).cast("long"), lambda x, y: x + y))

    return once(placed, counted)


def metrics(text: Column) -> dict[str, Column]:
    """Each metric as a Column over text (null: empty), usable by itself."""
    t = F.coalesce(text, F.lit(""))
    lines = lambda: F.filter(F.split(t, "\n"), lambda x: F.translate(x, SPACES, "") != "")
    return {
        "n_words": F.size(words(text)).cast("long"),
        "word_chars": F.char_length(F.translate(t, SPACES, "")).cast("long"),
        "n_symbols": (F.char_length(t) - F.char_length(F.translate(t, SYMBOLS, ""))).cast("long"),
        "n_lines": F.size(lines()).cast("long"),
        "n_dup_lines": once(lines(), lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
        "n_repeat_words": once(words(text), _repeat_words),
    }


def _sample(docs: DataFrame, text_col: str, sample: int) -> DataFrame:
    """About `sample` texts: of all files, or where there are many, of FILES that a hash of their names picks, so that no other file is read."""
    files = docs.inputFiles()
    if len(files) > FILES:
        chosen = sorted(files, key=lambda f: zlib.crc32(f.encode()))[:FILES]
        try:
            some = docs.filter(F.col("_metadata.file_path").isin(chosen))
            n = some.count()
        except AnalysisException:  # docs isn't read from files alone
            n = 0
        if n >= sample:
            docs = some
    share = min(1.0, sample / max(docs.count(), 1))  # counted from the files' footers
    return docs.select(F.col(text_col).alias("text")).sample(share, 42)


def rule_order(docs: DataFrame, text_col: str = "text", rules: Sequence[Rule] = RULES, sample: int = 2000) -> list[Rule]:
    """The rules by rejection per cost, best first, from the texts that each rejects and the steps that it takes on a sample.

    The first rule is the one that rejects most of the sample per step, the next the one that rejects most of what is left per step
    on that, and so on. One aggregation over the sample counts texts and adds up steps for each pattern of failed rules. Only the
    order, and so the time, depends on the sample; a document passes if it passes every rule, in whatever order.
    """
    have = metrics(F.col("text"))
    size = {"chars": F.char_length(F.coalesce("text", F.lit(""))).cast("double"), "words": have["n_words"].cast("double"), "lines": have["n_lines"].cast("double")}
    size["sorted_words"] = size["words"] * F.log2(size["words"] + 1)
    pattern = F.array(*[F.coalesce(r.fails(have), F.lit(True)) for r in rules])
    found = _sample(docs, text_col, sample).select(pattern.alias("failed"), *[c.alias(k) for k, c in size.items()])
    rows = found.groupBy("failed").agg(F.count(F.lit(1)).alias("n"), *[F.sum(k).alias(k) for k in size]).collect()  # 2 ** len(rules) at most
    order: list[int] = []
    while len(order) < len(rules):
        left = [r for r in rows if not any(r.failed[i] for i in order)]

        def worth(i: int, left: list = left) -> float:
            steps = sum(w * r[k] for k, w in rules[i].work._asdict().items() for r in left)
            return sum(r.n for r in left if r.failed[i]) / max(steps, 1.0)

        # nothing left to reject in the sample: the cheaper first
        order.append(max((i for i in range(len(rules)) if i not in order), key=lambda i: (worth(i), -sum(rules[i].work))))
    return [rules[i] for i in order]


def quality_filter(docs: DataFrame, text_col: str = "text", rules: Sequence[Rule] = RULES, sample: int = 2000) -> DataFrame:
    """The rows of docs that pass every rule, columns as they are.

    The rules become one conjunction in the order found, which stops at a document's first failure: what costs much runs on the
    documents that cheap, often-failing rules leave. Null and empty texts have no words and fail; repeated rows are judged alike
    and stay; an empty table gives an empty result; columns named like metrics don't clash, as metrics are never columns here.
    """
    have = metrics(docs[text_col])
    for rule in rule_order(docs, text_col, rules, sample):
        docs = docs.filter(~F.coalesce(rule.fails(have), F.lit(True)))
    return docs


def quality_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: Sequence[Rule] = RULES, sample: int = 2000) -> DataFrame:
    """doc_id, every metric, base_failed (few or repeated words) and kept (it passes every rule), for every row.

    The metrics are wanted here, so they are computed once a document and the cascade runs over them. Null and empty texts have
    zero in each metric and fail; null and repeated ids stay as they are.
    """
    order = rule_order(docs, text_col, rules, sample)
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    have = metrics(F.col("text"))
    # explode() of one struct keeps Catalyst from copying the metrics into each rule
    m = base.select("doc_id", F.explode(F.array(F.struct(*[c.alias(k) for k, c in have.items()]))).alias("m")).select("doc_id", "m.*")
    got = {k: F.col(k) for k in have}
    base_failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    passes = F.lit(True)
    for rule in order:
        passes = passes & ~F.coalesce(rule.fails(got), F.lit(True))
    return m.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", base_failed.alias("base_failed"), (~base_failed & passes).alias("kept"))


QUALITY_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ln FROM documents),
t AS (SELECT doc_id, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM t) WHERE n > 1),
p AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM r, (SELECT unnest([0, 1, 2]) AS j) GROUP BY doc_id),
m AS (SELECT d.doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
  (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, (len(ln) - len(list_distinct(ln)))::BIGINT AS n_dup_lines,
  coalesce(p.n, 0)::BIGINT AS n_repeat_words, len(ln)::BIGINT AS n_lines FROM d LEFT JOIN p ON p.doc_id = d.doc_id)
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR 10 * n_symbols > n_words OR word_chars < 2 * n_words OR word_chars > 20 * n_words OR 10 * n_dup_lines > 3 * n_lines) AS kept FROM m
"""
