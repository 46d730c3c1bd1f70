import random

import corpus_pipeline
from docloom.llm.decontamination import benchmark_matches
from docloom.llm.queries import ORACLES, QUERIES

from .test_brute_force import contained
from .test_native import base_spans, metrics
from .test_near import groups
from .test_tokens import check_packing

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = docs.columns
    kept = {r.doc_id for r in QUERIES["op3_quality_rules"](spark, SF).collect() if r.kept}
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality_rules", "near_dedup", "benchmark_decontamination", "secret_masking", "packing"]
    one = stages["quality_rules"](spark, docs, SF).cache()
    assert one.columns == names and {r.doc_id for r in one.collect()} == kept
    two = stages["near_dedup"](spark, one, SF).cache()
    assert two.columns == names and two.count() < one.count()
    three = stages["benchmark_decontamination"](spark, two, SF).cache()
    assert three.columns == names
    assert benchmark_matches(three, spark.read.parquet(f"{SF}/benchmark.parquet")).count() == 0
    four = stages["secret_masking"](spark, three, SF).cache()
    assert four.columns == names and four.count() == three.count()
    assert four.filter("text RLIKE 'AKIA[A-Z0-9]{14,}'").count() == 0
    assert four.filter("n_chars <> char_length(text)").count() == 0
    five = stages["packing"](spark, four, SF)
    assert {r.doc_id for r in five.collect()} == {r.doc_id for r in four.collect()}


def test_run_and_registration(spark):
    import __spark_entry__ as entry

    assert corpus_pipeline.run(spark, SF).count() > 0
    names = list(entry.queries())
    for n in range(1, 11):
        assert sum(x.startswith(f"op{n}_") for x in names) == 1
    assert "pipeline" in names and set(ORACLES) <= set(entry.oracle_sql())


def masked(text):
    """The text with its fixed secrets masked, those that touch by one mask."""
    at, out = 0, ""
    for _, a, z in (s.split(":") for s in base_spans(text)):
        if int(a) > at or at == 0:
            out += text[at : int(a)] + "[secret]"
        at = max(at, int(z))
    return out + text[at:]


def test_run_against_brute_force(spark, tmp_path):
    """Every stage's decision by the brute-force versions of the operators, one after the other, on documents with all that the stages remove."""
    rng = random.Random(17)
    words = [f"w{a}{b}" for a in "aeiou" for b in "kmnprst"] + ["the", "and", "of", "under", "never"]
    item = "Which of the old paper ships came home under seven bright moons after 12 days at sea with Anna and Boris on board?"
    rows = []
    for d in range(120):
        w = [rng.choice(words) + rng.choice(["", "s", "x", "y", "z"]) for _ in range(rng.choice([20, 60, 90, 140]))]
        if d % 9 == 0:
            w.insert(rng.randrange(len(w)), "password=hunter2hunter2 AKIAABCDEFGHIJKLMN")
        if d % 11 == 0:
            w.insert(5, item.replace("12", "40").replace("Anna", "Carl") if d % 2 else item)
        if d % 13 == 0:
            w += ["#"] * 60
        rows.append((d, " ".join(w)))
        if d % 7 == 0:
            w[rng.randrange(len(w))] = "changed"
            rows.append((1000 + d, " ".join(w)))
    rows += [(5000, None), (5001, ""), (5002, "same line\n" * 80)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([(d, t, "en", "a", None if t is None else len(t)) for d, t in rows], schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    good = [(d, t) for d, t in rows if metrics(t)[-1]]
    group, _, _ = groups(good)
    first = {}
    for (d, _), g in zip(good, group.values(), strict=True):
        first[g] = min(d, first.get(g, d))
    one = [(d, t) for d, t in good if d in first.values()]
    clean = [(d, t) for d, t in one if not contained(t, item)]
    want = [(d, masked(t)) for d, t in clean]
    assert len(rows) > len(good) > len(one) > len(clean) > 20 and want != clean
    docs = spark.createDataFrame(want, "doc_id long, text string")
    check_packing(docs, corpus_pipeline.run(spark, str(tmp_path)).collect())
