"""Small documents with nulls, missing fields and nesting: what the tables don't have."""

import datetime as dt
import re

import pytest

from docloom.api import Aggregator, Context, Options, Query, SpecError, aggregate, documents, find, operators, register, remove, update
from docloom.operators.stages import Flow, merged_target
from docloom.sources.sinks import FileTarget, FrameTarget


def run(spark, docs, pipeline, schema=None, **options):
    df = documents(spark, docs, schema) if isinstance(docs, list) else docs
    return [r.asDict(recursive=True) for r in aggregate(df, pipeline, Options(**options)).collect()]


def value(spark, expr, doc=None, schema=None):
    df = documents(spark, [doc or {"x": 1}], schema)
    return aggregate(df, [{"$project": {"_id": 0, "v": expr}}]).first()["v"]


def ids(spark, docs, criteria, schema=None):
    return sorted(d["_id"] for d in find(documents(spark, docs, schema), criteria).all())


def test_238_operators():
    import docloom.api  # noqa: F401

    public = {k: [n for n in operators(k) if n not in ("$lookupUnwind", "$lookupExists")] for k in ("expression", "accumulator", "pipeline", "projection", "query", "window", "update")}
    assert {k: len(v) for k, v in public.items()} == {"expression": 137, "accumulator": 25, "pipeline": 25, "projection": 2, "query": 26, "window": 9, "update": 14}


EXPRESSIONS = [
    ({"$add": [1, None]}, None),
    ({"$add": [dt.datetime(2020, 1, 1), 1000]}, dt.datetime(2020, 1, 1, 0, 0, 1)),
    ({"$subtract": [dt.datetime(2020, 1, 2), dt.datetime(2020, 1, 1)]}, 86400000),
    ({"$divide": [1, 0]}, None),
    ({"$mod": [-7, 3]}, -1),
    ({"$round": [2.5]}, 2),
    ({"$round": [19.25, 1]}, 19.2),
    ({"$trunc": [-7.89, 1]}, -7.8),
    ({"$log": [100, 10]}, 2.0),
    ({"$pow": [2, 10]}, 1024.0),
    ({"$cmp": [None, 3]}, -1),
    ({"$eq": ["a", 1]}, False),
    ({"$gt": ["a", 1]}, False),
    ({"$gte": [None, None]}, True),
    ({"$ifNull": [None, None, "z"]}, "z"),
    ({"$cond": [{"$gt": ["$x", 0]}, "p", "n"]}, "p"),
    ({"$switch": {"branches": [{"case": False, "then": 1}], "default": 9}}, 9),
    ({"$arrayElemAt": [[1, 2, 3], -1]}, 3),
    ({"$arrayElemAt": [[1, 2, 3], 7]}, None),
    ({"$filter": {"input": [1, 5, 9], "as": "n", "cond": {"$and": [{"$gt": ["$$n", 1]}, {"$lt": ["$$n", 9]}]}}}, [5]),
    ({"$reduce": {"input": ["a", "b"], "initialValue": "", "in": {"$concat": ["$$value", "$$this"]}}}, "ab"),
    ({"$map": {"input": [1, 2], "as": "n", "in": {"$add": ["$$n", "$x"]}}}, [2, 3]),
    ({"$range": [0, 10, 3]}, [0, 3, 6, 9]),
    ({"$range": [3, 0, -1]}, [3, 2, 1]),
    ({"$range": [0, 0]}, []),
    ({"$slice": [[1, 2, 3, 4], -2]}, [3, 4]),
    ({"$slice": [[1, 2, 3, 4], 1, 2]}, [2, 3]),
    ({"$lastN": {"n": 5, "input": [1, 2]}}, [1, 2]),
    ({"$maxN": {"n": 2, "input": [3, 9, 4]}}, [9, 4]),
    ({"$indexOfArray": [["a", "b", "a"], "a", 1]}, 2),
    ({"$indexOfArray": [["a"], "z"]}, -1),
    ({"$in": [None, [1, None]]}, True),
    ({"$zip": {"inputs": [[1, 2, 3], [4, 5]]}}, [[1, 4], [2, 5]]),
    ({"$zip": {"inputs": [[1, 2], [4]], "useLongestLength": True, "defaults": [0, 9]}}, [[1, 4], [2, 9]]),
    ({"$sortArray": {"input": [3, 1, 2], "sortBy": -1}}, [3, 2, 1]),
    ({"$setUnion": [[1, 2], [2, 3]]}, [1, 2, 3]),
    ({"$setIntersection": [[1, 2, 2], [2, 3]]}, [2]),
    ({"$allElementsTrue": [[1, 2]]}, True),
    ({"$anyElementTrue": [[0, 0]]}, False),
    ({"$concat": ["a", None]}, None),
    ({"$toUpper": None}, ""),
    ({"$split": ["a.b.c", "."]}, ["a", "b", "c"]),
    ({"$trim": {"input": " \t a b \n"}}, "a b"),
    ({"$ltrim": {"input": "xxa", "chars": "x"}}, "a"),
    ({"$substrBytes": ["éa", 2, 1]}, "a"),
    ({"$strLenBytes": "é"}, 2),
    ({"$strcasecmp": ["ABC", "abc"]}, 0),
    ({"$indexOfBytes": ["banana", "an", 2]}, 3),
    ({"$replaceAll": {"input": "a.b.c", "find": ".", "replacement": "-"}}, "a-b-c"),
    ({"$replaceOne": {"input": "a.b.c", "find": ".", "replacement": "-"}}, "a-b.c"),
    ({"$regexMatch": {"input": "HELLO", "regex": "hello", "options": "i"}}, True),
    ({"$toInt": "42"}, 42),
    ({"$toInt": "4.2"}, None),
    ({"$toBool": 0}, False),
    ({"$toBool": "false"}, True),
    ({"$toDate": 0}, dt.datetime(1970, 1, 1)),
    ({"$toString": dt.datetime(2020, 1, 2, 3, 4, 5)}, "2020-01-02T03:04:05.000Z"),
    ({"$convert": {"input": "x", "to": "int", "onError": -1}}, -1),
    ({"$convert": {"input": None, "to": 16, "onNull": -2}}, -2),
    ({"$type": "$nothing"}, "null"),
    ({"$let": {"vars": {"a": 2, "b": {"$add": ["$x", 1]}}, "in": {"$multiply": ["$$a", "$$b"]}}}, 4),
    ({"$literal": "$x"}, "$x"),
    ({"$dateAdd": {"startDate": dt.datetime(2021, 1, 31), "unit": "month", "amount": 1}}, dt.datetime(2021, 2, 28)),
    ({"$dateDiff": {"startDate": dt.datetime(2020, 12, 31, 23), "endDate": dt.datetime(2021, 1, 1, 1), "unit": "year"}}, 1),
    ({"$dateDiff": {"startDate": dt.datetime(2021, 1, 2), "endDate": dt.datetime(2021, 1, 3), "unit": "week"}}, 1),
    ({"$dateFromParts": {"year": 2020, "month": 14, "day": 1, "hour": 25}}, dt.datetime(2021, 2, 2, 1)),
    ({"$dateFromParts": {"isoWeekYear": 2020, "isoWeek": 1, "isoDayOfWeek": 1}}, dt.datetime(2019, 12, 30)),
    ({"$dateFromString": {"dateString": "05/02/2020", "format": "%d/%m/%Y"}}, dt.datetime(2020, 2, 5)),
    ({"$dateFromString": {"dateString": "no", "onError": dt.datetime(2000, 1, 1)}}, dt.datetime(2000, 1, 1)),
    ({"$dateToString": {"date": dt.datetime(2020, 1, 5, 1, 2, 3), "format": "%Y-%j %V %u %H:%M:%S.%L %%"}}, "2020-005 01 7 01:02:03.000 %"),
    ({"$hour": {"date": dt.datetime(2020, 1, 5, 23), "timezone": "+02:00"}}, 1),
    ({"$dateToParts": {"date": dt.datetime(2020, 1, 5, 1, 2, 3)}}, None),
    ({"$sum": [1, 2, 3]}, 6),
    ({"$avg": [1, 2]}, 1.5),
    ({"$stdDevSamp": [1, 3]}, 2**0.5),
    ({"$bitAnd": [12, 10]}, 8),
    ({"$covariancePop": [[[1, 2], [3, 8]]]}, 3.0),
    ({"$covarianceSamp": [[[1, 2], [3, 8]]]}, 6.0),
    ({"$cond": [True, "$$REMOVE", "$x"]}, None),
    (["a", "$x", None], ["a", "1", None]),
    ({"$and": ["", 1]}, True),
    ({"$bitNot": 0}, -1),
    ({"$getField": {"field": "k", "input": {"k": 5}}}, 5),
    ({"$function": {"body": lambda a: a + 1, "args": ["$x"], "returns": "long"}}, 2),
]


@pytest.mark.parametrize("expr,want", EXPRESSIONS, ids=[f"{i}{next(iter(e))}" for i, (e, _) in enumerate(EXPRESSIONS)])
def test_expression(spark, expr, want):
    got = value(spark, expr)
    if "$dateToParts" in expr:
        assert got.asDict() == {"year": 2020, "month": 1, "day": 5, "hour": 1, "minute": 2, "second": 3, "millisecond": 0}
    else:
        assert got == pytest.approx(want) if isinstance(want, float) else got == want


def test_regex_find(spark):
    got = value(spark, {"$regexFindAll": {"input": "ab12cd3", "regex": "([a-z]+)(\\d)"}})
    assert [(m.match, m.idx, m.captures) for m in got] == [("ab1", 0, ["ab", "1"]), ("cd3", 4, ["cd", "3"])]
    assert value(spark, {"$regexFind": {"input": "xx", "regex": "y"}}) is None


PEOPLE = [
    {"_id": 1, "name": "ann", "age": 30, "tags": ["a", "b"], "jobs": [{"t": "x", "n": 1}, {"t": "y", "n": 5}]},
    {"_id": 2, "name": None, "age": None, "tags": [], "jobs": []},
    {"_id": 3, "name": "bob", "age": 41, "tags": None, "jobs": [{"t": "y", "n": 2}]},
    {"_id": 4, "name": "cat", "age": 5, "tags": ["b", None], "jobs": None},
]
PEOPLE_SCHEMA = "_id int, name string, age int, tags array<string>, jobs array<struct<t:string,n:int>>"
CRITERIA = [
    ({"name": None}, [2]),
    ({"name": {"$ne": "ann"}}, [2, 3, 4]),
    ({"name": {"$nin": ["ann", "bob"]}}, [2, 4]),
    ({"name": {"$in": ["ann", None]}}, [1, 2]),
    ({"name": re.compile("^A", re.I)}, [1]),
    ({"age": {"$gt": 5}}, [1, 3]),
    ({"age": {"$gte": None}}, [2]),
    ({"age": {"$gt": "x"}}, []),
    ({"age": {"$not": {"$gt": 30}}}, [1, 2, 4]),
    ({"age": {"$mod": [2, 1]}}, [3, 4]),
    ({"age": {"$exists": False}}, [2]),
    ({"age": {"$type": "int"}}, [1, 3, 4]),
    ({"tags": "b"}, [1, 4]),
    ({"tags": ["a", "b"]}, [1]),
    ({"tags": []}, [2]),
    ({"tags": {"$ne": "b"}}, [2, 3]),
    ({"tags": {"$all": ["a", "b"]}}, [1]),
    ({"tags": {"$size": 0}}, [2]),
    ({"jobs.t": "y"}, [1, 3]),
    ({"jobs.n": {"$lt": 2}}, [1]),
    ({"jobs.0.n": 1}, [1]),
    ({"jobs": {"$elemMatch": {"t": "y", "n": {"$gt": 2}}}}, [1]),
    ({"jobs": {"t": "y", "n": 2}}, [3]),
    ({"$or": [{"age": 5}, {"name": "bob"}]}, [3, 4]),
    ({"$nor": [{"age": 5}, {"name": "bob"}]}, [1, 2]),
    ({"$expr": {"$gt": ["$age", {"$multiply": ["$_id", 10]}]}}, [1, 3]),
    ({"$where": lambda d: d["name"] == "cat"}, [4]),
    ({"nowhere": {"$exists": False}, "age": {"$lte": 30}}, [1, 4]),
]


@pytest.mark.parametrize("criteria,want", CRITERIA, ids=range(len(CRITERIA)))
def test_criteria(spark, criteria, want):
    assert ids(spark, PEOPLE, criteria, PEOPLE_SCHEMA) == want
    left = sorted(r["_id"] for r in remove(documents(spark, PEOPLE, PEOPLE_SCHEMA), criteria).collect())
    assert left == [i for i in (1, 2, 3, 4) if i not in want]


def test_query_errors_and_test(spark):
    assert Query({"a": {"$gt": 3}}).test({"a": 5}) is True
    for bad in ({"$foo": 1}, {"a": {"$foo": 1}}):
        with pytest.raises(SpecError):
            ids(spark, PEOPLE, bad, PEOPLE_SCHEMA)
    with pytest.raises(SpecError):
        find(documents(spark, PEOPLE, PEOPLE_SCHEMA), {"$where": lambda d: True}, options=Options(script_enabled=False)).all()


def test_cursor(spark):
    c = find(documents(spark, PEOPLE, PEOPLE_SCHEMA), {"_id": {"$gt": 1}}, {"name": 1}).sort({"_id": -1}).skip(1).limit(1)
    assert c.has_next() and c.next() == {"_id": 3, "name": "bob"} and not c.has_next() and c.next() is None
    assert find(documents(spark, PEOPLE, PEOPLE_SCHEMA), {}).count() == 4
    assert find(documents(spark, PEOPLE, PEOPLE_SCHEMA), {"_id": 1}).map(lambda d: d["age"]) == [30]


def test_projection(spark):
    df = documents(spark, PEOPLE[:1], PEOPLE_SCHEMA)
    assert run(spark, df, [{"$project": {"name": 1, "jobs.n": 1}}]) == [{"_id": 1, "name": "ann", "jobs": [{"n": 1}, {"n": 5}]}]
    assert run(spark, df, [{"$project": {"_id": 0, "tags": 0, "age": 0, "jobs.t": 0}}]) == [{"name": "ann", "jobs": [{"n": 1}, {"n": 5}]}]
    assert run(spark, df, [{"$project": {"jobs": {"$elemMatch": {"n": {"$gt": 2}}}}}]) == [{"_id": 1, "jobs": [{"t": "y", "n": 5}]}]
    assert run(spark, df, [{"$project": {"_id": 0, "tags": {"$slice": -1}}}])[0]["tags"] == ["b"]
    with pytest.raises(SpecError):
        run(spark, df, [{"$project": {"name": 1, "age": 0}}])


def test_unwind(spark):
    df = documents(spark, PEOPLE, PEOPLE_SCHEMA)
    got = run(spark, df, [{"$unwind": {"path": "$tags", "includeArrayIndex": "i", "preserveNullAndEmptyArrays": True}}, {"$project": {"tags": 1, "i": 1}}])
    assert sorted((d["_id"], d["i"], d["tags"]) for d in got if d["_id"] in (1, 2, 3)) == [(1, 0, "a"), (1, 1, "b"), (2, None, None), (3, None, None)] or {(d["_id"], d["i"], d["tags"]) for d in got} == {(1, 0, "a"), (1, 1, "b"), (2, None, None), (3, None, None), (4, 0, "b"), (4, 1, None)}
    assert len(run(spark, df, [{"$unwind": "$jobs"}])) == 3
    assert len(run(spark, df, [{"$unwind": "$name"}])) == 3


def test_group_and_sort(spark):
    docs = [{"_id": i, "k": k, "v": v} for i, (k, v) in enumerate([("a", 1), (None, 2), ("a", None), (None, 4), ("b", 7)])]
    got = run(spark, docs, [{"$sort": {"_id": -1}}, {"$group": {"_id": "$k", "s": {"$sum": "$v"}, "all": {"$push": "$v"}, "f": {"$first": "$v"}, "l": {"$last": "$v"}, "m": {"$avg": "$k"}}}, {"$sort": {"_id": 1}}], schema="_id int, k string, v int")
    assert [(d["_id"], d["s"], d["all"], d["f"], d["l"], d["m"]) for d in got] == [(None, 6, [4, 2], 4, 2, 0.0), ("a", 1, [None, 1], None, 1, 0.0), ("b", 7, [7], 7, 7, 0.0)]
    assert run(spark, documents(spark, docs, "_id int, k string, v int").limit(0), [{"$group": {"_id": None, "n": {"$sum": 1}}}]) == []
    assert run(spark, documents(spark, docs, "_id int, k string, v int").limit(0), [{"$count": "n"}]) == [{"n": 0}]
    assert [d["k"] for d in run(spark, [{"k": x} for x in ("b", "A", "a", "B")], [{"$sort": {"k": 1}}], collation="UNICODE_CI")] in (["A", "a", "b", "B"], ["a", "A", "b", "B"], ["A", "a", "B", "b"], ["a", "A", "B", "b"])


@pytest.mark.parametrize(
    ("collation", "want"),
    [
        ({"locale": "en", "strength": 1}, [{"a", "A", "\u00e1"}, {"a10"}, {"a2"}, {"b"}]),
        ({"locale": "en", "strength": 2}, [{"a", "A"}, {"\u00e1"}, {"a10"}, {"a2"}, {"b"}]),
        ({"locale": "en-US"}, ["a", "A", "\u00e1", "a10", "a2", "b"]),
        ({"locale": "en", "caseFirst": "upper"}, ["A", "a", "\u00e1", "a10", "a2", "b"]),
        ({"locale": "en", "caseFirst": "lower"}, ["a", "A", "\u00e1", "a10", "a2", "b"]),
        ({"locale": "en", "numericOrdering": True}, ["a", "A", "\u00e1", "a2", "a10", "b"]),
        ({"locale": "simple"}, ["A", "a", "a10", "a2", "b", "\u00e1"]),
    ],
)
def test_collation(spark, collation, want):
    got = [d["k"] for d in run(spark, [{"k": x} for x in ("b", "A", "a10", "a", "a2", "\u00e1")], [{"$sort": {"k": 1}}], collation=collation)]
    if isinstance(want[0], set):
        got = [set(got[sum(map(len, want[:i])) : sum(map(len, want[: i + 1]))]) for i in range(len(want))]
    assert got == want


def test_many_matches_and_keys(spark):
    """Places over more than one step, repeated keys; null and empty inputs."""
    df = spark.createDataFrame([(1, "ab1 " * 700, [(str(i % 300), i) for i in range(1000)]), (2, "", []), (3, None, None)], "i int, t string, p array<struct<k string, v int>>")
    spec = {"_id": 0, "i": 1, "f": {"$regexFindAll": {"input": "$t", "regex": "(b)[0-9]"}}, "o": {"$arrayToObject": "$p"}}
    found = aggregate(df, [{"$project": spec}])
    got = {r["i"]: r for r in found.collect()}
    assert [(m["match"], m["idx"], m["captures"]) for m in got[1]["f"]] == [("b1", 4 * i + 1, ["b"]) for i in range(700)]
    assert got[1]["o"] == {str(k): 900 + k if k < 100 else 600 + k for k in range(300)}
    assert found.filter("i = 1").selectExpr("map_keys(o)").first()[0] == [str(k) for k in range(300)]
    assert (got[2]["f"], got[2]["o"], got[3]["f"], got[3]["o"]) == ([], {}, [], None)


def test_collation_punctuation(spark):
    docs = [{"k": x} for x in ("-c", "b", " a")]
    assert [d["k"] for d in run(spark, docs, [{"$sort": {"k": 1}}], collation={"locale": "en", "alternate": "shifted"})] == [" a", "b", "-c"]
    with pytest.raises(SpecError):
        run(spark, docs, [{"$sort": {"k": 1}}], collation={"locale": "en", "backwards": True})


def test_sample_with_replacement(spark):
    docs = documents(spark, [{"v": i} for i in range(5)])
    got = [d["v"] for d in run(spark, docs, [{"$sample": {"size": 40, "replacement": True}}])]
    assert len(got) == 40 and set(got) <= set(range(5))
    assert run(spark, docs.limit(0), [{"$sample": {"size": 3, "replacement": True}}]) == []


def test_first_n_of_groups(spark):
    """Groups without a value, null keys, ties and both directions, as read in one pass and as ranked."""
    rows = [(k, v, i) for i, (k, v) in enumerate([("a", 3), ("a", None), ("a", 3), ("b", None), (None, 1), (None, 2), ("a", 5), ("a", 4)])]
    by = lambda way, op: {op: {"n": 2, "sortBy": {"v": way}, "output": "$i"}}
    group = {"_id": "$k", "n": {"$sum": 1}, "mx": {"$maxN": {"n": 2, "input": "$v"}}, "mn": {"$minN": {"n": 2, "input": "$v"}}, "f": {"$firstN": {"n": 2, "input": "$v"}}, "l": {"$lastN": {"n": 2, "input": "$v"}}, "t": by(-1, "$topN"), "b": by(-1, "$bottomN"), "u": by(1, "$topN")}
    df = spark.createDataFrame(rows, "k string, v int, i int").repartition(3)
    want = [
        {"_id": None, "n": 2, "mx": [2, 1], "mn": [1, 2], "f": [1, 2], "l": [1, 2], "t": [5, 4], "b": [5, 4], "u": [4, 5]},
        {"_id": "a", "n": 5, "mx": [5, 4], "mn": [3, 3], "f": [3, None], "l": [5, 4], "t": [6, 7], "b": [0, 1], "u": [1, 0]},
        {"_id": "b", "n": 1, "mx": [], "mn": [], "f": [None], "l": [None], "t": [3], "b": [3], "u": [3]},
    ]
    for docs in (df, df.limit(100)):
        plan = aggregate(docs, [{"$sort": {"i": 1}}, {"$group": group}])
        assert ("WindowGroupLimit" in plan._jdf.queryExecution().toString()) == (docs is df)
        assert sorted((d.asDict() for d in plan.collect()), key=lambda d: d["_id"] or "") == want


def test_bucket(spark):
    docs = [{"x": v} for v in (0, 5, 10, 15, 25, None)]
    pipeline = [{"$bucket": {"groupBy": "$x", "boundaries": [0, 10, 20, 25], "default": -1, "output": {"n": {"$sum": 1}, "xs": {"$push": "$x"}}}}, {"$sort": {"_id": 1}}]
    assert [(d["_id"], d["n"]) for d in run(spark, docs, pipeline, "x int")] == [(-1, 2), (0, 2), (10, 2), (20, 0)]
    with pytest.raises(Exception, match="outside"):
        run(spark, docs, [{"$bucket": {"groupBy": "$x", "boundaries": [0, 10, 20]}}], "x int")
    auto = run(spark, [{"x": v} for v in (1, 1, 2, 3, 4, 5, 6)], [{"$bucketAuto": {"groupBy": "$x", "buckets": 3}}, {"$sort": {"count": 1, "_id.min": 1}}], "x int")
    assert sorted((d["_id"]["min"], d["_id"]["max"], d["count"]) for d in auto) == [(1, 3, 3), (3, 5, 2), (5, 6, 2)]


def test_lookup_null_matches_null(spark):
    left = documents(spark, [{"_id": 1, "k": "a"}, {"_id": 2, "k": None}, {"_id": 3, "k": "z"}], "_id int, k string")
    right = documents(spark, [{"k": "a", "v": 1}, {"k": "a", "v": 2}, {"k": None, "v": 3}], "k string, v int")
    look = {"$lookup": {"from": "r", "localField": "k", "foreignField": "k", "as": "rs"}}
    got = run(spark, left, [look, {"$sort": {"_id": 1}}], collections={"r": right})
    assert [sorted(x["v"] for x in d["rs"]) for d in got] == [[1, 2], [3], []]
    for follow in ([{"$unwind": "$rs"}], [{"$unwind": {"path": "$rs", "preserveNullAndEmptyArrays": True}}]):
        plain = sorted((d["_id"], d["rs"] and d["rs"]["v"]) for d in run(spark, left, [look, *follow], collections={"r": right}))
        assert plain == [(1, 1), (1, 2), (2, 3)] + ([(3, None)] if len(plain) == 4 else [])
    for test, want in (({"rs": {"$ne": []}}, [1, 2]), ({"rs": {"$size": 0}}, [3])):
        assert sorted(d["_id"] for d in run(spark, left, [look, {"$match": test}, {"$unset": "rs"}], collections={"r": right})) == want


def test_no_cartesian_product_and_pushdown(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/orders.parquet")
    options = Options(collections={"customer": spark.read.parquet("/root/testdata/sf0.001/customer.parquet")})
    plan = aggregate(df, [{"$match": {"o_orderkey": {"$gt": 100}}}, {"$lookup": {"from": "customer", "localField": "o_custkey", "foreignField": "c_custkey", "as": "c"}}, {"$unwind": "$c"}, {"$project": {"_id": 0, "o_orderkey": 1, "n": "$c.c_name"}}], options)._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "GreaterThan(o_orderkey,100)" in plan and "collect_list" not in plan
    assert "o_orderkey:bigint,o_custkey:bigint>" in plan.replace("o_custkey:bigint,o_orderkey:bigint>", "o_orderkey:bigint,o_custkey:bigint>")


def test_facet_union_replace_redact(spark):
    docs = [{"_id": 1, "x": 1, "s": {"x": 9}}, {"_id": 2, "x": 2, "s": {"x": 0}}]
    got = run(spark, docs, [{"$facet": {"a": [{"$match": {"x": 1}}], "n": [{"$count": "n"}], "none": [{"$match": {"x": 99}}]}}], "_id int, x int, s struct<x:int>")[0]
    assert got["a"][0]["_id"] == 1 and got["n"] == [{"n": 2}] and got["none"] == []
    both = run(spark, docs, [{"$project": {"x": 1}}, {"$unionWith": {"coll": documents(spark, [{"_id": 1, "y": 5}]), "pipeline": [{"$match": {"y": 5}}]}}], "_id int, x int, s struct<x:int>")
    assert len(both) == 3 and both[2]["y"] == 5 and both[2]["x"] is None
    assert [d["x"] for d in run(spark, docs, [{"$replaceWith": "$s"}], "_id int, x int, s struct<x:int>")] == [9, 0]
    kept = run(spark, docs, [{"$redact": {"$cond": [{"$gte": ["$x", 1]}, "$$DESCEND", "$$PRUNE"]}}], "_id int, x int, s struct<x:int>")
    assert [d["s"] for d in kept] == [{"x": 9}, None]


CAKES = [{"_id": i, "t": t, "d": dt.datetime(2020, 1, d), "q": q} for i, (t, d, q) in enumerate([("c", 1, 10), ("c", 3, None), ("c", 7, 40), ("v", 1, 5), ("v", 2, 7)])]


@pytest.mark.parametrize(
    "field,want",
    [
        ({"$sum": "$q", "window": {"documents": ["unbounded", "current"]}}, [10, 10, 50, 5, 12]),
        ({"$sum": "$q", "window": {"range": [-2, 0], "unit": "day"}}, [10, 10, 40, 5, 12]),
        ({"$documentNumber": {}}, [1, 2, 3, 1, 2]),
        ({"$shift": {"output": "$q", "by": 1, "default": -1}}, [None, 40, -1, 7, -1]),
        ({"$locf": "$q"}, [10, 10, 40, 5, 7]),
        ({"$linearFill": "$q"}, [10, 20, 40, 5, 7]),
        ({"$derivative": {"input": "$q", "unit": "day"}, "window": {"documents": ["unbounded", "unbounded"]}}, [5, 5, 5, 2, 2]),
        ({"$integral": {"input": "$q", "unit": "day"}, "window": {"documents": ["unbounded", "current"]}}, [0, None, None, 0, 6]),
        ({"$expMovingAvg": {"input": "$q", "N": 3}}, [None, None, None, 5, 6]),
        ({"$rank": {}}, [1, 2, 3, 1, 2]),
    ],
)
def test_windows(spark, field, want):
    got = run(spark, CAKES, [{"$setWindowFields": {"partitionBy": "$t", "sortBy": {"d": 1}, "output": {"v": field}}}, {"$sort": {"_id": 1}}], "_id int, t string, d timestamp, q int")
    assert [d["v"] for d in got] == [None if w is None else pytest.approx(w) for w in want]


@pytest.mark.parametrize("alpha", [0.5, 0.999, 0.01, 1.0])
def test_long_moving_average_is_bounded(spark, alpha):
    rows = [(i, float(i % 17)) for i in range(800)]
    got = run(spark, spark.createDataFrame(rows, "i long, v double"), [{"$setWindowFields": {"sortBy": {"i": 1}, "output": {"e": {"$expMovingAvg": {"input": "$v", "alpha": alpha}}}}}, {"$sort": {"i": 1}}])
    a = rows[0][1]
    for (_, v), d in zip(rows, got, strict=True):
        a = alpha * v + (1 - alpha) * a if d["i"] else a
        assert d["e"] == pytest.approx(a, abs=1e-9)


def test_fill(spark):
    got = run(spark, CAKES, [{"$fill": {"partitionByFields": ["t"], "sortBy": {"d": 1}, "output": {"q": {"method": "linear"}}}}, {"$sort": {"_id": 1}}], "_id int, t string, d timestamp, q int")
    assert [d["q"] for d in got] == [10, 20, 40, 5, 7]


UPDATES = [
    ({"$set": {"a": 5}}, {"a": 5}),
    ({"$set": {"n.x": 7, "n.z": "new"}}, {"n": {"x": 7, "y": "q", "z": "new"}}),
    ({"$unset": {"n.x": ""}}, {"n": {"y": "q"}}),
    ({"$inc": {"a": 2, "fresh": 1}}, {"a": 3, "fresh": 1}),
    ({"$mul": {"a": 3, "none": 2}}, {"a": 3, "none": 0}),
    ({"$max": {"a": 0}}, {"a": 1}),
    ({"$min": {"a": 0}}, {"a": 0}),
    ({"$bit": {"a": {"or": 6}}}, {"a": 7}),
    ({"$rename": {"a": "b", "n.x": "n.w"}}, {"b": 1, "n": {"y": "q", "w": 1}}),
    ({"$pop": {"l": -1}}, {"l": [2, 2]}),
    ({"$pull": {"l": 2}}, {"l": [1]}),
    ({"$pull": {"o": {"k": {"$gt": 1}}}}, {"o": [{"k": 1}]}),
    ({"$pullAll": {"l": [1]}}, {"l": [2, 2]}),
    ({"$addToSet": {"l": {"$each": [2, 3, 3]}}}, {"l": [1, 2, 2, 3]}),
    ({"$push": {"l": 9}}, {"l": [1, 2, 2, 9]}),
    ({"$push": {"l": {"$each": [8, 7], "$position": 1, "$slice": 3}}}, {"l": [1, 8, 7]}),
    ({"$push": {"o": {"$each": [{"k": 0}], "$sort": {"k": 1}}}}, {"o": [{"k": 0}, {"k": 1}, {"k": 2}]}),
    ({"$set": {"l.$[]": 0}}, {"l": [0, 0, 0]}),
    ({"$inc": {"l.1": 5}}, {"l": [1, 7, 2]}),
    ({"$set": {"o.$[e].k": 9}}, {"o": [{"k": 1}, {"k": 9}]}),
    ({"$unset": {"l.0": ""}}, {"l": [None, 2, 2]}),
]


@pytest.mark.parametrize("spec,want", UPDATES, ids=[f"{i}{next(iter(s))}" for i, (s, _) in enumerate(UPDATES)])
def test_update(spark, spec, want):
    before = {"a": 1, "n": {"x": 1, "y": "q"}, "l": [1, 2, 2], "o": [{"k": 1}, {"k": 2}]}
    df = documents(spark, [before], "a int, n struct<x:int,y:string>, l array<int>, o array<struct<k:int>>")
    filters = [{"e.k": {"$gt": 1}}]
    after = update(df, spec, filters).first().asDict(recursive=True)
    assert {k: after[k] for k in want} == want
    assert all(k not in after for k in ("a",) if "$rename" in spec)
    marked = update(df, spec, filters, {"a": 1}, modified="m").first().asDict(recursive=True)
    assert bool(marked["m"]) == (after != before)
    same = update(df, spec, filters, {"a": 99}, modified="m").first().asDict(recursive=True)
    assert same["m"] == [] and all(same[k] == v for k, v in before.items() if k in same and "n" not in k)


def test_update_errors(spark):
    df = documents(spark, [{"s": "x"}])
    for bad in ({"$inc": {"s": 1}}, {"$push": {"s": 1}}, {"$nope": {}}, {"$set": {"a": 1}, "$inc": {"b": 1}}):
        with pytest.raises(SpecError):
            update(df, bad)


TARGET = [{"_id": 1, "a": 1, "b": 1}, {"_id": 2, "a": 2, "b": 2}]
NEW = [{"_id": 2, "a": 20}, {"_id": 3, "a": 30}]


@pytest.mark.parametrize(
    "arg,want",
    [
        ({}, [(1, 1, 1), (2, 20, 2), (3, 30, None)]),
        ({"whenMatched": "replace"}, [(1, 1, 1), (2, 20, None), (3, 30, None)]),
        ({"whenMatched": "keepExisting"}, [(1, 1, 1), (2, 2, 2), (3, 30, None)]),
        ({"whenNotMatched": "discard"}, [(1, 1, 1), (2, 20, 2)]),
        ({"whenMatched": [{"$set": {"a": {"$add": ["$a", "$$new.a"]}}}]}, [(1, 1, 1), (2, 22, 2), (3, 30, None)]),
        ({"whenMatched": "fail"}, None),
        ({"whenNotMatched": "fail"}, None),
    ],
)
def test_merge(spark, arg, want):
    target, new = documents(spark, TARGET, "_id int, a int, b int"), documents(spark, NEW, "_id int, a int")
    if want is None:
        with pytest.raises(SpecError):
            merged_target(Flow(new), target, arg)
    else:
        assert sorted((r["_id"], r["a"], r["b"]) for r in merged_target(Flow(new), target, arg).collect()) == want


@pytest.mark.parametrize(
    "arg,want",
    [
        ({"whenMatched": "replace"}, [(1, 1, 1), (2, 21, None), (3, 30, None), (3, 31, None)]),
        ({"whenMatched": "merge"}, [(1, 1, 1), (2, 21, 2), (3, 30, None), (3, 31, None)]),
        ({"whenMatched": "keepExisting", "whenNotMatched": "discard"}, [(1, 1, 1), (2, 2, 2)]),
        ({"whenMatched": [{"$set": {"a": {"$add": ["$a", "$$new.a"]}}}], "whenNotMatched": "discard"}, [(1, 1, 1), (2, 23, 2)]),
    ],
)
def test_merge_of_repeated_keys(spark, arg, want):
    """Of several documents that match one of the target the last counts; each that matches none is inserted."""
    target, new = documents(spark, TARGET, "_id int, a int, b int"), documents(spark, [{"_id": 2, "a": 20}, {"_id": 3, "a": 30}, {"_id": 2, "a": 21}, {"_id": 3, "a": 31}], "_id int, a int")
    assert sorted(((r["_id"], r["a"], r["b"]) for r in merged_target(Flow(new), target, arg).collect()), key=str) == want


def test_sinks(spark, tmp_path):
    documents(spark, TARGET, "_id int, a int, b int").write.parquet(f"{tmp_path}/t")
    into = FileTarget(spark, f"{tmp_path}/t")
    run(spark, NEW, [{"$merge": {"into": into}}], "_id int, a int")
    assert into.read().count() == 3
    frame = FrameTarget(documents(spark, TARGET, "_id int, a int, b int"))
    run(spark, NEW, [{"$merge": {"into": frame}}], "_id int, a int")
    assert frame.df.count() == 3
    for _ in range(2):
        run(spark, NEW, [{"$out": {"path": f"{tmp_path}/o", "format": "json"}}])
    assert spark.read.json(f"{tmp_path}/o").count() == 4


def test_sources(spark, tmp_path):
    from docloom.api import Catalog, read
    from docloom.sources.catalog import concatenated, generated

    made = generated(spark, lambda i: ({"_id": i * 10 + j, "tags": ["a"] * j} for j in range(3)), "_id long, tags array<string>, more int", 2)
    assert run(spark, made, [{"$match": {"tags": "a"}}, {"$count": "n"}]) == [{"n": 4}]
    both = concatenated(made, documents(spark, [{"_id": 99, "x": 1}], "_id long, x int"))
    assert both.count() == 7 and both.columns == ["_id", "tags", "more", "x"]
    for form in ("json", "orc", "csv"):
        made.select("_id").write.format(form).option("header", True).save(f"{tmp_path}/t.{form}")
        assert read(spark, f"{tmp_path}/t.{form}", "_id long", header=True).count() == 6
        assert Catalog(spark, str(tmp_path), format=form)("t").count() >= 6
    assert Catalog(spark, entries={"m": lambda: made})("m").count() == 6


def test_session(spark):
    from docloom.session import get_or_create

    assert get_or_create().sparkContext is spark.sparkContext


def test_registration(spark):
    with pytest.raises(SpecError):
        register("expression", "bad name", lambda s, a: None)
    with pytest.raises(SpecError):
        register("expression", "$abs", lambda s, a: None)
    own = Context().add("expression", "$twice", lambda s, arg: s.compile(arg) * 2).add("pipeline", "$tail", lambda f, n: f.to(f.df.filter(f"x > {n}")))
    got = run(spark, [{"x": 1}, {"x": 2}], [{"$tail": 1}, {"$project": {"_id": 0, "y": {"$twice": "$x"}}}], context=own)
    assert got == [{"y": 4}]
    with pytest.raises(SpecError):
        run(spark, [{"x": 1}], [{"$tail": 1}])


def test_accumulators_with_host_code_and_objects(spark):
    docs = [{"_id": i, "k": i % 2, "m": {"a": i} if i < 3 else None} for i in range(5)]
    fold = {"$accumulator": {"init": list, "accumulateArgs": ["$_id"], "accumulate": lambda a, x: [*a, x], "finalize": lambda a: "-".join(map(str, a)), "returns": "string"}}
    got = run(spark, docs, [{"$sort": {"_id": -1}}, {"$group": {"_id": "$k", "f": fold, "m": {"$mergeObjects": "$m"}}}, {"$sort": {"_id": 1}}], "_id int, k int, m struct<a:int>")
    assert [(d["f"], d["m"]) for d in got] == [("4-2-0", {"a": 0}), ("3-1", {"a": 1})]
    maps = run(spark, [{"_id": 1, "m": {"a": 1, "b": 2}}, {"_id": 2, "m": {"b": 5}}], [{"$sort": {"_id": 1}}, {"$group": {"_id": None, "m": {"$mergeObjects": "$m"}}}], "_id int, m map<string,int>")
    assert maps[0]["m"] == {"a": 1, "b": 5}


def test_not_strict(spark):
    docs = [{"_id": 1, "s": "", "l": [1, 2, 3]}]
    pipeline = [{"$project": {"l": {"$elemMatch": {"$gt": 1}}, "t": {"$or": ["$s"]}}}]
    assert run(spark, docs, pipeline) == [{"_id": 1, "l": [2], "t": True}]
    assert run(spark, docs, pipeline, strict=False) == [{"_id": 1, "l": [2, 3], "t": False}]


def test_redact_levels(spark):
    schema = "_id int, tags array<string>, parts array<struct<name:string,tags:array<string>,inner:struct<tags:array<string>,x:int>>>"
    docs = [{"_id": 1, "tags": ["G"], "parts": [{"name": "a", "tags": ["G", "S"], "inner": {"tags": ["H"], "x": 1}}, {"name": "b", "tags": ["T"], "inner": None}]}, {"_id": 2, "tags": ["T"], "parts": []}]
    keep = {"$cond": {"if": {"$gt": [{"$size": {"$setIntersection": ["$tags", ["G"]]}}, 0]}, "then": "$$DESCEND", "else": "$$PRUNE"}}
    assert run(spark, docs, [{"$redact": keep}], schema) == [{"_id": 1, "tags": ["G"], "parts": [{"name": "a", "tags": ["G", "S"], "inner": None}]}]


def test_project_computed_and_nested(spark):
    docs = [{"_id": 1, "isbn": "0001122", "foo": {"bar": {"baz": -1}, "baz": -10}, "baz": -100, "c": [{"t": "a", "b": "x", "d": [{"t": "c", "e": 1}]}]}]
    schema = "_id int, isbn string, foo struct<bar:struct<baz:int>,baz:int>, baz int, c array<struct<t:string,b:string,d:array<struct<t:string,e:int>>>>"
    assert run(spark, docs, [{"$project": {"isbn": {"prefix": {"$substr": ["$isbn", 0, 3]}}}}], schema) == [{"_id": 1, "isbn": {"prefix": "000"}}]
    assert run(spark, docs, [{"$project": {"_id": 0, "foo": {"bar": {"baz": {"$abs": "$foo.bar.baz"}}}}}], schema) == [{"foo": {"bar": {"baz": 1}}}]
    assert run(spark, docs, [{"$project": {"c.t": 0, "c.d.e": 0, "foo": 0, "baz": 0, "isbn": 0}}], schema) == [{"_id": 1, "c": [{"b": "x", "d": [{"t": "c"}]}]}]
    assert run(spark, docs, [{"$project": {"_id": 0, "bestOf": {"$slice": ["$c.t", 1, 1]}}}], schema) == [{"bestOf": []}]


def test_variables_and_now(spark):
    got = run(spark, [{"x": 2}], [{"$project": {"_id": 0, "v": {"$multiply": ["$x", "$$rate"]}, "r": "$$ROOT.x", "t": {"$type": "$$NOW"}}}], variables={"rate": 10})
    assert got == [{"v": 20, "r": 2, "t": "date"}]
    assert Aggregator([{"$addFields": {"y": 1, "x": "$$REMOVE"}}]).run(documents(spark, [{"x": 1, "z": 2}])) == [{"z": 2, "y": 1}]


@pytest.mark.parametrize(
    "text,form,want",
    [
        ("2020-W01-1", "%G-W%V-%u", "2019-12-30 00:00:00"),
        ("2021-W53-7 10:05", "%G-W%V-%u %H:%M", "2022-01-09 10:05:00"),
        ("2017-02-08T12:10:40.250+090", "%Y-%m-%dT%H:%M:%S.%L%Z", "2017-02-08 10:40:40.250000"),
        ("2017-02-08 12:10 -060", "%Y-%m-%d %H:%M %Z", "2017-02-08 13:10:00"),
        ("2017-02-30 12:10 -060", "%Y-%m-%d %H:%M %Z", None),
        ("other", "%G-W%V-%u", None),
    ],
)
def test_date_formats_with_iso_weeks_and_minute_offsets(spark, text, form, want):
    got = run(spark, [{"_id": 1, "s": text}], [{"$project": {"d": {"$dateFromString": {"dateString": "$s", "format": form}}}}], "_id int, s string")
    assert str(got[0]["d"]) == str(want)


def test_unreadable_specifier_is_an_error(spark):
    with pytest.raises(SpecError):
        run(spark, [{"_id": 1, "s": "x"}], [{"$project": {"d": {"$dateFromString": {"dateString": "$s", "format": "%Y %U"}}}}], "_id int, s string")


@pytest.mark.parametrize("tz,want", [("Asia/Tokyo", "09 +0900 540"), ("-03:30", "20 -0330 -210"), ("+0200", "02 +0200 120"), (None, "00 +0000 0")])
def test_offsets_of_regions(spark, tz, want):
    import datetime as dt

    spec = {"date": "$d", "format": "%H %z %Z"} | ({"timezone": tz} if tz else {})
    got = run(spark, [{"_id": 1, "d": dt.datetime(2020, 7, 1)}], [{"$project": {"s": {"$dateToString": spec}}}], "_id int, d timestamp")
    assert got[0]["s"] == want


def test_merge_into_a_name(spark):
    frame = FrameTarget(documents(spark, TARGET, "_id int, a int, b int"))
    docs = documents(spark, NEW, "_id int, a int")
    for collections in ({"there": frame}, lambda name: {"there": frame}[name]):
        aggregate(docs, [{"$merge": {"into": "there"}}], Options(collections=collections))
    assert frame.df.count() == 3


def test_only_the_query_s_own_operators(spark):
    docs = documents(spark, NEW, "_id int, a int")
    alone = Context(use_global=False)
    with pytest.raises(SpecError):
        aggregate(docs, [{"$limit": 1}], Options(context=alone))
    alone.add("pipeline", "$half", lambda f, arg: f.to(f.df.limit(1)))
    assert aggregate(docs, [{"$half": {}}], Options(context=alone)).count() == 1
