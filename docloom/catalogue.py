"""Queries over the test tables, one or more per operator family, each with the DuckDB SQL it is held against."""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .api import Catalog, Options, aggregate, find, remove, update
from .sources.sinks import FrameTarget

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _options(spark: SparkSession, sf_dir: str) -> Options:
    return Options(id_key="_id", collections=Catalog(spark, sf_dir))


def query(name: str, table: str, pipeline: list[dict], sql: str | None) -> None:
    """Register a pipeline over a table."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        o = _options(spark, sf_dir)
        return aggregate(o.collections(table), pipeline, o)

    QUERIES[name] = run
    if sql:
        ORACLES[name] = sql


def custom(name: str, sql: str | None):
    """Register a function of (DataFrames by name, options)."""

    def add(f):
        QUERIES[name] = lambda spark, sf_dir: f((o := _options(spark, sf_dir)).collections, o)
        if sql:
            ORACLES[name] = sql
        return f

    return add


def fields(**spec):
    return {"$project": {"_id": 0} | spec}


# groups and sorts

query(
    "q_pricing",
    "lineitem",
    [
        {"$match": {"l_shipdate": {"$lte": dt.datetime(1998, 9, 2)}}},
        {"$addFields": {"disc": {"$multiply": ["$l_extendedprice", {"$subtract": [1, "$l_discount"]}]}}},
        {"$group": {"_id": {"flag": "$l_returnflag", "status": "$l_linestatus"}, "sum_qty": {"$sum": "$l_quantity"}, "sum_disc": {"$sum": "$disc"}, "avg_price": {"$avg": "$l_extendedprice"}, "n": {"$count": {}}}},
        fields(flag="$_id.flag", status="$_id.status", sum_qty={"$round": ["$sum_qty", 2]}, sum_disc={"$round": ["$sum_disc", 2]}, avg_price={"$round": ["$avg_price", 2]}, n=1),
        {"$sort": {"flag": 1, "status": 1}},
    ],
    "SELECT l_returnflag AS flag, l_linestatus AS status, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc, round(avg(l_extendedprice), 2) AS avg_price, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL",
)
query("q_sort_limit_skip", "orders", [{"$sort": {"o_totalprice": -1, "o_orderkey": 1}}, {"$skip": 5}, {"$limit": 20}, fields(o_orderkey=1, o_totalprice=1)], "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 5")
query("q_count", "orders", [{"$match": {"o_orderstatus": "F"}}, {"$count": "n"}], "SELECT count(*) AS n FROM orders WHERE o_orderstatus = 'F'")
query("q_sort_by_count", "events", [{"$sortByCount": "$event_type"}], "SELECT event_type AS _id, count(*) AS count FROM events GROUP BY 1")
query("q_group_null_key", "orders", [{"$group": {"_id": None, "n": {"$sum": 1}, "top": {"$max": "$o_totalprice"}}}, fields(n=1, top=1)], "SELECT count(*) AS n, max(o_totalprice) AS top FROM orders")

# criteria

_MATCH = {
    "eq": ("orders", {"o_orderstatus": "O"}, "o_orderstatus = 'O'"),
    "ne": ("orders", {"o_orderstatus": {"$ne": "O"}}, "o_orderstatus <> 'O'"),
    "in": ("orders", {"o_orderpriority": {"$in": ["1-URGENT", "2-HIGH"]}}, "o_orderpriority IN ('1-URGENT', '2-HIGH')"),
    "nin": ("orders", {"o_orderpriority": {"$nin": ["1-URGENT", "2-HIGH"]}}, "o_orderpriority NOT IN ('1-URGENT', '2-HIGH')"),
    "gt_lt": ("orders", {"o_totalprice": {"$gt": 1000, "$lt": 200000.5}}, "o_totalprice > 1000 AND o_totalprice < 200000.5"),
    "gte_lte": ("orders", {"o_orderkey": {"$gte": 100, "$lte": 5000}}, "o_orderkey >= 100 AND o_orderkey <= 5000"),
    "mod": ("orders", {"o_orderkey": {"$mod": [7, 3]}}, "o_orderkey % 7 = 3"),
    "regex": ("customer", {"c_name": re.compile("#0*1.*5$")}, "regexp_matches(c_name, '#0*1.*5$')"),
    "regex_options": ("customer", {"c_mktsegment": {"$regex": "^bu", "$options": "i"}}, "regexp_matches(c_mktsegment, '^bu', 'i')"),
    "exists": ("orders", {"o_orderdate": {"$exists": True}, "nothing": {"$exists": False}}, "o_orderdate IS NOT NULL"),
    "type": ("orders", {"o_totalprice": {"$type": "double"}, "o_orderstatus": {"$type": "string"}}, "true"),
    "and_or": ("orders", {"$and": [{"o_orderstatus": "F"}, {"$or": [{"o_totalprice": {"$gt": 100000}}, {"o_orderpriority": "5-LOW"}]}]}, "o_orderstatus = 'F' AND (o_totalprice > 100000 OR o_orderpriority = '5-LOW')"),
    "nor_not": ("orders", {"$nor": [{"o_orderstatus": "F"}, {"o_totalprice": {"$not": {"$gt": 50000}}}]}, "NOT (o_orderstatus = 'F' OR NOT o_totalprice > 50000)"),
    "expr": ("lineitem", {"$expr": {"$gt": [{"$multiply": ["$l_quantity", 1000]}, "$l_extendedprice"]}}, "l_quantity * 1000 > l_extendedprice"),
    "bits_set": ("orders", {"o_orderkey": {"$bitsAllSet": 5}}, "(o_orderkey & 5) = 5"),
    "bits_clear": ("orders", {"o_orderkey": {"$bitsAllClear": [0, 3]}}, "(o_orderkey & 9) = 0"),
    "bits_any_set": ("orders", {"o_orderkey": {"$bitsAnySet": 6}}, "(o_orderkey & 6) <> 0"),
    "bits_any_clear": ("orders", {"o_orderkey": {"$bitsAnyClear": 6}}, "(o_orderkey & 6) <> 6"),
    "array_eq": ("embeddings", {"label": 1, "embedding": {"$size": 64}}, "label = 1 AND len(embedding) = 64"),
    "array_gt": ("embeddings", {"embedding": {"$gt": 0.3}}, "len(list_filter(embedding, lambda x: x > 0.3)) > 0"),
    "elem_match": ("embeddings", {"embedding": {"$elemMatch": {"$gt": 0.1, "$lt": 0.11}}}, "len(list_filter(embedding, lambda x: x > 0.1 AND x < 0.11)) > 0"),
}
_KEY = {"orders": "o_orderkey", "customer": "c_custkey", "lineitem": "l_orderkey", "embeddings": "vec_id"}
for _name, (_table, _criteria, _where) in _MATCH.items():
    query(f"q_match_{_name}", _table, [{"$match": _criteria}, fields(**{_KEY[_table]: 1})], f"SELECT {_KEY[_table]} FROM {_table} WHERE {_where}")
query("q_match_all", "events", [{"$group": {"_id": "$user_id", "kinds": {"$addToSet": "$event_type"}}}, {"$match": {"kinds": {"$all": ["click", "view"]}}}, fields(user_id="$_id")], "SELECT user_id FROM events GROUP BY 1 HAVING bool_or(event_type = 'click') AND bool_or(event_type = 'view')")
query("q_match_where", "orders", [{"$match": {"$where": lambda d: d["o_orderkey"] % 10 == 0 and d["o_orderstatus"] == "F"}}, fields(o_orderkey=1)], "SELECT o_orderkey FROM orders WHERE o_orderkey % 10 = 0 AND o_orderstatus = 'F'")


@custom("q_find", "SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal > 5000 ORDER BY c_acctbal DESC, c_custkey LIMIT 30")
def _find(c, o):
    return find(c("customer"), {"c_acctbal": {"$gt": 5000}}, {"c_custkey": 1, "c_acctbal": 1}, o).sort({"c_acctbal": -1, "c_custkey": 1}).limit(30).frame()


@custom("q_remove", "SELECT c_custkey FROM customer WHERE NOT (c_mktsegment = 'BUILDING' OR c_acctbal < 0)")
def _remove(c, o):
    return remove(c("customer"), {"$or": [{"c_mktsegment": "BUILDING"}, {"c_acctbal": {"$lt": 0}}]}, o).select("c_custkey")


@custom("q_json_schema", "SELECT o_orderkey FROM orders WHERE o_totalprice > 250000")
def _json_schema(c, o):
    o.validator = lambda schema: lambda d: d["o_totalprice"] > schema["properties"]["o_totalprice"]["minimum"]
    return aggregate(c("orders"), [{"$match": {"$jsonSchema": {"properties": {"o_totalprice": {"minimum": 250000}}}}}, fields(o_orderkey=1)], o)


# documents

query(
    "q_project",
    "orders",
    [{"$project": {"_id": "$o_orderkey", "o_orderstatus": 1, "year": {"$year": "$o_orderdate"}, "big": {"$gt": ["$o_totalprice", 150000]}}}],
    "SELECT o_orderkey AS _id, o_orderstatus, year(o_orderdate)::INT AS year, o_totalprice > 150000 AS big FROM orders",
)
query("q_project_exclude", "customer", [{"$project": {"c_name": 0, "c_acctbal": 0}}], "SELECT c_custkey, c_nationkey, c_mktsegment FROM customer")
query("q_set", "part", [{"$set": {"p_size": {"$add": ["$p_size", 1]}, "old": "$p_size"}}, fields(p_partkey=1, p_size=1, old=1)], "SELECT p_partkey, p_size + 1 AS p_size, p_size AS old FROM part")
query("q_add_fields", "part", [{"$addFields": {"label": {"$concat": ["$p_brand", "/", "$p_type"]}}}, {"$unset": ["p_name", "p_brand", "p_type", "p_size", "p_retailprice"]}], "SELECT p_partkey, p_brand || '/' || p_type AS label FROM part")
query("q_replace_root", "customer", [{"$replaceRoot": {"newRoot": {"id": "$c_custkey", "where": {"nation": "$c_nationkey"}}}}, {"$replaceWith": {"id": "$id", "nation": "$where.nation"}}], "SELECT c_custkey AS id, c_nationkey AS nation FROM customer")
query("q_unwind", "embeddings", [{"$unwind": {"path": "$embedding", "includeArrayIndex": "idx"}}, fields(vec_id=1, idx=1, embedding=1)], "SELECT vec_id, embedding, (i - 1)::BIGINT AS idx FROM (SELECT vec_id, unnest(embedding) AS embedding, generate_subscripts(embedding, 1) AS i FROM embeddings)")
query("q_project_slice", "embeddings", [{"$project": {"vec_id": 1, "embedding": {"$slice": [2, 3]}}}, {"$unwind": "$embedding"}], "SELECT vec_id, unnest(embedding[3:5]) AS embedding FROM embeddings")
query("q_project_elem_match", "embeddings", [{"$project": {"vec_id": 1, "embedding": {"$elemMatch": {"$gt": 0.2}}}}, {"$unwind": "$embedding"}], "SELECT vec_id, list_filter(embedding, lambda x: x > 0.2)[1] AS embedding FROM embeddings WHERE len(list_filter(embedding, lambda x: x > 0.2)) > 0")
query("q_redact", "orders", [{"$redact": {"$cond": [{"$lt": ["$o_totalprice", 100000]}, "$$KEEP", "$$PRUNE"]}}, fields(o_orderkey=1)], "SELECT o_orderkey FROM orders WHERE o_totalprice < 100000")
query("q_sample", "customer", [{"$sample": {"size": 50}}, {"$count": "n"}], "SELECT least(count(*), 50) AS n FROM customer")

# several collections

_LOOKUP = {"$lookup": {"from": "orders", "localField": "c_custkey", "foreignField": "o_custkey", "as": "orders"}}
query("q_lookup_size", "customer", [_LOOKUP, fields(c_custkey=1, n={"$size": "$orders"}, total={"$round": [{"$sum": "$orders.o_totalprice"}, 2]})], "SELECT c_custkey, count(o_orderkey)::INT AS n, round(coalesce(sum(o_totalprice), 0), 2) AS total FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
query("q_lookup_unwind", "customer", [_LOOKUP, {"$unwind": "$orders"}, fields(c_custkey=1, o_orderkey="$orders.o_orderkey")], "SELECT c_custkey, o_orderkey FROM customer JOIN orders ON o_custkey = c_custkey")
query("q_lookup_left", "customer", [_LOOKUP, {"$unwind": {"path": "$orders", "preserveNullAndEmptyArrays": True}}, fields(c_custkey=1, o_orderkey="$orders.o_orderkey")], "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON o_custkey = c_custkey")
query("q_lookup_semi", "customer", [_LOOKUP, {"$match": {"orders": {"$ne": []}}}, {"$unset": "orders"}, fields(c_custkey=1)], "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)")
query("q_lookup_anti", "customer", [_LOOKUP, {"$match": {"orders": {"$size": 0}}}, {"$unset": "orders"}, fields(c_custkey=1)], "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
query("q_union_with", "customer", [fields(name="$c_name", bal="$c_acctbal"), {"$unionWith": {"coll": "supplier", "pipeline": [fields(name="$s_name", bal="$s_acctbal")]}}], "SELECT c_name AS name, c_acctbal AS bal FROM customer UNION ALL SELECT s_name, s_acctbal FROM supplier")
query(
    "q_facet",
    "orders",
    [{"$facet": {"by_status": [{"$sortByCount": "$o_orderstatus"}], "dear": [{"$match": {"o_totalprice": {"$gt": 300000}}}, {"$count": "n"}]}}, fields(kinds={"$size": "$by_status"}, dear={"$arrayElemAt": ["$dear.n", 0]})],
    "SELECT (SELECT count(DISTINCT o_orderstatus) FROM orders)::INT AS kinds, (SELECT count(*) FROM orders WHERE o_totalprice > 300000) AS dear",
)
query(
    "q_bucket",
    "orders",
    [{"$bucket": {"groupBy": "$o_totalprice", "boundaries": [0.0, 50000.0, 100000.0, 200000.0], "default": -1.0, "output": {"n": {"$sum": 1}, "top": {"$max": "$o_totalprice"}}}}],
    "SELECT CASE WHEN o_totalprice >= 0 AND o_totalprice < 50000 THEN 0.0 WHEN o_totalprice >= 50000 AND o_totalprice < 100000 THEN 50000.0 WHEN o_totalprice >= 100000 AND o_totalprice < 200000 THEN 100000.0 ELSE -1.0 END::DOUBLE AS _id, count(*) AS n, max(o_totalprice) AS top FROM orders GROUP BY 1",
)
query(
    "q_bucket_null_default",
    "orders",
    [{"$bucket": {"groupBy": "$o_totalprice", "boundaries": [0.0, 50000.0, 100000.0], "default": -1.0, "output": {"top": {"$max": {"$cond": [{"$lt": ["$o_totalprice", 100000]}, "$o_totalprice", None]}}, "n": {"$sum": 1}}}}],
    "SELECT CASE WHEN o_totalprice < 50000 THEN 0.0 WHEN o_totalprice < 100000 THEN 50000.0 ELSE -1.0 END::DOUBLE AS _id, max(CASE WHEN o_totalprice < 100000 THEN o_totalprice END) AS top, count(*) AS n FROM orders GROUP BY 1",
)
query(
    "q_bucket_auto_prices",
    "orders",
    [{"$bucketAuto": {"groupBy": "$o_totalprice", "buckets": 7, "output": {"n": {"$sum": 1}, "last": {"$max": "$o_orderkey"}}}}, fields(lo="$_id.min", hi="$_id.max", n=1, last=1)],
    "WITH d AS (SELECT o_totalprice AS p, row_number() OVER (ORDER BY o_totalprice) AS r, count(*) AS n, max(o_orderkey) AS k FROM orders GROUP BY 1), s AS (SELECT greatest(1, floor(sum(n) / 7 + 0.5)) AS size FROM d), b AS (SELECT least(floor((r - 1) / size), 6) AS b, min(p) AS lo, max(p) AS top, sum(n)::BIGINT AS n, max(k) AS last FROM d, s GROUP BY 1) SELECT lo, coalesce(lead(lo) OVER (ORDER BY b), top) AS hi, n, last FROM b",
)
_AT = lambda name, n: {f"{name}_{i}": {"$arrayElemAt": [f"${name}", i]} for i in range(n)}
query(
    "q_acc_n_order",
    "orders",
    [
        {"$sort": {"o_orderkey": 1}},
        {"$group": {"_id": "$o_orderstatus", "top": {"$topN": {"n": 3, "sortBy": {"o_totalprice": -1, "o_orderkey": 1}, "output": "$o_orderkey"}}, "bottom": {"$bottomN": {"n": 3, "sortBy": {"o_totalprice": -1, "o_orderkey": 1}, "output": "$o_orderkey"}},
                    "most": {"$maxN": {"n": 2, "input": "$o_totalprice"}}, "least": {"$minN": {"n": 2, "input": "$o_totalprice"}}, "first": {"$firstN": {"n": 2, "input": "$o_orderkey"}}, "last": {"$lastN": {"n": 2, "input": "$o_orderkey"}}}},
        fields(status="$_id", **_AT("top", 3), **_AT("bottom", 3), **_AT("most", 2), **_AT("least", 2), **_AT("first", 2), **_AT("last", 2)),
    ],
    "WITH g AS (SELECT o_orderstatus AS status, list(o_orderkey ORDER BY o_totalprice DESC, o_orderkey) AS t, list(o_totalprice ORDER BY o_totalprice) AS p, list(o_orderkey ORDER BY o_orderkey) AS k FROM orders GROUP BY 1) SELECT status, t[1] AS top_0, t[2] AS top_1, t[3] AS top_2, t[-3] AS bottom_0, t[-2] AS bottom_1, t[-1] AS bottom_2, p[-1] AS most_0, p[-2] AS most_1, p[1] AS least_0, p[2] AS least_1, k[1] AS first_0, k[2] AS first_1, k[-2] AS last_0, k[-1] AS last_1 FROM g",
)
query(
    "q_bucket_auto",
    "part",
    [{"$bucketAuto": {"groupBy": "$p_size", "buckets": 4, "output": {"n": {"$sum": 1}}}}, fields(lo="$_id.min", n=1)],
    "WITH d AS (SELECT p_size, row_number() OVER (ORDER BY p_size) AS r, count(*) AS n FROM part GROUP BY 1), s AS (SELECT greatest(1, floor(sum(n) / 4 + 0.5)) AS size FROM d) SELECT min(p_size) AS lo, sum(n)::BIGINT AS n FROM (SELECT p_size, n, least(floor((r - 1) / size), 3) AS b FROM d, s) GROUP BY b",
)

# accumulators

query(
    "q_acc_numeric",
    "lineitem",
    [
        {"$group": {"_id": "$l_returnflag", "n": {"$count": {}}, "a": {"$avg": "$l_quantity"}, "lo": {"$min": "$l_extendedprice"}, "hi": {"$max": "$l_extendedprice"}, "sp": {"$stdDevPop": "$l_quantity"}, "ss": {"$stdDevSamp": "$l_quantity"},
                    "cp": {"$covariancePop": ["$l_quantity", "$l_discount"]}, "cs": {"$covarianceSamp": ["$l_quantity", "$l_discount"]}, "med": {"$median": {"input": "$l_quantity", "method": "exact"}}, "pct": {"$percentile": {"input": "$l_quantity", "p": [0.25, 0.9], "method": "exact"}}}},
        fields(flag="$_id", n=1, lo=1, hi=1, med=1, a={"$round": ["$a", 4]}, sp={"$round": ["$sp", 4]}, ss={"$round": ["$ss", 4]}, cp={"$round": ["$cp", 4]}, cs={"$round": ["$cs", 4]}, p25={"$arrayElemAt": ["$pct", 0]}, p90={"$round": [{"$arrayElemAt": ["$pct", 1]}, 4]}),
    ],
    "SELECT l_returnflag AS flag, count(*) AS n, min(l_extendedprice) AS lo, max(l_extendedprice) AS hi, median(l_quantity) AS med, round(avg(l_quantity), 4) AS a, round(stddev_pop(l_quantity), 4) AS sp, round(stddev_samp(l_quantity), 4) AS ss, round(covar_pop(l_quantity, l_discount), 4) AS cp, round(covar_samp(l_quantity, l_discount), 4) AS cs, quantile_cont(l_quantity, 0.25) AS p25, round(quantile_cont(l_quantity, 0.9), 4) AS p90 FROM lineitem GROUP BY 1",
)
query(
    "q_acc_ordered",
    "events",
    [
        {"$sort": {"event_id": 1}},
        {"$group": {"_id": "$user_id", "first": {"$first": "$event_id"}, "last": {"$last": "$event_type"}, "first2": {"$firstN": {"n": 2, "input": "$event_id"}}, "last2": {"$lastN": {"n": 2, "input": "$event_id"}}, "ids": {"$push": "$event_id"}}},
        fields(user_id="$_id", first=1, last=1, a="$first2", b="$last2", n={"$size": "$ids"}, third={"$arrayElemAt": ["$ids", 2]}),
        fields(user_id=1, first=1, last=1, n=1, third=1, a={"$sum": "$a"}, b={"$sum": "$b"}),
    ],
    "SELECT user_id, min(event_id) AS first, max_by(event_type, event_id) AS last, count(*)::INT AS n, (list(event_id ORDER BY event_id))[3] AS third, list_sum((list(event_id ORDER BY event_id))[1:2])::BIGINT AS a, list_sum((list(event_id ORDER BY event_id))[-2:])::BIGINT AS b FROM events GROUP BY 1",
)
query(
    "q_acc_top",
    "orders",
    [
        {"$group": {"_id": "$o_orderstatus", "top": {"$top": {"sortBy": {"o_totalprice": -1, "o_orderkey": 1}, "output": "$o_orderkey"}}, "bottom": {"$bottom": {"sortBy": {"o_totalprice": -1}, "output": "$o_totalprice"}},
                    "top3": {"$topN": {"n": 3, "sortBy": {"o_totalprice": -1}, "output": "$o_totalprice"}}, "bottom3": {"$bottomN": {"n": 3, "sortBy": {"o_totalprice": -1}, "output": "$o_totalprice"}}, "max2": {"$maxN": {"n": 2, "input": "$o_totalprice"}}, "min2": {"$minN": {"n": 2, "input": "$o_totalprice"}}, "kinds": {"$addToSet": "$o_orderpriority"}}},
        fields(status="$_id", top={"$first": "$top"}, bottom={"$first": "$bottom"}, top3={"$round": [{"$sum": "$top3"}, 2]}, bottom3={"$round": [{"$sum": "$bottom3"}, 2]}, max2={"$round": [{"$sum": "$max2"}, 2]}, min2={"$round": [{"$sum": "$min2"}, 2]}, kinds={"$size": "$kinds"}),
    ],
    "SELECT o_orderstatus AS status, (list(o_orderkey ORDER BY o_totalprice DESC, o_orderkey))[1] AS top, min(o_totalprice) AS bottom, round(list_sum((list(o_totalprice ORDER BY o_totalprice DESC))[1:3]), 2) AS top3, round(list_sum((list(o_totalprice ORDER BY o_totalprice))[1:3]), 2) AS bottom3, round(list_sum((list(o_totalprice ORDER BY o_totalprice DESC))[1:2]), 2) AS max2, round(list_sum((list(o_totalprice ORDER BY o_totalprice))[1:2]), 2) AS min2, count(DISTINCT o_orderpriority)::INT AS kinds FROM orders GROUP BY 1",
)
query(
    "q_acc_merge_objects",
    "events",
    [{"$sort": {"event_id": 1}}, {"$group": {"_id": "$user_id", "m": {"$mergeObjects": {"kind": "$event_type", "id": "$event_id"}}}}, fields(user_id="$_id", kind="$m.kind", id="$m.id")],
    "SELECT user_id, max_by(event_type, event_id) AS kind, max(event_id) AS id FROM events GROUP BY 1",
)
query(
    "q_acc_accumulator",
    "orders",
    [{"$group": {"_id": "$o_orderstatus", "v": {"$accumulator": {"init": lambda: 0, "accumulateArgs": ["$o_orderkey"], "accumulate": lambda a, x: (a + x * x) % 1000003, "finalize": lambda a: a, "returns": "long", "lang": "py"}}}}, fields(status="$_id", v=1)],
    "SELECT o_orderstatus AS status, (sum(o_orderkey::HUGEINT * o_orderkey) % 1000003)::BIGINT AS v FROM orders GROUP BY 1",
)

# windows


def _window(name: str, field: dict, sql: str, by: dict | None = None) -> None:
    query(f"q_win_{name}", "events", [{"$setWindowFields": {"partitionBy": "$user_id", "sortBy": by or {"event_id": 1}, "output": {"v": field}}}, fields(event_id=1, v={"$round": ["$v", 8]} if "round" in sql else "$v")], f"SELECT event_id, {sql.replace('round(', 'round_even(')} AS v FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)")


_T = "epoch_ms(ts)"
_window("rank", {"$rank": {}}, "rank() OVER w::INT")
_window("dense_rank", {"$denseRank": {}}, "dense_rank() OVER (PARTITION BY user_id ORDER BY event_type)::INT", {"event_type": 1})
_window("document_number", {"$documentNumber": {}}, "row_number() OVER w::INT")
_window("shift", {"$shift": {"output": "$event_type", "by": -1, "default": "none"}}, "lag(event_type, 1, 'none') OVER w")
_window("rows_sum", {"$sum": "$value", "window": {"documents": [-2, "current"]}}, "round(sum(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS 2 PRECEDING), 8)")
_window("range_sum", {"$sum": "$value", "window": {"range": [-50, 0]}}, "round(sum(value) OVER (PARTITION BY user_id ORDER BY event_id RANGE BETWEEN 50 PRECEDING AND CURRENT ROW), 8)")
_window("range_time", {"$count": {}, "window": {"range": [-6, 0], "unit": "hour"}}, "count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 6 HOUR PRECEDING AND CURRENT ROW)", {"ts": 1})
_window("avg_all", {"$avg": "$value"}, "round(avg(value) OVER (PARTITION BY user_id), 8)")
_window("push", {"$max": "$value", "window": {"documents": [-1, 1]}}, "round(max(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING), 8)")
_window("derivative", {"$derivative": {"input": "$value"}, "window": {"documents": [-1, 0]}}, "round((value - lag(value) OVER w) / (event_id - lag(event_id) OVER w), 8)")
_window("integral", {"$integral": {"input": "$value"}, "window": {"documents": ["unbounded", "current"]}}, "round(coalesce(sum(t) OVER w, 0), 8)")
ORACLES["q_win_integral"] = "SELECT event_id, round_even(coalesce(sum(t) OVER (PARTITION BY user_id ORDER BY event_id), 0), 8) AS v FROM (SELECT *, (event_id - lag(event_id) OVER w) * (value + lag(value) OVER w) / 2 AS t FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id))"
_window("exp_moving_avg", {"$expMovingAvg": {"input": "$value", "alpha": 0.3}}, "round_even(value, 8)")
ORACLES["q_win_exp_moving_avg"] = "WITH RECURSIVE r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events), e AS (SELECT user_id, event_id, n, value AS a FROM r WHERE n = 1 UNION ALL SELECT r.user_id, r.event_id, r.n, 0.3 * r.value + 0.7 * e.a FROM e JOIN r ON r.user_id = e.user_id AND r.n = e.n + 1) SELECT event_id, round_even(a, 8) AS v FROM e"
_GAPS = {"$addFields": {"gap": {"$cond": [{"$eq": [{"$mod": ["$event_id", 3]}, 0]}, "$value", None]}}}
_GAPS_SQL = "g AS (SELECT *, CASE WHEN event_id % 3 = 0 THEN value END AS gap FROM events)"
query("q_win_locf", "events", [_GAPS, {"$setWindowFields": {"partitionBy": "$user_id", "sortBy": {"event_id": 1}, "output": {"v": {"$locf": "$gap"}}}}, fields(event_id=1, v=1)], f"WITH {_GAPS_SQL} SELECT event_id, last_value(gap IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS v FROM g")
_LINEAR_SQL = f"WITH {_GAPS_SQL}, k AS (SELECT *, CASE WHEN gap IS NOT NULL THEN event_id END AS x FROM g), s AS (SELECT event_id, gap, last_value(x IGNORE NULLS) OVER a AS x0, last_value(gap IGNORE NULLS) OVER a AS y0, first_value(x IGNORE NULLS) OVER z AS x1, first_value(gap IGNORE NULLS) OVER z AS y1 FROM k WINDOW a AS (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING), z AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))"
query("q_win_linear_fill", "events", [_GAPS, {"$setWindowFields": {"partitionBy": "$user_id", "sortBy": {"event_id": 1}, "output": {"v": {"$linearFill": "$gap"}}}}, fields(event_id=1, v={"$round": ["$v", 8]})], f"{_LINEAR_SQL} SELECT event_id, round_even(coalesce(gap, y0 + (y1 - y0) * (event_id - x0) / nullif(x1 - x0, 0)), 8) AS v FROM s")
query("q_fill", "events", [_GAPS, {"$addFields": {"g2": "$gap"}}, {"$fill": {"partitionBy": "$user_id", "sortBy": {"event_id": 1}, "output": {"gap": {"method": "locf"}, "g2": {"value": -1.0}}}}, fields(event_id=1, gap=1, g2=1)], f"WITH {_GAPS_SQL} SELECT event_id, last_value(gap IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS gap, coalesce(gap, -1.0) AS g2 FROM g")

# expressions

_R = lambda x, n=6: {"$round": [x, n]}
query(
    "q_math",
    "lineitem",
    [{"$group": {"_id": {"q": "$l_quantity", "d": "$l_discount"}}}, {"$replaceRoot": {"newRoot": "$_id"}}, fields(q=1, d=1, abs={"$abs": {"$subtract": ["$d", "$q"]}}, add={"$add": ["$q", "$d", 1]}, ceil={"$ceil": {"$divide": ["$q", 7]}}, floor={"$floor": {"$divide": ["$q", 7]}}, divide=_R({"$divide": ["$q", 7]}), exp=_R({"$exp": "$d"}), ln=_R({"$ln": "$q"}), log=_R({"$log": ["$q", 2]}), log10=_R({"$log10": "$q"}),
     mod={"$mod": ["$q", 7]}, multiply=_R({"$multiply": ["$q", "$d", 2]}), pow=_R({"$pow": ["$q", 2]}), round=_R({"$divide": ["$q", 8]}, 1), sqrt=_R({"$sqrt": "$q"}), subtract=_R({"$subtract": ["$q", "$d"]}), trunc=_R({"$trunc": [{"$divide": ["$q", 7]}, 2]}))],
    "SELECT DISTINCT l_quantity AS q, l_discount AS d, abs(l_discount - l_quantity) AS abs, l_quantity + l_discount + 1 AS add, ceil(l_quantity / 7)::BIGINT AS ceil, floor(l_quantity / 7)::BIGINT AS floor, round_even(l_quantity / 7, 6) AS divide, round_even(exp(l_discount), 6) AS exp, round_even(ln(l_quantity), 6) AS ln, round_even(ln(l_quantity) / ln(2), 6) AS log, round_even(log10(l_quantity), 6) AS log10, l_quantity % 7 AS mod, round_even(l_quantity * l_discount * 2, 6) AS multiply, round_even(l_quantity ** 2, 6) AS pow, round_even(l_quantity / 8, 1) AS round, round_even(sqrt(l_quantity), 6) AS sqrt, round_even(l_quantity - l_discount, 6) AS subtract, round_even(floor(l_quantity / 7 * 100) / 100, 6) AS trunc FROM lineitem",
)
query(
    "q_trig",
    "lineitem",
    [{"$group": {"_id": "$l_discount"}}, {"$addFields": {"x": "$_id", "y": {"$add": ["$_id", 1.5]}}}, fields(x=1, **{n: _R({f"${n}": "$x"}) for n in ("sin", "cos", "tan", "asin", "acos", "atan", "sinh", "cosh", "asinh", "atanh", "degreesToRadians", "radiansToDegrees")}, acosh=_R({"$acosh": "$y"}), atan2=_R({"$atan2": ["$x", "$y"]}))],
    "SELECT DISTINCT x, " + ", ".join(f"round_even({f}(x), 6) AS {n}" for n, f in (("sin", "sin"), ("cos", "cos"), ("tan", "tan"), ("asin", "asin"), ("acos", "acos"), ("atan", "atan"), ("sinh", "sinh"), ("cosh", "cosh"), ("asinh", "asinh"), ("atanh", "atanh"), ("degreesToRadians", "radians"), ("radiansToDegrees", "degrees"))) + ", round_even(acosh(x + 1.5), 6) AS acosh, round_even(atan2(x, x + 1.5), 6) AS atan2 FROM (SELECT l_discount AS x FROM lineitem)",
)
query("q_bits", "orders", [fields(o_orderkey=1, a={"$bitAnd": ["$o_orderkey", 255]}, o={"$bitOr": ["$o_orderkey", 1]}, x={"$bitXor": ["$o_orderkey", 1023]}, n={"$bitNot": "$o_orderkey"})], "SELECT o_orderkey, o_orderkey & 255 AS a, o_orderkey | 1 AS o, xor(o_orderkey, 1023) AS x, ~o_orderkey AS n FROM orders")
query(
    "q_logic",
    "orders",
    [fields(o_orderkey=1, a={"$and": [{"$gt": ["$o_totalprice", 1000]}, {"$eq": ["$o_orderstatus", "F"]}]}, o={"$or": [{"$lt": ["$o_totalprice", 1000]}, {"$ne": ["$o_orderstatus", "F"]}]}, n={"$not": [{"$gte": ["$o_totalprice", 50000]}]}, le={"$lte": ["$o_totalprice", 50000]}, c={"$cmp": ["$o_orderstatus", "O"]},
            k={"$cond": {"if": {"$gt": ["$o_totalprice", 100000]}, "then": "big", "else": "small"}}, i={"$ifNull": ["$missing", "$o_orderstatus"]}, s={"$switch": {"branches": [{"case": {"$eq": ["$o_orderstatus", "F"]}, "then": 1}, {"case": {"$eq": ["$o_orderstatus", "O"]}, "then": 2}], "default": 3}}, l={"$let": {"vars": {"x": {"$mod": ["$o_orderkey", 10]}}, "in": {"$multiply": ["$$x", "$$x"]}}}, lit={"$literal": "$x"})],
    "SELECT o_orderkey, o_totalprice > 1000 AND o_orderstatus = 'F' AS a, o_totalprice < 1000 OR o_orderstatus <> 'F' AS o, NOT o_totalprice >= 50000 AS n, o_totalprice <= 50000 AS le, CASE WHEN o_orderstatus < 'O' THEN -1 WHEN o_orderstatus = 'O' THEN 0 ELSE 1 END::INT AS c, CASE WHEN o_totalprice > 100000 THEN 'big' ELSE 'small' END AS k, o_orderstatus AS i, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 3 END::INT AS s, (o_orderkey % 10) ** 2::BIGINT AS l, '$x' AS lit FROM orders".replace("(o_orderkey % 10) ** 2::BIGINT", "((o_orderkey % 10) * (o_orderkey % 10))::BIGINT"),
)
query(
    "q_strings",
    "part",
    [fields(p_partkey=1, cat={"$concat": ["$p_brand", "-", "$p_type"]}, pos={"$indexOfBytes": ["$p_name", "a"]}, up={"$toUpper": "$p_name"}, low={"$toLower": "$p_brand"}, sub={"$substrCP": ["$p_name", 1, 3]}, sub2={"$substr": ["$p_name", 0, -1]}, sub3={"$substrBytes": ["$p_name", 2, 4]}, n={"$strLenCP": "$p_name"}, b={"$strLenBytes": "$p_name"}, c={"$strcasecmp": ["$p_brand", "brand#25"]},
            l={"$ltrim": {"input": "$p_brand", "chars": "Br"}}, r={"$rtrim": {"input": "$p_brand", "chars": "12345"}}, t={"$trim": {"input": {"$concat": ["  ", "$p_brand", " "]}}}, one={"$replaceOne": {"input": "$p_name", "find": "a", "replacement": "<>"}}, all={"$replaceAll": {"input": "$p_name", "find": "a", "replacement": "<>"}}, parts={"$size": [{"$split": ["$p_name", " "]}]}, m={"$regexMatch": {"input": "$p_name", "regex": "^[a-m]"}}, found={"$regexFind": {"input": "$p_name", "regex": "[aeiou]+"}}, every={"$regexFindAll": {"input": "$p_name", "regex": "[aeiou]"}}),
     {"$addFields": {"found": "$found.match", "fat": "$found.idx", "every": {"$size": "$every"}, "last": {"$last": "$every.idx"}}}],
    "SELECT p_partkey, p_brand || '-' || p_type AS cat, (instr(p_name, 'a') - 1)::INT AS pos, upper(p_name) AS up, lower(p_brand) AS low, substr(p_name, 2, 3) AS sub, p_name AS sub2, substr(p_name, 3, 4) AS sub3, length(p_name)::INT AS n, strlen(p_name)::INT AS b, CASE WHEN upper(p_brand) < 'BRAND#25' THEN -1 WHEN upper(p_brand) = 'BRAND#25' THEN 0 ELSE 1 END::INT AS c, ltrim(p_brand, 'Br') AS l, rtrim(p_brand, '12345') AS r, p_brand AS t, CASE WHEN instr(p_name, 'a') > 0 THEN substr(p_name, 1, instr(p_name, 'a') - 1) || '<>' || substr(p_name, instr(p_name, 'a') + 1) ELSE p_name END AS one, replace(p_name, 'a', '<>') AS all, len(string_split(p_name, ' '))::INT AS parts, regexp_matches(p_name, '^[a-m]') AS m, nullif(regexp_extract(p_name, '[aeiou]+'), '') AS found, CASE WHEN regexp_matches(p_name, '[aeiou]') THEN instr(p_name, regexp_extract(p_name, '[aeiou]')) - 1 END::INT AS fat, len(regexp_extract_all(p_name, '[aeiou]'))::INT AS every, CASE WHEN regexp_matches(p_name, '[aeiou]') THEN length(regexp_extract(p_name, '^(.*)[aeiou]', 1)) END::INT AS last FROM part",
)
query(
    "q_dates",
    "orders",
    [fields(o_orderkey=1, **{n: {f"${n}": "$o_orderdate"} for n in ("year", "month", "dayOfMonth", "dayOfWeek", "dayOfYear", "hour", "minute", "second", "millisecond", "isoWeek", "isoWeekYear", "isoDayOfWeek", "week")}, add={"$dateAdd": {"startDate": "$o_orderdate", "unit": "day", "amount": 40}}, sub={"$dateSubtract": {"startDate": "$o_orderdate", "unit": "month", "amount": 2}}, diff={"$dateDiff": {"startDate": dt.datetime(1992, 3, 5), "endDate": "$o_orderdate", "unit": "day"}}, months={"$dateDiff": {"startDate": dt.datetime(1992, 3, 5), "endDate": "$o_orderdate", "unit": "month"}},
            parts={"$dateFromParts": {"year": {"$year": "$o_orderdate"}, "month": 14, "day": 3}}, text={"$dateToString": {"date": "$o_orderdate", "format": "%Y/%m/%d %H:%M"}}, back={"$dateFromString": {"dateString": {"$dateToString": {"date": "$o_orderdate", "format": "%Y/%m/%d"}}, "format": "%Y/%m/%d"}}, tp={"$dateToParts": {"date": "$o_orderdate"}}),
     {"$addFields": {"tp": "$tp.month", **{k: {"$toString": f"${k}"} for k in ("add", "sub", "parts", "back")}}}],
    "SELECT o_orderkey, year(d)::INT AS year, month(d)::INT AS month, day(d)::INT AS dayOfMonth, (dayofweek(d) + 1)::INT AS dayOfWeek, dayofyear(d)::INT AS dayOfYear, hour(d)::INT AS hour, minute(d)::INT AS minute, second(d)::INT AS second, (millisecond(d) % 1000)::INT AS millisecond, week(d)::INT AS isoWeek, isoyear(d)::INT AS isoWeekYear, isodow(d)::INT AS isoDayOfWeek, strftime(d, '%U')::INT AS week, strftime(d + INTERVAL 40 DAY, '%Y-%m-%dT%H:%M:%S.%gZ') AS add, strftime(d - INTERVAL 2 MONTH, '%Y-%m-%dT%H:%M:%S.%gZ') AS sub, date_diff('day', TIMESTAMP '1992-03-05', d) AS diff, date_diff('month', TIMESTAMP '1992-03-05', d) AS months, strftime(make_timestamp(year(d) + 1, 2, 3, 0, 0, 0), '%Y-%m-%dT%H:%M:%S.%gZ') AS parts, strftime(d, '%Y/%m/%d %H:%M') AS text, strftime(date_trunc('day', d), '%Y-%m-%dT%H:%M:%S.%gZ') AS back, month(d)::INT AS tp FROM (SELECT *, o_orderdate AS d FROM orders)",
)
_LISTS = [{"$group": {"_id": "$user_id", "a": {"$addToSet": {"$mod": ["$event_id", 7]}}, "b": {"$addToSet": {"$mod": ["$event_id", 5]}}}}]
_LISTS_SQL = "l AS (SELECT user_id, list_sort(list(DISTINCT event_id % 7)) AS a, list_sort(list(DISTINCT event_id % 5)) AS b FROM events GROUP BY 1)"
_SUM = lambda x: {"$sum": x}
query(
    "q_arrays",
    "events",
    [*_LISTS, fields(user_id="$_id", el={"$arrayElemAt": ["$a", -1]}, cat={"$size": [{"$concatArrays": ["$a", "$b"]}]}, fil=_SUM({"$filter": {"input": "$a", "as": "x", "cond": {"$gt": ["$$x", 2]}}}), first={"$first": "$a"}, last={"$last": "$a"}, f2=_SUM({"$firstN": {"n": 2, "input": "$a"}}), l2=_SUM({"$lastN": {"n": 2, "input": "$a"}}), inn={"$in": [3, "$a"]}, nin={"$nin": [3, "$a"]}, pos={"$indexOfArray": ["$a", 3]}, isa={"$isArray": "$a"}, map=_SUM({"$map": {"input": "$a", "as": "x", "in": {"$multiply": ["$$x", 2]}}}),
            mx=_SUM({"$maxN": {"n": 2, "input": "$a"}}), mn=_SUM({"$minN": {"n": 2, "input": "$a"}}), rng={"$size": [{"$range": [0, {"$size": "$a"}, 2]}]}, red={"$reduce": {"input": "$a", "initialValue": 0, "in": {"$add": ["$$value", "$$this"]}}}, rev={"$first": {"$reverseArray": "$a"}}, sl=_SUM({"$slice": ["$a", 1, 2]}), srt={"$first": {"$sortArray": {"input": "$a", "sortBy": -1}}}, zip={"$size": [{"$zip": {"inputs": ["$a", "$b"]}}]}, med={"$median": {"input": "$a", "method": "approximate"}}, pct={"$first": {"$percentile": {"input": "$a", "p": [0.9], "method": "approximate"}}})],
    f"WITH {_LISTS_SQL} SELECT user_id, a[-1] AS el, (len(a) + len(b))::INT AS cat, coalesce(list_sum(list_filter(a, lambda x: x > 2)), 0)::BIGINT AS fil, a[1] AS first, a[-1] AS last, list_sum(a[1:2])::BIGINT AS f2, list_sum(a[-2:])::BIGINT AS l2, list_contains(a, 3) AS inn, NOT list_contains(a, 3) AS nin, coalesce(list_position(a, 3), 0)::INT - 1 AS pos, true AS isa, (list_sum(a) * 2)::BIGINT AS map, list_sum(a[-2:])::BIGINT AS mx, list_sum(a[1:2])::BIGINT AS mn, ceil(len(a) / 2)::INT AS rng, list_sum(a)::BIGINT AS red, a[-1] AS rev, coalesce(list_sum(a[2:3]), 0)::BIGINT AS sl, a[-1] AS srt, least(len(a), len(b))::INT AS zip, a[greatest(ceil(len(a) * 0.5), 1)::INT]::DOUBLE AS med, a[greatest(ceil(len(a) * 0.9), 1)::INT]::DOUBLE AS pct FROM l",
)
query(
    "q_sets",
    "events",
    [*_LISTS, fields(user_id="$_id", d=_SUM({"$setDifference": ["$a", "$b"]}), e={"$setEquals": ["$a", "$b"]}, i=_SUM({"$setIntersection": ["$a", "$b"]}), s={"$setIsSubset": ["$b", "$a"]}, u={"$size": [{"$setUnion": ["$a", "$b"]}]}, al={"$allElementsTrue": ["$a"]}, an={"$anyElementTrue": ["$a"]})],
    f"WITH {_LISTS_SQL} SELECT user_id, coalesce(list_sum(list_filter(a, lambda x: NOT list_contains(b, x))), 0)::BIGINT AS d, a = b AS e, coalesce(list_sum(list_intersect(a, b)), 0)::BIGINT AS i, len(list_filter(b, lambda x: NOT list_contains(a, x))) = 0 AS s, len(list_distinct(list_concat(a, b)))::INT AS u, NOT list_contains(a, 0) AS al, len(list_filter(a, lambda x: x <> 0)) > 0 AS an FROM l",
)
query(
    "q_acc_as_expressions",
    "events",
    [*_LISTS, fields(user_id="$_id", s={"$sum": "$a"}, v=_R({"$avg": "$a"}, 4), hi={"$max": "$a"}, lo={"$min": "$a"}, sd=_R({"$stdDevPop": "$a"}, 4), two={"$sum": [{"$size": "$a"}, {"$size": "$b"}]})],
    f"WITH {_LISTS_SQL} SELECT user_id, list_sum(a)::BIGINT AS s, round_even(list_avg(a), 4) AS v, list_max(a) AS hi, list_min(a) AS lo, round_even(list_stddev_pop(a), 4) AS sd, (len(a) + len(b))::BIGINT AS two FROM l",
)
query(
    "q_objects",
    "customer",
    [{"$addFields": {"o": {"$mergeObjects": [{"a": "$c_custkey", "b": "x"}, {"b": "$c_mktsegment"}]}}}, {"$addFields": {"k": {"$objectToArray": {"p": "$c_name", "q": "$c_mktsegment"}}, "o": {"$setField": {"field": "z", "input": "$o", "value": "$c_nationkey"}}}}, {"$addFields": {"m": {"$arrayToObject": "$k"}, "o2": {"$unsetField": {"field": "a", "input": "$o"}}}}, fields(c_custkey=1, b="$o.b", z="$o.z", k={"$arrayElemAt": ["$k.v", 1]}, q={"$getField": {"field": "q", "input": "$m"}}, b2="$o2.b", name={"$getField": "c_name"})],
    "SELECT c_custkey, c_mktsegment AS b, c_nationkey AS z, c_mktsegment AS k, c_mktsegment AS q, c_mktsegment AS b2, c_name AS name FROM customer",
)
query(
    "q_types",
    "orders",
    [fields(o_orderkey=1, i={"$toInt": "$o_totalprice"}, l={"$toLong": "$o_orderkey"}, d={"$toDouble": "$o_orderkey"}, dec={"$toDecimal": "$o_totalprice"}, b={"$toBool": "$o_orderkey"}, s={"$toString": "$o_orderkey"}, c={"$convert": {"input": "$o_orderpriority", "to": "int", "onError": -1, "onNull": 0}}, n={"$isNumber": "$o_totalprice"}, t={"$type": "$o_totalprice"}, moment={"$toString": {"$toDate": {"$multiply": ["$o_orderkey", 1000]}}})],
    "SELECT o_orderkey, trunc(o_totalprice)::INT AS i, o_orderkey AS l, o_orderkey::DOUBLE AS d, o_totalprice AS dec, o_orderkey <> 0 AS b, o_orderkey::VARCHAR AS s, -1::INT AS c, true AS n, 'double' AS t, strftime(epoch_ms(o_orderkey * 1000), '%Y-%m-%dT%H:%M:%S.%gZ') AS moment FROM orders",
)
query("q_function", "orders", [fields(o_orderkey=1, f={"$function": {"body": lambda x, y: f"{y}:{x * 2}", "args": ["$o_orderkey", "$o_orderstatus"], "returns": "string", "lang": "py"}})], "SELECT o_orderkey, o_orderstatus || ':' || (o_orderkey * 2) AS f FROM orders")
query("q_rand", "orders", [fields(o_orderkey=1, r={"$and": [{"$gte": [{"$rand": {}}, 0]}, {"$lt": [{"$rand": {}}, 1]}]}, s={"$sampleRate": 1.0})], "SELECT o_orderkey, true AS r, true AS s FROM orders")

# updates

_PART = "SELECT p_partkey, {} FROM part"


def _updated(name: str, spec: dict, sql: str, keep: list[str], condition: dict | None = None, before: list[dict] | None = None, after: list[dict] | None = None) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        o = _options(spark, sf_dir)
        df = aggregate(o.collections("part"), before or [], o)
        out = update(df, spec, condition=condition, options=o)
        return aggregate(out, after or [], o).select("p_partkey", *keep)

    QUERIES[f"q_upd_{name}"] = run
    ORACLES[f"q_upd_{name}"] = _PART.format(sql)


_NEST = [{"$addFields": {"a": ["$p_size", 3, 9], "o": {"x": "$p_size", "y": {"z": "$p_brand"}}}}]
_FLAT = [{"$addFields": {"n": {"$size": "$a"}, "first": {"$first": "$a"}, "last": {"$last": "$a"}}}]
_updated("set", {"$set": {"p_brand": "none", "o.y.z": "new"}}, "'none' AS p_brand, 'new' AS z, p_size AS x", ["p_brand", "z", "x"], None, _NEST, [{"$addFields": {"z": "$o.y.z", "x": "$o.x"}}])
_updated("set_if", {"$set": {"p_brand": "small"}}, "CASE WHEN p_size < 10 THEN 'small' ELSE p_brand END AS p_brand", ["p_brand"], {"p_size": {"$lt": 10}})
_updated("unset", {"$unset": {"o.x": ""}}, "p_brand AS z", ["z"], None, _NEST, [{"$addFields": {"z": "$o.y.z"}}])
_updated("inc", {"$inc": {"p_size": 5}}, "p_size + 5 AS p_size", ["p_size"])
_updated("mul", {"$mul": {"p_size": 2}}, "p_size * 2 AS p_size", ["p_size"])
_updated("max", {"$max": {"p_size": 20}}, "greatest(p_size, 20) AS p_size", ["p_size"])
_updated("min", {"$min": {"p_size": 20}}, "least(p_size, 20) AS p_size", ["p_size"])
_updated("bit", {"$bit": {"p_size": {"xor": 7}}}, "xor(p_size, 7) AS p_size", ["p_size"])
_updated("rename", {"$rename": {"p_size": "size"}}, "p_size AS size", ["size"])
_updated("pop", {"$pop": {"a": 1}}, "2::INT AS n, p_size AS first, 3::INT AS last", ["n", "first", "last"], None, _NEST, _FLAT)
_updated("pull", {"$pull": {"a": {"$gte": 9}}}, "(1 + (p_size < 9)::INT)::INT AS n, CASE WHEN p_size < 9 THEN p_size ELSE 3 END AS first, 3::INT AS last", ["n", "first", "last"], None, _NEST, _FLAT)
_updated("pull_all", {"$pullAll": {"a": [3, 9]}}, "(p_size NOT IN (3, 9))::INT AS n", ["n"], None, _NEST, _FLAT)
_updated("push", {"$push": {"a": {"$each": [1, 2], "$sort": -1, "$slice": 4}}}, "4::INT AS n, greatest(p_size, 9) AS first", ["n", "first"], None, _NEST, _FLAT)
_updated("add_to_set", {"$addToSet": {"a": {"$each": [3, 77]}}}, "4::INT AS n, 77::INT AS last", ["n", "last"], None, _NEST, _FLAT)
_updated("current_date", {"$currentDate": {"p_size": True}}, "true AS recent", ["recent"], None, None, [{"$addFields": {"recent": {"$gt": ["$p_size", 1600000000000]}}}])


@custom("q_upd_array_filters", "SELECT p_partkey, p_size AS first, 100::INT AS last FROM part WHERE p_size < 9 UNION ALL SELECT p_partkey, 100::INT, 100::INT FROM part WHERE p_size >= 9")
def _array_filters(c, o):
    df = aggregate(c("part"), _NEST, o)
    return aggregate(update(df, {"$set": {"a.$[e]": 100}}, [{"e": {"$gte": 9}}], options=o), _FLAT, o).select("p_partkey", "first", "last")


# sinks


@custom("q_merge", "SELECT c_custkey, c_acctbal + 1 AS c_acctbal FROM customer WHERE c_nationkey = 3 UNION ALL SELECT c_custkey, c_acctbal FROM customer WHERE c_nationkey <> 3 AND c_custkey % 2 = 0")
def _merge(c, o):
    target = FrameTarget(c("customer").filter("c_nationkey <> 3 AND c_custkey % 2 = 0 OR c_nationkey = 3 AND c_custkey % 3 = 0").select("c_custkey", "c_acctbal"))
    aggregate(c("customer"), [{"$match": {"c_nationkey": 3}}, fields(c_custkey=1, c_acctbal={"$add": ["$c_acctbal", 1]}), {"$merge": {"into": target, "on": "c_custkey", "whenMatched": "replace", "whenNotMatched": "insert"}}], o)
    return target.df


def _merged(when: str, sql: str, sort: int = 1, new: str = "insert") -> None:
    """Orders, several of a customer, merged into a third of all customers; the last order in the sort's order counts."""

    def run(c, o):
        target = FrameTarget(c("customer").filter("c_custkey % 3 = 0").selectExpr("c_custkey", "CAST(NULL AS BIGINT) AS o_orderkey", "c_acctbal AS price"))
        aggregate(c("orders"), [{"$match": {"o_custkey": {"$lt": 400}}}, {"$sort": {"o_orderkey": sort}}, fields(c_custkey="$o_custkey", o_orderkey=1, price="$o_totalprice"), {"$merge": {"into": target, "on": "c_custkey", "whenMatched": when, "whenNotMatched": new}}], o)
        return target.df

    custom(f"q_merge_{when.lower()}_{new}", sql)(run)


_OLD = "t AS (SELECT c_custkey, NULL::BIGINT AS o_orderkey, c_acctbal AS price FROM customer WHERE c_custkey % 3 = 0), n AS (SELECT o_custkey AS c_custkey, o_orderkey, o_totalprice AS price FROM orders WHERE o_custkey < 400)"
_LAST = "l AS (SELECT c_custkey, arg_max(o_orderkey, o_orderkey) AS o_orderkey, arg_max(price, o_orderkey) AS price FROM n GROUP BY 1)"
_FRESH = "SELECT * FROM n WHERE c_custkey NOT IN (SELECT c_custkey FROM t)"
_merged("replace", f"WITH {_OLD}, {_LAST} SELECT t.c_custkey, l.o_orderkey, coalesce(l.price, t.price) AS price FROM t LEFT JOIN l USING (c_custkey) UNION ALL {_FRESH}")
_merged("merge", f"WITH {_OLD}, {_LAST.replace('arg_max', 'arg_min')} SELECT t.c_custkey, l.o_orderkey, coalesce(l.price, t.price) AS price FROM t LEFT JOIN l USING (c_custkey)", -1, "discard")
_merged("keepExisting", f"WITH {_OLD} SELECT * FROM t UNION ALL {_FRESH}")


@custom("q_out", "SELECT s_suppkey, s_acctbal FROM supplier WHERE s_acctbal > 0")
def _out(c, o):
    class Held:
        df = None

        def append(self, df):
            self.df = df if self.df is None else self.df.unionByName(df)

    held = Held()
    aggregate(c("supplier"), [{"$match": {"s_acctbal": {"$gt": 0}}}, fields(s_suppkey=1, s_acctbal=1), {"$out": held}], o)
    return held.df


@custom("q_json_path", "SELECT event_id FROM events WHERE json_extract(props, '$.k')::BIGINT > 50")
def _json_path(c, o):
    events = c("events").withColumn("props", F.from_json("props", "k long"))
    return aggregate(events, [{"$match": {"props.k": {"$gt": 50}}}, fields(event_id=1)], o)
