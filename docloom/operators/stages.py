"""Pipeline stages: DataFrame to DataFrame."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..context import Options, SpecError, register
from ..plans.scope import Scope
from ..plans.values import collated, follow, literal
from ..sources.catalog import resolve
from .accumulators import ORDERED, Group, accumulate, extreme, gathered, wanted
from .paths import put, put_all
from .projection import project
from .query import compile_query
from .windows import window_field

#: The column that stands for the order of documents where a stage needs one and no $sort gave it.
PLACE = "__place"


@dataclass
class Flow:
    """Documents on their way: df, and the order that the last $sort gave them (column, descending)."""

    df: DataFrame
    options: Options = field(default_factory=Options)
    order: list[tuple[str, bool]] = field(default_factory=list)
    now: Any = None

    def scope(self) -> Scope:
        return Scope(self.df, self.options, self.now) if self.now else Scope(self.df, self.options)

    def to(self, df: DataFrame, ordered: bool = False) -> Flow:
        keep = [(c, d) for c, d in self.order if c.split(".")[0] in df.columns] if ordered else []
        return replace(self, df=df, order=keep if len(keep) == len(self.order) else [])

    def keys(self) -> list[tuple[Column, bool]]:
        s = self.scope()
        return [(key, d) for c, d in self.order for key in collated(*s.field(c), self.options.collation)]


def run(flow: Flow, pipeline: list[dict]) -> Flow:
    """Each stage after the other; a stage is a dict of one operator."""
    for stage in pipeline:
        if len(stage) != 1:
            raise SpecError(f"a stage holds one operator: {', '.join(stage)}")
        ((name, arg),) = stage.items()
        found = flow.options.context.get("pipeline", name)
        if found is None:
            raise SpecError(f"unknown pipeline operator {name}")
        flow = found(flow, arg)
    return flow


def _stage(name: str):
    return register("pipeline", name)


@_stage("$match")
def _match(f: Flow, arg: dict) -> Flow:
    return f.to(f.df.filter(compile_query(f.scope(), arg)), True)


def _add_fields(f: Flow, arg: dict) -> Flow:
    """All expressions see the document before; $$REMOVE takes a field out."""
    s = f.scope()
    values = {k: None if v == "$$REMOVE" else s.compile(v) for k, v in arg.items()}
    if all(v is not None and "." not in k for k, v in values.items()):
        return f.to(f.df.withColumns(values), True)
    return f.to(put_all(f.df, {k: lambda c, t, v=v: v for k, v in values.items()}), True)


register("pipeline", "$addFields", _add_fields)
register("pipeline", "$set", _add_fields)


@_stage("$project")
def _project(f: Flow, arg: dict) -> Flow:
    return f.to(project(f.df, arg, f.scope()), True)


@_stage("$unset")
def _unset(f: Flow, arg: Any) -> Flow:
    df = f.df
    for path in [arg] if isinstance(arg, str) else arg:
        if path.split(".")[0] in df.columns or path in df.columns:
            df = put(df, path, lambda c, t: None)
    return f.to(df, True)


def _replace_root(f: Flow, arg: Any) -> Flow:
    spec = arg["newRoot"] if isinstance(arg, dict) and set(arg) == {"newRoot"} else arg
    s = f.scope()
    c, t = s.typed(spec)
    if not isinstance(t, T.StructType):
        raise SpecError("the new root is an object with known fields")
    return f.to(f.df.select(c.alias("r")).select("r.*"))


register("pipeline", "$replaceRoot", _replace_root)
register("pipeline", "$replaceWith", _replace_root)


def _limit(f: Flow, arg: int) -> Flow:
    """n of 0 or less changes nothing."""
    return f.to(f.df.limit(int(arg)), True) if arg > 0 else f


@_stage("$skip")
def _skip(f: Flow, arg: int) -> Flow:
    return f.to(f.df.offset(int(arg)), True) if arg > 0 else f


register("pipeline", "$limit", _limit)


@_stage("$sort")
def _sort(f: Flow, arg: dict) -> Flow:
    """null first, last if descending; strings by the collation, if there is one."""
    s, out = f.scope(), []
    for k, v in arg.items():
        out += [c.desc_nulls_last() if v in (-1, "desc") else c.asc_nulls_first() for c in collated(*s.field(k), f.options.collation)]
    return replace(f, df=f.df.orderBy(*out), order=[(k, v in (-1, "desc")) for k, v in arg.items()])


@_stage("$count")
def _count(f: Flow, arg: str) -> Flow:
    if not arg or arg.startswith("$") or "." in arg:
        raise SpecError("$count takes a plain field name")
    return f.to(f.df.agg(F.count(F.lit(1)).alias(arg)))


@_stage("$sortByCount")
def _sort_by_count(f: Flow, arg: Any) -> Flow:
    return run(f, [{"$group": {f.options.id_key: arg, "count": {"$sum": 1}}}, {"$sort": {"count": -1}}])


def placed(f: Flow, specs: list[dict]) -> tuple[Flow, list[tuple[Column, bool]]]:
    """The order for accumulators that need one: that of the last $sort, or the documents' place in their source."""
    if not any(set(x) & ORDERED for x in specs if isinstance(x, dict)):
        return f, []
    if f.order:
        return f, f.keys()
    f = f.to(f.df.withColumn(PLACE, F.monotonically_increasing_id()))
    return f, [(F.col(PLACE), False)]


def repeatable(df: DataFrame) -> bool:
    """Whether the plan gives the same documents each time it runs."""
    plan = df._jdf.queryExecution().analyzed()
    return not df.isStreaming and plan.deterministic() and not any(x in plan.toString() for x in ("GlobalLimit", "Offset"))


def grouped(f: Flow, by: Column, name: str, fields: dict) -> DataFrame:
    """One row a group: name holds its key, each field an accumulator's value.

    What returns n values of a group sees only the n documents that count, by a rank whose limit is taken before the shuffle too, and
    is joined to the rest. A plan that need not give the same documents twice is read once, and gathers the groups.
    """
    steady = repeatable(f.df)
    f, order = placed(f, list(fields.values()))
    s = Scope(f.df.drop(PLACE), f.options, f.now) if f.now else Scope(f.df.drop(PLACE), f.options)
    g = Group(order)
    whole = lambda df, some: df.groupBy(by.alias(name)).agg(*[accumulate(s, v, g).alias(k) for k, v in some.items()] or [F.lit(None).alias("__none")])
    near = {k: w for k, v in fields.items() if (w := wanted(s, v, order))} if steady else {}
    out = whole(f.df, {k: v for k, v in fields.items() if k not in near})
    for k, (n, counts, keys) in near.items():
        first = f.df.filter(counts).withColumn("__rank", F.row_number().over(Window.partitionBy(by).orderBy(*keys))).filter(F.col("__rank") <= n)
        part = whole(first, {k: fields[k]}).withColumnRenamed(name, "__by")
        empty = F.array().cast(part.schema[k].dataType)
        out = out.join(part, out[name].eqNullSafe(part["__by"]), "left").withColumn(k, F.coalesce(F.col(f"`{k}`"), empty)).drop("__by")
    return out.select(name, *fields)


@_stage("$group")
def _group(f: Flow, arg: dict) -> Flow:
    """By the value of the id key; null and missing are one group; no documents, no group."""
    key = f.options.id_key
    if key not in arg:
        raise SpecError(f"$group needs {key}")
    spec = arg[key]
    if isinstance(spec, dict) and not spec:
        spec = None
    by = F.lit(None).cast("string") if spec is None else f.scope().compile(spec)
    return f.to(grouped(f, by, key, {k: v for k, v in arg.items() if k != key}))


@_stage("$bucket")
def _bucket(f: Flow, arg: dict) -> Flow:
    """Boundaries are inclusive below; every bucket has a row, if an empty one; without default a value outside is an error."""
    edges = arg["boundaries"]
    if len(edges) < 3 - ("default" in arg) or any(not a < b for a, b in zip(edges, edges[1:], strict=False)):
        raise SpecError("boundaries ascend, and there are three or more")
    s, key = f.scope(), f.options.id_key
    c, t = s.typed(arg["groupBy"])
    n = len(edges) - 1
    at = F.when(F.lit(False), F.lit(0))
    for i in range(n):
        at = at.when((c >= literal(edges[i], t)) & (c < literal(edges[i + 1], t)), F.lit(i))
    at = at.otherwise(F.lit(n) if "default" in arg else F.raise_error(F.lit("$bucket: a value is outside all boundaries and there is no default")).cast("int"))
    fields = arg.get("output") or {"count": {"$sum": 1}}
    found = grouped(f, at, "__bucket", fields | {"__n": {"$sum": 1}})
    names = [*edges[:-1], *([arg["default"]] if "default" in arg else [])]
    same = len({type(x) for x in names}) == 1
    spark = f.df.sparkSession
    every = spark.createDataFrame([(i, x if same else str(x)) for i, x in enumerate(names)], ["__bucket", key]).withColumn("__bucket", F.col("__bucket").cast("int"))
    if same and isinstance(names[0], int) and not isinstance(names[0], bool) and isinstance(t, T.IntegerType):
        every = every.withColumn(key, F.col(key).cast("int"))
    zero = {k: F.coalesce(F.col(k), F.lit(0).cast(found.schema[k].dataType)) if set(v) & {"$sum", "$count"} else F.when(F.col(k).isNull(), F.array().cast(found.schema[k].dataType)).otherwise(F.col(k)) if isinstance(found.schema[k].dataType, T.ArrayType) else F.col(k) for k, v in fields.items()}
    joined = every.join(found, "__bucket", "left")
    joined = joined if "default" not in arg else joined.filter((F.col("__bucket") < n) | F.col("__n").isNotNull())
    return f.to(joined.select(F.col(key), *[zero[k].alias(k) for k in fields]))


#: Ranges in which $bucketAuto ranks values.
PARTS = 256


@_stage("$bucketAuto")
def _bucket_auto(f: Flow, arg: dict) -> Flow:
    """max(1, round(n / buckets)) different values a bucket, the rest in the last; _id holds min and the next bucket's min (for the last its max).

    Ranks are taken over the distinct values. Numbers and dates are dealt into PARTS ranges by approximate quantiles, ranked in each
    and moved on by what the ranges before it hold, so that no task sees all of them; other values are ranked in one window.
    """
    s, key, buckets = f.scope(), f.options.id_key, int(arg["buckets"])
    if buckets < 1:
        raise SpecError("buckets is 1 or more")
    c, t = s.typed(arg["groupBy"])
    held = f.df.withColumn("__key", c)
    distinct = held.groupBy("__key").agg(F.count(F.lit(1)).alias("n"))
    up = F.col("__key").asc_nulls_first()
    if isinstance(t, (T.NumericType, T.DateType, T.TimestampType)):
        bounds = distinct.agg(F.percentile_approx("__key", [i / PARTS for i in range(1, PARTS)]).alias("bounds"))
        dealt = distinct.join(F.broadcast(bounds)).withColumn("part", F.coalesce(F.size(F.filter("bounds", lambda b: b < F.col("__key"))), F.lit(0)))
        parts = dealt.groupBy("part").agg(F.count(F.lit(1)).alias("values"), F.sum("n").alias("n"))  # PARTS rows at most, like the windows over them
        every = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        parts = parts.select("part", (F.sum("values").over(Window.orderBy("part")) - F.col("values")).alias("before"), F.sum("n").over(every).alias("total"))
        placed_ = dealt.drop("bounds", "n").join(F.broadcast(parts), "part").withColumn("place", F.col("before") + F.row_number().over(Window.partitionBy("part").orderBy(up)) - 1)
    else:
        total = distinct.agg(F.sum("n").alias("total"))
        placed_ = distinct.join(F.broadcast(total)).withColumn("place", F.row_number().over(Window.orderBy(up)) - 1)
    size = F.greatest(F.lit(1), F.floor(F.col("total") / buckets + 0.5))
    ranked = placed_.select("__key", F.least(F.floor(F.col("place") / size), F.lit(buckets - 1)).cast("int").alias("__bucket"))
    fields = arg.get("output") or {"count": {"$sum": 1}}
    g = replace(f, df=held.join(ranked, held["__key"].eqNullSafe(ranked["__key"]), "left").drop(ranked["__key"]))
    found = grouped(g, F.col("__bucket"), "__bucket", fields | {"__min": {"$min": "$__key"}, "__max": {"$max": "$__key"}})
    upper = F.coalesce(F.lead("__min").over(Window.orderBy("__bucket")), F.col("__max"))
    return f.to(found.select(F.struct(F.col("__min").alias("min"), upper.alias("max")).alias(key), *fields))


@_stage("$facet")
def _facet(f: Flow, arg: dict) -> Flow:
    """One document: the results of each pipeline over the same input, as an array."""
    out = None
    for name, pipeline in arg.items():
        one = run(replace(f), pipeline)
        rows = F.collect_list(F.struct(F.struct(*[F.col(f"`{c}`") for c in one.df.columns]).alias("v")))
        if one.order:
            rows = gathered(Group(one.keys()), F.struct(*[F.col(f"`{c}`") for c in one.df.columns]))
        else:
            rows = F.transform(rows, lambda r: r["v"])
        row = one.df.agg(rows.alias(name)).withColumn("__one", F.lit(1))
        out = row if out is None else out.join(row, "__one")
    return f.to(out.drop("__one"))


def _lookup_sides(f: Flow, arg: dict) -> tuple[DataFrame, Column, DataFrame]:
    """The foreign documents with their key, and the local key: null matches null; an array's elements each match."""
    foreign = resolve(f.df.sparkSession, f.options.collections, arg["from"])
    key, t = Scope(foreign, f.options).field(arg["foreignField"])
    return foreign, key, t


@_stage("$lookup")
def _lookup(f: Flow, arg: dict) -> Flow:
    """Left join on equality: `as` is the array of the matching foreign documents."""
    foreign, key, _ = _lookup_sides(f, arg)
    docs = foreign.select(key.alias("__key"), F.struct(*[F.col(f"`{c}`") for c in foreign.columns]).alias("__doc")).groupBy("__key").agg(F.collect_list("__doc").alias("__docs"))
    local = f.df.withColumn("__local", f.scope().field(arg["localField"])[0])
    joined = local.join(docs, F.col("__local").eqNullSafe(F.col("__key")), "left")
    docs_t = docs.schema["__docs"].dataType
    out = F.coalesce(F.col("__docs"), F.array().cast(docs_t))
    return f.to(put(joined.withColumn("__as", out), arg["as"], lambda c, t: F.col("__as")).drop("__local", "__key", "__docs", "__as"), True)


@_stage("$lookupUnwind")
def _lookup_unwind(f: Flow, arg: dict) -> Flow:
    """$lookup and $unwind of its result in one join, without arrays; made by the rewriter. keep: documents without a match stay."""
    foreign, key, _ = _lookup_sides(f, arg)
    docs = foreign.select(key.alias("__key"), F.struct(*[F.col(f"`{c}`") for c in foreign.columns]).alias(arg["as"]))
    local = f.df.drop(arg["as"]).withColumn("__local", f.scope().field(arg["localField"])[0])
    return f.to(local.join(docs, F.col("__local").eqNullSafe(F.col("__key")), "left" if arg.get("keep") else "inner").drop("__local", "__key"), True)


@_stage("$lookupExists")
def _lookup_exists(f: Flow, arg: dict) -> Flow:
    """Documents with (or without) a match, as a semi (or anti) join; made by the rewriter."""
    foreign, key, _ = _lookup_sides(f, arg)
    local = f.df.withColumn("__local", f.scope().field(arg["localField"])[0])
    keys = foreign.select(key.alias("__key"))
    return f.to(local.join(keys, F.col("__local").eqNullSafe(F.col("__key")), "left_semi" if arg["found"] else "left_anti").drop("__local"), True)


@_stage("$unionWith")
def _union_with(f: Flow, arg: Any) -> Flow:
    """Both, with repeats; a bare name, or {coll, pipeline}."""
    spec = {"coll": arg} if isinstance(arg, str) else arg
    other = resolve(f.df.sparkSession, f.options.collections, spec["coll"]) if "coll" in spec else f.df
    other = run(replace(f, df=other, order=[]), spec.get("pipeline", [])).df
    return f.to(f.df.select("*").unionByName(other, allowMissingColumns=True))


@_stage("$unwind")
def _unwind(f: Flow, arg: Any) -> Flow:
    """A document for each element; what isn't an array passes through, with a null index."""
    spec = {"path": arg} if isinstance(arg, str) else arg
    path, keep, index = spec["path"].removeprefix("$"), spec.get("preserveNullAndEmptyArrays", False), spec.get("includeArrayIndex")
    c, t = f.scope().field(path)
    if not isinstance(t, T.ArrayType):
        df = f.df if keep else f.df.filter(c.isNotNull())
        return f.to(df.withColumn(index, F.lit(None).cast("long")) if index else df, True)
    parts = path.split(".")
    names = [n for n in f.df.columns if n != index]
    explode = F.posexplode_outer if keep else F.posexplode
    df = f.df.select(*[F.col(f"`{n}`") for n in names], explode(c).alias("__at", "__one"))
    df = put(df, path, lambda c, t: F.col("__one")) if len(parts) > 1 and path not in f.df.columns else df.withColumn(path, F.col("__one"))
    df = df.withColumn(index, F.col("__at").cast("long")) if index else df
    return f.to(df.drop("__at", "__one"))


@_stage("$sample")
def _sample(f: Flow, arg: dict) -> Flow:
    """size documents by chance, each at most once; with replacement: true, size independent draws.

    Draws with replacement: each document comes a Poisson number of times, with so high a mean that fewer than size in all have a chance
    below e^-20, and size of these are taken by chance.
    """
    if arg.get("replacement"):
        n, size = f.df.count(), int(arg["size"])
        f = f.to(f.df.sample(True, (size + 10 * size**0.5 + 50) / n)) if n else f
    return f.to(f.df.orderBy(F.rand()).limit(int(arg["size"])))


@_stage("$setWindowFields")
def _set_window_fields(f: Flow, arg: dict) -> Flow:
    s = f.scope()
    spec = arg.get("partitionBy")
    parts = [] if spec is None else [s.compile(spec)]
    values = {k: window_field(s, parts, arg.get("sortBy") or {}, v) for k, v in arg["output"].items()}
    if all("." not in k and isinstance(v, Column) for k, v in values.items()):
        return f.to(f.df.withColumns(values))
    held = f.df.withColumns({f"__w{i}": v for i, v in enumerate(values.values()) if isinstance(v, Column)})
    for i, v in enumerate(values.values()):
        held = held if isinstance(v, Column) else v(held, f"__w{i}")
    out = put_all(held, {k: lambda c, t, i=i: F.col(f"__w{i}") for i, k in enumerate(values)})
    return f.to(out.drop(*[f"__w{i}" for i in range(len(values))]))


@_stage("$fill")
def _fill(f: Flow, arg: dict) -> Flow:
    """First the fields with a method (linear, locf), then those with a value."""
    by = arg.get("partitionBy") or ([f"${x}" for x in arg["partitionByFields"]] if "partitionByFields" in arg else None)
    methods = {k: {"$linearFill" if v["method"] == "linear" else "$locf": f"${k}"} for k, v in arg["output"].items() if "method" in v}
    if methods:
        f = run(f, [{"$setWindowFields": {"partitionBy": by, "sortBy": arg.get("sortBy"), "output": methods}}])
    values = {k: {"$ifNull": [f"${k}", v["value"]]} for k, v in arg["output"].items() if "value" in v}
    return _add_fields(f, values) if values else f


def _redacted(s: Scope, c: Column, t: T.DataType, spec: Any) -> Column:
    """The object with its own and inner objects kept, pruned or gone into; as deep as the type goes."""
    inner = replace(s, current=(c, t), redact=True)
    said = inner.compile(spec)
    fields = []
    for f in t.fields:
        x, ft = c.getField(f.name), f.dataType
        if isinstance(ft, T.StructType):
            x = _redacted(s, x, ft, spec)
        elif isinstance(ft, T.ArrayType) and isinstance(ft.elementType, T.StructType):
            x = _redacted_array(s, x, ft.elementType, spec)
        fields.append(x.alias(f.name))
    return F.when(c.isNull() | (said == "PRUNE"), None).when(said == "KEEP", c).otherwise(F.struct(*fields))


def _redacted_array(s: Scope, c: Column, t: T.DataType, spec: Any) -> Column:
    return F.filter(F.transform(c, lambda e: _redacted(s, e, t, spec)), lambda e: e.isNotNull())


@_stage("$redact")
def _redact(f: Flow, arg: Any) -> Flow:
    """$$KEEP, $$PRUNE or $$DESCEND for the document and, going down, for each inner object and element."""
    s = f.scope()
    root = f.df.select(s.root()[0].alias("r"))
    out = root.select(_redacted(Scope(root, f.options, s.now), F.col("r"), f.df.schema, arg).alias("r"))
    return f.to(out.filter(F.col("r").isNotNull()).select("r.*"))


@_stage("$out")
def _out(f: Flow, arg: Any) -> Flow:
    """Append the documents to a path or table, and pass them on."""
    from ..sources.sinks import append

    append(f.df, arg)
    return f


def merged_target(f: Flow, target: DataFrame, arg: dict) -> DataFrame:
    """The target after $merge: documents that match on `on` are replaced, kept, merged or run through a pipeline; others are inserted or discarded."""
    on = arg.get("on", f.options.id_key)
    on = [on] if isinstance(on, str) else list(on)
    matched, new = arg.get("whenMatched", "merge"), arg.get("whenNotMatched", "insert")
    if target.groupBy(*on).count().filter("count > 1").limit(1).count():
        raise SpecError("the fields of `on` tell the target's documents apart")
    names = [*target.columns, *[c for c in f.df.columns if c not in target.columns]]
    old = target.select(F.struct(*target.columns).alias("__old"))
    docs = f.df.select(F.struct(*f.df.columns).alias("__new"))
    cond = F.lit(True)
    for k in on:
        cond = cond & F.col(f"__old.{k}").eqNullSafe(F.col(f"__new.{k}"))
    # of several documents that match one of the target the last counts; of those that match none each is inserted
    ordered, order = placed(f, [{"$last": None}])
    last = ordered.df.groupBy(*[F.col(k).alias(f"__on{i}") for i, k in enumerate(on)]).agg(extreme(Group(order), F.struct(*f.df.columns), True).alias("__new")).select("__new")
    both = old.join(last, cond, "left").unionByName(docs.join(old, cond, "left_anti"), allowMissingColumns=True)
    hit = F.col("__old").isNotNull() & F.col("__new").isNotNull()
    types = {**{c: t for c, t in f.df.dtypes}, **dict(target.dtypes)}
    side = lambda which, df, c: F.col(f"{which}.{c}").cast(types[c]) if c in df.columns else F.lit(None).cast(types[c])
    ours = {c: side("__new", f.df, c) for c in names}
    theirs = {c: side("__old", target, c) for c in names}
    if isinstance(matched, list):
        lets = {k: v for k, v in (arg.get("let") or {"new": "$$ROOT"}).items()}
        pair = both.filter(hit)
        opts = replace(f.options)
        bound = {k: follow(F.col("__new"), f.df.schema, [] if v == "$$ROOT" else v.removeprefix("$").split(".")) for k, v in lets.items()}
        flat = pair.select("__old.*", *[c.alias(f"__let_{k}") for k, (c, _) in bound.items()])
        opts.variables = dict(f.options.variables)
        staged = Flow(flat, opts)
        for stage in matched:
            ((name, spec),) = stage.items()
            s = staged.scope().bind(**{k: (F.col(f"__let_{k}"), t) for k, (_, t) in bound.items()})
            if name not in ("$addFields", "$set"):
                staged = run(staged, [stage])
            else:
                staged = staged.to(put_all(staged.df, {k: lambda c, t, v=v, s=s: s.compile(v) for k, v in spec.items()}))
        change = staged.df.drop(*[f"__let_{k}" for k in bound])
        rest = both.filter(~hit)
        rest = rest if new == "insert" else rest.filter(F.col("__old").isNotNull())
        if new == "fail" and not both.filter("__old IS NULL").isEmpty():
            raise SpecError("$merge: a document matches none")
        return change.unionByName(rest.select(*[F.when(F.col("__old").isNull(), ours[c]).otherwise(theirs[c]).alias(c) for c in names]), allowMissingColumns=True)
    if matched == "fail" and not both.filter(hit).isEmpty():
        raise SpecError("$merge: a document matches")
    if new == "fail" and not both.filter("__old IS NULL").isEmpty():
        raise SpecError("$merge: a document matches none")
    if new == "discard":
        both = both.filter(F.col("__old").isNotNull())
    pick = {"replace": lambda c: ours[c], "keepExisting": lambda c: theirs[c], "merge": lambda c: F.coalesce(ours[c], theirs[c])}.get(matched)
    if pick is None:
        pick = lambda c: theirs[c]
    return both.select(*[F.when(F.col("__new").isNull(), theirs[c]).when(F.col("__old").isNull(), ours[c]).otherwise(pick(c)).alias(c) for c in names])


@_stage("$merge")
def _merge(f: Flow, arg: dict) -> Flow:
    """Write the target with the documents merged into it, and pass them on. into: a sink with read() and write(df), or a name in the catalogue's writable tables."""
    from ..sources.sinks import target_of

    into = target_of(f.df.sparkSession, f.options.collections, arg["into"])
    into.write(merged_target(f, into.read(), arg))
    return f
