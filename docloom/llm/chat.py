"""Chat formatting by quotation linking: quoted passages are joined to the messages they come from, and conversations are put in the
order of replies, without the quotes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import once, release, stored

#: Quote marks, and blanks among them, before a line's text.
MARK = r"^[ \t>]*>"
#: What ends a sentence.
STOP = r"[.!?]+(?:\s+|\z)"


def _lines(text: Column) -> Column:
    """array of (level, body) by line: how many quote marks it has, and what follows them."""
    t = F.coalesce(text, F.lit(""))
    return F.transform(F.split(t, "\n"), lambda x: F.struct(F.char_length(F.regexp_replace(F.regexp_extract(x, MARK, 0), "[^>]", "")).alias("level"), F.regexp_replace(x, MARK, "").alias("body")))


def _marked(text: Column) -> Column:
    """Whether some line may have a quote mark; false for most texts, whose lines then needn't be looked at."""
    return text.rlike("(?m)" + MARK)


def _normal(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def _passages(messages: DataFrame) -> DataFrame:
    """conv_id, turn, level and passage, an array of its lines, of every passage: consecutive lines of one level that aren't blank."""
    kind = F.transform("lines", lambda x: F.when(F.trim(F.regexp_replace(x["body"], r"\s", " ")) == "", F.lit(-1)).otherwise(x["level"]))
    m = messages.select("conv_id", "turn", "lines", F.explode(F.array(kind)).alias("kind"))
    starts = F.filter(F.transform("kind", lambda k, i: F.struct(i.alias("i"), k.alias("k"))), lambda x: (x["i"] == 0) | (F.get(F.col("kind"), F.greatest(x["i"] - 1, F.lit(0))) != x["k"]))
    m = m.select("conv_id", "turn", "lines", F.explode(F.array(F.concat(starts, F.array(F.struct(F.size("kind").alias("i"), F.lit(-1).alias("k")))))).alias("edges"))
    runs = F.zip_with(F.slice("edges", F.lit(1), F.size("edges") - 1), F.slice("edges", F.lit(2), F.size("edges")), lambda a, z: F.struct(a["k"].alias("level"), a["i"].alias("a"), z["i"].alias("z")))
    p = m.select("conv_id", "turn", "lines", F.explode(runs).alias("r")).filter("r.level >= 0")
    return p.select("conv_id", "turn", F.col("r.level").alias("level"), F.transform(F.slice("lines", F.col("r.a") + 1, F.col("r.z") - F.col("r.a")), lambda x: x["body"]).alias("passage"))


def _said(parts: Column) -> Column:
    """The parts by their letters and digits in lower case, without those that have none."""
    return F.filter(F.transform(parts, _normal), lambda x: x != "")


def _sentences(passage: Column) -> Column:
    return once(F.array_join(passage, " "), lambda t: F.split(t, STOP))


def _links(messages: DataFrame) -> DataFrame:
    """conv_id, turn, n_quotes, n_linked and parent_turn (null: none) of every message with quotes."""
    lined = lambda m: m.withColumn("lines", F.explode(F.array(_lines(F.col("text")))))
    quotes = _passages(lined(messages.filter(_marked(F.col("text"))))).filter("level > 0")
    quotes = quotes.select("conv_id", "turn", "level", "passage", _normal(F.array_join("passage", " ")).alias("whole")).filter("whole <> ''")
    quotes = stored(quotes.withColumn("quote", F.monotonically_increasing_id()), "quotes")
    # conversations without quotes go no further
    own = _passages(lined(messages.join(quotes.select("conv_id").distinct(), "conv_id", "left_semi"))).filter("level = 0")
    units = lambda q: F.array_distinct(F.concat(_said(F.array(F.array_join(q, " "))), _said(q), _said(_sentences(q))))
    first = own.select("conv_id", "turn", F.explode(units(F.col("passage"))).alias("unit")).groupBy("conv_id", F.xxhash64("unit").alias("h")).agg(F.min("turn").alias("origin"))
    parts = F.concat(F.array(F.struct(F.lit(True).alias("all"), F.col("whole").alias("unit"))), F.transform(_said(_sentences(F.col("passage"))), lambda u: F.struct(F.lit(False).alias("all"), u.alias("unit"))))
    asked = quotes.select("conv_id", "turn", "quote", F.explode(parts).alias("u")).select("conv_id", "turn", "quote", "u.all", F.xxhash64("u.unit").alias("h"), F.when(F.col("u.all"), 0).otherwise(F.char_length("u.unit")).cast("long").alias("n"))
    hits = asked.join(first, ["conv_id", "h"]).filter("origin < turn")
    held = hits.groupBy("quote", "origin").agg(F.max("all").alias("all"), F.sum("n").alias("held"))
    best = held.groupBy("quote").agg(F.max(F.struct("all", "held", (-F.col("origin")).alias("early"))).alias("best"))
    length = asked.groupBy("quote").agg(F.sum("n").alias("length"))
    found = best.join(length, "quote").filter("best.all OR 2 * best.held >= length").select("quote", (-F.col("best.early")).alias("origin"))
    each = quotes.select("conv_id", "turn", "level", "quote").join(found, "quote", "left")
    near = F.min(F.when(F.col("origin").isNotNull(), F.struct(F.col("level").alias("level"), (-F.col("origin")).alias("late"))))
    return each.groupBy("conv_id", "turn").agg(F.count(F.lit(1)).alias("n_quotes"), F.count("origin").alias("n_linked"), (-near["late"]).alias("parent_turn"))


def _siblings(parents: DataFrame) -> DataFrame:
    """parents with next, the turn of the next reply to the same message (null: none).

    Rows are dealt by ranges of (conv_id, parent_turn, turn) and each is held against the one after it, the last of a range against
    the first of the next range that has rows: a message with any number of replies is spread over tasks.
    """
    dealt = stored(parents.repartitionByRange("conv_id", "parent_turn", "turn").withColumn("part", F.spark_partition_id()), "siblings")
    row = F.struct("conv_id", "parent_turn", "turn")
    heads = dealt.groupBy("part").agg(F.min(row).alias("head"))
    after = heads.select("part", F.lead("head").over(Window.orderBy("part")).alias("after"))  # as many rows as tasks
    one = dealt.select("*", F.lead(row).over(Window.partitionBy("part").orderBy("conv_id", "parent_turn", "turn")).alias("then")).join(F.broadcast(after), "part")
    then = F.coalesce("then", "after")
    same = (then["conv_id"] == F.col("conv_id")) & (then["parent_turn"] == F.col("parent_turn"))
    return one.select("conv_id", "turn", "parent_turn", F.when(same, then["turn"]).alias("next"))


def _places(parents: DataFrame) -> DataFrame:
    """conv_id, turn, depth, root_turn and reply_pos (its place in the thread, the first message 0) of every message of a thread.

    parents: conv_id, turn and parent_turn, an earlier one. A thread is walked around: down into each message, through its replies
    in order, and up again. The steps form a list, and pointer doubling gives each step what lies before it, in as many rounds as
    the logarithm of the longest walk, each over one row a step: no row holds a path.
    """
    links = stored(_siblings(parents), "threads")
    roots = links.select("conv_id", F.col("parent_turn").alias("turn")).distinct().join(links.select("conv_id", "turn"), ["conv_id", "turn"], "left_anti")
    children = links.groupBy("conv_id", F.col("parent_turn").alias("turn")).agg(F.min("turn").alias("child"))
    node = links.select("conv_id", "turn", "parent_turn", "next").unionByName(roots, allowMissingColumns=True).join(children, ["conv_id", "turn"], "left")
    # a step is (turn, up): down into a message or up from it; it points to the step before it (to, to_up)
    step = lambda turn, up, to, to_up: F.struct(turn.alias("turn"), F.lit(up).alias("up"), to.alias("to"), F.lit(to_up).alias("to_up"))
    t, child, nxt, parent = F.col("turn"), F.col("child"), F.col("next"), F.col("parent_turn")
    steps = F.filter(
        F.array(
            F.when(child.isNotNull(), step(child, False, t, False)).otherwise(step(t, True, t, False)),
            F.when(nxt.isNotNull(), step(nxt, False, t, True)).when(parent.isNotNull(), step(parent, True, t, True)),
        ),
        lambda s: s.isNotNull(),
    )
    first = roots.select("conv_id", "turn", F.lit(False).alias("up"), F.lit(None).cast("long").alias("to"), F.lit(None).cast("boolean").alias("to_up"))
    e = node.select("conv_id", F.explode(steps).alias("s")).select("conv_id", "s.*").unionByName(first)
    # pos: messages entered before the step, its own not counted; depth: those entered less those left; last: the list's first step seen so far
    e = stored(e.select("*", F.when(F.col("to").isNull(), 0).otherwise((~F.col("to_up")).cast("int")).cast("long").alias("pos"), F.when(F.col("to").isNull(), 0).when(F.col("to_up"), -1).otherwise(1).cast("long").alias("depth"), F.coalesce("to", "turn").alias("root_turn")), "walk")
    while not e.filter("to IS NOT NULL").isEmpty():
        above = e.select("conv_id", F.col("turn").alias("to"), F.col("up").alias("to_up"), F.col("to").alias("to2"), F.col("to_up").alias("to_up2"), F.col("pos").alias("pos2"), F.col("depth").alias("depth2"), F.col("root_turn").alias("root2"))
        done = e.filter("to IS NULL")
        joined = e.filter("to IS NOT NULL").join(above, ["conv_id", "to", "to_up"])
        more = joined.select("conv_id", "turn", "up", F.col("to2").alias("to"), F.col("to_up2").alias("to_up"), (F.col("pos") + F.col("pos2")).alias("pos"), (F.col("depth") + F.col("depth2")).alias("depth"), F.col("root2").alias("root_turn"))
        now = stored(done.unionByName(more), "walk")
        release(e)
        e = now
    return e.filter(~F.col("up")).select("conv_id", "turn", "depth", "root_turn", F.col("pos").alias("reply_pos"))


def link_quotations(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, turn, role, text (without quotes), n_quotes, n_linked, parent_turn, depth, root_turn and reply_pos of every row.

    What is quoted, at whatever level, is looked up as a whole passage and by its sentences, among whole passages, lines and
    sentences of the conversation; each comes from the earliest turn that says it itself. A quote comes from the earlier turn that
    says all of it, or else the one where most of its sentences come from, by length and at least half of it: so it may be part of
    a passage, wrapped anew, or leave out sentences (a part of a sentence finds no origin). Among equals it is the earliest. The
    parent of a message is the latest turn among the origins of its least nested linked quotes. Sorted by root_turn and reply_pos,
    a conversation has each reply below what it replies to, replies to one message in the order of turns, and threads by their
    first turn.

    Rows with equal conv_id and turn are one place of the tree and all stay. Null texts are empty. A null conv_id or turn is linked
    to nothing. A text without quotes stays as it is. Other columns are ignored; an empty table gives an empty result.
    """
    names = {conv_col: "conv_id", turn_col: "turn", role_col: "role", text_col: "text"}
    m = conversations.select(*[F.col(a).alias(b) for a, b in names.items()])
    m = m.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", F.coalesce("text", F.lit("")).alias("text"))
    links = stored(_links(m), "quotations")
    places = _places(links.filter("parent_turn IS NOT NULL").select("conv_id", "turn", "parent_turn"))
    out = m.join(links, ["conv_id", "turn"], "left").join(places, ["conv_id", "turn"], "left")
    own = lambda x: F.trim(F.regexp_replace(F.regexp_replace(F.array_join(F.transform(F.filter(x, lambda y: y["level"] == 0), lambda y: y["body"]), "\n"), r"\n\s*\n\s*\n", "\n\n"), r"^\s+|\s+$", ""))
    text = F.col("text")
    plain = F.when(_marked(text), once(_lines(text), lambda x: F.when(F.exists(x, lambda y: y["level"] > 0), own(x)).otherwise(text))).otherwise(text)
    n = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return out.select("conv_id", "turn", "role", plain.alias("text"), n("n_quotes"), n("n_linked"), "parent_turn", n("depth"), F.coalesce("root_turn", "turn").alias("root_turn"), n("reply_pos"))


def threads(linked: DataFrame, part_size: int = 1000) -> DataFrame:
    """conv_id, root_turn, part and messages (an array of reply_pos, turn, role and text, in reply order) of every thread; linked: as from link_quotations().

    A thread of more than part_size places comes in several parts, numbered from 0, so that no array grows with a thread; nothing
    is left out. Rows at one place follow each other by role and text.
    """
    at = linked.withColumn("part", F.floor(F.col("reply_pos") / part_size))
    return at.groupBy("conv_id", "root_turn", "part").agg(F.sort_array(F.collect_list(F.struct("reply_pos", "turn", "role", "text"))).alias("messages"))


CHAT_SQL = r"""
WITH RECURSIVE l AS (SELECT conv_id, turn, role, rid, i, regexp_replace(x, '^[ \t>]*>', '') AS body, length(regexp_replace(regexp_extract(x, '^[ \t>]*>'), '[^>]', '', 'g')) AS level
  FROM (SELECT conv_id, turn, role, rid, unnest(ls) AS x, generate_subscripts(ls, 1) AS i FROM (SELECT *, row_number() OVER () AS rid, string_split(coalesce(text, ''), chr(10)) AS ls FROM conversations))),
k AS (SELECT *, CASE WHEN trim(regexp_replace(body, '\s', ' ', 'g')) = '' THEN -1 ELSE level END AS kind FROM l),
e AS (SELECT *, CASE WHEN kind IS DISTINCT FROM lag(kind) OVER (PARTITION BY rid ORDER BY i) THEN 1 ELSE 0 END AS edge FROM k),
r AS (SELECT *, sum(edge) OVER (PARTITION BY rid ORDER BY i) AS run FROM e),
p AS (SELECT conv_id, turn, kind AS level, rid, run, list(body ORDER BY i) AS ls, string_agg(body, ' ' ORDER BY i) AS body FROM r WHERE kind >= 0 GROUP BY ALL),
s AS (SELECT conv_id, turn, level, rid, run, unnest(string_split_regex(body, '[.!?]+(?:\s+|\z)')) AS x, 'part' AS what FROM p UNION ALL SELECT conv_id, turn, level, rid, run, body, 'whole' FROM p
  UNION ALL SELECT conv_id, turn, level, rid, run, unnest(ls), 'line' FROM p WHERE level = 0),
u AS (SELECT conv_id, turn, level, rid, run, what, trim(regexp_replace(lower(x), '[^\p{L}\p{N}]+', ' ', 'g')) AS said FROM s),
f AS (SELECT conv_id, min(turn) AS origin, said FROM u WHERE level = 0 AND said <> '' GROUP BY ALL),
q AS (SELECT *, sum(CASE WHEN what = 'part' THEN length(said) ELSE 0 END) OVER (PARTITION BY rid, run) AS total FROM u WHERE level > 0 AND said <> ''),
h AS (SELECT q.rid, q.run, q.total, f.origin, bool_or(what = 'whole') AS whole, sum(CASE WHEN what = 'part' THEN length(q.said) ELSE 0 END) AS held FROM q JOIN f ON f.conv_id = q.conv_id AND f.said = q.said AND f.origin < q.turn GROUP BY ALL),
b AS (SELECT rid, run, total, origin, whole, held FROM (SELECT *, row_number() OVER (PARTITION BY rid, run ORDER BY whole DESC, held DESC, origin) AS n FROM h) WHERE n = 1 AND (whole OR 2 * held >= total)),
g AS (SELECT DISTINCT q.conv_id, q.turn, q.level, q.rid, q.run, b.origin FROM q LEFT JOIN b ON b.rid = q.rid AND b.run = q.run WHERE q.what = 'whole'),
n AS (SELECT conv_id, turn, count(*) AS n_quotes, count(origin) AS n_linked, -(min({'level': level, 'late': -origin}) FILTER (WHERE origin IS NOT NULL)).late AS parent_turn FROM g GROUP BY ALL),
t AS (SELECT DISTINCT c.conv_id, c.turn, n.parent_turn FROM conversations c LEFT JOIN n ON n.conv_id = c.conv_id AND n.turn = c.turn),
w AS (SELECT conv_id, turn, [turn] AS path FROM t WHERE parent_turn IS NULL UNION ALL SELECT t.conv_id, t.turn, list_append(w.path, t.turn) FROM t JOIN w ON w.conv_id = t.conv_id AND w.turn = t.parent_turn),
o AS (SELECT conv_id, turn, path, row_number() OVER (PARTITION BY conv_id, path[1] ORDER BY path) - 1 AS reply_pos FROM w),
c AS (SELECT conv_id, turn, role, coalesce(text, '') AS text, row_number() OVER () AS rid FROM conversations),
x AS (SELECT rid, max(level) AS deepest, regexp_replace(regexp_replace(string_agg(body, chr(10) ORDER BY i) FILTER (WHERE level = 0), '\n\s*\n\s*\n', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g') AS plain FROM l GROUP BY rid)
SELECT c.conv_id, c.turn::BIGINT AS turn, c.role, CASE WHEN x.deepest > 0 THEN coalesce(x.plain, '') ELSE c.text END AS text, coalesce(n.n_quotes, 0)::BIGINT AS n_quotes, coalesce(n.n_linked, 0)::BIGINT AS n_linked,
  n.parent_turn::BIGINT AS parent_turn, coalesce(len(o.path) - 1, 0)::BIGINT AS depth, coalesce(o.path[1], c.turn)::BIGINT AS root_turn, coalesce(o.reply_pos, 0)::BIGINT AS reply_pos
FROM c JOIN x ON x.rid = c.rid LEFT JOIN n ON n.conv_id = c.conv_id AND n.turn = c.turn LEFT JOIN o ON o.conv_id = c.conv_id AND o.turn = c.turn
"""
