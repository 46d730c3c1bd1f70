"""Benchmark decontamination by template canonicalisation: numbers, names and units become typed slots, windows of the resulting
templates are hash-joined, and the slots of matching windows must correspond one to one."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, once, stored

#: Typed placeholders, one character each, and what joins the words of a name.
NUMBER, NAME, UNIT, JOIN = "\ue000", "\ue001", "\ue002", "\ue003"
#: Units of measure and money that follow a number.
UNITS = (
    "mm cm m km in inch inches ft feet yd yard yards mile miles meter meters metre metres kilometer kilometers kilometre kilometres mg g kg gram grams "
    "kilogram kilograms t ton tons tonne tonnes oz ounce ounces lb lbs pound pounds ml cl l liter liters litre litres gallon gallons s sec second seconds min minute minutes "
    "h hr hour hours day days week weeks month months year years percent dollar dollars euro euros cent cents degree degrees watt watts volt volts"
).split()
#: Numbers in words, and those that are written as two.
_TENS = "twenty thirty forty fifty sixty seventy eighty ninety".split()
NUMBER_WORDS = "two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen hundred thousand million dozen".split() + _TENS
NUMBER_WORDS += [a + b for a in _TENS for b in ["one", *NUMBER_WORDS[:8]]]
#: The two readings of a text: names are slots, or words like others (so that copies in other letter case are found).
NAMED, PLAIN = 0, 1
#: Rows that may be broadcast: at 8 to 16 bytes each these are a few tens of MB.
SMALL = 1_000_000


def _raw(text: Column, reading: int) -> Column:
    """The text, with the words of a name of several words joined to one; every other white-space character stays where it is."""
    t = F.coalesce(text, F.lit(""))
    return F.regexp_replace(t, r"(\p{Lu}(?<![^ \t-\r\p{P}]\p{Lu})[\p{L}'’-]*+)[ \t-\r](?=\p{Lu})", "$1" + JOIN) if reading == NAMED else t


def _canonical(raw: Column, reading: int) -> Column:
    """raw in lower case and without signs, names as slots.

    A name is a run of words with a capital, whatever its place in a sentence (other words at the start of a sentence are slots as
    well, in items and documents alike). Patterns start with the character that is rare and never step back.
    """
    t = F.regexp_replace(raw, rf"\p{{Lu}}(?<![^ \t-\r\p{{P}}]\p{{Lu}})[\p{{L}}{JOIN}'’-]*+(?![^ \t-\r\p{{P}}])", NAME) if reading == NAMED else raw
    return F.regexp_replace(F.lower(t), rf"[^\p{{L}}\p{{N}}{NUMBER}-{UNIT} \t-\r]", "")


def _typed(words: Column) -> Column:
    """The words with slots for numbers (words with a digit, and NUMBER_WORDS) and for UNITS after a number."""
    numbers = F.transform(words, lambda w: F.when(w.isin(*NUMBER_WORDS) | w.rlike(r"\d"), F.lit(NUMBER)).otherwise(w))
    before = lambda n: F.concat(F.array(F.lit("")), F.slice(n, F.lit(1), F.size(n) - 1))
    units = lambda n: F.zip_with(n, before(n), lambda w, b: F.when((b == NUMBER) & w.isin(*UNITS), F.lit(UNIT)).otherwise(w))
    return once(numbers, lambda n: F.when(F.array_contains(n, F.lit(NUMBER)), units(n)).otherwise(n))


def _is_slot(word: Column) -> Column:
    return word.rlike(f"[{NUMBER}-{UNIT}]")


def _template(text: Column, reading: int) -> Column:
    """Hashes of the template's words."""
    words = F.filter(F.split(_canonical(_raw(text, reading), reading), SPACE + "+"), lambda w: w != "")
    return F.transform(_typed(words), lambda w: F.xxhash64(w))


def _pairs(text: Column, reading: int) -> Column:
    """array of (word, filler): the template's words; beside a slot what fills it (of a name of several words the last, as the first may be a sentence's first word), in lower case and without signs at its ends."""
    raw = _raw(text, reading)
    filler = lambda b: F.regexp_replace(F.lower(F.substring_index(b, JOIN, -1)), r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")
    both = F.filter(F.zip_with(F.split(_canonical(raw, reading), SPACE), F.split(raw, SPACE), lambda a, b: F.struct(a.alias("word"), b.alias("raw"))), lambda p: p["word"] != "")
    return once(both, lambda x: F.zip_with(_typed(F.transform(x, lambda p: p["word"])), x, lambda w, p: F.struct(w.alias("word"), F.when(_is_slot(w), filler(p["raw"])).alias("filler"))))


def _readings(df: DataFrame, name: str, of) -> DataFrame:
    """df once for each reading, with the columns reading and, by this name, what of makes of the text; both come from one scan."""
    both = F.array(*[F.struct(F.lit(r).alias("reading"), of(F.col("text"), r).alias(name)) for r in (NAMED, PLAIN)])
    kept = [c for c in df.columns if c != "text"]
    return df.select(*kept, F.explode(both).alias("read")).select(*kept, "read.*")


def _windows(df: DataFrame, keep: list[str], words: str, sizes: list[int]) -> DataFrame:
    """keep, pos, size and w, a hash, of each run of words (hashes of words), for each of the sizes; df holds the column reading.

    The words of a run come side by side out of shifted arrays, so that they are hashed in generated code; every size comes out of
    the same rows.
    """
    n = F.size(words)
    shifted = [F.slice(words, F.lit(j + 1), n).alias(f"w{j}") for j in range(max(sizes))]
    runs = df.select(*keep, "reading", F.posexplode(F.arrays_zip(*shifted)).alias("pos", "z"))
    hashed = lambda s: F.xxhash64(F.lit(s), "reading", *[F.col(f"z.w{j}") for j in range(s)])
    if len(sizes) == 1:
        return runs.filter(F.col(f"z.w{sizes[0] - 1}").isNotNull()).select(*keep, "pos", F.lit(sizes[0]).alias("size"), hashed(sizes[0]).alias("w"))
    every = F.array(*[F.when(F.col(f"z.w{s - 1}").isNotNull(), F.struct(F.lit(s).alias("size"), hashed(s).alias("w"))) for s in sizes])
    return runs.select(*keep, "pos", F.explode(every).alias("x")).filter("x IS NOT NULL").select(*keep, "pos", "x.size", "x.w")


def _fits(df: DataFrame) -> DataFrame:
    """df, to be broadcast if it is known to be small."""
    return F.broadcast(df) if df.count() <= SMALL else df


def _items(benchmark: DataFrame, id_col: str, text_col: str, size: int) -> tuple[DataFrame, DataFrame]:
    """Windows (item, item_id, reading, size, windows, ipos, w) and slots (item, pos, kind, filler) of the benchmark in both readings, each an item of its own; an item of fewer words is one window."""
    items = benchmark.select(F.col(id_col).cast("long").alias("item_id"), F.col(text_col).alias("text")).dropDuplicates()
    items = _readings(items.withColumn("key", F.xxhash64("item_id", "text")), "pairs", _pairs).filter(F.size("pairs") > 0)
    words = F.transform("pairs", lambda p: F.xxhash64(p["word"]))
    items = items.select(F.xxhash64("key", "reading").alias("item"), "key", "item_id", "reading", "pairs", words.alias("words"), F.least(F.size("pairs"), F.lit(size)).alias("own"))
    items = stored(items.withColumn("windows", F.size("words") - F.col("own") + 1), "items")
    windows = _windows(items, ["item", "key", "item_id", "own", "windows"], "words", list(range(1, size + 1))).filter("size = own").drop("own").withColumnRenamed("pos", "ipos")
    windows = windows.join(items.select("item", "reading"), "item")
    slots = items.select("item", F.posexplode("pairs").alias("pos", "p")).filter(_is_slot(F.col("p.word")))
    return stored(windows, "item-windows"), slots.select("item", "pos", F.col("p.word").alias("kind"), F.col("p.filler").alias("filler"))


def benchmark_matches(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", size: int = 5, share: float = 0.5, agreement: float = 0.8) -> DataFrame:
    """row, doc_id, item_id, n_windows, n_matched, n_slots, n_changed of each document and benchmark item that it contains.

    Contained is an item if one stretch of the document holds at least `share` of its windows (of `size` template words) and the
    slots there correspond: fillers of the item and of the document stand for each other one to one, in at least `agreement` of
    the slots, over all alignments in the stretch (an insertion shifts the alignment). n_changed counts slots with another filler
    than the item's: 0 for a copy, more for a question with new parameters. An item of fewer than `size` words says too little
    without its fillers: it is found only unchanged.

    Items and texts are read twice, once with every run of words with a capital as a name, once without names (numbers and units
    alone), so that copies in other letter case are found; the reading with more windows gives the figures, the first among equals.

    Null and empty texts contain and match nothing. Rows are told apart by row, a hash of id and text; repeated rows count once;
    items with equal ids and other texts are items of their own with one row each; a null id stays null. Empty tables give an empty
    result; other columns are ignored.
    """
    windows, item_slots = _items(benchmark, item_col, item_text_col, size)
    sizes = sorted(r[0] for r in windows.select("size").distinct().collect()) or [size]  # at most `size` values
    base = docs.select(F.xxhash64(F.col(id_col), F.col(text_col)).alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).filter(F.col("text").isNotNull())
    found = _windows(_readings(base.select("row", "text"), "words", _template), ["row"], "words", sizes)
    found = found.select("row", "w").join(_fits(windows.select("item", "windows", "w").distinct()), "w").distinct()
    pairs = stored(_candidates(found, windows, share), "window-pairs")

    held = _readings(base.join(_fits(pairs.select("row").distinct()), "row").dropDuplicates(["row"]), "pairs", _pairs)
    slots = F.filter(F.transform("pairs", lambda p, i: F.struct(i.alias("dpos"), p["word"].alias("kind"), p["filler"].alias("now"))), lambda p: p["now"].isNotNull())
    held = stored(held.select("row", "doc_id", "reading", F.transform("pairs", lambda p: F.xxhash64(p["word"])).alias("words"), slots.alias("slots")), "candidates")
    at = _windows(held, ["row"], "words", sizes).select("row", F.col("pos").alias("dpos"), "w")
    match = at.join(pairs, "row").join(windows.select("item", "w", "ipos", "size", "windows"), ["item", "w"])
    match = match.select("row", "item", "ipos", "size", "windows", (F.col("dpos") - F.col("ipos")).alias("shift"))
    match = stored(_stretches(match), "window-matches")

    of = ["row", "item", "stretch"]
    doc_slots = held.select("row", "reading", F.explode("slots").alias("p")).select("row", "reading", "p.*")
    reading = windows.select("item", "reading", "key", "item_id").distinct()
    covered = match.select(*of, "shift", F.explode(F.sequence(F.col("ipos"), F.col("ipos") + F.col("size") - 1)).alias("pos")).distinct()
    filled = covered.join(item_slots, ["item", "pos"]).join(reading.select("item", "reading"), "item").withColumn("dpos", F.col("pos") + F.col("shift")).join(doc_slots, ["row", "reading", "dpos", "kind"])
    said = stored(filled.groupBy(*of, "kind", "filler", "now").agg(F.countDistinct("pos").alias("n")), "fillers")
    forth = said.groupBy(*of, "kind", "filler").agg(F.max(F.struct("n", "now")).alias("most")).select(*of, "kind", "filler", F.col("most.now").alias("now"))
    back = said.groupBy(*of, "kind", "now").agg(F.max(F.struct("n", "filler")).alias("most")).select(*of, "kind", F.col("most.filler").alias("filler"), "now")
    one = said.join(forth, [*of, "kind", "filler", "now"]).join(back, [*of, "kind", "filler", "now"]).groupBy(*of).agg(F.sum("n").alias("agree"))
    every = said.groupBy(*of).agg(F.sum("n").alias("slots"), F.sum(F.when(F.col("now") != F.col("filler"), F.col("n")).otherwise(0)).alias("changed"))
    total = match.groupBy(*of).agg(F.countDistinct("ipos").alias("matched"), F.first("windows").alias("windows"), F.first("size").alias("size"))
    total = total.join(every, of, "left").join(one, of, "left").na.fill(0, ["slots", "changed", "agree"])
    good = total.filter((F.col("matched") >= share * F.col("windows")) & (F.col("agree") >= agreement * F.col("slots")) & ((F.col("size") >= size) | (F.col("changed") == 0)))
    figures = F.struct("matched", (-F.col("changed")).alias("same"), (-F.col("reading")).alias("first"), "windows", "slots", "changed")
    best = good.join(reading, "item").groupBy("row", "key").agg(F.max(figures).alias("b"), F.first("item_id").alias("item_id"))
    ids = held.filter(F.col("reading") == NAMED).select("row", "doc_id")
    n = lambda c, name: F.col(f"b.{c}").cast("long").alias(name)
    return best.join(ids, "row").select("row", "doc_id", "item_id", n("windows", "n_windows"), n("matched", "n_matched"), n("slots", "n_slots"), n("changed", "n_changed"))


def _stretches(match: DataFrame) -> DataFrame:
    """match with stretch, a number for the place in the document: shifts that lie less than the item's windows apart are one stretch.

    A window of the item that occurs several times in a stretch stays at the shift that most windows have.
    """
    counted = match.groupBy("row", "item", "shift").agg(F.count(F.lit(1)).alias("n"), F.first("windows").alias("windows"))
    along = Window.partitionBy("row", "item").orderBy("shift")
    counted = counted.withColumn("new", (F.col("shift") - F.lag("shift").over(along) >= F.col("windows")).cast("int"))
    counted = counted.withColumn("stretch", F.coalesce(F.sum("new").over(along), F.lit(0))).select("row", "item", "shift", "stretch", "n")
    one = match.join(counted, ["row", "item", "shift"]).groupBy("row", "item", "stretch", "ipos", "size", "windows").agg(F.max(F.struct("n", (-F.col("shift")).alias("back"))).alias("best"))
    return one.select("row", "item", "stretch", "ipos", "size", "windows", (-F.col("best.back")).alias("shift"))


def _candidates(found: DataFrame, windows: DataFrame, share: float) -> DataFrame:
    """row and item of the documents that hold enough different windows of an item; found: row, item, windows and w, distinct."""
    needed = windows.groupBy("item").agg(F.countDistinct("w").alias("different"))
    counted = found.groupBy("row", "item").agg(F.count(F.lit(1)).alias("n"))
    # of `windows` places at least share hold found windows; the other places may all hold one and the same window
    return counted.join(needed.join(windows.select("item", "windows").distinct(), "item"), "item").filter(F.col("n") >= F.col("different") - (1 - share) * F.col("windows")).select("row", "item")


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of docs that contain no benchmark item, columns as they are, whatever their names; options as for benchmark_matches()."""
    bad = stored(benchmark_matches(docs, benchmark, id_col, text_col, **options).select("row").distinct(), "contaminated")
    given = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("given"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("row"))
    return given.join(_fits(bad), "row", "left_anti").select(*[F.col("given")[c].alias(c) for c in docs.columns])
