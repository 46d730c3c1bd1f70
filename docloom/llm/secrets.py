"""Secret scans: fixed patterns, and a battery of randomness tests under length-aware control of false discoveries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import once, scan, stored

#: The fixed patterns and their least lengths, in the order in which kinds are listed.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = "AKIA[A-Z0-9]{14,}"
HEX = "[0-9a-f]{16,}"
KINDS = ("assign", "access", "hex", "random")
RANDOM = 3

#: What may be a random key: a run of characters that encodings use. '=' is padding at its end only, so that the value of name=value is a run of its own.
CANDIDATE = "[A-Za-z0-9+/_-]{20,}={0,2}"
#: Encodings, the narrowest that holds all of a candidate's characters is taken: name, alphabet in code order.
LOWER, UPPER, DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
ENCODINGS = (("hex", DIGITS + "abcdef"), ("HEX", DIGITS + "ABCDEF"), ("base32", UPPER + "234567"), ("lower", LOWER), ("upper36", DIGITS + UPPER), ("lower36", DIGITS + LOWER), ("letters", UPPER + LOWER), ("alnum", UPPER + LOWER + DIGITS), ("base64", UPPER + LOWER + DIGITS + "+/_-"))
#: The chance that two characters of ordinary text in an encoding are the same: letters of one case; letters of both with digits and signs,
#: as in names of programs and paths; of A to F, which make up 8, 1.5, 3, 4, 13 and 2 in 100 letters of prose.
COLLISIONS = {"HEX": 0.26, "letters": 0.053, "alnum": 0.053, "base64": 0.053}
PROSE_COLLISION = 0.07
#: A run is not a random key if the three tests together give so small a chance to a random one.
GATE = 0.001
#: Lengths from which a stratum starts. False discoveries are controlled in each, so that many short candidates don't hide a long key.
STRATA = (20, 24, 32, 48, 64, 128)
#: p-values are counted by steps of a tenth of -log10(p).
BINS = 400

_PLACE = "struct<start:bigint,end:bigint,bstart:bigint,bend:bigint>"


def _matches(text: Column, pattern: str) -> Column:
    """array of the pattern's leftmost non-overlapping matches with their places; value: the pattern's group, if it has one.

    split() gives what lies between the matches and regexp_extract_all() the matches, so the running sum of their lengths is each place.
    """
    has = "(" in pattern.replace("(?", "")
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(1)) if has else found
    gaps = F.split(text, pattern, -1)
    parts = F.zip_with(F.arrays_zip(found.alias("found"), value.alias("value")), F.slice(gaps, F.lit(1), F.greatest(F.size(gaps) - 1, F.lit(0))), lambda m, g: F.struct(g.alias("gap"), m["found"].alias("found"), m["value"].alias("value")))

    def place(at: Column, m: Column) -> tuple[Column, Column]:
        n = lambda f, x: f(m[x]).cast("long")
        start, bstart = at["c"] + n(F.char_length, "gap"), at["b"] + n(F.octet_length, "gap")
        end, bend = start + n(F.char_length, "found"), bstart + n(F.octet_length, "found")
        return F.struct(end.alias("c"), bend.alias("b")), F.struct(start.alias("start"), end.alias("end"), bstart.alias("bstart"), bend.alias("bend"))

    zero = F.struct(F.lit(0).cast("long").alias("c"), F.lit(0).cast("long").alias("b"))
    add = lambda s, e: F.struct((s["c"] + e["c"]).alias("c"), (s["b"] + e["b"]).alias("b"))
    both = lambda a, m: F.struct(*[a[c].alias(c) for c in ("start", "end", "bstart", "bend")], m["found"].alias("found"), m["value"].alias("value"))
    return F.when(text.rlike(pattern), once(parts, lambda p: F.zip_with(scan(p, zero, place, add, _PLACE), p, both))).otherwise(F.expr(f"cast(array() as array<{_PLACE[:-1]},found:string,value:string>>)"))


def _erfc(x: Column) -> Column:
    """The complementary error function by a Chebyshev fit, right to 1.2e-7 of its value in both tails."""
    fit = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)

    def value(z: Column) -> Column:
        def poly(t: Column) -> Column:
            out = F.lit(fit[-1])
            for c in reversed(fit[:-1]):
                out = t * out + c
            return t * F.exp(out - z * z)

        return once(1 / (1 + z / 2), poly)

    return once(x, lambda v: once(value(F.abs(v)), lambda e: F.when(v < 0, 2 - e).otherwise(e)))


def _upper(z: Column) -> Column:
    """The chance of a standard normal value above z."""
    return _erfc(z / 2**0.5) / 2


def _fisher(ps: list[Column]) -> Column:
    """Three p-values as one, by Fisher's method: the tail of chi-squared with six degrees of freedom."""
    half = -sum((F.log(F.greatest(p, F.lit(1e-300))) for p in ps), F.lit(0.0))
    return once(half, lambda x: F.exp(-x) * (1 + x + x * x / 2))


def _battery(token: Column) -> Column:
    """p: the chance that ordinary text gives so even a count of characters; null where the tests together speak against a random key.

    Against a random key speak chi-squared of the counts against the uniform alphabet (by Wilson and Hilferty's cube root), the
    number of runs above and below the alphabet's middle, and the serial correlation of neighbours; Fisher's method makes one of
    the three. What is then left to decide, random key or ordinary text, p decides under control of false discoveries.
    """
    core = F.rtrim(token, F.lit("="))
    encoding, alphabet, collision = F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit(PROSE_COLLISION)
    for name, chars in reversed(ENCODINGS):
        fits = F.translate(core, chars, "") == ""
        encoding, alphabet = F.when(fits, F.lit(name)).otherwise(encoding), F.when(fits, F.lit(chars)).otherwise(alphabet)
    rate = lambda e: F.coalesce(*[F.when(e == name, F.lit(r)) for name, r in COLLISIONS.items()], F.lit(PROSE_COLLISION))

    def tests(x: Column) -> Column:
        n, k = x["n"], x["k"]
        chars = F.filter(F.split(x["core"], ""), lambda c: c != "")
        square = F.aggregate(F.array_distinct(chars), F.lit(0.0), lambda s, c: s + F.pow(n - F.char_length(F.replace(x["core"], c, F.lit(""))), F.lit(2.0)))
        codes = F.transform(chars, lambda c: F.instr(x["alphabet"], c).cast("double") - (k + 1) / 2)
        pairs = lambda c: F.zip_with(F.slice(c, F.lit(1), F.size(c) - 1), F.slice(c, F.lit(2), F.size(c)), lambda a, b: F.struct(a.alias("a"), b.alias("b")))

        def of(c: Column) -> Column:
            high = F.aggregate(c, F.lit(0.0), lambda s, v: s + (v > 0).cast("double"))
            turns = F.aggregate(pairs(c), F.lit(1.0), lambda s, p: s + ((p["a"] > 0) != (p["b"] > 0)).cast("double"))
            power = F.aggregate(c, F.lit(0.0), lambda s, v: s + v * v)
            product = F.aggregate(pairs(c), F.lit(0.0), lambda s, p: s + p["a"] * p["b"])
            return F.struct((k / n * square - n).alias("chi"), (2 * high * (n - high) / n + 1).alias("mean"), turns.alias("turns"), (product / F.greatest(power, F.lit(1e-9)) * F.sqrt(n)).alias("serial"))

        def chances(v: Column) -> Column:
            df = k - 1
            even = (F.pow(F.greatest(v["chi"], F.lit(1e-9)) / df, F.lit(1 / 3)) - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df))
            runs = (v["turns"] - v["mean"]) / F.sqrt(F.greatest((v["mean"] - 1) * (v["mean"] - 2) / (n - 1), F.lit(0.25)))
            prose = (v["chi"] - df - (n - 1) * (k * x["collision"] - 1)) / F.sqrt(2 * df + 4 * (n - 1) * k * x["collision"])
            random = _fisher([_upper(even), 2 * _upper(F.abs(runs)), 2 * _upper(F.abs(v["serial"]))])
            return F.when(random >= GATE, F.greatest(_upper(-prose), F.lit(1e-300)))

        return once(F.transform(F.array(codes), of)[0], chances)

    given = F.struct(core.alias("core"), encoding.alias("encoding"), alphabet.alias("alphabet"))
    sized = lambda x: F.struct(x["core"].alias("core"), x["alphabet"].alias("alphabet"), F.char_length(x["core"]).cast("double").alias("n"), F.char_length(x["alphabet"]).cast("double").alias("k"), rate(x["encoding"]).alias("collision"))
    return once(given, lambda x: F.when(x["alphabet"].isNotNull() & (F.char_length(x["core"]) >= STRATA[0]), once(sized(x), tests)))


def _untouched(spans: Column) -> Column:
    """The spans, sorted, without the random runs that overlap a fixed one: those before which one ends later, or after which one starts earlier, than allowed."""
    far = F.lit(1 << 62).cast("long")
    fixed = lambda s, then, otherwise: F.when(s["kind"] < RANDOM, then).otherwise(otherwise)
    before = lambda x: scan(x, F.lit(0).cast("long"), lambda at, s: (fixed(s, F.greatest(at, s["end"]), at), at), F.greatest, "bigint")
    after = lambda x: F.reverse(scan(F.reverse(x), far, lambda at, s: (fixed(s, s["start"], at), at), F.least, "bigint"))

    def left(x: Column) -> Column:
        marked = F.zip_with(F.zip_with(x, before(x), lambda s, b: F.struct(s.alias("s"), b.alias("b"))), after(x), lambda y, a: F.when((y["s"]["kind"] < RANDOM) | ((y["b"] <= y["s"]["start"]) & (a >= y["s"]["end"])), y["s"]))
        return F.filter(marked, lambda s: s.isNotNull())

    both = lambda x: F.exists(x, lambda s: s["kind"] < RANDOM) & F.exists(x, lambda s: s["kind"] == RANDOM)
    return once(spans, lambda x: F.when(both(x), left(x)).otherwise(x))


def found_spans(text: Column) -> Column:
    """array of (start, kind, end, bstart, bend, stratum, p), by start, then kind as listed: every fixed match, and the runs of key characters that overlap none.

    start and end are code points, bstart and bend bytes, ends exclusive; stratum and p are for runs of key characters.
    """

    def spans(pattern: str, kind: int, keep: Callable[[Column], Column] | None = None) -> Column:
        at = _matches(text, pattern)
        at = F.filter(at, keep) if keep else at
        token = lambda m: m["found"] if kind == RANDOM else F.lit(None).cast("string")
        return F.transform(at, lambda m: F.struct(m["start"].alias("start"), F.lit(kind).alias("kind"), m["end"].alias("end"), m["bstart"].alias("bstart"), m["bend"].alias("bend"), token(m).alias("token")))

    def tested(m: Column) -> Column:
        stratum = F.lit(0) + sum((m["end"] - m["start"] >= s).cast("int") for s in STRATA[1:])
        is_random = m["kind"] == RANDOM
        return F.struct(*[m[c].alias(c) for c in ("start", "kind", "end", "bstart", "bend")], F.when(is_random, stratum).alias("stratum"), F.when(is_random, _battery(m["token"])).alias("p"))

    every = F.concat(spans(ASSIGN, 0, lambda m: F.char_length(m["value"]) >= 12), spans(ACCESS, 1), spans(HEX, 2), spans(CANDIDATE, RANDOM))
    return F.transform(_untouched(F.sort_array(every)), tested)


def discovery_cutoffs(found: DataFrame, rate: float = 0.01) -> dict[int, float]:
    """For each length stratum the largest p at which the share of false discoveries among its candidates stays within rate; found: spans.

    Benjamini and Hochberg's step-up rule over counts by stratum and step of -log10(p): at most len(STRATA) * (BINS + 1) rows reach
    the driver, whatever the corpus.
    """
    at = found.select(F.explode("spans").alias("c")).filter(F.col("c.kind") == RANDOM)
    step = F.when(F.col("c.p").isNotNull(), F.least(F.floor(-10 * F.log10(F.col("c.p"))), F.lit(BINS - 1))).otherwise(F.lit(-1)).cast("int")
    counts: dict[int, dict[int, int]] = {}
    for s, b, n in at.groupBy(F.col("c.stratum").alias("s"), step.alias("b")).agg(F.count(F.lit(1))).collect():
        counts.setdefault(s, {})[b] = n
    out = {}
    for s, by in counts.items():
        m, seen, cut = sum(by.values()), 0, -1.0
        for b in range(BINS - 1, -1, -1):
            seen += by.get(b, 0)
            highest = 10 ** (-b / 10)  # every p in this step or beyond is at most this
            if seen and highest * m <= rate * seen:
                cut = highest
        out[s] = cut
    return out


def _kept(spans: Column, cutoffs: dict[int, float]) -> Column:
    """The fixed spans, and the random runs whose p is within their stratum's cutoff."""
    limits = F.array(*[F.lit(float(cutoffs.get(s, -1.0))) for s in range(len(STRATA))])
    return F.filter(spans, lambda m: (m["kind"] < RANDOM) | (m["p"].isNotNull() & (m["p"] <= F.get(limits, m["stratum"]))))


def _said(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def secret_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rate: float = 0.01) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans and n_random of every row.

    Offsets are code points of the whole text, ends exclusive. Null and empty texts have no spans (base_sha256 is that of the empty
    string); null and repeated ids stay; other columns are ignored; an empty table gives an empty result. Texts are read once:
    the spans found are stored, and the cutoffs and the result come from them.
    """
    found = stored(docs.select(F.col(id_col).cast("long").alias("doc_id"), found_spans(F.coalesce(F.col(text_col), F.lit(""))).alias("spans")), "spans")
    s = found.select("doc_id", F.explode(F.array(_kept(F.col("spans"), discovery_cutoffs(found, rate)))).alias("every"))
    n = lambda k: F.size(F.filter("every", lambda s: s["kind"] == k)).cast("long").alias(f"n_{KINDS[k]}")
    base = F.filter("every", lambda s: s["kind"] < RANDOM)
    return s.select("doc_id", n(0), n(1), n(2), F.sha2(_said(base), 256).alias("base_sha256"), _said(F.col("every")).alias("spans"), n(RANDOM))


def mask_secrets(docs: DataFrame, text_col: str = "text", count_col: str | None = "n_chars", rate: float = 0.01, mask: str = "[secret]") -> DataFrame:
    """docs with every span replaced by mask (touching or overlapping spans by one), and count_col, if there, by the new length.

    Texts without spans, null ones among them, stay as they are, and so do all other columns and rows, whatever their names.
    """
    found = stored(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("given"), found_spans(F.coalesce(F.col(text_col), F.lit(""))).alias("spans")), "masking")
    held = found.select("given", F.explode(F.array(_kept(F.col("spans"), discovery_cutoffs(found, rate)))).alias("every"))

    def masked(data: Column) -> Column:
        cut = lambda a, z: F.substring(data, (a + 1).cast("int"), (z - a).cast("int")).cast("string")

        def put(at: Column, s: Column) -> tuple[Column, Column]:
            return F.greatest(at, s["bend"]), F.when(s["bstart"] > at, F.concat(cut(F.greatest(at, F.lit(0)), s["bstart"]), F.lit(mask))).otherwise("")

        tail = F.array_max(F.transform("every", lambda s: s["bend"]))
        return F.concat(F.array_join(scan(F.col("every"), F.lit(-1).cast("long"), put, F.greatest, "string"), ""), cut(tail, F.octet_length(data).cast("long")))

    text = F.col("given")[text_col]
    new = F.when(F.size("every") > 0, once(text.cast("binary"), masked)).otherwise(text)
    out = held.select("given", F.explode(F.array(F.struct(new.alias("text"), F.size("every").alias("n")))).alias("now"))
    count = lambda c: F.when(F.col("now.n") > 0, F.char_length("now.text").cast(docs.schema[c].dataType)).otherwise(F.col("given")[c])
    value = lambda c: F.col("now.text") if c == text_col else count(c) if c == count_col else F.col("given")[c]
    return out.select(*[value(c).alias(c) for c in docs.columns])
