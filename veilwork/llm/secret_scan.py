"""Secret scans in DataFrame expressions only.

Base kinds are patterns. The method slides a window over candidate strings, the
maximal runs of a character class, and keeps the counts of the class's
characters up to date: the entering character adds one, the leaving one takes
one off. From the counts comes the sum of c * log2(c), which falls as the
window's Shannon entropy rises. Windows over a class's threshold are merged into
spans, unless the candidate is on the allow-list or a base span has all of the
span. Allowed parts end a candidate: what stands before and behind them are
candidates of their own, so a secret next to a placeholder is found.

The sums are whole numbers of millionths of a bit, so results do not depend on
the order of additions. Counts are five bits each, twelve to a number, of which
a step changes two. Candidates are cut into blocks that overlap by a window, and
lists are added up in blocks, so the work grows with the length of a text.

Edge cases: a null text counts as empty and has no spans; repeated rows give
equal rows; an empty table gives an empty table; other columns, whatever their
names, pass through redact() untouched and are not read by scan(). Offsets are
code points.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilwork.llm.common import unwrapped, wrapped


@dataclass(frozen=True)
class Kind:
    """A base kind; a match stays if its group has at least so many characters."""

    name: str
    pattern: str
    group: int
    least: int


@dataclass(frozen=True)
class CharacterClass:
    """Candidates of a class, and the entropy in bits from which a window of them is suspect."""

    name: str
    alphabet: str
    window: int
    bits: float

    @property
    def pattern(self) -> str:
        return "[" + self.alphabet.replace("-", "\\-") + "]{" + str(self.window) + ",}"

    @property
    def places(self) -> list[int]:
        """Of each ASCII code its place in the alphabet, -1 if it has none."""
        return [self.alphabet.find(chr(i)) for i in range(128)]


#: The base kinds. A run is maximal, so a longer minimum inside the pattern keeps the same matches.
KINDS = (
    Kind("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Kind("access", r"AKIA[A-Z0-9]{14,}", 0, 18),
    Kind("hex", r"[0-9a-f]{16,}", 0, 16),
)
CLASSES = (
    CharacterClass("entropy_hex", "0123456789ABCDEFabcdef", 20, 3.2),
    CharacterClass("entropy_base64", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-", 24, 4.05),
    CharacterClass("entropy_lower", "abcdefghijklmnopqrstuvwxyz0123456789", 20, 3.65),
    CharacterClass("entropy_upper", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", 20, 3.65),
)
#: Candidates that match this as a whole (words, numbers, UUIDs) are not secrets; candidates are cut at the words of ALLOWED_PARTS.
ALLOWED = (
    r"^[A-Za-z]+(?:[-_/][A-Za-z]+)*$|^[0-9]+(?:[-_/][0-9]+)*$"
    r"|^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"
)
ALLOWED_PARTS = (
    r"(?i)(?:^|[-_/+])(?:example|sample|dummy|placeholder)"
    r"(?:[-_/+](?:example|sample|dummy|placeholder))*(?:[-_/+]|$)"
)
MASK = "[SECRET]"
MILLION = 1_000_000
#: Counts in one number and bits of each; windows of a block of a candidate; members of a list that are added up at once.
PACKED, COUNT_BITS, BLOCK, LISTED = 12, 5, 1024, 256


def weight(count: int) -> int:
    """c * log2(c) in millionths."""
    return round(MILLION * count * math.log2(count)) if count else 0


def most_weight(c: CharacterClass) -> int:
    """The largest sum of weights of a suspect window: its entropy is log2(window) - sum / window."""
    return math.floor(MILLION * c.window * (math.log2(c.window) - c.bits))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _running(values: Column, first: int, both: Callable[[Column, Column], Column]) -> Column:
    """Of each member of an array of ints what both() makes of first and all members before it, and of all of them last.

    An array that a fold extends is copied at each step, so the folds go over blocks of LISTED members.
    """
    ints = "array<int>"

    def within(block: Column) -> Column:
        start = F.struct(F.lit(first).alias("at"), F.array().cast(ints).alias("out"))
        walked = F.aggregate(block, start, lambda acc, x: F.struct(both(acc["at"], x).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")))
        return walked

    def of(all_values: Column) -> Column:
        last = F.floor((F.size(all_values) - 1) / LISTED).cast("int")
        blocks = F.transform(F.sequence(F.lit(0), last), lambda k: within(F.slice(all_values, k * LISTED + 1, LISTED)))
        return let(blocks, joined)

    def joined(blocks: Column) -> Column:
        start = F.struct(F.lit(first).alias("at"), F.array().cast(ints).alias("out"))
        before = F.aggregate(blocks, start, lambda acc, b: F.struct(both(acc["at"], b["at"]).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")))
        every = lambda w: F.flatten(F.zip_with(blocks, w["out"], lambda b, x: F.transform(b["out"], lambda y: both(x, y))))
        return let(before, lambda w: F.concat(every(w), F.array(w["at"])))

    return let(values, lambda v: F.when(F.size(v) > 0, of(v)).otherwise(F.array(F.lit(first))))


def _literals(values: list) -> Column:
    """A constant array of numbers or of arrays of numbers."""
    return F.expr(str(values).replace("[", "array(").replace("]", ")"))


FOUND = "array<struct<start:int,end:int,what:string>>"


def _matches(text: Column, patterns: list[tuple[str, int]]) -> Column:
    """Of each pattern (start, end, what) of all matches; what is the text of the pattern's group."""

    def zipped(pattern: str, group: int) -> Column:
        found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
        shown = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
        parts = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), found.alias("own"), shown.alias("what"))
        none = F.array().cast("array<struct<gap:string,own:string,what:string>>")
        return F.when(text.rlike(pattern), parts).otherwise(none)

    def placed(parts: Column) -> Column:
        ends = _running(F.transform(parts, lambda p: F.length(p["gap"]) + F.length(p["own"])), 0, lambda a, b: a + b)
        return F.zip_with(
            parts,
            F.slice(ends, 2, F.size(parts)),
            lambda p, end: F.struct((end - F.length(p["own"])).alias("start"), end.alias("end"), p["what"].alias("what")),
        )

    # behind the last match stands one more gap, which has no match
    every = F.array(*(zipped(p, g) for p, g in patterns))
    return F.transform(every, lambda z: let(F.filter(z, lambda p: p["own"].isNotNull()), placed).cast(FOUND))


SPANS = "array<struct<start:int,kind:int,end:int>>"


def base_spans(text: Column) -> Column:
    least = _literals([k.least for k in KINDS])

    def of(found: Column, i: Column) -> Column:
        good = F.filter(found, lambda m: F.length(m["what"]) >= F.get(least, i))
        return F.transform(good, lambda m: F.struct(m["start"].alias("start"), i.alias("kind"), m["end"].alias("end")))

    every = _matches(text, [(k.pattern, k.group) for k in KINDS])
    return F.array_sort(F.flatten(F.transform(every, of)).cast(SPANS))


def _merged(runs: Column) -> Column:
    """Spans (start, end) whose starts and ends both rise, with those that touch as one."""

    def of(r: Column) -> Column:
        starts = F.filter(r, lambda x, i: (i == 0) | (x["start"] > F.get(r, i - 1)["end"]))
        ends = F.filter(r, lambda x, i: (i == F.size(r) - 1) | (F.get(r, i + 1)["start"] > x["end"]))
        return F.zip_with(starts, ends, lambda a, b: F.struct(a["start"].alias("start"), b["end"].alias("end"))).cast("array<struct<start:int,end:int>>")

    return let(runs, of)


RUNS = "array<struct<start:int,end:int>>"


def suspect_runs(candidate: Column, kind: Column) -> Column:
    """(start, end) in a candidate of a class (its number) of merged windows over the threshold, by incremental counts."""
    places, windows = _literals([c.places for c in CLASSES]), _literals([c.window for c in CLASSES])
    most = _literals([most_weight(c) for c in CLASSES])
    table = _literals([weight(n) for n in range(max(c.window for c in CLASSES) + 2)])
    numbers = range(-(-max(len(c.alphabet) for c in CLASSES) // PACKED))
    zero = F.lit(0).cast("long")

    def unit(code: Column) -> Column:
        return F.call_function("shiftleft", F.lit(1).cast("long"), code % PACKED * COUNT_BITS)

    def count(acc: Column, code: Column) -> Column:
        held = F.get(F.array(*(acc[f"c{k}"] for k in numbers)), F.floor(code / PACKED).cast("int"))
        return F.call_function("shiftright", held, code % PACKED * COUNT_BITS).bitwiseAND(F.lit(31)).cast("int")

    def told(acc: Column, x: Column) -> Column:
        """What a step changes: the number and the unit that the characters have, and the sum."""
        entering, leaving = x["entering"], x["leaving"]
        gone = leaving >= 0
        less = F.when(gone, count(acc, leaving)).otherwise(1)
        # the leaving character has gone when the entering one is counted
        more = count(acc, entering) - F.when(leaving == entering, 1).otherwise(0)
        total = acc["sum"] + F.when(gone, F.get(table, less - 1) - F.get(table, less)).otherwise(0)
        return F.struct(
            (total + F.get(table, more + 1) - F.get(table, more)).cast("long").alias("sum"),
            F.floor(entering / PACKED).alias("into"),
            F.when(gone, F.floor(leaving / PACKED)).otherwise(-1).alias("from"),
            unit(entering).alias("more"),
            F.when(gone, unit(leaving)).otherwise(0).alias("less"),
        )

    def step(p: Column, begin: Column, acc: Column, x: Column, t: Column) -> Column:
        moved = [(acc[f"c{k}"] + F.when(t["into"] == k, t["more"]).otherwise(0) - F.when(t["from"] == k, t["less"]).otherwise(0)).alias(f"c{k}") for k in numbers]
        end = begin + acc["at"] + 1
        start = end - p["window"]
        hit = (acc["at"] + 1 >= p["window"]) & (t["sum"] <= p["most"])
        last = F.element_at(acc["runs"], -1)
        goes_on = (F.size(acc["runs"]) > 0) & (last["end"] >= start)
        kept = F.slice(acc["runs"], 1, F.size(acc["runs"]) - F.when(goes_on, 1).otherwise(0))
        one = F.array(F.struct(F.when(goes_on, last["start"]).otherwise(start).alias("start"), end.alias("end")))
        runs = F.when(hit, F.concat(kept, one)).otherwise(acc["runs"])
        return F.struct(*moved, t["sum"].alias("sum"), (acc["at"] + 1).alias("at"), runs.cast(RUNS).alias("runs"))

    def of_block(p: Column, k: Column) -> Column:
        """Runs of the windows that begin in block k."""
        first = F.struct(*(zero.alias(f"c{k}") for k in numbers), zero.alias("sum"), F.lit(0).alias("at"), F.array().cast(RUNS).alias("runs"))
        pairs = lambda o: F.zip_with(
            o,
            F.slice(F.concat(F.array_repeat(F.lit(-1), p["window"]), o), 1, F.size(o)),
            lambda x, y: F.struct(x.alias("entering"), y.alias("leaving")),
        )
        walk = let(F.slice(p["codes"], k * BLOCK + 1, F.lit(BLOCK - 1) + p["window"]), pairs)
        return F.aggregate(walk, first, lambda acc, x: let(told(acc, x), lambda t: step(p, k * BLOCK, acc, x, t)), lambda acc: acc["runs"])

    def of(p: Column) -> Column:
        last = F.floor((F.size(p["codes"]) - p["window"]) / BLOCK).cast("int")
        runs = F.flatten(F.transform(F.sequence(F.lit(0), last), lambda k: of_block(p, k)))
        return F.when(last >= 0, _merged(runs)).otherwise(F.array().cast(RUNS))

    codes = let(F.get(places, kind), lambda own: F.transform(F.split(candidate, "(?!^)(?!$)"), lambda x: F.get(own, F.ascii(x))))
    return let(F.struct(codes.alias("codes"), F.get(windows, kind).alias("window"), F.get(most, kind).alias("most")), of)


HELD = "array<struct<start:int,late:int,end:int,kind:int,what:string>>"


def _outside(spans: Column, base: Column) -> Column:
    """Those of the spans (start, late, end, kind, what; late: 1) that no base span has all of.

    One sorted list has both; of the base spans that begin before or with a span, the one that ends last decides.
    """
    begun = F.transform(base, lambda b: F.struct(b["start"], F.lit(0), b["end"], b["kind"], F.lit("")))

    def of(points: Column) -> Column:
        ends = _running(F.transform(points, lambda p: F.when(p["late"] == 0, p["end"]).otherwise(-1)), -1, F.greatest)
        told = F.zip_with(points, ends, lambda p, covered: F.struct(p.alias("p"), covered.alias("covered")))
        free = F.filter(told, lambda t: (t["p"]["late"] == 1) & (t["covered"] < t["p"]["end"]))
        return F.transform(free, lambda t: t["p"])

    every = F.array_sort(F.concat(begun.cast(HELD), spans))
    return let(spans, lambda s: F.when(F.size(s) > 0, let(every, of)).otherwise(F.array().cast(HELD)))


def _cut(m: Column) -> Column:
    """What of a match (start, end, what) stands between allowed parts; start and end follow."""
    parts = F.split(m["what"], ALLOWED_PARTS, -1)
    gone = F.transform(F.regexp_extract_all(m["what"], F.lit(ALLOWED_PARTS), F.lit(0)), lambda x: F.length(x))

    def placed(own: Column) -> Column:
        ends = _running(F.zip_with(own, gone, lambda x, y: F.length(x) + F.coalesce(y, F.lit(0))), 0, lambda a, b: a + b)
        starts = F.slice(ends, 1, F.size(own))
        return F.zip_with(own, starts, lambda x, at: F.struct((m["start"] + at).alias("start"), (m["start"] + at + F.length(x)).alias("end"), x.alias("what")))

    whole = F.array(F.struct(m["start"].alias("start"), m["end"].alias("end"), m["what"].alias("what")))
    return F.when(m["what"].rlike(ALLOWED_PARTS), let(parts, placed)).otherwise(whole)


def candidates(text: Column) -> Column:
    """Candidates of all classes, cut at allowed parts, that are long enough and not on the allow-list."""
    windows = _literals([c.window for c in CLASSES])

    def of(found: Column, i: Column) -> Column:
        cut = F.flatten(F.transform(found, _cut))
        unlisted = F.filter(cut, lambda m: (F.length(m["what"]) >= F.get(windows, i)) & ~m["what"].rlike(ALLOWED))
        return F.transform(unlisted, lambda m: F.struct(m["start"], F.lit(1), m["end"], i, m["what"])).cast(HELD)

    return F.flatten(F.transform(_matches(text, [(c.pattern, 0) for c in CLASSES]), of))


def suspects(whole: Column) -> Column:
    """Suspect spans of candidates."""

    def of(m: Column) -> Column:
        shown = lambda r: F.substring(m["what"], r["start"] + 1, r["end"] - r["start"])
        return F.transform(
            suspect_runs(m["what"], m["kind"]),
            lambda r: F.struct(m["start"] + r["start"], F.lit(1), m["start"] + r["end"], m["kind"], shown(r)),
        ).cast(HELD)

    return F.flatten(F.transform(whole, of))


def _listed(spans: Column) -> Column:
    names = F.array(*[F.lit(k.name) for k in (*KINDS, *CLASSES)])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", names[s["kind"]], s["start"], s["end"])), ",")


def with_spans(df: DataFrame) -> DataFrame:
    """row (all columns of df), text, base and found: base spans and all spans, each sorted by start, then kind as listed."""
    rows = wrapped(df).withColumn("text", F.coalesce(F.col("row.text"), F.lit("")))
    rows = rows.withColumn("base", base_spans(F.col("text"))).withColumn("whole", candidates(F.col("text")))
    rows = rows.withColumn("whole", _outside(F.col("whole"), F.col("base"))).withColumn("suspect", suspects(F.col("whole")))
    rows = rows.withColumn("suspect", _outside(F.col("suspect"), F.col("base")))
    added = F.transform("suspect", lambda s: F.struct(s["start"], s["kind"] + len(KINDS), s["end"])).cast(SPANS)
    return rows.select("row", "text", "base", F.array_sort(F.concat("base", added)).alias("found"))


def _is(kind: int) -> Callable[[Column], Column]:
    return lambda s: s["kind"] == kind


def scan(df: DataFrame) -> DataFrame:
    """Counts, digest of the base spans, and all spans of every row of df (doc_id, text)."""
    found = with_spans(df.select("doc_id", "text"))
    counts = [F.size(F.filter("base", _is(i))).cast("long").alias(f"n_{k.name}") for i, k in enumerate(KINDS)]
    digest = F.sha2(_listed(F.col("base")), 256).alias("base_sha256")
    return found.select("row.doc_id", *counts, digest, _listed(F.col("found")).alias("spans"))


TEXT_BLOCK = 4096  # code points that are skipped to reach a place in a text


def masked(text: Column, spans: Column) -> Column:
    """text with MASK in place of every span (sorted by start); spans that overlap are masked as one, also those that touch.

    The text is cut into blocks first, as a place far inside of a text is found by counting from its begin.
    """
    blocks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{TEXT_BLOCK}}}"), F.lit(0))

    def joined(merged: Column) -> Column:
        return let(blocks, lambda own: F.array_join(F.transform(F.sequence(F.lit(0), F.size(merged)), lambda i: gap(own, merged, i)), MASK))

    def gap(own: Column, merged: Column, i: Column) -> Column:
        """The text between spans i - 1 and i."""
        return let(
            F.struct(
                F.coalesce(F.get(merged, i - 1)["end"], F.lit(0)).alias("a"),
                F.coalesce(F.get(merged, i)["start"], F.length(text)).alias("b"),
            ),
            lambda g: let(
                F.struct(g["a"], g["b"], F.floor(g["a"] / TEXT_BLOCK).cast("int").alias("k")),
                lambda p: F.substring(
                    F.array_join(F.slice(own, p["k"] + 1, F.floor(p["b"] / TEXT_BLOCK).cast("int") - p["k"] + 1), ""),
                    p["a"] - p["k"] * TEXT_BLOCK + 1,
                    p["b"] - p["a"],
                ),
            ),
        )

    # ends rise once every span reaches as far as those before it
    reach = lambda found: F.zip_with(
        found,
        F.slice(_running(F.transform(found, lambda s: s["end"]), 0, F.greatest), 2, F.size(found)),
        lambda s, end: F.struct(s["start"].alias("start"), end.alias("end")),
    )
    return let(_merged(let(spans, reach)), joined)


def redact(df: DataFrame) -> DataFrame:
    """df with every span of its text masked. n_chars, if there, follows."""
    found = with_spans(df)
    hit = F.size("found") > 0
    text = F.when(hit, masked(F.col("text"), F.col("found"))).otherwise(F.col("row.text"))
    found = found.withColumn("masked", text)
    new = {"text": F.col("masked")}
    if "n_chars" in df.columns:
        kind = df.schema["n_chars"].dataType
        new["n_chars"] = F.when(hit, F.length("masked").cast(kind)).otherwise(F.col("row.n_chars"))
    return unwrapped(found, df.columns, new)
