"""Span algebra as column expressions.

A span is a struct (start, end, type, confidence); offsets are code points, the
end is exclusive. Everything here stays in the JVM.

The work on one text is that of a sort of its spans: nothing is looked up by a
walk over all spans, values are cut from short pieces of the text, and what
grows does so by blocks.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from veilwork.functions.rules import Rule, active_rules

SPAN = "struct<start:int,end:int,type:string,confidence:double>"
SPANS = f"array<{SPAN}>"


def empty(ddl: str = SPANS) -> Column:
    return F.expr(f"cast(array() as {ddl})")


def let(value: Column, body) -> Column:
    """body(value), with the value computed once for a row; inside a lambda it would be computed for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


#: Rows of a block of walked(), at least.
LEAST_BLOCK = 16


def walked(rows: Column, state: Column, step, ddl: str, finish=None) -> Column:
    """What a walk over rows puts out: step(state, row) gives the next state and an array, all of type ddl, finish(state) the end.

    A fold copies what it has gathered at each step. So it first gathers nothing but the states between blocks, as many as
    a block has rows, and then walks each block from its own state: n rows cost n to the power of 3/2, not 2.
    """

    def at(acc: Column, row: Column) -> Column:
        return step(acc, row)[0]

    def jump(acc: Column, block: Column) -> Column:
        after = F.aggregate(block, acc["state"], at)
        return F.struct(after.alias("state"), F.concat(acc["seen"], F.array(acc["state"])).alias("seen"))

    def one(acc: Column, row: Column) -> Column:
        after, out = step(acc["state"], row)
        return F.struct(after.alias("state"), F.concat(acc["out"], out.cast(ddl)).alias("out"))

    def block_out(block: Column, state: Column) -> Column:
        return F.aggregate(block, F.struct(state.alias("state"), empty(ddl).alias("out")), one, lambda acc: acc["out"])

    def blocks_out(blocks: Column) -> Column:
        start = F.struct(state.alias("state"), F.slice(F.array(state), 1, 0).alias("seen"))

        def told(passed: Column) -> Column:
            out = F.flatten(F.transform(blocks, lambda b, i: block_out(b, F.get(passed["seen"], i))))
            return F.concat(out, finish(passed["state"]).cast(ddl)) if finish else out

        return let(F.aggregate(blocks, start, jump), told)

    def dealt(rows: Column) -> Column:
        size = F.greatest(F.lit(LEAST_BLOCK), F.ceil(F.sqrt(F.size(rows))).cast("int"))
        starts = F.when(F.size(rows) > 0, F.sequence(F.lit(1), F.size(rows), size)).otherwise(empty("array<int>"))
        return F.transform(starts, lambda s: F.slice(rows, s, size))

    return let(let(rows, dealt), blocks_out)


#: Pieces of a text have two to the power of this many characters.
PIECE_BITS = 9


def pieces(text: Column) -> Column:
    """The text in short pieces of equal length: a place in a long text is only found by a walk from its start."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{1 << PIECE_BITS}}}"), F.lit(0))


def cut(of: Column, start: Column, end: Column) -> Column:
    """From start up to end of a text in pieces()."""
    start = F.greatest(start, F.lit(0))
    first = F.shiftright(start, PIECE_BITS)
    last = F.shiftright(end - 1, PIECE_BITS)
    several = F.array_join(F.slice(of, first + 1, F.greatest(last - first + 1, F.lit(0))), "")
    near = F.when(first == last, F.coalesce(F.get(of, first), F.lit(""))).otherwise(several)
    return F.substring(near, start.bitwiseAND((1 << PIECE_BITS) - 1) + 1, end - start)


#: Parts what a pattern has matched from what lies between; texts that have it themselves are cut in another way.
PARTING = "\x01"


def _parted(text: Column, pattern: str) -> Column:
    """What lies before the first match of a pattern, the match, what lies between it and the next one, and so on."""
    twice = F.arrays_zip(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("value"), F.split(text, pattern, -1).alias("gap"))
    # there is one more gap than matches: the last one has no value
    twice = F.flatten(F.transform(twice, lambda x: F.when(x["value"].isNull(), F.array(x["gap"])).otherwise(F.array(x["gap"], x["value"]))))
    once = F.split(F.regexp_replace(text, pattern, f"{PARTING}$0{PARTING}"), PARTING, -1)
    return F.when(F.contains(text, F.lit(PARTING)), twice).otherwise(once)


def matches(text: Column, pattern: str, literal: str = "", hint: str = "", dense: bool = False) -> Column:
    """(start, end, value) of the non-overlapping matches of a pattern, from the left.

    The texts between matches give their offsets; no builtin has them. Texts without the literal or the hint, which
    every match contains, are told apart first, and, unless most texts have a match (dense), those without a match.
    """
    ddl = "array<struct<start:int,end:int,value:string>>"
    none = empty(ddl)

    def placed(parts: Column, sizes: Column) -> Column:
        order = F.sequence(F.lit(0), F.shiftright(F.size(parts), 1) - 1)
        steps = F.transform(order, lambda i: F.get(sizes, 2 * i) + F.get(sizes, 2 * i + 1))
        ends = walked(steps, F.lit(0), lambda at, n: (at + n, F.array(at + n)), "array<int>")

        def one(end: Column, i: Column) -> Column:
            return F.struct((end - F.get(sizes, 2 * i + 1)).alias("start"), end.alias("end"), F.get(parts, 2 * i + 1).alias("value"))

        return F.transform(ends, one).cast(ddl)

    def found(parts: Column) -> Column:
        spots = let(F.transform(parts, F.length), lambda sizes: placed(parts, sizes))
        return F.when(F.size(parts) > 1, spots).otherwise(none)

    # most texts have no match: the cheapest test that shows it comes first
    some = text.isNotNull() if dense else text.rlike(pattern)
    some = text.rlike(hint) & some if hint else some
    some = F.contains(text, F.lit(literal)) & some if literal else some
    return F.when(some, let(_parted(text, pattern), found)).otherwise(none)


def luhn_ok(value: Column) -> Column:
    """13 to 19 digits, whatever stands between them, whose check digit is right."""
    digits = F.regexp_replace(value, r"(?U)\D", "")
    return F.length(digits).between(13, 19) & F.coalesce(F.call_function("luhn_check", digits), F.lit(False))


def _of_rule(text: Column, rule: Rule) -> Column:
    found = matches(text, rule.pattern, rule.literal, rule.hint)
    if rule.luhn:
        found = F.filter(found, lambda m: luhn_ok(m["value"]))
    return F.transform(
        found,
        lambda m: F.struct(
            m["start"].alias("start"), m["end"].alias("end"), F.lit(rule.type).alias("type"), F.lit(1.0).alias("confidence")
        ),
    ).cast(SPANS)


def detect(text: Column, entity_types: list[str] | None = None) -> Column:
    """Spans of the active rules, by (start, end), then in the rules' order; rules may overlap each other."""
    rules = active_rules(entity_types)
    if not rules:
        return empty()
    text = F.coalesce(text, F.lit(""))
    if len(rules) == 1:
        return _of_rule(text, rules[0])
    return stable_sort(F.concat(*(_of_rule(text, r) for r in rules)), lambda s: (s["start"], s["end"]))


def stable_sort(spans: Column, keys) -> Column:
    """The elements by keys(element), equal ones in their order."""
    numbered = F.transform(
        spans, lambda s, i: F.struct(*(k.alias(f"k{n}") for n, k in enumerate(keys(s))), i.alias("at"), s.alias("span"))
    )
    return F.transform(F.array_sort(numbered), lambda x: x["span"])


def overlap(a: Column, b: Column) -> Column:
    return (a["start"] < b["end"]) & (b["start"] < a["end"])


def validate(text: Column, spans: Column) -> Column:
    """Spans that lie in the text and are not empty."""
    inside = lambda n: F.filter(spans, lambda s: (s["start"] >= 0) & (s["end"] > s["start"]) & (s["end"] <= n))
    return let(F.length(text), inside)


def dedupe(spans: Column) -> Column:
    """A fold in the order of start, longer ones first, surer ones first.

    A span that overlaps a kept one of at least its confidence is left out; else it evicts all kept ones that it
    overlaps. So chains may lose everything but their last link: this is no choice of the surest.
    """
    return let(spans, _deduped)


def _deduped(spans: Column) -> Column:
    ordered = stable_sort(spans, lambda s: (s["start"], -(s["end"] - s["start"]), -s["confidence"]))

    def step(kept: Column, s: Column) -> Column:
        beaten = F.exists(kept, lambda k: overlap(k, s) & (k["confidence"] >= s["confidence"]))
        return F.when(beaten, kept).otherwise(F.concat(F.filter(kept, lambda k: ~overlap(k, s)), F.array(s)))

    def step_last(last: Column, s: Column) -> tuple[Column, Column]:
        # kept ones are disjoint and start no later than s: if none is empty, only the last can reach into s
        meets = F.coalesce(last["end"] > s["start"], F.lit(False))
        beaten = meets & (last["confidence"] >= s["confidence"])
        return F.when(beaten, last).otherwise(s), F.when(meets | last.isNull(), empty()).otherwise(F.array(last))

    filled = F.forall(spans, lambda s: F.coalesce(s["end"] > s["start"], F.lit(False)))
    chain = walked(ordered, F.expr(f"cast(null as {SPAN})"), step_last, SPANS, lambda last: F.array(last))
    folded = F.when(filled, chain).otherwise(F.aggregate(ordered, empty(), step))
    return F.when(F.size(spans) < 2, spans).otherwise(stable_sort(folded, lambda s: (s["start"],)))


def overlapped(spans: Column, others: Column) -> Column:
    """For each span, whether one of the others overlaps it: a sweep over the others' starts and the spans' ends."""
    point = "array<struct<at:int,late:int,i:int,x:int>>"
    begun = F.transform(others, lambda o: F.struct(o["start"].alias("at"), F.lit(1).alias("late"), F.lit(0).alias("i"), o["end"].alias("x")))
    # what begins where a span ends does not meet it, so spans come first
    asked = F.transform(spans, lambda s, i: F.struct(s["end"].alias("at"), F.lit(0).alias("late"), i.alias("i"), s["start"].alias("x")))
    told = "array<struct<i:int,met:boolean>>"

    def step(reach: Column, p: Column) -> tuple[Column, Column]:
        met = F.array(F.struct(p["i"].alias("i"), F.coalesce(reach > p["x"], F.lit(False)).alias("met")))
        return F.when(p["late"] == 1, F.greatest(reach, p["x"])).otherwise(reach), F.when(p["late"] == 0, met).otherwise(empty(told))

    swept = walked(F.array_sort(F.concat(begun.cast(point), asked.cast(point))), F.expr("cast(null as int)"), step, told)
    return F.transform(F.array_sort(swept), lambda t: t["met"])


def fuse(rule_spans: Column, model_spans: Column, least: float = 0.5) -> Column:
    """All rule spans, and sure enough model spans that overlap none of them; then dedupe."""
    sure = F.filter(model_spans, lambda m: m["confidence"] >= least)

    def joined(rules: Column, sure: Column) -> Column:
        told = F.arrays_zip(sure.alias("span"), overlapped(sure, rules).alias("met"))
        return F.concat(rules, F.transform(F.filter(told, lambda t: ~t["met"]), lambda t: t["span"]))

    return dedupe(let(rule_spans, lambda r: let(sure, lambda m: F.when(F.size(m) == 0, r).otherwise(joined(r, m)))))


def value_of(text: Column, span: Column) -> Column:
    return F.substring(text, span["start"] + 1, span["end"] - span["start"])


def with_values(text: Column, spans: Column, body) -> Column:
    """body(value, span, index) of each span."""
    return let(pieces(text), lambda p: F.transform(spans, lambda s, i: body(cut(p, s["start"], s["end"]), s, i)))


def with_replacements(text: Column, spans: Column, render) -> Column:
    """(span, replacement) pairs; render(value, span, index) gives the replacement."""
    return with_values(text, spans, lambda value, s, i: F.struct(s.alias("span"), render(value, s, i).alias("replacement")))


def splice(text: Column, pairs: Column) -> Column:
    """The text with each span replaced, from the right to the left.

    Where spans overlap, later ones in the text have been replaced before: offsets then cut into replacements.
    """
    backwards = stable_sort(pairs, lambda p: (-p["span"]["start"],))
    return F.aggregate(
        backwards,
        text,
        lambda out, p: F.concat(
            F.substring(out, F.lit(1), p["span"]["start"]),
            p["replacement"],
            F.substring(out, p["span"]["end"] + 1, F.length(out)),
        ),
    )


def splice_disjoint(text: Column, pairs: Column) -> Column:
    """As splice, for spans that do not overlap: one walk from the left, each piece copied once."""

    def spliced(pairs: Column, of: Column) -> Column:
        def step(at: Column, p: Column) -> tuple[Column, Column]:
            return p["span"]["end"], F.array(cut(of, at, p["span"]["start"]), p["replacement"])

        rest = lambda at: F.array(cut(of, at, F.lit(2**31 - 1)))
        forwards = stable_sort(pairs, lambda p: (p["span"]["start"],))
        return F.array_join(walked(forwards, F.lit(0), step, "array<string>", rest), "")

    return let(pairs, lambda ps: F.when(F.size(ps) == 0, text).otherwise(let(pieces(text), lambda of: spliced(ps, of))))


SEGMENT = "array<struct<new:int,old:int,replaced:boolean>>"


def segments(text: Column, pairs: Column) -> Column:
    """Where each stretch of the text after splicing comes from."""
    forwards = stable_sort(pairs, lambda p: (p["span"]["start"],))
    start = F.struct(F.lit(0).alias("new"), F.lit(0).alias("prev"))

    def one(new: Column, old: Column, replaced: bool) -> Column:
        return F.array(F.struct(new.alias("new"), old.alias("old"), F.lit(replaced).alias("replaced"))).cast(SEGMENT)

    def step(acc: Column, p: Column) -> tuple[Column, Column]:
        begin = p["span"]["start"]
        gap = F.greatest(begin - acc["prev"], F.lit(0))
        at = acc["new"] + gap
        kept = F.when(gap > 0, one(acc["new"], acc["prev"], False)).otherwise(empty(SEGMENT))
        after = F.struct((at + F.length(p["replacement"])).alias("new"), p["span"]["end"].alias("prev"))
        return after, F.concat(kept, one(at, begin, True))

    def finish(acc: Column) -> Column:
        return F.when(acc["prev"] < F.length(text), one(acc["new"], acc["prev"], False)).otherwise(empty(SEGMENT))

    return walked(forwards, start, step, SEGMENT, finish)


def remap(segs: Column, position: Column) -> Column:
    """Place in the text before splicing of a place after it; inside a replacement, the start of its span."""
    at = F.element_at(F.filter(segs, lambda s: s["new"] <= position), -1)
    moved = F.when(at["replaced"], at["old"]).otherwise(at["old"] + position - at["new"])
    return F.when(position < 0, F.lit(0)).when(F.size(segs) == 0, position).otherwise(moved)


def recast(spans: Column, segs: Column) -> Column:
    """Spans after splicing, in the coordinates before it: remap() of all starts and last characters, in one sweep."""
    point = "array<struct<at:int,asked:int,i:int,old:int,replaced:boolean>>"
    seg = F.transform(segs, lambda g, i: F.struct(g["new"], F.lit(0), i, g["old"], g["replaced"])).cast(point)
    ask = lambda at, i: F.struct(at.alias("at"), F.lit(1).alias("asked"), i.alias("i"), F.lit(0).alias("old"), F.lit(False).alias("replaced"))
    both = F.flatten(F.transform(spans, lambda s, i: F.array(ask(s["start"], 2 * i), ask(s["end"] - 1, 2 * i + 1)))).cast(point)
    moved = "array<struct<i:int,old:int>>"
    none = F.expr("cast(null as struct<new:int,old:int,replaced:boolean>)")

    def step(last: Column, p: Column) -> tuple[Column, Column]:
        asked = p["asked"] == 1
        here = F.struct(p["at"].alias("new"), p["old"].alias("old"), p["replaced"].alias("replaced"))
        old = F.when(last["replaced"], last["old"]).otherwise(last["old"] + p["at"] - last["new"])
        old = F.when(p["at"] < 0, F.lit(0)).otherwise(old)
        return F.when(asked, last).otherwise(here), F.when(asked, F.array(F.struct(p["i"].alias("i"), old.alias("old")))).otherwise(empty(moved))

    def placed(olds: Column) -> Column:
        return F.transform(
            spans,
            lambda s, i: F.struct(F.get(olds, 2 * i)["old"], F.get(olds, 2 * i + 1)["old"] + 1, s["type"], s["confidence"]),
        ).cast(SPANS)

    swept = F.array_sort(walked(F.array_sort(F.concat(seg, both)), none, step, moved))
    return F.when(F.size(segs) == 0, F.transform(spans, lambda s: s).cast(SPANS)).otherwise(let(swept, placed))


def split_on_newlines(text: Column, spans: Column, ddl: str) -> Column:
    """Spans (start, end, ...) cut at line ends; empty pieces go. ddl is the type of the array."""

    def lines(value: Column, s: Column, _: Column) -> Column:
        parts = F.split(value, "\n", -1)
        start = F.struct(s["start"].alias("at"), empty(ddl).alias("out"))

        def step(acc: Column, part: Column) -> Column:
            end = acc["at"] + F.length(part)
            one = F.array(s.withField("start", acc["at"]).withField("end", end))
            return F.struct((end + 1).alias("at"), F.when(F.length(part) > 0, F.concat(acc["out"], one)).otherwise(acc["out"]).alias("out"))

        return F.aggregate(parts, start, step, lambda acc: acc["out"])

    return F.flatten(with_values(text, spans, lines))


def listed(spans: Column) -> Column:
    """start-end:type of each, joined; for comparisons."""
    return F.array_join(F.transform(spans, lambda s: F.format_string("%d-%d:%s", s["start"], s["end"], s["type"])), " ")
