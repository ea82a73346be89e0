"""The character-level redaction score, as plans over all documents at once.

A document's mandatory and contextual spans form entities: neighbours that only a
connector parts belong together, and so do contextual spans inside a pair of
delimiters. A mandatory entity adds its coverage over 1. A contextual entity that
the prediction has tried to hit adds its coverage over 1 if the document has
nothing mandatory, else its uncovered share to the denominator. Each false
positive run adds 1 to the denominator, 2 if it swallows a gap.

Texts are read once: of each span only the characters at its ends are kept, and
of each text its matched delimiters. From there on all is rows of offsets.
Neighbours are a window; groups of neighbours are running sums of breaks. Pairs
of delimiters nest, so only outermost ones decide which spans are one entity, and
as those lie in order, entities are running sums as well. Hits spread from group
to pair to group in rounds, as semi-joins with what the last round has added.
Coverage, containment and gaps are sweeps (intervals.py). Whether a quote opens
or closes depends on all that is open, so delimiters are matched by one pass over
each text's delimiters in an Arrow function, which gets nothing else; that is all the Python there is.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from veilwork.functions import spans as S
from veilwork.operators import evaluation, intervals
from veilwork.sources.shared import stored

#: Which characters connect, and which come in pairs.
NO_CONNECTORS = "\\/@[]{}()<>\"'`"
BRACKETS = {"(": ")", "[": "]", "{": "}", "<": ">"}
QUOTES = "\"'`"
LEAST_GAP = 3

DELIMITERS = r"[\[\](){}<>\"'`]"
PAIRS = ArrayType(StructType().add("o", "integer").add("e", "integer").add("opener", "string").add("closer", "string"))


def _matched(signs: list[dict]) -> list[dict]:
    """Matched pairs of one text's delimiters, in order of their ends; a wrong closer drops what it meets."""
    open_: list[dict] = []
    pairs = []
    for sign in signs:
        quote = sign["c"] in QUOTES
        if not quote and sign["c"] in BRACKETS or quote and not (open_ and open_[-1]["c"] == sign["c"]):
            open_.append(sign)
        elif open_:
            first = open_.pop()
            if quote or BRACKETS.get(first["c"]) == sign["c"]:
                pairs.append({"o": first["at"], "e": sign["at"], "opener": first["c"], "closer": sign["c"]})
    return pairs


@F.arrow_udf(PAIRS)
def matched_pairs(signs: pa.Array) -> pa.Array:
    """Matched pairs of delimiters of texts, from their delimiters with places in order."""
    pair = pa.struct([("o", pa.int32()), ("e", pa.int32()), ("opener", pa.string()), ("closer", pa.string())])
    return pa.array([_matched(own or []) for own in signs.to_pylist()], pa.list_(pair))


def _delimiters(pieces: Column) -> Column:
    """Delimiters with their places, from a text's pieces. Characters are split only where a piece has any."""

    def of(piece: Column, i: Column) -> Column:
        signs = F.transform(F.split(piece, ""), lambda c, k: F.struct((F.shiftleft(i, S.PIECE_BITS) + k).alias("at"), c.alias("c")))
        return F.when(piece.rlike(DELIMITERS), F.filter(signs, lambda s: s["c"].rlike(DELIMITERS))).otherwise(F.array().cast("array<struct<at:int,c:string>>"))

    return F.flatten(F.transform(pieces, of))


#: Bits of a character in the look of a span.
CHAR_BITS = 21


def _look(near: Column, start: Column, end: Column) -> Column:
    """What neighbours are told apart by, in one long: the last character of a span and the next one, each as a code point, and four flags.

    near is the text from the character before the span to the second one behind it.
    """
    size = end - start
    piece = near.substr(F.when(start > 0, 2).otherwise(1), size)
    after = near.substr(F.when(start > 0, 2).otherwise(1) + size, F.lit(2))
    two, flags = after.substr(2, 1), [piece.rlike(r"\A[0-9]*\z"), F.length(piece) == 1]
    look = F.shiftleft(F.ascii(piece.substr(F.lit(-1), F.lit(1))).cast("long"), CHAR_BITS) + F.ascii(after.substr(1, 1))
    for flag in (*flags, two == " ", two == "\t"):
        look = F.shiftleft(look, 1) + flag.cast("long")
    return look


def _seen(look: Column) -> dict[str, Column]:
    """tail and one (code points), and whether all of a span are digits, it is one character, the second one behind it is a space or a tab."""
    bit = lambda n: F.shiftright(look, n).bitwiseAND(1) == 1
    char = lambda n: F.shiftright(look, n).bitwiseAND((1 << CHAR_BITS) - 1).cast("int")
    return {"tail": char(4 + CHAR_BITS), "one": char(4), "digits": bit(3), "lone": bit(2), "space": bit(1), "tab": bit(0)}


def facts(df: DataFrame) -> DataFrame:
    """What the score needs of each document, without its text.

    doc_id, length, red (whether anything is mandatory), marked (distinct spans with the characters around them), predictions,
    signs (delimiters of texts with anything contextual). Spans of other categories, and empty ones, are left out.
    """
    empty = F.array().cast("array<struct<start:int,end:int,category:string>>")
    own = F.filter(F.coalesce("spans", empty), lambda s: s["category"].isin("mandatory", "contextual") & (s["start"] >= 0) & (s["start"] < s["end"]))
    # structs are told apart by comparing each with all, numbers by hashing
    packed = F.transform(own, lambda s: F.shiftleft(s["start"].cast("long"), 32) + s["end"].cast("long") * 2 + (s["category"] == "contextual").cast("long"))
    docs = df.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.array_distinct(packed).alias("own"), "predictions")
    docs = docs.select("doc_id", F.length("text").alias("length"), S.pieces(F.col("text")).alias("pieces"), "own", "predictions")
    start = lambda s: F.shiftright(s, 32).cast("int")
    end = lambda s: F.shiftright(s.bitwiseAND(2**32 - 1), 1).cast("int")

    def mark(s: Column) -> Column:
        return F.struct(s.alias("packed"), S.cut(F.col("pieces"), start(s) - 1, end(s) + 2).alias("near"))

    yellow = F.exists("own", lambda s: s.bitwiseAND(1) == 1)
    signs = F.when(yellow, _delimiters(F.col("pieces"))).otherwise(F.array().cast("array<struct<at:int,c:string>>"))
    red = F.exists("own", lambda s: s.bitwiseAND(1) == 0)
    return docs.select("doc_id", "length", red.alias("red"), F.transform("own", mark).alias("marked"), "predictions", signs.alias("signs"))


def _events(told: DataFrame) -> DataFrame:
    """Where spans and predictions of facts() begin and end, and both ends of the texts: one row a place, which is four times the offset and late.

    late is 0 where a span ends, 2 at the end of a text, else 1; step is 1 or -1 where a prediction that has characters in
    the text begins or ends; reach is where a prediction that begins here ends.
    """
    spans = told.select("doc_id", "length", F.explode("marked").alias("s"))
    end = F.shiftright(F.col("s.packed").bitwiseAND(2**32 - 1), 1).cast("int")
    spans = spans.select("doc_id", "length", F.shiftright("s.packed", 32).cast("int").alias("start"), end.alias("end"), F.col("s.packed").bitwiseAND(1).cast("int").alias("colour"), "s.near")
    spans = spans.select("doc_id", "length", "start", "end", "colour", _look(F.col("near"), F.col("start"), F.col("end")).alias("look"), F.explode(F.array(F.lit(0), F.lit(1))).alias("late"))
    spans = spans.withColumn("at", F.when(F.col("late") == 1, F.col("start")).otherwise(F.col("end"))).withColumn("step", F.lit(0))
    found = told.select("doc_id", "length", F.explode("predictions").alias("p")).select("doc_id", "length", F.col("p.start").cast("int").alias("a"), F.col("p.end").cast("int").alias("b")).where("a is not null and b is not null")
    inside = lambda c: F.greatest(F.lit(0), F.least(c, "length"))
    real = (inside("a") < inside("b")).cast("int")
    begun = F.struct(F.greatest(F.lit(0), "a").alias("at"), F.col("b").alias("reach"), real.alias("step"))
    ended = F.struct(inside("b").alias("at"), F.lit(None).cast("int").alias("reach"), (-real).alias("step"))
    found = found.select("doc_id", "length", F.lit(1).alias("late"), F.explode(F.array(begun, ended)).alias("e")).select("doc_id", "length", "late", "e.*")
    ends = F.array(F.struct(F.lit(0).alias("at"), F.lit(1).alias("late")), F.struct(F.col("length").alias("at"), F.lit(2).alias("late")))
    ends = told.select("doc_id", "length", F.explode(ends).alias("e")).select("doc_id", "length", "e.*", F.lit(0).alias("step"))
    rows = spans.unionByName(found, allowMissingColumns=True).unionByName(ends, allowMissingColumns=True)
    return rows.withColumn("place", F.col("at").cast("long") * 4 + F.col("late")).drop("at", "late")


def swept(told: DataFrame) -> DataFrame:
    """Spans of facts() with covered (characters that the prediction covers) and met (whether a prediction touches it).

    All comes from one order of places: how many predictions and spans are open, what has been covered, how far
    predictions reach. Each document has one more row, without a span: false positives are the sums of fp, double those of
    whole. A false positive lies in one gap, so it swallows a gap where it begins and ends with it.
    """
    # at and late in one number, as rows are sorted by it
    order = Window.partitionBy("doc_id").orderBy("place")
    so_far, before = order.rowsBetween(Window.unboundedPreceding, Window.currentRow), order.rowsBetween(Window.unboundedPreceding, -1)
    at, late, in_text = F.shiftright("place", 2).cast("int"), F.col("place").bitwiseAND(3), F.col("start") < F.col("length")
    opened = F.when(in_text & (late == 1), 1).when(in_text & (late == 0), -1).otherwise(0)
    rows = _events(told).withColumn("_found", F.sum("step").over(so_far)).withColumn("_held", F.sum(opened).over(so_far))
    rows = rows.withColumn("_reach", F.max("reach").over(so_far)).withColumn("_to", F.coalesce(F.shiftright(F.lead("place").over(order), 2).cast("int"), at))
    to = F.col("_to")
    found, free, inside = F.col("_found") > 0, F.col("_held") == 0, (to > at) & (at < F.col("length"))
    # stretches lie side by side from the start of the text; places without characters are none
    false = inside & free & found
    passed = lambda c: F.coalesce(F.max(F.when(c, to)).over(before), F.lit(0))
    rows = rows.withColumn("_covered", F.coalesce(F.sum(F.when(found, to - at).otherwise(0)).over(before), F.lit(0)))
    # where the last stretch that is no false positive ends, and the last one with a span
    rows = rows.withColumn("_from", passed(inside & ~(free & found))).withColumn("_gap", passed(inside & ~free))
    rows = rows.withColumn("fp", (false & (F.col("_from") == at)).cast("int"))
    whole = (F.col("_from") == F.col("_gap")) & ((late == 2) | (inside & ~free)) & (at - F.col("_gap") >= LEAST_GAP)
    of = lambda n: F.max(F.when(late == n, F.col("_covered")))
    return rows.groupBy("doc_id", "start", "end", "colour").agg(
        (of(0) - of(1)).alias("covered"), F.coalesce(F.max(F.when(late == 0, F.col("_reach") > F.col("start"))), F.lit(False)).alias("met"),
        F.max("look").alias("look"), F.max("length").alias("length"), F.sum("fp").alias("fp"), F.sum(whole.cast("int")).alias("whole"),
    )


def linked(spans: DataFrame) -> DataFrame:
    """Spans of swept() with coverage, lone (the code point of one that is a single character), grp (the number of their group of
    connected neighbours) and mark_1 and mark_2, the code points of what connects them to the one before."""
    order = Window.partitionBy("doc_id").orderBy("start", "end", "colour")
    own, last = _seen(F.col("look")), _seen(F.col("_look"))
    rows = spans
    for c in ("end", "colour", "look"):
        rows = rows.withColumn(f"_{c}", F.lag(c).over(order))
    gap = F.greatest(F.least("start", "length") - F.least("_end", "length"), F.lit(0))
    one, codes = last["one"], lambda chars: [ord(c) for c in chars]
    closers = codes(BRACKETS.values())
    alnum = one.between(48, 57) | one.between(65, 90) | one.between(97, 122)
    closed = (gap >= 1) & (one == ord(" ")) & last["tail"].isin(closers)
    plain = (gap == 1) & ~one.isin(codes(NO_CONNECTORS)) & ~alnum
    fraction = (gap == 1) & (one == ord("/")) & last["digits"] & own["digits"]
    bracket = (gap == 2) & one.isin(closers) & (last["space"] | last["tab"])
    # the first span of a text has no neighbour before it
    how = F.when(F.col("_look").isNull(), 0).when(closed, 1).when(plain, 2).when(fraction, 3).when(bracket, 4).otherwise(0)
    rows = rows.withColumn("_how", how)
    how = F.col("_how")
    # mandatory neighbours join by plain connectors only, contextual ones by all
    joined = (F.col("_colour") == F.col("colour")) & F.when(F.col("colour") == 0, how == 2).otherwise(how > 0)
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("grp", F.sum(F.when(F.coalesce(joined, F.lit(False)), 0).otherwise(1)).over(so_far))
    first = F.when(how == 1, last["tail"]).when(how > 1, one)
    second = F.when(how == 1, one).when(how == 4, F.when(last["tab"], 9).otherwise(32))
    return rows.select(
        "doc_id", "start", "end", "colour", (F.col("covered") / (F.col("end") - F.col("start"))).alias("coverage"), "met",
        F.when(own["lone"], own["tail"]).alias("lone"), "grp", first.alias("mark_1"), second.alias("mark_2"), "fp", "whole",
    )


def kept_pairs(told: DataFrame, spans: DataFrame) -> DataFrame:
    """Pairs of delimiters (doc_id, o, e, opener, closer; start and end around both) that touch something contextual and hold nothing mandatory."""
    pairs = told.where(F.size("signs") > 1).select("doc_id", F.explode(matched_pairs("signs")).alias("p")).select("doc_id", "p.*", F.col("p.o").alias("start"), (F.col("p.e") + 1).alias("end"))
    near = intervals.touched(pairs, spans.where("colour = 1"))
    return intervals.holding(near, spans.where("colour = 0")).where("not _holds").drop("_holds")


def _behind(at: Column, late: int, *columns: Column, side: str) -> list[Column]:
    return [F.col("doc_id"), at.alias("_at"), F.lit(late).alias("_late"), F.struct(*columns).alias(side)]


def _latest(asked: DataFrame, given: DataFrame, order: list[Column]) -> DataFrame:
    """asked with the last of given that stands at or before it in the order of a document."""
    so_far = Window.partitionBy("doc_id").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    points = asked.unionByName(given, allowMissingColumns=True)
    return points.withColumn("given", F.last("given", True).over(so_far)).where("_late = 1")


def entities(yellow: DataFrame, pairs: DataFrame) -> DataFrame:
    """Contextual spans with entity: groups of neighbours, joined where an outermost pair holds spans of both."""
    before = Window.partitionBy("doc_id").orderBy("o").rowsBetween(Window.unboundedPreceding, -1)
    outer = pairs.withColumn("_reach", F.max("e").over(before)).where("_reach is null or e > _reach")
    given = outer.select(*_behind(F.col("o"), 0, F.col("o"), F.col("e"), side="given"))
    asked = yellow.select(*_behind(F.col("start"), 1, *(F.col(c) for c in yellow.columns), side="row"))
    rows = _latest(asked, given, [F.col("_at"), F.col("_late")])
    inside = F.col("row.end") <= F.col("given.e") + 1
    rows = rows.select("row.*", F.when(inside, F.col("given.o")).alias("_pair"))
    order = Window.partitionBy("doc_id").orderBy("start", "end")
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    held = F.col("_pair").isNotNull()
    rows = rows.withColumn("_grp", F.last(F.when(held, F.col("grp")), True).over(earlier)).withColumn("_before", F.last("_pair", True).over(earlier))
    same = (F.col("_grp") == F.col("grp")) | (F.col("_before") == F.col("_pair"))
    fresh = F.when(held & ~F.coalesce(same, F.lit(False)), 1).otherwise(0)
    rows = rows.withColumn("_n", F.sum(fresh).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    of_group = F.max(F.when(held, F.col("_n"))).over(Window.partitionBy("doc_id", "grp"))
    # a group without a held span is an entity by itself; its number is told apart by its sign
    return rows.withColumn("entity", F.coalesce(of_group, -F.col("grp"))).drop("_pair", "_grp", "_before", "_n")


def _ends(yellow: DataFrame, pairs: DataFrame) -> DataFrame:
    """doc_id, o, e, grp of the first contextual span that holds the opener or the closer of a pair, as far as there is one."""
    order = Window.partitionBy("doc_id").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    # the first span that reaches beyond a place is one that reaches further than all before it
    records = yellow.withColumn("_reach", F.max("end").over(order)).where("_reach is null or end > _reach")
    given = records.select(*_behind(F.col("end") - 1, 0, F.col("start"), F.col("grp"), side="given"))
    places = pairs.select("doc_id", "o", "e", F.explode(F.array("o", "e")).alias("_p"))
    asked = places.select(*_behind(F.col("_p"), 1, F.col("o"), F.col("e"), side="row"))
    rows = _latest(asked, given, [F.col("_at").desc(), F.col("_late")])
    return rows.where("given.start <= _at").select("doc_id", "row.o", "row.e", "given.grp").distinct()


def hit_groups(yellow: DataFrame, pairs: DataFrame) -> DataFrame:
    """doc_id, grp of the contextual groups that the prediction touches, and of all that these carry along.

    A group that holds an end of a pair carries along what lies inside of the pair. Each round follows only the groups
    that the last one has added; it ends when there are none, after as many rounds as the longest chain has pairs.
    """
    added = found = stored(yellow.where("met").select("doc_id", "grp").distinct())
    ends = stored(_ends(yellow, pairs))
    while not ends.isEmpty() and not added.isEmpty():
        reached = ends.join(added, ["doc_id", "grp"], "left_semi").select("doc_id", F.col("o").alias("_at"), F.lit(0).alias("_late"), F.col("e").alias("_reach"))
        asked = yellow.select("doc_id", F.col("start").alias("_at"), F.lit(1).alias("_late"), "end", "grp")
        so_far = Window.partitionBy("doc_id").orderBy("_at", "_late").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        rows = asked.unionByName(reached, allowMissingColumns=True).withColumn("_reach", F.max("_reach").over(so_far))
        held = rows.where("_late = 1 and end <= _reach").select("doc_id", "grp").distinct()
        added = stored(held.join(found, ["doc_id", "grp"], "left_anti"))
        found = found.unionByName(added)
    return found


def _entity_terms(entities: DataFrame) -> DataFrame:
    """doc_id, kind, n, d, fp, whole of entities with colour, red, hit and share; the row without a span has no kind."""
    share, zero, red = F.col("share"), F.lit(0.0), F.col("red")
    mandatory, skipped = F.col("colour") == 0, F.col("colour").isNull() | (F.col("colour") == 1) & ~F.coalesce("hit", F.lit(False))
    kind = F.when(mandatory, "mandatory").when(F.col("colour").isNull(), None).when(skipped, "skipped").otherwise("contextual")
    n = F.when(mandatory, share).when(skipped | red, zero).otherwise(share)
    d = F.when(mandatory, 1.0).when(skipped, zero).when(red, 1.0 - share).otherwise(1.0)
    return entities.select("doc_id", kind.alias("kind"), n.alias("n"), d.alias("d"), "fp", "whole")


def _plain_terms(told: DataFrame) -> DataFrame:
    """Terms of documents without pairs of delimiters: their entities are groups of neighbours, and hits do not spread.

    All of a document meets in one task and stays there.
    """
    own = Window.partitionBy("doc_id")
    rows = linked(swept(told))
    known = F.array_contains(F.collect_set("mark_1").over(own), F.col("lone")) | F.array_contains(F.collect_set("mark_2").over(own), F.col("lone"))
    rows = rows.withColumn("_known", F.coalesce(known, F.lit(False))).withColumn("_red", F.coalesce(F.max(F.col("colour") == 0).over(own), F.lit(False)))
    entities = rows.groupBy("doc_id", "colour", "grp").agg(
        F.max("_red").alias("red"), F.max("met").alias("hit"), F.avg("coverage").alias("share"),
        (F.max("_known") & (F.count("*") == 1) & (F.max("colour") == 1)).alias("_mark"), F.sum("fp").alias("fp"), F.sum("whole").alias("whole"),
    )
    # a lone mark is no entity; its row keeps the false positives that end there
    colour = F.when(F.coalesce("_mark", F.lit(False)), None).otherwise(F.col("colour"))
    return _entity_terms(entities.withColumn("colour", colour))


def _paired_terms(told: DataFrame) -> DataFrame:
    """Terms of documents with pairs of delimiters, which join groups to entities and carry hits along."""
    rows = stored(linked(swept(told)).join(told.select("doc_id", "red"), "doc_id"))
    spans, none = rows.where("start is not null"), F.lit(0).cast("long")
    mandatory = spans.where("colour = 0").groupBy("doc_id", "grp").agg(F.lit(0).alias("colour"), F.lit(True).alias("red"), F.lit(True).alias("hit"), F.avg("coverage").alias("share"), none.alias("fp"), none.alias("whole"))
    false = rows.groupBy("doc_id").agg(F.lit(None).cast("int").alias("colour"), F.sum("fp").alias("fp"), F.sum("whole").alias("whole"))
    pairs = stored(kept_pairs(told, spans.select("doc_id", "start", "end", "colour")))
    yellow = spans.where("colour = 1").select("doc_id", "start", "end", "grp", "coverage", "met", "lone", "red")
    hit = hit_groups(yellow, pairs).withColumn("hit", F.lit(True))
    by_entity = entities(yellow, pairs).join(hit, ["doc_id", "grp"], "left").groupBy("doc_id", "entity").agg(
        F.count("*").alias("_size"), F.max("lone").alias("mark"), F.lit(1).alias("colour"), F.max("red").alias("red"), F.max("hit").alias("hit"),
        F.avg(F.when(F.col("hit"), F.col("coverage"))).alias("share"), none.alias("fp"), none.alias("whole"),
    )
    signs = pairs.select("doc_id", F.explode(F.array(F.ascii("opener"), F.ascii("closer"))).alias("mark"))
    marks = spans.select("doc_id", F.explode(F.array("mark_1", "mark_2")).alias("mark")).where("mark is not null").unionByName(signs).distinct().withColumn("_known", F.lit(True))
    by_entity = by_entity.join(marks, ["doc_id", "mark"], "left").where("_known is null or _size > 1")
    some = mandatory.unionByName(by_entity.select(*(c for c in mandatory.columns if c != "grp")), allowMissingColumns=True)
    return _entity_terms(some.unionByName(false, allowMissingColumns=True))


def _terms(df: DataFrame) -> list[DataFrame]:
    """Terms of df's documents in two tables, each with all of a document: most have no pair of delimiters, and need no table but facts()."""
    told = stored(facts(df.where("doc_id is not null")))
    return [_plain_terms(told.where("size(signs) < 2")), _paired_terms(told.where("size(signs) > 1"))]


def score_terms(df: DataFrame) -> DataFrame:
    """doc_id, kind, n, d of every entity and false positive of df's documents; skipped entities have zeros.

    df has doc_id, text, spans array<struct<start,end,category>>, predictions array<struct<start,end>>. An id names one
    document; documents without an id are left out. Null texts are empty, null arrays have no elements.
    """
    plain, paired = _terms(df)
    rows = plain.unionByName(paired)
    times = F.concat(F.array_repeat(F.lit(2.0), F.col("whole").cast("int")), F.array_repeat(F.lit(1.0), (F.col("fp") - F.col("whole")).cast("int")))
    false = rows.where("fp > 0 or whole > 0").groupBy("doc_id").agg(F.sum("fp").alias("fp"), F.sum("whole").alias("whole"))
    false = false.select("doc_id", F.lit("false_positive").alias("kind"), F.lit(0.0).alias("n"), F.explode(times).alias("d"))
    return rows.where("kind is not null").select("doc_id", "kind", "n", "d").unionByName(false)


def scores(df: DataFrame) -> DataFrame:
    """n, d, r and the number of terms of each kind, a row for each document of df (as score_terms() takes it); without terms all are zero."""
    number = lambda kind: F.count(F.when(F.col("kind") == kind, 1))
    plain, paired = (
        part.groupBy("doc_id").agg(
            F.sum("n").alias("n"), (F.sum("d") + F.sum("fp") + F.sum("whole")).alias("d"), number("mandatory").alias("n_mandatory"), number("contextual").alias("n_contextual"),
            F.sum("fp").alias("n_fp"), number("skipped").alias("skipped"),
        )
        for part in _terms(df)
    )
    summed = plain.unionByName(paired)
    rows = df.select("doc_id").join(summed, "doc_id", "left").fillna(0, summed.columns[1:])
    return rows.withColumn("r", F.when(F.col("d") > 0, F.col("n") / F.col("d")).otherwise(0.0))


def report(score: DataFrame, categories: DataFrame) -> DataFrame:
    """Mean, p20, p50 and number of documents over all (category is null) and by category; empty categories have no row."""
    joined = score.join(categories, "doc_id", "left").select("r", F.col("category").alias("own"))
    groups = F.array(F.struct(F.lit(True).alias("_all"), F.lit(None).cast("string").alias("category")), F.struct(F.lit(False).alias("_all"), F.col("own").alias("category")))
    rows = joined.select("r", F.explode(groups).alias("g")).select("r", "g.*").where("_all or coalesce(category, '') <> ''")
    means = rows.groupBy("_all", "category").agg(F.avg("r").alias("mean"), F.count("*").alias("n"))
    parts = evaluation.quantiles(rows, ["_all", "category"], "r", {"p20": 0.2, "p50": 0.5})
    parts = parts.select(F.col("_all").alias("_a"), F.col("category").alias("_c"), "p20", "p50")
    return means.join(parts, (F.col("_all") == F.col("_a")) & F.col("category").eqNullSafe(F.col("_c"))).select("category", "mean", "p20", "p50", "n")
