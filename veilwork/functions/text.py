"""Scalar functions: keyed hashes, placeholders, labels, categories."""

from __future__ import annotations

import hashlib
from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from veilwork.functions.rules import CATEGORY_LABELS, CATEGORY_WORDS, MODEL_LABELS, OTHER_CATEGORY, OTHER_TYPE


def hmac_sha256(key: str, message: Column) -> Column:
    """Hex digest; the key is a constant of the plan, so both pads are literals."""
    raw = key.encode()
    raw = (hashlib.sha256(raw).digest() if len(raw) > 64 else raw).ljust(64, b"\0")
    inner, outer = bytes(b ^ 0x36 for b in raw), bytes(b ^ 0x5C for b in raw)
    first = F.sha2(F.concat(F.lit(inner), F.encode(message, "UTF-8")), 256)
    return F.sha2(F.concat(F.lit(outer), F.unhex(first)), 256)


def render(fmt: str, value: Column, kind: Column) -> Column:
    """A format with {last4}, {text} and {type}, filled one after the other; others stay as they are."""
    out = F.lit(fmt)
    for mark, filled in (("{last4}", F.right(value, F.lit(4))), ("{text}", value), ("{type}", kind)):
        out = F.replace(out, F.lit(mark), filled)
    return out


def placeholder(kind: Column, number: Column) -> Column:
    return F.format_string("[%s_%04d]", F.upper(kind), number)


def seed_signature(text: Column, seed: str) -> Column:
    """A placeholder with four hex digits that depend on it and on the seed."""
    return F.concat(text, F.lit("-"), F.substring(F.sha2(F.concat(F.lit(f"{seed}|"), text), 256), 1, 4))


def lookup(table: dict[str, str], key: Column) -> Column:
    return F.create_map(*(F.lit(x) for x in chain.from_iterable(table.items())))[key]


def sanitize_label(label: Column) -> Column:
    """The span type of a model's label."""
    # the ends lose Unicode white space before spaces and dashes within become underscores
    bare = F.regexp_replace(F.lower(label), r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")
    cleaned = F.replace(F.replace(bare, F.lit(" "), F.lit("_")), F.lit("-"), F.lit("_"))
    return F.coalesce(lookup(MODEL_LABELS, cleaned), F.lit(OTHER_TYPE))


def category(text: Column, labels: Column | None = None) -> Column:
    """A document's category by its labels, else by words in it, else operations."""
    lowered, out = F.lower(text), None
    conditions = []
    if labels is not None:
        for name, own in CATEGORY_LABELS.items():
            conditions.append((F.arrays_overlap(labels, F.array(*map(F.lit, own))), name))
    for name, words in CATEGORY_WORDS:
        found = F.lit(False)
        for w in words:
            found = found | F.contains(lowered, F.lit(w))
        conditions.append((found, name))
    for condition, name in conditions:
        out = F.when(condition, name) if out is None else out.when(condition, name)
    return out.otherwise(OTHER_CATEGORY)


def normalize_text(text: Column) -> Column:
    """Line ends as \\n, no white space at either end."""
    return F.regexp_replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def benchmark_text(mode: Column, text: Column, number: Column) -> Column:
    """The text of a load test's request: with its number for cold caches, as it is for hot ones."""
    return F.when(mode == "cache-cold", F.concat(text, F.lit(" request-"), number.cast("string"))).otherwise(text)
