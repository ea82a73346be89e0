"""Texts in chunks that are redacted on their own."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def split_chunks(text: str, chars: int, most_bytes: int) -> list[str]:
    """The longest pieces within both budgets, from the left; a character over the byte budget stands alone."""
    if text.isascii():
        step = max(1, min(chars, most_bytes))
        return [text[i : i + step] for i in range(0, len(text), step)]
    out, begin, size, n = [], 0, 0, 0
    for i, c in enumerate(text):
        width = len(c.encode())
        if n and (n == chars or size + width > most_bytes):
            out.append(text[begin:i])
            begin, size, n = i, 0, 0
        size += width
        n += 1
    return [*out, text[begin:]] if n else out


def chunk_table(df: DataFrame, key: str, text: str, chars: int, most_bytes: int) -> DataFrame:
    """key, chunk_ix and chunk: pieces within a budget of characters and of UTF-8 bytes.

    Bytes make the cut depend on all that stands before it, so this is an Arrow function; see ascii_chunks.
    """
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, at, pieces = [], [], []
            for k, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for i, piece in enumerate(split_chunks(value or "", chars, most_bytes)):
                    keys.append(k)
                    at.append(i)
                    pieces.append(piece)
            columns = [pa.array(keys, batch.schema.types[0]), pa.array(at, pa.int32()), pa.array(pieces, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=[key, "chunk_ix", "chunk"])

    return df.select(key, text).mapInArrow(run, f"{key} {kind}, chunk_ix int, chunk string")


def ascii_chunks(text: Column, step: int) -> Column:
    """Chunks of texts where a character is a byte, in the JVM."""
    n = F.ceil(F.length(text) / F.lit(step)).cast("int")
    places = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.expr("cast(array() as array<int>)"))
    return F.transform(places, lambda i: F.substring(text, i * step + 1, F.lit(step)))


def event_lines(df: DataFrame, key: str, payload: str, order: str) -> DataFrame:
    """Server-sent events: a data line for each row in order, and a last one that tells that all came."""
    lines = df.select(key, F.col(order).cast("long").alias("event_ix"), F.concat(F.lit("data: "), F.col(payload), F.lit("\n\n")).alias("line"))
    ends = df.groupBy(key).agg((F.max(order) + 1).cast("long").alias("event_ix"))
    return lines.unionByName(ends.withColumn("line", F.lit("data: [DONE]\n\n")))


def stream_completed(body: Column) -> Column:
    """Whether an event stream told that all came, before any error: the first line that tells either decides."""
    data = F.regexp_extract_all(body, F.lit(r"(?m)^(?:[ \t]*data: \[DONE\][ \t]*\r?$|data: .*)"), F.lit(0))
    done = lambda line: F.trim(F.replace(line, F.lit("\r"))) == "data: [DONE]"
    failed = lambda line: F.coalesce(F.array_contains(F.json_object_keys(F.substring(line, 7, 1 << 30)), "error"), F.lit(False))
    first = F.get(F.filter(data, lambda line: done(line) | failed(line)), F.lit(0))
    return F.coalesce(done(first), F.lit(False))
