"""Small helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilwork.sources.shared import clear, session_folder, shared_folder, stored

__all__ = ["BLANK", "WORD", "clear", "documents", "pages", "session_folder", "shared_folder", "stored", "texts_of", "thin", "unwrapped", "utf8_of", "wrapped"]

#: ASCII white space that separates words everywhere in this subpackage.
BLANK = "\x20\x09-\x0d"
WORD = rf"[^\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet")


def wrapped(df: DataFrame) -> DataFrame:
    """df with all its columns in one, row, so that any other names are free."""
    return df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row"))


def unwrapped(df: DataFrame, columns: list[str], new: dict[str, Column] | None = None) -> DataFrame:
    """The columns of row, some of them new."""
    return df.select(*((new or {}).get(c, F.col("row").getField(c)).alias(c) for c in columns))


#: Rows of a batch that are worked on together where results are as large as texts.
THIN_ROWS = 500


def thin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of THIN_ROWS, so that what is made of a batch before it leaves stays small."""
    for batch in batches:
        for begin in range(0, batch.num_rows, THIN_ROWS):
            yield batch.slice(begin, THIN_ROWS)


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """The texts of a batch; a null text is an empty one."""
    return ["" if t is None else t for t in batch.column(column).to_pylist()]


def utf8_of(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """The texts of a batch as UTF-8; a null text is an empty one."""
    return [t or b"" for t in batch.column(column).cast(pa.binary()).to_pylist()]
