"""Text files in one of several encodings."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Encodings in the order in which they are tried.
ENCODINGS = ("utf-8-sig", "utf-8", "cp932", "euc-jp")


def decode_text(content: Column, encodings: Sequence[str] = ENCODINGS, strict: bool = True) -> Column:
    """Text of a binary column in the first encoding that fits; none raises, or gives NULL if not strict.

    Valid UTF-8, which the first two default encodings read, stays in the JVM, its byte-order mark stripped. Only other rows
    reach the Arrow UDF; Spark's own decoder does not know cp932.
    """
    names = tuple(encodings)

    @F.pandas_udf("string")
    def decode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        def one(raw):
            if raw is None:
                return None
            for name in names:
                try:
                    return bytes(raw).decode(name)
                except UnicodeDecodeError:
                    continue
            if strict:
                raise ValueError(f"none of {', '.join(names)} can read a text of {len(raw)} bytes")
            return None

        for batch in batches:
            yield batch.map(one, na_action=None).astype(object)

    if names[:2] != ENCODINGS[:2]:
        return decode(content)
    return F.when(_is_utf8(content), _plain(content)).otherwise(decode(F.when(~_is_utf8(content), content)))


def _is_utf8(content: Column) -> Column:
    return F.is_valid_utf8(content.cast("string"))


def _plain(content: Column) -> Column:
    """Valid UTF-8 as text, without a byte-order mark."""
    marked = F.substring(content, 1, 3) == F.unhex(F.lit("EFBBBF"))
    return F.when(marked, F.substring(content, 4, F.octet_length(content))).otherwise(content).cast("string")


def decode_rows(df: DataFrame, content: str = "content", encodings: Sequence[str] = ENCODINGS, strict: bool = True) -> DataFrame:
    """The frame with ``content`` decoded as ``decode_text`` does, with Python only if and where it is needed.

    A look for a first row that is not UTF-8 comes before; where there is none the plan has no Python stage. Otherwise
    UTF-8 rows and others are two branches, and a worker sees the others alone. The branches read ``df`` anew, so
    it should be a stored table or files.
    """
    at = F.col(content)
    if tuple(encodings)[:2] != ENCODINGS[:2]:
        return df.withColumn(content, decode_text(at, encodings, strict))
    plain = F.coalesce(_is_utf8(at), F.lit(True))
    if df.where(~plain).isEmpty():
        return df.withColumn(content, _plain(at))
    others = df.where(~plain).withColumn(content, decode_text(at, encodings, strict))
    return df.where(plain).withColumn(content, _plain(at)).unionByName(others)


def read_text_files(spark: SparkSession, path: str, encodings: Sequence[str] = ENCODINGS, strict: bool = True) -> DataFrame:
    """``path, content`` of whole text files."""
    return decode_rows(spark.read.format("binaryFile").load(path).select("path", "content"), "content", encodings, strict)
