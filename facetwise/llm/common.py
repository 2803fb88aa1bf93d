"""Shared pieces of the training-data operators: words, broadcast objects, hashing."""

from __future__ import annotations

import pickle
import zlib

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from facetwise.scratch import Scratch

__all__ = ["Scratch", "Shared", "crc32_mod", "crc32_of", "texts", "words"]

#: Every byte that is no part of a word becomes a space; A-Z become a-z.
WORD_TABLE = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)


def words(text: bytes) -> list[bytes]:
    """Maximal runs of ASCII letters, digits and non-ASCII characters, A-Z lower-cased."""
    return text.translate(WORD_TABLE).split()


def texts(column) -> list[bytes]:
    """A string column of an Arrow batch as UTF-8; null becomes empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [x or b"" for x in column.cast(kind).to_pylist()]


def crc32_mod(column, n: int):
    """crc32 of the decimal text of a key, modulo n; null counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")), F.lit(n)).cast("int")


def crc32_of(value) -> int:
    return zlib.crc32(b"" if value is None else str(value).encode())


class Shared:
    """A broadcast object, pickled with the code of its class so that executors need no copy of this package."""

    def __init__(self, spark: SparkSession, value):
        self._sent = spark.sparkContext.broadcast(cloudpickle.dumps(value))

    @property
    def value(self):
        if "_value" not in self.__dict__:
            self._value = pickle.loads(self._sent.value)
        return self._value
