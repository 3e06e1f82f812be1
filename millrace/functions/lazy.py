"""Arrow functions that are made when first used, since their types need a running session."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType

#: Bytes of the first column that a paged function sees at once; a larger row comes alone.
PIECE = 1 << 20


def arrow_udf(schema: str):
    """Decorator: the function over pandas Series becomes a function of Columns."""

    def wrap(f):
        made = functools.cache(lambda: F.pandas_udf(f, schema))

        @functools.wraps(f, assigned=("__doc__", "__name__"))
        def call(*columns):
            return made()(*columns)

        del call.__wrapped__
        return call

    return wrap


def pieces(column: pa.Array, limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose texts have about ``limit`` bytes, or are one; 256 rows at most."""
    lo, total = 0, 0
    for i, n in enumerate(pc.binary_length(column).fill_null(0).to_pylist()):
        if i > lo and (total + n > limit or i - lo == 256):
            yield lo, i
            lo, total = i, 0
        total += n
    if lo < len(column):
        yield lo, len(column)


def paged_udf(schema: str):
    """Decorator: the function over lists of values becomes a function of Columns, for rows that are whole pages.

    It sees a few rows at a time and passes on what it makes of them, so that a task holds no objects of all rows of its Arrow batch.
    """

    def wrap(f):
        @functools.cache
        def made():
            kind = to_arrow_type(DataType.fromDDL(schema))

            def run(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
                for columns in batches:
                    for lo, hi in pieces(columns[0], PIECE):
                        yield pa.array(f(*[c.slice(lo, hi - lo).to_pylist() for c in columns]), kind)

            def alone(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
                return run((c,) for c in batches)

            return {False: F.arrow_udf(run, schema), True: F.arrow_udf(alone, schema)}

        @functools.wraps(f, assigned=("__doc__", "__name__"))
        def call(*columns):
            return made()[len(columns) == 1](*columns)

        del call.__wrapped__
        return call

    return wrap
