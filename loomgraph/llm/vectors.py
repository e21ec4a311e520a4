"""Integer vectors: kept rows, cut to whole numbers, as matrices inside tasks, and exact sums of them over all tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Whole numbers up to here are exact in double precision.
EXACT = 1 << 53
_LIMB = 1 << 80


def finite(vector: Column) -> Column:
    """Whether a vector is there, and all its components are there and finite."""
    return vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))


def integers(df: DataFrame, scale: int, into: str, vector: str = "embedding", multiple: int = 1) -> tuple[DataFrame, int]:
    """The rows whose vector is finite, with ``into``: each component as floor(scale * x), vectors padded with zeros to one length, the longest
    one's or the next multiple; and that length. A component beyond a long becomes the largest or smallest long."""
    kept = df.where(finite(F.col(vector)))
    dims = kept.agg(F.max(F.size(vector))).first()[0] or 0
    dims = -(-dims // multiple) * multiple
    at = F.col(vector)
    padded = F.concat(at, F.array_repeat(F.lit(0.0).cast(df.schema[vector].dataType.elementType), F.lit(dims) - F.size(at)))
    return kept.withColumn(into, F.transform(padded, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("long"))), dims


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    """Rows of a column of equally long lists."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dims)


def largest(*arrays: np.ndarray) -> int:
    """The largest absolute value, exactly."""
    return max((max(abs(int(a.max())), abs(int(a.min()))) for a in arrays if a.size), default=0)


def gram(x: np.ndarray) -> np.ndarray:
    """x.T @ x of whole numbers, exactly: in double precision as far as its sums stay exact, else in Python's numbers."""
    most = largest(x)
    rows = EXACT // max(1, most * most)
    if not rows:
        wide = x.astype(object)
        return wide.T.dot(wide) if len(x) else np.zeros((x.shape[1],) * 2, object)
    out = np.zeros((x.shape[1],) * 2, object)
    for k in range(0, len(x), rows := min(rows, 8192)):
        part = x[k : k + rows].astype(np.float64)
        out += (part.T @ part).astype(np.int64).astype(object)
    return out


def exact_sums(df: DataFrame, of: Callable[[pa.RecordBatch], np.ndarray], width: int) -> list[int]:
    """The sums, over all batches of all tasks, of the ``width`` whole numbers that a batch gives: exact, of any size, the same in any order.
    What reaches the driver has as many rows as there are numbers."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width, object)
        for batch in batches:
            total += of(batch)
        some = [i for i in range(width) if total[i]]
        limbs = [divmod(int(total[i]), _LIMB) for i in some]
        wide = pa.decimal128(38, 0)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([x for x, _ in limbs], wide), pa.array([x for _, x in limbs], wide)], ["at", "high", "low"])

    got = df.mapInArrow(partial, "at int, high decimal(38,0), low decimal(38,0)").groupBy("at").agg(F.sum("high").alias("high"), F.sum("low").alias("low"))
    out = [0] * width
    for r in got.toArrow().to_pylist():
        out[r["at"]] = int(r["high"]) * _LIMB + int(r["low"])
    return out
