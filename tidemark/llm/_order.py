"""Numbers and running totals in an order that Spark deals out by ranges, so that no task holds a whole key or table."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm._work import saved

#: Rows of a partition that monotonically_increasing_id can tell apart.
_BITS = 33


def numbered(df: DataFrame, order: Sequence[Column], name: str) -> DataFrame:
    """`df` with each row's number in `order` as the column `name`, from 1.

    Ranges are sorted by themselves and moved by the counts of those before; of these a row per
    partition comes to the driver. Rows equal in `order` take any of their numbers.
    """
    ranged = saved(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(name, F.monotonically_increasing_id()))
    part = F.shiftright(name, _BITS)
    counts = ranged.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect()
    before, moves = 0, []
    for r in sorted(counts, key=lambda r: r["part"]):
        moves.append((r["part"], before + 1))
        before += r["n"]
    moved = df.sparkSession.createDataFrame(moves, "_part long, _move long")
    return ranged.join(F.broadcast(moved), part == F.col("_part")).withColumn(name, F.col(name).bitwiseAND(F.lit((1 << _BITS) - 1)) + F.col("_move")).drop("_part", "_move")


def _inside(values: np.ndarray, starts: np.ndarray, first: np.ndarray, carry, xor: bool) -> np.ndarray:
    """Running totals that begin again at each of `starts`; `first` rows go on from `carry`."""
    total = np.bitwise_xor.accumulate(values) if xor else np.cumsum(values)
    base = np.where(starts > 0, total[starts - 1], 0)
    if xor:
        return total ^ np.where(first, carry, base)
    return total - base + np.where(first, carry, 0)


def running(df: DataFrame, key: str, order: Sequence[Column], sums: dict[str, str], xors: dict[str, str] | None = None) -> DataFrame:
    """`df` with running totals of long columns among the rows of each `key` (a long, not null) in `order`: name -> column.

    Rows are dealt by ranges of key and order, so a key may spread over any number of tasks. Each range
    totals its own rows; only its first key can have begun before, and takes what the ranges before hold
    of it: a row per partition comes to the driver for this.
    """
    xors = xors or {}
    names = [*sums, *xors]
    sorted_ = df.repartitionByRange(F.col(key), *order).sortWithinPartitions(F.col(key), *order)
    schema = T.StructType([*df.schema.fields, *(T.StructField(n, T.LongType()) for n in names), T.StructField("_part", T.LongType()), T.StructField("_row", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, carry, row = TaskContext.get().partitionId(), None, dict.fromkeys(names, 0), 0
        for batch in batches:
            n = len(batch)
            if not n:
                continue
            keys = batch.column(key).to_numpy()
            new = np.ones(n, bool)
            new[1:] = keys[1:] != keys[:-1]
            starts = np.maximum.accumulate(np.where(new, np.arange(n), 0))
            first = starts == 0 if keys[0] == last else np.zeros(n, bool)
            out = list(batch.columns)
            for name in names:
                values = batch.column(sums.get(name) or xors[name]).to_numpy().astype(np.int64)
                total = _inside(values, starts, first, carry[name], name in xors)
                carry[name] = int(total[-1])
                out.append(pa.array(total, pa.int64()))
            last = keys[-1]
            out += [pa.array(np.full(n, part), pa.int64()), pa.array(np.arange(row, row + n), pa.int64())]
            row += n
            yield pa.RecordBatch.from_arrays(out, [f.name for f in schema])

    ranged = saved(sorted_.mapInArrow(run, schema))
    ends = ranged.groupBy("_part").agg(F.min(key).alias("low"), F.max(key).alias("high"), F.max_by(F.struct(*names), "_row").alias("total")).collect()
    moves, before, carry = [], None, {}
    for r in sorted(ends, key=lambda r: r["_part"]):
        if r["low"] == before:
            moves.append((r["_part"], before, *(carry[n] for n in names)))
        goes_on = r["low"] == before == r["high"]
        for n in names:
            carry[n] = r["total"][n] if not goes_on else carry[n] ^ r["total"][n] if n in xors else carry[n] + r["total"][n]
        before = r["high"]
    moved = df.sparkSession.createDataFrame(moves, ", ".join(["_part long", "_key long", *(f"_{n} long" for n in names)]))
    out = ranged.join(F.broadcast(moved), (ranged["_part"] == moved["_part"]) & (ranged[key] == moved["_key"]), "left")
    zero = F.lit(0).cast("long")
    totals = [(F.col(n).bitwiseXOR(F.coalesce(f"_{n}", zero)) if n in xors else F.col(n) + F.coalesce(f"_{n}", zero)).alias(n) for n in names]
    return out.select(*(ranged[c] for c in df.columns), *totals)
