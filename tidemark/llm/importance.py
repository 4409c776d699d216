"""Importance resampling towards a target distribution of hashed n-grams."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm._order import numbered
from tidemark.llm._pieces import Words
from tidemark.llm._text import LOWER, bounds, chunks, column_bytes, ragged
from tidemark.llm._work import fresh, saved

#: Runs of GRAMS[0] to GRAMS[1] words are features, in BUCKETS buckets.
GRAMS, BUCKETS = (1, 1), 10_000
#: Share drawn of the documents of LEAST_WORDS words, in percent, and the seed of the draw.
PERCENT, LEAST_WORDS, SEED = 10, 20, 2024
#: Rank error of the quantile sketch, as a share of the documents.
SKETCH_ERROR = 0.001
#: Bytes of words: digits, a-z and all beyond ASCII.
_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True


class Features:
    """Buckets of the features of texts; each distinct feature is hashed once."""

    def __init__(self, grams: tuple[int, int], buckets: int):
        self.grams, self.buckets = grams, buckets
        self.forget()

    def forget(self) -> None:
        self.words, self.bucket = Words(400_000), np.zeros(0, np.int64)

    def read(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
        """How many words each row has; for each run length the rows and buckets of all features."""
        part, at = LOWER[data[offsets[0] : offsets[-1]]], offsets - offsets[0]
        starts, ends = bounds(_WORD[part], at)
        cut = np.searchsorted(starts, at)
        n = np.diff(cut)
        sizes = ends - starts
        flat = np.full(int(sizes.sum()) + len(sizes), 32, np.uint8)
        begin = np.cumsum(sizes + 1) - sizes - 1
        flat[ragged(begin, sizes)] = part[ragged(starts, sizes)]
        out = []
        for size in range(self.grams[0], self.grams[1] + 1):
            if self.words.full():
                self.forget()
            many = np.maximum(n - size + 1, 0)
            low = ragged(cut[:-1], many)
            high = low + size - 1
            numbers, new = self.words.number(flat, begin[low], begin[high] + sizes[high])
            self.bucket = np.concatenate([self.bucket, np.fromiter((zlib.crc32(w) % self.buckets for w in new), np.int64, len(new))])
            out.append((np.repeat(np.arange(len(n)), many), self.bucket[numbers]))
        return n, out


def bucket_counts(docs: DataFrame, grams: tuple[int, int] = GRAMS, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all texts fall into each bucket; each task sends one row a bucket at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, total = Features(grams, buckets), np.zeros(buckets, np.int64)
        for batch in batches:
            data, offsets = column_bytes(batch.column(0))
            for i, j in chunks(offsets):
                for _, found in features.read(data, offsets[i : j + 1])[1]:
                    total += np.bincount(found, minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], ["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for r in docs.select("text").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Each bucket's log odds of target against raw counts, in thousandths, rounded down; one is added to every count."""
    k, every, aimed = len(raw), float(raw.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1.0) * (every + k) / ((s + 1.0) * (aimed + k)))) for s, t in zip(raw.tolist(), target.tolist())], np.int64)


def weigh(docs: DataFrame, gain: np.ndarray, grams: tuple[int, int] = GRAMS) -> DataFrame:
    """doc_id, n_words, n_features, weight: the mean gain of a text's features, rounded down; 0 without any.

    `gain` has one number a bucket and goes to the tasks as an array.
    """
    names = ["doc_id", "n_words", "n_features", "weight"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features(grams, len(gain))
        for batch in batches:
            data, offsets = column_bytes(batch.column(1))
            for i, j in chunks(offsets):
                n, found = features.read(data, offsets[i : j + 1])
                count, total = np.zeros(j - i, np.int64), np.zeros(j - i, np.int64)
                for row, bucket in found:
                    count += np.bincount(row, minlength=j - i)
                    upto = np.concatenate([[0], np.cumsum(gain[bucket])])
                    total += np.diff(upto[np.searchsorted(row, np.arange(j - i + 1))])
                weight = np.where(count > 0, total // np.maximum(count, 1), 0)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), *(pa.array(x, pa.int64()) for x in (n, count, weight))], names)

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def scored(weighed: DataFrame, seed: int = SEED) -> DataFrame:
    """`weighed` with score: weight plus Gumbel noise from a hash of seed and doc_id, in thousandths; a null doc_id is hashed as an empty string."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return weighed.withColumn("score", F.col("weight") + F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))))


def bracket(rows: DataFrame, k: int, n: int, error: float = SKETCH_ERROR) -> tuple[int, int, int]:
    """low, high, above: scores between which the kth highest of n lies (1 <= k <= n), and how many are above high.

    A quantile sketch proposes low and high; the exact counts outside them decide whether the kth lies
    between, and else the bracket is widened, to all scores at last.
    """
    wide, share = error, 1 - k / n
    while True:
        if wide < 1:
            low, high = rows.approxQuantile("score", [max(0.0, share - 2 * wide), min(1.0, share + 2 * wide)], error)
        else:
            low, high = rows.agg(F.min("score"), F.max("score")).first()
        low, high = int(low), int(high)
        above, below = rows.agg(F.count_if(F.col("score") > high), F.count_if(F.col("score") < low)).first()
        if above < k <= n - below:
            return low, high, above
        wide *= 8


def draw(rows: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """`rows` (doc_id, n_words, n_features, weight, score) with rank: 1, 2, 3, ... for the drawn, else null.

    Of the N rows of `least_words` words, floor(percent * N / 100) highest scores are drawn; ties go to
    the smaller doc_id (null last), then to fewer features and smaller weights; of rows equal in all of
    these any. Only the rows in the bracket are sorted to find the last drawn one; the drawn are then
    numbered by ranges. The rows are read five times or more: save them before.
    """
    able = rows.where(F.col("n_words") >= least_words)
    n = able.count()
    k = percent * n // 100
    none = F.lit(None).cast("long").alias("rank")
    if not k:
        return rows.select("*", none)
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("n_features"), F.asc("weight")]
    low, high, above = bracket(able, k, n)
    last = numbered(able.where(F.col("score").between(low, high)).select("score", "doc_id", "n_features", "weight"), order, "at").where(F.col("at") == k - above).first()
    least, top = F.lit(last["score"]), (1 << 63) - 1
    place = F.struct(F.col("doc_id").isNull(), F.coalesce("doc_id", F.lit(top)), "n_features", "weight")
    bound = F.struct(F.lit(last["doc_id"] is None), *(F.lit(top if x is None else x).cast("long") for x in (last["doc_id"], last["n_features"], last["weight"])))
    chosen = (F.col("n_words") >= least_words) & ((F.col("score") > least) | (F.col("score") == least) & (place <= bound))
    ranked = numbered(rows.where(chosen), order, "rank").withColumn("rank", F.when(F.col("rank") <= k, F.col("rank")))
    return ranked.unionByName(rows.where(~chosen).select("*", none))


def resample(docs: DataFrame, target: DataFrame, grams: tuple[int, int] = GRAMS, buckets: int = BUCKETS, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_features, weight, score, rank for every row of `docs`, drawn towards the texts of `target`.

    Null or empty texts have no features and weight 0. Rows with a null or repeated doc_id are rows as
    any other; other columns are ignored; an empty `docs` gives no rows, an empty `target` has counts of 0.
    """
    gain = gains(bucket_counts(docs, grams, buckets), bucket_counts(target, grams, buckets))
    return draw(saved(scored(weigh(docs, gain, grams), seed)), percent, least_words)


def drawn(docs: DataFrame, result: DataFrame) -> DataFrame:
    """The rows of `docs` whose doc_id is drawn in `result`, with all their columns and their first rank.

    The rank is named so that it clashes with no column. Rows with a null doc_id are left out.
    """
    name = fresh("rank", docs.columns)
    ranks = result.where(F.col("rank").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("rank").alias(name))
    return docs.join(ranks, "doc_id")
