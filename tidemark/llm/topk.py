"""Exact top-k inner products by the threshold algorithm over sorted per-dimension lists."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm._work import saved

#: Rows of a block of vectors, and of a block of queries.
VECTORS, QUERIES = 32768, 32768
#: Queries that are searched together, and rows that they are scored with at once.
TOGETHER, SLICE = 256, 4096
#: Places of each list read before the first look at the bound; twice as many before each next one.
DEPTH = 2


def scaled(vectors: DataFrame) -> DataFrame:
    """vec_id, v array<double>: floor(256 x) of each component; rows with null or non-finite values or a null vec_id drop out."""
    fine = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.where(F.coalesce(fine, F.lit(False))).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda x: F.floor(256 * x.cast("double")).cast("double")).alias("v"))


def _best(scores: np.ndarray, columns: np.ndarray, kth: np.ndarray, held: tuple[np.ndarray, np.ndarray], ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best (score, row) of each line of `held` and of `scores`, whose columns are rows in order of id.

    Only scores that reach the line's kth are looked at; of many that tie with it, the first k.
    """
    least = kth
    if scores.shape[1] > k:
        least = np.maximum(kth, np.partition(scores, scores.shape[1] - k, axis=1)[:, -k]) if not np.isfinite(kth).all() else kth
    fit = (scores >= least[:, None]) & (scores > -np.inf)
    if np.count_nonzero(fit) > 8 * k * len(fit):
        tied = scores == least[:, None]
        fit &= ~tied | (np.cumsum(tied, axis=1, dtype=np.int32) <= k)
    line, column = np.nonzero(fit)
    old_score, old_row = held
    lines = np.concatenate([np.repeat(np.arange(len(scores)), k), line])
    found, rows = np.concatenate([old_score.ravel(), scores[line, column]]), np.concatenate([old_row.ravel(), columns[column]])
    order = np.lexsort((np.where(rows < 0, 0, ids[rows]), -found, lines))
    place = np.arange(len(order)) - np.searchsorted(lines[order], lines[order])
    taken = order[place < k]
    return found[taken].reshape(-1, k), rows[taken].reshape(-1, k)


def threshold_searches(wanted: np.ndarray, matrix: np.ndarray, orders: np.ndarray, ids: np.ndarray, own: np.ndarray, k: int, floor: np.ndarray, depth: int = DEPTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(scores, rows, how many rows were scored) of the k best rows of a block for each query but its own; rows that are missing are -1.

    The list of each dimension in which a query has a weight is read from the end that is best for it, for
    all queries together; rows seen for the first time are scored in full by one product. A query leaves
    when its kth score, or the `floor` that k rows elsewhere reach, is above the sum of the values at the
    places reached: no row not yet seen can reach even a tie.
    """
    n = len(ids)
    up, down = np.maximum(wanted, 0.0), np.minimum(wanted, 0.0)
    dimensions = np.arange(matrix.shape[1])
    scores, rows = np.full((len(wanted), k), -np.inf), np.full((len(wanted), k), -1)
    kth, read, live = floor.astype(float), np.zeros(len(wanted), np.int64), np.arange(len(wanted))
    unseen, at = np.ones(n, bool), 0
    while at < n:
        bound = up[live] @ matrix[orders[:, n - 1 - at], dimensions] + down[live] @ matrix[orders[:, at], dimensions]
        live = live[kth[live] <= bound]
        if not len(live):
            break
        falling, rising = np.flatnonzero(up[live].any(0)), np.flatnonzero(down[live].any(0))
        top = min(n, at + depth) if len(falling) + len(rising) else n
        new = np.zeros(n, bool)
        new[orders[falling, n - top : n - at]] = True
        new[orders[rising, at:top]] = True
        met = np.flatnonzero(new & unseen if len(falling) + len(rising) else unseen)
        unseen[met] = False
        met = met[np.argsort(ids[met], kind="stable")]
        for first in range(0, len(met), SLICE):
            part = met[first : first + SLICE]
            lines = wanted[live] @ matrix[part].T
            low, high = np.searchsorted(ids[part], own[live]), np.searchsorted(ids[part], own[live], "right")
            for line in np.flatnonzero(high > low):
                lines[line, low[line] : high[line]] = -np.inf
            read[live] += len(part) - (high - low)
            scores[live], rows[live] = _best(lines, part, kth[live], (scores[live], rows[live]), ids, k)
            kth[live] = np.maximum(kth[live], scores[live, k - 1])
        at, depth = top, depth * 2
    return scores, rows, read


def threshold_search(query: np.ndarray, matrix: np.ndarray, orders: np.ndarray, ids: np.ndarray, own: int, k: int, depth: int = DEPTH, floor: float = -np.inf) -> tuple[list[tuple[int, int]], int]:
    """(score, vec_id) of the k best rows of a block for one query, and how many rows were scored; see `threshold_searches`."""
    scores, rows, read = threshold_searches(query[None], matrix, orders, ids, np.array([own]), k, np.array([floor]), depth)
    return [(int(s), int(ids[i])) for s, i in zip(scores[0], rows[0]) if i >= 0], int(read[0])


def top_k(vectors: DataFrame, every: int = 50, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k highest integer inner products, ties to the smaller vec_id.

    Queries are the rows whose vec_id is divisible by `every`; candidates are all rows with another
    vec_id and as many components. Both are dealt into blocks of a fixed size; each pair of blocks is
    searched by itself and yields k rows a query, of which the k best are kept, so that no task
    holds more than two blocks. A query is searched in one block first; its kth score there is the floor
    of all others, so that a block whose bound is below it is not read. Repeated candidate rows each take
    a rank; a repeated query row counts once. An empty table gives no rows; other columns are ignored.
    """
    base = scaled(vectors).withColumn("width", F.size("v"))
    count = base.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("vec_id") % every == 0, 1)).alias("q")).first()
    blocks, groups = -(-count.n // VECTORS) or 1, -(-count.q // QUERIES) or 1
    asked = base.where(F.col("vec_id") % every == 0).dropDuplicates(["vec_id", "width"]).withColumn("group", F.pmod(F.xxhash64("vec_id"), F.lit(groups)).cast("int"))
    spread = base.withColumn("block", F.pmod(F.xxhash64("vec_id", "v"), F.lit(blocks)).cast("int")).withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    home = F.pmod(F.xxhash64(F.lit(1), "vec_id"), F.lit(blocks)).cast("int")

    def search(queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(queries) and len(rows) and int(queries["width"].iloc[0]):
            ids = rows["vec_id"].to_numpy()
            matrix, wanted = np.stack(rows["v"].to_numpy()), np.stack(queries["v"].to_numpy())
            orders = np.ascontiguousarray(np.argsort(matrix, axis=0, kind="stable").astype(np.int32).T)
            asking, floors = queries["vec_id"].to_numpy(), queries["floor"].to_numpy()
            for first in range(0, len(wanted), TOGETHER):
                some = slice(first, first + TOGETHER)
                scores, places, _ = threshold_searches(wanted[some], matrix, orders, ids, asking[some], k, floors[some])
                line, rank = np.nonzero(places >= 0)
                out.append(pd.DataFrame({"query_id": asking[some][line], "vec_id": ids[places[line, rank]], "score": scores[line, rank]}))
        elif len(queries) and len(rows):
            ids = np.sort(rows["vec_id"].to_numpy())
            out = [pd.DataFrame([(own, int(i), 0) for own in queries["vec_id"].tolist() for i in ids[ids != own][:k]], columns=["query_id", "vec_id", "score"])]
        return (pd.concat(out) if out else pd.DataFrame(columns=["query_id", "vec_id", "score"])).astype("int64")

    def meet(queries: DataFrame) -> DataFrame:
        return queries.groupBy(*keys).cogroup(spread.groupBy(*keys)).applyInPandas(search, "query_id long, vec_id long, score long")

    keys = ["width", "group", "block"]
    found = meet(asked.withColumn("block", home).withColumn("floor", F.lit(float("-inf"))))
    if blocks > 1:
        found = saved(found)
        enough = found.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.min("score").cast("double").alias("kth")).where(F.col("n") == k)
        floor = F.coalesce("kth", F.lit(float("-inf")))
        others = F.explode(F.filter(F.sequence(F.lit(0), F.lit(blocks - 1)), lambda b: b != home))
        bounded = asked.join(enough, F.col("vec_id") == F.col("query_id"), "left").withColumn("floor", floor).select("vec_id", "v", "width", "group", "floor", others.alias("block"))
        found = found.unionByName(meet(saved(bounded)))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
