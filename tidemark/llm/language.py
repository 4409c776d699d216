"""Language identification by a convolutional network over bytes, trained in numpy."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from tidemark.llm._text import chunks, column_bytes, ragged

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 8
#: The training sample: so many texts of each language by hash order, so many in all, so many characters of each.
PER_LANGUAGE, MOST_TEXTS, MOST_CHARS = 400, 8000, 2048
_LETTER = regex.compile(r"\p{L}")


@dataclass
class Model:
    """filters[k]: (width, 256, FILTERS); a bias for each filter; softmax weights on the pooled maxima."""

    languages: list[str]
    filters: list[np.ndarray]
    bias: np.ndarray
    weights: np.ndarray
    offset: np.ndarray


def windows(data: np.ndarray, offsets: np.ndarray, size: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Every byte of every row in consecutive windows, the last filled up with zeros; the row of each window."""
    lengths = np.diff(offsets)
    counts = -(-lengths // size)
    first = np.cumsum(counts) - counts
    out = np.zeros(int(counts.sum()) * size, np.uint8)
    out[ragged(first * size, lengths)] = data[offsets[0] : offsets[-1]]
    return out.reshape(-1, size), np.repeat(np.arange(len(lengths)), counts)


def _pooled(model: Model, x: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """The rectified maxima of all filters over each window, and where they stand."""
    out, places = [], []
    for k, f in enumerate(model.filters):
        n = x.shape[1] - len(f) + 1
        sums = f[0][x[:, :n]]
        for j in range(1, len(f)):
            sums += f[j][x[:, j : j + n]]
        where = sums.argmax(1)
        places.append(where)
        out.append(np.take_along_axis(sums, where[:, None, :], 1)[:, 0] + model.bias[k])
    return np.maximum(np.concatenate(out, 1), 0), places


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def train(texts: list[bytes], labels: list[str], rounds: int = 12, batch: int = 64, rate: float = 0.05, seed: int = 7) -> Model:
    """Fits by stochastic gradient steps with adaptive rates on windows of varying length."""
    rng = np.random.default_rng(seed)
    languages = sorted(set(labels))
    model = Model(languages, [rng.normal(0, 0.3, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS], np.zeros((len(WIDTHS), FILTERS), np.float32), rng.normal(0, 0.1, (len(WIDTHS) * FILTERS, len(languages))).astype(np.float32), np.zeros(len(languages), np.float32))
    if len(languages) < 2:
        return model
    target = np.searchsorted(languages, labels)
    seen = [np.full_like(p, 1e-3) for p in (*model.filters, model.bias, model.weights, model.offset)]

    def step(k: int, value: np.ndarray, gradient: np.ndarray) -> None:
        seen[k] += gradient * gradient
        value -= rate * gradient / np.sqrt(seen[k])

    for _ in range(rounds):
        order = rng.permutation(len(texts))
        for low in range(0, len(order), batch):
            chosen = order[low : low + batch]
            x = np.zeros((len(chosen), WINDOW), np.uint8)
            for row, i in enumerate(chosen):
                size = int(rng.choice((24, 64, WINDOW)))
                start = int(rng.integers(0, max(1, len(texts[i]) - size)))
                part = np.frombuffer(texts[i][start : start + size], np.uint8)
                x[row, : len(part)] = part
            pooled, places = _pooled(model, x)
            error = _softmax(pooled @ model.weights + model.offset)
            error[np.arange(len(chosen)), target[chosen]] -= 1
            error /= len(chosen)
            back = (error @ model.weights.T) * (pooled > 0)
            for k, f in enumerate(model.filters):
                part = back[:, k * FILTERS : (k + 1) * FILTERS]
                gradient = np.zeros_like(f)
                for j in range(len(f)):
                    np.add.at(gradient[j], (np.take_along_axis(x, places[k] + j, 1), np.arange(FILTERS)[None, :]), part)
                step(k, f, gradient)
            step(len(model.filters), model.bias, back.sum(0).reshape(model.bias.shape))
            step(len(model.filters) + 1, model.weights, pooled.T @ error)
            step(len(model.filters) + 2, model.offset, error.sum(0))
    return model


class Scorer:
    """Scores windows with the filters summed beforehand over pairs of bytes."""

    def __init__(self, model: Model):
        self.model = model
        self.tables = []
        for f in model.filters:
            parts = [(f[j][:, None, :] + f[j + 1][None, :, :]).reshape(65536, -1) if j + 1 < len(f) else f[j] for j in range(0, len(f), 2)]
            self.tables.append([np.ascontiguousarray(p, np.float32) for p in parts])

    def probabilities(self, x: np.ndarray, block: int = 256) -> np.ndarray:
        out = []
        for low in range(0, len(x), block):
            part = x[low : low + block].astype(np.intp)
            pairs = part[:, :-1] * 256 + part[:, 1:]
            pooled = []
            for k, tables in enumerate(self.tables):
                n = part.shape[1] - WIDTHS[k] + 1
                sums = tables[0].take(pairs[:, :n], 0)
                for j, table in enumerate(tables[1:], 1):
                    sums += table.take((pairs if len(table) == 65536 else part)[:, 2 * j : 2 * j + n], 0)
                pooled.append(sums.max(1) + self.model.bias[k])
            out.append(_softmax(np.maximum(np.concatenate(pooled, 1), 0) @ self.model.weights + self.model.offset))
        return np.concatenate(out) if out else np.zeros((0, len(self.model.languages)), np.float32)


def is_held_out() -> F.Column:
    return F.coalesce(F.expr("crc32(cast(cast(doc_id as string) as binary)) % 3 = 1"), F.lit(False))


def sample(docs: DataFrame, per_language: int = PER_LANGUAGE, most: int = MOST_TEXTS, most_chars: int = MOST_CHARS) -> list:
    """The labelled training rows: at most `most`, `per_language` of each language, first in hash order."""
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~is_held_out() & F.col("text").rlike(r"\p{L}"))
    rows = known.select("lang", F.substring("text", 1, most_chars).alias("text"), F.xxhash64(F.col("doc_id").cast("long")).alias("turn"))
    first = F.row_number().over(Window.partitionBy("lang").orderBy("turn", "text"))
    return rows.withColumn("place", first).where(F.col("place") <= per_language).orderBy("place", "lang", "turn").limit(most).collect()


def fit(docs: DataFrame, **limits) -> Model | None:
    """A model learned from `sample`, or None where no row is labelled."""
    rows = sample(docs, **limits)
    return train([r.text.encode() for r in rows], [r.lang for r in rows]) if rows else None


def predict(docs: DataFrame, model: Model | None, pred: str = "lang_pred", score: str = "score") -> DataFrame:
    """`docs` with a prediction `pred` and its `score`, by the mean over the bytes of the whole text of their windows' probabilities.

    The prediction is one of the model's languages, `und` with score 0 where text is null or has no letter
    or there is no model. Columns of docs by those names are replaced; other columns stay.
    """
    names = [c for c in docs.columns if c.lower() not in (pred, score)]
    base = docs.select(*(F.col(f"`{c}`") for c in names))
    schema = StructType([*base.schema, StructField(pred, StringType()), StructField(score, DoubleType())])
    at = next(i for i, c in enumerate(names) if c.lower() == "text")
    shared = base.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value) if shared.value else None
        for batch in batches:
            known, picked, sure = np.zeros(len(batch), bool), np.full(len(batch), -1), np.zeros(len(batch))
            if scorer:
                data, offsets = column_bytes(batch.column(at))
                for i, j in chunks(offsets):
                    known[i:j] = [bool(t) and _LETTER.search(t) is not None for t in batch.column(at).slice(i, j - i).to_pylist()]
                    lengths = np.diff(offsets[i : j + 1])
                    x, row = windows(data, offsets[i : j + 1])
                    place = np.arange(len(row)) - np.searchsorted(row, row)
                    sums = np.zeros((j - i, len(scorer.model.languages)))
                    np.add.at(sums, row, scorer.probabilities(x) * np.minimum(WINDOW, lengths[row] - place * WINDOW)[:, None])
                    sums /= np.maximum(lengths, 1)[:, None]
                    picked[i:j], sure[i:j] = sums.argmax(1), sums.max(1)
            languages = [scorer.model.languages[p] if k else "und" for p, k in zip(picked.tolist(), known.tolist())]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(languages, pa.string()), pa.array(np.where(known, np.clip(sure, 0, 1), 0.0), pa.float64())], [*names, pred, score])

    return base.mapInArrow(run, schema)


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score: learns from rows not held out and predicts every row."""
    found = predict(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), fit(docs))
    return found.select("doc_id", is_held_out().alias("held_out"), "lang_pred", "score")
