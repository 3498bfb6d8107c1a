"""Operator 1: quality classifier on hashed word and character n-gram vectors, averaged, with a softmax, by numpy SGD."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_rest

BITS = 17
GRAMS = (2, 4)
#: Characters handled at once; longer texts are taken whole, in stretches of about so many.
STRETCH = 1 << 20
_SPACE = re.compile("[\t-\r ]")
_P = np.uint32(0x9E3779B1)
_Q = np.uint32(0x85EBCA6B)
_POWERS = np.cumprod(np.full(64, 0x01000193, np.uint32), dtype=np.uint32)


def _stretches(text: str) -> Iterator[tuple[int, int]]:
    """Bounds of stretches of about STRETCH characters that part a text at white space only."""
    at = 0
    while len(text) - at > STRETCH:
        space = _SPACE.search(text, at + STRETCH)
        if space is None:
            break
        yield at, space.start()
        at = space.start()
    if at < len(text):
        yield at, len(text)


def buckets(text: str) -> Iterator[np.ndarray]:
    """Bucket numbers of all words, word pairs and character n-grams, as arrays; n-grams and pairs run on over the stretches."""
    last = np.zeros(0, np.uint32)
    for begin, end in _stretches(text):
        over = min(begin, max(GRAMS) - 1)
        whole = np.frombuffer(text[begin - over : end].encode("utf-32-le", "surrogatepass"), np.uint32)
        for n in GRAMS:
            c = whole[max(0, over - n + 1) :]
            if len(c) >= n:
                h = c[: len(c) - n + 1] * _P
                for i in range(1, n):
                    h = (h ^ (h >> np.uint32(15))) * _Q + c[i : len(c) - n + 1 + i] * _P
                yield (h * _Q + np.uint32(n)) * _P >> np.uint32(32 - BITS)
        c = whole[over:]
        inside = (c != 32) & ((c < 9) | (c > 13))
        edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        starts = np.concatenate([[0], edge])
        if not inside.any():
            continue
        place = np.arange(len(c)) - np.repeat(starts, np.diff(np.append(starts, len(c))))
        h = np.add.reduceat(c * _POWERS[place & 63], starts).astype(np.uint32)[inside[starts]]
        h = (h ^ (h >> np.uint32(13))) * _Q
        yield (h * _P) >> np.uint32(32 - BITS)
        h = np.concatenate([last, h])
        last = h[-1:]
        if len(h) > 1:
            pair = ((h[:-1] * _Q ^ h[1:]) * _P) >> np.uint32(32 - BITS)
            pair[h[:-1] == h[1:]] = 0  # any word twice running is one and the same pair
            yield pair


@dataclass(frozen=True)
class Model:
    """Of the two-layer model only what scoring needs: each bucket's vector times the softmax's weights, and the bias."""

    margin: np.ndarray
    bias: float

    def score(self, text: str | None) -> float:
        total, n = 0.0, 0
        for b in buckets(text or ""):
            total += float(self.margin[b].sum(dtype=np.float64))
            n += len(b)
        z = (total / n if n else 0.0) + self.bias
        return float(1 / (1 + np.exp(-np.clip(z, -50, 50))))


def fit(rows: list[tuple[int, np.ndarray, np.ndarray]], *, dim: int = 8, epochs: int = 8, rate: float = 0.5, seed: int = 7) -> Model:
    """SGD over (label, buckets, counts). Without rows the model scores 1/2 throughout."""
    rng = np.random.default_rng(seed)
    size = 1 << BITS
    vectors = rng.uniform(-1 / dim, 1 / dim, (size, dim)).astype(np.float32)
    out, bias = np.zeros((dim, 2), np.float32), np.zeros(2, np.float32)
    steps, done = epochs * max(1, len(rows)), 0
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            label, b, count = rows[i]
            step = rate * (1 - done / steps)
            done += 1
            total = float(count.sum())
            share = (count / total if total else count).astype(np.float32)
            mean = share @ vectors[b] if len(b) else np.zeros(dim, np.float32)
            z = mean @ out + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[label] -= 1
            down = out @ p
            out -= step * np.outer(mean, p)
            bias -= np.float32(0.1 * step) * p
            # a bucket's share of the mean is tiny; the square root lets rare but telling n-grams move
            vectors[b] -= step * np.sqrt(share)[:, None] * down
    return Model((vectors @ (out[:, 1] - out[:, 0])).astype(np.float32), float(bias[1] - bias[0]))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        bs, cs = [], []
        for text in batch.column(1):
            count = np.zeros(1 << BITS, np.int64)
            for b in buckets(text.as_py() or ""):
                count += np.bincount(b, minlength=1 << BITS)
            hit = np.flatnonzero(count)
            bs.append(hit.astype(np.int32))
            cs.append(count[hit].astype(np.float64))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bs, pa.list_(pa.int32())), pa.array(cs, pa.list_(pa.float64()))], names=["label", "buckets", "counts"])


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", folds: int = 5, sample: int = 4000) -> Model:
    """Learns from at most `sample` labelled rows, taken in the order of a hash, of which none is in fold 0.

    That bound is the only one: the driver gets bucket counts (at most 2^17 a document), never texts.
    """
    held = crc_rest(F.col(id_col), folds) == 0
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held).groupBy(id_col).agg(F.max(F.col(label_col).cast("int")).alias("label"))
    chosen = known.orderBy(F.xxhash64(id_col), id_col).limit(sample)
    rows = docs.select(id_col, F.col(text_col).alias("text")).join(F.broadcast(chosen), id_col).select("label", "text")
    got = rows.mapInArrow(_counted, "label int, buckets array<int>, counts array<double>").toArrow()
    cells = [got.column(i).combine_chunks() for i in range(3)]
    examples = [(int(cells[0][i].as_py() > 0), np.asarray(cells[1][i].values), np.asarray(cells[2][i].values)) for i in range(got.num_rows)]
    return fit(sorted(examples, key=lambda e: (zlib.crc32(e[1].tobytes()), e[0], len(e[1]))))  # whatever order tasks ended in


def score_quality(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text", folds: int = 5, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score and predicted for every document, from its whole text alone.

    A null or empty text has no features and gets the score of the bias; a null id is kept with held_out null; repeated
    rows score alike; an empty table gives no rows; other columns play no part.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([m.score(t.as_py()) for t in batch.column(1)], pa.float64())], names=["doc_id", "score"])

    out = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, score double")
    return out.select("doc_id", (crc_rest(F.col("doc_id"), folds) == 0).alias("held_out"), "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))


def keep_quality(docs: DataFrame, model: Model, *, text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """The documents that the model accepts, with all their columns, in one pass and without a join."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            yield batch.filter(pa.array([m.score(t.as_py()) >= threshold for t in batch.column(place)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
