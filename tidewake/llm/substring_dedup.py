"""Operator 12: substring deduplication by seed and extend: winnowed anchors join documents, matches extend both ways, maximal repeats go."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace

#: Shared anchors that go to the tasks as one array, of eight bytes each; more are joined by a shuffle.
SEEDS = 4_000_000
#: Rows of small tables (copies, removed stretches) that may be broadcast; more are joined by a shuffle.
SMALL = 1_000_000
#: Words that are hashed at once.
STRETCH = 1 << 17
_MEMO = 200_000
_LAST = (1 << 63) - 1
_MASK = (1 << 64) - 1
#: Odd multipliers of the two polynomials over word hashes.
_MULTIPLIERS = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= _MEMO:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class _Rolling:
    """Hashes of all runs of n words by differences of prefix sums."""

    def __init__(self, room: int):
        self.up, self.down = [], []
        for m in _MULTIPLIERS:
            for into, base in ((self.up, m), (self.down, pow(m, -1, 1 << 64))):
                powers = np.full(room, base, np.uint64)
                powers[0] = 1
                into.append(np.multiply.accumulate(powers))

    def hashes(self, h: np.ndarray, n: int, which: int) -> np.ndarray:
        sums = np.zeros(len(h) + 1, np.uint64)
        np.cumsum(h * self.up[which][: len(h)], out=sums[1:])
        count = len(h) - n + 1
        return _mix((sums[n:] - sums[:count]) * self.down[which][:count])


def _least(a: np.ndarray, width: int) -> np.ndarray:
    """Least element of every run of `width` elements, by doubling."""
    have = 1
    while have < width:
        step = min(have, width - have)
        a = np.minimum(a[:-step], a[step:])
        have += step
    return a


class Winnower:
    """Anchors of word sequences.

    An anchor is the least hash of a run of `seed` words among those of a window of `length` words. The anchor is chosen
    by the window's words alone, so equal windows have equal anchors, and whatever two documents share over `length` words
    or more has an anchor in common.
    """

    def __init__(self, length: int, seed: int):
        if not 0 < seed <= length:
            raise ValueError("the seed must be 1 word at least and `length` at most")
        self.length, self.seed = length, seed
        self.memo = _Words()
        self.rolling = _Rolling(STRETCH + length)

    def stretches(self, text: bytes) -> Iterator[tuple[int, np.ndarray]]:
        """(first word, word hashes) of overlapping stretches that hold every window once."""
        words = text.split()
        if len(words) < self.length:
            return
        h = np.fromiter(map(self.memo.__getitem__, words), np.uint64, len(words))
        for at in range(0, len(h) - self.length + 1, STRETCH):
            yield at, h[at : at + STRETCH + self.length - 1]

    def anchors(self, h: np.ndarray) -> np.ndarray:
        """The anchor of every window of a stretch."""
        return _least(self.rolling.hashes(h, self.seed, 0), self.length - self.seed + 1)

    def windows(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Two hashes of every window, of 64 and 32 bits."""
        return self.rolling.hashes(h, self.length, 0), self.rolling.hashes(h, self.length, 1) >> np.uint64(33)


def _texts(batch: pa.RecordBatch, column: str) -> Iterator[bytes]:
    return (x.as_py() or b"" for x in batch.column(column).cast(pa.binary()))


def _sign(length: int, seed: int) -> Callable:
    """(d, x, h): the distinct anchors of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        win = Winnower(length, seed)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                found = [np.unique(np.concatenate([np.zeros(0, np.uint64), *(win.anchors(h) for _, h in win.stretches(t))])) for t in _texts(part, "text")]
                many = np.repeat(np.arange(part.num_rows), [len(f) for f in found])
                yield pa.RecordBatch.from_arrays([part.column("d").take(pa.array(many)), part.column("x").take(pa.array(many)), pa.array(np.concatenate([np.zeros(0, np.uint64), *found]).view(np.int64))], names=["d", "x", "h"])

    return run


def _extend(length: int, seed: int, seeds) -> Callable:
    """(d, x, w, v, at): the windows that an anchor shared by documents extends to, left and right, with their first words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        win = Winnower(length, seed)
        common = None if seeds is None else seeds.value
        for batch in batches:
            hits = None if seeds is not None else batch.column("hits")
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows, w, v, starts = [], [], [], []
                for i, text in enumerate(_texts(part, "text")):
                    known = common if hits is None else np.sort(np.asarray(hits[at + i].values, np.int64))
                    if not len(known):
                        continue
                    for first, h in win.stretches(text):
                        anchor = win.anchors(h).view(np.int64)
                        # runs of windows with one anchor are looked up once
                        new = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
                        near = np.minimum(np.searchsorted(known, anchor[new]), len(known) - 1)
                        held = np.repeat(known[near] == anchor[new], np.diff(np.append(new, len(anchor))))
                        if held.any():
                            a, b = win.windows(h)
                            place = np.flatnonzero(held)
                            w.append(a[place])
                            v.append(b[place])
                            starts.append(first + place)
                            rows.append(np.full(len(place), i))
                if rows:
                    many = pa.array(np.concatenate(rows))
                    columns = [np.concatenate(w).view(np.int64), np.concatenate(v).astype(np.int32), np.concatenate(starts).astype(np.int32)]
                    yield pa.RecordBatch.from_arrays([part.column("d").take(many), part.column("x").take(many), *map(pa.array, columns)], names=["d", "x", "w", "v", "at"])

    return run


def _merge(length: int) -> Callable:
    """(d, x, repeats): maximal stretches of words, [begin, end), that the windows of a row cover."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends, flat = [0], []
            for starts in batch.column("starts"):
                s = np.unique(np.asarray(starts.values, np.int32))
                begins = np.concatenate([[True], s[1:] > s[:-1] + length])
                last = np.append(np.flatnonzero(begins)[1:] - 1, len(s) - 1)
                flat.append(np.column_stack([s[begins], s[last] + length]).ravel())
                ends.append(ends[-1] + len(flat[-1]))
            values = pa.array(np.concatenate([np.zeros(0, np.int32), *flat]).astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column("d"), batch.column("x"), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)], names=["d", "x", "repeats"])

    return run


def _cut(length: int):
    @F.arrow_udf("n_words long, repeats array<int>, kept string")
    def cut(text: pa.Array, repeats: pa.Array, copied: pa.Array) -> pa.Array:
        n, gone, kept = [], [], []
        for t, r, c in zip(text.cast(pa.binary()), repeats, copied):
            words = (t.as_py() or b"").split()
            cuts = r.as_py() or []
            if c.as_py() and len(words) >= length:
                cuts = [0, len(words)]
            n.append(len(words))
            gone.append(cuts)
            edges = [0, *cuts, len(words)]
            kept.append(b" ".join(w for b, e in zip(edges[::2], edges[1::2]) for w in words[b:e]))
        return pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(gone, pa.list_(pa.int32())), pa.array(kept, pa.binary()).cast(pa.string())], names=["n_words", "repeats", "kept"])

    return cut


def dedup_substrings(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = 13, seed: int = 6) -> DataFrame:
    """Removes the words that repeat a document of smaller id over `length` words or more; returns all input columns, the text
    as its kept words joined by one space, n_words (before), n_removed and repeats (bounds of the maximal repeats, in words: begin, end, begin, ...).

    Rows are winnowed to anchors of `seed` words, which are reduced to those that two documents share. Where a row holds one
    of these, the match is extended to all windows of `length` words around it; the windows' least holders are found by a
    grouped minimum, so a passage that many documents share costs a row for each of them and no pair is made. Windows that a
    smaller document holds are merged to maximal repeats. Exact copies of a text of a smaller document go no further than
    their hash (128 bits); windows are told apart by 95 bits. Hot anchors and windows are combined before they are shuffled,
    and in joins Spark splits them. All windows are judged on the input.

    Null or empty text: no words. Repeated rows of one id are one document, and never repeat each other. A null id stands for
    one last document. Texts of any length are hashed in stretches. Extra columns are kept, but n_words, n_removed and
    repeats are replaced; an empty table gives no rows.
    """
    spark = docs.sparkSession
    space = Workspace(spark, "substrings")
    text = F.coalesce(F.col(text_col), F.lit(""))
    own = docs.withColumn("_tw_id", F.coalesce(F.col(id_col).cast("long"), F.lit(_LAST))).withColumn("_tw_text", text).withColumn("_tw_x", F.xxhash64("_tw_text")).withColumn("_tw_y", F.xxhash64(F.lit(1), "_tw_text"))
    rows = own.select(F.col("_tw_id").alias("d"), F.col("_tw_x").alias("x"), F.col("_tw_y").alias("y"), F.col("_tw_text").alias("text"))
    small = lambda df, n: F.broadcast(df) if n <= SMALL else df
    key = rows.select("d", "x", "y")
    copies = space.save(key.join(key.groupBy("x", "y").agg(F.min("d").alias("first")), ["x", "y"]).where("d > first").select("d", "x", "y").distinct(), "copies")
    copies = small(copies, copies.count())
    # toDF: copies derive from the same rows
    rest = rows.join(copies.toDF("d", "x", "y"), ["d", "x", "y"], "left_anti").select("d", "x", "text")
    signed = rest.mapInArrow(_sign(length, seed), "d long, x long, h long")
    seeds = space.save(signed.groupBy("h").agg(F.min("d").alias("first"), F.max("d").alias("last")).where("first < last").select("h"), "seeds")
    if seeds.count() <= SEEDS:
        common = spark.sparkContext.broadcast(np.sort(seeds.toArrow().column("h").to_numpy()))
        found = rest.mapInArrow(_extend(length, seed, common), "d long, x long, w long, v int, at int")
    else:
        hits = signed.join(seeds, "h").groupBy("d", "x").agg(F.collect_set("h").alias("hits"))
        found = rest.join(hits.toDF("d", "x", "hits"), ["d", "x"]).mapInArrow(_extend(length, seed, None), "d long, x long, w long, v int, at int")
    least = found.groupBy("w", "v").agg(F.min("d").alias("first"), F.max("d").alias("last")).where("first < last").select("w", "v", "first")
    late = found.toDF("d", "x", "w", "v", "at").join(least, ["w", "v"]).where("d > first")
    merged = late.groupBy("d", "x").agg(F.collect_list("at").alias("starts")).mapInArrow(_merge(length), "d long, x long, repeats array<int>")
    merged = space.save(merged, "repeats")
    many = merged.agg(F.coalesce(F.sum(F.size("repeats")), F.lit(0))).first()[0]
    joined = own.join(small(merged.toDF("_tw_id", "_tw_x", "_tw_repeats"), many), ["_tw_id", "_tw_x"], "left").join(copies.toDF("_tw_id", "_tw_x", "_tw_y").withColumn("_tw_copy", F.lit(True)), ["_tw_id", "_tw_x", "_tw_y"], "left")
    out = joined.withColumn("_tw_cut", _cut(length)(F.col("_tw_text"), F.col("_tw_repeats"), F.coalesce("_tw_copy", F.lit(False))))
    names = [c for c in docs.columns if c not in ("n_words", "n_removed", "repeats")]
    removed = F.aggregate("_tw_cut.repeats", F.lit(0), lambda a, x: x - a)  # bounds rise, so the alternating sum is what lies between
    return out.select(
        *[F.col("_tw_cut.kept").alias(c) if c == text_col else F.col(f"`{c}`") for c in names],
        F.col("_tw_cut.n_words").alias("n_words"),
        removed.cast("long").alias("n_removed"),
        F.col("_tw_cut.repeats").alias("repeats"),
    )
