"""Operator 4: benchmark decontamination by pigeonhole edit matching."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace

#: Characters of benchmark items that one pass over the documents carries to the tasks.
BLOCK_CHARS = 4_000_000


def normal(text: str | None) -> str:
    """Lower case, white space runs as one space."""
    return " ".join((text or "").lower().split())


def best_distance(masks: dict[str, int], m: int, text: str, stop: int) -> int:
    """Least edit distance of a pattern of length m to any substring of text, by Myers' bit-parallel scan; ends early at `stop` or less."""
    all_ones = (1 << m) - 1
    top = 1 << (m - 1)
    plus, minus, score, best = all_ones, 0, m, m
    for c in text:
        eq = masks.get(c, 0)
        vertical = eq | minus
        horizontal = (((eq & plus) + plus) ^ plus) | eq
        hp = minus | (all_ones & ~(horizontal | plus))
        hm = plus & horizontal
        if hp & top:
            score += 1
        elif hm & top:
            score -= 1
            if score < best:
                best = score
                if best <= stop:
                    return best
        hp = (hp << 1) & all_ones
        hm = (hm << 1) & all_ones
        plus = hm | (all_ones & ~(vertical | hp))
        minus = hp & vertical
    return best


class Matcher:
    """Pieces of a block of items in one automaton, and the verification of their hits."""

    def __init__(self, items: list[tuple[int, str]], rate: float):
        import ahocorasick

        self.items = items
        self.budget = [int(rate * len(t)) for _, t in items]
        self.masks: dict[int, dict[str, int]] = {}
        pieces: dict[str, list[tuple[int, int]]] = {}
        for i, (_, t) in enumerate(items):
            parts = self.budget[i] + 1
            for j in range(parts):
                a, b = len(t) * j // parts, len(t) * (j + 1) // parts
                pieces.setdefault(t[a:b], []).append((i, a))
        self.automaton = ahocorasick.Automaton()
        for p, where in pieces.items():
            self.automaton.add_word(p, (len(p), where))
        if pieces:
            self.automaton.make_automaton()
        self.empty = not pieces

    def find(self, text: str) -> list[int]:
        """Ids of the items of which some stretch of text is within the error budget."""
        if self.empty:
            return []
        found: set[int] = set()
        tried: set[tuple[int, int]] = set()
        for end, (length, where) in self.automaton.iter(text):
            for i, offset in where:
                if i in found:
                    continue
                begin = end + 1 - length - offset
                if (i, begin) in tried:
                    continue
                tried.add((i, begin))
                item, k = self.items[i][1], self.budget[i]
                if text.startswith(item, begin) if begin >= 0 else False:
                    found.add(i)
                    continue
                if k == 0:
                    continue
                masks = self.masks.get(i)
                if masks is None:
                    masks = self.masks[i] = {}
                    for p, c in enumerate(item):
                        masks[c] = masks.get(c, 0) | 1 << p
                if best_distance(masks, len(item), text[max(0, begin - k) : begin + len(item) + k], k) <= k:
                    found.add(i)
        return sorted(self.items[i][0] for i in found)


_matchers: dict[str, Matcher] = {}


def _matcher(shared: Broadcast, rate: float) -> Matcher:
    """The matcher of a block; a Python worker builds it once and keeps the last one."""
    name, items = shared.value
    if name not in _matchers:
        _matchers.clear()
        _matchers[name] = Matcher(items, rate)
    return _matchers[name]


def _items(benchmark: DataFrame, item_col: str, item_text_col: str, block_chars: int) -> tuple[DataFrame, int]:
    """(items, blocks): items with their block; a block is one hash class of them, of about block_chars characters."""
    items = benchmark.select(F.col(item_col).cast("long").alias("i"), F.col(item_text_col).alias("t")).where("i IS NOT NULL AND length(trim(t)) > 0")
    blocks = max(1, -(-(items.agg(F.sum(F.length("t"))).first()[0] or 0) // block_chars))
    return items.withColumn("b", F.pmod(F.xxhash64("i", "t"), F.lit(blocks))), blocks


def _block(items: DataFrame, b: int) -> Broadcast:
    """A block's items, broadcast: its size is bounded, and the driver holds one block at a time."""
    rows = items.where(F.col("b") == b).collect()
    return items.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, sorted({(r["i"], normal(r["t"])) for r in rows if normal(r["t"])})))


def contaminated(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", rate: float = 0.05, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """doc_id and item_ids: the benchmark items of which the document holds a stretch within the error budget.

    The budget of an item is rate times its length, in characters after normal(). The items are a stated query set;
    they go to the tasks in blocks of about block_chars characters, one written pass over the documents for each block,
    so what the driver or a task holds is bounded however long the benchmark. Null, empty or white-space items match
    nothing; a null text holds nothing; repeated rows give a row each; a null id is kept as null; an empty benchmark
    leaves all clean.
    """
    items, blocks = _items(benchmark, item_col, item_text_col, block_chars)
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    if blocks == 1:
        return source.mapInArrow(_scan(_block(items, 0), rate), "doc_id long, item_ids array<long>")
    space = Workspace(docs.sparkSession, "decontamination")
    row = F.struct("doc_id", F.xxhash64("text").alias("h"))
    out = None
    for b in range(blocks):
        shared = _block(items, b)
        part = space.save(source.select(row.alias("doc_id"), "text").mapInArrow(_scan(shared, rate), "doc_id struct<doc_id:long,h:long>, item_ids array<long>"), f"block-{b}")
        shared.destroy()
        out = part if out is None else out.unionByName(part)
    rows = out.groupBy("doc_id").agg(F.array_sort(F.flatten(F.collect_list("item_ids"))).alias("item_ids"), (F.count("*") / blocks).cast("int").alias("copies"))
    # of repeated rows every one found the same items
    rows = rows.withColumn("item_ids", F.array_distinct("item_ids"))
    return rows.select(F.col("doc_id.doc_id").alias("doc_id"), "item_ids", F.explode(F.sequence(F.lit(1), "copies")).alias("_")).drop("_")


def _scan(shared: Broadcast, rate: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = _matcher(shared, rate)
        for batch in batches:
            found = [matcher.find(normal(t.as_py())) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int64()))], names=["doc_id", "item_ids"])

    return run


def keep_clean(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", rate: float = 0.05, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The documents that hold no item, with all their columns; a block of items after another, each pass but the last written, without a join. Null and empty texts stay."""
    items, blocks = _items(benchmark, item_col, item_text_col, block_chars)
    place, schema = docs.columns.index(text_col), docs.schema
    space = Workspace(docs.sparkSession, "decontamination")
    for b in range(blocks):
        shared = _block(items, b)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            matcher = _matcher(shared, rate)
            for batch in batches:
                yield batch.filter(pa.array([not matcher.find(normal(t.as_py())) for t in batch.column(place)], pa.bool_()))

        kept = docs.mapInArrow(run, schema)
        if b < blocks - 1:
            kept = space.save(kept, f"block-{b}")
            shared.destroy()
            if b:
                space.drop(docs)
        docs = kept
    return docs
