"""Operator 11: alignment of the tokens of two tokenizers over exact-text deduplicated documents."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Workspace, text_groups

#: Pairs whose counts go to the tasks as arrays, of 17 bytes each: the most frequent ones. Links of rarer pairs are joined by a shuffle.
HEAD = 2_000_000
#: Segments that a worker remembers, and their characters.
MEMO, MEMO_CHARS = 500_000, 20_000_000
#: Characters of new segments that are tokenised at once.
CHUNK = 20_000
_SPACE = "▁"
#: Cuts before a space or line feed that follows no white space.
_CUT = re.compile(r"(?<=\S)(?=[ \n])")
_DOUBLE = re.compile(r"\s[ \n]")
COUNTS = "n_a long, n_b long, n_groups long, n_links long"


class ByteTokenizer:
    """Byte-level BPE of a tokenizer file; strings of special tokens are plain text."""

    def __init__(self, path: str, pattern: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        special = {t["content"] for t in spec["added_tokens"]}
        # printable bytes stand for themselves, the others for the characters from 256 on, in order
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
        ranks = {bytes(byte[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
        merged = [spec["model"]["vocab"]["".join(m.split(" ") if isinstance(m, str) else m)] for m in spec["model"]["merges"]]
        if merged != sorted(merged):
            raise ValueError(f"{path}: merges do not rank as ids")
        self.bytes = [b""] * (max(ranks.values()) + 1)
        for token, i in ranks.items():
            self.bytes[i] = token
        self.encode = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


class PieceTokenizer:
    """Piece model with byte fallback that puts a space before a text."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        if any(_SPACE in p.lstrip(_SPACE) or "\n" in p for p in pieces):
            raise ValueError(f"{path}: pieces run on over white space")
        none = lambda i: self.model.is_control(i) or self.model.is_unknown(i) or self.model.is_unused(i)
        self.bytes = [b"" if none(i) else bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace(_SPACE, " ").encode() for i, p in enumerate(pieces)]
        self.space = self.model.piece_to_id(_SPACE)

    def encode(self, text: str) -> list[int]:
        """text begins with a space, which the model puts there itself, or with a line feed, before which it puts one."""
        if text == " ":
            return [self.space]
        return self.model.encode(text[1:]) if text[0] == " " else self.model.encode(text)[1:]


class Aligner:
    """Alignment of texts by segments.

    A segment begins at a space or line feed that follows a character other than white space. No token of either
    tokenizer runs on over such a place, so a text's tokens, groups and links are those of its segments, one after
    another. Segments recur, and what they hold is kept in a bounded memo.
    """

    def __init__(self, a: ByteTokenizer, b: PieceTokenizer):
        self.a, self.b = a, b
        self.size_b = len(b.bytes)
        self.len_a, self.len_b = (np.asarray([len(x) for x in t.bytes], np.int64) for t in (a, b))
        ids = np.arange(max(len(a.bytes), self.size_b))
        self.width = np.asarray([len(str(i)) for i in ids.tolist()])
        self.digits = (ids[:, None] // 10 ** np.arange(self.width.max()) % 10 + ord("0")).astype(np.uint8)  # from the last one
        self.clear()

    def clear(self) -> None:
        self.memo: dict = {}
        self.chars = 0
        self.groups: list[str] = []
        self.counts = np.zeros((0, 4), np.int64)  # tokens of A, of B, groups, links
        self.whole = np.zeros(0, bool)
        self.codes = np.zeros(0, np.int64)
        self.ends = np.zeros(1, np.int64)

    def _keys(self, text: str) -> list:
        """The segments of space+text: what follows the space, or from the line feed on. One that begins with both is a tuple."""
        if _DOUBLE.search(" " + text) is None:
            head, *lines = text.split("\n")
            keys = head.split(" ")
            for line in lines:
                first, *others = line.split(" ")
                keys.append("\n" + first)
                keys += others
            return keys
        return [s if s[0] == "\n" else s[1:] if s[1:2] != "\n" else (s,) for s in _CUT.split(" " + text)]

    @staticmethod
    def _segment(key) -> str:
        return key[0] if isinstance(key, tuple) else key if key[:1] == "\n" else " " + key

    def _tokens(self, segments: list[str]) -> Iterator[tuple[list[str], list[int] | None, list[int] | None]]:
        """Segments in groups, with the ids of each group, or none for a segment that its tokens do not spell."""
        join = lambda ids, table: b"".join(map(table.__getitem__, ids))
        group: list[str] = []
        size = 0
        # a segment that ends in white space may not stand before another
        for s in chain(sorted(segments, key=lambda s: s[-1].isspace()), [None]):
            if group and (s is None or size > CHUNK or group[-1][-1].isspace()):
                todo, group, size = [group], [], 0
                while todo:
                    own = todo.pop()
                    text = "".join(own)
                    a, b, raw = self.a.encode(text), self.b.encode(text), text.encode()
                    if join(a, self.a.bytes) == raw == join(b, self.b.bytes):
                        yield own, a, b
                    elif len(own) == 1:
                        yield own, None, None
                    else:
                        todo += [own[len(own) // 2 :], own[: len(own) // 2]]
            if s is not None:
                group.append(s)
                size += len(s)

    def _strings(self, a: np.ndarray, b: np.ndarray, end_a: np.ndarray, end_b: np.ndarray, bounds: np.ndarray) -> tuple[str, np.ndarray]:
        """The groups of all tokens, each followed by a semicolon, and where each group ends."""
        group_a, group_b = np.searchsorted(bounds, end_a), np.searchsorted(bounds, end_b)
        place_a = np.arange(len(a)) + np.searchsorted(group_b, group_a)
        place_b = np.arange(len(b)) + np.searchsorted(group_a, group_b, "right")
        ids, mark = np.empty(len(a) + len(b), np.int64), np.full(len(a) + len(b), ord(","), np.uint8)
        ids[place_a], ids[place_b] = a, b
        last_b = place_b[np.isin(end_b, bounds, assume_unique=True)]
        mark[place_a[np.isin(end_a, bounds, assume_unique=True)]], mark[last_b] = ord("|"), ord(";")
        ends = (self.width[ids] + 1).cumsum()
        out = np.empty(ends[-1] if len(ends) else 0, np.uint8)
        out[ends - 1] = mark
        for k in range(self.digits.shape[1]):
            own = self.width[ids] > k
            out[ends[own] - 2 - k] = self.digits[ids[own], k]
        return out.tobytes().decode("ascii"), ends[last_b]

    def _learn(self, keys: list) -> None:
        by_segment = {self._segment(k): k for k in keys}
        segments, whole, all_a, all_b = [], [], [], []
        for own, a, b in self._tokens(list(by_segment)):
            segments += own
            whole += [a is not None] * len(own)
            all_a += a or []
            all_b += b or []
        flat_a, flat_b, whole = np.asarray(all_a, np.int64), np.asarray(all_b, np.int64), np.asarray(whole, bool)
        end_a, end_b = self.len_a[flat_a].cumsum(), self.len_b[flat_b].cumsum()
        last = np.cumsum(np.asarray([len(s.encode()) for s in segments]) * whole)
        bounds, cuts = np.intersect1d(end_a, end_b, assume_unique=True), np.union1d(end_a, end_b)
        if not np.isin(last[whole], bounds).all():
            raise ValueError("a token runs on over the end of a segment")
        of = lambda ends: np.diff(np.searchsorted(ends, last, "right"), prepend=0)
        counts = np.column_stack([of(end_a), of(end_b), of(bounds), of(cuts)])
        string, at = self._strings(flat_a, flat_b, end_a, end_b, bounds)
        until = np.concatenate([[0], at])[counts[:, 2].cumsum()].tolist()
        # a segment's groups, without the last semicolon
        self.groups += [string[i : j - 1] if j > i else "" for i, j in zip([0, *until], until)]
        # between two neighbouring ends lies one token of A and one of B, and so each overlap once
        codes = flat_a[np.searchsorted(end_a, cuts)] * self.size_b + flat_b[np.searchsorted(end_b, cuts)]
        for n, s in enumerate(segments, len(self.memo)):
            self.memo[by_segment[s]] = n
        self.chars += sum(map(len, segments))
        self.counts = np.concatenate([self.counts, counts])
        self.whole = np.concatenate([self.whole, whole])
        self.codes = np.concatenate([self.codes, codes])
        self.ends = np.concatenate([self.ends, self.ends[-1] + counts[:, 3].cumsum()])

    def _index(self, texts: list[list]) -> list[np.ndarray]:
        found = [np.fromiter(map(self.memo.get, keys, repeat(-1)), np.int64, len(keys)) for keys in texts]
        missing = [np.flatnonzero(x < 0).tolist() for x in found]
        if new := list(dict.fromkeys(keys[i] for keys, places in zip(texts, missing) for i in places)):
            self._learn(new)
            for x, keys, places in zip(found, texts, missing):
                x[places] = [self.memo[keys[i]] for i in places]
        return found

    def align(self, texts: list[str]) -> Iterator[tuple[np.ndarray, str, np.ndarray, np.ndarray]]:
        """Of each text: the four counts, sha256 of its groups, codes of its linked id pairs (a * size of B + b), their links."""
        if len(self.memo) > MEMO or self.chars > MEMO_CHARS:
            self.clear()
        found = self._index([self._keys(t) for t in texts])
        # a text one of whose segments reads otherwise is held against its tokens' bytes as a whole
        odd = [i for i, x in enumerate(found) if not self.whole[x].all()]
        for i, x in zip(odd, self._index([[(" " + texts[i],)] for i in odd])):
            found[i] = x if self.whole[x].all() else x[:0]
        none = np.zeros(4, np.int64), "", np.zeros(0, np.int64), np.zeros(0, np.int64)
        for x in found:
            if not len(x):
                yield none
                continue
            digest = hashlib.sha256(";".join(map(self.groups.__getitem__, x.tolist())).encode()).hexdigest()
            once, times = np.unique(x, return_counts=True)
            n = self.counts[once, 3]
            at = np.arange(n.sum()) + np.repeat(self.ends[once] - n.cumsum() + n, n)
            codes, place = np.unique(self.codes[at], return_inverse=True)
            links = np.zeros(len(codes), np.int64)
            np.add.at(links, place, np.repeat(times, n))
            yield self.counts[x].sum(0), digest, codes, links


@lru_cache(1)
def _aligner(path_a: str, path_b: str, pattern: str) -> Aligner:
    """One for each worker; its memo serves all its tasks."""
    return Aligner(ByteTokenizer(path_a, pattern), PieceTokenizer(path_b))


def _align(*paths: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _aligner(*paths)
        for batch in batches:
            for rows, texts in text_groups(list(range(batch.num_rows)), batch.column("text").to_pylist()):
                counts, digests, codes, links = zip(*aligner.align(texts))
                ends = pa.array(np.cumsum([0, *map(len, codes)]), pa.int32())
                listed = lambda parts: pa.ListArray.from_arrays(ends, pa.array(np.concatenate(parts)))
                part = batch.slice(rows[0], len(rows))
                yield pa.RecordBatch.from_arrays([part.column("digest"), part.column("copies"), *(pa.array(c) for c in np.asarray(counts).T), pa.array(digests), listed(codes), listed(links)], names=["digest", "copies", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "codes", "links"])

    return run


def _measure(head) -> Callable:
    """Sums over a text's links by the counts of the head; links of other pairs stay as `rest`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, counts, best = head.value
        for batch in batches:
            listed, links = batch.column("codes"), batch.column("links").flatten().to_numpy()
            flat = listed.flatten().to_numpy()
            ends = np.concatenate([[0], np.cumsum(listed.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
            at = np.minimum(np.searchsorted(codes, flat), max(0, len(codes) - 1))
            hit = codes[at] == flat if len(codes) else np.zeros(len(flat), bool)

            def total(values: np.ndarray) -> pa.Array:
                sums = np.concatenate([[0], np.cumsum(values)])
                return pa.array((sums[ends[1:]] - sums[ends[:-1]]).astype(np.int64))

            def known(values: np.ndarray) -> np.ndarray:
                out = np.zeros(len(flat), np.int64)
                out[hit] = values[at[hit]] * links[hit]
                return out

            misses = np.concatenate([[0], np.cumsum(~hit)])[ends]
            rest = pa.StructArray.from_arrays([pa.array(flat[~hit]), pa.array(links[~hit])], names=["code", "links"])
            rest = pa.ListArray.from_arrays(pa.array(misses, pa.int32()), rest)
            own = [batch.column(c) for c in ("digest", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")]
            yield pa.RecordBatch.from_arrays([*own, total(known(best)), total(known(counts)), rest], names=["digest", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best", "count_sum", "rest"])

    return run


def _head(spark: SparkSession, counts: DataFrame, limit: int):
    """The `limit` most frequent pairs, about, as arrays in the tasks, and whether these are all."""
    total = counts.count()
    top = counts
    if total > limit:
        cutoff = counts.agg(F.percentile_approx("n", 1 - limit / total, 10000)).first()[0]
        top = counts.where(F.col("n") > cutoff)
    got = top.select("code", "n", F.col("best").cast("long").alias("best")).toArrow()
    code, n, best = (got.column(c).to_numpy().astype(np.int64) for c in ("code", "n", "best"))
    order = np.argsort(code)
    return spark.sparkContext.broadcast((code[order], n[order], best[order])), total <= limit


def align_tokens(docs: DataFrame, path_a: str, path_b: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: the id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of the text's alignment.

    Texts are shuffled by their full text, and each distinct one is tokenised and aligned once, with the number of its rows.
    A pair of ids counts that number for every distinct text that links it. The counts of the most frequent pairs go to the
    texts' own link lists as arrays (HEAD of them at most, about); links of all other pairs meet their counts in a
    shuffled join, where no key is frequent. Sums join the rows by a digest (sha256) of the text.

    Null and empty texts, and texts that the tokens of either tokenizer do not spell, have zeros and ''. Repeated rows are
    documents of their own; null ids stay null. Texts of any length are aligned whole. Other columns of docs are not
    returned; an empty table gives no rows.
    """
    spark = docs.sparkSession
    space = Workspace(spark, "alignment")
    text = F.col(text_col)
    distinct = docs.where(F.length(text) > 0).select(text.alias("text")).groupBy("text").agg(F.count("*").alias("copies")).select(F.unhex(F.sha2("text", 256)).alias("digest"), "copies", "text")
    aligned = space.save(distinct.mapInArrow(_align(path_a, path_b, pattern), f"digest binary, copies long, {COUNTS}, groups_sha256 string, codes array<long>, links array<long>"), "aligned")
    pairs = aligned.select("copies", F.explode("codes").alias("code")).groupBy("code").agg(F.sum("copies").alias("n"))
    size_b = PieceTokenizer(path_b).model.get_piece_size()
    # an id of A meets as many ids of B as there are, at most
    counts = space.save(pairs.withColumn("best", F.col("n") == F.max("n").over(Window.partitionBy(F.expr(f"code div {size_b}")))), "counts")
    head, all_known = _head(spark, counts, HEAD)
    measured = aligned.mapInArrow(_measure(head), f"digest binary, {COUNTS}, groups_sha256 string, n_best long, count_sum long, rest array<struct<code: long, links: long>>")
    if not all_known:
        measured = space.save(measured, "measured")
        rest = measured.select("digest", F.inline("rest")).join(counts, "code").groupBy("digest").agg(F.sum(F.col("links") * F.col("n")).alias("more"), F.sum(F.when(F.col("best"), F.col("links")).otherwise(0)).alias("more_best"))
        measured = measured.join(rest, "digest", "left").withColumn("n_best", F.col("n_best") + F.coalesce("more_best", F.lit(0))).withColumn("count_sum", F.col("count_sum") + F.coalesce("more", F.lit(0)))
    # toDF: the texts derive from the same rows
    rows = docs.select(F.col(id_col).cast("long").alias("d"), F.when(F.length(text) > 0, F.unhex(F.sha2(text, 256))).alias("digest")).toDF("d", "digest")
    out = rows.join(measured.drop("rest"), "digest", "left")
    zeros = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]
    return out.select(F.col("d").alias(id_col), *[F.coalesce(c, F.lit(0)).alias(c) for c in zeros], F.coalesce("groups_sha256", F.lit("")).alias("groups_sha256"))
