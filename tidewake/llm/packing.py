"""Operator 3: documents packed into token sequences by Karmarkar-Karp multiway differencing."""

from __future__ import annotations

import heapq
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace, text_groups

CAPACITY = 4096
END_ID = 2
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
PACKED = PIECES + ", sequence_id long, offset long"
#: A block of the differencing: about so many tokens, and at most about so many pieces.
BLOCK_TOKENS = 256 * CAPACITY
BLOCK_PIECES = 16384
#: A document's rest of over 4 * FILLER ids gives its last FILLER to 2 * FILLER - 1 ids as a piece of their own.
FILLER = 64
#: Characters of the vector path: ASCII, and the Latin-1 letters that lower() maps one to one and NFC leaves as they are.
_SAFE = "\t-\r -~À-ÖØ-öø-ÿ"
_FOREIGN = re.compile(f"[^\t-\r ]*[^{_SAFE}][^\t-\r ]*|<\\|(?:startoftext|endoftext)\\|>")
_MARK = "\x01"  # stands for a word that holds another character
_SPACE, _LETTER, _DIGIT, _OTHER, _ALIEN = range(5)
_CLASS = np.full(256, _OTHER, np.uint8)
_CLASS[[9, 10, 11, 12, 13, 32]] = _SPACE
_CLASS[[b for b in range(256) if chr(b).isalpha() and b not in (0xAA, 0xB5, 0xBA)]] = _LETTER
_CLASS[48:58] = _DIGIT
_CLASS[1] = _ALIEN
_LOWER = np.asarray([ord(chr(b).lower()) if _CLASS[b] == _LETTER else b for b in range(256)], np.uint8)
#: Characters that are encoded together, and words that the memo holds at most.
CHUNK, MEMO = 1 << 20, 600_000


class WordEncoder:
    """Ids of whole texts as little-endian bytes, by numpy over many texts at once, with a memo of pre-tokens.

    The tokenizer's normalizer and pre-tokenizer never look across white space. In ASCII and Latin-1 letters the
    pre-tokens are runs of letters, single digits, runs of other marks, and the contractions that begin such a run; they
    are found by comparing neighbours, hashed to 64 bits, and looked up in a sorted memo of ids. New letter runs are encoded
    many at once by the same model without normalizer or pattern. A word with any other character goes through the
    tokenizer as it is. The memo holds MEMO pre-tokens in flat arrays, some 40 bytes each; full, it drops the half that was not used for longest.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.tokenizer = Tokenizer.from_file(path)
        self.plain = Tokenizer.from_file(path)
        self.plain.normalizer = None
        self.plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocab = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        for token, i in vocab.items():
            self.ends[i] = token.endswith("</w>")
        self.keys, self.begin, self.size, self.used = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.pool, self.round = np.zeros(0, np.uint32), 0
        self.power = np.ones(1, np.uint64)

    def _ids(self, text: str) -> np.ndarray:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def _encoded(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids of each word): letter runs 128 at once, parted again at the tokens that end a word."""
        parts, sizes = [], []
        for at in range(0, len(words), 128):
            own = words[at : at + 128]
            ids = np.asarray(self.plain.encode_batch_fast([" ".join(own)], add_special_tokens=False)[0].ids, np.uint32)
            ends = np.flatnonzero(self.ends[ids]) + 1
            if len(ends) != len(own):
                each = [self._ids(w) for w in own]
                ids, ends = np.concatenate(each), np.cumsum([len(x) for x in each])
            parts.append(ids)
            sizes.append(np.diff(ends, prepend=0))
        return np.concatenate(parts), np.concatenate(sizes)

    def _learn(self, keys: np.ndarray, words: list[str]) -> None:
        """Adds pre-tokens, keys ascending."""
        letters = [i for i, w in enumerate(words) if w.isalpha()]
        rest = [i for i, w in enumerate(words) if not w.isalpha()]
        ids, sizes = self._encoded([words[i] for i in letters]) if letters else (np.zeros(0, np.uint32), np.zeros(0, np.int64))
        other = [self._ids(words[i]) for i in rest]
        size = np.zeros(len(words), np.int64)
        size[letters], size[rest] = sizes, [len(x) for x in other]
        begin = np.zeros(len(words), np.int64)
        begin[letters] = np.cumsum(sizes) - sizes
        begin[rest] = len(ids) + np.cumsum([0, *[len(x) for x in other]])[:-1]
        if len(self.keys) + len(keys) > MEMO and len(self.keys):
            stay = self.used > np.sort(self.used)[len(self.used) // 2] if self.used.max() > self.used.min() else np.zeros(len(self.keys), bool)
            spots, self.size = _ranges(self.begin[stay], self.size[stay]), self.size[stay]
            self.pool, self.begin = self.pool[spots], np.cumsum(self.size) - self.size
            self.keys, self.used = self.keys[stay], self.used[stay]
        begin += len(self.pool)
        self.pool = np.concatenate([self.pool, ids, *other])
        at = np.searchsorted(self.keys, keys)
        self.begin, self.size, self.used = (np.insert(a, at, v) for a, v in ((self.begin, begin), (self.size, size), (self.used, self.round)))
        self.keys = np.insert(self.keys, at, keys)

    def _chunk(self, texts: list[str]) -> list[np.ndarray]:
        aliens: list[str] = []

        def alien(m: re.Match) -> str:
            aliens.append(m.group())
            return _MARK

        clean = [_FOREIGN.sub(alien, t) if "<|" in t or _UNSAFE.search(t) else t for t in texts]
        raw = _LOWER[np.frombuffer(("\n".join(clean) + "\n\n\n").encode("latin-1"), np.uint8)]  # room to look two characters ahead
        kind = _CLASS[raw]
        edge = np.empty(len(raw), bool)
        edge[0] = True
        np.not_equal(kind[1:], kind[:-1], out=edge[1:])
        edge |= (kind == _DIGIT) | (kind == _ALIEN)
        # contractions: a mark at the start of a run, and the letters after it
        quote = np.flatnonzero((raw[:-2] == 39) & edge[:-2] & (kind[1:-1] == _LETTER))
        one, two = raw[quote + 1], raw[quote + 2]
        length = np.where(np.isin(one, _SHORT), 2, np.where((np.isin(one, _LONG) & (two == 101)) | ((one == 108) & (two == 108)), 3, 0))
        quote, length = quote[length > 0], length[length > 0]
        edge[quote + 1] = False
        edge[quote + length] = True
        starts = np.flatnonzero(edge)
        ends = np.append(starts[1:], len(raw))
        word = kind[starts] != _SPACE
        starts, ends = starts[word], ends[word]
        stops = np.cumsum([len(t) + 1 for t in clean])
        if not len(starts):
            return [np.zeros(0, np.uint32)] * len(texts)
        if (most := int((ends - starts).max())) > len(self.power):
            self.power = np.cumprod(np.full(most, 0x9E3779B97F4A7C15, np.uint64))
        spots = _ranges(starts, ends - starts)
        place = spots - np.repeat(starts, ends - starts)
        h = np.add.reduceat((raw[spots].astype(np.uint64) + np.uint64(1)) * self.power[place], np.cumsum(ends - starts) - (ends - starts))
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        own = kind[starts] != _ALIEN
        order = np.argsort(h)
        change = np.empty(len(h), bool)
        change[0] = True
        np.not_equal(h[order][1:], h[order][:-1], out=change[1:])
        unique, first = h[order][change], order[change]
        which = np.empty(len(h), np.int64)
        which[order] = np.cumsum(change) - 1
        self.round += 1
        at = np.minimum(np.searchsorted(self.keys, unique), max(0, len(self.keys) - 1))
        known = self.keys[at] == unique if len(self.keys) else np.zeros(len(unique), bool)
        self.used[at[known]] = self.round
        new = ~known & own[first]
        if new.any():
            line = raw.tobytes().decode("latin-1")
            self._learn(unique[new], [line[a:b] for a, b in zip(starts[first[new]].tolist(), ends[first[new]].tolist())])
        at = np.minimum(np.searchsorted(self.keys, unique), max(0, len(self.keys) - 1))
        begin, size, pool = self.begin[at][which] if len(self.keys) else np.zeros(len(h), np.int64), self.size[at][which] if len(self.keys) else np.zeros(len(h), np.int64), self.pool
        if aliens:
            each = [self._ids(w) for w in aliens]
            size[~own] = [len(x) for x in each]
            begin[~own] = len(pool) + np.cumsum([0, *[len(x) for x in each]])[:-1]
            pool = np.concatenate([pool, *each])
        ids = pool[_ranges(begin, size)]
        total = np.concatenate([[0], np.cumsum(size)])
        cuts = total[np.searchsorted(starts, stops)]
        return np.split(ids, cuts[:-1])

    def encode_all(self, texts: list[str]) -> list[bytes]:
        out: list[list[bytes]] = [[] for _ in texts]
        owner, part, held = [], [], 0

        def flush() -> None:
            for i, ids in zip(owner, self._chunk(part)):
                out[i].append(ids.astype("<u4").tobytes())
            owner.clear()
            part.clear()

        for i, text in enumerate(texts):
            for piece in _pieces(text):
                if part and held + len(piece) > CHUNK:
                    flush()
                    held = 0
                owner.append(i)
                part.append(piece)
                held += len(piece)
        if part:
            flush()
        return [b"".join(x) for x in out]


_UNSAFE = re.compile(f"[^{_SAFE}]")
#: What makes a contraction with the mark before it.
_SHORT, _LONG = np.frombuffer(b"stmd", np.uint8), np.frombuffer(b"rv", np.uint8)
_CUT = re.compile("[\t-\r ]")


def _pieces(text: str) -> Iterator[str]:
    """A text in pieces of about CHUNK characters, parted at white space only."""
    at = 0
    while len(text) - at > CHUNK:
        space = _CUT.search(text, at + CHUNK)
        if space is None:
            break
        yield text[at : space.start()]
        at = space.start()
    yield text[at:]


def _ranges(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Indexes begin .. begin + size - 1 of every pair, one after another."""
    return np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


_encoders: dict[str, WordEncoder] = {}


def encoder_of(path: str) -> WordEncoder:
    """The encoder of this Python worker, which keeps its memo from task to task."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def token_pieces(docs: DataFrame, tokenizer_path: str, *, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Every document's ids plus end_id, cut into pieces of capacity ids and the rest, whose end is a small piece of its own. Only lengths and checksums leave the task."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(tokenizer_path)
        end = np.asarray([end_id], "<u4").tobytes()
        for batch in batches:
            rows: list[tuple] = []
            for ids_of, texts in text_groups(batch.column(0).to_pylist(), batch.column(1).to_pylist(), CHUNK):
                for doc, ids in zip(ids_of, encoder.encode_all(texts)):
                    ids += end
                    n = len(ids) // 4
                    cuts = [*range(0, n, capacity), n]
                    if n % capacity > 4 * FILLER:  # the small last piece evens windows out
                        cuts.insert(-1, n - FILLER - n * 7919 % FILLER)
                    rows += [(doc, s, e - s, zlib.crc32(ids[4 * s : 4 * e]), n) for s, e in zip(cuts, cuts[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)] if rows else [pa.array([], pa.int64())] * 5, names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(cut, PIECES)


def difference(lengths: list[int], k: int) -> list[list[int]]:
    """Karmarkar-Karp over k windows: the two partial partitions of largest imbalance merge, large windows of one with small of the other.

    Returns at most k lists of indexes into lengths. A partial partition keeps the sums of the windows it has filled,
    largest first, and a node number for each; a node is an index into lengths or the union of two nodes.
    """
    n = len(lengths)
    heap: list[tuple[int, int]] = [(-x, i) for i, x in enumerate(lengths)] if k > 1 else [(0, i) for i in range(n)]
    heapq.heapify(heap)
    sums = {i: np.asarray([x]) for i, x in enumerate(lengths)}
    nodes = {i: np.asarray([i]) for i in range(n)}
    unions: list[np.ndarray] = []
    made, tick = n, n
    while len(heap) > 1:
        p, q = heapq.heappop(heap)[1], heapq.heappop(heap)[1]
        a, b, na, nb = sums.pop(p), sums.pop(q), nodes.pop(p), nodes.pop(q)
        # of k windows each, a descending and b ascending: what both have filled meets a's smallest and b's smallest
        over = max(0, len(a) + len(b) - k)
        tail, rest = len(a) - over, len(b) - over
        if over:
            unions.append(np.stack([na[tail:], nb[::-1][:over]], 1))
            s = np.concatenate([a[:tail], a[tail:] + b[::-1][:over], b[:rest]])
            m = np.concatenate([na[:tail], np.arange(made, made + over), nb[:rest]])
            made += over
        else:
            s, m = np.concatenate([a, b]), np.concatenate([na, nb])
        order = np.argsort(-s, kind="stable")
        sums[tick], nodes[tick] = s[order], m[order]
        heapq.heappush(heap, (-int(s[order[0]] - (s[order[-1]] if len(s) == k else 0)), tick))
        tick += 1
    parts = np.concatenate(unions).tolist() if unions else []
    out = []
    for root in nodes[heap[0][1]].tolist() if heap else []:
        open_, own = [root], []
        while open_:
            x = open_.pop()
            if x < n:
                own.append(x)
            else:
                open_ += parts[x - n]
        out.append(sorted(own))
    return out


def pack_lengths(lengths: list[int], capacity: int) -> list[list[int]]:
    """Windows of at most capacity: the fewest that the total allows, then more for as long as one is exceeded."""
    if not lengths:
        return []
    k = -(-sum(lengths) // capacity)
    while True:
        windows = difference(lengths, k)
        if all(sum(lengths[i] for i in w) <= capacity for w in windows):
            return [w for w in windows if w]
        k += max(1, k // 256)


def pack(docs: DataFrame, tokenizer_path: str, *, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Pieces of all documents with their sequence and offset.

    Full pieces fill a sequence each. The rest of all documents are dealt by hash into blocks of bounded size, and
    each block is split by differencing, so no task or driver holds more than a block's lengths; texts and ids never
    move. A null text is empty (one end id); repeated rows are packed each; a null id is kept as null; an empty table
    gives no rows. sequence_id is the block's number times 2^32 plus the window's.
    """
    spark = docs.sparkSession
    space = Workspace(spark, "packing")
    pieces = space.save(token_pieces(docs, tokenizer_path, id_col=id_col, text_col=text_col, capacity=capacity, end_id=end_id), "pieces")
    total = pieces.agg(F.count("*").alias("n"), F.sum("length").alias("t")).first()
    blocks = max(1, -(-(total["t"] or 0) // (BLOCK_TOKENS * capacity // CAPACITY)), -(-total["n"] // BLOCK_PIECES))

    def windows(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "doc_id", "start", "ids_crc32"], ascending=[False, True, True, True], ignore_index=True)
        lengths = pdf["length"].tolist()
        full = sum(n >= capacity for n in lengths)
        parts = [[i] for i in range(full)] + [[full + i for i in w] for w in pack_lengths(lengths[full:], capacity)]
        sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
        for s, window in enumerate(parts):
            at = 0
            for i in window:
                sequence[i], offset[i] = (int(key[0]) << 32) + s, at
                at += lengths[i]
        return pdf.drop(columns="block").assign(sequence_id=sequence, offset=offset)

    dealt = pieces.withColumn("block", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(blocks)))
    return dealt.groupBy("block").applyInPandas(windows, PACKED)
