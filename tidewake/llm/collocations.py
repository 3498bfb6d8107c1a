"""Operator 13: phrase collocations, counted by double-array tries of Apriori-safe candidates over all text positions at once."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Workspace

#: Words of a stretch of texts of one language that is written as one row.
CHUNK = 1 << 17
#: Stretches that pass to a task at once, of about a MB each.
STRETCHES = 4
#: Phrases that a task sums up before it passes them on.
SUMMED = 200_000
#: Passes in which pairs of words are summed, by their first word, so that a task has few of them at a time.
PAIR_PASSES = 4
#: Tasks for each core of the passes over pairs and of the counting pass: every task passes on one sum of each pair or phrase that it has seen.
PAIR_SHARDS = 6
SHARDS = 3
#: Phrases of a trie. More are dealt to several, by hash, each with a pass of its own.
BLOCK = 1_000_000
#: Bases that are drawn for a node of a trie before there are new slots for it.
DRAWS = 32
#: Parts of a language's candidates whose best are found first.
SALTS = 32
_BREAK = b"\n"
_TABLE = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?\n\x0b\x0c\r\t", b"abcdefghijklmnopqrstuvwxyz" + _BREAK * 10 + b" ")


class _Stretch(dict):
    """Texts of one language as numbers of their words: 0 is a break between pieces, -1 nothing."""

    def __init__(self):
        super().__init__({b"": -1, _BREAK: 0})
        self.parts: list[np.ndarray] = []
        self.size = 0

    def __missing__(self, word: bytes) -> int:
        value = self[word] = len(self) - 1
        return value

    def add(self, text: bytes) -> None:
        words = text.translate(_TABLE).replace(_BREAK, b" \n ").split(b" ")
        codes = np.fromiter(map(self.__getitem__, words), np.int32, len(words))
        self.parts += [codes[codes >= 0], np.zeros(1, np.int32)]
        self.size += len(self.parts[-2]) + 1

    def row(self, lang: str) -> pa.RecordBatch:
        codes, words = np.concatenate(self.parts), list(self)[2:]
        # the words' keys are what Spark's xxhash64 makes of language and word
        seed = xxhash.xxh64_intdigest(lang.encode(), 42)
        keys = np.asarray([xxhash.xxh64_intdigest(w, seed) for w in words], np.uint64)
        counts = np.bincount(codes, minlength=len(words) + 1)[1:]
        one = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
        # numbers as bytes: they pass from Spark to a task and back at once, not one by one
        columns = [pa.array([lang]), pa.array([codes.tobytes()], pa.binary()), pa.array([keys.tobytes()], pa.binary()), one(pa.array(words, pa.binary()).cast(pa.string())), one(pa.array(counts, pa.int32()))]
        return pa.RecordBatch.from_arrays(columns, names=["lang", "codes", "keys", "words", "counts"])


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    open_: dict[str, _Stretch] = {}
    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").cast(pa.binary())):
            stretch = open_.setdefault(lang, _Stretch())
            stretch.add(text.as_py())
            if stretch.size >= CHUNK:
                yield open_.pop(lang).row(lang)
            elif len(open_) > 64:  # of many languages, the fullest goes
                full = max(open_, key=lambda k: open_[k].size)
                yield open_.pop(full).row(full)
    for lang, stretch in open_.items():
        yield stretch.row(lang)


class DoubleArray:
    """Trie of word sequences in two arrays: state s goes over symbol c to t = base[s] + c, if check[t] == s.

    phrases: one row each of word keys, 0 after the last word, all distinct. A symbol is a key's place among all keys, and
    the states of single words are their symbols. accept[t] is the row of the phrase that ends in t, or -1.
    """

    def __init__(self, phrases: np.ndarray):
        self.phrases = phrases
        self.alphabet = np.unique(phrases[phrases != 0])
        a = len(self.alphabet)
        symbols = np.where(phrases != 0, np.searchsorted(self.alphabet, phrases), -1)
        self.base = np.zeros(a, np.int64)
        self.check = np.full(a, -1, np.int64)
        self.free = a  # no slot from here on is taken
        state = symbols[:, 0].copy()
        length = (symbols >= 0).sum(1)
        last = [(state[length == 1], np.flatnonzero(length == 1))]
        for level in range(1, phrases.shape[1]):
            rows = np.flatnonzero(length > level)
            edges, place = np.unique(state[rows] * (a + 1) + symbols[rows, level], return_inverse=True)
            state[rows] = self._place(edges // (a + 1), edges % (a + 1))[place]
            last.append((state[length == level + 1], np.flatnonzero(length == level + 1)))
        self.accept = np.full(len(self.check), -1, np.int64)
        for states, rows in last:
            self.accept[states] = rows
        self.base, self.check, self.accept = (x.astype(np.int32) for x in (self.base, self.check, self.accept))

    def _grow(self, size: int) -> None:
        more = max(0, size - len(self.check))
        self.check = np.concatenate([self.check, np.full(more, -1, np.int64)])
        self.base = np.concatenate([self.base, np.zeros(more, np.int64)])

    def _place(self, parents: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        """States of edges (sorted by parent and symbol): bases are drawn at random, those of the largest nodes first, until no two edges share a slot.

        Nodes that find no base in so many draws get new slots behind all others.
        """
        nodes, begin, degree = np.unique(parents, return_index=True, return_counts=True)
        a, rng = len(self.alphabet), np.random.default_rng(len(parents))
        states = np.full(len(parents), -1, np.int64)
        # slots of the single words never hold an edge
        self._grow(a + max(2 * a, len(self.check) + 3 * len(parents)))
        taken = self.check >= 0
        taken[:a] = True

        def settle(which: np.ndarray, start: int = a) -> np.ndarray:
            """Tries a base for each node, with its slots from start on; returns the nodes without luck."""
            edge = np.repeat(begin[which] - degree[which].cumsum() + degree[which], degree[which]) + np.arange(degree[which].sum())
            owner = np.repeat(np.arange(len(which)), degree[which])
            low = symbols[begin[which]]
            high = symbols[begin[which] + degree[which] - 1]
            base = start - low + (rng.random(len(which)) * (len(taken) - start - (high - low))).astype(np.int64)
            slots = base[owner] + symbols[edge]
            first = np.zeros(len(slots), bool)
            first[np.unique(slots, return_index=True)[1]] = True
            lost = np.zeros(len(which), bool)
            lost[owner[taken[slots] | ~first]] = True
            good = ~lost[owner]
            states[edge[good]] = slots[good]
            taken[slots[good]] = True
            self.check[slots[good]] = parents[edge[good]]
            self.base[nodes[which[~lost]]] = base[~lost]
            return which[lost]

        order = np.argsort(-degree, kind="stable")
        large = order[: int((degree > 32).sum())]
        for node in large:
            for _ in range(DRAWS):
                if not len(settle(np.asarray([node]))):
                    break
            else:  # behind all others
                many = len(self.check)
                self._grow(many + a)
                taken = np.concatenate([taken, np.zeros(a, bool)])
                edge = slice(begin[node], begin[node] + degree[node])
                base = many - symbols[begin[node]]
                states[edge] = base + symbols[edge]
                taken[states[edge]] = True
                self.check[states[edge]] = nodes[node]
                self.base[nodes[node]] = base
        rest, start = order[len(large) :], a
        while len(rest):
            for _ in range(DRAWS):
                rest = settle(rest, start)
            start, more = len(self.check), a + 4 * int(degree[rest].sum())
            if len(rest):
                self._grow(start + more)
                taken = np.concatenate([taken, np.zeros(more, bool)])
        return states

    def symbols(self, keys: np.ndarray) -> np.ndarray:
        """Symbols of keys, -1 where a key is none."""
        at = np.minimum(np.searchsorted(self.alphabet, keys), len(self.alphabet) - 1)
        return np.where(self.alphabet[at] == keys, at, -1)

    def walk(self, text: np.ndarray, levels: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Level by level, all positions of a text of symbols (-1: none) at once: where phrases begin, and the states they have come to."""
        place = np.flatnonzero(text >= 0)
        state = text[place]
        yield place, state
        for level in range(1, levels):
            room = place + level < len(text)
            place, state = place[room], state[room]
            symbol = text[place + level]
            to = self.base[state] + symbol
            good = (symbol >= 0) & (to >= 0) & (to < len(self.check))
            good[good] = self.check[to[good]] == state[good]
            place, state = place[good], to[good]
            yield place, state


def _stretches(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for codes, keys in zip(batch.column("codes"), batch.column("keys")):
        yield np.frombuffer(codes.as_buffer(), np.int32), np.frombuffer(keys.as_buffer(), np.int64)


@contextmanager
def _few_at_once(spark: SparkSession) -> Iterator[None]:
    """Jobs run in here pass STRETCHES rows to a task at once: rows of a MB need no batches of thousands."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, STRETCHES)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _emit(phrases: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*(pa.array(np.ascontiguousarray(c)) for c in phrases.T), pa.array(counts.astype(np.int64))], names=[*_keys(phrases.shape[1]), "n"])


def _keys(words: int) -> list[str]:
    return [f"k{i}" for i in range(words)]


def _schema(words: int) -> str:
    return ", ".join(f"{c} long" for c in [*_keys(words), "n"])


def _longer(trie, level: int, whole: bool, part: int, parts_of: int) -> Callable:
    """Occurrences n of phrases of `level` words whose first level-1 are the trie's phrase p, for one part of the phrases p.

    Where the trie holds all phrases, the last ones must be another of them, the last word k is a symbol, and p and k are
    one number pk, so that a row is short. Where it is one of several, k is the word's key, and the rows are (p, k, n).
    """

    def emit(parts: list) -> pa.RecordBatch:
        *keys, n = (np.concatenate(x) for x in zip(*parts))
        order = np.lexsort(keys[::-1])
        keys, n = [k[order] for k in keys], n[order]
        new = np.concatenate([[True], np.any([k[1:] != k[:-1] for k in keys], axis=0)])
        return pa.RecordBatch.from_arrays([*(pa.array(k[new]) for k in keys), pa.array(np.add.reduceat(n, np.flatnonzero(new)))], names=[*_pair(whole), "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t: DoubleArray = trie.value
        parts, size = [], 0
        for batch in batches:
            for codes, keys in _stretches(batch):
                text = np.concatenate([[-1], t.symbols(keys)])[codes]
                *_, (place, state) = t.walk(text, level - 1)
                phrase = np.full(len(codes) + 1, -1, np.int64)
                phrase[place] = t.accept[state]
                begin = np.flatnonzero(phrase[:-1] >= 0)
                begin = begin[(begin + level <= len(codes)) & (phrase[begin] % parts_of == part)]
                if whole:
                    begin = begin[phrase[begin + 1] >= 0]
                word, base = (text, len(t.alphabet)) if whole else (codes.astype(np.int64) - 1, len(keys))
                word = word[begin + level - 1]
                begin, word = begin[word >= 0], word[word >= 0]
                pairs, counts = np.unique(phrase[begin] * base + word, return_counts=True)
                if len(pairs):
                    parts.append((pairs, counts.astype(np.int64)) if whole else (pairs // base, keys[pairs % base], counts.astype(np.int64)))
                    size += len(pairs)
                if size >= SUMMED:
                    yield emit(parts)
                    parts, size = [], 0
        if parts:
            yield emit(parts)

    return run


def _pair(whole: bool) -> list[str]:
    return ["pk"] if whole else ["p", "k"]


def _spelled(trie, level: int | None = None, whole: bool = True) -> Callable:
    """The word keys of what _longer counted, or of (p, n) where the phrases are the trie's own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t: DoubleArray = trie.value
        for batch in batches:
            if level is None:
                phrases = t.phrases[batch.column("p").to_numpy()]
            else:
                if whole:
                    p, k = np.divmod(batch.column("pk").to_numpy(), len(t.alphabet))
                else:
                    p, k = batch.column("p").to_numpy(), batch.column("k").to_numpy()
                phrases = t.phrases[p].copy()
                phrases[:, level - 1] = t.alphabet[k] if whole else k
            yield _emit(phrases, batch.column("n").to_numpy())

    return run


def _counted(trie, levels: int) -> Callable:
    """(p, n): occurrences of the trie's phrases, accepting states of a task's stretches by bincount."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t: DoubleArray = trie.value
        total = np.zeros(len(t.phrases), np.int64)
        for batch in batches:
            for codes, keys in _stretches(batch):
                text = np.concatenate([[-1], t.symbols(keys)])[codes]
                for _, state in t.walk(text, levels):
                    row = t.accept[state]
                    total += np.bincount(row[row >= 0], minlength=len(total))
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], names=["p", "n"])

    return run


def _passes(phrases: DataFrame, words: int, run: Callable, space: Workspace) -> DataFrame:
    """What run(trie, whether it holds all) makes of the tries of the phrases, one trie of about BLOCK phrases at a time."""
    spark, cols = phrases.sparkSession, _keys(words)
    blocks = max(1, -(-phrases.count() // BLOCK))
    parts = []
    for b in range(blocks):
        own = phrases if blocks == 1 else phrases.where(F.pmod(F.xxhash64(*cols), F.lit(blocks)) == b)
        table = own.select(*cols).toArrow()
        if table.num_rows:
            trie = spark.sparkContext.broadcast(DoubleArray(np.column_stack([table.column(c).to_numpy() for c in cols])))
            parts.append(run(trie, blocks == 1))
            if blocks > 1:
                parts[-1] = space.save(parts[-1], "pass")
                trie.destroy()
    if not parts:
        return spark.createDataFrame([], _schema(words))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def collocations(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", min_count: int = 30, max_words: int = 4, keep: int = 2000, cover: tuple[int, int] = (80, 100), scale: int = 2_000_000) -> DataFrame:
    """Per language its `keep` best phrases of 2 to max_words words: lang, rank, phrase, a, l, r, n, score (all numbers long).

    Texts become stretches of word numbers, each with its own word list; all passes read these. Words of min_count
    occurrences or more are the first level. A phrase can only be frequent if its first and its last words are, so at every
    level a trie of the frequent phrases before, walked from all positions at once, finds where a longer one can stand;
    what such positions sum to prunes the candidates (no frequent phrase is lost, and no join of phrases is made). All candidates then
    form double-array tries, which one pass walks level by level from all positions; accepting states are counted by
    bincount in each task, and the tasks' counts are summed. Tries hold about BLOCK phrases, however many there are.

    A candidate is cut where its score floor(scale * a / (l + r)) is lowest (ties: the shorter first part), in decimal
    arithmetic, and goes if a longer one that holds it has cover[0]/cover[1] of its occurrences or more. Best phrases are
    found in parts of a language first. Null texts hold no words; a null language is `und`; repeated rows count each time; an empty
    table gives no rows. Other columns are not read. Words are told apart by 64-bit hashes of language and word.
    """
    space = Workspace(docs.sparkSession, "phrases")
    cols = _keys(max_words)
    texts = docs.select(F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"), F.col(text_col).alias("text")).where("text IS NOT NULL")
    chunks = space.save(texts.mapInArrow(_encode, "lang string, codes binary, keys binary, words array<string>, counts array<int>"), "stretches")
    words = chunks.select("lang", F.inline(F.arrays_zip("words", "counts"))).groupBy("lang", F.col("words").alias("word")).agg(F.sum("counts").alias("n"))
    words = space.save(words, "words")
    totals = words.groupBy("lang").agg(F.sum("n").alias("n"))
    frequent = space.save(words.where(F.col("n") >= min_count).select("lang", "word", F.xxhash64("lang", "word").alias("k0"), *[F.lit(0).cast("long").alias(c) for c in cols[1:]], "n"), "frequent")
    chunks, cores = chunks.select("codes", "keys"), docs.sparkSession.sparkContext.defaultParallelism
    dealt, shards = chunks.coalesce(PAIR_SHARDS * cores), chunks.coalesce(SHARDS * cores)
    level, candidates, schema = frequent, None, _schema(max_words)
    for size in range(2, max_words + 1):

        def longer(trie, whole: bool, size: int = size) -> DataFrame:
            # a phrase's first words are in one trie and one part only, so its sum is whole; sums are few, and spelled in few tasks
            passes, out, pair = PAIR_PASSES if size == 2 else 1, None, _pair(whole)
            for part in range(passes):
                found = dealt.mapInArrow(_longer(trie, size, whole, part, passes), ", ".join(f"{c} long" for c in [*pair, "n"])).groupBy(*pair).agg(F.sum("n").alias("n"))
                with _few_at_once(found.sparkSession):
                    found = space.save(found.where(F.col("n") >= min_count), "pairs")
                out = found if out is None else out.unionByName(found)
            return out.mapInArrow(_spelled(trie, size, whole), schema)

        level = space.save(_passes(level, max_words, longer, space).select(*cols), f"level{size}")
        candidates = level if candidates is None else candidates.unionByName(level)

    def count(trie, whole: bool) -> DataFrame:
        total = shards.mapInArrow(_counted(trie, max_words), "p long, n long").groupBy("p").agg(F.sum("n").alias("n"))
        with _few_at_once(total.sparkSession):
            total = space.save(total, "sums")
        return total.mapInArrow(_spelled(trie), schema)

    # a candidate is in one trie
    counted = space.save(_passes(candidates, max_words, count, space).select(*cols, F.col("n").alias("a")), "counted")

    freq = frequent.select(*cols, F.col("n").alias("f")).unionByName(counted.select(*cols, F.col("a").alias("f")))
    all_keys = F.filter(F.array(*cols), lambda k: k != 0)
    padded = lambda keys: [F.coalesce(F.get(keys, F.lit(i)), F.lit(0)).alias(c) for i, c in enumerate(cols)]

    def part(name: str) -> DataFrame:
        return freq.select(F.array(*cols).alias(f"{name}_keys"), F.col("f").alias(name))

    def full(keys: Column) -> Column:
        return F.array(*padded(keys))

    sized = counted.withColumn("keys", all_keys).withColumn("size", F.size("keys"))
    cuts = sized.select(*cols, "a", "keys", "size", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cuts = cuts.withColumn("l_keys", full(F.slice("keys", F.lit(1), F.col("k")))).withColumn("r_keys", full(F.slice("keys", F.col("k") + 1, F.col("size"))))
    cuts = cuts.join(part("l"), "l_keys").join(part("r"), "r_keys").withColumn("score", F.expr(f"CAST({scale} AS DECIMAL(18,0)) * CAST(a AS DECIMAL(20,0)) div CAST(l + r AS DECIMAL(20,0))"))
    best = cuts.groupBy(*cols, "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    # every phrase of two words or more within a longer one
    inner = F.flatten(F.transform(F.sequence(F.lit(2), F.col("size") - 1), lambda m: F.transform(F.sequence(F.lit(1), F.col("size") - m + 1), lambda i: F.slice("keys", i, m))))
    within = sized.where("size > 2").select("a", F.explode(inner).alias("sub")).groupBy(*padded("sub")).agg(F.max("a").alias("longest"))
    rest = best.join(within, cols, "left").where(F.col("longest").isNull() | (F.col("longest") * cover[1] < F.col("a") * cover[0]))

    spelled = rest.select(*cols, "a", "cut", F.posexplode(all_keys).alias("at", "key")).join(frequent.select(F.col("k0").alias("key"), "lang", "word"), "key")
    spelled = spelled.groupBy(*cols, "a", "cut", "lang").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    ranked = spelled.select("lang", "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), F.col("cut.score").alias("score"), F.pmod(F.xxhash64("phrase"), F.lit(SALTS)).alias("salt"))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    ranked = ranked.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= keep)
    ranked = ranked.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= keep)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
