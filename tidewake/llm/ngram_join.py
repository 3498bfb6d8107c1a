"""Operator 7: word n-gram Jaccard join by PartEnum signatures, and the components of its links."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Workspace

#: The first round of hubs takes one signature in so many; near copies share enough of them to meet there.
FIRST = 8
#: A signature stands for at least so many shingles wherever the guarantee allows it.
STRONG = 3
#: Shingles of a block of asking documents, and of the documents that it meets at once.
BLOCK, GROUP = 400_000, 1_000_000
#: Ids that may be broadcast, of eight bytes each.
SMALL = 4_000_000
#: Copies that may be broadcast, of three numbers each.
COPIES = 1_000_000
_MEMO = 200_000
_M1, _M2, _M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= _MEMO:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _M2
    h = (h ^ (h >> np.uint64(27))) * _M3
    return h ^ (h >> np.uint64(31))


def shingles(text: str | None, n: int, memo: _Words) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's n-word shingles; A-Z lower-cased, words parted by ASCII white space."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))
    if len(words) < n:
        return np.asarray([xxhash.xxh3_64_intdigest(b" ".join(words))], np.uint64)
    a = np.zeros(len(words) - n + 1, np.uint64)
    for i in range(n):
        a = _mix(a * _M1 + h[i : len(words) - n + 1 + i])
    return np.unique(a)


def signatures(s: np.ndarray, num: int, den: int) -> np.ndarray:
    """PartEnum signatures of a set, for Jaccard >= num/den.

    Sizes fall in bands [2^b, 2^(b+1)). A set signs in its own band, and in the band below if a set there can still
    be similar enough; so every similar pair meets in one band. In a band the hashed domain has `groups` first-level
    partitions of three second-level ones each. Similar sets differ in at most k elements, so by pigeonhole some group
    differs in at most one, hence in one second-level partition at most; of the three subsets of two partitions that are
    enumerated for it, one is equal in both sets, and so is its signature. There are more groups than k/2 + 1, so the
    pigeonhole leaves several such groups, and subsets of few elements need not be signed: a set leaves out those under
    the largest m <= STRONG for which no more groups than that surplus lose a subset. An equal subset has as many
    elements in either set, and of two sets the one with the larger m keeps a common group whole, so the other signs its
    equal subset too. Sets that can have no partner but an equal one sign nothing; equal sets are one class before.
    """
    size = len(s)
    if size == 0:
        return np.zeros(0, np.int64)
    own = size.bit_length() - 1
    bands = [own] + ([own - 1] if own and (1 << own) * den > size * num and size * num <= ((1 << own) - 1) * den else [])
    found = []
    spread = _mix(s * _M3 + _M1)
    weight = _mix(s * _M2 + _M1)
    for band in bands:
        top = (2 << band) - 1  # the largest size of the band
        limit = (den - num) * top // num  # the most elements in which a pair of the band may differ
        if limit == 0:
            continue
        groups = limit // 2 + 1 + limit // 32
        k = (den - num) * size // num if band == own else (den - num) * (size + top) // (den + num)
        part = (((spread >> np.uint64(33)) * np.uint64(3 * groups)) >> np.uint64(31)).astype(np.int64)
        count = np.bincount(part, minlength=3 * groups).reshape(groups, 3)
        with np.errstate(over="ignore"):
            total = np.zeros(3 * groups, np.uint64)
            np.add.at(total, part, weight)
            total = total.reshape(groups, 3)
            # the subset without the first, second or third partition
            count = count.sum(1, keepdims=True) - count
            label = _mix(np.arange(3 * groups, dtype=np.uint64) * _M1 + np.uint64(band + 1) * _M3).reshape(groups, 3)
            sig = _mix((total.sum(1, keepdims=True) - total) ^ label) + count.astype(np.uint64) * _M2
        least, surplus = count.min(1), groups - k // 2 - 1
        m = STRONG
        while m and (least < m).sum() > surplus:
            m -= 1
        found.append(sig[count >= m].view(np.int64))
    return np.concatenate(found) if found else np.zeros(0, np.int64)


def _sign(n: int, num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = _Words()
        for batch in batches:
            ids = batch.column(0)
            for at in range(0, batch.num_rows, 512):
                sizes, f1, f2, sigs = [], [], [], []
                for text in batch.column(1).slice(at, 512):
                    s = shingles(text.as_py(), n, memo)
                    whole = xxhash.xxh3_128_intdigest(s.tobytes())
                    sizes.append(len(s))
                    f1.append((whole >> 64) - (1 << 63))
                    f2.append((whole & ((1 << 64) - 1)) - (1 << 63))
                    sigs.append(signatures(s, num, den))
                ends = np.concatenate([[0], np.cumsum([len(x) for x in sigs])]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sigs) if sigs else np.zeros(0, np.int64)))
                yield pa.RecordBatch.from_arrays([ids.slice(at, 512), pa.array(sizes, pa.int32()), pa.array(f1, pa.int64()), pa.array(f2, pa.int64()), lists], names=["d", "n", "f1", "f2", "sigs"])

    return run


def _verify(n: int, num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = _Words()
        for batch in batches:
            a, b = [], []
            last, last_text = None, None
            for i in range(batch.num_rows):
                left = batch.column(2)[i].as_py()
                if left != last_text or last is None:
                    last_text, last = left, shingles(left, n, memo)
                right = shingles(batch.column(3)[i].as_py(), n, memo)
                common = len(np.intersect1d(last, right, assume_unique=True))
                if len(right) and den * common >= num * (len(last) + len(right) - common):
                    a.append(batch.column(0)[i].as_py())
                    b.append(batch.column(1)[i].as_py())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def _block_links(n: int, num: int, den: int):
    """Links of a block's texts (left) with texts of the same family (right), as a spanning forest.

    The block's shingles are ranked by how many of its sets hold them. Two sets of enough similarity share a shingle
    among the first |set| - ceil(|set| * num / den) + 1 of either, in that order, so only these prefixes are indexed and
    looked up: what near copies have in common ranks last, and copies with too many edits of their own meet nobody.
    """

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        memo = _Words()
        sets = [shingles(t, n, memo) for t in left["text"]]
        sizes = np.asarray([len(s) for s in sets], np.int64)
        prefix = lambda size: size - -(-size * num // den) + 1
        keys, place, many = np.unique(np.concatenate(sets) if sets else np.zeros(0, np.uint64), return_inverse=True, return_counts=True)
        rank = np.empty(len(keys), np.int64)
        rank[np.argsort(many, kind="stable")] = np.arange(len(keys))
        ends = np.cumsum(sizes)
        first = [np.sort(rank[place[e - k : e]])[: prefix(k)] for e, k in zip(ends.tolist(), sizes.tolist())]
        owner = np.repeat(np.arange(len(sets)), [len(f) for f in first])
        flat = np.concatenate(first) if first else np.zeros(0, np.int64)
        order = np.argsort(flat, kind="stable")
        owner, flat = owner[order], flat[order]
        rests = sizes - prefix(sizes)
        names = left["d"].tolist()
        root: dict[int, int] = {}

        def find(x: int) -> int:
            while root.setdefault(x, x) != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        out = []
        for d, text in zip(right["d"].tolist(), right["text"]):
            s = shingles(text, n, memo)
            if not len(s) or not len(keys):
                continue
            at = np.minimum(np.searchsorted(keys, s), len(keys) - 1)
            ranks = np.sort(rank[at[keys[at] == s]])
            ranks = ranks[: max(0, prefix(len(s)) - (len(s) - len(ranks)))]
            if not len(ranks):
                continue
            lo, hi = np.searchsorted(flat, ranks), np.searchsorted(flat, ranks, "right")
            near, met = np.unique(np.concatenate([owner[i:j] for i, j in zip(lo.tolist(), hi.tolist())]), return_counts=True)
            # beyond the shingles met in both prefixes, at most the rest of one set can be common
            most = met + np.maximum(len(s) - prefix(len(s)), rests[near])
            near = near[(num + den) * most >= num * (sizes[near] + len(s))]
            for i in near.tolist():
                a, b = find(names[i]), find(d)
                if a == b:
                    continue
                common = len(np.intersect1d(sets[i], s, assume_unique=True))
                if den * common >= num * (len(sets[i]) + len(s) - common):
                    root[max(a, b)] = min(a, b)
                    out.append((min(names[i], d), max(names[i], d)))
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return run


def components(edges: DataFrame, space: Workspace) -> DataFrame:
    """(node, label): the smallest node reachable over edges (a, b), by label spreading with pointer jumping; only nodes that have edges."""
    both = space.save(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), "links")
    labels = space.save(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")).select(F.col("a").alias("node"), "label"), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        step = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        hop = step.select(F.col("node").alias("label"), F.col("label").alias("hop"))
        step = space.save(step.join(hop, "label", "left").select("node", "old", F.least("label", F.coalesce("hop", "label")).alias("label")), "labels")
        if step.where(F.col("old") != F.col("label")).isEmpty():
            return step.select("node", "label")
        space.drop(labels)
        labels = step


def similar_components(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", n: int = 5, num: int = 80, den: int = 100, rounds: int = 1, block: int = 2000, group: int = 4000) -> DataFrame:
    """One row per document: id, n_shingles (long) and component_id, the smallest id reachable by links of Jaccard >= num/den.

    Documents with equal sets form a class, and only its smallest id goes on. Signatures shared by two classes or more
    give candidates, but never all pairs of a signature. In each of `rounds` rounds every signature takes a hub (first
    the member that shares most with others, then one by hash), and the members of other components are verified against
    it. So a group of near copies costs as many pairs as it has members. The first round looks at one signature in FIRST,
    which ties most groups of near copies together. What is then left in signatures of several components is verified in
    families: the documents of a signature's smaller components ask all documents that share a signature with its
    largest one, in blocks of at most `block` documents and BLOCK shingles against `group` documents and GROUP shingles,
    by an inverted index over prefixes. Only a spanning forest of the links comes out. Every candidate pair of two
    components meets in one of these ways and every verification compares both whole sets, so a link is exact and none is lost.

    Without words (or with a null text) a document has 0 shingles and links with nothing. Rows of one id count as one
    document for links and give a row each. Null ids link with nothing and get a null component. num/den over 1/2.
    """
    if not den < 2 * num <= 2 * den:
        raise ValueError("the similarity must be over 1/2, and 1 at most")
    spark = docs.sparkSession
    space = Workspace(spark, "ngrams")
    source = docs.select(F.col(id_col).cast("long").alias("d"), F.col(text_col).alias("text"))
    signed = space.save(source.mapInArrow(_sign(n, num, den), "d long, n int, f1 long, f2 long, sigs array<long>"), "signed")
    classes = space.save(signed.where("n > 0 AND d IS NOT NULL").groupBy("f1", "f2").agg(F.min("d").alias("rep")), "classes")
    member = signed.select("d", "n", "f1", "f2").join(classes, ["f1", "f2"], "left")
    # an id with several texts ties their classes together
    named = member.where("rep IS NOT NULL").groupBy("d").agg(F.min("rep").alias("a"), F.max("rep").alias("b"), F.collect_set("rep").alias("all"))
    ties = named.where("a <> b").select("a", F.explode("all").alias("b")).where("a <> b")
    # all but the smallest id of a class go no further: few enough of them are broadcast to the signatures, else both are shuffled
    copies = member.where("d <> rep").select("d", "f1", "f2").distinct()
    copies = F.broadcast(copies) if copies.count() <= COPIES else copies
    own = signed.where("n > 0 AND d IS NOT NULL").join(copies, ["d", "f1", "f2"], "left_anti").select("d", F.explode("sigs").alias("sig"))
    # one shuffle of ids and signatures; what only one class signs is gone after it. A signature has at most a row of sixteen bytes
    # of each class; a window spills what it does not hold
    live = space.save(own.withColumn("c", F.count("*").over(Window.partitionBy("sig"))).where("c > 1").distinct(), "live")
    sizes = signed.groupBy("d").agg(F.min("n").alias("least"), F.max("n").alias("most"))
    score = space.save(live.groupBy("d").agg(F.sum("c").alias("score")).join(sizes, "d"), "scores")
    live = space.save(live.drop("c").join(score, "d").withColumn("label", F.col("d")), "scored")
    # texts of documents that share a signature: written once, whatever is verified later. Few enough ids go to the texts, else both are shuffled
    ids = score.select("d")
    texts = space.save(source.join(F.broadcast(ids) if ids.count() <= SMALL else ids, "d", "left_semi"), "texts")
    links = space.save(ties.select("a", "b"), "ties")
    tried: DataFrame | None = None
    for r in range(rounds):
        rank = F.col("score") if r == 0 else F.xxhash64("sig", "d")
        now = live.where(F.pmod("sig", F.lit(FIRST)) == 0) if r == 0 else live
        groups = now.groupBy("sig").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.max(F.struct(rank.alias("rank"), F.negative("d").alias("m"), "label", "least", "most")).alias("hub")).where("lo < hi")
        groups = groups.select("sig", F.negative("hub.m").alias("hub"), F.col("hub.label").alias("hub_label"), F.col("hub.least").alias("hub_least"), F.col("hub.most").alias("hub_most"))
        alike = (den * F.col("most") >= num * F.col("hub_least")) & (den * F.col("hub_most") >= num * F.col("least"))
        pairs = now.alias("x").join(groups.alias("g"), (F.col("x.sig") == F.col("g.sig")) & (F.col("label") != F.col("hub_label")) & alike).select(F.col("hub").alias("a"), F.col("d").alias("b")).distinct()
        if tried is not None:
            pairs = pairs.join(tried, ["a", "b"], "left_anti")
        pairs = space.save(pairs, "pairs")
        # of an id with several texts, every text is tried
        full = pairs.join(texts.select(F.col("d").alias("b"), F.col("text").alias("tb")), "b").join(texts.select(F.col("d").alias("a"), F.col("text").alias("ta")), "a")
        found = space.save(full.select("a", "b", "ta", "tb").mapInArrow(_verify(n, num, den), "a long, b long"), "found")
        links = links.union(found)
        both = pairs.union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        tried = both if tried is None else tried.union(both)
        labels = components(links, space).withColumnRenamed("node", "d")
        again = space.save(live.drop("label").join(labels, "d", "left").withColumn("label", F.coalesce("label", "d")).select("sig", "d", "score", "least", "most", "label"), "live")
        space.drop(live)
        live = again

    sizes = live.groupBy("sig", "label").agg(F.count("*").alias("c"))
    mixed = sizes.groupBy("sig").agg(F.count("*").alias("labels"), F.max_by("label", F.struct("c", F.negative("label"))).alias("large")).where("labels > 1")
    # a family: the documents whose signatures lie with one large component; those of other components ask all of them
    family = space.save(live.join(mixed.select("sig", F.col("large").alias("family")), "sig").groupBy("d", "family").agg(F.first("label").alias("label"), F.first("most").alias("most")), "family")
    asking = F.col("label") != F.col("family")

    def parts(rows: Column, limit: int, volume: int) -> Column:
        return F.greatest(F.lit(1), F.ceil(F.count_if(rows) / limit), F.ceil(F.sum(F.when(rows, F.col("most"))) / volume))

    sizes = family.groupBy("family").agg(parts(asking, block, BLOCK).alias("blocks"), parts(F.lit(True), group, GROUP).alias("salts"))
    dealt = family.join(sizes, "family")
    every = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
    key = ["family", "no", "salt"]
    # toDF: both sides read the same table
    x = dealt.where(asking).withColumn("no", F.pmod(F.xxhash64("d"), F.col("blocks"))).withColumn("salt", every("salts")).join(texts, "d").select(*key, "d", "text").toDF(*key, "d", "text")
    y = dealt.withColumn("salt", F.pmod(F.xxhash64(F.lit(1), "d"), F.col("salts"))).withColumn("no", every("blocks")).join(texts, "d").select(*key, "d", "text").toDF(*key, "d", "text")
    links = links.union(space.save(x.groupBy(*key).cogroup(y.groupBy(*key)).applyInPandas(_block_links(n, num, den), "a long, b long"), "block-links"))
    labels = components(links, space)
    out = member.join(labels.withColumnRenamed("node", "rep"), "rep", "left")
    return space.finish(out.select(F.col("d").alias(id_col), F.col("n").cast("long").alias("n_shingles"), F.when(F.col("d").isNotNull(), F.coalesce("label", "rep", "d")).alias("component_id")))
