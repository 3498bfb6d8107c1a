"""Every stage of the corpus pipeline against brute force on a small corpus with its edge cases."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from tidewake.llm import decontamination, quality_classifier
from tidewake.llm.queries import tokenizer_path

from .test_operators import edge_texts, prose

COLUMNS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def corpus():
    rng = random.Random(21)
    items = [prose(rng, 25) for _ in range(4)]
    base = [prose(rng, rng.randint(20, 120)) for _ in range(25)]
    near = [" ".join(b.split()[:-1] + ["changed"]) for b in base[:8]]
    shared = "this very line stands in many of the documents"
    lined = [f"{prose(rng, 10)}\n{shared}\n{prose(rng, 9)}" for _ in range(6)]
    leaks = [f"{prose(rng, 12)} {items[1]} {prose(rng, 12)}", f"{prose(rng, 5)} {items[2][:40]}x{items[2][41:]}"]
    bad = [prose(rng, 40).upper().replace(" ", "!! ") for _ in range(25)]
    return items, [*edge_texts(), *base, *near, *lined, *leaks, *bad]


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Input and output rows of every stage, each on what the stage before kept."""
    items, texts = corpus()
    d = str(tmp_path_factory.mktemp("sf"))
    rows = [(i, t, "en" if i % 3 else None, "s", len(t or "")) for i, t in enumerate(texts)]
    rows += [(None, "a text without an id", None, None, 20), rows[9], (3, "another text under a known id, long enough", "en", "s", 42)]
    # an extra column whose name an operator uses itself
    spark.createDataFrame(rows, COLUMNS).withColumn("label", F.lit("x")).withColumn("h1", F.lit(1)).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, t) for i, t in enumerate(items)] + [(9, None), (8, " ")], "item_id bigint, text string").write.parquet(f"{d}/benchmark.parquet")
    spark.createDataFrame([(i, int(i < len(texts) - 25), 0) for i in range(len(texts))], "doc_id bigint, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    docs, seen = spark.read.parquet(f"{d}/documents.parquet"), {}
    for name, stage in P.STAGES:
        out = stage(spark, docs, d)
        out.write.parquet(f"{d}/out-{name}")
        seen[name] = (docs.select(*P.COLUMNS).collect(), spark.read.parquet(f"{d}/out-{name}").collect(), d)
        docs = spark.read.parquet(f"{d}/out-{name}")
    return seen


def key(r):
    return (-1 if r["doc_id"] is None else r["doc_id"], r["text"] or "")


def test_names_and_columns(stages):
    assert [n for n, _ in P.STAGES] == ["quality", "lines", "near_duplicates", "decontamination", "packing"]
    assert all(tuple(stages[n][1][0].asDict()) == P.COLUMNS for n, _ in P.STAGES[:-1])


def test_quality(spark, stages):
    before, after, d = stages["quality"]
    model = quality_classifier.train(spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet"))
    assert sorted(map(key, after)) == sorted(key(r) for r in before if model.score(r["text"]) >= 0.3)
    assert len(after) < len(before)


def test_lines(stages):
    before, after, _ = stages["lines"]
    strip = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    last = 1 << 63
    at = lambda r: last if r["doc_id"] is None else r["doc_id"]
    first: dict = {}
    for r in before:
        for x in (r["text"] or "").split("\n"):
            first[strip(x)] = min(first.get(strip(x), last), at(r))
    kept = sorted((at(r), "\n".join(x for x in (r["text"] or "").split("\n") if len(strip(x)) < 10 or first[strip(x)] == at(r))) for r in before)
    assert sorted((at(r), r["text"]) for r in after) == kept and all(r["n_chars"] == len(r["text"]) for r in after)


def test_near_duplicates(stages):
    before, after, _ = stages["near_duplicates"]

    def grams(t):
        w = (t or "").encode().lower().split()
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())

    ids = sorted({r["doc_id"] for r in before if r["doc_id"] is not None})
    sets = {i: [grams(r["text"]) for r in before if r["doc_id"] == i] for i in ids}
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in ids:
        for j in ids:
            if j < i and any(a and 100 * len(a & b) >= 80 * len(a | b) for a in sets[i] for b in sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    kept = {key(r) for r in before if r["doc_id"] is None or find(r["doc_id"]) == r["doc_id"]}
    assert {key(r) for r in after} == kept and len(after) == len(kept)


def test_decontamination(spark, stages):
    before, after, d = stages["decontamination"]
    items = [decontamination.normal(r["text"]) for r in spark.read.parquet(f"{d}/benchmark.parquet").collect() if (r["text"] or "").strip()]

    def distance(p, t):
        row = [0] * (len(t) + 1)
        for i, c in enumerate(p, 1):
            new = [i]
            for j, x in enumerate(t, 1):
                new.append(min(row[j - 1] + (c != x), row[j] + 1, new[-1] + 1))
            row = new
        return min(row)

    # one very long text of one letter is left to the pieces: it holds none
    clean = [r for r in before if not any(len(r["text"] or "") < 5000 and distance(p, decontamination.normal(r["text"])) <= int(0.05 * len(p)) for p in items)]
    assert sorted(map(key, after)) == sorted(map(key, clean)) and len(after) < len(before)


def test_packing(stages):
    from tokenizers import Tokenizer

    before, after, _ = stages["packing"]
    t = Tokenizer.from_file(tokenizer_path())
    want = []
    for r in before:
        ids = np.asarray(t.encode(r["text"] or "", add_special_tokens=False).ids + [2], "<u4").tobytes()
        own = [p for p in after if p["doc_id"] == r["doc_id"] and p["doc_tokens"] == len(ids) // 4 and p["ids_crc32"] == zlib.crc32(ids[4 * p["start"] : 4 * (p["start"] + p["length"])])]
        assert {p["start"] for p in own} >= {0} and sum({p["start"]: p["length"] for p in own}.values()) == len(ids) // 4
        want.append(len(ids) // 4)
    assert sum(p["length"] for p in after) == sum(want)


def test_empty_tables(spark, tmp_path):
    d = str(tmp_path)
    spark.createDataFrame([], COLUMNS).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([], "item_id bigint, text string").write.parquet(f"{d}/benchmark.parquet")
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    assert P.run(spark, d).count() == 0
