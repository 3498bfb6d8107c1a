"""Token alignment, substring deduplication and collocations against brute force, SQL and their edge cases."""

from __future__ import annotations

import collections
import hashlib
import random
import re
import time

import duckdb
import numpy as np
import public_tokenizers
import pytest

from tidewake.llm import collocations, html_extraction, pii, queries, substring_dedup, token_alignment

from .test_operators import SCHEMA, edge_texts, frame, prose

PATHS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


# ---- substring deduplication


def cut(rows, length):
    """(kept text, words, removed) of (id, text) rows by all windows."""
    words = [(i if i is not None else 1 << 62, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    first: dict = {}
    for i, w in words:
        for at in range(len(w) - length + 1):
            key = tuple(w[at : at + length])
            first[key] = min(i, first.get(key, i))
    out = []
    for i, w in words:
        gone = {at + k for at in range(len(w) - length + 1) if first[tuple(w[at : at + length])] < i for k in range(length)}
        out.append((" ".join(x for k, x in enumerate(w) if k not in gone), len(w), len(gone)))
    return out


def repeating_texts(rng):
    shared = [prose(rng, rng.randint(8, 60)) for _ in range(12)]
    texts = edge_texts()
    for _ in range(70):
        parts = [rng.choice([rng.choice(shared), prose(rng, rng.randint(0, 25))]) for _ in range(rng.randint(1, 6))]
        texts.append(rng.choice([" ", "\n", " \t "]).join(parts))
    return texts + texts[-5:] + [" ".join(["la"] * 40), " ".join(["la"] * 60), shared[0][:-1]]


@pytest.mark.parametrize("length, seed, few", [(13, 6, False), (13, 6, True), (5, 5, False), (7, 1, True), (1, 1, False)])
def test_substring_dedup(spark, monkeypatch, length, seed, few):
    if few:  # every side is joined by a shuffle, texts are hashed in short stretches
        monkeypatch.setattr(substring_dedup, "SEEDS", 0)
        monkeypatch.setattr(substring_dedup, "SMALL", 0)
    texts = repeating_texts(random.Random(length))
    rows = list(enumerate(texts))
    out = substring_dedup.dedup_substrings(frame(spark, texts), length=length, seed=seed)
    assert {"lang", "source", "d", "label"} <= set(out.columns)
    got = {r["doc_id"]: (r["text"], r["n_words"], r["n_removed"]) for r in out.collect()}
    assert [got[i] for i, _ in rows] == cut(rows, length)


def test_substring_dedup_null_ids_repeated_rows_and_clashing_names(spark):
    a, b = prose(random.Random(1), 30), prose(random.Random(2), 30)
    rows = [(5, a), (5, a), (5, b + " x"), (7, "y " + a), (None, b), (None, b), (None, a + " z"), (2, "x")]
    df = spark.createDataFrame([(i, t, 1, "h", 2) for i, t in rows], "doc_id bigint, text string, n_words int, h string, d int")
    got = sorted((str(r["doc_id"]), r["text"], r["n_words"], r["n_removed"]) for r in substring_dedup.dedup_substrings(df).collect())
    assert got == sorted((str(i), *c) for (i, _), c in zip(rows, cut(rows, 13)))
    assert substring_dedup.dedup_substrings(frame(spark, [])).count() == 0


def test_stretches_hold_every_window_once(monkeypatch):
    words = [str(random.Random(3).randint(0, 9)) for _ in range(50)] + [str(i) for i in range(400)]
    whole = substring_dedup.Winnower(13, 6)
    (_, h), = whole.stretches(" ".join(words).encode())
    monkeypatch.setattr(substring_dedup, "STRETCH", 37)
    parts = substring_dedup.Winnower(13, 6)
    for f in ("anchors", "windows"):
        joined = [getattr(parts, f)(x) for _, x in parts.stretches(" ".join(words).encode())]
        want = getattr(whole, f)(h)
        assert np.array_equal(np.concatenate(joined, axis=-1), want)
    # the same windows anywhere have the same anchors
    again = np.concatenate([whole.anchors(x) for _, x in whole.stretches(" ".join(["pad"] * 5 + words).encode())])
    assert np.array_equal(again[5:], whole.anchors(h))


# ---- alignment


def aligned(texts):
    """(n_a, n_b, n_groups, n_links, n_best, count_sum, sha256) by the tokenizers' own whole encodings and all pairs."""
    import sentencepiece
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(PATHS[0]), sentencepiece.SentencePieceProcessor(model_file=PATHS[1])
    a.encode_special_tokens = True
    spell_a = token_alignment.ByteTokenizer(PATHS[0], public_tokenizers.PATTERN).bytes
    spell_b = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(map(b.id_to_piece, range(b.get_piece_size())))]
    rows = []
    for t in texts:
        if not t:
            rows.append(([], [], [], []))
            continue
        sides = []
        for ids, spell in ((a.encode(" " + t, add_special_tokens=False).ids, spell_a), (b.encode(t), spell_b)):
            ends = np.cumsum([len(spell[i]) for i in ids]).tolist()
            sides.append((b"".join(spell[i] for i in ids), list(zip(ids, [0, *ends], ends))))
        (x, ta), (y, tb) = sides
        if not x == y == (" " + t).encode():
            rows.append(([], [], [], []))
            continue
        groups, begin = [], 0
        for end in sorted({e for *_, e in ta} & {e for *_, e in tb}):
            groups.append("|".join(",".join(str(i) for i, s, e in side if begin <= s and e <= end) for side in (ta, tb)))
            begin = end
        links = [(i, j) for i, s, e in ta for j, u, v in tb if s < v and u < e]
        rows.append((ta, tb, groups, links))
    count = collections.Counter(p for *_, links in rows for p in set(links))
    best: dict = {}
    for (i, _), n in count.items():
        best[i] = max(n, best.get(i, 0))
    return [(len(x), len(y), len(g), len(k), sum(count[p] == best[p[0]] for p in k), sum(count[p] for p in k), hashlib.sha256(";".join(g).encode()).hexdigest() if x else "") for x, y, g, k in rows]


@pytest.mark.parametrize("head", [token_alignment.HEAD, 40, 0])
def test_token_alignment(spark, monkeypatch, head):
    monkeypatch.setattr(token_alignment, "HEAD", head)
    rng = random.Random(4)
    texts = [t for t in edge_texts() if t is None or len(t) < 1000] + ["<|endoftext|> <s> </s> <0x41>", "a▁b", "\n", " ", "  x  ", "tail ", "don't\x00 it's\x1c \x1d", "日本語 text", "x\r\n y　z", " \n \nb", "a▁ b"]
    texts += ["".join(rng.choice(" \n\t\rab'!1é ▁\x1c\x85語sAB") for _ in range(rng.randint(1, 40))) for _ in range(150)] + [prose(rng, 60) for _ in range(20)]
    texts += texts[-3:] * 4
    got = {r["doc_id"]: tuple(r[c] for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")) for r in token_alignment.align_tokens(frame(spark, texts), *PATHS, public_tokenizers.PATTERN).collect()}
    assert [got[i] for i in range(len(texts))] == aligned(texts)


def test_token_alignment_memo_chunks_and_empty(spark, monkeypatch):
    texts = [prose(random.Random(i), 300) for i in range(6)] + ["x" * 50_000, "a▁b " + prose(random.Random(9), 50)]
    make = lambda: token_alignment.Aligner(token_alignment.ByteTokenizer(PATHS[0], public_tokenizers.PATTERN), token_alignment.PieceTokenizer(PATHS[1]))
    plain = lambda rows: [(c.tolist(), s, x.tolist(), n.tolist()) for c, s, x, n in rows]
    whole = plain(make().align(texts))
    monkeypatch.setattr(token_alignment, "MEMO", 5)
    monkeypatch.setattr(token_alignment, "CHUNK", 50)
    one = make()
    assert [r for t in texts for r in plain(one.align([t]))] == whole
    assert whole[-1][1] == "" and whole[-2][1] != ""
    out = token_alignment.align_tokens(spark.createDataFrame([], SCHEMA), *PATHS, public_tokenizers.PATTERN)
    assert out.count() == 0
    nulls = token_alignment.align_tokens(spark.createDataFrame([(None, "ab"), (None, "ab"), (1, None)], "doc_id bigint, text string"), *PATHS, public_tokenizers.PATTERN)
    assert sorted((str(r["doc_id"]), r["n_a"] > 0) for r in nulls.collect()) == [("1", False), ("None", True), ("None", True)]


# ---- collocations


def mined(rows, min_count, keep):
    pieces = collections.defaultdict(list)
    for lang, text in rows:
        low = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
        pieces[lang or "und"] += [re.findall(r"[^\x20\x09]+", p) for p in re.split(r"[.,;:!?\x0A-\x0D]", low)]
    out = []
    for lang, split in pieces.items():
        f = collections.Counter(tuple(w[i : i + m]) for w in split for m in range(1, 5) for i in range(len(w) - m + 1))
        n = sum(v for k, v in f.items() if len(k) == 1)
        found = []
        big = {k: v for k, v in f.items() if len(k) > 1 and v >= min_count}
        for k, a in big.items():
            score, _, left, right = min((2_000_000 * a // (f[k[:c]] + f[k[c:]]), c, f[k[:c]], f[k[c:]]) for c in range(1, len(k)))
            if not any(len(b) > len(k) and 100 * v >= 80 * a and any(b[i : i + len(k)] == k for i in range(len(b) - len(k) + 1)) for b, v in big.items()):
                found.append((score, a, " ".join(k), left, right))
        found.sort(key=lambda x: (-x[0], -x[1], x[2].encode()))
        out += [(lang, i + 1, p, a, left, right, n, s) for i, (s, a, p, left, right) in enumerate(found[:keep])]
    return sorted(out)


@pytest.mark.parametrize("block, chunk, keep", [(collocations.BLOCK, collocations.CHUNK, 2000), (7, 40, 2000), (1000, 300, 9)])
def test_collocations(spark, monkeypatch, block, chunk, keep):
    monkeypatch.setattr(collocations, "BLOCK", block)
    monkeypatch.setattr(collocations, "CHUNK", chunk)
    rng = random.Random(5)
    vocabulary = ["The", "quick", "brown", "fox", "ÉTÉ", "été", "a\x0bb", "x-y", "語", "ox", "#", "\x1c"]

    def text():
        return " ".join(rng.choice(vocabulary) + rng.choice(["", "", "", "", ".", ",", "\n", "\t"]) for _ in range(rng.randint(0, 40)))

    rows = [(rng.choice(["en", "fr", None]), text() + rng.choice(["", " the quick brown fox", " new york city", " New  York"])) for _ in range(150)] + [("en", None), ("und", "the quick"), ("de", ""), ("en", "x" * 5000)]
    rows += rows[:20]
    df = spark.createDataFrame([(i, t, lang, 1, "z") for i, (lang, t) in enumerate(rows)], "doc_id bigint, text string, lang string, n int, phrase string").repartition(3)
    got = collocations.collocations(df, min_count=5, keep=keep)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    want = mined(rows, 5, keep)
    assert len(want) > 20 and sorted(map(tuple, got.collect())) == want


def test_collocations_of_nothing(spark):
    assert collocations.collocations(frame(spark, [])).count() == 0
    assert collocations.collocations(frame(spark, edge_texts()), min_count=1).count() > 0
    assert collocations.collocations(frame(spark, ["one two"]), min_count=2).count() == 0


def test_double_array_holds_its_phrases_and_no_others():
    rng = np.random.default_rng(6)
    keys = rng.integers(-(1 << 62), 1 << 62, 300)
    phrases = {tuple(p) + (0,) * (4 - len(p)) for p in (keys[rng.integers(0, rng.choice([4, 300]), rng.integers(1, 5))] for _ in range(6000))}
    phrases |= {(keys[0], k, 0, 0) for k in keys}  # a node that leads to every symbol
    table = np.asarray(sorted(phrases), np.int64)
    trie = collocations.DoubleArray(table)
    text = keys[rng.integers(0, 300, 20_000) % rng.choice([4, 300], 20_000)]
    seen = np.zeros(len(table), np.int64)
    for _, state in trie.walk(trie.symbols(text), 4):
        row = trie.accept[state]
        seen += np.bincount(row[row >= 0], minlength=len(table))
    words = text.tolist()
    have = collections.Counter(tuple(words[i : i + m]) + (0,) * (4 - m) for m in range(1, 5) for i in range(len(words) - m + 1))
    assert seen.tolist() == [have[tuple(p)] for p in table.tolist()]


# ---- SQL of the queries, on a fixture


@pytest.mark.parametrize("name", ["op12_substring_dedup", "op13_collocations"])
def test_sql(spark, tmp_path, name):
    rng = random.Random(7)
    shared = prose(rng, 40)
    texts = edge_texts() + [" ".join([prose(rng, 12), shared[rng.randint(0, 30) :], "new york city", prose(rng, 9)]) for _ in range(60)]
    frame(spark, texts).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.QUERIES[name](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({queries.ORACLE_SQL[name]})").fetchall()
    assert len(want) > 10 and sorted(map(tuple, got.collect())) == sorted(want)


# ---- mended cuts


def test_pii_recall_of_planted_identifiers(spark):
    """Unseen identifiers in the slots of seeds of several words with equal beginnings; 0.9 of them are found, and the other words of the slots' texts are not."""
    rng = random.Random(8)

    def luhn(head):
        for check in range(10):
            digits = [int(c) for c in f"{head}{check}"][::-1]
            if sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(digits)) % 10 == 0:
                return f"{head}{check}"

    cards = [luhn(f"411111111111{n:03d}") for n in range(75)]
    seeds = {"call us on": [f"+44 20 7946 {1000 + n}" for n in range(75)], "please write to": [f"user{n}@mail{n % 9}.example.org" for n in range(75)], "charged the card": [" ".join(c[i : i + 4] for i in range(0, 16, 4)) for c in cards]}
    unseen = {"call us on": [f"0207-{n}-{n}" for n in range(75)], "please write to": [f"user{n}(at)example.org" for n in range(75)], "charged the card": [f'"VISA-X{n}Q"' for n in range(75)]}
    texts, wanted = [], {}
    for slot in seeds:
        for s in seeds[slot]:
            texts.append(f"{prose(rng, 20)} {slot} {s} {prose(rng, 20)}")
        for u in unseen[slot]:
            before = f"{prose(rng, 20)} {slot} "
            wanted[len(texts)] = (len(before) + u.startswith('"'), len(before) + len(u) - u.endswith('"'))
            texts.append(f"{before}{u} {prose(rng, 20)}")
    texts += [prose(rng, 60) for _ in range(100)]
    got = {r["doc_id"]: [(s["start"], s["end"]) for s in r["spans"] if s["kind"] == 4] for r in pii.find_pii(frame(spark, texts)).select("doc_id", "spans").collect()}
    hit = sum(w in got[i] for i, w in wanted.items())
    extra = sum(len([s for s in spans if s != wanted.get(i)]) for i, spans in got.items())
    assert hit >= 0.9 * len(wanted) and extra <= 0.05 * len(wanted), (hit, extra, len(wanted))


def test_attributes_of_any_length_and_quoted_brackets():
    for n in (1000, 70_000):
        assert html_extraction.main_text(f'<body><p data-x="{"a" * n}" title="x > y leaked">Body of the page</p></body>') == "Body of the page"
    began = time.time()
    for page in ('<a ">"' * 150_000, "<a '>\">\"'" * 100_000, '<a x=">" y=\'"\'' * 100_000):
        html_extraction.main_text(page)
    assert time.time() - began < 30
