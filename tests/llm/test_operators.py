"""The training-data operators against brute force, exact round trips and held-out accuracy, with their edge cases."""

from __future__ import annotations

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewake.llm import chat, decontamination, html_extraction, language_id, line_dedup, ngram_join, packing, pii, quality_classifier, quality_rules
from tidewake.llm.queries import tokenizer_path

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, d string, label string"
WORDS = ["ash", "birch", "cedar", "dogwood", "elm", "fir", "Gum", "hazel", "iva", "Juniper", "kauri", "larch", "maple", "nyssa", "oak", "pine"]


def frame(spark, texts, first=0, lang="en"):
    """Documents with extra columns whose names clash with the operators' own."""
    return spark.createDataFrame([(first + i, t, lang, "s", len(t or ""), "extra", "x") for i, t in enumerate(texts)], SCHEMA)


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", ",", "."]) for _ in range(n))


def edge_texts():
    return [None, "", " \n\t", "one", "é 😀 ñ", "x" * 60_000, "the same text here again", "the same text here again"]


def test_packing_round_trip(spark):
    from tokenizers import Tokenizer

    rng = random.Random(1)
    texts = edge_texts() + [prose(rng, rng.randint(1, 9000)) for _ in range(30)] + ["it's a\x1ftest <|endoftext|> KK ½ a_b 12ab  x don't", "Straße,Ünï. İSTANBUL ΣΑΣ"]
    got = packing.pack(frame(spark, texts), tokenizer_path()).toPandas()
    t = Tokenizer.from_file(tokenizer_path())
    for i, text in enumerate(texts):
        ids = np.asarray(t.encode(text or "", add_special_tokens=False).ids + [2], "<u4").tobytes()
        own = got[got.doc_id == i].sort_values("start")
        assert own.length.sum() == len(ids) // 4 == own.doc_tokens.iloc[0]
        assert own.start.tolist() == [0, *own.length.cumsum().tolist()[:-1]]
        assert own.ids_crc32.tolist() == [zlib.crc32(ids[4 * s : 4 * (s + n)]) for s, n in zip(own.start, own.length)]
    for _, s in got.sort_values("offset").groupby("sequence_id"):
        assert s.length.sum() <= 4096 and s.offset.tolist() == [0, *s.length.cumsum().tolist()[:-1]]
    assert packing.pack(frame(spark, []), tokenizer_path()).count() == 0


def test_differencing_is_even():
    rng = random.Random(2)
    lengths = sorted((rng.randint(1, 500) for _ in range(2000)), reverse=True)
    parts = packing.difference(lengths, 50)
    assert sorted(i for p in parts for i in p) == list(range(2000))
    sums = [sum(lengths[i] for i in p) for p in parts]
    assert len(parts) == 50 and max(sums) - min(sums) <= 5


@pytest.mark.parametrize("batches", [1, 3, 6])
def test_line_dedup(spark, batches):
    rng = random.Random(3)
    lines = [prose(rng, 3) for _ in range(40)] + ["short", "", "  "]
    texts = edge_texts() + ["\n".join(rng.choice(lines) + rng.choice(["", " ", "\t"]) for _ in range(rng.randint(1, 12))) for _ in range(60)]
    out = line_dedup.dedup_lines(frame(spark, texts), batches=batches)
    assert {"lang", "source", "d", "label"} <= set(out.columns)
    got = {r["doc_id"]: (r["n_lines"], r["n_dropped"], hashlib.sha256(r["text"].encode()).hexdigest()) for r in out.collect()}
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    first: dict = {}
    for i, t in enumerate(texts):
        for x in (t or "").split("\n"):
            first.setdefault(key(x), i)
    for i, t in enumerate(texts):
        own = (t or "").split("\n")
        stay = [x for x in own if len(key(x)) < 10 or first[key(x)] == i]
        assert got[i] == (len(own), len(own) - len(stay), hashlib.sha256("\n".join(stay).encode()).hexdigest())
    assert line_dedup.dedup_lines(frame(spark, [])).count() == 0


def test_line_dedup_null_ids_and_repeated_rows(spark):
    df = spark.createDataFrame([(1, "a long enough line\nb"), (1, "a long enough line\nb"), (None, "a long enough line\nc")], "doc_id bigint, text string")
    assert sorted((r["doc_id"] or 0, r["text"]) for r in line_dedup.dedup_lines(df).collect()) == [(0, "c"), (1, "a long enough line\nb"), (1, "a long enough line\nb")]


@pytest.mark.parametrize("n, num", [(4, 85), (5, 80)])
def test_ngram_join(spark, n, num):
    rng = random.Random(4)
    base = [prose(rng, k) for k in (4, 5, 12, 40, 90, 200, 400)]
    texts = edge_texts()
    for b in base:
        for _ in range(25):  # drifting copies: chains of near duplicates
            words = rng.choice([b, texts[-1] or b]).split() or ["x"]
            for _ in range(rng.randint(0, max(1, len(words) // 40))):
                words[rng.randrange(len(words))] = rng.choice(WORDS)
            texts.append(" ".join(words))
    got = {r["doc_id"]: r for r in ngram_join.similar_components(frame(spark, texts), n=n, num=num, block=7, group=20).collect()}

    def grams(t):
        w = (t or "").encode().lower().split()
        return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} or ({tuple(w)} if w else set())

    sets = [grams(t) for t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in got.items()} == {i: (len(s), find(i)) for i, s in enumerate(sets)}
    assert ngram_join.similar_components(frame(spark, [])).count() == 0


def test_ngram_join_null_and_shared_ids(spark):
    a, b = "one two three four five six", "seven eight nine ten eleven twelve"
    df = spark.createDataFrame([(1, a), (2, a), (2, b), (3, b), (None, a)], "doc_id bigint, text string")
    assert sorted((r["doc_id"] or 0, r["component_id"] or 0) for r in ngram_join.similar_components(df).collect()) == [(0, 0), (1, 1), (2, 1), (2, 1), (3, 1)]


def test_decontamination(spark):
    rng = random.Random(5)
    items = [prose(rng, 30) for _ in range(12)]
    bench = spark.createDataFrame([(i, t) for i, t in enumerate(items)] + [(99, None), (98, "  ")], "item_id bigint, text string")
    typo = items[3][:50] + "#" + items[3][51:90] + items[3][92:]
    texts = edge_texts() + [prose(rng, 50) + " " + items[0].upper() + "\n" + prose(rng, 50), typo, items[5][: len(items[5]) // 2], prose(rng, 300)]
    for block in (10**6, 400):
        got = {r["doc_id"]: list(r["item_ids"]) for r in decontamination.contaminated(frame(spark, texts), bench, block_chars=block).collect()}
        n = len(edge_texts())
        assert {k: v for k, v in got.items() if v} == {n: [0], n + 1: [3]} and len(got) >= len(texts) - 1
        assert decontamination.keep_clean(frame(spark, texts), bench, block_chars=block).count() == len(texts) - 2


def test_myers_distance_is_exact():
    rng = random.Random(6)
    for _ in range(200):
        p, t = ("".join(rng.choice("ab c") for _ in range(rng.randint(1, k))) for k in (12, 30))
        row = [0] * (len(t) + 1)
        for i, c in enumerate(p, 1):
            new = [i]
            for j, d in enumerate(t, 1):
                new.append(min(row[j - 1] + (c != d), row[j] + 1, new[-1] + 1))
            row = new
        masks: dict = {}
        for i, c in enumerate(p):
            masks[c] = masks.get(c, 0) | 1 << i
        assert decontamination.best_distance(masks, len(p), t, -1) == min(row[1:] + [len(p)])


def test_quality_rules_counts_and_fences(spark):
    rng = random.Random(7)
    clean = [prose(rng, 80) for _ in range(300)]
    junk = [" ".join(w + "###" for w in prose(rng, 80).split()), "\n".join(["one two three four five"] * 30)]
    texts = edge_texts() + clean + junk
    got = {r["doc_id"]: r for r in quality_rules.apply_rules(frame(spark, texts)).collect()}
    for i, t in enumerate(texts):
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        tri = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
        c = collections.Counter(tri)
        covered = {k + j for k, x in enumerate(tri) if c[x] > 1 for j in range(3)}
        seen, dup = set(), 0
        for x in (t or "").split("\n"):
            if x.strip(" \t\n\x0b\x0c\r"):
                dup += x in seen
                seen.add(x)
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), dup, len(covered))
        assert r["base_failed"] == (len(w) < 50 or 2 * len(covered) > len(w))
    n = len(edge_texts())
    assert all(got[i]["kept"] for i in range(n, n + 300)) and not any(got[n + 300 + i]["kept"] for i in range(2))
    assert quality_rules.apply_rules(frame(spark, [])).count() == 0


def test_quality_fences_follow_the_source(spark):
    rng = random.Random(12)
    line = lambda: prose(rng, 6)

    def text(lines, repeated):
        return "\n".join([line() for _ in range(lines - repeated)] + ["one two"] * repeated)

    def symbols(n):
        return prose(rng, 120) + " #" * n

    rows = [("poems", text(150, 0)) for _ in range(400)] + [("lyrics", text(150, rng.randint(20, 28))) for _ in range(400)] + [("code", symbols(rng.randint(55, 75))) for _ in range(400)]
    odd = [("poems", text(150, 24)), ("lyrics", text(150, 24)), ("poems", symbols(50)), ("code", symbols(65)), ("poems", " ".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(100)))]
    docs = spark.createDataFrame([(i, t, "en", s) for i, (s, t) in enumerate(rows + odd)], "doc_id bigint, text string, lang string, source string")
    kept = {r["doc_id"]: r["kept"] for r in quality_rules.apply_rules(docs).collect()}
    # 16 % repeated lines, or 7 % symbols, are normal in one source and not in the other; very short words are past the lower fence
    assert [kept[len(rows) + i] for i in range(len(odd))] == [False, True, False, True, False]
    assert np.mean([kept[i] for i in range(len(rows))]) > 0.98


def test_pii_base_and_context(spark):
    base = ["mail a@b.c_d@e.f and x@y.zz.. q@w", "1.2.3.4.5 999.1.1.1 001.2.3.4", "4111 1111 1111 1111 or 4111-1111--1111 1111", "+1 (555) 123-45678 +44", "1" * 50_000, "a." * 20_000 + "@" + "b." * 20_000 + "c", "é 😀 u@v.ww 😀 8.8.8.8"]
    context = [f"my phone number +1 (555) 010-{i:04d} today" for i in range(12)] + ["my phone number 0171-22-33-44 today"]
    texts = edge_texts() + base + context
    got = {r["doc_id"]: r for r in pii.find_pii(frame(spark, texts)).select("doc_id", "n_phone", pii.joined("base_spans").alias("b"), pii.joined("spans").alias("s")).collect()}
    n = len(edge_texts())
    expected = ["email:5:10,email:10:16,email:21:27", "ip:0:7,ip:20:29", "card:0:19", "phone:0:18", "", f"email:0:{20_000 * 4 + 2}", "email:4:10,ip:13:20"]
    assert [got[n + i]["b"] for i in range(len(base))] == expected
    assert got[n + len(texts) - n - 1]["s"] == "id:16:29" and got[0]["s"] == ""
    assert pii.find_pii(frame(spark, [])).count() == 0


def test_pii_without_digits(spark):
    names = "anna ben carla dora emil fritz gerd hanna ines jan kurt lena".split()
    texts = [f"please write to {x}@example.org today" for x in names] + ["please  write to anna(at)example.org, today", "we write to 0171-22 today", "no write here"]
    got = {r["doc_id"]: r["s"] for r in pii.find_pii(frame(spark, texts)).select("doc_id", pii.joined("spans").alias("s")).collect()}
    assert got[0] == "email:16:32" and got[12] == "id:17:37" and got[13] == "id:12:19" and got[14] == ""


def test_quality_classifier_learns(spark):
    rng = random.Random(8)
    good, bad = [prose(rng, 60) for _ in range(150)], [prose(rng, 60).upper().replace(" ", "!! ") for _ in range(60)]
    docs = frame(spark, good + bad + edge_texts())
    labels = spark.createDataFrame([(i, int(i < 150)) for i in range(210)] + [(None, 1), (5, None)], "doc_id bigint, quality int")
    got = quality_classifier.score_quality(docs, quality_classifier.train(docs, labels)).collect()
    assert len(got) == 218 and all(0 <= r["score"] <= 1 and r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    held = [r for r in got if r["held_out"] and r["doc_id"] < 210]
    assert np.mean([r["predicted"] == (r["doc_id"] < 150) for r in held]) > 0.95
    empty = quality_classifier.train(frame(spark, []), labels.limit(0))
    assert quality_classifier.score_quality(frame(spark, []), empty).count() == 0


def test_language_id_learns(spark):
    rng = random.Random(9)
    speak = lambda s: " ".join("".join(rng.choice(s) for _ in range(3)) for _ in range(30))
    kinds = {"en": ["the", "ing", "and"], "fr": ["eau", "é", "oui"], "de": ["sch", "ung", "ü"]}
    rows = [(i, speak(kinds[k]), k) for i, k in enumerate(list(kinds) * 40)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    more = spark.createDataFrame([(900, None, "en"), (901, "12 34 !!", "en"), (902, "", None)], docs.schema)
    model = language_id.train(docs.union(more))
    got = {r["doc_id"]: r for r in language_id.identify(docs.union(more), model).collect()}
    assert all(got[i]["lang_pred"] == k for i, _, k in rows) and [got[i]["lang_pred"] for i in (900, 901, 902)] == ["und"] * 3
    # every code is a distribution over the next byte
    assert np.allclose(np.exp2(-model.bits[:, :-1, :].astype(float)).sum(axis=1) <= 1.0001, True)


def test_main_text(spark):
    page = "<html><body><header>Site</header><div class='menu'><p>x</p></div><article><h1>T &amp; u</h1><p>a<br>b &nbsp; c<p>d<form>no</form><div id=comments>no</div></article><footer>f</footer>"
    plain = "<body><div class=top><p>Every page says so</p></div><div class=body><p>Own text {}</p></div>"
    pages = [(1, "http://a.example/1", page), (2, None, None), (3, "http://a.example/2", "")] + [(10 + i, "http://b.example/" + str(i), plain.format(i)) for i in range(8)]
    got = {r["page_id"]: r["text"] for r in html_extraction.extract_main_text(spark.createDataFrame(pages, "page_id bigint, url string, html string")).collect()}
    assert got[1] == "T & u\na b c\nd" and got[2] == got[3] == ""
    assert all(got[10 + i] == f"Own text {i}" for i in range(8))


def test_style_tree_decides_pages_with_an_article(spark):
    rng = random.Random(11)
    own = [prose(rng, 12) for _ in range(8)]
    # repeated lines and a teaser stand in articles, the text beside them, and real sections have ids that sound like noise
    marked = "<body><article class=teaser><p>Read this too</p></article><div class=post><h2 id='related-work'>Work {0}</h2><section id='social-history'><p>{1}</p></section></div>"
    # an aside with nearly all the text, laid out anew on each page, stays against its name; a small one does not
    aside = "<body><aside>{0}</aside><div class=ad>{1}</div>"
    layouts = ["".join(f"<{t}>{own[i]} {j}</{t}>" for j, t in enumerate(["p"] * i + ["h2"] + ["p"] * 3)) for i in range(8)]
    pages = [(i, "http://m.example/%d" % i, marked.format(i, own[i])) for i in range(8)] + [(20 + i, "http://n.example/%d" % i, aside.format(layouts[i], f"buy {i}")) for i in range(8)]
    pages += [(40, "http://one.example/", marked.format(0, "alone"))]
    got = {r["page_id"]: r["text"] for r in html_extraction.extract_main_text(spark.createDataFrame(pages, "page_id bigint, url string, html string")).collect()}
    assert all(got[i] == f"Work {i}\n{own[i]}" for i in range(8))
    assert all(got[20 + i].split("\n") == [f"{own[i]} {j}" for j in range(i + 4)] for i in range(8))
    assert got[40] == "Read this too\nWork 0\nalone"  # one page of a host is no evidence: nothing is lost


def test_chat_repair_is_cheapest(spark):
    rng = random.Random(10)
    roles = ["system", "user", "assistant", "tool", None]
    convs = {c: [rng.choice(roles) for _ in range(rng.randint(1, 6))] for c in range(60)} | {99: [rng.choice(roles) for _ in range(300)]}
    rows = [(c, i, r, f"t{i}") for c, rs in convs.items() for i, r in enumerate(rs)] + [(None, None, "user", None)]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    got = collections.defaultdict(list)
    for r in chat.format_chat(df, segment=16).collect():
        got[r["conv_id"]].append(r)
    for c, rs in convs.items():
        states = {chat.START: 0.0}
        for role in rs:
            new: dict = {}
            for s, cost in states.items():
                for more, _, t, _, _ in chat.options(s, chat._role(role)):
                    new[t] = min(new.get(t, 1e9), cost + more)
            states = new
        assert sum(r["cost"] for r in got[c]) == min(v + chat.INSERT * len(chat.ending(s)) for s, v in states.items())
        whole = "".join(r["rendered"] for r in sorted(got[c], key=lambda r: r["seq"]))
        said = re.findall(r"<\|(system|user|assistant)\|>", whole)
        assert all(b in {"system": ["user"], "user": ["assistant"], "assistant": ["user"]}[a] for a, b in zip(said, said[1:])) and said[-1] == "assistant"
        assert all(f"t{i}" in whole for i in range(len(rs)))


def test_word_encoder_gives_the_ids_of_whole_texts():
    from tokenizers import Tokenizer

    texts = ["", " \n", "Straße ÉTION, É. ÀÿŸ İx. ΣΑΣ, ªº µm. ÷× a×b it's don't x!!,, ABC$%& éa, 12a, ﬁx a\x85b", "a" * 64 + " " + "B" * 65 + ". x!!!!!!!!! y!!!!!!!!", "one One ONE, one. One!"]
    whole = Tokenizer.from_file(tokenizer_path())
    encoder = packing.WordEncoder(tokenizer_path())
    want = [np.asarray(whole.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert encoder.encode_all(texts) == want
    assert encoder.encode_all(texts[::-1]) == want[::-1]  # from the memo
