"""Operator 10: language identification by prediction by partial matching over bytes."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_rest, text_groups

ORDER = 3
_LETTER = re.compile(r"[^\W\d_]")
#: ASCII that is no letter counts as a space.
_TABLE = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))
_RUNS = re.compile(rb" +")
STRETCH = 1 << 20
#: Characters of the texts whose strings are looked up together.
GROUP = 1 << 18


def _bytes(text: str) -> bytes:
    return b"   " + _RUNS.sub(b" ", text.lower().encode("utf-8", "replace").translate(_TABLE)).strip()


def has_letter(text: str | None) -> bool:
    return any(m.group().isalpha() for m in _LETTER.finditer(text or ""))


def _find(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Places of wanted in ascending keys; -1 where missing."""
    if not len(keys):
        return np.full(len(wanted), -1)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, at, -1)


def _rows(table: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Rows of table, of zeros where the place is -1."""
    out = np.zeros((len(at), table.shape[1]))
    out[at >= 0] = table[at[at >= 0]]
    return out


class LanguageModel:
    """Frozen context trees of all languages, for prediction by partial matching with escapes and exclusion.

    counts: by language (four-byte strings as big-endian uint32, how often). The longest context has three bytes. In a
    context a symbol that was seen costs its count, and any other the escape, whose count is that of distinct symbols
    (method C), and then its cost in the context one byte shorter, where all symbols seen in the longer one are
    excluded. Below order 0 the bytes never seen are equally likely. So the code lengths of a context's 256 next bytes
    are those of a distribution. Everything that the sample holds is kept, sorted by key: size follows the distinct
    contexts and symbols of the sample. known has the finished code lengths of all four-byte strings seen in any language.
    """

    def __init__(self, counts: dict[str, tuple[np.ndarray, np.ndarray]]):
        self.languages = sorted(counts)
        wide = len(self.languages)
        self.grams: list[np.ndarray] = []
        self.contexts: list[np.ndarray] = []
        self.count: list[np.ndarray] = []
        self.total: list[np.ndarray] = []
        self.distinct: list[np.ndarray] = []
        for order in range(ORDER + 1):
            mask = np.uint32((1 << 8 * (order + 1)) - 1)
            keys = np.unique(np.concatenate([k & mask for k, _ in counts.values()] or [np.zeros(0, np.uint32)]))
            count = np.zeros((len(keys), wide))
            for j, lang in enumerate(self.languages):
                np.add.at(count[:, j], np.searchsorted(keys, counts[lang][0] & mask), counts[lang][1])
            contexts, begin = np.unique(keys >> np.uint32(8), return_index=True)
            add = lambda x, begin=begin: np.add.reduceat(x, begin) if len(x) else np.zeros((0, wide))
            for kept, value in ((self.grams, keys), (self.contexts, contexts), (self.count, count), (self.total, add(count)), (self.distinct, add((count > 0).astype(float)))):
                kept.append(value)
        # by context of an order: how often what it has seen stands in the context one byte shorter
        self.excluded = [np.zeros((0, wide))]
        for order in range(1, ORDER + 1):
            shorter = self.count[order - 1][np.searchsorted(self.grams[order - 1], self.grams[order] & np.uint32((1 << 8 * order) - 1))] if len(self.grams[order]) else np.zeros((0, wide))
            begin = np.searchsorted(self.grams[order], self.contexts[order] << np.uint32(8))
            self.excluded.append(np.add.reduceat(np.where(self.count[order] > 0, shorter, 0), begin) if len(begin) else np.zeros((0, wide)))
        self.known = self.costs(self.grams[ORDER])

    @property
    def bits(self) -> np.ndarray:
        """[context, byte, language]: code lengths of all next bytes in every longest context."""
        grams = (self.contexts[ORDER][:, None] << np.uint32(8)) | np.arange(256, dtype=np.uint32)
        return self.costs(grams.ravel()).reshape(len(self.contexts[ORDER]), 256, len(self.languages))

    def costs(self, grams: np.ndarray) -> np.ndarray:
        """Code length of the last byte of each four-byte string after the other three, in every language."""
        wide = len(self.languages)
        out, open_ = np.zeros((len(grams), wide)), np.ones((len(grams), wide), bool)
        longer = np.full(len(grams), -1)
        for order in range(ORDER, -1, -1):
            own = grams & np.uint32((1 << 8 * (order + 1)) - 1)
            at = _find(self.contexts[order], own >> np.uint32(8))
            count, total, distinct = _rows(self.count[order], _find(self.grams[order], own)), _rows(self.total[order], at), _rows(self.distinct[order], at)
            if order < ORDER:
                total -= _rows(self.excluded[order + 1], longer)
                distinct -= _rows(self.distinct[order + 1], longer)
            room = total + distinct
            seen = open_ & (count > 0)
            out[seen] += np.log2(room[seen] / count[seen])
            open_ &= count == 0
            escapes = open_ & (distinct > 0)
            out[escapes] += np.log2(room[escapes] / distinct[escapes])
            longer = at
        unseen = np.log2(256 - (self.distinct[0][0] if len(self.distinct[0]) else np.zeros(wide)).clip(max=255))
        return out + np.where(open_, unseen, 0)

    def code_lengths(self, text: str) -> np.ndarray:
        raw = np.frombuffer(_bytes(text), np.uint8)
        total = np.zeros(len(self.languages))
        for at in range(0, max(0, len(raw) - ORDER), STRETCH):
            b = raw[at : at + STRETCH + ORDER].astype(np.uint32)
            grams = (b[:-3] << 24) | (b[1:-2] << 16) | (b[2:-1] << 8) | b[3:]
            place = _find(self.grams[ORDER], grams)
            known = place >= 0
            total += np.bincount(place[known], minlength=len(self.known)) @ self.known
            if not known.all():
                rest, n = np.unique(grams[~known], return_counts=True)
                total += n @ self.costs(rest)
        return total

    def predict(self, text: str | None) -> tuple[str, float]:
        return self._verdict(text, self.code_lengths(text or ""))

    def predict_all(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """predict() of every text; the strings of a group of texts are looked up together, so the cost of a look-up is shared."""
        out: list[tuple[str, float]] = []
        for _, group in text_groups(texts, texts, GROUP):
            raws = [_bytes(t) for t in group]
            bits = self._lengths(raws) if sum(map(len, raws)) <= STRETCH else [self.code_lengths(t) for t in group]
            out += [self._verdict(t, b) for t, b in zip(group, bits)]
        return out

    def _lengths(self, raws: list[bytes]) -> np.ndarray:
        """[text, language]: code lengths of short texts in bytes."""
        b = np.frombuffer(b"".join(raws), np.uint8).astype(np.uint32)
        sizes = np.array([len(r) for r in raws])
        ends = np.cumsum(sizes)
        inside = np.ones(len(b), bool)
        for back in range(1, ORDER + 1):
            inside[ends - back] = False
        grams = ((b[:-3] << 24) | (b[1:-2] << 16) | (b[2:-1] << 8) | b[3:])[inside[:-3]]
        place = _find(self.grams[ORDER], grams)
        known = place >= 0
        cost = np.empty((len(grams), len(self.languages)))
        cost[known] = self.known[place[known]]
        rest, which = np.unique(grams[~known], return_inverse=True)
        cost[~known] = self.costs(rest)[which]
        some = sizes > ORDER
        total = np.zeros((len(raws), len(self.languages)))
        if some.any():
            begin = np.cumsum(sizes - ORDER) - (sizes - ORDER)
            total[some] = np.add.reduceat(cost, begin[some])
        return total

    def _verdict(self, text: str | None, bits: np.ndarray) -> tuple[str, float]:
        if not self.languages or not has_letter(text):
            return "und", 0.0
        p = np.exp2(np.clip(bits.min() - bits, -1000, 0))
        best = int(bits.argmin())
        return self.languages[best], float(p[best] / p.sum())


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        langs = batch.column(0).to_pylist()
        for lang in sorted(set(langs)):
            parts = []
            for i, own in enumerate(langs):
                raw = np.frombuffer(_bytes(batch.column(1)[i].as_py() or ""), np.uint8).astype(np.uint32) if own == lang else np.zeros(0, np.uint32)
                if len(raw) > ORDER:
                    parts.append((raw[:-3] << 24) | (raw[1:-2] << 16) | (raw[2:-1] << 8) | raw[3:])
            keys, n = np.unique(np.concatenate(parts) if parts else np.zeros(0, np.uint32), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(keys.astype(np.int64)), pa.array(n.astype(np.int64))], names=["lang", "gram", "n"])


def train(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = 4, held_fold: int = 2, sample: int = 800) -> LanguageModel:
    """Counts byte contexts of about `sample` documents of each language outside the held-out fold; the driver gets counts of four-byte strings.

    The sample of a language is every document whose hash falls under sample / (its documents), so it is spread over all data.
    """
    usable = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & F.col(id_col).isNotNull() & (crc_rest(F.col(id_col), folds) != held_fold))
    sizes = {r["lang"]: r["n"] for r in usable.groupBy(F.col(lang_col).alias("lang")).agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return LanguageModel({})
    of = F.create_map(*[F.lit(x) for kv in sizes.items() for x in kv])
    rows = usable.where(F.pmod(F.xxhash64(id_col), of[F.col(lang_col)]) < sample).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    got = rows.mapInArrow(_grams, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas()
    return LanguageModel({lang: (g["gram"].to_numpy().astype(np.uint32), g["n"].to_numpy()) for lang, g in got.sort_values(["lang", "gram"]).groupby("lang")})


def identify(docs: DataFrame, model: LanguageModel, *, id_col: str = "doc_id", text_col: str = "text", folds: int = 4, held_fold: int = 2) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every whole text: the language of the shortest code, and its posterior under equal priors.

    Texts that are null or have no letter are `und` with score 0; repeated rows give equal results; a null id is kept
    with held_out null; ties go to the first language by name; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            got = m.predict_all(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], names=["doc_id", "lang_pred", "score"])

    out = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, lang_pred string, score double")
    return out.select("doc_id", (crc_rest(F.col("doc_id"), folds) == held_fold).alias("held_out"), "lang_pred", "score")
