"""The registered queries of the training-data operators, and their SQL where SQL can express them.

Every query applies its operator, with production parameters, to its whole table and derives the digest columns
of its contract from the operator's own output.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_classifier import score_quality, train

    docs = _table(spark, sf_dir, "documents")
    return score_quality(docs, train(docs, _table(spark, sf_dir, "labels")))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import find_pii, joined

    found = find_pii(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2(joined("base_spans"), 256).alias("base_sha256"), joined("spans").alias("spans"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(_table(spark, sf_dir, "documents"), tokenizer_path())


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontamination import contaminated

    found = contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", F.size("item_ids").cast("long").alias("n_items"), "item_ids")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_rules import apply_rules

    return apply_rules(_table(spark, sf_dir, "documents"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_dedup import dedup_lines

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text"), 256).alias("kept_sha256"))


OP6_SQL = """
WITH lines AS (
  SELECT doc_id, u.i AS pos, u.line AS line,
         translate(trim(u.line, chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents),
       LATERAL (SELECT unnest(parts) AS line, generate_subscripts(parts, 1) AS i) u
), marked AS (
  SELECT *, length(key) >= 10 AND doc_id <> min(doc_id) OVER (PARTITION BY key) AS gone FROM lines
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ngram_join import similar_components

    return similar_components(_table(spark, sf_dir, "documents"), n=4, num=85, den=100)


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_extraction import extract_main_text

    pages = extract_main_text(_table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return pages.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chat import format_chat

    turns = format_chat(_table(spark, sf_dir, "conversations"))
    return turns.select("conv_id", "seq", "turn", "role", "action", F.array_join("inserted", ",").alias("inserted"), "cost", "rendered")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language_id import identify, train

    docs = _table(spark, sf_dir, "documents")
    return identify(docs, train(docs))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .token_alignment import align_tokens

    return align_tokens(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.PATTERN)


def op12_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring_dedup import dedup_substrings

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_substrings(docs).select("doc_id", "n_words", "n_removed", F.sha2(F.col("text"), 256).alias("kept_sha256"))


OP12_SQL = """
WITH words AS (
  SELECT doc_id, u.i AS pos, u.word AS word
  FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS parts FROM documents),
       LATERAL (SELECT unnest(parts) AS word, generate_subscripts(parts, 1) AS i) u
), spans AS (
  SELECT doc_id, pos, word, list(word) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING) AS span FROM words
), marked AS (
  SELECT *, len(span) = 13 AND min(doc_id) OVER (PARTITION BY span) < doc_id AS late FROM spans
), covered AS (
  SELECT *, bool_or(late) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 12 PRECEDING AND CURRENT ROW) AS gone FROM marked
), kept AS (
  SELECT doc_id, count(*) AS n_words, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY pos) FILTER (NOT gone) AS kept FROM covered GROUP BY doc_id
)
SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM documents LEFT JOIN kept USING (doc_id)
"""


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .collocations import collocations

    return collocations(_table(spark, sf_dir, "documents"))


OP13_SQL = """
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, doc_id, u.i AS piece, u.t AS t
  FROM (SELECT lang, doc_id, regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]') AS parts FROM documents),
       LATERAL (SELECT unnest(parts) AS t, generate_subscripts(parts, 1) AS i) u
), split AS (
  SELECT lang, doc_id, piece, regexp_extract_all(t, '[^\\x20\\x09]+') AS ws FROM pieces
), words AS (
  SELECT lang, doc_id, piece, ws, unnest(range(1, len(ws) + 1)) AS pos FROM split
), phrases AS (
  SELECT lang, m, array_to_string(ws[pos:pos + m - 1], ' ') AS phrase FROM words, (SELECT unnest(range(1, 5)) AS m) WHERE pos + m - 1 <= len(ws)
), freq AS (
  SELECT lang, phrase, m, count(*) AS f FROM phrases GROUP BY ALL HAVING count(*) >= 30
), totals AS (
  SELECT lang, count(*) AS n FROM phrases WHERE m = 1 GROUP BY lang
), cuts AS (
  SELECT c.lang, c.phrase, c.f AS a, k, string_split(c.phrase, ' ') AS ws, c.m FROM freq c, (SELECT unnest(range(1, 4)) AS k) WHERE k < c.m
), scored AS (
  SELECT c.lang, c.phrase, c.a, c.k, x.f AS l, y.f AS r, (2000000::HUGEINT * c.a) // (x.f + y.f) AS score
  FROM cuts c JOIN freq x ON x.lang = c.lang AND x.phrase = array_to_string(ws[1:c.k], ' ')
              JOIN freq y ON y.lang = c.lang AND y.phrase = array_to_string(ws[c.k + 1:c.m], ' ')
), best AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), inner_parts AS (
  SELECT lang, f, unnest(list_concat([array_to_string(ws[i:i + 1], ' ') for i in range(1, m)], CASE WHEN m = 4 THEN [array_to_string(ws[i:i + 2], ' ') for i in range(1, 3)] ELSE [] END)) AS sub
  FROM (SELECT lang, f, m, string_split(phrase, ' ') AS ws FROM freq WHERE m > 2)
), longest AS (
  SELECT lang, sub, max(f) AS f FROM inner_parts GROUP BY ALL
), kept AS (
  SELECT b.* FROM best b LEFT JOIN longest g ON g.lang = b.lang AND g.sub = b.phrase WHERE g.f IS NULL OR 100 * g.f < 80 * b.a
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM kept
)
SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_classifier": op1_quality_classifier,
    "op2_pii": op2_pii,
    "op3_packing": op3_packing,
    "op4_decontamination": op4_decontamination,
    "op5_quality_rules": op5_quality_rules,
    "op6_line_dedup": op6_line_dedup,
    "op7_ngram_join": op7_ngram_join,
    "op8_html_extraction": op8_html_extraction,
    "op9_chat_format": op9_chat_format,
    "op10_language_id": op10_language_id,
    "op11_token_alignment": op11_token_alignment,
    "op12_substring_dedup": op12_substring_dedup,
    "op13_collocations": op13_collocations,
}

ORACLE_SQL: dict[str, str] = {"op6_line_dedup": OP6_SQL, "op12_substring_dedup": OP12_SQL, "op13_collocations": OP13_SQL}
