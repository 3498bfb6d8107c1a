"""Operator 2: personal data by fixed patterns and by bootstrapped context patterns. DataFrame functions only."""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import SPACE, WORD, Workspace

#: Patterns that a text's words are held against in place.
LOOKUP = 5000
#: Places of found words that may be broadcast, of four bytes each and sixteen for their text.
PLACES = 1_000_000
#: Share of all distinct seeds that a pattern must hold, so that patterns follow the contexts that identifiers have in common and not the size of the corpus.
SHARE = 0.0015
KINDS = ("email", "ip", "card", "phone", "id")
_LOCAL = "A-Za-z0-9._%+-"
#: The base patterns, written so that Java matches them without recursion and without rescanning long runs:
#: a match starts at the start of its run, and what a run can't match whole is passed over at once.
PATTERNS = {
    "email": rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++\.[A-Za-z0-9-](?:[A-Za-z0-9.-](?<!\.\.))*(?<!\.)",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){11,18}(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A word with a digit or an at sign: every base span holds one.
MARKED_WORD = rf"(?<![^{SPACE}])[^{SPACE}0-9@]*+[0-9@][^{SPACE}]*+"
#: Formats of keys that name themselves; seeds beside the base spans.
SECRET = r"^[\"'`(]*(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|(?=[0-9a-f]*[a-f])(?=[0-9a-f]*[0-9])[0-9a-f]{32,128})[\"'`);,.]*$"
_TRIM = " \t\n\x0b\x0c\r"
#: Marks at the ends of a word that are no part of an identifier; a comma or full stop stays.
_EDGE = r"[\"'`#!*()\[\]{}<>“”‘’«»]*"


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _edges(m: Column) -> tuple[Column, Column]:
    """Lengths of the marks before and after an identifier in its word; none where the word is nothing but marks."""
    lead, trail = (F.char_length(F.regexp_extract(m, p, 0)) for p in (f"^{_EDGE}", f"{_EDGE}$"))
    some = lead < F.char_length(m)
    return F.when(some, lead).otherwise(0), F.when(some, trail).otherwise(0)


def _valid(kind: str, m: Column) -> Column:
    if kind == "ip":
        part = F.split(m, "\\.")
        ok = F.transform(part, lambda p: F.ltrim(p, F.lit("0")))
        return F.forall(ok, lambda p: (F.char_length(p) <= 3) & (F.coalesce(F.try_to_number(p, F.lit("999")).cast("int"), F.lit(0)) <= 255))
    if kind == "card":
        d = _digits(m)
        return F.char_length(d).between(12, 19) & F.call_function("luhn_check", d)
    if kind == "phone":
        return F.char_length(_digits(m)).between(9, 15)
    return F.lit(True)


def _found(text: Column, pattern: str, gate: Column, context: bool = False) -> Column:
    """Matches in order, each with the length of the text before it since the last match; what lies between gives contexts."""
    between, matches = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1))

    def one(m: Column, i: Column) -> Column:
        before = F.get(F.col("_between"), i) if context else F.get(between, i)
        fields = [F.char_length(before).alias("gap"), m.alias("m")]
        if context:
            tail = F.lower(F.regexp_extract(before, rf"([^{SPACE}]+[{SPACE}]+[^{SPACE}]+)[{SPACE}]*$", 1))
            near = F.lower(F.regexp_extract(before, rf"([^{SPACE}]+)[{SPACE}]*$", 1))
            after = F.lower(F.regexp_extract(F.get(F.col("_between"), i + 1), rf"^[{SPACE}]*([^{SPACE}]+)", 1))
            # an identifier may go on over several words with digits
            blank = lambda k: F.coalesce(F.trim(F.get(F.col("_between"), i + k)) == "", F.lit(False))
            second = F.when(blank(1), F.get(F.col("_matches"), i + 1))
            whole = F.concat_ws(" ", m, second, F.when(second.isNotNull() & blank(2), F.get(F.col("_matches"), i + 2)))
            lead, trail = _edges(m)
            fields += [lead.alias("lead"), trail.alias("trail"), m.rlike(SECRET).alias("secret"), F.xxhash64(whole).alias("whole"), F.regexp_replace(tail, rf"[{SPACE}]+", " ").alias("left2"), near.alias("left1"), after.alias("right1")]
        return F.struct(*fields)

    if context:
        return F.when(gate, F.transform(F.col("_matches"), one))
    return F.when(gate, F.transform(F.arrays_zip(matches.alias("m"), F.slice(between, 1, F.size(matches)).alias("b")), lambda z: F.struct(F.char_length(z["b"]).alias("gap"), z["m"].alias("m"))))


def _placed(found: DataFrame, column: str) -> DataFrame:
    """One row per match with its start and end in code points: running sums of what came before, in the order of the matches."""
    rows = found.where(F.size(column) > 0).select("uid", F.posexplode(column).alias("i", "x"))
    w = Window.partitionBy("uid").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("x.gap") + F.char_length("x.m")).over(w)
    return rows.withColumn("end", end).withColumn("start", F.col("end") - F.char_length("x.m"))


def score_patterns(edges: DataFrame, space: Workspace, *, rounds: int = 3, support: int = 5, trust: float = 0.5) -> DataFrame:
    """(pattern, confidence, seeds) from edges (pattern, instance, seed boolean).

    Round by round a pattern's confidence is the mean score of its instances, and an instance that is no seed scores
    the chance that one of its trusted patterns holds. Only patterns of at least `support` distinct seeds go on.
    """
    enough = edges.where("seed").groupBy("pattern").agg(F.count("*").alias("seeds")).where(F.col("seeds") >= support)
    edges = space.save(edges.join(enough, "pattern"), "edges")
    scored = edges.withColumn("score", F.col("seed").cast("double"))
    for r in range(rounds):
        patterns = space.save(scored.groupBy("pattern", "seeds").agg(F.avg("score").alias("confidence")), "patterns")
        if r + 1 < rounds:
            trusted = edges.where("NOT seed").join(patterns.where(F.col("confidence") >= trust).select("pattern", "confidence"), "pattern")
            instances = trusted.groupBy("instance").agg((1 - F.exp(F.sum(F.log(F.greatest(F.lit(1e-6), 1 - F.col("confidence")))))).alias("held"))
            scored = space.save(edges.join(instances, "instance", "left").withColumn("score", F.when(F.col("seed"), 1.0).otherwise(F.coalesce("held", F.lit(0.0)))).drop("held"), "scored")
    return patterns


def _plain_hits(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """(uid, i, instance, pattern): words without a digit or an at sign in the slot of a wanted pattern, by their place among the words.

    Slots are compared by hash. Up to LOOKUP patterns are held against in the expression, so that nothing but hits leaves
    a text; more are joined, with equal results.
    """
    part = F.split("pattern", " ")
    wanted = wanted.select("pattern", F.xxhash64(F.get(part, F.lit(0)), F.get(part, F.lit(1)), F.element_at(part, -1)).alias("h"))
    known = [r["h"] for r in wanted.select("h").limit(LOOKUP + 1).collect()]
    words = texts.select("uid", F.split(F.btrim(F.lower("t"), F.lit(_TRIM)), f"[{SPACE}]+").alias("w")).where(F.size("w") > 2)
    some = lambda at: F.slice("w", at, F.size("w") - 2)
    left = F.zip_with(some(1), some(2), lambda x, y: F.xxhash64(F.lit("l"), x, y))
    around = F.zip_with(some(1), some(3), lambda x, y: F.xxhash64(F.lit("c"), x, y))
    slots = F.concat(F.transform(left, lambda h, j: F.struct(h.alias("h"), (j + 2).alias("i"))), F.transform(around, lambda h, j: F.struct(h.alias("h"), (j + 1).alias("i"))))
    if len(known) <= LOOKUP:
        slots = F.filter(slots, lambda x: x["h"].isin(known)) if known else F.filter(slots, lambda x: F.lit(False))
    hits = words.select("uid", "w", F.explode(slots).alias("x")).select("uid", "x.h", "x.i", F.get("w", F.col("x.i")).alias("m"))
    return hits.where(~F.col("m").rlike("[0-9@]")).join(wanted, "h").select("uid", "i", F.xxhash64("m").alias("instance"), "pattern")


def _plain_places(texts: DataFrame, hits: DataFrame, base: DataFrame) -> DataFrame:
    """(uid, start, end) of words by their place among a text's words, outside base spans."""
    spots = hits.groupBy("uid").agg(F.collect_set("i").alias("places"))
    # few texts hold such words: their places go to the texts, else both are shuffled
    if hits.count() <= PLACES:
        spots = F.broadcast(spots)
    total = lambda parts: F.aggregate(parts, F.lit(0).cast("bigint"), lambda a, x: a + F.char_length(x))
    split = texts.join(spots, "uid").select("uid", "places", F.split("t", WORD, -1).alias("gaps"), F.regexp_extract_all("t", F.lit(f"({WORD})"), F.lit(1)).alias("words"))
    start = F.transform("places", lambda i: F.struct((total(F.slice("gaps", F.lit(1), i + 1)) + total(F.slice("words", F.lit(1), i))).alias("start"), F.get("words", i).alias("m")))
    lead, trail = _edges(F.col("x.m"))
    placed = split.select("uid", F.explode(start).alias("x")).select("uid", (F.col("x.start") + lead).alias("start"), (F.col("x.start") + F.char_length("x.m") - trail).alias("end"))
    inside = F.exists("base_spans", lambda s: (s["start"] < F.col("end")) & (s["end"] > F.col("start")))
    return placed.join(base, "uid", "left").where(~F.coalesce(inside, F.lit(False))).select("uid", "start", "end")


def find_pii(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", support: int = 5, confidence: float = 0.8, rounds: int = 3, grow: int = 1) -> DataFrame:
    """Per row of docs: doc_id, counts of base spans of each kind, base_spans and spans (arrays of start, kind, end in code points).

    Base spans and words in the format of a key are seeds; the latter are spans of kind `id`. The words around a seed (two to the left, or one on either side) are its patterns; all other
    words in the same contexts, with a digit or without, are the other instances. Patterns are scored over the graph of all documents, and
    where a pattern of enough seeds (`support`, and SHARE of all distinct ones) is confident, its other instances become spans of kind `id`, without the quotes and other marks around them. A base span is
    one instance, whatever its words. Instances with a digit
    that a confident pattern finds are seeds of one further pass (`grow`), in which patterns without base seeds can rise.

    One pass over the texts leaves matches, gaps and contexts only; another looks up the contexts of all plain words
    among the patterns of enough seeds. Null or empty texts have no spans; repeated rows
    and null ids are found row by row; an empty table gives no rows.
    """
    space = Workspace(docs.sparkSession, "pii")

    def needed(spots: DataFrame) -> int:
        """Seeds that a pattern must hold: a share of all, so that the graph grows with the corpus and not faster."""
        return max(support, ceil(SHARE * spots.where("seed").select("instance").distinct().count()))

    def confident(spots: DataFrame, least: int) -> DataFrame:
        edges = spots.groupBy("pattern", "instance").agg(F.max("seed").alias("seed"))
        return score_patterns(edges, space, rounds=rounds, support=least).where(F.col("confidence") >= confidence)

    text = F.coalesce(F.col(text_col), F.lit(""))
    texts = space.save(docs.select(F.monotonically_increasing_id().alias("uid"), F.col(id_col).cast("long").alias("doc_id"), text.alias("t")), "texts")
    df = texts
    digit = F.col("t").rlike("[0-9]")
    gates = {"email": F.contains(F.col("t"), F.lit("@")), "ip": digit, "card": digit, "phone": F.contains(F.col("t"), F.lit("+"))}
    marked = F.col("t").rlike("[0-9@]")
    df = df.withColumn("_between", F.when(marked, F.split("t", MARKED_WORD, -1))).withColumn("_matches", F.when(marked, F.regexp_extract_all("t", F.lit(f"({MARKED_WORD})"), F.lit(1))))
    found = space.save(df.select("uid", "doc_id", *[_found(F.col("t"), PATTERNS[k], g).alias(k) for k, g in gates.items()], _found(F.col("t"), MARKED_WORD, marked, True).alias("words")), "found")
    base = None
    for number, kind in enumerate(KINDS[:4]):
        part = _placed(found, kind).where(_valid(kind, F.col("x.m"))).select("uid", "start", F.lit(number).alias("kind"), "end", F.xxhash64("x.m").alias("is"))
        base = part if base is None else base.unionByName(part)
    told = space.save(base.groupBy("uid").agg(F.array_sort(F.collect_list(F.struct("start", "kind", "end", "is"))).alias("told")), "base")
    base = told.select("uid", F.transform("told", lambda s: s.dropFields("is")).alias("base_spans"))

    words = _placed(found, "words").select("uid", "start", "end", "x.lead", "x.trail", F.col("x.whole").alias("whole"), F.col("x.secret").alias("secret"), F.col("x.left2").alias("left2"), F.col("x.left1").alias("left1"), F.col("x.right1").alias("right1"))
    # what a base span holds is one instance, of however many words
    over = F.get(F.filter("told", lambda s: (s["start"] < F.col("end")) & (s["end"] > F.col("start"))), F.lit(0))
    words = words.join(told, "uid", "left").withColumn("over", over).withColumn("base", F.col("over").isNotNull()).withColumn("instance", F.coalesce("over.is", "whole"))
    words = words.withColumn("start", F.col("start") + F.when(F.col("base"), 0).otherwise(F.col("lead"))).withColumn("end", F.col("end") - F.when(F.col("base"), 0).otherwise(F.col("trail")))
    patterns = F.array_compact(F.array(F.when(F.col("left2") != "", F.concat(F.lit("l "), "left2")), F.when((F.col("left1") != "") & (F.col("right1") != ""), F.concat(F.lit("c "), "left1", F.lit(" _ "), "right1"))))
    spots = space.save(words.select("uid", "start", "end", "base", "secret", (F.col("base") | F.col("secret")).alias("seed"), "instance", F.explode_outer(patterns).alias("pattern")), "spots")
    secrets = spots.where("secret AND NOT base").select("uid", "start", "end").distinct()
    spots = spots.where("pattern IS NOT NULL").drop("secret")
    # what a confident pattern finds among the marked words is a seed of the next pass, so the set of edges grows
    for _ in range(grow):
        good = confident(spots, needed(spots))
        promoted = spots.where("NOT seed").join(good.select("pattern"), "pattern", "left_semi").select("instance", F.lit(True).alias("found")).distinct()
        spots = space.save(spots.join(promoted, "instance", "left").withColumn("seed", F.col("seed") | F.coalesce("found", F.lit(False))).drop("found"), "spots")
    least = needed(spots)
    wanted = space.save(spots.where("seed").groupBy("pattern").agg(F.countDistinct("instance").alias("n")).where(F.col("n") >= least).select("pattern"), "wanted")
    plain = space.save(_plain_hits(texts, wanted), "plain")
    good = space.save(confident(spots.select("pattern", "instance", "seed").unionByName(plain.select("pattern", "instance", F.lit(False).alias("seed"))), least).select("pattern"), "good")
    new = spots.where("NOT base").join(good, "pattern", "left_semi").select("uid", "start", "end").union(secrets)
    new = new.union(_plain_places(texts, plain.join(good, "pattern", "left_semi"), base))
    new = new.groupBy("uid").agg(F.collect_set(F.struct("start", F.lit(4).alias("kind"), "end")).alias("new_spans"))
    out = found.select("uid", "doc_id").join(base, "uid", "left").join(new, "uid", "left")
    none = F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>")
    out = out.select("doc_id", F.coalesce("base_spans", none).alias("base_spans"), F.coalesce("new_spans", none).alias("new_spans"))
    # a second parameter of the function would be the place in the array
    of_kind = lambda k: F.size(F.filter("base_spans", lambda s: s["kind"] == k))
    counts = [of_kind(k).cast("long").alias(f"n_{KINDS[k]}") for k in range(4)]
    return out.select("doc_id", *counts, "base_spans", F.array_sort(F.concat("base_spans", "new_spans")).alias("spans"))


def joined(spans: str) -> Column:
    """kind:start:end of all spans, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")
