"""Operator 8: main text of web pages by site style trees."""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Workspace

#: Elements whose text is never read.
RAW = frozenset("script style noscript template svg iframe textarea select button title object canvas".split())
_NAME = re.compile("[a-zA-Z][a-zA-Z0-9:-]*")
_RAW_NAME = re.compile(r"(?:" + "|".join(sorted(RAW)) + r")\b", re.I)
_RAW_END = re.compile(r"</(" + "|".join(sorted(RAW)) + r")\s*>", re.I)
_STOP = re.compile("[>\"']")
_ATTR = re.compile(r"\b(class|id|role|hidden|aria-hidden|style)\s*(?:=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?", re.I)
_PART = re.compile(r"[a-z0-9]+")
BLOCK = frozenset("html head body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul caption".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that end an open element of their own kind.
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "tbody": {"tbody", "thead", "tr", "td", "th"}, "tfoot": {"tbody", "thead", "tr", "td", "th"}}
#: Elements whose name speaks against content, and words in class or role, or whole ids of containers, that do so.
NO_CONTENT = frozenset("nav footer aside form menu dialog search".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
NO_CONTENT_WORDS = frozenset(
    "ad ads advert advertisement adverts advertising sponsor sponsored promo promotion banner nav navbar navigation menu sidebar footer masthead topbar breadcrumb breadcrumbs pagination pager comment comments respond reply disqus cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe signup login share sharing social related recommended widget toolbar complementary contentinfo hidden".split()
)


#: Mark of a node that stays though its name speaks against it; importance under which a branch goes even inside an article.
KEPT, IN_ARTICLE = 2.0, 0.1


def _markup(page: str) -> Iterator[tuple[int, int, str, bool, str, str]]:
    """(start, end, name, whether it closes, attributes, raw element's name) of comments, tags and raw elements in order; a name is empty where no element begins or ends.

    Every search runs forward from the last end, and what is missing once (a bracket, a closing quote, the end of a raw
    element) is not looked for again, so the pass is linear whatever the page holds, and attributes may be of any length.
    """
    at, n = 0, len(page)
    last_end, last_quote = page.rfind(">"), {q: page.rfind(q) for q in "\"'"}
    raw_ends: dict[str, list[int]] | None = None
    open_ended: set[int] = set()  # quotes from which on no bracket outside of quotes is left
    while (at := page.find("<", at)) >= 0:
        if page.startswith("<!--", at):
            end = page.find("-->", at + 4)
            end = n if end < 0 else end + 3
            yield at, end, "", False, "", ""
            at = end
            continue
        if at > last_end:  # no tag ends any more; an open comment may begin
            at = page.find("<!--", at)
            if at < 0:
                return
            continue
        raw = _RAW_NAME.match(page, at + 1)
        if raw:
            name, begin = raw.group().lower(), page.find(">", raw.end()) + 1
            if raw_ends is None:
                raw_ends = {}
                for m in _RAW_END.finditer(page):
                    raw_ends.setdefault(m.group(1).lower(), []).append(m.start())
            ends = raw_ends.get(name, [])
            i = bisect_left(ends, begin)
            end = page.index(">", ends[i]) + 1 if i < len(ends) else n
            yield at, end, "", False, "", name
            at = end
            continue
        closes = page.startswith("/", at + 1)
        name = _NAME.match(page, at + 1 + closes)
        if not name:
            if closes or page[at + 1 : at + 2] in ("!", "?"):
                end = page.find(">", at) + 1
                yield at, end, "", False, "", ""
                at = end
            else:
                at += 1
            continue
        spot, end, quotes = name.end(), 0, []
        while m := _STOP.search(page, spot):
            if m.group() == ">":
                end = m.end()
                break
            if m.start() >= last_quote[m.group()] or m.start() in open_ended:
                break
            quotes.append(m.start())
            spot = page.index(m.group(), m.end()) + 1
        if not end:
            open_ended.update(quotes)
        end = end or page.find(">", name.end()) + 1
        yield at, end, name.group().lower(), closes, page[name.end() : end - 1], ""
        at = end


class _Tree:
    """One pass over a page's markup: its visible text blocks, each with the style nodes above it, and the order of the style nodes under each."""

    __slots__ = ("blocks", "below")

    def __init__(self, page: str):
        self.blocks: list[tuple[tuple[str, ...], tuple[bool, ...], bool, str]] = []  # path, which of its nodes are named as no content, in the article, text
        self.below: dict[tuple[str, ...], xxhash.xxh3_64] = {}
        stack: list[tuple[str, str, bool, bool, bool]] = []  # tag, style, invisible, in the article, named as no content
        text: list[str] = []
        at = 0

        def flush() -> None:
            if text:
                words = " ".join(html.unescape("".join(text)).split())
                text.clear()
                if words:
                    if stack and stack[-1][2]:
                        return
                    path = tuple(s[1] for s in stack)
                    self.below.setdefault(path, xxhash.xxh3_64()).update("\n#text")
                    self.blocks.append((path, tuple(s[4] for s in stack), bool(stack) and stack[-1][3], words))

        for start, end, tag, closes, attrs, raw in _markup(page):
            if start > at:
                text.append(page[at:start])
            at = end
            if not tag:
                if raw in ("button", "select", "textarea"):
                    text.append(" ")
                continue
            if tag not in BLOCK:
                if tag == "br":
                    text.append(" ")
                continue
            flush()
            if closes:
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] == tag:
                        del stack[i:]
                        break
                continue
            if tag in VOID:
                continue
            ends = CLOSES.get(tag) or ({"p"} if tag not in ("html", "head", "body") else set())
            while stack and stack[-1][0] in ends:
                stack.pop()
            if tag == "body":
                while stack and stack[-1][0] == "head":
                    stack.pop()
            up_gone, up_in = (stack[-1][2], stack[-1][3]) if stack else (False, False)
            style, gone = tag, up_gone or tag == "head"
            words: list[str] = []
            if attrs and not attrs.isspace():
                for a in _ATTR.finditer(attrs):
                    key, value = a.group(1).lower(), (a.group(2) or "").strip("\"'").lower()
                    if key in ("class", "role"):
                        words += _PART.findall(value)
                        style += "." + value
                    elif key == "id":
                        if tag not in HEADINGS:
                            words.append(value)
                    elif key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and "display:none" in value.replace(" ", ""):
                        gone = True
            named = tag in NO_CONTENT or tag == "header" and not up_in or tag not in ("html", "body", "main", "article") and any(w in NO_CONTENT_WORDS for w in words) or tag == "article" and any(w in ("comment", "comments", "ad", "related", "promo") for w in words)
            inside = up_in or not named and (tag in ("article", "main") or "articlebody" in words)
            if stack and not gone:
                self.below.setdefault(tuple(s[1] for s in stack), xxhash.xxh3_64()).update("\n" + style)
            stack.append((tag, style, gone, inside, named))
        if at < len(page):
            text.append(page[at:])
        flush()


def main_text(page: str | None, tree_of_host: dict[int, float] | None = None) -> str:
    """The blocks that the host's style tree keeps: node to its importance where that is low, or KEPT where a node stays against its name."""
    known = tree_of_host or {}
    memo: dict[tuple, bool] = {}

    def gone(path: tuple[str, ...], named: tuple[bool, ...], inside: bool) -> bool:
        for i in range(len(path)):
            importance = known.get(_node(path[: i + 1])) if known else None
            if named[i] and importance != KEPT:
                return True
            if importance is not None and importance != KEPT and (not inside or importance < IN_ARTICLE):
                return True
        return False

    out = []
    for path, named, inside, words in _Tree(page or "").blocks:
        key = (path, named, inside)
        if key not in memo:
            memo[key] = gone(*key)
        if not memo[key]:
            out.append(words)
    return "\n".join(out)


def _node(path: tuple[str, ...]) -> int:
    return xxhash.xxh3_64_intdigest("/".join(path)) - (1 << 63)


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", 1))


def _nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Style nodes of every page: hashes of what each holds and of how it is laid out, and its share of the page's text. key: the text that no name speaks against, or all text where that is the lesser part."""
    for batch in batches:
        hosts: list = []
        columns: list[list] = [[], [], [], [], []]
        for host, page in zip(batch.column(0).to_pylist(), batch.column(1)):
            tree = _Tree(page.as_py() or "")
            below: dict[tuple[str, ...], list] = {}
            own, whole, unnamed, total = xxhash.xxh3_64(), xxhash.xxh3_64(), 0, 0
            for path, named, _, words in tree.blocks:
                total += len(words)
                whole.update(words + "\n")
                if not any(named):
                    unnamed += len(words)
                    own.update(words + "\n")
                for i in range(1, len(path)):
                    node = below.setdefault(path[: i + 1], [xxhash.xxh3_64(), 0])
                    node[0].update(words + "\n")
                    node[1] += len(words)
            key = (own if 2 * unnamed >= total else whole).intdigest() - (1 << 63)
            hosts += [host] * len(below)
            for path, (content, chars) in below.items():
                for column, x in zip(columns, (_node(path), content.intdigest() - (1 << 63), tree.below[path].intdigest() - (1 << 63), key, chars / total)):
                    column.append(x)
        kinds = [pa.int64()] * 4 + [pa.float64()]
        yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), *[pa.array(c, k) for c, k in zip(columns, kinds)]], names=["host", "node", "content", "layout", "key", "share"])


def style_tree(pages: DataFrame, *, importance: float = 0.3, least_pages: int = 5, against_name: float = 0.85) -> DataFrame:
    """(host, nodes): nodes of a host's merged tree that its pages decide, with their importance or KEPT.

    A node stands for all elements of a host at one path of tags and classes. Its content entropy is that of what it
    holds over the host's pages, its presentation entropy that of the sequence of elements in it, both with the number
    of pages as base: 0 where every page has the same, 1 where no two have. A branch is low where both are under
    `importance`. KEPT is a branch of both over `against_name` that holds half of the text of its pages.

    Every page counts, but copies of one main text count once. Counts are per (host, node, value) and built on the map
    side, so a host of any size is never one group.
    """
    nodes = pages.mapInArrow(_nodes, "host string, node long, content long, layout long, key long, share double")
    one = nodes.groupBy("host", "node", "key").agg(F.max_by(F.struct("content", "layout", "share"), F.struct("content", "layout")).alias("x"))
    value = lambda kind, x, share: F.struct(F.lit(kind).alias("kind"), F.col(x).alias("value"), share.alias("share"))
    values = one.select("host", "node", F.explode(F.array(value("c", "x.content", F.col("x.share")), value("l", "x.layout", F.lit(0.0)))).alias("v"))
    shares = values.groupBy("host", "node", "v.kind", "v.value").agg(F.count("*").alias("c"), F.sum("v.share").alias("share"))
    clogc = {k: F.sum(F.when(F.col("kind") == k, F.col("c") * F.log("c"))).alias(k) for k in "cl"}
    stats = shares.groupBy("host", "node").agg(F.sum(F.when(F.col("kind") == "c", F.col("c"))).alias("m"), F.sum("share").alias("share"), *clogc.values()).where(F.col("m") >= F.lit(max(2, least_pages)))
    content, layout = (1 - F.col(k) / (F.col("m") * F.log("m")) for k in "cl")
    verdict = F.when((F.least(content, layout) >= against_name) & (F.col("share") >= 0.5 * F.col("m")), F.lit(KEPT)).when(F.greatest(content, layout) < importance, F.greatest(content, layout))
    decided = stats.select("host", "node", verdict.alias("importance")).where("importance IS NOT NULL")
    return decided.groupBy("host").agg(F.collect_list(F.struct("node", "importance")).alias("nodes"))


def extract_main_text(pages: DataFrame, *, url_col: str = "url", html_col: str = "html", importance: float = 0.3, least_pages: int = 5) -> DataFrame:
    """All columns of pages without the markup, plus text: the main text of each page.

    The style tree of a page's host, built from all of the host's pages, decides every branch it has seen on least_pages
    pages. Names, roles and classes are a prior: a branch named as navigation, advert, form or comments goes unless the
    tree marks it KEPT, and a branch inside an article goes only where nearly all pages repeat it. An article vetoes
    nothing beside it. Pages of a null url share the empty host; a null page has empty text; repeated rows are taken
    each; no rows give no rows.
    """
    space = Workspace(pages.sparkSession, "style")
    slim = pages.select(host_of(F.col(url_col)).alias("host"), F.col(html_col).alias("html")).where(F.col("html").isNotNull())
    low = space.save(style_tree(slim, importance=importance, least_pages=least_pages), "tree")
    names = [c for c in pages.columns if c not in (html_col, "text", "_tw_low", "_tw_host")]
    joined = pages.withColumn("_tw_host", host_of(F.col(url_col)))
    joined = joined.join(low.select(F.col("host").alias("_tw_host"), F.col("nodes").alias("_tw_low")), "_tw_host", "left").select(*[F.col(f"`{c}`") for c in names], F.col(html_col).alias("_tw_html"), "_tw_low")
    k = len(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lows = batch.column(k + 1)
            texts = []
            for i, page in enumerate(batch.column(k)):
                nodes = lows[i].as_py() or ()
                texts.append(main_text(page.as_py(), {x["node"]: x["importance"] for x in nodes}))
            yield pa.RecordBatch.from_arrays([*batch.columns[:k], pa.array(texts, pa.string())], names=[*names, "text"])

    from pyspark.sql.types import StringType, StructField, StructType

    schema = StructType([*joined.select(*[F.col(f"`{c}`") for c in names]).schema.fields, StructField("text", StringType())])
    return joined.mapInArrow(run, schema)
