"""Main text of web pages by site style trees.

The DOMs of a host's pages are merged into one style tree: a node is a path of elements (tag with
class and id words, digits left out), navigation, advert and article nodes alike.  With P different
pages of the host and a value (text of a block, or sequence of child elements) seen on c of them, the
value tells log c / log P of what could be told by chance, so

* presentation importance of a node is 1 less the mean of that over the child sequences seen there;
* content importance is 1 less the mean of it over the texts of its blocks, whatever their number a
  page: a menu of six lines that every page repeats has 0, lines of one page only have 1;
* composite importance, from the leaves up, is ``OWN`` of a node's own (the mean of both) plus the
  rest of the mean of its children, weighted by what was seen there.

A host's figures are blended with those of the same nodes in the tree merged over all hosts, as if
the host had ``SHARED`` pages more like these, so that small hosts borrow templates and none is judged
by its size.  Rules of purpose set priors only: an element made for navigation, footers, sidebars,
forms or scripts, or named for such a purpose, has prior 0, ``article`` and ``main`` have 1, the rest
1/2.  A branch goes where (2 prior + importance) / 3 is below ``LOW`` at its node and at all below it: in
open ground the tree decides (importance below 0.5), ``article`` stands whatever the tree says, and menus that change from page to
page go by their prior.  Names do not count as a purpose where the element holds an ``article`` or
``main`` or, on pages without those, more than half of the text; inside ``article`` only names of
adverts and reader comments do, any other merely opens its branch to the tree's decision.  A single
text goes as well where at least ``SHARE`` of the host's different pages say it at the same node.

Every block that goes is counted by cause: ``by_tree`` (its branch has low importance by itself, or
its text is the host's) and ``by_prior`` (only the purpose of an element speaks against it).

Statistics are aggregated in Spark by (host, node, value), with copies of a page counted once, so a
host with a third of all pages is many small partial sums; only a host's tree (its templates'
nodes, not its pages; nodes of a single page anywhere are left out) meets in one task.

Defined results: null or empty html gives an empty text; a null or odd url is the host ""; broken
markup is read as far as it goes, an element cut off at the end is dropped; repeated pages are rows
of their own; an empty table gives an empty table; further columns are not read.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talweg.storage import stored

OWN = 0.5
LOW = 0.5
UNIMPORTANT = 3 * LOW - 1  # importance below which a branch of prior 1/2 goes
SHARED = 5
SHARE = 0.5
BROADCAST_BYTES = 8_000_000

# Elements and words by purpose.
RAW = {"script", "style", "title", "textarea", "noscript", "template", "iframe", "xmp", "noframes", "noembed"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
DROP = {"nav", "footer", "aside", "form", "button", "select", "option", "svg", "canvas", "object", "audio", "video", "menu", "dialog"}
INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "mark", "q",
    "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "img", "nobr",
}
CLOSES_P = {
    "address", "article", "aside", "blockquote", "center", "details", "dialog", "dd", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer",
    "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "li", "main", "menu", "nav", "ol", "p", "pre", "section", "table", "ul",
}
SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
LIMIT = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}
PURPOSE = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "adsense", "adsbygoogle", "banner", "sponsor", "sponsored", "promo", "promotion",
    "nav", "navbar", "navigation", "menu", "breadcrumb", "breadcrumbs", "pagination", "pager", "sidebar", "footer", "masthead", "topbar", "toolbar",
    "comment", "comments", "commentlist", "disqus", "respond", "replies", "reply", "cookie", "cookies", "consent", "gdpr", "notice", "notification",
    "alert", "popup", "modal", "overlay", "newsletter", "subscribe", "subscription", "signup", "login", "search", "share", "sharing", "social",
    "related", "recommended", "recommendations", "widget", "contentinfo", "complementary", "hidden", "skip", "copyright", "disclaimer",
}
# Names that keep their meaning inside an article.
FOREIGN = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "adsense", "adsbygoogle", "sponsor", "sponsored",
    "comment", "comments", "commentlist", "disqus", "respond", "replies", "reply",
}
MAIN = {"article", "main"}
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|</?[a-zA-Z][^>]*\Z|[^<]+|<", re.S
)
ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
HIDDEN = re.compile(r"(?:^|\s)(?:hidden(?=[\s=]|$)|aria-hidden\s*=\s*[\"']?true|style\s*=\s*(?:\"[^\"]*|'[^']*)display\s*:\s*none)", re.I)
WORD = re.compile(r"[a-z]+")
NAME = re.compile(r"[a-z]+(?:[-_]+[a-z]+)*")


def _hash(x: str) -> int:
    return xxhash.xxh64_intdigest(x.encode("utf-8", "surrogatepass")) - (1 << 63)


class _Element:
    """``gone``: an element from the root to this one has prior 0 by its tag; ``purpose``: those whose
    names tell a purpose, in force unless they hold the content; ``soft``: the path of such a one in an article."""

    __slots__ = ("article", "children", "gone", "holds", "main", "path", "purpose", "size", "soft", "tag")

    def __init__(self, tag: str, path: str, gone: bool = False, main: bool = False, purpose: tuple[_Element, ...] = (), soft: str = "", article: bool = False):
        self.tag, self.path, self.gone, self.main, self.article = tag, path, gone, main, article
        self.purpose, self.soft, self.children = purpose, soft, []
        self.holds, self.size = False, 0


def _described(tag: str, attributes: str, parent: _Element) -> _Element:
    words: list[str] = []
    role, named, foreign = "", False, False
    if attributes and ("=" in attributes or "hidden" in attributes):
        for name, *values in ATTRIBUTE.findall(attributes):
            value = entities.unescape("".join(values)).lower()
            words += WORD.findall(value)
            names = [set(WORD.findall(x)) for x in value.split() if NAME.fullmatch(x)]
            named = named or any(PURPOSE.issuperset(x) for x in names)
            foreign = foreign or any(PURPOSE.issuperset(x) and x & FOREIGN for x in names)
            if name.lower() == "role":
                role = value
    begins = (tag in MAIN or role == "main") and not foreign
    gone = parent.gone or tag in DROP or (tag == "header" and not parent.main)
    if not gone and tag not in ("html", "body"):
        gone = bool(attributes and HIDDEN.search(attributes))
    e = _Element(tag, f"{parent.path}/{'.'.join([tag, *words])}", gone, parent.main or begins, parent.purpose, parent.soft, parent.article or (begins and tag == "article"))
    if begins and not gone:
        for x in e.purpose:
            x.holds = True
        e.purpose, e.soft = (), ""
    elif named and tag not in ("html", "body"):
        if parent.article and not foreign:
            e.soft = e.soft or e.path
        else:
            e.purpose = (*e.purpose, e)
    return e


class Block:
    """Text of one block: ``kept`` says what no prior of 0 takes, of ``text``, which says all."""

    __slots__ = ("kept", "main", "path", "soft", "text")

    def __init__(self, path: str, text: str, kept: str, main: bool, soft: str):
        self.path, self.text, self.kept, self.main, self.soft = path, text, kept, main, soft

    def removed(self, low: list[str], often: set[tuple[str, int]]) -> str:
        """Why the block goes: "tree", "prior" or "" for a block that stays."""
        scope = self.soft if self.main else "/"
        if (self.path, _hash(self.text)) in often:
            return "tree"
        if self.kept and self.main and not scope:
            return ""
        for p in low:
            if (self.path == p or self.path.startswith(p + "/")) and (not self.kept or scope == "/" or p == scope or p.startswith(scope + "/")):
                return "tree"
        return "" if self.kept else "prior"


def blocks(html: str | None) -> tuple[list[Block], list[tuple[str, str]]]:
    """All blocks in page order, and (path, children) of elements."""
    root = _Element("", "")
    stack = [root]
    found: list[tuple[_Element, list[tuple[str, _Element]]]] = []
    shapes: list[tuple[str, str]] = []
    held: list[tuple[str, _Element]] = []
    home = root

    def close_block() -> None:
        if held:
            found.append((home, held.copy()))
            held.clear()

    def pop(n: int) -> None:
        for e in stack[n:]:
            if e.children and e.tag not in INLINE:
                shapes.append((e.path, " ".join(e.children)))
        del stack[n:]

    html = html or ""
    at, size = 0, len(html)
    while at < size:
        m = TOKEN.match(html, at)
        at = m.end()
        text = m.group()
        slash, tag, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if tag is None:
            if text[0] != "<" or text == "<":
                if not held:
                    home = next(e for e in reversed(stack) if e.tag not in INLINE)
                held.append((text, stack[-1]))
            continue
        tag = tag.lower()
        if slash:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    if tag not in INLINE:
                        close_block()
                    pop(i)
                    break
            else:
                if tag in ("p", "br"):
                    close_block()
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I).search(html, at)
            at = end.end() if end else size
            continue
        if tag == "br":
            held.append((" ", stack[-1])) if held else None
            continue
        if tag not in INLINE:
            close_block()
            if tag in CLOSES_P:
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].tag == "p":
                        pop(i)
                        break
                    if stack[i].tag not in INLINE:
                        break
            if tag in SAME:
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].tag in LIMIT[tag]:
                        break
                    if stack[i].tag in SAME[tag]:
                        pop(i)
                        break
        if tag in VOID:
            continue
        e = _described(tag, attributes, stack[-1])
        if tag not in INLINE:
            stack[-1].children.append(tag)
        stack.append(e)
    close_block()
    pop(1)
    total, within_main, within_article = 0, False, False
    for home, pieces in found:
        if home.main and any(t.strip() and not e.gone for t, e in pieces):
            within_main, within_article = True, within_article or home.article
        for text, e in pieces:
            n = 0 if e.gone else len(text.strip())
            total += n
            for x in e.purpose:
                x.size += n

    def gone(e: _Element) -> bool:
        return e.gone or any(not x.holds and (within_article or (within_main and not x.main) or 2 * x.size <= total) for x in e.purpose)

    def said(pieces: list[str]) -> str:
        return " ".join(entities.unescape("".join(pieces)).split())

    out: list[Block] = []
    for home, pieces in found:
        text = said([t for t, _ in pieces])
        if text:
            out.append(Block(home.path, text, said([t for t, e in pieces if not gone(e)]), home.main, home.soft))
    return out, shapes


def host_column(url: Column) -> Column:
    """Host of a url, lower-cased, without user and port; "" where there is none."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def _style_nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, page, path, kind, value): what each page says and shows at each node, and a row "page"."""
    for batch in batches:
        rows: list[tuple] = []
        for host, html in zip(batch.column("host").to_pylist(), (h.as_py() for h in batch.column("html")), strict=True):
            found, shapes = blocks(html)
            page = _hash("\n".join(b.text for b in found))
            seen = {(b.path, "text", _hash(b.text)) for b in found} | {(p, "shape", _hash(c)) for p, c in shapes} | {("", "page", 0)}
            rows += [(host, page, p, k, v) for p, k, v in seen]
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()), strict=True)],
            ["host", "page", "path", "kind", "value"],
        )


def importances(nodes: list[tuple[str, str, float, int]]) -> dict[str, float]:
    """Composite importance by path; ``nodes`` has (path, kind, importance of that kind, values seen)."""
    own: dict[str, list[float]] = {}
    weight: dict[str, int] = {}
    children: dict[str, list[str]] = {}
    for path, _, importance, seen in nodes:
        own.setdefault(path, []).append(importance)
        weight[path] = weight.get(path, 0) + seen
    for path in own:
        parent = path.rpartition("/")[0]
        while parent and parent not in own:
            parent = parent.rpartition("/")[0]
        children.setdefault(parent, []).append(path)
    out: dict[str, float] = {}
    for path in sorted(own, key=lambda p: -p.count("/")):
        mine = sum(own[path]) / len(own[path])
        below = children.get(path, [])
        all_ = sum(weight[c] for c in below)
        out[path] = OWN * mine + (1 - OWN) * sum(out[c] * weight[c] for c in below) / all_ if below else mine
    return out


def unimportant(tree: dict[str, float], untold: Iterable[str] = ()) -> list[str]:
    """Highest nodes of ``tree`` that are of low importance with everything below them.

    ``untold`` are nodes above others of which nothing is known, which therefore may be content: they stay.
    """
    held = {p for p, x in tree.items() if x >= UNIMPORTANT} | set(untold)
    for p in list(held):
        while p := p.rpartition("/")[0]:
            held.add(p)
    return sorted(p for p in tree if p not in held and (p.rpartition("/")[0] in held or p.rpartition("/")[0] not in tree))


def _trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        low, common = [], []
        for nodes in batch.column("nodes").to_pylist():
            tree = importances([(n["path"], n["kind"], n["importance"], n["seen"]) for n in nodes if n["value"] is None and n["importance"] is not None])
            low.append(unimportant(tree, [n["path"] for n in nodes if n["importance"] is None]))
            common.append([{"path": n["path"], "value": n["value"]} for n in nodes if n["value"] is not None])
        kind = pa.list_(pa.struct([("path", pa.string()), ("value", pa.int64())]))
        yield pa.RecordBatch.from_arrays([batch.column("host"), pa.array(low, pa.list_(pa.string())), pa.array(common, kind)], ["host", "low", "common"])


def node_statistics(counted: DataFrame) -> DataFrame:
    """(host, path, kind, importance, seen) from (host, path, kind, value, c): blended with all hosts.

    A node that no second page of any host has keeps a null importance.
    """

    def sums(rows: DataFrame, *by: str) -> DataFrame:
        return rows.groupBy(*by).agg(F.sum("c").alias("seen"), F.sum(F.col("c") * F.log("c")).alias("s"))

    told = F.when(F.col("pages") > 1, F.greatest(F.lit(0.0), 1 - F.col("s") / (F.col("seen") * F.log("pages"))))

    values = counted.where("kind <> 'page'")
    pages = counted.where("kind = 'page'").select("host", F.col("c").alias("pages"))
    own = sums(values, "host", "path", "kind").join(pages, "host").select("host", "path", "kind", "seen", "pages", told.alias("mine"))
    # one row of totals, held by the driver
    every = pages.agg(F.coalesce(F.sum("pages"), F.lit(0))).first()[0]
    shared = sums(values.groupBy("path", "kind", "value").agg(F.sum("c").alias("c")), "path", "kind").withColumn("pages", F.lit(every))
    shared = shared.where("seen > 1 AND pages > 1").select("path", "kind", told.alias("theirs"))
    blended = (F.col("pages") * F.coalesce("mine", "theirs") + SHARED * F.col("theirs")) / (F.col("pages") + SHARED)
    return own.join(shared, ["path", "kind"], "left").select("host", "path", "kind", blended.alias("importance"), "seen")


def style_trees(pages: DataFrame) -> DataFrame:
    """(host, low, common): the branches and the texts at a node to remove, for hosts that have any."""
    seen = pages.select(host_column(F.col("url")).alias("host"), "html").mapInArrow(_style_nodes, "host string, page bigint, path string, kind string, value bigint").distinct()
    counted = stored(seen.groupBy("host", "path", "kind", "value").agg(F.count("*").alias("c")), "style-values")
    node = F.struct("path", "kind", "importance", "seen", F.lit(None).cast("long").alias("value"))
    told = stored(node_statistics(counted), "style-nodes")
    tree = told.where("importance IS NOT NULL").select("host", node.alias("node"))
    above = told.where("importance IS NULL").select("host", F.regexp_replace("path", "/[^/]*$", "").alias("path")).distinct()
    untold = above.select("host", F.struct("path", F.lit("untold").alias("kind"), F.lit(None).cast("double").alias("importance"), F.lit(0).cast("long").alias("seen"), F.lit(None).cast("long").alias("value")).alias("node"))
    pages_of = counted.where("kind = 'page'").select("host", F.col("c").alias("pages"))
    often = counted.where("kind = 'text' AND c > 1").join(pages_of, "host").where(f"c >= {SHARE} * (pages + {SHARED})")
    often = often.select("host", F.struct("path", "kind", F.lit(0.0).alias("importance"), F.col("c").alias("seen"), "value").alias("node"))
    hosts = tree.union(often).union(untold).groupBy("host").agg(F.collect_list("node").alias("nodes"))
    return hosts.mapInArrow(_trees, "host string, low array<string>, common array<struct<path:string,value:bigint>>").where("size(low) > 0 OR size(common) > 0")


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, n, causes = [], [], {"tree": [], "prior": []}
        sides = (batch.column(c).to_pylist() for c in ("low", "common"))
        for html, low, common in zip((h.as_py() for h in batch.column("html")), *sides, strict=True):
            often = {(x["path"], x["value"]) for x in common or ()}
            keep, gone = [], {"tree": 0, "prior": 0}
            for block in blocks(html)[0]:
                cause = block.removed(low or [], often)
                if cause:
                    gone[cause] += 1
                else:
                    keep.append(block.kept)
            texts.append(" ".join(keep))
            n.append(len(texts[-1]))
            for cause, count in gone.items():
                causes[cause].append(count)
        yield pa.RecordBatch.from_arrays(
            [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), *(pa.array(x, pa.int64()) for x in (n, causes["tree"], causes["prior"]))],
            ["page_id", "url", "text", "n_chars", "by_tree", "by_prior"],
        )


def main_text(pages: DataFrame) -> DataFrame:
    """One row per page: page_id, url, text, n_chars, by_tree and by_prior (blocks that went, by cause)."""
    trees = stored(style_trees(pages), "style-trees")
    held = F.aggregate("low", F.lit(0), lambda n, p: n + F.length(p)) + F.aggregate("common", F.lit(0), lambda n, x: n + F.length(x["path"]) + 8)
    small = trees.agg(F.coalesce(F.sum(held + F.length("host")), F.lit(0))).first()[0] <= BROADCAST_BYTES
    rows = pages.select("page_id", "url", "html").withColumn("host", host_column(F.col("url"))).join(F.broadcast(trees) if small else trees, "host", "left")
    kind = dict(pages.dtypes)["page_id"]
    made = f"page_id {kind}, url string, text string, n_chars bigint, by_tree bigint, by_prior bigint"
    return rows.select("page_id", "url", "html", "low", "common").mapInArrow(_extracted, made)


def op6_html(spark, sf_dir: str) -> DataFrame:
    return main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))


QUERIES = {"op6_html": op6_html}
ORACLES: dict[str, str] = {}
