"""Main text of web pages by a site style tree.

The pages of a host are merged into one tree: elements with the same path of tags, classes and ids share a node. A node's
content matters as far as its features (words of short texts, long texts whole, link and image targets) differ between
pages, its presentation as far as the sequence of its children does; both are entropies. A branch in which nothing
matters is the site's furniture and goes from every page, and so does a text that most of a host's articles carry.

What an element says of itself weighs in as a prior: menus, asides, forms, scripts and the like matter nothing, and what
stands in an article or main element matters unless it is named otherwise or the tree says so.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from hashlib import blake2b
from html import unescape
from zlib import crc32

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ascii_lower, cut, drop, pieces, python_ready, whole_text

#: A branch whose greatest importance is below goes.
LEAST = 0.6
#: How fast the presentation of a node comes to count as its styles grow in number.
DECAY = 0.9
#: Distinct articles that a host needs before its tree is judged, and pages that a node needs.
LEAST_PAGES = 3
#: A node on fewer than one in so many pages of its host is not judged: so a host's list of nodes is bounded by its pages' size.
RAREST = 1000
#: Share of a host's articles with a text from which it counts as furniture.
COMMON = 0.5
#: Texts of up to so many words are told apart by their words.
SHORT = 30

# How HTML's elements behave.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea iframe noembed noframes xmp".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol "
    "p pre search section summary table tbody td tfoot th thead tr ul".split()
)
CLOSES_P = BLOCK - frozenset("body caption head html legend tbody td tfoot th thead tr".split())
IN_HEAD = frozenset("base head html link meta noscript script style template title".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
SIBLINGS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dd": ({"dd", "dt"}, {"dl"}), "dt": ({"dd", "dt"}, {"dl"}), "option": ({"option"}, {"select", "datalist"}), "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}), "tr": ({"tr"}, {"table"}), "tbody": ({"tbody", "thead", "tfoot"}, {"table"}), "thead": ({"tbody", "thead", "tfoot"}, {"table"}), "tfoot": ({"tbody", "thead", "tfoot"}, {"table"}),
}
SCOPE = frozenset("td th table caption html template".split())
P_SCOPE = SCOPE | {"button"}

# What elements, roles and names say of themselves.
FURNITURE = frozenset("aside audio button canvas datalist dialog embed fieldset footer head iframe input label menu nav noembed noframes noscript object script search select style svg template textarea title video xmp".split())
FURNITURE_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar tooltip".split())
APART = frozenset(
    "ad ads adbox adsbygoogle adsense adslot adunit adv advert adverts advertisement advertising banner bannerad sponsor sponsored sponsors promo promos promoted promotion outbrain taboola teaser teasers "
    "comment comments commentlist commentary disqus discussion respond reply replies related recommended recommendations recirc trending readers".split()
)
NAMED = frozenset(
    "alert breadcrumb breadcrumbs consent cookie cookies copyright crumbs disclaimer follow foot footer form gdpr infobar legal login masthead menu menus modal nav navbar navi navigation newsletter notice notices notification "
    "overlay pager paging pagination popular popup privacy rail search searchbox share sharing sharebar shares sidebar sidebars sidenav signin signup skip skiplink social subscribe subscription tagcloud toolbar topbar topnav widget widgets".split()
)
NAMED_WEAKLY = frozenset("header head side top tools".split())
CONTENT = frozenset("article articlebody blogpost body content entry main maincontent post story text".split())
AFTER = frozenset("has no with without show hide".split())

_TAG = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)|</(?:>|[^a-zA-Z>][^>]*+(?:>|\Z))"
    r"|<(/?+)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+)(?:>|\Z)",
    re.S,
)
_ATTRIBUTE = re.compile(r"([^\s=>\"'/]++)(?:\s*+=\s*+(\"[^\"]*+\"|'[^']*+'|[^\s>]++))?+")
_NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_DIGITS = re.compile(r"\d{3,}")
_END_SCOPE = {t: frozenset({"table"}) for t in ("tr", "tbody", "thead", "tfoot", "td", "th", "caption")} | {"table": frozenset(), "body": frozenset(), "html": frozenset()}
_RAW_END = {t: re.compile(rf"</{t}(?=[\s/>]|\Z)", re.I) for t in RAW}

FURNISHES, IS_MAIN, IS_CONTENT, STANDS_APART, IS_FORM = 1, 2, 4, 8, 16
_known: dict[tuple[str, str], tuple[str, int]] = {}
_keys: dict[tuple[int, str], int] = {}


def digest(s: str) -> int:
    return int.from_bytes(blake2b(s.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def attributes(raw: str) -> dict[str, str]:
    found: dict[str, str] = {}
    for name, value in _ATTRIBUTE.findall(raw):
        found.setdefault(name.lower(), unescape(value.strip("\"'")) if value else "")
    return found


def describe(tag: str, raw: str) -> tuple[str, int]:
    """An element's label in the tree, and what it says of itself."""
    known = _known.get((tag, raw))
    if known:
        return known
    own = attributes(raw)
    names = f"{own.get('class', '')} {own.get('id', '')}".split()
    parts = [[p.lower() for p in _NAME_PART.findall(n)] for n in [*names, *([tag] if "-" in tag else [])]]
    parts = [[p for i, p in enumerate(ps) if not i or ps[i - 1] not in AFTER] for ps in parts]
    words = {p for ps in parts for p in [*ps, "".join(ps)]}
    role, flags = own.get("role", "").lower(), 0
    if tag in ("article", "main") or role in ("main", "article") or own.get("itemprop", "").lower() == "articlebody":
        flags |= IS_MAIN
    if tag == "form" or role == "form":
        flags |= IS_FORM
    if words & CONTENT:
        flags |= IS_CONTENT
    if tag in FURNITURE or role in FURNITURE_ROLES:
        flags |= FURNISHES | STANDS_APART
    elif words & APART and tag not in ("html", "body"):
        flags |= FURNISHES | STANDS_APART
    elif tag not in ("html", "body", "article", "main") and (words & NAMED or words & NAMED_WEAKLY and not words & CONTENT and not flags & IS_MAIN):
        flags |= FURNISHES
    label = ".".join([tag, *sorted({_DIGITS.sub("0", n) for n in names}), *([f"@{role}"] if role else [])])
    if len(_known) > 50_000:
        _known.clear()
    _known[tag, raw] = label, flags
    return label, flags


class Page:
    """Elements of a page that are nodes of the tree, in document order, and its runs of inline text."""

    __slots__ = ("tag", "label", "flags", "parent", "runs", "targets", "children")

    def __init__(self, html: str):
        self.tag, self.label, self.flags, self.parent = ["#"], ["#"], [0], [-1]
        self.runs: list[list[tuple[str, int, bool]]] = []
        self.targets: list[tuple[int, str]] = []
        self.children: list[dict[str, int]] = [{}]
        self._parse(html)

    def _node(self, tag: str, raw: str, parent: int) -> int:
        label, flags = describe(tag, raw) if raw else describe(tag, "")
        if label in ("div", "section", "table", "td", "ul", "ol"):  # without a name, the place tells elements apart
            nth = self.children[parent].get(label, 0)
            self.children[parent][label] = nth + 1
            label = f"{label}:{nth}"
        self.tag.append(tag)
        self.label.append(label)
        self.flags.append(flags)
        self.parent.append(parent)
        self.children.append({})
        return len(self.tag) - 1

    def _parse(self, html: str) -> None:
        stack: list[tuple[str, int]] = [("#", 0)]
        opened: dict[str, int] = {}
        run: list[tuple[str, int, bool]] = []
        node, at, end, search = 0, 0, len(html), _TAG.search

        def pop(to: int) -> None:
            nonlocal node
            for t, _ in stack[to:]:
                opened[t] -= 1
            del stack[to:]
            node = stack[-1][1]

        def close(names: set[str] | frozenset[str], scope: set[str] | frozenset[str]) -> bool:
            """Closes the innermost open element of these names, unless one of ``scope`` lies between; tells whether a block went."""
            if not any(opened.get(n) for n in names):
                return False
            for i in range(len(stack) - 1, 0, -1):
                t = stack[i][0]
                if t in names:
                    block = any(x in BLOCK for x, _ in stack[i:])
                    pop(i)
                    return block
                if t in scope:
                    return False
            return False

        def flush() -> None:
            nonlocal run
            if run:
                self.runs.append(run)
                run = []

        while at < end:
            m = search(html, at)
            stop = m.start() if m else end
            if stop > at:
                text = html[at:stop]
                if "&" in text:
                    text = unescape(text)
                if run or not text.isspace():
                    if opened.get("head"):
                        close({"head"}, frozenset())
                    run.append((text, node, bool(opened.get("a"))))
            if not m:
                break
            at, tag = m.end(), m[2]
            if tag is None:
                continue
            tag = tag.lower()
            if m[1]:
                if stack[-1][0] == tag:
                    stack.pop()
                    opened[tag] -= 1
                    node = stack[-1][1]
                    if tag in BLOCK:
                        flush()
                elif tag not in BLOCK:
                    if opened.get(tag):
                        close({tag}, BLOCK)
                elif close({tag}, _END_SCOPE.get(tag, SCOPE)) or tag == "p":
                    flush()
                continue
            if opened.get("head") and tag not in IN_HEAD:
                close({"head"}, frozenset())
                flush()
            if tag in ("html", "body") and opened.get(tag):
                continue
            if tag in BLOCK:
                flush()
            if tag in CLOSES_P and opened.get("p"):
                close({"p"}, P_SCOPE)
            if tag in SIBLINGS:
                close(*SIBLINGS[tag])
            elif tag in HEADINGS and stack[-1][0] in HEADINGS:
                pop(len(stack) - 1)
            elif tag == "a" and opened.get("a"):
                close({"a"}, BLOCK)
            raw = m[3].strip(" /\n\t\r\f")
            if tag == "br":
                run.append((" ", node, False))
                continue
            if tag in RAW:
                over = _RAW_END[tag].search(html, at)
                at = over.start() if over else end  # its end tag isn't open and goes unheeded
                continue
            if tag in ("a", "img"):
                own = attributes(raw) if raw else {}
                if target := own.get("href") or own.get("src"):
                    self.targets.append((node, target))
                raw = f'class="{own["class"]}"' if own.get("class") else ""
            if tag in VOID:
                continue
            if tag in BLOCK or tag in FURNITURE or raw or "-" in tag:
                node = self._node(tag, raw, node)
            stack.append((tag, node))
            opened[tag] = opened.get(tag, 0) + 1
        flush()

    def own_words(self) -> tuple[list[bool], list[int]]:
        """For every node whether what it, or an element around it, says of itself takes it out; and the main elements that stay."""
        n, parent, flags = len(self.tag), self.parent, self.flags
        apart, holds, titled, mains = [False] * n, [False] * n, [False] * n, []
        for i in range(1, n):
            apart[i] = apart[parent[i]] or bool(flags[i] & STANDS_APART)
            if flags[i] & IS_MAIN and not apart[i]:
                mains.append(i)
        for i in mains:
            while i > 0 and not holds[i]:
                holds[i] = True
                i = parent[i]
        for i in range(n - 1, 0, -1):
            titled[i] |= self.tag[i] == "h1"
            titled[parent[i]] |= titled[i]
        gone, within = [False] * n, [False] * n
        for i in range(1, n):
            f, p = flags[i], parent[i]
            within[i] = within[p] or bool(f & IS_MAIN)
            named = f & FURNISHES or f & IS_FORM and not titled[i] or self.tag[i] == "header" and not within[p]
            gone[i] = gone[p] or apart[i] or bool(named) and not holds[i]
        return gone, [i for i in mains if not gone[i]]

    def sizes(self, gone: list[bool]) -> tuple[list[int], list[int], list[int]]:
        """Of every node's branch: characters that stay, those of them in links, and links."""
        n = len(self.tag)
        chars, linked, links = [0] * n, [0] * n, [0] * n
        for run in self.runs:
            for text, i, link in run:
                if not gone[i]:
                    chars[i] += len(text)
                    if link:
                        linked[i] += len(text)
                        links[i] += 1
        for i in range(n - 1, 0, -1):
            p = self.parent[i]
            chars[p] += chars[i]
            linked[p] += linked[i]
            links[p] += links[i]
        return chars, linked, links

    def settle(self) -> tuple[list[bool], list[bool], bool]:
        """Nodes that are gone with all that is in them, nodes of the main part, and whether the page marks one.

        It is marked by articles, if they hold half of what main elements do, else by those, else by the outermost element that
        is named as content and holds half of the text. Without a mark all is the main part, but lists of links go.
        """
        gone, mains = self.own_words()
        n, parent = len(self.tag), self.parent
        chars, linked, links = self.sizes(gone)
        if mains:
            top = lambda some: sum(chars[i] for i in some if not any(j in some for j in self.above(i)))
            articles = {i for i in mains if self.tag[i] == "article"}
            chosen = articles if articles and 2 * top(articles) >= top(set(mains)) else set(mains)
        else:
            named = (i for i in range(1, n) if self.flags[i] & IS_CONTENT and not gone[i] and self.tag[i] not in ("html", "body") and 2 * chars[i] >= chars[0] > 0)
            chosen = set(list(named)[:1])
        inside = [not chosen] * n
        for i in range(1, n):
            inside[i] = inside[parent[i]] or i in chosen
            if not chosen:
                gone[i] = gone[i] or gone[parent[i]] or links[i] >= 3 and 10 * linked[i] >= 7 * chars[i] and self.tag[i] not in ("html", "body")
        return gone, inside, bool(chosen)

    def above(self, i: int) -> Iterator[int]:
        while (i := self.parent[i]) > 0:
            yield i

    def keys(self, host: str) -> list[int]:
        """Every node's key in the tree of ``host``."""
        found = [digest(host)]
        for i in range(1, len(self.tag)):
            pair = found[self.parent[i]], self.label[i]
            key = _keys.get(pair)
            if key is None:
                if len(_keys) > 300_000:
                    _keys.clear()
                key = _keys[pair] = digest(f"{pair[0]} {pair[1]}")
            found.append(key)
        return found

    def texts(self, gone: list[bool], inside: list[bool]) -> Iterator[tuple[str, int]]:
        """Each run's text that stays, blanks made single, with the node where it starts; runs without text are left out."""
        for run in self.runs:
            stay = [(x, i) for x, i, _ in run if inside[i] and not gone[i]]
            text = " ".join("".join([x for x, _ in stay]).split())
            if text:
                yield text, stay[0][1]


def page_features(page: Page, host: str) -> tuple[dict[int, tuple[list[int], int]], dict[tuple[int, int], int], set[int], int]:
    """What a page adds to its host's tree: nodes with what is above them and their style, counts of features, digests of texts and of the longest one."""
    gone, inside, _ = page.settle()
    keys, parent = page.keys(host), page.parent
    styles: dict[int, list[str]] = {}
    above: dict[int, list[int]] = {}
    for i in range(1, len(keys)):
        if gone[i]:
            continue
        of = styles.setdefault(keys[parent[i]], [])
        if not of or of[-1] != page.label[i]:  # however long a list is, its style is one
            of.append(page.label[i])
        if keys[i] not in above:
            above[keys[i]] = [*above.get(keys[parent[i]], ()), keys[i]]
    counts: dict[tuple[int, int], int] = {}
    seen, longest = set(), ""
    for text, i in page.texts(gone, inside):
        seen.add(digest(text))
        if len(text) > len(longest):
            longest = text
        words = text.split(" ")
        for w in words if len(words) <= SHORT else (text,):
            at = keys[i], crc32(w.encode("utf-8", "surrogatepass"))
            counts[at] = counts.get(at, 0) + 1
    for i, target in page.targets:
        if keys[i] in above:
            at = keys[i], crc32(b"\n" + target.encode("utf-8", "surrogatepass"))
            counts[at] = counts.get(at, 0) + 1
    nodes = {k: (a, crc32("|".join(styles.get(k, ())).encode())) for k, a in above.items()}
    return nodes, counts, seen, digest(longest)


def main_text(html: str, low: frozenset[int] = frozenset(), common: frozenset[int] = frozenset(), host: str = "") -> str:
    """The main text of a page, without the branches ``low`` and the texts ``common`` of its host.

    In a marked main part only elements with a name can be furniture, and a text can be common if its element has one or is a
    plain paragraph; headings, cells and the like that recur are text. A page all of whose text is common keeps it.
    """
    if not html:
        return ""
    page = Page(html)
    gone, inside, marked = page.settle()
    if low:
        keys = page.keys(host)
        for i in range(1, len(keys)):
            gone[i] = gone[i] or gone[page.parent[i]] or keys[i] in low and (not marked or inside[i] and "." in page.label[i])
    found = list(page.texts(gone, inside))
    if common:
        left = [t for t, i in found if digest(t) not in common or marked and page.tag[i] not in ("p", "div") and "." not in page.label[i]]
        found = [(t, 0) for t in left] or found
    return "\n".join(t for t, _ in found)


def host_of(url: Column) -> Column:
    """Between the first ``://`` and the next ``/``, ``?`` or ``#``, A-Z in lower case; empty without ``://``."""
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


_ROWS = T.StructType(
    [T.StructField("kind", T.IntegerType()), T.StructField("host", T.StringType()), T.StructField("node", T.LongType()), T.StructField("above", T.ArrayType(T.LongType()))]
    + [T.StructField("item", T.LongType()), T.StructField("n", T.LongType()), T.StructField("logs", T.DoubleType())]
)
STYLE, FEATURE, TEXT, PAGE = range(4)


def statistics(pages: DataFrame) -> DataFrame:
    """Rows that add up to the trees: styles of nodes, features of nodes, texts of articles, pages.

    ``pages`` has ``host`` and ``whole``. A task adds up its own pages before it gives rows, a bounded number at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nodes: dict[tuple[str, int, int], list] = {}
        features: dict[tuple[int, int], list] = {}
        texts: set[tuple[str, int, int]] = set()
        sites: dict[str, int] = {}
        kinds = (pa.int32(), pa.string(), pa.int64(), pa.list_(pa.int64()), pa.int64(), pa.int64(), pa.float64())

        def rows() -> pa.RecordBatch:
            made = [(STYLE, h, k, a, s, n, None) for (h, k, s), (a, n) in nodes.items()]
            made += [(FEATURE, None, k, None, f, n, x) for (k, f), (n, x) in features.items()]
            made += [(TEXT, h, d, None, a, 1, None) for h, d, a in texts]
            made += [(PAGE, h, None, None, None, n, None) for h, n in sites.items()]
            for kept in (nodes, features, texts, sites):
                kept.clear()
            columns = zip(*made, strict=True) if made else [()] * len(kinds)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=_ROWS.fieldNames())

        for batch in batches:
            for some in pieces(batch, "whole"):
                for host, html in zip(some.column(0).to_pylist(), some.column(1).to_pylist(), strict=True):
                    sites[host] = sites.get(host, 0) + 1
                    found, counts, seen, longest = page_features(Page(html), host)
                    for k, (a, style) in found.items():
                        nodes.setdefault((host, k, style), [a, 0])[1] += 1
                    for at, n in counts.items():
                        own = features.setdefault(at, [0, 0.0])
                        own[0] += n
                        own[1] += n * math.log(n)
                    texts.update((host, d, longest) for d in seen)
                if len(features) + len(nodes) + len(texts) > 100_000:
                    yield rows()
        yield rows()

    return pages.where("host <> '' and whole <> ''").select("host", "whole").mapInArrow(run, _ROWS)


def furniture(rows: DataFrame) -> DataFrame:
    """``host``, ``low`` (keys of its branches of low importance) and ``common`` (digests of texts that most of its articles carry).

    ``rows`` is what ``statistics`` gives, written. Pages with the same longest text count as one article, so copies make
    nothing common. Both lists are bounded by the size of a page: a branch has to be on a page in ``RAREST``, a text on
    half of a host's articles.
    """
    log = lambda c: F.log(F.col(c).cast("double"))
    styles = rows.where(f"kind = {STYLE}").groupBy("host", "node", "item").agg(F.sum("n").alias("n"), F.first("above").alias("above"))
    nodes = styles.groupBy("host", "node").agg(F.sum("n").alias("m"), F.sum(F.col("n") * log("n")).alias("s"), F.count(F.lit(1)).alias("styles"), F.first("above").alias("above"))
    each = rows.where(f"kind = {FEATURE}").groupBy("node", "item").agg(F.sum("n").alias("n"), F.sum("logs").alias("logs"))
    contents = each.groupBy("node").agg(F.avg(log("n") - F.col("logs") / F.col("n")).alias("entropy"))
    presentation = (1 - F.pow(F.lit(DECAY), F.col("styles") - 1)) * (log("m") - F.col("s") / F.col("m")) / log("m")
    content = F.coalesce(1 - F.col("entropy") / log("m"), F.lit(0.0))
    own = nodes.join(contents, "node", "left").select("host", "node", "m", "above", F.when(F.col("m") < LEAST_PAGES, 1.0).otherwise(F.greatest(presentation, content)).alias("importance"))
    branches = own.select("host", F.explode("above").alias("branch"), "importance", "node", "m").groupBy("host", "branch").agg(
        F.max("importance").alias("importance"), F.max(F.when(F.col("branch") == F.col("node"), F.col("m"))).alias("m")
    )
    texts = rows.where(f"kind = {TEXT}").select("host", F.col("node").alias("text"), F.col("item").alias("article")).distinct()
    articles = texts.groupBy("host").agg(F.countDistinct("article").alias("articles"))
    sites = rows.where(f"kind = {PAGE}").groupBy("host").agg(F.sum("n").alias("pages")).join(articles, "host").where(F.col("articles") >= LEAST_PAGES)
    low = branches.where(F.col("importance") < LEAST).join(sites, "host").where(F.col("m") * RAREST >= F.col("pages"))
    shared = texts.groupBy("host", "text").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= LEAST_PAGES)
    shared = shared.join(sites, "host").where(F.col("n") >= F.lit(COMMON) * F.col("articles"))
    low = low.groupBy("host").agg(F.collect_set("branch").alias("low"))
    return low.join(shared.groupBy("host").agg(F.collect_set("text").alias("common")), "host", "full")


def extract(pages: DataFrame, html: str = "html", url: str = "url") -> DataFrame:
    """``pages`` without the page itself, with ``text`` and ``n_chars``; what ``pages`` has under these names gives way.

    Null and empty pages have an empty text, and so have pages that hold no main text. Pages without a host are not merged
    and are judged by themselves, as are hosts of fewer than three different articles. Copies, repeated rows and rows of
    one ``page_id`` each keep their row; nothing of a text is cut off; an empty table gives none. Which join brings a host's
    lists to its pages is Spark's choice by their written size; a hot host's pages can be split then.
    """
    pages = pages.drop("text", "n_chars")
    python_ready(pages.sparkSession)
    own = [c for c in pages.columns if c != html]
    ready = pages.select(F.struct(*[F.col(f"`{c}`") for c in own]).alias("row"), host_of(F.col(url)).alias("host"), whole_text(html).alias("whole"))
    rows = cut(statistics(ready), "site-rows")
    sites = cut(furniture(rows), "sites")
    drop(rows)
    joined = ready.join(sites, "host", "left").select("row", "host", "whole", "low", "common")
    schema = T.StructType([joined.schema["row"], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets: dict[str, tuple[frozenset, frozenset]] = {}
        for batch in batches:
            for some in pieces(batch, "whole"):
                made = []
                for i, (host, html) in enumerate(zip(some.column(1).to_pylist(), some.column(2).to_pylist(), strict=True)):
                    if host not in sets:
                        if len(sets) > 1000:
                            sets.clear()
                        sets[host] = frozenset(some.column(3)[i].as_py() or ()), frozenset(some.column(4)[i].as_py() or ())
                    made.append(main_text(html, *sets[host], host))
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(made, pa.string()), pa.array([len(x) for x in made], pa.int64())], names=["row", "text", "n_chars"])

    return joined.mapInArrow(run, schema).select("row.*", "text", "n_chars")
