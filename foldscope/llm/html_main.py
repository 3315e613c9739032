"""Main text of web pages by consensus of each host's pages.

Every page scores its own containers and votes for the generalised tag-class paths of the best; the votes are
summed per host; each page is then read again through the path its host agreed on.
"""

from __future__ import annotations

import html as references
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldscope.runtime import cut

# HTML's element classes and the words by which pages name their parts.
SILENT = "script style noscript template iframe svg math canvas audio video object map textarea select datalist button title".split()
# Those whose text has no tags, so that only their own end tag or the page's end ends them; those that nest; foreign ones that may close themselves.
RAW, NESTED, FOREIGN = set("script style title textarea".split()), set("object template svg".split()), set("svg math".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
CONTAINER = set("article blockquote body div main section td dd details center".split())
APART_TAGS = set("nav menu aside footer form dialog search fieldset head".split())
APART_ROLES = set("navigation banner contentinfo complementary search alert alertdialog dialog form menu menubar toolbar status".split())
APART_WORDS = set(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promoted promotion promos nav navbar navigation menu menus breadcrumb breadcrumbs pagination pager toolbar header masthead footer foot sidebar side rail "
    "related recommended recommendations widget widgets comment comments commentlist disqus discussion replies reply respond cookie cookies consent notice notices banner alert popup modal overlay gdpr newsletter subscribe signup login paywall share sharing social "
    "copyright legal disclaimer skip hidden".split()
)
MAIN_WORDS = set("article content post entry main story body text".split())
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
LISTS = set("ul ol menu dl table tr tbody thead tfoot select".split())

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|<(?P<silent>" + "|".join(SILENT) + r")(?=[\s/>])(?:\"[^\"]*\"|'[^']*'|[^'\">])*+>"
    r"|<(?P<close>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*+)(?P<attrs>(?:\"[^\"]*\"|'[^']*'|[^'\">])*+)(?:>|\Z)", re.S | re.I
)
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
SPACE = re.compile(r"\s+")
BLOCK_TAG = re.compile(r"</?(?:" + "|".join(sorted(BLOCK - {"option"}, key=len, reverse=True)) + r")(?=[\s/>])", re.I)
# Best containers a page votes for, and the share of its own best score at which a page follows its host.
VOTES, FOLLOW = 3, 0.25


@dataclass
class Node:
    tag: str
    path: str
    parent: int
    apart: bool
    favoured: bool
    text: float = 0.0
    named: bool = False  # apart by its class or id words or as a form, which a wrapper of the page may be as well


@dataclass
class Page:
    nodes: list[Node] = field(default_factory=list)
    blocks: list[tuple[int, str, int, str]] = field(default_factory=list)  # node, text, characters in links, tag


def _step(tag: str, attrs: dict[str, str]) -> str:
    """A path step: the tag and its class names with digits generalised, in alphabetical order."""
    names = sorted({re.sub(r"\d+", "#", c.lower()) for c in attrs.get("class", "").split()})
    return ".".join([tag, *names])


def _apart(tag: str, attrs: dict[str, str], inside_main: bool) -> bool:
    """Whether an element is apart for what it is."""
    if tag in APART_TAGS - {"form"} or (tag == "header" and not inside_main) or "hidden" in attrs or attrs.get("aria-hidden") == "true" or attrs.get("role", "").lower() in APART_ROLES - {"form"}:
        return True
    return bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", attrs.get("style", "")))


def _named_apart(tag: str, attrs: dict[str, str], inside_main: bool) -> bool:
    """Whether an element is a form or is called like a part that is apart."""
    if tag == "form" or attrs.get("role", "").lower() == "form":
        return True
    if tag in ("html", "body", "main", "article", "h1"):
        return False
    words = re.findall(r"[a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", f"{attrs.get('class', '')} {attrs.get('id', '')}").lower())
    if inside_main and tag == "header":
        words = [w for w in words if w != "header"]
    return not APART_WORDS.isdisjoint(words)


def _settle(page: Page) -> None:
    """Passes ``apart`` down the page.

    A named part that holds main, the page's longest article or most of the page's prose (half of it if it is a form or
    is called like the main part too, else four fifths) is a wrapper, not apart. If then no prose is left, names don't
    count at all.
    """
    nodes = page.nodes
    if any(n.named for n in nodes):
        prose, total = [0] * len(nodes), 0
        for at, text, linked, _ in page.blocks:
            up, size = at, len(text) if 2 * linked < len(text) else 0
            while up >= 0 and not nodes[up].apart:
                up = nodes[up].parent
            if up < 0:
                total += size
                while at >= 0:
                    prose[at] += size
                    at = nodes[at].parent
        articles = [k for k, n in enumerate(nodes) if n.tag == "article" and prose[k]]
        longest = max(articles, key=lambda k: prose[k], default=0)
        keep = {k for k, n in enumerate(nodes) if n.tag == "main" and prose[k]} | ({longest} if 4 * prose[longest] >= total else set()) - {0}
        wrappers = set()
        for k in keep:
            while k >= 0:
                wrappers.add(k)
                k = nodes[k].parent
        for k, n in enumerate(nodes):
            if n.named and (k in wrappers or total and not keep and prose[k] >= (0.5 if n.favoured or n.tag == "form" else 0.8) * total):
                n.named = False
    strong = [n.apart for n in nodes]
    for names in (True, False):
        for n, own in zip(nodes, strong, strict=True):
            n.apart = own or names and n.named or n.parent >= 0 and nodes[n.parent].apart
        if any(not nodes[at].apart and 2 * linked < len(text) for at, text, linked, _ in page.blocks):
            break


def _silent_end(source: str, at: int, tag: str, parent: str) -> int:
    """Where a silent element that starts before ``at`` ends: after its end tag, or where that is missing before the
    parent's end or the next element of its kind, at the next block."""
    if tag in RAW:
        end = re.compile(rf"</{tag}\s*[^>]*>", re.I).search(source, at)
        return end.end() if end else len(source)
    open_here = {tag: 1, parent: 1}
    for m in re.compile(rf"<(/?)({tag}|{re.escape(parent)})(?=[\s/>])[^>]*>", re.I).finditer(source, at):
        name = m[2].lower()
        if name == tag and not m[1] and tag not in NESTED:
            break
        if not (name in FOREIGN and m[0].endswith("/>")):
            open_here[name] += -1 if m[1] else 1
        if not open_here[tag]:
            return m.end()
        if not open_here[parent]:
            break
    else:
        m = None
    block = BLOCK_TAG.search(source, at)
    return min(m.start() if m else len(source), block.start() if block else len(source))


def parse(source: str) -> Page:
    """Blocks of text in page order, each with its innermost container; unclosed tags are closed where HTML closes them."""
    page = Page([Node("#", "", -1, False, False)])
    nodes, open_at = page.nodes, [(0, "#")]  # node of each open element and its tag; inline elements aren't kept
    text: list[str] = []
    linked, links, at = 0, 0, 0

    def flush() -> None:
        nonlocal text, linked
        if text:
            block = SPACE.sub(" ", references.unescape("".join(text))).strip()
            if block:
                page.blocks.append((open_at[-1][0], block, linked, open_at[-1][1]))
            text, linked = [], 0

    def close(upto: int) -> None:
        del open_at[upto:]

    while True:
        m = TOKEN.search(source, at)
        piece = source[at : m.start() if m else len(source)]
        if piece:
            text.append(piece)
            linked += len(piece.strip()) if links else 0
        if not m:
            break
        at = m.end()
        if m["silent"]:
            silent = m["silent"].lower()
            if not (silent in FOREIGN and m[0].endswith("/>")):
                at = _silent_end(source, at, silent, open_at[-1][1])
            continue
        if not m["tag"]:
            continue
        tag, closing = m["tag"].lower(), m["close"]
        if tag == "br":
            text.append(" ")
        elif tag == "a":
            links = max(0, links + (-1 if closing else 1))
        if tag not in BLOCK:
            continue
        flush()
        links = 0 if tag != "a" else links
        if closing:
            for k in range(len(open_at) - 1, 0, -1):
                if open_at[k][1] == tag:
                    close(k)
                    break
            continue
        ends = CLOSES.get(tag, {"p"})
        for k in range(len(open_at) - 1, 0, -1):
            if open_at[k][1] in ends:
                close(k)
                break
            if open_at[k][1] in CONTAINER or open_at[k][1] in LISTS and tag not in ("tr",):
                break
        if tag in VOID:
            continue
        attrs = {k.lower(): v.strip("\"'") for k, v in ATTRIBUTE.findall(m["attrs"])} if m["attrs"].strip() else {}
        up = nodes[open_at[-1][0]]
        inside = any(t in ("article", "main") for _, t in open_at)
        words = re.findall(r"[a-z]+", f"{attrs.get('class', '')} {attrs.get('id', '')}".lower())
        favoured = tag in ("article", "main") or attrs.get("role") in ("main", "article") or not MAIN_WORDS.isdisjoint(words)
        nodes.append(Node(tag, f"{up.path}>{_step(tag, attrs)}" if up.path else _step(tag, attrs), open_at[-1][0], _apart(tag, attrs, inside), favoured, named=_named_apart(tag, attrs, inside)))
        open_at.append((len(nodes) - 1, tag))
    flush()
    _settle(page)
    return page


def scores(page: Page) -> list[tuple[float, int]]:
    """(score, node) of the containers, best first: characters of prose blocks less those of link lists.

    An article, or a container named like one, counts all that it holds half as much again. A plain container
    counts its own blocks whole and those of inner ones half as much for each step down, so that a wrapper only
    beats its parts where the text is spread over several. Of equal ones the inner is better.
    """
    nodes = page.nodes
    for at, text, linked, _ in page.blocks:
        if nodes[at].apart:
            continue
        size, share = float(len(text) if 2 * linked < len(text) else -len(text)), 1.0
        while at >= 0:
            node = nodes[at]
            node.text += 1.5 * size if node.favoured else share * size
            if node.tag in CONTAINER:
                share /= 2
            at = node.parent
    found = [(n.text, k) for k, n in enumerate(nodes) if n.tag in CONTAINER and not n.apart and n.text > 0]
    return sorted(found, key=lambda x: (-x[0], -x[1]))


def parts_of(page: Page, node: int) -> set[int]:
    """``node`` with the containers that hold the rest of its text: all of its path, and where it is plain or named
    like the main part, its neighbours of that sort and those of its ancestors."""
    nodes = page.nodes
    good = [n.tag in CONTAINER and not n.apart and n.text > 0 for n in nodes]
    parts = {k for k, n in enumerate(nodes) if good[k] and n.path == nodes[node].path}
    at = node
    while at > 0 and nodes[at].tag not in ("article", "main", "body") and (nodes[at].favoured or _plain(nodes[at])):
        parts |= {k for k, n in enumerate(nodes) if good[k] and n.parent == nodes[at].parent and (n.favoured or _plain(n))}
        at = nodes[at].parent
    return parts


def _plain(node: Node) -> bool:
    """Whether a container has no class names."""
    return node.path.rpartition(">")[2] == node.tag


def text_of(page: Page, wanted: int | set[int]) -> str:
    """Blocks under ``wanted`` (a node or several) outside menus, notices and the like, joined by an empty line."""
    nodes, out, held = page.nodes, [], []
    wanted = {wanted} if isinstance(wanted, int) else wanted
    for k, n in enumerate(nodes):  # parents come before their children
        held.append(k in wanted or n.parent >= 0 and held[n.parent])
    for at, text, _, _ in page.blocks:
        if held[at] and not nodes[at].apart:
            out.append(text)
    return "\n\n".join(out)


def extract(source: str | None, agreed: str | None = None) -> str:
    """The page's main text through the agreed path, or through its own best container where that path holds
    less than a quarter of it. Empty and NULL pages give ''."""
    page = parse(source or "")
    ranked = scores(page)
    if not ranked:
        return text_of(page, 0)
    best = ranked[0]
    for score, k in ranked:
        if page.nodes[k].path == agreed and score >= FOLLOW * best[0]:
            best = (score, k)
            break
    return text_of(page, parts_of(page, best[1]))


def host_of(url) -> F.Column:
    """Lowercase host of a URL without user, port and path; '' for NULL and for what isn't a URL."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def votes(pages: DataFrame) -> DataFrame:
    """host, path, vote: a page gives its best containers the share that they have of the best score."""

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for host, source in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                page = parse(source or "")
                ranked = scores(page)[:VOTES]
                rows += [(host, page.nodes[k].path, s / ranked[0][0]) for s, k in ranked]
            kinds = (pa.string(), pa.string(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["host", "path", "vote"])

    return pages.select(host_of(F.col("url")).alias("host"), "html").mapInArrow(vote, "host string, path string, vote double")


def consensus(pages: DataFrame) -> DataFrame:
    """host, agreed: the path with most votes on each host, ties to the longer and then the later path."""
    tally = votes(pages).groupBy("host", "path").agg(F.round(F.sum("vote"), 6).alias("vote"))
    return tally.groupBy("host").agg(F.max_by("path", F.struct("vote", F.length("path").alias("n"), "path")).alias("agreed"))


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row of ``pages`` (page_id, url, html).

    NULL or empty html gives ''; pages without a usable URL form one host; repeated rows are pages of their own;
    other columns are ignored. The table of hosts has one short row each; Spark broadcasts it where its written
    size allows and otherwise joins by host, splitting large hosts.
    """
    agreed = cut(consensus(pages))
    rows = pages.select("page_id", "url", "html", host_of(F.col("url")).alias("host")).join(agreed, "host", "left")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(h, a) for h, a in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return rows.select("page_id", "url", "html", "agreed").mapInArrow(read, "page_id long, url string, text string, n_chars long")
