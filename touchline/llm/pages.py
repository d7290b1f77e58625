"""Main text of web pages by site style trees.

The pages of a host are merged into one tree of style nodes: the path of tags, classes and ids that leads to a block of text.
All blocks of all pages are in it, whatever their names. A block's content importance is one minus the entropy of its appearances
over the host's pages, in logarithms of their number: 1 for what one page alone shows, 0 for what all pages show alike. A style
node's presentation importance is the entropy of the styles of its children over the pages that have it: 0 where all pages lay it
out alike. Both make up a block's importance (Yi, Liu and Li, 2003, whose weight of a level is ``DECAY``). Blocks of low importance
are noise and go from each page, and so does what recurs in a branch that pages fill alike; what one page alone shows stays.

Names decide on what the tree leaves. Elements and roles (nav, footer, aside ...) and hidden parts are believed. A class or id, or
a form, is not believed where it holds over half of the text that the tree leaves to the page (a wrapper named ``no-sidebar`` or
``legal`` is the page), and one that names comments only where it holds all of it. Where a page marks its article or main part, only
that counts. Two bounds keep a page from being taken for noise: a marked article that would lose over half of its text to
the tree keeps it, and so does any page whose text would go by half to blocks that no more than half of the host's pages show: it is
one of a group of copies. What over half of a host's pages show goes from an unmarked page however long it is.

Blocks and layouts are counted once per distinct page, told by the digest of all its blocks; counts are aggregated by host, node
and content before anything meets, so that a host with a third of all pages is no single task's work. Up to a million noise blocks of
all hosts go to the workers as sorted numbers, and pages then stay where they lie; beyond that, the blocks of each page meet the noise
through a shuffle, so that a page never carries more noise than it shows.

Nulls: a null or empty html gives the empty text; a null url is a host of its own name (empty). Repeated rows count as one
page. Whole pages are read.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.llm.common import bounded, checkpointed, read, tidy

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)(?:>|\Z)""", re.S)
ATTRIBUTE = re.compile(r"""(class|id|role|hidden|aria-hidden|aria-label|itemprop)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
#: Fixed values of HTML: elements without content, elements whose content is not markup, and elements that flow in a line.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title xmp iframe noembed noframes noscript template svg math canvas object audio video select datalist button".split())
INLINE = set("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: Which open elements a start tag closes.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
BOUNDS = set("ul ol dl table article section div main body aside nav header footer form blockquote td th".split())
#: Names of elements, roles, and words of classes and ids that mark what is not the article.
NOISE_TAGS = set("nav header footer aside form menu dialog fieldset head".split())
NOISE_ROLES = set("navigation banner contentinfo complementary search form menu menubar dialog alert alertdialog toolbar".split())
NOISE_WORDS = set(
    "nav navbar navigation menu submenu header masthead footer sidebar aside widget widgets ad ads advert adverts advertisement "
    "advertising adsense sponsor sponsored sponsors promo promos promotion banner cookie cookies consent gdpr notice notices "
    "alert popup modal overlay newsletter subscribe subscription signup login form comment comments commentlist discussion "
    "disqus replies reply respond share sharing social breadcrumb breadcrumbs related recommended recommendations pagination pager "
    "toolbar topbar legal copyright disclaimer tags tagcloud skip".split()
)
#: Words that name user text, words that as a whole class or id name the article, and words after which a name tells of the layout.
COMMENT_WORDS = set("comment comments commentlist discussion disqus replies reply respond".split())
ARTICLE_WORDS = set("article post entry content main story".split())
LAYOUT_WORDS = set("no has with without".split())
WORD = re.compile(r"[A-Za-z][a-z]*|[A-Z]+")
#: A block is noise if its importance is below the bound and at least LEAST_PAGES distinct pages show it.
IMPORTANCE, LEAST_PAGES = 0.5, 4
#: Weight of content against presentation in a block's importance.
DECAY = 0.9
#: Noise blocks of all hosts, of eight bytes each, up to which they go to all workers.
BROADCAST_BLOCKS = 1_000_000


class Block:
    """A run of text in page order: its style path, whether it lies in a noise element or in the article, its link share, and the
    doubtful names (numbers of elements) that it lies under."""

    __slots__ = ("article", "linked", "names", "noise", "path", "text")

    def __init__(self, path: str, text: str, noise: bool, article: bool, linked: float, names: tuple[int, ...] = ()) -> None:
        self.path, self.text, self.noise, self.article, self.linked, self.names = path, text, noise, article, linked, names

    def key(self, site: str) -> int:
        return digest(f"{site}\n{self.path}\n{self.text}")


def digest(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def doubtful(value: str) -> str:
    """What a class or id names: ``comment``, ``noise`` or nothing."""
    kind = ""
    for token in value.split():
        words = [w.lower() for w in WORD.findall(token)]
        if len(words) == 1 and words[0] in ARTICLE_WORDS:
            return ""
        for before, w in zip(["", *words], words):
            if w in NOISE_WORDS and before not in LAYOUT_WORDS:
                kind = "comment" if w in COMMENT_WORDS or kind == "comment" else "noise"
    return kind


def named(tag: str, attributes: str) -> tuple[str, bool, bool, str]:
    """A node's style, whether it is a noise element, whether it is marked as the article, and what its class, id or form names."""
    noise, article, style = tag in NOISE_TAGS and tag != "form", tag in ("article", "main"), tag
    kinds = {"noise"} if tag == "form" else set()
    if attributes:
        plain = tag in ("body", "html", "main")
        for name, value in ATTRIBUTE.findall(attributes):
            name, value = name.lower(), value.strip("\"'")
            if name in ("class", "id"):
                style += ("." if name == "class" else "#") + re.sub(r"\d+", "", value)
                kinds |= set() if plain else {doubtful(value)}
            elif name == "role":
                noise |= value.lower() in NOISE_ROLES
                article |= value.lower() in ("main", "article")
            elif name == "hidden" or (name == "aria-hidden" and value.lower() == "true"):
                noise = True
            elif name == "itemprop":
                article |= value.lower() == "articlebody"
    return style, noise, article and not noise, "comment" if "comment" in kinds else "noise" if "noise" in kinds else ""


def parse(page: str) -> tuple[list[Block], set[int]]:
    """The page's blocks of text, by one scan over its tags, and those doubtful names that name comments.

    Unclosed and stray tags are closed as browsers do.
    """
    out: list[Block] = []
    stack: list[tuple[str, str, bool, bool, tuple[int, ...]]] = []  # tag, path, noise, article, doubtful names
    parts: list[str] = []
    comments: set[int] = set()
    linked = at = links = 0

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join(entities.unescape("".join(parts)).split())
            parts.clear()
            if text:
                top = stack[-1] if stack else ("", "", False, False, ())
                out.append(Block(top[1], text, top[2], top[3], min(1.0, linked / len(text)), top[4]))
        linked = 0

    def pop(k: int) -> None:
        nonlocal links
        links -= sum(s[0] == "a" for s in stack[k:])
        del stack[k:]

    while True:
        m = TOKEN.search(page, at)
        if (m.start() if m else len(page)) > at:
            text = page[at : m.start() if m else len(page)]
            parts.append(text)
            linked += len(text) if links else 0
        if not m:
            break
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            if m[0].startswith("<![CDATA["):
                parts.append(entities.escape(m[0][9:].removesuffix("]]>")))
            continue
        if tag not in INLINE:
            flush()
        elif tag == "br":
            parts.append(" ")
        if m[1]:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    pop(k)
                    break
                if tag in INLINE and stack[k][0] not in INLINE:
                    break
            continue
        if tag in RAW:
            if not m[3].endswith("/"):
                end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I).search(page, at)
                at = end.end() if end else len(page) if tag in ("script", "style", "textarea", "title", "xmp") else at
            continue
        if tag in VOID:
            continue
        if tag in CLOSES:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] in CLOSES[tag]:
                    pop(k)
                    if tag != "tr":
                        break
                elif stack[k][0] in BOUNDS and not (tag == "tr" and stack[k][0] in ("td", "th")):
                    break
        elif tag not in INLINE:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == "p":
                    pop(k)
                    break
                if stack[k][0] in BOUNDS:
                    break
        style, noise, article, kind = named(tag, m[3])
        over = stack[-1] if stack else ("", "", False, False, ())
        path = over[1] if tag in INLINE else f"{over[1]}/{style}"
        stack.append((tag, path, over[2] or noise, (over[3] or article) and not noise, (*over[4], at) if kind else over[4]))
        if kind == "comment":
            comments.add(at)
        links += tag == "a"
    flush()
    return out, comments


def candidates(blocks: list[Block], comments: set[int]) -> list[Block]:
    """What names leave: the marked article where there is one, else all but noise by name and blocks that are links."""
    blocks = [b for b in blocks if not b.noise]
    held: dict[int, int] = {}
    whole = 0
    for b in blocks:
        if b.linked < 0.8:
            whole += len(b.text)
            for n in b.names:
                held[n] = held.get(n, 0) + len(b.text)
    wrappers = {n for n, size in held.items() if size == whole or (2 * size > whole and n not in comments)}
    blocks = [b for b in blocks if wrappers.issuperset(b.names)]
    return [b for b in blocks if b.article] or [b for b in blocks if b.linked < 0.8]


def size(blocks: list[Block]) -> int:
    return sum(len(b.text) for b in blocks)


def main_text(page: str | None, site: str, most: Sorted | set[int], some: Sorted | set[int]) -> str:
    """The page's main text, given its noise: what over half of its host's pages show, and what fewer show."""
    blocks, comments = parse(page or "")
    if most or some:
        key = {b: b.key(site) for b in blocks}
        rest = [b for b in blocks if key[b] not in most]
        own = [b for b in rest if key[b] not in some]
        if 2 * size(candidates(own, comments)) < size(candidates(rest, comments)):
            own = rest
        marked = [b for b in candidates(blocks, comments) if b.article]
        kept = candidates(own, comments)
        if 2 * size([b for b in kept if b.article]) < size(marked):
            kept = marked
    else:
        kept = candidates(blocks, comments)
    return "\n".join(b.text for b in kept)


class Sorted:
    """Sorted numbers, asked like a set."""

    def __init__(self, values: np.ndarray) -> None:
        self.values = values

    def __len__(self) -> int:
        return len(self.values)

    def __contains__(self, key: int) -> bool:
        at = int(self.values.searchsorted(key))
        return at < len(self.values) and int(self.values[at]) == key


def host(url: str = "url"):
    return F.coalesce(F.lower(F.regexp_extract(F.col(url), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)), F.lit(""))


#: Rows of a tree: of the pages themselves, of a content of a node, of a node's layout, of all that a page shows at a path.
PAGE, CONTENT, LAYOUT, FILLED = range(4)


def branches(blocks: list[Block], site: str) -> list[tuple[int, int | None, int | None, int]]:
    """The page's part of the tree: ``(kind, node, path, value)``. A node's layout is the styles of its blocks in order."""
    contents: dict[int, tuple[int, int]] = {}
    layouts: dict[int, list[str]] = {}
    filled: dict[int, list[int]] = {}
    for b in blocks:
        parent, _, style = b.path.rpartition("/")
        node, path, key = digest(parent), digest(b.path), b.key(site)
        contents[key] = node, path
        layouts.setdefault(node, []).append(style)
        filled.setdefault(path, []).append(key)
    rows: list[tuple[int, int | None, int | None, int]] = [(CONTENT, node, path, key) for key, (node, path) in contents.items()]
    rows += [(LAYOUT, node, None, digest("\n".join(styles))) for node, styles in layouts.items()]
    return rows + [(FILLED, None, path, digest(" ".join(map(str, keys)))) for path, keys in filled.items()]


def style_tree(pages: DataFrame) -> DataFrame:
    """The merged trees of all hosts: ``(site, kind, node, path, value, shown)``, with the number of distinct pages that show it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for site, page in zip(batch.column("site").to_pylist(), batch.column("html").to_pylist(), strict=True):
                part = branches(parse(page or "")[0], site)
                whole = digest(" ".join(sorted(str(r[3]) for r in part if r[0] == CONTENT)))
                rows.append((site, PAGE, None, None, 0, whole))
                rows += [(site, *r, whole) for r in part]
            columns = zip(*rows, strict=True) if rows else [()] * 6
            kinds = [pa.string(), pa.int32()] + [pa.int64()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["site", "kind", "node", "path", "value", "page"])

    seen = pages.select("site", "html").mapInArrow(tidy(run), "site string, kind int, node long, path long, value long, page long").distinct()
    return seen.groupBy("site", "kind", "node", "path", "value").agg(F.count("*").alias("shown"))


def noise_of(pages: DataFrame, bound: float = IMPORTANCE, least_pages: int = LEAST_PAGES) -> DataFrame:
    """``(content, most)``: the contents of low importance of each host that has any, and whether over half of its pages show it."""
    tree = checkpointed(style_tree(pages))
    counts = tree.where(F.col("kind") == PAGE).select("site", F.col("shown").alias("pages")).where(F.col("pages") >= least_pages)
    often = tree.where((F.col("kind") == CONTENT) & (F.col("shown") > 1)).select("site", "node", "path", F.col("value").alias("content"), "shown")
    often = often.join(bounded(counts), "site")
    # Entropy of a node's layouts, and of what pages show at a path, in logarithms of the pages that have it.
    m, x = F.sum("shown"), F.sum(F.col("shown") * F.log("shown"))
    entropy = F.when(m > 1, (F.log(m) - x / m) / F.log(m)).otherwise(1.0)
    presented = tree.where(F.col("kind") == LAYOUT).groupBy("site", "node").agg(entropy.alias("presentation"))
    filled = tree.where(F.col("kind") == FILLED).groupBy("site", "path").agg(entropy.alias("filled"), m.alias("having")).where(F.col("having") >= least_pages)
    shared = 1 - F.log("shown") / F.log("pages")
    weighed = lambda content: (1 - DECAY) * F.col("presentation") + DECAY * content < bound
    low = (F.col("shown") >= least_pages) & weighed(shared)
    alike = F.coalesce(weighed(F.col("filled")), F.lit(False))
    found = often.join(presented, ["site", "node"]).join(filled, ["site", "path"], "left").where(low | alike)
    return found.select("content", (F.col("shown") * 2 > F.col("pages")).alias("most"))


def extracted(pages: DataFrame, broadcast_blocks: int = BROADCAST_BLOCKS) -> DataFrame:
    """``pages`` (``page_id, url, html``) as ``page_id, url, text, n_chars``."""
    sited = pages.select("page_id", "url", "html").withColumn("site", host())
    found = checkpointed(noise_of(sited))
    kind = pages.schema["page_id"].dataType.simpleString()
    schema = f"page_id {kind}, url string, text string, n_chars long"

    def written(batch: pa.RecordBatch, texts: list[str]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    if found.count() <= broadcast_blocks:
        rows = found.toArrow()
        content, common = rows.column("content").to_numpy(), rows.column("most").to_numpy().astype(bool)
        most, some = np.sort(content[common]), np.sort(content[~common])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            often, seldom = Sorted(most), Sorted(some)
            for batch in batches:
                yield written(batch, [main_text(page, site, often, seldom) for page, site in zip(batch.column("html").to_pylist(), batch.column("site").to_pylist(), strict=True)])

        return sited.mapInArrow(tidy(run), schema)

    def shown(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(same, key) for page, site, same in zip(*(batch.column(c).to_pylist() for c in ("html", "site", "same")), strict=True) for key in {b.key(site) for b in parse(page or "")[0]}]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.int64()))], ["same", "content"])

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("html", "site", "often", "seldom"))
            yield written(batch, [main_text(page, site, set(a or ()), set(b or ())) for page, site, a, b in zip(*columns, strict=True)])

    told = sited.withColumn("same", F.sha2(F.concat_ws("\n", "site", "html"), 256))
    held = told.select("html", "site", "same").mapInArrow(tidy(shown), "same string, content long").distinct().join(found, "content")
    sets = held.groupBy("same").agg(F.collect_list(F.when(F.col("most"), F.col("content"))).alias("often"), F.collect_list(F.when(~F.col("most"), F.col("content"))).alias("seldom"))
    return told.join(sets, "same", "left").select("page_id", "url", "html", "site", "often", "seldom").mapInArrow(tidy(joined), schema)


def op4_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extracted(read(spark, sf_dir, "pages"))
