"""Main text of web pages: subtrees that recur over a host's pages, as they are or by their shape, go, and so do boilerplate elements."""

from __future__ import annotations

import html
import re
from collections import Counter

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, worker_store

#: A subtree is template where it stands on MIN_PAGES different pages of its host, and on MIN_SHARE of them or on MANY_PAGES.
MIN_PAGES, MIN_SHARE, MANY_PAGES = 5, 0.2, 200

#: A subtree is a menu where it holds at least so many blocks and all its words stand in links.
MENU_BLOCKS = 3
#: Templates go to pages by their host, broadcast, up to this many hashes (some 10 MB) and so many of one host; else page by page.
BROADCAST_HASHES, HOST_HASHES = 100_000, 1_000
NAME = re.compile(r"(/?)([a-zA-Z][^\s/>]*)")
#: The rest of a tag, by whether the page has closing double and single quotes from here on: without, they are marks like others.
REST = {
    (dq, sq): re.compile("(?:[^>" + '"' * dq + "'" * sq + "]+" + '|"[^"]*"' * dq + "|'[^']*'" * sq + ")*")
    for dq in (False, True) for sq in (False, True)
}
ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Text inside these is no markup.
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
#: Elements that never hold main text.
DROPPED = RAW | frozenset("head nav header footer aside form button select option menu dialog svg canvas template object audio video map".split())
#: Words in class, id or role that mark boilerplate.
MARKED = re.compile(
    r"(?:^|[\s_-])(ad|ads|advert\w*|adsense|banner|sponsor\w*|promo\w*|nav\w*|menu\w*|breadcrumbs?|sidebar\w*|footer|header|masthead|cookies?|consent|gdpr|notice|popup|modal|newsletter|subscribe|"
    r"comments?|comment-\w+|replies|disqus|share|sharing|social|related|recommended|widget|pagination|pager|complementary|contentinfo|navigation|search|login|signup|skip\w*)(?=$|[\s_-])",
    re.I,
)
#: Names that say how a page is laid out around its main text, such as no-sidebar.
LAYOUT = re.compile(r"(?:no|has|with|without|not|is)[-_]", re.I)
#: Of the rolling hash over a page's texts.
PRIME, BASE = (1 << 61) - 1, 1_000_003
#: Elements of running text: those of an article are never taken for template.
FLOW = frozenset("p h1 h2 h3 h4 h5 h6 hgroup li dt dd blockquote pre tr td th thead tbody tfoot caption figure figcaption details summary".split())
BLOCK = frozenset(
    "address article blockquote body center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: An opening tag of the first kind ends an open element of the second kinds.
ENDS = {k: frozenset({"p"}) for k in BLOCK - {"body", "html"}} | {
    "li": frozenset({"li", "p"}), "dt": frozenset({"dt", "dd", "p"}), "dd": frozenset({"dt", "dd", "p"}), "tr": frozenset({"tr", "td", "th", "p"}), "td": frozenset({"td", "th", "p"}), "th": frozenset({"td", "th", "p"}),
}
#: A bit for each block element, for the kinds that stand in a subtree.
BIT = {tag: 1 << k for k, tag in enumerate(sorted(BLOCK))}
WORD, DIGITS = re.compile(r"\w"), re.compile(r"\d+")
SCOPES = frozenset({"ul", "ol", "dl", "table", "article", "main", "div", "section", "body", "html", "blockquote"})


def _marked(attributes: str) -> bool:
    """Whether a name in class, id or role marks boilerplate."""
    names = " ".join(a[2] or a[3] or a[4] or "" for a in ATTRIBUTE.finditer(attributes)).split()
    return any(MARKED.search(n) and not LAYOUT.match(n) for n in names)


def _names(attributes: str) -> str:
    """The names in class, id and role, in a fixed order and without numbers."""
    return " ".join(sorted({DIGITS.sub("", n) for a in ATTRIBUTE.finditer(attributes) for n in (a[2] or a[3] or a[4] or "").split()}))


def parse(page: str) -> tuple[list[tuple[str, int, bool, bool, bool]], list[tuple[str, int, int, int, bool, bool, str]]]:
    """(blocks, nodes) of a page.

    blocks: (text, the innermost node, whether in a boilerplate element, whether inside an article or main element,
    whether all words stand in links) in page order. nodes: (tag, parent or -1, first block, last block + 1, inside such an
    element, around one, names) of block elements in page order. What scripts, styles, buttons and the like hold is in no block. Linear in the page, however
    deep its elements, and whether or not tags, quotes, comments and raw text are closed.
    """
    blocks: list[tuple[str, int, bool, bool, bool]] = []
    nodes: list[list] = []
    stack: list[tuple[str, int, int, bool, int]] = []  # tag, node or -1, 0 or 1 (boilerplate) or 2 (no text at all), main, innermost node
    open_: Counter = Counter()  # how many of a tag are on the stack
    text: list[str] = []
    quotes = [True, True]
    plain = [False]  # whether the text so far has words outside links

    def flush() -> None:
        if text:
            got = " ".join(html.unescape("".join(text)).split())
            text.clear()
            if got:
                top = stack[-1] if stack else ("", -1, 0, False, -1)
                blocks.append((got, top[4], top[2] > 0, top[3], not plain[0]))
            plain[0] = False

    def close(n: int) -> None:
        flush()
        while len(stack) > n:
            tag, node, *_ = stack.pop()
            open_[tag] -= 1
            if node >= 0:
                nodes[node][3] = len(blocks)

    at, end = 0, len(page)
    while at < end:
        lt = page.find("<", at)
        upto = lt if lt >= 0 else end
        kind = stack[-1][2] if stack else 0
        if kind < 2 and upto > at:
            text.append(page[at:upto])
            if not plain[0] and not open_["a"]:
                plain[0] = WORD.search(page, at, upto) is not None
        if lt < 0:
            break
        if page.startswith("<!--", lt):
            at = page.find("-->", lt + 4) + 3
            at = end if at < 3 else at
            continue
        m = NAME.match(page, lt + 1)
        if not m:
            if page.startswith(("<!", "<?"), lt):
                at = page.find(">", lt) + 1 or end
            else:
                if kind < 2:
                    text.append("<")
                at = lt + 1
            continue
        rest = REST[quotes[0], quotes[1]].match(page, m.end())
        while rest.end() < end and page[rest.end()] != ">":  # a quote that is never closed: from here on there is none of its kind
            quotes["\"'".index(page[rest.end()])] = False
            rest = REST[quotes[0], quotes[1]].match(page, m.end())
        at, attributes, tag = rest.end() + 1, rest[0], m[2].lower()
        if m[1]:
            if open_[tag]:
                i = next(i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag)
                if tag in BLOCK or stack[i][2]:
                    close(i)
                else:
                    del stack[i]  # inline elements may end in any order
                    open_[tag] -= 1
            continue
        if tag in VOID:
            if kind < 2:
                if tag == "hr":
                    flush()
                elif tag == "br":
                    text.append(" ")
            continue
        ends = ENDS.get(tag)
        if ends and any(open_[x] for x in ends):
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] in ends and not stack[i][2]:
                    close(i)
                elif stack[i][0] in SCOPES:
                    break
        kind, main, inner = (stack[-1][2], stack[-1][3], stack[-1][4]) if stack else (0, False, -1)
        drop = tag in DROPPED or (bool(attributes) and tag not in ("html", "body", "main") and _marked(attributes))
        kind = 0 if tag == "main" and kind < 2 else max(kind, drop * (1 if tag in BLOCK else 2))
        main = main or tag in ("article", "main")
        if tag in RAW:
            found = re.compile(rf"</{re.escape(tag)}[\s/>]", re.I).search(page, at)
            at = page.find(">", found.start()) + 1 or end if found else end
            if tag in BLOCK:
                flush()
            continue
        if attributes.rstrip().endswith("/") and tag not in BLOCK:
            continue
        node = -1
        if tag in BLOCK:
            flush()
            node = inner = len(nodes)
            nodes.append([tag, stack[-1][4] if stack else -1, len(blocks), len(blocks), main, False, _names(attributes) if attributes else ""])
        elif drop and tag in DROPPED:
            flush()
        if tag in ("article", "main"):
            up = nodes[node][1]
            while up >= 0 and not nodes[up][5]:
                nodes[up][5] = True
                up = nodes[up][1]
        stack.append((tag, node, kind, main, inner))
        open_[tag] += 1
    close(0)
    return blocks, [tuple(n) for n in nodes]


def subtree_hashes(blocks: list, nodes: list) -> list[int | None]:
    """Each node's hash by its tag and the texts in it, or None where it can't be template: it holds no text, is or holds
    an article or main element or the whole page, or is running text of an article."""
    sums, powers = [0], [1]
    for text, *_ in blocks:  # a range's hash from two sums, so that depth costs nothing
        sums.append((sums[-1] * BASE + xxhash.xxh64_intdigest(text)) % PRIME)
        powers.append(powers[-1] * BASE % PRIME)
    out = []
    for tag, _, first, last, inside, around, _ in nodes:
        if first == last or around or tag in ("html", "body", "article", "main") or (inside and tag in FLOW):
            out.append(None)
        else:
            within = (sums[last] - sums[first] * powers[last - first]) % PRIME
            out.append(xxhash.xxh64_intdigest(f"{tag} {last - first} {within}") - (1 << 63))
    return out


def shape_hashes(blocks: list, nodes: list) -> list[tuple[int | None, bool]]:
    """Each node's (shape, whether it is a menu). The shape is a hash of its tag, its names, the kinds of elements in it
    and whether it is a menu, without the text; None inside articles, and where subtree_hashes has None."""
    links, kinds = [0], [BIT[n[0]] for n in nodes]
    for *_, linked in blocks:
        links.append(links[-1] + linked)
    for k in range(len(nodes) - 1, -1, -1):  # parents stand before what they hold
        if nodes[k][1] >= 0:
            kinds[nodes[k][1]] |= kinds[k]
    out = []
    for (tag, _, first, last, inside, around, names), held in zip(nodes, kinds, strict=True):
        menu = last - first >= MENU_BLOCKS and links[last] - links[first] == last - first
        if first == last or inside or around or tag in ("html", "body", "article", "main"):
            out.append((None, False))
        else:
            out.append((xxhash.xxh64_intdigest(f"{tag}|{names}|{held}|{menu}") - (1 << 63), menu))
    return out


def kept_blocks(page: str, gone=frozenset(), lists: bool = True, articles: bool = True) -> list[str]:
    """The blocks of a page's main text: without subtrees whose hash or shape is among `gone`, and without boilerplate
    elements (unless `lists` is false).

    Of a page with an article or main element that alone stays (unless `articles` is false). Where all of an article, or
    of a page without one, would be template, it stays.
    """
    blocks, nodes = parse(page)
    lost: list[bool] = []
    if gone:
        for k, (h, (shape, _)) in enumerate(zip(subtree_hashes(blocks, nodes), shape_hashes(blocks, nodes), strict=True)):
            up = nodes[k][1]
            lost.append(h in gone or shape in gone or (up >= 0 and lost[up]))
    own = [(text, main, bool(lost) and node >= 0 and lost[node]) for text, node, dropped, main, _ in blocks if not (lists and dropped)]
    if articles and any(main for _, main, _ in own):
        own = [b for b in own if b[1]]
    return [text for text, _, out in own if not out] or [text for text, *_ in own]


def _keyed(pages: DataFrame) -> DataFrame:
    """key, page_id, url, host, html of each page; repeated rows share their key."""
    page_id, url = F.col("page_id").cast("long"), F.col("url")
    host = F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[^:]*://([^/?#]*)", 1))
    return pages.select(F.xxhash64(page_id.cast("string"), url, "html").alias("key"), page_id.alias("page_id"), url.alias("url"), host.alias("host"), F.col("html").alias("html"))


def subtrees(pages: DataFrame) -> DataFrame:
    """pages(key, host, html) -> key, host, page, h, s, menu, first: each different subtree of each page that may be
    template, its shape or NULL, whether that is a menu, and whether the row is the page's first of the shape; page is a
    hash of the page's texts, so that copies of a page count as one."""
    schema = pa.schema([("page", pa.int64()), ("h", pa.int64()), ("s", pa.int64()), ("menu", pa.bool_()), ("first", pa.bool_())])

    def work(batches):
        worker_store("html")
        for batch in batches:
            at, rows = [], []
            for i, text in enumerate(batch.column("html")):
                blocks, nodes = parse(text.as_py() or "")
                page = xxhash.xxh64_intdigest("\n".join(b[0] for b in blocks)) - (1 << 63)
                pairs, met = dict.fromkeys((h, *s) for h, s in zip(subtree_hashes(blocks, nodes), shape_hashes(blocks, nodes), strict=True) if h is not None), set()
                for h, s, menu in pairs:
                    at.append(i)
                    rows.append((page, h, s, menu, s not in met))
                    met.add(s)
            columns = list(zip(*rows, strict=True)) or [()] * len(schema)
            taken = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("key").take(taken), batch.column("host").take(taken), *(pa.array(c, f.type) for c, f in zip(columns, schema, strict=True))], names=["key", "host", *schema.names])

    return pages.select("key", "host", "html").mapInArrow(work, f"key long, host {dict(pages.dtypes)['host']}, page long, h long, s long, menu boolean, first boolean")


def templates(own: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE, many_pages: int = MANY_PAGES) -> DataFrame:
    """own(host, page, h) -> host, h of the subtrees that recur: on at least min_pages different pages of the host, and on
    min_share of its pages or on many_pages. Partial counts go before each shuffle."""
    counts = own.select("host", "h", "page").distinct().groupBy("host", "h").agg(F.count("*").alias("n")).where(F.col("n") >= min_pages)
    totals = own.select("host", "page").distinct().groupBy("host").agg(F.count("*").alias("total"))
    return counts.join(totals, "host").where(F.col("n") >= F.least(F.lit(min_share) * F.col("total"), F.lit(many_pages))).select("host", "h")


def shapes(own: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE, many_pages: int = MANY_PAGES) -> DataFrame:
    """own(host, page, h, s, menu, first) -> host, s of the shapes outside articles that are template: they recur as
    templates() asks of a subtree, and they are menus or show little variety, which means that at least half of their
    different subtrees stand on min_pages different pages. What an author writes fills the same shape on many pages, but
    with a text of its own on each."""
    texts = own.where("s is not null").select("host", "s", "h", "page", "menu", "first").distinct()
    texts = texts.groupBy("host", "s", "h").agg(F.count("*").alias("n"), F.count_if("first").alias("pages"), F.max("menu").alias("menu"))
    found = texts.groupBy("host", "s").agg(F.sum("pages").alias("pages"), F.max("menu").alias("menu"), F.count("*").alias("texts"), F.count_if(F.col("n") >= min_pages).alias("again"))
    totals = own.select("host", "page").distinct().groupBy("host").agg(F.count("*").alias("total"))
    recurs = (F.col("pages") >= min_pages) & (F.col("pages") >= F.least(F.lit(min_share) * F.col("total"), F.lit(many_pages)))
    return found.join(totals, "host").where(recurs & (F.col("menu") | (2 * F.col("again") >= F.col("texts")))).select("host", "s")


def main_text(pages: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE, many_pages: int = MANY_PAGES, lists: bool = True, articles: bool = True) -> DataFrame:
    """page_id, url, text, n_chars for each row of pages(page_id, url, html), by the whole html.

    Subtrees of all elements of all pages are hashed, with their text and by their shape, and counted per host; recurring
    ones go: menus and shapes of little variety outside articles, and equal subtrees also inside them where they aren't
    running text. Boilerplate elements that don't recur go by tag, class, id or role, unless `lists` is false; of a page
    with an article that alone stays, unless `articles` is false.
    Character references are decoded, white space inside a block becomes one space, blocks are joined by line feeds.
    A NULL or empty html has an empty text; repeated rows and copies of a page count as one page and each get their
    row; pages without a host form one host. Unclosed elements end with their parent, unclosed comments and raw text
    with the page. An empty table gives no rows; other columns, of any name, are ignored.
    """
    keyed = _keyed(pages).withColumn("host", F.xxhash64("host"))
    own = cut(subtrees(keyed))  # a few numbers for each page
    equal = templates(own, min_pages, min_share, many_pages).withColumnRenamed("h", "code")
    codes = cut(equal.unionByName(shapes(own, min_pages, min_share, many_pages).withColumnRenamed("s", "code")))
    total, most = codes.groupBy("host").count().agg(F.coalesce(F.sum("count"), F.lit(0)), F.coalesce(F.max("count"), F.lit(0))).first()
    if total <= BROADCAST_HASHES and most <= HOST_HASHES:
        hits, by = F.broadcast(codes.groupBy("host").agg(F.collect_set("code").alias("gone"))), "host"  # pages stay where they are
    else:
        each = own.select("key", "host", F.explode(F.array("h", "s")).alias("code"))
        hits, by = each.join(codes, ["host", "code"], "left_semi").groupBy("key").agg(F.collect_set("code").alias("gone")), "key"  # at most one page's subtrees

    def work(batches):
        worker_store("html")
        for batch in batches:
            texts = ["\n".join(kept_blocks(h.as_py() or "", frozenset(g.as_py() or ()), lists, articles)) for h, g in zip(batch.column("html"), batch.column("gone"), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return keyed.join(hits, by, "left").select("page_id", "url", "html", "gone").mapInArrow(work, "page_id long, url string, text string, n_chars long")


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, url, text, n_chars for each row of `pages`: the main text of the whole html. NULL and empty html give an
    empty text; repeated rows each get their row; an empty table gives no rows; other columns are ignored."""
    return main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))
