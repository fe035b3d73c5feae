"""HTML extraction: site templates go by subtree hashes counted per host.

A page is parsed into a tree (unclosed and badly nested markup as browsers read
it, in the main).  Every element's subtree has two hashes:

* ``hash``, of its tag, its text and its children's hashes: the same boilerplate;
* ``shape``, of containers outside ``article`` and ``main``, of the tags, classes, ids
  and roles down from the body, and of the children's shapes, a run of equal ones
  counting once: the same slot of a template, whatever text a page has in it.

Spark counts, per host, the pages that have each.  What recurs on ``LEAST_PAGES`` pages
and ``LEAST_SHARE`` of the host's pages is template; a shape that on average holds
``MAIN_SHARE`` of its pages' text or more is where the host's articles stand, and stays
(on pages without an ``article`` or ``main`` a third of that is enough).

Blocks of prose in an ``article`` or ``main`` element (headings, paragraphs, lists,
quotes, tables) are counted per distinct article instead of per page, so copies of an
article on one host stay whole, and blocks that the articles of other hosts have more
often (``LEAST_OWN``) stay too: they are quoted text, not one site's template.  What
stands inside a block stays or goes with it.

The counts are asked first.  What they can't know, as on hosts of a few pages, goes by
elements that say themselves what they are (``DROPPED`` tags, ``MARKS`` in class, id or
role).
"""

from __future__ import annotations

import html as _html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.llm.columns import blocks, stored

LEAST_PAGES = 4
LEAST_SHARE = 0.1
MAIN_SHARE = 0.3
LEAST_OWN = 0.5  # of the distinct articles with a block of prose are the host's, if it's template there
BROADCAST_BYTES = 16 << 20  # of templates; beyond, pages and templates are joined by host and salt
# Element names by how HTML treats them.
RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody tfoot thead tr ul caption".split()
)
CELL = frozenset(["td", "th"])
DROPPED = frozenset("nav footer aside form script style noscript template iframe svg math button select option input textarea object embed canvas audio video menu dialog head title link meta map".split())
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd blockquote pre table thead tbody tfoot tr td th caption b i em strong a span code sub sup small q cite abbr mark u s br hr figcaption article main header".split())
#: prose that stands for itself, and so may be template on its own
OWN = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl blockquote pre table".split())
#: elements that hold a page's article, and those that hold every page
MAIN = frozenset(["article", "main"])
_FRAME = frozenset(["#root", "html", "head", "body"])
_DIGITS = re.compile(r"\d+")
UNSURE = 1 / 3  # of the share of text that keeps a shape, where no element says which is the article
# Words in class, id or role that mark what isn't the article.
MARKS = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|banner|sponsor\w*|promo\w*|cookies?|consent|gdpr|notice|alert|newsletter|subscri\w*|side-?bar|widget|menu|nav\w*|breadcrumbs?|footer|masthead|site-?header|page-?header|comments?|commentlist|replies|disqus|shar(?:e|ing)|social|related|recommend\w*|popup|modal|overlay|complementary|contentinfo|search|login|signup|skip-link)(?:$|[\s_-])",
    re.I,
)
_CLOSES_P = BLOCK - {"html", "body"}
_MARK = re.compile(r"<(?:!--|[!?]|(/?)([a-zA-Z][^\s/>]*)([^>\"']*)(>)?)")
_ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
#: an open element of these tags ends where one of the others begins
_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "thead": set(), "tbody": {"thead", "tbody", "tr", "td", "th"}}
_STOPS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table", "tbody", "thead", "tfoot"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}, "tbody": {"table"}}


class Node:
    __slots__ = ("tag", "marks", "children", "parent", "hash", "chars", "main", "shape")

    def __init__(self, tag: str, marks: str, parent: Node | None):
        self.tag, self.marks, self.parent, self.children = tag, marks, parent, []
        #: subtree's hash, length of its text, whether it has an article, shape (0 for none)
        self.hash, self.chars, self.main, self.shape = 0, 0, False, 0


def _tag_end(source: str, at: int) -> int:
    """Where the tag at ``at`` ends, quotes minded; if one stays open, at the next >."""
    i = at
    while True:
        gt = source.find(">", i)
        if gt < 0:
            return len(source)
        double, single = source.find('"', i, gt), source.find("'", i, gt)
        first = min((x for x in (double, single) if x >= 0), default=-1)
        if first < 0:
            return gt + 1
        close = source.find(source[first], first + 1)
        if close < 0:
            return gt + 1
        i = close + 1


def _said(attributes: str) -> str:
    """Class, id and role of a tag, and "hidden" if it is."""
    if "=" not in attributes and "hidden" not in attributes:
        return ""
    out = []
    for name, a, b, c in _ATTRIBUTE.findall(attributes):
        name = name.lower()
        if name in ("class", "id", "role"):
            out.append(a or b or c)
        elif name == "hidden":
            out.append("hidden")
    return " ".join(out)


def parse(source: str) -> Node:
    """The tree of a page; text children are strings as they stand in the source."""
    root = Node("#root", "", None)
    here, at, size = root, 0, len(source)
    while at < size:
        m = _MARK.search(source, at)
        if m is None:
            here.children.append(source[at:])
            break
        if m.start() > at:
            here.children.append(source[at : m.start()])
        if m[2] is None:
            if source.startswith("<!--", m.start()):
                end = source.find("-->", m.start() + 4)
                at = size if end < 0 else end + 3
            else:
                end = source.find(">", m.end())
                at = size if end < 0 else end + 1
            continue
        end = m.end() if m[4] else _tag_end(source, m.end())
        attributes = m[3] if m[4] else source[m.start(3) : end - 1]
        tag = m[2].lower()
        at = end
        if m[1]:
            node = here
            while node is not root and node.tag != tag:
                node = node.parent
            if node is not root:
                here = node.parent
            continue
        if tag in _CLOSES_P or tag in _STOPS:
            node = here
            while node is not root:
                if tag in _CLOSES_P and node.tag == "p":
                    here = node.parent
                    break
                if node.tag in ("td", "th", "button", "object", "caption", "table"):
                    break
                node = node.parent
        if tag in _STOPS:
            node, stops = here, _STOPS[tag]
            while node is not root and node.tag not in stops:
                if node.tag in _ENDS and tag in _ENDS[node.tag]:
                    here = node.parent
                    break
                node = node.parent
        node = Node(tag, _said(attributes), here)
        here.children.append(node)
        if tag in RAW:
            close = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(source, at)
            stop = close.start() if close else size
            node.children.append(source[at:stop])
            at = _tag_end(source, stop) if close else size
        elif tag not in VOID and not attributes.endswith("/"):
            here = node
        elif tag not in VOID and tag not in ("svg", "math") and tag in BLOCK:
            here = node  # a slash doesn't close an HTML element
    return root


def walk(root: Node) -> list[Node]:
    """Elements, each before what it holds."""
    out, todo = [], [root]
    while todo:
        node = todo.pop()
        out.append(node)
        todo += [c for c in reversed(node.children) if isinstance(c, Node)]
    return out


def _xx(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")) >> 1


def hash_subtrees(root: Node) -> list[Node]:
    """Give every element its subtree's hash, and containers outside articles their shape; all elements, each before what it holds."""
    nodes = walk(root)
    for node in reversed(nodes):
        parts, chars, main = [node.tag, "\x01"], 0, node.tag in MAIN
        for c in node.children:
            if isinstance(c, Node):
                parts.append(f"\x02{c.hash:x}")
                chars += c.chars
                main = main or c.main
            elif text := " ".join(c.split()):
                parts.append(text)
                chars += len(text)
        node.hash, node.chars, node.main = _xx("".join(parts)), 0 if node.tag in RAW else chars, main
    # slots: the way from the body to each container, then what each holds
    slots, todo = [], [(root, "")]
    while todo:
        node, path = todo.pop()
        if node.tag in MAIN or node.tag in RAW:
            continue
        own = path if node.tag in _FRAME else f"{path}/{node.tag}.{_DIGITS.sub('0', node.marks)}"
        slots.append((node, own))
        todo += [(c, own) for c in node.children if isinstance(c, Node)]
    for node, path in reversed(slots):
        inner, last = [path], 0
        for c in node.children:
            if isinstance(c, Node) and c.shape != last:
                last = c.shape
                inner.append(f"{last:x}")
        node.shape = _xx("\x03".join(inner))
    return nodes


def _slot(node: Node) -> bool:
    """Whether an element may be template by its shape alone."""
    return bool(node.shape) and not node.main and node.tag not in PROSE - {"header"} and node.tag not in _FRAME


def template_hashes(source: str | None) -> list[tuple[int, int, int]]:
    """The distinct hashes of a page's subtrees that hold text or structure and may be template.

    Each with the hash of the article that it's prose of, or 0; and for a shape with the
    thousandths of the page's text that it holds, or 0.
    """
    if not source:
        return []
    root = parse(source)
    hash_subtrees(root)
    whole = max(1, int(root.chars * (1 if root.main else UNSURE)))
    out, shapes, todo = set(), Counter(), [(root, 0)]
    while todo:
        node, article = todo.pop()
        if node.tag in MAIN:
            article = article or node.hash
        prose = article and node.tag in PROSE
        if node.tag not in _FRAME and node.tag not in RAW and not (prose and node.tag not in OWN) and node.children:
            out.add((node.hash, article if prose else 0, 0))
            if _slot(node):
                shapes[node.shape] += node.chars
        if node.tag not in DROPPED:
            todo += [(c, article) for c in node.children if isinstance(c, Node)]
    return sorted(out) + [(k, 0, 1000 * n // whole) for k, n in sorted(shapes.items())]


def _templated(node: Node, prose: bool, template: set[int] | frozenset) -> bool:
    if node.tag in _FRAME:
        return False
    return node.hash in template and not (prose and node.tag in PROSE - OWN) or node.shape in template and _slot(node)


def _telling(node: Node, prose: bool) -> bool:
    if node.tag in DROPPED or (node.tag == "header" and not prose):
        return True
    return bool(node.marks) and node.tag not in ("html", "body", "article", "main") and (node.marks == "hidden" or bool(MARKS.search(node.marks)))


def extracted(source: str | None, template: set[int] | frozenset = frozenset(), lists: bool = True) -> tuple[str, int]:
    """The main text of a page, blocks in page order, one a line; and the subtrees that the counts removed.

    Without ``lists`` only the counts decide, beside what no browser shows.
    """
    if not source:
        return "", 0
    root = parse(source)
    if template:
        hash_subtrees(root)
    lines: list[str] = []
    parts: list[str] = []

    def end() -> None:
        line = " ".join(_html.unescape("".join(parts)).split())
        if line:
            lines.append(line)
        parts.clear()

    todo, gone = [(root, False)], 0
    while todo:
        item, prose = todo.pop()
        if isinstance(item, str):
            parts.append(item)
            continue
        if item is None:
            end()
            continue
        inside = prose or item.tag in MAIN
        if template and item is not root and _templated(item, inside, template):
            gone += 1
            continue
        if item is not root and (_telling(item, inside) if lists else item.tag in RAW or item.tag == "head"):
            continue
        if item.tag in BLOCK:
            end()
            todo.append((None, prose))
        elif item.tag == "br" or item.tag in CELL:
            parts.append(" ")
        todo += [(c, inside) for c in reversed(item.children)]
    end()
    return "\n".join(lines), gone


def extract(source: str | None, template: set[int] | frozenset = frozenset(), lists: bool = True) -> str:
    return extracted(source, template, lists)[0]


HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)"


def templates(pages: DataFrame, least_pages: int = LEAST_PAGES, least_share: float = LEAST_SHARE) -> DataFrame:
    """Page count and template hashes of every host of (host, html) that has ``least_pages`` pages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches, "html"):
            rows: dict[tuple, list[int]] = {}
            for host, source in zip(b.column("host").to_pylist(), b.column("html").to_pylist()):
                for subtree, article, share in [(-1, 0, 0), *template_hashes(source)]:  # -1 counts the page itself
                    own = rows.setdefault((host, subtree, article), [0, 0])
                    own[0] += 1
                    own[1] += share
            hosts, subtrees, articles = zip(*rows)
            n, shares = zip(*rows.values())
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), *(pa.array(x, pa.int64()) for x in (subtrees, articles, n, shares))], ["host", "subtree", "article", "n", "share"])

    # pages are parsed once; a distinct article counts once, whatever the pages that have it
    dealt = pages.mapInArrow(run, "host string, subtree long, article long, n long, share long")
    each = stored(dealt.groupBy("host", "subtree", "article").agg(F.sum("n").alias("n"), F.sum("share").alias("share")), "subtrees", True)
    outside = F.col("article") == 0
    counts = each.groupBy("host", "subtree").agg(F.sum(F.when(outside, F.col("n")).otherwise(1)).alias("n"), F.sum("share").alias("share"), F.count(F.when(~outside, 1)).alias("prose"))
    # a host of fewer pages has no template
    common = stored(counts.where(f"n >= {least_pages} and share < {1000 * MAIN_SHARE} * n"), "common", True)
    hosts = common.where("subtree = -1").select("host", F.col("n").alias("pages"))
    often = common.where("subtree <> -1").join(hosts, "host").where(f"n >= {least_share} * pages")
    # prose that articles of many hosts share is nobody's template
    every = each.where("article <> 0").groupBy("subtree").agg(F.count("*").alias("all"))
    kept = often.join(every, "subtree", "left").where(f"prose = 0 or prose >= {LEAST_OWN} * all")
    # hashes of one host meet in one row only once they are few
    return hosts.join(kept.groupBy("host").agg(F.collect_list("subtree").alias("template")), "host", "left")


def with_templates(pages: DataFrame, known: DataFrame, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Every row of ``pages`` with its host's ``template``.

    Templates of up to ``broadcast_bytes`` in all go to where the pages are.  Beyond, both
    meet by host; a host with more pages than a part of the work should have (there can
    only be a bounded number of those) is dealt to as many parts as that needs.
    """
    known = stored(known, "templates", True)
    size, rows = known.agg(F.sum(F.octet_length("host") + 8 * F.greatest(F.size("template"), F.lit(0)) + 32), F.sum("pages")).first()
    if (size or 0) <= broadcast_bytes:
        return pages.join(F.broadcast(known.where("template is not null").select("host", "template")), "host", "left")
    parts = 4 * int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    much = max(1, int(rows) // parts)
    salted = known.withColumn("salts", F.ceil(F.col("pages") / much).cast("int"))
    hot = F.broadcast(salted.where("salts > 1").select("host", "salts"))  # under ``parts`` + 1 rows
    dealt = pages.join(hot, "host", "left").withColumn("salt", F.expr("cast(pmod(monotonically_increasing_id(), coalesce(salts, 1)) as int)")).drop("salts")
    every = salted.select("host", "template", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    return dealt.join(every, ["host", "salt"], "left").drop("salt")


def extract_pages(pages: DataFrame, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """page_id, url, text, n_chars and n_template (subtrees that the counts removed) of every row of ``pages`` (page_id, url, html).

    A null or empty html gives an empty text.  Rows without a url count as one host;
    repeated rows stay, and count as pages of their host; other columns are ignored.
    """
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", F.coalesce(F.lower(F.regexp_extract("url", HOST, 1)), F.lit("")).alias("host"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches, "html"):
            found = [extracted(x, frozenset(t or ())) for x, t in zip(b.column("html").to_pylist(), b.column("template").to_pylist())]
            found, gone = zip(*found)
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(found, pa.string()), pa.array([len(x) for x in found], pa.int64()), pa.array(gone, pa.int64())], ["page_id", "url", "text", "n_chars", "n_template"])

    known = with_templates(own, templates(own.select("host", "html")), broadcast_bytes)
    return known.select("page_id", "url", "html", "template").mapInArrow(run, "page_id long, url string, text string, n_chars long, n_template long")


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"))
