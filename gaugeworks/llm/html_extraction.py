"""HTML extraction with a site style tree.

The DOMs of one host are merged by style path (tags and classes from the
root). Spark measures each node of the merged tree over the pages that have it:
its presentation by the entropy of its sequences of child styles, its content
by the entropies of its sentences over those pages. A sentence on one page only
has entropy 0 and counts whole, one on every page counts nothing; both are
relative to the entropy of the pages themselves, so that copies of a page don't
make its text look like a template. Importance adds up from the leaves to the
root, and two kinds of branches are removed from every page of the host: those
that repeat (hardly any of their content is their own), and minor ones, which
add little to their pages beside a sibling that carries most of them. A branch
is judged on the pages that have it, so neither the size of the host nor the
number of its page templates matters.

A page whose host has no other page can't be judged so. What HTML itself says
therefore counts too: elements, roles and whole class names that stand for
menus, adverts, forms, notices and comments are not content, and a page with an
article or main element is read inside it. Inside those the tree removes
nothing: a byline that all articles share, or a lead, list or table beside a
long body, is part of its article. Of names, only those that can't be words of
the content count there, and only on elements that hold blocks.

The tree is counted as (host, path, kind, signature) rows, partially summed in
each task, so a host with a third of all pages is spread over its signatures.
"""

from __future__ import annotations

import hashlib
import html as _html
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from math import log

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, slices, small_batches, stored

#: A branch repeats if less than this part of its content is its own.
LEAST_IMPORTANCE = 0.1
#: A branch is minor if it carries less than this part of its pages, and a sibling at least the other.
LEAST_SHARE, MAIN_SHARE = 0.15, 0.5
#: Deeper elements are judged as part of the element at this depth; their text is read all the same.
DEEPEST = 24
#: Tasks that the pages of one template are dealt to
SPREAD = 32

_MARK = re.compile(r"""<!--.*?(?:-->|\Z)|<(?P<raw>script|style|iframe|textarea|title)\b(?:[^>"']|"[^"]*"|'[^']*')*>.*?(?:</(?P=raw)\s*>|\Z)|<(?P<end>/)?(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>"']|"[^"]*"|'[^']*')*)>|<[!?][^>]*>""", re.S | re.I)
_NAMES = re.compile(r"""(?<![\w-])(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var".split())
_CLOSED_BY_BLOCK = frozenset(["p"])
_SIBLING_CLOSES = {"li": "li", "dt": "dd", "dd": "dt", "tr": "tr", "td": "td", "th": "th", "option": "option"}
_NEVER = frozenset("nav footer aside form button dialog menu header".split())
_NEVER_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar side-bar rail widget nav navbar navigation menu menubar breadcrumb breadcrumbs footer header masthead "
    "cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login search comments comment comment-list disqus respond reply replies pagination pager skip".split()
)
#: Names of two words that say the same; other compounds (nav-open, related-work) say nothing.
_NEVER_COMPOUNDS = frozenset(
    "ad-box ad-banner ad-container ad-slot ad-unit ad-wrapper ads-box ads-container banner-ad advert-box sponsored-content promo-box nav-bar nav-menu nav-links main-nav site-nav top-nav main-menu site-menu "
    "site-header site-footer page-footer footer-links footer-nav sidebar-widget cookie-banner cookie-bar cookie-consent cookie-notice consent-banner newsletter-form newsletter-signup "
    "comment-form comment-list comments-area comments-section reply-form search-form search-box search-bar login-form signup-form modal-dialog popup-overlay skip-link breadcrumb-nav".split()
)
_MAIN = frozenset(["article", "main"])
#: Inside an article these names are words of the content as often as not, and names of a paragraph or of anything smaller say nothing.
_NOT_IN_MAIN = frozenset("alert header masthead modal overlay pager pagination popup promotion rail reply respond search signup skip widget".split())
#: Elements that names may drop inside an article
_NAMED_IN_MAIN = frozenset("aside details div fieldset figure iframe ins li ol section table ul".split())
#: Elements that hold blocks; only they can be minor, or be what others are minor to.
CONTAINERS = ("article aside center div footer form header main nav ol section table td ul").split()
#: What branches are counted by
STYLE, SENTENCE, PAGE, TEMPLATE = range(4)
_SENTENCE_END = re.compile(r"(?<=[.!?\u3002])\s+|\n+")
#: Elements that no name makes boilerplate, and those whose id is a link target rather than a role.
_NEVER_NAMED = _MAIN | {"html", "body"}
_ID_IS_TITLE = frozenset("h1 h2 h3 h4 h5 h6 section".split())
#: Elements that show nothing of what is inside; without an end tag they are skipped alone.
_HIDDEN = frozenset("svg object select template noscript".split())
_IN_HEAD = frozenset("base basefont bgsound link meta noscript template".split())
#: An open svg ends where one of these starts, unless a foreignObject is open.
_NOT_IN_SVG = frozenset("article aside blockquote body center dd div dl dt footer h1 h2 h3 h4 h5 h6 header hr img li main nav ol p pre section span table ul".split())


@dataclass
class Node:
    tag: str
    path: str
    dropped: bool
    main: bool
    children: list[str] = field(default_factory=list)
    hidden: bool = False


def _style(tag: str, attrs: str, inside: bool = False) -> tuple[str, bool]:
    """The style of an element, and whether its names say that it is not content; ``inside`` an article fewer names do."""
    found = [(m[1].lower(), n) for m in _NAMES.finditer(attrs) for n in (m[2] or m[3] or m[4] or "").lower().split()] if "=" in attrs else []
    names = sorted({n for _, n in found})
    if inside:
        found = [(kind, n) for kind, n in found if tag in _NAMED_IN_MAIN and n not in _NOT_IN_MAIN]
    bad = tag not in _NEVER_NAMED and any(n in _NEVER_NAMES or n.replace("_", "-") in _NEVER_COMPOUNDS for kind, n in found if kind != "id" or tag not in _ID_IS_TITLE)
    return ".".join([tag, *(re.sub(r"\d+", "0", n) for n in names)]), bad


#: The same, remembered: the pages of a host repeat their tags. Only short ones are, so that the memory stays small.
_SHORT = 256
_known_style = lru_cache(1 << 14)(_style)


def walk(page: str, low: frozenset[str] = frozenset(), rules: bool = True) -> Iterator[tuple[Node, str | None]]:
    """(node, text) in page order; text None marks the end of a block, and a node with its children the end of an element.

    ``low`` are the paths that the style tree removes; without ``rules`` nothing else is.
    """
    stack = [Node("", "", False, False)]
    at = 0
    ends: dict[str, int] = {}

    def close(to: int) -> Iterator[tuple[Node, str | None]]:
        while len(stack) > to:
            node = stack.pop()
            if not node.hidden:
                yield node, None

    def ends_after(tag: str, start: int) -> bool:
        if tag not in ends:
            ends[tag] = max((e.start() for e in re.finditer(rf"</{tag}\b", page, re.I)), default=-1)
        return ends[tag] >= start

    def read(text: str) -> Iterator[tuple[Node, str | None]]:
        if stack[-1].tag == "head" and not text.isspace():
            stack.pop()  # text ends an open head
        if not stack[-1].hidden:
            yield stack[-1], text

    for m in _MARK.finditer(page):
        if m.start() > at:
            yield from read(page[at : m.start()])
        at = m.end()
        if not m["tag"]:
            continue
        tag = m["tag"].lower()
        if stack[-1].hidden and not m["end"]:
            if stack[-1].tag == "head" and tag not in _IN_HEAD:
                stack.pop()
            elif tag in _NOT_IN_SVG:
                for i in range(len(stack) - 1, 0, -1):
                    if not stack[i].hidden or stack[i].tag == "foreignobject":
                        break
                    if stack[i].tag == "svg":
                        yield from close(i)
                        break
        # Inside hidden elements only the elements are followed, to find their ends.
        if not m["end"] and (stack[-1].hidden or tag in _HIDDEN or tag == "head"):
            foreign = tag == "svg" or any(n.tag == "svg" for n in stack)  # where a slash closes the element
            if tag not in _VOID and not (foreign and m["attrs"].rstrip().endswith("/")) and (tag == "head" or ends_after(tag, at)):
                stack.append(Node(tag, stack[-1].path, stack[-1].dropped, stack[-1].main, hidden=True))
            continue
        if m["end"]:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    yield from close(i)
                    break
            continue
        inline = tag in _INLINE
        if not inline:
            # A block ends an open paragraph, and an item its sibling.
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in _CLOSED_BY_BLOCK and tag not in _VOID or stack[i].tag == tag == _SIBLING_CLOSES.get(tag) or tag in _SIBLING_CLOSES and stack[i].tag == _SIBLING_CLOSES[tag]:
                    yield from close(i)
                    break
                if stack[i].tag not in _INLINE and stack[i].tag not in _CLOSED_BY_BLOCK:
                    break
        up = stack[-1]
        if tag in _VOID:
            if not inline:
                yield up, " "
            continue
        style, bad = (_known_style if len(m["attrs"]) <= _SHORT else _style)(tag, m["attrs"], up.main)
        path = f"{up.path}/{style}" if len(stack) <= DEEPEST and not inline else up.path
        up.children.append(style)
        main = up.main or tag in _MAIN or "main" in style.split(".")[1:]
        never = rules and (bad or (tag in _NEVER and not (tag in ("header", "menu") and up.main)))
        # What stands inside an article or main element is content, however little of it is the page's own.
        judged = path in low and path != up.path and tag not in _MAIN and not (rules and up.main)
        node = Node(tag, path, up.dropped or never or judged, main)
        stack.append(node)  # a slash doesn't close an element that isn't void
        if not inline:
            yield node, " "
    if at < len(page):
        yield from read(page[at:])
    yield from close(0)


def extract(page: str | None, low: frozenset[str] = frozenset(), rules: bool = True) -> str:
    """The main text: inside article or main elements where there are any, without dropped branches.

    Where the tree would leave nothing (two pages with one article), it isn't used. Without ``rules``, the tree alone decides.
    """
    inside: list[str] = []
    everywhere: list[str] = []
    has_main = False
    for node, text in walk(page or "", low, rules):
        text = " " if text is None and node.tag not in _INLINE else text or ""
        has_main = has_main or (rules and node.main and not node.dropped)
        if not node.dropped:
            everywhere.append(text)
            inside.append(text if node.main else " ")
    text = " ".join(_html.unescape("".join(inside if has_main else everywhere)).split())
    return text if text or not low else extract(page, frozenset(), rules)


def _signature(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True)


def host_of(url: str | None) -> str:
    m = re.match(r"^[a-z][a-z0-9+.-]*://([^/?#]*)", url or "", re.I)
    return m[1].lower() if m else ""


def template_of(paths: Iterable[str]) -> int:
    """Pages with equal sets of paths have one template."""
    return _signature("\n".join(sorted(set(paths) | {""})))


def template(page: str | None) -> int:
    return template_of(node.path for node, text in walk(page or "") if text is None)


def _tree_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def out(found: dict[tuple[str, str, int, int], list[float]]) -> pa.RecordBatch:
        keys, sums = list(found), list(found.values())
        columns = [pa.array([k[i] for k in keys], kind) for i, kind in enumerate((pa.string(), pa.string(), pa.int32(), pa.int64()))]
        return pa.RecordBatch.from_arrays([*columns, *(pa.array([x[i] for x in sums], pa.float64()) for i in range(3))], names=["host", "path", "kind", "signature", "n", "n_ln_n", "words"])

    found: dict[tuple[str, str, int, int], list[float]] = {}

    def add(key: tuple[str, str, int, int], n: int, words: int) -> None:
        sums = found.setdefault(key, [0.0, 0.0, 0.0])
        sums[0] += n
        sums[1] += n * log(n)
        sums[2] += words

    for batch in slices(batches):
        for url, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            host = host_of(url)
            styles: dict[str, list[str]] = {"": []}
            contents: dict[str, list[str]] = {}
            for node, text in walk(page or ""):
                if text is None:
                    styles.setdefault(node.path, []).extend(node.children)
                    if node.tag not in _INLINE and node.path in contents:
                        contents[node.path].append("\n")
                else:
                    contents.setdefault(node.path, []).append(text)
            sentences: dict[str, Counter] = {path: Counter(x for x in map(" ".join, map(str.split, _SENTENCE_END.split("".join(texts)))) if x) for path, texts in contents.items()}
            sizes = {x: x.count(" ") + 1 for found_here in sentences.values() for x in found_here}
            total = sum(n * sizes[x] for found_here in sentences.values() for x, n in found_here.items())
            whole = _signature("\n".join(x for path in styles for x in sentences.get(path, ())))
            own = template_of(styles)
            for path, children in styles.items():
                add((host, path, STYLE, _signature(" ".join(children))), 1, total)
                add((host, path, PAGE, whole), 1, 0)
                add((host, path, TEMPLATE, own), 1, 0)
                for x, n in sentences.get(path, {}).items():
                    add((host, path, SENTENCE, _signature(x)), n, n * sizes[x])
        if len(found) > 200_000:
            yield out(found)
            found.clear()
    yield out(found)


def branch_counts(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(host, path, kind, signature, n, n_ln_n, words), written once, as the tree and the templates would else each parse all pages.

    Kinds: ``STYLE``, a sequence of child styles (words: those of the pages
    that have it); ``SENTENCE`` (n occurrences, n_ln_n summed over pages, and
    the words they make); ``PAGE``, the text of the page that the node is on;
    ``TEMPLATE``, that page's template.
    """
    counts = pages.select(F.col(url_col).alias("url"), F.col(html_col).alias("html")).mapInArrow(_tree_counts, "host string, path string, kind int, signature long, n double, n_ln_n double, words double")
    return stored(counts.groupBy("host", "path", "kind", "signature").agg(F.sum("n").alias("n"), F.sum("n_ln_n").alias("n_ln_n"), F.sum("words").alias("words")), "style-counts")


def style_tree(counts: DataFrame) -> DataFrame:
    """(host, path, parent, pages, entropy, presentation, words, importance, share): the merged tree of each host.

    entropy: that of the texts of the pages that have the node, in nats; where
    it is 0 (one page, or copies of one) nothing can be judged. presentation:
    the entropy of its child styles relative to that. importance, of a branch:
    the part of its words (and of its nodes, each of which counts as one word)
    that is not shared between pages, from 0 to 1. share: such words relative
    to all words of its pages.
    """
    spread = F.log(F.sum("n")) - F.sum(F.col("n") * F.log("n")) / F.sum("n")
    styles = counts.where(F.col("kind") == STYLE).groupBy("host", "path").agg(F.sum("n").alias("pages"), F.sum("words").alias("page_words"), spread.alias("_shapes"))
    texts = counts.where(F.col("kind") == PAGE).groupBy("host", "path").agg(spread.alias("entropy"))
    # Of one sentence: its entropy over pages, times the words it makes. Sums need no join before they are small.
    of_one = F.col("words") * (F.log("n") - F.col("n_ln_n") / F.col("n"))
    content = counts.where(F.col("kind") == SENTENCE).groupBy("host", "path").agg(F.sum("words").alias("own_words"), F.sum(of_one).alias("_spread"))
    nodes = styles.join(texts, ["host", "path"]).join(content, ["host", "path"], "left").fillna(0.0, ["own_words", "_spread"])
    judged = F.col("entropy") > 1e-9  # entropies of equal pages are 0 up to rounding
    relative = lambda x: F.when(judged, F.least(F.lit(1.0), x / F.col("entropy"))).otherwise(1.0)
    nodes = nodes.withColumn("presentation", F.greatest(F.lit(0.0), relative(F.col("_shapes"))))
    nodes = nodes.withColumn("_own", F.col("own_words") * (1 - F.when(judged & (F.col("own_words") > 0), F.greatest(F.lit(0.0), relative(F.col("_spread") / F.col("own_words")))).otherwise(0.0)))
    # What a node has counts for it and every node above it.
    steps = F.split("path", "/")
    above = F.explode(F.transform(F.sequence(F.lit(1), F.size(steps)), lambda i: F.array_join(F.slice(steps, F.lit(1), i), "/")))
    sums = nodes.select("host", above.alias("path"), "_own", "own_words", "pages", (F.col("pages") * F.col("presentation")).alias("_shown")).groupBy("host", "path")
    branches = sums.agg(F.sum("_own").alias("_info"), F.sum("own_words").alias("words"), F.sum("pages").alias("_nodes"), F.sum("_shown").alias("_shown"))
    tree = nodes.select("host", "path", "pages", "page_words", "entropy", "presentation").join(branches, ["host", "path"])
    return tree.select(
        "host", "path", F.when(F.col("path") != "", F.regexp_replace("path", "/[^/]*$", "")).alias("parent"), "pages", "entropy", "presentation", "words",
        ((F.col("_info") + F.col("_shown")) / (F.col("words") + F.col("_nodes"))).alias("importance"),
        F.when(F.col("page_words") > 0, F.col("_info") / F.when(F.col("page_words") > 0, F.col("page_words"))).otherwise(1.0).alias("share"),
    )


def low_branches(tree: DataFrame) -> DataFrame:
    """(host, path, why): branches that the pages of a host repeat, and those that are minor beside a sibling with most of the page."""
    tag = F.regexp_extract("path", r"([^/.]*)[^/]*$", 1)
    holds = tag.isin(CONTAINERS)
    mains = tree.where((F.col("share") >= MAIN_SHARE) & holds).groupBy("host", "parent").agg(F.sum("pages").alias("_main_pages"))
    seen = tree.join(mains, ["host", "parent"], "left").where((F.col("path") != "") & (F.col("pages") >= 2) & (F.col("entropy") > 1e-9))
    minor = holds & (F.col("share") < LEAST_SHARE) & (F.col("_main_pages") >= F.col("pages"))
    return seen.select("host", "path", F.when(F.col("importance") < LEAST_IMPORTANCE, "repeats").when(minor, "minor").alias("why")).where("why IS NOT NULL")


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``id_col``, ``url_col``, text and n_chars (code points) for each row.

    Blocks are joined by one space, white space inside them is one space. A
    null or empty html gives the empty text. Pages without a host share the
    host ``""``. Rows pass one by one: repeated rows give repeated results (and
    weigh twice in the tree); a null id or url is passed through. Other
    columns are left out. An empty table gives no rows.
    """
    counts = branch_counts(pages, url_col, html_col)
    weak = low_branches(style_tree(counts)).select("host", "path")
    # Low branches are listed for each template of a host: a list is no longer than the paths of one page.
    have = counts.where(F.col("kind") == TEMPLATE).select("host", "path", F.col("signature").alias("template"))
    weak = stored(have.join(weak, ["host", "path"]).groupBy("host", "template").agg(F.collect_list("path").alias("_low")), "style-tree")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            urls, found = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            hosts = pa.array([host_of(url) for url in urls], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, hosts, pa.array([template(page) for page in found], pa.int64())], names=["_id", "_url", "_html", "_host", "_template"])

    kinds = {c: pages.schema[c].dataType.simpleString() for c in (id_col, url_col)}
    inputs = pages.select(F.col(id_col).alias("_id"), F.col(url_col).alias("_url"), F.col(html_col).alias("_html"))
    placed = inputs.mapInArrow(place, f"_id {kinds[id_col]}, _url {kinds[url_col]}, _html string, _host string, _template long")
    # Where the lists are too large to broadcast, the pages of one template go to ``SPREAD`` tasks.
    weak = weak.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))))
    part = F.pmod(F.xxhash64("_html", "_id"), F.lit(SPREAD)).cast("int")
    joined = placed.withColumn("_spread", part).join(weak, (F.col("_host") == F.col("host")) & (F.col("_template") == F.col("template")) & (F.col("_spread") == F.col("_part")), "left").select("_id", "_url", "_html", "_low")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets: dict[tuple[str, ...], frozenset[str]] = {}
        for batch in slices(batches):
            texts = []
            for page, low in zip(batch.column(2), batch.column(3), strict=True):
                key = tuple(low.as_py() or ())
                texts.append(extract(page.as_py(), sets.setdefault(key, frozenset(key))))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["_id", "_url", "text", "n_chars"])

    out = joined.mapInArrow(run, f"_id {kinds[id_col]}, _url {kinds[url_col]}, text string, n_chars long")
    return out.select(F.col("_id").alias(id_col), F.col("_url").alias(url_col), "text", "n_chars")


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return extract_text(read(spark, sf_dir, "pages"))
