"""Main text of web pages by tree scoring.

`main_text(pages, html)` adds `text` and `n_chars`. Tasks turn each page's tags into flat lists (elements in page order with
their parents, runs of text with their blocks); all further steps are arrays over the elements of many pages at once:

1. Elements that are never article go with all they hold: by tag, by role, hidden ones, and by the words of class and
   id (a menu, an advert, reader comments ...) unless the element holds a level-one heading, `<main>` or an `<article>`
   that is no comment itself, or, in a page without these, most of the text.
2. A block with text is a paragraph. Its points (one, one per comma, one per 100 characters up to three, times its
   share of text outside links) go whole to its parent, by half to the next ancestor and by 1/(3 level) up to `LEVELS`
   ancestors. Text right inside a container counts as a paragraph of that container. What a container gathers is
   discounted by the share of its text inside links.
3. The container with most points is taken (the first one in page order on a tie); if it lies in an `<article>` or
   `<main>`, that whole element. Siblings stay that have a fifth of its points, or are prose (80 characters, a quarter
   in links at most), and headings before it.
4. Lists of links inside it (three links, four fifths of the text) are menus and go.

Defined results: a null or empty page, and one without text outside the dropped elements, gives '' and 0. Text is never
shortened. Character references are decoded; white space is what Unicode calls so; `<br>` and blocks part words, inline
elements do not. Broken markup is read as browsers do in essence: implied ends, unknown end tags ignored, an open tag at
the end of the page dropped, an open comment ends with the page. Repeated rows stay rows of their own; other columns are
kept, those called `text` and `n_chars` are replaced. Long and deeply nested pages cost linear time.
"""

from __future__ import annotations

import html as references
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hushframe.llm.common import slices

LEVELS = 5
SIBLING_SHARE = 0.2
PROSE_CHARS = 80
PROSE_LINKS = 0.25
MENU_LINKS = 3
MENU_SHARE = 0.8

# Element names of HTML and usual words of class and id attributes.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html li main menu nav ol optgroup option p pre search section summary table tbody td "
    "tfoot th thead title tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style xmp iframe noembed noframes textarea title".split())
DROPPED = frozenset(
    "aside audio button canvas datalist dialog embed fieldset footer form head header iframe input menu nav noembed noframes "
    "noscript object optgroup option script search select style svg template textarea title video".split()
)
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar tablist".split())
BOILERPLATE = frozenset(
    "ad ads adsense advert adverts advertisement advertising advertisements banner breadcrumb breadcrumbs comment comments consent "
    "cookie cookies copyright disclaimer discussion disqus footer form gdpr header login masthead menu menus modal nav navbar "
    "navigation newsletter notice notices notification outbrain overlay pager pagination paywall popup promo promos promoted "
    "promotion recommended related replies reply respond responses rss share sharing sidebar sidebars signin signup skyscraper "
    "social sponsor sponsored sponsors subscribe subscription taboola toolbar topbar widget widgets".split()
)
COMMENTS = frozenset("comment comments discussion disqus replies reply respond responses".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Blocks whose points begin with their parent; text right inside any other block counts for that block itself.
PARAGRAPHS = HEADINGS | frozenset("p pre blockquote li td th dd dt figcaption caption summary address".split())
#: An element ends an open one of these names unless one of the barriers was opened in between.
ENDS = {
    "li": (("li",), ("ul", "ol", "menu", "dir")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr", "td", "th"), ("table",)),
    "td": (("td", "th"), ("table", "tr")),
    "th": (("td", "th"), ("table", "tr")),
    "tbody": (("tr", "td", "th", "tbody", "thead", "tfoot"), ("table",)),
    "tfoot": (("tr", "td", "th", "tbody", "thead"), ("table",)),
    "option": (("option",), ("select", "datalist")),
    "body": (("head",), ()),
    "a": (("a",), ("td", "th", "table")),
}
P_BARRIERS = ("table", "td", "th", "caption", "button", "object")
CELLS = ("td", "th", "caption", "table")

TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>""")
PLAIN_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>")
ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
COMMAS = re.compile("[,،、，﹐﹑]")
UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


class Pages:
    """Elements and runs of text of many pages, one after another."""

    def __init__(self) -> None:
        self.tags: list[str] = []
        self.parents: list[int] = []
        self.ends: list[int] = []
        self.verdicts: list[int] = []  # 0 nothing known, 1 its words speak against it, 2 dropped, 3 words of a comment
        self.first: list[int] = []  # first element of each page
        self.runs: list[tuple[int, int, bool, bool, str]] = []  # element, block, in a link, something parts it, text
        self.page_runs: list[int] = []

    def add(self, page: str) -> None:
        """One page: its root element holds everything."""
        tags, parents, ends, verdicts, runs = self.tags, self.parents, self.ends, self.verdicts, self.runs
        root = len(tags)
        self.first.append(root)
        self.page_runs.append(len(runs))
        stack, open_at, blocks, links = [], {}, [], 0
        parted = True

        def push(tag: str, verdict: int) -> None:
            nonlocal links, parted
            node = len(tags)
            tags.append(tag)
            parents.append(stack[-1] if stack else node)
            ends.append(node + 1)
            verdicts.append(verdict)
            if tag in VOID:
                return
            open_at.setdefault(tag, []).append(len(stack))
            stack.append(node)
            if tag in BLOCKS or len(stack) == 1:
                blocks.append(node)
                parted = True
            links += tag == "a"

        def pop_to(depth: int) -> None:
            nonlocal links, parted
            while len(stack) > depth:
                node = stack.pop()
                open_at[tags[node]].pop()
                ends[node] = len(tags)
                if blocks[-1] == node:
                    blocks.pop()
                    parted = True
                links -= tags[node] == "a"

        def depth_of(names: tuple[str, ...]) -> int:
            return max((open_at[n][-1] for n in names if open_at.get(n)), default=-1)

        def text(raw: str) -> None:
            nonlocal parted
            if raw:
                decoded = references.unescape(raw) if "&" in raw else raw
                runs.append((stack[-1], blocks[-1], links > 0, parted, decoded))
                parted = False

        push("#root", 0)
        at, size = 0, len(page)
        while at < size:
            lt = page.find("<", at)
            if lt < 0:
                text(page[at:])
                break
            text(page[at:lt])
            if page.startswith("<!--", lt):
                if page.startswith((">", "->"), lt + 4):  # a comment that ends at once
                    at = page.index(">", lt + 4) + 1
                    continue
                end = page.find("-->", lt + 4)
                at = size if end < 0 else end + 3
                continue
            if page.startswith(("<!", "<?"), lt) or page.startswith("</", lt) and not page[lt + 2 : lt + 3].isalpha():
                end = page.find(">", lt)
                at = size if end < 0 else end + 1
                continue
            found = TAG.match(page, lt) or PLAIN_TAG.match(page, lt)
            if found is None:
                if lt + 1 < size and (page[lt + 1].isascii() and page[lt + 1].isalpha() or page[lt + 1] == "/"):
                    break  # the page ends within a tag
                text("<")
                at = lt + 1
                continue
            at = found.end()
            tag = found[2].lower()
            if found[1]:
                if tag == "br":
                    parted = True
                elif open_at.get(tag) and (tag in CELLS or tag in ("tr", "tbody", "thead", "tfoot") or open_at[tag][-1] > depth_of(CELLS)):
                    pop_to(open_at[tag][-1])
                elif tag in BLOCKS:
                    parted = True
                continue
            if tag in ("br", "hr"):
                parted = True
            if tag in BLOCKS or tag == "hr":
                p = depth_of(("p",))
                if p > depth_of(P_BARRIERS):
                    pop_to(p)
            if tag in ENDS:
                names, barriers = ENDS[tag]
                barrier = depth_of(barriers)
                while (depth := depth_of(names)) > barrier:
                    pop_to(depth)
            push(tag, verdict_of(tag, found[3]) if tag not in DROPPED else 2)
            if found[3].endswith("/") and tag not in VOID and (open_at.get("svg") or open_at.get("math")):
                pop_to(len(stack) - 1)  # drawings and formulas close their elements like this
            elif tag in RAW:
                close = re.compile(f"</{tag}(?=[\\s/>])", re.I).search(page, at)
                at = size if close is None else close.start()
            elif tag == "plaintext":
                text(page[at:])
                break
        pop_to(0)


def verdict_of(tag: str, attributes: str) -> int:
    """What the attributes say about an element."""
    if not attributes or attributes.isspace():
        return 0
    words: set[str] = set()
    for name, double, single, bare in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), double or single or bare
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and UNSEEN.search(value):
            return 2
        if name == "role" and value.strip().lower() in ROLES:
            return 2
        if name in ("class", "id"):
            words.update(w.lower() for w in WORD.findall(value))
    if tag in ("html", "body", "main", "#root") or not words & BOILERPLATE:
        return 0
    return 3 if words & COMMENTS else 1


def spans(marked: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which elements lie in the subtree of a marked one."""
    depth = np.zeros(len(ends) + 1, np.int64)
    nodes = np.flatnonzero(marked)
    np.add.at(depth, nodes, 1)
    np.add.at(depth, ends[nodes], -1)
    return np.cumsum(depth[:-1]) > 0


def below(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sums over subtrees."""
    total = np.concatenate([np.zeros(1, values.dtype), np.cumsum(values)])
    return total[ends] - total[: len(values)]


def extract(pages: list[str]) -> list[str]:
    """The main text of each page."""
    if not pages:
        return []
    found = Pages()
    for page in pages:
        found.add(page)
    n = len(found.tags)
    tags, parents, ends = np.array(found.tags, object), np.array(found.parents), np.array(found.ends)
    verdicts = np.array(found.verdicts)
    page_of = np.zeros(n, np.int64)
    page_of[found.first] = 1
    page_of = np.cumsum(page_of) - 1

    def among(names) -> np.ndarray:
        return np.fromiter((t in names for t in found.tags), bool, n)

    anchors = among(("h1", "main")) | (among(("article",)) & (verdicts == 0))
    drop = (verdicts == 2) | ((verdicts > 0) & (below(anchors.astype(np.int64), ends) - anchors == 0))

    run_node, run_block = (np.array([r[i] for r in found.runs], np.int64) for i in (0, 1))
    run_link = np.array([r[2] for r in found.runs], bool)
    chars = np.array([sum(map(len, r[4].split())) for r in found.runs], np.int64)
    commas = np.array([len(COMMAS.findall(r[4])) for r in found.runs], np.int64)

    def per_block(values: np.ndarray) -> np.ndarray:
        return np.bincount(run_block[seen], values[seen], n) if len(run_block) else np.zeros(n)

    # a page without a heading or an article: words of class and id are not believed of what holds most of its text
    seen = ~spans(verdicts == 2, ends)[run_node]
    text = per_block(chars)
    most = below(text, ends) * 2 > np.bincount(page_of, text)[page_of]
    drop &= (verdicts != 1) | ~most | (np.bincount(page_of, anchors)[page_of] > 0)
    hidden = spans(drop, ends)
    seen = ~hidden[run_node]
    own, own_links, own_commas = per_block(chars), per_block(chars * run_link), per_block(commas)
    share = np.divide(own_links, own, out=np.zeros(n), where=own > 0)
    points = np.where(own > 0, (1 + own_commas + np.minimum(own / 100, 3)) * (1 - share), 0)

    score = np.zeros(n)
    heading = among(HEADINGS)
    payer = np.flatnonzero((points > 0) & ~heading)
    target = np.where(among(PARAGRAPHS)[payer], parents[payer], payer)
    amount, alive = points[payer], np.ones(len(payer), bool)
    for level in range(LEVELS):
        factor = 1 if level == 0 else 0.5 if level == 1 else 1 / (3 * level)
        np.add.at(score, target[alive], amount[alive] * factor)
        alive &= parents[target] != target
        target = parents[target]
    all_chars, all_links = below(own, ends), below(own_links, ends)
    density = np.divide(all_links, all_chars, out=np.zeros(n), where=all_chars > 0)
    score = np.where(hidden, 0, score * (1 - density))

    # the best container of each page, the first one on a tie
    order = np.lexsort((np.arange(n), -score, page_of))
    best = order[found.first]
    whole = among(("article", "main"))
    for i, node in enumerate(best):
        up = node
        while parents[up] != up:
            if whole[up]:
                best[i] = up
                break
            up = parents[up]

    keep = np.zeros(n, bool)
    good = best[score[best] > 0]
    bound = np.zeros(len(found.first))
    bound[page_of[good]] = SIBLING_SHARE * score[good]
    beside = np.full(len(found.first), -1)
    beside[page_of[good]] = np.where(parents[good] != good, parents[good], -1)
    best_of = np.full(len(found.first), -1)
    best_of[page_of[good]] = good
    keep[good] = True
    sibling = (parents == beside[page_of]) & (parents != np.arange(n))
    prose = (all_chars >= PROSE_CHARS) & (density <= PROSE_LINKS) & (score > 0)
    paragraph = among(PARAGRAPHS) & ~heading & (own >= PROSE_CHARS) & (share <= PROSE_LINKS)
    keep |= sibling & ((score > 0) & (score >= bound[page_of]) | prose | paragraph | heading & (np.arange(n) < best_of[page_of]))

    n_links = below(among(("a",)).astype(np.int64), ends)
    menu = among(("ul", "ol", "dl", "div", "table")) & (n_links >= MENU_LINKS) & (density >= MENU_SHARE)
    kept = spans(keep, ends) & ~spans(drop | menu, ends)

    limits = [*found.page_runs, len(found.runs)]
    out = []
    for first, last in zip(limits, limits[1:]):
        parts, cut = [], True
        for node, _, _, parted, text in found.runs[first:last]:
            cut |= parted
            if kept[node]:
                if cut:
                    parts.append(" ")
                parts.append(text)
                cut = False
        out.append(" ".join("".join(parts).split()))
    return out


def main_text(pages: DataFrame, html: str = "html") -> DataFrame:
    """The rows with `text` and `n_chars` (code points)."""

    @F.arrow_udf("string")
    def texts(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            out: list[str] = []
            for some in slices(batch, 2 << 20):
                out += extract([x or "" for x in some.to_pylist()])
            yield pa.array(out, pa.string())

    rest = [c for c in pages.columns if c.lower() not in ("text", "n_chars")]
    found = pages.select(*(F.col(f"`{c}`") for c in rest), texts(F.col(f"`{html}`").cast("string")).alias("text"))
    return found.select("*", F.length("text").cast("long").alias("n_chars"))
