"""Operator 7: main text of a page by two-pass block rules.

A linear scan cuts the page into blocks and notes, for each, its words, the part of them inside links, its stop words, and
the elements around it. Pass one decides blocks by link density, length and stop-word density; mark-up that names page
furniture or an article shifts the bar, and pages without any such mark-up are decided by the words alone. Ambiguous short
blocks stay open and, in pass two, take the label of the nearest decided neighbours within the same part of the page.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lettermill.llm.common import batches_of, rows_of

#: Tags that end a block.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body br button caption center col colgroup dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html "
    "iframe legend li main menu nav noscript ol optgroup option p pre search section select summary table tbody td template textarea tfoot th thead title tr ul video audio canvas object".split()
)
#: Elements whose content is no text of the page.
RAW_TAGS = frozenset("script style noscript template textarea svg math iframe object audio video canvas select title noframes noembed xmp".split())
#: Elements of page furniture.
FURNITURE_TAGS = frozenset("nav footer aside form header menu dialog button fieldset".split())
#: Elements that have no end tag.
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr frame keygen command".split())
#: Elements that hold the main text.
MAIN_TAGS = frozenset("article main".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that hold blocks and so say which blocks are neighbours.
HOLDERS = frozenset("article aside blockquote body center details dialog div dl fieldset figure footer form header html main menu nav ol section table tbody td tr ul".split())
#: Words in class, id and role that name page furniture.
FURNITURE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsense banner sponsor sponsored sponsorship promo promoted promotion outbrain taboola "
    "nav navbar navigation menu menubar breadcrumb breadcrumbs pagination pager toolbar topbar masthead "
    "header footer sidebar sidenav aside rail widget widgets related recommended recirculation trending popular "
    "cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup signin login paywall "
    "comment comments commentlist disqus respond reply replies discussion "
    "share sharing social follow form search searchbox copyright legal disclaimer skip contentinfo complementary advertisment".split()
)
#: Words in class, id and role that name the main text, so that a furniture word beside them does not count.
MAIN_WORDS = frozenset("article articlebody post entry story content maincontent main body text".split())
#: Frequent words of English, German, French and Spanish.
STOP_WORDS = frozenset(
    "the of and to in a is that it for was on are with as be this by at from have has had not but or an they which you we he she his her their its were been "
    "der die das und in zu den mit von für auf ist im dem nicht ein eine einer als auch es an werden aus er hat dass sie nach wird bei sich wir ich noch nur "
    "le la les de des du et en un une est que qui dans pour par sur au aux ce cette avec pas plus il elle on nous vous se ne sont son sa ses ou mais "
    "el los las del y que en un una por con no para su al lo como más o pero sus le ya fue este ha si porque esta entre cuando muy sin sobre también me hay donde".split()
)
#: A block with a larger part of its words in links is furniture; shorter than SHORT words it stays open; from LONG on a few stop words
#: are enough, and from MASS on, where no more than FEW_LINKS of its words are in links, none are needed: the stop words are of four languages only.
LINKS, FEW_LINKS, SHORT, LONG, MASS = 0.5, 0.2, 10, 25, 40
#: Least part of stop words in a block that counts as prose, and in one that may.
STOP_HIGH, STOP_LOW = 0.15, 0.05

_TAG_NAME = re.compile(r"/?[A-Za-z][A-Za-z0-9:_-]*")
_ATTRIBUTES = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.IGNORECASE)
_NAME_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_LETTERS = re.compile(r"[^\W\d_]+")
_QUOTE_OR_END = re.compile(r"""["'>]""")


class Block:
    __slots__ = ("text", "words", "linked", "heading", "node", "main", "furniture", "label")

    def __init__(self, text: str, words: int, linked: int, heading: bool, node: int):
        self.text, self.words, self.linked, self.heading, self.node = text, words, linked, heading, node
        self.main = self.furniture = False
        self.label = ""


class Nodes:
    """The elements that hold blocks, each after the one around it; node 0 is the page."""

    def __init__(self):
        self.around, self.furniture, self.main = [0], [False], [False]

    def add(self, around: int, furniture: bool, main: bool) -> int:
        self.around.append(around)
        self.furniture.append(furniture)
        self.main.append(main or self.main[around])
        return len(self.around) - 1

    def settle(self) -> None:
        """Hands each mark of furniture on to the nodes inside."""
        for k in range(1, len(self.around)):
            self.furniture[k] = self.furniture[k] or self.furniture[self.around[k]]


def _names_furniture(attributes: str) -> bool:
    for name, value in _ATTRIBUTES.findall(attributes):
        name, value = name.lower(), value.strip("\"'")
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.IGNORECASE):
            return True
        if name in ("class", "id", "role"):
            for token in value.split():
                parts = [p.lower() for p in _NAME_PARTS.findall(token)]
                if parts and any(p in FURNITURE_WORDS for p in parts) and not parts[-1:] == ["body"] and not (parts[0] in MAIN_WORDS and len(parts) > 1 and parts[-1] in ("header", "text", "content")):
                    return True
    return False


def _tag_end(page: str, at: int, dead: set[int]) -> int:
    """Where the first `>` outside of quotes is, from `at` on; -1: nowhere. `dead` keeps the opening quotes from which no way leads to one, so that no quote is followed twice."""
    seen = []
    while m := _QUOTE_OR_END.search(page, at):
        if m[0] == ">":
            return m.start()
        if m.start() in dead:
            break
        seen.append(m.start())
        at = page.find(m[0], m.end()) + 1
        if not at:
            break
    dead.update(seen)
    return -1


def scan(page: str) -> tuple[list[Block], Nodes]:
    """The page's blocks in order, and the elements around them.

    Linear in the page's length; broken mark-up never raises: an open tag, comment or script runs to where the page ends.
    """
    out: list[Block] = []
    pieces: list[str] = []
    linked = 0
    nodes = Nodes()
    open_tags: list[tuple[str, int]] = []  # name, and the node that it is or is in
    places: dict[str, list[int]] = {}  # of each name in open_tags
    wraps: list[int] = []  # nodes of open forms, whose mark is void once an article or its heading is found inside
    dead: set[int] = set()
    links = 0
    heading = False
    no_end: set[str] = set()

    def here() -> int:
        return open_tags[-1][1] if open_tags else 0

    def flush() -> None:
        nonlocal linked, heading
        if pieces:
            text = " ".join("".join(pieces).split())
            if text:
                out.append(Block(text, text.count(" ") + 1, linked, heading, here()))
            pieces.clear()
        linked = 0

    def close(k: int) -> None:
        nonlocal links
        while len(open_tags) > k:
            name, node = open_tags.pop()
            places[name].pop()
            links -= name == "a"
            if wraps and wraps[-1] == node and here() != node:
                wraps.pop()

    at, size = 0, len(page)
    while at < size:
        lt = page.find("<", at)
        if lt < 0:
            lt = size
        if lt > at:
            text = html.unescape(page[at:lt])
            pieces.append(text)
            if links:
                linked += len(text.split())
        if lt >= size:
            break
        if page.startswith("<!--", lt):
            end = page.find("-->", lt + 4)
            at = size if end < 0 else end + 3
            continue
        after = page[lt + 1 : lt + 2]
        if after in ("!", "?"):
            end = page.find(">", lt)
            at = size if end < 0 else end + 1
            continue
        m = _TAG_NAME.match(page, lt + 1)
        if m is None:
            pieces.append("<")
            at = lt + 1
            continue
        end = page.find(">", m.end())
        if end < 0:
            break  # a tag that the page's end cuts off
        attributes = page[m.end() : end]
        if attributes.count('"') % 2 or attributes.count("'") % 2:
            whole = _tag_end(page, m.end(), dead)
            end = end if whole < 0 else whole
            attributes = page[m.end() : end]
        at = end + 1
        name = m[0].lower()
        if name[0] == "/":
            name = name[1:]
            if name in BLOCK_TAGS:
                flush()
                heading = False
            if places.get(name):
                around = () if name in MAIN_TAGS or name == "body" else (*MAIN_TAGS, "body")
                if all(places[name][-1] > places[x][-1] for x in around if places.get(x)):  # an end tag never closes the article around it
                    close(places[name][-1])
            continue
        if name in BLOCK_TAGS:
            flush()
            heading = name in HEADINGS
        if name in RAW_TAGS:
            if attributes.endswith("/") and name in ("svg", "math", "iframe", "object", "canvas"):
                continue
            if name not in no_end:
                m = re.compile(rf"</{name}\b[^>]*>", re.IGNORECASE).search(page, at)
                if m:
                    at = m.end()
                    continue
                no_end.add(name)
            if name in ("script", "style"):
                break
            continue
        if name in VOID_TAGS or attributes.endswith("/"):
            continue
        if name in ("p", "li", "td", "th", "tr", "dt", "dd", "option") and open_tags and open_tags[-1][0] == name:
            close(len(open_tags) - 1)
        node = here()
        is_main = name in MAIN_TAGS
        if is_main or name == "h1":
            for k in wraps:
                nodes.furniture[k] = False
            wraps.clear()
        named = bool(attributes.strip()) and not is_main and _names_furniture(attributes)
        is_furniture = name not in ("html", "body") and (named or name in FURNITURE_TAGS) and not (name == "header" and nodes.main[node])
        if is_main or is_furniture or name in HOLDERS:
            node = nodes.add(node, is_furniture, is_main)
            if name == "form" and is_furniture:
                wraps.append(node)
        places.setdefault(name, []).append(len(open_tags))
        open_tags.append((name, node))
        links += name == "a"
    flush()
    nodes.settle()
    for b in out:
        b.main, b.furniture = nodes.main[b.node], nodes.furniture[b.node]
    return out, nodes


def stop_words(text: str) -> int:
    return sum(w in STOP_WORDS for w in _LETTERS.findall(text.lower()))


def decide(found: list[Block]) -> None:
    """Pass one: labels the blocks that their words, links and mark-up decide; the others stay open.

    Link density speaks first, then length and stop-word density together. Mark-up shifts the bar: nothing passes it in
    furniture, and on a page with an article a block outside must be twice as long and dense in stop words.
    """
    has_main = any(b.main and not b.furniture for b in found)
    for b in found:
        density = stop_words(b.text) / b.words if b.words >= SHORT else 0.0
        if b.furniture:
            b.label = "bad"
        elif b.linked > LINKS * b.words:
            b.label = "" if b.main and b.heading else "bad"
        elif has_main and not b.main:
            b.label = "good" if b.words >= 2 * LONG and density >= STOP_HIGH else "bad"
        elif b.words >= LONG and density >= STOP_LOW or b.words >= SHORT and density >= STOP_HIGH:
            b.label = "good"
        elif b.words >= MASS and b.linked <= FEW_LINKS * b.words:
            b.label = "good"


def inherit(found: list[Block], nodes: Nodes) -> None:
    """Pass two: an open block takes the label of its nearest decided neighbours.

    Neighbours are sought in the element around the block, then in the one around that, and so on; furniture is nobody's
    neighbour. Where the two sides differ the nearer one counts, and the one that is good where they tie; a heading goes with what
    follows it. Without any neighbour a block is good inside an article and bad elsewhere.
    """
    size = len(nodes.around)
    first, last, near = [len(found)] * size, [-1] * size, [0] * size
    decided = [k for k, b in enumerate(found) if b.label and not b.furniture]
    for k in decided:
        node = found[k].node
        first[node], last[node] = min(first[node], k), max(last[node], k)
    for node in range(size - 1, 0, -1):
        around = nodes.around[node]
        first[around], last[around] = min(first[around], first[node]), max(last[around], last[node])
    for node in range(1, size):
        near[node] = node if last[node] >= 0 else near[nodes.around[node]]
    for k, b in enumerate(found):
        if b.label:
            continue
        scope, at = near[b.node], bisect_left(decided, k)
        before, after = decided[at - 1] if at else -1, decided[at] if at < len(decided) else len(found)
        was = found[before].label if first[scope] <= before else ""
        then = found[after].label if after <= last[scope] else ""
        if b.main:  # what is outside of the article says nothing of the inside
            was = was if was and found[before].main else ""
            then = then if then and found[after].main else ""
        b.label = _of_two(was, k - before, then, after - k, b.heading) or ("good" if b.main else "bad")


def _of_two(was: str, back: int, then: str, ahead: int, heading: bool) -> str:
    if was == then or not then:
        return was
    if not was or heading:
        return then
    return was if back < ahead else then if ahead < back else "good"


def label(page: str) -> list[Block]:
    """The page's blocks, each labelled `good` or `bad`."""
    found, nodes = scan(page)
    decide(found)
    inherit(found, nodes)
    return found


def main_text(page: str) -> str:
    return " ".join([b.text for b in label(page) if b.label == "good"])


EXTRACTED = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string())])


def extract_main_text(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Columns page_id, url, text, one row for each row of `df`.

    A null page is empty; a page without main text gives the empty string; repeated rows give repeated results; null ids and
    urls stay null; an empty table gives no rows; other columns are not carried. One pass without a shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return batches_of(((key, url, main_text(body.decode("utf-8", "replace"))) for key, url, body in rows_of(batches)), EXTRACTED)

    source = df.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).cast("binary").alias("body"))
    return source.mapInArrow(run, "page_id long, url string, text string")
