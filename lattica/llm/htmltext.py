"""Main text of HTML pages by two-pass block rules.

A page is cut into blocks. The first pass judges each block by itself: link density, length
and stop-word density, and whether it stands in an element that never holds the article. It
leaves short and wordy-but-untypical blocks undecided. The second pass gives each undecided
block the label of its nearest decided neighbours in the same section of the page; a section
without any decided block is the article if it is marked as one. A page without an article
element whose words are hardly ever stop words is in a language without a list: there length and
link density decide. East Asian characters count two to a word, as they stand without spaces.

Names of classes and ids mark whole parts of a page. On a heading or paragraph inside an article
only a name that is such a word by itself counts (``ad``, not ``share-price``), on a heading no id
does, and names that tell of a layout (``with-sidebar``, ``menu-open``) count nowhere.

Each page is judged alone in its task; nothing is shuffled.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

MAX_LINK_DENSITY = 0.5
SHORT_WORDS, LONG_WORDS, STOP_DENSITY, RARE_STOPS = 8, 25, 0.2, 0.05

#: HTML element names, the words by which pages name their parts, common words.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW_TAGS = frozenset("script style textarea title template noscript iframe noembed noframes desc metadata annotation annotation-xml".split())
NEVER_TAGS = frozenset("nav footer aside form dialog menu button select head".split())
NEVER_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form".split())
NEVER_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored sponsors promo promotion banner sidebar menu nav navbar navigation "
    "breadcrumb breadcrumbs footer masthead cookie cookies consent gdpr notice notices notification popup modal overlay newsletter subscribe "
    "signup login paywall comment comments disqus replies respondents share sharing social related recommended widget widgets toolbar "
    "copyright pagination pager skip".split()
)
LAYOUT_STARTS = frozenset("no not with without has is".split())
LAYOUT_ENDS = frozenset("open opened closed active enabled disabled visible hidden collapsed expanded".split())
HEADER_NAMES = frozenset(["header", "topbar"])
COMMENT_NAMES = frozenset(["comment", "comments", "disqus", "replies", "reply"])
STOP_WORDS = frozenset(
    "a about all also an and are as at be been but by can for from had has have he her his if in into is it its more no not of on one or our out "
    "she so some than that the their there they this to up was we were what when which who will with would you your "
    "aber als am an auch auf aus bei bin bis da das dem den der des die dies durch ein eine einem einen einer er es für hat ich ihr im in ist "
    "mit nach nicht noch nur oder sein sich sie sind über um und uns unter vom von vor war wie wir wird zu zum zur "
    "au aux avec ce ces dans de des du elle en est et il ils je la le les leur lui mais ne nous on ou où par pas plus pour qu que qui sa se ses "
    "son sont sur un une vous "
    "al como con cuando de del desde donde el ella en entre era es esta este fue ha hay la las lo los más me muy no o para pero por que se si sin "
    "sobre su sus también un una y ya".split()
)

_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|[^<]+|<""",
    re.DOTALL,
)
_NAMES = re.compile(r"""\b(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.IGNORECASE)
_WORD = re.compile(r"[^\W\d_]+")
_EAST_ASIAN = re.compile("[\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]")
_TEXT_TAGS = frozenset("p h1 h2 h3 h4 h5 h6".split())


@dataclass
class Block:
    section: int
    article: bool
    never: bool
    heading: bool
    listed: bool = False
    text: list[str] = field(default_factory=list)
    linked: int = 0


@dataclass
class _Open:
    tag: str
    never: bool
    article: bool
    comment: bool
    section: int


def _names(attributes: str, whole: bool, ids: bool) -> tuple[set[str], set[str]]:
    """The words of classes, ids and roles; with ``whole`` only names of one word, without ``ids`` no ids."""
    names, roles = set(), set()
    for kind, value in _NAMES.findall(attributes):
        kind = kind.lower()
        if kind == "id" and not ids:
            continue
        for name in value.strip("\"'").split():
            words = [w for w in re.split(r"[^a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", name).lower()) if w]
            if kind == "role":
                roles.update(words)
            elif words and not (len(words) > 1 and (whole or words[0] in LAYOUT_STARTS or words[-1] in LAYOUT_ENDS)):
                names.update(words)
    return names, roles


def page_blocks(page: str) -> list[Block]:
    """The page's blocks in order, with character references decoded."""
    blocks: list[Block] = []
    stack: list[_Open] = [_Open("", False, False, False, 0)]
    sections, current, links, breaks = 0, None, 0, 0
    at, n = 0, len(page)
    while at < n:
        token = _TOKEN.match(page, at)
        at = token.end()
        slash, tag, attributes = (token[1], token[2], token[3]) if token[2] else (token[4], token[5], token[6])
        if not tag:
            text = token[0]
            if text.startswith(("<!", "<?")) and len(text) > 2:
                continue
            top = stack[-1]
            if current is None:
                if text.isspace():
                    continue
                current = Block(top.section, top.article, top.never, False, top.tag == "li")
                blocks.append(current)
            text = html.unescape(text)
            current.text.append(text)
            if links > 0:
                current.linked += len("".join(text.split()))
            if not text.isspace():
                breaks = 0
            continue
        tag = tag.lower()
        if not slash and tag in RAW_TAGS:
            close = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.IGNORECASE).search(page, at)
            at = close.end() if close else at if attributes.endswith("/") else n
            continue
        if tag == "br":
            breaks += 1
            if breaks > 1:
                current = None
            elif current is not None:
                current.text.append(" ")
            continue
        if tag == "a":
            links = 0 if slash else 1
        block = tag in BLOCK_TAGS
        if block:
            current, links, breaks = None, 0, 0
        if slash:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    del stack[k:]
                    break
                if stack[k].tag in ("article", "main", "body") and tag not in ("body", "html", "article", "main"):
                    break
            continue
        if tag in VOID_TAGS or attributes.endswith("/"):
            continue
        if block and stack[-1].tag == "p":
            stack.pop()
        if tag in ("li", "option", "td", "th", "tr", "dd", "dt") and stack[-1].tag == tag:
            stack.pop()
        if not block and not attributes and tag not in NEVER_TAGS:
            continue
        top = stack[-1]
        in_text = top.article and tag in _TEXT_TAGS
        names, roles = _names(attributes, in_text, not (in_text and tag != "p")) if attributes else (set(), set())
        comment = top.comment or bool(names & COMMENT_NAMES)
        if tag in ("html", "body"):
            never, article = False, False
        elif tag in ("article", "main"):
            never, article = comment, not comment
        else:
            article = top.article
            never = top.never or tag in NEVER_TAGS or bool(names & NEVER_NAMES) or bool(roles & NEVER_ROLES) or comment
            never = never or not article and (tag == "header" or bool(names & HEADER_NAMES))
        if tag in ("article", "main", "section", "body") or never != top.never:
            sections += 1
            section = sections
        else:
            section = top.section
        if block or never:
            stack.append(_Open(tag, never, article, comment, section))
        if tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
            current = Block(section, article, never, True)
            blocks.append(current)
    return blocks


def _words(text: str) -> tuple[list[str], int]:
    """The lower-case words of a block and its length in words."""
    words = [w.lower() for w in _WORD.findall(text)]
    return words, len(words) if text.isascii() else len(words) + len(_EAST_ASIAN.findall(text)) // 2


def judge(block: Block, text: str, listed_language: bool = True) -> bool | None:
    """First pass: article text, not article text, or undecided."""
    if block.never:
        return False
    letters = len("".join(text.split()))
    words, length = _words(text)
    if letters and block.linked / letters > MAX_LINK_DENSITY:
        return None if block.article and not block.listed else False
    if block.heading or length < SHORT_WORDS:
        return None
    stops = sum(w in STOP_WORDS for w in words)
    if stops >= STOP_DENSITY * length or length >= LONG_WORDS and (block.article or not listed_language):
        return True
    return None if block.article or length < LONG_WORDS else False


def _in_listed_language(blocks: list[tuple[Block, str]]) -> bool:
    """Does the page mark its article, or are its words stop words often enough for the lists to judge it?"""
    stops = total = 0
    for block, text in blocks:
        if block.never:
            continue
        if block.article:
            return True
        words, length = _words(text)
        stops += sum(w in STOP_WORDS for w in words)
        total += length
    return stops >= RARE_STOPS * total


def main_text(page: str | None) -> str:
    """The article's blocks, one line each; empty where the page has none."""
    if not page:
        return ""
    blocks = [(b, t) for b in page_blocks(page) if (t := " ".join("".join(b.text).split()))]
    listed = _in_listed_language(blocks)
    labels = [judge(b, t, listed) for b, t in blocks]
    return "\n".join(t for (_, t), keep in zip(blocks, _settled([b for b, _ in blocks], labels), strict=True) if keep)


def _settled(blocks: list[Block], labels: list[bool | None]) -> list[bool]:
    """Second pass: an undecided block takes the label of its nearest decided neighbours.

    The neighbours before and after must stand in the same part of the page (the article, or
    outside it); lists of links inside an article decide nothing about their surroundings. Where they differ the nearer counts; at equal distance a heading goes with
    what follows and any other block with what is article text.
    """
    n = len(blocks)
    before: list[int | None] = [None] * n
    after: list[int | None] = [None] * n
    for places, order in ((before, range(n)), (after, range(n - 1, -1, -1))):
        last: dict[bool, int] = {}
        for k in order:
            part = blocks[k].article and not blocks[k].never
            if labels[k] is None:
                places[k] = last.get(part)
            elif not blocks[k].never and not (part and blocks[k].listed):
                last[part] = k
    found = []
    for k in range(n):
        if labels[k] is not None:
            found.append(labels[k])
            continue
        a, b = before[k], after[k]
        if a is None and b is None:
            found.append(blocks[k].article)
        elif a is None or b is None:
            found.append(bool(labels[a if b is None else b]))
        elif labels[a] == labels[b]:
            found.append(bool(labels[a]))
        elif blocks[k].heading:
            found.append(bool(labels[b]))
        elif k - a != b - k:
            found.append(bool(labels[a if k - a < b - k else b]))
        else:
            found.append(True)
    return found


def extract_pages(pages: DataFrame) -> DataFrame:
    """Main text of every page: page_id, url, text, n_chars (code points).

    A null or empty page, or one without an article, gives empty text. Rows with null or
    repeated ids are handled like any other.
    """

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(page) for page in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id").cast(pa.int64()), batch.column("url").cast(pa.string()), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                ["page_id", "url", "text", "n_chars"],
            )

    return pages.select("page_id", "url", "html").mapInArrow(extract, "page_id long, url string, text string, n_chars long")
