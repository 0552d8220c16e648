"""Main text of web pages by two passes over blocks.

A page is cut into blocks of text. The first pass decides the clear ones by stop-word density, length and link
density, and by the containers that hold them (navigation, forms, adverts, comments and the like are out); short and middling
blocks stay open. The second pass gives each open block the label of its nearest decided neighbours, those of its own
container first.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import bounded, in_parts

SHORT, LONG = 70, 200
STOP_LOW, STOP_HIGH = 0.12, 0.2
LINKS = 0.33
# fixed values: frequent words of five languages
STOP_WORDS = frozenset(
    "a an and are as at be by for from has have he in is it of on or that the this to was were which with you not "
    "le la les un une des du de et est en que qui dans pour pas sur au aux avec ce ne se plus par "
    "der die das und ist in den von zu mit sich des auf für nicht ein eine als auch es an dem im "
    "el los las un una y es por con para se del al como más su lo no "
    "il di che e per non una sono con si da".split()
)
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style template iframe svg head textarea select option button".split())
OUT_TAGS = frozenset("nav footer aside form menu dialog".split())
OUT_ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar toolbar".split())
OUT_NAMES = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|advert\w*|adsense|adslot|sponsor\w*|promo\w*|banner|cookies?|consent|gdpr|notices?|alerts?|popup|modal|overlay|newsletter|"
    r"subscri\w+|signup|sign-up|sidebar|side|related|recommend\w*|share|sharing|social|comments?|commentlist|disqus|repl(?:y|ies)|respond|"
    r"menu|nav|navbar|navigation|breadcrumbs?|footer|site-header|page-header|masthead|topbar|toolbar|pagination|pager|widget|login|search|tags|copyright|legal|disclaimer)(?=$|[\s_-])"
)
OUT_WHOLE = frozenset("ad advert advertisement comment comments promo related reply sidebar sponsored widget".split())
MAIN_NAMES = re.compile(r"(?:^|[\s_-])(?:article|post|entry|story|main)[_-]?(?:body|content|text)?(?=$|[\s_-])")

NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
QUICK = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>\"'<]*)>")  # a tag without quotes
STOP = re.compile(r"[>\"']")
ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role|hidden|style|aria-hidden|itemprop)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
EDGE = re.compile(r"^\W+|\W+$|\d", re.U)


class Tags:
    """The markup of a page from left to right, in time proportional to its length.

    An attribute's value may hold `>` in quotes; where a quote never ends, the tag ends at the first `>`. A tag without any `>` is text.
    """

    def __init__(self, page: str):
        self.page = page
        self.endless: set[int] = set()  # quotes from which no way leads out of a tag
        self.last = page.rfind(">")

    def _end(self, at: int) -> int:
        """Just after the `>` that ends the tag whose name ends here; -1 without one."""
        if at > self.last:
            return -1
        page, passed, begin = self.page, [], at
        while m := STOP.search(page, at):
            if m[0] == ">":
                return m.end()
            close = -1 if m.start() in self.endless else page.find(m[0], m.end())
            passed.append(m.start())
            if close < 0:
                break
            at = close + 1
        self.endless.update(passed)
        return page.find(">", begin) + 1 or -1

    def __iter__(self) -> Iterator[tuple[int, int, str, bool, str]]:
        """(start, end, name in lower case, whether it closes, attributes); comments and declarations have no name. A send() moves on to a place."""
        page, at = self.page, 0
        while (at := page.find("<", at)) >= 0:
            if m := QUICK.match(page, at):
                end, found = m.end(), (m[2].lower(), bool(m[1]), m[3])
            elif page.startswith("<!--", at):
                end = page.find("-->", at + 4)
                end, found = (end + 3 if end >= 0 else len(page)), ("", False, "")
            elif m := NAME.match(page, at):
                end = self._end(m.end())
                found = m[1].lower(), page[at + 1] == "/", page[m.end() : end - 1]
            elif page[at + 1 : at + 2] in ("/", "!", "?") and at < self.last:
                end, found = page.find(">", at) + 1, ("", False, "")
            else:
                end = -1
            if end < 0:
                at += 1
                continue
            moved = yield at, end, *found
            at = end if moved is None else moved

    def after(self, name: str, at: int) -> tuple[int, int]:
        """Start and end of the next end tag of this name; the page's end without one."""
        found = re.compile(rf"</{re.escape(name)}", re.I).search(self.page, at)
        if found is None:
            return len(self.page), len(self.page)
        return found.start(), self.page.find(">", found.end()) + 1 or len(self.page)


@dataclass
class Block:
    text: str
    linked: int
    tag: str
    place: int  # the innermost container
    out: bool
    main: bool
    label: str = ""

    @property
    def heading(self) -> bool:
        return self.tag in HEADINGS


def _kind(tag: str, attributes: str, in_main: bool) -> tuple[bool, bool]:
    """Whether what an element holds is out, and whether it is the main part."""
    found = {}
    for m in ATTRIBUTE.finditer(attributes) if attributes else ():
        found[m[1].lower()] = (m[2] or m[3] or m[4] or "").lower()
    names = f"{found.get('class', '')} {found.get('id', '')}"
    tokens = set(names.split())
    main = tag in ("article", "main") or found.get("role") in ("main", "article") or found.get("itemprop") == "articlebody" or bool(MAIN_NAMES.search(names))
    out = tag in OUT_TAGS or (tag == "header" and not in_main) or found.get("role") in OUT_ROLES or "hidden" in found or found.get("aria-hidden") == "true"
    out = out or "display:none" in found.get("style", "").replace(" ", "") or ("header" in tokens and not in_main)
    # a page or article may be styled for what it holds ("comments-open"), so only whole names count there
    out = out or (bool(tokens & OUT_WHOLE) if tag in ("body", "html", "article", "main") else bool(OUT_NAMES.search(names)))
    return out, main and not out


def blocks_of(page: str) -> list[Block]:
    """Blocks in page order, white space made single, empty ones left out."""
    blocks: list[Block] = []
    stack: list[tuple[str, bool, bool, int, bool]] = [("", False, False, 0, False)]  # tag, out, main, container, left out of its block
    parts: list[str] = []
    linked = anchors = containers = 0
    block_tag = ""

    def close() -> None:
        nonlocal linked
        text = " ".join(html.unescape("".join(parts)).split())
        if text:
            _, out, main, place, _ = stack[-1]
            blocks.append(Block(text, linked, block_tag, place, out, main))
        parts.clear()
        linked = 0

    def text_of(raw: str) -> None:
        nonlocal linked
        if stack[-1][4]:
            return
        parts.append(raw)
        if anchors:
            linked += len(" ".join(html.unescape(raw).split()))

    tags, open_tags, at = Tags(page), Counter(), 0
    found = iter(tags)
    here = next(found, None)
    while here is not None:
        start, end, tag, closes, attributes = here
        if start > at:
            text_of(page[at:start])
        at = end
        if tag in RAW and not closes and not attributes.endswith("/"):
            begin, at = tags.after(tag, at)
            if tag == "head" and (body := re.compile(r"<body[\s>]", re.I).search(page, end, begin)):
                at = body.start()  # a head that was left open
            here = _sent(found, at)
            continue
        if tag and closes:
            if tag == "a":
                anchors = max(0, anchors - 1)
            if tag in BLOCKS:
                close()
                block_tag = ""
            if open_tags[tag]:
                depth = next(i for i in range(len(stack) - 1, 0, -1) if stack[i][0] == tag)
                if any(stack[i][1] != stack[depth - 1][1] and not stack[i][4] for i in range(depth, len(stack))):
                    close()
                open_tags.subtract(x[0] for x in stack[depth:])
                del stack[depth:]
        elif tag and tag not in RAW:
            if tag == "br":
                parts.append(" ")
            if tag in BLOCKS:
                close()
                while len(stack) > 1 and (stack[-1][0] not in BLOCKS or stack[-1][0] == "p" or stack[-1][0] == tag == "li"):
                    open_tags[stack.pop()[0]] -= 1
                block_tag, anchors = tag, 0
            if tag not in VOID and not attributes.endswith("/"):
                anchors += tag == "a"
                _, out, main, place, mute = stack[-1]
                new_out, new_main = _kind(tag, attributes, main)
                new_out = new_out or (tag == "title" and not main)
                mute = mute or (new_out and not out and tag not in BLOCKS)  # something out within a line leaves the block whole
                if tag in BLOCKS and tag not in HEADINGS and tag != "p":
                    containers += 1
                    place = containers
                stack.append((tag, out or new_out, main or new_main, place, mute))
                open_tags[tag] += 1
        here = next(found, None)
    text_of(page[at:])
    close()
    return blocks


def _sent(tags: Iterator, at: int):
    """The next tag from a place on."""
    try:
        return tags.send(at)
    except StopIteration:
        return None


def _nearest(blocks: list[Block], decided: list[bool], own: bool) -> tuple[list[int | None], list[int | None]]:
    """For each block the nearest decided one before and after it, of its own container or of all; one pass each way."""

    def passed(order) -> list[int | None]:
        last: dict[int, int] = {}
        out: list[int | None] = [None] * len(blocks)
        for i in order:
            place = blocks[i].place if own else 0
            out[i] = last.get(place)
            if decided[i]:
                last[place] = i
        return out

    return passed(range(len(blocks))), passed(range(len(blocks) - 1, -1, -1))


def stop_density(text: str) -> float:
    words = text.lower().split()
    return sum(w in STOP_WORDS or EDGE.sub("", w) in STOP_WORDS for w in words) / len(words) if words else 0.0


def classify(blocks: list[Block]) -> None:
    """Sets each block's label to good or bad."""
    density = [stop_density(b.text) for b in blocks]
    words = sum(len(b.text) for b, d in zip(blocks, density, strict=True) if d > 0)
    spoken = words * 4 >= sum(len(b.text) for b in blocks)  # else the page's language has no list here
    for b, d in zip(blocks, density, strict=True):
        size, links = len(b.text), b.linked / max(1, len(b.text))
        if b.out or (links > LINKS and not b.main):
            b.label = "bad"
        elif b.heading:
            b.label = "heading"
        elif not b.main and (b.text[:1] in "©®" or (size < SHORT and links > 0)):
            b.label = "bad"
        elif size < SHORT:
            b.label = "short"
        elif not spoken or d >= STOP_HIGH:
            b.label = "good" if size > LONG or b.main else "near"
        elif d >= STOP_LOW or b.main:
            b.label = "near"
        else:
            b.label = "bad"
    decided = [b.label in ("good", "bad") for b in blocks]
    first = [b.label for b in blocks]

    any_decided = any(decided)
    near = {own: _nearest(blocks, decided, own) for own in (True, False)}

    def nearest(i: int, own: bool) -> list[tuple[int, str] | None]:
        return [None if j is None else (abs(j - i), first[j]) for j in (side[i] for side in near[own])]

    for i, b in enumerate(blocks):
        if decided[i]:
            continue
        before, after = nearest(i, True)
        if before is None and after is None:
            before, after = nearest(i, False)
            if b.main and "good" not in (before and before[1], after and after[1]):
                b.label = "good"
                continue
        if first[i] == "heading" and after is not None:
            b.label = after[1]
            continue
        if not any_decided:
            b.label = "good"
            continue
        if b.main:
            before, after = before or after, after or before
        before, after = before or (i + 1, "bad"), after or (len(blocks) - i, "bad")  # the page's edges count as bad
        if before[1] == after[1]:
            b.label = before[1]
        elif first[i] == "near" or b.main:
            b.label = "good"
        else:
            b.label = min(before, after)[1] if before[0] != after[0] else "bad"


def main_text(page: str | None) -> str:
    if not page:
        return ""
    blocks = blocks_of(page)
    classify(blocks)
    return "\n\n".join(b.text for b in blocks if b.label == "good")


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, the main text of the whole html and its length in code points.

    A null or empty html, or one without a good block, has an empty text. Repeated rows are treated alike; other columns are left out.
    """

    def run(batches):
        for part in in_parts(batches, "html"):
            texts = [main_text(page) for page in part.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return bounded(pages.selectExpr("cast(page_id as long) as page_id", "cast(url as string) as url", "cast(html as string) as html")).mapInArrow(run, "page_id long, url string, text string, n_chars long")
