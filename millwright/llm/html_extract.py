"""Operator 5: main text of HTML pages by line-block distribution.

Markup is stripped first: every block element of a page becomes one line, scripts, styles, forms
and page furniture (navigation, side columns, footers) leave empty lines in their place.  Names of
classes and ids are a hint only: an element named like furniture goes if it has no long text
without links, one named like text of others (adverts, reader comments) if the page has other text.  Then the text lengths of ``WINDOW`` consecutive lines are summed for
every line; the sum surges where a body of text begins and dives to nothing where it ends.  The
text between a surge and its dive is one candidate body.  Lines that are links for the most part
count as empty, so a list of links is a dive, and such a line with several links is left out; a
paragraph with words of its own that ends like a sentence is text, however much of it is linked.  A page that marks its article keeps the
bodies inside the mark, where no text outside of it has a higher sum and more length; of several
marks those with sums near the highest count.  Any other page keeps the highest body, those whose peak reaches
``PEAK_SHARE`` of it or that stand in its elements or beside them, and all bodies between these.
"""

from __future__ import annotations

import html as _html
import re
from bisect import bisect_left, bisect_right
from heapq import heapify, heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 3
PEAK_SHARE = 0.34
LINK_SHARE = 0.6
LONG = 140                                       # characters without a link in WINDOW lines

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
_ATTR = re.compile(r"([a-zA-Z_:][\w:.-]*)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
_PARTS = re.compile(r"[a-z0-9]+")

RAW = frozenset("script style noscript template svg math iframe object canvas audio video head title textarea select option datalist".split())
#: Their content is characters only, up to their own end tag.
TEXT_ONLY = {t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in "script style title textarea iframe noscript".split()}
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
                   "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody tfoot thead tr ul").split())
FURNITURE = frozenset("nav aside footer form menu dialog button input label fieldset".split())
FURNITURE_ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar toolbar form status".split())
FURNITURE_WORDS = frozenset(("ad ads adbox adslot advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist "
                             "consent aside rail alert adsense adsbygoogle copyright cookie cookies disqus dropdown foot footer gdpr header login masthead menu menubar modal nav navbar navigation navi "
                             "newsletter notice notices notification overlay pager pagination popup promo promoted promotion recommended related "
                             "replies respond responses search share sharing sidebar sidebars signup skip social sponsor sponsored "
                             "subscribe subscription toolbar topbar widget widgets").split())
#: Elements that may leave out their end tag: what they are parts of, and what else ends them.
PARTS_OF = {"li": ("ul", "ol"), "dt": ("dl",), "dd": ("dl",), "td": ("table",), "th": ("table",), "tr": ("table",)}
SIBLINGS = {"dt": ("dd",), "dd": ("dt",), "td": ("th", "tr", "tbody"), "th": ("td", "tr", "tbody"), "tr": ("tbody", "tfoot")}
#: Words that name text of somebody else; those of the others that also name parts of an article;
#: and words that name its text.
FOREIGN_WORDS = frozenset(("ad ads adbox adslot advert adverts advertisement advertising adsense adsbygoogle comment comments commentlist consent "
                           "cookie cookies copyright disqus gdpr newsletter notice notices notification promo promoted promotion replies sidebar sidebars signup sponsor "
                           "sponsored subscribe subscription").split())
FRAME_WORDS = frozenset("alert aside banner foot footer header notice notices notification rail widget widgets".split())
CONTENT_WORDS = frozenset("article body content editor entry heading headline paragraph post story text title".split())
#: Words whose elements go whatever the length of the article, if the page has any other text.
NEVER_MAIN = frozenset("comment comments commentlist consent cookie cookies disqus gdpr replies reply respond responses".split())
LANDMARKS = frozenset("article main".split())
INLINE_CONTROLS = frozenset("button input label".split())
CONTAINERS = frozenset("div section td center main article body details".split())


GAP = ("", 0, -1, -1, 0, False)


def _attributes(text: str) -> dict[str, str]:
    return {k.lower(): _html.unescape(v.strip("\"'")).lower() for k, v in _ATTR.findall(text)} if text.strip(" /") else {}


def _names(attributes: dict[str, str]) -> frozenset[str]:
    words = _PARTS.findall(attributes.get("class", "") + " " + attributes.get("id", ""))
    return frozenset(w for w in words if not w.isdigit())


def _is_furniture(tag: str, attributes: dict[str, str], inside: bool) -> bool:
    if tag in FURNITURE or (tag == "header" and not inside):
        return True
    if not attributes:
        return False
    if "hidden" in attributes or attributes.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", attributes.get("style", "")):
        return True
    return tag not in ("html", "body", "main") and not (tag == "header" and inside) and attributes.get("role") in FURNITURE_ROLES


def _hint(tag: str, attributes: dict[str, str], inside: bool) -> int:
    """What class and id say: 3 for comments and consent, 2 for other text of somebody else, 1 for
    other furniture, else 0.

    Names of several words, such as article-header or widget-text, count by their first and last
    word if another one names content; frame words do not count beside it.
    """
    if tag in ("html", "body", "main") or (tag == "header" and inside):
        return 0
    words, own = set(), False
    for name in (attributes.get("class", "") + " " + attributes.get("id", "")).split():
        parts = _PARTS.findall(name)
        if CONTENT_WORDS.isdisjoint(parts):
            words.update(parts)
        else:
            own = True
            words.update({parts[0], parts[-1]} - FRAME_WORDS)
    if tag in LANDMARKS or re.fullmatch("h[1-6]|p", tag):
        return 3 if words & NEVER_MAIN else 2 if words & {"ad", "ads", "advert", "advertisement", "comment", "comments", "cookie", "notice", "promo", "sponsored", "reply"} else 0
    if words & NEVER_MAIN:
        return 3
    if words & FOREIGN_WORDS:
        return 2
    if own:
        words -= FRAME_WORDS
    if inside:
        words.discard("header")
    return int(bool(words & FURNITURE_WORDS))


def _tokens(page: str):
    """(start, end, name, is an end tag, attributes) of every mark; what ``TEXT_ONLY`` elements hold is passed over.

    A script or style without an end tag reaches to the end of the page, any other such element is empty.
    """
    at, missing = 0, set()
    while m := _TOKEN.search(page, at):
        at, tag, ends, extra = m.end(), (m.group(2) or "").lower(), m.group(1) == "/", m.group(3) or ""
        if tag in TEXT_ONLY and not ends and not extra.endswith("/"):
            stop = None if tag in missing else TEXT_ONLY[tag].search(page, at)
            if stop:
                at = stop.start()
            else:
                missing.add(tag)
                if tag in ("script", "style"):
                    yield m.start(), len(page), tag, ends, "/"
                    return
                extra = "/"
        yield m.start(), m.end(), tag, ends, extra


def _closings(tokens: list[tuple]) -> dict[int, int]:
    """Place of the end tag of every element that has one, by the place of its start tag."""
    out: dict[int, int] = {}
    opened: dict[str, list[int]] = {}
    for k, (_, _, tag, ends, extra) in enumerate(tokens):
        if ends:
            if opened.get(tag):
                out[opened[tag].pop()] = k
        elif tag and tag not in VOID and not extra.endswith("/"):
            opened.setdefault(tag, []).append(k)
    return out


def _after(tokens: list[tuple], k: int, closings: dict[int, int], bounds: list[int], mark: str) -> tuple[int, bool]:
    """Place of the first token after the element that begins at ``k``, inside an open landmark ``mark``
    or "", and if the token before it is the element's end tag.  ``bounds`` are the places of landmarks
    and of the ends of the body.

    An element ends at its end tag, but not outside of the landmark or body it began in.  One that
    has none ends where its kind may (a list item at the next one) or, with no landmark open, at
    the next landmark.
    """
    tag, stop = tokens[k][2], closings.get(k)
    around = PARTS_OF.get(tag)
    depth = inner = 0
    if tag == "p" or around or tag == "head":
        places = range(k + 1, len(tokens))
    else:
        stop_at = len(tokens) if stop is None else stop
        places = bounds[bisect_right(bounds, k):bisect_left(bounds, stop_at)] + [stop_at] * (stop is not None)
    for i in places:
        _, _, t, ends, extra = tokens[i]
        if i == stop and tag != "p" and not around:
            return i + 1, True
        if not t or extra.endswith("/") and not ends:
            continue
        if tag == "p" and (t in BLOCK or ends and t in CONTAINERS):
            own = ends and t == "p"
            return i + own, own
        if around:
            if t in around:
                depth += -1 if ends else 1
                if depth < 0:
                    return i, False
            elif depth == 0 and (t == tag or t in SIBLINGS.get(tag, ())):
                own = ends and t == tag
                return i + own, own
        if ends and t in ("body", "html"):
            return i, False
        if t == mark:
            inner += -1 if ends else 1
            if inner < 0:
                return i, False
        elif stop is None and t in LANDMARKS and not ends and not mark:
            return i, False
        elif stop is None and tag == "head" and not ends and t in BLOCK:
            return i, False
    return len(tokens), False


def _mark_frame(boxes: list[list], box: int):
    while not boxes[box][2] or box and not boxes[boxes[box][0]][2]:
        boxes[box][2] = True
        box = boxes[box][0]


def lines_of(page: str) -> tuple[list[tuple[str, int, int, int, int]], list[int], list[list]]:
    """(text, characters inside links, landmark number or 0, element number, links) per block, with an
    empty text and a landmark of -1 where markup was taken out; the landmark around each landmark; and
    [element around it, words of class and id, if it holds the page's frame] per element.

    A main heading (h1) counts as text even if it is a link.
    """
    out: list[tuple[str, int, int, int, int]] = []
    around = [0]
    hinted: list[tuple[int, int, int]] = []      # (first line, end, hint) of elements with furniture's names
    open_hints: list[tuple[int, int, int]] = []  # (place of the token after it, first line, hint)
    parts: list[str] = []
    linked = links = 0
    in_link, open_link, in_title = 0, False, False
    in_prose, plain = False, False               # a paragraph is open; it has letters outside of links
    landmark, marks, n_marks = 0, [], 0          # innermost landmark, its open elements
    holders, n_holders = [("", 0)], 0            # open containers
    boxes: list[list] = [[0, frozenset(), True]]

    def close():
        nonlocal linked, links, in_link, plain
        text = " ".join(_html.unescape("".join(parts)).split())
        if text:
            sentence = in_prose and plain and text[-1] in ".!?\u2026"
            out.append((text, 0 if in_title else linked, landmark, holders[-1][1], links, sentence))
        parts.clear()
        linked, links, plain = 0, 0, False
        if open_link:
            in_link = 0

    tokens = list(_tokens(page))
    closings = _closings(tokens)
    bounds = [i for i, t in enumerate(tokens) if t[2] in LANDMARKS or t[3] and t[2] in ("body", "html")]
    at = k = 0
    while k < len(tokens):
        start, end, tag, ends, extra = tokens[k]
        if start > at:
            parts.append(page[at:start])
            if in_link:
                linked += start - at
            elif in_prose and not plain:
                plain = any(map(str.isalpha, parts[-1]))
        at = end
        while open_hints and open_hints[-1][0] <= k:
            close()
            _, first, hint = open_hints.pop()
            hinted.append((first, len(out), hint))
        k += 1
        if not tag:
            continue
        if not ends:
            attributes = _attributes(extra)
            if tag in RAW or _is_furniture(tag, attributes, landmark > 0):
                if tag in ("nav", "footer", "header"):
                    _mark_frame(boxes, holders[-1][1])
                if tag in BLOCK or tag in CONTAINERS or tag in FURNITURE and tag not in INLINE_CONTROLS:
                    close()
                    out.extend([GAP] * WINDOW)
                if tag not in VOID and not extra.endswith("/"):
                    k, own = _after(tokens, k - 1, closings, bounds, marks[-1][0] if marks else "")
                    at = tokens[k - 1][1] if own else tokens[k][0] if k < len(tokens) else len(page)
                continue
            hint = _hint(tag, attributes, landmark > 0) if attributes and tag not in VOID and not extra.endswith("/") else 0
            if hint:
                close()
                stop, own = _after(tokens, k - 1, closings, bounds, marks[-1][0] if marks else "")
                open_hints.append((stop - own, len(out), hint))
        if tag == "a":
            in_link = 0 if ends or "href" not in attributes else 1
            open_link = not ends and k - 1 not in closings  # a link without an end tag ends with its block
            links += in_link
        elif tag == "br" or tag == "th" or (tag == "td" and ends):
            parts.append(" ")
        elif tag in BLOCK or tag in CONTAINERS:
            close()
            in_prose = tag == "p" and not ends
            if tag == "h1":
                in_title = not ends
            if tag in CONTAINERS:
                if not ends:
                    n_holders += 1
                    boxes.append([holders[-1][1], _names(attributes), tag == "body"])
                    holders.append((tag, n_holders))
                elif any(t == tag for t, _ in holders):
                    while holders.pop()[0] != tag:
                        pass
            if tag in LANDMARKS:
                if not ends:
                    n_marks += 1
                    marks.append((tag, landmark))
                    around.append(landmark)
                    landmark = n_marks
                    out.extend([GAP] * WINDOW)
                elif any(t == tag for t, _ in marks):
                    while marks:
                        t, landmark = marks.pop()
                        if t == tag:
                            break
                    out.extend([GAP] * WINDOW)
    if at < len(page):
        parts.append(page[at:])
    close()
    while open_hints:
        _, first, hint = open_hints.pop()
        hinted.append((first, len(out), hint))
    return _without_furniture(out, hinted), around, boxes


def _unlinked(line: tuple) -> int:
    """Length of a line; 0 if it is links for the most part and no sentence of a paragraph."""
    return 0 if line[1] > LINK_SHARE * len(line[0]) and not line[5] else len(line[0])


def _without_furniture(lines: list[tuple], hinted: list[tuple[int, int, int]]) -> list[tuple]:
    """The lines, without those of elements that have furniture's names and no long text.

    Long text of somebody else goes too, unless the page has no other; comments and consent
    banners go however short the other text is.
    """
    if not hinted:
        return lines
    lengths = [_unlinked(line) for line in lines]
    foreign = [False] * len(lines)
    for first, end, hint in hinted:
        if hint >= 2:
            foreign[first:end] = [True] * (end - first)
    own = [0 if f else n for f, n in zip(foreign, lengths)]
    gone = [False] * len(lines)
    # innermost first: what goes with an inner element does not speak for the one around it
    for first, end, hint in hinted:
        if hint == 1 and (sum(own[first:end]) < LONG or all(sum(own[i:min(i + WINDOW, end)]) < LONG for i in range(first, end))):
            gone[first:end] = [True] * (end - first)
            own[first:end] = [0] * (end - first)
    rest = sum(own)
    for first, end, hint in hinted:
        if hint == 3 and rest or hint == 2 and (rest >= LONG or sum(lengths[first:end]) < max(LONG, rest)):
            gone[first:end] = [True] * (end - first)
    out = []
    for k, line in enumerate(lines):
        if not gone[k]:
            out.append(line)
        elif k == 0 or not gone[k - 1]:
            out.extend([GAP] * WINDOW)
    return out


def _chosen_landmarks(bodies: list[tuple], around: list[int]) -> set[int]:
    """The landmarks whose bodies are the main text, from (first, end, highest sum, landmark, text length).

    None if the text outside of all of them has both a higher sum and more text than any outermost
    one; else those whose highest sum reaches ``PEAK_SHARE`` of the best, and those around them.
    """
    outer = list(range(len(around)))
    for mark in outer:
        outer[mark] = outer[around[mark]] if around[mark] else mark
    peaks, whole = {}, {}
    for _, _, peak, mark, length in bodies:
        peaks[mark] = max(peaks.get(mark, 0), peak)
        top, total = whole.get(outer[mark], (0, 0))
        whole[outer[mark]] = max(top, peak), total + length
    outside = whole.pop(0, (0, 0))
    peaks.pop(0, 0)
    if not whole or all(outside[0] > top and outside[1] > total for top, total in whole.values()):
        return set()
    least = PEAK_SHARE * max(peaks.values())
    chosen = {mark for mark, peak in peaks.items() if peak >= least}
    for mark in list(chosen):
        while around[mark]:
            mark = around[mark]
            chosen.add(mark)
    return chosen


def _around_the_highest(bodies: list[tuple], lines: list[tuple], lengths: list[int], boxes: list[list]) -> list[tuple]:
    """The body with the highest sum, those that come near it or belong to it, and all between them.

    A body belongs to it if it lies in one of its elements or beside them in one element.  Where
    that element holds the page's frame too (navigation, lists of links), only bodies in elements
    named alike, or like content, count.
    """
    linked = [line[3] for line in lines if line[0]]
    flat = [n == 0 for line, n in zip(lines, lengths) if line[0]]
    for k in range(1, len(linked)):
        if flat[k] and flat[k - 1]:              # a list of links
            _mark_frame(boxes, linked[k])
    held = [{lines[k][3] for k in range(a, b) if lengths[k]} for a, b, *_ in bodies]
    best = max(range(len(bodies)), key=lambda n: bodies[n][2])
    # An element's number is above those of the elements around it.
    ahead = [-box for box in held[best]]
    heapify(ahead)
    while True:
        common = -heappop(ahead)
        while ahead and ahead[0] == -common:
            heappop(ahead)
        if not ahead:
            break
        heappush(ahead, -boxes[common][0])
    parent = boxes[common][0] if len(held[best]) == 1 else common
    child = [0] * len(boxes)                     # the element just below the parent, around each element
    for box in range(1, len(boxes)):
        child[box] = box if boxes[box][0] == parent else child[boxes[box][0]]
    names = frozenset().union(*(boxes[child[box]][1] for box in held[best] if child[box]))
    belongs = [False] * len(boxes)
    inside = [False] * len(boxes)                # of an element of the body that holds no frame
    for box, (outer, _, frame) in enumerate(boxes):
        inside[box] = box > 0 and inside[outer] or box in held[best] and not frame
        belongs[box] = inside[box] or box > 0 and box in held[best]
        if not belongs[box] and parent not in held[best] and (child[box] or box == parent):
            beside = boxes[child[box]][1]
            belongs[box] = not boxes[parent][2] or child[box] > 0 and bool(beside & (names | CONTENT_WORDS) or not beside and not names)
    least = PEAK_SHARE * bodies[best][2]
    kept = [n for n, body in enumerate(bodies) if body[2] >= least or any(belongs[box] for box in held[n])]
    return bodies[kept[0]:kept[-1] + 1]


def main_text(page: str | None) -> str:
    """Blocks of the page's main text in page order, joined by one line feed; "" if there is none."""
    lines, around, boxes = lines_of(page or "")
    lengths = [_unlinked(line) for line in lines]
    texts = [line[0] if n or line[4] < 2 else "" for line, n in zip(lines, lengths)]  # without lines of several links and little else
    sums = [sum(lengths[i:i + WINDOW]) for i in range(len(lengths))]
    bodies, i = [], 0
    while i < len(sums):
        if sums[i] == 0:
            i += 1
            continue
        surge = i
        while i < len(sums) and sums[i] > 0:     # the dive: WINDOW lines without text
            i += 1
        full = [k for k in range(surge, i) if lengths[k]]
        bodies.append((full[0], full[-1] + 1, max(sums[surge:i]), lines[full[0]][2], sum(lengths[surge:i])))
    if not bodies:                               # links only: what the page marks as its article, if any
        return "\n".join(line[0] for line in lines if line[2] > 0)
    chosen = _chosen_landmarks(bodies, around)
    if chosen:
        return "\n".join(texts[k] for a, b, _, mark, _ in bodies if mark in chosen for k in range(a, b) if texts[k])
    bodies = _around_the_highest([body for body in bodies if body[3] == 0], lines, lengths, boxes)
    return "\n".join(texts[k] for a, b, *_ in bodies for k in range(a, b) if texts[k])


def extract_main_text(pages: DataFrame, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """``keep`` columns, text and n_chars (code points) per page.

    A null or empty page gives an empty text; broken markup is read as far as it goes and an
    element left open ends at the next landmark or at the end of the page; repeated rows and ties
    are pages of their own; no rows give no rows.
    """
    def run(batches):
        for batch in batches:
            texts = [main_text(h) for h in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(k) for k in range(batch.num_columns - 1)), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                [*batch.schema.names[:-1], "text", "n_chars"])

    rows = pages.select(*keep, F.col(html_col).alias("_html"))
    schema = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes[:-1])
    return rows.mapInArrow(run, schema + ", text string, n_chars long")
