"""Main text of HTML pages from streamed parser events.

The standard library's parser feeds events to a reader that cuts the page into lines, one for each block
(paragraph, heading, list item, cell and so on), and notes the tags met on the line and the containers
around it. A line's text-to-tag ratio is its number of characters over its number of tags; characters of
links, and of parts that are never main text (menus, forms, scripts, ...), don't count. The ratios are
smoothed by a Gaussian kernel and split in two clusters by a threshold. The lines of the upper cluster
choose the region: the innermost container that holds nearly all of their text. It is widened to the
containers around it as long as they add more text than links, so that a title, a lead or a last line
beside it is not lost. Its lines, short ones too, are the main text, less the parts that are never main
text and, in what the widening adds or where no container but the page itself encloses the text, less the
lines that are mostly links.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SIGMA = 1.5  # lines
SHARE = 0.9  # of the upper cluster's text that the region holds at least

#: HTML elements by what they are.
CONTAINERS = frozenset("html body main article section div aside nav header footer form ul ol dl table tbody thead tfoot tr td th blockquote figure fieldset details center".split())
BLOCKS = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd pre address figcaption caption summary legend hr option".split())
NEVER = frozenset("head title nav header footer aside form script style noscript template svg math button select textarea iframe object canvas audio video dialog menu".split())
RAW = frozenset("script style".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that are part of an article when they stand in one.
IN_ARTICLE = frozenset("header".split())
ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar toolbar dialog alert alertdialog".split())
#: Parts of class and id names that mark what isn't main text.
MARKS = re.compile(
    r"(?:^|[_-])(?:ads?|advert\w*|adsense|sponsor\w*|promo\w*|banner|nav\w*|menu\w*|side-?bar|header|footer|masthead|breadcrumbs?|cookies?\w*|consent|gdpr|notices?|popup|pop-up|modal"
    r"|overlay|newsletter|subscri\w*|comments?|commentlist|disqus|replies|reply|respond|share|sharing|social\w*|related|recommend\w*|widgets?|toolbar|pagination|pager|login|signup|skip-?link)(?=$|[_-])",
    re.IGNORECASE,
)
#: Names that are marked so but belong to an article, or tell what is beside an element.
UNMARKED = re.compile(r"(?:article|post|entry|story)[_-]?(?:body|content|text|header|title)?|(?:has|with|without|no|is)[_-].*", re.IGNORECASE)


#: Last parts of ids that name a component; elsewhere in an id a marked word may be of its subject, as in a heading's id.
COMPONENTS = re.compile(
    r"(?:.*[_-])?(?:ads?|adsense|banner|nav|navbar|navigation|menu|side-?bar|header|footer|masthead|breadcrumbs?|cookies?|consent|notices?|popup|pop-up|modal|overlay|newsletter|comments?|commentlist"
    r"|disqus|replies|respond|widgets?|toolbar|pagination|pager|skip-?link)",
    re.IGNORECASE,
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Names of what readers add to a page; unlike a wrapper's name, such a name holds also for most of a page's text.
REPLIES = re.compile(r"(?:.*[_-])?(?:comments?|commentlist|disqus|replies|reply|respond)(?:[_-](?:list|section|area|body|thread|wrap|wrapper|container))?", re.IGNORECASE)


def marked(names: str) -> bool:
    """Whether one of the class names is marked."""
    return any(MARKS.search(n) and not UNMARKED.fullmatch(n) for n in names.split())


def marked_id(name: str) -> bool:
    """Whether an id is a marked word as a whole, or ends with a component's name."""
    name = name.strip()
    found = MARKS.match(name)
    return bool(found and found.end() == len(name) or COMPONENTS.fullmatch(name)) and not UNMARKED.fullmatch(name)


class _Reader(HTMLParser):
    """Collects lines: text, characters outside links, tags, the container around, and whether it is cut.

    Containers are numbered as they open, so those within number n are the ones from n to ``ends()[n]``. Each
    knows the one around it, and what it needs of those farther out is handed down when it opens: a page
    takes time and memory in proportion to its length, however deep it is nested.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[str, int, int, int, bool]] = []
        self.open: list[tuple[str, int, bool]] = [("", 0, False)]  # element, its number (-1: none), whether cut
        self.places: dict[str, list[int]] = {}  # places in ``open`` by element
        self.here = 0  # the innermost open container
        self.kind = [""]
        self.parent = [-1]
        self.depth = [0]
        self.in_article = [False]
        self.in_named = [False]  # whether names mark it or one around it
        self.in_replies = [False]
        self.named: dict[int, bool] = {}  # elements that their names mark, and whether as REPLIES
        self.titles: list[int] = []  # containers of h1 and main elements that aren't cut
        self.articles: list[int] = []  # and of articles
        self.text: list[str] = []
        self.tags = self.plain = 0
        self.in_link = False
        self.in_title = False  # in an h1, whose text counts also where it is a link
        self.link_depth = 0  # containers open where the link begins
        self.link_line = True  # whether the link begins on this line
        self.doubtful: dict[int, int] = {}  # characters by line, of a link that has gone past the end of its own

    def read(self, html: str) -> None:
        """The whole page. Markup that is not finished at its end is no text; a last "<" is."""
        self.feed(html)
        if self.rawdata.startswith("<") and len(self.rawdata) > 1:
            self.rawdata = ""
        self.close()
        self.end_link(closed=False)
        self.end_line()

    def parse_marked_section(self, i: int, report: int = 1) -> int:
        """CDATA ends with "]]>"; any other section, and one that is not finished, is a comment up to ">"."""
        end = self.rawdata.find("]]>", i) if self.rawdata[i + 3 : i + 9].lower() == "cdata[" else -1
        return end + 3 if end >= 0 else self.parse_bogus_comment(i)

    def end_line(self) -> None:
        text = " ".join("".join(self.text).split())
        if text:
            self.lines.append((text, self.plain, self.tags, self.here, self.open[-1][2]))
        else:
            self.doubtful.pop(len(self.lines), None)
        self.text = []
        self.tags = self.plain = 0
        self.link_line = self.in_title = False

    def end_link(self, closed: bool) -> None:
        """A link that is never closed ends with its line: what follows isn't its text."""
        if not closed:
            for i, chars in self.doubtful.items():
                if i == len(self.lines):
                    self.plain += chars
                else:
                    text, plain, *rest = self.lines[i]
                    self.lines[i] = (text, plain + chars, *rest)
        self.in_link, self.doubtful = False, {}

    def is_never(self, tag: str, attrs) -> bool:
        if tag in NEVER and not (tag in IN_ARTICLE and self.in_article[self.here]):
            return True
        if tag in ("html", "body", "main"):
            return False
        for name, value in attrs:
            if name == "hidden" or (name == "aria-hidden" and value == "true"):
                return True
            if value and name == "role" and value.strip().lower() in ROLES:
                return True
        return False

    def replies(self, tag: str, attrs) -> bool | None:
        """Whether its names mark an element as REPLIES, or as something else; None if they don't."""
        if tag in ("html", "body", "main", "h1"):
            return None
        by = [value for name, value in attrs if value and (name == "class" and marked(value) or name == "id" and tag not in HEADINGS and marked_id(value))]
        return any(REPLIES.fullmatch(n) for value in by for n in value.split()) if by else None

    def enter(self, tag: str, number: int, cut: bool) -> None:
        self.places.setdefault(tag, []).append(len(self.open))
        self.open.append((tag, number, cut))

    def enter_container(self, tag: str, cut: bool, replies: bool | None) -> None:
        """Opens a numbered element; whether to cut what names mark is known at the page's end."""
        number, around = len(self.kind), self.here
        if replies is not None:
            self.named[number] = replies
        self.kind.append(tag)
        self.parent.append(around)
        self.depth.append(self.depth[around] + 1)
        self.in_article.append(self.in_article[around] or tag in ("article", "main"))
        self.in_named.append(self.in_named[around] or replies is not None)
        self.in_replies.append(self.in_replies[around] or bool(replies))
        self.enter(tag, number, cut)
        self.here = number

    def handle_starttag(self, tag: str, attrs) -> None:
        if tag in CONTAINERS or tag in NEVER:
            self.end_line()
            if tag in ("tr", "td", "th"):
                self.close_to({"tr": ("tr", "td", "th")}.get(tag, ("td", "th")), ("table",))
            cut, replies = self.open[-1][2] or self.is_never(tag, attrs), self.replies(tag, attrs)
            self.enter_container(tag, cut, replies)
            if tag in ("main", "article") and not cut and replies is None:
                (self.titles if tag == "main" else self.articles).append(self.here)
        elif tag in BLOCKS:
            self.end_line()
            if tag not in ("hr",):
                self.drop_block()
                self.in_title = tag == "h1"
                if not self.open[-1][2]:
                    if tag == "h1":
                        self.titles.append(self.here)
                    if self.is_never(tag, attrs):
                        self.enter(tag, -1, True)
                    elif (replies := self.replies(tag, attrs)) is not None:
                        self.enter_container(tag, False, replies)
        elif tag == "br":
            self.text.append(" ")
        elif tag == "a":
            self.end_link(closed=False)
            if any(name == "href" for name, _ in attrs):
                self.in_link, self.link_depth, self.link_line = True, self.depth[self.here], True
        self.tags += 1

    def leave(self) -> None:
        tag, number, _ = self.open.pop()
        self.places[tag].pop()
        if number >= 0:
            self.here = self.parent[number]

    def drop_block(self) -> None:
        """A block ends the block before it; only blocks that are cut, or may be, are kept in mind."""
        if self.open[-1][0] in BLOCKS:
            self.leave()

    def close_to(self, tags: tuple[str, ...], stop: tuple[str, ...]) -> None:
        last = lambda names: max((self.places[t][-1] for t in names if self.places.get(t)), default=0)
        if last(tags) > last(stop):
            self.cut_back(last(tags))

    def cut_back(self, k: int) -> None:
        self.end_line()
        while len(self.open) > k:
            self.leave()
        if self.in_link and self.depth[self.here] < self.link_depth:
            self.end_link(closed=False)

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if tag in CONTAINERS or tag in NEVER:
            if self.places.get(tag):
                self.cut_back(self.places[tag][-1])
        elif tag in BLOCKS:
            self.end_line()
            self.drop_block()
        elif tag == "a":
            self.end_link(closed=True)

    def handle_startendtag(self, tag: str, attrs) -> None:
        self.handle_starttag(tag, attrs)  # HTML ignores the slash

    def handle_data(self, data: str) -> None:
        self.text.append(data)
        if self.open[-1][2]:
            return
        if not self.in_link or self.in_title:
            self.plain += len(data)
        elif not self.link_line:
            self.doubtful[len(self.lines)] = self.doubtful.get(len(self.lines), 0) + len(data)

    def around(self, number: int) -> Iterator[int]:
        """A container and those around it, outwards."""
        while number >= 0:
            yield number
            number = self.parent[number]

    def ends(self) -> list[int]:
        """The largest number within each container."""
        out = list(range(len(self.kind)))
        for n in range(len(out) - 1, 0, -1):
            out[self.parent[n]] = max(out[self.parent[n]], out[n])
        return out

    def sums(self, values: Iterator[tuple[int, int]]) -> list[int]:
        """Values of containers, summed up over what is within each."""
        out = [0] * len(self.kind)
        for n, value in values:
            out[n] += value
        for n in range(len(out) - 1, 0, -1):
            out[self.parent[n]] += out[n]
        return out

    def cut_named(self) -> None:
        """Cuts what names mark, unless it is a wrapper: the page's h1, main or largest article, or most of its text, are in it."""
        if not self.named:
            return
        held = self.sums((line[3], line[1]) for line in self.lines if not line[4])
        total = held[0]
        largest = max((n for n in self.articles if not self.in_replies[n]), key=held.__getitem__, default=-1)
        wraps = list(self.titles)
        if all(self.in_named[n] for n in self.titles):  # else the page's head is outside, and the article may be a teaser
            wraps.append(largest)
        spared: set[int] = set()
        for number in wraps:
            for n in self.around(number):
                if n in spared:
                    break
                spared.add(n)
        for n, replies in self.named.items():
            if not replies and 2 * held[n] > total or replies and held[n] == total > 0:
                spared.add(n)
        gone = [n in self.named and n not in spared for n in range(len(self.kind))]
        for n in range(1, len(gone)):
            gone[n] = gone[n] or gone[self.parent[n]]
        self.lines = [(text, 0, tags, n, True) if not cut and gone[n] else (text, plain, tags, n, cut) for text, plain, tags, n, cut in self.lines]


def smoothed(ratios: list[float], sigma: float = SIGMA) -> list[float]:
    reach = math.ceil(2 * sigma)
    kernel = [math.exp(-(d * d) / (2 * sigma * sigma)) for d in range(-reach, reach + 1)]
    out = []
    for i in range(len(ratios)):
        low, high = max(0, i - reach), min(len(ratios), i + reach + 1)
        weights = kernel[low - i + reach : high - i + reach]
        out.append(sum(w * r for w, r in zip(weights, ratios[low:high], strict=True)) / sum(weights))
    return out


def threshold(values: list[float]) -> float:
    """Where two clusters part: the mean of the two clusters' means, repeated until it rests."""
    t = sum(values) / len(values)
    for _ in range(50):
        high = [v for v in values if v >= t]
        low = [v for v in values if v < t]
        if not high or not low:
            return t
        new = (sum(high) / len(high) + sum(low) / len(low)) / 2
        if abs(new - t) < 1e-9:
            return t
        t = new
    return t


def is_link(line: tuple) -> bool:
    """Whether most of a line is the text of links."""
    return 2 * line[1] < len(line[0])


def extract(html: str) -> str:
    """The main text: its lines, joined by newlines; empty if there is none."""
    reader = _Reader()
    reader.read(html)
    reader.cut_named()
    lines = reader.lines
    ratios = [0.0 if cut else plain / max(tags, 1) for _, plain, tags, _, cut in lines]
    if not any(ratios):
        return ""
    level = smoothed(ratios)
    limit = threshold(level)
    upper = [i for i, v in enumerate(level) if v >= limit and ratios[i]]
    if not upper:
        upper = [i for i, r in enumerate(ratios) if r]
    held = reader.sums((lines[i][3], lines[i][1]) for i in upper)
    # numbers grow inwards, so the largest that holds the share is the innermost
    region = max(n for n, chars in enumerate(held) if chars >= SHARE * held[0])
    end = reader.ends()
    within = lambda i, n: n <= lines[i][3] <= end[n]
    # an article or main element around the region is the article, whole
    for n in reader.around(region):
        if reader.kind[n] in ("article", "main"):
            return "\n".join(line[0] for i, line in enumerate(lines) if not line[4] and within(i, n))
    uncut = [line for line in lines if not line[4]]
    linked = reader.sums((line[3], len(line[0])) for line in uncut if is_link(line))
    other = reader.sums((line[3], len(line[0])) for line in uncut if not is_link(line))
    whole = region
    for n in reader.around(reader.parent[region]):
        links = linked[n] - linked[whole]
        if links and links >= other[n] - other[whole]:
            break
        whole = n
    enclosed = reader.kind[region] not in ("", "html", "body")  # if nothing encloses the text, links count only between the cluster's lines
    own = lambda i: within(i, region) if enclosed else upper[0] <= i <= upper[-1]
    return "\n".join(line[0] for i, line in enumerate(lines) if not line[4] and within(i, whole) and (own(i) or not is_link(line)))


def extract_pages(pages: DataFrame, html: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """``keep`` columns with ``text`` (empty if none) and ``n_chars`` (code points), one row per page.

    The whole of each page is parsed; null counts as empty. Every row is its own result: repeated rows and
    ties stay, an empty table gives an empty one; only ``html`` and the ``keep`` columns are read, and
    ``keep`` columns called text or n_chars are replaced. Very long pages are parsed as one string each.
    Malformed markup is never an error: unknown declarations are comments, elements that are not closed end
    with the page, and markup that is not finished at its end is left out.
    """

    def run(series_iter: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for series in series_iter:
            texts = [extract(h) if h else "" for h in series]
            yield pd.DataFrame({"text": texts, "n_chars": [len(t) for t in texts]})

    udf = F.pandas_udf(run, "struct<text: string, n_chars: bigint>")
    rest = [F.col(f"`{c}`") for c in keep if c not in ("text", "n_chars")]
    return pages.select(*rest, udf(F.coalesce(F.col(f"`{html}`").cast("string"), F.lit(""))).alias("__found")).select(*rest, "__found.*")
