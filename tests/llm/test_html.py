"""Main text of pages: a plain second version, malformed and very deep pages."""

import random
import time

import pytest

pytest.importorskip("readgraph.llm")

from readgraph.llm import html_text as h  # noqa: E402


def plain(html):
    """The same decisions from whole lists of the containers around each line, gone over again for each question."""
    reader = h._Reader()
    reader.read(html)

    def around(n):
        return [n, *around(reader.parent[n])] if n >= 0 else []

    lines = [(text, chars, tags, set(around(n)), cut) for text, chars, tags, n, cut in reader.lines]
    chars_in = lambda n, which: sum(line[1] for line in which if n in line[3])
    uncut = [line for line in lines if not line[4]]
    total = sum(line[1] for line in uncut)
    outside = [n for n in reader.titles if not set(around(n)) & reader.named.keys()]
    own = [n for n in reader.articles if not any(reader.named.get(x) for x in around(n))]
    largest = max(own, key=lambda n: chars_in(n, uncut), default=-1)
    spared = {x for n in [*reader.titles, *([] if outside else [largest])] for x in around(n)}
    for n, replies in reader.named.items():
        held = chars_in(n, uncut)
        if (held == total > 0) if replies else 2 * held > total:
            spared.add(n)
    gone = reader.named.keys() - spared
    lines = [(t, 0, tags, path, True) if cut or path & gone else (t, c, tags, path, False) for t, c, tags, path, cut in lines]
    ratios = [0.0 if cut else c / max(tags, 1) for _, c, tags, _, cut in lines]
    if not any(ratios):
        return ""
    level = h.smoothed(ratios)
    limit = h.threshold(level)
    upper = [i for i, v in enumerate(level) if v >= limit and ratios[i]] or [i for i, r in enumerate(ratios) if r]
    most = sum(lines[i][1] for i in upper)
    held = {n: sum(lines[i][1] for i in upper if n in lines[i][3]) for n in range(len(reader.kind))}
    region = max(n for n in held if held[n] >= h.SHARE * most)
    for n in around(region):
        if reader.kind[n] in ("article", "main"):
            return "\n".join(line[0] for line in lines if not line[4] and n in line[3])
    whole = region
    for n in around(region)[1:]:
        added = [line for line in lines if not line[4] and n in line[3] and whole not in line[3]]
        links = sum(len(line[0]) for line in added if 2 * line[1] < len(line[0]))
        if links and 2 * links >= sum(len(line[0]) for line in added):
            break
        whole = n
    out = []
    for i, line in enumerate(lines):
        inner = upper[0] <= i <= upper[-1] if reader.kind[region] in ("", "html", "body") else region in line[3]
        if not line[4] and whole in line[3] and (inner or 2 * line[1] >= len(line[0])):
            out.append(line[0])
    return "\n".join(out)


TAGS = "div p section article main h1 h2 nav ul li a table tr td span b header footer aside form script br hr blockquote title textarea".split()
ATTRS = ["", ' class="content"', ' class="sidebar"', ' id="comments"', ' class="comments-area"', ' id="related-work"', ' href="x"', " hidden", ' role="navigation"', ' class="page-with-sidebar"', ' class="entry-header"']
ODD = ["<![foo[x]]>", "<![", "<![ [", "<!", "<!DOCTYPE [ <", "<!-- open", "<!-->", "<?php x", "</", "</ >", "<", "&", "&#", "&#x110000;", "&amp", "<![CDATA[ a > b ]]>", "<![if !x]>", "<![endif]>", "<a b='", "<div/>", "<0>", "\x00", "<!x>", "]]>"]
WORDS = "alpha beta gamma delta epsilon zeta eta theta".split()


def pages(n, seed):
    rng = random.Random(seed)
    for _ in range(n):
        parts = []
        for _ in range(rng.randint(1, 60)):
            r, tag = rng.random(), rng.choice(TAGS)
            if r < 0.3:
                parts.append(f"<{tag}{rng.choice(ATTRS)}>")
            elif r < 0.55:
                parts.append(f"</{tag}>")
            elif r < 0.65:
                parts.append(rng.choice(ODD))
            else:
                parts.append(" ".join(rng.choices(WORDS, k=rng.choice([1, 3, 20, 60]))))
        yield "".join(parts)


@pytest.mark.parametrize("seed", range(4))
def test_against_plain(seed):
    for page in pages(400, seed):
        assert h.extract(page) == plain(page), page


def test_malformed_pages_on_spark(spark):
    odd = [f"<p>some text</p>{x}" for x in ODD] + list(pages(100, 9)) + [None, "", "<![foo[" * 1000]
    rows = spark.createDataFrame([(i, "u", x) for i, x in enumerate(odd)], "page_id bigint, url string, html string")
    got = {r["page_id"]: r["text"] for r in h.extract_pages(rows).collect()}
    assert len(got) == len(odd) and all(got[i] == h.extract(x or "") for i, x in enumerate(odd))


@pytest.mark.parametrize(
    ("end", "text"),
    [("<![foo[x]]>", "some text"), ("<!DOCTYPE [ <", "some text"), ("<!-- open <p>more", "some text"), ("<?php x", "some text"), ("</", "some text"), ("<div class='x", "some text"), ("<![", "some text"), ("<![CDATA[ a > b ]]>", "some text"), (" 1 < ", "some text\n1 <"), ("<script>if (a<b) {", "some text"), ("a &amp", "some text\na &"), ("<![foo[x]]><p>more", "some text\nmore"), ("<![CDATA[x<p>more", "some text\nmore")],
)
def test_unfinished_markup(end, text):
    assert h.extract("<p>some text</p>" + end) == text


@pytest.mark.parametrize(
    "part", ["<div>", "<div>text ", "<table><tr><td>x", "<section><div>", "<a href=x>t<div>", "<h1><article class=sidebar>x", "<p><b>", "<a ", "<!--", "&#", "<![foo[", "<td>x</td></section>"]
)
def test_time_grows_with_length(part):
    """A page of 100,000 parts takes seconds, and four times one of 25,000 at most six times as long, however deep it is nested."""

    def seconds(n):
        began = time.process_time()
        h.extract("<table>" + part * n)
        return time.process_time() - began

    seconds(1000)
    quarter, whole = seconds(25_000), seconds(100_000)
    assert whole < 20 and whole < 6 * max(quarter, 0.5)
