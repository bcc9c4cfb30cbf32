"""A page as a tree of block elements and text blocks.

Inline markup vanishes (that of media, formulas, objects, templates, buttons
and select lists too: their text stays in its place), character references are
decoded, and the raw text of scripts, styles, titles, text fields and frames is
dropped. Each run of text between two block borders is
one text block below its innermost block element. Missing end tags are closed
as browsers do for paragraphs, list items and table cells.
"""

from __future__ import annotations

import html as entities
import re

# FIXED VALUES: element groups of HTML
BLOCKS = frozenset("""address article aside blockquote body caption center dd details dialog dir div dl dt fieldset
figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre search
section summary table tbody td tfoot th thead tr ul""".split())
RAW = frozenset("script style title textarea iframe".split())
FOREIGN = ("svg", "math")
CLOSED_BY = {"li": ("ul", "ol", "menu", "dir"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table", "tr"),
             "th": ("table", "tr")}
SAME = {"dt": ("dt", "dd"), "dd": ("dt", "dd"), "td": ("td", "th"), "th": ("td", "th"), "li": ("li",), "tr": ("tr",)}

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-z][^\s/>]*+)|<[!?/][^>]*+>", re.S | re.I | re.A)
#: blanks and slashes, then the tag's end or one attribute; a quote opens a
#: value after "=" only, and one without a partner belongs to an unquoted value
_ATTRIBUTE = re.compile(r"[\s/]*+(?:(>)|=?+[^\s/>=]*+(?:\s*+=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s>]*+))?+)", re.A)
#: where raw text ends, and the border of an svg or formula
_ENDS = {t: re.compile(rf"</{t}(?=[\s/>])", re.I | re.A) for t in RAW}
_ENDS["svg"] = re.compile(r"</?(?:svg|math)(?=[\s/>])", re.I | re.A)
_NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_WORD = re.compile(r"[a-z]+")


def tag_end(source: str, at: int, dead: set) -> tuple[int, bool]:
    """Where the tag whose attributes start at ``at`` ends (behind its ">"),
    and if it is empty ("/>"); -1 if there is no ">" any more. If the page
    ends within an attribute, the next ">" ends the tag, as quoted it may be.
    ``dead`` holds the places of this page from which that was so: no place
    is tried twice, and the time is linear."""
    seen, first = [], at
    while at < len(source) and at not in dead:
        seen.append(at)
        m = _ATTRIBUTE.match(source, at)
        if m[1]:
            return m.end(), m.end() - 1 > at and source[m.end() - 2] == "/"
        at = m.end()
    dead.update(seen)
    at = source.find(">", first) + 1
    return at or -1, source[at - 2:at - 1] == "/"


def name_words(attrs: str) -> list[str]:
    """The words in class, id and role: ``main-content`` and ``mainContent``
    both give ``main`` and ``content``."""
    found = " ".join(x for m in _NAMES.findall(attrs) for x in m if x)
    return _WORD.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", found).lower())


class Page:
    """Nodes in page order: ``parent``, ``tag`` ("" for text), ``attrs``;
    for text blocks ``text`` and ``linked`` (its characters inside links)."""

    __slots__ = ("parent", "tag", "attrs", "text", "linked")

    def __init__(self, source: str):
        self.parent, self.tag, self.attrs, self.text, self.linked = [-1], ["html"], [""], [None], [0]
        stack, held, links, linked = [0], [], 0, 0
        count = {"html": 1}
        foreign: list = []  # open svg and math elements
        ends: dict = {}
        dead: set = set()

        def flush():
            nonlocal linked
            if held:
                text = " ".join("".join(held).split())
                held.clear()
                if text:
                    self._add(stack[-1], "", "", text, linked)
                linked = 0

        def close(tags, stops=()):
            """Pop up to the nearest open element of ``tags``, not beyond ``stops``."""
            if not any(count.get(t) for t in tags):
                return
            for k in range(len(stack) - 1, 0, -1):
                t = self.tag[stack[k]]
                if t in tags:
                    flush()
                    for i in stack[k:]:
                        count[self.tag[i]] -= 1
                    del stack[k:]
                    return
                if t in stops:
                    return

        def words(raw):
            nonlocal linked
            if raw:
                raw = entities.unescape(raw) if "&" in raw else raw
                held.append(raw)
                if links:
                    linked += len(raw)

        def live(opened):
            """``opened`` without the elements whose parent is closed."""
            while opened and not (len(stack) >= opened[-1][1] and stack[opened[-1][1] - 1] == opened[-1][2]):
                opened.pop()
            return opened

        def ahead(name):
            """The next place from ``at`` on where ``_ENDS[name]`` matches; each stretch is searched once."""
            if ends.get(name, -1) < at:
                found = _ENDS[name].search(source, at)
                ends[name] = found.start() if found else len(source)
            return ends[name]

        at = 0
        while m := _TOKEN.search(source, at):
            words(source[at:m.start()])
            at = m.end()
            tag = m[2]
            if tag is None:
                continue
            end, empty = tag_end(source, at, dead)
            if end < 0:  # an unfinished tag at the end is not text
                at = len(source)
                break
            tag, attrs, at = tag.lower(), source[at:end - 1], end
            if tag not in BLOCKS:
                if tag == "a":
                    links = max(0, links + (-1 if m[1] else 1))
                elif tag in ("br", "img", "input", "wbr", "option", "optgroup"):
                    held.append(" ")
                elif tag in FOREIGN:
                    if not m[1] and not empty:
                        foreign.append((tag, len(stack), stack[-1]))
                    elif m[1] and live(foreign) and foreign[-1][0] == tag:
                        foreign.pop()
                elif tag in RAW and not m[1]:
                    # inside an svg it may be empty, and ends with the svg at the latest
                    if not live(foreign) or not empty and ahead(tag) < ahead("svg"):
                        at = ahead(tag)
                continue
            if m[1]:
                flush()
                if tag not in ("html", "body"):  # what follows </body> still belongs to it
                    close((tag,))
            elif tag == "html" or tag == "body" and count.get("body"):
                flush()
            else:
                flush()
                links = 0 if tag not in ("div", "p") else links
                if tag in SAME:
                    close(SAME[tag], CLOSED_BY[tag])
                else:
                    close(("p",), ("td", "th", "li", "blockquote", "div", "section", "article"))
                if tag == "hr":
                    continue
                self._add(stack[-1], tag, attrs, None, 0)
                stack.append(len(self.tag) - 1)
                count[tag] = count.get(tag, 0) + 1
        tail = source[at:]
        cut = tail.find("<")  # an unfinished tag at the end is not text
        while cut >= 0 and not tail[cut + 1:cut + 2].isalpha() and tail[cut + 1:cut + 2] not in ("/", "!"):
            cut = tail.find("<", cut + 1)
        words(tail if cut < 0 else tail[:cut])
        flush()

    def _add(self, parent, tag, attrs, text, linked):
        self.parent.append(parent)
        self.tag.append(tag)
        self.attrs.append(attrs)
        self.text.append(text)
        self.linked.append(linked)
