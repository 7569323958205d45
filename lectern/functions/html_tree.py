"""TXT-10: one HTML text as Markdown, from its tag tree.

The tags are read once, as a stream; open elements lie on a stack. Inline text gathers in the block it
lies in; an element that closes renders what it holds and hands it to the element around it, so
nested lists, quotes and tables are put together from the inside out, in time linear in the text
times its depth. What browsers forgive is forgiven: a block closes the paragraph before it, ``li``,
``td`` and ``tr`` close their predecessors, end tags without a start are skipped, and an inline
element that is not closed within its block leaves its content unmarked.

Rendered are headings, paragraphs, hard line breaks, rules, bullet and numbered lists (``start``
too), quotes, preformatted blocks (fenced, with the language of ``class="language-…"``), tables (pipes), bold,
italic, struck-through and code spans, links and images. Of ``head``, ``script``, ``style``, ``template``
and comments nothing stays. Other tags pass their content on. All named, decimal and hexadecimal
character references are decoded; white space collapses but for preformatted blocks.
"""

from __future__ import annotations

import re
from html import unescape
from html.parser import HTMLParser

# Elements by their part in the output.
BLOCKS = frozenset("address article aside blockquote body caption center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
                   "header hr html legend li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
DROPPED = frozenset("head script style template title".split())
MARKS = {"b": "**", "strong": "**", "i": "*", "em": "*", "del": "~~", "s": "~~", "strike": "~~"}
#: A start tag closes these open elements, up to the nearest of its boundary.
IMPLIED = {"li": ({"li"}, {"ul", "ol"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tr": ({"tr"}, {"table"}),
           "tbody": ({"thead", "tbody", "tfoot"}, {"table"}), "thead": ({"thead", "tbody", "tfoot"}, {"table"}), "tfoot": ({"thead", "tbody", "tfoot"}, {"table"}),
           "dd": ({"dd", "dt"}, {"dl"}), "dt": ({"dd", "dt"}, {"dl"})}
#: Not closed by a block that begins inside them.
_HOLDERS = BLOCKS - {"p", "h1", "h2", "h3", "h4", "h5", "h6", "dt", "summary", "legend", "caption"}
_SPACE = re.compile(r"[ \t\n\r\f\v]+")
_BREAK = "\v"


class _Element:
    __slots__ = ("tag", "attrs", "inline", "blocks", "tight")

    def __init__(self, tag: str, attrs: dict):
        self.tag, self.attrs = tag, attrs
        self.inline: list[str] = []   # inline pieces since the last block
        self.blocks: list = []        # finished blocks (rows of cells in tables)
        self.tight: list[bool] = []   # whether a block is a list, which follows its text without a blank line


def _flat(pieces: list[str]) -> str:
    """Inline pieces as one run: single spaces, hard breaks between text only."""
    run = re.sub(r" *\v[ \v]*", _BREAK, re.sub(" +", " ", "".join(pieces))).strip(" " + _BREAK)
    return run.replace(_BREAK, "  \n")


def _fence(text: str, least: int) -> str:
    """A run of backticks that does not occur in the text."""
    return "`" * max(least, 1 + max((len(r) for r in re.findall("`+", text)), default=0))


class _Tree(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack = [_Element("html", {})]
        self.dropped = 0   # depth below an element that is dropped
        self.verbatim = 0  # depth below pre

    # ------------------------------------------------------------------ the stream

    def handle_starttag(self, tag, attrs):
        if tag == "body":
            self.dropped = 0  # a head that was not closed ends here
        if self.dropped or tag in DROPPED:
            self.dropped += tag in DROPPED
            return
        if tag == "br":
            self.stack[-1].inline.append("\n" if self.verbatim else _BREAK)
        elif tag == "img":
            found = dict(attrs)
            self.stack[-1].inline.append(f"![{found.get('alt') or ''}]({found.get('src') or ''})")
        elif tag == "hr":
            self._make_room(tag)
            self._add(self.stack[-1], "---")
        elif tag in BLOCKS:
            self._make_room(tag)
            self.verbatim += tag == "pre"
            self.stack.append(_Element(tag, dict(attrs)))
        elif self.verbatim:  # a preformatted block is text; code inside tells its language
            lang = re.search(r"(?:^|\s)(?:language|lang)-(\S+)", dict(attrs).get("class") or "")
            if tag == "code" and lang:
                next(e for e in reversed(self.stack) if e.tag == "pre").attrs["lang"] = lang[1]
        elif tag in MARKS or tag in ("code", "a"):
            self.stack.append(_Element(tag, dict(attrs)))

    def handle_endtag(self, tag):
        if tag in DROPPED:
            self.dropped = max(0, self.dropped - 1)
        if self.dropped or tag in DROPPED or (self.verbatim and tag not in BLOCKS):
            return
        for at in range(len(self.stack) - 1, 0, -1):
            open_ = self.stack[at].tag
            if open_ == tag:
                self._close_to(at)
                return
            if tag not in BLOCKS and open_ in BLOCKS:
                return  # an inline end tag does not reach out of its block

    def handle_data(self, data):
        if not self.dropped:
            self.stack[-1].inline.append(data if self.verbatim else _SPACE.sub(" ", data))

    def finish(self) -> str:
        self.close()
        self._close_to(1)
        root = self.stack[0]
        self._end_run(root)
        return "\n\n".join(root.blocks).strip(" \t\r\n")

    # ------------------------------------------------------------------ the tree

    def _make_room(self, tag: str) -> None:
        """Close what a block that begins here ends."""
        if tag in IMPLIED:
            ended, bounds = IMPLIED[tag]
            for at in range(len(self.stack) - 1, 0, -1):
                if self.stack[at].tag in bounds:
                    break
                if self.stack[at].tag in ended:
                    self._close_to(at)
                    break
        at = len(self.stack)
        while at > 1 and self.stack[at - 1].tag not in _HOLDERS:
            at -= 1
        self._close_to(at)

    def _close_to(self, at: int) -> None:
        """Close the elements from ``at`` on, the last one first; all but the first are unfinished."""
        while len(self.stack) > at:
            element = self.stack.pop()
            outer = self.stack[-1]
            if element.tag in BLOCKS:
                self.verbatim -= element.tag == "pre"
                self._end_block(element, outer)
            else:
                outer.inline += self._span(element) if len(self.stack) == at else element.inline

    @staticmethod
    def _span(element: _Element) -> list[str]:
        text = "".join(element.inline)
        body = text.strip(" " + _BREAK)
        if not body:
            return [text]
        head, tail = text[:len(text) - len(text.lstrip(" " + _BREAK))], text[len(text.rstrip(" " + _BREAK)):]
        if element.tag == "a":
            href = element.attrs.get("href")
            return [text] if href is None else [head, f"[{body}]({href})", tail]
        if element.tag == "code":
            ticks = _fence(body, 1)
            pad = " " if body[0] == "`" or body[-1] == "`" else ""
            return [head, ticks, pad, body, pad, ticks, tail]
        return [head, MARKS[element.tag], body, MARKS[element.tag], tail]

    def _end_run(self, element: _Element) -> None:
        run = "".join(element.inline).strip("\n") if element.tag == "pre" else _flat(element.inline)
        element.inline = []
        if run.strip():
            self._keep(element, run)

    def _add(self, element: _Element, block: str, tight: bool = False) -> None:
        if element.inline:
            self._end_run(element)
        self._keep(element, block, tight)

    def _end_block(self, element: _Element, outer: _Element) -> None:
        tag = element.tag
        self._end_run(element)
        if tag in ("td", "th"):
            self._keep(outer, " ".join(b.replace("\n", " ") for b in element.blocks).replace("|", "\\|"))
            return
        if tag == "tr":
            self._keep(outer, tuple(element.blocks))
            return
        if tag in ("thead", "tbody", "tfoot"):
            for row in element.blocks:
                self._keep(outer, row)
            return
        if tag == "li":
            self._keep(outer, self._item(element))
            return
        if not element.blocks:
            return
        if tag in ("ul", "ol"):
            self._add(outer, self._list(element), True)
            return
        if tag == "table":
            text = self._table(element)
        elif tag == "blockquote":
            text = "\n".join(f"> {line}" if line else ">" for line in "\n\n".join(element.blocks).split("\n"))
        elif tag[0] == "h" and tag[1:].isdigit():
            text = "#" * int(tag[1]) + " " + " ".join(element.blocks).replace("  \n", " ")
        elif tag == "pre":
            body = "\n".join(element.blocks)
            fence = _fence(body, 3)
            text = f"{fence}{element.attrs.get('lang', '')}\n{body}\n{fence}"
        else:  # passes its blocks on
            if outer.inline:
                self._end_run(outer)
            outer.blocks += element.blocks
            outer.tight += element.tight
            return
        self._add(outer, text)

    @staticmethod
    def _keep(outer: _Element, part, tight: bool = False) -> None:
        outer.blocks.append(part)
        outer.tight.append(tight)

    @staticmethod
    def _item(element: _Element) -> str:
        text = ""
        for block, tight in zip(element.blocks, element.tight):
            text += block if not text else ("\n" if tight else "\n\n") + block
        return text

    @staticmethod
    def _list(element: _Element) -> str:
        start = element.attrs.get("start") or "1"
        first, items = int(start) if start.lstrip("-").isdigit() else 1, []
        for n, item in enumerate(element.blocks):
            mark = "- " if element.tag == "ul" else f"{first + n}. "
            pad = " " * len(mark)
            items.append(mark + "\n".join(line if not k or not line else pad + line for k, line in enumerate(str(item).split("\n"))))
        return "\n".join(items)

    @staticmethod
    def _table(element: _Element) -> str:
        rows = [b for b in element.blocks if isinstance(b, tuple)]
        beside = [b for b in element.blocks if not isinstance(b, tuple)]  # caption, stray text
        width = max((len(r) for r in rows), default=0)
        if not width:
            return "\n\n".join(beside)
        line = lambda cells: "| " + " | ".join([*cells, *[""] * (width - len(cells))]) + " |"
        return "\n\n".join([*beside, "\n".join([line(rows[0]), line(["---"] * width), *map(line, rows[1:])])])


def to_markdown(html: str, keep_fences: bool = False) -> str:
    """``keep_fences``: stretches of fenced Markdown code pass as they are."""
    if keep_fences and "```" in html:
        parts = re.split(r"(```.*?```)", html, flags=re.S)
        return "\n".join(p for p in (part if k % 2 else to_markdown(part) for k, part in enumerate(parts)) if p)
    if "<" not in html:  # text without tags keeps its lines
        lines = unescape(html).replace("\xa0", " ")
        return re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+\n", "\n", lines)).strip(" \t\r\n")
    tree = _Tree()
    tree.feed(html)
    return tree.finish().replace("\xa0", " ")
