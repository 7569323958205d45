"""PRJ-21: escaping of ``| & < >`` inside inline code and fenced code (native expressions).

Inline code is the span between a line's first and last backtick; fenced code is the span
between the document's first and last triple backtick. Escape order is pipe, amp, lt,
gt (so a pipe ends up as ``&amp;pipe;``), the inline pass first, then the fence pass.
Unescaping goes entity by entity (amp, pipe, gt, lt), inline span then fence span for
each.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Character ↔ entity pairs, in escape order.
ESCAPES = [("|", "&pipe;"), ("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")]
# Entity → character, in unescape order.
UNESCAPES = [("&amp;", "&"), ("&pipe;", "|"), ("&gt;", ">"), ("&lt;", "<")]


def _replace_all(s: Column, pairs) -> Column:
    for a, b in pairs:
        s = F.replace(s, F.lit(a), F.lit(b))
    return s


def _on_span(s: Column, mark: str, fn) -> Column:
    """Apply ``fn`` to the text strictly between the first and the last ``mark`` of ``s``."""
    n = len(mark)
    first = F.instr(s, mark)
    last = F.length(s) - F.instr(F.reverse(s), mark[::-1]) - n + 2
    start = first + n
    has = (first > 0) & (last > first) & (last >= start)
    head = F.substring(s, F.lit(1), start - 1)
    mid = F.substring(s, start, last - start)
    tail = F.substring(s, last, F.length(s))
    return F.when(has, F.concat(head, fn(mid), tail)).otherwise(s)


def _per_line(text: Column, fn) -> Column:
    return F.array_join(F.transform(F.split(text, "\n"), lambda line: _on_span(line, "`", fn)), "\n")


def escape_code(md) -> Column:
    md = F.col(md) if isinstance(md, str) else md
    # bind the input once: the expression tree must not copy its argument several times
    return F.transform(F.array(md), lambda t: F.transform(
        F.array(_per_line(t, lambda m: _replace_all(m, ESCAPES))),
        lambda u: _on_span(u, "```", lambda m: _replace_all(m, ESCAPES)))[0])[0]


def unescape_code(md) -> Column:
    md = F.col(md) if isinstance(md, str) else md
    def step(pair):
        def fn(t):
            inline = _per_line(t, lambda m: _replace_all(m, [pair]))
            return F.transform(F.array(inline),
                               lambda u: _on_span(u, "```", lambda m: _replace_all(m, [pair])))[0]
        return fn

    out = md
    for pair in UNESCAPES:
        out = F.transform(F.array(out), step(pair))[0]
    return out
