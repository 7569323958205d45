"""TXT-10 / TXT-11 / TXT-12: conversions between HTML, Markdown and problem markup.

HTML ↔ Markdown reads block structure (nested lists, fences, quotes, tables), which a chain of
patterns cannot: ``html_tree`` and ``markdown_blocks`` convert one text each, applied to Arrow batches.
Problem markup (TXT-12) is an ordered chain of native ``regexp_replace`` steps.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.functions.html_tree import to_markdown
from lectern.functions.markdown_blocks import to_html

# Problem text markup (TXT-12), applied to one part.
PROBLEM_MARKUP = [
    (r"(?m)^(.*)\n==+$", r'<h3 class="hd hd-2 problem-header">\1</h3>'),
    (r"(?is)\[explanation\]\n?([^\]]*)\[/?explanation\]",
     "<solution>\n<div class=\"detailed-solution\">\nExplanation\n\n\\1\n</div>\n</solution>"),
    (r"(?is)\[code\]\n?([^\]]*)\[/?code\]", r"<pre><code>\1</code></pre>"),
]


def _spark_repl(r: str) -> str:
    return r.replace("$", "\\$").replace("\\1", "$1").replace("\\2", "$2")


def _chain(c: Column, steps) -> Column:
    for pat, rep in steps:
        c = F.regexp_replace(c, pat, _spark_repl(rep))
    return c


@F.pandas_udf(T.StringType())
def _markdown_of(texts: pd.Series) -> pd.Series:
    return texts.map(to_markdown, na_action="ignore")


@F.pandas_udf(T.StringType())
def _markdown_beside_code(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: to_markdown(t, keep_fences=True), na_action="ignore")


@F.pandas_udf(T.StringType())
def _html_of(texts: pd.Series) -> pd.Series:
    return texts.map(to_html, na_action="ignore")


def html_to_markdown(html, keep_fences: bool = False) -> Column:
    """TXT-10: HTML → Markdown by its tag tree, without blank space at its ends (``keep_fences``: the
    text may hold fenced Markdown code, which passes as it is). A line without a tag, a reference, a
    hard space or a fence only loses that blank space, which needs no tree."""
    c = F.col(html) if isinstance(html, str) else html
    rich = c.rlike("[<&\n\u00a0]|```")
    tree = (_markdown_beside_code if keep_fences else _markdown_of)(F.when(rich, c))
    return F.when(rich, tree).otherwise(F.btrim(c, F.lit(" \t\r\n")))


def markdown_to_html(md) -> Column:
    """TXT-11: Markdown → HTML, block by block; text is escaped."""
    return _html_of(F.col(md) if isinstance(md, str) else md)


def problem_markup(part) -> Column:
    """TXT-12 (tag rewriting part): underlined headers, explanation and code blocks; then
    triple newlines become one. Paragraph wrapping is ``wrap_paragraphs``."""
    c = F.col(part) if isinstance(part, str) else part
    return _chain(c, PROBLEM_MARKUP)


OPENS = r"<(script|pre|label|description)"
CLOSES = r"</(script|pre|label|description)"


def wrap_paragraphs(df, keys: list[str], col: str = "text", out: str = "markup"):
    """TXT-12 (paragraphs), a DataFrame job: lines that do not start with a tag become
    ``<p>line</p>`` unless they sit inside a script/pre/label/description element (a
    running count of opened minus closed elements over the earlier lines); then
    ``\\n\\n\\n`` → ``\\n``. A null text stays null. Lines are exploded and re-joined in order, so a long text is
    never rescanned per line."""
    from pyspark.sql import Window
    lines = df.select(*keys, F.posexplode_outer(F.split(F.col(col), "\n")).alias("ln", "line"))
    flag = F.when(F.col("line").rlike(OPENS), 1).otherwise(0) - F.when(F.col("line").rlike(CLOSES), 1).otherwise(0)
    w = Window.partitionBy(*keys).orderBy("ln").rowsBetween(Window.unboundedPreceding, -1)
    depth = F.coalesce(F.sum(flag).over(w), F.lit(0))
    bare = ~F.col("line").rlike(r"^\s*<") & (F.col("line") != "")
    wrapped = F.when(bare & (depth <= 0) & ~F.col("line").rlike(OPENS),
                     F.concat(F.lit("<p>"), F.col("line"), F.lit("</p>"))).otherwise(F.col("line"))
    joined = (lines.select(*keys, "ln", wrapped.alias("w"))
              .groupBy(*keys).agg(F.expr("listagg(w, '\\n') WITHIN GROUP (ORDER BY ln)").alias("j")))
    return joined.select(*keys, F.regexp_replace("j", "\n\n\n", "\n").alias(out))


def sql_chain(expr: str, steps) -> str:
    """The same chain as DuckDB SQL (oracle side)."""
    for pat, rep in steps:
        p = pat.replace("'", "''")
        r = rep.replace("'", "''").replace("\n", "' || chr(10) || '")
        expr = f"regexp_replace({expr}, '{p}', '{r}', 'g')"
    return expr
