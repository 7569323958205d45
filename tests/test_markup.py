"""TXT-10 and TXT-11 by literal cases, both ways, and on texts that make naive patterns slow."""

import random
import time

import pytest

from lectern.functions.html_tree import to_markdown
from lectern.functions.markdown_blocks import to_html
from lectern.functions.markup import html_to_markdown, markdown_to_html, wrap_paragraphs

TO_MARKDOWN = {
    "<ol><li>one</li><li>two<ul><li>in</li></ul></li></ol><blockquote>q</blockquote><table><tr><td>1</td><td>2</td></tr></table>&#8217;":
        "1. one\n2. two\n   - in\n\n> q\n\n| 1 | 2 |\n| --- | --- |\n\n’",
    "<ul><li>a<ol><li>b<ul><li>c</ul></ol><li>d</ul>": "- a\n  1. b\n     - c\n- d",
    "<ul><li><p>a</p><p>b</p></li><li>c</li></ul>": "- a\n\n  b\n- c",
    "<ul><li><pre>x\n y</pre></li></ul>": "- ```\n  x\n   y\n  ```",
    "<blockquote><blockquote>deep</blockquote>out</blockquote>": "> > deep\n>\n> out",
    "<p>a<p>b<div>c<h2> d  e </h2>f</div>": "a\n\nb\n\nc\n\n## d e\n\nf",
    "<b>x</b> <strong> y </strong><em>z</em><del>w</del>": "**x** **y** *z*~~w~~",
    "<p>un <b>closed<p>next</b> end": "un closed\n\nnext end",
    "a<br>b<br><br>c<br>": "a  \nb  \nc",
    "<code>a`b</code> <code></code>x": "``a`b`` x",
    "<pre><code class='hl language-go'>if a &lt; b {\n}\n</code></pre>": "```go\nif a < b {\n}\n```",
    "<pre>a\n```\nb</pre>": "````\na\n```\nb\n````",
    "<a href='/u?a=1&amp;b=2'>t</a><a>plain</a><img src=s alt='A B'>": "[t](/u?a=1&b=2)plain![A B](s)",
    "<table><caption>C</caption><tr><th>h</th></tr><tr><td>a|b</td><td>c<br>d</td></tr></table>": "C\n\n| h |  |\n| --- | --- |\n| a\\|b | c   d |",
    "<head><title>t</title><body>x<script>var a = '<p>';</script><style>p{}</style><!-- c --><template>t</template>y": "xy",
    "&lt;b&gt; &eacute;&#x2014;&#65;&nbsp;&unknown;": "<b> é—A &unknown;",
    "plain  text\n\n\n\nkept lines": "plain  text\n\nkept lines",
    "": "", "   ": "", "</p></ul>x": "x", "<li>stray</li>": "stray",
}
TO_HTML = {
    "```\n**a** <b>\n- x\n```": "<pre><code>**a** &lt;b&gt;\n- x\n</code></pre>",
    "~~~ py\na\n```\n~~~\nb": '<pre><code class="py language-py">a\n```\n</code></pre>\n<p>b</p>',
    "```\nnever closed": "<pre><code>never closed\n</code></pre>",
    "`**c**` ``a`b`` `open": "<p><code>**c**</code> <code>a`b</code> `open</p>",
    "one\ntwo\n\nthree": "<p>one\ntwo</p>\n<p>three</p>",
    "- a\n- b\n  - c\n\n    d\n- e": "<ul>\n<li><p>a</p></li>\n<li><p>b</p>\n<ul>\n<li><p>c</p>\n<p>d</p></li>\n</ul></li>\n<li><p>e</p></li>\n</ul>",
    "- a\nlazy\n* other": "<ul>\n<li>a\nlazy</li>\n</ul>\n<ul>\n<li>other</li>\n</ul>",
    "7. a\n8. b": '<ol start="7">\n<li>a</li>\n<li>b</li>\n</ol>',
    "- ```\n  x\n   y\n  ```": "<ul>\n<li><pre><code>x\n y\n</code></pre></li>\n</ul>",
    "text\n2020. not a list": "<p>text\n2020. not a list</p>",
    "> a\nlazy\n> - b\n\nc": "<blockquote>\n<p>a\nlazy</p>\n<ul>\n<li>b</li>\n</ul>\n</blockquote>\n<p>c</p>",
    "# a #\n###### b\n####### c\n#d": "<h1>a</h1>\n<h6>b</h6>\n<p>####### c\n#d</p>",
    "a\n===\nb\n---\n***": "<h1>a</h1>\n<h2>b</h2>\n<hr />",
    "a | b\n--|--\n1 | 2 | 3\n4": "<table>\n<thead>\n<tr><th>a</th><th>b</th></tr>\n</thead>\n<tbody>\n<tr><td>1</td><td>2</td></tr>\n</tbody>\n</table>\n<p>4</p>",
    "**a *b* c** * d * ** e ** f***": "<p><strong>a <em>b</em> c</strong> * d * ** e ** f***</p>",
    "a  \nb\\\nc": "<p>a<br />\nb<br />\nc</p>",
    '![x "y"](u) [**t**](v) [n]': '<p><img src="u" alt="x &quot;y&quot;" /> <a href="v"><strong>t</strong></a> [n]</p>'.replace('"x "', '"x &quot;"'),
    "a < b & c > d": "<p>a &lt; b &amp; c &gt; d</p>",
    "": "", "\n\n": "", "\r\na\r\n": "<p>a</p>",
}


@pytest.mark.parametrize("html", TO_MARKDOWN)
def test_to_markdown(html):
    assert to_markdown(html) == TO_MARKDOWN[html]


@pytest.mark.parametrize("markdown", TO_HTML)
def test_to_html(markdown):
    assert to_html(markdown) == TO_HTML[markdown]


def test_there_and_back():
    """Documents of nested lists, quotes, code and paragraphs come back as they were."""
    rng = random.Random(4)

    def block(depth):
        kind = rng.choice(["p", "p", "ul", "ol", "quote", "code", "head", "rule"][:8 if depth else 3])
        words = " ".join(rng.choice(["a", "b c", "**d**", "*e f*", "`g*`", "[h](/i)"]) for _ in range(3))
        if kind == "p" or (depth == 0 and kind != "p"):
            return words
        if kind == "code":
            return "```py\nx < 1\n\n  **y**\n```"
        if kind == "head":
            return "## " + words
        if kind == "rule":
            return "---"
        if kind == "quote":
            return "\n".join(f"> {line}".rstrip() for line in (block(depth - 1) + "\n\n" + block(0)).split("\n"))
        items = []
        for n in range(2):
            mark = "- " if kind == "ul" else f"{n + 1}. "
            text = block(0)
            if depth > 1 and rng.random() < 0.5:
                text += "\n- " + block(0) + "\n- " + block(0)
            items.append(mark + text.replace("\n", "\n" + " " * len(mark)))
        return "\n".join(items)

    for _ in range(300):
        parts, last = [], None
        for _ in range(4):
            part = block(2)
            if not (last and last[0] in "-123" and part[0] in "-123"):  # two lists in a row would be one
                parts.append(part)
                last = part
        text = "\n\n".join(parts)
        assert to_markdown(to_html(text)) == text


def test_long_texts_take_linear_time():
    for text in ("*a " * 60_000, "**a " * 60_000, "[" * 100_000, "`" + "``x" * 60_000, "> " * 300 + "x", "- a\n" * 20_000, "a\n" * 50_000, "| a " * 20_000 + "\n|-" * 3):
        start = time.time()
        to_html(text)
        assert time.time() - start < 5, text[:10]
    for html in ("<b>" * 20_000 + "x", "<p>a" * 50_000, "<ul><li>" * 150 + "x", "<td>x" * 20_000, "</b>" * 50_000, "&amp;" * 100_000 + "<p>"):
        start = time.time()
        to_markdown(html)
        assert time.time() - start < 10, html[:10]


def test_columns_and_nulls(spark):
    df = spark.createDataFrame([(1, None), (2, "<p>a"), (3, "")], "k int, t string")
    assert [r[1] for r in df.select("k", html_to_markdown("t")).orderBy("k").collect()] == [None, "a", ""]
    assert [r[1] for r in df.select("k", markdown_to_html("t")).orderBy("k").collect()] == [None, "<p>&lt;p&gt;a</p>", ""]
    assert sorted(((r["k"], r["markup"]) for r in wrap_paragraphs(df, ["k"], "t").collect())) == [(1, None), (2, "<p>a"), (3, "")]
