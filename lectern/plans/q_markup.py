"""HTML ↔ Markdown and problem markup queries (TXT-10, TXT-11, TXT-12). The SQL of the conversions
states what the tables' own texts become; it shares nothing with the library."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.functions.markup import (PROBLEM_MARKUP, html_to_markdown, markdown_to_html, problem_markup, sql_chain, wrap_paragraphs)
from lectern.operators.problems import split_parts
from lectern.plans.registry import query
from lectern.sources import catalogue
from lectern.sources.catalogue import table
from lectern.plans.q_xml import PROBLEM_MD_SQL


def _steps(expr: str, *steps: tuple[str, str]) -> str:
    for pattern, by in steps:
        expr = f"regexp_replace({expr}, '{pattern}', {by}, 'g')"
    return expr


# Pages: chr(1) ends a block, chr(2) begins a list item, chr(3) is a line break. Their <b> is never closed.
_PAGE = _steps("html", ("(?s)<!--.*?-->|<head>.*?</head>|<!DOCTYPE[^>]*>", "''"), (r"\s+", "' '"), ("<li>", "chr(2)"), ("</li>|</?b>", "''"),
               ('<a href="([^"]*)">([^<]*)</a>', r"'[\2](\1)'"), ("<h1>", "chr(1) || '# '"), ("<br>", "chr(3)"), ("<[^>]+>", "chr(1)"))
_PAGE = (f"replace(replace(replace(replace(replace({_PAGE}, '&quot;', '\"'), '&copy;', '©'), '&middot;', '·'), '&lt;', '<'), '&gt;', '>')")
_PAGE = _steps(f"replace({_PAGE}, '&amp;', '&')", ("[ \x01\x03]*\x01[ \x01\x03]*", "chr(1)"), (" *\x03[ \x03]*", "'  ' || chr(10)"),
               ("\x01\x02 *", "chr(1) || '- '"), (" *\x02 *", "chr(10) || '- '"), (" +([\x01\n])", r"'\1'"))
_PAGE = f"trim(replace({_PAGE}, chr(1), chr(10) || chr(10)), ' ' || chr(10))"


@query("html_to_markdown", f"SELECT page_id, {_PAGE} AS markdown FROM pages")
def q_html_to_markdown(spark, sf_dir):
    """TXT-10: every web page's HTML as Markdown."""
    return table(spark, sf_dir, "pages").select("page_id", html_to_markdown("html").alias("markdown"))


@query("html_blocks", """SELECT p_partkey AS doc_id, CASE p_size % 6
  WHEN 0 THEN concat_ws(chr(10), '1. ' || p_name, '2. ' || p_type, '   - ' || p_brand, '   - **' || p_name || '**', '', 'after')
  WHEN 1 THEN concat_ws(chr(10), '> ' || p_name, '>', '> - ' || p_type, '', '’' || p_brand || '—&')
  WHEN 2 THEN concat_ws(chr(10), '| ' || p_name || ' | k |', '| --- | --- |', '| ' || p_type || '\\|x | `' || p_brand || '` |')
  WHEN 3 THEN concat_ws(chr(10), '```py', 'if a < b:', '  # ' || p_name, '```', '', '### ' || p_type)
  WHEN 4 THEN concat_ws(chr(10), p_name || '  ', p_type, '', '*' || p_brand || '* [' || p_name || '](/x) open', '', '---')
  ELSE concat_ws(chr(10), '9. ' || p_name, '', '   ' || p_type, '10. ' || p_brand) END AS markdown FROM part""")
def q_html_blocks(spark, sf_dir):
    """TXT-10: lists in lists, quotes, tables, code, references and open elements."""
    return catalogue.markup_documents(spark, sf_dir).select("doc_id", html_to_markdown("html").alias("markdown"))


# Documents have no Markdown but plain lines without a blank one between: one paragraph each.
@query("markdown_to_html", """SELECT doc_id, CASE WHEN trim(text, ' ' || chr(9) || chr(10)) = '' THEN '' ELSE '<p>' || array_to_string(list_transform(
  string_split(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), chr(10)), lambda line: trim(line)), chr(10)) || '</p>' END AS html FROM documents""")
def q_markdown_to_html(spark, sf_dir):
    """TXT-11: every document's text (as Markdown) rendered to HTML."""
    return table(spark, sf_dir, "documents").select("doc_id", markdown_to_html("text").alias("html"))


@query("markdown_blocks", """SELECT p_partkey AS doc_id, CASE p_size % 6
  WHEN 0 THEN concat_ws(chr(10), '<ol>', '<li>' || p_name || '</li>', '<li>' || p_type, '<ul>', '<li>' || p_brand || '</li>', '<li><strong>' || p_name || '</strong></li>', '</ul></li>', '</ol>', '<p>after</p>')
  WHEN 1 THEN concat_ws(chr(10), '<pre><code class="py language-py">**' || p_name || '** &lt;' || p_type || '&gt;', '', '# ' || p_brand, '</code></pre>', '<p>tail</p>')
  WHEN 2 THEN concat_ws(chr(10), '<p>' || p_name || ' <code>**' || p_type || '**</code> and <em>' || p_brand || '</em>', 'second line</p>', '<blockquote>', '<p>' || p_name, 'more</p>', '</blockquote>')
  WHEN 3 THEN concat_ws(chr(10), '<table>', '<thead>', '<tr><th>' || p_name || '</th><th>k</th></tr>', '</thead>', '<tbody>', '<tr><td>' || p_type || '</td><td><code>' || p_brand || '</code></td></tr>', '</tbody>', '</table>')
  WHEN 4 THEN concat_ws(chr(10), '<ul>', '<li><p>' || p_name || '</p></li>', '<li><p>' || p_type || '</p></li>', '</ul>', '<h2>' || p_brand || '</h2>', '<hr />')
  ELSE concat_ws(chr(10), '<h1>' || p_name || '</h1>', '<p>' || p_type || '<br />', p_brand || '</p>') END AS html FROM part""")
def q_markdown_blocks(spark, sf_dir):
    """TXT-11: nested lists, fenced code, code spans, quotes, tables, headings and breaks."""
    return catalogue.markup_documents(spark, sf_dir).select("doc_id", markdown_to_html("markdown").alias("html"))


_PARTS = f"""WITH pd AS (SELECT p_partkey AS doc_id, {PROBLEM_MD_SQL} AS text FROM part),
parts AS (
  SELECT doc_id, unnest(ps) AS part, generate_subscripts(ps, 1) - 1 AS part_idx
  FROM (SELECT doc_id, list_filter(string_split_regex(replace(text, chr(13) || chr(10), chr(10)),
                                                      '\\n\\s*---\\s*\\n'), lambda p: trim(p) <> '') AS ps FROM pd)),
mk AS (SELECT doc_id, part_idx, {sql_chain('part', PROBLEM_MARKUP)} AS m FROM parts),
ln AS (SELECT doc_id, part_idx, unnest(string_split(m, chr(10))) AS line,
              generate_subscripts(string_split(m, chr(10)), 1) AS ln FROM mk),
fl AS (SELECT *, CASE WHEN regexp_matches(line, '<(script|pre|label|description)') THEN 1 ELSE 0 END
                 - CASE WHEN regexp_matches(line, '</(script|pre|label|description)') THEN 1 ELSE 0 END AS f FROM ln),
dp AS (SELECT *, coalesce(sum(f) OVER (PARTITION BY doc_id, part_idx ORDER BY ln
                 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS depth FROM fl),
wr AS (SELECT doc_id, part_idx, ln,
              CASE WHEN NOT regexp_matches(line, '^\\s*<') AND line <> '' AND depth <= 0
                        AND NOT regexp_matches(line, '<(script|pre|label|description)')
                   THEN '<p>' || line || '</p>' ELSE line END AS w FROM dp)
SELECT doc_id, part_idx, replace(string_agg(w, chr(10) ORDER BY ln), chr(10) || chr(10) || chr(10), chr(10)) AS markup
FROM wr GROUP BY doc_id, part_idx"""


@query("text_markup", _PARTS)
def q_text_markup(spark, sf_dir):
    """TXT-12: problem parts with headers, explanation / code blocks and paragraphs marked up."""
    parts = split_parts(catalogue.problem_documents(spark, sf_dir), ["doc_id"])
    marked = parts.select("doc_id", "part_idx", problem_markup(F.col("part")).alias("text"))
    return wrap_paragraphs(marked, ["doc_id", "part_idx"])
