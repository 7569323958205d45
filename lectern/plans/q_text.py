"""Queries over the problem-Markdown text jobs (TXT-*) and code escaping (PRJ-21).

Input: one problem document per part (``catalogue.problem_documents``), form chosen by
p_size % 5 (0 single, 1 checkbox, 2 dropdown + multi-line single choice, 3 numeric,
4 string). The oracle SQL states what each form must yield, from the part columns.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import functions as F

from lectern.functions.escaping import escape_code, unescape_code
from lectern.operators.problems import ParsedProblems, question_choices
from lectern.plans.registry import query
from lectern.sources import catalogue

KEYS = ["doc_id"]

PD = """WITH pd AS (SELECT p_partkey AS doc_id, p_size % 5 AS form, p_name, p_type, p_brand, p_retailprice,
                       p_size FROM part)"""


@lru_cache(maxsize=8)
def _parsed(spark, sf_dir) -> ParsedProblems:
    return ParsedProblems(catalogue.problem_documents(spark, sf_dir), KEYS)


@query("split_parts", PD + """,
body AS (
  SELECT doc_id, form, '>>' || p_name || '||' || p_type || '<<' || chr(10) || chr(10) AS head,
         chr(10) || '|| ' || p_brand || ' ||' AS tail,
         CASE form
           WHEN 0 THEN '(x) ' || p_brand || ' {{Right:: ' || p_type || '}}' || chr(10) || '( ) ' || p_type || chr(10) ||
                       '(!@) ' || p_name || chr(10)
           WHEN 1 THEN '[x] ' || p_brand || ' {{selected: yes ' || p_type || '},{unselected: no ' || p_type || '}}' || chr(10) ||
                       '[ ] ' || p_type || chr(10) || '[x] ' || p_name || chr(10)
           WHEN 2 THEN '[[' || p_type || ', (' || p_brand || '), ' || p_name || ']]'
           WHEN 4 THEN 's= ' || p_brand || chr(10) || 'or= ' || p_type || chr(10) ||
                       'not= ' || p_name || ' {{Not ' || p_name || '}}' || chr(10)
         END AS lines
  FROM pd)
SELECT doc_id, 0 AS part_idx,
       CASE form WHEN 3 THEN trim(head, chr(10)) WHEN 2 THEN head || lines ELSE head || lines || tail END AS part FROM body
UNION ALL SELECT doc_id, 1, '+(x) ```' || chr(10) || 'print(''' || p_brand || ''')' || chr(10) || '``` -(x)-' || chr(10) ||
                            '+( ) ' || p_type || ' -( )-' FROM pd WHERE form = 2
""")
def q_split_parts(spark, sf_dir):
    """TXT-0 / TXT-1: the whole parts of each document, without line breaks at their ends; of numeric
    problems without the answer lines, which ``answers_numeric`` compares."""
    p = _parsed(spark, sf_dir).parts
    part = F.regexp_replace("part", r"(?m)^(= |or= )[0-9].*$", "")
    return p.select("doc_id", "part_idx", F.regexp_replace(part, r"^\n+|\n+$", "").alias("part"))


@query("question_labels", PD + """
SELECT doc_id, 0 AS part_idx, 0 AS label_idx, p_name AS label, p_type AS description FROM pd
""")
def q_question_labels(spark, sf_dir):
    """TXT-2: ``>>label||description<<``."""
    return _parsed(spark, sf_dir).labels


@query("demand_hints", PD + """
SELECT doc_id, 0 AS part_idx, p_brand AS hint FROM pd WHERE form IN (0, 1, 4)
""")
def q_demand_hints(spark, sf_dir):
    """TXT-3: ``|| hint ||`` lines."""
    return _parsed(spark, sf_dir).hints.select("doc_id", "part_idx", "hint")


@query("choices_single", PD + """
SELECT doc_id, 0 AS part_idx, p_brand AS text, true AS correct, false AS fixed, true AS shuffle,
       p_type AS hint, 'Right' AS hint_label FROM pd WHERE form = 0
UNION ALL SELECT doc_id, 0, p_type, false, false, true, '', '' FROM pd WHERE form = 0
UNION ALL SELECT doc_id, 0, p_name, false, true, true, '', '' FROM pd WHERE form = 0
UNION ALL SELECT doc_id, 1, '```' || chr(10) || 'print(''' || p_brand || ''')' || chr(10) || '```',
       true, false, false, '', '' FROM pd WHERE form = 2
UNION ALL SELECT doc_id, 1, p_type, false, false, false, '', '' FROM pd WHERE form = 2
""")
def q_choices_single(spark, sf_dir):
    """TXT-4 + TXT-5: single-choice lines and multi-line single choices."""
    return _parsed(spark, sf_dir).single.drop("run", "line_no")


@query("choices_multi", PD + """
SELECT doc_id, 0 AS part_idx, p_brand AS text, true AS correct, 'yes ' || p_type AS hint_selected,
       'no ' || p_type AS hint_unselected FROM pd WHERE form = 1
UNION ALL SELECT doc_id, 0, p_type, false, NULL, NULL FROM pd WHERE form = 1
UNION ALL SELECT doc_id, 0, p_name, true, NULL, NULL FROM pd WHERE form = 1
""")
def q_choices_multi(spark, sf_dir):
    """TXT-6: checkbox choices with selected / unselected hints."""
    return _parsed(spark, sf_dir).multi.drop("run", "line_no")


@query("options_dropdown", PD + """
SELECT doc_id, 0 AS part_idx, 0 AS dropdown, 0 AS option_idx, p_type AS text, false AS correct, '' AS hint,
       '' AS hint_label FROM pd WHERE form = 2
UNION ALL SELECT doc_id, 0, 0, 1, p_brand, true, '', '' FROM pd WHERE form = 2
UNION ALL SELECT doc_id, 0, 0, 2, p_name, false, '', '' FROM pd WHERE form = 2
""")
def q_options_dropdown(spark, sf_dir):
    """TXT-7: dropdown options."""
    return _parsed(spark, sf_dir).dropdowns


@query("answers_numeric", PD + """
SELECT doc_id, 0 AS part_idx, CAST(p_retailprice AS VARCHAR) AS answer, '0.5' AS tolerance, false AS is_range,
       '' AS hint, CAST(p_retailprice + 1 AS VARCHAR) AS additional_answers FROM pd WHERE form = 3
""")
def q_answers_numeric(spark, sf_dir):
    """TXT-8: numeric answers with tolerance and additional answers."""
    n = _parsed(spark, sf_dir).numeric
    return n.select("doc_id", "part_idx", "answer", "tolerance", "is_range", "hint",
                    F.array_join("additional_answers", ";").alias("additional_answers"))


@query("answers_string", PD + """
SELECT doc_id, 0 AS part_idx, p_brand AS answer, 'ci' AS match_type, '' AS hint, p_type AS additional_answers,
       p_name || '=>Not ' || p_name AS not_hints FROM pd WHERE form = 4
""")
def q_answers_string(spark, sf_dir):
    """TXT-9: string answers, ``or=`` answers and ``not=`` hints."""
    s = _parsed(spark, sf_dir).string
    return s.select("doc_id", "part_idx", "answer", "match_type", "hint",
                    F.array_join("additional_answers", ";").alias("additional_answers"),
                    F.array_join(F.transform("not_hints", lambda x: F.concat(x["answer"], F.lit("=>"), x["hint"])),
                                 ";").alias("not_hints"))


_RECORDS_SQL = PD + """
SELECT doc_id,
  CASE form WHEN 0 THEN 'multiplechoiceresponse' WHEN 1 THEN 'choiceresponse' WHEN 2 THEN 'multiplechoiceresponse'
            WHEN 4 THEN 'stringresponse' END AS kind,
  CASE form WHEN 0 THEN 'MCSA' WHEN 1 THEN 'MCMA' WHEN 2 THEN 'MCSA' WHEN 4 THEN 'WSCQ' END AS question_type,
  CASE WHEN form IN (0, 1, 4) THEN p_name ELSE '' END AS label,
  CASE WHEN form = 4 THEN p_brand END AS answer,
  CASE WHEN form = 4 THEN 'ci' END AS match_type,
  CASE WHEN form IN (0, 1, 4) THEN p_brand END AS demand_hint,
  CASE form
    WHEN 0 THEN p_brand || '|true|' || p_type || ';' || p_type || '|false|;' || p_name || '|false|'
    WHEN 1 THEN p_brand || '|true|yes ' || p_type || ';' || p_type || '|false|;' || p_name || '|true|'
    WHEN 2 THEN '```' || chr(10) || 'print(''' || p_brand || ''')' || chr(10) || '```|true|;' || p_type || '|false|'
  END AS choices
FROM pd
"""


@query("problem_records", _RECORDS_SQL)
def q_problem_records(spark, sf_dir):
    """TXT-13: one question record per document."""
    r = _parsed(spark, sf_dir).records()
    flat = F.array_join(F.transform("choices", lambda c: F.concat_ws(
        "|", c["text"], c["correct"].cast("string"), c["hint"])), ";")
    return r.select("doc_id", "kind", "question_type", "label", "answer", "match_type", "demand_hint",
                    flat.alias("choices"))


@query("question_choices", PD + """
SELECT doc_id, 10 AS seq, p_brand AS text, true AS is_answer, p_type AS explanation FROM pd WHERE form = 0
UNION ALL SELECT doc_id, 20, p_type, false, '' FROM pd WHERE form = 0
UNION ALL SELECT doc_id, 30, p_name, false, '' FROM pd WHERE form = 0
UNION ALL SELECT doc_id, 10, p_brand, true, 'yes ' || p_type FROM pd WHERE form = 1
UNION ALL SELECT doc_id, 20, p_type, false, '' FROM pd WHERE form = 1
UNION ALL SELECT doc_id, 30, p_name, true, '' FROM pd WHERE form = 1
UNION ALL SELECT doc_id, 10, '```' || chr(10) || 'print(''' || p_brand || ''')' || chr(10) || '```', true, ''
  FROM pd WHERE form = 2
UNION ALL SELECT doc_id, 20, p_type, false, '' FROM pd WHERE form = 2
""")
def q_question_choices(spark, sf_dir):
    """TXT-14 + WIN-4: answer choices with sequence (position+1)*10."""
    return question_choices(_parsed(spark, sf_dir).records(), KEYS)


@query("escape_code", """
SELECT p_partkey AS doc_id, 'inline' AS variant,
       p_name || ' `a&amp;pipe;' || CAST(p_size AS VARCHAR) || '&amp;b` c' AS escaped, true AS roundtrip
FROM part
UNION ALL
SELECT p_partkey, 'fenced', '```' || chr(10) || p_name || ' &lt;x&gt; &amp;pipe; y &amp; z' || chr(10) || '```', true
FROM part
""")
def q_escape_code(spark, sf_dir):
    """PRJ-21: escape inline / fenced code and check that unescaping restores the text."""
    t = catalogue.code_texts(spark, sf_dir)
    e = escape_code(F.col("text"))
    return t.select("doc_id", "variant", e.alias("escaped"),
                    (unescape_code(escape_code(F.col("text"))) == F.col("text")).alias("roundtrip"))
