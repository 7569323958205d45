"""Queries over the record sets (cards, sections, units, courses, questions, exams,
versioned contents, search documents)."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.functions.text import strip_hints
from lectern.operators.records import CourseRecords
from lectern.operators.timestamps import rollup_updated_at
from lectern.plans.oracle import with_prelude
from lectern.plans.registry import query, stager, stored_ctx

_RECORDS: dict = {}


def records(spark, sf_dir) -> CourseRecords:
    key = (id(spark), sf_dir)
    if key not in _RECORDS:
        c = stored_ctx(spark, sf_dir)
        _RECORDS[key] = CourseRecords(c.h, lambda: rollup_updated_at(c.h, c.commits, stager(spark, sf_dir, "rollup")),
                                      stage=stager(spark, sf_dir, "records"))
    return _RECORDS[key]


# Oracle building blocks over the prelude: exam flags, card pieces, problem forms.
REC = r"""
ex AS (SELECT seq_id, (graded AND starts_with(format, 'Final Exam')) AS is_exam FROM sq),
card AS (SELECT vtx.*, ex.is_exam FROM vtx JOIN ex USING (seq_id)),
pieces AS (
  SELECT course_id, vert_id, nn, l_returnflag,
    CASE WHEN l_returnflag = 'A' THEN p_name || ' ' || p_type
         WHEN l_returnflag = 'N' AND l_linestatus = 'O' THEN
           '<iframe src="https://exlcode.com/repl?embedded=true&amp;workspace=' ||
           replace(url_encode('{"id":"' ||
             translate(substr(sha256(course_id || '/' || vert_id || '/' || CAST(nn AS VARCHAR) || '/src'), 1, 32),
                       '0123456789', 'ghijklmnop') ||
             '","name":"' || base || '","environmentKey":"python_3_4_free","files":{"main.py":{"name":"main.py",' ||
             '"isDir":false,"isTmplFile":false,"isImmutable":false,"contents":"' || p_type || ' ' || p_name ||
             '"}}}'), '%20', '+') || '" width="100%" height="500px"></iframe>'
         WHEN l_returnflag = 'N' THEN
           '<div class="js-cp-boilerplate">{"js":{"code":"// main.js\n' || p_type || ' ' || p_name ||
           '\n","transformer":"js"},"css":{"code":"","transformer":"css"},"html":{"code":"","transformer":"html"},' ||
           '"showPans":["js","console"],"activePan":"js"}</div>'
    END AS piece,
    CASE WHEN l_returnflag = 'A' THEN p_name || ' ' || p_type END AS text,
    CASE WHEN l_returnflag = 'N' AND l_linestatus = 'O' THEN p_type || ' ' || p_name END AS code,
    CASE WHEN l_returnflag = 'A' THEN
      CASE WHEN course_id = 'R0' THEN ''
           ELSE 'https://github.com/acme/c' || substr(course_id, 2) || '/edit/master/' ||
                array_to_string(list_transform(string_split(vpath || '/' || base || ext, '/'),
                  lambda x: replace(replace(replace(replace(replace(replace(url_encode(x),
                       '%24', '$'), '%26', '&'), '%2B', '+'), '%3A', ':'), '%3D', '='), '%40', '@')), '/')
      END END AS edit_url
  FROM blk),
cc AS (
  SELECT card.course_id, card.vert_id,
    coalesce(string_agg(piece || chr(10) || chr(10), '' ORDER BY nn) FILTER (WHERE piece IS NOT NULL), '') AS content,
    coalesce(string_agg(text, '' ORDER BY nn) FILTER (WHERE text IS NOT NULL), '') AS text,
    coalesce(string_agg(code, '' ORDER BY nn) FILTER (WHERE code IS NOT NULL), '') AS code,
    coalesce(arg_max(edit_url, nn) FILTER (WHERE edit_url IS NOT NULL), '') AS edit_url
  FROM card LEFT JOIN pieces ON pieces.vert_id = card.vert_id
  GROUP BY card.course_id, card.vert_id),
pblk AS (
  SELECT blk.*, p_size % 5 AS form, ex.is_exam,
         row_number() OVER (PARTITION BY blk.vert_id ORDER BY nn) - 1 AS q_rank
  FROM blk JOIN ex USING (seq_id) WHERE l_returnflag = 'R'),
nb AS (SELECT vert_id, count(*) AS n_blocks, max(CASE WHEN l_returnflag <> 'R' THEN 1 ELSE 0 END) AS non_problem
       FROM blk GROUP BY vert_id),
q AS (
  SELECT pblk.*,
    CASE WHEN is_exam THEN vert_id ELSE vert_id || '_q_' || CAST(q_rank AS VARCHAR) END AS qid,
    CASE form WHEN 0 THEN 'MCSA' WHEN 1 THEN 'MCMA' WHEN 2 THEN 'MCSA' WHEN 4 THEN 'WSCQ' END AS question_type,
    CASE WHEN form IN (0, 1, 4) THEN p_name ELSE '' END AS question_text,
    CASE WHEN form = 4 THEN 300 ELSE 60 END AS est_time_sec,
    CASE WHEN form IN (0, 1, 4) THEN p_brand ELSE '' END AS hint,
    CASE WHEN form = 4 AND l_linenumber % 2 = 0 THEN '#!exl::repl(''' || base || '.prob.repl.yaml'')'
         WHEN form = 4 THEN p_brand END AS answer
  FROM pblk LEFT JOIN nb USING (vert_id)
  WHERE form <> 3 AND (NOT is_exam OR (n_blocks = 1 AND non_problem = 0)))
"""


def rec_sql(body: str) -> str:
    return with_prelude(REC.strip() + ",\n" + body.strip())


@query("card_content", rec_sql("""
res AS (SELECT course_id, vert_id, content, text, code, edit_url FROM cc)
SELECT * FROM res
"""))
def q_card_content(spark, sf_dir):
    """AGG-4 / AGG-5 / AGG-6 / PRJ-12 / PRJ-22 / PRJ-23 / PRJ-24: rendered content, search text,
    code and edit URL of every card."""
    return records(spark, sf_dir).contents


@query("versioned_contents", rec_sql("""
res AS (SELECT cc.course_id, cc.vert_id || '_vc' AS id, 1 AS latest_version, 1 AS version, content
        FROM cc JOIN card USING (vert_id) WHERE NOT card.is_exam)
SELECT * FROM res
"""))
def q_versioned_contents(spark, sf_dir):
    """SET-4: one versioned content per card of a non-exam section."""
    return records(spark, sf_dir).versioned_contents


@query("card_records", rec_sql("""
qi AS (SELECT vert_id, string_agg(qid, ',' ORDER BY nn) AS question_ids FROM q WHERE NOT is_exam GROUP BY vert_id),
res AS (
  SELECT card.course_id, card.chapter_id, card.seq_id, card.vert_id AS id, CAST(card.idx + 1 AS BIGINT) AS index,
         vert_title AS title, 'Learn ' || vert_title AS headline, card.vert_id || '_vc' AS content_id,
         coalesce(qi.question_ids, '') AS question_ids, cc.edit_url AS github_edit_url
  FROM card JOIN cc USING (vert_id) LEFT JOIN qi USING (vert_id) WHERE NOT card.is_exam)
SELECT * FROM res
"""))
def q_card_records(spark, sf_dir):
    """Cards: index (position + 1), titles, content id, ordered question ids (AGG-9), edit URL."""
    c = records(spark, sf_dir).card_records
    return c.select("course_id", "chapter_id", "seq_id", "id", "index", "title", "headline", "content_id",
                    F.array_join("question_ids", ",").alias("question_ids"), "github_edit_url")


@query("section_records", rec_sql("""
res AS (SELECT sqx.course_id, sqx.chapter_id, sqx.seq_id AS id, CAST(idx + 1 AS BIGINT) AS index, seq_title AS title,
               'Learn ' || seq_title AS headline
        FROM sqx JOIN ex USING (seq_id) WHERE NOT ex.is_exam)
SELECT * FROM res
"""))
def q_section_records(spark, sf_dir):
    """WIN-2: sections numbered among all sequentials (exams leave gaps), exams filtered after."""
    return records(spark, sf_dir).section_records.drop("updated_at")


@query("unit_records", rec_sql("""
fe AS (SELECT sqx.chapter_id, string_agg(sqx.seq_id || '_exam', ',' ORDER BY sqx.idx) AS ids
       FROM sqx JOIN ex USING (seq_id) WHERE ex.is_exam GROUP BY sqx.chapter_id),
res AS (
  SELECT chx.course_id, chx.chapter_id AS id, CAST(idx + 1 AS BIGINT) AS index, chapter_title AS title,
         'Learn ' || chapter_title AS headline,
         round(100.0 / count(*) OVER (PARTITION BY chx.course_id), 6) AS final_exam_weight_pct,
         CAST(2 AS BIGINT) AS attempts_allowed_per_day, coalesce(fe.ids, '') AS final_exam_ids
  FROM chx LEFT JOIN fe USING (chapter_id))
SELECT * FROM res
"""))
def q_unit_records(spark, sf_dir):
    """AGG-3 + WIN-2: units with index, exam weight (100 / chapters) and final exam ids."""
    u = records(spark, sf_dir).unit_records
    return u.select("course_id", "id", "index", "title", "headline", "final_exam_weight_pct",
                    "attempts_allowed_per_day", F.array_join("final_exam_ids", ",").alias("final_exam_ids"))


@query("course_records", """
SELECT 'R' || r_regionkey AS course_id, 'R' || r_regionkey AS url_name, r_name AS display_name,
       CAST((r_regionkey + 1) * 60 AS BIGINT) AS est_minutes, CAST(r_regionkey AS BIGINT) AS weight,
       CAST(CASE WHEN r_regionkey = 4 THEN NULL ELSE 1 END AS BIGINT) AS skill_level,
       r_name || ',all' AS topics,
       CAST(CASE WHEN r_regionkey % 2 = 0 THEN 1 ELSE 0 END AS BIGINT) AS timekit_intervals,
       CAST(CASE WHEN r_regionkey % 2 = 0 THEN 3600 ELSE 0 END AS BIGINT) AS timekit_seconds,
       CAST(1 AS BIGINT) AS subscription_level, CAST(30 AS BIGINT) AS verified_cert_cost, true AS is_published,
       'images/c' || r_regionkey || '.png' AS cover_url,
       CASE WHEN r_regionkey = 0 THEN 'https://gitlab.com/acme/c0'
            ELSE 'https://github.com/acme/c' || r_regionkey END AS repo_url
FROM region
""")
def q_course_records(spark, sf_dir):
    """PRJ-8 / PRJ-9 / PRJ-10: course records with defaults, topics round trip and timekit."""
    c = records(spark, sf_dir).course_records
    iv = F.col("instructor_timekit.intervals")
    return c.select("course_id", "url_name", "display_name", "est_minutes", "weight", "skill_level",
                    F.array_join("topics", ",").alias("topics"),
                    F.size(iv).alias("timekit_intervals"),
                    F.aggregate(iv, F.lit(0).cast("bigint"), lambda a, x: a + x["duration_seconds"]).alias("timekit_seconds"),
                    "subscription_level", "verified_cert_cost", "is_published", "cover_url", "repo_url")


@query("questions", rec_sql("""
res AS (
  SELECT q.course_id, qid AS id, question_type, question_text, CAST(est_time_sec AS BIGINT) AS est_time_sec, hint,
         is_exam AS exam_only, chapter_id AS ref_unit_id, seq_id AS ref_section_id,
         CASE WHEN is_exam THEN NULL ELSE vert_id END AS ref_card_id,
         CASE WHEN is_exam THEN 'course,unit,section' ELSE 'course,unit,section,card' END AS ref_levels,
         answer,
         CAST(CASE form WHEN 0 THEN 3 WHEN 1 THEN 3 WHEN 2 THEN 2 ELSE 0 END AS BIGINT) AS n_choices,
         CASE form
           WHEN 0 THEN p_brand || ' [true] ' || p_type || chr(10) || p_type || ' [false] ' || chr(10) || p_name || ' [false] '
           WHEN 1 THEN p_brand || ' [true] yes ' || p_type || chr(10) || p_type || ' [false] ' || chr(10) || p_name || ' [true] '
           WHEN 2 THEN '```' || chr(10) || 'print(''' || p_brand || ''')' || chr(10) || '``` [true] ' || chr(10) || p_type || ' [false] '
           ELSE '' END AS choices
  FROM q)
SELECT * FROM res
"""))
def q_questions(spark, sf_dir):
    """SET-2 + JOIN-9 + PRJ-15 + PRJ-16 + WIN-3: card and exam questions with references and whole
    choices (text, whether it is an answer, explanation; in their order)."""
    q = records(spark, sf_dir).questions
    choice = lambda c: F.concat(F.trim(strip_hints(c["text"])), F.lit(" ["), c["correct"].cast("string"), F.lit("] "), c["hint"])
    return q.select("course_id", "id", "question_type", "question_text", "est_time_sec", "hint", "exam_only",
                    "ref_unit_id", "ref_section_id", "ref_card_id",
                    F.array_join(F.transform("doc_refs", lambda r: r["level"]), ",").alias("ref_levels"),
                    "answer", F.coalesce(F.size("choices"), F.lit(0)).alias("n_choices"),
                    F.coalesce(F.array_join(F.transform("choices", choice), "\n"), F.lit("")).alias("choices"))


@query("exam_totals", rec_sql("""
agg AS (SELECT card.seq_id, count(*) AS n, sum(CASE WHEN est_time_sec = 300 THEN 5 ELSE 1 END) AS est,
               sum(CASE WHEN est_time_sec = 300 THEN 8 ELSE 2 END) AS lim,
               string_agg(q.vert_id, ',' ORDER BY card.idx) AS ids
        FROM q JOIN card USING (vert_id) WHERE q.is_exam GROUP BY card.seq_id),
res AS (
  SELECT sq.course_id, sq.seq_id || '_exam' AS id, CAST(coalesce(n, 0) AS BIGINT) AS question_count,
         CAST(coalesce(est, 0) AS BIGINT) AS est_time, CAST(coalesce(lim, 0) AS BIGINT) AS time_limit,
         coalesce(ids, '') AS question_ids, CAST(75 AS BIGINT) AS pass_mark_pct
  FROM sq JOIN ex USING (seq_id) LEFT JOIN agg USING (seq_id) WHERE ex.is_exam)
SELECT * FROM res
"""))
def q_exam_totals(spark, sf_dir):
    """AGG-2 + FLT-3: exam totals over valid exam cards (time rounded half up per question)."""
    e = records(spark, sf_dir).exams
    return e.select("course_id", "id", "question_count", "est_time", "time_limit",
                    F.array_join("question_ids", ",").alias("question_ids"), "pass_mark_pct")


_SEARCH_SQL = rec_sql("""
docs AS (
  SELECT card.course_id, to_base64(('Card:' || card.vert_id)::BLOB) AS id, 'card' AS doc_type, vert_title AS title,
         'Learn ' || vert_title AS headline, cc.text AS text_content, cc.code AS code_content,
         card.course_id AS course_ref, card.chapter_id AS unit_id, card.seq_id AS section_id, card.vert_id AS card_id
  FROM card JOIN cc USING (vert_id) WHERE NOT card.is_exam
  UNION ALL
  SELECT sqx.course_id, to_base64(('Section:' || sqx.seq_id)::BLOB), 'section', seq_title, 'Learn ' || seq_title,
         NULL, NULL, sqx.course_id, sqx.chapter_id, sqx.seq_id, NULL
  FROM sqx JOIN ex USING (seq_id) WHERE NOT ex.is_exam
  UNION ALL
  SELECT course_id, to_base64(('Unit:' || chapter_id)::BLOB), 'unit', chapter_title, 'Learn ' || chapter_title,
         NULL, NULL, course_id, chapter_id, NULL, NULL FROM chx
  UNION ALL
  SELECT 'R' || r_regionkey, to_base64(('Course:R' || r_regionkey)::BLOB), 'course', r_name, r_name || ' in depth',
         'All about ' || r_name, NULL, 'R' || r_regionkey, NULL, NULL, NULL FROM region),
res AS (SELECT docs.*, 'en' AS language FROM docs)
SELECT * FROM res
""")


@query("search_documents", _SEARCH_SQL)
def q_search_documents(spark, sf_dir):
    """SET-1 + PRJ-11 + PRJ-14: the search documents of every course (the flagship query)."""
    return records(spark, sf_dir).search_documents


@query("nested_courses", rec_sql("""
units AS (SELECT course_id, string_agg(chapter_id, ',' ORDER BY idx) AS unit_ids, count(*) AS n_units
          FROM chx GROUP BY course_id),
secs AS (SELECT sqx.course_id, count(*) AS n_sections FROM sqx JOIN ex USING (seq_id) WHERE NOT ex.is_exam
         GROUP BY sqx.course_id),
cards AS (SELECT course_id, count(*) AS n_cards FROM card WHERE NOT is_exam GROUP BY course_id),
res AS (SELECT 'R' || r_regionkey AS course_id, coalesce(unit_ids, '') AS unit_ids,
               CAST(coalesce(n_units, 0) AS BIGINT) AS n_units, CAST(coalesce(n_sections, 0) AS BIGINT) AS n_sections,
               CAST(coalesce(n_cards, 0) AS BIGINT) AS n_cards
        FROM region LEFT JOIN units ON units.course_id = 'R' || r_regionkey
        LEFT JOIN secs ON secs.course_id = 'R' || r_regionkey LEFT JOIN cards ON cards.course_id = 'R' || r_regionkey)
SELECT * FROM res
"""))
def q_nested_courses(spark, sf_dir):
    """AGG-7: nested course documents (units ⊃ sections ⊃ cards), summarised per course."""
    n = records(spark, sf_dir).nested_courses
    units = F.coalesce(F.col("units"), F.array())
    return n.select(
        "course_id",
        F.array_join(F.transform(units, lambda u: u["id"]), ",").alias("unit_ids"),
        F.size(units).alias("n_units"),
        F.aggregate(units, F.lit(0), lambda a, u: a + F.size(F.coalesce(u["sections"], F.array()))).alias("n_sections"),
        F.aggregate(units, F.lit(0), lambda a, u: a + F.aggregate(
            F.coalesce(u["sections"], F.array()), F.lit(0),
            lambda b, s: b + F.coalesce(F.size(s["cards"]), F.lit(0)))).alias("n_cards"))


_CODE_SQL = rec_sql(r"""
cq AS (
  SELECT pblk.*, CASE WHEN is_exam THEN vert_id ELSE vert_id || '_q_' || CAST(q_rank AS VARCHAR) END AS qid,
    '{"id":"' || translate(substr(sha256(course_id || '/' || vert_id || '/' || CAST(nn AS VARCHAR) || '/src'), 1, 32),
                           '0123456789', 'ghijklmnop') ||
    '","name":"","environmentKey":"python_3_4_free","files":{"solution.py":{"name":"solution.py","isDir":false,' ||
    '"isTmplFile":false,"isImmutable":false,"contents":"' || p_type || '"}}}' AS ws
  FROM pblk WHERE form = 4 AND l_linenumber % 2 = 0 AND l_linenumber <> 6)
SELECT course_id, qid AS id, CAST(1 AS BIGINT) AS api_version, 'python_3_4_free' AS environment,
       '{"solution.py":{"name":"solution.py","isDir":false,"isTmplFile":false,"isImmutable":false,"contents":"' ||
       p_type || '"}}' AS src_files, 'null' AS tmpl_files, 'null' AS test_files, 'default' AS grading_strategy,
       '{"main":["' || p_type || '"]}' AS grading_tests,
       p_name || chr(10) || chr(10) || '<iframe src="https://exlcode.com/repl?embedded=true&amp;workspace=' ||
       replace(url_encode(ws), '%20', '+') || '" width="100%" height="500px"></iframe>' AS explanation
FROM cq
""")


@query("code_questions", _CODE_SQL)
def q_code_questions(spark, sf_dir):
    """JOIN-3 + PRJ-7 + PRJ-25: code-question data of string problems answered by a repl."""
    r = records(spark, sf_dir)
    cd = r.code_data.join(r.problem_records.select("course_id", "vert_id", "block_idx", "question_id"),
                          ["course_id", "vert_id", "block_idx"])
    return cd.select("course_id", F.col("question_id").alias("id"), "code.*")


@query("course_attrs", """
SELECT 'R' || r_regionkey AS course_id,
  'description=All about ' || r_name || ';est_minutes=' || CAST((r_regionkey + 1) * 60 AS VARCHAR) ||
  ';headline=' || r_name || ' in depth;info_md=;instructor_timekit=' ||
  CASE WHEN r_regionkey % 2 = 0 THEN '{"intervals":[{"credits":' || CAST(r_regionkey AS VARCHAR) ||
       ',"project_id":"p' || CAST(r_regionkey AS VARCHAR) || '","duration_seconds":3600}]}' ELSE 'null' END ||
  ';primary_topic=' || r_name || ';repo_url=' ||
  CASE WHEN r_regionkey = 0 THEN 'https://gitlab.com/acme/c0' ELSE 'https://github.com/acme/c' || CAST(r_regionkey AS VARCHAR) END ||
  ';topics=' || r_name || ',all;weight=' || CAST(r_regionkey AS VARCHAR) AS attrs
FROM region
""")
def q_course_attrs(spark, sf_dir):
    """PRJ-30: typed course fields as the string attribute map other layouts carry."""
    from lectern.operators.records import course_attrs
    a = course_attrs(records(spark, sf_dir).h.courses)
    return a.select("course_id", F.array_join(F.transform(F.array_sort(F.map_entries("attrs")),
                                                          lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")
                    .alias("attrs"))
