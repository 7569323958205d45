"""DuckDB oracle SQL for the registered queries.

The prelude re-states the stand-in mapping (``lectern.sources.catalogue``) as CTEs over the
driver's tables and computes each expected result directly from the columns the stand-in
rows were made from — an independent route to the same answer.
"""

from __future__ import annotations

from lectern.plans.normalize import ts_sql

# Stand-in mapping as CTEs. vert ids that the library derives are computed with the same
# rule (sha-256 of "<course_id>/<folder>", first 12 hex digits, digits → g..p).
PRELUDE = r"""
ch AS (
  SELECT 'R' || n_regionkey AS course_id, n_nationkey, n_name,
         CAST(n_nationkey AS VARCHAR) || '_' || n_name AS chf,
         'N' || n_nationkey AS chapter_id, n_name AS chapter_title
  FROM nation),
sq AS (
  SELECT ch.course_id, ch.chf, ch.chapter_id, c_custkey, c_name, c_mktsegment,
         CAST(c_custkey AS VARCHAR) || '_' || c_name AS sqf,
         'C' || c_custkey AS seq_id, c_name AS seq_title,
         (c_mktsegment = 'HOUSEHOLD') AS graded,
         CASE WHEN c_custkey % 2 = 0 THEN 'Final Exam' ELSE 'Homework' END AS format
  FROM customer JOIN ch ON c_nationkey = ch.n_nationkey),
vt0 AS (
  SELECT sq.course_id, sq.chf, sq.sqf, sq.chapter_id, sq.seq_id, sq.graded, sq.format,
         o_orderkey, o_orderdate, o_orderpriority,
         CAST(o_orderkey AS VARCHAR) || '_' || o_orderpriority AS vf,
         sq.chf || '/' || sq.sqf || '/' || CAST(o_orderkey AS VARCHAR) || '_' || o_orderpriority AS vpath,
         o_orderkey % 13 AS variant
  FROM orders JOIN sq ON o_custkey = sq.c_custkey
  -- a folder holding no file (no index, no line) does not exist in a files table
  WHERE o_orderkey % 13 <> 0 OR o_orderkey IN (SELECT l_orderkey FROM lineitem)),
vt AS (
  SELECT vt0.*,
         CASE WHEN variant IN (0, 3, 4)
              THEN translate(substr(sha256(course_id || '/' || vpath), 1, 32), '0123456789', 'ghijklmnop')
              ELSE 'O' || o_orderkey END AS vert_id,
         CASE WHEN variant IN (0, 4) THEN o_orderpriority WHEN variant = 2 THEN ''
              ELSE 'Order ' || o_orderkey END AS vert_title
  FROM vt0),
li AS (
  SELECT l.*, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_suppkey, l_linenumber,
         l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) - 1 AS nn
  FROM lineitem l),
blk AS (
  SELECT vt.course_id, vt.chapter_id, vt.seq_id, vt.vert_id, vt.vpath, vt.graded, vt.format, li.*, p.*,
         li.nn AS block_idx,
         printf('%02d_b', li.nn) AS base,
         CASE l_returnflag WHEN 'R' THEN 'problem' WHEN 'A' THEN 'html' ELSE 'exleditor' END AS block_type,
         CASE l_returnflag WHEN 'R' THEN '.prob.md' WHEN 'A' THEN '.md' ELSE '.repl.yaml' END AS ext,
         CASE WHEN l_linestatus = 'O' THEN 'python_3_4_free' ELSE 'javascript_default_free' END AS environment,
         CASE WHEN l_linestatus = 'O' THEN 'py' ELSE 'js' END AS src_ext
  FROM li JOIN part p ON li.l_partkey = p.p_partkey JOIN vt ON li.l_orderkey = vt.o_orderkey),
chx AS (
  SELECT ch.*, row_number() OVER (PARTITION BY course_id ORDER BY chf) - 1 AS idx FROM ch),
sqx AS (
  SELECT sq.*, row_number() OVER (PARTITION BY course_id, chf ORDER BY sqf) - 1 AS idx FROM sq),
vtx AS (
  SELECT vt.*, row_number() OVER (PARTITION BY course_id, chf, sqf ORDER BY vf) - 1 AS idx FROM vt)
"""


def with_prelude(body: str) -> str:
    return "WITH " + PRELUDE.strip() + ",\n" + body.strip()
