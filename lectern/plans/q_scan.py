"""SRC-1 over real files: the document tree is written as files and scanned (planned listing and
reading, ignored folders, files that are not text), and the scanned catalogue is validated."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.operators.hierarchy import build_hierarchy, store_hierarchy
from lectern.operators.records import CourseRecords
from lectern.operators.validate import violations
from lectern.plans.registry import query, stager
from lectern.sources.catalogue import stored_document_tree
from lectern.sources.tree import scan_tree

_TREE = """WITH d AS (
  SELECT doc_id, source, text, coalesce(toxic, 0) = 1 AS bad, '1_' || lang || '/' || (doc_id % 4) || '_part' AS seq,
         '1_' || lang || '/' || (doc_id % 4) || '_part/' || (doc_id % 16) || '_card' AS vert
  FROM documents LEFT JOIN labels USING (doc_id)),
f AS (
  SELECT source AS course_id, vert || '/' || doc_id || '_doc.md' AS path, strlen(text) + bad::BIGINT AS length,
         CASE WHEN NOT bad THEN md5(text) END AS content_md5, CASE WHEN bad THEN 'not UTF-8 text at byte 0' END AS error FROM d
  UNION ALL SELECT source, vert || '/' || doc_id || '_doc.repl/src/__init__.py', strlen('n = ' || doc_id), md5('n = ' || doc_id), NULL FROM d WHERE doc_id % 50 = 0
  UNION ALL SELECT source, seq || '/' || doc_id || '_x.repl/inner/' || doc_id || '.md', strlen(text), md5(text), NULL FROM d WHERE doc_id % 97 = 3
  UNION ALL SELECT DISTINCT source, 'index.yaml', CASE WHEN source = 'src3' THEN 2 ELSE strlen('url_name: ' || source || chr(10) || 'display_name: ' || source || chr(10)) END,
         CASE WHEN source <> 'src3' THEN md5('url_name: ' || source || chr(10) || 'display_name: ' || source || chr(10)) END,
         CASE WHEN source = 'src3' THEN 'not UTF-8 text at byte 0' END FROM d WHERE source NOT LIKE '%7')"""


@query("scan_tree", _TREE + """
SELECT course_id, path, length, content_md5, error FROM f
""")
def q_scan_tree(spark, sf_dir):
    """SRC-1: every file that is not ignored, with its bytes; undecodable ones say so."""
    files = scan_tree(spark, stored_document_tree(spark, sf_dir), partition_bytes=1 << 20)
    return files.select("course_id", "path", "length", F.md5("content").alias("content_md5"), "error")


@query("scan_violations", _TREE + """
SELECT course_id, 'VAL-13' AS rule, path, error AS message FROM f WHERE error IS NOT NULL
UNION ALL SELECT DISTINCT source, 'VAL-1', 'index.yaml', 'unable to read index configuration' FROM d WHERE source LIKE '%7'
UNION ALL SELECT source, 'VAL-3', seq || '/' || doc_id || '_x.repl/inner', 'invalid directory depth/name combination' FROM d WHERE doc_id % 97 = 3
""")
def q_scan_violations(spark, sf_dir):
    """VAL-1, VAL-3 and VAL-13 on a scanned catalogue."""
    stage = stager(spark, sf_dir, "scan")
    files = stage("files", scan_tree(spark, stored_document_tree(spark, sf_dir)))
    h = store_hierarchy(build_hierarchy(files), f"{stage.base}/levels", spark)
    return violations(CourseRecords(h, stage=stage))
