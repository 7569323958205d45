"""Workspace queries over the ``documents`` stand-in: flat files, path lookups (JOIN-7),
batched edits (JOIN-8) and file violations (VAL-10)."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.operators.workspace import apply_file_edits, file_violations, lookup_path
from lectern.plans.registry import query
from lectern.sources import catalogue

KEYS = ["ws"]

WS = """WITH d AS (
  SELECT doc_id, source, lang, text, coalesce(toxic, 0) = 1 AS hidden, coalesce(quality, 1) = 0 AS immutable,
         source || '/' || lang || '/' || CAST(doc_id AS VARCHAR) || '.js' AS path
  FROM documents LEFT JOIN labels USING (doc_id)),
ws AS (
  SELECT path, false AS is_dir, hidden AS is_hidden, immutable AS is_immutable, text AS contents FROM d
  UNION ALL SELECT DISTINCT source, true, false, false, NULL FROM d
  UNION ALL SELECT DISTINCT source || '/' || lang, true, lang = 'fr', false, NULL FROM d)"""


def _ws(spark, sf_dir):
    return catalogue.stored(spark, sf_dir, "workspace", catalogue.workspace_files)


@query("workspace_files", WS + """
SELECT path, is_dir, is_hidden, is_immutable, md5(coalesce(contents, '')) AS contents_md5 FROM ws
""")
def q_workspace_files(spark, sf_dir):
    """SRC-6 (flat form): files and folders of the documents workspace."""
    w = _ws(spark, sf_dir)
    return w.select("path", "is_dir", "is_hidden", "is_immutable",
                    F.md5(F.coalesce("contents", F.lit(""))).alias("contents_md5"))


@query("lookup_path", WS + """
SELECT doc_id AS request_id,
       (doc_id % 4 <> 3 AND lang <> 'fr') AS found,
       CASE WHEN doc_id % 4 <> 3 AND lang <> 'fr' THEN path END AS path
FROM d
""")
def q_lookup_path(spark, sf_dir):
    """JOIN-7: resolve ``./a``, ``/a`` and ``a`` requests; hidden ancestors block, a hidden
    file itself is returned."""
    r = lookup_path(_ws(spark, sf_dir), catalogue.path_requests(spark, sf_dir), KEYS)
    return r.select("request_id", "found", "path")


_EDIT = WS + """,
-- every edit with the folder whose life decides it; folder edits change that folder
e0 AS (
  SELECT doc_id, doc_id % 5 AS k, lang, path AS old_path, hidden OR immutable AS guarded, source || '/new' || (doc_id % 3) AS made, source || '/' || lang AS home,
         CASE WHEN doc_id % 5 IN (0, 1, 3) AND NOT (doc_id % 5 = 1 AND lang = 'de') THEN home WHEN lang = 'es' THEN home ELSE made END AS folder,
         CASE doc_id % 5 WHEN 1 THEN lang = 'de' WHEN 2 THEN lang = 'es' WHEN 4 THEN true ELSE false END AS on_folder,
         CASE doc_id % 5 WHEN 0 THEN 'write' WHEN 1 THEN 'remove' WHEN 2 THEN CASE WHEN lang = 'es' THEN 'remove' ELSE 'write' END WHEN 3 THEN 'write' ELSE 'mkdir' END AS op,
         CASE doc_id % 5 WHEN 0 THEN 'edited ' WHEN 2 THEN 'new ' WHEN 3 THEN 'new ' END || doc_id AS contents
  FROM d),
fe AS (SELECT folder, doc_id AS t, op AS last_op FROM e0 WHERE on_folder),
rm AS (SELECT folder, min(t) AS first_rm, max(t) AS last_rm FROM fe WHERE last_op = 'remove' GROUP BY folder),
e1 AS (
  SELECT e0.*, coalesce(fe.last_op = 'mkdir', e0.folder = home) AS there, coalesce(first_rm > doc_id, true) AS first_life, coalesce(last_rm > doc_id, false) AS taken
  FROM e0 ASOF LEFT JOIN fe ON e0.folder = fe.folder AND e0.doc_id > fe.t LEFT JOIN rm ON rm.folder = e0.folder),
e AS (
  SELECT *, CASE WHEN on_folder THEN folder WHEN k = 2 THEN folder || '/' || doc_id || '.txt' WHEN k = 3 THEN folder || '/' || doc_id || '.txt' ELSE old_path END AS path,
         CASE WHEN op = 'mkdir' THEN 'applied'
              WHEN NOT there THEN CASE op WHEN 'remove' THEN 'refused: no such file' ELSE 'refused: parent is not a folder' END
              WHEN k IN (0, 1) AND NOT on_folder AND first_life AND guarded THEN 'refused: protected file'
              WHEN k = 1 AND NOT on_folder AND NOT first_life THEN 'refused: no such file'
              ELSE 'applied' END AS status FROM e1),
done AS (SELECT * FROM e WHERE status = 'applied' AND NOT on_folder),
stay AS (SELECT * FROM ws WHERE NOT EXISTS (SELECT 1 FROM rm WHERE ws.path = folder OR starts_with(ws.path, folder || '/'))),
after AS (
  SELECT stay.path, is_dir, coalesce(done.contents, stay.contents) AS contents FROM stay LEFT JOIN done ON done.path = stay.path AND k IN (0, 1)
  WHERE coalesce(done.op, '') <> 'remove'
  UNION ALL SELECT path, false, contents FROM done WHERE op = 'write' AND NOT taken AND (k IN (2, 3) OR NOT first_life)
  UNION ALL SELECT folder, true, NULL FROM fe GROUP BY folder
    HAVING arg_max(last_op, t) = 'mkdir' AND folder NOT IN (SELECT path FROM stay))"""


@query("apply_file_edits", _EDIT + """
SELECT path, is_dir, md5(coalesce(contents, '')) AS contents_md5 FROM after
""")
def q_apply_file_edits(spark, sf_dir):
    """JOIN-8: the workspace after a batch of writes, new folders and removes (protected files refuse;
    a removed folder takes its subtree; below a folder made again edits go on)."""
    new, _ = apply_file_edits(_ws(spark, sf_dir), catalogue.file_edits(spark, sf_dir), KEYS)
    return new.select("path", "is_dir", F.md5(F.coalesce("contents", F.lit(""))).alias("contents_md5"))


@query("file_edit_outcomes", _EDIT + """
SELECT path, op, doc_id AS seq, status FROM e
""")
def q_file_edit_outcomes(spark, sf_dir):
    """JOIN-8: outcome of every edit, in sequence order."""
    _, out = apply_file_edits(_ws(spark, sf_dir), catalogue.file_edits(spark, sf_dir), KEYS)
    return out.select("path", "op", "seq", "status")


@query("workspace_violations", WS + """
SELECT path, 'cannot serialise a hidden file' AS message FROM ws WHERE is_hidden
""")
def q_workspace_violations(spark, sf_dir):
    """VAL-10: workspace rows that cannot be written as a workspace document."""
    return file_violations(_ws(spark, sf_dir), KEYS).select("path", "message")
