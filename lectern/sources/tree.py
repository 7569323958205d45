"""SRC-1 / SRC-2: course trees as a ``files`` table and their YAML index files.

``files`` has one row per file: ``course_id, path, content`` where ``path`` is relative
to the course root (``01_Ch/02_Sec/03_Card/00_text.md``). It can come from a scan of course
folders (``scan_tree``, which adds ``length`` and ``error``) or from any table with those columns.
"""

from __future__ import annotations

import json
import re
import uuid

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.operators.prefix import running_total

#: Bytes of content that a reading task passes on at a time.
READ_BATCH = 16 << 20
MSG_NOT_TEXT = "not UTF-8 text"

# Index file names in order of preference.
INDEX_NAMES = ["index.yaml", "index.yml"]

# Typed view of an index file. Scalars are read as text and converted natively, so a
# bad value becomes a violation row instead of a failed task.
INDEX_SCHEMA = T.StructType([
    T.StructField("url_name", T.StringType()),
    T.StructField("display_name", T.StringType()),
    T.StructField("org", T.StringType()),
    T.StructField("course", T.StringType()),
    T.StructField("course_image", T.StringType()),
    T.StructField("language", T.StringType()),
    T.StructField("headline", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("topics", T.ArrayType(T.StringType())),
    T.StructField("primary_topic", T.StringType()),
    T.StructField("skill_level", T.StringType()),
    T.StructField("info_md", T.StringType()),
    T.StructField("repo_url", T.StringType()),
    T.StructField("weight", T.StringType()),
    T.StructField("est_minutes", T.StringType()),
    T.StructField("instructor_timekit", T.StringType()),
    T.StructField("graded", T.StringType()),
    T.StructField("format", T.StringType()),
])

REPL_SCHEMA = T.StructType([
    T.StructField("api_version", T.StringType()),
    T.StructField("environment", T.StringType()),
    T.StructField("src_path", T.StringType()),
    T.StructField("explanation", T.StringType()),
    T.StructField("tmpl_path", T.StringType()),
    T.StructField("test_path", T.StringType()),
    T.StructField("display", T.StructType([T.StructField("height", T.StringType())])),
    T.StructField("tests", T.MapType(T.StringType(), T.ArrayType(T.StringType()))),
    T.StructField("grading_strategy", T.StringType()),
])

_PARSED = T.StructType([T.StructField("json", T.StringType()),
                        T.StructField("error", T.StringType())])


def _loader():
    import yaml
    return getattr(yaml, "CSafeLoader", yaml.SafeLoader)


# What follows reads the documents that most index files are, one line of JSON and ``key: value`` lines, to
# the mapping that the YAML loader gives, many times faster. Whatever it is not sure of, the loader reads.
_WORDS = {word: value for words, value in (("true yes on", True), ("false no off", False), ("null", None))
          for w in words.split() for word in (w, w.capitalize(), w.upper())}
_PAIR = re.compile(r"""([A-Za-z_][A-Za-z0-9_]{0,99}):(?:[ ]+(?:
    (?P<plain>[A-Za-z][A-Za-z0-9_./()+,!?&;*'"@%=~-]*(?:[ ]+[A-Za-z0-9_./()+,!?&;*'"@%=~-]+)* | [A-Za-z]+://[A-Za-z0-9_./?&=%~+-]+)
    | (?P<number>0|[1-9][0-9]{0,17}) | '(?P<single>[^'\\]*)' | "(?P<double>[^"\\]*)" | (?P<none>\[\])))?""", re.X)
_LONG_KEY = re.compile(r'"[^"]{1000,}"\s*:')


def _float(text: str) -> float:
    if "e" in text or "E" in text:
        raise ValueError("text in YAML")
    return float(text)


def _constant(text: str):
    raise ValueError("text in YAML")


def _json_reader():
    return json.JSONDecoder(parse_float=_float, parse_constant=_constant).decode


def _simple_document(text: str, read_json) -> dict | None:
    """The mapping of a simple document; None: the YAML loader is to read it."""
    if text.startswith("{"):
        if (not text.isprintable() or "\\u" in text or "\\/" in text or text.count("{") + text.count("[") > 100
                or (len(text) > 1000 and _LONG_KEY.search(text))):
            return None
        try:
            return read_json(text)
        except ValueError:
            return None
    doc = {}
    for line in text.split("\n"):
        if line == "":
            continue
        pair = _PAIR.fullmatch(line)
        if pair is None or not line.isprintable() or pair[1].lower() in _WORDS:
            return None
        plain = pair["plain"]
        if plain is not None:
            if plain in _WORDS:
                doc[pair[1]] = _WORDS[plain]
            elif plain.lower() in _WORDS:
                return None
            else:
                doc[pair[1]] = plain
        elif pair["number"] is not None:
            doc[pair[1]] = int(pair["number"])
        elif pair["none"] is not None:
            doc[pair[1]] = []
        else:
            doc[pair[1]] = pair["single"] if pair["single"] is not None else pair["double"]
    return doc or None


@F.pandas_udf(_PARSED)
def yaml_to_json(texts: pd.Series) -> pd.DataFrame:
    """YAML document → JSON text (vectorised over an Arrow batch); error text on failure."""
    import yaml
    loader, read_json = _loader(), _json_reader()
    out_json, out_err = [], []
    for t in texts:
        if t is None:
            out_json.append(None)
            out_err.append(None)
            continue
        try:
            doc = _simple_document(t, read_json)
            if doc is None:
                doc = yaml.load(t, Loader=loader)
            if doc is None:
                doc = {}
            if not isinstance(doc, dict):
                raise ValueError("index document is not a mapping")
            out_json.append(json.dumps(doc, default=str))
            out_err.append(None)
        except Exception as exc:  # noqa: BLE001 - any parse failure is a VAL-13 row
            out_json.append(None)
            out_err.append(str(exc) or type(exc).__name__)
    return pd.DataFrame({"json": out_json, "error": out_err})


def parse_yaml(content: Column, schema: T.StructType) -> Column:
    """struct(doc: <schema>, error: string) for a YAML text column."""
    parsed = yaml_to_json(content)
    return F.struct(F.from_json(parsed["json"], schema).alias("doc"), parsed["error"].alias("error"))


def with_path_parts(files: DataFrame) -> DataFrame:
    """Adds ``parts``, ``depth`` (number of folders above the file), ``name`` and ``folder``."""
    path, name = F.col("path"), F.substring_index("path", "/", -1)
    above = F.greatest(F.length(path) - F.length(name) - 1, F.lit(0))
    return files.withColumns({"parts": F.split(path, "/"), "name": name,
                              "depth": F.length(path) - F.length(F.replace(path, F.lit("/"), F.lit(""))),
                              "folder": F.substring(path, F.lit(1), above)})


def file_system(root: str):
    """The Arrow file system of ``root`` and the root's path there. Local and mounted folders,
    ``file:``, ``hdfs://``, ``s3://`` and ``gs://``: executors list and read through it themselves."""
    from pyarrow import fs
    if root.startswith("file:/") and not root.startswith("file://"):
        root = "file://" + root[len("file:"):]
    system, path = fs.FileSystem.from_uri(root)
    return system, path.rstrip("/")


def list_tree(spark: SparkSession, root: str) -> DataFrame:
    """The files below ``root/<course>/…`` as ``(course_id, path, length, error)``; no content is read.

    Folders are listed level by level as a distributed frontier: every folder is one row, listed by
    one task, so a course that holds most files spreads like any other. Ignored folders (at the
    levels where they are ignored, and as a course) are dropped before they are listed: nothing
    below them is seen. Files directly below the root belong to no course and are left out. A folder
    that cannot be listed becomes a row with its ``error`` and no length.
    """
    from lectern.functions.paths import IGNORED_DIRS
    from lectern.session import run_dir
    base = f"{run_dir(spark)}/lectern-scan/{uuid.uuid4().hex}"
    ignored = frozenset(IGNORED_DIRS)

    def listed(batches):
        from pyarrow import fs
        system, top = file_system(root)
        for batch in batches:
            out = {"rel": [], "is_dir": [], "length": [], "error": []}
            for rel in batch.column("rel").to_pylist():
                try:
                    found = system.get_file_info(fs.FileSelector(f"{top}/{rel}" if rel else top, recursive=False))
                except OSError as exc:
                    found = []
                    for name, value in (("rel", rel), ("is_dir", False), ("length", None), ("error", f"unreadable folder: {type(exc).__name__}")):
                        out[name].append(value)
                level = rel.count("/") + 1 if rel else 0  # of what lies in the folder: 0 is a course
                for info in found:
                    is_dir = info.type == fs.FileType.Directory
                    if (level == 0 and not is_dir) or (is_dir and level <= 3 and info.base_name in ignored):
                        continue
                    out["rel"].append(f"{rel}/{info.base_name}" if rel else info.base_name)
                    out["is_dir"].append(is_dir)
                    out["length"].append(None if is_dir else info.size)
                    out["error"].append(None)
            yield pa.RecordBatch.from_pydict({"rel": pa.array(out["rel"], pa.string()), "is_dir": pa.array(out["is_dir"], pa.bool_()),
                                              "length": pa.array(out["length"], pa.int64()), "error": pa.array(out["error"], pa.string())})

    schema = "rel string, is_dir boolean, length long, error string"
    frontier, levels = spark.createDataFrame([("",)], "rel string"), []
    while True:
        path = f"{base}/level{len(levels)}"
        frontier.repartition(F.col("rel")).mapInArrow(listed, schema).write.parquet(path)
        levels.append(path)
        found = spark.read.schema(schema).parquet(path)
        frontier = found.where("is_dir").select("rel")
        if frontier.isEmpty():
            break
    files = spark.read.schema(schema).parquet(*levels).where(~F.col("is_dir") & (F.col("rel") != ""))
    return files.select(F.substring_index("rel", "/", 1).alias("course_id"),
                        F.when(F.col("rel").contains("/"), F.expr("substr(rel, instr(rel, '/') + 1)")).otherwise("").alias("path"), "length", "error")


def read_files(spark: SparkSession, root: str, listed: DataFrame, partition_bytes: int = 64 << 20) -> DataFrame:
    """``listed`` files with their text: ``(course_id, path, length, content, error)``.

    The listing is cut into runs of about ``partition_bytes`` along the path order (a two-level
    prefix sum of the lengths), one task each; a file larger than that is a run of its own. A file
    that cannot be read or is not UTF-8 has no content and says why in ``error``.
    """
    planned = running_total(listed, ["course_id", "path"], "length").withColumn("run", F.floor(F.col("start") / partition_bytes))
    runs = (planned.agg(F.max("run")).first()[0] or 0) + 1

    def read(batches):
        system, top = file_system(root)
        for batch in batches:
            rows, held = [], 0
            for course, path, length, error in zip(*(batch.column(c).to_pylist() for c in ("course_id", "path", "length", "error"))):
                content = None
                if error is None:
                    try:
                        with system.open_input_stream(f"{top}/{course}/{path}") as stream:
                            content = stream.read()
                        content.decode()
                    except UnicodeDecodeError as exc:
                        content, error = None, f"{MSG_NOT_TEXT} at byte {exc.start}"
                    except OSError as exc:
                        content, error = None, f"unreadable file: {type(exc).__name__}"
                rows.append((course, path, length, content, error))
                held += len(content or b"")
                if held >= READ_BATCH:
                    yield _file_batch(rows)
                    rows, held = [], 0
            yield _file_batch(rows)

    dealt = planned.repartitionByRange(runs, "run") if runs > 1 else planned.coalesce(1)
    return dealt.select("course_id", "path", "length", "error").mapInArrow(read, "course_id string, path string, length long, content string, error string")


def _file_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.string(), pa.int64(), pa.binary(), pa.string()]
    columns = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]
    columns[3] = columns[3].cast(pa.string())
    return pa.RecordBatch.from_arrays(columns, names=["course_id", "path", "length", "content", "error"])


def scan_tree(spark: SparkSession, root: str, partition_bytes: int = 64 << 20) -> DataFrame:
    """SRC-1: every file below ``root/<course>/…`` that is not ignored, as ``(course_id, path,
    length, content, error)``: listed first (``list_tree``), then read in runs of equal bytes
    (``read_files``). The first folder below ``root`` is the course id."""
    return read_files(spark, root, list_tree(spark, root), partition_bytes)
