"""Substring dedup: difference-cover anchors.

A window is ``WINDOW`` consecutive words of one text. A word goes if some window over it also starts
in a document with a smaller id; windows are judged on the input texts.

Anchors: word grams are hashed only at positions whose residue modulo a period v lies in a perfect
difference cover of v. For any two positions some shift below v takes both into the cover, so two
equal windows always share an aligned gram of WINDOW - v + 1 words inside them (v = 31: 6 of 31
positions are hashed, grams of 20 words). Anchors found in two different texts are then extended:
every window over them is hashed (128 bits) and compared for the least document id.

At scale: each text is read whole, in Arrow batches. A task combines its anchors (and later its
windows) before the shuffle: what is already known to be shared inside the task is settled there
and only one row per key goes on, so a passage in a third of all documents costs one row a task and
key. After the shuffle sorted runs are streamed; no group is collected. Copies of one text are
resolved first by a narrow aggregation on their digests (all but the least id lose every window),
so only distinct texts with a passage in common have windows hashed. Texts are shuffled once, and
only those with shared anchors are kept for the extension.

Cases: null text → no words; texts shorter than a window keep all their words; a null id keeps all
words and provides no window; rows that repeat an id do not remove each other's words (only a
smaller id counts); empty table → empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import Scratch, WordScanner, covered, mix64, own_name, texts_of

WINDOW = 50
#: Perfect difference covers, by period.
COVERS = {1: (0,), 3: (0, 1), 7: (1, 2, 4), 13: (0, 1, 3, 9), 21: (3, 6, 7, 12, 14), 31: (1, 5, 11, 24, 25, 27)}
#: Rows that a task combines at once.
CHUNK = 1 << 21


def period_for(window: int) -> int:
    """The largest period that leaves grams of a good third of the window."""
    return max(v for v in COVERS if v <= max(1, window * 2 // 3))


def anchors(words: np.ndarray, window: int, scanner: WordScanner) -> tuple[np.ndarray, np.ndarray]:
    """Positions in the cover, and the hash of the gram at each."""
    v = period_for(window)
    grams = scanner.windows(words, window - v + 1)
    at = np.flatnonzero(np.isin(np.arange(len(grams)) % v, COVERS[v]))
    return at, grams[at]


def _private(key: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """A key of its own for each (key, owner): spreads rows that are settled already."""
    return mix64(key ^ (owner * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1)))


def _firsts(*columns: np.ndarray) -> np.ndarray:
    """Mask of the rows that differ from the one before in any column."""
    new = np.ones(len(columns[0]), dtype=bool)
    if len(new):
        new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return new


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, th (XXH64 of the text), md5, n_words and the SHA-256 of all words, of every row."""
    names = ["doc_id", "th", "md5", "n_words", "sha"]

    def run(batches):
        for batch in batches:
            rows = []
            for t in texts_of(batch.column("text")):
                words = (t or b"").split()
                rows.append((xxhash.xxh64_intdigest(t or b"", 42), hashlib.md5(t or b"").hexdigest(), len(words), hashlib.sha256(b" ".join(words)).hexdigest()))
            th = np.array([r[0] for r in rows], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(th), *(pa.array([r[k] for r in rows], kind) for k, kind in ((1, pa.string()), (2, pa.int64()), (3, pa.string())))], names=names)

    return docs.mapInArrow(run, "doc_id long, th long, md5 string, n_words long, sha string")


def _anchor_rows(docs: DataFrame, window: int, chunk: int = CHUNK) -> DataFrame:
    """route, th, settled: each text's anchors, combined within a task. ``route`` is the anchor's
    hash, or a private key where the task itself saw the anchor in two different texts."""
    def combine(keys, owners):
        key, th = np.concatenate(keys), np.concatenate(owners)
        order = np.lexsort((th, key))
        key, th = key[order], th[order]
        once = _firsts(key, th)
        key, th = key[once], th[once]
        first = _firsts(key)
        group = np.cumsum(first) - 1
        shared = np.bincount(group)[group] > 1 if len(key) else np.zeros(0, bool)
        route = np.concatenate([key[first], _private(key[shared], th[shared])])
        return pa.RecordBatch.from_arrays([pa.array(route.view(np.int64)), pa.array(np.concatenate([th[first], th[shared]]).view(np.int64)),
                                           pa.array(np.arange(len(route)) >= first.sum())], names=["route", "th", "settled"])

    def run(batches):
        scanner, keys, owners, held = WordScanner(), [], [], 0
        for batch in batches:
            for t in texts_of(batch.column("text")):
                if t is None:
                    continue
                starts, ends = scanner.spans(t)
                if len(starts) < window:
                    continue
                key = np.unique(anchors(scanner.hashes(t, starts, ends), window, scanner)[1])
                keys.append(key)
                owners.append(np.full(len(key), xxhash.xxh64_intdigest(t, 42), dtype=np.uint64))
                held += len(key)
                if held >= chunk:
                    yield combine(keys, owners)
                    keys, owners, held = [], [], 0
        if held:
            yield combine(keys, owners)

    return docs.where(F.col("doc_id").isNotNull()).select("text").mapInArrow(run, "route long, th long, settled boolean")


def _streamed(rows: DataFrame, by: list[str], order: list[str], decide, schema: str) -> DataFrame:
    """Runs of rows equal in ``by``, sorted by ``order``: ``decide`` gets whole runs of a sorted
    batch (the last run is carried into the next batch) and gives a mask of the rows to keep."""
    names = rows.columns

    def run(batches):
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in names}
            if held is not None:
                cols = {c: np.concatenate([held[c], cols[c]]) for c in names}
            start = int(np.flatnonzero(_firsts(*(cols[c] for c in by)))[-1])
            held = {c: v[start:] for c, v in cols.items()}
            if start:
                yield emit({c: v[:start] for c, v in cols.items()})
        if held is not None:
            yield emit(held)

    def emit(cols):
        keep = decide(cols)
        return pa.RecordBatch.from_arrays([pa.array(cols[c][keep]) for c in out], names=out)

    out = [x.split()[0] for x in schema.split(", ")]
    return rows.repartition(*by).sortWithinPartitions(*order).mapInArrow(run, schema)


def _shared_anchor(cols):
    """Settled rows, and runs with two different texts."""
    first = _firsts(cols["route"])
    group = np.cumsum(first) - 1
    texts = np.bincount(group, weights=_firsts(cols["route"], cols["th"]))
    return cols["settled"].astype(bool) | (texts[group] > 1)


def _later_window(cols):
    """Settled rows, and those whose run has a smaller id."""
    first = _firsts(cols["route"], cols["w2"])
    group = np.cumsum(first) - 1
    return cols["settled"].astype(bool) | (cols["doc_id"] > cols["doc_id"][first][group])


def _window_rows(found: DataFrame, window: int, chunk: int = CHUNK) -> DataFrame:
    """route, w2, doc_id, settled: each window over a shared anchor, combined within a task."""
    def combine(parts):
        w1, w2, doc = (np.concatenate([p[k] for p in parts]) for k in range(3))
        order = np.lexsort((doc, w2, w1))
        w1, w2, doc = w1[order], w2[order], doc[order]
        once = _firsts(w1, w2, doc)
        w1, w2, doc = w1[once], w2[once], doc[once]
        first = _firsts(w1, w2)
        route = np.where(first, w1, _private(w1, doc.view(np.uint64)))
        return pa.RecordBatch.from_arrays([pa.array(route.view(np.int64)), pa.array(w2.view(np.int64)), pa.array(doc), pa.array(~first)], names=["route", "w2", "doc_id", "settled"])

    def run(batches):
        scanner, parts, held = WordScanner(), [], 0
        reach = period_for(window)
        for batch in batches:
            for t, doc, th, routes in zip(texts_of(batch.column("text")), batch.column("doc_id").to_pylist(), batch.column("th").to_pylist(), batch.column("routes")):
                starts, ends = scanner.spans(t)
                words = scanner.hashes(t, starts, ends)
                at, key = anchors(words, window, scanner)
                known = routes.values.to_numpy().view(np.uint64)
                owner = np.full(len(key), th, dtype=np.int64).view(np.uint64)
                at = at[np.isin(key, known) | np.isin(_private(key, owner), known)]
                n = len(words) - window + 1
                over = np.zeros(n + 1, dtype=np.int64)  # windows that hold an anchor start up to v - 1 words before it
                np.add.at(over, np.minimum(n, np.maximum(0, at - reach + 1)), 1)
                np.add.at(over, np.minimum(n, at + 1), -1)
                at = np.flatnonzero(np.cumsum(over[:-1]) > 0)
                w1 = scanner.windows(words, window)[at]
                w2 = scanner.windows(scanner.hashes(t, starts, ends, 1), window, 1)[at]
                parts.append((w1, w2, np.full(len(at), doc, dtype=np.int64)))
                held += len(at)
                if held >= chunk:
                    yield combine(parts)
                    parts, held = [], 0
        if parts:
            yield combine(parts)

    return found.mapInArrow(run, "route long, w2 long, doc_id long, settled boolean")


def _cut(found: DataFrame, window: int) -> DataFrame:
    """doc_id, th, n_removed and the kept words of each text with windows to remove."""
    def run(batches):
        scanner = WordScanner()
        for batch in batches:
            removed, kept = [], []
            for t, doc, routes in zip(texts_of(batch.column("text")), batch.column("doc_id").to_pylist(), batch.column("gone")):
                starts, ends = scanner.spans(t)
                w1 = scanner.windows(scanner.hashes(t, starts, ends), window)
                known = routes.values.to_numpy().view(np.uint64)
                owner = np.full(len(w1), doc, dtype=np.int64).view(np.uint64)
                gone = covered(np.flatnonzero(np.isin(w1, known) | np.isin(_private(w1, owner), known)), window, len(starts))
                words = t.split()
                removed.append(int(gone.sum()))
                kept.append(b" ".join(words[i] for i in np.flatnonzero(~gone).tolist()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("th"), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())],
                                             names=["doc_id", "th", "n_removed", "kept"])

    return found.mapInArrow(run, "doc_id long, th long, n_removed long, kept string")


def removals(docs: DataFrame, *, window: int = WINDOW, scratch: Scratch | None = None) -> tuple[DataFrame, DataFrame]:
    """Two tables: ``base`` (doc_id, th, n_words, sha, copy: whether a smaller id has the same
    text) of every row, and ``cut`` (doc_id, th, n_removed, kept) of the distinct texts that lose
    words. A copy loses all its words if it is as long as a window."""
    scratch = scratch or Scratch(docs.sparkSession, "substring")
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    base = scratch("digests", digests(docs))
    firsts = scratch("firsts", base.where(F.col("doc_id").isNotNull()).groupBy("th", "md5").agg(F.min("doc_id").alias("first"), F.max("n_words").alias("n")))
    shared = _streamed(_anchor_rows(docs, window), ["route"], ["route", "th"], _shared_anchor, "th long, route long")
    routes = scratch("anchors", shared.groupBy("th").agg(F.collect_list("route").alias("routes")))
    wanted = scratch("wanted", routes.join(firsts.where(F.col("n") >= window), "th").select(F.col("first").alias("doc_id"), "th", "routes"))
    texts = docs.withColumn("th", F.xxhash64("text"))
    found = scratch("found", texts.join(wanted, ["doc_id", "th"]))
    later = _streamed(_window_rows(found, window), ["route", "w2"], ["route", "w2", "doc_id"], _later_window, "doc_id long, route long")
    gone = later.groupBy("doc_id").agg(F.collect_list("route").alias("gone"))
    cut = scratch("cut", _cut(found.drop("routes").join(gone, "doc_id"), window).dropDuplicates(["doc_id", "th"]))
    base = base.join(firsts.select("th", "md5", "first"), ["th", "md5"], "left")
    return base.select("doc_id", "th", "n_words", "sha", F.coalesce(F.col("first") < F.col("doc_id"), F.lit(False)).alias("copy")), cut


def digest_report(docs: DataFrame, *, window: int = WINDOW, scratch: Scratch | None = None) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every row."""
    base, cut = removals(docs, window=window, scratch=scratch)
    cut = cut.select("doc_id", "th", F.col("n_removed").alias("r"), F.sha2("kept", 256).alias("k"))
    all_gone = F.col("copy") & (F.col("n_words") >= window)
    return base.join(cut, ["doc_id", "th"], "left").select(
        "doc_id", "n_words", F.when(all_gone, F.col("n_words")).otherwise(F.coalesce("r", F.lit(0))).cast("long").alias("n_removed"),
        F.when(all_gone, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("k", "sha")).alias("kept_sha256"))


def remove_repeats(docs: DataFrame, *, window: int = WINDOW, scratch: Scratch | None = None) -> DataFrame:
    """``docs``, columns unchanged: the text of a document that loses words is its kept words joined
    by one space (``n_chars``, if there, follows); other rows stay as they are."""
    base, cut = removals(docs, window=window, scratch=scratch)
    copies = base.where(F.col("copy") & (F.col("n_words") >= window)).select("doc_id", "th", F.lit("").alias("kept"))
    # columns of their own beside whatever the documents have
    id_, hash_, kept = (own_name(docs, name) for name in ("_id", "_th", "_kept"))
    changed = cut.select("doc_id", "th", "kept").union(copies.distinct()).toDF(id_, hash_, kept)
    out = docs.join(changed, (docs["doc_id"].cast("long") == changed[id_]) & (F.xxhash64(docs["text"].cast("string")) == changed[hash_]), "left")
    columns = []
    for c in docs.columns:
        if c == "text":
            columns.append(F.coalesce(changed[kept], docs[c]).alias(c))
        elif c == "n_chars":
            columns.append(F.when(changed[kept].isNotNull(), F.length(changed[kept]).cast(docs.schema[c].dataType)).otherwise(docs[c]).alias(c))
        else:
            columns.append(docs[c])
    return out.select(*columns)
