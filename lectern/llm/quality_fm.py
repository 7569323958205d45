"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

    y(x) = w0 + sum_i w_i x_i + 1/2 sum_f [ (sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2 ]

The pairwise part uses the sum-of-squares identity, so a text costs time linear in its words.
Features: every word of the whole text, hashed (share of the words, unit length), binned
structure statistics (word count, word length, symbols, capitals, repeated words and lines,
separators, digits), and the metadata column ``n_chars`` (its bin). Labels, language, source and
id are never features.

Training takes at most about ``SAMPLE`` labelled rows (expected size, picked by a hash of the id),
with Adam on the log loss; scoring covers every row.

Cases: null or empty text → scored from its (empty) structure bins; null ids are scored and never
learned from; labels that are null or for unknown ids are ignored, repeated labels count once each;
no labels at all → score 0.5 everywhere. Extra columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.llm.common import WordScanner, texts_of

SAMPLE = 8000
#: Features: hashed words first, then bins of structure statistics and metadata.
WORD_BITS = 14
BINS = 16
FACTORS = 8
THRESHOLD = 0.3

_STATS = ("n_words", "word_length", "symbols", "capitals", "repeats", "duplicate_lines", "separators",
          "digits", "punctuated_words", "line_length", "adjacent_repeats", "n_chars")
N_FEATURES = (1 << WORD_BITS) + BINS * len(_STATS)

_KIND = np.zeros(256, dtype=np.uint8)  # 1 symbol, 2 capital, 3 digit
_KIND[list(b"#*$%&|<>@^~_=+{}[]\\!")] = 1
_KIND[list(range(65, 91))] = 2
_KIND[list(range(48, 58))] = 3


def _log_bin(value: float, scale: float) -> int:
    return min(BINS - 1, int(math.log2(1 + max(0.0, value)) * scale))


def _share_bin(share: float) -> int:
    """Bins that are finer near zero."""
    return min(BINS - 1, int(math.sqrt(max(0.0, share)) * BINS))


def structure_bins(text: bytes, starts: np.ndarray, ends: np.ndarray, words: np.ndarray, n_chars: int | None) -> np.ndarray:
    n, size = len(starts), max(1, len(text))
    kinds = np.bincount(_KIND[np.frombuffer(text, dtype=np.uint8)], minlength=4)
    lines = [x for x in text.split(b"\n") if x.strip()]
    last = np.frombuffer(text, dtype=np.uint8)[ends - 1] if n else np.zeros(0, np.uint8)
    alone = int(np.count_nonzero((ends - starts == 1) & (_KIND[last] == 1))) if n else 0
    bins = (
        _log_bin(n, 1.0),
        _log_bin(float((ends - starts).mean()) if n else 0.0, 3.0),
        _share_bin(kinds[1] / size),
        _share_bin(kinds[2] / size),
        _share_bin(1 - len(np.unique(words)) / n if n else 0.0),
        _share_bin(1 - len(set(lines)) / len(lines) if lines else 0.0),
        _share_bin(alone / n if n else 0.0),
        _share_bin(kinds[3] / size),
        _share_bin(float(np.count_nonzero(_KIND[last] == 1)) / n if n else 0.0),
        _log_bin(n / max(1, len(lines)), 1.5),
        _share_bin(float(np.count_nonzero(words[1:] == words[:-1])) / n if n else 0.0),
        0 if n_chars is None else 1 + min(BINS - 2, int(math.log2(1 + max(0, n_chars)) * 0.8)),
    )
    return (1 << WORD_BITS) + BINS * np.arange(len(bins)) + np.array(bins)


def features(text: bytes | None, n_chars: int | None, scanner: WordScanner) -> tuple[np.ndarray, np.ndarray]:
    """Sparse features of one text: indices (each once) and values."""
    text = text or b""
    starts, ends = scanner.spans(text)
    words = scanner.hashes(text, starts, ends)
    idx, count = np.unique((words >> np.uint64(64 - WORD_BITS)).astype(np.int64), return_counts=True)
    x = np.sqrt(count / max(1, len(words)))
    fixed = structure_bins(text, starts, ends, words, n_chars)
    return np.concatenate([idx, fixed]), np.concatenate([x, np.full(len(fixed), 0.5)])


@dataclass
class FactorisationMachine:
    bias: float
    linear: np.ndarray
    factors: np.ndarray

    def margin(self, idx: np.ndarray, x: np.ndarray) -> float:
        vx = self.factors[idx] * x[:, None]
        return float(self.bias + self.linear[idx] @ x + 0.5 * ((vx.sum(axis=0) ** 2).sum() - (vx * vx).sum()))

    def score(self, idx: np.ndarray, x: np.ndarray) -> float:
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, self.margin(idx, x)))))


def fit(rows: list[tuple[np.ndarray, np.ndarray, int]], *, epochs: int = 12, batch: int = 64, rate: float = 0.02,
        ridge: float = 1e-5, seed: int = 7) -> FactorisationMachine:
    """Adam on the log loss; rows come in a fixed order and are shuffled by ``seed``."""
    rng = np.random.default_rng(seed)
    bias, w = 0.0, np.zeros(N_FEATURES)
    v = rng.normal(0, 0.05, (N_FEATURES, FACTORS))
    if not rows:
        return FactorisationMachine(0.0, w, np.zeros_like(v))
    bias = math.log((1 + sum(y for *_, y in rows)) / (1 + sum(1 - y for *_, y in rows)))
    mw, sw, mv, sv, mb, sb, t = np.zeros_like(w), np.zeros_like(w), np.zeros_like(v), np.zeros_like(v), 0.0, 0.0, 0
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), batch):
            part = [rows[i] for i in order[at:at + batch]]
            idx = np.concatenate([r[0] for r in part])
            x = np.concatenate([r[1] for r in part])
            y = np.array([r[2] for r in part], dtype=float)
            first = np.cumsum([0] + [len(r[0]) for r in part[:-1]])
            lens = np.array([len(r[0]) for r in part])
            vx = v[idx] * x[:, None]
            total = np.add.reduceat(vx, first, axis=0)
            z = bias + np.add.reduceat(w[idx] * x, first) + 0.5 * ((total ** 2).sum(axis=1) - np.add.reduceat((vx * vx).sum(axis=1), first))
            g = np.repeat((1 / (1 + np.exp(-np.clip(z, -40, 40))) - y) / len(part), lens)
            gv = g[:, None] * x[:, None] * (np.repeat(total, lens, axis=0) - vx)
            u, inv = np.unique(idx, return_inverse=True)
            gw = np.bincount(inv, weights=g * x) + ridge * w[u]
            gf = np.stack([np.bincount(inv, weights=gv[:, k]) for k in range(FACTORS)], axis=1) + ridge * v[u]
            gb = float((g / lens.repeat(lens)).sum())
            t += 1
            c1, c2 = 1 - 0.9 ** t, 1 - 0.999 ** t
            mb, sb = 0.9 * mb + 0.1 * gb, 0.999 * sb + 0.001 * gb * gb
            bias -= rate * (mb / c1) / (math.sqrt(sb / c2) + 1e-8)
            mw[u], sw[u] = 0.9 * mw[u] + 0.1 * gw, 0.999 * sw[u] + 0.001 * gw * gw
            mv[u], sv[u] = 0.9 * mv[u] + 0.1 * gf, 0.999 * sv[u] + 0.001 * gf * gf
            w[u] -= rate * (mw[u] / c1) / (np.sqrt(sw[u] / c2) + 1e-8)
            v[u] -= rate * (mv[u] / c1) / (np.sqrt(sv[u] / c2) + 1e-8)
    return FactorisationMachine(bias, w, v)


def train(docs: DataFrame, labels: DataFrame, learn_from: Column, sample: int = SAMPLE) -> FactorisationMachine:
    """Fit on a bounded sample of the labelled rows where ``learn_from`` (on ``doc_id``) holds.

    The labels are narrow (id, 0 or 1) and are thinned to the sample before they meet the texts;
    texts that carry no sampled label leave the scan only if their id passes the same hash."""
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).where(learn_from).select("doc_id", F.col("quality").alias("y"))
    n = known.count()
    if n == 0:
        return fit([])
    spread = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("quality")), F.lit(1_000_003)) / 1_000_003
    part = spread < min(1.0, sample / n)
    docs = docs.where(part).select("doc_id", "text", "n_chars" if "n_chars" in docs.columns else F.lit(None).cast("long").alias("n_chars"))
    rows = docs.join(known.where(part), "doc_id")

    def encode(batches):
        scanner = WordScanner()
        for batch in batches:
            got = [features(t, c, scanner) for t, c in zip(texts_of(batch.column("text")), batch.column("n_chars").to_pylist())]
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column("doc_id"), "y": batch.column("y").cast(pa.int32()),
                "i": pa.array([g[0].astype(np.int32).tobytes() for g in got], pa.binary()),
                "x": pa.array([g[1].astype(np.float32).tobytes() for g in got], pa.binary())})

    got = rows.select("doc_id", "text", "n_chars", "y").mapInArrow(encode, "doc_id long, y int, i binary, x binary").toLocalIterator()
    data = sorted((r["doc_id"], r["y"], bytes(r["i"]), bytes(r["x"])) for r in got)
    return fit([(np.frombuffer(i, np.int32).astype(np.int64), np.frombuffer(x, np.float32).astype(float), y) for _, y, i, x in data])


def _scores(batch: pa.RecordBatch, model: FactorisationMachine, scanner: WordScanner) -> list[float]:
    chars = batch.column("n_chars").to_pylist() if "n_chars" in batch.schema.names else [None] * batch.num_rows
    return [model.score(*features(t, c, scanner)) for t, c in zip(texts_of(batch.column("text")), chars)]


def score(docs: DataFrame, model: FactorisationMachine, *, score_col: str = "score") -> DataFrame:
    """``docs`` with ``score`` (0 to 1, higher: quality 1 likelier) added, in one pass over the scan."""
    shared = docs.sparkSession.sparkContext.broadcast(vars(model))  # N_FEATURES x (FACTORS + 1) floats

    def run(batches):
        m, scanner = FactorisationMachine(**shared.value), WordScanner()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(_scores(batch, m, scanner), pa.float64())],
                                             names=[*batch.schema.names, score_col])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(score_col, T.DoubleType())]))


def keep_good(docs: DataFrame, model: FactorisationMachine, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, columns unchanged, that score at least ``threshold``."""
    shared = docs.sparkSession.sparkContext.broadcast(vars(model))

    def run(batches):
        m, scanner = FactorisationMachine(**shared.value), WordScanner()
        for batch in batches:
            yield batch.filter(pa.array([s >= threshold for s in _scores(batch, m, scanner)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
