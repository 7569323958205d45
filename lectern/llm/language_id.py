"""Language identification: family first, then one-versus-one linear SVMs inside the family.

Features are hashed character n-grams (bytes, 1 to 4) of the lower-cased letters, so that a whole
text is scored by a few vectorised passes. Families are learned: languages whose mean profiles
lie closest are merged (average linkage) until about the square root of their number is left.
A one-versus-rest linear SVM picks the family, linear SVMs on each pair of its languages vote.

Training takes a bounded sample (``SAMPLE`` documents in expectation, split evenly over the
languages, picked by a hash of the id); counts of languages cover all rows. Scoring covers every
row and every byte of its text.

Cases: null text, or one without a letter → ``und`` with score 0; null or repeated ids are
scored like any other row; no labelled row at all → every text is ``und``; one single language →
that language with score 1. Extra columns are ignored. Nulls in ``lang`` are never learned from.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bound of the training sample, in documents (expected size).
SAMPLE = 3000
BUCKETS = 1 << 13
NGRAMS = (1, 2, 3, 4)
UNDETERMINED = "und"

_LETTER = re.compile(r"[^\W\d_]")
#: ASCII bytes that are not letters become spaces; other bytes stay.
_FOLD = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))


def has_letter(text: str | None) -> bool:
    return text is not None and _LETTER.search(text) is not None


def ngram_buckets(text: str) -> np.ndarray:
    """Bucket of every n-gram of the folded text."""
    folded = b" " + b" ".join(text.lower().encode("utf-8", "surrogatepass").translate(_FOLD).split()) + b" "
    codes = np.frombuffer(folded, dtype=np.uint8).astype(np.uint32)
    gram, out = np.zeros(len(codes), dtype=np.uint32), []
    for n in NGRAMS:
        if n > len(codes):
            break
        gram = gram[: len(codes) - n + 1] * np.uint32(257) + codes[n - 1:]
        h = (gram + np.uint32(n)) * np.uint32(0x9E3779B1)
        h ^= h >> np.uint32(15)
        out.append((h * np.uint32(0x85EBCA77)) >> np.uint32(32 - 13))
    return np.concatenate(out).astype(np.int64)


def profile(text: str) -> np.ndarray:
    """Square roots of the n-gram shares: unit length, so long and short texts compare."""
    counts = np.bincount(ngram_buckets(text), minlength=BUCKETS).astype(np.float32)
    return np.sqrt(counts / max(1.0, counts.sum()))


def fit_svm(x: np.ndarray, y: np.ndarray, rounds: int = 120, ridge: float = 1e-4) -> tuple[np.ndarray, float]:
    """Linear SVM with squared hinge loss and balanced classes, by accelerated gradient steps."""
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(np.float32)
    w = np.zeros(x.shape[1], dtype=np.float32)
    b = 0.0
    v, c, t = w.copy(), b, 1.0
    step = 1.0 / (2 * 2.0 + ridge)  # rows have unit length, the bias adds one; weights sum to one
    for _ in range(rounds):
        slack = np.maximum(0.0, 1 - y * (x @ v + c)) * weight * y
        w2, b2 = v + step * (2 * (x.T @ slack) - ridge * v), c + step * 2 * float(slack.sum())
        t2 = (1 + math.sqrt(1 + 4 * t * t)) / 2
        v, c = w2 + (t - 1) / t2 * (w2 - w), b2 + (t - 1) / t2 * (b2 - b)
        w, b, t = w2.astype(np.float32), b2, t2
    return w, b


def merge_families(profiles: np.ndarray, names: list[str]) -> list[list[int]]:
    """Average linkage over the cosine of mean profiles, down to about sqrt(n) families."""
    unit = profiles / np.maximum(1e-9, np.linalg.norm(profiles, axis=1, keepdims=True))
    near = unit @ unit.T
    groups = [[i] for i in range(len(names))]
    while len(groups) > max(1, round(math.sqrt(len(names)))):
        i, j = max(((i, j) for i in range(len(groups)) for j in range(i + 1, len(groups))),
                   key=lambda p: (float(near[np.ix_(groups[p[0]], groups[p[1]])].mean()), -p[0], -p[1]))
        groups[i] += groups.pop(j)
    return groups


@dataclass
class LanguageModel:
    """Weights of every linear function as columns: families first, then pairs of languages."""

    languages: list[str]
    families: list[list[int]]
    pairs: list[tuple[int, int]]
    weights: np.ndarray
    bias: np.ndarray

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.languages or not has_letter(text):
            return UNDETERMINED, 0.0
        return self.decide(profile(text) @ self.weights + self.bias)

    def decide(self, z: np.ndarray) -> tuple[str, float]:
        nf = len(self.families)
        order = np.argsort(-z[:nf], kind="stable")
        family = self.families[order[0]]
        p = 1.0 if nf == 1 else 1 / (1 + math.exp(-2 * min(30.0, float(z[order[0]] - z[order[1]]))))
        votes = {i: [0, 0.0] for i in family}
        for k, (i, j) in enumerate(self.pairs):
            if i in votes and j in votes:
                m = float(z[nf + k])
                votes[i if m >= 0 else j][0] += 1
                votes[i][1] += m
                votes[j][1] -= m
        best = max(family, key=lambda i: (votes[i][0], votes[i][1], -i))
        own = [float(z[nf + k]) * (1 if i == best else -1) for k, (i, j) in enumerate(self.pairs)
               if best in (i, j) and i in votes and j in votes]
        return self.languages[best], p / (1 + math.exp(-3 * max(-30.0, min(30.0, min(own))))) if own else p


def fit(x: np.ndarray, labels: list[str]) -> LanguageModel:
    languages = sorted(set(labels))
    y = np.array([languages.index(v) for v in labels], dtype=np.int64)
    if not languages:
        return LanguageModel([], [], [], np.zeros((BUCKETS, 0), np.float32), np.zeros(0))
    families = merge_families(np.stack([x[y == i].mean(axis=0) for i in range(len(languages))]), languages)
    columns, bias, pairs = [], [], []
    for f in families:
        w, b = fit_svm(x, np.where(np.isin(y, f), 1.0, -1.0).astype(np.float32)) if len(families) > 1 else (np.zeros(x.shape[1], np.float32), 0.0)
        columns.append(w)
        bias.append(b)
    for f in families:
        for a in range(len(f)):
            for c in range(a + 1, len(f)):
                rows = np.flatnonzero((y == f[a]) | (y == f[c]))
                w, b = fit_svm(x[rows], np.where(y[rows] == f[a], 1.0, -1.0).astype(np.float32))
                pairs.append((f[a], f[c]))
                columns.append(w)
                bias.append(b)
    return LanguageModel(languages, families, pairs, np.stack(columns, axis=1).astype(np.float32), np.array(bias))


def bucket_of(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus`` (null for a null id)."""
    return F.crc32(doc_id.cast("string")) % modulus


def train(docs: DataFrame, learn_from: Column, sample: int = SAMPLE) -> LanguageModel:
    """Fit on a bounded sample of the rows where ``learn_from`` holds and ``lang`` is not null."""
    rows = docs.where(learn_from & F.col("lang").isNotNull()).select("doc_id", "text", "lang")
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return fit(np.zeros((0, BUCKETS), np.float32), [])
    each = max(1, sample // len(counts))
    share = F.create_map(*[F.lit(v) for lang, n in sorted(counts.items()) for v in (lang, min(1.0, each / n))])
    spread = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("language")), F.lit(1_000_003)) / 1_000_003
    picked = rows.where(spread < F.element_at(share, F.col("lang")))

    def profiles(batches):
        for batch in batches:
            texts, langs = batch.column("text").to_pylist(), batch.column("lang").to_pylist()
            kept = [(profile(t).astype(np.float16).tobytes(), lang) for t, lang in zip(texts, langs) if has_letter(t)]
            yield pa.RecordBatch.from_pydict({"p": pa.array([k[0] for k in kept], pa.binary()),
                                              "lang": pa.array([k[1] for k in kept], pa.string())})

    got = sorted((r["lang"], bytes(r["p"])) for r in picked.mapInArrow(profiles, "p binary, lang string").toLocalIterator())
    x = np.empty((len(got), BUCKETS), dtype=np.float32)
    for i, (_, p) in enumerate(got):
        x[i] = np.frombuffer(p, dtype=np.float16)
    labels = [lang for lang, _ in got]
    del got
    return fit(x, labels)


def predict(docs: DataFrame, model: LanguageModel, *, lang_col: str = "lang_pred", score_col: str = "score") -> DataFrame:
    """``docs`` with the predicted language and its score (0 to 1) as two more columns, in one pass
    over the scan and without a shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(vars(model))  # BUCKETS x functions floats

    def score(batches):
        m = LanguageModel(**shared.value)
        for batch in batches:
            got = [m.predict(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())],
                names=[*batch.schema.names, lang_col, score_col])

    schema = T.StructType([*docs.schema.fields, T.StructField(lang_col, T.StringType()), T.StructField(score_col, T.DoubleType())])
    return docs.mapInArrow(score, schema)


def keep_known(docs: DataFrame, model: LanguageModel, min_score: float = 0.0) -> DataFrame:
    """The rows of ``docs``, columns unchanged, whose language is determined with at least
    ``min_score``; texts without a letter go."""
    shared = docs.sparkSession.sparkContext.broadcast(vars(model))

    def keep(batches):
        m = LanguageModel(**shared.value)
        for batch in batches:
            got = [m.predict(t) for t in batch.column("text").to_pylist()]
            yield batch.filter(pa.array([g[0] != UNDETERMINED and g[1] >= min_score for g in got], pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)
