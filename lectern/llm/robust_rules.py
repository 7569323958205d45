"""Quality rules: robust multivariate outliers by minimum covariance determinant (MCD).

Per text, base statistics give a transformed vector (log word count, word length, and square
roots of the symbol, repeated-line and repeated-word shares). Per (language, source) the MCD
estimate of centre and scatter is found by concentration steps over ALL rows of the group: each
step keeps the share ``SUPPORT`` of rows with the smallest Mahalanobis distances and re-estimates.
Steps start from medians and MADs, from the mean and covariance of all rows and from those of
``HALVES`` halves dealt by a hash of the vector (copies fall in one half); each start runs until it
settles, and the estimate of least determinant stands. A row is rejected if its squared distance to
its group's estimate passes ``CUTOFF``.

At scale: statistics are computed once in a pass over the texts and staged (narrow rows). Every
concentration step is two map-side combined aggregations on these rows: counts over fixed
logarithmic distance bins give the support's threshold, exact integer sums (fixed-point vectors,
decimals) give mean and covariance (the bin at the threshold counts by the share that is needed of
it), so results do not depend on the order of rows or tasks. Medians and MADs come from counts over
logarithmic bins of about one per cent. The 5 x 5 algebra runs per group in Arrow batches; rows meet
their group's estimates by (group, salt), so no group meets in one task. Rows of groups that have
settled take no part in further steps.

Groups with fewer than ``MIN_GROUP`` usable rows use their language's estimate, or the one over
all rows. Null languages and sources form groups of their own. In units of ``FLOOR`` no direction of
a scatter counts as narrower than one, so groups whose statistics are constant still have a distance
and a few copies cannot make a determinant small.

Cases: null or empty text → zero statistics, ``base_failed`` (fewer than 50 words), not kept.
Repeated rows are judged alike. Empty table → empty result. Extra columns are ignored. Rows that
fail the base rules take no part in the estimates.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import Scratch, WordScanner, covered, texts_of

#: Junk may hold up to half of a group.
SUPPORT = 0.5
HALVES = 2
#: A start has settled when a step lowers its objective (log determinant plus mean distance) by less.
SETTLED = 1e-3
MIN_GROUP = 200
#: Squared distance beyond which a row goes. For five independent normal dimensions only about
#: one row in a billion lies beyond 50; heavier tails of clean texts stay well inside.
CUTOFF = 60.0
#: Fixed-point scale of the vectors.
SCALE = 4096
#: Least standard deviation of each dimension (log words, word length, three share roots).
FLOOR = (0.25, 0.5, 0.05, 0.12, 0.15)
DIMS = len(FLOOR)
#: A group's rows meet its estimate in so many parts, so that a hot group is not one task's.
SALTS = 64
#: Resolution of the distance bins: so many per doubling.
BINS_PER_OCTAVE = 64

_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(b"#*$%&|<>")] = True


def base_statistics(text: bytes | None, scanner: WordScanner) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of one whole text."""
    if not text:
        return 0, 0, 0, 0, 0
    codes = np.frombuffer(text, dtype=np.uint8)
    starts, ends = scanner.spans(text)
    n = len(starts)
    leads = np.concatenate([[0], np.cumsum((codes & 0xC0) != 0x80)])
    chars = int((leads[ends] - leads[starts]).sum()) if n else 0
    lines = [x for x in text.split(b"\n") if x.strip(b" \t\n\x0b\x0c\r")]
    repeat = 0
    if n >= 3:
        words = scanner.hashes(text, starts, ends)
        _, inverse, count = np.unique(scanner.windows(words, 3), return_inverse=True, return_counts=True)
        repeat = int(covered(np.flatnonzero(count[inverse] > 1), 3, n).sum())
    return n, chars, int(_SYMBOL[codes].sum()), len(lines) - len(set(lines)), repeat


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and the base statistics of every row, in one pass over the scan."""
    def run(batches):
        scanner = WordScanner()
        for batch in batches:
            got = np.array([base_statistics(t, scanner) for t in texts_of(batch.column("text"))], dtype=np.int64).reshape(-1, 5)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("lang"), batch.column("source"), *(pa.array(got[:, k]) for k in range(5))], names=names)

    names = ["doc_id", "lang", "source", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("lang").cast("string"), F.col("source").cast("string")).mapInArrow(
        run, "doc_id long, lang string, source string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long")


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def vector() -> list[Column]:
    """The transformed statistics in fixed point."""
    n = F.greatest(F.col("n_words"), F.lit(1))
    parts = (F.log(F.lit(1.0) + F.col("n_words")), F.col("word_chars") / n, F.sqrt(F.col("n_symbols") / n),
             F.sqrt(F.col("n_dup_lines") / n), F.sqrt(F.col("n_repeat_words") / n))
    return [F.round(p * SCALE).cast("long").alias(f"z{i}") for i, p in enumerate(parts)]


def _moments(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Exact count, sums and sums of products per group."""
    wide = [F.col(f"z{i}").cast("decimal(18,0)") for i in range(DIMS)]
    sums = [F.sum(F.col(f"z{i}").cast("decimal(28,0)")).alias(f"s{i}") for i in range(DIMS)]
    products = [F.sum((wide[i] * wide[j]).cast("decimal(38,0)")).alias(f"p{i}{j}") for i in range(DIMS) for j in range(i, DIMS)]
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), *sums, *products)


_SUMS = [f"s{i}" for i in range(DIMS)] + [f"p{i}{j}" for i in range(DIMS) for j in range(i, DIMS)]
_ESTIMATE = "centre array<double>, inverse array<double>, log_det double, objective double"


def _kinds(df: DataFrame, keys: list[str]) -> str:
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.select(*keys).schema)


def _estimate(mean: np.ndarray, cov: np.ndarray) -> tuple[list, list, float, float]:
    """Centre, inverse scatter, log determinant and objective, with floors on the scatter: a
    direction narrower than one in units of the floors counts as that wide."""
    unit = np.array(FLOOR)
    width, turn = np.linalg.eigh(cov / np.outer(unit, unit))
    wide = np.maximum(width, 1.0)
    inverse = (turn / wide) @ turn.T / np.outer(unit, unit)
    log_det = float(np.log(wide).sum())
    return mean.tolist(), inverse.ravel().tolist(), log_det, log_det + float((width / wide).sum())


def _estimates(moments: DataFrame, keys: list[str], factor: float) -> DataFrame:
    """Per group: the centre and the inverse of the (scaled, floored) scatter, by 5 x 5 algebra."""
    def run(batches):
        for batch in batches:
            n = np.array(batch.column("n").to_pylist(), dtype=float)
            v = {c: np.array([float(x) for x in batch.column(c).to_pylist()]) for c in _SUMS}
            got = []
            for r in range(batch.num_rows):
                mean = np.array([v[f"s{i}"][r] for i in range(DIMS)]) / n[r]
                cov = np.zeros((DIMS, DIMS))
                for i in range(DIMS):
                    for j in range(i, DIMS):
                        cov[i, j] = cov[j, i] = v[f"p{i}{j}"][r] / n[r] - mean[i] * mean[j]
                got.append(_estimate(mean / SCALE, factor * cov / SCALE ** 2))
            yield _estimate_batch(batch, keys, got)

    return moments.mapInArrow(run, f"{_kinds(moments, keys)}, {_ESTIMATE}")


def _estimate_batch(batch: pa.RecordBatch, keys: list[str], got: list[tuple]) -> pa.RecordBatch:
    lists, number = pa.list_(pa.float64()), pa.float64()
    return pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), *(pa.array([g[k] for g in got], kind) for k, kind in enumerate((lists, lists, number, number)))],
                                      names=[*keys, "centre", "inverse", "log_det", "objective"])


def _medians(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Per group: medians as centre and squared MADs (for a normal cloud) as scatter, from counts
    over logarithmic bins; some thousands of bins a group at most."""
    cells = F.explode(F.array(*[F.struct(F.lit(i).alias("dim"), (F.signum(z) * F.floor(F.log2(1 + F.abs(z)) * BINS_PER_OCTAVE)).cast("int").alias("bin"))
                                for i, z in enumerate(F.col(f"z{i}") for i in range(DIMS))]))
    counts = rows.select(*keys, cells.alias("c")).groupBy(*keys, "c.dim", "c.bin").agg(F.count("*").alias("n"))
    packed = counts.groupBy(*keys).agg(F.collect_list(F.struct("dim", "bin", "n")).alias("cells"))

    def middle(x, n):
        order = np.argsort(x, kind="stable")
        run = np.cumsum(n[order])
        return float(x[order][np.searchsorted(run, run[-1] / 2)])

    def run(batches):
        for batch in batches:
            got = []
            for cells in batch.column("cells").to_pylist():
                dim, bin_, n = (np.array([c[k] for c in cells]) for k in ("dim", "bin", "n"))
                value = np.sign(bin_) * (np.exp2((np.abs(bin_) + 0.5 * (bin_ != 0)) / BINS_PER_OCTAVE) - 1) / SCALE
                centre = np.array([middle(value[dim == i], n[dim == i]) for i in range(DIMS)])
                mads = np.array([middle(np.abs(value[dim == i] - centre[i]), n[dim == i]) for i in range(DIMS)])
                got.append(_estimate(centre, np.diag(np.square(1.4826 * mads))))
            yield _estimate_batch(batch, keys, got)

    return packed.mapInArrow(run, f"{_kinds(packed, keys)}, {_ESTIMATE}")


def _distance() -> Column:
    """Squared Mahalanobis distance of a row's vector to the estimate joined to it."""
    d = [F.col(f"z{i}") / F.lit(float(SCALE)) - F.col("centre")[i] for i in range(DIMS)]
    total = F.lit(0.0)
    for i in range(DIMS):
        total = total + d[i] * d[i] * F.col("inverse")[i * DIMS + i]
        for j in range(i + 1, DIMS):
            total = total + 2.0 * d[i] * d[j] * F.col("inverse")[i * DIMS + j]
    return F.greatest(total, F.lit(0.0))


def _salt(*columns: str) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(SALTS)).cast("int").alias("salt")


def _for_each_salt(estimates: DataFrame) -> DataFrame:
    """A few numbers a group, once for every salt."""
    return estimates.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


def minimum_covariance(rows: DataFrame, keys: list[str], scratch: Scratch, name: str, large: Column,
                       support: float = SUPPORT) -> DataFrame:
    """MCD estimates per group of ``rows`` (columns ``keys``, not null, and ``z0``…) where ``large``
    (a condition on the keys and the count ``n``) holds."""
    z, by_start = [f"z{i}" for i in range(DIMS)], [*keys, "start"]
    # start 0: medians; 1: all rows; from 2 on: halves by a hash of the vector
    halves = [F.when(F.xxhash64(*z, F.lit(s)) % 2 == 0, F.lit(s)) for s in range(2, 2 + HALVES)]
    dealt = rows.withColumn("start", F.explode(F.filter(F.array(F.lit(1), *halves), lambda s: s.isNotNull())))
    moments = scratch(f"{name}-starts", _moments(dealt, by_start))
    groups = moments.where((F.col("start") == 1) & large).select(*keys)
    first = _medians(rows, keys).withColumn("start", F.lit(0)).unionByName(_estimates(moments, by_start, 1.0)).join(groups, keys, "left_semi")
    running = scratch(f"{name}0", first.withColumn("settled", F.lit(False)))
    rows = rows.withColumn("salt", _salt(*z))
    # with the support's share of a normal cloud, the kept scatter is too small by this factor
    factor = _consistency(support)
    bin_of = F.floor(F.log2(F.col("d2") + F.lit(2.0 ** -20)) * BINS_PER_OCTAVE).cast("int")
    settled, step = None, 0
    while not running.isEmpty():
        step += 1
        counts = _placed(rows, running, keys, []).withColumn("bin", bin_of).groupBy(*by_start, "bin").agg(F.count("*").alias("n"))
        bins = counts.groupBy(*by_start).agg(F.sort_array(F.collect_list(F.struct("bin", "n"))).alias("bins"), F.sum("n").alias("total"))
        # the first bin at which the running count reaches the support, and the share of its rows
        # that is needed; a few thousand bins at most
        need = F.col("total") * support
        reach = F.aggregate("bins", F.struct(F.lit(0).cast("long").alias("seen"), F.lit(None).cast("int").alias("cut"), F.lit(None).cast("double").alias("share")),
                            lambda a, b: F.struct((a["seen"] + b["n"]).alias("seen"), *[
                                F.when(a["cut"].isNotNull(), a[c]).when(a["seen"] + b["n"] >= need, v).alias(c)
                                for c, v in (("cut", b["bin"]), ("share", (need - a["seen"]) / b["n"]))]))
        cuts = scratch(f"{name}{step}-cuts", bins.select(*by_start, reach.alias("r")).select(*by_start, "r.cut", "r.share"))
        aimed = running.join(cuts, by_start)
        inside = _placed(rows, aimed, keys, ["cut"]).withColumn("bin", bin_of).where(F.col("bin") <= F.col("cut")).withColumn("edge", F.col("bin") == F.col("cut"))
        weight = F.when(F.col("edge"), F.col("share")).otherwise(1.0)
        kept = _moments(inside, [*by_start, "edge"]).join(cuts, by_start).groupBy(*by_start).agg(*[F.sum(F.col(c).cast("double") * weight).alias(c) for c in ["n", *_SUMS]])
        before = running.select(*by_start, F.col("objective").alias("before"))
        # the starts themselves are no estimates of a kept share: their objective does not count
        done = (F.lit(step > 1) & (F.col("before") - F.col("objective") < SETTLED)).alias("settled")
        stepped = scratch(f"{name}{step}", _estimates(kept, by_start, factor).join(before, by_start).select(*by_start, "centre", "inverse", "log_det", "objective", done))
        found, running = stepped.where("settled"), stepped.where("NOT settled")
        settled = found if settled is None else settled.unionByName(found)
    fits = running if settled is None else settled
    best = F.min_by(F.struct("centre", "inverse"), F.struct("log_det", "start"))
    return scratch(f"{name}-best", fits.groupBy(*keys).agg(best.alias("fit")).select(*keys, "fit.*"))


def _placed(rows: DataFrame, estimates: DataFrame, keys: list[str], extra: list[str]) -> DataFrame:
    """Each row once for every estimate of its group, with its squared distance to it."""
    packed = estimates.groupBy(*keys).agg(F.collect_list(F.struct("start", "centre", "inverse", *extra)).alias("fits"))
    met = rows.join(_for_each_salt(packed), [*keys, "salt"])
    return met.withColumn("fit", F.explode("fits")).select(*keys, *[f"z{i}" for i in range(DIMS)], "fit.*").withColumn("d2", _distance())


def _consistency(support: float) -> float:
    """h / P(chi2_{p+2} <= q) with q the h-quantile of chi2_p, p = DIMS, by integration."""
    x = np.linspace(1e-6, 60, 400_001)

    def cdf(p):
        dens = x ** (p / 2 - 1) * np.exp(-x / 2)
        return np.cumsum(dens) / dens.sum()

    q = int(np.searchsorted(cdf(DIMS), support))
    return float(support / cdf(DIMS + 2)[q])


def judge(docs: DataFrame, *, cutoff: float = CUTOFF, min_group: int = MIN_GROUP, scratch: Scratch | None = None) -> DataFrame:
    """doc_id, base statistics, base_failed, kept, and the squared distance (null for rows that
    failed the base rules) of every row of ``docs``."""
    scratch = scratch or Scratch(docs.sparkSession, "robust")
    none, every = F.lit("\u0000"), F.lit("\u0001")  # null languages and sources group together
    stats = scratch("statistics", statistics(docs).withColumn("base_failed", base_failed()).select(
        "*", F.coalesce("lang", none).alias("g_lang"), F.coalesce("source", none).alias("g_source"), *vector()))
    usable = stats.where(~F.col("base_failed"))
    # each row counts for its group, its language and the whole: three estimates in one run
    level = F.array(*[F.struct(F.lit(n).alias("level"), a.alias("k1"), b.alias("k2"))
                      for n, a, b in ((0, F.col("g_lang"), F.col("g_source")), (1, F.col("g_lang"), every), (2, every, every))])
    rows = usable.select(F.explode(level).alias("k"), *[f"z{i}" for i in range(DIMS)]).select("k.*", *[f"z{i}" for i in range(DIMS)])
    fits = minimum_covariance(rows, ["level", "k1", "k2"], scratch, "mcd", (F.col("n") >= min_group) | (F.col("level") == 2))
    # every group's own estimate if it has one, else its language's, else the one over all rows
    groups = usable.select("g_lang", "g_source", every.alias("g_all")).distinct()
    for k, on in enumerate((["g_lang", "g_source"], ["g_lang", "g_all"], ["g_all", "g_all"])):
        part = fits.where(F.col("level") == k).select(F.col("k1").alias("a"), F.col("k2").alias("b"), F.struct("centre", "inverse").alias(f"fit{k}"))
        groups = groups.join(part, (groups[on[0]] == part["a"]) & (groups[on[1]] == part["b"]), "left").drop("a", "b")
    chosen = scratch("chosen", groups.withColumn("fit", F.coalesce("fit0", "fit1", "fit2")).select("g_lang", "g_source", "fit.*"))
    judged = stats.withColumn("salt", _salt("doc_id")).join(_for_each_salt(chosen), ["g_lang", "g_source", "salt"], "left").withColumn("d2", F.when(~F.col("base_failed"), _distance()))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                         (~F.col("base_failed") & (F.coalesce(F.col("d2"), F.lit(0.0)) <= cutoff)).alias("kept"), F.col("d2").alias("distance"))
