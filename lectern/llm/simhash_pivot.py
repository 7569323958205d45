"""SimHash near-duplicates: pivot distance tables.

Every text gets a 64-bit fingerprint of its word shingles. Distinct fingerprints carry a table of
their Hamming distances to ``PIVOTS`` reference fingerprints, computed once. By the triangle
inequality two fingerprints within k bits differ by at most k in every coordinate, so a pair goes
as soon as its largest coordinate difference passes k; survivors are verified bit by bit.

Which fingerprints meet: the 64 bits are cut into ``BLOCKS`` blocks; two fingerprints within k bits
agree on all but at most k blocks, so each one is listed under every choice of BLOCKS - k blocks
(20 lists of 32 agreeing bits at 6 blocks and k = 3) and only meets those of the same list. Lists
longer than ``LIST_LIMIT`` are not compared as a whole: their members are listed anew by the same
rule inside the bits that are not yet fixed, which is exact again; at the last level a list can
hold at most 2^16 fingerprints. A task streams over its sorted lists and emits, for each list, one
link per member to its component's least fingerprint there (never all pairs), so rows stay linear
in the input however dense a group is. Components over these links are the components over all
links.

Copies share a fingerprint and collapse before anything is compared.

Cases: null or wordless texts have fingerprint zero and are linked like any other; texts with
fewer words than the shingle length count their whole word sequence as one shingle; a null id
never names a component unless its component has no other id; repeated rows are kept. Extra
columns are ignored. Empty table → empty result.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import Scratch, own_name, texts_of
from lectern.llm.components import connected_components

SHINGLE = 3
MAX_BITS = 3
PIVOTS = 16
BLOCKS = 6
LIST_LIMIT = 4096

#: Lower-cases A-Z only.
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """Bit i is set if over half of the shingles' XXH64 (seed 42) have it set."""
    words = (text or b"").translate(_LOWER).split()
    if not words:
        return 0
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), 42)
    joined = b" ".join(words)
    lens = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1
    starts = np.cumsum(lens) - lens
    n = len(words) - shingle + 1
    ends = (starts + lens - 1)[shingle - 1:]
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[a:b], 42) for a, b in zip(starts[:n].tolist(), ends.tolist())), dtype=np.uint64, count=n)
    total = np.zeros(64, dtype=np.int64)
    for at in range(0, n, 1 << 16):
        part = np.unpackbits(hashes[at:at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        total += part.sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * total > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, marks: list[Column] | None = None) -> DataFrame:
    """doc_id and fingerprint (64 bits as a signed long), in one pass over the scan; with ``marks``
    (longs m0, m1), if given."""
    marks = [m.alias(f"m{i}") for i, m in enumerate(marks or [])]
    names = ["doc_id", "fp"] + [f"m{i}" for i in range(len(marks))]

    def run(batches):
        for batch in batches:
            fps = np.array([fingerprint(t, shingle) for t in texts_of(batch.column("text"))], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fps.view(np.int64)), *batch.columns[2:]], names=names)

    columns = [F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *marks]
    return docs.select(*columns).mapInArrow(run, ", ".join(f"{n} long" for n in names))


def row_marks(df: DataFrame) -> list[Column]:
    """Two 64-bit hashes of a row over all its columns, nulls told apart."""
    values = [F.to_json(F.struct(f.name)) if "map<" in f.dataType.simpleString() else F.col(f.name) for f in df.schema.fields]
    told = [x for v in values for x in (v, v.isNull())]
    return [F.xxhash64(*told), F.xxhash64(F.lit("second"), *told)]


def pivots(count: int = PIVOTS) -> list[int]:
    """The reference fingerprints: XXH64 of their numbers, as signed longs."""
    return np.array([xxhash.xxh64_intdigest(f"pivot {k}", 42) for k in range(count)], dtype=np.uint64).view(np.int64).tolist()


def pivot_table(fps: DataFrame, count: int = PIVOTS) -> DataFrame:
    """Each distinct fingerprint with its distances to the pivots, packed eight to a long."""
    refs = pivots(count)
    packs = []
    for at in range(0, count, 8):
        pack = F.lit(0).cast("long")
        for k, p in enumerate(refs[at:at + 8]):
            pack = pack.bitwiseOR(F.shiftleft(F.bit_count(F.col("fp").bitwiseXOR(F.lit(p))).cast("long"), 8 * k))
        packs.append(pack.alias(f"t{at // 8}"))
    return fps.select("fp", *packs)


def block_choices(free: list[int], k: int = MAX_BITS, blocks: int = BLOCKS) -> list[tuple[int, list[int]]]:
    """For the bit positions ``free``: each choice of all but ``k`` of ``blocks`` blocks, as a mask
    and the positions that stay free."""
    cuts = [len(free) * i // blocks for i in range(blocks + 1)]
    parts = [free[a:b] for a, b in zip(cuts, cuts[1:])]
    out = []
    for fixed in combinations(range(blocks), blocks - k):
        mask = sum(1 << p for i in fixed for p in parts[i])
        out.append((mask, [p for i in range(blocks) if i not in fixed for p in parts[i]]))
    return out


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _list_runs(key: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Start of each run of rows of the same list (same mask, same masked bits)."""
    new = np.ones(len(key), dtype=bool)
    new[1:] = (key[1:] != key[:-1]) | (mask[1:] != mask[:-1])
    return np.flatnonzero(new)


def close_pairs(fp: np.ndarray, table: np.ndarray, left: np.ndarray, right: np.ndarray, k: int) -> np.ndarray:
    """Which of the candidate pairs (positions) are within ``k`` bits: the pivot table first, one
    coordinate after the other on what is left, then the bits themselves."""
    alive = np.arange(len(left))
    for c in range(table.shape[1]):
        column = table[:, c]
        alive = alive[np.abs(column[left[alive]] - column[right[alive]]) <= k]
        if not len(alive):
            break
    return alive[np.bitwise_count(fp[left[alive]] ^ fp[right[alive]]) <= k]


def _links(fp: np.ndarray, table: np.ndarray, run_of: np.ndarray, size: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (member, root) of positions within their run; rows of a run are adjacent."""
    root = np.arange(len(fp))
    longest = int(size.max()) if len(size) else 1
    pairs_l, pairs_r = [], []
    for step in range(1, longest):
        left = np.flatnonzero(run_of[:-step] == run_of[step:]) if step < len(fp) else np.zeros(0, np.int64)
        if not len(left):
            break
        good = close_pairs(fp, table, left, left + step, k)
        pairs_l.append(left[good])
        pairs_r.append(left[good] + step)
        if sum(map(len, pairs_l)) > 1 << 20:
            root = _merge(root, pairs_l, pairs_r)
            pairs_l, pairs_r = [], []
    root = _merge(root, pairs_l, pairs_r)
    member = np.flatnonzero(root != np.arange(len(fp)))
    return member, root[member]


def _merge(root: np.ndarray, left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Least position of each component, given roots so far and further pairs."""
    if not left:
        return root
    a, b = np.concatenate(left), np.concatenate(right)
    while len(a):
        ra, rb = root[a], root[b]
        open_ = ra != rb
        a, b, ra, rb = a[open_], b[open_], ra[open_], rb[open_]
        if not len(a):
            break
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while True:
            up = root[root]
            if np.array_equal(up, root):
                break
            root = up
    return root


_LIST_SCHEMA = "mask long, key long, fp long, t0 long, t1 long"


def _compare_lists(k: int, limit: int, last: bool):
    """Streams rows sorted by list; yields links of lists up to ``limit``, and the rows of longer
    ones unchanged (to be listed anew). A list may span batches: the last one is carried over, and
    no more than ``limit`` rows of it are ever held unless this is the last level."""
    def out(a, b, kind, rows=None):
        if rows is None:
            zero = np.zeros(len(a), dtype=np.int64)
            cols = [zero, zero, a.view(np.int64), b.view(np.int64), zero]
        else:
            cols = [rows[c] for c in ("mask", "key", "fp", "t0", "t1")]
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(cols[0]), kind, dtype=np.int32)), *(pa.array(c) for c in cols)],
                                          names=["kind", "mask", "key", "fp", "t0", "t1"])

    def solve(rows):
        starts = _list_runs(rows["key"], rows["mask"])
        size = np.diff(np.append(starts, len(rows["fp"])))
        long_run = size > limit if not last else np.zeros(len(size), dtype=bool)
        run_of = np.repeat(np.arange(len(starts)), size)
        if long_run.any():
            yield out(None, None, 1, {c: v[long_run[run_of]] for c, v in rows.items()})
        keep = (size > 1) & ~long_run
        rows_k, run_k = {c: v[keep[run_of]] for c, v in rows.items()}, run_of[keep[run_of]]
        if not len(run_k):
            return
        fp = rows_k["fp"].view(np.uint64)
        table = np.stack([rows_k["t0"], rows_k["t1"]], axis=1).view(np.uint8).reshape(-1, 16).astype(np.int16)
        # runs of alike length together: short ones need few steps
        for low, high in ((2, 8), (9, 64), (65, 1 << 62)):
            part = np.isin(run_k, np.flatnonzero((size >= low) & (size <= high) & keep))
            if part.any():
                f = fp[part]
                member, root = _links(f, table[part], run_k[part], size[(size >= low) & (size <= high) & keep], k)
                if len(member):
                    yield out(f[member], f[root], 0)

    def run(batches):
        held: list[dict] = []
        passing = None  # (mask, key) of a list already known to be too long
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = {c: batch.column(c).to_numpy() for c in ("mask", "key", "fp", "t0", "t1")}
            if passing is not None:
                same = (rows["mask"] == passing[0]) & (rows["key"] == passing[1])
                if same.any():
                    yield out(None, None, 1, {c: v[same] for c, v in rows.items()})
                rows = {c: v[~same] for c, v in rows.items()}
                if not len(rows["fp"]):
                    continue
                passing = None
            rows = {c: np.concatenate([h[c] for h in held] + [rows[c]]) for c in rows}
            starts = _list_runs(rows["key"], rows["mask"])
            at = int(starts[-1])
            if at:
                yield from solve({c: v[:at] for c, v in rows.items()})
            tail = {c: v[at:] for c, v in rows.items()}
            if not last and len(tail["fp"]) > limit:
                yield out(None, None, 1, tail)
                passing, held = (tail["mask"][0], tail["key"][0]), []
            else:
                held = [tail]
        if held and len(held[0]["fp"]):
            yield from solve(held[0])

    return run


def near_links(table: DataFrame, scratch: Scratch, *, k: int = MAX_BITS, blocks: int = BLOCKS, limit: int = LIST_LIMIT) -> DataFrame:
    """Links (a, b) between distinct fingerprints of a pivot table whose components are those of
    all pairs within ``k`` bits."""
    levels = [[(0, list(range(64)))]]  # masks fixed so far and the positions still free
    while len(levels[-1][0][1]) > 16:
        levels.append([(mask | more, rest) for mask, free in levels[-1] for more, rest in block_choices(free, k, blocks)])
    links, rows = None, table.select(F.lit(0).cast("long").alias("mask"), "fp", "t0", "t1")
    for depth in range(1, len(levels)):
        # the masks that refine each mask of the level before
        finer: dict[int, list[int]] = {}
        for mask, free in levels[depth - 1]:
            finer.setdefault(mask, [_signed(mask | more) for more, _ in block_choices(free, k, blocks)])
        if depth == 1:
            choices = F.array(*[F.lit(m).cast("long") for m in finer[0]])
        else:
            choices = F.element_at(F.create_map(*[x for m, fine in finer.items() for x in (F.lit(_signed(m)).cast("long"), F.array(*[F.lit(f).cast("long") for f in fine]))]), F.col("mask"))
        listed = rows.withColumn("mask", F.explode(choices)).withColumn("key", F.col("fp").bitwiseAND(F.col("mask"))).select("mask", "key", "fp", "t0", "t1")
        if depth > 1:
            listed = listed.distinct()  # two lists of the level before can lead to the same one
        sorted_ = listed.repartition("mask", "key").sortWithinPartitions("mask", "key", "fp")
        got = scratch(f"lists{depth}", sorted_.mapInArrow(_compare_lists(k, limit, depth == len(levels) - 1), "kind int, " + _LIST_SCHEMA))
        found = got.where("kind = 0").select(F.col("fp").alias("a"), F.col("t0").alias("b"))
        links = found if links is None else links.union(found)
        rows = got.where("kind = 1").select("mask", "fp", "t0", "t1")
        if rows.isEmpty():
            break
    return links


def _roots(prints: DataFrame, scratch: Scratch, k: int, limit: int) -> DataFrame:
    """(v, root) of every fingerprint that has a link: the least fingerprint of its component."""
    distinct = scratch("distinct", pivot_table(prints.select("fp").distinct()))
    return connected_components(near_links(distinct, scratch, k=k, limit=limit), scratch)


def near_duplicates(docs: DataFrame, *, shingle: int = SHINGLE, k: int = MAX_BITS, limit: int = LIST_LIMIT,
                    scratch: Scratch | None = None) -> DataFrame:
    """doc_id, fp (signed long) and component_id (the least doc_id reachable over links of ``k`` or
    fewer differing bits) of every row of ``docs``."""
    scratch = scratch or Scratch(docs.sparkSession, "simhash")
    prints = scratch("fingerprints", fingerprints(docs, shingle))
    roots = _roots(prints, scratch, k, limit)
    # the least id of each fingerprint, then of each component; fingerprints without links stand alone
    firsts = prints.groupBy("fp").agg(F.min("doc_id").alias("first"))
    member = firsts.join(roots.withColumnRenamed("v", "fp"), "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    member = scratch("members", member)
    least = member.groupBy("root").agg(F.min("first").alias("component_id"))
    named = scratch("named", member.join(least, "root").select("fp", "component_id"))
    return prints.join(named, "fp").select("doc_id", "fp", "component_id")


def hex_of(fp: str) -> Column:
    """16 lower-case hex digits of a signed long."""
    return F.lower(F.lpad(F.hex(F.col(fp)), 16, "0"))


def drop_near_duplicates(docs: DataFrame, *, shingle: int = SHINGLE, k: int = MAX_BITS, limit: int = LIST_LIMIT,
                         scratch: Scratch | None = None) -> DataFrame:
    """``docs``, columns unchanged, with one row of each component: the one of the least id (rows
    without an id come last), of equal ids the one whose row has the least hash. Components are those
    of rows, so an id that names several texts can stay several times, and copies without an id go."""
    scratch = scratch or Scratch(docs.sparkSession, "simhash-drop")
    marks = row_marks(docs)
    prints = scratch("fingerprints", fingerprints(docs, shingle, marks))
    # the first row of each fingerprint, then of each component
    first = lambda order: F.min(order).alias("row")
    firsts = scratch("firsts", prints.groupBy("fp").agg(first(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "m0", "m1"))))
    rooted = firsts.join(_roots(prints, scratch, k, limit).withColumnRenamed("v", "fp"), "fp", "left")
    names = [own_name(docs, n) for n in ("m0", "m1")]
    kept = scratch("kept", rooted.groupBy(F.coalesce("root", "fp").alias("root")).agg(first(F.col("row"))).select(*[F.col(f"row.m{i}").alias(n) for i, n in enumerate(names)]))
    # rows that are equal in all columns share their marks: one of them stays
    marked = docs.withColumns(dict(zip(names, marks))).join(kept, names, "left_semi")
    return marked.dropDuplicates(names).select(*docs.columns)
