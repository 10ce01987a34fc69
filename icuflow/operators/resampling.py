"""Bootstrap of whole groups: multiplicities for thousands of replicates, and ranking metrics of all replicates in one pass over the rows."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from icuflow.sources.files import kept, removed

#: A group's counts travel as the bytes of such numbers, one for each replicate.
COUNT = np.dtype("<u2")
#: Counts that are turned into numbers at a time, so that they stay in a core's cache.
CELLS = 1 << 17
#: Groups drawn together in one task, on average.
BUCKET = 1 << 16
#: Replicates whose draws come from one hash.
SHARED = 8
#: Ranges of keys that are handled apart.
RANGES = 64
#: Ranges of a score at most, and rows of a range at least, about.
PLACES, PLACE_ROWS = 256, 1 << 12
#: Rows that are packed together, rows of a step in the order of scores, and counts held at a time where a replicate is a column.
PACKED_ROWS, STEP, COLUMN_CELLS = 1 << 17, 64, 1 << 24
#: Counts that are summed up at a time where scores are frequent.
SUMMED_CELLS = 1 << 23
#: Draws of a row, draws that are packed together, and counts of a bucket of groups.
ROW_DRAWS, PACKED_DRAWS, BUCKET_CELLS = 1 << 9, 1 << 22, 1 << 21
#: Rows of a table that one task sorts, about.
ROWS_A_TASK = 1 << 20
METRICS = ("roc_auc", "average_precision")


def range_of(df: DataFrame, column: str, ranges: int = RANGES) -> Column:
    """Number of the range that a value of a numeric column falls in; ranges hold about as many rows each, equal values share one."""
    cuts = sorted(set(df.agg(F.percentile_approx(column, [i / ranges for i in range(1, ranges)], 10_000)).first()[0] or []))

    def among(low: int, high: int) -> Column:
        middle = (low + high) // 2
        return F.lit(low) if low == high else F.when(F.col(column) >= cuts[middle], among(middle + 1, high)).otherwise(among(low, middle))

    return among(0, len(cuts))


def freed(spark: SparkSession) -> None:
    """What earlier plans shuffled is deleted once their plans are collected."""
    spark._jvm.System.gc()


def tasks_of(spark: SparkSession, rows: int) -> int:
    """The session's partitions, or one for each ROWS_A_TASK rows if these are more."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // ROWS_A_TASK))


def dense_index(keys: DataFrame, key: str) -> DataFrame:
    """key, index: the place of each distinct key from 0, counted by range, so no task sorts all keys."""
    ranged = keys.select(key, range_of(keys, key).alias("r"))
    sizes = ranged.groupBy("r").agg(F.count("*").alias("n"))
    # as many rows as ranges
    before = sizes.select("r", F.coalesce(F.sum("n").over(Window.orderBy("r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    inside = F.row_number().over(Window.partitionBy("r").orderBy(key))
    return ranged.join(F.broadcast(before), "r").select(key, (F.col("before") + inside - 1).alias("index"))


def hashed_weights(groups: DataFrame, key: str, replicates: int, seed: int = 1) -> DataFrame:
    """key, weights: draws by md5, which any engine can repeat, for few replicates, as every draw is hashed.

    A draw's group is its hash modulo the number of groups, in the order of keys. Draws travel packed, two or three bytes
    each, and are counted where their bucket of keys is. Groups that are never drawn have no row."""
    spark, keys = groups.sparkSession, groups.select(key).distinct()
    n = keys.count()
    bucket = max(1, min(BUCKET, BUCKET_CELLS // max(1, replicates)))
    tasks = tasks_of(spark, replicates * n // 8)
    blocks = max(1, -(-n // ROW_DRAWS))
    drawn = spark.range(0, replicates * blocks if n else 0, 1, tasks).select(F.floor(F.col("id") / blocks).cast("int").alias("replicate"), (F.pmod("id", F.lit(blocks)) * ROW_DRAWS).alias("low"))
    drawn = drawn.withColumns({"named": F.concat_ws(":", F.lit(seed), "replicate", F.lit("")), "ds": F.sequence("low", F.least(F.col("low") + ROW_DRAWS, F.lit(n)) - 1)})
    digests = F.array_join(F.transform("ds", lambda d: F.substring(F.md5(F.concat("named", d.cast("string"))), 1, 8)), "")
    offset = np.dtype("<u2" if bucket <= 1 << 16 else "<u4")

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in _gathered(batches, PACKED_DRAWS // ROW_DRAWS):
            replicate, digests = x.column("replicate").to_numpy(), x.column("digests").to_pylist()
            for low, high in _runs(replicate):  # draws come in the order of replicates
                own = np.sort(np.frombuffer(bytes.fromhex("".join(digests[low:high])), ">u4").astype(np.int64) % n)
                found, cuts = np.unique(own // bucket, return_index=True)
                offsets = [o.astype(offset).tobytes() for o in np.split(own % bucket, cuts[1:])]
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array([replicate[low]] * len(found), pa.int32()), pa.array(offsets, pa.binary())], names=["bucket", "replicate", "offsets"])

    def counted(keys: pa.Table, draws: pa.Table) -> pa.Table:
        keys = keys.sort_by("index")
        cells = [np.frombuffer(b, offset).astype(np.int64) * replicates + r for r, b in zip(draws.column("replicate").to_pylist(), draws.column("offsets").to_pylist(), strict=True)]
        counts = np.bincount(np.concatenate(cells or [np.zeros(0, np.int64)]), minlength=keys.num_rows * replicates).reshape(-1, replicates)
        some = np.flatnonzero(counts.any(1))
        return pa.table({key: keys.column(key).take(pa.array(some)), "weights": pa.array([w.tobytes() for w in counts[some].astype(COUNT)], pa.binary())})

    draws = drawn.select("replicate", digests.alias("digests")).mapInArrow(packed, "bucket long, replicate int, offsets binary")
    indexed = dense_index(keys, key).withColumn("bucket", F.floor(F.col("index") / bucket))
    buckets = tasks_of(spark, n)
    return indexed.repartition(buckets, "bucket").groupBy("bucket").cogroup(draws.repartition(buckets, "bucket").groupBy("bucket")).applyInArrow(counted, f"`{key}` {keys.schema[key].dataType.simpleString()}, weights binary")


def _mixed(x: np.ndarray) -> np.ndarray:
    """Splitmix's finish: 64 bits that look random for each number."""
    shifted = x >> np.uint64(30)
    x = x ^ shifted
    for factor, shift in ((0xBF58476D1CE4E5B9, 27), (0x94D049BB133111EB, 31)):  # in place
        x *= np.uint64(factor)
        np.right_shift(x, np.uint64(shift), out=shifted)
        x ^= shifted
    return x


def _poisson_tables() -> tuple[list[int], int, np.ndarray]:
    """A count of mean 1 from a byte: the bytes from which it is 1, 2 and so on, those from which the byte doesn't tell it, and the steps of what is left then."""
    p = np.array([math.exp(-1) / math.factorial(k) for k in range(18)])
    whole = np.floor(p * 256)
    left = np.cumsum(p * 256 - whole)
    return np.cumsum(whole)[: np.count_nonzero(whole) - 1].astype(int).tolist(), int(whole.sum()), left / left[-1]


BYTES, DOUBTFUL, LEFT = _poisson_tables()


def _doubtful(mixed: np.ndarray, byte: np.ndarray) -> np.ndarray:
    """Counts of bytes that don't tell them, from more bits of the same hash."""
    more = _mixed(mixed + (byte + 1).astype(np.uint64) * np.uint64(0xD1B54A32D192ED03)) >> np.uint64(11)
    return np.searchsorted(LEFT[:-1], more.astype(np.float64) / float(1 << 53), "right")


def _blocks(low: int, high: int, seed: int) -> np.ndarray:
    return _mixed((np.arange(low, high, dtype=np.uint64) + np.uint64((seed << 32) + 1)) * np.uint64(0x9E3779B97F4A7C15))


def poisson_counts(hashes: np.ndarray, low: int, high: int, seed: int) -> np.ndarray:
    """A count of mean 1 (one byte) for each hash (64 bits) and each replicate from low (divisible by SHARED) up to high: the same wherever it is asked for."""
    blocks = _blocks(low // SHARED, -(-high // SHARED), seed)
    found = np.empty((len(hashes), len(blocks) * SHARED), np.uint8)
    size = max(1, CELLS // max(1, found.shape[1]))
    for at in range(0, len(hashes), size):
        mixed = _mixed(hashes[at : at + size].astype(np.uint64)[:, None] + blocks[None])
        cells, counts = mixed.view("u1"), found[at : at + size]
        np.greater_equal(cells, BYTES[0], out=counts.view(bool))
        for b in BYTES[1:]:
            counts += (cells >= b).view(np.uint8)
        # eight at a time first, as few are so
        words = np.flatnonzero((cells >= DOUBTFUL).view("<u8").reshape(-1) != 0)
        if len(words):
            at_byte = np.flatnonzero(cells.reshape(-1, SHARED)[words].reshape(-1) >= DOUBTFUL)
            word, byte = words[at_byte // SHARED], at_byte % SHARED
            counts.reshape(-1, SHARED)[word, byte] = _doubtful(mixed.reshape(-1)[word], byte)
    return found[:, : high - low]


def poisson_count(hashes: np.ndarray, replicate: np.ndarray, seed: int) -> np.ndarray:
    """poisson_counts() for one replicate of each hash."""
    blocks = _blocks(0, int(replicate.max(initial=0)) // SHARED + 1, seed)
    mixed, byte = _mixed(hashes.astype(np.uint64) + blocks[replicate // SHARED]), replicate % SHARED
    cells = np.take_along_axis(mixed.view("u1").reshape(-1, SHARED), byte[:, None], 1)[:, 0]
    return np.where(cells >= DOUBTFUL, _doubtful(mixed, byte), np.searchsorted(BYTES, cells, "right"))


def draws(groups: DataFrame, key: str, replicates: int, seed: int = 1) -> DataFrame:
    """key, hash, fixes: how often each replicate draws the group, as what any task can work out from the hash, and the few draws that differ from it.

    A replicate draws with replacement, as many groups as there are. Independent counts of mean 1 have that law once their
    total is right, so draws are taken back at random (or added) until it is: about the square root of the number of groups
    for each replicate. A draw to take back is found by looking at places at random until one holds a draw, so only the
    totals need all counts. fixes: 2 * replicate for a draw more, 2 * replicate + 1 for one less. Only distinct keys are
    shuffled; the driver holds a number for each replicate and BUCKET keys."""
    keys = groups.select(key).where(F.col(key).isNotNull()).distinct()
    n = keys.count()
    buckets = max(1, -(-n // BUCKET))
    dealt = keys.select(key, F.xxhash64(key).alias("hash"), F.pmod(F.xxhash64(key, F.lit(1)), F.lit(buckets)).cast("int").alias("bucket")).repartition(buckets, "bucket")

    def hashes(frame: pa.Table) -> np.ndarray:
        return frame.column("hash").to_numpy().view(np.uint64)

    def total(frame: pa.Table) -> pa.Table:
        found, own = np.zeros(replicates, dtype=np.int64), hashes(frame)
        for at in range(0, len(own), STEP):
            found += poisson_counts(own[at : at + STEP], 0, replicates, seed).sum(0, dtype=np.uint16)
        return pa.table({"bucket": frame.column("bucket").slice(0, 1), "n": [frame.num_rows], "totals": pa.array([found])})

    sizes, totals = np.zeros(buckets, dtype=np.int64), np.zeros((buckets, replicates), dtype=np.int64)
    found = dealt.groupBy("bucket").applyInArrow(total, "bucket int, n long, totals array<long>").toArrow()  # all buckets are worked out at once
    if found.num_rows:
        at = found.column("bucket").to_numpy()
        sizes[at], totals[at] = found.column("n").to_numpy(), found.column("totals").combine_chunks().flatten().to_numpy().reshape(-1, replicates)
    surplus, change = totals.sum(0) - n, np.zeros((buckets, replicates), dtype=np.int32)
    for k in range(replicates if n else 0):
        rng = np.random.default_rng([seed, k])
        change[:, k] = -rng.multivariate_hypergeometric(totals[:, k], surplus[k], method="marginals") if surplus[k] > 0 else rng.multinomial(-surplus[k], sizes / n)
    shared = groups.sparkSession.sparkContext.broadcast(change)

    def taken(own: np.ndarray, wanted: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
        """Replicate and row of wanted[k] draws of each replicate, each draw once: places are looked at until enough hold a draw."""
        span = len(own) * len(LEFT)
        held = np.zeros(0, np.int64)  # replicate * span + a place among len(LEFT) of each row
        while True:
            missing = wanted - np.bincount(held // span, minlength=replicates)
            if not (missing > 0).any():
                return held // span, held % span // len(LEFT)
            k = np.repeat(np.arange(replicates), np.where(missing > 0, missing * len(LEFT) + 8, 0))
            place = rng.integers(0, span, len(k))
            drawn = np.concatenate([poisson_count(own[place[i : i + CELLS] // len(LEFT)], k[i : i + CELLS], seed) for i in range(0, len(k), CELLS)]) > place % len(LEFT)
            held = np.concatenate([held, (k * span + place)[drawn]])
            held = held[np.sort(np.unique(held, return_index=True)[1])]
            held = held[np.argsort(held // span, kind="stable")]
            held = held[np.arange(len(held)) - np.searchsorted(held // span, held // span) < wanted[held // span]]  # the first ones

    def fixed(frame: pa.Table) -> pa.Table:
        frame = frame.sort_by(key)
        own, bucket = hashes(frame), frame.column("bucket")[0].as_py()
        wanted, rng = shared.value[bucket], np.random.default_rng([seed, replicates, bucket])
        more, (less, gone) = np.repeat(np.arange(replicates), np.maximum(wanted, 0)), taken(own, np.maximum(-wanted, 0), rng)
        row, code = np.concatenate([rng.integers(0, len(own), len(more)), gone]), np.concatenate([2 * more, 2 * less + 1])
        order = np.argsort(row, kind="stable")
        ends = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(own)))]).astype(np.int32)
        return pa.table({key: frame.column(key), "hash": frame.column("hash"), "fixes": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(code[order].astype(np.int32)))})

    return dealt.groupBy("bucket").applyInArrow(fixed, f"`{key}` {keys.schema[key].dataType.simpleString()}, hash long, fixes array<int>")


def drawn_counts(x: pa.RecordBatch, replicates: int, seed: int) -> np.ndarray:
    """The counts of a few rows of draws(), a row each."""
    counts = poisson_counts(x.column("hash").to_numpy().view(np.uint64), 0, replicates, seed).astype(np.float64)
    row, code = _fixes(x.column("fixes"))
    np.add.at(counts, (row, code // 2), 1 - 2 * (code % 2))
    return counts


def group_weights(groups: DataFrame, key: str, replicates: int, seed: int = 1) -> DataFrame:
    """key, weights: the counts of draws() as bytes, one COUNT a replicate. Large: resampled_metrics() takes draws() instead."""

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = max(1, CELLS // max(1, replicates))
            for start in range(0, batch.num_rows, size):
                x = batch.slice(start, size)
                yield pa.RecordBatch.from_arrays([x.column(key), pa.array([w.tobytes() for w in drawn_counts(x, replicates, seed).astype(COUNT)], pa.binary())], names=[key, "weights"])

    found = draws(groups, key, replicates, seed)
    return found.mapInArrow(written, f"`{key}` {found.schema[key].dataType.simpleString()}, weights binary")


def _gathered(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    held, n = [], 0
    for b in batches:
        held.append(b)
        n += b.num_rows
        if n >= rows:
            yield pa.Table.from_batches(held).combine_chunks()
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held).combine_chunks()


def _runs(*columns: np.ndarray) -> list[tuple[int, int]]:
    """Where equal neighbours begin and end."""
    if not len(columns[0]):
        return []
    cuts = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0)) + 1
    return list(zip([0, *cuts.tolist()], [*cuts.tolist(), len(columns[0])], strict=True))


def _fixes(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Row and code of each fix."""
    return np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy())), lists.flatten().to_numpy()


class _Counts:
    """Counts of rows by replicate: from the bytes of each, or from the hash of each and the fixes, in the order of rows."""

    def __init__(self, replicates: int, seed: int, weights: np.ndarray | None, hashes: np.ndarray | None = None, row: np.ndarray | None = None, code: np.ndarray | None = None):
        self.replicates, self.seed, self.weights, self.hashes, self.row, self.code = replicates, seed, weights, hashes, row, code

    def ordered(self, order: np.ndarray) -> _Counts:
        if self.weights is not None:
            return _Counts(self.replicates, self.seed, self.weights[order])
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        row = place[self.row]
        by = np.argsort(row, kind="stable")
        return _Counts(self.replicates, self.seed, None, self.hashes[order], row[by], self.code[by])

    def of(self, begin: int, end: int, low: int = 0, high: int | None = None) -> np.ndarray:
        """Of the rows from begin and the replicates from low (divisible by SHARED); a change of these numbers changes nothing else."""
        high = self.replicates if high is None else high
        if self.weights is not None:
            return self.weights[begin:end, low:high]
        counts = poisson_counts(self.hashes[begin:end], low, high, self.seed)
        first, last = np.searchsorted(self.row, [begin, end])
        row, code = self.row[first:last] - begin, self.code[first:last]
        if len(row):
            own = (code // 2 >= low) & (code // 2 < high)
            np.add.at(counts, (row[own], code[own] // 2 - low), np.where(code[own] % 2, 255, 1).astype(np.uint8))  # 255 is one less
        return counts


def _pairs_by_steps(p: np.ndarray, label: np.ndarray, counts: _Counts) -> list[np.ndarray]:
    """pairs, positives, negatives of each replicate, rows from the highest score down: a step of rows is compared as a whole."""
    kind = np.float32 if label.dtype == np.uint8 else np.float64  # sums of a step are exact in 24 bits
    same = np.concatenate([[False], p[1:] == p[:-1]])
    group, label = np.cumsum(~same), label.astype(np.float64)
    pairs, tp, fp = (np.zeros(counts.replicates) for _ in range(3))
    tied = np.zeros((2, counts.replicates))  # sums of the last score so far
    for i in range(0, len(p), STEP):
        j = min(i + STEP, len(p))
        c, a, g = counts.of(i, j), label[i:j], group[i:j]
        pos, neg = np.flatnonzero(a), np.flatnonzero(1 - a)
        dp, dn = c[pos].astype(kind), c[neg].astype(kind)
        above, below = g[pos][None], g[neg][:, None]
        matrix = ((above < below) + 0.5 * (above == below)) * a[pos][None] * (1 - a[neg])[:, None]
        pairs += np.einsum("ij,ij->j", matrix.astype(kind) @ dp, dn)
        sums = np.stack([a[pos].astype(kind) @ dp, (1 - a[neg]).astype(kind) @ dn]).astype(np.float64)
        pairs += sums[1] * tp

        def of_group(at: int, c=c, a=a, g=g) -> np.ndarray:
            own = np.flatnonzero(g == at)
            return np.stack([a[own], 1 - a[own]]) @ c[own].astype(np.float64)

        if same[i]:
            lead = of_group(g[0])
            pairs += (lead[0] * tied[1] - lead[1] * tied[0]) / 2
        if j < len(p) and same[j]:
            tied = of_group(g[-1]) + (tied if same[i] and g[0] == g[-1] else 0)
        tp += sums[0]
        fp += sums[1]
    return [pairs, tp, fp]


def _by_columns(p: np.ndarray, label: np.ndarray, counts: _Counts, above: np.ndarray) -> list[np.ndarray]:
    """pairs, positives, negatives and steps of average precision of each replicate, rows from the highest score down; above: positives and negatives of higher ranges."""
    ends = np.flatnonzero(np.concatenate([p[1:] != p[:-1], [True]]))
    found, label = np.zeros((4, counts.replicates)), label.astype(np.float64)
    size = max(1, COLUMN_CELLS // len(p) // SHARED) * SHARED
    for low in range(0, counts.replicates, size):
        columns = np.ascontiguousarray(counts.of(0, len(p), low, min(low + size, counts.replicates)).T)
        for k, w in enumerate(columns, low):
            tp, fp = np.cumsum(label * w)[ends], np.cumsum((1 - label) * w)[ends]
            pos, neg = np.diff(tp, prepend=0), np.diff(fp, prepend=0)
            ctp = tp + above[0, k]
            found[:, k] = (neg * (tp - pos / 2)).sum(), tp[-1], fp[-1], (pos * ctp / np.maximum(ctp + fp + above[1, k], 1)).sum()
    return list(found)


def resampled_metrics(df: DataFrame, key: str, scores: Sequence[str], weights: DataFrame, replicates: int, seed: int = 1, metrics: Sequence[str] = METRICS) -> DataFrame:
    """replicate, score and the metrics (of METRICS) of each replicate, ties and all; replicates without both classes go.

    weights: as made by draws() (with the same seed), or key and the counts' bytes. Rows meet their group's draws once.
    Rows of a frequent score (more than a range holds) are summed up where they are; the others are packed and dealt to
    ranges of scores, where they are put in order. Counts are worked out from the group's hash in both places, so they are
    never shuffled. ROC AUC needs the sums of the ranges above only at the end, so rows are read once; average precision needs them before
    (two arrays for each range, the only thing the driver holds), so packed rows are written and read twice."""
    spark, scores, by_hash, precise = df.sparkSession, list(scores), "fixes" in weights.columns, "average_precision" in metrics
    carried = ["hash", "fixes"] if by_hash else ["weights"]
    rows = df.where(F.col(key).isNotNull() & F.col("label").isNotNull()).select(key, F.col("label").cast("double").alias("label"), *[F.col(s).cast("double").alias(f"p{i}") for i, s in enumerate(scores)])
    n = rows.count()
    points = min(PLACES, max(1, n // PLACE_ROWS))
    found = rows.agg(*[F.percentile_approx(f"p{i}", [k / points for k in range(1, points)], 10_000) for i in range(len(scores))]).first() if points > 1 else [[]] * len(scores)
    cuts, often = [], []
    for at in found:
        values, times = np.unique(np.nan_to_num(np.array(at or [], dtype=np.float64), nan=np.inf, posinf=np.inf, neginf=-np.inf), return_counts=True)
        cuts.append(values)
        often.append(times > 1)
    tasks = tasks_of(spark, n)
    if tasks > int(spark.conf.get("spark.sql.shuffle.partitions")):
        rows, weights = rows.repartition(tasks, key), weights.repartition(tasks, key)
    names = ["score", "place", "n", "label", "p", "counts", "row", "code", "pos", "neg"]
    types = [pa.int32(), pa.int32(), pa.int32(), *[pa.binary()] * 7]

    def counts_of(x: pa.Table) -> _Counts:
        if by_hash:
            return _Counts(replicates, seed, None, x.column("hash").to_numpy().view(np.uint64), *_fixes(x.column("fixes").combine_chunks()))
        return _Counts(replicates, seed, np.frombuffer(b"".join(x.column("weights").to_pylist()), COUNT).reshape(-1, replicates))

    def summed(x: pa.Table, places: list[np.ndarray], sums: dict[tuple[int, int], np.ndarray]) -> None:
        """Sums of positives and negatives of each frequent score, places -1 left out; a group's neighbouring rows share its counts."""
        counts, label = counts_of(x), x.column("label").to_numpy()
        shared = np.cumsum(np.concatenate([[False], counts.hashes[1:] != counts.hashes[:-1]])) if by_hash else np.arange(len(label))
        first = np.flatnonzero(np.concatenate([[True], shared[1:] != shared[:-1]]))
        if by_hash:
            own = np.isin(counts.row, first)
            counts = _Counts(replicates, seed, None, counts.hashes[first], shared[counts.row[own]], counts.code[own])
        c = counts.of(0, len(first))
        for s, place in enumerate(places):
            order = np.lexsort((label, place))
            for low, high in _runs(place[order], label[order]):
                at, y = int(place[order[low]]), label[order[low]]
                if at >= 0:
                    both = sums.setdefault((s, at), np.zeros((2, replicates)))
                    own = c[shared[order[low:high]]]
                    both += np.array([[y], [1 - y]]) * own.sum(0, dtype=np.uint16 if own.dtype == np.uint8 and len(own) < 257 else np.uint32)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], np.ndarray] = {}
        for x in _gathered(batches, PACKED_ROWS):
            label, hot, made = x.column("label").to_numpy(), [], []
            counts = counts_of(x)
            small = label.astype(np.uint8) if np.isin(label, (0, 1)).all() else label
            kind = COUNT if by_hash or counts.weights.max() > 255 else np.uint8
            for s in range(len(scores)):
                column = x.column(f"p{s}").combine_chunks()
                p = column.fill_null(0).to_numpy(zero_copy_only=False)
                p, known = np.where(np.isnan(p), np.inf, p), column.is_valid().to_numpy(zero_copy_only=False)
                r = np.searchsorted(cuts[s], p, "right")
                frequent = np.zeros(len(p), bool)
                if len(cuts[s]):
                    frequent = known & (r > 0) & often[s][r - 1] & (cuts[s][r - 1] == p)
                hot.append(np.where(frequent, 2 * r, -1))
                order = np.flatnonzero(known & ~frequent)
                order = order[np.argsort(r[order].astype(np.uint16), kind="stable")]
                if not len(order):
                    continue
                own = counts.ordered(np.concatenate([order, np.flatnonzero(~known | frequent)]))
                for low, high in _runs(r[order]):
                    at, fixes = order[low:high], np.searchsorted(own.row, [low, high]) if by_hash else []
                    travel = [own.hashes[low:high], (own.row[slice(*fixes)] - low).astype(np.uint32), own.code[slice(*fixes)].astype(np.int32)] if by_hash else [own.weights[low:high].astype(kind), b"", b""]
                    made.append((s, 2 * int(r[at[0]]) + 1, high - low, small[at].tobytes(), p[at].tobytes(), *map(bytes, travel), b"", b""))
            if any((h >= 0).any() for h in hot):
                size = max(1, SUMMED_CELLS // max(1, replicates))
                for at in range(0, x.num_rows, size):
                    summed(x.slice(at, size), [h[at : at + size] for h in hot], sums)
            yield pa.RecordBatch.from_arrays([pa.array([m[i] for m in made], t) for i, t in enumerate(types)], names=names)
        made = [(*at, 0, b"", b"", b"", b"", b"", *(v.tobytes() for v in both)) for at, both in sums.items()]
        yield pa.RecordBatch.from_arrays([pa.array([m[i] for m in made], t) for i, t in enumerate(types)], names=names)

    def read(x: pa.Table) -> tuple[np.ndarray, np.ndarray, _Counts]:
        """Score, label and counts of a range's rows, from the highest score down."""
        sizes = x.column("n").to_pylist()
        blobs = lambda c: x.column(c).to_pylist()
        joined = lambda c, kind: np.frombuffer(b"".join(blobs(c)), kind)
        p, labels = joined("p", np.float64), [np.frombuffer(b, np.uint8 if len(b) == k else np.float64) for b, k in zip(blobs("label"), sizes, strict=True)]
        if by_hash:
            starts = np.cumsum([0, *sizes[:-1]])
            row = np.concatenate([np.frombuffer(b, np.uint32).astype(np.int64) + k for b, k in zip(blobs("row"), starts, strict=True)])
            counts = _Counts(replicates, seed, None, joined("counts", np.uint64), row, joined("code", np.int32))
        else:
            counts = _Counts(replicates, seed, np.concatenate([np.frombuffer(b, np.uint8 if len(b) == k * replicates else COUNT).reshape(k, replicates) for b, k in zip(blobs("counts"), sizes, strict=True)]))
        order = np.argsort(-p, kind="stable")
        return p[order], np.concatenate(labels)[order], counts.ordered(order)

    def both(x: pa.Table) -> np.ndarray:
        return sum(np.stack([np.frombuffer(a), np.frombuffer(b)]) for a, b in zip(x.column("pos").to_pylist(), x.column("neg").to_pylist(), strict=True))

    def written(x: pa.Table, *arrays: np.ndarray) -> pa.Table:
        return pa.table({"score": x.column("score").slice(0, 1), "place": x.column("place").slice(0, 1), **{c: pa.array([v]) for c, v in zip(("pairs", "pos", "neg", "steps"), arrays, strict=True)}})

    def totals(x: pa.Table) -> pa.Table:
        if x.column("place")[0].as_py() % 2:
            _, label, counts = read(x)
            found = np.zeros((2, replicates))
            for at in range(0, len(label), STEP):
                y = label[at : at + STEP].astype(np.float64)
                found += np.stack([y, 1 - y]) @ counts.of(at, at + len(y)).astype(np.float64)
        else:
            found = both(x)
        return written(x, np.zeros(0), *found, np.zeros(0))

    def ranked(x: pa.Table) -> pa.Table:
        s, place = x.column("score")[0].as_py(), x.column("place")[0].as_py()
        if place % 2:
            return written(x, *(_by_columns(*read(x), shared.value[s, place]) if precise else [*_pairs_by_steps(*read(x)), np.zeros(replicates)]))
        pos, neg = both(x)
        tp, fp = shared.value[s, place] if precise else np.zeros((2, replicates))
        return written(x, pos * neg / 2, pos, neg, pos * (tp + pos) / np.maximum(tp + pos + fp + neg, 1))

    schema = "score int, place int, pairs array<double>, pos array<double>, neg array<double>, steps array<double>"
    parts = rows.join(weights, key).select("label", *[f"p{i}" for i in range(len(scores))], *carried).mapInArrow(packed, "score int, place int, n int, " + ", ".join(f"{c} binary" for c in names[3:]))
    path, shared = [], None
    if precise:
        parts, folder = kept(parts, "resampled")
        path.append(folder)
        freed(spark)
    grouped = parts.repartition(max(tasks, points), "score", "place").groupBy("score", "place")
    if precise:
        above, carry = {}, {}
        for r in sorted(grouped.applyInArrow(totals, schema).collect(), key=lambda r: -r["place"]):
            above[r["score"], r["place"]] = carry.get(r["score"], np.zeros((2, replicates)))
            carry[r["score"]] = above[r["score"], r["place"]] + np.array([r["pos"], r["neg"]])
        shared = spark.sparkContext.broadcast(above)
    each = grouped.applyInArrow(ranked, schema).select("score", "place", F.posexplode(F.arrays_zip("pairs", "pos", "neg", "steps")).alias("replicate", "v"))
    higher = F.coalesce(F.sum("v.pos").over(Window.partitionBy("score", "replicate").orderBy(F.desc("place")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    x = each.withColumn("above", higher).groupBy("replicate", "score").agg(F.sum(F.col("v.pairs") + F.col("v.neg") * F.col("above")).alias("pairs"), *[F.sum(f"v.{c}").alias(c) for c in ("pos", "neg", "steps")])
    values = {"roc_auc": F.try_divide(F.col("pairs"), F.col("pos") * F.col("neg")), "average_precision": F.try_divide(F.col("steps"), F.col("pos"))}
    name = F.element_at(F.array(*[F.lit(s) for s in scores]), F.col("score") + 1)
    # a row for each replicate and score
    out, _ = kept(x.where("pos * neg <> 0").select("replicate", name.alias("score"), *[values[m].alias(m) for m in metrics]), "replicates")
    removed(spark, *path)
    freed(spark)
    return out
