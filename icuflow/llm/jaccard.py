"""Near-duplicate classes by an n-gram Jaccard join with rare-first prefix filtering.

Two texts link when the Jaccard similarity of their sets of word n-grams is at least PERCENT / 100. Sets are compared
as 64-bit hashes of n-grams; texts with equal sets (by a 128-bit hash) form one class, and only classes are joined.
Classes, not doc_ids, are the keys throughout: one id may hold several texts.

1. A first pass gives each row its set size, class and histogram, and adds up how often n-grams occur in a sketch of fixed size
   over all texts. The sketch orders the n-grams, rare ones first (ties by hash): any fixed order gives right results,
   this one keeps common passages out of prefixes.
2. Prefixes, n - ceil(t n) + 1 n-grams long, are shuffled by n-gram, with each n-gram's position. N-grams that the sketch finds very common are salted. Sorted within each partition, an
   n-gram that one class has alone is dropped; no n-gram's rows are ever held at once. Each row left tells how many
   n-grams before it are left too (no other can be shared, which tightens the positional filter), and the first of them.
3. Then in rounds: each n-gram names the classes that share most as its pivots (1, then 16, 256, ... a round), and every
   other class of the n-gram meets them, the first one where the n-gram's classes are ranked. A pair counts at the first n-gram that it shares. Pairs that pass the length and
   positional filters, and whose histograms allow enough common n-grams, are verified, each once: the sets of a pivot's partners travel to the pivot's set, a bounded
   number of n-grams to a task, where the suffix filter (the parts of both suffixes on either side of a probe) precedes
   the whole comparison. Linked classes are contracted (components.py); then pivots leave their n-grams, as do
   n-grams whose classes are all connected by now. So a group of copies costs about one test a class, not one a pair,
   and a pair is left untested only if its classes are connected already or a filter rules it out.

Sets are made again from the texts where they are needed; a bitmap of fixed size tells which texts those are.

Empty sets (no words, or null text) link with nothing. Rows with a null id are returned with a null component and
take no part. Repeated rows and ids are in one component when their texts are alike; rows of one id with unlike texts
each have their own. Texts are read whole, whatever their length; no rows give no rows. Further columns of docs aren't
read by near_duplicates and stay, whatever their names, in deduplicated_rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from icuflow.llm.common import Members, discard, settle, thrifty, unused
from icuflow.llm.components import connected

WORDS = 3
PERCENT = 90
SKETCH = 1 << 20
CHUNKS = 64
BINS = 64
HOT = 10_000
PART_GRAMS = 1 << 16
PIVOTS = 16
KNOWN = 4
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


class Shingler:
    """Sets of n-gram hashes, ascending. Each distinct word is hashed once."""

    def __init__(self, words: int = WORDS):
        self.words, self.known = words, {}

    def set_of(self, text: bytes | None) -> np.ndarray:
        words = text.lower().split() if text else []  # bytes: A-Z only, and the white space of ASCII
        if not words:
            return np.zeros(0, np.uint64)
        known = self.known
        if len(known) > 1 << 19:
            known.clear()
        digest = xxhash.xxh3_64_intdigest
        codes = np.array([known.get(w) or known.setdefault(w, digest(w)) for w in words], np.uint64)
        n = min(self.words, len(words))
        mixed = np.full(len(codes) - n + 1, n, np.uint64)
        for k in range(n):
            mixed = mixed * _A + codes[k : len(codes) - n + 1 + k]
            mixed ^= mixed >> np.uint64(29)
        mixed *= _B
        mixed ^= mixed >> np.uint64(32)
        mixed *= _C
        mixed ^= mixed >> np.uint64(29)
        return np.unique(mixed)


def class_of(grams: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(grams.tobytes())


def prefix_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def needed(n, m, percent: int):
    """The least intersection of linked sets of n and m elements."""
    return -(-percent * (n + m) // (100 + percent))


def _sets(batches, shingler: Shingler) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    for b in batches:
        for at in range(0, b.num_rows, 256):
            part = b.slice(at, 256)
            yield part, [shingler.set_of(t) for t in part.column("text").cast(pa.binary()).to_pylist()]


def surveyed(docs: DataFrame, words: int) -> DataFrame:
    """Rows of two kinds: doc_id, n, cls, bins of each row; and chunk, counts: each task's sketch of n-gram counts in pieces."""
    id_type = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {id_type}, n int, cls binary, bins binary, chunk int, counts binary"
    width = SKETCH // CHUNKS

    def survey(batches):
        shingler, total, waiting, kind = Shingler(words), np.zeros(SKETCH, np.int64), [], None
        for b, sets in _sets(batches, shingler):
            kind, none = b.schema.field("doc_id").type, pa.nulls
            waiting += sets
            if sum(map(len, waiting)) > SKETCH:
                total += np.bincount((np.concatenate(waiting) >> np.uint64(44)).astype(np.int64), minlength=SKETCH)
                waiting = []
            k = b.num_rows
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([len(s) for s in sets], pa.int32()), pa.array([class_of(s) if len(s) else None for s in sets], pa.binary()), pa.array([histogram(s) if len(s) else None for s in sets], pa.binary()), none(k, pa.int32()), none(k, pa.binary())], names=["doc_id", "n", "cls", "bins", "chunk", "counts"])
        if kind is not None:
            total += np.bincount((np.concatenate([*waiting, np.zeros(0, np.uint64)]) >> np.uint64(44)).astype(np.int64), minlength=SKETCH)
            pieces = np.minimum(total, 2**32 - 1).astype(np.uint32).reshape(CHUNKS, width)
            for c, piece in enumerate(pieces):
                if piece.any():
                    yield pa.RecordBatch.from_arrays([pa.nulls(1, kind), pa.nulls(1, pa.int32()), pa.nulls(1, pa.binary()), pa.nulls(1, pa.binary()), pa.array([c], pa.int32()), pa.array([piece.tobytes()], pa.binary())], names=["doc_id", "n", "cls", "bins", "chunk", "counts"])

    return docs.mapInArrow(thrifty(survey), schema)


def sketch_of(survey: DataFrame) -> np.ndarray:
    """The sum of the tasks' sketches, SKETCH numbers in all."""

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for c, counts in zip(b.column("chunk").to_pylist(), b.column("counts").to_pylist(), strict=True):
                sums[c] = sums.get(c, 0) + np.frombuffer(counts, np.uint32).astype(np.int64)
        for c, s in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([c], pa.int32()), pa.array([np.minimum(s, 2**32 - 1).astype(np.uint32).tobytes()], pa.binary())], names=["chunk", "counts"])

    rows = survey.where("chunk is not null").select("chunk", "counts").repartition(CHUNKS, "chunk").mapInArrow(thrifty(add), "chunk int, counts binary").collect()
    out = np.zeros((CHUNKS, SKETCH // CHUNKS), np.uint32)
    for r in rows:
        out[r["chunk"]] = np.frombuffer(r["counts"], np.uint32)
    return out.reshape(-1)


def histogram(grams: np.ndarray) -> bytes:
    """The unit, and how many n-grams fall in each bin, in units, rounded up to bytes."""
    counts = np.bincount((grams & np.uint64(BINS - 1)).astype(np.int64), minlength=BINS)
    unit = -(-int(counts.max()) // 255)
    return np.uint32(unit).tobytes() + (-(-counts // unit)).astype(np.uint8).tobytes()


def most_common(a: list[bytes], b: list[bytes]) -> np.ndarray:
    """The most n-grams that sets with these histograms can share."""
    read = lambda x: (np.frombuffer(b"".join(x), np.uint8).reshape(-1, 4 + BINS)[:, 4:].astype(np.int64)) * np.frombuffer(b"".join(h[:4] for h in x), np.uint32).astype(np.int64)[:, None]
    return np.minimum(read(a), read(b)).sum(axis=1)


def suffixes_allow(x: np.ndarray, y: np.ndarray, least: int, depth: int = 3) -> bool:
    """Whether two ascending sets can share least elements: a probe from the middle of the longer one cuts both in two, down to some depth."""

    def most(x: np.ndarray, y: np.ndarray, depth: int) -> int:
        if not depth or min(x.size, y.size) < 8:
            return min(x.size, y.size)
        probe = (x if x.size >= y.size else y)[max(x.size, y.size) // 2]
        i, j = (int(np.searchsorted(z, probe)) for z in (x, y))
        return most(x[:i], y[:j], depth - 1) + most(x[i:], y[j:], depth - 1)

    return most(x, y, depth) >= least


def prefixes(docs: DataFrame, sketch: np.ndarray, words: int, percent: int, hot: int = HOT) -> DataFrame:
    """gram, salts, cls, n, place: the prefix of each class, at least once. salts: into how many parts a common n-gram is dealt."""
    shared = docs.sparkSession.sparkContext.broadcast(np.minimum(sketch, (1 << 20) - 1).astype(np.uint32))
    # what every place of the sketch holds on average is noise, not a common n-gram
    hot = max(hot, 4 * int(sketch.mean()))

    def cut(batches):
        shingler, counts, seen = Shingler(words), shared.value, set()
        for _, sets in _sets(batches, shingler):
            grams, often, classes, numbers = [], [], [], []
            for s in sets:
                if not len(s) or (cls := class_of(s)) in seen:
                    continue
                if len(seen) < 1 << 20:
                    seen.add(cls)
                count = counts[(s >> np.uint64(44)).astype(np.int64)]
                rank = (count.astype(np.uint64) << np.uint64(44)) | (s >> np.uint64(20))
                p, order = prefix_length(len(s), percent), np.argsort(rank, kind="stable")
                grams.append(s[order[:p]])
                often.append(count[order[:p]])
                classes.append(np.full(p, np.frombuffer(cls, "V16")[0], "V16"))
                numbers.append(np.stack([np.full(p, len(s)), np.arange(p)]).astype(np.int32))
            if grams:
                data = np.concatenate(classes).tobytes()
                n, place = np.concatenate(numbers, axis=1)
                cls = pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), len(data) // 16, [None, pa.py_buffer(data)]).cast(pa.binary())
                salts = (np.concatenate(often) // np.uint32(hot) + 1).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(grams).view(np.int64)), pa.array(salts), cls, pa.array(n), pa.array(place)], names=["gram", "salts", "cls", "n", "place"])

    return docs.select("text").mapInArrow(thrifty(cut), "gram long, salts int, cls binary, n int, place int")


def shared_grams(rows: DataFrame) -> DataFrame:
    """rows, with salt, of n-grams that several classes have, each class once; all rows of salted n-grams."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def scan(batches):
        waiting, given, last = None, False, (None, None, None)  # the last batch's last row, if it was given out, and its key and class
        for b in batches:
            if not b.num_rows:
                continue
            gram, salt, many = (b.column(c).to_numpy() for c in ("gram", "salt", "salts"))
            cls = np.frombuffer(b"".join(b.column("cls").to_pylist()), np.uint64).reshape(-1, 2)
            same_run = np.r_[last[:2] == (gram[0], salt[0]), (gram[1:] == gram[:-1]) & (salt[1:] == salt[:-1])]
            again = same_run & np.r_[last[2] == cls[0].tobytes(), (cls[1:] == cls[:-1]).all(axis=1)]
            follows = same_run & ~again  # another class of the same n-gram
            run = np.cumsum(~same_run)
            out = ~again & ((many > 1) | (np.bincount(run[follows], minlength=run[-1] + 1)[run] > 0))
            if run[0] == 0 and given:  # the run goes on from the last batch, which had given it out
                out |= ~again & (run == 0)
            if run[0] == 0 and not given and (follows & (run == 0)).any():
                yield waiting
            if out.any():
                yield b.filter(pa.array(out))
            in_last = run == run[-1]
            given = bool((out & in_last).any()) or (given and run[-1] == 0)
            if run[-1]:
                waiting = b.slice(int(np.argmax(in_last)), 1)
            last = (gram[-1], salt[-1], cls[-1].tobytes())

    salted = rows.withColumn("salt", F.pmod(F.xxhash64("cls"), F.col("salts")).cast("int"))
    return salted.repartition(parts, "gram", "salt").sortWithinPartitions("gram", "salt", "cls").mapInArrow(thrifty(scan), salted.schema)


def placed(rows: DataFrame) -> DataFrame:
    """rows with before (how many n-grams of the class come earlier), earlier (the first KNOWN of them), first (the order of pivots) and label (the class itself)."""
    own = Window.partitionBy("cls")
    order, shares = own.orderBy("place"), F.least(F.count("*").over(own), F.lit(1 << 20))
    x = rows.withColumn("before", (F.row_number().over(order) - 1).cast("int"))
    x = x.withColumn("earlier", F.collect_list(F.when(F.col("before") < KNOWN, F.col("gram"))).over(order.rowsBetween(Window.unboundedPreceding, -1)))
    first = F.shiftleft((F.lit(1 << 20) - shares).cast("long"), 40) + F.xxhash64("cls").bitwiseAND((1 << 40) - 1)
    return x.withColumn("first", first).withColumn("label", F.col("cls"))


def _pass(x, p, percent: int) -> Column:
    """Whether a class may link with a pivot of its n-gram by the length and positional filters, and the n-gram is the first that they share. x, p: columns of their rows, by name."""
    least = F.ceil(percent * (p("n") + x("n")).cast("long") / (100 + percent))
    lengths = F.least(p("n"), x("n")) * F.lit(100).cast("long") >= F.greatest(p("n"), x("n")) * F.lit(percent).cast("long")
    positional = F.least(p("before"), x("before")) + F.least(p("n") - p("place"), x("n") - x("place")) >= least
    return lengths & positional & ~F.arrays_overlap(p("earlier"), x("earlier"))


def candidate_pairs(live: DataFrame, pivots: DataFrame, percent: int) -> DataFrame:
    """u, v, m, n: pairs of classes of different components, u a pivot and v a later class of one of its n-grams, that pass the length and positional filters; m and n are their set sizes.

    live, pivots: rows of placed()."""
    p = pivots.drop("salt").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).alias("p")
    later = (F.col("x.first") > F.col("p.first")) | ((F.col("x.first") == F.col("p.first")) & (F.col("x.cls") > F.col("p.cls")))
    met = live.alias("x").join(p, (F.col("x.gram") == F.col("p.gram")) & (F.col("x.salt") == F.col("p.salt")) & later & (F.col("x.label") != F.col("p.label")))
    passed = met.where(_pass(lambda c: F.col(f"x.{c}"), lambda c: F.col(f"p.{c}"), percent))
    return passed.select(F.col("p.cls").alias("u"), F.col("x.cls").alias("v"), F.col("p.n").alias("m"), F.col("x.n").alias("n")).distinct()


def ranked(rows: DataFrame, k: int, percent: int) -> DataFrame:
    """rows of placed() with rank (1 to k: a pivot of its n-gram) and, for n-grams that aren't salted, u and m: the n-gram's first pivot and its set size where the pair passes.

    So classes meet their first pivot where they are ranked, and pivots leave by their rank. A salted n-gram's pivots are the first of its parts' first k."""
    order = Window.partitionBy("gram").orderBy("first", "cls")
    pivot = F.first(F.struct("cls", "n", "place", "before", "earlier", "label")).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    plain = rows.where("salts = 1").withColumn("rank", F.row_number().over(order)).withColumn("pivot", pivot)
    meets = (F.col("rank") > 1) & (F.col("label") != F.col("pivot.label")) & _pass(F.col, lambda c: F.col(f"pivot.{c}"), percent)
    plain = plain.withColumn("u", F.when(meets, F.col("pivot.cls"))).withColumn("m", F.when(meets, F.col("pivot.n"))).drop("pivot")
    salted = rows.where("salts > 1")
    tops = salted.select("gram", "salt", "first", "cls").withColumn("rank", F.row_number().over(Window.partitionBy("gram", "salt").orderBy("first", "cls"))).where(F.col("rank") <= k)
    tops = tops.select("gram", "first", "cls").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("gram", "cls", "rank")
    salted = salted.join(tops, ["gram", "cls"], "left").withColumn("rank", F.coalesce("rank", F.lit(k + 1)))
    return plain.unionByName(salted.withColumn("u", F.lit(None).cast("binary")).withColumn("m", F.lit(None).cast("int")))


def met_pairs(rows: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs of candidate_pairs() of ranked() rows: those with the first pivots are at hand, those with others and of salted n-grams come by a join."""
    first = rows.where("u is not null").select("u", F.col("cls").alias("v"), "m", "n")
    pivots = rows.where((F.col("rank") <= k) & ((F.col("rank") > 1) | (F.col("salts") > 1)))
    return first.unionByName(candidate_pairs(rows if k > 1 else rows.where("salts > 1"), pivots, percent)).distinct()


def alike(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """pairs (settled) whose histograms allow a link."""
    bins = lambda c: classes.select(F.col("cls").alias(f"c{c}"), F.col("bins").alias(f"b{c}"))
    both = pairs.join(bins("u"), F.col("u") == F.col("cu")).join(bins("v"), F.col("v") == F.col("cv")).select("u", "v", "m", "n", "bu", "bv")

    def keep(batches):
        for b in batches:
            if b.num_rows:
                m, n = b.column("m").to_numpy().astype(np.int64), b.column("n").to_numpy().astype(np.int64)
                may = most_common(b.column("bu").to_pylist(), b.column("bv").to_pylist()) >= needed(m, n, percent)
                yield b.select(["u", "v", "n"]).filter(pa.array(may))

    return both.mapInArrow(thrifty(keep), "u binary, v binary, n int")


def sets_of(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """cls, grams of the texts of docs whose doc_id is in wanted (one column), at least once a class, and of a few others."""
    shared = docs.sparkSession.sparkContext.broadcast(Members(wanted))

    def make(batches):
        shingler, seen = Shingler(words), set()
        for b in batches:
            few = b.filter(pa.array(shared.value.has(b.column("key").to_numpy())))
            for _, sets in _sets([few], shingler):
                made = {}
                for s in sets:
                    if len(s) and (cls := class_of(s)) not in seen:
                        made[cls] = s.tobytes()
                        if len(seen) < 1 << 20:
                            seen.add(cls)
                if made:
                    yield pa.RecordBatch.from_arrays([pa.array(list(made), pa.binary()), pa.array(list(made.values()), pa.binary())], names=["cls", "grams"])

    return docs.select(F.xxhash64("doc_id").alias("key"), "text").mapInArrow(thrifty(make), "cls binary, grams binary")


def verified(pairs: DataFrame, classes: DataFrame, docs: DataFrame, words: int, percent: int, part_grams: int = PART_GRAMS) -> DataFrame:
    """u, v, linked of pairs (u, v, n; settled). A pivot's partners are dealt to parts of about part_grams n-grams, and its set goes to each of them."""
    hubs = settle(pairs.groupBy("u").agg(F.ceil(F.sum(F.col("n").cast("long")) / part_grams).cast("int").alias("parts")), "hubs")
    dealt = pairs.alias("p").join(hubs.alias("h"), F.col("p.u") == F.col("h.u")).select(F.col("p.u").alias("u"), F.pmod(F.xxhash64("v"), F.col("parts")).cast("int").alias("part"), F.col("v").alias("wanted"), F.lit(1).alias("turn"))
    own = hubs.select("u", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("u").alias("wanted"), F.lit(0).alias("turn"))
    needs = settle(own.unionByName(dealt), "needs")  # so that its size is known: while it is small, the sets travel once
    ids = pairs.select(F.col("v").alias("wanted")).unionByName(hubs.select(F.col("u").alias("wanted"))).distinct().join(classes, F.col("wanted") == F.col("cls")).select("doc_id").distinct()
    moved = needs.join(sets_of(docs, ids, words), F.col("wanted") == F.col("cls")).select("u", "part", "turn", "wanted", "grams")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def check(batches):
        key, own = None, None
        for b in batches:
            us, vs = b.column("u").to_pylist(), b.column("wanted").to_pylist()
            out: dict[tuple[bytes, bytes], bool] = {}
            for k, (part, turn) in enumerate(zip(b.column("part").to_pylist(), b.column("turn").to_pylist(), strict=True)):
                grams = np.frombuffer(b.column("grams")[k].as_buffer(), np.uint64)
                if not turn:
                    key, own = (us[k], part), grams.copy()
                elif (us[k], vs[k]) not in out:
                    if key != (us[k], part):
                        raise ValueError("the set of a pivot is missing")
                    least = needed(len(own), len(grams), percent)
                    linked = suffixes_allow(own, grams, least)
                    if linked:
                        at = np.minimum(np.searchsorted(own, grams), len(own) - 1)
                        linked = int((own[at] == grams).sum()) >= least
                    out[us[k], vs[k]] = linked
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([u for u, _ in out], pa.binary()), pa.array([v for _, v in out], pa.binary()), pa.array(list(out.values()), pa.bool_())], names=["u", "v", "linked"])

    done = settle(moved.repartition(parts, "u", "part").sortWithinPartitions("u", "part", "turn").mapInArrow(thrifty(check), "u binary, v binary, linked boolean"), "verdicts")
    discard(hubs, needs)
    return done


def linked_classes(live: DataFrame, classes: DataFrame, docs: DataFrame, words: int, percent: int, part_grams: int = PART_GRAMS) -> DataFrame | None:
    """node, component: the components of classes, settled; None without links. live: shared_grams()."""
    tested, found, k = [], None, 1
    rows = settle(placed(live), "live")
    while not rows.isEmpty():
        before, rows = rows, settle(ranked(rows, k, percent), "ranked")
        discard(before)
        pairs = met_pairs(rows, k, percent)
        for old in tested:
            pairs = pairs.join(old.where("not linked").select("u", "v"), ["u", "v"], "left_anti")
        met = settle(pairs, "met")
        pairs = settle(alike(met, classes, percent), "pairs")
        if not pairs.isEmpty():
            tested.append(verified(pairs, classes, docs, words, percent, part_grams))
            edges = tested[-1].where("linked").select("u", "v")
            before, found = found, connected(edges if found is None else edges.unionByName(found.select(F.col("node").alias("u"), F.col("component").alias("v"))))
            discard(*([before] if before is not None else []))

        def named(x: DataFrame, found=found) -> DataFrame:
            """x with labels of now."""
            return x.withColumn("label", F.col("cls")) if found is None else x.join(found, F.col("cls") == F.col("node"), "left").withColumn("label", F.coalesce("component", "cls")).drop("node", "component")

        # grams whose classes aren't all in one component
        left = rows.where(F.col("rank") > k)  # without pivots
        open_ = settle(named(left.select("gram", "cls")).groupBy("gram").agg(F.min("label").alias("a"), F.max("label").alias("b")).where("a <> b").select("gram"), "open")
        before, rows = rows, settle(named(left.drop("label", "rank", "u", "m").join(open_, "gram", "left_semi")), "live")
        discard(before, met, pairs, open_)
        k *= PIVOTS
    discard(rows, *tested)
    return found


def labelled(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, hot: int = HOT, part_grams: int = PART_GRAMS) -> tuple[DataFrame, DataFrame]:
    """Each row's doc_id, n and cls (null for an empty set or a null id); and of each class the label (a class of its component) and component_id."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    survey = settle(surveyed(docs, words), "survey")
    rows = survey.where("chunk is null").select("doc_id", "n", F.expr("if(doc_id is null, null, cls)").alias("cls"))
    classes = settle(survey.where("chunk is null and doc_id is not null and cls is not null").groupBy("cls").agg(F.min("doc_id").alias("doc_id"), F.first("bins").alias("bins")), "classes")
    with_id = docs.where("doc_id is not null")
    live = shared_grams(prefixes(with_id, sketch_of(survey), words, percent, hot))
    found = linked_classes(live, classes, with_id, words, percent, part_grams)
    if found is None:
        named = classes.select("cls", F.col("cls").alias("label"), F.col("doc_id").alias("component_id"))
    else:
        joined = settle(classes.join(found, F.col("cls") == F.col("node"), "left").select("cls", "doc_id", F.coalesce("component", "cls").alias("label")), "labels")
        least = settle(joined.groupBy("label").agg(F.min("doc_id").alias("component_id")), "least")
        named = joined.join(least, "label").select("cls", "label", "component_id")
    named = settle(named, "named")
    discard(classes, *([found, joined, least] if found is not None else []))
    return rows, named


def near_duplicates(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, **bounds: int) -> DataFrame:
    """For each row of docs: doc_id, n_shingles (set size) and component_id (the smallest doc_id that links reach)."""
    rows, named = labelled(docs, words, percent, **bounds)
    out = rows.join(named.select(F.col("cls").alias("c"), "component_id"), F.col("cls") == F.col("c"), "left")
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))


def deduplicated_rows(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, **bounds: int) -> DataFrame:
    """Of each component of docs one row with the smallest doc_id, with all its columns; rows with an empty set or a null id all stay.

    Where an id holds several texts, each text's own component decides."""
    rows, named = labelled(docs, words, percent, **bounds)
    key = unused(docs.columns, "kept_id")
    in_class = rows.where("cls is not null").groupBy("doc_id", "cls").agg(F.count("*").alias("copies"))
    best = in_class.join(named.select(F.col("cls").alias("c"), "label"), F.col("cls") == F.col("c")).groupBy("label").agg(F.min(F.struct("doc_id", "cls")).alias("row"))
    kept = settle(best.select("row.doc_id", "row.cls"), "kept")
    ids = rows.where("doc_id is not null").groupBy(F.col("doc_id").alias("d")).agg(F.count("*").alias("times"), F.max(F.col("n") == 0).alias("empty"))
    ids = settle(ids.join(kept.groupBy("doc_id").agg(F.count("*").alias("keeps")), F.col("d") == F.col("doc_id"), "left").select("d", "times", "empty", "keeps"), "ids")
    once = ids.where("times = 1 and (empty or keeps is not null)").select(F.col("d").alias(key))
    own = docs["doc_id"].cast("long")
    out = docs.join(once, own == once[key], "left_semi").unionByName(docs.where(own.isNull()))
    repeated = ids.where("times > 1 and (empty or keeps is not null)").select("d")
    if repeated.isEmpty():
        return out
    # ids that several rows have: those rows' classes decide
    column, shared, names = unused(docs.columns, "cls"), docs.sparkSession.sparkContext.broadcast(Members(repeated)), docs.columns
    hashed = unused([*docs.columns, column], "id_hash")

    def classed(batches):
        shingler = Shingler(words)
        for b in batches:
            few = b.filter(pa.array(shared.value.has(b.column(len(names)).to_numpy())))
            for at in range(0, few.num_rows, 256):
                part = few.slice(at, 256)
                sets = [shingler.set_of(t) for t in part.column(names.index("text")).cast(pa.string()).cast(pa.binary()).to_pylist()]
                cls = pa.array([class_of(s) if len(s) else None for s in sets], pa.binary())
                yield pa.RecordBatch.from_arrays([*part.columns[: len(names)], cls], names=[*names, column])

    found = docs.where(own.isNotNull()).withColumn(hashed, F.xxhash64(own)).mapInArrow(thrifty(classed), StructType([*docs.schema, StructField(column, BinaryType())]))
    found = settle(found.join(repeated.select(F.col("d").alias(key)), F.col("doc_id").cast("long") == F.col(key), "left_semi"), "repeated")
    wanted = kept.select(F.col("doc_id").alias(key), F.col("cls").alias(hashed))
    chosen = found.where(F.col(column).isNotNull()).join(wanted, (F.col("doc_id").cast("long") == F.col(key)) & (F.col(column) == F.col(hashed)), "left_semi").dropDuplicates(["doc_id", column])
    return out.unionByName(chosen.unionByName(found.where(F.col(column).isNull())).drop(column))


ORACLE = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
g AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) < 3 THEN array_to_string(w, ' ') ELSE w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] END AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT w.doc_id, count(g.s) AS n FROM (SELECT DISTINCT doc_id FROM w) w LEFT JOIN g USING (doc_id) GROUP BY 1),
l AS (
  SELECT a.doc_id AS u, b.doc_id AS v FROM g a JOIN g b ON a.s = b.s AND a.doc_id <> b.doc_id
  JOIN n x ON x.doc_id = a.doc_id JOIN n y ON y.doc_id = b.doc_id AND 10 * least(x.n, y.n) >= 9 * greatest(x.n, y.n)
  GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 90 * (x.n + y.n - count(*))),
r AS MATERIALIZED (SELECT * FROM l),
c AS (
  WITH RECURSIVE t(doc_id, c) AS (
    SELECT doc_id, doc_id FROM n
    UNION
    SELECT r.v, t.c FROM t JOIN r ON r.u = t.doc_id WHERE t.c < r.v)
  SELECT doc_id, min(c) AS component_id FROM t GROUP BY doc_id)
SELECT w.doc_id, CAST(n.n AS BIGINT) AS n_shingles, c.component_id FROM w JOIN n USING (doc_id) JOIN c USING (doc_id)
"""
