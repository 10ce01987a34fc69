"""The trie of conversations' prefixes, its subtrees summed by the Euler-tour technique.

1. Turns are numbered by their place in one global order (a range sort that splits a long conversation), and dealt to the
   conversations that begin with them.
2. A prefix is named by 128 bits: the exclusive or of the hashes of its turns, each with its place. It is run up inside
   blocks of BLOCK turns and over the blocks' totals, so that no conversation is one group.
3. Nodes are the distinct prefixes, numbered by (parent, smallest member), so that siblings are neighbours.
4. Tour: node v has the arcs 2v (enter) and 2v + 1 (exit); the successor of each follows from its first child, its next
   sibling and its parent.
5. List ranking: one arc in RULERS, by hash, is a ruler. Every arc jumps, doubling its stride, to the next ruler, with the
   sums of leaves and savings on the way; the rulers are a list of their own, RULERS times shorter, which is ranked in
   the same way until at most LAST are left; these, a bounded list, are summed in the driver.
6. A subtree's sums are the differences of the tour's sums at a node's two arcs.

Rows without conv_id belong to no conversation. Turns of a conversation that share a number (null is the lowest) are ordered
by role, then by a hash of the text; repeated rows are turns of their own. Texts count whole, and only their hashes and sizes are shuffled.
No rows give no nodes. Other columns aren't read. No group is collected: the ids that end at a node are packed where they
were sorted, and hashed as a stream.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from icuflow.llm.common import discard, settle

SHARED, HEADS = 5, 9  # conversations of a group begin alike in up to HEADS - 1 turns
BLOCK = 1024
RULERS, LAST = 32, 1 << 16
PACKED = 1 << 16


def numbered(df: DataFrame, *order: Column | str, name: str) -> DataFrame:
    """df in the order given, with place (from 0, without gaps); settled. The driver gets one count a partition."""
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    x = settle(df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id()), name)
    part = F.shiftright("place", 33).cast("int")
    sizes = {r[0]: r[1] for r in x.groupBy(part.alias("part")).count().collect()}
    starts = np.cumsum([0, *(sizes.get(k, 0) for k in range(max(sizes, default=0)))]).tolist()
    out = x.withColumn("place", F.element_at(F.lit(starts), part + 1).cast("long") + F.col("place").bitwiseAND((1 << 33) - 1))
    out.settled_at = x.settled_at
    return out


def rebuilt(turns: DataFrame, head: Column) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """Conversations (conv, n: turns after rebuilding), their turns (conv, pos, role and hashes), and what to discard afterwards."""
    text, role = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("text", "role"))
    x = turns.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv"), "turn", role.alias("role"), F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(1), text).alias("t2"), F.octet_length(text).cast("long").alias("size")
    )
    x = numbered(x, "conv", F.col("turn").asc_nulls_first(), "role", "t1", "t2", name="turns")
    convs = x.groupBy("conv").agg(F.min("place").alias("first"), F.count("*").alias("n")).withColumn("head", head).withColumn("base", F.expr(f"conv - conv % {SHARED}"))
    convs = settle(convs, "convs")
    followers = convs.groupBy("base").agg(F.collect_list(F.struct("conv", "head")).alias("followers"))  # 2 * SHARED - 1 at most
    lengths = convs.select(F.col("conv").alias("base"), F.col("n").alias("base_n"))
    convs_all = convs.join(lengths, "base", "left").withColumn("shared", F.least("head", F.coalesce("base_n", F.lit(0))))
    info = convs_all.join(followers.withColumnRenamed("base", "conv"), "conv", "left").select("conv", "first", "head", "shared", "followers")
    own = F.when(F.expr("pos > head"), F.array(F.struct(F.col("conv"), (F.col("pos") - F.col("head") + F.col("shared")).alias("pos"))))
    heads = F.expr("transform(filter(followers, f -> pos <= f.head), f -> struct(f.conv, pos))")
    none = F.expr("cast(array() as array<struct<conv:bigint,pos:bigint>>)")
    y = x.join(info, "conv").withColumn("pos", F.col("place") - F.col("first") + 1)
    y = y.select(F.explode(F.concat(F.coalesce(own, none), F.coalesce(heads, none))).alias("to"), "role", "t1", "t2", "size").select("to.*", "role", "t1", "t2", "size")
    totals = convs_all.select("conv", (F.col("shared") + F.greatest(F.lit(0), F.col("n") - F.col("head"))).alias("n"))
    return totals, y, [x, convs]


def prefixes(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """turns: conv, pos, role, t1, t2, size. Adds the prefix's name up to each turn (k1, k2) and up to the one before (p1, p2). Also the settled rows behind it."""
    block = F.floor((F.col("pos") - 1) / BLOCK)
    named = lambda seed: F.xxhash64(F.lit(seed), "pos", "role", "t1", "t2", "size")
    x = turns.select("conv", "pos", block.alias("block"), "size", named(3).alias("h1"), named(4).alias("h2"))
    upto = Window.partitionBy("conv", "block").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    x = settle(x.select("conv", "pos", "block", "size", "h1", "h2", F.bit_xor("h1").over(upto).alias("u1"), F.bit_xor("h2").over(upto).alias("u2")), "prefixes")
    earlier = Window.partitionBy("conv").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    long = x.where("block > 0").select("conv").distinct()
    blocks = x.join(long, "conv", "semi").groupBy("conv", "block").agg(F.bit_xor("h1").alias("h1"), F.bit_xor("h2").alias("h2"))
    carried = blocks.select("conv", "block", F.bit_xor("h1").over(earlier).alias("c1"), F.bit_xor("h2").over(earlier).alias("c2"))
    y = x.join(carried, ["conv", "block"], "left")
    k = [F.col(f"u{i}").bitwiseXOR(F.coalesce(f"c{i}", F.lit(0))) for i in (1, 2)]
    return y.select("conv", "pos", "size", k[0].alias("k1"), k[1].alias("k2"), k[0].bitwiseXOR(F.col("h1")).alias("p1"), k[1].bitwiseXOR(F.col("h2")).alias("p2")), x


def ends(rows: DataFrame) -> DataFrame:
    """rows: k1, k2, conv. The SHA-256 of each (k1, k2)'s ids, ascending and joined by commas."""

    def packed(batches):
        for b in batches:
            k1, k2, conv = (b.column(c).to_numpy(zero_copy_only=False) for c in ("k1", "k2", "conv"))
            cuts = np.flatnonzero((k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])) + 1
            starts = [s for a, e in zip([0, *cuts.tolist()], [*cuts.tolist(), conv.size], strict=True) for s in range(a, e, PACKED)]
            pieces = [conv[a:e].tobytes() for a, e in zip(starts, [*starts[1:], conv.size], strict=True)]
            at = np.array(starts, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(k1[at]), pa.array(k2[at]), pa.array(conv[at]), pa.array(pieces, pa.binary())], names=["k1", "k2", "first", "ids"])

    def digested(batches):
        key, state, comma = None, None, False
        for b in batches:
            out: list[tuple] = []
            for k1, k2, ids in zip(*(b.column(c).to_pylist() for c in ("k1", "k2", "ids")), strict=True):
                if key != (k1, k2):
                    if key is not None:
                        out.append((*key, state.hexdigest()))
                    key, state, comma = (k1, k2), hashlib.sha256(), False
                state.update((("," if comma else "") + ",".join(map(str, np.frombuffer(ids, np.int64).tolist()))).encode())
                comma = True
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], kind) for i, kind in enumerate((pa.int64(), pa.int64(), pa.string()))], names=["k1", "k2", "ends_sha256"])
        if key is not None:
            yield pa.RecordBatch.from_arrays([pa.array([v]) for v in (*key, state.hexdigest())], names=["k1", "k2", "ends_sha256"])

    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ("k1", "k2", "conv")
    x = rows.select(*order).repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(packed, "k1 long, k2 long, first long, ids binary")
    return x.repartition(parts, "k1", "k2").sortWithinPartitions("k1", "k2", "first").mapInArrow(digested, "k1 long, k2 long, ends_sha256 string")


def _is_ruler(arc: Column, level: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(level), arc), F.lit(RULERS)) == 0


def ranked(arcs: DataFrame, level: int = 0) -> DataFrame:
    """arcs: arc, next (null: the end), s0, s1, settled. Each arc's sums of s0 and s1 from itself to the end, settled."""
    spark = arcs.sparkSession
    ruled = F.col("next").isNull() | _is_ruler(F.col("next"), level)  # the end, too, is where a stride stops
    state = settle(arcs.select("arc", "next", "s0", "s1", ruled.alias("done")), "strides")
    while not state.where("NOT done").isEmpty():
        behind = state.where(~_is_ruler(F.col("arc"), level)).select(F.col("arc").alias("next"), F.col("next").alias("beyond"), F.col("s0").alias("z0"), F.col("s1").alias("z1"), F.col("done").alias("there"))
        further = state.where("NOT done").join(behind, "next").select("arc", F.col("beyond").alias("next"), (F.col("s0") + F.col("z0")).alias("s0"), (F.col("s1") + F.col("z1")).alias("s1"), F.col("there").alias("done"))
        before, state = state, settle(state.where("done").unionByName(further), "strides")
        discard(before)
    rulers = settle(state.where(_is_ruler(F.col("arc"), level)).drop("done"), "rulers")
    if rulers.count() > LAST:
        upto = ranked(rulers, level + 1)
        discard(rulers)
    else:
        upto = _summed_here(rulers)
    sums = upto.select(F.col("arc").alias("next"), F.col("s0").alias("z0"), F.col("s1").alias("z1"))
    out = settle(state.join(sums, "next", "left").select("arc", *((F.col(f"s{i}") + F.coalesce(f"z{i}", F.lit(0))).alias(f"s{i}") for i in (0, 1))), "ranks")
    discard(state, upto)
    return out


def _summed_here(rulers: DataFrame) -> DataFrame:
    """The same for at most LAST arcs, from the end of the list on, in the driver."""
    rows = rulers.collect()
    before = {r["next"]: r for r in rows}
    s0 = s1 = 0
    out, at = [], None
    while at in before:
        r = before[at]
        s0, s1, at = s0 + r["s0"], s1 + r["s1"], r["arc"]
        out.append((at, s0, s1))
    made = rulers.sparkSession.createDataFrame(out, "arc long, s0 long, s1 long")
    made.settled_at = rulers.settled_at
    return made


def prefix_trie(turns: DataFrame, head: Column | None = None) -> DataFrame:
    """The nodes of the trie. turns: conv_id, turn, role, text. head: how many turns of its group's first conversation (column conv) a conversation begins with."""
    spark = turns.sparkSession
    head = F.crc32(F.col("conv").cast("string").cast("binary")) % HEADS if head is None else head
    totals, rows, waste = rebuilt(turns, head)
    rows, kept = prefixes(rows)
    totals = settle(totals, "totals")
    rows = settle(rows, "named")
    discard(*waste, kept)
    no = F.lit(None).cast("long")
    root = totals.agg(F.lit(0).alias("depth"), F.lit(0).alias("size"), F.count("*").alias("n_convs"), F.min("conv").alias("conv")).where("n_convs > 0")
    root = root.select(F.lit(0).alias("k1"), F.lit(0).alias("k2"), no.alias("p1"), no.alias("p2"), "depth", "size", "n_convs", "conv")
    below = rows.groupBy("k1", "k2").agg(F.first("p1").alias("p1"), F.first("p2").alias("p2"), F.first("pos").alias("depth"), F.first("size").alias("size"), F.count("*").alias("n_convs"), F.min("conv").alias("conv"))
    longs = [F.col(c).cast("long").alias(c) for c in below.columns]
    nodes = numbered(root.select(*longs).unionByName(below.select(*longs)), F.col("p1").asc_nulls_first(), "p2", "conv", name="nodes")

    kids = nodes.where("p1 is not null").groupBy("p1", "p2").agg(F.min("place").alias("first"), F.max("place").alias("last"), F.count("*").alias("n_children"))
    own = nodes.join(kids.select(F.col("p1").alias("k1"), F.col("p2").alias("k2"), "first", "last", "n_children"), ["k1", "k2"], "left")
    own = settle(own.withColumn("n_children", F.coalesce("n_children", F.lit(0))), "tree")
    above = own.where("n_children > 0").select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("place").alias("parent"), F.col("conv").alias("parent_conv_id"), F.col("last").alias("last_sibling"))
    tree = settle(own.join(above, ["p1", "p2"], "left"), "tree")
    discard(nodes, own)

    enter = F.struct((F.col("place") * 2).alias("arc"), F.coalesce(F.col("first") * 2, F.col("place") * 2 + 1).alias("next"), F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long").alias("s0"), ((F.col("n_convs") - 1) * F.col("size")).alias("s1"))
    after = F.when(F.col("place") < F.col("last_sibling"), (F.col("place") + 1) * 2).otherwise(F.col("parent") * 2 + 1)
    leave = F.struct((F.col("place") * 2 + 1).alias("arc"), after.alias("next"), F.lit(0).cast("long").alias("s0"), F.lit(0).cast("long").alias("s1"))
    sums = ranked(tree.select(F.explode(F.array(enter, leave)).alias("a")).select("a.*"))
    sign = F.when(F.col("arc") % 2 == 0, 1).otherwise(-1)
    subtree = sums.groupBy(F.shiftright("arc", 1).alias("place")).agg(F.sum(F.col("s0") * sign).alias("n_leaves"), F.sum(F.col("s1") * sign).alias("saved_tokens"))

    ending = rows.join(totals.withColumnRenamed("n", "pos"), ["conv", "pos"], "semi").select("k1", "k2", "conv")
    ending = ending.unionByName(totals.where("n = 0").select(F.lit(0).cast("long").alias("k1"), F.lit(0).cast("long").alias("k2"), "conv"))
    nothing = hashlib.sha256().hexdigest()
    out = tree.join(subtree, "place").join(ends(ending), ["k1", "k2"], "left")
    return out.select(F.col("conv").alias("conv_id"), "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(nothing)).alias("ends_sha256"))


# CRC-32 of the id, a bit or a byte a step
ORACLE = """WITH RECURSIVE t AS (SELECT conv_id AS c, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos FROM conversations WHERE conv_id IS NOT NULL),
b AS (SELECT c, CAST(c AS VARCHAR) AS s, 0 AS step, 4294967295::BIGINT AS crc FROM (SELECT DISTINCT c FROM t)
  UNION ALL SELECT c, s, step + 1, CASE WHEN step % 9 = 0 THEN xor(crc, CAST(ascii(s[step // 9 + 1]) AS BIGINT)) WHEN crc & 1 = 1 THEN xor(crc >> 1, 3988292384::BIGINT) ELSE crc >> 1 END FROM b WHERE step < 9 * length(s)),
h AS (SELECT c, c - c % 5 AS base, xor(crc, 4294967295::BIGINT) % 9 AS h FROM b WHERE step = 9 * length(s)),
r AS (SELECT h.c, t.pos, role, text FROM h JOIN t ON t.c = h.base AND t.pos <= h.h
  UNION ALL SELECT h.c, t.pos, role, text FROM h JOIN t ON t.c = h.c AND t.pos > h.h),
q AS (SELECT c, row_number() OVER (PARTITION BY c ORDER BY pos) AS d, role, text FROM r),
p AS (SELECT c, d, strlen(text) AS size, md5(string_agg(md5(role) || md5(text), '') OVER (PARTITION BY c ORDER BY d)) AS k, d = count(*) OVER (PARTITION BY c) AS ending FROM q
  UNION ALL SELECT c, 0, 0, 'root', c NOT IN (SELECT c FROM q) FROM h),
n AS (SELECT k, d, min(c) AS conv, count(*) AS n_convs, max(size) AS size, sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (WHERE ending), '')) AS ends FROM p GROUP BY k, d),
f AS (SELECT n.*, a.conv AS parent, pk.k AS pk FROM n LEFT JOIN p pk ON pk.c = n.conv AND pk.d = n.d - 1 LEFT JOIN n a ON a.k = pk.k),
g AS (SELECT f.*, coalesce(x.kids, 0) AS kids FROM f LEFT JOIN (SELECT pk, count(*) AS kids FROM f WHERE pk IS NOT NULL GROUP BY pk) x ON x.pk = f.k),
s AS (SELECT p.k, sum(CASE WHEN g.kids = 0 THEN 1 ELSE 0 END) AS leaves, sum((g.n_convs - 1) * g.size) AS saved FROM g JOIN p ON p.c = g.conv AND p.d <= g.d GROUP BY p.k)
SELECT g.conv AS conv_id, g.d AS depth, g.parent AS parent_conv_id, g.n_convs, g.kids AS n_children, CAST(s.leaves AS BIGINT) AS n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, g.ends AS ends_sha256 FROM g JOIN s ON s.k = g.k"""
