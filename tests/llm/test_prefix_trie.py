"""The trie of prefixes against dictionaries of tuples."""

import hashlib
import random
import zlib

import pandas as pd
from helpers import DATA, rows_of
from pyspark.sql import functions as F

from icuflow.llm import prefix_trie as pt


def brute(rows, head=lambda c: zlib.crc32(str(c).encode()) % 9):
    """rows: (conv_id, turn, role, text)."""
    own = {}
    for c, turn, role, text in sorted(rows, key=lambda r: (r[0] or 0, r[1] is not None, r[1] or 0, r[2] or "")):
        if c is not None:
            own.setdefault(c, []).append((role or "", text or ""))
    members = {}
    for c, turns in own.items():
        base = c - (c % 5 if c >= 0 else -(-c % 5))
        made = own.get(base, [])[: head(c)] + turns[head(c) :]
        for k in range(len(made) + 1):
            members.setdefault(tuple(made[:k]), []).append((c, k == len(made)))
    out = {}
    for n, m in members.items():
        ends = ",".join(map(str, sorted(c for c, e in m if e)))
        out[n] = {"conv_id": min(m)[0], "depth": len(n), "parent_conv_id": min(members[n[:-1]])[0] if n else None, "n_convs": len(m), "n_children": 0, "n_leaves": 0, "saved_tokens": (len(m) - 1) * len(n[-1][1].encode()) if n else 0, "ends_sha256": hashlib.sha256(ends.encode()).hexdigest()}
    for n in sorted(out, key=len, reverse=True):
        own_row = out[n]
        own_row["n_leaves"] = own_row["n_leaves"] or 1
        if n:
            above = out[n[:-1]]
            above["n_children"] += 1
            above["n_leaves"] += own_row["n_leaves"]
            above["saved_tokens"] += own_row["saved_tokens"]
    return pd.DataFrame(list(out.values()))


SCHEMA = "conv_id long, turn long, role string, text string"


def same(spark, rows, **settings):
    got = pt.prefix_trie(spark.createDataFrame(rows, SCHEMA).withColumn("depth", F.lit("x")).withColumn("place", F.lit(1)).repartition(3), **settings).toPandas()
    return rows_of(got) == rows_of(brute(rows))


def test_whole_table(spark):
    turns = spark.read.parquet(f"{DATA}/conversations.parquet")
    assert rows_of(pt.prefix_trie(turns).toPandas()) == rows_of(brute([tuple(r) for r in turns.select("conv_id", "turn", "role", "text").collect()]))


def test_nulls_repeats_and_negative_ids(spark):
    rng = random.Random(4)
    rows = [(c, k if k else None, rng.choice(["user", None]), rng.choice(["a", "é", "", None])) for c in [*range(-12, 30), 101, 103, 10**12 + 4] for k in range(rng.randint(1, 12))]
    assert same(spark, [*rows, (None, 1, "user", "x"), (None, None, None, None)])


def test_one_long_conversation_and_many_copies(spark, monkeypatch):
    monkeypatch.setattr(pt, "BLOCK", 16)
    rows = [(7, k, "user", f"t{k % 3}") for k in range(400)] + [(c, k, "user", f"t{k % 3}") for c in range(1000, 1200) for k in range(5)]
    assert same(spark, rows)


def test_lists_of_rulers_are_ranked_in_levels(spark, monkeypatch):
    monkeypatch.setattr(pt, "LAST", 20)
    monkeypatch.setattr(pt, "RULERS", 4)
    rng = random.Random(9)
    assert same(spark, [(c, k, "user", rng.choice("ab")) for c in range(60) for k in range(rng.randint(1, 9))])


def test_no_rows(spark):
    assert pt.prefix_trie(spark.createDataFrame([], SCHEMA)).collect() == []
