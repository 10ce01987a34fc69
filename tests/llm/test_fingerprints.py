"""Fingerprints against sets of paragraphs, and the sketch's own properties."""

import hashlib
import random
import re

import pytest
from helpers import DATA
from pyspark.sql import functions as F

from icuflow.llm import fingerprints as fp

PARAGRAPH = re.compile(r"[^.!?\n]{1,120}[.!?\n]*|[.!?\n]+")


def alike(a, b):
    a, b = (set(PARAGRAPH.findall(t)) for t in (a, b))
    size = lambda x: sum(map(len, x))
    return size(a & b) / size(a | b) if a | b else 1.0


def brute(rows):
    """rows: (doc_id, text), in any order."""
    rows = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, len(r[1]), r[1]))
    out = []
    for k, (i, t) in enumerate(rows):
        after, q = rows[(k + 1) % len(rows)][1], len(t) // 4
        edited = t[: len(t) - q] + after[:q]
        out.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), round(alike(t, edited), 9), round(alike(t, after), 9)))
    return sorted(out, key=str)


def reported(docs):
    return sorted(((r.doc_id, r.n_chars, r.edited_sha256, round(r.near_edited, 9), round(r.near_next, 9)) for r in fp.fingerprint_report(docs).collect()), key=str)


def test_whole_table(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    assert reported(docs) == brute([(r.doc_id, r.text) for r in docs.collect()])


def test_odd_rows(odd):
    assert reported(odd) == brute([(r.doc_id, r.text) for r in odd.collect()])


def test_no_rows(none):
    assert fp.fingerprint_report(none).collect() == []


@pytest.mark.parametrize("n", [1, 2])
def test_few_rows(spark, n):
    rows = [(k, f"One. Two {k}. Three.\n") for k in range(n)]
    assert reported(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)


def test_ids_far_apart_and_shared(spark):
    rng = random.Random(2)
    rows = [(rng.choice([-(1 << 62), -5, 0, 7, 7, 7, 8, 1 << 40, (1 << 62) + k]), f"Row {k}. " * rng.randint(0, 9)) for k in range(400)] + [(None, "x"), (None, None)]
    assert reported(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)) == brute(rows)


def test_equal_texts_and_only_those_have_equal_fingerprints(spark):
    made = fp.fingerprint_report(spark.read.parquet(f"{DATA}/documents.parquet")).select("doc_id", "fingerprint")
    rows = made.join(spark.read.parquet(f"{DATA}/documents.parquet"), "doc_id").agg(F.count_distinct("fingerprint"), F.count_distinct("text"), F.count_distinct("fingerprint", "text")).first()
    assert len(set(rows)) == 1


def test_small_differences_of_long_texts_need_no_retry(spark):
    """Two of 5,000 paragraphs differ: the first sketch, of 24 cells, gives both up."""
    a = "\n".join(f"paragraph {k}" for k in range(5000))
    b = a.replace("paragraph 77\n", "another\n")
    x = spark.createDataFrame([(a, b)], "a string, b string").select(F.expr(fp.digests("a")).alias("a"), F.expr(fp.digests("b")).alias("b"))
    left, right = (fp.cells(fp.hashed(c, 0)) for c in "ab")
    got = x.select(F.expr(fp.peeled(fp.subtracted(left, right), 0)).alias("r"), F.array_union(F.array_except("a", "b"), F.array_except("b", "a")).alias("wanted")).first()
    assert sorted(got.r.found) == sorted(got.wanted) and len(got.wanted) == 2
    assert all(c.n == 0 and c.key == 0 and c.chk == 0 for c in got.r.cells)


def test_very_long_text(spark):
    rows = [(1, "".join(f"Line {k} of it.\n" for k in range(20_000))), (2, "".join(f"Line {k} of it.\n" for k in range(500, 20_500)))]
    assert reported(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)


def test_no_python_in_the_plan(spark):
    plan = fp.fingerprint_report(spark.read.parquet(f"{DATA}/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
