"""Aligned tokens against both libraries on whole texts, and divide and conquer against set intersection."""

import hashlib
import random
from collections import Counter, defaultdict
from itertools import accumulate

import pandas as pd
import public_tokenizers
import pytest
import sentencepiece
from helpers import DATA, rows_of
from pyspark.sql import functions as F

from icuflow.llm import alignment as al
from icuflow.llm.bpe import piece_bytes

A, B = (public_tokenizers.path(f) for f in ("byte_bpe_50k.json", "piece_bpe_32k.model"))


def test_cuts_are_the_shared_ends():
    rng = random.Random(3)
    for _ in range(3000):
        n = rng.randint(1, 40)
        a, b = (sorted({n, *rng.sample(range(1, n + 1), rng.randint(0, n))}) for _ in range(2))
        wanted = [(a.index(e) + 1, b.index(e) + 1) for e in sorted(set(a) & set(b))]
        assert al.shared_cuts(a, b) == wanted


def test_cuts_of_many_tokens():
    for a, b in ((range(1, 200_001), range(1, 200_001)), (range(2, 400_001, 2), [*range(1, 400_000, 2), 400_000])):
        cuts = al.shared_cuts(list(a), list(b))
        assert cuts[-1] == (len(a), len(b)) and len(cuts) == len(set(a) & set(b))


@pytest.fixture(scope="module")
def models():
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    a.no_truncation()
    a.no_padding()
    with open(A, encoding="utf-8") as f:
        return a, b, piece_bytes(f.read()), al.piece_model_bytes(b)


def brute(rows, models):
    a, b, bytes_a, bytes_b = models
    made, counts = [], Counter()
    for _, text in rows:
        one = None
        if text:
            ids = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
            spelled = [b"".join(map(x.__getitem__, i)) for x, i in zip((bytes_a, bytes_b), ids, strict=True)]
            if spelled == [(" " + text).encode()] * 2:
                ends = [list(accumulate(len(x[k]) for k in i)) for x, i in zip((bytes_a, bytes_b), ids, strict=True)]
                shared, groups, at = sorted(set(ends[0]) & set(ends[1])), [], (0, 0)
                for e in shared:
                    to = ends[0].index(e, at[0]) + 1, ends[1].index(e, at[1]) + 1
                    groups.append("|".join(",".join(map(str, i[s:t])) for i, s, t in zip(ids, at, to, strict=True)))
                    at = to
                links, i, j = [], 0, 0
                while i < len(ids[0]):
                    links.append((ids[0][i], ids[1][j]))
                    x, y = ends[0][i], ends[1][j]
                    i, j = i + (x <= y), j + (y <= x)
                counts.update(set(links))
                one = (len(ids[0]), len(ids[1]), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest())
        made.append(one)
    most = defaultdict(int)
    for (x, _), n in counts.items():
        most[x] = max(most[x], n)
    full = [(i, *o[:3], len(o[3]), sum(counts[k] == most[k[0]] for k in o[3]), sum(counts[k] for k in o[3]), o[4]) if o else (i, *[0] * 6, "") for (i, _), o in zip(rows, made, strict=True)]
    return pd.DataFrame(full, columns=["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])


def test_whole_table_in_small_blocks(spark, models):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    wanted = brute([(r.doc_id, r.text) for r in docs.collect()], models)
    for block in (30_000, 1 << 24):
        assert rows_of(al.alignment_report(docs, A, B, block_chars=block).toPandas()) == rows_of(wanted)


def test_odd_rows(spark, odd, models):
    more = ["a▁b", "▁", "  two  spaces ", "日本語 😀 é", "<|endoftext|> <s> <unk> </s>", "<0x41>", "\r\n\t", "a b", "x" * 5000]
    docs = odd.select("doc_id", "text", "n_words").unionByName(spark.createDataFrame([(100 + k, t, 1) for k, t in enumerate(more)], "doc_id long, text string, n_words int")).withColumn("n_a", F.lit("x"))
    got = al.alignment_report(docs, A, B, block_chars=10_000).toPandas()
    assert rows_of(got) == rows_of(brute([(r.doc_id, r.text) for r in docs.collect()], models))
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("blocks_")]


def test_no_rows(none):
    assert al.alignment_report(none, A, B).collect() == []
