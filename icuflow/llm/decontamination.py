"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

A window is a run of WINDOW consecutive words of a benchmark item; an item of fewer words, but not none, is one
window. Words are runs of ASCII letters and digits and of all characters beyond ASCII, with A-Z lower-cased. For each
window length there is one searcher: a shift table over blocks of two words says how far a position can be skipped,
the windows that end with a block share a bucket, and a direct comparison confirms an occurrence. Benchmark words are
numbered; a document word that no item has is 0 and always allows the longest skip.

The documents are never shuffled: each task searches its own rows. Windows go to the tasks in blocks of about
BLOCK_BYTES of distinct item text, one block at a time: it is collected, searched for in a pass that is written, and
let go before the next; hits are carried along as columns.

Null and empty texts have no words. Texts are read whole, whatever their length; other columns of docs aren't read,
whatever their names, and clean_rows() returns them all; no rows give no rows. Items with a null id or text, or without a word, have no windows. Repeated rows
and repeated items are searched like any other; an item counts once a document.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from icuflow.llm.common import settle, thrifty

WINDOW = 10
BLOCK_BYTES = 4 << 20
_FOLD = bytes(ord(chr(c).lower()) if c >= 128 or chr(c).isalnum() else 32 for c in range(128)) + bytes(range(128, 256))


def words_of(text: bytes) -> list[bytes]:
    """Of a text in UTF-8: bytes beyond ASCII belong to words, like the characters that they are part of."""
    return text.translate(_FOLD).split()


class WuManber:
    """Finds all windows of one length."""

    def __init__(self, length: int, windows: dict[tuple[int, ...], set[int]]):
        self.length, self.block = length, min(2, length)
        self.most = length - self.block + 1
        self.shift: dict[tuple[int, ...], int] = {}
        self.buckets: dict[tuple[int, ...], dict[int, list]] = defaultdict(lambda: defaultdict(list))
        for window, items in windows.items():
            for end in range(self.block, length + 1):
                key = window[end - self.block : end]
                self.shift[key] = min(self.shift.get(key, self.most), length - end)
            self.buckets[window[-self.block :]][window[0]].append((window, items))

    def find(self, words: list[int]) -> Iterator[tuple[int, set[int]]]:
        """The end and the items of each occurrence, ends ascending."""
        length, block, most = self.length, self.block, self.most
        shift, buckets, at, n = self.shift, self.buckets, length, len(words)
        while at <= n:
            key = tuple(words[at - block : at])
            if skip := shift.get(key, most):
                at += skip
                continue
            for window, items in buckets[key].get(words[at - length], ()):
                if tuple(words[at - length : at]) == window:
                    yield at, items
            at += 1


class Matcher:
    """The searchers of a block of items."""

    def __init__(self, items: list[tuple[int, bytes]], window: int = WINDOW):
        self.number: dict[bytes, int] = {}
        by_length: dict[int, dict[tuple[int, ...], set[int]]] = defaultdict(lambda: defaultdict(set))
        for item, text in items:
            words = [self.number.setdefault(w, len(self.number) + 1) for w in words_of(text)]
            for at in range(max(1, len(words) - window + 1) if words else 0):
                own = tuple(words[at : at + window])
                by_length[len(own)][own].add(item)
        self.searchers = [WuManber(length, windows) for length, windows in sorted(by_length.items())]

    def search(self, text: bytes) -> tuple[int, list[tuple[int, int]], set[int]]:
        """Number of words, the hit runs of words (start, end), and the items found."""
        words = words_of(text)
        numbers = [*map(self.number.get, words, [0] * len(words))]
        numbers = [x or 0 for x in numbers] if None in numbers else numbers
        spans, items = [], set()
        for searcher in self.searchers:
            for end, found in searcher.find(numbers):
                items |= found
                spans.append((end - searcher.length, end))
        return len(words), merged(spans), items


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


_HITS = "n_words long, hits array<struct<start:int,end:int>>, item_ids array<long>"
_RUNS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def matchers(benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> Iterator[tuple[bool, object]]:
    """Block by block, if it is the last one, and a broadcast of its items. The size is measured first; a block holds about block_bytes of text."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).dropna().distinct()
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-total // block_bytes))
    context = benchmark.sparkSession.sparkContext
    for k in range(n):
        yield k + 1 == n, context.broadcast([(r[0], r[1].encode()) for r in items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).collect()])


def searched(shared, window: int) -> Callable[[bytes | None], tuple]:
    matcher = Matcher(shared.value, window)
    return lambda text: matcher.search(text or b"")


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """For each row of docs: doc_id, n_words, hits (runs of hit words), item_ids (sorted items with an occurring window)."""
    empty = F.array().cast("array<struct<start:int,end:int>>"), F.array().cast("array<long>")
    out = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.lit(0).cast("long").alias("n_words"), empty[0].alias("hits"), empty[1].alias("item_ids"))
    for last, shared in matchers(benchmark, block_bytes):

        def search(batches, shared=shared):
            find = searched(shared, window)
            for b in batches:
                found = [find(t) for t in b.column("text").cast(pa.binary()).to_pylist()]
                runs = [merged([*((x["start"], x["end"]) for x in old), *new[1]]) for old, new in zip(b.column("hits").to_pylist(), found, strict=True)]
                items = [sorted({*old, *new[2]}) for old, new in zip(b.column("item_ids").to_pylist(), found, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id"), b.column("text"), pa.array([x[0] for x in found], pa.int64()), pa.array([[{"start": s, "end": e} for s, e in r] for r in runs], _RUNS), pa.array(items, pa.list_(pa.int64()))], names=["doc_id", "text", "n_words", "hits", "item_ids"]
                )

        out = out.mapInArrow(thrifty(search), out.schema)
        if not last:
            out = settle(out, "hits")
            shared.destroy()
    return out.drop("text")


def clean_rows(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of docs in which no window occurs, with all their columns."""
    at = docs.columns.index("text")
    for last, shared in matchers(benchmark, block_bytes):

        def keep(batches, shared=shared):
            find = searched(shared, window)
            for b in batches:
                yield b.filter(pa.array([not find(t)[2] for t in b.column(at).cast(pa.binary()).to_pylist()], pa.bool_()))

        docs = docs.mapInArrow(thrifty(keep), docs.schema)
        if not last:
            docs = settle(docs, "clean")
            shared.destroy()
    return docs


def digest(items: list[int]) -> str:
    return hashlib.sha256(",".join(sorted(map(str, items))).encode()).hexdigest()


def contamination_report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The columns of the contract, derived from contamination()."""
    found = contamination(docs, benchmark)
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"])
    ids = F.concat_ws(",", F.array_sort(F.transform("item_ids", lambda x: x.cast("string"))))
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("item_ids").cast("long").alias("n_items"), F.sha2(ids, 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS r,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w
  FROM documents),
b AS (
  SELECT item_id,
         regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w
  FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL),
bw AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i : i + 9], ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
dw AS (
  SELECT r, i, n, array_to_string(w[i : i + n - 1], ' ') AS g
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)),
hit AS (SELECT DISTINCT dw.r, dw.i, dw.n, bw.item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.g = bw.g),
pos AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM hit) GROUP BY r),
it AS (SELECT r, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids
       FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS s FROM hit) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (r) LEFT JOIN it USING (r)
"""
