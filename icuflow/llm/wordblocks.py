"""Blocks of documents with numbered words, and the way of a word's values back to the blocks that have it.

A block is a run of a task's texts of about so many characters. Its distinct words are numbered in order of appearance
and a text becomes a row of numbers. Each block sends its distinct words, dealt to buckets by a hash of the word, once
to whatever finds a value for them; a frequent word makes one entry a block, so no bucket grows with its frequency.
Entries are packed: one row of a table holds all words that a block has in a bucket.

blocked() gives both in one table, written once, so that numbers and words always fit together, and bucketed by block,
so that texts aren't shuffled to meet their words' values:

* rows of texts: block, keys (doc_ids), numbers and lengths (packed), for up to about CHUNK_WORDS words; bucket is null.
* rows of words: block, bucket, numbers (packed, ascending), words (packed), and counts (packed) in the block.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from icuflow.llm.common import discard, give_back, scratch_dir

BLOCK_CHARS = 32 << 20
BUCKET_CHARS = 32 << 20
CHUNK_WORDS = 1 << 17
RUN_BYTES = 4 << 20


def pack(numbers: np.ndarray) -> bytes:
    """Numbers below 2^32, compressed by planes of equal bytes; planes of zeros at the top take no place."""
    planes = np.ascontiguousarray(numbers, "<u4").view(np.uint8).reshape(-1, 4).T
    used = int(np.max(np.nonzero(planes.any(axis=1))[0], initial=-1)) + 1
    return struct.pack("<IB", planes.shape[1], used) + zstandard.ZstdCompressor(level=1).compress(planes[:used].tobytes())


def unpack(data: bytes) -> np.ndarray:
    n, used = struct.unpack_from("<IB", data)
    out = np.zeros((n, 4), np.uint8)
    if used:
        out[:, :used] = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[5:]), np.uint8).reshape(used, n).T
    return out.view("<u4").reshape(-1)


def pack_words(words: list[str]) -> bytes:
    lengths = pack(np.fromiter(map(len, words), np.uint32, len(words)))
    return struct.pack("<I", len(lengths)) + lengths + zstandard.ZstdCompressor(level=1).compress("".join(words).encode())


def unpack_words(data: bytes) -> list[str]:
    (n,) = struct.unpack_from("<I", data)
    ends = np.cumsum(unpack(data[4 : 4 + n]), dtype=np.int64).tolist()
    text = zstandard.ZstdDecompressor().decompress(data[4 + n :]).decode()
    return [text[a:b] for a, b in zip([0, *ends], ends, strict=False)]


release = give_back  # after each block, as workers live on


class Numbering(dict):
    """Words to numbers in order of appearance. words_of cuts a text; spelled gives each word's text."""

    def __init__(self, words_of: Callable[[str], list], spelled: Callable[[object], str] | None = None):
        super().__init__()
        self.words_of, self.spelled = words_of, spelled

    def __missing__(self, word):
        n = self[word] = len(self)
        return n

    def row(self, text: str | None) -> np.ndarray:
        words = self.words_of(text) if text else ()
        return np.fromiter(map(self.__getitem__, words), np.uint32, len(words))

    def texts(self) -> list[str]:
        return list(map(self.spelled, self)) if self.spelled else list(self)


def runs(texts: pa.Array, size: int = RUN_BYTES) -> Iterator[tuple[int, list[str | None]]]:
    """Runs of texts of about size bytes, so that what is made of a run stays small."""
    start, at = 0, 0
    lengths = pc.fill_null(pc.binary_length(texts), 0).to_pylist()
    for k, n in enumerate(lengths):
        at += n
        if at >= size or k + 1 == len(lengths):
            yield start, texts.slice(start, k + 1 - start).to_pylist()
            start, at = k + 1, 0


def _parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


_NAMES = ["block", "bucket", "keys", "numbers", "lengths", "words", "counts"]


def blocked(docs: DataFrame, numbering: Callable[[], Numbering], buckets: int, block_chars: int = BLOCK_CHARS, name: str = "blocks") -> DataFrame:
    """docs: doc_id, text. Settled; see above."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def made(block: int, numbered: Numbering, texts: list) -> Iterator[pa.RecordBatch]:
        def batch(n: int, **columns) -> pa.RecordBatch:
            none = {"block": pa.int64(), "bucket": pa.int32(), "keys": pa.list_(texts[0][0].type)} | dict.fromkeys(_NAMES[3:], pa.binary())
            return pa.RecordBatch.from_arrays([columns.get(c) if c in columns else pa.nulls(n, none[c]) for c in _NAMES], names=_NAMES)

        counts = np.zeros(len(numbered), np.int64)
        for keys, rows in texts:
            flat = np.concatenate(rows)
            counts += np.bincount(flat, minlength=counts.size)
            yield batch(1, block=pa.array([block], pa.int64()), keys=pa.ListArray.from_arrays(pa.array([0, len(keys)], pa.int32()), keys), numbers=pa.array([pack(flat)], pa.binary()), lengths=pa.array([pack(np.fromiter(map(len, rows), np.uint32, len(rows)))], pa.binary()))
        words = numbered.texts()
        own = np.fromiter((xxhash.xxh3_64_intdigest(w.encode()) % buckets for w in words), np.int64, len(words))
        order = np.argsort(own, kind="stable")
        cuts = np.searchsorted(own[order], np.arange(buckets + 1)).tolist()
        for at in range(0, buckets, 256):
            full = [(b, order[cuts[b] : cuts[b + 1]]) for b in range(at, min(at + 256, buckets)) if cuts[b] < cuts[b + 1]]
            if full:
                packed = [[pack(np.diff(numbers, prepend=0)) for _, numbers in full], [pack_words([words[k] for k in numbers.tolist()]) for _, numbers in full], [pack(counts[numbers]) for _, numbers in full]]
                yield batch(len(full), block=pa.array([block] * len(full), pa.int64()), bucket=pa.array([b for b, _ in full], pa.int32()), **{c: pa.array(x, pa.binary()) for c, x in zip(("numbers", "words", "counts"), packed, strict=True)})

    def blocks(batches):
        block, chars, numbered, texts = TaskContext.get().partitionId() << 32, 0, numbering(), []
        for b in batches:
            for start, part in runs(b.column("text")):
                first = 0
                rows, size = [], 0
                for k, t in enumerate(part):
                    rows.append(numbered.row(t))
                    size, chars = size + len(rows[-1]), chars + len(t or "")
                    if size >= CHUNK_WORDS or chars >= block_chars or k + 1 == len(part):
                        texts.append((b.column("doc_id").slice(start + first, k + 1 - first), rows))
                        first, rows, size = k + 1, [], 0
                    if chars >= block_chars:
                        yield from made(block, numbered, texts)
                        block, chars, numbered, texts = block + 1, 0, numbering(), []
                        release()
        if texts:
            yield from made(block, numbered, texts)
        del numbered, texts
        release()

    return kept_by_block(docs.mapInArrow(blocks, f"block long, bucket int, keys array<{kind}>, numbers binary, lengths binary, words binary, counts binary"), name)


def kept_by_block(table: DataFrame, name: str) -> DataFrame:
    """table written once to the shared folder, bucketed by block."""
    spark, called = table.sparkSession, f"{name}_{uuid.uuid4().hex}"
    path = f"{scratch_dir(spark)}/{called}"
    table.write.format("parquet").bucketBy(_parts(spark), "block").option("path", path).saveAsTable(called)
    out = spark.table(called)
    out.settled_at, out.called = path, called
    return out


def dropped(*kept: DataFrame) -> None:
    """Forget tables of kept_by_block() that nothing reads any more, and delete their files."""
    for table in kept:
        table.sparkSession.sql(f"DROP TABLE IF EXISTS {table.called}")
        discard(table)


def ascending(packed: bytes) -> np.ndarray:
    """The numbers of a row of words."""
    return np.cumsum(unpack(packed), dtype=np.int64)


def buckets_for(docs: DataFrame, chars: int) -> int:
    """So many that one bucket's distinct words fit into a task's memory, and that partitions get about as much each."""
    return max(4 * _parts(docs.sparkSession), -(-chars // BUCKET_CHARS))


def by_bucket(made: DataFrame, *columns: str) -> DataFrame:
    """The rows of words, those of a bucket together."""
    return made.where("bucket is not null").select("block", "bucket", *columns).repartition(_parts(made.sparkSession), "bucket").sortWithinPartitions("bucket", "block")


def by_block(made: DataFrame, values: DataFrame, function: Callable[[int, list[tuple], list[tuple]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """function(block, texts, values) of each block: texts are (keys, numbers, lengths), values the columns of values (block, numbers and further binary columns) without block."""
    columns = [c for c in values.columns if c != "block"]

    def joined(left: pa.Table, right: pa.Table) -> pa.Table:
        texts = [*zip(*(left.column(c) for c in ("keys", "numbers", "lengths")), strict=True)]
        texts = [(k.values, n.as_py(), m.as_py()) for k, n, m in texts]
        block = next((t.column("block")[0].as_py() for t in (left, right) if t.num_rows))
        return pa.Table.from_batches(function(block, texts, [*zip(*(right.column(c).to_pylist() for c in columns), strict=True)]))

    texts = made.where("bucket is null").select("block", "keys", "numbers", "lengths")
    return texts.groupBy("block").cogroup(values.groupBy("block")).applyInArrow(joined, schema)


def slices(texts: list[tuple], words: int) -> Iterator[tuple[pa.Array, list[np.ndarray]]]:
    """Keys and rows of numbers, about words words at a time."""
    for keys, numbers, lengths in texts:
        flat, ends = unpack(numbers), np.cumsum(unpack(lengths), dtype=np.int64)
        start, done = 0, 0  # the first text, and word, not given out yet
        while start < ends.size:
            stop = max(start + 1, int(np.searchsorted(ends, done + words, side="right")))
            yield keys.slice(start, stop - start), np.split(flat[done : ends[stop - 1]], ends[start : stop - 1] - done)
            start, done = stop, int(ends[stop - 1])
