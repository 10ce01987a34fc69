"""Token ids in Arrow IPC files of fixed-size lists.

Documents are dealt to files by ranges of ascending doc_id (null first; equal ids by a hash of the text). A file
holds the ids of its documents, one after another, in rows of LENGTH ids with a mask of the same length (false in the
last row's padding), both as fixed-size lists, so that a reader that maps the file into memory sees any row, or the
whole run of ids, as an array without copying. Ids take 16 bits where the vocabulary allows, else 32. A second file
beside it has, for each document, doc_id and the start and number of its ids in the file.

Each task attempt writes files of its own names in the shared folder, and the manifest, which is written once, names
the files of the attempts that counted; so a lost executor leaves nothing but unnamed files.

A word is encoded once a worker, which keeps what it has encoded from task to task, up to KNOWN_WORDS. Text is cut at spaces; the tokenizer drops white space, and neither its normalization
nor its splitting looks across a space, so the ids of a text are those of its parts in order. Parts of ASCII and
Latin letters, whose lower case and splitting are plain, are cut into the tokenizer's own words first. Null and empty texts
have no ids but the end id. Repeated rows are documents of their own.
"""

from __future__ import annotations

import os
import re
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from icuflow.llm.common import scratch_dir, settle

LENGTH = 2048
BATCH_ROWS = 256
KNOWN_WORDS = 1 << 19


def opened(uri: str) -> tuple[pa.fs.FileSystem, str]:
    """The file system and path of a URI or plain path."""
    if uri.startswith("file:"):
        uri = "/" + uri[5:].lstrip("/")
    return (pa.fs.LocalFileSystem(), uri) if uri.startswith("/") else pa.fs.FileSystem.from_uri(uri)


def sequence_schema(width: pa.DataType, length: int) -> pa.Schema:
    return pa.schema([("input_ids", pa.list_(width, length)), ("mask", pa.list_(pa.bool_(), length))])


class SequenceWriter:
    """Packs runs of ids into rows of equal length."""

    def __init__(self, fs: pa.fs.FileSystem, path: str, width: pa.DataType, length: int = LENGTH):
        self.schema, self.length, self.written = sequence_schema(width, length), length, 0
        self.dtype = width.to_pandas_dtype()
        self.sink = fs.open_output_stream(path)
        self.file = pa.ipc.new_file(self.sink, self.schema)
        self.waiting: list[np.ndarray] = []
        self.size = 0

    def add(self, ids: np.ndarray) -> int:
        """Appends a document's ids; returns where they start."""
        start = self.written + self.size
        self.waiting.append(ids)
        self.size += ids.size
        if self.size >= self.length * BATCH_ROWS:
            self._write(self.size // self.length)
        return start

    def _write(self, rows: int) -> None:
        flat = np.concatenate(self.waiting or [np.zeros(0, self.dtype)])
        n = min(rows * self.length, flat.size)
        ids, mask = np.zeros(rows * self.length, self.dtype), np.zeros(rows * self.length, bool)
        ids[:n], mask[:n] = flat[:n], True
        arrays = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.length) for x in (ids, mask)]
        self.file.write_batch(pa.RecordBatch.from_arrays(arrays, schema=self.schema))
        self.waiting, self.size, self.written = [flat[n:]], flat.size - n, self.written + n

    def close(self) -> int:
        if self.size:
            self._write(-(-self.size // self.length))
        self.file.close()
        self.sink.close()
        return self.written


class SequenceFile:
    """Random access to the rows and runs of a file; nothing is copied but runs that cross batches."""

    def __init__(self, uri: str):
        fs, path = opened(uri)
        self.source = pa.memory_map(path) if isinstance(fs, pa.fs.LocalFileSystem) else fs.open_input_file(path)
        self.file = pa.ipc.open_file(self.source)
        self.length = self.file.schema.field("input_ids").type.list_size
        self.starts, self.parts = [], []
        at = 0
        for k in range(self.file.num_record_batches):
            ids = self.file.get_batch(k).column("input_ids")
            self.starts.append(at)
            self.parts.append(ids.flatten().to_numpy(zero_copy_only=True))
            at += self.parts[-1].size

    def row(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids and the mask of the k-th sequence."""
        b = int(np.searchsorted(self.starts, k * self.length, side="right")) - 1
        r = k - self.starts[b] // self.length
        return self.parts[b][r * self.length : (r + 1) * self.length], self.file.get_batch(b).column("mask")[r].values.to_numpy(zero_copy_only=False)

    def run(self, start: int, n: int) -> np.ndarray:
        out, b = [], max(0, int(np.searchsorted(self.starts, start, side="right")) - 1)
        while n:
            part = self.parts[b][start - self.starts[b] :][:n]
            out.append(part)
            start, n, b = start + part.size, n - part.size, b + 1
        return out[0] if len(out) == 1 else np.concatenate(out or [np.zeros(0, np.uint16)])


# Characters that normalization leaves alone or just lower-cases, and the splitting rule among them.
_PLAIN = re.compile(r"[\x00-\x7f\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017f]*")
_SPLIT = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z\u00df-\u017f]+|[0-9]|[^a-z0-9\t-\r \u00df-\u017f]+")

# Byte-level vocabularies spell a byte by a character: printable Latin-1 characters by themselves, the others, in order, by 256 and on.
_PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTES = {b: chr(256 + k) for k, b in enumerate(sorted(set(range(256)) - set(_PRINTED)))}


class WordCache:
    """Ids of texts from the ids of their parts between spaces, each part encoded when it is first met."""

    def __init__(self, source: str, dtype):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model, self.dtype, self.known, self.words = Tokenizer.from_str(source), dtype, {}, {}
        self.code = array("H" if np.dtype(dtype).itemsize == 2 else "I").typecode
        self.model.no_padding()
        self.model.no_truncation()

    def encode(self, texts: list[str | None], end: int) -> Iterator[np.ndarray]:
        for words in (self.known, self.words):
            if len(words) > KNOWN_WORDS:
                words.clear()
        split = [t.split(" ") if t else [] for t in texts]
        fresh = [w for w in dict.fromkeys(w for words in split for w in words) if w not in self.known]
        cut = {w: _SPLIT.findall(w.lower()) if _PLAIN.fullmatch(w) and "<|" not in w else None for w in fresh}
        model, words = self.model.model, self.words
        for w in dict.fromkeys(w for own in cut.values() if own for w in own):
            if w not in words:
                # the model itself takes a word that is lower-cased and cut already, spelled in its characters for bytes
                spelled = w if w.isascii() and w.isalnum() else w.encode().decode("latin-1").translate(_BYTES)
                words[w] = array(self.code, [t.id for t in model.tokenize(spelled)]).tobytes()
        odd = [w for w, own in cut.items() if own is None]
        for at in range(0, len(odd), 10_000):
            got = self.model.encode_batch_fast(odd[at : at + 10_000], add_special_tokens=False)
            self.known.update((w, array(self.code, e.ids).tobytes()) for w, e in zip(odd[at : at + 10_000], got, strict=True))
        find = self.words.__getitem__
        self.known.update((w, find(own[0]) if len(own) == 1 else b"".join(map(find, own))) for w, own in cut.items() if own is not None)
        last = np.array([end], self.dtype).tobytes()
        for words in split:
            yield np.frombuffer(b"".join([*map(self.known.__getitem__, words), last]), self.dtype)


_KEPT: dict[tuple[str, str], WordCache] = {}


def worker_cache(source: str, dtype) -> WordCache:
    """This worker's cache for a vocabulary; tasks that follow find its words. One vocabulary at a time."""
    key = (source, np.dtype(dtype).str)
    if key not in _KEPT:
        _KEPT.clear()
        _KEPT[key] = WordCache(source, dtype)
    return _KEPT[key]


def _slices(b: pa.RecordBatch, chars: int = 2 << 20) -> Iterator[tuple[list, list[str | None]]]:
    start, size = 0, 0
    texts = b.column("text")
    for k in range(b.num_rows):
        size += len(texts[k].as_buffer()) if texts[k].is_valid else 0
        if size >= chars or k + 1 == b.num_rows:
            yield b.column("doc_id").slice(start, k + 1 - start), texts.slice(start, k + 1 - start).to_pylist()
            start, size = k + 1, 0


def write_files(docs: DataFrame, vocabulary: str, end: int, length: int = LENGTH, files: int | None = None) -> DataFrame:
    """Writes the ids of all texts; returns the manifest: file, ids, index (paths), n_docs, n_tokens and base (ids in all files before)."""
    spark = docs.sparkSession
    with open(vocabulary, encoding="utf-8") as f:
        source = f.read()
    folder = f"{scratch_dir(spark)}/tokens-{uuid.uuid4().hex}"
    shared, narrow = spark.sparkContext.broadcast(source), max(end, _largest_id(source)) < 65536
    files = files or int(spark.conf.get("spark.sql.shuffle.partitions"))
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    ordered = docs.withColumn("tie", F.xxhash64("text")).repartitionByRange(files, "doc_id", "tie").sortWithinPartitions("doc_id", "tie")

    def write(batches):
        part, own = TaskContext.get().partitionId(), uuid.uuid4().hex
        fs, path = opened(folder)
        fs.create_dir(path, recursive=True)
        width = pa.uint16() if narrow else pa.uint32()
        cache = worker_cache(shared.value, width.to_pandas_dtype())
        names = [f"part-{part:06d}-{own}.{kind}.arrow" for kind in ("ids", "index")]
        writer, index, sink, n = SequenceWriter(fs, f"{path}/{names[0]}", width, length), None, None, 0
        for b in batches:
            for keys, texts in _slices(b):
                runs = [(writer.add(ids), ids.size) for ids in cache.encode(texts, end)]
                out = pa.RecordBatch.from_arrays([keys, pa.array([r[0] for r in runs], pa.int64()), pa.array([r[1] for r in runs], pa.int64())], names=["doc_id", "start", "n_tokens"])
                if index is None:
                    sink = fs.open_output_stream(f"{path}/{names[1]}")
                    index = pa.ipc.new_file(sink, out.schema)
                index.write_batch(out)
                n += len(runs)
        total = writer.close()
        if index is not None:
            index.close()
            sink.close()
            yield pa.RecordBatch.from_pydict({"file": [part], "ids": [f"{folder}/{names[0]}"], "index": [f"{folder}/{names[1]}"], "n_docs": [n], "n_tokens": [total]}, schema=pa.schema([("file", pa.int32()), ("ids", pa.string()), ("index", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())]))

    made = settle(ordered.select("doc_id", "text").mapInArrow(write, "file int, ids string, index string, n_docs long, n_tokens long"), "manifest")
    # one row a file, so one task is enough for the running sum
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    return made.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0).cast("long")))


def _largest_id(source: str) -> int:
    import json

    spec = json.loads(source)
    return max([*spec["model"]["vocab"].values(), *(t["id"] for t in spec["added_tokens"])], default=0)


def read_documents(manifest: DataFrame, id_type: str) -> DataFrame:
    """doc_id, start (over all files) and ids (packed, little-endian unsigned 32-bit) of every document, from the files."""
    n = max(1, int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def read(batches):
        for b in batches:
            for entry in b.to_pylist():
                ids = SequenceFile(entry["ids"])
                fs, path = opened(entry["index"])
                with fs.open_input_file(path) as f:
                    index = pa.ipc.open_file(f)
                    for k in range(index.num_record_batches):
                        part = index.get_batch(k)
                        starts, counts = part.column("start").to_numpy(), part.column("n_tokens").to_numpy()
                        runs = [ids.run(s, c).astype("<u4").tobytes() for s, c in zip(starts.tolist(), counts.tolist(), strict=True)]
                        yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(starts + entry["base"], pa.int64()), pa.array(runs, pa.binary())], names=["doc_id", "start", "ids"])

    return manifest.select("file", "ids", "index", "base").repartition(n, "file").mapInArrow(read, f"doc_id {id_type}, start long, ids binary")


def token_file_report(docs: DataFrame, vocabulary: str, end: int = 1, **shape: int) -> DataFrame:
    """The columns of the contract, from the files read back."""
    manifest = write_files(docs, vocabulary, end, **shape)
    read = read_documents(manifest, docs.schema["doc_id"].dataType.simpleString())
    return read.select("doc_id", "start", F.expr("octet_length(ids) div 4").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


def crc32_of(ids: list[int]) -> int:
    return zlib.crc32(np.array(ids, "<u4").tobytes())
