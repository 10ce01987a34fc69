"""BPE encoding and decoding through a table of distinct words.

1. Split: each task cuts its texts before every space that has no white space on either side. The tokenizer's own
   splitting never joins characters over such a cut, so the ids of a text are the ids of its words in order. Texts
   become blocks with numbered words (wordblocks.py).
2. Encode: the distinct words of all blocks meet in buckets by hash, where each is encoded once, by the tokenizers
   library. The table of encoded words is never in one place.
3. Join: words' ids return to the blocks that have them, and take the words' places in each text, by number.
4. Decode: the ids of each distinct word are joined with the id-to-piece table of the vocabulary, whose size is fixed
   and whose key is dense, so that the join is a look-up by id; the words' bytes are put together in order. Ids and
   bytes of a block's words stand in one buffer each, not as objects.

No step holds more than a bucket's distinct words, or a block's, and a few texts. A text is never cut between blocks,
whatever its length. Null text counts as empty and has no ids. Rows are independent: repeated rows give repeated
results. Columns of docs other than doc_id and text aren't read, whatever their names; no rows give no rows. Strings of
the vocabulary's special tokens become those tokens, as the library does by default.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from icuflow.llm import wordblocks
from icuflow.llm.common import chars_in
from icuflow.llm.wordblocks import ascending, pack, unpack

OUT_WORDS = 1 << 16
_ROUGH, _CLEAN = re.compile(r" \s|\s "), re.compile(r"(?<=\S) (?=\S)")


def words_of(text: str | None) -> list[str]:
    """The words of a text; all but the first stand for themselves with a space before."""
    if not text:
        return []
    if text[0] == " " or text[-1] == " " or _ROUGH.search(text):
        return _CLEAN.split(text)
    return text.split(" ")


def tokenizer(source: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    found = Tokenizer.from_str(source)
    found.no_padding()
    found.no_truncation()
    return found


def encoded(model, words: list[str]) -> list[list[int]]:
    return [e.ids for e in model.encode_batch_fast(words, add_special_tokens=False)]


def piece_bytes(source: str) -> list[bytes]:
    """The bytes of each id. In byte-level vocabularies a character stands for a byte: printable Latin-1 characters for themselves, the others, in order, for 256 and on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    byte_of = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}
    spec = json.loads(source)
    by_id = {i: p for p, i in spec["model"]["vocab"].items()} | {t["id"]: t["content"] for t in spec["added_tokens"]}
    spell = lambda p: bytes(map(byte_of.__getitem__, p)) if all(c in byte_of for c in p) else p.encode()
    return [spell(by_id.get(i, "")) for i in range(max(by_id) + 1)]


def gathered(buffer: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The stretches of buffer that start at starts, one after another."""
    ends = np.cumsum(lengths, dtype=np.int64)
    return buffer[np.repeat(starts.astype(np.int64) - (ends - lengths), lengths) + np.arange(int(ends[-1]) if ends.size else 0)]


class Pieces:
    """The bytes of all ids in one buffer, by id."""

    def __init__(self, spelled: list[bytes]):
        self.buffer = np.frombuffer(b"".join(spelled), np.uint8)
        self.lengths = np.fromiter(map(len, spelled), np.uint32, len(spelled))
        self.starts = np.cumsum(self.lengths, dtype=np.int64) - self.lengths

    def of(self, ids: np.ndarray) -> np.ndarray:
        return gathered(self.buffer, self.starts[ids], self.lengths[ids])


def decoded(out: bytes) -> bytes:
    try:
        out.decode()
    except UnicodeDecodeError:
        out = out.decode("utf-8", "replace").encode()
    return out


def _numbering() -> wordblocks.Numbering:
    """First words of texts are 1-tuples; all others stand for themselves with a space before."""

    def marked(text: str) -> list:
        words = words_of(text)
        return [(words[0],), *words[1:]] if words else []

    return wordblocks.Numbering(marked, lambda w: " " + w if type(w) is str else w[0])


def word_ids(made: DataFrame, source: str) -> DataFrame:
    """block, numbers, counts, ids: for each row of words its numbers and, packed, the numbers of ids and the ids. A word is encoded once."""
    shared = made.sparkSession.sparkContext.broadcast(source)

    def encode(batches):
        model, known, bucket = tokenizer(shared.value), {}, None
        for b in batches:
            out: tuple[list, list] = ([], [])
            for own, packed in zip(b.column("bucket").to_pylist(), b.column("words").to_pylist(), strict=True):
                if own != bucket:
                    bucket, known = own, {}
                words = wordblocks.unpack_words(packed)
                fresh = [w for w in words if w not in known]
                known.update(zip(fresh, (np.array(x, np.uint32).tobytes() for x in encoded(model, fresh)), strict=True))
                ids = [known[w] for w in words]
                out[0].append(pack(np.fromiter(map(len, ids), np.uint32, len(ids)) >> 2))
                out[1].append(pack(np.frombuffer(b"".join(ids), np.uint32)))
            yield pa.RecordBatch.from_arrays([b.column("block"), b.column("numbers"), *(pa.array(x, pa.binary()) for x in out)], names=["block", "numbers", "counts", "ids"])

    return wordblocks.by_bucket(made, "numbers", "words").mapInArrow(encode, "block long, numbers binary, counts binary, ids binary")


class BlockWords:
    """The encoded words of a block by number: their ids and their bytes, each in one buffer, with starts and lengths."""

    def __init__(self, rows: list[tuple[bytes, bytes, bytes]], pieces: Pieces):
        numbers, counts, ids = ([f(r[k]) for r in rows] for k, f in enumerate((ascending, unpack, unpack)))
        joined = lambda parts, kind: np.concatenate([*parts, np.zeros(0, kind)]).astype(kind, copy=False)
        numbers, counts, self.ids = joined(numbers, np.int64), joined(counts, np.uint32), joined(ids, np.uint32)
        # a block's distinct words have fewer bytes than a string may have, so 32 bits are enough for places in them
        by_number = np.argsort(numbers)
        self.n_ids, self.id_starts = counts[by_number], (np.cumsum(counts, dtype=np.uint32) - counts)[by_number]
        upto = np.zeros(self.ids.size + 1, np.uint32)
        np.cumsum(pieces.lengths[self.ids], dtype=np.uint32, out=upto[1:])
        self.byte_starts = upto[self.id_starts]
        self.n_bytes = upto[self.id_starts + self.n_ids] - self.byte_starts
        self.bytes = np.concatenate([np.zeros(0, np.uint8), *(pieces.of(self.ids[k : k + OUT_WORDS]) for k in range(0, self.ids.size, OUT_WORDS))])

    def text(self, row: np.ndarray) -> tuple[bytes, bytes]:
        """The ids of the words in row, packed, and the bytes that they are decoded to."""
        ids = gathered(self.ids, self.id_starts[row], self.n_ids[row])
        return ids.astype("<u4").tobytes(), decoded(gathered(self.bytes, self.byte_starts[row], self.n_bytes[row]).tobytes())


def encode_decode(docs: DataFrame, vocabulary: str, block_chars: int = wordblocks.BLOCK_CHARS) -> DataFrame:
    """For each row of docs: doc_id, ids (packed, little-endian unsigned 32-bit) and the text decoded from them.

    vocabulary: path of a byte-level BPE file of the tokenizers library. It is read on the driver and sent along.
    """
    with open(vocabulary, encoding="utf-8") as f:
        source = f.read()
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    spelled = docs.sparkSession.sparkContext.broadcast(Pieces(piece_bytes(source)))
    made = wordblocks.blocked(docs, _numbering, wordblocks.buckets_for(docs, chars_in(docs)), block_chars)

    def assemble(_, texts, values):
        words = BlockWords(values, spelled.value)
        wordblocks.release()
        for keys, rows in wordblocks.slices(texts, OUT_WORDS):
            out = [words.text(row) for row in rows]
            yield pa.RecordBatch.from_arrays([keys, pa.array([t[0] for t in out], pa.binary()), pa.array([t[1] for t in out], pa.binary()).cast(pa.string())], names=["doc_id", "ids", "decoded"])

    return wordblocks.by_block(made, word_ids(made, source), assemble, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ids binary, decoded string")


def bpe_report(docs: DataFrame, vocabulary: str, **bounds: int) -> DataFrame:
    """The columns of the contract, derived from encode_decode()."""
    made = encode_decode(docs, vocabulary, **bounds)
    return made.select("doc_id", F.expr("octet_length(ids) div 4").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
