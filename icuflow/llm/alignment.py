"""Two tokenizers' tokens of the same texts, aligned, with corpus-wide counts of linked ids.

A is a byte-level BPE of the tokenizers library, B a BPE with byte fallback of sentencepiece. Texts are cut before clean
spaces (bpe.py); neither tokenizer joins characters over such a cut, so it ends a token of both, and whatever is known
of a word holds wherever it stands.

1. Blocks of documents with numbered words; distinct words meet in buckets by hash (wordblocks.py), and there each is
   encoded and aligned once.
2. Alignment, by divide and conquer: of an interval of tokens, an end of A near the middle is looked up among B's ends by
   bisection, then its neighbours outwards; the first that both have cuts the interval, and both halves go on. An
   interval without such an end is a group. (A word is the first cut; a long word without spaces is cut on in the same way.)
3. Links: a byte range between two neighbouring ends, of either tokenizer, lies in one token of each, so the ranges are
   the pairs that overlap.
4. Counts: a block counts in how many of its documents each pair of ids is linked, the counts are summed by pair, the
   highest of each A id is found, and both return to the blocks that have the pair, by joins. Sums of a document are the
   sums of its words.

A text that is null, empty, or that either tokenizer doesn't give back byte for byte (it holds U+2581, say) has no
tokens, groups or links, and counts nowhere. Repeated rows are documents of their own. Very long texts are never cut
between blocks. Special tokens' strings are plain text. Only doc_id and text are read; no rows give no rows.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Sequence
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from icuflow.llm import wordblocks
from icuflow.llm.bpe import gathered, piece_bytes, tokenizer, words_of
from icuflow.llm.common import chars_in, discard, settle
from icuflow.llm.wordblocks import ascending, pack, unpack

BLOCK_CHARS = 8 << 20
OUT_WORDS = 1 << 17
SLICE = 1 << 15


def shared_cuts(ends_a: Sequence[int], ends_b: Sequence[int]) -> list[tuple[int, int]]:
    """Where groups end, as numbers of tokens of A and of B. Both ascend and have the same last end."""
    out, todo = [], [(0, len(ends_a), 0, len(ends_b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        cut = None
        if a1 - a0 > 1 and b1 - b0 > 1:
            middle = (a0 + a1) // 2 - 1
            for far in range(max(middle - a0, a1 - 2 - middle) + 1):
                for at in (middle,) if not far else (middle + far, middle - far):
                    if a0 <= at < a1 - 1:
                        found = bisect_left(ends_b, ends_a[at], b0, b1 - 1)
                        if found < b1 - 1 and ends_b[found] == ends_a[at]:
                            cut = (at + 1, found + 1)
                            break
                if cut:
                    break
        if cut:
            todo += [(cut[0], a1, cut[1], b1), (a0, cut[0], b0, cut[1])]
        else:
            out.append((a1, b1))
    return out


def piece_model_bytes(model) -> list[bytes]:
    """The bytes of each id of a sentencepiece model."""
    out = []
    for k in range(model.get_piece_size()):
        p = model.id_to_piece(k)
        out.append(bytes([int(p[3:5], 16)]) if model.is_byte(k) else p.replace("▁", " ").encode())
    return out


class Aligner:
    """Aligns words. of() gives a word's ids and the groups' sizes, packed as unsigned 32-bit; all empty if the word has no tokens."""

    NONE = (b"", b"", b"", b"")

    def __init__(self, source_a: str, source_b: bytes):
        import sentencepiece

        self.a = tokenizer(source_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=source_b)
        self.bytes_a, self.bytes_b = piece_bytes(source_a), piece_model_bytes(self.b)
        self.len_a, self.len_b = list(map(len, self.bytes_a)), list(map(len, self.bytes_b))

    def of(self, words: list[str]) -> list[tuple[bytes, bytes, bytes, bytes]]:
        """words: with the space before each."""
        ids_a = [e.ids for e in self.a.encode_batch_fast(words, add_special_tokens=False)]
        ids_b = self.b.encode([w[1:] for w in words], num_threads=1)
        return [self._one(w.encode(), a, b) for w, a, b in zip(words, ids_a, ids_b, strict=True)]

    def _one(self, text: bytes, a: list[int], b: list[int]) -> tuple[bytes, bytes, bytes, bytes]:
        if b"".join(map(self.bytes_a.__getitem__, a)) != text or b"".join(map(self.bytes_b.__getitem__, b)) != text:
            return self.NONE
        cuts = shared_cuts(list(accumulate(map(self.len_a.__getitem__, a))), list(accumulate(map(self.len_b.__getitem__, b))))
        sizes = np.diff(np.array(cuts, np.uint32), axis=0, prepend=np.zeros((1, 2), np.uint32))
        return np.array(a, np.uint32).tobytes(), np.array(b, np.uint32).tobytes(), sizes[:, 0].tobytes(), sizes[:, 1].tobytes()


_PARTS = ("a", "b", "groups_a", "groups_b")


def word_alignments(made: DataFrame, source_a: str, source_b: bytes) -> DataFrame:
    """block, numbers, and for each part the numbers of entries (n_...) and the entries, packed. A word is aligned once."""
    shared = made.sparkSession.sparkContext.broadcast((source_a, source_b))

    def align(batches):
        model, known, bucket = Aligner(*shared.value), {}, None
        for batch in batches:
            out: list[list] = [[] for _ in range(8)]
            for own, packed in zip(batch.column("bucket").to_pylist(), batch.column("words").to_pylist(), strict=True):
                if own != bucket:
                    bucket, known = own, {}
                words = wordblocks.unpack_words(packed)
                fresh = [w for w in words if w not in known]
                known.update(zip(fresh, model.of(fresh), strict=True))
                rows = [known[w] for w in words]
                for k in range(4):
                    out[2 * k].append(pack(np.fromiter((len(r[k]) >> 2 for r in rows), np.uint32, len(rows))))
                    out[2 * k + 1].append(pack(np.frombuffer(b"".join(r[k] for r in rows), np.uint32)))
            yield pa.RecordBatch.from_arrays([batch.column("block"), batch.column("numbers"), *(pa.array(x, pa.binary()) for x in out)], names=["block", "numbers", *(n for p in _PARTS for n in (f"n_{p}", p))])

    schema = "block long, numbers binary, " + ", ".join(f"n_{p} binary, {p} binary" for p in _PARTS)
    return wordblocks.by_bucket(made, "numbers", "words").mapInArrow(align, schema)


def _joined(rows: list[tuple], k: int, read=unpack) -> np.ndarray:
    return np.concatenate([*(read(r[k]) for r in rows), np.zeros(0, np.int64)]).astype(np.int64)


class BlockWords:
    """The aligned words of a block, by number. pairs: its distinct linked pairs (A id in the upper half)."""

    def __init__(self, rows: list[tuple], len_a: np.ndarray, len_b: np.ndarray):
        order = np.argsort(_joined(rows, 0, ascending))
        counts, values = {}, {}
        for k, p in enumerate(_PARTS):
            n, v = _joined(rows, 1 + 2 * k), _joined(rows, 2 + 2 * k)
            values[p], counts[p] = gathered(v, (np.cumsum(n) - n)[order], n[order]), n[order]
        self.n_a, self.n_b, self.n_groups = counts["a"], counts["b"], counts["groups_a"]
        a, b = values["a"], values["b"]
        ends_a, ends_b = np.cumsum(len_a[a]), np.cumsum(len_b[b])
        ends = np.union1d(ends_a, ends_b)  # every word's bytes stand behind the last one's, in both
        pairs = a[np.searchsorted(ends_a, ends)] << 32 | b[np.searchsorted(ends_b, ends)]
        self.pairs, self.links = np.unique(pairs, return_inverse=True)
        self.n_links = self.n_a + self.n_b - self.n_groups
        self.link_starts = np.cumsum(self.n_links) - self.n_links
        self.texts = self._texts(a, b, values["groups_a"], values["groups_b"])

    def _texts(self, a: np.ndarray, b: np.ndarray, groups_a: np.ndarray, groups_b: np.ndarray) -> list[str]:
        """The groups of each word, each with a semicolon behind it. Ids share their strings, and a slice of the words is joined at a time."""
        known = range(int(max(a.max(initial=0), b.max(initial=0))) + 1)
        inside, ends = np.array([f"{k}," for k in known], object), {m: np.array([f"{k}{m}" for k in known], object) for m in "|;"}
        upto_a, upto_b, upto_groups = (np.concatenate([np.zeros(1, np.int64), np.cumsum(n)]) for n in (self.n_a, self.n_b, self.n_groups))
        made: list[str] = []
        for first in range(0, self.n_a.size, SLICE):
            to = min(first + SLICE, self.n_a.size)
            groups = slice(upto_groups[first], upto_groups[to])
            sizes = groups_a[groups], groups_b[groups]
            before = [np.cumsum(n) - n for n in sizes]
            out = np.empty(sum(int(n.sum()) for n in sizes), object)
            for ids, own, other, mark in ((a[upto_a[first] : upto_a[to]], 0, before[1], "|"), (b[upto_b[first] : upto_b[to]], 1, before[0] + sizes[0], ";")):
                last = np.zeros(ids.size, bool)
                last[before[own] + sizes[own] - 1] = True
                out[np.arange(ids.size) + np.repeat(other, sizes[own])] = np.where(last, ends[mark][ids], inside[ids])
            flat, stops = out.tolist(), (upto_a[first + 1 : to + 1] + upto_b[first + 1 : to + 1] - upto_a[first] - upto_b[first]).tolist()
            made += ["".join(flat[s:e]) for s, e in zip([0, *stops], stops, strict=False)]
        return made


def _in_order(texts: list[tuple]) -> list[tuple]:
    """The same order of a block's rows of texts whenever they are read; rows alike in it are alike in what follows from their words."""
    return sorted(texts, key=lambda t: t[1:])


_NAMES = {"number": pa.int32(), "pair": pa.int64(), "docs": pa.int64(), "n_links": pa.binary(), "links": pa.binary(), "n_a": pa.binary(), "n_b": pa.binary(), "n_groups": pa.binary(), "digests": pa.binary()}
_SCHEMA = "block long, number int, pair long, docs long, n_links binary, links binary, n_a binary, n_b binary, n_groups binary, digests binary"


def _rows(block: int, n: int, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([block] * n, pa.int64()), *(pa.array(columns[c], kind) if c in columns else pa.nulls(n, kind) for c, kind in _NAMES.items())], names=["block", *_NAMES])


def block_links(made: DataFrame, values: DataFrame, len_a: np.ndarray, len_b: np.ndarray) -> DataFrame:
    """Of each block: a row for each pair (number, pair, docs: in how many documents), one of all words' links (by pairs' numbers), and one of all documents' own results, in order."""

    def assemble(block, texts, rows):
        words = BlockWords(rows, len_a, len_b)
        wordblocks.release()
        docs, found, digests = np.zeros(words.pairs.size, np.int64), [], []
        for _, part in wordblocks.slices(_in_order(texts), OUT_WORDS):
            for row in part:
                if not row.size or not (words.n_a[row] > 0).all():
                    found.append((0, 0, 0))
                    digests.append(bytes(32))
                    continue
                once = np.unique(row)
                docs[np.unique(gathered(words.links, words.link_starts[once], words.n_links[once]))] += 1
                found.append((words.n_a[row].sum(), words.n_b[row].sum(), words.n_groups[row].sum()))
                text = "".join(map(words.texts.__getitem__, row.tolist()))
                digests.append(hashlib.sha256(text[:-1].encode()).digest())
        sums = np.array(found, np.int64).reshape(-1, 3)
        yield _rows(block, words.pairs.size, number=np.arange(words.pairs.size, dtype=np.int32), pair=words.pairs, docs=docs)
        yield _rows(block, 1, n_links=[pack(words.n_links)], links=[pack(words.links)])
        yield _rows(block, 1, n_a=[pack(sums[:, 0])], n_b=[pack(sums[:, 1])], n_groups=[pack(sums[:, 2])], digests=[b"".join(digests)])

    return wordblocks.by_block(made, values, assemble, _SCHEMA)


def pair_counts(links: DataFrame) -> DataFrame:
    """pair, count (documents in which it is linked), best: whether no pair of the same A id has more."""
    total = links.where("number is not null AND docs > 0").groupBy("pair").agg(F.sum("docs").alias("count")).withColumn("a", F.shiftright("pair", 32))
    return total.join(total.groupBy("a").agg(F.max("count").alias("most")), "a").select("pair", "count", (F.col("count") == F.col("most")).alias("best"))


def _assembled(made: DataFrame, links: DataFrame) -> DataFrame:
    """The columns of the contract: each block's texts meet its words' links and its pairs' counts."""
    valued = links.where("number is not null").join(pair_counts(links), "pair").select("block", "number", "count", "best")
    packed = ("n_links", "links", "n_a", "n_b", "n_groups", "digests")
    right = valued.unionByName(links.where("number is null").select("block", *packed), allowMissingColumns=True)

    def sums(left: pa.Table, right: pa.Table) -> pa.Table:
        row = {c: next(v for v in right.column(c).to_pylist() if v is not None) for c in packed}
        at = right.filter(right.column("number").is_valid())
        number, (n_links, links) = at.column("number").to_numpy(), (unpack(row[c]).astype(np.int64) for c in ("n_links", "links"))
        counts, best = (np.zeros(int(links.max(initial=-1)) + 1, np.int64) for _ in range(2))
        counts[number], best[number] = at.column("count").to_numpy(), at.column("best").to_numpy().astype(np.int64)
        upto = [np.concatenate([np.zeros(1, np.int64), np.cumsum(x[links])]) for x in (counts, best)]
        ends = np.cumsum(n_links)
        word_sums = [u[ends] - u[ends - n_links] for u in upto]
        texts = _in_order([(k.values, n.as_py(), m.as_py()) for k, n, m in zip(*(left.column(c) for c in ("keys", "numbers", "lengths")), strict=True)])
        keys, found = [], []
        for part, rows in wordblocks.slices(texts, OUT_WORDS):
            keys.append(part)
            found += [tuple(int(w[r].sum()) for w in word_sums) for r in rows]
        n_a, n_b, n_groups = (unpack(row[c]).astype(np.int64) for c in ("n_a", "n_b", "n_groups"))
        made, full = np.array(found, np.int64).reshape(-1, 2) * (n_a > 0)[:, None], n_a > 0
        digests = [row["digests"][32 * k : 32 * k + 32].hex() if ok else "" for k, ok in enumerate(full.tolist())]
        columns = {"doc_id": pa.concat_arrays(keys), "n_a": n_a, "n_b": n_b, "n_groups": n_groups, "n_links": n_a + n_b - n_groups, "n_best": made[:, 1], "count_sum": made[:, 0], "groups_sha256": pa.array(digests, pa.string())}
        return pa.table(columns)

    texts = made.where("bucket is null").select("block", "keys", "numbers", "lengths")
    kind = made.schema["keys"].dataType.elementType.simpleString()
    schema = f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    return texts.groupBy("block").cogroup(right.groupBy("block")).applyInArrow(sums, schema)


def alignment_report(docs: DataFrame, vocabulary_a: str, vocabulary_b: str, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """vocabulary_a: path of a byte-level BPE file of the tokenizers library, vocabulary_b: of a sentencepiece model; both are read on the driver and sent along."""
    import sentencepiece

    with open(vocabulary_a, encoding="utf-8") as f:
        source_a = f.read()
    with open(vocabulary_b, "rb") as f:
        source_b = f.read()
    len_a, len_b = (np.array(list(map(len, x)), np.int64) for x in (piece_bytes(source_a), piece_model_bytes(sentencepiece.SentencePieceProcessor(model_proto=source_b))))
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    numbering = lambda: wordblocks.Numbering(words_of, lambda w: " " + w)
    made = wordblocks.blocked(docs, numbering, wordblocks.buckets_for(docs, chars_in(docs)), block_chars)
    links = settle(block_links(made, word_alignments(made, source_a, source_b), len_a, len_b), "links")
    out = settle(_assembled(made, links), "alignment")
    wordblocks.dropped(made)
    discard(links)
    return out
