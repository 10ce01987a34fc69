"""Masked pseudo-likelihood: a bidirectional window network scores documents.

Words are counted over all documents, exactly. The most frequent ones get an id each; all others share hashed ids,
within which a word has its share of their occurrences, so that every word of the corpus has a probability of its own
and what is gathered grows with the corpus. Id 0 stands for what lies outside a text. A network predicts each word from
REACH words on either side: their embeddings, one table for each place, are summed and squashed; a softmax over
classes of ids, one over the members of the class, and the share within the id give the word's probability. A
document's score is the sum of the conditional log-probabilities of its words.

Documents are dealt to blocks by a hash of the row, so that the layout of docs changes nothing. Texts are cut into words
once; words travel to their counts and back by wordblocks.py, so no task or driver holds the vocabulary: it holds the
ids of at most CLASSES * CLASSES words. Training predicts every word of every document: each block runs stochastic
gradient descent (Adagrad, numpy) from the same start, and the blocks' weights are averaged, weighted by their numbers
of words, in Spark, a piece of the weights at a time; another round starts from the average.

Null and empty texts have no words, score 0 and no mean. Repeated rows score alike, up to rounding. Texts are read whole, whatever
their length, each in one block. Columns of docs other than doc_id and text aren't read, whatever their names; no rows
give no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from icuflow.llm import wordblocks
from icuflow.llm.common import chars_in, discard, settle
from icuflow.llm.wordblocks import ascending, pack, unpack

REACH, WIDTH, CLASSES = 2, 16, 32
HASHED = 256
BATCH = 4096
GROUP = 1 << 15
ROUNDS = 1
RATE = 0.05
PIECE = 1024
BLOCK_CHARS = 16 << 20
WORD = re.compile(r"\w+|[^\w\s]")


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def hash_of(word: str) -> int:
    return xxhash.xxh3_64_intdigest(word.encode()) % HASHED


class Ids:
    """The id of a word: 1 and on by frequency, the last HASHED for all others."""

    def __init__(self, words: list[str], classes: int = CLASSES):
        self.own = {w: k + 1 for k, w in enumerate(words)}
        self.first = classes * classes - HASHED

    def __call__(self, word: str) -> int:
        return self.own.get(word) or self.first + hash_of(word)


def stream(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all rows with REACH zeros around each, and where the words are."""
    lengths = np.array([len(r) for r in rows], np.int64)
    starts = np.cumsum(np.r_[REACH, lengths[:-1] + REACH]) if len(rows) else np.zeros(0, np.int64)
    flat = np.zeros(int(lengths.sum()) + REACH * (len(rows) + 1), np.int16)
    at = np.arange(int(lengths.sum())) + np.repeat(starts - (np.cumsum(lengths) - lengths), lengths)
    flat[at] = np.concatenate([*rows, np.zeros(0, np.int16)])
    return flat, at


_PLACES = [k for k in range(-REACH, REACH + 1) if k]


class Network:
    """All weights in one flat vector, seen as named parts."""

    def __init__(self, flat: np.ndarray | None = None, seed: int = 5, classes: int = CLASSES):
        self.count = classes
        shapes = {"table": (len(_PLACES), classes * classes, WIDTH), "squash": (WIDTH,), "classes": (WIDTH, classes), "class_bias": (classes,), "members": (classes, WIDTH, classes), "member_bias": (classes, classes)}
        size = sum(int(np.prod(s)) for s in shapes.values())
        self.flat = flat.copy() if flat is not None else np.random.default_rng(seed).normal(0, 0.1, size).astype(np.float32)
        self.shapes, self.part = shapes, self._parts(self.flat, shapes)
        self.squares: dict[str, np.ndarray] = {}
        self.ones, self.full = np.ones(classes, np.float32), np.ones(BATCH, np.float32)

    @staticmethod
    def _parts(flat: np.ndarray, shapes: dict) -> dict[str, np.ndarray]:
        out, at = {}, 0
        for name, shape in shapes.items():
            n = int(np.prod(shape))
            out[name] = flat[at : at + n].reshape(shape)
            at += n
        return out

    def hidden(self, around: list[np.ndarray]) -> np.ndarray:
        h = self.part["squash"] + self.part["table"][0].take(around[0], axis=0)
        for k in range(1, len(around)):
            h += self.part["table"][k].take(around[k], axis=0)
        return np.tanh(h, out=h)

    def _large(self) -> bool:
        """Whether an exponential of a logit could leave the range."""
        most = lambda w, b: (np.abs(self.part[w]).max(axis=-1).sum(axis=-1) + np.abs(self.part[b]).max(axis=-1)).max()
        return max(most("classes", "class_bias"), most("members", "member_bias")) > 40

    @staticmethod
    def _logits(h: np.ndarray, weights: np.ndarray, bias: np.ndarray, large: bool) -> np.ndarray:
        x = h @ weights
        x += bias
        if large:
            x -= x.max(axis=1, keepdims=True)
        return x

    def _sums(self, x: np.ndarray) -> np.ndarray:
        """x becomes exponentials; their sums by row."""
        np.exp(x, out=x)
        return x @ self.ones

    def _sorted(self, flat: np.ndarray, at: np.ndarray) -> tuple:
        """A batch in the order of its words' classes: hidden layer, places around, classes, members, and where classes begin."""
        order = np.argsort(flat[at], kind="stable")
        at = at[order]
        around, target = [flat[at + k] for k in _PLACES], flat[at].astype(np.int64)
        c, m = target // self.count, target % self.count
        return order, self.hidden(around), around, c, m, np.searchsorted(c, np.arange(self.count + 1)).tolist()

    def log_probabilities(self, flat: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Of the ids of flat at the places at."""
        out, large = np.zeros(len(at)), self._large()
        for start in range(0, len(at), GROUP):
            order, h, _, c, m, cuts = self._sorted(flat, at[start : start + GROUP])
            logits = self._logits(h, self.part["classes"], self.part["class_bias"], large)
            got = logits[np.arange(len(c)), c].astype(np.float64)
            got -= np.log(self._sums(logits))
            for k in range(self.count):
                a, b = cuts[k], cuts[k + 1]
                if a < b:
                    inner = self._logits(h[a:b], self.part["members"][k], self.part["member_bias"][k], large)
                    got[a:b] += inner[np.arange(b - a), m[a:b]]
                    got[a:b] -= np.log(self._sums(inner))
            out[start + order] = got
        return out

    def _step(self, name: str, slope: np.ndarray, rate: float, at=...) -> None:
        """Adagrad on the part, or on what at names of it; a weight without slope doesn't move."""
        square = self.squares[name][at] + slope * slope
        self.squares[name][at] = square
        self.part[name][at] -= rate * slope / np.sqrt(square)

    def train(self, flat: np.ndarray, at: np.ndarray, rate: float = RATE) -> None:
        """One pass over the places at, BATCH at a time."""
        if not self.squares:
            self.squares = self._parts(np.full(self.flat.size, 1e-6, np.float32), self.shapes)
        for start in range(0, len(at), BATCH):
            _, h, around, c, m, cuts = self._sorted(flat, at[start : start + BATCH])
            n, large = len(c), self._large()
            members, member_bias = np.zeros_like(self.part["members"]), np.zeros_like(self.part["member_bias"])
            off = self._logits(h, self.part["classes"], self.part["class_bias"], large)
            off *= (1 / (self._sums(off) * n))[:, None]
            off[np.arange(n), c] -= 1 / n
            back = off @ self.part["classes"].T
            for k in range(self.count):
                a, b = cuts[k], cuts[k + 1]
                if a < b:
                    own = h[a:b]
                    e = self._logits(own, self.part["members"][k], self.part["member_bias"][k], large)
                    e *= (1 / (self._sums(e) * n))[:, None]
                    e[np.arange(b - a), m[a:b]] -= 1 / n
                    back[a:b] += e @ self.part["members"][k].T
                    np.matmul(own.T, e, out=members[k])
                    np.matmul(self.full[: b - a], e, out=member_bias[k])
            back *= 1 - h * h
            for k, met in enumerate(around):
                order = np.argsort(met, kind="stable")
                ids = met[order]
                heads = np.r_[0, np.nonzero(ids[1:] != ids[:-1])[0] + 1]
                self._step("table", np.add.reduceat(back[order], heads, axis=0), rate, (k, ids[heads]))
            for name, slope in (("members", members), ("member_bias", member_bias), ("classes", h.T @ off), ("class_bias", off.sum(axis=0)), ("squash", back.sum(axis=0))):
                self._step(name, slope, rate)


def groups(texts: list[tuple], ids: np.ndarray) -> Iterator[tuple[pa.Array, list[np.ndarray], list[np.ndarray]]]:
    """Keys, rows of numbers and rows of ids, about GROUP words at a time."""
    for keys, rows in wordblocks.slices(texts, GROUP):
        yield keys, rows, [ids[r] for r in rows]


def _by_number(values: list[tuple]) -> list[np.ndarray]:
    """The packed columns of values after the numbers, in the order of the numbers."""
    numbers = np.concatenate([*(ascending(v[0]) for v in values), np.zeros(0, np.int64)])
    out = []
    for k in range(1, len(values[0]) if values else 1):
        out.append(np.zeros(numbers.size, np.uint32))
        out[-1][numbers] = np.concatenate([unpack(v[k]) for v in values])
    return out


def dealt(docs: DataFrame, chars: int, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """doc_id, text in an order, and in parts, that depend on the rows alone."""
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    row = F.xxhash64("doc_id", "text")
    return rows.withColumn("row", row).repartition(max(1, -(-chars // block_chars)), "row").sortWithinPartitions("row", "doc_id", "text").drop("row")


def counted(made: DataFrame, most: int) -> tuple[list[tuple[str, int]], np.ndarray]:
    """The most frequent words with their counts (ties by word), and the counts of all words by hashed id."""

    def count(batches):
        # of all buckets of the task: the best words so far, and the counts by hashed id
        names, n, cells = np.zeros(0, object), np.zeros(0, np.int64), np.zeros(HASHED, np.int64)
        for _, words, totals, _ in _totals(batches):
            own = np.array([*words], object)
            cells += np.bincount(np.fromiter(map(hash_of, own), np.int64, own.size), weights=totals, minlength=HASHED).astype(np.int64)
            names, n = np.concatenate([names, own]), np.concatenate([n, totals])
            best = sorted(np.nonzero(n >= np.partition(n, -most)[-most])[0] if n.size > most else range(n.size), key=lambda k: (-n[k], names[k]))[:most]
            names, n = names[best], n[best]
        full = np.nonzero(cells)[0]
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.nulls(n.size, pa.int32()), pa.array(n)], names=["word", "cell", "n"])
        yield pa.RecordBatch.from_arrays([pa.nulls(full.size, pa.string()), pa.array(full, pa.int32()), pa.array(cells[full])], names=["word", "cell", "n"])

    got = wordblocks.by_bucket(made, "words", "counts").mapInArrow(count, "word string, cell int, n long")
    got = settle(got, "counts")
    best = [(r["word"], r["n"]) for r in got.where("word is not null").orderBy(F.desc("n"), "word").limit(most).collect()]
    masses = np.zeros(HASHED)
    for r in got.where("cell is not null").groupBy("cell").agg(F.sum("n").alias("n")).collect():
        masses[r["cell"]] = r["n"]
    for word, n in best:
        masses[hash_of(word)] -= n
    discard(got)
    return best, masses


def _totals(batches) -> Iterator[tuple[int, list[str], np.ndarray, list[tuple]]]:
    """Of each bucket: its distinct words, their counts in all blocks, and its rows as (row, places of its words)."""
    bucket, words, rows, totals = None, wordblocks.Numbering(lambda w: w), [], np.zeros(0, np.int64)
    for b in batches:
        columns = b.schema.names
        for k in range(b.num_rows):
            row = {c: b.column(c)[k].as_py() for c in columns}
            if row["bucket"] != bucket:
                if rows:
                    yield bucket, words, totals, rows
                bucket, words, rows, totals = row["bucket"], wordblocks.Numbering(lambda w: w), [], np.zeros(0, np.int64)
            places = words.row(wordblocks.unpack_words(row.pop("words")))
            totals = np.concatenate([totals, np.zeros(len(words) - totals.size, np.int64)])
            totals[places] += unpack(row.pop("counts"))
            rows.append((row, places.astype(np.uint32)))
    if rows:
        yield bucket, words, totals, rows


def valued(made: DataFrame, words: list[str]) -> DataFrame:
    """block, numbers, ids, totals (0 for words with an id of their own) of each row of words, kept by block."""
    shared = made.sparkSession.sparkContext.broadcast(words)

    def value(batches):
        id_of = Ids(shared.value)
        for _, known, totals, rows in _totals(batches):
            ids = np.fromiter(map(id_of, known), np.uint32, len(known))
            rest = np.where(ids < id_of.first, 0, totals).astype(np.uint32)
            for at in range(0, len(rows), 256):
                part = rows[at : at + 256]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r["block"] for r, _ in part], pa.int64()), pa.array([r["numbers"] for r, _ in part], pa.binary()), pa.array([pack(ids[p]) for _, p in part], pa.binary()), pa.array([pack(rest[p]) for _, p in part], pa.binary())], names=["block", "numbers", "ids", "totals"]
                )

    rows = wordblocks.by_bucket(made, "numbers", "words", "counts").mapInArrow(value, "block long, numbers binary, ids binary, totals binary")
    return wordblocks.kept_by_block(rows, "values")


def averaged_round(made: DataFrame, values: DataFrame, start: np.ndarray) -> np.ndarray:
    """The average of the weights that the blocks reach from start."""
    shared = made.sparkSession.sparkContext.broadcast(start)

    def train(block, texts, values):
        ids = _by_number(values)[0].astype(np.int16) if values else np.zeros(0, np.int16)
        network, n = Network(shared.value), 0
        for _, _, rows in groups(texts, ids):
            flat, at = stream(rows)
            network.train(flat, at)
            n += len(at)
        pieces = range(-(-network.flat.size // PIECE)) if n else []
        weights = [network.flat[k * PIECE : (k + 1) * PIECE].tobytes() for k in pieces]
        yield pa.RecordBatch.from_arrays([pa.array([block] * len(weights), pa.int64()), pa.array(pieces, pa.int32()), pa.array([n] * len(weights), pa.int64()), pa.array(weights, pa.binary())], names=["block", "piece", "n", "weights"])

    def average(batches):
        piece, words, total = None, 0, 0.0
        out = lambda: pa.RecordBatch.from_arrays([pa.array([piece], pa.int32()), pa.array([(total / words).astype(np.float32).tobytes()], pa.binary())], names=["piece", "weights"])
        for b in batches:
            for own, n, weights in zip(b.column("piece").to_pylist(), b.column("n").to_pylist(), b.column("weights").to_pylist(), strict=True):
                if own != piece:
                    if words:
                        yield out()
                    piece, words, total = own, 0, 0.0
                words, total = words + n, total + n * np.frombuffer(weights, np.float32).astype(np.float64)
        if words:
            yield out()

    trained = wordblocks.by_block(made, values, train, "block long, piece int, n long, weights binary")
    parts = min(-(-start.size // PIECE), int(made.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    out = start.copy()
    for r in trained.repartition(parts, "piece").sortWithinPartitions("piece", "block").mapInArrow(average, "piece int, weights binary").collect():
        out[r["piece"] * PIECE : (r["piece"] + 1) * PIECE] = np.frombuffer(r["weights"], np.float32)
    return out


def prepared(docs: DataFrame, block_chars: int = BLOCK_CHARS) -> tuple[DataFrame, DataFrame, list[str], np.ndarray]:
    """The blocks of docs, their words' values, the words with ids of their own, and the counts of all others by hashed id."""
    chars = chars_in(docs.select(F.col("text").cast("string").alias("text")))
    made = wordblocks.blocked(dealt(docs, chars, block_chars), lambda: wordblocks.Numbering(words_of), wordblocks.buckets_for(docs, chars), block_chars)
    best, masses = counted(made, CLASSES * CLASSES - HASHED - 1)
    words = [w for w, _ in best]
    return made, valued(made, words), words, masses


def score_documents(docs: DataFrame, rounds: int = ROUNDS, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """For each row of docs: doc_id, n_words, score (the sum of log-probabilities) and mean_score."""
    made, values, _, masses = prepared(docs, block_chars)
    weights = Network().flat
    for _ in range(rounds):
        weights = averaged_round(made, values, weights)
    shared = docs.sparkSession.sparkContext.broadcast((weights, masses))

    def score(_, texts, values):
        weights, masses = shared.value
        network = Network(weights)
        ids, totals = _by_number(values) if values else (np.zeros(0, np.uint32),) * 2
        first = CLASSES * CLASSES - HASHED
        rest = ids >= first
        shares = np.zeros(ids.size)
        shares[rest] = np.log(totals[rest] / masses[ids[rest].astype(np.int64) - first])
        for keys, numbers, rows in groups(texts, ids.astype(np.int16)):
            got = network.log_probabilities(*stream(rows)) + shares[np.concatenate([*numbers, np.zeros(0, np.uint32)])]
            sizes = np.array([len(r) for r in rows], np.int64)
            ends = np.cumsum(sizes)
            sums = np.concatenate([[0.0], np.cumsum(got)])
            scores = sums[ends] - sums[ends - sizes]
            means = [s / n if n else None for s, n in zip(scores.tolist(), sizes.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([keys, pa.array(sizes), pa.array(scores), pa.array(means, pa.float64())], names=["doc_id", "n_words", "score", "mean_score"])

    return wordblocks.by_block(made, values, score, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_words long, score double, mean_score double")
