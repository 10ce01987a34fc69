"""Language identification: averaged hashed subword embeddings with a linear softmax.

Subwords are runs of one to three characters of the lower-cased text, where every character that is not a letter
counts as a space and runs of spaces as one. They are hashed to BUCKETS rows of an embedding table; a text is the
average of its rows, and a linear layer with softmax gives a probability for each language. Table and layer are
trained together by stochastic gradient descent in numpy, on a sample of at most about SAMPLE rows, the same share of
each language up to its part of the bound, whatever their number; the sample depends on the rows alone. One row in five
of it is kept out of training, to fit the temperature of the softmax and the score below which a prediction is
rejected: at most one in a thousand of its correct predictions lies below, and it is ABOVE_CHANCE beyond an even score
of all languages at most, so that clean short texts stay.

Every text is read whole, whatever its length. Null texts and texts without a letter are "und" with score 0, as are all
texts if nothing could be learned. Repeated rows give repeated results. identify() reads no other columns than doc_id,
text and lang, whatever their names, and accepted_rows() returns all of them; no rows give no rows.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from icuflow.llm.common import hash_share, id_remainder, thrifty

BUCKETS = 1 << 12
WIDTH = 16
SAMPLE = 4000
ABOVE_CHANCE = 0.1
UNDETERMINED = "und"
_OTHER, _LETTER = re.compile(r"[\W\d_]+"), re.compile(r"[^\W\d_]")


def counts_of(text: str) -> np.ndarray:
    """How often the text's subwords fall into each bucket."""
    points = np.frombuffer(f" {_OTHER.sub(' ', text.lower())} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    one = points * np.uint32(2654435761)
    two = (one[:-1] ^ np.uint32(0x9E3779B9)) * np.uint32(40503) + one[1:]
    three = (two[:-1] ^ np.uint32(0x85EBCA6B)) * np.uint32(48271) + one[2:]
    shift = np.uint32(32 - BUCKETS.bit_length() + 1)
    out = np.bincount(one[1:-1] >> shift, minlength=BUCKETS)
    for x in (two, three):
        x ^= x >> np.uint32(15)
        x *= np.uint32(2246822519)
        out += np.bincount(x >> shift, minlength=BUCKETS)
    return out


def averages(texts: list[str]) -> np.ndarray:
    out = np.zeros((len(texts), BUCKETS), np.float32)
    for row, t in zip(out, texts, strict=True):
        n = counts_of(t)
        row[:] = n / max(1, n.sum())
    return out


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


class LanguageModel:
    """A trained table and layer. languages are in the order of the outputs."""

    def __init__(self, languages: list[str], table: np.ndarray, layer: np.ndarray, bias: np.ndarray):
        self.languages, self.bias = languages, bias
        self.weights = (table @ layer).astype(np.float32)
        self.temperature, self.least = 1.0, 0.0

    def probabilities(self, features: np.ndarray) -> np.ndarray:
        return softmax((features @ self.weights + self.bias) / self.temperature)

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        known = [k for k, t in enumerate(texts) if t and self.languages and _LETTER.search(t)]
        names, scores = [UNDETERMINED] * len(texts), [0.0] * len(texts)
        for at in range(0, len(known), 256):
            rows = known[at : at + 256]
            p = self.probabilities(averages([texts[k] for k in rows]))
            for k, best, score in zip(rows, p.argmax(axis=1), p.max(axis=1), strict=True):
                names[k], scores[k] = self.languages[best], min(1.0, float(score))
        return names, scores


def _fragments(texts: list[str], rng: np.random.Generator) -> list[str]:
    """A short run of words of each text, so that short texts are met in training."""
    out = []
    for t in texts:
        words = t.split()
        n = int(rng.integers(2, 25))
        at = int(rng.integers(0, max(1, len(words) - n + 1)))
        out.append(" ".join(words[at : at + n]))
    return out


def fit(rows: list[tuple[str, str]], epochs: int = 12, batch: int = 64, rate: float = 8.0, seed: int = 7) -> LanguageModel:
    """rows: text and language. The order of the rows doesn't matter."""
    rows = sorted((t, g) for t, g in rows if t and _LETTER.search(t))
    languages = sorted({g for _, g in rows})
    rng = np.random.default_rng(seed)
    if len(languages) < 2:
        return LanguageModel(languages, np.zeros((BUCKETS, WIDTH)), np.zeros((WIDTH, len(languages))), np.zeros(len(languages)))
    rows = [rows[k] for k in rng.permutation(len(rows))]
    kept, learned = rows[: len(rows) // 5], rows[len(rows) // 5 :]
    number = {g: k for k, g in enumerate(languages)}
    texts = [t for t, _ in learned]
    x = averages([*texts, *_fragments(texts, rng)])
    y = np.array([number[g] for _, g in learned] * 2)
    frequency = np.sqrt((x**2).mean(axis=0) + 1e-8)  # rare subwords take larger steps
    table = rng.normal(0, 0.1, (BUCKETS, WIDTH)).astype(np.float32)
    layer = rng.normal(0, 0.3, (WIDTH, len(languages))).astype(np.float32)
    bias = np.zeros(len(languages), np.float32)
    steps, done = epochs * -(-len(x) // batch), 0
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for at in range(0, len(x), batch):
            part = order[at : at + batch]
            hidden = x[part] @ table
            off = softmax(hidden @ layer + bias)
            off[np.arange(len(part)), y[part]] -= 1
            off /= len(part)
            step = rate * (1 - done / steps)
            back = x[part].T @ (off @ layer.T)
            layer -= 0.1 * step * (hidden.T @ off)
            bias -= 0.1 * step * off.sum(axis=0)
            table -= step * back / frequency[:, None] * 0.2
            done += 1
    model = LanguageModel(languages, table, layer, bias)
    if kept:
        texts = [t for t, _ in kept]
        features, truth = averages([*texts, *_fragments(texts, rng)]), np.array([number[g] for _, g in kept] * 2)
        loss = {}
        for t in (0.25, 0.35, 0.5, 0.7, 1.0, 1.4, 2.0, 2.8, 4.0):
            model.temperature = t
            loss[t] = -np.log(np.maximum(model.probabilities(features)[np.arange(len(truth)), truth], 1e-9)).mean()
        model.temperature = min(loss, key=loss.get)
        p = model.probabilities(features[: len(kept)])
        right = np.sort(p.max(axis=1)[p.argmax(axis=1) == truth[: len(kept)]])
        model.least = min(1 / len(languages) + ABOVE_CHANCE, float(right[len(right) // 1000])) if right.size else 0.0
    return model


def held_out() -> Column:
    return id_remainder("doc_id", 3) == 1


def learn(docs: DataFrame, sample: int = SAMPLE) -> LanguageModel:
    """From rows with a text and a language that aren't held out."""
    rows = docs.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"), "doc_id").where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out())
    sizes = rows.groupBy(F.col("lang").alias("named")).agg(F.count("*").alias("n"))
    if not (languages := sizes.count()):
        return fit([])
    shared = rows.join(sizes, F.col("lang") == F.col("named")).where(hash_share("doc_id", "text") < F.lit(sample / languages) / F.col("n"))
    picked = shared.select("text", "lang").collect()
    return fit([(r["text"], r["lang"]) for r in picked])


def identify(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """For each row of docs: doc_id, held_out, lang_pred, score and accepted (false: und, or a score too low to trust)."""
    shared = docs.sparkSession.sparkContext.broadcast(learn(docs, sample))

    def predict(batches):
        for b in batches:
            names, scores = shared.value.predict(b.column("text").to_pylist())
            accepted = [n != UNDETERMINED and s >= shared.value.least for n, s in zip(names, scores, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(accepted, pa.bool_())], names=["doc_id", "held_out", "lang_pred", "score", "accepted"])

    rows = docs.select("doc_id", held_out().alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(thrifty(predict), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, held_out boolean, lang_pred string, score double, accepted boolean")


def accepted_rows(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The rows of docs whose language is accepted, with all their columns."""
    shared, at = docs.sparkSession.sparkContext.broadcast(learn(docs, sample)), docs.columns.index("text")

    def keep(batches):
        for b in batches:
            names, scores = shared.value.predict(b.column(at).cast(pa.string()).to_pylist())
            yield b.filter(pa.array([n != UNDETERMINED and s >= shared.value.least for n, s in zip(names, scores, strict=True)], pa.bool_()))

    return docs.mapInArrow(thrifty(keep), docs.schema)
