"""Toxicity by noisy-channel deobfuscation.

Writers hide words by leetspeak (1d10t), spacing (i d i o t) and repetition (idiooot). Each suspect stretch of text
becomes a lattice of characters: an observed character can stand for itself, for the letters it imitates, or, if it
repeats or merely separates, for nothing, each at a cost; Viterbi decoding under a character trigram model finds the
likeliest intended word. The model's counts are taken over all documents, in Spark.

The score is learned from labelled rows: the words of a text, as written and as restored, give features (the word and
its first characters, as insults are inflected). Each feature's log-odds are learned on one part of the sample; on
the rest, a logistic layer over a text's strongest features is fitted, weighted to the classes' shares among all
labelled rows, so that scores are probabilities. The sample holds at most about SAMPLE rows of each class and depends
on the rows alone. Score and model use nothing but the text.

Only stretches with a sign of hiding (_SUSPECT, _SPACED) reach the lattice; other writings are read as they stand. In
scoring, neither do stretches that cannot become a word with odds, whatever the path: imitation, repetition and
separation leave a stretch's skeleton as it is. Decoding is exact, no path is cut off.

Null and empty texts have no features; their score is the model's for none. Without labels of both classes every
score is the share of label 1, or 0. Labels that contradict one another count as toxic. Texts are read whole, whatever their
length. Repeated rows score alike; other columns aren't read, whatever their names; no rows give no rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from icuflow.llm.common import hash_share, id_remainder

SAMPLE = 4000
THRESHOLD = 0.3
KNOWN_WORDS = 1 << 19

# Letters of the character model, and what a character can imitate.
LETTERS = "abcdefghijklmnopqrstuvwxyzàáâäæçèéêëìíîïñòóôöœùúûüß"
IMITATES = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "¥": "y"}
COST_IMITATES, COST_REPEATS, COST_SEPARATES = 1.5, 1.0, 0.7

_N = len(LETTERS) + 1  # 0 is the end of a word
_CODE = np.zeros(0x180, np.int64)
_CODE[[ord(c) for c in LETTERS]] = np.arange(1, _N)
_WORD = re.compile(r"[^\W\d_]+")
_SUSPECT = re.compile(
    r"[^\W_][*_~.-]+[^\W_]"  # separators inside, in runs
    r"|[^\W\d_][0-9@$!|+(€£¥]+[^\W\d_]"  # imitating characters beside letters
    r"|(?<![^\W_])(?<![@$!|+(€£¥])[0-9@$!|+(€£¥]+[^\W\d_]{2}|[^\W\d_][!|+(€£¥]*[0-9@$]"
    r"|([^\W\d_])\1"  # a letter twice or more
)
# characters that stand alone, three at least, with runs of separators and white space between them
_SPACED = re.compile(r"(?:(?<![^\W_])[^\W_]|(?<!\S)[@$!|+(€£¥])(?:[\s*_~.-]+[^\W_](?![^\W_])|[\s*_~.-]+[@$!|+(€£¥](?![^\W_])){2,}")
_INNER = re.compile(r"[,/:;?\"'&#]+")  # punctuation that no hidden word holds
_MARKS = "0123456789@$!|+()€£¥*_~.-"


def trigram_ids(text: str) -> np.ndarray:
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    codes = np.concatenate([[0], _CODE[np.where(points < _CODE.size, points, 0)], [0]])
    return ((codes[:-2] * _N + codes[1:-1]) * _N + codes[2:])[(codes[1:-1] > 0)]


def trigram_counts(docs: DataFrame) -> DataFrame:
    """trigram, n: how often each occurs in all texts. Its size is bounded by the alphabet."""

    def count(batches):
        total = np.zeros(_N**3, np.int64)
        for b in batches:
            for t in b.column("text").to_pylist():
                if t:
                    total += np.bincount(trigram_ids(t), minlength=_N**3) if len(t) > 20_000 else 0
                    if len(t) <= 20_000:
                        ids, n = np.unique(trigram_ids(t), return_counts=True)
                        total[ids] += n
        ids = np.nonzero(total)[0]
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(total[ids], pa.int64())], names=["trigram", "n"])

    return docs.select(F.col("text").cast("string").alias("text")).mapInArrow(count, "trigram long, n long").groupBy("trigram").agg(F.sum("n").alias("n"))


class CharacterModel:
    """Log-probabilities of a letter (or the end) after two others, smoothed by the shorter context."""

    def __init__(self, counts: dict[int, int]):
        three = np.zeros(_N**3)
        three[list(counts)] = list(counts.values())
        three = three.reshape(_N, _N, _N)
        two = three.sum(axis=0)
        one = two.sum(axis=0) + 1.0
        p1 = one / one.sum()
        p2 = (two + 5 * p1) / (two.sum(axis=1, keepdims=True) + 5)
        p3 = (three + 5 * p2) / (three.sum(axis=2, keepdims=True) + 5)
        self.log = np.log(p3).tolist()
        self.code = {c: k + 1 for k, c in enumerate(LETTERS)}

    def restore(self, observed: str) -> str:
        """The likeliest word behind the observed characters, in time linear in their number."""
        # the last two letters' codes: the best score, and the letters so far as a chain of (before, letter)
        states: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
        for c in observed:
            after: dict[tuple[int, int], tuple[float, tuple | None]] = {}
            means = [(c, 0.0)] if c in self.code else []
            imitated = IMITATES.get(c, "")
            means += [(x, COST_IMITATES) for x in imitated]
            for (a, b), (score, chain) in states.items():
                for letter, cost in means:
                    k = self.code[letter]
                    s = score + self.log[a][b][k] - cost
                    if s > after.get((b, k), (-math.inf,))[0]:
                        after[b, k] = (s, (chain, letter))
                repeats = chain is not None and (c == chain[1] or chain[1] in imitated)
                if repeats or not means:
                    s = score - (COST_REPEATS if repeats else COST_SEPARATES)
                    if s > after.get((a, b), (-math.inf,))[0]:
                        after[a, b] = (s, chain)
            states = after
        chain = max(((s + self.log[a][b][0], n, c) for n, ((a, b), (s, c)) in enumerate(states.items())), default=(0, 0, None))[2]
        out = []
        while chain is not None:
            chain, letter = chain
            out.append(letter)
        return "".join(reversed(out))


def features_of(word: str) -> list[str]:
    return [word, *(f"{word[:n]}*" for n in (4, 5, 6, 7) if len(word) > n)] if len(word) > 2 else [word]


def _kinds() -> dict[int, str | None]:
    """For str.translate: a character's kind. Letters that one character imitates are of one kind, and so is that character; others have none."""
    kind = {c: c for c in LETTERS}
    for letters in IMITATES.values():
        for c in letters:
            kind = {k: kind[letters[0]] if v == kind[c] else v for k, v in kind.items()}
    return {ord(k): v for k, v in kind.items()} | {ord(c): kind[letters[0]] for c, letters in IMITATES.items()}


class _Kinds(dict):
    def __missing__(self, key):
        return None


_KINDS = _Kinds(_kinds())
_RUN = re.compile(r"(.)\1+")


def skeleton(observed: str) -> str:
    """The kinds of the characters, runs as one. Whatever word restore() finds has the skeleton of what was observed."""
    return _RUN.sub(r"\1", observed.translate(_KINDS))


class Restorer:
    """The words of a text, as written and as restored. Each distinct stretch between white space is decoded once.

    With odds, only words that have odds are given, and only stretches whose skeleton fits one of those are decoded: the rest can't find any."""

    def __init__(self, model: CharacterModel, odds: dict[str, float] | None = None):
        self.model, self.odds, self.known = model, odds, {}
        whole, starts = ({skeleton(f) for f in odds or () if f.endswith("*") == star} for star in (False, True))
        self.whole, self.starts, self.lengths = whole, starts, sorted({len(x) for x in starts})

    def _fits(self, seen: str) -> bool:
        if self.odds is None:
            return True
        own = skeleton(seen)
        return own in self.whole or any(own[:n] in self.starts for n in self.lengths)

    def restored(self, seen: str) -> list[str]:
        # with the marks at its ends cut off it is tried as well: an imitating character may be just a mark
        # and so is each piece between inner punctuation
        pieces = {x for x in _INNER.split(seen) if _SUSPECT.search(x)}
        tried = {x for p in {seen, *pieces} for x in (p, p.strip(_MARKS))}
        return [w for w in {self.model.restore(x) for x in tried if self._fits(x)} if len(w) > 2]

    def _kept(self, words: list[str]) -> tuple[str, ...]:
        return tuple(words) if self.odds is None else tuple(w for w in words if any(f in self.odds for f in features_of(w)))

    def words(self, text: str) -> tuple[set[str], int]:
        """The words, and the number of distinct stretches between white space."""
        text = text.lower()
        parts = set(text.split())
        if len(self.known) > KNOWN_WORDS:
            self.known.clear()
        known = self.known
        for p in parts.difference(known):
            known[p] = self._kept(_WORD.findall(p) + (self.restored(p) if _SUSPECT.search(p) else []))
        words = set()
        words.update(*map(known.__getitem__, parts))
        for p in {m.group() for m in _SPACED.finditer(text)}:
            found = known.get(p)
            if found is None:
                found = known[p] = self._kept(self.restored(p))
            words.update(found)
        return words, len(parts)


class ToxicityModel:
    """Log-odds of features and the logistic layer."""

    def __init__(self, characters: CharacterModel, odds: dict[str, float], layer: np.ndarray | None, share: float):
        self.characters, self.odds, self.layer, self.share = characters, odds, layer, share

    def start(self) -> None:
        self.restorer = Restorer(self.characters, self.odds)

    def summary(self, words: set[str], parts: int) -> np.ndarray:
        found = sorted((s for s in (max((self.odds.get(f, 0.0) for f in features_of(w)), default=0.0) for w in words) if s > 0), reverse=True)[:5] + [0.0] * 5
        return np.array([1.0, found[0], found[1], found[2], sum(found[:5]), float(sum(s > 3 for s in found)), math.log1p(parts) / 5])

    def scores(self, texts: list[str | None]) -> list[float]:
        if self.layer is None:
            return [self.share] * len(texts)
        x = np.array([self.summary(*(self.restorer.words(t) if t else ((), 0))) for t in texts]).reshape(len(texts), -1) @ self.layer
        return (1 / (1 + np.exp(-np.clip(x, -30, 30)))).tolist()


def log_odds(rows: list[tuple[set[str], int]]) -> dict[str, float]:
    """Of features that at least three toxic texts have and that are likelier there."""
    seen: tuple[Counter, Counter] = (Counter(), Counter())
    n = [0, 0]
    for words, toxic in rows:
        n[toxic] += 1
        seen[toxic].update({f for w in words for f in features_of(w)})
    out = {}
    for f, k in seen[1].items():
        if k >= 3:
            value = math.log((k + 0.5) / (n[1] + 1)) - math.log((seen[0][f] + 0.5) / (n[0] + 1)) - 1.0 / math.sqrt(k)
            if value > 1:
                out[f] = min(value, 8.0)
    return out


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: float = 1e-3) -> np.ndarray:
    """Newton's method with a small ridge."""
    b = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        slope = x.T @ (weight * (y - p)) - penalty * weight.sum() * b
        curve = (x * (weight * p * (1 - p))[:, None]).T @ x + (penalty * weight.sum() + 1e-9) * np.eye(x.shape[1])
        step = np.linalg.solve(curve, slope)
        b += step
        if np.abs(step).max() < 1e-8:
            break
    return b


def held_out() -> Column:
    return id_remainder("doc_id", 4) == 2


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> ToxicityModel:
    """From labelled rows that aren't held out; the character model from all rows."""
    characters = CharacterModel({r["trigram"]: r["n"] for r in trigram_counts(docs).collect()})
    marks = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic")).where(F.col("toxic").isin(0, 1) & ~held_out())
    n = [0, 0]
    for r in marks.groupBy("toxic").count().collect():
        n[r["toxic"]] = r["count"]
    share = n[1] / max(1, sum(n))
    if not all(n):
        return ToxicityModel(characters, {}, None, share)
    part = F.when(F.col("toxic") == 1, F.lit(min(1.0, sample / n[1]))).otherwise(F.lit(min(1.0, sample / n[0])))
    # at most about 2 * sample rows, so they go to the texts, not the texts to them
    marks = F.broadcast(marks.where(hash_share("doc_id") < part))
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(marks, "doc_id").where(F.col("text").isNotNull())
    restorer = Restorer(characters)
    texts = sorted(((r["s"], r["text"], r["toxic"]) for r in rows.select("text", "toxic", hash_share("text", "doc_id").alias("s")).collect()), key=lambda r: r[:2])
    if not {0, 1} <= {toxic for _, _, toxic in texts}:
        return ToxicityModel(characters, {}, None, share)
    words = [(*restorer.words(text), toxic) for _, text, toxic in texts]
    cut = len(words) * 3 // 5
    first = ToxicityModel(characters, log_odds([(w, toxic) for w, _, toxic in words[:cut]]), None, share)
    x = np.array([first.summary(w, n) for w, n, _ in words[cut:]])
    y = np.array([toxic for _, _, toxic in texts[cut:]])
    got = Counter(toxic for _, _, toxic in texts)
    weight = np.where(y == 1, n[1] / got[1], n[0] / got[0])
    layer = logistic(x, y, weight) if len(set(y.tolist())) == 2 else None
    return ToxicityModel(characters, first.odds, layer, share)


def score_toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """For each row of docs: doc_id, held_out, score and predicted (1 if the score is at least THRESHOLD)."""
    shared = docs.sparkSession.sparkContext.broadcast(learn(docs, labels, sample))

    def score(batches):
        model = shared.value
        model.start()
        for b in batches:
            texts, scores = b.column("text"), []
            for at in range(0, b.num_rows, 500):
                scores += model.scores(texts.slice(at, 500).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(scores, pa.float64()), pa.array([int(s >= THRESHOLD) for s in scores], pa.int32())], names=["doc_id", "held_out", "score", "predicted"])

    rows = docs.select("doc_id", held_out().alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(score, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, held_out boolean, score double, predicted int")
