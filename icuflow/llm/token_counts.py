"""Word-piece counts by a linear longest-match automaton.

A word is a run of letters, digits and underscores of the lower-cased text, or one other character that isn't white
space. It is spelled in bytes and ends with a mark, as in vocabularies whose pieces say if they end a word. Greedy
longest-match takes the longest piece of the vocabulary at each place. The automaton is a trie of the pieces in which
each node also has a failure link, and the number of pieces that following it pops; reading a byte follows links until
the trie goes on, so a word takes time linear in its length, and no piece is ever built.

A word that can't be matched counts as one (unknown) piece. Each distinct word is read once a task. Null and empty
texts have no words. Texts are read whole.
"""

from __future__ import annotations

import json
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

END = 256
KNOWN_WORDS = 1 << 19
WORD = re.compile(r"\w+|[^\w\s]")


def vocabulary_pieces(path: str) -> list[tuple[int, ...]]:
    """The pieces of a byte-level vocabulary with word ends, as bytes; the end of a word is 256. Special tokens are left out."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    byte_of = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}
    mark = spec["model"]["end_of_word_suffix"]
    special = {t["content"] for t in spec["added_tokens"]}
    out = []
    for piece in spec["model"]["vocab"]:
        if piece not in special:
            body = piece.removesuffix(mark)
            out.append((*map(byte_of.__getitem__, body), *([END] if piece.endswith(mark) and body else [])))
    return out


class Automaton:
    """next: per node its children; fail and pops: where to go on and how many pieces that ends, -1 where nothing matches."""

    def __init__(self, pieces: list[tuple[int, ...]]):
        self.next: list[dict[int, int]] = [{}]
        whole = [False]
        for piece in pieces:
            node = 0
            for c in piece:
                if (after := self.next[node].get(c)) is None:
                    after = self.next[node][c] = len(self.next)
                    self.next.append({})
                    whole.append(False)
                node = after
            whole[node] = node > 0
        self.fail, self.pops = [-1] * len(whole), [0] * len(whole)
        level = [(0, c, kid) for c, kid in self.next[0].items()]
        while level:
            for parent, c, node in level:
                if whole[node]:
                    self.fail[node], self.pops[node] = 0, 1
                    continue
                at, pops = self.fail[parent], self.pops[parent]
                while at >= 0 and c not in self.next[at]:
                    pops += self.pops[at]
                    at = self.fail[at]
                if at >= 0:
                    self.fail[node], self.pops[node] = self.next[at][c], pops
            level = [(node, c, kid) for _, _, node in level for c, kid in self.next[node].items()]

    def count(self, word: str) -> int:
        node, n = 0, 0
        for c in (*word.encode("utf-8", "surrogatepass"), END):
            while (after := self.next[node].get(c)) is None:
                n += self.pops[node]
                node = self.fail[node]
                if node < 0:
                    return 1
            node = after
        while node:
            n += self.pops[node]
            node = self.fail[node]
            if node < 0:
                return 1
        return n


def token_counts(docs: DataFrame, vocabulary: str) -> DataFrame:
    """For each row of docs: doc_id, n_words, n_tokens. vocabulary: a file as in vocabulary_pieces(), read on the driver."""
    shared = docs.sparkSession.sparkContext.broadcast(Automaton(vocabulary_pieces(vocabulary)))

    def count(batches):
        known: dict[str, int] = {}
        for b in batches:
            n_words, n_tokens = [], []
            for t in b.column("text"):
                words = WORD.findall((t.as_py() or "").lower())
                if len(known) > KNOWN_WORDS:
                    known.clear()
                for w in set(words).difference(known):
                    known[w] = shared.value.count(w)
                n_words.append(len(words))
                n_tokens.append(sum(map(known.__getitem__, words)))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_tokens, pa.int64())], names=["doc_id", "n_words", "n_tokens"])

    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(count, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_words long, n_tokens long")
