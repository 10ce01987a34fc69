"""Personal data by candidate gradient boosting.

Kinds: email, ip, card, phone. Strict patterns with their checks (Luhn, octets, digit counts) give the base spans, which
always stay. Generators of high recall propose further, possibly overlapping spans in freer formats (name at host dot
org, 1[.]2[.]3[.]4, cards with other separators, phones without a plus), several for a kind. Boosted trees score them
by format and context, a logistic curve fitted on held-out candidates turns scores into probabilities, and each kind
has a threshold, the least probability at which PRECISION of its held-out candidates were right; of overlapping spans
the best is taken, and none that touches a base span.

The trees learn from all texts: base spans found there, rewritten REWRITES times into the freer formats in their own
context, are right; the same formats with broken checks are wrong, and so is prose that the generators propose
elsewhere in those texts. What they propose there in a format that nobody writes by chance, or with its checks
fulfilled, is not used: it may well be personal data. Draws depend on the text alone. Texts without base spans give no
trees and no added spans.

Features fall into the fixed bins of GRID, and Spark counts how often each row of bins was right and wrong. Each level
of a tree is grown from sums by node, feature and bin, which tasks make of their rows and the driver adds up: numbers
of fixed size, whatever the number of texts. Sums are of integers, so the layout of docs doesn't change the model. The
curve and the thresholds come from counts by kind and 1/CELLS of a score.

Offsets count code points, ends are exclusive. Null text counts as empty. Texts are read whole, whatever their length;
no pattern takes more than linear time. Repeated rows give repeated results. Columns of docs other than doc_id and text
aren't read by find_pii, and redacted_rows returns all of them, whatever their names; no rows give no rows.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from icuflow.llm.common import discard, settle, thrifty
from icuflow.llm.wordblocks import runs

KINDS = ("email", "ip", "card", "phone")
PRECISION = 0.95
REWRITES = 8
ROUNDS, DEPTH, RATE = 40, 3, 0.3
FEATURES = 21
GRID = np.array([*range(16), 17, 19, 23, 27, 31, 39, 47, 55, 63, 95, 127, 191, np.inf])  # the greatest value of each bin
UNIT = 1 << 20  # slopes are summed as integers of this unit
CELLS, HIGHEST = 64, 16  # cells a unit of score, from -HIGHEST to HIGHEST
EXAMPLES = 1 << 16

Span = tuple[str, int, int]
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
# a match starts where a run of digits starts, and takes whole runs
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else (2 * d if d < 5 else 2 * d - 9)
    return total % 10 == 0


def octets(parts: list[str]) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in parts)


def emails(text: str) -> Iterator[tuple[int, int]]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str | None) -> list[Span]:
    """By kind as listed, then by start."""
    if not text:
        return []
    out = [("email", s, e) for s, e in emails(text)]
    if not _DIGIT.search(text):
        return out
    out += [("ip", *m.span()) for m in _IP.finditer(text) if octets(m.group().split("."))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = _NOT_DIGIT.sub("", m.group())
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", *m.span()))
    if "+" in text:
        out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= len(_NOT_DIGIT.sub("", m.group())) <= 15]
    return out


# Generators: freer formats. Runs are bounded, so that a candidate starts and ends in bounded time.
_FREE = [
    ("email", re.compile(r"(?<![\w.%+-])[\w.%+-]{1,64} ?(?:[\[({<] ?at ?[\])}>]|[\[({<]@[\])}>]) ?[A-Za-z0-9-]{1,63}(?:(?: ?[\[({<] ?(?:dot|\.) ?[\])}>] ?|\.)[A-Za-z0-9-]{2,63}){1,4}", re.I)),
    ("email", re.compile(r"(?<![\w.%+-])[\w.%+-]{1,64}(?: ?[\[({] ?at ?[\])}] ?| at | ?@ ?)[A-Za-z0-9-]{1,63}(?:(?: ?[\[({] ?dot ?[\])}] ?| dot |\. ?)[A-Za-z0-9-]{2,63}){1,4}", re.I)),
    ("ip", re.compile(r"(?<![0-9.])[0-9]{1,3}(?:(?: ?[\[({](?:\.|dot)[\])}] ?| \. | dot |, ?|\.)[0-9]{1,3}){3}(?![0-9])", re.I)),
    ("card", re.compile(r"(?<![0-9])[0-9]{4}(?:(?:[./_]| ?- ?|  )[0-9]{3,6}){2,4}(?![0-9])")),
    ("card", re.compile(r"(?<![0-9])[0-9]{1,6}(?:[ ./_-]{1,3}[0-9]{1,6}){2,9}(?![0-9])")),
    ("phone", re.compile(r"(?<![\w.+-])(?:00 ?)?[0-9]{2,4}(?:[ ./-][0-9]{2,4}){2,5}(?![\w-])")),
    ("phone", re.compile(r"(?<![\w.+-])(?:00 ?)?(?:[0-9]{1,3}[ .-])?(?:\([0-9]{2,4}\) ?|[0-9]{2,4}[ .-])[0-9]{3,4}[ .-][0-9]{3,4}(?![\w-])")),
]
_MAY_FREE_EMAIL = re.compile(r"\bat\b|@", re.I)
# Words that announce a kind, and words that announce other numbers.
CUES = {
    "email": {"email", "mail", "e", "contact", "write", "correo", "courriel"},
    "ip": {"ip", "host", "server", "address", "addr", "from"},
    "card": {"card", "visa", "credit", "mastercard", "carte", "karte", "tarjeta"},
    "phone": {"phone", "tel", "call", "fax", "mobile", "telefon", "cell"},
}
OTHER_CUES = {"version", "v", "license", "licence", "order", "id", "isbn", "page", "section", "date", "no", "number", "ref", "figure", "table"}
_BEFORE = re.compile(r"(\w+)\W*$")


def candidates(text: str, taken: list[Span]) -> list[Span]:
    """Proposed spans that touch none of those taken."""
    out: dict[Span, None] = {}
    digit = _DIGIT.search(text)
    for kind, pattern in _FREE:
        if not (digit if kind != "email" else _MAY_FREE_EMAIL.search(text)):
            continue
        for m in pattern.finditer(text):
            if not any(s < m.end() and m.start() < e for _, s, e in taken):
                out[(kind, *m.span())] = None
    return [*out]


def _may_be_right(span: Span, text: str) -> bool:
    """Of a proposal in a given text: whether it may be personal data, by its marks or checks."""
    own = text[span[1] : span[2]]
    digits, parts = _NOT_DIGIT.sub("", own), [p for p in _NOT_DIGIT.split(own) if p]
    if span[0] == "email":
        return bool(re.search(r"@|[\[({<] ?(?:at|dot|\.) ?[\])}>]|\bdot\b", own, re.I))
    return {"ip": len(parts) == 4 and octets(parts), "card": 13 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}[span[0]]


def described(span: Span, text: str) -> list[float]:
    """Format and context features."""
    kind, s, e = span
    own = text[s:e]
    digits = _NOT_DIGIT.sub("", own)
    parts = [p for p in _NOT_DIGIT.split(own) if p]
    m = _BEFORE.search(text[max(0, s - 24) : s])
    before = m.group(1).lower() if m else ""
    tail = re.split(r"[^A-Za-z0-9]+", own)[-1].lower()
    near = text[max(0, s - 1) : s] + text[e : e + 1]
    return [
        float(KINDS.index(kind)),
        float(len(digits)),
        float(len(digits) >= 12 and luhn(digits)),
        float(len(parts) == 4 and octets(parts)),
        float(len(parts)),
        float(len(own)),
        float(len({len(p) for p in parts})),
        float(sum(c in "[({" for c in own)),
        float(own.count(" ")),
        float(own.count(",")),
        float("@" in own),
        float(bool(re.search(r"[\[({] ?(?:at|dot|\.) ?[\])}]", own, re.I))),
        float(bool(re.search(r"\bdot\b", own, re.I))),
        float(len(tail)),
        float(any(c.isdigit() for c in own.split("@")[0][:12])),
        float(before in CUES[kind]),
        float(before in OTHER_CUES),
        float(any(c.isalnum() for c in near)),
        float(any(c in "=\"'/$%#" for c in near)),
        float(len(parts[0]) if parts else 0),
        float(len(parts[-1]) if parts else 0),
    ]


class Boosted:
    """Gradient-boosted regression trees for log loss, grown level by level from sums over binned rows."""

    def __init__(self, rounds: int = ROUNDS, depth: int = DEPTH, rate: float = RATE):
        self.rounds, self.depth, self.rate, self.trees, self.start = rounds, depth, rate, [], 0.0

    def fit(self, right: int, wrong: int, total: Callable[[Boosted, dict, int], np.ndarray]) -> Boosted:
        """right, wrong: how many rows there are; total: the sum of sums() over all of them."""
        rate = np.clip(right / (right + wrong), 1e-3, 1 - 1e-3)
        self.start = float(np.log(rate / (1 - rate)))
        for _ in range(self.rounds):
            self.trees.append(self._grown(total))
        return self

    def _grown(self, total):
        splits: dict[int, tuple[int, int]] = {}
        leaves: dict[int, float] = {1: 0.0}
        for level in range(self.depth):
            opened = [k for k in leaves if k >> level == 1]
            if not opened:
                break
            sums = total(self, splits, level)
            for node in opened:
                own = sums[:, node - (1 << level)]
                (g, h), n = own[:2, 0].sum(axis=1) / UNIT, own[2, 0].sum()
                leaves[node] = float(self.rate * g / (h + 1))
                if n < 10:
                    continue
                left = np.cumsum(own, axis=2)
                gl, hl = left[:2] / UNIT
                gain = gl**2 / (hl + 1) + (g - gl) ** 2 / (h - hl + 1) - g**2 / (h + 1)
                gain[(left[2] < 3) | (left[2] > n - 3)] = 0
                f, k = np.unravel_index(int(gain.argmax()), gain.shape)
                if gain[f, k] > 1e-3:
                    del leaves[node]
                    splits[node] = int(f), int(k)
                    leaves[2 * node] = float(self.rate * gl[f, k] / (hl[f, k] + 1))
                    leaves[2 * node + 1] = float(self.rate * (g - gl[f, k]) / (h - hl[f, k] + 1))

        def tree(node):
            return leaves[node] if node in leaves else (splits[node][0], float(GRID[splits[node][1]]), tree(2 * node), tree(2 * node + 1))

        return tree(1)

    def scores(self, bins: np.ndarray) -> np.ndarray:
        x, total = GRID[bins], np.zeros(len(bins))
        for t in self.trees:
            total = total + self._values(t, x)
        return self.start + total

    def sums(self, bins: np.ndarray, right: np.ndarray, wrong: np.ndarray, splits: dict, level: int) -> np.ndarray:
        """Slope, curvature (in UNITs) and rows by node of the level, feature and bin; splits: those of the tree that grows."""
        p, n = 1 / (1 + np.exp(-self.scores(bins))), right + wrong
        slope = right * UNIT - n * np.rint(p * UNIT).astype(np.int64)
        curve = n * np.rint(p * (1 - p) * UNIT).astype(np.int64)
        node = np.ones(len(bins), np.int64)
        for k in sorted(splits):
            at = node == k
            node[at] = 2 * k + (bins[at, splits[k][0]] > splits[k][1])
        live, width = node >= 1 << level, len(GRID)
        at, out = (node[live] - (1 << level)) * width, np.zeros((3, 1 << level, FEATURES, width), np.int64)
        for c, own in enumerate((slope, curve, n)):
            for f in range(FEATURES):
                out[c, :, f] = np.bincount(at + bins[live, f], own[live], width << level).astype(np.int64).reshape(-1, width)
        return out

    @staticmethod
    def _values(tree, x: np.ndarray):
        if not isinstance(tree, tuple):
            return tree
        return np.where(x[:, tree[0]] <= tree[1], Boosted._values(tree[2], x), Boosted._values(tree[3], x))

    @staticmethod
    def _value(tree, row) -> float:
        while isinstance(tree, tuple):
            tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
        return tree

    def score(self, row: list[float]) -> float:
        return self.start + sum(self._value(t, row) for t in self.trees)


def rewritten(kind: str, own: str, rng: np.random.Generator) -> tuple[str, str]:
    """A span in a freer format, and one that looks alike but is wrong."""
    pick = lambda *x: x[int(rng.integers(len(x)))]
    digits = _NOT_DIGIT.sub("", own)
    other = lambda n: "".join(str(d) for d in rng.integers(0, 10, n))
    if kind == "email":
        at, dot = pick((" at ", " dot "), (" [at] ", " [dot] "), ("(at)", "(dot)"), (" @ ", "."), (" [at] ", "."))
        local, domain = own.split("@", 1)
        letters = lambda low, high: "".join(chr(97 + c) for c in rng.integers(0, 26, int(rng.integers(low, high))))
        if rng.random() < 0.5:  # other names than those of the sample
            local, domain = pick(letters(2, 10), letters(2, 8) + pick(".", "_", "-") + letters(2, 9), letters(2, 8) + other(2)), letters(3, 12) + "." + pick("com", "org", "net", "io", letters(2, 4))
        return local + at + domain.replace(".", dot), f"{pick('look', 'the', 'was', 'stay', 'good')} at {pick('the', 'home', 'least', 'this')} {pick('dot', 'dot')} {pick('the', 'of', 'and')}"
    if kind == "ip":
        sep = pick("[.]", "(.)", " . ", " dot ", "[dot]")
        numbers = rng.integers(0, 256, 4) if (listed := rng.random() < 0.4) else rng.integers(0, 999, 4) + pick(0, 256)
        return own.replace(".", sep), (", " if listed else pick(", ", ".", sep)).join(map(str, numbers))
    if kind == "card":
        sep = pick(".", "/", "_", " - ", "  ")
        groups = [digits[k : k + 4] for k in range(0, len(digits), 4)]
        if len(groups[-1]) < 3:
            groups[-2:] = [groups[-2] + groups[-1]]
        wrong = sep.join([other(4) for _ in range(4)])
        return sep.join(groups), wrong if not luhn(_NOT_DIGIT.sub("", wrong)) else wrong[:-1] + str((int(wrong[-1]) + 1) % 10)
    national = digits[-10:].rjust(10, "5")
    shape = pick("({}) {}-{}", "{}-{}-{}", "{}.{}.{}", "1 ({}) {}-{}", "001 {} {} {}")
    return shape.format(national[:3], national[3:6], national[6:]), pick("{}-{}-{}", "{} {} {}", "{}.{}.{}").format(other(pick(2, 4)), other(3), other(pick(3, 4)))


class PiiModel:
    """The trees, the curve from their scores to probabilities, and each kind's threshold; no trees: nothing is added."""

    def __init__(self, trees: Boosted | None, thresholds: dict[str, float], curve: tuple[float, float] = (1.0, 0.0)):
        self.trees, self.thresholds, self.curve = trees, thresholds, curve

    def curved(self, score: float) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.curve[0] * score + self.curve[1], -30, 30))))

    def probability(self, row: list[float]) -> float:
        return self.curved(self.trees.score(row))

    def added(self, text: str, base: list[Span]) -> list[Span]:
        if self.trees is None:
            return []
        scored = [(self.probability(described(c, text)), c) for c in candidates(text, base)]
        out: list[Span] = []
        for score, span in sorted(scored, key=lambda x: (-x[0], x[1][1:], KINDS.index(x[1][0]))):
            if score >= self.thresholds.get(span[0], np.inf) and not any(s < span[2] and span[1] < e for _, s, e in out):
                out.append(span)
        return out

    def spans(self, text: str | None) -> tuple[list[Span], list[Span]]:
        """Base spans and all spans, each by kind, then start."""
        base = base_spans(text)
        return base, sorted([*base, *self.added(text or "", base)], key=lambda x: (KINDS.index(x[0]), x[1:]))


def platt(scores: np.ndarray, right: np.ndarray, wrong: np.ndarray) -> tuple[float, float]:
    """Slope and intercept of the logistic curve from scores to the share that is right, by Newton's method; shares keep off 0 and 1. right, wrong: rows of each score."""
    n, high, low = right + wrong, (right.sum() + 1) / (right.sum() + 2), 1 / (wrong.sum() + 2)
    hits = right * high + wrong * low
    x, b = np.stack([scores, np.ones(len(scores))], axis=1), np.array([1.0, 0.0])
    for _ in range(20):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        curve = (x * (n * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        b = b + np.linalg.solve(curve, x.T @ (hits - n * p) - 1e-3 * (b - [1.0, 0.0]))
    return (float(b[0]), float(b[1])) if np.isfinite(b).all() and b[0] > 0 else (1.0, 0.0)


def examples(text: str, seed: int = 11) -> Iterator[tuple[list[float], bool]]:
    """What a text teaches: described candidates, and whether they are right. Draws of rewrites depend on text and seed."""
    base = base_spans(text)
    if base:
        rng = np.random.default_rng([seed, xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass"))])
        for kind, s, e in base * REWRITES:
            for label, own in zip((1, 0), rewritten(kind, text[s:e], rng), strict=True):
                cue = sorted(CUES[kind])[int(rng.integers(len(CUES[kind])))] + ": " if rng.random() < 0.3 and label else ""
                made = text[max(0, s - 40) : s] + cue + own + text[e : e + 40]
                at = len(text[max(0, s - 40) : s] + cue)
                for c in candidates(made, []):
                    if c[1] < at + len(own) and at < c[2]:
                        yield described(c, made), bool(label and c[0] == kind and abs(c[1] - at) <= 1 and abs(c[2] - at - len(own)) <= 1)
    for c in candidates(text, base):
        if not _may_be_right(c, text):
            yield described(c, text), False


def counted(texts: Iterable[str], most: int = EXAMPLES) -> Iterator[dict[bytes, np.ndarray]]:
    """Rows of bins with the numbers of examples: right and wrong to learn from, right and wrong kept out (a third). A new dictionary once one has most rows."""
    found: dict[bytes, np.ndarray] = {}
    for text in texts:
        digest = xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass"))
        for k, (row, right) in enumerate(examples(text)):
            kept = xxhash.xxh3_64_intdigest(k.to_bytes(8, "little"), digest) % 3 == 0
            key = np.searchsorted(GRID, row).astype(np.uint8).tobytes()
            found.setdefault(key, np.zeros(4, np.int64))[2 * kept + (not right)] += 1
        if len(found) >= most:
            yield found
            found = {}
    yield found


def cells(trees: Boosted, bins: np.ndarray, right: np.ndarray, wrong: np.ndarray) -> np.ndarray:
    """How many rows are right and wrong, by kind and cell of the score."""
    width = 2 * HIGHEST * CELLS
    at = bins[:, 0].astype(np.int64) * width + np.clip(np.floor(trees.scores(bins) * CELLS) + width // 2, 0, width - 1).astype(np.int64)
    return np.stack([np.bincount(at, own, len(KINDS) * width).astype(np.int64).reshape(-1, width) for own in (right, wrong)])


def fitted(counts: np.ndarray, total: Callable[[Callable], np.ndarray]) -> PiiModel:
    """counts: the numbers of examples; total(f): the sum of f(bins, counts) over all rows."""
    if not counts[::2].sum() or not counts[1::2].sum() or counts.sum() < 50:
        return PiiModel(None, {})
    trees = Boosted().fit(*counts[:2].tolist(), lambda own, splits, level: total(lambda bins, n: own.sums(bins, n[:, 0], n[:, 1], splits, level)))
    found = total(lambda bins, n: cells(trees, bins, n[:, 2], n[:, 3]))
    lowest = np.arange(found.shape[2]) / CELLS - HIGHEST
    model = PiiModel(trees, {}, platt(lowest + 0.5 / CELLS, *found.sum(axis=1)))
    for k, kind in enumerate(KINDS):
        hits, n, model.thresholds[kind] = 0, 0, np.inf
        for cell in np.flatnonzero(found[:, k].sum(axis=0))[::-1].tolist():
            hits, n = hits + found[0, k, cell], n + found[:, k, cell].sum()
            if n >= 10 and hits / n >= PRECISION and (score := model.curved(lowest[cell])) > 0.5:
                model.thresholds[kind] = score
    return model


def _unpacked(rows: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(rows), np.uint8).reshape(-1, FEATURES)


def fit(texts: Iterable[str]) -> PiiModel:
    """The model of these texts, here."""
    (found,) = counted(texts, 1 << 62)
    bins, counts = _unpacked([*found]), np.array([*found.values()], np.int64).reshape(-1, 4)
    return fitted(counts.sum(axis=0), lambda f: f(bins, counts))


def learn(docs: DataFrame) -> PiiModel:
    """The model of all texts of docs."""
    names = ["n0", "n1", "n2", "n3"]

    def count(batches):
        for found in counted(t for b in batches for _, own in runs(b.column("text")) for t in own):
            counts = np.array([*found.values()], np.int64).reshape(-1, 4)
            yield pa.RecordBatch.from_arrays([pa.array([*found], pa.binary()), *map(pa.array, counts.T)], names=["row", *names])

    texts = docs.select(F.col("text").cast("string").alias("text")).where("text is not null")
    rows = texts.mapInArrow(thrifty(count), "row binary, " + ", ".join(f"{n} long" for n in names))
    table = settle(rows.groupBy("row").agg(*(F.sum(n).alias(n) for n in names)), "examples")

    def total(f: Callable) -> np.ndarray:
        def add(batches):
            out = 0
            for b in batches:
                if b.num_rows:
                    out = out + f(_unpacked(b.column("row").to_pylist()), np.stack([b.column(n).to_numpy() for n in names], axis=1))
            if not isinstance(out, int):
                yield pa.RecordBatch.from_arrays([pa.array([out.tobytes()]), pa.array([list(out.shape)], pa.list_(pa.int32()))], names=["sums", "shape"])

        return sum(np.frombuffer(r["sums"], np.int64).reshape(r["shape"]) for r in table.mapInArrow(add, "sums binary, shape array<int>").collect())

    counts = np.array(table.agg(*(F.coalesce(F.sum(n), F.lit(0)) for n in names)).first(), np.int64)
    model = fitted(counts, total)
    discard(table)
    return model


def find_pii(docs: DataFrame) -> DataFrame:
    """For each row of docs: doc_id, base and spans (arrays of kind, start, end)."""
    shared = docs.sparkSession.sparkContext.broadcast(learn(docs))
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
    listed = lambda spans: [{"kind": k, "start": s, "end": e} for k, s, e in spans]

    def find(batches):
        for b in batches:
            for start, texts in runs(b.column("text")):
                found = [shared.value.spans(t) for t in texts]
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(start, len(texts)), *(pa.array([listed(f[k]) for f in found], kind) for k in (0, 1))], names=["doc_id", "base", "spans"])

    struct = "array<struct<kind:string,start:int,end:int>>"
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(thrifty(find), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, base {struct}, spans {struct}")


def redact(text: str, spans: list[Span]) -> str:
    """Each run of touching spans becomes the first one's kind in brackets."""
    out, at, runs = [], 0, []
    for kind, s, e in sorted(spans, key=lambda x: (x[1], -x[2])):
        if runs and s < runs[-1][2]:
            runs[-1][2] = max(runs[-1][2], e)
        else:
            runs.append([kind, s, e])
    for kind, s, e in runs:
        out += [text[at:s], f"[{kind.upper()}]"]
        at = e
    return "".join([*out, text[at:]])


def redacted_rows(docs: DataFrame) -> DataFrame:
    """docs with the spans in text redacted; n_chars, if there, is the new length. Rows without spans stay as they are."""
    shared, names = docs.sparkSession.sparkContext.broadcast(learn(docs)), docs.columns

    def clean(batches):
        for b in batches:
            for start, old in runs(b.column(names.index("text"))):
                part = b.slice(start, len(old))
                found = [shared.value.spans(t)[1] for t in old]
                texts = [redact(t, s) if s else t for t, s in zip(old, found, strict=True)]
                columns = list(part.columns)
                columns[names.index("text")] = pa.array(texts, part.column(names.index("text")).type)
                if "n_chars" in names:
                    k = names.index("n_chars")
                    columns[k] = pa.array([len(t) if s else n for t, s, n in zip(texts, found, part.column(k).to_pylist(), strict=True)], part.column(k).type)
                yield pa.RecordBatch.from_arrays(columns, schema=b.schema)

    return docs.mapInArrow(thrifty(clean), docs.schema)


def pii_report(docs: DataFrame) -> DataFrame:
    """The columns of the contract, derived from find_pii(). Counts are of base spans."""
    found = find_pii(docs)
    joined = lambda c: F.concat_ws(",", F.transform(c, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))))
    number = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(number, KINDS), F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"), (F.size("spans") - F.size("base")).cast("long").alias("n_added"))
