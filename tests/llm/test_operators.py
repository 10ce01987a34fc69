"""Each operator against brute force or the library, on odd rows, and on empty tables."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from helpers import DATA, rows_of
from pyspark.sql import functions as F

from icuflow.llm import bpe, decontamination, jaccard, language_id, pii, pseudo_likelihood, queries, token_counts, token_files, topk, toxicity, wordblocks

BYTES, WORDS = (public_tokenizers.path(f) for f in ("byte_bpe_50k.json", "word_bpe_49k.json"))


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_same_rows_as_sql(spark, duck, name):
    got, wanted = queries.QUERIES[name](spark, DATA).toPandas(), duck.execute(queries.ORACLE_SQL[name]).df()
    assert rows_of(got) == rows_of(wanted) and len(got)


def library(path):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


# 1 personal data


def brute_spans(text):
    patterns = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    out = []
    for kind, p in patterns.items():
        for m in re.finditer(p, text or ""):
            d = re.sub(r"[^0-9]", "", m.group())
            ok = {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m.group().split(".")), "card": 13 <= len(d) <= 19 and pii.luhn(d), "phone": 9 <= len(d) <= 15}
            if ok[kind]:
                out.append((kind, *m.span()))
    return out


def test_base_spans(rng):
    parts = ["a", "b.c", "@", "@", "1", "23", "255", "256", "007", ".", ".", "-", " ", "+", "(", ")", "4111111111111111", "_", "é", "%"]
    for _ in range(5000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(1, 25)))
        assert pii.base_spans(text) == brute_spans(text)


def test_long_runs_take_linear_time():
    for text in ("1" * 300_000, "a" * 300_000, "1." * 150_000, "+1 " * 100_000, "a@" * 100_000, "1-" * 150_000):
        pii.base_spans(text)


def test_trees_find_free_formats_and_keep_base(spark):
    rows = [f"write to user{k}@mail{k % 7}.example.com or call +1 (555) 010-{1000 + k} from 10.0.{k % 250}.7 with 4111111111111111 now" for k in range(120)]
    model = pii.fit(rows)
    text = "number 4111.1111.1111.1111 end"
    assert model.spans(text) == ([], [("card", 7, 26)]) and pii.redact(text, model.spans(text)[1]) == "number [CARD] end"
    assert model.spans("version 2.0 of 2024-01-12, page 17 of 300, at home by the river")[1] == []
    base, spans = model.spans(rows[0])
    assert set(base) <= set(spans) and len(base) == 4
    assert pii.redact(rows[0], spans).count("[EMAIL]") == 1


def test_planted_free_formats_in_given_documents(spark, rng):
    """Recall of each kind's free formats planted into the given documents, by a model that learned from those as they are; and what it adds to them."""
    texts = [r["text"] for r in spark.read.parquet(f"{DATA.replace('sf0.001', 'sf0.01')}/documents.parquet").collect() if r["text"]]
    model = pii.fit(sorted(set(texts)))
    assert all(t < 1 for t in model.thresholds.values()) and set(model.thresholds) == set(pii.KINDS)
    cards = [c for c in (f"{rng.randrange(10**15, 10**16)}" for _ in range(1000)) if pii.luhn(c)]

    def made(kind):
        n = lambda a, b: rng.randrange(a, b)
        if kind == "email":
            return "".join(rng.choices("abcdefghij", k=n(3, 9))) + rng.choice([" [at] ", " (at) ", "[at]"]) + rng.choice(["corp", "mailbox", "site"]) + rng.choice([" [dot] ", " (dot) ", "."]) + rng.choice(["com", "org"])
        if kind == "ip":
            return rng.choice(["[.]", "(.)", "[dot]"]).join(str(n(0, 256)) for _ in range(4))
        c = rng.choice(cards)
        return rng.choice([".", "/", "_"]).join(c[k : k + 4] for k in range(0, 16, 4)) if kind == "card" else f"({n(200, 999)}) {n(200, 999)}-{n(1000, 9999)}"

    for kind in pii.KINDS:
        found = 0
        for text in rng.sample(texts, 60):
            words = text.split(" ")
            at, own = rng.randrange(len(words) + 1), made(kind)
            start = len(" ".join([*words[:at], ""]))
            found += (kind, start, start + len(own)) in model.spans(" ".join([*words[:at], own, *words[at:]]))[1]
        assert found >= 42, (kind, found)
    added = [(k, t[s:e]) for t in texts for k, s, e in model.added(t, pii.base_spans(t))]
    assert len(added) <= 5
    assert model.added("see version 1.2.3 and page 12, 13, 14, 15, on 2024-01-15, when they look at the house. Then go", []) == []


def test_model_learns_from_all_texts_in_any_layout(spark):
    texts = [f"{k} mail user{k}@host{k % 11}.example.org" if k % 2 else f"{k} of {k % 250}, {k % 13}, 7, 999" for k in range(4000)]
    docs = spark.createDataFrame([(t,) for t in [*texts, None, ""]], "text string")
    whole = pii.fit(texts)
    for layout in (docs.coalesce(1), docs.repartition(5)):
        model = pii.learn(layout)
        assert (model.trees.trees, model.trees.start, model.thresholds, model.curve) == (whole.trees.trees, whole.trees.start, whole.thresholds, whole.curve)
    counts = sum(n for found in pii.counted(texts, 50) for n in found.values())
    assert counts.sum() == sum(1 for t in texts for _ in pii.examples(t)) >= 2000 * pii.REWRITES


def test_pii_report(spark, odd, none):
    assert pii.pii_report(odd).count() == odd.count() and pii.pii_report(none).count() == 0
    empty = hashlib.sha256(b"").hexdigest()
    assert {r["base_sha256"] for r in pii.pii_report(odd).collect()} == {empty}
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in pii.pii_report(docs).collect():
        spans = ",".join(f"{k}:{s}:{e}" for k, s, e in brute_spans(texts[r["doc_id"]]))
        assert r["base_sha256"] == hashlib.sha256(spans.encode()).hexdigest()
    clean = pii.redacted_rows(odd)
    assert clean.columns == odd.columns and clean.count() == odd.count()


# 2 pseudo-likelihood


def test_log_probabilities_by_hand():
    net = pseudo_likelihood.Network()
    net.part["class_bias"][3] = 50  # so large that exponentials are shifted
    for large in (True, False):
        rows = [np.array([5, 9, 700], np.int16), np.array([], np.int16), np.array([3], np.int16)]
        flat, at = pseudo_likelihood.stream(rows)
        around, words = np.stack([flat[at + k] for k in (-2, -1, 1, 2)], axis=1), flat[at]
        assert around.tolist() == [[0, 0, 9, 700], [0, 5, 700, 0], [5, 9, 0, 0], [0, 0, 0, 0]] and words.tolist() == [5, 9, 700, 3]
        assert net._large() == large
        h = np.tanh(sum(net.part["table"][k][around[:, k]] for k in range(4)) + net.part["squash"]).astype(float)
        joint = np.zeros((4, pseudo_likelihood.CLASSES**2))
        c = h @ net.part["classes"] + net.part["class_bias"]
        pc = np.exp(c) / np.exp(c).sum(1, keepdims=True)
        for k in range(pseudo_likelihood.CLASSES):
            m = h @ net.part["members"][k] + net.part["member_bias"][k]
            joint[:, k * 32 : k * 32 + 32] = pc[:, [k]] * np.exp(m) / np.exp(m).sum(1, keepdims=True)
        assert np.allclose(joint.sum(1), 1, atol=1e-5)
        assert np.allclose(net.log_probabilities(flat, at), np.log(joint[np.arange(4), words]), atol=1e-4)
        net.part["class_bias"][3] = 0


def test_gradient_by_differences():
    """One step of training moves each weight against the slope of the loss."""
    rng = np.random.default_rng(3)
    flat, at = pseudo_likelihood.stream([rng.integers(1, 1024, 50).astype(np.int16)])
    net = pseudo_likelihood.Network()
    loss, before = lambda: -net.log_probabilities(flat, at).mean(), net.flat.copy()
    net.train(flat, at)
    moved, after = net.flat - before, net.flat.copy()
    checked = 0
    for k in np.argsort(-np.abs(moved))[::400][:60]:
        slope = []
        for d in (0.02, -0.02):
            net.flat[:] = before
            net.flat[k] += d
            slope.append(loss())
        slope = (slope[0] - slope[1]) / 0.04
        if abs(slope) > 1e-4:
            checked += 1
            assert moved[k] * slope < 0
    net.flat[:] = after
    assert checked > 10


def test_scores_by_brute_force(spark, odd, none):
    """Exact counts of all words, and each document's sum word by word, from the trained weights; the layout of the rows changes nothing."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").unionByName(odd.select((F.col("doc_id") + 10_000).alias("doc_id"), "text"))
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    made, values, words, masses = pseudo_likelihood.prepared(docs, block_chars=100_000)
    counts = Counter(w for r in docs.collect() for w in pseudo_likelihood.words_of(r["text"] or ""))
    most = pseudo_likelihood.CLASSES**2 - pseudo_likelihood.HASHED - 1
    assert words == sorted(counts, key=lambda w: (-counts[w], w))[:most] and len(counts) > most
    rest = Counter()
    for w, n in counts.items():
        if w not in set(words):
            rest[pseudo_likelihood.hash_of(w)] += n
    assert masses.tolist() == [rest[c] for c in range(pseudo_likelihood.HASHED)]
    net, id_of, log = pseudo_likelihood.Network(pseudo_likelihood.averaged_round(made, values, pseudo_likelihood.Network().flat)), pseudo_likelihood.Ids(words), {}
    got = {r["doc_id"]: r for r in pseudo_likelihood.score_documents(docs, block_chars=100_000).collect()}
    other = {r["doc_id"]: r for r in pseudo_likelihood.score_documents(docs.repartition(7, "text"), block_chars=100_000).collect()}
    better = 0.0
    for d, text in texts.items():
        own = pseudo_likelihood.words_of(text or "")
        flat, at = pseudo_likelihood.stream([np.array([id_of(w) for w in own], np.int16)])
        wanted = net.log_probabilities(flat, at).sum() + sum(np.log(counts[w] / rest[pseudo_likelihood.hash_of(w)]) for w in own if w not in id_of.own)
        better += net.log_probabilities(flat, at).sum() - pseudo_likelihood.Network().log_probabilities(flat, at).sum()
        assert got[d]["n_words"] == len(own) and abs(got[d]["score"] - wanted) < 1e-3 + 1e-4 * abs(wanted)
        assert abs(got[d]["score"] - other[d]["score"]) < 1e-6 + 1e-6 * abs(wanted) and (got[d]["mean_score"] is None) == (not own)
    assert better > 0.5 * sum(counts.values())
    assert pseudo_likelihood.score_documents(none).count() == 0


def test_packing(rng):
    for numbers in ([], [0], [0, 0, 0], [255, 256, 65536, 2**32 - 1], [rng.randrange(1 << 20) for _ in range(1000)]):
        assert wordblocks.unpack(wordblocks.pack(np.array(numbers, np.uint32))).tolist() == numbers
    for words in ([], [""], ["a\n", "", "\x00é😀", " x"]):
        assert wordblocks.unpack_words(wordblocks.pack_words(words)) == words


# 3 toxicity


@pytest.fixture(scope="module")
def toxic(spark):
    clean, bad = ["the river runs by the old house", "we walk to the market each day"], ["you are an idiot", "what a stupid moron", "such pathetic trash"]
    rows = [(k, " ".join([clean[k % 2], bad[k % 3] if k % 5 == 0 else "", f"note{k}", "and so it goes on and on"]), int(k % 5 == 0)) for k in range(600)]
    return spark.createDataFrame(rows, "doc_id long, text string, toxic int")


def test_hidden_words_are_found(spark, toxic):
    model = toxicity.learn(toxic, toxic.select("doc_id", "toxic"))
    assert [model.characters.restore(w) for w in ("1d10t", "idiooot", "m0r0n", "p@th3tic", "i d i o t")] == ["idiot", "idiot", "moron", "pathetic", "idiot"]
    model.start()
    scores = model.scores(["we walk to the market each day and so it goes on", "you are an 1d10t and so it goes on", "you are an i d i o t and so it goes on", None, ""])
    assert scores[0] < 0.3 and min(scores[1:3]) > 0.3 and max(scores[3:]) < 0.6
    assert model.restorer.words("clean words stay stay") == (set(), 3)
    assert toxicity.Restorer(model.characters).words("clean words stay") == ({"clean", "words", "stay"}, 3)


def test_scores_ignore_held_out_labels(spark, toxic, odd, none):
    flipped = toxic.withColumn("toxic", F.when(toxicity.held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = (sorted(map(tuple, toxicity.score_toxicity(toxic, x.select("doc_id", "toxic")).collect())) for x in (toxic, flipped))
    assert a == b
    held = [r for r in a if r[1]]
    assert sum((r[3] == 1) == (r[0] % 5 == 0) for r in held) > 0.95 * len(held)
    labels = toxic.select("doc_id", "toxic")
    assert toxicity.score_toxicity(odd, labels.limit(0)).count() == odd.count() and toxicity.score_toxicity(odd, labels).count() == odd.count()
    assert toxicity.score_toxicity(none, labels).count() == 0


@pytest.mark.parametrize("hidden", ["idi0t", "hi/1diot", "x,1diot", "1diot", "i d-i o.t", "i  d  i  o  t", "i\td\ti\to\tt", "i\nd\ni\no\nt", "i d ! o t", "i--d--i--o--t", "id--iot", "idi..ot", "iidiot", "!diot", "idioott"])
def test_every_hidden_form_is_decoded(spark, toxic, hidden):
    model = toxicity.learn(toxic, toxic.select("doc_id", "toxic"))
    model.start()
    assert "idiot" in model.restorer.words(f"you are an {hidden} and so")[0]


@pytest.mark.parametrize("form", ["as$", "dumbas$", "a$$", "a55", "f**k", "st--upid", "a s s", "stuppid"])
def test_every_hidden_form_reaches_the_lattice(form):
    restorer, seen = toxicity.Restorer(toxicity.CharacterModel({})), []
    restorer.model.restore = lambda x: seen.append(x) or ""
    restorer.words(f"so {form} it is")
    assert form in seen


def test_decoding_by_enumeration(rng):
    """restore() gives the likeliest of all paths through the lattice, and its result has the skeleton of what was observed."""
    counts = {}
    for w in ["idiot", "stupid", "about", "oil", "toll", "see", "as"] * 20:
        for i in toxicity.trigram_ids(w).tolist():
            counts[i] = counts.get(i, 0) + 1
    model = toxicity.CharacterModel(counts)

    def paths(seen, done=""):
        if not seen:
            yield done, 0.0
            return
        c, imitated = seen[0], toxicity.IMITATES.get(seen[0], "")
        means = ([(c, 0.0)] if c in model.code else []) + [(x, toxicity.COST_IMITATES) for x in imitated]
        steps = [(done + x, cost) for x, cost in means]
        repeats = bool(done) and (c == done[-1] or done[-1] in imitated)
        if repeats or not means:
            steps.append((done, toxicity.COST_REPEATS if repeats else toxicity.COST_SEPARATES))
        for now, cost in steps:
            for word, rest in paths(seen[1:], now):
                yield word, rest + cost

    def value(word, cost):
        codes = [0, 0, *(model.code[c] for c in word), 0]
        return sum(model.log[a][b][c] for a, b, c in zip(codes, codes[1:], codes[2:], strict=False)) - cost

    for _ in range(400):
        seen = "".join(rng.choice("idots01!|5$- .aalll2") for _ in range(rng.randint(1, 8)))
        got, all_ = model.restore(seen), [(value(w, cost), w) for w, cost in paths(seen)]
        assert abs(max(v for v, w in all_ if w == got) - max(all_)[0]) < 1e-9
        assert toxicity.skeleton(got) == toxicity.skeleton(seen)


def test_scoring_decodes_all_that_counts(spark, toxic):
    """With odds the same words with odds are found as without them."""
    model, text = toxicity.learn(toxic, toxic.select("doc_id", "toxic")), "an 1d10t, a m0r0n; i d i o t s  st--upid idiooots p@thet1c/trash hello l00k 100 2.5 foo--bar"
    model.start()
    every = toxicity.Restorer(model.characters).words(text)[0]
    assert model.restorer.words(text)[0] == {w for w in every if any(f in model.odds for f in toxicity.features_of(w))}


def test_decoding_is_linear():
    toxicity.CharacterModel({}).restore("a " * 50_000)


# 4 languages


def test_languages(spark, odd, none):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    got = language_id.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r["lang_pred"] == r["lang"] for r in got) >= 0.9 * len(got)
    assert all(0 <= r["score"] <= 1 for r in got)
    shuffled = docs.withColumn("lang", F.when(language_id.held_out(), F.lit("xx")).otherwise(F.col("lang")))
    assert "xx" not in language_id.learn(shuffled).languages
    by_id = {r["doc_id"]: r for r in language_id.identify(odd).collect()}
    assert all(by_id[k]["lang_pred"] == "und" and by_id[k]["score"] == 0 for k in (0, 1, 2))
    assert language_id.identify(none).count() == 0
    kept = language_id.accepted_rows(docs)
    assert kept.columns == docs.columns and kept.count() >= 0.98 * docs.count()


# 5 decontamination


def test_hits_by_brute_force(rng):
    for _ in range(300):
        items = [(k, " ".join(rng.choice("abcd") for _ in range(rng.choice([0, 1, 2, 3, 4, 6])))) for k in range(4)]
        doc = [rng.choice("abcde") for _ in range(rng.randint(0, 30))]
        hit, found = set(), set()
        for k, text in items:
            own = text.split()
            n = min(3, len(own))
            for s in range(max(1, len(own) - 2) if own else 0):
                for at in range(len(doc) - n + 1):
                    if doc[at : at + n] == own[s : s + n]:
                        hit |= set(range(at, at + n))
                        found.add(k)
        m = decontamination.Matcher([(k, t.encode()) for k, t in items], window=3)
        n, spans, got = m.search(" ".join(doc).encode())
        assert (n, got) == (len(doc), found) and {x for s, e in spans for x in range(s, e)} == hit


def test_decontamination_edges(spark, odd, none):
    bench = spark.createDataFrame([(1, "Same TEXT here"), (2, None), (None, "x"), (3, ""), (1, "Same TEXT here")], "item_id long, text string")
    got = {r["doc_id"]: r for r in decontamination.contamination_report(odd, bench).collect()}
    assert got[12]["n_hit"] == 3 and got[12]["n_items"] == 1 and not got[4]["contaminated"] and got[0]["n_words"] == 0
    assert decontamination.contamination_report(none, bench).count() == 0 and decontamination.contamination_report(odd, bench.limit(0)).where("contaminated").isEmpty()
    assert decontamination.clean_rows(odd, bench).columns == odd.columns
    a = decontamination.contamination(spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/benchmark.parquet"))
    b = decontamination.contamination(spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/benchmark.parquet"), block_bytes=2000)
    assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))


# 6 byte-pair encoding


@pytest.mark.parametrize("bounds", [{}, {"block_chars": 20_000}])
def test_bpe_equals_library(spark, odd, none, bounds):
    extra = ["\n\n x<|endoftext|> y", "<|endoftext|>", "  x 　y  z", "é" * 300 + " " + "x" * 3000, "tab\t here \t\t there", "１２ ½ 3", "😀 😀😀  "]
    docs = odd.select("doc_id", "text").unionByName(spark.createDataFrame([(100 + k, t) for k, t in enumerate(extra)], "doc_id long, text string")).unionByName(spark.read.parquet(f"{DATA}/documents.parquet").select((F.col("doc_id") + 1000).alias("doc_id"), "text"))
    tk, wanted = library(BYTES), []
    for r in docs.collect():
        ids = tk.encode(r["text"] or "", add_special_tokens=False).ids
        wanted.append((str(r["doc_id"]), len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(tk.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert sorted((str(r[0]), *r[1:]) for r in bpe.bpe_report(docs, BYTES, **bounds).collect()) == sorted(wanted)
    assert bpe.bpe_report(none, BYTES, **bounds).count() == 0


# 7 near duplicates


def brute_components(docs):
    def grams(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())
        return {tuple(w[i : i + 3]) for i in range(max(1, len(w) - 2))} if w else set()

    sets, up = [(d, grams(t)) for d, t in docs], {d: d for d, _ in docs}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, (d, x) in enumerate(sets):
        for e, y in sets[:i]:
            if x and y and 100 * len(x & y) >= 90 * len(x | y):
                a, b = find(d), find(e)
                up[max(a, b)] = min(a, b)
    return sorted((d, len(g), find(d)) for d, g in sets)


@pytest.mark.parametrize("bounds", [{}, {"hot": 1, "part_grams": 50}])
def test_components_by_brute_force(spark, rng, bounds):
    bases = [[f"w{rng.randrange(300)}" for _ in range(n)] for n in (1, 2, 3, 9, 10, 11, 12, 25, 60, 60, 200)]
    docs = []
    for k in range(300):
        w = list(rng.choice(bases))
        for _ in range(rng.randint(0, max(1, len(w) // 40))):
            w[rng.randrange(len(w))] = f"w{rng.randrange(300)}"
        docs.append((k, " ".join(w)))
    docs += [(1000, None), (1001, ""), (1002, "  "), (1003, docs[3][1]), (1003, docs[3][1])]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert sorted(map(tuple, jaccard.near_duplicates(df, **bounds).collect())) == brute_components(docs)


def test_ids_with_two_texts(spark, rng):
    """Each text of an id links on its own; the stage keeps one row of each component."""
    rows, text = [], lambda: " ".join(f"w{rng.randrange(400)}" for _ in range(60))
    for k in range(40):
        a, b = text(), text()
        rows += [(k, a, "x"), (k, b, "y"), (100 + k, a + " end", "x"), (200 + k, b + " end", "y"), (200 + k, b + " end", "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, kept_id string")
    got = {r["doc_id"]: r["component_id"] for r in jaccard.near_duplicates(df).collect()}
    assert all(got[100 + k] == got[200 + k] == got[k] == k for k in range(40))
    kept = jaccard.deduplicated_rows(df)
    assert kept.columns == df.columns and sorted(map(tuple, kept.collect())) == sorted(r for r in rows if r[0] < 100)


def test_large_groups_of_near_copies(spark, rng):
    """A chain of edits, two groups that share most of their n-grams, and a passage that unlike texts share."""
    base = [f"a{k}" for k in range(300)]
    docs, own = [], list(base)
    for k in range(40):
        own = list(own)
        own[rng.randrange(300)] = f"e{k}"
        docs.append((k, " ".join(own)))
    far = base[:255] + [f"b{k}" for k in range(45)]
    docs += [(200 + k, " ".join([*far[:270], f"f{k}", *far[271:]])) for k in range(40)]
    docs += [(300 + k, " ".join([*(f"p{k}" for k in range(12)), *(f"q{k}.{j}" for j in range(13))])) for k in range(40)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    for bounds in ({}, {"hot": 1, "part_grams": 1000}):
        assert sorted(map(tuple, jaccard.near_duplicates(df, **bounds).collect())) == brute_components(docs)


def test_first_pivots_are_met_where_they_are_ranked(spark, rng):
    """The same pairs as a join of all rows with all pivots, salted or not."""
    base = [f"a{k}" for k in range(80)]
    docs = [(k, " ".join([*base[: rng.randrange(60, 80)], f"b{k % 3}", f"c{k}"])) for k in range(30)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    for hot in (1, 10_000):
        sketch = jaccard.sketch_of(jaccard.surveyed(df, 3))
        rows = jaccard.placed(jaccard.shared_grams(jaccard.prefixes(df, sketch, 3, 80, hot))).localCheckpoint()
        ids = {g: sorted((r["first"], r["cls"]) for r in rows.collect() if r["gram"] == g) for g in {r["gram"] for r in rows.collect()}}
        for k in (1, 4):
            ranked = jaccard.ranked(rows, k, 80).localCheckpoint()
            pivots = ranked.where(ranked["rank"] <= k)
            assert {(r["gram"], r["cls"]) for r in pivots.collect()} == {(g, c) for g, own in ids.items() for _, c in own[:k]} and ranked.count() == rows.count()
            joined = jaccard.candidate_pairs(rows, pivots.drop("rank", "u", "m"), 80)
            assert sorted(map(tuple, jaccard.met_pairs(ranked, k, 80).collect())) == sorted(map(tuple, joined.collect())) != []
        if hot > 1:  # no row meets its n-gram's first pivot by a join
            assert ranked.where("u is not null").count() and not ranked.where("salts > 1").count()


def test_bounds_of_common_ngrams(rng):
    """Neither histograms nor the suffix filter rule out what two sets share."""
    for n in (3, 50, 3000, 40_000):
        x = np.unique(np.array([rng.getrandbits(64) for _ in range(n)], np.uint64))
        for kept in (0, 0.5, 0.95, 1):
            y = np.unique(np.concatenate([x[: int(kept * n)], np.array([rng.getrandbits(64) for _ in range(n - int(kept * n))], np.uint64)]))
            common = np.intersect1d(x, y).size
            assert jaccard.most_common([jaccard.histogram(x)], [jaccard.histogram(y)])[0] >= common and jaccard.suffixes_allow(x, y, common)
            assert n < 3000 or kept > 0.5 or not jaccard.suffixes_allow(x, y, n)


def test_near_duplicate_edges(odd, none):
    got = jaccard.near_duplicates(odd).collect()
    assert len(got) == odd.count() and all(r["component_id"] is None for r in got if r["doc_id"] is None)
    assert {r["component_id"] for r in got if r["doc_id"] in (12, 13)} == {12}
    assert jaccard.near_duplicates(none).count() == 0


# 8 search


def test_search_edges(spark):
    rows = [(0, [1.0, 2.0]), (1, [1.0, 2.0]), (2, [1.0, 2.0]), (3, None), (4, [1.0, None]), (5, [float("nan"), 1.0]), (6, [float("inf"), 1.0]), (50, [-1.0, 0.5]), (7, [1.0]), (None, [1.0, 1.0]), (100, [1e12, 1e12])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("label", F.lit(1))
    got = {(r["query_id"], r["rank"]): r["vec_id"] for r in topk.top_k(df.where("vec_id <> 100"), 50, 5, shard_rows=2).collect()}
    assert got == {(0, 1): 1, (0, 2): 2, (0, 3): 50, (50, 1): 0, (50, 2): 1, (50, 3): 2}
    big = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in topk.top_k(df.where("vec_id in (0, 1, 100)"), 50, 5).collect()}
    assert big[0, 1] == (100, 256 * 256 * 3 * 10**12)
    assert topk.top_k(df.limit(0), 50, 5).count() == 0


def test_search_by_brute_force(spark, rng):
    rows = [(k, [rng.choice([-1.0, -0.5, 0.0, 0.25, 1.0]) for _ in range(6)]) for k in range(400)]
    wanted = []
    for q, x in rows[::50]:
        scored = sorted((-sum(int(256 * a // 1) * int(256 * b // 1) for a, b in zip(x, y, strict=True)), k) for k, y in rows if k != q)
        wanted += [(q, n + 1, k, -s) for n, (s, k) in enumerate(scored[:5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert sorted(map(tuple, topk.top_k(df, 50, 5, shard_rows=40, query_block=3).collect())) == sorted(wanted)


# 9 token files


def test_token_files(spark, odd, none):
    docs = odd.where("doc_id is not null").dropDuplicates(["doc_id"]).select("doc_id", "text").unionByName(spark.createDataFrame([(200, "don't ÀÉß÷× ŸſŁ İI 's <|endoftext|>x a'll"), (201, "ΑΣ ΣΑΣ ä ̈b\x1cc")], "doc_id long, text string"))
    tk, wanted, at = library(WORDS), [], 0
    for r in sorted(docs.collect(), key=lambda r: r["doc_id"]):
        ids = [*tk.encode(r["text"] or "", add_special_tokens=False).ids, 1]
        wanted.append((r["doc_id"], at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    for shape in ({}, {"length": 16, "files": 3}):
        assert sorted(map(tuple, token_files.token_file_report(docs, WORDS, **shape).collect())) == wanted
    assert token_files.token_file_report(odd, WORDS).count() == odd.count() and token_files.token_file_report(none, WORDS).count() == 0
    manifest = token_files.write_files(docs, WORDS, 1, length=16, files=1).collect()
    file = token_files.SequenceFile(manifest[0]["ids"])
    ids, mask = file.row(0)
    assert len(ids) == 16 and mask.all() and not file.row(-(-manifest[0]["n_tokens"] // 16) - 1)[1].all() == bool(manifest[0]["n_tokens"] % 16)


def test_encoded_words_stay_in_the_worker():
    with open(WORDS, encoding="utf-8") as f:
        source = f.read()
    cache = token_files.worker_cache(source, np.uint16)
    first = [ids.tolist() for ids in cache.encode(["some words, some more", None], 1)]
    again = token_files.worker_cache(source, np.uint16)
    assert again is cache and {"some", "words,", "more"} <= set(again.known)
    assert first == [ids.tolist() for ids in again.encode(["some words, some more", ""], 1)]
    assert token_files.worker_cache(source, np.uint32) is not cache


# 10 token counts


def greedy(word, pieces, most):
    symbols, at, n = (*word.encode(), token_counts.END), 0, 0
    while at < len(symbols):
        size = next((k for k in range(min(most, len(symbols) - at), 0, -1) if symbols[at : at + k] in pieces), 0)
        if not size:
            return 1
        at, n = at + size, n + 1
    return n


def test_automaton_by_brute_force(rng):
    for _ in range(200):
        pieces = {tuple(rng.choice([97, 98, 99]) for _ in range(rng.randint(1, 4))) + rng.choice([(), (token_counts.END,)]) for _ in range(8)} | {(token_counts.END,)}
        automaton = token_counts.Automaton(sorted(pieces))
        for _ in range(30):
            word = "".join(rng.choice("abc") for _ in range(rng.randint(1, 8)))
            assert automaton.count(word) == greedy(word, pieces, 5)


def test_token_counts(spark, odd, none):
    pieces = token_counts.vocabulary_pieces(WORDS)
    known, most = set(pieces), max(map(len, pieces))
    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(30)
    for r in token_counts.token_counts(docs, WORDS).join(docs.select("doc_id", "text"), "doc_id").collect():
        words = token_counts.WORD.findall(r["text"].lower())
        assert r["n_words"] == len(words) and r["n_tokens"] == sum(greedy(w, known, most) for w in words)
    assert token_counts.token_counts(odd, WORDS).count() == odd.count() and token_counts.token_counts(none, WORDS).count() == 0
