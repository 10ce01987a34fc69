"""The pipeline's stages take effect and keep clean documents."""

from helpers import DATA


def test_stages(spark, odd, none):
    import corpus_pipeline as p

    assert [n for n, _ in p.STAGES] == ["language_id", "ngram_jaccard", "decontamination", "pii", "bpe"]
    docs, seen = spark.read.parquet(f"{DATA}/documents.parquet"), []
    columns = docs.columns
    for name, stage in p.STAGES:
        docs = stage(spark, docs, DATA).cache()
        seen.append(docs.count())
        assert name == "bpe" or docs.columns == columns
    assert seen[0] >= seen[1] >= seen[2] == seen[3] == seen[4] > 0.7 * seen[0]
    assert p.run(spark, DATA).count() == seen[-1]
    for frame in (odd.select(*columns), none.select(*columns)):
        for _, stage in p.STAGES:
            stage(spark, frame, DATA).count()


def test_near_copies_leave_one(spark):
    import corpus_pipeline as p

    text = " ".join(f"w{k}" for k in range(100))
    docs = spark.createDataFrame([(5, text, "en", "s", 1), (3, text + " end", "en", "s", 1), (9, "other words entirely", "en", "s", 1), (None, text, "en", "s", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    assert {r["doc_id"] for r in p.deduplicated(spark, docs, DATA).collect()} == {3, 9, None}


def test_copies_alike_by_eight_tenths_leave_one(spark):
    import corpus_pipeline as p

    words = [f"w{k}" for k in range(200)]
    edited = [f"x{k}" if k in (30, 80, 130, 180) else w for k, w in enumerate(words)]
    longer = [*words, *(f"y{k}" for k in range(30))]
    inserted = [*words[:100], *(f"z{k}" for k in range(30)), *words[100:]]
    other = [f"x{k}" if k % 20 == 10 else w for k, w in enumerate(words)]

    def alike(a, b):
        a, b = ({tuple(x[k : k + 5]) for k in range(len(x) - 4)} for x in (a, b))
        return len(a & b) / len(a | b)

    assert all(0.8 <= alike(words, x) < 0.9 for x in (edited, longer, inserted)) and alike(words, other) < 0.8
    rows = [(k, " ".join(x), "en", "s", 1) for k, x in ((7, words), (8, edited), (9, longer), (10, inserted), (11, other))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert {r["doc_id"] for r in p.deduplicated(spark, docs, DATA).collect()} == {7, 11}
