"""The pipeline on planted cases, against what each stage should do to them."""

import random

import corpus_pipeline


def test_planted_cases_go_and_clean_documents_stay(spark, tmp_path):
    rng = random.Random(1)
    fresh = lambda n: [f"w{rng.randint(0, 10**9)}" for _ in range(n)]
    passage, question = " ".join(fresh(60)), " ".join(fresh(30))
    docs = {i: " ".join(fresh(60)) for i in range(120)}
    toxic = set(range(200, 260))
    for i in toxic:
        words = fresh(40)
        words.insert(rng.randrange(40), "vileword")
        docs[i] = " ".join(words)
    docs[300], docs[301] = docs[7], docs[8] + " end"  # a copy and a near copy
    docs[302] = f"{' '.join(fresh(20))} {question} {' '.join(fresh(20))}"
    docs[303], docs[304] = f"{docs[300][:50]}x {' '.join(fresh(20))} {passage}", f"{passage} {' '.join(fresh(20))}"
    docs[305] = ""
    rows = [(i, t, "en", "one", len(t)) for i, t in docs.items()] + [(306, None, "en", "one", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i in toxic)) for i in docs if i < 300], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, question)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    kept = docs.keys() - toxic - {300, 301, 302}
    for name, stage in corpus_pipeline.STAGES[:4]:
        first = stage(spark, spark.read.parquet(f"{tmp_path}/documents.parquet").limit(0), str(tmp_path))
        assert first.columns == ["doc_id", "text", "lang", "source", "n_chars"] and first.count() == 0, name
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert got.keys() == kept - {305}  # nothing is taken of a document without words
    for i in got:
        text = docs[i].replace(passage, "") if i in (303, 304) else docs[i]
        assert got[i].text.strip() == text.strip() and got[i].n_chars == len(got[i].text)
    # one source shares all of the total: each document is taken once
    assert all(r.taken == r["size"] for r in got.values())


def test_the_mix_keeps_all_columns(spark, tmp_path):
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    rows = [(1, "one two three", None, 40, "t", "r"), (1, "one two three", None, 40, "t", "r"), (2, None, "a", 41, None, None), (3, "word " * 100_000, "a", 42, "x", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size int, taken string, row string")
    got = corpus_pipeline.mix(spark, docs, str(tmp_path))
    assert got.columns == ["doc_id", "text", "source", "size", "taken", "row", "mix_size", "source_size", "target", "mix_taken"]
    assert sorted((r.doc_id, r["size"], r.taken, r.row, r.mix_size) for r in got.collect()) == [(1, 40, "t", "r", 3), (1, 40, "t", "r", 3), (3, 42, "x", None, 100_000)]
    assert corpus_pipeline.mix(spark, docs.limit(0), str(tmp_path)).count() == 0
