import brute

import corpus_pipeline


def test_stages(spark, docs, rows, tmp_path):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    at, seen = docs, {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, at, str(tmp_path))
        if name != "encoding":
            assert out.columns == docs.columns
        at = spark.createDataFrame(out.collect(), out.schema)
        seen[name] = at.collect()
    good = {r.doc_id for r in seen["quality rules"]}
    for i, t, *_ in rows:
        n, chars, symbols, dup, repeat = brute.measures(t)
        if n < 50 or 100 * repeat > 50 * n or symbols > n:
            assert i not in good or i is None
    kept = [(r.doc_id, r.text) for r in seen["quality rules"]]
    want = {(i, t) for i, _, _, t in brute.line_dedup(kept)}
    assert {(r.doc_id, r.text) for r in seen["line dedup"]} == want
    assert all(r.n_chars == len(r.text) for r in seen["line dedup"])
    comp = brute.near([(r.doc_id, r.text) for r in seen["line dedup"]], 80)
    assert {r.doc_id for r in seen["near dedup"]} - {None} == {i for i, c in comp.items() if i == c}
    mixed = [r.doc_id for r in seen["mixing"]]
    assert set(mixed) <= {r.doc_id for r in seen["near dedup"]} and all(mixed.count(i) <= 3 * sum(r.doc_id == i for r in seen["near dedup"]) for i in mixed)
    assert len(seen["encoding"]) == len(mixed) and all(r.round_trip and r.n_tokens == len(r.ids) for r in seen["encoding"])


def test_run(spark, docs, tmp_path):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0
    assert len(corpus_pipeline.STAGES) == 5 and corpus_pipeline.ORACLE_SQL is None


def test_near_dedup_of_null_and_repeated_ids(spark, docs):
    """Copies without an id or under a used one go like any other."""
    words = lambda s: " ".join(f"{s}{i}" for i in range(60))
    rows = [(None, words("a")), (None, words("a")), (5, words("a")), (6, words("b")), (6, words("b")), (6, words("c")), (9, words("c")), (None, words("d")), (None, words("d")), (None, None), (None, None), (7, "")]
    df = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], docs.schema).repartition(4)
    kept = corpus_pipeline.near_dedup(spark, df, "")
    assert kept.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr) == sorted([(5, words("a")), (6, words("b")), (6, words("c")), (None, words("d")), (None, None), (None, None), (7, "")], key=repr)


def test_an_empty_table(spark, docs, tmp_path):
    docs.where("1 = 0").write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
