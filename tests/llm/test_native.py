import brute
import pytest
from brute import clashing

from millrace.llm import mixing, quality


def test_measures(docs, rows):
    got = quality.ledger(clashing(docs, "n_words", "fail_bits", "kept", "n_lines")).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute.measures(r.text)


def test_policies_and_ablations(docs):
    led = quality.ledger(docs)
    rows = quality.apply_policy(led, "v2").collect()
    for r in rows:
        failed = [r.n_words < 50, 100 * r.n_repeat_words > 50 * r.n_words, r.n_symbols > r.n_words, r.word_chars > 20 * r.n_words, r.word_chars < 2 * r.n_words, 10 * r.n_dup_lines > 8 * r.n_lines]
        assert r.fail_bits == sum(1 << i for i, f in enumerate(failed) if f) and r.kept == (not any(failed))
    cost = {r.rule: r for r in quality.ablations(led, "v2").collect()}
    for i, (name, _) in enumerate(quality.RULES):
        bit = 1 << i
        assert cost[name].failed == sum(bool(r.fail_bits & bit) for r in rows)
        assert cost[name].failed_alone == sum(r.fail_bits == bit for r in rows)
        assert cost[name].kept_without == sum(r.fail_bits & ~bit == 0 for r in rows)


def test_filter_keeps_columns(docs, empty):
    kept = quality.filter_documents(clashing(docs, "n_words", "kept"))
    assert kept.columns == [*docs.columns, "n_words", "kept"] and 0 < kept.count() < docs.count()
    assert quality.filter_documents(empty).count() == 0


def test_no_python_in_plans(docs):
    for df in (quality.ledger(docs), mixing.mix_sources(docs)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def targets(sizes, weights=(1, 2, 3), most=3):
    names = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, full, left = sum(sizes.values()), {}, set(names)
    while True:
        rest = total - sum(full.values())
        over = {s for s in left if rest * weight[s] / sum(weight[x] for x in left) > most * sizes[s]}
        if not over:
            return full | {s: rest * weight[s] / sum(weight[x] for x in left) for s in left}
        full |= {s: most * sizes[s] for s in over}
        left -= over


def test_mix(docs, rows):
    got = mixing.mix_sources(clashing(docs, "size", "rate", "copies")).collect()
    assert len(got) == len(rows)
    sizes, taken, biggest = {}, {}, {}
    for r in got:
        assert r.size == len(brute.words(r.text)) and 0 <= r.copies <= 3 and r.taken == r.copies * r.size
        sizes[r.source] = sizes.get(r.source, 0) + r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
        biggest[r.source] = max(biggest.get(r.source, 0), r.size)
    want = targets(sizes)
    for r in got:
        assert r.target == pytest.approx(want[r.source]) and r.source_size == sizes[r.source]
    for s in sizes:
        assert abs(taken[s] - want[s]) <= max(0.02 * want[s] + 60, biggest[s] / 2)  # a text goes in whole
    again = mixing.mix_sources(docs.repartition(2)).collect()
    say = lambda rs: sorted(((r.doc_id, r.size, r.taken) for r in rs), key=repr)
    assert say(got) == say(again)


def test_caps_and_single_sources(spark, empty):
    small = [(i, "w " * 10, "en", "a", 0) for i in range(20)] + [(i, "w " * 2, "en", "z", 0) for i in range(100, 103)] + [(200, "w", "en", "m", 0), (201, None, "en", "q", 0)]
    df = spark.createDataFrame(small, "doc_id long, text string, lang string, source string, n_chars long")
    got = mixing.mix_sources(df).collect()
    by = {s: sum(r.taken for r in got if r.source == s) for s in "azmq"}
    assert by["z"] <= 18 and by["m"] == 3 and by["q"] == 0 and abs(by["a"] - next(r.target for r in got if r.source == "a")) <= 10
    assert mixing.mix_sources(empty).count() == 0
    n = mixing.mixed_documents(df)
    assert n.columns == df.columns and n.count() == sum(r.copies for r in got)
