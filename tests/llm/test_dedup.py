import pytest

import brute
from brute import clashing
from millrace.llm import lines, minhash, substring


def some(rows):
    return sorted(rows, key=repr)


def test_line_dedup(docs, rows):
    got = lines.drop_repeated_lines(clashing(docs, "doc", "fp", "keep", "n_lines", "h1"))
    assert some((r.doc_id, r.n_lines, r.n_dropped, r.kept_text) for r in got.collect()) == some(brute.line_dedup(rows))
    assert "h1" in got.columns and "lang" in got.columns


def test_line_dedup_hot_key(spark, monkeypatch):
    """A key held by every document is spread over partitions and settled at their borders."""
    many = [(i, "the line all share\nown line number %d\nthe line all share" % i) for i in range(400)]
    df = spark.createDataFrame(many, "doc_id long, text string").repartition(5)
    monkeypatch.setattr(lines, "RANGE_ROWS", 150)
    got = lines.drop_repeated_lines(df).collect()
    assert some((r.doc_id, r.n_lines, r.n_dropped, r.kept_text) for r in got) == some(brute.line_dedup(many))


def test_substring_dedup(docs, rows):
    got = substring.remove_repeats(clashing(docs, "doc", "fp", "t", "places", "kept"))
    assert some(tuple(r) for r in got.collect()) == some(brute.substring(rows))


def test_substring_dedup_with_a_full_sketch(docs, rows):
    """A sketch far too small lets everything through and changes nothing."""
    got = substring.remove_repeats(docs, most_cells=1 << 10)
    assert some(tuple(r) for r in got.collect()) == some(brute.substring(rows))


@pytest.mark.parametrize("percent", [80, 85])
def test_near_duplicates(docs, rows, percent):
    got = minhash.near_duplicates(clashing(docs, "node", "fp", "digest", "kept", "component"), percent=percent).collect()
    want = brute.near(rows, percent)
    assert len(got) == len(rows)
    for r in got:
        assert r.component_id == (want[r.doc_id] if r.doc_id is not None else None)
        assert r.kept == (r.doc_id is None or r.component_id == r.doc_id)
    sizes = {(i, len(brute.shingles(t))) for i, t, *_ in rows}
    assert {(r.doc_id, r.n_shingles) for r in got} == sizes


def test_chains_and_mixed_buckets(spark):
    """Documents each near the next, so that first and last are far apart but in one component."""
    base = [f"w{i}" for i in range(200)]
    chain = []
    for i in range(12):
        w = list(base)
        w[: 4 * i] = [f"x{k}" for k in range(4 * i)]
        chain.append((i, " ".join(w)))
    got = minhash.near_duplicates(spark.createDataFrame(chain, "doc_id long, text string"), percent=85).collect()
    want = brute.near(chain, 85)
    assert {r.doc_id: r.component_id for r in got} == want and len(set(want.values())) == 1


def test_empty(empty):
    assert lines.drop_repeated_lines(empty).count() == 0
    assert substring.remove_repeats(empty).count() == 0
    assert minhash.near_duplicates(empty).count() == 0


def test_estimate_is_close():
    import numpy as np

    rng = np.random.default_rng(1)
    for share in (0.5, 0.8, 0.95):
        both = rng.integers(0, 2**64, int(2000 * share), dtype=np.uint64)
        a = np.concatenate([both, rng.integers(0, 2**64, 2000 - len(both), dtype=np.uint64)])
        b = np.concatenate([both, rng.integers(0, 2**64, 2000 - len(both), dtype=np.uint64)])
        _, s = minhash._signatures(np.concatenate([a, b]), np.array([0, len(a)]))
        x = s.view(np.uint64)[0] ^ s.view(np.uint64)[1]
        wrong = np.bitwise_count((x | (x >> np.uint64(1))) & np.uint64(0x5555555555555555)).sum()
        est = (1 - wrong / minhash.MINIMA - 0.25) / 0.75
        assert abs(est - len(both) / (4000 - len(both))) < 0.12


def test_estimates_deviate_as_stated():
    """Over many pairs, small sets among them, estimates are unbiased and deviate as the operator assumes, and nearly all
    similar pairs share a band."""
    import numpy as np

    rng = np.random.default_rng(2)
    for size, both in ((20, 17), (74, 68), (1000, 919)):
        off, met, shared = [], 0, both / (2 * size - both)
        for _ in range(150):
            pool = rng.integers(0, 2**64, 2 * size - both, dtype=np.uint64)
            keys, s = minhash._signatures(np.concatenate([pool[:size], pool[size - both :]]), np.array([0, size]))
            x = s.view(np.uint64)[0] ^ s.view(np.uint64)[1]
            wrong = np.bitwise_count((x | (x >> np.uint64(1))) & np.uint64(0x5555555555555555)).sum()
            off.append((1 - wrong / minhash.MINIMA - 0.25) / 0.75 - shared)
            met += bool((keys[0] == keys[1]).any())
        m = shared + (1 - shared) / 4
        stated = (m * (1 - m) / minhash.MINIMA) ** 0.5 / 0.75
        assert abs(np.mean(off)) < 4 * stated / 150**0.5 and np.std(off) < 1.25 * stated and max(map(abs, off)) < minhash.DEVIATIONS * stated
        assert met == 150


def test_large_buckets_in_tiles(spark):
    """A bucket of several tiles, of many components and sizes, finds what a comparison of all pairs finds; no task holds
    more than two tiles."""
    import numpy as np
    from pyspark.sql import functions as F

    rng = np.random.default_rng(8)
    rows = []
    for i in range(120):
        size = int(rng.choice([70, 75, 80, 120, 300]))
        base = [f"s{i // 3}w{j}" for j in range(size)]
        rows.append((i, " ".join(base[: size - int(rng.integers(0, 4))] + [f"own{i}"])))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    member = minhash.features(df, "doc_id", "text", 5).select(F.lit(7).cast("long").alias("key"), F.col("doc_id").alias("node"), F.col("doc_id").alias("comp"), "n_shingles", *minhash.SIGNATURE)
    member = member.withColumn("comp", F.when(F.col("node") % 3 == 0, F.lit(0)).otherwise(F.col("node")))
    plain = {tuple(r) for r in minhash.cross_pairs(member, 80).collect()}
    tiled = {tuple(r) for r in minhash.cross_pairs(member, 80, tile=8).collect()}
    assert plain == tiled
    comp = {i: 0 if i % 3 == 0 else i for i, _ in rows}
    near = brute.near
    for a, b in ((a, b) for a in range(120) for b in range(a + 1, 120) if comp[a] != comp[b] and len(set(near([rows[a], rows[b]], 80).values())) == 1):
        assert (a, b) in plain


@pytest.mark.parametrize("s", [78, 1345, 1860])
def test_small_sets_skip_the_estimate(spark, s):
    """Sets of four and five shingles, similar at 0.8 exactly, whose low bits agree less often than chance would have it."""
    a = " ".join(f"w{s}x{i}" for i in range(8))
    df = spark.createDataFrame([(1, a), (2, f"{a} w{s}x8")], "doc_id long, text string")
    assert sorted((r.doc_id, r.component_id) for r in minhash.near_duplicates(df, percent=80).collect()) == [(1, 1), (2, 1)]
    rows = minhash.features(df, "doc_id", "text", 5).selectExpr("7L as key", "doc_id as node", "doc_id as comp", "n_shingles", *minhash.SIGNATURE)
    assert [tuple(r) for r in minhash.cross_pairs(rows, 80).collect()] == [(1, 2)]


def thue_morse(n, letters):
    """A word of n letters that many polynomial hashes can't tell from the one with its letters exchanged."""
    return "".join(letters[bin(i).count("1") % 2] for i in range(n))


@pytest.mark.parametrize("n", [1024, 2048])
def test_words_that_polynomial_hashes_confuse(spark, n):
    filler = [f"f{i}" for i in range(12)]
    rows = [(1, " ".join([thue_morse(n, "ab"), *filler])), (2, " ".join([thue_morse(n, "ba"), *filler])), (3, " ".join([thue_morse(n, "ab"), *filler]))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert some(tuple(r) for r in substring.remove_repeats(df).collect()) == some(brute.substring(rows))
    only = [(1, thue_morse(n, "ab")), (2, thue_morse(n, "ba")), (3, thue_morse(n, "ab"))]
    got = minhash.near_duplicates(spark.createDataFrame(only, "doc_id long, text string"), percent=85).collect()
    assert {r.doc_id: r.component_id for r in got} == brute.near(only, 85) == {1: 1, 2: 2, 3: 1}


def test_equal_hashes_decide_nothing():
    """With one hash for all windows of a task everything meets, and words still tell what is equal."""
    import numpy as np

    from millrace.llm import _words as W

    rng = np.random.default_rng(5)
    ids = rng.integers(0, 3, 4000)
    at = np.arange(len(ids) - 12)
    for key in (np.zeros(len(at), np.uint64), (at % 3).astype(np.uint64), W.windows(W.mix(ids.astype(np.uint64)), 13)):
        order, new = W.same_windows(key, at, ids, 13)
        group = np.empty(len(at), int)
        group[order] = np.cumsum(new)
        seen = {}
        for p in at:
            assert seen.setdefault(tuple(ids[p : p + 13]), group[p]) == group[p]
        assert len(seen) == new.sum()


def test_substring_dedup_in_many_small_parts(docs, rows):
    """Equal windows meet, however often a task hands on what it holds."""
    got = substring.remove_repeats(docs, k=4, flush=50)
    assert some(tuple(r) for r in got.collect()) == some(brute.substring(rows, 4))


def test_substring_dedup_with_short_windows(docs, rows):
    for k in (1, 2):
        assert some(tuple(r) for r in substring.remove_repeats(docs, k=k).collect()) == some(brute.substring(rows, k))
