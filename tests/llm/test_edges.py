"""Every operator over odd column names, a text of 5 MB, nulls and repeated rows, and over an empty table."""

import hashlib

import brute
import pytest
from pyspark.sql import functions as F

from millrace.llm import ann, bpe, chat, lines, minhash, mixing, quality, secrets, sharding, substring

TOKENIZERS = pytest.importorskip("public_tokenizers")
ODD = ["a.b", "mr_key", "mr_text", "Size", "N_WORDS", "IDS", "Slot", "Kept_Text", "SPANS", "c0", "keep", "W", "Kept", "`tick`"]
LONG = " ".join(f"word{i % 70001} x" for i in range(430_000)) + "\n" + "password = abcdefgh12345 " + "z" * 200_000


@pytest.fixture(scope="module")
def odd(spark):
    """Documents whose id, text and source have names with dots, among columns with names the operators use."""
    words = lambda s, n=60: " ".join(f"{s}{i}" for i in range(n))
    rows = [(1, LONG, "s"), (2, words("a"), None), (3, words("a"), "s"), (None, words("b"), "t"), (None, None, "t"), (4, "", "t"), (5, None, None), (5, words("c"), "s"), (5, words("c"), "s"), (6, words("d") + "\n" + words("a"), "u")]
    df = spark.createDataFrame(rows, "`the.id` long, `Some text` string, `where` string").repartition(3)
    return df.select("*", *[F.lit(i).alias(n) for i, n in enumerate(ODD)])


def texts(odd):
    return [(r["the.id"], r["Some text"]) for r in odd.select("`the.id`", "`Some text`").collect()]


HOW = {"id_col": "the.id", "text_col": "Some text"}
PASSED = ["the.id", "Some text", "where", *ODD]


def columns(added):
    low = {a.lower() for a in added}
    return [c for c in PASSED if c.lower() not in low] + list(added)


def test_sharding(odd):
    got = sharding.shuffle_into_shards(odd, shards=3, **HOW)
    assert got.columns == columns(["shard", "slot"]) and got.count() == odd.count()


def test_mixing(odd):
    got = mixing.mix_sources(odd, source_col="where", **HOW)
    assert got.columns == columns(mixing.ADDED)
    assert sorted(r["size"] for r in got.select("size").collect()) == sorted(len(brute.words(t)) for _, t in texts(odd))


def test_quality(odd, tmp_path):
    got = quality.apply_policy(quality.ledger(odd, text_col="Some text"), "v2")
    added = [*quality.MEASURES, "fail_bits"]
    assert got.columns == [c for c in columns(added) if c != "Kept"] + ["kept"]
    assert sorted((r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in got.collect()) == sorted(brute.measures(t) for _, t in texts(odd))
    assert quality.filter_documents(odd, text_col="Some text").columns == PASSED
    kept = quality.write_ledger(odd, str(tmp_path / "ledger"), **HOW)
    assert kept.columns == ["the.id", *added] and kept.count() == odd.count() and quality.ablations(kept, "v2").count() == len(quality.RULES)


def test_secrets(odd):
    got = secrets.find_secrets(odd, text_col="Some text")
    assert got.columns == columns(["spans"])
    for r in got.collect():
        assert [(s.start, secrets.KINDS.index(s.kind), s.end) for s in r["spans"] if s.kind in secrets.BASE] == brute.base_spans(r["Some text"])


def test_bpe(odd):
    from tokenizers import Tokenizer

    path = TOKENIZERS.path("byte_bpe_50k.json")
    lib = Tokenizer.from_file(path)
    got = bpe.decode(bpe.encode(odd, path, text_col="Some text"), path)
    assert got.columns == [c for c in columns(["ids"])] + ["decoded"]
    for r in got.collect():
        assert r["decoded"] == (r["Some text"] or "") and r["ids"] == lib.encode(r["Some text"] or "", add_special_tokens=False).ids


def test_lines(odd):
    got = lines.drop_repeated_lines(odd, **HOW)
    assert got.columns == columns(lines.ADDED)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert sorted(((r["the.id"], r["n_lines"], r["n_dropped"], sha(r["kept_text"])) for r in got.collect()), key=repr) == sorted(((i, n, d, sha(t)) for i, n, d, t in brute.line_dedup(texts(odd))), key=repr)


def test_substring(odd):
    got = substring.remove_repeats(odd, **HOW).collect()
    assert sorted(((i, n, d, brute.sha(t)) for i, n, d, t in got), key=repr) == sorted(((i, n, d, brute.sha(t)) for i, n, d, t in brute.substring(texts(odd))), key=repr)


def test_near_duplicates(odd):
    got = minhash.near_duplicates(odd, percent=85, **HOW).collect()
    assert len(got) == odd.count() and {r.component_id for r in got if r.doc_id in (2, 3)} == {2}
    assert {(r.doc_id, r.n_shingles) for r in got} == {(i, len(brute.shingles(t))) for i, t in texts(odd)}


def test_quotations(spark):
    talk = spark.createDataFrame([(1, 0, "u", LONG), (1, 1, "u", "> word7 x word8 x word9\nyes"), (None, None, None, None)], "`a.b` long, Turn long, `h` string, `own` string")
    got = chat.link_quotations(talk, "a.b", "turn", "h", "own").collect()
    assert sorted((r.turn, r.reply_to, r.place) for r in got if r.turn is not None) == [(0, None, 0), (1, 0, 1)] and len(got) == 3


def test_neighbours(spark):
    df = spark.createDataFrame([(i, [float(i + 1), 1.0], 0) for i in range(6)], "`vec.id` long, `The vector` array<double>, list int")
    got = ann.search(df, df.where("`vec.id` = 0"), "vec.id", "The vector", k=2).collect()
    assert [r.vec_id for r in sorted(got, key=lambda r: r.rank)] == [1, 2]


def test_empty_tables(odd):
    none, path = odd.where(F.lit(False)), TOKENIZERS.path("byte_bpe_50k.json")
    for made in (sharding.shuffle_into_shards(none, **HOW), mixing.mixed_documents(none, source_col="where", **HOW), quality.ledger(none, text_col="Some text"), secrets.find_secrets(none, text_col="Some text"),
                 bpe.decode(bpe.encode(none, path, text_col="Some text"), path), lines.drop_repeated_lines(none, **HOW), substring.remove_repeats(none, **HOW), minhash.near_duplicates(none, **HOW)):
        assert made.count() == 0
