"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import ann, bpe, chat, lines, minhash, mixing, quality, secrets, sharding, substring

#: The public tokenizer file that op 9 uses; a parameter of the operator.
TOKENIZER = "byte_bpe_50k.json"


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ivf_pq_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return ann.search(rows, rows.where("vec_id % 50 = 0"), k=5)


def op2_external_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sharding.shuffle_into_shards(table(spark, sf_dir, "documents").select("doc_id", "text"), shards=16)
    text = F.coalesce("text", F.lit(""))
    return rows.select("doc_id", (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op3_entropy_balanced_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mixing.mix_sources(table(spark, sf_dir, "documents"), weights=(1, 2, 3), most=3)
    return rows.select("doc_id", "size", "source_size", "target", "taken", "copies")


def op4_quality_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality.apply_policy(quality.ledger(table(spark, sf_dir, "documents").select("doc_id", "text")), "v2")
    base = F.col("fail_bits").bitwiseAND(F.lit(quality.mask("v1"))) != 0
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), "kept", "fail_bits")


def quality_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule of policy v2 costs, from the ledger of op 4."""
    return quality.ablations(quality.ledger(table(spark, sf_dir, "documents").select("doc_id", "text")), "v2")


def op5_linked_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = secrets.find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    said = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    of = lambda *kinds: F.filter("spans", lambda x: x["kind"].isin(*kinds))
    count = lambda kind: F.size(of(kind)).cast("long")
    return rows.select("doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"), F.sha2(said(of(*secrets.BASE)), 256).alias("base_sha256"), said(F.col("spans")).alias("spans"))


def op6_quotation_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.link_quotations(table(spark, sf_dir, "conversations"))


def ids_digest(ids: Column) -> Column:
    return F.sha2(F.array_join(ids.cast("array<string>"), ","), 256)


def op9_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tokenizer_path()
    coded = bpe.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), path)
    coded = coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), ids_digest(F.col("ids")).alias("ids_sha256"), "ids")
    return bpe.decode(coded, path).select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))


def op7_minhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), k=5, percent=85)


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring.remove_repeats(table(spark, sf_dir, "documents"), k=13)
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lines.drop_repeated_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), least=10)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP4_SQL = rf"""
WITH w AS (SELECT doc_id, {WORDS} AS w, coalesce(text, '') AS t FROM documents),
l AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM w),
d AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
p AS (SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, w FROM w WHERE len(w) >= 3),
k AS (SELECT doc_id, i, array_to_string(w[i:i + 2], ' ') AS k FROM p),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS n FROM k) WHERE n > 1),
c AS (SELECT doc_id, count(DISTINCT i) AS n FROM (SELECT doc_id, i + unnest(range(0, 3)) AS i FROM r) GROUP BY doc_id),
m AS (SELECT w.doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
   len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, coalesce(d.n_dup, 0)::BIGINT AS n_dup_lines,
   coalesce(c.n, 0)::BIGINT AS n_repeat_words, coalesce(d.n_lines, 0) AS n_lines
   FROM w LEFT JOIN d ON d.doc_id = w.doc_id LEFT JOIN c ON c.doc_id = w.doc_id),
b AS (SELECT *, (CASE WHEN n_words < 50 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END
   + CASE WHEN n_symbols > n_words THEN 4 ELSE 0 END + CASE WHEN word_chars > 20 * n_words THEN 8 ELSE 0 END
   + CASE WHEN word_chars < 2 * n_words THEN 16 ELSE 0 END + CASE WHEN 10 * n_dup_lines > 8 * n_lines THEN 32 ELSE 0 END)::BIGINT AS fail_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (fail_bits & 3) <> 0 AS base_failed, fail_bits = 0 AS kept, fail_bits FROM b
"""

ABLATIONS_SQL = rf"""
WITH q AS ({OP4_SQL}), r AS (SELECT unnest([{", ".join(str(1 << i) for i in range(len(quality.RULES)))}]) AS bit, unnest([{", ".join(repr(n) for n, _ in quality.RULES)}]) AS rule)
SELECT r.rule, (count(*) FILTER (q.fail_bits & r.bit <> 0))::BIGINT AS failed, (count(*) FILTER (q.fail_bits = r.bit))::BIGINT AS failed_alone,
  (count(*) FILTER (q.fail_bits & ~r.bit = 0))::BIGINT AS kept_without FROM q, r GROUP BY r.rule
"""

OP6_SQL = r"""
WITH RECURSIVE s AS (SELECT conv_id, turn, string_split(coalesce(text, ''), chr(10)) AS lines FROM conversations),
u AS (SELECT conv_id, turn, unnest(lines) AS line, unnest(range(1, len(lines) + 1)) AS i FROM s),
m AS (SELECT *, regexp_extract(line, '^(?:[\x20\x09]*>)+') AS marks FROM u),
l AS (SELECT conv_id, turn, i, line, length(marks) - length(replace(marks, '>', '')) AS mark,
   trim(regexp_replace(translate(substr(line, length(marks) + 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+', ' ', 'g')) AS k FROM m),
b AS (SELECT *, last_value(CASE WHEN mark = 0 OR k <> '' THEN mark END IGNORE NULLS) OVER (PARTITION BY conv_id, turn ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS held FROM l),
e AS (SELECT *, CASE WHEN mark > 0 AND k = '' AND held > 0 THEN held ELSE mark END AS level FROM b),
g AS (SELECT *, sum(CASE WHEN level <> coalesce(before, 0) THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id, turn ORDER BY i) AS p
   FROM (SELECT *, lag(level) OVER (PARTITION BY conv_id, turn ORDER BY i) AS before FROM e)),
h AS (SELECT *, sum(CASE WHEN k = '' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id, turn, p ORDER BY i) AS q FROM g),
w AS (SELECT conv_id, turn, i, level, k, string_agg(k, ' ') OVER (PARTITION BY conv_id, turn, p ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS passage,
   string_agg(k, ' ') OVER (PARTITION BY conv_id, turn, p, q ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS paragraph FROM h WHERE k <> ''),
own AS (SELECT DISTINCT conv_id, turn, unnest([passage, paragraph, k]) AS key FROM w WHERE level = 0),
inner_ AS (SELECT DISTINCT conv_id, turn, ' ' || passage || ' ' AS passage FROM w WHERE level = 0),
asked AS (SELECT DISTINCT conv_id, turn, unnest([passage, paragraph, k]) AS key FROM w WHERE level > 0),
whole AS (SELECT a.conv_id, a.turn, a.key, max(o.turn) AS origin FROM asked a LEFT JOIN own o ON o.conv_id = a.conv_id AND o.key = a.key AND o.turn < a.turn GROUP BY ALL),
part AS (SELECT a.conv_id, a.turn, a.key, max(o.turn) AS origin FROM whole a JOIN inner_ o ON o.conv_id = a.conv_id AND o.turn < a.turn AND contains(o.passage, ' ' || a.key || ' ')
   WHERE a.origin IS NULL AND len(string_split(a.key, ' ')) >= 4 GROUP BY ALL),
f AS (SELECT a.conv_id, a.turn, a.key, coalesce(a.origin, p.origin) AS origin FROM whole a LEFT JOIN part p ON p.conv_id = a.conv_id AND p.turn = a.turn AND p.key = a.key),
o AS (SELECT w.conv_id, w.turn, w.level, coalesce(x.origin, y.origin, z.origin) AS origin, min(w.level) OVER (PARTITION BY w.conv_id, w.turn) AS outermost FROM w
   JOIN f x ON x.conv_id = w.conv_id AND x.turn = w.turn AND x.key = w.passage
   JOIN f y ON y.conv_id = w.conv_id AND y.turn = w.turn AND y.key = w.paragraph
   JOIN f z ON z.conv_id = w.conv_id AND z.turn = w.turn AND z.key = w.k WHERE w.level > 0),
v AS (SELECT conv_id, turn, origin, count(*) AS n, count(*) FILTER (level = outermost) AS votes FROM o GROUP BY ALL),
r AS (SELECT conv_id, turn, sum(n) AS n_quoted, coalesce(sum(n) FILTER (origin IS NOT NULL), 0) AS n_linked,
   (arg_max(origin, (votes, n, origin)) FILTER (origin IS NOT NULL)) AS reply_to FROM v GROUP BY ALL),
t AS (SELECT conv_id, turn, trim(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (mark = 0), ''), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS text FROM l GROUP BY ALL),
a AS (SELECT m.conv_id, m.turn, m.role, t.text, coalesce(r.n_quoted, 0)::BIGINT AS n_quoted, coalesce(r.n_linked, 0)::BIGINT AS n_linked, r.reply_to
   FROM conversations m JOIN t ON t.conv_id = m.conv_id AND t.turn = m.turn LEFT JOIN r ON r.conv_id = m.conv_id AND r.turn = m.turn),
tree AS (SELECT conv_id, turn, turn::BIGINT AS thread, 0::BIGINT AS depth, [turn] AS way FROM a WHERE reply_to IS NULL
   UNION ALL SELECT a.conv_id, a.turn, tree.thread, tree.depth + 1, list_append(tree.way, a.turn) FROM a JOIN tree ON tree.conv_id = a.conv_id AND tree.turn = a.reply_to)
SELECT a.conv_id, a.turn, a.role, a.text, a.n_quoted, a.n_linked, a.reply_to, tree.thread, tree.depth, row_number() OVER (PARTITION BY a.conv_id, tree.thread ORDER BY tree.way) - 1 AS place
FROM a JOIN tree ON tree.conv_id = a.conv_id AND tree.turn = a.turn
"""

OP7_SQL = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({LOWERED}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN []
        WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
        ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS n_both FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * n_both >= 85 * (a.n + b.n - n_both)),
e AS (SELECT x, y FROM l UNION SELECT y, x FROM l),
r AS (SELECT doc_id AS d, doc_id AS c FROM documents UNION SELECT e.y, r.c FROM r JOIN e ON e.x = r.d),
m AS (SELECT d, min(c) AS c FROM r GROUP BY d)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.c AS component_id, d.doc_id = m.c AS kept
FROM documents d JOIN m ON m.d = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
"""

OP8_SQL = rf"""
WITH w AS (SELECT doc_id, {WORDS} AS w FROM documents),
p AS (SELECT doc_id, unnest(range(1, len(w) - 11)) AS i, w FROM w WHERE len(w) >= 13),
k AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS k FROM p),
f AS (SELECT k, min(doc_id) AS low FROM k GROUP BY k),
g AS (SELECT DISTINCT doc_id, i + unnest(range(0, 13)) AS i FROM (SELECT k.doc_id, k.i FROM k JOIN f ON f.k = k.k WHERE f.low < k.doc_id)),
t AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS word FROM w),
o AS (SELECT t.doc_id, count(*) FILTER (g.i IS NOT NULL) AS n_removed,
        string_agg(word, ' ' ORDER BY t.i) FILTER (g.i IS NULL) AS kept
      FROM t LEFT JOIN g ON g.doc_id = t.doc_id AND g.i = t.i GROUP BY t.doc_id)
SELECT w.doc_id, len(w.w)::BIGINT AS n_words, coalesce(o.n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(o.kept, '')) AS kept_sha256
FROM w LEFT JOIN o ON o.doc_id = w.doc_id
"""

OP10_SQL = r"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
             unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) AS i FROM documents),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
             'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM l),
f AS (SELECT k, min(doc_id) AS low FROM k WHERE length(k) >= 10 GROUP BY k HAVING count(DISTINCT doc_id) >= 2),
m AS (SELECT k.*, coalesce(f.low < k.doc_id, false) AS gone FROM k LEFT JOIN f ON f.k = k.k)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""

QUERIES = {f.__name__: f for f in (
    op1_ivf_pq_neighbours, op2_external_shuffle, op3_entropy_balanced_mix, op4_quality_ledger, op5_linked_secrets,
    op6_quotation_linking, op7_minhash_near_duplicates, op8_substring_dedup, op9_bpe_round_trip, op10_line_dedup, quality_ablations,
)}
ORACLES = {
    "op4_quality_ledger": OP4_SQL, "op6_quotation_linking": OP6_SQL, "op7_minhash_near_duplicates": OP7_SQL,
    "op8_substring_dedup": OP8_SQL, "op10_line_dedup": OP10_SQL, "quality_ablations": ABLATIONS_SQL,
}
