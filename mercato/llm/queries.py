"""The corpus operators as queries, with SQL twins where SQL can say them."""

from __future__ import annotations

from pyspark.sql import functions as F

import corpus_pipeline
from mercato.llm import (
    exact_dedup, html, lines, mixing, near_duplicates, packing, passages, periodic, quality, sharding, spelling, urls, warc,
)
from mercato.llm.common import bind, table, word_count, words

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def register(build):
        QUERIES[name] = build
        if sql is not None:
            ORACLES[name] = sql.strip()
        return build

    return register


SPACES = r"[\x20\x09-\x0D]"
RULES = [("symbols", "n_symbols / greatest(n_words, 1)"), ("marks", "n_marks / greatest(n_words, 1)"),
         ("dup_lines", "n_dup_lines / greatest(n_lines, 1)"), ("repeats", "n_repeat_words / greatest(n_words, 1)")]
TRIED = " UNION ALL ".join(
    f"SELECT stratum, '{rule}' AS rule, {i} AS step, {cut} AS cutoff, count(*) AS n, "
    f"count(*) FILTER (WHERE {value} >= {cut}::DOUBLE) AS k FROM held GROUP BY stratum"
    for rule, value in RULES for i, cut in enumerate(quality.CUTOFFS[rule]))
REJECTED = " OR ".join(f"coalesce({value} >= cut_{rule}, false)" for rule, value in RULES)
CUT_COLUMNS = ", ".join(f"min(cutoff::DOUBLE) FILTER (WHERE rule = '{rule}' AND accepted) AS cut_{rule}" for rule, _ in RULES)


@query("op1_quality_rules", rf"""
WITH plain AS (SELECT doc_id, lang, coalesce(text, '') AS t FROM documents),
worded AS (
  SELECT doc_id, lang AS stratum, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM plain),
windows AS (
  SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS piece
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 6, 1))) AS i FROM worded)),
twice AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, piece) AS c FROM windows) WHERE c > 1),
repeats AS (
  SELECT doc_id, count(DISTINCT place) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS place FROM twice) GROUP BY doc_id),
found AS (
  SELECT doc_id, stratum, len(w) AS n_words, length(regexp_replace(t, '{SPACES}+', '', 'g')) AS word_chars,
         length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
         len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words,
         len(lines) AS n_lines, length(t) - length(replace(t, '!', '')) AS n_marks
  FROM worded LEFT JOIN repeats USING (doc_id)),
judged AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM found),
held AS (
  SELECT * FROM judged WHERE NOT base_failed
  AND doc_id IN (SELECT doc_id FROM labels GROUP BY doc_id HAVING max(quality) = 1)),
tried AS ({TRIED}),
tested AS (
  SELECT *, CASE WHEN k >= n * 0.0125 THEN 1.0 ELSE (
    SELECT sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln(0.0125::DOUBLE) + (n - i) * ln(0.9875::DOUBLE)))
    FROM (SELECT unnest(range(0, k + 1)) AS i)) END AS p
  FROM tried),
sequenced AS (
  SELECT *, min(CASE WHEN p <= 0.05 / (4 * (SELECT count(DISTINCT stratum) FROM held)) THEN 1 ELSE 0 END)
            OVER (PARTITION BY stratum, rule ORDER BY step) = 1 AS accepted FROM tested),
chosen AS (SELECT stratum, {CUT_COLUMNS} FROM sequenced GROUP BY stratum)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT ({REJECTED}) AS kept
FROM judged LEFT JOIN chosen ON judged.stratum IS NOT DISTINCT FROM chosen.stratum
""")
def op1_quality_rules(spark, sf_dir):
    return quality.quality_verdicts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("rejected_by", "stratum")


LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@query("op6_exact_dedup", f"""
WITH plain AS (SELECT doc_id, {LOWERED} AS t FROM documents),
groups AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM plain GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256
FROM plain JOIN groups USING (t)
""")
def op6_exact_dedup(spark, sf_dir):
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents")).drop("mark")


@query("op3_hypergeometric_shards")
def op3_hypergeometric_shards(spark, sf_dir):
    text = F.coalesce("text", F.lit(""))
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"),
        F.lit("rows").alias("law"))
    return sharding.uniform_shards(docs, 8).withColumn("grown_shard", F.lit(None).cast("int"))


@query("op9_mix_sources", r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || '|' || md5(coalesce(text, '')) || '|0'), 1, 13))::BIGINT AS r
  FROM documents),
sources AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT *, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::DOUBLE AS w, 3.0::DOUBLE * source_size AS cap FROM sources),
levels AS (
  SELECT *, ((sum(source_size) OVER ())::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM weighed),
targets AS (
  SELECT source, source_size, least(cap, coalesce(max(level) FILTER (WHERE level * w <= cap) OVER () * w, cap)) AS target FROM levels),
placed AS (
  SELECT s.*, source_size, target, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS passes,
         floor(r / 4503599627370496.0::DOUBLE * greatest(1, least(65536, ceil(source_size / 20000::DOUBLE))))::BIGINT AS block
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
blocks AS (SELECT source, block, sum(size) AS words FROM placed GROUP BY source, block),
summed AS (SELECT *, sum(words) OVER (PARTITION BY source ORDER BY block) AS up_to FROM blocks),
ranked AS (
  SELECT p.*, up_to, words, target - passes * source_size AS rest,
         sum(size) OVER (PARTITION BY p.source, p.block ORDER BY r RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
         - sum(size) OVER (PARTITION BY p.source, p.block, r) / 2.0::DOUBLE AS middle
  FROM placed p JOIN summed b ON p.source IS NOT DISTINCT FROM b.source AND p.block = b.block)
SELECT doc_id, size, source_size, target,
       (size * (passes + CASE WHEN up_to <= rest OR (up_to - words < rest AND middle <= rest - up_to + words) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM ranked
""")
def op9_mix_sources(spark, sf_dir):
    return mixing.words_taken(table(spark, sf_dir, "documents")).drop("shards")


@query("op10_best_fit_packing")
def op10_best_fit_packing(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", word_count(F.col("text")).alias("length"))
    return packing.pack(docs)


@query("op2_warc_salvage", """
WITH plain AS (SELECT page_id, coalesce(html, '') AS t FROM pages),
sized AS (SELECT page_id, strlen(t) AS payload_bytes, sha1(t) AS payload_digest, max(page_id) OVER (PARTITION BY t) AS first FROM plain)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id <> first THEN first END AS refers_to
FROM sized
""")
def op2_warc_salvage(spark, sf_dir):
    return warc.round_trip(table(spark, sf_dir, "pages"))


URL_RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]


@query("op8_link_trust")
def op8_link_trust(spark, sf_dir):
    return urls.judge_urls(table(spark, sf_dir, "pages"), URL_RULES)


@query("op4_wrapper_induction")
def op4_wrapper_induction(spark, sf_dir):
    return html.extract(table(spark, sf_dir, "pages"))


@query("op7_lsh_forest_join")
def op7_lsh_forest_join(spark, sf_dir):
    return near_duplicates.similar_texts(table(spark, sf_dir, "documents")).drop("mark")


@query("op5_repeated_passages")
def op5_repeated_passages(spark, sf_dir):
    return passages.repeated_passages(table(spark, sf_dir, "documents")).drop("mark")


# The SQL twin counts CRC-32 itself: a table of 256 entries, then byte by byte.
CRC_BIT = "CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END"


@query("op11_spelling_variants", rf"""
WITH RECURSIVE crc_table AS (
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, _: {CRC_BIT}) AS c FROM (SELECT unnest(range(256)) AS i))),
runs AS (
  SELECT doc_id, run, count(*) AS n FROM (
    SELECT doc_id, unnest(regexp_extract_all({LOWERED}, '[A-Za-zÀ-ÿ]+')) AS run FROM documents) GROUP BY ALL),
coded AS (
  SELECT run, n, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)) AS x FROM runs),
hashed AS (
  SELECT run, n, xor(list_reduce(list_prepend(4294967295, list_transform(range(len(x) // 2), lambda i: ('0x' || x[2 * i + 1:2 * i + 2])::BIGINT)),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS h FROM coded, crc_table),
words AS (
  SELECT CASE WHEN h % 199 = 0 THEN left(run, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, n
  FROM hashed),
vocabulary AS (
  SELECT word, sum(n)::BIGINT AS n FROM words WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
holes AS (
  SELECT word, n, i, left(word, i) || substr(word, i + 2) AS rest FROM (SELECT word, n, unnest(range(length(word))) AS i FROM vocabulary)),
near AS (
  SELECT a.word, b.word AS other, b.n FROM holes a JOIN holes b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT a.word, v.word, v.n FROM holes a JOIN vocabulary v ON a.rest = v.word
  UNION SELECT v.word, a.word, a.n FROM holes a JOIN vocabulary v ON a.rest = v.word),
best AS (SELECT word, count(*) AS n_near, max(n) AS top_n, arg_min(other, {{'minus': -n, 'other': other}}) AS top FROM near GROUP BY word),
forms AS (
  SELECT word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN top_n >= 5 * v.n THEN top END AS form, CASE WHEN top_n >= 5 * v.n THEN top_n END AS form_n
  FROM vocabulary v LEFT JOIN best USING (word)),
led AS (
  SELECT word, form AS root, 1 AS step FROM forms WHERE form IS NOT NULL
  UNION ALL SELECT led.word, forms.form, step + 1 FROM led JOIN forms ON led.root = forms.word WHERE forms.form IS NOT NULL)
SELECT word, form, coalesce(r.root, word) AS root, n, n_near, form_n
FROM forms LEFT JOIN (SELECT word, arg_max(root, step) AS root FROM led GROUP BY word) r USING (word)
""")
def op11_spelling_variants(spark, sf_dir):
    def rewritten(run):
        h = F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), run))
        at = F.pmod(h, F.length(run)).cast("int")
        without = F.concat(F.substr(run, F.lit(1), at), F.substr(run, at + 2, F.length(run)))
        return F.when(h % 199 == 0, without).otherwise(run)

    docs = table(spark, sf_dir, "documents")
    return spelling.spelling_groups(spelling.word_counts(docs, r"[A-Za-z\u00C0-\u00FF]+", rewrite=rewritten, keep=["doc_id"]))


@query("op12_line_dedup", rf"""
WITH lines AS (
  SELECT doc_id, i, line, length(key) >= 40 AS long, key FROM (
    SELECT doc_id, i, line, trim(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS key
    FROM (SELECT doc_id, unnest(x) AS line, unnest(range(len(x))) AS i FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS x FROM documents)))),
shared AS (SELECT key, max(doc_id) AS keeper FROM lines WHERE long GROUP BY key HAVING count(DISTINCT doc_id) >= 5)
SELECT doc_id, count(*) AS n_lines, count(keeper) FILTER (WHERE doc_id <> keeper) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE keeper IS NULL OR doc_id = keeper), '')) AS kept_sha256
FROM lines LEFT JOIN shared USING (key) GROUP BY doc_id
""")
def op12_line_dedup(spark, sf_dir):
    kept = lines.drop_shared_lines(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def with_planted_runs(docs):
    """Texts in which every tenth document, by its id's hash, goes on periodically from some word."""
    h = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    g = F.floor(h / 10)

    def planted(held):
        n = F.size(held)
        a = F.pmod(g, n).cast("int")
        p = (F.floor((n - a) / (F.pmod(g, F.lit(8)) + 3)) + 1).cast("int")
        return F.transform(held, lambda w, i: F.when(i >= a, F.get(held, a + F.pmod(i - a, p))).otherwise(w))

    text = F.array_join(bind(words(F.col("text")), planted), " ")
    return docs.select("doc_id", F.when(h % 10 == 0, text).otherwise(F.col("text")).alias("text"))


@query("op13_periodic_runs")
def op13_periodic_runs(spark, sf_dir):
    found = periodic.find_periodic_runs(with_planted_runs(table(spark, sf_dir, "documents")))
    listed = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    best = F.array_min(F.transform("runs", lambda r: F.struct(
        (-r["length"]).alias("minus"), r["start"].alias("start"), r["period"].alias("period"))))
    length = -F.col("best.minus")
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"), length.alias("length"),
        F.col("best.period").alias("period"), F.floor(1000 * length / F.col("best.period")).alias("exponent_milli"),
        F.sha2(F.when(F.size("runs") > 0, F.concat(listed, F.lit("\n"))).otherwise(""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"))


@query("pipeline", corpus_pipeline.ORACLE_SQL)
def pipeline(spark, sf_dir):
    return corpus_pipeline.run(spark, sf_dir)
