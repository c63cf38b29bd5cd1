"""The queries of this subpackage and the SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from tessera.llm import blockmax, decontam, exact, filter_audit, langid, lines, minhash, mixing, pieces, quality, secrets, substring, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substring.substring_dedup(_table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_dedup(_table(spark, sf_dir, "documents"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.warc_round_trip(_table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.language_id(_table(spark, sf_dir, "documents"))


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_dedup(_table(spark, sf_dir, "documents"), size=4, percent=80)


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest_columns(secrets.secret_scan(_table(spark, sf_dir, "documents")))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality.score_quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return scored.withColumn("predicted", (F.col("score") >= 0.7).cast("int"))


def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.poisson_mix(_table(spark, sf_dir, "documents"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.line_dedup(_table(spark, sf_dir, "documents"))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")).drop("th")


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blockmax.ranked_search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op12_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    rows = pieces.round_trip(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return rows.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.filter_audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


OP1_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
win AS (SELECT doc_id, s, array_to_string(ws[s:s + 19], ' ') AS k FROM w, LATERAL (SELECT unnest(range(1, len(ws) - 18)) AS s) g),
again AS (SELECT doc_id, s FROM win QUALIFY row_number() OVER (PARTITION BY k ORDER BY doc_id, s) > 1),
gone AS (SELECT doc_id, list(DISTINCT s + j) AS places FROM again, range(0, 20) AS r(j) GROUP BY doc_id),
kept AS (SELECT w.doc_id, len(ws) AS n_words, CASE WHEN places IS NULL THEN ws ELSE list_filter(ws, lambda x, i: NOT list_contains(places, i)) END AS ks FROM w LEFT JOIN gone USING (doc_id))
SELECT doc_id, n_words::BIGINT AS n_words, (n_words - len(ks))::BIGINT AS n_removed, sha256(array_to_string(ks, ' ')) AS kept_sha256 FROM kept
"""

OP2_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER w AS keep_id,
       count(*) OVER (PARTITION BY norm) AS group_size,
       doc_id = first_value(doc_id) OVER w AS kept,
       sha256(norm) AS text_sha256
FROM d WINDOW w AS (PARTITION BY norm ORDER BY length(t) DESC, doc_id)
"""

OP3_SQL = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS x FROM pages),
q AS (SELECT page_id, h, list_transform(range(0, 8), lambda i: ('0x' || substr(x, 1 + 5 * i, 5))::BIGINT) AS v, max(page_id) OVER (PARTITION BY h) AS top FROM p)
SELECT page_id, octet_length(encode(h))::BIGINT AS payload_bytes,
       array_to_string(list_transform(v, lambda n: array_to_string(list_transform([15, 10, 5, 0], lambda s: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((n >> s) & 31) + 1)::INT, 1)), '')), '') AS payload_digest,
       CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> top THEN top END AS refers_to
FROM q
"""

OP5_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
sh AS (SELECT DISTINCT doc_id, array_to_string(ws[s:s + 3], ' ') AS g FROM w, LATERAL (SELECT unnest(range(1, greatest(len(ws) - 2, 2))) AS s) t WHERE len(ws) > 0),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
links AS (SELECT a.doc_id AS a, b.doc_id AS b FROM sh a JOIN sh b ON a.g = b.g AND a.doc_id <> b.doc_id JOIN n x ON x.doc_id = a.doc_id JOIN n y ON y.doc_id = b.doc_id
          GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 80 * (min(x.n) + min(y.n) - count(*))),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
c AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT c.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, c.doc_id = component_id AS kept FROM c LEFT JOIN n USING (doc_id)
"""

OP8_SQL = r"""
WITH s AS (SELECT source, sum(greatest(length(coalesce(text, '')), 1))::BIGINT AS chars FROM documents GROUP BY source),
r AS (SELECT source, round(1.0 * sum(chars) OVER () * (pow(chars::DOUBLE, 0.5) / sum(pow(chars::DOUBLE, 0.5)) OVER ()) / chars, 9) AS rate FROM s),
term AS (SELECT source, rate, k, exp(-rate + k * ln(rate) - lgamma(k + 1)) AS p FROM r, range(0, 4000) AS g(k) WHERE k <= ceil(rate + 12 * sqrt(rate) + 24)),
cdf AS (SELECT source, k, round(least(sum(p) OVER (PARTITION BY source ORDER BY k), 1.0), 12) AS c FROM term),
u AS (SELECT *, ('0x' || substr(md5('17:' || coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))), 1, 13))::BIGINT / 4503599627370496.0 AS u FROM documents),
n AS (SELECT u.doc_id, u.text, u.lang, u.source, u.n_chars, u.u, count(*) AS copies FROM u JOIN cdf ON u.source IS NOT DISTINCT FROM cdf.source AND cdf.c <= u.u GROUP BY ALL)
SELECT doc_id, text, lang, source, n_chars, g.copy::INT AS copy, md5('order:17:' || coalesce(doc_id::VARCHAR, '') || ':' || g.copy) AS shuffle_key
FROM n, LATERAL (SELECT unnest(range(0, copies)) AS copy) g
"""

OP11_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
tf AS (SELECT doc_id, len(ts) AS n, t, count(*) AS tf FROM (SELECT doc_id, ts, unnest(ts) AS t FROM d) GROUP BY ALL),
nl AS (SELECT count(*) AS docs, sum(len(ts))::BIGINT AS total FROM d WHERE len(ts) > 0),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM benchmark),
w AS (SELECT t, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM tf, nl WHERE t IN (SELECT t FROM q) GROUP BY t, docs),
s AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * docs) // total))))::BIGINT AS score FROM q JOIN w USING (t) JOIN tf USING (t), nl GROUP BY item_id, doc_id),
r AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 10
"""

OP13_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
l AS (SELECT doc_id, max(quality = 1) AS good, max(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
v AS (SELECT d.part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
             [len(ws) < 50, 100 * len(list_distinct(ws)) < 65 * len(ws), 100 * (length(t) - length(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', ''))) > 5 * length(t),
              regexp_matches(t, '[#$%&*|]'), d.doc_id > min(d.doc_id) OVER (PARTITION BY t)] AS f
      FROM d LEFT JOIN l USING (doc_id)),
m AS (SELECT part, f, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM v GROUP BY part, f),
p(x) AS (VALUES (1), (2), (3), (4), (5)),
o AS (SELECT [a.x, b.x, c.x, d.x, e.x] AS o FROM p a, p b, p c, p d, p e WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
s AS (SELECT o, step, o[step] AS letter, o[1:step - 1] AS before FROM o, range(1, 6) AS g(step)),
x AS (SELECT part, o, step, letter,
             sum(n * (NOT f[letter] AND NOT coalesce(list_bool_or(list_transform(before, lambda i: f[i])), false))::INT)::BIGINT AS kept,
             sum(n * (f[letter] AND NOT coalesce(list_bool_or(list_transform(before, lambda i: f[i])), false))::INT)::BIGINT AS removed,
             sum(n * (f[letter] AND coalesce(list_bool_or(list_transform(before, lambda i: f[i])), false))::INT)::BIGINT AS redundant,
             sum(n * (f[letter] AND len(list_filter(f, lambda y: y)) = 1)::INT)::BIGINT AS unique_fails,
             sum(good * (f[letter] AND NOT coalesce(list_bool_or(list_transform(before, lambda i: f[i])), false))::INT)::BIGINT AS good_lost,
             sum(toxic * (f[letter] AND NOT coalesce(list_bool_or(list_transform(before, lambda i: f[i])), false))::INT)::BIGINT AS toxic_lost
      FROM m, s GROUP BY part, o, step, letter)
SELECT part, array_to_string(list_transform(o, lambda i: substr('ABCDE', i, 1)), '') AS filter_order, step::INT AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       (sum(removed) OVER (PARTITION BY part, letter))::BIGINT AS shapley
FROM x
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_substring_dedup": op1_substring_dedup,
        "op2_exact_dedup": op2_exact_dedup,
        "op3_warc": op3_warc,
        "op4_language_id": op4_language_id,
        "op5_near_dedup": op5_near_dedup,
        "op6_secret_scan": op6_secret_scan,
        "op7_quality": op7_quality,
        "op8_mix_sources": op8_mix_sources,
        "op9_line_dedup": op9_line_dedup,
        "op10_decontaminate": op10_decontaminate,
        "op11_ranked_search": op11_ranked_search,
        "op12_sentencepiece": op12_sentencepiece,
        "op13_filter_audit": op13_filter_audit,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_substring_dedup": OP1_SQL, "op2_exact_dedup": OP2_SQL, "op3_warc": OP3_SQL, "op5_near_dedup": OP5_SQL, "op8_mix_sources": OP8_SQL, "op11_ranked_search": OP11_SQL, "op13_filter_audit": OP13_SQL}
