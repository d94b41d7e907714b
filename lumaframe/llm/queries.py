"""The registered queries of the corpus operators and the SQL of those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, embedding_dedup, filter_audit, jaccard, langid, licenses, line_dedup, media, mixing, periodic_runs, pii, suffix_dedup, warc
from .shared import documents

VOCABULARY = "byte_bpe_50k.tiktoken"


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(documents(spark, sf_dir), public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    taken = mixing.copies(documents(spark, sf_dir))
    return taken.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("n_copies")).alias("taken"))


OP4_SQL = """
WITH d AS (SELECT doc_id, text, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size FROM documents),
s AS (SELECT source, sum(size)::DOUBLE AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5.0, 2.0, 1.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS weight, 2.0::DOUBLE * source_size AS cap FROM s),
r AS (SELECT *, cap / weight AS ratio, 1.5::DOUBLE * sum(source_size) OVER () AS budget FROM w),
o AS (SELECT *, (budget - coalesce(sum(cap) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / sum(weight) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS own FROM r),
l AS (SELECT arg_min(own, ratio) AS level FROM o WHERE own <= ratio),
t AS (SELECT source, source_size, CASE WHEN source_size = 0 THEN 0 ELSE least(cap, level * weight) END AS target FROM o, l),
c AS (SELECT *, CASE WHEN size <= 0 THEN 0 ELSE floor(log2(size::DOUBLE) * 8)::INT + 1 END AS class,
  ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || '|' || coalesce(text, '')), 1, 12))::BIGINT AS spread, spread % (SELECT greatest(1, (count(*) + 5999) // 6000) FROM d) AS cell FROM d),
n AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY class, cell, size, doc_id NULLS LAST, spread) AS rank,
  (('0x' || substr(md5('mix' || coalesce(source, '')), 1, 12))::BIGINT)::DOUBLE / 281474976710656.0 AS begin FROM c)
SELECT doc_id, size::BIGINT AS size, source_size::BIGINT AS source_size, target,
  CASE WHEN size = 0 THEN 0 ELSE size * (floor(begin + rank * (target / source_size)) - floor(begin + (rank - 1) * (target / source_size))) END::BIGINT AS taken
FROM n JOIN t ON n.source IS NOT DISTINCT FROM t.source
"""


def cut_digests(found: DataFrame) -> DataFrame:
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cut_digests(suffix_dedup.drop_repeated_bytes(documents(spark, sf_dir)))


#: Every 50-byte string by its place, its smallest document, and the bytes that later ones cover.
OP2_SQL = """
WITH h AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
k AS (SELECT doc_id, x, unnest(range((len(x)//2 + 999)//1000)) AS k FROM h),
c AS (SELECT doc_id, k, substr(x, 2000*k + 1, 2098) AS part FROM k),
b AS (SELECT doc_id, k, part, unnest(range(least(1000, len(part)//2))) AS j FROM c),
w AS (SELECT doc_id, 1000*k + j AS i, substr(part, 2*j + 1, 2) AS byte, CASE WHEN 2*j + 100 <= len(part) THEN substr(part, 2*j + 1, 100) END AS s FROM b),
f AS (SELECT s, min(doc_id) AS first FROM w WHERE s IS NOT NULL GROUP BY s),
m AS (SELECT w.doc_id, i, byte, coalesce(first < w.doc_id, FALSE) AS again FROM w LEFT JOIN f ON w.s = f.s),
v AS (SELECT doc_id, i, byte, max(again::INT) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS gone FROM m),
p AS (SELECT *, gone = 1 AND coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY i), 0) = 0 AS fresh FROM v),
g AS (SELECT doc_id, sum(gone) AS n_removed, count(*) FILTER (fresh) AS n_spans, string_agg(byte, '' ORDER BY i) FILTER (gone = 0) AS kept FROM p GROUP BY doc_id)
SELECT h.doc_id, (len(x)//2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256 FROM h LEFT JOIN g ON h.doc_id = g.doc_id
"""


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.drop_repeated_lines(documents(spark, sf_dir).select("doc_id", "text"))


OP3_SQL = """
WITH l AS (SELECT doc_id, generate_subscripts(x, 1) AS i, unnest(x) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents)),
f AS (SELECT *, length(translate(line, chr(32) || chr(9) || chr(11) || chr(12) || chr(13), '')) > 0 AS filled FROM l),
n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS w FROM f WHERE filled),
t AS (SELECT doc_id, w, line || chr(10) || lead(line, 1) OVER o || chr(10) || lead(line, 2) OVER o AS win FROM n WINDOW o AS (PARTITION BY doc_id ORDER BY w)),
r AS (SELECT doc_id, w, row_number() OVER (PARTITION BY win ORDER BY doc_id, w) AS place FROM t WHERE win IS NOT NULL),
c AS (SELECT DISTINCT doc_id, w + k AS w FROM r, (VALUES (0), (1), (2)) v(k) WHERE place > 1),
k AS (SELECT f.doc_id, f.i, f.line, c.w IS NOT NULL AS gone FROM f LEFT JOIN n ON f.doc_id = n.doc_id AND f.i = n.i LEFT JOIN c ON n.doc_id = c.doc_id AND n.w = c.w),
g AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone) AS text, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed FROM k GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NOT NULL THEN coalesce(g.text, '') END AS text, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_removed, 0)::BIGINT AS n_removed
FROM documents d LEFT JOIN g ON d.doc_id = g.doc_id
"""


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymise(documents(spark, sf_dir).select("doc_id", "text"))


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


#: All pairs of vectors, then what links reach.
OP6_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
f AS (SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS n FROM v WHERE len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM f a JOIN f b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_dot_product(a.e, b.e)/(a.n*b.n) >= 0.95),
r(id, reached) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.id, l.b FROM r JOIN l ON r.reached = l.a),
c AS (SELECT id, min(reached) AS component_id FROM r GROUP BY id), n AS (SELECT a, count(*) AS n_links FROM l GROUP BY a)
SELECT id AS vec_id, coalesce(n_links, 0)::BIGINT AS n_links, component_id, component_id = id AS kept FROM c LEFT JOIN n ON n.a = c.id
"""


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.classes(documents(spark, sf_dir), size=4, percent=85)


#: Pairs by shared shingles, then what links reach.
OP7_SQL = """
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 4 THEN list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS sh FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
x AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM x JOIN n p ON a = p.doc_id JOIN n q ON b = q.doc_id WHERE 100*c >= 85*(p.n + q.n - c)),
r(id, reached) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.id, l.b FROM r JOIN l ON r.reached = l.a)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id FROM d LEFT JOIN n ON d.doc_id = n.doc_id JOIN (SELECT id, min(reached) AS component_id FROM r GROUP BY id) c ON c.id = d.doc_id
"""


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    found = langid.predict(docs.select("doc_id", "text"), langid.train(docs))
    return found.select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(documents(spark, sf_dir)).drop("matches")


def op9_sql() -> str:
    """All places of base phrases, and for each template the best run of as many words as it has, by joins of words."""
    rows, number = [], 0
    for label, several in licenses.TEMPLATES.items():
        for template in several:
            words = licenses.words_of(template)
            own = sorted(set(words))
            rows += [f"({number}, '{label}', {len(words)}, {len(own)}, {licenses.needed(len(own), licenses.THRESHOLD)}, '{w}')" for w in own]
            number += 1
    base = [(p.split() + [None, None], label) for p, label in licenses.BASE.items()]
    places = " UNION ALL ".join(
        f"SELECT doc_id, pos, '{label}' AS label FROM n WHERE word = '{p[0]}' AND w1 = '{p[1]}'" + (f" AND w2 = '{p[2]}'" if p[2] else "") for p, label in base
    )
    return f"""
WITH t(tid, label, len, n, need, word) AS (VALUES {", ".join(rows)}),
x AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS x FROM documents),
w AS (SELECT doc_id, unnest(x) AS word, generate_subscripts(x, 1) - 1 AS pos FROM x),
h AS (SELECT doc_id, tid, label, len, n, need, word, pos FROM w JOIN t USING (word)),
b AS (SELECT s.doc_id, s.tid, s.label, s.n, s.need, s.pos, count(DISTINCT e.word) AS held FROM h s JOIN h e ON s.doc_id = e.doc_id AND s.tid = e.tid AND e.pos BETWEEN s.pos AND s.pos + s.len - 1 GROUP BY ALL),
m AS (SELECT doc_id, label, max(held / n::DOUBLE) AS part FROM b WHERE held >= need GROUP BY ALL),
n AS (SELECT doc_id, pos, word, lead(word, 1) OVER o AS w1, lead(word, 2) OVER o AS w2 FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY pos)),
p AS ({places}),
q AS (SELECT doc_id, count(*) AS n_base, min(pos) AS first_word, max(pos) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM p GROUP BY doc_id),
a AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT doc_id, label FROM p UNION ALL SELECT doc_id, label FROM m) GROUP BY doc_id),
s AS (SELECT doc_id, max(part) AS part FROM m GROUP BY doc_id)
SELECT x.doc_id, len(x)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce(part, 0) END::DOUBLE AS score
FROM x LEFT JOIN q ON x.doc_id = q.doc_id LEFT JOIN a ON x.doc_id = a.doc_id LEFT JOIN s ON x.doc_id = s.doc_id
"""


def op10_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = media.described(documents(spark, sf_dir))
    return found.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", F.col("length").alias("media_bytes"), "media_sha256", "feature")

def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.filter_audit(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


#: Each order and step by the bits of its filter and of those before it, over counts of masks.
OP11_SQL = """
WITH w AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
m AS (SELECT doc_id, part, (len(words) < 50)::INT + 2 * (100 * len(list_distinct(words)) < 65 * len(words))::INT
  + 4 * (100 * len(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * len(t))::INT + 8 * regexp_matches(t, '[#$%&*|]')::INT
  + 16 * coalesce(min(doc_id) OVER (PARTITION BY t) < doc_id, FALSE)::INT AS mask FROM w),
l AS (SELECT doc_id, max((coalesce(quality, 0) = 1)::INT) AS good, max((coalesce(toxic, 0) = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
h AS (SELECT part, mask, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic FROM m LEFT JOIN l ON m.doc_id = l.doc_id GROUP BY part, mask),
f(x) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')),
o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM f a JOIN f b ON b.x <> a.x JOIN f c ON c.x NOT IN (a.x, b.x) JOIN f d ON d.x NOT IN (a.x, b.x, c.x) JOIN f e ON e.x NOT IN (a.x, b.x, c.x, d.x)),
s AS (SELECT filter_order, k AS step, 1 << (ascii(substr(filter_order, k, 1)) - 65) AS bit FROM o, (VALUES (1), (2), (3), (4), (5)) v(k)),
b AS (SELECT *, sum(bit) OVER (PARTITION BY filter_order ORDER BY step)::BIGINT - bit AS earlier FROM s),
r AS (SELECT part, filter_order, step, bit, coalesce(sum(n) FILTER (mask & (bit + earlier) = 0), 0) AS kept, coalesce(sum(n) FILTER (mask & bit <> 0 AND mask & earlier = 0), 0) AS removed,
  coalesce(sum(n) FILTER (mask & bit <> 0 AND mask & earlier <> 0), 0) AS redundant, coalesce(sum(n) FILTER (mask = bit), 0) AS unique_fails,
  coalesce(sum(good) FILTER (mask & bit <> 0 AND mask & earlier = 0), 0) AS good_lost, coalesce(sum(toxic) FILTER (mask & bit <> 0 AND mask & earlier = 0), 0) AS toxic_lost
  FROM h, b GROUP BY part, filter_order, step, bit)
SELECT part, filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
  good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley FROM r
"""


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.index(warc.chunks(warc.write(spark.read.parquet(f"{sf_dir}/pages.parquet"))))
    return found.select(F.col("key").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast("long").alias("refers_to"))


#: Base32 by twenty bits of the SHA-1 at a time.
OP12_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS t FROM pages),
f AS (SELECT page_id, octet_length(encode(t)) AS n, sha1(t) AS h, min(page_id) OVER (PARTITION BY t) AS first FROM p)
SELECT page_id, n::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(h, 5 * (i // 4) + 1, 5))::BIGINT >> (15 - 5 * (i % 4))) & 31)::INT + 1, 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
FROM f
"""


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, text): documents whose crc32(doc_id) ends in 0 become periodic from some word on; the others stay as they are."""
    mark = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    rows = docs.select("doc_id", "text", mark.alias("h"), F.floor(mark / 10).cast("long").alias("g"))
    rows = rows.withColumn("w", F.array_remove(F.split(F.when(F.col("h") % 10 == 0, F.col("text")), periodic_runs.SPACES), "")).withColumn("n", F.size("w").cast("long"))
    rows = rows.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n"))).withColumn("rest", F.col("n") - F.col("a"))
    rows = rows.withColumn("p", 1 + F.floor(F.col("rest") / (3 + F.col("g") % 8)))
    number = lambda c: F.col(c).cast("int")
    times = F.ceil(F.col("rest") / F.col("p")).cast("int")
    repeated = F.slice(F.flatten(F.array_repeat(F.slice("w", number("a") + 1, number("p")), times)), F.lit(1), number("rest"))
    planted = F.concat_ws(" ", F.concat(F.slice("w", F.lit(1), number("a")), repeated))
    return rows.select("doc_id", F.when(F.col("n") > 0, planted).otherwise(F.col("text")).alias("text"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.collapse(with_planted_runs(documents(spark, sf_dir)))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    lines = F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise("")
    found = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    start, length, period = -F.col("best.start"), F.col("best.length"), -F.col("best.period")
    return found.select("doc_id", "n_runs", start.alias("start"), length.alias("length"), period.alias("period"), F.floor(1000 * length / period).cast("long").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


QUERIES = {
    "op1_bpe": op1_bpe,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op3_line_dedup": op3_line_dedup,
    "op4_mixing": op4_mixing,
    "op5_pii": op5_pii,
    "op6_embedding_dedup": op6_embedding_dedup,
    "op7_jaccard_join": op7_jaccard_join,
    "op8_language_id": op8_language_id,
    "op9_license_scan": op9_license_scan,
    "op10_media_columns": op10_media_columns,
    "op11_filter_audit": op11_filter_audit,
    "op12_warc": op12_warc,
    "op13_periodic_runs": op13_periodic_runs,
}
ORACLES = {
    "op2_suffix_dedup": OP2_SQL,
    "op3_line_dedup": OP3_SQL,
    "op4_mixing": OP4_SQL,
    "op6_embedding_dedup": OP6_SQL,
    "op7_jaccard_join": OP7_SQL,
    "op9_license_scan": op9_sql(),
    "op11_filter_audit": OP11_SQL,
    "op12_warc": OP12_SQL,
}
