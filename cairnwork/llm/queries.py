"""The registered queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

import hashlib

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontam, exactdup, html, pathjoin, piece, quality, sharding, tokenfile, urlfilter, vectorcode, whitening, wordpieces
from .common import fresh_path, table

PIECE_MODEL = public_tokenizers.path("piece_bpe_32k.model")
BYTE_MODEL = public_tokenizers.path("byte_bpe_50k.json")
WORD_MODEL = public_tokenizers.path("word_bpe_49k.json")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op2_urlfilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.filter_urls(table(spark, sf_dir, "pages"), urlfilter.labelled_urls(spark)).select("page_id", "host", "path", "rule", "verdict")


def op3_interleave(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sharding.interleave(table(spark, sf_dir, "documents"), shards=8)
    return rows.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op4_tokenfile(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "tokens")
    tokenfile.write_tokens(table(spark, sf_dir, "documents"), path, BYTE_MODEL, end_id=2, special_as_text=False)
    return tokenfile.read_tokens(spark, path).select("doc_id", "start", "n_tokens", tokenfile.ids_crc32("ids").alias("ids_crc32"))


def op5_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = piece.encode_pieces(table(spark, sf_dir, "documents").select("doc_id", "text"), PIECE_MODEL)
    return rows.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"), F.coalesce(F.array_max("ends"), F.lit(0)).cast("long").alias("n_bytes"),
    )


def op6_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract_text(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op7_exactdup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exactdup.exact_dedup(table(spark, sf_dir, "documents"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_quotelink(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chat(table(spark, sf_dir, "conversations"))


def op10_pathjoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pathjoin.near_classes(table(spark, sf_dir, "documents"))


def op11_vectorcode(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes, books = vectorcode.compress_vectors(table(spark, sf_dir, "embeddings"))
    digest = hashlib.sha256(",".join(str(c) for c in books.ravel()).encode()).hexdigest()
    return codes.select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def op12_wordpieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = wordpieces.encode_words(table(spark, sf_dir, "documents"), WORD_MODEL)
    return rows.select("doc_id", "n_tokens", F.sha2("packed_ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def quoted_threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The conversations as threads with quotes: message t quotes a remark of message t / 2, and in it that of t / 4."""
    told = table(spark, sf_dir, "conversations")
    body = F.trim(F.regexp_replace("text", "[\\x00-\\x20]+", " "))
    quote = lambda mark, part: F.when(F.col("turn") >= part, F.concat(F.lit(mark + " Remark "), F.expr(f"turn div {part}"), F.lit(" of this thread.\n"))).otherwise("")
    threads = told.select("conv_id", "turn", "role", F.concat(quote(">>", 4), quote(">", 2), F.lit("Remark "), "turn", F.lit(" of this thread. "), body).alias("text"))
    out = chat.format_chat(threads)
    origin = lambda level: F.get(F.filter("origins", lambda o: o["level"] == level), 0)["turn"]
    return out.select("conv_id", "turn", "role", F.sha2("text", 256).alias("text_sha256"), "parent_turn", "linked", origin(1).alias("level1"), origin(2).alias("level2"), "position", F.col("n_quotes").cast("long").alias("n_quotes"))


def url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op2 reads off each url before the model has its say."""
    judged = urlfilter.filter_urls(table(spark, sf_dir, "pages"), urlfilter.labelled_urls(spark))
    return judged.select("page_id", "host", "path", "rule", F.when(F.col("rule").isNotNull(), F.col("verdict")).alias("rule_verdict"))


def shard_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op3's places, without what SQL has no function for."""
    return sharding.interleave(table(spark, sf_dir, "documents"), shards=8).select("doc_id", "size", "shard", "slot")


def vector_deviations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op13's count and exact deviations, without eigenvectors, which SQL has no function for."""
    vectors, d = whitening.whole_vectors(table(spark, sf_dir, "embeddings"))
    fitted = whitening.fit(whitening.moments(vectors, d), components=0)
    return whitening.project(vectors, fitted).select("vec_id", F.lit(fitted.moments.n).cast("long").alias("n"), "deviation")


def _codes_sql(rounds: int = 4) -> str:
    """op11 as SQL: every distance of every round, by inner products of whole numbers."""
    nearest = """
a{r} AS MATERIALIZED (SELECT rid, p, k % 256 AS e, k // 256 AS error FROM (SELECT rid, s.p, min(CAST(s.yy - 2 * list_inner_product(s.y, b.y) + list_inner_product(b.y, b.y) AS BIGINT) * 256 + b.e) AS k FROM s JOIN b{r} b ON s.p = b.p GROUP BY 1, 2))"""
    moved = """,
m{r} AS (SELECT p, e, list(c ORDER BY i) AS y FROM (SELECT a.p, a.e, i, floor(sum(s.y[i]) / count(*)) AS c FROM a{r} a JOIN s USING (rid, p), unnest(range(1, len(s.y) + 1)) AS t(i) GROUP BY 1, 2, 3) GROUP BY 1, 2),
b{n} AS MATERIALIZED (SELECT b.p, b.e, coalesce(m.y, b.y) AS y FROM b{r} b LEFT JOIN m{r} m USING (p, e)),"""
    steps = "".join(nearest.format(r=r) + (moved.format(r=r, n=r + 1) if r < rounds else "") for r in range(rounds + 1))
    return f"""
WITH v AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id, embedding) AS rid, vec_id, label, list_transform(embedding, lambda c: floor(1024 * CAST(c AS DOUBLE))) AS x FROM embeddings
WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
s AS MATERIALIZED (SELECT rid, p, y, list_inner_product(y, y) AS yy FROM (SELECT rid, p, x[p * len(x) // 4 + 1 : (p + 1) * len(x) // 4] AS y FROM v, unnest(range(4)) AS t(p))),
b0 AS (SELECT p, rid - 1 AS e, y FROM s WHERE rid <= 256),{steps},
d AS (SELECT sha256(string_agg(CAST(CAST(y[i] AS BIGINT) AS VARCHAR), ',' ORDER BY p, e, i)) AS codebooks_sha256 FROM b{rounds}, unnest(range(1, len(y) + 1)) AS t(i)),
c AS (SELECT rid, string_agg(printf('%02x', e), '' ORDER BY p) AS code, CAST(sum(error) AS BIGINT) AS error FROM a{rounds} GROUP BY 1)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM v JOIN c USING (rid), d"""


QUERIES = {f.__name__: f for f in (op1_decontaminate, op2_urlfilter, op3_interleave, op4_tokenfile, op5_pieces, op6_extract, op7_exactdup, op8_quality, op9_quotelink, op10_pathjoin, op11_vectorcode, op12_wordpieces, op13_whitening, quoted_threads, url_rules, shard_slots, vector_deviations)}

ORACLE_SQL = {
    "op1_decontaminate": r"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(w), 10) AS size, array_to_string(w[i + 1 : i + least(len(w), 10)], ' ') AS win FROM b, unnest(range(0, greatest(len(w) - 9, least(len(w), 1)))) AS t(i)),
sizes AS (SELECT DISTINCT size FROM bw),
dw AS (SELECT rid, size, i AS pos, array_to_string(w[i + 1 : i + size], ' ') AS win FROM d, sizes, unnest(range(0, len(w) - size + 1)) AS t(i)),
m AS (SELECT rid, item_id, pos, bw.size FROM dw JOIN bw ON dw.size = bw.size AND dw.win = bw.win),
h AS (SELECT rid, count(DISTINCT p) AS n_hit FROM m, unnest(range(pos, pos + size)) AS t(p) GROUP BY 1),
i AS (SELECT rid, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS items FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS s FROM m) GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (rid) LEFT JOIN i USING (rid)""",
    "op7_exactdup": r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, row_number() OVER (PARTITION BY t ORDER BY doc_id NULLS LAST) = 1 AS kept, sha256(t) AS text_sha256 FROM n WINDOW w AS (PARTITION BY t)""",
    "quoted_threads": r"""
WITH RECURSIVE m AS (SELECT conv_id, turn, role, 'Remark ' || turn || ' of this thread. ' || trim(regexp_replace(text, '[\x00-\x20]+', ' ', 'g')) AS own, CASE WHEN turn > 0 THEN turn // 2 END AS parent,
CASE WHEN turn >= 2 THEN turn // 2 END AS level1, CASE WHEN turn >= 4 THEN turn // 4 END AS level2 FROM conversations),
w AS (SELECT conv_id, turn, [turn] AS path FROM m WHERE parent IS NULL UNION ALL SELECT m.conv_id, m.turn, list_append(w.path, m.turn) FROM m JOIN w ON m.conv_id = w.conv_id AND m.parent = w.turn)
SELECT m.conv_id, m.turn, role, sha256(own) AS text_sha256, parent AS parent_turn, level1 IS NOT NULL AS linked, level1, level2, row_number() OVER (PARTITION BY m.conv_id ORDER BY path) - 1 AS position,
CAST((level1 IS NOT NULL)::INT + (level2 IS NOT NULL)::INT AS BIGINT) AS n_quotes FROM m JOIN w USING (conv_id, turn)""",
    "url_rules": r"""
WITH s AS (SELECT page_id, regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1) AS h, regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*((?:/[^?#]*)?)', 1) AS path FROM pages),
p AS (SELECT page_id, translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, path FROM s),
r(rule, rule_verdict) AS (VALUES ('net/', 'block'), ('example.net/en/', 'allow'), ('example.com/de/', 'block'), ('org/fr/', 'allow')),
f AS (SELECT page_id, arg_max(rule, length(rule)) AS rule, arg_max(rule_verdict, length(rule)) AS rule_verdict FROM (SELECT DISTINCT page_id, host, path FROM p) JOIN r ON (host = split_part(rule, '/', 1) OR ends_with(host, '.' || split_part(rule, '/', 1))) AND starts_with(path, substr(rule, strpos(rule, '/'))) GROUP BY 1)
SELECT page_id, host, path, rule, rule_verdict FROM p LEFT JOIN f USING (page_id)""",
    "shard_slots": r"""
WITH d AS (SELECT doc_id, source, CAST(strlen(coalesce(text, '')) + 1 AS BIGINT) AS size, md5('0/' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS draw, coalesce('=' || source, '') AS stratum FROM documents),
f AS (SELECT *, (2 * row_number() OVER (PARTITION BY stratum ORDER BY draw, doc_id) - 1) / (2 * count(*) OVER (PARTITION BY stratum)) AS fraction FROM d),
o AS (SELECT *, row_number() OVER (ORDER BY fraction, stratum, draw, doc_id) - 1 AS place, count(*) OVER () AS n FROM f),
s AS (SELECT doc_id, size, CAST(place * 8 // n AS INTEGER) AS shard, place, n FROM o)
SELECT doc_id, size, shard, CAST(place - (shard * n + 7) // 8 AS BIGINT) AS slot FROM s""",
    "op11_vectorcode": _codes_sql(),
    "vector_deviations": r"""
WITH v AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda c: CAST(floor(1024 * CAST(c AS DOUBLE)) AS BIGINT) + 100000) AS x FROM embeddings
WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
c AS (SELECT rid, vec_id, i, x[i] AS c FROM v, unnest(range(1, len(x) + 1)) AS t(i)),
s AS (SELECT *, count(*) OVER w AS n, sum(c) OVER w AS total FROM c WINDOW w AS (PARTITION BY i))
SELECT vec_id, n, CAST(sum((n * c - total) * (n * c - total)) AS BIGINT) AS deviation FROM s GROUP BY rid, vec_id, n""",
}
