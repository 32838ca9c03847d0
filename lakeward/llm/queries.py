"""Registered queries of the operators, and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lakeward.llm import bpe, exact_dedup as ed, language_id as lid, quality as ql, secret_scan
from lakeward.llm.common import checkpointed
from lakeward.llm.conversations import damage, repair_conversations, repaired_or_empty
from lakeward.llm.decontaminate import decontaminate
from lakeward.llm.embedding_dedup import link_embeddings
from lakeward.llm.line_dedup import line_dedup
from lakeward.llm.mixing import mix_sources
from lakeward.llm.ngram_join import near_duplicates
from lakeward.llm.spelling import count_words, group_variants
from lakeward.llm.url_filter import Rule, judge_urls

URL_RULES = [Rule("net/", "block"), Rule("example.net/en/", "allow"), Rule("example.com/de/", "block"), Rule("org/fr/", "allow")]


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def read(spark, d, table):
    return spark.read.parquet(f"{d}/{table}.parquet")


def remainder(column, by):
    """crc32 of the id as text, modulo ``by``; null for a null id."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % by


def word_count(text):
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def op1_url_filters(spark, d):
    return judge_urls(read(spark, d, "pages").select("page_id", "url"), URL_RULES).select(
        "page_id", "host", "path", "rule", "verdict", "template", "purity")


def op2_line_dedup(spark, d):
    out = line_dedup(read(spark, d, "documents").select("doc_id", "text"), min_documents=10)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op3_language_id(spark, d):
    docs = read(spark, d, "documents")
    held = F.coalesce(remainder("doc_id", 3) == 1, F.lit(False))
    model = lid.train(docs, ~held)
    out = lid.predict_languages(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held.alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))


def op4_exact_dedup(spark, d):
    return ed.exact_groups(read(spark, d, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op5_secret_scans(spark, d):
    out = secret_scan.scan_documents(read(spark, d, "documents"))
    return out.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base", 256).alias("base_sha256"), "spans", "n_novel")


def op6_source_mixing(spark, d):
    sizes = checkpointed(read(spark, d, "documents").select("doc_id", "source", word_count(F.col("text")).alias("size")))
    return mix_sources(sizes).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("repetitions")).alias("taken"))


def op7_bpe(spark, d):
    out = bpe.encode_documents(read(spark, d, "documents"), tokenizer_path())
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op8_ngram_jaccard(spark, d):
    return near_duplicates(read(spark, d, "documents"))


def op9_quality(spark, d):
    docs, labels = read(spark, d, "documents"), read(spark, d, "labels")
    held = F.coalesce(remainder("doc_id", 5) == 0, F.lit(False))
    features = checkpointed(ql.document_statistics(docs))
    forest = ql.train(features, labels, ~held)
    out = ql.score_documents(features, forest)
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op10_embedding_dedup(spark, d):
    return link_embeddings(read(spark, d, "embeddings"))


def op11_decontamination(spark, d):
    out = decontaminate(read(spark, d, "documents"), read(spark, d, "benchmark"), width=10)
    return out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), "contaminated")


def op12_spelling_variants(spark, d):
    return group_variants(count_words(read(spark, d, "documents"), damage_every=97))


def op13_conversation_repair(spark, d):
    told = read(spark, d, "conversations")
    return repaired_or_empty(told, repair_conversations(damage(told)))


QUERIES = {f.__name__: f for f in (op1_url_filters, op2_line_dedup, op3_language_id, op4_exact_dedup, op5_secret_scans,
                                   op6_source_mixing, op7_bpe, op8_ngram_jaccard, op9_quality, op10_embedding_dedup, op11_decontamination, op12_spelling_variants, op13_conversation_repair)}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
# crc32 of the bytes (a list of numbers), with the table that _CRC_TABLE gives as tab
_CRC_TABLE = """(SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, b: CASE WHEN c & 1 = 1
               THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)) AS tab)"""
_CRC = "xor(list_reduce({bytes}, lambda c, b: xor(c >> 8, tab[xor(c & 255, b) + 1]), 4294967295), 4294967295)"
_BREAK = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"

ORACLES = {
    "op2_line_dedup": f"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines, string_split({_LOWER}, chr(10)) AS low FROM documents),
l AS (SELECT doc_id, unnest(range(1, len(lines) + 1)) AS pos, unnest(lines) AS line,
             unnest(list_transform(low, lambda x: trim(x, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)))) AS key FROM d),
common AS (SELECT key FROM l WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (key IN (SELECT key FROM common)) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (key NOT IN (SELECT key FROM common)), '')) AS kept_sha256
FROM l GROUP BY doc_id""",
    "op4_exact_dedup": f"""
WITH d AS (SELECT doc_id, sha256({_LOWER}) AS h FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, h AS text_sha256
FROM d WINDOW w AS (PARTITION BY h)""",
    "op8_ngram_jaccard": f"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex({_LOWER}, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, sh FROM (
        SELECT doc_id, unnest(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))
                                   WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS sh FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS MATERIALIZED (SELECT p.a, p.b FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b
                   WHERE 100 * p.c >= 75 * (x.n + y.n - p.c)),
r(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(m.m, d.doc_id)) AS component_id
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT a AS doc_id, min(b) AS m FROM r GROUP BY a) m USING (doc_id)""",
    "op10_embedding_dedup": """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND len(list_filter(embedding, lambda c: c <> 0)) > 0),
e AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id
  AND len(a.x) = len(b.x) AND list_cosine_similarity(a.x, b.x) >= 0.9),
r(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
m AS (SELECT a AS vec_id, min(b) AS m FROM r GROUP BY a), k AS (SELECT a AS vec_id, count(*) AS n FROM e GROUP BY a)
SELECT vec_id, coalesce(k.n, 0) AS n_links, least(vec_id, coalesce(m.m, vec_id)) AS component_id,
       vec_id = least(vec_id, coalesce(m.m, vec_id)) AS kept
FROM embeddings LEFT JOIN m USING (vec_id) LEFT JOIN k USING (vec_id)""",
    "op11_decontamination": f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, list_filter(string_split_regex({_LOWER}, '{_BREAK}'), lambda x: x <> '') AS ws FROM documents),
i AS (SELECT item_id, list_filter(string_split_regex({_LOWER}, '{_BREAK}'), lambda x: x <> '') AS ws FROM benchmark),
w AS (SELECT DISTINCT item_id, least(len(ws), 10) AS k, array_to_string(ws[s:s + least(len(ws), 10) - 1], ' ') AS win
      FROM (SELECT *, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS s FROM i WHERE len(ws) > 0)),
p AS (SELECT rid, k, s, array_to_string(ws[s:s + k - 1], ' ') AS win
      FROM (SELECT rid, ws, k, unnest(range(1, len(ws) - k + 2)) AS s FROM d, (SELECT DISTINCT k FROM w) WHERE len(ws) >= k)),
h AS MATERIALIZED (SELECT rid, p.k, s, item_id FROM p JOIN w ON p.k = w.k AND p.win = w.win),
c AS (SELECT rid, count(DISTINCT x) AS n_hit FROM (SELECT rid, unnest(range(s, s + k)) AS x FROM h) GROUP BY rid),
n AS (SELECT rid, count(*) AS n_items, string_agg(t, ',' ORDER BY t) AS ids FROM (SELECT DISTINCT rid, item_id::VARCHAR AS t FROM h) GROUP BY rid)
SELECT doc_id, len(ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (rid) LEFT JOIN n USING (rid)""",
    "op12_spelling_variants": f"""
WITH RECURSIVE r AS (SELECT coalesce(doc_id::VARCHAR, '') || ':' AS id, unnest(regexp_extract_all({_LOWER}, '[a-z\u00C0-\u00FF]+')) AS run FROM documents),
k AS (SELECT id, run, count(*) AS times FROM r WHERE length(run) >= 5 GROUP BY id, run),
h AS (SELECT run, times, {_CRC.format(bytes="flatten(list_transform(string_split(id || run, ''), lambda x: CASE WHEN unicode(x) < 128 THEN [unicode(x)::BIGINT] ELSE [195, unicode(x)::BIGINT - 64] END))")} AS h
      FROM k, {_CRC_TABLE}),
w AS MATERIALIZED (SELECT word, sum(times)::BIGINT AS n FROM (SELECT times, CASE WHEN h % 97 = 0
      THEN run[:(h % length(run))::BIGINT] || run[(h % length(run))::BIGINT + 2:] ELSE run END AS word FROM h) WHERE length(word) >= 5 GROUP BY word HAVING sum(times) >= 3),
v AS MATERIALIZED (SELECT word, p, word[:p - 1] || word[p + 1:] AS short FROM (SELECT word, unnest(range(1, length(word) + 1)) AS p FROM w)),
e AS (SELECT x.word AS a, y.word AS b FROM v x JOIN v y ON x.p = y.p AND x.short = y.short AND x.word <> y.word
      UNION SELECT v.word, w.word FROM v JOIN w ON v.short = w.word UNION SELECT w.word, v.word FROM v JOIN w ON v.short = w.word),
b AS (SELECT e.a AS word, count(*) AS n_near, arg_min(y.word, (-y.n, y.word)) AS near, max(y.n) AS near_n FROM e JOIN w y ON y.word = e.b GROUP BY e.a),
f AS MATERIALIZED (SELECT w.word, n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 2 * n THEN near END AS form, CASE WHEN near_n >= 2 * n THEN near_n END AS form_n
      FROM w LEFT JOIN b USING (word)),
t AS (SELECT word, word AS at, form AS onward FROM f UNION ALL SELECT t.word, f.word, f.form FROM t JOIN f ON f.word = t.onward)
SELECT f.word, f.form, t.at AS root, n, n_near, form_n FROM f JOIN t ON t.word = f.word AND t.onward IS NULL""",
    "op13_conversation_repair": f"""
WITH RECURSIVE h AS MATERIALIZED (SELECT conv_id, turn, role, text, {_CRC.format(bytes="list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda x: unicode(x)::BIGINT)")} % 20 AS k
  FROM conversations, {_CRC_TABLE}),
d AS (SELECT conv_id, turn, CASE k WHEN 4 THEN 'user' ELSE role END AS role, CASE k WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
      FROM (SELECT *, unnest(CASE k WHEN 3 THEN [1, 2] ELSE [1] END) AS copy FROM h WHERE k <> 0)),
r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, sha256(text) NULLS FIRST) AS i,
             rtrim(coalesce(text, ''), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS st FROM d),
f AS MATERIALIZED (SELECT conv_id, i, turn, role, text, coalesce(role, '')[1:1] AS c,
        CASE WHEN st = '' THEN 'b' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'd' WHEN right(st, 1) NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault FROM r),
e(conv_id, i, fb, fs, fu, fa) AS (
  SELECT conv_id, max(i) + 1, struct_pack(p := 0::BIGINT, a := ''), struct_pack(p := 6::BIGINT, a := 'II'),
         struct_pack(p := 3::BIGINT, a := 'I'), struct_pack(p := 0::BIGINT, a := '') FROM f GROUP BY conv_id
  UNION ALL
  SELECT conv_id, i, list_sort([gb, struct_pack(p := gu.p + 3, a := 'I' || gu.a)])[1], list_sort([gs, struct_pack(p := gu.p + 3, a := 'I' || gu.a)])[1],
         list_sort([gu, struct_pack(p := ga.p + 3, a := 'I' || ga.a)])[1], list_sort([ga, struct_pack(p := gu.p + 3, a := 'I' || gu.a)])[1]
  FROM (SELECT e.conv_id, f.i,
      struct_pack(p := fb.p + 4, a := 'D' || fb.a) AS db, struct_pack(p := fs.p + 4, a := 'D' || fs.a) AS ds,
      struct_pack(p := fu.p + 4, a := 'D' || fu.a) AS du, struct_pack(p := fa.p + 4, a := 'D' || fa.a) AS da,
      CASE WHEN fault IN ('b', 'd') THEN 1000000000 WHEN fault = 't' THEN 3 ELSE 0 END AS x,
      struct_pack(p := fu.p + x + CASE c WHEN 'u' THEN 0 ELSE 3 END, a := CASE c WHEN 'u' THEN 'K' ELSE 'R' END || fu.a) AS tu,
      struct_pack(p := fa.p + x + CASE c WHEN 'a' THEN 0 ELSE 3 END, a := CASE c WHEN 'a' THEN 'K' ELSE 'R' END || fa.a) AS ta,
      struct_pack(p := fs.p + x + CASE c WHEN 's' THEN 0 ELSE 1000000000 END, a := 'K' || fs.a) AS ts,
      list_sort([db, tu, ts])[1] AS gb, list_sort([ds, tu])[1] AS gs, list_sort([du, ta])[1] AS gu, list_sort([da, tu])[1] AS ga
    FROM e JOIN f ON e.conv_id IS NOT DISTINCT FROM f.conv_id AND f.i = e.i - 1)),
s AS (SELECT conv_id, fb.p AS cost, fb.a AS audit FROM e WHERE i = 1),
t AS (SELECT conv_id, audit, t, audit[t:t] AS ch, len(replace(audit[:t], 'I', '')) AS i, len(replace(audit[:t], 'D', '')) - 1 AS place,
             len(replace(audit, 'D', '')) % 2 AS odd FROM (SELECT *, unnest(range(1, len(audit) + 1)) AS t FROM s)),
g AS (SELECT t.conv_id, string_agg(CASE WHEN ch = 'K' THEN f.role WHEN (place - odd) % 2 = 0 THEN 'user' ELSE 'assistant' END || ':' ||
             CASE WHEN ch = 'I' THEN '' ELSE f.text END, chr(10) ORDER BY t) AS body
      FROM t JOIN f ON t.conv_id IS NOT DISTINCT FROM f.conv_id AND f.i = greatest(t.i, 1) WHERE ch <> 'D' GROUP BY t.conv_id),
m AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank,
             count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated,
             count(*) FILTER (before IS NOT NULL AND before || c NOT IN ('su', 'ua', 'au')) AS illegal
      FROM (SELECT *, lag(c) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM f) GROUP BY conv_id)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
       coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(body, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN m ON o.conv_id IS NOT DISTINCT FROM m.conv_id
LEFT JOIN s ON o.conv_id IS NOT DISTINCT FROM s.conv_id LEFT JOIN g ON o.conv_id IS NOT DISTINCT FROM g.conv_id""",
}
