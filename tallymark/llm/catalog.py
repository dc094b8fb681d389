"""Queries of the operators over the given tables, with SQL twins where SQL can say it."""

from __future__ import annotations

import public_tokenizers

from ..sources.tables import table
from . import bpe, decontam, dialogue, exactdup, htmltext, pii, preference, resample, secrets, simhash, tokenfile, toxicity, warc

QUERIES, ORACLE = {}, {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return add


@query("op1_toxicity")
def op1(spark, folder):
    return toxicity.score_all(table(spark, folder, "documents"), table(spark, folder, "labels"), "doc_id", "text")


@query("op2_secrets")
def op2(spark, folder):
    return secrets.scan(table(spark, folder, "documents"), "doc_id", "text")


@query("op3_decontamination")
def op3(spark, folder):
    return decontam.leaks(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query("op4_token_files")
def op4(spark, folder):
    path = public_tokenizers.path("byte_bpe_50k.json")
    return tokenfile.round_trip(table(spark, folder, "documents"), "doc_id", "text", path, end_id=0)


@query("op5_main_text")
def op5(spark, folder):
    return htmltext.extract(table(spark, folder, "pages"), "page_id", "url", "html")


@query(
    "op6_revisits",
    """
    WITH cut AS (
      SELECT page_id, md5(coalesce(html, '')) AS etag, length(coalesce(html, '')) AS size,
             regexp_replace(regexp_replace(regexp_replace(lower(trim(coalesce(url, ''))), '#.*$', ''),
                            '^[a-z][a-z0-9+.-]*://', ''), '^(www|m)\\.', '') AS plain
      FROM pages),
    kept AS (
      SELECT page_id, etag, size, regexp_replace(split_part(plain, '?', 1), '(/|\\.html?)$', '') AS path,
             list_sort(list_filter(string_split(regexp_extract(plain, '\\?(.*)$', 1), '&'),
                       lambda p: p <> '' AND NOT regexp_matches(p, '^(utm_[a-z]+|ref|fbclid|gclid)='))) AS args
      FROM cut),
    keyed AS (
      SELECT page_id, etag, size, CASE WHEN len(args) > 0 THEN path || '?' || array_to_string(args, '&') ELSE path END AS url_key
      FROM kept),
    half AS (SELECT max(page_id) // 2 + 1 AS h FROM pages),
    again AS (SELECT page_id, etag, url_key, page_id + h AS asked FROM keyed, half),
    hit AS (
      SELECT a.*, f.page_id AS stored, f.etag AS stored_tag, f.size AS stored_size
      FROM again a ASOF LEFT JOIN keyed f ON a.url_key = f.url_key AND a.asked >= f.page_id)
    SELECT page_id * 2 + 1 AS record_id, page_id, url_key, stored * 2 AS response_id,
           CASE WHEN stored IS NULL THEN 'orphan' WHEN etag = stored_tag THEN 'resolved' ELSE 'changed' END AS status,
           CASE WHEN etag = stored_tag
                THEN 'content-length=' || stored_size || ';date=' || asked || ';server=first' ELSE '' END AS headers
    FROM hit
    """,
)
def op6(spark, folder):
    return warc.revisits_of_pages(table(spark, folder, "pages"))


@query("op7_bpe")
def op7(spark, folder):
    return bpe.digest(table(spark, folder, "documents"), "doc_id", "text", public_tokenizers.path("word_bpe_49k.json"))


@query(
    "op8_exact_dedup",
    """
    WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256 FROM documents)
    SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
           doc_id = max(doc_id) OVER g AS kept, text_sha256
    FROM d WINDOW g AS (PARTITION BY text_sha256)
    """,
)
def op8(spark, folder):
    return exactdup.decide(table(spark, folder, "documents"), "doc_id", "text")


@query("op9_pseudonyms")
def op9(spark, folder):
    return pii.replace(table(spark, folder, "documents"), "doc_id", "text", b"tallymark")


@query("op10_simhash")
def op10(spark, folder):
    return simhash.group(table(spark, folder, "documents"), "doc_id", "text")


#: A CRC-32 in SQL: each byte is XORed in (x >= 0), then eight single shifts (x = -1).
CRC_STEP = "CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, 3988292384 * (c & 1)) END"


@query(
    "op11_resampling",
    f"""
    WITH RECURSIVE worded AS (
      SELECT 'd' AS side, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
      UNION ALL
      SELECT 'b', item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM benchmark),
    spread AS (
      SELECT side, doc_id, unnest(list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i:i + n - 1], ' '))) AS feature
      FROM worded, (SELECT unnest([1, 2, 3]) AS n)),
    used AS (SELECT side, doc_id, feature, count(*) AS n FROM spread GROUP BY ALL),
    named AS (SELECT feature, octet_length(encode(feature)) AS size FROM (SELECT DISTINCT feature FROM used)),
    longest AS (SELECT max(size) AS size FROM named),
    byte AS (
      SELECT b::BIGINT AS b, list_reduce([b::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1], lambda c, x: {CRC_STEP}) AS v
      FROM (SELECT unnest(range(256)) AS b)),
    place(d, b, v) AS (
      SELECT 0, b, v FROM byte
      UNION ALL
      SELECT d + 1, p.b, xor(p.v >> 8, t.v) FROM place p JOIN byte t ON t.b = (p.v & 255) WHERE d < (SELECT size FROM longest)),
    blank(size, v) AS (
      SELECT 0, 4294967295
      UNION ALL
      SELECT size + 1, xor(k.v >> 8, t.v) FROM blank k JOIN byte t ON t.b = (k.v & 255) WHERE size < (SELECT size FROM longest)),
    bytes AS (
      SELECT feature, size, d, ('0x' || substr(hex(encode(feature)), 2 * (size - d)::BIGINT - 1, 2))::BIGINT AS b
      FROM (SELECT feature, size, unnest(range(size)) AS d FROM named)),
    summed AS (SELECT feature, any_value(size) AS size, bit_xor(p.v) AS v FROM bytes JOIN place p USING (d, b) GROUP BY feature),
    hashed AS (SELECT feature, xor(xor(s.v, k.v), 4294967295) % 10000 AS bucket FROM summed s JOIN blank k USING (size)),
    counted AS (
      SELECT bucket, coalesce(sum(n) FILTER (side = 'd'), 0)::DOUBLE AS s, coalesce(sum(n) FILTER (side = 'b'), 0)::DOUBLE AS t
      FROM used JOIN hashed USING (feature) GROUP BY bucket),
    gain AS (
      SELECT bucket, floor(1000 * ln((t + 1) * ((SELECT sum(s) FROM counted) + 10000) / ((s + 1) * ((SELECT sum(t) FROM counted) + 10000)))) AS g
      FROM counted),
    weighed AS (
      SELECT doc_id, sum(n)::BIGINT AS n_features, sum(n * g)::BIGINT AS weight
      FROM used JOIN hashed USING (feature) JOIN gain USING (bucket) WHERE side = 'd' GROUP BY doc_id),
    scored AS (
      SELECT doc_id, len(w) AS words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) +
             floor(-1000 * ln(-ln((('0x' || substr(sha256('42:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
      FROM worded LEFT JOIN weighed USING (doc_id) WHERE side = 'd'),
    ranked AS (
      SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, 5 * count(*) OVER () // 100 AS most FROM scored WHERE words >= 20)
    SELECT doc_id, n_features, weight, score, CASE WHEN rank <= most THEN rank END AS rank FROM scored LEFT JOIN ranked USING (doc_id)
    """,
)
def op11(spark, folder):
    return resample.resample(table(spark, folder, "documents"), table(spark, folder, "benchmark"), "doc_id", "text")


@query(
    "op12_conversation_repair",
    f"""
    WITH RECURSIVE src AS (
      SELECT dense_rank() OVER (ORDER BY conv_id NULLS FIRST) AS c, conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
             coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
    coded AS (
      SELECT *, xor(4294967295, list_reduce(flatten(list_transform(range(1, len(k) + 1), lambda i: [ascii(k[i])::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1])),
             lambda c, x: {CRC_STEP}, 4294967295::BIGINT)) % 20 AS kind FROM src),
    damaged AS (
      SELECT c, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role,
             CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
      FROM coded, (SELECT unnest([0, 1]) AS copy) WHERE kind <> 0 AND (copy = 0 OR kind = 3)),
    placed AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, role, sha256(text)) AS i FROM damaged),
    seen AS (
      SELECT *, row_number() OVER (PARTITION BY c, role, text ORDER BY i) AS again, lag(role[1]) OVER (PARTITION BY c ORDER BY i) || role[1] AS step,
             right(rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1) AS stop FROM placed),
    judged AS (
      SELECT c, i, turn, role, text, step,
             CASE WHEN stop = '' THEN 'blank' WHEN again > 1 THEN 'duplicate' WHEN stop NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault
      FROM seen),
    put(q, q2, extra, sign, lines) AS (VALUES
      (0, 0, 0, '', NULL), (1, 1, 0, '', NULL), (2, 2, 0, '', NULL), (3, 3, 0, '', NULL), (0, 2, 2, 'I', 'user:'), (1, 2, 2, 'I', 'user:'),
      (3, 2, 2, 'I', 'user:'), (2, 3, 2, 'I', 'assistant:'), (0, 3, 4, 'II', 'user:' || chr(10) || 'assistant:'), (1, 3, 4, 'II', 'user:' || chr(10) || 'assistant:')),
    eat(q, q2, price, sign, initial, role) AS (VALUES
      (0, 0, 3, 'D', NULL, NULL), (1, 1, 3, 'D', NULL, NULL), (2, 2, 3, 'D', NULL, NULL), (3, 3, 3, 'D', NULL, NULL),
      (0, 1, 0, 'K', 's', NULL), (0, 2, 0, 'K', 'u', NULL), (1, 2, 0, 'K', 'u', NULL), (2, 3, 0, 'K', 'a', NULL), (3, 2, 0, 'K', 'u', NULL),
      (0, 2, 2, 'R', NULL, 'user'), (1, 2, 2, 'R', NULL, 'user'), (3, 2, 2, 'R', NULL, 'user'), (2, 3, 2, 'R', NULL, 'assistant')),
    walk(c, i, q, cost, audit, made) AS (
      SELECT DISTINCT c, 0::BIGINT, 0, 0::BIGINT, '', NULL::VARCHAR FROM src
      UNION ALL
      SELECT c, i, q, best.cost, best.audit, best.made FROM (
        SELECT w.c, w.i + 1 AS i, e.q2 AS q, min({{'cost': w.cost + p.extra + e.price + CASE WHEN j.fault = 'truncated' AND e.sign <> 'D' THEN 1 ELSE 0 END,
               'audit': w.audit || p.sign || e.sign,
               'made': nullif(concat_ws(chr(10), w.made, p.lines, CASE WHEN e.sign <> 'D' THEN coalesce(e.role, j.role) || ':' || j.text END), '')}}) AS best
        FROM walk w JOIN judged j ON j.c = w.c AND j.i = w.i + 1 JOIN put p ON p.q = w.q JOIN eat e ON e.q = p.q2
        WHERE e.sign = 'D' OR (j.fault NOT IN ('blank', 'duplicate') AND (e.sign = 'R' OR e.initial = j.role[1]))
        GROUP BY w.c, w.i + 1, e.q2)),
    ends AS (SELECT c, count(*) AS n FROM judged GROUP BY c),
    best AS (
      SELECT w.c, min({{'cost': w.cost + p.extra, 'audit': w.audit || p.sign, 'made': concat_ws(chr(10), w.made, p.lines)}}) AS best
      FROM walk w LEFT JOIN ends USING (c) JOIN put p ON p.q = w.q WHERE w.i = coalesce(n, 0) AND p.q2 IN (0, 3) GROUP BY w.c),
    counted AS (
      SELECT c, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
             count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
             count(*) FILTER (step NOT IN ('su', 'ua', 'au')) AS illegal
      FROM judged GROUP BY c)
    SELECT s.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
           coalesce(illegal, 0) AS illegal, best.cost AS cost, best.audit AS audit, sha256(coalesce(best.made, '')) AS repaired_sha256
    FROM (SELECT DISTINCT c, conv_id FROM src) s LEFT JOIN counted USING (c) JOIN best USING (c)
    """,
)
def op12(spark, folder):
    return dialogue.repair_damaged(table(spark, folder, "conversations"))


@query("op13_quality")
def op13(spark, folder):
    return preference.score_all(table(spark, folder, "documents"), table(spark, folder, "labels"), "doc_id", "text")
