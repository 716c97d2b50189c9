"""The registered queries: each operator over its whole table, and SQL for those it can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm import bpe, chat, decontam, langid, near_dedup, pii, quality, url_filter, warc
from tidelog.llm.kit import table
from tidelog.llm.line_dedup import line_dedup


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup(docs).select("doc_id", "n_lines", "n_removed", "text")


LINE_DEDUP_SQL = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, text FROM documents),
l AS (SELECT r, doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM d),
three AS (
  SELECT r, doc_id, pos, line || chr(10) || lead(line, 1) OVER p || chr(10) || lead(line, 2) OVER p AS win
  FROM l WINDOW p AS (PARTITION BY r ORDER BY pos)),
later AS (
  SELECT r, pos FROM (
    SELECT r, pos, row_number() OVER (PARTITION BY win ORDER BY doc_id, r, pos) AS nth FROM three
    WHERE win IS NOT NULL AND trim(win, chr(10) || chr(13) || chr(9) || chr(11) || chr(12) || ' ') <> '')
  WHERE nth > 1),
covered AS (SELECT DISTINCT r, pos + k AS pos FROM later, (VALUES (0), (1), (2)) AS o(k)),
kept AS (SELECT r, string_agg(line, chr(10) ORDER BY pos) AS text, count(*) AS n FROM l ANTI JOIN covered USING (r, pos) GROUP BY r),
had AS (SELECT r, count(*) AS n FROM l GROUP BY r)
SELECT d.doc_id, coalesce(had.n, 0) AS n_lines, coalesce(had.n, 0) - coalesce(kept.n, 0) AS n_removed,
  CASE WHEN d.text IS NOT NULL THEN coalesce(kept.text, '') END AS text
FROM d LEFT JOIN had USING (r) LEFT JOIN kept USING (r)
"""


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "class_id")


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.round_trip(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return records.select(F.col("id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to", "error")


WARC_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages),
bits AS (
  SELECT hex, string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + v, 1), '' ORDER BY i) AS digest FROM (
    SELECT hex, i, CAST(('0x' || substr(hex, 1 + 10 * (i // 8), 10)) AS BIGINT) // (1::BIGINT << (35 - 5 * (i % 8))) % 32 AS v
    FROM (SELECT DISTINCT hex FROM p), range(32) AS t(i)) GROUP BY hex),
g AS (SELECT hex, max(page_id) AS response_id, count(*) AS n FROM p GROUP BY hex)
SELECT page_id, payload_bytes, digest AS payload_digest, CASE WHEN page_id = response_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> response_id THEN response_id END AS refers_to, NULL::VARCHAR AS error
FROM p JOIN bits USING (hex) JOIN g USING (hex)
"""


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.sanitise(table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == pii.KINDS.index(kind))).cast("long").alias(f"n_{kind}")
    digest = F.sha2(pii.span_text(F.col("base")).cast("binary"), 256).alias("base_sha256")
    return found.select("doc_id", *map(count, pii.FORMS), digest, pii.span_text(F.col("spans")).alias("spans"))


# Terms are judged by whole documents and marked in every document.
PII_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
raw AS (
  SELECT r, doc_id, text, 'email' AS kind, 0 AS no, regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+') AS m, string_split_regex(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+') AS g FROM d
  UNION ALL SELECT r, doc_id, text, 'ip', 1, regexp_extract_all(text, '[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)'), string_split_regex(text, '[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)') FROM d
  UNION ALL SELECT r, doc_id, text, 'card', 2, regexp_extract_all(text, '[0-9]([ -]?[0-9])+'), string_split_regex(text, '[0-9]([ -]?[0-9])+') FROM d
  UNION ALL SELECT r, doc_id, text, 'phone', 3, regexp_extract_all(text, '\+[0-9][ ().0-9-]+[0-9]'), string_split_regex(text, '\+[0-9][ ().0-9-]+[0-9]') FROM d),
each AS (SELECT r, doc_id, text, kind, no, unnest(m) AS v, unnest(g[:len(m)]) AS gap, unnest(range(len(m))) AS i FROM raw WHERE len(m) > 0),
placed AS (
  SELECT r, doc_id, text, kind, no, v, regexp_replace(v, '[^0-9]', '', 'g') AS ds,
    sum(length(gap) + length(v)) OVER (PARTITION BY r, kind ORDER BY i) AS stop FROM each),
base AS (
  SELECT r, doc_id, text, kind, no, v, ds, stop - length(v) AS start, stop FROM placed
  WHERE CASE kind WHEN 'email' THEN true
    WHEN 'ip' THEN list_bool_and(list_transform(string_split(v, '.'), lambda x: length(ltrim(x, '0')) <= 3 AND coalesce(try_cast(ltrim(x, '0') AS INTEGER), 0) <= 255))
    WHEN 'card' THEN length(ds) BETWEEN 14 AND 19 AND list_sum(list_transform(range(length(ds)), lambda j:
      CASE WHEN j % 2 = 0 THEN ds[length(ds) - j]::INTEGER ELSE (2 * ds[length(ds) - j]::INTEGER) % 10 + (2 * ds[length(ds) - j]::INTEGER) // 10 END)) % 10 = 0
    ELSE length(ds) BETWEEN 10 AND 15 END),
values_of AS (SELECT r, kind, CASE kind WHEN 'email' THEN lower(v) WHEN 'ip' THEN v ELSE ds END AS entity, regexp_extract_all(lower(v), '[\p{{L}}\p{{N}}]+') AS own FROM base),
held AS (SELECT r, kind, entity, flatten(list(own)) AS own FROM values_of GROUP BY r, kind, entity),
n_e AS (SELECT kind, entity, count(*) AS n_e FROM held GROUP BY ALL HAVING count(*) >= {pii.SUPPORT}),
terms AS (SELECT DISTINCT r, unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+')) AS term FROM d),
n_t AS (SELECT term, count(*) AS n_t FROM terms GROUP BY term),
n_et AS (SELECT kind, entity, term, count(*) AS n_et FROM held JOIN n_e USING (kind, entity) JOIN terms USING (r) WHERE NOT list_contains(own, term) GROUP BY ALL HAVING count(*) >= {pii.SUPPORT}),
told AS (
  SELECT DISTINCT term FROM n_et JOIN n_e USING (kind, entity) JOIN n_t USING (term), (SELECT count(*)::DOUBLE AS n FROM d)
  WHERE n_e < n AND log2(n) + log2(n_et) - log2(n_e) - log2(n_t) >= {pii.ALPHA} * (log2(n) - log2(n_e))),
words AS (
  SELECT r, v, sum(length(gap) + length(v)) OVER (PARTITION BY r ORDER BY i) AS stop FROM (
    SELECT r, unnest(m) AS v, unnest(g[:len(m)]) AS gap, unnest(range(len(m))) AS i FROM (
      SELECT r, regexp_extract_all(text, '[\p{{L}}\p{{N}}]+') AS m, string_split_regex(text, '[\p{{L}}\p{{N}}]+') AS g FROM d))),
spans AS (
  SELECT r, kind, no, start, stop FROM base
  UNION ALL SELECT r, 'term', 4, stop - length(v), stop FROM words WHERE lower(v) IN (SELECT term FROM told)),
told_spans AS (
  SELECT r, string_agg(kind || ':' || start::BIGINT || ':' || stop::BIGINT, ',' ORDER BY start, no) AS spans,
    string_agg(kind || ':' || start::BIGINT || ':' || stop::BIGINT, ',' ORDER BY start, no) FILTER (WHERE no < 4) AS base,
    count(*) FILTER (WHERE kind = 'email') AS n_email, count(*) FILTER (WHERE kind = 'ip') AS n_ip,
    count(*) FILTER (WHERE kind = 'card') AS n_card, count(*) FILTER (WHERE kind = 'phone') AS n_phone
  FROM spans GROUP BY r)
SELECT doc_id, coalesce(n_email, 0) AS n_email, coalesce(n_ip, 0) AS n_ip, coalesce(n_card, 0) AS n_card, coalesce(n_phone, 0) AS n_phone,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN told_spans USING (r)
"""

def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontam.overlaps(docs, table(spark, sf_dir, "benchmark").select("item_id", "text"), keep=["doc_id"])
    digest = F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256")
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), digest, "contaminated")


# Whether a window occurs is told by a join of 13-word strings; a word is hit if any of the
# windows that hold it occurs.
DECONTAMINATION_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL),
p AS (SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(w[i + 1:i + least(len(w), 13)], ' ') AS win FROM (SELECT item_id, w, unnest(range(greatest(len(w) - 12, 1))) AS i FROM b WHERE len(w) > 0)),
lengths AS (SELECT DISTINCT n FROM p),
t AS (SELECT r, n, i, array_to_string(w[i + 1:i + n], ' ') AS win FROM (SELECT r, w, n, unnest(range(len(w) - n + 1)) AS i FROM d, lengths WHERE len(w) >= n)),
hit AS (SELECT r, t.n, i, item_id FROM t JOIN p ON t.n = p.n AND t.win = p.win),
words AS (SELECT DISTINCT r, unnest(range(i, i + n)) AS k FROM hit),
n_hit AS (SELECT r, count(*) AS n_hit FROM words GROUP BY r),
items AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item_id::VARCHAR AS item FROM hit) GROUP BY r)
SELECT doc_id, coalesce(len(w), 0) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= coalesce(len(w), 0) AS contaminated
FROM d LEFT JOIN n_hit USING (r) LEFT JOIN items USING (r)
"""

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_digests(bpe.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), TOKENIZER, keep=["doc_id"]))


def bpe_digests(encoded: DataFrame) -> DataFrame:
    ids = F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256")
    return encoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), ids, F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.judge(docs, model, keep=["doc_id"]).drop("line_marks")


def op7_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = langid.identify(docs.select("doc_id", "text"), langid.fit(docs), keep=["doc_id"])
    return found.select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


#: Host, path and verdict.
URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    judged = url_filter.judge(pages, url_filter.fit(pages), URL_RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict", F.round("score", 6).alias("score"))


def _smoothed(kind: int, fold: str) -> str:
    """The probability of a symbol under the model ``kind``, with or without the hosts held back, from the counts of its contexts."""
    p = "(1::DOUBLE / 64)"
    for k in range(5):
        n, total, kinds = (f"{x}{k}_{kind}{fold}" for x in ("n", "t", "k"))
        p = f"(CASE WHEN {total} > 0 THEN ({n} + {kinds} * {p}) / ({total} + {kinds}) ELSE {p} END)"
    return p


def _context_counts(fold: str) -> str:
    """Counts of each gram's symbol after its 0 to 4 earlier ones, all after these, and the symbols seen after them."""
    where = {"a": "", "f": " AND NOT held"}[fold]
    out = []
    for k in range(5):
        context = ", ".join(f"c{i}" for i in range(1, k + 1))
        for kind in (0, 1):
            own = f"FILTER (WHERE bad = {bool(kind)}{where})"
            over = f"PARTITION BY {context}" if context else ""
            out += [f"count(r) {own} OVER (PARTITION BY {context + ', ' if context else ''}c) AS n{k}_{kind}{fold}", f"count(r) {own} OVER ({over}) AS t{k}_{kind}{fold}"]
            out.append(f"count(DISTINCT c) {own} OVER ({over}) AS k{k}_{kind}{fold}")
    return ",\n    ".join(out)


# The models' counts are windows over all characters; equal URLs share a score, in units of 2 ** -36.
URL_SQL = rf"""
WITH p AS (
  SELECT row_number() OVER () AS r, page_id, coalesce(url, '') AS url, lower(coalesce(url, '')) AS low, strpos(coalesce(url, ''), '://') AS pos FROM pages),
q AS (
  SELECT r, page_id, regexp_matches(low, '{url_filter.REJECT}') AS bad, CASE WHEN pos > 0 THEN substr(url, pos + 3) ELSE url END AS s,
    CASE WHEN pos > 0 THEN translate(regexp_extract(substr(url, pos + 3), '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
    CASE WHEN pos > 0 THEN regexp_extract(substr(url, pos + 3), '^[^/?#]*([^?#]*)', 1) ELSE '' END AS path FROM p),
u AS (SELECT *, md5(host)[1] < '4' AS held FROM q),
bytes AS (SELECT r, bad, held, unnest(range(octet_length(encode(s)))) AS i, hex(encode(s)) AS x FROM u),
symbols AS (
  SELECT r, bad, held, i, CASE WHEN b BETWEEN 65 AND 90 THEN b - 64 WHEN b < 128 AND strpos('{url_filter.SYMBOLS.replace("'", "''")}', chr(b)) > 0 THEN strpos('{url_filter.SYMBOLS.replace("'", "''")}', chr(b)) ELSE 63 END AS c
  FROM (SELECT r, bad, held, i, ('0x' || substr(x, 2 * i + 1, 2))::INTEGER AS b FROM bytes)),
grams AS (
  SELECT r, bad, held, i, c, {", ".join(f"coalesce(lag(c, {k}) OVER w, 0) AS c{k}" for k in range(1, 5))} FROM symbols WINDOW w AS (PARTITION BY r ORDER BY i)),
counted AS (
  SELECT r, bad, held,
    {_context_counts("a")},
    {_context_counts("f")}
  FROM grams),
scored AS (
  SELECT r, sum(round((ln({_smoothed(0, "a")}) - ln({_smoothed(1, "a")})) * {url_filter.UNITS})) / count(*) / {url_filter.UNITS} AS score,
    sum(round((ln({_smoothed(0, "f")}) - ln({_smoothed(1, "f")})) * {url_filter.UNITS})) / count(*) / {url_filter.UNITS} AS apart FROM counted GROUP BY r),
have AS (
  SELECT count(*) FILTER (WHERE bad) > 0 AND count(*) FILTER (WHERE NOT bad) > 0 AS has_both,
    count(*) FILTER (WHERE bad AND held) > 0 AND count(*) FILTER (WHERE NOT bad AND held) > 0 AND count(*) FILTER (WHERE bad AND NOT held) > 0 AND count(*) FILTER (WHERE NOT bad AND NOT held) > 0 AS usable
  FROM u WHERE s <> ''),
places AS (
  SELECT bad, greatest(least(floor((CASE WHEN usable THEN apart ELSE score END - {url_filter.LOW}) / {url_filter.HIGH - url_filter.LOW} * {url_filter.BINS}), {url_filter.BINS - 1}), 0) AS k
  FROM u JOIN scored USING (r), have WHERE held OR NOT usable),
spread AS (SELECT t.k, count(*) FILTER (WHERE p.k < t.k AND NOT bad) AS blocked, count(*) FILTER (WHERE p.k < t.k AND bad) AS caught, count(*) FILTER (WHERE NOT bad) AS n FROM range({url_filter.BINS + 1}) AS t(k), places p GROUP BY t.k),
best AS (SELECT {url_filter.LOW} + k * {url_filter.HIGH - url_filter.LOW} / {url_filter.BINS} AS threshold FROM spread WHERE blocked <= {url_filter.MAX_FALSE} * greatest(n, 1) ORDER BY caught DESC, k LIMIT 1),
ruled AS (
  SELECT *, CASE
    WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule FROM u)
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
    WHEN s <> '' AND has_both AND coalesce(score < (SELECT threshold FROM best), false) THEN 'block' ELSE 'allow' END AS verdict,
  round(coalesce(score, 0), 6) AS score
FROM ruled LEFT JOIN scored USING (r), have
"""


PROBE = "</s>[INST] ok [/INST]"


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PROBE).alias("text"))
    return chat.read_back(chat.format_turns(rows.unionByName(probe)))


# formatted_chars follows from the template: 15 characters around a user's turn, 7 around an
# assistant's, 21 around another's with its role, and a backslash for each backslash or control string.
CHAT_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, i, CASE i WHEN 0 THEN 'user' ELSE 'assistant' END, '</s>[INST] ok [/INST]' FROM range(2) AS t(i)),
e AS (
  SELECT *, length(text) + len(regexp_extract_all(text, '\\|\[INST\]|\[/INST\]|</?s>|<</?SYS>>|\[ROLE\]')) AS n,
    length(role) + len(regexp_extract_all(role, '\\|\[INST\]|\[/INST\]|</?s>|<</?SYS>>|\[ROLE\]')) AS n_role FROM c)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(n + CASE role WHEN 'user' THEN 15 WHEN 'assistant' THEN 7 ELSE 21 + n_role END)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""

QUERIES = {"op1_line_dedup": op1_line_dedup, "op2_near_dedup": op2_near_dedup, "op3_warc": op3_warc, "op4_pii": op4_pii, "op5_decontamination": op5_decontamination, "op6_bpe": op6_bpe, "op7_langid": op7_langid, "op8_url_filter": op8_url_filter, "op9_quality": op9_quality, "op10_chat": op10_chat}
ORACLE_SQL = {"op1_line_dedup": LINE_DEDUP_SQL, "op3_warc": WARC_SQL, "op4_pii": PII_SQL, "op5_decontamination": DECONTAMINATION_SQL, "op8_url_filter": URL_SQL, "op10_chat": CHAT_SQL}
