"""One query for each operator, over its whole table, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import collocations, conversations, decontaminate, hnsw, language, licenses, line_dedup, lm_score, packing, sentencepiece, simhash, toxicity, warc
from .common import held_out, table


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    columns = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
    return licenses.scan_licenses(docs).select("doc_id", *[f"license.{c}" for c in columns])


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    kept = line_dedup.drop_lines(docs, line_dedup.keep_bitmaps(docs, min_docs=10, min_chars=1))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    net = language.train(docs, F.col("lang"), ~held_out(F.col("doc_id")))
    found = language.identify(docs.select("doc_id", "text"), net)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("language.lang").alias("lang_pred"), "language.score")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").filter(~held_out(F.col("doc_id")))
    scored = toxicity.score(docs, toxicity.train(docs, labels))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.3).cast("int").alias("predicted"))


def op1_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    index = hnsw.build_index(rows, k=5)
    return hnsw.nearest(rows.filter(F.col("vec_id") % 50 == 0), index, k=5)


def op3_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lm_score.backoff_scores(table(spark, sf_dir, "documents").select("doc_id", "text"), order=3, alpha=0.4)
    return found.select("doc_id", "n_words", F.round("log_sum", 4).alias("log_sum"), F.round("log_mean", 6).alias("log_mean"))


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    encoded = sentencepiece.encode_documents(docs)
    back = sentencepiece.decode_documents(encoded)
    joined = F.array_join("pieces", " ")
    return back.select("doc_id", F.size("pieces").cast("long").alias("n_pieces"), F.sha2(joined, 256).alias("pieces_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"), F.col("decoded").eqNullSafe(F.col("text")).alias("round_trip"))


def op8_warc_packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    manifest = warc.write_archives(warc.classify(pages, least=1000), warc.archive_folder(spark))
    return warc.read_archives(manifest).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate.contaminated(docs, table(spark, sf_dir, "benchmark"), threshold=0.6)


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = simhash.near_duplicates(docs, size=3, distance=3)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.repair(conversations.damage(table(spark, sf_dir, "conversations")))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents").select("lang", "text"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_nearest_vectors, op2_license_scan, op3_lm_score, op4_line_dedup, op5_language_id, op6_toxicity, op7_sentencepiece, op8_warc_packages,
        op9_decontamination, op10_simhash, op11_packing, op12_conversation_repair, op13_collocations,
    )
}

_LINES = """
lines AS (
  SELECT place, doc_id, same, generate_subscripts(parts, 1) AS pos, unnest(parts) AS line
  FROM (SELECT row_number() OVER () AS place, doc_id, concat(doc_id, '|', md5(coalesce(text, ''))) AS same, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents)
), keyed AS (
  SELECT place, doc_id, same, pos, line, trim(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS key
  FROM lines
), common AS (
  SELECT key FROM keyed WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT same) >= 10
)"""

_GRAMS = """
texts AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS ws
  FROM documents
), spots AS (
  SELECT doc_id, len(ws) AS n_doc, pos, ws[pos] AS w3, CASE WHEN pos > 1 THEN ws[pos - 1] END AS w2, CASE WHEN pos > 2 THEN ws[pos - 2] END AS w1
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS pos FROM texts)
), own1 AS (SELECT doc_id, w3, count(*) AS n FROM spots GROUP BY ALL),
own2 AS (SELECT doc_id, w2, w3, count(*) AS n FROM spots WHERE pos > 1 GROUP BY ALL),
own3 AS (SELECT doc_id, w1, w2, w3, count(*) AS n FROM spots WHERE pos > 2 GROUP BY ALL),
rest1 AS (SELECT doc_id, w3, sum(n) OVER (PARTITION BY w3) - n AS n FROM own1),
rest2 AS (SELECT doc_id, w2, w3, sum(n) OVER (PARTITION BY w2, w3) - n AS n FROM own2),
rest3 AS (SELECT doc_id, w1, w2, w3, sum(n) OVER (PARTITION BY w1, w2, w3) - n AS n FROM own3),
whole AS (SELECT count(*) AS n FROM spots),
scored AS (
  SELECT s.doc_id, CASE
    WHEN s.pos > 2 AND c3.n > 0 THEN c3.n / c2b.n
    WHEN s.pos > 1 AND c2.n > 0 THEN power(0.4, least(3, s.pos) - 2) * c2.n / c1b.n
    WHEN c1.n > 0 THEN power(0.4, least(3, s.pos) - 1) * c1.n / (whole.n - s.n_doc)
    ELSE power(0.4, least(3, s.pos)) / (whole.n - s.n_doc + 1) END AS p
  FROM spots s CROSS JOIN whole
  LEFT JOIN rest3 c3 ON c3.doc_id = s.doc_id AND c3.w1 = s.w1 AND c3.w2 = s.w2 AND c3.w3 = s.w3
  LEFT JOIN rest2 c2 ON c2.doc_id = s.doc_id AND c2.w2 = s.w2 AND c2.w3 = s.w3
  LEFT JOIN rest2 c2b ON c2b.doc_id = s.doc_id AND c2b.w2 = s.w1 AND c2b.w3 = s.w2
  LEFT JOIN rest1 c1 ON c1.doc_id = s.doc_id AND c1.w3 = s.w3
  LEFT JOIN rest1 c1b ON c1b.doc_id = s.doc_id AND c1b.w3 = s.w2
)"""

# CRC-32 by its table, which follows from the polynomial; bytes by way of hexadecimal digits.
_CRC = """
crc_table AS (
  SELECT list(list_reduce(list_prepend(b, range(8)), lambda c, k: xor(c >> 1, (c & 1) * 3988292384)) ORDER BY b) AS entries FROM range(256) r(b)
)"""


def _crc32(text: str) -> str:
    byte = f"list_transform(range(strlen({text})), lambda k: ('0x' || substr(hex(encode({text})), 2 * k + 1, 2))::BIGINT)"
    return f"xor(4294967295, list_reduce(list_prepend(4294967295, {byte}), lambda c, b: xor(c >> 8, entries[(xor(c, b) & 255) + 1])))"


def _edit(state: str, cost: str, letter: str, line: str = "''") -> str:
    return f"CASE WHEN {state} IS NOT NULL THEN {{'c': {state}.c + {cost}, 'a': {state}.a || '{letter}', 't': {state}.t || {line}}} END"


def _least(*choices: str) -> str:
    return f"list_sort([{', '.join(choices)}], 'ASC', 'NULLS LAST')[1]"


def _settled(source: str) -> str:
    """Cheapest ways to each state (n, s, u, a), insertions included."""
    user, assistant = "chr(10) || 'user:'", "chr(10) || 'assistant:'"
    u = _least("u", _edit("n", "3", "I", user), _edit("s", "3", "I", user), _edit("a", "3", "I", user))
    return f"SELECT * REPLACE ({_least('a', _edit('u', '3', 'I', assistant))} AS a) FROM (SELECT * REPLACE ({u} AS u) FROM ({source}))"


def _row(state: str, before: tuple[str, ...], name: str) -> str:
    line, choices = "chr(10) || role || ':' || text", [_edit(state, "4", "D")]
    for b in before:
        choices.append(f"CASE WHEN stays AND initial = '{state}' THEN {_edit(b, 'extra', 'K', line)} END")
        if name:
            choices.append(f"CASE WHEN stays THEN {_edit(b, '3 + extra', 'R', f"chr(10) || '{name}:' || text")} END")
    return f"{_least(*choices)} AS {state}"


_REPAIR = f"""
WITH RECURSIVE {_CRC.strip()}, given AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {_crc32("(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '))")} % 20 AS kind
  FROM conversations, crc_table
), damaged AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy
  FROM given WHERE kind <> 0
), placed AS (
  SELECT *, left(role, 1) AS initial, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i,
    rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS seen
  FROM damaged
), judged AS (
  SELECT *, CASE WHEN seen = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate' WHEN right(seen, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
    lag(initial) OVER (PARTITION BY conv_id ORDER BY i) || initial AS pair
  FROM placed
), counted AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) AS n, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal
  FROM judged GROUP BY conv_id
), steps AS (
  SELECT DISTINCT conv_id, 0::BIGINT AS i, {{'c': 0::BIGINT, 'a': '', 't': ''}} AS n, NULL::STRUCT(c BIGINT, a VARCHAR, t VARCHAR) AS s, NULL::STRUCT(c BIGINT, a VARCHAR, t VARCHAR) AS u, NULL::STRUCT(c BIGINT, a VARCHAR, t VARCHAR) AS a
  FROM conversations
  UNION ALL
  SELECT conv_id, i, {_row("n", (), "")}, {_row("s", ("n",), "")}, {_row("u", ("n", "s", "a"), "user")}, {_row("a", ("u",), "assistant")}
  FROM (
    SELECT p.conv_id, j.i, n, s, u, a, j.role, j.text, j.initial, j.fault NOT IN ('blank', 'duplicate') AS stays, CASE WHEN j.fault = 'truncated' THEN 3 ELSE 0 END AS extra
    FROM ({_settled("SELECT * FROM steps")}) p JOIN judged j ON j.conv_id IS NOT DISTINCT FROM p.conv_id AND j.i = p.i + 1
  )
)
SELECT e.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  best.c AS cost, best.a AS audit, sha256(substr(best.t, 2)) AS repaired_sha256
FROM (SELECT conv_id, i, {_least("n", "a")} AS best FROM ({_settled("SELECT * FROM steps")})) e
LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM e.conv_id
WHERE e.i = coalesce(c.n, 0)"""
_PHRASES = """
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece
  FROM documents
), worded AS (
  SELECT lang, list_filter(regexp_split_to_array(piece, '[\\x20\\x09]+'), lambda w: w <> '') AS ws FROM pieces
), spots AS (
  SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM worded
), grams AS (
  SELECT lang, m, array_to_string(ws[i:i + m - 1], ' ') AS phrase FROM spots, range(1, 5) r(m) WHERE i + m - 1 <= len(ws)
), counts AS (
  SELECT lang, m, phrase, count(*) AS a FROM grams GROUP BY ALL HAVING count(*) >= 30
), totals AS (
  SELECT lang, count(*) AS n FROM spots GROUP BY lang
), candidates AS (
  SELECT *, string_split(phrase, ' ') AS ws FROM counts WHERE m > 1
), cuts AS (
  SELECT c.lang, c.phrase, c.a, k, h.a AS l, t.a AS r, (2000000::HUGEINT * c.a // (h.a + t.a))::BIGINT AS score
  FROM (SELECT *, unnest(range(1, m)) AS k FROM candidates) c
  JOIN counts h ON h.lang = c.lang AND h.phrase = array_to_string(c.ws[1:k], ' ')
  JOIN counts t ON t.lang = c.lang AND t.phrase = array_to_string(c.ws[k + 1:c.m], ' ')
), best AS (
  SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), longer AS (
  SELECT lang, array_to_string(ws[s:s + z - 1], ' ') AS phrase, max(a) AS longer
  FROM (SELECT *, unnest(range(1, m - z + 2)) AS s FROM (SELECT *, unnest(range(2, m)) AS z FROM candidates))
  GROUP BY ALL
)
SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY b.score DESC, b.a DESC, b.phrase) AS rank, b.phrase, b.a, b.l, b.r, n, b.score
FROM best b JOIN totals USING (lang) LEFT JOIN longer ON longer.lang = b.lang AND longer.phrase = b.phrase
WHERE longer IS NULL OR 100 * longer < 80 * b.a
QUALIFY rank <= 2000"""

SQL = {
    "op13_collocations": _PHRASES,
    "op12_conversation_repair": _REPAIR,
    "op3_lm_score": f"""
WITH {_GRAMS.strip()}
SELECT t.doc_id, len(t.ws) AS n_words, round(coalesce(x.total, 0), 4) AS log_sum, round(x.total / len(t.ws), 6) AS log_mean
FROM texts t LEFT JOIN (SELECT doc_id, sum(ln(p)) AS total FROM scored GROUP BY doc_id) x ON x.doc_id = t.doc_id""",
    "op8_warc_packages": """
WITH own AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
), keepers AS (
  SELECT payload_digest, max(page_id) AS keeper FROM own WHERE payload_bytes >= 1000 GROUP BY payload_digest
)
SELECT page_id, payload_bytes, own.payload_digest, CASE WHEN page_id <> coalesce(keeper, page_id) THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id <> coalesce(keeper, page_id) THEN keeper END AS refers_to
FROM own LEFT JOIN keepers ON keepers.payload_digest = own.payload_digest AND payload_bytes >= 1000""",
    "op4_line_dedup": f"""
WITH {_LINES.strip()}
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (common.key IS NOT NULL) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (common.key IS NULL), '')) AS kept_sha256
FROM keyed LEFT JOIN common ON keyed.key = common.key
GROUP BY place, doc_id""",
}
