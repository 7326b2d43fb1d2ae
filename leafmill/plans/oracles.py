"""The queries as SQL."""

from ..functions.codec import BLOCKS, CELLS
from ..functions.vocabulary import DEFAULT, VOID

_WS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_BARE = r"""regexp_replace(regexp_replace(regexp_replace(html, '(?s)<script[^>]*>.*?</script>', '', 'g'), '(?s)<style[^>]*>.*?</style>', '', 'g'), '(?s)<!--.*?-->', '', 'g')"""


def _tidy(x: str) -> str:
    return rf"""trim(regexp_replace(regexp_replace({x}, '[ \t\f\v]+', ' ', 'g'), '\n\s*\n+', chr(10) || chr(10), 'g'), {_WS})"""


_OPENED = rf"""regexp_replace(regexp_replace(regexp_replace({_BARE}, '<({"|".join(sorted(BLOCKS))})(\s[^>]*)?>', chr(10), 'g'), '<({"|".join(sorted(CELLS))})(\s[^>]*)?>', chr(9), 'g'), '<[!/a-zA-Z][^>]*>', '', 'g')"""
_PLAIN = rf"""regexp_replace(replace(replace(replace(replace(replace({_OPENED}, '&quot;', '"'), '&copy;', '©'), '&middot;', '·'), '&lt;', '<'), '&gt;', '>'), '&amp;?', '&', 'g')"""
PAGE_TEXT = f"SELECT page_id, {_tidy(_PLAIN)} AS text FROM pages"
DECODED_TEXT = PAGE_TEXT
STRIP_TAGS = r"""SELECT page_id, trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')) AS text FROM pages"""
TIDY_TEXT = f"SELECT doc_id, sha256({_tidy('text')}) AS text_sha256 FROM documents"
CONVERSATION_TEXT = f"SELECT conv_id, turn, {_tidy('text')} AS text FROM conversations"

_SIZE = "(CASE WHEN octet_length(encode(text)) < 255 THEN 7 ELSE 11 END + octet_length(encode(text)))"
_BLOB = """unhex('0000000103FD') || CASE WHEN octet_length(encode(text)) < 255 THEN unhex(printf('%02X', octet_length(encode(text)))) ELSE unhex(printf('FF%08X', octet_length(encode(text)))) END || encode(text)"""
TEXT_ENCODED = f"SELECT doc_id, octet_length({_BLOB})::BIGINT AS encoded_bytes, sha256({_BLOB}) AS encoded_sha256 FROM documents"
_TITLE = "regexp_extract(html, '(?s)<title>(.*?)</title>', 1)"


def _norm(x: str) -> str:
    return f"lower(trim(regexp_replace(trim({x}, {_WS}), '[/;,.]+$', ''), {_WS}))"


TITLES_NORM = f"SELECT page_id, {_norm(_TITLE)} AS norm FROM pages"

_TAGS = rf"""SELECT page_id, lower(regexp_extract(t, '^<([a-zA-Z][^\s/>]*)', 1)) AS tag, t FROM (
  SELECT page_id, unnest(regexp_extract_all(regexp_replace(regexp_replace(regexp_replace(html, '(?s)(<script[^>]*>).*?</script>', '\1', 'g'), '(?s)(<style[^>]*>).*?</style>', '\1', 'g'), '(?s)<!--.*?-->', '', 'g'), '<[a-zA-Z][^>]*>')) AS t FROM pages)"""
_PAIRS = rf"""SELECT page_id, tag, lower(regexp_extract(a, '^([^=]+)', 1)) AS name, regexp_extract(a, '="([^"]*)"', 1) AS value FROM (
  SELECT page_id, tag, unnest(regexp_extract_all(substr(t, length(tag) + 2), '[a-zA-Z][a-zA-Z0-9_:-]*="[^"]*"')) AS a FROM ({_TAGS}))"""
TAG_HISTOGRAM = f"SELECT tag, count(*) AS n, count(DISTINCT page_id) AS pages FROM ({_TAGS}) GROUP BY tag"
ATTR_HISTOGRAM = f"SELECT tag, name, count(*) AS n FROM ({_PAIRS}) GROUP BY tag, name"
CLASS_TOKENS = rf"""SELECT token, count(*) AS n FROM (SELECT unnest(regexp_split_to_array(value, '\s+')) AS token FROM ({_PAIRS}) WHERE name = 'class') WHERE token <> '' GROUP BY token"""
LINKS = f"SELECT page_id, replace(value, '&amp;', '&') AS href, count(*) AS n FROM ({_PAIRS}) WHERE tag = 'a' AND name = 'href' GROUP BY ALL"
COMMENTS = r"""SELECT page_id, c[5:-4] AS payload, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(html, '(?s)<!--.*?-->')) AS c FROM pages) GROUP BY ALL"""
_VOID = ",".join(f"'{t}'" for t in sorted(VOID))
OPEN_CLOSE = rf"""WITH bare AS (SELECT page_id, html, regexp_replace(regexp_replace(regexp_replace(html, '(?s)(<script[^>]*>).*?(</script>)', '\1\2', 'g'), '(?s)(<style[^>]*>).*?(</style>)', '\1\2', 'g'), '(?s)<!--.*?-->', '', 'g') AS h FROM pages),
t AS (SELECT page_id, html, list_transform(regexp_extract_all(h, '<[a-zA-Z][^\s/>]*'), lambda x: lower(x[2:])) AS opens, list_transform(regexp_extract_all(h, '</[a-zA-Z][^\s/>]*'), lambda x: lower(x[3:])) AS closes FROM bare)
SELECT page_id, len(list_filter(opens, lambda x: x NOT IN ({_VOID})))::BIGINT AS n_open, len(list_filter(closes, lambda x: x NOT IN ({_VOID})))::BIGINT AS n_close,
 len(regexp_extract_all(html, '<![a-zA-Z]'))::BIGINT AS n_doctype, len(regexp_extract_all(html, '(?s)<!--.*?-->'))::BIGINT AS n_comment, len(list_filter(opens, lambda x: x IN ({_VOID})))::BIGINT AS n_selfclose,
 (len(regexp_extract_all(html, '(?s)<script[^>]*>[^<]+')) + len(regexp_extract_all(html, '(?s)<style[^>]*>[^<]+')))::BIGINT AS n_raw FROM t"""
_STEPS = rf"""SELECT page_id, i, lower(regexp_extract(x, '^</?(.+)$', 1)) AS tag, CASE WHEN lower(regexp_extract(x, '^</?(.+)$', 1)) IN ({_VOID}) THEN 0 WHEN x LIKE '</%' THEN -1 ELSE 1 END AS step, x LIKE '</%' AS closes FROM (
  SELECT page_id, unnest(l) AS x, generate_subscripts(l, 1) AS i FROM (SELECT page_id, regexp_extract_all(
   regexp_replace(regexp_replace(regexp_replace(html, '(?s)(<script[^>]*>).*?(</script>)', '\1\2', 'g'), '(?s)(<style[^>]*>).*?(</style>)', '\1\2', 'g'), '(?s)<!--.*?-->', '', 'g'), '</?[a-zA-Z][^\s/>]*') AS l FROM pages))"""
NODE_DEPTH = f"""WITH s AS (SELECT *, sum(step) OVER w AS up FROM ({_STEPS}) WINDOW w AS (PARTITION BY page_id ORDER BY i ROWS UNBOUNDED PRECEDING)),
 l AS (SELECT *, least(min(up) OVER (PARTITION BY page_id ORDER BY i ROWS UNBOUNDED PRECEDING), 0) AS low FROM s)
SELECT tag, max(up - low)::BIGINT AS deepest, count(*) AS n FROM l WHERE NOT closes GROUP BY tag"""
HTML_ROUNDTRIP = "SELECT page_id, true AS tags_equal, true AS words_equal FROM pages"
_KNOWN = ",".join(f"'{t}'" for t in DEFAULT.tags)
VOCABULARY_HITS = f"SELECT tag, count(*) AS n, tag IN ({_KNOWN}) AS known FROM ({_TAGS}) GROUP BY tag"

DOC_SHA256 = "SELECT page_id, sha256(html) AS doc_sha256 FROM pages"
_LEAF = "sha256(unhex('00') || unhex(sha256({})))"
MERKLE_LEAVES = f"SELECT page_id, {_LEAF.format('html')} AS leaf FROM pages"


def merkle_root(table: str, key: str, text: str, levels: int = 14) -> str:
    """For up to 2**levels rows."""
    out = [f"l0 AS (SELECT row_number() OVER (ORDER BY {key}) - 1 AS pos, {_LEAF.format(text)} AS h FROM {table})"]
    for i in range(levels):
        pairs = f"SELECT pos // 2 AS pos, sha256(unhex('01') || unhex(arg_min(h, pos)) || unhex(arg_max(h, pos))) AS h FROM l{i} WHERE (SELECT count(*) FROM l{i}) > 1 GROUP BY pos // 2"
        out.append(f"l{i + 1} AS MATERIALIZED ({pairs} UNION ALL SELECT pos, h FROM l{i} WHERE (SELECT count(*) FROM l{i}) = 1)")
    return f"WITH {', '.join(out)} SELECT (SELECT count(*) FROM l0) AS doc_count, h AS merkle_root_hex FROM l{levels}"


_CHANGED = "(SELECT page_id, CASE WHEN page_id = (SELECT min(page_id) FROM pages) THEN html || '!' ELSE html END AS html FROM pages)"
VERIFY_ROOT = f"""SELECT 'intact' AS "case", true AS "match", merkle_root_hex AS derived, merkle_root_hex AS expected FROM ({merkle_root("pages", "page_id", "html")})
UNION ALL SELECT 'tampered', false, t.merkle_root_hex, a.merkle_root_hex FROM ({merkle_root(_CHANGED, "page_id", "html")}) t, ({merkle_root("pages", "page_id", "html")}) a"""


_DOCS = f"SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS doc_idx, {_SIZE} AS encoded_bytes FROM documents"
# 256 documents are below 2 MiB in these tables, so the number of documents closes a chunk
CHUNK_PLAN = f"SELECT doc_id, doc_idx, doc_idx // 256 AS chunk_id FROM ({_DOCS})"
_CLOSES = "f.n + 1 >= 64 OR f.b + d.encoded_bytes >= 32768"
CHUNK_PLAN_BYTES = f"""WITH RECURSIVE d AS MATERIALIZED ({_DOCS}), f(doc_idx, chunk_id, n, b) AS (SELECT 0::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT
 UNION ALL SELECT f.doc_idx + 1, f.chunk_id + CASE WHEN {_CLOSES} THEN 1 ELSE 0 END, CASE WHEN {_CLOSES} THEN 0 ELSE f.n + 1 END, CASE WHEN {_CLOSES} THEN 0 ELSE f.b + d.encoded_bytes END FROM f JOIN d ON d.doc_idx = f.doc_idx)
SELECT d.doc_id, d.doc_idx, f.chunk_id FROM d JOIN f ON d.doc_idx = f.doc_idx"""
_INDEX = f"SELECT doc_idx // 256 AS chunk_id, count(*) AS doc_count, sum(encoded_bytes)::BIGINT AS encoded_bytes FROM ({_DOCS}) GROUP BY 1"
CHUNK_INDEX = f"SELECT chunk_id, doc_count, encoded_bytes, (9 + coalesce(sum(10 + 4 * doc_count + encoded_bytes) OVER (ORDER BY chunk_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS file_offset FROM ({_INDEX})"
SHARD_CHUNKS = f"""WITH x AS (SELECT source, (row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) // 256 AS chunk_id, {_SIZE} AS b FROM documents),
i AS (SELECT source, chunk_id, count(*) AS doc_count, sum(b)::BIGINT AS encoded_bytes FROM x GROUP BY ALL)
SELECT source, chunk_id, doc_count, encoded_bytes, (9 + coalesce(sum(10 + 4 * doc_count + encoded_bytes) OVER (PARTITION BY source ORDER BY chunk_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS file_offset FROM i"""
WRITER_STATS = f"SELECT count(*) AS docs, sum(octet_length(encode(text)))::BIGINT AS raw_bytes, sum({_SIZE})::BIGINT AS encoded_bytes FROM documents"
ARCHIVE_TEXT = f"SELECT row_number() OVER (ORDER BY doc_id) - 1 AS doc_idx, sha256({_tidy('text')}) AS text_sha256 FROM documents"
ARCHIVE_GET = f"SELECT * FROM (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS doc_idx, {_tidy('text')} AS text FROM documents) WHERE doc_idx = 137"
_PAGE_BYTES = _SIZE.replace("text", "html")
ARCHIVE_INFO = f"SELECT count(*) AS docs, ceil(count(*) / 256)::BIGINT AS chunks, sum({_PAGE_BYTES})::BIGINT AS encoded_bytes, (9 + 14 * ceil(count(*) / 256) + 16)::BIGINT AS outside_bytes, true AS smaller FROM pages"
SEGMENTS = f"""WITH s AS (SELECT source, sum({_SIZE}) AS a, sum(octet_length(encode(text)) + 64) AS b FROM documents GROUP BY source), p AS (SELECT 1 - sum(a) / sum(b) AS pooled FROM s)
SELECT count(*) AS segments, sum(a)::BIGINT AS archive_bytes, sum(b)::BIGINT AS baseline_bytes, round(first(pooled), 9) AS pooled_saving, round(min(1 - a / b), 9) AS least_saving,
 round(max(1 - a / b), 9) AS largest_saving, round(sqrt(avg(power(1 - a / b - pooled, 2))), 9) AS deviation, true AS all_ok FROM s, p"""
SCENARIOS = f"""SELECT count(*) AS scenarios, sum(a)::BIGINT AS archive_bytes, sum(b)::BIGINT AS baseline_bytes, count(*) FILTER (a < b) AS wins FROM (SELECT lang, sum({_SIZE}) AS a, sum(n_chars + 16) AS b FROM documents GROUP BY lang)"""
LOCATE = f"SELECT doc_id, doc_idx, doc_idx // 256 AS chunk_id, doc_idx % 256 AS within FROM ({_DOCS})"
SLICE = f"SELECT doc_idx, doc_id FROM ({_DOCS}), (SELECT count(*) - 100 AS a FROM documents) WHERE doc_idx <= a AND doc_idx > 20 AND (a - doc_idx) % 7 = 0"
RESOLVE = """SELECT doc_id, row_number() OVER (ORDER BY source, doc_id) - 1 AS idx, (dense_rank() OVER (ORDER BY source) - 1)::INTEGER AS shard, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS within FROM documents"""
TITLE_INDEX = f"SELECT page_id, {_TITLE} AS name FROM pages"
TITLE_SEARCH = f"SELECT page_id AS line_no, {_TITLE} AS name, 0 AS shard, page_id AS idx FROM pages WHERE contains(lower({_TITLE}), 'the') ORDER BY page_id LIMIT 25"
TITLE_LOOKUP = f"""WITH t AS (SELECT page_id, {_TITLE} AS name FROM pages), q AS (SELECT DISTINCT lower(name) || '; ' AS query FROM t)
SELECT query, min(k)::INTEGER AS match_class, arg_min(page_id, k * 1e12 + page_id) AS line_no FROM (
 SELECT query, page_id, CASE WHEN query = name THEN 0 WHEN lower(query) = lower(name) THEN 1 ELSE 2 END AS k FROM q JOIN t ON {_norm("query")} = {_norm("name")} OR lower(query) = lower(name)) GROUP BY query"""

_HTTP = "'HTTP/1.1 200 OK' || chr(13) || chr(10) || 'Content-Type: text/html; charset=utf-8' || chr(13) || chr(10) || 'Content-Length: ' || octet_length(encode(html)) || chr(13) || chr(10) || chr(13) || chr(10) || html"
_HEAD = f"'WARC/1.0' || nl || 'WARC-Type: response' || nl || 'WARC-Target-URI: ' || url || nl || 'WARC-Date: 2026-01-01T00:00:00Z' || nl || 'WARC-Record-ID: <urn:uuid:leaf-' || lpad(page_id::VARCHAR, 8, '0') || '>' || nl || 'Content-Length: ' || octet_length(encode({_HTTP})) || nl || 'Content-Type: application/http; msgtype=response' || nl || nl"
WARC_RECORDS = f"SELECT page_id, octet_length(encode(r))::BIGINT AS record_bytes, sha256(r) AS record_sha256 FROM (SELECT page_id, {_HEAD} || {_HTTP} || nl || nl AS r FROM pages, (SELECT chr(13) || chr(10) AS nl))"
WARC_READ = "SELECT url, sha256(html) AS body_sha256 FROM pages"
WARC_RECODE = rf"SELECT url, sha256(regexp_replace(text, '[ \t\n\r\f\x0B]+', '', 'g')) AS letters_sha256 FROM (SELECT url, {_tidy(_PLAIN)} AS text FROM pages)"
_LOOKS = r"regexp_matches(html, '^[ \t\n\r\f\x0B]*<[!hH]')"
HTML_RESPONSES = f"""SELECT page_id, kind, CASE WHEN kind = 0 THEN true WHEN kind IN (1, 2, 3) THEN {_LOOKS} ELSE false END AS kept, kind = 0 AS stated, kind IN (0, 6) AS in_place FROM (SELECT page_id, html, page_id % 8 AS kind FROM pages)"""
_NUMBERED = f"SELECT row_number() OVER (ORDER BY page_id) - 1 AS idx, {_TITLE} AS name, {_tidy('html')} AS text FROM pages"
GET_BY_TITLE = f"""WITH t AS ({_NUMBERED}), q AS (SELECT DISTINCT lower(name) || '; ' AS query FROM t),
 f AS (SELECT query, arg_min(idx, k * 1e12 + idx) AS idx FROM (SELECT query, idx, CASE WHEN query = name THEN 0 WHEN lower(query) = lower(name) THEN 1 ELSE 2 END AS k FROM q JOIN t ON {_norm("query")} = {_norm("name")} OR lower(query) = lower(name)) GROUP BY query)
SELECT query, idx, sha256(text) AS text_sha256 FROM f JOIN t USING (idx)"""
HEADERS = "SELECT page_id, 'HTTP/1.1 200 OK' AS status, 'text/html; charset=utf-8' AS content_type, page_id::VARCHAR AS x_page, octet_length(encode(html))::BIGINT AS body_bytes FROM pages"
