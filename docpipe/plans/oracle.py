"""The registered queries once more, as plain SQL for an independent engine."""

_SPACE = (
    r"[\s\x0b\x1c-\x1f\x85\xa0\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
)
_DROPPED = "|".join(
    ["<!--.*?-->"] + [rf"<{t}\b[^>]*>.*?</{t}\s*>" for t in ("nav", "header", "footer", "aside", "script", "style")]
)


def _decoded(text):
    """Character references that occur in the pages; "&amp" may lack its semicolon."""
    text = rf"regexp_replace({text}, '&amp([^a-zA-Z0-9;]|$)', '&amp;\1', 'g')"
    for name, char in [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")]:
        text = f"replace({text}, '{name}', '{char}')"
    return text


def _inner(tag):
    return rf"regexp_extract(bare, '(?is)<{tag}\b[^>]*>(.*?)</{tag}\s*>', 1)"


def _timeout_batches(timeout):
    """Count-or-timeout batches by walking each event type from its first row (recursive)."""
    return f"""WITH RECURSIVE r AS (
          SELECT event_type, ts, event_id, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS i,
                 count(*) OVER (PARTITION BY event_type) AS m FROM events WHERE ts IS NOT NULL),
        nx AS (
          SELECT a.event_type, a.i, a.event_id, a.ts, a.m, least(a.i + 32, a.m, coalesce((
            SELECT min(b.i) FROM r b WHERE b.event_type IS NOT DISTINCT FROM a.event_type AND b.ts >= a.ts + INTERVAL {timeout}), a.m)) AS nxt
          FROM r a),
        walk AS (
          SELECT DISTINCT event_type, 0 AS batch_no, CAST(0 AS BIGINT) AS i FROM r
          UNION ALL
          SELECT w.event_type, w.batch_no + 1, n.nxt FROM walk w JOIN nx n ON n.event_type IS NOT DISTINCT FROM w.event_type AND n.i = w.i
          WHERE n.nxt < n.m)
        SELECT n.event_type, CAST(w.batch_no AS BIGINT) AS batch_no, n.event_id AS first_id, epoch_us(n.ts) AS first_us,
          CAST(n.nxt - n.i AS BIGINT) AS n,
          CASE WHEN n.nxt - n.i = 32 THEN 'size' WHEN n.nxt = n.m THEN 'end' ELSE 'timeout' END AS closed_by
        FROM walk w JOIN nx n ON n.event_type IS NOT DISTINCT FROM w.event_type AND n.i = w.i"""


# Page extraction for the mark-up that occurs in the pages table.
def _page_sql(source):
    return f"""
bare AS (
  SELECT page_id, url, regexp_replace(html, '{_DROPPED}', ' ', 'gsi') AS bare FROM {source}),
rooted AS (
  SELECT page_id, url, bare,
    CASE WHEN bare IS NULL THEN NULL WHEN bare ILIKE '%<main%' THEN {_inner('main')}
         WHEN bare ILIKE '%<article%' THEN {_inner('article')}
         WHEN bare ILIKE '%<body%' THEN {_inner('body')} ELSE '' END AS root FROM bare),
texted AS (
  SELECT page_id, url,
    CASE WHEN bare IS NULL THEN NULL WHEN bare ILIKE '%<title%' THEN trim({_decoded(_inner('title'))}) ELSE url END AS title,
    trim(regexp_replace({_decoded("regexp_replace(root, '<[^>]*>', ' ', 'g')")}, '{_SPACE}', ' ', 'g')) AS text
  FROM rooted),
extracted AS (SELECT *, sha256(text) AS content_hash FROM texted),
seen AS (
  SELECT url, CASE WHEN url LIKE 'http:%' THEN sha256(title || text) ELSE content_hash END AS seen_hash
  FROM extracted WHERE url NOT LIKE '%?%'),
outcomes AS (
  SELECT page_id, e.url,
    CASE WHEN text IS NULL THEN 'fetch_error' WHEN text = '' THEN 'empty' WHEN content_hash = seen_hash THEN 'unchanged' ELSE 'emitted' END AS outcome
  FROM extracted e LEFT JOIN seen s ON e.url = s.url)"""


_PAGES = _page_sql("pages")

# A crawl with failed fetches, empty bodies and missing titles.
_CRAWL = rf"""
raw AS (
  SELECT page_id, url, CASE page_id % 17 WHEN 3 THEN NULL WHEN 5 THEN '<html><body></body></html>'
    WHEN 7 THEN regexp_replace(html, '(?is)<title\b[^>]*>.*?</title\s*>', '', 'g') ELSE html END AS html FROM pages),
{_page_sql("raw")}"""

_PAGE_JSON = """
page_json AS (
  SELECT url AS key, to_json(struct_pack(url := url, title := title, text := text,
    crawled_at := '2024-01-31T00:00:00.000000+00:00', content_hash := content_hash))::VARCHAR AS value
  FROM extracted)"""


def _windows(source, size, overlap, keep):
    """Token windows of `source`(keep.., text)."""
    stride = size - overlap
    cols = ", ".join(keep)
    return f"""
tokens AS (
  SELECT {cols}, list_filter(string_split_regex(text, '{_SPACE}'), lambda w: w <> '') AS t FROM {source}),
counted AS (
  SELECT *, 1 + CASE WHEN len(t) > {size} THEN CAST(ceil((len(t) - {size}) / {float(stride)}) AS BIGINT) ELSE 0 END
    AS total_chunks FROM tokens WHERE len(t) > 0),
numbered AS (SELECT *, unnest(range(total_chunks)) AS chunk_index FROM counted),
cut AS (
  SELECT {cols}, chunk_index, total_chunks,
    t[chunk_index * {stride} + 1 : chunk_index * {stride} + {size}] AS w FROM numbered),
windows AS (
  SELECT {cols}, chunk_index, total_chunks, CAST(len(w) AS BIGINT) AS n_tokens, array_to_string(w, ' ') AS text
  FROM cut)"""


def _chunk_id(size=512, overlap=64):
    return (f"sha256(concat_ws(chr(1), url, content_hash, CAST(chunk_index AS VARCHAR), "
            f"'{size}', '{overlap}', 'whitespace'))")


_DOC_PAGES = """
doc_pages AS (
  SELECT doc_id, lang, 'doc://' || source || '/' || doc_id AS url, source || ' ' || doc_id AS title, text,
    sha256(text) AS content_hash FROM documents)"""

_CHUNKS = f"""{_DOC_PAGES},
{_windows('doc_pages', 512, 64, ['lang', 'url', 'title', 'content_hash'])},
chunk AS (SELECT {_chunk_id()} AS chunk_id, *, CAST(0 AS BIGINT) AS created_at FROM windows)"""


def _buckets(source, key):
    """(key, bucket, n) of the hashed bag of words."""
    return f"""(
  SELECT {key}, CAST(('0x' || substr(md5(w), 1, 8))::BIGINT % 384 AS BIGINT) AS bucket, count(*) AS n
  FROM (SELECT {key}, unnest(string_split_regex(lower(text), '[^\\p{{L}}\\p{{N}}]+')) AS w FROM {source})
  WHERE w <> '' GROUP BY ALL)"""


def _unit(source, key):
    """(key, bucket, w): unit vectors stored as 32-bit floats."""
    return f"""(
  SELECT {key}, bucket, CAST(CAST(n / sqrt(sum(n * n) OVER (PARTITION BY {key})) AS FLOAT) AS DOUBLE) AS w
  FROM {_buckets(source, key)})"""


# Chunk and query vectors, their lengths, and all scores.
_SCORES = f"""
cv AS {_unit('chunk', 'chunk_id')},
qv AS {_unit('asked', 'query_id')},
cn AS (SELECT chunk_id, sqrt(sum(w * w)) AS len FROM cv GROUP BY 1),
qn AS (SELECT query_id, sqrt(sum(w * w)) AS len FROM qv GROUP BY 1),
dots AS (
  SELECT query_id, chunk_id, sum(q.w * c.w) AS dot FROM qv q JOIN cv c USING (bucket) GROUP BY 1, 2),
scores AS (
  SELECT a.query_id, c.chunk_id, round(coalesce(dot / (qn.len * cn.len), 0.0), 9) AS s
  FROM asked a CROSS JOIN chunk c
  LEFT JOIN dots d ON d.query_id = a.query_id AND d.chunk_id = c.chunk_id
  LEFT JOIN qn ON qn.query_id = a.query_id LEFT JOIN cn ON cn.chunk_id = c.chunk_id),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, chunk_id) AS rank FROM scores)"""

_TEXT_SEARCH = f"{_CHUNKS}, {_SCORES}"

_ASKED = rf"""
asked AS (
  SELECT item_id AS query_id, regexp_replace(text, '^{_SPACE}|{_SPACE}$', '', 'g') AS text FROM benchmark
  WHERE length(text) BETWEEN 1 AND 2048 AND regexp_replace(text, '^{_SPACE}|{_SPACE}$', '', 'g') <> '')"""

_PAGE_CHUNKS = f"""{_PAGES},
page_ready AS (SELECT url, title, content_hash, text FROM extracted WHERE text <> ''),
{_windows('page_ready', 512, 64, ['url', 'title', 'content_hash'])},
chunk AS (SELECT {_chunk_id()} AS chunk_id, *, CAST(0 AS BIGINT) AS created_at FROM windows)"""

# Language cells: mean directions, nearest cell per chunk and per query.
_CELLS = """
lang_no AS (SELECT lang, row_number() OVER (ORDER BY lang) - 1 AS cell FROM (SELECT DISTINCT lang FROM chunk)),
lang_mean AS (
  SELECT cell, bucket, sum(w) AS m FROM cv JOIN chunk USING (chunk_id) JOIN lang_no USING (lang) GROUP BY 1, 2),
centre AS (SELECT cell, bucket, m / sqrt(sum(m * m) OVER (PARTITION BY cell)) AS m FROM lang_mean),
chunk_near AS (
  SELECT chunk_id, cell, round(coalesce(sum(w * m), 0) / max(len), 9) AS s
  FROM cv JOIN cn USING (chunk_id) JOIN centre USING (bucket) GROUP BY 1, 2),
chunk_cell AS (
  SELECT chunk_id, cell FROM chunk_near
  QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY s DESC, cell) = 1),
query_near AS (
  SELECT query_id, cell, round(coalesce(sum(w * m), 0) / max(len), 9) AS s
  FROM qv JOIN qn USING (query_id) JOIN centre USING (bucket) GROUP BY 1, 2),
query_cell AS (
  SELECT query_id, cell FROM query_near
  QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY s DESC, cell) = 1),
probed AS (
  SELECT s.query_id, s.chunk_id, s.s,
    row_number() OVER (PARTITION BY s.query_id ORDER BY s.s DESC, s.chunk_id) AS rank
  FROM scores s JOIN query_cell q ON q.query_id = s.query_id
  JOIN (SELECT chunk_id, cell FROM chunk_cell
        UNION ALL SELECT chunk_id, 0 FROM chunk WHERE chunk_id NOT IN (SELECT chunk_id FROM chunk_cell)) c
    ON c.chunk_id = s.chunk_id AND c.cell = q.cell)"""

# Mean direction per label of the embeddings table.
_LABELS = """
cells AS (
  SELECT vec_id, label, generate_subscripts(embedding, 1) AS pos, CAST(unnest(embedding) AS DOUBLE) AS x
  FROM embeddings),
label_mean AS (SELECT label, pos, avg(x) AS m FROM cells GROUP BY 1, 2),
label_dir AS (SELECT label, pos, m / sqrt(sum(m * m) OVER (PARTITION BY label)) AS m FROM label_mean),
lengths AS (SELECT vec_id, sqrt(sum(x * x)) AS len FROM cells GROUP BY 1),
label_scores AS (
  SELECT d.label AS cell, c.vec_id, any_value(c.label) AS label, round(sum(c.x * d.m) / any_value(len), 9) AS s
  FROM cells c JOIN label_dir d USING (pos) JOIN lengths USING (vec_id) GROUP BY 1, 2),
label_cell AS (
  SELECT vec_id, label, cell FROM label_scores
  QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, cell) = 1)"""


def _exact(k):
    return f"""WITH {_LABELS}
SELECT cell AS query_id, rank, vec_id, label, round(s, 4) AS score FROM (
  SELECT *, row_number() OVER (PARTITION BY cell ORDER BY s DESC, vec_id) AS rank FROM label_scores)
WHERE rank <= {k}"""


def _histogram(source, value, bounds, by=()):
    keys = "".join(f"{c}, " for c in by)
    group = f"GROUP BY {', '.join(by)}" if by else ""
    counts = " UNION ALL ".join(
        f"SELECT {keys}CAST({b} AS DOUBLE) AS le, CAST(count(*) FILTER ({value} <= CAST({b} AS DOUBLE)) AS BIGINT) AS n, "
        f"round(CAST(sum({value}) AS DOUBLE), 6) AS total, count(*) AS count FROM {source} {group}"
        for b in [*bounds, "'inf'"]
    )
    return counts


_LATENCY = [0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0]
_SECONDS = "seconds AS (SELECT event_type, value / 1000 AS v FROM events)"


def _quantile(q):
    return f"""(SELECT event_type, round(CASE WHEN le = CAST('inf' AS DOUBLE) THEN low WHEN n = below THEN coalesce(low, 0)
    ELSE coalesce(low, 0) + (le - coalesce(low, 0)) * ({q} * total_n - below) / (n - below) END, 6) AS v
  FROM marked WHERE n >= {q} * total_n
  QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY le) = 1)"""


_COUNTER = """
counter AS (
  SELECT event_id, event_type, ts, CAST(props->>'$.k' AS DOUBLE) AS v FROM events),
stepped AS (
  SELECT *, lag(v) OVER w AS pv, lag(ts) OVER w AS pts FROM counter
  WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id)),
steps AS (
  SELECT *, CASE WHEN pv IS NULL THEN NULL WHEN v < pv THEN v ELSE v - pv END AS step FROM stepped)"""

_INCREASE = f"""{_COUNTER},
grown AS (
  SELECT event_type, time_bucket(INTERVAL '6 hours', ts) AS start,
    sum(CASE WHEN pts >= time_bucket(INTERVAL '6 hours', ts) THEN step ELSE 0 END) AS increase
  FROM steps GROUP BY 1, 2)"""


def _throughput(seconds):
    return f"""
SELECT DISTINCT event_type, epoch_us(ts) AS ts_us, n, round(n / {float(seconds)}, 9) AS per_second FROM (
  SELECT event_type, ts, count(*) OVER (PARTITION BY event_type ORDER BY epoch_us(ts)
    RANGE BETWEEN {seconds * 1_000_000} PRECEDING AND CURRENT ROW) AS n FROM events)"""


_BATCHES = """
batches AS (
  SELECT source, CAST((rn - 1) // 32 AS BIGINT) AS batch_no, count(*) AS n FROM (
    SELECT source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn FROM documents)
  GROUP BY 1, 2)"""

_VERSIONS = """
versions AS (
  SELECT 'doc://' || source || '/' || lang AS url, doc_id, sha256(text) AS content_hash FROM documents),
known AS (SELECT url, arg_min(content_hash, doc_id) AS seen_hash FROM versions GROUP BY 1),
compared AS (
  SELECT v.url, doc_id, content_hash,
    coalesce(lag(content_hash) OVER (PARTITION BY v.url ORDER BY doc_id), seen_hash) AS before
  FROM versions v LEFT JOIN known k ON v.url = k.url)"""

_UPSERT = f"""{_DOC_PAGES},
revised AS (
  SELECT url, title, CASE WHEN lang = 'fr' THEN text || ' (revised)' ELSE text END AS text
  FROM doc_pages WHERE lang IN ('de', 'fr')),
versions AS (
  SELECT url, title, content_hash, text, 1 AS created_at FROM doc_pages
  UNION ALL SELECT url, title, sha256(text), text, 2 FROM revised),
{_windows('versions', 512, 64, ['url', 'title', 'content_hash', 'created_at'])},
ids AS (SELECT {_chunk_id()} AS chunk_id, * FROM windows),
newest AS (
  SELECT * FROM ids QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY created_at DESC) = 1),
latest AS (SELECT url, arg_max(content_hash, created_at) AS content_hash FROM newest GROUP BY 1)"""

_ALERTS = """
checks AS (
  SELECT user_id, time_bucket(INTERVAL '1 day', ts) AS ts, bool_or(event_type = 'error') AS active
  FROM events GROUP BY 1, 2),
ordered AS (
  SELECT *, lag(active) OVER w AS before, ts - lag(ts) OVER w AS gap FROM checks
  WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
islands AS (
  SELECT *, max(CASE WHEN active AND (before IS NULL OR NOT before OR gap > INTERVAL '1 day') THEN ts END)
    OVER (PARTITION BY user_id ORDER BY ts) AS since FROM ordered)"""

_GAUGES = """
covered AS (
  SELECT 'type=' || event_type AS series, epoch_us(ts) AS us, value,
    unnest(range(CAST(ceil(epoch_us(ts) / 600e6) AS BIGINT), CAST(ceil((epoch_us(ts) + 7200000000) / 600e6) AS BIGINT))) AS slot
  FROM events),
newest AS (
  SELECT series, slot, value FROM covered
  QUALIFY row_number() OVER (PARTITION BY series, slot ORDER BY us DESC, value DESC) = 1),
ordered AS (
  SELECT series, slot, value > 60 AS active, lag(value > 60) OVER w AS before, slot - lag(slot) OVER w AS gap FROM newest
  WINDOW w AS (PARTITION BY series ORDER BY slot)),
islands AS (
  SELECT *, max(CASE WHEN active AND (before IS NULL OR NOT before OR gap > 1) THEN slot END)
    OVER (PARTITION BY series ORDER BY slot) AS since FROM ordered)"""

ORACLE = {
    "page_scan": """SELECT page_id, url, CAST(strlen(html) AS BIGINT) AS html_bytes, sha256(html) AS html_hash FROM pages""",
    "page_titles": f"WITH {_PAGES} SELECT page_id, url, title FROM extracted",
    "page_extract": f"WITH {_PAGES} SELECT page_id, url, title, text, content_hash FROM extracted",
    "nonempty_pages": f"WITH {_CRAWL} SELECT page_id, url, content_hash FROM extracted WHERE text <> ''",
    "url_filter": "SELECT page_id, url FROM pages WHERE contains(url, '/en/')",
    "frontier_cap": "SELECT page_id, url FROM pages WHERE contains(url, '/en/') ORDER BY page_id LIMIT 50",
    "sitemap_urls": "SELECT page_id, CAST(0 AS BIGINT) AS pos, url FROM pages",
    "sitemap_index": """SELECT child_pos, pos, url FROM (SELECT CAST(page_id // 100 AS BIGINT) AS child_pos,
        row_number() OVER (PARTITION BY page_id // 100 ORDER BY page_id) - 1 AS pos, url FROM pages) WHERE contains(url, '/en/')""",
    "changed_pages": f"""WITH {_CRAWL} SELECT page_id, e.url, content_hash
        FROM extracted e LEFT JOIN seen s ON e.url = s.url
        WHERE text <> '' AND content_hash IS DISTINCT FROM seen_hash""",
    "unchanged_pages": f"""WITH {_CRAWL} SELECT page_id, e.url, content_hash
        FROM extracted e JOIN seen s ON e.url = s.url AND content_hash = seen_hash WHERE text <> ''""",
    "page_versions": f"WITH {_VERSIONS} SELECT url, doc_id, content_hash FROM compared WHERE content_hash IS DISTINCT FROM before",
    "errors_by_reason": f"""SELECT stage, reason, count(*) AS n FROM (
          SELECT 'crawler' AS stage, outcome AS reason FROM (WITH {_CRAWL} SELECT outcome FROM outcomes)
            WHERE outcome IN ('fetch_error', 'parse_error')
          UNION ALL SELECT 'consumer', 'malformed' FROM conversations
          UNION ALL SELECT 'chunker', violation FROM (WITH {_CHUNKS}, hashed AS (SELECT sha256(text) AS chunk_id, * EXCLUDE (chunk_id) FROM chunk)
            SELECT chunk_id, 'url_too_long' AS violation FROM hashed WHERE strlen(url) > 2048
            UNION ALL SELECT chunk_id, 'title_too_long' FROM hashed WHERE strlen(title) > 512
            UNION ALL SELECT chunk_id, 'text_too_long' FROM hashed WHERE strlen(text) > 4096
            UNION ALL SELECT chunk_id, 'chunk_id_duplicate' FROM hashed GROUP BY chunk_id HAVING count(*) > 1)) GROUP BY ALL""",
    "crawl_outcomes": f"WITH {_CRAWL} SELECT page_id, url, outcome FROM outcomes",
    "crawl_report_observed": f"""WITH {_CRAWL} SELECT count(*) AS urls_found, count(*) FILTER (outcome <> 'fetch_error') AS crawled,
        count(*) FILTER (outcome = 'emitted') AS emitted,
        count(*) FILTER (outcome IN ('empty', 'unchanged')) AS skipped,
        count(*) FILTER (outcome = 'fetch_error') AS errored_fetch, CAST(0 AS BIGINT) AS errored_parse FROM outcomes""",
    "crawl_report": f"""WITH {_CRAWL} SELECT count(*) AS urls_found, count(*) FILTER (outcome <> 'fetch_error') AS crawled,
        count(*) FILTER (outcome = 'emitted') AS emitted,
        count(*) FILTER (outcome IN ('empty', 'unchanged')) AS skipped,
        count(*) FILTER (outcome = 'fetch_error') AS errored_fetch, CAST(0 AS BIGINT) AS errored_parse FROM outcomes""",
    "skip_ratio": f"""WITH {_CRAWL} SELECT regexp_extract(url, '/(en|de|es|fr)/', 1) AS section,
        count(*) FILTER (outcome <> 'emitted') AS part, count(*) AS whole,
        round(count(*) FILTER (outcome <> 'emitted') / count(*), 9) AS ratio FROM outcomes
        WHERE outcome <> 'fetch_error' GROUP BY 1""",
    "page_events_json": f"WITH {_PAGES}, {_PAGE_JSON} SELECT key, value FROM page_json",
    "chunk_events_json": f"""WITH {_CHUNKS} SELECT chunk_id AS key, to_json(struct_pack(chunk_id := chunk_id, url := url,
        title := title, chunk_index := chunk_index, total_chunks := total_chunks, text := text,
        content_hash := content_hash, created_at := created_at))::VARCHAR AS value FROM chunk""",
    "json_events": f"""WITH {_PAGES} SELECT url, title, text, '2024-01-31T00:00:00.000000+00:00' AS crawled_at,
        content_hash FROM extracted""",
    "chunk_events_read": f"""WITH {_CHUNKS}
        SELECT chunk_id, coalesce(CASE WHEN chunk_index % 3 = 1 THEN NULL ELSE url END, '') AS url,
          coalesce(CASE WHEN chunk_index % 3 = 1 THEN NULL ELSE title END, '') AS title, CAST(chunk_index AS BIGINT) AS chunk_index,
          CAST(NULL AS VARCHAR) AS reason FROM chunk WHERE chunk_index % 7 <> 5
        UNION ALL SELECT chunk_id, CASE WHEN chunk_index % 3 = 1 THEN NULL ELSE url END, CASE WHEN chunk_index % 3 = 1 THEN NULL ELSE title END,
          CAST(chunk_index AS BIGINT), 'missing_text' FROM chunk WHERE chunk_index % 7 = 5
        UNION ALL SELECT NULL, NULL, NULL, NULL, 'malformed' FROM conversations""",
    "stream_redelivery": f"WITH {_PAGES} SELECT url, content_hash FROM extracted WHERE text <> ''",
    "malformed_events": "SELECT text AS value, 'malformed' AS reason FROM conversations",
    "constraint_violations": f"""WITH {_CHUNKS}, hashed AS (SELECT sha256(text) AS chunk_id, * EXCLUDE (chunk_id) FROM chunk)
        SELECT chunk_id, 'url_too_long' AS violation FROM hashed WHERE strlen(url) > 2048
        UNION ALL SELECT chunk_id, 'title_too_long' FROM hashed WHERE strlen(title) > 512
        UNION ALL SELECT chunk_id, 'text_too_long' FROM hashed WHERE strlen(text) > 4096
        UNION ALL SELECT chunk_id, 'chunk_id_duplicate' FROM hashed GROUP BY chunk_id HAVING count(*) > 1""",
    "chunk_windows": f"WITH {_windows('documents', 512, 64, ['doc_id'])} SELECT doc_id, chunk_index, total_chunks, text FROM windows",
    "chunk_windows_small": f"WITH {_windows('documents', 64, 8, ['doc_id'])} SELECT doc_id, chunk_index, total_chunks, text FROM windows",
    "chunk_rows": f"""WITH {_CHUNKS} SELECT chunk_id, url, title, chunk_index, total_chunks, text, content_hash, created_at
        FROM chunk""",
    "chunk_token_counts": f"WITH {_windows('documents', 512, 64, ['doc_id'])} SELECT doc_id, chunk_index, n_tokens FROM windows",
    "pretoken_lossless": "SELECT doc_id, sha256(text) AS text_hash FROM documents WHERE text <> ''",
    "upsert_chunks": f"""WITH {_UPSERT} SELECT chunk_id, url, chunk_index, total_chunks, text, content_hash,
        CAST(created_at AS BIGINT) AS created_at FROM newest SEMI JOIN latest USING (url, content_hash)""",
    "vector_dims": "SELECT vec_id, CAST(len(embedding) AS BIGINT) AS dim FROM embeddings",
    "l2_normalize": f"""WITH {_LABELS} SELECT vec_id, CAST(pos - 1 AS BIGINT) AS pos, round(x / len, 6) AS value
        FROM cells JOIN lengths USING (vec_id)""",
    "cosine_pairs": f"""WITH {_LABELS} SELECT c.vec_id, c.label, round(sum(c.x * d.m) / any_value(len), 6) AS cosine
        FROM cells c JOIN label_dir d ON c.label = d.label AND c.pos = d.pos JOIN lengths l ON l.vec_id = c.vec_id
        GROUP BY 1, 2""",
    "exact_search": _exact(5),
    "exact_search_k50": _exact(50),
    "stream_vector_table": f"""WITH {_LABELS}, flipped AS (
          SELECT vec_id, cell FROM label_scores QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY -s DESC, cell) = 1)
        SELECT e.vec_id, e.vec_id // 4 AS page, CAST(CASE WHEN (e.vec_id // 4) % 3 = 0 THEN 2 ELSE 1 END AS BIGINT) AS version,
          CASE WHEN (e.vec_id // 4) % 3 = 0 THEN f.cell ELSE l.cell END AS cell
        FROM embeddings e JOIN label_cell l USING (vec_id) JOIN flipped f USING (vec_id)
        WHERE e.embedding IS NOT NULL AND NOT ((e.vec_id // 4) % 3 = 0 AND e.vec_id % 4 = 3)""",
    "assign_cells": f"WITH {_LABELS} SELECT vec_id, label, cell FROM label_cell",
    "cell_sizes": f"WITH {_LABELS} SELECT cell, count(*) AS n FROM label_cell GROUP BY 1",
    "kmeans_check": "SELECT count(*) AS rows, CAST(0 AS BIGINT) AS misplaced FROM embeddings",
    "hash_embed_sparse": f"SELECT doc_id, bucket, n FROM {_buckets('documents', 'doc_id')}",
    "hash_embed_dense": f"SELECT doc_id, bucket, round(w, 6) AS weight FROM {_unit('documents', 'doc_id')}",
    "valid_queries": f"""SELECT conv_id, turn, s AS text, turn AS top_k,
        CASE WHEN text IS NULL OR length(text) < 1 THEN 'empty' WHEN length(text) > 2048 THEN 'too_long'
          WHEN s = '' THEN 'blank' WHEN turn < 1 OR turn > 50 THEN 'bad_top_k' END AS reason
        FROM (SELECT *, regexp_replace(text, '^{_SPACE}|{_SPACE}$', '', 'g') AS s FROM conversations)""",
    "text_search": f"""WITH {_ASKED}, {_TEXT_SEARCH}
        SELECT query_id, rank, chunk_id, url, title, chunk_index, total_chunks, text, round(s, 4) AS score
        FROM ranked JOIN chunk USING (chunk_id) WHERE rank <= 5""",
    "page_search": f"""WITH {_ASKED}, {_PAGE_CHUNKS}, {_SCORES}
        SELECT query_id, rank, chunk_id, url, title, chunk_index, total_chunks, text, round(s, 4) AS score
        FROM ranked JOIN chunk USING (chunk_id) WHERE rank <= 5""",
    "ivf_search": f"""WITH {_ASKED}, {_TEXT_SEARCH}, {_CELLS}
        SELECT query_id, rank, chunk_id, round(s, 4) AS score FROM probed WHERE rank <= 5""",
    "ivf_search_all_cells": f"""WITH {_ASKED}, {_TEXT_SEARCH}
        SELECT query_id, rank, chunk_id, round(s, 4) AS score FROM ranked WHERE rank <= 5""",
    "ivf_recall": f"""WITH {_ASKED}, {_TEXT_SEARCH}, {_CELLS}
        SELECT t.query_id, round(count(f.chunk_id) / count(*), 6) AS recall
        FROM (SELECT * FROM ranked WHERE rank <= 5) t
        LEFT JOIN (SELECT * FROM probed WHERE rank <= 5) f ON f.query_id = t.query_id AND f.chunk_id = t.chunk_id
        GROUP BY 1""",
    "requests_by_status": """SELECT CASE WHEN event_type = 'error' THEN 'error' ELSE 'success' END AS status,
        count(*) AS n FROM events GROUP BY 1""",
    "latency_histogram": f"WITH {_SECONDS} {_histogram('seconds', 'v', _LATENCY, ['event_type'])}",
    "label_ratio": """WITH r AS (
          SELECT epoch_us(time_bucket(INTERVAL '6 hours', ts)) AS start_us, 'c' || CAST(user_id % 3 AS VARCHAR) AS component, event_type FROM events),
        p AS (SELECT start_us, component, event_type, count(*) AS v FROM r GROUP BY ALL),
        w AS (SELECT start_us, component, count(*) AS v FROM r GROUP BY ALL)
        SELECT start_us, component, event_type, round(p.v / w.v, 9) AS share FROM p JOIN w USING (start_us, component)""",
    "label_error_ratio": """WITH r AS (
          SELECT epoch_us(time_bucket(INTERVAL '6 hours', ts)) AS start_us, 'c' || CAST(user_id % 3 AS VARCHAR) AS component, event_type FROM events),
        e AS (SELECT start_us, component, count(*) AS v FROM r WHERE event_type = 'error' GROUP BY ALL),
        w AS (SELECT start_us, component, count(*) AS v FROM r GROUP BY ALL)
        SELECT start_us, component, round(e.v / w.v, 9) AS ratio FROM e JOIN w USING (start_us, component)""",
    "latency_sketch": """WITH groups AS (
          SELECT event_type, NULL::VARCHAR AS day, count(value) AS n FROM events GROUP BY 1
          UNION ALL SELECT event_type, CAST(CAST(ts AS DATE) AS VARCHAR), count(value) FROM events GROUP BY 1, 2)
        SELECT event_type, day, q, n, true AS within FROM groups, (VALUES (0.5), (0.9), (0.99)) t(q) WHERE n > 0""",
    "latency_quantiles": f"""WITH {_SECONDS}, hist AS ({_histogram('seconds', 'v', _LATENCY, ['event_type'])}),
        marked AS (SELECT *, lag(le) OVER w AS low, coalesce(lag(n) OVER w, 0) AS below,
          max(n) OVER (PARTITION BY event_type) AS total_n FROM hist WINDOW w AS (PARTITION BY event_type ORDER BY le))
        SELECT a.event_type, a.v AS p50, b.v AS p95, c.v AS p99
        FROM {_quantile(0.5)} a JOIN {_quantile(0.95)} b USING (event_type) JOIN {_quantile(0.99)} c USING (event_type)""",
    "chunk_size_histogram": f"WITH {_CHUNKS} {_histogram('chunk', 'n_tokens', [64, 128, 256, 384, 512, 640])}",
    "chunks_per_page_histogram": f"""WITH {_CHUNKS}, firsts AS (SELECT * FROM chunk WHERE chunk_index = 0)
        {_histogram('firsts', 'total_chunks', [1, 2, 5, 10, 20, 50])}""",
    "timeout_batches": _timeout_batches("2 SECOND"),
    "timeout_batches_daily": _timeout_batches("1 DAY"),
    "embed_batches": f"WITH {_BATCHES} SELECT source, batch_no, n FROM batches",
    "batch_size_histogram": f"WITH {_BATCHES} {_histogram('batches', 'n', [1, 4, 8, 16, 32, 64])}",
    "counter_increase": f"""WITH {_INCREASE} SELECT event_type, epoch_us(start) AS start_us,
        epoch_us(start + INTERVAL '6 hours') AS end_us, increase FROM grown""",
    "counter_rate": f"""WITH {_INCREASE} SELECT event_type, epoch_us(start) AS start_us,
        epoch_us(start + INTERVAL '6 hours') AS end_us, round(increase / 21600.0, 9) AS rate FROM grown""",
    "counter_increase_sliding": f"""WITH {_COUNTER}, spread AS (
          SELECT *, unnest(range(6)) AS back FROM steps),
        placed AS (SELECT *, time_bucket(INTERVAL '1 hour', ts) - back * INTERVAL '1 hour' AS start FROM spread)
        SELECT event_type, epoch_us(start) AS start_us, epoch_us(start + INTERVAL '6 hours') AS end_us,
          sum(CASE WHEN pts >= start THEN step ELSE 0 END) AS increase FROM placed GROUP BY event_type, start""",
    "counter_increase_range": f"WITH {_COUNTER} SELECT event_type, coalesce(sum(step), 0) AS increase FROM steps GROUP BY 1",
    "error_ratio": """SELECT epoch_us(time_bucket(INTERVAL '6 hours', ts)) AS start_us,
        count(*) FILTER (event_type = 'error') AS errors, count(*) AS requests,
        round(count(*) FILTER (event_type = 'error') / count(*), 9) AS ratio FROM events GROUP BY 1""",
    "consumer_lag": """SELECT 'embedder' AS grp, topic, CAST(sum(greatest(0, end_offset - position)) AS BIGINT) AS lag
        FROM (SELECT event_type AS topic, user_id, count(*) AS end_offset,
          count(*) FILTER (ts < TIMESTAMP '2024-01-20 00:00:00') AS position FROM events GROUP BY 1, 2) GROUP BY 2""",
    "gauge_latest": """SELECT event_type, user_id, epoch_us(ts) AS ts_us, value FROM events
        QUALIFY row_number() OVER (PARTITION BY event_type, user_id ORDER BY ts DESC, event_id DESC) = 1""",
    "rolling_throughput": _throughput(60),
    "rolling_throughput_hour": _throughput(3600),
    "windowed_counts": """SELECT epoch_us(start) AS start_us, epoch_us(start + INTERVAL '10 minutes') AS end_us, event_type,
        count(*) AS n FROM (SELECT time_bucket(INTERVAL '10 minutes', ts) AS start, event_type FROM events)
        GROUP BY start, event_type""",
    "stalled_series": """SELECT user_id, epoch_us(time_bucket(INTERVAL '1 day', ts)) AS start_us FROM events GROUP BY 1, 2
        HAVING count(*) FILTER (event_type = 'purchase') = 0 AND count(*) FILTER (event_type = 'view') > 0""",
    "alert_states": f"""WITH {_ALERTS} SELECT user_id, epoch_us(ts) AS ts_us, active,
        CASE WHEN active THEN epoch_us(since) ELSE -1 END AS active_since_us,
        CASE WHEN NOT active THEN 'inactive' WHEN ts - since >= INTERVAL '1 day' THEN 'firing' ELSE 'pending' END AS state
        FROM islands""",
    "gauge_alerts": f"""WITH {_GAUGES} SELECT 'ValueHigh' AS alertname, series, slot * 600000000 AS ts_us,
        CASE WHEN active THEN since * 600000000 ELSE -1 END AS active_since_us,
        CASE WHEN NOT active THEN 'inactive' WHEN slot - since >= 3 THEN 'firing' ELSE 'pending' END AS state FROM islands""",
    "stream_closed_windows": """SELECT epoch_us(start) AS start_us, epoch_us(start + INTERVAL '1 day') AS end_us, event_type,
        count(*) AS n FROM (SELECT time_bucket(INTERVAL '1 day', ts) AS start, event_type FROM events)
        WHERE start + INTERVAL '1 day' <= (SELECT date_trunc('millisecond', max(ts)) - INTERVAL '24 hours' FROM events)
        GROUP BY start, event_type""",
    "stream_recrawl": f"""WITH {_PAGES},
        first AS (SELECT url, content_hash FROM extracted WHERE text <> ''),
        swapped AS (
          SELECT p.url, coalesce(q.content_hash, p.content_hash) AS content_hash, coalesce(q.text, p.text) AS text
          FROM extracted p LEFT JOIN extracted q ON q.page_id = xor(p.page_id, 1) AND p.page_id % 4 < 2)
        SELECT url, content_hash, CAST(1 AS BIGINT) AS crawl FROM first
        UNION ALL
        SELECT s.url, s.content_hash, CAST(2 AS BIGINT) FROM swapped s LEFT JOIN first f USING (url)
        WHERE s.text <> '' AND s.content_hash IS DISTINCT FROM f.content_hash""",
    "stream_page_chunks": f"""WITH {_PAGE_CHUNKS} SELECT chunk_id, url, title, chunk_index, total_chunks, text,
        content_hash, created_at FROM chunk""",
}
