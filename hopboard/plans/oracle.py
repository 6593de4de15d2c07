"""SQL with the same results as the queries of the catalog, for an independent engine.

Written against plain columns: the JSON round trip of the Spark queries must not change a value.
"""

from __future__ import annotations

# The standard instant in epoch milliseconds, bucket width and live bucket ids.
_AS_OF_MS = 1705754096000
_WIDTH_MS = 21600000
_CURRENT = f"({_AS_OF_MS} // {_WIDTH_MS})"
_OLDEST = f"({_CURRENT} - 27)"
# Three standard errors of a sketch of 2**14 registers.
_ERROR = "CAST(3 * 1.04 / 128 AS DOUBLE)"
_SPACE = r"[\t\n\v\f\r \x{85}\x{A0}\p{Z}]"


def _normalized(text: str) -> str:
    trimmed = f"regexp_replace({text}, '^{_SPACE}+|{_SPACE}+$', '', 'g')"
    lowered = f"lower({trimmed})"
    collapsed = (
        f"CASE WHEN regexp_matches({lowered}, '[ \\t\\n\\r\\v\\f]') "
        f"THEN regexp_replace({lowered}, '{_SPACE}+', ' ', 'g') ELSE {lowered} END"
    )
    return f"CASE WHEN ({collapsed}) <> '' AND length({collapsed}) <= 256 THEN {collapsed} END"


def _reason(well_formed: str) -> str:
    return (
        f"CASE WHEN NOT {well_formed} THEN 'malformed json' WHEN coalesce(query, '') = '' THEN 'empty query' "
        "WHEN coalesce(source, '') = '' THEN 'missing source' "
        "WHEN coalesce(ts_ms, 0) <= 0 THEN 'missing or invalid ts_ms' END"
    )


_SEARCH = """
search AS (
  SELECT event_id AS id, ts, value AS weight, event_type AS kind, CAST(event_id AS VARCHAR) AS event_id,
    CASE WHEN event_id % 19 = 0 THEN '   '
         WHEN event_id % 23 = 0 THEN ''
         WHEN event_id % 29 = 0 THEN repeat('я', 257)
         WHEN event_id % 7 = 0 THEN '  ' || upper(event_type) || chr(9) || ' ' || k || ' '
         WHEN event_id % 11 = 0 THEN upper(event_type) || '  ' || k
         ELSE event_type || ' ' || k END AS query,
    CASE WHEN event_id % 31 = 0 THEN '' ELSE 'user-' || CAST(user_id AS VARCHAR) END AS source,
    CASE WHEN event_id % 37 = 0 THEN 0 ELSE epoch_us(ts) // 1000 END AS ts_ms,
    event_id % 41 <> 0 AS well_formed
  FROM (SELECT *, CAST(CAST(json_extract_string(props, '$.k') AS INTEGER) % 20 AS VARCHAR) AS k FROM events)
)"""

_CLASSIFIED = f"""{_SEARCH},
judged AS (SELECT *, {_reason('well_formed')} AS reason, {_normalized('query')} AS norm FROM search),
classified AS (
  SELECT *, ts_ms // {_WIDTH_MS} AS bucket_id,
    CASE WHEN reason IS NOT NULL THEN 'invalid' WHEN norm IS NULL THEN 'norm_dropped'
         WHEN ts_ms // {_WIDTH_MS} BETWEEN {_OLDEST} AND {_CURRENT} THEN 'consumed'
         ELSE 'out_of_window' END AS outcome
  FROM judged
),
history AS (SELECT bucket_id, norm AS query, source FROM classified WHERE reason IS NULL AND norm IS NOT NULL),
consumed AS (SELECT bucket_id, norm AS query, source FROM classified WHERE outcome = 'consumed')"""

_RANK = "CAST(row_number() OVER (ORDER BY count DESC, query) AS INTEGER) AS rank, query, count"

_TOP = f"""{_CLASSIFIED},
counts AS (SELECT query, count(DISTINCT source) AS count FROM consumed GROUP BY query),
top AS (SELECT {_RANK} FROM counts QUALIFY rank <= 20)"""

_NAMED = f"""{_CLASSIFIED},
parts AS (
  SELECT DISTINCT query, split_part(query, ' ', 1) AS kind, CAST(split_part(query, ' ', 2) AS INTEGER) AS k FROM history
),
names AS (
  SELECT query, kind || ' ' || CAST(CASE kind WHEN 'view' THEN k - 1 WHEN 'error' THEN (k + 1) % 20 ELSE k // 10 * 10 END AS VARCHAR) AS canonical
  FROM parts WHERE kind = 'view' AND k > 0 OR kind = 'error' OR kind = 'click' AND k % 10 <> 0
),
reach AS (
  SELECT query, canonical FROM names
  UNION SELECT reach.query, names.canonical FROM reach JOIN names ON names.query = reach.canonical
),
ends AS (SELECT query, canonical FROM reach WHERE canonical NOT IN (SELECT query FROM names))"""

_STORED = f"""{_SEARCH},
stored AS (SELECT query AS word, min(ts) AS created_at FROM search WHERE kind = 'error' GROUP BY query),
active AS (SELECT DISTINCT norm AS word FROM (SELECT {_normalized('word')} AS norm FROM stored) WHERE norm IS NOT NULL),
given AS (SELECT DISTINCT norm AS word FROM (
  SELECT {_normalized('query')} AS norm FROM search WHERE weight >= 20) WHERE norm IS NOT NULL)"""

_STATUSES = f"""{_STORED},
log AS (
  SELECT id AS seq, CASE WHEN weight >= 20 THEN 'remove' ELSE 'add' END AS op, query AS word,
    {_normalized('query')} AS norm_word, ts AS changed_at
  FROM search
),
folded AS (
  SELECT *, coalesce(lag(op = 'add') OVER (PARTITION BY norm_word ORDER BY seq),
                     norm_word IN (SELECT word FROM stored)) AS present_before
  FROM log
),
statuses AS (
  SELECT seq, op, word, norm_word, changed_at,
    CASE WHEN norm_word IS NULL THEN 'invalid' WHEN op = 'remove' THEN 'removed'
         WHEN present_before THEN 'conflict' ELSE 'added' END AS status
  FROM folded
)"""

_ODD = f"""{_SEARCH},
odd AS (
  SELECT id, id % 21 AS oddity, kind, 'user-' || CAST(id AS VARCHAR) AS user_name, ts_ms FROM search
),
decoded AS (
  SELECT id,
    oddity NOT IN (1, 5, 6, 7, 8, 9, 10, 12) AS well_formed,
    CASE WHEN oddity = 2 THEN 'later' WHEN oddity IN (0, 3, 4, 11, 13, 15, 16, 17, 18, 19, 20) THEN kind END AS query,
    CASE WHEN oddity = 13 THEN 'user' || chr(9) || CAST(id AS VARCHAR)
         WHEN oddity = 18 THEN chr(65533) || 'x' || chr(65533) || chr(128512) || '-' || CAST(id AS VARCHAR)
         WHEN oddity = 20 THEN 'u' || chr(65533) || chr(65533) || 'b' || CAST(id AS VARCHAR)
         WHEN oddity = 19 THEN chr(92) || 'ud800-' || CAST(id AS VARCHAR)
         WHEN oddity IN (0, 2, 3, 4, 11, 15, 16, 17) THEN user_name END AS source,
    CASE WHEN oddity IN (0, 2, 3, 4, 11, 13, 15, 16, 17, 18, 19, 20) THEN ts_ms END AS ts_ms,
    CAST(NULL AS VARCHAR) AS event_id
  FROM odd
)"""

ORACLE_SQL: dict[str, str] = {
    "raw_events": f"""WITH {_SEARCH}
SELECT id, epoch_us(ts) // 1000 AS arrival_ms,
  CASE WHEN well_formed
       THEN CAST(to_json({{'query': query, 'source': source, 'ts_ms': ts_ms, 'event_id': event_id}}) AS VARCHAR)
       ELSE '{{bad' END AS value
FROM search""",
    "decode_outcomes": f"""WITH {_SEARCH}
SELECT coalesce({_reason('well_formed')}, 'valid') AS reason, count(*) AS rows FROM search GROUP BY 1""",
    "decode_strictness": f"""WITH {_ODD}
SELECT id, query, source, ts_ms, event_id, {_reason('well_formed')} AS reason FROM decoded""",
    "normalize_query": f"""WITH {_SEARCH},
texts AS (
  SELECT 'documents' AS origin, doc_id AS id, CAST(0 AS BIGINT) AS part, text FROM documents
  UNION ALL SELECT 'conversations', conv_id, turn, text FROM conversations
  UNION ALL SELECT 'events', id, 0, query FROM search
),
done AS (SELECT origin, id, part, {_normalized('text')} AS query FROM texts)
SELECT origin, id, part, query, query IS NOT NULL AS kept FROM done""",
    "ingest_outcomes": f"""WITH {_CLASSIFIED}
SELECT count(*) AS messages,
  count(*) FILTER (outcome = 'consumed') AS consumed,
  count(*) FILTER (outcome <> 'invalid') AS decoded,
  count(*) FILTER (outcome = 'invalid') AS invalid,
  count(*) FILTER (outcome = 'norm_dropped') AS norm_dropped,
  count(*) FILTER (outcome = 'out_of_window') AS out_of_window
FROM classified""",
    "quarantine": f"""WITH {_CLASSIFIED}
SELECT id,
  CASE WHEN well_formed
       THEN CAST(to_json({{'query': query, 'source': source, 'ts_ms': ts_ms, 'event_id': event_id}}) AS VARCHAR)
       ELSE '{{bad' END AS value,
  outcome, reason AS reject_reason
FROM classified WHERE outcome <> 'consumed'""",
    "late_future_outcomes": f"""WITH {_CLASSIFIED},
arriving AS (
  SELECT *, CASE id % 6 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 12 WHEN 3 THEN 240 WHEN 4 THEN -12 ELSE 2500000 END AS lag_hours
  FROM classified
),
clocked AS (SELECT *, (epoch_us(ts) // 1000 + CAST(lag_hours AS BIGINT) * 3600000) // {_WIDTH_MS} AS current_id FROM arriving)
SELECT CAST(lag_hours AS INTEGER) AS lag_hours,
  CASE WHEN reason IS NOT NULL THEN 'invalid' WHEN norm IS NULL THEN 'norm_dropped'
       WHEN bucket_id BETWEEN current_id - 27 AND current_id THEN 'consumed' ELSE 'out_of_window' END AS outcome,
  count(*) AS rows
FROM clocked GROUP BY ALL""",
    "bucket_counts": f"""WITH {_CLASSIFIED}
SELECT bucket_id, query, count(DISTINCT source) AS count FROM history GROUP BY bucket_id, query""",
    "bucket_counts_approx": f"""WITH {_CLASSIFIED}
SELECT bucket_id, query, count(DISTINCT source) AS count, TRUE AS within_tolerance FROM history GROUP BY bucket_id, query""",
    "top_approx": f"""WITH {_CLASSIFIED}
SELECT query, count(DISTINCT source) AS count, TRUE AS within_tolerance FROM consumed GROUP BY query""",
    "top_approx_direct": f"""WITH {_CLASSIFIED}
SELECT query, count(DISTINCT source) AS count, TRUE AS within_tolerance FROM consumed GROUP BY query""",
    "top_exact": f"WITH {_TOP} SELECT * FROM top",
    "top_from_messages": f"WITH {_TOP} SELECT * FROM top",
    "sketch_accuracy": f"""WITH {_CLASSIFIED}
SELECT query, count(DISTINCT source) AS count, TRUE AS within_tolerance FROM history GROUP BY query""",
    "top_stoplist": f"""WITH {_CLASSIFIED},
active AS (SELECT {_normalized('query')} AS word FROM search WHERE kind = 'error'),
counts AS (
  SELECT query, count(DISTINCT source) AS count FROM consumed
  WHERE query NOT IN (SELECT word FROM active WHERE word IS NOT NULL) GROUP BY query
)
SELECT {_RANK} FROM counts QUALIFY rank <= 20""",
    "top_prefix": f"WITH {_TOP} SELECT * FROM top WHERE rank <= 5",
    "top_json": f"""WITH {_TOP}
SELECT CAST(to_json({{
  'data': list({{'query': query, 'count': count}} ORDER BY rank),
  'timestamp': {_AS_OF_MS} // 1000, 'window_sec': 604800}}) AS VARCHAR) AS document
FROM top WHERE rank <= 10""",
    "hopping_top": f"""WITH {_CLASSIFIED},
ticks AS (SELECT unnest(range(min(bucket_id), max(bucket_id) + 1)) AS tick FROM history),
live AS (
  SELECT tick, query, count(DISTINCT source) AS count
  FROM ticks JOIN history ON bucket_id BETWEEN tick - 27 AND tick GROUP BY tick, query
)
SELECT tick, CAST(row_number() OVER (PARTITION BY tick ORDER BY count DESC, query) AS INTEGER) AS rank, query, count
FROM live QUALIFY rank <= 5""",
    "hopping_top_approx": f"""WITH {_CLASSIFIED},
ticks AS (SELECT unnest(range(min(bucket_id), max(bucket_id) + 1)) AS tick FROM history)
SELECT tick, query, count(DISTINCT source) AS count, TRUE AS within_tolerance
FROM ticks JOIN history ON bucket_id BETWEEN tick - 27 AND tick GROUP BY tick, query""",
    "top_bounded": f"WITH {_TOP} SELECT * FROM top",
    "top_certain": f"""WITH {_CLASSIFIED},
counts AS (SELECT query, count(DISTINCT source) AS count FROM consumed GROUP BY query),
places AS (SELECT {_RANK}, CAST(ceil(count / (1 + {_ERROR})) AS BIGINT) AS low, CAST(floor(count / (1 - {_ERROR})) AS BIGINT) AS high FROM counts)
SELECT rank, query, count, low, high,
  low > coalesce((SELECT max(high) FROM places WHERE rank = 21), 0) AS in_top,
  low > coalesce((SELECT max(high) FROM places AS next WHERE next.rank = places.rank + 1), 0)
    AND high < coalesce((SELECT min(low) FROM places AS last WHERE last.rank = places.rank - 1), 9223372036854775807) AS at_rank,
  TRUE AS enclosed
FROM places WHERE rank <= 20""",
    "canonical_names": f"""WITH RECURSIVE {_NAMED}
SELECT query, coalesce(ends.canonical, query) AS canonical, ends.canonical IS NULL AS cyclic
FROM names LEFT JOIN ends USING (query)""",
    "top_canonical": f"""WITH RECURSIVE {_NAMED},
counts AS (
  SELECT coalesce(ends.canonical, consumed.query) AS query, count(DISTINCT source) AS count
  FROM consumed LEFT JOIN ends ON ends.query = consumed.query GROUP BY 1
)
SELECT {_RANK} FROM counts QUALIFY rank <= 20""",
    "expired_buckets": f"""WITH {_CLASSIFIED}
SELECT bucket_id, count(DISTINCT query) AS queries FROM history WHERE bucket_id < {_OLDEST} GROUP BY bucket_id""",
    "stoplist_clean": f"WITH {_STORED} SELECT word FROM active",
    "stoplist_list": f"WITH {_STORED} SELECT word FROM stored ORDER BY word",
    "stoplist_insert": f"""WITH {_STORED}
SELECT word, 'stored' AS status FROM stored
UNION ALL SELECT word, 'added' FROM given WHERE word NOT IN (SELECT word FROM stored)
UNION ALL SELECT word, 'conflict' FROM given WHERE word IN (SELECT word FROM stored)""",
    "stoplist_delete": f"""WITH {_STORED}
SELECT word FROM stored WHERE word NOT IN (SELECT word FROM given)""",
    "stoplist_apply": f"""WITH {_STATUSES}
SELECT seq, op, word, norm_word, status,
  CASE WHEN op = 'add' THEN coalesce(norm_word, word) ELSE word END AS echo
FROM statuses""",
    "stoplist_final": f"""WITH {_STATUSES},
last AS (
  SELECT norm_word AS word, arg_max(op, seq) AS op, arg_max(changed_at, seq) FILTER (status = 'added') AS added_at
  FROM statuses WHERE status <> 'invalid' GROUP BY norm_word
)
SELECT coalesce(s.word, l.word) AS word, epoch_us(coalesce(l.added_at, s.created_at)) // 1000 AS created_ms
FROM stored s FULL JOIN last l ON s.word = l.word WHERE coalesce(l.op, 'add') = 'add'""",
    "stoplist_stored": f"""WITH {_STATUSES},
last AS (SELECT norm_word AS word, arg_max(op, seq) AS op FROM statuses WHERE status <> 'invalid' GROUP BY norm_word)
SELECT coalesce(s.word, l.word) AS word
FROM stored s FULL JOIN last l ON s.word = l.word WHERE coalesce(l.op, 'add') = 'add'""",
    "pipeline_gauges": f"""WITH {_TOP},
active AS (SELECT DISTINCT norm AS word FROM (
  SELECT {_normalized('query')} AS norm FROM search WHERE kind = 'error') WHERE norm IS NOT NULL)
SELECT 'snapshot_size' AS gauge, count(*) AS value FROM top
UNION ALL SELECT 'stoplist_words', count(*) FROM active""",
    "bot_flood": f"""WITH {_CLASSIFIED},
flooded AS (
  SELECT query, source FROM consumed
  UNION ALL SELECT 'накрутка', 'bot-account' FROM events
  WHERE epoch_us(ts) // 1000 // {_WIDTH_MS} BETWEEN {_OLDEST} AND {_CURRENT}
),
counts AS (SELECT query, count(DISTINCT source) AS count FROM flooded GROUP BY query)
SELECT {_RANK} FROM counts QUALIFY rank <= 1000""",
    "replay_idempotent": f"WITH {_TOP} SELECT * FROM top",
    "event_roundtrip": f"""WITH {_SEARCH}
SELECT query, source, ts_ms, event_id, TRUE AS well_formed FROM search WHERE {_reason('TRUE')} IS NULL""",
    "stream_top": f"WITH {_TOP} SELECT * FROM top",
    "stateful_top": f"WITH {_TOP} SELECT * FROM top",
    "scripted_source": f"WITH {_TOP} SELECT *, (SELECT count(*) FROM events) AS committed FROM top",
    "stream_counters": f"""WITH {_CLASSIFIED}
SELECT count(*) AS messages,
  count(*) FILTER (outcome = 'consumed') AS consumed,
  count(*) FILTER (outcome <> 'invalid') AS decoded,
  count(*) FILTER (outcome = 'invalid') AS invalid,
  count(*) FILTER (outcome = 'norm_dropped') AS norm_dropped,
  count(*) FILTER (outcome = 'out_of_window') AS out_of_window,
  TRUE AS decoded_adds_up, TRUE AS messages_add_up
FROM classified""",
    "generated_events": """WITH size AS (SELECT count(*) AS n, count(DISTINCT user_id) AS users FROM events)
SELECT 'fixed' AS mode, 'слайм' AS query, n AS rows, least(n, users) AS sources FROM size
UNION ALL SELECT 'flood', 'накрутка', n, 1 FROM size
UNION ALL SELECT 'flood', 'ordinary', n // 5, NULL FROM size""",
}
