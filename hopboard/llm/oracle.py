"""SQL for DuckDB with the results of the queries that SQL can express."""

_AZ = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_BLANK = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

OP1 = f"""
WITH lines AS (
  SELECT doc_id, pos, line, {_AZ.format(f"trim(line, {_BLANK})")} AS key
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
               generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents)
),
frequent AS (SELECT key FROM lines WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*) AS n_lines, count(f.key) AS n_dropped,
       sha256(coalesce(string_agg(CASE WHEN f.key IS NULL THEN line END, chr(10) ORDER BY pos), '')) AS kept_sha256
FROM lines LEFT JOIN frequent f USING (key) GROUP BY doc_id
"""

OP2 = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS digest FROM pages),
latest AS (SELECT digest, max(page_id) AS latest FROM p WHERE n >= 1000 GROUP BY digest)
SELECT page_id, n AS payload_bytes, digest AS payload_digest,
       CASE WHEN coalesce(latest, page_id) = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN coalesce(latest, page_id) <> page_id THEN latest END AS refers_to
FROM p LEFT JOIN latest USING (digest)
"""

OP6 = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0
    AND len(list_filter(embedding, lambda e: e <> 0)) > 0
),
pairs AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.x) = len(b.x)
  WHERE list_cosine_similarity(a.x, b.x) >= 0.98
),
reach AS (SELECT a, b FROM pairs UNION SELECT r.a, p.b FROM reach r JOIN pairs p ON r.b = p.a),
smallest AS (SELECT a, min(b) AS b FROM reach GROUP BY a),
linked AS (SELECT a, count(*) AS n FROM pairs GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, least(vec_id, coalesce(s.b, vec_id)) AS component_id,
       vec_id = least(vec_id, coalesce(s.b, vec_id)) AS kept
FROM embeddings LEFT JOIN smallest s ON s.a = vec_id LEFT JOIN linked l ON l.a = vec_id
"""

OP7 = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array({_AZ.format("coalesce(text, '')")}, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words FROM documents
),
s AS (
  SELECT doc_id, unnest(list_distinct(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 3 THEN [list_aggregate(words, 'string_agg', ' ')]
    ELSE list_transform(range(1, len(words) - 1), lambda i: words[i] || ' ' || words[i + 1] || ' ' || words[i + 2]) END)) AS shingle
  FROM w
),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY 1, 2
),
pairs AS (
  SELECT a, b FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared.n >= 85 * (x.n + y.n - shared.n)
),
reach AS (SELECT a, b FROM pairs UNION SELECT r.a, p.b FROM reach r JOIN pairs p ON r.b = p.a),
smallest AS (SELECT a, min(b) AS b FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(s.b, d.doc_id)) AS component_id,
       d.doc_id = least(d.doc_id, coalesce(s.b, d.doc_id)) AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN smallest s ON s.a = d.doc_id
"""

_WORDS9 = f"""list_filter(regexp_split_to_array({_AZ.format("coalesce(text, '')")}, '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"""

OP9 = f"""
WITH items AS (SELECT item_id, {_WORDS9} AS words FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, least(len(words), 10) AS n,
         unnest(list_transform(range(1, greatest(len(words) - 10, 0) + 2), lambda i: array_to_string(words[i:i + least(len(words), 10) - 1], ' '))) AS string
  FROM items WHERE len(words) > 0
),
docs AS (SELECT doc_id, {_WORDS9} AS words FROM documents),
runs AS (
  SELECT doc_id, n, i, array_to_string(words[i:i + n - 1], ' ') AS string
  FROM (SELECT doc_id, words, n, unnest(range(1, len(words) - n + 2)) AS i
        FROM docs, (SELECT DISTINCT n FROM windows) WHERE len(words) >= n)
),
found AS (SELECT doc_id, n, i, item_id FROM runs JOIN windows USING (n, string)),
hits AS (SELECT doc_id, count(DISTINCT w) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS w FROM found) GROUP BY doc_id),
listed AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM found) GROUP BY doc_id
)
SELECT d.doc_id, len(d.words) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs d LEFT JOIN hits USING (doc_id) LEFT JOIN listed USING (doc_id)
"""

_RUNS12 = """words || CASE WHEN len(words) > 1
  THEN list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1]) ELSE [] END"""

OP12 = f"""
WITH RECURSIVE steps AS (
  SELECT i AS byte, i AS crc, 0 AS bit FROM range(256) t(i)
  UNION ALL SELECT byte, CASE WHEN crc & 1 = 1 THEN xor(crc >> 1, 3988292384) ELSE crc >> 1 END, bit + 1 FROM steps WHERE bit < 8
),
crc_table AS (SELECT list(crc ORDER BY byte) AS entries FROM steps WHERE bit = 8),
d AS (SELECT doc_id, {_WORDS9} AS words FROM documents),
b AS (SELECT {_WORDS9} AS words FROM benchmark),
df AS (SELECT doc_id, unnest({_RUNS12}) AS feature FROM d),
bf AS (SELECT unnest({_RUNS12}) AS feature FROM b),
dn AS (SELECT doc_id, feature, count(*) AS n FROM df GROUP BY ALL),
bn AS (SELECT feature, count(*) AS n FROM bf GROUP BY ALL),
named AS (SELECT feature, hex(encode(feature)) AS code FROM (SELECT feature FROM dn UNION SELECT feature FROM bn)),
hashed AS (
  SELECT feature, xor(list_reduce(list_prepend(4294967295, list_transform(range(1, len(code), 2), lambda i: ('0x' || code[i:i + 1])::BIGINT)),
    lambda crc, byte: xor(crc >> 8, entries[xor(crc & 255, byte) + 1])), 4294967295) % 10000 AS bucket
  FROM named, crc_table
),
s AS (SELECT bucket, sum(n) AS n FROM dn JOIN hashed USING (feature) GROUP BY bucket),
t AS (SELECT bucket, sum(n) AS n FROM bn JOIN hashed USING (feature) GROUP BY bucket),
gains AS (
  SELECT s.bucket, floor(1000 * ln(((coalesce(t.n, 0) + 1) * ((SELECT sum(n) FROM s) + 10000))::DOUBLE
    / ((s.n + 1) * (coalesce((SELECT sum(n) FROM t), 0) + 10000))::DOUBLE))::BIGINT AS gain
  FROM s LEFT JOIN t USING (bucket)
),
weights AS (
  SELECT doc_id, sum(n) AS n_features, sum(n * gain) AS total
  FROM dn JOIN hashed USING (feature) JOIN gains USING (bucket) GROUP BY doc_id
),
scored AS (
  SELECT doc_id, len(words) AS n_words, coalesce(n_features, 0)::BIGINT AS n_features,
    coalesce(floor(total::DOUBLE / n_features), 0)::BIGINT AS weight,
    coalesce(floor(total::DOUBLE / n_features), 0)::BIGINT
      + floor(-1000 * ln(-ln((('0x' || sha256('7:' || doc_id)[1:8])::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
  FROM d LEFT JOIN weights USING (doc_id)
),
placed AS (
  SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, 25 * count(*) OVER () // 100 AS wanted
  FROM scored WHERE n_words >= 20
)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= wanted THEN rank END AS rank FROM scored LEFT JOIN placed USING (doc_id)
"""

ORACLE_SQL = {
    "op1_line_dedup": OP1,
    "op2_warc": OP2,
    "op6_embedding_dedup": OP6,
    "op7_minhash_dedup": OP7,
    "op9_decontamination": OP9,
    "op12_importance": OP12,
}
