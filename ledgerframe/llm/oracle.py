"""DuckDB SQL for the operators that SQL can express."""

LINE_DEDUP = r"""
WITH parts AS (
  SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line,
         generate_subscripts(string_split(text, chr(10)), 1) - 1 AS raw
  FROM documents WHERE text IS NOT NULL
), counted AS (
  SELECT doc_id, raw, line, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS words FROM parts
), seq AS (
  SELECT doc_id, raw, line, words,
         row_number() OVER (PARTITION BY doc_id ORDER BY raw) - 1 AS n,
         sum(words) OVER (PARTITION BY doc_id ORDER BY raw) AS stop
  FROM counted WHERE words > 0
), ranges AS (
  SELECT a.doc_id, a.n AS s, min(b.n) AS e
  FROM seq a JOIN seq b ON a.doc_id = b.doc_id AND b.n >= a.n AND b.stop >= a.stop - a.words + 50
  GROUP BY ALL
  UNION
  SELECT b.doc_id, max(a.n), b.n
  FROM seq b JOIN seq a ON a.doc_id = b.doc_id AND a.n <= b.n AND a.stop - a.words <= b.stop - 50
  GROUP BY b.doc_id, b.n
), runs AS (
  SELECT r.doc_id, r.s, r.e, string_agg(q.line, chr(10) ORDER BY q.n) AS body
  FROM ranges r JOIN seq q ON q.doc_id = r.doc_id AND q.n BETWEEN r.s AND r.e
  GROUP BY ALL
), later AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY body ORDER BY doc_id, s) AS copy FROM runs) WHERE copy > 1
), gone AS (
  SELECT DISTINCT p.doc_id, p.raw FROM seq p JOIN later l ON p.doc_id = l.doc_id AND p.n BETWEEN l.s AND l.e
), kept AS (
  SELECT p.doc_id, string_agg(p.line, chr(10) ORDER BY p.raw) AS body
  FROM parts p ANTI JOIN gone g ON p.doc_id = g.doc_id AND p.raw = g.raw
  GROUP BY ALL
), lost AS (SELECT doc_id, count(*) AS lines FROM gone GROUP BY ALL), result AS (
  SELECT d.doc_id, coalesce(l.lines, 0)::BIGINT AS n_removed_lines,
         CASE WHEN l.lines IS NULL THEN d.text
              WHEN regexp_matches(coalesce(k.body, ''), '[^\x20\x09-\x0D]') THEN k.body ELSE '' END AS kept
  FROM documents d LEFT JOIN lost l ON d.doc_id = l.doc_id LEFT JOIN kept k ON d.doc_id = k.doc_id
)
SELECT doc_id, n_removed_lines, length(kept)::BIGINT AS n_kept_chars, sha256(kept) AS kept_sha256 FROM result
"""

MIXING = r"""
WITH sized AS (
  SELECT doc_id, text, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents
), sums AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS place FROM sized GROUP BY source
), weighed AS (
  SELECT *, [5, 2, 1][((place - 1) % 3 + 1)::INT] AS weight, 1.5::DOUBLE * sum(source_size) OVER () AS budget FROM sums
), water AS (  -- the level at which capped and uncapped targets spend the budget, tried at every cap
  SELECT max(level) AS level FROM (
    SELECT (any_value(w.budget) - coalesce(sum(2 * v.source_size) FILTER (WHERE 2.0 * v.source_size / v.weight < 2.0 * w.source_size / w.weight), 0))
           / sum(v.weight) FILTER (WHERE 2.0 * v.source_size / v.weight >= 2.0 * w.source_size / w.weight) AS level
    FROM weighed w CROSS JOIN weighed v GROUP BY w.source, w.source_size, w.weight)
), targets AS (
  SELECT source, source_size, CASE WHEN source_size = 0 THEN 0.0 ELSE least(2.0 * source_size, level * weight) END AS target
  FROM weighed, water
), rated AS (
  SELECT s.*, t.source_size, t.target, CASE WHEN t.source_size = 0 THEN 0.0 ELSE t.target / t.source_size END AS rate,
         md5('mix-1' || chr(31) || coalesce(s.doc_id::VARCHAR, chr(0)) || chr(31) || md5(coalesce(s.text, ''))) AS own,
         count(*) OVER (PARTITION BY s.source) AS docs
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
), dealt AS (
  SELECT *, ('0x' || own[25:32])::BIGINT % ceil(docs / 10000.0)::BIGINT AS part FROM rated
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY source, part ORDER BY size, own) AS place, rate - floor(rate) AS fraction,
         CAST('0x' || substr(md5('mix-1' || chr(31) || coalesce(source, chr(0)) || chr(31) || part::VARCHAR), 1, 13) AS BIGINT) / 4503599627370496.0 AS u
  FROM dealt
)
SELECT doc_id, size, source_size, target,
       (size * (floor(rate) + floor(place * fraction + u) - floor((place - 1) * fraction + u)))::BIGINT AS taken
FROM placed
"""

FILL_IN_MIDDLE = r"""
WITH drawn AS (
  SELECT doc_id, coalesce(text, '') AS body, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS units,
         sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS h
  FROM documents
), ranks AS (
  SELECT doc_id, body, units, len(units)::BIGINT AS n, ('0x' || h[1:8])::BIGINT % (len(units) + 1) AS r1,
         ('0x' || h[9:16])::BIGINT % (len(units) + 1) AS r2, ('0x' || h[25:32])::BIGINT % 100 < 50 AS suffix_first,
         body = '' OR contains(body, '<P>') OR contains(body, '<S>') OR contains(body, '<M>') AS plain
  FROM drawn
), parts AS (
  SELECT *, array_to_string(units[1:least(r1, r2)], '') AS p, array_to_string(units[least(r1, r2) + 1:greatest(r1, r2)], '') AS m,
         array_to_string(units[greatest(r1, r2) + 1:], '') AS s
  FROM ranks
)
SELECT doc_id, n, CASE WHEN plain THEN 'plain' WHEN suffix_first THEN 'spm' ELSE 'psm' END AS form,
       CASE WHEN NOT plain THEN length(p)::BIGINT END AS prefix_chars, CASE WHEN NOT plain THEN length(m)::BIGINT END AS middle_chars,
       sha256(CASE WHEN plain THEN body WHEN suffix_first THEN '<S>' || s || '<P>' || p || '<M>' || m
                   ELSE '<P>' || p || '<S>' || s || '<M>' || m END) AS output_sha256,
       sha256(body) AS restored_sha256
FROM parts
"""

WARC = r"""
WITH stored AS (
  SELECT page_id, coalesce(html, '') AS payload FROM pages
), measured AS (
  SELECT page_id, strlen(payload)::BIGINT AS payload_bytes, sha1(payload) AS payload_digest,
         max(page_id) OVER (PARTITION BY payload) AS newest,
         row_number() OVER (PARTITION BY payload ORDER BY page_id DESC NULLS LAST) AS place
  FROM stored
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 1000 AND place > 1 THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND place > 1 THEN newest END AS refers_to
FROM measured
"""

RANKED_SEARCH = r"""
WITH words AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                           '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM documents
), lengths AS (SELECT doc_id, count(*)::BIGINT AS n FROM words GROUP BY doc_id
), corpus AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS terms FROM lengths
), wanted AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                     '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark
), postings AS (
  SELECT doc_id, term, count(*)::BIGINT AS tf FROM words WHERE term IN (SELECT term FROM wanted) GROUP BY ALL
), weights AS (
  SELECT term, floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM postings, corpus GROUP BY term
), scores AS (
  SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * docs) // terms))))::BIGINT AS score
  FROM wanted JOIN postings USING (term) JOIN weights USING (term) JOIN lengths USING (doc_id), corpus GROUP BY ALL
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank FROM scores WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM placed WHERE rank <= 10
"""

ORACLE = {"op2_line_dedup": LINE_DEDUP, "op7_mixing": MIXING, "op11_ranked_search": RANKED_SEARCH, "op12_warc": WARC, "op13_fill_in_middle": FILL_IN_MIDDLE}
