"""The same results in SQL, for the operators that SQL can express."""

from trawl.llm.mixing import HEX

RUN = r"[\x20\x09-\x0D]+"

# The base kinds of secrets
ASSIGN = (
    r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]"""
    r"""|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
)

WORDS = "[A-Za-z\u00C0-\u00FF]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

ORACLES = {
    "op11_spelling_variants": rf"""
WITH RECURSIVE shifts AS (  -- the table of crc32, eight shifts of each byte
  SELECT b, 0 AS k, b::BIGINT AS c FROM range(256) r(b)
  UNION ALL
  SELECT b, k + 1, xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END) FROM shifts WHERE k < 8),
crc AS (SELECT list(c ORDER BY b) AS t FROM shifts WHERE k = 8),
runs AS (
  SELECT doc_id, translate(unnest(regexp_extract_all(coalesce(text, ''), '{WORDS}')), '{UPPER}', '{LOWER}') AS run FROM documents),
counted AS (SELECT doc_id, run, count(*) AS n FROM runs WHERE length(run) >= 7 GROUP BY ALL),
steps AS (
  SELECT doc_id, run, n, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)) AS bytes, 0 AS i, 4294967295 AS c FROM counted
  UNION ALL
  SELECT doc_id, run, n, bytes, i + 1,
         xor(c >> 8, t[(xor(c, ('0x' || bytes[2 * i + 1:2 * i + 2])::BIGINT) & 255) + 1])
  FROM steps, crc WHERE 2 * i < length(bytes)),
hashed AS (SELECT run, n, xor(c, 4294967295) AS h FROM steps WHERE 2 * i = length(bytes)),
words AS (
  SELECT CASE WHEN h % 31 = 0 THEN run[1:h % length(run)] || run[h % length(run) + 2:] ELSE run END AS word, sum(n)::BIGINT AS n
  FROM hashed GROUP BY 1 HAVING length(word) >= 7 AND sum(n) >= 2),
holes AS (
  SELECT word, k, word[1:k] || word[k + 2:] AS hole FROM words, range(length(word)) r(k)),
pairs AS (
  SELECT x.word, y.word AS other FROM holes x JOIN holes y ON x.hole = y.hole AND x.k = y.k AND x.word <> y.word
  UNION SELECT word, hole FROM holes JOIN (SELECT word AS hole FROM words) USING (hole)
  UNION SELECT hole, word FROM holes JOIN (SELECT word AS hole FROM words) USING (hole)),
near AS (
  SELECT p.word, count(*) AS n_near, min(struct_pack(less := -w.n, other := p.other)) AS best
  FROM pairs p JOIN words w ON w.word = p.other GROUP BY p.word),
formed AS (
  SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN -best.less >= 10 * n THEN best.other END AS form,
         CASE WHEN -best.less >= 10 * n THEN -best.less END AS form_n
  FROM words LEFT JOIN near USING (word)),
walk AS (
  SELECT word, word AS at FROM formed
  UNION ALL SELECT w.word, f.form FROM walk w JOIN formed f ON f.word = w.at WHERE f.form IS NOT NULL),
roots AS (SELECT w.word, w.at AS root FROM walk w JOIN formed f ON f.word = w.at WHERE f.form IS NULL)
SELECT word, form, root, n, n_near, form_n FROM formed JOIN roots USING (word)""",
    "op12_fill_in_middle": """
WITH drawn AS (
  SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n,
         sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS d FROM documents),
h AS (
  SELECT doc_id, text, n, ('0x' || d[1:8])::BIGINT % (n + 1) AS a, ('0x' || d[9:16])::BIGINT % (n + 1) AS b,
         ('0x' || d[17:24])::BIGINT % 100 AS p, ('0x' || d[25:32])::BIGINT % 100 AS s FROM drawn),
cut AS (
  SELECT *, least(a, b) AS low, greatest(a, b) AS high,
         CASE WHEN n = 0 OR p >= 90 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') THEN 'plain'
              WHEN s < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
parts AS (
  SELECT *, '<P>' || text[1:low] AS p_part, '<M>' || text[low + 1:high] AS m_part, '<S>' || text[high + 1:] AS s_part FROM cut)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN low END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN high - low END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN p_part || s_part || m_part ELSE s_part || p_part || m_part END)
         AS output_sha256,
       sha256(text) AS restored_sha256
FROM parts""",
    "op6_exact_dedup": f"""
WITH n AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '{RUN}', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM n WINDOW w AS (PARTITION BY text_sha256)""",
    "op10_mix_sources": rf"""
WITH RECURSIVE sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size, q.weight
  FROM documents LEFT JOIN (
    SELECT doc_id, max(CASE WHEN quality = 1 THEN 2.0 ELSE 0.5 END)::DOUBLE AS weight FROM labels GROUP BY ALL) q
  USING (doc_id)),
src AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         [1, 2, 3][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight
  FROM sized GROUP BY source),
-- each step holds at its cap what the level of the step before puts above it
level(step, held, lvl) AS (
  SELECT 0, 0::BIGINT, (SELECT sum(source_size)::DOUBLE / sum(weight) FROM src)
  UNION ALL
  SELECT step + 1, (SELECT count(*) FROM src WHERE 3 * source_size < lvl * weight),
         (SELECT (sum(source_size) - coalesce(sum(3 * source_size) FILTER (3 * source_size < lvl * weight), 0))::DOUBLE
                 / sum(weight) FILTER (3 * source_size >= lvl * weight) FROM src)
  FROM level WHERE step < 60 AND (SELECT count(*) FROM src WHERE 3 * source_size < lvl * weight) > held),
target AS (
  SELECT source, source_size, round(least(3.0 * source_size, weight * lvl), 6) AS target,
         CASE WHEN source_size > 0
              THEN floor(round(least(3.0 * source_size, weight * lvl), 6) / source_size)::BIGINT ELSE 0 END AS epochs
  FROM src, (SELECT max(lvl) AS lvl FROM level)),
keyed AS (
  SELECT *, -ln((('0x' || substr(md5('11:' || doc_id), 1, {HEX}))::BIGINT + 0.5::DOUBLE) / (16.0::DOUBLE ** {HEX}))
            / coalesce(weight, 1.0) AS key FROM sized),
summed AS (
  SELECT k.doc_id, k.size, t.source_size, t.target, t.epochs, t.target - t.epochs * t.source_size AS budget,
         sum(k.size) OVER (PARTITION BY k.source ORDER BY key, k.doc_id, k.size ROWS UNBOUNDED PRECEDING) AS upto
  FROM keyed k JOIN target t ON k.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, epochs, size * (epochs + (upto - size / 2.0 <= budget)::INT) AS taken
FROM summed""",
    "op8_url_filters": r"""
WITH host AS (
  SELECT page_id, url, regexp_replace(lower(regexp_extract(url, '(?i)^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)), '\.+$', '') AS host,
         list_filter(string_split(regexp_extract(url, '(?i)^[a-z][a-z0-9+.-]*://[^/?#]*(/[^?#]*)?', 1), '/'), lambda x: x <> '') AS parts,
         1704067200 + ('0x' || substr(md5('t' || page_id), 1, 7))::BIGINT % 31536000 AS fetched
  FROM pages),
hosts AS (
  SELECT host, ('0x' || substr(md5(host), 1, 7))::BIGINT % 100 AS roll,
         1704067200 + ('0x' || substr(md5('b' || host), 1, 7))::BIGINT % 15768000 AS b,
         1704067200 + ('0x' || substr(md5('p' || host), 1, 7))::BIGINT % 31536000 AS p,
         1704067200 + ('0x' || substr(md5('d' || host), 1, 7))::BIGINT % 31536000 AS d
  FROM (SELECT DISTINCT host FROM host WHERE host <> '')),
entries AS (
  SELECT rule, since, min(verdict) AS verdict FROM (
    SELECT host AS rule, b AS since, 'block' AS verdict FROM hosts WHERE roll < 30
    UNION ALL SELECT host, b + 5000000, NULL FROM hosts WHERE roll < 20
    UNION ALL SELECT host || '/en', p, 'review' FROM hosts WHERE roll >= 80
    UNION ALL SELECT regexp_replace(host, '^[^.]+\.', ''), d, CASE WHEN roll < 50 THEN 'warn' ELSE 'allow' END
              FROM hosts WHERE roll % 10 = 5) GROUP BY ALL),
spans AS (
  SELECT *, coalesce(lead(since) OVER (PARTITION BY rule ORDER BY since), 9999999999) AS until FROM entries),
asked AS (
  SELECT page_id, fetched, host, unnest(list_concat(
    list_transform(range(1, len(string_split(host, '.')) + 1), lambda i: array_to_string(string_split(host, '.')[-i:], '.')),
    list_transform(range(1, len(parts) + 1), lambda i: host || '/' || array_to_string(parts[1:i], '/')))) AS rule
  FROM host WHERE host <> ''),
best AS (
  SELECT page_id, count(*) AS n_active,
         max(struct_pack(p := contains(rule, '/'), l := length(rule), rule := rule, verdict := verdict, since := since)) AS best
  FROM asked JOIN spans USING (rule) WHERE verdict IS NOT NULL AND since <= fetched AND fetched < until GROUP BY ALL)
SELECT page_id, fetched, host, best.rule AS rule, coalesce(best.verdict, 'allow') AS verdict, best.since AS since,
       coalesce(n_active, 0) AS n_active
FROM host LEFT JOIN best USING (page_id)""",
}
