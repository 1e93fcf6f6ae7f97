"""The same results as ``queries`` in plain SQL over the same tables."""

from trawl.config import REFUSAL_TEXT, TARGET_SECTIONS
from trawl.functions.text import QUERY_STOP_WORDS
from trawl.operators.grounding import EVIDENCE_HEADING, WEAK_NOTE

SPACE = (
    r"[\t\n\x0b\x0c\r \x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}"
    r"\x{202f}\x{205f}\x{3000}]"
)
STOP = "[" + ", ".join(f"'{w}'" for w in QUERY_STOP_WORDS) + "]"


def strip(x):
    return rf"regexp_replace(regexp_replace({x}, '\A{SPACE}+', ''), '{SPACE}+\z', '')"


def toks(x):
    return f"regexp_extract_all(lower({x}), '[a-z0-9]+')"


def useful(x):
    return f"list_filter({toks(x)}, lambda t: NOT list_contains({STOP}, t))"


DOCS = f"""docs AS (
  SELECT doc_id AS id, upper(lang) AS ticker, source AS section, text, {toks('text')} AS toks
  FROM documents)"""


def asked(company="NULL"):
    return f"""asked AS (
  SELECT item_id AS qid, text AS question, {company}::VARCHAR AS company FROM benchmark)"""


POSTINGS = """post AS (
  SELECT id, ticker, dl, t, count(*) AS tf
  FROM (SELECT id, ticker, len(toks) AS dl, unnest(toks) AS t FROM docs) GROUP BY ALL),
dfs AS (SELECT t, count(*) AS df FROM post GROUP BY t),
corp AS (SELECT count(*) AS n, avg(len(toks)) AS avgdl FROM docs)"""


def bm25(questions, out, k):
    """CTEs ending in out(qid, r, id, score)."""
    q = questions
    return f"""{out}_t AS (
  SELECT qid, company, CASE WHEN len(u) > 0 THEN u ELSE a END AS ts FROM (
    SELECT qid, company, {useful('question')} AS u, {toks('question')} AS a FROM {q})),
{out}_q AS (
  SELECT qid, company, t, count(*) AS times, min(p) AS first FROM (
    SELECT qid, company, unnest(ts) AS t, unnest(range(len(ts))) AS p FROM {out}_t) GROUP BY ALL),
{out}_s AS (
  SELECT qid, id, round(sum(times * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5
                      / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 9) AS score, min(first) AS first
  FROM post JOIN {out}_q USING (t) JOIN dfs USING (t), corp
  WHERE company IS NULL OR company = ticker GROUP BY ALL),
{out} AS (
  SELECT qid, r, id, score FROM (
    SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, first, id) AS r
    FROM {out}_s) WHERE r <= {k})"""


def hashed(source, key, tokens, out):
    return f"""{out}_c AS (
  SELECT k, b, count(*) AS c FROM (
    SELECT k, ('0x' || substr(md5(t), 1, 8))::BIGINT % 64 AS b
    FROM (SELECT {key} AS k, unnest({tokens}) AS t FROM {source})) GROUP BY ALL),
{out}_w AS (SELECT k, b, (c / sqrt(sum(c * c) OVER (PARTITION BY k)))::FLOAT AS w FROM {out}_c),
{out} AS (
  SELECT g.k, list(coalesce(w, 0)::DOUBLE ORDER BY g.b) AS v
  FROM (SELECT DISTINCT {key} AS k, b FROM {source}, range(64) r(b)) g
  LEFT JOIN {out}_w USING (k, b) GROUP BY g.k)"""


VECTORS = hashed("docs", "id", "toks", "dvec")


def dense(questions, out, k):
    """CTEs ending in out(qid, r, id, sim)."""
    return (
        hashed(questions, "qid", toks("question"), f"{out}_v")
        + f""",
{out} AS (
  SELECT qid, r, id, sim FROM (
    SELECT *, row_number() OVER (PARTITION BY qid ORDER BY sim DESC, id) AS r FROM (
      SELECT q.qid, d.id, round(list_dot_product(qv.v, dv.v), 9) AS sim
      FROM {questions} q JOIN {out}_v qv ON qv.k = q.qid, docs d JOIN dvec dv ON dv.k = d.id
      WHERE q.company IS NULL OR q.company = d.ticker)) WHERE r <= {k})"""
    )


def fused(dense_cte, sparse_cte, out, k, mode):
    order = {
        "rrf": "round(rrf, 12) DESC, dr NULLS LAST, sr NULLS LAST",
        "interleave": "least(2 * (dr - 1), 2 * (sr - 1) + 1)",
    }[mode]
    return f"""{out}_j AS (
  SELECT coalesce(d.qid, s.qid) AS qid, coalesce(d.id, s.id) AS id, d.r AS dr, s.r AS sr,
         coalesce(sim, 0) AS sim, score,
         coalesce(1.0 / (60 + d.r - 1), 0) + coalesce(1.0 / (60 + s.r - 1), 0) AS rrf
  FROM {dense_cte} d FULL JOIN {sparse_cte} s ON d.qid = s.qid AND d.id = s.id),
{out} AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY {order}) AS r
                 FROM {out}_j) WHERE r <= {k})"""


def gate(questions, out):
    """out(qid, opaque) with a ceiling of one document."""
    return f"""{out} AS (
  SELECT qid, coalesce(bool_or(df = 1), false) AS opaque
  FROM (SELECT qid, unnest(CASE WHEN len(u) > 0 THEN u ELSE [''] END) AS t FROM (
    SELECT qid, {useful('question')} AS u FROM {questions})) LEFT JOIN dfs USING (t) GROUP BY qid)"""


def gated(questions, out, k):
    """CTEs ending in out(qid, r, id, sim, dr, sr, score, rrf, fusion)."""
    o = out
    return f"""{gate(questions, o + '_g')},
{o}_lq AS (SELECT q.* FROM {questions} q JOIN {o}_g USING (qid) WHERE opaque),
{o}_pq AS (SELECT q.* FROM {questions} q JOIN {o}_g USING (qid) WHERE NOT opaque),
{dense(o + '_lq', o + '_d', 50)}, {bm25(o + '_lq', o + '_s', 50)},
{fused(o + '_d', o + '_s', o + '_f', k, 'interleave')},
{dense(o + '_pq', o + '_p', k)},
{o} AS (
  SELECT qid, r, id, sim, dr, sr, score, rrf, 'interleave' AS fusion FROM {o}_f
  UNION ALL
  SELECT qid, r, id, sim, NULL, NULL, NULL, NULL, 'dense-passthrough' FROM {o}_p)"""


def merged(lists, out, k):
    """Round robin of lists(q, list_no, r, id, sim) into out(qid, r, id, sim)."""
    return f"""{out} AS (
  SELECT q AS qid, place AS r, id, sim FROM (
    SELECT *, row_number() OVER (PARTITION BY q ORDER BY r, list_no) AS place FROM (
      SELECT *, row_number() OVER (PARTITION BY q, id ORDER BY r, list_no) AS seen FROM {lists})
    WHERE seen = 1) WHERE place <= {k})"""


def whole_word(word, text):
    return rf"regexp_matches({text}, '(^|[^\p{{L}}\p{{N}}_]){word}([^\p{{L}}\p{{N}}_]|$)')"


COMPANIES = {"DE": "der", "EN": "the", "ES": "los", "FR": "les"}


def mentioned(x):
    tests = ", ".join(
        f"CASE WHEN {whole_word(t, f'upper({x})')} OR {whole_word(n, f'lower({x})')} THEN '{t}' END"
        for t, n in COMPANIES.items()
    )
    return f"list_filter([{tests}], lambda t: t IS NOT NULL)"


def numbered(subs, out):
    """subs(q, sub_key, question, company) with qid and list_no."""
    return f"""{out} AS (
  SELECT q || '/' || list_no AS qid, * FROM (
    SELECT *, row_number() OVER (PARTITION BY q ORDER BY sub_key) AS list_no
    FROM (SELECT DISTINCT * FROM {subs})))"""


def by_company(questions, out):
    return f"""{out}_m AS (SELECT *, {mentioned('question')} AS named FROM {questions}),
{out} AS (
  SELECT qid AS q, coalesce(c, '') AS sub_key, question, coalesce(c, company) AS company FROM (
    SELECT *, unnest(CASE WHEN company IS NULL AND len(named) >= 2 THEN named ELSE [NULL] END) AS c
    FROM {out}_m))"""


def sentences(x):
    parts = f"string_split_regex({x}, '[.\\n]')"
    return f"list_filter(list_transform({parts}, lambda p: {strip('p')}), lambda p: p <> '')"


def by_sentence(questions, out, filtered=False):
    company = (
        f"coalesce(company, CASE WHEN len({mentioned('s')}) = 1 THEN ({mentioned('s')})[1] END)"
        if filtered
        else "company"
    )
    return f"""{out}_p AS (SELECT *, {sentences('question')} AS parts FROM {questions}),
{out} AS (
  SELECT q, coalesce(s, '') AS sub_key, coalesce(s, question) AS question, {company} AS company
  FROM (SELECT qid AS q, question, company,
               unnest(CASE WHEN len(parts) > 1 THEN parts ELSE [NULL] END) AS s FROM {out}_p))"""


def lists(ranked, subs, out):
    return f"""{out} AS (
  SELECT s.q, s.list_no, r.r, r.id, r.sim FROM {ranked} r JOIN {subs} s USING (qid))"""


def stem(*parts):
    return "WITH " + ",\n".join(parts)


GOLDEN = """key AS (
  SELECT item_id AS qid, doc_id AS id FROM benchmark b JOIN documents d ON contains(d.text, b.text)),
golden AS (
  SELECT item_id AS qid, text AS question,
         CASE WHEN n IS NULL THEN 'control' WHEN n = 1 THEN 'single' ELSE 'multi' END AS category,
         length(text) >= 240 AS reliable
  FROM benchmark LEFT JOIN (SELECT qid, count(*) AS n FROM key GROUP BY qid) ON qid = item_id)"""


def scores(ranked, out, golden="golden", key="key"):
    return f"""{out}_k AS (
  SELECT qid, count(*) AS n, count(*) FILTER (r <= 5) AS in5, count(*) FILTER (r <= 10) AS inp,
         min(r) AS first, list(id ORDER BY id) FILTER (coalesce(r, 99) > 5) AS missed
  FROM {key} LEFT JOIN {ranked} USING (qid, id) GROUP BY qid),
{out} AS (
  SELECT g.qid, g.question, g.category, g.reliable, k.n, k.n IS NULL AS control,
         coalesce(t.sim, 0) AS top1, (in5 > 0)::BIGINT AS hit5, in5 / k.n AS recall5,
         inp / k.n AS recallp, CASE WHEN k.n IS NOT NULL THEN coalesce(1.0 / first, 0) END AS mrr,
         CASE WHEN k.n IS NOT NULL THEN coalesce(array_to_string(missed, ','), '') END AS missed5
  FROM {golden} g LEFT JOIN {out}_k k USING (qid)
  LEFT JOIN (SELECT qid, sim FROM {ranked} WHERE r = 1) t USING (qid))"""


SCORE_ROWS = """SELECT qid AS query_id, category, round(top1, 6) AS top1, control,
  reliable AS recall_reliable, n AS n_relevant, hit5, round(recall5, 6) AS recall5,
  round(recallp, 6) AS recall_pool, round(mrr, 6) AS mrr, missed5 FROM """


def means(source):
    return f"""SELECT category, count(*) AS n, count(*) FILTER (reliable) AS n_rel,
  round(avg(hit5), 6) AS hit5, round(avg(mrr), 6) AS mrr,
  round(avg(recall5) FILTER (reliable), 6) AS recall5,
  round(avg(recallp) FILTER (reliable), 6) AS recall_pool
FROM {source} WHERE NOT control GROUP BY ROLLUP (category)"""


DENSE10 = stem(DOCS, asked(), VECTORS, dense("asked", "ranked", 10))
HYBRID10 = stem(
    DOCS, asked(), POSTINGS, VECTORS, dense("asked", "dn", 50), bm25("asked", "sp", 50),
    fused("dn", "sp", "ranked", 10, "interleave"),
)
POOL = f"""{VECTORS}, {POSTINGS}, {dense('asked', 'dn', 50)}, {bm25('asked', 'sp', 50)},
{fused('dn', 'sp', 'hy', 20, 'interleave')},
pool AS (
  SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY place) AS pool_rank FROM (
    SELECT qid, id, min(place) AS place FROM (
      SELECT qid, id, r AS place FROM dn WHERE r <= 20
      UNION ALL SELECT qid, id, 1000 + r FROM hy) GROUP BY ALL))"""
JUDGED = f"""{stem(DOCS, asked(), POOL, GOLDEN)},
verdicts AS (
  SELECT qid, id, quality = 1 AS relevant FROM (
    SELECT qid, id FROM pool UNION SELECT qid, id FROM key) p JOIN labels l ON l.doc_id = p.id),
rightly AS (
  SELECT k.qid, count(*) AS n_right, count(*) FILTER (relevant) AS n_recovered,
         coalesce(array_to_string(list(k.id ORDER BY k.id) FILTER (NOT coalesce(relevant, false)), ','), '') AS missed
  FROM key k LEFT JOIN verdicts v USING (qid, id) GROUP BY k.qid),
negatives AS (
  SELECT *, row_number() OVER (PARTITION BY qid ORDER BY pool_rank) AS nr
  FROM pool p ANTI JOIN key k ON p.qid = k.qid AND p.id = k.id),
wrongly AS (
  SELECT n.qid, count(*) AS n_neg, count(*) FILTER (relevant) AS n_false,
         coalesce(array_to_string(list(n.id ORDER BY nr) FILTER (relevant), ','), '') AS false_accepts
  FROM (SELECT * FROM negatives WHERE nr <= 8) n LEFT JOIN verdicts v USING (qid, id) GROUP BY n.qid),
validated AS (
  SELECT g.qid, category, n_right, n_recovered, missed, coalesce(n_neg, 0) AS n_neg,
         coalesce(n_false, 0) AS n_false, coalesce(false_accepts, '') AS false_accepts
  FROM golden g JOIN rightly USING (qid) LEFT JOIN wrongly USING (qid) WHERE reliable),
sampled AS (SELECT qid FROM golden WHERE NOT reliable AND qid IN (SELECT qid FROM key)),
completed AS (
  SELECT coalesce(h.qid, j.qid) AS qid, coalesce(h.id, j.id) AS id,
         h.id IS NOT NULL AS hand, j.id IS NOT NULL AS judged
  FROM (SELECT * FROM key WHERE qid IN (FROM sampled)) h
  FULL JOIN (SELECT qid, id FROM pool JOIN verdicts USING (qid, id)
             WHERE relevant AND qid IN (FROM sampled)) j ON h.qid = j.qid AND h.id = j.id)"""

DENSE_ROWS = "SELECT qid AS query_id, r AS rank, id, round(sim, 6) AS similarity FROM "
FUSED_ROWS = """SELECT qid AS query_id, id, r AS rank, dr AS dense_rank, sr AS bm25_rank,
  round(sim, 6) AS similarity, round(score, 6) AS bm25_score, round(rrf, 9) AS rrf_score, """
BM25_ROWS = "SELECT qid AS query_id, r AS bm25_rank, id, round(score, 6) AS bm25_score FROM "

CENTROIDS = """cent_x AS (
  SELECT label, i, avg(x::DOUBLE) AS x FROM (
    SELECT label, unnest(embedding) AS x, unnest(range(len(embedding))) AS i FROM embeddings)
  GROUP BY ALL),
cent AS (
  SELECT label AS qid, list(x / n ORDER BY i) AS v FROM (
    SELECT *, sqrt(sum(x * x) OVER (PARTITION BY label)) AS n FROM cent_x) GROUP BY label)"""


def centroid_top(out, k, where):
    return f"""{out} AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY qid ORDER BY sim DESC, id) AS r FROM (
      SELECT qid, vec_id AS id, embedding::DOUBLE[] AS e,
             round(list_dot_product(v, embedding::DOUBLE[]), 9) AS sim
      FROM cent, embeddings WHERE {where})) WHERE r <= {k})"""


def preview(x):
    head = f"substr({x}, 1, 200)"
    cut = f"regexp_extract({head}, '(?s)\\A(.*) ', 1)"
    return (
        f"replace(CASE WHEN contains(substr({head}, 161, 40), ' ') THEN {cut} ELSE {head} END, "
        "chr(10), ' | ')"
    )


def excerpt(x, n):
    return f"substr(replace({strip(x)}, chr(10), ' '), 1, {n})"


def same_tokens():
    """Jaccard similarity of question and document token sets."""
    q = toks("question")
    return (
        f"round(len(list_intersect(list_distinct({q}), list_distinct(toks))) "
        f"/ greatest(len(list_distinct(list_concat({q}, toks))), 1), 9)"
    )


SPLIT = stem(DOCS, asked(), POSTINGS, VECTORS)
ENTITIES = "&copy; © &middot; · &quot; \" &amp; &".split()


def decoded(x):
    for entity, char in zip(ENTITIES[::2], ENTITIES[1::2]):
        x = f"replace({x}, '{entity}', '{char}')"
    return x


FRESH = """fresh AS (
  SELECT page_id * 2 AS id, upper(regexp_extract(url, '/([a-z]{2})/', 1)) AS ticker, 'web' AS section,
    url AS text FROM pages)"""

ORACLES = {
    "tokenize_documents": f"""{stem(DOCS)} SELECT id, len(toks) AS n_tokens,
  len(list_distinct(toks)) AS n_distinct, md5(array_to_string(toks, ' ')) AS digest FROM docs""",
    "query_terms": f"""SELECT item_id AS query_id, array_to_string(
  CASE WHEN len({useful('text')}) > 0 THEN {useful('text')} ELSE {toks('text')} END, ' ') AS bm25_query
FROM benchmark""",
    "document_previews": f"""SELECT doc_id AS id, {preview('text')} AS preview,
  {excerpt('text', 320)} AS excerpt, replace(substr(text, 1, 140), chr(10), ' | ') AS head
FROM documents""",
    "company_detection": f"""SELECT conv_id, turn, array_to_string(named, ',') AS companies,
  len(named) > 0 AND NOT list_contains(named, 'FR') AS mismatch
FROM (SELECT conv_id, turn, {mentioned('text')} AS named FROM conversations)""",
    "id_companies": """SELECT chunk_id,
  CASE upper(lang) WHEN 'DE' THEN 'German' WHEN 'FR' THEN 'French' ELSE upper(lang) END AS company,
  printf('%04d', doc_id) AS short_id
FROM (SELECT lang, doc_id, printf('%s-%s-%04d', upper(lang), '2024-01-01', doc_id) AS chunk_id
      FROM documents)""",
    "inverted_index": f"{stem(DOCS, POSTINGS)} SELECT t AS term, id, tf, dl FROM post",
    "term_stats": f"""{stem(DOCS, POSTINGS)}
SELECT t AS term, df, round(ln(1 + (n - df + 0.5) / (df + 0.5)), 9) AS idf FROM dfs, corp""",
    "corpus_stats": f"{stem(DOCS, POSTINGS)} SELECT n, round(avgdl, 6) AS avgdl FROM corp",
    "token_document_frequency": f"""{stem(DOCS, POSTINGS, asked())}
SELECT qid AS query_id, p AS position, t AS term, coalesce(df, 0) AS df FROM (
  SELECT qid, unnest(u) AS t, unnest(range(len(u))) AS p FROM (
    SELECT qid, {useful('question')} AS u FROM asked)) LEFT JOIN dfs USING (t)""",
    "rare_token_gate": f"""{stem(DOCS, POSTINGS, asked(), gate('asked', 'g'))}
SELECT qid AS query_id, opaque FROM g""",
    "bm25_topk": f"{stem(DOCS, POSTINGS, asked(), bm25('asked', 'b', 10))} {BM25_ROWS} b",
    "bm25_stored_index": f"{stem(DOCS, POSTINGS, asked(), bm25('asked', 'b', 10))} {BM25_ROWS} b",
    "bm25_filtered": stem(DOCS, POSTINGS, asked("'DE'"), bm25("asked", "b", 10)) + BM25_ROWS + "b",
    "vector_stats": """SELECT vec_id, len(embedding) AS dim,
  round(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS norm,
  array_to_string(list_transform(embedding[1:8],
    lambda x: round_even(x::DOUBLE * 10000, 0)::BIGINT), ',') AS first8 FROM embeddings""",
    "hashed_embeddings": f"""{stem(DOCS, VECTORS)}
SELECT k AS id, array_to_string(list_transform(v, lambda x: round(x * 1000000)::BIGINT), ',') AS micro_units
FROM dvec""",
    "dense_topk": f"{stem(CENTROIDS, centroid_top('ranked', 10, 'true'))} {DENSE_ROWS} ranked",
    "dense_topk_filtered": f"{stem(CENTROIDS, centroid_top('ranked', 10, 'label = qid'))} {DENSE_ROWS} ranked",
    "dense_text_topk": f"""{DENSE10}
SELECT qid AS query_id, r AS rank, id, round(sim, 6) AS similarity,
  CASE WHEN sim >= 0.75 THEN 'very high (direct paraphrase)'
       WHEN sim >= 0.65 THEN 'high (clearly relevant)'
       WHEN sim >= 0.58 THEN 'moderate (likely relevant)'
       WHEN sim >= 0.52 THEN 'low (near BGE noise floor — corpus may not contain a good match)'
       ELSE 'very low (likely no good match)' END AS band,
  repeat('#', round_even(sim * 40, 0)::BIGINT) AS bar FROM ranked""",
    "mmr": f"""WITH RECURSIVE {CENTROIDS}, {centroid_top('pool', 50, 'true')},
pairs AS (
  SELECT a.qid, a.id AS a, b.id AS b, list_dot_product(a.e, b.e) AS c
  FROM pool a JOIN pool b USING (qid)),
picks AS (
  SELECT qid, 1 AS n, [id] AS ids FROM pool WHERE r = 1
  UNION ALL
  SELECT qid, n + 1, list_append(ids, first(a ORDER BY value DESC, r)) FROM (
    SELECT p.qid, p.n, p.ids, x.a, o.r, round(0.3 * o.sim - 0.7 * max(x.c), 9) AS value
    FROM picks p JOIN pairs x ON x.qid = p.qid AND list_contains(p.ids, x.b)
      AND NOT list_contains(p.ids, x.a)
    JOIN pool o ON o.qid = x.qid AND o.id = x.a
    WHERE p.n < 10 GROUP BY p.qid, p.n, p.ids, x.a, o.r, o.sim) GROUP BY qid, n, ids)
SELECT qid AS query_id, p.r AS rank, p.id, round(p.sim, 6) AS similarity, k AS mmr_rank
FROM (SELECT qid, unnest(ids) AS id, unnest(range(1, 11)) AS k FROM picks WHERE n = 10)
JOIN pool p USING (qid, id)""",
    "hybrid_rrf": f"""{SPLIT}, {dense('asked', 'dn', 50)}, {bm25('asked', 'sp', 50)},
{fused('dn', 'sp', 'f', 10, 'rrf')} {FUSED_ROWS} 'rrf' AS fusion FROM f""",
    "hybrid_interleave": f"{HYBRID10} {FUSED_ROWS} 'interleave' AS fusion FROM ranked",
    "hybrid_gated": f"{SPLIT}, {gated('asked', 'f', 10)} {FUSED_ROWS} fusion FROM f",
    "round_robin_sources": f"""{stem(DOCS)}, lists AS (
  SELECT * FROM (
    SELECT ticker AS q, section AS list_no, id, NULL AS sim, row_number() OVER (
      PARTITION BY ticker, section ORDER BY length(text) DESC, id) AS r FROM docs) WHERE r <= 20),
{merged('lists', 'm', 20)} SELECT qid AS query_id, r AS rank, id FROM m""",
    "company_decomposition": f"""{SPLIT}, {by_company('asked', 'subs')}, {numbered('subs', 'nq')},
{dense('nq', 'dn', 10)}, {lists('dn', 'nq', 'li')}, {merged('li', 'm', 10)} {DENSE_ROWS} m""",
    "query_split": f"""{SPLIT}, {by_sentence('asked', 'subs')}, {numbered('subs', 'nq')},
{dense('nq', 'dn', 10)}, {lists('dn', 'nq', 'li')}, {merged('li', 'm', 10)} {DENSE_ROWS} m""",
    "query_split_filtered": f"""{SPLIT}, {by_sentence('asked', 'subs', True)}, {numbered('subs', 'nq')},
{dense('nq', 'dn', 10)}, {lists('dn', 'nq', 'li')}, {merged('li', 'm', 10)} {DENSE_ROWS} m""",
    "aspect_expansion": f"""{SPLIT}, {by_sentence('asked', 'subs')}, {numbered('subs', 'nq')},
{dense('nq', 'dn', 50)}, {bm25('nq', 'sp', 50)}, {fused('dn', 'sp', 'f', 10, 'interleave')},
{lists('f', 'nq', 'li')}, {merged('li', 'm', 10)} {DENSE_ROWS} m""",
    "full_stack_topk": f"""{SPLIT}, {by_sentence('asked', 'subs')}, {numbered('subs', 'outer_q')},
{by_company('outer_q', 'parts')}, {numbered('parts', 'inner_q')}, {gated('inner_q', 'f', 5)},
{lists('f', 'inner_q', 'inner_l')}, {merged('inner_l', 'inner_m', 5)},
{lists('inner_m', 'outer_q', 'outer_l')}, {merged('outer_l', 'm', 5)} {DENSE_ROWS} m""",
    "rerank_topk": f"""{SPLIT}, {dense('asked', 'dn', 50)},
sc AS (
  SELECT dn.qid, id, sim, dn.r AS pr, {same_tokens()} AS s
  FROM dn JOIN asked USING (qid) JOIN docs USING (id)),
m AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY s DESC, pr) AS r FROM sc)
SELECT qid AS query_id, r AS rank, id, round(sim, 6) AS similarity, s AS rerank_score
FROM m WHERE r <= 10""",
    "compare_filter_arms": stem(DOCS, asked("'FR'"), VECTORS, dense("asked", "fa", 5))
    + f""",
opened AS (SELECT qid, question, NULL::VARCHAR AS company FROM asked), {dense('opened', 'oa', 5)}
SELECT coalesce(fa.qid, oa.qid) AS query_id, coalesce(fa.id, oa.id) AS id, fa.r AS filtered_rank,
  oa.r AS open_rank, round(fa.sim, 6) AS filtered_sim, round(oa.sim, 6) AS open_sim
FROM fa FULL JOIN oa ON fa.qid = oa.qid AND fa.id = oa.id""",
    "result_ticker_breakdown": f"""{DENSE10}
SELECT qid AS query_id, ticker, count(*) AS n FROM ranked JOIN docs USING (id) GROUP BY ALL""",
    "candidate_pool": f"""{stem(DOCS, asked(), POOL)}
SELECT qid AS query_id, id, pool_rank FROM pool""",
    "golden_answer_key": f"WITH {GOLDEN} SELECT qid AS query_id, id FROM key",
    "eval_dense": f"{DENSE10}, {GOLDEN}, {scores('ranked', 'sc')} {SCORE_ROWS} sc",
    "eval_hybrid": f"{HYBRID10}, {GOLDEN}, {scores('ranked', 'sc')} {SCORE_ROWS} sc",
    "eval_dense_means": f"{DENSE10}, {GOLDEN}, {scores('ranked', 'sc')} {means('sc')}",
    "eval_hybrid_means": f"{HYBRID10}, {GOLDEN}, {scores('ranked', 'sc')} {means('sc')}",
    "negative_controls": f"""{DENSE10}, {GOLDEN}, {scores('ranked', 'sc')}
SELECT qid AS query_id, round(top1, 6) AS top1, CASE WHEN top1 < 0.58
  THEN 'weak best match, as it should be' ELSE 'strong best match for a control: look into it' END AS note
FROM sc WHERE control""",
    "eval_report": f"""{DENSE10}, {GOLDEN}, {scores('ranked', 'sc')},
mm AS ({means('sc')})
SELECT qid::VARCHAR AS label, CASE WHEN control
  THEN printf('%3d  %-15s     —      —       —     —  %s', qid, category, substr(question, 1, 46))
  ELSE printf('%3d  %-15s %5d ', qid, category, hit5)
    || lpad(CASE WHEN reliable THEN printf('%.2f', recall5) ELSE printf('(%.2f)', recall5) END, 6, ' ') || ' '
    || lpad(CASE WHEN reliable THEN printf('%.2f', recallp) ELSE printf('(%.2f)', recallp) END, 7, ' ')
    || printf(' %5.2f  ', mrr) || substr(question, 1, 46)
    || CASE WHEN NOT reliable THEN '  [sampled key, left out of mean recall]'
            WHEN recall5 = 1 THEN '' ELSE '  [not among the first 5: ' || missed5 || ']' END END AS line
FROM sc
UNION ALL
SELECT coalesce(category, 'overall'), printf('%-16s %d whole keys: recall of 5 ', coalesce(category, 'overall'), n_rel)
  || coalesce(printf('%.2f', recall5), '—') || ', of 10 ' || coalesce(printf('%.2f', recall_pool), '—')
  || printf('; %d questions: hits ', n) || printf('%.2f', hit5) || ', first place (MRR) ' || printf('%.2f', mrr) FROM mm""",
    "relevant_placements": f"""{SPLIT}, {dense('asked', 'dn', 50)}, {GOLDEN},
sc AS (
  SELECT dn.qid, id, row_number() OVER (PARTITION BY dn.qid ORDER BY {same_tokens()} DESC, dn.r) AS rr
  FROM dn JOIN asked USING (qid) JOIN docs USING (id))
SELECT qid AS query_id, id, coalesce('rank ' || rr, 'outside the pool') AS placement
FROM key LEFT JOIN sc USING (qid, id)""",
    "judge_validation": f"""{JUDGED} SELECT qid AS query_id, category, n_right, n_recovered, missed,
  n_neg, false_accepts FROM validated""",
    "judge_verdict": f"""{JUDGED}, tot AS (
  SELECT coalesce(sum(n_right), 0)::BIGINT AS tot_right, coalesce(sum(n_recovered), 0)::BIGINT AS tot_recovered,
         coalesce(sum(n_neg), 0)::BIGINT AS tot_wrong, coalesce(sum(n_false), 0)::BIGINT AS tot_false_acc
  FROM validated),
rates AS (SELECT *, coalesce(tot_recovered / nullif(tot_right, 0), 0) AS a,
                 coalesce(tot_false_acc / nullif(tot_wrong, 0), 0) AS b FROM tot)
SELECT tot_right, tot_recovered, tot_wrong, tot_false_acc, round(a, 6) AS recovery,
  round(b, 6) AS false_rate, a >= 0.9 AND b <= 0.15 AS passed FROM rates""",
    "key_completion": f"""{JUDGED}
SELECT c.qid AS query_id, any_value(p.n) AS pool_size,
  coalesce(array_to_string(list(id ORDER BY id) FILTER (hand), ','), '') AS hand_key,
  coalesce(array_to_string(list(id ORDER BY id) FILTER (judged), ','), '') AS judged_relevant,
  array_to_string(list(id ORDER BY id), ',') AS new_key,
  coalesce(array_to_string(list(id ORDER BY id) FILTER (judged AND NOT hand), ','), '') AS added
FROM completed c JOIN (SELECT qid, count(*) AS n FROM pool GROUP BY qid) p USING (qid) GROUP BY c.qid""",
    "key_overlay_means": f"""{JUDGED}, ranked AS (SELECT * FROM dn WHERE r <= 10),
key2 AS (
  SELECT qid, id FROM completed
  UNION ALL SELECT qid, id FROM key WHERE qid NOT IN (SELECT qid FROM completed)),
golden2 AS (
  SELECT qid, question, category, reliable OR qid IN (SELECT qid FROM completed) AS reliable FROM golden),
{scores('ranked', 'sc', 'golden2', 'key2')} {means('sc')}""",
    "page_text": rf"""SELECT page_id, regexp_replace(array_to_string(list_filter(list_transform(
  string_split_regex(html, '(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>|</?[a-z!?][^>]*>'),
  lambda n: {strip(decoded('n'))}), lambda n: n <> ''), chr(10)), '\n\n+', chr(10) || chr(10), 'g') AS clean
FROM pages""",
    "upsert_rows": f"""WITH {DOCS}, {FRESH}
SELECT id, ticker, section, md5(text) AS digest FROM docs WHERE id NOT IN (SELECT id FROM fresh)
UNION ALL SELECT id, ticker, section, md5(text) FROM fresh""",
    "upsert_pruned": f"""WITH {DOCS}, {FRESH}
SELECT id, ticker, section, md5(text) AS digest FROM docs
WHERE id NOT IN (SELECT id FROM fresh) AND ticker NOT IN (SELECT ticker FROM fresh)
UNION ALL SELECT id, ticker, section, md5(text) FROM fresh""",
    "stored_collection": f"""WITH {DOCS} SELECT id, ticker, section,
  md5(CASE WHEN section = 'src1' THEN text || '!' ELSE text END) AS digest FROM docs""",
    "collection_counts": f"""WITH {DOCS}
SELECT t AS ticker, count(id) AS chunks FROM (SELECT unnest(['DE', 'EN', 'ES', 'FR', 'IT']) AS t)
LEFT JOIN docs ON ticker = t GROUP BY t UNION ALL SELECT '(all)', count(*) FROM docs""",
    "collection_sample": f"""WITH {DOCS}
SELECT id, ticker, length(text) AS chars FROM docs ORDER BY id LIMIT 3""",
    "document_length_stats": """SELECT source AS section, len(l) AS chunks, l[1] AS min_length,
  l[len(l) // 2 + 1] AS median_length, l[least(len(l) - 1, floor(len(l) * 0.95)::BIGINT) + 1] AS p95_length,
  l[-1] AS max_length
FROM (SELECT source, list(length(text) ORDER BY length(text)) AS l FROM documents GROUP BY source)""",
    "resolve_tickers": """SELECT ticker, printf('%010d', max(c_custkey)) AS cik,
  arg_max(c_name, c_custkey) AS company_name
FROM (SELECT *, upper(c_mktsegment || c_nationkey) AS ticker FROM customer) GROUP BY ticker""",
    "latest_annual_reports": """WITH f AS (
  SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS p
  FROM orders WHERE o_orderpriority = '1-URGENT'),
a AS (SELECT *, printf('%010d-%s-%06d', 1, strftime(o_orderdate, '%y'), o_orderkey) AS acc,
             'doc' || o_orderkey || '.htm' AS doc FROM f WHERE p = 1)
SELECT 'T' || c_custkey AS ticker, printf('%010d', c_custkey) AS cik, c_name AS company_name,
  '10-K' AS filing_type, strftime(o_orderdate, '%Y-%m-%d') AS filing_date, acc AS accession_number,
  doc AS primary_doc, 'https://www.sec.gov/Archives/edgar/data/' || c_custkey || '/'
  || replace(acc, '-', '') || '/' || doc AS source_url
FROM a JOIN customer ON c_custkey = o_custkey""",
    "rewrite_cache": r"""SELECT text AS question, i AS position, parts[i + 1] AS rewrite
FROM (SELECT text, parts, unnest(range(len(parts))) AS i
      FROM (SELECT text, string_split(text, '. ') AS parts FROM benchmark))""",
}

# --- prompts and audits ---

EVIDENCE = """ev AS (
  SELECT r.qid, r.r, r.sim, d.* FROM ranked r JOIN docs d USING (id))"""


def evidence(k):
    return f"{stem(DOCS, asked(), VECTORS, dense('asked', 'ranked', k))}, {EVIDENCE}"


BAND = "CASE WHEN top < 0.52 THEN 'refuse' WHEN top < 0.58 THEN 'weak' ELSE 'answer' END"
PROMPTS = f"""{evidence(5)}, pr AS (
  SELECT qid, question, top, {BAND} AS band, provided,
    '{EVIDENCE_HEADING}' || chr(10) || chr(10) || blocks
    || CASE WHEN {BAND} = 'weak' THEN chr(10) || chr(10) || '{WEAK_NOTE}' ELSE '' END
    || chr(10) || chr(10) || 'Question: ' || question AS turn
  FROM asked JOIN (
    SELECT qid, max(sim) FILTER (r = 1) AS top, list(id::VARCHAR ORDER BY id::VARCHAR) AS provided,
      string_agg('<chunk id="' || id || '" ticker="' || ticker || '" section="' || section || '">'
        || chr(10) || {strip('text')} || chr(10) || '</chunk>', chr(10) || chr(10) ORDER BY r) AS blocks
    FROM ev GROUP BY qid) USING (qid))"""
CITED = r"list_distinct(regexp_extract_all(answer, '\[([A-Za-z0-9][A-Za-z0-9\-_.]*)\]', 1))"
KNOWN = f"array_to_string(list_sort(list_filter({CITED}, lambda c: list_contains(provided, c))), ',')"
UNKNOWN = KNOWN.replace("lambda c: list", "lambda c: NOT list")

ORACLES |= {
    "prompt_assembly": f"""{PROMPTS}
SELECT qid AS query_id, round(top, 6) AS top_sim, band, array_to_string(provided, ',') AS provided,
  CASE WHEN band <> 'refuse' THEN turn END AS turn FROM pr""",
    "grounded_answers": f"""{PROMPTS}, an AS (
  SELECT *, CASE WHEN band = 'refuse' THEN '{REFUSAL_TEXT}' ELSE {strip(
      "(question || ' [' || provided[1] || '][' || provided[3] || '] [n-' || qid || ']')")} END AS answer FROM pr)
SELECT qid AS query_id, answer, answer = '{REFUSAL_TEXT}' AS refused, {KNOWN} AS citations,
  {UNKNOWN} AS unknown_citations, round(top, 6) AS top_sim, 'claude-opus-4-8' AS model,
  band = 'refuse' AS hard_gated FROM an""",
    "citation_audit": f"""WITH an AS (
  SELECT conv_id, turn, text || printf(' [c%d-%d] see [c%d-%d][Reserved]', conv_id, turn, conv_id, turn + 100) AS answer,
    list_transform(range(10), lambda i: 'c' || conv_id || '-' || i) AS provided
  FROM conversations WHERE role = 'assistant')
SELECT conv_id, turn, {KNOWN} AS citations, {UNKNOWN} AS unknown_citations,
  {strip('answer')} = '{REFUSAL_TEXT}' AS refused FROM an""",
    "seed_prompts": f"""{evidence(12)}
SELECT qid AS query_id, 'Question: ' || any_value(question) || chr(10) || chr(10) || 'Retrieved excerpts:' || chr(10)
  || string_agg('[' || id || '] ' || {excerpt('text', 320)}, chr(10) ORDER BY r) AS turn
FROM ev JOIN asked USING (qid) GROUP BY qid""",
    "judge_prompts": f"""{evidence(5)}
SELECT qid AS query_id, id, 'Annual report of ' || ticker || ', a passage:' || chr(10) || '---' || chr(10)
  || substr(text, 1, 1200) || chr(10) || '---' || chr(10)
  || 'Does the passage help to answer what was asked?' || chr(10) || question AS turn
FROM ev JOIN asked USING (qid)""",
}

# --- item sections of the report layout that the query builds ---

WANTED = ", ".join(
    "({}, '{}', '{}')".format(i, item, label.replace("'", "''"))
    for i, (item, label) in enumerate(TARGET_SECTIONS.items())
)
ORACLES["item_sections"] = rf"""WITH lines AS (
  SELECT id, unnest(ls) AS line, unnest(range(len(ls))) AS n FROM (
    SELECT doc_id AS id, string_split(
      'Item 1. Business' || chr(10) || 'Item 1A. Risk Factors' || chr(10) || 'Item 7. Overview' || chr(10)
      || 'Item 1. Business' || chr(10) || text || chr(10) || 'as discussed in' || chr(10)
      || 'Item 7 of our report.' || chr(10) || 'ITEM 1A. Risk Factors' || chr(10)
      || replace(text, '. ', '.' || chr(10)) || chr(10) || 'Item' || chr(160) || '7. [Reserved]' || chr(10) || replace(text, ' ', '  ')
      || chr(10) || 'Item 9. Other' || chr(10) || text, chr(10)) AS ls FROM documents)),
heads AS (
  SELECT *, regexp_extract(line, '^\s*(?:Item|ITEM)[\s\x{{a0}}]+(\d{{1,2}}[A-Za-z]?)\b\.?\s+[A-Z\[]', 1) AS item FROM lines),
slices AS (
  SELECT *, sum((item <> '')::INT) OVER (PARTITION BY id ORDER BY n) AS s FROM heads),
bodies AS (
  SELECT id, s, max(item) AS item, {strip('string_agg(line, chr(10) ORDER BY n)')} AS body
  FROM slices WHERE s > 0 GROUP BY id, s),
best AS (
  SELECT *, row_number() OVER (PARTITION BY id, upper(item) ORDER BY length(body) DESC, s) AS k FROM bodies)
SELECT id, row_number() OVER (PARTITION BY id ORDER BY o) - 1 AS position, section,
  length(body) AS chars, md5(body) AS digest
FROM best JOIN (VALUES {WANTED}) w(o, it, section) ON upper(item) = it
WHERE k = 1 AND length(body) >= 500"""

# --- chunks: the same folds as list_reduce over {o: finished, b: open} ---


def once(value, name, body):
    return f"(list_transform([{value}], lambda {name}: {body}))[1]"


def some(x):
    return f"(CASE WHEN {x} <> '' THEN [{x}] ELSE []::VARCHAR[] END)"


def fold(items, out, buf, n):
    """Fold strings with state s{n} and item x{n}, then flush the open one."""
    state = "{'o': []::VARCHAR[], 'b': ''}"
    start = f"list_transform({items}, lambda p{n}: {{'o': []::VARCHAR[], 'b': p{n}}})"
    reduced = (
        f"list_reduce({start}, lambda s{n}, x{n}: {{'o': {out}, 'b': {buf}}}, {state})"
    )
    return once(reduced, f"r{n}", f"list_concat(r{n}.o, {some(f'r{n}.b')})")


def atoms(x, level=0):
    n, t = level, f"t{level}"
    if level == 3:
        pieces = f"list_transform(range(0, length({t}), 1000), lambda i: substr({t}, i + 1, 1000))"
    else:
        sep = ["chr(10)", "'. '", "' '"][level]
        width = [1, 2, 1][level]
        s, part = f"s{n}", f"x{n}.b"
        over = f"length({part}) > 1000"
        fits = f"length({s}.b) + {width} + length({part}) <= 1000"
        out = (
            f"CASE WHEN {over} THEN list_concat(list_concat({s}.o, {some(s + '.b')}), {atoms(part, n + 1)}) "
            f"WHEN {s}.b = '' OR {fits} THEN {s}.o ELSE list_append({s}.o, {s}.b) END"
        )
        buf = (
            f"CASE WHEN {over} THEN '' WHEN {s}.b = '' THEN {part} "
            f"WHEN {fits} THEN {s}.b || {sep} || {part} ELSE {part} END"
        )
        pieces = fold(f"string_split({t}, {sep})", out, buf, n)
    return once(
        strip(x),
        t,
        f"CASE WHEN {t} = '' THEN []::VARCHAR[] WHEN length({t}) <= 1000 THEN [{t}] ELSE {pieces} END",
    )


def overlap(x):
    tail = f"right({x}, 150)"
    after = " ".join(
        f"WHEN contains({tail}, {m}) THEN substr({tail}, instr({tail}, {m}) + {w})"
        for m, w in [("'. '", 2), ("'? '", 2), ("'! '", 2), ("chr(10)", 1), ("' '", 1)]
    )
    return f"CASE WHEN length({x}) <= 150 THEN {x} {after} ELSE {tail} END"


def packed(items):
    s, a = "s9", "x9.b"
    absorb = f"(length({s}.b) + 1 + length({a}) <= 1000 OR length({s}.b) < 200)"
    seed = overlap(f"{s}.b")
    out = f"CASE WHEN {s}.b = '' OR {absorb} THEN {s}.o ELSE list_append({s}.o, {s}.b) END"
    buf = f"""CASE WHEN {s}.b = '' THEN {a} WHEN {absorb} THEN {s}.b || chr(10) || {a}
      WHEN {seed} <> '' AND length({seed}) + 1 + length({a}) <= 1000 THEN {seed} || chr(10) || {a}
      ELSE {a} END"""
    return fold(items, out, buf, 9)


def found(piece, cursor):
    """1-based position in text from a 0-based cursor, else anywhere, else 0."""
    ahead = f"instr(substr(text, {cursor} + 1), {piece})"
    return f"CASE WHEN {ahead} > 0 THEN {ahead} + {cursor} ELSE instr(text, {piece}) END"


CHUNKS = f"""{stem(DOCS)},
whole AS (
  SELECT id, ticker || id AS filing, section, text, {packed(atoms('text'))} AS cs FROM docs),
cut AS (
  SELECT * REPLACE (CASE WHEN length(cs[-1]) < 200 THEN cs[1:len(cs) - 1] ELSE cs END AS cs) FROM whole),
placed AS (
  SELECT *, list_reduce(
    list_transform(cs, lambda c: {{'cursor': 0::BIGINT, 'spans': []::BIGINT[], 'c': c}}),
    lambda s, x: {once(found('x.c', 's.cursor'), 'p', once(
        found('right(x.c, 80)', 's.cursor'), 'q', once(
            "CASE WHEN p > 0 THEN [p - 1, p - 1 + length(x.c)] WHEN q > 0 THEN "
            "[greatest(0, q - 1 + length(right(x.c, 80)) - length(x.c)), q - 1 + length(right(x.c, 80))] "
            "ELSE [-1, -1] END", 'a',
            "{'cursor': CASE WHEN a[1] >= 0 THEN a[1] + 1 ELSE s.cursor END, "
            "'spans': list_concat(s.spans, a), 'c': x.c}")))},
    {{'cursor': 0::BIGINT, 'spans': []::BIGINT[], 'c': ''}}).spans AS spans FROM cut),
chunks AS (
  SELECT printf('%s-%s-%04d', filing, '2024-01-01', i) AS chunk_id, filing, section, i AS chunk_index,
    cs[i + 1] AS chunk, spans[2 * i + 1] AS char_start, spans[2 * i + 2] AS char_end
  FROM (SELECT *, unnest(range(len(cs))) AS i FROM placed))"""

ORACLES |= {
    "chunk_documents": f"""{CHUNKS} SELECT chunk_id, section, chunk_index, char_start, char_end,
  md5(chunk) AS digest FROM chunks""",
    "chunk_files": f"{CHUNKS} SELECT chunk_id AS id, section, char_start, md5(chunk) AS digest FROM chunks",
    "streamed_collection": f"{CHUNKS} SELECT chunk_id AS id, section, md5(chunk) AS digest FROM chunks",
    "chunk_length_stats": f"""{CHUNKS} SELECT section, len(l) AS chunks, l[1] AS min_length,
  l[len(l) // 2 + 1] AS median_length, l[least(len(l) - 1, floor(len(l) * 0.95)::BIGINT) + 1] AS p95_length,
  l[-1] AS max_length
FROM (SELECT section, list(length(chunk) ORDER BY length(chunk)) AS l FROM chunks GROUP BY section)""",
    "chunk_samples": f"""{CHUNKS} SELECT chunk_id, length(chunk) AS length,
  replace(substr(chunk, 1, 200), chr(10), ' | ') AS head, replace(right(chunk, 160), chr(10), ' | ') AS tail
FROM (SELECT *, count(*) OVER (PARTITION BY filing) AS n FROM chunks)
WHERE chunk_index = least(1, n - 1) OR chunk_index = n // 2""",
    "chunk_bm25": f"""{CHUNKS}, cdocs AS (
  SELECT chunk_id AS id, substr(filing, 1, 2) AS ticker, {toks('chunk')} AS toks FROM chunks),
{asked()}, {POSTINGS.replace('FROM docs', 'FROM cdocs')}, {bm25('asked', 'b', 10)} {BM25_ROWS} b""",
}

HALF = "text[1:length(text) // 2]"
GROWN = f"""docs AS (
  SELECT *, {toks('text')} AS toks FROM (
    SELECT doc_id AS id, CASE WHEN lang = 'fr' THEN 'XX' ELSE upper(lang) END AS ticker, source AS section,
           CASE WHEN source = 'src1' THEN {HALF} ELSE text END AS text FROM documents))"""
DIGESTS = "SELECT id, ticker, section, md5(text) AS digest FROM "

ORACLES |= {
    "upsert_new_ticker": f"{stem(GROWN)} {DIGESTS} docs",
    "compacted_collection": f"""WITH {DOCS}
SELECT id, ticker, section, md5(CASE WHEN ticker = 'EN' THEN text || '!' ELSE text END) AS digest
FROM docs WHERE ticker <> 'EN' OR length(text) >= 1000""",
    "stored_counts": f"""{stem(GROWN)}
SELECT t AS ticker, count(id) AS chunks FROM (SELECT unnest(['DE', 'EN', 'ES', 'FR', 'IT', 'XX']) AS t)
LEFT JOIN docs ON ticker = t GROUP BY t UNION ALL SELECT '(all)', count(*) FROM docs""",
    "collection_version": f"{stem(DOCS)} {DIGESTS} docs",
    "many_companies": r"""WITH names AS (
  SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]{8,}')) AS w FROM benchmark),
said AS (
  SELECT DISTINCT conv_id, turn, unnest(regexp_extract_all(lower(text), '[\p{L}\p{M}\p{N}_]+')) AS w FROM conversations)
SELECT c.conv_id, c.turn, coalesce(n.companies, '') AS companies FROM conversations c LEFT JOIN (
  SELECT conv_id, turn, string_agg(upper(w), ',' ORDER BY upper(w)) AS companies FROM said JOIN names USING (w) GROUP BY ALL) n
ON n.conv_id = c.conv_id AND n.turn = c.turn""",
    "short_question_key": """SELECT item_id AS query_id, doc_id AS id
FROM benchmark b JOIN documents d ON contains(d.text, substr(b.text, 1, 9))""",
    "segmented_term_stats": f"{stem(GROWN, POSTINGS)} SELECT t AS term, df FROM dfs",
    "segmented_bm25": stem(GROWN, POSTINGS, asked(), bm25("asked", "b", 10)) + BM25_ROWS + "b",
    "segmented_bm25_filtered": stem(GROWN, POSTINGS, asked("'XX'"), bm25("asked", "b", 10)) + BM25_ROWS + "b",
    "stored_bm25_pruned": ORACLES["bm25_topk"],
    "stored_bm25_pruned_filtered": ORACLES["bm25_filtered"],
    "page_text_entities": f"""SELECT page_id, CASE WHEN clean = '' THEN '' ELSE clean || chr(10) END
  || 'été ¬it; A \U0001f600 – \ufffd &bogus; &lt; ©2024 ♥' AS clean FROM ({ORACLES["page_text"]})""",
    "stored_dense_topk": ORACLES["dense_topk"],
    "stored_hybrid_gated": ORACLES["hybrid_gated"],
    "replayed_batches": f"""WITH {DOCS} SELECT id, ticker, section,
  md5(CASE WHEN section = 'src3' THEN text || '?' ELSE text END) AS digest FROM docs""",
}

ORACLES |= {
    "collection_peek": f"{stem(GROWN)} SELECT id, ticker, length(text) AS chars FROM docs ORDER BY id LIMIT 3",
    "golden_file": f"""WITH {GOLDEN}
SELECT qid AS query_id, question, qid % 3 <> 0 AS recall_reliable, coalesce(n, 0) AS n_relevant
FROM golden LEFT JOIN (SELECT qid, count(*) AS n FROM key GROUP BY qid) USING (qid)""",
    "sidecar_file": f"{JUDGED} SELECT qid AS query_id, id FROM completed",
    "filing_files": f"""SELECT upper(lang) AS ticker, id, section, digest
FROM ({ORACLES["item_sections"]}) JOIN documents ON doc_id = id""",
}
