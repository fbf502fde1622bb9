"""DuckDB SQL for the registered queries."""

from __future__ import annotations

TOKENS = "list_transform(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+'), lambda t: t[1:64])"
_INDEX = f"""
tok AS (SELECT doc_id, {TOKENS} AS w FROM documents),
post AS (SELECT doc_id, term, count(*) AS tf, any_value(len(w)) AS dl FROM (SELECT doc_id, w, unnest(w) AS term FROM tok) GROUP BY doc_id, term),
stats AS (SELECT count(*) AS n_docs, coalesce(sum(len(w)), 0) AS n_tokens, CASE WHEN count(*) > 0 THEN coalesce(sum(len(w)), 0) / count(*) ELSE 0 END AS avgdl FROM tok),
vocab AS (SELECT term, count(*) AS df, ln(1 + ((any_value(n_docs) - count(*)) + 0.5) / (count(*) + 0.5))::FLOAT AS idf FROM post, stats GROUP BY term)"""


def _terms(phrases: dict[int, list[str]], cap: int) -> str:
    rows = ", ".join(f"({q}, {i}, '{t}')" for q, terms in phrases.items() for i, t in enumerate(terms))
    return f"""
asked AS (SELECT *, least({cap}, CASE WHEN len(query_term) <= 2 THEN 0 WHEN len(query_term) <= 5 THEN 1 ELSE 2 END) AS edits
  FROM (VALUES {rows}) AS t(query_id, qi, query_term)),
cand AS (SELECT query_id, qi, query_term, term, edits, idf FROM asked, vocab WHERE abs(len(query_term) - len(term)) <= edits AND damerau_levenshtein(query_term, term) <= edits),
pair AS (SELECT DISTINCT query_term AS a, term AS b FROM cand),
dp AS (
  SELECT a, b, 0 AS i, range(0, len(b) + 1) AS p2, range(0, len(b) + 1) AS p1 FROM pair
  UNION ALL
  SELECT a, b, i + 1, p1, list_transform(range(0, len(b) + 1), lambda j: j + list_min(list_transform(c[1:j + 1], lambda y, k: y - (k - 1))))
  FROM (SELECT a, b, i, p2, p1, list_transform(range(0, len(b) + 1), lambda k: CASE WHEN k = 0 THEN i + 1 ELSE least(
      p1[k + 1] + 1, p1[k] + (a[i + 1] <> b[k])::INT,
      CASE WHEN i >= 1 AND k > 1 AND a[i + 1] = b[k - 1] AND a[i] = b[k] THEN p2[k - 1] + 1 ELSE 999 END) END) AS c
    FROM dp WHERE i < len(a))),
near AS (SELECT query_id, qi, query_term, term, edits, idf, p1[len(term) + 1] AS distance
  FROM cand JOIN dp ON a = query_term AND b = term AND i = len(a) WHERE p1[len(term) + 1] <= edits)"""


_SCORES = """
best AS (
  SELECT query_id, doc_id, qi, max(((idf::DOUBLE * (1.0 - distance / (edits + 1)::DOUBLE)) * (tf * (1.2::FLOAT::DOUBLE + 1)) / (tf + 1.2::FLOAT::DOUBLE * (1.0 - 0.75::FLOAT::DOUBLE + 0.75::FLOAT::DOUBLE * dl / (SELECT avgdl FROM stats)::FLOAT::DOUBLE)))::FLOAT) AS s
  FROM near JOIN post USING (term) GROUP BY query_id, doc_id, qi),
scored AS (SELECT query_id, doc_id, list_reduce(list(s ORDER BY qi), lambda a, x: (a + x)::FLOAT) AS score FROM best GROUP BY query_id, doc_id)"""


def expand_sql(phrases: dict[int, list[str]], cap: int) -> str:
    return f"WITH RECURSIVE {_INDEX}, {_terms(phrases, cap)} SELECT query_id, qi, query_term, term, distance::INT AS distance, edits::INT AS edits FROM near"


def search_sql(phrases: dict[int, list[str]], cap: int, k: int) -> str:
    return f"""WITH RECURSIVE {_INDEX}, {_terms(phrases, cap)}, {_SCORES}
SELECT query_id, rank::INT AS rank, doc_id, round(score::DOUBLE, 4) AS score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM scored) WHERE rank <= {k}"""


_FNV = "list_reduce(list_transform(string_split(term, ''), lambda c: ascii(c)::UHUGEINT), lambda h, c: (xor(h, c) * 1099511628211) % 18446744073709551616, 14695981039346656037::UHUGEINT)"
_PRINTS = f"""
words AS (SELECT doc_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+')) AS term FROM documents),
counts AS (SELECT doc_id, term, count(*) AS tf FROM words GROUP BY doc_id, term),
hashes AS (SELECT term, {_FNV} AS h FROM (SELECT DISTINCT term FROM words)),
bits AS (SELECT doc_id, b, sum(CASE WHEN ((h::UBIGINT >> b::UBIGINT) & 1::UBIGINT) = 1 THEN tf ELSE -tf END) AS vote FROM counts JOIN hashes USING (term), range(64) AS t(b) GROUP BY doc_id, b),
prints AS (SELECT d.doc_id, coalesce(sum(CASE WHEN vote > 0 THEN (1::UBIGINT << b::UBIGINT)::HUGEINT ELSE 0 END), 0)::UBIGINT AS fp FROM documents d LEFT JOIN bits USING (doc_id) GROUP BY d.doc_id),
reps AS (SELECT fp, min(doc_id) AS doc_id, count(*) AS copies FROM prints GROUP BY fp),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, bit_count(xor(a.fp, b.fp))::INT AS distance FROM reps a JOIN reps b ON a.doc_id < b.doc_id WHERE bit_count(xor(a.fp, b.fp)) <= 3)"""
_UNIT = "list_transform(embedding, lambda x: CASE WHEN n > 0 THEN x::DOUBLE / n ELSE 0 END::FLOAT)"
_NORMED = f"normed AS (SELECT vec_id, {_UNIT} AS v FROM (SELECT vec_id, embedding, sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) AS n FROM embeddings))"
_DOT = "list_sum(list_transform(list_zip(a.v, q.v), lambda z: z[1]::DOUBLE * z[2]::DOUBLE))"
_SLUG = "regexp_replace(regexp_replace(lower(coalesce({}, '')), '[^0-9a-z]+', '-', 'g'), '^-|-$', '', 'g')"

_PLAIN = "coalesce(html, '')"
for _tag in ("script", "style", "noscript", "nav", "header", "footer", "aside", "form", "head"):
    _PLAIN = f"regexp_replace({_PLAIN}, '<{_tag}(\\s[^>]*)?>.*?</{_tag}>', '', 'gs')"
_PLAIN = f"regexp_replace(regexp_replace({_PLAIN}, '<!--.*?-->', '', 'gs'), '<[^>]*>', '', 'g')"
for _name, _char in (("copy", "©"), ("middot", "·"), ("quot", '"'), ("amp", "&")):
    _PLAIN = f"replace({_PLAIN}, '&{_name};', '{_char}')"
_PAGE_TEXT = f"left(trim(regexp_replace({_PLAIN}, '\\s+', ' ', 'g')), 8000)"

_GRAYS = """
px AS (
  SELECT page_id AS img_id, k % 32 AS x, k // 32 AS y, CASE WHEN page_id % 7 = 6 THEN page_id - 1 ELSE page_id END AS b,
    CASE WHEN page_id % 7 = 6 THEN (k * 5 + page_id) % 3 - 1 ELSE 0 END AS noise FROM pages, range(1024) AS t(k)),
grays AS (SELECT img_id, x, y, greatest((x * (1 + b % 7) + y * (1 + b % 5) + (x * y * (1 + b % 11)) % 37 + ((x + b) * (y + 3 * b)) % (29 + b % 13)) % 256 + noise, 0)::DOUBLE AS g FROM px),
waves AS (SELECT j, n, (CASE WHEN j = 0 THEN sqrt(1 / 32) ELSE sqrt(2 / 32) END * cos(pi() * (2 * n + 1) * j / 64))::FLOAT::DOUBLE AS c FROM range(8) AS a(j), range(32) AS b(n)),
across AS (SELECT img_id, y, j AS k, sum(g * c) AS s FROM grays JOIN waves ON n = x GROUP BY ALL),
coefs AS (SELECT img_id, j * 8 + k AS i, sum(s * c)::FLOAT AS c FROM across JOIN waves ON n = y GROUP BY ALL),
middle AS (SELECT img_id, (((list(c ORDER BY c))[32]::DOUBLE + (list(c ORDER BY c))[33]::DOUBLE) / 2)::FLOAT AS m FROM coefs GROUP BY img_id),
prints AS (SELECT img_id AS doc_id, coalesce(sum(CASE WHEN c > m THEN (1::UBIGINT << i::UBIGINT)::HUGEINT ELSE 0 END), 0)::UBIGINT AS fp FROM coefs JOIN middle USING (img_id) GROUP BY img_id)"""
_GROUPED = """
links AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs),
reach AS (SELECT doc_id AS a, doc_id AS b FROM reps UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
least AS (SELECT a AS doc_id, min(b) AS group_id FROM reach GROUP BY a),
labelled AS (SELECT fp, copies, group_id FROM reps JOIN least USING (doc_id)),
sizes AS (SELECT group_id, sum(copies)::BIGINT AS size FROM labelled GROUP BY group_id HAVING sum(copies) >= 2)
SELECT group_id, size, doc_id FROM prints JOIN labelled USING (fp) JOIN sizes USING (group_id)"""
_BLURRED = "greatest(0, least(255, (list_sum(list_transform(range(33), lambda t: taps[t + 1] * line[greatest(0, least(31, p + t - 16)) + 1]))::BIGINT * reciprocal) >> 16))"

STATIC: dict[str, str] = {
    "tokens_per_doc": f"SELECT doc_id, len({TOKENS})::INT AS n_tokens FROM documents",
    "term_frequency": f"SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({TOKENS}) AS term FROM documents) GROUP BY doc_id, term",
    "corpus_stats": f"WITH {_INDEX} SELECT n_docs::BIGINT AS n_docs, n_tokens::BIGINT AS n_tokens, round(avgdl, 6) AS avgdl FROM stats",
    "vocab_df_idf": f"WITH {_INDEX} SELECT term, df, round(idf::DOUBLE, 4) AS idf FROM vocab",
    "postings_offsets": f"""WITH {_INDEX} SELECT term, df, (sum(df) OVER (ORDER BY term) - df)::BIGINT AS "first", (sum(df) OVER (ORDER BY term))::BIGINT AS "end" FROM vocab""",
    "fnv1a64_terms": f"SELECT term, '0x' || lpad(lower(to_hex({_FNV}::UBIGINT)), 16, '0') AS hash FROM (SELECT DISTINCT unnest({TOKENS}) AS term FROM documents)",
    "simhash_fingerprint": f"WITH {_PRINTS} SELECT doc_id, '0x' || lpad(lower(to_hex(fp)), 16, '0') AS fingerprint FROM prints",
    "simhash_pairs": f"WITH {_PRINTS} SELECT a, b, distance FROM pairs",
    "simhash_first_pairs": f"WITH {_PRINTS} SELECT a, b, distance FROM pairs ORDER BY a, b LIMIT 12",
    "simhash_groups": f"WITH RECURSIVE {_PRINTS}, {_GROUPED}",
    "dct8x8": f"WITH {_GRAYS} SELECT img_id, i::INT AS i, round(c::DOUBLE, 2) + 0.0 AS coefficient FROM coefs",
    "phash": f"WITH {_GRAYS} SELECT doc_id AS img_id, '0x' || lpad(lower(to_hex(fp)), 16, '0') AS hash FROM prints",
    "phash_groups": f"""WITH RECURSIVE {_GRAYS},
reps AS (SELECT fp, min(doc_id) AS doc_id, count(*) AS copies FROM prints GROUP BY fp),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b FROM reps a JOIN reps b ON a.doc_id < b.doc_id WHERE bit_count(xor(a.fp, b.fp)) <= 8), {_GROUPED}""",
    "planted_recall": f"""WITH {_GRAYS}
SELECT count(*) AS n, count(*) FILTER (WHERE bit_count(xor(a.fp, b.fp)) <= 8) AS found FROM prints a JOIN prints b ON b.doc_id = a.doc_id - 1 WHERE a.doc_id % 7 = 6""",
    "gaussian_blur": f"""WITH raw AS (SELECT list(exp(-(k * k) / 128) ORDER BY k) AS r FROM range(-16, 17) AS t(k)),
taps AS (SELECT list_transform(r, lambda v: floor(v / list_sum(r) * 4096 + 0.5)::BIGINT) AS taps FROM raw),
weights AS (SELECT taps, floor(65536 / list_sum(taps) + 0.5)::BIGINT AS reciprocal FROM taps),
px AS (
  SELECT page_id AS i, k % 4 AS c, (k // 4) % 32 AS x, k // 128 AS y FROM pages, range(4096) AS t(k)),
lines AS (SELECT i, c, y, list(CASE WHEN c = 3 THEN 255 ELSE (x * (1 + i % 5) + y * (1 + i % 3) + 40 * c + i) // 8 * 8 % 256 END ORDER BY x) AS line FROM px GROUP BY i, c, y),
wide AS (SELECT i, c, y, list_transform(range(32), lambda p: {_BLURRED}) AS v FROM lines, weights),
columns_ AS (SELECT i, c, x, list(v[x + 1] ORDER BY y) AS line FROM wide, range(32) AS t(x) GROUP BY i, c, x),
high AS (SELECT i, c, x, list_transform(range(32), lambda p: {_BLURRED}) AS v FROM columns_, weights),
bytes AS (SELECT i, string_agg(printf('%02x', v[y + 1]::INT), '' ORDER BY y, x, c) AS h FROM high, range(32) AS t(y) GROUP BY i)
SELECT i AS img_id, sha256(unhex(h)) AS sha256 FROM bytes""",
    "page_text": f"SELECT page_id, {_PAGE_TEXT} AS text FROM pages",
    "page_prompt": f"""WITH t AS (SELECT page_id, {_PAGE_TEXT} AS text FROM pages)
SELECT page_id, '[{{"role":"system","content":"Answer from the page."}},{{"role":"user","content":' || to_json(CASE WHEN text = '' THEN 'There is no readable page content to work with.' ELSE 'PAGE CONTENT:' || chr(10) || text || chr(10) || chr(10) || 'TASK:' || chr(10) || 'Summarise the page.' END) || '}}]' AS messages FROM t""",
    "page_links": """WITH l AS (SELECT page_id, regexp_extract_all(html, '<a [^>]*href="([^"]+)"', 1) AS links, regexp_extract_all(html, '<img [^>]*src="([^"]+)"', 1) AS images FROM pages),
n AS (SELECT page_id, len(links) AS k, list_concat(links, images) AS urls FROM l)
SELECT page_id, i::INT AS n, CASE WHEN i < k THEN 'link' ELSE 'image' END AS kind, urls[i + 1] AS url FROM n, range(len(urls)) AS t(i)""",
    "page_metadata": "SELECT page_id, 'page' AS name, page_id || ', ' || page_id AS content FROM pages UNION ALL SELECT page_id, 'og:url', url FROM pages",
    "url_params": """SELECT page_id, '{' || array_to_string(list_transform(list_filter(string_split(regexp_extract(url, '\\?([^#]*)', 1), '&'), lambda p: p <> ''),
  lambda p: to_json(url_decode(split_part(p, '=', 1))) || ':' || to_json(url_decode(split_part(p, '=', 2)))), ',') || '}' AS params FROM pages""",
    "image_variants": """WITH p AS (SELECT page_id, split_part(url || '/pic.png', '?', 1) AS path FROM pages),
k AS (SELECT page_id, path, unnest(['webply', regexp_extract(path, '\\.([^./]+)$', 1)]) AS type FROM p)
SELECT page_id, media, type, path || '?width=' || width || '&format=' || type || '&optimize=medium' AS url FROM k, (VALUES ('(min-width: 600px)', 2000), ('', 750)) AS b(media, width)""",
    "block_config": f"""SELECT n_regionkey AS block_id, '{{' || string_agg('"' || k || '":["' || n_nationkey || '","' || n_name || '"]', ',' ORDER BY k) || '}}' AS config
FROM (SELECT *, {_SLUG.format("n_name")} AS k FROM nation) GROUP BY n_regionkey""",
    "subsequence_score_topk": """WITH chars AS (SELECT doc_id, list_filter(string_split(lower(coalesce(text, '')), ''), lambda c: c <> '') AS cs FROM documents),
walked AS (SELECT doc_id, list_reduce(list_transform(cs, lambda c, k: {'at': 1, 'run': 0, 'score': 0.0::DOUBLE, 'c': c, 'i': k - 1, 'n': len(cs)}), lambda s, e:
    CASE WHEN s.at <= 7 AND 'thering'[s.at] = e.c
    THEN {'at': s.at + 1, 'run': s.run + 1, 'score': s.score + (1.0::DOUBLE + s.run * 2 + CASE WHEN e.i = 0 THEN 3 WHEN regexp_matches(s.c, '[ \\-/_.,:(]') THEN 2 ELSE 0 END + (e.n - e.i) / e.n::DOUBLE), 'c': e.c, 'i': e.i, 'n': e.n}
    ELSE {'at': s.at, 'run': 0, 'score': s.score, 'c': e.c, 'i': e.i, 'n': e.n} END, {'at': 1, 'run': 0, 'score': 0.0::DOUBLE, 'c': '', 'i': 0, 'n': 0}) AS s FROM chars)
SELECT doc_id, round(s.score, 6) AS score FROM walked WHERE s.at > 7 AND s.score > 0 ORDER BY 2 DESC, 1 LIMIT 10""",
    "vector_normalize": f"WITH {_NORMED} SELECT vec_id, list_transform(v, lambda x: round(x::DOUBLE, 4) + 0.0) AS embedding FROM normed",
    "cosine_scores": f"WITH {_NORMED} SELECT q.vec_id AS query_id, a.vec_id, round({_DOT}, 5) + 0.0 AS score FROM normed a, normed q WHERE q.vec_id % 100 = 0",
    "knn_topk": """WITH normed AS (SELECT vec_id, embedding, sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) AS n FROM embeddings),
scored AS (SELECT q.vec_id AS query_id, a.vec_id, round(list_sum(list_transform(list_zip(a.embedding, q.embedding), lambda z: z[1]::DOUBLE * z[2]::DOUBLE)) / (a.n * q.n), 5) + 0.0 AS score
  FROM normed a, normed q WHERE q.vec_id % 100 = 0 AND a.vec_id <> q.vec_id)
SELECT query_id, rank::INT AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored) WHERE rank <= 8""",
    "truncation_delta": f"""WITH {_NORMED},
short AS (SELECT vec_id, {_UNIT} AS v FROM (SELECT vec_id, e AS embedding, sqrt(list_sum(list_transform(e, lambda x: x::DOUBLE * x::DOUBLE))) AS n FROM (SELECT vec_id, embedding[1:32] AS e FROM embeddings))),
scored AS (SELECT q.vec_id AS query_id, a.vec_id, round({_DOT}, 5) AS s FROM normed a, normed q WHERE q.vec_id % 100 = 0 AND a.vec_id <> q.vec_id),
near AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id) <= 8),
cut AS (SELECT s, round({_DOT}, 5) AS t FROM near JOIN short a ON a.vec_id = near.vec_id JOIN short q ON q.vec_id = near.query_id)
SELECT count(*) AS n, 0::BIGINT AS n_unmatched, count(*) FILTER (WHERE s <> t) AS n_different, round(max(abs(s - t)), 4) AS max_delta FROM cut""",
    "term_ids": f"""WITH w AS (SELECT doc_id, {TOKENS} AS w FROM documents),
first AS (SELECT term, min((doc_id, i)) AS f FROM (SELECT doc_id, unnest(w) AS term, generate_subscripts(w, 1) AS i FROM w) GROUP BY term)
SELECT term, row_number() OVER (ORDER BY f) - 1 AS term_id FROM first""",
    "longest_document": f"SELECT coalesce(max(len({TOKENS})), 0)::INT AS max_tokens FROM documents",
    "first_documents": "SELECT doc_id, length(coalesce(text, ''))::INT AS n_chars FROM documents ORDER BY doc_id LIMIT 50",
    "planted_bits": f"""WITH {_GRAYS}
SELECT count(*) AS n, 0::BIGINT AS n_unmatched, count(*) FILTER (WHERE a.fp <> b.fp) AS n_different, round(avg(bit_count(xor(a.fp, b.fp))), 6) AS mean_bits FROM prints a JOIN prints b ON b.doc_id = a.doc_id - 1 WHERE a.doc_id % 7 = 6""",
    "stream_usage": """SELECT stream_id, usage, CASE WHEN coalesce(usage, 0) = 0 THEN 'Done' ELSE 'Done · ' || usage || ' tokens/s' END AS status
FROM (SELECT conv_id AS stream_id, arg_max(length(coalesce(text, '')), turn) FILTER (WHERE turn % 2 = 1)::INT AS usage FROM conversations GROUP BY conv_id)""",
    "slugify": f"""SELECT page_id, slug, array_to_string(list_transform(string_split(slug, '-'), lambda w, i: CASE WHEN i > 1 AND regexp_matches(w, '^[a-z]') THEN upper(w[1]) || w[2:] WHEN i > 1 THEN '-' || w ELSE w END), '') AS camel
FROM (SELECT page_id, {_SLUG.format("url")} AS slug FROM pages)""",
    "url_parts": """SELECT page_id, CASE WHEN len(p) > 1 THEN array_to_string(p[1:len(p) - 1], '/') ELSE '' END AS path, coalesce(regexp_replace(p[len(p)], '\\.[^.]*$', ''), '') AS name,
  CASE WHEN regexp_matches(url, '^(?i)(https?:|data:|blob:)') THEN url ELSE '/base' || url END AS resolved, regexp_replace(url, '/+$', '') AS bare
FROM (SELECT page_id, url, list_filter(string_split(regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1), '/'), lambda s: s <> '') AS p FROM pages)""",
    "chat_messages_json": """SELECT conv_id, turn, '[{"role":"system","content":"Answer briefly."},{"role":"user","content":' || to_json(coalesce(text, '')) || '}]' AS messages FROM conversations""",
    "chunk_fold": "SELECT conv_id AS stream_id, string_agg(coalesce(text, ''), '' ORDER BY turn) AS text FROM conversations GROUP BY conv_id",
    "chunk_reconcile": """SELECT conv_id AS stream_id, list_reduce(list(coalesce(text, '') ORDER BY turn), lambda a, c: CASE WHEN a <> '' AND starts_with(c, a) THEN c ELSE a || c END, '') AS text
FROM (SELECT conv_id, turn, text FROM conversations UNION ALL SELECT conv_id, 1000000, string_agg(coalesce(text, ''), '' ORDER BY turn) || '!' FROM conversations GROUP BY conv_id) GROUP BY conv_id""",
    "sse_fold": "SELECT conv_id AS stream_id, string_agg(coalesce(text, ''), '' ORDER BY turn) AS text FROM conversations WHERE role = 'assistant' GROUP BY conv_id",
    "rum_weighted_counts": """SELECT event_type, count(*) AS n_sampled, (count(*) * 10)::BIGINT AS n_estimated, round(sum(value * 10), 2) AS value_estimated
FROM events WHERE ('0x' || md5(event_id::VARCHAR)[1:8])::BIGINT % 10 = 0 GROUP BY event_type""",
    "latest_value": "SELECT user_id, event_type, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1",
    "field_concat": "SELECT c_custkey, concat_ws(' ', nullif(c_name, ''), nullif(c_mktsegment, '')) AS line FROM customer",
    "result_list": f"""WITH {_INDEX}, hits AS (SELECT doc_id, tf FROM post WHERE term = 'the' ORDER BY tf DESC, doc_id LIMIT 20)
SELECT doc_id, tf, coalesce(nullif(source, ''), '#') AS link, coalesce(nullif(lang, ''), nullif(source, ''), '(untitled)') AS title FROM hits JOIN documents USING (doc_id)""",
}
