"""The same results stated in SQL, written without looking at the Spark plans.

Everything is spelled out from the definitions: similar terms are found by
comparing all terms, neighbours by comparing all vectors.
"""

from __future__ import annotations

# Fixed values, written out so that a wrong constant in the library shows.
FIELD_WEIGHTS = {"title": 3.0, "synopsis": 1.0, "authors": 2.0, "genres": 1.5, "publisher": 1.0}
MAPPING_BOOSTS = {"title": 2.0}
STYLE_LABELS = {
    "keyword": "Title keywords",
    "author": "Author-based",
    "subject": "Subject/conceptual",
    "year": "Year + subject",
}

TOKENS = r"'[\p{L}\p{M}\p{N}_]+(?:[''’.][\p{L}\p{M}\p{N}_]+)*'"
SPACES = r"'[\s\p{Z}]+'"
SEED = 7

ORACLES: dict[str, str] = {}


def words(text: str) -> str:
    return f"regexp_extract_all(lower({text}), {TOKENS})"


# --- shared parts ---------------------------------------------------------------

DOCUMENTS = """
corpus AS (
  SELECT CAST(doc_id AS VARCHAR) AS doc_id, split_part(text, chr(10), 1) AS title, text AS synopsis,
         CASE WHEN source IS NULL OR source = '' THEN CAST([] AS VARCHAR[]) ELSE [source] END AS authors,
         CASE WHEN lang IS NULL OR lang = '' THEN CAST([] AS VARCHAR[]) ELSE [lang] END AS genres,
         coalesce(source, '') AS publisher,
         CASE WHEN lang = 'en' THEN 'covers/' || doc_id
              WHEN lang <> 'es' THEN 'other/' || doc_id ELSE '' END AS book_picture
  FROM documents)"""

BOOKS = """
books AS (
  SELECT o.o_orderkey AS id, o.o_custkey, 'Order ' || o.o_orderkey AS title,
         'Order ' || o.o_orderkey || ' by ' || c.c_name || '. Published in ' || year(o.o_orderdate)
           || '. Subjects: ' || o.o_orderpriority || ', ' || c.c_mktsegment || '.' AS synopsis
  FROM orders o LEFT JOIN customer c ON c.c_custkey = o.o_custkey)"""

ASSEMBLED = BOOKS + """,
assembled AS (
  SELECT b.id, b.title, b.synopsis, p.c_name AS publisher,
         list_sort(coalesce(list(DISTINCT s.s_name) FILTER (s.s_name IS NOT NULL), [])) AS authors,
         list_sort(coalesce(list(DISTINCT g.p_name) FILTER (g.p_name IS NOT NULL), [])) AS genres
  FROM books b
  JOIN customer p ON p.c_custkey = b.o_custkey
  LEFT JOIN lineitem l ON l.l_orderkey = b.id
  LEFT JOIN supplier s ON s.s_suppkey = l.l_suppkey
  LEFT JOIN lineitem m ON m.l_orderkey = b.id
  LEFT JOIN part g ON g.p_partkey = m.l_partkey
  GROUP BY b.id, b.title, b.synopsis, p.c_name)"""

ORDER_CORPUS = ASSEMBLED + """,
corpus AS (
  SELECT CAST(id AS VARCHAR) AS doc_id, title, synopsis, authors, genres, publisher,
         '' AS book_picture
  FROM assembled)"""

REQUESTS = """
requests AS (
  SELECT CAST(item_id AS VARCHAR) AS query_id, text AS q,
         CASE WHEN item_id % 3 = 0 THEN 5 ELSE item_id % 50 + 1 END AS lim,
         CAST(CASE WHEN item_id % 4 = 0 THEN 0.02 ELSE 0.0 END AS DOUBLE) AS threshold
  FROM benchmark)"""

FREE_QUERIES = "queries AS (SELECT CAST(item_id AS VARCHAR) AS query_id, text AS q FROM benchmark)"

POSTINGS = f"""
tokens AS (
  SELECT doc_id, 'title' AS field, unnest({words('title')}) AS term FROM corpus
  UNION ALL SELECT doc_id, 'synopsis', unnest({words('synopsis')}) FROM corpus
  UNION ALL SELECT doc_id, 'authors', unnest({words('author')})
            FROM (SELECT doc_id, unnest(authors) AS author FROM corpus)
  UNION ALL SELECT doc_id, 'publisher', unnest({words('publisher')}) FROM corpus
  UNION ALL SELECT DISTINCT doc_id, 'genres', unnest(genres) FROM corpus),
postings AS (SELECT doc_id, field, term, count(*) AS tf FROM tokens GROUP BY ALL),
lengths AS (SELECT doc_id, field, sum(tf) AS dl FROM postings GROUP BY ALL),
field_stats AS (SELECT field, count(*) AS n_docs, avg(dl) AS avgdl FROM lengths GROUP BY ALL),
term_stats AS (SELECT field, term, count(*) AS df FROM postings GROUP BY ALL)"""

QUERY_TERMS = f"""
query_terms AS (
  SELECT query_id, 'text' AS kind, q_term, count(*) AS qtf
  FROM (SELECT query_id, unnest({words('q')}) AS q_term FROM queries) GROUP BY ALL
  UNION ALL SELECT query_id, 'keyword', q, 1 FROM queries WHERE q <> ''),
vocabulary AS (
  SELECT CASE WHEN field = 'genres' THEN 'keyword' ELSE 'text' END AS kind, field, term, df
  FROM term_stats)"""

# The edit distance of this engine counts bytes, so the letters of the test
# tables that take more than one byte are replaced by letters not in use.
WIDE, NARROW = "ßäçèéêíñóöü", "ABCDEFGHIJK"


def narrow(text: str) -> str:
    return f"translate({text}, '{WIDE}', '{NARROW}')"


ALLOWED = "CASE WHEN length(q_term) <= 2 THEN 0 WHEN length(q_term) <= 5 THEN 1 ELSE 2 END"

FUZZY = f"""
wanted AS (SELECT DISTINCT kind, q_term, {ALLOWED} AS allowed FROM query_terms),
known AS (SELECT DISTINCT kind, term FROM vocabulary),
near AS (
  SELECT kind, q_term, term, allowed,
         damerau_levenshtein({narrow('q_term')}, {narrow('term')}) AS edits
  FROM wanted JOIN known USING (kind)
  WHERE abs(length(q_term) - length(term)) <= allowed),
expanded AS (
  SELECT kind, field, q_term, term, edits, df,
         1 - CAST(edits AS DOUBLE) / least(length(q_term), length(term)) AS boost
  FROM near JOIN vocabulary USING (kind, term) WHERE edits <= allowed
  QUALIFY row_number() OVER (PARTITION BY field, q_term ORDER BY boost DESC, term) <= 50)"""

PLAIN = """
expanded AS (
  SELECT kind, field, q_term, term, 0 AS edits, df, CAST(1 AS DOUBLE) AS boost
  FROM (SELECT DISTINCT kind, q_term FROM query_terms) w
  JOIN vocabulary v USING (kind) WHERE v.term = w.q_term)"""


def weights(fields: dict[str, float]) -> str:
    rows = ", ".join(f"('{name}', CAST({w} AS DOUBLE))" for name, w in fields.items())
    return f"field_weights(field, fw) AS (VALUES {rows})"


ALL_FIELDS = {f: w * MAPPING_BOOSTS.get(f, 1.0) for f, w in FIELD_WEIGHTS.items()}
SYNOPSIS_ONLY = {"synopsis": 1.0}


def bm25(depth: int, fields: dict[str, float], fuzzy: bool) -> str:
    """Needs ``corpus`` and ``queries``; gives ``bm25(query_id, rank, doc_id, score)``."""
    return f"""{POSTINGS}, {QUERY_TERMS}, {FUZZY if fuzzy else PLAIN}, {weights(fields)},
blended AS (SELECT field, q_term, max(df) AS top_df FROM expanded GROUP BY ALL),
query_weights AS (
  SELECT query_id, field, term,
         sum(qtf * boost * fw * ln(1 + (n_docs - top_df + 0.5) / (top_df + 0.5))) AS weight
  FROM query_terms JOIN expanded USING (kind, q_term) JOIN blended USING (field, q_term)
  JOIN field_stats USING (field) JOIN field_weights USING (field)
  GROUP BY ALL),
field_scores AS (
  SELECT query_id, doc_id, field,
         sum(weight * tf / (tf + 1.2 * (1 - norm + norm * dl / avgdl))) AS score
  FROM query_weights JOIN postings USING (field, term) JOIN lengths USING (doc_id, field)
  JOIN (SELECT field, avgdl, CASE WHEN field = 'genres' THEN 0.0 ELSE 0.75 END AS norm
        FROM field_stats) USING (field)
  GROUP BY ALL),
bm25 AS (
  SELECT query_id, doc_id, score,
         row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank
  FROM (SELECT query_id, doc_id, round(max(score), 6) AS score FROM field_scores GROUP BY ALL)
  QUALIFY rank <= {depth})"""


def hashed(source: str, key: str, text: str, out: str) -> str:
    """Word-hash vectors of a text column: ``out(key, vec)``."""
    return f"""
{out}_slots AS (
  SELECT {key}, CAST('0x' || substr(md5(word), 1, 9) AS UBIGINT) AS h
  FROM (SELECT {key}, unnest({words(text)}) AS word FROM {source})),
{out}_cells AS (
  SELECT {key}, CAST((h // 16) % 384 AS BIGINT) AS pos,
         CAST(sum(CASE WHEN h % 2 = 0 THEN 1 ELSE -1 END) AS DOUBLE) AS x
  FROM {out}_slots GROUP BY ALL),
{out}_norms AS (SELECT {key}, sqrt(sum(x * x)) AS norm FROM {out}_cells GROUP BY ALL),
{out}_unit AS (
  SELECT {key}, pos, CAST(CAST(CASE WHEN norm = 0 THEN 0 ELSE x / norm END AS FLOAT) AS DOUBLE) AS x
  FROM {out}_cells JOIN {out}_norms USING ({key})),
{out} AS (
  SELECT {key}, list(coalesce(x, 0) ORDER BY pos) AS vec
  FROM (SELECT DISTINCT {key}, unnest(range(384)) AS pos FROM {source})
  LEFT JOIN {out}_unit USING ({key}, pos) GROUP BY ALL)"""


DOC_TEXT = "title || '. ' || synopsis"
CHECKSUM = "round(list_sum(list_transform(vec, lambda x, i: x * i)), 6)"


def knn(depth: int) -> str:
    """Needs ``qvec(query_id, vec)`` and ``dvec(doc_id, vec)``; gives ``knn``."""
    return f"""
knn AS (
  SELECT query_id, doc_id, score,
         row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank
  FROM (SELECT query_id, doc_id, round(list_dot_product(qvec.vec, dvec.vec), 6) + 0 AS score
        FROM qvec, dvec)
  QUALIFY rank <= {depth})"""


def fused(lexical: str, dense: str, out: str = "fused") -> str:
    """Reciprocal rank fusion of two ranked relations."""
    return f"""
{out} AS (
  SELECT *, row_number() OVER (PARTITION BY query_id
              ORDER BY score DESC, bm25_rank NULLS LAST, knn_rank NULLS LAST) AS rank
  FROM (SELECT coalesce(a.query_id, b.query_id) AS query_id, coalesce(a.doc_id, b.doc_id) AS doc_id,
               a.rank AS bm25_rank, b.rank AS knn_rank,
               coalesce(1 / CAST(60 + a.rank AS DOUBLE), 0) + coalesce(1 / CAST(60 + b.rank AS DOUBLE), 0)
                 AS score
        FROM {lexical} a FULL JOIN {dense} b ON a.query_id = b.query_id AND a.doc_id = b.doc_id))"""


def overlap(query: str, text: str) -> str:
    q = f"list_distinct({words(query)})"
    return f"round(len(list_intersect({q}, {words(text)})) / CAST(len({q}) AS DOUBLE), 6)"


# --- documents ------------------------------------------------------------------

ORACLES["assemble_documents"] = ORACLES["assemble_fanout"] = f"""
WITH {ASSEMBLED}
SELECT id AS book_id, title, synopsis, publisher,
       array_to_string(authors, '|') AS authors, array_to_string(genres, '|') AS genres
FROM assembled"""

ORACLES["normalize_documents"] = f"""
WITH {DOCUMENTS}
SELECT doc_id, title, synopsis, array_to_string(authors, '|') AS authors,
       len(authors) AS n_authors, array_to_string(genres, '|') AS genres, publisher, book_picture
FROM corpus"""

ORACLES["build_text"] = f"""
WITH {DOCUMENTS} SELECT doc_id, {DOC_TEXT} AS text FROM corpus"""

ORACLES["corpus_scan"] = ORACLES["corpus_created"] = f"""
WITH {DOCUMENTS}
SELECT doc_id, title, synopsis FROM corpus WHERE doc_id <> '' AND title <> ''"""

ORACLES["corpus_page"] = f"""
WITH {BOOKS}
SELECT CAST(id AS VARCHAR) AS doc_id, title, synopsis
FROM books JOIN customer ON c_custkey = o_custkey ORDER BY doc_id LIMIT 2000"""

ORACLES["corpus_half"] = f"""
WITH {BOOKS},
numbered AS (
  SELECT CAST(id AS VARCHAR) AS doc_id, title, synopsis, row_number() OVER (ORDER BY CAST(id AS VARCHAR)) AS n,
         count(*) OVER () AS total
  FROM books JOIN customer ON c_custkey = o_custkey)
SELECT doc_id, title, synopsis FROM numbered WHERE n <= total // 2"""

ORACLES["corpus_count"] = "SELECT count(*) AS n_documents FROM documents"

ORACLES["embed_documents"] = f"""
WITH {DOCUMENTS}, {hashed('corpus', 'doc_id', DOC_TEXT, 'dvec')}
SELECT doc_id, pos, round(x, 6) AS x FROM dvec_unit WHERE x <> 0"""

ORACLES["embed_queries"] = f"""
WITH {FREE_QUERIES}, {hashed('queries', 'query_id', 'q', 'qvec')}
SELECT query_id, len(vec) AS dim, {CHECKSUM} AS vec_sum FROM qvec"""

ORACLES["bulk_index"] = f"""
WITH {ORDER_CORPUS}, {hashed('corpus', 'doc_id', DOC_TEXT, 'dvec')}
SELECT doc_id, title, synopsis, array_to_string(authors, '|') AS authors,
       array_to_string(genres, '|') AS genres, publisher, book_picture,
       len(vec) AS dim, {CHECKSUM} AS vec_sum
FROM corpus JOIN dvec USING (doc_id)"""

# --- events ---------------------------------------------------------------------

ENVELOPES = """
envelopes AS (
  SELECT event_id, ts, user_id, event_type AS routing_key,
         CASE WHEN event_id % 13 = 0 THEN 'malformed' WHEN event_id % 11 = 0 THEN 'no title' END AS reason,
         CASE WHEN event_id % 11 = 0 THEN '' ELSE 'User ' || user_id END AS title,
         CASE WHEN event_id % 17 = 0 THEN '' ELSE event_type || ' ' || value END AS synopsis,
         '{"' || CASE WHEN event_id % 7 = 0 THEN 'bookId' ELSE 'id' END || '":"' || user_id
           || '","title":"' || CASE WHEN event_id % 11 = 0 THEN '' ELSE 'User ' || user_id END || '"'
           || CASE WHEN event_id % 17 = 0 THEN ''
                   ELSE ',"synopsis":"' || event_type || ' ' || value || '"' END
           || CASE WHEN event_id % 13 = 0 THEN '' ELSE '}' END AS body
  FROM events),
arrived AS (SELECT * FROM envelopes WHERE routing_key = 'signup'),
versions AS (
  SELECT CAST(user_id AS VARCHAR) AS doc_id, event_id, ts, title, synopsis
  FROM arrived WHERE reason IS NULL),
newest AS (
  SELECT * FROM versions
  QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY ts DESC, event_id DESC) = 1)"""

ORACLES["bulk_index_counts"] = f"""
WITH {ENVELOPES}
SELECT count(*) FILTER (reason IS NULL) AS indexed, count(*) FILTER (reason IS NOT NULL) AS failed,
       count(*) AS total
FROM envelopes"""

ORACLES["upsert_latest"] = f"""
WITH {ENVELOPES}
SELECT doc_id, event_id, title, synopsis, '' AS authors, '' AS publisher, '' AS book_picture FROM newest"""

ORACLES["upsert_patched"] = f"""
WITH {ENVELOPES}
SELECT doc_id, arg_max(title, (ts, event_id)) AS title,
       coalesce(arg_max(synopsis, (ts, event_id)) FILTER (synopsis <> ''), '') AS synopsis
FROM versions GROUP BY doc_id"""

ORACLES["parse_events"] = f"""
WITH {ENVELOPES}
SELECT event_id, CAST(user_id AS VARCHAR) AS doc_id, title, synopsis, '' AS book_picture
FROM arrived WHERE reason IS NULL"""

ORACLES["rejected_events"] = f"""
WITH {ENVELOPES} SELECT event_id, reason, body FROM arrived WHERE reason IS NOT NULL"""

ORACLES["stream_upsert"] = ORACLES["stream_compacted"] = ORACLES["stream_restarted"] = ORACLES["stream_replayed"] = ORACLES["stream_event_log"] = f"""
WITH {ENVELOPES}, {hashed('newest', 'doc_id', DOC_TEXT, 'dvec')}
SELECT doc_id, title, synopsis, '' AS authors, '' AS publisher, '' AS book_picture,
       {CHECKSUM} AS vec_sum
FROM newest JOIN dvec USING (doc_id)"""

ORACLES["stream_latest_by_key"] = f"""
WITH {ENVELOPES} SELECT doc_id, event_id, title, synopsis FROM newest"""

ORACLES["stream_dedup"] = f"""
WITH {ENVELOPES} SELECT event_id, routing_key, body FROM envelopes"""

ORACLES["bulk_index_repeated_ids"] = f"""
WITH {DOCUMENTS} SELECT doc_id, 'New ' || title AS title, count(*) OVER () AS n_docs FROM corpus"""

ORACLES["stream_late_events"] = "SELECT event_id, CAST(ts AS TIMESTAMP) AS ts FROM events"

# --- requests -------------------------------------------------------------------

EVENT_REQUESTS = """
complete AS (
  SELECT CAST(event_id AS VARCHAR) AS query_id, event_type AS q,
         CASE WHEN user_id % 10 = 0 THEN 5 ELSE CAST(floor(value) AS BIGINT) END AS "limit",
         CASE WHEN user_id % 10 = 1 THEN CAST(0 AS DOUBLE) ELSE round(value / 50, 4) END AS threshold
  FROM events)"""

ORACLES["query_validate"] = f"""
WITH {EVENT_REQUESTS}
SELECT query_id, q, "limit", threshold,
       CASE WHEN "limit" BETWEEN 1 AND 50 AND threshold BETWEEN 0 AND 1 THEN 1 ELSE 0 END AS ok
FROM complete"""

ORACLES["candidate_depth"] = f"""
WITH {EVENT_REQUESTS}
SELECT query_id, "limit", greatest("limit" * 4, 20) AS fetch_k
FROM complete WHERE "limit" BETWEEN 1 AND 50 AND threshold BETWEEN 0 AND 1"""

# --- lexical retrieval ----------------------------------------------------------

ORACLES["tokenize"] = f"""
WITH {DOCUMENTS}
SELECT doc_id, len({words('synopsis')}) AS n_tokens, array_to_string({words('synopsis')}, ' ') AS tokens
FROM corpus"""

# Words of the scripts that occur: letters with marks between them, digits likewise.
SEGMENTS = (
    r"'_*(?:(?:[\p{Latin}µ]\p{M}*)+(?:[.:''’‘·](?:[\p{Latin}µ]\p{M}*)+)*|\p{Nd}+(?:[.,;''’‘]\p{Nd}+)*)+"
    r"(?:_+(?:(?:[\p{Latin}µ]\p{M}*)+(?:[.:''’‘·](?:[\p{Latin}µ]\p{M}*)+)*|\p{Nd}+(?:[.,;''’‘]\p{Nd}+)*)+)*_*"
    r"|[\p{Katakana}ー]+|\p{Han}|\p{Hiragana}'"
)
SEGMENTED = f"regexp_extract_all(lower('東京タワー と ' || synopsis || ' データ処理 snake_case 3.14 1,000 a:b'), {SEGMENTS})"
ORACLES["tokenize_unicode"] = f"""
WITH {DOCUMENTS}
SELECT doc_id, len({SEGMENTED}) AS n_tokens, array_to_string({SEGMENTED}, ' ') AS tokens FROM corpus"""

ORACLES["term_stats"] = f"""
WITH {DOCUMENTS}, {POSTINGS} SELECT field, term, df FROM term_stats"""

ORACLES["field_stats"] = f"""
WITH {DOCUMENTS}, {POSTINGS} SELECT field, n_docs, round(avgdl, 6) AS avgdl FROM field_stats"""

ORACLES["bm25_single_field"] = f"""
WITH {DOCUMENTS}, {FREE_QUERIES}, {bm25(20, SYNOPSIS_ONLY, False)} SELECT * FROM bm25"""

ORACLES["bm25_multi_field"] = f"""
WITH {DOCUMENTS}, {FREE_QUERIES}, {bm25(20, ALL_FIELDS, False)} SELECT * FROM bm25"""

ORACLES["bm25_multi_field_fuzzy"] = f"""
WITH {DOCUMENTS}, {FREE_QUERIES}, {bm25(20, ALL_FIELDS, True)} SELECT * FROM bm25"""

ORACLES["fuzzy_expand"] = f"""
WITH {DOCUMENTS}, {FREE_QUERIES}, {POSTINGS}, {QUERY_TERMS}, {FUZZY}
SELECT field, q_term, term, edits, round(boost, 6) AS boost, df FROM expanded"""

CHANGED = f"""
{DOCUMENTS.replace('corpus AS', 'before AS')}, {ENVELOPES},
corpus AS (
  SELECT doc_id, title, CASE WHEN list_contains(genres, 'de') THEN title || ' ' || publisher
         ELSE synopsis END AS synopsis, authors, genres, publisher
  FROM before
  UNION ALL
  SELECT 'u' || doc_id, title, synopsis, CAST([] AS VARCHAR[]), CAST([] AS VARCHAR[]), '' FROM newest)"""

ORACLES["index_update_stats"] = f"""
WITH {CHANGED}, {POSTINGS} SELECT field, n_docs, round(avgdl, 6) AS avgdl FROM field_stats"""

ORACLES["index_update_terms"] = f"""
WITH {CHANGED}, {POSTINGS} SELECT field, term, df FROM term_stats"""

ORACLES["index_update_search"] = f"""
WITH {CHANGED}, {FREE_QUERIES}, {bm25(20, ALL_FIELDS, False)} SELECT * FROM bm25"""

# --- dense retrieval ------------------------------------------------------------

CENTRES = """
cells AS (
  SELECT vec_id, label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings),
means AS (SELECT label, pos, avg(CAST(x AS DOUBLE)) AS x FROM cells GROUP BY ALL),
centre_norms AS (SELECT label, sqrt(sum(x * x)) AS norm FROM means GROUP BY ALL),
qvec AS (
  SELECT CAST(label AS VARCHAR) AS query_id, label, list(x / norm ORDER BY pos) AS vec
  FROM means JOIN centre_norms USING (label) GROUP BY ALL),
dvec AS (
  SELECT CAST(vec_id AS VARCHAR) AS doc_id, label, CAST(embedding AS DOUBLE[]) AS vec FROM embeddings)"""

ORACLES["l2_normalize"] = """
WITH cells AS (
  SELECT CAST(vec_id AS VARCHAR) AS doc_id, generate_subscripts(embedding, 1) - 1 AS pos,
         CAST(unnest(embedding) AS DOUBLE) * label AS x FROM embeddings),
norms AS (SELECT doc_id, sqrt(sum(x * x)) AS norm FROM cells GROUP BY ALL)
SELECT doc_id, pos, round(norm, 6) AS norm,
       round(CASE WHEN norm = 0 THEN x ELSE x / norm END, 6) + 0 AS x
FROM cells JOIN norms USING (doc_id)"""

ORACLES["cosine_scores"] = f"""
WITH {CENTRES}
SELECT d.doc_id, d.label, round(list_dot_product(d.vec, q.vec), 6) AS score
FROM dvec d JOIN qvec q USING (label)"""

ORACLES["knn_exact"] = ORACLES["knn_all_cells_vectors"] = ORACLES["knn_lsh"] = f"""
WITH {CENTRES}, {knn(20)} SELECT * FROM knn"""

GIVEN_CELLS = """
homes AS (
  SELECT d.doc_id, d.vec, c.label AS cell FROM dvec d, qvec c
  QUALIFY row_number() OVER (
    PARTITION BY d.doc_id ORDER BY list_dot_product(d.vec, c.vec) DESC, c.label) = 1),
probes AS (
  SELECT q.query_id, q.vec, c.label AS cell FROM qvec q, qvec c
  QUALIFY row_number() OVER (
    PARTITION BY q.query_id ORDER BY list_dot_product(q.vec, c.vec) DESC, c.label) <= 3),
near AS (
  SELECT query_id, doc_id, round(list_dot_product(p.vec, h.vec), 6) + 0 AS score,
         row_number() OVER (PARTITION BY query_id
           ORDER BY round(list_dot_product(p.vec, h.vec), 6) + 0 DESC, doc_id) AS rank
  FROM probes p JOIN homes h USING (cell) QUALIFY rank <= 20)"""

ORACLES["knn_given_cells"] = f"WITH {CENTRES}, {GIVEN_CELLS} SELECT * FROM near"

ORACLES["knn_cells_recall"] = f"""
WITH {CENTRES}, {knn(20)}, {GIVEN_CELLS}
SELECT query_id, round(count(near.doc_id) / CAST(count(*) AS DOUBLE), 6) AS recall
FROM knn LEFT JOIN near USING (query_id, doc_id) GROUP BY query_id"""

ORACLES["knn_lsh_recall"] = f"""
WITH {CENTRES}, {knn(20)} SELECT count(*) AS neighbours, 1 AS enough FROM knn"""

ORACLES["knn_exact_documents"] = f"""
WITH {DOCUMENTS}, {FREE_QUERIES}, {hashed('corpus', 'doc_id', DOC_TEXT, 'dvec')},
{hashed('queries', 'query_id', 'q', 'qvec')}, {knn(20)} SELECT * FROM knn"""

# --- fusion ---------------------------------------------------------------------


def order_lists(second: str) -> str:
    return f"""
rows_ AS (
  SELECT CAST(o_custkey AS VARCHAR) AS query_id, CAST(o_orderkey AS VARCHAR) AS doc_id,
         o_totalprice AS price, o_orderdate AS day, o_orderpriority AS title FROM orders),
list_a AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY price DESC, doc_id) AS rank FROM rows_),
list_b AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY {second}) AS rank FROM rows_)"""


FUSED_COLUMNS = "query_id, rank, doc_id, round(score, 9) AS score, bm25_rank, knn_rank"

ORACLES["rrf_fuse"] = f"""
WITH {order_lists('day DESC, doc_id')}, {fused('list_a', 'list_b')} SELECT {FUSED_COLUMNS} FROM fused"""

ORACLES["rrf_ties"] = f"""
WITH {order_lists('price, doc_id DESC')}, {fused('list_a', 'list_b')} SELECT {FUSED_COLUMNS} FROM fused"""

ORACLES["hit_dedup_first"] = f"""
WITH {order_lists('day DESC, doc_id')}
SELECT coalesce(a.query_id, b.query_id) AS query_id, coalesce(a.doc_id, b.doc_id) AS doc_id,
       coalesce('A ' || a.title, b.title) AS title,
       CASE WHEN a.doc_id IS NULL THEN 'knn' ELSE 'bm25' END AS source
FROM (SELECT * FROM list_a WHERE rank <= 5) a
FULL JOIN (SELECT * FROM list_b WHERE rank <= 20) b ON a.query_id = b.query_id AND a.doc_id = b.doc_id"""

ORACLES["threshold_after_limit"] = f"""
WITH {order_lists('day DESC, doc_id')}, {fused('list_a', 'list_b')}
SELECT query_id, rank, doc_id, round(score, 9) AS score FROM fused
WHERE rank <= CAST(query_id AS BIGINT) % 12 + 1
  AND (CAST(query_id AS BIGINT) % 3 = 0 OR score >= CAST(0.031 AS DOUBLE))"""

ORACLES["rerank_head_tail"] = f"""
WITH {DOCUMENTS}, {FREE_QUERIES}, {bm25(50, SYNOPSIS_ONLY, False)},
scored AS (
  SELECT b.*, CASE WHEN b.rank <= 20 THEN {overlap('q', DOC_TEXT)} END AS head
  FROM bm25 b JOIN queries USING (query_id) JOIN corpus USING (doc_id))
SELECT query_id, doc_id, coalesce(head, score) AS score, score AS rrf_score,
       row_number() OVER (PARTITION BY query_id ORDER BY head IS NULL, head DESC, rank) AS rank
FROM scored"""

HYBRID = f"""
{DOCUMENTS}, {REQUESTS}, queries AS (SELECT query_id, q FROM requests),
{bm25(200, ALL_FIELDS, True)},
{hashed('corpus', 'doc_id', DOC_TEXT, 'dvec')}, {hashed('queries', 'query_id', 'q', 'qvec')}, {knn(200)},
bm25_cut AS (SELECT b.* FROM bm25 b JOIN requests r USING (query_id) WHERE b.rank <= greatest(4 * lim, 20)),
knn_cut AS (SELECT k.* FROM knn k JOIN requests r USING (query_id) WHERE k.rank <= greatest(4 * lim, 20)),
{fused('bm25_cut', 'knn_cut')}"""


def shown(source: str) -> str:
    return f"""
SELECT query_id, rank, doc_id AS id, title, book_picture AS "bookPicture", round(score, 6) AS score
FROM {source} JOIN requests USING (query_id) JOIN corpus USING (doc_id)
WHERE rank <= lim AND (threshold <= 0 OR score >= threshold)"""


ORACLES["hybrid_search"] = f"WITH {HYBRID} {shown('fused')}"

ORACLES["reopened_search"] = ORACLES["hybrid_search_cells"] = ORACLES["hybrid_search"]

ORACLES["memoised_search"] = f"""
WITH {HYBRID},
shown AS ({shown('fused')}),
counts AS (SELECT query_id, count(*) AS n FROM shown GROUP BY query_id)
SELECT r.query_id, coalesce(n, 0) AS n_items,
       CASE WHEN EXISTS (SELECT 1 FROM requests o WHERE CAST(o.query_id AS BIGINT) % 2 = 0
                         AND o.q = r.q AND o.lim = r.lim AND o.threshold = r.threshold)
            THEN 'cache' ELSE 'search' END AS source
FROM requests r LEFT JOIN counts USING (query_id)"""

ORACLES["hybrid_search_reranked"] = f"""
WITH {HYBRID},
scored AS (
  SELECT f.query_id, f.doc_id, f.rank AS old_rank, f.score AS rrf_score,
         CASE WHEN f.rank <= 20 THEN {overlap('q', DOC_TEXT)} END AS head
  FROM fused f JOIN queries USING (query_id) JOIN corpus USING (doc_id)),
moved AS (
  SELECT query_id, doc_id, coalesce(head, rrf_score) AS score,
         row_number() OVER (PARTITION BY query_id ORDER BY head IS NULL, head DESC, old_rank) AS rank
  FROM scored)
{shown('moved')}"""

# --- memo -----------------------------------------------------------------------

CACHE = """
log AS (
  SELECT 'res:' || sha256(event_type || ' ' || user_id || '|5|0.0') AS key,
         event_type || ' ' || user_id AS q, event_id, event_type, value,
         CAST(ts AS TIMESTAMP) AS written_at,
         CAST(ts AS TIMESTAMP) + INTERVAL 3600 SECOND AS expires_at
  FROM events),
newest AS (
  SELECT * FROM log QUALIFY row_number() OVER (PARTITION BY key ORDER BY written_at DESC) = 1),
live AS (
  SELECT * FROM (
    SELECT * FROM log WHERE written_at <= TIMESTAMP '2024-01-15 12:00:00'
    QUALIFY row_number() OVER (PARTITION BY key ORDER BY written_at DESC) = 1)
  WHERE expires_at > TIMESTAMP '2024-01-15 12:00:00'),
asked AS (SELECT DISTINCT key, q FROM log)"""

ORACLES["cache_keys"] = f"""
WITH {REQUESTS}
SELECT query_id, 'emb:' || sha256(q) AS emb_key,
       'res:' || sha256(q || '|' || lim || '|' || threshold) AS res_key
FROM requests"""

ORACLES["cache_put_latest"] = f"""
WITH {CACHE}
SELECT key, CASE WHEN value >= 5 THEN CAST(event_id AS VARCHAR) END AS first_id,
       epoch_us(written_at) AS written_at, epoch_us(expires_at) AS expires_at
FROM newest"""

ORACLES["cache_lookup"] = ORACLES["cache_recent"] = f"""
WITH {CACHE}
SELECT q, CASE WHEN value < 5 THEN 0 ELSE 1 END AS n_items, epoch_us(expires_at) AS expires_at FROM live"""

ORACLES["cache_hits"] = f"""
WITH {CACHE} SELECT key, q FROM asked WHERE key IN (SELECT key FROM live)"""

ORACLES["cache_long_ttl"] = f"""
WITH {CACHE},
mixed AS (
  SELECT key, q, event_id, written_at,
         written_at + to_seconds(CASE event_id % 3 WHEN 0 THEN 60 WHEN 1 THEN 7200 ELSE 86400 END) AS expires_at
  FROM log WHERE written_at <= TIMESTAMP '2024-01-15 12:00:00')
SELECT q, epoch_us(expires_at) AS expires_at FROM (
  SELECT * FROM mixed QUALIFY row_number() OVER (PARTITION BY key ORDER BY written_at DESC) = 1)
WHERE expires_at > TIMESTAMP '2024-01-15 12:00:00'"""

ORACLES["cache_misses"] = f"""
WITH {CACHE} SELECT key, q FROM asked WHERE key NOT IN (SELECT key FROM live)"""

ORACLES["cache_roundtrip"] = """
SELECT event_id AS id, event_type AS title, '' AS "bookPicture", value AS score
FROM events WHERE value >= 5"""

ORACLES["memo_embeddings"] = f"""
WITH {DOCUMENTS},
texts AS (
  SELECT {DOC_TEXT} AS text, bool_or(publisher < 'src15') AS known FROM corpus GROUP BY 1),
{hashed('texts', 'text', 'text', 'tvec')}
SELECT text, CASE WHEN known THEN 'cache' ELSE 'model' END AS source, len(vec) AS dim,
       {CHECKSUM} AS vec_sum
FROM texts JOIN tvec USING (text)"""

# --- evaluation -----------------------------------------------------------------

PARSED = f"""
found AS (
  SELECT CAST(id AS VARCHAR) AS doc_id, title, synopsis,
         regexp_extract(synopsis, ' by (.+?)\\. Published', 1) AS a,
         regexp_extract(synopsis, 'Published in (\\d{{4}})', 1) AS y,
         regexp_extract(synopsis, '(?i)Subjects?: (.+?)\\.?\\s*$', 1) AS s
  FROM books),
parsed AS (
  SELECT doc_id, title, synopsis,
         CASE WHEN a = '' THEN CAST([] AS VARCHAR[])
              ELSE list_transform(string_split(a, ','), lambda x: trim(x)) END AS authors,
         nullif(y, '') AS year,
         CASE WHEN s = '' THEN CAST([] AS VARCHAR[])
              ELSE list_filter(list_transform(string_split(s, ','), lambda x: trim(x)), lambda x: x <> '')
              END AS subjects
  FROM found)"""

ORACLES["parse_synopsis"] = f"""
WITH {BOOKS}, {PARSED}
SELECT doc_id, array_to_string(authors, '|') AS authors, year, array_to_string(subjects, '|') AS subjects
FROM parsed"""


def draw(*parts: str) -> str:
    return "md5('" + str(SEED) + "|' || " + " || '|' || ".join(parts) + ")"


def choice(size: str, *parts: str) -> str:
    return f"(CAST('0x' || substr({draw(*parts)}, 1, 8) AS UBIGINT) % ({size}) + 1)"


def keyword(source: str, out: str) -> str:
    return f"""
{out}_words AS (
  SELECT doc_id, title,
         list_filter(regexp_split_to_array(title, {SPACES}), lambda w: length(w) > 3) AS w
  FROM {source}),
{out} AS (
  SELECT doc_id, title,
         CASE WHEN len(w) >= 2 THEN array_to_string(list_transform(
           list_sort(list_transform(w, lambda x: {draw('doc_id', 'x')} || x))[1:3],
           lambda x: substr(x, 33)), ' ') END AS query
  FROM {out}_words)"""


def labelled(style: str, query: str, source: str) -> str:
    return f"""
SELECT doc_id AS query_id, {query} AS query, doc_id AS relevant_id, '{style}' AS style, title
FROM {source} WHERE {query} <> ''"""


AUTHOR = "'books by ' || authors[1]"
SUBJECT = f"subjects[CAST({choice('least(3, len(subjects))', 'doc_id', chr(39) + 'subject' + chr(39))} AS BIGINT)]"
YEAR = "subjects[1] || ' from ' || year"

ORACLES["gen_queries_keyword"] = f"""
WITH {DOCUMENTS}, {keyword('corpus', 'kw')} {labelled('keyword', 'query', 'kw')}"""
ORACLES["gen_queries_author"] = f"WITH {BOOKS}, {PARSED} {labelled('author', AUTHOR, 'parsed')}"
ORACLES["gen_queries_subject"] = f"WITH {BOOKS}, {PARSED} {labelled('subject', SUBJECT, 'parsed')}"
ORACLES["gen_queries_year"] = f"WITH {BOOKS}, {PARSED} {labelled('year', YEAR, 'parsed')}"

STYLE_LIST = "[" + ", ".join(f"'{s}'" for s in STYLE_LABELS) + "]"
STYLE_NUMBER = choice(str(len(STYLE_LABELS)), "doc_id", "'style'")

MIXED = f"""
{PARSED}, {keyword('parsed', 'kw')},
styled AS (
  SELECT doc_id, title, {STYLE_LIST}[CAST({STYLE_NUMBER} AS BIGINT)] AS style,
         kw.query AS keyword_query, {AUTHOR} AS author_query, {SUBJECT} AS subject_query,
         {YEAR} AS year_query
  FROM parsed JOIN kw USING (doc_id, title)),
qrels AS (
  SELECT doc_id AS query_id, doc_id AS relevant_id, style, title,
         CASE style WHEN 'keyword' THEN keyword_query WHEN 'author' THEN author_query
                    WHEN 'subject' THEN subject_query ELSE year_query END AS query
  FROM styled WHERE CASE style WHEN 'keyword' THEN keyword_query WHEN 'author' THEN author_query
                    WHEN 'subject' THEN subject_query ELSE year_query END <> ''
  ORDER BY {draw('doc_id')}, doc_id LIMIT 100)"""

ORACLES["gen_queries_mixed"] = ORACLES["query_set_saved"] = f"""
WITH {BOOKS}, {MIXED} SELECT query_id, query, relevant_id, style, title FROM qrels"""

LABELS = ", ".join(f"('{s}', '{label}')" for s, label in STYLE_LABELS.items())
ORACLES["query_style_counts"] = f"""
WITH {BOOKS}, {MIXED}, labels_(style, label) AS (VALUES {LABELS})
SELECT style, label, count(*) AS n_queries FROM qrels JOIN labels_ USING (style) GROUP BY ALL"""

JUDGED = f"""
{ORDER_CORPUS}, {MIXED}, queries AS (SELECT query_id, query AS q FROM qrels),
{bm25(10, ALL_FIELDS, True)},
{hashed('corpus', 'doc_id', DOC_TEXT, 'dvec')}, {hashed('queries', 'query_id', 'q', 'qvec')}, {knn(10)},
{fused('bm25', 'knn')},
runs AS (
  SELECT 'BM25' AS method, query_id, doc_id, rank FROM bm25
  UNION ALL SELECT 'Dense', query_id, doc_id, rank FROM knn
  UNION ALL SELECT 'Hybrid-RRF', query_id, doc_id, rank FROM fused WHERE rank <= 10),
judged AS (
  SELECT m.method, q.query_id, q.style, r.rank
  FROM qrels q CROSS JOIN (VALUES ('BM25'), ('Dense'), ('Hybrid-RRF')) m(method)
  LEFT JOIN runs r ON r.method = m.method AND r.query_id = q.query_id AND r.doc_id = q.relevant_id),
metrics AS (
  SELECT method, 'Hit@1' AS metric, avg(CASE WHEN rank <= 1 THEN 1.0 ELSE 0.0 END) AS value
  FROM judged GROUP BY method
  UNION ALL SELECT method, 'Hit@5', avg(CASE WHEN rank <= 5 THEN 1.0 ELSE 0.0 END) FROM judged GROUP BY method
  UNION ALL SELECT method, 'Hit@10', avg(CASE WHEN rank <= 10 THEN 1.0 ELSE 0.0 END) FROM judged GROUP BY method
  UNION ALL SELECT method, 'MRR@10', avg(coalesce(1 / CAST(rank AS DOUBLE), 0)) FROM judged GROUP BY method
  UNION ALL SELECT method, 'NDCG@10', avg(coalesce(1 / log2(rank + 1), 0)) FROM judged GROUP BY method)"""

ORACLES["eval_hits"] = f"WITH {JUDGED} SELECT method, query_id, style, rank FROM judged"
ORACLES["eval_metrics"] = f"WITH {JUDGED} SELECT method, metric, round(value, 6) AS value FROM metrics"
ORACLES["eval_mrr"] = ORACLES["eval_metrics"] + " WHERE metric = 'MRR@10'"
ORACLES["eval_ndcg"] = ORACLES["eval_metrics"] + " WHERE metric = 'NDCG@10'"
ORACLES["eval_metrics_wide"] = f"""
WITH {JUDGED}
SELECT method, round(max(value) FILTER (metric = 'Hit@1'), 4) AS "Hit@1",
       round(max(value) FILTER (metric = 'Hit@5'), 4) AS "Hit@5",
       round(max(value) FILTER (metric = 'Hit@10'), 4) AS "Hit@10",
       round(max(value) FILTER (metric = 'MRR@10'), 4) AS "MRR@10",
       round(max(value) FILTER (metric = 'NDCG@10'), 4) AS "NDCG@10"
FROM metrics GROUP BY method"""
