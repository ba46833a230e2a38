"""The registered queries in DuckDB SQL, written apart from the Spark code they check."""

# White space as a character list for trim and as a character class for patterns.
WS_CODES = [*range(0x9, 0xE), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029]
WS_CODES += [0x202F, 0x205F, 0x3000]
WS_CHARS = "(" + " || ".join(f"chr({c})" for c in WS_CODES) + ")"
WS_CLASS = "".join(rf"\x{{{c:X}}}" for c in WS_CODES)
NL = "chr(10)"
WIDTH = 64


def strip(text: str) -> str:
    return f"trim({text}, {WS_CHARS})"


def blank(text: str) -> str:
    return f"({text} IS NULL OR {strip(text)} = '')"


def with_(*ctes: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(ctes)


# Corpus, chunks, vectors, store

CORPUS = f"""corpus AS (
  SELECT doc_id, 'doc' || doc_id || '.md' AS file_name,
         CASE WHEN doc_id % 4 <> 3 THEN source ELSE 'doc' || doc_id END AS category, text
  FROM documents WHERE NOT {blank('text')} AND strlen(text) <= 5242880)"""

REVISED = f"""revised AS (
  SELECT doc_id, file_name, CASE WHEN doc_id % 5 = 0 THEN 'moved' ELSE category END AS category,
         CASE WHEN doc_id % 3 = 0 THEN text || {NL} || 'Revised.' ELSE text END AS text
  FROM corpus)"""


def chunked(source: str, p: str, limit: int = 1000, overlap: int = 150) -> str:
    """CTEs ending in {p}chunks(doc_id, chunk_index, chunk_text), by recursion over lines."""
    room = limit - overlap - 1
    tail = f"""CASE WHEN length(f.body) <= {overlap} THEN f.body
        WHEN regexp_full_match(substr(f.body, length(f.body) - {overlap}, 2), '[^{WS_CLASS}]{{2}}')
        THEN regexp_replace(right(f.body, {overlap}), '^[^{WS_CLASS}]*[{WS_CLASS}]', '')
        ELSE right(f.body, {overlap}) END"""
    whole = f"CASE WHEN f.tail IS NULL THEN f.body ELSE f.tail || {NL} || f.body END"
    return f"""{p}lines AS (
  SELECT doc_id, unnest(l) AS line, unnest(range(len(l))) AS li FROM (
    SELECT doc_id, string_split(replace(replace(text, chr(13) || {NL}, {NL}), chr(13), {NL}), {NL}) AS l
    FROM {source})),
{p}sentences AS (
  SELECT doc_id, li, unnest(s) AS piece, unnest(range(len(s))) AS si FROM (
    SELECT doc_id, li, CASE WHEN length(line) <= {room} THEN [line] ELSE string_split(
      regexp_replace(line, '([.!?])[\\x09\\x0A\\x0B\\x0C\\x0D\\x20]+', '\\1' || chr(31), 'g'), chr(31))
      END AS s FROM {p}lines)),
{p}pieces AS (
  SELECT doc_id, li, si, pi, substr(piece, (pi * {room} + 1)::BIGINT, {room}) AS atom FROM (
    SELECT *, unnest(range(greatest(ceil(length(piece) / {room}.0)::BIGINT, 1))) AS pi
    FROM {p}sentences)),
{p}atoms AS (
  SELECT doc_id, atom, row_number() OVER (PARTITION BY doc_id ORDER BY li, si, pi) AS n
  FROM {p}pieces WHERE NOT {blank('atom')}),
{p}fold AS (
  SELECT doc_id, n, NULL::VARCHAR AS tail, atom AS body, 0 AS idx, NULL::VARCHAR AS done
  FROM {p}atoms WHERE n = 1
  UNION ALL
  SELECT f.doc_id, a.n,
    CASE WHEN length(f.body) + 1 + length(a.atom) <= {room} THEN f.tail ELSE {tail} END,
    CASE WHEN length(f.body) + 1 + length(a.atom) <= {room} THEN f.body || {NL} || a.atom
         ELSE a.atom END,
    CASE WHEN length(f.body) + 1 + length(a.atom) <= {room} THEN f.idx ELSE f.idx + 1 END,
    CASE WHEN length(f.body) + 1 + length(a.atom) <= {room} THEN NULL ELSE {whole} END
  FROM {p}fold f JOIN {p}atoms a ON a.doc_id = f.doc_id AND a.n = f.n + 1),
{p}chunks AS MATERIALIZED (
  SELECT doc_id, (idx - 1)::INTEGER AS chunk_index, done AS chunk_text FROM {p}fold
  WHERE done IS NOT NULL
  UNION ALL
  SELECT f.doc_id, f.idx::INTEGER, {whole} FROM {p}fold f
  JOIN (SELECT doc_id, max(n) AS n FROM {p}atoms GROUP BY doc_id) m
    ON m.doc_id = f.doc_id AND m.n = f.n)"""


def embedded(source: str, key: str, text: str, name: str) -> str:
    """CTEs ending in {name}(key, embedding): hashed word counts at unit length, as FLOAT[]."""
    return f"""{name}_counts AS (
  SELECT id, b, count(*) AS c FROM (
    SELECT id, ('0x' || substr(md5(w), 1, 8))::BIGINT % {WIDTH} AS b FROM (
      SELECT {key} AS id, unnest(regexp_split_to_array(lower({text}), '[^\\p{{L}}\\p{{N}}]+')) AS w
      FROM {source}) WHERE w <> '')
  GROUP BY id, b),
{name} AS MATERIALIZED (
  SELECT id, list((CASE WHEN total > 0 THEN coalesce(c, 0) / sqrt(total) ELSE 0 END)::FLOAT
                  ORDER BY b) AS embedding
  FROM (SELECT i.id, g.b, n.c, sum(coalesce(n.c * n.c, 0)) OVER (PARTITION BY i.id) AS total
        FROM (SELECT {key} AS id FROM {source}) i CROSS JOIN (SELECT unnest(range({WIDTH})) AS b) g
        LEFT JOIN {name}_counts n ON n.id = i.id AND n.b = g.b)
  GROUP BY id)"""


def stored(chunks: str, source: str, name: str) -> str:
    """A CTE of store rows: what remains when documents are saved in doc_id order."""
    return f"""{name}_all AS MATERIALIZED (
  SELECT ('0x' || substr(md5(concat_ws(chr(31), d.category, c.doc_id, c.chunk_index, c.chunk_text)),
          1, 15))::BIGINT AS record_id, d.category, c.doc_id, c.chunk_index, c.chunk_text
  FROM {chunks} c JOIN {source} d ON d.doc_id = c.doc_id),
{name} AS MATERIALIZED (
  SELECT * FROM {name}_all
  QUALIFY doc_id = max(doc_id) OVER (PARTITION BY category, chunk_text))"""


STORE = ",\n".join([CORPUS, chunked("corpus", ""), stored("chunks", "corpus", "store")])
INCOMING = ",\n".join([REVISED, chunked("revised", "r_"), stored("r_chunks", "revised", "incoming")])
MERGED = """merged AS (
  SELECT * FROM store s WHERE NOT EXISTS (
    SELECT 1 FROM incoming i WHERE i.category = s.category AND i.chunk_text = s.chunk_text)
  UNION ALL SELECT * FROM incoming)"""
STORE_VIEW = "record_id, category, doc_id, chunk_index, chunk_text"

# Admission

REQUESTS = """requests AS (
  SELECT conv_id * 1000 + turn AS query_id,
    CASE k WHEN 6 THEN '   ' WHEN 7 THEN repeat('x', 2001) ELSE ' ' || text || chr(10) END AS query,
    CASE k WHEN 1 THEN 3 WHEN 2 THEN 0 WHEN 3 THEN 51 END AS top_k,
    CASE k WHEN 1 THEN ' src' || (conv_id % 20) WHEN 0 THEN '' END AS category,
    CASE k WHEN 4 THEN 0.7::DOUBLE WHEN 5 THEN 1.5::DOUBLE END AS min_similarity
  FROM (SELECT *, (conv_id * 7 + turn) % 8 AS k FROM conversations WHERE role = 'user'))"""

SEARCHES = """requests AS (
  SELECT conv_id * 1000 + turn AS query_id, ' ' || text || chr(10) AS query,
    CASE k WHEN 1 THEN 3 WHEN 2 THEN 1 WHEN 3 THEN 50 END AS top_k,
    CASE k WHEN 1 THEN ' src' || (conv_id % 20) WHEN 0 THEN '' END AS category,
    CASE k WHEN 4 THEN 0.7::DOUBLE WHEN 5 THEN 1.0::DOUBLE END AS min_similarity
  FROM (SELECT *, (conv_id * 7 + turn) % 8 AS k FROM conversations WHERE role = 'user'))"""

CHECKED = f"""checked AS (
  SELECT query_id, {strip('query')} AS query, coalesce(top_k, 5) AS top_k,
    nullif({strip('category')}, '') AS category,
    coalesce(min_similarity, 0::DOUBLE) AS min_similarity,
    CASE WHEN {blank('query')} THEN 'query.missing'
         WHEN length({strip('query')}) > 2000 THEN 'query.too_long'
         WHEN top_k NOT BETWEEN 1 AND 50 THEN 'top_k.out_of_range'
         WHEN isnan(min_similarity) OR min_similarity NOT BETWEEN 0 AND 1
         THEN 'min_similarity.out_of_range' END AS error_code
  FROM requests)"""

ASKED = f"asked AS (SELECT * FROM checked WHERE error_code IS NULL)"

PLAIN_QUESTIONS = f"""asked AS (
  SELECT query_id, {strip('query')} AS query, 5 AS top_k, NULL::VARCHAR AS category,
         0::DOUBLE AS min_similarity
  FROM (SELECT conv_id * 1000 + turn AS query_id, text AS query FROM conversations WHERE role = 'user'
        UNION ALL SELECT -1 - item_id, text FROM benchmark)
  WHERE NOT {blank('query')} AND length({strip('query')}) <= 2000)"""

MANIFEST = """manifest AS (
  SELECT doc_id, CASE doc_id % 10
    WHEN 0 THEN 'doc' || doc_id || '.md' WHEN 1 THEN 'doc' || doc_id || '.TXT'
    WHEN 2 THEN '../doc' || doc_id || '.md' WHEN 3 THEN 'nested/doc' || doc_id || '.txt'
    WHEN 4 THEN 'doc' || doc_id || '.exe' WHEN 5 THEN '.md' WHEN 6 THEN '' WHEN 7 THEN '..'
    WHEN 8 THEN 'do?c' || doc_id || '.txt' ELSE 'a\\doc' || doc_id || '.md' END AS file_name
  FROM documents)"""

NAMED = f"""named AS (
  SELECT doc_id, file_name,
    CASE WHEN {blank('file_name')} THEN 'file_name.missing'
         WHEN regexp_matches(file_name, '[/\\\\:]') THEN 'file_name.not_a_bare_name'
         WHEN regexp_matches(file_name, '[\\x00-\\x1F"<>|*?]') THEN 'file_name.invalid_characters'
         WHEN file_name IN ('.', '..') THEN 'file_name.not_a_bare_name'
         WHEN regexp_replace(file_name, '\\.[^.]*$', '') = '' THEN 'file_name.stem_missing'
         WHEN lower(regexp_extract(file_name, '\\.[^.]*$')) NOT IN ('.txt', '.md')
         THEN 'file_name.extension_not_allowed' END AS error_code
  FROM manifest)"""

SIZED = f"""sized AS (
  SELECT doc_id, CASE WHEN strlen(text) > 4000 THEN 'document.too_large'
                      WHEN {blank('text')} THEN 'document.empty' END AS error_code
  FROM documents)"""

# Retrieval


def hits(store: str, condition: str = "true") -> str:
    """A CTE of ranked hits from `scored`-ready tables: q(query_id, vector, ...), s(record_id, ...)."""
    return f"""scored AS (
  SELECT q.query_id, q.top_k, q.min_similarity, s.record_id,
         list_cosine_similarity(q.vector::DOUBLE[], s.embedding::DOUBLE[]) AS cosine
  FROM q JOIN {store} s ON (q.category IS NULL OR q.category = s.category) AND {condition}),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(cosine, 9) DESC, record_id) AS rank
  FROM scored WHERE NOT isnan(cosine) AND greatest(0, least(1, cosine)) >= min_similarity),
hits AS MATERIALIZED (
  SELECT query_id, rank::INTEGER AS rank, record_id,
         round(greatest(0, least(1, cosine)), 6) AS similarity
  FROM ranked WHERE rank <= top_k)"""


VECTOR_STORE = """s AS (
  SELECT vec_id AS record_id, label::VARCHAR AS category, embedding FROM embeddings)"""


def vector_questions(top_k="5", category="NULL::VARCHAR", floor="0") -> str:
    return f"""q AS (
  SELECT vec_id AS query_id, embedding AS vector, {top_k} AS top_k, {category} AS category,
         {floor}::DOUBLE AS min_similarity FROM embeddings)"""


FILTERED = vector_questions("vec_id % 50 + 1", "CASE WHEN vec_id % 3 <> 0 THEN label::VARCHAR END")
HIT_VIEW = "SELECT query_id, rank, record_id, similarity FROM hits"

APPROX = """centroids AS (
  SELECT row_number() OVER (ORDER BY md5(vec_id::VARCHAR)) - 1 AS cell, embedding AS centroid
  FROM (SELECT * FROM embeddings ORDER BY md5(vec_id::VARCHAR) LIMIT 16)),
celled AS MATERIALIZED (
  SELECT s.*, c.cell FROM s CROSS JOIN centroids c
  QUALIFY row_number() OVER (PARTITION BY s.record_id ORDER BY
    round(list_cosine_similarity(s.embedding::DOUBLE[], c.centroid::DOUBLE[]), 9) DESC, c.cell) = 1),
sizes AS (
  SELECT q.query_id, q.vector, q.top_k, m.cell, count(*) AS n
  FROM q JOIN celled m ON q.category IS NULL OR q.category = m.category
  GROUP BY q.query_id, q.vector, q.top_k, m.cell),
visits AS MATERIALIZED (
  SELECT z.query_id, z.cell FROM sizes z JOIN centroids c USING (cell)
  QUALIFY sum(z.n) OVER (PARTITION BY z.query_id ORDER BY
    round(list_cosine_similarity(z.vector::DOUBLE[], c.centroid::DOUBLE[]), 9) DESC, z.cell) - z.n
    < greatest((SELECT ceil(count(*) * 0.7) FROM s), z.top_k))"""

TEXT_VECTORS = ",\n".join(
    [
        embedded("store", "record_id", "chunk_text", "store_vectors"),
        embedded("asked", "query_id", "query", "asked_vectors"),
        """s AS (SELECT s.*, v.embedding FROM store s JOIN store_vectors v ON v.id = s.record_id)""",
        """q AS (SELECT a.*, v.embedding AS vector FROM asked a JOIN asked_vectors v ON v.id = a.query_id)""",
        hits("s"),
    ]
)
SEARCH = ",\n".join([STORE, SEARCHES, CHECKED, ASKED, TEXT_VECTORS])
PLAIN_SEARCH = ",\n".join([STORE, PLAIN_QUESTIONS, TEXT_VECTORS])


def answered(budget: int) -> str:
    """CTEs from hits to context(query_id, label, record_id, text) and final answers."""
    return f"""packed AS (
  SELECT query_id, list(h.record_id ORDER BY rank) AS ids, list(s.chunk_text ORDER BY rank) AS texts
  FROM hits h JOIN store s USING (record_id) GROUP BY query_id),
walk AS (
  SELECT query_id, 1 AS i, length(texts[1]) AS used, [1] AS taken, ids, texts FROM packed
  UNION ALL
  SELECT query_id, i + 1,
    CASE WHEN used + length(texts[i + 1]) <= {budget} THEN used + length(texts[i + 1]) ELSE used END,
    CASE WHEN used + length(texts[i + 1]) <= {budget} THEN list_append(taken, i + 1) ELSE taken END,
    ids, texts
  FROM walk WHERE i < len(ids)),
context AS MATERIALIZED (
  SELECT query_id, unnest(range(1, len(taken) + 1))::INTEGER AS label, ids[unnest(taken)] AS record_id,
         texts[unnest(taken)] AS text
  FROM walk WHERE i = len(ids)),
top AS (SELECT query_id, similarity FROM hits WHERE rank = 1),
spoken AS (
  SELECT a.query_id, a.query, t.similarity AS top_similarity,
    CASE WHEN t.similarity < 0.65
         THEN 'INSUFFICIENT_CONTEXT: no excerpt is close enough to the question.'
         WHEN t.similarity IS NOT NULL THEN (
           SELECT string_agg(regexp_extract({strip('c.text')}, '^[^.!?]*[.!?]?') || ' [S' || c.label || ']',
                             ' ' ORDER BY c.label)
           FROM context c WHERE c.query_id = a.query_id AND c.label <= 2) END AS raw_answer
  FROM asked a LEFT JOIN top t USING (query_id)),
final AS (
  SELECT *, CASE
      WHEN raw_answer IS NULL
      THEN 'The indexed documents do not contain anything relevant to that question.'
      WHEN starts_with({strip('raw_answer')}, 'INSUFFICIENT_CONTEXT')
      THEN 'no excerpt is close enough to the question.'
      ELSE {strip('raw_answer')} END AS answer,
    raw_answer IS NOT NULL AND NOT starts_with({strip('raw_answer')}, 'INSUFFICIENT_CONTEXT')
      AS answered
  FROM spoken)"""


RESPONSES = """responses AS (
  SELECT conv_id, turn, CASE k WHEN 0 THEN text || ' [S1].' WHEN 1 THEN text || ' [S2, S1] and [S9].'
      WHEN 2 THEN 'INSUFFICIENT_CONTEXT: ' || text WHEN 3 THEN 'INSUFFICIENT_CONTEXT'
      ELSE text END AS raw_answer,
    CASE k WHEN 4 THEN 'Length' ELSE 'stop' END AS finish_reason
  FROM (SELECT *, (conv_id + turn) % 5 AS k FROM conversations WHERE role = 'assistant'))"""

NORMAL = f"""trimmed AS (
  SELECT conv_id, turn, finish_reason, {strip('raw_answer')} AS t FROM responses),
reasons AS (
  SELECT *, NOT starts_with(t, 'INSUFFICIENT_CONTEXT') AS ok,
    ltrim(substr(t, length('INSUFFICIENT_CONTEXT') + 1), ': ' || chr(13) || chr(10)) AS reason
  FROM trimmed),
normal AS (
  SELECT conv_id, turn,
    CASE WHEN t = '' THEN NULL ELSE
      CASE WHEN ok THEN t
           WHEN {blank('reason')} THEN 'The retrieved text does not contain the answer to that question.'
           ELSE reason END
      || CASE WHEN lower(finish_reason) = 'length' THEN {NL} || {NL} ||
           '[Answer truncated at the configured output token limit.]' ELSE '' END END AS answer,
    CASE WHEN t <> '' THEN ok END AS answered,
    CASE WHEN t = '' THEN 'answer.empty_response' END AS error_code
  FROM reasons)"""

CITED = """marks AS (
  SELECT conv_id, turn, unnest(m) AS mark, unnest(range(len(m))) AS mi FROM (
    SELECT *, regexp_extract_all(answer, '\\[S([0-9]+(?:[ \\t]*,[ \\t]*S?[0-9]+)*)\\]', 1) AS m FROM normal)),
parts AS (
  SELECT conv_id, turn, mi, unnest(p) AS part, unnest(range(len(p))) AS pi FROM (
    SELECT *, string_split(mark, ',') AS p FROM marks)),
labels_ AS (
  SELECT conv_id, turn, mi, pi, try_cast(ltrim(trim(part), 'Ss') AS INTEGER) AS label FROM parts),
firsts AS (
  SELECT conv_id, turn, conv_id * 10 + label AS record_id, min(mi * 1000000 + pi) AS at FROM labels_
  WHERE label IN (1, 2, 3) GROUP BY ALL),
cited AS (
  SELECT n.conv_id, n.turn, any_value(n.answer) AS answer, any_value(n.answered) AS answered,
         coalesce(string_agg(f.record_id, ',' ORDER BY f.at), '') AS cited_record_ids
  FROM normal n LEFT JOIN firsts f USING (conv_id, turn) GROUP BY n.conv_id, n.turn)"""

ERROR_CLASS = """CASE WHEN error_code = 'document.not_found' THEN 'not_found'
  WHEN split_part(error_code, '.', 1) IN ('chunking', 'embedding', 'answer')
    OR error_code IN ('document.read_failed', 'document.no_chunks_produced') THEN 'upstream'
  ELSE 'validation' END"""

GENERATED = f""" SELECT a.query_id, CASE WHEN count(c.label) > 0 THEN 'Seen [' ||
        string_agg('S' || c.label, ', ' ORDER BY c.label) || '].' END AS raw_answer,
      CASE WHEN count(c.label) > 0 THEN 'stop' END AS finish_reason,
      CASE WHEN count(c.label) > 0 THEN 18 + 10 + any_value(length(a.query)) +
        sum(length({strip('c.text')}) + 5 + length(c.label::VARCHAR) + 1) END::INTEGER
        AS input_tokens,
      CASE WHEN count(c.label) > 0 THEN count(c.label) END::INTEGER AS output_tokens
        FROM asked a LEFT JOIN context c USING (query_id) GROUP BY a.query_id"""

ORACLE = {
    "document_sizes": "SELECT strlen(text) + 1 AS size_bytes FROM documents",
    "document_read": f"""SELECT CASE WHEN strlen(text) < 4000 THEN text || {NL} END AS text,
        CASE WHEN strlen(text) >= 4000 THEN 'document.too_large' END AS error_code FROM documents""",
    "chunk_store_scan": with_(STORE, embedded("store", "record_id", "chunk_text", "v"))
    + f""" SELECT {STORE_VIEW}, round(sqrt(list_sum(list_transform(embedding::DOUBLE[],
         lambda x: x * x))), 5) AS norm FROM store JOIN v ON v.id = record_id""",
    "chunk_store_category": with_(STORE) + f" SELECT {STORE_VIEW} FROM store WHERE category = 'src1'",
    "chunk_store_append": with_(STORE) + f" SELECT {STORE_VIEW} FROM store_all",
    "replace_and_insert": with_(STORE, INCOMING, MERGED) + f" SELECT {STORE_VIEW} FROM merged",
    "replace_and_insert_on_disk": with_(STORE, INCOMING, MERGED)
    + f" SELECT {STORE_VIEW} FROM merged",
    "incremental_ingest": with_(STORE) + f" SELECT {STORE_VIEW} FROM store",
    "file_name_admission": with_(MANIFEST, NAMED) + " SELECT * FROM named",
    "document_admission": with_(SIZED) + " SELECT * FROM sized",
    "search_request_admission": with_(REQUESTS, CHECKED) + " SELECT * FROM checked",
    "category_assign": """SELECT doc_id, 'doc' || doc_id || '.md' AS file_name,
        CASE WHEN doc_id % 4 <> 3 THEN source ELSE 'doc' || doc_id END AS category,
        NULL::VARCHAR AS error_code FROM documents""",
    "rejects_by_code": with_(MANIFEST, NAMED, REQUESTS, CHECKED, SIZED)
    + f""" SELECT {ERROR_CLASS} AS error_class, error_code, count(*) AS n FROM (
        SELECT error_code FROM named UNION ALL SELECT error_code FROM checked
        UNION ALL SELECT error_code FROM sized) WHERE error_code IS NOT NULL GROUP BY ALL""",
    "chunk_documents": with_(chunked("documents", "")) + " SELECT * FROM chunks",
    "chunk_fixed_width": f"""SELECT doc_id, i::INTEGER AS chunk_index,
        substr(text, i * 850 + 1, 1000) AS chunk_text FROM (
          SELECT *, unnest(range(ceil(greatest(length(text) - 150, 1) / 850.0)::BIGINT)) AS i
          FROM documents WHERE NOT {blank('text')})""",
    "chunk_budget_audit": with_(chunked("documents", ""))
    + f""" SELECT d.doc_id, count(c.chunk_text) AS chunks,
          coalesce(max(length(chunk_text)), 0)::INTEGER AS longest,
          count(*) FILTER (length(chunk_text) > 900) AS over_limit
        FROM documents d LEFT JOIN chunks c ON c.doc_id = d.doc_id
        WHERE NOT {blank('text')} GROUP BY d.doc_id""",
    "embed_hashed": with_(embedded("documents", "doc_id", "text", "v"))
    + """ SELECT * FROM (SELECT id AS doc_id, unnest(range(64))::INTEGER AS position,
          round(unnest(embedding)::DOUBLE, 6) AS weight FROM v) WHERE weight > 0""",
    "embed_unavailable": with_(chunked("documents", ""))
    + """ SELECT doc_id, chunk_index,
        CASE WHEN length(chunk_text) % 7 = 0 THEN 'embedding.unavailable' END AS error_code FROM chunks""",
    "embed_chunks": with_(
        chunked("documents", ""),
        "keyed AS (SELECT *, doc_id * 1000000 + chunk_index AS id FROM chunks)",
        embedded("keyed", "id", "chunk_text", "v"),
    )
    + """ SELECT doc_id, chunk_index, round(list_sum(list_transform(embedding::DOUBLE[],
          lambda x, i: x * i)), 4) AS weighted_sum, NULL::VARCHAR AS error_code
        FROM keyed JOIN v USING (id)""",
    "embedding_audit": """SELECT label, count(*) AS vectors,
        count(*) FILTER (label < 3) AS wrong_dimensions FROM embeddings GROUP BY label""",
    "pair_vectors": """SELECT d.doc_id, CASE WHEN e.vec_id IS NOT NULL THEN length(text)::INTEGER END
          AS characters, len(e.embedding)::INTEGER AS width,
        CASE WHEN e.vec_id IS NULL THEN 'embedding.count_mismatch' END AS error_code
        FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id""",
    "ingest_summary": with_(STORE, INCOMING)
    + """, events_ AS (
          SELECT category, chunk_text, -1 AS doc_id, count(*) AS n FROM store GROUP BY ALL
          UNION ALL SELECT category, chunk_text, doc_id, count(*) FROM incoming_all GROUP BY ALL),
        saves AS (SELECT *, coalesce(lag(n) OVER (
            PARTITION BY category, chunk_text ORDER BY doc_id), 0) AS before FROM events_)
        SELECT r.doc_id, r.file_name, r.category, any_value(length(r.text))::INTEGER AS character_count,
          sum(s.n)::BIGINT AS chunks_inserted, sum(s.before)::BIGINT AS chunks_replaced
        FROM revised r JOIN saves s ON s.doc_id = r.doc_id
        GROUP BY r.doc_id, r.file_name, r.category""",
    "replaced_rows": with_(STORE, INCOMING)
    + """ SELECT category, count(*) AS replaced FROM store s WHERE EXISTS (
          SELECT 1 FROM incoming i WHERE i.category = s.category AND i.chunk_text = s.chunk_text)
        GROUP BY category""",
    "store_audit": with_(STORE)
    + """ SELECT 'category' AS scope, category, count(*) AS row_count, count(*) AS vector_count
          FROM store GROUP BY category
        UNION ALL SELECT 'store', NULL, count(*), count(*) FROM store""",
    "cosine_pairs": """SELECT a.vec_id,
        round(1 - list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS distance,
        round(greatest(0, least(1, list_cosine_similarity(a.embedding::DOUBLE[],
          b.embedding::DOUBLE[]))), 6) AS similarity
        FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""",
    "topk_exact": with_(VECTOR_STORE, vector_questions(), hits("s")) + " " + HIT_VIEW,
    "topk_by_category": with_(VECTOR_STORE, FILTERED, hits("s")) + " " + HIT_VIEW,
    "topk_grid": with_(VECTOR_STORE, FILTERED, hits("s")) + " " + HIT_VIEW,
    "topk_with_floor": with_(VECTOR_STORE, vector_questions("50", floor="0.35"), hits("s"))
    + " " + HIT_VIEW,
    "topk_approx": with_(
        VECTOR_STORE,
        FILTERED,
        APPROX,
        hits("celled", "(q.query_id, s.cell) IN (SELECT (query_id, cell) FROM visits)"),
    )
    + " " + HIT_VIEW,
    "topk_approx_every_cell": with_(VECTOR_STORE, FILTERED, hits("s")) + " " + HIT_VIEW,
    "topk_single": """WITH first AS (SELECT * FROM embeddings ORDER BY vec_id LIMIT 1),
        scored AS (SELECT e.vec_id, e.label, list_cosine_similarity(e.embedding::DOUBLE[],
            first.embedding::DOUBLE[]) AS score FROM embeddings e JOIN first USING (label))
        SELECT vec_id AS record_id, label::VARCHAR AS category, '' AS chunk_text,
          round(greatest(0, least(1, score)), 6) AS similarity
        FROM scored WHERE score >= 0.01 ORDER BY round(score, 9) DESC, vec_id LIMIT 20""",
    "batch_retrieval": with_(SEARCH)
    + """ SELECT query_id, rank, h.record_id, s.category, s.chunk_text, similarity
        FROM hits h JOIN store s USING (record_id)""",
    "context_budget": with_(SEARCH, answered(2000)) + " SELECT * FROM context",
    "search_usage": with_(SEARCH, answered(2000))
    + """ SELECT a.query_id,
          (SELECT count(*) FROM hits h WHERE h.query_id = a.query_id)::INTEGER AS retrieved_chunks,
          (SELECT count(*) FROM context c WHERE c.query_id = a.query_id)::INTEGER
            AS chunks_used_as_context, t.similarity AS top_similarity
        FROM asked a LEFT JOIN top t USING (query_id)""",
    "prompt_assembly": with_(SEARCH, answered(2000))
    + f""" SELECT a.query_id, CASE WHEN count(c.label) > 0 THEN
            'Source excerpts:' || {NL} || {NL} || string_agg('[S' || c.label || ']' || {NL} ||
              {strip('c.text')} || {NL} || {NL}, '' ORDER BY c.label)
            || 'Question:' || {NL} || any_value(a.query) END AS prompt,
          coalesce(string_agg(c.record_id, ',' ORDER BY c.label), '') AS record_ids
        FROM asked a LEFT JOIN context c USING (query_id) GROUP BY a.query_id""",
    "generate_extractive": with_(SEARCH, answered(2000))
    + """ SELECT query_id, raw_answer, CASE WHEN raw_answer IS NOT NULL THEN 'stop' END
          AS finish_reason FROM spoken""",
    "generate_answers": with_(SEARCH, answered(2000)) + GENERATED,
    "generate_unavailable": with_(SEARCH, answered(2000), f"generated AS ({GENERATED})")
    + """ SELECT query_id, CASE WHEN input_tokens % 3 <> 0 THEN raw_answer END AS answer,
          CASE WHEN input_tokens % 3 = 0 THEN 'answer.unavailable' END AS error_code
        FROM generated WHERE raw_answer IS NOT NULL""",
    "no_hit_short_circuit": with_(SEARCH)
    + """ SELECT a.query_id, CASE WHEN h.query_id IS NULL THEN
          'The indexed documents do not contain anything relevant to that question.'
          ELSE 'pending' END AS answer, CASE WHEN h.query_id IS NULL THEN false END AS answered,
          h.query_id IS NOT NULL AS reaches_generator
        FROM asked a LEFT JOIN (SELECT DISTINCT query_id FROM hits) h USING (query_id)""",
    "answer_normalize": with_(RESPONSES, NORMAL) + " SELECT * FROM normal",
    "citations": with_(RESPONSES, NORMAL, CITED)
    + " SELECT conv_id, turn, cited_record_ids FROM cited",
    "grounding_report": with_(RESPONSES, NORMAL, CITED)
    + """ SELECT count(*) AS answers, count(*) FILTER (answered) AS answered,
          count(*) FILTER (NOT answered) AS refused,
          count(*) FILTER (answered AND cited_record_ids = '') AS answered_without_citation,
          count(*) FILTER (ends_with(answer, 'output token limit.]')) AS truncated,
          round(avg(answered::INTEGER), 6) AS answered_rate
        FROM cited""",
    "grounded_answers": with_(SEARCH, answered(12000))
    + """ SELECT f.query_id, f.query, f.answer, f.answered,
          coalesce((SELECT string_agg(c.record_id, ',' ORDER BY c.label) FROM context c
            WHERE c.query_id = f.query_id AND c.label <= 2 AND f.answered), '') AS cited_record_ids,
          (SELECT count(*) FROM hits h WHERE h.query_id = f.query_id)::INTEGER AS retrieved_chunks,
          (SELECT count(*) FROM context c WHERE c.query_id = f.query_id)::INTEGER
            AS chunks_used_as_context,
          f.top_similarity, CASE WHEN f.raw_answer IS NOT NULL THEN 'stop' END AS finish_reason
        FROM final f""",
    "public_answers": with_(PLAIN_SEARCH, answered(12000))
    + " SELECT query_id, query, answer, answered FROM final",
}
# The same rows by other ways through the library.
ORACLE |= {
    "retrieval_on_disk": ORACLE["batch_retrieval"],
    "retrieval_every_cell": ORACLE["batch_retrieval"],
    "retrieval_codes": ORACLE["batch_retrieval"],
    "retrieval_in_categories": ORACLE["batch_retrieval"]
    + " WHERE query_id IN (SELECT query_id FROM requests WHERE trim(category) <> '')",
    "retrieval_bounded_cells": ORACLE["batch_retrieval"],
    "topk_codes": ORACLE["topk_by_category"],
    "topk_bounded_cells": ORACLE["topk_by_category"],
    "answers_on_disk": ORACLE["public_answers"],
}
