"""DuckDB SQL of the logical tables, for the oracles: the same derivations as ``prose.sources.tables``."""

from __future__ import annotations

VIEWS = {
    "section_keys": """SELECT *, CASE WHEN doc_id % 17 = 0 THEN 'Author''s Note' WHEN doc_id % 23 = 0 THEN 'Preface'
        ELSE 'Chapter ' || (section_index + 1) END AS title FROM (
        SELECT CAST(doc_id // 50 AS INT) AS novel, doc_id,
        CAST(row_number() OVER (PARTITION BY doc_id // 50 ORDER BY doc_id) - 1 AS INT) AS section_index FROM documents)""",
    "sections": "SELECT k.*, d.text FROM section_keys k JOIN documents d USING (doc_id)",
    "novels": """SELECT novel, 'uuid-' || novel AS uuid, 'Novel ' || novel AS title,
        CASE WHEN novel % 7 <> 0 THEN novel // 5 END AS series_id, CASE WHEN novel % 7 <> 0 THEN novel % 5 + 1 END AS book_order
        FROM (SELECT DISTINCT CAST(doc_id // 50 AS INT) AS novel FROM documents)""",
    "entries": """SELECT CAST(conv_id // 20 AS INT) AS novel, CAST(conv_id % 20 AS INT) AS section_index, conv_id, turn, role AS speaker_name,
        ['happy','angry','sad','fearful','warm','serious','whisper','mysterious','bogus'][turn % 9 + 1] AS emotion,
        ['low','med','high'][turn % 3 + 1] AS intensity, text AS original_text,
        CAST(row_number() OVER (PARTITION BY conv_id // 20 ORDER BY conv_id, turn) - 1 AS INT) AS sequence_number FROM conversations""",
    "k": "SELECT *, coalesce(TRY_CAST(json_extract_string(props, '$.k') AS INT), 0) AS k FROM events",
    "novel_events": """SELECT event_id, CAST(user_id % 20 AS INT) AS novel, k % 5 AS section_index, CAST(event_id % 100 AS INT) AS sequence_number,
        k % 11 AS spoiler_level FROM k WHERE event_type = 'error'""",
    "profiles": "SELECT event_id AS id, user_id AS character_id, CAST(user_id % 20 AS INT) AS novel, k AS section_index, event_type AS status FROM k",
    "reader_events": "SELECT event_id, user_id AS reader_id, CAST(event_id % 20 AS INT) AS novel, k AS section_index, event_type, ts FROM k",
    "progress": """SELECT reader_id, novel, arg_max(section_index, (ts, event_id)) AS section_index, max(ts) AS updated_at
        FROM reader_events WHERE event_type = 'view' GROUP BY ALL""",
    "people": """SELECT c_custkey AS character_id, CAST(c_custkey // 50 AS INT) AS novel, c_name AS name, [lower(c_name), c_mktsegment] AS aliases,
        ['male','female','unknown'][c_custkey % 3 + 1] AS gender,
        ['child','teen','young','young_adult','adult','middle_aged','elderly','unknown'][c_custkey % 8 + 1] AS age_range,
        ['protagonist','deuteragonist','antagonist','major','minor','minor'][c_custkey % 6 + 1] AS role FROM customer""",
    "chunks": """SELECT vec_id AS chunk, CAST(label AS INT) AS chapter_index, CAST(vec_id % 3 + 1 AS INT) AS novel_number,
        CAST(vec_id % 5 AS INT) AS series_key, CAST(embedding AS DOUBLE[]) AS embedding FROM embeddings""",
    "asks": """SELECT chunk AS query, chapter_index AS current_chapter, 2 AS novel_number_now, series_key, embedding AS query_embedding
        FROM chunks WHERE chunk % 50 = 0""",
    "dense_all": """SELECT query, chunk, novel_number_now, current_chapter, novel_number, chapter_index,
        round(list_cosine_similarity(query_embedding, embedding), 6) AS score FROM asks JOIN chunks USING (series_key)
        WHERE novel_number < novel_number_now OR (novel_number = novel_number_now AND chapter_index <= current_chapter)""",
    "dense": "SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, chunk) AS rank FROM dense_all QUALIFY rank <= 40",
    "boosted": """SELECT query, chunk, round(score * (1 + 0.15 * exp(-greatest(0, (novel_number_now - novel_number) * 1000
        + current_chapter - chapter_index) / 5.0)), 6) AS score FROM dense""",
    "boosted8": "SELECT b.*, d.current_chapter FROM boosted b JOIN dense d USING (query, chunk) QUALIFY row_number() OVER (PARTITION BY query ORDER BY b.score DESC, chunk) <= 8",
    "places": """SELECT doc_id AS chunk, section_index AS chapter_index, uuid AS novel_uuid, coalesce(first_uuid, uuid) AS series_key, coalesce(book_order, 1) AS novel_number, (
        SELECT list(DISTINCT speaker_name) FROM entries e WHERE e.novel = k.novel AND e.section_index = k.section_index) AS speakers
        FROM section_keys k JOIN novels USING (novel) LEFT JOIN (SELECT series_id, arg_min(uuid, book_order) AS first_uuid FROM novels WHERE series_id IS NOT NULL GROUP BY 1) USING (series_id)""",
    "seen": """SELECT r.chunk AS query, c.chunk, r.chunk % 150 <> 0 OR r.novel_uuid = c.novel_uuid AS near, coalesce(list_contains(c.speakers, 'system'), FALSE) AS said
        FROM (SELECT * FROM places WHERE chunk % 50 = 0) r JOIN places c USING (series_key)
        WHERE c.novel_number < r.novel_number OR (c.novel_number = r.novel_number AND c.chapter_index <= r.chunk // 50 * 7 % 50)""",
    "terms": """SELECT doc_id AS chunk, unnest(list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^a-z0-9]+'), lambda t: t <> '')) AS term FROM documents""",
    "lens": """SELECT doc_id AS chunk, len(list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^a-z0-9]+'), lambda t: t <> '')) AS len FROM documents""",
    "tf": "SELECT term, chunk, count(*) AS tf FROM terms GROUP BY ALL",
    "qterms": "SELECT DISTINCT chunk AS query, term FROM terms WHERE chunk % 50 = 0",
    "bm25_all": """SELECT query, chunk, near, said, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / mean))), 6) AS score
        FROM qterms JOIN tf USING (term) JOIN seen USING (query, chunk) JOIN (SELECT term, count(*) AS df FROM tf GROUP BY 1) USING (term) JOIN lens USING (chunk),
        (SELECT count(*) AS n, avg(len) AS mean FROM lens) GROUP BY ALL""",
    "bm25": "SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, chunk) AS rank FROM bm25_all QUALIFY rank <= 40",
    "bm25_said": "SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, chunk) AS rank FROM bm25_all WHERE near AND said QUALIFY rank <= 40",
    "dense_docs_all": """SELECT query, chunk, near, said, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS score
        FROM seen JOIN embeddings a ON a.vec_id = query JOIN embeddings b ON b.vec_id = chunk""",
    "dense_docs": "SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, chunk) AS rank FROM dense_docs_all QUALIFY rank <= 40",
    "dense_said": "SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, chunk) AS rank FROM dense_docs_all WHERE near AND said QUALIFY rank <= 40",
    "pars_raw": r"""SELECT doc_id, list_filter(list_transform(string_split_regex(text, '\n\s*\n'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS blank,
        list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS lines,
        length(text) - length(replace(text, chr(10), '')) AS feeds FROM documents""",
    "pars": "SELECT doc_id, CASE WHEN len(blank) <= 1 AND feeds > 5 THEN lines ELSE blank END AS pars FROM pars_raw",
    "packed_pars": "SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS ps FROM documents",
    "packed_fold": """SELECT doc_id, len(ps) AS m, list_reduce(list_prepend({'n': 0::BIGINT, 'k': 0::BIGINT},
        list_transform(ps, lambda x: {'n': length(x)::BIGINT, 'k': 0::BIGINT})),
        lambda s, x: CASE WHEN s.n > 0 AND s.n + x.n > 6500 THEN {'n': x.n, 'k': s.k + 1} ELSE {'n': s.n + x.n, 'k': s.k} END) AS s FROM packed_pars""",
    "snapped": """SELECT novel, sequence_number, CASE WHEN emotion IN ('bogus') THEN 'neutral' ELSE emotion END AS emotion,
        CASE WHEN emotion IN ('happy','angry','sad','fearful') THEN intensity WHEN emotion IN ('warm','serious','whisper') AND intensity = 'high' THEN 'high'
        ELSE 'low' END AS intensity FROM entries""",
}


def with_views(sql: str) -> str:
    """The query behind the views that it names, themselves or through others."""
    import re

    used: list[str] = []

    def need(text: str) -> None:
        for name in VIEWS:
            if re.search(rf"\b{name}\b", text) and name not in used:
                need_own = VIEWS[name]
                need(re.sub(rf"\b{name}\b", "", need_own))
                if name not in used:
                    used.append(name)

    need(sql)
    if not used:
        return sql
    head = "WITH RECURSIVE " if re.match(r"\s*WITH RECURSIVE\b", sql) else "WITH "
    own = re.match(r"\s*WITH (?:RECURSIVE )?", sql)
    views = ",\n".join(f"{n} AS ({VIEWS[n]})" for n in used)
    return head + views + (",\n" + sql[own.end() :] if own else "\n" + sql)
