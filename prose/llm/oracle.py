"""DuckDB SQL for those queries that SQL can express."""

_WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')"

_QUALITY = rf"""
WITH w AS (SELECT doc_id, text, {_WORDS} AS words,
           list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines,
           coalesce(source, '') AS host FROM documents),
grams AS (SELECT doc_id, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS g
          FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 1, 1))) AS i FROM w)),
repeats AS (SELECT doc_id, i FROM grams QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
covered AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM repeats, (SELECT unnest([0, 1, 2]) AS k) GROUP BY 1),
base AS (SELECT w.doc_id, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
         length(regexp_replace(coalesce(text, ''), '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words
         FROM w LEFT JOIN covered USING (doc_id)),
line AS (SELECT DISTINCT host, text, trim(regexp_replace(lower(l), '[0-9]+', '0', 'g')) AS line FROM (SELECT host, text, unnest(lines) AS l FROM w)),
frequent AS (SELECT host, line FROM line GROUP BY ALL HAVING count(*) > 20),
gone AS (SELECT host, list(line) AS gone FROM frequent GROUP BY 1),
removed AS (SELECT doc_id, list_sum(list_transform(list_filter(lines, lambda l: list_contains(coalesce(gone, []), trim(regexp_replace(lower(l), '[0-9]+', '0', 'g')))),
            lambda l: length(regexp_replace(l, '[\x20\x09-\x0D]+', '', 'g')))) AS chars FROM w LEFT JOIN gone USING (host)),
judged AS (SELECT base.*, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, coalesce(chars, 0) AS gone
           FROM base LEFT JOIN removed USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND gone <= 0.5 * word_chars AS kept FROM judged
"""

_MIDDLE = r"""
WITH u AS (SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || doc_id) AS h,
           regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS units FROM documents),
h AS (SELECT *, len(units) AS n, list_transform([1, 9, 17, 25], lambda k: CAST('0x' || substr(h, k, 8) AS BIGINT)) AS d FROM u),
cut AS (SELECT *, least(d[1] % (n + 1), d[2] % (n + 1)) AS a, greatest(d[1] % (n + 1), d[2] % (n + 1)) AS b,
        CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR d[3] % 100 >= 50 THEN 'plain'
             WHEN d[4] % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM h),
part AS (SELECT *, array_to_string(units[1:a], '') AS p, array_to_string(units[a + 1:b], '') AS m, array_to_string(units[b + 1:], '') AS s FROM cut)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(text) AS restored_sha256 FROM part
"""

_VECTORS = """
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE label IS NOT NULL AND len(embedding) > 0
           AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
link AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
         WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
reach AS (SELECT a, b FROM link UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a)
SELECT vec_id, (SELECT count(*) FROM link WHERE a = vec_id) AS n_links, component_id, vec_id = component_id AS kept
FROM (SELECT vec_id, least(vec_id, coalesce(m, vec_id)) AS component_id FROM embeddings LEFT JOIN (SELECT a, min(b) AS m FROM reach GROUP BY 1) ON a = vec_id)
"""

ORACLE: dict[str, str] = {"op3_quality_rules": _QUALITY, "op11_fill_in_middle": _MIDDLE, "op13_embedding_dedup": _VECTORS}
