"""DuckDB SQL for the queries of this package that SQL can express."""

from __future__ import annotations

LOWERED = """translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"""

FILL_IN_MIDDLE = r"""
WITH cut AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS digest,
         regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS units
  FROM documents
), drawn AS (
  SELECT *, len(units) AS n, ('0x' || substr(digest, 1, 8))::BIGINT % (len(units) + 1) AS one, ('0x' || substr(digest, 9, 8))::BIGINT % (len(units) + 1) AS two,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>')
                OR ('0x' || substr(digest, 17, 8))::BIGINT % 100 >= 50 THEN 'plain'
              WHEN ('0x' || substr(digest, 25, 8))::BIGINT % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
  FROM cut
), parts AS (
  SELECT *, array_to_string(units[1:least(one, two)], '') AS prefix, array_to_string(units[least(one, two) + 1:greatest(one, two)], '') AS middle,
         array_to_string(units[greatest(one, two) + 1:], '') AS suffix
  FROM drawn
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                        ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM parts
"""

COLLOCATIONS = r"""
WITH piece AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(regexp_split_to_array(<lowered>, '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
), cut AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS words FROM piece
), total AS (
  SELECT lang, sum(len(words))::HUGEINT AS n FROM cut GROUP BY lang
), place AS (
  SELECT lang, words, size, unnest(range(1, len(words) - size + 2)) AS start FROM cut, range(1, 6) AS t(size) WHERE len(words) >= size
), gram AS (
  SELECT lang, size, words[start:start + size - 1] AS words, count(*)::HUGEINT AS f FROM place GROUP BY ALL HAVING count(*) >= 100
), candidate AS (
  SELECT * FROM gram WHERE size > 1
), cuts AS (
  SELECT lang, size, words, f, unnest(range(1, size)) AS k FROM candidate
), scored AS (
  SELECT c.lang, c.words, c.size, c.f AS a, c.k, x.f AS l, y.f AS r, n, (1000 * c.f * n) // (x.f * y.f) AS score
  FROM cuts c JOIN gram x ON x.lang = c.lang AND x.words = c.words[1:c.k] JOIN gram y ON y.lang = c.lang AND y.words = c.words[c.k + 1:]
       JOIN total t ON t.lang = c.lang
), best AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, words ORDER BY score, k) = 1
), inside AS (
  SELECT lang, words[pos:pos + width - 1] AS words, max(f) AS around
  FROM (SELECT lang, words, f, width, unnest(range(1, size - width + 2)) AS pos FROM candidate, range(2, 5) AS t(width) WHERE width < size) GROUP BY ALL
), kept AS (
  SELECT b.*, array_to_string(b.words, ' ') AS phrase FROM best b LEFT JOIN inside i ON i.lang = b.lang AND i.words = b.words
  WHERE around IS NULL OR 100 * around < 100 * a
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r,
       n::BIGINT AS n, score::BIGINT AS score
FROM kept QUALIFY rank <= 2000
""".replace("<lowered>", LOWERED)

DECONTAMINATION = r"""
WITH doc AS MATERIALIZED (
  SELECT row_number() OVER () AS row_id, doc_id, regexp_extract_all(<lowered>, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM documents
), item AS (
  SELECT item_id, regexp_extract_all(<lowered>, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM benchmark
), widths AS (
  SELECT item_id, words, least(10, len(words)) AS width, unnest(range(1, greatest(len(words) - 10, 0) + 2)) AS start FROM item WHERE len(words) > 0
), windows AS (
  SELECT DISTINCT item_id, width, array_to_string(words[start:start + width - 1], ' ') AS w FROM widths
), sizes AS (
  SELECT DISTINCT width FROM windows
), places AS (
  SELECT row_id, width, words, unnest(range(1, len(words) - width + 2)) AS start FROM doc, sizes WHERE len(words) >= width
), found AS (
  SELECT row_id, start, p.width, item_id FROM places p JOIN windows w ON p.width = w.width AND array_to_string(p.words[start:start + p.width - 1], ' ') = w.w
), hit AS (
  SELECT row_id, count(DISTINCT word) AS n_hit FROM (SELECT row_id, unnest(range(start, start + width)) AS word FROM found) GROUP BY row_id
), names AS (
  SELECT row_id, count(item_id) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS joined
  FROM (SELECT DISTINCT row_id, item_id::VARCHAR AS item_id FROM found) GROUP BY row_id
)
SELECT doc_id, len(words) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(joined, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN hit USING (row_id) LEFT JOIN names USING (row_id)
""".replace("<lowered>", LOWERED)
