"""The same results in DuckDB SQL, for the operators that SQL can express."""

from __future__ import annotations

#: DuckDB form of "lower-case A-Z only".
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"list_filter(regexp_split_to_array({_LOWER}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '')"

OP9 = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS words FROM documents),
i AS (SELECT item_id, {_WORDS} AS words FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, list_slice(words, k, k + least(len(words), 10) - 1) AS win
  FROM (SELECT item_id, words, unnest(range(1, len(words) - least(len(words), 10) + 2)) AS k FROM i WHERE len(words) > 0)),
lengths AS (SELECT DISTINCT len(win) AS n FROM windows),
spread AS (
  SELECT doc_id, k, n, list_slice(words, k, k + n - 1) AS win
  FROM (SELECT doc_id, words, n, unnest(range(1, len(words) - n + 2)) AS k FROM d, lengths WHERE len(words) >= n)),
hits AS (SELECT s.doc_id, s.k, s.n, w.item_id FROM spread s JOIN windows w ON s.win = w.win),
words_hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS p FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.words) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words_hit USING (doc_id) LEFT JOIN items USING (doc_id)
"""

_SPACED = f"list_filter(regexp_split_to_array({_LOWER}, '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')"


def _near_copies(width: int, percent: int) -> str:
    """Components of documents whose sets of ``width``-word shingles are similar."""
    return f"""
WITH RECURSIVE d AS (SELECT doc_id, {_SPACED} AS words FROM documents),
s AS (
  SELECT DISTINCT doc_id, list_slice(words, k, k + least(len(words), {width}) - 1) AS shingle
  FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - {width - 1}, 1) + 1)) AS k FROM d WHERE len(words) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b USING (shingle) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM pairs JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * c >= {percent} * (x.n + y.n - c)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, r.component_id
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a) r USING (doc_id)
"""


OP6 = _near_copies(5, 75)
OP11 = f"SELECT *, doc_id = component_id AS kept FROM ({_near_copies(3, 85)})"

OP13 = f"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, {_LOWER} AS text FROM documents),
pieces AS (SELECT lang, unnest(regexp_split_to_array(text, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM d),
w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[ \\t]+'), lambda x: x <> '') AS words FROM pieces),
lengths AS (SELECT unnest(range(1, 5)) AS size),
grams AS (
  SELECT lang, size, list_slice(words, k, k + size - 1) AS p
  FROM (SELECT lang, words, size, unnest(range(1, len(words) - size + 2)) AS k FROM w, lengths WHERE len(words) >= size)),
f AS (SELECT lang, size, p, count(*) AS a FROM grams GROUP BY lang, size, p HAVING count(*) >= 30),
n AS (SELECT lang, count(*) AS n FROM grams WHERE size = 1 GROUP BY lang),
cuts AS (SELECT *, unnest(range(1, size)) AS k FROM f WHERE size > 1),
sides AS (SELECT c.lang, c.size, c.p, c.a, c.k, x.a AS l, y.a AS r,
    CAST((2000000::HUGEINT * c.a) // (x.a + y.a) AS BIGINT) AS score
  FROM cuts c JOIN f x ON x.lang = c.lang AND x.p = list_slice(c.p, 1, c.k)
  JOIN f y ON y.lang = c.lang AND y.p = list_slice(c.p, c.k + 1, c.size)),
lowest AS (SELECT * FROM sides QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, k) = 1),
longer AS (
  SELECT lang, part, max(a) AS a FROM (
    SELECT lang, list_slice(p, 1, size - 1) AS part, a FROM f WHERE size > 2
    UNION ALL SELECT lang, list_slice(p, 2, size), a FROM f WHERE size > 2) GROUP BY lang, part),
kept AS (SELECT c.lang, array_to_string(c.p, ' ') AS phrase, c.a, c.l, c.r, c.score
  FROM lowest c LEFT JOIN longer g ON g.lang = c.lang AND g.part = c.p WHERE g.a IS NULL OR 100 * g.a < 80 * c.a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM kept JOIN n USING (lang) QUALIFY rank <= 2000
"""

SQL: dict[str, str] = {"op6_count_vector_join": OP6, "op9_decontaminate": OP9, "op11_bbit_minhash": OP11, "op13_best_first": OP13}
