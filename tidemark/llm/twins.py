"""What the queries compute, as SQL for another engine; written apart from the operators."""

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
# only A-Z change
_FOLDED = _WORDS.replace("coalesce(text, '')",
                         "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")

OP10 = rf"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, coalesce(text, '') AS text, {_WORDS} AS w FROM documents),
places AS (SELECT r, w, len(w) AS n, unnest(range(1, len(w) + 1)) AS i FROM d),
windows AS (
  SELECT r, i, CASE WHEN i + 7 <= n THEN array_to_string(w[i:i + 7], ' ') END AS w8,
         CASE WHEN i + 4 <= n THEN array_to_string(w[i:i + 4], ' ') END AS w5,
         CASE WHEN i + 200 <= n THEN md5(array_to_string(w[i:i + 200], ' ')) END AS w201
  FROM places),
counted AS (
  SELECT r, i, w8 IS NOT NULL AND count(*) OVER (PARTITION BY r, w8) > 1 AS s8,
         w5 IS NOT NULL AND count(*) OVER (PARTITION BY r, w5) > 1 AS s5,
         w201 IS NOT NULL AND count(*) OVER (PARTITION BY r, w201) > 1 AS s201
  FROM windows),
covered AS (
  SELECT r, bool_or(s8) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) AS c8,
         bool_or(s5) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS c5, s201
  FROM counted),
spans AS (
  SELECT r, count(*) FILTER (c8) AS n8, count(*) FILTER (c5) AS n5, bool_or(s201) AS too_long FROM covered GROUP BY r),
lines AS (
  SELECT r, count(*) - count(DISTINCT line) AS dup
  FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r),
base AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
         coalesce(dup, 0)::BIGINT AS n_dup_lines, coalesce(n8, 0)::BIGINT AS n_repeat_words,
         coalesce(n5, 0)::BIGINT AS covered_words, coalesce(too_long, false) AS too_long
  FROM d LEFT JOIN spans USING (r) LEFT JOIN lines USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, covered_words,
       n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
       NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND 100 * covered_words <= 40 * n_words
         AND NOT too_long AS kept
FROM base
"""

OP9 = rf"""
WITH RECURSIVE d AS (SELECT doc_id, {_FOLDED} AS w FROM documents),
sets AS (
  SELECT DISTINCT doc_id, s FROM (
    SELECT doc_id, unnest(CASE WHEN len(w) >= 5
             THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
             ELSE [array_to_string(w, ' ')] END) AS s
    FROM d WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c
  FROM sets a JOIN sets b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (
  SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
  WHERE 100 * c >= 80 * (x.n + y.n - c)),
reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents
  UNION
  SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id
FROM documents LEFT JOIN sizes USING (doc_id)
JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a) USING (doc_id)
"""

# words with their places in code points, the number of their line, and spans united per text
_PLACED = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, {_FOLDED} AS w, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]+') AS gaps,
         regexp_matches(coalesce(text, ''), '^[\x20\x09-\x0D]') AS later
  FROM documents),
each AS (
  SELECT r, doc_id, i, w[i] AS word, CASE WHEN later THEN gaps[i] WHEN i > 1 THEN gaps[i - 1] ELSE '' END AS gap
  FROM (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM d)),
placed AS (
  SELECT r, doc_id, i, word, sum(length(gap) + length(word)) OVER o AS stop, sum(length(gap) - length(replace(gap, chr(10), ''))) OVER o AS line
  FROM each WINDOW o AS (PARTITION BY r ORDER BY i)),
windows AS (
  SELECT r, doc_id, stop - length(word) AS start, lead(stop, 49) OVER (PARTITION BY r ORDER BY i) AS stop,
         md5(array_to_string(d.w[i:i + 49], ' ')) AS body
  FROM placed JOIN d USING (r, doc_id)),
ranked AS (
  SELECT *, first_value(r) OVER o AS first_r, first_value(stop) OVER o AS first_stop, row_number() OVER o AS k
  FROM windows WHERE stop IS NOT NULL WINDOW o AS (PARTITION BY body ORDER BY doc_id NULLS LAST, r, start)),
window_spans AS (
  SELECT r, doc_id, CASE WHEN r = first_r THEN greatest(start, first_stop) ELSE start END AS start, stop FROM ranked WHERE k > 1)"""
_UNITED = """,
ends AS (SELECT *, max(stop) OVER (PARTITION BY r ORDER BY start, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM spans),
islands AS (SELECT *, count(*) FILTER (reach IS NULL OR start > reach) OVER (PARTITION BY r ORDER BY start, stop
                                         ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island FROM ends)
SELECT doc_id, min(start)::BIGINT AS start, max(stop)::BIGINT AS stop FROM islands GROUP BY r, doc_id, island
"""
OP5_PASSAGES = _PLACED + ", spans AS (SELECT * FROM window_spans)" + _UNITED
OP5 = _PLACED + """,
lines AS (
  SELECT r, doc_id, min(stop - length(word)) AS start, max(stop) AS stop, count(*) AS words, string_agg(word, ' ' ORDER BY i) AS body,
         row_number() OVER (PARTITION BY r ORDER BY line) AS unit
  FROM placed GROUP BY r, doc_id, line),
known AS (SELECT *, row_number() OVER (PARTITION BY body ORDER BY doc_id NULLS LAST, r, unit) AS k FROM lines),
runs AS (SELECT *, unit - row_number() OVER (PARTITION BY r ORDER BY unit) AS run FROM known WHERE k > 1),
paragraphs AS (SELECT r, doc_id, min(start) AS start, max(stop) AS stop FROM runs GROUP BY r, doc_id, run HAVING sum(greatest(words, (stop - start) // 10)) >= 50),
spans AS (SELECT * FROM window_spans UNION ALL SELECT * FROM paragraphs)""" + _UNITED

OP6 = rf"""
WITH d AS (SELECT doc_id, source, len({_WORDS})::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS place
      FROM d GROUP BY source),
w AS (SELECT *, CASE (place - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM s),
-- sources that reach their cap first come first; before each, what is left for it and those after it
o AS (SELECT *, row_number() OVER (ORDER BY 3 * source_size / weight, place) AS k FROM w),
l AS (SELECT *, (sum(source_size) OVER () - 3 * coalesce(sum(source_size) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING
                 AND 1 PRECEDING), 0))::DOUBLE
                / (sum(weight) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level
      FROM o),
level AS (SELECT level FROM l WHERE 3 * source_size >= weight * level ORDER BY k LIMIT 1),
t AS (SELECT source, source_size,
             CASE WHEN 3 * source_size < weight * level.level THEN (3 * source_size)::DOUBLE
                  ELSE weight * level.level END AS target
      FROM w, level),
r AS (SELECT d.doc_id, d.size, t.source_size, t.target,
             row_number() OVER (PARTITION BY d.source ORDER BY d.size, d.doc_id) AS k,
             CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS e,
             (('0x' || substr(md5('mix:' || coalesce('s' || d.source, 'n')), 1, 4))::INTEGER + 0.5::DOUBLE) / 65536 AS u
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, (least(floor(e * k + u) - floor(e * (k - 1) + u), 3) * size)::BIGINT AS taken
FROM r
"""

OP2 = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (
  SELECT a.vec_id AS query_id, b.vec_id, list_inner_product(a.q::DOUBLE[], b.q::DOUBLE[])::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""

# crc32 by its definition: the table by the polynomial, then byte after byte of the UTF-8 text
_CRC = r"""crc AS (
  SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0],
              lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t
  FROM (SELECT unnest(range(256)) AS i))"""


def _crc32(text: str) -> str:
    """SQL for the crc32 of a text, in a query over the table crc."""
    octets = f"list_transform(range(length(hex(encode({text}))) // 2), lambda i: ('0x' || substr(hex(encode({text})), 2 * i + 1, 2))::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295, {octets}), lambda c, b: xor(c >> 8, crc.t[1 + (xor(c, b) & 255)])), 4294967295)"


_AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

OP11 = rf"""
WITH RECURSIVE {_CRC},
occurring AS (
  SELECT doc_id, run, count(*) AS k FROM (
    SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), {_AZ}), '[A-Za-z\x{{C0}}-\x{{FF}}]+')) AS run FROM documents)
  WHERE length(run) >= 7 GROUP BY ALL),
hashed AS (SELECT run, k, CASE WHEN doc_id IS NOT NULL THEN {_crc32("doc_id::VARCHAR || ':' || run")} END AS h FROM occurring, crc),
spelt AS (
  SELECT k, CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word
  FROM hashed),
v AS MATERIALIZED (SELECT word, sum(k)::BIGINT AS n FROM spelt WHERE length(word) >= 7 GROUP BY word HAVING sum(k) >= 2),
cut AS MATERIALIZED (
  SELECT word, n, substr(word, 1, i) AS head, substr(word, i + 2) AS tail FROM (SELECT *, unnest(range(length(word))) AS i FROM v)),
pairs AS (
  SELECT a.word, b.word AS near, b.n AS near_n FROM cut a JOIN cut b ON a.head = b.head AND a.tail = b.tail AND a.word <> b.word
  UNION SELECT v.word, cut.word, cut.n FROM v JOIN cut ON v.word = cut.head || cut.tail
  UNION SELECT cut.word, v.word, v.n FROM v JOIN cut ON v.word = cut.head || cut.tail),
best AS (SELECT word, count(*) AS n_near, min((-near_n, near)) AS b FROM pairs GROUP BY word),
judged AS MATERIALIZED (
  SELECT word, n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN -b[1] >= 10 * n THEN b[2] END AS form,
         CASE WHEN -b[1] >= 10 * n THEN -b[1] END AS form_n
  FROM v LEFT JOIN best USING (word)),
walk AS (
  SELECT word, word AS root, 0 AS steps FROM judged
  UNION ALL SELECT walk.word, judged.form, steps + 1 FROM walk JOIN judged ON walk.root = judged.word WHERE judged.form IS NOT NULL),
ends AS (SELECT word, max_by(root, steps) AS root FROM walk GROUP BY word)
SELECT word, form, root, n, n_near, form_n::BIGINT AS form_n FROM judged JOIN ends USING (word)
"""


def _field(value: str) -> str:
    return f"CASE WHEN {value} IS NULL THEN '-' ELSE strlen({value}::VARCHAR) || ':' || {value} END"


def _row_digest(text: str) -> str:
    return "sha256(" + " || ".join(_field(x) for x in ("doc_id", "source", "lang", "n_chars", text)) + ")"


OP12 = rf"""
WITH RECURSIVE {_CRC},
d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce('.' || lang, '') AS grp, {_row_digest("text")} AS leaf, {_row_digest("changed")} AS seen
  FROM (SELECT *, CASE WHEN doc_id IS NOT NULL AND {_crc32("coalesce(doc_id, 0)::VARCHAR")} % 3 = 0
                       THEN translate(text, {_AZ}) ELSE text END AS changed FROM documents, crc)),
leaves AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS LAST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY grp) AS n FROM d),
low AS (
  SELECT grp, 0 AS lvl, idx, leaf AS h, n FROM leaves
  UNION ALL
  SELECT grp, lvl + 1, idx // 8, sha256(string_agg(h, '' ORDER BY idx)), (n + 7) // 8 FROM low WHERE n > 1 GROUP BY grp, lvl, idx // 8, n),
subroots AS MATERIALIZED (SELECT grp, h, row_number() OVER (ORDER BY grp) - 1 AS idx, count(*) OVER () AS n FROM low WHERE n = 1),
high AS (
  SELECT 0 AS lvl, idx, h, n FROM subroots
  UNION ALL
  SELECT lvl + 1, idx // 8, sha256(string_agg(h, '' ORDER BY idx)), (n + 7) // 8 FROM high WHERE n > 1 GROUP BY lvl, idx // 8, n),
-- the upper tree goes on where a group's tree ends
nodes AS (SELECT grp, lvl, idx, h, n FROM low UNION ALL SELECT '*', lvl, idx, h, n FROM high),
sides AS MATERIALIZED (
  SELECT grp, lvl, idx, coalesce(string_agg(h, '') OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS before,
         coalesce(string_agg(h, '') OVER (o ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS after
  FROM nodes WHERE n > 1 WINDOW o AS (PARTITION BY grp, lvl, idx // 8 ORDER BY idx)),
climb AS (
  SELECT r, grp, 0 AS lvl, idx, seen AS h, '' AS proof FROM leaves
  UNION ALL
  SELECT r, grp, lvl + 1, idx // 8, sha256(before || h || after), proof || before || after FROM climb JOIN sides USING (grp, lvl, idx)),
inner_end AS (SELECT r, grp, max_by(h, lvl) AS h, max_by(proof, lvl) AS proof FROM climb GROUP BY r, grp),
upward AS (
  SELECT r, 0 AS lvl, s.idx, e.h, proof FROM inner_end e JOIN subroots s USING (grp)
  UNION ALL
  SELECT r, u.lvl + 1, u.idx // 8, sha256(before || h || after), proof || before || after
  FROM upward u JOIN sides s ON s.grp = '*' AND s.lvl = u.lvl AND s.idx = u.idx),
ends AS (SELECT r, max_by(h, lvl) AS folded_root, max_by(proof, lvl) AS proof FROM upward GROUP BY r)
SELECT doc_id, leaf, s.h AS subroot, (SELECT h FROM high WHERE n = 1) AS root, sha256(proof) AS proof_sha256, folded_root,
       folded_root = (SELECT h FROM high WHERE n = 1) AS verified
FROM leaves JOIN ends USING (r) JOIN subroots s USING (grp)
"""

SQL: dict[str, str] = {"op2_exact_top_k": OP2, "op5_substring_dedup": OP5, "op5_passage_dedup": OP5_PASSAGES,
                       "op6_mixing": OP6, "op9_ngram_join": OP9,
                       "op10_quality_rules": OP10,
                       "op11_spelling_variants": OP11, "op12_merkle_manifest": OP12}
