"""DuckDB SQL of the queries over words: spelling variants and periodic runs, each over the whole table."""

from __future__ import annotations

#: The table of the checksum, made from its polynomial.
CRC = r"""
crc_table AS (
  SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, b: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS crc FROM range(256) r(i))"""


def crc32(bytes_: str) -> str:
    """The unsigned checksum of a list of bytes, for rows that have the column crc of crc_table."""
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {bytes_}), lambda c, b: xor(c >> 8, crc[(xor(c, b) & 255) + 1])), 4294967295)"


#: Words from the texts, near words by what is left of them when one letter goes, forms and roots.
OP11_SQL = rf"""
WITH RECURSIVE {CRC},
runs AS (
  SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS times
  FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS run FROM documents) GROUP BY ALL),
coded AS (
  SELECT run, times, hex(encode(concat(doc_id, ':', run))) AS x FROM runs WHERE length(run) >= 6),
summed AS (
  SELECT run, times, {crc32("list_transform(range(length(x) // 2), lambda i: CAST(concat('0x', substr(x, 2 * i + 1, 2)) AS BIGINT))")} AS h FROM coded, crc_table),
counted AS (
  SELECT CASE WHEN h % 199 = 0 THEN concat(left(run, (h % length(run))::INT), substr(run, (h % length(run))::INT + 2)) ELSE run END AS word, sum(times)::BIGINT AS n FROM summed GROUP BY 1),
words AS (SELECT word, n FROM counted WHERE length(word) >= 6 AND n >= 5),
less AS (
  SELECT word, n, unnest(range(1, length(word) + 1)) AS i, concat(left(word, (i - 1)::INT), substr(word, (i + 1)::INT)) AS x FROM words),
pairs AS (
  SELECT a.word, b.word AS other FROM less a JOIN less b ON a.i = b.i AND a.x = b.x AND a.word <> b.word
  UNION SELECT a.word, b.word FROM less a JOIN words b ON a.x = b.word
  UNION SELECT b.word, a.word FROM less a JOIN words b ON a.x = b.word),
near AS (
  SELECT p.word, p.other, w.n FROM pairs p JOIN words w ON p.other = w.word),
best AS (
  SELECT word, count(*) AS n_near, min(struct_pack(less := -n, other := other)) AS x FROM near GROUP BY 1),
named AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN -x.less >= 5 * n THEN x.other END AS form, CASE WHEN -x.less >= 5 * n THEN -x.less END AS form_n FROM words w LEFT JOIN best USING (word)),
follow AS (
  SELECT word, word AS at FROM named UNION ALL SELECT f.word, n.form FROM follow f JOIN named n ON f.at = n.word WHERE n.form IS NOT NULL),
ends AS (SELECT f.word, f.at AS root FROM follow f JOIN named n ON f.at = n.word WHERE n.form IS NULL)
SELECT word, form, root, n, n_near, form_n FROM named JOIN ends USING (word)
"""

#: Equal words a period apart make islands of six at least; those of a run that starts and ends alike belong to its smallest period.
OP13_SQL = rf"""
WITH {CRC},
given AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w, len(w) AS n, {crc32("list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)")} AS h FROM documents, crc_table),
tails AS (
  SELECT *, h % 10 = 0 AND n > 0 AS tail, CASE WHEN n > 0 THEN (h // 10) % n ELSE 0 END AS a, 1 + (n - a) // (3 + (h // 10) % 8) AS p FROM given),
texts AS (
  SELECT doc_id, n, CASE WHEN tail THEN list_transform(range(n), lambda i: CASE WHEN i >= a THEN w[a + (i - a) % p + 1] ELSE w[i + 1] END) ELSE w END AS w FROM tails),
placed AS (
  SELECT doc_id, unnest(range(n)) AS i, unnest(w) AS x FROM texts),
grams AS (
  SELECT doc_id, i, string_agg(x, ' ') OVER six AS g, count(*) OVER six AS k FROM placed WINDOW six AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 5 FOLLOWING)),
equals AS (
  SELECT a.doc_id, a.i, b.i - a.i AS q FROM grams a JOIN grams b ON a.doc_id = b.doc_id AND a.g = b.g AND b.i > a.i AND a.k = 6 AND b.k = 6),
islands AS (
  SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM equals),
runs AS (
  SELECT doc_id, start, length, min(q) AS period FROM (SELECT doc_id, q, min(i) AS start, count(*) + 5 + q AS length FROM islands GROUP BY doc_id, q, island)
  WHERE length >= greatest(12, 2 * q) GROUP BY ALL),
said AS (
  SELECT doc_id, count(*) AS n_runs, string_agg(concat(start, ',', length, ',', period, chr(10)), '' ORDER BY start, period) AS s,
    max(struct_pack(length := length, s := -start, p := -period)) AS best FROM runs GROUP BY 1),
gone AS (
  SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM runs),
kept AS (
  SELECT p.doc_id, string_agg(p.x, ' ' ORDER BY p.i) AS c FROM placed p ANTI JOIN gone g ON p.doc_id = g.doc_id AND p.i = g.i GROUP BY 1)
SELECT t.doc_id, coalesce(n_runs, 0) AS n_runs, -best.s AS start, best.length AS length, -best.p AS period, 1000 * best.length // -best.p AS exponent_milli,
  sha256(coalesce(s, '')) AS runs_sha256, sha256(coalesce(c, '')) AS collapsed_sha256
FROM texts t LEFT JOIN said USING (doc_id) LEFT JOIN kept USING (doc_id)
"""
