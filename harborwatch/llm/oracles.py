"""SQL counterparts of the queries, written from their definitions, for one machine and small tables."""

from __future__ import annotations

from harborwatch.llm import interleave, line_runs, repetition, variants

_WORDS = r"[^\x20\x09-\x0D]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SPACES = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def repeats() -> str:
    def grams(n: int) -> str:
        later = ", ".join(f"lead(word, {k}) OVER w" for k in range(1, n))
        return f"""g{n} AS (SELECT doc_id, i, CASE WHEN lead(word, {n - 1}) OVER w IS NOT NULL
              THEN concat_ws(' ', word, {later}) END AS gram FROM words WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
          r{n} AS (SELECT doc_id, i, gram IS NOT NULL AND row_number() OVER (PARTITION BY doc_id, gram ORDER BY i) > 1 AS again,
                          gram IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, gram) > 1 AS repeated FROM g{n}),
          c{n} AS (SELECT doc_id, cast(sum(CASE WHEN covered THEN size ELSE 0 END) AS bigint) AS dup_{n}gram_chars,
                          count_if(in_repeat) AS in_repeat
                   FROM (SELECT r.doc_id, size, bool_or(again) OVER w AS covered, bool_or(repeated) OVER w AS in_repeat
                         FROM r{n} r JOIN words ON words.doc_id = r.doc_id AND words.i = r.i
                         WINDOW w AS (PARTITION BY r.doc_id ORDER BY r.i ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)) x
                   GROUP BY doc_id)"""

    lengths = list(repetition.MAX_COVERAGE)
    joins = " ".join(f"LEFT JOIN c{n} ON c{n}.doc_id = d.doc_id" for n in lengths)
    coverage = ", ".join(f"coalesce(dup_{n}gram_chars, 0) AS dup_{n}gram_chars" for n in lengths)
    good = " AND ".join(f"dup_{n}gram_chars <= {most}e0 * word_chars" for n, most in repetition.MAX_COVERAGE.items())
    columns = ("doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, dup_line_chars, "
               + ", ".join(f"dup_{n}gram_chars" for n in lengths))
    return f"""
WITH lists AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{_WORDS}') AS ws FROM documents),
words AS (SELECT doc_id, i, word, length(word) AS size FROM (
  SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM lists) u),
{", ".join(grams(n) for n in lengths)},
cut AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM lists),
lines AS (SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id, line ORDER BY i) AS place
          FROM (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM cut) u
          WHERE regexp_matches(line, '{_WORDS}')),
l AS (SELECT doc_id, count_if(place > 1) AS n_dup_lines, cast(sum(length(line)) AS bigint) AS line_chars,
             cast(sum(CASE WHEN place > 1 THEN length(line) ELSE 0 END) AS bigint) AS dup_line_chars FROM lines GROUP BY doc_id),
s AS (SELECT doc_id, count(*) AS n_words, cast(sum(size) AS bigint) AS word_chars FROM words GROUP BY doc_id),
m AS (SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(word_chars, 0) AS word_chars,
             length(regexp_replace(d.text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
             coalesce(c{repetition.WINDOW}.in_repeat, 0) AS n_repeat_words, coalesce(dup_line_chars, 0) AS dup_line_chars,
             coalesce(line_chars, 0) AS line_chars, {coverage}
      FROM lists d LEFT JOIN s ON s.doc_id = d.doc_id LEFT JOIN l ON l.doc_id = d.doc_id {joins}),
b AS (SELECT *, n_words < {repetition.MIN_WORDS} OR 100 * n_repeat_words > {repetition.MAX_REPEAT_PERCENT} * n_words AS base_failed
      FROM m)
SELECT {columns}, base_failed, NOT base_failed AND dup_line_chars <= {repetition.MAX_DUP_LINE_CHARS}e0 * line_chars AND {good} AS kept
FROM b"""


def near_copies(size: int, percent: int) -> str:
    shingle = " || ' ' || ".join(f"ws[i + {k}]" for k in range(size))
    return f"""
WITH RECURSIVE lists AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{_WORDS}') AS ws FROM documents),
sets AS (
  SELECT DISTINCT doc_id, {shingle} AS shingle
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - {size} + 2)) AS i FROM lists WHERE len(ws) >= {size}) x
  UNION SELECT doc_id, array_to_string(ws, ' ') FROM lists WHERE len(ws) BETWEEN 1 AND {size} - 1),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
links AS (
  SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n FROM sets x JOIN sets y ON x.shingle = y.shingle
                    AND x.doc_id <> y.doc_id GROUP BY ALL) p
  JOIN sizes sa ON sa.doc_id = a JOIN sizes sb ON sb.doc_id = b WHERE 100 * p.n >= {percent} * (sa.n + sb.n - p.n)),
reach AS (SELECT doc_id, doc_id AS other FROM lists UNION SELECT reach.doc_id, links.b FROM reach JOIN links ON links.a = reach.other)
SELECT l.doc_id, coalesce(max(n), 0) AS n_shingles, min(other) AS component_id, l.doc_id = min(other) AS kept
FROM lists l JOIN reach r ON r.doc_id = l.doc_id LEFT JOIN sizes s ON s.doc_id = l.doc_id GROUP BY l.doc_id"""


def shared_lines() -> str:
    return f"""
WITH cut AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
lines AS (SELECT *, translate(trim(line, {_SPACES}), '{_UPPER}', '{_LOWER}') AS key FROM (
  SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM cut) u),
keys AS (SELECT key, max(doc_id) AS top FROM lines WHERE length(key) >= {line_runs.MIN_CHARS}
         GROUP BY key HAVING count(DISTINCT doc_id) >= {line_runs.MIN_DOCS}),
marked AS (SELECT l.*, k.top IS NOT NULL AND l.doc_id <> k.top AS gone FROM lines l LEFT JOIN keys k ON k.key = l.key)
SELECT doc_id, count(*) AS n_lines, count_if(gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id"""


#: Table of the reflected polynomial, and the checksum of a text ``{0}`` beside it.
_CRC_TABLE = """crc_steps AS (
  SELECT range AS i, range::BIGINT AS c, 0 AS k FROM range(256)
  UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM crc_steps WHERE k < 8),
crc_table AS (SELECT list(c ORDER BY i) AS crc_of FROM crc_steps WHERE k = 8)"""
_CRC = """xor(list_reduce(list_transform(regexp_extract_all(hex(encode({0})), '..'), lambda x: ('0x' || x)::BIGINT),
  lambda c, x: xor(c >> 8, crc_of[(xor(c, x) & 255)::INT + 1]), 4294967295::BIGINT), 4294967295)"""


def interleaved() -> str:
    n = interleave.SHARDS
    digits = interleave._HASH_BITS // 4
    return f"""
WITH RECURSIVE {_CRC_TABLE},
rows AS (SELECT doc_id, CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS stratum, strlen(text) + 16 AS size,
                {_CRC.format("text")} AS text_crc32
         FROM (SELECT doc_id, source, coalesce(text, '') AS text FROM documents) d, crc_table),
shuffled AS (SELECT *, ('0x' || substr(md5('{interleave.SEED}:' || doc_id || ':' || text_crc32), 1, {digits}))::BIGINT AS mix FROM rows),
paced AS (SELECT *, (2 * row_number() OVER (PARTITION BY stratum ORDER BY mix, doc_id, text_crc32) - 1)
                    / (2 * count(*) OVER (PARTITION BY stratum)) AS pace FROM shuffled),
placed AS (SELECT *, row_number() OVER (ORDER BY pace, stratum, mix, doc_id, text_crc32) - 1 AS place,
                  count(*) OVER () AS total FROM paced),
dealt AS (SELECT *, place * {n} // total AS shard FROM placed)
SELECT doc_id, size, text_crc32, 'rows' AS law, shard::INT AS shard,
       place - min(place) OVER (PARTITION BY shard) AS slot, NULL::INT AS grown_shard FROM dealt"""


def spelling_variants() -> str:
    return f"""
WITH RECURSIVE {_CRC_TABLE},
found AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS run FROM documents),
low AS (SELECT doc_id, translate(run, '{_UPPER}', '{_LOWER}') AS run, count(*) AS times FROM found GROUP BY ALL),
hashed AS (SELECT run, times, {_CRC.format("doc_id || ':' || run")} AS h FROM low, crc_table),
spelt AS (SELECT times, CASE WHEN h % {variants.LOSS} = 0
                             THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word
          FROM hashed),
words AS (SELECT word, sum(times)::BIGINT AS n FROM spelt WHERE length(word) >= {variants.LEAST_LETTERS}
          GROUP BY word HAVING sum(times) >= {variants.LEAST_COUNT}),
places AS (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM words),
less AS (SELECT word, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM places),
near AS (SELECT a.word, b.word AS near FROM less a JOIN less b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
         UNION SELECT l.word, w.word FROM less l JOIN words w ON w.word = l.rest
         UNION SELECT w.word, l.word FROM less l JOIN words w ON w.word = l.rest),
best AS (SELECT near.word, count(*) AS n_near, arg_min(near, (-n, near)) AS near, max(n) AS most
         FROM near JOIN words ON words.word = near.near GROUP BY near.word),
forms AS (SELECT words.word, words.n, coalesce(n_near, 0) AS n_near,
                 CASE WHEN most >= {variants.RATIO} * words.n THEN near END AS form,
                 CASE WHEN most >= {variants.RATIO} * words.n THEN most END AS form_n
          FROM words LEFT JOIN best ON best.word = words.word),
steps AS (SELECT word, word AS at FROM forms UNION ALL SELECT steps.word, forms.form FROM steps JOIN forms ON forms.word = steps.at
          WHERE forms.form IS NOT NULL)
SELECT forms.word, forms.form, steps.at AS root, forms.n, forms.n_near, forms.form_n
FROM steps JOIN forms AS ends ON ends.word = steps.at AND ends.form IS NULL JOIN forms ON forms.word = steps.word"""
