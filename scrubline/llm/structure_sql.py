"""DuckDB twins of the periodic runs and of conversation repair, written from the definitions, not from the operators."""

from __future__ import annotations

# the checksum of a decimal text, bit by bit and then byte by byte
_CRC_TABLE = """crc_table AS (
  SELECT list_transform(range(256), lambda n: list_reduce(range(8),
    lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, CAST(n AS BIGINT))) AS crcs)"""


def _crc(text: str) -> str:
    codes = f"list_transform(list_filter(string_split({text}, ''), lambda x: x <> ''), lambda x: CAST(ascii(x) AS BIGINT))"
    return f"xor(list_reduce({codes}, lambda c, b: xor(c // 256, crcs[xor(c, b) % 256 + 1]), CAST(4294967295 AS BIGINT)), 4294967295)"


# every pair of equal words of a text; pairs in a row at one distance are a match
PERIODIC_RUNS = f"""
WITH {_CRC_TABLE},
parted AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS own,
    {_crc("coalesce(CAST(doc_id AS VARCHAR), '')")} AS h
  FROM documents, crc_table),
placed AS (
  SELECT *, row_number() OVER () AS row, len(own) AS n, h // 10 AS g FROM parted),
planted AS (
  SELECT *, CASE WHEN h % 10 = 0 AND n > 0 THEN g % n END AS a FROM placed),
texts AS (
  SELECT row, doc_id, n, CASE WHEN a IS NULL THEN own ELSE
    list_transform(range(n), lambda i: own[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + g % 8)) END]) END AS words
  FROM planted),
words AS (
  SELECT row, doc_id, n, unnest(words) AS word, unnest(range(n)) AS i FROM texts),
matches AS (
  SELECT x.row, y.i - x.i AS period, x.i FROM words x JOIN words y ON x.row = y.row AND x.word = y.word AND y.i > x.i AND 3 * (y.i - x.i) <= x.n),
islands AS (
  SELECT row, period, i, i - row_number() OVER (PARTITION BY row, period ORDER BY i) AS island FROM matches),
stretches AS (
  SELECT row, period, min(i) AS start, count(*) + period AS length FROM islands GROUP BY row, period, island
  HAVING count(*) + period >= greatest(24, 3 * period)),
runs AS (
  SELECT * FROM stretches r WHERE NOT EXISTS (
    SELECT 1 FROM stretches s WHERE s.row = r.row AND s.period < r.period AND s.start <= r.start AND s.start + s.length >= r.start + r.length)),
reports AS (
  SELECT row, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS listed FROM runs GROUP BY row),
ranked AS (
  SELECT r.* FROM runs r WHERE NOT EXISTS (
    SELECT 1 FROM runs s WHERE s.row = r.row AND (s.length * r.period > r.length * s.period
      OR (s.length * r.period = r.length * s.period AND (s.start < r.start OR (s.start = r.start AND s.period < r.period)))))),
dropped AS (
  SELECT DISTINCT row, unnest(range(start + period, start + length)) AS i FROM runs),
kept AS (
  SELECT w.row, string_agg(w.word, ' ' ORDER BY w.i) AS line FROM words w LEFT JOIN dropped d ON w.row = d.row AND w.i = d.i
  WHERE d.i IS NULL GROUP BY w.row)
SELECT doc_id, CAST(coalesce(n_runs, 0) AS BIGINT) AS n_runs, CAST(start AS BIGINT) AS start, CAST(length AS BIGINT) AS length,
  CAST(period AS BIGINT) AS period, CAST(1000 * length // period AS BIGINT) AS exponent_milli,
  sha256(coalesce(listed, '')) AS runs_sha256, sha256(coalesce(line, '')) AS collapsed_sha256
FROM texts LEFT JOIN reports USING (row) LEFT JOIN ranked USING (row) LEFT JOIN kept USING (row)"""


def _add(state: str, cost: str, edit: str) -> str:
    """An audit with its cost in eight digits before it, after one more edit; null stays null."""
    return f"(lpad(CAST(CAST(left({state}, 8) AS INTEGER) + {cost} AS VARCHAR), 8, '0') || substr({state}, 9) || '{edit}')"


# e, s, u, a: the least cost and audit after which the roles so far end in nothing, s, u or a
_BEFORE_USER = "least(e, s, a)"
CONVERSATION_REPAIR = f"""
WITH RECURSIVE {_CRC_TABLE},
keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    {_crc("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")} % 20 AS fault
  FROM conversations, crc_table),
damaged AS (
  SELECT conv_id, turn, CASE WHEN fault = 4 THEN 'user' ELSE role END AS role,
    CASE fault WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(CASE WHEN fault = 3 THEN [1, 2] ELSE [1] END) AS copy
  FROM keyed WHERE fault <> 0),
ordered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS i,
    regexp_replace(text, '[\\x20\\x09-\\x0D]+$', '') AS shown
  FROM damaged),
facts AS (
  SELECT conv_id, turn, role, text, i, left(role, 1) AS initial, shown = '' AS blank,
    row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS seen,
    shown <> '' AND right(shown, 1) NOT IN ('.', '!', '?') AS cut,
    lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before
  FROM ordered),
counted AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) AS n,
    count(*) FILTER (blank) AS blank, count(*) FILTER (seen AND NOT blank) AS duplicate, count(*) FILTER (cut AND NOT seen) AS truncated,
    count(*) FILTER (before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal
  FROM facts GROUP BY conv_id),
steps AS (
  SELECT conv_id, CAST(0 AS BIGINT) AS i, '00000000' AS e, CAST(NULL AS VARCHAR) AS s, '00000002I' AS u, '00000004II' AS a FROM counted
  UNION ALL
  SELECT conv_id, i, e, s, least(u, {_add(_BEFORE_USER, "2", "I")}) AS u,
    least(a, {_add(f"least(u, {_add(_BEFORE_USER, '2', 'I')})", "2", "I")}) AS a
  FROM (
    SELECT p.conv_id, f.i, {_add("e", "3", "D")} AS e,
      least({_add("s", "3", "D")}, CASE WHEN NOT blank AND NOT seen AND initial = 's' THEN {_add("e", "CAST(cut AS INTEGER)", "K")} END) AS s,
      least({_add("u", "3", "D")}, CASE WHEN NOT blank AND NOT seen AND initial = 'u' THEN {_add(_BEFORE_USER, "CAST(cut AS INTEGER)", "K")} END,
        CASE WHEN NOT blank AND NOT seen THEN {_add(_BEFORE_USER, "2 + CAST(cut AS INTEGER)", "R")} END) AS u,
      least({_add("a", "3", "D")}, CASE WHEN NOT blank AND NOT seen AND initial = 'a' THEN {_add("u", "CAST(cut AS INTEGER)", "K")} END,
        CASE WHEN NOT blank AND NOT seen THEN {_add("u", "2 + CAST(cut AS INTEGER)", "R")} END) AS a
    FROM steps p JOIN facts f ON f.conv_id IS NOT DISTINCT FROM p.conv_id AND f.i = p.i + 1)),
chosen AS (
  SELECT c.conv_id, least(e, a) AS best FROM steps p JOIN counted c ON c.conv_id IS NOT DISTINCT FROM p.conv_id AND c.n = p.i),
edits AS (
  SELECT conv_id, j, substr(best, 8 + CAST(j AS INTEGER), 1) AS edit FROM (SELECT *, unnest(range(1, length(best) - 7)) AS j FROM chosen)),
numbered AS (
  SELECT *, count(*) FILTER (edit <> 'I') OVER (PARTITION BY conv_id ORDER BY j) AS i FROM edits),
lines AS (
  SELECT n.conv_id, n.j, n.edit, f.role, CASE WHEN n.edit = 'I' THEN '' ELSE f.text END AS text,
    row_number() OVER (PARTITION BY n.conv_id ORDER BY n.j) - 1 AS m,
    first_value(n.edit = 'K' AND f.initial = 's') OVER (PARTITION BY n.conv_id ORDER BY n.j) AS after_system
  FROM numbered n LEFT JOIN facts f ON f.conv_id IS NOT DISTINCT FROM n.conv_id AND f.i = n.i WHERE n.edit <> 'D'),
repaired AS (
  SELECT conv_id, string_agg(CASE WHEN edit = 'K' THEN role WHEN (m + CAST(coalesce(after_system, false) AS INTEGER)) % 2 = 0 THEN 'user' ELSE 'assistant' END
    || ':' || text, chr(10) ORDER BY j) AS whole
  FROM lines GROUP BY conv_id)
SELECT o.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank,
  CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate, CAST(coalesce(truncated, 0) AS BIGINT) AS truncated,
  CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, CAST(coalesce(CAST(left(best, 8) AS INTEGER), 0) AS BIGINT) AS cost,
  coalesce(substr(best, 9), '') AS audit, sha256(coalesce(whole, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o
LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN chosen b ON b.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN repaired r ON r.conv_id IS NOT DISTINCT FROM o.conv_id"""
