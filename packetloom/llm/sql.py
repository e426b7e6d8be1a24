"""DuckDB SQL of the corpus queries that SQL can express, newer ones; older ones stand in ``queries``."""

from __future__ import annotations

# The CRC-32 of a text's UTF-8 bytes, by the usual table of 256 remainders.
_CRC = r"""
crc_table AS (
  SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0],
              lambda c, x: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS remainders
  FROM range(256) AS r(i)),
"""


def _crc(text: str) -> str:
    """SQL of the CRC-32 of ``text``, beside ``crc_table``."""
    read = f"list_transform(range(strlen({text})), lambda i: ('0x' || substr(hex(encode({text})), 2 * i + 1, 2))::BIGINT)"
    step = "lambda c, b: xor(c >> 8, remainders[xor(c & 255, b) + 1])"
    return f"xor(list_reduce(list_concat([4294967295::BIGINT], {read}), {step}), 4294967295)"


_FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def _leaf(n_chars: str) -> str:
    values = [n_chars if c == "n_chars" else c for c in _FIELDS]
    return "sha256(" + " || ".join(f"coalesce(strlen(({v})::VARCHAR)::VARCHAR || ':' || ({v})::VARCHAR, '-')" for v in values) + ")"


MERKLE = f"""
WITH RECURSIVE {_CRC}
leaves AS (
  SELECT doc_id, lang, {_leaf("n_chars")} AS h,
         CASE WHEN {_crc("doc_id::VARCHAR")} % 7 = 0 THEN {_leaf("n_chars + 1")} ELSE {_leaf("n_chars")} END AS changed
  FROM documents, crc_table),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id, h) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n FROM leaves),
tree AS (
  SELECT lang, 0 AS level, pos, n, h FROM placed
  UNION ALL
  SELECT lang, level + 1, pos // 2, (max(n) + 1) // 2, sha256(string_agg(h, '' ORDER BY pos))
  FROM tree WHERE n > 1 GROUP BY lang, level, pos // 2),
langs AS (
  SELECT lang, h, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM tree WHERE n = 1),
upper_tree AS (
  SELECT 0 AS level, pos, n, h FROM langs
  UNION ALL
  SELECT level + 1, pos // 2, (max(n) + 1) // 2, sha256(string_agg(h, '' ORDER BY pos))
  FROM upper_tree WHERE n > 1 GROUP BY level, pos // 2),
root AS (SELECT h AS root FROM upper_tree WHERE n = 1),
lower_steps AS (
  SELECT p.lang, p.pos, a.level, (p.pos >> a.level) & 1 AS slot, coalesce(s.h, '') AS sibling
  FROM placed p
  JOIN (SELECT DISTINCT lang, level FROM tree WHERE n > 1) a ON a.lang IS NOT DISTINCT FROM p.lang
  LEFT JOIN tree s ON s.lang IS NOT DISTINCT FROM p.lang AND s.level = a.level AND s.pos = xor(p.pos >> a.level, 1)),
upper_steps AS (
  SELECT l.lang, a.level, (l.pos >> a.level) & 1 AS slot, coalesce(s.h, '') AS sibling
  FROM langs l
  JOIN (SELECT DISTINCT level FROM upper_tree WHERE n > 1) a ON true
  LEFT JOIN upper_tree s ON s.level = a.level AND s.pos = xor(l.pos >> a.level, 1)),
lower_paths AS (
  SELECT lang, pos, list({{'slot': slot, 'h': sibling}} ORDER BY level) AS steps FROM lower_steps GROUP BY lang, pos),
upper_paths AS (SELECT lang, list({{'slot': slot, 'h': sibling}} ORDER BY level) AS steps FROM upper_steps GROUP BY lang),
paths AS (
  SELECT p.doc_id, p.h AS leaf, l.h AS subroot, p.changed,
         list_concat(coalesce(x.steps, []), coalesce(y.steps, [])) AS steps
  FROM placed p JOIN langs l ON l.lang IS NOT DISTINCT FROM p.lang
  LEFT JOIN lower_paths x ON x.lang IS NOT DISTINCT FROM p.lang AND x.pos = p.pos
  LEFT JOIN upper_paths y ON y.lang IS NOT DISTINCT FROM p.lang),
folded AS (
  SELECT *, list_reduce(list_concat([{{'slot': 0::BIGINT, 'h': changed}}], steps), lambda a, s:
              {{'slot': 0::BIGINT, 'h': CASE WHEN s.slot = 1 THEN sha256(s.h || a.h) ELSE sha256(a.h || s.h) END}}).h AS folded_root
  FROM paths)
SELECT doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(steps, lambda s: s.h), '')) AS proof_sha256,
       folded_root, folded_root = root AS verified
FROM folded, root
"""

_WORDS = (
    "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
    r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
)

RESAMPLE = f"""
WITH {_CRC}
w AS (SELECT doc_id, {_WORDS} AS words FROM documents),
f AS (SELECT doc_id, unnest(words) AS word FROM w),
g AS (SELECT unnest({_WORDS}) AS word FROM benchmark),
named AS (
  SELECT word, {_crc("word")} % 10000 AS bucket
  FROM (SELECT word FROM f UNION SELECT word FROM g), crc_table),
s AS (SELECT bucket, count(*) AS s FROM f JOIN named USING (word) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS t FROM g JOIN named USING (word) GROUP BY bucket),
gains AS (
  SELECT bucket, floor(1000 * ln(((coalesce(t, 0) + 1)::DOUBLE * ((SELECT count(*) FROM f) + 10000))
                                 / ((coalesce(s, 0) + 1)::DOUBLE * ((SELECT count(*) FROM g) + 10000))))::BIGINT AS gain
  FROM range(10000) AS r(bucket) LEFT JOIN s USING (bucket) LEFT JOIN t USING (bucket)),
weights AS (
  SELECT doc_id, floor(sum(gain)::DOUBLE / count(*))::BIGINT AS weight
  FROM f JOIN named USING (word) JOIN gains USING (bucket) GROUP BY doc_id),
scored AS (
  SELECT doc_id, len(words)::BIGINT AS n_features, coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT + 0.5)::DOUBLE
                                                    / 4294967296)))::BIGINT AS score
  FROM w LEFT JOIN weights USING (doc_id)),
ranked AS (
  SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS n, count(*) OVER () AS fit
  FROM scored WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN n <= 10 * fit // 100 THEN n END AS rank
FROM scored LEFT JOIN ranked USING (doc_id)
"""
