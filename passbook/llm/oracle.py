"""The same results as DuckDB SQL, where SQL can express them."""

from __future__ import annotations

MIX = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5('mix/' || coalesce(doc_id::VARCHAR, 'null')) AS sort_key
  FROM documents),
sources AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
ranked AS (
  SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS i FROM sources),
weighed AS (
  SELECT *, CASE i % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight,
         2.0::DOUBLE * source_size AS ceiling FROM ranked),
levels AS (
  SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE
             - coalesce(sum(ceiling) OVER (ORDER BY ceiling / weight, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
            / sum(weight) OVER (ORDER BY ceiling / weight, i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weighed),
held AS (
  SELECT *, max(CASE WHEN level * weight <= ceiling THEN level END) OVER () AS held FROM levels),
aimed AS (
  SELECT source, source_size, least(coalesce(held * weight, ceiling), ceiling) AS target FROM held),
placed AS (
  SELECT s.doc_id, s.size, a.source_size, a.target,
         coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.sort_key, s.doc_id, s.size
                                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
  FROM sized s JOIN aimed a ON s.source IS NOT DISTINCT FROM a.source)
SELECT doc_id, size, source_size, target,
       (CASE WHEN source_size > 0 THEN floor(target)::BIGINT // source_size * size
             + greatest(0, least(floor(target)::BIGINT % source_size - start, size)) ELSE 0 END)::BIGINT AS taken
FROM placed
"""


#: CRC-32 of ASCII texts and UTF-8 bytes, by its rule.
_CHECKSUM = r"""
checksum_table AS (
  SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, k: xor(c >> 1, (c & 1) * 3988292384)) ORDER BY i) AS t
  FROM range(256) AS r(i)),
"""


def _checksum(text: str) -> str:
    """CRC-32 of the UTF-8 bytes of ``text`` as SQL, next to ``checksum_table``."""
    code = f"list_transform(range(octet_length(encode({text}))), lambda i: ('0x' || substr(hex(encode({text})), 2 * i + 1, 2))::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {code}), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295)"


RESAMPLE = rf"""
WITH {_CHECKSUM}
cut AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                           '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word
  FROM documents),
aim AS (
  SELECT unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                   '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word
  FROM benchmark),
known AS (SELECT DISTINCT word FROM (SELECT word FROM cut UNION ALL SELECT word FROM aim)),
bucketed AS (SELECT word, {_checksum("word")} % 10000 AS bucket FROM known, checksum_table),
have AS (SELECT bucket, count(*) AS n FROM cut JOIN bucketed USING (word) GROUP BY bucket),
want AS (SELECT bucket, count(*) AS n FROM aim JOIN bucketed USING (word) GROUP BY bucket),
totals AS (SELECT (SELECT coalesce(sum(n), 0) FROM have)::DOUBLE AS s, (SELECT coalesce(sum(n), 0) FROM want)::DOUBLE AS t),
gains AS (
  SELECT have.bucket, floor(1000 * ln((coalesce(want.n, 0) + 1)::DOUBLE * (s + 10000)
                                      / ((have.n + 1)::DOUBLE * (t + 10000))))::BIGINT AS gain
  FROM have LEFT JOIN want USING (bucket), totals),
sums AS (
  SELECT doc_id, count(*) AS n, sum(gain)::BIGINT AS total
  FROM cut JOIN bucketed USING (word) JOIN gains USING (bucket) GROUP BY doc_id),
weighed AS (
  SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_features,
         CASE WHEN n IS NULL THEN 0 ELSE (total - ((total % n) + n) % n) // n END::BIGINT AS weight,
         ('0x' || substr(sha256('2024:' || d.doc_id), 1, 8))::BIGINT AS h
  FROM documents d LEFT JOIN sums USING (doc_id)),
scored AS (
  SELECT doc_id, n_features, weight,
         weight + floor(-1000.0::DOUBLE * ln(-ln((h + 0.5::DOUBLE) / 4294967296.0::DOUBLE)))::BIGINT AS score
  FROM weighed),
entered AS (
  SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r, count(*) OVER () * 10 // 100 AS k
  FROM scored WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, (CASE WHEN r <= k THEN r END)::BIGINT AS rank
FROM scored LEFT JOIN entered USING (doc_id)
"""


def _field(name: str) -> str:
    return f"coalesce(octet_length(encode({name}::VARCHAR)) || ':' || {name}::VARCHAR, '-')"


MERKLE = rf"""
WITH RECURSIVE {_CHECKSUM}
leaves AS (
  SELECT doc_id, lang, sha256({" || ".join(map(_field, ("doc_id", "source", "lang", "n_chars", "text")))}) AS leaf,
         CASE WHEN {_checksum("doc_id::VARCHAR")} % 3 = 0 THEN sha256({" || ".join(map(_field, ("doc_id", "source", "lang", "n_chars")))}
              || coalesce(octet_length(encode(text)) || ':'
                          || translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '-')) END AS found
  FROM documents, checksum_table),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n
  FROM leaves),
lower_nodes AS (
  SELECT lang, 0 AS level, i, n, leaf AS hash FROM placed
  UNION ALL
  SELECT lang, level + 1, i // 8, (n + 7) // 8, sha256(string_agg(hash, '' ORDER BY i))
  FROM lower_nodes WHERE n > 1 GROUP BY lang, level, i // 8, n),
subroots AS (SELECT lang, hash AS subroot FROM lower_nodes WHERE n = 1),
ranked AS (
  SELECT lang, subroot, row_number() OVER (ORDER BY lang IS NOT NULL, encode(lang)) - 1 AS i, count(*) OVER () AS n FROM subroots),
upper_nodes AS (
  SELECT 0 AS level, i, n, subroot AS hash FROM ranked
  UNION ALL
  SELECT level + 1, i // 8, (n + 7) // 8, sha256(string_agg(hash, '' ORDER BY i))
  FROM upper_nodes WHERE n > 1 GROUP BY level, i // 8, n),
roots AS (SELECT hash AS root FROM upper_nodes WHERE n = 1),
lower_steps AS (
  SELECT lang, level, i,
         coalesce(string_agg(hash, '') OVER (run ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS "left",
         coalesce(string_agg(hash, '') OVER (run ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS "right"
  FROM lower_nodes WHERE n > 1 WINDOW run AS (PARTITION BY lang, level, i // 8 ORDER BY i)),
upper_steps AS (
  SELECT level, i,
         coalesce(string_agg(hash, '') OVER (run ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS "left",
         coalesce(string_agg(hash, '') OVER (run ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS "right"
  FROM upper_nodes WHERE n > 1 WINDOW run AS (PARTITION BY level, i // 8 ORDER BY i)),
climbed AS (
  SELECT lang, i AS place, 0 AS level, i, coalesce(found, leaf) AS now, '' AS siblings FROM placed
  UNION ALL
  SELECT c.lang, c.place, c.level + 1, c.i // 8, sha256(s."left" || c.now || s."right"), c.siblings || s."left" || s."right"
  FROM climbed c JOIN lower_steps s ON s.lang IS NOT DISTINCT FROM c.lang AND s.level = c.level AND s.i = c.i),
out_of_group AS (
  SELECT c.lang, c.place, c.now, c.siblings, r.i FROM climbed c
  JOIN ranked r ON r.lang IS NOT DISTINCT FROM c.lang
  JOIN (SELECT lang, max(level) AS top FROM lower_nodes GROUP BY lang) h
    ON h.lang IS NOT DISTINCT FROM c.lang AND h.top = c.level),
folded AS (
  SELECT lang, place, 0 AS level, i, now, siblings FROM out_of_group
  UNION ALL
  SELECT f.lang, f.place, f.level + 1, f.i // 8, sha256(s."left" || f.now || s."right"), f.siblings || s."left" || s."right"
  FROM folded f JOIN upper_steps s ON s.level = f.level AND s.i = f.i),
last AS (SELECT * FROM folded WHERE level = (SELECT max(level) FROM upper_nodes))
SELECT p.doc_id, p.leaf, s.subroot, root, sha256(l.siblings) AS proof_sha256, l.now AS folded_root, l.now = root AS verified
FROM placed p
JOIN last l ON l.lang IS NOT DISTINCT FROM p.lang AND l.place = p.i
JOIN subroots s ON s.lang IS NOT DISTINCT FROM p.lang, roots
"""

ORACLE: dict[str, str] = {
    "op2_mix_sources": MIX,
    "op11_importance_resampling": RESAMPLE,
    "op13_merkle_manifest": MERKLE,
}
