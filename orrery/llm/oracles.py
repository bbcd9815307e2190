"""SQL that says what queries of this subpackage return, for the operators that SQL can express."""

from __future__ import annotations

from . import quality

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SPACED = r"'[^\x20\x09-\x0D]+'"
_ALNUM = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"


def _low(column: str) -> str:
    return f"translate(coalesce({column}, ''), '{_UPPER}', '{_LOWER}')"


#: Sets of shingles, links by counts of common ones, components by reachability.
NEARDUP = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_low("text")}, {_SPACED}) AS ws FROM documents),
g AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 2], ' ') AS g FROM w, unnest(range(1, greatest(len(ws) - 2, 1) + 1)) t(i) WHERE len(ws) > 0),
n AS (SELECT doc_id, COUNT(*) AS n FROM g GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, COUNT(*) AS k FROM g x JOIN g y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n u ON u.doc_id = a JOIN n v ON v.doc_id = b WHERE 100 * k >= 85 * (u.n + v.n - k)),
r(doc_id, m) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.b, r.m FROM r JOIN e ON e.a = r.doc_id),
c AS (SELECT doc_id, MIN(m) AS component_id FROM r GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d JOIN c ON c.doc_id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id"""

_LENGTHS = ", ".join(f"({n})" for n in quality.LIMITS)
_WITHIN = " AND ".join(f"c{n} <= {limit} * greatest(word_chars, 1)" for n, limit in quality.LIMITS.items())
#: Words, windows of words that occur twice, and characters of the later ones and of repeated lines.
QUALITY = f"""
WITH w AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), {_SPACED}) AS ws FROM documents),
b AS (SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols FROM w),
l AS (SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id, line ORDER BY i) AS r FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS i FROM w) WHERE regexp_matches(line, {_SPACED})),
dl AS (SELECT doc_id, COUNT(*) AS k, SUM(list_sum(list_transform(regexp_extract_all(line, {_SPACED}), lambda x: length(x)))) AS c FROM l WHERE r > 1 GROUP BY doc_id),
g AS (SELECT doc_id, n, i, array_to_string(ws[i:i + n - 1], ' ') AS gram FROM w, (VALUES {_LENGTHS}) v(n), unnest(range(1, len(ws) - n + 2)) t(i)),
d AS (SELECT doc_id, n, i, COUNT(*) OVER (PARTITION BY doc_id, n, gram) AS k, row_number() OVER (PARTITION BY doc_id, n, gram ORDER BY i) AS r FROM g),
late AS (SELECT DISTINCT doc_id, n, i + j AS pos FROM d, range(0, 10) t(j) WHERE r > 1 AND j < n),
lc AS (SELECT late.doc_id, n, SUM(length(ws[pos])) AS c FROM late JOIN w ON w.doc_id = late.doc_id GROUP BY 1, 2),
rep AS (SELECT doc_id, COUNT(DISTINCT i + j) AS k FROM d, range(0, {quality.BASE_N}) t(j) WHERE n = {quality.BASE_N} AND k > 1 GROUP BY doc_id),
a AS (SELECT b.*, coalesce(dl.k, 0)::BIGINT AS n_dup_lines, coalesce(rep.k, 0)::BIGINT AS n_repeat_words, coalesce(dl.c, 0)::BIGINT AS n_line_chars, {", ".join(f"coalesce(c{n}, 0)::BIGINT AS c{n}" for n in quality.LIMITS)}
  FROM b LEFT JOIN dl USING (doc_id) LEFT JOIN rep USING (doc_id) LEFT JOIN (SELECT doc_id, {", ".join(f"SUM(c) FILTER (n = {n}) AS c{n}" for n in quality.LIMITS)} FROM lc GROUP BY doc_id) USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_line_chars, concat_ws(',', {", ".join(f"c{n}" for n in quality.LIMITS)}) AS n_gram_chars,
  n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND n_line_chars <= {quality.LINE_LIMIT} * greatest(word_chars, 1) AND {_WITHIN} AS kept
FROM a"""

#: All windows of items, and of documents in the lengths that items have.
DECONTAMINATION = f"""
WITH w AS (SELECT doc_id, regexp_extract_all({_low("text")}, {_ALNUM}) AS ws FROM documents),
i AS (SELECT item_id, ws, least(len(ws), 10) AS n FROM (SELECT item_id, regexp_extract_all({_low("text")}, {_ALNUM}) AS ws FROM benchmark) WHERE len(ws) > 0),
iw AS (SELECT DISTINCT item_id, n, array_to_string(ws[k:k + n - 1], ' ') AS g FROM i, unnest(range(1, len(ws) - n + 2)) t(k)),
dw AS (SELECT doc_id, n, k, array_to_string(ws[k:k + n - 1], ' ') AS g FROM w, (SELECT DISTINCT n FROM i) v, unnest(range(1, len(ws) - n + 2)) t(k)),
h AS (SELECT dw.doc_id, dw.n, dw.k, iw.item_id FROM dw JOIN iw ON iw.g = dw.g AND iw.n = dw.n),
p AS (SELECT doc_id, COUNT(DISTINCT k + j) AS n_hit FROM h, range(0, 10) t(j) WHERE j < n GROUP BY doc_id),
s AS (SELECT doc_id, COUNT(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM h WHERE item_id IS NOT NULL) GROUP BY doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN p USING (doc_id) LEFT JOIN s USING (doc_id)"""
