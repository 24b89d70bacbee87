"""SQL that the results of this subpackage are checked against, where SQL can express them."""

from __future__ import annotations

_WORD = r"[^\x20\x09-\x0D]+"

NEAR_DUPLICATES = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORD}') AS w FROM documents),
sh AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, least(len(w), 1)) + 1)) AS i FROM d)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 85 * (nx.n + ny.n - c)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r(node, root) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.y, r.root FROM r JOIN e ON e.x = r.node WHERE r.root < e.y)
SELECT node AS doc_id, coalesce(max(n.n), 0) AS n_shingles, min(root) AS component_id, min(root) = node AS kept
FROM r LEFT JOIN n ON n.doc_id = r.node GROUP BY node
"""

QUALITY = rf"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text,
    regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w FROM documents),
g AS (SELECT rid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
rep AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS k FROM g) WHERE k > 1),
cov AS (SELECT rid, count(DISTINCT i + j) AS n FROM rep, (VALUES (0), (1), (2)) v(j) GROUP BY rid),
ln AS (SELECT rid, count(*) AS n_lines, count(*) - count(DISTINCT l) AS n_dup FROM (SELECT rid, unnest(string_split(text, chr(10))) AS l FROM d)
  WHERE regexp_matches(l, '{_WORD}') GROUP BY rid),
m AS (
  SELECT d.rid, doc_id, lang, source, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
    len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols, coalesce(n_dup, 0) AS n_dup_lines, coalesce(cov.n, 0) AS n_repeat_words,
    coalesce(n_lines, 0) AS n_lines FROM d LEFT JOIN cov ON cov.rid = d.rid LEFT JOIN ln ON ln.rid = d.rid),
x AS (
  SELECT rid, lang, source, n_words, unnest(['word_length', 'symbols', 'dup_lines', 'repeat_words']) AS metric, unnest([1.5, 0.1, 0.35, 0.3]::DOUBLE[]) AS slack,
    unnest([word_chars / greatest(n_words, 1), n_symbols / greatest(n_words, 1), n_dup_lines / greatest(n_lines, 1), n_repeat_words / greatest(n_words, 1)]) AS x FROM m),
b AS (
  SELECT lang, source, metric, slack, CASE WHEN x > 0 THEN CAST(ceil(ln(x) / ln(CAST(1.02 AS DOUBLE))) AS INTEGER) ELSE -100000 END AS bucket, count(*) AS n
  FROM x WHERE n_words > 0 GROUP BY ALL),
lv AS (
  SELECT depth, CASE WHEN depth > 0 THEN lang END AS lang, CASE WHEN depth > 1 THEN source END AS source, metric, slack, bucket, sum(n) AS n
  FROM b, (VALUES (0), (1), (2)) v(depth) GROUP BY ALL),
c AS (
  SELECT *, sum(n) OVER (PARTITION BY depth, lang, source, metric ORDER BY bucket) / sum(n) OVER (PARTITION BY depth, lang, source, metric) AS cum,
    CASE WHEN bucket > -100000 THEN pow(CAST(1.02 AS DOUBLE), bucket - 0.5) ELSE 0.0 END AS v FROM lv),
q AS (
  SELECT depth, lang, source, metric, slack, sum(n) AS rows, min(v) FILTER (cum >= 0.1) AS q10, min(v) FILTER (cum >= 0.9) AS q90 FROM c GROUP BY ALL),
f AS (SELECT depth, lang, source, metric, max(rows) OVER (PARTITION BY depth, lang, source) AS rows,
    q10 - (2.0 * (q90 - q10) + slack) AS low, q90 + (2.0 * (q90 - q10) + slack) AS high FROM q),
t AS (
  SELECT own.lang, own.source, own.metric, CASE WHEN own.rows >= 200 THEN own.low WHEN la.rows >= 200 THEN la.low ELSE al.low END AS low,
    CASE WHEN own.rows >= 200 THEN own.high WHEN la.rows >= 200 THEN la.high ELSE al.high END AS high
  FROM f own LEFT JOIN f la ON la.depth = 1 AND la.lang = own.lang AND la.metric = own.metric LEFT JOIN f al ON al.depth = 0 AND al.metric = own.metric
  WHERE own.depth = 2),
ok AS (SELECT rid, bool_and(x <= high AND x >= low) AS inside FROM x JOIN t ON t.lang = x.lang AND t.source = x.source AND t.metric = x.metric GROUP BY rid)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines,
  n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  coalesce(inside, false) AND NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS kept
FROM m LEFT JOIN ok ON ok.rid = m.rid
"""


def _rounds(rounds: int) -> str:
    """One set of tables for each template gathered in a leaf; what is left over stands for itself."""
    parts, rest = [], "ll"
    for k in range(rounds):
        parts.append(f"""
c{k} AS (SELECT leaf, line_id AS template_id, t AS ct FROM (SELECT *, row_number() OVER (PARTITION BY leaf ORDER BY n_docs DESC, line_id) AS i FROM {rest}) WHERE i = 1),
s{k} AS (SELECT r.*, template_id, list_sum(list_transform(list_zip(t, ct), lambda z: CASE WHEN z[1] = z[2] THEN 1 ELSE 0 END)) / len(t) >= 0.7 AS near FROM {rest} r JOIN c{k} ON c{k}.leaf = r.leaf),
r{k} AS (SELECT leaf, line_id, t, n_docs FROM s{k} WHERE NOT near),""")
        rest = f"r{k}"
    joined = " UNION ALL ".join(f"SELECT line_id, template_id FROM s{k} WHERE near" for k in range(rounds))
    return "".join(parts) + f"\ntp AS ({joined} UNION ALL SELECT line_id, line_id FROM {rest}),"


LINE_TEMPLATES = rf"""
WITH l0 AS (
  SELECT doc_id, i - 1 AS line_no, list_filter(string_split_regex(string_split(text, chr(10))[i], '[ \t\r\x0b\x0c]+'), lambda x: x <> '') AS w
  FROM (SELECT doc_id, text, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents WHERE text IS NOT NULL)),
l1 AS (SELECT doc_id, line_no, list_transform(w, lambda x: CASE WHEN regexp_matches(x, '[0-9]') THEN '<*>' ELSE x END) AS t FROM l0 WHERE len(w) >= 4),
l AS (SELECT *, md5(array_to_string(t, ' ')) AS line_id, len(t) || ' ' || array_to_string(t[1:3], ' ') AS leaf FROM l1),
ll AS (SELECT leaf, line_id, any_value(t) AS t, count(DISTINCT coalesce(doc_id, -1)) AS n_docs FROM l GROUP BY leaf, line_id),{_rounds(4)}
k AS (SELECT template_id, count(DISTINCT coalesce(doc_id, -1)) AS n_docs FROM l JOIN tp ON tp.line_id = l.line_id GROUP BY template_id)
SELECT doc_id, line_no, k.template_id, k.n_docs FROM l JOIN tp ON tp.line_id = l.line_id JOIN k ON k.template_id = tp.template_id WHERE k.n_docs >= 3
"""

#: The tree level by level; paths climb through their source's tree and then through the tree of the sources. DuckDB has no
#: crc32: its table is built from the polynomial.
MANIFEST = r"""
WITH RECURSIVE
steps AS (SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, [0, 0, 0, 0, 0, 0, 0, 0]),
  lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS crc),
docs AS (
  SELECT row_number() OVER () AS r, doc_id, source, lang, n_chars, text,
    list_reduce(list_prepend(4294967295, list_transform(range(1, length(doc_id::VARCHAR) + 1), lambda i: ord(substr(doc_id::VARCHAR, i, 1))::BIGINT)),
      lambda c, b: xor(c >> 8, crc[1 + (xor(c, b) & 255)])) AS state
  FROM documents, steps),
fields AS (
  SELECT r, doc_id, source,
    coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
      || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head,
    coalesce(strlen(text) || ':' || text, '-') AS whole,
    CASE WHEN xor(state, 4294967295) % 2 = 0 THEN coalesce(strlen(replace(text, chr(10), '')) || ':' || replace(text, chr(10), ''), '-')
      ELSE coalesce(strlen(text) || ':' || text, '-') END AS now
  FROM docs),
hashed AS (SELECT r, doc_id, source, sha256(head || whole) AS leaf, sha256(head || now) AS seen FROM fields),
leaves AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf, seen) - 1 AS i FROM hashed),
tree AS (
  SELECT 0 AS level, source, i, leaf AS h, count(*) OVER (PARTITION BY source) AS n FROM leaves
  UNION ALL
  SELECT * FROM (
    SELECT level + 1 AS level, source, i // 3 AS i, sha256(string_agg(h, '' ORDER BY i)) AS h, (any_value(n) + 2) // 3 AS n
    FROM tree WHERE n > 1 GROUP BY level, source, i // 3)),
tops AS (SELECT source, h AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS i FROM tree WHERE n = 1),
forest AS (
  SELECT 0 AS level, i, subroot AS h, count(*) OVER () AS n FROM tops
  UNION ALL
  SELECT * FROM (
    SELECT level + 1 AS level, i // 3 AS i, sha256(string_agg(h, '' ORDER BY i)) AS h, (any_value(n) + 2) // 3 AS n
    FROM forest WHERE n > 1 GROUP BY level, i // 3)),
sides AS (
  SELECT a.level, a.source, a.i, coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (WHERE b.i < a.i), '') AS l,
    coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (WHERE b.i > a.i), '') AS r
  FROM tree a JOIN tree b ON a.level = b.level AND a.source IS NOT DISTINCT FROM b.source AND a.i // 3 = b.i // 3
  WHERE a.n > 1 GROUP BY a.level, a.source, a.i),
forest_sides AS (
  SELECT a.level, a.i, coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (WHERE b.i < a.i), '') AS l,
    coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (WHERE b.i > a.i), '') AS r
  FROM forest a JOIN forest b ON a.level = b.level AND a.i // 3 = b.i // 3
  WHERE a.n > 1 GROUP BY a.level, a.i),
climb AS (
  SELECT r, source, 0 AS level, i, seen AS h, '' AS proof FROM leaves
  UNION ALL
  SELECT c.r, c.source, c.level + 1, c.i // 3, sha256(s.l || c.h || s.r), c.proof || s.l || s.r
  FROM climb c JOIN sides s ON s.level = c.level AND s.i = c.i AND s.source IS NOT DISTINCT FROM c.source),
at_top AS (SELECT r, arg_max(h, level) AS h, arg_max(proof, level) AS proof FROM climb GROUP BY r),
over AS (
  SELECT a.r, 0 AS level, t.i, a.h, a.proof FROM at_top a JOIN leaves v USING (r) JOIN tops t ON v.source IS NOT DISTINCT FROM t.source
  UNION ALL
  SELECT c.r, c.level + 1, c.i // 3, sha256(s.l || c.h || s.r), c.proof || s.l || s.r
  FROM over c JOIN forest_sides s ON s.level = c.level AND s.i = c.i),
done AS (SELECT r, arg_max(h, level) AS h, arg_max(proof, level) AS proof FROM over GROUP BY r)
SELECT v.doc_id, v.leaf, t.subroot, f.h AS root, sha256(d.proof) AS proof_sha256, d.h AS folded_root, d.h = f.h AS verified
FROM leaves v JOIN tops t ON v.source IS NOT DISTINCT FROM t.source JOIN done d USING (r), (SELECT h FROM forest WHERE n = 1) f
"""
