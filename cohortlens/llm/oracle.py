"""DuckDB SQL for the text operators that SQL can express."""

from __future__ import annotations

from cohortlens.llm.licences import ALL_RIGHTS, COPYRIGHT_LINE, EQUIVALENT, known_texts

OP6 = r"""
WITH doc AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), item AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), short AS (
  SELECT item_id, w, least(len(w), 10) AS n FROM item WHERE len(w) > 0
), item_window AS (
  SELECT DISTINCT item_id, n, array_to_string(w[i : i + n - 1], ' ') AS g
  FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM short)
), lengths AS (SELECT DISTINCT n FROM item_window),
doc_window AS (
  SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS g
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM doc, lengths WHERE len(w) >= n)
), hit AS (
  SELECT DISTINCT d.doc_id, d.i, d.n, m.item_id FROM doc_window d JOIN item_window m ON d.n = m.n AND d.g = m.g
), hit_words AS (
  SELECT doc_id, count(*) AS n_hit
  FROM (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS k FROM hit) GROUP BY doc_id
), hit_items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items
  FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(h.n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(m.n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(m.items, '')) AS items_sha256,
  coalesce(h.n_hit, 0) > 0 AS contaminated
FROM doc d LEFT JOIN hit_words h ON d.doc_id = h.doc_id LEFT JOIN hit_items m ON d.doc_id = m.doc_id
"""

#: Lines that share a third at a nearby place are compared; two edits leave one third of the shorter line as it is.
OP3 = r"""
WITH line AS (
  SELECT doc_id, i - 1 AS pos, l[i] AS line
  FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i
        FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))
), part AS (SELECT * FROM line WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
ranked AS (SELECT *, row_number() OVER (ORDER BY doc_id, pos) AS r FROM part),
firsts AS (SELECT line, min(r) AS r, length(line) AS n FROM ranked GROUP BY line),
uniq AS (SELECT * FROM firsts WHERE n >= 20),
third AS (
  SELECT r, n, line, k, n // 3 AS base, n % 3 AS longer FROM uniq, (SELECT unnest(range(3)) AS k)
), seg AS (
  SELECT r, n, line, k, base * k + greatest(0, k - (3 - longer)) + 1 AS begin_at,
    base + CASE WHEN k >= 3 - longer THEN 1 ELSE 0 END AS size FROM third
), idx AS (SELECT r, n, line, k, begin_at, substring(line, begin_at, size) AS s FROM seg),
shape AS (SELECT DISTINCT n, k, begin_at, size FROM seg),
look AS (
  SELECT u.r, u.line, h.n, h.k, substring(u.line, h.begin_at + d, h.size) AS s
  FROM uniq u, (SELECT unnest(range(3)) AS less), (SELECT unnest(range(-2, 3)) AS d), shape h
  WHERE h.n = u.n - less AND h.begin_at + d >= 1 AND h.begin_at + d + h.size - 1 <= u.n
), near AS (
  SELECT DISTINCT i.r AS a, l.r AS b, i.line AS x, l.line AS y
  FROM look l JOIN idx i ON l.n = i.n AND l.k = i.k AND l.s = i.s AND l.r <> i.r
), gone AS (SELECT DISTINCT greatest(a, b) AS r FROM near WHERE levenshtein(x, y) <= 2),
stay AS (SELECT r FROM firsts WHERE r NOT IN (SELECT r FROM gone)),
kept AS (
  SELECT l.doc_id, l.pos, l.line, (k.r IS NULL OR s.r IS NOT NULL) AS keep
  FROM line l LEFT JOIN ranked k ON k.doc_id = l.doc_id AND k.pos = l.pos LEFT JOIN stay s ON s.r = k.r
), out AS (
  SELECT doc_id, count(*) AS n, sum(CASE WHEN keep THEN 0 ELSE 1 END) AS gone,
    string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE keep) AS text FROM kept GROUP BY doc_id
)
SELECT d.doc_id, CASE WHEN coalesce(d.text, '') = '' THEN 0 ELSE CAST(o.n AS BIGINT) END AS n_lines,
  CAST(coalesce(o.gone, 0) AS BIGINT) AS n_removed, sha256(coalesce(o.text, '')) AS kept_sha256
FROM documents d LEFT JOIN out o ON d.doc_id = o.doc_id
"""

OP4 = r"""
WITH doc AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), win AS (
  SELECT doc_id, i, array_to_string(w[i : i + 19], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM doc WHERE len(w) >= 20)
), later AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) AS r FROM win)
  WHERE r > 1
), gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS k FROM later),
word AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS k FROM doc),
kept AS (
  SELECT w.doc_id, count(g.k) AS n_removed, string_agg(w.x, ' ' ORDER BY w.k) FILTER (WHERE g.k IS NULL) AS text
  FROM word w LEFT JOIN gone g ON w.doc_id = g.doc_id AND w.k = g.k GROUP BY w.doc_id
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(k.n_removed, 0) AS BIGINT) AS n_removed,
  sha256(coalesce(k.text, '')) AS kept_sha256
FROM doc d LEFT JOIN kept k ON d.doc_id = k.doc_id
"""

#: Bytes are pairs of hexadecimal digits.
OP9 = r"""
WITH doc AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
sized AS (SELECT doc_id, h, len(h) // 2 AS n FROM doc),
win AS (
  SELECT doc_id, i, md5(substring(h, 2 * i - 1, 400)) AS g
  FROM (SELECT doc_id, h, unnest(range(1, n - 198)) AS i FROM sized WHERE n >= 200)
), twice AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY g) AS c FROM win) WHERE c > 1
), edge AS (
  SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM twice
), run AS (
  SELECT doc_id, i, sum(CASE WHEN before IS NULL OR i > before + 200 THEN 1 ELSE 0 END)
    OVER (PARTITION BY doc_id ORDER BY i) AS r FROM edge
), span AS (SELECT doc_id, r, min(i) AS a, max(i) + 199 AS b FROM run GROUP BY doc_id, r),
piece AS (
  SELECT s.doc_id, s.r, s.a, s.b,
    substring(d.h, 2 * coalesce(lag(s.b) OVER (PARTITION BY s.doc_id ORDER BY s.r), 0) + 1,
      2 * (s.a - 1 - coalesce(lag(s.b) OVER (PARTITION BY s.doc_id ORDER BY s.r), 0))) AS x
  FROM span s JOIN sized d ON s.doc_id = d.doc_id
), all_spans AS (
  SELECT doc_id, count(*) AS n_spans, sum(b - a + 1) AS n_removed, max(b) AS last, string_agg(x, '' ORDER BY r) AS x
  FROM piece GROUP BY doc_id
)
SELECT d.doc_id, CAST(d.n AS BIGINT) AS n_bytes, CAST(coalesce(a.n_removed, 0) AS BIGINT) AS n_removed,
  CAST(coalesce(a.n_spans, 0) AS BIGINT) AS n_spans,
  sha256(unhex(CASE WHEN a.doc_id IS NULL THEN d.h ELSE a.x || substring(d.h, 2 * a.last + 1) END)) AS kept_sha256
FROM sized d LEFT JOIN all_spans a ON d.doc_id = a.doc_id
"""

OP10 = r"""
WITH RECURSIVE doc AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), shingle AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM doc WHERE len(w) > 0)
), size AS (SELECT doc_id, count(*) AS n FROM shingle GROUP BY doc_id),
pair AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM shingle a JOIN shingle b ON a.s = b.s AND a.doc_id <> b.doc_id
  GROUP BY ALL
), link AS (
  SELECT x, y FROM pair JOIN size p ON p.doc_id = x JOIN size q ON q.doc_id = y WHERE 100 * c >= 80 * (p.n + q.n - c)
), reach(doc_id, other) AS (
  SELECT doc_id, doc_id FROM doc UNION SELECT r.doc_id, l.y FROM reach r JOIN link l ON r.other = l.x
)
SELECT d.doc_id, CAST(coalesce(s.n, 0) AS BIGINT) AS n_shingles, min(r.other) AS component_id
FROM doc d JOIN reach r ON d.doc_id = r.doc_id LEFT JOIN size s ON s.doc_id = d.doc_id GROUP BY d.doc_id, s.n
"""


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _canonical_lines(text: str) -> str:
    out = f"translate(coalesce({text}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    for pattern, by in ((COPYRIGHT_LINE, "chr(10)"), (ALL_RIGHTS, "chr(10)"), (r"[^\p{L}\p{N}\n]+", "' '")):
        out = f"regexp_replace({out}, {_text(pattern)}, {by}, 'g')"
    return out


def _digest(canonical: str) -> str:
    for other, one in EQUIVALENT:
        canonical = f"regexp_replace({canonical}, {_text(rf'(^|[ \n]){other}($|[ \n])')}, {_text(rf'\1{one}\2')}, 'g')"
    return f"sha256(trim(regexp_replace({canonical}, '[ \\n]+', ' ', 'g')))"


OP8 = f"""
WITH given AS (
  SELECT * FROM (VALUES {", ".join(f"({_text(u)}, {_text(i)}, {_text(t)})" for u, i, t in known_texts())}) AS v(unit, licence, text)
), known AS (
  SELECT unit, min(licence) AS licence, digest
  FROM (SELECT unit, licence, {_digest("c")} AS digest FROM (SELECT *, {_canonical_lines("text")} AS c FROM given))
  GROUP BY unit, digest
), doc AS (SELECT doc_id, {_canonical_lines("text")} AS c FROM documents),
whole AS (SELECT doc_id, {_digest("c")} AS digest FROM doc),
line AS (
  SELECT DISTINCT doc_id, licence
  FROM (SELECT doc_id, {_digest("l")} AS digest FROM (SELECT doc_id, unnest(string_split(c, chr(10))) AS l FROM doc)
        WHERE length(l) < 400) JOIN (SELECT * FROM known WHERE unit = 'line') USING (digest)
), notice AS (SELECT doc_id, count(*) AS n, string_agg(licence, ',' ORDER BY licence) AS notices FROM line GROUP BY doc_id)
SELECT w.doc_id, w.digest, k.licence, CAST(coalesce(n.n, 0) AS BIGINT) AS n_notices, coalesce(n.notices, '') AS notices
FROM whole w LEFT JOIN (SELECT * FROM known WHERE unit = 'text') k ON w.digest = k.digest
LEFT JOIN notice n ON n.doc_id = w.doc_id
"""

OP11 = """
WITH v AS (
  SELECT vec_id, CAST(CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS BIGINT) AS label,
    list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS x
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.vec_id AS anchor_id, c.vec_id AS id, a.label = c.label AS alike,
    CAST(list_inner_product(a.x, c.x) AS BIGINT) AS score
  FROM v a JOIN v c ON a.vec_id <> c.vec_id WHERE a.vec_id % 50 = 0
), positive AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM scored WHERE alike
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
)
SELECT p.anchor_id, p.positive_id,
  CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY n.score DESC, n.id) AS INTEGER) AS rank,
  n.id AS negative_id, p.positive_score, n.score AS negative_score
FROM positive p JOIN scored n ON p.anchor_id = n.anchor_id AND NOT n.alike
  AND 50 * p.positive_score <= 100 * n.score AND 100 * n.score <= 95 * p.positive_score
QUALIFY rank <= 3
"""


def _floor_mean(total: str, n: str) -> str:
    return f"({total} - ((({total}) % {n}) + {n}) % {n}) // {n}"


def _codebook_round(r: int) -> str:
    """Assignment under the codebooks ``b{r}``, and the next ones."""
    return f"""
, a{r} AS (
  SELECT p.vec_id, p.part, p.x, b.entry, list_sum(list_transform(list_zip(p.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d
  FROM part p JOIN b{r} b ON p.part = b.part
  QUALIFY row_number() OVER (PARTITION BY p.vec_id, p.part ORDER BY d, b.entry) = 1
), m{r} AS (
  SELECT part, entry, i, sum(x[i]) AS s, count(*) AS n
  FROM (SELECT part, entry, x, unnest(range(1, len(x) + 1)) AS i FROM a{r}) GROUP BY part, entry, i
), b{r + 1} AS (
  SELECT b.part, b.entry, coalesce(m.x, b.x) AS x
  FROM b{r} b LEFT JOIN (SELECT part, entry, list(CAST({_floor_mean("s", "n")} AS BIGINT) ORDER BY i) AS x FROM m{r} GROUP BY part, entry) m
    ON b.part = m.part AND b.entry = m.entry
)"""


OP12 = f"""
WITH v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS x
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), part AS (
  SELECT vec_id, part, x[part * (len(x) // 16) + 1 : (part + 1) * (len(x) // 16)] AS x
  FROM (SELECT vec_id, x, unnest(range(16)) AS part FROM v)
), first AS (
  SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM v QUALIFY entry < 64
), b0 AS (SELECT part, entry, x FROM part JOIN first USING (vec_id))
{_codebook_round(0)}{_codebook_round(1)}{_codebook_round(2)}
, coded AS (
  SELECT vec_id, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error
  FROM a2 GROUP BY vec_id
), total AS (SELECT label, CAST(sum(error) AS BIGINT) AS label_error FROM v JOIN coded USING (vec_id) GROUP BY label),
digest AS (
  SELECT sha256(string_agg(CAST(x[i] AS VARCHAR), ',' ORDER BY part, entry, i)) AS codebooks_sha256
  FROM (SELECT part, entry, x, unnest(range(1, len(x) + 1)) AS i FROM b2)
)
SELECT v.vec_id, c.code, c.error, t.label_error, d.codebooks_sha256
FROM v JOIN coded c USING (vec_id) JOIN total t ON v.label IS NOT DISTINCT FROM t.label, digest d
"""

ORACLE = {
    "op3_line_dedup": OP3,
    "op4_substring_dedup": OP4,
    "op6_decontaminate": OP6,
    "op8_licences": OP8,
    "op9_suffix_dedup": OP9,
    "op10_jaccard": OP10,
    "op11_hard_negatives": OP11,
    "op12_vector_codes": OP12,
}
