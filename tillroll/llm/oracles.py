"""DuckDB statements for the queries that SQL can express."""

from __future__ import annotations

from tillroll.llm import license_scan, mixing, secret_scan

WORDS = "coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)"


def _text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _matches(kind: str, pattern: str) -> str:
    """Matches with their places, from the lengths of the pieces between them."""
    p = _text(pattern)
    return f"""
  SELECT doc_id, m AS value, sum(length(p) + length(m)) OVER (
           PARTITION BY doc_id ORDER BY i) AS stop, {_text(kind)} AS kind
  FROM (SELECT doc_id, unnest(ms) AS m, unnest(ps[1:len(ms)]) AS p, unnest(range(len(ms))) AS i
        FROM (SELECT doc_id, regexp_extract_all(text, {p}) AS ms, string_split_regex(text, {p}) AS ps
              FROM docs) WHERE len(ms) > 0)"""


def secret_scan_sql() -> str:
    """Spans as the operator finds them; the entropy of every window is computed
    from scratch instead of by incremental counts."""
    base = " UNION ALL ".join(
        f"SELECT *, {rank} AS rank FROM ({_matches(kind, pattern)}) WHERE length("
        + (f"regexp_extract(value, {_text(pattern)}, {group})" if group else "value") + f") >= {least}"
        for rank, (kind, pattern, group, least) in enumerate(secret_scan.BASE))
    allowed = " OR ".join(f"regexp_matches(value, {_text(p)})" for p in secret_scan.ALLOWED)
    limits = {k: secret_scan.most_gain(v) for k, v in secret_scan.THRESHOLDS.items()}
    w = secret_scan.WINDOW
    return f"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
base AS ({base}),
candidates AS (
  SELECT *, row_number() OVER () AS c FROM ({_matches("entropy", secret_scan.CANDIDATE)}) k
  WHERE NOT ({allowed}) AND NOT EXISTS (
    SELECT 1 FROM base b WHERE b.doc_id = k.doc_id AND b.stop >= k.stop
      AND b.stop - length(b.value) <= k.stop - length(k.value))),
parts AS (SELECT c, k, ps[k] AS part FROM (
            SELECT c, string_split_regex(value, {_text(secret_scan.FILLER)}) AS ps FROM candidates), unnest(range(1, len(ps) + 1)) AS u(k)),
windows AS (SELECT c, k, pos, substr(part, pos, {w}) AS win FROM parts,
            unnest(range(1, length(part) - {w - 2})) AS u(pos)),
chars AS (SELECT c, k, pos, substr(win, i, 1) AS ch, count(*) AS n FROM windows,
          unnest(range(1, {w + 1})) AS u(i) GROUP BY ALL),
sums AS (SELECT c, k, pos, sum(CAST(round(n * log2(n) * {secret_scan.SCALE}) AS BIGINT)) AS s FROM chars GROUP BY ALL),
best AS (SELECT c, min(s) AS s FROM sums GROUP BY c),
entropy AS (
  SELECT k.* EXCLUDE (c), {len(secret_scan.BASE)} AS rank FROM candidates k JOIN best USING (c)
  WHERE s <= CASE WHEN regexp_matches(value, '^[0-9]+$') THEN {limits["digits"]}
                  WHEN regexp_matches(value, '^([0-9a-f]+|[0-9A-F]+)$') THEN {limits["hex"]}
                  WHEN regexp_matches(value, '^[A-Za-z]+$')
                    AND len(regexp_extract_all(value, '[a-z][A-Z]')) + len(regexp_extract_all(value, '[A-Z][a-z]'))
                        >= {secret_scan.CHANGES} * (length(value) - 1) THEN {limits["cased"]}
                  WHEN NOT regexp_matches(value, '[0-9]') THEN {limits["letters"]}
                  ELSE {limits["mixed"]} END),
spans AS (SELECT doc_id, kind, rank, stop - length(value) AS start, stop FROM (
            SELECT * FROM base UNION ALL SELECT * FROM entropy)),
lists AS (
  SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
         count(*) FILTER (kind = 'hex') AS n_hex,
         string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank, stop)
           FILTER (kind <> 'entropy') AS base,
         string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank, stop) AS spans
  FROM spans GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access,
       coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM docs LEFT JOIN lists USING (doc_id)"""


def source_mix_sql(seed: int = 11) -> str:
    """The level of target per weight solves sum(min(cap, w * level)) = share: it is
    the greatest of the levels that the sources with the least cap / w leave."""
    weights = " ".join(f"WHEN {i} THEN {w}" for i, w in enumerate(mixing.WEIGHTS))
    return f"""
WITH docs AS (SELECT doc_id, source, CAST({WORDS} AS BIGINT) AS size FROM documents),
sizes AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM docs GROUP BY source),
turns AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(mixing.WEIGHTS)} {weights} END AS w,
          2.0::DOUBLE * source_size AS cap FROM sizes),
levels AS (
  SELECT max((1.5::DOUBLE * total - held) / free) AS level FROM (
    SELECT sum(source_size) OVER () AS total,
           coalesce(sum(cap) OVER (ORDER BY cap / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS held,
           sum(w) OVER (ORDER BY cap / w, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS free
    FROM turns)),
targets AS (SELECT source, source_size, least(cap, w * level) AS target FROM turns, levels),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY size DESC, md5('{seed}:' || doc_id), doc_id) - 1 AS place
  FROM docs),
steps AS (
  SELECT doc_id, size, source_size, target, place,
         CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS each,
         CAST(CAST('0x' || substr(md5('{seed}:' || coalesce(r.source, '')), 1, 8) AS BIGINT) AS DOUBLE) / 4294967296.0::DOUBLE AS shift
  FROM ranked r JOIN targets t ON r.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       size * CAST(floor((place + 1) * each + shift) - floor(place * each + shift) AS BIGINT) AS taken
FROM steps"""


def license_scan_sql(header: float = 0.8, whole: float = 0.6) -> str:
    """All lines and whole texts against all templates, without the cue terms."""
    terms = license_scan.template_terms(license_scan.TEMPLATES)
    values = ", ".join(f"({_text(k)}, {i}, {_text(w)}, {c})" for i, (k, v) in enumerate(terms.items())
                       for w, c in v.items())
    return f"""
WITH docs AS (SELECT doc_id, concat_ws('/', source, lang, doc_id) AS path, lower(coalesce(text, '')) AS t FROM documents),
template(name, rank, term, c) AS (VALUES {values}),
n AS (SELECT count(*) AS n FROM docs),
df AS (SELECT term, count(DISTINCT doc_id) AS df FROM (
         SELECT doc_id, unnest(regexp_extract_all(t, '[a-z0-9]+')) AS term FROM docs)
       WHERE term IN (SELECT term FROM template) GROUP BY term),
idf AS (SELECT term, ln((1 + n) / (1 + coalesce(df, 0))) + 1 AS idf
        FROM (SELECT DISTINCT term FROM template) LEFT JOIN df USING (term), n),
unseen AS (SELECT ln(1 + n) + 1 AS idf FROM n),
vec AS (SELECT name, rank, term, c * idf AS x FROM template JOIN idf USING (term)),
norm AS (SELECT name, sqrt(sum(x * x)) AS norm FROM vec GROUP BY name),
units AS (SELECT doc_id, 0 AS unit, t AS u FROM docs UNION ALL
          SELECT doc_id, i, u FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS u,
                 unnest(range(1, len(string_split(t, chr(10))) + 1)) AS i FROM docs)),
counts AS (SELECT doc_id, unit, term, count(*) AS c FROM (
             SELECT doc_id, unit, unnest(regexp_extract_all(u, '[a-z0-9]+')) AS term FROM units) GROUP BY ALL),
weighed AS (SELECT doc_id, unit, term, c * coalesce(i.idf, s.idf) AS x
            FROM counts LEFT JOIN idf i USING (term), unseen s),
lengths AS (SELECT doc_id, unit, sqrt(sum(x * x)) AS len FROM weighed GROUP BY ALL),
cosines AS (SELECT doc_id, unit, name, rank, round(dot / (len * norm), 6) AS score FROM (
              SELECT w.doc_id, w.unit, v.name, v.rank, sum(w.x * v.x) AS dot FROM weighed w JOIN vec v USING (term)
              GROUP BY ALL) JOIN lengths USING (doc_id, unit) JOIN norm USING (name)),
headers AS (SELECT doc_id, name, score FROM cosines WHERE unit > 0 AND score >= {header}
            QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, rank) = 1),
wholes AS (SELECT doc_id, name, score, rank FROM cosines WHERE unit = 0 AND score >= {whole}
           QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, rank) = 1),
files AS (SELECT doc_id, path, CASE WHEN contains(path, '/') THEN regexp_replace(path, '/[^/]*$', '') ELSE '' END AS dir FROM docs),
covered AS (SELECT dir, w.name FROM files JOIN wholes w USING (doc_id)
            QUALIFY row_number() OVER (PARTITION BY dir ORDER BY score DESC, rank) = 1),
near AS (SELECT f.dir, c.dir AS up, c.name FROM (SELECT DISTINCT dir FROM files) f
         JOIN covered c ON f.dir = c.dir OR c.dir = '' OR starts_with(f.dir, c.dir || '/')
         QUALIFY row_number() OVER (PARTITION BY f.dir ORDER BY length(c.dir) DESC) = 1)
SELECT f.doc_id, f.path, h.name AS header, h.score AS header_score, w.name AS covers,
       near.name AS inherited, near.up AS inherited_from, coalesce(h.name, near.name) AS licence
FROM files f LEFT JOIN headers h USING (doc_id) LEFT JOIN wholes w USING (doc_id) LEFT JOIN near USING (dir)"""


def substring_dedup_sql(window: int = 50) -> str:
    """Every window of every text, instead of anchors."""
    return f"""
WITH docs AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'), []) AS ws FROM documents),
windows AS (SELECT doc_id, i, md5(array_to_string(ws[i:i + {window - 1}], ' ')) AS h
            FROM docs, unnest(range(1, len(ws) - {window - 2})) AS u(i)),
least AS (SELECT h, min(doc_id) AS first_id FROM windows GROUP BY h),
covered AS (SELECT DISTINCT doc_id, i + k AS place FROM windows JOIN least USING (h), range({window}) r(k)
            WHERE doc_id > first_id),
words AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS place FROM docs),
kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY place) AS t
         FROM words ANTI JOIN covered USING (doc_id, place) GROUP BY doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(t, '')) AS kept_sha256
FROM docs LEFT JOIN kept USING (doc_id)"""


def exact_dedup_sql() -> str:
    return """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))"""


def hard_negatives_sql() -> str:
    """Scores by list products; every anchor against every row."""
    return """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.vec_id AS anchor_id, c.vec_id AS other_id, a.label = c.label AS same,
         CAST(list_inner_product(a.q, c.q) AS BIGINT) AS score
  FROM v a, v c WHERE a.vec_id % 50 = 0 AND a.vec_id <> c.vec_id),
positives AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
SELECT anchor_id, positive_id,
       CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id) AS INTEGER) AS rank,
       other_id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scored USING (anchor_id)
WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY rank <= 3"""
