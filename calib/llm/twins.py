"""SQL twins of the queries that SQL can express."""

from __future__ import annotations

from calib.llm import curriculum, secrets

WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

BALL_TREE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, r.vec_id, list_dot_product(q.v, r.v)::BIGINT AS score
  FROM v q JOIN v r ON q.vec_id <> r.vec_id AND len(q.v) = len(r.v) WHERE q.vec_id % 20 = 0)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
WHERE rank <= 20"""

JACCARD = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') AS w
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS s
  FROM w, range(1, 1000000) t(i) WHERE i <= greatest(len(w) - 3, 1) AND len(w) > 0),
n AS (SELECT w.doc_id, count(s) AS n FROM w LEFT JOIN s USING (doc_id) GROUP BY ALL),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id
  JOIN n x ON x.doc_id = a.doc_id JOIN n y ON y.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 85 * (x.n + y.n - count(*))),
reach AS (SELECT doc_id AS a, doc_id AS b FROM n
          UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b)
SELECT doc_id, n AS n_shingles, min(b) AS component_id FROM n JOIN reach ON a = doc_id GROUP BY ALL"""


def _spans(place: int, rule: secrets.Rule) -> str:
    pattern = rule.pattern.replace("'", "''")
    return f"""
  SELECT doc_id, {place} AS kind, '{rule.kind}' AS name, stop - size AS start, stop FROM (
    SELECT doc_id, k, length(part) AS size, length(regexp_extract(part, '{pattern}', {rule.group})) AS asked,
           sum(length(part)) OVER (PARTITION BY doc_id ORDER BY k ROWS UNBOUNDED PRECEDING)::BIGINT AS stop
    FROM (SELECT doc_id, unnest(parts) AS part, unnest(range(len(parts))) AS k FROM (
      SELECT doc_id, string_split(regexp_replace(t, '({pattern})', chr(1) || '\\1' || chr(1), 'g'), chr(1)) AS parts
      FROM d)))
  WHERE k % 2 = 1 AND asked >= {rule.least}"""


def secrets_sql() -> str:
    """Matches are cut out between marks; a text's own marks give way to a like character."""
    rules = (*secrets.BASE, *secrets.MORE)
    parts = " UNION ALL ".join(_spans(k, r) for k, r in enumerate(rules))
    counts = ", ".join(f"count(*) FILTER (kind = {k}) AS n_{r.kind}" for k, r in enumerate(secrets.BASE))
    joined = "string_agg(name || ':' || start || ':' || stop, ',' ORDER BY start, kind)"
    return f"""
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), chr(1), chr(2)) AS t FROM documents),
s AS ({parts})
SELECT doc_id, {counts},
       sha256(coalesce({joined} FILTER (kind < {len(secrets.BASE)}), '')) AS base_sha256,
       coalesce({joined}, '') AS spans
FROM d LEFT JOIN s USING (doc_id) GROUP BY doc_id"""


def _schedule_rows() -> str:
    rows = []
    for place, knots in enumerate(curriculum.SCHEDULES):
        area = sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(knots, knots[1:]))
        done = 0.0
        for (t0, w0), (t1, w1) in zip(knots, knots[1:]):
            w0, w1 = w0 / area, w1 / area
            rows.append(f"({place}, {t0!r}::DOUBLE, {t1!r}::DOUBLE, {w0!r}::DOUBLE, {w1!r}::DOUBLE, {done!r}::DOUBLE)")
            done += (t1 - t0) * (w0 + w1) / 2
    return ", ".join(rows)


def curriculum_sql(digits: int) -> str:
    weights = "[" + ", ".join(f"{w}::DOUBLE" for w in curriculum.WEIGHTS) + "]"
    most = curriculum.MOST
    whole = " + ".join(f"(size > 0 AND {k} * ss + e <= target)::INTEGER" for k in range(most))
    fills = ""
    for k in range(curriculum.FILLS):
        fills += f""",
g{k} AS (SELECT source, max(target) - sum(copies * size) AS gap FROM r{k} GROUP BY source),
c{k} AS (SELECT r.source, arg_min(e, (abs(size - gap), e)) AS last FROM r{k} r
         JOIN g{k} g ON r.source IS NOT DISTINCT FROM g.source
         WHERE copies < {most} AND size > 0 AND abs(size - gap) < gap GROUP BY r.source),
r{k + 1} AS (SELECT r.* REPLACE (copies + coalesce(size > 0 AND e = last, false)::INTEGER AS copies) FROM r{k} r
         LEFT JOIN c{k} c ON r.source IS NOT DISTINCT FROM c.source)"""
    return f"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}'))::BIGINT AS size,
                  ('0x' || md5('{curriculum.SEED}:' || doc_id)[1:15])::BIGINT AS draw FROM documents),
src AS (SELECT source, sum(size)::BIGINT AS ss FROM d GROUP BY source),
w AS (SELECT *, {weights}[place + 1] AS weight, ss * {most}::DOUBLE AS cap FROM (
  SELECT *, (row_number() OVER (ORDER BY source IS NULL, source) - 1) % {len(curriculum.WEIGHTS)} AS place FROM src)),
o AS (SELECT *, sum(cap) OVER x AS caps, sum(weight) OVER x AS ws FROM w
      WINDOW x AS (ORDER BY cap / weight, source IS NULL, source ROWS UNBOUNDED PRECEDING)),
t AS (SELECT sum(ss)::DOUBLE AS total, sum(weight) AS allw FROM w),
f AS (SELECT o.*, cap / weight <= (total - (caps - cap)) / (allw - ws + weight) AS filled FROM o, t),
lv AS (SELECT (any_value(total) - coalesce(sum(cap) FILTER (filled), 0))
              / nullif(any_value(allw) - coalesce(sum(weight) FILTER (filled), 0), 0) AS level FROM f, t),
g AS (SELECT source, place, ss, CASE WHEN filled THEN cap ELSE weight * level END AS target FROM f, lv),
b AS (SELECT doc_id, d.source, size, place, ss, target,
             sum(size) OVER (PARTITION BY d.source ORDER BY draw, doc_id, size ROWS UNBOUNDED PRECEDING)::BIGINT AS e
      FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source),
r0 AS (SELECT *, {whole} AS copies FROM b){fills},
seg(place, t0, t1, w0, w1, done) AS (VALUES {_schedule_rows()}),
m AS (SELECT doc_id, place, k, least((k * ss + e - size / 2.0::DOUBLE) / target, 1.0::DOUBLE) AS share
      FROM r{curriculum.FILLS}, range({most}) u(k) WHERE k < copies),
z AS (SELECT m.*, t0, t1, w0, share - done AS rest, (w1 - w0) / (t1 - t0) AS slope FROM m JOIN seg USING (place)
      WHERE done <= share QUALIFY row_number() OVER (PARTITION BY doc_id, k ORDER BY done DESC) = 1),
p AS (SELECT doc_id, list(round(least(t0 + CASE WHEN rest <= 0 THEN 0 ELSE
        rest * 2 / (w0 + sqrt(greatest(w0 * w0 + slope * rest * 2, 0))) END, t1), {digits}) ORDER BY k) AS positions
      FROM z GROUP BY doc_id)
SELECT doc_id, size, ss AS source_size, target, (copies * size)::BIGINT AS taken,
       coalesce(positions, []::DOUBLE[]) AS positions
FROM r{curriculum.FILLS} LEFT JOIN p USING (doc_id)"""


def _terms(source: str, pattern: str, *columns: str) -> str:
    cols = "".join(f"{c}, " for c in columns)
    return f"""SELECT {cols}unnest(regexp_extract_all(
    translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{pattern}')) AS term FROM {source}"""


ALNUM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
ALPHA = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"

STRATA = f"""
WITH c AS (SELECT doc_id, term, count(*) AS tf FROM ({_terms('documents', ALNUM, 'doc_id')}) GROUP BY ALL),
d AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM c GROUP BY doc_id),
g AS (SELECT count(*) AS docs, sum(n)::BIGINT AS terms FROM d),
m AS (SELECT doc_id, 75 + (25 * n * docs) // terms AS m FROM d, g),
w AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS w
      FROM (SELECT term, count(*) AS df FROM c GROUP BY term), g),
q AS (SELECT item_id, term, count(*) AS times FROM ({_terms('benchmark', ALNUM, 'item_id')}) GROUP BY ALL),
s AS (SELECT item_id, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::BIGINT AS score
      FROM q JOIN w USING (term) JOIN c USING (term) JOIN m USING (doc_id) GROUP BY ALL)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0)
WHERE rank <= 20"""

DIVERGENCE = f"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, text
           FROM documents),
t AS ({_terms('d', ALPHA, 'id', 'lang', 'source')}),
kept AS (SELECT lang, term, count(*) AS total FROM t GROUP BY ALL HAVING count(DISTINCT id) >= 10),
v AS (SELECT lang, count(*) AS v, sum(total)::BIGINT AS n FROM kept GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS c FROM t JOIN kept USING (lang, term) GROUP BY ALL),
gn AS (SELECT g.lang, g.source, coalesce(sum(c), 0)::BIGINT AS n FROM g LEFT JOIN c USING (lang, source) GROUP BY ALL),
p AS (SELECT gn.lang, gn.source, kept.term, coalesce(c, 0) AS c, kept.total,
             1 + (1000000000 * (coalesce(c, 0) + 2)) // (gn.n + 2 * v.v) AS p,
             1 + (1000000000 * (kept.total + 2)) // (v.n + 2 * v.v) AS q
      FROM gn JOIN kept USING (lang) JOIN v USING (lang) LEFT JOIN c USING (lang, source, term)),
both_ AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
          FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pair AS (SELECT a.lang, a.source, b.source AS item, coalesce(value, 0)::BIGINT AS value
         FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
         LEFT JOIN both_ ON both_.lang = a.lang AND both_.source = a.source AND both_.item = b.source),
rows AS (SELECT lang, source, 'pair' AS part, item, value FROM pair
         UNION ALL SELECT lang, source, 'term', term, (((p - q) * (p - q)) // (p + q))::BIGINT FROM p
         WHERE c > 0 AND p > q)
SELECT lang, source, part, item, value, rank::INTEGER AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM rows)
WHERE part = 'pair' OR rank <= 10"""
