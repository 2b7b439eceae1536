"""SQL for DuckDB that gives the rows of those operators that SQL can express."""

from __future__ import annotations

from .secrets import BASE, KINDS, ROLE, SCOPE

WORD = r"[^\x20\x09-\x0D]+"

TOP_VECTORS = """
    WITH v AS (
      SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q FROM embeddings
      WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    p AS (
      SELECT a.vec_id AS query_id, b.vec_id, list_inner_product(a.q, b.q)::BIGINT AS score
      FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0)
    SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
    FROM p QUALIFY rank <= 5"""

MIXING = f"""
    WITH t AS (SELECT doc_id, source, text, coalesce(text, '') AS x FROM documents),
    d AS (
      SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '{WORD}')), 0)::BIGINT AS size,
        greatest(0.05, 1 - 5.0 * (length(x) - length(translate(x, '#*$%&|<>', ''))) / greatest(length(x), 1)) AS q,
        ('0x' || substr(md5(doc_id || 'mix'), 1, 12))::BIGINT / 281474976710656.0::DOUBLE AS u FROM t),
    k AS (SELECT *, -ln(1 - u) / q AS key FROM d),
    s AS (SELECT source, sum(size)::BIGINT AS source_size FROM k GROUP BY source),
    w AS (SELECT *, [5.0, 2.0, 1.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS w, source_size * 3.0::DOUBLE AS most FROM s),
    l AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(most) OVER b, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER b, 0)) AS level
      FROM w WINDOW b AS (ORDER BY most / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    f AS (SELECT arg_min(level, most / w) FILTER (WHERE level <= most / w) AS level FROM l),
    g AS (SELECT source, source_size, CASE WHEN f.level IS NULL THEN most ELSE least(most, f.level * w) END::DOUBLE AS target FROM l, f),
    e AS (SELECT *, coalesce(floor(target / nullif(source_size, 0)), 0) AS epochs FROM g),
    r AS (SELECT *, round(target - epochs * source_size)::BIGINT AS rest FROM e),
    p AS (SELECT k.*, sum(size) OVER (PARTITION BY source ORDER BY key, doc_id NULLS LAST ROWS UNBOUNDED PRECEDING) AS upto FROM k)
    SELECT doc_id, size, source_size, target, (size * epochs + greatest(0, least(size, rest - (upto - size))))::BIGINT AS taken
    FROM p JOIN r ON p.source IS NOT DISTINCT FROM r.source"""


def _spans(kind: str, number: int) -> str:
    pattern = KINDS[kind].replace("'", "''")
    value = f"regexp_extract_all(x, '{pattern}', 2)" if kind == "assign" else "h"
    keep = {"assign": "length(v) >= 6", "mixed": "regexp_matches(hit, '[0-9]') AND regexp_matches(hit, '[a-z]') AND regexp_matches(hit, '[A-Z]')"}.get(kind, "true")
    return f"""
      SELECT doc_id, '{kind}' AS kind, {number} AS kn, '{ROLE[kind]}' AS role, s::INTEGER AS s, (s + length(hit))::INTEGER AS e FROM (
        SELECT doc_id, h[i] AS hit, v[i] AS v, list_sum(list_transform(g[1:i], lambda y: length(y))) + coalesce(list_sum(list_transform(h[1:i - 1], lambda y: length(y))), 0) AS s FROM (
          SELECT doc_id, g, h, {value} AS v, unnest(range(1, len(h) + 1)) AS i FROM (
            SELECT doc_id, x, string_split_regex(x, '{pattern}') AS g, regexp_extract_all(x, '{pattern}') AS h FROM t))) WHERE {keep}"""


NEAR = f"EXISTS (SELECT 1 FROM a o WHERE o.doc_id = a.doc_id AND o.role = '{{}}' AND o.e >= a.s - {SCOPE} AND o.s <= a.e + {SCOPE})"
SECRETS = f"""
    WITH t AS (SELECT doc_id, coalesce(text, '') AS x FROM documents),
    a AS ({" UNION ALL ".join(_spans(k, i) for i, k in enumerate(KINDS))}),
    r AS (SELECT * FROM a WHERE kn < {len(BASE)} OR (kind = 'mixed' AND {NEAR.format("identifier")}) OR (kind = 'user' AND {NEAR.format("secret")})
      OR (kind = 'endpoint' AND {NEAR.format("identifier")} AND {NEAR.format("secret")})),
    g AS (
      SELECT doc_id, {", ".join(f"count(*) FILTER (WHERE kind = '{k}') AS n_{k}" for k in BASE)},
        string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, kn, e) FILTER (WHERE kn < {len(BASE)}) AS base, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, kn, e) AS spans
      FROM r GROUP BY doc_id)
    SELECT t.doc_id, {", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM t LEFT JOIN g USING (doc_id)"""

#: Classes of characters in the order of quality_rules.CLASSES, as what is left when the earlier ones are taken out.
CLASS_PATTERNS = [r"\p{Ll}", r"\p{Lu}", r"[\p{Lt}\p{Lm}\p{Lo}\p{M}]", r"\p{N}", r"[\x20\x09-\x0D]", r"[.,;:!?''\"\-]", r"[#*$%&|<>]", r"[()\[\]{}]"]
JSD = "sqrt(greatest(0, (sum(CASE WHEN p > 0 THEN p * log2(2 * p / (p + q)) ELSE 0 END) + sum(CASE WHEN q > 0 THEN q * log2(2 * q / (p + q)) ELSE 0 END)) / 2))"
QUALITY = f"""
    WITH t AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(text, '') AS x FROM documents),
    w AS (SELECT doc_id, lang, x, regexp_extract_all(x, '{WORD}') AS ws FROM t),
    n AS (SELECT doc_id, len(ws) AS n_words, coalesce(list_sum(list_transform(ws, lambda y: length(y))), 0)::BIGINT AS word_chars, (length(x) - length(translate(x, '#*$%&|<>', '')))::BIGINT AS n_symbols,
        len(list_filter(string_split(x, chr(10)), lambda y: regexp_matches(y, '{WORD}'))) - len(list_distinct(list_filter(string_split(x, chr(10)), lambda y: regexp_matches(y, '{WORD}')))) AS n_dup_lines FROM w),
    v AS (SELECT doc_id, unnest(range(1, len(ws) - 3)) AS i, ws FROM w),
    v5 AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, ws[i:i + 4]) AS c FROM v),
    rp AS (SELECT doc_id, count(DISTINCT k) AS n_repeat_words FROM (SELECT doc_id, unnest(range(i, i + 5)) AS k FROM v5 WHERE c > 1) GROUP BY doc_id),
    h0 AS (SELECT doc_id, lang, length(x)::DOUBLE AS n, [{", ".join(f"length(x) - length(regexp_replace(x, '{p}', '', 'g'))" for p in CLASS_PATTERNS)}] AS c FROM t),
    h AS (SELECT doc_id, lang, n, list_append(c, n - list_sum(c)) AS c FROM h0),
    hk AS (SELECT doc_id, lang, n, k, c[k]::DOUBLE AS c FROM h, range(1, 10) r(k)),
    cr AS (SELECT lang, k, sum(c / greatest(n / 2000, 1)) AS c FROM hk GROUP BY lang, k),
    cq AS (SELECT lang, k, c / sum(c) OVER (PARTITION BY lang) AS q FROM cr),
    cd AS (SELECT doc_id, n, min(j) AS class_distance FROM (SELECT doc_id, n, cq.lang, {JSD} AS j FROM (SELECT doc_id, n, k, c / greatest(n, 1) AS p FROM hk) JOIN cq USING (k) GROUP BY doc_id, n, cq.lang) GROUP BY doc_id, n),
    lw AS (SELECT doc_id, lang, unnest(regexp_extract_all(translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}')) AS word FROM t),
    lc AS (SELECT lang, word, count(*) AS n FROM lw GROUP BY lang, word), lt AS (SELECT lang, sum(n) AS total FROM lc GROUP BY lang),
    lk AS (SELECT lang, word, n / total AS q FROM lc JOIN lt USING (lang) QUALIFY row_number() OVER (PARTITION BY lang ORDER BY n DESC, word) <= 60),
    dw AS (SELECT doc_id, word, count(*) AS n FROM lw GROUP BY doc_id, word), dn AS (SELECT doc_id, sum(n) AS n FROM dw GROUP BY doc_id HAVING sum(n) >= 30),
    m AS (SELECT dn.doc_id, lk.lang, lk.q, coalesce(dw.n, 0) / dn.n AS p FROM dn CROSS JOIN lk LEFT JOIN dw ON dw.doc_id = dn.doc_id AND dw.word = lk.word),
    mo AS (SELECT doc_id, lang, q, p FROM m UNION ALL SELECT doc_id, lang, 1 - sum(q), 1 - sum(p) FROM m GROUP BY doc_id, lang),
    wd AS (SELECT doc_id, min(j) AS word_distance FROM (SELECT doc_id, lang, {JSD} AS j FROM mo GROUP BY doc_id, lang) GROUP BY doc_id),
    z AS (SELECT n.*, coalesce(n_repeat_words, 0) AS n_repeat_words, CASE WHEN cd.n >= 200 THEN class_distance END AS cdist, word_distance AS wdist, cd.n AS chars FROM n LEFT JOIN rp USING (doc_id) JOIN cd USING (doc_id) LEFT JOIN wd USING (doc_id)),
    b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM z)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
      NOT base_failed AND NOT coalesce(cdist > 0.2 + 2.5 / sqrt(greatest(chars, 1)), false) AND NOT coalesce(wdist > 0.2 + 1.9 / sqrt(greatest(n_words, 1)), false) AS kept,
      round(cdist, 6) AS class_distance, round(wdist, 6) AS word_distance FROM b"""

LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')".format
MINHASH = f"""
    WITH RECURSIVE w AS (SELECT doc_id, coalesce(regexp_extract_all({LOWER("text")}, '{WORD}'), []) AS ws FROM documents),
    t AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN []::VARCHAR[] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
        ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) END AS ss FROM w),
    e AS (SELECT doc_id, len(ss) AS n, unnest(ss) AS s FROM t),
    c AS (SELECT a.doc_id AS x, b.doc_id AS y, a.n AS nx, b.n AS ny, count(*) AS k FROM e a JOIN e b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
    l AS (SELECT x, y FROM c WHERE 100 * k >= 85 * (nx + ny - k)),
    r(x, y) AS (SELECT doc_id, doc_id FROM t UNION SELECT r.x, l.y FROM r JOIN l ON l.x = r.y),
    g AS (SELECT x AS doc_id, min(y) AS component_id FROM r GROUP BY x)
    SELECT doc_id, len(ss) AS n_shingles, component_id, doc_id = component_id AS kept FROM t JOIN g USING (doc_id)"""

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
LEXICAL = f"""
    WITH d AS (SELECT doc_id, ts, len(ts) AS n FROM (SELECT doc_id, regexp_extract_all({LOWER("text")}, '{TERM}') AS ts FROM documents) WHERE len(ts) > 0),
    s AS (SELECT count(*) AS docs, sum(n)::BIGINT AS terms FROM d),
    q AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest(regexp_extract_all({LOWER("text")}, '{TERM}')) AS term FROM benchmark) GROUP BY ALL),
    p AS (SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, n, unnest(ts) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
    w AS (SELECT term, floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM p, s GROUP BY term, docs),
    f AS (SELECT item_id, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * n * docs) // terms))))::BIGINT AS score FROM q JOIN p USING (term) JOIN w USING (term), s GROUP BY ALL)
    SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM f WHERE score > 0 QUALIFY rank <= 10"""

#: crc32 by its table of 256 numbers, a byte at a time.
SPELLING = f"""
    WITH RECURSIVE z AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, x: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
    o AS (SELECT doc_id, w, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all({LOWER("text")}, '[a-z\\x{{C0}}-\\x{{FF}}]+')) AS w FROM documents) WHERE length(w) >= 7 GROUP BY ALL),
    y AS (SELECT w, n, hex(encode(doc_id || ':' || w)) AS h FROM o),
    b AS (SELECT w, n, list_transform(range(1, length(h), 2), lambda i: ('0x' || substr(h, i, 2))::BIGINT) AS bs FROM y),
    k AS (SELECT w, n, xor(list_reduce(list_prepend(4294967295, bs), lambda c, x: xor(c >> 8, t[xor(c, x) % 256 + 1])), 4294967295) AS h FROM b, z),
    c AS (SELECT word, sum(n)::BIGINT AS n FROM (SELECT CASE WHEN h % 31 = 0 THEN left(w, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS word, n FROM k) WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
    v AS (SELECT word, n, unnest(range(0, length(word))) AS i FROM c),
    u AS (SELECT word, n, left(word, i) || '*' || substr(word, i + 2) AS hole, left(word, i) || substr(word, i + 2) AS less FROM v),
    m AS (SELECT DISTINCT u.word AS a, c.word AS b FROM u JOIN c ON c.word = u.less),
    e AS (SELECT a, b FROM m UNION SELECT b, a FROM m UNION SELECT x.word, y.word FROM u x JOIN u y ON x.hole = y.hole AND x.word <> y.word),
    r AS (SELECT a AS word, b AS near, c.n AS near_n, count(*) OVER (PARTITION BY a) AS n_near FROM e JOIN c ON c.word = b QUALIFY row_number() OVER (PARTITION BY a ORDER BY c.n DESC, b) = 1),
    f AS (SELECT c.word, c.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 10 * c.n THEN near END AS form, CASE WHEN near_n >= 10 * c.n THEN near_n END AS form_n FROM c LEFT JOIN r USING (word)),
    g(word, root, step) AS (SELECT word, form, 1 FROM f WHERE form IS NOT NULL UNION ALL SELECT g.word, f.form, step + 1 FROM g JOIN f ON f.word = g.root WHERE f.form IS NOT NULL),
    h AS (SELECT word, arg_max(root, step) AS root FROM g GROUP BY word)
    SELECT word, form, coalesce(root, word) AS root, n, n_near, form_n FROM f LEFT JOIN h USING (word)"""
