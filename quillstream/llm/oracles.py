"""SQL of the queries that SQL can express, for DuckDB over the same tables."""

from __future__ import annotations

from . import lattice, mixing, perplexity, suffixes, turns, urls

_L = suffixes.LENGTH
#: Bytes as pairs of hexadecimal digits; a string of LENGTH bytes at each start, the first of equal ones kept.
REPEATS = f"""
WITH d AS (SELECT doc_id, lower(hex(encode(coalesce(text, '')))) AS x FROM documents),
 b AS (SELECT doc_id, x, length(x) // 2 AS n, unnest(generate_series(0, greatest(length(x) // 2 - 1, 0))) AS i FROM d),
 w AS (SELECT doc_id, i, CASE WHEN i + {_L} <= n THEN substr(x, (2 * i + 1)::INT, {2 * _L}) END AS s, CASE WHEN n > 0 THEN substr(x, (2 * i + 1)::INT, 2) ELSE '' END AS byte, n FROM b),
 r AS (SELECT *, CASE WHEN s IS NOT NULL AND row_number() OVER (PARTITION BY s ORDER BY doc_id, i) > 1 THEN 1 ELSE 0 END AS again FROM w),
 g AS (SELECT *, max(again) OVER (PARTITION BY doc_id ORDER BY i ROWS {_L - 1} PRECEDING) AS gone FROM r),
 e AS (SELECT *, gone = 1 AND coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY i), 0) = 0 AS begins FROM g)
SELECT doc_id, any_value(n)::BIGINT AS n_bytes, sum(gone)::BIGINT AS n_removed, count(*) FILTER (WHERE begins) AS n_spans,
 sha256(unhex(coalesce(string_agg(byte, '' ORDER BY i) FILTER (WHERE gone = 0), ''))) AS kept_sha256 FROM e GROUP BY doc_id"""

_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_PART = lambda k: f"('0x' || substr(h, {5 * k + 1}, 5))::INT"
_CODE = " || ".join(f"substr('{_BASE32}', (({_PART(k)} >> {s}) & 31) + 1, 1)" for k in range(8) for s in (15, 10, 5, 0))
ARCHIVES = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS top FROM pages),
 q AS (SELECT page_id, top, strlen(html) AS payload_bytes, sha1(html) AS h FROM p)
SELECT page_id, payload_bytes, {_CODE} AS payload_digest, CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> top THEN top END AS refers_to FROM q"""

LINKS = f"""
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e, label FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
   AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
 l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
   WHERE list_inner_product(a.e, b.e) / sqrt(list_inner_product(a.e, a.e)) / sqrt(list_inner_product(b.e, b.e)) >= {lattice.LEAST}),
 r AS (SELECT vec_id AS x, vec_id AS y FROM embeddings UNION SELECT r.x, l.b FROM r JOIN l ON l.a = r.y),
 c AS (SELECT x, min(y) AS root FROM r GROUP BY x), n AS (SELECT a, count(*) AS k FROM l GROUP BY a)
SELECT vec_id, coalesce(k, 0) AS n_links, root AS component_id, vec_id = root AS kept FROM embeddings JOIN c ON x = vec_id LEFT JOIN n ON a = vec_id"""

_W = "[" + ", ".join(map(str, mixing.WEIGHTS)) + "]"
#: The blocks of all ranks together are the first words of the unrolled stream, so SQL needs no schedule.
MIX = rf"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, md5(coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
 p AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY h, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM d),
 s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
 w AS (SELECT *, {_W}[((row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(mixing.WEIGHTS)} + 1)::INT]::DOUBLE AS weight, source_size::DOUBLE * {mixing.REPEATS} AS most, sum(source_size) OVER ()::DOUBLE AS total FROM s),
 t AS (SELECT *, (total - coalesce(sum(most) OVER (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS try FROM w),
 g AS (SELECT source, source_size, total, least(most, (SELECT max(try) FROM t WHERE try <= most / weight) * weight) AS target FROM t),
 f AS (SELECT *, floor(target + 0.5)::BIGINT AS upto FROM g),
 j AS (SELECT p.*, f.source_size, f.target, f.upto FROM p JOIN f ON p.source IS NOT DISTINCT FROM f.source)
SELECT doc_id, size, source_size, target, source, CASE WHEN source_size > 0 THEN (upto // source_size) * size + greatest(0, least(size, upto % source_size - start)) ELSE 0 END::BIGINT AS taken FROM j"""

_REST = "CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END"
_RULES = sorted(urls.RULES, key=lambda r: (-len(r[0]), r[0]))


def _case(value) -> str:
    arms = ""
    for rule, verdict in _RULES:
        h, _, p = rule.partition("/")
        arms += f" WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '/{p}') THEN '{value(rule, verdict)}'"
    return f"CASE{arms} END"


def _url_filter() -> str:
    o, n = urls.ORDER, urls.ORDER + 1
    q = f"""
WITH a AS (SELECT page_id, {_REST} AS rest FROM pages),
 b AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{urls.UPPER}', '{urls.LOWER}') AS host, regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM a),
 d AS (SELECT *, {_case(lambda r, v: r)} AS rule, {_case(lambda r, v: v)} AS ruled FROM b),
 t AS (SELECT host, path, ruled, host || path AS text, count(*)::DOUBLE AS n FROM d WHERE host || path <> '' GROUP BY ALL),
 e AS (SELECT host, path, ruled, n, substr(repeat(chr(2), {o}) || text || chr(3), i::INT, {n}) AS gram FROM (SELECT *, unnest(generate_series(1, length(text) + 1)) AS i FROM t)),
 m_ AS (SELECT gram, sum(CASE WHEN ruled = 'block' THEN n ELSE 0 END) AS nb, sum(CASE WHEN ruled = 'allow' THEN n ELSE 0 END) AS na FROM e GROUP BY gram)"""
    last = "(SELECT gram, 1 / 256.0::DOUBLE AS pb, 1 / 256.0::DOUBLE AS pa FROM m_)"
    for k in range(n):
        q += f""",
 s{k} AS (SELECT substr(gram, {n - k}) AS s, sum(nb) AS nb, sum(na) AS na FROM m_ GROUP BY ALL),
 c{k} AS (SELECT substr(s, 1, {k}) AS c, sum(nb) AS tb, sum(na) AS ta, count(*) FILTER (WHERE nb > 0) AS qb, count(*) FILTER (WHERE na > 0) AS qa FROM s{k} GROUP BY ALL),
 p{k} AS (SELECT gram, CASE WHEN tb > 0 THEN (nb + qb * pb) / (tb + qb) ELSE pb END AS pb, CASE WHEN ta > 0 THEN (na + qa * pa) / (ta + qa) ELSE pa END AS pa
   FROM {last} l JOIN s{k} ON s = substr(gram, {n - k}) JOIN c{k} ON c = substr(gram, {n - k}, {k}))"""
        last = f"p{k}"
    return q + f""",
 z AS (SELECT host, path, ruled, n, round(avg(ln(pb) - ln(pa)), 9) AS score FROM e JOIN {last} USING (gram) GROUP BY ALL),
 h AS (SELECT floor(score * {urls.CUTS}) AS step, sum(CASE WHEN ruled = 'block' THEN n ELSE 0 END) AS b, sum(CASE WHEN ruled = 'allow' THEN n ELSE 0 END) AS a FROM z WHERE ruled IS NOT NULL GROUP BY ALL),
 g AS (SELECT step, round(sum(b) OVER (ORDER BY step DESC) / nullif((SELECT sum(b) FROM h), 0) + coalesce(sum(a) OVER (ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / nullif((SELECT sum(a) FROM h), 0), 9) AS gain FROM h),
 x AS (SELECT (SELECT step / {urls.CUTS} FROM g WHERE gain IS NOT NULL ORDER BY gain DESC, step LIMIT 1) AS threshold)
SELECT d.page_id, d.host, d.path, d.rule, coalesce(d.ruled, CASE WHEN threshold IS NOT NULL AND d.host <> '' AND coalesce(z.score, 0) >= threshold THEN 'block' ELSE 'allow' END) AS verdict,
 round(CASE WHEN threshold IS NULL THEN 0.0 ELSE coalesce(z.score, 0.0) END, 6) AS score, threshold FROM d LEFT JOIN z ON z.host = d.host AND z.path = d.path CROSS JOIN x"""


URL_FILTER = _url_filter()

_GAP = r"\x20\x09-\x0D"
_K = perplexity.ORDER


def _kneser_ney() -> str:
    """Grams as pairs of hexadecimal digits, keys with their language in front; each order's counts and probabilities from those of the next."""
    q = rf"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, coalesce(lang, '') AS lang, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^{_GAP}]+') AS w FROM documents),
 x AS MATERIALIZED (SELECT rid, lang, lower(hex(encode(array_to_string(w, ' ') || ' '))) AS x FROM d WHERE len(w) > 0),
 y AS (SELECT rid, lang, unnest(l) AS byte, generate_subscripts(l, 1) AS i FROM (SELECT rid, lang, regexp_extract_all(x, '..') AS l FROM x)),
 g AS MATERIALIZED (SELECT rid, lang, {" || ".join(f"coalesce(lag(byte, {k}) OVER w, '20')" for k in range(_K - 1, 0, -1))} || byte AS gram FROM y WINDOW w AS (PARTITION BY rid ORDER BY i)),
 c{_K} AS MATERIALIZED (SELECT lang, gram, count(*)::DOUBLE AS n FROM g GROUP BY ALL)"""
    for k in range(_K - 1, 0, -1):
        q += f""",
 c{k} AS MATERIALIZED (SELECT lang, substr(gram, 3) AS gram, count(*)::DOUBLE AS n FROM c{k + 1} GROUP BY ALL)"""
    for k in range(1, _K + 1):
        below = "1 / 256.0::DOUBLE" if k == 1 else "l.p"
        join = "" if k == 1 else f" JOIN p{k - 1} l ON l.key = c.lang || substr(c.gram, 3)"
        cut = lambda i: f"CASE WHEN {i} - {i + 1} * y * n{i + 1} / n{i} > 0 AND {i} - {i + 1} * y * n{i + 1} / n{i} < {i} THEN {i} - {i + 1} * y * n{i + 1} / n{i} ELSE {i / 2} END AS d{i}"
        q += f""",
 n{k} AS MATERIALIZED (SELECT *, n1 / nullif(n1 + 2 * n2, 0) AS y FROM (SELECT lang, {", ".join(f"nullif(count(*) FILTER (WHERE n = {i}), 0)::DOUBLE AS n{i}" if i < 4 else "count(*) FILTER (WHERE n = 4)::DOUBLE AS n4" for i in (1, 2, 3, 4))} FROM c{k} GROUP BY lang)),
 d{k} AS MATERIALIZED (SELECT lang, {", ".join(cut(i) for i in (1, 2, 3))} FROM n{k}),
 e{k} AS MATERIALIZED (SELECT c.lang, gram, n, CASE n WHEN 1 THEN d1 WHEN 2 THEN d2 ELSE d3 END AS d FROM c{k} c JOIN d{k} USING (lang)),
 t{k} AS MATERIALIZED (SELECT lang || substr(gram, 1, {2 * k - 2}) AS context, sum(n) AS t, sum(d) AS cut FROM e{k} GROUP BY ALL),
 p{k} AS MATERIALIZED (SELECT c.lang, c.gram, c.lang || c.gram AS key, (n - d) / t + cut / t * {below} AS p FROM e{k} c JOIN t{k} t ON t.context = c.lang || substr(c.gram, 1, {2 * k - 2}){join})"""
    return q + rf""",
 s AS MATERIALIZED (SELECT rid, sum(-log2(p)) AS cost FROM g JOIN p{_K} USING (lang, gram) GROUP BY rid),
 v AS MATERIALIZED (SELECT rid, doc_id, lang, text, w, len(w)::BIGINT AS n_words, cost / nullif(len(w), 0) AS bits FROM d LEFT JOIN s USING (rid)),
 o AS MATERIALIZED (SELECT lang, text, max(bits) AS value, max(n_words) AS n FROM v WHERE n_words > 0 GROUP BY ALL),
 m AS MATERIALIZED (SELECT lang, pow(2.0, (quantile_cont(floor(log2(value) * {perplexity.STEPS})::DOUBLE, 0.5) + 0.5) / {perplexity.STEPS}) AS middle FROM o GROUP BY lang),
 z AS MATERIALIZED (SELECT lang, 1.4826 * pow(2.0, (quantile_cont(floor(log2(greatest(abs(value - middle) * sqrt(n), 1e-6)) * {perplexity.STEPS})::DOUBLE, 0.5) + 0.5) / {perplexity.STEPS}) AS spread FROM o JOIN m USING (lang) GROUP BY lang),
 u AS (SELECT rid, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM v),
 q AS (SELECT rid, i, word || ' ' || {" || ' ' || ".join(f"lead(word, {k}) OVER w" for k in range(1, perplexity.SPAN))} AS five FROM u WINDOW w AS (PARTITION BY rid ORDER BY i)),
 r AS MATERIALIZED (SELECT rid, count(DISTINCT word) AS n FROM (SELECT rid, i + unnest(range({perplexity.SPAN})) AS word FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, five) AS times FROM q WHERE five IS NOT NULL) WHERE times > 1) GROUP BY rid),
 b AS MATERIALIZED (SELECT v.*, length(array_to_string(w, ''))::BIGINT AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
   list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^{_GAP}]')) AS l, coalesce(r.n, 0)::BIGINT AS n_repeat_words FROM v LEFT JOIN r USING (rid))
SELECT doc_id, n_words, word_chars, n_symbols, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, n_repeat_words, n_words < {perplexity.FEWEST} OR 100 * n_repeat_words > {perplexity.PERCENT} * n_words AS base_failed,
 NOT base_failed AND coalesce(abs(bits - middle) <= {perplexity.WIDTH} * sqrt(spread * spread / n_words + pow({perplexity.LEAST} * middle, 2.0)), false) AS kept, round(bits, 6) AS bits FROM b LEFT JOIN m USING (lang) LEFT JOIN z USING (lang)"""


KNESER_NEY = _kneser_ney()

#: A row of the automaton: state, initial, next state. Repairs are searched turn by turn, all that is cheapest up to each state.
TURNS = rf"""
WITH RECURSIVE crc AS (SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda a, k: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END, i::BIGINT)) AS t),
 k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations),
 h AS (SELECT conv_id, turn, role, text, xor(list_reduce(list_transform(string_split(key, ''), lambda c: ascii(c)::BIGINT), lambda a, b: xor(a >> 8, t[((xor(a, b) & 255) + 1)::INT]), 4294967295::BIGINT), 4294967295) % 20 AS h FROM k CROSS JOIN crc),
 e AS (SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' WHEN role = '' THEN ' ' ELSE role END AS role, CASE h WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE WHEN h = 3 THEN 2 ELSE 1 END)) AS copy FROM h WHERE h > 0),
 o AS (SELECT *, left(role, 1) AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS rn, NOT regexp_matches(text, '[^{_GAP}]') AS blank FROM e),
 f AS (SELECT *, NOT blank AND row_number() OVER (PARTITION BY conv_id, role, text ORDER BY rn) > 1 AS again, lag(c) OVER (PARTITION BY conv_id ORDER BY rn) || c AS pair FROM o),
 r AS (SELECT *, blank OR again AS must, NOT blank AND NOT again AND NOT regexp_matches(text, '[.!?][{_GAP}]*$') AS open FROM f),
 nxt(s, c, z) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)),
 ins(i, s, m, a, l) AS (SELECT i::INT, i::INT, 0, '', '' FROM range(4) t(i) UNION ALL SELECT i, z, m + 1, a || 'I', l || chr(10) || CASE nxt.c WHEN 'a' THEN 'assistant:' ELSE 'user:' END FROM ins JOIN nxt ON nxt.s = ins.s AND nxt.c = CASE ins.s WHEN 2 THEN 'a' ELSE 'u' END WHERE m < 3),
 way(conv_id, rn, s, best) AS (SELECT DISTINCT conv_id, 0::BIGINT, 0, row(0, '', '') FROM r
  UNION ALL SELECT conv_id, rn, s, min(best) AS best FROM (
   SELECT r.conv_id, r.rn, x.z AS s, row(way.best[1] + {turns.INSERT} * ins.m + x.cost, way.best[2] || ins.a || x.a, way.best[3] || ins.l || CASE x.a WHEN 'D' THEN '' WHEN 'K' THEN chr(10) || r.role || ':' || r.text ELSE chr(10) || CASE x.c WHEN 'a' THEN 'assistant:' ELSE 'user:' END || r.text END) AS best
   FROM way JOIN r ON r.conv_id IS NOT DISTINCT FROM way.conv_id AND r.rn = way.rn + 1 JOIN ins ON ins.i = way.s
   JOIN (SELECT s, c, z, 'K' AS a, 0 AS cost FROM nxt UNION ALL SELECT s, c, z, 'R', {turns.REROLE} FROM nxt WHERE c <> 's' UNION ALL SELECT s::INT, '', s::INT, 'D', {turns.DELETE} FROM range(4) t(s)) y(s, c, z, a, cost) ON y.s = ins.s AND (y.a = 'D' OR NOT r.must AND (y.a = 'R' OR y.c = r.c))
   JOIN LATERAL (SELECT y.z, y.a, y.c, y.cost + CASE WHEN y.a <> 'D' AND r.open THEN {turns.OPEN} ELSE 0 END AS cost) x ON true) GROUP BY ALL),
 n AS (SELECT conv_id, max(rn) AS rows_, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE blank) AS blank, count(*) FILTER (WHERE again) AS duplicate, count(*) FILTER (WHERE open) AS truncated, count(*) FILTER (WHERE pair NOT IN ('su', 'ua', 'au')) AS illegal FROM r GROUP BY conv_id),
 z AS (SELECT way.conv_id, min(row(best[1] + {turns.INSERT} * m, best[2] || a, best[3] || l)) AS best FROM way JOIN n ON n.conv_id IS NOT DISTINCT FROM way.conv_id AND n.rows_ = way.rn JOIN ins ON ins.i = way.s AND ins.s IN (0, 3) GROUP BY way.conv_id)
SELECT c.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal,
 coalesce(z.best[1], 0)::BIGINT AS cost, coalesce(z.best[2], '') AS audit, sha256(coalesce(substr(z.best[3], 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN n ON n.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN z ON z.conv_id IS NOT DISTINCT FROM c.conv_id"""
