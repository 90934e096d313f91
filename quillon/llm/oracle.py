"""SQL of the queries that SQL can express, for DuckDB. Hashes, profiles, tokens and Viterbi paths are beyond it."""

_SPLIT = "list_filter(regexp_split_to_array({}, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"
_WORDS = _SPLIT.format("coalesce({}, '')")
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _shingles(words: str, k: str = "5") -> str:
    return f"CASE WHEN len({words}) = 0 THEN [] ELSE list_transform(range(1, greatest(len({words}) - {k}, 0) + 2), lambda i: array_to_string({words}[i : i + {k} - 1], ' ')) END"


OP2 = f"""WITH raw AS (SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS ln FROM documents WHERE text IS NOT NULL),
  lines AS (SELECT *, len({_WORDS.format('line')}) AS n FROM raw),
  own AS (SELECT doc_id, ln, line, n, row_number() OVER d AS p, sum(n) OVER d AS upto FROM lines WHERE n > 0 WINDOW d AS (PARTITION BY doc_id ORDER BY ln)),
  seqs AS (SELECT doc_id, list(line ORDER BY p) AS seq FROM own GROUP BY doc_id),
  ahead AS (SELECT a.doc_id, a.p AS s, min(b.p) AS e FROM own a JOIN own b ON a.doc_id = b.doc_id AND b.p BETWEEN a.p AND a.p + 49 AND b.upto - a.upto + a.n >= 50 GROUP BY 1, 2),
  back AS (SELECT b.doc_id, max(a.p) AS s, b.p AS e FROM own a JOIN own b ON a.doc_id = b.doc_id AND b.p BETWEEN a.p AND a.p + 49 AND b.upto - a.upto + a.n >= 50 GROUP BY b.doc_id, b.p),
  blocks AS (SELECT q.doc_id, s, e, array_to_string(seq[s:e], chr(10)) AS body FROM (SELECT * FROM ahead UNION SELECT * FROM back) q JOIN seqs ON q.doc_id = seqs.doc_id),
  later AS (SELECT doc_id, s, e FROM (SELECT *, row_number() OVER (PARTITION BY body ORDER BY doc_id, s) AS k FROM blocks) WHERE k > 1),
  cut AS (SELECT DISTINCT l.doc_id, p FROM own o JOIN later l ON o.doc_id = l.doc_id AND o.p BETWEEN l.s AND l.e),
  marked AS (SELECT o.*, c.p IS NOT NULL AS gone FROM own o LEFT JOIN cut c ON o.doc_id = c.doc_id AND o.p = c.p),
  every AS (SELECT l.doc_id, l.ln, l.line, l.n, m.gone, last_value(m.gone IGNORE NULLS) OVER (PARTITION BY l.doc_id ORDER BY l.ln ROWS UNBOUNDED PRECEDING) AS before, first_value(m.gone IGNORE NULLS) OVER (PARTITION BY l.doc_id ORDER BY l.ln ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS after FROM lines l LEFT JOIN marked m ON l.doc_id = m.doc_id AND l.ln = m.ln),
  done AS (SELECT doc_id, count(*) FILTER (n > 0) AS n_lines, count(*) FILTER (gone) AS removed_lines, coalesce(sum(n) FILTER (gone), 0)::BIGINT AS removed_words, coalesce(string_agg(line, chr(10) ORDER BY ln) FILTER (NOT (CASE WHEN n > 0 THEN gone ELSE coalesce(before, false) AND coalesce(after, true) END)), '') AS text FROM every GROUP BY doc_id)
  SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(removed_lines, 0) AS removed_lines, coalesce(removed_words, 0) AS removed_words, coalesce(done.text, '') AS text FROM documents d LEFT JOIN done ON d.doc_id = done.doc_id"""

OP5 = f"""WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format(_LOWER.format('text'))} AS words FROM documents),
  s AS (SELECT doc_id, list_distinct({_shingles('words')}) AS sh FROM w),
  x AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS g FROM s),
  pairs AS (SELECT a.doc_id AS a, b.doc_id AS b FROM x a JOIN x b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 75 * (max(a.n) + max(b.n) - count(*))),
  both_ AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs),
  reach AS (SELECT a, b FROM both_ UNION SELECT r.a, e.b FROM reach r JOIN both_ e ON r.b = e.a)
  SELECT s.doc_id, len(sh) AS n_shingles, least(s.doc_id, coalesce(min(b), s.doc_id)) AS component_id, least(s.doc_id, coalesce(min(b), s.doc_id)) = s.doc_id AS kept FROM s LEFT JOIN reach ON reach.a = s.doc_id GROUP BY s.doc_id, sh"""

OP13 = f"""WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format(_LOWER.format('text'))} AS words FROM documents),
  s AS (SELECT doc_id, list_distinct({_shingles('words', '4')}) AS sh FROM w),
  x AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS g FROM s),
  pairs AS (SELECT a.doc_id AS a, b.doc_id AS b FROM x a JOIN x b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 85 * (max(a.n) + max(b.n) - count(*))),
  both_ AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs),
  reach AS (SELECT a, b FROM both_ UNION SELECT r.a, e.b FROM reach r JOIN both_ e ON r.b = e.a)
  SELECT s.doc_id, len(sh) AS n_shingles, least(s.doc_id, coalesce(min(b), s.doc_id)) AS component_id FROM s LEFT JOIN reach ON reach.a = s.doc_id GROUP BY s.doc_id, sh"""

#: All windows that begin and end with a shingle of the item, of any length that can be similar.
OP8 = f"""WITH items AS (SELECT DISTINCT item_id, {_WORDS.format('lower(text)')} AS words FROM benchmark),
  it AS (SELECT item_id, len(words) AS n, greatest(len(words) - 4, 1) AS m, {_shingles('words')} AS sh FROM items WHERE len(words) > 0),
  ig AS (SELECT item_id, n, m, g, count(*) AS weight FROM (SELECT item_id, n, m, unnest(sh) AS g FROM it) GROUP BY ALL),
  d AS (SELECT DISTINCT doc_id, {_WORDS.format('lower(text)')} AS words FROM documents),
  ks AS (SELECT DISTINCT least(n, 5) AS k FROM it UNION SELECT 5),
  dl AS (SELECT doc_id, {_shingles('words', 'k')} AS sh FROM d, ks),
  dsh AS (SELECT DISTINCT doc_id, unnest(sh) AS g, generate_subscripts(sh, 1) - 1 AS p FROM dl),
  hit AS (SELECT doc_id, item_id, n, m, p, ig.g, weight FROM dsh JOIN ig ON dsh.g = ig.g QUALIFY 100 * count(*) OVER (PARTITION BY doc_id, item_id) >= 75 * m),
  win AS (SELECT a.doc_id, a.item_id, a.n, a.m, a.p AS s, b.p AS e FROM hit a JOIN hit b ON a.doc_id = b.doc_id AND a.item_id = b.item_id AND b.p BETWEEN a.p AND a.p + 100 * a.m // 75 - 1),
  cnt AS (SELECT w.doc_id, w.item_id, w.n, w.m, s, e, least(count(*), any_value(weight)) AS c FROM win w JOIN hit h ON h.doc_id = w.doc_id AND h.item_id = w.item_id AND h.p BETWEEN s AND e GROUP BY w.doc_id, w.item_id, w.n, w.m, s, e, h.g),
  sim AS (SELECT doc_id, item_id, n, m, s, e, sum(c) AS shared, e - s + 1 + m - sum(c) AS every FROM cnt GROUP BY doc_id, item_id, n, m, s, e)
  SELECT doc_id, item_id, s AS start_word, (e - s + least(n, 5))::BIGINT AS n_words, round(shared / every, 9) AS similarity FROM sim WHERE 100 * shared >= 75 * every QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY shared / every DESC, s, e) = 1"""

_HOST = "translate(regexp_extract({0}, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_REST = "CASE WHEN instr({0}, '://') > 0 THEN substr({0}, instr({0}, '://') + 3) ELSE '' END"


def _fits(host: str, path: str) -> str:
    return f"((host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '{path}'))"


_RULES = (("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"), ("net", "/", "block"))


def _rank(name: str, links: str, seed: str) -> str:
    """Rounds until a change is below 0.85^100, less than a ten-millionth."""
    start = f"SELECT 0 AS round, host, 0.15 * {seed} AS score, 0.15 AS most FROM seeds"
    flow = f"SELECT r.round + 1 AS round, l.dst AS host, 0.85 * r.score / l.n AS score, 0.85 * r.most / l.n AS most FROM {name} r JOIN {links} l ON l.src = r.host WHERE r.round < 100"
    again = f"SELECT t.round + 1, host, 0.15 * {seed}, 0.15 FROM seeds, (SELECT DISTINCT round FROM {name}) t WHERE t.round < 100"
    return f"{name} AS ({start} UNION ALL SELECT round, host, sum(score), sum(most) FROM ({flow} UNION ALL {again}) GROUP BY round, host)"


OP9 = f"""WITH RECURSIVE r0 AS (SELECT page_id, html, {_REST.format("coalesce(url, '')")} AS rest FROM pages),
  split AS (SELECT page_id, html, {_HOST.format('rest')} AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM r0),
  ruled AS (SELECT *, CASE {' '.join(f"WHEN {_fits(h, p)} THEN '{h}{p}'" for h, p, _ in _RULES)} END AS rule, CASE {' '.join(f"WHEN {_fits(h, p)} THEN '{v}'" for h, p, v in _RULES)} END AS says FROM split),
  own AS (SELECT host, count(*) FILTER (says = 'allow') / count(*) AS trusted, count(*) FILTER (says = 'block') / count(*) AS blocked FROM ruled WHERE host <> '' GROUP BY host),
  refs AS (SELECT host AS src, unnest(regexp_extract_all(html, '(?i)\\bhref\\s*=\\s*["'']?([^"''\\s>]+)', 1)) AS u FROM split WHERE host <> '' AND html IS NOT NULL),
  refs2 AS (SELECT src, CASE WHEN starts_with(u, '//') THEN 'http:' || u ELSE u END AS u FROM refs),
  links AS (SELECT DISTINCT src, {_HOST.format('x')} AS dst FROM (SELECT src, {_REST.format('u')} AS x FROM refs2) WHERE {_HOST.format('x')} NOT IN ('', src)),
  seeds AS (SELECT host, max(trusted) AS trusted, max(blocked) AS blocked FROM (SELECT * FROM own UNION ALL SELECT unnest([src, dst]), 0, 0 FROM links) GROUP BY host),
  fwd AS (SELECT src, dst, count(*) OVER (PARTITION BY src) AS n FROM links), rev AS (SELECT dst AS src, src AS dst, count(*) OVER (PARTITION BY dst) AS n FROM links),
  {_rank('trust', 'fwd', 'trusted')}, {_rank('distrust', 'rev', 'blocked')},
  flown AS (SELECT host, trusted, blocked, t.score - 0.15 * trusted AS tg, t.most - 0.15 AS tm, d.score - 0.15 * blocked AS dg, d.most - 0.15 AS dm FROM seeds JOIN trust t USING (host) JOIN distrust d USING (host) WHERE t.round = 100 AND d.round = 100),
  shares AS (SELECT host, greatest(CASE WHEN tm > 1e-6 THEN tg / tm ELSE 0 END, trusted) AS t, greatest(CASE WHEN dm > 1e-6 THEN dg / dm ELSE 0 END, blocked) AS d FROM flown)
  SELECT page_id, ruled.host, path, rule, coalesce(says, CASE WHEN d - t > 0.5 + 1e-4 THEN 'block' ELSE 'allow' END) AS verdict FROM ruled LEFT JOIN shares ON shares.host = ruled.host"""

_PER_PART = "SELECT p.vec_id, p.part, b.entry, list_sum(list_transform(list_zip(v, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS gap FROM parts p JOIN {0} b ON p.part = b.part"
_NEAREST = "SELECT vec_id, part, entry, gap FROM (" + _PER_PART + ") QUALIFY row_number() OVER (PARTITION BY vec_id, part ORDER BY gap, entry) = 1"


def _round(k: int) -> str:
    """One round: assignment to the codebooks of round k, then the averages, rounded down, as those of round k + 1."""
    means = "SELECT a.part, entry, i, floor_div(sum(v[i])::BIGINT, count(*)) AS c FROM a JOIN parts p ON a.vec_id = p.vec_id AND a.part = p.part, (SELECT unnest(range(1, 9)) AS i) GROUP BY a.part, entry, i"
    means = means.replace("floor_div(sum(v[i])::BIGINT, count(*))", "((sum(v[i])::BIGINT - ((sum(v[i])::BIGINT % count(*)) + count(*)) % count(*)) // count(*))")
    new = f"SELECT part, entry, list(c ORDER BY i) AS c FROM m{k} GROUP BY part, entry"
    return f"a{k} AS MATERIALIZED ({_NEAREST.format(f'b{k}')}), m{k} AS MATERIALIZED ({means.replace('FROM a JOIN', f'FROM a{k} a JOIN')}), n{k} AS ({new}), b{k + 1} AS MATERIALIZED (SELECT b.part, b.entry, coalesce(n.c, b.c) AS c FROM b{k} b LEFT JOIN n{k} n ON b.part = n.part AND b.entry = n.entry)"


OP11 = f"""WITH good AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor(x::DOUBLE * 4096)::BIGINT) AS v FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
  parts AS MATERIALIZED (SELECT vec_id, part, v[part * 8 + 1 : part * 8 + 8] AS v FROM good, (SELECT unnest(range(8)) AS part)),
  b0 AS MATERIALIZED (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry, v AS c FROM parts QUALIFY row_number() OVER (PARTITION BY part ORDER BY vec_id) <= 16),
  {', '.join(_round(k) for k in range(6))}, last AS MATERIALIZED ({_NEAREST.format('b6')}),
  coded AS (SELECT vec_id, string_agg(lower(printf('%02x', entry)), '' ORDER BY part) AS code, sum(gap)::BIGINT AS error FROM last GROUP BY vec_id),
  books AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM b6)
  SELECT g.vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM good g JOIN coded c ON g.vec_id = c.vec_id, books"""

_TERMS = "unnest(regexp_extract_all(" + _LOWER.format("text") + r", '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'))"

OP12 = f"""WITH t AS (SELECT doc_id, {_TERMS} AS term FROM documents), tf AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY ALL), len AS (SELECT doc_id, count(*) AS n FROM t GROUP BY doc_id),
  s AS (SELECT count(*) AS nn, sum(n)::BIGINT AS l FROM len), q AS (SELECT item_id, term, count(*) AS r FROM (SELECT item_id, {_TERMS} AS term FROM benchmark) GROUP BY ALL),
  w AS (SELECT term, floor(1000 * ln((2 * nn + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM tf, s GROUP BY term, nn),
  imp AS (SELECT tf.doc_id, tf.term, w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * nn) // l))) AS x FROM tf JOIN len ON tf.doc_id = len.doc_id JOIN w ON tf.term = w.term, s),
  sc AS (SELECT item_id, doc_id, sum(r * x)::BIGINT AS score FROM q JOIN imp ON q.term = imp.term GROUP BY ALL)
  SELECT item_id, rank::INT AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM sc WHERE score > 0) WHERE rank <= 20"""

ORACLE_SQL = {"op2_lines": OP2, "op5_minhash": OP5, "op8_decontamination": OP8, "op9_urls": OP9, "op11_vectors": OP11, "op12_search": OP12, "op13_join": OP13}
