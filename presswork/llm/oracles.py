"""SQL for the queries that SQL can express."""

ORACLES: dict[str, str] = {}

ORACLES["op5_mixing"] = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size
  FROM documents
), g AS (
  SELECT doc_id, source, size, count(*) AS copies, size * count(*) AS words,
         md5(concat('mix-1|', coalesce(doc_id::VARCHAR, 'null'))) AS key
  FROM d GROUP BY doc_id, source, size
), s AS (
  SELECT source, sum(words)::BIGINT AS source_size,
         CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight
  FROM g GROUP BY source
), r AS (
  SELECT *, 3 * source_size AS cap, sum(source_size) OVER ()::BIGINT AS total, sum(weight) OVER ()::BIGINT AS weights,
         coalesce(sum(3 * source_size) OVER w, 0)::BIGINT AS capped, coalesce(sum(weight) OVER w, 0)::BIGINT AS capped_weight
  FROM s
  WINDOW w AS (ORDER BY (3 * source_size)::DOUBLE / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), l AS (
  SELECT total - capped AS rest, weights - capped_weight AS share, capped_weight AS k FROM r
  WHERE (total - capped) * weight <= cap * (weights - capped_weight) ORDER BY capped_weight LIMIT 1
), t AS (
  SELECT source, source_size, CASE WHEN capped_weight < k THEN cap::DOUBLE ELSE (rest * weight)::DOUBLE / share END AS target
  FROM r, l
), c AS (
  SELECT g.*, source_size, target, coalesce(sum(words) OVER (PARTITION BY g.source ORDER BY key, size
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
         CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS times
  FROM g JOIN t ON g.source IS NOT DISTINCT FROM t.source
), e AS (
  SELECT *, target - times * source_size AS extra,
    size > 0 AND target - times * source_size > 0 AND before * 2 + words <= (target - times * source_size) * 2 AS drawn
  FROM c
), gap AS (
  SELECT source, any_value(extra) - coalesce(sum(words) FILTER (drawn), 0)::BIGINT AS gap FROM e GROUP BY source
), closing AS (
  SELECT e.source, e.key, e.size, row_number() OVER (PARTITION BY e.source ORDER BY abs(words - gap), key, size) AS nth
  FROM e JOIN gap ON e.source IS NOT DISTINCT FROM gap.source WHERE NOT drawn AND words > 0 AND abs(words - gap) < gap
), p AS (
  SELECT e.*, times + CASE WHEN drawn OR nth IS NOT NULL THEN 1 ELSE 0 END AS repeats
  FROM e LEFT JOIN (FROM closing WHERE nth = 1) o
    ON e.source IS NOT DISTINCT FROM o.source AND e.key = o.key AND e.size = o.size
)
SELECT doc_id, size, source_size, target, (size * repeats)::BIGINT AS taken
FROM p, LATERAL (SELECT unnest(range(copies)))
"""

ORACLES["op9_decontamination"] = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
         coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                  '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w
  FROM documents
), i AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                  '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark
), iw AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[s:s + least(len(w), 10) - 1], ' ') AS words
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS s FROM i WHERE len(w) > 0)
), dw AS (
  SELECT r, s, n, array_to_string(w[s:s + n - 1], ' ') AS words
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, (SELECT DISTINCT n FROM iw) WHERE len(w) >= n)
), h AS (
  SELECT DISTINCT r, s, n, item_id FROM dw JOIN iw USING (n, words)
), hit AS (
  SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(s, s + n)) AS p FROM h) GROUP BY r
), its AS (
  SELECT r, count(*) AS n_items, string_agg(k, ',' ORDER BY k) AS ids FROM (SELECT DISTINCT r, item_id::VARCHAR AS k FROM h) GROUP BY r
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN its USING (r)
"""

ORACLES["op6_substrings"] = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents
), win AS (
  SELECT r, doc_id, s, array_to_string(w[s:s + 12], ' ') AS words
  FROM (SELECT r, doc_id, w, unnest(range(1, len(w) - 11)) AS s FROM d WHERE len(w) >= 13 AND doc_id IS NOT NULL)
), first AS (
  SELECT words, min(doc_id) AS lowest FROM win GROUP BY words HAVING min(doc_id) < max(doc_id)
), gone AS (
  SELECT DISTINCT r, unnest(range(s, s + 13)) AS p FROM win JOIN first USING (words) WHERE doc_id > lowest
), each AS (
  SELECT r, doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM d
), kept AS (
  SELECT each.r, string_agg(word, ' ' ORDER BY each.p) AS text, count(*) AS n
  FROM each LEFT JOIN gone ON each.r = gone.r AND each.p = gone.p WHERE gone.r IS NULL GROUP BY each.r
)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (r)
"""

ORACLES["op8_near_duplicates"] = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                 '[^\x20\x09-\x0D]+'), []) AS w
  FROM documents
), sh AS (
  SELECT DISTINCT doc_id, array_to_string(w[s:s + least(len(w), 5) - 1], ' ') AS x
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - least(len(w), 5) + 2)) AS s FROM d WHERE len(w) > 0)
), n AS (
  SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id
), common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sh a JOIN sh b USING (x) WHERE a.doc_id < b.doc_id GROUP BY ALL
), link AS (
  SELECT a, b FROM common JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 85 * (na.n + nb.n - c)
), pairs AS (
  SELECT a, b FROM link UNION ALL SELECT b, a FROM link
), reach AS (
  SELECT doc_id AS v, doc_id AS r FROM d
  UNION
  SELECT pairs.b, reach.r FROM reach JOIN pairs ON pairs.a = reach.v WHERE reach.r < pairs.b
), comp AS (
  SELECT v, min(r) AS r FROM reach GROUP BY v
)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, r AS component_id, d.doc_id = r AS kept
FROM d LEFT JOIN n USING (doc_id) JOIN comp ON comp.v = d.doc_id
"""

ORACLES["op2_near_vectors"] = r"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), link AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b USING (label)
  WHERE a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.98
), reach AS (
  SELECT vec_id AS v, vec_id AS r FROM embeddings
  UNION
  SELECT link.b, reach.r FROM reach JOIN link ON link.a = reach.v WHERE reach.r < link.b
), comp AS (
  SELECT v, min(r) AS r FROM reach GROUP BY v
), n AS (
  SELECT a, count(*) AS n FROM link GROUP BY a
)
SELECT vec_id, coalesce(n.n, 0)::BIGINT AS n_links, r AS component_id, vec_id = r AS kept
FROM embeddings LEFT JOIN n ON n.a = vec_id JOIN comp ON comp.v = vec_id
"""

_SECRETS = {
    "assign": r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+""",
    "access": r"AKIA[A-Z0-9]+",
    "hex": r"[0-9a-f]{32,}",
    "private": r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----",
    "jwt": r"\beyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}",
    "vendor": r"\b(?:gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{20,}|sk_live_[A-Za-z0-9]{20,}|AIza[A-Za-z0-9_-]{35})",
}
_KEPT = {
    "assign": r"""length(regexp_extract(m, '^(?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)$', 1)) >= 8""",
    "access": "length(m) >= 16",
}


def _found(rank: int, kind: str) -> str:
    quoted = _SECRETS[kind].replace("'", "''")
    return f"""
  SELECT r, {rank} AS rank, '{kind}' AS kind, e - length(m) AS s, e, m FROM (
    SELECT r, m, sum(gap + length(m)) OVER (PARTITION BY r ORDER BY i ROWS UNBOUNDED PRECEDING)::BIGINT AS e FROM (
      SELECT r, unnest(range(len(ms))) AS i, unnest(ms) AS m, unnest(list_transform(gaps[1:len(ms)], lambda x: length(x))) AS gap FROM (
        SELECT r, regexp_extract_all(t, '{quoted}') AS ms, string_split_regex(t, '{quoted}') AS gaps FROM d
      ) WHERE len(ms) > 0
    )
  ) WHERE {_KEPT.get(kind, 'true')}"""


ORACLES["op7_secrets"] = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
f AS ({' UNION ALL '.join(_found(k, kind) for k, kind in enumerate(_SECRETS))}),
g AS (
  SELECT r, count(*) FILTER (kind = 'assign') AS a, count(*) FILTER (kind = 'access') AS b, count(*) FILTER (kind = 'hex') AS c,
         string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank) FILTER (rank < 3) AS base,
         string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank) AS everything
  FROM f GROUP BY r
)
SELECT doc_id, coalesce(a, 0)::BIGINT AS n_assign, coalesce(b, 0)::BIGINT AS n_access, coalesce(c, 0)::BIGINT AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(everything, '') AS spans
FROM d LEFT JOIN g USING (r)
"""

ORACLES["op11_filter_audit"] = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words
  FROM documents
), first AS (
  SELECT coalesce(text, '') AS t, min(doc_id) AS lowest FROM documents GROUP BY 1
), l AS (
  SELECT doc_id, max(quality = 1) AS good, max(toxic = 1) AS bad FROM labels GROUP BY doc_id
), d AS (
  SELECT part, coalesce(good, false) AS good, coalesce(bad, false) AS bad,
    CASE WHEN len(words) < 100 THEN 'A' ELSE '' END
    || CASE WHEN 100 * len(list_distinct(words)) < 80 * len(words) THEN 'B' ELSE '' END
    || CASE WHEN 100 * len(regexp_extract_all(t, '[A-Z]')) > 10 * length(t) THEN 'C' ELSE '' END
    || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END
    || CASE WHEN w.doc_id > lowest THEN 'E' ELSE '' END AS fails
  FROM w JOIN first USING (t) LEFT JOIN l ON l.doc_id = w.doc_id
), c AS (
  SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (bad) AS bad FROM d GROUP BY ALL
), orders AS (
  SELECT '' AS o UNION ALL
  SELECT o || x FROM orders, (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x) WHERE NOT contains(o, x)
), steps AS (
  SELECT o, k AS step, o[k] AS f, o[1:k - 1] AS earlier FROM orders, (SELECT unnest(range(1, 6)) AS k) WHERE length(o) = 5
), s AS (
  SELECT part, o, step, f, earlier, fails, n, good, bad, contains(fails, f) AS now,
         earlier <> '' AND len(list_intersect(string_split(fails, ''), string_split(earlier, ''))) > 0 AS gone
  FROM steps, c
), r AS (
  SELECT part, o AS filter_order, step, f,
    sum(CASE WHEN NOT gone AND NOT now THEN n ELSE 0 END)::BIGINT AS kept,
    sum(CASE WHEN NOT gone AND now THEN n ELSE 0 END)::BIGINT AS removed,
    sum(CASE WHEN gone AND now THEN n ELSE 0 END)::BIGINT AS redundant,
    sum(CASE WHEN fails = f THEN n ELSE 0 END)::BIGINT AS unique_fails,
    sum(CASE WHEN NOT gone AND now THEN good ELSE 0 END)::BIGINT AS good_lost,
    sum(CASE WHEN NOT gone AND now THEN bad ELSE 0 END)::BIGINT AS toxic_lost
  FROM s GROUP BY part, o, step, f
)
SELECT part, filter_order, step::INTEGER AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       (sum(removed) OVER (PARTITION BY part, f))::BIGINT AS shapley
FROM r
"""

ORACLES["op12_collocations"] = r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
), w AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p
), g AS (
  SELECT lang, k, w[s:s + k - 1] AS words
  FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS s FROM w, (SELECT unnest(range(1, 6)) AS k) WHERE len(w) >= k)
), f AS (
  SELECT lang, k, array_to_string(words, ' ') AS phrase, count(*) AS f FROM g GROUP BY ALL
), total AS (
  SELECT lang, sum(f) AS n FROM f WHERE k = 1 GROUP BY lang
), often AS (
  SELECT * FROM f WHERE f >= 100
), cuts AS (
  SELECT c.lang, c.phrase, c.k AS words, c.f AS a, unnest(range(1, c.k)) AS cut, string_split(c.phrase, ' ') AS w FROM often c WHERE c.k > 1
), scored AS (
  SELECT c.lang, c.phrase, c.words, a, cut, x.f AS l, y.f AS r, n::BIGINT AS n, (1000::HUGEINT * a * n) // (x.f::HUGEINT * y.f) AS score
  FROM cuts c JOIN often x ON x.lang = c.lang AND x.phrase = array_to_string(w[:cut], ' ')
  JOIN often y ON y.lang = c.lang AND y.phrase = array_to_string(w[cut + 1:], ' ') JOIN total ON total.lang = c.lang
), best AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) AS o FROM scored) WHERE o = 1
), kept AS (
  SELECT * FROM best b WHERE NOT EXISTS (
    SELECT 1 FROM often x WHERE x.lang = b.lang AND x.k > b.words AND 100 * x.f >= 100 * b.a AND contains(' ' || x.phrase || ' ', ' ' || b.phrase || ' '))
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept
)
SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM ranked WHERE rank <= 2000
"""
