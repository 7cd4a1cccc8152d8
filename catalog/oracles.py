"""The registered queries in SQL, written against the driver tables only."""

from __future__ import annotations

from presswork import params

from . import fixtures as T

# ------------------------------------------------------------------ building blocks

SP = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]"
NSP = r"[^\s\x0b\x1c-\x1f\x{85}\p{Z}]"


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def sql_list(values) -> str:
    return "[" + ", ".join(lit(v) for v in values) + "]"


def in_list(values) -> str:
    return "(" + ", ".join(lit(v) for v in values) + ")"


def sents(c: str) -> str:
    return rf"string_split(regexp_replace({c}, '([.!?])[\s\x0b]+', '\1' || chr(1), 'g'), chr(1))"


def strip(c: str) -> str:
    return f"regexp_replace({c}, '^{SP}+|{SP}+$', '', 'g')"


def wc(c: str) -> str:
    return f"len(regexp_extract_all({c}, '{NSP}+'))"


def words(c: str) -> str:
    return f"regexp_extract_all({c}, '{NSP}+')"


def padded(c: str) -> str:
    return rf"(' ' || trim(regexp_replace(regexp_replace(lower({c}), '([^\p{{L}}\p{{N}}\s])', ' \1 ', 'g'), '\s+', ' ', 'g')) || ' ')"


def rfind(c: str, ch: str) -> str:
    return f"(CASE WHEN contains({c}, {lit(ch)}) THEN length({c}) - strpos(reverse({c}), {lit(ch)}) ELSE -1 END)"


def unescape(c: str) -> str:
    x = c
    for a, b in (("&quot;?", '"'), ("&copy;?", "©"), ("&middot;?", "·"), ("&amp;?", "&")):
        x = f"regexp_replace({x}, '{a}', '{b}', 'g')"
    return x


def untag(c: str, sep: str) -> str:
    x = rf"regexp_replace({c}, '(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>', '{sep}', 'g')"
    return f"regexp_replace({x}, '<[a-zA-Z/!?][^>]*>', '{sep}', 'g')"


def clean(c: str, markup: bool = False) -> str:
    x = f"coalesce({c}, '')"
    if markup:
        x = unescape(untag(unescape(x), " "))
    x = f"regexp_replace({x}, 'https?{NSP}+|www\\.{NSP}+', '', 'g')"
    x = f"regexp_replace({x}, '{NSP}+@{NSP}+\\.{NSP}+', '', 'g')"
    x = rf"regexp_replace({x}, '[^\x00-\x7F]+', ' ', 'g')"
    x = rf"regexp_replace(lower({x}), '[!-/:-@\[-`{{-~0-9]+', '', 'g')"
    return rf"trim(regexp_replace({x}, '[\s\x0b\x1c-\x1f]+', ' ', 'g'))"


def lines_of(c: str) -> str:
    """Stripped non-blank lines of marked-up text."""
    x = unescape(untag(c, ""))
    parts = rf"string_split(regexp_replace({x}, '\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{{85}}\x{{2028}}\x{{2029}}]|  ', chr(1), 'g'), chr(1))"
    return f"array_to_string([{strip('x')} for x in {parts} if {strip('x')} <> ''], chr(10))"


def n_sents(c: str) -> str:
    return f"len([p for p in string_split(translate(coalesce({c}, ''), '!?', '..'), '.') if {strip('p')} <> ''])"


BOIL = " OR ".join(f"contains(lower(s), {lit(p)})" for p in T.BOILERPLATE)


def unboiled(c: str) -> str:
    return f"[s for s in {sents(c)} if NOT ({BOIL})]"


ARTICLES = rf"""
art AS (
  SELECT doc_id, 'S' || (doc_id % 8) AS sector,
         CASE WHEN doc_id % 2 = 0 THEN 'newsapi' ELSE 'gnews' END AS provider,
         CAST((doc_id // 8) % 5 AS INTEGER) AS query_idx, CAST(doc_id % 2 AS INTEGER) AS provider_idx,
         doc_id AS provider_rank, 'doc://' || md5(text) AS url,
         ss[1] AS title, array_to_string(ss[1:2], ' ') AS description, text AS content,
         source AS source_name, lang,
         TIMESTAMP '2024-01-01' + to_hours(doc_id) AS published_ts,
         strftime(TIMESTAMP '2024-01-01' + to_hours(doc_id), '%Y-%m-%dT%H:%M:%SZ') AS published_raw,
         date_trunc('day', TIMESTAMP '2024-01-01' + to_hours(doc_id))::TIMESTAMP AS snapshot_ts
  FROM (SELECT *, {sents('text')} AS ss FROM documents)
)"""

DEDUP = """
ded AS (
  SELECT * FROM art QUALIFY row_number() OVER (PARTITION BY sector, url
    ORDER BY query_idx, provider_idx, provider_rank) = 1
)"""


def top(n: int) -> str:
    return f"""
top AS (
  SELECT *, row_number() OVER (PARTITION BY sector ORDER BY query_idx, provider_idx, provider_rank) AS deck_pos
  FROM ded QUALIFY deck_pos <= {n}
)"""


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


ORACLES: dict[str, str] = {}


def add(name: str, sql: str) -> None:
    ORACLES[name] = sql


A = with_(ARTICLES)

# ------------------------------------------------------------------ selection

add("dedup_by_url", with_(ARTICLES, DEDUP) + "SELECT sector, url, doc_id FROM ded")
add("top_per_sector", with_(ARTICLES, DEDUP, top(5)) + "SELECT sector, deck_pos, url, title FROM top")
add("collect_sources", with_(ARTICLES, DEDUP, top(10)) + "SELECT sector, deck_pos, provider, url FROM top")
add("union_sources", A + "SELECT doc_id, provider, title, CASE WHEN provider = 'newsapi' THEN source_name END AS source_name FROM art")
add("limit_per", A + "SELECT sector, provider, doc_id FROM art QUALIFY row_number() OVER (PARTITION BY sector, provider ORDER BY provider_rank) <= 7")
add("limit_request", A + "SELECT query_idx, doc_id FROM art ORDER BY query_idx, provider_idx, provider_rank LIMIT 500")
add("order_articles", A + "SELECT doc_id, url, CAST(length(title) % 7 AS BIGINT) AS score FROM art ORDER BY score DESC, published_ts DESC, url LIMIT 50")
add("rank_articles", A + """
SELECT doc_id, url, CAST(length(title) % 7 AS BIGINT) AS score,
  row_number() OVER (ORDER BY length(title) % 7 DESC NULLS LAST, published_ts DESC NULLS LAST, url NULLS FIRST) AS rank FROM art""")
add("latest_snapshot", A + "SELECT sector, doc_id, url FROM art QUALIFY rank() OVER (PARTITION BY sector ORDER BY snapshot_ts DESC) = 1")
add("exclude_used", with_(ARTICLES, DEDUP, top(10)) + """
SELECT doc_id, sector, url FROM art a
WHERE NOT EXISTS (SELECT 1 FROM top t WHERE t.sector = a.sector AND t.url = a.url)""")

_q = ", ".join(f"({lit(s)}, {i}, {lit(q.strip(chr(34)))})" for s, i, q in T.QUERIES)
add("search_articles", with_(ARTICLES, f"q(sector, query_idx, term) AS (VALUES {_q})", f"""
pad AS (SELECT doc_id, {padded('title')} AS t, {padded('description')} AS d, {padded('content')} AS c FROM art)""") + """
SELECT doc_id, sector, CAST(query_idx AS INTEGER) AS query_idx,
  CAST(3 * contains(t, ' ' || term || ' ')::INT + 2 * contains(d, ' ' || term || ' ')::INT
     + contains(c, ' ' || term || ' ')::INT AS BIGINT) AS score
FROM pad, q
WHERE contains(t, ' ' || term || ' ') OR contains(d, ' ' || term || ' ') OR contains(c, ' ' || term || ' ')""")
# each search against all runs of as many tokens
MANY = with_(ARTICLES, f"""
q(sector, query_idx, term) AS (VALUES {_q} UNION ALL SELECT sector, CAST(doc_id + 10 AS INTEGER), array_to_string((string_split(trim({padded('content')}), ' '))[1:3], ' ') FROM art),
fl AS (SELECT doc_id, 3 AS weight, string_split(trim({padded('title')}), ' ') AS w FROM art UNION ALL SELECT doc_id, 2, string_split(trim({padded('description')}), ' ') FROM art
  UNION ALL SELECT doc_id, 1, string_split(trim({padded('content')}), ' ') FROM art),
sz AS (SELECT DISTINCT len(string_split(term, ' ')) AS n FROM q WHERE term <> ''),
gr AS (SELECT DISTINCT doc_id, weight, array_to_string(w[s:s + n - 1], ' ') AS term
  FROM (SELECT doc_id, weight, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM fl, sz WHERE len(w) >= n))""") + """
SELECT doc_id, sector, query_idx, CAST(sum(weight) AS BIGINT) AS score FROM gr JOIN q USING (term) GROUP BY doc_id, sector, query_idx, term"""
add("search_many", MANY)
add("search_index", MANY)
add("expand_queries", """
WITH own(sector, queries) AS (VALUES ('S0', ['of the', 'orre']), ('S1', ['de la', 'und', '"und der"'])),
s AS (SELECT DISTINCT 'S' || (doc_id % 8) AS sector FROM documents),
q AS (SELECT s.sector, coalesce(queries, [s.sector]) AS qs FROM s LEFT JOIN own USING (sector)),
e AS (SELECT sector, CAST(i - 1 AS INTEGER) AS query_idx, qs[i] AS query
      FROM (SELECT sector, qs, unnest(range(1, len(qs) + 1)) AS i FROM q))
SELECT *, CASE WHEN contains(query, ' ') AND NOT (starts_with(query, '"') AND ends_with(query, '"'))
  THEN '"' || query || '"' ELSE query END AS quoted_query FROM e""")

PAGE_TEXT = rf"""
pt AS (
  SELECT *, {lines_of('main')} AS page_text FROM (
    SELECT *, CASE WHEN inn = '' THEN html ELSE inn END AS main FROM (
      SELECT page_id, url, html, regexp_extract(html, '(?is)<article\b[^>]*>(.*)</article\s*>', 1) AS inn FROM pages))
)"""
add("backfill_content", with_(ARTICLES, PAGE_TEXT, """
r AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN substr(content, 1, 150) ELSE content END AS content FROM art)""") + """
SELECT doc_id,
  CASE WHEN length(r.content) < 500 AND length(page_text) > length(r.content) THEN page_text ELSE r.content END AS content,
  coalesce(length(r.content) < 500 AND length(page_text) > length(r.content), false) AS backfilled
FROM r LEFT JOIN pt ON pt.page_id = r.doc_id""")

# ------------------------------------------------------------------ filters

add("require_fields", A + """
SELECT doc_id, title FROM (SELECT doc_id, url,
  CASE WHEN doc_id % 5 = 0 THEN '' WHEN doc_id % 7 = 0 THEN NULL ELSE title END AS title FROM art) WHERE title <> ''""")
add("lookback", A + """
SELECT doc_id FROM art WHERE CAST(published_ts AS DATE) BETWEEN DATE '2024-01-25' - 14 AND DATE '2024-01-25'""")
add("language", "SELECT doc_id, lang FROM documents WHERE lang = 'en'")
add("fresh", A + """
SELECT doc_id FROM art WHERE snapshot_ts > TIMESTAMP '2024-01-10 12:00:00' - INTERVAL 86400 SECOND
  AND snapshot_ts <= TIMESTAMP '2024-01-10 12:00:00'""")
add("valid_rows", A + "SELECT doc_id, url FROM art WHERE doc_id % 4 <> 0")
add("content_flags", A + f"""
SELECT doc_id, length(content) < 100 AS needs_refetch, length(content) < 200 AS needs_second_extractor,
  length(content) < 500 AS needs_full_text, {n_sents('content')} < 6 AS needs_more_sentences FROM art""")
add("drop_boilerplate", A + f"""
SELECT doc_id, CAST(len(k) AS BIGINT) AS n, array_to_string(k, ' ') AS kept
FROM (SELECT doc_id, {unboiled('content')} AS k FROM art)""")

SHOWN = f"""
sh AS (
  SELECT doc_id, CASE WHEN len(a) >= 3 THEN a WHEN len(b) >= 3 THEN b END AS k FROM (
    SELECT doc_id,
      {unboiled("CASE WHEN length(content) > length(summary) THEN content WHEN summary <> '' THEN summary ELSE 'No content available.' END")} AS a,
      {unboiled("CASE WHEN summary <> '' THEN summary ELSE content END")} AS b
    FROM src)
)"""
SRC = "src AS (SELECT doc_id, coalesce(description, '') AS summary, content FROM art)"
SHOW = f"{strip(chr(40) + 'array_to_string(k[1:15], ' + lit(' ') + ')' + chr(41))} || CASE WHEN len(k) > 15 THEN ' ...' ELSE '' END"
add("content_gate", with_(ARTICLES, SRC, SHOWN) + "SELECT doc_id, CAST(len(k) AS BIGINT) AS n FROM sh WHERE k IS NOT NULL")
add("display_content", with_(ARTICLES, SRC, SHOWN) + f"SELECT doc_id, {SHOW} AS shown FROM sh")

# ------------------------------------------------------------------ text

add("clean_text", f"SELECT doc_id, {clean('text', True)} AS cleaned FROM documents")
add("clean_pages", f"SELECT page_id, {clean('html', True)} AS cleaned FROM pages")
STOP = in_list(params.STOPWORDS)
add("remove_stopwords", f"""
SELECT doc_id, array_to_string([w for w in {words('text')} if lower(w) NOT IN {STOP}], ' ') AS kept FROM documents""")
add("split_sentences", f"""
SELECT doc_id, CAST(i - 1 AS BIGINT) AS pos, ss[i] AS sentence
FROM (SELECT doc_id, ss, unnest(range(1, len(ss) + 1)) AS i FROM (SELECT doc_id, {sents('text')} AS ss FROM documents))""")
add("count_sentences", f"SELECT doc_id, CAST({n_sents('text')} AS BIGINT) AS n FROM documents")
add("paragraphs", r"""
SELECT doc_id, CAST(i - 1 AS BIGINT) AS pos, ps[i] AS paragraph
FROM (SELECT doc_id, ps, unnest(range(1, len(ps) + 1)) AS i FROM (
  SELECT doc_id, string_split(replace(text, '.' || chr(10), '.' || chr(10) || chr(10)), chr(10) || chr(10)) AS ps FROM documents))""")


def enhanced(source: str, key: str) -> str:
    """CTEs from ``source(key, summary, content)`` to ``en(key, summary)``."""
    return rf"""
e1 AS (SELECT {key}, summary, content, i, {strip('ss[i]')} AS s FROM (
   SELECT *, unnest(range(1, len(ss) + 1)) AS i FROM (SELECT *, {sents('content')} AS ss FROM {source}))),
e2 AS (SELECT *, {wc('s')} AS n, string_split(regexp_replace(s, '[,;:][\s\x0b]+', chr(1), 'g'), chr(1)) AS parts FROM e1),
e3 AS (SELECT {key}, i, CASE WHEN n BETWEEN 5 AND 50 THEN [s]
   WHEN n > 50 AND len(parts) > 1 AND len([p for p in parts if {wc('p')} BETWEEN 5 AND 30]) = len(parts) THEN parts
   ELSE [] END AS k FROM e2),
e4 AS (SELECT {key}, flatten(list(k ORDER BY i)) AS kept FROM e3 GROUP BY {key}),
e5 AS (SELECT s.*, kept, array_to_string(kept, ' ') AS part FROM {source} s JOIN e4 USING ({key})),
e6 AS (SELECT *, {sents('substr(content, length(part) + 1, 1000)')} AS more,
   15 - len(string_split(part, '. ')) AS need,
   [p for p in string_split(content, chr(10) || chr(10)) if {wc('p')} > 10] AS paras,
   substr(content, 1, 2000) AS head FROM e5),
en AS (SELECT {key}, CASE
   WHEN content = '' THEN CASE WHEN length(summary) > 20 THEN summary ELSE {lit(params.NO_SUMMARY_TEXT)} END
   WHEN len(kept) >= 15 THEN array_to_string(kept[1:15], ' ')
   WHEN len(kept) > 0 THEN {strip("(part || ' ' || array_to_string(more[1:(CASE WHEN need >= 0 THEN need ELSE greatest(len(more) + need, 0) END)], ' '))")}
   WHEN len(paras) > 0 THEN array_to_string(paras[1:5], ' ')
   WHEN {rfind('head', '.')} > 500 THEN substr(head, 1, {rfind('head', '.')} + 1)
   ELSE head END AS summary FROM e6)"""


add("enhance_summary", with_(ARTICLES, SRC, enhanced("src", "doc_id")) + "SELECT doc_id, summary FROM en")
add("cut_at_sentence", f"""
WITH j AS (SELECT doc_id, array_to_string(({sents('text')})[1:15], ' ') AS t FROM documents),
h AS (SELECT doc_id, t, substr(t, 1, 1200) AS head FROM j)
SELECT doc_id, CASE WHEN length(t) <= 1200 THEN t WHEN {rfind('head', '.')} > 0
  THEN substr(head, 1, {rfind('head', '.')} + 1) ELSE head END AS cut FROM h""")
add("html_to_text", f"SELECT page_id, {lines_of('html')} AS body FROM pages")
add("quote_phrase", A + """
SELECT doc_id, CASE WHEN contains(title, ' ') AND NOT (starts_with(title, '"') AND ends_with(title, '"'))
  THEN '"' || title || '"' ELSE title END AS quoted FROM art""")
add("slug", A + rf"""
SELECT doc_id, lower(replace(regexp_replace({strip('title')}, '[^\p{{L}}\p{{N}} _-]', '_', 'g'), ' ', '_')) AS slug,
  replace(lower(title), ' ', '_') AS cache_key FROM art""")

# ------------------------------------------------------------------ fields

add("source_name", "SELECT doc_id, CASE WHEN doc_id % 3 = 2 THEN 'Unknown' ELSE trim(source) END AS source_name FROM documents")
add("source_line", A + "SELECT doc_id, upper(source_name || ' • ' || substr(published_raw, 1, 10)) AS line FROM art")
add("issue_label", A + "SELECT doc_id, 'ISSUE • ' || strftime(published_ts, '%B %d, %Y') AS label FROM art")
add("preview_cards", A + f"""
SELECT sector, doc_id, url, source_name,
  CASE WHEN doc_id % 10 IN (1, 2) OR {strip('title')} = '' THEN 'Untitled Article' ELSE {strip('title')} END AS preview_title,
  CASE WHEN doc_id % 10 = 3 OR d = '' THEN 'No description available'
       WHEN length(d) > 200 THEN substr(d, 1, 197) || '...' ELSE d END AS preview_description,
  CASE doc_id % 10 WHEN 4 THEN 'yesterday' WHEN 5 THEN 'Date not available'
       ELSE strftime(published_ts, '%B %d, %Y %H:%M') END AS preview_date,
  true AS has_content
FROM (SELECT *, {strip('description')} AS d FROM art)""")
add("deck_articles", A + """
SELECT doc_id, sector, title, source_name AS source, substr(published_raw, 1, 10) AS date, description AS summary,
  sector AS categories FROM art""")
_icon, _blurb = params.SECTOR_META["Supply Chain"]
add("sector_meta", A + f"""
SELECT s AS sector, doc_id, CASE WHEN s = 'Supply Chain' THEN {lit(_icon)} ELSE {lit(params.DEFAULT_ICON)} END AS sector_icon,
  CASE WHEN s = 'Supply Chain' THEN {lit(_blurb)} ELSE {lit(params.DEFAULT_BLURB_PREFIX)} || s END AS sector_description
FROM (SELECT doc_id, CASE WHEN sector = 'S3' THEN 'Supply Chain' ELSE sector END AS s FROM art)""")

# ------------------------------------------------------------------ enrichment

_tax = ", ".join(f"({lit(c)}, {i}, {lit(t)})" for i, (c, ts) in enumerate(T.TAXONOMY.items()) for t in ts)
CATS = f"""
tax(category, ord, term) AS (VALUES {_tax}),
pads AS (SELECT doc_id, {padded('text')} AS p FROM documents),
hit AS (SELECT DISTINCT doc_id, ord, category FROM pads, tax WHERE contains(p, ' ' || term || ' ')),
cat AS (SELECT d.doc_id, coalesce(list(category ORDER BY ord) FILTER (category IS NOT NULL), []) AS cats
        FROM documents d LEFT JOIN hit USING (doc_id) GROUP BY d.doc_id)"""
add("match_categories", with_(CATS) + "SELECT doc_id, array_to_string(cats, '|') AS categories FROM cat")
_RUNS = """
run AS (SELECT doc_id, array_to_string(w[k:k + 1], ' ') AS run FROM pads, (SELECT unnest([1, 3, 5, 7, 9, 11]) AS k) WHERE len(w) >= k AND array_to_string(w[k:k + 1], ' ') <> ''),
gr AS (SELECT doc_id, array_to_string(w[s:s + n - 1], ' ') AS run, s FROM (
  SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM pads, (SELECT unnest([1, 2]) AS n) WHERE len(w) >= n))"""
add("match_categories_large", with_(ARTICLES, f"""
pads AS (SELECT doc_id, string_split(trim({padded('content')}), ' ') AS w FROM art)""", _RUNS, """
tax AS (SELECT 'c' || (doc_id % 89) AS category, run, doc_id % 7 AS ord FROM run),
rk AS (SELECT category, min((ord, run)) AS rank FROM tax GROUP BY category),
hit AS (SELECT DISTINCT doc_id, category, rank FROM gr JOIN tax USING (run) JOIN rk USING (category))""") + """
SELECT doc_id, coalesce(string_agg(category, '|' ORDER BY rank, category), '') AS categories FROM art LEFT JOIN hit USING (doc_id) GROUP BY doc_id""")
add("match_entities_large", with_(ARTICLES, r"""
pads AS (SELECT doc_id, regexp_extract_all(content, '[\p{L}\p{N}]+') AS w FROM art)""", _RUNS, f"""
dict AS (SELECT DISTINCT run, ({sql_list(params.ENTITY_LABELS)})[length(run) % {len(params.ENTITY_LABELS)} + 1] AS label FROM run),
men AS (SELECT doc_id, label, run, min(s) AS pos FROM gr JOIN dict USING (run) GROUP BY ALL)""") + """
SELECT doc_id, label, string_agg(run, '|' ORDER BY pos, run) AS names FROM men GROUP BY doc_id, label""")
add("primary_category", with_(CATS) + "SELECT doc_id, coalesce(cats[1], 'other') AS primary_category FROM cat")

_ents = ", ".join(f"({lit(s)}, {lit(l)}, {s.count(' ') + 1})" for s, l in T.ENTITIES.items())


def mentions(source: str, keys: str) -> str:
    """CTE ``men(keys, pos, surface, label)`` of dictionary mentions in ``source(keys, text)``."""
    return rf"""
dict(surface, label, n) AS (VALUES {_ents}),
tok AS (SELECT {keys}, regexp_extract_all(text, '[\p{{L}}\p{{N}}]+') AS t FROM {source}),
tk AS (SELECT {keys}, generate_subscripts(t, 1) AS pos, unnest(t) AS w FROM tok),
tw AS (SELECT *, w || ' ' || lead(w) OVER (PARTITION BY {keys} ORDER BY pos) AS w2 FROM tk),
men AS (SELECT {keys}, pos, surface, label FROM tw JOIN dict ON n = 1 AND w = surface
  UNION ALL SELECT {keys}, pos, surface, label FROM tw JOIN dict ON n = 2 AND w2 = surface)"""


ENT = mentions("documents", "doc_id") + """,
ent AS (SELECT doc_id, label, list(surface ORDER BY p) AS names FROM
  (SELECT doc_id, label, surface, min(pos) AS p FROM men GROUP BY ALL) GROUP BY ALL)"""
add("match_entities", with_(ENT) + "SELECT doc_id, label, array_to_string(names, '|') AS names FROM ent")
ENT3 = """
e3 AS (SELECT d.doc_id, coalesce(max(names) FILTER (label = 'ORG'), []) AS org,
  coalesce(max(names) FILTER (label = 'PERSON'), []) AS person, coalesce(max(names) FILTER (label = 'GPE'), []) AS gpe
  FROM documents d LEFT JOIN ent USING (doc_id) GROUP BY d.doc_id)"""
add("entity_line", with_(ENT, ENT3) + """
SELECT doc_id, concat_ws(' | ',
  CASE WHEN len(org) > 0 THEN 'Organizations: ' || array_to_string(org[1:3], ', ') END,
  CASE WHEN len(person) > 0 THEN 'People: ' || array_to_string(person[1:3], ', ') END,
  CASE WHEN len(gpe) > 0 THEN 'Locations: ' || array_to_string(gpe[1:3], ', ') END) AS line FROM e3""")
add("tags", with_(CATS) + """
SELECT doc_id, upper(cats[1]) AS tag,
  array_to_string([upper(c) || ':' || printf('%.2f', least(1.5, 0.15 * length(c))) for c in cats[1:2]], '|') AS tags FROM cat""")
add("mine_entities", r"""
SELECT surface, count(*) AS doc_count FROM (
  SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '\p{Lu}[\p{L}\p{N}]+(?: \p{Lu}[\p{L}\p{N}]+)*')) AS surface FROM documents)
GROUP BY surface HAVING count(*) >= 2""")
_lem = "CASE w " + " ".join(f"WHEN {lit(k)} THEN {lit(v)}" for k, v in T.LEMMAS.items()) + " ELSE w END"


def lemmas(c: str) -> str:
    return f"array_to_string([{_lem} for w in {words(c)} if w NOT IN {STOP}], ' ')"


add("lemmatize", f"SELECT doc_id, {lemmas('c')} AS lemmatized_content FROM (SELECT doc_id, {clean('text', True)} AS c FROM documents)")
add("clean_articles", A + f"""
SELECT doc_id, {clean('title', True)} AS cleaned_title, {clean('description', True)} AS cleaned_description, c AS cleaned_content,
  array_to_string([w for w in {words('c')} if w NOT IN {STOP}], ' ') AS content_no_stopwords, {lemmas('c')} AS lemmatized_content
FROM (SELECT *, {clean('content', True)} AS c FROM art)""")


def sentence_rows(source: str, text: str, signals, with_entities: bool = True) -> str:
    """CTEs from ``source(doc_id, text)`` to ``sr(doc_id, i, s, w, start, score)``."""
    ent = f"""
smen AS (SELECT doc_id, i, count(*) AS k FROM men GROUP BY ALL),""" if with_entities else """
smen AS (SELECT 0 AS doc_id, 0 AS i, 0 AS k WHERE false),"""
    men = (mentions("(SELECT doc_id, i, s AS text FROM sn)", "doc_id, i") + ",") if with_entities else ""
    return rf"""
sn AS (SELECT doc_id, i, ss[i] AS s, len(ss) AS n, {wc('ss[i]')} AS w FROM (
  SELECT doc_id, ss, unnest(range(1, len(ss) + 1)) AS i FROM (SELECT doc_id, {sents(text)} AS ss FROM {source}))),
{men}{ent}
st AS (SELECT *, coalesce(sum(w) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start,
  len([t for t in regexp_extract_all(lower(s), '[\p{{L}}\p{{N}}]+') if t IN {in_list(signals)}]) AS sig FROM sn),
sr AS (SELECT doc_id, i, trim(s) AS s, w, start, (coalesce(k, 0) * 0.5::DOUBLE + sig + (1.5::DOUBLE - abs(start::DOUBLE / n - 0.5::DOUBLE))) * w AS score
  FROM st LEFT JOIN smen USING (doc_id, i))"""


def summary_from(source: str, text: str) -> str:
    """CTE ``sm(doc_id, summary)`` from ``sr``."""
    return rf"""
best AS (SELECT * FROM sr QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, i) <= 8),
chosen AS (SELECT doc_id, string_agg(s, ' ' ORDER BY i) AS c FROM best GROUP BY doc_id),
firsts AS (SELECT doc_id, string_agg(s, ' ' ORDER BY i) AS f FROM sr WHERE i <= 5 GROUP BY doc_id),
sm AS (SELECT a.doc_id, CASE WHEN {text} = '' THEN '' WHEN {wc('c')} < 50 AND {wc(text)} > 100 THEN f ELSE c END AS summary
  FROM {source} a JOIN chosen USING (doc_id) JOIN firsts USING (doc_id))"""


add("sentence_table", with_(sentence_rows("documents", "text", T.SIGNALS)) + """
SELECT doc_id, CAST(i - 1 AS BIGINT) AS pos, CAST(w AS BIGINT) AS words, start AS tok_start, round(score, 9) AS score FROM sr""")
add("sentence_profile", f"""
SELECT sector, CAST(count(*) FILTER (n < 5) AS BIGINT) AS short_sentences, CAST(count(*) FILTER (n > 50) AS BIGINT) AS long_sentences,
  CAST(count(*) FILTER (n BETWEEN 5 AND 50) AS BIGINT) AS kept_sentences
FROM (SELECT sector, {wc('s')} AS n FROM (SELECT 'S' || (doc_id % 8) AS sector, unnest({sents('text')}) AS s FROM documents))
GROUP BY sector""")
add("summarize", with_(sentence_rows("documents", "text", T.SIGNALS), summary_from("documents", "text")) + "SELECT doc_id, summary FROM sm")


def phrase_rows(source: str, text: str, signals, extra: str = "") -> str:
    """CTEs from ``source(doc_id, text)`` to ``ps(doc_id, phrase, n, first_pos, score)``."""
    bonus = " OR ".join(f"contains(phrase, {lit(s)})" for s in signals)
    return rf"""
pt0 AS (SELECT doc_id, lower({text}) AS low, string_split(trim({padded(text)}), ' ') AS toks FROM {source}),
pr AS (SELECT doc_id, low, unnest([trim(r) for r in string_split(array_to_string(
   [CASE WHEN t IN {STOP} OR regexp_matches(t, '^[^\p{{L}}\p{{N}}]') THEN '|' ELSE t END for t in toks], ' '), '|')]) AS phrase FROM pt0),
pf AS (SELECT doc_id, phrase FROM pr WHERE phrase <> '' {extra}),
pc AS (SELECT doc_id, phrase, count(*) AS n FROM pf GROUP BY ALL),
pn AS (SELECT pc.*, sum(n) OVER (PARTITION BY pc.doc_id) AS total, strpos(low, phrase) - 1 AS first_pos, length(low) AS len
  FROM pc JOIN pt0 USING (doc_id)),
ps AS (SELECT doc_id, phrase, n, first_pos, round(n::DOUBLE / total::DOUBLE * (1.0::DOUBLE + len(string_split(phrase, ' ')) * 0.2::DOUBLE)
   * CASE WHEN first_pos >= 0 THEN 1.5::DOUBLE - first_pos::DOUBLE / len ELSE 1.0::DOUBLE END
   * CASE WHEN {bonus} THEN 1.5::DOUBLE ELSE 1.0::DOUBLE END, 9) AS score FROM pn)"""


KEY = """
kp AS (SELECT doc_id, pos, phrase, CASE WHEN mx > 0 THEN score / mx ELSE score END AS score FROM (
  SELECT *, row_number() OVER w AS pos, max(score) OVER (PARTITION BY doc_id) AS mx FROM ps
  WINDOW w AS (PARTITION BY doc_id ORDER BY score DESC, first_pos, phrase)) WHERE pos <= 8)"""
add("phrase_table", with_(phrase_rows("documents", "text", T.PHRASE_SIGNALS)) + """
SELECT doc_id, phrase, n, first_pos, round(score, 9) AS score, round(n::DOUBLE / sum(n) OVER (PARTITION BY doc_id)::DOUBLE, 9) AS tf FROM ps""")
add("key_phrases", with_(phrase_rows("documents", "text", params.PHRASE_SIGNALS), KEY) + """
SELECT doc_id, pos, phrase, round(score, 9) AS score FROM kp""")
_lab = in_list(params.PHRASE_ENTITY_LABELS)
EXTRA = f"UNION ALL SELECT doc_id, lower(surface) FROM men WHERE label IN {_lab}"
add("key_phrases_with_entities", with_(mentions("documents", "doc_id"), phrase_rows("documents", "text", params.PHRASE_SIGNALS, EXTRA), KEY) + """
SELECT doc_id, pos, phrase, round(score, 9) AS score FROM kp""")
add("phrase_idf", with_("src AS (SELECT min(doc_id) AS doc_id, text FROM documents GROUP BY text)", phrase_rows("src", "text", params.PHRASE_SIGNALS)) + """
SELECT phrase, count(DISTINCT doc_id) AS doc_count, round(ln((SELECT count(*) FROM src)::DOUBLE / count(DISTINCT doc_id)), 9) AS idf
FROM pf GROUP BY phrase""")
_terms = f"SELECT 'S' || (doc_id % 8) AS sector, unnest({words(clean('text', True))}) AS term FROM documents"
add("term_frequencies", f"""
SELECT term, count(*) AS frequency FROM ({_terms}) WHERE term NOT IN {STOP} GROUP BY term ORDER BY frequency DESC, term LIMIT 100""")
add("term_frequencies_by_sector", f"""
SELECT sector, term, count(*) AS frequency FROM ({_terms}) WHERE term NOT IN {STOP} GROUP BY sector, term
QUALIFY row_number() OVER (PARTITION BY sector ORDER BY frequency DESC, term) <= 20""")

MEAN3 = "k3 AS (SELECT doc_id, (coalesce(max(score) FILTER (pos = 1), 0) + coalesce(max(score) FILTER (pos = 2), 0) + coalesce(max(score) FILTER (pos = 3), 0)) / count(*) AS m FROM kp WHERE pos <= 3 GROUP BY doc_id)"
BASE = "(CASE WHEN len(cats) > 0 THEN 0.3::DOUBLE ELSE 0 END + coalesce(0.2::DOUBLE * m, 0))"
BOOST = "(CASE WHEN len(org) > 0 THEN 0.2::DOUBLE ELSE 0 END + CASE WHEN len(person) > 0 THEN 0.1::DOUBLE ELSE 0 END + CASE WHEN len(gpe) > 0 THEN 0.1::DOUBLE ELSE 0 END)"
add("relevance_score", with_(CATS, ENT, ENT3, phrase_rows("documents", "text", params.PHRASE_SIGNALS), KEY, MEAN3) + f"""
SELECT doc_id, round(least(1.0::DOUBLE, {BASE} + {BOOST}), 9) AS relevance, round(least(1.0::DOUBLE, {BASE}), 9) AS first_pass
FROM cat JOIN e3 USING (doc_id) LEFT JOIN k3 USING (doc_id)""")
POINTS = "pts AS (SELECT doc_id, string_agg(phrase, '|' ORDER BY pos) FILTER (pos <= 5) AS key_points FROM kp GROUP BY doc_id)"
add("insight_records", with_(CATS, ENT, ENT3, phrase_rows("documents", "text", params.PHRASE_SIGNALS, EXTRA), KEY, MEAN3, POINTS) + f"""
SELECT doc_id, array_to_string(cats, '|') AS categories, coalesce(cats[1], 'other') AS primary_category,
  round(least(1.0::DOUBLE, {BASE} + {BOOST}), 9) AS relevance, coalesce(key_points, '') AS key_points,
  array_to_string(org[1:5], '|') AS organizations, array_to_string(person[1:3], '|') AS people, array_to_string(gpe[1:3], '|') AS locations
FROM cat JOIN e3 USING (doc_id) LEFT JOIN k3 USING (doc_id) LEFT JOIN pts USING (doc_id)""")

# ------------------------------------------------------------------ deck

COUNTS = """
cc AS (SELECT category, count(*) AS n, min((doc_id, i)) AS first_seen FROM (
  SELECT doc_id, unnest(cs) AS category, generate_subscripts(cs, 1) AS i FROM (
    SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN ['Other'] ELSE cats END AS cs FROM cat)) GROUP BY category)"""
add("category_counts", with_(CATS, COUNTS) + "SELECT category, n FROM cc")
_cols = sql_list(params.BAR_COLOURS)
add("category_bars", with_(CATS, COUNTS) + f"""
SELECT bar_no, category, n, round(n::DOUBLE / mx * 6.0::DOUBLE, 9) AS bar_inches, ({_cols})[(bar_no - 1) % 5 + 1] AS colour, bar_no <= 5 AS in_legend
FROM (SELECT *, row_number() OVER (ORDER BY first_seen) AS bar_no, max(n) OVER () AS mx FROM cc) WHERE bar_no <= 6""")
add("by_sector", """
WITH s AS (SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN 'General' ELSE 'S' || (doc_id % 8) END AS sector FROM documents),
f AS (SELECT sector, row_number() OVER (ORDER BY min(doc_id)) AS sector_ord FROM s GROUP BY sector)
SELECT doc_id, sector, sector_ord FROM s JOIN f USING (sector)""")
add("sector_stats", A + f"""
SELECT sector, count(*) AS articles, CAST(count(*) FILTER (b < 6) AS BIGINT) AS thin_articles, CAST(sum(b) AS BIGINT) AS sentences_before, CAST(sum(a) AS BIGINT) AS sentences_after
FROM (SELECT sector, {n_sents('description')} AS b, {n_sents('content')} AS a FROM art) GROUP BY sector
UNION ALL SELECT 'S-none', 0, 0, 0, 0""")


def layout(per: int) -> str:
    slots = params.TWO_UP_SLOTS if per == 2 else params.ONE_UP_SLOTS
    boxes = ", ".join(f"({i}, {l}::DOUBLE, {t}::DOUBLE, {w}::DOUBLE, {h}::DOUBLE)" for i, (l, t, w, h) in enumerate(slots))
    return f"""
box(slot, "left", top, width, height) AS (VALUES {boxes}),
dr AS (SELECT doc_id, 'S' || (doc_id % 8) AS sector FROM documents),
ns AS (SELECT sector, count(*) AS n, min(doc_id) AS f FROM dr GROUP BY sector),
ls AS (SELECT sector, 2 + coalesce(sum(1 + (n + {per} - 1) // {per}) OVER (ORDER BY f ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS section_slide,
  1 + sum(1 + (n + {per} - 1) // {per}) OVER (ORDER BY f) AS last_slide FROM ns),
ly AS (SELECT doc_id, sector, idx, CAST(section_slide + 1 + idx // {per} AS BIGINT) AS slide_no, slot, b."left", b.top, b.width, b.height
  FROM (SELECT *, row_number() OVER (PARTITION BY sector ORDER BY doc_id) - 1 AS idx FROM dr) JOIN ls USING (sector)
  JOIN box b ON b.slot = idx % {per})"""


for _per in (1, 2):
    add(f"deck_layout_{_per}", with_(layout(_per)) + 'SELECT doc_id, sector, idx, slide_no, CAST(slot AS BIGINT) AS slot, "left", top, width, height FROM ly')
add("deck_outline", with_(layout(2)) + """
SELECT CAST(1 AS BIGINT) AS slide_no, 'title' AS kind, 'Weekly Newsletter' AS heading
UNION ALL SELECT CAST(section_slide AS BIGINT), 'section', upper(sector) FROM ls
UNION ALL SELECT CAST(max(last_slide) + 1 AS BIGINT), 'summary', 'Summary' FROM ls""")

# gaps and pools as bounded sets; each gap takes the candidate of its turn
FILL = with_(ARTICLES, SRC, SHOWN, """
dk AS (SELECT doc_id, sector, url, k IS NOT NULL AS accepted,
   CASE doc_id % 3 WHEN 0 THEN 'newsapi' WHEN 1 THEN 'gnews' ELSE 'any' END AS want FROM art JOIN sh USING (doc_id)),
p5 AS (SELECT sector, provider, provider_rank, url || '#alt' AS new_url, k FROM art JOIN sh USING (doc_id)
   QUALIFY row_number() OVER (PARTITION BY sector, provider ORDER BY provider_rank) <= 5),
pk AS (SELECT * FROM p5 WHERE k IS NOT NULL AND NOT EXISTS (SELECT 1 FROM dk WHERE dk.sector = p5.sector AND dk.url = p5.new_url)
   QUALIFY row_number() OVER (PARTITION BY sector, new_url ORDER BY CASE provider WHEN 'newsapi' THEN 0 ELSE 1 END, provider_rank) = 1),
pool AS (SELECT *, row_number() OVER (PARTITION BY sector, provider ORDER BY provider_rank) AS r FROM pk),
gap AS (SELECT *, row_number() OVER (PARTITION BY sector, want ORDER BY doc_id) AS g FROM dk WHERE NOT accepted),
m1 AS (SELECT gap.doc_id, gap.sector, gap.url, new_url, provider AS new_provider, k FROM gap JOIN pool ON pool.sector = gap.sector AND pool.provider = gap.want AND pool.r = gap.g),
left_over AS (SELECT *, row_number() OVER (PARTITION BY sector ORDER BY CASE provider WHEN 'newsapi' THEN 0 ELSE 1 END, provider_rank) AS r2
   FROM pool WHERE NOT EXISTS (SELECT 1 FROM m1 WHERE m1.sector = pool.sector AND m1.new_url = pool.new_url)),
fs AS (SELECT * FROM m1 UNION ALL
   SELECT gap.doc_id, gap.sector, gap.url, new_url, provider, k FROM gap JOIN left_over l ON l.sector = gap.sector AND gap.want = 'any' AND l.r2 = gap.g)""")
add("fill_slots", FILL + "SELECT doc_id, sector, url, new_url, new_provider FROM fs")
# gaps of the sector General choose one after the other
add("fill_slots_general", with_(ARTICLES, SRC, SHOWN, f"""
dk AS (SELECT doc_id, CASE WHEN doc_id % 8 < 3 THEN 'General' ELSE sector END AS sector, url, k IS NOT NULL AND doc_id % 3 <> 0 AS accepted,
   array_to_string((string_split(title, ' '))[1:2], ' ') AS title,
   CASE doc_id % 3 WHEN 0 THEN ['newsapi'] WHEN 1 THEN ['gnews'] ELSE ['newsapi', 'gnews'] END AS want FROM art JOIN sh USING (doc_id)),
gap AS (SELECT *, trim({padded('title')}) AS term, row_number() OVER (ORDER BY doc_id) AS turn FROM dk WHERE sector = 'General' AND NOT accepted AND title <> ''),
pads AS MATERIALIZED (SELECT doc_id, {padded('title')} AS t, {padded('description')} AS d, {padded('content')} AS c FROM art),
terms AS (SELECT DISTINCT term, ' ' || term || ' ' AS held FROM gap WHERE term <> ''),
hs AS MATERIALIZED (SELECT term, doc_id, 3 * contains(t, held)::INT + 2 * contains(d, held)::INT + contains(c, held)::INT AS score FROM pads, terms
  WHERE contains(t, held) OR contains(d, held) OR contains(c, held)),
hit AS (SELECT turn, hs.doc_id AS c, score FROM gap JOIN hs USING (term)),
best AS (SELECT hit.turn, provider, art.url || '#alt' AS new_url, sh.k, row_number() OVER (PARTITION BY hit.turn, provider ORDER BY score DESC, provider_rank) AS r
  FROM hit JOIN art ON art.doc_id = c JOIN sh ON sh.doc_id = c QUALIFY r <= 5),
ok AS (SELECT best.turn, provider, new_url, r FROM best JOIN gap USING (turn) WHERE best.k IS NOT NULL AND list_contains(want, provider)
  AND NOT EXISTS (SELECT 1 FROM dk WHERE dk.sector = 'General' AND dk.url = new_url)),
wish AS MATERIALIZED (SELECT turn, list(new_url ORDER BY provider DESC, r) AS urls, list(provider ORDER BY provider DESC, r) AS providers FROM ok GROUP BY turn)""").replace("WITH ", "WITH RECURSIVE ", 1) + """,
each AS MATERIALIZED (SELECT gap.turn, coalesce(urls, []) AS urls FROM gap LEFT JOIN wish USING (turn)),
go(turn, used, pick) AS (SELECT 0::BIGINT, []::VARCHAR[], NULL::VARCHAR UNION ALL
  SELECT each.turn, CASE WHEN p IS NULL THEN used ELSE list_append(used, p) END, p
  FROM (SELECT go.turn + 1 AS next, used FROM go) g JOIN each ON each.turn = g.next, LATERAL (SELECT list_filter(each.urls, lambda u: NOT list_contains(used, u))[1] AS p))
SELECT doc_id, sector, url, pick AS new_url, providers[list_position(urls, pick)] AS new_provider FROM go JOIN gap USING (turn) JOIN wish USING (turn) WHERE pick IS NOT NULL""")
add("digest_summary", with_(ARTICLES, DEDUP, top(5), """
comb AS (SELECT sector, string_agg(CASE WHEN coalesce(description, '') <> '' THEN description ELSE content END, chr(10) ORDER BY deck_pos) AS content
  FROM top WHERE coalesce(description, '') <> '' OR content <> '' GROUP BY sector),
src AS (SELECT sector, content AS summary, content FROM comb)""", enhanced("src", "sector")) + "SELECT sector, summary AS digest_summary FROM en")
add("digest_summary_all", with_(ARTICLES, DEDUP, top(1_000_000_000), """
comb AS (SELECT sector, string_agg(CASE WHEN coalesce(description, '') <> '' THEN description ELSE content END, chr(10) ORDER BY deck_pos) AS content
  FROM top WHERE coalesce(description, '') <> '' OR content <> '' GROUP BY sector),
src AS (SELECT sector, content AS summary, content FROM comb)""", enhanced("src", "sector")) + "SELECT sector, summary AS digest_summary FROM en")
add("issue_summary", with_(ARTICLES, DEDUP, """
so AS (SELECT sector, row_number() OVER (ORDER BY min((query_idx, provider_idx, provider_rank)), sector) AS o FROM ded GROUP BY sector),
src AS (SELECT 'issue' AS issue, content AS summary, content FROM (
  SELECT string_agg(CASE WHEN coalesce(description, '') <> '' THEN description ELSE content END, chr(10) ORDER BY o, query_idx, provider_idx, provider_rank) AS content
  FROM ded JOIN so USING (sector) WHERE coalesce(description, '') <> '' OR content <> ''))""", enhanced("src", "issue")) + "SELECT summary AS digest_summary FROM en")
add("digest_summary_odd", with_("""
odd AS (SELECT doc_id, 'S' || (doc_id % 8) AS sector, CASE doc_id % 8
   WHEN 1 THEN translate(text, '.!?', '') WHEN 2 THEN substr(text, 1, 60) WHEN 3 THEN replace(translate(text, '!?', ''), '. ', chr(10) || chr(10))
   WHEN 4 THEN array_to_string(string_split(text, ' ')[1:4], ' ') || '.'
   WHEN 5 THEN CASE WHEN doc_id % 80 <> 5 THEN substr(text, 1, 5) || '!' || chr(10) ELSE text END ELSE text END AS t FROM documents),
comb AS (SELECT sector, string_agg(t, chr(10) ORDER BY doc_id) AS content FROM odd WHERE t <> '' GROUP BY sector),
src AS (SELECT sector, content AS summary, content FROM comb)""", enhanced("src", "sector")) + "SELECT sector, summary AS digest_summary FROM en")

# ------------------------------------------------------------------ pages and providers

add("normalize_pages", with_(PAGE_TEXT) + rf"""
SELECT page_id, url, {strip(unescape(untag(r"regexp_extract(html, '(?is)<title\b[^>]*>(.*?)</title\s*>', 1)", '')))} AS title, page_text AS content,
  regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1) AS source_name,
  CASE WHEN regexp_extract(html, '(?is)<html\b[^>]*\blang\s*=\s*"([^"]*)"', 1) = '' THEN 'en' ELSE regexp_extract(html, '(?is)<html\b[^>]*\blang\s*=\s*"([^"]*)"', 1) END AS lang,
  '' AS description FROM pt""")
add("page_metadata", r"""
SELECT doc_id, 'http://s.example/A' || doc_id AS url, 'T A' || doc_id AS title,
  trim(regexp_replace(translate(substr(text, 1, 200), '<>&' || chr(10), '    ') || 'inner end', '\s+', ' ', 'g')) AS content,
  CASE WHEN doc_id % 5 = 4 THEN '' ELSE 'about ' || source || ' A' || doc_id END AS description, 's.example' AS source_name,
  CASE WHEN doc_id % 5 = 4 THEN 'en' ELSE 'fr' END AS lang, '2024-01-02' AS published_raw, 'A' || doc_id || ' & co' AS authors,
  'x|A' || doc_id || '|y' AS keywords, 'http://i/A' || doc_id || '?a=b' AS image_url FROM documents""")
NEWSAPI = """
na AS (SELECT doc_id // 10 AS request_id, CAST(doc_id % 10 AS BIGINT) AS provider_rank, url, title, published_raw, source_name, doc_id, content, description
  FROM art WHERE (doc_id // 10) % 7 <> 0)"""
add("read_provider_responses", with_(ARTICLES, NEWSAPI) + """
SELECT request_id, provider_rank, url, title,
  CASE WHEN doc_id % 4 <> 3 THEN '{"id":"id","name":"' || source_name || '"}' END AS source,
  CASE WHEN doc_id % 2 = 0 THEN published_raw END AS "publishedAt" FROM na""")
add("normalize_newsapi", with_(ARTICLES, NEWSAPI) + """
SELECT request_id, provider_rank, url, title, CASE WHEN doc_id % 4 <> 3 THEN source_name ELSE 'Unknown' END AS source_name,
  '' AS image_url, CASE WHEN doc_id % 2 = 0 THEN published_raw ELSE '2024-06-01T00:00:00' END AS published_raw FROM na""")
GNEWS = f"""
gn AS (SELECT doc_id // 10 AS request_id, CAST(doc_id % 10 AS BIGINT) AS provider_rank, url, {strip('title')} AS title, published_raw, source_name, content, description
  FROM art WHERE (doc_id // 10) % 9 <> 0 AND doc_id % 5 <> 0 AND doc_id % 6 <> 0 AND {strip('title')} <> '')"""
add("normalize_gnews", with_(ARTICLES, GNEWS) + """
SELECT request_id, provider_rank, url, title, source_name, 'img' AS image_url, published_raw FROM gn""")
FILINGS = """
fl AS (SELECT doc_id // 10 AS request_id, doc_id AS provider_rank, published_raw,
  CASE WHEN doc_id % 3 = 0 THEN 'Unknown Company' ELSE upper(source_name) END AS company,
  CASE doc_id % 3 WHEN 0 THEN 'Filing' WHEN 1 THEN '10-K' ELSE '8-K' END AS filing_type FROM art)"""
add("normalize_filings", with_(ARTICLES, FILINGS) + """
SELECT request_id, provider_rank, company || ' - ' || filing_type AS title, 'https://f.example/' || provider_rank || '.txt' AS url,
  'SEC EDGAR' AS source_name, published_raw, filing_type || ' filing from ' || company AS description, company, filing_type FROM fl""")

# ------------------------------------------------------------------ sources and sinks

add("read_snapshots", A + """
SELECT sector, url, row_number() OVER (PARTITION BY sector, snapshot_ts ORDER BY doc_id) - 1 AS provider_rank, source_name, title,
  strftime(published_ts, '%Y-%m-%d %H:%M:%S') AS published, strftime(snapshot_ts, '%Y-%m-%d') AS snapshot_day FROM art""")
add("bad_snapshots", A + """
SELECT sector AS file, CASE WHEN sector IN ('S3', 'S5', 'S6') THEN 1 ELSE count(*) END AS n,
  CASE sector WHEN 'S3' THEN 'unreadable' WHEN 'S5' THEN 'empty' WHEN 'S6' THEN 'no sector' ELSE 'read' END AS reason FROM art GROUP BY sector""")
add("stream_bad_snapshots", A + """
SELECT DISTINCT sector AS file, CASE sector WHEN 'S3' THEN 'unreadable' ELSE 'no sector' END AS reason FROM art WHERE sector IN ('S3', 'S6')""")
add("write_snapshot", A + """
SELECT doc_id, sector, strftime(published_ts, '%Y-%m-01') AS snapshot_day FROM art
WHERE NOT (sector IN ('S0', 'S1') AND published_ts < TIMESTAMP '2024-02-01' AND doc_id % 16 >= 8)""")
add("archive_roundtrip", A + """
SELECT title, url, source_name AS source, published_raw AS published_at, provider, '2024-06-01T00:00:00' AS fetched_at, '1.0' AS version FROM art""")
add("write_digest", A + "SELECT doc_id, title, unnest(['2024-06-01', '2024-06-08']) AS issue FROM art")

# ------------------------------------------------------------------ streams

add("stream_snapshots", A + """
SELECT sector, url, row_number() OVER (PARTITION BY sector, snapshot_ts ORDER BY doc_id) - 1 AS provider_rank, source_name, title FROM art""")
add("stream_dedup", A + "SELECT DISTINCT sector, url FROM art")
add("stream_category_counts", with_(ARTICLES, CATS) + """
SELECT strftime(d, '%Y-%m-%d') AS day, category, count(*) AS n FROM (
  SELECT date_trunc('day', published_ts)::TIMESTAMP AS d, unnest(cats) AS category FROM art JOIN cat USING (doc_id))
WHERE d + INTERVAL 1 DAY <= (SELECT max(published_ts) FROM art) - INTERVAL 1 DAY GROUP BY ALL""")
add("stream_event_counts", """
SELECT strftime(d, '%Y-%m-%d') AS day, event_type AS category, count(*) AS n FROM (
  SELECT date_trunc('day', ts)::TIMESTAMP AS d, event_type FROM events)
WHERE d + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 1 DAY GROUP BY ALL""")
add("stream_category_counts_all", with_(ARTICLES, CATS) + """
SELECT strftime(d, '%Y-%m-%d') AS day, category, count(*) AS n FROM (
  SELECT date_trunc('day', published_ts)::TIMESTAMP AS d, unnest(cats) AS category FROM art JOIN cat USING (doc_id)) GROUP BY ALL""")
add("stream_event_counts_all", """
SELECT strftime(ts, '%Y-%m-%d') AS day, event_type AS category, count(*) AS n FROM events GROUP BY ALL""")
add("stream_enrich", with_(ARTICLES, CATS) + """
SELECT sector, url, doc_id, coalesce(cats[1], 'other') AS primary_category FROM art JOIN cat USING (doc_id)
QUALIFY row_number() OVER (PARTITION BY sector, url ORDER BY published_ts, provider_rank) = 1""")

# ------------------------------------------------------------------ pipelines

add("build_digest", with_(ARTICLES, PAGE_TEXT, f"""
ch AS (SELECT *, row_number() OVER (PARTITION BY sector ORDER BY query_idx, provider_idx, provider_rank) AS deck_pos
  FROM (SELECT * REPLACE (CASE WHEN doc_id % 3 = 0 THEN substr(content, 1, 120) ELSE content END AS content) FROM art WHERE lang = 'en')
  QUALIFY deck_pos <= 5),
bf AS (SELECT ch.*, CASE WHEN (length(ch.content) < 100 OR (provider = 'newsapi' AND length(ch.content) < 500) OR {n_sents('ch.content')} < 6)
   AND length(page_text) > length(ch.content) THEN page_text ELSE ch.content END AS body FROM ch LEFT JOIN pt ON pt.page_id = ch.doc_id),
src AS (SELECT doc_id, description AS summary, body AS content FROM bf)""", SHOWN, """
ns AS (SELECT sector, count(*) AS n, row_number() OVER (ORDER BY sector) AS so FROM bf GROUP BY sector),
ls AS (SELECT sector, 2 + coalesce(sum(1 + n) OVER (ORDER BY so ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS sec FROM ns)""") + f"""
SELECT bf.sector, deck_pos, 'page://' || bf.doc_id AS url, title, substr(published_raw, 1, 10) AS date, k IS NOT NULL AS accepted,
  {SHOW} AS display_content, CAST(sec + deck_pos AS BIGINT) AS slide_no
FROM bf JOIN sh USING (doc_id) JOIN ls ON ls.sector = bf.sector""")
add("build_digest_by_search", with_(ARTICLES, f"q(sector, query_idx, term) AS (VALUES {_q})", f"""
pad AS (SELECT *, {padded('title')} AS t, {padded('description')} AS d, {padded('content')} AS c FROM art
  WHERE CAST(published_ts AS DATE) BETWEEN DATE '2024-02-05' - 14 AND DATE '2024-02-05')""", """
hit AS (SELECT pad.* EXCLUDE (sector, query_idx), q.sector, q.query_idx,
  3 * contains(t, ' ' || term || ' ')::INT + 2 * contains(d, ' ' || term || ' ')::INT + contains(c, ' ' || term || ' ')::INT AS score FROM pad, q),
one AS (SELECT * FROM hit WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY sector, url
  ORDER BY query_idx, provider_idx, score DESC, published_ts DESC, provider_rank) = 1),
ch AS (SELECT *, row_number() OVER (PARTITION BY sector ORDER BY query_idx, provider_idx, score DESC, published_ts DESC, provider_rank) AS deck_pos
  FROM one QUALIFY deck_pos <= 5),
src AS (SELECT DISTINCT doc_id, description AS summary, content FROM ch)""", SHOWN, """
ns AS (SELECT sector, count(*) AS n, row_number() OVER (ORDER BY sector) AS so FROM ch GROUP BY sector),
ls AS (SELECT sector, 2 + coalesce(sum(1 + n) OVER (ORDER BY so ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS sec FROM ns)""") + """
SELECT ch.sector, deck_pos, url, title, k IS NOT NULL AS accepted, CAST(sec + deck_pos AS BIGINT) AS slide_no
FROM ch JOIN sh USING (doc_id) JOIN ls ON ls.sector = ch.sector""")
CLEANED = f"cl AS (SELECT doc_id, {clean('text', True)} AS text FROM documents)"
CATS_CL = CATS.replace("FROM documents)", "FROM cl)").replace("pads AS (SELECT doc_id", "pads AS (SELECT doc_id")
ENT_CL = mentions("cl", "doc_id") + """,
ent AS (SELECT doc_id, label, list(surface ORDER BY p) AS names FROM
  (SELECT doc_id, label, surface, min(pos) AS p FROM men GROUP BY ALL) GROUP BY ALL)"""
add("enrich_articles", with_(ARTICLES, CLEANED, CATS_CL, ENT_CL, ENT3, phrase_rows("cl", "text", params.PHRASE_SIGNALS, EXTRA), KEY, MEAN3, POINTS,
    sentence_rows("cl", "text", params.SENTENCE_SIGNALS, False), summary_from("cl", "text")) + f"""
SELECT cl.doc_id, {clean('title', True)} AS cleaned_title, {lemmas('cl.text')} AS lemmatized_content,
  CASE WHEN cl.text <> '' THEN array_to_string(cats, '|') END AS categories,
  CASE WHEN cl.text <> '' THEN coalesce(key_points, '') END AS key_points,
  CASE WHEN cl.text <> '' THEN round(least(1.0::DOUBLE, {BASE} + {BOOST}), 9) END AS relevance,
  CASE WHEN cl.text <> '' THEN summary END AS summary
FROM cl JOIN art USING (doc_id) JOIN cat USING (doc_id) JOIN e3 USING (doc_id) JOIN sm USING (doc_id)
LEFT JOIN k3 USING (doc_id) LEFT JOIN pts USING (doc_id)""")
add("build_deck", FILL + ", " + layout(2) + f"""
SELECT dk.doc_id, dk.sector, idx, slide_no, CAST(slot AS BIGINT) AS slot, accepted,
  CASE WHEN accepted THEN dk.url ELSE new_url END AS shown_url,
  CAST(coalesce(length(CASE WHEN accepted THEN {SHOW.replace('(k', '(sh.k').replace('(array_to_string(k', '(array_to_string(sh.k')} ELSE {SHOW.replace('(k', '(fs.k').replace('(array_to_string(k', '(array_to_string(fs.k')} END), 0) AS BIGINT) AS n_shown
FROM dk JOIN sh USING (doc_id) JOIN ly USING (doc_id) LEFT JOIN fs ON fs.doc_id = dk.doc_id""")
add("preview", with_(ARTICLES, DEDUP, top(10)) + f"""
SELECT sector, deck_pos, CASE WHEN {strip('title')} = '' THEN 'Untitled Article' ELSE {strip('title')} END AS preview_title,
  strftime(published_ts, '%B %d, %Y %H:%M') AS preview_date, {lit(params.DEFAULT_BLURB_PREFIX)} || sector AS sector_description,
  sector || ' Sector (' || count(*) OVER (PARTITION BY sector) || ' articles)' AS heading FROM top""")
add("archive_sources", with_(ARTICLES, PAGE_TEXT, NEWSAPI, GNEWS, FILINGS) + rf"""
SELECT provider, source, count(*) AS n, CAST(sum(length(title)) AS BIGINT) AS title_chars FROM (
  SELECT 'newsapi' AS provider, CASE WHEN doc_id % 4 <> 3 THEN source_name ELSE 'Unknown' END AS source, title FROM na
  UNION ALL SELECT 'gnews', source_name, title FROM gn
  UNION ALL SELECT 'sec_edgar', 'SEC EDGAR', company || ' - ' || filing_type FROM fl
  UNION ALL SELECT 'web_scraper', regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1), {strip(unescape(untag(r"regexp_extract(html, '(?is)<title\b[^>]*>(.*?)</title\s*>', 1)", '')))} FROM pt)
GROUP BY ALL""")
add("archive_sources_all", with_(ARTICLES, PAGE_TEXT, NEWSAPI, GNEWS, FILINGS) + rf"""
SELECT provider, title, url, source, published_at, md5(content) AS content_md5, description FROM (
  SELECT 'newsapi' AS provider, title, url, CASE WHEN doc_id % 4 <> 3 THEN source_name ELSE 'Unknown' END AS source,
    CASE WHEN doc_id % 2 = 0 THEN published_raw ELSE '2024-06-01T00:00:00' END AS published_at, content, description FROM na
  UNION ALL SELECT 'gnews', title, url, source_name, published_raw, {strip('content')}, {strip('description')} FROM gn
  UNION ALL SELECT 'sec_edgar', company || ' - ' || filing_type, 'https://f.example/' || provider_rank || '.txt', 'SEC EDGAR', published_raw,
    description, filing_type || ' filing from ' || company FROM fl JOIN (SELECT doc_id AS provider_rank, description FROM art) USING (provider_rank)
  UNION ALL SELECT 'web_scraper', {strip(unescape(untag(r"regexp_extract(html, '(?is)<title\b[^>]*>(.*?)</title\s*>', 1)", '')))}, url,
    regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1), '', page_text, '' FROM pt)""")
add("stream_enrich_records", "SELECT r.* FROM (" + ORACLES["insight_records"] + ") r JOIN (" + with_(ARTICLES) + """
SELECT doc_id FROM art QUALIFY row_number() OVER (PARTITION BY sector, url ORDER BY published_ts, provider_rank) = 1) USING (doc_id)""")
