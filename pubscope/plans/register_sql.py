"""The SQL (DuckDB's dialect) that gives the same rows as the register's queries."""

from __future__ import annotations

from pubscope.functions.names import NO_NAMES, PARTICLES
from pubscope.operators.words import stopwords
from pubscope.plans import register as q

_WS = r"\s\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"


def _strip(c: str) -> str:
    return rf"regexp_replace({c}, '^[{_WS}]+|[{_WS}]+$', '', 'g')"


def _some(c: str) -> str:
    return f"nullif({_strip(c)}, '')"


def _clean(c: str) -> str:
    return rf"trim(regexp_replace(regexp_replace({c}, '[\x{{200b}}-\x{{200f}}\x{{2060}}\x{{feff}}]', '', 'g'), '[{_WS}]+', ' ', 'g'))"


def _list(values: object) -> str:
    return ", ".join("'" + str(v).replace("'", "''") + "'" for v in values)  # type: ignore[attr-defined]


def _fold(c: str) -> str:
    return f"strip_accents(lower({c}))"


def _key(c: str) -> str:
    words = rf"trim(regexp_replace({_fold(c)}, '[^\p{{L}}\p{{N}}]+', ' ', 'g'))"
    return f"coalesce(nullif(regexp_replace({words}, '^(the|le|la|les|der|die|das|el|al) +', ''), ''), trim({_fold(c)}))"


_LAST = "last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY slug ORDER BY harvested_at DESC, ingested_at DESC) AS rn FROM publications WHERE slug IS NOT NULL) WHERE rn = 1)"
_REC = f"""{_LAST},
rec AS (SELECT slug, {_some("url")} AS url, {_some("title")} AS title, {_some("subtitle")} AS subtitle,
  list_filter(list_transform(coalesce(authors, []), lambda x: {_strip("x")}), lambda x: x IS NOT NULL AND x <> '') AS authors,
  {_some("document_type")} AS type, nullif(year, 0) AS year, {_some("journal")} AS journal, {_some("publisher")} AS publisher, {_some("series")} AS series, {_some("doi")} AS doi FROM last)"""
_HAY = _fold("concat_ws(' ', title, subtitle, nullif(array_to_string(authors, ' '), ''), journal, publisher, series, type, year)")


def _where(filters: q.Filters, but: str | None = None) -> str:
    tests = {
        "type": f"coalesce(type, '') IN ({_list(sorted(filters.type))})" if filters.type else "true",
        "author": f"list_has_any(authors, [{_list(sorted(filters.author))}])" if filters.author else "true",
        "venue": " OR ".join(f"coalesce({f} IN ({_list(filters.venues_of(f))}), false)" for f in ("journal", "publisher") if filters.venues_of(f)) or "true",
        "years": f"coalesce(year BETWEEN {filters.years[0]} AND {filters.years[1]}, false)" if filters.years else "true",
        "search": f"contains({_HAY}, {_fold(chr(39) + filters.search.strip() + chr(39))})",
    }
    return " AND ".join(f"({t})" for d, t in tests.items() if d != but)


def _ranked(source: str, extra: str = "") -> str:
    return f"SELECT {extra}key, count, row_number() OVER (ORDER BY count DESC, key) AS rank FROM ({source})"


def _types(where: str = "true") -> str:
    return f"SELECT coalesce(type, '') AS key, count(*) AS count FROM rec WHERE {where} GROUP BY 1"


def _pairs(where: str = "true", least: int = 2) -> str:
    return f"""au AS (SELECT DISTINCT slug, unnest(authors) AS id FROM rec WHERE {where}),
  published AS (SELECT id, count(*) AS count FROM au GROUP BY id),
  links AS (SELECT x.id AS source, y.id AS target, count(*) AS weight FROM au x JOIN au y ON x.slug = y.slug AND x.id < y.id
    WHERE x.id IN (SELECT id FROM published WHERE count >= {least}) AND y.id IN (SELECT id FROM published WHERE count >= {least}) GROUP BY 1, 2),
  nodes AS (SELECT id, count FROM published WHERE id IN (SELECT source FROM links UNION SELECT target FROM links))"""


_SERIES = f"""top AS ({_ranked(_types())}), named AS (SELECT key, CASE WHEN rank <= 4 THEN key ELSE '{q.OTHER}' END AS series FROM top)"""


def _stacked(where: str) -> str:
    return f"""{_SERIES}, span AS (SELECT unnest(range(min(year), max(year) + 1)) AS year FROM rec),
  counts AS (SELECT year, coalesce(named.series, '{q.OTHER}') AS key, count(*) AS count FROM (SELECT *, coalesce(type, '') AS t FROM rec WHERE {where}) r LEFT JOIN named ON named.key = r.t WHERE year IS NOT NULL GROUP BY 1, 2),
  stacked AS (SELECT span.year::INT AS year, coalesce(sum(count) OVER (PARTITION BY span.year), 0)::BIGINT AS total, key, coalesce(count, 0) AS count FROM span LEFT JOIN counts ON counts.year = span.year)"""


_TAIL = r"\s*(\(.*?\)|\[.*?\]|,?\s*et\.?\s?al\.?|,?\s*u\.\s?a\.|,?\s*eds?\.?\)?)\s*$"


def _noise(c: str) -> str:
    out = f"trim({_strip(c)}, ',;')"
    for _ in range(5):
        out = rf"trim({_strip(f'''regexp_replace({out}, '{_TAIL}', '', 'i')''')}, ',;')"
    return out


_SPLIT = f"""cell AS (SELECT entry_id, i, list_filter(list_transform(string_split(part, ','), lambda x: {_strip("x")}), lambda x: x <> '') AS pieces, {_strip("part")} AS whole
    FROM (SELECT entry_id, unnest(string_split(authors, ';')) AS part, generate_subscripts(string_split(authors, ';'), 1) AS i FROM listing_entries WHERE authors IS NOT NULL)),
  flat AS (SELECT entry_id, i, unnest(CASE WHEN len(pieces) >= 4 AND len(pieces) % 2 = 0 THEN list_transform(range(1, len(pieces), 2), lambda k: pieces[k] || ', ' || pieces[k + 1]) WHEN whole <> '' THEN [whole] ELSE [] END) AS raw,
    generate_subscripts(CASE WHEN len(pieces) >= 4 AND len(pieces) % 2 = 0 THEN list_transform(range(1, len(pieces), 2), lambda k: pieces[k] || ', ' || pieces[k + 1]) WHEN whole <> '' THEN [whole] ELSE [] END, 1) AS j FROM cell)"""

_READ = f"""occ AS (SELECT slug, unnest(authors) AS raw, generate_subscripts(authors, 1) - 1 AS pos FROM rec),
  bare AS (SELECT slug, pos, {_noise("raw")} AS name FROM occ),
  tok AS (SELECT *, list_filter(regexp_split_to_array(name, '[{_WS}]+'), lambda t: t <> '') AS t FROM bare WHERE name <> '' AND {_fold("name")} NOT IN ({_list(NO_NAMES)})),
  cutat AS (SELECT *, coalesce(list_filter(range(1, len(t)), lambda i: list_contains([{_list(PARTICLES)}], trim({_fold("t[i + 1]")}, '.')))[1], len(t) - 1) AS at_ FROM tok),
  parts AS (SELECT slug, pos, CASE WHEN contains(name, ',') THEN {_strip("split_part(name, ',', 1)")} WHEN len(t) = 1 THEN t[1] ELSE array_to_string(t[at_ + 1:], ' ') END AS surname,
    CASE WHEN contains(name, ',') THEN {_strip("substr(name, instr(name, ',') + 1)")} WHEN len(t) = 1 THEN '' ELSE array_to_string(t[:at_], ' ') END AS given FROM cutat),
  read AS (SELECT *, trim({_strip("surname || ', ' || given")}, ',') AS display, coalesce({_key("surname")}, '') || '|' || coalesce({_key("given")}, '') AS key FROM parts),
  keys AS (SELECT key, count(*) AS count, arg_min(display, (-length(display), slug, pos)) AS surface FROM read GROUP BY key),
  sg AS (SELECT key, split_part(key, '|', 1) AS s, split_part(key, '|', 2) AS g, list_filter(string_split(split_part(key, '|', 2), ' '), lambda x: x <> '') AS t FROM keys),
  fits AS (SELECT a.key AS alias, b.key AS target FROM sg a JOIN sg b ON a.s = b.s AND a.key <> b.key AND len(a.t) > 0 AND len(a.t) < len(b.t)
    AND len(list_filter(range(1, len(a.t) + 1), lambda i: a.t[i] = b.t[i] OR (length(a.t[i]) = 1 AND starts_with(b.t[i], a.t[i])))) = len(a.t)),
  only_ AS (SELECT alias, min(target) AS target FROM fits GROUP BY alias HAVING count(*) = 1),
  folded AS (SELECT * FROM only_ WHERE target NOT IN (SELECT alias FROM only_))"""

_VENUES = f"""forms AS (SELECT publisher AS form, count(*) AS n FROM rec WHERE publisher IS NOT NULL GROUP BY 1),
  keyed AS (SELECT *, {_key("form")} AS key FROM forms)"""


def _lemma(c: str) -> str:
    noun = f"CASE WHEN regexp_matches({c}, '^.{{2,}}ies$') THEN regexp_replace({c}, 'ies$', 'y') WHEN regexp_matches({c}, '^.{{2,}}(?:ss|sh|ch|x|z)es$') THEN regexp_replace({c}, 'es$', '') WHEN regexp_matches({c}, '^.{{2,}}[^sui]s$') THEN regexp_replace({c}, 's$', '') ELSE {c} END"
    verb = f"CASE WHEN regexp_matches({c}, '^.{{4,}}[^e]ing$') THEN regexp_replace({c}, 'ing$', '') WHEN regexp_matches({c}, '^.{{4,}}[^e]ed$') THEN regexp_replace({c}, 'ed$', '') ELSE {c} END"
    return f"CASE WHEN ({noun}) <> {c} THEN {noun} ELSE {verb} END"


def _terms(stop: str) -> str:
    return rf"""tok AS (SELECT coalesce(source, 'none') AS unit, doc_id, unnest(ts) AS token, generate_subscripts(ts, 1) AS at_ FROM
    (SELECT source, doc_id, list_filter(regexp_split_to_array(lower(text), '[^\p{{L}}]+'), lambda x: x <> '') AS ts FROM documents WHERE text IS NOT NULL)),
  term AS (SELECT unit, doc_id, at_, {_lemma("token")} AS term FROM tok WHERE length(token) >= 2 AND token NOT IN ({stop})),
  kept AS (SELECT * FROM term WHERE term NOT IN ({stop})),
  per_unit AS (SELECT unit, term, count(*) AS n, min((doc_id, at_)) AS first FROM kept GROUP BY 1, 2),
  best AS (SELECT unit, term AS text, n AS size, row_number() OVER (PARTITION BY unit ORDER BY n DESC, first, term) AS rank FROM per_unit QUALIFY rank <= 100),
  merged AS (SELECT text, sum(size)::BIGINT AS size, array_to_string(list_sort(list_distinct(list(unit))), ' | ') AS units FROM best GROUP BY text)"""


def _words() -> dict[str, str]:
    t = _terms(_list(stopwords()))
    members = "('abstracts', 'project_pages', 'book_reviews')"
    cloud = f"WITH {t}, shown AS (SELECT text, size, row_number() OVER (ORDER BY size DESC, text) AS rank FROM merged QUALIFY rank <= %d)"
    return {
        "term_frequencies": f"""WITH {t}, combined AS (SELECT term, sum(n)::BIGINT AS n, min(first) AS first FROM per_unit WHERE unit IN {members} GROUP BY term)
            SELECT unit, text, size, rank FROM best UNION ALL
            SELECT '(combined)', term, n, row_number() OVER (ORDER BY n DESC, first, term) AS rank FROM combined QUALIFY rank <= 100""",
        "term_totals": f"WITH {t} SELECT unit, count(*) AS tokens FROM kept GROUP BY unit UNION ALL SELECT '(all)', count(*) FROM kept",
        "merged_groups": f"WITH {t} SELECT * FROM merged",
        "prepared_words": f"""{cloud % 75} SELECT text, size, rank, size / (SELECT max(size) FROM shown) * 100 AS share,
            least(greatest(sqrt(518400.0 / ((SELECT count(*) FROM shown) * 1.5)) * (size / (SELECT max(size) FROM shown)), 12.0), 90.0) AS font,
            least(floor((rank - 1) / (SELECT count(*) FROM shown) * 6), 5)::INT AS slot, CASE WHEN rank > 12 AND left(md5(text), 1) IN ('0', '1', '2', '3') THEN 90 ELSE 0 END AS rotation FROM shown""",
        "word_previews": f"""{cloud % 31} SELECT text, i::INT AS slot, CASE WHEN lo = hi THEN 22 ELSE (13 + floor((size - lo) / (hi - lo) * 21 + 0.5))::INT END AS px
            FROM (SELECT unnest(range(0, (SELECT count(*) FROM shown))) AS i), (SELECT min(size) AS lo, max(size) AS hi, count(*) AS n FROM shown) m, shown WHERE rank - 1 = (i * 5) % n""",
        "word_context": f"WITH {t} SELECT sum(size)::BIGINT AS occurrences, count(*) AS terms FROM merged",
    }


_SNAP = f"""days AS (SELECT DISTINCT snapshot_date FROM publication_snapshots ORDER BY 1 DESC LIMIT 2),
  snap AS (SELECT snapshot_date, slug, coalesce(title, '') || ' | ' || coalesce(authors, '') || ' | ' || coalesce(publisher, '') || ' | ' AS fingerprint
    FROM (SELECT *, row_number() OVER (PARTITION BY snapshot_date, slug ORDER BY delivery DESC, row_no DESC, title DESC NULLS LAST) AS rn FROM (SELECT * REPLACE ({_some("slug")} AS slug) FROM publication_snapshots WHERE snapshot_date IN (SELECT * FROM days))) WHERE rn = 1 AND slug IS NOT NULL),
  listing AS (SELECT * FROM snap WHERE snapshot_date = (SELECT max(snapshot_date) FROM days)), cached AS (SELECT * FROM snap WHERE snapshot_date = (SELECT min(snapshot_date) FROM days))"""
_FIRST = "first AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY slug ORDER BY page, pos, entry_id) AS rn FROM listing_entries WHERE trim(slug) <> '') WHERE rn = 1)"
_DRIFT = f"""expected(type_id, label) AS (VALUES {", ".join(f"({i}, '{t}')" for i, t in enumerate(q.TYPES))}),
  actual AS (SELECT coalesce(type_id, 100 + length(t.type)) AS type_id, CASE WHEN type_id = 2 THEN upper(t.type) ELSE t.type END AS label FROM (SELECT DISTINCT type FROM rec WHERE type IS NOT NULL) t LEFT JOIN expected ON label = t.type)"""
_PARAS = rf"""p AS (SELECT page_id, {_clean("x")} AS text, i FROM (SELECT page_id, unnest(paragraphs) AS x, generate_subscripts(paragraphs, 1) AS i FROM unit_pages) WHERE x IS NOT NULL),
  marked AS (SELECT *, NOT (len(string_split(text, ' ')) <= 12 AND regexp_matches(text, '(?i)^(Dr\.|Prof\.|PD\b|Priv\.-Doz\.|Dipl\.)')) AS prose FROM p WHERE text <> ''),
  kept AS (SELECT *, bool_or(prose) OVER (PARTITION BY page_id ORDER BY i) AS begun FROM marked)"""
_SEL = _list(q.SELECTED)
_EGO = f"ego AS (SELECT source AS id FROM links WHERE source IN ({_SEL}) OR target IN ({_SEL}) UNION SELECT target FROM links WHERE source IN ({_SEL}) OR target IN ({_SEL}))"
_DRAWN = f"""busy AS (SELECT id FROM nodes ORDER BY count DESC, id LIMIT 60), shown AS (SELECT * FROM nodes WHERE id IN (SELECT id FROM busy UNION SELECT id FROM ego))"""
_EXPAND = f"""alias(variant_key, target) AS (SELECT {_key("v")}, t FROM (VALUES {", ".join(f"('{v}', '{t}')" for s, v, t in q.ALIASES if s == "publishers")}) x(v, t))"""


def _venue(used: str) -> str:
    return f"""used AS (SELECT key, used, sum(n) AS n FROM ({used}) GROUP BY 1, 2)
      SELECT key, arg_min(used, (-n, -length(used), used)) AS canonical, sum(n)::BIGINT AS n FROM used GROUP BY key"""


ORACLES: dict[str, str] = {
    "type_counts_rank": f"WITH {_REC} {_ranked(_types())}",
    "xfilter_type": f"WITH {_REC} {_ranked(_types(_where(q.WIDE, 'type')))}",
    "xfilter_author": f"WITH {_REC} " + _ranked(f"SELECT key, count(*) AS count FROM (SELECT unnest(authors) AS key FROM rec WHERE {_where(q.WIDE, 'author')}) GROUP BY key"),
    "xfilter_venue": f"WITH {_REC} " + " UNION ALL ".join(_ranked(f"SELECT {f} AS key, count(*) AS count FROM rec WHERE {f} IS NOT NULL AND {_where(q.WIDE, 'venue')} GROUP BY 1", f"'{f}' AS field, ") + " QUALIFY rank <= 50" for f in ("journal", "publisher")),
    "xfilter_years": f"WITH {_REC}, {_stacked(_where(q.WIDE, 'years'))} SELECT * FROM stacked",
    "xfilter_network": f"WITH {_REC}, {_pairs(_where(q.WIDE, 'author'))} SELECT * FROM links",
    "xfilter_list_page": f"WITH {_REC} SELECT slug, title, year, type FROM rec WHERE {_where(q.WIDE)} ORDER BY coalesce(year, 0) DESC, coalesce(title, ''), slug LIMIT 20 OFFSET 20",
    "xfilter_all": f"WITH {_REC} SELECT slug, year, type FROM rec WHERE {_where(q.CHOSEN)}",
    "dashboard_views": f"WITH {_REC} " + " UNION ALL ".join(f"SELECT '{d or 'all'}' AS view, count(*) AS records FROM rec WHERE {_where(q.CHOSEN, d)}" for d in ("type", "author", "venue", "years", "search", None)),
    "dashboard_all": f"""WITH {_REC}, {_pairs(_where(q.WIDE, 'author'))}, """
    + ", ".join(f"v_{k} AS (SELECT key, count(*) AS count FROM (SELECT {x} AS key FROM rec WHERE {_where(q.WIDE, but)}) WHERE key IS NOT NULL GROUP BY key)" for k, x, but in (("type", "coalesce(type, '')", "type"), ("author", "unnest(authors)", "author"), ("journal", "journal", "venue"), ("publisher", "publisher", "venue"), ("years", "year::VARCHAR", "years")))
    + " SELECT 'type' AS view, key, count FROM v_type UNION ALL SELECT 'years', key, count FROM v_years"
    + "".join(f" UNION ALL SELECT '{k}', key, count FROM (SELECT * FROM v_{k} ORDER BY count DESC, key LIMIT 50)" for k in ("author", "journal", "publisher"))
    + f" UNION ALL SELECT 'network', source || ' & ' || target, weight FROM links UNION ALL SELECT 'list', '', count(*) FROM rec WHERE {_where(q.WIDE)}",
    "summary_counts": f"""WITH {_REC}, seen AS (SELECT * FROM rec WHERE {_where(q.WIDE)})
        SELECT count(*) AS publications, count(*) FILTER (type IS NULL) AS untyped, count(*) FILTER (year IS NULL) AS without_year, min(year) AS year_min, max(year) AS year_max,
          (SELECT count(DISTINCT a) FROM (SELECT unnest(authors) AS a FROM seen)) AS authors, CASE WHEN min(year) = max(year) THEN min(year)::VARCHAR ELSE min(year) || '–' || max(year) END AS extent, format('{{:,}}', count(*)) AS figure FROM seen""",
    "series_order": f"WITH {_REC}, {_SERIES} SELECT top.key, count, series FROM top JOIN named ON top.key = named.key",
    "stacked_years": f"WITH {_REC}, {_stacked('true')} SELECT *, count / nullif(total, 0) * 100 AS share, total / (SELECT max(total) FROM stacked) * 100 AS height FROM stacked",
    "meta_per_year": f"""WITH {_REC}, span AS (SELECT unnest(range(min(year), max(year) + 1))::INT AS year FROM rec), n AS (SELECT year, count(*) AS count FROM rec GROUP BY year),
        f AS (SELECT span.year, coalesce(count, 0) AS count FROM span LEFT JOIN n ON n.year = span.year) SELECT year, count, greatest(count / (SELECT max(count) FROM f) * 100, 1.5) AS height FROM f""",
    "meta_types": f"""WITH {_REC}, known(o, label) AS (VALUES {", ".join(f"({i}, '{t}')" for i, t in enumerate(q.TYPES))})
        SELECT (row_number() OVER (ORDER BY coalesce(o, {len(q.TYPES)}), type) - 1)::INT AS ordinal, type AS label FROM (SELECT DISTINCT type FROM rec WHERE type IS NOT NULL) LEFT JOIN known ON label = type""",
    "year_ticks": f"""WITH {_REC}, e AS (SELECT min(year) AS a, max(year) AS b, max(year) - min(year) + 1 AS span FROM rec), y AS (SELECT unnest(range(a, b + 1))::INT AS year, a, b, span FROM e)
        SELECT year, (year - a + 0.5) / span * 100 AS offset FROM y WHERE year % (CASE WHEN span > 40 THEN 10 WHEN span > 15 THEN 5 ELSE 1 END) = 0 OR year IN (a, b)""",
    "year_options": f"WITH {_REC}, y AS (SELECT unnest(range(min(year), max(year) + 1))::INT AS year FROM rec) SELECT (row_number() OVER (ORDER BY year DESC) - 1)::INT AS pos, year, year BETWEEN {q.CHOSEN.years[0]} AND {q.CHOSEN.years[1]} AS chosen FROM y",
    "search_substring": f"WITH {_REC} SELECT slug, title FROM rec WHERE contains({_HAY}, 'cemetery')",
    "suggestions": f"""WITH {_REC}, x AS (SELECT 'author' AS kind, unnest(authors) AS value FROM rec UNION ALL SELECT 'journal', journal FROM rec UNION ALL SELECT 'publisher', publisher FROM rec),
        c AS (SELECT kind, value, count(*) AS count FROM x WHERE value IS NOT NULL GROUP BY ALL) SELECT kind, value, count, (instr({_fold("value")}, 'ver') - 1)::INT AS "at" FROM c WHERE contains({_fold("value")}, 'ver') ORDER BY 4, count DESC, value, kind LIMIT 8""",
    "list_pages": f"WITH {_REC}, r AS (" + _ranked("SELECT key, count(*) AS count FROM (SELECT unnest(authors) AS key FROM rec) GROUP BY key") + ") SELECT key, count, rank, ((rank - 1) // 12 + 1)::INT AS page, count / (SELECT max(count) FROM r) * 100 AS share FROM r",
    "record_labels": rf"""WITH {_REC}, f AS (SELECT *, authors[1] AS a, list_filter(regexp_split_to_array(trim(coalesce(nullif(split_part(authors[1], ',', 2), ''), '')), '[{_WS}]+'), lambda t: t <> '') AS g FROM rec)
        SELECT slug, coalesce(nullif(concat_ws(': ', title, subtitle), ''), slug) AS label, coalesce(journal, publisher, series) AS venue, coalesce(array_to_string(authors, '; '), '') AS names, 'https://doi.org/' || doi AS link,
          CASE WHEN len(g) > 0 THEN array_to_string(list_transform(g, lambda t: t[1] || '.'), ' ') || ' ' || trim(split_part(a, ',', 1)) ELSE trim(split_part(a, ',', 1)) END AS first FROM f""",
    "merge_keys": f"SELECT name_id, {_key('form')} AS key FROM name_forms",
    "venue_canonical": f"WITH {_REC}, {_VENUES}, " + _venue("SELECT key, form AS used, n FROM keyed"),
    "venue_merges": f"WITH {_REC}, {_VENUES}, best AS (SELECT key, arg_min(form, (-n, -length(form), form)) AS canonical FROM keyed GROUP BY key) SELECT canonical, array_to_string(list_sort(list(form)), ' | ') AS variants FROM keyed JOIN best USING (key) WHERE form <> canonical GROUP BY canonical, key",
    "alias_lookup": f"WITH {_REC}, {_VENUES}, {_EXPAND}, " + _venue(f"SELECT {_key('coalesce(target, form)')} AS key, coalesce(target, form) AS used, n FROM keyed LEFT JOIN alias ON variant_key = key"),
    "author_split": f"WITH {_SPLIT} SELECT entry_id, row_number() OVER (PARTITION BY entry_id ORDER BY i, j) - 1 AS pos, raw, {_noise('raw')} AS name FROM flat",
    "name_keys": f"WITH {_REC}, {_READ} SELECT * FROM keys",
    "prefix_fold": f"WITH {_REC}, {_READ} SELECT * FROM folded",
    "name_display": f"""WITH {_REC}, {_READ}, shown AS (SELECT keys.key, coalesce(target, keys.key) AS root FROM keys LEFT JOIN folded ON alias = keys.key)
        SELECT k.surface AS author, count(DISTINCT slug) AS publications FROM read JOIN shown USING (key) JOIN keys k ON k.key = root GROUP BY 1""",
    "coauthor_links": f"WITH {_REC}, {_pairs()} SELECT *, least(1 + weight, 6) AS width, 60 / sqrt(weight) AS distance FROM links",
    "coauthor_nodes": f"WITH {_REC}, {_pairs()} SELECT id, count, 4 + 14 * sqrt(count / (SELECT max(count) FROM nodes)) AS radius FROM nodes",
    "neighbour_map": f"WITH {_REC}, {_pairs()}, b AS (SELECT source AS id, target AS n FROM links UNION SELECT target, source FROM links) SELECT id, array_to_string(list_sort(list(n)), ' | ') AS neighbours, count(*) AS degree FROM b GROUP BY id",
    "ego_network": f"WITH {_REC}, {_pairs()}, {_EGO} SELECT *, source IN ({_SEL}) OR target IN ({_SEL}) AS own FROM links WHERE source IN (SELECT id FROM ego) AND target IN (SELECT id FROM ego)",
    "drawn_network": f"WITH {_REC}, {_pairs()}, {_EGO}, {_DRAWN} SELECT id, count, CASE WHEN id IN ({_SEL}) THEN 'selected' WHEN id IN (SELECT id FROM ego) THEN 'neighbour' ELSE 'other' END AS role FROM shown",
    "network_signature": f"""WITH {_REC}, {_pairs()}, busy AS (SELECT id FROM nodes ORDER BY count DESC, id LIMIT 60)
        SELECT (SELECT array_to_string(list_sort(list(id)), '|') FROM busy) AS ids, count(*) AS links, coalesce(sum(weight), 0)::BIGINT AS weight FROM links WHERE source IN (SELECT id FROM busy) AND target IN (SELECT id FROM busy)""",
    "solo_authors": f"WITH {_REC}, {_pairs(least=1)} SELECT id FROM published WHERE id NOT IN (SELECT id FROM nodes)",
    **_words(),
    "listing_first": f"WITH {_FIRST} SELECT slug, page, pos, entry_id FROM first",
    "refresh_diff": f"WITH {_SNAP} SELECT coalesce(l.slug, c.slug) AS slug, CASE WHEN c.slug IS NULL THEN 'new' WHEN l.slug IS NULL THEN 'withdrawn' WHEN l.fingerprint = c.fingerprint THEN 'unchanged' ELSE 'changed' END AS status FROM listing l FULL JOIN cached c ON l.slug = c.slug",
    "refresh_merge": f"WITH {_SNAP} SELECT l.slug, CASE WHEN c.fingerprint = l.fingerprint THEN 'cached' ELSE 'fresh' END AS origin, l.fingerprint FROM listing l LEFT JOIN cached c ON l.slug = c.slug",
    "type_tagging": f"""WITH {_FIRST}, t(o, label) AS (VALUES {", ".join(f"({i}, '{t}')" for i, t in enumerate(q.TYPES))}),
        s AS (SELECT slug, max(o) AS o FROM publications JOIN t ON document_type = label GROUP BY slug) SELECT slug, label AS document_type FROM first LEFT JOIN s USING (slug) LEFT JOIN t USING (o)""",
    "schema_drift": f"WITH {_REC}, {_DRIFT} SELECT type_id::INT AS type_id, CASE WHEN a.label IS NULL THEN 'missing' WHEN e.label IS NULL THEN 'added' ELSE 'renamed' END AS change, e.label AS expected, a.label AS actual FROM expected e FULL JOIN actual a USING (type_id) WHERE e.label IS DISTINCT FROM a.label",
    "quality_gates": f"""WITH {_REC}, n AS (SELECT count(*) AS n, count(*) FILTER (year IS NULL) AS u FROM rec), m AS (SELECT count(DISTINCT slug) AS m FROM publications)
        SELECT 'not_empty' AS gate, n > 0 AS ok, n AS detail FROM n UNION ALL SELECT 'years', u <= n * 0.25, u FROM n UNION ALL SELECT 'no_drop', n >= m * 0.9, n - m FROM n, m""",
    "published_in": rf"""WITH {_REC}, r AS (SELECT DISTINCT ref_id, from_slug, lower(regexp_extract(regexp_replace(url_decode(replace(regexp_replace(regexp_replace({_strip("slug")}, '^([A-Za-z][A-Za-z0-9+.-]*:)?//[^/?#]*', ''), '(?s)[?#].*$', ''), '+', '%2B')), '^[/{_WS}]+|[/{_WS}]+$', '', 'g'), '[^/]*$')) AS target, title FROM volume_refs)
        SELECT ref_id, from_slug, target, rec.title AS volume, rec.year AS volume_year FROM r LEFT JOIN rec ON rec.slug = target""",
    "imprints": rf"""WITH {_LAST}, l AS (SELECT slug, series, concat_ws(', ', publisher, CASE WHEN len(places) > 0 THEN array_to_string(places, ', ') END, coalesce(regexp_replace(iso_date, '^(\d{{4}})-(\d{{2}})-(\d{{2}})$', '\3/\2/\1'), nullif(year, 0)::VARCHAR)) AS line FROM last),
        p AS (SELECT *, list_filter(list_transform(string_split(line, ','), lambda x: {_strip("x")}), lambda x: x <> '') AS parts FROM l),
        k AS (SELECT *, coalesce(parts[-1], '') AS tail FROM p), z AS (SELECT *, regexp_matches(tail, '^\d{{2}}/\d{{2}}/\d{{4}}$') AS dated, regexp_matches(tail, '^\d{{4}}$') AS bare FROM k),
        r AS (SELECT *, CASE WHEN dated OR bare THEN parts[:len(parts) - 1] ELSE parts END AS rest FROM z)
        SELECT slug, CASE WHEN dated THEN tail[7:10] || '-' || tail[4:5] || '-' || tail[1:2] END AS date, CASE WHEN dated THEN tail[7:10] WHEN bare THEN tail END::INT AS year, rest[1] AS publisher, coalesce(array_to_string(rest[2:], ' | '), '') AS places, {_some("series")} AS series FROM r""",
    "periodicals": rf"""WITH {_LAST}, p AS (SELECT slug, list_filter(list_transform(string_split(concat_ws(', ', journal, volume, issue), ','), lambda x: {_strip("x")}), lambda x: x <> '') AS p FROM last),
        k AS (SELECT slug, p, coalesce(list_filter(range(1, len(p)), lambda i: len(list_filter(p[i + 1:], lambda x: NOT regexp_matches(x, '^[\d/–—-]+$'))) = 0)[1], len(p)) AS c FROM p)
        SELECT slug, nullif(array_to_string(p[:c], ', '), '') AS journal, p[c + 1] AS volume, p[c + 2] AS issue FROM k""",
    "identifiers": rf"""WITH {_LAST}, v AS (SELECT slug, coalesce({_some("isbn")}, {_some("issn")}) AS value, {_some("doi")} AS d, pages, series, year FROM last),
        w AS (SELECT *, regexp_matches(value, '^\d{{4}}-?\d{{3}}[\dXx]$') AS is_issn FROM v)
        SELECT slug, CASE WHEN NOT is_issn THEN value END AS isbn, CASE WHEN is_issn THEN value END AS issn, d AS doi, CASE WHEN regexp_matches(coalesce(pages, ''), '(?i)^(p\.|pp\.|\d+\s*p\.)') THEN pages END AS pages,
          coalesce(nullif(year, 0), nullif(regexp_extract(series, '\b(1[89]\d{{2}}|20\d{{2}})\b', 1), '')::INT, nullif(regexp_extract(pages, '\b(1[89]\d{{2}}|20\d{{2}})\b', 1), '')::INT) AS year FROM w""",
    "addresses": r"""WITH """ + _LAST + r""", a AS (SELECT slug, url, document_type, regexp_replace(url, '^https?://[^/]*', '') AS path FROM last),
        n AS (SELECT *, regexp_replace(regexp_replace(replace(path, '?', ''), '[^A-Za-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS safe FROM a)
        SELECT slug, CASE WHEN starts_with(path, '/pub/') THEN nullif(trim(split_part(substr(path, 6), '?', 1), '/'), '') END AS "of",
          CASE WHEN length(safe) > 80 THEN left(safe, 80) || '_' || left(sha1(url), 12) WHEN safe = '' THEN 'index' ELSE safe END || '.html' AS file,
          'https://register.example' || path AS url, '/list/page-3?filter%5Btype%5D=' || replace(url_encode(coalesce(document_type, '')), '%20', '+') AS listing FROM n""",
    "byline_filter": f"WITH {_PARAS} SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY i) - 1 AS pos, text FROM kept WHERE begun",
    "unit_html": f"WITH {_PARAS} SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY i) - 1 AS pos, text FROM kept WHERE begun",
    "unit_documents": f"SELECT page_id, concat_ws(chr(10) || chr(10), {_some('title')}, array_to_string(nullif(list_filter(list_transform(paragraphs, lambda x: {_clean('x')}), lambda x: x IS NOT NULL AND x <> ''), []), chr(10) || chr(10))) || chr(10) AS document FROM unit_pages",
    "listing_html": f"""WITH c AS (SELECT slug, page::BIGINT * 100000 + pos AS page, {_clean("coalesce(title, '')")} AS title, {_clean("coalesce(authors, '')")} AS authors, {_clean("coalesce(publisher, '')")} AS publisher, {_clean("coalesce(periodical, '')")} AS periodical FROM listing_entries WHERE slug <> '')
        SELECT slug, page, title, authors, publisher, periodical FROM c QUALIFY row_number() OVER (PARTITION BY slug ORDER BY page, title, authors, publisher, periodical) = 1""",
    "detail_html": f"""WITH {_LAST} SELECT slug, {_clean("coalesce(title, '')")} AS title, {_clean("coalesce(subtitle, '')")} AS subtitle,
        coalesce(array_to_string(list_filter(list_transform(list_filter(list_transform(coalesce(authors, []), lambda x: {_strip("x")}), lambda x: x <> ''), lambda x: {_clean("x")}), lambda x: x <> ''), '; '), '') AS authors,
        {_clean("coalesce(abstract, '')")} AS abstract, coalesce({_some("doi")}, 'none') AS doi, coalesce({_some("isbn")}, 'none') AS number FROM last""",
}
