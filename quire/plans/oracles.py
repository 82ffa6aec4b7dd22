"""The registered queries in DuckDB SQL, written from the same definitions.

``SHARED`` holds the layers that queries build on, each a named subquery; ``_with`` picks
those that a query needs.
"""

from __future__ import annotations

import re

from quire.functions import text as X
from quire.plans.synthetic import HEADINGS

_NAMES = "[" + ", ".join(f"'{h}'" for h in HEADINGS) + "]"
# in RE2 the classes are of ASCII and U would mean ungreedy
_CAPTION, _TABLE_CAPTION, _REFERENCE = (p.replace("(?iU)", "(?i)") for p in (X.CAPTION, X.TABLE_CAPTION, X.REFERENCE))


def _is_caption(c: str) -> str:
    return f"regexp_matches({c}, '{_CAPTION}')"


def _strip(c: str) -> str:
    return rf"regexp_replace({c}, '^\s+|\s+$', '', 'g')"


def _below(c: str, n: int) -> str:
    """A plain comparison of a row number; DuckDB 2.0 loses rows where it turns one of whole
    numbers into a top-n over the window."""
    return f"CAST({c} AS DOUBLE) < {n}"


def _words(c: str) -> str:
    return rf"len(regexp_extract_all({c}, '\S+'))"


def _mid(c: str) -> str:
    return rf"regexp_matches({c}, '^\s*\p{{Ll}}')"


def _percent(part: str, whole: str) -> str:
    return f"CASE WHEN {whole} > 0 THEN CAST(round_even(100.0 * {part} / {whole}, 0) AS INTEGER) || '%' ELSE '—' END"


def _section(c: str) -> str:
    bare = rf"lower(trim(regexp_replace(trim(regexp_replace({c}, '^\s*([0-9]+(\.[0-9]+)*|[IVXLC]+|[A-Z])[.)]?\s+', '')), '(?i)^(our|the|a|an)\s+', '')))"

    def first(test: str) -> str:
        rows = []
        for section, keywords in X.SECTION_KEYWORDS:
            rows.append(f"WHEN {' OR '.join(f'{test}({bare}, {chr(39)}{k}{chr(39)})' for k in keywords)} THEN '{section}'")
        return f"CASE {' '.join(rows)} ELSE 'unknown' END"

    return rf"CASE WHEN {bare} = '' THEN 'unknown' WHEN regexp_matches({bare}, '\s+(and|&)\s+') THEN {first('contains')} ELSE {first('starts_with')} END"


SHARED = {
    "ln": "SELECT 'doc-' || doc_id AS paper_id, CAST(i - 1 AS INTEGER) AS i, raw FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)",
    "pg": "SELECT DISTINCT paper_id, CAST(p AS INTEGER) AS page FROM (SELECT paper_id, unnest(range(0, max(i) // 12 + 1)) AS p FROM ln GROUP BY paper_id)",
    "tb0": f"""SELECT paper_id, i // 12 AS page, (i % 12) * 2 AS pos, i, CASE WHEN i % 9 = 8 THEN concat_ws(' ', raw, lead(raw) OVER (PARTITION BY paper_id ORDER BY i)) ELSE raw END AS raw, (i % 12) // 6 AS col, i % 12 % 6 AS row, i // 9 AS k, i % 27 = 0 AS wide,
  CASE WHEN i % 9 = 0 THEN 'heading' WHEN i % 12 = 5 THEN 'caption' WHEN i % 5 = 2 THEN 'citing' ELSE 'body' END AS role,
  CASE WHEN (i // 12) % 2 = 0 THEN 'Figure' ELSE 'Table' END AS word, ({_NAMES})[(i // 9) % {len(HEADINGS)} + 1] AS heading FROM ln""",
    "tb": r"""SELECT paper_id, page, pos, i, role, CASE WHEN role = 'heading' AND wide OR col = 0 THEN 54.0 ELSE 321.0 END::DOUBLE AS x0, (100 + row * 80)::DOUBLE AS y0,
  CASE WHEN role = 'heading' AND wide THEN 558.0 WHEN col = 0 THEN 291.0 ELSE 558.0 END::DOUBLE AS x1, (140 + row * 80)::DOUBLE AS y1,
  CASE WHEN i = 0 THEN raw WHEN role = 'heading' THEN (k + 1) || '. ' || heading WHEN role = 'caption' THEN word || ' ' || (page + 1) || ': ' || raw
    WHEN role = 'citing' THEN raw || ' as shown in ' || word || ' ' || (page + 1) ELSE raw END AS text,
  CASE WHEN role = 'heading' THEN 12.0 ELSE 9.0 END::DOUBLE AS font_size, CASE WHEN role = 'heading' THEN 1.0 ELSE 0.0 END::DOUBLE AS bold_ratio
  FROM tb0""",
    "tx": r"SELECT * FROM tb WHERE regexp_matches(text, '\S')",
    "fg": "SELECT paper_id, page, pos + 1 AS pos, i, x0, 550.0::DOUBLE AS y0, x1, 640.0::DOUBLE AS y1 FROM tx WHERE role = 'caption'",
    # coverage, its runs and the gutters, loosely and then strictly
    "bins": "SELECT paper_id, page, CAST(unnest(range(0, 612)) AS INTEGER) AS bin FROM (SELECT DISTINCT paper_id, page FROM tx)",
    "cov1": "SELECT b.paper_id, b.page, bin, coalesce(sum(y1 - y0), 0) AS h FROM bins b LEFT JOIN bl t ON t.paper_id = b.paper_id AND t.page = b.page AND bin >= greatest(CAST(floor(x0) AS INTEGER), 0) AND bin < least(CAST(floor(x1) AS INTEGER) + 1, 612) GROUP BY ALL",
    "run1": "SELECT paper_id, page, min(bin)::DOUBLE AS s, (max(bin) + 1)::DOUBLE AS e FROM (SELECT *, bin - row_number() OVER (PARTITION BY paper_id, page ORDER BY bin) AS g FROM (SELECT *, max(h) OVER (PARTITION BY paper_id, page) AS peak FROM cov1) WHERE peak > 0 AND h <= peak * 0.5) GROUP BY paper_id, page, g HAVING min(bin) > 0 AND max(bin) + 1 <= 611 AND count(*) >= 612 * 0.035",
    "edge1": "SELECT paper_id, page, list_concat(list_concat([0.0::DOUBLE], list(( s + e) / 2 ORDER BY s)), [612.0::DOUBLE]) AS edges FROM run1 GROUP BY ALL",
    "in1": "SELECT t.* FROM bl t JOIN edge1 e USING (paper_id, page) WHERE len(list_filter(edges, lambda z: z <= x0 + 1)) = len(list_filter(edges, lambda z: z <= greatest(x1 - 1, x0)))",
    "cov2": "SELECT b.paper_id, b.page, bin, coalesce(sum(y1 - y0), 0) AS h FROM bins b JOIN (SELECT DISTINCT paper_id, page FROM in1) USING (paper_id, page) LEFT JOIN in1 t ON t.paper_id = b.paper_id AND t.page = b.page AND bin >= greatest(CAST(floor(x0) AS INTEGER), 0) AND bin < least(CAST(floor(x1) AS INTEGER) + 1, 612) GROUP BY ALL",
    "gut": "SELECT paper_id, page, min(bin)::DOUBLE AS start, (max(bin) + 1)::DOUBLE AS \"end\" FROM (SELECT *, bin - row_number() OVER (PARTITION BY paper_id, page ORDER BY bin) AS g FROM (SELECT *, max(h) OVER (PARTITION BY paper_id, page) AS peak FROM cov2) WHERE peak > 0 AND h <= peak * 0.08) GROUP BY paper_id, page, g HAVING min(bin) > 0 AND max(bin) + 1 <= 611 AND count(*) >= 612 * 0.035",
    "edge": "SELECT p.paper_id, p.page, list_concat(list_concat([0.0::DOUBLE], coalesce(m, [])), [612.0::DOUBLE]) AS edges FROM pg p LEFT JOIN (SELECT paper_id, page, list((start + \"end\") / 2 ORDER BY start) AS m FROM gut GROUP BY ALL) USING (paper_id, page)",
    "ord0": "SELECT b.*, edges, len(edges) > 2 AND len(list_filter(edges, lambda z: z <= x0 + 1)) <> len(list_filter(edges, lambda z: z <= greatest(x1 - 1, x0))) AS spans FROM bl b JOIN edge USING (paper_id, page)",
    "ord1": "SELECT *, CASE WHEN spans OR len(edges) <= 2 THEN 0 ELSE len(list_filter(edges, lambda z: z <= (x0 + x1) / 2)) - 1 END AS column_index, sum(CAST(spans AS INTEGER)) OVER (PARTITION BY paper_id, page ORDER BY y0, pos) AS band FROM ord0",
    "ord": "SELECT * EXCLUDE (edges), row_number() OVER (PARTITION BY paper_id ORDER BY page, band, spans DESC, column_index, y0, pos) - 1 AS order_index FROM ord1",
    # which captions name which figure
    "ck0": f"SELECT c.paper_id, c.page, f.pos, c.text, row_number() OVER (PARTITION BY c.paper_id, c.page ORDER BY greatest(f.y0 - c.y1, c.y0 - f.y1, 0), c.pos, f.pos) AS rank FROM tx c JOIN fg f USING (paper_id, page) WHERE {_is_caption('c.text')} AND (least(c.x1, f.x1) - greatest(c.x0, f.x0)) / greatest(c.x1 - c.x0, 1) >= 0.5 AND greatest(f.y0 - c.y1, c.y0 - f.y1, 0) <= 24",
    "ck": f"SELECT paper_id, page, pos, CASE WHEN regexp_matches(text, '{_TABLE_CAPTION}') THEN 'table' ELSE 'figure' END AS kind FROM ck0 WHERE rank = 1",
    "al": "SELECT paper_id, page, pos, x0, y0, x1, y1, text, font_size, bold_ratio, false AS image, NULL::VARCHAR AS kind FROM tx UNION ALL SELECT paper_id, page, pos, x0, y0, x1, y1, '', NULL, 0.0, true, kind FROM fg LEFT JOIN ck USING (paper_id, page, pos)",
    "bs": "SELECT paper_id, page, median(font_size) AS body_size FROM (SELECT paper_id, page, font_size, unnest(range(0, length(" + _strip("text") + "))) FROM al WHERE NOT image) GROUP BY ALL",
    "cl": rf"""SELECT ord.*, body_size, CASE WHEN image THEN coalesce(kind, 'figure') WHEN {_is_caption('text')} THEN 'caption'
  WHEN length(text) <= 120 AND regexp_matches(text, '\S') AND (font_size >= coalesce(body_size, 10.0) * 1.12 OR bold_ratio >= 0.6) THEN 'heading' ELSE 'body' END AS region_type
  FROM ord LEFT JOIN bs USING (paper_id, page)""",
    "sc0": f"SELECT *, CASE WHEN region_type = 'heading' THEN {_section('text')} END AS found FROM cl",
    "rg": f"""SELECT * EXCLUDE (found), coalesce(last_value(CASE WHEN found <> 'unknown' THEN found END IGNORE NULLS) OVER w, 'title') AS section,
  coalesce(last_value(CASE WHEN found <> 'unknown' THEN {_strip('text')} END IGNORE NULLS) OVER w, '') AS section_title_raw, paper_id || '::region::' || order_index AS region_id
  FROM sc0 WINDOW w AS (PARTITION BY paper_id ORDER BY order_index ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
    # the fold over regions, then islands of short chunks
    "pr": r"SELECT *, row_number() OVER (PARTITION BY paper_id ORDER BY order_index) AS t FROM rg WHERE region_type = 'caption' OR (region_type IN ('heading', 'body') AND regexp_matches(text, '\S'))",
    "fold": """SELECT paper_id, t, 0 AS chunk, CASE WHEN region_type = 'caption' THEN 0 ELSE length(text) END AS held, section AS sec, region_type <> 'caption' AS open FROM pr WHERE t = 1
  UNION ALL SELECT p.paper_id, p.t, f.chunk + CAST(p.region_type = 'caption' OR NOT f.open OR p.section <> f.sec OR p.region_type = 'heading' OR f.held + length(p.text) > 1200 AS INTEGER),
    CASE WHEN p.region_type = 'caption' THEN 0 WHEN NOT f.open OR p.section <> f.sec OR p.region_type = 'heading' OR f.held + length(p.text) > 1200 THEN length(p.text) ELSE f.held + length(p.text) END,
    CASE WHEN p.region_type = 'caption' THEN f.sec WHEN NOT f.open OR p.section <> f.sec OR p.region_type = 'heading' OR f.held + length(p.text) > 1200 THEN p.section ELSE f.sec END, p.region_type <> 'caption'
  FROM fold f JOIN pr p ON p.paper_id = f.paper_id AND p.t = f.t + 1""",
    "rc": r"""SELECT paper_id, chunk, bool_or(region_type = 'caption') AS alone, first(section ORDER BY t) AS section, first(section_title_raw ORDER BY t) AS title,
  string_agg(text, chr(10) ORDER BY t) FILTER (regexp_matches(text, '\S')) AS text, min(page) AS p0, max(page) AS p1, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1
  FROM pr JOIN fold USING (paper_id, t) GROUP BY paper_id, chunk""",
    "isl": "SELECT *, sum(CAST(starts AS INTEGER)) OVER (PARTITION BY paper_id ORDER BY chunk) AS island FROM (SELECT *, alone OR length(text) >= 120 OR coalesce(lag(section) OVER (PARTITION BY paper_id ORDER BY chunk) <> section, true) AS starts FROM rc)",
    "ch": """SELECT paper_id, row_number() OVER (PARTITION BY paper_id ORDER BY island) - 1 AS order_index, * EXCLUDE (paper_id), paper_id || '::chunk::' || (row_number() OVER (PARTITION BY paper_id ORDER BY island) - 1) AS chunk_id,
  CAST(greatest(1, length(text) // 4) AS INTEGER) AS token_count FROM (SELECT paper_id, island, first(section ORDER BY chunk) AS section, first(title ORDER BY chunk) AS section_title_raw, string_agg(text, chr(10) ORDER BY chunk) AS text,
    first(p0 ORDER BY chunk) AS page_start, last(p1 ORDER BY chunk) AS page_end, bool_and(p0 = p1) FILTER (starts) AND min(p1) = max(p1) AS boxed,
    first(x0 ORDER BY chunk) AS x0, first(y0 ORDER BY chunk) AS y0, first(x1 ORDER BY chunk) AS x1, first(y1 ORDER BY chunk) AS y1 FROM isl GROUP BY paper_id, island)""",
    # artifacts: one figure or table a page at most, so nearest captions need no greedy matching
    "cp": "SELECT paper_id, a.region_id, trim(c.text) AS caption, row_number() OVER (PARTITION BY a.paper_id, a.page ORDER BY greatest(greatest(c.x0 - a.x1, a.x0 - c.x1, 0), greatest(c.y0 - a.y1, a.y0 - c.y1, 0)), a.region_id, c.region_id) AS rank FROM rg a JOIN rg c USING (paper_id, page) WHERE a.image AND c.region_type = 'caption' AND (least(a.x1, c.x1) - greatest(a.x0, c.x0)) / least(a.x1 - a.x0, c.x1 - c.x0) >= 0.5",
    "ar": "SELECT *, paper_id || '::artifact::' || n AS artifact_id FROM (SELECT rg.*, coalesce(caption, '') AS caption, row_number() OVER (PARTITION BY rg.paper_id ORDER BY order_index) - 1 AS n, row_number() OVER (PARTITION BY rg.paper_id, region_type ORDER BY order_index) AS k FROM rg LEFT JOIN (SELECT * FROM cp WHERE rank = 1) cp ON cp.region_id = rg.region_id WHERE image)",
    "ref": rf"""SELECT DISTINCT paper_id, id, CASE WHEN lower(m) LIKE 'fig%' THEN 'figure' WHEN lower(m) LIKE 'tab%' THEN 'table' ELSE 'equation' END AS kind, regexp_replace(n, '^0+(.)', '\1') AS num FROM
  (SELECT paper_id, id, m, unnest(regexp_extract_all(regexp_extract(m, '{_REFERENCE}', 2), '[0-9]+')) AS n FROM (SELECT paper_id, id, unnest(regexp_extract_all(text, '{_REFERENCE}')) AS m FROM cited))""",
    "lk": rf"""SELECT a.paper_id, artifact_id, r.id AS chunk_id FROM (SELECT *, CASE WHEN lower(caption) LIKE 'fig%' THEN 'figure' ELSE 'table' END AS kind2, regexp_replace(regexp_extract(caption, '[0-9]+'), '^0+(.)', '\1') AS num2 FROM ar WHERE regexp_matches(caption, '(?i)^(figure|fig|table|tab)s?\.?\s*[0-9]+')) a
  JOIN ref r ON r.paper_id = a.paper_id AND r.kind = a.kind2 AND r.num = a.num2""",
    # each artifact's first citing chunk, the pieces between mentions, and the first mention that names it
    "lf": "SELECT * FROM (SELECT a.paper_id, a.artifact_id, a.n, a.region_type, a.page, a.caption, c.chunk_id, c.order_index AS chunk, c.section, FLAT AS t, KIND AS kind, NUM AS num, row_number() OVER (PARTITION BY a.artifact_id ORDER BY c.order_index) AS link FROM ar a JOIN lk ON lk.artifact_id = a.artifact_id JOIN ch c ON c.chunk_id = lk.chunk_id) WHERE link = 1",
    "lm": rf"SELECT *, regexp_extract_all(t, '{_REFERENCE}') AS ms, string_split_regex(t, '{_REFERENCE}') AS ps FROM lf",
    "ln2": rf"SELECT *, list_position(list_transform(ms, lambda m: CASE WHEN lower(m) LIKE 'fig%' THEN 'figure' WHEN lower(m) LIKE 'tab%' THEN 'table' ELSE 'equation' END = kind AND list_contains(list_transform(regexp_extract_all(regexp_extract(m, '{_REFERENCE}', 2), '[0-9]+'), lambda d: regexp_replace(d, '^0+(.)', '\1')), num)), true) AS j FROM lm",
    "lp": "SELECT *, length(t) AS len, list_sum(list_transform(ps[1:j], lambda p: length(p))) + coalesce(list_sum(list_transform(ms[1:j - 1], lambda m: length(m))), 0) AS beg, length(ms[j]) AS k FROM ln2",
    "ls": "SELECT *, CASE WHEN greatest(0, beg - 62) > 0 THEN '… ' ELSE '' END || substring(t, CAST(greatest(0, beg - 62) AS BIGINT) + 1, CAST(beg - greatest(0, beg - 62) AS BIGINT)) AS before, ms[j] AS marked, substring(t, CAST(beg + k AS BIGINT) + 1, CAST(least(len, beg + k + 74) - beg - k AS BIGINT)) || CASE WHEN least(len, beg + k + 74) < len THEN ' …' ELSE '' END AS after FROM lp",
    # the lines before any recognised section, folded to a title
    "fr0": rf"SELECT paper_id, order_index, region_type = 'heading' AS heading, t, length(regexp_replace(t, '[^\p{{L}}]', '', 'g')) >= 4 AND t = upper(t) AS shouted, font_size, y0, y1 FROM (SELECT *, FLATTEXT AS t, max(CAST(section <> 'title' AS INTEGER)) OVER (PARTITION BY paper_id ORDER BY order_index ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS gone FROM rg) WHERE gone = 0 AND NOT (x1 > x0 AND y1 - y0 > x1 - x0)",
    "fr": "SELECT *, t <> '' AND CASE WHEN bool_or(heading) OVER (PARTITION BY paper_id) THEN heading ELSE shouted END AS fits, row_number() OVER (PARTITION BY paper_id ORDER BY order_index) AS k FROM fr0",
    "ft": """SELECT DISTINCT paper_id, 0::BIGINT AS k, '' AS title, NULL::DOUBLE AS size, 0.0::DOUBLE AS bottom, false AS done FROM fr
  UNION ALL SELECT f.paper_id, x.k, CASE WHEN f.done OR (f.title = '' AND NOT (x.fits AND length(x.t) <= 200)) THEN f.title WHEN f.title = '' THEN x.t WHEN GOES THEN f.title || ' ' || x.t ELSE f.title END,
    CASE WHEN NOT f.done AND f.title = '' AND x.fits AND length(x.t) <= 200 THEN x.font_size ELSE f.size END,
    CASE WHEN NOT f.done AND ((f.title = '' AND x.fits AND length(x.t) <= 200) OR (f.title <> '' AND GOES)) THEN x.y1 ELSE f.bottom END, f.done OR (f.title <> '' AND NOT GOES)
  FROM ft f JOIN fr x ON x.paper_id = f.paper_id AND x.k = f.k + 1""".replace(
        "GOES", "coalesce(x.fits AND abs(x.font_size - f.size) <= 0.6 AND x.y0 - f.bottom <= 2.0 * f.size AND length(f.title || ' ' || x.t) <= 200, false)"
    ),
    "tt": "SELECT p.paper_id, coalesce(title, '') AS title FROM (SELECT DISTINCT paper_id FROM rg) p LEFT JOIN (SELECT paper_id, arg_max(title, k) AS title FROM ft GROUP BY paper_id) USING (paper_id)",
    "bt": "SELECT paper_id, string_agg(raw || chr(10), '' ORDER BY i) AS text FROM ln GROUP BY paper_id",
    "bp": "SELECT paper_id, page, coalesce(sum(n) OVER (PARTITION BY paper_id ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM (SELECT paper_id, i // 12 AS page, sum(length(raw) + 1) AS n FROM ln GROUP BY ALL)",
    "bw": r"SELECT paper_id, row_number() OVER (PARTITION BY paper_id ORDER BY s) - 1 AS order_index, raw FROM (SELECT paper_id, s, substring(text, CAST(s AS INTEGER) + 1, 800) AS raw FROM (SELECT paper_id, text, unnest(range(0, length(text), 700)) AS s FROM bt)) WHERE regexp_matches(raw, '\S')",
    "sp": """SELECT paper_id, page, pos, 0 AS span_no, text, CASE WHEN role = 'heading' THEN 'Times-Bold' WHEN i % 4 = 1 THEN 'CMR9' ELSE 'Times-Roman' END AS font, font_size AS size, role, x0, y0, x1, y1 FROM tx
  UNION ALL SELECT paper_id, page, pos, 1, ' x + y = 1', 'CMMI10', 7.0, role, x0, y0, x1, y1 FROM tx WHERE i % 7 = 3""",
}


def _flat(c: str) -> str:
    return _strip(rf"regexp_replace({c}, '\s+', ' ', 'g')")


# expressions that layers share, filled in here so that they stand written once
_LABEL = rf"regexp_extract(a.caption, '^{_REFERENCE.removeprefix('(?i)' + chr(92) + 'b')}', GROUP, 'i')"
SHARED["lf"] = (
    SHARED["lf"]
    .replace("FLAT", _flat("c.text"))
    .replace("KIND", "CASE WHEN lower(a.caption) LIKE 'fig%' THEN 'figure' WHEN lower(a.caption) LIKE 'tab%' THEN 'table' ELSE 'equation' END")
    .replace("NUM", rf"regexp_replace(regexp_extract({_LABEL.replace('GROUP', '2')}, '^[0-9]+'), '^0+(.)', '\1')")
)
SHARED["fr0"] = SHARED["fr0"].replace("FLATTEXT", _flat("text"))


def _with(body: str, **own: str) -> str:
    """``body`` with the shared layers that it needs, in an order that defines them first.
    own: layers that this query defines itself."""
    layers = {**SHARED, **own}
    need: list[str] = []

    def visit(text: str, above: tuple[str, ...]) -> None:
        for n in layers:
            if n in above or n in need:
                continue
            if re.search(rf"\b(FROM|JOIN)\s+{n}\b|, {n}\b(?= )", text):
                visit(layers[n], (*above, n))
                need.append(n)

    visit(body, ())
    if not need:
        return body
    return "WITH RECURSIVE " + ",\n".join(f"{n} AS ({layers[n]})" for n in need) + "\n" + body


_ALL = {"bl": "SELECT * FROM al"}
_TEXT_ONLY = {"bl": "SELECT * FROM tx"}
_IN_CHUNKS = {**_ALL, "cited": "SELECT paper_id, chunk_id AS id, text FROM ch"}


def oracle_sql() -> dict[str, str]:
    box = "x0, y0, x1, y1"
    px = lambda c: f"round({c} * (200 / 72.0::DOUBLE), 3)"
    title = r"regexp_extract(coalesce(html, ''), '<title>((?s:.)*?)</title>', 1)"
    board = lambda key: f"{key}, count(*) AS chunks, count(*) FILTER (section = 'unknown') AS unknown, count(*) FILTER ({_mid('text')}) AS mid_word"
    shares = f"*, {_percent('unknown', 'chunks')} AS unknown_share, {_percent('mid_word', 'chunks')} AS mid_word_share"
    kinds = ("heading", "body", "caption", "figure", "table", "equation")
    per_kind = ", ".join(f"count(*) FILTER (region_type = '{k}') AS \"{k}\"" for k in kinds)
    totals = ", ".join(f'CAST(sum("{k}") AS BIGINT) AS "{k}"' for k in kinds)
    spread = "greatest(greatest(a.x0 - r.x1, r.x0 - a.x1, 0), greatest(a.y0 - r.y1, r.y0 - a.y1, 0))"
    problems = {
        "pc": f"""SELECT paper_id, page, max(CAST(regexp_matches(text, '\\S') AS INTEGER)) AS has_text, count(*) FILTER (region_type = 'caption') AS captions, count(*) FILTER (image) AS arts,
  greatest((max(x1) - min(x0)) * (max(y1) - min(y0)), 1) AS area FROM rg GROUP BY ALL""",
        "st": f"SELECT paper_id, page, count(*) AS stray FROM rg r WHERE region_type = 'body' AND length({_strip('text')}) <= 25 AND EXISTS (SELECT 1 FROM rg a WHERE a.image AND a.paper_id = r.paper_id AND a.page = r.page AND {spread} <= 30) GROUP BY ALL",
        "gi": "SELECT paper_id, page, arg_min(region_type, order_index) AS giant FROM rg JOIN pc USING (paper_id, page) WHERE NOT image AND greatest(x1 - x0, 0) * greatest(y1 - y0, 0) / area >= 0.6 GROUP BY ALL",
        "pp": """SELECT paper_id, page, list_filter([CASE WHEN has_text = 0 THEN 'no-text-layer' END, CASE WHEN stray >= 4 THEN stray || ' tiny BODY regions around an artifact' END,
  CASE WHEN giant IS NOT NULL THEN 'a ' || upper(giant) || ' region covers the page' END, CASE WHEN captions > 0 AND arts = 0 THEN 'a caption with nothing to caption' END], lambda z: z IS NOT NULL) AS problems
  FROM pc LEFT JOIN st USING (paper_id, page) LEFT JOIN gi USING (paper_id, page)""",
        "rep": f"""SELECT paper_id, count(DISTINCT page) AS pages, count(*) AS regions, {per_kind}, coalesce(any_value(flagged), 0) AS flagged, count(*) FILTER (region_type = 'heading') = 0 AS no_headings
  FROM rg LEFT JOIN (SELECT paper_id, count(*) AS flagged FROM pp WHERE len(problems) > 0 GROUP BY 1) USING (paper_id) GROUP BY paper_id""",
    }
    image = {"pi": "SELECT paper_id, page AS page_index, printf('%s/pages/page_%04d.png', paper_id, page) AS image_path, 1700 AS width_px, 2200 AS height_px, 200 AS dpi FROM pg"}
    absorbed = {
        "bx": "SELECT paper_id, page, pos, x0, 215.0 AS y0, x1, 390.0 AS y1 FROM fg",
        "ab": f"SELECT t.paper_id, t.page, t.pos, min(b.pos) AS host, any_value(t.text) AS text FROM tx t JOIN bx b USING (paper_id, page) WHERE NOT {_is_caption('t.text')} AND least(t.x1, b.x1) > greatest(t.x0, b.x0) AND least(t.y1, b.y1) > greatest(t.y0, b.y0) AND (least(t.x1, b.x1) - greatest(t.x0, b.x0)) * (least(t.y1, b.y1) - greatest(t.y0, b.y0)) / ((t.x1 - t.x0) * (t.y1 - t.y0)) >= 0.7 GROUP BY ALL",
    }
    rules = {
        "dr": "SELECT paper_id, page, y0 - 2 AS y, x0, x1 FROM tx WHERE i % 4 = 0 UNION ALL SELECT paper_id, page, 630.0, x0, x1 FROM fg",
        "ru": "SELECT * FROM dr WHERE x1 - x0 >= 612 * 0.25 AND NOT EXISTS (SELECT 1 FROM fg f WHERE f.paper_id = dr.paper_id AND f.page = dr.page AND y BETWEEN f.y0 AND f.y1 AND (least(dr.x1, f.x1) - greatest(dr.x0, f.x0)) / (dr.x1 - dr.x0) >= 0.9)",
        "ri": "SELECT *, sum(CAST(b AS INTEGER)) OVER (PARTITION BY paper_id, page ORDER BY y, x0, x1) AS g FROM (SELECT *, NOT coalesce((least(x1, lag(x1) OVER w) - greatest(x0, lag(x0) OVER w)) / least(x1 - x0, lag(x1) OVER w - lag(x0) OVER w) > 0.5 AND y - lag(y) OVER w <= 350, false) AS b FROM ru WINDOW w AS (PARTITION BY paper_id, page ORDER BY y, x0, x1))",
        "rt": "SELECT paper_id, page, min(x0) AS x0, min(y) AS y0, max(x1) AS x1, max(y) AS y1 FROM ri GROUP BY paper_id, page, g HAVING count(*) >= 2",
    }
    crop = {
        "pad": """SELECT a.paper_id, a.region_id, a.x0, a.y0, a.x1, a.y1,
    least(6, coalesce(min(CASE WHEN v AND o.x1 <= a.x0 THEN (a.x0 - o.x1) / 2 END), 6)) AS l, least(6, coalesce(min(CASE WHEN v AND o.x1 > a.x0 AND o.x0 >= a.x1 THEN (o.x0 - a.x1) / 2 END), 6)) AS r,
    least(6, coalesce(min(CASE WHEN h AND o.y1 <= a.y0 THEN (a.y0 - o.y1) / 2 END), 6)) AS u, least(6, coalesce(min(CASE WHEN h AND o.y1 > a.y0 AND o.y0 >= a.y1 THEN (o.y0 - a.y1) / 2 END), 6)) AS d
  FROM ar a LEFT JOIN LATERAL (SELECT o.*, least(a.y1, o.y1) > greatest(a.y0, o.y0) AS v, least(a.x1, o.x1) > greatest(a.x0, o.x0) AS h FROM rg o WHERE o.paper_id = a.paper_id AND o.page = a.page AND o.region_id <> a.region_id) o ON true GROUP BY ALL""",
        "cb": "SELECT paper_id, region_id, greatest(0, x0 - l) AS x0, greatest(0, y0 - u) AS y0, least(612, x1 + r) AS x1, least(792, y1 + d) AS y1 FROM pad",
    }
    base = {"bc": f"SELECT paper_id, order_index, {_strip('raw')} AS text FROM bw"}
    _mid_text = _mid("text")
    body = f"""{_strip("regexp_replace(t, '\\s+', ' ', 'g')")}"""
    q = {
        "baseline_windows": f"SELECT doc_id, order_index, CAST(length(raw) AS INTEGER) AS chars, sha1({_strip('raw')}) AS text_sha1, CAST({_words('raw')} AS INTEGER) AS token_count, {_mid('raw')} AS mid_word FROM (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY s) - 1 AS order_index, raw FROM (SELECT doc_id, s, substring(text, CAST(s AS INTEGER) + 1, 800) AS raw FROM (SELECT doc_id, text, unnest(range(0, length(text), 700)) AS s FROM documents)) WHERE regexp_matches(raw, '\\S'))",
        "baseline_pages": _with(f"SELECT b.paper_id || '::chunk::' || order_index AS chunk_id, b.paper_id, order_index, (SELECT max(page) FROM bp p WHERE p.paper_id = b.paper_id AND start <= order_index * 700) AS page_start, (SELECT max(page) FROM bp p WHERE p.paper_id = b.paper_id AND start <= greatest(order_index * 700 + length(raw) - 1, order_index * 700)) AS page_end, CAST({_words('raw')} AS INTEGER) AS token_count FROM bw b"),
        "midword_share": f"SELECT {shares} FROM (SELECT {board('source')} FROM (SELECT source, 'unknown' AS section, substring(text, CAST(s AS INTEGER) + 1, 800) AS text FROM (SELECT source, text, unnest(range(0, length(text), 700)) AS s FROM documents)) WHERE regexp_matches(text, '\\S') GROUP BY source)",
        "window_sweep": f"SELECT size, count(*) AS chunks, count(*) FILTER ({_mid('raw')}) AS mid_word FROM (" + " UNION ALL ".join(f"SELECT {n} AS size, substring(text, CAST(s AS INTEGER) + 1, {n}) AS raw FROM (SELECT text, unnest(range(0, length(text), {n - 100})) AS s FROM documents)" for n in (400, 800, 1200, 2000, 4000)) + ") WHERE regexp_matches(raw, '\\S') GROUP BY size",
        "paper_ids": "SELECT page_id, 'page-' || page_id || '-' || substring(sha1(coalesce(html, '')), 1, 12) AS paper_id, true AS accepted FROM pages",
        "clean_titles": f"SELECT page_id, CASE WHEN lower(t) IN ('', {', '.join(repr(x) for x in X.GENERIC_TITLES)}) OR starts_with(lower(t), 'microsoft word - ') OR lower(t) IN (page_id || '.pdf', '' || page_id) THEN NULL ELSE t END AS title FROM (SELECT page_id, {_strip('r')} AS t FROM (SELECT page_id, CASE WHEN page_id % 10 = 0 THEN ' Untitled ' WHEN page_id % 10 = 1 THEN page_id || '.pdf' ELSE {title} END AS r FROM pages))",
        "safe_names": f"SELECT page_id, CASE WHEN t = '' THEN page_id || '.pdf' ELSE page_id || '_' || t || '.pdf' END AS name FROM (SELECT page_id, substring(regexp_replace(regexp_replace({title}, '[^A-Za-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g'), 1, 60) AS t FROM pages)",
        "heading_class": _with(f"SELECT paper_id, i, {_section('text')} AS plain, {_section(chr(39) + '2.1 Our ' + chr(39) + ' || nm')} AS filler, {_section(chr(39) + 'IV. ' + chr(39) + ' || nm || ' + chr(39) + ' and Motivation' + chr(39))} AS combined, {_section(chr(39) + 'On ' + chr(39) + ' || nm')} AS buried, trim(regexp_replace(text, '^\\s*([0-9]+(\\.[0-9]+)*|[IVXLC]+|[A-Z])[.)]?\\s+', '')) AS bare FROM (SELECT *, regexp_replace(text, '^\\d+\\. ', '') AS nm FROM tx WHERE role = 'heading')"),
        "coverage_gutters": _with('SELECT paper_id, page, start, "end" FROM gut', **_TEXT_ONLY),
        "reading_order": _with("SELECT paper_id, page, i, CAST(column_index AS INTEGER) AS column_index, order_index FROM ord", **_TEXT_ONLY),
        "table_rules": _with("SELECT * FROM rt WHERE EXISTS (SELECT 1 FROM tx t WHERE t.paper_id = rt.paper_id AND t.page = rt.page AND least(t.x1, rt.x1) > greatest(t.x0, rt.x0) AND least(t.y1, rt.y1) > greatest(t.y0, rt.y0) AND (least(t.x1, rt.x1) - greatest(t.x0, rt.x0)) * (least(t.y1, rt.y1) - greatest(t.y0, rt.y0)) / ((t.x1 - t.x0) * (t.y1 - t.y0)) >= 0.7)", **rules),
        "image_merge": _with("SELECT paper_id, page, pos AS block_no, x0, y0, x1, y1 FROM fg"),
        "body_size": _with("SELECT paper_id, page, body_size FROM bs"),
        "font_profile": _with("SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY paper_id, page, block_no ORDER BY chars DESC, font, size) AS INTEGER) AS rank FROM (SELECT paper_id, page, pos AS block_no, font, size, sum(length(text)) AS chars FROM sp GROUP BY ALL)) WHERE rank <= 4"),
        "font_totals": _with("SELECT paper_id, page, font, size, sum(length(text)) AS chars FROM sp GROUP BY ALL"),
        "block_measures": _with(f"SELECT paper_id, page, pos AS block_no, sha1({_strip('t')}) AS text_sha1, CASE WHEN a >= m THEN z ELSE 7.0 END AS font_size, round(bold / tot, 9) AS bold_ratio, round(CASE WHEN m2 > 0 AND tot <= 200 THEN (m2 + weak) / tot ELSE m2 / tot END, 9) AS math_ratio FROM (SELECT paper_id, page, pos, string_agg(text, '' ORDER BY span_no) AS t, sum(length({_strip('text')})) AS tot, coalesce(sum(length(text)) FILTER (span_no = 0), 0) AS a, coalesce(sum(length(text)) FILTER (span_no = 1), 0) AS m, coalesce(sum(length({_strip('text')})) FILTER (font = 'CMMI10'), 0) AS m2, coalesce(sum(length({_strip('text')})) FILTER (font = 'CMR9'), 0) AS weak, coalesce(sum(length({_strip('text')})) FILTER (font = 'Times-Bold'), 0) AS bold, any_value(size) FILTER (span_no = 0) AS z FROM sp GROUP BY ALL)"),
        "page_furniture": _with("SELECT paper_id, page, pos FROM (SELECT *, pos % 12 = 10 AND page % 3 = 0 AS foot FROM tx) WHERE NOT ((foot OR regexp_matches(text, '^[\\s\\-–—\\[\\(]*([0-9]+|[ivxlcIVXLC]+)[\\s\\-–—\\]\\)\\.]*$')) AND (CASE WHEN foot THEN 752 ELSE y1 END <= 72 OR CASE WHEN foot THEN 740 ELSE y0 END >= 720))"),
        "classify_blocks": _with("SELECT paper_id, order_index, region_type, CAST(column_index AS INTEGER) AS column_index, sha1(text) AS text_sha1 FROM cl", **_ALL),
        "absorb_text": _with("SELECT paper_id, page, bx.pos, sha1(coalesce(a, '')) AS absorbed_sha1, CAST(length(coalesce(a, '')) AS INTEGER) AS chars FROM bx LEFT JOIN (SELECT paper_id, page, host AS pos, string_agg(text, chr(10) ORDER BY pos) AS a FROM ab GROUP BY ALL) USING (paper_id, page, pos)", **absorbed),
        "absorb_rest": _with("SELECT paper_id, page, pos FROM tx WHERE NOT EXISTS (SELECT 1 FROM ab WHERE ab.paper_id = tx.paper_id AND ab.page = tx.page AND ab.pos = tx.pos)", **absorbed),
        "caption_kinds": _with("SELECT paper_id, page, pos, kind FROM ck"),
        "figure_merge": _with("SELECT paper_id, page, x0 + 10 AS x0, 560.0::DOUBLE AS y0, x0 + 120 AS x1, 630.0::DOUBLE AS y1 FROM fg"),
        "equation_merge": _with("SELECT paper_id, page, x0, y0, CASE WHEN i % 7 = 3 THEN x0 + 52 ELSE x1 END AS x1, y1, sha1(CASE WHEN i % 7 = 3 THEN 'x' || chr(10) || '+' || chr(10) || 'y' ELSE text END) AS text_sha1 FROM tx"),
        "section_carry": _with("SELECT paper_id, order_index, section, section_title_raw FROM rg", **_ALL),
        "chunks": _with("SELECT chunk_id, section, section_title_raw, sha1(text) AS text_sha1, page_start, page_end, CASE WHEN boxed THEN x0 END AS x0, CASE WHEN boxed THEN y0 END AS y0, CASE WHEN boxed THEN x1 END AS x1, CASE WHEN boxed THEN y1 END AS y1, order_index, token_count FROM ch", **_ALL),
        "caption_pairs": _with("SELECT region_id AS artifact_region, sha1(caption) AS caption_sha1 FROM cp WHERE rank = 1", **_ALL),
        "artifacts": _with(f"SELECT artifact_id, region_type AS artifact_type, sha1(caption) AS caption_sha1, page, {box}, printf('%s/artifacts/%s_%02d.png', paper_id, CASE WHEN region_type = 'figure' THEN 'fig' ELSE 'tbl' END, k) AS image_path FROM ar", **_ALL),
        "crop_boxes": _with("SELECT region_id, round(x0, 6) AS x0, round(y0, 6) AS y0, round(x1, 6) AS x1, round(y1, 6) AS y1, CAST(greatest(0, floor(x0 * 200 / 72)) AS INTEGER) AS px0, CAST(greatest(0, floor(y0 * 200 / 72)) AS INTEGER) AS py0, CAST(least(1700, round_even(x1 * 200 / 72, 0)) AS INTEGER) AS px1, CAST(least(2200, round_even(y1 * 200 / 72, 0)) AS INTEGER) AS py1 FROM cb", **_ALL, **crop),
        "page_images": _with("SELECT * FROM pi", **image),
        "refs": _with("SELECT paper_id, id AS i, kind, num FROM ref", cited="SELECT paper_id, i AS id, text FROM tx"),
        "links": _with("SELECT paper_id, artifact_id, chunk_id FROM lk", **_IN_CHUNKS),
        "page_checks": _with("SELECT paper_id, page, array_to_string(problems, '; ') AS problems FROM pp", **_ALL, **problems),
        "paper_report": _with("SELECT * FROM rep", **_ALL, **problems),
        "corpus_totals": _with(f"SELECT count(*) AS papers, count(*) FILTER (flagged > 0) AS flagged_papers, {totals} FROM rep", **_ALL, **problems),
        "run_scoreboard": _with(f"SELECT {shares} FROM (SELECT {board('run')} FROM (SELECT 'baseline' AS run, 'unknown' AS section, text FROM bc UNION ALL SELECT 'layout', section, text FROM ch) GROUP BY run)", **_ALL, **base),
        "region_tally": _with("SELECT paper_id, region_type, count(*) AS regions FROM rg GROUP BY ALL", **_ALL),
        "busiest_pages": _with("SELECT paper_id, first(page ORDER BY n DESC, seen) AS busiest, array_to_string((list(page ORDER BY page))[1:10], ',') AS pages FROM (SELECT paper_id, page, count(*) AS n, min(order_index) AS seen FROM rg GROUP BY ALL) GROUP BY paper_id", **_ALL),
        "section_run": _with("SELECT paper_id, row_number() OVER (PARTITION BY paper_id ORDER BY f) - 1 AS place, section, regions, title FROM (SELECT paper_id, section, min(order_index) AS f, count(*) AS regions, coalesce(first(section_title_raw ORDER BY order_index) FILTER (section_title_raw <> ''), '') AS title FROM rg GROUP BY ALL)", **_ALL),
        "chunk_stats": _with("SELECT paper_id, count(*) AS chunks, count(*) FILTER (section <> 'unknown') AS placed, CAST(sum(token_count) AS BIGINT) AS tokens FROM ch GROUP BY ALL", **_ALL),
        "chunk_preview": _with(f"SELECT paper_id, order_index, section, CAST(length(text) AS INTEGER) AS chars, page_start + 1 AS page, CASE WHEN rest <> '' THEN head ELSE '' END AS head, substring({body}, 1, 210) || CASE WHEN length(t) > 210 THEN ' …' ELSE '' END AS body FROM (SELECT *, CASE WHEN rest <> '' THEN rest ELSE head END AS t FROM (SELECT *, split_part(text, chr(10), 1) AS head, substring(text, length(split_part(text, chr(10), 1)) + 2) AS rest FROM ch WHERE " + _below("order_index", 4) + "))", **_ALL),
        "artifact_summary": _with("SELECT paper_id, region_type AS artifact_type, count(*) AS artifacts, count(*) AS cropped FROM ar GROUP BY ALL", **_ALL),
        "kwic": _with("SELECT paper_id, artifact_id, chunk_id, before, marked, after FROM ls", **_IN_CHUNKS),
        "link_previews": _with("SELECT paper_id, place, region_type AS artifact_type, page + 1 AS page, chunk, replace(section, '_', ' ') AS section, sha1(substring(caption, 1, 90)) AS caption_sha1, sha1(before || '|' || marked || '|' || after) AS passage_sha1 FROM (SELECT *, row_number() OVER (PARTITION BY paper_id ORDER BY n) - 1 AS place FROM ls) WHERE " + _below("place", 4), **_IN_CHUNKS),
        "paper_titles": _with("SELECT paper_id, title FROM tt", **_ALL),
        "paper_cards": _with("SELECT paper_id, title, coalesce(p.n, 0) AS pages, coalesce(c.n, 0) AS chunks, coalesce(a.n, 0) AS artifacts FROM tt LEFT JOIN (SELECT paper_id, count(*) AS n FROM pg GROUP BY 1) p USING (paper_id) LEFT JOIN (SELECT paper_id, count(*) AS n FROM ch GROUP BY 1) c USING (paper_id) LEFT JOIN (SELECT paper_id, count(*) AS n FROM ar GROUP BY 1) a USING (paper_id)", **_ALL),
        "artifact_tiles": _with("SELECT paper_id, n AS place, region_type AS artifact_type, page + 1 AS page, sha1(CASE WHEN caption = '' THEN 'No caption printed beside it.' ELSE substring(caption, 1, 120) END) AS caption, printf('%s/artifacts/%s_%02d.png', paper_id, CASE WHEN region_type = 'figure' THEN 'fig' ELSE 'tbl' END, k) AS image_path FROM ar WHERE " + _below("n", 8), **_ALL),
        "overlay_legend": _with("SELECT paper_id, page, region_type, count(*) AS regions FROM rg GROUP BY ALL", **_ALL),
        "link_stats": _with("SELECT a.paper_id, a.n AS artifacts, coalesce(l.linked, 0) AS linked, a.n - coalesce(l.linked, 0) AS unlinked, coalesce(l.mentions, 0) AS mentions, coalesce(l.citing, 0) AS citing FROM (SELECT paper_id, count(*) AS n FROM ar GROUP BY 1) a LEFT JOIN (SELECT paper_id, count(DISTINCT artifact_id) AS linked, count(*) AS mentions, count(DISTINCT chunk_id) AS citing FROM lk GROUP BY 1) l USING (paper_id)", **_IN_CHUNKS),
        "overlay": _with(f"SELECT paper_id, page, row_number() OVER (PARTITION BY paper_id, page ORDER BY order_index) AS badge, region_type, {px('x0')} AS px0, {px('y0')} AS py0, {px('x1')} AS px1, {px('y1')} AS py1 FROM rg", **_ALL),
        "gallery": _with("SELECT paper_id, page, '/paper/' || paper_id || '/page/' || page AS href FROM pg"),
        "page_strip": _with("SELECT paper_id, count(*) AS pages, array_to_string((list(image_path ORDER BY page_index))[1:12], ',') AS shown FROM pi GROUP BY ALL", **image),
        "headline": _with(f"SELECT r.paper_id, regions, sections, coalesce(c.n, 0) AS chunks, coalesce(placed, 0) AS placed, coalesce(a.n, 0) AS artifacts, coalesce(bm, '—') AS baseline_mid_word, coalesce(lm, '—') AS layout_mid_word FROM (SELECT paper_id, count(*) AS regions, count(DISTINCT section) FILTER (section <> 'unknown') AS sections FROM rg GROUP BY 1) r LEFT JOIN (SELECT paper_id, count(*) AS n, count(*) FILTER (section <> 'unknown') AS placed, {_percent(f'(count(*) FILTER ({_mid_text}))', 'count(*)')} AS lm FROM ch GROUP BY 1) c USING (paper_id) LEFT JOIN (SELECT paper_id, count(*) AS n FROM ar GROUP BY 1) a USING (paper_id) LEFT JOIN (SELECT paper_id, {_percent(f'(count(*) FILTER ({_mid_text}))', 'count(*)')} AS bm FROM bc GROUP BY 1) b USING (paper_id)", **_ALL, **base),
        "exemplars": _with(f"SELECT coalesce(b.paper_id, w.paper_id) AS paper_id, sha1(broken) AS broken_sha1, sha1(whole) AS whole_sha1 FROM (SELECT paper_id, arg_min(text, order_index) AS broken FROM bc WHERE {_mid('text')} GROUP BY 1) b FULL JOIN (SELECT paper_id, arg_min(text, order_index) AS whole FROM ch WHERE section <> 'unknown' AND contains(text, chr(10)) GROUP BY 1) w ON b.paper_id = w.paper_id", **_ALL, **base),
        "comparison": _with("SELECT paper_id, run, order_index, section, page, CAST(length(text) AS INTEGER) AS chars, CASE WHEN length(text) > 260 THEN substring(text, 1, 260) || ' …' ELSE text END AS shown FROM (SELECT b.paper_id, 'baseline' AS run, order_index, 'unknown' AS section, (SELECT max(page) FROM bp p WHERE p.paper_id = b.paper_id AND start <= order_index * 700) AS page, text FROM bc b WHERE BELOW UNION ALL SELECT paper_id, 'layout', order_index, section, page_start, text FROM ch WHERE BELOW)".replace("BELOW", _below("order_index", 12)), **_ALL, **base),
        "file_sizes": "SELECT page_id, CASE WHEN n IS NULL OR n = 0 THEN '—' WHEN n / 1048576.0::DOUBLE >= 1 THEN printf('%.1f MB', n / 1048576.0::DOUBLE) ELSE printf('%.0f KB', n / 1024.0::DOUBLE) END AS size FROM (SELECT page_id, octet_length(encode(html)) AS n FROM pages)",
    }
    return q
