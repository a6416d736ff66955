"""DuckDB SQL of the core queries, written apart from the Spark plans."""

from __future__ import annotations

from foliora.functions.text import ARABIC_DIGITS, ARABIC_UNITS, DIGITS, PERSIAN_DIGITS
from foliora.sources.files import KNOWN_NAMES

R = "(SELECT DISTINCT ON (region_key) region_key, doc_id, page, region_id, bbox, lower(trim(script)) AS script, confidence, coalesce(text, '') AS text FROM regions)"
S = "(SELECT DISTINCT ON (result_id) * FROM results)"
J = "(SELECT DISTINCT seq, job_id, source_file, pages_processed, status FROM jobs)"
NB = r"[^\p{L}\p{N}_]"
W = r"[\s\x{1c}-\x{1f}\x{85}\p{Z}]"
AR = r"\x{0600}-\x{06FF}\x{FB50}-\x{FDFF}\x{FE70}-\x{FEFF}"


def digits(t: str) -> str:
    return f"translate({t}, '{ARABIC_DIGITS}{PERSIAN_DIGITS}', '{DIGITS}{DIGITS}')"


def units(t: str) -> str:
    rules = [("mq|Mq|mQ|MQ", "mg"), ("[mM][cC]G|[mM]Cg|Mcg", "mcg"), ("µg", "mcg"), ("iu|Iu|iU", "IU"), ("ml|Ml|ML", "mL"), ("l", "L")]
    for wrong, right in rules:
        for _ in range(2):  # neighbours share a boundary
            t = f"regexp_replace({t}, '(^|{NB})(?:{wrong})({NB}|$)', '\\1{right}\\2', 'g')"
    return f"regexp_replace({t}, '(\\p{{Nd}})(mg|mL|mcg|IU|g|L|%)', '\\1 \\2', 'g')"


def arabic(t: str) -> str:
    for name, unit in ARABIC_UNITS:
        t = f"replace({t}, '{name}', '{unit}')"
    return t


def strip(t: str) -> str:
    return f"regexp_replace(regexp_replace({t}, '^{W}+', ''), '{W}+$', '')"


def conf(t: str) -> str:
    return f"CASE WHEN length({t}) = 0 THEN 0.0::DOUBLE WHEN length({t}) < 10 THEN 0.4::DOUBLE WHEN length({t}) > 50 THEN 0.92::DOUBLE WHEN {t} IS NULL THEN NULL ELSE 0.75::DOUBLE END"


def n_of(t: str, chars: str) -> str:
    return f"length(regexp_replace({t}, '[^{chars}]', '', 'g'))"


def script(t: str) -> str:
    a, n = n_of(t, AR), n_of(t, "a-zA-Z")
    return f"CASE WHEN {a} + {n} = 0 THEN 'unknown' WHEN {a} / ({a} + {n})::DOUBLE > 0.7 THEN 'arabic' WHEN {a} / ({a} + {n})::DOUBLE < 0.3 THEN 'latin' ELSE 'mixed' END"


UNITS_RE = "mg|ml|mcg|iu|g|l|%|مجم|مل|جم"
STRENGTH = rf"(?i)(\p{{Nd}}+(?:[.,]\p{{Nd}}+)?){W}*({UNITS_RE})"
SUFFIX = "(['.pdf', '.JPG', '.jpeg', '.png', '.tiff', '.tif', '.bmp', '.webp', '.docx', ''])[result_id % 10 + 1]"
FILES = f"(SELECT result_id, CASE WHEN ends_with(source_file, '.pdf') THEN left(source_file, length(source_file) - 4) ELSE source_file END AS base, {SUFFIX} AS suf FROM {S})"
BOXES = f"(SELECT region_key, bbox.w AS w, bbox.h AS h, CASE WHEN script IN ('arabic', 'latin', 'mixed') THEN script ELSE 'mixed' END AS script FROM {R} WHERE bbox IS NOT NULL AND bbox.w IS NOT NULL AND bbox.h IS NOT NULL)"
ROUTED = f"(SELECT *, CASE WHEN script IN ('arabic', 'latin', 'mixed') THEN CASE WHEN region_key % 13 = 0 THEN 'skipped' WHEN script = 'mixed' THEN 'both' ELSE script END ELSE 'none' END AS route FROM {R})"
ANSWERS = f"(SELECT result_id, full_text_english AS en, full_text_arabic AS ar FROM {S})"
CHILDREN = f"""(SELECT r.*, coalesce(s.n, 0) AS ns, coalesce(m.n, 0) AS nm, s.vals, s.v1, s.u1, s.f, m.lines, m.first_inn FROM {S} r
 LEFT JOIN (SELECT result_id, count(*) AS n, true AS f, first(value ORDER BY strength_id) AS v0, arg_min(struct_pack(v := value), strength_id).v AS v1, arg_min(struct_pack(v := unit), strength_id).v AS u1,
   string_agg('- ' || coalesce(value, '') || ' ' || coalesce(unit, ''), chr(10) ORDER BY strength_id) AS vals
   FROM (SELECT DISTINCT ON (strength_id) * FROM strengths WHERE result_id IS NOT NULL) GROUP BY 1) s ON s.result_id = r.result_id
 LEFT JOIN (SELECT result_id, count(*) AS n, arg_min(struct_pack(v := matched), match_id).v AS first_inn,
   string_agg('- `' || coalesce(input, '') || '` → **' || coalesce(matched, '') || '** (score: ' || coalesce(CAST(CAST(round_even(score, 0) AS BIGINT) AS VARCHAR), '0') || '%)', chr(10) ORDER BY match_id) AS lines
   FROM (SELECT DISTINCT ON (match_id) * FROM inn_matches WHERE result_id IS NOT NULL AND is_valid) GROUP BY 1) m ON m.result_id = r.result_id)"""
FLAGS = "coalesce(regions_flagged_for_review, [])"
NL = "chr(10)"


def _markdown() -> str:
    title = "'# Extraction Report' || chr(10) || chr(10) || '**Source:** `' || coalesce(nullif(source_file, ''), 'unknown') || '`  '"
    title += " || chr(10) || '**Pages processed:** ' || coalesce(CAST(pages_processed AS VARCHAR), 'None') || '  ' || chr(10) || '**Regions flagged for review:** ' || CAST(len(" + FLAGS + ") AS VARCHAR) || chr(10)"
    names = f"CASE WHEN nm > 0 THEN {NL} || '## Identified Drug Names (INN Match)' || {NL} || {NL} || lines || {NL} ELSE '' END"
    doses = f"CASE WHEN ns > 0 THEN {NL} || '## Detected Strengths / Doses' || {NL} || {NL} || vals || {NL} ELSE '' END"
    ar = f"CASE WHEN coalesce(full_text_arabic, '') <> '' THEN {NL} || '## ' || chr(8207) || 'النص العربي (Arabic Content)' || {NL} || {NL} || full_text_arabic || {NL} ELSE '' END"
    en = f"CASE WHEN coalesce(full_text_english, '') <> '' THEN {NL} || '## English Content' || {NL} || {NL} || full_text_english || {NL} ELSE '' END"
    fl = f"CASE WHEN len({FLAGS}) > 0 THEN {NL} || '## Regions Requiring Manual Review' || {NL} || {NL} || array_to_string(list_transform({FLAGS}, lambda x: '- Region ID `' || CAST(x AS VARCHAR) || '`'), {NL}) || {NL} ELSE '' END"
    return f"SELECT result_id, {title} || {names} || {doses} || {ar} || {en} || {fl} AS markdown FROM {CHILDREN}"


def _text(expr: str, name: str = "text") -> str:
    return f"SELECT region_key, {expr} AS {name} FROM {R}"


CLEAN = arabic(units(digits("text")))
# a neighbour of a unit name can be a part of the next match: the replacement is applied twice
STRICT = units(digits("text"))
for _name, _unit in sorted(ARABIC_UNITS, key=lambda u: -len(u[0])):
    for _ in range(2):
        STRICT = f"regexp_replace({STRICT}, '(\\p{{Nd}})({W}*){_name}([^\\p{{L}}\\p{{M}}]|$)', '\\1\\2{_unit}\\3', 'g')"
LAST = f"(SELECT DISTINCT ON (job_id) * FROM {J} ORDER BY job_id, seq DESC)"
STRENGTHS = f"(SELECT region_key, regexp_extract_all({units(digits('text'))}, '{STRENGTH}', 1) AS v, regexp_extract_all({units(digits('text'))}, '{STRENGTH}', 2) AS u, regexp_extract_all({units(digits('text'))}, '{STRENGTH}', 0) AS r FROM {R})"
TOKENS = f"(SELECT region_key, unnest(toks) AS input, unnest(range(len(toks))) AS pos FROM (SELECT region_key, regexp_extract_all(text, '[a-zA-Z\\x{{0600}}-\\x{{06FF}}]{{4,}}') AS toks FROM {R}))"
MERGED = f"(SELECT result_id, {strip('coalesce(en, chr(32))')} AS e, {strip('coalesce(ar, chr(32))')} AS a, coalesce({conf('en')}, 0.0) AS ec, coalesce({conf('ar')}, 0.0) AS ac FROM {ANSWERS} WHERE en IS NOT NULL OR ar IS NOT NULL)"
ARWIN = f"({script('a')}) = 'arabic' AND ({script('e')}) <> 'arabic'"
DOCS = f"""SELECT doc_id, CAST(count(DISTINCT coalesce(page, 1)) AS INTEGER) AS pages_processed,
 coalesce(string_agg(c, chr(10) || chr(10) ORDER BY page, region_id) FILTER (WHERE text <> '' AND coalesce(script, '') <> 'latin'), '') AS full_text_arabic,
 coalesce(string_agg(c, chr(10) || chr(10) ORDER BY page, region_id) FILTER (WHERE text <> '' AND coalesce(script, '') <> 'arabic'), '') AS full_text_english,
 coalesce(string_agg(c, chr(10) || chr(10) ORDER BY page, region_id) FILTER (WHERE text <> ''), '') AS full_text_combined,
 coalesce(string_agg(CAST(region_id AS VARCHAR), ',' ORDER BY page, region_id) FILTER (WHERE text <> '' AND confidence < 0.85), '') AS regions_flagged
 FROM (SELECT *, {CLEAN} AS c FROM {R}) GROUP BY 1"""


def sorted_words(t: str) -> str:
    return f"array_to_string(list_sort(list_filter(regexp_split_to_array({t}, '\\s+'), lambda w: w <> '')), ' ')"


def matched(tokens: str) -> str:
    """token, inn, score, pos for the tokens of a query, by a dynamic program over the letters (rows of running maxima)."""
    rows = "list_transform(string_split(t, ''), lambda c: list_transform(string_split(name, ''), lambda d: CASE WHEN c = d THEN 1::BIGINT ELSE 0::BIGINT END))"
    zero = "list_transform(range(1, m + 1), lambda j: 0::BIGINT)"
    step = "list_transform(range(1, m + 1), lambda j: list_max(list_transform(range(1, j + 1), lambda k: greatest(p[k], CASE WHEN k > 1 THEN p[k - 1] ELSE 0 END + q[k]))))"
    bag = "200 * len(list_filter(string_split(t, ''), lambda c: contains(name, c))) >= 80 * (n + m)"
    return f"""SELECT token, inn, pos, round_even(200.0::DOUBLE * l / (n + m), 1)::DOUBLE AS score FROM (
 SELECT *, row_number() OVER (PARTITION BY token ORDER BY l::DOUBLE / (n + m) DESC, pos) AS best FROM (
 SELECT *, list_max(list_reduce(list_prepend({zero}, {rows}), lambda p, q: {step})) AS l FROM (
 SELECT * FROM (SELECT token, {sorted_words('token')} AS t, length({sorted_words('token')}) AS n FROM ({tokens})) JOIN (SELECT pos, inn, {sorted_words('inn')} AS name, length({sorted_words('inn')}) AS m FROM inn) ON 3 * n >= 2 * m AND 3 * m >= 2 * n WHERE n > 0 AND m > 0 AND {bag}))
 WHERE 200 * l >= 80 * (n + m)) WHERE best = 1"""


INPUTS = f"(SELECT input, lower({strip('input')}) AS token FROM (SELECT DISTINCT input FROM inn_matches WHERE input IS NOT NULL))"
FIRST_TOKENS = f"(SELECT region_key, CAST(pos AS INTEGER) AS pos, input, lower(input) AS token FROM (SELECT *, row_number() OVER (PARTITION BY region_key, lower(input) ORDER BY pos) AS k FROM {TOKENS}) WHERE k = 1)"
X0, Y0 = "greatest(0.0, least(bbox.x / (300.0::DOUBLE / 72), 420.0::DOUBLE))", "greatest(0.0, least(bbox.y / (300.0::DOUBLE / 72), 595.0::DOUBLE))"

SQL: dict[str, str] = {
    "scan_dispatch": f"SELECT result_id, lower(suf) AS suffix, CASE WHEN lower(suf) = '.pdf' THEN 'pdf' WHEN lower(suf) IN ('.jpg', '.jpeg', '.png', '.tiff', '.tif', '.bmp', '.webp') THEN 'image' ELSE 'unsupported' END AS kind FROM {FILES}",
    "batch_scan": f"SELECT result_id, lower(suf) AS suffix FROM {FILES} WHERE lower(suf) IN ('.pdf', '.jpg', '.jpeg', '.png', '.tiff', '.tif')",
    "output_name": f"SELECT result_id, base AS stem, base || '_ocr.json' AS json_name, base || '_ocr.md' AS markdown_name FROM {FILES}",
    "script_hint": f"SELECT result_id, CASE WHEN (contains(s, 'ar') OR contains(s, 'عربي')) AND contains(s, 'en') THEN 'mixed' WHEN contains(s, 'ar') OR contains(s, 'عربي') THEN 'arabic' WHEN contains(s, 'en') THEN 'latin' ELSE 'mixed' END AS script FROM (SELECT result_id, lower(regexp_replace(source_file, '\\.[^.]*$', '')) AS s FROM {S})",
    "page_enumerate": f"SELECT doc_id, page, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY page) AS INTEGER) AS page_num FROM (SELECT DISTINCT doc_id, page FROM {R})",
    "layout_heuristic": f"""SELECT region_key, 1 AS region_id, 0 AS x, 0 AS y, w, h, script, CASE WHEN script = 'arabic' THEN 'rtl' ELSE 'ltr' END AS direction FROM {BOXES} WHERE script <> 'mixed'
 UNION ALL SELECT region_key, 1, 0, 0, CAST(w // 2 AS INTEGER), h, 'latin', 'ltr' FROM {BOXES} WHERE script = 'mixed'
 UNION ALL SELECT region_key, 2, CAST(w // 2 AS INTEGER), 0, CAST(w - w // 2 AS INTEGER), h, 'arabic', 'rtl' FROM {BOXES} WHERE script = 'mixed'""",
    "layout_full_page": f"SELECT region_key, 1 AS region_id, 0 AS x, 0 AS y, w, h, script, CASE WHEN script = 'arabic' THEN 'rtl' ELSE 'ltr' END AS direction FROM {BOXES}",
    "route_regions": f"SELECT region_key, route, CASE WHEN route = 'skipped' AND script <> 'mixed' THEN 0.0::DOUBLE WHEN route IN ('skipped', 'none') THEN 1.0::DOUBLE ELSE confidence END AS confidence FROM {ROUTED}",
    "route_counts": f"SELECT route, count(*) AS n FROM {ROUTED} GROUP BY 1",
    "confidence": _text(conf("text"), "confidence"),
    "ocr_replay": f"SELECT result_id, lang, t AS text, {conf('t')} AS confidence, CASE WHEN o IS NULL THEN 'connection_error' END AS error FROM (SELECT result_id, lang, o, {strip('coalesce(o, chr(32))')} AS t FROM (SELECT result_id, 'en' AS lang, en AS o FROM {ANSWERS} UNION ALL SELECT result_id, 'ar', ar FROM {ANSWERS}))",
    "ocr_fallback": f"SELECT result_id, CASE WHEN a <> '' THEN a ELSE e END AS text, a = '' AS prompt_fallback_used FROM (SELECT result_id, {strip('coalesce(ar, chr(32))')} AS a, {strip('coalesce(en, chr(32))')} AS e FROM {ANSWERS})",
    "ocr_merge": f"SELECT result_id, CASE WHEN e = '' AND a = '' THEN '' WHEN a = '' THEN e WHEN e = '' OR ({ARWIN}) THEN a ELSE a || chr(10) || chr(10) || e END AS text, CASE WHEN e = '' AND a = '' THEN 0.0::DOUBLE WHEN a = '' THEN ec WHEN e = '' OR ({ARWIN}) THEN ac ELSE (ec + ac) / 2 END AS confidence FROM {MERGED}",
    "script_detect": f"SELECT region_key, CAST({n_of('text', AR)} AS INTEGER) AS n_arabic, CAST({n_of('text', 'a-zA-Z')} AS INTEGER) AS n_latin, {script('text')} AS script FROM {R}",
    "has_arabic": _text(f"regexp_matches(text, '[{AR}]')", "has_arabic"),
    "normalize_digits": _text(digits("text")),
    "normalize_units": _text(units("text")),
    "normalize_numerals": _text(units(digits("text"))),
    "arabic_units": _text(arabic("text")),
    "bidi_passthrough": _text("text"),
    "postprocess_text": _text(CLEAN),
    "extract_strengths": f"SELECT region_key, CAST(i AS INTEGER) AS ord, replace(v[i + 1], ',', '.') AS value, lower(u[i + 1]) AS unit, r[i + 1] AS raw FROM (SELECT *, unnest(range(len(r))) AS i FROM {STRENGTHS})",
    "inn_fallback": "SELECT * FROM (VALUES " + ", ".join(f"({k}, '{n}')" for k, n in enumerate(KNOWN_NAMES)) + ") AS t(pos, inn)",
    "inn_tokens": f"SELECT region_key, CAST(pos AS INTEGER) AS pos, input FROM (SELECT *, row_number() OVER (PARTITION BY region_key, lower(input) ORDER BY pos) AS k FROM {TOKENS}) WHERE k = 1",
    "inn_match_substring": f"SELECT token, arg_min(inn, pos) AS matched, 85.0::DOUBLE AS score FROM (SELECT DISTINCT lower(input) AS token FROM {TOKENS}) JOIN inn ON contains(inn, token) OR contains(token, inn) GROUP BY 1",
    "inn_match_one": f"SELECT i.input, h.inn AS matched, coalesce(h.score, 0.0::DOUBLE) AS score, CASE WHEN h.inn IS NOT NULL THEN 'list' ELSE 'none' END AS source, h.inn IS NOT NULL AS is_valid FROM {INPUTS} i LEFT JOIN ({matched(f"SELECT DISTINCT token FROM {INPUTS} WHERE token <> ''")}) h ON h.token = i.token",
    "inn_match_all": f"SELECT t.region_key, t.pos, t.input, h.inn AS matched, h.score FROM {FIRST_TOKENS} t JOIN ({matched(f'SELECT DISTINCT token FROM {FIRST_TOKENS}')}) h ON h.token = t.token",
    "strict_units": _text(STRICT),
    "qc_flag": f"SELECT region_key, coalesce(confidence < 0.85, false) AS needs_review FROM {R} WHERE text <> ''",
    "qc_flagged": f"SELECT doc_id, string_agg(page || ':' || region_id, ',' ORDER BY page, region_id) AS flagged FROM {R} WHERE text <> '' AND confidence < 0.85 GROUP BY 1",
    "document_result": f"""WITH docs AS ({DOCS}), used AS (SELECT DISTINCT doc_id, lower(unnest(regexp_extract_all(full_text_combined, '[a-zA-Z\\x{{0600}}-\\x{{06FF}}]{{4,}}'))) AS token FROM docs),
 hits AS ({matched('SELECT DISTINCT token FROM used')}), n AS (SELECT doc_id, count(*) AS n FROM used JOIN hits USING (token) GROUP BY 1)
 SELECT doc_id, pages_processed, full_text_arabic, full_text_english, full_text_combined, regions_flagged, CAST(len(regexp_extract_all({units(digits('full_text_combined'))}, '{STRENGTH}')) AS INTEGER) AS n_strengths, CAST(coalesce(n.n, 0) AS INTEGER) AS n_matches
 FROM docs LEFT JOIN n USING (doc_id)""",
    "result_projection": f"SELECT result_id, source_file, pages_processed, CAST(ns AS INTEGER) AS n_strengths, CAST(nm AS INTEGER) AS n_matches, coalesce(array_to_string({FLAGS}, ','), '') AS flagged FROM {CHILDREN}",
    "json_export": f"SELECT result_id, source_file, first_inn AS inn, CASE WHEN f THEN concat_ws(' ', v1, u1) END AS strength, CASE WHEN len({FLAGS}) > 0 THEN 'true' ELSE 'false' END AS requires_manual_review, metadata['dpi'] AS dpi, metadata['timestamp'] AS timestamp FROM {CHILDREN}",
    "markdown_export": _markdown(),
    "summary": f"SELECT result_id, source_file, pages_processed, CAST(nm AS INTEGER) AS names_found, CAST(ns AS INTEGER) AS strengths_found, CAST(len({FLAGS}) AS INTEGER) AS flagged FROM {CHILDREN}",
    "job_upsert": f"SELECT * FROM {LAST}",
    "job_get": f"SELECT * FROM {LAST} WHERE job_id = (SELECT min(job_id) FROM jobs)",
    "job_list": f"SELECT job_id, source_file, pages_processed AS pages, (SELECT count(DISTINCT job_id) FROM jobs) AS total FROM {LAST} ORDER BY seq DESC LIMIT 20",
    "batch_summary": f"SELECT count(*) FILTER (WHERE pages_processed IS NOT NULL) AS ok, count(*) AS total FROM {LAST}",
    "health_check": "SELECT m AS model, coalesce((SELECT bool_or(contains(p_name, m)) FROM part), false) AS available FROM (VALUES ('part 1'), ('no-such-model')) AS t(m)",
    "overlay_geometry": f"SELECT p.doc_id, p.page, b.region_key, b.x0, b.y0, b.x1, b.y1 FROM (SELECT DISTINCT doc_id, page FROM {R}) p LEFT JOIN (SELECT doc_id, page, region_key, CAST(round_even({X0}, 6) AS DOUBLE) AS x0, CAST(round_even({Y0}, 6) AS DOUBLE) AS y0, CAST(round_even(greatest({X0} + 1, least((bbox.x + bbox.w) / (300.0::DOUBLE / 72), 420.0::DOUBLE)), 6) AS DOUBLE) AS x1, CAST(round_even(greatest({Y0} + 1, least((bbox.y + bbox.h) / (300.0::DOUBLE / 72), 595.0::DOUBLE)), 6) AS DOUBLE) AS y1 FROM {R} WHERE bbox IS NOT NULL AND text <> '') b ON b.doc_id IS NOT DISTINCT FROM p.doc_id AND b.page IS NOT DISTINCT FROM p.page",
    "deskew_angle": "SELECT l_orderkey, l_linenumber, CAST(round_even(CASE WHEN abs(a) < 0.1 OR abs(a) > 10 THEN 0.0 ELSE a END, 4) AS DOUBLE) AS angle FROM (SELECT l_orderkey, l_linenumber, CASE WHEN q < -45 THEN -(90 + q) ELSE -q END AS a FROM (SELECT *, (l_quantity - 25) * 2 AS q FROM lineitem))",
    "base64_content": _text("base64(encode(text))", "content"),
}
SQL |= {"bench_inn": SQL["inn_match_all"], "bench_normalize": SQL["postprocess_text"], "bench_strengths": SQL["extract_strengths"], "bench_document": SQL["document_result"]}
