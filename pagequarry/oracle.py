"""The SQL each registered query is held against, for DuckDB over the same tables.

Written against the rules rather than the column expressions: RE2 has no lookaround, so boundaries are captured
and put back, and folds are list reductions.
"""

from __future__ import annotations

from .functions import fixed as X
from .plans import relations as R
from .queries import ERRORS, PAGE_SPECS, PAGES, TERMS

ORACLE_SQL: dict[str, str] = {}


def q(text: str | None) -> str:
    return "NULL" if text is None else "'" + text.replace("'", "''") + "'"


def rows(values: list[tuple], names: str) -> str:
    one = lambda v: q(v) if isinstance(v, str) or v is None else str(v)
    return f"(SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(one, r)) + ')' for r in values)}) v({names}))"


def listed(values: list[str]) -> str:
    return ", ".join(map(q, values))


def strip(c: str) -> str:
    return f"regexp_replace({c}, {q(f'^{X.WHITE}+|{X.WHITE}+$')}, '', 'g')"


def words(c: str) -> str:
    return f"list_filter(string_split_regex({c}, {q(X.WHITE + '+')}), lambda w: w <> '')"


def only(c: str, chars: str) -> str:
    return f"regexp_replace({c}, {q(f'[^{chars}]')}, '', 'g')"


def letters(c: str) -> str:
    return f"length({only(c, r'\p{L}')})"


def has(c: str, pattern: str) -> str:
    return f"regexp_matches({c}, {q(pattern)})"


def fold(c: str, terms: list[tuple[str, str]]) -> str:
    for k, v in terms:
        if any("぀" <= x <= "鿿" for x in k):
            c = f"replace({c}, {q(k)}, {q(v)})"
        else:  # twice, as neighbours share the character between them
            for _ in range(2):
                c = f"regexp_replace({c}, {q(f'(^|[^A-Za-z0-9]){k}([^A-Za-z0-9]|$)')}, {q(chr(92) + '1' + v + chr(92) + '2')}, 'g')"
    return c


BLOCKS = f"""blocks AS (
  SELECT * FROM (SELECT doc_id AS page_num, generate_subscripts(string_split(text, chr(10)), 1) AS id, unnest(string_split(text, chr(10))) AS text, lang FROM documents)
  UNION ALL SELECT -1, id, text, 'xx' FROM {rows(R.SAMPLE_LINES, 'id, text')}),
t0 AS (SELECT page_num, id, lang, text, {strip('text')} AS t FROM blocks)"""
TERMS_SQL = f"terms AS {rows(R.SAMPLE_TERMS, 'ord, src, tgt, tier')}"
BOXES = """items AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) AS ord FROM lineitem),
corners AS (SELECT l_orderkey AS page_num, ord, (l_partkey * 7 + ord * 13) % 160 AS x0, (l_suppkey * 11 + l_orderkey * 3) % 200 AS y0, 20 + l_partkey % 90 AS w, 15 + (l_orderkey + ord * 17) % 80 AS h, (l_partkey * 31 + ord * 7) % 101 AS conf FROM items),
boxes AS (SELECT page_num, ord, x0, y0, x0 + w AS x1, y0 + h AS y1, conf FROM corners),
moves AS (SELECT *, (page_num + ord) % 9 - 4 AS dx, (page_num * 3 + ord) % 7 - 3 AS dy FROM boxes WHERE (page_num + ord) % 10 <> 0),
moved AS (SELECT page_num, CASE WHEN page_num % 13 = 0 THEN ord + 1 ELSE ord END AS ord, ord AS was, x0 + dx AS x0, y0 + dy AS y0, x1 + dx AS x1, y1 + dy AS y1 FROM moves)"""
TURNS = """turns AS (SELECT conv_id AS doc, turn AS page_num, CAST(CASE WHEN coalesce(text, '') = '' THEN 0 ELSE len(string_split(text, ' ')) % 9 END AS BIGINT) AS lines FROM conversations)"""
STATS = """stats AS (SELECT event_type AS tag, user_id AS part, round(value, 2) AS seconds, event_id % 97 AS tokens, event_id % 11 <> 0 AS ok FROM events)"""


def inter(a: str, b: str) -> str:
    return f"(greatest(0, least({a}.x1, {b}.x1) - greatest({a}.x0, {b}.x0)) * greatest(0, least({a}.y1, {b}.y1) - greatest({a}.y0, {b}.y0)))"


def size(a: str) -> str:
    return f"(({a}.x1 - {a}.x0) * ({a}.y1 - {a}.y0))"


def iou(a: str, b: str) -> str:
    return f"({inter(a, b)} / ({size(a)} + {size(b)} - {inter(a, b)}))"


CLEAN = f"""folded AS (SELECT page_num, id, lang, t, {fold("replace(array_to_string(" + words('text') + ", ' '), '@', 'a')", TERMS)} AS line FROM t0),
parts AS (SELECT page_num, id, lang, t, list_transform({words('line')}, lambda w: {{'w': w, 'a': {only('w', chr(92) + 'p{L}')}}}) AS ws FROM folded),
clean AS (SELECT page_num, id, lang, t, array_to_string(list_transform(list_filter(ws, lambda x: NOT (length(x.a) >= 3 AND NOT {has('x.a', X.VOWEL)} AND NOT {has('x.a', X.CJK)}) AND upper(x.a) NOT IN ({listed(X.DROPPED_WORDS)})), lambda x: x.w), ' ') AS cleaned_text FROM parts)"""


def gibberish(t: str) -> str:
    bad = f"len(list_filter({words(t)}, lambda w: length({only('w', r'{}\[\]|\\<>/#*')}) > length(w) * 0.5 OR ({letters('w')} >= 4 AND NOT {has('w', X.CJK)} AND NOT {has('w', X.VOWEL)})))"
    n = f"len({words(t)})"
    return f"""CASE WHEN {t} = '' THEN true WHEN length({t}) <= 3 THEN false
      WHEN {has(t, r'\p{L}')} AND NOT {has(t, X.VOWEL)} AND NOT {has(t, X.CJK)} THEN true WHEN {has(t, r'[{}\[\]|\\<>]')} THEN true
      WHEN {n} = 1 THEN {bad} > 0 ELSE {bad} / {n} > 0.5 END"""


def noise(t: str) -> str:
    links = " OR ".join(f"contains(lower({t}), {q(p)})" for p in X.LINK_PARTS)
    return f"""CASE WHEN {t} = '' THEN 'blank' WHEN NOT {has(t, X.CJK)} AND length({t}) < 2 THEN 'single' WHEN {gibberish(t)} THEN 'gibberish'
      WHEN {links} THEN 'link' WHEN length({t}) > 15 AND length({only(t, '/')}) > 2 THEN 'path'
      WHEN {letters(t)} > 0 AND NOT {has(t, X.VOWEL)} AND NOT {has(t, X.CJK)} AND lower({t}) NOT IN ({listed(X.VOWELLESS_WORDS)}) THEN 'vowelless'
      WHEN len({words(f'lower({t})')}) <= 3 AND len(list_filter({words(f'lower({t})')}, lambda w: {only('w', chr(92) + 'p{L}')} IN ({listed(X.EFFECTS)}))) > 0 THEN 'effect'
      WHEN NOT {has(t, X.CJK)} AND ({letters(t)} = 0 OR {letters(t)} / length({t}) < 0.35) THEN 'symbols' END"""


def route() -> str:
    return f"""CASE WHEN t IN ({listed([k for k, _ in TERMS])}) THEN 'glossary' WHEN cleaned_text = '' THEN 'empty' WHEN length(cleaned_text) < 2 AND NOT {has('cleaned_text', X.CJK)} THEN 'single'
      WHEN noise IS NOT NULL THEN 'noise' WHEN {has('cleaned_text', r'^\p{Nd}{1,4}$')} THEN 'number' ELSE 'translate' END"""


ROUTED = f"""WITH {BLOCKS}, {CLEAN}, stripped AS (SELECT *, {strip('cleaned_text')} AS c FROM clean), noisy AS (SELECT *, {noise('c')} AS noise FROM stripped),
routed AS (SELECT page_num, id, lang, cleaned_text, {route()} AS route FROM noisy)"""

ORACLE_SQL["q_classify_blocks"] = f"{ROUTED} SELECT lang, route, count(*) AS n_blocks, CAST(sum(length(cleaned_text)) AS BIGINT) AS n_chars FROM routed GROUP BY ALL"
ORACLE_SQL["q_engine_hist"] = f"{ROUTED} SELECT CASE WHEN route = 'translate' THEN 'Unknown' ELSE route END AS engine, count(*) AS n_blocks FROM routed GROUP BY 1"
ORACLE_SQL["q_clean_input"] = f"WITH {BLOCKS}, {CLEAN} SELECT page_num, id, cleaned_text FROM clean"
ORACLE_SQL["q_gibberish"] = f"WITH {BLOCKS} SELECT page_num, id, {gibberish('t')} AS gibberish FROM t0"
ORACLE_SQL["q_noise_engine"] = f"WITH {BLOCKS} SELECT page_num, id, coalesce({noise('t')}, 'text') AS reason FROM t0"
ORACLE_SQL["q_noise_local"] = f"""WITH {BLOCKS} SELECT page_num, id, CASE WHEN length(t) < 2 THEN 'short'
  WHEN {has('t', r'\p{Lu}')} AND NOT {has('t', r'[\p{Ll}\p{Lt}]')} AND length(t) <= 6 AND NOT {has('t', X.WHITE)} THEN 'capitals'
  WHEN {' OR '.join(f"contains(lower(t), {q(p)})" for p in X.LOCAL_EFFECTS)} THEN 'effect' WHEN {' OR '.join(has('t', p) for p in X.LOCAL_PATTERNS)} THEN 'pattern'
  WHEN {letters('t')} > 0 AND {letters('t')} / length(t) < 0.4 THEN 'symbols' ELSE 'text' END AS reason FROM t0"""
_REAL = f"({has('t', X.CJK)} OR {has('t', r'[\x{3000}-\x{303f}\x{ff01}-\x{ff5e}!?…―〜]')})"
ORACLE_SQL["q_meaningful"] = f"""WITH {BLOCKS} SELECT page_num, id, CASE WHEN t = '' THEN false
  WHEN length(t) <= 3 AND NOT {_REAL} AND NOT {has('t', r'^[\p{L}\p{N}]+$')} THEN false
  WHEN length(t) < 3 AND {has('t', r'^\p{L}+$')} AND NOT {has('t', X.CJK)} AND lower(t) NOT IN ({listed(X.SHORT_WORDS)}) THEN false
  WHEN length({only('t', r'=+|\\/_*<>\[\]{}')}) > 0.25 * length(t) THEN false WHEN {_REAL} THEN true
  ELSE length({only('t', rf"\p{{L}}\p{{N}}{X.WHITE[1:-1]},.!?'\-")}) / length(t) >= 0.60 END AS meaningful FROM t0"""
ORACLE_SQL["q_polish_gate"] = f"""WITH {BLOCKS}, w AS (SELECT page_num, id, text, {words('text')} AS ws FROM t0) SELECT page_num, id, NOT (
  {has("replace(text, ' ', '')", r'^\p{Nd}+$')} OR (len(ws) > 0 AND len(list_filter(ws, lambda x: {has('x', r'\p{Lu}')} AND NOT {has('x', r'[\p{Ll}\p{Lt}]')} AND length(x) > 2)) / len(ws) > 0.5)
  OR (id % 2 = 0 AND len(ws) <= 6)) AS polish FROM w"""
ORACLE_SQL["q_lang_detect"] = f"""WITH {BLOCKS} SELECT lang, CASE WHEN lang = 'es' THEN 'ko' WHEN {letters('text')} > 0 AND length({only('text', 'A-Za-z')}) / {letters('text')} > 0.6 THEN 'en' ELSE 'auto' END AS detected, count(*) AS n_blocks FROM t0 GROUP BY ALL"""


def marks(c: str) -> str:
    c = f"regexp_replace({c}, {q(X.ELLIPSIS)}, '……', 'g')"
    c = f"translate(replace(replace(replace({c}, '!?', '！？'), '?!', '！？'), '？！', '！？'), '!?~〜', '！？～～')"
    c = f"regexp_replace(regexp_replace({c}, '(?:……){{2,}}', '……', 'g'), '[，、,]+$', '')"
    for _ in range(2):  # without lookahead a character between two blanks is used up
        c = f"regexp_replace({c}, {q(f'({X.HAN}){X.WHITE}+({X.HAN})')}, '\\1 \\2', 'g')"
    return strip(c)


def output(c: str) -> str:
    c = strip(f"regexp_replace(regexp_replace({c}, {q(X.ELLIPSIS)}, '……', 'g'), {q(X.NOTE)}, '')")
    c = strip(f"regexp_replace({c}, {q(X.WHITE + '*' + r'\([A-Za-z]([A-Za-z\-]|' + X.WHITE + r')*\)')}, '', 'g')")
    c = f"replace(translate({c}, '；;', '，，'), '@', '')"
    c = strip(f"regexp_replace({c}, {q(r'([。.，,_—\-:：]' + X.WHITE + '*)+$')}, '')")
    c = f"regexp_replace({c}, {q(r'^([_—\-:：，,]' + X.WHITE + '*)+')}, '')"
    for wrong, right in X.CORRECTIONS:
        c = f"replace({c}, {q(wrong)}, {q(right)})"
    return marks(strip(c))


ORACLE_SQL["q_clean_output"] = f"WITH {BLOCKS} SELECT page_num, id, {output('text')} AS cleaned FROM t0"
ORACLE_SQL["q_lettering_marks"] = f"WITH {BLOCKS} SELECT page_num, id, {marks('text')} AS marked FROM t0"
ORACLE_SQL["q_refusals"] = f"""WITH {BLOCKS} SELECT page_num, id, {' OR '.join(f"contains(text, {q(r)})" for r in X.REFUSALS)} AS refusal, {has('text', X.HAN)} AS accepted, lang LIKE 'zh%' OR lang LIKE '%chinese%' AS chinese FROM t0"""


def valid(k: str, v: str) -> str:
    k, v = strip(k), strip(v)
    return f"""(length({k}) BETWEEN 1 AND 30 AND length({v}) BETWEEN 1 AND 30 AND {k} <> {v} AND NOT {has(f"replace({k}, ' ', '')", r'^\p{Nd}+$')}
      AND CASE WHEN {has(k, X.CJK)} THEN length({k}) >= 2 ELSE length({k}) >= 3 AND {letters(k)} >= 3 END)"""


LOADED = f"""{TERMS_SQL}, good AS (SELECT ord, {strip('src')} AS src, {strip('tgt')} AS tgt, tier FROM terms WHERE {valid('src', 'tgt')}),
loaded AS (SELECT src, tgt, tier FROM good QUALIFY row_number() OVER (PARTITION BY src ORDER BY tier = 'auto', ord DESC) = 1)"""
ORACLE_SQL["q_term_valid"] = f"WITH {TERMS_SQL}, p AS (SELECT src, tgt FROM terms UNION ALL SELECT p_name, p_brand FROM part) SELECT src, tgt, {valid('src', 'tgt')} AS valid FROM p"
ORACLE_SQL["q_load_terms"] = f"WITH {LOADED} SELECT src, tgt, tier FROM loaded"
ORACLE_SQL["q_term_exact"] = f"WITH {BLOCKS}, {LOADED} SELECT page_num, id, tgt FROM t0 JOIN loaded ON t = src WHERE tier = 'curated'"
_HIT = "CASE WHEN regexp_matches(src, '{cjk}') THEN contains(text, src) ELSE regexp_matches({text}, '(^|[^A-Za-z0-9])' || {src} || '([^A-Za-z0-9]|$)') END"
_KEYS = f"keys AS {rows(TERMS, 'src, tgt')}"
ORACLE_SQL["q_term_hits"] = f"WITH {BLOCKS}, {_KEYS} SELECT page_num, id, src FROM t0, keys WHERE {_HIT.format(cjk=X.CJK, text='text', src='src')}"
# The page's terms: of a key in both tiers the curated value, at the automatic entry's place.
ORACLE_SQL["q_term_hints"] = f"""WITH {BLOCKS}, {TERMS_SQL}, good AS (SELECT ord, {strip('src')} AS src, {strip('tgt')} AS tgt, tier = 'auto' AS auto FROM terms WHERE {valid('src', 'tgt')}),
keys AS (SELECT src, coalesce(arg_max(tgt, ord) FILTER (NOT auto), arg_max(tgt, ord)) AS tgt, CASE WHEN bool_or(auto) THEN 0 ELSE 1 END AS late FROM good GROUP BY src)
SELECT src, tgt, late, count(*) AS n_blocks FROM t0, keys WHERE {_HIT.format(cjk=X.CJK, text='lower(text)', src='lower(src)')} GROUP BY ALL"""
ORACLE_SQL["q_term_ground"] = f"""WITH {BLOCKS}, {TERMS_SQL}, p AS (SELECT src, tgt FROM terms UNION ALL SELECT * FROM (VALUES ('thing', '东西'), ('stop', '停'), ('nothere', '无')))
SELECT DISTINCT src, tgt FROM p WHERE {valid('src', 'tgt')} AND tgt IN ('停', '东西', '西奥', '词') AND src NOT IN ('魔術師', '魔術', 'Theo', 'The')
AND EXISTS (SELECT 1 FROM t0 WHERE {_HIT.format(cjk=X.CJK, text='text', src='src')})"""
ORACLE_SQL["q_term_fold"] = f"WITH {BLOCKS} SELECT page_num, id, {fold('text', TERMS)} AS folded FROM t0"
ORACLE_SQL["q_text_keys"] = f"""WITH {BLOCKS} SELECT page_num, id, substr(sha256(t), 1, 20) AS cache_key, md5(t) AS md5, substr(sha1(t), 1, 10) AS sha1, {only('text', r'\p{L}\p{N}\x{4e00}-\x{9fff}\x{3040}-\x{30ff}')} AS dedup_key FROM t0"""
# Titles of the sample, extension and folders gone and composed (NFKC) by hand; the others are ASCII, which NFKC leaves alone.
_TITLES = """('図書館の大魔術師 第5巻.pdf', '図書館の大魔術師 第5巻'), ('One_Piece_Vol.12.pdf', 'One_Piece_Vol.12'), ('Title 05.pdf', 'Title 05'), ('1984.pdf', '1984'),
('a/b/[tag] Some.Name ch 3.v2.pdf', '[tag] Some.Name ch 3.v2'), ('x 3巻.zip', 'x 3巻'), ('.hidden', '.hidden'), ('Ｔｉｔｌｅ ０５.pdf', 'Title 05'), ('Foo Ｖｏｌ．１２.pdf', 'Foo Vol.12'), ('ﾀｲﾄﾙ　第③巻.pdf', 'タイトル 第3巻')"""
_SPACED = "regexp_replace(title, '第\\s*[0-9０-９一二三四五六七八九十百〇零]+\\s*[巻卷集話话冊册部]', ' ', 'g')"
_SPACED = f"regexp_replace({_SPACED}, '[0-9]+\\s*[巻卷冊册]', ' ', 'g')"
_SPACED = f"regexp_replace({_SPACED}, '(^|[^A-Za-z])(?i:vol(?:ume)?|v|ch(?:apter)?|ep(?:isode)?|book|tome|part)\\.?\\s*[0-9]+', '\\1 ', 'g')"
_SPACED = f"regexp_replace(regexp_replace({_SPACED}, '[(\\[（【［][^)\\]）】］]*[)\\]）】］]', ' ', 'g'), '[_\\-~～・.]+', ' ', 'g')"
ORACLE_SQL["q_series_key"] = f"""WITH names AS (SELECT * FROM (VALUES {_TITLES}) v(name, title) UNION SELECT p_name || ' Vol.' || p_size || '.pdf', p_name || ' Vol.' || p_size FROM part),
keys AS (SELECT name, trim(regexp_replace(regexp_replace(' ' || {_SPACED}, '\\s+[0-9]+\\s*$', ''), '\\s+', ' ', 'g')) AS series FROM names),
safe AS (SELECT name, series, substr(trim(regexp_replace(lower(series), '[<>:"/\\\\|?*\\x00-\\x1f]', '_', 'g'), ' .'), 1, 80) AS file FROM keys)
SELECT name, series, CASE WHEN file = '' THEN '_default' ELSE file END AS file FROM safe"""
_SPECS = ", ".join(f"({k}, {q(s)})" for k, s in enumerate(PAGE_SPECS))
ORACLE_SQL["q_page_range"] = f"""WITH raw AS (SELECT * FROM (VALUES {_SPECS}) v(spec, s)),
specs AS (SELECT spec, true AS web, translate(s, '，－—', ',--') AS s FROM raw UNION ALL SELECT spec, false, s FROM raw),
parts AS (SELECT spec, web, trim(unnest(string_split(s, ','))) AS part FROM specs),
ends AS (SELECT spec, web, string_split(part, '-') AS e FROM parts WHERE part <> ''),
spans AS (SELECT spec, web, TRY_CAST(trim(e[1]) AS INT) AS a, TRY_CAST(trim(e[-1]) AS INT) AS b FROM ends WHERE len(e) <= 2),
pages AS (SELECT DISTINCT p_size AS page_num FROM part),
named AS (SELECT DISTINCT spec, web, page_num FROM spans JOIN pages ON page_num BETWEEN a AND b AND page_num BETWEEN 1 AND {PAGES}),
covered AS (SELECT DISTINCT spec, web FROM spans WHERE a IS NOT NULL AND b IS NOT NULL AND greatest(a, 1) <= least(b, {PAGES}))
SELECT spec, web, page_num FROM named UNION ALL SELECT spec, web, page_num FROM specs, pages WHERE (spec, web) NOT IN (SELECT (spec, web) FROM covered)"""
ORACLE_SQL["q_text_dedup"] = f"""WITH {BLOCKS}, k AS (SELECT page_num, id, {only('text', r'\p{L}\p{N}\x{4e00}-\x{9fff}\x{3040}-\x{30ff}')} AS key FROM t0)
SELECT page_num, id FROM k WHERE key = '' UNION ALL SELECT page_num, min(id) FROM k WHERE key <> '' GROUP BY page_num, key"""
ORACLE_SQL["q_cache_split"] = f"""WITH {BLOCKS}, c AS (SELECT t, last('译' || t ORDER BY page_num, id) AS cached FROM t0 WHERE lang = 'en' AND t <> '' GROUP BY t)
SELECT page_num, id, cached IS NOT NULL AS from_cache, sha256(cached) AS translated_sha256 FROM t0 LEFT JOIN c USING (t)"""
ORACLE_SQL["q_write_back"] = f"WITH {BLOCKS} SELECT page_num, count(*) AS n_blocks, CAST(sum(CASE WHEN id % 3 = 0 THEN 1 + length(text) ELSE 0 END) AS BIGINT) AS n_chars FROM t0 GROUP BY 1"
ORACLE_SQL["q_prompt"] = f"""WITH {BLOCKS}, keys AS {rows([(k, *t) for k, t in enumerate(TERMS)], 'ord, src, tgt')},
l AS (SELECT page_num, string_agg('ID: ' || id || ' | 原文: ' || t, chr(10) ORDER BY id) AS s FROM t0 GROUP BY 1),
h AS (SELECT DISTINCT page_num, ord, '- ' || src || ' -> ' || tgt AS line FROM t0, keys WHERE {_HIT.format(cjk=X.CJK, text='lower(text)', src='lower(src)')}),
g AS (SELECT page_num, string_agg(line, chr(10) ORDER BY ord) AS s FROM h GROUP BY 1),
p AS (SELECT page_num, l.s || coalesce(chr(10) || g.s, '') || chr(10) || '再译一次。' AS s FROM l LEFT JOIN g USING (page_num)) SELECT page_num, sha256(s) AS prompt_sha256, length(s) AS n_chars FROM p"""
ORACLE_SQL["q_assemble"] = "SELECT o_orderkey AS page_num, CASE WHEN o_orderstatus = 'O' THEN 'new' ELSE 'old' END || o_orderstatus AS path FROM orders"

PAIRS = f"""pairs AS (SELECT b.page_num, b.ord AS block, r.ord AS row, b.ord = r.ord AS same, {iou('b', 'r')} AS score FROM boxes b JOIN moved r USING (page_num) WHERE {iou('b', 'r')} >= {X.IOU_MATCH})"""
MATCHED = f"""{PAIRS}, lists AS (SELECT page_num, list([{{'block': block, 'row': row}}] ORDER BY score DESC, same DESC, block DESC, row DESC) AS l FROM pairs GROUP BY 1),
taken AS (SELECT page_num, list_reduce(l, lambda used, p: CASE WHEN len(list_filter(used, lambda u: u.block = p[1].block OR u.row = p[1].row)) > 0 THEN used ELSE list_concat(used, p) END) AS m FROM lists),
matches AS (SELECT page_num, unnest(m) AS m FROM taken)"""
ORACLE_SQL["q_iou_pairs"] = f"WITH {BOXES}, {PAIRS} SELECT page_num, block, row, same, round(score, 6) AS score FROM pairs"
ORACLE_SQL["q_iou_match"] = f"WITH {BOXES}, {MATCHED} SELECT page_num, m.block AS block, m.row AS row FROM matches"
ORACLE_SQL["q_unmatched"] = f"WITH {BOXES}, {MATCHED} SELECT page_num, count(*) AS n_rows FROM moved WHERE was % 2 = 1 AND (page_num, ord) NOT IN (SELECT (page_num, m.row) FROM matches) GROUP BY 1"
ORACLE_SQL["q_review_diff"] = f"""WITH {BOXES}, n AS (SELECT * FROM moved WHERE page_num % 3 = 0), o AS (SELECT * FROM boxes WHERE page_num IN (SELECT page_num FROM n)),
c AS (SELECT coalesce(o.page_num, n.page_num) AS page_num, CASE WHEN n.ord IS NULL THEN 'removed' WHEN o.ord IS NULL THEN 'drawn'
  WHEN greatest(abs(o.x0 - n.x0), abs(o.y0 - n.y0), abs(o.x1 - n.x1), abs(o.y1 - n.y1)) > 1 THEN 'moved' ELSE 'kept' END AS change FROM o FULL JOIN n ON o.page_num = n.page_num AND o.ord = n.ord)
SELECT page_num, change, count(*) AS n_boxes FROM c GROUP BY ALL"""
ORACLE_SQL["q_overlap_text"] = f"WITH {BOXES} SELECT b.page_num, b.ord, string_agg('s' || s.was, ' ' ORDER BY s.was) AS text FROM boxes b JOIN moved s USING (page_num) WHERE {inter('b', 's')} > 0 GROUP BY ALL"
ORACLE_SQL["q_detected"] = f"WITH {BOXES} SELECT page_num, ord, x0, y0, x1, y1 FROM boxes WHERE conf / 100 > {X.DETECTOR_CONFIDENCE}"


def kept(order: str, clash: str) -> str:
    return f"""lists AS (SELECT page_num, list([{{'ord': ord, 'x0': x0, 'y0': y0, 'x1': x1, 'y1': y1}}] ORDER BY {order}) AS l FROM boxes GROUP BY 1),
folds AS (SELECT page_num, list_reduce(l, lambda kept, b: CASE WHEN len(list_filter(kept, lambda k: {clash})) > 0 THEN kept ELSE list_concat(kept, b) END) AS m FROM lists),
kept AS (SELECT page_num, unnest(m) AS k FROM folds)"""


ORACLE_SQL["q_nms"] = f"WITH {BOXES}, {kept('conf DESC, ord', iou('b[1]', 'k') + f' > {X.IOU_SUPPRESS}')} SELECT page_num, k.ord AS ord FROM kept"
ORACLE_SQL["q_drop_contained"] = f"""WITH {BOXES}, {kept('(x1 - x0) * (y1 - y0) DESC, ord', inter('b[1]', 'k') + f" >= {X.CONTAINED} * " + size('b[1]'))}
SELECT page_num, ord FROM boxes WHERE (page_num, x0, y0, x1, y1) IN (SELECT (page_num, k.x0, k.y0, k.x1, k.y1) FROM kept)"""
ORACLE_SQL["q_nested_dups"] = f"WITH {BOXES} SELECT page_num, ord FROM boxes b WHERE EXISTS (SELECT 1 FROM boxes o WHERE o.page_num = b.page_num AND {size('o')} > {size('b')} AND {inter('b', 'o')} >= {X.NESTED} * {size('b')}) AND conf % 5 <> 0"

_UNION = "{{'ord': {a}.ord, 'x0': least({a}.x0, {b}.x0), 'y0': least({a}.y0, {b}.y0), 'x1': greatest({a}.x1, {b}.x1), 'y1': greatest({a}.y1, {b}.y1)}}"
_SIDES = {k: f"greatest(1, {b}.{hi} - {b}.{lo})" for k, b, lo, hi in (("aw", "s[1]", "x0", "x1"), ("ah", "s[1]", "y0", "y1"), ("bw", "p[1]", "x0", "x1"), ("bh", "p[1]", "y0", "y1"))}
_TALL = "greatest(0, least(s[1].y1, p[1].y1) - greatest(s[1].y0, p[1].y0))"
_JOINS = """({i} >= 0.20::DOUBLE * greatest(1, {aw} * {ah} + {bw} * {bh} - {i}) OR {i} >= 0.55::DOUBLE * least({aw} * {ah}, {bw} * {bh})
  OR ({ah} > 1.1::DOUBLE * {aw} AND {bh} > 1.1::DOUBLE * {bw} AND greatest(s[1].x0, p[1].x0) - least(s[1].x1, p[1].x1) <= 15 AND {t} >= 0.60::DOUBLE * least({ah}, {bh})))""".format(i=inter("s[1]", "p[1]"), t=_TALL, **_SIDES)
_BOX = "{'ord': ord, 'x0': x0, 'y0': y0, 'x1': x1, 'y1': y1}"
# A pass takes the first box left and what it meets, grown, until none is left; passes go on while they shorten the list.
ORACLE_SQL["q_fuse"] = f"""WITH RECURSIVE {BOXES}, lists AS (SELECT page_num, list({_BOX} ORDER BY ord) AS l FROM boxes GROUP BY 1),
passes AS (SELECT page_num, l AS rest, l[:0] AS made, len(l) AS n FROM lists
  UNION ALL SELECT page_num, CASE WHEN len(rest) > 0 THEN took[2:] ELSE made END, CASE WHEN len(rest) > 0 THEN list_concat(made, took[:1]) ELSE made[:0] END, CASE WHEN len(rest) > 0 THEN n ELSE len(made) END
  FROM (SELECT *, list_reduce(list_transform(CASE WHEN len(rest) > 0 THEN rest ELSE made END, lambda b: [b]), lambda s, p: CASE WHEN {_JOINS} THEN list_concat([{_UNION.format(a='s[1]', b='p[1]')}], s[2:]) ELSE list_concat(s, p) END) AS took
    FROM passes WHERE len(rest) > 0 OR len(made) < n)),
done AS (SELECT page_num, generate_subscripts(made, 1) AS ord, unnest(made) AS b FROM passes WHERE len(rest) = 0 AND len(made) = n)
SELECT page_num, ord, b.x0 AS x0, b.y0 AS y0, b.x1 AS x1, b.y1 AS y1 FROM done"""
_LOW, _HIGH = ("list_min(list_transform(list_filter(s, lambda m: m.c = k), lambda m: m.x0))", "list_max(list_transform(list_filter(s, lambda m: m.c = k), lambda m: m.x1))")
_FITS = f"(greatest(0, least({_HIGH}, p[1].x1) - greatest({_LOW}, p[1].x0)) > 0.4 * least({_HIGH} - {_LOW}, p[1].x1 - p[1].x0) OR abs((p[1].x0 + p[1].x1) / 2 - ({_LOW} + {_HIGH}) / 2) < 50)"
_LAST = "list_max(list_transform(s, lambda m: m.c))"
ORACLE_SQL["q_reading_order"] = f"""WITH {BOXES}, spans AS (SELECT *, row_number() OVER (PARTITION BY page_num ORDER BY (y0 + y1) / 2, ord) AS n FROM boxes WHERE x1 - x0 >= 98.0),
edges AS (SELECT page_num, n AS band, ord, coalesce(lag(y1) OVER (PARTITION BY page_num ORDER BY n), 0) AS top, y0 AS until FROM spans
  UNION ALL SELECT page_num, coalesce(max(n), 0) + 1, NULL, coalesce(arg_max(y1, n), 0), NULL FROM (SELECT DISTINCT page_num FROM boxes) LEFT JOIN spans USING (page_num) GROUP BY 1),
banded AS (SELECT b.*, band FROM boxes b JOIN edges e USING (page_num) WHERE x1 - x0 < 98.0 AND (y0 + y1) / 2 >= top AND (until IS NULL OR (y0 + y1) / 2 < until)),
lists AS (SELECT page_num, band, list([{{'ord': ord, 'x0': x0, 'y0': y0, 'x1': x1, 'c': 1::BIGINT, 'n': 1::BIGINT}}] ORDER BY x0, ord) AS l FROM banded GROUP BY 1, 2),
folds AS (SELECT page_num, band, list_reduce(l, lambda s, p: list_concat(s, [{{'ord': p[1].ord, 'x0': p[1].x0, 'y0': p[1].y0, 'x1': p[1].x1, 'c': coalesce(list_filter(range(1, {_LAST} + 1), lambda k: {_FITS})[1], {_LAST} + 1), 'n': len(s) + 1}}])) AS m FROM lists),
placed AS (SELECT page_num, band, m.ord AS ord, m.y0 AS y0, m.c AS c, m.n AS n, avg((m.x0 + m.x1) / 2) OVER (PARTITION BY page_num, band, m.c) AS centre FROM (SELECT page_num, band, unnest(m) AS m FROM folds)),
every AS (SELECT page_num, ord, band, 0 AS last, centre, c, y0, n FROM placed UNION ALL SELECT page_num, ord, band, 1, 0, 0, 0, 0 FROM edges WHERE ord IS NOT NULL)
SELECT page_num, ord, row_number() OVER (PARTITION BY page_num ORDER BY band, last, centre, c, y0, n) AS id FROM every"""
_WITHIN = "greatest(greatest(s[k].x1, p[1].x1) - least(s[k].x0, p[1].x0), greatest(s[k].y1, p[1].y1) - least(s[k].y0, p[1].y0)) <= 150"
_FIRST = f"list_filter(range(1, len(s) + 1), lambda k: {_WITHIN})[1]"
ORACLE_SQL["q_merge_regions"] = f"""WITH {BOXES}, lists AS (SELECT page_num, list([{_BOX}] ORDER BY y0, x0, ord) AS l FROM boxes GROUP BY 1),
folds AS (SELECT page_num, list_reduce(l, lambda s, p: CASE WHEN {_FIRST} IS NULL THEN list_concat(s, p) ELSE list_transform(s, lambda g, i: CASE WHEN i = {_FIRST} THEN {_UNION.format(a='g', b='p[1]')} ELSE g END) END) AS m FROM lists),
done AS (SELECT page_num, generate_subscripts(m, 1) AS ord, unnest(m) AS b FROM folds) SELECT page_num, ord, b.x0 AS x0, b.y0 AS y0, b.x1 AS x1, b.y1 AS y1 FROM done"""
ORACLE_SQL["q_grid_order"] = f"WITH {BOXES} SELECT page_num, ord, row_number() OVER (PARTITION BY page_num ORDER BY y0 // 30, x0, ord) AS id FROM boxes"
ORACLE_SQL["q_page_medians"] = f"""WITH {BOXES} SELECT page_num, ord, CAST(median(y1 - y0) OVER p AS DOUBLE) AS median_height,
CASE sign(sum(CASE WHEN y1 - y0 > x1 - x0 THEN 1 ELSE -1 END) OVER p) WHEN 1 THEN 'vertical' WHEN -1 THEN 'horizontal' END AS page_direction FROM boxes WINDOW p AS (PARTITION BY page_num)"""
_PX = ", ".join(f"least(greatest(CAST(trunc({c} * 1.7) AS BIGINT), 0), {m}) AS px_{c}" for c, m in (("x0", 300), ("y0", 400), ("x1", 300), ("y1", 400)))
_PT = ", ".join(f"greatest(0, least({m}.0, (CAST({c} AS DOUBLE) {s} CAST({w} AS DOUBLE) / 2 - {d}) / 0.5::DOUBLE)) AS pt_{n}" for n, c, s, w, d, m in (("x0", "x0", "-", "(x1 - x0)", 12, 200), ("y0", "y0", "-", "(y1 - y0)", 0, 300), ("x1", "x0", "+", "(x1 - x0)", 12, 200), ("y1", "y0", "+", "(y1 - y0)", 0, 300)))
ORACLE_SQL["q_scaled_boxes"] = f"WITH {BOXES} SELECT page_num, ord, conf, {_PX}, {_PT}, CASE WHEN 0.299::DOUBLE * (x0 % 256) + 0.587::DOUBLE * (y0 % 256) + 0.114::DOUBLE * (x1 % 256) > 127 THEN 'black' ELSE 'white' END AS lettering FROM boxes"
ORACLE_SQL["q_orientation"] = f"""WITH {BOXES}, g AS (SELECT *, conf % 7 AS gx, (conf // 7) % 7 AS gy, x1 - x0 AS w, y1 - y0 AS h FROM boxes)
SELECT page_num, ord, CASE WHEN h >= 1.5 * w THEN 'vertical' WHEN w >= 1.5 * h THEN 'horizontal' WHEN greatest(gx, gy) >= 3 AND gx >= 1.5 * gy THEN 'vertical'
WHEN greatest(gx, gy) >= 3 AND gy >= 1.5 * gx THEN 'horizontal' WHEN page_num % 3 = 0 THEN 'vertical' WHEN page_num % 3 = 1 THEN 'horizontal' WHEN h > w THEN 'vertical' ELSE 'horizontal' END AS direction FROM g"""
ORACLE_SQL["q_font_sizes"] = """WITH g AS (SELECT * FROM (VALUES ('0'), ('-1'), ('NaN'), ('2'), ('999'), ('12.34'), ('abc'), (NULL)) v(given) UNION ALL SELECT DISTINCT CAST(p_size AS VARCHAR) FROM part),
n AS (SELECT given, TRY_CAST(given AS DOUBLE) AS v FROM g) SELECT given, CASE WHEN v IS NULL OR isnan(v) OR isinf(v) OR v <= 0 THEN 0.0 ELSE round(least(greatest(v, 4), 150), 1) END AS points FROM n"""
ORACLE_SQL["q_runs"] = """WITH h AS (SELECT user_id, CAST(floor(epoch(ts) / 3600) AS BIGINT) AS hour, bool_or(value > 10) AS on_ FROM events GROUP BY ALL),
i AS (SELECT user_id, hour, hour - row_number() OVER (PARTITION BY user_id ORDER BY hour) AS island FROM h WHERE on_) SELECT user_id, min(hour) AS start, max(hour) + 1 AS stop FROM i GROUP BY user_id, island"""


def packing(state: str) -> str:
    return f"""WITH {TURNS}, lists AS (SELECT doc, list([{{'page_num': page_num, 'lines': lines, 'batch': 0::BIGINT, 'held': lines, 'first': true}}] ORDER BY page_num, lines) AS l FROM turns GROUP BY 1),
folds AS (SELECT doc, list_reduce(l, lambda s, p: list_concat(s, [{state}])) AS m FROM lists) SELECT doc, m.page_num AS page_num, m.lines AS lines, m.batch AS batch FROM (SELECT doc, unnest(m) AS m FROM folds)"""


_OVER = f"s[-1].held + p[1].lines > {X.CHUNK_LINES}"
_FULL = f"s[-1].held >= {X.CHUNK_LINES}"
ORACLE_SQL["q_pack_serial"] = packing(f"{{'page_num': p[1].page_num, 'lines': p[1].lines, 'batch': s[-1].batch + CASE WHEN {_OVER} THEN 1 ELSE 0 END, 'held': CASE WHEN {_OVER} THEN p[1].lines ELSE s[-1].held + p[1].lines END, 'first': false}}")
ORACLE_SQL["q_pack_stream"] = packing(f"{{'page_num': p[1].page_num, 'lines': p[1].lines, 'batch': s[-1].batch + CASE WHEN {_FULL} THEN 1 ELSE 0 END, 'held': CASE WHEN {_FULL} THEN p[1].lines ELSE s[-1].held + p[1].lines END, 'first': false}}")
ORACLE_SQL["q_stream_batches"] = ORACLE_SQL["q_pack_stream"]
ORACLE_SQL["q_slices"] = f"WITH {BLOCKS} SELECT page_num, id, (row_number() OVER (PARTITION BY page_num ORDER BY id) - 1) // {X.CHUNK_LINES} AS slice FROM t0"
ORACLE_SQL["q_halving"] = f"""WITH {BLOCKS}, n AS (SELECT page_num AS batch, count(*) AS lines FROM t0 GROUP BY 1),
h AS (SELECT batch, CASE WHEN lines > {X.CHUNK_LINES} THEN [(lines + 1) // 2, lines // 2] ELSE list_transform(range(lines), lambda x: 1::BIGINT) END AS p FROM n)
SELECT batch, CAST(generate_subscripts(p, 1) - 1 AS BIGINT) AS part, unnest(p) AS part_lines FROM h"""
_SUMS = "count(*) AS calls, round(sum(seconds), 2) AS seconds, CAST(sum(tokens) AS BIGINT) AS completion_tokens, count(*) FILTER (NOT ok) AS failed"
ORACLE_SQL["q_stage_stats"] = ORACLE_SQL["q_merge_stats"] = f"WITH {STATS} SELECT tag, {_SUMS} FROM stats GROUP BY 1"
ORACLE_SQL["q_throughput"] = f"WITH {STATS} SELECT round(avg(round(tokens / greatest(0.01, seconds), 2)), 4) AS chars_per_sec, 100.0::DOUBLE AS acceptance_rate, round(avg(round(seconds * 1000, 2)), 4) AS latency_ms, CAST(sum(tokens) AS BIGINT) AS chars FROM stats"
ORACLE_SQL["q_progress"] = """WITH d AS (SELECT o_orderkey % 50 AS task, count(*) AS n, count(*) FILTER (o_orderstatus = 'F') AS a, count(*) FILTER (o_orderstatus = 'O') AS b FROM orders GROUP BY 1)
SELECT task, CAST(5 + 10 + floor(30.0 * a / n) + floor(45.0 * b / n) AS BIGINT) AS web, CAST(15 + 15 + floor(35.0 * a / n) + floor(30.0 * b / n) AS BIGINT) AS cli FROM d"""
ORACLE_SQL["q_fast_path"] = "SELECT CASE WHEN (o_custkey % 3 > 0 AND o_orderkey % 60 < 30) OR o_custkey % 5 = 0 THEN 'deep' ELSE 'fast' END AS path_taken, count(*) AS n_pages FROM orders GROUP BY 1"
ORACLE_SQL["q_script_sheet"] = f"""WITH {BOXES} SELECT CAST(page_num AS INT) AS page_num, CAST(ord AS INT) AS id, '=1+"' || ord || chr(10) || 'x' AS raw, CASE WHEN ord % 2 = 0 THEN '译' ELSE '' END AS text, CAST(x0 AS DOUBLE) AS x0, CAST(y1 AS DOUBLE) AS y1 FROM boxes"""
ORACLE_SQL["q_layout_json"] = f"WITH {BOXES} SELECT page_num, count(*) AS n_blocks, CAST(sum(x1) AS BIGINT) AS sum_x1, false AS hidden FROM boxes GROUP BY 1"
ORACLE_SQL["q_streamed_reply"] = """SELECT conv_id + 1000 AS call, string_agg(role, '' ORDER BY turn) AS content, CAST(NULL AS VARCHAR) AS finish_reason, count(*) AS completion_tokens FROM conversations GROUP BY 1
UNION ALL SELECT 1, '你好', 'stop', 7 UNION ALL SELECT 2, 'a', NULL, 1"""
ORACLE_SQL["q_reply_join"] = f"""WITH {BLOCKS}, r AS (SELECT * FROM (VALUES (1, 1, '好', false), (1, 2, '', true), (2, 1, '是', false), (3, 3, '单', false), (5, 5, '五', false)) v(page_num, id, trans, sfx))
SELECT b.page_num, b.id, coalesce(sfx, false) AS is_sfx, coalesce(trans, '') AS translated_text FROM t0 b LEFT JOIN r USING (page_num, id)"""
ORACLE_SQL["q_editor_blocks"] = f"""WITH {BOXES}, e AS (SELECT page_num + 1000 AS doc, 1 AS page_num, ord AS id, CAST(x0 AS DOUBLE) AS x0, CAST(y0 AS DOUBLE) AS y0, CAST(x1 AS DOUBLE) AS x1, CAST(y1 AS DOUBLE) AS y1, false AS user_edited, NULL AS direction, conf AS f FROM boxes
UNION ALL SELECT 1, 3, 1, 0, 0, 10, 10, true, 'vertical', 200 UNION ALL SELECT 4, 1, 4, 1, 2, 30, 40, false, NULL, 0)
SELECT doc, page_num, id, x1 - x0 AS width, y1 - y0 AS height, (x0 + x1) / 2 AS center_x, (y0 + y1) / 2 AS center_y, user_edited, direction, CASE WHEN f > 0 THEN least(greatest(f, 4), 150)::DOUBLE END AS font_size_pt FROM e"""
ORACLE_SQL["q_editor_violations"] = """SELECT * FROM (VALUES (1, 3, 1, 'box'), (1, 3, 1, 'id repeats'), (2, 0, 1, 'page'), (2, NULL, NULL, 'page'), (3, NULL, NULL, 'no pages'), (4, 1, NULL, 'incomplete'), (4, 1, 2, 'incomplete'), (4, 1, 3, 'box')) v(doc, page_num, id, problem)
UNION ALL SELECT l_orderkey + 1000, NULL, NULL, 'too many rows' FROM lineitem GROUP BY 1 HAVING count(*) > 5000"""
ORACLE_SQL["q_cascade"] = f"""{ROUTED}, given AS (SELECT route, cleaned_text, CASE WHEN (page_num + id) % 3 = 0 THEN 1 WHEN id % 2 = 1 THEN 2 END AS step FROM routed)
SELECT CASE WHEN route = 'noise' THEN 'effect filter' WHEN route = 'number' THEN 'digits' WHEN route = 'glossary' THEN 'glossary' WHEN route = 'translate' AND step = 1 THEN 'first' WHEN route = 'translate' AND step = 2 THEN 'second' ELSE 'untranslated' END AS translation_engine,
CASE WHEN route = 'number' THEN '#' WHEN route = 'glossary' THEN '魔术' WHEN route = 'translate' AND step = 1 THEN '好' WHEN route = 'translate' AND step = 2 THEN '行！？' ELSE '' END AS translated_text, count(*) AS n_blocks FROM given GROUP BY ALL"""

# The language check: tokens are Latin words or single characters, judged with their neighbours.
LINES = f"""lines AS (SELECT -1 AS page_num, id, 'OK!? Don''t' AS raw, text FROM {rows(R.SAMPLE_LINES, 'id, text')} UNION ALL SELECT conv_id, turn, regexp_replace(text, '[^ ]+$', ''), '好' || text FROM conversations),
tokens AS (SELECT page_num, id, text, list_transform(regexp_extract_all(coalesce(raw, ''), '[A-Za-z][A-Za-z'']*'), lambda w: lower(w)) AS said, regexp_extract_all(coalesce(text, ''), '(?s)[A-Za-z][A-Za-z'']*|.') AS ts FROM lines)"""
_DIGIT = r"^\p{Nd}$"
_NEAR = [f"coalesce(regexp_matches(list_extract(ts, i {k}), {q(_DIGIT)}), false)" for k in ("- 1", "+ 1")]
_NEAR[0] = f"(i > 1 AND {_NEAR[0]})"
_FINE = f"(t IN ({listed(list(X.EMOTIVE + X.SENTENCE_MARKS))}) OR regexp_matches(t, {q(f'^(?:{X.EMOJI}|{X.WIDE_HAN}|{X.WHITE})$')}) OR regexp_matches(t, {q(_DIGIT)}) OR list_contains(said, lower(t)))"
_MARK = f"(t IN ({listed(list(X.ASCII_MARKS))}) OR (t IN ({listed(list(X.DIGIT_MARKS))}) AND ({_NEAR[0]} OR {_NEAR[1]})))"
_SEVERE = f"CASE WHEN {_FINE} THEN '' WHEN regexp_matches(t, '\\p{{L}}') OR regexp_matches(t, {q(X.KANA)}) OR regexp_matches(t, {q(X.HANGUL)}) THEN 'hard' WHEN {_MARK} THEN '' ELSE 'soft' END"
JUDGED = f"""{LINES}, judged AS (SELECT page_num, id, text, list_transform(ts, lambda t, i: {{'t': t, 's': {_SEVERE}, 'between': {_NEAR[0]} AND {_NEAR[1]}}}) AS j FROM tokens),
chars AS (SELECT page_num, id, list_filter(flatten(list_transform(list_filter(j, lambda x: x.s = 'hard'), lambda x: string_split(replace(x.t, '''', ''), ''))), lambda c: c <> '') AS h, list_transform(list_filter(j, lambda x: x.s = 'soft'), lambda x: x.t) AS f FROM judged),
found AS (SELECT page_num, id, array_to_string(list_filter(h, lambda c, i: list_position(h, c) = i), '') AS hard, array_to_string(list_filter(f, lambda c, i: list_position(f, c) = i), '') AS soft FROM chars)"""
_WIDE = f"translate(x.t, {q(''.join(X.ASCII_MARKS))}, {q(''.join(X.ASCII_MARKS.values()))})"
_PUT = f"CASE WHEN x.s <> '' THEN regexp_replace(regexp_replace(x.t, '[^'']', '', 'g'), '''', '’', 'g') WHEN x.between AND x.t IN ({listed(list(X.DIGIT_MARKS))}) THEN x.t ELSE {_WIDE} END"
_ONE = "joined"
for _mark in "，。、：；":
    _ONE = f"regexp_replace({_ONE}, '{_mark}+', '{_mark}', 'g')"
SANE = f"""{JUDGED}, put AS (SELECT page_num, id, text, regexp_replace(array_to_string(list_transform(j, lambda x: {_PUT}), ''), '[ 　]{{2,}}', ' ', 'g') AS joined FROM judged),
trimmed AS (SELECT page_num, id, text, {strip(f"regexp_replace({_ONE}, {q(f'^[，。、：；—{X.WHITE[1:-1]}]+|[，、：；—{X.WHITE[1:-1]}]+$')}, '', 'g')")} AS c FROM put),
sane AS (SELECT page_num, id, text, CASE WHEN regexp_matches(c, {q(X.WIDE_HAN)}) THEN c ELSE '' END AS clean FROM trimmed)"""
ORACLE_SQL["q_find_issues"] = f"WITH {JUDGED} SELECT page_num, id, hard, soft, substr(hard || soft, 1, 12) AS hint FROM found"
ORACLE_SQL["q_flagged"] = f"WITH {JUDGED} SELECT page_num, id, hard || soft AS chars FROM found WHERE hard || soft <> ''"
ORACLE_SQL["q_sanitize"] = f"WITH {SANE} SELECT page_num, id, clean FROM sane"
ORACLE_SQL["q_check_report"] = f"WITH {SANE} SELECT CASE WHEN clean = '' THEN 'emptied' ELSE 'cleaned' END AS action, count(*) AS n_lines, CAST(sum(length(hard || soft)) AS BIGINT) AS n_removed FROM found JOIN sane USING (page_num, id) WHERE hard || soft <> '' GROUP BY 1"
ORACLE_SQL["q_warning"] = f"""WITH {JUDGED}, bad AS (SELECT page_num, id FROM found WHERE hard || soft <> ''), top AS (SELECT * FROM bad ORDER BY page_num, id LIMIT {X.REPORT_ROWS})
SELECT (SELECT count(*) FROM bad) AS n, (SELECT string_agg('page ' || page_num || ' #' || id, ', ' ORDER BY page_num, id) FROM top) AS places"""
ORACLE_SQL["q_check_and_fix"] = f"""WITH {SANE}, s AS (SELECT id, hard, soft, clean FROM found JOIN sane USING (page_num, id)),
a AS (SELECT CASE WHEN hard = '' AND soft = '' THEN 'fine' WHEN hard <> '' AND id % 2 = 0 THEN 'retranslated' WHEN clean = '' THEN 'emptied' ELSE 'cleaned' END AS action, CASE WHEN hard = '' THEN 0 WHEN id % 2 = 0 THEN 1 ELSE 2 END AS retries FROM s)  -- こ is the first hard character of all, so every odd line's retries name it and fail
SELECT action, retries, count(*) AS n_lines FROM a GROUP BY ALL"""
ORACLE_SQL["q_union_issues"] = f"""WITH {JUDGED}, pages AS (SELECT page_num, flatten(list(h ORDER BY id)) AS h FROM chars GROUP BY 1)
SELECT page_num, array_to_string(list_filter(h, lambda c, i: list_position(h, c) = i), '') AS hard FROM pages"""
ORACLE_SQL["q_wrapped"] = f"""WITH {BLOCKS} SELECT page_num, id, CASE WHEN t = '' THEN text ELSE array_to_string(regexp_extract_all(text, {q(f'(?s).{{12}}[{X.CLOSING}]*|.+')}), chr(10)) END AS lines FROM t0"""
ORACLE_SQL["q_joined_lines"] = f"""WITH {BLOCKS} SELECT page_num, md5(CASE WHEN lang = 'xx' THEN string_agg(text, '' ORDER BY id) ELSE string_agg(text, ' ' ORDER BY id) END) AS text_md5, CASE WHEN lang IN ('en', 'fr') THEN lang ELSE 'other' END AS lang FROM t0 GROUP BY page_num, t0.lang"""


def grown(low: str, high: str, limit: int) -> list[str]:
    start = f"greatest(0, least(({low} + {high}) // 2 - 32, {limit} - 64))"
    return [f"CASE WHEN {high} - {low} >= 64 THEN {low} ELSE {start} END AS w_{low}", f"CASE WHEN {high} - {low} >= 64 THEN {high} ELSE {start} + 64 END AS w_{high}"]


ORACLE_SQL["q_box_shapes"] = f"""WITH {BOXES}, s AS (SELECT *, x1 - x0 AS w, y1 - y0 AS h FROM boxes) SELECT page_num, ord, w / (h + 1e-5) > 0.15 AND w / (h + 1e-5) < 8 AND w < 60 AND h < 50 AS character,
w > 15 AND h > 8 AND w < 285 AND h < 237.5 AS line, {', '.join(grown('x0', 'x1', 300) + grown('y0', 'y1', 250))} FROM s"""
ORACLE_SQL["q_usage_merge"] = "SELECT CASE WHEN event_id % 7 = 0 THEN 'Unknown' ELSE event_type END AS engine, count(*) AS n_blocks FROM events GROUP BY 1"
ORACLE_SQL["q_ocr_batches"] = f"WITH {BOXES}, s AS (SELECT (row_number() OVER (PARTITION BY page_num ORDER BY ord) - 1) // 16 AS slice FROM boxes) SELECT slice, count(*) AS n_boxes FROM s GROUP BY 1"
ORACLE_SQL["q_dictionary"] = "SELECT CAST(p_partkey AS VARCHAR) AS src, p_name AS tgt, 'parts' AS tier FROM part WHERE p_partkey % 10 = 0 UNION ALL SELECT * FROM (VALUES ('Theo', '西奥', 'terms'), ('魔術', '魔术', 'terms'))"
ORACLE_SQL["q_text_cache"] = f"""WITH {BLOCKS}, c AS (SELECT t, lang = 'en' AS old, id % 2 = 0 AS new FROM t0 WHERE t <> ''), k AS (SELECT t, bool_or(old) AS old, bool_or(new) AS new FROM c GROUP BY t)
SELECT substr(sha256(t), 1, 20) AS cache_key, sha256(CASE WHEN new THEN '新' ELSE '旧' END || t) AS cached_sha256 FROM k WHERE old OR new"""
ORACLE_SQL["q_scripts"] = f"""WITH {BLOCKS}, ts AS (SELECT lang, unnest(regexp_extract_all(text, '(?s)[A-Za-z][A-Za-z'']*|.')) AS t FROM t0)
SELECT lang, CASE WHEN regexp_matches(t, {q(X.KANA)}) THEN 'kana' WHEN regexp_matches(t, {q(X.HANGUL)}) THEN 'hangul' WHEN regexp_matches(t, {q(X.WIDE_HAN)}) THEN 'cjk' WHEN regexp_matches(t, {q(X.WHITE)}) THEN 'space'
  WHEN regexp_matches(t, '^[\\p{{Nd}}\\x{{b2}}\\x{{b3}}\\x{{b9}}\\x{{2070}}\\x{{2074}}-\\x{{2079}}\\x{{2080}}-\\x{{2089}}]$') THEN 'digit' WHEN regexp_matches(t, '\\p{{Latin}}') AND regexp_matches(t, '\\p{{L}}') THEN 'latin' WHEN regexp_matches(t, '\\p{{L}}') THEN 'script' ELSE 'symbol' END AS script, count(*) AS n_tokens FROM ts GROUP BY ALL"""
ORACLE_SQL["q_vertical_columns"] = f"""WITH {BLOCKS}, p AS (SELECT page_num, id, list_filter(list_transform(string_split_regex(text, '\\r\\n|\\r|\\n'), lambda x: {strip('x')}), lambda x: x <> '') AS ps FROM t0)
SELECT page_num, id, array_to_string(flatten(list_transform(ps, lambda x: regexp_extract_all(x, '(?s).{{7}}[！？…。，、：；）」』》〉”’!?,.]*|.+'))), '|') AS columns FROM p"""
ORACLE_SQL["q_gap_overlaps"] = f"""WITH {BOXES} SELECT a.page_num, a.ord, count(*) AS n_near FROM boxes a JOIN boxes b ON a.page_num = b.page_num AND a.ord <> b.ord
AND a.x0 < b.x1 + 2 AND b.x0 < a.x1 + 2 AND a.y0 < b.y1 + 2 AND b.y0 < a.y1 + 2 GROUP BY ALL"""
_SAID = "CASE WHEN conf % 3 = 2 THEN NULL WHEN conf % 6 = 0 THEN ' ' ELSE '译' || conf END"
ORACLE_SQL["q_renderable"] = f"WITH {BOXES}, s AS (SELECT page_num, ord AS id, {_SAID} AS translated_text FROM boxes) SELECT * FROM s WHERE trim(coalesce(translated_text, '')) <> ''"
ORACLE_SQL["q_editor_projection"] = f"""WITH {BOXES} SELECT page_num, ord AS id, x0, CASE WHEN conf % 2 = 0 THEN 'c' ELSE 't' END || conf AS raw, coalesce({_SAID}, '') AS text, CASE WHEN conf % 3 = 0 THEN 'vertical' ELSE 'horizontal' END AS direction,
CASE WHEN conf % 5 = 0 THEN 'file:a.ttf' ELSE '' END AS font, CASE WHEN conf % 7 = 0 THEN conf ELSE 0 END::DOUBLE AS font_size, CASE WHEN conf % 4 = 0 THEN conf / 2 ELSE 0 END::DOUBLE AS glyph_pt FROM boxes WHERE conf % 17 <> 0"""
EDITED = f"""{BOXES}, o AS (SELECT page_num, ord, conf, {_SAID} AS said, CASE WHEN conf % 17 = 0 THEN 0 ELSE x0 END AS x0, CASE WHEN conf % 17 = 0 THEN 0 ELSE y0 END AS y0, CASE WHEN conf % 17 = 0 THEN 0 ELSE x1 END AS x1, CASE WHEN conf % 17 = 0 THEN 0 ELSE y1 END AS y1 FROM boxes),
n AS (SELECT m.page_num, m.ord, m.x0, m.y0, m.x1, m.y1, b.conf AS c, CASE WHEN b.conf % 3 = 2 THEN '' WHEN b.conf % 6 = 0 THEN ' ' WHEN b.conf % 11 = 0 THEN '改' ELSE '译' || b.conf END AS text FROM moved m JOIN boxes b ON m.page_num = b.page_num AND m.was = b.ord WHERE m.page_num % 3 = 0),
both_ AS (SELECT coalesce(o.page_num, n.page_num) AS page_num, coalesce(o.ord, n.ord) AS id, CASE WHEN n.ord IS NULL THEN 'removed' WHEN o.ord IS NULL THEN 'drawn' ELSE 'kept' END AS change, n.c, n.text,
  coalesce(greatest(abs(o.x0 - n.x0), abs(o.y0 - n.y0), abs(o.x1 - n.x1), abs(o.y1 - n.y1)) > 1, false) AS moved, coalesce(n.text <> coalesce(o.said, ''), false) AS typed,
  coalesce((n.c % 2 = 0) <> (o.conf % 3 = 0), false) AS turned, coalesce(CASE WHEN n.c % 14 = 0 THEN n.c ELSE 0 END <> CASE WHEN o.conf % 7 = 0 THEN o.conf ELSE 0 END, false) AS sized, coalesce((n.c % 10 = 0) <> (o.conf % 5 = 0), false) AS refont
  FROM (SELECT * FROM o WHERE page_num IN (SELECT page_num FROM n)) o FULL JOIN (SELECT * FROM n WHERE page_num IN (SELECT page_num FROM o)) n ON o.page_num = n.page_num AND o.ord = n.ord),
edited AS (SELECT page_num, id, change, moved AND change = 'kept' AS moved, typed AND change = 'kept' AS typed, turned AND change = 'kept' AS turned, sized AND change = 'kept' AS sized, refont AND change = 'kept' AS refont, c, text FROM both_),
plan AS (SELECT page_num, id, change, moved, typed, turned, sized, refont, change = 'drawn' OR moved OR typed OR turned OR sized OR refont AS user_edited, (moved AND NOT typed) OR (change = 'drawn' AND trim(text) = '' AND c % 13 = 0) AS need_ocr FROM edited)"""
ORACLE_SQL["q_review_plan"] = f"WITH {EDITED} SELECT * FROM plan"
ORACLE_SQL["q_read_again"] = f"""WITH {EDITED}, r AS (SELECT p.page_num, p.id, CASE WHEN x0 % 4 = 0 THEN '' ELSE 'x' || x0 END AS text FROM plan p JOIN boxes b ON p.page_num = b.page_num AND p.id = b.ord WHERE need_ocr)
SELECT page_num, id, text, CASE WHEN text = '' THEN '' ELSE '译' || text END AS translated_text, text = '' AS blank FROM r"""
ORACLE_SQL["q_recognised"] = f"""WITH {BOXES}, near AS (SELECT b.page_num, b.ord, string_agg('s' || s.was, ' ' ORDER BY s.was) AS text FROM boxes b JOIN moved s USING (page_num) WHERE b.x0 % 3 = 2 AND {inter('b', 's')} > 0 GROUP BY ALL),
r AS (SELECT page_num, ord, CASE WHEN x0 % 3 = 0 THEN 'word ' || y0 % 9 ELSE 'line ' || ord END AS text, CASE WHEN x0 % 3 = 0 THEN 'first' ELSE 'second' END AS ocr_engine FROM boxes WHERE x0 % 3 = 0 OR (x0 % 3 = 1 AND y0 % 2 = 1) UNION ALL SELECT page_num, ord, text, 'overlap' FROM near)
SELECT page_num, ord, text, ocr_engine FROM r QUALIFY row_number() OVER (PARTITION BY page_num, replace(text, ' ', '') ORDER BY ord) = 1"""
_INK = "ink AS (SELECT c_custkey AS box, p AS position, (p + c_custkey) % (8 + c_custkey % 23) < c_custkey % 19 AS inked FROM customer, range(60) t(p))"
ORACLE_SQL["q_glyph_sizes"] = f"""WITH {_INK}, i AS (SELECT box, position, position - row_number() OVER (PARTITION BY box ORDER BY position) AS island FROM ink WHERE inked),
r AS (SELECT box, count(*) AS n FROM i GROUP BY box, island HAVING count(*) >= 6), m AS (SELECT box, n FROM r QUALIFY n >= 0.6::DOUBLE * max(n) OVER (PARTITION BY box)),
g AS (SELECT c_custkey AS box, coalesce((SELECT CAST(floor(median(n)) AS BIGINT) FROM m WHERE m.box = c_custkey), 0) AS glyph, c_custkey % 12 + 1 AS page FROM customer)
SELECT box, glyph, CASE WHEN glyph > 0 THEN least(greatest(glyph, CAST(trunc(page * 0.8::DOUBLE) AS BIGINT)), CAST(trunc(page * 1.6::DOUBLE) AS BIGINT)) ELSE CAST(trunc(page * 1.6::DOUBLE) AS BIGINT) END AS most FROM g"""
ORACLE_SQL["q_area_sizes"] = f"""WITH {BOXES}, s AS (SELECT page_num, ord, conf, ord * 7 % 40 AS most, greatest(x1 - x0 - CAST(trunc((x1 - x0) * 0.15::DOUBLE) AS BIGINT), 20) AS w, greatest(y1 - y0 - CAST(trunc((y1 - y0) * 0.15::DOUBLE) AS BIGINT), 20) AS h FROM boxes),
a AS (SELECT *, least(CAST(trunc(trunc(sqrt(w * h / (greatest(conf, 1) * 1.25::DOUBLE))) * 1.5::DOUBLE) AS BIGINT), w, h, 120) AS area FROM s)
SELECT page_num, ord, 10::BIGINT AS low, greatest(CASE WHEN most > 0 THEN least(area, most) ELSE area END, 10) AS high FROM a"""
ORACLE_SQL["q_split_columns"] = f"""WITH {BOXES}, g AS (SELECT *, 2 + conf % 14 AS w, CASE WHEN conf % 4 = 0 THEN 30 ELSE 2 + conf % 3 END AS gap0 FROM boxes),
c0 AS (SELECT page_num, w, y0 AS low, y1 AS high, sum(w + gap0) OVER (PARTITION BY page_num ORDER BY ord) - w AS start FROM g),
c1 AS (SELECT *, start + w AS stop, max(w) OVER b AS widest FROM c0 WINDOW b AS (PARTITION BY page_num)),
c2 AS (SELECT c1.*, (SELECT median(d.w) FROM c1 d WHERE d.page_num = c1.page_num AND d.w >= 0.45::DOUBLE * d.widest) AS main_w FROM c1),
c3 AS (SELECT *, w < 0.45::DOUBLE * main_w AS slim FROM c2),
c4 AS (SELECT *, max(high - low) FILTER (NOT slim) OVER (PARTITION BY page_num) AS tall FROM c3),
c AS (SELECT *, slim AND NOT (high - low >= 0.6::DOUBLE * tall AND w >= 0.3::DOUBLE * widest) AS narrow FROM c4),
m0 AS (SELECT *, start - lag(stop) OVER o AS gap, least(lag(high) OVER o, high) - greatest(lag(low) OVER o, low) AS shared, least(lag(high) OVER o - lag(low) OVER o, high - low) AS shorter FROM c WHERE NOT narrow WINDOW o AS (PARTITION BY page_num ORDER BY start)),
m1 AS (SELECT *, median(gap) OVER (PARTITION BY page_num) AS usual FROM m0),
m AS (SELECT *, 1 + sum(CASE WHEN (gap > greatest(1.8::DOUBLE * usual, 0.6::DOUBLE * main_w) AND gap > usual + 4) OR (shorter > 0 AND shared < 0.5::DOUBLE * shorter) THEN 1 ELSE 0 END) OVER (PARTITION BY page_num ORDER BY start) AS part FROM m1),
e AS (SELECT page_num, part, min(start) AS s, max(stop) AS t FROM m GROUP BY ALL),
f AS (SELECT c.page_num, part, start, stop, low, high FROM c JOIN e USING (page_num) WHERE narrow QUALIFY row_number() OVER (PARTITION BY c.page_num, start ORDER BY least(abs((start + stop) / 2 - s), abs((start + stop) / 2 - t)), part) = 1),
every AS (SELECT page_num, part, start, stop, low, high FROM m UNION ALL SELECT * FROM f)
SELECT page_num, 1 AS ord, CAST(part AS BIGINT) AS part, CAST(min(start) AS BIGINT) AS start, CAST(max(stop) AS BIGINT) AS stop, min(low) AS low, max(high) AS high FROM every GROUP BY page_num, part"""
ORACLE_SQL["q_catalogue"] = """WITH f AS (SELECT p_brand AS font, p_name AS name, '/' || p_partkey AS path FROM part WHERE p_size % 4 <> 0 QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey % 3, p_partkey) = 1),
a AS (SELECT CASE WHEN p_size % 2 = 0 AND p_brand IN (SELECT font FROM f) THEN p_brand ELSE '' END AS font, count(*) AS n FROM part GROUP BY 1) SELECT font, n, name, path FROM a LEFT JOIN f USING (font)"""
ORACLE_SQL["q_spread_of_values"] = """WITH v AS (SELECT event_type, round(value % 256, 2) AS v FROM events) SELECT event_type, round(quantile_cont(v, 0.95), 6) AS p95, round(stddev_pop(v), 6) AS deviation,
round(avg(CASE WHEN v > 90 THEN 1 ELSE 0 END), 6) AS white, round(avg(CASE WHEN v BETWEEN 40 AND 90 THEN 1 ELSE 0 END), 6) AS middle, round(avg(CASE WHEN v < 40 THEN 1 ELSE 0 END), 6) AS dark FROM v GROUP BY 1"""
ORACLE_SQL["q_polished"] = f"""WITH {BLOCKS}, w AS (SELECT id, text, {words('text')} AS ws FROM t0), d AS (SELECT id, CASE id % 3 WHEN 0 THEN '你好吗你好' WHEN 1 THEN '是' ELSE '' END AS draft, NOT (
  {has("replace(text, ' ', '')", r'^\p{Nd}+$')} OR (len(ws) > 0 AND len(list_filter(ws, lambda x: {has('x', r'\p{Lu}')} AND NOT {has('x', r'[\p{Ll}\p{Lt}]')} AND length(x) > 2)) / len(ws) > 0.5) OR (id % 3 = 0 AND len(ws) <= 6)) AS worth FROM w),
b AS (SELECT draft, worth AND draft <> '' AND id % 2 = 0 AS better FROM d) SELECT CASE WHEN better THEN '好……' ELSE draft END AS translated_text, CASE WHEN better THEN 'polished' ELSE 'web' END AS translation_engine, count(*) AS n_blocks FROM b GROUP BY ALL"""
_TOP = "row_number() OVER (ORDER BY page_num, id) <= 8"
ORACLE_SQL["q_warnings"] = f"""WITH {SANE}, bad AS (SELECT page_num, id, hard || soft AS chars, clean FROM found JOIN sane USING (page_num, id) WHERE hard || soft <> ''), n AS (SELECT count(*) AS n, count(*) FILTER (clean <> '') AS cleaned, count(*) FILTER (clean = '') AS emptied FROM bad),
top AS (SELECT *, '第' || page_num || '页#' || id AS place FROM bad QUALIFY {_TOP}), more AS (SELECT CASE WHEN n > 8 THEN ' 等共 ' || n || ' 行' ELSE '' END AS t FROM n)
SELECT 'failed' AS kind, (SELECT count(*) || ' 页提取失败，已保留原页未翻译: 第 ' || string_agg(n_nationkey, ', ' ORDER BY n_nationkey) || ' 页' FROM nation WHERE n_nationkey % 7 = 0) AS warning
UNION ALL SELECT 'none failed', ''
UNION ALL SELECT 'flagged', '校对译文含非简体中文字符或符号（未自动修改）: ' || (SELECT string_agg(place || '（' || substr(chars, 1, 6) || '）', '、' ORDER BY page_num, id) FROM top) || (SELECT t FROM more)
UNION ALL SELECT 'language', '语言检查: ' || (SELECT array_to_string(list_filter([CASE WHEN cleaned > 0 THEN cleaned || ' 行已清理非法字符' END, CASE WHEN emptied > 0 THEN emptied || ' 行清理后无中文，保留原文' END], lambda x: x IS NOT NULL), '，') FROM n)
  || '：' || (SELECT string_agg(place || '（去掉「' || chars || '」）', '、' ORDER BY page_num, id) FROM top) || (SELECT t FROM more)"""
ORACLE_SQL["q_page_errors"] = """WITH p AS (SELECT doc_id, length(unnest(string_split(coalesce(text, ''), chr(10)))) AS n FROM documents)
SELECT CAST(doc_id AS VARCHAR) AS path, count(*) AS n_pages, CAST(sum(n) FILTER (n % 5 <> 0) AS BIGINT) AS n_chars, count(*) FILTER (n % 5 = 0) AS n_failed, CASE WHEN bool_or(n % 5 = 0) THEN 'ValueError: odd page' ELSE '' END AS error FROM p GROUP BY doc_id"""
ORACLE_SQL["q_sorted_pages"] = "SELECT o_orderkey AS page_num, row_number() OVER (ORDER BY o_orderkey) AS place FROM orders"
ORACLE_SQL["q_stream_out_of_order"] = packing(f"{{'page_num': p[1].page_num, 'lines': p[1].lines, 'batch': s[-1].batch + CASE WHEN {_FULL} THEN 1 ELSE 0 END, 'held': CASE WHEN {_FULL} THEN p[1].lines ELSE s[-1].held + p[1].lines END, 'first': false}}").replace(
    f"{TURNS}, ", f"{TURNS.replace('turns AS', 'said AS')}, turns AS (SELECT doc, row_number() OVER (PARTITION BY doc ORDER BY page_num, lines) AS page_num, lines + 1 AS lines FROM said), ")
_OOM = " OR ".join(f"contains(lower(message), {q(e)})" for e in X.MEMORY_ERRORS)
ORACLE_SQL["q_memory_errors"] = f"""WITH m AS (SELECT * FROM {rows(list(enumerate(ERRORS)), 'n, message')} UNION ALL SELECT p_partkey + 100, CASE WHEN p_size % 5 = 0 THEN 'cuDNN ' ELSE '' END || p_name FROM part)
SELECT n, coalesce({_OOM}, false) AS oom FROM m"""
# Each model's turn adds to a list: what is left of the budget, and the devices so far.
ORACLE_SQL["q_placement"] = """WITH seen AS (SELECT 'm' || (p_partkey % 7) AS model, p_partkey AS n, p_retailprice * (p_partkey % 9) AS delta FROM part),
costs AS (SELECT 'm' || k AS model, k, coalesce((SELECT arg_max(greatest(100, CAST(trunc(delta * 1.2::DOUBLE) AS BIGINT)), n) FROM seen WHERE model = 'm' || k AND model <> 'm3' AND delta BETWEEN 30 AND 6000), 300 + 150 * k) AS need FROM range(7) t(k)),
hosts AS (SELECT s_suppkey AS host, CASE WHEN s_suppkey % 11 <> 0 THEN abs(s_acctbal) END AS free, s_suppkey % 4 * 100 AS reserve FROM supplier),
m AS (SELECT host, model, k, need::DOUBLE AS need, free, reserve, (host + k) % 5 <> 0 AS capable, (host + k) % 6 = 0 AS resident FROM hosts, costs),
lists AS (SELECT host, list([{'model': model, 'need': need, 'free': free, 'reserve': reserve, 'capable': capable, 'resident': resident, 'room': free - reserve, 'device': 'cpu'}] ORDER BY k) AS l FROM m GROUP BY 1),
starts AS (SELECT host, list_concat([[{'model': '', 'need': 0.0::DOUBLE, 'free': l[1][1].free, 'reserve': l[1][1].reserve, 'capable': false, 'resident': false, 'room': l[1][1].room, 'device': 'cpu'}]], l) AS l FROM lists),
folds AS (SELECT host, list_reduce(l, lambda s, p: list_concat(s, [{'model': p[1].model, 'need': p[1].need, 'free': p[1].free, 'reserve': p[1].reserve, 'capable': p[1].capable, 'resident': p[1].resident,
  'room': CASE WHEN p[1].capable AND NOT p[1].resident AND s[-1].room >= p[1].need THEN s[-1].room - p[1].need ELSE s[-1].room END,
  'device': CASE WHEN p[1].capable AND p[1].resident AND p[1].free >= p[1].reserve / 2 THEN 'gpu' WHEN p[1].capable AND NOT p[1].resident AND s[-1].room >= p[1].need THEN 'gpu' ELSE 'cpu' END}])) AS f FROM starts),
placed AS (SELECT host, unnest(f[2:]) AS m FROM folds) SELECT host, m.model AS model, m.device AS device FROM placed"""
ORACLE_SQL["q_progress_events"] = """WITH e AS (SELECT user_id AS task, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
s AS (SELECT task, n, n // 3 AS percent, CASE WHEN event_id % 29 = 0 THEN 'complete' WHEN event_id % 31 = 0 THEN 'failed' WHEN event_id % 5 < 2 THEN 'review' ELSE 'processing' END AS status FROM e),
ends AS (SELECT task, min(n) AS last FROM s WHERE status IN ('complete', 'failed') GROUP BY 1),
p AS (SELECT s.*, last, lag(status) OVER o AS was, coalesce(lag(percent) OVER o, -1) AS before FROM s LEFT JOIN ends USING (task) WINDOW o AS (PARTITION BY task ORDER BY n)),
t AS (SELECT task, n, percent, CASE status WHEN 'complete' THEN 'complete' WHEN 'failed' THEN 'error' WHEN 'review' THEN CASE WHEN was IS DISTINCT FROM 'review' THEN 'review' END ELSE CASE WHEN percent <> before OR was = 'review' THEN 'progress' END END AS event FROM p WHERE last IS NULL OR n <= last)
SELECT task, n, event, percent FROM t WHERE event IS NOT NULL"""
# Sizes by halving, unrolled over seven bits, and a fold over a page's boxes that shrinks each until it is clear of those before it.
_FITS_AT = "ceil(greatest(n, 1) / greatest(1, w // {s})) * {s} * 1.25::DOUBLE <= h AND least(greatest(n, 1), greatest(1, w // {s})) * {s} <= w + 5"
ORACLE_SQL["q_placed_lettering"] = f"""WITH RECURSIVE {BOXES}, b AS (SELECT page_num, ord, x0, y0, x1 - x0 AS bw, y1 - y0 AS bh, conf % 23 AS n, CASE WHEN conf % 3 = 0 THEN conf % 40 ELSE 0 END AS most, CASE WHEN conf % 19 = 0 THEN 14 ELSE 0 END AS forced,
  greatest(x1 - x0 - CAST(trunc((x1 - x0) * 0.15::DOUBLE) AS BIGINT), 20) AS w, greatest(y1 - y0 - CAST(trunc((y1 - y0) * 0.15::DOUBLE) AS BIGINT), 20) AS h FROM boxes),
caps AS (SELECT *, least(CAST(trunc(trunc(sqrt(w * h / (greatest(n, 1) * 1.25::DOUBLE))) * 1.5::DOUBLE) AS BIGINT), w, h, 120) AS area FROM b),
sizes AS (SELECT DISTINCT n, w, h, area, t.cap FROM caps, (SELECT unnest(range(0, 121)) AS cap) t WHERE t.cap = 0 OR t.cap <= 120),
halves AS (SELECT n, w, h, area, cap, 9::BIGINT AS lo, CASE WHEN cap > 0 THEN least(area, cap) ELSE area END AS hi, 9::BIGINT AS best FROM sizes
  UNION ALL SELECT n, w, h, area, cap, CASE WHEN {_FITS_AT.format(s='((lo + hi) // 2)')} THEN (lo + hi) // 2 + 1 ELSE lo END, CASE WHEN {_FITS_AT.format(s='((lo + hi) // 2)')} THEN hi ELSE (lo + hi) // 2 - 1 END,
    CASE WHEN {_FITS_AT.format(s='((lo + hi) // 2)')} THEN (lo + hi) // 2 ELSE best END FROM halves WHERE lo <= hi),
fit AS (SELECT n, w, h, area, cap, best FROM halves WHERE lo > hi),
tries AS (SELECT page_num, ord, 0 AS try, most AS cap FROM caps WHERE forced = 0
  UNION ALL SELECT t.page_num, t.ord, try + 1, greatest(9, f.best - 2) FROM tries t JOIN caps c USING (page_num, ord) JOIN fit f ON f.n = c.n AND f.w = c.w AND f.h = c.h AND f.area = c.area AND f.cap = t.cap WHERE f.best > 9 AND try < 29),
options AS (SELECT page_num, ord, try, f.best AS size FROM tries t JOIN caps c USING (page_num, ord) JOIN fit f ON f.n = c.n AND f.w = c.w AND f.h = c.h AND f.area = c.area AND f.cap = t.cap UNION ALL SELECT page_num, ord, 0, forced FROM caps WHERE forced > 0),
spots AS (SELECT o.page_num, o.ord, try, size, forced, least(greatest(n, 1), greatest(1, w // size)) * size AS wide, ceil(greatest(n, 1) / greatest(1, w // size)) * size * 1.25::DOUBLE AS tall, x0, y0, bw, bh FROM options o JOIN caps c USING (page_num, ord)),
rects AS (SELECT page_num, ord, list({{'ord': ord, 'size': size, 'l': x0 + (bw - wide) / 2, 't': y0 + greatest(0.0, (bh - tall) / 2), 'r': x0 + (bw - wide) / 2 + wide, 'b': y0 + greatest(0.0, (bh - tall) / 2) + tall, 'f': forced > 0 OR size <= 9}} ORDER BY try) AS c FROM spots GROUP BY 1, 2),
lists AS (SELECT page_num, list(c ORDER BY ord) AS l FROM rects GROUP BY 1),
folds AS (SELECT page_num, list_reduce(list_concat([l[1][:0]], l), lambda s, p: list_concat(s, [coalesce(list_filter(p, lambda x: x.f OR len(list_filter(s, lambda y: x.l < y.r + 2 AND y.l < x.r + 2 AND x.t < y.b + 2 AND y.t < x.b + 2)) = 0)[1], p[-1])])) AS m FROM lists)
SELECT page_num, m.ord AS ord, m.size AS size, CAST(m.l AS DOUBLE) AS left, CAST(m.t AS DOUBLE) AS top, CAST(m.r AS DOUBLE) AS right, CAST(m.b AS DOUBLE) AS bottom FROM (SELECT page_num, unnest(m) AS m FROM folds)"""
