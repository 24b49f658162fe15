"""SQL texts: the synthetic mapping view, and the statements that say in SQL what the queries compute.

Identifiers, literals and functions here are understood by DuckDB; CATALOG also by Spark.
"""

from __future__ import annotations

from quarry.functions.vocabulary import DIMENSIONS

CATALOG = """
SELECT l.l_orderkey, l.l_linenumber,
  s.s_name AS ld_name,
  concat('LD-', cast(l.l_suppkey AS string)) AS ld_article,
  cast(NULL AS string) AS ld_url,
  cast(p.p_size AS string) AS ld_dn,
  cast(10 + 6 * (l.l_suppkey % 4) AS string) AS ld_pn_mpa,
  CASE l.l_suppkey % 5 WHEN 0 THEN 'Flanged end' WHEN 1 THEN 'threaded' WHEN 2 THEN 'WELDED' WHEN 3 THEN 'coupling' ELSE 'unspecified' END AS ld_connection,
  CASE l.l_suppkey % 4 WHEN 0 THEN 'water' WHEN 1 THEN 'gas' WHEN 2 THEN 'Steam' ELSE 'oil' END AS ld_medium,
  CASE l.l_suppkey % 3 WHEN 0 THEN 'manual' WHEN 1 THEN 'electric' ELSE 'gear' END AS ld_control,
  cast(NULL AS string) AS ld_temp,
  concat(cast(cast(l.l_quantity AS int) AS string), ' cm') AS ld_length,
  p.p_name AS steel_name,
  concat(p.p_type, '.', p.p_brand, '-', cast(p.p_size AS string)) AS steel_article,
  CASE WHEN l.l_linenumber % 3 = 0 THEN NULL ELSE concat('https://s.example/', cast(l.l_suppkey % 3 AS string)) END AS steel_url,
  concat('DN ', cast(p.p_size AS string)) AS steel_dn,
  concat('PN', cast(10 + 6 * (p.p_partkey % 4) AS string)) AS steel_pn_bar,
  CASE p.p_partkey % 5 WHEN 0 THEN 'Flanged end' WHEN 1 THEN 'threaded' WHEN 2 THEN 'WELDED' WHEN 3 THEN 'coupling' ELSE 'unspecified' END AS steel_connection,
  CASE l.l_linenumber % 4 WHEN 0 THEN 'water' WHEN 1 THEN 'gas' WHEN 2 THEN 'Steam' ELSE 'oil' END AS steel_medium,
  CASE p.p_partkey % 3 WHEN 0 THEN 'manual' WHEN 1 THEN 'electric' ELSE 'gear' END AS steel_control,
  l.l_returnflag AS steel_temp,
  concat(cast(cast(l.l_quantity AS int) AS string), ' mm') AS steel_length,
  cast(7 + l.l_linenumber % 3 AS int) AS match_score,
  cast(7 AS int) AS match_max,
  l.l_extendedprice AS price_ld
FROM {lineitem} l JOIN {part} p ON l.l_partkey = p.p_partkey JOIN {supplier} s ON l.l_suppkey = s.s_suppkey
"""
CAT = "cat AS (" + CATALOG.format(lineitem="lineitem", part="part", supplier="supplier") + ")"

# The synthetic rows are in ASCII, so only such aliases can occur.
ALIASES = {d: {a: v for a, v in words.items() if a.isascii()} for d, words in DIMENSIONS.items()}
FIELDS = ("dn", "pn_bar", "connection", "medium", "control")


def norm(x: str) -> str:
    return rf"nullif(trim(regexp_replace(translate(replace(lower({x}), 'ß', 'ss'), 'ёς', 'еσ'), '\s+', ' ', 'g')), '')"


def bare(x: str) -> str:
    return rf"nullif(regexp_replace({x}, '[\s./\\_-]+', '', 'g'), '')"


def alias(x: str, dim: str, other: str | None = None) -> str:
    """x is normalised."""
    cases = " ".join(rf"WHEN regexp_matches({x}, '\b{a}\b') THEN '{c}'" for a, c in ALIASES[dim].items())
    return f"CASE {cases} ELSE {x if other is None else other} END"


def number(x: str) -> str:
    return rf"TRY_CAST(nullif(regexp_extract(replace({x}, ',', '.'), '[-+]?\d+(?:[.,]\d+)?'), '') AS DOUBLE)"


def pn(x: str) -> str:
    return f"(CASE WHEN contains({x}, 'mpa') THEN 10 * {number(x)} ELSE {number(x)} END)"


def length(x: str) -> str:
    return rf"(CASE WHEN regexp_matches({x}, '\bcm\b') THEN 10 * {number(x)} WHEN {x} LIKE '%m' AND {x} NOT LIKE '%mm' THEN 1000 * {number(x)} ELSE {number(x)} END)"


def g(x: str) -> str:
    return f"format('{{:g}}', {x}::DOUBLE)"


def lab(prefix: str, x: str, suffix: str = "") -> str:
    return f"CASE WHEN {x} <> '' THEN '{prefix}' || {x} || '{suffix}' END"


def parts(items: list[str], sep: str) -> str:
    """Joined distinct non-empty items, in order."""
    given = f"list_filter([{', '.join(items)}], lambda x: x IS NOT NULL AND x <> '')"
    return f"array_to_string(list_filter({given}, lambda x, i: list_position({given}, x) = i), {sep})"


def distinct_list(given: str) -> str:
    return f"list_filter({given}, lambda x, i: list_position({given}, x) = i)"


TOKENS = r"regexp_extract_all({}, '[\p{{L}}\p{{N}}_]+')"

KEY = ("article_compact", "name_norm", "dn", "pn_bar", "connection", "control")
SRC = f"""
src0 AS (SELECT DISTINCT * EXCLUDE (l_orderkey, l_linenumber) FROM cat),
src AS (SELECT *, concat_ws(chr(1), article_compact, name_norm, coalesce(dn::VARCHAR, '~'), coalesce(pn_bar::VARCHAR, '~'), connection, control) AS k FROM (
  SELECT steel_article AS article, coalesce({norm('steel_article')}, '') AS article_norm, coalesce({bare(norm('steel_article'))}, '') AS article_compact,
    steel_name AS name, coalesce({norm('steel_name')}, '') AS name_norm, steel_url AS url, {number(norm('steel_dn'))} AS dn, {pn(norm('steel_pn_bar'))} AS pn_bar,
    {alias(norm('steel_connection'), 'connection')} AS connection, {alias(norm('steel_medium'), 'medium')} AS medium, {alias(norm('steel_control'), 'control')} AS control,
    {norm('steel_temp')} AS temperature, {length(norm('steel_length'))} AS length_mm, coalesce({norm('ld_article')}, '') AS ld_article_norm,
    ld_article, ld_name, ld_url, {number(norm('ld_dn'))} AS ld_dn, {pn(norm('ld_pn_mpa'))} AS ld_pn_bar, {alias(norm('ld_connection'), 'connection')} AS ld_connection,
    {alias(norm('ld_medium'), 'medium')} AS ld_medium, {alias(norm('ld_control'), 'control')} AS ld_control, {length(norm('ld_length'))} AS ld_length_mm, price_ld AS ld_price
  FROM src0))"""


def canon(name: str, by: str, value: str, table: str = "src") -> str:
    return f"{name} AS (SELECT {by}, {value} FROM (SELECT {by}, {value}, row_number() OVER (PARTITION BY {by} ORDER BY count(*) DESC, {value}::VARCHAR) AS r FROM {table} WHERE {value} IS NOT NULL GROUP BY {by}, {value}) WHERE r = 1)"


_HEAD = ("article", "name", "url", "medium", "temperature", "length_mm")
_LD = ("ld_article", "ld_name", "ld_url", "ld_dn", "ld_pn_bar", "ld_connection", "ld_medium", "ld_control", "ld_length_mm", "ld_price")
_dn, _pn = g("dn"), g("pn_bar")
DOCS = (
    SRC
    + ", "
    + ", ".join(canon(f"c_{f}", "k", f) for f in _HEAD)
    + f""",
dk AS (SELECT k, {', '.join(f'any_value({x}) AS {x}' for x in KEY)}, list_sort(list(DISTINCT name)) AS name_variants FROM src GROUP BY k),
d0 AS (SELECT dk.* EXCLUDE (article_compact), dk.article_compact, {', '.join(f'c_{f}.{f}' for f in _HEAD)}
  FROM dk {' '.join(f'LEFT JOIN c_{f} ON dk.k = c_{f}.k' for f in _HEAD)}),
docs AS (SELECT *, sha1(concat_ws('', article_compact, {norm('name')}, {_dn}, {_pn}, connection, control)) AS steel_id,
  coalesce({norm('article')}, '') AS article_norm, {alias(norm('name'), 'brand')} AS brand FROM d0),
lex AS (SELECT *, array_to_string(list_filter(li, lambda x, i: list_position(li, x) = i), chr(10)) AS lexical_text FROM (
  SELECT *, list_filter(list_concat([name], name_variants, [brand, article, article_norm, article_compact, {lab('DN', _dn)}, {lab('DN ', _dn)}, {lab('Ду', _dn)}, {lab('Ду ', _dn)},
    {lab('PN', _pn)}, {lab('PN ', _pn)}, {lab('Ру', _pn)}, {lab('Ру ', _pn)}, {lab('', _pn, ' бар')}, connection, medium, control]), lambda x: x IS NOT NULL AND x <> '') AS li FROM docs))"""
)
SEMANTIC = parts(
    [lab("Название: ", "name"), lab("Бренд: ", "brand"), lab("Тип товара: ", "name"), lab("Диаметр DN ", _dn), lab("Давление PN ", _pn, " бар"), lab("Соединение: ", "connection"), lab("Рабочая среда: ", "medium"), lab("Управление: ", "control"), lab("Температура: ", "temperature"), lab("Длина: ", g("length_mm"), " мм"), lab("Артикул: ", "article")],
    "chr(10)",
)
LDS = ", ".join(canon(f"l_{f}", "k, ld_article_norm", f) for f in _LD) + f""",
lk AS (SELECT DISTINCT k, ld_article_norm FROM src WHERE ld_article_norm <> ''),
lds AS (SELECT lk.*, {', '.join(f'l_{f}.{f}' for f in _LD)} FROM lk {' '.join(f'LEFT JOIN l_{f} ON lk.k = l_{f}.k AND lk.ld_article_norm = l_{f}.ld_article_norm' for f in _LD)})"""


def bm25(docs: str, doc_id: str, doc_text: str, queries: str, query_text: str, k: int = 300, name: str = "bm") -> str:
    """CTEs that end in {name}(query_id, doc_id, score, rank)."""
    return f"""
{name}_t AS (SELECT {doc_id} AS doc_id, {TOKENS.format(norm(doc_text))} AS toks FROM {docs}),
{name}_l AS (SELECT doc_id, coalesce(len(toks), 0) AS dl FROM {name}_t),
{name}_s AS (SELECT count(*)::DOUBLE AS n, avg(dl)::DOUBLE AS avgdl FROM {name}_l),
{name}_f AS (SELECT doc_id, term, count(*)::DOUBLE AS tf FROM (SELECT doc_id, unnest(toks) AS term FROM {name}_t) GROUP BY 1, 2),
{name}_d AS (SELECT term, count(*)::DOUBLE AS df FROM {name}_f GROUP BY 1),
{name}_q AS (SELECT DISTINCT query_id, unnest({TOKENS.format(norm(query_text))}) AS term FROM {queries}),
{name}_x AS (SELECT q.query_id, f.doc_id, round(sum(ln(1 + (s.n - d.df + 0.5::DOUBLE) / (d.df + 0.5::DOUBLE)) * f.tf * 2.2::DOUBLE / (f.tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * l.dl / s.avgdl))), 6) AS score
  FROM {name}_q q JOIN {name}_f f USING (term) JOIN {name}_d d USING (term) JOIN {name}_l l USING (doc_id) CROSS JOIN {name}_s s GROUP BY 1, 2),
{name} AS (SELECT * FROM (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::INTEGER AS rank FROM {name}_x) WHERE rank <= {k})"""


LETTERS = "abcdefghijklmnopqrstuvwxyz0123456789"


def letters(text: str) -> str:
    """How often a text has each letter and digit: an encoder that SQL can say."""
    return f"list_transform(string_split('{LETTERS}', ''), lambda c: (length(lower({text})) - length(replace(lower({text}), c, '')))::DOUBLE)"


def dense(vectors: str, queries: str, k: int, name: str = "dn") -> str:
    """vectors(doc_id, v), queries(query_id, qv). A zero vector scores 0."""
    return f"""
{name}_x AS (SELECT query_id, doc_id, CASE WHEN list_max(list_transform(v, lambda x: abs(x))) > 0 AND list_max(list_transform(qv, lambda x: abs(x))) > 0 THEN round(list_inner_product(v::DOUBLE[], qv::DOUBLE[]) / (sqrt(list_inner_product(v::DOUBLE[], v::DOUBLE[])) * sqrt(list_inner_product(qv::DOUBLE[], qv::DOUBLE[]))), 6) ELSE 0.0::DOUBLE END AS score FROM {vectors}, {queries}),
{name} AS (SELECT * FROM (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::INTEGER AS rank FROM {name}_x) WHERE rank <= {k})"""


def rrf(rankings: list[str], k: int = 300, name: str = "rf") -> str:
    both = " UNION ALL ".join(f"SELECT query_id, doc_id, 1.0::DOUBLE / (60 + rank) AS part FROM {r}" for r in rankings)
    return f"""
{name}_x AS (SELECT query_id, doc_id, round(sum(part), 9) AS score FROM ({both}) GROUP BY 1, 2),
{name} AS (SELECT * FROM (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::INTEGER AS rank FROM {name}_x) WHERE rank <= {k})"""


QUERIES = (
    "hot gear DN 25 PN16",
    "ECONOMY.Brand#2-11 flanged",
    "Temper welded gas manual dn10 pn 22",
    "  small   ring STEAM electric DN 11,5 ",
    "economybrand#211",
    "threaded oil valve PN 28 PROMO.Brand#17-28",
    "coupling water pneumatic Broen 1184399",
    "",
)


def _trait(dim: str) -> str:
    return f"list_filter(list_transform(words, lambda w: {alias('w', dim, 'NULL')}), lambda v: v IS NOT NULL)[1]"


#: A query for each part, in SQL that Spark and DuckDB understand: words of one of the queries above, then the part's own.
ASKED = f"""
SELECT p_partkey AS query_id, concat(CASE p_partkey % {len(QUERIES)} {' '.join(f"WHEN {i} THEN '{q}'" for i, q in enumerate(QUERIES))} END,
  ' ', p_name, CASE p_partkey % 3 WHEN 0 THEN ' PN16' WHEN 1 THEN ' pn 22,5' ELSE '' END, CASE p_partkey % 2 WHEN 0 THEN ' Dn ' ELSE '  DN' END, cast(p_size AS string),
  CASE p_partkey % 5 WHEN 0 THEN concat(' ', p_type, '.', p_brand, '-', cast(p_size AS string)) WHEN 1 THEN lower(p_brand) ELSE '' END) AS query
FROM part
"""


def parsed(queries: tuple[str, ...] = QUERIES, *, table: str | None = None) -> str:
    """CTEs that end in q: the parsed queries of a list, or of a table (query_id, raw)."""
    rows = table or "(VALUES " + ", ".join(f"({i}, '{q}')" for i, q in enumerate(queries)) + ")"
    dn, p = g("dn"), g("pn_bar")
    lexical = f"list_filter(list_concat([normalized], toks, [brand, {lab('dn', dn)}, {lab('dn ', dn)}, {lab('ду', dn)}, {lab('ду ', dn)}, {lab('pn', p)}, {lab('pn ', p)}, {lab('ру', p)}, {lab('ру ', p)}, {lab('', p, ' бар')}, connection, medium, control]), lambda x: x IS NOT NULL AND x <> '')"
    tail = f"list_filter([{lab('DN ', dn)}, {lab('PN ', p)}, {lab('Соединение: ', 'connection')}, {lab('Среда: ', 'medium')}, {lab('Управление: ', 'control')}], lambda x: x IS NOT NULL)"
    return rf"""
q0 AS (SELECT query_id::BIGINT AS query_id, raw, coalesce({norm('raw')}, '') AS normalized FROM {rows} AS v(query_id, raw)),
q1 AS (SELECT *, list_filter(string_split(normalized, ' '), lambda w: w <> '' AND NOT regexp_matches(w, '[\d./_-]')) AS words,
  flatten(list_transform(list_filter(regexp_split_to_array(raw, '\s+'), lambda w: w <> '' AND (regexp_matches(w, '[./_-]') OR (length(w) >= 5 AND regexp_matches(w, '\d')))), lambda w: [w, lower(w), regexp_replace(lower(w), '[\s./\\_-]+', '', 'g')])) AS t0,
  TRY_CAST(nullif(replace(regexp_extract(normalized, '(?i)\b(?:dn)\s*([0-9]+(?:[.,][0-9]+)?)', 1), ',', '.'), '') AS DOUBLE) AS dn,
  TRY_CAST(nullif(replace(regexp_extract(normalized, '(?i)\b(?:pn|ru|mpa)\s*([0-9]+(?:[.,][0-9]+)?)', 1), ',', '.'), '') AS DOUBLE) AS pn_bar FROM q0),
q2 AS (SELECT *, {distinct_list('t0')} AS toks, {', '.join(f'{_trait(d)} AS {d}' for d in ALIASES)} FROM q1),
q3 AS (SELECT *, {lexical} AS ll, {tail} AS tail, coalesce(nullif(concat_ws(' ', upper(brand[1]) || brand[2:], toks[1]), ''), nullif(trim(raw), ''), normalized) AS main FROM q2),
q AS (SELECT * EXCLUDE (ll, tail, main), replace(normalized, ' ', '') AS compact, array_to_string(list_filter(ll, lambda x, i: list_position(ll, x) = i), ' ') AS lexical_text,
  array_to_string(list_concat([main], tail), ', ') AS semantic_text FROM q3)"""


def _mean(checks: list[tuple[str, str]]) -> str:
    total = " + ".join(f"(CASE WHEN {a} IS NOT NULL THEN {s} ELSE 0.0::DOUBLE END)" for a, s in checks)
    n = " + ".join(f"(CASE WHEN {a} IS NOT NULL THEN 1 ELSE 0 END)" for a, _ in checks)
    return f"(CASE WHEN {n} > 0 THEN ({total}) / ({n}) END)"


def _eq(a: str, b: str) -> str:
    return f"(CASE WHEN {a} = {b} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)"


def _similar(a: str, b: str) -> str:
    A, B = (f"coalesce({bare(x)}, replace({x}, ' ', ''))" for x in (a, b))
    steps = "".join(f" WHEN starts_with({x}, {y}) OR starts_with({y}, {x}) THEN 0.85::DOUBLE WHEN contains({x}, {y}) OR contains({y}, {x}) THEN 0.75::DOUBLE" for x, y in ((A, B), (a, b)))
    return f"CASE WHEN {A} = {B} OR {a} = {b} THEN 1.0::DOUBLE{steps} ELSE 0.0::DOUBLE END"


# hits: the candidates of the inline queries in the catalogue, with the parsed query (q_...) and the document.
def hits(ranking: str) -> str:
    return f"""
hits AS (SELECT r.query_id, r.doc_id, r.score AS raw_score, lex.*, {', '.join(f'q.{c} AS q_{c}' for c in ('normalized', 'compact', 'toks', 'brand', *FIELDS))}
  FROM {ranking} r JOIN lex ON r.doc_id = lex.steel_id JOIN q ON r.query_id = q.query_id)"""


_LEXICAL = f"{CAT}, {DOCS}, {parsed()}, {bm25('lex', 'steel_id', 'lexical_text', 'q', 'lexical_text')}"
HITS = f"{_LEXICAL}, {hits('bm')}"
# the same with both retrievers, fused
FUSED_HITS = f"""{_LEXICAL},
vv AS (SELECT steel_id AS doc_id, {letters('st')} AS v FROM (SELECT steel_id, {SEMANTIC} AS st FROM docs)),
vq AS (SELECT query_id, {letters('semantic_text')} AS qv FROM q), {dense('vv', 'vq', 300)}, {rrf(['bm', 'dn'])}, {hits('rf')}"""
EXACT = f"""
ex AS (SELECT query_id, doc_id, max({_similar('a', 'b')}) AS text_exactness FROM (
  SELECT query_id, doc_id, a, unnest(s) AS b FROM (
    SELECT query_id, doc_id, unnest(list_filter(list_transform(list_concat([q_normalized, q_compact, q_brand], q_toks), lambda x: {norm('x')}), lambda x: x IS NOT NULL)) AS a,
      list_filter(list_transform([article, article_norm, article_compact, name, brand], lambda x: {norm('x')}), lambda x: x IS NOT NULL) AS s FROM hits)) GROUP BY 1, 2)"""
_w = lambda v, w: (f"coalesce({v} * {w}::DOUBLE, 0.0::DOUBLE)", f"(CASE WHEN {v} IS NULL THEN 0.0::DOUBLE ELSE {w}::DOUBLE END)")
_ws = [_w("hybrid_score", "0.55"), _w("text_exactness", "0.25"), _w("source_field_score", "0.20")]
SOURCES = f"""{EXACT},
sc AS (SELECT hits.*, ex.text_exactness,
  CASE WHEN max(raw_score) OVER (PARTITION BY hits.query_id) <= 0 THEN 0.0::DOUBLE ELSE least(1.0::DOUBLE, greatest(0.0::DOUBLE, raw_score / max(raw_score) OVER (PARTITION BY hits.query_id))) END AS hybrid_score,
  {_mean([(f'q_{f}', _eq(f'q_{f}', alias(norm('brand'), 'brand') if f == 'brand' else f)) for f in ('brand', *FIELDS)])} AS source_field_score
  FROM hits LEFT JOIN ex ON hits.query_id = ex.query_id AND hits.doc_id = ex.doc_id),
ss AS (SELECT *, round(({' + '.join(a for a, _ in _ws)}) / ({' + '.join(b for _, b in _ws)}), 9) AS source_score FROM sc),
sources AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY source_score DESC, hybrid_score DESC, coalesce(text_exactness, 0) DESC, doc_id)::INTEGER AS source_rank FROM ss)"""
_ldpn = "(CASE WHEN l.ld_pn_bar = s.q_pn_bar THEN 1.0::DOUBLE WHEN l.ld_pn_bar > s.q_pn_bar THEN 0.85::DOUBLE ELSE 0.0::DOUBLE END)"
CANDS = f"""{LDS},
cand0 AS (SELECT s.*, l.* EXCLUDE (k), l.ld_article_norm AS ld_key, {_mean([(f's.q_{f}', _ldpn if f == 'pn_bar' else _eq(f's.q_{f}', f'l.ld_{f}')) for f in FIELDS])} AS ld_field_score
  FROM sources s JOIN lds l ON s.k = l.k),
cand AS (SELECT *, round(CASE WHEN ld_field_score IS NULL THEN source_score ELSE source_score * 0.70::DOUBLE + ld_field_score * 0.30::DOUBLE END, 9) AS final_score FROM cand0),
best AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY final_score DESC, source_score DESC, ld_key)::INTEGER AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id, ld_key ORDER BY final_score DESC, source_rank) AS r FROM cand) WHERE r = 1)"""
EVIDENCE = """
ev AS (SELECT *, row_number() OVER (PARTITION BY query_id, ld_key ORDER BY source_rank) AS place FROM (
  SELECT query_id, ld_key, source_rank, article, source_score, row_number() OVER (PARTITION BY query_id, ld_key, article ORDER BY source_score DESC, source_rank) AS r FROM cand) WHERE r = 1)"""


def messages() -> tuple[str, str]:
    reasons, wrong = [], []
    for f, label in (("dn", "DN"), ("pn_bar", "PN")):
        q, v = f"q_{f}", f"ld_{f}"
        above = f"WHEN {v} > {q} THEN '{label} ' || {g(v)} || ' выше запрошенного ' || {g(q)}" if f == "pn_bar" else ""
        reasons.append(f"CASE WHEN {v} = {q} THEN 'Совпадает {label} ' || {g(q)} {above} END")
        wrong.append(f"CASE WHEN {q} IS NULL THEN NULL WHEN {v} IS NULL THEN '{label}: ожидался ' || {g(q)} || ', но поле не указано' WHEN {v} {'<' if above else '<>'} {q} THEN '{label}: ожидался ' || {g(q)} || ', найден ' || {g(v)} END")
    for f, label, start, word, none in (("connection", "присоединение", "Присоединение: ожидалось ", "найден", "не указано"), ("medium", "среда", "Среда: ожидалась ", "найден", "не указана"), ("control", "управление", "Управление: ожидалось ", "найдено", "не указано")):
        q, v = f"q_{f}", f"ld_{f}"
        reasons.append(f"CASE WHEN {v} = {q} THEN 'Совпадает {label} ' || {q} END")
        wrong.append(f"CASE WHEN {q} IS NOT NULL AND {v} IS DISTINCT FROM {q} THEN '{start}' || {q} || ', {word} ' || coalesce({v}, '{none}') END")
    join = lambda xs: f"array_to_string(list_filter([{', '.join(xs)}], lambda x: x IS NOT NULL), '; ')"
    only = f"CASE WHEN ld_field_score IS NULL AND {join(reasons)} = '' THEN 'LD-кандидат ' || {norm('ld_article')} ELSE {join(reasons)} END"
    return only, join(wrong)


def source_messages() -> tuple[str, str]:
    reasons = [
        f"CASE WHEN text_exactness >= 1.0 THEN 'Найден товар с артикулом ' || {norm('article')} WHEN text_exactness >= 0.85 THEN 'Есть сильное текстовое совпадение с артикулом ' || {norm('article')} WHEN text_exactness >= 0.75 THEN 'Есть текстовое совпадение с наименованием ' || {norm('name')} END",
        "CASE WHEN brand = q_brand THEN 'Совпадает бренд ' || q_brand END",
    ]
    wrong = ["CASE WHEN q_brand IS NOT NULL AND brand IS DISTINCT FROM q_brand THEN 'Бренд: ожидался ' || q_brand || ', найден ' || coalesce(brand, 'не указан') END"]
    for f, label in (("dn", "DN"), ("pn_bar", "PN")):
        q = f"q_{f}"
        reasons.append(f"CASE WHEN {f} = {q} THEN 'Совпадает {label} ' || {g(q)} END")
        wrong.append(f"CASE WHEN {q} IS NULL THEN NULL WHEN {f} IS NULL THEN '{label}: ожидался ' || {g(q)} || ', но поле не указано' WHEN {f} <> {q} THEN '{label}: ожидался ' || {g(q)} || ', найден ' || {g(f)} END")
    for f, label, start, word, none in (("connection", "присоединение", "Присоединение: ожидалось ", "найден", "не указано"), ("medium", "среда", "Среда: ожидалась ", "найден", "не указана"), ("control", "управление", "Управление: ожидалось ", "найдено", "не указано")):
        q = f"q_{f}"
        reasons.append(f"CASE WHEN {f} = {q} THEN 'Совпадает {label} ' || {q} END")
        wrong.append(f"CASE WHEN {q} IS NOT NULL AND {f} IS DISTINCT FROM {q} THEN '{start}' || {q} || ', {word} ' || coalesce({f}, '{none}') END")
    join = lambda xs: f"array_to_string(list_filter([{', '.join(xs)}], lambda x: x IS NOT NULL), '; ')"
    return join(reasons), f"CASE WHEN source_field_score < 1.0 AND {join(wrong)} = '' THEN 'Часть структурных полей не совпадает' ELSE {join(wrong)} END"


#: The first microsecond of the events' month.
MONTH = 1_704_067_200_000_000
EVENTS = f"""e AS (SELECT event_id, user_id AS who, epoch_us(ts) AS t, event_type, value FROM events),
o0 AS (SELECT *, {MONTH} + (o_orderkey * 7919 % 2592000) * 1000000 AS t FROM orders),
o AS (SELECT o_orderkey, o_custkey % 150 AS who, t, t + (1 + o_orderkey % 9) * 40 * 60000000 AS until, o_totalprice FROM o0)"""
