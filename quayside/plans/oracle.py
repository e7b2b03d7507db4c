"""DuckDB SQL for the queries of plans.queries, written apart from the operators; only tables of fixed values are shared."""

from __future__ import annotations

from quayside.functions import normalize as N
from quayside.operators import classify, compare, extract, resolve
from quayside.plans.queries import KINDS, REQUIRED_FIELDS, SECTIONS
from quayside.sources import synthetic

NUM = r"-?[0-9][0-9,]*(?:\.[0-9]+)?"


def text(v: str) -> str:
    return "'" + v.replace("'", "''") + "'"


def values(rows: list[tuple], names: str) -> str:
    return f"(VALUES {', '.join('(' + ', '.join(text(x) if isinstance(x, str) else str(x) for x in r) + ')' for r in rows)}) AS {names}"


def number(v: str) -> str:
    return f"try_cast(replace(regexp_extract({v}, '{NUM}'), ',', '') AS DECIMAL(38,10))"


def shown(x: str) -> str:
    return f"rtrim(rtrim(format('{{:,.6f}}', CAST({x} AS DOUBLE)), '0'), '.')"


def repaired(v: str) -> str:
    near = "(regexp_matches(right(acc, 1), '^[0-9]$') OR regexp_matches(substr(x, 2, 1), '^[0-9]$'))"
    step = f"acc || CASE WHEN {near} AND left(x, 1) = 'O' THEN '0' WHEN {near} AND left(x, 1) IN ('I', 'L') THEN '1' ELSE left(x, 1) END"
    return f"list_reduce(list_prepend('', list_transform(range(1, length({v}) + 1), lambda i: substr({v}, i, 2))), lambda acc, x: {step})"


UNITS = "CASE {u} " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in N.PACKAGE_UNITS.items()) + " ELSE {u} END"
TONS, KILOS = "('MT', 'MTS', 'TON', 'TONS')", "('MT', 'MTS', 'TON', 'TONS', 'KG', 'KGS', 'KGM')"
IDS, SHIPS, MONEYS = (f"({', '.join(text(x) for x in names)})" for names in (N.ID_FIELDS, N.SHIP_FIELDS, N.MONEY_FIELDS))
CODES = "|".join(N.CURRENCIES)
CURRENCY = f"replace(CASE WHEN regexp_extract(upper(value), '(?:^|[^A-Z0-9_])({CODES})(?:$|[^A-Z0-9_])', 1) <> '' THEN regexp_extract(upper(value), '(?:^|[^A-Z0-9_])({CODES})(?:$|[^A-Z0-9_])', 1) ELSE regexp_extract(upper(trim(value)), '^({CODES})[0-9]', 1) END, 'RMB', 'CNY')"

FIELDS = f"""{synthetic.SQL},
lines AS (SELECT case_id, seg, doc_type, ord, trim(x) AS raw FROM (SELECT case_id, seg, doc_type, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS ord FROM papers) WHERE trim(x) <> ''),
aliases AS (SELECT * FROM {values([(i, c, a, extract.plain_words(a)) for i, (c, a) in enumerate((c, a) for c, names in extract.ALIASES for a in names)], 't(o, canonical, alias, words)')}),
labels AS (SELECT DISTINCT split_part(raw, ':', 1) AS label, lower(trim(regexp_replace(split_part(raw, ':', 1), '[^0-9a-zA-Z\\x{{4e00}}-\\x{{9fff}}]+', ' ', 'g'))) AS words FROM lines WHERE instr(raw, ':') > 1),
named AS (SELECT label, a.canonical FROM labels l JOIN aliases a ON contains(l.words, a.words)
  QUALIFY row_number() OVER (PARTITION BY label ORDER BY (l.words = a.words) DESC, length(a.words) DESC, o) = 1),
inside AS (SELECT case_id, seg, doc_type, ord, raw, canonical, alias, trim(left(raw, instr(lower(raw), alias) - 1) || substr(raw, instr(lower(raw), alias) + length(alias)), ' :-：') AS value
  FROM lines JOIN aliases ON contains(lower(raw), alias) WHERE instr(raw, ':') = 0 AND trim(left(raw, instr(lower(raw), alias) - 1) || substr(raw, instr(lower(raw), alias) + length(alias)), ' :-：') <> ''
  QUALIFY row_number() OVER (PARTITION BY case_id, seg, ord ORDER BY o) = 1),
found AS (
  SELECT case_id, seg, doc_type, ord, canonical, trim(substr(raw, instr(raw, ':') + 1)) AS value, 0.78 AS confidence FROM lines JOIN named ON split_part(raw, ':', 1) = label AND instr(raw, ':') > 1
  UNION ALL SELECT case_id, seg, doc_type, ord, canonical, value, 0.62 FROM inside),
left_over AS (SELECT * FROM lines ANTI JOIN found USING (case_id, seg, ord)),
fields AS (
  SELECT case_id, seg, doc_type, ord, canonical, value, CAST(confidence AS DECIMAL(9,2)) AS confidence FROM found
  UNION ALL SELECT case_id, seg, doc_type, ord, x.c, trim(x.v), 0.72 FROM (SELECT *, CASE {' '.join(f"WHEN regexp_extract(raw, {text(p)}, 1, 'i') <> '' THEN {{'c': '{c}', 'v': regexp_extract(raw, {text(p)}, 1, 'i')}}" for c, p in extract.IDENTIFIERS)} END AS x FROM left_over) WHERE x IS NOT NULL),
firsts AS (SELECT case_id, seg, doc_type, canonical, arg_min(value, ord) AS value FROM fields WHERE value <> '' GROUP BY ALL)"""

NORMAL = f"""{FIELDS},
parts AS (SELECT *, {number('value')} AS num, upper(value) AS up, regexp_extract(upper(value), '{NUM}\\s*([A-Z]{{2,10}})?', 1) AS u10, coalesce(nullif(regexp_extract(upper(value), '{NUM}\\s*([A-Z]{{2,5}})?', 1), ''), 'KGS') AS u5 FROM firsts),
norm AS (SELECT case_id, seg, doc_type, canonical, value,
  CASE WHEN canonical IN ('package_count', 'quantity') OR canonical = 'exchange_rate' OR canonical IN {MONEYS} THEN num WHEN canonical IN ('net_weight', 'gross_weight') THEN CASE WHEN u5 IN {TONS} THEN num * 1000 ELSE num END END AS n,
  CASE WHEN canonical IN ('package_count', 'quantity') AND num IS NOT NULL THEN {UNITS.format(u='u10')} WHEN canonical IN ('net_weight', 'gross_weight') AND num IS NOT NULL THEN CASE WHEN u5 IN {KILOS} THEN 'KGS' ELSE u5 END ELSE '' END AS u,
  CASE WHEN canonical IN ('package_count', 'quantity') AND num IS NOT NULL THEN trim({shown('num')} || ' ' || {UNITS.format(u='u10')})
       WHEN canonical IN ('net_weight', 'gross_weight') AND num IS NOT NULL THEN {shown(f'CASE WHEN u5 IN {TONS} THEN num * 1000 ELSE num END')} || ' ' || CASE WHEN u5 IN {KILOS} THEN 'KGS' ELSE u5 END
       WHEN canonical IN {MONEYS} AND num IS NOT NULL THEN trim({CURRENCY} || ' ' || {shown('num')})
       WHEN canonical = 'exchange_rate' THEN {shown('num')}
       WHEN canonical IN {IDS} THEN {repaired("regexp_replace(up, '[^A-Z0-9]', '', 'g')")}
       WHEN canonical = 'hs_code' THEN regexp_replace(value, '[^0-9]', '', 'g')
       WHEN canonical IN {SHIPS} THEN regexp_replace(up, '[^A-Z0-9]', '', 'g')
       ELSE lower(trim(regexp_replace(value, '\\s+', ' ', 'g'))) END AS v
  FROM parts)"""


def compared(hub: str, fields: tuple[str, ...], targets: str, same: str) -> str:
    return f"""
asked AS (SELECT * FROM (SELECT DISTINCT case_id FROM norm WHERE canonical IN ({', '.join(text(f) for f in fields)})), (SELECT unnest([{', '.join(text(f) for f in fields)}]) AS field)),
hub AS (SELECT case_id, canonical, value, n, u, v FROM norm WHERE doc_type = '{hub}'),
others AS (SELECT case_id, canonical, n, u, v FROM norm WHERE {targets}),
results AS (SELECT a.case_id, a.field, CASE WHEN any_value(h.v) IS NULL OR count(o.v) = 0 THEN 'MISSING' WHEN count_if(NOT ({same})) > 0 THEN 'MISMATCH' ELSE 'MATCH' END AS status,
    any_value(h.value) AS hub_value, count(o.v) AS n_papers, CASE WHEN any_value(h.v) IS NULL THEN 0 ELSE coalesce(CAST(count_if(NOT ({same})) AS BIGINT), 0) END AS n_differ
  FROM asked a LEFT JOIN hub h ON h.case_id = a.case_id AND h.canonical = a.field LEFT JOIN others o ON o.case_id = a.case_id AND o.canonical = a.field GROUP BY a.case_id, a.field)"""


SAME = f"CASE WHEN h.n IS NOT NULL AND o.n IS NOT NULL THEN h.n = o.n AND (h.u = o.u OR a.field = 'exchange_rate' OR a.field IN {MONEYS}) ELSE h.v = o.v END"
RESULTS = NORMAL + "," + compared("declaration", compare.CHECK_FIELDS, "doc_type <> 'declaration'", SAME)
RISKY, OPTIONAL = (f"({', '.join(text(x) for x in names)})" for names in (compare.HIGH_RISK, compare.OPTIONAL))
STATUS = f"""CASE WHEN bool_or(field IN {RISKY} AND status = 'MISMATCH') THEN 'HIGH_RISK' WHEN bool_or(status = 'MISMATCH') THEN 'MISMATCH' WHEN bool_or(status = 'MISSING' AND field NOT IN {OPTIONAL}) THEN 'MISSING' ELSE 'MATCH' END"""

HEAD = "lower(trim(regexp_replace(array_to_string(list_slice(string_split(text, chr(10)), 1, {n}), chr(10)), '\\s+', ' ', 'g')))"
SCORES = f"""{synthetic.SQL},
terms AS (SELECT * FROM {values([(i, t, x) for i, (t, names) in enumerate(classify.TERMS) for x in names], 't(o, candidate, term)')}),
heads AS (SELECT case_id, seg, doc_type, {HEAD.format(n=1)} AS h1, {HEAD.format(n=8)} AS h8, {HEAD.format(n=100000)} AS h FROM papers),
scores AS (SELECT case_id, seg, doc_type, o, candidate, CAST(sum(CASE WHEN contains(h1, term) THEN 100 WHEN contains(h8, term) THEN 45 ELSE 15 END) / 100.0 AS DECIMAL(9,2)) AS score FROM heads JOIN terms ON contains(h, term) GROUP BY ALL)"""


def correction(prefix: str) -> str:
    """A column for each type that takes part; the scores are read once."""
    names = list(dict.fromkeys(x for c in classify.CORRECTIONS for x in (c[0], c[2])))
    sql = f""",\nc AS MATERIALIZED (SELECT case_id, seg, candidate, score, {', '.join(f"max(score) FILTER (WHERE candidate = '{n}') OVER (PARTITION BY case_id, seg) AS {n}" for n in names)} FROM {prefix})"""
    last = "c"
    for i, (a, least, b, by) in enumerate(classify.CORRECTIONS):
        sql += f",\nc{i} AS (SELECT * REPLACE (CASE WHEN {a} >= {least} THEN CAST(greatest(0, least(9.99, {b} + ({by}))) AS DECIMAL(9,2)) ELSE {b} END AS {b}) FROM {last})"
        last = f"c{i}"
    return sql + f" SELECT case_id, seg, candidate, CAST(CASE candidate {' '.join(f'WHEN {chr(39)}{n}{chr(39)} THEN {n}' for n in names)} ELSE score END AS DECIMAL(9,2)) AS score FROM {last}"


KEYS = FIELDS + """,
keys AS (SELECT case_id * 4 + seg AS seg_id, case_id, seg, canonical AS key, regexp_replace(upper(value), '[^A-Z0-9]', '', 'g') AS value FROM firsts WHERE canonical IN ('bl_no', 'invoice_no', 'container_no', 'booking_no'))"""


def variant(a: str) -> str:
    return f"[{a}, replace({a}, 'O', '0'), replace({a}, '0', 'O'), replace(replace({a}, 'I', '1'), 'L', '1'), replace({a}, '1', 'I')]"


def similar(a: str, b: str) -> str:
    return f"CASE WHEN {a} = {b} THEN 1.0 WHEN list_has_any({variant(a)}, {variant(b)}) THEN 0.92 WHEN least(length({a}), length({b})) >= 5 AND (contains({a}, {b}) OR contains({b}, {a})) THEN least(length({a}), length({b})) / greatest(length({a}), length({b})) ELSE 1 - levenshtein({a}, {b}) / greatest(length({a}), length({b}), 1) END"


SURE = f"""{synthetic.SQL},
sure AS (SELECT case_id, seg, doc_type, CAST(CASE WHEN case_id % 5 = 0 AND seg = 1 THEN 0.40 WHEN case_id % 9 = 0 AND seg = 3 THEN 0.31 ELSE 0.90 END AS DECIMAL(9,2)) AS confidence FROM papers WHERE NOT (case_id % 4 = 1 AND seg = 2) AND NOT (case_id % 6 = 2 AND seg = 3)),
needs AS (SELECT unnest([{', '.join(text(x) for x in resolve.REQUIRED['import'])}]) AS doc_type),
gone AS (SELECT c.case_id, n.doc_type FROM (SELECT DISTINCT case_id FROM sure) c, needs n WHERE NOT EXISTS (SELECT 1 FROM sure s WHERE s.case_id = c.case_id AND s.doc_type = n.doc_type AND s.confidence >= CASE WHEN s.doc_type = 'declaration' THEN 0.30 ELSE 0.42 END))"""

WIDE = f"""{FIELDS},
ranked AS (SELECT *, CAST({number('value')} AS DECIMAL(18,6)) AS x, row_number() OVER (PARTITION BY case_id ORDER BY doc_type <> 'declaration', seg, ord) AS place FROM fields),
wide AS (SELECT case_id, {', '.join(f"arg_min(x, place) FILTER (WHERE canonical = '{f}' AND x IS NOT NULL) AS {f}" for f in ('fob', 'cif', 'freight', 'insurance', 'exchange_rate', 'customs_value', 'trade_promotion_fee', 'duty_amount', 'business_tax'))},
  {', '.join(f"arg_min(value, place) FILTER (WHERE canonical = '{f}' AND value <> '') AS {f}" for f in ('hs_code', 'duty_rate', 'import_regulation', 'mp1', 'bsmi', 'commodity_inspection'))} FROM ranked GROUP BY case_id),
based AS (SELECT *, coalesce(customs_value, round(CAST(cif AS DECIMAL(38,6)) * exchange_rate, 0)) AS base FROM wide)"""


def rules_sql(prefix: str, table: str, rules: dict[str, str]) -> str:
    return f"WITH {prefix}\n" + "\nUNION ALL ".join(f"SELECT case_id, '{k}' AS rule, CASE {v} END AS status FROM {table}" for k, v in rules.items())


TAX = {
    "cif_logic": "WHEN cif IS NULL AND fob IS NULL THEN 'MISSING' WHEN cif < fob THEN 'MISMATCH' WHEN fob + cif + freight + insurance IS NULL THEN 'PENDING' WHEN abs(fob + freight + insurance - cif) <= greatest(1, abs(fob + freight + insurance) * 0.005) THEN 'MATCH' ELSE 'MISMATCH'",
    "customs_value": "WHEN customs_value IS NULL THEN 'MISSING' WHEN cif + exchange_rate IS NULL THEN 'PENDING' WHEN abs(round(CAST(cif AS DECIMAL(38,6)) * exchange_rate, 0) - customs_value) <= 3 THEN 'MATCH' ELSE 'MISMATCH'",
    "trade_promotion_fee": "WHEN trade_promotion_fee IS NULL THEN 'MISSING' WHEN base IS NULL THEN 'PENDING' WHEN abs(round(base * 0.0004, 0) - trade_promotion_fee) <= 2 THEN 'MATCH' ELSE 'MISMATCH'",
    "business_tax": "WHEN business_tax IS NULL THEN 'MISSING' WHEN base IS NULL THEN 'PENDING' WHEN abs(round((base + coalesce(duty_amount, 0) + coalesce(trade_promotion_fee, 0)) * 0.05, 0) - business_tax) <= 3 THEN 'MATCH' ELSE 'MISMATCH'",
    "duty_amount": "WHEN duty_amount IS NULL THEN 'MISSING' WHEN base IS NULL THEN 'PENDING' WHEN duty_amount < 0 THEN 'MISMATCH' ELSE 'MATCH'",
}
KNOWN = {
    "hs_code": "WHEN hs_code IS NULL THEN 'MISSING' ELSE 'MATCH'",
    "duty_rate": "WHEN duty_rate IS NOT NULL THEN 'MATCH' WHEN hs_code IS NOT NULL THEN 'PENDING' ELSE 'MISSING'",
    "import_regulation": "WHEN import_regulation IS NOT NULL THEN 'MATCH' WHEN hs_code IS NOT NULL THEN 'PENDING' ELSE 'MISSING'",
    "mp1": "WHEN list_contains(regexp_split_to_array(upper(coalesce(import_regulation, '')), '[^A-Z0-9]+'), 'MP1') AND NOT coalesce(upper(trim(mp1)) NOT IN ('N', 'NO', 'NONE', '-', 'N/A', '無', '免'), false) THEN 'PENDING' WHEN mp1 IS NOT NULL THEN 'MATCH' WHEN hs_code IS NOT NULL OR duty_rate IS NOT NULL OR import_regulation IS NOT NULL THEN 'PENDING' ELSE 'MISSING'",
    "bsmi": "WHEN bsmi IS NOT NULL THEN 'MATCH' ELSE 'PENDING'",
    "commodity_inspection": "WHEN commodity_inspection IS NOT NULL THEN 'MATCH' ELSE 'PENDING'",
}
CONTEXT = f"""{synthetic.SQL},
facts AS (SELECT n, CASE WHEN n % 2 = 0 THEN 'even' ELSE 'odd' END AS region, CASE WHEN a > 200000 THEN 'huge' WHEN a > 100000 THEN 'big' ELSE 'small' END AS size, n % 5 = 0 AS five FROM figures),
met AS (SELECT n AS case_id, 'R1' AS rule_id, 10 AS p, 0 AS o FROM facts WHERE region = 'even' AND size IN ('big', 'huge') UNION ALL SELECT n, 'R2', 20, 1 FROM facts WHERE five UNION ALL SELECT n, 'R3', 5, 2 FROM facts UNION ALL SELECT n, 'R5', 10, 4 FROM facts WHERE region = 'odd' AND five AND size = 'small')"""
LISTS = """before AS (SELECT 'in/' || o_orderkey || '.txt' AS path, o_orderdate AS mtime, o_orderkey % 1000 AS size FROM orders WHERE o_orderkey % 10 <> 7),
after AS (SELECT 'in/' || o_orderkey || '.txt' AS path, o_orderdate AS mtime, o_orderkey % 1000 + CASE WHEN o_orderkey % 9 = 0 THEN 1 ELSE 0 END AS size FROM orders WHERE o_orderkey % 10 <> 3)"""
FEEDBACK = """log AS (SELECT event_id AS id, ts, CASE WHEN event_type IN ('error', 'purchase') THEN event_type WHEN event_type IN ('view', 'click') THEN 'correct' ELSE 'other' END AS error_type, event_type IN ('view', 'click') AS is_correct FROM events)"""
WINDOWS = "SELECT strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H:%M') AS window_start, event_type, count(*) AS n, CAST(round(sum(value), 2) AS DECIMAL(18,2)) AS total FROM events GROUP BY 1, 2"


def normal(canonical: str) -> str:
    return f"WITH {NORMAL} SELECT case_id, seg, v AS value, CAST(round(n, 3) AS DECIMAL(18,3)) AS number, u AS unit FROM norm WHERE canonical = '{canonical}'"


def names(status: str) -> str:
    return f"coalesce(string_agg(field, ',' ORDER BY field) FILTER (WHERE status = '{status}'), '')"


def oracle_sql() -> dict[str, str]:
    section = "CASE " + " ".join(f"WHEN field IN ({', '.join(text(f) for f in fs)}) THEN '{s}'" for s, fs in SECTIONS) + " END"
    wanted = "CASE doc_type " + " ".join(f"WHEN '{k}' THEN [{', '.join(text(x) for x in v)}]" for k, v in REQUIRED_FIELDS.items()) + " END"
    figures = f"WITH {synthetic.SQL} "
    summed = f"{FIELDS}, totals AS (SELECT case_id, canonical, doc_type, CAST(sum({number('value')}) AS DECIMAL(38,2)) AS total FROM fields WHERE canonical IN ('quantity', 'package_count', 'gross_weight', 'amount') GROUP BY ALL)"
    order = "CASE field " + " ".join(f"WHEN '{f}' THEN {i}" for i, f in enumerate(compare.CHECK_FIELDS)) + " END"
    return {
        **{f"norm_{k}": normal(v) for k, v in (("quantity", "quantity"), ("packages", "package_count"), ("weight", "gross_weight"), ("money", "amount"), ("identifier", "bl_no"), ("hs", "hs_code"))},
        "norm_currency": f"WITH {FIELDS} SELECT {CURRENCY} AS currency, count(*) AS n FROM firsts WHERE canonical = 'amount' GROUP BY 1",
        "norm_match_key": f"WITH {FIELDS} SELECT case_id, seg, replace(replace(replace(replace({repaired('x')}, 'VOYAGE', 'VOY'), 'VOY.', 'VOY'), 'V.', 'VOY'), 'VSL', 'VESSEL') AS match_key FROM (SELECT *, regexp_replace(upper(regexp_replace(regexp_replace(regexp_replace(value, '[ \\t]+', ' ', 'g'), '\\s*/\\s*', '/', 'g'), '\\s*-\\s*', '-', 'g')), '[^A-Z0-9/\\-.]', '', 'g') AS x FROM firsts WHERE canonical = 'vessel_voyage')",
        "norm_text": "SELECT p_partkey, lower(trim(regexp_replace('  ' || p_name || ' / ' || p_type, '\\s+', ' ', 'g'))) AS t, upper(regexp_replace(regexp_replace(regexp_replace(p_name || ' - ' || p_type || ' / x', '[ \\t]+', ' ', 'g'), '\\s*/\\s*', '/', 'g'), '\\s*-\\s*', '-', 'g')) AS m FROM part",
        "line_fields": f"WITH {FIELDS} SELECT case_id, seg, ord, canonical, value, confidence FROM fields",
        "label_map": f"WITH {FIELDS} SELECT split_part(raw, ':', 1) AS label, count(*) AS n, any_value(canonical) AS canonical FROM lines LEFT JOIN named ON split_part(raw, ':', 1) = label WHERE contains(raw, ':') GROUP BY 1",
        "first_field": f"WITH {FIELDS} SELECT case_id, seg, canonical, value FROM firsts",
        "classify_terms": f"WITH {SCORES} SELECT case_id, seg, candidate, score FROM scores",
        "classify_best": f"WITH {SCORES}, best AS (SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY case_id, seg ORDER BY score DESC, o) = 1) SELECT doc_type, candidate, count(*) AS n, min(score) AS least FROM best GROUP BY 1, 2",
        "classify_boundary": f"WITH {SCORES}" + correction("scores"),
        "text_structure": f"{figures}SELECT case_id, seg, len(list_filter(l, lambda x: trim(x) <> '')) AS n_lines, len(list_filter(l, lambda x: contains(x, ':'))) AS kv_lines, len(list_filter(l, lambda x: len(regexp_extract_all(x, '[0-9]+')) >= 3)) AS table_lines, length(regexp_replace(text, '[^0-9]', '', 'g')) AS digits, length(text) AS chars, len(regexp_extract_all(text, '(?i)[0-9](?: )?(?:KGS?|MT)')) AS weights, len(regexp_extract_all(text, '[A-Z]{{4}}[0-9]{{7}}')) AS containers FROM (SELECT *, string_split(text, chr(10)) AS l FROM papers)",
        "token_similarity": "WITH a AS (SELECT DISTINCT item_id, unnest(regexp_split_to_array(lower(text), '[^a-z0-9]+')) AS w FROM benchmark), d AS (SELECT DISTINCT doc_id, unnest(regexp_split_to_array(lower(text), '[^a-z0-9]+')) AS w FROM documents), s AS (SELECT item_id, count(*) AS n FROM a WHERE w <> '' GROUP BY 1) SELECT doc_id, item_id, count(*) AS shared, count(*) / any_value(n) AS share FROM d JOIN a USING (w) JOIN s USING (item_id) WHERE w <> '' GROUP BY 1, 2 HAVING count(*) / any_value(n) >= 0.8",
        "segment_islands": "WITH e AS (SELECT user_id, ts, event_id, CASE WHEN event_type IN ('view', 'click') THEN 'look' ELSE 'act' END AS kind FROM events WHERE user_id IS NOT NULL), m AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS place, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - row_number() OVER (PARTITION BY user_id, kind ORDER BY ts, event_id) AS g FROM e), r AS (SELECT user_id, kind, min(place) AS first_at, max(place) AS last_at, count(*) AS n FROM m GROUP BY user_id, kind, g) SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY first_at) - 1 AS island, kind, first_at, last_at, n FROM r",
        "page_texts": f"{figures}SELECT case_id, length(t) AS chars, md5(t) AS digest FROM (SELECT case_id, string_agg(text, chr(10) || chr(10) ORDER BY seg) AS t FROM papers GROUP BY 1)",
        "best_by_confidence": f"WITH {FIELDS} SELECT case_id, canonical, value FROM fields WHERE value <> '' QUALIFY row_number() OVER (PARTITION BY case_id, canonical ORDER BY confidence DESC, seg, ord) = 1",
        "last_key": f"WITH {FIELDS} SELECT case_id, canonical, arg_max(value, seg) AS value FROM firsts GROUP BY 1, 2",
        "ordered_values": "WITH f AS (SELECT l_orderkey, l_returnflag, min(l_linenumber) AS o FROM lineitem GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY o, l_returnflag) AS r FROM f) SELECT l_orderkey, string_agg(l_returnflag, ',' ORDER BY o, l_returnflag) AS flags FROM k WHERE r <= 2 GROUP BY 1",
        "pair_scores": f"""WITH {KEYS}, v AS (SELECT DISTINCT key, value, translate(value, 'OIL', '011') AS f FROM keys WHERE value <> ''),
b AS (SELECT key, value, '=' || f AS block FROM v UNION SELECT key, value, '-' || value FROM v UNION SELECT key, value, '-' || left(value, i - 1) || substr(value, i + 1) FROM (SELECT *, unnest(range(1, length(value) + 1)) AS i FROM v)),
p AS (SELECT DISTINCT x.key, x.value AS a, y.value AS b FROM b x JOIN b y ON x.key = y.key AND x.block = y.block AND x.value < y.value),
s AS (SELECT *, {similar('a', 'b')} AS similarity, CASE key WHEN 'booking_no' THEN 1.0 WHEN 'bl_no' THEN 0.95 ELSE 0.9 END AS w FROM p),
t AS (SELECT *, CASE WHEN similarity >= 1 THEN w WHEN similarity >= 0.88 THEN w * 0.92 ELSE w * 0.72 END AS score FROM s WHERE similarity >= 0.9)
SELECT key, a, b, CAST(similarity AS DECIMAL(9,4)) AS similarity, CAST(score AS DECIMAL(9,4)) AS score, CASE WHEN score >= 0.95 THEN 'exact_match' WHEN score >= 0.8 THEN 'high_confidence' WHEN score >= 0.6 THEN 'partial_match' ELSE 'low_confidence' END AS label FROM t""",
        "anti_mix": f"WITH {KEYS}, p AS (SELECT n * 4 AS a, n * 4 + 1 AS b FROM figures UNION ALL SELECT n * 4, n * 4 + 5 FROM figures) SELECT DISTINCT a, b FROM p JOIN keys x ON x.seg_id = a JOIN keys y ON y.seg_id = b AND x.key = y.key WHERE {similar('x.value', 'y.value')} < 0.72",
        "case_components": f"""WITH RECURSIVE {KEYS}, v AS (SELECT DISTINCT seg_id, key, translate(value, 'OIL', '011') AS value FROM keys), e AS (SELECT DISTINCT x.seg_id AS a, y.seg_id AS b FROM v x JOIN v y ON x.key = y.key AND x.value = y.value),
r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a), c AS (SELECT a, min(b) AS root FROM r GROUP BY 1) SELECT root AS first_paper, count(*) AS n_papers FROM c GROUP BY 1""",
        "case_ids": f"WITH {FIELDS} SELECT case_id, coalesce(CASE WHEN case_id % 3 > 0 THEN coalesce(min(value) FILTER (WHERE canonical = 'booking_no'), min(value) FILTER (WHERE canonical = 'bl_no'), min(value) FILTER (WHERE canonical = 'invoice_no')) END, 'CASE-' || upper(left(sha1(string_agg(DISTINCT doc_type || case_id, '|' ORDER BY doc_type || case_id)), 8))) AS label FROM firsts GROUP BY case_id",
        "missing_documents": f"WITH {SURE} SELECT * FROM gone",
        "fallback_candidates": f"WITH {SURE}, low AS (SELECT case_id, doc_type, max(confidence) AS c FROM sure WHERE doc_type IN (SELECT doc_type FROM needs) AND confidence < CASE WHEN doc_type = 'declaration' THEN 0.30 ELSE 0.42 END GROUP BY 1, 2) SELECT case_id, string_agg(doc_type || ' (' || CAST(floor(c * 100) AS INT) || '%)', ', ' ORDER BY doc_type) AS shown FROM low GROUP BY 1",
        "compare_declaration": f"WITH {RESULTS} SELECT case_id, field, status, n_papers, n_differ FROM results",
        "compare_export": f"WITH {NORMAL.replace('AS u10', 'AS u10').replace('FROM firsts),' + chr(10) + 'norm', 'FROM (SELECT case_id, seg, doc_type, canonical, lower(trim(replace(value, chr(44), chr(32)))) AS v0, lower(trim(replace(value, chr(44), ' + text('') + '))) AS value FROM firsts)),' + chr(10) + 'norm')},{compared('bill_of_lading', ('container_no', 'package_count', 'gross_weight', 'bl_no', 'vessel_voyage'), 'doc_type IN (' + text('packing_list') + ', ' + text('declaration') + ')', 'h.v = o.v')} SELECT case_id, field, status, n_papers, n_differ FROM results",
        "report_status": f"WITH {RESULTS} SELECT case_id, {STATUS} AS status, CAST(count_if(status = 'MATCH') AS BIGINT) AS n_match, CAST(count_if(status = 'MISMATCH') AS BIGINT) AS n_mismatch, CAST(count_if(status = 'MISSING') AS BIGINT) AS n_missing FROM results GROUP BY 1",
        "totals_by_type": f"WITH {summed} SELECT * FROM totals",
        "consensus": f"WITH {summed} SELECT case_id, canonical, count(*) AS n_types, count(DISTINCT total) AS n_totals, CASE WHEN count(DISTINCT total) = 1 THEN 'match' ELSE 'warning' END AS status FROM totals WHERE total IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 2",
        "container_superset": "WITH w AS (SELECT l_orderkey, CAST(l_suppkey AS VARCHAR) AS s, bool_or(l_linenumber % 2 = 1) AS there FROM lineitem GROUP BY 1, 2) SELECT l_orderkey, bool_and(there) AS complete, coalesce(string_agg(s, ',' ORDER BY s) FILTER (WHERE NOT there), '') AS missing FROM w GROUP BY 1",
        "merged_bills": "SELECT l_orderkey, count(DISTINCT l_suppkey) AS bills, count(DISTINCT l_partkey) AS boxes, CAST(sum(l_quantity) AS BIGINT) AS pieces FROM lineitem GROUP BY 1 HAVING bills >= 2 AND boxes >= 2 AND pieces % 2 = 0",
        "rule_matches": f"WITH {CONTEXT} SELECT case_id, rule_id FROM met",
        "rule_order": f"WITH {CONTEXT} SELECT case_id, rule_id, row_number() OVER (PARTITION BY case_id ORDER BY p, o) AS place FROM met",
        "condition_ops": "SELECT p_partkey, v IN ('standard tin', 'promo brass') AS is_in, v NOT IN ('standard tin') AS not_in, v <> '' AS there, contains(v, 'tin') OR contains(v, 'steel') AS holds, v = 'promo brass' AS is_one FROM (SELECT p_partkey, coalesce(lower(trim(regexp_replace(p_type, '\\s+', ' ', 'g'))), '') AS v FROM part)",
        "required_fields": f"WITH {FIELDS}, h AS (SELECT case_id, doc_type, list(DISTINCT canonical) AS have FROM fields WHERE value <> '' GROUP BY 1, 2), l AS (SELECT case_id, doc_type, list_sort(list_filter({wanted}, lambda x: NOT list_contains(have, x))) AS lacks FROM h WHERE doc_type IN ('invoice', 'packing_list', 'declaration')) SELECT case_id, doc_type, array_to_string(lacks, ',') AS missing FROM l WHERE len(lacks) > 0",
        "freight_by_volume": f"{figures}SELECT n AS case_id, CASE WHEN p * 1.5 <= 5 THEN 6000 ELSE 8000 END AS freight FROM figures",
        "insurance_premium": f"{figures}SELECT n AS case_id, CAST(round(greatest(CAST(a AS DECIMAL(18,6)) * 1.1 * 0.0012, 400), 2) AS DECIMAL(18,2)) AS premium FROM figures",
        "declared_vs_expected": f"{figures}, x AS (SELECT n AS case_id, 'freight' AS item, CASE WHEN n % 4 > 0 THEN freight END AS d, floor(a / 20) AS e FROM figures UNION ALL SELECT n, 'insurance', insurance + n % 3, insurance FROM figures UNION ALL SELECT n, 'cif', cif, a + freight + insurance FROM figures) SELECT case_id, item, CAST(d AS DECIMAL(18,2)) AS declared, CAST(e AS DECIMAL(18,2)) AS expected, CASE WHEN d IS NULL THEN 'MISSING' WHEN d = e THEN 'MATCH' ELSE 'MISMATCH' END AS status FROM x",
        "unit_price": f"{figures}SELECT n AS case_id, CAST(CASE WHEN q > 0 THEN floor(CAST(a AS DECIMAL(18,4)) * 100 / q + 0.5) / 100 END AS DECIMAL(18,2)) AS price FROM figures",
        "tax_rules": rules_sql(WIDE, "based", TAX),
        "knowledge_rules": rules_sql(WIDE, "based", KNOWN),
        "case_confidence": f"WITH {SURE} SELECT case_id, CAST(round(avg(confidence), 4) AS DECIMAL(9,4)) AS mean, min(confidence) AS least, coalesce(string_agg(doc_type, ',' ORDER BY seg, doc_type) FILTER (WHERE confidence < 0.65), '') AS low FROM sure GROUP BY 1",
        "workflow_state": f"""WITH {RESULTS}, {SURE.split(synthetic.SQL + ',', 1)[1]},
t AS (SELECT case_id, min(confidence) AS least, bool_or(doc_type = 'bill_of_lading') AS bl, bool_or(doc_type = 'declaration') AS de FROM sure GROUP BY 1), g AS (SELECT case_id, count(*) AS n_missing FROM gone GROUP BY 1), c AS (SELECT case_id, {STATUS} AS rs, count_if(status = 'MISMATCH') AS mm FROM results GROUP BY 1),
s AS (SELECT t.case_id, rs, coalesce(mm, 0) AS mm, coalesce(n_missing, 0) AS nm, CASE WHEN least < 0.65 THEN 'NEEDS_HUMAN_REVIEW' WHEN NOT bl THEN 'WAITING_BL' WHEN NOT de THEN 'WAITING_DECLARATION' WHEN coalesce(n_missing, 0) > 0 THEN 'PARTIAL_DOCUMENTS' WHEN rs IS NULL THEN 'PENDING' WHEN rs = 'MATCH' THEN 'AUDIT_COMPLETED' WHEN rs = 'MISSING' THEN 'READY_FOR_AUDIT' ELSE 'NEEDS_HUMAN_REVIEW' END AS state FROM t LEFT JOIN g USING (case_id) LEFT JOIN c USING (case_id))
SELECT case_id, state, state IN ('READY_FOR_AUDIT', 'AUDIT_COMPLETED') AND nm = 0 AND mm = 0 AND rs <> 'HIGH_RISK' AS can_declare, CASE WHEN rs IN ('HIGH_RISK', 'MISMATCH') THEN 'EXCEPTION' WHEN nm > 0 THEN 'MISSING_DOCUMENTS' ELSE 'COMPLETE' END AS case_status FROM s""",
        "unresolved_keys": f"WITH {KEYS}, k AS (SELECT case_id, list(DISTINCT key) AS have, count(DISTINCT seg) AS n FROM keys GROUP BY 1) SELECT case_id, array_to_string(list_concat(list_filter(['invoice_no', 'bl_no', 'booking_no', 'container_no'], lambda x: NOT list_contains(have, x)), CASE WHEN n = 1 THEN ['cross_document_match'] ELSE [] END), ',') AS unresolved FROM k",
        "section_status": f"WITH {RESULTS} SELECT case_id, {section} AS section, CASE WHEN bool_or(status = 'MISMATCH') THEN 'issue' WHEN bool_or(status = 'MISSING' AND (n_papers > 0 OR hub_value IS NOT NULL)) THEN 'missing' WHEN bool_or(status = 'MATCH') THEN 'done' ELSE 'unchecked' END AS state FROM results WHERE {section} IS NOT NULL GROUP BY 1, 2",
        "pivot_compare": f"WITH {FIELDS} SELECT case_id, canonical AS field, {', '.join(f'max(value) FILTER (WHERE doc_type = {text(k)}) AS {k}' for k in KINDS)} FROM firsts GROUP BY 1, 2",
        "issue_filter": f"WITH {RESULTS} SELECT case_id, field, status FROM results WHERE status <> 'MATCH' AND contains(lower(case_id || ' ' || field || ' ' || status), 'weight')",
        "result_lists": f"WITH {RESULTS} SELECT case_id, {names('MATCH')} AS matched, {names('MISMATCH')} AS differing, {names('MISSING')} AS missing FROM results GROUP BY 1",
        "report_text": f"WITH {RESULTS} SELECT case_id, md5(string_agg(CASE status WHEN 'MATCH' THEN '✓' WHEN 'MISMATCH' THEN '✗' ELSE '⚠' END || ' ' || field || ': ' || coalesce(hub_value, '-') || ' (' || n_papers || ' papers, ' || n_differ || ' differ)', chr(10) ORDER BY {order})) AS digest FROM results GROUP BY 1",
        "feedback_recent": f"WITH {FEEDBACK} SELECT id, error_type, is_correct FROM log ORDER BY ts DESC, id DESC LIMIT 50",
        "feedback_stats": f"WITH {FEEDBACK} SELECT error_type, count(*) AS n, CAST(count_if(is_correct) AS BIGINT) AS n_correct, CAST(count_if(NOT is_correct) AS BIGINT) AS n_issues FROM log GROUP BY 1",
        "backtest_accuracy": "SELECT o_orderpriority AS template, count(*) AS samples, CAST(count_if(o_orderstatus = 'F') AS BIGINT) AS failures, CAST(round(count_if(o_orderstatus <> 'F') * 100.0 / count(*), 1) AS DECIMAL(9,1)) AS accuracy FROM orders GROUP BY 1",
        "top_customer_mode": "WITH c AS (SELECT o_orderpriority, o_custkey, count(*) AS n, min(o_orderkey) AS f FROM orders GROUP BY 1, 2) SELECT o_orderpriority, o_custkey, n FROM c QUALIFY row_number() OVER (PARTITION BY o_orderpriority ORDER BY n DESC, f) = 1",
        "snapshot_diff": f"WITH {LISTS} SELECT path, CASE WHEN b.size IS NULL THEN 'added' WHEN a.size IS NULL THEN 'removed' ELSE 'changed' END AS change FROM before b FULL JOIN after a USING (path) WHERE b.size IS NULL OR a.size IS NULL OR b.size <> a.size OR b.mtime <> a.mtime",
        "newer_files": f"WITH {LISTS}, old AS (SELECT path, CASE WHEN size % 4 = 0 THEN mtime - INTERVAL 1 DAY ELSE mtime END AS t FROM after) SELECT path FROM before LEFT JOIN old USING (path) WHERE t IS NULL OR t < mtime",
        "expired_files": f"WITH {LISTS} SELECT path FROM before WHERE mtime < TIMESTAMP '1998-01-01' - INTERVAL 365 DAY",
        "event_windows": WINDOWS,
        "watch_stream": WINDOWS,
    }
