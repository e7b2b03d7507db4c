"""DuckDB SQL for the queries of plans.more, written apart from the operators; only tables of fixed values are shared."""

from __future__ import annotations

from quayside.functions import normalize as N
from quayside.operators import booking, checks, guards, profiles
from quayside.plans.more import COMPARED, DECLARED, RETITLED, STEMS, TYPES
from quayside.plans.oracle import FIELDS, KEYS, OPTIONAL, RESULTS, RISKY, SURE, WIDE, number, similar, text
from quayside.plans.queries import KINDS
from quayside.sources import synthetic

SURE_ONLY = SURE.removeprefix(synthetic.SQL + ",")
WORDS = "regexp_extract_all(upper({v}), '[A-Z0-9]+')"


def listed(names: tuple[str, ...]) -> str:
    return f"({', '.join(map(text, names))})"


def vessel(v: str) -> str:
    w = WORDS.format(v=v)
    place = f"list_position({w}, list_filter({w}, lambda x: regexp_matches(x, '[0-9]'))[1])"
    return f"array_to_string(list_filter({w}, lambda x, i: i IS DISTINCT FROM {place}), ' ')"


def voyage(v: str) -> str:
    return f"coalesce(list_filter({WORDS.format(v=v)}, lambda x: regexp_matches(x, '[0-9]'))[1], '')"


def hint(stem: str) -> str:
    words = guards.FILE_WORDS.removeprefix("(?i)").replace("[/-]", "[/\\-]")
    left = f"regexp_replace(regexp_replace({stem}, '^[0-9]+[_\\-\\s]*', ''), '{words}', '', 'gi')"
    name = f"regexp_replace({left}, '[^\\x{{4e00}}-\\x{{9fff}}]', '', 'g')"
    return f"CASE WHEN length({name}) >= 2 THEN {name} ELSE '' END"


def stem(n: str) -> str:
    return f"(n % 100) || '_' || CASE {n} {' '.join(f'WHEN {k} THEN {text(v)}' for k, v in STEMS.items())} END"


def both(test: str, *names: str) -> str:
    return "(" + " OR ".join(f"coalesce({test.format(a=f'a.{k}', b=f'b.{k}')}, false)" for k in names) + ")"


def field(patterns: tuple[str, ...]) -> str:
    found = ", ".join(f"nullif(regexp_extract(text, {text('(?im)' + p)}, 1), '')" for p in patterns)
    return f"nullif(trim(coalesce({found}), ' ' || chr(9) || ':-：'), '')"


VERSION = "[p_size % 5, p_partkey % 10, 0, CASE WHEN p_partkey % 3 = 0 THEN 0 ELSE 1 END] || CASE WHEN p_partkey % 3 = 0 THEN [p_size % 4, 1] ELSE [] END"
VALID = f"""v <> '' AND v NOT IN {listed(guards.GENERIC)} AND CASE WHEN canonical IN ('bl_no', 'invoice_no', 'booking_no') THEN length(v) >= 4 AND NOT regexp_full_match(v, '[A-Z]+') WHEN canonical = 'container_no' THEN length(v) >= 8 AND regexp_matches(v, '[0-9]')
  WHEN canonical = 'vessel_voyage' THEN length(v) >= 6 AND v NOT IN {listed(guards.GENERIC_VESSELS)} WHEN canonical = 'amount' THEN regexp_matches(v, '[0-9]') ELSE true END"""
NEAR = f"({similar('{a}', '{b}')}) >= 0.72"
FAR = f"({similar('{a}', '{b}')}) < 0.72"
FOUR = ("bl_no", "invoice_no", "container_no", "booking_no")
BOOKING = f"""{synthetic.SQL},
read_ AS (SELECT case_id, seg, lower(text) AS low, {', '.join(f'{field(p)} AS f_{k}' for k, p in booking.PATTERNS)} FROM papers),
booked AS (SELECT *, {' + '.join(f'CASE WHEN f_{k} IS NULL THEN 0 ELSE 1 END' for k, _ in booking.PATTERNS)} AS n FROM read_ WHERE {' OR '.join(f'contains(low, {text(t)})' for t in booking.TERMS)})"""
SURENESS = "CAST(least(0.55 + least(0.4, n * 0.04), 0.95) AS DECIMAL(9,2))"
WARNED = f"""{RESULTS}, {SURE_ONLY},
have AS (SELECT case_id, list(DISTINCT doc_type) FILTER (WHERE doc_type <> 'declaration') AS h FROM sure GROUP BY 1),
warnings AS (SELECT case_id, 'declaration_only' AS warning FROM have WHERE h IS NULL
  UNION ALL SELECT case_id, 'no_' || t FROM have, (SELECT unnest([{', '.join(map(text, checks.WARNED))}]) AS t) WHERE NOT list_contains(coalesce(h, []), t)
  UNION ALL SELECT case_id, field || ':' || status FROM results WHERE field IN {RISKY} AND status <> 'MATCH' AND NOT (field IN {OPTIONAL} AND status = 'MISSING'))"""
CLEAN = "upper(trim(regexp_replace(value, '\\s+', ' ', 'g')))"
SUMS = listed(checks.SUMS)
UNITS = "(VALUES " + ", ".join(f"({text(a)}, {text(b)})" for a, b in {**N.PACKAGE_UNITS, **{b: b for b in N.PACKAGE_UNITS.values()}}.items()) + ") AS u(a, b)"


NORMAL_TEXT = "trim(regexp_replace(lower(translate({v}, '：﹕／', '::/')), '\\s+', ' ', 'g'))"


def counted(pattern: str) -> str:
    return f"len(regexp_extract_all(normal, {text(pattern)}))"


def with_terms(v: str, terms: tuple[str, ...]) -> str:
    return f"list_filter([{', '.join(map(text, terms))}]::VARCHAR[], lambda x: contains({v}, x))"


def says(v: str, terms: tuple[str, ...], word: bool = False) -> str:
    return f"(len({with_terms(v, terms)}) > 0" + (f" OR regexp_matches({v}, {text(profiles.DELIVERY_WORD)}))" if word else ")")


IDENTITIES = {f"says_{k}": says("normal", v, k == "delivery_order") for k, v in profiles.SAYS.items()} | {f"titled_{k}": says("header", v, k == "delivery_order") for k, v in profiles.TITLED.items()}
GROUPS_SAID = " + ".join(f"CAST({says('normal', v)} AS INT)" for v in profiles.SUPPORT.values())
TERMS_SAID = " + ".join(f"len({with_terms('normal', v)})" for v in profiles.SUPPORT.values())
SHAPES = f"""{synthetic.SQL},
given AS (SELECT case_id, seg, {', '.join(f'{x} AS {k}' for k, x in RETITLED.items())} FROM papers),
normals AS (SELECT case_id, seg, {NORMAL_TEXT.format(v='text')} AS normal, {NORMAL_TEXT.format(v='file')} AS file, list_transform(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> ''), lambda x: {NORMAL_TEXT.format(v='x')}) AS ls FROM given),
shapes AS MATERIALIZED (SELECT case_id, seg, normal, array_to_string(list_slice(ls, 1, {profiles.HEADER_LINES}), ' ') AS header, file, len(ls) AS lines, len(list_filter(ls, lambda x: regexp_matches(x, {text(profiles.KEY_VALUE)}))) AS kv, len(list_filter(ls, lambda x: regexp_matches(x, {text(profiles.ROW)}))) AS tables,
  {counted('[0-9]')} AS digits, length(normal) AS chars, {counted(profiles.MONEY)} AS money, {counted(profiles.WEIGHT)} AS weights, {counted(profiles.BOX)} AS boxes, {counted('[' + profiles.NOISE + ']')} AS noise, list_distinct(regexp_extract_all(normal, {text(profiles.TOKEN)})) AS tokens FROM normals)"""


def profile_sql(at: int) -> str:
    kind, least, groups = profiles.PROFILES[at]
    share = lambda a, b, n: f"{a} * 100 >= greatest({b}, 1) * {n}"
    top = with_terms("header", groups.get("layout", ()))
    own = {g: with_terms("normal", groups.get(g, ())) for g in profiles.GROUPS}
    own["layout"] = f"CASE WHEN len({top}) > 0 THEN {top} ELSE {own['layout']} END"
    own["identifier"] = f"list_filter([{', '.join(f'CASE WHEN regexp_matches(normal, {text(p)}) THEN {text(p)} END' for p in groups.get('identifier', ()))}]::VARCHAR[], lambda x: x IS NOT NULL)"
    parts = [f"least({most}, {each} * len({own[g]}){f' + CASE WHEN len({own[g]}) > 0 AND tables * 100 > greatest(lines, 1) * 18 THEN 50 ELSE 0 END' if g == 'table' else ''})" for g, (each, most) in profiles.GROUPS.items()]
    shape = [f"CASE WHEN {share('kv', 'lines', 16)} THEN 50 ELSE 0 END", f"CASE WHEN {share('tables', 'lines', 18)} THEN 50 ELSE 0 END"]
    shape += ["least(80, 25 * money)"] if kind == "invoice" else ["least(100, 30 * weights)"] if kind == "packing_list" else []
    shape += ["CASE WHEN boxes > 0 THEN 60 ELSE 0 END"] if kind in profiles.BOXED else []
    shape += [f"CASE WHEN {share('digits', 'chars', 12)} THEN 80 ELSE 0 END"] if kind in profiles.NUMBERED else []
    hinted = f"(file <> '' AND {says('file', profiles.FILE_HINTS.get(kind, ()))})"
    parts += [f"least(160, {' + '.join(shape)})", f"CASE WHEN {hinted} THEN 60 ELSE 0 END"]
    if kind == "declaration":
        evidence = f"len(list_distinct({own['fields']} || {own['customs']} || {own['table']} || {own['identifier']}))"
        parts.append(f"CASE WHEN {evidence} >= 4 THEN 120 WHEN {evidence} >= 2 AND {share('digits', 'chars', 10)} THEN 100 WHEN {says('normal', profiles.CORE)} THEN 180 ELSE 0 END")
        parts.append(f"CASE WHEN {GROUPS_SAID} >= 3 THEN 240 WHEN {GROUPS_SAID} >= 2 THEN 200 WHEN {TERMS_SAID} >= 3 AND {share('digits', 'chars', 8)} THEN 100 ELSE 0 END")
    words = profiles.anchors(groups)
    total = f"{' + '.join(parts)} + least(120.0::DOUBLE, len(list_filter([{', '.join(map(text, words))}], lambda x: list_contains(tokens, x))) * 220.0::DOUBLE / {len(words)}) - least(120.0::DOUBLE, noise * 120.0::DOUBLE / greatest(chars, 1))"
    score = f"greatest(0, least(98, CAST(round(CAST(({total}) / 10 AS DECIMAL(12,6)), 0) AS INT)))"
    if kind == "declaration":
        score = f"CASE WHEN {IDENTITIES['says_declaration']} THEN {score} ELSE least({score}, CASE WHEN len({with_terms('normal', profiles.CAP_FIELDS)}) >= 7 THEN 76 ELSE 74 END) END"
    said = " || ".join(f"{x}[:{n}]" for x, n in ((f"({top})", 3), (f"({own['fields']})", 5), (f"({own['customs']})", 4), (f"({own['shipping']})", 4), (f"({own['fingerprint']})", 3))) + f" || CASE WHEN {hinted} THEN ['file name: ' || file] ELSE [] END"
    return f"SELECT case_id, seg, {at} AS ord, '{kind}' AS candidate, {score} AS score, {said} AS said FROM shapes WHERE {score} >= {least}"


PROFILED = f"""{SHAPES},
profiled AS MATERIALIZED ({' UNION ALL '.join(map(profile_sql, range(len(profiles.PROFILES))))})"""


def corrected_sql() -> str:
    names = [t for t, _, _ in profiles.PROFILES]
    weak_bl = "NOT says_bill_of_lading"
    packing = "packing_list IS NOT NULL AND contains(normal, 'packing list')"
    arrival = f"arrival_notice IS NOT NULL AND says_arrival_notice AND bill_of_lading IS NOT NULL AND {weak_bl}"
    delivery = "delivery_order IS NOT NULL AND says_delivery_order AND NOT says_arrival_notice"
    manifest = "manifest IS NOT NULL AND says_manifest AND NOT titled_bill_of_lading"
    steps = {
        "packing_list": [f"CASE WHEN {packing} THEN 14 ELSE 0 END"],
        "declaration": [f"CASE WHEN NOT says_declaration AND {GROUPS_SAID} < 2 THEN CASE WHEN invoice IS NOT NULL THEN -55 ELSE -12 END ELSE 0 END"],
        "arrival_notice": [f"CASE WHEN {arrival} THEN 12 ELSE 0 END"],
        "delivery_order": [f"CASE WHEN {delivery} THEN CASE WHEN titled_delivery_order THEN 28 ELSE 10 END ELSE 0 END"],
        "manifest": [f"CASE WHEN {delivery} THEN CASE WHEN titled_delivery_order THEN -12 ELSE -8 END ELSE 0 END", f"CASE WHEN {manifest} THEN 10 ELSE 0 END"],
        "bill_of_lading": [f"CASE WHEN {packing} AND {weak_bl} THEN -10 ELSE 0 END", f"CASE WHEN {arrival} THEN -8 ELSE 0 END", f"CASE WHEN {delivery} THEN CASE WHEN {weak_bl} THEN -8 WHEN titled_delivery_order THEN -18 ELSE 0 END ELSE 0 END", f"CASE WHEN {manifest} THEN CASE WHEN {weak_bl} THEN -6 ELSE -12 END ELSE 0 END"],
    }

    def final(t: str) -> str:
        out = t
        for x in steps.get(t, []):
            out = f"greatest(0, least(98, {out} + {x}))"
        return f"CASE WHEN {t} IS NOT NULL THEN {out} END"

    each = " UNION ALL ".join(f"SELECT case_id, seg, {i} AS ord, '{t}' AS candidate, {final(t)} AS score FROM held" for i, t in enumerate(names))
    return f"""WITH {PROFILED}, wide AS (SELECT case_id, seg, {', '.join(f"max(score) FILTER (WHERE candidate = '{t}') AS {t}" for t in names)} FROM profiled GROUP BY 1, 2),
held AS MATERIALIZED (SELECT s.*, {', '.join(f'{v} AS {k}' for k, v in IDENTITIES.items())}, wide.* EXCLUDE (case_id, seg) FROM shapes s LEFT JOIN wide USING (case_id, seg) WHERE normal <> ''),
c AS (SELECT * FROM ({each}) WHERE score >= CASE WHEN candidate = 'declaration' THEN 30 ELSE 0 END),
r AS (SELECT case_id, seg, candidate, score, ord FROM c UNION ALL SELECT case_id, seg, 'unknown', {profiles.UNKNOWN}, 99 FROM held WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.case_id = held.case_id AND c.seg = held.seg))
SELECT case_id, seg, candidate, CAST(score / 100.0 AS DECIMAL(4,2)) AS score, score >= {profiles.SURE} AS sure, row_number() OVER (PARTITION BY case_id, seg ORDER BY score DESC, ord) AS place FROM r"""


def oracle_sql() -> dict[str, str]:
    figures = f"WITH {synthetic.SQL} "
    ship = f"WITH {FIELDS}, ship AS (SELECT case_id, value FROM firsts WHERE canonical = 'vessel_voyage')"
    return {
        "vessel_split": f"{ship} SELECT case_id, {vessel('value')} AS vessel, {voyage('value')} AS voyage, regexp_replace(regexp_replace(upper('Vessel ' || value), '\\b(VESSEL|VOYAGE|VOY|VSL)\\b', '', 'g'), '[^A-Z0-9]', '', 'g') AS bare FROM ship",
        "vessel_pending": f"""{ship}, p AS (SELECT case_id, CASE WHEN case_id % 3 = 1 THEN 'EVER' ELSE regexp_replace(value, ' V[.].*', '') END AS a, CASE WHEN case_id % 2 = 1 THEN regexp_replace(value, ' [0-9].*', '') ELSE value END AS b FROM ship)
SELECT case_id, {vessel('a')} <> '' AND {vessel('a')} = {vessel('b')} AND ({voyage('a')} <> '') <> ({voyage('b')} <> '') AS pending FROM p""",
        "version_order": f"SELECT p_partkey, 'v' || (p_size % 5) || '.' || (p_partkey % 10) || CASE WHEN p_partkey % 3 = 0 THEN '-rc' || (p_size % 4) || '.1' ELSE '' END AS version, ({VERSION}) > [2, 5, 0, 0, 2] AS newer FROM part",
        "valid_keys": f"WITH {FIELDS}, k AS (SELECT case_id, seg, canonical, CASE WHEN case_id % 10 = 0 THEN left(regexp_replace(upper(value), '[^A-Z0-9]', '', 'g'), 5) ELSE regexp_replace(upper(value), '[^A-Z0-9]', '', 'g') END AS v FROM firsts WHERE canonical IN ('bl_no', 'invoice_no', 'container_no', 'booking_no', 'vessel_voyage', 'amount', 'customer')) SELECT case_id, seg, canonical AS key, {VALID} AS valid FROM k",
        "source_hints": f"{figures}, s AS (SELECT n, {stem('n % 4')} AS a, {stem('n % 3')} AS b FROM figures), h AS (SELECT *, {hint('a')} AS x, {hint('b')} AS y FROM s) SELECT n AS case_id, x AS hint, a <> b AND x <> '' AND y <> '' AND x <> y AS conflict FROM h",
        "paper_bridges": f"""WITH {KEYS}, m AS (SELECT case_id, seg, {', '.join(f"min(value) FILTER (WHERE key = '{k}') AS {k}" for k in FOUR)} FROM keys GROUP BY 1, 2)
SELECT a.case_id, b.seg, {both(NEAR, *FOUR)} AS bridge, NOT {both('{a} IS NOT NULL AND {b} IS NOT NULL', *FOUR)} AS complementary, {both(FAR, *FOUR)} AS unlike FROM m a JOIN m b ON a.case_id = b.case_id AND a.seg = 2 AND b.seg <> 2""",
        "booking_fields": f"""WITH {BOOKING} SELECT case_id, seg, CASE WHEN contains(low, 'booking confirmation') THEN 'booking_confirmation' WHEN contains(low, 'shipping order') OR contains(low, 's/o') THEN 'shipping_order' ELSE 'booking' END AS doc_type, CAST(n AS BIGINT) AS n_fields,
  array_to_string(list_filter([{', '.join(f"CASE WHEN f_{k} IS NULL THEN '{k}' END" for k in booking.WANTED)}], lambda x: x IS NOT NULL), ',') AS missing, {SURENESS} AS confidence, f_booking_no AS booking_no, f_vessel AS vessel, f_voyage AS voyage, f_container_no AS container_no FROM booked""",
        "parser_choice": f"""WITH {FIELDS}, {BOOKING.removeprefix(synthetic.SQL + ',')}, g AS (SELECT case_id, seg, count(*) AS n FROM fields GROUP BY 1, 2),
r AS (SELECT case_id, seg, 'booking' AS parser, 0 AS o, {SURENESS} AS confidence FROM booked UNION ALL SELECT case_id, seg, 'semantic', 1, CAST(least(0.35 + CASE WHEN case_id % 4 > 0 THEN 0.3 ELSE 0 END + least(0.3, n * 0.03), 0.95) AS DECIMAL(9,2)) FROM g)
SELECT case_id, seg, parser, confidence FROM r QUALIFY row_number() OVER (PARTITION BY case_id, seg ORDER BY confidence DESC, o) = 1""",
        "reconciled_types": f"{figures}, t AS (SELECT n, {', '.join(f'{v} AS {k}' for k, v in TYPES.items())} FROM figures) SELECT n AS case_id, CASE WHEN parsed = detected THEN parsed WHEN parsed = 'unknown' THEN coalesce(candidate, detected) WHEN candidate <> parsed AND n % 7 = 0 THEN candidate ELSE parsed END AS doc_type FROM t",
        "high_risk_warnings": f"WITH {WARNED} SELECT * FROM warnings",
        "warned_status": f"""WITH {WARNED} SELECT case_id, CASE WHEN case_id IN (SELECT case_id FROM warnings) THEN 'HIGH_RISK' WHEN bool_or(status = 'MISMATCH') THEN 'MISMATCH' WHEN bool_or(status = 'MISSING' AND field NOT IN {OPTIONAL}) THEN 'MISSING' ELSE 'MATCH' END AS status FROM results GROUP BY case_id""",
        "formal_compare": f"""WITH {FIELDS}, k AS (SELECT case_id, canonical, doc_type, CAST(sum({number('value')}) AS DECIMAL(38,2)) AS total FROM fields WHERE canonical IN {listed(COMPARED)} AND doc_type <> 'declaration' AND value <> '' GROUP BY ALL),
v AS (SELECT case_id, canonical, count(*) AS n, count(DISTINCT {CLEAN}) AS d FROM fields WHERE canonical IN {listed(COMPARED)} AND doc_type <> 'declaration' AND value <> '' GROUP BY ALL), t AS (SELECT case_id, canonical, count(DISTINCT total) AS d FROM k GROUP BY ALL)
SELECT case_id, canonical AS field, CASE WHEN CASE WHEN canonical IN {SUMS} THEN t.d <= 1 ELSE v.d = 1 END THEN 'MATCH' ELSE 'MISMATCH' END AS status FROM v JOIN t USING (case_id, canonical) WHERE n >= 2""",
        "declaration_totals": f"""WITH {FIELDS}, f AS (SELECT *, doc_type = 'declaration' AS own, {CLEAN} AS v, {number('value')} AS x FROM fields WHERE canonical IN {listed(DECLARED)} AND value <> ''),
t AS (SELECT case_id, canonical, own, doc_type, CAST(sum(x) AS DECIMAL(38,2)) AS total FROM f GROUP BY ALL), s AS (SELECT case_id, canonical, list(DISTINCT total) FILTER (WHERE NOT own) AS totals, max(total) FILTER (WHERE own) AS total FROM t GROUP BY ALL),
v AS (SELECT case_id, canonical, list_sort(list(DISTINCT v) FILTER (WHERE NOT own)) AS papers, list_sort(list(DISTINCT v) FILTER (WHERE own)) AS declared FROM f GROUP BY ALL),
b AS (SELECT *, flatten(list_transform(papers, lambda x: regexp_extract_all(x, '[A-Z]{{4}}[0-9]{{7}}'))) AS pb, flatten(list_transform(declared, lambda x: regexp_extract_all(x, '[A-Z]{{4}}[0-9]{{7}}'))) AS db FROM v JOIN s USING (case_id, canonical) WHERE papers IS NOT NULL AND declared IS NOT NULL),
r AS (SELECT case_id, canonical AS field, CASE WHEN canonical IN {SUMS} THEN CASE WHEN len(totals) = 1 AND total IS NOT NULL THEN totals[1] = total END WHEN len(papers) = 1 THEN declared = papers WHEN canonical = 'container_no' THEN len(pb) > 0 AND list_has_all(db, pb) END AS ok FROM b)
SELECT case_id, field, CASE WHEN ok THEN 'MATCH' ELSE 'MISMATCH' END AS status FROM r WHERE ok IS NOT NULL""",
        "exact_values": f"WITH {WIDE}, am AS (SELECT case_id, arg_min(x, place) AS amount FROM ranked WHERE canonical = 'amount' GROUP BY 1) SELECT case_id, CASE WHEN fob + freight + insurance + cif IS NULL THEN 'MISSING' WHEN fob + freight + insurance = cif THEN 'MATCH' ELSE 'MISMATCH' END AS cif_status, CAST(CAST(coalesce(nullif(cif, 0), amount) AS DECIMAL(38,6)) * exchange_rate AS DECIMAL(38,2)) AS local_amount FROM wide LEFT JOIN am USING (case_id)",
        "weight_check": f"WITH {RESULTS} SELECT case_id, CASE WHEN count_if(field IN ('net_weight', 'gross_weight') AND status = 'MISMATCH') > 0 THEN 'MISMATCH' WHEN count_if(field IN ('net_weight', 'gross_weight') AND status = 'MATCH') > 0 THEN 'MATCH' ELSE 'MISSING' END AS status FROM results GROUP BY 1",
        "found_documents": f"WITH {SURE} SELECT case_id, string_agg(DISTINCT doc_type, ',' ORDER BY doc_type) AS found FROM sure GROUP BY 1",
        "effective_missing": f"WITH {SURE} SELECT case_id, doc_type FROM gone WHERE NOT EXISTS (SELECT 1 FROM sure s WHERE s.case_id = gone.case_id AND s.doc_type = gone.doc_type)",
        "shipment_slots": f"WITH {SURE}, s AS (SELECT case_id // 8 AS shipment, doc_type, case_id * 4 + seg AS place, case_id || '-' || seg AS name, row_number() OVER (PARTITION BY case_id // 8, doc_type ORDER BY case_id, seg) AS r FROM sure) SELECT shipment, {', '.join(f'max(name) FILTER (WHERE r = 1 AND doc_type = {text(k)}) AS {k}' for k in KINDS)}, coalesce(string_agg(name, ',' ORDER BY place) FILTER (WHERE r > 1), '') AS others FROM s GROUP BY 1",
        "values_by_field": f"WITH {FIELDS} SELECT case_id, canonical, md5(string_agg(doc_type || ': ' || value, '; ' ORDER BY seg, ord)) AS digest FROM fields WHERE value <> '' GROUP BY 1, 2",
        "unit_aliases": f"WITH {FIELDS}, w AS (SELECT case_id, unnest(regexp_extract_all(upper(value), '\\b([A-Z]{{2,8}})\\b')) AS w FROM firsts WHERE canonical IN ('package_count', 'quantity')) SELECT case_id, b AS unit, string_agg(DISTINCT w, ' / ' ORDER BY w) AS written FROM w JOIN {UNITS} ON w = a GROUP BY 1, 2 HAVING count(DISTINCT w) > 1",
        "status_labels": f"WITH {RESULTS} SELECT field, CASE status {' '.join(f'WHEN {text(a)} THEN {text(b)}' for a, b in checks.STATUS_LABELS.items())} END AS label, count(*) AS n FROM results GROUP BY 1, 2",
        "fixed_freight": f"{figures} SELECT n AS case_id, CAST(CASE n % 3 WHEN 0 THEN 8000 WHEN 1 THEN 15000 END AS DECIMAL(18,2)) AS freight FROM figures",
        "feedback_fanout": f"SELECT event_id, unnest({FANOUT}) AS error_type FROM events",
        "top_errors": f"SELECT error_type, count(*) AS n FROM (SELECT unnest({FANOUT}) AS error_type FROM events) GROUP BY 1 ORDER BY n DESC, error_type LIMIT 5",
        "shipment_keys": f"WITH {KEYS}, m AS (SELECT case_id, {', '.join(f'arg_min(value, seg) FILTER (WHERE key = {text(k)}) AS {k}' for k in FOUR)} FROM keys WHERE value <> '' GROUP BY 1) SELECT case_id, booking_no, bl_no, invoice_no, container_no, coalesce(booking_no, bl_no, invoice_no, container_no) AS label FROM m",
        "text_shapes": f"WITH {SHAPES} SELECT case_id, seg, md5(header) AS header, lines, kv, tables, digits, chars, money, weights, boxes, noise, len(tokens) AS n_tokens FROM shapes",
        "identity_tests": f"WITH {SHAPES} SELECT case_id, seg, {', '.join(f'{v} AS {k}' for k, v in IDENTITIES.items())} FROM shapes",
        "profile_scores": f"WITH {PROFILED} SELECT case_id, seg, candidate, CAST(score AS BIGINT) AS score, array_to_string(list_filter(said, lambda x, i: list_position(said, x) = i)[:8], ',') AS evidence FROM profiled",
        "profile_candidates": corrected_sql(),
        "group_scores": f"WITH {KEYS}, p AS (SELECT DISTINCT a.case_id, a.key FROM keys a JOIN keys b ON a.case_id = b.case_id AND a.key = b.key AND a.value = b.value AND a.seg < b.seg) SELECT case_id, CAST(max(CASE key WHEN 'booking_no' THEN 1.0 WHEN 'bl_no' THEN 0.95 ELSE 0.9 END) AS DECIMAL(9,2)) AS score, string_agg(key || ' equal', '; ' ORDER BY key) AS reasons FROM p GROUP BY 1",
    }


FANOUT = "CASE WHEN event_type = 'error' THEN ['ocr', 'field'] WHEN event_type = 'purchase' THEN ['match'] WHEN event_type = 'view' THEN ['正確'] ELSE ['其他'] END"
