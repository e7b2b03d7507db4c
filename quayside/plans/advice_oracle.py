"""DuckDB SQL for the queries of plans.advice, written apart from the operators; only tables of fixed values are shared."""

from __future__ import annotations

from quayside.operators import advice, intake
from quayside.plans.advice import FACTS, FIGURES, GIVEN, ORDER, PRACTICE, RATES, REQUIRED, RULES, SHIPPED, SOME_FIELDS, SOME_STATUS
from quayside.plans.more import RETITLED, TYPES
from quayside.plans.more_oracle import SURE_ONLY, listed
from quayside.plans.oracle import FIELDS, RESULTS, SURE, text, values
from quayside.sources import synthetic

NL = "chr(10)"
FACTS_SQL = f"WITH {synthetic.SQL}, facts AS (SELECT n AS case_id, {', '.join(f'{x} AS {k}' for k, x in FACTS.items())} FROM figures)"
SOME = f"some_results AS (SELECT n AS case_id, field, {SOME_STATUS} AS status FROM figures, {values([(i, f) for i, f in enumerate(SOME_FIELDS)], 't(k, field)')})"
SQUASHED = "lower(trim(regexp_replace({v}, '\\s+', ' ', 'g')))"


def case_of(v: str, table: dict[str, str]) -> str:
    return f"CASE {v} {' '.join(f'WHEN {text(a)} THEN {text(b)}' for a, b in table.items())} END"


def ordered_terms(v: str, rules: list[tuple[str, tuple[str, ...]]], other: str) -> str:
    tests = [(" OR ".join(f"instr(lower(coalesce({v}, '')), {text(t.lower())}) > 0" for t in terms), name) for name, terms in rules]
    return f"CASE {' '.join(f'WHEN {t} THEN {text(name)}' for t, name in tests)} ELSE {text(other)} END"


def intake_sql() -> str:
    rows = [(i, k, b, j, t.lower()) for i, (k, b, terms) in enumerate(intake.KINDS) for j, t in enumerate(terms)]
    head = f"array_to_string(list_slice(string_split(body, {NL}), 1, {intake.HEADER_LINES}), {NL})"
    return f"""WITH {synthetic.SQL},
given AS (SELECT case_id, seg, body, lower(file) AS file, {SQUASHED.format(v='body')} AS n, {SQUASHED.format(v=head)} AS h FROM (SELECT case_id, seg, {RETITLED['text']} AS body, {RETITLED['file']} AS file FROM papers)),
hits AS (SELECT case_id, seg, o, kind, least(98, any_value(base) + least(18, 4 * (count(*) - 1)) + CASE WHEN bool_or(contains(h, term)) THEN 8 ELSE 0 END + CASE WHEN bool_or(j = 0 AND contains(h, term)) THEN 8 ELSE 0 END) AS score
  FROM given JOIN {values(rows, 't(o, kind, base, j, term)')} ON contains(n, term) GROUP BY case_id, seg, o, kind),
best AS (SELECT * FROM hits QUALIFY row_number() OVER (PARTITION BY case_id, seg ORDER BY score DESC, o) = 1),
all_ AS (SELECT case_id, seg, coalesce(kind, CASE WHEN regexp_matches(file, '\\.(jpg|jpeg|png|tif|tiff)$') THEN 'image_scan' ELSE 'unknown' END) AS kind, CAST(coalesce(score, CASE WHEN n = '' THEN 0 ELSE 35 END) AS BIGINT) AS score, n FROM given LEFT JOIN best USING (case_id, seg))
SELECT case_id, seg, kind, score, concat_ws('; ', CASE WHEN score < 55 THEN 'low classification confidence' END, CASE WHEN n = '' THEN 'no extracted text' END) AS warnings, coalesce({case_of('kind', intake.DOC_TYPES)}, kind) AS doc_type FROM all_"""


def amount(*labels: str) -> str:
    one = [f"CAST(nullif(replace(regexp_extract(upper(said), '\\b{x}\\b[^0-9]{{0,8}}([0-9][0-9,]*(?:\\.[0-9]+)?)', 1), ',', ''), '') AS DECIMAL(18,2))" for x in labels]
    return f"coalesce({', '.join(one)})" if len(one) > 1 else one[0]


def plain(x: str) -> str:
    return f"rtrim(rtrim(CAST(CAST({x} AS DECIMAL(38,2)) AS VARCHAR), '0'), '.')"


KIND = f"coalesce(nullif({TYPES['parsed']}, 'unknown'), CASE WHEN n % 2 <> 0 THEN 'booking' END, CASE WHEN n % 7 <> 0 THEN {TYPES['candidate']} END, 'unknown')"
HEADLINE = f"""CASE WHEN can_declare THEN '文件齊全且未發現阻擋報關的差異' WHEN state IN {listed(tuple(advice.HEADLINES))} THEN {case_of('state', advice.HEADLINES)} WHEN n_missing > 0 THEN '缺少 ' || n_missing || ' 份必要文件' WHEN n_high > 0 THEN '發現 ' || n_high || ' 個高風險核對問題'
  WHEN n_differ > 0 THEN '發現 ' || n_differ || ' 個差異，需人工判斷' WHEN n_rules > 0 THEN '發現規則提醒，需確認是否適用本案' ELSE '已建立案件 workflow，等待進一步核對' END"""
ACTIONS = f"""coalesce(nullif(concat_ws({NL}, CASE WHEN "grouping" IN {listed(advice.LOW)} THEN '請人工確認 INV / PKG / B/L 是否屬於同一票案件' END, CASE WHEN n_missing > 0 THEN '補齊缺少的正式文件' END, CASE WHEN unresolved <> '' THEN '補確認關鍵欄位: ' || unresolved END,
  CASE WHEN n_differ > 0 THEN '逐項核對差異欄位，確認是否需要更正報單或文件' END, CASE WHEN n_high > 0 THEN '先處理高風險欄位，再決定是否可報' END, CASE WHEN n_rules > 0 THEN '確認公司、客戶、航線或案件規則是否適用' END), ''), '可進入報關送件流程')"""
SHOWN = f"coalesce({case_of('state', advice.STATES)}, {case_of('case_status', advice.CASES)}, 'processing')"
HAS = "list_contains(string_split(labels, ','), '{x}')"
LACKS = f"array_to_string(list_filter([{', '.join(map(text, PRACTICE))}], lambda x: NOT list_contains(string_split(labels, ','), x)), '、')"
NOTES = f"""concat_ws({NL}, CASE WHEN {HAS.format(x='CIF')} AND {HAS.format(x='FOB')} THEN 'CIF / FOB 已取得，請驗算運費與保費是否合理。' WHEN {HAS.format(x='CIF')} OR {HAS.format(x='FOB')} THEN '僅取得部分交易價格欄位，需確認運費、保費及完稅價格。' END,
  CASE WHEN {HAS.format(x='稅則')} AND {HAS.format(x='品名')} THEN '稅則與品名已取得，需依公司實務規則覆核稅則合理性。' WHEN NOT {HAS.format(x='稅則')} THEN '稅則尚未取得，無法完成最終申報風險判斷。' END, CASE WHEN {LACKS} <> '' THEN '未取得 ' || {LACKS} || ' 欄位；若本品項適用相關規定，需人工確認。' END,
  CASE WHEN n_rules = 1 THEN '正式報單尚未完整確認，不能作為最終申報結論。' END)"""
SAID = "CASE status WHEN 'MISMATCH' THEN '✗ ' || field || ' 不一致' WHEN 'MISSING' THEN '✗ ' || field || ' 缺失' WHEN 'HIGH_RISK' THEN '⚠ ' || field || ' 待人工確認' END"
PLACE = f"list_position([{', '.join(map(text, ORDER))}], field)"
RANK = f"list_position([{', '.join(map(text, advice.PRIORITY))}], status)"
SECTION_ROWS = values([(i + 1, k, f) for i, (k, names) in enumerate(advice.SECTIONS) for f in names], "s(number, section, f)")


def findings_sql() -> str:
    of_case = {r: (lv, d, c, f, m) for r, lv, d, c, f, m in RULES}
    rate = f"CASE upper(coalesce(box_size, '')) {' '.join(f'WHEN {text(k)} THEN {v}' for k, v in RATES.items())} END"
    money = "'Expected: ' || CAST({x} AS DECIMAL(18,2))"
    says = {
        "field_compare": "'{d} ' || nullif(detail, '')",
        "freight_by_cbm": "'{d} ' || coalesce(CASE WHEN cbm IS NOT NULL THEN " + money.format(x="CASE WHEN cbm <= 5 THEN 6000 ELSE 8000 END") + " END, 'Missing CBM or configured rate table.')",
        "fixed_freight_by_container_size": "'{d} ' || coalesce(" + money.format(x=rate) + ", 'Missing configured fixed freight for container_size=' || upper(coalesce(nullif(box_size, ''), '-')))",
        "insurance_formula": "'{d} ' || coalesce(" + money.format(x="round(greatest(CAST(amount AS DECIMAL(18,2)) * 1.1 * 0.0012, 400), 2)") + ", 'Missing amount, insurance_rate, or configured rate table.')",
    }
    # greatest() passes over nulls, so the premium of no amount is told apart
    says["insurance_formula"] = "CASE WHEN amount IS NULL THEN '{d} Missing amount, insurance_rate, or configured rate table.' ELSE " + says["insurance_formula"] + " END"
    parts = []
    for r, (lv, d, c, f, m) in of_case.items():
        where = "true" if m is None else f"n % 4 = {m}"
        if c == "parser_required_fields":
            lacks = f"array_to_string(list_filter([{', '.join(map(text, f))}], lambda x: NOT list_contains(have, x)), ', ')"
            parts.append(f"SELECT case_id, seg, '{r}' AS rule_id, '{lv} {r}: {d} Missing parser fields: ' || {lacks} AS message FROM have JOIN figures ON n = case_id WHERE {where} AND {lacks} <> ''")
        else:
            said = says.get(c, "'{d}'").format(d=d)
            parts.append(f"SELECT case_id, -1 AS seg, '{r}' AS rule_id, '{lv} {r}: ' || {said} AS message FROM told WHERE {where} AND {said} IS NOT NULL")
    return f"""{RESULTS},
have AS (SELECT case_id, CAST(seg AS BIGINT) AS seg, list(DISTINCT canonical) AS have FROM firsts GROUP BY 1, 2),
acts AS (SELECT case_id, field || ' ' || status AS x, row_number() OVER (PARTITION BY case_id ORDER BY {PLACE}) AS i FROM results WHERE status IN ('MISMATCH', 'MISSING', 'HIGH_RISK')),
detailed AS (SELECT n, {', '.join(f'{x} AS {k}' for k, x in FIGURES.items())}, concat_ws('; ', (SELECT string_agg(x, '; ' ORDER BY i) FROM acts WHERE acts.case_id = n AND i <= 5), CASE WHEN n % 6 = 0 THEN 'w1; w2; w3' END) AS detail FROM figures),
told AS (SELECT n AS case_id, * FROM detailed)
{' UNION ALL '.join(parts)}"""


def oracle_sql() -> dict[str, str]:
    found = {
        "intake_kinds": intake_sql(),
        "segment_kinds": f"WITH {synthetic.SQL}, kinds AS (SELECT n, {KIND} AS kind FROM figures) SELECT n AS case_id, kind, CAST(CASE WHEN n % 6 = 0 THEN 0 WHEN kind = 'unknown' THEN 30 ELSE 75 END AS BIGINT) AS score FROM kinds",
        "evidence_kinds": f"{FACTS_SQL} SELECT case_id, {ordered_terms('source', list(intake.EVIDENCE), '')} AS kind, {ordered_terms('problem', [(m, w) for w, m in intake.MESSAGES], intake.OTHER_MESSAGE)} AS message FROM facts",
        "field_categories": f"WITH {FIELDS} SELECT CASE {' '.join(f'WHEN canonical IN {listed(f) if len(f) > 1 else chr(40) + text(f[0]) + chr(41)} THEN {text(c)}' for c, f in intake.CATEGORIES)} ELSE {text(intake.BASIC)} END AS category, count(*) AS n, count(DISTINCT canonical) AS fields FROM firsts GROUP BY 1",
        "case_headlines": f"{FACTS_SQL} SELECT case_id, {HEADLINE} AS headline, {ACTIONS} AS actions FROM facts",
        "shown_states": f"""{FACTS_SQL} SELECT case_id, {SHOWN} AS shown, {case_of(SHOWN, advice.STATE_LABELS)} AS label, CASE WHEN state IN ('READY_FOR_AUDIT', 'AUDIT_COMPLETED') THEN '可核對' WHEN state = 'LOW_CONFIDENCE' THEN '確認同票' WHEN n_rules > 0 THEN '確認規則' ELSE '無' END AS action,
  concat_ws({NL}, CASE WHEN coalesce(release_method, '') NOT IN {listed(advice.RELEASE_METHODS)} THEN '放行方式需為 C1、C2、C3M 或 C3X。' END, CASE WHEN n_papers <= 0 THEN '請先加入進口文件。' END) AS warnings FROM facts""",
        "practice_notes": f"{FACTS_SQL} SELECT case_id, {NOTES} AS notes, regexp_matches(upper(counted), 'CONTAINER') AND regexp_matches(upper(counted), 'BLE|BALES') AS bales FROM facts",
        "formula_words": f"""WITH {synthetic.SQL}, said AS (SELECT n AS case_id, gw, n, {FACTS['said']} AS said FROM figures),
read_ AS (SELECT *, {amount('FOB')} AS fob, {amount('FRT', 'FREIGHT')} AS frt, {amount('INS', 'INSURANCE')} AS ins, {amount('CIF')} AS c, CAST(CAST(gw AS DECIMAL(18,3)) / 1000 AS DECIMAL(18,2)) AS tons FROM said)
SELECT case_id, coalesce({plain('fob')} || ' + ' || {plain('frt')} || ' + ' || {plain('ins')} || ' = ' || {plain('fob + frt + ins')} || '，CIF ' || CASE WHEN fob + frt + ins = c THEN '正確' ELSE '不一致，差額 ' || {plain('c - fob - frt - ins')} END, '') AS cif,
  CASE WHEN tons * 1000 = gw + n % 2 THEN {plain('tons')} || ' MTS = ' || {plain('gw + n % 2')} || ' KG' ELSE '' END AS weight FROM read_""",
        "risk_levels": f"""{FACTS_SQL}, {SOME}, counts AS (SELECT case_id, CAST(count_if(status IN ('MISMATCH', 'HIGH_RISK')) AS BIGINT) AS n_differ, CAST(count_if(status = 'MISSING') AS BIGINT) AS n_lacking FROM some_results WHERE NOT (status = 'HIGH_RISK' AND field = 'amount') GROUP BY 1)
SELECT c.case_id, c.n_differ, c.n_lacking, CASE WHEN n_missing > 0 THEN '中風險' WHEN c.n_differ > 0 THEN '高風險' WHEN c.n_lacking > 0 THEN '中風險' ELSE '低風險' END AS level, CASE WHEN n_missing > 0 THEN '請先補齊缺少文件，再進行稅則、金額、重量與船名航次最終核對。' WHEN c.n_differ > 0 THEN '請優先確認紅色差異欄位，必要時回查發票、裝箱單與報單原始資料。' ELSE '目前主要欄位未見重大異常，可進入人工覆核與歸檔。' END AS recommendation
FROM counts c JOIN facts f ON f.case_id = c.case_id""",
        "risk_summary": f"""WITH {RESULTS}, {SURE_ONLY}, said AS (SELECT case_id, 0 AS part, 0 AS place, '✗ 缺少 ' || doc_type AS x FROM gone UNION ALL SELECT case_id, 1, {PLACE}, {SAID} FROM results)
SELECT case_id, coalesce(string_agg(x, {NL} ORDER BY part, place, x), '✓ 目前未發現需要立即處理的高風險項目。') AS summary FROM said GROUP BY 1""",
        "report_outline": f"""WITH {synthetic.SQL}, {SOME}, placed AS (SELECT case_id, field, {RANK} AS r, coalesce(section, field) AS section, number FROM some_results LEFT JOIN {SECTION_ROWS} ON f = field)
SELECT case_id, CAST(coalesce(any_value(number), 100 + min(r)) AS BIGINT) AS place, section, [{', '.join(map(text, advice.PRIORITY))}][min(r)] AS status, string_agg(DISTINCT field, ',' ORDER BY field) AS fields FROM placed GROUP BY case_id, section""",
        "parsed_items": f"""WITH {FIELDS}, items AS (SELECT case_id, seg, string_agg(canonical || '=' || value, '；' ORDER BY canonical) AS x FROM firsts GROUP BY 1, 2)
SELECT case_id, seg, CASE WHEN case_id % 7 = 3 OR case_id % 5 = 2 THEN 'WARNING' ELSE 'MATCH' END AS status, CASE WHEN case_id % 7 = 3 THEN 'unreadable' WHEN case_id % 5 = 2 THEN '未抓到指定欄位。' ELSE x END AS shown FROM items""",
        "handled_fields": f"WITH {FIELDS}, {SOME} SELECT case_id, string_agg(field, ',' ORDER BY field) AS handled FROM (SELECT case_id, field FROM some_results UNION SELECT case_id, canonical FROM firsts) GROUP BY 1",
        "completeness": f"""WITH {SURE}, best AS (SELECT case_id, doc_type, max(confidence) AS c FROM sure GROUP BY 1, 2)
SELECT k.case_id, t.doc_type, CASE WHEN c IS NULL THEN 'missing' WHEN c < 0.78 THEN 'warning' ELSE 'ok' END AS state FROM (SELECT DISTINCT case_id FROM sure) k CROSS JOIN (SELECT unnest([{', '.join(map(text, REQUIRED))}]) AS doc_type) t LEFT JOIN best b ON b.case_id = k.case_id AND b.doc_type = t.doc_type""",
        "substituted_documents": f"WITH {SURE} SELECT case_id, doc_type, CASE WHEN doc_type = 'bill_of_lading' AND case_id % 8 < 5 AND case_id % 3 > 0 AND case_id % 4 > 0 THEN '⚠ 未取得正式 B/L，目前以到貨通知作為船務佐證。' ELSE '✗ 缺少 ' || doc_type END AS note FROM gone",
        "case_context": f"""WITH {FIELDS}, given AS (SELECT n AS case_id, {', '.join(f'{x} AS {k}' for k, x in GIVEN.items())} FROM figures),
own AS (SELECT case_id, canonical AS key, arg_min(value, seg) AS value FROM firsts WHERE canonical IN ('bl_no', 'invoice_no', 'booking_no') GROUP BY 1, 2
  UNION ALL SELECT DISTINCT case_id, 'document_types', doc_type FROM papers
  UNION ALL SELECT case_id, 'shipment_type', CASE WHEN bool_or(t LIKE '%cfs%') THEN 'CFS' WHEN bool_or(t LIKE '%fcl%' OR t LIKE '%20ft%' OR t LIKE '%40ft%') THEN 'FCL' END AS x FROM (SELECT case_id, lower({SHIPPED['text']}) AS t FROM papers) GROUP BY 1 HAVING x IS NOT NULL
  UNION ALL SELECT case_id, 'destination_country', 'Vietnam' FROM given WHERE lower(pod) LIKE '%vietnam%' OR lower(pod) LIKE '%viet nam%')
SELECT * FROM own UNION ALL SELECT case_id, 'pod', pod FROM given UNION ALL SELECT case_id, 'bl_no', bl_no FROM given WHERE NOT EXISTS (SELECT 1 FROM own WHERE own.case_id = given.case_id AND own.key = 'bl_no')""",
        "rule_findings": f"WITH {findings_sql()}",
    }
    return found
