"""DuckDB SQL of the organizer's queries, written apart from the operators; only tables of fixed values are shared."""

from __future__ import annotations

from quayside.operators import compare, organizer as O, resolve
from quayside.plans import oracle
from quayside.plans.oracle import RESULTS, WIDE, shown, text
from quayside.plans.organizer import FINDINGS, GROUPING, RISK
from quayside.sources import case_papers, synthetic

NL = "chr(10)"


def listed(names) -> str:
    return f"({', '.join(map(text, names))})"


def named(v: str, table: dict[str, str]) -> str:
    return f"CASE {v} {' '.join(f'WHEN {text(a)} THEN {text(b)}' for a, b in table.items())} ELSE {v} END"


def place(v: str, names) -> str:
    return f"list_position([{', '.join(map(text, names))}], {v})"


def noted(value: str, note: str = "''") -> str:
    return f"{{'value': {value}, 'note': {note}}}"


NUMBER = "([0-9][0-9,]*(?:\\.[0-9]+)?)\\s*"
SQUEEZED = "trim(regexp_replace(value, '\\s+', ' ', 'g'))"
#: Every distinct value of a field, as it is shown, with a note.
NORMED = f"""
seen AS (SELECT DISTINCT canonical, value, {SQUEEZED} AS t, upper({SQUEEZED}) AS up FROM fields),
cuts AS (SELECT *, try_cast(replace(regexp_extract(up, '{NUMBER}([A-Z./]+)?', 1), ',', '') AS DECIMAL(38,10)) AS q, replace(regexp_extract(up, '{NUMBER}([A-Z./]+)?', 2), '.', '') AS qu,
  try_cast(replace(regexp_extract(up, '{NUMBER}([A-Z]+)?', 1), ',', '') AS DECIMAL(38,10)) AS w, regexp_extract(up, '{NUMBER}([A-Z]+)?', 2) AS wu, {oracle.number('t')} AS m, regexp_extract(up, '\\b({O.CURRENCIES})\\b', 1) AS code, replace(up, '.', '') AS alone FROM seen),
normed AS (SELECT canonical, value, CASE WHEN t = '' THEN {noted("''")}
  WHEN canonical IN {listed(O.COUNTS)} THEN CASE WHEN q IS NULL THEN {noted('up')} ELSE {noted(f"trim({shown('q')} || ' ' || {named('qu', O.UNITS)})", f"CASE WHEN qu <> '' AND qu <> {named('qu', O.UNITS)} THEN qu || ' 視為 ' || {named('qu', O.UNITS)} ELSE '' END")} END
  WHEN canonical = 'unit' THEN {noted(named('alone', O.UNITS), f"CASE WHEN alone <> '' AND alone <> {named('alone', O.UNITS)} THEN alone || ' 視為 ' || {named('alone', O.UNITS)} ELSE '' END")}
  WHEN canonical IN {listed(O.WEIGHTS)} THEN CASE WHEN w IS NULL THEN {noted('up')} WHEN wu IN {listed(O.TONS)} THEN {noted(f"{shown('w * 1000')} || ' KG'", f"{shown('w')} || ' ' || wu || ' 換算為 ' || {shown('w * 1000')} || ' KG'")}
    WHEN wu IN ('', 'KG') THEN {noted(f"{shown('w')} || ' KG'")} WHEN wu IN {listed(O.KILOS)} THEN {noted(f"{shown('w')} || ' KG'", "wu || ' 視為 KG'")} ELSE {noted(f"{shown('w')} || ' ' || wu")} END
  WHEN canonical IN {listed(O.MONEY)} THEN CASE WHEN m IS NULL THEN {noted('up')} ELSE {noted(f"trim(replace(code, 'RMB', 'CNY') || ' ' || {shown('m')})", "'已標準化幣別與千分位'")} END
  WHEN canonical IN {listed(O.CODES)} THEN {noted("replace(up, ' ', '')")} ELSE {noted('t')} END AS x FROM cuts)"""


def moved(sql: str) -> str:
    return sql.replace(synthetic.SQL, case_papers.SQL)


VESSEL = "list_filter(regexp_extract_all(upper(value), '[A-Z0-9]+'), lambda w: {t})"
WORDS = "regexp_extract_all(upper(value), '[A-Z0-9]+')"
FIRST_DIGITS = f"list_filter({WORDS}, lambda x: regexp_matches(x, '[0-9]'))[1]"
BASE = f"""{moved(RESULTS)},{WIDE.removeprefix(oracle.FIELDS + ',')},{NORMED},
named_fields AS (SELECT f.case_id, seg, ord, f.doc_type, f.canonical AS field, x.value AS value, x.note AS note, confidence, case_id || '-' || seg || '.txt' AS source FROM fields f JOIN normed v ON v.canonical = f.canonical AND v.value = f.value WHERE x.value <> ''),
known_keys AS (SELECT n AS case_id, 'bl_no' AS key, bl AS value FROM figures WHERE n % 8 <> 5
  UNION ALL SELECT l_orderkey, 'shipper', min(s_name) FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1),
cases AS (SELECT c.case_id, CASE status {' '.join(f"WHEN '{a}' THEN '{b}'" for a, b in GROUPING.items())} ELSE 'pending_review' END AS grouping_ FROM (SELECT DISTINCT case_id FROM papers) c LEFT JOIN results r ON r.case_id = c.case_id AND field = 'bl_no'),
gone AS (SELECT case_id, doc_type FROM (SELECT DISTINCT case_id FROM papers), (SELECT unnest([{', '.join(map(text, resolve.REQUIRED['import']))}]) AS doc_type) EXCEPT SELECT case_id, doc_type FROM papers),
findings AS ({' UNION ALL '.join(f"SELECT case_id, {i} AS place, {text(FINDINGS[k])} AS title, CASE {oracle.TAX[k]} END AS status FROM based" for i, k in enumerate(FINDINGS, 1))}),
lacking AS (SELECT p.case_id, concat_ws('、', {', '.join(f"CASE WHEN NOT coalesce(bool_or(f.canonical IN {listed(names)}), false) THEN {text(label)} END" for label, names in O.MANIFEST_NEEDS.items())}) AS lacks
  FROM (SELECT DISTINCT case_id FROM papers WHERE doc_type = 'manifest') p LEFT JOIN fields f ON f.case_id = p.case_id AND f.doc_type = 'manifest' AND f.value <> '' GROUP BY 1),
vessels AS (SELECT case_id, seg, doc_type, array_to_string(list_filter({WORDS}, lambda x, i: i IS DISTINCT FROM list_position({WORDS}, {FIRST_DIGITS})), ' ') AS vessel, coalesce({FIRST_DIGITS}, '') AS voyage FROM firsts WHERE canonical = 'vessel_voyage'),
pending AS (SELECT d.case_id, 'vessel_voyage' AS field, arg_min(CASE WHEN o.voyage = '' THEN '⚠ 航次待確認：船名一致，報單航次 ' || d.voyage || '，佐證文件未取得航次。' ELSE '⚠ 航次待確認：船名一致，佐證文件航次 ' || o.voyage || '，報單未取得航次。' END, o.seg) AS vessel
  FROM vessels d JOIN vessels o ON o.case_id = d.case_id AND d.doc_type = 'declaration' AND o.doc_type <> 'declaration' AND d.vessel <> '' AND d.vessel = o.vessel AND (d.voyage = '') <> (o.voyage = '') GROUP BY 1),
told AS (SELECT case_id, canonical AS field, list(value ORDER BY spot) AS vals, list(x ORDER BY spot) AS xs FROM (SELECT case_id, f.canonical, f.value, any_value(x) AS x, min(seg) AS spot FROM firsts f JOIN normed v ON v.canonical = f.canonical AND v.value = f.value WHERE doc_type <> 'declaration' GROUP BY ALL) GROUP BY ALL),
valued AS (SELECT r.*, coalesce(vals, []) AS vals, p.vessel, coalesce(list_filter(list_transform(list_filter(coalesce(xs, []), lambda y: y.value = h.x.value AND h.x.value <> ''), lambda y: CASE WHEN h.x.note = y.note OR y.note = '' THEN h.x.note WHEN h.x.note = '' THEN y.note ELSE h.x.note || '；' || y.note END), lambda n: n <> '')[1], '') AS equal_note,
    {place('r.field', compare.CHECK_FIELDS)} AS place, {named('r.field', O.FIELD_LABELS)} AS label
  FROM results r LEFT JOIN told t USING (case_id, field) LEFT JOIN pending p USING (case_id, field) LEFT JOIN normed h ON h.canonical = r.field AND h.value = r.hub_value)"""
KEPT = f"""
wanted AS (SELECT case_id, field, 1 AS own, CAST(confidence AS DOUBLE) AS c, seg, ord, value, source, note FROM named_fields
  UNION ALL SELECT case_id, {named('key', {k: f for f, k in O.KEY_FIELDS.items()})}, 0, {O.KEY_CONFIDENCE}, 0, 0, value, {text(O.KEY_SOURCE)}, '' FROM known_keys),
summary AS (SELECT case_id, {named('field', {f: s for s, names in O.SECTIONS.items() for f in names})} AS section, CAST({place('field', [f for names in O.SECTIONS.values() for f in names])} AS BIGINT) AS place, field, {named('field', O.FIELD_LABELS)} AS label, value, source, CAST(c AS DECIMAL(9,2)) AS confidence, note
  FROM wanted WHERE field IN {listed([f for names in O.SECTIONS.values() for f in names])} QUALIFY row_number() OVER (PARTITION BY case_id, field ORDER BY own DESC, c DESC, seg, ord) = 1)"""
MANIFEST = f"""
stated AS (SELECT case_id, field, {named('field', O.FIELD_LABELS)} AS label, value, source, confidence, note, seg, ord FROM named_fields WHERE doc_type = 'manifest' AND field IN {listed(O.MANIFEST)} QUALIFY row_number() OVER (PARTITION BY case_id, field, value ORDER BY seg, ord) = 1)"""
AUDIT = """SELECT case_id, 0 AS rank, place, CASE status WHEN 'MATCH' THEN '✓ ' || label || ' 一致' || CASE WHEN equal_note <> '' THEN '（' || equal_note || '）' ELSE '' END
  WHEN 'MISMATCH' THEN coalesce(vessel, '✗ ' || label || ' 不一致：' || concat_ws('；', '報單 ' || hub_value, array_to_string(list_transform(vals, lambda v: '佐證文件 ' || v), '；')))
  ELSE '⚠ ' || label || ' 缺資料：' || CASE WHEN hub_value IS NOT NULL AND len(vals) = 0 THEN '報單有值 ' || hub_value || '，佐證文件未取得對應欄位' WHEN hub_value IS NULL AND len(vals) > 0 THEN '佐證文件有值（' || array_to_string(vals, '；') || '），報單未取得對應欄位' ELSE '報單與佐證文件都未取得可核對欄位' END END AS text FROM valued"""
DOC, KIND = named("doc_type", O.DOCUMENT_LABELS), place("doc_type", O.DOCUMENT_LABELS)
MISSING = f"""SELECT g.case_id, 0 AS rank, {place('g.doc_type', O.DOCUMENT_LABELS)} AS place, CASE WHEN g.doc_type = 'bill_of_lading' AND coalesce(e.good, false) THEN '⚠ 未取得正式 B/L，目前以到貨通知作為船務佐證。' ELSE '✗ 缺少 ' || {named('g.doc_type', O.DOCUMENT_LABELS)} END AS text FROM gone g
  LEFT JOIN (SELECT f.case_id, bool_or(f.canonical IN ('vessel_voyage', 'vessel', 'eta')) AND (bool_or(f.canonical = 'bl_no') OR bool_or(k.case_id IS NOT NULL)) AS good FROM fields f LEFT JOIN known_keys k ON k.case_id = f.case_id AND key = 'bl_no' WHERE doc_type = 'arrival_notice' GROUP BY 1) e ON e.case_id = g.case_id
  UNION ALL SELECT g.case_id, 0, {place('g.doc_type', O.DOCUMENT_LABELS)} + 100, '⚠ 已收到疑似 ' || {named('g.doc_type', O.DOCUMENT_LABELS)} || '，需人工確認：' || string_agg(source, ', ' ORDER BY seg) FROM gone g JOIN papers p ON p.case_id = g.case_id AND p.candidate = g.doc_type GROUP BY 1, 2, 3, g.doc_type"""
ERRORS = f"""SELECT case_id, 0 AS rank, 0 AS place, {text(O.MIXED)} AS text FROM cases WHERE grouping_ IN {listed(O.LOW)}
  UNION ALL SELECT case_id, 1, seg * 2, '文件辨識需人工確認。' FROM papers WHERE manual
  UNION ALL SELECT case_id, 1, seg * 2 + 1, '疑似 ' || {DOC} || '，辨識信心 ' || CAST(floor(confidence * 100) AS INTEGER) || '%。' FROM papers WHERE confidence < 0.78
  UNION ALL SELECT case_id, 2, place, label || ' 不一致，請比對報單與佐證文件。' FROM valued WHERE status = 'MISMATCH' AND vessel IS NULL
  UNION ALL SELECT case_id, 2, place, label || ' 缺少可核對資料。' FROM valued WHERE status = 'MISSING' AND field NOT IN {listed(O.OPTIONAL)}
  UNION ALL SELECT case_id, 3, place, title || ' 需覆核：{RISK}' FROM findings WHERE status IN ('MISMATCH', 'MISSING')
  UNION ALL SELECT case_id, 4, 0, '艙單資料不完整：缺少' || lacks || '，需以 B/L、到貨通知或報單佐證。' FROM lacking WHERE lacks <> ''"""
RISKS = f"""{MISSING}
  UNION ALL SELECT case_id, 1, place, coalesce(vessel, label || '與佐證文件不一致，需優先覆核。') FROM valued WHERE status = 'MISMATCH'
  UNION ALL SELECT case_id, 2, place, title || CASE status WHEN 'MISMATCH' THEN '不一致，' ELSE '缺失，' END || '{RISK}' FROM findings WHERE status IN ('MISMATCH', 'MISSING')
  UNION ALL SELECT case_id, 3, 0, CASE WHEN lacks = '' THEN '艙單已提供船名航次、櫃號與貨物摘要，可作為船務資料佐證。' ELSE '艙單已作為船務佐證，但缺少' || lacks || '，建議人工確認艙單與報單船務資料是否一致。' END FROM lacking"""
STEPS = f"""SELECT DISTINCT case_id, 0 AS rank, 0 AS place, {text(O.NEXT[0])} AS text FROM gone UNION ALL SELECT case_id, 1, 0, {text(O.NEXT[1])} FROM cases WHERE grouping_ IN {listed(O.LOW)}
  UNION ALL SELECT DISTINCT case_id, 2, 0, {text(O.NEXT[2])} FROM results WHERE status <> 'MATCH' UNION ALL SELECT case_id, 3, 0, {text(O.NEXT[3])} FROM cases"""


def has(f: str) -> str:
    return f"list_contains(have, '{f}')"


LACKS = f"""concat_ws('、', {', '.join(f"CASE WHEN NOT {has(f)} THEN {text(O.FIELD_LABELS[f])} END" for f in O.PRACTICE)})"""
HELD = "held AS (SELECT c.case_id, grouping_, coalesce(list(field) FILTER (WHERE section <> 'shipment'), []) AS have FROM cases c LEFT JOIN summary s ON s.case_id = c.case_id GROUP BY 1, 2)"
PRACTICE = f"""SELECT case_id, 0 AS rank, 0 AS place, CASE WHEN grouping_ IN {listed(O.LOW)} THEN {text(O.GROUPING_NOTES[0])} WHEN grouping_ NOT IN {listed(O.SURE)} THEN {text(O.GROUPING_NOTES[1])} END AS text FROM held
  UNION ALL SELECT case_id, 1, 0, CASE WHEN {has('cif')} AND {has('fob')} THEN 'CIF / FOB 已取得，請驗算運費與保費是否合理。' WHEN {has('cif')} OR {has('fob')} THEN '僅取得部分交易價格欄位，需確認運費、保費及完稅價格。' END FROM held
  UNION ALL SELECT case_id, 2, 0, CASE WHEN {has('hs_code')} AND {has('description')} THEN '稅則與品名已取得，需依公司實務規則覆核稅則合理性。' WHEN NOT {has('hs_code')} THEN '稅則尚未取得，無法完成最終申報風險判斷。' END FROM held
  UNION ALL SELECT case_id, 3, 0, CASE WHEN {LACKS} <> '' THEN '未取得 ' || {LACKS} || ' 欄位；若本品項適用相關規定，需人工確認。' END FROM held
  UNION ALL SELECT case_id, 4, 0, '正式報單尚未完整確認，不能作為最終申報結論。' FROM gone WHERE doc_type = 'declaration'"""


def gathered(rows: str, most: int | None = None) -> str:
    return f"""SELECT case_id, {f"list_slice(list(text ORDER BY spot), 1, {most})" if most else "list(text ORDER BY spot)"} AS items FROM (SELECT case_id, text, min({{'rank': rank, 'place': CAST(place AS BIGINT)}}) AS spot FROM ({rows}) WHERE text IS NOT NULL GROUP BY ALL) GROUP BY 1"""


def joined(rows: str, most: int | None = None, more: str = "") -> str:
    return f"WITH {BASE}{more}\nSELECT case_id, array_to_string(items, {NL}) AS items FROM ({gathered(rows, most)})"


def humanized(v: str) -> str:
    names = [(x, label) for table in (O.DOCUMENT_LABELS, O.FIELD_LABELS) for k, label in table.items() for x in (k, k.upper())] + [("low confidence", "低信心"), ("pending review", "待人工確認")]
    pairs = ", ".join(f"[{text(a)}, {text(b)}]" for a, b in names)
    return f"list_reduce(list_prepend([{v}, ''], [{pairs}]), lambda acc, p: [replace(acc[1], p[1], p[2]), ''])[1]"


def report() -> str:
    line = "label || '：' || value || CASE WHEN note <> '' THEN '；' || note ELSE '' END"
    lists = {"missing": (MISSING, None), "audit": (AUDIT, None), "errors": (ERRORS, O.MOST_ERRORS), "next": (STEPS, None)}
    ctes = "".join(f",\nb_{k} AS ({gathered(*v)})" for k, v in lists.items())
    ctes += f",\nr_first AS ({gathered(RISKS, O.MOST_RISKS)}),\nb_risks AS ({gathered(f'SELECT case_id, rank - 10 AS rank, place, text FROM ({PRACTICE}) UNION ALL SELECT case_id, 0, unnest(range(1, len(items) + 1)), unnest(items) FROM r_first')})"
    for s in O.SECTIONS:
        ctes += f",\nb_{s} AS (SELECT case_id, list({line} ORDER BY place) AS items FROM summary WHERE section = '{s}' GROUP BY 1)"
    ctes += f",\nb_manifest AS (SELECT case_id, list({line} ORDER BY seg, ord, label, value) AS items FROM stated GROUP BY 1)"
    names = list(dict.fromkeys(b for b, _, _ in O.HEADINGS))
    cols = ", ".join(f"coalesce({'list_filter(b_errors.items, lambda e: NOT list_contains(coalesce(b_risks.items, []), e))' if b == 'errors' else f'b_{b}.items'}, []) AS {b}_" for b in names)
    ctes += f",\nwhole AS (SELECT c.case_id, c.grouping_, {cols} FROM cases c {' '.join(f'LEFT JOIN b_{b} ON b_{b}.case_id = c.case_id' for b in names)})"
    parts = [f"'一、案件摘要' || {NL} || '案件編號：' || case_id || {NL} || '分票判斷：' || {named('grouping_', O.GROUPINGS)} || {NL}"]
    for i, (b, title, empty) in enumerate(O.HEADINGS):
        body = f"array_to_string(list_transform(CASE WHEN len({b}_) > 0 THEN {b}_ ELSE [{text(empty)}] END, lambda v: '- ' || v), {NL})"
        part = f"{NL} || {text(title)} || {NL} || {body}" if i == 0 else f"{NL} || {NL} || {text(title)} || {NL} || {body}"
        parts.append(part if empty else f"CASE WHEN len({b}_) > 0 THEN {part} ELSE '' END")
    return f"WITH {BASE},{KEPT},{MANIFEST},\n{HELD}{ctes}\nSELECT case_id, {' || '.join(parts)} AS text FROM whole"


BUCKET = named("doc_type", O.BUCKETS)


def oracle_sql() -> dict[str, str]:
    return {
        "organizer_values": f"WITH {BASE} SELECT case_id, seg, ord, field AS canonical, value, note FROM named_fields",
        "case_summaries": f"WITH {BASE},{KEPT} SELECT * FROM summary",
        "manifest_values": f"WITH {BASE},{MANIFEST} SELECT case_id, field, label, value, source, CAST(confidence AS DECIMAL(9,2)) AS confidence, note FROM stated",
        "manifest_lacks": f"WITH {BASE} SELECT * FROM lacking",
        "audit_texts": joined(AUDIT),
        "missing_notes": joined(MISSING),
        "potential_errors": joined(ERRORS, O.MOST_ERRORS),
        "risk_notes": joined(RISKS, O.MOST_RISKS),
        "next_steps": joined(STEPS),
        "practice_lines": joined(PRACTICE, None, f",{KEPT},\n{HELD}"),
        "paper_buckets": f"""WITH {case_papers.SQL}, own AS (SELECT case_id, {BUCKET} AS bucket, string_agg(source, ', ' ORDER BY seg) AS papers FROM papers GROUP BY 1, 2),
guesses AS (SELECT case_id, {named('candidate', O.BUCKETS)} AS bucket, string_agg('疑似文件：' || source, ', ' ORDER BY seg) AS papers FROM papers WHERE candidate IS NOT NULL GROUP BY 1, 2)
SELECT * FROM own UNION ALL SELECT * FROM guesses g WHERE NOT EXISTS (SELECT 1 FROM own o WHERE o.case_id = g.case_id AND o.bucket = g.bucket)""",
        "humanized_notes": f"WITH {case_papers.SQL} SELECT case_id, seg, {humanized("coalesce(candidate, doc_type) || ' low confidence: gross_weight, ' || upper(coalesce(candidate, doc_type)) || ' pending review'")} AS note FROM papers WHERE confidence < 0.78",
        "case_report": report(),
    }
