"""DuckDB SQL of the queries of plans.exports; only tables of fixed values are shared with the operators."""

from __future__ import annotations

from quayside.operators import export as E, labels as L
from quayside.plans import oracle
from quayside.plans.exports import LABELLED
from quayside.plans.oracle import text, values
from quayside.sources import case_papers, export_papers, synthetic


def listed(names) -> str:
    return f"({', '.join(map(text, names))})"


def quoted(label: str) -> str:
    return "".join(c if c.isalnum() or c == " " else "\\" + c for c in label)


DEFS = [(kind, field, rank, x.lower(), quoted(x)) for kind, fields in L.TABLES.items() for field, names in fields.items() for rank, x in enumerate(sorted(names, key=lambda n: -len(n)))]
NAMED = f"CASE kind {' '.join(f'WHEN {text(a)} THEN {text(b)}' for a, b in L.NAMES.items())} ELSE kind END"


def value(at: str) -> str:
    return f"left(trim(regexp_extract(t, '(?im){at}' || name || '\\s*[:：#]\\s*([^\\n]+)', 1), chr(32) || chr(9) || ':：'), {L.LONGEST})"


LABELS = f"""{case_papers.SQL},
told AS (SELECT case_id, seg, {', '.join(f'{v} AS {k}' for k, v in LABELLED.items())} FROM papers),
tidy AS (SELECT case_id, seg, kind AS doc_type, {NAMED} AS k, file, array_to_string(list_filter(list_transform(string_split(replace(told, chr(13), chr(10)), chr(10)), lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g'))), lambda x: x <> ''), chr(10)) AS t FROM told),
defs AS (SELECT * FROM {values(DEFS, 'd(k, field, rank, low, name)')}),
tried AS (SELECT case_id, seg, doc_type, file, field, rank, {value('^\\s*')} AS a, {value('')} AS b FROM tidy JOIN defs USING (k) WHERE contains(lower(t), low)),
found AS (SELECT case_id, seg, doc_type, file, field, min_by(CASE WHEN a <> '' THEN a ELSE b END, rank) AS value FROM tried WHERE a <> '' OR b <> '' GROUP BY ALL)"""
ERROR = f"CASE WHEN lower(file) LIKE '%.txt' THEN '' ELSE {text(L.UNREAD)} || regexp_extract(file, '(\\.[^.]*)$', 1) END"
FIRSTS = oracle.FIELDS.replace(synthetic.SQL, export_papers.SQL)
RESULTS = f"""{FIRSTS},
hubs AS (SELECT case_id, min(seg) AS h FROM papers WHERE doc_type IN {listed(E.HUB)} GROUP BY 1),
vals AS (SELECT f.case_id, f.seg, f.canonical AS field, f.value, p.doc_type, p.source, trim(regexp_replace(lower(replace(f.value, ',', '')), '\\s+', ' ', 'g')) AS n FROM firsts f JOIN papers p USING (case_id, seg)),
own AS (SELECT v.* FROM vals v JOIN hubs b ON v.case_id = b.case_id AND v.seg = b.h),
cells AS (SELECT case_id, field, place FROM hubs, (SELECT unnest([{', '.join(map(text, E.FIELDS))}]) AS field, unnest(range(1, {len(E.FIELDS) + 1})) AS place)),
met AS (SELECT c.case_id, c.field, c.place, any_value(o.value) AS hub_value, count(t.seg) AS n, string_agg(t.source, ', ' ORDER BY t.seg) FILTER (WHERE t.n <> o.n) AS wrong FROM cells c
  LEFT JOIN own o ON c.case_id = o.case_id AND c.field = o.field LEFT JOIN (SELECT * FROM vals WHERE doc_type IN {listed(E.TARGETS)}) t ON c.case_id = t.case_id AND c.field = t.field GROUP BY 1, 2, 3),
results AS (SELECT case_id, place, field, CASE WHEN hub_value IS NULL OR n = 0 THEN 'MISSING' WHEN wrong IS NOT NULL THEN 'MISMATCH' ELSE 'MATCH' END AS status, coalesce(hub_value, '') AS hub_value,
  field || ': ' || CASE WHEN hub_value IS NULL THEN {text(E.NO_VALUE)} WHEN n = 0 THEN {text(E.NO_OTHER)} WHEN wrong IS NOT NULL THEN replace({text(E.DIFFERS)}, '{{}}', wrong) ELSE {text(E.AGREES)} END AS message FROM met)"""
SUMMARY = f"CASE status {' '.join(f'WHEN {text(a)} THEN {text(b)}' for a, b in E.SUMMARIES.items())} END"


def oracle_sql() -> dict[str, str]:
    return {
        "label_values": f"WITH {LABELS} SELECT case_id, seg, doc_type, field, value FROM found",
        "label_papers": f"WITH {LABELS}, kept AS (SELECT case_id, seg, count(*) AS n, string_agg(field || '=' || value, chr(10) ORDER BY field) AS fields FROM found WHERE lower(file) LIKE '%.txt' GROUP BY 1, 2) SELECT case_id, seg, k AS kind, file AS source, coalesce(n, 0) AS n_fields, coalesce(fields, '') AS fields, {ERROR} AS error FROM tidy LEFT JOIN kept USING (case_id, seg)",
        "booking_compare": f"WITH {RESULTS} SELECT case_id, field, status, hub_value, message FROM results",
        "booking_report": f"WITH {RESULTS}, told AS (SELECT p.case_id, CASE WHEN count(r.status) = 0 THEN 'HIGH_RISK' WHEN bool_or(r.status = 'MISMATCH') THEN 'MISMATCH' WHEN bool_or(r.status = 'MISSING') THEN 'MISSING' ELSE 'MATCH' END AS status, string_agg(message, chr(10) ORDER BY place) FILTER (WHERE r.status <> 'MATCH') AS w FROM (SELECT DISTINCT case_id FROM papers) p LEFT JOIN results r USING (case_id) GROUP BY 1) SELECT case_id, status, {SUMMARY} AS summary, CASE WHEN status = 'HIGH_RISK' THEN {text(E.NO_HUB)} ELSE coalesce(w, '') END AS warnings FROM told",
    }
