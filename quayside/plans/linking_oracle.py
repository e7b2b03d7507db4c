"""DuckDB SQL of the linking queries: every two papers of a folder, without blocks."""

from __future__ import annotations

from quayside.operators import guards, keys, resolve, shipments
from quayside.plans.more_oracle import hint, listed
from quayside.plans import oracle
from quayside.plans.oracle import repaired, similar, text
from quayside.sources import intake_folders

NUMBERS = ("invoice_no", "bl_no", "booking_no", "shipping_order_no")
WEIGHT = " ".join(f"WHEN '{k}' THEN {w}" for k, w in resolve.WEIGHTS.items())


def matcher(v: str) -> str:
    for a, b in (("[ \\t]+", " "), ("\\s*/\\s*", "/"), ("\\s*-\\s*", "-")):
        v = f"regexp_replace({v if v.startswith('regexp') else f'translate({v}, {text(chr(0x3000) + chr(0xFF1A) + chr(0xFF0D) + chr(0x2013) + chr(0x2014))}, {text(" :---")})'}, '{a}', '{b}', 'g')"
    return f"upper({v})"


def first(pattern: str) -> str:
    return f"list_filter(list_transform(regexp_extract_all(t, {text(pattern)}, 1), lambda v: trim(v)), lambda v: v NOT IN {listed(keys.STOP)})[1]"


def digits(v: str) -> str:
    return f"regexp_replace(translate({v}, '?OILSG', '701158'), '[^0-9]', '', 'g')"


def split(pattern: str) -> str:
    p = text(pattern)
    parts = f"list_zip(regexp_extract_all(t, {p}, 1), regexp_extract_all(t, {p}, 2), regexp_extract_all(t, {p}, 3))"
    return f"list_filter(list_transform({parts}, lambda x: CASE WHEN length({digits('x[2] || x[3]')}) >= 7 THEN x[1] || right({digits('x[2] || x[3]')}, 7) END), lambda x: x IS NOT NULL)[1]"


def suffix(v: str) -> str:
    only = f"regexp_replace({repaired(v)}, '[^0-9]', '', 'g')"
    return f"CASE WHEN length({only}) >= 7 THEN right({only}, 7) END"


def valid(k: str, v: str) -> str:
    own = "true"
    if k in NUMBERS:
        own = f"length({v}) >= 4 AND NOT regexp_full_match({v}, '[A-Z]+')"
    elif k == "container_no":
        own = f"length({v}) >= 8 AND regexp_matches({v}, '[0-9]')"
    elif k == "container_suffix":
        own = f"length({v}) >= 6 AND regexp_full_match({v}, '[0-9]+')"
    elif k == "vessel_voyage":
        own = f"length({v}) >= 6 AND {v} NOT IN {listed(guards.GENERIC_VESSELS)}"
    return f"CASE WHEN {v} <> '' AND {v} NOT IN {listed(guards.GENERIC)} AND {own} THEN {v} END"


def normal(k: str) -> str:
    bare = f"regexp_replace({matcher(k)}, '[^A-Z0-9/.\\-]', '', 'g')"
    return f"CASE WHEN {bare} = '' THEN '' ELSE {repaired(bare)} END" if k in keys.REPAIRED else bare


def alias(k: str) -> str:
    return "replace(replace(replace(replace(vessel_voyage, 'VOYAGE', 'VOY'), 'VOY.', 'VOY'), 'V.', 'VOY'), 'VSL', 'VESSEL')" if k == "vessel_voyage" else k


KEYED = f"""{intake_folders.SQL},
said AS (SELECT batch, paper, doc_type, file, customer, {matcher("text")} AS t FROM intake),
shown AS (SELECT * EXCLUDE (t), {", ".join(f"{first(p)} AS {k}" for k, p in keys.PATTERNS.items())}, coalesce({", ".join(map(split, keys.SPLIT_CONTAINERS))}) AS split,
  right(list_filter(list_transform(regexp_extract_all(t, '{keys.SUFFIX}', 1), lambda v: {digits("v")}), lambda v: length(v) >= 6)[1], 7) AS said_suffix FROM said),
boxed AS (SELECT * REPLACE (coalesce(container_no, split) AS container_no), nullif(customer, '') AS consignee FROM shown),
whole AS (SELECT *, coalesce({suffix("container_no")}, CASE WHEN split IS NULL THEN said_suffix END) AS container_suffix FROM boxed),
bare AS (SELECT batch, paper, doc_type, file, {", ".join(f"{normal(k)} AS {k}" for k in (*keys.PATTERNS, "container_suffix", "consignee"))} FROM whole),
fixed AS (SELECT batch, paper, doc_type, file, {", ".join(f"{alias(k)} AS {k}" for k in (*keys.PATTERNS, "container_suffix", "consignee"))} FROM bare),
keyed AS (SELECT batch, paper, doc_type, file, {", ".join(f"{valid(k, k)} AS {k}" for k in (*keys.PATTERNS, "container_suffix", "consignee"))} FROM fixed)"""
HELD = (*keys.PATTERNS, "container_suffix", "consignee")
LONG = KEYED + ",\nlong AS (" + " UNION ALL ".join(f"SELECT batch, paper, '{k}' AS key, {k} AS value FROM keyed WHERE {k} IS NOT NULL" for k in HELD) + ")"
PAIRS = f"""{KEYED},
hinted AS (SELECT *, {hint("regexp_replace(file, '[.][^.]*$', '')")} AS hint FROM keyed),
pairs AS (SELECT a.batch, a.paper AS i, b.paper AS j, a.doc_type AS ta, b.doc_type AS tb, a.file = b.file AS one_file, a.hint AS ha, b.hint AS hb,
  {", ".join(f"CASE WHEN a.{k} IS NOT NULL AND b.{k} IS NOT NULL THEN {similar(f'a.{k}', f'b.{k}')} END AS {k}" for k in HELD)}
  FROM hinted a JOIN hinted b ON a.batch = b.batch AND a.paper < b.paper)"""


def least(names: tuple[str, ...], x: float) -> str:
    return "(" + " OR ".join(f"coalesce({k} >= {x}, false)" for k in names if k in HELD) + ")"


def below(names: tuple[str, ...], x: float) -> str:
    return "(" + " OR ".join(f"coalesce({k} < {x}, false)" for k in names if k in HELD) + ")"


def score(k: str) -> str:
    w = resolve.WEIGHTS[k]
    partial = f" WHEN {k} >= 0.72 THEN {w} * 0.72" if k in resolve.PARTIAL else ""
    return f"CASE WHEN {k} >= 1 THEN {w} WHEN {k} >= 0.88 THEN {w} * 0.92{partial} ELSE 0 END"


def reason(k: str) -> str:
    partial = f" WHEN {k} >= 0.72 THEN '{k}: partial'" if k in resolve.PARTIAL else ""
    return f"CASE WHEN {k} >= 1 THEN '{k}: exact' WHEN {k} >= 0.88 THEN '{k}: OCR-normalized'{partial} END"


ORDERED = tuple(k for k in resolve.WEIGHTS if k in HELD)
DECIDED = f"""{PAIRS},
guarded AS (SELECT *, NOT one_file AND ha <> '' AND hb <> '' AND ha <> hb AS source,
  {below(NUMBERS, 0.72)} OR ({below(("container_no",), 0.72)} AND NOT {least(("container_suffix",), 0.92)}) OR {below(("consignee",), 0.58)} AS mixed,
  greatest({", ".join(map(score, ORDERED))}) AS keyscore FROM pairs),
filed AS (SELECT *, one_file AND keyscore < 0.68 AS by_file, CASE WHEN one_file AND keyscore < 0.68 THEN 0.68 ELSE keyscore END AS s1,
  ((ta IN {listed(guards.BRIDGE)} AND tb IN {listed(guards.CORE)}) OR (tb IN {listed(guards.BRIDGE)} AND ta IN {listed(guards.CORE)})) AND ({least(("booking_no", "bl_no", "invoice_no", "container_no"), 0.72)} OR {least(("container_suffix",), 0.92)}
    OR ({least(("vessel_voyage",), 0.78)} AND ({least(("consignee",), 0.62)} OR {least(("eta", "date"), 0.86)} OR (ha <> '' AND ha = hb)))) AS bridge,
  ta IN {listed(guards.USEFUL)} AND tb IN {listed(guards.USEFUL)} AND ta <> tb AND ({least(guards.SOFT, 0.72)} OR ({" AND ".join(f"{k} IS NULL" for k in guards.CONTEXT if k in HELD)})) AS completes FROM guarded),
decided AS (SELECT batch, i, j, source OR mixed AS refused, CASE WHEN source OR mixed THEN 0 WHEN s1 < 0.6 AND bridge THEN 0.64 WHEN s1 < 0.6 AND completes THEN 0.62 ELSE s1 END AS score,
  CASE WHEN source THEN ['source anti-mix guard'] WHEN mixed THEN ['anti-mix guard'] ELSE list_filter([{", ".join(map(reason, ORDERED))}, CASE WHEN by_file THEN 'same source file' END,
    CASE WHEN s1 < 0.6 AND bridge THEN 'shipment bridge candidate' END, CASE WHEN s1 < 0.6 AND NOT bridge AND completes THEN 'customs document set candidate' END], lambda x: x IS NOT NULL) END AS reasons FROM filed)"""
REACH = """
reach AS (SELECT batch, paper AS a, paper AS b FROM keyed UNION SELECT r.batch, r.a, e.b FROM reach r JOIN both_ways e ON r.batch = e.batch AND r.b = e.a),
heads AS (SELECT batch, a AS paper, min(b) AS head FROM reach GROUP BY 1, 2)"""
BOTH = "both_ways AS (SELECT batch, i AS a, j AS b FROM decided WHERE score >= 0.6 UNION ALL SELECT batch, j, i FROM decided WHERE score >= 0.6)"


def labelled(pick: str, prefix: str) -> str:
    of = ", ".join(f"{pick}({k}, paper) FILTER (WHERE {k} IS NOT NULL)" for k in resolve.CASE_KEYS)
    return f"coalesce({of}, '{prefix}' || upper(left(sha1(string_agg(file, '|' ORDER BY paper)), 8)))"


DESCRIBED = f"""
told AS (SELECT h.batch, h.head, max(score) AS score, list_slice(list_distinct_in_order(flatten(list(reasons ORDER BY i, j))), 1, {shipments.SHOWN}) AS reasons
  FROM decided d JOIN heads h ON d.batch = h.batch AND d.i = h.paper JOIN heads g ON d.batch = g.batch AND d.j = g.paper AND g.head = h.head GROUP BY 1, 2)""".replace(
    "list_distinct_in_order(flatten(list(reasons ORDER BY i, j)))", "list_reduce(list_prepend([''], list_transform(flatten(list(reasons ORDER BY i, j)), lambda x: [x])), lambda acc, x: CASE WHEN list_contains(acc, x[1]) THEN acc ELSE acc || x END)[2:]"
)
SURE = "CASE WHEN count(*) <= 1 AND {s} <= 0 THEN 'pending_review' WHEN {s} >= 0.95 THEN 'exact_match' WHEN {s} >= 0.8 THEN 'high_confidence' WHEN {s} >= 0.6 THEN 'partial_match' WHEN {s} > 0 THEN 'low_confidence' ELSE 'pending_review' END".format(s="coalesce(any_value(score), 0)")
CASES = f"""SELECT k.batch, {labelled("max_by", "CASE-")} AS case_id, count(*) AS n_papers, string_agg(k.paper::VARCHAR, ',' ORDER BY k.paper) AS papers, CAST(coalesce(any_value(score), 0) AS DECIMAL(9,4)) AS score, {SURE} AS confidence, coalesce(array_to_string(any_value(reasons), '; '), '') AS reasons
FROM keyed k JOIN heads USING (batch, paper) LEFT JOIN told USING (batch, head) GROUP BY k.batch, head"""
#: Each folder's links in the order of their scores; a link joins two groups unless a refused pair stands between them.
APART = """
places AS (SELECT batch, paper, row_number() OVER (PARTITION BY batch ORDER BY paper) AS place FROM keyed),
local AS (SELECT d.batch, refused, score, a.place AS i, b.place AS j FROM decided d JOIN places a ON d.batch = a.batch AND d.i = a.paper JOIN places b ON d.batch = b.batch AND d.j = b.paper),
links AS (SELECT batch, list(struct_pack(i := i, j := j) ORDER BY score DESC, i, j) AS e, count(*) AS n FROM local WHERE score >= 0.6 GROUP BY 1),
walls AS (SELECT batch, list(struct_pack(i := i, j := j)) AS w FROM local WHERE refused GROUP BY 1),
start AS (SELECT batch, list(place ORDER BY place) AS heads, list(paper ORDER BY place) AS p FROM places GROUP BY 1),
fold AS (
  SELECT batch, 1 AS k, heads FROM start
  UNION ALL
  SELECT f.batch, f.k + 1, CASE WHEN x = y OR len(list_filter(coalesce(w, []), lambda v: (heads[v.i] = x AND heads[v.j] = y) OR (heads[v.i] = y AND heads[v.j] = x))) > 0 THEN heads
    ELSE list_transform(heads, lambda h: CASE WHEN h = greatest(x, y) THEN least(x, y) ELSE h END) END
  FROM (SELECT f.*, CASE WHEN heads[e[k].i] <> heads[e[k].j] THEN w END AS w, heads[e[k].i] AS x, heads[e[k].j] AS y FROM fold f JOIN links USING (batch) LEFT JOIN walls USING (batch) WHERE k <= n) f),
ends AS (SELECT batch, max_by(heads, k) AS heads FROM fold GROUP BY 1),
heads AS (SELECT batch, unnest(p) AS paper, unnest(list_transform(e.heads, lambda h: p[h])) AS head FROM ends e JOIN start USING (batch))"""
INTAKE = f"""{PAIRS},
best AS (SELECT *, greatest({", ".join(f"coalesce({k}, 0)" for k in shipments.GROUPING)}) AS s FROM pairs),
decided AS (SELECT batch, i, j, CASE WHEN s >= 0.88 THEN 0.9 WHEN s >= 0.72 THEN 0.65 ELSE 0 END AS score, CASE WHEN s >= 0.72 THEN [CASE {" ".join(f"WHEN {k} = s THEN '{k}'" for k in shipments.GROUPING)} END] ELSE [] END AS reasons FROM best)"""
SHIPMENTS = f"""folder AS (SELECT batch, bool_and(head = paper) AND {" AND ".join(f"count(DISTINCT {k}) <= 1" for k in shipments.GROUPING)} AND {" AND ".join(f"count_if(doc_type = '{t}') <= 1" for t in shipments.SIGNALS)} AS single, min(paper) AS least FROM keyed JOIN heads USING (batch, paper) GROUP BY 1),
headed AS (SELECT k.*, CASE WHEN single THEN least ELSE head END AS head, single FROM keyed k JOIN heads USING (batch, paper) JOIN folder USING (batch)),
told AS (SELECT h.batch, h.head, max(score) AS score, list(DISTINCT reasons[1]) AS reasons FROM decided d JOIN heads h ON d.batch = h.batch AND d.i = h.paper WHERE score >= 0.6 GROUP BY 1, 2)
SELECT batch, {labelled("min_by", "SHIPMENT-")} AS shipment_id, count(*) AS n_papers, CASE WHEN any_value(single) OR count(*) <= 1 THEN 'pending_review' WHEN any_value(score) >= 0.88 THEN 'high_confidence' WHEN any_value(score) >= 0.6 THEN 'partial_match' ELSE 'pending_review' END AS confidence,
  CASE WHEN any_value(single) THEN '{shipments.SINGLE}' ELSE coalesce(array_to_string(list_sort(any_value(reasons)), '; '), '') END AS reasons FROM headed LEFT JOIN told USING (batch, head) GROUP BY batch, head"""


def oracle_sql() -> dict[str, str]:
    scored = f"CASE WHEN s >= 1 THEN w WHEN s >= 0.88 THEN w * 0.92 WHEN s >= 0.72 AND key IN {listed(resolve.PARTIAL)} THEN w * 0.72 ELSE 0 END"
    return {
        "match_keys": f"WITH {LONG} SELECT batch, paper, key, value FROM long",
        "folder_pair_scores": f"""WITH {LONG}, v AS (SELECT DISTINCT batch, key, value FROM long), p AS (SELECT a.batch, a.key, a.value AS a, b.value AS b, {similar("a.value", "b.value")} AS s, CASE a.key {WEIGHT} END AS w FROM v a JOIN v b ON a.batch = b.batch AND a.key = b.key AND a.value < b.value),
t AS (SELECT *, {scored} AS score FROM p WHERE s >= 0.72)
SELECT batch, key, a, b, CAST(s AS DECIMAL(9,4)) AS similarity, CAST(score AS DECIMAL(9,4)) AS score, CASE WHEN score >= 0.95 THEN 'exact_match' WHEN score >= 0.8 THEN 'high_confidence' WHEN score >= 0.6 THEN 'partial_match' WHEN score > 0 THEN 'low_confidence' ELSE 'pending_review' END AS label FROM t""",
        "case_groups": f"WITH RECURSIVE {DECIDED},\n{BOTH},{REACH},{DESCRIBED}\n{CASES}",
        "case_groups_apart": f"WITH RECURSIVE {DECIDED},{APART},{DESCRIBED}\nSELECT batch, case_id, n_papers, papers, confidence FROM ({CASES})",
        "rates_as_of": """WITH cases AS (SELECT o_orderkey AS case_id, 'freight:' || c_nationkey AS ref, CAST(o_orderdate AS DATE) AS date FROM orders JOIN customer ON o_custkey = c_custkey),
versions AS (SELECT ref, make_date(year(date), 7, 1) AS valid_from, CAST(count(*) % 7 AS VARCHAR) AS multiplier FROM cases GROUP BY 1, 2)
SELECT case_id, c.ref, CAST(valid_from AS VARCHAR) AS valid_from, multiplier FROM cases c ASOF LEFT JOIN versions v ON c.ref = v.ref AND c.date >= v.valid_from""",
        "feedback_latest": f"""WITH {oracle.FEEDBACK}, late AS (SELECT * FROM log ORDER BY ts DESC, id DESC LIMIT 100), e AS (SELECT error_type, count(*) AS n, max(struct_pack(ts := ts, id := id)) AS latest FROM late WHERE NOT is_correct GROUP BY 1)
SELECT count(*) AS total, CAST(count_if(is_correct) AS BIGINT) AS n_correct, CAST(count_if(NOT is_correct) AS BIGINT) AS n_issues, (SELECT coalesce(string_agg(error_type || ':' || n, ',' ORDER BY n DESC, latest DESC), '') FROM e) AS errors FROM late""",
        "listing_stream": oracle.oracle_sql()["snapshot_diff"],
        "shipment_groups": f"WITH RECURSIVE {INTAKE},\n{BOTH},{REACH},\n{SHIPMENTS}",
    }
