"""The reference answers as DuckDB SQL, one statement per registered query.

`FRAGMENTS` holds common table expressions with the fragments they need; `build`
puts the needed ones in order in front of a final SELECT.  Literals are written
with an exponent so that DuckDB reads them as doubles.
"""

from __future__ import annotations

FRAGMENTS: dict[str, tuple[list[str], str]] = {}
HEADS: dict[str, str] = {}  # recursive fragments: the part in front of AS


def fragment(name: str, needs: list[str], sql: str) -> None:
    FRAGMENTS[name] = (needs, sql)


def build(needs: list[str], select: str) -> str:
    order: list[str] = []

    def visit(n: str) -> None:
        for d in FRAGMENTS[n][0]:
            visit(d)
        if n not in order:
            order.append(n)

    for n in needs:
        visit(n)
    ctes = ",\n".join(f"{HEADS.get(n, n)} AS ({FRAGMENTS[n][1]})" for n in order)
    head = "WITH RECURSIVE " if any(n in HEADS for n in order) else "WITH "
    return f"{head}{ctes}\n{select}" if ctes else select


def half_up(x: str, d: int = 0) -> str:
    if d == 0:
        return f"floor(({x}) + 0.5e0)"
    return f"(floor(({x}) * 1e{d} + 0.5e0) / 1e{d})"


def case(x: str, table: dict, default: str = "NULL", text: bool = False) -> str:
    q = (lambda v: f"'{v}'") if text else (lambda v: f"{float(v)!r}e0")
    return f"CASE {x} " + " ".join(f"WHEN '{k}' THEN {q(v)}" for k, v in table.items()) + f" ELSE {default} END"


def choose(x: str, values: list) -> str:
    return f"CASE {x} " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values) if v is not None) + " END"


def among(x: str, values: list[str]) -> str:
    return f"coalesce({x} IN ({', '.join(repr(v) for v in values)}), false)"


def haversine(a: str, b: str, c: str, d: str) -> str:
    """Metres between (lng a, lat b) and (lng c, lat d)."""
    return (f"(12742017.6e0 * asin(least(1e0, sqrt(power(sin((radians({d}) - radians({b})) / 2), 2) + cos(radians({b})) * "
            f"cos(radians({d})) * power(sin(radians(({c}) - ({a})) / 2), 2)))))")


# --- domain tables ----------------------------------------------------------
TAG_COLUMNS = {
    "highway": "CASE WHEN sz % 17 = 0 THEN 'steps' WHEN b = 25 THEN 'trunk' WHEN p_type IN ('STANDARD','MEDIUM') THEN 'footway' "
               "WHEN p_type = 'PROMO' THEN 'residential' WHEN p_type = 'SMALL' THEN 'path' "
               "WHEN p_type = 'LARGE' THEN 'pedestrian' ELSE 'service' END",
    "footway": "CASE WHEN p_type IN ('STANDARD','MEDIUM') AND sz % 17 <> 0 AND b <> 25 THEN "
               "CASE sz % 4 WHEN 0 THEN 'sidewalk' WHEN 1 THEN 'crossing' END END",
    "surface": "CASE WHEN b <= 5 THEN 'asphalt' WHEN b <= 8 THEN 'paving_stones' WHEN b <= 11 THEN 'gravel' "
               "WHEN b <= 13 THEN 'cobblestone' WHEN b = 14 THEN 'Concrete' END",
    "smoothness": choose("sz % 10", [None, "bad", "good", "intermediate", "very_bad"]),
    "width": choose("b % 6", ["0.8", "1.1 m", "150 cm", "5 ft", "wide"]),
    "est_width": "CASE WHEN sz % 8 = 0 THEN '1.0' END",
    "kerb": choose("(b + sz) % 7", ["lowered", "raised", "flush", "no"]),
    "kerb_height": choose("(b + sz) % 9", ["3 cm", "0.12"]),
    "incline": choose("sz % 12", ["10%", "-6%", "3°", "up", "7"]),
    "tactile_paving": choose("b % 8", ["yes", "no"]),
    "wheelchair": choose("(sz + b + d) % 13", ["no", "yes", "limited"]),
    "crossing": "CASE WHEN p_type IN ('STANDARD','MEDIUM') AND sz % 17 <> 0 AND b <> 25 AND sz % 4 = 1 THEN "
                + choose("b % 3", ["zebra", "traffic_signals", "unmarked"]) + " END",
    "ramp": "CASE WHEN sz % 19 = 0 THEN 'yes' END",
    "ramp_wheelchair": "CASE WHEN sz = 34 THEN 'yes' END",
    "barrier": "CASE WHEN b = 7 THEN 'bollard' WHEN b = 17 AND d = 1 THEN 'gate' WHEN b = 19 AND sz > 40 THEN 'fence' END",
    "sidewalk": "CASE WHEN p_type = 'PROMO' THEN " + choose("b % 4", ["no", "both", "left"]) + " END",
    "sidewalk_left": "CASE WHEN p_type = 'ECONOMY' THEN " + choose("b % 5", ["no", "yes", "separate"]) + " END",
    "sidewalk_right": "CASE WHEN p_type = 'ECONOMY' THEN " + choose("b % 5", ["no", None, "separate"]) + " END",
    "foot": "CASE WHEN b = 23 THEN 'no' END",
    "access": "CASE WHEN b = 22 THEN 'private' END",
    "service": "CASE WHEN p_type = 'ECONOMY' AND sz % 3 = 0 THEN 'driveway' END",
}
TAG_SQL = ", ".join(f"{v} AS t_{k}" for k, v in TAG_COLUMNS.items())
KIND_SQL = ("CASE WHEN t_highway = 'steps' THEN 'steps' WHEN t_highway = 'pedestrian' THEN 'pedestrian_street' "
            "WHEN t_highway = 'footway' AND t_footway = 'crossing' THEN 'crossing' "
            "WHEN t_highway = 'footway' AND t_footway = 'sidewalk' THEN 'sidewalk' "
            "WHEN t_highway = 'footway' THEN 'footway' WHEN t_highway = 'path' THEN 'path' ELSE 'road_walkable' END")

fragment("part_k", [], """
SELECT p_partkey AS k, p_partkey % 40 AS x, p_partkey // 40 AS y, p_size AS sz, p_type,
       CAST(substr(p_brand, 7) AS INT) AS b, p_name, (SELECT max(p_partkey) FROM part) AS last_key FROM part""")
fragment("seg0", ["part_k"], f"""
SELECT *, {KIND_SQL} AS kind FROM (
SELECT *, 'r' || ((k // 400) % 5) AS region_id, 'w' || k || CASE d WHEN 0 THEN 'E' ELSE 'N' END AS segment_id,
       x + (1 - d) AS x2, y + d AS y2, 'n' || k AS from_node, 'n' || (k + CASE d WHEN 0 THEN 1 ELSE 40 END) AS to_node,
       CAST(sz + 20 + d * 7 AS DOUBLE) AS length_m,
       CASE WHEN sz % 5 <> 0 THEN TIMESTAMP '1997-01-01' + to_days(CAST(sz * 37 + b * 11 AS INT)) END AS osm_ts,
       p_name AS street_name,
       CASE WHEN sz % 2 = 0 THEN translate(p_name, 'abdegiklmnoprstuvxz', 'αβδεγικλμνοπρστυβξζ') END AS street_name_el,
       sz % 23 = 0 AS has_manual, CASE b % 3 WHEN 0 THEN 'confirmed' WHEN 1 THEN 'corrected' ELSE 'needs_inspection' END AS m_result,
       CASE WHEN b % 3 = 0 THEN 'accessible' WHEN b % 3 = 1 THEN CASE b % 4 WHEN 0 THEN 'accessible' WHEN 1 THEN 'partial'
            WHEN 2 THEN 'inaccessible' ELSE 'unverified' END END AS m_status,
       {TAG_SQL}
FROM (SELECT *, 0 AS d FROM part_k WHERE x < 39 UNION ALL SELECT *, 1 AS d FROM part_k WHERE k + 40 <= last_key))""")
fragment("seg", ["seg0"], """
SELECT *, 32.4e0 + x * 0.0004e0 AS lng1, 34.75e0 + y * 0.0004e0 AS lat1, 32.4e0 + x2 * 0.0004e0 AS lng2,
       34.75e0 + y2 * 0.0004e0 AS lat2, 32.4e0 + ((x + x2) / 2e0) * 0.0004e0 AS clng, 34.75e0 + ((y + y2) / 2e0) * 0.0004e0 AS clat
FROM seg0""")
fragment("obs", [], f"""
SELECT *, CASE WHEN s % 4 = 0 THEN [own, other] ELSE [own] END AS segment_ids FROM (
SELECT concat_ws('-', 'o', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS observation_id,
       concat_ws('-', 'img', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS source_id,
       'w' || k || CASE o % 2 WHEN 0 THEN 'E' ELSE 'N' END AS own, 'w' || k || CASE o % 2 WHEN 0 THEN 'N' ELSE 'E' END AS other,
       s, k, 'r' || ((k // 400) % 5) AS region_id,
       CASE WHEN l_linestatus = 'F' AND s % 10 = 0 THEN 'citizen' ELSE 'mapillary' END AS source_type,
       CASE l_returnflag WHEN 'R' THEN 'good' WHEN 'A' THEN 'medium' ELSE 'poor' END AS quality,
       {choose('ln', [None, 'yes', 'yes', 'yes', 'no', 'not_visible', 'unknown', 'yes'])} AS pedestrian_path_visible,
       {choose('q % 4', ['clear', 'restricted', 'blocked', 'unknown'])} AS pedestrian_path_condition,
       {choose('s % 4', ['yes', 'no', 'not_visible', 'unknown'])} AS curb_ramp_visible,
       {choose('s % 3', ['usable', 'damaged', 'unknown'])} AS curb_ramp_condition,
       CASE WHEN disc = 10 THEN 'yes' WHEN disc <= 3 THEN 'no' ELSE 'unknown' END AS stairs_visible,
       {choose('o % 6', ['paved', 'paving_stones', 'gravel', 'dirt', 'other', 'unknown'])} AS surface_type,
       {choose('tax % 4', ['good', 'uneven', 'damaged', 'unknown'])} AS surface_condition,
       CASE WHEN (k + ln) % 5 = 0 THEN 'no' ELSE 'yes' END AS obstacle_visible,
       {choose('(k + ln) % 5', ['none', 'minor', 'moderate', 'blocking', 'unknown'])} AS obstacle_severity,
       CASE WHEN (k + ln) % 5 = 3 THEN 'parked scooter' ELSE '' END AS description,
       CASE WHEN s % 5 < 3 THEN 'yes' ELSE 'not_visible' END AS crossing_visible,
       CASE s % 5 WHEN 0 THEN ['marked_crossing', 'tactile_paving'] WHEN 1 THEN ['dropped_kerb'] WHEN 2 THEN ['traffic_signals']
            ELSE CAST([] AS VARCHAR[]) END AS features,
       {choose('(q + s) % 4', ['clear', 'restricted', 'blocked', 'unknown'])} AS clear_passage_classification,
       list_filter([CASE WHEN ln = 7 THEN 'low light' END, CASE WHEN q > 45 THEN 'glare' END,
                    CASE WHEN disc = 0 THEN 'partly hidden' END], lambda u: u IS NOT NULL) AS uncertain,
       CASE WHEN q <> 1 THEN l_shipdate END AS captured_at, l_shipdate + to_days(30) AS analysed_at,
       CASE q WHEN 13 THEN 'failed' WHEN 14 THEN 'superseded' ELSE 'active' END AS status
FROM (SELECT *, CAST(floor(l_quantity) AS BIGINT) q, CAST(floor(l_discount * 100 + 0.5e0) AS BIGINT) disc,
             CAST(floor(l_tax * 100 + 0.5e0) AS BIGINT) tax, l_orderkey o, l_linenumber ln, l_suppkey s, l_partkey k FROM lineitem))""")
fragment("images", [], """
SELECT concat_ws('-', 'img', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS image_id, 'r' || ((k // 400) % 5) AS region_id,
       (32.4e0 + (k % 40) * 0.0004e0) + (q % 10) * 0.00004e0 AS lng,
       (34.75e0 + (k // 40) * 0.0004e0) + ((disc % 7) - 3) * 0.00004e0 + (q % 3) * 0.000007e0 AS lat,
       CASE WHEN q <> 1 THEN l_shipdate END AS captured_at,
       CASE WHEN q % 9 <> 0 THEN CAST((q * 7) % 360 AS DOUBLE) END AS compass_angle, s % 20 = 0 AS is_pano,
       CASE WHEN tax <> 0 THEN disc / 10e0 END AS quality_score, CASE WHEN s % 11 <> 0 THEN 'seq' || s END AS sequence_id
FROM (SELECT *, CAST(floor(l_quantity) AS BIGINT) q, CAST(floor(l_discount * 100 + 0.5e0) AS BIGINT) disc,
             CAST(floor(l_tax * 100 + 0.5e0) AS BIGINT) tax, l_suppkey s, l_partkey k FROM lineitem)""")
CATEGORIES = ["broken_pavement", "missing_curb_ramp", "steps", "blocked_sidewalk", "narrow_passage",
              "surface_problem", "crossing_problem", "temporary_obstruction", "other"]
fragment("reports", [], f"""
SELECT 'rep' || e AS report_id, 'r' || ((k // 400) % 5) AS region_id,
       {choose("CASE WHEN event_type = 'view' THEN cents % 9 ELSE e % 9 END", CATEGORIES)} AS category, props AS description,
       (32.4e0 + (k % 40) * 0.0004e0) + (cents % 10) * 0.00004e0 AS lng, (34.75e0 + (k // 40) * 0.0004e0) + (cents % 37) * 0.00001e0 AS lat,
       'w' || k || CASE e % 3 WHEN 0 THEN 'N' ELSE 'E' END AS segment_id, e % 4 = 0 AS has_photo,
       CASE WHEN e % 4 = 0 THEN 'reports/' || e || '.jpg' END AS photo_path, 'u' || user_id AS reporter_uid,
       {choose('e % 7', ['pending', 'pending', 'needs_review', 'verified', 'verified', 'rejected', 'resolved'])} AS status,
       CASE WHEN e % 50 <> 0 THEN ts END AS created_at, CASE WHEN e % 7 IN (3, 4) THEN ts + to_days(2) END AS verified_at,
       CASE WHEN e % 7 >= 3 THEN ts + to_days(2) END AS reviewed_at, CASE WHEN e % 7 = 5 THEN ts + to_days(30) END AS photo_delete_after,
       CASE WHEN e % 7 = 4 THEN 'works' END AS assigned_to
FROM (SELECT *, event_id e, CAST(floor(value * 100 + 0.5e0) AS BIGINT) cents,
             event_id % (SELECT max(p_partkey) + 1 FROM part) AS k FROM events)""")
fragment("pois", [], f"""
SELECT 'poi' || s_suppkey AS poi_id, 'r' || ((k // 400) % 5) AS region_id, s_name AS name,
       {choose('s_nationkey % 15', ["hospital", "clinic", "doctors", "pharmacy", "school", "kindergarten", "university", "townhall",
               "government", "social_facility", "bus_station", "bus_stop", "post_office", "library", "community_centre"])} AS class,
       (32.4e0 + (k % 40) * 0.0004e0) + 0.0001e0 AS lng, (34.75e0 + (k // 40) * 0.0004e0) + 0.00005e0 AS lat
FROM (SELECT *, s_suppkey * 20 + s_nationkey AS k FROM supplier)""")
fragment("calls", [], """
SELECT event_id AS call_id, ts, 'img' || user_id AS source_id, 'job' || (event_id // 100) AS job_id,
       CASE event_type WHEN 'error' THEN 'failed' WHEN 'view' THEN 'cached' ELSE 'ok' END AS outcome FROM events""")
fragment("requests", [], """
SELECT 'req' || k AS request_id, 'r' || ((k // 400) % 5) AS region_id, 'n' || k AS origin_node, 'n' || goal AS goal_node,
       CASE c_mktsegment WHEN 'BUILDING' THEN 'wheelchair' WHEN 'FURNITURE' THEN 'reduced_mobility'
            WHEN 'MACHINERY' THEN 'stroller' ELSE 'balanced' END AS profile, c_acctbal > 5000 AS prefer_verified,
       (32.4e0 + x * 0.0004e0) + 0.00011e0 AS olng, (34.75e0 + y * 0.0004e0) + 0.00003e0 AS olat,
       (32.4e0 + x2 * 0.0004e0) - 0.00007e0 AS dlng, (34.75e0 + (y + dy) * 0.0004e0) + 0.00002e0 AS dlat
FROM (SELECT *, (y + dy) * 40 + x2 AS goal FROM (
  SELECT *, CASE WHEN x + dx < 40 THEN x + dx ELSE x - dx END AS x2 FROM (
    SELECT *, c_custkey AS k, c_custkey % 40 AS x, c_custkey // 40 AS y, c_nationkey % 4 + 1 AS dx, c_custkey % 3 AS dy FROM customer)))
WHERE goal IN (SELECT p_partkey FROM part)""")

# --- tag evidence -----------------------------------------------------------
fragment("typed", ["seg"], r"""
SELECT *, CASE coalesce(t_width, t_est_width) WHEN '0.8' THEN 0.8e0 WHEN '1.1 m' THEN 1.1e0 WHEN '150 cm' THEN 150e0 / 100
            WHEN '5 ft' THEN 5e0 * 0.3048e0 WHEN '1.0' THEN 1e0 END AS w,
       CASE t_kerb_height WHEN '3 cm' THEN 3e0 / 100 WHEN '0.12' THEN 0.12e0 END AS kh,
       CASE t_incline WHEN '10%' THEN 10e0 WHEN '-6%' THEN 6e0 WHEN '3°' THEN abs(tan(radians(3e0)) * 100) WHEN '7' THEN 7e0 END AS inc,
       kind = 'steps' AS is_steps, coalesce(t_ramp_wheelchair = 'yes', false) AS rw, coalesce(t_ramp = 'yes', false) AS rp,
       kind = 'crossing' AS is_cross, lower(t_surface) AS sf,
       kind = 'road_walkable' AND coalesce(t_sidewalk, t_sidewalk_left, t_sidewalk_right) IS NOT NULL AS road,
       coalesce(t_sidewalk = 'no', false) OR (coalesce(t_sidewalk_left = 'no', false) AND coalesce(t_sidewalk_right = 'no', false)) AS none_side,
       coalesce(t_sidewalk IN ('both', 'left'), false) OR coalesce(t_sidewalk_left = 'yes', false) AS some_side
FROM seg""")


def ev(cond: str, id_: str, weight: str = "1e0", ord_: int = 0) -> str:
    return f"CASE WHEN {cond} THEN {{'ord': {ord_}, 'id': '{id_}', 'src': 'osm', 'w': {weight}}} END"


TAG_B = [
    ("is_steps", "steps", "1e0"), ("t_wheelchair = 'no'", "wheelchair_tagged_no", "1e0"),
    ("t_wheelchair = 'limited'", "restricted_passage", "0.7e0"), ("sf IN ('gravel', 'cobblestone')", "unsuitable_surface", "1e0"),
    ("sf = 'paving_stones'", "uneven_surface", "0.5e0"),
    ("t_smoothness IN ('bad', 'very_bad')", "damaged_surface", "CASE t_smoothness WHEN 'bad' THEN 0.7e0 ELSE 1e0 END"),
    ("t_smoothness = 'intermediate'", "uneven_surface", "0.5e0"), ("w < 1.2e0", "narrow_width", "CASE WHEN w < 0.9e0 THEN 1e0 ELSE 0.5e0 END"),
    ("t_kerb = 'raised'", "high_kerb", "1e0"), ("kh > 0.06e0", "high_kerb", "1e0"), ("inc > 8", "steep_incline", "1e0"),
    ("inc > 5 AND inc <= 8", "moderate_incline", "1e0"), ("is_cross AND t_kerb = 'raised'", "crossing_without_ramp", "1e0"),
    ("t_barrier = 'fence'", "blocking_obstacle", "1e0"), ("t_barrier IN ('bollard', 'gate')", "restricted_passage", "0.8e0"),
    ("road AND none_side", "no_pedestrian_path", "1e0"),
]
TAG_P = [
    ("is_steps AND rw", "ramp_present", "1e0"), ("t_wheelchair = 'yes'", "wheelchair_tagged_yes", "1e0"),
    ("sf IN ('asphalt', 'concrete')", "good_paved_surface", "1e0"), ("t_smoothness = 'good'", "good_paved_surface", "1e0"),
    ("w >= 1.5e0", "adequate_width", "1e0"), ("t_kerb IN ('flush', 'no')", "flush_kerb", "1e0"), ("t_kerb = 'lowered'", "curb_ramp", "1e0"),
    ("kh <= 0.06e0", "flush_kerb", "1e0"), ("t_tactile_paving = 'yes'", "tactile_paving", "1e0"),
    ("is_cross AND t_crossing IN ('zebra', 'traffic_signals')", "accessible_crossing", "1e0"),
    ("is_cross AND coalesce(t_kerb <> 'raised', true) AND (coalesce(t_kerb IN ('lowered', 'flush'), false) OR coalesce(kh <= 0.06e0, false))", "curb_ramp", "1e0"),
    ("rp OR rw", "ramp_present", "1e0"), ("road AND NOT none_side AND some_side", "clear_path", "1e0"),
]
KNOWN = [
    ("highway=steps", "is_steps", 0.45), ("ramp:wheelchair", "is_steps AND rw", 0.1), ("wheelchair", "t_wheelchair IS NOT NULL", 0.3),
    ("surface", "sf IS NOT NULL", 0.2), ("smoothness", "t_smoothness IS NOT NULL", 0.18), ("width", "w IS NOT NULL", 0.12),
    ("kerb", "t_kerb IS NOT NULL", 0.22), ("kerb:height", "kh IS NOT NULL", 0.12), ("incline", "inc IS NOT NULL", 0.14),
    ("tactile_paving", "t_tactile_paving IS NOT NULL", 0.08), ("crossing", "is_cross", 0.1), ("ramp", "rp OR rw", 0.08),
    ("barrier", "t_barrier IS NOT NULL", 0.12), ("sidewalk", "road", 0.16),
]
_list = lambda rows: "list_filter([" + ", ".join(ev(c, i, w, n) for n, (c, i, w) in enumerate(rows)) + "], lambda e: e IS NOT NULL)"
fragment("tagev", ["typed"], f"""
SELECT *, {_list(TAG_B)} AS tag_b, {_list(TAG_P)} AS tag_p,
       least(1e0, 0e0 + {' + '.join(f"CASE WHEN {c} THEN {p}e0 ELSE 0e0 END" for _, c, p in KNOWN)}) AS info,
       list_filter([{', '.join(f"CASE WHEN {c} THEN '{n}' END" for n, c, _ in KNOWN)}], lambda e: e IS NOT NULL) AS known_tags,
       list_filter([CASE WHEN is_steps AND NOT rw THEN 'steps' END, CASE WHEN t_wheelchair = 'no' THEN 'wheelchair_tagged_no' END],
                   lambda e: e IS NOT NULL) AS hard_blocks,
       (is_steps AND NOT rw) OR t_wheelchair IS NOT NULL AS decisive
FROM typed""")

# --- observations -----------------------------------------------------------
fragment("linked", ["obs"], """
SELECT *, row_number() OVER (PARTITION BY segment_id ORDER BY captured_at DESC NULLS LAST, observation_id) AS rn
FROM (SELECT *, unnest(segment_ids) AS segment_id FROM obs WHERE status = 'active')""")
fragment("near", ["linked"], """
SELECT *, NOT ((pedestrian_path_visible NOT IN ('unknown', 'not_visible')) OR pedestrian_path_condition <> 'unknown'
      OR curb_ramp_visible NOT IN ('unknown', 'not_visible') OR stairs_visible <> 'unknown' OR surface_type <> 'unknown'
      OR surface_condition <> 'unknown' OR obstacle_visible <> 'unknown' OR obstacle_severity <> 'unknown'
      OR crossing_visible NOT IN ('unknown', 'not_visible') OR clear_passage_classification <> 'unknown' OR len(features) > 0) AS empty
FROM linked""")
WORST = {
    "pedestrian_path_visible": ["no", "yes"], "pedestrian_path_condition": ["blocked", "restricted", "clear"],
    "curb_ramp_visible": ["no", "yes"], "stairs_visible": ["yes", "no"],
    "surface_type": ["dirt", "gravel", "other", "paving_stones", "paved"], "surface_condition": ["damaged", "uneven", "good"],
    "obstacle_severity": ["blocking", "moderate", "minor", "none"],
    "clear_passage_classification": ["blocked", "restricted", "clear"], "curb_ramp_condition": ["damaged", "usable"],
}
DOTTED = {k: k.replace("_visible", ".visible").replace("_condition", ".condition").replace("surface_type", "surface.type")
          .replace("_severity", ".severity").replace("_classification", ".classification") for k in WORST}
fragment("cells", ["near"], "\nUNION ALL\n".join(
    f"SELECT segment_id, '{DOTTED[p]}' AS path, {p} AS value, list_position({vs!r}, {p}) AS worst FROM near WHERE {p} NOT IN ('unknown', 'not_visible')"
    for p, vs in WORST.items()))
fragment("ranked", ["cells"], """
SELECT *, row_number() OVER (PARTITION BY segment_id, path ORDER BY support DESC, worst) AS rank,
       sum(support) OVER (PARTITION BY segment_id, path) AS informative,
       count(*) OVER (PARTITION BY segment_id, path, support) AS same FROM (
SELECT segment_id, path, value, worst, count(*) AS support FROM cells GROUP BY ALL)""")
fragment("votes", ["ranked"], """
SELECT segment_id, path, value, support, CAST(informative AS BIGINT) AS informative, support / informative AS agreement, same > 1 AS tie
FROM ranked WHERE rank = 1""")
fragment("agree", ["votes", "near"], """
SELECT s.segment_id, coalesce(a.total / a.n, 1e0) AS agreement, CASE WHEN a.n > 0 THEN 1e0 - a.total / a.n ELSE 0e0 END AS conflict,
       coalesce(a.contested, CAST([] AS VARCHAR[])) AS contested
FROM (SELECT DISTINCT segment_id FROM near) s LEFT JOIN (
  SELECT segment_id, list_sum(list(agreement ORDER BY list_position(['pedestrian_path.visible', 'pedestrian_path.condition', 'curb_ramp.visible',
           'stairs.visible', 'surface.type', 'surface.condition', 'obstacle.severity', 'clear_passage.classification'], path))) AS total,
         count(*) AS n, list(path ORDER BY path) FILTER (agreement < 1) AS contested
  FROM votes WHERE informative >= 2 AND path <> 'curb_ramp.condition' GROUP BY 1) a USING (segment_id)""")
fragment("summary", ["near"], """
SELECT segment_id, count(*) AS observation_count, count(*) FILTER (NOT empty) AS informative_count,
       count(*) FILTER (source_type = 'mapillary') AS n_map, count(*) FILTER (source_type = 'citizen') AS n_cit,
       CASE WHEN count(DISTINCT source_type) = 1 THEN min(source_type) ELSE 'visual' END AS label,
       max(coalesce(captured_at, analysed_at)) AS last_observed_at, list(quality ORDER BY rn) FILTER (rn <= 3) AS qualities,
       count(*) FILTER (list_contains(features, 'tactile_paving')) AS f_tactile, count(*) FILTER (list_contains(features, 'dropped_kerb')) AS f_kerb,
       count(*) FILTER (list_contains(features, 'traffic_signals') OR list_contains(features, 'marked_crossing')) AS f_cross
FROM near GROUP BY 1""")
fragment("wide", ["votes", "summary", "agree"], f"""
SELECT s.*, a.agreement, a.conflict, a.contested, {', '.join(f"v.{k}" for k in WORST)}
FROM summary s JOIN agree a USING (segment_id) LEFT JOIN (SELECT segment_id, {', '.join(
    f"max(CASE WHEN path = '{DOTTED[k]}' THEN {{'v': value, 'w': CASE informative WHEN 1 THEN 0.6e0 ELSE agreement END}} END) AS {k}" for k in WORST)}
FROM votes GROUP BY 1) v USING (segment_id)""")


def vev(cond: str, id_: str, w: str, n: int) -> str:
    return f"CASE WHEN {cond} THEN {{'ord': {n}, 'id': '{id_}', 'src': label, 'w': {w}}} END"


_ped, _cond, _rv, _rc = "pedestrian_path_visible", "pedestrian_path_condition", "curb_ramp_visible", "curb_ramp_condition"
_sev, _pass = "obstacle_severity", "clear_passage_classification"
_dmg = f"{_rv}.v = 'yes' AND coalesce({_rc}.v = 'damaged', false)"
VIS_B = [
    (f"{_ped}.v = 'no'", "no_pedestrian_path", f"{_ped}.w"), (f"{_cond}.v = 'blocked'", "blocking_obstacle", f"{_cond}.w"),
    (f"{_cond}.v = 'restricted'", "restricted_passage", f"{_cond}.w"), (f"{_rv}.v = 'no'", "missing_curb_ramp", f"{_rv}.w"),
    (_dmg, "missing_curb_ramp", f"{_rc}.w * 0.6e0"), ("stairs_visible.v = 'yes'", "steps", "stairs_visible.w"),
    ("surface_condition.v = 'damaged'", "damaged_surface", "surface_condition.w"),
    ("surface_condition.v = 'uneven'", "uneven_surface", "surface_condition.w"),
    ("surface_type.v IN ('gravel', 'dirt')", "unsuitable_surface", "surface_type.w"), (f"{_sev}.v = 'blocking'", "blocking_obstacle", f"{_sev}.w"),
    (f"{_sev}.v = 'moderate'", "restricted_passage", f"{_sev}.w"),
    (f"{_pass}.v = 'blocked' AND coalesce({_sev}.v <> 'blocking', true)", "blocking_obstacle", f"{_pass}.w"),
    (f"{_pass}.v = 'restricted' AND coalesce({_sev}.v NOT IN ('moderate', 'blocking'), true)", "restricted_passage", f"{_pass}.w"),
]
_fw = "CASE informative_count WHEN 0 THEN 0e0 WHEN 1 THEN 0.6e0 ELSE 1e0 END"
VIS_P = [
    (f"{_cond}.v = 'clear' AND {_ped}.v = 'yes'", "clear_path", f"{_cond}.w"), (f"{_rv}.v = 'yes' AND NOT ({_dmg})", "curb_ramp", f"{_rv}.w"),
    ("surface_condition.v = 'good' AND surface_type.v IN ('paved', 'paving_stones')", "good_paved_surface", "surface_condition.w"),
    ("f_tactile > 0", "tactile_paving", _fw), ("f_kerb > 0", "curb_ramp", _fw), ("f_cross > 0", "accessible_crossing", _fw),
]
_vlist = lambda rows: "list_filter([" + ", ".join(vev(c, i, w, 100 + n) for n, (c, i, w) in enumerate(rows)) + "], lambda e: e IS NOT NULL)"
fragment("visual", ["wide"], f"SELECT *, {_vlist(VIS_B)} AS vis_b, {_vlist(VIS_P)} AS vis_p FROM wide")

# --- assessment -------------------------------------------------------------
BARRIER_OF = {"broken_pavement": "damaged_surface", "missing_curb_ramp": "missing_curb_ramp", "steps": "steps",
              "blocked_sidewalk": "blocking_obstacle", "narrow_passage": "narrow_width", "surface_problem": "unsuitable_surface",
              "crossing_problem": "crossing_without_ramp", "temporary_obstruction": "blocking_obstacle"}
fragment("repseg", ["reports"], f"""
SELECT segment_id, count(*) AS n_rep, max(verified_at) AS last_report_at,
       list(DISTINCT {case('category', BARRIER_OF, text=True)}) FILTER (category <> 'other') AS rep_ids
FROM reports WHERE status = 'verified' GROUP BY 1""")
fragment("inputs", ["tagev", "visual", "repseg"], """
SELECT t.*, coalesce(v.observation_count, 0) AS observation_count, coalesce(v.informative_count, 0) AS informative_count,
       coalesce(v.agreement, 1e0) AS agreement, coalesce(v.conflict, 0e0) AS conflict, v.qualities, coalesce(v.n_map, 0) AS n_map,
       coalesce(v.n_cit, 0) AS n_cit, coalesce(r.n_rep, 0) AS n_rep, v.last_observed_at, r.last_report_at, coalesce(v.contested, []) AS contested,
       coalesce(vis_b, []) AS vb, coalesce(vis_p, []) AS vp, coalesce(rep_ids, []) AS rep_ids
FROM tagev t LEFT JOIN visual v USING (segment_id) LEFT JOIN repseg r USING (segment_id)""")
fragment("items", ["inputs"], """
SELECT segment_id, 'b' AS side, unnest(tag_b, recursive := true) FROM inputs
UNION ALL SELECT segment_id, 'b', unnest(vb, recursive := true) FROM inputs
UNION ALL SELECT segment_id, 'b', 200, unnest(rep_ids), 'citizen', 0.85e0 FROM inputs
UNION ALL SELECT segment_id, 'p', unnest(tag_p, recursive := true) FROM inputs
UNION ALL SELECT segment_id, 'p', unnest(vp, recursive := true) FROM inputs
UNION ALL SELECT segment_id, 'p', 200, 'manually_verified', 'manual', 1e0 FROM inputs WHERE has_manual AND m_status = 'accessible'""")
fragment("folded", ["items"], """
SELECT segment_id, side, id, first_ord, list_reduce(l, lambda acc, e: {'w': least(1e0, greatest(acc.w, e.w)
         + CASE WHEN len(list_distinct(list_concat(acc.s, e.s))) > 1 THEN 0.15e0 ELSE 0e0 END), 's': list_distinct(list_concat(acc.s, e.s))}) AS f
FROM (SELECT segment_id, side, id, min(ord) AS first_ord, list({'w': w, 's': [src]} ORDER BY ord) AS l FROM items GROUP BY ALL)""")
PAIRS = [("missing_curb_ramp", "curb_ramp"), ("high_kerb", "flush_kerb"), ("narrow_width", "adequate_width"),
         ("no_pedestrian_path", "clear_path"), ("damaged_surface", "good_paved_surface"), ("unsuitable_surface", "good_paved_surface"),
         ("uneven_surface", "good_paved_surface"), ("blocking_obstacle", "clear_path"), ("crossing_without_ramp", "curb_ramp"),
         ("wheelchair_tagged_no", "wheelchair_tagged_yes")]
PEN = {"steps": 45, "wheelchair_tagged_no": 35, "no_pedestrian_path": 30, "missing_curb_ramp": 25, "crossing_without_ramp": 22,
       "high_kerb": 20, "damaged_surface": 20, "blocking_obstacle": 20, "steep_incline": 20, "unsuitable_surface": 18,
       "restricted_passage": 15, "narrow_width": 15, "moderate_incline": 10, "uneven_surface": 10}
POS = {"wheelchair_tagged_yes": 10, "manually_verified": 10, "curb_ramp": 8, "flush_kerb": 8, "clear_path": 6, "good_paved_surface": 6,
       "accessible_crossing": 5, "ramp_present": 5, "tactile_paving": 4, "adequate_width": 4}
CEIL = {"wheelchair_tagged_no": 12, "steps": 18, "blocking_obstacle": 42, "no_pedestrian_path": 52, "missing_curb_ramp": 62,
        "crossing_without_ramp": 62, "steep_incline": 62, "high_kerb": 64, "narrow_width": 66, "damaged_surface": 70,
        "unsuitable_surface": 72, "restricted_passage": 74}
fragment("w0", ["folded"], "SELECT segment_id, " + ", ".join(
    [f"max(f.w) FILTER (side = 'b' AND id = '{i}') AS b_{i}" for i in PEN] + [f"max(f.w) FILTER (side = 'p' AND id = '{i}') AS p_{i}" for i in POS])
    + " FROM folded GROUP BY 1")
for _n, (_b, _p) in enumerate(PAIRS):
    fragment(f"w{_n + 1}", [f"w{_n}"], f"SELECT * REPLACE (CASE WHEN b_{_b} >= p_{_p} THEN NULL ELSE p_{_p} END AS p_{_p}, "
             f"CASE WHEN b_{_b} < p_{_p} THEN NULL ELSE b_{_b} END AS b_{_b}) FROM w{_n}")
fragment("weights", ["w10"], "SELECT *, " + " + ".join(
    f"coalesce(floor({half_up(f'{v}e0 * b_{i}', 1)} * 10 + 0.5e0), 0e0)" for i, v in PEN.items()) + " AS pen10, " + " + ".join(
    f"coalesce(floor({half_up(f'{v}e0 * p_{i}', 1)} * 10 + 0.5e0), 0e0)" for i, v in POS.items()) + " AS pos10, least(100e0, "
    + ", ".join(f"coalesce(100e0 - {100 - v}e0 * b_{i}, 100e0)" for i, v in CEIL.items()) + ") AS top FROM w10")
fragment("scored", ["inputs", "weights"], f"""
SELECT *, CASE WHEN has_evidence THEN CAST(greatest(0e0, least(100e0, {half_up('least(raw0, top0)')})) AS INT) END AS score,
       CASE WHEN has_evidence THEN CAST(raw0 AS INT) END AS raw_score FROM (
SELECT *, greatest(0e0, least(100e0, {half_up('100e0 - total_penalty + least(total_bonus, 20e0)')})) AS raw0 FROM (
SELECT i.*, w.* EXCLUDE (segment_id), coalesce(pen10, 0e0) / 10e0 AS total_penalty, coalesce(pos10, 0e0) / 10e0 AS total_bonus,
       coalesce(top, 100e0) AS top0,
       w.segment_id IS NOT NULL OR info > 0 OR informative_count > 0 OR has_manual AS has_evidence,
       greatest(last_observed_at, last_report_at, CASE WHEN info > 0 THEN osm_ts END) AS last_evidence_at,
       CASE WHEN has_manual THEN TIMESTAMP '2001-06-01' END AS last_verified_at
FROM inputs i LEFT JOIN weights w USING (segment_id)))""")
fragment("fresh", ["scored"], f"""
SELECT *, CASE WHEN ref IS NULL THEN 'none' WHEN days <= 365 THEN 'recent' WHEN days <= 1095 THEN 'aging' ELSE 'stale' END AS freshness_state,
       CAST({half_up('days')} AS INT) AS age_days, last_verified_at IS NOT NULL AND (last_evidence_at IS NULL OR last_verified_at >= last_evidence_at) AS fver
FROM (SELECT *, greatest(last_evidence_at, last_verified_at) AS ref,
        CASE WHEN greatest(last_evidence_at, last_verified_at) IS NOT NULL THEN greatest(0e0,
          (epoch_us(TIMESTAMP '2001-12-01') - epoch_us(greatest(last_evidence_at, last_verified_at))) / 86400000000e0) END AS days FROM scored)""")
_q = lambda n: f"coalesce({case(f'qualities[{n}]', {'good': 17, 'medium': 11, 'poor': 4})}, 0e0)"
fragment("conf", ["fresh"], f"""
SELECT *, CAST({half_up("CASE WHEN has_manual THEN greatest(floored, 85e0) ELSE floored END")} AS INT) AS confidence FROM (
SELECT *, CASE WHEN decisive THEN greatest(least(100e0, greatest(0e0, aged)), 70e0) ELSE least(100e0, greatest(0e0, aged)) END AS floored FROM (
SELECT *, (c_tags + c_images + c_agree + c_conflict + c_reports)
          * CASE freshness_state WHEN 'recent' THEN 1e0 WHEN 'aging' THEN 0.9e0 WHEN 'stale' THEN 0.75e0 ELSE 0.6e0 END AS aged FROM (
SELECT *, {half_up('65e0 * info', 1)} AS c_tags, {half_up(' + '.join(_q(n) for n in (1, 2, 3)), 1)} AS c_images,
       CASE WHEN informative_count >= 2 THEN {half_up('15e0 * agreement', 1)} ELSE 0e0 END AS c_agree,
       CASE WHEN informative_count >= 2 THEN -{half_up('20e0 * conflict', 1)} ELSE 0e0 END AS c_conflict,
       least(n_rep * 6e0, 12e0) AS c_reports FROM fresh)))""")
_fold_ids = lambda side, table: "array_to_string(list_sort(list_filter([" + ", ".join(
    f"CASE WHEN {side}_{i} IS NOT NULL THEN '{i}' END" for i in table) + "], lambda z: z IS NOT NULL)), ',')"
fragment("assess", ["conf"], f"""
SELECT *, CASE WHEN overridden THEN m_status WHEN NOT has_evidence OR score IS NULL OR confidence < 45 THEN 'unverified'
            WHEN score >= 80 THEN 'accessible' WHEN score >= 50 THEN 'partial' ELSE 'inaccessible' END AS status,
       CASE WHEN overridden THEN 'manual_override' WHEN NOT has_evidence OR score IS NULL THEN 'no_evidence'
            WHEN confidence < 45 THEN 'insufficient_evidence' ELSE 'score_band' END AS reason,
       {_fold_ids('b', PEN)} AS barriers, {_fold_ids('p', POS)} AS positives,
       list_filter([{', '.join(f"CASE WHEN b_{i} IS NOT NULL THEN '{i}' END" for i in PEN)}], lambda z: z IS NOT NULL) AS barrier_list,
       array_to_string(list_filter(['osm', CASE WHEN n_map > 0 THEN 'mapillary' END, CASE WHEN n_cit > 0 OR n_rep > 0 THEN 'citizen' END,
                        CASE WHEN has_manual THEN 'manual' END], lambda z: z IS NOT NULL), ',') AS sources
FROM (SELECT *, has_manual AND m_result = 'corrected' AND m_status IS NOT NULL AS overridden FROM conf)""")

ORACLES: dict[str, str] = {}


def oracle(name: str, needs: list[str], select: str) -> None:
    ORACLES[name] = build(needs, select)
