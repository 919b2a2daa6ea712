"""SQL for the routing, priority, coverage, validation, search and publication queries."""

import oracles_places as OP
from footscape import params as P
from oracles import HEADS, half_up, haversine, fragment, oracle

TXT = OP.TXT
CODES = {"w": "wheelchair", "r": "reduced_mobility", "s": "stroller", "b": "balanced"}

# --- edges and costs ----------------------------------------------------------
fragment("edge0", ["assess"], """SELECT segment_id, region_id, from_node AS src, to_node AS dst, false AS rev, length_m, status, score, confidence, freshness_state,
  list_distinct(list_concat(CASE WHEN has_evidence THEN barrier_list ELSE [] END, hard_blocks)) AS blocks, street_name, lng1 AS a, lat1 AS b, lng2 AS c, lat2 AS d FROM assess""")
fragment("edge", ["edge0"], """SELECT * FROM edge0 UNION ALL SELECT segment_id, region_id, dst, src, true, length_m, status, score, confidence, freshness_state, blocks, street_name, c, d, a, b FROM edge0""")
_vals = lambda rows: "VALUES " + ", ".join(rows)
fragment("mult", [], "SELECT * FROM (" + _vals([f"('{p}', '{s}', {m if m is not None else 'NULL'}::DOUBLE)" for p in P.PROFILES for s, m in P.STATUS_MULTIPLIER[p].items()]) + ") t(profile, status, m)")
fragment("bmet", [], "SELECT * FROM (" + _vals([f"('{p}', '{b}', {m})" for p in P.PROFILES for b, m in P.BARRIER_METRES[p].items()]) + ") t(profile, barrier, metres)")
fragment("prof", [], "SELECT * FROM (" + _vals([f"('{p}', {pv}, {P.UNKNOWN_RATE[p]}::DOUBLE, {P.STALE_RATE[p]}::DOUBLE)" for p in P.PROFILES for pv in ("false", "true")]) + ") t(profile, pv, ur, sr)")
PRICED = """
SELECT e.*, p.profile, p.pv, list_concat(CASE WHEN p.profile = 'wheelchair' THEN list_filter(blocks, lambda z: z IN ('steps', 'wheelchair_tagged_no')) ELSE [] END,
         CASE WHEN m.m IS NULL THEN ['status:' || e.status] ELSE [] END) AS blocked_by,
       length_m * m.m + coalesce(bm.metres, 0) + CASE WHEN e.status = 'unverified' THEN length_m * (p.ur * CASE WHEN pv THEN 2 ELSE 1 END) ELSE 0 END
       + length_m * p.sr * CASE freshness_state WHEN 'stale' THEN 1e0 WHEN 'none' THEN 1.3e0 ELSE 0e0 END AS cost
FROM {edge} e CROSS JOIN prof p JOIN mult m ON m.profile = p.profile AND m.status = e.status
LEFT JOIN (SELECT segment_id, rev, profile, CAST(sum(metres) AS DOUBLE) AS metres FROM (SELECT segment_id, rev, unnest(blocks) AS barrier FROM {edge}) JOIN bmet USING (barrier) GROUP BY ALL) bm
  ON bm.segment_id = e.segment_id AND bm.rev = e.rev AND bm.profile = p.profile
UNION ALL SELECT e.*, '__shortest__', false, [], length_m FROM {edge} e"""
fragment("priced", ["edge", "mult", "bmet", "prof"], PRICED.replace("{edge}", "edge"))
oracle("edge_costs", ["priced"], f"""SELECT segment_id, profile, pv AS prefer_verified, len(blocked_by) > 0 AS forbidden, CASE WHEN len(blocked_by) = 0 THEN {half_up('cost', 2)} END AS cost,
  {TXT('blocked_by')} AS blocked_by FROM priced WHERE NOT rev""")
fragment("search", ["requests"], """SELECT request_id || '|recommended' AS search_id, request_id, 'recommended' AS variant, region_id, origin_node AS start, goal_node AS goal, profile, prefer_verified AS pv, NULL::VARCHAR AS without FROM requests
  UNION ALL SELECT request_id || '|balanced', request_id, 'balanced', region_id, origin_node, goal_node, 'balanced', false, NULL FROM requests
  UNION ALL SELECT request_id || '|shortest', request_id, 'shortest', region_id, origin_node, goal_node, '__shortest__', false, NULL FROM requests""")
fragment("dsearch", ["assess"], """SELECT segment_id AS search_id, region_id, from_node AS start, to_node AS goal, 'wheelchair' AS profile, false AS pv, segment_id AS without
  FROM assess WHERE status = 'inaccessible' OR (status = 'partial' AND barriers <> '')""")


def paths(name: str, source: str, overlay: str = "") -> None:
    """Cheapest label (cost, length, edges, last edge) per search and node, and the path it points back along. `overlay`: edges of single searches."""
    HEADS[name] = f"{name}(search_id, node, b, goal) USING KEY (search_id, node)"
    fragment(f"{name}_e", ["priced"], "SELECT region_id, profile, pv, src, dst, segment_id, length_m, cost, CASE WHEN rev THEN '-' ELSE '' END || segment_id AS leg FROM priced WHERE len(blocked_by) = 0")
    more = [overlay] if overlay else []
    own = f" UNION ALL SELECT d.search_id, e.dst, d.b, e.cost, e.length_m, e.leg, d.goal, d.node FROM {name} d JOIN {overlay} e ON e.search_id = d.search_id AND e.src = d.node" if overlay else ""
    fragment(name, [source, f"{name}_e", *more], f"""
SELECT search_id, start, {{'cost': 0e0, 'len': 0e0, 'hops': 0, 'leg': ''}}, goal FROM {source}
UNION (SELECT n.search_id, n.dst, min(n.nb), any_value(n.goal) FROM (
   SELECT d.search_id, d.dst, {{'cost': d.b.cost + d.cost, 'len': d.b.len + d.length_m, 'hops': d.b.hops + 1, 'leg': d.leg}} AS nb, d.goal
   FROM (SELECT d.search_id, e.dst, d.b, e.cost, e.length_m, e.leg, d.goal, d.node FROM {name} d JOIN {source} s USING (search_id)
         JOIN {name}_e e ON e.region_id = s.region_id AND e.profile = s.profile AND e.pv = s.pv AND e.src = d.node WHERE s.without IS NULL OR e.segment_id <> s.without{own}) d
   LEFT JOIN recurring.{name} g ON g.search_id = d.search_id AND g.node = d.goal
   WHERE d.node <> d.goal AND (g.b IS NULL OR d.b.cost + d.cost <= g.b.cost)) n
 LEFT JOIN recurring.{name} r ON r.search_id = n.search_id AND r.node = n.dst
 WHERE r.b IS NULL OR n.nb < r.b GROUP BY 1, 2)""")
    HEADS[f"{name}_b"] = f"{name}_b(search_id, node, path)"
    ends = f"SELECT DISTINCT leg, src FROM {name}_e" + (f" UNION SELECT leg, src FROM {overlay}" if overlay else "")
    fragment(f"{name}_b", [name, f"{name}_e", *more], f"""SELECT search_id, node, []::VARCHAR[] FROM {name} WHERE node = goal
UNION ALL SELECT x.search_id, e.src, list_prepend(p.b.leg, x.path) FROM {name}_b x JOIN {name} p ON p.search_id = x.search_id AND p.node = x.node AND p.b.leg <> ''
JOIN ({ends}) e ON e.leg = p.b.leg""")
    fragment(f"{name}_p", [f"{name}_b"], f"SELECT search_id, arg_max(path, len(path)) AS path FROM {name}_b GROUP BY 1")


paths("sp", "search")
paths("dp", "dsearch")
fragment("routed", ["search", "sp", "sp_p"], "SELECT s.*, p.b IS NOT NULL AS found, p.b.cost AS cost, p.b.len AS length_m, q.path FROM search s LEFT JOIN sp p ON p.search_id = s.search_id AND p.node = s.goal LEFT JOIN sp_p q ON q.search_id = s.search_id")
oracle("least_cost_paths", ["routed"], f"""SELECT search_id, found, {half_up('cost', 2)} AS cost, {half_up('length_m', 1)} AS length_m, CASE WHEN NOT found THEN 'no_path' END AS reason FROM routed""")

# --- routes between points: each request's halves of its snapped edges are an overlay of its own -----------------
fragment("prequests", ["requests"], """SELECT request_id, region_id, profile, prefer_verified, olat, olng + CASE WHEN k % 29 = 0 THEN 0.5e0 ELSE 0e0 END AS olng,
  CASE WHEN k % 11 = 0 THEN olng + 0.0001e0 ELSE dlng + CASE WHEN k % 31 = 0 THEN 0.5e0 ELSE 0e0 END END AS dlng, CASE WHEN k % 11 = 0 THEN olat ELSE dlat END AS dlat
  FROM (SELECT *, CAST(substr(request_id, 4) AS BIGINT) AS k FROM requests)""")
fragment("pendpoint", ["prequests"], "SELECT request_id || '|o' AS pid, request_id, region_id AS preg, 'origin' AS side, olng AS lng, olat AS lat FROM prequests UNION ALL SELECT request_id || '|d', request_id, region_id, 'destination', dlng, dlat FROM prequests")
fragment("psnapc", ["pendpoint", "seg"], OP.near_pairs("pendpoint", "pid", 250, "p.request_id, p.side, p.preg, s.region_id,"))
fragment("psnap", ["psnapc"], """SELECT request_id, side, '@' || request_id || '|' || side AS v, n.s, n.t, n.a + (n.c - n.a) * n.t AS fx, n.b + (n.d - n.b) * n.t AS fy FROM (
  SELECT request_id, side, arg_min({'s': segment_id, 'a': lng1, 'b': lat1, 'c': lng2, 'd': lat2, 't': tt}, {'d': dist, 's': segment_id}) AS n FROM psnapc WHERE dist <= 250 AND preg = region_id GROUP BY 1, 2)""")
fragment("pboth", ["psnap"], "SELECT o.request_id, o.s AS os, d.s AS ds, o.v AS ov, d.v AS dv, o.t <= d.t AS fwd, o.fx, o.fy, d.fx AS gx, d.fy AS gy FROM psnap o JOIN psnap d ON o.request_id = d.request_id AND o.side = 'origin' AND d.side = 'destination'")
_keep = "e.region_id, {src} AS src, {dst} AS dst, false AS rev, status, score, confidence, freshness_state, blocks, street_name, {line}"
_x = lambda tag, src, dst, line: "SELECT x.request_id, e.segment_id || " + tag + " AS segment_id, " + _keep.format(src=src, dst=dst, line=line)
fragment("xhalf", ["psnap", "pboth", "edge0"], " UNION ALL ".join([
    _x("'#a@' || x.request_id || '|' || side", "e.src", "v", "a, b, fx AS c, fy AS d") + " FROM psnap x JOIN edge0 e ON e.segment_id = x.s",
    _x("'#b@' || x.request_id || '|' || side", "v", "e.dst", "fx, fy, c, d") + " FROM psnap x JOIN edge0 e ON e.segment_id = x.s",
    _x("'#direct@' || x.request_id", "CASE WHEN fwd THEN ov ELSE dv END", "CASE WHEN fwd THEN dv ELSE ov END", "CASE WHEN fwd THEN fx ELSE gx END, CASE WHEN fwd THEN fy ELSE gy END, CASE WHEN fwd THEN gx ELSE fx END, CASE WHEN fwd THEN gy ELSE fy END")
    + " FROM pboth x JOIN edge0 e ON e.segment_id = x.os WHERE os = ds"]))
fragment("xedge0", ["xhalf"], f"SELECT segment_id, region_id, src, dst, rev, {haversine('a', 'b', 'c', 'd')} AS length_m, status, score, confidence, freshness_state, blocks, street_name, a, b, c, d, request_id FROM xhalf")
fragment("xedge", ["xedge0"], "SELECT * FROM xedge0 UNION ALL SELECT segment_id, region_id, dst, src, true, length_m, status, score, confidence, freshness_state, blocks, street_name, c, d, a, b, request_id FROM xedge0")
fragment("xpriced", ["xedge", "mult", "bmet", "prof"], PRICED.replace("{edge}", "xedge"))
_variants = " UNION ALL ".join(f"SELECT request_id || '|{v}' AS search_id, request_id, '{v}' AS variant, region_id, {{ends}}, {p} AS profile, {pv} AS pv, NULL::VARCHAR AS without FROM {{source}}"
                               for v, p, pv in (("recommended", "profile", "prefer_verified"), ("balanced", "'balanced'", "false"), ("shortest", "'__shortest__'", "false")))
fragment("psearch", ["prequests", "pboth"], _variants.format(ends="ov AS start, dv AS goal", source="prequests JOIN pboth USING (request_id)"))
fragment("pp_x", ["psearch", "xpriced"], """SELECT s.search_id, p.src, p.dst, p.length_m, p.cost, CASE WHEN p.rev THEN '-' ELSE '' END || p.segment_id AS leg
  FROM xpriced p JOIN psearch s ON s.request_id = p.request_id AND s.profile = p.profile AND s.pv = p.pv WHERE len(p.blocked_by) = 0""")
paths("pp", "psearch", "pp_x")
fragment("plost", ["prequests", "psnap"], _variants.format(ends="NULL::VARCHAR AS start, NULL::VARCHAR AS goal", source="prequests WHERE request_id NOT IN (SELECT request_id FROM psnap GROUP BY 1 HAVING count(*) = 2)"))
fragment("prouted", ["psearch", "pp", "pp_p", "plost", "psnap"], """SELECT s.*, p.b IS NOT NULL AS found, p.b.cost AS cost, p.b.len AS length_m, q.path, CASE WHEN p.b IS NULL THEN 'no_path' END AS reason
  FROM psearch s LEFT JOIN pp p ON p.search_id = s.search_id AND p.node = s.goal LEFT JOIN pp_p q ON q.search_id = s.search_id
UNION ALL SELECT *, false, NULL, NULL, NULL, CASE WHEN request_id IN (SELECT request_id FROM psnap WHERE side = 'origin') THEN 'destination_off_network' ELSE 'origin_off_network' END FROM plost""")
fragment("leg", ["prouted", "edge", "xedge"], """SELECT r.search_id, r.pos, e.* FROM (SELECT search_id, unnest(path) AS leg, unnest(range(len(path))) AS pos FROM prouted WHERE found) r
  JOIN (SELECT * FROM edge UNION ALL SELECT * EXCLUDE (request_id) FROM xedge) e ON e.segment_id = ltrim(r.leg, '-') AND e.rev = starts_with(r.leg, '-')""")
_sm = ", ".join(f"coalesce(sum(length_m) FILTER (status = '{s}'), 0e0) AS {s}_m" for s in P.STATUSES)
fragment("legsum", ["leg"], f"""SELECT search_id, {_sm}, coalesce(sum(length_m) FILTER (freshness_state IN ('stale', 'none')), 0e0) AS stale_m, sum(length_m) AS total_m,
  coalesce(sum(score * length_m) FILTER (score IS NOT NULL AND status <> 'unverified'), 0e0) AS sw, coalesce(sum(length_m) FILTER (score IS NOT NULL AND status <> 'unverified'), 0e0) AS sm,
  sum(confidence * length_m) AS cw, list_sort(list_distinct(flatten(list(blocks)))) AS blocks FROM leg GROUP BY 1""")
oracle("route_status_metres", ["legsum"], "SELECT search_id, " + ", ".join(f"{half_up(c, 1)} AS {c}" for c in [f"{s}_m" for s in P.STATUSES] + ["stale_m", "total_m"]) + " FROM legsum")
oracle("route_barrier_metres", ["leg"], f"SELECT search_id, barrier, CAST({half_up('sum(length_m)')} AS INT) AS metres FROM (SELECT search_id, length_m, unnest(blocks) AS barrier FROM leg) GROUP BY 1, 2")
SPEED = "CASE profile " + " ".join(f"WHEN '{p}' THEN {v}e0" for p, v in P.SPEED_MPS.items()) + " ELSE 1.2e0 END"
fragment("routesum", ["prouted", "legsum"], f"""
SELECT *, CAST({half_up('total_m')} AS INT) AS distance_m, CAST({half_up(f'total_m / {SPEED}')} AS INT) AS duration_s,
  CASE WHEN sm / total_m >= 0.5e0 AND sm > 0 THEN CAST({half_up('sw / sm')} AS INT) END AS rscore, {half_up('sm / total_m', 3)} AS assessed_share,
  CAST({half_up('cw / total_m')} AS INT) AS rconf, CAST({half_up('unverified_m / total_m * 100')} AS INT) AS unknown_percent, unverified_m / total_m >= 0.4e0 AS high_unknown,
  CAST({half_up('total_m - short_m')} AS INT) AS extra_distance_m, list_filter(short_blocks, lambda z: NOT list_contains(blocks, z)) AS avoided FROM (
SELECT r.*, l.* EXCLUDE (search_id), max(l.total_m) FILTER (variant = 'shortest') OVER w AS short_m, max(l.blocks) FILTER (variant = 'shortest') OVER w AS short_blocks,
  max(r.found) FILTER (variant = 'shortest') OVER w AS short_found, max(r.found) FILTER (variant = 'recommended') OVER w AS rec_found, max(r.path) FILTER (variant = 'recommended') OVER w AS rec_path
FROM prouted r LEFT JOIN legsum l USING (search_id) WINDOW w AS (PARTITION BY request_id))""")
_rs = [("variant = 'shortest'", "shortest_only_distance"), (f"{half_up('accessible_m')} / distance_m >= 0.7e0", "mostly_assessed_accessible"), ("len(avoided) > 0", "barriers_avoided"),
       ("len(blocks) > 0", "barriers_remaining"), ("high_unknown", "high_unknown"), ("NOT high_unknown AND unknown_percent > 0", "some_unknown"), ("extra_distance_m > 20", "extra_distance"),
       ("extra_distance_m <= 20 AND variant <> 'shortest'", "no_extra_distance"), (f"{half_up('stale_m')} > 0", "stale_evidence"), ("pv", "prefer_verified")]
_reasons = "array_to_string(list_filter([" + ", ".join(f"CASE WHEN {c} THEN 'route.reason.{k}' END" for c, k in _rs) + "], lambda z: z IS NOT NULL), ',')"
oracle("planned_routes", ["routesum"], f"""SELECT search_id, found, reason, distance_m, duration_s, rscore AS accessibility_score, CASE WHEN found THEN assessed_share END AS assessed_share, rconf AS evidence_confidence, unknown_percent, high_unknown, extra_distance_m,
  CASE WHEN variant <> 'recommended' THEN path IS NOT DISTINCT FROM rec_path END AS same_as_recommended,
  CASE WHEN NOT rec_found AND short_found THEN 'no_accessible_route' WHEN NOT rec_found THEN 'no_route' WHEN variant = 'recommended' AND high_unknown THEN 'high_unknown_coverage' END AS warning,
  CASE WHEN found THEN {TXT('blocks')} END AS barriers, CASE WHEN found THEN {TXT('avoided')} END AS avoided, CASE WHEN found THEN {_reasons} END AS reasons FROM routesum""")
_bear = OP._bear.format(a="a", b="b", c="c", d="d")
fragment("turned", ["leg"], f"""SELECT *, sum(CASE WHEN move <> 'continue' OR street_name IS DISTINCT FROM prev_name THEN 1 ELSE 0 END) OVER (PARTITION BY search_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS step FROM (
  SELECT *, CASE WHEN pos = 0 THEN 'depart' WHEN abs(turn) >= 110 THEN 'sharp_' || side WHEN abs(turn) >= 35 THEN 'turn_' || side ELSE 'continue' END AS move FROM (
  SELECT *, CASE WHEN turn > 0 THEN 'right' ELSE 'left' END AS side FROM (
  SELECT * REPLACE (CASE WHEN turn >= 180e0 THEN turn - 360e0 ELSE turn END AS turn) FROM (SELECT *, floor((((bear - lag(bear) OVER w + 540) % 360) - 180) * 1e6 + 0.5e0) / 1e6 AS turn, lag(street_name) OVER w AS prev_name FROM (SELECT *, {_bear} AS bear FROM leg) WINDOW w AS (PARTITION BY search_id ORDER BY pos)))))""")
fragment("steps", ["turned"], f"""SELECT search_id, step, arg_min(move, pos) AS manoeuvre, arg_min(street_name, pos) AS street_name, CAST({half_up('sum(length_m)')} AS INT) AS distance_m,
  arg_max(status, CASE status WHEN 'accessible' THEN 0 WHEN 'partial' THEN 1 WHEN 'unverified' THEN 2 ELSE 3 END) AS status, {TXT('list_distinct(flatten(list(blocks)))')} AS barriers FROM turned GROUP BY 1, 2""")
oracle("route_steps", ["steps"], """SELECT search_id, CAST(step AS BIGINT) AS step, manoeuvre, street_name, distance_m, status, barriers FROM steps
  UNION ALL SELECT search_id, CAST(max(step) + 1 AS BIGINT), 'arrive', arg_max(street_name, step), 0, NULL, '' FROM steps GROUP BY 1""")
oracle("route_lines", ["leg"], f"SELECT search_id, count(*) + 1 AS points, {half_up('sum(' + haversine('a', 'b', 'c', 'd') + ')', 1)} AS length_m FROM leg GROUP BY 1")
_t, _d = OP.to_segment("p.lng", "p.lat", "q.a", "q.b", "q.c", "q.d")
_d = _d.replace("p.lng", "lng").replace("p.lat", "lat").replace("q.", "")
oracle("route_progress", ["leg"], f"""SELECT ping_id, min(dist) > 35 AS off_route FROM (SELECT ping_id, {_d} AS dist FROM (SELECT p.*, q.a, q.b, q.c, q.d, {_t} AS tt FROM (
  SELECT search_id, search_id || '|' || pos AS ping_id, a AS lng, b + CASE WHEN pos % 4 = 3 THEN 0.0009e0 ELSE 0.00001e0 END AS lat FROM leg) p JOIN leg q USING (search_id))) GROUP BY 1""")

# --- snapped requests -------------------------------------------------------------
fragment("endpoint", ["requests"], "SELECT request_id || '|o' AS pid, request_id, 'o' AS side, olng AS lng, olat AS lat FROM requests UNION ALL SELECT request_id || '|d', request_id, 'd', dlng, dlat FROM requests")
fragment("snapc", ["endpoint", "seg"], OP.near_pairs("endpoint", "pid", 250, "p.request_id, p.side,"))
fragment("snap1", ["snapc"], "SELECT request_id, side, arg_min({'s': segment_id, 'a': lng1, 'b': lat1, 'c': lng2, 'd': lat2, 't': tt}, {'d': dist, 's': segment_id}) AS n FROM snapc WHERE dist <= 250 GROUP BY 1, 2")
_f = lambda x: (f"({x}.a + ({x}.c - {x}.a) * {x}.t)", f"({x}.b + ({x}.d - {x}.b) * {x}.t)")
_half = lambda x: f"2 * ({haversine(x + '.a', x + '.b', *_f(x))} + {haversine(*_f(x), x + '.c', x + '.d')})"
oracle("snapped_requests", ["snap1"], f"""SELECT o.request_id, CASE WHEN o.n.s = d.n.s THEN 10 ELSE 8 END AS edges, {half_up(_half('o.n') + ' + ' + _half('d.n') + ' + CASE WHEN o.n.s = d.n.s THEN 2 * ' + haversine(*_f('o.n'), *_f('d.n')) + ' ELSE 0e0 END', 1)} AS metres
  FROM snap1 o JOIN snap1 d ON o.request_id = d.request_id AND o.side = 'o' AND d.side = 'd'""")
fragment("detour", ["dsearch", "dp", "assess"], f"""SELECT s.search_id AS segment_id, CAST({half_up('p.b.len')} AS INT) AS detour_m, {half_up('p.b.len / a.length_m', 2)} AS ratio,
  CASE WHEN p.b IS NULL THEN 'no_alternative' END AS reason FROM dsearch s JOIN assess a ON a.segment_id = s.search_id LEFT JOIN dp p ON p.search_id = s.search_id AND p.node = s.goal""")
oracle("detour_ratio", ["detour"], "SELECT * FROM detour")

# --- priority ----------------------------------------------------------------------
fragment("worthy", ["assess"], "SELECT * FROM assess WHERE status = 'inaccessible' OR (status = 'partial' AND barriers <> '')")
oracle("issue_worthy", ["worthy"], "SELECT segment_id, status FROM worthy")


def scored(name: str, needs: list[str], ratio: str, boost: str, joins: str) -> None:
    f = {"sev": "CASE WHEN status = 'unverified' OR score IS NULL THEN 0e0 ELSE (100e0 - score) / 100e0 END",
         "alt": f"CASE WHEN {ratio} IS NULL THEN 1e0 WHEN {ratio} <= 1.05e0 THEN 0e0 ELSE least(1e0, {ratio} - 1) END",
         "poi": "1e0 - exp(-coalesce(poi_sum, 0e0) / 1.5e0)",
         "saf": "CASE WHEN safety AND kind IN ('crossing', 'road_walkable') THEN 1e0 WHEN safety THEN 0.6e0 WHEN kind = 'crossing' THEN 0.35e0 ELSE 0e0 END",
         "rep": "least(1e0, n_rep / 3e0)", "con": "confidence / 100e0",
         "fre": "CASE freshness_state WHEN 'recent' THEN 1e0 WHEN 'aging' THEN 0.6e0 WHEN 'stale' THEN 0.25e0 ELSE 0e0 END"}
    w = dict(sev=30, alt=20, poi=15, saf=10, rep=10, con=8, fre=7)
    fragment(name, needs, f"""SELECT *, CASE WHEN priority_score >= 75 THEN 'critical' WHEN priority_score >= 55 THEN 'high' WHEN priority_score >= 35 THEN 'medium' ELSE 'low' END AS priority_band FROM (
  SELECT *, CAST(least(100e0, {half_up('0e0 + ' + ' + '.join(f'{k} * {w[k]}e0' for k in w) + ' + boost * 15e0')}) AS INT) AS priority_score FROM (
  SELECT *, {', '.join(f'greatest(0e0, least(1e0, {e})) AS {k}' for k, e in f.items())} FROM (SELECT a.*, poi_sum, {boost} AS boost{', ratio' if ratio == 'ratio' else ''},
    list_has_any(barrier_list, ['no_pedestrian_path', 'crossing_without_ramp', 'blocking_obstacle', 'missing_curb_ramp']) AS safety FROM worthy a LEFT JOIN poisum USING (segment_id) {joins})))""")


scored("prio", ["worthy", "poisum", "detour"], "ratio", "0e0", "LEFT JOIN detour USING (segment_id)")
oracle("priority", ["prio"], f"SELECT segment_id, priority_score, priority_band, {half_up('sev * 30e0', 1)} AS severity, {half_up('alt * 20e0', 1)} AS no_alternative, {half_up('saf * 10e0', 1)} AS safety FROM prio")
fragment("stored", [], """SELECT 'issue_w' || p_partkey || 'E' AS issue_id, 'w' || p_partkey || 'E' AS segment_id, CASE p_partkey % 5 WHEN 0 THEN 'new' WHEN 1 THEN 'assigned' WHEN 2 THEN 'resolved' WHEN 3 THEN 'in_progress' ELSE 'verified' END AS old_status,
  CASE WHEN p_partkey % 4 = 0 THEN 0.5e0 ELSE 0e0 END AS old_boost, CASE WHEN p_partkey % 5 = 1 THEN 'roads' END AS dept FROM part""")
scored("prio2", ["worthy", "poisum", "stored", "detour"], "ratio", "coalesce(old_boost, 0e0)", "LEFT JOIN stored USING (segment_id) LEFT JOIN detour USING (segment_id)")
fragment("queue", ["prio2", "stored"], """SELECT coalesce(s.issue_id, 'issue_' || n.segment_id) AS issue_id, coalesce(n.segment_id, s.segment_id) AS segment_id, n.region_id,
  CASE WHEN n.segment_id IS NULL THEN 'resolved' WHEN s.issue_id IS NULL OR old_status = 'resolved' THEN 'new' ELSE old_status END AS workflow_status, coalesce(n.priority_score, 0) AS priority_score,
  coalesce(n.priority_band, 'low') AS priority_band, coalesce(old_boost, 0e0) AS manual_boost, dept AS assigned_department, CASE WHEN n.segment_id IS NULL THEN 'evidence_no_longer_shows_barrier' END AS resolved_reason, n.barriers, n.ratio
  FROM prio2 n FULL JOIN stored s ON s.segment_id = n.segment_id""")
oracle("issue_queue", ["queue"], "SELECT issue_id, workflow_status, priority_score, priority_band, manual_boost, assigned_department, resolved_reason FROM queue")
oracle("top_barriers", ["queue"], "SELECT issue_id, priority_score, barriers <> '' AS has_barrier FROM queue WHERE workflow_status NOT IN ('resolved', 'rejected') AND priority_score > 0 ORDER BY priority_score DESC, issue_id LIMIT 4")
oracle("open_critical_issues", ["queue"], "SELECT issue_id, priority_score FROM queue WHERE workflow_status = 'new' AND priority_band = 'high' ORDER BY priority_score DESC, issue_id LIMIT 50")
oracle("patched_issues", ["stored"], """SELECT issue_id, CASE WHEN ok AND k % 3 = 0 THEN 'assigned' ELSE old_status END AS workflow_status, CASE WHEN ok AND k % 2 = 0 THEN 'parks' ELSE dept END AS assigned_department,
  CASE WHEN ok AND k % 7 = 0 THEN (k % 3) / 2e0 ELSE old_boost END AS manual_boost, ok AND k % 7 = 0 AS boost_changed FROM (SELECT *, k % 3 <> 1 AS ok FROM (SELECT *, CAST(substr(segment_id, 2, length(segment_id) - 2) AS BIGINT) AS k FROM stored))""")
fragment("boosts", ["stored"], "SELECT *, CASE WHEN ch THEN (k % 3) / 2e0 ELSE old_boost END AS new_boost FROM (SELECT *, k % 3 <> 1 AND k % 7 = 0 AS ch FROM (SELECT *, CAST(substr(segment_id, 2, length(segment_id) - 2) AS BIGINT) AS k FROM stored))")
scored("prio3", ["worthy", "poisum", "boosts", "detour"], "ratio", "coalesce(new_boost, 0e0)", "LEFT JOIN boosts USING (segment_id) LEFT JOIN detour USING (segment_id)")
oracle("boosted_issues", ["queue", "prio3", "boosts"], f"""SELECT q.issue_id, coalesce(ch, false) AS boost_changed, coalesce(new_boost, 0e0) AS manual_boost,
  CASE WHEN ch THEN coalesce(n.priority_score, 0) ELSE q.priority_score END AS priority_score, CASE WHEN ch THEN coalesce(n.priority_band, 'low') ELSE q.priority_band END AS priority_band,
  CASE WHEN ch THEN CASE WHEN n.segment_id IS NULL THEN 0e0 ELSE {half_up('new_boost * 15e0', 1)} END END AS boost_points
  FROM queue q LEFT JOIN boosts b ON b.segment_id = q.segment_id LEFT JOIN prio3 n ON n.segment_id = q.segment_id""")
oracle("issue_export", ["queue"], """SELECT segment_id, priority_score || '|' || priority_band || '|' || segment_id || '|' || coalesce(CAST(ratio AS VARCHAR), 'none found') || '|' || workflow_status || '|' || coalesce(assigned_department, '') AS line
  FROM queue WHERE priority_score > 0 ORDER BY priority_score DESC, segment_id""")

# --- coverage -----------------------------------------------------------------------
CLS = {"assessed": "status <> 'unverified'", "unknown": "status = 'unverified'", **{s: f"status = '{s}'" for s in P.ASSESSED}, "manually_verified": "man",
       "image_assessed": "NOT man AND img", "tags_only": "NOT man AND NOT img AND status <> 'unverified'", "stale": "freshness_state = 'stale'"}
fragment("cov", ["assess"], f"""SELECT coalesce(region_id, 'all') AS region_id, count(*) AS segments, {half_up('sum(length_m)')} AS total_m,
  {', '.join(f"{half_up(f'coalesce(sum(length_m) FILTER ({c}), 0e0)')} AS {n}_m, count(*) FILTER ({c}) AS {n}_segments, {half_up(f'coalesce(sum(length_m) FILTER ({c}), 0e0) / sum(length_m) * 100', 1)} AS {n}_pct" for n, c in CLS.items())},
  count(*) FILTER (has_manual AND m_result = 'needs_inspection') AS needs_inspection FROM (SELECT *, has_manual AS man, n_map > 0 AS img FROM assess) GROUP BY ROLLUP (region_id)""")
oracle("coverage_by_region", ["cov", "found"], """SELECT cov.*, with_imagery FROM cov JOIN (
  SELECT coalesce(region_id, 'all') AS region_id, count(*) FILTER (len(frames) > 0) AS with_imagery FROM found GROUP BY ROLLUP (region_id)) USING (region_id)""")
_rows = [("Total pedestrian network", "total_m", "100e0"), ("Assessed", "assessed_m", "assessed_pct"), ("Unknown (insufficient evidence)", "unknown_m", "unknown_pct"),
         ("Manually verified", "manually_verified_m", "manually_verified_pct"), ("Assessed from imagery", "image_assessed_m", "image_assessed_pct"), ("Map tags only", "tags_only_m", "tags_only_pct"),
         ("Stale evidence", "stale_m", "stale_pct"), ("Classified accessible", "accessible_m", "accessible_pct"), ("Classified partial", "partial_m", "partial_pct"), ("Classified inaccessible", "inaccessible_m", "inaccessible_pct")]
oracle("coverage_export", ["cov"], " UNION ALL ".join(f"SELECT region_id, '{n}' AS measure, {m} AS metres, {p} AS percent FROM cov WHERE region_id <> 'all'" for n, m, p in _rows))
oracle("region_overview", ["cov", "reports", "queue", "usage"], """SELECT region_id, segments, assessed_pct, coalesce(pr, 0) AS pending_reports, coalesce(ci, 0) AS critical_issues,
  (SELECT CAST(sum(calls) AS BIGINT) FROM (SELECT calls FROM usage ORDER BY day DESC LIMIT 7)) AS calls_this_week FROM cov
  LEFT JOIN (SELECT region_id, count(*) AS pr FROM reports WHERE status = 'pending' GROUP BY 1) USING (region_id) LEFT JOIN (SELECT region_id, count(*) AS ci FROM queue WHERE priority_score >= 75 GROUP BY 1) USING (region_id) WHERE region_id <> 'all'""")
oracle("stale_share", ["assess"], f"""SELECT region_id, count(*) AS segments, count(*) FILTER (freshness_state IN ('stale', 'none')) AS stale, {half_up("count(*) FILTER (freshness_state IN ('stale', 'none')) / count(*)", 3)} AS share,
  count(*) FILTER (freshness_state IN ('stale', 'none')) / count(*) > 0.35e0 AS flagged FROM assess GROUP BY 1""")

# --- validation -----------------------------------------------------------------------
fragment("lab", ["assess"], """SELECT a.*, CASE a.b % 3 WHEN 0 THEN 'accessible' WHEN 1 THEN 'partial' ELSE 'inaccessible' END AS truth, list_filter([CASE WHEN b % 4 = 0 THEN 'steps' END, CASE WHEN b % 5 = 0 THEN 'narrow_width' END,
  CASE WHEN b % 7 = 0 THEN 'high_kerb' END], lambda z: z IS NOT NULL) AS tb, CASE WHEN has_evidence THEN barrier_list ELSE [] END AS pb FROM assess a WHERE d = 0""")
_rk = lambda c: f"CASE {c} WHEN 'accessible' THEN 3 WHEN 'partial' THEN 2 WHEN 'inaccessible' THEN 1 ELSE 0 END"
_cl = "status <> 'unverified'"
oracle("validation_metrics", ["lab"], f"""SELECT region_id, count(*) AS samples, count(*) FILTER ({_cl}) AS classified, count(*) FILTER (NOT ({_cl})) AS declined, count(*) FILTER ({_cl} AND status = truth) AS agreed,
  count(*) FILTER ({_cl} AND {_rk('status')} > {_rk('truth')}) AS optimistic, count(*) FILTER ({_cl} AND {_rk('status')} < {_rk('truth')}) AS pessimistic, count(*) FILTER ({_cl}) >= 30 AS sufficient,
  {half_up(f"count(*) FILTER ({_cl} AND status = truth) / count(*) FILTER ({_cl})", 3)} AS agreement FROM lab GROUP BY 1""")
oracle("confusion_matrix", ["lab"], "SELECT truth AS true_status, " + ", ".join(f"count(*) FILTER (status = '{s}') AS {s}" for s in P.STATUSES) + " FROM lab GROUP BY 1")
oracle("barrier_pr", ["lab"], f"""SELECT barrier, tp, fp, fn, CASE WHEN tp + fp > 0 THEN {half_up('tp / (tp + fp)', 3)} END AS precision, CASE WHEN tp + fn > 0 THEN {half_up('tp / (tp + fn)', 3)} END AS recall FROM (
  SELECT barrier, count(*) FILTER (t AND p) AS tp, count(*) FILTER (p AND NOT t) AS fp, count(*) FILTER (t AND NOT p) AS fn FROM (
  SELECT barrier, list_contains(tb, barrier) AS t, list_contains(pb, barrier) AS p FROM (SELECT tb, pb, unnest(list_distinct(list_concat(tb, pb))) AS barrier FROM lab)) GROUP BY 1)""")
oracle("unlabelled_targets", ["assess"], "SELECT segment_id, status, confidence AS evidence_confidence FROM assess WHERE status <> 'unverified' AND NOT (d = 0 AND length(segment_id) % 2 = 0) ORDER BY confidence, segment_id LIMIT 40")
fragment("elog", [], """SELECT *, 'w' || (event_id % (SELECT max(p_partkey) + 1 FROM part)) || 'E' AS segment_id, CASE CAST(floor(value) AS BIGINT) % 4 WHEN 0 THEN 'accessible' WHEN 1 THEN 'partial' WHEN 2 THEN 'inaccessible' ELSE 'unverified' END AS status FROM events""")
oracle("assessment_changes", ["elog"], "SELECT event_id, segment_id, before AS status_before, status FROM (SELECT *, lag(status) OVER (PARTITION BY segment_id ORDER BY ts) AS before FROM elog) WHERE status IS DISTINCT FROM before")
oracle("frozen_labels", ["elog"], """SELECT l.segment_id, l.labelled_by, l.true_status, 'steps' AS true_barriers, g.status AS predicted_status, CAST(g.event_id % 97 AS INT) AS predicted_confidence FROM (
  SELECT segment_id, 'u' || user_id AS labelled_by, arg_max(status, ts) AS true_status, max(ts) + INTERVAL 1 HOUR AS at FROM elog WHERE event_type = 'click' AND status <> 'unverified' GROUP BY 1, 2) l
  ASOF LEFT JOIN (SELECT * FROM elog WHERE event_type <> 'click') g ON g.segment_id = l.segment_id AND g.ts <= l.at""")

# --- search --------------------------------------------------------------------------
_pk = OP.phonetic
fragment("streets", ["seg"], f"SELECT key, count(*) AS segments, arg_min(street_name, segment_id) AS street_name, list({_pk('street_name')}) AS l1, arg_min(street_name_el, segment_id) AS street_name_el FROM (SELECT *, {_pk('coalesce(street_name_el, street_name)')} AS key FROM seg) GROUP BY 1")
oracle("street_index", ["streets"], "SELECT key, segments, street_name FROM streets")
fragment("starts", ["streets"], f"SELECT DISTINCT key, segments, unnest(list_concat([n], string_split(n, ' '))) AS w FROM (SELECT key, segments, unnest([{_pk('street_name')}, {_pk('street_name_el')}]) AS n FROM streets) WHERE n <> ''")
oracle("street_suggest", ["starts"], f"""SELECT query_id, key, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY segments DESC, key) AS rank FROM (
  SELECT DISTINCT query_id, key, segments FROM (SELECT query_id, {_pk('query')} AS qk FROM (SELECT c_custkey AS query_id, lower(left(c_mktsegment, CAST(1 + c_custkey % 3 AS INT))) AS query FROM customer) WHERE length(query) >= 2) q
  JOIN starts ON starts_with(w, qk))) WHERE rank <= 6""")

# --- projection ------------------------------------------------------------------------
fragment("mix", ["assess"], "SELECT status, count(*) / sum(count(*)) OVER () AS share FROM assess WHERE status <> 'unverified' GROUP BY 1")
oracle("measured_mix", ["mix"], f"SELECT status, {half_up('share', 4)} AS share FROM mix")
_h = lambda s: f"((list_reduce(list_transform(string_split({s}, ''), lambda c: CAST(ascii(c) AS BIGINT)), lambda h, c: (xor(h, c) * 16777619) % 4294967296, CAST(2166136261 AS BIGINT)) % 100000) / 100000e0)"
fragment("proj", ["assess", "mix"], f"""SELECT segment_id, freshness_state, length_m, was = 'unverified' AS simulated, st AS status, CASE WHEN was = 'unverified' THEN CAST({half_up('lo + spread * (hi - lo)')} AS INT) ELSE score END AS score FROM (
  SELECT *, CASE st WHEN 'accessible' THEN 80 WHEN 'partial' THEN 52 ELSE 14 END AS lo, CASE st WHEN 'accessible' THEN 96 WHEN 'partial' THEN 78 ELSE 48 END AS hi FROM (
  SELECT * EXCLUDE (status), status AS was, CASE WHEN status <> 'unverified' THEN status WHEN roll < pa THEN 'accessible' WHEN roll < pa + pp THEN 'partial' ELSE 'inaccessible' END AS st FROM (
  SELECT *, {_h('segment_id')} AS roll, {_h("segment_id || ':score'")} AS spread, (SELECT share FROM mix WHERE status = 'accessible') AS pa, (SELECT share FROM mix WHERE status = 'partial') AS pp FROM assess)))""")
oracle("projection", ["proj"], "SELECT segment_id, status, score, simulated FROM proj")
oracle("map_view", ["proj"], f"""SELECT CASE WHEN simulated THEN 'projected' ELSE 'assessed' END AS view, status, CASE status WHEN 'accessible' THEN '#18A66A' WHEN 'partial' THEN '#F2B84B' ELSE '#E55757' END AS color,
  CASE status WHEN 'accessible' THEN '●' WHEN 'partial' THEN '◐' ELSE '■' END AS glyph, count(*) AS n, max(CAST(length_m AS INT) || ' m') AS longest FROM proj WHERE freshness_state = 'recent' GROUP BY ALL""")

# --- state and workflow ------------------------------------------------------------------
oracle("refreshed_regions", ["assess"], """SELECT region_id, count(*) FILTER (s <> freshness_state) AS moved FROM (SELECT *, CASE WHEN ref IS NULL THEN 'none' WHEN d2 <= 365 THEN 'recent' WHEN d2 <= 1095 THEN 'aging' ELSE 'stale' END AS s FROM (
  SELECT *, greatest(0e0, (epoch_us(TIMESTAMP '2002-09-01') - epoch_us(ref)) / 86400000000e0) AS d2 FROM assess)) GROUP BY 1""")
oracle("cleared_overrides", ["seg"], "SELECT segment_id, CASE WHEN has_manual AND kind <> 'footway' THEN m_result END AS result FROM seg")
oracle("verification_checks", [], """SELECT event_id, CASE WHEN event_id % 4 = 3 THEN 'unknown result' WHEN event_id % 4 = 1 AND event_id % 8 >= 4 THEN 'correction without status'
  WHEN event_id % 4 = 1 AND length(trim(left(props, CAST(event_id % 9 AS INT)))) < 5 THEN 'correction without reason' END AS error FROM events""")
fragment("jobs", [], "SELECT o_orderkey AS job_id, CASE o_orderkey % 4 WHEN 0 THEN 'queued' WHEN 1 THEN 'running' WHEN 2 THEN 'completed' ELSE 'failed' END AS status, o_orderkey % 3 AS ec, o_orderkey % 5 AS sc, CASE WHEN o_orderkey % 42 <> 0 THEN o_orderdate END AS since FROM orders")
fragment("sjobs", ["jobs"], "SELECT *, status IN ('queued', 'running') AND coalesce(since <= TIMESTAMP '1998-05-31 23:30:00', false) AS stale FROM jobs")
oracle("stale_jobs", ["sjobs"], "SELECT job_id, CASE WHEN stale THEN 'failed' ELSE status END AS status, stale FROM sjobs")
oracle("job_outcomes", ["jobs"], "SELECT CASE WHEN ec > 0 AND sc = 0 THEN 'failed' WHEN ec > 0 THEN 'partial' ELSE 'completed' END AS outcome, count(*) AS n FROM jobs GROUP BY 1")
oracle("audit_changes", ["sjobs"], "SELECT job_id, CASE WHEN job_id % 10 > 0 THEN status END AS before, CASE WHEN job_id % 10 < 9 THEN CASE WHEN stale THEN 'failed' ELSE status END END AS after, CASE WHEN job_id % 10 < 9 THEN false END AS leaks FROM sjobs")
oracle("audit_redaction", [], """SELECT o_orderkey AS job_id, CASE WHEN length(note) > 400 THEN left(note, 399) || '…' ELSE note END AS note, 30 AS attempts, 'no' AS keys, CAST(o_orderkey + 1 AS VARCHAR) AS first_no,
  '{"status":"done"}' AS next FROM (SELECT o_orderkey, repeat('order ' || o_orderkey, CAST(o_orderkey % 60 + 1 AS INT)) AS note FROM orders)""")
oracle("saved_places", [], """SELECT user_id, place_id, rn FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY seen DESC, place_id) AS rn FROM (
  SELECT user_id, event_id % 400 AS place_id, max(ts) AS seen FROM events WHERE event_type IN ('click', 'view') GROUP BY 1, 2)) WHERE rn <= 10""")
oracle("segment_details", ["assess", "elog"], """SELECT segment_id, a.status AS assessed_status, CAST(least(12, observation_count) AS INT) AS observations, CAST(CASE WHEN n IS NULL THEN 0 ELSE least(10, n) END AS INT) AS events, latest
  FROM assess a LEFT JOIN (SELECT segment_id, count(*) AS n, arg_max(status, ts) AS latest FROM elog GROUP BY 1) USING (segment_id)""")
fragment("bundle", ["assess"], f"SELECT region_id, count(*) AS segment_count, {half_up('sum(length_m)')} AS total_length_m, " + ", ".join(f"count(*) FILTER (status = '{s}') AS n_{s}" for s in P.STATUSES) + " FROM assess GROUP BY 1")
oracle("region_catalogue", ["bundle"], "SELECT region_id, segment_count, row_number() OVER (ORDER BY segment_count % 2 <> 0, region_id) = 1 AS is_default FROM bundle")
oracle("bundle_metadata", ["bundle"], "SELECT *, CAST(CASE WHEN region_id = 'r4' THEN 1 ELSE CAST(substr(region_id, 2) AS INT) + 4 END AS INT) AS version FROM bundle")
oracle("report_export", ["reports"], """SELECT report_id || ',' || coalesce(strftime(created_at, '%Y-%m-%dT%H:%M:%S.%g') || 'Z', '') || ',' || category || ',' || status || ',,' || segment_id || ',"' || replace(description, '"', '""') || '",'
  || CASE WHEN has_photo THEN 'yes' ELSE 'no' END || ',' || coalesce(strftime(reviewed_at, '%Y-%m-%dT%H:%M:%S.%g') || 'Z', '') || ',' || coalesce(assigned_to, '') AS value FROM reports ORDER BY created_at DESC NULLS LAST, report_id""")
oracle("geojson_statuses", ["assess"], "SELECT region_id, status, 'LineString' AS type, count(*) AS features FROM assess GROUP BY 1, 2")
oracle("parameter_checks", ["part_k"], """SELECT k AS p_partkey, CAST(CAST(sz * 2.2e0 > 100 OR b * 3e0 > 100 AS INT) + CAST(b * 3e0 >= sz * 2.2e0 AS INT) + CAST(sz * 2.5e0 > 100 AS INT) + CAST(b * 40 >= sz * 25 AS INT)
  + CAST(b * 5 > 100 AS INT) + CAST(sz * 110 > 5000 AS INT) AS INT) AS errors FROM part_k""")
