"""SQL for the report, imagery, text, geometry and network queries."""

import oracles_evidence as OE
from footscape.functions.text import GREEK_LETTERS, GREEK_PAIRS, GREEK_WIDE, LATIN_FOLDS
from oracles import CATEGORIES, HEADS, half_up, haversine, fragment, oracle

NOW_R = "TIMESTAMP '2024-02-01'"
NOW_O = "TIMESTAMP '2001-12-01'"
TXT = OE.TXT

# --- reports ----------------------------------------------------------------
fragment("openrep", ["reports"], f"""SELECT * FROM reports WHERE status NOT IN ('rejected', 'resolved', 'withdrawn', 'duplicate')
  AND (created_at IS NULL OR created_at >= {NOW_R} - to_days(45))""")
oracle("open_reports", ["openrep"], "SELECT report_id, status FROM openrep")
oracle("verified_reports", ["reports"], "SELECT report_id, segment_id FROM reports WHERE status = 'verified'")
oracle("report_checks", [], f"""SELECT doc_id, {TXT('''list_filter([CASE WHEN doc_id % 9 = 0 THEN 'unknown category' END,
  CASE WHEN doc_id % 120 > 90 THEN 'latitude out of range' END, CASE WHEN length(text) > 600 THEN 'description too long' END], lambda z: z IS NOT NULL)''')} AS errors FROM documents""")


def to_segment(lng: str, lat: str, a: str, b: str, c: str, d: str) -> tuple[str, str]:
    """(t, metres) from a point to the straight piece (a, b)-(c, d), on a plane at the point's latitude."""
    kx = f"(111412.84e0 * cos(radians({lat})) - 93.5e0 * cos(3 * radians({lat})))"
    ky = f"(111132.92e0 - 559.82e0 * cos(2 * radians({lat})))"
    dx, dy = f"(({c}) * {kx} - ({a}) * {kx})", f"(({d}) * {ky} - ({b}) * {ky})"
    t = (f"greatest(0e0, least(1e0, ((({lng}) * {kx} - ({a}) * {kx}) * {dx} + (({lat}) * {ky} - ({b}) * {ky}) * {dy}) / ({dx} * {dx} + {dy} * {dy})))")
    return t, haversine(lng, lat, f"({a} + ({c} - {a}) * tt)", f"({b} + ({d} - {b}) * tt)")


def near_pairs(points: str, key: str, radius: float, extra: str = "") -> str:
    t, d = to_segment("p.lng", "p.lat", "s.lng1", "s.lat1", "s.lng2", "s.lat2")
    d = d.replace("p.lng", "lng").replace("p.lat", "lat").replace("s.", "")
    deg = radius / 80000
    return f"""SELECT *, {d} AS dist FROM (SELECT p.{key}, p.lng, p.lat, {extra} s.segment_id, s.lng1, s.lat1, s.lng2, s.lat2, {t} AS tt
  FROM {points} p JOIN seg s ON s.lng1 <= p.lng + {deg}e0 AND s.lng2 >= p.lng - {deg}e0 AND s.lat1 <= p.lat + {deg}e0 AND s.lat2 >= p.lat - {deg}e0)"""


fragment("repnear", ["reports", "seg"], near_pairs("reports", "report_id", 35))
oracle("report_snap", ["repnear"], f"""SELECT r.report_id, CAST({half_up('n.d')} AS INT) AS segment_distance_m, n.d IS NOT NULL AS matched
  FROM reports r LEFT JOIN (SELECT report_id, min(dist) AS d FROM repnear WHERE dist <= 35 GROUP BY 1) n USING (report_id)""")
REL = {"broken_pavement": ["surface_problem"], "surface_problem": ["broken_pavement"], "blocked_sidewalk": ["temporary_obstruction", "narrow_passage"],
       "temporary_obstruction": ["blocked_sidewalk"], "narrow_passage": ["blocked_sidewalk"], "missing_curb_ramp": ["crossing_problem"],
       "crossing_problem": ["missing_curb_ramp"]}
_rel = " OR ".join(f"(ac = '{k}' AND bc IN ({', '.join(repr(x) for x in v)}))" for k, v in REL.items())
oracle("duplicate_reports", ["openrep"], f"""SELECT report_id, rank, candidate_id, {half_up('least(1e0, raw)', 3)} AS score, CAST({half_up('d')} AS INT) AS distance_m,
  CAST({half_up('coalesce(days, 0e0)')} AS INT) AS age_days FROM (
  SELECT *, row_number() OVER (PARTITION BY report_id ORDER BY raw DESC, candidate_id) AS rank FROM (
  SELECT *, (0.5e0 * CASE WHEN d >= 40 THEN 0e0 ELSE 1 - d / 40e0 END + 0.3e0 * CASE WHEN ac = bc THEN 1e0 WHEN {_rel} THEN 0.6e0 ELSE 0e0 END
     + 0.2e0 * CASE WHEN days IS NULL OR days >= 45 THEN 0e0 ELSE 1 - days / 45e0 END) + CASE WHEN aseg = bseg THEN 0.15e0 ELSE 0e0 END AS raw FROM (
  SELECT a.report_id, b.report_id AS candidate_id, a.category AS ac, b.category AS bc, a.segment_id AS aseg, b.segment_id AS bseg,
     {haversine('a.lng', 'a.lat', 'b.lng', 'b.lat')} AS d, abs(epoch_us(a.created_at) / 1e6 - epoch_us(b.created_at) / 1e6) / 86400e0 AS days
  FROM openrep a JOIN openrep b ON a.report_id <> b.report_id AND abs(a.lat - b.lat) < 0.0006e0 AND abs(a.lng - b.lng) < 0.0006e0))
  WHERE {half_up('least(1e0, raw)', 3)} >= 0.6e0) WHERE rank <= 5""")


def geohash(lng: str, lat: str, n: int) -> str:
    bits = n * 5
    xb, yb = (bits + 1) // 2, bits // 2
    x, y = f"CAST(floor(({lng} + 180e0) / 360e0 * {1 << xb}) AS BIGINT)", f"CAST(floor(({lat} + 90e0) / 180e0 * {1 << yb}) AS BIGINT)"
    out = []
    for c in range(n):
        terms = []
        for j in range(5):
            i = c * 5 + j
            v, w = (x, xb) if i % 2 == 0 else (y, yb)
            terms.append(f"(({v} >> {w - 1 - i // 2}) & 1) * {1 << (4 - j)}")
        out.append(f"substr('0123456789bcdefghjkmnpqrstuvwxyz', CAST({' + '.join(terms)} AS INT) + 1, 1)")
    return " || ".join(out)


oracle("geohash_cells", ["reports"], f"SELECT report_id, {geohash('lng', 'lat', 8)} AS geohash, {half_up('lng', 5)} AS lng, {half_up('lat', 5)} AS lat FROM reports")
oracle("reports_near_pois", ["pois", "reports"], """SELECT poi_id, count(*) AS reports FROM (
  SELECT poi_id FROM (SELECT *, floor((lng + 180e0) / 360e0 * 32768) AS x, floor((lat + 90e0) / 180e0 * 32768) AS y FROM pois) p
  JOIN (SELECT floor((lng + 180e0) / 360e0 * 32768) AS x, floor((lat + 90e0) / 180e0 * 32768) AS y FROM reports) r
  ON abs(p.x - r.x) <= 1 AND abs(p.y - r.y) <= 1) GROUP BY 1""")
oracle("newest_reports", ["reports"], "SELECT report_id, region_id, created_at FROM reports WHERE status = 'verified' ORDER BY created_at DESC NULLS LAST, report_id DESC LIMIT 60")
oracle("retention_due", ["reports"], f"""SELECT report_id, photo_delete_after FROM reports WHERE status = 'rejected' AND photo_path IS NOT NULL
  AND photo_delete_after <= {NOW_R}""")
oracle("orphan_uploads", [], "SELECT 'reports/' || event_id || '.jpg' AS path FROM events WHERE ts <= TIMESTAMP '2024-01-19' AND event_id % 4 <> 0")
oracle("public_reports", ["reports"], "SELECT report_id, region_id, category, status, has_photo FROM reports")
oracle("reviewed_reports", ["reports"], """SELECT r.report_id, CASE e % 6 WHEN 0 THEN 'verified' WHEN 1 THEN 'rejected' WHEN 3 THEN 'resolved' WHEN 4 THEN 'needs_review'
    WHEN 2 THEN CASE WHEN e % 12 = 2 THEN 'duplicate' ELSE status END ELSE status END AS status,
  CASE WHEN e % 12 = 2 THEN 'rep' || (e - 1) END AS duplicate_of,
  strftime(CASE WHEN e % 6 = 1 THEN ts + to_days(33) ELSE photo_delete_after END, '%Y-%m-%d') AS delete_after
  FROM reports r JOIN (SELECT event_id AS e, ts FROM events) v ON r.report_id = 'rep' || e""")
oracle("rejected_decisions", [], """SELECT 'rep' || event_id AS report_id, CASE WHEN event_id % 6 = 5 THEN 'unknown decision' ELSE 'duplicate without original' END AS error
  FROM events WHERE event_id % 6 = 5 OR event_id % 12 = 8""")

# --- imagery ------------------------------------------------------------------
fragment("usable", ["images"], f"""SELECT DISTINCT ON (image_id) * FROM images WHERE NOT is_pano AND (captured_at IS NULL OR captured_at >= {NOW_O} - INTERVAL '70128 hours')""")
fragment("imgnear", ["usable", "seg"], near_pairs("usable", "image_id", 22, "p.captured_at, p.compass_angle, p.quality_score, p.sequence_id,"))
_bear = ("((degrees(atan2(sin(radians({c} - {a})) * cos(radians({d})), cos(radians({b})) * sin(radians({d})) - sin(radians({b})) * cos(radians({d})) "
         "* cos(radians({c} - {a})))) + 360) % 360)")
BEAR = _bear.format(a="lng1", b="lat1", c="lng2", d="lat2")
fragment("frames", ["imgnear"], f"""
SELECT *, {half_up('0.35e0 * proximity + 0.30e0 * recency + 0.20e0 * direction + 0.15e0 * quality', 4)} AS score, {half_up('dist', 1)} AS distance_m FROM (
SELECT *, 1e0 - dist / 22e0 AS proximity, CASE WHEN captured_at IS NULL THEN 0.3e0 WHEN years <= 1 THEN 1e0 ELSE greatest(0e0, 1e0 - (years - 1) / 7) END AS recency,
  CASE WHEN compass_angle IS NULL THEN 0.5e0 ELSE 1e0 - 0.35e0 * (least(delta, 180 - delta) / 90e0) END AS direction,
  CASE WHEN quality_score IS NULL THEN 0.6e0 ELSE least(1e0, quality_score) END AS quality FROM (
SELECT *, CASE WHEN dd > 180 THEN 360 - dd ELSE dd END AS delta FROM (
SELECT *, (epoch_us({NOW_O}) - epoch_us(captured_at)) / (365.25e0 * 86400e6) AS years, ((compass_angle - {BEAR}) % 360 + 360) % 360 AS dd
FROM imgnear WHERE dist <= 22)))""")
oracle("usable_images", ["usable"], "SELECT image_id FROM usable")
oracle("images_near_segments", ["imgnear"], f"SELECT segment_id, count(*) AS frames, {half_up('min(dist)', 2)} AS nearest_m FROM imgnear WHERE dist <= 22 GROUP BY 1")
oracle("frame_scores", ["frames"], f"SELECT segment_id, image_id, {half_up('score', 3)} AS score, {half_up('direction', 3)} AS direction, {half_up('recency', 3)} AS recency FROM frames")
NEED = OE.NEED
_far = lambda n: f"{haversine('f.lng', 'f.lat', f'c{n}.lng', f'c{n}.lat')} >= 12"
_seq = lambda n: f"coalesce(f.sequence_id = c{n}.sequence_id, false)"
fragment("needed", ["frames", "tagev"], f"SELECT f.* FROM frames f JOIN (SELECT segment_id FROM tagev WHERE {NEED} IS NULL) USING (segment_id)")
_pick = lambda late: f"arg_min(f, {{'l': {late}, 's': -f.score, 'i': f.image_id}})"
fragment("c1", ["needed"], f"SELECT segment_id, u.* FROM (SELECT segment_id, {_pick('false')} AS u FROM (SELECT segment_id AS segment_id, n AS f FROM needed n) GROUP BY 1)".replace("SELECT segment_id, u.*", "SELECT unnest(u)"))
fragment("c2", ["needed", "c1"], f"""SELECT unnest(u) FROM (SELECT segment_id, {_pick('late')} AS u FROM (
  SELECT f.segment_id, f, {_seq(1)} AS late FROM needed f JOIN c1 USING (segment_id) WHERE f.image_id <> c1.image_id AND {_far(1)}) GROUP BY 1)""")
fragment("c3", ["needed", "c1", "c2"], f"""SELECT unnest(u) FROM (SELECT segment_id, {_pick('late')} AS u FROM (
  SELECT f.segment_id, f, {_seq(1)} OR {_seq(2)} AS late FROM needed f JOIN c1 USING (segment_id) JOIN c2 USING (segment_id)
  WHERE f.image_id NOT IN (c1.image_id, c2.image_id) AND {_far(1)} AND {_far(2)}) GROUP BY 1)""")
fragment("found", ["tagev", "c1", "c2", "c3"], f"""
SELECT t.segment_id, t.region_id, CASE WHEN {NEED} IS NOT NULL THEN 'not_needed' WHEN c1.image_id IS NULL THEN 'none_found' ELSE 'selected' END AS status,
  list_filter([c1.image_id, c2.image_id, c3.image_id], lambda z: z IS NOT NULL) AS frames,
  list_filter([c1.distance_m, c2.distance_m, c3.distance_m], lambda z: z IS NOT NULL) AS dists
FROM tagev t LEFT JOIN c1 USING (segment_id) LEFT JOIN c2 USING (segment_id) LEFT JOIN c3 USING (segment_id)""")
oracle("frame_selection", ["found"], "SELECT segment_id, status, array_to_string(frames, ',') AS frames FROM found")
fragment("tasks", ["found"], """SELECT segment_id, region_id, frames[list_position(dists, list_min(dists))] AS image_id, list_min(dists) AS distance_m, frames
  FROM found WHERE status = 'selected'""")
oracle("pending_tasks", ["tasks"], "SELECT segment_id, image_id, distance_m FROM tasks")
oracle("budget_admission", ["tasks"], """SELECT segment_id, position, position <= 150 AS admitted FROM (
  SELECT segment_id, row_number() OVER (ORDER BY distance_m, segment_id) AS position FROM tasks)""")
oracle("retired_frames", ["found"], """SELECT segment_id, CASE WHEN status <> 'selected' THEN 0 WHEN length(segment_id) % 2 = 0 THEN len(frames) ELSE 1 END AS analysed,
  CASE WHEN status = 'selected' AND length(segment_id) % 2 = 0 THEN len(frames) - 1 ELSE 0 END AS skipped FROM found""")
oracle("discovery_summary", ["found"], f"""SELECT region_id, count(*) AS searched, count(*) FILTER (status = 'selected') AS with_imagery, count(*) FILTER (status = 'not_needed') AS settled,
  0 AS outside, CAST(sum(len(frames)) AS BIGINT) AS frames_selected, {half_up("count(*) FILTER (status = 'selected') / count(*)", 3)} AS coverage_ratio FROM found GROUP BY 1""")
oracle("failure_runs", ["calls"], """SELECT job_id, max(n) AS longest_run, coalesce(max(n) FILTER (NOT any_ok), 0) >= 5 AS tripped FROM (SELECT job_id, island, bool_or(had_ok) AS any_ok, count(*) FILTER (outcome = 'failed') AS n FROM (
  SELECT *, sum(CASE WHEN outcome <> 'failed' THEN 1 ELSE 0 END) OVER (PARTITION BY job_id ORDER BY ts, call_id ROWS UNBOUNDED PRECEDING) AS island,
  count(*) FILTER (outcome <> 'failed') OVER (PARTITION BY job_id ORDER BY ts, call_id ROWS UNBOUNDED PRECEDING) > 0 AS had_ok
  FROM calls WHERE outcome <> 'cached') GROUP BY 1, 2) GROUP BY 1""")
fragment("usage", ["calls"], """SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) FILTER (outcome <> 'cached') AS calls, count(*) FILTER (outcome = 'cached') AS cached,
  count(*) FILTER (outcome = 'failed') AS failed, greatest(0, 3000 - count(*) FILTER (outcome <> 'cached')) AS remaining FROM calls GROUP BY 1""")
oracle("daily_usage", ["usage"], "SELECT * FROM usage")
oracle("analysis_estimate", ["tasks", "usage"], """SELECT region_id, count(*) AS segments, CAST(sum(len(frames)) AS BIGINT) AS frames, least(count(*), 200, any_value(room)) AS expected_calls,
  CAST(least(sum(len(frames)), 200, any_value(room)) AS BIGINT) AS max_calls FROM tasks, (SELECT arg_max(remaining, day) AS room FROM usage) GROUP BY 1""")
oracle("usage_left", ["usage"], "SELECT day, calls, cached, failed, calls + day(CAST(day AS DATE)) % 3 AS reserved, greatest(0, 3000 - calls - day(CAST(day AS DATE)) % 3) AS remaining FROM usage")
oracle("usage_week", ["usage"], "SELECT * FROM usage ORDER BY day DESC LIMIT 7")
oracle("leaked_reservations", ["usage"], "SELECT day, calls + day(CAST(day AS DATE)) % 3 AS reserved, day(CAST(day AS DATE)) % 3 AS leaked FROM usage")
fragment("ftasks", ["images"], "SELECT image_id AS source_id, 'w' || split_part(image_id, '-', 4) || 'E' AS segment_id FROM images")
oracle("frames_to_analyse", ["ftasks", "obs"], "SELECT source_id, segment_id FROM ftasks WHERE source_id NOT IN (SELECT source_id FROM obs WHERE status <> 'failed')")
oracle("cached_links", ["obs"], f"SELECT observation_id, {TXT('''list_distinct(CASE WHEN status <> 'failed' THEN list_append(segment_ids, 'w' || k || 'E') ELSE segment_ids END)''')} AS segment_ids FROM obs")
oracle("relink_audit", ["ftasks", "obs"], """SELECT state, count(*) AS n FROM (SELECT CASE WHEN o.source_id IS NULL THEN 'no_observation'
  WHEN list_contains(o.segment_ids, t.segment_id) THEN 'linked' ELSE 'unlinked' END AS state
  FROM ftasks t LEFT JOIN (SELECT * FROM obs WHERE status <> 'superseded') o USING (source_id)) GROUP BY 1""")
_d2 = haversine("m.lng", "m.lat", "f.lng", "f.lat")
oracle("observation_frames", ["images"], f"""
SELECT matched_by, count(*) AS n FROM (SELECT m.oid, CASE WHEN m.hit THEN 'id' WHEN n.oid IS NOT NULL THEN 'distance' END AS matched_by FROM (
  SELECT image_id AS oid, lng, lat, CAST(split_part(image_id, '-', 2) AS BIGINT) % 2 = 0 AND NOT is_pano AS hit FROM images) m
  LEFT JOIN (SELECT DISTINCT oid FROM (SELECT m.oid, {_d2} AS d FROM (SELECT image_id AS oid, lng, lat, floor(lng / 0.002e0) AS cx, floor(lat / 0.002e0) AS cy FROM images
     WHERE NOT (CAST(split_part(image_id, '-', 2) AS BIGINT) % 2 = 0 AND NOT is_pano)) m
     JOIN (SELECT DISTINCT lng, lat, cx + dx AS cx, cy + dy AS cy FROM (SELECT lng, lat, floor(lng / 0.002e0) AS cx, floor(lat / 0.002e0) AS cy FROM images WHERE NOT is_pano),
           (SELECT unnest([-1, 0, 1]) AS dx), (SELECT unnest([-1, 0, 1]) AS dy)) f USING (cx, cy)) WHERE d <= 50) n USING (oid)) GROUP BY 1""")

# --- text -----------------------------------------------------------------------
oracle("analysis_keys", ["obs"], "SELECT source_type || '::' || source_id || '::-::m1::1.0.0' AS dedupe_key, source_type || '_' || source_id || '_x_y_m1_1.0.0' AS doc_id FROM obs")
_s = r"regexp_replace(regexp_replace(text, '^\s+|\s+$', '', 'g'), '\s+', ' ', 'g')"
oracle("short_texts", [], f"SELECT doc_id, length(t) AS chars, md5(t) AS digest FROM (SELECT doc_id, CASE WHEN length({_s}) > 120 THEN left({_s}, 119) || '…' ELSE {_s} END AS t FROM documents)")
oracle("page_image_ids", [], r"SELECT page_id, CASE WHEN regexp_matches(url, '^https?://([^/?#]+\.)?example\.com([/?#]|$)') THEN CAST(page_id AS VARCHAR) END AS image_id FROM pages")
oracle("hash_units", ["seg"], f"""SELECT segment_id, {half_up('(h % 100000) / 100000e0', 5)} AS unit FROM (SELECT segment_id,
  list_reduce(list_transform(string_split(segment_id, ''), lambda c: CAST(ascii(c) AS BIGINT)), lambda h, c: (xor(h, c) * 16777619) % 4294967296, CAST(2166136261 AS BIGINT)) AS h FROM seg)""")


def phonetic(c: str) -> str:
    s = f"strip_accents(lower(coalesce({c}, '')))"
    for a, b in GREEK_PAIRS:
        s = f"replace({s}, '{a}', '{b}')"
    s = f"translate({s}, '{GREEK_LETTERS[0]}', '{GREEK_LETTERS[1]}')"
    for a, b in GREEK_WIDE + LATIN_FOLDS:
        s = f"replace({s}, '{a}', '{b}')"
    s = f"trim(regexp_replace({s}, '[^a-z0-9]+', ' ', 'g'))"
    for ch in "abcdefghijklmnopqrstuvwxyz":
        s = f"regexp_replace({s}, '{ch}{ch}+', '{ch}', 'g')"
    return s


oracle("phonetic_keys", ["seg"], f"SELECT segment_id, {phonetic('street_name')} AS latin, {phonetic('street_name_el')} AS greek FROM seg")
oracle("mixed_timestamps", [], "SELECT event_id, CAST(floor(epoch_us(ts) / 1e6) AS BIGINT) AS epoch FROM events")
oracle("day_keys", [], "SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n FROM events GROUP BY 1")

# --- geometry ----------------------------------------------------------------------
_len = haversine("lng1", "lat1", "lng2", "lat2")
oracle("segment_geometry", ["seg"], f"""SELECT segment_id, {half_up(_len, 3)} AS length_m, {half_up('lng1 + (lng2 - lng1) * 0.5e0', 6)} AS mid_lng, {half_up('lat1 + (lat2 - lat1) * 0.5e0', 6)} AS mid_lat,
  {half_up(BEAR, 2)} AS bearing, {half_up('CASE WHEN q > 180 THEN 360 - q ELSE q END', 2)} AS delta, {half_up(f'(({BEAR} - 300 + 540) % 360) - 180', 2)} AS turn
  FROM (SELECT *, (({BEAR} - 300) % 360 + 360) % 360 AS q FROM seg)""")
oracle("packed_geometry", ["seg"], f"SELECT segment_id, 2 AS points, {half_up('lng2', 6)} AS lng FROM seg")
fragment("boxes", ["seg"], "SELECT region_id, min(lng1) AS w, min(lat1) AS s, max(lng2) AS e, max(lat2) AS n FROM seg GROUP BY 1")
_area = "abs((n - s) * 110.574e0 * ((e - w) * 111.320e0 * cos(radians((s + n) / 2))))"
oracle("region_areas", ["boxes"], f"SELECT region_id, {half_up(_area, 4)} AS area_km2, {_area} > 25 AS too_large FROM boxes")
oracle("points_in_regions", ["boxes", "reports"], """SELECT b.region_id AS box_region, count(*) AS reports FROM boxes b JOIN reports r
  ON r.lng BETWEEN b.w AND b.e AND r.lat BETWEEN b.s AND b.n GROUP BY 1""")
oracle("tile_images", ["boxes", "images"], """SELECT tile_id, coalesce(c, 0) AS images, coalesce(c, 0) >= 2000 AS truncated FROM (
  SELECT tile_id, count(i.image_id) AS c FROM (
   SELECT region_id || '-' || tx || '-' || ty AS tile_id, w + tx * ((e - w) / cols) AS w, w + (tx + 1) * ((e - w) / cols) AS e, s + ty * ((n - s) / rows) AS s, s + (ty + 1) * ((n - s) / rows) AS n
   FROM (SELECT *, unnest(range(cols)) AS tx FROM (SELECT *, greatest(1, CAST(ceil((e - w) / 0.0047e0) AS INT)) AS cols, greatest(1, CAST(ceil((n - s) / 0.0047e0) AS INT)) AS rows FROM boxes)) q,
        LATERAL (SELECT unnest(range(q.rows)) AS ty)) t
  LEFT JOIN (SELECT image_id, lng + 0.0000017e0 AS lng, lat + 0.0000013e0 AS lat FROM images) i ON i.lng BETWEEN t.w AND t.e AND i.lat BETWEEN t.s AND t.n GROUP BY 1)""")
_cos = "cos(radians((34.7533e0 + 34.7581e0) / 2))"
oracle("segments_in_box", ["seg"], f"""SELECT in_search_area, count(*) AS n FROM (SELECT NOT (32.4093e0 + 22e0 / (111320e0 * {_cos}) < lng1 OR 32.4051e0 - 22e0 / (111320e0 * {_cos}) > lng2
  OR 34.7581e0 + 22e0 / 111320e0 < lat1 OR 34.7533e0 - 22e0 / 111320e0 > lat2) AS in_search_area FROM seg) GROUP BY 1""")
_pd = haversine("s.clng", "s.clat", "p.lng", "p.lat")
fragment("poinear", ["seg", "pois"], f"""SELECT segment_id, poi_id, class, name, CAST({half_up('d')} AS INT) AS distance_m FROM (SELECT s.segment_id, p.poi_id, p.class, p.name, {_pd} AS d
  FROM seg s JOIN pois p ON abs(s.clat - p.lat) < 0.003e0 AND abs(s.clng - p.lng) < 0.004e0) WHERE d <= 250""")
oracle("nearby_pois", ["poinear"], "SELECT segment_id, poi_id, class, distance_m FROM poinear")
POIW = {"hospital": 1.0, "clinic": 0.8, "doctors": 0.6, "pharmacy": 0.5, "school": 0.8, "kindergarten": 0.6, "university": 0.6, "townhall": 0.9,
        "government": 0.8, "social_facility": 0.9, "bus_station": 0.8, "bus_stop": 0.4, "post_office": 0.5, "library": 0.5, "community_centre": 0.5}
_w = "CASE class " + " ".join(f"WHEN '{k}' THEN {v}e0" for k, v in POIW.items()) + " END"
fragment("poisum", ["poinear"], f"SELECT segment_id, sum(floor({_w} * (1 - distance_m / 250e0 * 0.7e0) * 1e6 + 0.5e0)) / 1e6 AS poi_sum, count(*) AS poi_count FROM poinear GROUP BY 1")
oracle("poi_pressure", ["poisum"], f"SELECT segment_id, {half_up('poi_sum', 3)} AS poi_sum, poi_count FROM poisum")

# --- network -------------------------------------------------------------------------
fragment("kept", ["ways"], "SELECT * FROM ways WHERE walk AND NOT (kind = 'road_walkable' AND apart)")
fragment("vertex", ["kept"], """SELECT k AS way_id, kind, region_id, unnest([0, 1, 2]) AS pos, unnest([k, k + 1, CASE WHEN sz % 4 = 0 THEN k + 2 ELSE k + 41 END]) AS node_id, last_key FROM kept""")
fragment("marked", ["vertex"], "SELECT *, pos <> 1 OR uses > 1 AS is_junction, node_id > last_key AS missing FROM (SELECT *, count(*) OVER (PARTITION BY region_id, node_id) AS uses FROM vertex)")
oracle("junctions", ["marked"], "SELECT way_id, pos, node_id, is_junction, missing FROM marked")
fragment("hops", ["marked"], """SELECT a.way_id, a.kind, a.node_id AS f, b.node_id AS t, a.missing OR b.missing OR (NOT m.is_junction AND (m.missing OR e.any_missing)) AS bad
  FROM marked a JOIN marked b ON a.way_id = b.way_id AND b.pos = a.pos + 1 JOIN marked m ON m.way_id = a.way_id AND m.pos = 1
  JOIN (SELECT way_id, bool_or(missing) AS any_missing FROM marked GROUP BY 1) e ON e.way_id = a.way_id""")
_xy = lambda n: (f"(32.4e0 + ({n} % 40) * 0.0004e0)", f"(34.75e0 + ({n} // 40) * 0.0004e0)")
_hd = haversine(_xy("f")[0], _xy("f")[1], _xy("t")[0], _xy("t")[1])
oracle("network_segments", ["hops"], f"""SELECT 'w' || way_id || '_' || f || '_' || t AS segment_id, 'n' || f AS from_node, 'n' || t AS to_node, {half_up(_hd, 1)} AS length_m, kind FROM hops WHERE NOT bad""")
_vd = haversine(_xy("lag(node_id) OVER w")[0], _xy("lag(node_id) OVER w")[1], _xy("node_id")[0], _xy("node_id")[1])
oracle("along_way", ["part_k"], f"""SELECT way_id, pos, {half_up('sum(step) OVER (PARTITION BY way_id ORDER BY pos ROWS UNBOUNDED PRECEDING)', 2)} AS along_m FROM (
  SELECT way_id, pos, coalesce({_vd}, 0e0) AS step FROM (SELECT * FROM (SELECT k AS way_id, last_key, unnest([0, 1, 2]) AS pos, unnest([k, k + 1, CASE WHEN sz % 4 = 0 THEN k + 2 ELSE k + 41 END]) AS node_id FROM part_k)
  WHERE node_id <= last_key) WINDOW w AS (PARTITION BY way_id ORDER BY pos))""")
oracle("network_stats", ["seg", "boxes"], f"""SELECT region_id, segments, nodes, total_length_m, {half_up(_area, 4)} AS area_km2 FROM (SELECT region_id, count(*) AS segments, {half_up('sum(length_m)')} AS total_length_m FROM seg GROUP BY 1)
  JOIN (SELECT region_id, count(DISTINCT n) AS nodes FROM (SELECT region_id, from_node AS n FROM seg UNION ALL SELECT region_id, to_node FROM seg) GROUP BY 1) USING (region_id) JOIN boxes USING (region_id)""")
oracle("length_quantiles", ["seg"], """SELECT region_id, max(n) AS segments, max(length_m) FILTER (rn = least(n, CAST(floor(n * 0.5e0) AS BIGINT) + 1)) AS median_m,
  max(length_m) FILTER (rn = least(n, CAST(floor(n * 0.9e0) AS BIGINT) + 1)) AS p90_m, max(length_m) AS max_m, count(*) FILTER (length_m > 50) AS oversize, count(*) FILTER (length_m > 50) AS unavoidable
  FROM (SELECT *, row_number() OVER (PARTITION BY region_id ORDER BY length_m) AS rn, count(*) OVER (PARTITION BY region_id) AS n FROM seg) GROUP BY 1""")
fragment("paths", ["seg"], """SELECT CAST(substr(from_node, 2) AS BIGINT) AS a, CAST(substr(to_node, 2) AS BIGINT) AS b FROM seg WHERE kind IN ('footway', 'sidewalk', 'crossing')""")
fragment("links", ["paths"], "SELECT a, b FROM paths UNION ALL SELECT b, a FROM paths")
HEADS["comp"] = "comp(node, component) USING KEY (node)"
fragment("comp", ["links"], """SELECT DISTINCT a, a FROM links UNION (SELECT l.b, min(c.component) FROM comp c JOIN links l ON l.a = c.node
  JOIN recurring.comp r ON r.node = l.b WHERE c.component < r.component GROUP BY 1)""")
oracle("components", ["comp"], "SELECT node, component FROM comp")
oracle("connectivity", ["comp"], f"""SELECT count(*) AS components, max(n) AS largest, CAST(sum(n) AS BIGINT) AS nodes, count(*) FILTER (n < 4) AS isolated,
  {half_up('max(n) / sum(n)', 3)} AS largest_share FROM (SELECT component, count(*) AS n FROM comp GROUP BY 1)""")
fragment("alllinks", ["seg"], """SELECT CAST(substr(from_node, 2) AS BIGINT) AS a, CAST(substr(to_node, 2) AS BIGINT) AS b FROM seg
  UNION ALL SELECT CAST(substr(to_node, 2) AS BIGINT), CAST(substr(from_node, 2) AS BIGINT) FROM seg""")
HEADS["allcomp"] = "allcomp(node, component) USING KEY (node)"
fragment("allcomp", ["alllinks"], """SELECT DISTINCT a, a FROM alllinks UNION (SELECT l.b, min(c.component) FROM allcomp c JOIN alllinks l ON l.a = c.node
  JOIN recurring.allcomp r ON r.node = l.b WHERE c.component < r.component GROUP BY 1)""")
oracle("network_components", ["allcomp"], "SELECT node, component FROM allcomp")
# a bridge's two ends are apart when the walk leaves it out: each footpath is tried
fragment("footpath", ["seg"], "SELECT segment_id, from_node AS a, to_node AS b FROM seg WHERE kind IN ('footway', 'sidewalk', 'crossing')")
fragment("footlink", ["footpath"], "SELECT segment_id, a, b FROM footpath UNION ALL SELECT segment_id, b, a FROM footpath")
HEADS["without"] = "without(edge_id, node, goal) USING KEY (edge_id, node)"
fragment("without", ["footpath", "footlink"], """SELECT segment_id, a, b FROM footpath UNION (SELECT DISTINCT w.edge_id, l.b, w.goal FROM without w JOIN footlink l ON l.a = w.node AND l.segment_id <> w.edge_id
  LEFT JOIN recurring.without r ON r.edge_id = w.edge_id AND r.node = l.b LEFT JOIN recurring.without g ON g.edge_id = w.edge_id AND g.node = w.goal WHERE r.node IS NULL AND g.node IS NULL)""")
oracle("bridges", ["footpath", "without"], "SELECT segment_id AS edge_id FROM footpath f LEFT JOIN without w ON w.edge_id = f.segment_id AND w.node = f.b WHERE w.node IS NULL")
oracle("graph_nodes", ["seg"], f"SELECT DISTINCT node, {half_up('lng', 6)} AS lng, {half_up('lat', 6)} AS lat FROM (SELECT from_node AS node, lng1 AS lng, lat1 AS lat FROM seg UNION ALL SELECT to_node, lng2, lat2 FROM seg)")
oracle("stale_segments", ["seg"], "SELECT segment_id FROM seg WHERE k % 7 = 0")
oracle("import_diff", ["seg"], """SELECT change, count(*) AS n FROM (SELECT CASE WHEN k % 7 = 0 THEN 'removed' ELSE 'kept' END AS change FROM seg UNION ALL SELECT 'added' FROM seg WHERE k % 11 = 0) GROUP BY 1""")
oracle("import_preserve", ["seg"], """SELECT segment_id, CASE WHEN has_manual THEN m_result END AS result FROM seg WHERE k % 7 <> 0 UNION ALL SELECT segment_id || 'b', NULL FROM seg WHERE k % 11 = 0""")
assert CATEGORIES
