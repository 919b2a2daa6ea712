"""SQL for the way, evidence and assessment queries."""

from oracles import BARRIER_OF, PEN, case, half_up, oracle

TXT = lambda expr: f"array_to_string(list_sort({expr}), ',')"
WAY_TAGS = ["highway", "footway", "surface", "smoothness", "width", "est_width", "kerb", "kerb_height", "incline", "tactile_paving",
            "wheelchair", "crossing", "ramp", "ramp_wheelchair", "barrier", "sidewalk", "sidewalk_left", "sidewalk_right", "foot",
            "access", "service"]
NAMES = {"kerb_height": "kerb:height", "ramp_wheelchair": "ramp:wheelchair", "sidewalk_left": "sidewalk:left", "sidewalk_right": "sidewalk:right"}
from oracles import KIND_SQL, TAG_SQL, fragment  # noqa: E402

fragment("ways", ["part_k"], f"""
SELECT *, t_highway <> 'trunk' AND coalesce(t_foot <> 'no', true) AND coalesce(t_access <> 'private', true) AS walk,
       coalesce(t_sidewalk_left = 'separate' AND t_sidewalk_right = 'separate', false) AS apart FROM (
SELECT *, {KIND_SQL} AS kind FROM (SELECT *, {TAG_SQL}, 'r' || ((k // 400) % 5) AS region_id,
    CASE WHEN sz % 2 = 0 THEN translate(p_name, 'abdegiklmnoprstuvxz', 'αβδεγικλμνοπρστυβξζ') END AS name_el
  FROM (SELECT *, 0 AS d FROM part_k)))""")
oracle("pedestrian_ways", ["ways"], "SELECT k AS way_id, kind, kind = 'road_walkable' AS is_carriageway FROM ways "
       "WHERE walk AND NOT (kind = 'road_walkable' AND apart)")
oracle("way_stats", ["ways"], """SELECT region_id, count(*) AS ways_received,
  count(*) FILTER (walk AND NOT (kind = 'road_walkable' AND apart)) AS ways_kept, count(*) FILTER (NOT walk) AS skipped_non_pedestrian,
  count(*) FILTER (walk AND kind = 'road_walkable' AND apart) AS skipped_redundant_carriageway FROM ways GROUP BY 1""")
oracle("relevant_tags", ["ways"], "SELECT k AS way_id, array_to_string(list_sort(list_filter([" + ", ".join(
    f"'{NAMES.get(t, t)}=' || t_{t}" for t in WAY_TAGS) + ", 'name=' || p_name, 'name:el=' || name_el], lambda z: z IS NOT NULL)), '|') AS tags FROM ways")
oracle("way_names", ["ways"], "SELECT k AS way_id, p_name AS name_en, coalesce(name_el, p_name) AS name_el FROM ways")
oracle("typed_tags", ["typed"], f"SELECT segment_id, {half_up('w', 4)} AS width_m, {half_up('kh', 4)} AS kerb_height_m, {half_up('inc', 4)} AS incline_pct FROM typed")
oracle("tag_evidence", ["tagev"], f"SELECT segment_id, {half_up('info', 3)} AS informativeness, decisive, {TXT('hard_blocks')} AS hard_blocks, "
       f"{TXT('known_tags')} AS known_tags FROM tagev")
oracle("tag_evidence_items", ["tagev"], f"""SELECT side, id, count(*) AS n, {half_up('sum(w)', 3)} AS weight FROM (
  SELECT 'barrier' AS side, unnest(tag_b, recursive := true) FROM tagev UNION ALL SELECT 'positive', unnest(tag_p, recursive := true) FROM tagev) GROUP BY 1, 2""")
NEED = """CASE WHEN t_highway = 'trunk' THEN 'highway:trunk'
  WHEN t_highway = 'service' AND t_service = 'driveway' THEN 'service:driveway'
  WHEN t_foot = 'no' OR t_access = 'private' THEN 'access:closed'
  WHEN decisive AND len(hard_blocks) > 0 THEN 'blocks:' || array_to_string(hard_blocks, ',')
  WHEN decisive THEN 'wheelchair:' || t_wheelchair END"""
oracle("visual_evidence_needed", ["tagev"], f"SELECT segment_id, {NEED} IS NULL AS needs_visual, {NEED} AS reason FROM tagev")

# --- observations -----------------------------------------------------------
fragment("raw", ["obs"], """
SELECT *, CASE WHEN n % 7 = 0 THEN 'excellent' ELSE quality END AS raw_quality, n % 5 = 0 AS no_ramp, surface_type = 'other' AS marble,
       len(uncertain) AS n_unc FROM (SELECT *, length(observation_id) + ascii(right(observation_id, 1)) AS n FROM obs)""")
oracle("validate_observations", ["raw"], f"""SELECT observation_id, len(e) = 0 AS ok, len(e) AS n_errors, {TXT('e')} AS errors FROM (
  SELECT observation_id, list_filter([CASE WHEN raw_quality = 'excellent' THEN 'imageQuality: unexpected excellent' END,
    CASE WHEN no_ramp THEN 'curbRamp: missing' END, CASE WHEN marble THEN 'surface.type: unexpected marble' END,
    'uncertainFindings: expected array'], lambda z: z IS NOT NULL) AS e FROM raw)""")
oracle("normalise_observations", ["raw"], """SELECT observation_id, CASE WHEN raw_quality = 'excellent' THEN 'poor' ELSE raw_quality END AS quality,
  CASE WHEN no_ramp THEN 'unknown' ELSE curb_ramp_visible END AS ramp, CASE WHEN marble THEN 'unknown' ELSE surface_type END AS surface,
  array_to_string(features, ',') AS features, CASE WHEN description = '' THEN 0 ELSE 140 END AS description_chars, 0 AS n_uncertain FROM raw""")
oracle("reading_quality", ["obs"], """SELECT observation_id, quality <> 'poor' AND pedestrian_path_visible <> 'not_visible' AND len(uncertain) <= 2 AS sufficient,
  false AS is_empty FROM obs""")
oracle("observations_newest", ["near"], "SELECT segment_id, observation_id, rn FROM near WHERE rn <= 20")
oracle("first_segment", ["obs"], "SELECT observation_id, own AS segment_id FROM obs")
oracle("feature_votes", ["votes"], f"SELECT segment_id, path, value, support, informative, {half_up('agreement', 4)} AS agreement, tie FROM votes")
oracle("vote_ranks", ["ranked"], "SELECT segment_id, path, value, support, rank FROM ranked")
oracle("observation_agreement", ["agree"], f"SELECT segment_id, {half_up('agreement', 4)} AS agreement, {half_up('conflict', 4)} AS conflict, {TXT('contested')} AS contested FROM agree")
oracle("observation_summary", ["summary", "near"], f"""SELECT s.segment_id, observation_count, informative_count, label AS source_label,
  array_to_string(qualities, ',') AS qualities, {TXT('list_distinct(u)')} AS uncertain
  FROM summary s JOIN (SELECT segment_id, flatten(list(uncertain)) AS u FROM near GROUP BY 1) USING (segment_id)""")
oracle("crossing_features", ["near"], "SELECT segment_id, feature, count(*) AS support FROM (SELECT segment_id, unnest(features) AS feature FROM near) GROUP BY ALL")
_t = lambda c: TXT(f"list_transform({c}, lambda e: e.id || ':' || CAST(floor(e.w * 1000 + 0.5e0) AS BIGINT))")
oracle("visual_evidence", ["visual"], f"SELECT segment_id, {_t('vis_b')} AS barriers, {_t('vis_p')} AS positives FROM visual")

# --- assessment ---------------------------------------------------------------
oracle("assess_status", ["assess"], """SELECT segment_id, region_id, status, reason, score AS accessibility_score, confidence AS evidence_confidence,
  freshness_state, age_days AS evidence_age_days, CASE WHEN has_evidence THEN barriers ELSE '' END AS barriers, positives, sources,
  observation_count, informative_count FROM assess""")
for _name in ("reassessed_observations", "reassessed_verifications"):  # the same as assessing all at once
    oracle(_name, ["assess"], """SELECT segment_id, region_id, status, reason, score AS accessibility_score, confidence AS evidence_confidence,
      freshness_state, age_days AS evidence_age_days, CASE WHEN has_evidence THEN barriers ELSE '' END AS barriers, positives, sources,
      observation_count, informative_count FROM assess""")
oracle("score_breakdown", ["assess"], f"""SELECT segment_id, score AS accessibility_score, raw_score, total_penalty, total_bonus,
  least(total_bonus, 20e0) AS capped_bonus, CASE WHEN top0 < 100 THEN CAST({half_up('top0')} AS INT) END AS ceiling FROM assess WHERE score IS NOT NULL""")
oracle("folded_evidence", ["folded"], f"SELECT segment_id, side, id, {half_up('f.w', 4)} AS weight, {TXT('f.s')} AS sources FROM folded")
oracle("confidence", ["conf"], """SELECT segment_id, confidence AS evidence_confidence, confidence >= 45 AS classifiable, c_tags AS tag_points,
  c_images AS image_points, c_agree AS agreement_points, c_conflict AS conflict_points, c_reports AS report_points FROM conf""")
oracle("freshness", ["seg"], f"""SELECT segment_id, CASE WHEN ref IS NULL THEN 'none' WHEN days <= 365 THEN 'recent' WHEN days <= 1095 THEN 'aging' ELSE 'stale' END AS freshness_state,
  CAST({half_up('days')} AS INT) AS age_days, mv IS NOT NULL AND (osm_ts IS NULL OR mv >= osm_ts) AS freshness_verified,
  ref IS NULL OR days > 1095 AS is_stale FROM (SELECT *, CASE WHEN ref IS NOT NULL THEN greatest(0e0, (epoch_us(TIMESTAMP '2001-12-01') - epoch_us(ref)) / 86400000000e0) END AS days FROM (
  SELECT *, CASE WHEN has_manual THEN TIMESTAMP '2001-06-01' END AS mv, greatest(osm_ts, CASE WHEN has_manual THEN TIMESTAMP '2001-06-01' END) AS ref FROM seg))""")
oracle("status_counts", ["assess"], f"SELECT region_id, status, count(*) AS segments, {half_up('sum(length_m)', 1)} AS metres FROM assess GROUP BY 1, 2")
oracle("report_barriers", ["reports"], f"SELECT report_id, {case('category', BARRIER_OF, text=True)} AS barrier FROM reports")
oracle("reports_by_segment", ["repseg"], f"SELECT segment_id, n_rep AS verified_report_count, coalesce({TXT('rep_ids')}, '') AS barriers FROM repseg")
