"""DuckDB SQL for the registered queries."""

from __future__ import annotations

from lumeset.functions.metrics import QUALITY_WEIGHTS, SIGMOIDS
from lumeset.functions.text import FAMILY_NAMES, FAMILY_PHRASES, OTHER_SCENE
from lumeset.operators.profile import INFORMATION, POINTS, PROFILED
from lumeset.operators.reject import REASONS
from lumeset.plans.registered import COUNT, LIKE, NEAR_BITS
from lumeset.sources.tables import CANDIDATE, FRAME

ORACLES: dict[str, str] = {}
D = "::DOUBLE"


def cols(exprs: dict[str, str]) -> str:
    return ", ".join(f"{e} AS {c}" for c, e in exprs.items())


def macros(sql: str) -> str:
    """Write {x} for shared parts, so that braces of SQL structs need no doubling."""
    for name, part in PARTS.items():
        sql = sql.replace("{" + name + "}", part)
    return sql


def clamp(x: str) -> str:
    return f"greatest(0.0{D}, least(1.0{D}, {x}))"


SIGN = "(CASE WHEN hu >= 9223372036854775808::HUGEINT THEN hu - 18446744073709551616::HUGEINT ELSE hu END)::BIGINT"
HU = "list_sum(list_transform(range(1, 65), lambda i: CASE WHEN embedding[i] > 0 THEN (1::HUGEINT << (64 - i)) ELSE 0::HUGEINT END))"
N = {"blur_score": "blur_score", "contrast": "contrast", "color_richness": "color_richness", "action_intensity": "action_intensity", "ui_density": "ui_density"}
NORM = ", ".join(f"1.0{D} / (1.0{D} + exp(-{k}{D} * ({c} - {m}{D}))) AS n_{c}" for c, (m, k) in SIGMOIDS.items()) + f", least(1.0{D}, edge_density * 5.0{D}) AS n_edge_density, least(1.0{D}, dramatic_score / 100.0{D}) AS n_dramatic_score, visual_balance / 100.0{D} AS n_visual_balance"
QUALITY = " + ".join(f"n_{c} * {w}{D}" for c, w in QUALITY_WEIGHTS.items())
VIS = f"0.30{D} * least(1.0{D}, luminance_range / 32.0{D}) + 0.25{D} * least(1.0{D}, luminance_entropy / 1.5{D}) + 0.20{D} * least(1.0{D}, edge_density / 0.08{D}) + 0.15{D} * least(1.0{D}, contrast / 12.0{D}) + 0.10{D} * (1.0{D} - greatest(near_black_ratio, near_white_ratio))"
PC, PE, PR = clamp(f"1.0{D} - contrast / 18.0{D}"), clamp(f"1.0{D} - edge_density / 0.14{D}"), clamp(f"1.0{D} - luminance_range / 48.0{D}")
WASH = clamp(f"0.25{D} * {clamp(f'(brightness - 180.0{D}) / 75.0{D}')} + 0.20{D} * near_white_ratio + 0.20{D} * {PC} + 0.15{D} * {PE} + 0.10{D} * dominant_tone_ratio + 0.10{D} * {PR}")
SUI = "greatest(menu_layout, title_layout, game_over_layout)"
SUP = clamp(f"0.65{D} * n_ui_density + 0.35{D} * (1.0{D} - n_action_intensity)")


def veiled(vis: str, info: str, wash: str) -> str:
    return clamp(f"0.18{D} * (1.0{D} - ({vis})) + 0.16{D} * (1.0{D} - ({info})) + 0.12{D} * greatest(near_black_ratio, near_white_ratio) + 0.10{D} * {PR} + 0.10{D} * {PC} + 0.08{D} * {PE} + 0.10{D} * {wash} + 0.08{D} * {SUI} + 0.08{D} * {SUP}")


LOST = clamp(f"0.40{D} * {PC} + 0.35{D} * {PE} + 0.25{D} * {PR}")


def over(m: str, floor: float, scale: float) -> str:
    return clamp(f"({m} - greatest({floor}{D}, p_{m}_90)) / {scale}{D}")


BRIGHT = clamp(f"0.35{D} * {clamp(f'(brightness - p_brightness_90) / greatest(8.0{D}, p_brightness_90 - p_brightness_50)')} + 0.25{D} * {over('near_white_ratio', 0.05, 0.18)} + 0.20{D} * {WASH} + 0.20{D} * {LOST}")
DARK = clamp(f"0.40{D} * {clamp(f'(p_brightness_10 - brightness) / greatest(8.0{D}, p_brightness_50 - p_brightness_10)')} + 0.25{D} * {over('near_black_ratio', 0.05, 0.18)} + 0.20{D} * {over('dominant_tone_ratio', 0.55, 0.20)} + 0.15{D} * {LOST}")
PROFILE = "SELECT " + ", ".join(f"quantile_cont({m}::FLOAT::DOUBLE, {q / 100}) AS p_{m}_{q}" for m in PROFILED for q in POINTS) + " FROM fr"
INFO = "SELECT k1, k2, k3, k4, k5, " + " + ".join(
    f"{w}{D} * (((CASE WHEN f_{m} < {m} THEN le_{m} ELSE lt_{m} END) + (CASE WHEN f_{m} > {m} THEN lt_{m} ELSE le_{m} END)) / 2.0{D} / n)" for m, w in INFORMATION.items()
) + " AS information FROM (SELECT *, count(*) OVER () AS n, " + ", ".join(f"count(*) OVER (ORDER BY f_{m}) AS le_{m}, count(*) OVER (ORDER BY f_{m}) - count(*) OVER (PARTITION BY f_{m}) AS lt_{m}" for m in INFORMATION) + " FROM (SELECT *, " + ", ".join(f"{m}::FLOAT::DOUBLE AS f_{m}" for m in INFORMATION) + " FROM fr))"
REASON = """CASE
  WHEN near_black_ratio >= 0.97 AND luminance_entropy <= 0.35 AND luminance_range <= greatest(12.0, p_luminance_range_10) THEN 'blackout'
  WHEN near_white_ratio >= 0.92 AND luminance_entropy <= 0.55 AND luminance_range <= greatest(12.0, p_luminance_range_25) THEN 'whiteout'
  WHEN brightness >= 245 AND contrast <= greatest(6.0, p_contrast_10) AND edge_density <= greatest(0.02, p_edge_density_10) AND dominant_tone_ratio >= 0.88 THEN 'whiteout'
  WHEN washout >= 0.60 AND brightness >= 200 AND contrast <= greatest(8.0, p_contrast_25) AND edge_density <= greatest(0.05, p_edge_density_25) AND visibility <= 0.76 THEN 'whiteout'
  WHEN dominant_tone_ratio >= 0.88 AND greatest(near_black_ratio, near_white_ratio) <= 0.25 AND luminance_range <= greatest(12.0, p_luminance_range_10) AND contrast <= p_contrast_25 AND edge_density <= p_edge_density_25 THEN 'single_tone'
  WHEN bright >= 0.56 AND (visibility <= 0.78 OR information <= 0.62) AND (near_white_ratio >= p_near_white_ratio_90 OR washout >= 0.24)
    THEN CASE WHEN bright >= 0.72 OR near_white_ratio >= 0.58 THEN 'whiteout' ELSE 'fade_transition' END
  WHEN dark >= 0.54 AND visibility <= 0.66 AND brightness <= p_brightness_25 THEN 'fade_transition'
  WHEN (near_black_ratio >= 0.65 OR near_white_ratio >= 0.65) AND visibility < 0.30 AND (luminance_range <= greatest(14.0, p_luminance_range_25) OR information < 0.35) THEN 'fade_transition'
  WHEN washout >= 0.54 AND (brightness >= 185 OR near_white_ratio >= 0.24) AND (visibility <= 0.68 OR information <= 0.55) THEN 'fade_transition'
  WHEN veiled >= 0.46 AND (washout >= 0.40 OR near_white_ratio >= 0.20 OR near_black_ratio >= 0.20 OR system_ui >= 0.20) THEN 'fade_transition'
  WHEN (near_white_ratio >= 0.28 OR brightness >= greatest(200.0, p_brightness_90) OR near_black_ratio >= 0.28 OR brightness <= least(58.0, p_brightness_10))
    AND contrast <= greatest(12.0, p_contrast_25) AND edge_density <= greatest(0.08, p_edge_density_25)
    AND (dominant_tone_ratio >= 0.72 OR luminance_range <= greatest(28.0, p_luminance_range_25)) THEN 'fade_transition' END"""
#: In text of these tables no letter but sharp s folds to other letters
KEY_SCENE = f"coalesce(nullif(substr(regexp_replace(lower(%s), '[^\\p{{L}}\\p{{N}}]', '', 'g'), 1, 48), ''), '{OTHER_SCENE}')"


def family(scene: str) -> str:
    out = "CASE"
    for f, names in FAMILY_NAMES.items():
        out += f" WHEN lower(trim({scene})) IN ({', '.join(repr(n) for n in names)}) THEN '{f}'"
    for f, phrases in FAMILY_PHRASES.items():
        out += " WHEN " + " OR ".join(f"contains(lower(trim({scene})), '{p}')" for p in phrases) + f" THEN '{f}'"
    return out + " ELSE 'content' END"


PARTS = {
    "fr": f"fr AS (SELECT {cols(FRAME)} FROM lineitem)",
    "norm": f"norm AS (SELECT *, {NORM} FROM fr)",
    "emb": f"emb AS (SELECT vec_id, embedding, {SIGN} AS h FROM (SELECT *, {HU} AS hu FROM embeddings))",
    "ca": f"ca AS (SELECT e.*, h, embedding AS features FROM (SELECT {cols(CANDIDATE)} FROM (SELECT *, epoch_us(ts) AS epoch_us FROM events)) e JOIN emb ON vec_id = features_id % (SELECT count(*) FROM embeddings))",
    "judged": f"""prof AS ({PROFILE}), info AS ({INFO}),
sc AS (SELECT norm.*, information, {VIS} AS visibility, {WASH} AS washout, {SUI} AS system_ui FROM norm JOIN info USING (k1, k2, k3, k4, k5)),
rel AS (SELECT *, {BRIGHT} AS bright, {DARK} AS dark, {veiled('visibility', 'information', 'washout')} AS veiled FROM sc, prof),
judged AS (SELECT *, {REASON} AS reason FROM rel)""",
    "sm": "sm AS (SELECT ca.* EXCLUDE (scene), event_type AS scene, CASE event_type WHEN 'purchase' THEN 'cinematic' WHEN 'click' THEN 'recurring_gameplay' ELSE 'ordinary' END AS role, score AS selection, key::DOUBLE AS quality, printf('p%08d', key) AS path FROM ca)",
    "stats": "stats AS (SELECT run, scene, count(*) AS n, min(ord) AS first, coalesce(arg_min(role, ord) FILTER (role <> 'ordinary'), 'ordinary') AS role, greatest(max({'a': selection, 'b': quality}), {'a': 0.0::DOUBLE, 'b': 0.0::DOUBLE}) AS best FROM sm GROUP BY run, scene)",
    "grp": "grp AS (SELECT label::VARCHAR AS grp, vec_id, embedding, list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE)))) AS u FROM embeddings)",
}


def quota(count: int) -> str:
    return f"""q0 AS (SELECT *, least({count}, sum(n) OVER w) AS places, sum(CASE WHEN role = 'cinematic' THEN n ELSE 0 END) OVER w AS cin_n, sum(CASE WHEN role = 'cinematic' THEN 0 ELSE n END) OVER w AS oth_n, count(*) OVER w > {count} AS scarce FROM stats WINDOW w AS (PARTITION BY run)),
q1 AS (SELECT *, least(cin_n, greatest(greatest(1, ceil(places * 0.1)), places - oth_n)) AS lim, row_number() OVER (PARTITION BY run ORDER BY CASE WHEN scarce THEN -best.a END, CASE WHEN scarce THEN -best.b END, first) AS turn FROM q0),
q2 AS (SELECT run, scene, turn, places, lim, role = 'cinematic' AS cin, unnest(range(1, least(n, {count}) + 1)) AS k FROM q1),
q3 AS (SELECT *, row_number() OVER (PARTITION BY run, cin ORDER BY k, turn) AS c FROM q2),
q4 AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY k, turn) AS r FROM q3 WHERE NOT cin OR c <= lim),
q5 AS (SELECT run, scene, count(*) AS given FROM q4 WHERE r <= places GROUP BY ALL),
quotas AS (SELECT q1.*, coalesce(given, 0)::BIGINT AS quota FROM q1 LEFT JOIN q5 USING (run, scene))"""


def o(name: str, sql: str) -> None:
    ORACLES[name] = macros(sql)


o("profile_percentiles", "WITH {fr}, p AS (" + PROFILE + ") SELECT " + ", ".join(f"round(p_{m}_{q}, 6) AS p_{m}_{q}" for m in PROFILED for q in POINTS) + " FROM p")
o("report_profile", "WITH {fr}, p AS (" + PROFILE + "), l AS (SELECT unnest([" + ", ".join(f"{{'metric': '{m}', 'point': {q}, 'x': p_{m}_{q} / 3.0{D}}}" for m in PROFILED for q in POINTS) + f"""], recursive := true) FROM p),
h AS (SELECT *, x * 134217729.0{D} - (x * 134217729.0{D} - x) AS hi FROM l), w AS (SELECT *, floor(hi * 10000.0{D} + (x - hi) * 10000.0{D}) AS whole FROM h), o AS (SELECT *, (hi * 10000.0{D} - (whole + 0.5{D})) + (x - hi) * 10000.0{D} AS over FROM w)
SELECT metric, point, CASE WHEN over > 0 THEN whole + 1 WHEN over < 0 THEN whole ELSE whole + abs(whole % 2) END / 10000.0{D} AS value FROM o""")
o("frame_scores", f"""WITH {{fr}}, {{norm}}, q AS (SELECT *, {QUALITY} AS quality, {VIS} AS visibility, {WASH} AS washout FROM norm)
SELECT k1, k2, k3, k4, k5, (brightness < 7 AND contrast < 4) OR (brightness > 248 AND contrast < 4) OR (contrast < 2 AND blur_score < 1) AS unusable,
  round((greatest(0.0{D}, 1.0{D} - abs(brightness - 125.0{D}) / 125.0{D}) * 0.10{D} + least(1.0{D}, contrast / 70.0{D}) * 0.25{D} + least(1.0{D}, ln(1.0{D} + blur_score) / ln(801.0{D})) * 0.35{D} + least(1.0{D}, luminance_entropy / 7.5{D}) * 0.30{D}) * 100.0{D}, 6) AS mechanical,
  round(quality, 6) AS quality, round(quality * 0.7{D} + near_white_ratio * 0.3{D}, 6) AS selection, round(visibility, 6) AS visibility, round(washout, 6) AS washout, round({SUI}, 6) AS system_ui, round({SUP}, 6) AS support_ui,
  round({veiled('visibility', f'0.5{D}', 'washout')}, 6) AS veiled FROM q""")
o("relative_transitions", f"WITH {{fr}}, prof AS ({PROFILE}) SELECT k1, k2, k3, k4, k5, round({BRIGHT}, 9) AS bright, round({DARK}, 9) AS dark FROM fr, prof")
o("information_scores", f"WITH {{fr}}, info AS ({INFO}) SELECT k1, k2, k3, k4, k5, round(information, 9) AS information FROM info")
o("reject_classifier", "WITH {fr}, {norm}, {judged} SELECT k1, k2, k3, k4, k5, reason FROM judged")
o("reject_breakdown", "WITH {fr}, {norm}, {judged}, dom(reason) AS (VALUES " + ", ".join(f"('{r}')" for r in REASONS) + ") SELECT reason, count(k1) AS n FROM dom LEFT JOIN judged USING (reason) GROUP BY reason")
o("temporal_dip_filter", """WITH {emb}, {ca}, u AS (SELECT *, list_transform(features, lambda x: x::DOUBLE / sqrt(list_sum(list_transform(features, lambda y: y::DOUBLE * y::DOUBLE)))) AS u, score / 100.0::DOUBLE AS vis FROM ca),
n AS (SELECT *, lag(u) OVER w AS ub, lead(u) OVER w AS ua, lag(vis) OVER w AS vb, lead(vis) OVER w AS va, lag(is_transition) OVER w AS tb, lead(is_transition) OVER w AS ta FROM u WINDOW w AS (PARTITION BY run ORDER BY ts, key))
SELECT run, key, coalesce(NOT is_transition AND NOT tb AND NOT ta AND list_dot_product(ub, ua) >= 0.05 AND vis + 0.05::DOUBLE < least(vb, va), false) AS dip FROM n""")
o("scene_labels", "SELECT p_partkey, " + KEY_SCENE % "p_name || ' / ' || p_type" + " AS scene_key, CASE p_partkey % 4 WHEN 1 THEN 'cinematic' WHEN 2 THEN 'recurring_gameplay' ELSE 'ordinary' END AS role FROM part")
o("screen_families", "WITH {emb}, {ca} SELECT key, " + KEY_SCENE % "scene" + " AS scene_key, " + family("scene") + " AS family FROM ca")
o("inferred_titles", "SELECT p_partkey, CASE WHEN p_partkey % 4 = 3 THEN p_name || '-' || p_size || ' end' ELSE p_name END AS title FROM part")
o("duration_labels", f"""WITH t AS (SELECT *, round_even(o_totalprice / 60.0{D}, 0)::BIGINT AS m, greatest(0, round_even(o_totalprice, 0)::BIGINT) AS s, o_orderkey % 61 AS a, o_custkey % 7 AS b FROM orders)
SELECT o_orderkey, CASE WHEN m // 60 > 0 THEN format('約{{}}時間{{}}分', m // 60, m % 60) ELSE format('約{{}}分', m) END AS duration,
  CASE WHEN s // 3600 > 0 THEN printf('%02d:%02d:%02d', s // 3600, s % 3600 // 60, s % 60) ELSE printf('%02d:%02d', s % 3600 // 60, s % 60) END AS at,
  CASE WHEN b > 0 AND a > 0 THEN round(1.0{D} / (a{D} / b{D}), 6) ELSE 0.0{D} END AS interval, printf('v%02d %s', o_orderkey % 100, o_orderstatus) AS label,
  CASE WHEN o_orderkey % 2 = 0 THEN 'http://host:9000' ELSE 'http://host:11434' END AS host FROM t""")
o("salvaged_replies", "SELECT event_id, CASE WHEN event_type <> 'error' AND k BETWEEN 0 AND 100 THEN k END AS blog_score FROM (SELECT *, (regexp_extract('Sure:' || chr(10) || props || chr(10) || 'Done', '(?s)\\{.*\\}')::JSON ->> 'k')::DOUBLE AS k FROM events)")
o("hash_text", "WITH {emb} SELECT vec_id, h, lpad(lower(to_hex(CASE WHEN h < 0 THEN h::HUGEINT + 18446744073709551616::HUGEINT ELSE h::HUGEINT END)), 16, '0') AS hex, true AS same FROM emb")
o("unit_vectors", "WITH {grp} SELECT vec_id, round(list_sum(list_transform(u, lambda x: x * x)), 6) AS square, round(u[1], 6) AS first FROM grp")
o("event_entropy", "WITH n AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL), p AS (SELECT user_id, n / sum(n) OVER (PARTITION BY user_id) AS p FROM n) SELECT user_id, round(-sum(p * log2(p)), 6) AS entropy FROM p GROUP BY user_id")
o("hamming_pairs", f"WITH {{emb}}, c AS (SELECT h, min(vec_id) AS k, count(*) AS n FROM emb GROUP BY h) SELECT a.k AS a, b.k AS b, bit_count(xor(a.h, b.h))::INT AS distance, a.n AS n_a, b.n AS n_b FROM c a JOIN c b ON a.k < b.k AND bit_count(xor(a.h, b.h)) < {NEAR_BITS}")
o("near_frames", """WITH {emb}, {ca}, x AS (SELECT key, xor(h, xor(1::BIGINT << (key % 61), (key % 4) << (key % 7 * 8))) AS h FROM ca), c AS (SELECT h, min(key) AS k, count(*) AS n FROM x GROUP BY h)
SELECT a.k AS a, b.k AS b, bit_count(xor(a.h, b.h))::INT AS distance, a.n AS n_a, b.n AS n_b FROM c a JOIN c b ON a.k < b.k AND bit_count(xor(a.h, b.h)) < 5""")
o("cosine_degrees", f"""WITH {{emb}}, {{ca}}, c AS (SELECT features, min(key) AS class, count(*) AS n FROM ca GROUP BY features),
u AS (SELECT class, n, list_transform(features, lambda x: x::DOUBLE / sqrt(list_sum(list_transform(features, lambda y: y::DOUBLE * y::DOUBLE)))) AS u FROM c)
SELECT a.class, a.n, (a.n - 1 + coalesce(sum(b.n) FILTER (b.class <> a.class AND list_dot_product(a.u, b.u) >= {LIKE}), 0))::BIGINT AS links FROM u a, u b GROUP BY a.class, a.n""")
o("hash_classes", "SELECT doc_id, min(doc_id) OVER (PARTITION BY n_chars) AS class, count(*) OVER (PARTITION BY n_chars) AS n FROM documents")
o("cosine_pairs", f"WITH {{grp}} SELECT a.vec_id AS a, b.vec_id AS b, round(list_dot_product(a.u, b.u), 6) AS cosine FROM grp a JOIN grp b ON a.vec_id < b.vec_id AND list_dot_product(a.u, b.u) >= {LIKE}")
o("stage_blend", "WITH {emb}, {ca} SELECT run, key, round(score * 0.4::DOUBLE + (100.0::DOUBLE - score) * 0.6::DOUBLE, 6) AS aggregate FROM ca WHERE NOT is_transition")
o("unassessed_documents", "SELECT doc_id, source FROM documents ANTI JOIN labels USING (doc_id)")
o("cache_probe", "SELECT source, count(quality) AS hits, count(*) - count(quality) AS misses FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source")
o("exact_id_check", "SELECT doc_id AS id, 'missing' AS what FROM documents ANTI JOIN labels USING (doc_id) UNION ALL SELECT doc_id, 'unknown' FROM labels ANTI JOIN documents USING (doc_id)")
o("nearest_in_time", "WITH {emb}, {ca} SELECT run, key, round(least(ts - lag(ts) OVER w, lead(ts) OVER w - ts), 3) AS seconds FROM ca WINDOW w AS (PARTITION BY run, source ORDER BY ts, key)")
o("context_window", "WITH {emb}, {ca} SELECT run, key, round(greatest(min(ts) OVER w + 0.05::DOUBLE, ts - 0.35::DOUBLE), 3) AS before, round(least(max(ts) OVER w, ts + 0.35::DOUBLE), 3) AS after FROM ca WINDOW w AS (PARTITION BY run, source)")
o("source_survivors", "WITH {emb}, {ca} SELECT run, source, count(*) FILTER (NOT is_transition) AS alive, count(*) AS n FROM ca GROUP BY ALL")
o("uncovered_sources", "WITH {emb}, {ca} SELECT run, source FROM ca GROUP BY ALL HAVING count(*) FILTER (NOT is_transition AND score > 50) = 0")
o("source_time_scales", f"WITH {{emb}}, {{ca}} SELECT run, source, round(greatest(60.0::DOUBLE, (max(ts) - min(ts)) / greatest(1.0::DOUBLE, {COUNT}::DOUBLE / count(*) OVER (PARTITION BY run))), 3) AS scale FROM ca GROUP BY run, source")
BINS = """s AS (SELECT run, source, min(ts) AS start, max(ts) - min(ts) AS span, count(*) AS n FROM ca GROUP BY ALL),
b AS (SELECT *, coalesce(sum(span) OVER (PARTITION BY run ORDER BY source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE) AS off, greatest(sum(span) OVER (PARTITION BY run ORDER BY source ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING), 0.001::DOUBLE) AS whole, least(60, %d, sum(n) OVER (PARTITION BY run)) AS bins FROM s)"""
o("time_bins", "WITH {emb}, {ca}, " + BINS % (COUNT * 12) + " SELECT run, key, least(bins - 1, floor((off + greatest(0.0::DOUBLE, ts - start)) / whole * bins))::BIGINT AS bin FROM ca JOIN b USING (run, source)")
o("source_topk", "WITH {emb}, {ca} SELECT run, source, key, row_number() OVER (PARTITION BY run, source ORDER BY score DESC, ts, key)::INT AS place FROM ca QUALIFY place <= 3")
o("batch_numbers", "WITH {emb}, {ca} SELECT run, key, (row_number() OVER (PARTITION BY run ORDER BY key) - 1) // 12 AS batch FROM ca")
o("memory_chunks", """WITH RECURSIVE s AS (SELECT doc_id, source, coalesce(n_chars, 1048576) AS z, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS i FROM documents),
g(source, i, chunk, total, rows) AS (
  SELECT source, 1::BIGINT, 0::BIGINT, z::BIGINT, 1::BIGINT FROM s WHERE i = 1
  UNION ALL
  SELECT g.source, s.i, g.chunk + over::BIGINT, CASE WHEN over THEN s.z ELSE g.total + s.z END, CASE WHEN over THEN 1 ELSE g.rows + 1 END
  FROM g JOIN s ON s.source IS NOT DISTINCT FROM g.source AND s.i = g.i + 1, LATERAL (SELECT g.total + s.z > 65536 AND g.rows >= 16 AS over)),
c AS (SELECT source, i, chunk, count(*) OVER (PARTITION BY source, chunk) < 16 AND chunk > 0 AND chunk = max(chunk) OVER (PARTITION BY source) AS short FROM g)
SELECT doc_id, s.source, chunk - short::BIGINT AS chunk FROM s JOIN c ON s.source IS NOT DISTINCT FROM c.source AND s.i = c.i""")
o("output_names", """WITH {emb}, {ca}, s AS (SELECT run, key, event_type || lpad((row_number() OVER (PARTITION BY run, event_type ORDER BY key))::VARCHAR, 4, '0') AS stem, CASE WHEN key % 2 = 0 THEN '.JPG' ELSE '.jpg' END AS suffix FROM ca),
a AS (SELECT *, row_number() OVER (PARTITION BY run, lower(stem || suffix) ORDER BY key) - 1 AS again FROM s) SELECT run, key, stem || CASE WHEN again > 0 THEN '_' || again ELSE '' END || suffix AS name FROM a""")
o("label_conflicts", "SELECT user_id, event_type, count(DISTINCT props) AS kinds, count(*) AS n FROM events GROUP BY ALL HAVING count(DISTINCT props) > 1")
o("last_update", "SELECT user_id, event_type, arg_max(value, {'a': ts, 'b': event_id}) AS value, max(event_id) AS last_id FROM events GROUP BY ALL")
o("id_sets", """SELECT 'union' AS what, count(*) AS n FROM (SELECT doc_id FROM documents UNION SELECT doc_id FROM labels) UNION ALL SELECT 'difference', count(*) FROM (SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels)
UNION ALL SELECT 'common', count(*) FROM (SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels) UNION ALL SELECT 'distinct', count(DISTINCT doc_id) FROM documents""")
o("canonical_digest", '''SELECT o_orderkey, sha256('{"o_custkey":' || o_custkey || ',"o_orderkey":' || o_orderkey || ',"o_orderpriority":"' || o_orderpriority || '","o_orderstatus":"' || o_orderstatus || '"}') AS digest FROM orders''')
o("run_statistics", "WITH {emb}, {ca} SELECT run, count(*) AS n, count(*) FILTER (is_transition) AS rejected, round(avg(is_transition::INT), 6) AS failure_rate, count(DISTINCT scene) AS scenes, round(max(score), 4) AS best FROM ca GROUP BY run")
CU = """cu0 AS (SELECT c_nationkey AS run, c_custkey AS key, c_custkey AS ord, abs(c_acctbal) AS duration FROM customer),
cu AS (SELECT *, least(4000, floor(greatest(0.0::DOUBLE, CASE WHEN 0.05::DOUBLE + 0.05::DOUBLE >= duration THEN greatest(0.0::DOUBLE, duration - 0.05::DOUBLE) ELSE duration - 0.05::DOUBLE - 0.05::DOUBLE END) / 0.25::DOUBLE + 1e-9::DOUBLE) + 1)::BIGINT AS capacity FROM cu0)"""
o("sample_capacities", f"WITH {CU} SELECT key, capacity FROM cu")
GIVE = """u AS (SELECT run, key, ord, weight, target, unnest(range(least_n + 1, most_n + 1)) AS k FROM al),
r AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY greatest(weight, 0.001::DOUBLE) / k DESC, ord, k) AS rk FROM u),
b0 AS (SELECT run, sum(least_n) AS begun FROM al GROUP BY run), g AS (SELECT run, key, count(*) AS more FROM r JOIN b0 USING (run) WHERE rk <= target - begun GROUP BY ALL)
SELECT run, key, (least_n + coalesce(more, 0))::BIGINT AS n FROM al LEFT JOIN g USING (run, key)"""
o("sample_budget", f"""WITH {CU}, c1 AS (SELECT *, least(capacity, ceil(duration / 10.0::DOUBLE) + 1)::BIGINT AS base FROM cu),
c2 AS (SELECT *, sum(base) OVER w AS bases, least(greatest({COUNT * 36}, 120, sum(base) OVER w, count(*) OVER w), sum(capacity) OVER w, 4000) AS target FROM c1 WINDOW w AS (PARTITION BY run)),
al AS (SELECT run, key, ord, duration AS weight, CASE WHEN bases <= target THEN base ELSE 1 END AS least_n, capacity AS most_n, target FROM c2), {GIVE}""")
o("minimum_budget", f"WITH {CU}, al AS (SELECT run, key, ord, duration AS weight, 1 AS least_n, capacity AS most_n, least(sum(capacity) OVER w, greatest(200, count(*) OVER w)) AS target FROM cu WINDOW w AS (PARTITION BY run)), {GIVE}")
o("sample_positions", f"""WITH s AS (SELECT s_suppkey AS key, abs(s_acctbal) / 50.0{D} AS d FROM supplier),
m AS (SELECT key, d, least(0.5{D}, d / 4.0{D}) AS ds FROM s),
t AS (SELECT *, 0.05{D} + 0.05{D} >= d AS tight, greatest(0.05{D} + 0.05{D}, least(ds + greatest(ds, 0.05{D}), greatest(0.0{D}, d - 0.25{D}))) AS total FROM m),
a AS (SELECT *, greatest(least(ds, total / 2.0{D}), 0.05{D}) AS s2 FROM t),
b AS (SELECT *, total - s2 AS e2 FROM a),
c AS (SELECT key, d, CASE WHEN tight THEN 0.0{D} WHEN e2 < 0.05{D} THEN total - 0.05{D} ELSE s2 END AS st, CASE WHEN tight THEN least(d, 0.05{D}) WHEN e2 < 0.05{D} THEN 0.05{D} ELSE e2 END AS em FROM b),
e AS (SELECT key, d, st, greatest(st, d - em) AS en FROM c),
n AS (SELECT *, greatest(1, least(greatest(ceil(d / 10.0{D}) + 1, 120), 4000, floor((en - st) / 0.25{D} + 1e-9{D}) + 1))::BIGINT AS n FROM e),
x AS (SELECT *, unnest(range(n)) AS i FROM n)
SELECT key, i, round(CASE WHEN n = 1 THEN (st + en) / 2.0{D} WHEN i = n - 1 THEN en ELSE st + i * ((en - st) / (n - 1)) END, 6) AS ts FROM x""")
o("scene_stats", "WITH {emb}, {ca}, {sm}, {stats} SELECT run, scene, n, first, role, best.a AS best_selection, best.b AS best_quality FROM stats")
o("scene_quotas", "WITH {emb}, {ca}, {sm}, {stats}, " + quota(20) + " SELECT run, scene, quota FROM quotas")
o("scarce_scene_quotas", "WITH {emb}, {ca}, {sm}, {stats}, " + quota(3) + " SELECT run, scene, quota FROM quotas")
PLACE = f"""va AS (SELECT run, scene, key, list_transform(features, lambda x: x::DOUBLE / sqrt(list_sum(list_transform(features, lambda y: y::DOUBLE * y::DOUBLE)))) AS u, row_number() OVER (PARTITION BY run, scene ORDER BY ord, key) AS i, count(*) OVER (PARTITION BY run, scene) AS n FROM sm),
vg(run, scene, n, t, lead, got) AS (
  SELECT run, scene, any_value(n), 0, []::DOUBLE[][], []::INT[] FROM va GROUP BY run, scene
  UNION ALL
  SELECT run, scene, n, t + 1, CASE WHEN near IS NULL THEN list_append(lead, u) ELSE lead END, list_append(got, coalesce(near, len(lead) + 1)::INT)
  FROM (SELECT vg.*, va.u, (list_filter(range(1, len(vg.lead) + 1), lambda k: list_dot_product(vg.lead[k], va.u) >= {LIKE}))[1] AS near FROM vg JOIN va ON va.run = vg.run AND va.scene = vg.scene AND va.i = vg.t + 1)),
p0 AS (SELECT sm.*, printf('%s_%03d', sm.scene, got[i]) AS variant_group, row_number() OVER (PARTITION BY sm.run, sm.scene ORDER BY selection DESC, quality DESC, path) AS sr FROM sm JOIN va ON va.run = sm.run AND va.scene = sm.scene AND va.key = sm.key JOIN vg ON vg.run = sm.run AND vg.scene = sm.scene AND vg.t = va.n),
p1 AS (SELECT *, row_number() OVER (PARTITION BY run, scene, variant_group ORDER BY sr) AS k, min(sr) OVER (PARTITION BY run, scene, variant_group) AS f FROM p0),
pl AS (SELECT *, row_number() OVER (PARTITION BY run, scene ORDER BY k, f)::INT AS place FROM p1)"""
o("variant_turns", "WITH RECURSIVE {emb}, {ca}, {sm}, " + PLACE + " SELECT run, scene, key, variant_group, place FROM pl")
o("scene_turns", "WITH RECURSIVE {emb}, {ca}, {sm}, {stats}, " + quota(20) + ", " + PLACE + """,
sg AS (SELECT pl.*, q.first, CASE WHEN place <= quota THEN 0 WHEN q.role = 'cinematic' THEN 2 ELSE 1 END AS segment FROM pl JOIN quotas q USING (run, scene))
SELECT run, key, segment, row_number() OVER (PARTITION BY run ORDER BY segment, CASE WHEN segment = 0 THEN place ELSE 0 END, first, place)::INT AS turn FROM sg""")


def greedy(final: bool) -> str:
    visual, time, dup = (0.65, 9.0, 35.0) if final else (0.60, 8.0, 30.0)
    caps = {"title": 1, "map": max(1, -(-COUNT // 10)), "menu": max(2, -(-COUNT * 15 // 100))}
    shown = "len(list_filter(g.sel, lambda s: s.family = e.family))"
    vd = f"coalesce(list_min(list_transform(g.sel, lambda s: bit_count(xor(s.h, e.h)))), 64)"
    td = "coalesce(list_min(list_transform(list_filter(g.sel, lambda s: s.source = e.source), lambda s: abs(s.ts - e.ts))), e.z)"
    utility = f"""e.score + 14.0{D} / (len(list_filter(g.sel, lambda s: s.scene = e.scene)) + 1) + 12.0{D} / (len(list_filter(g.sel, lambda s: s.source = e.source)) + 1) + least(32, {vd}) * {visual}{D} + least(e.z, {td}) / e.z * {time}{D}"""
    if final:
        utility += f" - CASE WHEN e.family <> 'content' THEN {shown} * 1.5{D} ELSE 0.0{D} END"
    utility += f" - CASE WHEN {vd} < {NEAR_BITS} AND {td} < 60 THEN {dup}{D} ELSE 0.0{D} END"
    first = f"'x': (CASE e.family WHEN 'title' THEN {shown} < {caps['title']} WHEN 'map' THEN {shown} < {caps['map']} WHEN 'menu' THEN {shown} < {caps['menu']} ELSE true END), 'y': {vd} >= {NEAR_BITS}, " if final else ""
    return f"""WITH RECURSIVE {{emb}}, {{ca}},
el AS (SELECT run, key, ord, source, ts, score, h, {KEY_SCENE % 'scene'} AS scene, {family('scene')} AS family FROM ca WHERE NOT is_transition),
n AS (SELECT run, count(DISTINCT source) AS ns, count(*) AS nr FROM el GROUP BY run),
z AS (SELECT run, source, greatest(60.0{D}, (max(ts) - min(ts)) / greatest(1.0{D}, least({COUNT}, any_value(nr)){D} / any_value(ns))) AS z FROM el JOIN n USING (run) GROUP BY ALL),
e AS (SELECT * FROM el JOIN n USING (run) JOIN z USING (run, source)),
g(run, ns, nr, step, sel) AS (
  SELECT run, ns, nr, 0, []::STRUCT(key BIGINT, source INT, scene VARCHAR, family VARCHAR, h BIGINT, ts DOUBLE)[] FROM n
  UNION ALL
  SELECT g.run, g.ns, g.nr, g.step + 1, list_append(any_value(g.sel), arg_max({{'key': e.key, 'source': e.source::INT, 'scene': e.scene, 'family': e.family, 'h': e.h, 'ts': e.ts}},
    {{{first}'a': {utility}, 'b': e.score, 'c': -e.ts, 'd': -e.ord}}))
  FROM g JOIN e ON e.run = g.run
  WHERE g.step < least({COUNT}, g.nr) AND NOT list_contains(list_transform(g.sel, lambda s: s.key), e.key)
    AND (g.step >= least({COUNT}, g.ns) OR NOT list_contains(list_transform(g.sel, lambda s: s.source), e.source::INT))
  GROUP BY g.run, g.ns, g.nr, g.step)
"""


PICKED = "picked AS (SELECT run, unnest(list_transform(sel, lambda s: s.key)) AS key, unnest(range(1, len(sel) + 1))::INT AS pick FROM g WHERE step = least(" + str(COUNT) + ", nr))"
o("diverse_topk", greedy(False) + ", " + PICKED + " SELECT * FROM picked")
o("final_topk", greedy(True) + ", " + PICKED + " SELECT * FROM picked")
o("selection_report", greedy(True) + ", " + PICKED + """ SELECT run, key, row_number() OVER (PARTITION BY run ORDER BY score DESC, source, ts)::INT AS place, round(score, 2) AS score, round(ts, 6) AS ts,
lpad(lower(to_hex(CASE WHEN h < 0 THEN h::HUGEINT + 18446744073709551616::HUGEINT ELSE h::HUGEINT END)), 16, '0') AS hash FROM picked JOIN ca USING (run, key)""")
o("source_representatives", """WITH RECURSIVE {emb}, {ca},
g(run, source, step, sel) AS (
  SELECT DISTINCT run, source, 0, []::STRUCT(key BIGINT, h BIGINT)[] FROM ca
  UNION ALL
  SELECT g.run, g.source, g.step + 1, list_append(any_value(g.sel), arg_max({'key': c.key, 'h': c.h}, {'x': coalesce(list_min(list_transform(g.sel, lambda s: bit_count(xor(s.h, c.h)))), 64) >= 30, 'a': c.score, 'b': -c.ts, 'c': -c.key}))
  FROM g JOIN ca c ON c.run = g.run AND c.source = g.source WHERE g.step < 3 AND NOT list_contains(list_transform(g.sel, lambda s: s.key), c.key) GROUP BY g.run, g.source, g.step)
SELECT run, source, sel[step].key AS key, step::INT AS pick FROM g WHERE step > 0""")
o("diversity_filter", """WITH RECURSIVE {grp}, o AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY vec_id) AS i, count(*) OVER (PARTITION BY grp) AS n FROM grp),
g(grp, n, t, sel, refused) AS (
  SELECT grp, any_value(n), 0, []::STRUCT(id BIGINT, u DOUBLE[])[], []::BIGINT[] FROM o GROUP BY grp
  UNION ALL
  SELECT g.grp, g.n, g.t + 1,
    CASE WHEN len(g.sel) < least(20, g.n) AND NOT list_contains(list_transform(g.sel, lambda s: s.id), o.vec_id) AND coalesce(list_max(list_transform(g.sel, lambda s: list_dot_product(s.u, o.u))), -1.0) <= ([0.05, 0.15, 0.25])[(g.t // g.n)::INT + 1]
      THEN list_append(g.sel, {'id': o.vec_id, 'u': o.u}) ELSE g.sel END,
    CASE WHEN len(g.sel) < least(20, g.n) AND NOT list_contains(list_transform(g.sel, lambda s: s.id), o.vec_id) AND coalesce(list_max(list_transform(g.sel, lambda s: list_dot_product(s.u, o.u))), -1.0) > ([0.05, 0.15, 0.25])[(g.t // g.n)::INT + 1]
      THEN list_append(g.refused, o.vec_id) ELSE g.refused END
  FROM g JOIN o ON o.grp = g.grp AND o.i = g.t % g.n + 1 WHERE g.t < 3 * g.n),
f AS (SELECT grp, list_transform(sel, lambda s: s.id) AS ids, refused FROM g WHERE t = 3 * n)
SELECT o.grp AS run, vec_id AS key, coalesce(list_position(ids, vec_id), 0)::INT AS pick, list_contains(refused, vec_id) AND NOT list_contains(ids, vec_id) AS refused FROM o JOIN f USING (grp)""")
LEADERS = """o AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY vec_id) AS i, count(*) OVER (PARTITION BY grp) AS n FROM grp),
g(grp, n, t, lead, got) AS (
  SELECT grp, any_value(n), 0, []::DOUBLE[][], []::INT[] FROM o GROUP BY grp
  UNION ALL
  SELECT g.grp, g.n, g.t + 1, CASE WHEN near IS NULL THEN list_append(g.lead, g.u) ELSE g.lead END, list_append(g.got, coalesce(near, len(g.lead) + 1)::INT)
  FROM (SELECT g.*, o.u, (list_filter(range(1, len(g.lead) + 1), lambda k: list_dot_product(g.lead[k], o.u) >= 0.2))[1] AS near FROM g JOIN o ON o.grp = g.grp AND o.i = g.t + 1) g WHERE g.t < g.n)
, led AS (SELECT o.grp AS scene, vec_id AS key, got[i] AS leader FROM o JOIN g ON o.grp = g.grp AND g.t = g.n)"""
o("variant_groups", "WITH RECURSIVE {grp}, " + LEADERS + " SELECT * FROM led")
SHARP = "sharp AS (SELECT grp, vec_id, u, embedding[1]::DOUBLE AS quality, row_number() OVER (PARTITION BY grp ORDER BY embedding[1]::DOUBLE DESC, vec_id) AS i, count(*) OVER (PARTITION BY grp) AS n FROM grp)"
PATTERNS = """g(grp, n, t, lead, got) AS (
  SELECT grp, any_value(n), 0, []::DOUBLE[][], []::INT[] FROM sharp GROUP BY grp
  UNION ALL
  SELECT g.grp, g.n, g.t + 1, CASE WHEN near IS NULL THEN list_append(g.lead, g.u) ELSE g.lead END, list_append(g.got, coalesce(near, len(g.lead) + 1)::INT)
  FROM (SELECT g.*, s.u, (list_filter(range(1, len(g.lead) + 1), lambda k: list_dot_product(g.lead[k], s.u) >= 0.2))[1] AS near FROM g JOIN sharp s ON s.grp = g.grp AND s.i = g.t + 1) g WHERE g.t < g.n),
pattern AS (SELECT s.grp AS scene, got[i] AS leader, count(*) AS n, max(quality) AS sharpest, arg_min(vec_id, i) AS best FROM sharp s JOIN g ON s.grp = g.grp AND g.t = s.n GROUP BY ALL HAVING count(*) > 1),
often AS (SELECT *, row_number() OVER (PARTITION BY scene ORDER BY n DESC, sharpest DESC, best) AS place FROM pattern)"""
o("frequent_patterns", "WITH RECURSIVE {grp}, " + SHARP + ", " + PATTERNS + " SELECT scene, leader, n, best, place::INT AS place FROM often")
o("classification_refill", f"""WITH {{emb}}, {{ca}}, c AS (SELECT run, key, row_number() OVER w AS i, NOT is_transition AS ok, coalesce(sum((NOT is_transition)::INT) OVER (PARTITION BY run ORDER BY score DESC, key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM ca WINDOW w AS (PARTITION BY run ORDER BY score DESC, key))
SELECT run, key, i::INT AS i, ok FROM c WHERE before < {COUNT}""")
o("histogram_metrics", """WITH e AS (SELECT user_id, least(255, floor(value / 2.0))::INT AS tone FROM events), n AS (SELECT user_id, tone, count(*) AS n FROM e GROUP BY ALL), t AS (SELECT user_id, sum(n) AS t FROM n GROUP BY 1),
g AS (SELECT user_id, tone // 16 AS g, sum(n) AS n FROM n GROUP BY ALL), top AS (SELECT user_id, max(n) AS top FROM g GROUP BY 1)
SELECT user_id, round(-sum(n / t * log2(n / t)), 9) AS entropy, round(coalesce(sum(n) FILTER (tone <= 12), 0) / any_value(t), 9) AS black, round(coalesce(sum(n) FILTER (tone >= 243), 0) / any_value(t), 9) AS white, round(any_value(top) / any_value(t), 9) AS tone
FROM n JOIN t USING (user_id) JOIN top USING (user_id) GROUP BY user_id""")
o("stream_survivors", "SELECT epoch(date_trunc('hour', ts))::BIGINT AS start, event_type, count(*) FILTER (event_id % 9 <> 0) AS alive, count(*) AS n FROM events GROUP BY ALL")
o("sheet_layout", greedy(True) + ", " + PICKED + ", pl AS (SELECT run, key, row_number() OVER (PARTITION BY run ORDER BY score DESC, source, ts)::INT AS place FROM picked JOIN ca USING (run, key)) SELECT run, key, place, (place - 1) % 3 * 480 AS x, ((place - 1) // 3 * 270)::BIGINT AS y FROM pl")
o("quality_scene_join", "WITH {emb}, {ca}, {sm} SELECT event_type, max(role) AS role, avg((role = 'ordinary')::INT) AS without, count(*) AS n FROM sm GROUP BY event_type")


o("shortlist", """WITH RECURSIVE {emb}, {ca},
r AS (SELECT event_type AS run, key, value AS quality, features_id % (SELECT count(*) FROM embeddings) AS v, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, key) AS i, count(*) OVER (PARTITION BY event_type) AS n FROM ca),
u AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE)))) AS u FROM embeddings),
st(step, thr) AS (VALUES (0, 0.72::DOUBLE), (1, 0.75::DOUBLE), (2, 0.78::DOUBLE), (3, 0.82::DOUBLE), (4, 0.87::DOUBLE)),
like_ AS MATERIALIZED (SELECT a.vec_id AS v, step, list(b.vec_id) AS near FROM u a, u b, st WHERE list_dot_product(a.u, b.u) > thr GROUP BY ALL),
x AS MATERIALIZED (SELECT r.run, r.key, r.v, step * n + i AS t, coalesce(near, []) AS near FROM r CROSS JOIN st LEFT JOIN like_ USING (v, step) WHERE n > 500),
g(run, n, t, keys, vecs) AS (
  SELECT DISTINCT run, n, 0::BIGINT, []::BIGINT[], []::BIGINT[] FROM r WHERE n > 500
  UNION ALL
  SELECT g.run, g.n, g.t + 1, CASE WHEN ok THEN list_append(keys, x.key) ELSE keys END, CASE WHEN ok THEN list_append(vecs, x.v) ELSE vecs END
  FROM g JOIN x ON x.run = g.run AND x.t = g.t + 1, LATERAL (SELECT len(keys) < 500 AND NOT list_has_any(vecs, x.near) AND NOT list_contains(keys, x.key) AS ok) WHERE g.t < 5 * g.n),
f AS (SELECT run, unnest(keys) AS key, unnest(range(1, len(keys) + 1)) AS pick FROM g WHERE t = 5 * n),
p AS (SELECT r.run, r.key, CASE WHEN n > 500 THEN coalesce(pick, 1000000 + i) ELSE 0 END AS o FROM r LEFT JOIN f USING (run, key))
SELECT run, key, row_number() OVER (PARTITION BY run ORDER BY o, key)::INT AS place FROM p QUALIFY place <= 500""")
o("catalog_representatives", "WITH RECURSIVE {grp}, " + SHARP + ", " + PATTERNS + """,
dv(grp, n, t, sel) AS (
  SELECT grp, any_value(n), 0, []::STRUCT(id BIGINT, u DOUBLE[])[] FROM sharp GROUP BY grp
  UNION ALL
  SELECT dv.grp, dv.n, dv.t + 1, CASE WHEN len(dv.sel) < 24 AND coalesce(list_max(list_transform(dv.sel, lambda s: list_dot_product(s.u, sharp.u))), -1.0) <= 0.2 THEN list_append(dv.sel, {'id': sharp.vec_id, 'u': sharp.u}) ELSE dv.sel END
  FROM dv JOIN sharp ON sharp.grp = dv.grp AND sharp.i = dv.t + 1 WHERE dv.t < dv.n),
apart AS (SELECT grp, unnest(list_transform(sel, lambda s: s.id)) AS vec_id, unnest(range(1, len(sel) + 1)) AS pick FROM dv WHERE t = n),
al AS (SELECT grp, vec_id, min(n) AS n FROM (SELECT grp, vec_id, CASE WHEN i <= 8 THEN i ELSE 3000000000 + i END AS n FROM sharp UNION ALL SELECT scene, best, 1000000000 + place FROM often UNION ALL SELECT grp, vec_id, 2000000000 + pick FROM apart) GROUP BY ALL)
SELECT al.grp AS run, al.vec_id AS key, row_number() OVER (PARTITION BY al.grp ORDER BY CASE WHEN sharp.n <= 24 THEN i END, al.n)::INT AS place FROM al JOIN sharp ON sharp.grp = al.grp AND sharp.vec_id = al.vec_id QUALIFY place <= 24""")
o("scene_select", "WITH RECURSIVE {emb}, {ca}, {sm}, {stats}, " + quota(20) + ", " + PLACE + """,
sg AS (SELECT pl.*, q.first, CASE WHEN place <= quota THEN 0 WHEN q.role = 'cinematic' THEN 2 ELSE 1 END AS segment FROM pl JOIN quotas q USING (run, scene)),
tu AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY segment, CASE WHEN segment = 0 THEN place ELSE 0 END, first, place) AS turn, list_transform(features, lambda x: x::DOUBLE / sqrt(list_sum(list_transform(features, lambda y: y::DOUBLE * y::DOUBLE)))) AS u FROM sg),
st(step, thr) AS (VALUES (0, 0.1::DOUBLE), (1, 0.13::DOUBLE), (2, 0.16::DOUBLE), (3, 0.2::DOUBLE), (4, 0.25::DOUBLE)),
visits AS (SELECT run, key, u, CASE WHEN role = 'recurring_gameplay' THEN greatest(thr, 0.98::DOUBLE) ELSE thr END AS thr, row_number() OVER (PARTITION BY run ORDER BY segment = 2, step, turn) AS v, count(*) OVER (PARTITION BY run) AS n FROM tu, st),
g(run, n, v, sel) AS (
  SELECT run, any_value(n), 0, []::STRUCT(id BIGINT, u DOUBLE[])[] FROM visits GROUP BY run
  UNION ALL
  SELECT g.run, g.n, g.v + 1, CASE WHEN len(g.sel) < 20 AND NOT list_contains(list_transform(g.sel, lambda s: s.id), x.key) AND coalesce(list_max(list_transform(g.sel, lambda s: list_dot_product(s.u, x.u))), -1.0) <= x.thr THEN list_append(g.sel, {'id': x.key, 'u': x.u}) ELSE g.sel END
  FROM g JOIN visits x ON x.run = g.run AND x.v = g.v + 1 WHERE g.v < g.n)
SELECT run, unnest(list_transform(sel, lambda s: s.id)) AS key, unnest(range(1, len(sel) + 1))::INT AS pick FROM g WHERE v = n""")
