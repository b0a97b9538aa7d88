"""DuckDB SQL with the same columns and rows as the queries of ``queries.py``."""

from __future__ import annotations

from functools import reduce

_SIZES = {"hue_hist": 18, "sat_hist": 8, "val_hist": 8, "dom_colours": 20, "dorsal_ventral": 9, "gabor": 24, "lbp": 10, "entropy": 2}
_SIGNAL = ["dorsal_ventral", "hue_hist", "entropy", "sat_hist"]
_FEATURES = "feats AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY feature_id ORDER BY arrived_at) AS rn FROM image_features) WHERE rn = 1)"


def _sound(field: str) -> str:
    return f"coalesce(len({field}) = {_SIZES[field]} AND len(list_filter({field}, lambda v: v IS NULL OR isnan(v) OR isinf(v))) = 0, false)"


def _where(*fields: str) -> str:
    return " AND ".join(_sound(f) for f in fields)


def _word_list(column: str) -> str:
    return rf"list_filter(regexp_split_to_array(trim(translate({column}, '_', ' ')), '\s+'), lambda w: len(w) > 0)"


def _mean(field: str, where: str = "true", key: str = "lower(trim(genus))") -> str:
    """Long form of the group means: (genus, i, m, n)."""
    return f"""(SELECT {key} AS genus, i, avg({field}[i]) AS m, count(*) AS n FROM feats, range(1, {_SIZES[field] + 1}) AS r(i)
      WHERE genus IS NOT NULL AND {_sound(field)} AND {where} GROUP BY 1, 2)"""


def _pairs(means: str, value: str = "m") -> str:
    return f"(SELECT a.genus AS a, b.genus AS b, sqrt(sum((a.{value} - b.{value}) ** 2)) AS d FROM {means} a JOIN {means} b ON a.i = b.i AND a.genus < b.genus GROUP BY 1, 2)"


_DEPTH = "depth AS (SELECT lower(split_part(tip_label, '_', 1)) AS genus, avg(branch_length) AS l FROM tree_tips GROUP BY 1)"
_PATHS = "paths AS (SELECT a.genus AS a, b.genus AS b, a.l + b.l AS d FROM depth a JOIN depth b ON a.genus < b.genus)"


def _rank(column: str) -> str:
    value = f"round({column}, 9)"
    return f"rank() OVER (ORDER BY {value}) + (count(*) OVER (PARTITION BY {value}) - 1) / 2"


def _correlations(field: str) -> str:
    return f"""(SELECT a.i - 1 AS pos, CASE WHEN stddev_pop(abs(a.m - b.m)) < 1e-10 THEN 0.0 ELSE coalesce(corr(abs(a.m - b.m), p.d), 0.0) END AS r, count(*) AS n
      FROM {_mean(field)} a JOIN {_mean(field)} b ON a.i = b.i AND a.genus < b.genus JOIN paths p ON p.a = a.genus AND p.b = b.genus GROUP BY 1)"""


_PREDICTED = "pred AS (SELECT l_suppkey, l_quantity > 25 AS predicted, l_extendedprice > 40000 AS actual, l_quantity / 50 AS score FROM lineitem)"
_COUNTS = """counts AS (SELECT l_suppkey, count(*) FILTER (predicted AND actual) AS tp, count(*) FILTER (predicted AND NOT actual) AS fp,
  count(*) FILTER (NOT predicted AND actual) AS fn, count(*) FILTER (NOT predicted AND NOT actual) AS tn FROM pred GROUP BY 1)"""


def _measures(source: str, keys: str = "l_suppkey, ") -> str:
    return f"""SELECT {keys}tp, fp, fn, tn, round(coalesce((tp + tn) / nullif(tp + fp + fn + tn, 0), 0), 4) AS accuracy, round(pr, 4) AS precision, round(rc, 4) AS recall,
      round(CASE WHEN pr + rc > 0 THEN 2 * pr * rc / (pr + rc) ELSE 0 END, 4) AS f1, round(coalesce(tp / nullif(tp + fp + fn, 0), 0), 4) AS iou
      FROM (SELECT *, coalesce(tp / nullif(tp + fp, 0), 0) AS pr, coalesce(tp / nullif(tp + fn, 0), 0) AS rc FROM {source})"""


_CURVE = """steps AS (SELECT l_suppkey % 5 AS part, score, count(*) FILTER (actual) AS pos, count(*) FILTER (NOT actual) AS neg FROM pred GROUP BY 1, 2),
curve AS (SELECT part, score, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER (PARTITION BY part) AS p, sum(neg) OVER (PARTITION BY part) AS n
  FROM steps WINDOW w AS (PARTITION BY part ORDER BY score DESC ROWS UNBOUNDED PRECEDING))"""

_NODES = """nodes AS (
  SELECT n_nationkey + 100 AS node, n_regionkey + 10 AS parent, n_name AS label, coalesce(bal, 0) AS length
  FROM nation LEFT JOIN (SELECT c_nationkey, avg(c_acctbal) / 1000 AS bal FROM customer GROUP BY 1) ON c_nationkey = n_nationkey),
regions AS (SELECT r_regionkey + 10 AS node, len(r_name) / 10 AS length FROM region),
paths AS (SELECT a.label AS a, b.label AS b, a.parent AS pa, b.parent AS pb,
    a.length + b.length + CASE WHEN a.parent = b.parent THEN 0 ELSE ra.length + rb.length END AS d
  FROM nodes a JOIN nodes b ON a.label < b.label JOIN regions ra ON ra.node = a.parent JOIN regions rb ON rb.node = b.parent)"""

_CASCADE = rf"""WITH named AS (SELECT replace(tip_label, '_', ' ') AS plain, tip_label, tip_id FROM tree_tips),
      byname AS (SELECT plain AS key, arg_min(tip_label, tip_id) AS tip FROM named GROUP BY 1), byep AS (SELECT lower(string_split(plain, ' ')[-1]) AS key, arg_min(tip_label, tip_id) AS tip FROM named GROUP BY 1),
      l AS (SELECT DISTINCT visual_label, list_filter(regexp_split_to_array(trim(visual_label), ' +'), lambda w: len(w) > 0) AS w FROM tree_tip_matching_audit WHERE visual_label IS NOT NULL),
      k AS (SELECT visual_label, array_to_string(w[-2:], ' ') AS two, lower(w[-1]) AS one, lower({_word_list('w[-1]')}[-1]) AS bare FROM l WHERE len(w) > 0)
      SELECT visual_label, coalesce(a.tip, b.tip, c.tip, d.tip) AS tip, CASE WHEN a.tip IS NOT NULL THEN 'exact' WHEN b.tip IS NOT NULL THEN 'last_two_words' WHEN c.tip IS NOT NULL THEN 'epithet_only' WHEN d.tip IS NOT NULL THEN 'epithet_underscore_stripped' ELSE 'none' END AS method
      FROM k LEFT JOIN byname a ON a.key = visual_label LEFT JOIN byname b ON b.key = two LEFT JOIN byep c ON c.key = one LEFT JOIN byep d ON d.key = bare"""

_BEST = "best AS (SELECT image_id, log_id, sam_score, strategy FROM (SELECT DISTINCT image_id, log_id, sam_score, strategy FROM annotation_log WHERE image_id IS NOT NULL AND sam_score IS NOT NULL) QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY sam_score DESC, log_id) = 1)"

_SHORT = {"Tufalsoma": "T.", "Cemildonis": "C.", "Langnatha": "L.", "Zulirsoma": "Z."}
_COLOURS = {"Tufalsoma": "#4fc3f7", "Cemildonis": "#81c784", "Langnatha": "#ffb74d", "Zulirsoma": "#ff8a65"}


def _name(group: str, i: str = "i") -> str:
    """Name of the feature at place ``i`` (from one) of a group."""
    k = f"({i} - 1)"
    listed = lambda names: "[" + ", ".join(f"'{n}'" for n in names) + f"][{i}]"
    if group in ("hue_hist", "sat_hist", "val_hist"):
        width = 10 if group == "hue_hist" else 32
        return f"printf('{group[:3]}_bin_%03d_%03d', {k} * {width}, {k} * {width} + {width})"
    names = {
        "dom_colours": [f"domcol_{b}_{c}" for b in range(5) for c in ("hue", "sat", "val")] + [f"domcol_{b}_freq" for b in range(5)],
        "dorsal_ventral": [f"{r}_{c}_mean" for r in ("dorsal", "ventral", "dv_diff") for c in ("hue", "sat", "val")],
        "gabor": [f"gabor_t{a:03d}_f{f}_{t}" for a in (0, 45, 90, 135) for f in ("0p1", "0p2", "0p4") for t in ("mean", "std")],
        "lbp": [f"lbp_bin_{b:02d}" for b in range(10)],
        "entropy": ["hue_entropy", "lbp_entropy"],
    }
    return listed(names[group])


_LOGS = ("standardization_log", "annotation_log", "extraction_log")

_GROUP_R = " UNION ALL ".join(f"SELECT '{g}' AS grp, r FROM {_correlations(g)}" for g in _SIZES)

_CARDS = """SELECT source, title, '<div><h3>' || replace(replace(replace(title, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '</h3><p>' || n || '</p></div>' AS html
      FROM (SELECT coalesce(source, '') AS source, coalesce(title, '') AS title, count(*) AS n FROM documents GROUP BY 1, 2)"""

_GENERA = ["tufalsoma", "cemildonis", "langnatha", "zulirsoma"]


def _report(source: str, tables: str, checks: list[tuple[str, str, str]]) -> str:
    """Each check's value over ``source`` with PASS, FAIL or SKIP by its condition."""
    values = ", ".join(f"CAST({value} AS DOUBLE) AS v{i}" for i, (_, value, _) in enumerate(checks))
    lines = " UNION ALL ".join(f"SELECT '{test}' AS test, CASE WHEN v{i} IS NULL THEN 'SKIP' WHEN v{i} {passes} THEN 'PASS' ELSE 'FAIL' END AS status, round(v{i}, 4) AS value FROM one" for i, (test, _, passes) in enumerate(checks))
    return f"WITH {tables}, one AS (SELECT {values} FROM {source}) {lines}"


def _anchor(part: str, field: str, value: str) -> str:
    return f"(avg({value}) FILTER (contains(lower(species), '{part}') AND {_sound(field)}))"


def _varies(field: str) -> str:
    values = lambda of: f"(sum(list_sum(list_transform({field}, lambda v: {of}))) FILTER ({_sound(field)}) / nullif(count(*) FILTER ({_sound(field)}) * {_SIZES[field]}, 0))"
    return f"{values('v * v')} - {values('v')} * {values('v')}"


_PLAIN, _PATTERNED, _STRIPED, _SMOOTH = "fudantoina", "bosilvoina", "nucungaum", "remenmeum"
_ENERGIES = "list_transform(range(12), lambda k: gabor[2 * k + 1])"
_CROWD = "len(list_filter(dom_colours[16:20], lambda v: v > 0.15))"
_CHECKS = [
    *[(f"sound_{g}", f"count(*) FILTER (NOT {_sound(g)})", "= 0") for g in _SIZES],
    ("no_nan", "sum(" + " + ".join(f"coalesce(len(list_filter({g}, lambda v: isnan(v))), 0)" for g in _SIZES) + ")", "= 0"),
    ("no_infinity", "sum(" + " + ".join(f"coalesce(len(list_filter({g}, lambda v: isinf(v))), 0)" for g in _SIZES) + ")", "= 0"),
    ("genus_given", "count(*) FILTER (genus IS NULL)", "= 0"),
    *[(f"varies_{g}", _varies(g), "> 1e-8") for g in _SIZES],
    *[(f"not_negative_{g}", f"min(list_min({g})) FILTER ({_sound(g)})", ">= -1e-6") for g in ("hue_hist", "sat_hist", "val_hist", "lbp")],
    ("positive_entropy", f"min(list_min(entropy)) FILTER ({_sound('entropy')})", "> 0"),
    ("plain_hue_entropy", _anchor(_PLAIN, "entropy", "entropy[1]"), "< 2.0"),
    ("plain_saturation", _anchor(_PLAIN, "sat_hist", "list_sum(sat_hist) / 8"), "> 0.1"),
    ("plain_yellow", _anchor(_PLAIN, "hue_hist", "hue_hist[4] + hue_hist[5] + hue_hist[6]"), "> 0.05"),
    ("smooth_hue_entropy", _anchor(_SMOOTH, "entropy", "entropy[1]"), "< 2.2"),
    ("smooth_low_saturation", _anchor(_SMOOTH, "sat_hist", "sat_hist[1]"), "> 0.0"),
    ("patterned_over_plain", f"{_anchor(_PATTERNED, 'entropy', 'entropy[1]')} - {_anchor(_PLAIN, 'entropy', 'entropy[1]')}", "> 0"),
    ("striped_peak", f"{_anchor(_STRIPED, 'gabor', f'list_max({_ENERGIES})')} - 1.2 * {_anchor(_STRIPED, 'gabor', f'list_sum({_ENERGIES}) / 12')}", "> 0"),
    ("striped_over_smooth", f"{_anchor(_STRIPED, 'gabor', 'list_sum(gabor) / 24')} - 0.8 * {_anchor(_SMOOTH, 'gabor', 'list_sum(gabor) / 24')}", "> 0"),
    ("striped_clusters", _anchor(_STRIPED, "dom_colours", _CROWD), ">= 2"),
    ("smooth_fewer_clusters", f"{_anchor(_SMOOTH, 'dom_colours', _CROWD)} - {_anchor(_STRIPED, 'dom_colours', _CROWD)}", "<= 0"),
    ("texture_entropy", f"{_anchor(_STRIPED, 'entropy', 'entropy[2]')} - 0.9 * {_anchor(_SMOOTH, 'entropy', 'entropy[2]')}", ">= 0"),
    *[(f"countershading_{k}", _anchor(v, "dorsal_ventral", "abs(dorsal_ventral[9])"), "> 0.01") for k, v in (("plain", _PLAIN), ("patterned", _PATTERNED), ("striped", _STRIPED), ("smooth", _SMOOTH))],
]

SQL = {
    "clean_filename": r"""SELECT DISTINCT log_id, upper(left(b, 1)) || substr(b, 2) AS clean, lower(regexp_extract(original_file, '(\.[^./]*)$', 1)) AS suffix
      FROM (SELECT log_id, original_file, regexp_replace(regexp_replace(string_split(original_file, '/')[-1], '\.[^.]*$', ''), '[_ ]+$', '') AS b FROM standardization_log)""",
    "path_parts": r"""SELECT DISTINCT log_id, CASE WHEN len(string_split(image_path, '/')) > 1 THEN string_split(image_path, '/')[-2] WHEN image_path IS NOT NULL THEN '' END AS folder,
      regexp_replace(string_split(image_path, '/')[-1], '\.[^.]*$', '') AS stem, lower(regexp_extract(image_path, '(\.[^./]*)$', 1)) AS suffix FROM extraction_log""",
    "clean_label": f"""SELECT species, CASE WHEN len(w) >= 3 AND w[1] = w[2] THEN left(w[1], 1) || '. ' || array_to_string(w[3:], ' ') WHEN len(w) >= 2 THEN left(w[1], 1) || '. ' || array_to_string(w[2:], ' ') ELSE species END AS short,
      w[-1] AS epithet, array_to_string(w[-2:], ' ') AS pair, w[1] AS genus, replace(translate(species, ' ', '_'), '.', '') AS newick
      FROM (SELECT DISTINCT species, {_word_list('species')} AS w FROM annotation_log WHERE species IS NOT NULL) WHERE len(w) > 0""",
    "composite_key": f"WITH {_FEATURES} SELECT genus || ' ' || species AS key, count(*) AS n FROM feats WHERE genus IS NOT NULL AND species IS NOT NULL GROUP BY 1",
    "selected_features": f"WITH {_FEATURES} SELECT feature_id, len(f) AS n, round(list_sum(f), 6) AS total, round(f[10], 6) AS tenth FROM (SELECT feature_id, {' || '.join(_SIGNAL)} AS f FROM feats WHERE {_where(*_SIGNAL)})",
    "finite_values": f"""WITH {_FEATURES} SELECT feature_id, len(list_filter(gabor, lambda v: isnan(v) OR isinf(v))) AS bad,
      round(coalesce(list_sum(list_transform(gabor, lambda v: CASE WHEN v IS NULL OR isnan(v) OR isinf(v) THEN 0.0 ELSE v END)), 0.0), 6) AS total FROM feats WHERE gabor IS NOT NULL""",
    "quality_gate": """SELECT CASE WHEN sam_score < 0.70 OR mask_area_frac < 0.10 OR mask_area_frac > 0.90 THEN 'LOW_CONFIDENCE' WHEN sam_score IS NULL THEN 'FAILED' ELSE 'OK' END AS gate,
      CASE WHEN sam_score < 0.70 THEN 'score' WHEN mask_area_frac < 0.10 THEN 'small' WHEN mask_area_frac > 0.90 THEN 'large' ELSE '' END AS reason, upper(status) AS status, count(*) AS n
      FROM (SELECT DISTINCT log_id, sam_score, mask_area_frac, status FROM annotation_log) GROUP BY 1, 2, 3""",
    "size_gate": "SELECT genus, count(*) FILTER (n_fish_pixels < 100000) AS small, count(*) FILTER (n_fish_pixels >= 100000) AS large, count(*) FILTER (n_fish_pixels IS NULL) AS missing FROM (SELECT DISTINCT log_id, genus, n_fish_pixels FROM extraction_log) GROUP BY 1",
    "binarised": "SELECT event_type, count(*) FILTER (value > 127) AS over, count(*) FILTER (value <= 127) AS under FROM events GROUP BY 1",
    "title_filter": "SELECT page_id, min(doc_id) AS first_doc, count(*) AS n, count(*) FILTER (contains(title, 'naso')) AS same_case FROM documents WHERE contains(lower(title), 'naso') GROUP BY 1",
    "square_geometry": """SELECT log_id, w, h, round(1024.0::DOUBLE / greatest(w, h), 6) AS scale, nw AS new_width, nh AS new_height, CAST(floor((1024 - nw) / 2) AS INT) AS pad_left, CAST(floor((1024 - nh) / 2) AS INT) AS pad_top
      FROM (SELECT *, CAST(round_even(w * (1024::DOUBLE / greatest(w, h)), 0) AS INT) AS nw, CAST(round_even(h * (1024::DOUBLE / greatest(w, h)), 0) AS INT) AS nh FROM
      (SELECT DISTINCT log_id, CAST(split_part(lower(original_size), 'x', 1) AS INT) AS w, CAST(split_part(lower(original_size), 'x', 2) AS INT) AS h FROM standardization_log WHERE regexp_full_match(original_size, '[0-9]+x[0-9]+')))""",
    "colour_space": """SELECT l_returnflag, round(avg(CASE WHEN span = 0 THEN 0 WHEN t < 0 THEN t + 180 ELSE t END), 4) AS hue, round(avg(CASE WHEN hi = 0 THEN 0 ELSE span * 255 / hi END), 4) AS saturation, sum(hi) AS value,
      CAST(sum(floor((r * 0.299::DOUBLE + g * 0.587::DOUBLE + b * 0.114::DOUBLE) / 255 * 255)) AS BIGINT) AS grey
      FROM (SELECT *, CASE WHEN span = 0 THEN 0 WHEN hi = r THEN (g - b) / span WHEN hi = g THEN (b - r) / span + 2 ELSE (r - g) / span + 4 END * 30 AS t FROM
      (SELECT *, greatest(r, g, b) AS hi, greatest(r, g, b) - least(r, g, b) AS span FROM
      (SELECT l_returnflag, CAST(l_quantity AS INT) * 37 % 256 AS r, CAST(l_partkey AS INT) * 13 % 256 AS g, CAST(l_suppkey AS INT) * 7 % 256 AS b FROM lineitem))) GROUP BY 1""",
    "swatch_colours": f"""WITH {_FEATURES}, c AS (SELECT feature_id, CAST(k AS INT) AS block, dom_colours[3 * k + 1] AS h, dom_colours[3 * k + 2] AS s, dom_colours[3 * k + 3] AS v FROM feats, range(5) AS r(k) WHERE {_sound('dom_colours')}),
      e AS (SELECT feature_id, block, v, CAST(floor(h * 6) AS INT) % 6 AS k, v * (1 - s) AS p, v * (1 - (h * 6 - floor(h * 6)) * s) AS q, v * (1 - (1 - (h * 6 - floor(h * 6))) * s) AS t FROM c)
      SELECT feature_id, block, round([v, q, p, p, t, v][k + 1], 6) AS r, round([t, v, v, q, p, p][k + 1], 6) AS g, round([p, p, t, v, v, q][k + 1], 6) AS b FROM e""",
    "boxes": """SELECT l_suppkey, x AS x0, y AS y0, x + w AS x1, y + h AS y1, 100.0 - (x + w) AS mirrored, CASE l_suppkey % 9 WHEN 3 THEN 180 WHEN 6 THEN 270 WHEN 8 THEN 90 ELSE 0 END AS turn
      FROM (SELECT l_suppkey, CAST(min(l_linenumber) AS DOUBLE) AS x, min(l_quantity) AS y, CAST(max(l_linenumber) - min(l_linenumber) AS DOUBLE) AS w, max(l_quantity) - min(l_quantity) AS h FROM lineitem GROUP BY 1)""",
    "histogram_entropy": f"""WITH {_FEATURES}, p AS (SELECT feature_id, list_transform(hue_hist, lambda h: h / (list_sum(hue_hist) + 1e-8) + 1e-8) AS p FROM feats WHERE {_sound('hue_hist')})
      SELECT feature_id, round(-list_sum(list_transform(p, lambda x: x / list_sum(p) * ln(x / list_sum(p)))), 6) AS entropy FROM p""",
    "feature_summary": f"WITH {_FEATURES} " + " UNION ALL ".join(f"SELECT {_name(g)} AS feature, count(*) AS n, round(avg({g}[i]), 5) AS mean, min({g}[i]) AS low, max({g}[i]) AS high FROM feats, range(1, {n + 1}) AS r(i) WHERE {_sound(g)} GROUP BY i" for g, n in _SIZES.items()),
    "annotation_join": f"WITH {_FEATURES} SELECT status, count(*) AS pairs, count(DISTINCT feature_id) AS features FROM feats JOIN (SELECT DISTINCT image_id, upper(status) AS status, log_id FROM annotation_log) n USING (image_id) GROUP BY 1".replace("SELECT status", "SELECT n.status AS status"),
    "unmatched_left_join": f"WITH {_FEATURES} SELECT image_id IS NOT NULL AND image_id IN (SELECT image_id FROM annotation_log WHERE image_id IS NOT NULL) AS noted, count(*) AS n FROM feats GROUP BY 1",
    "semi_labels": f"WITH {_FEATURES} SELECT feature_id, image_id FROM feats SEMI JOIN annotation_log USING (image_id)",
    "anti_labels": f"WITH {_FEATURES} SELECT feature_id, image_id FROM feats ANTI JOIN annotation_log USING (image_id)",
    "label_cascade": _CASCADE,
    "matching_audit": f"SELECT method, tip IS NOT NULL AS in_tree, count(*) AS n, min(visual_label) AS first_label FROM ({_CASCADE}) GROUP BY 1, 2",
    "epithet_join": f"""WITH {_FEATURES}, t AS (SELECT lower(string_split(tip_label, '_')[-1]) AS epithet, arg_min(tip_label, tip_id) AS tip_label FROM tree_tips GROUP BY 1)
      SELECT feature_id, tip_label FROM (SELECT feature_id, lower({_word_list('species')}[-1]) AS epithet FROM feats WHERE species IS NOT NULL) LEFT JOIN t USING (epithet)""",
    "aligned_labels": " INTERSECT ".join(f"SELECT lower(trim(genus)) AS genus FROM {t} WHERE genus IS NOT NULL" for t in (*_LOGS, "image_features")),
    "source_priority": """SELECT genus, arg_min(file, (source, file)) AS value, min(source) AS source FROM (
      SELECT lower(trim(genus)) AS genus, mask_path AS file, 0 AS source FROM extraction_log UNION ALL SELECT lower(trim(genus)), file_name, 1 FROM annotation_log
      UNION ALL SELECT lower(trim(genus)), original_file, 2 FROM standardization_log) WHERE genus IS NOT NULL AND file IS NOT NULL GROUP BY 1""",
    "upserted_lines": """WITH c AS (SELECT o_orderkey AS l_orderkey FROM orders WHERE o_orderstatus = 'P')
      SELECT l_orderkey, max(l_linenumber) AS lines, sum(l_quantity) AS quantity FROM lineitem ANTI JOIN c USING (l_orderkey) GROUP BY 1 UNION ALL SELECT l_orderkey, 0, 0.0 FROM c""",
    "nearest_centroid": """WITH c AS (SELECT label, i, avg(CAST(embedding[i] AS DOUBLE)) AS m FROM embeddings, range(1, 65) AS r(i) WHERE label IS NOT NULL GROUP BY 1, 2),
      g AS (SELECT vec_id, c.label, sqrt(sum((CAST(embedding[c.i] AS DOUBLE) - m) ** 2)) AS d FROM embeddings JOIN c ON true GROUP BY 1, 2)
      SELECT vec_id, arg_min(label, (d, label)) AS nearest, round(min(d), 5) AS distance FROM g GROUP BY 1""",
    "status_counts": " UNION ALL ".join(f"SELECT '{t}' AS tbl, status, count(*) AS n FROM (SELECT DISTINCT log_id, upper(status) AS status FROM {t}) GROUP BY 2" for t in _LOGS),
    "genus_counts": "SELECT genus, count(*) AS total, count(*) FILTER (status = 'OK') AS ok, count(*) FILTER (status <> 'OK') AS failed FROM (SELECT DISTINCT log_id, lower(trim(genus)) AS genus, upper(status) AS status FROM standardization_log) GROUP BY 1",
    "genus_mean_vector": f"WITH {_FEATURES} SELECT genus, count(*) AS n, " + ", ".join(f"round(avg(gabor[{i + 1}]), 5) AS m{i}" for i in range(24)) + f" FROM feats WHERE genus IS NOT NULL AND {_sound('gabor')} GROUP BY 1",
    "genus_entropy": f"WITH {_FEATURES} SELECT genus, round(avg(entropy[1]), 9) AS mean, min(entropy[1]) AS low, max(entropy[1]) AS high, count(*) AS n FROM feats WHERE genus IS NOT NULL AND {_sound('entropy')} GROUP BY 1",
    "slice_variance": f"WITH {_FEATURES} SELECT CAST((i - 1) // 6 AS INT) AS angle, round(var_pop(gabor[i]), 3) AS variance, min(gabor[i]) AS low FROM feats, range(1, 25) AS r(i) WHERE {_sound('gabor')} GROUP BY 1",
    "density_histogram": """WITH c AS (SELECT event_type, CAST(least(floor(value / 25.0), 19) AS INT) AS bin, count(*) AS n FROM events WHERE value BETWEEN 0 AND 500 GROUP BY 1, 2),
      t AS (SELECT event_type, sum(n) AS total FROM c GROUP BY 1)
      SELECT t.event_type, b.bin, coalesce(n, 0) AS n, round(coalesce(n, 0) / (total * 25.0), 9) AS density FROM t, (SELECT CAST(range AS INT) AS bin FROM range(20)) b LEFT JOIN c ON c.event_type = t.event_type AND c.bin = b.bin""",
    "cluster_frequencies": "SELECT label, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM embeddings GROUP BY 1",
    "dorsal_ventral": """WITH p AS (SELECT *, floor((min(l_linenumber) OVER w + max(l_linenumber) OVER w) / 2) AS mid FROM lineitem WHERE l_returnflag = 'R' WINDOW w AS (PARTITION BY l_suppkey)),
      m AS (SELECT l_suppkey, coalesce(avg(l_discount) FILTER (l_linenumber < mid), 0) AS uh, coalesce(avg(l_discount) FILTER (l_linenumber >= mid), 0) AS lh, coalesce(avg(l_tax) FILTER (l_linenumber < mid), 0) AS us, coalesce(avg(l_tax) FILTER (l_linenumber >= mid), 0) AS ls FROM p GROUP BY 1)
      SELECT l_suppkey, round(uh, 9) AS up_h, round(lh, 9) AS low_h, round(us, 9) AS up_s, round(ls, 9) AS low_s, round(uh - lh, 9) AS diff_h, round(us - ls, 9) AS diff_s FROM m""",
    "energy_stats": f"WITH {_FEATURES} SELECT CAST(i - 1 AS INT) AS pos, round(avg(gabor[i]), 5) AS mean, round(stddev_pop(gabor[i]), 5) AS deviation FROM feats, range(1, 25) AS r(i) WHERE {_sound('gabor')} GROUP BY 1",
    "best_filter": f"""WITH {_FEATURES}, e AS (SELECT feature_id, k, gabor[2 * k + 1] AS e FROM feats, range(12) AS r(k) WHERE {_sound('gabor')})
      SELECT feature_id, CAST(k // 3 AS INT) AS angle, CAST(k % 3 AS INT) AS frequency, e AS energy FROM e QUALIFY row_number() OVER (PARTITION BY feature_id ORDER BY e DESC, k) = 1""",
    "confusion": f"WITH {_PREDICTED}, {_COUNTS} {_measures('counts')}",
    "macro_average": f"WITH {_PREDICTED}, {_COUNTS}, m AS ({_measures('counts')}) SELECT count(*) AS n, " + ", ".join(f"round(avg({x}), 9) AS {x}" for x in ("accuracy", "precision", "recall", "f1", "iou")) + " FROM m",
    "micro_average": f"""WITH {_PREDICTED}, {_COUNTS}, s AS (SELECT CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn, CAST(sum(tn) AS BIGINT) AS tn FROM counts), m AS ({_measures('s', '')})
      SELECT * REPLACE (round(CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END, 4) AS f1) FROM m""",
    "mask_average_precision": f"WITH {_PREDICTED}, {_COUNTS}, m AS ({_measures('counts')}) SELECT l_suppkey % 5 AS part, round(avg(len(list_filter(range(10, 20), lambda k: iou >= k / 20)) / 10), 6) AS ap FROM m GROUP BY 1",
    "summary_rows": f"WITH {_PREDICTED}, {_COUNTS}, m AS ({_measures('counts')}) SELECT CAST(l_suppkey AS VARCHAR) AS name, iou, tp FROM m UNION ALL SELECT 'MACRO', round(avg(iou), 9), NULL FROM m",
    "bounding_boxes": """SELECT l_suppkey, CAST(x AS DOUBLE) AS x, y, CAST(x1 - x AS DOUBLE) AS width, y1 - y AS height, area, round(area / n, 6) AS fraction FROM (
      SELECT l_suppkey, min(l_linenumber) FILTER (l_returnflag = 'R') AS x, max(l_linenumber) FILTER (l_returnflag = 'R') AS x1, min(l_quantity) FILTER (l_returnflag = 'R') AS y, max(l_quantity) FILTER (l_returnflag = 'R') AS y1,
      count(*) FILTER (l_returnflag = 'R') AS area, count(*) AS n FROM lineitem GROUP BY 1)""",
    "duplicate_ids": "SELECT image_id, count(DISTINCT log_id) AS n FROM annotation_log WHERE image_id IS NOT NULL GROUP BY 1 HAVING count(DISTINCT log_id) > 1",
    "within_between": f"""WITH {_FEATURES}, m AS (SELECT * FROM {_mean('hue_hist', key='genus')} WHERE n >= 3),
      w AS (SELECT avg(v) AS within FROM (SELECT genus, avg(v) AS v FROM (SELECT genus, i, var_pop(hue_hist[i]) AS v FROM feats, range(1, 19) AS r(i) WHERE {_sound('hue_hist')} AND genus IN (SELECT genus FROM m) GROUP BY 1, 2) GROUP BY 1)),
      b AS (SELECT avg(d) AS between_, count(*) AS pairs FROM {_pairs('m')})
      SELECT round(within, 9) AS within, round(between_, 9) AS between, pairs, between_ > within * 0.1 AS passed FROM w, b""",
    "own_other_centroid": """WITH c AS (SELECT label, i, avg(CAST(embedding[i] AS DOUBLE)) AS m FROM embeddings, range(1, 65) AS r(i) WHERE label IS NOT NULL GROUP BY 1, 2),
      g AS (SELECT vec_id, e.label AS label, c.label AS other, sqrt(sum((CAST(embedding[c.i] AS DOUBLE) - m) ** 2)) AS d FROM embeddings e JOIN c ON true WHERE e.label IS NOT NULL GROUP BY 1, 2, 3)
      SELECT label, round(avg(d) FILTER (label = other), 5) AS own, round(avg(d) FILTER (label <> other), 5) AS other FROM g GROUP BY 1""",
    "cumulative_curve": f"WITH {_PREDICTED}, {_CURVE} SELECT part, round(score, 6) AS score, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(p AS BIGINT) AS p, CAST(n AS BIGINT) AS n FROM curve",
    "swatch_offsets": f"""WITH {_FEATURES}, s AS (SELECT feature_id, CAST(i AS INT) AS pos, dom_colours[16 + i] AS v FROM feats, range(5) AS r(i) WHERE {_sound('dom_colours')})
      SELECT feature_id, pos, round(coalesce(sum(v) OVER (PARTITION BY feature_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 6) AS offset FROM s""",
    "average_rank": "SELECT o_orderkey, rank() OVER (PARTITION BY o_orderpriority ORDER BY p) + (count(*) OVER (PARTITION BY o_orderpriority, p) - 1) / 2 AS rank FROM (SELECT *, round(o_totalprice / 1000) * 1000 AS p FROM orders)",
    "row_index": "SELECT doc_id, page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY rev_no NULLS FIRST, doc_id) - 1 AS INT) AS place FROM documents",
    "top_orders": "SELECT o_orderkey, c_name, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey ORDER BY o_totalprice DESC, o_orderkey LIMIT 20",
    "percentiles": "SELECT event_type, round(quantile_cont(value, 0.99), 6) AS p99, round(quantile_cont(value, 0.5), 6) AS median FROM events GROUP BY 1",
    "best_annotation": "SELECT image_id, log_id, sam_score, strategy FROM (SELECT DISTINCT image_id, log_id, sam_score, strategy FROM annotation_log WHERE image_id IS NOT NULL AND sam_score IS NOT NULL) QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY sam_score DESC, log_id) = 1",
    "sorted_species": "SELECT DISTINCT genus || species AS name FROM extraction_log WHERE genus IS NOT NULL AND species IS NOT NULL",
    "label_difference": """WITH a AS (SELECT DISTINCT species FROM extraction_log WHERE species IS NOT NULL), b AS (SELECT DISTINCT species FROM annotation_log WHERE species IS NOT NULL)
      SELECT species, 'extraction' AS side FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT species, 'annotation' FROM (SELECT * FROM b EXCEPT SELECT * FROM a)""",
    "hash_sample": "SELECT l_returnflag, k, CAST(place AS INT) AS place FROM (SELECT l_returnflag, k, row_number() OVER (PARTITION BY l_returnflag ORDER BY md5(k || '_42'), k) AS place FROM (SELECT DISTINCT l_returnflag, l_orderkey || '-' || l_linenumber || '-' || l_partkey AS k FROM lineitem)) WHERE place <= 200",
    "stratified_split": """SELECT doc_id, stratum, CASE WHEN place < 0.70 THEN 'train' WHEN place < 0.85 THEN 'validation' ELSE 'test' END AS split FROM (
      SELECT doc_id, stratum, (row_number() OVER (PARTITION BY stratum ORDER BY md5(doc_id || '_42'), doc_id) - 1)::DOUBLE / count(*) OVER (PARTITION BY stratum) AS place FROM (SELECT doc_id, coalesce(source, '') AS stratum FROM documents))""",
    "standardised": f"WITH {_FEATURES}, s AS (SELECT * FROM feats WHERE {_sound('gabor')}) SELECT feature_id, " + ", ".join(f"round((gabor[{i + 1}] - avg(gabor[{i + 1}]) OVER ()) / CASE WHEN stddev_pop(gabor[{i + 1}]) OVER () > 0 THEN stddev_pop(gabor[{i + 1}]) OVER () ELSE 1 END, 5) AS z{i}" for i in range(24)) + " FROM s",
    "genus_distances": f"WITH {_FEATURES} SELECT a, b, round(d, 5) AS d FROM {_pairs(_mean('gabor'))}",
    "distance_range": f"WITH {_FEATURES} SELECT round(min(d), 8) AS low, round(max(d), 8) AS high, round(min(d) FILTER (d > 0), 8) AS low_positive, count(*) AS pairs FROM {_pairs(_mean('hue_hist'))}",
    "selected_distances": f"""WITH {_FEATURES}, m AS (SELECT lower(trim(genus)) AS genus, i, avg(f[i]) AS m FROM (SELECT genus, {' || '.join(_SIGNAL)} AS f FROM feats WHERE genus IS NOT NULL AND {_where(*_SIGNAL)}), range(1, 38) AS r(i) GROUP BY 1, 2),
      z AS (SELECT genus, i, (m - avg(m) OVER w) / CASE WHEN stddev_pop(m) OVER w > 0 THEN stddev_pop(m) OVER w ELSE 1 END AS m FROM m WINDOW w AS (PARTITION BY i)) SELECT a, b, round(d, 4) AS d FROM {_pairs('z')}""",
    "pearson": "SELECT l_returnflag, round(corr(l_quantity, l_extendedprice), 6) AS r, count(*) AS n FROM lineitem GROUP BY 1",
    "spearman": """WITH e AS (SELECT event_type, value, user_id % 50 AS u FROM events), r AS (SELECT event_type,
      rank() OVER (PARTITION BY event_type ORDER BY value) + (count(*) OVER (PARTITION BY event_type, value) - 1) / 2 AS rx, rank() OVER (PARTITION BY event_type ORDER BY u) + (count(*) OVER (PARTITION BY event_type, u) - 1) / 2 AS ry FROM e)
      SELECT event_type, round(corr(rx, ry), 6) AS rho FROM r GROUP BY 1""",
    "mantel": f"""WITH {_FEATURES}, {_DEPTH}, {_PATHS}, vis AS {_pairs(_mean('gabor'))}, plain AS (SELECT v.a, v.b, v.d AS v, p.d AS p FROM vis v JOIN paths p ON v.a = p.a AND v.b = p.b),
      both_ AS (SELECT a, b, v, p, {_rank('v')} AS rv, {_rank('p')} AS rp FROM plain),
      base AS (SELECT corr(v, p) AS r, corr(rv, rp) AS rho, count(*) AS m, avg(v) AS mv, avg(p) AS mp, stddev_pop(v) AS sv, stddev_pop(p) AS sp, avg(rv) AS mrv, stddev_pop(rv) AS srv, avg(rp) AS mrp, stddev_pop(rp) AS srp FROM both_),
      ks AS (SELECT k, row_number() OVER (ORDER BY k) AS rn FROM (SELECT a AS k FROM both_ UNION SELECT b FROM both_)),
      perms AS (SELECT perm, k, row_number() OVER (PARTITION BY perm ORDER BY md5(perm || '_' || k)) AS pos FROM ks, range(1, 100) AS r(perm)),
      other AS (SELECT perm, perms.k AS k, ks.k AS o FROM perms JOIN ks ON ks.rn = perms.pos),
      moved AS (SELECT x.perm, b.p, b.rp, least(x.o, y.o) AS lo, greatest(x.o, y.o) AS hi FROM both_ b JOIN other x ON x.k = b.a JOIN other y ON y.k = b.b AND y.perm = x.perm),
      sums AS (SELECT perm, sum(v.v * moved.p) AS vp, sum(v.rv * moved.rp) AS rvp FROM moved JOIN both_ v ON v.a = lo AND v.b = hi GROUP BY 1),
      nul AS (SELECT r, rho, m, (vp - m * mv * mp) / (m * sv * sp) AS nr, (rvp - m * mrv * mrp) / (m * srv * srp) AS nrho FROM sums, base)
      SELECT round(r, 5) AS r, round((count(*) FILTER (round(nr, 9) >= round(r, 9)) + 1) / 100, 6) AS p, round(rho, 5) AS rho, round((count(*) FILTER (round(nrho, 9) >= round(rho, 9)) + 1) / 100, 6) AS rho_p,
      m AS pairs, round((1.645 + 0.842) / sqrt(m - 3), 6) AS least_r FROM nul GROUP BY r, rho, m""",
    "feature_correlations": f"WITH {_FEATURES}, {_DEPTH}, {_PATHS} SELECT CAST(pos AS INT) AS pos, round(r, 5) AS r, n FROM {_correlations('gabor')}",
    "group_mean_r": f"WITH {_FEATURES}, {_DEPTH}, {_PATHS} SELECT grp, round(avg(r), 5) AS mean_r, round(stddev_samp(r), 5) AS deviation, count(*) FILTER (r < 0) AS negative FROM (" + _GROUP_R + ") GROUP BY 1",
    "roc_auc": f"""WITH {_PREDICTED}, {_CURVE}, x AS (SELECT part, score, fp / nullif(n, 0) AS x, tp / nullif(p, 0) AS y FROM curve),
      l AS (SELECT part, x, y, coalesce(lag(x) OVER w, 0) AS px, coalesce(lag(y) OVER w, 0) AS py FROM x WINDOW w AS (PARTITION BY part ORDER BY score DESC)) SELECT part, round(coalesce(sum((x - px) * (y + py) / 2), 0.5), 6) AS auc FROM l GROUP BY 1""",
    "pr_area": f"""WITH {_PREDICTED}, {_CURVE}, x AS (SELECT part, score, tp / nullif(p, 0) AS x, tp / (tp + fp) AS y FROM curve),
      l AS (SELECT part, x, y, coalesce(lag(x) OVER w, 0) AS px, coalesce(lag(y) OVER w, 1) AS py FROM x WINDOW w AS (PARTITION BY part ORDER BY score DESC)) SELECT part, round(coalesce(sum((x - px) * (y + py) / 2), 0), 6) AS ap FROM l GROUP BY 1""",
    "validation_report": _report("feats", _FEATURES, _CHECKS),
    "tree_tips_sorted": f"WITH {_NODES} SELECT label, round(length, 9) AS length FROM nodes",
    "patristic": f"WITH {_NODES} SELECT a, b, round(d, 9) AS d FROM paths",
    "region_distances": f"WITH {_NODES} SELECT pa = pb AS same, round(avg(d), 9) AS mean, round(min(d), 9) AS low FROM paths GROUP BY 1",
    "pruned_tree": f"""WITH {_NODES}, k AS (SELECT DISTINCT n_name AS label FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_acctbal > 9000),
      t AS (SELECT nodes.*, count(*) OVER (PARTITION BY parent) AS same FROM nodes SEMI JOIN k USING (label)), f AS (SELECT count(DISTINCT parent) AS n FROM t)
      SELECT label, CASE WHEN same > 1 THEN parent WHEN n > 1 THEN 1 END AS parent, CASE WHEN same > 1 THEN round(t.length, 9) WHEN n > 1 THEN round(t.length + regions.length, 9) END AS length FROM t, f, regions WHERE regions.node = t.parent""",
    "robinson_foulds": f"""WITH {_NODES}, first_ AS (SELECT min(label) AS l, count(*) AS n FROM nodes),
      side AS (SELECT 0 AS tree, parent AS p, label FROM nodes UNION ALL SELECT 1, coalesce(c, 0) % 5 + 10, label FROM nodes LEFT JOIN (SELECT c_nationkey + 100 AS node, count(*) AS c FROM customer GROUP BY 1) USING (node)),
      grp AS (SELECT tree, p, list_sort(list(label)) AS s FROM side GROUP BY 1, 2), every_ AS (SELECT list_sort(list(label)) AS e FROM nodes),
      split AS (SELECT DISTINCT tree, array_to_string(CASE WHEN list_contains(s, l) THEN list_filter(e, lambda x: NOT list_contains(s, x)) ELSE s END, '|') AS split FROM grp, every_, first_ WHERE len(s) > 1 AND len(e) - len(s) > 1)
      SELECT distance, round(distance / (2 * (n - 3)), 6) AS share FROM first_, (SELECT count(*) AS distance FROM (SELECT split FROM split GROUP BY 1 HAVING count(*) = 1))""",
    "html_report": _CARDS,
    "event_windows": "SELECT date_trunc('hour', ts) AS start, count(*) FILTER (value < 50) AS low, count(*) FILTER (value BETWEEN 50 AND 400) AS ok, count(*) FILTER (value > 400) AS high FROM events GROUP BY 1",
    "flattened_pixels": """WITH p AS (SELECT l_returnflag, CAST(l_quantity AS INT) * 37 % 256 AS r, CAST(l_partkey AS INT) * 13 % 256 AS g, CAST(l_suppkey AS INT) * 7 % 256 AS b, l_linenumber * 41 % 256 AS a FROM lineitem),
      f AS (SELECT l_returnflag, CAST(round((r * a + 255 * (255 - a)) / 255.0) AS BIGINT) AS r, CAST(round((g * a + 255 * (255 - a)) / 255.0) AS BIGINT) AS g, CAST(round((b * a + 255 * (255 - a)) / 255.0) AS BIGINT) AS b FROM p),
      l AS (SELECT *, (r * 19595 + g * 38470 + b * 7471 + 32768) // 65536 AS l FROM f)
      SELECT l_returnflag, CAST(sum(r) AS BIGINT) AS r, CAST(sum(g) AS BIGINT) AS g, CAST(sum(b) AS BIGINT) AS b, CAST(sum(l) AS BIGINT) AS l, count(*) FILTER (l > 127) AS inside FROM l GROUP BY 1""",
    "normalised_colours": """SELECT l_returnflag, round(avg(CASE WHEN span = 0 THEN 0 WHEN t < 0 THEN t + 180 ELSE t END / 180.0), 5) AS h, round(avg(CASE WHEN hi = 0 THEN 0 ELSE span * 255 / hi END / 255.0), 5) AS s, round(avg(hi / 255.0), 5) AS v
      FROM (SELECT *, CASE WHEN span = 0 THEN 0 WHEN hi = r THEN (g - b) / span WHEN hi = g THEN (b - r) / span + 2 ELSE (r - g) / span + 4 END * 30 AS t FROM
      (SELECT *, greatest(r, g, b) AS hi, greatest(r, g, b) - least(r, g, b) AS span FROM
      (SELECT l_returnflag, CAST(l_quantity AS INT) * 37 % 256 AS r, CAST(l_partkey AS INT) * 13 % 256 AS g, CAST(l_suppkey AS INT) * 7 % 256 AS b FROM lineitem))) GROUP BY 1""",
    "short_names": "SELECT tip_id, " + reduce(lambda text, pair: f"replace(replace({text}, '{pair[0]}_', '{pair[1]}'), '{pair[0]} ', '{pair[1]}')", _SHORT.items(), "tip_label") + " AS name FROM tree_tips",
    "genus_colours": "SELECT tip_id, split_part(tip_label, '_', 1) AS genus, CASE split_part(tip_label, '_', 1) " + " ".join(f"WHEN '{g}' THEN '{c}'" for g, c in _COLOURS.items()) + " ELSE '#666677' END AS colour FROM tree_tips",
    "percent_shares": "SELECT status, n, printf('%.1f%%', n * 100.0::DOUBLE / sum(n) OVER ()) AS share FROM (SELECT status, count(*) AS n FROM (SELECT DISTINCT log_id, upper(status) AS status FROM annotation_log) GROUP BY 1)",
    "aligned_distances": f"""WITH {_FEATURES}, {_DEPTH}, {_PATHS}, o AS (SELECT lower(split_part(tip_label, '_', 1)) AS k, min(tip_id) AS place FROM tree_tips GROUP BY 1)
      SELECT oa.place AS pa, ob.place AS pb, v.a AS a, v.b AS b, round(v.d, 5) AS d, round(p.d, 9) AS p FROM {_pairs(_mean('gabor'))} v JOIN paths p ON p.a = v.a AND p.b = v.b JOIN o oa ON oa.k = v.a JOIN o ob ON ob.k = v.b""",
    "remaining_images": f"WITH {_FEATURES} SELECT feature_id, image_id FROM feats WHERE image_id IS NOT NULL AND image_id NOT IN (SELECT image_id FROM annotation_log WHERE upper(status) = 'OK' AND image_id IS NOT NULL)",
    "continued_log": f"""WITH {_FEATURES}, {_BEST} SELECT image_id, log_id, strategy, NULL::VARCHAR AS status FROM best UNION ALL
      SELECT DISTINCT image_id, NULL::BIGINT, NULL::VARCHAR, 'NEW' FROM feats WHERE image_id IS NOT NULL AND image_id NOT IN (SELECT image_id FROM best)""",
    "upserted_annotations": f"""WITH {_FEATURES}, {_BEST}, c AS (SELECT DISTINCT image_id FROM feats WHERE image_id IS NOT NULL)
      SELECT log_id, best.image_id AS image_id, sam_score, CASE WHEN c.image_id IS NOT NULL THEN 'again' ELSE strategy END AS strategy FROM best LEFT JOIN c ON c.image_id = best.image_id UNION ALL
      SELECT (SELECT max(log_id) FROM best) + row_number() OVER (ORDER BY image_id), image_id, NULL, 'again' FROM c WHERE image_id NOT IN (SELECT image_id FROM best)""",
    "strongest_group": f"WITH {_FEATURES}, {_DEPTH}, {_PATHS} SELECT grp, round(mean_r, 5) AS mean_r FROM (SELECT grp, avg(r) AS mean_r FROM (" + _GROUP_R + ") GROUP BY 1) ORDER BY round(mean_r, 9) DESC, grp DESC LIMIT 1",
    "ordered_distances": f"WITH {_FEATURES}, p AS {_pairs(_mean('gabor'))} SELECT a, b, round(d, 5) AS d FROM p UNION ALL SELECT b, a, round(d, 5) FROM p UNION ALL SELECT DISTINCT genus, genus, 0.0 FROM {_mean('gabor')}",
    "html_report_cards": _CARDS,
    "summary_document": """SELECT to_json({'n': CAST(sum(n) AS BIGINT), 'by_status': list({'status': status, 'n': n} ORDER BY status)})::VARCHAR AS document
      FROM (SELECT status, count(*) AS n FROM (SELECT DISTINCT log_id, upper(status) AS status FROM annotation_log) GROUP BY 1)""",
    "csv_round_trip": f"WITH {_FEATURES} SELECT feature_id, round(entropy[1], 6) AS hue_entropy, round(entropy[2], 6) AS lbp_entropy FROM feats WHERE {_sound('entropy')}",
    "json_round_trip": "SELECT DISTINCT log_id, n_fish_pixels, status FROM extraction_log",
    "list_round_trip": "SELECT DISTINCT CAST(image_id AS BIGINT) AS id FROM annotation_log WHERE image_id IS NOT NULL",
    "matrix_round_trip": f"WITH {_FEATURES} SELECT a, b, round(d, 5) AS d FROM {_pairs(_mean('gabor'))}",
    "tree_round_trip": f"WITH {_DEPTH} SELECT genus AS label, round(l, 6) AS length FROM depth",
    "annotation_document": f"WITH {_BEST}, i AS (SELECT image_id, min(file_name) AS file_name FROM annotation_log WHERE image_id IS NOT NULL GROUP BY 1) SELECT CAST(image_id AS BIGINT) AS image_id, file_name, log_id AS note, round(sam_score, 6) AS area FROM best JOIN i USING (image_id)",
    "image_round_trip": "SELECT 's' || s_suppkey AS name, 5 AS pixels, CAST(s_suppkey * 37 % 256 * 5 AS BIGINT) AS r, CAST(s_suppkey * 13 % 256 * 5 AS BIGINT) AS g, CAST(s_suppkey * 7 % 256 * 5 AS BIGINT) AS b FROM supplier",
    "genus_validation": _report("r, w", f"""{_FEATURES}, r AS (SELECT lower(trim(genus)) AS genus, {' || '.join(_SIGNAL)} AS f FROM feats WHERE {_where(*_SIGNAL)} AND lower(trim(genus)) IN ({', '.join(f"'{g}'" for g in _GENERA)})),
      m AS (SELECT genus, list(m ORDER BY i) AS m FROM (SELECT genus, i, avg(f[i]) AS m FROM r, range(1, 38) AS x(i) GROUP BY 1, 2) GROUP BY 1),
      w AS (SELECT {', '.join(f"max(m) FILTER (genus = '{g}') AS m{i}" for i, g in enumerate(_GENERA))} FROM m)""", [
        ("genera_differ", "max(list_distance(m0, m1))", "> 0.1"), ("closer_than_third", "max(list_distance(m0, m1) - list_distance(m0, m2))", "< 0"), ("closer_than_fourth", "max(list_distance(m0, m1) - list_distance(m0, m3))", "< 0"),
        ("own_centre", f"avg(list_distance(f, m2)) FILTER (genus = '{_GENERA[2]}') - avg(list_distance(f, m3)) FILTER (genus = '{_GENERA[2]}')", "< 0"),
    ]),
    "closest_species": rf"""WITH {_FEATURES}, r AS (SELECT lower(trim(genus)) AS genus, lower(regexp_replace(species, '[^\p{{L}}]+', '', 'g')) AS name, {' || '.join(_SIGNAL)} AS f FROM feats WHERE species IS NOT NULL AND {_where(*_SIGNAL)} AND lower(trim(genus)) IN ({', '.join(f"'{g}'" for g in _GENERA)})),
      m AS (SELECT genus, name, i, avg(f[i]) AS m FROM r, range(1, 38) AS x(i) GROUP BY 1, 2, 3),
      p AS (SELECT a.genus AS genus, a.name AS a, b.name AS b, round(sqrt(sum((a.m - b.m) ** 2)), 6) AS d FROM m a JOIN m b ON a.genus = b.genus AND a.i = b.i AND a.genus || '|' || a.name < b.genus || '|' || b.name GROUP BY 1, 2, 3)
      SELECT genus, arg_min(a, (d, a, b)) AS first, arg_min(b, (d, a, b)) AS second, round(min(d), 4) AS d, min(d) > 0.01 AS differ FROM p GROUP BY 1""",
}
