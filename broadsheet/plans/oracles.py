"""SQL for DuckDB that says what the layout queries must return. Queries are chains of common table expressions over the driver's tables."""

from __future__ import annotations

from ..functions.text import CLUSTER_STOPWORDS, STOPWORDS
from ..operators import scoring
from ..schemas import FEATURE_CLASSES, FEATURE_PARTNERS, RELATIONS, SOURCE_FEATURES
from ..sources.tables import BLOCKS_SQL


def _words(some: list[str] | tuple[str, ...]) -> str:
    return ", ".join(f"'{w}'" for w in some)


def _overlap(a1: str, a2: str, b1: str, b2: str) -> str:
    return f"(greatest(0.0::DOUBLE, least({a2}, {b2}) - greatest({a1}, {b1})) / greatest(least({a2} - {a1}, {b2} - {b1}), 1e-9::DOUBLE))"


def _gap(a1: str, a2: str, b1: str, b2: str) -> str:
    return f"greatest({b1} - {a2}, {a1} - {b2}, 0.0::DOUBLE)"


_first, _, _rest = BLOCKS_SQL.format(documents="documents").replace(" DIV ", " // ").replace("AS STRING", "AS VARCHAR").partition("SELECT concat('np_'")
#: Each entry may use those before it.
STEPS = {
    "b4": _first.strip().removeprefix("WITH ").rstrip(","),
    "blocks": f"blocks AS (SELECT concat('np_'{_rest.strip()}), p AS (SELECT *, greatest(width, 1.0) * greatest(height, 1.0) AS area, concat_ws('||', newspaper_id, CAST(image_id AS VARCHAR), page_filename) AS page_key FROM blocks)",
    "nms": """visit AS (SELECT *, row_number() OVER (PARTITION BY page_key, class_name ORDER BY confidence DESC, width DESC, height DESC, ord) AS rk FROM p),
 fold AS (
  SELECT page_key, class_name, rk, [struct_pack(ord := ord, x1 := x1, y1 := y1, x2 := x2, y2 := y2)] AS kept FROM visit WHERE rk = 1
  UNION ALL
  SELECT f.page_key, f.class_name, v.rk, CASE WHEN len(list_filter(f.kept, lambda k:
    (greatest(0.0, least(v.x2, k.x2) - greatest(v.x1, k.x1)) * greatest(0.0, least(v.y2, k.y2) - greatest(v.y1, k.y1))) > 0 AND (
    (greatest(0.0, least(v.x2, k.x2) - greatest(v.x1, k.x1)) * greatest(0.0, least(v.y2, k.y2) - greatest(v.y1, k.y1))) / ((v.x2 - v.x1) * (v.y2 - v.y1) + (k.x2 - k.x1) * (k.y2 - k.y1)
      - (greatest(0.0, least(v.x2, k.x2) - greatest(v.x1, k.x1)) * greatest(0.0, least(v.y2, k.y2) - greatest(v.y1, k.y1)))) >= 0.85::DOUBLE
    OR (greatest(0.0, least(v.x2, k.x2) - greatest(v.x1, k.x1)) * greatest(0.0, least(v.y2, k.y2) - greatest(v.y1, k.y1))) / least((v.x2 - v.x1) * (v.y2 - v.y1), (k.x2 - k.x1) * (k.y2 - k.y1)) >= 0.95::DOUBLE))) > 0
   THEN f.kept ELSE list_append(f.kept, struct_pack(ord := v.ord, x1 := v.x1, y1 := v.y1, x2 := v.x2, y2 := v.y2)) END
  FROM fold f JOIN visit v ON v.page_key = f.page_key AND v.class_name = f.class_name AND v.rk = f.rk + 1
 ),
 keep AS (SELECT unnest(list_transform(arg_max(kept, rk), lambda k: k.ord)) AS ord FROM fold GROUP BY page_key, class_name),
 n AS (SELECT p.* FROM p JOIN keep USING (ord))""",
    "ref": """refs AS (SELECT *, first_value(page_width) OVER (PARTITION BY page_key ORDER BY ord)::DOUBLE AS wide,
   class_name IN ('Text', 'List-item', 'Caption', 'Footnote') AND width <= page_width * 0.55::DOUBLE AND confidence >= 0.30::DOUBLE AS is_text, width <= page_width * 0.70::DOUBLE AS is_narrow FROM n),
 w AS (SELECT page_key, coalesce(median(greatest(width, 1.0)) FILTER (is_text), median(greatest(width, 1.0))) AS text_width,
   CASE WHEN count(*) FILTER (is_text) >= 4 THEN median(greatest(x2 - x1, 1.0)) FILTER (is_text) WHEN count(*) FILTER (is_narrow) > 0 THEN median(greatest(x2 - x1, 1.0)) FILTER (is_narrow) END AS column_width,
   CASE WHEN count(*) FILTER (is_text) >= 4 THEN 1 WHEN count(*) FILTER (is_narrow) > 0 THEN 2 ELSE 0 END AS tier FROM refs GROUP BY page_key),
 rb AS (SELECT refs.*, w.column_width FROM refs JOIN w USING (page_key) WHERE (w.tier = 1 AND is_text) OR (w.tier = 2 AND is_narrow))""",
    "columns": """i1 AS (SELECT *, max(x2) OVER (PARTITION BY page_key ORDER BY x1, x2, block_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM rb),
 i2 AS (SELECT *, CASE WHEN before IS NULL OR x1 > before + least(greatest(wide * 0.012::DOUBLE, column_width * 0.08::DOUBLE), wide * 0.018::DOUBLE) THEN 1 ELSE 0 END AS begins FROM i1),
 i3 AS (SELECT *, sum(begins) OVER (PARTITION BY page_key ORDER BY x1, x2, block_id ROWS UNBOUNDED PRECEDING) AS island FROM i2),
 i4 AS (SELECT page_key, island, min(x1) AS x1, max(x2) AS x2 FROM i3 GROUP BY 1, 2),
 i5 AS (SELECT page_key, count(*) AS n_islands FROM i4 GROUP BY 1),
 i6 AS (SELECT page_key, count(DISTINCT center_x) AS n_centers FROM rb GROUP BY 1),
 g1 AS (SELECT rb.*, center_x - lag(center_x) OVER (PARTITION BY page_key ORDER BY center_x, block_id) AS gap FROM rb),
 g2 AS (SELECT page_key, max(wide) AS wide, median(gap) FILTER (gap > 0) AS usual FROM g1 GROUP BY 1),
 g3 AS (SELECT g1.*, CASE WHEN gap > greatest(g2.wide * 0.08::DOUBLE, coalesce(usual * 3, g2.wide)) THEN 1 ELSE 0 END AS begins FROM g1 JOIN g2 USING (page_key)),
 g4 AS (SELECT *, sum(begins) OVER (PARTITION BY page_key ORDER BY center_x, block_id ROWS UNBOUNDED PRECEDING) AS part FROM g3),
 g5 AS (SELECT page_key, min(center_x) - max(column_width) / 2 AS x1, max(center_x) + max(column_width) / 2 AS x2 FROM g4 GROUP BY page_key, part),
 c0 AS (SELECT i4.page_key, x1, x2 FROM i4 JOIN i5 USING (page_key) JOIN i6 USING (page_key) WHERE NOT (n_islands <= 1 AND n_centers > 1)
   UNION ALL SELECT g5.page_key, x1, x2 FROM g5 JOIN i5 USING (page_key) JOIN i6 USING (page_key) WHERE n_islands <= 1 AND n_centers > 1
   UNION ALL SELECT page_key, 0.0, max(wide) FROM refs WHERE page_key NOT IN (SELECT page_key FROM rb) GROUP BY 1),
 c AS (SELECT page_key, CAST(row_number() OVER (PARTITION BY page_key ORDER BY x1, x2) - 1 AS INT) AS column_id, x1, x2, (x1 + x2) / 2 AS center_x FROM c0)""",
    "layout": """a0 AS (SELECT n.ord, arg_min(c.column_id, (abs(n.center_x - c.center_x), c.column_id)) AS column_id FROM n JOIN c USING (page_key) GROUP BY 1),
 l AS (SELECT n.*, a0.column_id, CAST(row_number() OVER (PARTITION BY page_key ORDER BY column_id, y1, x1, block_id) - 1 AS INT) AS reading_order_rank,
   CAST(row_number() OVER (PARTITION BY page_key ORDER BY y1, x1, block_id) - 1 AS INT) AS global_reading_rank FROM n JOIN a0 USING (ord))""",
    "near": f"""np AS (SELECT a.page_key, a AS a, b AS b, {_gap("a.y1", "a.y2", "b.y1", "b.y2")} AS vertical_gap FROM l a JOIN l b ON a.page_key = b.page_key AND a.reading_order_rank < b.reading_order_rank AND {_gap("a.y1", "a.y2", "b.y1", "b.y2")} <= 450.0),
 np2 AS (SELECT *, CASE WHEN a.y1 <= b.y1 THEN a ELSE b END AS u, CASE WHEN a.y1 <= b.y1 THEN b ELSE a END AS d FROM np),
 h AS (SELECT * FROM l WHERE class_name IN ('Section-header', 'Title') AND confidence >= 0.30::DOUBLE AND (class_name = 'Title' OR height / page_height >= 0.018::DOUBLE OR (height / page_height >= 0.012::DOUBLE AND width / page_width >= 0.20::DOUBLE)))""",
    "uncut": f"""cut AS (SELECT DISTINCT np2.a.block_id AS l_id, np2.b.block_id AS r_id FROM np2 JOIN h ON h.page_key = np2.page_key WHERE np2.a.class_name NOT IN ('Section-header', 'Title') AND np2.b.class_name NOT IN ('Section-header', 'Title')
   AND u.y2 < d.y1 AND h.y1 >= u.y2 AND h.y2 <= d.y1 AND {_overlap("h.x1", "h.x2", "u.x1", "u.x2")} >= 0.30::DOUBLE AND {_overlap("h.x1", "h.x2", "d.x1", "d.x2")} >= 0.30::DOUBLE),
 ok AS (SELECT np.* FROM np LEFT JOIN cut ON cut.l_id = np.a.block_id AND cut.r_id = np.b.block_id WHERE cut.l_id IS NULL)""",
    "bucket": f"""k0 AS (SELECT ok.*, abs(a.column_id - b.column_id) AS delta, {_overlap("a.x1", "a.x2", "b.x1", "b.x2")} AS ov, abs(b.center_x - a.center_x) AS dx, {_gap("a.x1", "a.x2", "b.x1", "b.x2")} AS hg, text_width,
   sqrt((b.center_x - a.center_x) * (b.center_x - a.center_x) + (b.center_y - a.center_y) * (b.center_y - a.center_y)) AS dist FROM ok JOIN w USING (page_key)),
 k AS (SELECT * FROM (SELECT *, CASE WHEN delta = 0 AND (ov >= 0.30::DOUBLE OR dx <= text_width * 0.40::DOUBLE) THEN 'same_column_window' WHEN delta = 0 AND hg <= text_width * 0.35::DOUBLE THEN 'adjacent_column'
   WHEN delta = 1 AND ov >= 0.80::DOUBLE AND dx <= text_width * 0.15::DOUBLE THEN 'same_column_window' WHEN delta = 1 THEN 'adjacent_column'
   WHEN a.class_name IN ('Section-header', 'Title') OR b.class_name IN ('Section-header', 'Title') OR (a.class_name IN ('Text', 'List-item', 'Caption', 'Footnote') AND b.class_name IN ('Text', 'List-item', 'Caption', 'Footnote')) THEN 'cross_column_headline_continuation' END AS source FROM k0) WHERE source IS NOT NULL)""",
    "top": """ends AS (SELECT page_key, a.block_id AS lft, b.block_id AS rgt, source, vertical_gap, delta, dist, a.block_id AS anchor, b.block_id AS other FROM k UNION ALL SELECT page_key, a.block_id, b.block_id, source, vertical_gap, delta, dist, b.block_id, a.block_id FROM k),
 ranked AS (SELECT *, row_number() OVER (PARTITION BY page_key, anchor, source ORDER BY vertical_gap, delta, round(dist, 9), other) AS rn FROM ends),
 top AS (SELECT page_key, lft, rgt, string_agg(DISTINCT source, '|' ORDER BY source) AS sources, count(DISTINCT source) AS n_sources FROM ranked WHERE rn <= CASE source WHEN 'same_column_window' THEN 3 WHEN 'adjacent_column' THEN 2 ELSE 1 END GROUP BY 1, 2, 3)""",
    "pairs": f"""pr AS (SELECT concat(a.block_id, '__PAIR__', b.block_id) AS pair_id, a.newspaper_id, a.image_id, a.page_number, a.page_filename, a.page_filename AS image_path_in_zip, a.block_id AS left_block_id, b.block_id AS right_block_id,
  a.class_name AS left_class_name, b.class_name AS right_class_name, concat(a.class_name, '__', b.class_name) AS class_pair, sources AS candidate_sources, CAST(n_sources AS INT) AS num_candidate_sources,
  a.confidence AS left_confidence, b.confidence AS right_confidence, least(a.confidence, b.confidence) AS min_yolo_confidence, (a.confidence + b.confidence) / 2 AS mean_yolo_confidence,
  a.x1 AS left_x1, a.y1 AS left_y1, a.x2 AS left_x2, a.y2 AS left_y2, b.x1 AS right_x1, b.y1 AS right_y1, b.x2 AS right_x2, b.y2 AS right_y2, a.column_id AS left_column_id, b.column_id AS right_column_id,
  b.column_id - a.column_id AS column_delta, abs(b.column_id - a.column_id) AS abs_column_delta,
  CASE abs(b.column_id - a.column_id) WHEN 0 THEN 'same_column' WHEN 1 THEN 'adjacent_column' ELSE 'cross_column' END AS column_relation,
  b.reading_order_rank - a.reading_order_rank AS reading_order_delta, b.global_reading_rank - a.global_reading_rank AS global_reading_order_delta,
  {_overlap("a.x1", "a.x2", "b.x1", "b.x2")} AS x_overlap_ratio, {_overlap("a.y1", "a.y2", "b.y1", "b.y2")} AS y_overlap_ratio, {_gap("a.x1", "a.x2", "b.x1", "b.x2")} / a.page_width AS horizontal_gap_norm, {_gap("a.y1", "a.y2", "b.y1", "b.y2")} / a.page_height AS vertical_gap_norm,
  (b.center_x - a.center_x) / a.page_width AS center_dx_norm, (b.center_y - a.center_y) / a.page_height AS center_dy_norm, abs((b.center_x - a.center_x) / a.page_width) AS abs_center_dx_norm, abs((b.center_y - a.center_y) / a.page_height) AS abs_center_dy_norm,
  sqrt(pow(b.center_x - a.center_x, 2) + pow(b.center_y - a.center_y, 2)) / sqrt(pow(a.page_width::DOUBLE, 2) + pow(a.page_height::DOUBLE, 2)) AS center_distance_norm,
  least(a.area, b.area) / greatest(a.area, b.area, 1.0) AS area_ratio, least(a.width, b.width) / greatest(a.width, b.width, 1.0) AS width_ratio, least(a.height, b.height) / greatest(a.height, b.height, 1.0) AS height_ratio
  FROM top JOIN l a ON a.page_key = top.page_key AND a.block_id = top.lft JOIN l b ON b.page_key = top.page_key AND b.block_id = top.rgt)""",
}
ROUNDED = "x_overlap_ratio y_overlap_ratio horizontal_gap_norm vertical_gap_norm center_dx_norm center_dy_norm abs_center_dx_norm abs_center_dy_norm center_distance_norm area_ratio width_ratio height_ratio".split()


def after(step: str, query: str, *more: str) -> str:
    """A query over the steps up to `step` and further expressions."""
    names = list(STEPS)
    return "WITH RECURSIVE " + ",\n ".join([*(STEPS[n] for n in names[: names.index(step) + 1]), *more]) + "\n" + query


# Text: forms that agree with Unicode regular expressions.
_NORMAL = r"lower(trim(regexp_replace(coalesce({0}, ''), '[\s\x0B\x85\p{{Z}}]+', ' ', 'g')))"


def normal(column: str) -> str:
    return _NORMAL.format(column)


def _set(found: str, stop: list[str]) -> str:
    return f"list_distinct(list_filter({found}, lambda w: len(w) >= 3 AND w NOT IN ({_words(stop)})))"


def tokens(column: str) -> str:
    return _set(f"regexp_extract_all({normal(column)}, '[a-z0-9]+')", STOPWORDS)


def cluster_tokens(column: str) -> str:
    return _set(f"regexp_extract_all(lower(coalesce({column}, '')), '[a-z0-9]+(?:-[a-z0-9]+)?')", CLUSTER_STOPWORDS)


def keywords(column: str) -> str:
    return f"list_transform(list_sort(list_transform({tokens(column)}, lambda w: struct_pack(n := -len(w), w := w)))[1:12], lambda x: x.w)"


_RUN = r"[A-Z][A-Za-z0-9&.''-]*(?:[\s\x0B\x85\p{Z}]+[A-Z][A-Za-z0-9&.''-]*){0,3}"


def entities(column: str) -> str:
    found = f"regexp_extract_all(coalesce({column}, ''), '(?:^|[^\\p{{L}}\\p{{N}}_])({_RUN})', 1)"
    return f"list_distinct(list_transform(list_filter({found}, lambda p: len(trim(p)) >= 3), lambda p: {normal('p')}))"


def joined(list_sql: str) -> str:
    return f"array_to_string(list_sort({list_sql}), '|')"


def terms(bigrams: bool, most: int | None) -> list[str]:
    """Expressions up to x, the TF-IDF weights of the kept blocks' texts."""
    words = f"tw AS (SELECT newspaper_id, block_id, regexp_extract_all({normal('ocr_text')}, '[\\p{{L}}\\p{{N}}_]{{2,}}') AS ws FROM l)"
    singles = "SELECT newspaper_id, block_id, unnest(ws) AS term FROM tw"
    pairs = " UNION ALL SELECT newspaper_id, block_id, unnest(list_transform(range(1, len(ws)), lambda i: concat(ws[i], ' ', ws[i + 1]))) FROM tw WHERE len(ws) > 1"
    counts = f"tc0 AS (SELECT newspaper_id, block_id, term, count(*) AS n FROM ({singles}{pairs if bigrams else ''}) GROUP BY 1, 2, 3)"
    if most is None:
        kept = "tc AS (SELECT * FROM tc0)"
    else:
        kept = f"tt AS (SELECT newspaper_id, term, row_number() OVER (PARTITION BY newspaper_id ORDER BY sum(n) DESC, term) AS place FROM tc0 GROUP BY 1, 2), tc AS (SELECT tc0.* FROM tc0 JOIN tt USING (newspaper_id, term) WHERE place <= {most})"
    return [
        words, counts, kept, "td AS (SELECT newspaper_id, term, count(*) AS df FROM tc GROUP BY 1, 2)", "tn AS (SELECT newspaper_id, count(*) AS nb FROM l GROUP BY 1)",
        "tr AS (SELECT tc.*, n * (ln((nb + 1) / (df + 1)) + 1) AS raw FROM tc JOIN td USING (newspaper_id, term) JOIN tn USING (newspaper_id))",
        "tl AS (SELECT newspaper_id, block_id, sqrt(sum(raw * raw)) AS norm FROM tr GROUP BY 1, 2)", "x AS (SELECT newspaper_id, block_id, term, raw / norm AS weight FROM tr JOIN tl USING (newspaper_id, block_id))",
    ]


def feature(name: str) -> str:
    if name.startswith("source__"):
        return f"CAST(contains(candidate_sources, '{name.removeprefix('source__')}') AS INT)"
    if name.startswith("column_relation_"):
        return f"CAST(column_relation = '{name.removeprefix('column_relation_')}' AS INT)"
    if name.startswith("class_pair_"):
        return f"CAST(class_pair = '{name.removeprefix('class_pair_')}' AS INT)"
    for side in ("left", "right"):
        if name.startswith(f"{side}_class_name_"):
            return f"CAST({side}_class_name = '{name.removeprefix(f'{side}_class_name_')}' AS INT)"
    return name


FLAGS = [f"source__{s}" for s in SOURCE_FEATURES] + [f"{s}_class_name_{c}" for s in ("left", "right") for c in FEATURE_CLASSES] + [f"class_pair_{a}__{b}" for a, o in FEATURE_PARTNERS.items() for b in o.split()] + [f"column_relation_{r}" for r in RELATIONS]
_TEXT = ("ocr_cosine_similarity", "text_similarity", "entity_overlap", "shared_keywords")


def logistic(text: bool = False) -> str:
    z = " + ".join([f"{scoring.BIAS}::DOUBLE", *(f"({feature(n)})::DOUBLE * ({w}::DOUBLE)" for n, w in scoring.WEIGHTS.items() if text or n not in _TEXT)])
    return f"round(1.0::DOUBLE / (1.0::DOUBLE + exp(-({z}))), 6)"


SCORED = f"sc AS (SELECT *, {logistic()} AS probability_same_article FROM pr), sd AS (SELECT *, CAST(probability_same_article >= 0.5::DOUBLE AS INT) AS prediction FROM sc)"
CLUSTERED = """e AS (SELECT left_block_id AS x, right_block_id AS y FROM sd WHERE prediction = 1 UNION SELECT right_block_id, left_block_id FROM sd WHERE prediction = 1),
 reach AS (SELECT block_id AS x, block_id AS y FROM l UNION SELECT r.x, e.y FROM reach r JOIN e ON e.x = r.y),
 root AS (SELECT x, min(y) AS root FROM reach GROUP BY 1),
 cl0 AS (SELECT root, concat('pred_', substr(md5(string_agg(x, '|' ORDER BY x)), 1, 10)) AS predicted_cluster_id, CAST(count(*) AS INT) AS predicted_cluster_size FROM root GROUP BY 1),
 cl AS (SELECT l.*, predicted_cluster_id, predicted_cluster_size FROM l JOIN root ON root.x = l.block_id JOIN cl0 USING (root))"""
ARTICLES = """ar AS (SELECT newspaper_id, predicted_cluster_id AS article_id, round(avg(confidence), 4) AS confidence, string_agg(block_id, '|' ORDER BY image_id, page_filename, block_id) AS detection_ids,
  string_agg(DISTINCT concat('page_', lpad(CAST(image_id + 1 AS VARCHAR), 3, '0')), '|' ORDER BY concat('page_', lpad(CAST(image_id + 1 AS VARCHAR), 3, '0'))) AS page_ids FROM cl GROUP BY 1, 2)"""
