"""Registered queries of the layout engine over the driver's tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import articles, blocks, candidates, clustering, jobs, layout, pair_text, scoring
from ..schemas import FEATURES, PAIR_COLUMNS
from ..sources import images, sinks, tables
from . import oracles as O
from .run import Config, run
from ..settle import new_path, settled

Query = Callable[[SparkSession, str], DataFrame]
_found: dict[str, tuple[Query, str | None]] = {}


def _query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _found[name] = (f, sql)
        return f

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _detected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.derived_blocks(_table(spark, sf_dir, "documents"))


def _prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks.prepare(_detected(spark, sf_dir))


def _kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks.suppress(_prepared(spark, sf_dir).drop("bbox", "ocr_text"))


def _settled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return settled(_kept(spark, sf_dir))


def _geometry_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return settled(layout.annotate(_settled(spark, sf_dir)))


def _texts(spark: SparkSession, sf_dir: str, placed: DataFrame) -> DataFrame:
    """The annotated blocks' texts, which take no part in the layout."""
    return placed.select("newspaper_id", "block_id", "ord").join(_detected(spark, sf_dir).select("block_id", "ord", "ocr_text"), ["block_id", "ord"])


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return candidates.pairs(_geometry_layout(spark, sf_dir))


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.score(_pairs(spark, sf_dir))


def _run(spark: SparkSession, sf_dir: str, text: bool = False, **config):
    """text: pairs are scored with their text features, else by geometry alone, as the SQL of the queries that have one does."""
    return run(_detected(spark, sf_dir).drop("bbox", *([] if text else ["ocr_text"])), Config(text=text, **config))


def r6(name: str) -> Column:
    return F.round(name, 6).alias(name)


def _sql6(names: list[str] | tuple[str, ...]) -> str:
    return ", ".join(f"round({c}, 6) AS {c}" for c in names)


_BLOCK = "newspaper_id, image_id, page_number, page_filename, block_id, page_width, page_height, class_id, class_name, confidence, x1, y1, x2, y2, width, height, center_x, center_y, area, page_key"


@_query("blocks_prepare", O.after("blocks", f"SELECT {_BLOCK}, ord FROM p"))
def _(spark, sf_dir):
    return _prepared(spark, sf_dir).select(*_BLOCK.split(", "), "ord")


@_query("nms_suppress", O.after("nms", "SELECT block_id, class_name, page_key, confidence, x1, y1, x2, y2, ord FROM n"))
def _(spark, sf_dir):
    return _kept(spark, sf_dir).select("block_id", "class_name", "page_key", "confidence", "x1", "y1", "x2", "y2", "ord")


@_query("layout_reference_width", O.after("ref", "SELECT page_key, round(text_width, 6) AS text_width, round(column_width, 6) AS column_width, CAST(tier AS INT) AS tier FROM w"))
def _(spark, sf_dir):
    return layout.reference_widths(_settled(spark, sf_dir)).select("page_key", r6("text_width"), r6("column_width"), "tier")


@_query("layout_columns", O.after("columns", f"SELECT page_key, column_id, {_sql6(['x1', 'x2', 'center_x'])} FROM c"))
def _(spark, sf_dir):
    return layout.columns(_settled(spark, sf_dir)).select("page_key", "column_id", *map(r6, ("x1", "x2", "center_x")))


@_query("layout_center_split", O.after("columns", f"SELECT page_key, {_sql6(['x1', 'x2'])} FROM g5"))
def _(spark, sf_dir):
    return layout.center_groups(layout.reference_blocks(layout.with_reference(_settled(spark, sf_dir)))).select("page_key", r6("x1"), r6("x2"))


@_query("column_assign", O.after("layout", "SELECT block_id, column_id FROM l"))
def _(spark, sf_dir):
    return _geometry_layout(spark, sf_dir).select("block_id", "column_id")


@_query("reading_order", O.after("layout", "SELECT block_id, reading_order_rank FROM l"))
def _(spark, sf_dir):
    return _geometry_layout(spark, sf_dir).select("block_id", "reading_order_rank")


@_query("global_order", O.after("layout", "SELECT block_id, global_reading_rank FROM l"))
def _(spark, sf_dir):
    return _geometry_layout(spark, sf_dir).select("block_id", "global_reading_rank")


@_query("headline_boundaries", O.after("near", "SELECT block_id, class_name, confidence, y1, y2 FROM h"))
def _(spark, sf_dir):
    return candidates.boundaries(_geometry_layout(spark, sf_dir)).select("block_id", "class_name", "confidence", "y1", "y2")


def _ends() -> tuple[Column, Column]:
    return F.col("a.block_id").alias("left_block_id"), F.col("b.block_id").alias("right_block_id")


@_query("pair_all_gap", O.after("near", "SELECT a.block_id AS left_block_id, b.block_id AS right_block_id, round(vertical_gap, 6) AS vertical_gap FROM np"))
def _(spark, sf_dir):
    return candidates.near_pairs(_geometry_layout(spark, sf_dir)).select(*_ends(), r6("vertical_gap"))


@_query("pair_boundary_blocked", O.after("uncut", "SELECT l_id AS left_block_id, r_id AS right_block_id FROM cut"))
def _(spark, sf_dir):
    some = _geometry_layout(spark, sf_dir)
    return candidates.uncut(candidates.near_pairs(some), some, blocked=True).select(*_ends())


@_query("pair_buckets", O.after("bucket", "SELECT a.block_id AS left_block_id, b.block_id AS right_block_id, delta AS column_delta, source, round(dist, 6) AS center_distance FROM k"))
def _(spark, sf_dir):
    some = _geometry_layout(spark, sf_dir)
    found = candidates.buckets(candidates.uncut(candidates.near_pairs(some), some))
    return found.select(*_ends(), "column_delta", "source", r6("center_distance"))


@_query("candidate_topk", O.after("top", "SELECT page_key, lft AS left_block_id, rgt AS right_block_id, sources, CAST(n_sources AS INT) AS n_sources FROM top"))
def _(spark, sf_dir):
    some = _geometry_layout(spark, sf_dir)
    found = candidates.buckets(candidates.uncut(candidates.near_pairs(some), some))
    return candidates.top(found).select("page_key", F.col("left").alias("left_block_id"), F.col("right").alias("right_block_id"), F.array_join("sources", "|").alias("sources"), F.size("sources").alias("n_sources"))


_EMPTY = ("left_article_id", "right_article_id", "label")
_CONSTANT = {c: "0.0::DOUBLE" for c in ("left_article_id_confidence", "right_article_id_confidence", "min_article_id_confidence", "mean_article_id_confidence")}
_CONSTANT |= {c: "false" for c in ("left_article_ambiguous", "right_article_ambiguous", "hard_negative")} | {"label_reason": "'production_unknown'"} | {c: "CAST(NULL AS VARCHAR)" for c in _EMPTY}


@_query("pair_geometry", O.after("pairs", "SELECT " + ", ".join(f"{_CONSTANT[c]} AS {c}" if c in _CONSTANT else f"round({c}, 6) AS {c}" if c in O.ROUNDED else c for c in PAIR_COLUMNS) + " FROM pr"))
def _(spark, sf_dir):
    return _pairs(spark, sf_dir).select(*(r6(c) if c in O.ROUNDED else c for c in PAIR_COLUMNS))


@_query(
    "crop_boxes",
    O.after(
        "blocks",
        "SELECT block_id, CAST(greatest(floor(x1) - 6, 0) AS INT) AS \"left\", CAST(greatest(floor(y1) - 6, 0) AS INT) AS top, CAST(least(ceil(x2) + 6, page_width) AS INT) AS \"right\", CAST(least(ceil(y2) + 6, page_height) AS INT) AS bottom, false AS too_small FROM p",
    ),
)
def _(spark, sf_dir):
    return blocks.crops(_prepared(spark, sf_dir))


def _docs(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", "text")


@_query("text_normalize", f"SELECT doc_id, md5({O.normal('text')}) AS hash, len({O.normal('text')}) AS n FROM documents")
def _(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", X.normalize("text").alias("t")).select("doc_id", F.md5(F.encode("t", "utf-8")).alias("hash"), F.length("t").cast("long").alias("n"))


for _name, _make, _make_sql in (("text_tokens", X.tokens, O.tokens), ("text_keywords", X.keywords, O.keywords), ("text_entities", X.entities, O.entities), ("cluster_tokens", X.cluster_tokens, O.cluster_tokens)):
    _query(_name, f"SELECT doc_id, md5({O.joined(_make_sql('text'))}) AS hash, len({_make_sql('text')}) AS n FROM documents")(
        lambda spark, sf_dir, make=_make: _docs(spark, sf_dir).select("doc_id", make("text").alias("found")).select("doc_id", F.md5(F.encode(F.array_join(F.sort_array("found"), "|"), "utf-8")).alias("hash"), F.size("found").cast("long").alias("n"))
    )


def _sides(spark, sf_dir, make) -> DataFrame:
    placed = _geometry_layout(spark, sf_dir)
    own = _texts(spark, sf_dir, placed).select("block_id", make("ocr_text").alias("found"))
    sides = [own.select(F.col("block_id").alias(f"{s}_block_id"), F.col("found").alias(s)) for s in ("left", "right")]
    return candidates.pairs(placed).select("pair_id", "left_block_id", "right_block_id").join(sides[0], "left_block_id").join(sides[1], "right_block_id")


def _sides_sql(make: str, query: str) -> str:
    return O.after("pairs", query, f"s AS (SELECT block_id, {make} AS found FROM l)", "b AS (SELECT pair_id, x.found AS lf, y.found AS rf FROM pr JOIN s x ON x.block_id = left_block_id JOIN s y ON y.block_id = right_block_id)")


@_query("pair_jaccard_entities", _sides_sql(O.entities("ocr_text"), "SELECT pair_id, round(len(list_intersect(lf, rf)) / greatest(len(list_distinct(list_concat(lf, rf))), 1), 6) AS entity_overlap FROM b"))
def _(spark, sf_dir):
    return _sides(spark, sf_dir, X.entities).select("pair_id", F.round(X.jaccard(F.col("left"), F.col("right")), 6).alias("entity_overlap"))


@_query("pair_shared_keywords", _sides_sql(O.keywords("ocr_text"), "SELECT pair_id, CAST(len(list_intersect(lf, rf)) AS INT) AS shared_keywords FROM b"))
def _(spark, sf_dir):
    return _sides(spark, sf_dir, X.keywords).select("pair_id", X.shared(F.col("left"), F.col("right")).alias("shared_keywords"))


@_query("tfidf_weights", O.after("layout", "SELECT newspaper_id, block_id, term, round(weight, 6) AS weight FROM x", *O.terms(False, None)))
def _(spark, sf_dir):
    return pair_text.tfidf(_texts(spark, sf_dir, _geometry_layout(spark, sf_dir)), bigrams=False, most=None, keep=settled).select("newspaper_id", "block_id", "term", r6("weight"))


@_query("tfidf_cosine", O.after("pairs", "SELECT pair_id, round(sum(a.weight * b.weight), 6) AS ocr_cosine_similarity FROM pr JOIN x a ON a.block_id = left_block_id JOIN x b ON b.block_id = right_block_id AND a.term = b.term GROUP BY 1", *O.terms(True, pair_text.MOST_TERMS)))
def _(spark, sf_dir):
    placed = _geometry_layout(spark, sf_dir)
    return pair_text.cosines(candidates.pairs(placed), _detected(spark, sf_dir), kept=placed).select("pair_id", r6("ocr_cosine_similarity"))


@_query("sequence_ratio")
def _(spark, sf_dir):
    placed = _geometry_layout(spark, sf_dir)
    return pair_text.sequence_ratios(candidates.pairs(placed), _detected(spark, sf_dir), placed).select("pair_id", F.round("text_similarity", 6).alias("text_similarity"))


_MATRIX = [c for c in FEATURES if c not in ("ocr_cosine_similarity", "text_similarity", "entity_overlap", "shared_keywords")]


@_query("feature_matrix", O.after("pairs", "SELECT pair_id, " + ", ".join(f'round(({O.feature(c)})::DOUBLE, 6) AS "{c}"' if c not in O.FLAGS else f'{O.feature(c)} AS "{c}"' for c in _MATRIX) + " FROM pr"))
def _(spark, sf_dir):
    made = scoring.feature_matrix(_pairs(spark, sf_dir))
    return made.select("pair_id", *(F.col(f"`{c}`") if c in O.FLAGS else F.round(F.col(c).cast("double"), 6).alias(c) for c in _MATRIX))


@_query("pair_score", O.after("pairs", "SELECT pair_id, probability_same_article, prediction, 0.5::DOUBLE AS prediction_threshold FROM sd", O.SCORED))
def _(spark, sf_dir):
    return _scored(spark, sf_dir).select("pair_id", "probability_same_article", "prediction", "prediction_threshold")


@_query(
    "pair_merge_fill",
    O.after(
        "pairs",
        "SELECT pair_id, coalesce(round(c, 6), 0.0) AS ocr_cosine_similarity, CAST(coalesce(k, 0) AS INT) AS shared_keywords FROM pr LEFT JOIN t USING (pair_id)",
        "t AS (SELECT pair_id, x_overlap_ratio AS c, num_candidate_sources AS k FROM pr WHERE column_relation = 'same_column')",
    ),
)
def _(spark, sf_dir):
    """Pairs of one column have text features here, the others none."""
    pairs = _pairs(spark, sf_dir)
    text = pairs.filter("column_relation = 'same_column'").select("pair_id", F.col("x_overlap_ratio").alias("ocr_cosine_similarity"), F.lit(0.0).alias("text_similarity"), F.lit(0.0).alias("entity_overlap"), F.col("num_candidate_sources").alias("shared_keywords"))
    return pair_text.merge(pairs, text).select("pair_id", r6("ocr_cosine_similarity"), "shared_keywords")


_CLUSTER = "newspaper_id, image_id, page_filename, block_id, predicted_cluster_id, predicted_cluster_size, class_name, confidence, x1, y1, x2, y2, page_width, page_height"


@_query("clusters_union_find", O.after("pairs", f"SELECT {_CLUSTER} FROM cl", O.SCORED, O.CLUSTERED))
def _(spark, sf_dir):
    return _run(spark, sf_dir).clusters.select(*_CLUSTER.split(", "))


@_query("clusters_validated")
def _(spark, sf_dir):
    return _run(spark, sf_dir, text=True, validate=True).clusters.select(*_CLUSTER.split(", "))


@_query("cluster_audit")
def _(spark, sf_dir):
    return _run(spark, sf_dir, text=True, validate=True).scored.select("pair_id", "probability_same_article", "cluster_validation_status", F.round("cluster_validation_score", 6).alias("cluster_validation_score"), "cluster_validation_reason")


@_query("clusters_leiden")
def _(spark, sf_dir):
    return _run(spark, sf_dir, text=True, method="leiden").clusters.select(*_CLUSTER.split(", "))


_SAME = "(candidate_sources = 'same_column_window' OR column_relation = 'same_column')"
_BLOCK_SCORE = f"""probability_same_article + 0.02 + CASE WHEN {_SAME} THEN 0.04 WHEN column_relation = 'adjacent_column' AND x_overlap_ratio > 0.2 THEN 0.02 WHEN contains(candidate_sources, 'cross_column_headline_continuation') THEN -0.02
 WHEN column_relation = 'cross_column' THEN -0.05 ELSE 0.0 END + CASE WHEN class_pair IN ('Section-header__Text', 'Text__Section-header') THEN 0.02 WHEN class_pair = 'Section-header__Section-header' THEN -0.02 WHEN contains(class_pair, 'Picture') THEN -0.05 ELSE 0.0 END
 - 0.02 - CASE WHEN vertical_gap_norm > 0.08 THEN 0.03 ELSE 0.0 END - 0.04"""
_APPEND_SCORE = f"""probability_same_article + CASE WHEN probability_same_article >= 0.85 THEN 0.02 ELSE 0.0 END + CASE WHEN {_SAME} THEN 0.04 ELSE -0.06 END + CASE WHEN x_overlap_ratio >= 0.8 THEN 0.03 ELSE 0.0 END
 + CASE WHEN vertical_gap_norm <= 0.02 THEN 0.03 ELSE -0.05 END + CASE WHEN abs(reading_order_delta) <= 3 THEN 0.02 ELSE -0.03 END"""


@_query("validation_scores", O.after("pairs", f"SELECT pair_id, round({_BLOCK_SCORE}, 6) AS block_score, round({_APPEND_SCORE}, 6) AS append_score FROM sc", O.SCORED))
def _(spark, sf_dir):
    """Scores of a single block against a cluster of two without shared words, and of a cluster of one against one of three, by the clustering's own rules."""

    def judge(batches):
        import pandas as pd

        for batch in batches:
            rows = batch.to_dict("records")
            single = [clustering.judge_block(r, r["left_block_id"], ["", r["right_block_id"]], {"": set()}, 0.9)[1] for r in rows]
            append = [clustering.judge_append(r, [""], ["", "", ""], 0.9)[1] for r in rows]
            yield pd.DataFrame({"pair_id": batch["pair_id"], "block_score": [round(s, 6) for s in single], "append_score": [round(s, 6) for s in append]})

    return _scored(spark, sf_dir).withColumn("text_similarity", F.lit(0.0)).mapInPandas(judge, "pair_id string, block_score double, append_score double")


def _joined() -> tuple[Column, Column]:
    return F.array_join("detection_ids", "|").alias("detection_ids"), F.array_join("page_ids", "|").alias("page_ids")


def _articles_sql(query: str, *more: str) -> str:
    return O.after("pairs", query, O.SCORED, O.CLUSTERED, O.ARTICLES, *more)


@_query("articles", _articles_sql("SELECT newspaper_id, article_id, confidence, detection_ids, page_ids FROM ar"))
def _(spark, sf_dir):
    return _run(spark, sf_dir).articles().select("newspaper_id", "article_id", "confidence", *_joined())


_DETECTION = "concat('page_', lpad(CAST(image_id + 1 AS VARCHAR), 3, '0'))"


@_query("detections_view", O.after("nms", f"SELECT newspaper_id, block_id AS detection_id, {_DETECTION} AS page_id, class_name AS label, confidence, x1 AS x, y1 AS y, x2 - x1 AS w, y2 - y1 AS h FROM n"))
def _(spark, sf_dir):
    return articles.detections(_kept(spark, sf_dir)).select("newspaper_id", "detection_id", "page_id", "label", "confidence", "bbox.x", "bbox.y", "bbox.w", "bbox.h")


_PAGES = "pv AS (SELECT DISTINCT newspaper_id, concat('page_', lpad(CAST(page_number AS VARCHAR), 3, '0')) AS page_id, page_number, concat('documents/', newspaper_id, '/outputs/pages/', page_filename) AS image_uri FROM p)"


@_query("pages_view", O.after("blocks", "SELECT * FROM pv", _PAGES))
def _(spark, sf_dir):
    return articles.pages_view(tables.pages_of(_detected(spark, sf_dir)))


@_query("candidate_pairs_view", O.after("pairs", "SELECT newspaper_id, pair_id, left_block_id AS source_detection_id, right_block_id AS target_detection_id, candidate_sources, reading_order_delta FROM pr"))
def _(spark, sf_dir):
    view = articles.candidate_view(_pairs(spark, sf_dir))
    some = F.from_json("features", "candidate_sources string, reading_order_delta int")
    return view.select("newspaper_id", "pair_id", "source_detection_id", "target_detection_id", some.alias("f")).select("newspaper_id", "pair_id", "source_detection_id", "target_detection_id", "f.candidate_sources", "f.reading_order_delta")


@_query("pairwise_view", O.after("pairs", "SELECT newspaper_id, pair_id, prediction = 1 AS prediction, probability_same_article AS probability, 'pairwise-v1' AS model_version FROM sd", O.SCORED))
def _(spark, sf_dir):
    return articles.pairwise_view(_scored(spark, sf_dir)).select("newspaper_id", "pair_id", "prediction", "probability", "model_version")


@_query(
    "article_detail",
    _articles_sql(
        "SELECT ar.article_id, ar.newspaper_id, ar.confidence, (SELECT count(*) FROM cl WHERE cl.predicted_cluster_id = ar.article_id AND cl.newspaper_id = ar.newspaper_id) AS detections, (SELECT string_agg(DISTINCT class_name, '|' ORDER BY class_name) FROM cl WHERE cl.predicted_cluster_id = ar.article_id) AS labels, "
        "(SELECT string_agg(image_uri, '|' ORDER BY pv.page_id) FROM pv WHERE pv.newspaper_id = ar.newspaper_id AND list_contains(string_split(ar.page_ids, '|'), pv.page_id)) AS image_uris FROM ar",
        _PAGES,
    ),
)
def _(spark, sf_dir):
    done = _run(spark, sf_dir)
    found = articles.article_detail(done.articles(), articles.detections(done.blocks), done.pages)
    labels = F.array_join(F.array_sort(F.array_distinct(F.transform("detections", lambda d: d["label"]))), "|")
    return found.select("article_id", "newspaper_id", "confidence", F.size("detections").cast("long").alias("detections"), labels.alias("labels"), F.array_join(F.transform("pages", lambda p: p["image_uri"]), "|").alias("image_uris"))


@_query(
    "visualization_pages",
    _articles_sql(
        f"SELECT pv.newspaper_id, pv.page_id, pv.page_number, pv.image_uri, coalesce(d.n, 0) AS n_detections, d.ids AS detection_ids, a.ids AS article_ids FROM pv "
        f"LEFT JOIN (SELECT newspaper_id, {_DETECTION} AS page_id, count(*) AS n, string_agg(block_id, '|' ORDER BY block_id) AS ids FROM l GROUP BY 1, 2) d USING (newspaper_id, page_id) "
        f"LEFT JOIN (SELECT newspaper_id, page_id, string_agg(article_id, '|' ORDER BY article_id) AS ids FROM (SELECT newspaper_id, article_id, unnest(string_split(page_ids, '|')) AS page_id FROM ar) GROUP BY 1, 2) a USING (newspaper_id, page_id)",
        _PAGES,
    ),
)
def _(spark, sf_dir):
    done = _run(spark, sf_dir)
    found = articles.visualization(done.pages, articles.detections(done.blocks), done.articles())

    def ids(column: str, name: str) -> Column:
        return F.array_join(F.array_sort(F.transform(column, lambda x: x[name])), "|")

    return found.select("newspaper_id", "page_id", "page_number", "image_uri", F.coalesce(F.size("detections"), F.lit(0)).cast("long").alias("n_detections"), ids("detections", "detection_id").alias("detection_ids"), ids("articles", "article_id").alias("article_ids"))


_COUNTS = "SELECT (SELECT count(DISTINCT page_key) FROM p) AS pages, (SELECT count(*) FROM l) AS blocks, (SELECT count(*) FROM sd) AS candidate_pairs, (SELECT CAST(sum(prediction) AS BIGINT) FROM sd) AS predicted_positive_pairs, (SELECT count(DISTINCT predicted_cluster_id) FROM cl) AS clusters"


@_query("manifest_counts", _articles_sql(_COUNTS))
def _(spark, sf_dir):
    return _run(spark, sf_dir).counts()


@_query("metrics_view", _articles_sql(f"SELECT candidate_pairs, predicted_positive_pairs AS positive_pairs, greatest(candidate_pairs - predicted_positive_pairs, 0) AS negative_pairs, clusters AS articles_found, CAST(NULL AS DOUBLE) AS processing_time_seconds FROM ({_COUNTS})"))
def _(spark, sf_dir):
    return articles.metrics(_run(spark, sf_dir).counts())


@_query("export_csv_rows", _articles_sql("SELECT article_id, confidence, detection_ids, page_ids FROM ar"))
def _(spark, sf_dir):
    return sinks.csv_rows(_run(spark, sf_dir).articles())


@_query("coerce_numbers", "SELECT event_id, CAST(CASE WHEN r = floor(r) AND abs(r) < 9e18 THEN r END AS BIGINT) AS whole, CASE WHEN r = floor(r) AND abs(r) < 9e18 THEN NULL ELSE r END AS real, CASE WHEN r IS NULL THEN t END AS text FROM (SELECT *, TRY_CAST(t AS DOUBLE) AS r FROM (SELECT event_id, CASE event_id % 4 WHEN 0 THEN event_type WHEN 1 THEN CAST(user_id AS VARCHAR) WHEN 2 THEN NULL ELSE concat(user_id % 100, '.', event_id % 10) END AS t FROM events))")
def _(spark, sf_dir):
    events = _table(spark, sf_dir, "events")
    part = F.col("event_id") % 4
    value = F.when(part == 0, F.col("event_type")).when(part == 1, F.col("user_id").cast("string")).when(part == 3, F.concat((F.col("user_id") % 100).cast("string"), F.lit("."), (F.col("event_id") % 10).cast("string")))
    return articles.coerced(events.select("event_id", value.alias("raw")), "raw", ["event_id"])


_FILES = "f AS (SELECT concat('doc_', lpad(CAST(doc_id AS VARCHAR), 12, '0')) AS document_id, concat('documents/doc_', lpad(CAST(doc_id AS VARCHAR), 12, '0'), '/metadata.json') AS path, sha256(text) AS file_sha256, n_chars > 0 AS has_blocks FROM documents)"


@_query("detection_cache_lookup", f"WITH {_FILES}, g AS (SELECT file_sha256, list(document_id ORDER BY path) AS ids FROM f WHERE has_blocks GROUP BY 1) SELECT document_id, CASE WHEN document_id <> ids[1] THEN ids[1] ELSE ids[2] END AS cached_document_id FROM f JOIN g USING (file_sha256) WHERE CASE WHEN document_id <> ids[1] THEN ids[1] ELSE ids[2] END IS NOT NULL")
def _(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    name = F.concat(F.lit("doc_"), F.lpad(F.col("doc_id").cast("string"), 12, "0"))
    files = docs.select(name.alias("document_id"), F.concat(F.lit("documents/"), name, F.lit("/metadata.json")).alias("path"), F.sha2(F.encode("text", "utf-8"), 256).alias("file_sha256"), (F.col("n_chars") > 0).alias("has_blocks"))
    return jobs.detection_cache(files)


@_query("document_ids", "SELECT page_id, concat(regexp_extract(url, '([^/]*)$', 1), '__', substr(md5(url), 1, 10)) AS document_id FROM (SELECT page_id, concat('/scans/', page_id) AS url FROM pages)")
def _(spark, sf_dir):
    return _table(spark, sf_dir, "pages").select("page_id", X.default_document_id(F.concat(F.lit("/scans/"), F.col("page_id").cast("string"))).alias("document_id"))


@_query("hash_numbers", "SELECT doc_id, CAST(concat('0x', substr(md5(source), 1, 12)) AS BIGINT) AS hash_number, sha256(source) AS sha FROM documents")
def _(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", X.hash_number(F.col("source")).alias("hash_number"), F.sha2(F.encode("source", "utf-8"), 256).alias("sha"))


_REKEY = O.after(
    "blocks",
    "SELECT concat(newspaper_id, '__', image_id, '__', nr) AS block_id, class_name, x1, y1, page_filename FROM n",
    "q AS (SELECT * REPLACE (concat('cached_', newspaper_id) AS newspaper_id), row_number() OVER (PARTITION BY newspaper_id, image_id ORDER BY ord) - 1 AS nr FROM blocks)",
    "p2 AS (SELECT *, concat_ws('||', newspaper_id, CAST(image_id AS VARCHAR), page_filename) AS page_key FROM q)",
    O.STEPS["nms"].replace("FROM p)", "FROM p2)").replace("SELECT p.* FROM p JOIN", "SELECT p2.* FROM p2 JOIN"),
)


@_query("cached_blocks_rekey", _REKEY)
def _(spark, sf_dir):
    """All newspapers' blocks as other documents'."""
    some = _detected(spark, sf_dir).drop("bbox", "ocr_text")
    return blocks.rekey(some, tables.pages_of(some), F.concat(F.lit("cached_"), "newspaper_id")).select("block_id", "class_name", "x1", "y1", "page_filename")


@_query(
    "classifier_metrics",
    "SELECT tn, fp, fn, tp, n AS rows, (tn + tp) / n AS accuracy, tp / (tp + fp) AS precision, tp / (tp + fn) AS recall, 2 * tp / (2 * tp + fp + fn) AS f1 FROM (SELECT count(*) AS n, count(*) FILTER (quality = 0 AND p = 0) AS tn, count(*) FILTER (quality = 0 AND p = 1) AS fp, count(*) FILTER (quality = 1 AND p = 0) AS fn, count(*) FILTER (quality = 1 AND p = 1) AS tp FROM (SELECT quality, CASE WHEN n_chars >= 400 THEN 1 ELSE 0 END AS p FROM labels JOIN documents USING (doc_id)))",
)
def _(spark, sf_dir):
    both = _table(spark, sf_dir, "labels").join(_table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
    return scoring.classifier_metrics(both.withColumn("p", (F.col("n_chars") >= 400).cast("int")), "quality", "p")


@_query("job_latest_status", "SELECT user_id AS job_id, event_id, event_type AS status FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1")
def _(spark, sf_dir):
    updates = _table(spark, sf_dir, "events").select(F.col("user_id").alias("job_id"), "event_id", "ts", F.col("event_type").alias("status"))
    return jobs.latest(updates, "job_id", ["ts", "event_id"]).select("job_id", "event_id", "status")


_STAGE_ROWS = ", ".join(f"({i}, '{k}', {v})" for i, (k, v) in enumerate(jobs.STAGES.items()))


@_query("event_stage_progress", f"WITH st(place, stage, progress) AS (VALUES {_STAGE_ROWS}) SELECT stage, progress, count(*) AS n, count(DISTINCT user_id) AS n_jobs FROM events JOIN st ON st.place = event_id % 14 GROUP BY 1, 2")
def _(spark, sf_dir):
    stages = jobs.stage_table(spark)
    events = _table(spark, sf_dir, "events").withColumn("place", (F.col("event_id") % len(jobs.STAGES)).cast("int"))
    named = events.join(F.broadcast(stages.select("place", "stage")), "place")
    return jobs.with_progress(named).groupBy("stage", "progress").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("user_id").alias("n_jobs"))


# Tables that are written and read again.


def _as_csv(spark: SparkSession, name: str, df: DataFrame) -> str:
    return sinks.write_tables({name: df}, new_path(spark))[f"{name}_csv"]


def _typed(df: DataFrame, like: DataFrame, columns: list[str]) -> DataFrame:
    """Columns of text with the types of another table's."""
    return df.select(*(F.col(c).cast(like.schema[c].dataType).alias(c) for c in columns))


_PAGE_COLUMNS = "newspaper_id, image_id, page_number, page_filename, image_path, page_width, page_height"


@_query("pages_csv", O.after("blocks", f"SELECT DISTINCT {_PAGE_COLUMNS.replace('image_path', 'page_filename AS image_path')} FROM p"))
def _(spark, sf_dir):
    return tables.pages_csv(spark, _as_csv(spark, "pages", tables.pages_of(_detected(spark, sf_dir))))


@_query("blocks_csv", O.after("nms", "SELECT newspaper_id, image_id, page_number, block_id, class_id, class_name, confidence, x1, y1, x2, y2, width, height, center_x, center_y, concat('[', x1, ',', y1, ',', x2, ',', y2, ']') AS bbox FROM n"))
def _(spark, sf_dir):
    some = blocks.suppress(_prepared(spark, sf_dir).drop("ocr_text")).drop("ord")
    return tables.blocks_csv(spark, _as_csv(spark, "blocks", some)).drop("ord", "page_filename", "image_path", "image_path_in_zip", "page_width", "page_height")


@_query("inferred_columns_csv", O.after("columns", f"SELECT page_key, column_id, {_sql6(['x1', 'x2', 'center_x'])} FROM c"))
def _(spark, sf_dir):
    some = layout.columns(_settled(spark, sf_dir))
    read = tables.strings_csv(spark, _as_csv(spark, "inferred_page_columns", some), some.columns)
    return _typed(read, some, some.columns).select("page_key", "column_id", *map(r6, ("x1", "x2", "center_x")))


@_query("candidate_pairs_csv", O.after("pairs", "SELECT pair_id, left_block_id, right_block_id, candidate_sources, reading_order_delta, round(x_overlap_ratio, 6) AS x_overlap_ratio, round(vertical_gap_norm, 6) AS vertical_gap_norm FROM pr"))
def _(spark, sf_dir):
    some = _pairs(spark, sf_dir)
    read = tables.strings_csv(spark, _as_csv(spark, "candidate_block_pairs", some), some.columns)
    own = ["pair_id", "left_block_id", "right_block_id", "candidate_sources", "reading_order_delta", "x_overlap_ratio", "vertical_gap_norm"]
    return _typed(read, some, own).select(*own[:5], *map(r6, own[5:]))


@_query("pair_predictions_csv", O.after("pairs", "SELECT pair_id, probability_same_article, prediction, 0.5::DOUBLE AS prediction_threshold FROM sd", O.SCORED))
def _(spark, sf_dir):
    some = _scored(spark, sf_dir)
    read = tables.strings_csv(spark, _as_csv(spark, "pair_predictions", some), some.columns)
    return _typed(read, some, ["pair_id", "probability_same_article", "prediction", "prediction_threshold"])


@_query("block_clusters_csv", O.after("pairs", "SELECT block_id, predicted_cluster_id, predicted_cluster_size, x1, y1 FROM cl", O.SCORED, O.CLUSTERED))
def _(spark, sf_dir):
    some = _run(spark, sf_dir).clusters
    read = tables.strings_csv(spark, _as_csv(spark, "block_clusters", some), some.columns)
    return _typed(read, some, ["block_id", "predicted_cluster_id", "predicted_cluster_size", "x1", "y1"])


_READ = ", ".join(f"'{c}'" for c in images.OCR_CLASSES)


@_query("block_ocr_csv", O.after("blocks", f"SELECT block_id, class_name, CAST(NULL AS VARCHAR) AS ocr_text, CASE WHEN class_name IN ({_READ}) THEN 'ocr_disabled' ELSE 'non_text' END AS ocr_error FROM p"))
def _(spark, sf_dir):
    """Without a reader; an empty text is no text in CSV."""
    some = images.block_text(_prepared(spark, sf_dir))
    return tables.strings_csv(spark, _as_csv(spark, "block_ocr", some), some.columns)


@_query("pair_text_csv", O.after("pairs", "SELECT pair_id, round(coalesce(s, 0.0), 6) AS ocr_cosine_similarity FROM pr LEFT JOIN (SELECT pair_id, sum(a.weight * b.weight) AS s FROM pr JOIN x a ON a.block_id = left_block_id JOIN x b ON b.block_id = right_block_id AND a.term = b.term GROUP BY 1) USING (pair_id)", *O.terms(True, pair_text.MOST_TERMS)))
def _(spark, sf_dir):
    """The text features that need no Python, as the run makes them."""
    placed = _geometry_layout(spark, sf_dir)
    some = pair_text.features(candidates.pairs(placed), _detected(spark, sf_dir), False, kept=placed)
    read = tables.strings_csv(spark, _as_csv(spark, "pairwise_ocr_features", some), some.columns)
    return _typed(read, some, ["pair_id", "ocr_cosine_similarity"]).select("pair_id", r6("ocr_cosine_similarity"))


@_query("export_json_rows", _articles_sql("SELECT article_id, confidence, detection_ids, page_ids FROM ar"))
def _(spark, sf_dir):
    path = new_path(spark)
    sinks.export_articles(_run(spark, sf_dir).articles(), path, "json")
    read = spark.read.schema("article_id string, confidence double, detection_ids array<string>, page_ids array<string>").json(path)
    return read.select("article_id", "confidence", *_joined())


@_query("export_xml_rows", _articles_sql("SELECT article_id, confidence, detection_ids, page_ids FROM ar"))
def _(spark, sf_dir):
    path = new_path(spark)
    sinks.export_articles(_run(spark, sf_dir).articles(), path, "xml")
    one = "struct<{0}: array<struct<_id: string>>>"
    read = spark.read.format("xml").option("rowTag", "article").schema(f"_id string, _confidence double, detections {one.format('detection')}, pages {one.format('page')}").load(path)

    def ids(column: str, tag: str) -> Column:
        return F.array_join(F.transform(f"{column}.{tag}", lambda x: x["_id"]), "|")

    return read.select(F.col("_id").alias("article_id"), F.col("_confidence").alias("confidence"), ids("detections", "detection").alias("detection_ids"), ids("pages", "page").alias("page_ids"))


@_query("visualization_payload", _articles_sql("SELECT newspaper_id, (SELECT count(*) FROM l WHERE l.newspaper_id = x.newspaper_id) AS blocks, (SELECT string_agg(article_id, '|' ORDER BY article_id) FROM ar WHERE ar.newspaper_id = x.newspaper_id) AS articles FROM (SELECT DISTINCT newspaper_id FROM l) x"))
def _(spark, sf_dir):
    done = _run(spark, sf_dir)
    made = sinks.payload({"blocks": done.blocks, "articles": done.articles()})
    read = F.from_json("payload", "blocks array<struct<block_id: string>>, articles array<struct<article_id: string>>").alias("p")
    found = made.select("newspaper_id", read)
    return found.select("newspaper_id", F.size("p.blocks").cast("long").alias("blocks"), F.array_join(F.array_sort("p.articles.article_id"), "|").alias("articles"))


#: Two trees of one split each, for the scorer that runs boosted trees.
_STUMPS = [("x_overlap_ratio", 0.5, -0.5, 0.75), ("vertical_gap_norm", 0.05, 1.0, -1.25)]


def _stumps() -> scoring.Trees:
    names = [name for name, *_ in _STUMPS]
    trees = [{"left_children": [1, -1, -1], "right_children": [2, -1, -1], "split_indices": [i, 0, 0], "split_conditions": [at, low, high], "default_left": [1, 0, 0]} for i, (_, at, low, high) in enumerate(_STUMPS)]
    return scoring.Trees({"learner": {"feature_names": names, "learner_model_param": {"base_score": "5E-1"}, "gradient_booster": {"model": {"trees": trees}}}})


_STUMPS_SQL = " + ".join(f"CASE WHEN CAST({name} AS FLOAT) < CAST({at} AS FLOAT) THEN {low} ELSE {high} END" for name, at, low, high in _STUMPS)


@_query("pair_score_trees", O.after("pairs", f"SELECT pair_id, round(1 / (1 + exp(-({_STUMPS_SQL})::DOUBLE)), 5) AS probability, CAST(1 / (1 + exp(-({_STUMPS_SQL})::DOUBLE)) >= 0.6 AS INT) AS prediction FROM pr"))
def _(spark, sf_dir):
    made = scoring.score(_pairs(spark, sf_dir), _stumps(), 0.6)
    return made.select("pair_id", F.round("probability_same_article", 5).alias("probability"), "prediction")


@_query("first_of_repeated_blocks", O.after("blocks", "SELECT block_id, ord FROM (SELECT concat(newspaper_id, class_name) AS block_id, ord, row_number() OVER (PARTITION BY newspaper_id, class_name ORDER BY ord) AS rn FROM p) WHERE rn = 1"))
def _(spark, sf_dir):
    """Blocks of one class of a newspaper share an id here."""
    some = _detected(spark, sf_dir).withColumn("block_id", F.concat("newspaper_id", "class_name"))
    return pair_text.distinct_blocks(some).select("block_id", "ord")


@_query("text_collapse", "SELECT doc_id, md5(trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g'))) AS hash FROM documents")
def _(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.md5(F.encode(X.collapse("text"), "utf-8")).alias("hash"))


def queries() -> dict[str, Query]:
    return {name: f for name, (f, _) in _found.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _found.items() if sql}
