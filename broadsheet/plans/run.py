"""The whole run: blocks to articles, for any number of documents at once."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from ..operators import articles, blocks, candidates, clustering, layout, pair_text, scoring
from ..schemas import ADJACENT, CROSS, SAME
from ..sources import tables
from ..sources.store import Request
from ..settle import settled


@dataclass(frozen=True)
class Config:
    top: dict[str, int] = field(default_factory=lambda: dict(candidates.TOP))
    #: Without one, that of the metrics file, or the default.
    threshold: float | None = None
    scorer: scoring.Scorer | None = None
    #: Files of the driver: a booster's model, the names of its features, its metrics with the best threshold.
    model_path: str | None = None
    feature_columns_path: str | None = None
    metrics_path: str | None = None
    detection_confidence: float = 0.25
    detection_image_size: int | None = None
    ocr_language: str = "eng"
    ocr_layout: str = "6"
    text: bool = True
    sequence: bool = True
    method: str = "union_find"
    validate: bool = False
    validation: clustering.Validation = clustering.Validation()
    resolution: float = 1.0
    seed: int = 13


    def cut(self) -> float:
        return scoring.threshold(self.metrics_path) if self.threshold is None else self.threshold

    def model(self) -> scoring.Scorer | None:
        if self.scorer is None and self.model_path is not None:
            return scoring.Trees.read(self.model_path, self.feature_columns_path)
        return self.scorer

    @classmethod
    def of_request(cls, request: Request, **more) -> Config:
        """What a service's request says, and what only the service knows."""
        return cls(
            top={SAME: request.same_column_top_k, ADJACENT: request.adjacent_column_top_k, CROSS: request.cross_column_top_k}, threshold=request.pairwise_threshold, text=request.run_ocr,
            method=request.clustering_method, validate=request.cluster_validation_enabled,
            validation=clustering.Validation(request.strong_pair_threshold, request.medium_pair_min_probability, request.medium_pair_max_probability, request.cluster_validation_threshold),
            resolution=request.leiden_resolution, seed=request.leiden_seed, detection_confidence=request.yolo_confidence, detection_image_size=request.yolo_image_size, **more,
        )


@dataclass(frozen=True)
class Run:
    pages: DataFrame
    blocks: DataFrame
    columns: DataFrame
    pairs: DataFrame
    scored: DataFrame
    clusters: DataFrame

    def articles(self) -> DataFrame:
        return articles.articles(self.clusters)

    def counts(self) -> DataFrame:
        return articles.manifest_counts(self.pages, self.blocks, self.scored, self.clusters)


def run(found: DataFrame, config: Config = Config()) -> Run:
    """found: detected blocks with `ord`, and with ocr_text where text features are wanted.

    Suppressed and annotated blocks and scored pairs, which several tables need, are written once, without texts; pairs too
    where there are text features. Texts come back to blocks by block_id and `ord`, so `ord` may begin anew on each page.
    """
    texts = [c for c in ("ocr_text",) if c in found.columns]
    with_text = config.text and bool(texts)
    kept = settled(blocks.suppress(blocks.prepare(found.drop(*texts))))
    columns = layout.columns(kept)
    placed = settled(layout.annotate(kept, columns))
    pairs = candidates.pairs(placed, config.top)
    pairs = settled(pairs) if with_text else pairs
    ready = pair_text.merge(pairs, pair_text.features(pairs, found, config.sequence, kept=placed)) if with_text else pairs
    scored = settled(scoring.score(ready, config.model(), config.cut()))
    # The pages' groups get tokens alone, made before they are moved.
    to_join = placed.join(found.select("block_id", "ord", clustering.joined_tokens("ocr_text").alias(clustering.TOKENS)), ["block_id", "ord"]) if texts and config.validate else placed
    clusters, scored = clustering.cluster(to_join, scored, config.method, config.validate, config.validation, config.resolution, config.seed)
    if texts:
        placed = placed.join(found.select("block_id", "ord", *texts), ["block_id", "ord"])
    return Run(tables.pages_of(found), placed, columns, pairs, scored, clusters)
