"""Command line of a run: blocks of earlier detections, or images through adapters, to the tables of articles.

Adapters are functions named as module:function: a decoder of files, a loader of a detector, a loader of an OCR reader.
"""

from __future__ import annotations

import argparse
import importlib
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import blocks, candidates, clustering
from .plans.run import Config, run
from .schemas import ADJACENT, CROSS, SAME
from .sources import images, sinks, tables


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="broadsheet", description="Newspaper scans, or their detected blocks, to articles.")
    say, v = out.add_argument, clustering.Validation()
    say("input", help="A .tif, .tiff or .png file, or a folder of them.")
    say("--output-dir", required=True)
    say("--decoder", help="module:function that gives the frames of a file's bytes; without it, Pillow.")
    say("--detector", help="module:function that gives a detector, called with the image size.")
    say("--reader", help="module:function that gives an OCR reader; without it, Tesseract.")
    say("--classifier-model")
    say("--feature-columns")
    say("--classifier-metrics")
    say("--newspaper-id")
    say("--cached-yolo-blocks", help="Blocks of another run (CSV), instead of a detector.")
    say("--yolo-cache-document-id")
    say("--yolo-confidence", type=float, default=Config.detection_confidence)
    say("--yolo-image-size", type=int)
    for name, kind in (("same", SAME), ("adjacent", ADJACENT), ("cross", CROSS)):
        say(f"--{name}-column-top-k", type=int, default=candidates.TOP[kind])
    say("--pairwise-threshold", type=float)
    say("--run-ocr", action="store_true", default=True)
    say("--no-ocr", dest="run_ocr", action="store_false")
    say("--clustering-method", choices=["union_find", "leiden"], default="union_find")
    say("--leiden-resolution", type=float, default=1.0)
    say("--leiden-seed", type=int, default=13)
    say("--cluster-validation-enabled", action="store_true")
    say("--strong-pair-threshold", type=float, default=v.strong)
    say("--medium-pair-min-probability", type=float, default=v.medium_low)
    say("--medium-pair-max-probability", type=float, default=v.medium_high)
    say("--cluster-validation-threshold", type=float, default=v.threshold)
    say("--tesseract-lang", default=Config.ocr_language)
    say("--tesseract-psm", default=Config.ocr_layout)
    return out


def named(adapter: str):
    module, _, function = adapter.partition(":")
    return getattr(importlib.import_module(module), function)


def config_of(args: argparse.Namespace) -> Config:
    return Config(
        top={SAME: args.same_column_top_k, ADJACENT: args.adjacent_column_top_k, CROSS: args.cross_column_top_k}, threshold=args.pairwise_threshold, text=args.run_ocr, method=args.clustering_method,
        validate=args.cluster_validation_enabled, resolution=args.leiden_resolution, seed=args.leiden_seed,
        validation=clustering.Validation(args.strong_pair_threshold, args.medium_pair_min_probability, args.medium_pair_max_probability, args.cluster_validation_threshold),
        model_path=args.classifier_model, feature_columns_path=args.feature_columns, metrics_path=args.classifier_metrics,
        detection_confidence=args.yolo_confidence, detection_image_size=args.yolo_image_size, ocr_language=args.tesseract_lang, ocr_layout=args.tesseract_psm,
    )


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> dict[str, str]:
    """Runs and writes all tables; their paths by name."""
    args = parser().parse_args(argv)
    spark = spark or SparkSession.builder.getOrCreate()
    config = config_of(args)
    files = spark.read.format("binaryFile").load(args.input).filter(tables.is_image("path"))
    decoder = named(args.decoder) if args.decoder else images.pillow_frames
    pages = images.write_pages(images.explode_pages(files, decoder, f"{args.output_dir}/pages", args.newspaper_id))
    if args.cached_yolo_blocks:
        old = tables.blocks_csv(spark, args.cached_yolo_blocks)
        own = old if args.yolo_cache_document_id is None else old.filter(F.col("newspaper_id") == args.yolo_cache_document_id)
        # The blocks go to the pages of their number, whatever document they were of.
        found: DataFrame = blocks.rekey(own.drop("newspaper_id").join(pages.select("newspaper_id", "image_id"), "image_id"), pages)
    elif args.detector:
        make, size = named(args.detector), config.detection_image_size
        found = images.detect(pages, lambda: make(size), config.detection_confidence)
    else:
        raise SystemExit("give --detector or --cached-yolo-blocks")
    text = None
    if config.text:
        reader = named(args.reader) if args.reader else images.Tesseract(config.ocr_language, config.ocr_layout).load
        text = images.block_text(found, reader)
        found = found.join(text.select("block_id", "ocr_text"), "block_id", "left")
    done = run(found, config)
    out = {"pages": pages, "blocks": done.blocks.drop("ord"), "inferred_page_columns": done.columns, "candidate_block_pairs": done.pairs, "pair_predictions": done.scored, "block_clusters": done.clusters}
    paths = sinks.write_tables(out | ({"block_ocr": text} if text is not None else {}), args.output_dir)
    said = {k: str(v) for k, v in asdict(config).items()}
    sinks.manifest(done.counts(), said, paths).coalesce(1).write.mode("overwrite").json(f"{args.output_dir}/manifest")
    sinks.export_articles(done.articles(), f"{args.output_dir}/articles")
    return paths


if __name__ == "__main__":
    main()
