"""Adapters for images, detection and OCR. Decoders, models and OCR programs are passed in; without them the sources are tables.

Adapters run in mapInPandas, so a worker loads a model once and reads an image once for the crops that follow each other.
"""

from __future__ import annotations

import subprocess
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import collapse, default_document_id
from ..operators.blocks import crops
from ..schemas import OCR_CLASSES
from ..settle import settled
from .store import read_bytes, write_bytes

# Fixed value: crops with a longer side below it are made twice as large.
SMALL = 1600

#: Frames of a file's bytes: (width, height, PNG bytes) each.
Decoder = Callable[[bytes], Iterable[tuple[int, int, bytes]]]
#: Boxes on an image file: (class id, class name or None, confidence, x1, y1, x2, y2) each.
Detector = Callable[[str], Iterable[tuple[int, str | None, float, float, float, float, float]]]
#: (text, error) of an image file's crop.
Reader = Callable[[str, tuple[int, int, int, int]], tuple[str, str]]


def explode_pages(files: DataFrame, decoder: Decoder, folder: str, newspaper_id: str | None = None) -> DataFrame:
    """Pages of binary files (path, content), one for each frame, with the frame's PNG in `content`."""
    named = files.select("path", "content", (F.lit(newspaper_id) if newspaper_id else default_document_id(F.col("path"))).alias("newspaper_id"), F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"(?<=.)\.[^.]*$", "").alias("stem"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                for i, (width, height, png) in enumerate(decoder(row.content)):
                    name = f"{row.stem}_page_{i + 1:03d}.png"
                    yield pd.DataFrame([{"newspaper_id": row.newspaper_id, "image_id": i, "page_number": i + 1, "page_filename": name, "image_path": f"{folder}/{name}", "page_width": width, "page_height": height, "content": png}])

    return named.mapInPandas(run, "newspaper_id string, image_id int, page_number int, page_filename string, image_path string, page_width int, page_height int, content binary")


def detect(pages: DataFrame, load: Callable[[], Detector], least: float = 0.25) -> DataFrame:
    """Blocks of pages; a class without a name is called by its number, sides are 0 at least."""
    keys = ["newspaper_id", "image_id", "page_number", "page_filename", "image_path", "page_width", "page_height"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        detector = load()
        for batch in batches:
            rows = []
            for page in batch.itertuples(index=False):
                for i, (class_id, name, confidence, x1, y1, x2, y2) in enumerate(b for b in detector(page.image_path) if b[2] >= least):
                    width, height = max(x2 - x1, 0.0), max(y2 - y1, 0.0)
                    rows.append((*(getattr(page, k) for k in keys), page.page_filename, f"{page.newspaper_id}__{page.image_id}__{i}", class_id, name or str(class_id), confidence, x1, y1, x2, y2, [x1, y1, x2, y2], width, height, x1 + width / 2, y1 + height / 2, i))
            names = [*keys, "image_path_in_zip", "block_id", "class_id", "class_name", "confidence", "x1", "y1", "x2", "y2", "bbox", "width", "height", "center_x", "center_y", "ord"]
            yield pd.DataFrame(rows, columns=names)

    schema = "newspaper_id string, image_id int, page_number int, page_filename string, image_path string, page_width int, page_height int, image_path_in_zip string, block_id string, class_id int, class_name string, confidence double, x1 double, y1 double, x2 double, y2 double, bbox array<double>, width double, height double, center_x double, center_y double, ord long"
    return pages.select(*keys).mapInPandas(run, schema)


def block_text(blocks: DataFrame, load: Callable[[], Reader] | None = None) -> DataFrame:
    """(block_id, class_name, ocr_text, ocr_error): no text for classes that are not read, for crops that are too small, and without a reader."""
    one = blocks.groupBy("block_id").agg(F.min_by(F.struct("class_name", "image_path", "x1", "y1", "x2", "y2", "page_width", "page_height"), "ord").alias("b")).select("block_id", "b.*")
    some = one.join(crops(one), "block_id")
    error = F.when(~F.col("class_name").isin(*OCR_CLASSES), "non_text")
    if load is None:
        return some.select("block_id", "class_name", F.lit("").alias("ocr_text"), F.coalesce(error, F.lit("ocr_disabled")).alias("ocr_error"))
    error = error.when(F.col("too_small"), "crop_too_small")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = load()
        for batch in batches:
            found = [("", e) if e else reader(p, (int(a), int(b), int(c), int(d))) for p, a, b, c, d, e in zip(batch["image_path"], batch["left"], batch["top"], batch["right"], batch["bottom"], batch["error"])]
            yield pd.DataFrame({"block_id": batch["block_id"], "class_name": batch["class_name"], "ocr_text": [t for t, _ in found], "ocr_error": [e for _, e in found]})

    ready = some.select("block_id", "class_name", "image_path", "left", "top", "right", "bottom", F.coalesce(error, F.lit("")).alias("error")).sortWithinPartitions("image_path")
    return ready.mapInPandas(run, "block_id string, class_name string, ocr_text string, ocr_error string").withColumn("ocr_text", collapse("ocr_text"))


# What needs programs or packages that may not be there.


def pillow_frames(raw: bytes) -> Iterator[tuple[int, int, bytes]]:
    """Decoder by Pillow: each frame of a file as a PNG in colours."""
    import io

    from PIL import Image, ImageSequence

    with Image.open(io.BytesIO(raw)) as file:
        for frame in ImageSequence.Iterator(file):
            out = io.BytesIO()
            frame.convert("RGB").save(out, "PNG")
            yield *frame.size, out.getvalue()


def write_pages(pages: DataFrame) -> DataFrame:
    """Writes each page's `content` to its image_path, on the executors, and gives the pages without it, written as a table so that this happens once.

    The folder must be one that all executors share, as any URI that Arrow knows. A page that is written again is the same file.
    """
    fields = [f for f in pages.schema.fields if f.name != "content"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["image_path"], batch["content"]):
                write_bytes(path, bytes(content))
            yield batch.drop(columns="content")

    return settled(pages.mapInPandas(run, T.StructType(fields)))


def sharpened(crop):
    """A crop made ready for OCR: grey, twice as large if its longer side is below SMALL, with full contrast, sharpened. A Pillow image."""
    from PIL import Image, ImageFilter, ImageOps

    grey = crop.convert("L")
    if max(grey.size) < SMALL:
        grey = grey.resize(tuple(2 * n for n in grey.size), Image.Resampling.LANCZOS)
    return ImageOps.autocontrast(grey).filter(ImageFilter.SHARPEN)


def pillow_crop(path: str, box: tuple[int, int, int, int]) -> bytes:
    """The PNG of an image file's crop, made ready for OCR."""
    import io

    from PIL import Image

    out = io.BytesIO()
    with Image.open(io.BytesIO(read_bytes(path))) as page:
        sharpened(page.crop(box)).save(out, "PNG")
    return out.getvalue()


@dataclass(frozen=True)
class Tesseract:
    """Reader by the tesseract program, which gets the crop on its standard input. What it says when it fails is the error."""

    language: str = "eng"
    layout: str = "6"
    program: tuple[str, ...] = ("tesseract",)
    crop: Callable[[str, tuple[int, int, int, int]], bytes] = pillow_crop

    def load(self) -> Reader:
        return self

    def __call__(self, path: str, box: tuple[int, int, int, int]) -> tuple[str, str]:
        done = subprocess.run([*self.program, "stdin", "stdout", "-l", self.language, "--psm", self.layout], input=self.crop(path, box), capture_output=True, check=False)
        if done.returncode:
            return "", done.stderr.decode(errors="ignore").strip()
        return done.stdout.decode(errors="ignore"), ""
