"""Documents, jobs, page images and exports of a service, as files of a folder that any file system of Arrow holds.

A record is one JSON file, so a change rewrites that record alone, whatever else the folder holds. Records are small and read on the
driver; tables of many documents are read with `tables.metadata`, uploads of many files come through `upload_all`, on the executors.
"""

from __future__ import annotations

import hashlib
import json
import posixpath
import re
import uuid
from collections.abc import Iterator
from dataclasses import asdict, dataclass, fields
from datetime import datetime, timezone

import pandas as pd
import pyarrow.fs as arrow_fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.jobs import STAGES

# Endings of files that are taken, and the message for others.
ENDINGS = (".tif", ".tiff", ".png")
REJECTED = "Only .tif, .tiff, and .png files are supported"


class NotFound(KeyError):
    """There is no such record or file."""


@dataclass(frozen=True)
class Request:
    """What a run is asked for; the bounds are checked."""

    run_yolo: bool = True
    run_pairwise: bool = True
    run_grouping: bool = True
    model_version: str = "pairwise-v1"
    run_ocr: bool = True
    clustering_method: str = "union_find"
    leiden_resolution: float = 1.0
    leiden_seed: int = 13
    cluster_validation_enabled: bool = False
    strong_pair_threshold: float = 0.92
    medium_pair_min_probability: float = 0.5
    medium_pair_max_probability: float = 0.9199
    cluster_validation_threshold: float = 0.9
    same_column_top_k: int = 3
    adjacent_column_top_k: int = 2
    cross_column_top_k: int = 1
    pairwise_threshold: float | None = None
    reuse_yolo_cache: bool = True
    yolo_confidence: float = 0.25
    yolo_image_size: int | None = None

    def __post_init__(self) -> None:
        if self.clustering_method not in ("union_find", "leiden"):
            raise ValueError(f"unknown clustering method: {self.clustering_method}")
        for name, low, high in BOUNDS:
            value = getattr(self, name)
            if value is not None and not low <= value <= high:
                raise ValueError(f"{name} must be from {low} to {high}")
        if self.leiden_resolution <= 0 or self.yolo_image_size is not None and self.yolo_image_size <= 0:
            raise ValueError("leiden_resolution and yolo_image_size must be above 0")

    @classmethod
    def of(cls, values: dict) -> Request:
        unknown = values.keys() - {f.name for f in fields(cls)}
        if unknown:
            raise ValueError(f"unknown fields: {sorted(unknown)}")
        return cls(**values)


# Least and most of a request's numbers.
BOUNDS = (
    ("strong_pair_threshold", 0, 1), ("medium_pair_min_probability", 0, 1), ("medium_pair_max_probability", 0, 1), ("cluster_validation_threshold", 0, 1.5), ("pairwise_threshold", 0, 1),
    ("yolo_confidence", 0, 1), ("same_column_top_k", 0, float("inf")), ("adjacent_column_top_k", 0, float("inf")), ("cross_column_top_k", 0, float("inf")),
)


def now() -> str:
    return datetime.now(timezone.utc).isoformat()


def new_id(kind: str) -> str:
    return f"{kind}_{uuid.uuid4().hex[:12]}"


def opened(where: str) -> tuple[arrow_fs.FileSystem, str]:
    """File system and path of a URI, or of a path on this machine."""
    return arrow_fs.FileSystem.from_uri(where) if re.match("[a-z0-9]+:", where) else (arrow_fs.LocalFileSystem(), where)


def write_bytes(where: str, data: bytes) -> None:
    fs, path = opened(where)
    fs.create_dir(posixpath.dirname(path), recursive=True)
    with fs.open_output_stream(path) as out:
        out.write(data)


def read_bytes(where: str) -> bytes:
    fs, path = opened(where)
    if fs.get_file_info(path).type != arrow_fs.FileType.File:
        raise NotFound(where)
    with fs.open_input_stream(path) as f:
        return f.read()


def taken(name: str) -> bool:
    return name.lower().endswith(ENDINGS)


class Store:
    def __init__(self, folder: str):
        self.folder = folder.rstrip("/")

    def health(self) -> dict[str, str]:
        return {"status": "ok"}

    # Records.

    def _at(self, kind: str, key: str) -> str:
        """kind: documents or jobs. Keys are names, not paths."""
        if not re.fullmatch(r"[A-Za-z0-9_.-]+", key) or set(key) == {"."}:
            raise NotFound(key)
        return f"{self.folder}/documents/{key}/metadata.json" if kind == "documents" else f"{self.folder}/jobs/{key}.json"

    def _read(self, kind: str, key: str) -> dict:
        return json.loads(read_bytes(self._at(kind, key)))

    def _write(self, kind: str, key: str, record: dict) -> dict:
        write_bytes(self._at(kind, key), json.dumps(record).encode())
        return record

    def document(self, document_id: str) -> dict:
        return self._read("documents", document_id)

    def job(self, job_id: str) -> dict:
        return self._read("jobs", job_id)

    def update_document(self, document_id: str, **changes) -> dict:
        return self._write("documents", document_id, self.document(document_id) | changes | {"updated_at": now()})

    def update_job(self, job_id: str, **changes) -> dict:
        """With the stage's progress, unless the job has one of its own, and the stage in words."""
        record = self.job(job_id) | changes | {"updated_at": now()}
        stage = str(record.get("stage", "uploaded"))
        own = {"progress": int(record.get("progress", STAGES.get(stage, 0))), "stage_label": str(record.get("stage_label") or stage.replace("_", " ").title())}
        return self._write("jobs", job_id, record | own)

    # Uploads and runs.

    def upload(self, filename: str, content: bytes, source_name: str | None = None, publication_date: str | None = None) -> dict:
        """The new document's record. Files of other kinds raise ValueError."""
        if not taken(filename):
            raise ValueError(REJECTED)
        document_id, ending, time = new_id("doc"), posixpath.splitext(filename)[1].lower(), now()
        uri = f"documents/{document_id}/original{ending}"
        write_bytes(f"{self.folder}/{uri}", content)
        record = {
            "document_id": document_id, "filename": filename, "file_size_bytes": len(content), "file_sha256": hashlib.sha256(content).hexdigest(), "source_name": source_name, "publication_date": publication_date,
            "status": "uploaded", "page_count": 0, "article_count": 0, "file_uri": uri, "file_path": f"{self.folder}/{uri}", "created_at": time, "updated_at": time,
        }
        return self._write("documents", document_id, record)

    def upload_all(self, files: DataFrame) -> DataFrame:
        """(path, document_id, file_sha256, error) for binary files (path, content): each is written on its executor, once for each time that the result is read."""
        store = self

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                rows = []
                for path, content in zip(batch["path"], batch["content"]):
                    try:
                        record = store.upload(posixpath.basename(path), content)
                        rows.append((path, record["document_id"], record["file_sha256"], None))
                    except ValueError as error:
                        rows.append((path, None, None, str(error)))
                yield pd.DataFrame(rows, columns=["path", "document_id", "file_sha256", "error"])

        return files.select("path", F.col("content")).mapInPandas(run, "path string, document_id string, file_sha256 string, error string")

    def queue(self, document_id: str, request: Request = Request()) -> dict:
        """A new job for a document that is there."""
        self.document(document_id)
        job_id, time = new_id("job"), now()
        record = {"job_id": job_id, "document_id": document_id, "status": "queued", "stage": "queued", "message": "Waiting for background worker", "request": asdict(request), "created_at": time, "updated_at": time}
        return self._write("jobs", job_id, record | {"stage_label": "Queued", "progress": STAGES["queued"]})

    def process(self, job_id: str, run) -> dict:
        """Runs a queued job: run(document, request) gives what changes in the document's record. A run that fails leaves its error in both records."""
        job = self.job(job_id)
        document_id = job["document_id"]
        self.update_job(job_id, status="processing", stage="processing", progress=STAGES["processing"], stage_label="Processing", started_at=now())
        self.update_document(document_id, status="processing")
        try:
            changes = run(self.document(document_id), Request.of(job["request"]))
        except Exception as error:
            self.update_document(document_id, status="failed", error=str(error))
            return self.update_job(job_id, status="failed", stage="failed", progress=STAGES["failed"], stage_label="Failed", error=str(error), completed_at=now())
        self.update_document(document_id, status="completed", **(changes or {}))
        return self.update_job(job_id, status="completed", stage="completed", progress=STAGES["completed"], stage_label="Completed", completed_at=now())

    # Files.

    def _file(self, base: str, name: str) -> bytes:
        """A file below a folder; names that lead out of it are not found."""
        path = posixpath.normpath(posixpath.join("/", name))
        if ".." in name.split("/") or name.startswith("/") or path == "/":
            raise NotFound(name)
        return read_bytes(f"{base}{path}")

    def page_file(self, document_id: str, filename: str) -> bytes:
        self.document(document_id)
        return self._file(f"{self.folder}/documents/{document_id}/outputs/pages", filename)

    def export_file(self, filename: str) -> bytes:
        return self._file(f"{self.folder}/exports", filename)
