"""Jobs from request files: strict request, one run, one result."""

from __future__ import annotations

import json
import os
import re
import time
import uuid
from dataclasses import asdict, dataclass, fields
from datetime import datetime, timezone

from pyspark.sql import SparkSession

from .operators.incremental import snapshot
from .parse.runtime import Configuration, default_backend, detect
from .plans import document, pipeline
from .sources import repository
from .workspace import local, remove, shared, uri


@dataclass(frozen=True)
class JobRequest:
    jobId: str | None = None
    repositoryId: str | None = None
    sourcePath: str | None = None
    gitUrl: str | None = None
    gitRef: str | None = None
    outputPath: str | None = None
    snapshotIn: str | None = None
    snapshotOut: str | None = None

    @staticmethod
    def read(text: str) -> "JobRequest":
        """Fields that are not known are an error."""
        given = json.loads(text)
        unknown = set(given) - {f.name for f in fields(JobRequest)}
        if unknown:
            raise ValueError(f"unknown fields: {sorted(unknown)}")
        return JobRequest(**given)


def safe_job_id(value: str) -> str:
    return re.sub(r"[^A-Za-z0-9._-]", "_", value)


def _now() -> str:
    return datetime.now(timezone.utc).isoformat()


def run_job(spark: SparkSession, request: JobRequest, workspace: str | None = None) -> dict:
    """Index what the request names. ``workspace``: a path or URI that the cluster shares. A path wins over a git URL.

    An outputPath that ends in .json gets the document, with its manifest beside it; any other is a folder
    of tables. Snapshots to and from a path that ends in .json are JSON.
    """
    if not (request.sourcePath or request.gitUrl):
        raise ValueError("sourcePath or gitUrl must be given")
    if not request.outputPath:
        raise ValueError("outputPath must be given")
    job = safe_job_id(request.jobId or str(uuid.uuid4()))
    started, clock = _now(), time.perf_counter()
    work = f"{shared(spark, workspace)}/{job}-{uuid.uuid4().hex}"
    out = {"jobId": job, "startedAt": started, "outputPath": request.outputPath}
    try:
        clone = None if request.sourcePath else request.gitUrl
        if clone:
            os.makedirs(local(work), exist_ok=True)
        source = repository.acquire(local(work) if clone else "", request.sourcePath, clone, request.gitRef, request.repositoryId)
        result = pipeline.index(spark, repository.files(spark, source.folder), f"{work}/tables", source.repository_id, source.acquisition, default_backend())
        previous = repository.read_snapshot(spark, request.snapshotIn) if request.snapshotIn else None
        _, plan = pipeline.refresh(spark, result, previous)
        if request.outputPath.endswith(".json"):
            top, manifest = document.write(spark, result, uri(request.outputPath), source, pipeline.VERSION, started)
            paths = plan.first().asDict()
            summary = document.console_summary(top, manifest, source, request.outputPath, paths, detect(Configuration.from_environment()).detail) | {"exportId": manifest["exportId"]}
        else:
            manifest = pipeline.export_index(spark, result, uri(request.outputPath))
            summary = plan.drop("parse_paths", "removed_paths").first().asDict() | {"exportId": manifest["exportId"]}
        if request.snapshotOut:
            taken = snapshot(result.inventory)
            if request.snapshotOut.endswith(".json"):
                repository.write_snapshot_json(spark, taken, uri(request.snapshotOut), result.inventory.count())
            else:
                taken.write.mode("overwrite").parquet(uri(request.snapshotOut))
        summary |= {"outcome": manifest["metadata"]["outcome"], "elapsedMs": int(1000 * (time.perf_counter() - clock))}
        return out | {"status": "SUCCESS", "finishedAt": _now(), "summary": summary}
    except Exception as error:
        root = error
        while root.__cause__:
            root = root.__cause__
        failed = {"error": type(error).__name__, "message": str(error)[:500], "rootCauseType": type(root).__name__, "rootCause": str(root)[:500], "elapsedMs": int(1000 * (time.perf_counter() - clock))}
        return out | {"status": "FAILED", "finishedAt": _now(), "summary": failed}
    finally:
        remove(spark, work)


def run_file(spark: SparkSession, request_path: str, result_path: str, workspace: str | None = None) -> dict:
    """Read a request file, run it, write the result file; fields without a value are left out."""
    with open(request_path, encoding="utf-8") as file:
        request = JobRequest.read(file.read())
    result = run_job(spark, request, workspace)
    with open(result_path, "w", encoding="utf-8") as file:
        json.dump({k: v for k, v in result.items() if v is not None}, file, indent=2)
    return result


def request_json(request: JobRequest) -> str:
    return json.dumps({k: v for k, v in asdict(request).items() if v is not None})
