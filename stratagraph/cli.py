"""Command line: index a folder or a git repository, or run a job file."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession

from . import worker
from .plans.pipeline import VERSION


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="stratagraph")
    out.add_argument("--version", action="version", version=VERSION)
    out.add_argument("--source")
    out.add_argument("--git-url")
    out.add_argument("--git-ref")
    out.add_argument("--repository-id")
    out.add_argument("--output")
    out.add_argument("--snapshot-in")
    out.add_argument("--snapshot-out")
    out.add_argument("--worker-request")
    out.add_argument("--worker-result")
    out.add_argument("--workspace", help="a folder that the whole cluster shares; else spark.checkpoint.dir")
    return out


def main(args: list[str] | None = None) -> int:
    given = parser().parse_args(args)
    job = bool(given.worker_request and given.worker_result)
    if not job and (bool(given.source) == bool(given.git_url) or not given.output):
        parser().print_help(sys.stderr)
        return 2
    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if job:
        result = worker.run_file(spark, given.worker_request, given.worker_result, given.workspace)
    else:
        request = worker.JobRequest(None, given.repository_id, given.source, given.git_url, given.git_ref, given.output, given.snapshot_in, given.snapshot_out)
        result = worker.run_job(spark, request, given.workspace)
    # a document's run prints its summary, others the job's result
    print(json.dumps(result["summary"] if result["status"] == "SUCCESS" and "exportManifestPreview" in result["summary"] else result, indent=2, default=str))
    return int(result["status"] != "SUCCESS")


if __name__ == "__main__":
    sys.exit(main())
