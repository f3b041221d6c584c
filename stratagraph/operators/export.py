"""Export: payload, manifest, contract and compatibility."""

from __future__ import annotations

from datetime import datetime, timezone
from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the export contract.
SCHEMA_VERSION, CONTRACT_VERSION, PAYLOAD_TYPE = "1.0.0", "1.0", "architecture-index-document"
TARGETS = ["FILE", "HTTP_IMPORT"]


class ExportTarget(Protocol):
    """Anything that takes a finished bundle."""

    def publish(self, bundle: dict) -> None: ...


def manifest_columns(payload: Column, outcome: Column) -> list[Column]:
    sha = F.sha2(payload, 256)
    return [
        sha.alias("payload_sha256"),
        F.substring(sha, 1, 12).alias("export_id"),
        F.octet_length(payload).cast("long").alias("payload_size"),
        F.when(outcome == "FAILED", "do-not-import").otherwise("safe-to-import").alias("recommendation"),
    ]


def contract(producer: str) -> dict:
    return {"contractVersion": CONTRACT_VERSION, "schemaVersion": SCHEMA_VERSION, "producer": producer, "payloadType": PAYLOAD_TYPE, "acceptedTargets": TARGETS}


def compatibility(own: dict, schema_version: str) -> dict:
    return {
        "schemaVersionCompatible": own["schemaVersion"] == schema_version,
        "payloadTypeCompatible": own["payloadType"] == PAYLOAD_TYPE,
        "contractVersionCompatible": own["contractVersion"] == CONTRACT_VERSION,
    }


def evaluate(own: dict, document: dict) -> dict:
    """Whether a document may be imported under a contract."""
    parts = {"schemaMatches": own["schemaVersion"] == document.get("schemaVersion"), "payloadTypeMatches": own["payloadType"] == PAYLOAD_TYPE, "contractVersionSupported": own["contractVersion"] == CONTRACT_VERSION}
    return parts | {"compatible": all(parts.values())}


def write_tables(tables: dict[str, DataFrame], folder: str) -> None:
    """A table for each array of the document; the manifest comes last, so a folder with one is whole."""
    for name, frame in tables.items():
        frame.write.mode("overwrite").parquet(f"{folder}/{name}")


def write_manifest(spark: SparkSession, folder: str, counts: dict[str, int], outcome: str, producer: str) -> dict:
    """Digest of the written tables' rows, whatever their order, with counts, contract and recommendation."""
    digests = []
    for name in sorted(counts):
        rows = spark.read.parquet(f"{folder}/{name}")
        one = rows.select(F.xxhash64(F.to_json(F.struct(*sorted(rows.columns)))).cast("decimal(20,0)").alias("h")).agg(F.count("*"), F.sum("h")).first()
        digests.append(f"{name}:{one[0]}:{one[1]}")
    sha = spark.range(1).select(F.sha2(F.lit("|".join(digests)), 256)).first()[0]
    out = {
        "exportId": sha[:12],
        "generatedAt": datetime.now(timezone.utc).isoformat(),
        "payloadSha256": sha,
        "contract": contract(producer) | {"compatibility": compatibility(contract(producer), SCHEMA_VERSION) | {"targetRecommendation": "do-not-import" if outcome == "FAILED" else "safe-to-import"}},
        "metadata": counts | {"outcome": outcome},
    }
    spark.createDataFrame([out | {k: str(out[k]) for k in ("contract", "metadata")}]).coalesce(1).write.mode("overwrite").json(f"{folder}/manifest")
    return out
