"""Stable ids: a prefix and the CRC32 of a token in hex, without leading zeros.

While facts are made and joined their ids also end with a digest, as different tokens
may have one CRC32; ``settled`` drops it wherever it is not needed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

REPO_SCOPE = "scope:repo"


def _col(x: Column | str) -> Column:
    return F.lit(x) if isinstance(x, str) else x


def stable_token(token: Column) -> Column:
    return F.lower(F.hex(F.crc32(token)))


#: The end of an id that tells tokens of one CRC32 apart: half of the SHA-256 of its token's parts.
_DIGEST = "~[0-9a-f]{32}$"


def plain(id: Column) -> Column:
    """An id without its digest, as documents hold it: a prefix and a CRC32."""
    return F.regexp_replace(id, _DIGEST, "")


def _id(prefix: Column | str, token: Column, *parts: Column) -> Column:
    """The stable id of ``token`` and the digest of its ``parts``: a CRC32 has 32 bits, so some tens of thousands of facts share one now and then."""
    digest = F.substring(F.sha2(F.concat_ws("\0", *(F.coalesce(p, F.lit("\1")) for p in parts or (token,))), 256), 1, 32)
    return F.concat(_col(prefix), F.lit(":"), stable_token(token), F.lit("~"), digest)


def file_entity_id(path: Column) -> Column:
    return _id("entity:file", path)


def scoped_entity_id(language: Column | str, path: Column, name: Column, line: Column) -> Column:
    parts = [path, name, line.cast("string")]
    return _id(F.concat(F.lit("entity:"), _col(language)), F.concat_ws(":", *parts), *parts)


def external_entity_id(language: Column | str, name: Column) -> Column:
    return _id(F.concat(F.lit("entity:external:"), _col(language)), name)


def inferred_entity_id(kind: str, source: Column, *more: Column) -> Column:
    """The id of what is inferred from the entity ``source``."""
    return _id(f"entity:external:{kind}", F.concat_ws(":", plain(source), *more), source, *more)


def relationship_id(prefix: Column | str, source: Column, target: Column, label: Column) -> Column:
    token = F.concat(plain(source), F.lit(":"), plain(target), F.lit(":"), F.coalesce(label, F.lit("null")))
    return _id(F.concat(F.lit("rel:"), _col(prefix)), token, source, target, label)


def scope_id(kind: Column | str, value: Column) -> Column:
    return _id(F.concat(F.lit("scope:"), _col(kind)), value)


def shared(rows: DataFrame) -> DataFrame:
    """(plain) ids that several rows share; few, so that they can be broadcast."""
    return rows.select("id", plain(F.col("id")).alias("plain")).groupBy("plain").agg(F.count_distinct("id").alias("n")).where("n > 1").select("plain")


def settled(rows: DataFrame, shared: DataFrame, *columns: str) -> DataFrame:
    """``rows`` with plain ids in the columns; ids whose plain one is ``shared`` keep their digest, so that ids stay unique."""
    for column in columns:
        own = plain(F.col(column))
        rows = rows.join(shared.select(F.col("plain").alias("__plain")), own == F.col("__plain"), "left")
        rows = rows.withColumn(column, F.when(F.col("__plain").isNull(), own).otherwise(F.col(column))).drop("__plain")
    return rows


def scope_or_repo(scope: Column) -> Column:
    """Null or blank scopes belong to the repository."""
    return F.when(scope.isNull() | (F.trim(scope) == ""), F.lit(REPO_SCOPE)).otherwise(scope)
