"""Repositories as file tables: a folder, a git clone, and stored documents and snapshots."""

from __future__ import annotations

import json
import re
import subprocess
import sys
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StructField, StructType

from ..schemas import DIAGNOSTICS, ENTITIES, RELATIONSHIPS, SCOPES, SNAPSHOT


@dataclass(frozen=True)
class Source:
    repository_id: str
    folder: str
    acquisition: str
    branch: str | None = None
    revision: str | None = None
    has_remote: bool = False
    remote_url: str | None = None


def identity(explicit: str | None, fallback: str | None) -> str:
    return (explicit or "").strip() or fallback or "repository"


def repository_name(url: str) -> str:
    """Last part of a git URL, without ``.git``."""
    return re.sub(r"\.git$", "", re.split(r"[/:]", url.rstrip("/"))[-1])


def _git(*args: str, folder: str | None = None) -> str | None:
    done = subprocess.run(["git", *(["-C", folder] if folder else []), *args], capture_output=True, text=True)
    return done.stdout.strip() if done.returncode == 0 else None


def local(folder: str, repository_id: str | None = None) -> Source:
    """A folder; with what git tells where it is a work tree. A tree without commits has no revision."""
    import os

    if not os.path.isdir(folder):
        raise ValueError(f"not a directory: {folder}")
    folder = os.path.abspath(folder)
    name = identity(repository_id, os.path.basename(folder))
    if _git("rev-parse", "--is-inside-work-tree", folder=folder) != "true":
        return Source(name, folder, "LOCAL_PATH")
    return Source(name, folder, "LOCAL_PATH", _git("rev-parse", "--abbrev-ref", "HEAD", folder=folder), _git("rev-parse", "HEAD", folder=folder), bool(_git("remote", folder=folder)))


def clone(url: str, workspace: str, ref: str | None = None, repository_id: str | None = None) -> Source:
    """A shallow clone below ``workspace``, which the caller removes and which all executors must see."""
    name = repository_name(url)
    target = f"{workspace}/{name}"
    done = subprocess.run(["git", "clone", "--depth", "1", *(["--branch", ref] if ref else []), "--", url, target], capture_output=True, text=True)
    if done.returncode:
        raise RuntimeError(f"git clone failed: {done.stderr.strip()[-300:]}")
    got = local(target, identity(repository_id, name))
    return Source(got.repository_id, got.folder, "GIT", got.branch, got.revision, True, url)


def acquire(workspace: str, path: str | None = None, git_url: str | None = None, ref: str | None = None, repository_id: str | None = None) -> Source:
    if bool(path) == bool(git_url):
        raise ValueError("give either a path or a git URL")
    return local(path, repository_id) if path else clone(git_url, workspace, ref, repository_id)


def files(spark: SparkSession, folder: str) -> DataFrame:
    """(relative_path, size, content) of all regular files; content is null where it is not UTF-8."""
    root = folder if "://" in folder else f"file://{folder}"
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = root.rstrip("/").split("://", 1)[1]
    path = F.regexp_replace("path", f"^[a-z]+:/*{re.escape('/' + base.lstrip('/'))}/", "")
    text = F.when(F.is_valid_utf8(F.col("content").cast("string")), F.col("content").cast("string"))
    return found.select(F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))).alias("relative_path"), F.col("length").alias("size"), text.alias("content"))


def read_document(spark: SparkSession, path: str) -> DataFrame:
    """A stored document, one row; unknown fields are left out, parts that are objects come as JSON texts."""
    parts = "schemaVersion string, indexerVersion string, runMetadata string, source string, completeness string, metadata string"
    arrays = {"scopes": SCOPES, "entities": ENTITIES, "relationships": RELATIONSHIPS, "diagnostics": DIAGNOSTICS}
    schema = parts + "".join(f", {n} array<{_renamed(StructType.fromDDL(ddl)).simpleString()}>" for n, ddl in arrays.items())
    return spark.read.schema(schema).option("multiLine", True).json(path)


def table_of(document: DataFrame, name: str, ddl: str) -> DataFrame:
    """One array of a document as a table with our names; absent arrays are empty."""
    return _ours(document.select(F.explode(name).alias("r")), ddl)


def _ours(facts: DataFrame, ddl: str) -> DataFrame:
    rows = facts.select("r.*")
    return rows.select(*(F.col(_camel(f.name)).cast(f.dataType).alias(f.name) for f in StructType.fromDDL(ddl).fields))


#: More lines without a fact than a document of one fact a line has, and more characters than such a line has by which it is read here.
_MARKS, _MARK = 64, 1 << 16


def _lines(spark: SparkSession, path: str, at: int = -1, end: int = sys.maxsize) -> DataFrame:
    """(at, line): the lines of a text between two places, by their first bytes, which do not depend on how it is split."""
    kinds = ("org.apache.hadoop.mapreduce.lib.input.TextInputFormat", "org.apache.hadoop.io.LongWritable", "org.apache.hadoop.io.Text")
    found = spark.sparkContext.newAPIHadoopFile(path, *kinds).filter(lambda r: at < r[0] < end)
    return spark.createDataFrame(found, "at long, line string", verifySchema=False)


def _marks(spark: SparkSession, path: str) -> list[tuple[int, str]] | None:
    """The lines without a fact of a document of one fact a line, as ``document.write`` makes them; None for other layouts."""
    line = F.col("line")
    fact = line.startswith("{") & (line.endswith("}") | line.endswith("},") | line.endswith("}]") | line.endswith("}],"))
    marks = sorted(tuple(r) for r in _lines(spark, path).where(~fact).select("at", F.substring(line, 1, _MARK + 1)).limit(_MARKS).collect())
    if not 2 <= len(marks) < _MARKS or marks[0] != (0, "{") or marks[-1][1] != "}" or not all(m.startswith('"') for _, m in marks[1:-1]):
        return None
    return marks


def _places(marks: list[tuple[int, str]], names: list[str]) -> dict[str, tuple[int, int]] | None:
    """Between which lines the facts of each array stand; None where an array does not begin on a line of its own."""
    places = {}
    for (at, mark), (end, _) in zip(marks[1:-1], marks[2:]):
        name, _, rest = mark[1:].partition('": ')
        if name in names:
            if name in places or rest not in ("[", "[]", "[],"):
                return None
            places[name] = (at, end)
    return places


_PARTS = ["schemaVersion", "indexerVersion", "runMetadata", "source", "completeness", "metadata"]


def _head(marks: list[tuple[int, str]]) -> dict | None:
    """The parts of a document that stand on lines of their own; None if a line is too long, or not whole."""
    found = dict.fromkeys(_PARTS)
    for _, mark in marks[1:-1]:
        if mark.partition('": ')[2] in ("[", "[]", "[],"):
            continue
        try:
            parts = json.loads("{" + mark.removesuffix(",") + "}") if len(mark) <= _MARK else None
        except ValueError:
            parts = None
        if parts is None:
            return None
        found |= {k: v if v is None or isinstance(v, (str, dict, list)) else json.dumps(v) for k, v in parts.items() if k in found}
    return found


def document_parts(spark: SparkSession, path: str, arrays: dict[str, str]) -> tuple[dict, dict[str, DataFrame]]:
    """(head, tables) of a stored document. One fact a line is read in parallel, a line at a time; a document of another layout is read as one row, which one task must hold."""
    marks = _marks(spark, path)
    places = marks and _places(marks, list(arrays))
    whole, head = read_document(spark, path), _head(marks) if places is not None else None
    if head is None:
        parts = whole.select(*_PARTS).first().asDict(recursive=True)
        head = {k: json.loads(v) if isinstance(v, str) and v[:1] in "{[" else v for k, v in parts.items()}
    if places is None:
        return head, {n: table_of(whole, n, ddl) for n, ddl in arrays.items()}
    out = {}
    for name, ddl in arrays.items():
        own = _lines(spark, path, *places.get(name, (0, 0)))
        facts = F.from_json(F.concat(F.lit("["), F.regexp_replace("line", r"\]?,?\z", ""), F.lit("]")), ArrayType(_renamed(StructType.fromDDL(ddl))))
        bad = F.raise_error(F.concat(F.lit(f"{path}: no fact at byte "), F.col("at").cast("string")))
        out[name] = _ours(own.select(F.explode(F.coalesce(facts, bad)).alias("r")), ddl)
    return head, out


def document_tables(spark: SparkSession, path: str, arrays: dict[str, str]) -> dict[str, DataFrame]:
    """The arrays of a stored document as tables."""
    return document_parts(spark, path, arrays)[1]


def _camel(name: str) -> str:
    return re.sub(r"_(\w)", lambda m: m.group(1).upper(), name)


def _renamed(kind: DataType) -> DataType:
    """A type with its fields under their names in stored documents."""
    if isinstance(kind, StructType):
        return StructType([StructField(_camel(f.name), _renamed(f.dataType)) for f in kind.fields])
    return ArrayType(_renamed(kind.elementType)) if isinstance(kind, ArrayType) else kind


SNAPSHOT_VERSION = "1"


def write_snapshot_json(spark: SparkSession, snapshot: DataFrame, path: str, total: int | None = None) -> None:
    """One JSON object with the files by path, as one file below the folder ``path``."""
    row = F.struct(*(F.col(f.name).alias(_camel(f.name)) for f in StructType.fromDDL(SNAPSHOT).fields))
    # one repository's files
    one = snapshot.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("relative_path", row)))).alias("filesByPath"), F.count("*").alias("n"))
    made = F.struct(F.lit(SNAPSHOT_VERSION).alias("schemaVersion"), F.current_timestamp().alias("createdAt"), "filesByPath", F.create_map(F.lit("indexedFileCount"), F.col("n"), F.lit("totalFileCount"), F.lit(total).cast("long") if total is not None else F.col("n")).alias("metadata"))
    one.select(F.to_json(made, {"ignoreNullFields": "false"}).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def _snapshot_table(spark: SparkSession, path: str) -> DataFrame:
    found = spark.read.schema(SNAPSHOT).parquet(path)
    found.isEmpty()
    return found


def _snapshot_json(spark: SparkSession, path: str) -> DataFrame:
    entry = _renamed(StructType.fromDDL(SNAPSHOT)).simpleString()
    rows = spark.read.schema(f"schemaVersion string, filesByPath map<string,{entry}>").option("multiLine", True).json(path)
    if rows.where("filesByPath is not null").isEmpty():
        raise ValueError("no files by path")
    fields = [F.col(f"r.{_camel(f.name)}").cast(f.dataType).alias(f.name) for f in StructType.fromDDL(SNAPSHOT).fields]
    return rows.select(F.explode(F.map_values("filesByPath")).alias("r")).select(*fields)


def read_snapshot(spark: SparkSession, path: str) -> DataFrame | None:
    """A stored snapshot, JSON where the path ends in .json, else Parquet; None if there is none to read, so that all files count as added."""
    try:
        return (_snapshot_json if path.rstrip("/").endswith(".json") else _snapshot_table)(spark, path)
    except Exception as error:
        print(f"no previous snapshot at {path}: {str(error)[:200]}", file=sys.stderr)
        return None
