"""File inventory: classification, ignore rules, technology markers and totals."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths

# Which extension gives which language and type, and which content tells a technology.
LANGUAGE_OF = {
    "java": "java", "js": "javascript", "jsx": "javascript", "ts": "typescript", "tsx": "typescript", "sql": "sql",
    "json": "json", "yaml": "yaml", "yml": "yaml", "properties": "properties", "xml": "xml",
}
SOURCES = ["java", "kt", "js", "jsx", "ts", "tsx"]
DOCUMENTATION = ["md", "txt", "rst"]
CONFIG_ENDINGS = [".properties", ".yaml", ".yml", ".json", ".xml"]
BUILD_MARKERS = {"spring": ["spring-boot", "org.springframework"], "quarkus": ["quarkus"]}
NODE_MARKERS = {"react": ['"react"'], "nextjs": ['"next"'], "typescript": ['"typescript"']}
SETTING_MARKERS = {"spring": ["spring."], "quarkus": ["quarkus."]}


@dataclass(frozen=True)
class ScanOptions:
    ignored_directories: list[str] = field(default_factory=lambda: [".git", ".idea", ".gradle", "node_modules", "target", "build", "dist", "out"])
    ignored_files: list[str] = field(default_factory=lambda: [".DS_Store"])
    marker_chars: int = 16384


def file_name(path: Column) -> Column:
    return F.lower(F.substring_index(path, "/", -1))


def extension(path: Column) -> Column:
    return F.regexp_extract(file_name(path), r"\.([^.]+)$", 1)


def _any(name: Column, endings: list[str]) -> Column:
    out = F.lit(False)
    for e in endings:
        out = out | name.endswith(e)
    return out


def file_type(path: Column) -> Column:
    name, ext = file_name(path), extension(path)
    config = name.isin("pom.xml", "package.json") | name.startswith("build.gradle") | _any(name, CONFIG_ENDINGS)
    return F.when(config, "config").when(ext == "sql", "sql").when(ext.isin(*SOURCES), "source").when(ext.isin(*DOCUMENTATION), "documentation").when(F.trim(ext) == "", "unknown").otherwise(ext)


def language(path: Column) -> Column:
    ext, out = extension(path), F.lit(None).cast("string")
    for known in sorted(set(LANGUAGE_OF.values())):
        out = F.when(ext.isin(*[e for e, to in LANGUAGE_OF.items() if to == known]), known).otherwise(out)
    return out


def ignored(path: Column, options: ScanOptions) -> Column:
    return paths.has_segment(path, options.ignored_directories + options.ignored_files)


def markers(path: Column, content: Column, options: ScanOptions) -> Column:
    """Technologies by name and content, then the language."""
    name, text = file_name(path), F.lower(F.substring(F.coalesce(content, F.lit("")), 1, options.marker_chars))
    build = (name == "pom.xml") | name.startswith("build.gradle")
    node = name == "package.json"
    setting = _any(name, [".properties", ".yaml", ".yml"])

    def told(where: Column, rules: dict[str, list[str]]) -> list[Column]:
        out = []
        for marker, words in rules.items():
            hit = F.lit(False)
            for w in words:
                hit = hit | F.contains(text, F.lit(w))
            out.append(F.when(where & hit, marker))
        return out

    found = [F.when(build, "build"), *told(build, BUILD_MARKERS), F.when(node, "node"), *told(node, NODE_MARKERS), *told(setting, SETTING_MARKERS), language(path)]
    return F.array_distinct(F.array_compact(F.array(*found)))


def inventory(files: DataFrame, options: ScanOptions | None = None) -> DataFrame:
    """files (relative_path, size, content) -> one classified row for each file; ignored ones are flagged, not dropped."""
    options, path = options or ScanOptions(), F.col("relative_path")
    return files.select(
        path,
        F.coalesce("size", F.lit(-1)).cast("long").alias("size"),
        extension(path).alias("extension"),
        file_type(path).alias("type"),
        language(path).alias("detected_language"),
        ignored(path, options).alias("ignored"),
        markers(path, F.col("content"), options).alias("candidate_technology_markers"),
    )


def in_order(rows: DataFrame) -> DataFrame:
    """The inventory in order of its paths, by their bytes."""
    return rows.orderBy("relative_path")


def summary(rows: DataFrame) -> DataFrame:
    """One row: totals, and the languages and markers of files that are not ignored."""
    own = F.when(~F.col("ignored"), F.col("candidate_technology_markers"))
    return rows.agg(
        F.count("*").alias("total_files"),
        F.count_if("ignored").alias("ignored_files"),
        F.count_if(~F.col("ignored")).alias("indexed_files"),
        F.array_sort(F.collect_set(F.when(~F.col("ignored"), F.col("detected_language")))).alias("languages"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set(own)))).alias("technologies"),
    )
