"""Rules on source snippets: qualified names, annotations, configuration entries, SQL tables."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The patterns that results depend on.
QUALIFIED_NAME = r"([A-Za-z_][\w.]*\*?)"
ANNOTATION_NAME = r"@([A-Za-z_][\w.]*)"
IDENTIFIER = r"([A-Za-z_][\w$]*)"
IMPORT_FROM = r"from\s+['\"]([^'\"]+)['\"]"
CREATE_TABLE = r"(?i)\bcreate\s+table\s+(?:if\s+not\s+exists\s+)?([A-Za-z_][\w.$]*)"
INTO_TABLE = r"(?i)\b(?:insert\s+into|update|delete\s+from|truncate\s+table)\s+([A-Za-z_][\w.$]*)"
FROM_TABLE = r"(?i)\b(?:from|join)\s+([A-Za-z_][\w.$]*)"
COLON_PAIR = r"(?s)^\s*['\"]?([A-Za-z0-9_.\-/]+)['\"]?\s*:\s*(.+?)\s*$"
EQUALS_PAIR = r"(?s)^\s*([A-Za-z0-9_.\-]+)\s*=\s*(.+?)\s*$"
QUOTED = r"\"([^\"]+)\"|'([^']+)'"
XML_ELEMENT = r"(?s)^\s*<([A-Za-z0-9_.:-]+)>(.*?)</\1>\s*$"
XML_ATTRIBUTE = r"([A-Za-z0-9_.:-]+)\s*=\s*['\"]([^'\"]+)['\"]"
JDBC = r"(jdbc:[A-Za-z0-9:;_./?=&%-]+)"
URL = r"(https?://[^\s'\"<>)]+)"
HOST_PORT = r"\b([A-Za-z0-9_.-]+:\d{2,5})\b"
ENDPOINT_PATH = r"(['\"])(/[^'\"]*)\1"
DATASTORE_WORDS = ["datasource", "jdbc:", "postgres", "mysql", "oracle", "mssql", "sqlite"]
VALUE_CHARS = 120


def all_matches(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(1))


def _or_null(text: Column) -> Column:
    return F.when(text != "", text)


def qualified_name(text: Column) -> Column:
    """The last qualified name, or null."""
    return F.try_element_at(all_matches(text, QUALIFIED_NAME), F.lit(-1))


def annotations(text: Column) -> Column:
    return all_matches(text, ANNOTATION_NAME)


def java_import(text: Column) -> Column:
    bare = F.regexp_replace(F.regexp_replace(text, r"^\s*import\s+", ""), r";\s*$", "")
    return qualified_name(bare)


def java_method_name(text: Column) -> Column:
    """The last identifier before the first parenthesis."""
    return F.try_element_at(all_matches(F.substring_index(text, "(", 1), IDENTIFIER), F.lit(-1))


def import_source(text: Column) -> Column:
    return _or_null(F.regexp_extract(text, IMPORT_FROM, 1))


def package_from_path(path: Column) -> Column:
    after = F.regexp_extract(path, r"^.*?/java/(.+)/[^/]*$", 1)
    folder = F.regexp_extract(path, r"^(.+)/[^/]*$", 1)
    marked = path.contains("/java/") & (after != "")
    return F.translate(F.when(marked, after).when(folder != "", folder).otherwise(F.lit("default")), "/", ".")


def created_table(text: Column) -> Column:
    return _or_null(F.regexp_extract(text, CREATE_TABLE, 1))


def referenced_tables(text: Column) -> Column:
    """Tables written, then tables read, each once."""
    return F.array_union(all_matches(text, INTO_TABLE), all_matches(text, FROM_TABLE))


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def _let(value: Column, use) -> Column:
    """``use`` of a value that is made once, however often it occurs there."""
    return F.get(F.transform(F.array(value), lambda x: use(x)), F.lit(0))


def sanitised(text: Column) -> Column:
    """One line, single spaces, without one pair of outer quotes."""
    flat = F.regexp_replace(F.translate(strip(text), "\n\r", "  "), r"\s+", " ")
    paired = lambda x: (F.length(x) > 1) & ((x.startswith('"') & x.endswith('"')) | (x.startswith("'") & x.endswith("'")))
    return _let(flat, lambda x: F.when(paired(x), F.substring(x, F.lit(2), F.length(x) - 2)).otherwise(x))


def compact_value(text: Column) -> Column:
    return F.substring(sanitised(F.coalesce(text, F.lit(""))), 1, VALUE_CHARS)


def undecorated(text: Column) -> Column:
    """The first quoted part; else the text if it opens a bracket; else without one trailing comma or brace."""

    def use(plain: Column) -> Column:
        first, second = F.regexp_extract(plain, QUOTED, 1), F.regexp_extract(plain, QUOTED, 2)
        return F.when(first != "", first).when(second != "", second).when(plain.rlike(r"^[{\[<]"), plain).otherwise(F.regexp_replace(plain, r"[,}]\s*$", ""))

    return _let(strip(text), use)


def config_pair(language: Column, text: Column) -> Column:
    """struct(key, value) of one entry, or null."""

    def use(snippet: Column) -> Column:
        def pair(pattern: str, fix=lambda x: x) -> Column:
            return F.when(snippet.rlike(pattern), F.struct(F.regexp_extract(snippet, pattern, 1).alias("key"), compact_value(fix(F.regexp_extract(snippet, pattern, 2))).alias("value")))

        xml = F.coalesce(pair(XML_ELEMENT), pair(XML_ATTRIBUTE))
        return F.when(language.isin("json", "yaml"), pair(COLON_PAIR, undecorated)).when(language == "properties", pair(EQUALS_PAIR)).when(language == "xml", xml)

    return F.when(F.trim(text) != "", _let(sanitised(text), use))


def dependency_targets(key: Column, value: Column) -> Column:
    """JDBC URLs, URLs, host:port pairs, then the value of datasource and bootstrap-servers keys."""
    name, trimmed = F.lower(F.coalesce(key, F.lit(""))), F.trim(F.coalesce(value, F.lit("")))
    by_key = [F.when(name.contains(w) & (trimmed != ""), trimmed) for w in ("datasource", "bootstrap-servers")]
    found = F.concat(*(all_matches(F.coalesce(value, F.lit("")), p) for p in (JDBC, URL, HOST_PORT)), F.array_compact(F.array(*by_key)))
    return F.array_distinct(F.filter(F.transform(found, lambda x: F.trim(x)), lambda x: x != ""))


def datastore_like(key: Column, value: Column) -> Column:
    both = F.lower(F.concat_ws(" ", F.coalesce(key, F.lit("")), F.coalesce(value, F.lit(""))))
    return both.rlike("|".join(DATASTORE_WORDS))


def ends_with_any(text: Column, words: list[str]) -> Column:
    low = F.lower(text)
    out = F.lit(False)
    for w in words:
        out = out | low.endswith(w)
    return out


def any_ends_with(names: Column, words: list[str]) -> Column:
    return F.exists(names, lambda x: ends_with_any(x, words))


def endpoint_path(text: Column) -> Column:
    """The first quoted text that starts with a slash, else ``/``."""
    found = F.regexp_extract(text, ENDPOINT_PATH, 2)
    return F.when(found != "", found).otherwise(F.lit("/"))


def http_method(annotation: Column) -> Column:
    low = F.lower(annotation)
    out = F.lit("REQUEST")
    for verb in ("patch", "delete", "put", "post", "get"):
        out = F.when(low.endswith(f"{verb}mapping"), F.lit(verb.upper())).otherwise(out)
    return out
