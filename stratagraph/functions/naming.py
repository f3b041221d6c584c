"""Display names of scopes and entities."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .paths import basename

# The kinds whose names are shortened, by what their names are.
PATH_SCOPES = ["FILE", "DIRECTORY", "MODULE"]
MEMBERS = ["FUNCTION", "CONFIG_ARTIFACT"]
TYPES = ["MODULE", "CLASS", "INTERFACE", "SERVICE", "PERSISTENCE_ADAPTER", "UI_MODULE", "STARTUP_POINT"]


def _looks_path(name: Column) -> Column:
    return name.contains("/") | name.contains("\\")


def _looks_qualified(name: Column, language: Column) -> Column:
    dotted = name.contains(".") & ~_looks_path(name) & ~name.contains(" ")
    loose = dotted & ~name.startswith(".") & ~name.endswith(".")
    strict = dotted & name.rlike(r"^[\p{L}_][\p{L}\p{Nd}_$]*(\.[\p{L}_][\p{L}\p{Nd}_$]*)+$")
    return F.when(F.lower(F.coalesce(language, F.lit(""))) == "java", loose).otherwise(strict)


def _base_path(name: Column) -> Column:
    return basename(F.translate(name, "\\", "/"))


def _blank(name: Column) -> Column:
    return name.isNull() | (F.trim(name) == "")


def scope_display_name(kind: Column, name: Column) -> Column:
    return F.when(_blank(name), name).when(kind.isin(*PATH_SCOPES), _base_path(name)).when(kind == "PACKAGE", basename(name, ".")).otherwise(name)


def member_name(name: Column, language: Column) -> Column:
    """After ``#``, else the last dotted part, else the file name."""
    return F.when(name.contains("#"), basename(name, "#")).when(_looks_qualified(name, language), basename(name, ".")).when(_looks_path(name), _base_path(name)).otherwise(name)


def type_name(name: Column, language: Column) -> Column:
    """After ``#``, else the file name, else the last dotted part."""
    return F.when(name.contains("#"), basename(name, "#")).when(_looks_path(name), _base_path(name)).when(_looks_qualified(name, language), basename(name, ".")).otherwise(name)


def entity_display_name(kind: Column, name: Column, language: Column) -> Column:
    return F.when(_blank(name), name).when(kind.isin(*MEMBERS), member_name(name, language)).when(kind.isin(*TYPES), type_name(name, language)).otherwise(name)
