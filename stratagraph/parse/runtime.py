"""Which parser runtime is at hand: configuration, detection, search for grammar libraries, and the registry made of them."""

from __future__ import annotations

import ctypes
import importlib.util
import os
import platform
from dataclasses import dataclass, field
from pathlib import Path

from .backends import Backend, Node, PlainBackend, Registry, Tree, UnavailableBackend

ENABLED, LIBRARIES = "STRATAGRAPH_GRAMMARS_ENABLED", "STRATAGRAPH_GRAMMARS_DIR"
#: Names that a listing of a library folder shows at most.
LISTED = 20


@dataclass(frozen=True)
class Language:
    """A language and the grammar library that parses it; one that is not active is known but has no parser."""

    key: str
    library: str
    symbol: str
    endings: tuple[str, ...]
    active: bool = True


# The languages that have a grammar, their libraries, symbols and endings.
ACTIVE = [
    Language("java", "tree-sitter-java", "tree_sitter_java", (".java",)),
    Language("typescript", "tree-sitter-typescript", "tree_sitter_typescript", (".ts", ".tsx")),
    Language("json", "tree-sitter-json", "tree_sitter_json", (".json",)),
    Language("yaml", "tree-sitter-yaml", "tree_sitter_yaml", (".yaml", ".yml")),
    Language("sql", "tree-sitter-sql", "tree_sitter_sql", (".sql",)),
    Language("properties", "tree-sitter-properties", "tree_sitter_properties", (".properties",)),
    Language("xml", "tree-sitter-xml", "tree_sitter_xml", (".xml",)),
]
KNOWN = [Language("javascript", "tree-sitter-javascript", "tree_sitter_javascript", (".js", ".jsx"), False)]


@dataclass(frozen=True)
class Configuration:
    enabled: bool = True
    folder: Path | None = None

    @staticmethod
    def from_environment(env: dict[str, str] | None = None) -> "Configuration":
        env = dict(os.environ) if env is None else env
        folder = env.get(LIBRARIES, "").strip()
        return Configuration(env.get(ENABLED, "true").lower() != "false", Path(folder) if folder else None)

    def facts(self) -> dict:
        """Null values become empty texts."""
        out = {"enabled": self.enabled, "configuredFolder": self.folder, "system": platform.system(), "machine": platform.machine(), "python": platform.python_version()}
        if self.folder:
            out |= {"folderExists": self.folder.exists(), "folderIsDirectory": self.folder.is_dir(), "folderContents": listing(self.folder)}
        return {k: "" if v is None else str(v) if isinstance(v, Path) else v for k, v in out.items()}


@dataclass(frozen=True)
class Status:
    available: bool
    detail: str
    facts: dict = field(default_factory=dict)


def listing(folder: Path) -> list[str]:
    """The first names of a folder, sorted; for messages only."""
    return sorted(os.listdir(folder))[:LISTED] if folder.is_dir() else []


def library_file(base: str, system: str | None = None) -> str:
    system = (system or platform.system()).lower()
    if system.startswith("win"):
        return f"{base}.dll"
    return f"lib{base}.dylib" if system in ("darwin", "macos") else f"lib{base}.so"


def platform_folder(system: str | None = None, machine: str | None = None) -> str:
    system, machine = (system or platform.system()).lower(), (machine or platform.machine()).lower()
    plain = lambda x: "".join(c if c.isalnum() else "-" for c in x)
    name = {"darwin": "macos", "windows": "windows", "linux": "linux"}.get(system, plain(system))
    kind = {"arm64": "aarch64", "aarch64": "aarch64", "amd64": "x86_64", "x64": "x86_64", "x86_64": "x86_64"}.get(machine, plain(machine))
    return f"{name}-{kind}"


def locate(base: str, configuration: Configuration, root: Path | None = None) -> str:
    """The library's path: from the configured folder, else ``lib/<platform>``, else ``lib``, else by its bare name, which the system looks up. Raises if a folder is configured and it is in none of them."""
    name, root = library_file(base), root or Path.cwd()
    folders = [*([configuration.folder] if configuration.folder else []), root / "lib" / platform_folder(), root / "lib"]
    for folder in folders:
        if (folder / name).exists():
            return str((folder / name).resolve())
    if configuration.folder:
        raise FileNotFoundError(f"{name} is in none of {[str(f) for f in folders]}")
    return name


def detect(configuration: Configuration) -> Status:
    facts = configuration.facts()
    if not configuration.enabled:
        return Status(False, "Grammar parsing is switched off by configuration", facts)
    if importlib.util.find_spec("tree_sitter") is None:
        return Status(False, "No grammar runtime is installed", facts)
    return Status(True, "A grammar runtime is installed", facts)


class GrammarBackend:
    """Parses with grammar libraries, where their runtime is installed."""

    name = "grammar"

    def __init__(self, language: Language, configuration: Configuration):
        self.language, self.path = language, locate(language.library, configuration)
        self._parser = None

    def _load(self):
        if self._parser is None:  # in the worker process, not on the driver
            import tree_sitter

            function = getattr(ctypes.CDLL(self.path), self.language.symbol)
            function.restype = ctypes.c_void_p
            self._parser = tree_sitter.Parser(tree_sitter.Language(function()))
        return self._parser

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_parser": None}

    def parse(self, language: str, text: str) -> Tree:
        raw = text.encode()
        top = self._load().parse(raw).root_node
        # places count characters, the runtime counts bytes
        ends = [0, *(len(c.encode()) for c in text)]
        for i in range(1, len(ends)):
            ends[i] += ends[i - 1]
        place = {b: i for i, b in enumerate(ends)}
        root = Node(top.type, place[top.start_byte], place[top.end_byte], error=top.is_error)
        stack = [(top, root)]
        while stack:
            found, node = stack.pop()
            for child in found.children:
                made = Node(child.type, place[child.start_byte], place[child.end_byte], error=child.is_error or child.is_missing)
                node.children.append(made)
                stack.append((child, made))
        return Tree(root, text)


def grammar_registry(configuration: Configuration | None = None) -> Registry:
    """A backend for each active language: its grammar where runtime and library are there, else one that says that it is unavailable."""
    configuration = configuration or Configuration.from_environment()
    status = detect(configuration)
    backends: dict[str, Backend] = {}
    for language in ACTIVE:
        try:
            backends[language.key] = GrammarBackend(language, configuration) if status.available else UnavailableBackend(status.detail)
        except OSError as error:
            backends[language.key] = UnavailableBackend(str(error))
    return Registry(backends)


def default_backend(configuration: Configuration | None = None) -> Backend:
    """Grammars where their runtime is installed, else the plain scanners."""
    configuration = configuration or Configuration.from_environment()
    return grammar_registry(configuration) if detect(configuration).available else PlainBackend()

