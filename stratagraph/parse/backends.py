"""Parser backends: a file's text in, syntax nodes out.

A backend is any object with ``name`` and ``parse(language, text)`` that gives a
``Tree`` or raises. The plain backends here cut source text with small scanners of
our own; they give the node types that extraction reads, and claim no more.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Protocol

SNIPPET = 200


@dataclass
class Node:
    type: str
    start: int
    end: int
    children: list["Node"] = field(default_factory=list)
    error: bool = False


@dataclass
class Tree:
    root: Node
    text: str

    def has_errors(self) -> bool:
        stack = [self.root]
        while stack:
            node = stack.pop()
            if node.error:
                return True
            stack += node.children
        return False


class Backend(Protocol):
    name: str

    def parse(self, language: str, text: str) -> Tree: ...


class Unavailable(Exception):
    """No parser for this language here."""


class UnavailableBackend:
    name = "unavailable"

    def __init__(self, why: str | None = None):
        self.why = why

    def parse(self, language: str, text: str) -> Tree:
        raise Unavailable(self.why or language)


class Registry:
    """A backend for each language; a language without one is not supported."""

    name = "registry"

    def __init__(self, backends: dict[str, Backend]):
        self.backends = dict(backends)

    @property
    def languages(self) -> list[str]:
        return list(self.backends)

    def find(self, language: str) -> Backend | None:
        return self.backends.get(language)

    def with_backends(self, more: dict[str, Backend]) -> "Registry":
        """The last backend given for a language counts."""
        return Registry({**self.backends, **more})

    def parse(self, language: str, text: str) -> Tree:
        return self.backends[language].parse(language, text)


def _words(text: str, pattern: str, kind: str, base: int = 0) -> list[Node]:
    return [Node(kind, m.start() + base, m.end() + base) for m in re.finditer(pattern, text)]


def _balanced(text: str, at: int, opening: str, closing: str) -> int:
    """Place after the bracket that closes the one at ``at``, or the text's end. Quoted text does not count."""
    depth, quote, i = 0, "", at
    while i < len(text):
        c = text[i]
        if quote:
            if c == "\\":
                i += 1
            elif c == quote:
                quote = ""
        elif c in "\"'`":
            quote = c
        elif c == opening:
            depth += 1
        elif c == closing:
            depth -= 1
            if not depth:
                return i + 1
        i += 1
    return len(text)


def _json(text: str) -> list[Node]:
    return _words(text, r'"[^"\n]+"\s*:\s*("(?:[^"\\\n]|\\.)*"|[^\s,{}\[\]]+|[\[{])', "pair")


def _yaml(text: str) -> list[Node]:
    return _words(text, r"(?m)^[ \t]*(?:- )?['\"]?[\w.\-/]+['\"]?[ \t]*:[ \t]+\S.*$", "block_mapping_pair")


def _properties(text: str) -> list[Node]:
    return _words(text, r"(?m)^[ \t]*[^#!\s][^\n]*$", "property")


def _xml(text: str) -> list[Node]:
    return _words(text, r"(?s)<([\w.:-]+)>[^<]*</\1>", "element") + _words(text, r"[\w.:-]+\s*=\s*(?:\"[^\"]*\"|'[^']*')", "attribute")


_SQL_KINDS = {"create": "create_table_statement", "insert": "insert_statement", "update": "update_statement", "delete": "delete_statement", "select": "select_statement", "truncate": "truncate_statement"}


def _sql(text: str) -> list[Node]:
    out = []
    for m in re.finditer(r"[^;]*\S[^;]*", text):
        lead = len(m.group()) - len(m.group().lstrip())
        word = m.group().split(None, 1)[0].lower()
        out.append(Node(_SQL_KINDS.get(word, "statement"), m.start() + lead, m.end()))
    return out


_ANNOTATION = r"@[\w.]+(?:\((?:[^()\"']|\"[^\"]*\"|'[^']*')*\))?"
_JAVA_TYPE = re.compile(rf"(?:{_ANNOTATION}\s*)*(?:\b(?:public|protected|private|abstract|final|static|sealed)\s+)*\b(class|interface|enum|record)\s+([A-Za-z_]\w*)")
_JAVA_METHOD = re.compile(rf"(?:{_ANNOTATION}\s*)*(?:\b(?:public|protected|private|static|final|abstract|synchronized|default)\s+)+(?:[\w<>\[\],.?]+\s+)?([A-Za-z_]\w*)\s*(\([^)]*\))")


def _code(text: str, kinds: list[tuple[re.Pattern, Callable[[re.Match], Node]]]) -> list[Node]:
    return [make(m) for pattern, make in kinds for m in pattern.finditer(text)]


def _body(text: str, at: int) -> int:
    """End of a declaration: of its block, or its semicolon."""
    m = re.compile(r"[{;]").search(text, at)
    return len(text) if not m else m.end() if m.group() == ";" else _balanced(text, m.start(), "{", "}")


def _java(text: str) -> list[Node]:
    marks = lambda m: [Node("annotation" if "(" in a.group() else "marker_annotation", m.start() + a.start(), m.start() + a.end()) for a in re.finditer(_ANNOTATION, text[m.start() : m.start(1)])]

    def type_(m: re.Match) -> Node:
        return Node(f"{m.group(1)}_declaration", m.start(), _body(text, m.end()), [*marks(m), Node("identifier", m.start(2), m.end(2))])

    def method(m: re.Match) -> Node:
        return Node("method_declaration", m.start(), _body(text, m.end()), [*marks(m), Node("identifier", m.start(1), m.end(1)), Node("formal_parameters", m.start(2), m.end(2))])

    out = _words(text, r"(?m)^\s*package\s+[\w.]+\s*;", "package_declaration") + _words(text, r"(?m)^\s*import\s+(?:static\s+)?[\w.*]+\s*;", "import_declaration")
    return out + _code(text, [(_JAVA_TYPE, type_), (_JAVA_METHOD, method)])


_DECORATED = rf"(?:{_ANNOTATION}\s*)*(?:\bexport\s+)?(?:\bdefault\s+)?(?:\babstract\s+)?(?:\basync\s+)?"
_TS = re.compile(rf"{_DECORATED}\b(class|interface|function)\s+([A-Za-z_$][\w$]*)")
_TS_ARROW = re.compile(r"\b([A-Za-z_$][\w$]*)\s*(?::[^=\n]+)?=\s*(?:async\s*)?(\([^)]*\)|[A-Za-z_$][\w$]*)\s*(?::[^=\n]+)?=>")


def _typescript(text: str) -> list[Node]:
    def declared(m: re.Match) -> Node:
        marks = [Node("decorator", m.start() + a.start(), m.start() + a.end()) for a in re.finditer(_ANNOTATION, text[m.start() : m.start(1)])]
        name = Node("type_identifier" if m.group(1) != "function" else "identifier", m.start(2), m.end(2))
        return Node(f"{m.group(1)}_declaration", m.start(), _body(text, m.end()), [*marks, name])

    def arrow(m: re.Match) -> Node:
        return Node("variable_declarator", m.start(), m.end(), [Node("identifier", m.start(1), m.end(1)), Node("arrow_function", m.start(2), m.end())])

    return _words(text, r"(?m)^\s*import\s[^;\n]*(?:;|$)", "import_statement") + _code(text, [(_TS, declared), (_TS_ARROW, arrow)])


SCANNERS = {"json": _json, "yaml": _yaml, "properties": _properties, "xml": _xml, "sql": _sql, "java": _java, "typescript": _typescript}


class PlainBackend:
    """Scanners for all active languages; nests what lies inside something else."""

    name = "plain-scanner"

    def parse(self, language: str, text: str) -> Tree:
        if language not in SCANNERS:
            raise Unavailable(language)
        root = Node("program" if language in ("java", "typescript") else "document", 0, len(text))
        stack = [root]
        for node in sorted(SCANNERS[language](text), key=lambda n: (n.start, -n.end)):
            while node.start >= stack[-1].end and len(stack) > 1:
                stack.pop()
            stack[-1].children.append(node)
            stack.append(node)
        return Tree(root, text)


def flatten(path: str, tree: Tree) -> Iterator[dict]:
    """Rows of the node table in pre-order, by an explicit stack; ``last`` closes each node's range."""
    lines = [0, *(m.end() for m in re.finditer("\n", tree.text))]
    import bisect

    def at(i: int) -> tuple[int, int]:
        line = bisect.bisect_right(lines, i) - 1
        return line, i - lines[line]

    rows, stack = [], [(tree.root, None, 0)]
    while stack:
        node, parent, depth = stack.pop()
        if isinstance(node, int):  # all below row ``node`` are done
            rows[node]["last"] = len(rows) - 1
            continue
        pre = len(rows)
        (sl, sc), (el, ec) = at(node.start), at(node.end)
        rows.append({"path": path, "pre": pre, "last": pre, "parent_pre": parent, "depth": depth, "type": node.type, "named": True, "error": node.error, "missing": False, "start_byte": node.start, "end_byte": node.end, "start_line": sl, "start_column": sc, "end_line": el, "end_column": ec, "text": tree.text[node.start : node.end][:SNIPPET]})
        stack.append((pre, None, 0))
        stack += [(child, pre, depth + 1) for child in reversed(sorted(node.children, key=lambda n: n.start))]
    return iter(rows)
