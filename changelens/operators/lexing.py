"""One linear pass over a file's text: its strings, comments, brackets, words and marks in order.

Scripts (JavaScript, TypeScript) have templates, whose ``${...}`` hold code, and regular-expression literals; both
are told from division and text by what stands before them. Patterns are possessive, so no text makes them
go back over what they have read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

#: Languages by how a comment begins; fixed values.
HASH = ("py", "rb", "sh", "yaml", "yml", "toml", "ini", "cfg", "")
SCRIPT = ("js", "jsx", "mjs", "cjs", "ts", "mts", "cts", "tsx")
SLASH = (*SCRIPT, "go", "java", "kt", "rs", "cs", "php", "swift")

_REST = r"|(?P<open>[(\[{])|(?P<close>[)\]}])|(?P<word>[\w$]++)|(?P<mark>\S)"
_SHORT = r"\"(?:[^\"\\\n]++|\\.)*+\"|'(?:[^'\\\n]++|\\.)*+'"
_HASH = re.compile(rf"(?P<text>\b[rbfuRBFU]{{0,2}}(?:\"\"\"(?:[^\\\"]++|\\.|\"(?!\"\"))*+\"\"\"|'''(?:[^\\']++|\\.|'(?!''))*+'''|{_SHORT})|\"\"\"(?:[^\\\"]++|\\.|\"(?!\"\"))*+\"\"\"|'''(?:[^\\']++|\\.|'(?!''))*+'''|{_SHORT})|(?P<comment>\#[^\n]*+){_REST}", re.S)
_SLASHED = rf"(?P<comment>//[^\n]*+|/\*.*?(?:\*/|\Z))|(?P<text>{_SHORT}"
_SLASH = re.compile(rf"{_SLASHED}|`[^`]*+`){_REST}", re.S)
_SCRIPT = re.compile(rf"{_SLASHED})|(?P<tick>`){_REST}", re.S)
_TEMPLATE = re.compile(r"(?:[^`\\$]++|\\.|\\\Z|\$(?!\{))*+(?:`|\$\{|\Z)", re.S)
_PATTERN = re.compile(r"/(?:[^/\\\[\n]++|\\.|\[(?:[^\]\\\n]++|\\.)*+\])++/[a-z]*+")
#: Words after which a slash begins a pattern, and a bracket no subscript.
BEFORE_VALUE = frozenset(("return", "typeof", "case", "in", "of", "yield", "await", "delete", "void", "throw", "new", "else", "do", "instanceof", "and", "or", "not", "if", "default"))
PAIRS = {")": "(", "]": "[", "}": "{"}


class Token(NamedTuple):
    kind: str  # text, comment, open, close, word, mark
    start: int
    end: int
    value: str


def language(suffix: str) -> str | None:
    plain = suffix.lstrip(".")
    return "script" if plain in SCRIPT else "slash" if plain in SLASH else "hash" if plain in HASH else None


def tokens(suffix: str, text: str) -> Iterator[Token]:
    """The tokens of a file; none of a language that isn't known. A template comes in pieces, its code between them."""
    kind = language(suffix)
    if kind == "script":
        yield from _script(text)
    elif kind:
        for m in (_HASH if kind == "hash" else _SLASH).finditer(text):
            yield Token(m.lastgroup, m.start(), m.end(), m[0])


def _script(text: str) -> Iterator[Token]:
    at, before, make = 0, None, Token._make
    holes: list[int] = []  # for each open template, how many braces are open in its code
    while m := _SCRIPT.search(text, at):
        kind, start, at = m.lastgroup, m.start(), m.end()
        if kind == "tick" or (m[0] == "}" and holes and holes[-1] == 0):
            if kind != "tick":
                holes.pop()
                yield Token("close", start, at, "}")
            piece = _TEMPLATE.match(text, at)
            start, at = (start, piece.end()) if kind == "tick" else (at, piece.end())
            before = Token("text", start, at, text[start:at])
            yield before
            if piece[0].endswith("${"):
                holes.append(0)
                before = Token("open", at - 1, at, "{")
                yield before
            continue
        if m[0] == "/" and (before is None or before.kind == "open" or before.kind == "mark" or before.value in BEFORE_VALUE) and (pattern := _PATTERN.match(text, start)):
            kind, at = "text", pattern.end()
        elif holes and m[0] in "{}":
            holes[-1] += 1 if m[0] == "{" else -1
        token = make((kind, start, at, m[0] if kind != "text" else text[start:at]))
        if kind != "comment":
            before = token
        yield token


class Brackets:
    """What is open, as tokens are read in order. A closing bracket of another kind than the last open one is passed over."""

    def __init__(self) -> None:
        self.open: list[Token] = []

    def read(self, token: Token) -> Token | None:
        """The opening bracket that a token closes, if it does."""
        if token.kind == "open":
            self.open.append(token)
        elif token.kind == "close" and self.open and self.open[-1].value == PAIRS[token.value]:
            return self.open.pop()
        return None
