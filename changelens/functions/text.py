"""Text: lines, tokens, globs, slugs, normal forms."""

from __future__ import annotations

import html
import json
import re
from collections.abc import Callable, Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The separators at which a text's lines end, CRLF being one.
LINE_END = "\\r\\n|[\\n\\r\\u000b\\u000c\\u001c-\\u001e\\u0085\\u2028\\u2029]"
WORD = "A-Za-z0-9_"


def lines(df: DataFrame, text: str = "text", keep: Sequence[str] = ()) -> DataFrame:
    """A row for each line: ``keep``, line_no (from 1), line; the end of the last line doesn't begin another."""
    parts = F.split(F.col(text), LINE_END)
    parts = F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)
    return df.select(*keep, F.posexplode(parts).alias("_at", "line")).select(*keep, (F.col("_at") + 1).alias("line_no"), "line")


def _edge(char: str) -> bool:
    return char.isascii() and char.isalnum()


def token_pattern(signature: str, model: bool = False, named: Iterable[str] = ()) -> str:
    """A regular expression (Java and Python) for a signature as a whole token.

    A side that ends in a letter or digit must not touch one or an underscore; a
    dot and a digit (also escaped) don't follow, as those make another version.
    ``mcp__server__`` may stand before it. model: ids with a further ``-suffix`` are
    others, but for snapshots (dates, three digits, latest) and those that ``named`` has, as whole ids or as ``-suffixes``.
    """
    left = rf"(?:(?<![{WORD}])|(?<=mcp__[{WORD}-]{{0,100}}__))" if _edge(signature[0]) else ""
    return left + re.escape(signature) + token_end(signature, model, named)


def token_end(signature: str, model: bool = False, named: Iterable[str] = ()) -> str:
    """The part of ``token_pattern`` that looks at what follows the signature."""
    right = rf"(?![{WORD}])(?!\.\d)(?!\\\.\d)" if _edge(signature[-1]) else ""
    if model and right:
        names = sorted({n.lower() for n in named}, key=lambda n: (-len(n), n))
        ids = "|".join(re.escape(n[len(signature) :]) for n in names if n.startswith(signature.lower() + "-"))
        ends = "|".join(re.escape(n) for n in names if n.startswith("-"))
        whole = rf"(?i:{ids})(?![{WORD}]|[-.][a-zA-Z0-9])" if ids else "(?!)"
        end = rf"(?i:{ends})(?![a-zA-Z0-9])" if ends else "(?!)"
        snapshot = rf"-(?:\d{{8}}|\d{{4}}-\d{{2}}-\d{{2}}|\d{{4}}|\d{{3}}|latest)(?![{WORD}]|\.)(?:(?!-[a-zA-Z])|(?={end}))"
        right += rf"(?:(?!-)|(?={snapshot})|(?={whole})|(?={end}))"
    return right


def glob_pattern(glob: str) -> str:
    """An anchored regular expression; a star crosses slashes."""
    out, i = "", 0
    while i < len(glob):
        c, end = glob[i], glob.find("]", i + 2)
        if c == "[" and end > 0:
            body = glob[i + 1 : end].replace("\\", "\\\\")
            out += "[" + ("^" + body[1:] if body[0] == "!" else body) + "]"
            i = end
        else:
            out += {"*": ".*", "?": "."}.get(c, re.escape(c))
        i += 1
    return rf"(?s)\A(?:{out})\z"


def file_matches(path: Column, globs: Sequence[str]) -> Column:
    """Whether a path or its last part fits a glob."""
    name = F.element_at(F.split(path, "/"), -1)
    return _any([path.rlike(glob_pattern(g)) | name.rlike(glob_pattern(g)) for g in globs])


def is_ignored(path: Column, patterns: Sequence[str]) -> Column:
    """Ignore rules: ``dir/`` is a directory anywhere or a prefix, a bare name any part, others globs."""
    found = []
    for p in patterns:
        if p.endswith("/"):
            folders = F.slice(F.split(path, "/"), 1, F.greatest(F.size(F.split(path, "/")) - 1, F.lit(0)))
            found.append(F.exists(folders, _fits(glob_pattern(p[:-1]))) if "/" not in p[:-1] else path.rlike(glob_pattern(p + "*")))
        else:
            found.append(path.rlike(glob_pattern(p)))
            if "/" not in p:
                found.append(F.exists(F.split(path, "/"), _fits(glob_pattern(p))))
    return _any(found)


def _fits(pattern: str) -> Callable[[Column], Column]:
    return lambda part: part.rlike(pattern)


def _any(conditions: Sequence[Column]) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | c
    return out


#: Names of test folders and files.
TEST_DIRS = ("test", "tests", "__tests__", "spec", "specs", "testdata", "fixtures", "__fixtures__", "__mocks__", "__snapshots__", "cassettes")
TEST_BEGIN = "test_"
TEST_ENDS = ("_test.py", "_test.go", ".test.ts", ".test.js", ".spec.ts", ".spec.js", ".test.tsx", ".spec.tsx")


def in_test(path: Column) -> Column:
    """Whether a file is a test: by its folders' names, or by its own."""
    parts = F.split(F.lower(F.replace(path, F.lit("\\"), F.lit("/"))), "/")
    folders, name = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), F.element_at(parts, -1)
    return F.arrays_overlap(folders, F.array(*map(F.lit, TEST_DIRS))) | name.startswith(TEST_BEGIN) | _any([name.endswith(x) for x in TEST_ENDS])


def vendor_slug(name: Column) -> Column:
    """Lower case; runs of anything but letters and digits become a hyphen."""
    return F.regexp_replace(F.regexp_replace(F.lower(name), r"[^\p{L}\p{N}]+", "-"), r"\A-+|-+\z", "")


def id_slug(name: Column) -> Column:
    """Lower case; anything but letters, digits and underscores becomes a hyphen, of several one, and none at an end."""
    slug = F.regexp_replace(F.regexp_replace(F.lower(name), "(?:[^a-z0-9_-]|-)+", "-"), r"\A[-_]+|[-_]+\z", "")
    return F.when(slug == "index", "index-id").otherwise(slug)


def clip(text: Column, size: int) -> Column:
    """At most ``size`` characters, cut at a space, with an ellipsis."""
    short = F.regexp_replace(F.substring(text, 1, size - 1), r"\s+\S*\z", "")
    return F.when(F.char_length(text) <= size, text).otherwise(F.concat(short, F.lit("…")))


def safe_name(name: Column, pattern: str = r"\A[A-Za-z0-9_.:/-]{1,128}\z") -> Column:
    """A plain name as it is, any other as its hash."""
    return F.when(name.rlike(pattern), name).otherwise(F.concat(F.lit("sha256:"), F.sha2(name, 256)))


#: Forms of a tool's plain name, of a hashed one, of paths and of what follows a tool's name in one.
TOOL_NAME = r"\A[A-Za-z0-9_.\-/]{1,128}\z"
HASHED = r"\Asha256:[0-9a-f]{64}\z"
PATH = r"\A[A-Za-z0-9_.\-/\[\]:]{1,600}\z"
PATH_REST = r"\A[A-Za-z0-9_.\-/\[\]]{0,256}\z"
UNSHOWN = r"[\x00-\x1f\x7f-\x9f\x{200b}-\x{200f}\x{202a}-\x{202e}\x{2060}-\x{2064}\x{feff}]"


def safe_tool(name: Column) -> Column:
    """A plain or hashed name as it is, any other as its hash; none for null."""
    kept = name.rlike(TOOL_NAME) | name.rlike(HASHED)
    return F.when(F.coalesce(name, F.lit("")) == "", "").when(kept, name).otherwise(F.concat(F.lit("sha256:"), F.sha2(name, 256)))


def safe_path(path: Column, tool: Column) -> Column:
    """A path of plain characters as it is, any other as a hash; below a tool only what is odd is hashed."""
    path, head = F.coalesce(path, F.lit("")), F.concat(F.lit("tool:"), tool)
    below = F.coalesce((tool != "") & path.startswith(head), F.lit(False))
    rest = F.substr(path, F.char_length(head) + 1)
    part = F.regexp_extract(rest, r"\A\.(?:input|output|annotations)", 0)
    rest = F.when(rest.rlike(PATH_REST), rest).otherwise(F.concat(part, F.lit(".sha256:"), F.sha2(rest, 256)))
    alone = F.when(path.rlike(PATH), path).otherwise(F.concat(F.lit("sha256:"), F.sha2(path, 256)))
    return F.when(path == "", "").when(below, F.concat(F.lit("tool:"), safe_tool(tool), rest)).otherwise(alone)


def plain_text(text: Column, size: int) -> Column:
    """At most ``size`` characters of a text without control and invisible ones; empty for null."""
    return F.substring(F.regexp_replace(F.coalesce(text, F.lit("")), UNSHOWN, ""), 1, size)


_DROPPED = re.compile(r"(?is)<style\b.*?</style\s*>|<script\b.*?</script\s*>|<!--.*?-->")
_SHOWN = re.compile(r"(?i)\b(?:label|title|alt|aria-label|datetime)\s*=\s*(?:\"([^\"]*)\"|'([^']*)')")
_INLINE = re.compile(r"(?i)</?(?:a|abbr|b|code|em|i|kbd|mark|s|small|span|strong|sub|sup|u|var|wbr)\b[^<>]*>")
_TAG = re.compile(r"<[a-zA-Z/!][^<>]*>")
_LINK = re.compile(r"!?\[([^\[\]]*)\]\([^()\s]*\)")
_FOLDS = str.maketrans({**dict.fromkeys("‐‑‒–—−", "-"), **dict.fromkeys("‘’", "'"), **dict.fromkeys("“”", '"'), " ": " ", **dict.fromkeys("​‌‍﻿⁠", None)})


def normal_text(page: str | None) -> str:
    """A page or a quotation in the form in which they are compared: no markup, plain quotes and dashes, single spaces, lower case."""
    text = _DROPPED.sub(" ", page or "")
    text = _INLINE.sub(lambda m: " ".join(a or b for a, b in _SHOWN.findall(m[0])), text)
    text = _TAG.sub(lambda m: " " + " ".join(a or b for a, b in _SHOWN.findall(m[0])) + " ", text)
    text = _LINK.sub(r"\1", html.unescape(text))
    text = re.sub(r"\\([\\`*_{}\[\]()#+\-.!|<>])", r"\1", text).translate(_FOLDS)
    return " ".join(text.replace("`", "").replace("*", "").split()).lower()


@F.arrow_udf(T.StringType())
def normalize(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for batch in batches:
        yield pa.array([normal_text(x.as_py()) for x in batch], pa.string())


def canonical(value: str | None) -> str | None:
    """JSON with sorted keys, without spaces, escaped to ASCII; null for what is no JSON."""
    try:
        return None if value is None else json.dumps(json.loads(value), sort_keys=True, separators=(",", ":"))
    except (ValueError, RecursionError):
        return None


@F.arrow_udf(T.StringType())
def canonical_json(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for batch in batches:
        yield pa.array([canonical(x.as_py()) for x in batch], pa.string())


def json_hash(value: Column) -> Column:
    return F.sha2(canonical_json(value), 256)
