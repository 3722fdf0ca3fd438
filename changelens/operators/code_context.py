"""What a hit in code is: in a comment, in prose, a use or an item of a list; and where a constant that holds it is used.

The lexers are small functions over one file's text, run by Arrow UDFs; what they
find meets hits in joins on file and line.
"""

from __future__ import annotations

import ast
import bisect
import posixpath
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpoint
from . import lexing

SPAN = pa.list_(pa.struct([("line", pa.int32()), ("start", pa.int32()), ("stop", pa.int32())]))
SPAN_SQL = "array<struct<line:int,start:int,stop:int>>"


def _by_line(text: str, begin: int, end: int, starts: list[int], first: int) -> Iterator[dict]:
    """A stretch of a text as one span for each line; ``first``: the line that it begins in."""
    for n in range(first, len(starts)):
        low, high = starts[n], starts[n + 1] - 1 if n + 1 < len(starts) else len(text)
        if low > end:
            return
        if max(begin, low) < min(end, high):
            yield {"line": n + 1, "start": max(begin, low) - low, "stop": min(end, high) - low}


def _line_starts(text: str) -> list[int]:
    return [0, *(m.end() for m in re.finditer("\n", text))]


def _code(suffix: str, text: str) -> list[lexing.Token]:
    return [t for t in lexing.tokens(suffix, text) if t.kind != "comment"]


def _statement_strings(text: str) -> list[tuple[int, int]] | None:
    """Places of the strings that are statements of their own, by Python's syntax tree; none of a text that has no such tree."""
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return None
    rows = text.split("\n")
    starts = _line_starts(text)
    place = lambda line, column: starts[line - 1] + len(rows[line - 1].encode()[:column].decode(errors="ignore"))  # noqa: E731  columns are counted in bytes
    found = (n.value for n in ast.walk(tree) if isinstance(n, ast.Expr) and isinstance(n.value, ast.Constant) and isinstance(n.value.value, str))
    return [(place(n.lineno, n.col_offset), place(n.end_lineno, n.end_col_offset)) for n in found]


def _alone(text: str, code: list[lexing.Token]) -> list[tuple[int, int]]:
    """Places of the strings that stand alone on their lines, outside brackets and not as values."""
    around = [None, *code, None]
    apart = lambda a, b: "\n" in text[a:b]
    out = []
    for before, t, after in zip(around, around[1:], around[2:], strict=False):
        if t and t.kind == "text" and (before is None or (apart(before.end, t.start) and before.kind != "open" and before.value not in (",", "="))) and (after is None or apart(t.end, after.start)):
            out.append((t.start, t.end))
    return out


def comment_spans(suffix: str, text: str, found: list[lexing.Token] | None = None) -> list[dict]:
    """Comments, and in Python strings that stand alone as statements (documentation), line by line. found: the text's tokens, if they are known."""
    found = list(lexing.tokens(suffix, text)) if found is None else found
    places = [(t.start, t.end) for t in found if t.kind == "comment"]
    if suffix.lstrip(".") == "py":
        said = _statement_strings(text)
        places += _alone(text, [t for t in found if t.kind != "comment"]) if said is None else said
    starts = _line_starts(text)
    return [row for a, b in sorted(places) for row in _by_line(text, a, b, starts, bisect.bisect_right(starts, a) - 1)]


def list_spans(suffix: str, text: str, found: list[lexing.Token] | None = None) -> list[dict]:
    """Strings that are items of a list, set or map of literals at any depth, line by line: tables rather than uses."""
    starts, out, brackets = _line_starts(text), [], lexing.Brackets()
    code = _code(suffix, text) if found is None else [t for t in found if t.kind != "comment"]
    tables: set[int] = set()  # where brackets open that are no subscripts and no bodies of calls
    for before, t, after in zip([None, *code], code, [*code[1:], None], strict=False):
        brackets.read(t)
        if t.kind == "open" and t.value != "(":
            subscript = before and (before.value in (")", "]") or (before.kind == "word" and before.value not in lexing.BEFORE_VALUE))
            if not subscript:
                tables.add(t.start)
        elif t.kind == "text" and brackets.open and brackets.open[-1].start in tables and (after is None or after.value in (",", "]", "}")):
            out += _by_line(text, t.start, t.end, starts, bisect.bisect_right(starts, t.start) - 1)
    return out


def _spans(function) -> object:
    def of(suffix: Column, text: Column) -> Column:
        @F.arrow_udf(SPAN_SQL)
        def found(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
            for suffixes, texts in batches:
                yield pa.array([function(s or "", t or "") for s, t in zip(suffixes.to_pylist(), texts.to_pylist(), strict=True)], SPAN)

        return found(suffix, text)

    return of


TIERS = pa.list_(pa.struct([("line", pa.int32()), ("start", pa.int32()), ("stop", pa.int32()), ("comment", pa.bool_())]))


def _tier_spans(suffix: Column, text: Column) -> Column:
    """Comment and list spans of a file, which is lexed once."""

    @F.arrow_udf("array<struct<line:int,start:int,stop:int,comment:boolean>>")
    def of(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for suffixes, texts in batches:
            out = []
            for s, t in zip(suffixes.to_pylist(), texts.to_pylist(), strict=True):
                found = list(lexing.tokens(s or "", t or ""))
                out.append([x | {"comment": True} for x in comment_spans(s or "", t or "", found)] + [x | {"comment": False} for x in list_spans(s or "", t or "", found)])
            yield pa.array(out, TIERS)

    return of(suffix, text)


def spans(files: DataFrame, kind: str) -> DataFrame:
    """(file, line, start, stop) of the ``comment`` or ``list`` spans of files (path, suffix, text)."""
    find = _spans({"comment": comment_spans, "list": list_spans}[kind])
    return files.select(F.col("path").alias("file"), F.inline(find(F.col("suffix"), F.col("text"))))


def covered(hits: DataFrame, spans: DataFrame) -> DataFrame:
    """hits (file, line, start, stop, ...) with ``covered``: whether a span of the line holds it."""
    by_line = spans.groupBy("file", "line").agg(F.collect_list(F.struct(F.col("start").alias("a"), F.col("stop").alias("b"))).alias("_spans"))
    joined = hits.join(by_line, ["file", "line"], "left")
    inside = F.exists("_spans", lambda s: (s.a <= F.col("start")) & (s.b >= F.col("stop")))
    return joined.withColumn("covered", F.coalesce(inside, F.lit(False))).drop("_spans")


def tiers(hits: DataFrame, files: DataFrame) -> DataFrame:
    """Hits outside comments, with ``tier``: listed for items of literal tables, else use. Hits are found once, and each file that has some is lexed once."""
    hits = checkpoint(hits)
    files = files.join(hits.select(F.col("file").alias("path")).distinct(), "path", "left_semi")  # others needn't be read
    found = files.select(F.col("path").alias("file"), F.inline(_tier_spans(F.col("suffix"), F.col("text"))))
    by_line = found.groupBy("file", "line").agg(F.collect_list(F.struct(F.col("start").alias("a"), F.col("stop").alias("b"), "comment")).alias("_spans"))
    joined = hits.join(by_line, ["file", "line"], "left")
    held = lambda comment: F.coalesce(F.exists("_spans", lambda s: (s.comment == F.lit(comment)) & (s.a <= F.col("start")) & (s.b >= F.col("stop"))), F.lit(False))
    return joined.where(~held(True)).withColumn("tier", F.when(held(False), "listed").otherwise("use")).drop("_spans")


_NAMES = (("name", pa.string()), ("kind", pa.string()), ("of", pa.string()), ("line", pa.int32()), ("scope_start", pa.int32()), ("scope_end", pa.int32()), ("bound", pa.int32()))
NAME = pa.list_(pa.struct(_NAMES))
NAME_SQL = "array<struct<name:string,kind:string,of:string,line:int,scope_start:int,scope_end:int,bound:int>>"


def python_names(text: str) -> list[dict]:
    """Constants (``const``, of: the string), their loads (``load``) and imports (``import``, of: module:name) of a file."""
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError):
        return []
    out: list[dict] = []

    def walk(node: ast.AST, scope: tuple[int | None, int | None]) -> None:
        row = lambda name, kind, of, line: out.append({"name": name, "kind": kind, "of": of, "line": line, "scope_start": scope[0], "scope_end": scope[1], "bound": None})
        for child in ast.iter_child_nodes(node):
            if isinstance(child, ast.Assign | ast.AnnAssign) and isinstance(child.value, ast.Constant) and isinstance(child.value.value, str):
                for target in child.targets if isinstance(child, ast.Assign) else [child.target]:
                    if isinstance(target, ast.Name):
                        row(target.id, "const", child.value.value, child.lineno)
            elif isinstance(child, ast.ImportFrom):
                for alias in child.names:
                    row(alias.asname or alias.name, "import", f"{child.module or ''}:{alias.name}", child.lineno)
            elif isinstance(child, ast.Name) and isinstance(child.ctx, ast.Load):
                row(child.id, "load", None, child.lineno)
            inner = isinstance(child, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef | ast.Lambda)
            walk(child, (child.lineno, child.end_lineno) if inner else scope)

    walk(tree, (None, None))
    return out


#: Suffixes of JavaScript and TypeScript.
SCRIPTS = tuple(f".{s}" for s in lexing.SCRIPT)


_DEPTH = {"open": 1, "close": -1}


class _Script:
    """Names of a script, read token by token.

    Blocks are those of the brackets: a constant in one holds from its declaration to the block's end, and what is declared
    anew further inside hides it there, whatever its value. So each use is bound to its declaration as it is read.
    """

    def __init__(self, path: str, text: str):
        self.path, self.text, self.starts = path, text, _line_starts(text)
        self.rows: list[dict] = []
        self.uses: set[tuple[str, int, int | None]] = set()
        self.known: set[str] = set()
        self.brackets = lexing.Brackets()
        self.declared: list[list[str]] = [[]]  # names by open block
        self.local: dict[str, list[dict | None]] = {}  # a name's declarations in open blocks, the innermost last

    def line(self, at: int) -> int:
        return bisect.bisect_right(self.starts, at)

    def row(self, name: str, kind: str, of: str | None, line: int, bound: int | None = None) -> dict:
        found = {"name": name, "kind": kind, "of": of, "line": line, "scope_start": None, "scope_end": None, "bound": bound}
        self.rows.append(found)
        return found

    def read(self) -> list[dict]:
        code = _code(".js", self.text)
        end = len(code)
        at = 0
        while at < end:
            t = code[at]
            opened = self.brackets.read(t)
            if t.kind == "open":
                self.declared.append([])
            elif opened:
                self.leave(self.line(t.start))
            elif t.kind == "word":
                before, after = code[at - 1] if at else None, code[at + 1] if at + 1 < end else None
                if t.value == "import" and (before is None or before.value != "."):
                    at = self.imported(code, at)
                    continue
                if t.value in ("const", "let", "var") and after and after.kind == "word":
                    at = self.declare(code, at)
                    continue
                if self.is_use(before, t, after):
                    self.use(t)
            at += 1
        while len(self.declared) > 1:
            self.leave(len(self.starts))
        found = [{"name": n, "kind": "load", "of": None, "line": line, "scope_start": None, "scope_end": None, "bound": bound} for n, line, bound in sorted(self.uses, key=str) if n in self.known]
        return self.rows + found

    def leave(self, line: int) -> None:
        for name in self.declared.pop():
            const = self.local[name].pop()
            if const:
                const["scope_end"] = line

    def is_use(self, before: lexing.Token | None, t: lexing.Token, after: lexing.Token | None) -> bool:
        if before and (before.value == "." and before.end == t.start):
            return False
        key = after and after.value == ":" and self.text[after.end : after.end + 1] != ":"
        return not key or bool(before and before.value not in ("{", "}", ",", "(", ";") and (before.value == "case" or before.kind != "word"))

    def use(self, t: lexing.Token) -> None:
        line, inner = self.line(t.start), self.local.get(t.value)
        if not inner:
            self.uses.add((t.value, line, None))
        elif inner[-1]:
            self.uses.add((t.value, line, inner[-1]["line"]))

    def declare(self, code: list[lexing.Token], at: int) -> int:
        """A declaration: its name, and its string if that is all of its value's beginning. The place at which to read on."""
        name, first = code[at + 1], code[at - 1] if at and code[at - 1].value == "export" else code[at]
        own_line = not self.text[self.starts[self.line(first.start) - 1] : first.start].strip()
        depth, i, value = 0, at + 2, None
        while i < len(code):  # over a type, to the equals sign
            t = code[i]
            if t.value == "=" and not depth:
                if self.text[t.end : t.end + 1] not in ("=", ">"):
                    value = code[i + 1] if i + 1 < len(code) else None
                    break
            elif i == at + 2 and t.value not in (":", "!") or t.value in (";", "const", "let", "var"):
                break
            elif not depth and t.value not in ("=", "|", "&") and code[i - 1].value not in (":", "|", "&") and "\n" in self.text[code[i - 1].end : t.start]:
                break  # the line ends without a value
            depth += _DEPTH.get(t.kind, 0)
            if depth < 0:
                break
            i += 1
        line = self.line(name.start)
        const = None
        if value and value.kind == "text" and value.value[0] in "'\"`" and own_line:
            const = self.row(name.value, "const", self.string(code, i + 1), line)
            self.known.add(name.value)
        inside = len(self.declared) > 1
        if inside:
            self.declared[-1].append(name.value)
            self.local.setdefault(name.value, []).append(const)
            if const and first.value != "export":
                const["scope_start"] = line + 1
        return i + 1 if i < len(code) and code[i].value == "=" else at + 2

    def string(self, code: list[lexing.Token], i: int) -> str:
        """A literal; of a template also the pieces after its code."""
        begun = code[i]
        if begun.value[0] != "`" or begun.value.endswith("`") and len(begun.value) > 1:
            return begun.value
        depth = 0
        for t in code[i + 1 :]:
            depth += _DEPTH.get(t.kind, 0)
            if t.kind == "text" and not depth and not t.value.endswith("${"):
                return self.text[begun.start : t.end]
        return self.text[begun.start :]

    def imported(self, code: list[lexing.Token], at: int) -> int:
        """An import of names from a relative path. The place at which to read on."""
        names: list[list[str]] = [[]]
        i, inside = at + 1, False
        while i < len(code) and code[i].kind != "text" and code[i].value not in (";", "(", "="):
            t = code[i]
            inside = t.kind == "open" or inside and t.kind != "close"
            if t.value == ",":
                names.append([])
            elif inside and t.kind == "word":
                names[-1].append(t.value)
            i += 1
        if i < len(code) and code[i].kind == "text" and code[i - 1].value == "from":
            target = code[i].value[1:-1]
            if target.startswith("."):
                home = posixpath.normpath(posixpath.join(posixpath.dirname(self.path), target))
                home = next((home.removesuffix(s) for s in SCRIPTS if home.endswith(s)), home).replace("/", ".")
                for words in names:
                    words = words[1:] if len(words) in (2, 4) and words[0] == "type" else words
                    for module in (home, f"{home}.index") if words else ():
                        self.row(words[-1], "import", f"{module}:{words[0]}", self.line(code[at].start))
                        self.known.add(words[-1])
            return i + 1
        return i


def script_names(path: str, text: str) -> list[dict]:
    """The same of a script: constants with strings, named imports from relative paths, and uses of either, bound to their declaration if that stands in a block."""
    return _Script(path, text).read()


def _linked(rows: list[dict]) -> list[dict]:
    """Without the loads of names that the file neither sets to a string nor imports."""
    known = {r["name"] for r in rows if r["kind"] != "load"}
    return [r for r in rows if r["kind"] != "load" or r["name"] in known]


def names(files: DataFrame) -> DataFrame:
    """(file, name, kind, of, line, scope_start, scope_end) of Python files and scripts."""

    @F.arrow_udf(NAME_SQL)
    def of(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for paths, suffixes, texts in batches:
            rows = zip(paths.to_pylist(), suffixes.to_pylist(), texts.to_pylist(), strict=True)
            yield pa.array([_linked(python_names(t or "")) if s == ".py" else script_names(p or "", t or "") for p, s, t in rows], NAME)

    known = files.where(F.col("suffix").isin(".py", *SCRIPTS))
    return known.select(F.col("path").alias("file"), F.inline(of(F.col("path"), F.col("suffix"), F.col("text"))))


def constant_uses(hits: DataFrame, files: DataFrame) -> DataFrame:
    """(record_id, signature, file, line, via): loads of constants whose string is a hit's, in their scope or where they are imported.

    The nearest constant of a name wins; the line of a direct hit is no use. Python and scripts.
    """
    return uses_of(checkpoint(hits.select("record_id", "signature", "file", "line").distinct()), files)


def uses_of(hits: DataFrame, files: DataFrame) -> DataFrame:
    """``constant_uses`` of hits (record_id, signature, file, line) that are distinct and cheap to read again.

    Files are lexed once, into a table of their names. Its joins sort both sides: what a text yields is larger than
    the plan takes it for, so none of it may be broadcast.
    """
    found = checkpoint(names(files))
    consts = found.where("kind = 'const'").select("file", "name", F.col("of").alias("value"), F.col("line").alias("defined"), F.col("scope_start").alias("a"), F.col("scope_end").alias("b"))
    # a literal may go over several lines
    last = F.col("defined") + F.size(F.split("value", "\n")) - 1
    spread = consts.withColumn("at", F.explode(F.sequence(F.col("defined"), last)))
    hit = spread.join(hits.withColumnRenamed("line", "at").hint("merge"), ["file", "at"])
    hit = hit.where(F.col("value").contains(F.col("signature"))).drop("at").distinct()
    loads = found.where("kind = 'load'").select("file", "name", "line", "bound")
    # a use in a script that is bound to a block's declaration is no other's
    here = hit.join(loads.hint("merge"), ["file", "name"]).where("if(bound is null, a is null or (line between a and b and file rlike '[.]py$'), bound = defined)")
    # a module is named by the end of its file's path
    module = F.regexp_replace(F.regexp_replace("file", rf"(?:/__init__)?\.py\z|(?:{'|'.join(s[1:] for s in SCRIPTS)})\z", ""), "/", ".")
    module = F.rtrim(module, F.lit("."))
    # a script names the whole path, and no other language's files
    script = lambda c: F.regexp_extract(c, r"\.[^./]*\z", 0).isin(*SCRIPTS)
    key = lambda file, name: F.when(script(file), name).otherwise(F.element_at(F.split(name, r"\."), -1))
    exported = hit.where("a is null").withColumns({"_module": module, "_key": key("file", module)}).withColumnRenamed("file", "home").withColumnRenamed("name", "exported")
    imports = found.where("kind = 'import'").select("file", "name", F.split_part("of", F.lit(":"), F.lit(1)).alias("from"), F.split_part("of", F.lit(":"), F.lit(2)).alias("exported"))
    imports = imports.withColumn("_key", key("file", F.col("from")))
    fits = (F.col("_module") == F.col("from")) | (~script("file") & F.col("_module").endswith(F.concat(F.lit("."), F.col("from"))))
    linked = exported.join(imports.hint("merge"), ["_key", "exported"]).where((script("file") == script("home")) & fits)
    there = linked.select("record_id", "signature", "file", "name", "home", "defined").join(loads.where("bound is null").hint("merge"), ["file", "name"])
    columns = ["record_id", "signature", "file", "name", "line", F.col("home"), "defined"]
    both = here.withColumn("home", F.col("file")).select(*columns).unionByName(there.select(*columns))
    direct = hits.select("record_id", "file", "line").distinct().hint("merge")
    order = Window.partitionBy("record_id", "file", "line").orderBy((F.col("home") != F.col("file")).asc(), F.desc("defined"))
    best = both.join(direct, ["record_id", "file", "line"], "left_anti").withColumn("_place", F.row_number().over(order)).where("_place = 1")
    return best.select("record_id", "signature", "file", "line", F.concat("name", F.lit(" ("), "home", F.lit(":"), F.col("defined").cast("string"), F.lit(")")).alias("via"))
