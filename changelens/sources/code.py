"""Code: files, their lines, and the cells of notebooks."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import is_ignored, lines
from . import deps

#: Suffixes of code and data files, and folders that hold no calls of a repository's own.
SUFFIXES = (".py", ".js", ".mjs", ".cjs", ".ts", ".mts", ".cts", ".tsx", ".jsx", ".go", ".rb", ".java", ".kt", ".cs", ".php", ".rs", ".swift", ".sh", ".yml", ".yaml", ".json", ".toml", ".ini", ".cfg", ".ipynb")
SKIPPED = (".git", "node_modules", ".venv", "venv", "dist", "build", "out", "__pycache__", "site-packages", ".next", "coverage", ".tox", ".mypy_cache", ".pytest_cache", "vendor", "locales", "i18n")


@F.arrow_udf(T.StringType())
def decoded(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """UTF-8 without what isn't."""
    for batch in batches:
        yield pa.array([None if x is None else x.decode("utf-8", "ignore") for x in batch.to_pylist()], pa.string())


def is_env(path: Column) -> Column:
    """``.env`` and ``.env.*``: settings without a suffix."""
    return F.element_at(F.split(path, "/"), -1).rlike(r"\A\.env(?:\..*)?\z")


def is_code(path: Column, suffixes: Sequence[str] = SUFFIXES) -> Column:
    parts = F.split(path, "/")
    name = F.element_at(parts, -1)
    good = is_env(path)
    for s in suffixes:
        good = good | (name.endswith(s) & (name != s))
    return good & ~F.arrays_overlap(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(1))), F.array(*map(F.lit, SKIPPED)))


def files(spark: SparkSession, root: str, ignored: Sequence[str] = ()) -> DataFrame:
    """(path, suffix, text) of a tree's code files; contents are read for these alone."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    place = F.concat(F.lit(root.rstrip("/").split("://")[-1].replace("file:", "")), F.lit("/"))
    path = F.element_at(F.split(F.col("path"), F.concat(F.lit("\\Q"), place, F.lit("\\E"))), -1)
    found = found.select(path.alias("path"), "content").where(is_code(F.col("path")) & ~is_ignored(F.col("path"), ignored))
    return found.select("path", F.when(is_env(F.col("path")), "").otherwise(F.concat(F.lit("."), F.element_at(F.split("path", r"\."), -1))).alias("suffix"), decoded(F.col("content")).alias("text"))


def code_lines(files: DataFrame) -> DataFrame:
    """(path, line_no, line, cell, raw_line): lines of files; of notebooks, those of their code cells, with their line in the file itself."""
    plain = lines(files.where("suffix != '.ipynb'"), "text", ["path"]).withColumns({"cell": F.lit(""), "raw_line": F.col("line_no")})
    return plain.unionByName(notebook_lines(files.where("suffix = '.ipynb'")))


_JSON = re.compile(r"\"(?:[^\"\\]++|\\.)*+\"|[{}\[\],\n]|[^\s{}\[\],:\"]++", re.S)


def _said(token: str) -> str:
    """What a JSON string says."""
    return json.loads(token, strict=False) if "\\" in token else token[1:-1]


def _sources(raw: str) -> Iterator[tuple[int, str, list[tuple[str, int]]]]:
    """(number, type, [(source string, its line in the file)]) of each cell of a notebook: one pass over its JSON, which holds where it is as keys and items."""
    where: list[str | None] = []  # of each open object the key at hand, of each list None
    keyed = False  # whether the key at hand awaits its value
    n, line, kind, parts = 0, 1, "", []
    for m in _JSON.finditer(raw):
        token = m[0]
        if token == "\n":
            line += 1
        elif token in "{[":
            if token == "{" and where == ["cells", None]:
                n, kind, parts = n + 1, "", []
            where.append("" if token == "{" else None)
            keyed = False
        elif token in "}]":
            where.pop()
            keyed = False
            if token == "}" and where == ["cells", None]:
                yield n, kind, parts
        elif token == ",":
            keyed = False
        elif where and where[-1] is not None and not keyed:
            where[-1], keyed = _said(token), True
        elif where[:2] == ["cells", None] and token[0] == '"':
            if where[2:] == ["cell_type"]:
                kind = _said(token)
            elif where[2:] in (["source"], ["source", None]):
                parts.append((_said(token), line))


def _cells(text: str) -> list[dict]:
    try:
        if not isinstance(json.loads(text)["cells"], list):
            return []
    except (ValueError, TypeError, KeyError, RecursionError):
        return []
    out: list[dict] = []
    for c, kind, parts in _sources(text):
        said = [(line, raw) for part, raw in parts for line in part.splitlines() or [""]] if kind == "code" else []
        for i, (line, raw) in enumerate(said, 1):
            out.append({"line_no": len(out) + 1, "line": "" if line.lstrip()[:1] in ("%", "!") else line, "cell": f"cell {c}, line {i}", "raw_line": raw})
    return out


def notebook_lines(notebooks: DataFrame) -> DataFrame:
    """Lines of code cells, numbered through the notebook, with cell, line in the cell and line in the file; magics and shell commands are blank."""
    kind = pa.list_(pa.struct([("line_no", pa.int32()), ("line", pa.string()), ("cell", pa.string()), ("raw_line", pa.int32())]))

    @F.arrow_udf("array<struct<line_no:int,line:string,cell:string,raw_line:int>>")
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([_cells(x or "") for x in batch.to_pylist()], kind)

    return notebooks.select("path", F.inline(of(F.col("text"))))


def at_code_lines(sites: DataFrame, lines: DataFrame) -> DataFrame:
    """sites (file, line: in the file itself, ...) with ``line_no``, the first line of ``code_lines`` that stands there."""
    first = lines.groupBy(F.col("path").alias("file"), F.col("raw_line").alias("line")).agg(F.min("line_no").alias("line_no"))
    return sites.join(first, ["file", "line"], "left")


#: Names of dependency files beside those whose pins are read, in lower case.
OTHER_MANIFESTS = ("gemfile", "pom.xml", "build.gradle", "build.gradle.kts", "cargo.toml")


def is_manifest(path: Column) -> Column:
    """Dependency files outside the folders that are skipped."""
    name = F.lower(F.element_at(F.split(path, "/"), -1))
    skipped = F.arrays_overlap(F.slice(F.split(path, "/"), 1, F.greatest(F.size(F.split(path, "/")) - 1, F.lit(1))), F.array(*map(F.lit, SKIPPED)))
    return (deps.ecosystem(path).isNotNull() | name.isin(*OTHER_MANIFESTS) | name.endswith(".csproj")) & ~skipped


def context_texts(files: DataFrame, repo: str = "repo", ignored: Sequence[str] = ()) -> DataFrame:
    """(repo, text): all in which a repository's context is looked for. files: (repo, path, text) of whole trees.

    The texts of code files and of dependency files, and a line for each pinned version: of a folder's lock file, where it
    has one for an ecosystem, else of its manifests. Null texts hold nothing.
    """
    path = F.col("path")
    manifest = F.coalesce(is_manifest(path), F.lit(False))
    kept = files.where((is_code(path) & ~is_ignored(path, ignored)) | manifest).select(repo, "path", F.coalesce("text", F.lit("")).alias("text"))
    # a file's place is within its repository, so both make its path
    whole = kept.where(manifest).select(F.to_json(F.struct(F.col(repo).alias("r"))).alias("of"), "path", "text")
    parted = F.concat("of", F.lit("\n/"), "path")
    pinned = deps.effective_pins(deps.dependency_pins(whole.select(parted.alias("path"), "text")))
    said = deps.words(pinned).join(whole.select(parted.alias("path"), "of"), "path").groupBy("of").agg(F.array_join(F.collect_set("word"), "\n").alias("text"))
    owners = kept.select(repo).distinct().withColumn("of", F.to_json(F.struct(F.col(repo).alias("r"))))
    return kept.select(repo, "text").unionByName(said.join(owners, "of").select(repo, "text"))
