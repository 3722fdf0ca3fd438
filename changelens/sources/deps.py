"""Pinned and required versions out of dependency files."""

from __future__ import annotations

import json
import re
import tomllib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: File name in lower case -> (ecosystem, whether it locks versions).
FILES = {
    "package.json": ("npm", False), "package-lock.json": ("npm", True), "npm-shrinkwrap.json": ("npm", True), "yarn.lock": ("npm", True), "pnpm-lock.yaml": ("npm", True),
    "pyproject.toml": ("pypi", False), "pipfile": ("pypi", False), "pipfile.lock": ("pypi", True), "poetry.lock": ("pypi", True), "uv.lock": ("pypi", True),
    "composer.json": ("packagist", False), "composer.lock": ("packagist", True), "go.mod": ("go", False), "gemfile.lock": ("rubygems", True), "cargo.lock": ("cargo", True),
}
#: Patterns of paths of requirement lists, in lower case.
REQUIREMENTS = (r"(?:^|/)(?:[^/]*requirements[^/]*|constraints[^/]*)\.(?:txt|in)$", r"(?:^|/)requirements/[^/]*\.(?:txt|in)$")
_REQUIREMENT = re.compile(r"\A\s*([A-Za-z0-9][\w.-]*)\s*(?:\[[^\]]*\])?\s*\(?\s*([^;#()]*)")
_BOUND = re.compile(r"(===?|~=|>=|\^|~|>)?\s*v?(\d[\w.+!-]*)")


def version(text: str | None) -> str:
    """The version that a range begins with; a bare major stands for any of its minors; empty for none."""
    found = [(op, v) for op, v in _BOUND.findall(re.sub(r"(?:<=?|!=)\s*v?[\w.*+!-]+", "", text or ""))]
    if not found:
        return ""
    v = found[0][1].rstrip(".*-")
    return f"{v}.x" if re.fullmatch(r"\d+", v) else v


def python_name(name: str) -> str:
    return re.sub(r"[-_.]+", "-", name).lower()


def _python(lines: list[str]) -> Iterator[tuple[str, str]]:
    for line in lines:
        if (m := _REQUIREMENT.match(line)) and not line.lstrip().startswith(("#", "-")):
            yield python_name(m[1]), version(m[2])


def _tables(data: dict, *names: str) -> Iterator[tuple[str, str]]:
    for n in names:
        for name, value in (data.get(n) or {}).items():
            yield name, version(value.get("version") if isinstance(value, dict) else str(value))


def _nested(packages: dict) -> Iterator[tuple[str, str]]:
    for name, value in packages.items():
        if isinstance(value, dict):
            yield name, str(value.get("version", ""))
            yield from _nested(value.get("dependencies") or {})


def _npm(name: str, wanted: str) -> tuple[str, str]:
    """A package and its version; of one under another name (``npm:package@version``), the package's own."""
    own, at, range_ = wanted.removeprefix("npm:").rpartition("@")
    if not wanted.startswith("npm:"):
        return name, version(wanted)
    return (own, version(range_)) if own else (f"{at}{range_}", "")


def _json(name: str, data: dict) -> Iterator[tuple[str, str]]:
    if name == "package.json":
        for kind in ("dependencies", "devDependencies", "peerDependencies", "optionalDependencies"):
            yield from (_npm(n, str(v)) for n, v in (data.get(kind) or {}).items())
    elif name == "composer.json":
        yield from ((n, v) for n, v in _tables(data, "require", "require-dev") if "/" in n)
    elif name == "composer.lock":
        yield from ((p["name"], str(p.get("version", "")).lstrip("v")) for k in ("packages", "packages-dev") for p in data.get(k) or [])
    elif name == "pipfile.lock":
        for k in ("default", "develop"):
            yield from ((python_name(n), version(v.get("version"))) for n, v in (data.get(k) or {}).items())
    else:
        for place, value in (data.get("packages") or {}).items():
            if place:
                yield value.get("name") or place.rsplit("node_modules/", 1)[-1], str(value.get("version", ""))  # one under another name has its own, too
        yield from _nested(data.get("dependencies") or {})


def _toml(name: str, data: dict) -> Iterator[tuple[str, str]]:
    if name in ("poetry.lock", "uv.lock", "cargo.lock"):
        tidy = str if name == "cargo.lock" else python_name
        yield from ((tidy(p["name"]), str(p.get("version", ""))) for p in data.get("package") or [])
    elif name == "pipfile":
        yield from ((python_name(n), v) for n, v in _tables(data, "packages", "dev-packages"))
    else:
        project = data.get("project") or {}
        yield from _python(project.get("dependencies") or [])
        for group in (project.get("optional-dependencies") or {}, data.get("dependency-groups") or {}):
            for items in group.values():
                yield from _python([x for x in items if isinstance(x, str)])
        poetry = (data.get("tool") or {}).get("poetry") or {}
        for table in (poetry, *(poetry.get("group") or {}).values()):
            yield from ((python_name(n), v) for n, v in _tables(table, "dependencies", "dev-dependencies") if n != "python")


_YARN = re.compile(r'(?m)^"?(?:@?[^@"\s][^@"\n]*)@[^\n]*:\n(?:[ \t]+[^\n]*\n)*?[ \t]+version:? "?([^"\n]+)"?')
_YARN_NAME = re.compile(r'\A"?(@?[^@"]+)@')
_PNPM = re.compile(r"(?m)^  ['\"]?/?(@?[^@'\"\s/]+(?:/[^@'\"\s/]+)?)[@/](\d[^('\":\s]*)[^:\n]*:")
_GEM = re.compile(r"(?m)^    ([\w.-]+) \(([^)]+)\)$")
_GO = re.compile(r"(?m)^\s*(?:require\s+)?([\w.-]+\.[\w.-]+/[^\s]+)\s+v([^\s/]+)")
_GO_REPLACE = re.compile(r"(?m)^\s*(?:replace\s+)?(\S+)(?:\s+v\S+)?\s+=>\s+(\S+)(?:\s+v(\S+))?")


def pins(path: str, text: str) -> list[tuple[str, str]]:
    """(name, version) of a dependency file, sorted; none of one that can't be read."""
    name = path.rsplit("/", 1)[-1].lower()
    try:
        if any(re.search(p, path.lower()) for p in REQUIREMENTS):
            found = list(_python(text.splitlines()))
        elif name.endswith(".json") or name in ("composer.lock", "pipfile.lock"):
            found = list(_json(name, json.loads(text)))
        elif name.endswith(".toml") or name in ("poetry.lock", "uv.lock", "cargo.lock", "pipfile"):
            found = list(_toml(name, tomllib.loads(text)))
        elif name == "yarn.lock":
            found = [(_YARN_NAME.match(m[0])[1], m[1]) for m in _YARN.finditer(text) if _YARN_NAME.match(m[0])]
        elif name == "pnpm-lock.yaml":
            found = _PNPM.findall(text)
        elif name == "gemfile.lock":
            found = _GEM.findall(text)
        elif name == "go.mod":
            replaced = {old: (new, v) for old, new, v in _GO_REPLACE.findall(text)}
            kept = "\n".join(x for x in text.splitlines() if "=>" not in x)
            found = [replaced[n] if replaced.get(n, ("", ""))[1] else (n, v) for n, v in _GO.findall(kept)]
        else:
            found = []
    except (ValueError, AttributeError, TypeError, KeyError):
        return []
    return sorted({(n, v) for n, v in found if n})


def name_of(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def ecosystem(path: Column) -> Column:
    """(ecosystem, is_lock) by file name; null for other files."""
    name_ = F.lower(name_of(path))
    listed = F.lower(path).rlike(REQUIREMENTS[0]) | F.lower(path).rlike(REQUIREMENTS[1])
    out = F.when(listed, F.struct(F.lit("pypi").alias("ecosystem"), F.lit(False).alias("is_lock")))
    for name, (eco, lock) in FILES.items():
        out = out.when(name_ == name, F.struct(F.lit(eco).alias("ecosystem"), F.lit(lock).alias("is_lock")))
    return out


def dependency_pins(files: DataFrame) -> DataFrame:
    """(path, dir, ecosystem, is_lock, name, version) of all dependency files in (path, text)."""
    kind = pa.list_(pa.struct([("name", pa.string()), ("version", pa.string())]))

    @F.arrow_udf("array<struct<name:string,version:string>>")
    def of(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for paths, texts in batches:
            yield pa.array([[{"name": n, "version": v} for n, v in pins(p, t or "")] for p, t in zip(paths.to_pylist(), texts.to_pylist(), strict=True)], kind)

    rows = files.withColumn("_e", ecosystem(F.col("path"))).where("_e is not null")
    folder = F.regexp_extract("path", r"(?s)\A(.*)/[^/]*\z", 1)
    return rows.select("path", folder.alias("dir"), "_e.*", F.inline(of(F.col("path"), F.col("text"))))


def effective_pins(pinned: DataFrame) -> DataFrame:
    """Pins without those of manifests beside a lock file of their ecosystem."""
    locks = pinned.where("is_lock").select("dir", "ecosystem").distinct()
    return pinned.where("is_lock").unionByName(pinned.where("not is_lock").join(locks, ["dir", "ecosystem"], "left_anti"))


def words(pinned: DataFrame) -> DataFrame:
    """The words by which contexts refer to pins."""
    both = F.array(F.concat(F.lit("dep:"), F.col("ecosystem"), F.lit(":"), F.col("name"), F.lit("@"), F.col("version")), F.concat(F.lit("dep:"), F.col("name"), F.lit("@"), F.col("version")))
    return pinned.select("path", F.explode(both).alias("word")).distinct()
