"""Change records: one YAML file each."""

from __future__ import annotations

import datetime
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Columns of text; the others are in ``schemas.RECORDS``.
TEXTS = ("id", "vendor", "surface", "kind", "severity", "summary", "detail", "source_url", "verified_by", "fix_hint")
def _groups(items: list | None) -> list[list[str]]:
    """Alternatives of words that must occur together: a bare word is an alternative of its own."""
    return [[str(w) for w in (x if isinstance(x, list) else [x])] for x in items or []]


def parse(text: str) -> dict:
    import yaml

    raw = yaml.safe_load(text) or {}
    day = lambda v: v.isoformat()[:10] if isinstance(v, datetime.date) else v
    out = {n: None if raw.get(n) is None else str(raw[n]) for n in TEXTS}
    out |= {n: day(raw.get(n)) for n in ("effective", "verified_on")}
    out |= {n: bool(raw.get(n, False)) for n in ("verified", "illustrative")}
    out |= {n: [str(x) for x in raw.get(n) or []] for n in ("signatures", "files", "exclude")}
    out |= {n: _groups(raw.get(n)) for n in ("context", "repo_context")}
    out["evidence"] = [{"url": e.get("url") or raw.get("source_url"), "text": e.get("text")} if isinstance(e, dict) else {"url": raw.get("source_url"), "text": str(e)} for e in raw.get("evidence") or []]
    return out


def parse_safely(text: str | None) -> dict:
    """``parse``, or only ``error`` for a file that is no record."""
    import yaml

    try:
        return parse(text or "") | {"error": None}
    except (yaml.YAMLError, AttributeError, TypeError, ValueError, RecursionError) as e:
        return {"error": f"{type(e).__name__}: {e}"[:500]}


_KIND = pa.struct(
    [(n, pa.string()) for n in (*TEXTS, "effective", "verified_on")]
    + [("verified", pa.bool_()), ("illustrative", pa.bool_())]
    + [(n, pa.list_(pa.string())) for n in ("signatures", "files", "exclude")]
    + [(n, pa.list_(pa.list_(pa.string()))) for n in ("context", "repo_context")]
    + [("evidence", pa.list_(pa.struct([("url", pa.string()), ("text", pa.string())]))), ("error", pa.string())]
)


RAW = "struct<" + ",".join(f"{f.name}:{str(f.type).replace('item: ', '').replace('list', 'array').replace(': ', ':').replace('bool', 'boolean')}" for f in _KIND) + ">"


def read(spark: SparkSession, folder: str) -> DataFrame:
    """All records of a folder: ``*.yml`` by name, then ``*.yaml``; ``load_ordinal`` is their place. A malformed file is a row of nulls with ``error``."""

    @F.arrow_udf(RAW)
    def parsed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array(list(map(parse_safely, batch.to_pylist())), _KIND)

    files = spark.read.text(folder, wholetext=True, pathGlobFilter="*.{yml,yaml}").select(F.col("_metadata.file_name").alias("_name"), "value")
    order = Window.orderBy(F.col("_name").endswith(".yaml").asc(), "_name")  # a folder of records, some hundred files
    files = files.withColumn("load_ordinal", F.row_number().over(order) - 1)
    rows = files.select(parsed("value").alias("r"), "load_ordinal").select("r.*", "load_ordinal")
    return rows.withColumns({n: F.try_to_date(n, "yyyy-MM-dd") for n in ("effective", "verified_on")})
