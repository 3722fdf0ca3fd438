"""What makes a token a site: names that a record itself gives, others' forms of an id, prose in data files, excluded calls."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import checkpoint
from . import code_context, tokens

#: An id, and a suffix, as a record's text names them.
MODEL_ID = r"[a-z][a-z0-9]*(?:[-.][a-z0-9]+)+"
NAMED_SUFFIX = r"(?:(?<=\s)|^)-[a-z][a-z0-9]*\b"
#: What follows a vendor's id where a partner serves it under its own.
PARTNERS = {"Anthropic": r"\A(?:(?:-\d{8})?(?:-v\d+:\d+|@))"}
#: Suffixes of data files; how an id is led up to that is set, not talked about.
DATA = (".json", ".yaml", ".yml", ".toml")
FLAG = r"(?:^|\s)-{1,2}\w[\w-]*[=\s]\s*[\"']?$"
ITEM = r"^\s*-\s+[\"']?$"
KEY = r"(?:^\s*(?:-\s+)?|[{,]\s*)[\w\"'-]+\s*[:=]\s*[\"']?$"
OPENER = r"[\[{(,]\s*[\"']?$"
#: Characters, words and plain words of a sentence at least; plain words after a key, and before an opener, that make one.
SENTENCE = (40, 8, 4)
AFTER_KEY, BEFORE_OPENER = 5, 2
#: Fixed value: lines that a call is followed for.
CALL_LINES = 6
#: Lines of a file that are looked at together; the next ones that a call may reach are with them.
CALL_BLOCK = 10_000


def record_names(text: Column) -> Column:
    """Ids and ``-suffixes`` that a record's own text names; they count as the record's."""
    low = F.lower(text)
    return F.array_sort(F.array_union(F.regexp_extract_all(low, F.lit(MODEL_ID), F.lit(0)), F.regexp_extract_all(low, F.lit(NAMED_SUFFIX), F.lit(0))))


def named_signatures(records: DataFrame) -> DataFrame:
    """``tokens.signature_table`` with ``named``: of records of models, what their summary, detail and surface name."""
    prose = F.concat_ws(" ", "summary", "detail", "surface")
    named = F.when(F.col("kind") == "model", record_names(prose)).otherwise(F.array().cast("array<string>"))
    return tokens.signature_table(records).join(records.select(F.col("id").alias("record_id"), named.alias("named")), "record_id")


def not_partner(hits: DataFrame, keys: list[str], vendor: str = "vendor") -> DataFrame:
    """Drop a line's hits of a model's id (``keys`` name record, line and signature) if all of them are partners' forms of it."""
    after = F.substr("line", F.col("stop") + 1)
    own = F.lit(True)
    for name, form in PARTNERS.items():
        own = own & ~(F.col("model") & (F.col(vendor) == name) & after.rlike(form))
    any_own = F.bool_or(F.coalesce(own, F.lit(True))).over(Window.partitionBy(*keys))
    return hits.withColumn("_own", any_own).where("_own").drop("_own")


#: What a quoted string of a data file holds, and what a single quote begins; JSON has double quotes alone.
_INSIDE, _SINGLE = {'"': r"(?:[^\"\\]|\\.?)*+", "'": r"(?:[^'\\]|\\.?)*+"}, r"(?<![^\s:\-\[,{=])'"


def _plain_words(text: Column) -> Column:
    return F.size(F.filter(F.split(text, r"\s+"), lambda w: F.btrim(w, F.lit(".,;:!?()")).rlike(r"\A[A-Za-z]{2,}\z")))


def prose(line: Column, start: Column, stop: Column, suffix: Column) -> Column:
    """Whether what stands at a place of a data file is talked about in a sentence, rather than set.

    What is quoted before the place is taken out; a quote that remains is the one that the place stands in, and
    the sentence is what it quotes. Else it is the line, up to a comment. All are built-in expressions.
    """
    left, right = F.substr(line, F.lit(1), start), F.substr(line, stop + 1)
    double, single = _INSIDE['"'], _INSIDE["'"]
    json_file = suffix == ".json"
    rest = F.when(json_file, F.regexp_replace(left, f'"{double}"', "s")).otherwise(F.regexp_replace(left, f"\"{double}\"|{_SINGLE}{single}'", "s"))
    opened = F.when(json_file, F.regexp_extract(rest, f'(")({double})\\z', 1)).otherwise(F.regexp_extract(rest, f"(?:(\"){double}|(?:{_SINGLE}){single})\\z", 0))
    quote = F.substr(opened, F.lit(1), F.lit(1))
    quoted = quote != ""
    held = F.when(json_file, F.regexp_extract(rest, f'"({double})\\z', 1)).otherwise(F.substr(opened, F.lit(2)))
    before = F.when(quoted, held).otherwise(left)
    comment = F.coalesce(F.nullif(F.instr(line, " #"), F.lit(0)) - 1, F.char_length(line))
    tail = F.substr(line, stop + 1, F.greatest(comment - stop, F.lit(0)))
    after = F.when(quote == '"', F.regexp_extract(right, rf"\A{double}", 0)).when(quote == "'", F.regexp_extract(right, rf"\A{single}", 0)).otherwise(tail)
    text = F.concat(before, F.substr(line, start + 1, stop - start), after)
    words, value = F.size(F.filter(F.split(text, r"\s+"), lambda w: w != "")), F.regexp_extract(after, r"\A[^\"',}\]]*", 0)
    least, all_words, plain = SENTENCE
    set_ = before.rlike(FLAG) | before.rlike(ITEM) | (before.rlike(KEY) & (_plain_words(value) < AFTER_KEY))
    listed = before.rlike(OPENER) & (_plain_words(F.regexp_extract(before, r"(?s)([^\[{]*)\z", 1)) < BEFORE_OPENER)
    return ~set_ & ~listed & (F.char_length(F.regexp_replace(text, r"\A\s+|\s+\z", "")) >= least) & (words >= all_words) & (_plain_words(text) >= plain)


def not_prose(hits: DataFrame, suffix: str = "suffix") -> DataFrame:
    """Drop hits of models' ids in sentences of data files."""
    asked = F.coalesce(F.col("model") & F.col(suffix).isin(*DATA), F.lit(False))
    return hits.where(F.when(asked, ~prose(F.col("line"), F.col("start"), F.col("stop"), F.col(suffix))).otherwise(True))


def call_text(lines: list[str], at: int) -> str:
    """What stands from a place of the first line to the end of its call, without white space; without a bracket on that line, the line."""
    text, depth, opened = "\n".join([lines[0][at:], *lines[1:]]), 0, False
    for m in re.finditer(r"[(\[{)\]}\n]", text):
        if m[0] == "\n":
            if not opened:
                return "".join(text[: m.start()].split())
            continue
        depth += 1 if m[0] in "([{" else -1
        opened |= m[0] in "([{"
        if opened and depth <= 0:
            return "".join(text[: m.end()].split())
    return "".join(text.split())


@F.arrow_udf(T.StringType())
def calls(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
    for lines, starts in batches:
        yield pa.array([call_text(x, at) for x, at in zip(lines.to_pylist(), starts.to_pylist(), strict=True)], pa.string())


def not_called(hits: DataFrame, lines: DataFrame, excludes: str = "excludes", partitions: int | None = None) -> DataFrame:
    """Drop hits whose call begins as an excluded one does, white space aside, also if its arguments stand on later lines.

    hits: (file, line_no, start, signature, ``excludes`` array, ...); lines: (file, line_no, line). Only hits whose
    signature begins such a call look further lines up. Lines and those hits are dealt out once, by blocks of a file, to
    ``partitions`` (else as Spark is set), and a window goes over them: none of what texts yield is broadcast, however small a plan takes it to be.
    """
    flat = F.transform(F.coalesce(F.col(excludes), F.array().cast("array<string>")), lambda e: F.regexp_replace(e, r"(?U)\s+", ""))
    mine = F.filter(flat, lambda e: e.startswith(F.col("signature")))
    marked = hits.withColumns({"_mine": mine, "_hit": F.struct(*hits.columns)})
    asked = marked.where((F.size("_mine") > 0) & F.col("file").isNotNull() & F.col("line_no").isNotNull() & F.col("start").isNotNull())
    block = lambda at: F.floor(at / CALL_BLOCK)
    # a block's first lines are with the block before, too
    blocks = F.array_distinct(F.array(block(F.col("line_no")), block(F.greatest(F.col("line_no") - CALL_LINES + 1, F.lit(0)))))
    held = lines.where("file is not null").select("file", "line_no", F.explode(blocks).alias("_block"), "line")
    held = held.select("file", "_block", F.col("line_no").cast("long").alias("_at"), F.struct(F.col("line_no").alias("at"), "line").alias("_line"), F.lit(None).cast(asked.select(F.struct("start", "_mine", "_hit").alias("x")).schema["x"].dataType).alias("_asked"))
    wanted = asked.select("file", block(F.col("line_no")).alias("_block"), F.col("line_no").cast("long").alias("_at"), F.lit(None).cast(held.schema["_line"].dataType).alias("_line"), F.struct("start", "_mine", "_hit").alias("_asked"))
    rows, by = held.unionByName(wanted), ["file", "_block"]
    ahead = Window.partitionBy(*by).orderBy("_at").rangeBetween(0, CALL_LINES - 1)
    rows = (rows.repartition(partitions, *by) if partitions else rows).withColumn("_lines", F.collect_list("_line").over(ahead)).where(F.col("_asked").isNotNull() & (F.size("_lines") > 0))
    read = rows.select("_asked.*", F.transform(F.array_sort("_lines"), lambda x: x["line"]).alias("_lines")).withColumn("_call", calls(F.col("_lines"), F.col("start")))
    kept = read.where(~F.exists("_mine", lambda e: F.col("_call").startswith(e))).select("_hit.*")
    return marked.where(F.size("_mine") == 0).select("_hit.*").unionByName(kept)


def sites(direct: DataFrame, files: DataFrame) -> DataFrame:
    """(record_id, signature, file, line, via): direct hits, one a line and signature, and the uses of constants that hold them."""
    own = checkpoint(direct.select("record_id", "signature", "file", "line").distinct())
    return own.withColumn("via", F.lit("")).unionByName(code_context.uses_of(own, files))


def drift_signatures(events: DataFrame) -> DataFrame:
    """events with ``signature``: the tool or the field whose calls an event is about; those of a whole response have none."""
    tool = F.split_part(F.substr("path", F.lit(6)), F.lit("."), F.lit(1))
    leaf = F.replace(F.element_at(F.split("path", r"\."), -1), F.lit("[]"), F.lit(""))
    return events.withColumn("signature", F.when(F.col("path").startswith("tool:"), tool).otherwise(leaf)).where("signature not in ('', '$')")


def only_files(sites: DataFrame, changed: DataFrame, file: str = "file") -> DataFrame:
    """Sites in changed files (path), whichever way their slashes lean."""
    plain = F.ltrim(F.replace(F.col(file), F.lit("\\"), F.lit("/")), F.lit("/"))
    wanted = changed.select(F.ltrim(F.replace("path", F.lit("\\"), F.lit("/")), F.lit("/")).alias("_path")).distinct()
    return sites.withColumn("_path", plain).join(wanted, "_path", "left_semi").drop("_path")


def ignore_patterns(text: str | None) -> list[str]:
    """The patterns of an ignore file: a line each, without comments and blank lines."""
    lines = (line.strip() for line in (text or "").splitlines())
    return [line for line in lines if line and not line.startswith("#")]
