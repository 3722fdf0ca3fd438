"""URL filters: rules, and a character language-model ratio for the rest.

``parts`` splits URLs into host and path, ``rule`` finds the longest rule that fits,
``fit`` learns two character models, ``judge`` puts them together.

Method: one variable-order Markov model of accepted and one of rejected URLs, as bytes.
A context of up to ``ORDER`` bytes counts if it occurs in a share of ``MIN_SHARE`` of
its model's URLs; the distribution in a context is its counts with ``PULL`` more dealt as
the next shorter context deals them, down to even shares of bytes. A URL's number is
the difference of its log likelihoods a byte. The threshold is found on sites that a
model hasn't seen: the sites are dealt to ``FOLDS`` folds, each is scored by the models of the
others, and each site with rejected or accepted URLs counts once. It is the middle of
the widest stretch of numbers that part these sites best, or within ``TOLERANCE`` as well,
with ``MAX_FALSE`` of the accepted ones above at most. If even so less than
``MIN_GAIN`` more of the rejected than of the accepted sites are above it, the examples tell nothing of
sites that aren't among them: the threshold is infinite, and what no rule judges is allowed.
N-grams and histograms are counted in Spark over all examples; contexts over the share are few
however many URLs there are.

Examples are a labelled table (url, bad) that the caller names. Without one they are the
URLs that the rules judge, and what the rules themselves look at is left out of the
text, there and in the URLs to be judged: labels of a host that a rule names, and as many
segments of a path as the longest rule has. No word is known to this module as unwanted.

Defined results: null URLs and those without ``://`` have an empty host and path;
a URL without any text has number 0 and, without a rule, the verdict allow; without examples of
both kinds all numbers are 0 and the threshold is infinite. Examples with a null label are left out; repeated rows
count and are judged each.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint

ORDER, MIN_SHARE, PULL = 4, 0.003, 1.0
#: Bins of the calibration's histogram between -SPAN and SPAN.
BINS, SPAN = 2000, 4.0
FOLDS, TOLERANCE, MAX_FALSE, MIN_GAIN = 5, 0.05, 0.05, 0.5
BEGIN = b"\x00"


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; empty if there is no ``://``."""
    pattern = r"(?s)\A.*?://([^/?#]*)([^?#]*)"
    found = lambda i: F.coalesce(F.regexp_extract(url, pattern, i), F.lit(""))
    return F.translate(found(1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), found(2)


def rule(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """(rule, verdict) of the longest rule that fits, null for none. rules: ("block" or "allow", host and path)."""
    out = None
    for verdict, text in sorted(rules, key=lambda r: -len(r[1])):
        name, slash, rest = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        value = F.struct(F.lit(text).alias("rule"), F.lit(verdict).alias("verdict"))
        out = F.when(fits, value) if out is None else out.when(fits, value)
    return out if out is not None else F.lit(None).cast("struct<rule:string,verdict:string>")


@dataclass
class CharModel:
    """counts: by context, how often each byte follows it."""

    counts: dict[bytes, dict[int, int]]
    _logs: dict[bytes, list[float]] = field(default_factory=dict)

    def _shares(self, context: bytes) -> np.ndarray:
        shorter = self._shares(context[1:]) if context else np.full(256, 1 / 256)
        own = self.counts.get(context)
        if own is None:
            return shorter
        shares = PULL * shorter
        shares[list(own)] += list(own.values())
        return shares / (PULL + sum(own.values()))

    def _state(self, context: bytes) -> bytes:
        while context and context not in self.counts:
            context = context[1:]
        return context

    def log(self, data: bytes) -> float:
        total, run = 0.0, BEGIN
        for byte in data:
            state = self._state(run)
            if (logs := self._logs.get(state)) is None:
                logs = self._logs[state] = np.log(self._shares(state)).tolist()
            total += logs[byte]
            run = (run + bytes([byte]))[-ORDER:]
        return total


def unnamed(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """What no rule looks at: the other labels of the host, and the path behind the segments of the longest rule."""
    named = sorted({label for _, text in rules for label in text.partition("/")[0].split(".")})
    depth = max((len([x for x in text.split("/")[1:] if x]) for _, text in rules), default=0)
    labels = F.array_join(F.filter(F.split(host, r"\."), lambda x: ~x.isin(named)), ".")
    return F.concat(labels, F.regexp_replace(path, rf"(?s)\A(?:/[^/]*){{0,{depth}}}", ""))


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(bad, fold, context, byte, n): sums of a task."""
    held: Counter[tuple[bool, int, bytes, int]] = Counter()

    def out() -> pa.RecordBatch:
        bad, fold, context, byte = zip(*held, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(bad), pa.array(fold, pa.int32()), pa.array(context, pa.binary()), pa.array(byte, pa.int32()), pa.array(list(held.values()), pa.int64())], ["bad", "fold", "context", "byte", "n"])

    for batch in batches:
        for bad, fold, text, n in zip(*(batch.column(c).to_pylist() for c in ("bad", "fold", "text", "n")), strict=True):
            run = BEGIN
            for byte in text.encode():
                for k in range(len(run) + 1):
                    held[bad, fold, run[k:], byte] += n
                run = (run + bytes([byte]))[-ORDER:]
            if len(held) > 500_000:
                yield out()
                held.clear()
    if held:
        yield out()


@dataclass
class Judge:
    accepted: CharModel
    rejected: CharModel
    threshold: float = np.inf

    def number(self, text: str) -> float:
        data = text.encode()
        return (self.rejected.log(data) - self.accepted.log(data)) / len(data) if data else 0.0


def _numbers(judges: Sequence[Judge], text: Column, which: Column) -> Column:
    """Each text's number, by the judge of its place in ``judges``."""

    @F.arrow_udf("double")
    def of(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, places in batches:
            found: dict[tuple[str, int], float] = {}
            keys = [(t or "", p) for t, p in zip(texts.to_pylist(), places.to_pylist(), strict=True)]
            for key in keys:
                if key not in found:
                    found[key] = judges[key[1]].number(key[0])
            yield pa.array([found[k] for k in keys], pa.float64())

    return of(text, which)


def fit(rows: DataFrame) -> Judge:
    """Learn from examples (bad, text, site), and calibrate on sites outside each fold's models."""
    fold = F.pmod(F.xxhash64("site"), F.lit(FOLDS)).cast("int").alias("fold")
    rows = checkpoint(rows.where(F.col("bad").isNotNull() & (F.col("text") != "")).groupBy("bad", "site", fold, "text").agg(F.count("*").alias("n")))
    urls = np.zeros((2, FOLDS), np.int64)
    for r in rows.groupBy("bad", "fold").agg(F.sum("n").alias("n")).collect():
        urls[int(r.bad), r.fold] = r.n
    if not urls.sum(axis=1).all():
        return Judge(CharModel({}), CharModel({}))
    counts = rows.select("bad", "fold", "text", "n").mapInArrow(_grams, "bad boolean, fold int, context binary, byte int, n long").groupBy("bad", "context", "byte", "fold").agg(F.sum("n").alias("n"))
    # contexts over the share: some hundred in a URL's length of bytes, each with 256 next bytes and FOLDS folds at most
    by_context = counts.groupBy("bad", "context").agg(F.sum("n").alias("n"), F.collect_list(F.struct("byte", "fold", "n")).alias("next"))
    least = MIN_SHARE * (urls.sum(axis=1, keepdims=True) - urls).min(axis=1)
    tables: list[list[dict[bytes, dict[int, int]]]] = [[{}, {}] for _ in range(FOLDS + 1)]  # by the fold left out, the last of all; accepted and rejected
    for r in by_context.where(F.col("n") >= F.when(F.col("bad"), float(least[1])).otherwise(float(least[0]))).select("bad", "context", "next").collect():
        for out in range(FOLDS + 1):
            kept: Counter[int] = Counter()
            for byte, its_fold, n in r.next:
                if its_fold != out:
                    kept[byte] += n
            if kept and kept.total() >= MIN_SHARE * (urls[int(r.bad)].sum() - (urls[int(r.bad), out] if out < FOLDS else 0)):
                tables[out][int(r.bad)][bytes(r.context)] = dict(kept)
    judges = [Judge(CharModel(accepted), CharModel(rejected)) for accepted, rejected in tables]
    number = _numbers(judges, F.col("text"), F.col("fold"))
    place = F.greatest(F.lit(0), F.least(F.lit(BINS - 1), F.floor((F.avg(number) + SPAN) * (BINS / (2 * SPAN))))).cast("int")
    sums = np.zeros((2, BINS))
    for r in rows.groupBy("bad", "site").agg(place.alias("bin")).groupBy("bad", "bin").agg(F.count("*").alias("n")).collect():
        sums[int(r.bad), r.bin] = r.n
    judges[-1].threshold = _calibrated(sums)
    return judges[-1]


def _calibrated(sums: np.ndarray) -> float:
    """The threshold by the numbers of accepted and of rejected sites, in bins."""
    above = sums[:, ::-1].cumsum(axis=1)[:, ::-1] / np.maximum(1, sums.sum(axis=1, keepdims=True))
    gain = np.where(above[0] <= MAX_FALSE, above[1] - above[0], -1.0)
    if gain.max() < MIN_GAIN:
        return float("inf")
    best = np.flatnonzero(gain >= gain.max() - TOLERANCE)
    runs = np.split(best, np.flatnonzero(np.diff(best) > 1) + 1)
    widest = max(runs, key=len)
    return float((widest[0] + widest[-1]) / 2 * (2 * SPAN / BINS) - SPAN)


def judge(df: DataFrame, rules: Sequence[tuple[str, str]], url: str = "url", examples: DataFrame | None = None) -> DataFrame:
    """Add host, path, rule, number and verdict. examples: (url, bad); null for what the rules judge."""
    host, path = parts(F.col(url))
    rows = df.withColumns({"host": host, "path": path}).withColumn("__rule", rule(F.col("host"), F.col("path"), rules))
    if examples is None:
        text = unnamed(F.col("host"), F.col("path"), rules)
        known = rows.where("__rule is not null").select((F.col("__rule.verdict") == "block").alias("bad"), text.alias("text"), F.col("host").alias("site"))
    else:
        text, (site, rest) = F.concat("host", "path"), parts(F.col("url"))
        known = examples.select("bad", F.concat(site, rest).alias("text"), site.alias("site"))
    learned = fit(known)
    rows = rows.withColumn("__text", text).withColumn("number", _numbers([learned], F.col("__text"), F.lit(0)))
    verdict = F.coalesce(F.col("__rule.verdict"), F.when((F.col("__text") != "") & (F.col("number") > learned.threshold), "block").otherwise("allow"))
    return rows.withColumns({"rule": F.col("__rule.rule"), "verdict": verdict}).drop("__rule", "__text")
