"""Where records' identifiers occur in lines of code or text.

Signatures are a small dimension; lines are the large side. As far as the signatures are
few (counted first), ``token_hits`` scans each line once with an automaton of all of them.
More of them are joined. Signatures have few outlines (words and numbers as such, and what stands between, before and
behind them); what in a line has one of those and ends like a token is joined to the signatures as a
whole text, so that neither side is sent more than once. Signatures of rarer outlines, and those with named variants, have candidates
by an equi-join on plain words, so that every
line meets only signatures whose rarest word it holds (of words, the one that fewest signatures have), and verifies them with
the exact pattern; signatures that may stand inside a word or have none are looked for
by automata of bounded size beside the join. A word on a third of all lines is a skewed key of the large
side only; the dimension's rows are broadcast as far as their size allows, and
adaptive execution splits the join otherwise.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import token_end

#: Rows of a signature table up to which it is broadcast.
BROADCAST_ROWS = 50_000
#: Rows of a signature table up to which lines are scanned for all of them at once.
SCAN_ROWS = 20_000
#: Compiled ends of tokens that a worker keeps.
ENDS = 1_000
#: Signatures of one automaton beside the join.
SCAN_BLOCK = 20_000
#: Outlines of signatures by which lines are cut, those that most signatures have.
OUTLINES = 1_000


def signature_table(records: DataFrame) -> DataFrame:
    """(record_id, signature, word, model): a row for each signature and, if dots are escaped in code, its escaped form."""
    rows = records.select(F.col("id").alias("record_id"), F.explode("signatures").alias("signature"), (F.col("kind") == "model").alias("model"))
    escaped = F.replace("signature", F.lit("."), F.lit("\\."))
    written = F.when(F.col("signature").contains("."), F.array("signature", escaped)).otherwise(F.array("signature"))
    return rows.withColumn("written", F.explode(written)).withColumn("word", longest_word(F.col("written")))


def longest_word(text: Column) -> Column:
    """The longest (of several, the first) run of word characters; null if there is none."""
    words = F.regexp_extract_all(text, F.lit("[A-Za-z0-9_]+"), F.lit(0))
    return F.try_element_at(F.array_sort(words, lambda a, b: F.char_length(b) - F.char_length(a)), F.lit(1))


def by_rarest_word(signatures: DataFrame) -> DataFrame:
    """Signatures (written, ...) with, as ``word``, that of their words which fewest of them have; of several the longest, then the first in order.

    A word that many share (``model`` in ``model-1``, ``model-2``, ...) would bring every line with it to all of them.
    Words with ``__`` are taken only if there is no other. None is null.
    """
    words = F.array_distinct(F.regexp_extract_all("written", F.lit("[A-Za-z0-9_]+"), F.lit(0)))
    plain = F.filter(words, lambda w: ~w.contains("__"))
    forms = signatures.select("written").distinct()
    each = forms.select("written", F.explode(F.when(F.size(plain) > 0, plain).otherwise(words)).alias("_word"))
    rarity = each.groupBy("_word").agg(F.count("*").alias("_n"))
    best = each.join(rarity, "_word").groupBy("written").agg(F.min(F.struct("_n", -F.char_length("_word"), "_word")).alias("_best"))
    return signatures.drop("word").join(best.select("written", F.col("_best._word").alias("word")), "written", "left").select(*signatures.columns)


def line_words(lines: DataFrame, keep: Sequence[str], line: str = "line") -> DataFrame:
    """Each word of each line once."""
    return lines.select(*keep, line, F.explode(F.array_distinct(F.regexp_extract_all(F.col(line), F.lit("[A-Za-z0-9_]+"), F.lit(0)))).alias("word"))


def candidates(lines: DataFrame, signatures: DataFrame, keep: Sequence[str], line: str = "line") -> DataFrame:
    """Lines that hold a signature as a substring, found by its rarest word; ``signatures`` has (written, word, ...).

    A signature may begin or end inside a word of the line (``mcp__x__name``, names with
    underscores at their ends); those have their own key: any word that contains it. Signatures
    without a word, with ``_`` at an end or ``__`` in their word have no such key in every line that
    holds them, and are found by automata instead.
    """
    text = F.col("written")
    signatures = by_rarest_word(signatures)
    keyed = F.coalesce(~(text.startswith("_") | text.endswith("_") | F.col("word").contains("__")), F.lit(False))
    found = _by_word(lines, signatures.where(keyed), keep, line)
    odd = signatures.where(~keyed)
    forms = sorted(r.written for r in odd.select("written").distinct().collect() if r.written)
    for i in range(0, len(forms), SCAN_BLOCK):
        found_here = lines.select(*keep, F.col(line).alias("line"), F.explode(held(F.col(line), forms[i : i + SCAN_BLOCK])).alias("written"))
        found = found.unionByName(found_here.join(odd.drop("word"), "written"))
    return found


def held(line: Column, forms: Sequence[str]) -> Column:
    """Which of some texts a line or a whole text holds, by one automaton of all of them."""

    @F.arrow_udf("array<string>")
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        from ahocorasick import Automaton

        automaton = Automaton()
        for form in forms:
            automaton.add_word(form, form)
        automaton.make_automaton()
        for batch in batches:
            yield pa.array([sorted({form for _, form in automaton.iter(text or "")}) for text in batch.to_pylist()], pa.list_(pa.string()))

    return of(line)


def _by_word(lines: DataFrame, signatures: DataFrame, keep: Sequence[str], line: str) -> DataFrame:
    small = F.broadcast(signatures) if signatures.count() <= BROADCAST_ROWS else signatures
    words = lines.select(*keep, F.col(line).alias("line"), F.regexp_extract_all(F.col(line), F.lit("[A-Za-z0-9_]+"), F.lit(0)).alias("_words"))
    joined = words.select(*keep, "line", F.explode(F.array_distinct(_keys(F.col("_words")))).alias("word")).join(small, "word")
    return joined.where(F.col("line").contains(F.col("written"))).drop("word")


def _keys(words: Column) -> Column:
    joined = F.filter(words, lambda w: w.contains("__"))
    inner = F.flatten(F.transform(joined, lambda w: F.split(w, "__")))
    inner = F.concat(inner, F.transform(inner, lambda w: F.regexp_replace(w, r"\A_+", "")))
    called = F.transform(joined, lambda w: F.regexp_extract(w, r"\A.*?mcp__.*?__(.*)\z", 1))
    edged = F.filter(words, lambda w: w.startswith("_") | w.endswith("_"))
    return F.concat(words, inner, called, F.transform(edged, lambda w: F.regexp_replace(w, r"\A_+|_+\z", "")))


def positions(line: Column, signature: Column, model: Column, named: Column) -> Column:
    """Places (from 0, overlaps included) at which a signature stands as a token."""

    @F.arrow_udf("array<int>")
    def of(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        ends: dict[str, re.Pattern[str]] = {}
        for texts, signatures, models, names in batches:
            out = []
            for text, s, is_model, n in zip(texts.to_pylist(), signatures.to_pylist(), models.to_pylist(), names.to_pylist(), strict=True):
                end = token_end(s, bool(is_model), n or ())
                if end not in ends:
                    if len(ends) >= ENDS:
                        ends.clear()
                    ends[end] = re.compile(end)
                out.append(token_positions(text, s, ends[end], len(s)))
            yield pa.array(out, pa.list_(pa.int32()))

    return of(line, signature, model, named)


_JOINED = re.compile(r"mcp__[A-Za-z0-9_-]{0,100}__\Z")
#: Characters that it takes at most.
MCP_CHARS = 107


def python_pattern(signature: str, model: bool, named: Sequence[str]) -> str:
    """The pattern without its look-behinds, which Python can't vary in length; ``token_positions`` does their work.

    Few ends differ (``token_end``): many signatures share a compiled one, to be matched behind where they stand.
    """
    return re.escape(signature) + token_end(signature, model, named)


def is_token(text: str, at: int, signature: str, pattern: re.Pattern[str], skip: int = 0) -> bool:
    """Whether the signature that stands at a place is a token there. skip: its length, if the pattern is that of its end alone."""
    before = text[at - 1] if at else " "
    free = not (signature[0].isascii() and signature[0].isalnum()) or not (before == "_" or before.isascii() and before.isalnum()) or _JOINED.search(text, 0, at)
    return bool(free and pattern.match(text, at + skip))


def token_positions(text: str, signature: str, pattern: re.Pattern[str], skip: int = 0) -> list[int]:
    found, at = [], text.find(signature)
    while at >= 0:
        if is_token(text, at, signature, pattern, skip):
            found.append(at)
        at = text.find(signature, at + 1)
    return found


HITS = pa.list_(pa.struct([("written", pa.string()), ("model", pa.bool_()), ("start", pa.int32())]))
HITS_SQL = "array<struct<written:string,model:boolean,start:int>>"


def scan(line: Column, wanted: Sequence[tuple[str, bool]]) -> Column:
    """All tokens of a few signatures (written form, model) in a line, found by one automaton in one pass."""

    @F.arrow_udf(HITS_SQL)
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        from ahocorasick import Automaton

        automaton, patterns = Automaton(), {w: re.compile(python_pattern(*w, ())) for w in wanted}
        forms: dict[str, list[bool]] = {}
        for written, model in wanted:
            forms.setdefault(written, []).append(model)
        for written, models in forms.items():
            automaton.add_word(written, (written, models))
        automaton.make_automaton()
        for batch in batches:
            out = []
            for text in batch.to_pylist():
                found = []
                for end, (written, models) in automaton.iter(text or ""):
                    at = end - len(written) + 1
                    found += [{"written": written, "model": m, "start": at} for m in models if is_token(text, at, written, patterns[written, m])]
                out.append(found)
            yield pa.array(out, HITS)

    return of(line)


def outline(text: Column) -> Column:
    """A signature with ``w`` for each of its words and ``0`` for each number; null if it has none, or ``_`` at an end, as it may then stand inside a word."""
    marked = F.regexp_replace(F.regexp_replace(text, "[0-9]*+[A-Za-z_][A-Za-z0-9_]*", "w"), "[0-9]+", "0")
    return F.when(~(text.startswith("_") | text.endswith("_")) & text.rlike("[A-Za-z0-9_]"), marked)


def outline_tree(outlines: Sequence[str]) -> dict:
    """Outlines word by word: the kind of a word, what stands behind it, the kind of the next; under None what stands before and behind a whole one."""
    tree: dict = {}
    for text in outlines:
        before, *rest = re.split("([w0])", text)
        nodes = tree
        for kind, gap in zip(rest[::2], rest[1::2], strict=True):
            node = nodes.setdefault(kind, {})
            nodes = node.setdefault(gap, {})
        if not nodes:
            del node[gap]
        node.setdefault(None, []).append((before, gap))
    return tree


_WORDS = re.compile("([A-Za-z0-9_]+)")
_INNER = re.compile("(?<=__)[A-Za-z0-9]")
_END, _MODEL_END = re.compile(token_end("x")), re.compile(token_end("x", True))


def line_spans(text: str, tree: dict) -> Iterator[tuple[int, int, bool]]:
    """(start, stop, model): what in a text has one of the outlines and is a token; whether it would be one as a model's id."""
    pieces = _WORDS.split(text)  # every other one is a word
    ends = list(accumulate(map(len, pieces)))
    words, gaps, firsts, stops = pieces[1::2], pieces[2::2], ends[::2], ends[1::2]
    kinds = ["0" if word.isdigit() else "w" for word in words]
    last = len(words) - 1
    for i, word in enumerate(words):
        first = firsts[i]
        starts = ((first, kinds[i]),)
        if "__" in word:  # mcp__server__ may stand before a signature
            inner = [m.start() for m in _INNER.finditer(text, first, stops[i])]
            starts += tuple((at, "0" if text[at : stops[i]].isdigit() else "w") for at in inner if at > first and _JOINED.search(text, max(0, at - MCP_CHARS), at))
        for at, kind in starts:
            node, k = tree.get(kind), i
            while node:
                if None in node:
                    stop = stops[k]
                    for before, after in node[None]:
                        if before:
                            if at > first or not text.endswith(before, 0, at):
                                continue
                        elif text[at] == "_":
                            continue
                        if after:
                            if text.startswith(after, stop):
                                yield at - len(before), stop + len(after), True
                        elif text[stop - 1] != "_" and _END.match(text, stop):
                            yield at - len(before), stop, bool(_MODEL_END.match(text, stop))
                if k == last or (nodes := node.get(gaps[k])) is None:
                    break
                k += 1
                node = nodes.get(kinds[k])


def spans(line: Column, outlines: Sequence[str]) -> Column:
    """What in a line has one of the outlines and is a token."""

    @F.arrow_udf("array<struct<written:string,start:int,model:boolean>>")
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        tree = outline_tree(outlines)
        for batch in batches:
            ends, written, starts, models = [0], [], [], []
            for text in batch.to_pylist():
                for start, stop, model in line_spans(text or "", tree):
                    written.append(text[start:stop])
                    starts.append(start)
                    models.append(model)
                ends.append(len(starts))
            fields = [pa.array(written, pa.string()), pa.array(starts, pa.int32()), pa.array(models, pa.bool_())]
            yield pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(fields, ["written", "start", "model"]))

    return of(line)


def _by_outline(lines: DataFrame, signatures: DataFrame, keep: Sequence[str], forms: DataFrame) -> DataFrame:
    """``token_hits`` of many signatures: their outlines are counted, and what has one in a line is joined to them as a whole text."""
    counts = forms.groupBy(outline(F.col("written")).alias("outline")).count()
    counted = counts.orderBy(F.col("outline").isNull().desc(), F.desc("count"), "outline").limit(OUTLINES + 2).collect()
    usual = [r for r in counted if r.outline is not None][:OUTLINES]
    few = len(counted) <= OUTLINES and sum(r["count"] for r in counted) <= BROADCAST_ROWS
    columns = [c for c in signatures.columns if c not in ("written", "word")]
    wanted = signatures.select(*columns, F.col("written").alias("_written"))
    found = lines.select(*keep, "line", F.explode(spans(F.col("line"), [r.outline for r in usual])).alias("_span"))
    found = found.select(*keep, "line", F.col("_span.written").alias("_text"), F.col("_span.start").alias("start"), F.col("_span.model").alias("_as_model"))
    wanted = F.broadcast(wanted) if few else wanted.hint("merge")  # plans take texts made of few columns for small tables
    hits = found.join(wanted, (F.col("_text") == F.col("_written")) & (F.col("_as_model") | ~F.coalesce("model", F.lit(False))))
    hits = hits.select(*keep, "line", *columns, "start", (F.col("start") + F.char_length("_text")).alias("stop"))
    if len(usual) < len(counted):  # signatures without an outline, or with a rarer one
        shape = outline(F.col("written"))
        rest = signatures.where(shape.isNull() | ~shape.isin([r.outline for r in usual]))
        hits = hits.unionByName(_verified(candidates(lines, rest, keep), F.array().cast("array<string>")))
    return hits


def _verified(found: DataFrame, named: Column) -> DataFrame:
    """A row for each place of a candidate's line at which its signature is a token."""
    hits = found.withColumn("start", F.explode(positions(F.col("line"), F.col("written"), F.col("model"), named)))
    return hits.withColumn("stop", F.col("start") + F.char_length("written")).drop("written")


def token_hits(lines: DataFrame, signatures: DataFrame, keep: Sequence[str], named: Column | None = None, forms: DataFrame | None = None) -> DataFrame:
    """A row for each occurrence: ``keep``, the signature's columns, line, start, stop.

    Up to ``SCAN_ROWS`` signatures are looked for by one automaton in each line; more of them
    by the join of whole texts, and those with named variants by the join of words.
    forms: rows with all the ``written`` that signatures have, repeated or not, if a signature table is dear to read; it is counted and its outlines are.
    """
    forms = signatures if forms is None else forms
    if named is None and forms.limit(SCAN_ROWS + 1).count() <= SCAN_ROWS:
        wanted = [(r.written, r.model) for r in signatures.select("written", "model").distinct().collect() if r.written]
        if wanted:
            found = lines.select(*keep, "line", F.explode(scan(F.col("line"), wanted)).alias("_hit"))
            small = F.broadcast(signatures.drop("word").withColumnsRenamed({"written": "_written", "model": "_model"}))
            hits = found.join(small, (F.col("_hit.written") == F.col("_written")) & (F.col("_hit.model") == F.col("_model")))
            hits = hits.withColumns({"start": F.col("_hit.start"), "stop": F.col("_hit.start") + F.char_length("_written"), "model": F.col("_model")})
            return hits.drop("_hit", "_written", "_model")
    if named is None:
        return _by_outline(lines, signatures, keep, forms)
    return _verified(candidates(lines, signatures, keep), named)


def longest_wins(hits: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Drop hits that lie inside a longer one of the same record and line."""
    by = Window.partitionBy(*keys)
    # a hit is covered if one that begins no later reaches as far, and isn't itself
    order = by.orderBy("start", F.desc("stop")).rowsBetween(Window.unboundedPreceding, -1)
    return hits.withColumn("_reach", F.max("stop").over(order)).where(F.col("_reach").isNull() | (F.col("_reach") < F.col("stop"))).drop("_reach")


def not_excluded(hits: DataFrame, excludes: Sequence[str], line: str = "line") -> DataFrame:
    """Drop hits that lie inside an excluded text of the line."""
    covered = F.lit(False)
    for text in excludes:
        # the last place at which the text could begin and still cover the hit
        window = F.substring(F.col(line), F.greatest(F.col("stop") - len(text) + 1, F.lit(1)), 2 * len(text) - (F.col("stop") - F.col("start")))
        covered = covered | window.contains(text)
    return hits.where(~covered)


def context_matches(text: Column, groups: Column) -> Column:
    """Whether all words of any group occur, without regard to case; no groups match anything."""
    lower = F.lower(text)
    return (F.size(groups) <= 0) | F.exists(groups, lambda g: F.forall(g, lambda w: lower.contains(F.lower(w))))


def repo_words(files: DataFrame, words: Sequence[str], repo: str = "repo", text: str = "text") -> DataFrame:
    """(repo, words): which of the words occur in any file of a repository."""
    lower = F.lower(text)
    seen = files.groupBy(repo).agg(*[F.bool_or(lower.contains(w.lower())).alias(f"_{i}") for i, w in enumerate(words)])
    return seen.select(repo, F.array_compact(F.array(*[F.when(F.col(f"_{i}"), F.lit(w)) for i, w in enumerate(words)])).alias("words"))


def repo_context(records: DataFrame, repos: DataFrame) -> DataFrame:
    """(id, repo) pairs of the records with a context whose repository has all words of a group, and of those without one with every repository.

    repos: (repo, words). Words meet in a join, so no record is held against every repository but those that hold for all of them.
    """
    groups = records.select("id", F.posexplode("repo_context").alias("_group", "_words")).select("id", "_group", F.array_distinct("_words").alias("_words"))
    need = groups.select("id", "_group", F.size("_words").alias("_n"), F.explode("_words").alias("word"))
    has = repos.select("repo", F.explode(F.array_distinct("words")).alias("word"))
    full = need.join(has, "word").groupBy("id", "_group", "_n", "repo").agg(F.count("*").alias("_found")).where("_found = _n").select("id", "repo")
    empty = groups.where(F.size("_words") == 0).select("id").union(records.where(F.size(F.coalesce("repo_context", F.array())) == 0).select("id")).distinct()
    everywhere = repos.select("repo", F.explode(F.array(F.lit(0))).alias("_all")).join(empty.withColumn("_all", F.lit(0)), "_all").select("id", "repo")
    return full.unionByName(everywhere).distinct()


def gated(hits: DataFrame, records: DataFrame, repos: DataFrame) -> DataFrame:
    """hits (record_id, repo, ...) of records without a context, or in a repository (repo, words) that has it."""
    asked = records.where(F.size(F.coalesce("repo_context", F.array())) > 0)
    pairs = repo_context(asked, repos).withColumnRenamed("id", "record_id")
    free = hits.join(asked.select(F.col("id").alias("record_id")), "record_id", "left_anti")
    return free.unionByName(hits.join(pairs, ["record_id", "repo"], "left_semi").select(*free.columns))


def whole_line_comment(line: Column) -> Column:
    return line.rlike(r"\A\s*(?:#|//|/\*|\*|--|<!--)")
