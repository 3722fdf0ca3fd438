"""Queries of the training-data operators: each applies its operator to the whole of its table.

``QUERIES`` has (spark, sf_dir) -> DataFrame by name, ``ORACLES`` the DuckDB SQL
of those that SQL can express.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, bpe, embedding, html_text, lexical, line_dedup, media, mixing, quality, sharding, simhash, suffix_tree, url_filter
from .common import checkpoint, table


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every text and the text decoded from them, as digests."""
    ranks = bpe.read_ranks(spark, public_tokenizers.path("byte_bpe_50k.tiktoken"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    ids = bpe.decode(bpe.encode(docs, ranks, public_tokenizers.PATTERN), ranks)
    return ids.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


#: Labels are learned from rows outside fold 0 of five.
TRAIN = "coalesce(crc32(cast(cast(doc_id as string) as binary)) % 5, 0) != 0"


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document, learned from the labels of four folds of five."""
    scores = quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), TRAIN)
    return scores.select("doc_id", (~F.expr(TRAIN)).alias("held_out"), "score", (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hexadecimal(F.col("fingerprint")).alias("fingerprint"), "component_id")


def op4_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links within labels at cosine 0.93, for every vector."""
    return embedding.link(table(spark, sf_dir, "embeddings"))


_EMBEDDING_SQL = f"""
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
ok AS (SELECT * FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS x, b.vec_id AS y FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= {embedding.COSINE}),
reach AS (SELECT vec_id AS x, vec_id AS y FROM v UNION SELECT r.x, l.y FROM reach r JOIN links l ON l.x = r.y),
c AS (SELECT x AS vec_id, min(y) AS component_id FROM reach GROUP BY x), n AS (SELECT x AS vec_id, count(*) AS n_links FROM links GROUP BY x)
SELECT vec_id, coalesce(n_links, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept FROM c LEFT JOIN n USING (vec_id)"""


def op5_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recordings that match those of every hundredth conversation; each turn's text is played as a melody."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    prints = media.fingerprints(turns, media.rendered(F.col("text"))).drop("text")
    found = media.search(prints, F.col("conv_id") * (1 << 20) + F.col("turn"), F.col("conv_id") % 100 == 0)
    match = F.col("match_key")
    return found.select("conv_id", "turn", "n_matches", F.shiftright(match, 20).alias("match_conv_id"), F.pmod(match, F.lit(1 << 20)).alias("match_turn"), "match_offset", "match_error")


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    pages = html_text.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return pages.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


#: The tree of the mixture: domain, language, source. Nodes that aren't named weigh 1.
MIX_PATH = {
    "domain": "CASE WHEN source = 'src0' THEN 'crawl' WHEN length(source) = 4 THEN 'reference' ELSE 'community' END",
    "lang": "coalesce(lang, '')",
    "source": "coalesce(source, '')",
}
MIX_WEIGHTS = {
    ("crawl",): 2, ("reference",): 5, ("community",): 3,
    ("crawl", "en"): 4, ("reference", "en"): 4, ("community", "en"): 4,
    ("crawl", "de"): 2, ("reference", "de"): 2, ("community", "de"): 2,
    ("crawl", "fr"): 2, ("reference", "fr"): 2, ("community", "fr"): 2,
    ("reference", "en", "src1"): 3,
}
MIX_PERCENT, MIX_EPOCHS, MIX_SEED = 60, 2, 7


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each document is taken for a mixture of 60 % of all tokens, at most two epochs of a source."""
    docs = table(spark, sf_dir, "documents").select("doc_id", *[F.expr(c).alias(n) for n, c in MIX_PATH.items()], mixing.words(F.col("text")).alias("n_tokens"))
    return mixing.copies(checkpoint(docs), [*MIX_PATH], MIX_WEIGHTS, MIX_PERCENT, MIX_EPOCHS, MIX_SEED).select("doc_id", *MIX_PATH, "n_tokens", "copies")


def _mixing_sql() -> str:
    """The same budgets and prefixes; places are compared with running sums over whole leaves."""
    path = list(MIX_PATH)
    case = lambda i: "CASE " + "".join(f"WHEN {' AND '.join(f"{c} = '{v}'" for c, v in zip(path, k, strict=False))} THEN {w} " for k, w in MIX_WEIGHTS.items() if len(k) == i + 1) + "ELSE 1 END"
    levels = ""
    for i, child in enumerate(path):
        above, here = ", ".join(["root", *path[:i]]), ", ".join(["root", *path[: i + 1]])
        levels += f"""
, n{i} AS (SELECT {here}, sum(tokens)::HUGEINT * {MIX_EPOCHS} AS cap, max(w{i})::HUGEINT AS weight FROM leaves GROUP BY ALL)
, o{i} AS (SELECT *, sum(weight) OVER (PARTITION BY {above}) AS w_all,
    coalesce(sum(cap) OVER s, 0) AS c_before, coalesce(sum(weight) OVER s, 0) AS w_before, row_number() OVER r AS pos
  FROM n{i} JOIN b{i} USING ({above})
  WINDOW s AS (PARTITION BY {above} ORDER BY cap::DOUBLE / weight::DOUBLE, {child} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
    r AS (PARTITION BY {above} ORDER BY cap::DOUBLE / weight::DOUBLE, {child}))
, p{i} AS (SELECT *, min(pos) FILTER (cap * (w_all - w_before) > (budget - c_before) * weight) OVER (PARTITION BY {above}) AS stop FROM o{i})
, q{i} AS (SELECT *, coalesce(sum(cap) FILTER (stop IS NULL OR pos < stop) OVER (PARTITION BY {above}), 0) AS c_full,
    coalesce(sum(weight) FILTER (stop IS NULL OR pos < stop) OVER (PARTITION BY {above}), 0) AS w_full FROM p{i})
, b{i + 1} AS (SELECT {here}, CASE WHEN stop IS NULL OR pos < stop THEN cap ELSE ((budget - c_full) * weight)::HUGEINT // (w_all - w_full)::HUGEINT END::HUGEINT AS budget FROM q{i})"""
    keys = ", ".join(path)
    return f"""
WITH d AS (SELECT doc_id, {", ".join(f"{c} AS {n}" for n, c in MIX_PATH.items())}, 0 AS root,
  len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS n_tokens FROM documents)
, leaves AS (SELECT root, {keys}, sum(n_tokens)::HUGEINT AS tokens, {", ".join(f"{case(i)} AS w{i}" for i in range(len(path)))} FROM d GROUP BY ALL)
, b0 AS (SELECT root, (sum(tokens)::HUGEINT * {MIX_PERCENT} // 100)::HUGEINT AS budget FROM leaves GROUP BY root){levels}
, f AS (SELECT {keys}, CASE WHEN tokens > 0 THEN budget // tokens ELSE 0 END::BIGINT AS whole, budget, tokens FROM b{len(path)} JOIN leaves USING (root, {keys}))
, k AS (SELECT d.*, whole, (budget - whole * tokens)::BIGINT AS rest,
  concat(md5(concat('{MIX_SEED}:', whole, ':', coalesce(doc_id::VARCHAR, ''))), ':', coalesce(doc_id::VARCHAR, '')) AS place
  FROM d JOIN f USING ({keys}))
, r AS (SELECT *, sum(n_tokens) OVER (PARTITION BY {keys} ORDER BY place) AS upto FROM k)
SELECT doc_id, {keys}, n_tokens, (whole + CASE WHEN rest > 0 AND upto <= rest THEN 1 ELSE 0 END)::INTEGER AS copies FROM r"""


URL_RULES = [("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/")]


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, rule and verdict of every page's URL."""
    judged = url_filter.judge(table(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict", "number")


#: The language model learns from rows outside fold 2 of seven.
LM_TRAIN = "coalesce(crc32(cast(cast(doc_id as string) as binary)) % 7, 0) != 2"


def op9_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """log10 probability of every document under the suffix tree and under word counts."""
    docs = table(spark, sf_dir, "documents")
    train = docs.where(LM_TRAIN).select("text")
    counts = checkpoint(suffix_tree.word_counts(train))
    scores = suffix_tree.score(docs, suffix_tree.learn(train, counts), counts, F.expr(LM_TRAIN))
    return scores.select("doc_id", (~F.expr(LM_TRAIN)).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


SHARDS = 24


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of every document, equal texts together and bytes near equal."""
    text = F.coalesce("text", F.lit(""))
    rows = table(spark, sf_dir, "documents").select(
        "doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("group")
    )
    out = sharding.assign(rows, SHARDS, F.col("group"), F.col("size"), F.col("doc_id"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


#: Lines of at least one code point that stand in ten documents go; the table is read in four batches.
LINE_DOCS, LINE_CHARS, LINE_BATCHES = 10, 1, 4


def op11_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document less the lines that many documents share."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    batch = F.pmod(F.xxhash64("doc_id"), F.lit(LINE_BATCHES))
    kept = line_dedup.drop_repeated(docs, batch, LINE_BATCHES, LINE_DOCS, min_chars=LINE_CHARS)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


_LINES_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS id, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT id, doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS place FROM d),
k AS (SELECT *, trim(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS key FROM l),
r AS (SELECT key FROM k WHERE length(key) >= {LINE_CHARS} GROUP BY key HAVING count(DISTINCT id) >= {LINE_DOCS}),
m AS (SELECT k.*, r.key IS NOT NULL AS gone FROM k LEFT JOIN r USING (key))
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (NOT gone), '')) AS kept_sha256 FROM m GROUP BY id, doc_id"""


#: Documents that are returned for an item.
BEST = 50


def op12_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best documents of every benchmark item."""
    found = lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark").select("item_id", "text"), BEST)
    return found.select("item_id", "rank", F.col("doc").alias("doc_id"), "score")


_SEARCH_SQL = rf"""
WITH words AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
t AS (SELECT doc_id, term, count(*)::BIGINT AS tf FROM words GROUP BY ALL),
d AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM t GROUP BY doc_id), c AS (SELECT count(*)::BIGINT AS n_docs, sum(n)::BIGINT AS n_terms FROM d),
i AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
w AS (SELECT term, floor(1000 * ln((2 * any_value(n_docs) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM t, c WHERE term IN (SELECT term FROM i) GROUP BY term),
s AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * n_docs) // n_terms))))::BIGINT AS score
  FROM i JOIN t USING (term) JOIN w USING (term) JOIN d USING (doc_id), c GROUP BY item_id, doc_id)
SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INTEGER AS rank, doc_id, score FROM s WHERE score > 0
QUALIFY rank <= {BEST}"""


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the tokens of two tokenizers align in every document."""
    files = alignment.read_tokenizers(spark, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    return alignment.document_links(table(spark, sf_dir, "documents").select("doc_id", "text"), files, public_tokenizers.PATTERN)


QUERIES = {"op1_quality": op1_quality, "op2_simhash": op2_simhash, "op3_bpe": op3_bpe, "op4_embedding": op4_embedding, "op5_media": op5_media, "op6_html_text": op6_html_text, "op7_mixing": op7_mixing, "op8_url_filter": op8_url_filter, "op9_lm_score": op9_lm_score, "op10_sharding": op10_sharding, "op11_lines": op11_lines, "op12_search": op12_search, "op13_alignment": op13_alignment}
ORACLES = {"op4_embedding": _EMBEDDING_SQL, "op7_mixing": _mixing_sql(), "op11_lines": _LINES_SQL, "op12_search": _SEARCH_SQL}
