"""Training-data operators (quality, dedup, tokens, media, HTML, mixing, URLs, LM scores, shards).

Nothing outside this subpackage imports it; ``__spark_entry__`` adds its
queries only when it is present.
"""
