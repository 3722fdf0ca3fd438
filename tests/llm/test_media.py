import io
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from changelens.llm import media
from changelens.llm.queries import op5_media


def wav(samples, rate, width=2, channels=1):
    out = io.BytesIO()
    with wave.open(out, "wb") as f:
        f.setnchannels(channels)
        f.setsampwidth(width)
        f.setframerate(rate)
        scaled = np.repeat(samples, channels) * (2 ** (8 * width - 1) - 1)
        f.writeframes((scaled + (128 if width == 1 else 0)).astype({1: np.uint8, 2: "<i2", 4: "<i4"}[width]).tobytes())
    return out.getvalue()


def song(seed, rate, notes=60):
    tones = np.random.default_rng(seed).integers(0, 24, notes)
    t = np.arange(round(media.HOP * rate)) / rate
    return 0.5 * np.concatenate([np.sin(2 * np.pi * 110 * 2 ** (k / 12) * t) for k in tones])


def plain_filters(frames):
    """The integers by summing boxes cell by cell."""
    out = []
    for i in range(len(frames) - media.SPAN + 1):
        word = 0
        for boxes, step in zip(media.filters(), media.STEPS * 4, strict=True):
            value = sum(sign * frames[i + start + x][(low + y) % 12] for sign, start, wide, low, high in boxes for x in range(wide) for y in range(high)) / (media.SPAN * boxes[0][4])
            level = int(value > -step) + int(value > 0) + int(value > step)
            word = word << 2 | (level ^ level >> 1)
        out.append(word)
    return out


def test_integers_by_definition():
    data = wav(song(1, 4000, 20), 4000)
    assert media.fingerprint(data).tolist() == plain_filters(media.chroma(*media.decode(data)))


def test_other_rates_widths_noise_and_cuts_match_and_other_songs_do_not():
    rng = np.random.default_rng(2)
    plain = media.fingerprint(wav(song(1, 8000), 8000))
    changed = [wav(song(1, 11025), 11025, 4, 2), wav(song(1, 8000), 8000, 1), wav(np.clip(song(1, 8000) + 0.05 * rng.standard_normal(len(song(1, 8000))), -1, 1), 8000), wav(song(1, 8000)[1024 * 15 :], 8000)]
    found = {o: (offset, share) for _, o, offset, share in media.matches([plain], [media.fingerprint(x) for x in changed] + [media.fingerprint(wav(song(k, 8000), 8000)) for k in range(5, 25)])}
    assert set(found) == {0, 1, 2, 3} and found[3][0] == 15 and all(s <= media.MAX_ERROR for _, s in found.values())


def brute(prints):
    """Matches of each with each, trying all offsets at which an integer is shared."""
    out = {}
    for i, a in enumerate(prints):
        for j, b in enumerate(prints):
            best = []
            for offset in {x - y for x in media._starts(a) for y in media._starts(b) if a[x] == b[y]}:
                bits, n = media.error(a, b, offset)
                if n >= min(media.MIN_OVERLAP, len(a), len(b)) and bits <= media.MAX_ERROR * 32 * n:
                    best.append((bits / (32 * n), int(offset)))
            if best:
                out[i, j] = min(best)
    return out


@pytest.mark.parametrize("block", [2048, 9])
def test_search_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(media, "BLOCK", block)
    monkeypatch.setattr(media, "QUERY_BLOCK", block)
    rows = [r for r in spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").collect()][:60]
    texts = [r.text for r in rows] + [rows[3].text, rows[3].text, " ".join(rows[4].text.split()[3:]), rows[5].text + " and more words", None, "too short"]
    df = spark.createDataFrame(list(enumerate(texts)), "key long, text string")
    got = {r.key: r for r in media.search(media.fingerprints(df, media.rendered(F.col("text"))), F.col("key"), F.col("key") % 3 == 0).collect()}
    prints = [media.fingerprint(media.render(t)) for t in texts]
    pairs = brute(prints)
    assert set(got) == set(range(0, len(texts), 3)) and any(r.n_matches for r in got.values())
    for k, r in got.items():
        found = {j: v for (i, j), v in pairs.items() if i == k and j != k}
        assert r.n_matches == len(found)
        if found:
            best = min((share, j, offset) for j, (share, offset) in found.items())
            if equal := [j for j in found if prints[j].tolist() == prints[k].tolist()]:
                best = (0, min(equal) if min(equal) < k else max(equal), 0)
            assert (r.match_error, r.match_key, r.match_offset) == (pytest.approx(best[0]), best[1], best[2])


def at_any_offset(a, b):
    least = min(media.MIN_OVERLAP, len(a), len(b))
    for offset in range(least - len(b), len(a) - least + 1):
        bits, n = media.error(a, b, offset)
        if n and bits <= media.MAX_ERROR * 32 * n:
            return True
    return False


def test_recall_against_all_offsets_of_all_pairs():
    rng, rate = np.random.default_rng(7), 4000
    plain = [song(k, rate) for k in range(30)]
    noisy = [x[int(rng.integers(0, 20)) * round(media.HOP * rate) :] for x in plain]
    noisy += [np.clip(x + level * rng.standard_normal(len(x)), -1, 1) for x in plain for level in (0.05, 0.15, 0.3)]
    loops = [np.concatenate([song(k, rate, 6)] * 12) for k in range(40, 50)]
    queries, others = [media.fingerprint(wav(x, rate)) for x in plain + loops], [media.fingerprint(wav(x, rate)) for x in noisy + loops]
    true = {(i, j) for i, a in enumerate(queries) for j, b in enumerate(others) if len(a) and len(b) and at_any_offset(a, b)}
    got = {(q, o) for q, o, _, _ in media.matches(queries, others)}
    assert got <= true and len(true) > 80
    assert len(got) >= 0.95 * len(true), (len(got), len(true))


def test_query(spark, sf_dir):
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    rows = op5_media(spark, sf_dir).collect()
    assert sorted((r.conv_id, r.turn) for r in rows) == sorted((r.conv_id, r.turn) for r in turns.where("conv_id % 100 = 0").collect())


def test_edges(spark):
    good = wav(song(1, 4000), 4000)
    rows = [(1, None, "a"), (2, b"", "a"), (3, b"RIFFnonsense", "a"), (4, wav(song(1, 4000, 3), 4000), "a"), (5, good, "a"), (5, good, "a"), (6, good[:-7], "a"), (None, good, "a")]
    df = spark.createDataFrame(rows, "key long, media binary, fingerprint string")
    prints = media.fingerprints(df, F.col("media"))
    got = sorted((r.key or 0, r.n_matches) for r in media.search(prints.drop("media").withColumns({"best": F.lit(1), "copies": F.lit(2)}), F.col("key"), F.lit(True)).collect())
    assert got[:5] == [(0, 3), (1, 0), (2, 0), (3, 0), (4, 0)] and [x[0] for x in got[5:]] == [5, 5, 6]
    assert media.search(media.fingerprints(df.limit(0), F.col("media")), F.col("key"), F.lit(True)).count() == 0
    silent = media.fingerprint(wav(np.zeros(20_000), 4000))
    assert len(set(silent.tolist())) == 1
