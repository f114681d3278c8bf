"""Phrases against a plain count, and quotient filters against dictionaries."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from tests.llm.conftest import frame
from tidemark.llm import collocations, quotient


def plain_phrases(rows, least, longest, top):
    """rows: (lang, text)."""
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        folded = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", folded):
            w = re.findall("[^ \t]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                f.update((lang, tuple(w[i:i + k])) for i in range(len(w) - k + 1))
    cand = {key: a for key, a in f.items() if len(key[1]) > 1 and a >= least}
    inside = lambda x, y: any(y[i:i + len(x)] == x for i in range(len(y) - len(x) + 1))
    out = []
    for (lang, p), a in cand.items():
        if any(lang == other and len(q) > len(p) and 100 * b >= 100 * a and inside(p, q) for (other, q), b in cand.items()):
            continue
        cuts = [(1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p))]
        score, k = min(cuts)
        out.append((lang, " ".join(p), a, f[lang, p[:k]], f[lang, p[k:]], n[lang], score))
    ranked = []
    for lang in {r[0] for r in out}:
        mine = sorted((r for r in out if r[0] == lang), key=lambda r: (-r[6], -r[2], r[1].encode()))[:top]
        ranked += [(lang, i, *r[1:]) for i, r in enumerate(mine, 1)]
    return sorted(ranked)


def phrase_rows():
    rng = random.Random(23)
    words = ["New", "york", "city", "is", "a", "a", "x\x01", "x", "é", "the", "of", "state", "\x00", "y"]
    rows = [(rng.choice(["en", "en", "de", "und", None]), "".join(rng.choice(words) + rng.choice([" ", " ", " ", "\t", ", ", ".\n", "\r\n"]) for _ in range(rng.randint(0, 60)))) for _ in range(120)]
    rows += [("en", None), ("en", ""), (None, "  \t\n"), ("fr", "once only"), ("en", "a a a a a a"), ("en", "New York City is " * 400), ("de", "only " * 9), rows[0], rows[0]]
    return rows


@pytest.mark.parametrize("least,longest,top", [(4, 5, 2000), (3, 3, 7), (4, 2, 2000)])
def test_phrases_equal_a_plain_count(spark, monkeypatch, least, longest, top):
    monkeypatch.setattr(collocations, "SHELF_MOST", 900)
    monkeypatch.setattr(collocations, "SHARD_PLACES", 100)
    rows = phrase_rows()
    docs = spark.createDataFrame([(t, lang, 1, "w", 2, 3.0) for lang, t in rows], "text string, lang string, shelf int, word string, n int, f double").repartition(4)
    got = sorted(tuple(r) for r in collocations.mine(docs, least, longest, top).collect())
    assert got == plain_phrases(rows, least, longest, top) and got


def test_phrases_of_the_corpus_and_of_nothing(spark, docs, rows, empty):
    got = sorted(tuple(r) for r in collocations.mine(docs, 6).collect())
    assert got == plain_phrases([("en", t) for _, t in rows], 6, 5, 2000)
    assert collocations.mine(empty).count() == 0
    assert collocations.mine(docs, 10 ** 9).count() == 0
    assert frame(spark, []).count() == 0


@pytest.mark.parametrize("n,bits", [(2, 1), (2, 17), (2, 32), (3, 17), (3, 22), (4, 17), (5, 3), (5, 12), (5, 17), (5, 26), (5, 32)])
def test_filters_lose_nothing(n, bits):
    rng = np.random.default_rng(n * 100 + bits)
    layout = quotient.Layout(n, bits)
    top = min(1 << bits, 40)
    words = [rng.integers((1 << bits) - top, 1 << bits, 6000) for _ in range(n)]
    lanes = layout.permute(layout.pack(words))
    assert (layout.unpack(layout.restore(lanes)) == np.array(words).T).all()
    expected = Counter(zip(*(w.tolist() for w in words)))
    keys, counts, where = quotient.counted(lanes, places=True)
    assert all((keys[j][where] == lanes[j]).all() for j in range(len(lanes)))
    for wanted in (1, 5, 64):
        s = layout.shard_bits(wanted)
        shard = layout.shard(keys, s)
        got = Counter()
        for x in np.unique(shard):
            part = [k[shard == x] for k in keys]
            raw = quotient.dump(layout, part, counts[shard == x] * 300, s)
            again, sums = quotient.merge([quotient.load(layout, raw, int(x), s)] * 3)
            assert all((a == b).all() for a, b in zip(again, part))
            got.update(dict(zip(map(tuple, layout.unpack(layout.restore(again)).tolist()), (sums // 900).tolist())))
        assert got == expected


def test_permuted_keys_spread_evenly():
    layout = quotient.Layout(2, 17)
    a, b = np.divmod(np.arange(40000), 200)  # dense ids
    shards = np.bincount(layout.shard(layout.permute(layout.pack([a, b])), 6), minlength=64)
    assert shards.min() > 450 and shards.max() < 800


def test_ratio_passes_64_bits(spark):
    rng = random.Random(1)
    rows = [(a := rng.randint(100, 10 ** 12), rng.randint(10 ** 12, 2 * 10 ** 13), a + rng.randint(0, 10 ** 6), a + rng.randint(0, 10 ** 12)) for _ in range(200)]
    got = spark.createDataFrame(rows, "a long, n long, l long, r long").select("a", "n", "l", "r", collocations.ratio().alias("s")).collect()
    assert all(r.s == 1000 * r.a * r.n // (r.l * r.r) for r in got)
