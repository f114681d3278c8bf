"""Encoding against the sentencepiece library, and hard negatives against a plain search."""

import math
import random

import pytest
import sentencepiece

from tidemark.llm import negatives, wordpieces
from tests.llm.conftest import frame

EDGES = ["", " ", "  ", "\n", "▁", " ▁ x", "<s> </s> <unk> <0x0A>", "Hello  world  ", "a" * 3000, "\x00\x01 é", "ﬁ ① Ａ é 　x", "漢字  x​"]


def number(n):
    return bytes([n & 127 | 128]) + number(n >> 7) if n > 127 else bytes([n])


def field(n, raw):
    return bytes([n << 3 | 2]) + number(len(raw)) + raw


def plain_model():
    with open(wordpieces.model_path(), "rb") as f:
        return f.read()


def mapped_model(rule, squeeze):
    """The same pieces with a compiled character map; a message's fields may be given again at its end."""
    proto = sentencepiece.SentencePieceNormalizer(rule_name=rule).serialized_model_proto()
    blob = next(v for n, value in wordpieces._fields(proto) if n == 3 for m, v in wordpieces._fields(value) if m == 2)
    return plain_model() + field(3, field(2, blob) + bytes([3 << 3, 1, 4 << 3, squeeze, 5 << 3, 1]))


def strange_texts(n):
    rng = random.Random(5)
    letters = " " * 6 + "\n\t▁aeiouthn.,éß中文😀ﬁ①Ａ́ 　\x00\x01<>s/"
    return EDGES + ["".join(rng.choice(letters) for _ in range(rng.randint(1, 60))) for _ in range(n)]


@pytest.mark.parametrize("raw", [plain_model(), mapped_model("nmt_nfkc", 0), mapped_model("nmt_nfkc", 1), mapped_model("nfkc_cf", 1)], ids=["plain", "nfkc", "nfkc-squeezed", "folded-squeezed"])
def test_pieces_spans_and_text_equal_the_library(raw):
    model, library = wordpieces.PieceModel(raw), sentencepiece.SentencePieceProcessor(model_proto=raw)
    for text in strange_texts(400):
        ids, starts, ends = model.encode(text)
        pieces = library.encode(text, return_type="proto").pieces
        assert (ids.tolist(), starts.tolist(), ends.tolist()) == ([p.id for p in pieces], [p.begin for p in pieces], [p.end for p in pieces]), text
        assert model.decode(ids.tolist()) == library.decode(ids.tolist())


def test_decoding_any_ids_equals_the_library():
    model, library, rng = wordpieces.PieceModel(plain_model()), sentencepiece.SentencePieceProcessor(model_file=wordpieces.model_path()), random.Random(3)
    for _ in range(3000):
        ids = [rng.choice([0, 1, 2, rng.randint(3, 258), rng.randint(259, 31999), 28705]) for _ in range(rng.randint(0, 9))]
        assert model.decode(ids) == library.decode(ids)


def test_documents_encode_and_decode(spark, docs, rows, empty):
    library = sentencepiece.SentencePieceProcessor(model_file=wordpieces.model_path())
    encoded = wordpieces.encode(docs)
    got = sorted((repr(r.doc_id), list(r.ids)) for r in encoded.collect())
    assert got == sorted((repr(i), library.encode(t or "")) for i, t in rows)
    texts = sorted((repr(r.doc_id), r.text) for r in wordpieces.decode(encoded).collect())
    assert texts == sorted((repr(i), library.decode(library.encode(t or ""))) for i, t in rows)
    for r in encoded.where("size(ids) > 0").limit(20).collect():
        assert list(r.starts) == sorted(r.starts) and r.ends[-1] == max(r.ends) and all(a <= b for a, b in zip(r.starts, r.ends))
    assert wordpieces.decode(wordpieces.encode(empty)).count() == 0


VECTORS = "vec_id long, embedding array<float>, label int, block int, `group` string, ids string, v double, id string, anchor_ids int"


def vector_rows(n=900, d=8):
    rng = random.Random(17)
    rows = []
    for i in range(n):
        v = [rng.choice([-0.5, -0.25, 0.0, 0.25, 0.5]) if i % 3 else rng.gauss(0, 0.3) for _ in range(d)]  # many ties
        rows.append((i, v, i % 4 if i % 5 else 0))
    rows += [(None, rows[1][1], 1), (n, None, 1), (n + 1, [1.0, None] + [0.0] * (d - 2), 1), (n + 2, [float("nan")] * d, 1), (n + 3, [float("inf")] * d, 1), (n + 4, rows[2][1], None),
             (n + 5, [1.0], 2), (n + 6, [], 2), (n + 7, [0.0] * d, 2), rows[50], rows[51], (1000, rows[10][1], 99), (n + 8, [500.0] * d, 3)]
    return rows


def plain_mine(rows, d=8):
    ok = [(i, label, [math.floor(256 * float(x)) for x in v]) for i, v, label in rows
          if i is not None and label is not None and v is not None and len(v) == d and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a in sorted({i for i, _, _ in ok if i % 50 == 0}):
        label, q = min((lab, v) for i, lab, v in ok if i == a)
        scored = sorted((-sum(x * y for x, y in zip(q, v)), i, lab) for i, lab, v in ok if i != a)
        for s, p, _ in [x for x in scored if x[2] == label][:5]:
            fits = [(-t, i) for t, i, lab in scored if lab != label and 50 * -s <= 100 * -t <= 95 * -s][:3]
            out += [(a, p, r, i, -s, t) for r, (t, i) in enumerate(fits, 1)]
    return out


def test_negatives_equal_a_plain_search(spark, monkeypatch):
    monkeypatch.setattr(negatives, "BLOCK", 200)
    monkeypatch.setattr(negatives, "ANCHOR_BLOCK", 4)
    frame_ = spark.createDataFrame([(*r, 1, "g", "x", 0.5, "y", 2) for r in vector_rows()], VECTORS).repartition(5)
    rounded = [  # as 32-bit numbers
        (r.vec_id, r.embedding, r.label) for r in frame_.collect()]
    got = negatives.mine(frame_, lambda i: i % 50 == 0).collect()
    assert sorted(map(tuple, got)) == sorted(plain_mine(rounded)) and got


def test_negatives_of_nothing_and_of_one_label(spark):
    nothing = spark.createDataFrame([], VECTORS)
    assert negatives.mine(nothing, lambda i: i % 50 == 0).count() == 0
    one = spark.createDataFrame([(i, [1.0, float(i)], 1) for i in range(60)], "vec_id long, embedding array<float>, label int")
    assert negatives.mine(one, lambda i: i % 50 == 0).count() == 0


def test_thresholds_stop_reading_and_products_stay_exact():
    import numpy as np
    big = np.array([[1 << 40, 3], [5, 1 << 40]], np.int64)
    assert negatives.product(big, np.array([1 << 40, -1], np.int64)).tolist() == [(1 << 80) - 3, (5 << 40) - (1 << 40)]
    rng = np.random.default_rng(2)
    x = rng.integers(-9, 9, (4000, 2))
    x[7] = [90, 90]
    lists = negatives.Lists(np.arange(4000), np.zeros(4000, np.int64), x)
    q = np.array([3, 2])
    limits, steps = lists.thresholds(q[None])[0], 0
    for limit, (new, scores) in zip(limits, lists.read(q)):
        steps += 1
        if limit < (x @ q).max():
            break
    assert steps < len(lists.depths) and negatives.positives_in(lists, -1, q, limits, 1)[0].tolist() == [7]
