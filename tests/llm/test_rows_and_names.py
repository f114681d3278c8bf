"""Rows without an id of their own, and carried columns whose names the stages use inside."""

import pytest

from tidemark.llm import decontaminate, minhash

import corpus_pipeline

ITEM = "which of the seven rivers flows north past the old mill town"
TEXTS = [(None, f"before {ITEM} after"), (None, "a clean text with no identity at all"), (None, "another clean text of nobody in particular"), (7, f"{ITEM} once more"), (7, "a clean text that shares its identity"), (8, None), (8, "")]
NAMES = ["__batch", "n_removed", "n_lines", "__id", "_leak", "carried_0", "stage_score", "row_id", "own_key", "n_chars"]


def test_clean_judges_each_row_by_its_own_text(spark):
    docs = spark.createDataFrame(TEXTS, "doc_id long, text string")
    items = spark.createDataFrame([(1, ITEM), (None, "a clean text with no identity at all")], "item_id long, text string")
    got = decontaminate.clean(docs, items).collect()
    assert sorted(map(repr, got)) == sorted(repr(r) for r in docs.collect() if ITEM not in (r.text or ""))


@pytest.mark.parametrize("stage", ["lines", "near_duplicates", "decontamination"])
def test_stages_carry_columns_of_any_name(spark, tmp_path, stage):
    prose = [" ".join(f"w{i * 31 + j}" for j in range(40)) for i in range(4)]
    rows = [(i, t, *(f"{c}-{i}" for c in NAMES[:-1]), len(t)) for i, t in enumerate(prose)] + [(9, f"some {ITEM} here", *(f"{c}-9" for c in NAMES[:-1]), 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"`{c}` string" for c in NAMES[:-1]) + ", n_chars long")
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    made = dict(corpus_pipeline.STAGES)[stage](spark, docs, str(tmp_path))
    assert made.columns == docs.columns
    want = [r for r in rows if stage != "decontamination" or r[0] != 9]
    assert sorted(map(tuple, made.collect())) == sorted(want)


def test_many_unlike_classes_of_one_band_are_all_compared(spark, monkeypatch):
    """A template of which every text changes another fifth of the words: few pairs count, and chains join the rest."""
    monkeypatch.setattr(minhash, "BLOCK", 5)
    monkeypatch.setattr(minhash, "COLUMNS", 100)
    base = [f"t{i}" for i in range(400)]
    rows = []
    for k in range(24):
        words = list(base)
        for j in range(7):  # neighbours k and k + 1 differ in fewer words than others, but for every sixth
            words[(k + k // 6 * 20 + j) * 7 % 400] = f"x{k}_{j}"
        rows.append((k, " ".join(words)))
    rows += [(100 + k, r[1] + " tail") for k, r in enumerate(rows[:5])]
    sets = {i: {tuple(w[j:j + 5]) for j in range(len(w) - 4)} for i, w in ((i, t.split()) for i, t in rows)}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i in sets:
        for j in sets:
            if i < j and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    want = {i: find(i) for i in sets}
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want and len(set(want.values())) > 1
