"""A small corpus with every awkward case: nulls, empty, blank and very long texts, ties, repeated rows, copies of all
kinds, and columns whose names the operators use themselves."""

import random

import pytest

SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, batch int, __batch int, part string, words string, hash string, "
          "n int, class string, band string, score string, length int, rank int, shard int, id string, h string, d string")
SYLLABLES = "th er on an re he in ed nd ha at en es of or nt ea ti to it st io le is ou ar as de rt ve".split()


def _word(rng):
    return "".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 4)))


def corpus():
    rng = random.Random(11)

    def prose(n):
        return " ".join(_word(rng) + rng.choice(["", "", "", ",", ".", ".\n"]) for _ in range(n))

    passage = prose(70)
    line = " ".join(_word(rng) for _ in range(14))
    texts = [prose(rng.randint(20, 220)) for _ in range(40)]
    texts += [texts[3], texts[3], texts[5]]
    for i in (7, 8, 9, 9, 9):  # near copies: one or two words changed
        w = texts[i].split(" ")
        w[rng.randrange(len(w))] = "changed"
        texts.append(" ".join(w))
    texts += [f"{prose(30)} {passage} {prose(25)}" for _ in range(5)]
    texts += [f"{prose(20)}\n{line}\n{prose(20)}" for _ in range(6)] + [f"{prose(15)}\n{line} extra\n{prose(20)}", f"{line}\n{line}\n{line}"]
    texts += [None, "", " \n\t ", "one", "One two three", "one two three", "é ü ß 漢字 " * 30, "é ü ß 漢字 " * 30, "a " * 400, "\n\n\n", "x" * 3000, "x" * 2000]
    texts += [" ".join(_word(rng) for _ in range(9000)) + "\n" + texts[10], texts[20].upper(), "Mixed\r\nline ends\r\n" + prose(12)]
    ids = list(range(100, 100 + len(texts)))
    rng.shuffle(ids)
    rows = list(zip(ids, texts))
    rows += [rows[0], rows[0], (rows[1][0], "another text under the same id " + prose(20)), (None, texts[4]), (None, prose(30)), (None, None)]
    return rows


@pytest.fixture(scope="session")
def rows():
    return corpus()


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), 1, 2, "p", "w", "h", 3, "c", "b", "0.5", 4, 5, 6, "x", "y", "z") for i, t in rows], SCHEMA)


@pytest.fixture(scope="session")
def docs(spark, rows):
    return frame(spark, rows).repartition(5).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return frame(spark, [])
