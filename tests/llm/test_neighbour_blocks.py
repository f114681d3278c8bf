"""A block of candidates beside many queries: the same nearest rows whether few or nearly all rows remain candidates."""

import numpy as np
import pytest

from tidemark.llm import neighbours


@pytest.mark.parametrize("spread", [0.0, 40.0])
def test_a_block_answers_all_its_queries_like_brute_force(spread):
    rng = np.random.default_rng(5)
    x = (rng.standard_normal((300, 16)) + spread * rng.integers(0, 8, (300, 1))).astype(np.float32)
    x[7] = x[3]  # a tie
    ids, centre, turn = np.arange(300) * 3, x.astype(float).mean(axis=0), neighbours.rotation(16)
    asked = np.arange(0, 300, 2)
    qi, ci, dist = neighbours.search_block(ids, x, *neighbours.encode(x, centre, turn), ids[asked], x[asked], centre, turn, 5, at_once=32)
    for i, row in enumerate(asked):
        total = np.zeros(300)
        for j in range(16):
            total += (x[:, j].astype(float) - float(x[row, j])) ** 2
        want = [c for c in np.lexsort((ids, np.sqrt(total))) if c != row][:5]
        assert ci[qi == i].tolist() == want and dist[qi == i].tolist() == np.sqrt(total[want]).tolist()
