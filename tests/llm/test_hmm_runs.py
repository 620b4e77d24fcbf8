"""The recursions over slices of texts give what they give over all texts at once."""

import numpy as np

from serialloom.llm.hmm import Segments, boundaries, expected, runs


def test_runs_cover_every_text_and_token_once():
    lens = np.array([3, 1, 500, 2, 2, 2, 90])
    for most in (1, 4, 100, 10**6):
        got = list(runs(lens, most))
        assert [i for t, _ in got for i in range(t.start, t.stop)] == list(range(len(lens)))
        assert [i for _, a in got for i in range(a.start, a.stop)] == list(range(lens.sum()))
        assert all(lens[t].sum() <= most or t.stop - t.start == 1 for t, _ in got)
    assert list(runs(np.zeros(0, np.int64), 5)) == []


def test_sliced_counts_and_likelihoods_equal_whole_ones():
    rng = np.random.default_rng(3)
    lens = rng.integers(1, 400, 40)
    sym = rng.integers(0, 50, lens.sum())
    start, move = rng.dirichlet(np.ones(3)), rng.dirichlet(np.ones(3), 3)
    ratio = rng.uniform(0.2, 3, (50, 3))
    whole = expected(sym, lens, start, move, ratio)
    parts = [expected(sym[a], lens[t], start, move, ratio) for t, a in runs(lens, 700)]
    assert len(parts) > 5
    for k in range(4):
        np.testing.assert_allclose(sum(p[k] for p in parts), whole[k], rtol=1e-9)
    log = boundaries(sym, Segments(lens), start, move, ratio)[2]
    np.testing.assert_allclose(np.concatenate([boundaries(sym[a], Segments(lens[t]), start, move, ratio)[2] for t, a in runs(lens, 700)]), log, rtol=1e-9)
