"""How much a search for stated items hashes."""

from __future__ import annotations

import numpy as np
import pytest

from strandline.llm import contamination


@pytest.mark.parametrize("part", [contamination.PART, 1 << 10])
def test_a_document_is_sketched_once_and_only_for_items_that_it_may_hold(monkeypatch, part):
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in rng.integers(0, 10**9, 4000)]
    items = [" ".join(words[a : a + n]) for a, n in ((100, 12), (900, 30), (2000, 60), (3000, 120))]
    index = contamination.build(list(range(4)), items, 5, 32)
    hashed = []
    mix = contamination.mix
    monkeypatch.setattr(contamination, "mix", lambda x: hashed.append(np.size(x)) or mix(x))
    monkeypatch.setattr(contamination, "PART", part)
    run = contamination.hashes(" ".join(words), 5)
    assert contamination.matches(run, index, 75) == [(i, n - 4, n - 4) for i, n in enumerate((12, 30, 60, 120))]
    assert sum(hashed) == 32 * len(run)
    hashed.clear()
    # one shingle of an item isn't 75 percent of any
    assert contamination.matches(contamination.hashes(" ".join([*words[102:107], *words[3500:3900]]), 5), index, 75) == []
    assert not hashed
