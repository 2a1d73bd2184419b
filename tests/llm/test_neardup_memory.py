"""Memory of the near-duplicate signatures."""

from __future__ import annotations

import tracemalloc

import numpy as np
import pyarrow as pa

from mercato.llm import neardup


def _sets(lengths):
    values = np.random.default_rng(3).integers(-2**62, 2**62, sum(lengths))
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, pa.int64()))


def test_signatures_hold_no_batch_of_work():
    sets = _sets([300] * 4000)      # 9.6 MB of hashes
    tracemalloc.start()
    neardup.signatures(sets)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40e6              # was 81 MB when a batch was worked on at once


def test_signatures_do_not_depend_on_the_step(monkeypatch):
    sets = _sets([0, 3, 0, 0, 40, 1, 700, 0, 5, 2, 0])
    at_once = neardup.signatures(sets).to_pylist()
    for step in (1, 7, 64):
        monkeypatch.setattr(neardup, "STEP", step)
        assert neardup.signatures(sets).to_pylist() == at_once
        assert neardup.signatures(sets[3:9]).to_pylist() == at_once[3:9]
    assert neardup.signatures(_sets([0, 0])).to_pylist() == [{"set_key": None, "bands": []}] * 2
