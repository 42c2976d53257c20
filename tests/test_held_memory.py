"""What a stream holds of a key, and what scoring it takes, stay near the size of its readings."""

import tracemalloc

import numpy as np
import pandas as pd

from wattloom.streaming import live


class Watermark:
    def getCurrentWatermarkMs(self):
        return 0


def test_held_readings_are_packed():
    n = 200_000
    us = np.random.default_rng(1).permutation(n).astype("int64") + 1
    batches = [pd.DataFrame({"_us": us[i : i + 10_000], "_v": us[i : i + 10_000] / 2}) for i in range(0, n, 10_000)]
    *_, kept = live._due(iter(batches), (b"", b""), 0, Watermark(), True)
    assert sum(map(len, kept)) == 16 * n
    times, values = np.frombuffer(kept[0], "int64"), np.frombuffer(kept[1], "float64")
    assert (times == np.arange(1, n + 1)).all() and (values == times / 2).all()
    # held ones come first among equal times, and those not after the last one are late
    got = live._due(iter([pd.DataFrame({"_us": [3, 2, 1], "_v": [9.0, 8.0, 7.0]})]), (times[:3].tobytes(), values[:3].tobytes()), 1, Watermark(), False)
    assert got[0].tolist() == [2, 2, 3, 3] and got[1].tolist() == [1.0, 8.0, 1.5, 9.0]


def test_scores_take_bounded_memory():
    values = np.random.default_rng(2).integers(0, 900, 500_000).astype("float64")
    tracemalloc.start()
    try:
        scores = live._risks(values, 200.0)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 100e6
    at = 100_000 + 7
    assert (scores[at : at + 30] == live._risks(values[at - 19 : at + 30], 200.0)[19:]).all()
