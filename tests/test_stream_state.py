"""What filters on streams keep and touch, without Spark."""

import pickle

import numpy as np
from pyspark.sql import Row

from sparkwave.streaming import signals as streaming


class Kept:
    """A handle's states in memory; counts calls."""

    def __init__(self):
        self.value, self.map, self.calls = None, {}, 0

    def getValueState(self, name, schema):
        return self

    def getMapState(self, name, key, schema):
        return Entries(self)

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value


class Entries:
    def __init__(self, kept):
        self.kept = kept

    def getValue(self, k):
        self.kept.calls += 1
        return self.kept.map.get(k)

    def containsKey(self, k):
        self.kept.calls += 1
        return k in self.kept.map

    def updateValue(self, k, v):
        self.kept.calls += 1
        self.kept.map[k] = v

    def removeKey(self, k):
        self.kept.calls += 1
        del self.kept.map[k]

    def keys(self):
        return iter(self.kept.map)


def run(batches):
    kept, out = Kept(), {}
    worker = streaming._InOrder(lambda: streaming.Comb(1.0, 1), ("x",), None, None)
    worker.init(kept)
    for batch in batches:
        for r in worker.handleInputRows((1, 0), iter([Row(clip_id=1, channel=0, idx=i, x=x) for i, x in batch]), None):
            out |= {r["first"] + k: y for k, y in enumerate(r["y"])}
    return kept, out


def test_early_rows_are_held_in_blocks():
    rng = np.random.default_rng(1)
    x, order = rng.normal(0, 1, 4000), rng.permutation(4000)
    kept, out = run([[(int(i), float(x[i])) for i in part] for part in np.array_split(order, 4)])
    np.testing.assert_allclose([out[i] for i in range(4000)], np.cumsum(x), atol=1e-9)
    assert len(out) == 4000 and not kept.map and kept.calls < 200


def test_a_held_row_that_comes_again_with_those_before_it_is_not_kept():
    kept, out = run([[(3, 1.0)], [(0, 1.0), (1, 1.0), (2, 1.0), (3, 5.0), (7, 1.0)], [(4, 1.0), (5, 1.0), (6, 1.0)]])
    assert [out[i] for i in range(8)] == [1, 2, 3, 8, 9, 10, 11, 12]
    assert not kept.map and kept.value[:2] == (8, 0)


def test_the_state_of_a_short_clip_is_small():
    x = np.random.default_rng(4).normal(0, 0.3, 3000)
    voice, whole = streaming.StreamVocoder(1.2), streaming.StreamVocoder(1.2).run(x)
    parts = []
    for k, part in enumerate(np.split(x, [20, 300, 1500])):
        parts.append(voice.run(part))
        data = pickle.dumps(voice)
        assert k or len(data) < 2000
        voice = pickle.loads(data)
    np.testing.assert_allclose(np.concatenate(parts), whole, atol=1e-12)
