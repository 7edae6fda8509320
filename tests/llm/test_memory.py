"""Memory of the Python kernels that the pipeline's executors hold: what is traced at the peak, as a multiple of the text."""

import gc
import random
import tracemalloc
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest

from simplicia.llm import bpe, common, jaccard
from simplicia.llm.common import spans


def traced(run):
    """The result and the bytes held at the peak, beyond those held before."""
    tracemalloc.start()
    try:
        before = tracemalloc.get_traced_memory()[0]
        tracemalloc.reset_peak()
        out = run()
        return out, tracemalloc.get_traced_memory()[1] - before
    finally:
        tracemalloc.stop()


def texts(n, size):
    rng = random.Random(3)
    words = ["".join(rng.choices("abcdeé", k=rng.randint(2, 9))) for _ in range(5000)]
    return [" ".join(rng.choices(words, k=size)).encode() for _ in range(n)]


class Kernel:
    """Stands for a table and keeps the function that goes to the tasks."""

    def select(self, *_):
        return self

    def mapInArrow(self, run, schema):
        self.run = run
        return self


def test_profiles_of_long_texts_hold_a_run_at_a_time(spark):
    made = [b"", *texts(400, 1200), b""]
    batch = pa.record_batch([pa.array(range(len(made)), pa.int64()), pa.array([t.decode() for t in made])], names=["doc_id", "text"])
    run = jaccard.profiles(Kernel()).run
    most = 0
    tracemalloc.start()
    rows = []
    for out in run([batch]):
        most = max(most, tracemalloc.get_traced_memory()[1])
        rows += out.column("n_shingles").to_pylist()
    tracemalloc.stop()
    flat, sizes = jaccard.shingle_sets(made)
    assert rows == sizes.tolist()
    assert most < 10 * sum(map(len, made))


def test_encoding_and_decoding_hold_few_times_the_text():
    coder = bpe._coder(bpe.default_vocabulary())
    made = ["", " don't  \n", *(t.decode() for t in texts(300, 1600)), "'", "s"]
    raws = [t.encode() for t in made]
    whole = sum(map(len, raws))
    (ids, borders), held = traced(lambda: coder.encode_texts(raws))
    assert held < 26 * whole
    back, held = traced(lambda: coder.decode_texts(ids, borders))
    assert back == raws and held < 8 * whole
    for i in (0, 1, 2, len(made) - 2, len(made) - 1):
        assert coder.encode(made[i]) == ids[borders[i] : borders[i + 1]].tolist()


@pytest.mark.parametrize("sizes", [[], [0, 0], [3, 0, 200_000, 1, 0], [1] * 70_000])
def test_spans_in_runs(sizes):
    values, sizes = np.arange(300_000), np.array(sizes, np.int64)
    begin = np.arange(len(sizes), dtype=np.int64) % 7
    want = [values[b : b + n] for b, n in zip(begin, sizes, strict=True)]
    assert np.array_equal(spans(values, begin, sizes), np.concatenate([np.zeros(0, np.int64), *want]))


def test_driver_keeps_no_coder(spark):
    """The broadcast is all that is left of it; the coder and what its making took stayed with the driver before."""
    out = bpe.encoded(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), bpe.default_vocabulary(), ["doc_id"])
    gc.collect()
    assert not any(isinstance(x, bpe.PrefixCoder) for x in gc.get_objects())
    assert out.collect()[0].round_trip


@pytest.mark.parametrize("grown, runs", [(300, 0), (600, 1)])
def test_storing_collects_a_grown_heap_of_the_driver(spark, monkeypatch, grown, runs):
    """Once for tables stored shortly after each other, and not while the heap is far from its bound."""
    done = []
    heap = SimpleNamespace(totalMemory=lambda: grown, maxMemory=lambda: 1000)
    jvm = SimpleNamespace(java=SimpleNamespace(lang=SimpleNamespace(Runtime=SimpleNamespace(getRuntime=lambda: heap))), System=SimpleNamespace(gc=lambda: done.append(1)))
    monkeypatch.setattr(common, "_TIDIED", [float("-inf")])
    monkeypatch.setattr(spark.sparkContext, "_jvm", jvm)
    for _ in range(3):
        common.tidied(spark)
    assert len(done) == runs
