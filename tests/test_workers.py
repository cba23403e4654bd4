import numpy as np
import pyarrow as pa
import pytest

from orrery.plans import workers


def held_after(spark, run):
    """The most bytes of its own that a worker has at the start of a second stage, after one of `run`."""

    def look(batches):
        for _ in batches:
            yield pa.RecordBatch.from_arrays([pa.array([workers.own_bytes()])], ["n"])

    spark.range(0, 8, 1, 4).mapInArrow(run, "n long").collect()
    return max(r["n"] for r in spark.range(0, 8, 1, 4).mapInArrow(look, "n long").collect())


@pytest.mark.skipif(not workers.own_bytes(), reason="needs /proc")
def test_a_stage_leaves_its_workers_small(spark):
    """Many freed small blocks below one that stays are not returned by the C library itself."""

    def run(batches):
        import builtins

        for b in batches:
            many = [bytes(8000) for _ in range(40_000)]
            builtins.pin = bytes(8000)
            del many
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(b.num_rows))], ["n"])

    assert held_after(spark, workers.released(run)) < 200 << 20


def test_released_passes_every_batch(monkeypatch):
    monkeypatch.setattr(workers, "SPARE", -1)
    batches = [pa.RecordBatch.from_arrays([pa.array([k])], ["n"]) for k in range(3)]
    assert list(workers.released(lambda found: (b for b in found))(iter(batches))) == batches
    with pytest.raises(ZeroDivisionError):
        list(workers.released(lambda found: (1 // 0 for _ in found))(iter(batches)))
