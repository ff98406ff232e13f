"""What ``prepare`` sets for Python workers."""
import pyarrow as pa

from memweave.session import prepare


def test_workers_give_back_what_they_free(spark):
    def run(batches):
        import numpy as np

        def held() -> int:
            with open("/proc/self/status") as f:
                return next(int(line.split()[1]) for line in f if line.startswith("RssAnon")) >> 10
        for _ in batches:
            del _
        for mb in (12, 16, 20, 24, 28):
            np.ones(mb << 17)                              # freed at once: an allocator that adapts keeps such arrays from here on
        before = held()
        arrays, small = [], []
        for _ in range(20):
            arrays.append(np.ones(8 << 17))
            small.append(np.ones(64))                      # lies above the array, so that the heap's end cannot fall
        del arrays
        yield pa.RecordBatch.from_arrays([pa.array([held() - before]), pa.array([pa.default_memory_pool().backend_name])],
                                         names=["mb", "pool"])
    row = prepare(spark, give_back=True).range(1).repartition(1).mapInArrow(run, "mb long, pool string").first()
    assert row["mb"] < 40 and row["pool"] == "system"
