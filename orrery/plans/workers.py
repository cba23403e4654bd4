"""Memory of Python workers, which Spark keeps from task to task and from stage to stage.

What a task frees stays with the allocators of its process, so that a worker would go on holding the most that any
stage before has needed, beside what the next one needs.
"""

from __future__ import annotations

import ctypes
import os
from collections.abc import Callable, Iterator

import pyarrow as pa

#: Bytes of its own that a worker may keep after a task.
SPARE = 96 << 20


def own_bytes() -> int:
    """Resident bytes of this process without mapped files; 0 where the system doesn't say."""
    try:
        with open("/proc/self/statm") as f:
            resident, shared = map(int, f.read().split()[1:3])
    except OSError:
        return 0
    return (resident - shared) * os.sysconf("SC_PAGE_SIZE")


def give_back() -> None:
    """Return to the system what Arrow's pool and the C library keep of freed memory."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's
    if trim:
        trim(0)


def released(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """`run`, for mapInArrow, and after its last batch a worker of over SPARE bytes gives back what the task has freed."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        if own_bytes() > SPARE:
            give_back()

    return whole
