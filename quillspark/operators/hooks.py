"""What runs inside Python workers around a caller's model: one load per worker, failing rows singled out."""

from __future__ import annotations

import gc
import sys
import types
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle

# Python workers get these functions by value, so they need not import this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

KEPT_MODELS = 4  # models that a worker holds at once
SLICE_BYTES = 4 << 20  # text of one call
SWEPT_BYTES = 16 << 20  # text between two sweeps


def worker_model(token: str, load: Callable):
    """``load()`` of the hook named ``token``, once per Python worker process.

    Spark reuses a worker for many tasks, each of which gets its functions anew; what has to
    outlive a task therefore hangs on an entry of ``sys.modules``. The oldest model goes when a
    worker has served more than ``KEPT_MODELS`` hooks.
    """
    held = sys.modules.setdefault("_held_models", types.ModuleType("_held_models")).__dict__.setdefault("models", {})
    if token not in held:
        while len(held) >= KEPT_MODELS:
            del held[next(iter(held))]
        held[token] = load()
    return held[token]


def slices(batches: Iterable[pa.RecordBatch], text: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches in slices with at most ``most`` bytes of text each, one row at least."""
    for batch in batches:
        size = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        ends, at = np.cumsum(size, dtype=np.int64), 0
        while at < batch.num_rows:
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + most, side="right")))
            yield batch.slice(at, to - at)
            at = to


def swept(batches: Iterable[pa.RecordBatch], text: str, most: int = SWEPT_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches, with a collection of cyclic garbage after every ``most`` bytes of text.

    A pandas column whose ``.str`` was used refers to itself, so a model's columns stay in memory until
    a collection. Python starts one after many new objects, however large they are: a few columns
    of thousands of texts each would pile up through a whole task.
    """
    since = 0
    for batch in batches:
        size = max(1, batch.column(text).nbytes)
        yield batch
        del batch
        since += size
        if since >= most:
            gc.collect()
            since = 0


def answers(fn: Callable[[pd.Series, pd.Series], pd.Series], texts: pd.Series,
            hints: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """Answer and error per row; one of both is None.

    A batch that fails is cut in halves until the failing rows stand alone, so a bad row among n costs
    about 2 log2 n further calls. An answer of another length than the batch is a failure too.
    """
    got, errors = (np.full(len(texts), None, dtype=object) for _ in range(2))
    todo = [(0, len(texts))] if len(texts) else []
    while todo:
        start, stop = todo.pop()
        try:
            said = list(fn(texts.iloc[start:stop], hints.iloc[start:stop]))
            if len(said) != stop - start:
                raise ValueError(f"{len(said)} answers to {stop - start} texts")
            got[start:stop] = said
        except Exception as exc:
            if stop - start == 1:
                errors[start] = f"{type(exc).__name__}: {exc}"
            else:
                half = (start + stop) // 2
                todo += [(half, stop), (start, half)]
    return got, errors
