"""Blocks of an index, sent to the executors a few at a time, and the parts of a batch that are held against them."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.shared import written

def slices(batch: pa.RecordBatch, text: str, chars: int, rows: int) -> Iterator[pa.RecordBatch]:
    """A batch in parts of about ``chars`` characters of the column ``text``, and ``rows`` rows at most."""
    sizes = pc.fill_null(pc.utf8_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    part = np.cumsum(sizes) // chars + np.arange(batch.num_rows) // rows
    edges = [*np.flatnonzero(np.diff(part, prepend=-1)).tolist(), batch.num_rows]
    for at, end in zip(edges, edges[1:], strict=False):
        yield batch.slice(at, end - at)


#: The block that this process has unpacked last, for the tasks that it runs one after the other.
_LAST: dict[tuple[str, int], Any] = {}


class Sent:
    """Blocks that the executors have on disk; a process holds one of them at a time."""

    def __init__(self, parts: list, load: Callable[[bytes], Any]) -> None:
        self.parts, self.load, self.name = parts, load, uuid.uuid4().hex

    def __len__(self) -> int:
        return len(self.parts)

    def __getitem__(self, k: int) -> Any:
        if not 0 <= k < len(self.parts):
            raise IndexError(k)
        key = self.name, k
        if key not in _LAST:
            _LAST.clear()
            _LAST[key] = self.load(bytes(self.parts[k].value))
            self.parts[k].__dict__.pop("_value", None)  # else a task would come to hold all blocks
        return _LAST[key]


def in_passes(blocks: DataFrame, per_pass: int, load: Callable[[bytes], Any], run: Callable[[Sent], DataFrame], name: str) -> DataFrame | None:
    """The rows of ``run`` over all ``blocks`` (block, data), at most ``per_pass`` of them at a time; None without blocks.

    The driver reads one block after the other and broadcasts it.  If one pass doesn't do, the rows of each are written and its
    blocks given up before the next one begins, so neither driver nor executors ever have more than ``per_pass`` blocks.
    """
    numbers = sorted(r[0] for r in blocks.select("block").collect())
    out = None
    for first in range(0, len(numbers), per_pass):
        chosen = blocks.where(F.col("block").isin(numbers[first : first + per_pass])).select("data")
        sent = Sent([blocks.sparkSession.sparkContext.broadcast(r[0]) for r in chosen.toLocalIterator()], load)
        found = run(sent)
        if len(numbers) > per_pass:
            found = written(found, name)
            for part in sent.parts:
                part.destroy()
        out = found if out is None else out.unionByName(found)
    return out
