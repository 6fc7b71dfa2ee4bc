"""Side tables: what a scan of documents needs to know of its rows, found by the rows' identity.

A side table is written in one file for each part of the documents (rows of one file whose
numbers share the upper bits), and the task that reads a part of the documents reads
that file.  So no text is moved, however the documents are dealt to tasks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kept_by

#: Lower bits of an identity that the rows of a part differ in.
PART_BITS = 14


def by_part(df: DataFrame, name: str) -> str:
    """Write df (uid, ...) in one file for each part of the documents, where the task that reads a part finds it."""
    return kept_by(df.withColumn("part", F.shiftright("uid", PART_BITS)), "part", name)


class Part:
    """Rows of a batch that lie in one part, and what its side tables hold."""

    def __init__(self, number: int, batch: pa.RecordBatch, paths: tuple[str, ...]):
        self.number, self.batch, self.tables = number, batch, [self._read(f"{p}/{number}.parquet") for p in paths]
        self._by_uid: dict[int, list[int]] | None = None
        self.memo: dict[str, object] = {}  # what a reader makes of the tables once

    @staticmethod
    def _read(path: str) -> pa.Table | None:
        store, file = fs.FileSystem.from_uri(path)
        return None if store.get_file_info(file).type == fs.FileType.NotFound else pq.read_table(file, filesystem=store)

    @property
    def uid(self) -> list[int]:
        return self.batch.column(0).to_pylist()

    def rows(self, column: str, k: int = 0) -> dict[int, list[int]]:
        """Row numbers of a side table by a column's value."""
        if self._by_uid is None:
            self._by_uid = {}
            for r, u in enumerate(self.tables[k].column(column).to_pylist() if self.tables[k] is not None else ()):
                self._by_uid.setdefault(u, []).append(r)
        return self._by_uid


class Side:
    """Side tables of the documents, read part by part as a scan goes on; the last part stays."""

    def __init__(self, *paths: str):
        self.paths, self.last = paths, None

    def parts(self, batch: pa.RecordBatch):
        """The batch (uid first) by parts."""
        number = np.asarray(batch.column(0)) >> PART_BITS
        edge = np.flatnonzero(np.r_[True, number[1:] != number[:-1], True]) if len(number) else np.zeros(1, int)
        for a, z in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
            if self.last is None or self.last.number != number[a]:
                self.last = None
                self.last = Part(int(number[a]), batch, self.paths)
            self.last.batch = batch.slice(a, z - a)
            yield self.last
