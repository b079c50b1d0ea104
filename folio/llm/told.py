"""Numbers told to the parts of a table, without moving the table's rows.

A part is what one task wrote of a stored table; its rows carry its number. What a part is told is a
table of its own folder in the shared folder, which the task that later reads the part's rows opens.
So each task holds only what concerns its rows, and neither the driver nor a broadcast holds any. The
shared folder must be one that pyarrow opens: a path, or a URI of HDFS, S3 or GCS.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.session import shared_dir

#: What the part looked at last was told, by folder: rows of a part follow each other.
_last: dict[str, np.ndarray] = {}


def _read(folder: str) -> np.ndarray:
    """The sorted numbers in a part's folder; none where nothing was told."""
    if folder not in _last:
        files, path = fs.FileSystem.from_uri(folder)
        found = [f.path for f in files.get_file_info(fs.FileSelector(path, allow_not_found=True)) if f.path.endswith(".parquet")]
        told = [pq.ParquetFile(f, filesystem=files).read(["n"])["n"].to_numpy() for f in found]
        _last.clear()
        _last[folder] = np.unique(np.concatenate(told)) if told else np.empty(0, np.int64)
    return _last[folder]


class Told:
    """``numbers`` has columns part int and n long; repeated rows count once."""

    def __init__(self, numbers: DataFrame, name: str):
        self.path = f"{shared_dir(numbers.sparkSession)}/folio-{name}-{uuid.uuid4().hex}"
        fs.FileSystem.from_uri(self.path)  # an error here and not in the tasks
        numbers.repartition("part").write.partitionBy("part").option("compression", "zstd").parquet(self.path)

    def column(self, part: str, n: str) -> Column:
        """Was the part told of the number?"""
        path = self.path

        @F.arrow_udf("boolean")
        def told(parts: pa.Array, numbers: pa.Array) -> pa.Array:
            parts, numbers = (x.to_numpy(zero_copy_only=False) for x in (parts, numbers))
            found = np.zeros(len(parts), bool)
            for p in np.unique(parts).tolist():
                own, known = parts == p, _read(f"{path}/part={p}")
                at = np.minimum(np.searchsorted(known, numbers[own]), max(0, len(known) - 1))
                found[own] = known[at] == numbers[own] if len(known) else False
            return pa.array(found)

        return told(part, n)
