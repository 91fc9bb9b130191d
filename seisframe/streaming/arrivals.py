"""Traces of files as they arrive in a folder, as a stream.

An extra beyond the survey operators: each new file becomes rows of
(path, trace_idx, iline, xline, samples).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .. import codec, spec


def read_stream(spark: SparkSession, folder: str, iline: int = spec.ILINE, xline: int = spec.XLINE, pattern: str = "*.sgy") -> DataFrame:
    """Files must fit a task's memory; larger ones are read by range with ``sources.segy.load``."""
    files = spark.readStream.format("binaryFile").option("pathGlobFilter", pattern).schema("path string, modificationTime timestamp, length bigint, content binary").load(folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                raw = np.frombuffer(content, dtype=np.uint8)
                head = raw[spec.TEXT_BYTES : spec.PREAMBLE][None]
                nt, code = int(codec.field(head, 21, 2)[0]) & 0xFFFF, int(codec.field(head, 25, 2)[0])
                record = spec.TRACE_BYTES + nt * codec.element_size(code)
                n = (len(raw) - spec.PREAMBLE) // record
                rows = raw[spec.PREAMBLE : spec.PREAMBLE + n * record].reshape(n, record)
                heads = rows[:, : spec.TRACE_BYTES]
                values = codec.decode_samples(rows[:, spec.TRACE_BYTES :], code)
                samples = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * nt), pa.array(values.ravel()))
                keys = [pa.array(codec.field(heads, loc, 4).astype(np.int32)) for loc in (iline, xline)]
                yield pa.RecordBatch.from_arrays([pa.array([path] * n), pa.array(np.arange(n)), *keys, samples], names=["path", "trace_idx", "iline", "xline", "samples"])

    return files.select("path", "content").mapInArrow(run, "path string, trace_idx bigint, iline int, xline int, samples array<float>")
