"""Spark data sources ``segy`` and ``rawvol``: reading and writing by record ranges.

    spark.read.format("segy").option("mode", "traces").load(path)

Modes: ``traces`` (keys, raw header, samples), ``headers`` (keys, raw header,
decoded header), ``keys`` (keys only), ``binary`` (the binary header, one row)
and ``textual`` (40 rows). The options ``first``, ``end``, ``index`` and
``lines`` (first record, records of a line, distance of lines, number of lines)
choose records before a task is planned, ``t0`` and ``t1`` samples. Of long
records only the bytes that the mode and these options need are read. They are
options and not pushed filters, as Spark keeps what one query pushed into a
Python source for the next query over the same DataFrame.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from .. import spec

#: Bytes of records for an input partition, and for an Arrow batch.
PARTITION_BYTES, BATCH_BYTES = 64 << 20, 4 << 20
#: Records are read in parts if that skips at least so many bytes of each.
SKIP = 4096


def _keys(options: dict) -> list[tuple[str, int, int]]:
    """(column, location, code) of the bound keys and of the option ``keys=name:loc[:code],...``."""
    bound = [("iline", "iline", spec.ILINE), ("xline", "xline", spec.XLINE), ("offset", "offset", spec.OFFSET), ("x_coord", "xloc", spec.X_COORD), ("y_coord", "yloc", spec.Y_COORD)]
    out = []
    for column, option, default in bound:
        loc = int(options.get(option, default))
        if loc <= 0:
            raise ValueError(f"{option} must be positive")
        out.append((column, loc, 4))
    for item in filter(None, options.get("keys", "").split(",")):
        name, loc, *code = item.split(":")
        known = spec.TRACE_AT.get(int(loc))
        if not code and known is None:
            raise ValueError(f"location {loc} is no field; give a length code")
        out.append((name, int(loc), int(code[0]) if code else known.code))
    return out


def _struct(table: tuple[spec.Field, ...]) -> str:
    return ", ".join(f"`{f.name}`: {f.spark}" for f in table)


def _header_arrays(headers, table):
    """Arrow arrays of all fields of header bytes (n, size)."""
    import numpy as np
    import pyarrow as pa

    out = []
    for f in table:
        raw = np.ascontiguousarray(headers[:, f.loc - 1 : f.loc - 1 + f.size])
        if f.opaque:
            out.append(binary_rows(raw))
        else:
            values = raw.view(f.numpy)[:, 0]
            out.append(pa.array(values.astype(values.dtype.newbyteorder("=") if f.code != 1 else np.int16)))
    return out


@dataclass
class Span(InputPartition):
    """Records first..last of a file, and as many again ``stride`` records on, ``lines`` times altogether."""

    first: int
    last: int
    stride: int = 0
    lines: int = 1


def read_records(f, record: int, parts: list[tuple[int, int]], first: int, n: int):
    """Bytes (n, ...) of the parts (start, end) of n records; the gaps between parts are not read if they are long."""
    import numpy as np

    if record - sum(b - a for a, b in parts) < SKIP:
        rows = np.frombuffer(f.read_at(n * record, spec.PREAMBLE + first * record), dtype=np.uint8).reshape(n, record)
        return np.concatenate([rows[:, a:b] for a, b in parts], axis=1) if len(parts) > 1 else rows[:, parts[0][0] : parts[0][1]]
    at = range(spec.PREAMBLE + first * record, spec.PREAMBLE + (first + n) * record, record)
    return np.frombuffer(b"".join(f.read_at(b - a, k + a) for k in at for a, b in parts), dtype=np.uint8).reshape(n, -1)


def binary_rows(rows):
    """An Arrow array of equally long byte rows, without a Python object for each."""
    import numpy as np
    import pyarrow as pa

    n, size = rows.shape
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.arange(n + 1, dtype=np.int32) * np.int32(size)), pa.py_buffer(np.ascontiguousarray(rows))])


def write_records(fd: int, index, rows, record: int, base: int) -> None:
    """Write byte rows at their records, a run of neighbours at once."""
    import numpy as np

    order = np.argsort(index, kind="stable")
    index, rows = index[order], np.ascontiguousarray(rows[order])
    cuts = [0, *(np.flatnonzero(np.diff(index) != 1) + 1).tolist(), len(index)]
    for a, b in zip(cuts, cuts[1:]):
        data, at = memoryview(rows[a:b]).cast("B"), base + int(index[a]) * record
        while len(data):
            done = os.pwrite(fd, data, at)
            data, at = data[done:], at + done


def _schema_of(options: dict) -> str:
    mode = options.get("mode", "traces")
    if mode == "textual":
        return "line_no int, text string"
    if mode == "binary":
        return ", ".join(f"`{f.name}` {f.spark}" for f in spec.BINARY) + ", raw_header binary"
    keys = "".join(f", `{name}` {spec.SPARK.get(code, 'bigint')}" for name, _, code in _keys(options))
    if mode == "keys":
        return f"trace_idx bigint{keys}"
    if mode == "headers":
        return f"trace_idx bigint{keys}, raw_header binary, hdr struct<{_struct(spec.TRACE)}>"
    if mode == "traces":
        return f"trace_idx bigint{keys}, raw_header binary, samples array<float>"
    raise ValueError(f"unknown mode {mode}")


class SegySource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "segy"

    def schema(self) -> str:
        return _schema_of(dict(self.options))

    def reader(self, schema: StructType) -> DataSourceReader:
        return SegyReader(dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return SegyWriter(dict(self.options), overwrite)


class SegyReader(DataSourceReader):
    def __init__(self, options: dict):
        from .files import open_info

        self.options, self.mode = options, options.get("mode", "traces")
        self.info = open_info(options["path"])
        n = self.info.trace_count
        self.first, self.end = max(0, int(options.get("first", 0))), min(n, int(options.get("end", n)))
        index, lines = options.get("index"), options.get("lines")
        self.exact = None if index is None else {int(i) for i in index.split(",") if i}
        self.lines = None if lines is None else tuple(map(int, lines.split(",")))
        if self.lines:
            at, count, stride, number = self.lines
            if at < 0 or min(count, number) < 1 or stride < count or at + (number - 1) * stride + count > n:
                raise ValueError(f"lines {lines} are outside the file")

    def partitions(self) -> list[Span]:
        if self.mode in ("textual", "binary"):
            return [Span(0, 0)]
        per = max(1, int(self.options.get("partition_bytes", PARTITION_BYTES)) // self.info.record)
        if self.lines:
            at, count, stride, number = self.lines
            if count >= per:
                return [Span(k, min(k + per, end) - 1) for line in range(number) for end in [at + line * stride + count] for k in range(end - count, end, per)]
            some = max(1, per // count)
            return [Span(at + k * stride, at + k * stride + count - 1, stride, min(some, number - k)) for k in range(0, number, some)]
        if self.exact is not None:
            inside = sorted(i for i in self.exact if self.first <= i < self.end)
            runs: list[Span] = []
            for i in inside:  # neighbours are read together
                if runs and i - runs[-1].last < 8 and i - runs[-1].first < per:
                    runs[-1].last = i
                else:
                    runs.append(Span(i, i))
            return runs or [Span(0, -1)]
        return [Span(a, min(a + per, self.end) - 1) for a in range(self.first, self.end, per)] or [Span(0, -1)]

    def read(self, partition: Span):
        import numpy as np
        import pyarrow as pa

        from .. import codec
        from .files import filesystem

        system, path = filesystem(self.info.path)
        with system.open_input_file(path) as f:
            if self.mode == "textual":
                lines = codec.decode_text(f.read_at(spec.TEXT_BYTES, 0), self.options.get("coding"))
                yield pa.RecordBatch.from_arrays([pa.array(range(1, len(lines) + 1), type=pa.int32()), pa.array(lines)], names=["line_no", "text"])
                return
            if self.mode == "binary":
                raw = f.read_at(spec.BINARY_BYTES, spec.TEXT_BYTES)
                arrays = _header_arrays(np.frombuffer(raw, dtype=np.uint8)[None], spec.BINARY)
                yield pa.RecordBatch.from_arrays([*arrays, pa.array([raw], type=pa.binary())], names=[*(x.name for x in spec.BINARY), "raw_header"])
                return
            t0, t1 = int(self.options.get("t0", 0)), int(self.options.get("t1", self.info.nt))
            if not 0 <= t0 < t1 <= self.info.nt and self.info.nt:
                raise ValueError(f"time range {t0}..{t1} is outside 0..{self.info.nt}")
            size, parts = self.info.esize, [(0, spec.TRACE_BYTES)]
            if self.mode == "traces":
                parts.append((spec.TRACE_BYTES + t0 * size, spec.TRACE_BYTES + t1 * size))
            if len(parts) > 1 and parts[1][0] == spec.TRACE_BYTES:
                parts = [(0, parts[1][1])]
            for index, rows in self._rows(f, partition, parts):
                yield self._batch(index, rows, t1 - t0)

    def _rows(self, f, partition: Span, parts: list[tuple[int, int]]):
        """(record numbers, bytes of their parts), about a batch at a time."""
        import numpy as np

        record = self.info.record
        per = max(1, BATCH_BYTES // sum(b - a for a, b in parts))
        index, rows, held = [], [], 0
        for line in range(partition.lines):
            first, last = partition.first + line * partition.stride, partition.last + line * partition.stride
            for a in range(first, last + 1, per):
                n = min(per, last + 1 - a)
                index.append(np.arange(a, a + n))
                rows.append(read_records(f, record, parts, a, n))
                held += n
                if held >= per:
                    yield np.concatenate(index), np.concatenate(rows)
                    index, rows, held = [], [], 0
        if held:
            yield np.concatenate(index), np.concatenate(rows)

    def _batch(self, index, rows, nt: int):
        import numpy as np
        import pyarrow as pa

        from .. import codec

        headers, arrays, names = rows[:, : spec.TRACE_BYTES], [pa.array(index)], ["trace_idx"]
        for name, loc, code in _keys(self.options):
            values = codec.field(headers, loc, code)
            arrays.append(pa.array(values.astype(np.int16 if code == 1 else values.dtype.newbyteorder("="))))
            names.append(name)
        if self.mode != "keys":
            arrays.append(binary_rows(headers))
            names.append("raw_header")
        if self.mode == "headers":
            arrays.append(pa.StructArray.from_arrays(_header_arrays(headers, spec.TRACE), names=[x.name for x in spec.TRACE]))
            names.append("hdr")
        if self.mode == "traces":
            values = codec.decode_samples(np.ascontiguousarray(rows[:, spec.TRACE_BYTES :]), self.info.format, self.options.get("ibm", "round"))
            arrays.append(pa.ListArray.from_arrays(pa.array(np.arange(len(index) + 1, dtype=np.int32) * nt), pa.array(values.ravel())))
            names.append("samples")
        return pa.RecordBatch.from_arrays(arrays, names=names)


@dataclass
class Written(WriterCommitMessage):
    records: int


class _InPlaceWriter(DataSourceArrowWriter):
    """A file made at its full size on the driver; tasks write disjoint records, so a task may run again."""

    def _prepare(self, overwrite: bool, size: int) -> None:
        import uuid

        from .files import local_path

        self.final = local_path(self.options["path"])
        if os.path.exists(self.final) and not overwrite:
            raise FileExistsError(self.final)
        self.partial = f"{self.final}.{uuid.uuid4().hex}.tmp"
        os.makedirs(os.path.dirname(self.partial) or ".", exist_ok=True)
        with open(self.partial, "wb") as f:
            f.truncate(size)

    def commit(self, messages: list) -> None:
        self._finish(sum(m.records for m in messages if m is not None))
        os.replace(self.partial, self.final)

    def _finish(self, records: int) -> None:
        pass

    def abort(self, messages: list) -> None:
        if os.path.exists(self.partial):
            os.unlink(self.partial)


class SegyWriter(_InPlaceWriter):
    """Rows (trace_idx, raw_header, samples); options trace_count, nt, format, and the hex preamble."""

    def __init__(self, options: dict, overwrite: bool):
        from .. import codec

        self.options = options
        self.nt, self.code, self.count = int(options["nt"]), int(options.get("format", 5)), int(options["trace_count"])
        self.record = spec.TRACE_BYTES + self.nt * codec.element_size(self.code)
        self.preamble = bytes.fromhex(options["preamble"])
        if len(self.preamble) != spec.PREAMBLE:
            raise ValueError("the preamble must have 3600 bytes")
        self._prepare(overwrite, spec.PREAMBLE + self.count * self.record)

    def write(self, iterator) -> Written:
        import numpy as np

        from .. import codec

        done = 0
        with open(self.partial, "r+b", buffering=0) as f:
            for batch in iterator:
                at = batch.schema.get_field_index
                index = batch.column(at("trace_idx")).to_numpy()
                if not len(index):
                    continue
                if index.min() < 0 or index.max() >= self.count:
                    raise ValueError("trace_idx is outside the file")
                headers = np.frombuffer(b"".join(batch.column(at("raw_header")).to_pylist()), dtype=np.uint8).reshape(-1, spec.TRACE_BYTES)
                values = batch.column(at("samples")).flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(len(index), self.nt)
                rows = np.concatenate([headers, codec.encode_samples(values, self.code)], axis=1)
                write_records(f.fileno(), index, rows, self.record, spec.PREAMBLE)
                done += len(index)
        return Written(done)

    def _finish(self, records: int) -> None:
        if records != self.count:
            os.unlink(self.partial)
            raise ValueError(f"{records} traces written, {self.count} declared")
        with open(self.partial, "r+b") as f:
            f.write(self.preamble)


class RawVolumeSource(DataSource):
    """Headerless little-endian float32 volumes in C order; options ni, nx, nt."""

    @classmethod
    def name(cls) -> str:
        return "rawvol"

    def schema(self) -> str:
        return "iline_idx int, xline_idx int, samples array<float>"

    def reader(self, schema: StructType) -> DataSourceReader:
        return RawVolumeReader(dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return RawVolumeWriter(dict(self.options), overwrite)


class RawVolumeReader(DataSourceReader):
    def __init__(self, options: dict):
        from .files import file_size

        self.path = options["path"]
        self.ni, self.nx, self.nt = (int(options[k]) for k in ("ni", "nx", "nt"))
        if file_size(self.path) != 4 * self.ni * self.nx * self.nt:
            raise ValueError("the file's size doesn't fit ni * nx * nt")

    def partitions(self) -> list[Span]:
        per, n = max(1, PARTITION_BYTES // max(1, 4 * self.nt)), self.ni * self.nx
        return [Span(a, min(a + per, n) - 1) for a in range(0, n, per)]

    def read(self, partition: Span):
        import numpy as np
        import pyarrow as pa

        from .files import filesystem

        system, path = filesystem(self.path)
        per = max(1, BATCH_BYTES // max(1, 4 * self.nt))
        with system.open_input_file(path) as f:
            for a in range(partition.first, partition.last + 1, per):
                n = min(per, partition.last + 1 - a)
                values = np.frombuffer(f.read_at(4 * n * self.nt, 4 * a * self.nt), dtype="<f4")
                at = np.arange(a, a + n)
                samples = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * self.nt), pa.array(values))
                yield pa.RecordBatch.from_arrays([pa.array((at // self.nx).astype(np.int32)), pa.array((at % self.nx).astype(np.int32)), samples], names=["iline_idx", "xline_idx", "samples"])


class RawVolumeWriter(_InPlaceWriter):
    """Rows (iline_idx, xline_idx, samples); a cell without a row stays zero."""

    def __init__(self, options: dict, overwrite: bool):
        self.options = options
        self.ni, self.nx, self.nt = (int(options[k]) for k in ("ni", "nx", "nt"))
        self._prepare(overwrite, 4 * self.ni * self.nx * self.nt)

    def write(self, iterator) -> Written:
        import numpy as np

        done = 0
        with open(self.partial, "r+b", buffering=0) as f:
            for batch in iterator:
                at = batch.schema.get_field_index
                cell = batch.column(at("iline_idx")).to_numpy().astype(np.int64) * self.nx + batch.column(at("xline_idx")).to_numpy()
                values = batch.column(at("samples")).flatten().to_numpy(zero_copy_only=False).astype("<f4").reshape(len(cell), self.nt)
                write_records(f.fileno(), cell, values, 4 * self.nt, 0)
                done += len(cell)
        return Written(done)


def register(spark: SparkSession) -> None:
    """Make both formats known to the session."""
    spark.dataSource.register(SegySource)
    spark.dataSource.register(RawVolumeSource)


def load(spark: SparkSession, path: str, mode: str = "traces", **options):
    """DataFrame of a SEG-Y file; options as of the format."""
    register(spark)
    reader = spark.read.format("segy").option("mode", mode)
    for k, v in options.items():
        if v is not None:
            reader = reader.option(k, str(v))
    return reader.load(path)
