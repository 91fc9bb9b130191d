from __future__ import annotations

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from seisframe import api, cli, codec, spec
from seisframe.functions import native
from seisframe.operators import geometry as g
from seisframe.operators import headers as hd
from seisframe.operators import sinks, spatial
from seisframe.operators import volume as vol
from seisframe.sources import files, segy
from seisframe.survey import Survey, guess

NT = 8


def model(seed, ni=6, nx=7, drop=0.3, shuffle=False, repeat=False):
    """Rows of a survey and the dense array they mean."""
    rng = np.random.default_rng(seed)
    cells = [(i, x) for i in range(ni) for x in range(nx) if (i, x) in ((0, 0), (ni - 1, nx - 1), (0, 1), (1, 0)) or rng.random() >= drop]
    if repeat:
        cells += cells[2:5]
    if shuffle:
        rng.shuffle(cells)
    dense, rows = np.zeros((ni, nx, NT), dtype=np.float32), []
    for n, (i, x) in enumerate(map(tuple, cells)):
        samples = rng.integers(-50, 50, NT).astype(np.float32)
        dense[i, x] = samples
        rows.append((n, 10 + 2 * int(i), 100 + 3 * int(x), 0, 1000 + 20 * int(x), 5000 + 30 * int(i), samples.tolist()))
    return rows, dense


def make(spark, path, rows, **options):
    frame = spark.createDataFrame(rows, "trace_idx long, iline int, xline int, offset int, x_coord int, y_coord int, samples array<float>").repartition(3)
    sinks.write_traces(frame, str(path), NT, len(rows), **options)
    return str(path)


@pytest.mark.parametrize(("seed", "options"), [(1, {"drop": 0}), (2, {}), (3, {"shuffle": True}), (4, {"shuffle": True, "repeat": True})])
@pytest.mark.parametrize("code", [1, 5])
def test_dense_reads_match_the_model(spark, tmp_path, seed, options, code):
    rows, dense = model(seed, **options)
    path = make(spark, tmp_path / "a.sgy", rows, code=code)
    assert (api.fromfile(spark, path, 189, 193, None, None) == dense).all()
    own = Survey(spark, path, 189, 193)
    assert own.shape == dense.shape and own.trace_count == len(rows) and len(own) == 6
    assert own.geometry.regular == (len(rows) == 42 and not options.get("repeat"))
    for key in (2, -1, (slice(1, 4), 3), (Ellipsis, slice(2, 5)), ([4, 0, 4], [1, 6], [7, 0]), (1, 2, 3)):
        want = dense[np.ix_(*[np.atleast_1d(k) for k in key])] if isinstance(key, tuple) and isinstance(key[0], list) else dense[key]
        assert np.allclose(own.to_numpy(key), np.squeeze(want)), key


def test_other_formats(spark, tmp_path):
    rows, dense = model(5)
    for code in (2, 3, 8):
        assert (api.fromfile(spark, make(spark, tmp_path / f"{code}.sgy", rows, code=code), 189, 193, 2, 3) == dense).all()


def test_ranges_flat_view_and_ragged_tail(spark, tmp_path):
    rows, _ = model(6)
    path = make(spark, tmp_path / "a.sgy", rows)
    with open(path, "ab") as f:
        f.write(b"\x01" * 40)
    flat = np.array([r[-1] for r in rows], dtype=np.float32)
    assert api.trace_count(path) == len(rows)
    assert (api.collect(spark, path) == flat).all()
    assert (api.collect(spark, path, 3, -1, 2, 5) == flat[3:, 2:5]).all()
    assert (api.collect(spark, path, 4) == flat[4:5]).all()
    own = Survey(spark, path, 189, 193, as_2d=True)
    assert own.shape == flat.shape and (own.to_numpy((slice(2, 6), [0, 7])) == flat[2:6][:, [0, 7]]).all()
    assert (own.to_numpy(([5, 1], slice(0, 3))) == flat[[5, 1], :3]).all()
    assert (api.get_trace_keys(spark, path, [189, 193]) == np.array([r[1:3] for r in rows])).all()
    assert own.to_3d().shape == (6, 7, NT) and own.min() == flat.min() and own.max(True) == flat.max()
    with pytest.raises(IndexError):
        vol.collect(own.traces, len(rows), NT, 2, 999)


def test_options_prune_record_ranges(spark, tmp_path):
    rows, _ = model(7, ni=20, nx=20, drop=0)
    path = make(spark, tmp_path / "a.sgy", rows)
    tasks = lambda **o: segy.load(spark, path, "keys", partition_bytes=2720, **o).rdd.getNumPartitions()
    assert (tasks(), tasks(first=100, end=120), tasks(index="3,5,300")) == (40, 2, 2)
    assert [r.trace_idx for r in segy.load(spark, path, "keys", index="300,5,3").where("trace_idx in (3, 300)").collect()] == [3, 300]
    every = segy.load(spark, path, "keys")
    assert every.where("trace_idx = 7").first().xline == 100 + 21 and every.count() == 400


def test_headers_modes_and_native_decoding(spark, tmp_path):
    rows, _ = model(8)
    path = make(spark, tmp_path / "a.sgy", rows, scalar=-10)
    got = segy.load(spark, path, "headers")
    first = got.where("trace_idx = 0").select("hdr.*").first()
    assert (first.inline_num, first.crossline_num, first.scalar_for_coord, first.num_sample) == (10, 100, -10, NT)
    own = got.select("trace_idx", native.header_field(got.raw_header, 189).alias("il"), native.header_field(got.raw_header, 71).alias("s"), native.coordinate_scale(native.header_field(got.raw_header, 71)).alias("f")).orderBy("trace_idx").collect()
    assert [r.il for r in own] == [r[1] for r in rows] and {r.s for r in own} == {-10} and {r.f for r in own} == {0.1}
    words = spark.createDataFrame([(0x42640000,), (0xC276A000,), (0,)], "w long").select(native.ibm_float(F.col("w")).alias("v"))
    assert [r.v for r in words.collect()] == [100.0, -118.625, 0.0]
    assert hd.read_header(path)[21][1] == NT and api.header_lines(path)[0].startswith("Bytes 1 - 4: 1 -- ")
    assert hd.read_header(path, "t", 2)[1].tolist() == rows[2][-1]
    assert segy.load(spark, path, "textual").count() == 40 and segy.load(spark, path, "binary").first().data_format == 5
    with pytest.raises(ValueError, match="kind"):
        hd.read_header(path, "zz")


def test_patching_headers(spark, tmp_path):
    path = make(spark, tmp_path / "a.sgy", model(9)[0])
    hd.modify_bin_key(path, 3217 - 3200, 500)
    assert files.open_info(path).dt == 500
    assert hd.modify_trace_key(spark, path, 37, 9) == api.trace_count(path)
    assert hd.modify_trace_key(spark, path, 37, -4, 1) == 1
    assert api.get_trace_keys(spark, path, 37)[:3].tolist() == [9, -4, 9]
    for bad in (lambda: hd.modify_bin_key(path, 101, 1), lambda: hd.modify_bin_key(path, 2, 1), lambda: hd.modify_trace_key(spark, path, 2, 1, force=True, kind="x")):
        with pytest.raises(ValueError, match="location|type"):
            bad()
    with pytest.raises(IndexError):
        hd.modify_trace_key(spark, path, 37, 1, 10_000)


def test_prestack(spark, tmp_path):
    rng = np.random.default_rng(1)
    rows, dense = [], np.full((3, 4, 5, NT), 7, dtype=np.float32)
    for i in range(3):
        for x in range(4):
            for o in range(5):
                if (i + x + o) % 4 or (i, x, o) == (0, 0, 0):
                    dense[i, x, o] = rng.integers(-9, 9, NT)
                    rows.append((len(rows), i + 1, x + 1, 100 + 50 * o, 0, 0, dense[i, x, o].tolist()))
    path = make(spark, tmp_path / "p.sgy", rows, sorting=2)
    assert (api.load_prestack3D(spark, path, 189, 193, 37, 7.0) == dense).all()
    assert api.scan_prestack(spark, path, 189, 193)["shape"] == [3, 4, 5]
    rows[4], rows[5] = (4, *rows[5][1:]), (5, *rows[4][1:])
    with pytest.raises(ValueError, match="offset"):
        api.scan_prestack(spark, make(spark, tmp_path / "q.sgy", rows), 189, 193)


def test_violations_across_chunks(spark):
    keys = spark.createDataFrame([(k, k if k != 6 else 2) for k in range(12)], "trace_idx long, iline int")
    for chunk in (1, 3, 6, 100):
        got = g.previous(keys, ["iline"], chunk).orderBy("trace_idx").collect()
        assert [r.prev_iline for r in got] == [None, *[r.iline for r in got[:-1]]]


def test_equal_gaps_and_steps(spark):
    keys = spark.createDataFrame([(n, il, x) for n, (il, x) in enumerate((i, x) for i in (1, 2, 4, 5, 7, 8) for x in (5, 7, 11))], "trace_idx long, iline int, xline int")
    geo = g.scan(keys)
    assert geo.shape == (8, 4) and not geo.regular
    assert [r["count"] for r in g.line_index(keys, 1).orderBy("line_num").collect()] == [3, 3, 0, 3, 3, 0, 3, 3]
    with pytest.raises(ValueError, match="grid"):
        g.scan(keys, steps=(1, 4))


def test_cut_share_and_raw_volumes(spark, tmp_path):
    rows, dense = model(10)
    path, out, raw = make(spark, tmp_path / "a.sgy", rows, start_time=4), str(tmp_path / "b.sgy"), str(tmp_path / "v.dat")
    geo = Survey(spark, path, 189, 193).geometry
    n = sinks.cut(spark, path, out, geo, (0, 3), (0, 4), (2, 6))
    part = api.get_trace_keys(spark, out, [189, 193, 115, 105])
    assert len(part) == n and set(part[:, 2]) == {4} and set(part[:, 3]) == {4 + 4}
    assert np.allclose(api.fromfile_without_scan(spark, out, 3, 4, 10, 100, istep=2, xstep=3), dense[:3, :4, 2:6])
    api.tofile(spark, path, raw, istep=2, xstep=3)
    assert (np.fromfile(raw, "<f4").reshape(dense.shape) == dense).all()
    assert api.create_by_sharing_header(spark, out, path, raw, dense.shape, istep=None, xstep=None) == len(rows)
    assert (api.fromfile(spark, out, 189, 193, 2, 3) == dense).all()
    assert api.textual_header(out) == api.textual_header(path)
    with pytest.raises(ValueError, match="shape"):
        api.create_by_sharing_header(spark, out, path, dense[:2], istep=2, xstep=3)
    with pytest.raises(IndexError):
        sinks.cut(spark, path, out, geo, (2, 99))


def test_create_guess_and_cli(spark, tmp_path, capsys):
    data = np.random.default_rng(0).normal(size=(30, 20, NT)).astype(np.float32)
    path = str(tmp_path / "c.sgy")
    api.create(spark, path, data, custom=["mine"], dt=4000, min_iline=5)
    assert (api.fromfile(spark, path) == data).all() and (api.fromfile_by_guess(spark, path) == data).all()
    assert guess(path, spark)[0][:4] == (189, 193, 1, 1)
    assert api.textual_header(path)[0].startswith("C01 mine") and os.path.getsize(path) == 3600 + 600 * (240 + 4 * NT)
    raw = str(tmp_path / "c.dat")
    assert cli.main(["read", "-i", path, "-o", raw, "-m", "-p"], spark) == 0
    assert (np.fromfile(raw, "<f4").reshape(data.shape) == data).all() and "isnormal    : True" in capsys.readouterr().out
    assert cli.main(["create", "-i", raw, "-o", path, "-d", "30", "20", str(NT), "-f", "1"], spark) == 0
    assert np.allclose(api.fromfile(spark, path), data, rtol=1e-6)
    with pytest.raises(ValueError):
        hd.NewSurvey(1, 1, 1, format=4)


def test_key_normaliser():
    assert vol.normalise_key((None, -1, slice(None, 3)), (4, 5, 6)) == [(3, 4), (0, 3), (0, 6)]
    assert vol.normalise_key((Ellipsis, [-1, 0]), (4, 5, 6)) == [(0, 4), (0, 5), [5, 0]]
    for bad in ((0, 0, 0, 0), 9, (Ellipsis, Ellipsis), slice(None, None, 2), [7], slice(3, 3)):
        with pytest.raises(IndexError):
            vol.normalise_key(bad, (4, 5, 6))


def test_gather_repeats_and_missing(spark, tmp_path):
    rows, _ = model(11)
    own = Survey(spark, make(spark, tmp_path / "a.sgy", rows), 189, 193)
    index = spark.createDataFrame([(0, 3), (1, -1), (2, 3)], "pos int, trace_idx long")
    got = vol.gather(own.traces, index, len(rows), NT, 1, 4).orderBy("pos").collect()
    assert [r.samples for r in got] == [rows[3][-1][1:4], [0, 0, 0], rows[3][-1][1:4]]
    with pytest.raises(Exception, match="out of range"):
        vol.gather(own.traces, spark.createDataFrame([(0, 999)], "pos int, trace_idx long"), len(rows), NT).collect()


def test_affine_path_and_bilinear(spark, tmp_path):
    rows, dense = model(12, drop=0)
    own = Survey(spark, make(spark, tmp_path / "a.sgy", rows), 189, 193)
    t = own.affine
    assert np.allclose([t.a, t.b, t.d, t.e], [0, 20 / 3, 15, 0], atol=1e-9)
    assert spatial.north(t) == pytest.approx((1.0, 0.0), abs=1e-3)
    line, path = own.arbitrary_line([(0, 0), (3, 4), (5, 6)], "zero", 0.7)
    got = line.groupBy("pos").pivot("k", list(range(NT))).sum("value").orderBy("pos").toPandas().to_numpy()[:, 1:]
    for (u, v), values in zip(path, got, strict=True):
        i, j = min(int(u), 4), min(int(v), 5)
        a, b = u - i, v - j
        want = dense[i, j] * (1 - a) * (1 - b) + dense[i, j + 1] * (1 - a) * b + dense[i + 1, j] * a * (1 - b) + dense[i + 1, j + 1] * a * b
        assert np.allclose(values, want, atol=1e-4)
    for kind, points in (("line", [(10, 100), (16, 112)]), ("xy", [(1000, 5000), (1080, 5090)])):
        assert np.allclose(spatial.place_points(points, own.geometry, kind, t), [[0, 0], [3, 4]])
    with pytest.raises(ValueError, match="outside"):
        spatial.place_points([(0, 99)], own.geometry, "zero")


def test_failed_writes_leave_nothing(spark, tmp_path):
    path = tmp_path / "a.sgy"
    rows, _ = model(13)
    frame = spark.createDataFrame(rows, "trace_idx long, iline int, xline int, offset int, x_coord int, y_coord int, samples array<float>")
    with pytest.raises(Exception, match="declared|outside"):
        sinks.write_traces(frame, str(path), NT, len(rows) + 1)
    assert not path.exists()
    with pytest.raises(FileNotFoundError):
        files.open_info(str(path))


def test_stream_of_files(spark, tmp_path):
    from seisframe.streaming import arrivals

    (tmp_path / "in").mkdir()
    rows, _ = model(14)
    make(spark, tmp_path / "in" / "a.sgy", rows)
    query = arrivals.read_stream(spark, str(tmp_path / "in")).writeStream.format("memory").queryName("arrived").trigger(availableNow=True).start()
    query.awaitTermination(60)
    got = spark.table("arrived").orderBy("trace_idx").collect()
    assert [list(r.samples) for r in got] == [r[-1] for r in rows] and got[0].iline == 10
    assert codec.element_size(5) == 4 and spec.stack_class(4) == "poststack"


class Counted:
    """A file system that counts the bytes read."""

    def __init__(self, inner):
        self.inner, self.bytes = inner, 0

    def open_input_file(self, path):
        outer = self

        class File:
            def __init__(self):
                self.f = outer.inner.open_input_file(path)

            def __enter__(self):
                return self

            def __exit__(self, *_):
                self.f.close()

            def read_at(self, n, at):
                outer.bytes += n
                return self.f.read_at(n, at)

        return File()


def bytes_read(monkeypatch, **options):
    """(bytes, rows) of one read, done here and not in a worker."""
    reader = segy.SegyReader({k: str(v) for k, v in options.items()})
    real = files.filesystem
    counted = Counted(real(options["path"])[0])
    monkeypatch.setattr(files, "filesystem", lambda uri: (counted, uri))
    try:
        rows = sum(b.num_rows for p in reader.partitions() for b in reader.read(p))
    finally:
        monkeypatch.setattr(files, "filesystem", real)
    return counted.bytes, rows


def test_only_needed_bytes_are_read(spark, tmp_path, monkeypatch):
    nt, ni, nx = 2500, 8, 9
    path = str(tmp_path / "long.sgy")
    data = np.arange(ni * nx * nt, dtype=np.float32).reshape(ni, nx, nt)
    api.create(spark, path, data)
    record = 240 + 4 * nt
    assert bytes_read(monkeypatch, path=path, mode="keys") == (ni * nx * 240, ni * nx)
    assert bytes_read(monkeypatch, path=path, mode="headers", first=9, end=18) == (9 * 240, 9)
    assert bytes_read(monkeypatch, path=path, first=9, end=18) == (9 * record, 9)
    assert bytes_read(monkeypatch, path=path, lines=f"2,3,{nx},4") == (12 * record, 12)
    assert bytes_read(monkeypatch, path=path, t0=7, t1=8) == (ni * nx * 244, ni * nx)
    assert bytes_read(monkeypatch, path=path, first=0, end=0) == (0, 0)
    assert bytes_read(monkeypatch, path=path, lines=f"0,{nx},{nx},{ni}", partition_bytes=3 * record, t0=0, t1=5) == (ni * nx * 260, ni * nx)
    own = Survey(spark, path, 189, 193)
    assert own.geometry.in_order
    for key in ((slice(None), 4), (2, 3), (slice(2, 5), slice(1, 4), slice(100, 103)), ([7, 0], slice(3, 5), [5, 2]), (Ellipsis, 2499)):
        want = data[np.ix_([7, 0], [3, 4], [5, 2])] if isinstance(key[0], list) else data[key]
        assert (own.to_numpy(key) == np.squeeze(want)).all()


def test_slices_of_a_regular_survey_shuffle_nothing(spark, tmp_path):
    rows, _ = model(21, drop=0)
    own = Survey(spark, make(spark, tmp_path / "a.sgy", rows), 189, 193)
    for key in (3, (slice(None), 2), (1, 1), (slice(1, 3), slice(2, 4), slice(1, 5)), ([4, 0], [1, 6])):
        plan = own[key]._jdf.queryExecution().executedPlan().toString()
        assert plan.count("BatchScan") == 1 and "Join" not in plan.replace("BroadcastHashJoin", "")
        assert not [x for x in plan.split("\n") if "Exchange" in x and "Broadcast" not in x]
    assert own._reach((3, 4), (0, 7)) == {"first": 21, "end": 28} and own._reach((1, 3), (2, 4)) == {"lines": "9,2,7,2"}
    irregular, _ = model(22)
    there = Survey(spark, make(spark, tmp_path / "b.sgy", irregular), 189, 193)
    at = [r[0] for r in irregular if r[1] == 14]
    assert there._reach((2, 3), (0, 7)) == {"first": min(at), "end": max(at) + 1}


def test_scan_across_ranges_of_keys(spark):
    rng = np.random.default_rng(4)
    keys = spark.createDataFrame([(n, int(a), int(b)) for n, (a, b) in enumerate(zip(rng.choice(np.arange(-60, 900, 4), 300), rng.choice(np.arange(5, 200, 3), 300)))], "trace_idx long, iline int, xline int")
    rows = keys.collect()
    for chunk in (1, 7, 1 << 16):
        got = {r["axis"]: r for r in g.key_axes(keys, ("iline", "xline"), chunk).collect()}
        for axis in ("iline", "xline"):
            values = np.unique([r[axis] for r in rows])
            assert (got[axis]["low"], got[axis]["high"], got[axis]["step"]) == (values[0], values[-1], np.diff(values).min())
    with pytest.raises(ValueError, match="grid"):
        g.scan(spark.createDataFrame([(0, 1, 1), (1, 4, 1), (2, 6, 1)], "trace_idx long, iline int, xline int"))
    with pytest.raises(ValueError, match="positive"):
        g.scan(keys, steps=(0, 1))
    with pytest.raises(ValueError, match="no traces"):
        g.scan(keys.limit(0))


def test_survey_functions(spark, tmp_path):
    rows, dense = model(23, drop=0)
    path = make(spark, tmp_path / "a.sgy", rows, start_time=12, scalar=-10)
    own = Survey(spark, path, 189, 193)
    assert not own.is_create_geometry
    assert np.array_equal(np.asarray(own), dense) and np.array(own, dtype=np.float64).dtype == np.float64
    np.save(tmp_path / "a.npy", own)
    assert np.array_equal(np.load(tmp_path / "a.npy"), dense) and own.is_create_geometry
    got = own.read_traces([(2, 3), (0, 0), (2, 3)]).orderBy("pos").collect()
    assert [list(r.samples) for r in got] == [dense[2, 3].tolist(), dense[0, 0].tolist(), dense[2, 3].tolist()]
    got = own.read_traces([5, -1, 40], 2, 6).orderBy("pos").collect()
    assert [list(r.samples) for r in got] == [dense.reshape(-1, NT)[5, 2:6].tolist(), [0.0] * 4, dense.reshape(-1, NT)[40, 2:6].tolist()]
    assert [r.trace_idx for r in own.map_to_index([(1, 0), (0, 6)]).orderBy("pos").collect()] == [7, 6]
    assert own.time_start == 12 and own.scalar == 0.1 and own.time_axis[:2].tolist() == [12.0, 14.0]
    assert own.interval == pytest.approx((3.0, 2.0))
    own.scalar = 1.0
    assert own.scalar == 1.0
    xy = own.ix_to_xy([(10, 100), (20, 118)], zero_based=False)
    assert np.allclose(xy, [(1000, 5000), (1120, 5150)], atol=0.01) and np.allclose(own.xy_to_ix(xy, zero_based=False), [(10, 100), (20, 118)], atol=0.01)
    assert own.north() == pytest.approx((1.0, 0.0), abs=1e-3)
    point = own.interp([(1.5, 2.0)], "zero").orderBy("k").toPandas()["value"]
    assert np.allclose(point, (dense[1, 2] + dense[2, 2]) / 2, atol=1e-4)
    assert own.outline().count() == own.outline("xy").count() == 12
    assert own.key_series(("xline", "x_coord"), 3, 5).orderBy("trace_idx").collect()[1][:] == (4, 112, 1080)
    with pytest.raises(ValueError, match="mode"):
        own.outline("other")


def test_whole_file_functions(spark, tmp_path):
    data = np.random.default_rng(3).normal(size=(12, 20, NT)).astype(np.float32)
    path, raw = str(tmp_path / "c.sgy"), str(tmp_path / "c.dat")
    api.create(spark, path, data)
    assert (api.fromfile_ignore_header(spark, path, 20, 12, NT) == data.reshape(20, 12, NT)).all()
    api.tofile_ignore_header(spark, path, raw, NT, 20, 12)
    assert (np.fromfile(raw, "<f4").reshape(data.shape) == data).all()
    os.unlink(raw)
    assert cli.main(["read", "-i", path, "-o", raw, "--ignore-header", "-d", "12", "20", str(NT)], spark) == 0
    assert (np.fromfile(raw, "<f4").reshape(data.shape) == data).all()
    with pytest.raises(ValueError, match="aren't"):
        api.set_size(path, NT, 20, 13)
    api.tofile_by_guess(spark, path, raw)
    assert (np.fromfile(raw, "<f4").reshape(data.shape) == data).all()
    out = str(tmp_path / "d.sgy")
    assert api.create_by_sharing_header_guess(spark, out, path, data * 2) == 240
    assert (api.fromfile(spark, out) == data * 2).all()
    with pytest.raises(ValueError, match="no guessed"):
        api.create_by_sharing_header_guess(spark, out, path, data[:, :5])
    with pytest.raises(ValueError, match="shape"):
        api.create_by_sharing_header_guess(spark, out, path, raw)
    meta = api.get_metaInfo(spark, path)
    assert (meta.ni, meta.nx, meta.nt, meta.isnormal) == (12, 20, NT, True) and meta.x_interval == pytest.approx(25.0)
    meta.dt = 1000
    assert meta.as_dict()["dt"] == 1000
    head = api.trace_header(path, 21)
    assert int.from_bytes(api.trace_header(path, 21, raw=True)[188:192], "big") == 2 == np.frombuffer(head[188:192], dtype=np.int32)[0]
    assert len(api.trace_record(path, 21, raw=True)) == 240 + 4 * NT and np.array_equal(np.frombuffer(api.trace_record(path, 21)[240:], dtype=np.float32), data[1, 1])
    assert np.frombuffer(api.binary_header(path)[16:18], dtype=np.int16)[0] == 2000
    assert api.get_trace_keys2(spark, path, 193, 3, 5).tolist() == [4, 5]
    with pytest.raises(NotImplementedError):
        api.scan_4D(path)
    assert guess(path, spark, xline=17)[0][:2] == (189, 17) and guess(path, spark, xloc=5, yloc=9)[0][4:] == (5, 9)
    with pytest.raises(ValueError, match="plausible"):
        guess(path, spark, iline=1)


def test_gathers_as_a_volume(spark, tmp_path):
    """A 2-D prestack line read as a volume whose second axis is the offset."""
    rng = np.random.default_rng(31)
    data = rng.integers(-9, 9, (5, 4, NT)).astype(np.float32)
    rows = [(4 * i + o, 7, 300 + i, 150 + 25 * o, 0, 0, data[i, o].tolist()) for i in range(5) for o in range(4)]
    path = make(spark, tmp_path / "line.sgy", rows)
    assert (api.fromfile(spark, path, iline=21, xline=37, istep=1, xstep=25) == data).all()


def test_external_keys_and_fill(spark, tmp_path):
    rows, dense = model(32)
    blank = [(n, 0, 0, 0, 0, 0, samples) for n, *_, samples in rows]
    ic = spark.createDataFrame([(n, il, xl) for n, il, xl, *_ in rows], "trace_idx long, iline int, xline int")
    own = Survey(spark, make(spark, tmp_path / "a.sgy", blank), ic=ic, fill=float("nan"))
    there = np.zeros(dense.shape[:2], dtype=bool)
    for _, il, xl, *_ in rows:
        there[(il - 10) // 2, (xl - 100) // 3] = True
    got = own.to_numpy()
    assert np.isnan(got[~there]).all() and (got[there] == dense[there]).all() and not there.all()
    part = own.to_numpy((slice(1, 4), slice(2, 5), [3, 1]))
    assert np.array_equal(part, got[1:4, 2:5][:, :, [3, 1]], equal_nan=True)
    with pytest.raises(ValueError, match="one row"):
        _ = Survey(spark, str(tmp_path / "a.sgy"), ic=ic.limit(3)).geometry
