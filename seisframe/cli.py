"""Command line: ``python -m seisframe.cli read|create ...``."""

from __future__ import annotations

import argparse


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="seisframe")
    sub = top.add_subparsers(dest="command", required=True)
    read = sub.add_parser("read", help="show headers, or convert to a raw float32 volume")
    read.add_argument("-i", "--input", required=True)
    read.add_argument("-o", "--output")
    read.add_argument("-f", "--fill", type=float, default=0.0)
    read.add_argument("-z", "--iline", type=int, default=189)
    read.add_argument("-c", "--xline", type=int, default=193)
    read.add_argument("--istep", type=int, default=1)
    read.add_argument("--xstep", type=int, default=1)
    read.add_argument("--xloc", type=int, default=73)
    read.add_argument("--yloc", type=int, default=77)
    read.add_argument("-p", "--print-textual", action="store_true")
    read.add_argument("-m", "--meta", action="store_true")
    read.add_argument("--ignore-header", action="store_true", help="traces in file order, without a geometry")
    read.add_argument("-d", "--dims", nargs=3, type=int, metavar=("NI", "NX", "NT"), help="with --ignore-header: the sizes that the traces must have")
    create = sub.add_parser("create", help="make a file from a raw volume")
    create.add_argument("-i", "--input", required=True)
    create.add_argument("-o", "--output", required=True)
    create.add_argument("-d", "--dims", nargs=3, type=int, required=True, metavar=("NI", "NX", "NT"))
    create.add_argument("-z", "--iline", type=int, default=189)
    create.add_argument("-c", "--xline", type=int, default=193)
    create.add_argument("--dt", type=int, default=2000)
    create.add_argument("-f", "--format", type=int, default=5)
    create.add_argument("--dx", type=float, default=25.0)
    create.add_argument("--dy", type=float, default=25.0)
    create.add_argument("--min-inline", type=int, default=1)
    create.add_argument("--min-crossline", type=int, default=1)
    create.add_argument("--start-time", type=int, default=0)
    create.add_argument("-s", "--share", action="store_true")
    create.add_argument("--header", help="donor file for --share")
    create.add_argument("--istep", type=int, default=1)
    create.add_argument("--xstep", type=int, default=1)
    return top


def main(argv: list[str] | None = None, spark=None) -> int:
    a = parser().parse_args(argv)
    from . import api
    from .sources import segy
    from .survey import Survey

    if a.command == "read" and a.print_textual:
        print("\n".join(api.textual_header(a.input)))
    if spark is None:
        from pyspark.sql import SparkSession

        spark = SparkSession.builder.getOrCreate()
    if a.command == "read":
        if a.meta:
            keys = segy.load(spark, a.input, "keys", iline=a.iline, xline=a.xline, xloc=a.xloc, yloc=a.yloc)
            print(api.report(api.meta_info(keys, a.input, a.istep, a.xstep)))
        if a.output and a.ignore_header and a.dims:
            ni, nx, nt = a.dims
            api.tofile_ignore_header(spark, a.input, a.output, nt, nx, ni)
        elif a.output:
            Survey(spark, a.input, a.iline, a.xline, a.istep, a.xstep, a.xloc, a.yloc, as_2d=a.ignore_header, fill=a.fill).tofile(a.output)
    elif a.share:
        api.create_by_sharing_header(spark, a.output, a.header, a.input, tuple(a.dims), a.iline, a.xline, a.istep, a.xstep)
    else:
        facts = {"dt": a.dt, "format": a.format, "start_time": a.start_time, "iline_interval": a.dx, "xline_interval": a.dy, "min_iline": a.min_inline, "min_xline": a.min_crossline}
        api.create(spark, a.output, a.input, tuple(a.dims), **facts)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
