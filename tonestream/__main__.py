"""python -m tonestream convert INPUT OUTPUT [-e FILTER:KEY=VALUE,...] | list | describe NAME"""

from __future__ import annotations

import argparse
import sys
import time

from pyspark.sql import SparkSession

from .plans import builtin, convert, observe
from .plans.diagnostics import Problems


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="tonestream", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    c = commands.add_parser("convert", help="convert a file")
    c.add_argument("input")
    c.add_argument("output")
    c.add_argument("-e", "--filter", action="append", default=[], help="name:key=value,...; may be repeated")
    c.add_argument("-i", "--input", dest="inputs", action="append", default=[], help="another input, NAME=PATH")
    c.add_argument("-w", "--wire", action="append", default=[], help="FILTER.PORT=NAME")
    c.add_argument("-f", "--force", action="store_true", help="overwrite the output")
    c.add_argument("--dry-run", action="store_true", help="resolve and explain, write nothing")
    c.add_argument("--metrics", action="store_true", help="report samples, bytes and time")
    c.add_argument("--codec", default="", help="codec of the output: lpcm, float, alaw, ulaw, ms-adpcm, ima-adpcm or flac")
    c.add_argument("--level", type=int, default=12, help="FLAC's search, 0 to 23")
    c.add_argument("--mpeg-tables", default="", help="JSON file with the tables that MPEG audio needs")
    c.add_argument("--progress", choices=("auto", "always", "never"), default="auto")
    commands.add_parser("list", help="formats, filters and codecs")
    d = commands.add_parser("describe", help="settings of a filter, or another component as KIND/NAME")
    d.add_argument("name")
    o = parser.parse_args(args)
    try:
        if o.command == "list":
            registry = builtin.catalog().registry
            print("formats:", *sorted({f for f, _ in convert.FORMATS.values()}))
            for kind in ("filter", "decoder", "encoder"):
                print(f"{kind}s:", *[x.name for x in registry.enumerate(kind)])
        elif o.command == "describe":
            kind, _, name = o.name.rpartition("/")
            try:
                about = builtin.catalog().describe(kind or "filter", name)
            except Problems as e:
                raise convert.ConversionError("resolver", e.items[0].code, str(e)) from e
            for f in about["fields"]:
                print("\t".join(str(f[k]) for k in ("name", "type", "default")))
        else:
            spark = SparkSession.builder.appName("tonestream").getOrCreate()
            spark.sparkContext.setLogLevel("ERROR")
            spec = convert.Spec(o.input, o.output, tuple(o.filter), o.force, tuple(tuple(i.split("=", 1)) for i in o.inputs if "=" in i), tuple(o.wire), o.codec, o.level, o.mpeg_tables)
            if o.dry_run:
                print(convert.build(spark, spec).explain())
                return 0
            start, counts, line = time.time(), [0, 0], observe.Progress(o.progress)
            plan = convert.build(spark, spec)

            def seen(n: int, size: int) -> None:
                counts[:] = n, size
                line.update(n / plan.result.rate, None, time.time() - start)

            convert.write(plan, seen)
            line.update(counts[0] / plan.result.rate, counts[0] / plan.result.rate, time.time() - start, final=True)
            if o.metrics:
                print(f"{counts[0]} samples, {observe.format_bytes(counts[1])}, {observe.format_duration(time.time() - start)}", file=sys.stderr)
    except convert.ConversionError as e:
        print(f"{e} ({e.code})", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
