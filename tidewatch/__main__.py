"""Command line: ``python -m tidewatch analyze SPEC`` and ``python -m tidewatch monitor SPEC --csv-in TRACE``."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from . import api
from .operators import sinks
from .sources import events, pcap


def main(argv: list[str] | None = None) -> int:
    top = argparse.ArgumentParser(prog="tidewatch")
    sub = top.add_subparsers(dest="command", required=True)
    one = sub.add_parser("analyze")
    one.add_argument("spec")
    run = sub.add_parser("monitor")
    run.add_argument("spec")
    source = run.add_mutually_exclusive_group(required=True)
    source.add_argument("--csv-in")
    source.add_argument("--pcap-in")
    source.add_argument("--stdin", action="store_true")
    run.add_argument("--local-network", action="append")
    run.add_argument("--csv-time-column")
    run.add_argument("--offline", default="relative")
    run.add_argument("--start-time")
    run.add_argument("--output-format", choices=("log", "json", "csv"), default="log")
    run.add_argument("--output-time-format", default="relative")
    run.add_argument("--verbosity", choices=sinks.LEVELS, default="violations")
    run.add_argument("--debug-streams", nargs="*", default=[])
    run.add_argument("--output-file")
    run.add_argument("--statistics", action="store_true")
    a = top.parse_args(argv)
    with open(a.spec, encoding="utf-8") as f:
        spec = api.Spec(f.read())
    if a.command == "analyze":
        for kind, found in (("input", spec.inputs()), ("output", spec.outputs())):
            for name, t in found.items():
                print(f"{kind} {name}: {t}")
        print(f"{len(spec.triggers())} triggers")
        return 0
    spark = SparkSession.builder.appName("tidewatch").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    column = int(a.csv_time_column) if a.csv_time_column and a.csv_time_column.isdigit() else a.csv_time_column
    options = {"start": a.start_time} if a.start_time else {}
    if a.pcap_in:
        trace = pcap.read_pcap(spark, a.pcap_in, a.local_network)
    elif a.stdin:
        trace = events.from_text(spark, sys.stdin.read(), spec.text, a.offline, column, **options)
    else:
        trace = events.read_csv(spark, a.csv_in, spec.text, a.offline, column, **options)
    result = spec.monitor(trace)
    shown = sinks.visible(spec.spec, a.verbosity, debug=tuple(a.debug_streams))
    changes = result.changes()
    changes = changes.filter(changes.stream.isin(*shown)) if shown else changes.limit(0)
    if a.output_format == "csv":
        if result.plan is None:
            raise SystemExit("CSV needs a specification without spawned streams")
        lines = sinks.csv_rows(result.plan, [n for n in shown if n not in result.plan.keyed], a.output_time_format)
        if not a.output_file:
            print(",".join(lines.columns))
    else:
        lines = (sinks.log_rows(changes, spec.triggers(), a.output_time_format) if a.output_format == "log" else sinks.json_rows(changes, a.output_time_format)).orderBy("ts", "kind", "seq").select("value")
    if a.output_file:
        (lines.write.csv(a.output_file, header=True) if a.output_format == "csv" else lines.write.text(a.output_file))
    else:
        for row in lines.toLocalIterator():
            print(",".join(row))
    if a.statistics:
        for row in sinks.statistics(result.changes(), spec.triggers()).toLocalIterator():
            print(f"{row['stream']}: {row['n']}", file=sys.stderr)
    return 0


if __name__ == "__main__":
    sys.exit(main())
