"""Command line: python -m finlake.cli <command> --warehouse DIR ..."""

from __future__ import annotations

import argparse
import sys
from datetime import date

from finlake import session
from finlake.plans import analytics, gold, ingest, regulatory, silver
from finlake.sources import datagen, landing
from finlake.sources.bus import FileBus, KafkaBus
from finlake.sources.store import TableStore


def _names(text: str) -> list[str]:
    return [x for x in text.split(",") if x]


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="finlake", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, *options: tuple) -> None:
        s = sub.add_parser(name)
        s.add_argument("--warehouse", required=True)
        s.add_argument("--master")
        s.add_argument("--countries", type=_names)
        for flag, kw in options:
            s.add_argument(flag, **kw)

    tables = ("--tables", {"type": _names})
    once = [
        ("--once", {"action": "store_true"}), ("--bus", {"required": True, "help": "folder, or kafka:HOST:PORT"}),
        ("--checkpoints", {"required": True}), ("--starting-offsets", {"default": "earliest"}),
    ]
    command(
        "ingest", ("--landing", {"required": True}), ("--datasets", {"type": _names}), ("--batch-size", {"type": int, "default": landing.CHUNK}),
        ("--archive", {}), ("--archive-after", {"type": float, "default": landing.GRACE_MINUTES}), ("--no-archive", {"action": "store_true"}),
        ("--bus", {"help": "where files that no rule routes are reported"}),
    )
    for name in ("silver", "gold"):
        command(name, tables, ("--window-days", {"type": int, "default": silver.WINDOW_DAYS}))
    command("regulatory", ("--report-date", {"type": date.fromisoformat, "required": True}))
    command("compact", tables, ("--target-size-mb", {"type": int, "default": 32}), ("--min-input-files", {"type": int, "default": 2}))
    command("raw-to-silver", ("--datasets", {"type": _names}), *once)
    command("silver-to-gold", ("--rules", {"type": _names}), *once)
    command("query", ("--name", {"required": True, "choices": [*analytics.QUERIES, *analytics.CHARTS, "sante_partitionnement"]}), ("--bus", {}))
    command(
        "seed", ("--landing", {"required": True}), ("--preset", {"choices": ("demo", "full"), "default": "demo"}), ("--customers", {"type": int}),
        ("--accounts", {"type": int}), ("--rows", {"type": int}), ("--seed", {"type": int, "default": 20260813}),
        ("--anomalies", {"type": int, "default": 5}),
    )
    return p


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    spark = session.build(master=a.master)
    store = TableStore(spark, a.warehouse)
    bus = None
    if getattr(a, "bus", None):
        bus = KafkaBus(spark, a.bus[6:], getattr(a, "starting_offsets", "earliest")) if a.bus.startswith("kafka:") else FileBus(spark, a.bus)
    if a.command == "ingest":
        done = ingest.run(spark, store, a.landing, a.datasets, a.countries, a.batch_size, None if a.no_archive else a.archive, a.archive_after)
        for o in done:
            print(o)
        if bus:
            print(landing.publish_rejects(spark, bus, a.landing), "files that no rule routes")
        return int(any(o.error for o in done))
    if a.command in ("silver", "gold"):
        plan = silver if a.command == "silver" else gold
        done = plan.run(spark, store, a.tables, a.countries, a.window_days)
        for name, o in done.items():
            print(name, o)
        return int(any("error" in o for o in done.values()))
    if a.command == "regulatory":
        print(regulatory.run(spark, store, a.report_date, a.countries)["rows"])
    elif a.command == "compact":
        for t in a.tables or store.tables("raw"):
            print(t, store.compact("raw", t, a.target_size_mb, a.min_input_files))
    elif a.command in ("raw-to-silver", "silver-to-gold"):
        from finlake.streaming import jobs
        from finlake.streaming.state import Watch, watched

        watch = Watch()
        spark.streams.addListener(watch)
        if a.command == "raw-to-silver":
            running = [jobs.raw_to_silver(spark, bus, store, d, a.checkpoints, a.once) for d in a.datasets or jobs.DATASETS]
        else:
            running = [jobs.ALL_RULES[r](spark, bus, store, a.checkpoints, a.once) for r in a.rules or jobs.RULES]
        errors = watched(running, watch, a.once, store)
        spark.streams.removeListener(watch)
        print("\n".join(errors))
        return int(bool(errors))
    elif a.command == "query":
        analytics.register(spark, store, bus)
        df = analytics.partition_health(store) if a.name == "sante_partitionnement" else analytics.run(spark, a.name) if a.name in analytics.QUERIES else analytics.chart(
            spark, a.name, a.countries,
        )
        df.show(1000, False)
    else:
        sizes = {"demo": (6_000, 10_000, 3_000), "full": (500_000, 800_000, 240_000)}[a.preset]
        data = datagen.generate(spark, a.customers or sizes[0], a.accounts or sizes[1], a.rows or sizes[2], a.seed, a.anomalies)
        print(len(datagen.deposit(data, a.landing)), "files")
    return 0


if __name__ == "__main__":
    sys.exit(main())
