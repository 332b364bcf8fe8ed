"""python -m fastaxis: measures events as they are announced.

Events and origins come by a bus (see fastaxis.sources.bus), and comments go to it; the tables that they
refer to are Parquet folders below --tables. Each event is measured once, a fixed time after its first
announcement, with its latest payload and origin.
"""

from __future__ import annotations

import argparse
import logging.config
import os
import sys
from collections.abc import Sequence

from fastaxis.config import ConfigError, Key, Settings, build, keys, load

VERSION = "3"
#: Settings that the command line takes too, and their short options (fixed names).
SHORT = {"seiscomp.host": "-H", "seiscomp.database": "-d", "seiscomp.wait_time": "-w"}
#: Folders that the service works in.
FOLDERS = {"bus": "the bus: announced events and origins, published comments", "tables": "the tables that events refer to", "store": "the results store", "checkpoint": "the stream's state"}


def _value(key: Key):
    """The reader of one setting's text: a whole number where its default is one, within its bounds."""

    def read(text: str):
        value = int(text) if type(key.default) is int else text
        if wrong := [b.says for b in key.bounds if not b.holds(value)]:
            raise argparse.ArgumentTypeError(f"must be {wrong[0]}")
        return value

    return read


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="fastaxis", description=__doc__.split("\n\n")[0], allow_abbrev=False)
    p.add_argument("--version", action="version", version=f"fastaxis {VERSION}")
    p.add_argument("--config", default="config.yaml", help="settings, a YAML file")
    for path, key in keys():
        if path in SHORT:
            p.add_argument(SHORT[path], f"--{path.split('.')[-1].replace('_', '-')}", dest=path, type=_value(key), help=f"in place of {path}")
    for name, said in FOLDERS.items():
        p.add_argument(f"--{name}", help=f"folder of {said}")
    p.add_argument("--once", action="store_true", help="stop when all events announced so far are done")
    return p


def settings(args: argparse.Namespace) -> Settings:
    """The file's settings, with what the command line says in their place."""
    given = load(args.config).to_dict()
    for path in SHORT:
        section, name = path.split(".")
        if getattr(args, path) is not None:
            given[section][name] = getattr(args, path)
    return build(given)


def start_logging(config: Settings) -> None:
    """To the console, and to a file where the settings name one."""
    sinks = {"console": {"class": "logging.StreamHandler", "formatter": "line"}}
    if config.logging.file:
        sinks["file"] = {"class": "logging.FileHandler", "formatter": "line", "filename": config.logging.file}
    line = {"format": "%(asctime)s %(levelname)s %(name)s %(message)s"}
    logging.config.dictConfig({"version": 1, "disable_existing_loggers": False, "formatters": {"line": line}, "handlers": sinks, "root": {"level": config.logging.level.upper(), "handlers": list(sinks)}})


def main(argv: Sequence[str] | None = None) -> int:
    p = parser()
    args = p.parse_args(argv)
    try:
        config = settings(args)
        if missing := [f"--{n}" for n in FOLDERS if getattr(args, n) is None]:
            p.error(f"{', '.join(missing)} must be given")
        start_logging(config)
    except (ConfigError, OSError, ValueError) as e:
        p.error(str(e))
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.appName("fastaxis").config("spark.sql.session.timeZone", "UTC").config("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider").getOrCreate()
    try:
        run(spark, args, config)
    finally:
        spark.stop()
    return 0


def run(spark, args: argparse.Namespace, config: Settings) -> None:
    """Starts the stream and waits for its end. Of the tables, published and channels may be missing."""
    from pyspark.errors import AnalysisException

    from fastaxis.operators import publish
    from fastaxis.operators.outbox import Outbox
    from fastaxis.operators.relational import Database
    from fastaxis.operators.store import Store
    from fastaxis.plans import picks, service
    from fastaxis.sources import archive, bus, velocity
    from fastaxis.streaming import debounce

    def table(name: str, demanded: bool = True):
        try:
            return spark.read.parquet(f"{args.tables}/{name}")
        except AnalysisException:
            if demanded:
                raise
            return None

    def catalogue() -> service.Catalogue:
        # What this service published before, and what others did.
        own, others = publish.commented(bus.messages(spark, args.bus, bus.COMMENTS)), table("published", False)
        published = own if others is None else own.unionByName(others.select("pick_id"))
        return service.Catalogue(*[table(n) for n in ("origins", "magnitudes", "arrivals", "picks", "stations")], published, table("channels", False))

    # Results go to a database where the environment names one; the outbox is a folder in any case.
    store = Database.of(spark, os.environ) if "POSTGRES_HOST" in os.environ else Store(spark, args.store)
    outbox = Outbox(spark, f"{args.store.rstrip('/')}/outcomes")
    store.init()
    number = store.begin_run(VERSION, config)
    model = velocity.profile(velocity.layers(spark, config.velocity_model.path))
    fetch = lambda wanted: archive.fetch(spark, config.sds.archive, wanted, config.waveform.t_before, config.waveform.t_after)
    process = service.processor(catalogue, picks.measurer(fetch, model, config), store, number, VERSION, args.bus, config.seiscomp.reprocess, outbox)
    announced = bus.follow(spark, args.bus)
    # A state that begins anew knows from the outbox which events are done.
    fired = debounce.debounced(announced, config.seiscomp.wait_time, handled=None if config.seiscomp.reprocess else outbox.handled())
    query = debounce.run_batches(fired, process, args.checkpoint)
    if args.once:
        debounce.drain(query, config.seiscomp.wait_time)
    else:
        query.awaitTermination()


if __name__ == "__main__":
    sys.exit(main())
