"""python -m trackweave.streaming [--key value]...: the polled job, by settings from arguments and TRACKWEAVE_ variables (see JobConfig)."""

from __future__ import annotations

import logging
import re
import sys
from pathlib import Path

from pyspark.sql import SparkSession

from trackweave.config import JobConfig, Raster
from trackweave.sources.tracks import JdbcRelations, Relations
from trackweave.streaming.job import run
from trackweave.streaming.store import Store


def uri(folder: str) -> str:
    """A folder without a scheme is one of this machine."""
    return folder if re.match(r"[a-z][a-z0-9+.-]*://", folder) else Path(folder).absolute().as_uri()


def main(arguments: list[str], spark: SparkSession | None = None) -> int:
    """Reads the database whose connection string lies in the file `db`, else Parquet below data/relations; keeps its tables in
    data/store and publishes tiles to output."""
    if len(arguments) % 2 or any(not k.startswith("--") for k in arguments[::2]):
        print(__doc__, file=sys.stderr)
        return 2
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(levelname)s %(name)s: %(message)s")
    config = JobConfig.load({k[2:]: v for k, v in zip(arguments[::2], arguments[1::2], strict=True)})
    spark = spark or SparkSession.builder.appName("trackweave").getOrCreate()
    data, raster = uri(config.data), Raster()
    store = Store(spark, f"{data}/store", raster.resolution)
    read = (lambda: JdbcRelations(spark, config.connection_string())) if config.db else lambda: Relations.read(spark, f"{data}/relations")
    run(store, read, config, raster, output=uri(config.output))
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
