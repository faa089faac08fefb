"""Contributions as a stream whose offsets are contribution ids, read from the three relations on Parquet."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset as ds
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from trackweave.sources.tracks import decode_wkb, next_window

FORMAT = "trackweave_contributions"
SCHEMA = "contribution_id long, user_id string, points array<struct<lon:double,lat:double>>"
POINTS = pa.list_(pa.struct([("lon", pa.float64()), ("lat", pa.float64())]))
ARROW = pa.schema([("contribution_id", pa.int64()), ("user_id", pa.string()), ("points", POINTS)])


class ParquetRelations:
    """Folders contributions, user_contributions and users below a folder (a URI), by ranges of ids: row groups that hold other ids are
    passed over."""

    def __init__(self, folder: str) -> None:
        self.folder = folder

    def _table(self, name: str) -> ds.Dataset:
        store, root = fs.FileSystem.from_uri(self.folder)
        return ds.dataset(f"{root}/{name}", format="parquet", filesystem=store)

    def after(self, last: int) -> int | None:
        """The smallest id after last: looked for in ranges that double, so that what is read does not grow with what waits."""
        ids, column = self._table("contributions"), pc.field("ContributionId")
        if not ids.head(1, columns=["ContributionId"], filter=column > last).num_rows:
            return None
        low, width = last, 1024
        while True:
            found = pc.min(ids.to_table(columns=["ContributionId"], filter=(column > low) & (column <= low + width)).column(0)).as_py()
            if found is not None:
                return found
            low, width = low + width, 2 * width

    def any_after(self, last: int) -> bool:
        return self._table("contributions").head(1, columns=["ContributionId"], filter=pc.field("ContributionId") > last).num_rows > 0

    def latest_up_to(self, low: int, high: int) -> int | None:
        """The greatest id of low < id <= high."""
        column = pc.field("ContributionId")
        return pc.max(self._table("contributions").to_table(columns=["ContributionId"], filter=(column > low) & (column <= high)).column(0)).as_py()

    def tracks(self, low: int, high: int) -> list[tuple[int, str, list]]:
        """contribution_id, user_id, points of low < id <= high, by (id, user); geometries that are null or no line strings are left out."""
        within = (pc.field("ContributionId") > low) & (pc.field("ContributionId") <= high)
        drawn = self._table("contributions").to_table(columns=["ContributionId", "PointsGeom"], filter=within & ~pc.field("PointsGeom").is_null())
        lines: dict[int, list[list]] = {}
        for i, geometry in zip(*[drawn.column(k).to_pylist() for k in range(2)], strict=True):
            if isinstance(geometry, bytes):
                kind, points = decode_wkb(geometry)
                if kind != "LineString":
                    continue
                geometry = [{"lon": x, "lat": y} for x, y in points]
            lines.setdefault(i, []).append(geometry)
        links = self._table("user_contributions").to_table(columns=["ContributionId", "UserId"], filter=within)
        users = self._table("users").to_table(columns=["Id", "UserIdentifier"], filter=pc.field("Id").isin(pc.unique(links.column("UserId"))))
        names: dict[int, list[str]] = {}
        for i, name in zip(*[users.column(k).to_pylist() for k in range(2)], strict=True):
            names.setdefault(i, []).append(name)
        pairs = zip(*[links.column(k).to_pylist() for k in range(2)], strict=True)
        out = [(i, str(name), points) for i, user in pairs for points in lines.get(i, ()) for name in names.get(user, ())]
        return sorted(out, key=lambda r: (r[0], r[1]))


def end_of_batch(source: ParquetRelations, last: int, max_contributions: int, max_users: int) -> int:
    """The id up to which the next batch after last goes, last if nothing is new: a gap in the ids is skipped, then max_contributions
    ids, but no further than before the first one that brings in user number max_users + 1; ids are never divided. What is
    read is bounded by max_contributions."""
    following = source.after(last)
    if following is None:
        return last
    end = following - 1 + max_contributions
    latest = end if source.any_after(end) else source.latest_up_to(last, end)
    low, high = next_window(latest, following, last, max_contributions)
    seen: set[str] = set()
    rows = source.tracks(low, high)
    for i, user, _ in rows:
        seen.add(user)
        if len(seen) > max_users:
            before = [j for j, _, _ in rows if j < i]
            return before[-1] if before else i
    return high


@dataclass
class IdRange(InputPartition):
    low: int
    high: int


class ContributionReader(DataSourceStreamReader):
    """Offsets are {"id": the last id read}. Spark tells a restarted query's offset by partitions() before it asks for the latest one."""

    def __init__(self, options: dict) -> None:
        self.source, self.first = ParquetRelations(options["path"]), int(options.get("after", -1))
        self.contributions, self.users = int(options.get("maxcontributions", 10)), int(options.get("maxusers", 2))
        self.parts, self.at = int(options.get("partitions", 8)), None

    def initialOffset(self) -> dict:
        return {"id": self.first}

    def latestOffset(self) -> dict:
        self.at = end_of_batch(self.source, self.first if self.at is None else self.at, self.contributions, self.users)
        return {"id": self.at}

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        low, high = int(start["id"]), int(end["id"])
        self.at = high if self.at is None else max(self.at, high)
        width = max(1, -(-(high - low) // self.parts))
        return [IdRange(x, min(x + width, high)) for x in range(low, high, width)]

    def read(self, partition: IdRange) -> Iterator[pa.RecordBatch]:
        rows = self.source.tracks(partition.low, partition.high)
        columns = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(ARROW.types)]
        yield pa.RecordBatch.from_arrays(columns, schema=ARROW)

    def commit(self, end: dict) -> None:
        """Nothing is held back."""


class ContributionSource(DataSource):
    """Options: path (of the relations), after (the id behind which a new query starts), maxContributions and maxUsers of a batch,
    partitions. A row for each line string and user: contribution_id, user_id, points."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> DataSourceStreamReader:
        return ContributionReader({k.lower(): v for k, v in self.options.items()})


def contribution_stream(spark: SparkSession, folder: str, max_contributions: int = 10, max_users: int = 2, after: int = -1):
    """The tracks of the relations below a folder as a stream, in the batches that polling would take."""
    spark.dataSource.register(ContributionSource)
    options = {"path": folder, "after": after, "maxContributions": max_contributions, "maxUsers": max_users}
    return spark.readStream.format(FORMAT).options(**options).load()
