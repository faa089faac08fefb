"""Tracks from three relations (Parquet or JDBC), geometry bytes, and the admission of batches."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TRACK = "contribution_id long, user_id string, geom_type string, points array<struct<lon:double,lat:double>>"

# Geometry types of well-known binary.
TYPES = {1: "Point", 2: "LineString", 3: "Polygon", 4: "MultiPoint", 5: "MultiLineString", 6: "MultiPolygon", 7: "GeometryCollection"}


@dataclass(frozen=True)
class Relations:
    """Contributions (ContributionId, PointsGeom: points, or well-known binary), UserContributions (ContributionId, UserId) and Users
    (Id, UserIdentifier) as tables."""

    contributions: DataFrame
    user_contributions: DataFrame
    users: DataFrame

    @staticmethod
    def read(spark: SparkSession, folder: str) -> Relations:
        return Relations(*[spark.read.parquet(f"{folder}/{x}") for x in ("contributions", "user_contributions", "users")])

    def latest_and_next(self, last: int) -> tuple[int | None, int | None]:
        """The greatest id and the smallest one after last; nulls if there is none."""
        newer = self.contributions.where(F.col("ContributionId") > last)
        return tuple(newer.agg(F.max("ContributionId"), F.min("ContributionId")).first())

    def tracks(self, low: int, high: int) -> DataFrame:
        """contribution_id, user_id, points of low < id <= high."""
        rows = contribution_window(self.contributions, self.user_contributions, self.users, low, high)
        if dict(rows.dtypes)["geom"] == "binary":
            return decode_tracks(rows, "geom").where("geom_type = 'LineString'").drop("geom_type")
        return rows.select("contribution_id", "user_id", F.col("geom").alias("points"))


@dataclass(frozen=True)
class JdbcRelations:
    """The same three relations in a database, which joins them and finds ids by itself. geometry: SQL for the bytes."""

    spark: SparkSession
    url: str
    options: dict[str, str] = field(default_factory=dict)
    partitions: int = 8
    geometry: str = 'ST_AsBinary(c."PointsGeom")'

    def _query(self, sql: str):
        return self.spark.read.format("jdbc").option("url", self.url).option("dbtable", f"({sql}) t").options(**self.options)

    def latest_and_next(self, last: int) -> tuple[int | None, int | None]:
        ends = 'SELECT MAX("ContributionId") AS latest, MIN("ContributionId") AS earliest FROM "Contributions"'
        return tuple(self._query(f'{ends} WHERE "ContributionId" > {int(last)}').load().first())

    def tracks(self, low: int, high: int) -> DataFrame:
        joined = (
            f'SELECT c."ContributionId" AS contribution_id, u."UserIdentifier" AS user_id, {self.geometry} AS wkb FROM "Contributions" c '
            'JOIN "UserContributions" uc ON uc."ContributionId" = c."ContributionId" JOIN "Users" u ON u."Id" = uc."UserId" '
            f'WHERE c."ContributionId" > {int(low)} AND c."ContributionId" <= {int(high)}'
        )
        reader = self._query(joined).option("partitionColumn", "contribution_id").option("numPartitions", self.partitions)
        rows = reader.option("lowerBound", low + 1).option("upperBound", high + 1).load().toDF("contribution_id", "user_id", "wkb")
        return decode_tracks(rows).where("geom_type = 'LineString'").drop("geom_type")


def contribution_window(contributions: DataFrame, user_contributions: DataFrame, users: DataFrame, low: int, high: int) -> DataFrame:
    """The columns of contributions and UserIdentifier as user_id for low < id <= high, a row per user; null geometries are left out.

    contributions: ContributionId, PointsGeom; user_contributions: ContributionId, UserId; users: Id, UserIdentifier.
    """
    c = contributions.where((F.col("ContributionId") > low) & (F.col("ContributionId") <= high) & F.col("PointsGeom").isNotNull())
    out = c.join(user_contributions, "ContributionId").join(users, F.col("UserId") == F.col("Id"))
    return out.select(F.col("ContributionId").alias("contribution_id"), F.col("UserIdentifier").alias("user_id"), F.col("PointsGeom").alias("geom"))


def latest_contribution(contributions: DataFrame) -> DataFrame:
    """One row: latest and earliest id, null if there are none."""
    return contributions.agg(F.max("ContributionId").alias("latest"), F.min("ContributionId").alias("earliest"))


def decode_wkb(data: bytes | None) -> tuple[str | None, list[tuple[float, float]]]:
    """Type and points of a geometry in (extended) well-known binary; points of line strings only. Null, or bytes that are none: (None, [])."""
    try:
        order = "<" if data[0] == 1 else ">"
        (kind,) = struct.unpack_from(order + "I", data, 1)
        at, size = 5 + 4 * bool(kind & 0x20000000), 2 + bool(kind & 0x80000000) + bool(kind & 0x40000000)
        base = kind & 0x0FFFFFFF
        size += (base // 1000 in (1, 2)) + 2 * (base // 1000 == 3)
        name = TYPES.get(base % 1000)
        if name != "LineString":
            return name, []
        (n,) = struct.unpack_from(order + "I", data, at)
        flat = struct.unpack_from(f"{order}{n * size}d", data, at + 4)
        return name, list(zip(flat[::size], flat[1::size], strict=True))
    except (TypeError, IndexError, struct.error):
        return None, []


def decode_tracks(rows: DataFrame, wkb: str = "wkb") -> DataFrame:
    """contribution_id, user_id, geom_type and points of rows with geometry bytes; rows without geometry are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [decode_wkb(x) for x in batch.column(2).to_pylist()]
            points = [[{"lon": x, "lat": y} for x, y in p] for _, p in found]
            kind = pa.list_(pa.struct([("lon", pa.float64()), ("lat", pa.float64())]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([t for t, _ in found], pa.string()), pa.array(points, kind)],
                names=["contribution_id", "user_id", "geom_type", "points"],
            )

    given = rows.where(F.col(wkb).isNotNull()).select(F.col("contribution_id").cast("long"), F.col("user_id").cast("string"), wkb)
    return given.mapInArrow(run, TRACK).where("geom_type is not null")


def admitted(rows: DataFrame, max_users: int) -> DataFrame:
    """The rows (contribution_id, user_id, ...) of a window up to the first id that brings in user number max_users + 1.

    Users count in the order of (id, user). Ids are never divided: an id that alone has more users than allowed comes whole if it
    is the first one. Nothing is sorted but the users' first ids.
    """
    firsts = rows.groupBy("user_id").agg(F.min("contribution_id").alias("first")).orderBy("first", "user_id").limit(max_users + 1)
    cut = firsts.agg(
        F.when(F.count(F.lit(1)) > max_users, F.max("first")).alias("cut"), F.min("first").alias("start")
    )
    bound = cut.select(F.when(F.col("cut") == F.col("start"), F.col("start") + 1).otherwise(F.col("cut")).alias("cut"))
    return rows.join(F.broadcast(bound), F.col("cut").isNull() | (F.col("contribution_id") < F.col("cut"))).drop("cut")


def next_window(latest: int | None, next_id: int | None, last: int, max_contributions: int) -> tuple[int, int] | None:
    """(low, high] of the next batch, None if nothing is new. A gap in the ids is skipped: the window ends max_contributions
    ids behind the next one that is there."""
    if latest is None or latest <= last or next_id is None:
        return None
    return next_id - 1, min(latest, next_id - 1 + max_contributions)
