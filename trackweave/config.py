"""Settings of the raster and of the batch job."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, fields

UINT32 = 4294967295


@dataclass(frozen=True)
class Raster:
    """zoom: of the base level. resolution: pixels along a tile's side; even, so that levels nest."""

    zoom: int = 14
    resolution: int = 512

    def __post_init__(self) -> None:
        if self.resolution < 2 or self.resolution % 2:
            raise ValueError("resolution must be even")
        if not 0 <= self.zoom <= 24:
            raise ValueError("zoom must be 0 to 24")


@dataclass(frozen=True)
class Semantics:
    """intended: exact 64-bit sums. compat: 32-bit wrap and saturation, doubling merges, and trips that carry into users."""

    mode: str = "intended"

    def __post_init__(self) -> None:
        if self.mode not in ("intended", "compat"):
            raise ValueError("mode must be intended or compat")

    @property
    def compat(self) -> bool:
        return self.mode == "compat"


@dataclass(frozen=True)
class JobConfig:
    """db: file that holds the connection string. min_users: privacy threshold of a base pixel. max_contributions: ids of one
    batch. max_users: users of one batch. refresh_ms: wait when idle; 0 runs once. data, output: folders."""

    db: str = ""
    min_users: int = 3
    max_contributions: int = 10
    max_users: int = 2
    refresh_ms: int = 1000
    data: str = "data"
    output: str = "output"

    @staticmethod
    def load(values: Mapping[str, str] | None = None, env: Mapping[str, str] | None = None, prefix: str = "TRACKWEAVE_") -> JobConfig:
        """From values, then environment variables named prefix + key, over the defaults; keys ignore case, - is _."""
        env = os.environ if env is None else env
        given = {k.lower().replace("-", "_"): v for k, v in (values or {}).items()}
        given |= {k[len(prefix) :].lower().replace("-", "_"): v for k, v in env.items() if k.startswith(prefix)}
        given["refresh_ms"] = given.pop("refresh_time", given.get("refresh_ms", JobConfig.refresh_ms))
        kinds = {f.name: type(f.default) for f in fields(JobConfig)}
        return JobConfig(**{k: kinds[k](v) for k, v in given.items() if k in kinds})

    def connection_string(self) -> str:
        with open(self.db) as f:
            return f.read().strip()
