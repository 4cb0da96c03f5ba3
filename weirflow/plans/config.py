"""Settings of a deployment, as JSON: where the data is, whose it is, and the digest key."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field
from pathlib import Path

from pyspark.sql import SparkSession

from ..model import AlreadyExists, InvalidRequest
from ..sources.commitlog import HadoopStore, LocalStore, Store


@dataclass(frozen=True)
class Config:
    """S23, D1, D2. The key isn't shown when the settings are printed."""

    tenant: str
    root: str
    backend: str = "local"
    digest_key: str = field(default="", repr=False)

    def __post_init__(self) -> None:
        if self.backend not in ("local", "hadoop") or not self.tenant or "/" in self.tenant:
            raise InvalidRequest(f"config {self}")

    def save(self, path: str | Path) -> None:
        """Never overwrites."""
        try:
            with Path(path).open("x") as f:
                json.dump(asdict(self), f, indent=1)
        except FileExistsError:
            raise AlreadyExists(str(path)) from None

    @staticmethod
    def load(path: str | Path) -> Config:
        told = json.loads(Path(path).read_text())
        if set(told) - set(Config.__dataclass_fields__):
            raise InvalidRequest("unknown settings")
        return Config(**told)

    def store(self, spark: SparkSession) -> Store:
        """The tenant's control files."""
        at = f"{self.root.rstrip('/')}/{self.tenant}"
        return LocalStore(at.removeprefix("file://")) if self.backend == "local" else HadoopStore(spark, at)
