"""Stamped runs: a folder of tables with a manifest that tells what they were made from."""

from __future__ import annotations

import hashlib
import json
import re
from datetime import datetime
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from reqloom.contracts import ContractError
from reqloom.sources import store

_STAMP = re.compile(r"_(\d{8}_\d{6})(?:_\w+)?$")


def file_sha256(path: str | Path, block: int = 1 << 20) -> str:
    digest = hashlib.sha256()
    with open(path, "rb") as stream:
        while data := stream.read(block):
            digest.update(data)
    return digest.hexdigest()


def latest(folder: str | Path, prefix: str) -> str | Path:
    """The run of ``prefix`` with the newest stamp, by name. A word may follow the stamp."""
    runs = [n for n in store.folders(folder) if (m := _STAMP.search(n)) and n[: m.start()] == prefix]
    if not runs:
        raise FileNotFoundError(f"no run {prefix}_* in {folder}")
    return store.place(f"{folder}/{max(runs, key=lambda n: (_STAMP.search(n)[1], n))}")


class Run:
    """A run's folder, local or in a store that all executors reach. Begun once, never overwritten; ``finish`` writes its manifest last."""

    def __init__(self, path: str | Path):
        self.path = store.place(path)

    @classmethod
    def begin(cls, folder: str | Path, prefix: str, now: datetime | None = None) -> Run:
        run = cls(f"{folder}/{prefix}_{now or datetime.now():%Y%m%d_%H%M%S}")
        store.make_folder(run.path)
        return run

    def table(self, name: str) -> str:
        return f"{store.uri(self.path)}/{name}.parquet"

    def write(self, name: str, df: DataFrame, mode: str = "error") -> None:
        df.write.mode(mode).parquet(self.table(name))

    def read(self, spark: SparkSession, name: str) -> DataFrame:
        return spark.read.parquet(self.table(name))

    def mark(self, name: str) -> None:
        """Notes that a part of the run is done."""
        store.write_text(f"{self.path}/{name}_done", "")

    def marked(self, name: str) -> bool:
        return store.exists(f"{self.path}/{name}_done")

    def finish(self, manifest: dict) -> None:
        store.write_text(f"{self.path}/manifest.json", json.dumps(manifest, ensure_ascii=False, indent=2, sort_keys=True))

    def manifest(self) -> dict:
        if not store.exists(f"{self.path}/manifest.json"):
            raise FileNotFoundError(f"{self.path} has no manifest: it isn't finished")
        return json.loads(store.read_text(f"{self.path}/manifest.json"))

    def source(self, key: str) -> Run:
        """The run that the manifest names under ``key``."""
        named = self.manifest().get(key)
        if not named:
            raise ContractError(f"{self.path}: the manifest has no {key}")
        return Run(named)
