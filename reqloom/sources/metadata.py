"""Per-record metadata from elsewhere: fetched on the executors, resumable."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Mapping

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reqloom.sources.schemas import METADATA

Fetcher = Callable[[str], Mapping]


def pending(records: DataFrame, resume: bool = True) -> DataFrame:
    """Records to fetch: all, or those without status ``ok``."""
    return records.where(F.coalesce(F.col("metadata_status"), F.lit("")) != "ok") if resume else records


def fetch_metadata(records: DataFrame, fetch: Fetcher, delay: float = 0.0, resume: bool = True, limit: int | None = None) -> DataFrame:
    """``records`` with ``youtube_metadata`` and its status from ``fetch(url)``.

    A failure leaves the record with status ``error`` and the first 500
    characters of what went wrong. With ``resume`` records of status ``ok`` stay
    as they are; ``limit`` is how many are fetched, in order of their urls.
    """
    wanted = pending(records, resume)
    done = records.where(F.coalesce(F.col("metadata_status"), F.lit("")) == "ok") if resume else records.limit(0)
    if limit is not None:
        chosen = wanted.orderBy("url").limit(limit)
        done, wanted = done.unionByName(wanted.exceptAll(chosen)), chosen
    names = [x.split()[0] for x in METADATA.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for url in batch["url"]:
                try:
                    found = fetch(url)
                    rows.append(({k: found.get(k) for k in names}, "ok", None))
                except Exception as error:
                    rows.append((None, "error", str(error)[:500]))
                if delay:
                    time.sleep(delay)
            out = batch.copy()
            out["youtube_metadata"] = [r[0] for r in rows]
            out["metadata_status"], out["metadata_error"] = [r[1] for r in rows], [r[2] for r in rows]
            yield out

    return done.unionByName(wanted.mapInPandas(run, records.schema))
