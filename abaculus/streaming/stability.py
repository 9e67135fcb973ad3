"""Files that have stopped growing (S26, T2), and counterparties that come often, as streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from abaculus.session import ship_package

STATE = "size long, modified long, since double, last double, passed boolean"


def stable_files(listings: DataFrame, seconds: float) -> DataFrame:
    """(path, size, seen_at) of files whose size and time have stayed for ``seconds``, once until they change again.

    ``listings`` is a stream of what repeated listings of a folder have seen: path, size, modified (long), seen_at (timestamp) and
    locked (boolean). A file that is locked starts anew, and so does one whose size or time differs. What was seen
    before the latest of its file is left out. The state is five values per file.
    """
    ship_package(listings.sparkSession)

    def follow(key: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        size, modified, since, last, passed = state.get if state.exists else (None, None, None, float("-inf"), False)
        seen = pd.concat(list(parts)).sort_values(["at", "size", "modified"], kind="stable")  # one file's listings of one batch
        out = []
        for r in seen.itertuples(index=False):
            if r.at < last:
                continue
            if r.locked or (r.size, r.modified) != (size, modified):
                size, modified, since, passed = (None, None, None, False) if r.locked else (r.size, r.modified, r.at, False)
            elif not passed and r.at - since >= seconds:
                passed = True
                out.append((key[0], int(size), r.at))
            last = r.at
        state.update((None if size is None else int(size), None if modified is None else int(modified), since, float(last), bool(passed)))
        if out:
            yield pd.DataFrame(out, columns=["path", "size", "at"])

    rows = listings.select("path", "size", "modified", F.coalesce("locked", F.lit(False)).alias("locked"), (F.unix_micros("seen_at") / 1e6).alias("at"))
    found = rows.groupBy("path").applyInPandasWithState(follow, "path string, size long, at double", STATE, "append", "NoTimeout")
    return found.select("path", "size", F.timestamp_micros(F.round(F.col("at") * 1e6).cast("long")).alias("seen_at"))


def frequent(stream: DataFrame, days: int, least: int, late: str, *keys: str) -> DataFrame:
    """(window, keys, n): spans of ``days`` days, one starting each day, in which the keys have ``least`` rows or more.

    Counts are partial sums per key and span; the watermark ends spans, drops their state, and leaves out rows later than that.
    """
    spans = stream.withWatermark("ts", late).groupBy(F.window("ts", f"{days} days", "1 day"), *keys).agg(F.count(F.lit(1)).alias("n"))
    return spans.where(F.col("n") >= least)
