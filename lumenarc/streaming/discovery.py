"""Media and sidecars that arrive in any order, matched as a stream.

Both are keyed by folder and by the start of a name that every strategy keeps,
so all that can belong together meets in one state. A file leaves the state
with its sidecar once that of its first choice is there, else when the
watermark has passed its time by ``wait``: then with the best so far, or none.
Sidecars leave when the last file that may still want one has. A file is given
out once, and what has been given out does not depend on the order of arrival.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lumenarc.functions import names
from lumenarc.operators import matching
from lumenarc.runtime import ship

EVENTS = ["dir", "root", "at", "file_id", "name", "wanted", "json_name"]
OUT = "file_id string, dir string, name string, json_name string, strategy string"


def folder_kind(folder: Column, path: Column) -> Column:
    """special, year or album: what discovery does with a folder's files."""
    return F.when(names.special_folder(path).isNotNull(), "special").when(names.is_canonical(folder), "year").otherwise("album")


def events(media: DataFrame, sidecars: DataFrame, tryhard: bool = False) -> DataFrame:
    """One stream of media(file_id, dir, name, at) and sidecars(dir, json_name, at), keyed by dir and root."""
    choices = matching.sidecar_names(F.col("name"), matching.STRATEGIES if tryhard else matching.STRATEGIES[: matching.BASIC])
    none = F.lit(None).cast("string")
    files = media.select("dir", matching.root_of(F.col("name")).alias("root"), "at", F.col("file_id").cast("string").alias("file_id"), "name", F.to_json(choices).alias("wanted"), none.alias("json_name"))
    found = sidecars.select("dir", matching.root_of(F.col("json_name")).alias("root"), "at", none.alias("file_id"), none.alias("name"), none.alias("wanted"), "json_name")
    return files.unionByName(found)


def matched(stream: DataFrame, wait: str = "10 minutes") -> DataFrame:
    """file_id, dir, name, json_name, strategy of each file among ``events``: once, in append mode.

    ``wait`` is how far apart the times (column ``at``) of a file and its
    sidecar may be, and how late a row may come: the watermark is so far behind,
    and rows from before it are not looked at. Without a sidecar both are null.
    A null folder, name or time is no event.
    """
    ship(stream.sparkSession)
    patience = int(pd.Timedelta(wait).total_seconds() * 1000)

    def choose(wanted: list, there: set) -> tuple | None:
        return next(((c["json_name"], c["strategy"]) for c in wanted if c["json_name"] in there), None)

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        pending, there = (json.loads(x) for x in state.get) if state.exists else ({}, {})
        now, out = state.getCurrentWatermarkMs(), []

        def settle(least: Callable[[dict, tuple | None], bool]) -> None:
            for file_id in sorted(pending):
                of = pending[file_id]
                best = choose(of["wanted"], there.keys())
                if least(of, best):
                    out.append((file_id, key[0], pending.pop(file_id)["name"], *(best or (None, None))))

        # Whose time is up does not see what this batch brings.
        settle(lambda of, best: of["at"] <= now)
        for frame in frames:
            for at, file_id, name, wanted, json_name in frame[["at", "file_id", "name", "wanted", "json_name"]].itertuples(index=False, name=None):
                ms = int(at.timestamp() * 1000)
                if isinstance(file_id, str):
                    pending[file_id] = {"name": name, "wanted": json.loads(wanted), "at": ms}
                else:
                    there[json_name] = max(ms + patience, there.get(json_name, 0))
        settle(lambda of, best: best is not None and best[0] == of["wanted"][0]["json_name"])
        # A sidecar may serve files that come up to ``wait`` after it.
        there = {n: until for n, until in there.items() if until > now or pending}
        if pending or there:
            state.update((json.dumps(pending), json.dumps(there)))
            state.setTimeoutTimestamp(max(now + 1, min([of["at"] for of in pending.values()] or [max(there.values())])))
        elif state.exists:
            state.remove()
        yield pd.DataFrame(out, columns=["file_id", "dir", "name", "json_name", "strategy"], dtype=object)

    usable = stream.filter("dir IS NOT NULL AND root IS NOT NULL AND at IS NOT NULL AND (name IS NOT NULL OR json_name IS NOT NULL)")
    keyed = usable.withWatermark("at", wait).groupBy("dir", "root")
    return keyed.applyInPandasWithState(step, OUT, "pending string, there string", "append", GroupStateTimeout.EventTimeTimeout)


def discovered(found: DataFrame) -> DataFrame:
    """matched files with ``kind`` of their folder, whose names are the last of ``dir``; years come before albums and special folders."""
    kind = folder_kind(names.base_name(F.col("dir")), F.concat_ws("/", "dir", "name"))
    rank = F.when(kind == "year", 0).when(kind == "album", 1).otherwise(2)
    return found.select("*", kind.alias("kind"), rank.alias("phase"))
