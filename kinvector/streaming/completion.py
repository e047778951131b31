"""When all streams of a job are done."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor

from kinvector.streaming.gallery import ROCKS

FINISHED = "job_id long, streams long, frames long"


class Completion(StatefulProcessor):
    """Frames received and frames announced of each stream of a job, until they are equal for all ``streams``.

    An end marker says how many frames its stream has sent. It may come before
    the last of them, so a job is done when the frames are there and not when the
    markers are; then its state is dropped.
    """

    def __init__(self, streams: int):
        self.streams = streams

    def init(self, handle) -> None:
        self.seen = handle.getMapState("seen", "stream_id long", "received long, announced long")
        self.done = handle.getValueState("done", "frames long")

    def handleInputRows(self, key, rows, timerValues):
        if self.done.exists():
            return
        for pdf in rows:
            for stream, part in pdf.groupby("stream_id"):
                received, announced = self.seen.getValue((int(stream),)) if self.seen.containsKey((int(stream),)) else (0, None)
                ends = part["announced"].dropna()
                announced = int(ends.iloc[-1]) if len(ends) else announced
                self.seen.updateValue((int(stream),), (received + int(part["announced"].isna().sum()), announced))
        held = [tuple(v) for _, v in self.seen.iterator()]
        if len(held) == self.streams and all(r == a for r, a in held):
            frames = sum(r for r, _ in held)
            self.done.update((frames,))
            self.seen.clear()
            yield pd.DataFrame([(int(key[0]), self.streams, frames)], columns=["job_id", "streams", "frames"])

    def close(self) -> None:
        pass


def finished(rows: DataFrame, streams: int) -> DataFrame:
    """A row for each job when all its ``streams`` have sent all their frames.

    ``rows`` is a stream of frames (job_id, stream_id, announced null) and end
    markers (announced: how many frames the stream has), in any order.
    """
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    return rows.select("job_id", "stream_id", "announced").groupBy("job_id").transformWithStateInPandas(Completion(streams), FINISHED, "append", "None")
