"""Progress of running streams."""

from __future__ import annotations

from pyspark.sql.streaming import StreamingQueryListener


class Progress(StreamingQueryListener):
    """Keeps the last rows-per-second figures and the totals of each query."""

    def __init__(self, history: int = 30):
        self.history, self.rates, self.rows, self.ended = history, {}, {}, set()

    def onQueryStarted(self, event):
        self.rates[str(event.id)], self.rows[str(event.id)] = [], 0

    def onQueryProgress(self, event):
        p = event.progress
        rates = self.rates.setdefault(str(p.id), [])
        rates.append(p.processedRowsPerSecond)
        del rates[: -self.history]
        self.rows[str(p.id)] = self.rows.get(str(p.id), 0) + p.numInputRows

    def onQueryIdle(self, event):
        pass

    def onQueryTerminated(self, event):
        self.ended.add(str(event.id))
