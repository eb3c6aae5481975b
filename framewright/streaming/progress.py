"""Progress of streaming queries: rows and seconds of each batch, kept and, if asked, printed every so many rows."""

from __future__ import annotations

from pyspark.sql.streaming import StreamingQueryListener


class Progress(StreamingQueryListener):
    def __init__(self, every: int = 100, show=print):
        self.every, self.show, self.rows, self.batches = every, show, 0, []

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        before, self.rows = self.rows, self.rows + p.numInputRows
        self.batches.append((p.batchId, p.numInputRows, p.processedRowsPerSecond))
        if self.rows // self.every > before // self.every:
            self.show(f"{self.rows} rows, {p.processedRowsPerSecond:.1f} a second")

    def onQueryTerminated(self, event) -> None:
        pass
