"""The change feed as a stream: ordered admission, and state kept by micro-batches."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

OUT = "shard int, seq long, ident string, body string, outcome string"


class Admission(StatefulProcessor):
    """One shard's deliveries (shard, seq, ident, body) in, outcomes out; admitted ones leave in order of seq, as `admitted`.

    State: the frontier, and deliveries ahead of it, at most `pending` and no further than `window` positions ahead.
    Of a delivery behind the frontier the outcome is old; of a repeat of one that waits, ok if it is equal, else conflicting-sequence.
    """

    def __init__(self, window: int = 128, pending: int = 128):
        self.window, self.pending = window, pending

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.frontier = handle.getValueState("frontier", "seq long")
        self.waiting = handle.getMapState("waiting", "seq long", "ident string, body string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        shard = key[0]
        front = self.frontier.get()[0] if self.frontier.exists() else 0
        held = {k[0]: v for k, v in self.waiting.iterator()}
        out = []
        for pdf in rows:
            for seq, ident, body in zip(pdf["seq"].tolist(), pdf["ident"].tolist(), pdf["body"].tolist(), strict=True):
                change = (ident, None if pd.isna(body) else body)
                if seq <= front:
                    outcome = "old"
                elif seq > front + self.window:
                    outcome = "retention-window"
                elif seq in held:
                    outcome = "ok" if tuple(held[seq]) == change else "conflicting-sequence"
                elif len(held) >= self.pending:
                    outcome = "pending-window"
                else:
                    outcome, held[seq] = "ok", change
                    self.waiting.updateValue((seq,), change)
                out.append((shard, seq, *change, outcome))
                while front + 1 in held:
                    front += 1
                    out.append((shard, front, *held.pop(front), "admitted"))
                    self.waiting.removeKey((front,))
        self.frontier.update((front,))
        yield pd.DataFrame(out, columns=["shard", "seq", "ident", "body", "outcome"])

    def close(self) -> None:
        pass


def stream_admit(deliveries: DataFrame, window: int = 128, pending: int = 128) -> DataFrame:
    """A streaming frame of deliveries -> their outcomes, and the admitted changes in order. Only (shard, seq, ident, body) goes through one shard's task."""
    return deliveries.select("shard", "seq", "ident", "body").groupBy("shard").transformWithStateInPandas(Admission(window, pending), OUT, "Append", "None")
