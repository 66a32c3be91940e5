"""Message ingestion as keyed state, in Structured Streaming and in batch."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OUTPUT = "conversation_id string, message_id string, us bigint, decision string, episode_id string"
_STATE = "seen int, current int, centroid array<double>, last_us bigint, dormant array<string>, last_id string"
# Thresholds of the double gate and of the reactivation of a dormant episode, the weight of the old centroid.
LOW, HIGH, REACTIVATE, KEEP = 0.35, 0.65, 0.75, 0.85
#: Dormant episodes that a conversation can reactivate: the latest, as the reference's search looks at.
MOST_DORMANT = 20


@dataclass
class Conversation:
    """State of one conversation: number of episodes, the current one and its centroid, closed ones with centroids."""

    seen: int = 0
    current: int = 0
    centroid: list[float] | None = None
    last_us: int = 0
    dormant: list[tuple[int, list[float]]] = None
    last_id: str = ""

    def __post_init__(self):
        self.dormant = self.dormant or []

    def step(self, us: int, vec, p: float | None) -> tuple[str, int]:
        """Decision for a message with boundary probability ``p``: append, new, reactivate, or the slow path."""
        self.last_us = max(self.last_us, us)
        v = np.asarray(vec, dtype=float) if vec is not None else None
        if self.current == 0:
            return "NEW", self._open(v)
        if p is not None and LOW <= p <= HIGH:
            return "SLOW_PATH", self.current
        if p is not None and p > HIGH:
            best, best_no = REACTIVATE, None
            if v is not None:
                for no, c in self.dormant:
                    c = np.asarray(c)
                    d = float(np.linalg.norm(c) * np.linalg.norm(v))
                    s = float(c @ v) / d if d > 1e-9 and len(c) == len(v) else 0.0
                    if s > best:
                        best, best_no = s, no
            self._close()
            if best_no is not None:
                self.centroid = next(list(c) for no, c in self.dormant if no == best_no)
                self.dormant = [x for x in self.dormant if x[0] != best_no]
                self.current = best_no
                return "REACTIVATE", best_no
            return "NEW", self._open(v)
        if v is not None:
            old = np.asarray(self.centroid) if self.centroid is not None else None
            self.centroid = (v if old is None or len(old) != len(v) else KEEP * old + (1 - KEEP) * v).tolist()
        return "APPEND", self.current

    def _open(self, v) -> int:
        self.seen += 1
        self.current, self.centroid = self.seen, v.tolist() if v is not None else None
        return self.current

    def _close(self) -> None:
        if self.centroid is not None:
            self.dormant = (self.dormant + [(self.current, self.centroid)])[-MOST_DORMANT:]

    def pack(self) -> tuple:
        closed = [f"{no}:" + ",".join(repr(float(x)) for x in c) for no, c in self.dormant]
        return (self.seen, self.current, self.centroid, self.last_us, closed, self.last_id)

    @classmethod
    def unpack(cls, t: tuple) -> "Conversation":
        closed = [(int(s.split(":")[0]), [float(x) for x in s.split(":")[1].split(",")]) for s in (t[4] if t[4] is not None else [])]
        return cls(int(t[0]), int(t[1]), list(t[2]) if t[2] is not None else None, int(t[3]), closed, t[5] or "")


def _advance(state: Conversation, key: str, pdf: pd.DataFrame) -> list[tuple]:
    out = []
    for m, us, vec, p in zip(pdf["message_id"], pdf["us"], pdf["vec"], pdf["boundary"]):
        decision, no = state.step(int(us), vec, None if p is None or p != p else float(p))
        out.append((key, m, int(us), decision, f"{key}/{no}"))
    return out


def ingest_batch(messages: DataFrame) -> DataFrame:
    """Batch twin: ``conversation_id, message_id, us, vec, boundary`` in time order per conversation.

    Conversations stream through a task one after the other, so memory holds one state, never a group.
    """
    ordered = messages.where("conversation_id is not null and us is not null").repartition("conversation_id").sortWithinPartitions("conversation_id", "us", "message_id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state = None, None
        for pdf in batches:
            out = []
            for conversation, part in pdf.groupby("conversation_id", sort=False):
                if conversation != key:
                    key, state = conversation, Conversation()
                out += _advance(state, conversation, part)
            yield pd.DataFrame(out, columns=[c.split()[0] for c in OUTPUT.split(", ")])

    return ordered.mapInPandas(run, OUTPUT)


def ingest_stream(messages: DataFrame, lateness: str = "24 hours", idle_ms: int = 24 * 3600 * 1000) -> DataFrame:
    """Streaming form with keyed state. ``messages`` needs ``sent_at timestamp`` beside the batch columns.

    Rows later than the watermark are dropped; those of one trigger are put in time order. A
    conversation idle in event time for ``idle_ms`` closes its episode, so the next message opens one.
    """
    from pyspark.sql.streaming.state import GroupStateTimeout

    def update(key, batches, state):
        conversation = key[0]
        current = Conversation.unpack(state.get) if state.exists else Conversation()
        if state.hasTimedOut:
            current._close()
            current.current, current.centroid = 0, None
            state.update(current.pack())
            return
        rows = pd.concat(list(batches)).sort_values(["us", "message_id"])
        out = _advance(current, conversation, rows)
        state.update(current.pack())
        state.setTimeoutTimestamp(max(current.last_us // 1000 + idle_ms, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in OUTPUT.split(", ")])

    rows = messages.where("conversation_id is not null and us is not null").withWatermark("sent_at", lateness)
    return rows.groupBy("conversation_id").applyInPandasWithState(update, OUTPUT, _STATE, "append", GroupStateTimeout.EventTimeTimeout)


def upsert_sink(path: str):
    """``foreachBatch`` writer: a batch that is delivered again overwrites its own files, so each counts once."""

    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    return write


def session_windows(events: DataFrame, gap: str = "30 minutes", lateness: str = "24 hours") -> DataFrame:
    """Sessions of a stream (or of a batch) by Spark's own session window, with late data up to ``lateness``."""
    return events.withWatermark("ts", lateness).groupBy(F.session_window("ts", gap), "user_id").agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")
