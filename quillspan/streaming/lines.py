"""Line protocols over a stream: a line that is cut by a micro-batch is carried in the state store."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quillspan.session import importable

STATE = "seq long, line long, open string, closed boolean, seqs array<long>, bodies array<string>, lasts array<boolean>"


def _assemble(prefix: str):
    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seq, line, rest, closed, seqs, bodies, lasts = state.get if state.exists else (0, 0, "", False, [], [], [])
        waiting = dict(zip(seqs, zip(bodies, lasts, strict=True), strict=True))
        for frame in frames:
            for at, body, last in zip(frame["seq"].tolist(), frame["body"].tolist(), frame["last"].tolist(), strict=True):
                if at >= seq:  # what was taken before is a copy
                    waiting[at] = (body or "", bool(last))
        rows = []

        def take(text: str) -> None:
            nonlocal line
            if text.startswith(prefix):
                rows.append((key[0], line, text[len(prefix) :].strip(" ")))
                line += 1

        while not closed and seq in waiting:
            body, closed = waiting.pop(seq)
            *whole, rest = (rest + body).split("\n")
            seq += 1
            for text in whole:
                take(text.removesuffix("\r"))
            if closed:
                take(rest.strip())
                rest = ""
        if closed:
            waiting = {}
        order = sorted(waiting)
        state.update((seq, line, rest, closed, order, [waiting[k][0] for k in order], [waiting[k][1] for k in order]))
        yield pd.DataFrame(rows, columns=["key", "line", "payload"])

    return update


def event_lines_stream(chunks: DataFrame, key: str, prefix: str = "data:") -> DataFrame:
    """``wire.event_lines`` for a stream of chunks: key, line, payload, each line as soon as it has ended.

    ``chunks``: key, seq (from 0, without gaps), body, last (true for the body's last chunk, whose open line counts, too). Chunks may be cut anywhere, may
    come twice, and may come before earlier ones: those wait in the state. A body's state is its open line and what waits.
    """
    importable(chunks.sparkSession)
    kind = chunks.schema[key].dataType.simpleString()
    out = chunks.select(key, "seq", "body", "last").groupBy(key).applyInPandasWithState(
        _assemble(prefix), f"key {kind}, line long, payload string", STATE, "append", GroupStateTimeout.NoTimeout
    )
    return out.withColumnRenamed("key", key)
