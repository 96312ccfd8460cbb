"""Model health over a stream of calls: state per model in the streaming state store."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quillspan.operators.routing import ENDING, REFUSED, REST_OTHER_S, REST_S, STRIKES
from quillspan.session import importable

OUT = "model string, at_s double, usable boolean, failures long, successes long"
STATE = "until_s double, failures long, successes long"


def _update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    until, failures, successes = state.get if state.exists else (0.0, 0, 0)
    calls = pd.concat(list(batches)).sort_values(["at_s", "id"])
    rows = []
    for call in calls.itertuples():
        rows.append((key[0], call.at_s, call.at_s >= until, failures, successes))
        if call.failed:
            failures, until = failures + 1, call.at_s + REST_S.get(call.category, REST_OTHER_S)
        else:
            successes, until = successes + 1, 0.0
    state.update((float(until), int(failures), int(successes)))
    yield pd.DataFrame(rows, columns=["model", "at_s", "usable", "failures", "successes"])


def health_stream(calls: DataFrame) -> DataFrame:
    """Calls (model, id, at_s, failed, category), as a stream, with the state that each met."""
    importable(calls.sparkSession)
    return calls.groupBy("model").applyInPandasWithState(_update, OUT, STATE, "append", GroupStateTimeout.NoTimeout)


def _rested(call, category: str) -> float:
    """Until when a model rests after a failed call."""
    told = category not in ("timeout", *REFUSED) and not pd.isna(call.retry_after)
    return call.at_s + max(1.0, call.retry_after if told else REST_S.get(category, REST_OTHER_S))


def _availability(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    until, gone, strikes = state.get if state.exists else (0.0, False, "{}")
    strikes = json.loads(strikes)
    calls = pd.concat(list(batches)).sort_values(["at_s", "id"])
    rows = []
    for call in calls.itertuples():
        struck = strikes.get(str(call.capability), 0) >= STRIKES
        rows.append((key[0], call.id, "model" if gone else "quality" if struck else "resting" if call.at_s < until else None))
        category = call.category if isinstance(call.category, str) else None
        if category is None:
            until = 0.0
        elif category == "model_unavailable":
            gone = True
        elif category == "invalid":
            strikes[str(call.capability)] = strikes.get(str(call.capability), 0) + 1
        elif category != "provider_auth" and category not in ENDING:
            until = _rested(call, category)
    state.update((float(until), bool(gone), json.dumps(strikes)))
    yield pd.DataFrame(rows, columns=["model", "id", "why_not"])


def availability_stream(calls: DataFrame) -> DataFrame:
    """``routing.availability`` for a stream of calls: model, id, why_not (model, quality, resting or null).

    ``calls``: model, capability, id, at_s, category (null: a success), retry_after. State is kept per model, so what a provider refuses as a whole
    is not seen here.
    """
    importable(calls.sparkSession)
    return calls.groupBy("model").applyInPandasWithState(
        _availability, "model string, id long, why_not string", "until_s double, gone boolean, strikes string", "append", GroupStateTimeout.NoTimeout
    )


def _job(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    known = json.loads(state.get[0]) if state.exists else {"ended": False, "off": [], "gone": [], "strikes": {}, "until": {}}
    rows = []
    for call in pd.concat(list(batches)).sort_values(["at_s", "id"]).itertuples():
        pair = f"{call.model}|{call.capability}"
        why = (
            "ended" if known["ended"] else "provider" if call.provider in known["off"] else "model" if call.model in known["gone"]
            else "quality" if known["strikes"].get(pair, 0) >= STRIKES else "resting" if call.at_s < known["until"].get(call.model, 0.0) else None
        )
        rows.append((key[0], call.id, why))
        category = call.category if isinstance(call.category, str) else None
        if category in ENDING:
            known["ended"] = True
        elif category == "provider_auth":
            known["off"].append(call.provider)
        elif category == "model_unavailable":
            known["gone"].append(call.model)
        elif category == "invalid":
            known["strikes"][pair] = known["strikes"].get(pair, 0) + 1
        else:
            known["until"][call.model] = 0.0 if category is None else _rested(call, category)
    known["off"], known["gone"] = sorted(set(known["off"])), sorted(set(known["gone"]))
    state.update((json.dumps(known),))
    yield pd.DataFrame(rows, columns=["job", "id", "why_not"])


def job_stream(calls: DataFrame) -> DataFrame:
    """``routing.availability`` by job for a stream of calls: job, id, why_not (also ended and provider).

    ``calls``: job, provider, model (strings), capability, id, at_s, category, retry_after. The state of a job is what is known of its models and
    providers, which are few.
    """
    importable(calls.sparkSession)
    return calls.groupBy("job").applyInPandasWithState(_job, "job string, id long, why_not string", "known string", "append", GroupStateTimeout.NoTimeout)


def tumbling_counts(events: DataFrame, at: str, kind: str, width: str, late: str) -> DataFrame:
    """Counts per kind and window of event time; rows later than ``late`` are dropped by the watermark."""
    from pyspark.sql import functions as F

    return events.withWatermark(at, late).groupBy(F.window(at, width), kind).count()
