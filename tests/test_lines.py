"""Lines over a stream equal the lines of the whole body, however it is cut, ordered or repeated."""

import random

from quillspan.sources import wire
from quillspan.streaming.lines import event_lines_stream

BODIES = {
    1: 'data: {"a": 1}\r\n: a remark\ndata: x\n\ndata:y  \ndata: rest ',
    2: "data: é中\r\n" * 5,
    3: "",
    4: "nothing here\n at all",
    5: "\n\ndata: \ndata",
}


def cut(rng, body):
    places = sorted(rng.sample(range(1, len(body)), min(len(body) - 1, rng.randrange(6)))) if len(body) > 1 else []
    return [body[a:b] for a, b in zip([0, *places], [*places, len(body)], strict=True)]


def by_hand(body):
    *whole, rest = body.split("\n")
    lines = [t.removesuffix("\r") for t in whole] + [rest.strip()]
    return [t[5:].strip(" ") for t in lines if t.startswith("data:")]


def test_any_split_of_a_body_gives_its_lines(spark, tmp_path):
    schema = "sid int, seq long, body string, last boolean"
    rng = random.Random(8)
    chunks = []
    for copy in range(6):
        for sid, body in BODIES.items():
            parts = cut(rng, body)
            chunks += [(10 * copy + sid, k, p, k == len(parts) - 1) for k, p in enumerate(parts)]
    batch = wire.event_lines(spark.createDataFrame([c[:3] for c in chunks], "sid int, seq int, body string"), "sid", complete=True)
    want = {(k * 10 + sid, n, p) for k in range(6) for sid, body in BODIES.items() for n, p in enumerate(by_hand(body))}
    assert {tuple(r) for r in batch.collect()} == want
    sent = chunks + rng.sample(chunks, len(chunks) // 3)  # a third comes twice, and all in any order
    rng.shuffle(sent)
    for part in range(4):
        spark.createDataFrame(sent[part::4], schema).coalesce(1).write.parquet(f"{tmp_path}/in/{part}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    query = event_lines_stream(stream, "sid").writeStream.format("memory").queryName("lines").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True)
    query.start().awaitTermination(180)
    got = [tuple(r) for r in spark.table("lines").collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_events_stop_at_the_end_mark(spark):
    payloads = ['{"choices": [{"delta": {"content": "Hel"}}]}', "{broken", "3", '{"choices": []}', '{"choices": [{"delta": {"content": "lo"}, "finish_reason": "stop"}], "usage": {"prompt_tokens": 4}}', "[DONE]", '{"choices": [{"delta": {"content": "!"}}]}']
    lines = spark.createDataFrame([(k, n, p) for k in (1, 2) for n, p in enumerate(payloads) if k == 1 or p != "[DONE]"], "k int, line int, payload string")
    got = {r.k: (r.text, r.finish, r.usage.prompt_tokens, r.usage.completion_tokens) for r in wire.deltas(wire.completion_events(lines, "k"), "k").collect()}
    assert got == {1: ("Hello", "stop", 4, None), 2: ("Hello!", "stop", 4, None)}
