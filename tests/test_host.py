"""Monitors in a host program, byte sources and sinks, datagrams."""

import dataclasses
import json
import socket
import threading
import time

import pytest

from tidewatch import host
from tidewatch.lang.syntax import SpecError
from tidewatch.sources import bytes as raw

S = 1_000_000_000
SPEC = """input a: Int64
output n @1s := a.aggregate(over: 2s, using: count)
output k(p) spawn with a close @a when a == 9 eval when p == a with k(p)[-1].defaults(to: 0) + 1
trigger eval when a > 4 with "a is {}".format(a)"""


def test_events_and_deadlines():
    m = host.Config(SPEC).with_verdict(host.trigger_messages).monitor()
    assert m.accept_event({"a": 5}, S // 2) == host.Verdicts([], [("trigger_0", (), "a is 5")], S // 2)
    got = m.accept_event((1,), 3 * S + 1)
    assert [ts for ts, _ in got.timed] == [S, 2 * S, 3 * S] and got.event == []
    assert [ts for ts, _ in m.with_verdict(host.incremental).accept_time(5 * S)] == [4 * S, 5 * S]
    assert (m.inputs(), m.triggers(), m.trigger_place(0)) == (["a"], ["trigger_0"], 2) and m.period_of("n") == S and m.period_of("k") is None
    assert m.counts() == {"inputs": 1, "outputs": 3, "triggers": 1, "periodic": 1, "event_based": 2} and m.type_of("n") == "uint"
    for wrong in ({"b": 1}, (1, 2)):
        with pytest.raises(SpecError):
            m.accept_event(wrong, 9 * S)


def test_verdicts_of_a_cycle():
    @dataclasses.dataclass
    class Told:
        time: int
        a: int | None
        k: dict[int, int]
        trigger_0: bool
        n: int = -1

    m = host.Config(SPEC).with_verdict(host.record(Told)).monitor()
    assert m.accept_event({"a": 7}, 0).event == Told(0, 7, {7: 1}, True, -1)
    got = m.accept_event({"a": 2}, 2 * S)
    assert [v for _, v in got.timed] == [Told(S, None, {}, False, 1)] and got.event == Told(2 * S, 2, {2: 1}, False)
    total = m.with_verdict(host.total).accept_event({"a": 7}, 2 * S + 1).event
    assert total["a"] == 7 and total["k"] == {(7,): 2, (2,): 1} and total["n"] == 1
    closing = m.with_verdict(host.total)
    assert set(closing.accept_event({"a": 9}, 3 * S - 1).event["k"]) == {(7,), (2,), (9,)} and closing.accept_event({"a": 1}, 3 * S - 1).event["k"] == {(1,): 1}
    both = m.with_verdict(host.total_incremental).accept_event({"a": 1}, 3 * S - 1).event
    assert [(c.stream, c.value) for c in both] == [("a", 1), ("k", 2)]


def test_tracers_count():
    t = host.Timings()
    m = host.Config(SPEC).with_tracer(t).with_mapping(lambda e: {"a": len(e)}).monitor()
    list(m.run([("x" * 9, 0), ("xx", 1)]))
    assert (t.cycles, t.spawns, t.closes, t.values) == (2, 2, 1, 3) and t.parse_ns > 0 and t.eval_ns > 0


def test_queues():
    q = host.Config(SPEC).queued(bound=64).start()
    for k in range(4):
        q.accept_event({"a": k + 3}, k * S)
    q.end(4 * S)
    got = list(q.verdicts())
    assert [(v.kind, v.ts // S) for v in got] == [("event", 0), ("event", 1), ("timed", 1), ("event", 2), ("timed", 2), ("event", 3), ("timed", 3), ("timed", 4)]
    quiet = host.Config("input a: Int64\noutput x eval when a > 5 with a").queued().start()
    quiet.accept_event({"a": 1}, 0)
    with pytest.raises(ValueError):
        quiet.accept_event({"a": 1})
    quiet.end()
    assert list(quiet.verdicts()) == []
    late = host.Config(SPEC).queued().start()
    late.accept_event({"a": 1}, S)
    late.accept_event({"a": 1}, 0)
    with pytest.raises(SpecError, match="back"):
        late.end()


def test_deadlines_come_by_the_clock_online():
    q = host.Config("input a: Int64\noutput n @10Hz := a.aggregate(over: 1s, using: count)").online().queued().start()
    q.accept_event({"a": 1})
    time.sleep(0.55)
    q.end()
    got = list(q.verdicts())
    assert 4 <= len(got) <= 6 and all(v.kind == "timed" and v.ts == (i + 1) * S // 10 for i, v in enumerate(got))


def test_records_of_bytes(spark, tmp_path):
    chunks = [b"on", b"e\ntwo\nthr", b"ee\n"]
    assert [r["line"] for r in raw.records(chunks, raw.Lines())] == ["one", "two", "three"]
    with pytest.raises(ValueError):
        list(raw.records([b"half"], raw.Lines()))
    a, b = socket.socketpair()
    a.sendall(b"x\ny\n")
    a.close()
    assert [r["line"] for r in raw.records(raw.reader(b), raw.Lines())] == ["x", "y"]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.bin").write_bytes(b"1\n2\n")
    (tmp_path / "in" / "b.bin").write_bytes(b"3\n")
    df = raw.read_bytes(spark, str(tmp_path / "in"), raw.Lines(), "line string")
    assert sorted((r.path[-5:], r.place, r.line) for r in df.collect()) == [("a.bin", 0, "1"), ("a.bin", 1, "2"), ("b.bin", 0, "3")]
    out = str(tmp_path)
    raw.write_bytes(df.select("line").coalesce(1), lambda r: json.dumps(r).encode() + b"\n", lambda part: open(f"{out}/part-{part}", "wb"))
    assert sorted((tmp_path / "part-0").read_text().split()) == ['"1"}', '"2"}', '"3"}', '{"line":', '{"line":', '{"line":']


def test_datagrams(spark):
    spark.dataSource.register(raw.Datagrams)
    probe = socket.socket(socket.AF_INET, socket.SOCK_DGRAM)
    probe.bind(("127.0.0.1", 0))
    port = probe.getsockname()[1]
    probe.close()
    stream = spark.readStream.format("datagrams").option("port", port).option("senders", "127.0.0.1, 10.0.0.1").load()
    query = stream.writeStream.format("memory").queryName("heard").start()
    stop = threading.Event()

    def send():
        out = socket.socket(socket.AF_INET, socket.SOCK_DGRAM)
        while not stop.is_set():
            out.sendto(b'{"a": 1}', ("127.0.0.1", port))
            time.sleep(0.05)

    threading.Thread(target=send, daemon=True).start()
    try:
        for _ in range(200):
            time.sleep(0.1)
            if spark.sql("select * from heard").count() > 3:
                break
    finally:
        stop.set()
        query.stop()
    rows = spark.sql("select * from heard").collect()
    assert len(rows) > 3 and {(r.sender, bytes(r.payload)) for r in rows} == {("127.0.0.1", b'{"a": 1}')}
