"""Language, lifetimes, sources, sinks, time formats and live queries, by hand-worked expectations."""

import json
import struct

import pytest

from tidewatch import api
from tidewatch.lang.analysis import Analysis
from tidewatch.lang.syntax import SpecError, parse
from tidewatch.operators import sinks, verdicts
from tidewatch.plans.compiler import compile_spec
from tidewatch.sources import events, pcap
from tidewatch.streaming import fold, machine

S = 1_000_000_000
HALF = "\n".join(["a,time", *[f"{a},{i / 2}" for i, a in enumerate([1, 1, 2, 2, 2, 1, 1, 1, 1, 2, 1, 2, 2])]])


def rows(text):
    head, *lines = [x.split(",") for x in text.split("\n")]
    at = head.index("time")
    return [(int(round(float(x[at]) * S)), {h: None if v == "#" else int(v) for h, v in zip(head, x, strict=True) if h != "time"}) for x in lines]


def fired(spec, text):
    out = {}
    for ts, m in machine.triggers(spec, rows(text)):
        out.setdefault(m, []).append(ts / S)
    return out


@pytest.mark.parametrize("text", ["output x := 1", "input a: Int64\noutput x := y", "input a: Int64\noutput x := a.offset(by: 1)", "input a: Int64\noutput x := x + a", "input a: Int\ninput a: Int", "input a: Wrong\noutput x := a", "output", "input a: Int64\noutput x @1s := a + a.hold(or: 0) $"])
def test_rejects(text):
    with pytest.raises(SpecError):
        an = Analysis(parse(text))
        for s in an.spec.outputs:
            an.stream_pacing(s)
            an.stream_type(s)
        for s in an.spec.inputs:
            an.stream_type(s)


def test_inferred_pacing_and_types():
    an = Analysis(parse("input a: Int64\ninput b: Float64\noutput x := a + cast<Int64>(b)\noutput y @2Hz := a.hold(or: 0)\noutput z := y * 2"))
    p = an.stream_pacing(an.spec["x"])
    assert p.value == "&&" and {q.value for q in p.args} == {"a", "b"}
    assert an.stream_pacing(an.spec["z"]).value == S // 2
    assert an.stream_type(an.spec["x"]) == "int"


def test_an_event_at_a_deadline_comes_first():
    counts = "input a: Int64\noutput n @1s := a.aggregate(over: 4s, using: count)\ntrigger eval when n > 0 with \"{}\".format(n)"
    assert fired(counts, HALF) == {"3": [1.0], "5": [2.0], "7": [3.0], "8": [4.0, 5.0, 6.0]}


def test_unit_instances_close_after_their_cycle():
    spec = "input a: UInt64\noutput c @2Hz := a.hold(or: 2) % 2 = 1\noutput b spawn @1Hz when a.hold(or: 1) % 2 = 0 close when c eval @a with true\ntrigger @2Hz b.hold(or: false) \"on\""
    assert fired(spec, HALF) == {"on": [1.5, 2.0, 2.5]}


def test_an_instance_that_closes_itself_starts_anew():
    spec = "input a: Int64\noutput b(p: Int64) spawn with a close when b(p) = 5 eval when p = a with b(p).offset(by: -1).defaults(to: 0) + 1\ntrigger @a b(1).hold(or: 0) = 1 \"one\""
    text = "\n".join(["a,time", *[f"{a},{i / 2}" for i, a in enumerate([1, 1, 2, 2, 2, 1, 1, 1, 1, 2, 1])]])
    assert fired(spec, text) == {"one": [0.0, 4.0, 4.5]}


def test_local_deadlines_count_from_the_spawn(spark):
    spec = "input a: Int64\noutput b(p) spawn with a eval @1s with a.hold(or: 0)\n"
    df = spark.createDataFrame([(S // 2, 0, 7), (2 * S, 1, 8), (3 * S, 2, 7)], "__ts long, __seq long, a long")
    result = api.monitor(spec, df)
    assert result.plan is None
    got = [(r.ts / S, r.params, r.value) for r in result.changes().filter("change = 'Value'").collect()]
    assert sorted(got) == [(1.5, "7", "7"), (2.5, "7", "8"), (3.0, "8", "7")]


def test_instances_by_condition_and_group():
    spec = "input a: Int64\ninput b: Int64\noutput c(p, q) spawn with (a, b) eval when a == p && b == q with p + q\noutput d(p) spawn with a eval @true with c.aggregate(over_instances: all(where: (x, y) => x == p), using: sum)"
    out = machine.run(spec, [(S, {"a": 1, "b": 2}), (2 * S, {"a": 2, "b": 3}), (3 * S, {"a": 1, "b": 5})])
    assert [(c.params, c.value) for _, cs in out for c in cs if c.stream == "d" and c.kind == "Value"] == [((1,), 3), ((1,), 3), ((2,), 5), ((1,), 9), ((2,), 5)]


def test_percentiles_of_windows_and_of_instances_differ():
    points = [(0, float(x)) for x in (42, 5, 7, -13)]
    assert [machine.aggregate(f"pctl{p}", points, "float", linear=True) for p in (25, 75)] == [0.5, 15.75]
    assert machine.aggregate("pctl25", points, "float") == -4.0
    assert machine.aggregate("pctl20", [(0, x) for x in range(21, 26)], "int") == 21
    assert machine.aggregate("avg", [(0, -7), (0, 2)], "int") == -2 and machine.aggregate("sd", [], "float") == 0.0


def test_csv_formats(spark, tmp_path):
    spec = "input a: Int64\ninput h: Bytes\noutput x := a * 2"
    (tmp_path / "t.csv").write_text("extra, h ,a,time\nq,0aFF, 1,0.000536\nq,#, #, 0.100536\nq,#,3,0.2\n")
    got = events.read_csv(spark, str(tmp_path / "t.csv"), spec).orderBy("__seq").collect()
    assert [(r["__ts"], r["a"], r["h"] and bytes(r["h"])) for r in got] == [(536000, 1, b"\x0a\xff"), (100536000, None, None), (200000000, 3, None)]
    with pytest.raises(SpecError):
        events.read_csv(spark, str(tmp_path / "t.csv"), "input zz: Int64")


@pytest.mark.parametrize(("how", "cells", "want"), [
    ("relative_nanos", ["5", "9"], [5, 9]), ("relative", ["0.000000001", "2.5"], [1, 2 * S + S // 2]), ("offset_nanos", ["5", "9"], [5, 14]), ("offset", ["0.5", "0.25"], [S // 2, 3 * S // 4]),
    ("absolute", ["1700000000.5", "1700000001.75"], [0, 5 * S // 4]), ("absolute_rfc", ["2024-01-01T00:00:01.5Z", "2024-01-01T00:00:03Z"], [0, 3 * S // 2]), ("delay", ["x", "y"], [0, S]),
])
def test_time_formats(spark, how, cells, want):
    text = "a,time\n" + "\n".join(f"{i},{c}" for i, c in enumerate(cells))
    df = events.from_text(spark, text, "input a: Int64", how)
    assert [r["__ts"] for r in df.orderBy("__seq").collect()] == want


def test_records_of_several_kinds(spark):
    one = spark.createDataFrame([(1, 1, 5)], "__ts long, __seq long, x long")
    two = spark.createDataFrame([(2, 2, "b", True)], "__ts long, __seq long, y string, skip boolean")
    df = events.merged({"A": one, "B": two}, prefix=True, ignore=("skip",))
    assert sorted(df.columns) == ["A::x", "B::y", "__seq", "__ts"] and df.count() == 2
    assert events.padded(one, "input x: Int64\ninput y: Float64").collect()[0]["y"] is None
    raw = spark.createDataFrame([("u", '{"a": 3, "time": 1.5}'), ("v", '{"a": 4, "time": 2}')], "sender string, payload string")
    got = events.from_json(raw, "payload", "input a: Int64", "time", senders=["u"]).collect()
    assert [(r["__ts"], r["a"]) for r in got] == [(3 * S // 2, 3)]


def capture(frames):
    head = struct.pack("<IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, 65535, 1)
    return head + b"".join(struct.pack("<IIII", 100 + i, 500, len(f), len(f)) + f for i, f in enumerate(frames))


def test_packets(spark, tmp_path):
    eth = bytes(range(6)) + bytes(range(6, 12))
    udp = struct.pack(">HHHH", 53, 4000, 13, 7) + b"hello"
    ip = struct.pack(">BBHHHBBH", 0x45, 0b1010, 20 + len(udp), 9, 0x4000, 64, 17, 1) + bytes([10, 0, 0, 1]) + bytes([8, 8, 8, 8])
    tcp = struct.pack(">HHIIHHHH", 1, 2, 3, 4, 5 << 12 | 0x12, 6, 7, 8) + b"xy"
    six = struct.pack(">IHBB", 6 << 28 | 5 << 20 | 77, len(tcp), 6, 9) + bytes(16) + bytes([1] * 16)
    (tmp_path / "c.pcap").write_bytes(capture([eth + b"\x08\x00" + ip + udp, eth + b"\x86\xdd" + six + tcp, b"short"]))
    a, b, c = pcap.read_pcap(spark, str(tmp_path / "c.pcap"), ["10.0.0.0/8"]).orderBy("__seq").collect()
    assert (a["UDP::source"], a["IPv4::ttl"], a["IPv4::flags::df"], a["payload"], a["protocol"], a["direction"], a["TCP::source"]) == (53, 64, True, "hello", "UDP", "Outgoing", None)
    assert tuple(a["IPv4::source"]) == (10, 0, 0, 1) and tuple(a["Ethernet::source"]) == (6, 7, 8, 9, 10, 11)
    assert (b["TCP::flags::syn"], b["TCP::flags::ack"], b["TCP::flags::fin"], b["IPv6::flow_label"], b["IPv6::traffic_class"], b["payload"]) == (True, True, False, 77, 5, "xy")
    assert (c["protocol"], c["Ethernet::type"], c["__ts"] - a["__ts"]) == ("Unknown", None, 2 * S)


def test_sinks(spark, tmp_path):
    spec = "input a: Int64\noutput x := a * 2\noutput y := a.offset(by: -1)\noutput k(p) spawn with a eval when p == a with a\ntrigger a > 1 \"big\""
    df = spark.createDataFrame([(0, 0, 1), (S // 2, 1, 2)], "__ts long, __seq long, a long")
    result = api.monitor(spec, df)
    plan = result.plan
    assert [tuple(r) for r in sinks.csv_rows(plan, ["x", "y"]).orderBy("time").collect()] == [("0.000000000", "2", "#"), ("0.500000000", "4", "1")]
    with pytest.raises(SpecError):
        sinks.csv_rows(plan, ["k"])
    objects = [json.loads(r.value) for r in sinks.json_rows(result.changes()).collect()]
    last = next(o for o in objects if o["time"] == "0.500000000")
    assert last["streams"]["k"] == [{"instance": "2", "spawn": True, "eval": "2"}] and last["streams"]["x"] == [{"eval": "4"}]
    log = {r.value for r in sinks.log_rows(result.changes(), ["trigger_0"]).collect()}
    assert '[0.500000000][Trigger][#0][Value] = "big"' in log and "[0.500000000][Output][k(2)][Spawn]" in log
    assert {r.stream: r.n for r in sinks.statistics(result.changes(), ["trigger_0"]).collect()}["trigger_0"] == 1
    assert sinks.visible(plan, "violations") == ["trigger_0"] and "a" in sinks.visible(plan, "streams") and sinks.visible(plan, "silent", debug=("x",)) == ["x"]
    whole = verdicts.total(compile_spec("input a: Int64\noutput x @a := a + 1", df)).orderBy("seq").collect()
    assert [(r["a"], r["x"]) for r in whole] == [(1, 2), (2, 3)]
    assert verdicts.total_incremental(plan).filter("stream = 'a'").count() == 2
    sinks.discard(result.triggers())


def test_live_queries_keep_state_between_batches(spark, tmp_path):
    spec = "input v: Int64\noutput s := s[-1].defaults(to: 0) + v\noutput n @1s := v.aggregate(over: 2s, using: count)"
    src, out = tmp_path / "in", tmp_path / "out"
    schema = "`__ts` long, `__seq` long, k string, v long"
    parts = [[(0, 0, "p", 1), (S // 2, 1, "q", 5)], [(S, 2, "p", 2), (3 * S, 3, "p", 4)]]
    for i, part in enumerate(parts):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(src / f"b={i}"))
    stream = spark.readStream.schema(schema + ", b int").option("maxFilesPerTrigger", 1).parquet(str(src)).drop("b")
    query = fold.live(spec, stream, ["k"]).writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    rows_ = spark.read.parquet(str(out)).filter("change = 'Value'").collect()
    assert sorted(int(r.value) for r in rows_ if r.stream == "s") == [1, 3, 5, 7]
    assert sorted((r.ts // S, int(r.value)) for r in rows_ if r.stream == "n") == [(1, 2), (2, 1)]


def test_folds_by_key_end_together(spark):
    spec = "input v: Int64\noutput n @1s := v.aggregate(over: 1s, using: count)"
    df = spark.createDataFrame([(0, 0, "p", 1), (5 * S // 2, 1, "q", 5)], "__ts long, __seq long, k string, v long")
    assert fold.fold(spec, df, ["k"]).filter("change = 'Value'").count() == 4


def test_the_clock_moves_without_events():
    m = machine.Machine("input v: Int64\noutput n @1h := v.aggregate(over: 2h, using: count)")
    fired_at = []
    for _ in range(30):
        fired_at += [ts for ts, _ in m.advance(m.now + 600 * S)]
        m = machine.Machine.restore(m.text, m.state())
    assert fired_at == [k * 3600 * S for k in range(1, 6)]


def test_values_of_closed_instances_are_forgotten():
    spec = "input a: Int64\noutput b(p) spawn with a close @a when true eval when p == a with a\noutput n @a := b(1).aggregate(over: 1s, using: count)"
    spec = spec.replace("output n @a", "output n @1s")
    m = machine.Machine(spec)
    for k in range(3000):
        m.event(k * S // 10, {"a": 1 + k % 2})
    assert sum(map(len, m.drained.values())) < 200


def test_unsigned_values_have_no_sign(spark):
    df = spark.createDataFrame([(0, 0, 2, -3)], "__ts long, __seq long, u long, a long")
    for text in ("output x := u - 5", "output x := cast<UInt64>(a)"):
        spec = f"input u: UInt64\ninput a: Int64\n{text}"
        with pytest.raises(Exception, match="unsigned"):
            compile_spec(spec, df).stream("x").collect()
        with pytest.raises(SpecError, match="unsigned"):
            machine.run(spec, [(0, {"u": 2, "a": -3})])
    assert compile_spec("input u: UInt64\noutput x := u - 2", df).stream("x").collect()[0]["value"] == 0


def test_cycles_of_one_time_are_told_apart(spark):
    df = spark.createDataFrame([(S, 4, 5), (S, 5, 10)], "__ts long, __seq long, x long")
    for result in (api.monitor("input x: Int64\noutput y := x", df), api.Result("", None, fold.fold("input x: Int64\noutput y := x", df))):
        lines = sinks.json_rows(result.changes()).orderBy("ts", "kind", "seq").collect()
        assert [json.loads(r.value)["streams"]["y"] for r in lines] == [[{"eval": "5"}], [{"eval": "10"}]]


def test_summed_times_by_blocks(spark, monkeypatch):
    from tidewatch.sources import times

    monkeypatch.setattr(times, "BLOCK", 4)
    df = spark.createDataFrame([(k, k + 1) for k in range(11)], "__seq long, d long")
    assert [r["__ts"] for r in times.with_time(df, "offset_nanos", "d").orderBy("__seq").collect()] == [(k + 1) * (k + 2) // 2 for k in range(11)]
    assert [r["__ts"] for r in times.with_time(df, "delay", delay_ns=7).orderBy("__seq").collect()] == [7 * k for k in range(11)]


def test_live_queries_leave_out_late_events_and_keep_large_numbers(spark, tmp_path):
    spec = "input v: Int64\ninput w: Int64\noutput q := v / 2\noutput s @v := w.hold(or: 0)"
    src, out = tmp_path / "in", tmp_path / "out"
    schema = "`__ts` long, `__seq` long, k string, v long, w long"
    big = 2**60 + 1
    for i, part in enumerate([[(5 * S, 0, "p", 7, None), (6 * S, 1, "p", 9, big)], [(S, 2, "p", 100, 1), (7 * S, 3, "p", -3, None)]]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(src / f"b={i}"))
    stream = spark.readStream.schema(schema + ", b int").option("maxFilesPerTrigger", 1).parquet(str(src)).drop("b")
    query = fold.live(spec, stream, ["k"], late="drop").writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    rows_ = spark.read.parquet(str(out)).filter("change = 'Value'").collect()
    assert sorted((r.ts // S, r.value) for r in rows_ if r.stream == "q") == [(5, "3"), (6, "4"), (7, "-1")]
    assert sorted((r.ts // S, r.value) for r in rows_ if r.stream == "s") == [(5, "0"), (6, str(big)), (7, str(big))]


def test_live_queries_wait_for_a_watermark(spark, tmp_path):
    src, out = tmp_path / "in", tmp_path / "out"
    schema = "`__ts` long, `__seq` long, k string, v long"
    for i, part in enumerate([[(3 * S, 0, "p", 3), (S, 1, "p", 1)], [(2 * S, 2, "p", 2), (9 * S, 3, "p", 9)]]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(src / f"b={i}"))
    stream = spark.readStream.schema(schema + ", b int").option("maxFilesPerTrigger", 1).parquet(str(src)).drop("b")
    query = fold.live("input v: Int64\noutput s := s[-1].defaults(to: 0) * 10 + v", stream, ["k"], delay_ms=4000).writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert sorted(int(r.value) for r in spark.read.parquet(str(out)).filter("change = 'Value'").collect()) == [1, 12, 123]
