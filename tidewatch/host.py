"""Monitors inside a host program: events in, verdicts out, one cycle at a time or through queues.

For traces and streams that Spark reads use ``api`` and ``streaming.fold``; this is for a
program that has its events in hand. All of it runs the same ordered machine.
"""

from __future__ import annotations

import dataclasses
import queue
import threading
import time
import typing
from collections.abc import Callable, Iterable, Iterator, Mapping, Sequence

from .lang.analysis import Analysis, is_tick, period_of
from .lang.syntax import SpecError, parse
from .streaming.machine import Change, Machine


# verdicts: what is told of a cycle
def incremental(machine: Machine, changes: list[Change]) -> list[Change]:
    """Changed outputs."""
    return changes


def total_incremental(machine: Machine, changes: list[Change]) -> list[Change]:
    """Changed inputs and outputs."""
    fresh = [Change(n, "Value", (), i.past[-1]) for n, i in machine.inputs.items() if i.fresh] if machine.is_event else []
    return fresh + changes


def total(machine: Machine, changes: list[Change]) -> dict[str, object]:
    """The last value of every input, and of every output: of spawned ones a value for each live instance."""
    last = lambda i: i.past[-1] if i.past else None
    out: dict[str, object] = {n: last(i) for n, i in machine.inputs.items()}
    for s in machine.spec.outputs:
        alive = {k: last(i) for k, i in machine.live[s.name].items()}
        out[s.name] = alive if s.params else alive.get(())
    return out


def trigger_messages(machine: Machine, changes: list[Change]) -> list[tuple[str, tuple, str]]:
    """(trigger, parameters, message)"""
    names = {s.name for s in machine.spec.triggers}
    return [(c.stream, c.params, c.value) for c in changes if c.stream in names and c.kind == "Value"]


def record(kind: type) -> Callable[[Machine, list[Change]], object]:
    """Verdicts as instances of a dataclass, whose fields are named like streams.

    A stream without a value gives the field's default, else None. Of a stream with parameters
    a mapping from parameters to value is told, or, if the field is a set, the instances with
    one; a field of type bool says whether a trigger fired; ``time`` is the cycle's time.
    """
    hints, fields = typing.get_type_hints(kind), dataclasses.fields(kind)

    def told(machine: Machine, changes: list[Change]) -> object:
        values: dict[str, object] = {}
        for f in fields:
            if f.name == "time":
                values["time"] = machine.now
                continue
            if f.name not in machine.spec.by_name:
                raise SpecError(f"{f.name} is no stream of the specification")
            own = [(c.params, c.value) for c in total_incremental(machine, changes) if c.stream == f.name and c.kind == "Value"]
            one = lambda p: p[0] if len(p) == 1 else p
            base = typing.get_origin(hints[f.name]) or hints[f.name]
            if base is set or base is frozenset:
                values[f.name] = base(one(p) for p, _ in own)
            elif isinstance(base, type) and issubclass(base, Mapping):
                values[f.name] = {one(p): v for p, v in own}
            elif base is bool and f.name in {s.name for s in machine.spec.triggers}:
                values[f.name] = bool(own)
            elif own:
                values[f.name] = own[-1][1]
            elif f.default is dataclasses.MISSING and f.default_factory is dataclasses.MISSING:
                values[f.name] = None
        return kind(**values)

    return told


class Tracer:
    """What happens inside a monitor, for a subclass to listen to."""

    def parse_start(self) -> None: ...

    def parse_end(self) -> None: ...

    def eval_start(self) -> None: ...

    def eval_end(self) -> None: ...

    def spawn(self, stream: str, params: tuple) -> None: ...

    def instance(self, stream: str, params: tuple) -> None: ...

    def close(self, stream: str, params: tuple) -> None: ...


class Timings(Tracer):
    """Nanoseconds and numbers of cycles, spawns, values and closes."""

    def __init__(self):
        self.parse_ns = self.eval_ns = self.cycles = self.spawns = self.values = self.closes = 0

    def parse_start(self) -> None:
        self._at = time.perf_counter_ns()

    def parse_end(self) -> None:
        self.parse_ns += time.perf_counter_ns() - self._at

    def eval_start(self) -> None:
        self._at = time.perf_counter_ns()

    def eval_end(self) -> None:
        self.eval_ns += time.perf_counter_ns() - self._at
        self.cycles += 1

    def spawn(self, stream: str, params: tuple) -> None:
        self.spawns += 1

    def instance(self, stream: str, params: tuple) -> None:
        self.values += 1

    def close(self, stream: str, params: tuple) -> None:
        self.closes += 1


class EventSource(typing.Protocol):
    """Where a host's events come from: (event, time in nanoseconds) one after the other."""

    def events(self) -> Iterator[tuple[object, int]]: ...


@dataclasses.dataclass
class Verdicts:
    """timed: (time, verdict) of the deadlines before an event; event: the event's own; ts: its time."""

    timed: list[tuple[int, object]]
    event: object
    ts: int


@dataclasses.dataclass
class QueuedVerdict:
    kind: str  # "timed" or "event"
    ts: int
    verdict: object


@dataclasses.dataclass(frozen=True)
class Config:
    """A specification and how it is run; every method gives a changed copy."""

    text: str
    is_online: bool = False
    verdict: Callable = incremental
    tracer: Tracer | None = None
    mapping: Callable[[object], Mapping] | None = None
    start: int = 0

    @classmethod
    def from_file(cls, path: str) -> Config:
        with open(path, encoding="utf-8") as f:
            return cls(f.read())

    def online(self) -> Config:
        """Deadlines come by the clock of the machine it runs on."""
        return dataclasses.replace(self, is_online=True)

    def offline(self) -> Config:
        """Deadlines come with the times of events."""
        return dataclasses.replace(self, is_online=False)

    def with_verdict(self, verdict: Callable) -> Config:
        return dataclasses.replace(self, verdict=verdict)

    def with_tracer(self, tracer: Tracer) -> Config:
        return dataclasses.replace(self, tracer=tracer)

    def with_mapping(self, mapping: Callable[[object], Mapping]) -> Config:
        """mapping: an event of the host to a value by input name; without one events are mappings, or sequences in the order of inputs."""
        return dataclasses.replace(self, mapping=mapping)

    def with_start(self, nanos: int) -> Config:
        """Of absolute times."""
        return dataclasses.replace(self, start=nanos)

    def monitor(self) -> Monitor:
        return Monitor(self)

    def queued(self, bound: int = 0) -> QueuedMonitor:
        return QueuedMonitor(self, bound)


class Monitor:
    """Takes events in the order of their times and answers with verdicts."""

    def __init__(self, config: Config):
        tracer = config.tracer or Tracer()
        tracer.parse_start()
        self.config, self.machine, self.tracer = config, Machine(config.text), tracer
        tracer.parse_end()
        self.spec, self.analysis = self.machine.spec, self.machine.an

    def _event(self, event: object) -> Mapping:
        if self.config.mapping is not None:
            event = self.config.mapping(event)
        if isinstance(event, Mapping):
            if unknown := set(event) - set(self.machine.inputs):
                raise SpecError(f"no inputs: {sorted(unknown)}")
            return event
        if isinstance(event, Sequence) and len(event) == len(self.machine.inputs):
            return dict(zip(self.machine.inputs, event, strict=True))
        raise SpecError("an event is a mapping, or a sequence with a value or None for every input")

    def _run(self, cycles: Callable[[], list]) -> list[tuple[int, object]]:
        """Verdicts are taken while the machine stands at their cycle."""
        out: list[tuple[int, object]] = []
        self.machine.listener = lambda ts, changes: out.append((ts, self._told(changes)))
        self.tracer.eval_start()
        try:
            cycles()
        finally:
            self.machine.listener = None
            self.tracer.eval_end()
        return out

    def _told(self, changes: list[Change]) -> object:
        hooks = {"Spawn": self.tracer.spawn, "Value": self.tracer.instance, "Close": self.tracer.close}
        for c in changes:
            hooks[c.kind](c.stream, c.params)
        return self.config.verdict(self.machine, changes)

    def accept_event(self, event: object, ts: int) -> Verdicts:
        """The deadlines before ``ts`` (nanoseconds), then the event."""
        row, at = self._event(event), ts - self.config.start
        *timed, (_, own) = self._run(lambda: self.machine.event(at, row))
        return Verdicts(timed, own, at)

    def accept_time(self, ts: int) -> list[tuple[int, object]]:
        """The deadlines up to and with ``ts``."""
        return self._run(lambda: self.machine.advance(ts - self.config.start))

    def run(self, source: EventSource | Iterable[tuple[object, int]]) -> Iterator[Verdicts]:
        for event, ts in source.events() if hasattr(source, "events") else source:
            yield self.accept_event(event, ts)

    # about the specification
    def inputs(self) -> list[str]:
        return [s.name for s in self.spec.inputs]

    def outputs(self) -> list[str]:
        return [s.name for s in self.spec.outputs]

    def triggers(self) -> list[str]:
        return [s.name for s in self.spec.triggers]

    def trigger_place(self, i: int) -> int:
        """The place among the outputs of the i-th trigger."""
        return self.outputs().index(self.triggers()[i])

    def type_of(self, name: str) -> object:
        return self.analysis.stream_type(self.spec[name])

    def period_of(self, name: str) -> int | None:
        """Nanoseconds between the evaluations of a periodic output."""
        p = self.analysis.stream_pacing(self.spec[name])
        return period_of(p) if is_tick(p) else None

    def counts(self) -> dict[str, int]:
        periodic = sum(self.period_of(n) is not None for n in self.outputs())
        return {"inputs": len(self.inputs()), "outputs": len(self.outputs()), "triggers": len(self.triggers()), "periodic": periodic, "event_based": len(self.outputs()) - periodic}

    def with_verdict(self, verdict: Callable) -> Monitor:
        """The same monitor, at the same place, with other verdicts."""
        out = Monitor(self.config.with_verdict(verdict))
        out.machine = self.machine
        return out


class QueuedMonitor:
    """A monitor in a thread of its own: events go into one queue, verdicts come out of another.

    Offline, deadlines run with the events. Online, the time of an event is when it is taken,
    and deadlines run when they are due. Verdicts of events that change nothing are left out.
    """

    def __init__(self, config: Config, bound: int = 0):
        self.config, self._in, self.output = config, queue.Queue(bound), queue.Queue(bound)
        self._thread: threading.Thread | None = None
        self._failure: BaseException | None = None
        self._monitor = Monitor(config)

    def start(self) -> QueuedMonitor:
        if self._thread is not None:
            raise RuntimeError("the monitor has started")
        self._began = time.monotonic_ns()
        self._thread = threading.Thread(target=self._work, daemon=True)
        self._thread.start()
        return self

    def accept_event(self, event: object, ts: int | None = None) -> None:
        """ts: needed offline. Waits while the queue is full."""
        if self._thread is None:
            raise RuntimeError("the monitor has not started")
        if (ts is None) != self.config.is_online:
            raise ValueError("events have a time offline, and none online")
        self._check()
        self._in.put((event, ts))

    def end(self, ts: int | None = None) -> None:
        """No more events; offline, deadlines up to ``ts`` run still. Waits for the thread; a failure of it is raised here."""
        if self._thread is None:
            raise RuntimeError("the monitor has not started")
        self._in.put((None, ts))
        self._thread.join()
        self._check()

    def verdicts(self) -> Iterator[QueuedVerdict]:
        """All verdicts to the end."""
        while (v := self.output.get()) is not None:
            yield v

    def _check(self) -> None:
        if self._failure is not None:
            raise self._failure

    def _tell(self, timed: list, event: Verdicts | None = None) -> None:
        for ts, v in timed:
            self.output.put(QueuedVerdict("timed", ts, v))
        if event is not None and event.event not in (None, [], {}, ()):
            self.output.put(QueuedVerdict("event", event.ts, event.event))

    def _work(self) -> None:
        now = lambda: time.monotonic_ns() - self._began + self.config.start
        try:
            while True:
                wait = None
                if self.config.is_online and (due := self._monitor.machine.due()) is not None:
                    wait = max(0.0, (due + self.config.start - now()) / 1e9)
                try:
                    event, ts = self._in.get(timeout=wait)
                except queue.Empty:
                    self._tell(self._monitor.accept_time(now()))
                    continue
                if event is None:
                    if ts is not None:
                        self._tell(self._monitor.accept_time(ts))
                    return
                got = self._monitor.accept_event(event, now() if ts is None else ts)
                self._tell(got.timed, got)
        except BaseException as e:  # told to whoever calls next
            self._failure = e
        finally:
            self.output.put(None)


def specification(text: str) -> Analysis:
    """A checked specification."""
    return Analysis(parse(text))
