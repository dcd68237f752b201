"""Column layouts of the engine and the options of a run."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

DAY = 86_400

EVENTS = T.StructType([
    T.StructField("event_idx", T.LongType()),
    T.StructField("type", T.StringType()),
    T.StructField("src", T.LongType()),
    T.StructField("dst", T.LongType()),
    T.StructField("weight", T.DoubleType()),
    T.StructField("ts", T.LongType()),
])

ADD, DELETE = "ADD", "DEL"


@dataclass
class Options:
    """How a graph is read and which way a program runs. Days are given as days; weight and time positions count from 1 after src and dst, 0 for none."""

    graph: str = ""
    undirected: bool = False
    transpose: bool = False
    weight_pos: int = 0
    time_pos: int = 0
    logical_time: bool = False
    change_log: bool = False
    window_days: float = 0.0
    time_range: bool = False
    dynamic: bool = False
    synchronous: bool = False
    previous_only: bool = False
    snapshot_days: float = 0.0
    snapshot_events: int = 0
    rate: float = 0.0
    refine_rounds: int = 0
    check: bool = False
    compare: bool = False
    write_properties: bool = False
    top_n: int = 10
    sources: list[int] = field(default_factory=list)

    def __post_init__(self):
        self.dynamic = self.dynamic or bool(self.rate or self.snapshot_days or self.snapshot_events)
        self.synchronous = self.synchronous or self.previous_only
        if self.synchronous and self.dynamic:
            raise ValueError("a dynamic run cannot be synchronous")
        if self.weight_pos < 0 or self.time_pos < 0 or max(self.weight_pos, self.time_pos) > 3:
            raise ValueError("property positions lie between 1 and 3, or are 0")
        if self.weight_pos and self.weight_pos == self.time_pos:
            raise ValueError("weight and time cannot share a position")
        if self.snapshot_events:
            self.snapshot_days = 0.0  # a count of events goes before an interval
        if self.window_days and not (self.time_pos or self.logical_time):
            raise ValueError("a sliding window needs timestamps")

    @property
    def window(self) -> int:
        return int(self.window_days * DAY)

    @property
    def snapshot_interval(self) -> int:
        return int(self.snapshot_days * DAY)
