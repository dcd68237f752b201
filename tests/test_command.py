"""The command line on a small change log."""

import pytest

from tidegraph import __main__ as command
from tidegraph import sinks
from tidegraph.graph import Graph
from tidegraph.schema import Options
from tidegraph.sources import text
from tidegraph.streaming.live import pagerank_step

DAY = 86_400
LOG = "# a log\n" + "\n".join(f"{k} {s} {d} {t * DAY}" for k, s, d, t in [("a", 1, 2, 1), ("a", 2, 3, 2), ("a", 3, 1, 3), ("a", 3, 4, 4), ("a", 1, 2, 5), ("d", 1, 2, 6), ("a", 4, 5, 7), ("d", 3, 4, 8)]) + "\n"


@pytest.fixture
def run(spark, tmp_path, monkeypatch, capsys):
    (tmp_path / "log.txt").write_text(LOG)
    monkeypatch.setattr(sinks, "series_name", lambda graph, program: str(tmp_path / program))
    monkeypatch.setattr(sinks, "properties_name", lambda graph, dynamic: str(tmp_path / "props"))

    def go(program, *more):
        code = command.main([program, "-g", str(tmp_path / "log.txt"), "-changes", "-pt", "1", *more])
        return code, capsys.readouterr().out, lambda name: spark.read.csv(str(tmp_path / name), header=name != "props").collect()

    return go


def test_pagerank_series(run, monkeypatch):
    monkeypatch.setattr(command, "pagerank_step", lambda: pagerank_step(1e-3))
    code, out, read = run("pagerank", "-de", "4", "-p", "-plot", "-n", "2")
    rows = read("pagerank")
    assert code == 0 and "rank" in out and len(read("props")) == 5
    assert [r["e"] for r in rows] == ["4", "4"] and [r["date"] for r in rows] == ["1970-01-05", "1970-01-09"]


def test_slopes(spark):
    log = [("ADD", s, d, 1.0, t * DAY) for s, d, t in [(1, 2, 1), (2, 3, 2), (3, 1, 3), (1, 3, 4), (2, 1, 5), (3, 2, 6)]]
    g = Graph(text.events_of(spark, log), Options(time_pos=1, snapshot_events=2))
    rows = command.series(g, "pagerank", command.arguments(["pagerank", "-g", "x", "-de", "2", "-plotdt", "-ia", "1", "2"])).collect()
    assert len(rows) == 3 and {"1", "2"} <= set(rows[0].asDict()) and "3" not in rows[0].asDict()
    assert rows[0]["1"] is None and rows[1]["1"] is not None and rows[2]["1"] is None


def test_dynamic_programs(run):
    code, out, _ = run("temporal", "-de", "4", "-o", "-c", "-plot")
    assert code == 0 and "differing windows: 0" in out and "violations: 0" in out
    code, out, read = run("colour", "-de", "8", "-c", "-plot")
    assert code == 0 and "violations: 0" in out and len(read("colour")) == 2
    with pytest.raises(ValueError):
        run("sssp", "-de", "4")  # deletions


def test_refused(run):
    with pytest.raises(ValueError):
        run("pagerank", "-plot")
    with pytest.raises(ValueError):
        run("stats", "-de", "2", "-plot")
