import json

import numpy as np
import pytest

from brindle.operators import events as E
from brindle.operators.frame import column_types
from brindle.sources import arrays_io as IO
from brindle.sources import delimited as C
from brindle.streaming import monitor


def test_csv_inference(spark):
    t = C.parse_csv(spark, "int_col,float_col,bool_col,str_col\n1,1.5,true,x\n2,2.5,no,y\n")
    assert column_types(t) == {"int_col": "int32", "float_col": "float64", "bool_col": "bool", "str_col": "string"}
    assert column_types(C.parse_csv(spark, "f\n0\n1\n")) == {"f": "bool"}
    assert column_types(C.parse_csv(spark, "f\n9223372036854775806\n")) == {"f": "int64"}
    assert [tuple(r) for r in C.parse_csv(spark, "a,b,c\n1,2.5,foo\n,NA,\n3,4.5,bar\n").collect()] == [(1, 2.5, "foo"), (None, None, None), (3, 4.5, "bar")]
    empty = C.parse_csv(spark, "name,age,score\n")
    assert empty.count() == 0 and len(empty.columns) == 3
    typed = C.parse_csv(spark, "id,flag\n7,yes\nx,no\n", types={"id": "int32", "flag": "bool"})
    assert [tuple(r) for r in typed.collect()] == [(7, True), (None, False)]
    with pytest.raises(ValueError):
        C.parse_csv(spark, "a,b\n1\n")


def test_csv_files_round_trip(spark, tmp_path):
    t = spark.createDataFrame([(5, "x", 1.5), (7, None, None)], "a int, b string, c double")
    C.write_csv(t, str(tmp_path / "t"), sep=";", na="NA")
    back = C.read_csv(spark, str(tmp_path / "t"), sep=";")
    assert sorted(map(tuple, back.collect())) == [(5, "x", 1.5), (7, None, None)]
    assert sorted(r[0] for r in C.csv_lines(t).collect()) == ["5,x,1.5", "7,,"]


def test_numbers(spark, tmp_path):
    (tmp_path / "n.txt").write_text("# head\n1 2\n\n3 4 # tail\n")
    assert [r["values"] for r in C.read_numbers(spark, str(tmp_path / "n.txt")).orderBy("line").collect()] == [[1.0, 2.0], [3.0, 4.0]]


def test_array_files(spark, tmp_path):
    a = np.arange(6, dtype=np.float32).reshape(2, 3)
    IO.save_npy(str(tmp_path / "a.npy"), a)
    IO.save_npz(str(tmp_path / "b.npz"), {"x": a, "y": np.array([1, 2])})
    IO.save_safetensors(str(tmp_path / "c.safetensors"), {"w": a, "n": np.array([7], np.int64)})
    got = IO.read_npy(spark, str(tmp_path / "a.npy")).first()
    assert got["shape"] == [2, 3] and got["values"] == a.ravel().tolist() and got["dtype"] == "float32"
    assert {r["name"] for r in IO.read_npz(spark, str(tmp_path / "b.npz")).collect()} == {"x", "y"}
    assert {r["name"]: r["values"] for r in IO.read_safetensors(spark, str(tmp_path / "c.safetensors")).collect()} == {"w": a.ravel().tolist(), "n": [7.0]}
    (tmp_path / "d.idx").write_bytes(bytes([0, 0, 8, 1, 0, 0, 0, 3, 5, 6, 7]))
    assert IO.read_idx(spark, str(tmp_path / "d.idx")).first()["values"] == [5.0, 6.0, 7.0]
    (tmp_path / "e.bin").write_bytes(bytes([3]) + bytes(3072))
    assert IO.read_cifar(spark, str(tmp_path / "e.bin")).first()["label"] == 3


LOG = [
    {"type": "define_metric", "key": "train/loss", "summary": "min"},
    {"type": "metric", "step": 1, "timestamp": 42.0, "key": "train/loss", "value": 1.5},
    {"type": "metric", "step": 2, "timestamp": 43.0, "key": "train/loss", "value": 0.5},
    {"type": "metric", "step": 3, "timestamp": 44.0, "key": "train/loss", "value": 0.9},
    {"type": "tags", "values": ["x", "y"]}, {"type": "tags", "values": ["y", "z"]}, {"type": "notes", "value": "first"}, {"type": "notes", "value": "second"},
    {"type": "finished", "status": "finished", "ended_at": 50.0},
    {"type": "metric", "step": 4, "timestamp": 51.0, "key": "train/loss", "value": 9.0},
]


def log(spark, lines):
    rows = [("r1", i, x if isinstance(x, str) else json.dumps(x)) for i, x in enumerate(lines)]
    return E.parse(spark.createDataFrame(rows, "run_id string, ord long, value string"))


def test_event_log(spark):
    e = E.live(log(spark, [*LOG, "not json", '{"type": "other"}']))
    assert e.count() == len(LOG) - 1
    assert E.latest(e).first()["value"] == 0.9
    assert [r["value"] for r in E.history(e, "train/loss").collect()] == [1.5, 0.5, 0.9]
    assert tuple(E.best(e).first()) == ("r1", "train/loss", 0.5, 44.0)
    assert E.summary(e).first()["value"] == 0.5
    assert tuple(E.status(e).first()) == ("r1", "finished", 50.0)
    assert E.status(log(spark, [*LOG, {"type": "resumed", "at": 60.0}])).first()["status"] == "running"
    assert E.tags(e).first()["tags"] == ["x", "y", "z"] and E.notes(e).first()["notes"] == "second"
    given = log(spark, [*LOG, {"type": "summary", "values": {"train/loss": "0.1"}}])
    assert E.summary(given).first()["value"] == 0.1


def test_session_and_stream(spark, tmp_path):
    with E.Session(spark, str(tmp_path), "exp", "run-1") as s:
        s.log_metrics({"loss": 2.0, "acc": 0.5}, 1, 10.0)
        s.log_metric("loss", 1.0, 2, 11.0)
    e = E.read(spark, str(tmp_path / "exp" / "run-1"))
    assert {(r["run_id"], r["key"], r["value"]) for r in E.latest(e).collect()} == {("run-1", "loss", 1.0), ("run-1", "acc", 0.5)}
    stream = monitor.tail(spark, str(tmp_path / "exp"))
    got = monitor.run_to_memory(monitor.latest_metrics(stream), "latest_test", "complete", str(tmp_path / "cp"))
    assert {(r["key"], r["value"]) for r in got.collect()} == {("loss", 1.0), ("acc", 0.5)}
    seen = spark.createDataFrame([("a", 10.0, False), ("b", 10.0, True), ("c", 19.0, False)], "run_id string, seen double, ended boolean")
    assert {r[0]: r[1] for r in monitor.live_status(seen, 20.0).collect()} == {"a": "stopped", "b": "finished", "c": "running"}


def test_log_lines_keep_their_order_over_flushes(spark, tmp_path):
    from brindle.operators import events

    run = events.Session(spark, str(tmp_path), "exp", "r1")
    for step in range(4):
        for k in range(30 if step == 1 else 1):
            run.log_metric("loss", 10.0 * step + k / 100, step=step * 100 + k, timestamp=1.0)
        run.set_notes(f"note {step}")
        run.flush()
    found = events.read(spark, f"{tmp_path}/exp/r1").orderBy("ord").collect()
    steps = [r["step"] for r in found if r["type"] == "metric"]
    assert steps == sorted(steps) and len(steps) == 33 and [r["note"] for r in found if r["type"] == "notes"][-1] == "note 3"
