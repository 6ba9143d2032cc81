import numpy as np

from epochlane.sources import signals


def test_signal_files_follow_each_other(spark, tmp_path):
    day = tmp_path / "2024_01_02" / "x"
    day.mkdir(parents=True)
    a, b = np.arange(32, dtype="<i2"), np.arange(100, 108, dtype="<i2")
    (day / "R7_a.dat").write_bytes(a.tobytes() + b"\0\0\0")
    (day / "R7_b.dat").write_bytes(b.tobytes())
    (day / "other.dat").write_bytes(b.tobytes())
    got = signals.read_files(spark, str(tmp_path)).orderBy("channel", "sample_idx").collect()
    assert [(r["sample_idx"], r["sample"]) for r in got if r["channel"] == 1] == [(0, 1.0), (1, 9.0), (2, 17.0), (3, 25.0), (4, 101.0)]
    assert {r["channel"] for r in got} == {0, 1, 2, 3} and {(r["subject_id"], str(r["day"])) for r in got} == {("R7", "2024-01-02")}


def test_matrix(spark, tmp_path):
    (tmp_path / "m.csv").write_text("1,nan,3\n,2,0\n")
    got = signals.read_matrix(spark, str(tmp_path / "m.csv"), 3).orderBy("window_id", "pos").collect()
    assert [r["value"] for r in got] == [1.0, None, 3.0, None, 2.0, 0.0]


def test_matrix_of_several_files(spark, tmp_path):
    for name, first in (("b.csv", 100), ("a.csv", 0)):
        (tmp_path / name).write_text("".join(f"{first + i},\n" for i in range(100)))
    got = signals.read_matrix(spark, str(tmp_path), 2).where("pos = 0").collect()
    assert {r["window_id"]: r["value"] for r in got} == {i: float(i) for i in range(200)}
