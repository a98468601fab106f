"""Numbers and sums over ranges, and the shared folder."""

import os
import random

import pytest
from pyspark.sql import functions as F

from netquill.operators import relational as rel
from netquill.plans import checkpoint


def test_running_totals_over_ranges(spark, rows):
    rnd = random.Random(1)
    data = [(rnd.choice("abc"), k, rnd.randrange(9)) for k in range(2000)] + [(None, 1, 5), (None, 2, 6)]
    got = {(r["g"], r["x"]): (r["c"], r["c_total"]) for r in checkpoint.running_totals(rows(data, "g string, x long, n long").repartition(7), ["g"], "x", "n", "c").collect()}
    for g in ("a", "b", "c", None):
        mine, c = sorted((x, n) for k, x, n in data if k == g), 0
        for x, n in mine:
            c += n
            assert got[g, x] == (c, sum(n for _, n in mine))
    assert len(got) == len(data)


def test_medians(spark, rows):
    d = rows([("a", 1.0), ("a", 5.0), ("a", 5.0), ("a", 9.0), ("b", 2.0), ("b", 4.0), ("c", None), ("d", 3.0)], "g string, value double")
    assert {r["g"]: r["median"] for r in rel.medians(d, "g").collect()} == {"a": 5.0, "b": 3.0, "d": 3.0}


def test_rising_steps(spark, rows):
    d = rows([(k, v) for k, v in enumerate([1.0, 2.0, 2.0, 1.0, None, 3.0, 4.0])], "at long, v double").repartition(3)
    assert rel.rising_steps(d, "at", "v").first()["n_rises"] == 2


def test_tables_are_freed(spark):
    t = checkpoint.cut(spark.range(5))
    path = "/" + t._cut_path.removeprefix("file:").lstrip("/")
    assert os.path.isdir(path) and t.count() == 5
    checkpoint.free(t, None, spark.range(1))
    assert not os.path.exists(path)


class Unset:
    """A session in which the shared folder isn't set."""

    def __init__(self, master):
        self.conf = self.sparkContext = self
        self.master = master

    def get(self, key, default=None):
        return default

    def getConf(self):  # noqa: N802
        return self


def test_a_cluster_needs_a_shared_folder():
    with pytest.raises(RuntimeError):
        checkpoint.shared_root(Unset("spark://host:7077"))
    assert checkpoint.shared_root(Unset("local[2]")).startswith("file://")


def test_top_of(spark):
    d = spark.range(100).select((F.col("id") % 3).alias("k"), "id")
    assert sorted(r["id"] for r in rel.top_of(d, ["k"], [F.desc("id")], 2).collect()) == [94, 95, 96, 97, 98, 99]


def test_tasks_do_not_grow_with_tables(spark, tmp_path, monkeypatch):
    """Reading a table makes parts as many as its size needs; smaller settings stay."""
    from netquill import session
    from netquill.plans import registry

    keys = ["spark.sql.shuffle.partitions", *session.MOST]
    before = {k: spark.conf.get(k) for k in keys}
    spark.range(100_000).write.parquet(str(tmp_path / "numbers.parquet"))
    monkeypatch.setattr(session, "BYTES_A_PART", 10_000)
    try:
        for k, size in zip(session.MOST, ("128MB", "1m")):
            spark.conf.set(k, size)
        assert registry.t(spark, str(tmp_path), "numbers").count() == 100_000
        assert int(spark.conf.get(keys[0])) > 20 and [spark.conf.get(k) for k in session.MOST] == [str(16 << 20), "1m"]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
