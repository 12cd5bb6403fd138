"""Tables in the shared folder."""

import os
from types import SimpleNamespace

import pytest

from quern import storage


def folder(df):
    return df.inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0]


def test_a_cluster_needs_a_shared_folder():
    session = SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: default), sparkContext=SimpleNamespace(master="spark://host:7077", applicationId="a"))
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        storage.shared_folder(session)
    named = SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: "s3a://bucket/shared/"), sparkContext=session.sparkContext)
    assert storage.shared_folder(named) == "s3a://bucket/shared"


def test_the_session_keeps_its_settings(spark):
    before = spark.conf.get("spark.checkpoint.dir", None)
    storage.materialize(spark.range(3), "kept")
    assert spark.conf.get("spark.checkpoint.dir", None) == before


def test_scratch_and_discard(spark):
    keep = []
    with storage.scratch(spark, keep):
        gone = storage.materialize(spark.range(3), "gone")
        keep.append(storage.materialize(gone.selectExpr("id + 1 AS id"), "kept"))
        with storage.scratch(spark, inner := []):
            inner.append(storage.materialize(spark.range(1), "inner"))
        places = [folder(t) for t in (gone, keep[0], inner[0])]
    assert [os.path.exists(p) for p in places] == [False, True, False]
    assert keep[0].count() == 3
    storage.discard(keep[0], spark.range(2))
    assert not os.path.exists(places[1])
