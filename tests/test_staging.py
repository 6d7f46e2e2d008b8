"""The shared folder for intermediate tables."""

import os
from types import SimpleNamespace

import pytest

from rosterlake import staging


def test_a_cluster_needs_a_shared_folder():
    def session(master, folder=None):
        return SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: folder), sparkContext=SimpleNamespace(master=master))

    for master in ("spark://host:7077", "yarn", "k8s://https://host", "local-cluster[3,2,1024]"):
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            staging.shared_dir(session(master))
        assert staging.shared_dir(session(master, "s3a://bucket/x/")) == "s3a://bucket/x"


def test_clear_deletes_what_was_staged(spark):
    rows = staging.staged(spark.range(5), "numbers")
    folder = staging.run_folder(spark).removeprefix("file:").replace("//", "/")
    assert rows.count() == 5 and any(x.startswith("numbers-") for x in os.listdir(folder))
    staging.clear(spark)
    assert not os.path.exists(folder)


def test_passing_tables_go_and_lasting_ones_stay(spark):
    with staging.passing(spark):
        inner = staging.staged(spark.range(3), "inner")
        with staging.passing(spark):
            staging.staged(spark.range(1), "nested")
        assert inner.count() == 3
        kept = staging.staged(inner.where("id > 0"), "kept", lasting=True)
    assert kept.count() == 2
    assert not any("passing-" in f for f in kept.inputFiles())
    with pytest.raises(Exception):
        staging.staged(inner, "gone")
