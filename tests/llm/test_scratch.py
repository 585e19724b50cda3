"""Working tables: whose they are, and that nothing is left."""

from pathlib import Path
from types import SimpleNamespace

import pytest

import corpus_pipeline
from tideline.llm import scratch
from tideline.llm.ngram_join import ngram_components


def files_of(df):
    return Path(df._scratch.removeprefix("file://"))


def test_scopes(spark):
    """Tables of a scope are its own; what it leaves passes on; dropped tables are gone."""
    outer = scratch.table(spark.range(3), "outer")
    with scratch.scope() as mine:
        a, b = scratch.table(spark.range(3), "a"), scratch.table(spark.range(4), "b")
        assert mine == [a._scratch, b._scratch]
        with scratch.scope() as inner:
            scratch.table(spark.range(1), "c")
            scratch.delete(spark, inner)
        scratch.drop(a)
        assert mine == [b._scratch] and not files_of(a).exists() and files_of(b).exists()
    assert {outer._scratch, b._scratch} <= set(scratch._unscoped)
    scratch.release(spark)
    assert not scratch._unscoped and not files_of(b).exists() and not files_of(outer).exists()


def test_no_local_folder_on_a_cluster():
    """Without a shared folder a cluster session is refused."""
    session = SimpleNamespace(conf=SimpleNamespace(get=lambda name, default: default), sparkContext=SimpleNamespace(master="spark://host:7077"))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        scratch.root(session)
    session.conf.get = lambda name, default: "hdfs://shared/folder/"
    assert scratch.root(session) == "hdfs://shared/folder"


def test_nothing_is_left(spark, sf):
    """The n-gram join leaves its result, the pipeline the documents that its result reads; release deletes both."""
    scratch.release(spark)
    root = Path(scratch.root(spark).removeprefix("file://")) / "tideline"
    before = set(root.iterdir()) if root.exists() else set()
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert ngram_components(docs).count() == docs.count() and len(scratch._unscoped) == 1
    out = corpus_pipeline.run(spark, sf)
    n = out.count()
    assert len(scratch._unscoped) == 2 and 0 < n < docs.count()
    scratch.release(spark)
    assert set(root.iterdir()) <= before
