import os

import pytest
from tests.llm import cases

from larderflow.llm import exact_dedup, scratch


def test_released_folders_are_gone(spark):
    docs = cases.table(spark, cases.awkward())
    with scratch.released(spark):
        out = scratch.Scratch(spark, "inside")
        assert exact_dedup.dedup(docs).count() == docs.count()
        out.table(docs, "t")
        assert os.path.isdir(out.path)
    assert not os.path.exists(out.path)
    kept = scratch.Scratch(spark, "outside")
    kept.table(docs, "t")
    assert os.path.isdir(kept.path)


def test_no_machine_local_folder_on_a_cluster(spark):
    class Context:
        master = "spark://host:7077"

        def getConf(self):  # noqa: N802
            return {}

    class Session:
        sparkContext = Context()  # noqa: N815
        conf = {}

    with pytest.raises(ValueError, match="checkpoint"):
        scratch.shared_root(Session())
