from types import SimpleNamespace

import pytest

from wareloom import session


def fake(master, folder=None):
    context = SimpleNamespace(master=master, getCheckpointDir=lambda: "set", setCheckpointDir=None)
    if folder is None:
        context.getCheckpointDir = lambda: None
    return SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda key, default=None: folder or default))


def test_a_cluster_without_a_shared_folder_is_refused():
    with pytest.raises(session.NoSharedFolder):
        session.checkpoint_folder(fake("spark://host:7077"))


def test_the_named_folder_is_used():
    assert session.checkpoint_folder(fake("spark://host:7077", "hdfs://shared")) == "hdfs://shared"


def test_a_local_session_gets_a_folder(spark):
    assert session.checkpoint_folder(spark)
