import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from coweave.session import build_session
    s = build_session(master="local[4]", shuffle_partitions=4)
    if not s.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        s.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="coweave-test-ckpt-"))
    yield s
    s.stop()


@pytest.fixture()
def tmp_dir():
    return tempfile.mkdtemp(prefix="coweave-test-")


def graph_of(spark, edges, vertices=None):
    """CoGraph from a list of (src, dst[, w]) and optional {id: name}."""
    from coweave.operators.graph import build_graph
    rows = [(a, b, (e[2] if len(e) > 2 else 1)) for e in edges for a, b in [e[:2]]]
    e = spark.createDataFrame(rows, "src bigint, dst bigint, w bigint")
    ids = sorted({x for r in rows for x in r[:2]} | set((vertices or {}).keys()))
    names = vertices or {i: f"v{i}" for i in ids}
    v = spark.createDataFrame([(i, names[i]) for i in names], "id bigint, name string")
    return build_graph(v, e)
