import os

import pytest

from hubloom.llm.queries import NODES_FROM, numbered_nodes, queries
from tests.conftest import SMALL


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="needs the test tables")
@pytest.mark.parametrize("name", queries())
def test_runs(spark, name):
    assert queries()[name](spark, SMALL).count() > 0


def test_long_node_numbers_stay_apart(spark):
    a, b = "9" * 19, "9" * 18 + "8"
    own = spark.createDataFrame([(1, a), (2, b), (3, "7"), (4, a), (5, "1" * 40)], "hub long, n string")
    tied = spark.createDataFrame([(b, b), (b, "7")], "first string, n string")
    got = {(r.a, r.b) for r in numbered_nodes(own, tied).collect()}
    v = {r[0]: r[1] for r in got}
    assert v[1] == v[4] and len({v[1], v[2], v[3], v[5]}) == 4 and v[3] == NODES_FROM + 7
    assert {(v[2], v[2]), (v[2], v[3])} <= got
