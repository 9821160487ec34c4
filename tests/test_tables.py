"""Tables in the shared folder, connected components, and grouping of long groups."""

import random
import time

import numpy as np
import pandas as pd
import pytest

from inkfold import tables
from inkfold.operators.connected import roots
from inkfold.operators.groups import whole_groups


class Conf(dict):
    def set(self, key, value):
        self[key] = value


class Session:
    def __init__(self, **conf):
        self.conf = Conf({k.replace("_", "."): v for k, v in conf.items()})


@pytest.mark.parametrize("master", ["spark://host:7077", "yarn", "k8s://https://x", "local-cluster[2,1,1024]", ""])
def test_no_local_folder_on_a_cluster(master):
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        tables.shared_dir(Session(spark_master=master))
    named = Session(spark_master=master)
    named.conf["spark.checkpoint.dir"] = "hdfs://x/y/"
    assert tables.shared_dir(named) == "hdfs://x/y"


def test_a_local_folder_on_one_machine():
    for master in ("local", "local[8]"):
        session = Session(spark_master=master)
        assert tables.shared_dir(session) == session.conf["spark.checkpoint.dir"] == tables.shared_dir(session)


def test_a_table_replaces_another(spark):
    import os

    old = tables.materialize(spark.range(5))
    new = tables.materialize(old.selectExpr("id + 1 AS id"), instead_of=old)
    path = lambda t: t._table.split(":", 1)[1]
    assert not os.path.exists(path(old)) and sorted(r.id for r in new.collect()) == [1, 2, 3, 4, 5]
    kept = spark.range(3)
    tables.materialize(spark.range(1), instead_of=kept)  # not a table from here: it stays
    assert kept.count() == 3


def test_components_against_brute_force(spark):
    r = random.Random(5)
    links = [(i, i + 1) for i in range(1000, 1060)] + [(r.randrange(200), r.randrange(200)) for _ in range(120)] + [(7, 7), (3, 9), (9, 3), (3, 9), (None, 4)]
    r.shuffle(links)
    least = {x: x for p in links for x in p if x is not None}
    for _ in range(len(links)):
        for a, b in links:
            if a is not None and b is not None:
                least[a] = least[b] = min(least[a], least[b])
    got = dict(map(tuple, roots(spark.createDataFrame(links, "a bigint, b bigint")).collect()))
    assert got == {x: y for x, y in least.items() if x != y}
    assert roots(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_groups_stay_whole(monkeypatch):
    from inkfold.operators import groups

    r = random.Random(2)
    for least in (1, 7, 40):
        monkeypatch.setattr(groups, "ROWS", least)
        keys = sorted((r.randrange(3), r.choice("ab")) for _ in range(r.randint(0, 200)))
        frame = pd.DataFrame(keys, columns=["k", "l"]).assign(v=range(len(keys)))
        cuts = sorted(r.randint(0, len(keys)) for _ in range(12))
        batches = [frame.iloc[a:b] for a, b in zip([0, *cuts], [*cuts, len(keys)], strict=True)]
        out = list(whole_groups(iter(batches), ["k", "l"]))
        assert [v for f in out for v in f.v] == list(range(len(keys)))
        ends = [(f.k.iloc[0], f.l.iloc[0]) for f in out if len(f)]
        assert all(tuple(f[["k", "l"]].iloc[-1]) < e for f, e in zip(out, ends[1:], strict=False))


def test_a_long_group_takes_linear_time():
    batch = pd.DataFrame({"k": np.zeros(2000, np.int64), "v": np.arange(2000)})
    began = time.time()
    (whole,) = whole_groups((batch for _ in range(1000)), ["k"])
    assert len(whole) == 2_000_000 and time.time() - began < 3
