"""Channel layers through nested media."""

import pytest
from pyspark.sql import functions as F

from tidemark.sources import channels as C
from tidemark.sources import timeline as N

SOURCE = lambda named, db=None, **more: f'<audio-channel-source srcCh="{named}"' + "".join(f' {k}="{v}"' for k, v in more.items()) + ">" + ("" if db is None else f'<adjust-volume amount="{db}"/>') + "</audio-channel-source>"
DOC = '<fcpxml><resources><asset id="a" audioChannels="2"/><asset id="one"/>{media}</resources><project uid="u"><sequence><spine>{spine}</spine></sequence></project></fcpxml>'
INNER = '<media id="m"><sequence><spine><asset-clip ref="a">{}</asset-clip></spine></sequence></media>'
SELF = '<media id="m"><sequence><spine><asset-clip ref="one"/><ref-clip ref="m"/></spine></sequence></media>'

#: spine, media; channel, dB, divisor, reason in order.
CASES = {
    "plain": (('<asset-clip ref="a"/>', ""), [(1, 0.0, 1, None), (2, 0.0, 1, None)]),
    "one group": ((f'<asset-clip ref="a">{SOURCE("1, 2", "-6dB")}</asset-clip>', ""), [(1, -6.0, 2, None), (2, -6.0, 2, None)]),
    "shut out": ((f'<asset-clip ref="a">{SOURCE("2")}</asset-clip>', ""), [(2, 0.0, 1, None)]),
    "inactive": ((f'<asset-clip ref="a">{SOURCE("1")}{SOURCE("2", active=0)}</asset-clip>', ""), [(1, 0.0, 1, None)]),
    "silent": ((f'<asset-clip ref="a">{SOURCE("1,2", enabled=0)}</asset-clip>', ""), []),
    "outer divisor once": ((f'<ref-clip ref="m">{SOURCE("1,2,3", "-1dB")}</ref-clip>', INNER.format(SOURCE("1,2", "-2dB"))), [(1, -3.0, 3, None), (2, -3.0, 3, None)]),
    "inner divisor alone": (('<ref-clip ref="m"/>', INNER.format(SOURCE("1,2", "-2dB"))), [(1, -2.0, 2, None), (2, -2.0, 2, None)]),
    "second source": ((f'<clip>{SOURCE("1,2,3", "-1dB")}<gap><audio ref="a" srcID="2"/></gap></clip>', ""), [(1, -1.0, 3, None)]),
    "each use": ((f'<ref-clip ref="m">{SOURCE("1")}</ref-clip><ref-clip ref="m">{SOURCE("2", "-4dB")}</ref-clip>', INNER.format("")), [(1, 0.0, 1, None), (2, -4.0, 1, None)]),
    "named twice": ((f'<asset-clip ref="one">{SOURCE("1")}{SOURCE("1")}</asset-clip>', ""), [(1, None, None, "channels")]),
    "odd channel": ((f'<asset-clip ref="one">{SOURCE("1,x")}</asset-clip>', ""), [(1, None, None, "channels")]),
    "odd volume": ((f'<asset-clip ref="one">{SOURCE("1", "loud")}</asset-clip>', ""), [(1, None, None, "volume")]),
    "not shown": (("<gap/>", INNER.format("")), []),
    "refused": (("<gap>", ""), []),
}


@pytest.fixture(scope="module")
def found(spark):
    nodes = spark.createDataFrame([r for name, ((spine, media), _) in CASES.items() for r in N.nodes_of(name, DOC.format(spine=spine, media=media).encode())], N.NODES)
    out = {}
    for r in C.weights(nodes).orderBy("doc", "channel").collect():
        out.setdefault(r.doc, []).append(r)
    return out


@pytest.mark.parametrize("name", CASES)
def test_layers(found, name):
    got = found.get(name, [])
    assert [(r.channel, r.db, r.divisor, r.reason) for r in got] == CASES[name][1]
    for r in got:
        assert r.weight is None if r.reason else abs(r.weight - 10 ** (r.db / 20) / r.divisor) < 1e-12


def test_media_in_itself_and_no_documents(spark, monkeypatch):
    nodes = spark.createDataFrame(list(N.nodes_of("d", DOC.format(spine='<ref-clip ref="m"/>', media=SELF).encode())), N.NODES)
    ends = C.weights(nodes).groupBy("reason").agg(F.count(F.lit(1)).alias("n"), F.max(F.size("path")).alias("most")).collect()
    assert {r.reason: (r.n, r.most) for r in ends} == {None: (1, 1), "cycle": (2, 1)}
    monkeypatch.setattr(C, "DEEPEST", 0)
    assert {r.reason for r in C.weights(nodes).collect()} == {"deep"}
    assert C.weights(nodes.where("false")).count() == 0
