"""Plans of whole project documents: nested media, time maps, lanes, angles, time codes."""

import math
from fractions import Fraction

import pytest

from tidemark.sources import project as P
from tidemark.sources import timeline as N

HEAD = """<fcpxml><resources><format id="r1" frameDuration="1/25s"/><effect id="e1" uid="x"/>
<asset id="a1" start="0s" duration="100s" hasAudio="1" audioRate="48000"/><asset id="a2" start="10s" duration="20s" hasAudio="1"/><asset id="a3" duration="9s" hasAudio="0"/>
{media}</resources><project uid="u"><sequence format="r1" duration="{whole}" tcStart="{tc}"><spine>{spine}</spine></sequence></project></fcpxml>"""


RAMP = '<timeMap><timept time="0s" value="0s" interp="linear"/><timept time="2s" value="2s" interp="linear"/><timept time="4s" value="8s" interp="linear"/></timeMap>'
MEDIA = '<media id="m1"><sequence tcStart="0s" duration="30s"><spine><asset-clip name="x" ref="a1" offset="0s" duration="5s" start="1s"/><asset-clip name="y" ref="a2" offset="5s" duration="5s"/><title name="t" ref="e1" lane="1" offset="6s" duration="1s"/></spine></sequence></media>'
LOOP = '<media id="m3"><sequence duration="9s"><spine><ref-clip name="again" ref="m3" offset="1s" duration="3s" start="0s"/></spine></sequence></media>'
OUTER = '<media id="m2"><sequence duration="30s"><spine><ref-clip name="in" ref="m1" offset="0s" duration="4s" start="0s">' + RAMP + "</ref-clip></spine></sequence></media>"
LONG = '<media id="m1"><sequence duration="30s"><spine><gap name="hole" offset="0s" duration="9s"><title name="t" ref="e1" lane="1" offset="1s" duration="5s"/></gap></spine></sequence></media>'
CAMS = '<media id="mc"><multicam><mc-angle angleID="p"><asset-clip name="p" ref="a1" offset="0s" duration="9s" start="0s"/></mc-angle><mc-angle angleID="q"><gap offset="0s" duration="2s"/><asset-clip name="q" ref="a2" offset="2s" duration="7s"/></mc-angle></multicam></media>'
CAM = '<mc-clip name="m" ref="mc" offset="0s" duration="5s" start="1s">{}</mc-clip>'
BOTH = '<mc-source angleID="p" srcEnable="video"/><mc-source angleID="q" srcEnable="audio"/>'
ROLES = '<asset-clip name="m" ref="a1" offset="0s" duration="2s" audioRole="music.score"/><asset-clip name="v" ref="a1" offset="2s" duration="2s" srcEnable="video"/><asset-clip name="n" ref="a3" offset="4s" duration="2s"/><asset-clip name="d" ref="a1" offset="6s" duration="2s"><adjust-volume amount="-6.5dB"/></asset-clip>'
point = lambda t, v, more='interp="linear"': f'<timept time="{t}" value="{v}" {more}/>'
mapped = lambda *points: f'<ref-clip name="r" ref="m1" offset="0s" duration="4s" start="0s"><timeMap>{"".join(points)}</timeMap><asset-clip name="b" ref="a1" lane="-1" offset="1s" duration="2s" start="7s"/></ref-clip>'
stopped = lambda why: [("r", "m1", "0", "4", None, None, why), ("r/b", "a1", "1", "2", "7", "2", None)]
lost = lambda path, ref, offset, duration, why: [(path, ref, offset, duration, None, None, why)]

#: name: spine, media, length, first time code; the plan; the titles.
CASES = {
    "ramp": ((f'<asset-clip name="c" ref="a1" offset="0s" duration="4s" start="0s">{RAMP}</asset-clip>', "", "4s"), [("c", "a1", "0", "2", "0", "2", None), ("c", "a1", "2", "2", "2", "6", None)], []),
    "trimmed": (('<gap name="g" offset="3600s" duration="1s"/><ref-clip name="r" ref="m1" offset="3601s" duration="6s" start="3s"/>', MEDIA, "7s", "3600s"), [("r/x", "a1", "1", "2", "4", "2", None), ("r/y", "a2", "3", "4", "0", "4", None)], [("r/t", "4", "5", 1, False)]),
    # Outer: 3 s show 1 s of m2, then 3 s show 3 s. Inner: m2 0-2 shows 0-2 of m1, 2-4 shows 2-8.
    "nested ramps": (
        ('<ref-clip name="out" ref="m2" offset="0s" duration="6s" start="0s"><timeMap>' + point("0s", "0s") + point("3s", "1s") + point("6s", "4s") + "</timeMap></ref-clip>", MEDIA + OUTER, "6s"),
        [("out/in/x", "a1", "0", "3", "1", "1", None), ("out/in/x", "a1", "3", "1", "2", "1", None), ("out/in/x", "a1", "4", "1", "3", "3", None), ("out/in/y", "a2", "5", "1", "0", "3", None)],
        [("out/in/t", "16/3", "17/3", 1, True)],
    ),
    "cut title": ((f'<ref-clip name="r" ref="m1" offset="0s" duration="4s" start="0s">{RAMP}</ref-clip>', LONG, "4s"), [], [("r/hole/t", "1", "10/3", 2, True)]),
    "reverse": ((mapped(point("0s", "5s"), point("4s", "1s")), MEDIA, "4s"), stopped("reverse"), []),
    "freeze": ((mapped(point("0s", "1s"), point("4s", "1s")), MEDIA, "4s"), stopped("freeze"), []),
    "smooth": ((mapped(point("0s", "0s", ""), point("4s", "4s", "")), MEDIA, "4s"), stopped("smooth"), []),
    "eased": ((mapped(point("0s", "0s", 'interp="linear" outTime="1s"'), point("4s", "4s")), MEDIA, "4s"), stopped("smooth"), []),
    "short map": ((mapped(point("1s", "0s"), point("4s", "4s")), MEDIA, "4s"), stopped("points"), []),
    "odd map": ((mapped(point("0s", "0s"), point("x", "4s")), MEDIA, "4s"), stopped("points"), []),
    "lead": (('<asset-clip name="c" ref="a1" offset="0s" duration="4s" start="0s"><timeMap>' + point("0s", "0s") + point("1/1000s", "0s") + point("4s", "3999/500s") + "</timeMap></asset-clip>", "", "4s"), [("c", "a1", "1/1000", "3999/1000", "0", "3999/500", None)], []),
    "anchored": (
        (
            '<clip name="c" offset="0s" duration="3s" start="2s" enabled="0"><asset-clip name="in" ref="a1" offset="0s" duration="9s" start="0s"/>'
            '<asset-clip name="up" ref="a1" lane="1" offset="4s" duration="9s" start="50s"/><spine lane="2" offset="3s" name="line"><asset-clip name="s" ref="a2" offset="1s" duration="2s"/></spine>'
            '<title name="t" ref="e1" lane="3" offset="1s" duration="3s"/></clip><gap offset="3s" duration="4s"/>',
            "",
            "7s",
        ),
        [("c/line/s", "a2", "2", "2", "0", "2", None), ("c/up", "a1", "2", "5", "50", "5", None)],
        [("c/t", "0", "2", 1, False)],
    ),
    "angles": ((CAM.format(BOTH), CAMS, "5s"), [("m/q", "a2", "1", "4", "0", "4", None)], []),
    "unknown angle": ((CAM.format('<mc-source angleID="z"/>'), CAMS, "5s"), lost("m", "mc", "0", "5", "angle"), []),
    "doubled angle": ((CAM.format('<mc-source angleID="p"/><mc-source angleID="p"/>'), CAMS, "5s"), lost("m", "mc", "0", "5", "angle"), []),
    "no angle": ((CAM.format(""), CAMS, "5s"), lost("m", "mc", "0", "5", "angle"), []),
    "angles alike": ((CAM.format('<mc-source angleID="p"/>'), CAMS.replace('"q"', '"p"', 1), "5s"), lost("m", "mc", "0", "5", "angle"), []),
    "loop": (('<ref-clip name="r" ref="m3" offset="0s" duration="3s"/>', LOOP, "3s"), lost("r/again", "m3", "1", "2", "cycle"), []),
    "missing": (('<ref-clip name="r" ref="none" offset="0s" duration="3s"/>', "", "3s"), lost("r", "none", "0", "3", "missing"), []),
    "a sample too far": (('<asset-clip name="c" ref="a2" offset="0s" duration="960001/48000s" start="10s"/>', "", "30s"), [("c", "a2", "0", "960001/48000", "0", "20", None)], []),
    "too far": (('<asset-clip name="c" ref="a2" offset="0s" duration="21s" start="10s"/>', "", "30s"), lost("c", "a2", "0", "21", "range"), []),
    "too early": (('<asset-clip name="c" ref="a2" offset="0s" duration="2s" start="9s"/>', "", "30s"), lost("c", "a2", "0", "2", "range"), []),
    "roles": ((ROLES,), [("m", "a1", "0", "2", None, None, "role"), ("d", "a1", "6", "2", "0", "2", None)], []),
    "odd time": (('<asset-clip name="c" ref="a1" offset="zero" duration="2s"/>', "", "30s"), [], []),
    "empty": (("",), [], []),
}


def document(spine, media="", whole="20s", tc="0s"):
    return HEAD.format(spine=spine, media=media, whole=whole, tc=tc)


@pytest.fixture(scope="module")
def nodes(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("projects")
    for i, (case, _, _) in enumerate(CASES.values()):
        (folder / f"{i}.fcpxml").write_text(document(*case))
    (folder / "bad.fcpxml").write_text("<a/>")
    return N.read_nodes(spark, str(folder)).cache()


def by_document(rows):
    out = {name: [] for name in CASES}
    for r in rows:
        out[list(CASES)[int(r.doc.rsplit("/", 1)[1].split(".")[0])]].append(r)
    return out


def test_plans_and_titles_of_all_documents(nodes):
    walk = P.walked(nodes)
    plans, shown = by_document(P.plan(walk).collect()), by_document(P.titles(walk, N.header(nodes)).collect())
    for name, (_, plan, titles) in CASES.items():
        got = sorted(((r.path, r.asset, r.offset, r.duration, r.source, r.source_len, r.reason) for r in plans[name]), key=lambda r: (Fraction(r[2]), r[0]))
        assert got == sorted(plan, key=lambda r: (Fraction(r[2]), r[0])), name
        assert sorted((r.path, r.begin, r.end, r.pieces, r.warped) for r in shown[name]) == titles, name
    assert [str(r.db) for r in plans["roles"] if r.path == "d"] == ["-6.5000"]
    frames = {r.path: (r.start_frame, r.end_frame, r.exact) for r in shown["nested ramps"]}
    assert frames == {"out/in/t": (133, 142, False)}
    for rows in plans.values():
        for r in rows:
            begin, end = Fraction(r.offset), Fraction(r.offset) + Fraction(r.duration)
            assert (r.start_sample, r.samples) == (math.floor(begin * 16000 + Fraction(1, 2)), math.floor(end * 16000 + Fraction(1, 2)) - math.floor(begin * 16000 + Fraction(1, 2)))


def test_all_roles(nodes):
    rows = by_document(P.plan(P.walked(nodes.where("doc LIKE '%/22.fcpxml'"), "all"), "all").collect())
    assert sorted((r.path, r.reason) for r in rows["roles"]) == [("d", None), ("m", None)]


def test_depth_is_told(nodes):
    at = list(CASES).index("nested ramps")
    rows = by_document(P.plan(P.walked(nodes.where(f"doc LIKE '%/{at}.fcpxml'"), depth=1)).collect())["nested ramps"]
    assert {(r.path, r.reason) for r in rows} == {("out/in", "deep")}


def test_no_documents(nodes):
    walk = P.walked(nodes.where("doc LIKE '%bad%'"))
    assert P.plan(walk).collect() == [] and P.titles(walk, N.header(nodes)).collect() == []
