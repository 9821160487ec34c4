"""Comparing renderings: how often a pixel is shuffled, values of the report, and odd sides."""

import json
import random

import duckdb
import pytest

from inkfold.operators import evaluate
from inkfold.plans.queries import QUERIES, SQL
from tests.compare import assert_same, tables

SF = "/root/testdata/sf0.001"
PIXEL = "board_id string, dpi int, x int, y int, r int, g int, b int"


def shuffled(spark, run) -> int:
    """How many rows the stages of a run write to shuffles."""
    sc = spark.sparkContext._jsc.sc()
    none = spark.sparkContext._jvm.java.util.ArrayList()

    def written():
        sc.listenerBus().waitUntilEmpty()
        stages = sc.statusStore().stageList(none, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), none)
        return {(s.stageId(), s.attemptId()): s.shuffleWriteRecords() for s in (stages.apply(i) for i in range(stages.size()))}

    old = written()
    run()
    return sum(n for k, n in written().items() if k not in old)


@pytest.mark.parametrize("name", ["evaluation_report", "compare_renderings", "aggregate_scales"])
def test_lines_and_pixels_are_shuffled_once(spark, name):
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        rows = shuffled(spark, lambda: QUERIES[name](spark, SF).collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    lines = spark.read.parquet(f"{SF}/lineitem.parquet").count()
    # A line, its pixel on two sides at two scales, and what there is of regions and boards.
    assert 5 * lines <= rows < 5.5 * lines


def test_report_against_sql(spark):
    con = tables(SF)
    scales = con.execute(SQL["compare_renderings"]).df()
    totals = con.execute(SQL["aggregate_scales"]).df().set_index("board_id")
    details = con.execute(SQL["detail_plan"]).df()
    got = {r.board_id: r for r in QUERIES["evaluation_report"](spark, SF).collect()}
    assert set(got) == set(totals.index)
    names = ["mean_error", "within_tolerance", "ink_ratio", "passed"]
    for board, row in got.items():
        found = json.loads(row.json)
        assert [found[n] for n in names] == pytest.approx([totals.loc[board, n] for n in names], rel=1e-12)
        want = scales[scales.board_id == board].sort_values("dpi")
        assert [s["dpi"] for s in found["scales"]] == list(want.dpi)
        for n in names:
            assert [s[n] for s in found["scales"]] == pytest.approx(list(want[n]), rel=1e-12)
        places = ["number", "dpi", "x", "y", "width", "height"]
        assert [tuple(d[p] for p in places) for d in found.get("details") or []] == sorted(details[details.board_id == board][places].itertuples(index=False, name=None))
        assert row.html.startswith("<p>passed" if totals.loc[board, "passed"] else "<p>failed") and row.html.count("<li>") == len(want)


def test_lines_that_tie(spark, tmp_path):
    """Lines equal in the columns that make a pixel, in others not, come in any order without a difference."""
    con = duckdb.connect()
    con.execute(f"""COPY (SELECT * REPLACE (l_orderkey % 7 AS l_orderkey, l_partkey % 2 AS l_partkey, 1 AS l_suppkey, l_linenumber % 2 AS l_linenumber, CAST(l_quantity % 3 AS DOUBLE) AS l_quantity)
      FROM '{SF}/lineitem.parquet' LIMIT 900) TO '{tmp_path}/lineitem.parquet' (FORMAT parquet)""")
    for name in ("difference_image", "compare_renderings", "detail_regions"):
        assert_same(QUERIES[name](spark, str(tmp_path)), tables(str(tmp_path)), SQL[name])


def by_hand(ref, gen):
    """Metrics and ranked regions of one scale of a board, from dicts of places."""
    both = sorted(set(ref) & set(gen))
    gap = {p: sum(abs(u - v) for u, v in zip(ref[p], gen[p], strict=True)) for p in both}
    ink = [sum(765 - sum(side[p]) for p in both) for side in (ref, gen)]
    near = sum(max(abs(u - v) for u, v in zip(ref[p], gen[p], strict=True)) <= 32 for p in both)
    cells = {}
    for x, y in both:
        cells.setdefault((y // 32 * 32, x // 32 * 32), []).append((x, y))
    score = {c: [gap[p] for p in at if ref[p][0] < 255 and len(set(ref[p])) == 1] for c, at in cells.items()}
    ranked = sorted((-sum(v), *c) for c, v in score.items() if v)[:3]
    worst = [(x, y, max(p[0] for p in cells[y, x]) - x + 1, max(p[1] for p in cells[y, x]) - y + 1, -s) for s, y, x in ranked]
    return (sum(gap.values()) / (len(both) * 765), near / len(both), ink[1] / ink[0]), worst


def test_against_brute_force(spark):
    r = random.Random(11)
    sides, rows = {}, ([], [])
    for board, (w, h) in {"a": (70, 40), "b": (33, 90), "c": (5, 3)}.items():
        for dpi in (18, 72):
            ref = {(x, y): (v, v, v if r.random() < 0.7 else 9) for x in range(w) for y in range(h) for v in [r.choice((0, 60, 200, 255))] if r.random() < 0.9}
            gen = {p: tuple(min(255, c + r.choice((0, 0, 3, 50))) for c in v) for p, v in ref.items() if r.random() < 0.95}
            ref[w, h] = gen[w, h] = (1, 2, 3)
            sides[board, dpi] = ref, gen
            for out, side in zip(rows, (ref, gen), strict=True):
                out += [(board, dpi, *p, *v) for p, v in side.items()]
    for out in rows:
        r.shuffle(out)
    a, b = (spark.createDataFrame(out, PIXEL) for out in rows)
    got = {(s.board_id, s.dpi): s for s in evaluate.compare(a, b).collect()}
    assert set(got) == set(sides)
    whole, pairs = evaluate.regions(a, b), evaluate.paired(a, b)
    for dpi in (18, 72):
        ways = [evaluate.worst_regions(whole, dpi).collect(), evaluate.detail_regions(pairs, dpi).collect()]
        for board in "abc":
            metrics, worst = by_hand(*sides[board, dpi])
            s = got[board, dpi]
            assert s.error is None and (s.mean_error, s.within_tolerance, s.ink_ratio) == pytest.approx(metrics, rel=1e-12)
            for way in ways:
                assert [(d.x, d.y, d.width, d.height, d.score) for d in sorted(way, key=lambda d: d.number) if d.board_id == board] == worst


def test_odd_sides(spark):
    whole = [(x, y, 7, 7, 7) for x in range(2) for y in range(2)]
    kinds = {
        "same": (whole, whole), "only reference": (whole, []), "only generated": ([], whole), "wider": (whole, [*whole, (2, 0, 7, 7, 7)]), "twice": ([*whole, whole[0]], whole),
        "apart": ([(1, 0, 7, 7, 7), (0, 1, 7, 7, 7)], [(1, 1, 7, 7, 7), (0, 0, 7, 7, 7)]), "unknown place": ([*whole, (None, 0, 1, 1, 1)], [*whole, (None, 0, 9, 9, 9), (None, 0, 9, 9, 9)]),
        None: (whole, whole),
    }
    a, b = (spark.createDataFrame([(k, 18, *p) for k, sides in kinds.items() for p in sides[i]], PIXEL) for i in (0, 1))
    got = {s.board_id: s for s in evaluate.compare(a, b).collect()}
    errors = {k: evaluate.SIZES_DIFFER for k in ("only reference", "only generated", "wider", None)} | {"twice": evaluate.REPEATED}
    assert {k: s.error for k, s in got.items()} == {k: errors.get(k) for k in kinds}
    for k, s in got.items():
        fine = k in ("same", "unknown place")
        assert s.passed == fine and (s.mean_error, s.within_tolerance, s.ink_ratio) == ((0, 1, 1) if fine else (None, None, None))
    assert evaluate.paired(a, b).where("board_id IS NULL OR x IS NULL OR board_id LIKE 'only%'").count() == 0
