import random

import pytest
from pagewise.operators import layout as L
from pagewise.operators import tables as t
from pyspark.sql import functions as F


def lines(spark, *rows):
    return spark.createDataFrame([("d", 1, k, *r) for k, r in enumerate(rows)], "document_id string, page int, position int, text string, confidence double, x0 double, y0 double, x1 double, y1 double")


def groups(spark, *rows):
    return [r.text for r in L.group_lines(lines(spark, *rows)).orderBy("place").collect()]


def test_lines_group_by_gap_and_keep_columns_apart(spark):
    left = [(f"l{k}", 0.9, 0.0, 12.0 * k, 100.0, 12.0 * k + 10) for k in range(3)]
    right = [(f"r{k}", 0.9, 150.0, 12.0 * k + 1, 250.0, 12.0 * k + 11) for k in range(3)]
    mixed = [x for pair in zip(left, right) for x in pair]
    assert groups(spark, *mixed) == ["l0 l1 l2", "r0 r1 r2"]
    assert groups(spark, ("a", 1.0, 0.0, 0.0, 50.0, 10.0), ("b", 1.0, 0.0, 30.0, 50.0, 40.0)) == ["a", "b"]
    assert groups(spark, ("b", 1.0, 0.0, 11.0, 50.0, 21.0), ("a", 1.0, 0.0, 0.0, 50.0, 10.0)) == ["a b"]


def test_lines_are_stripped_and_blank_ones_left_out(spark):
    got = L.group_lines(lines(spark, ("  one ", 1.0, 0.0, 0.0, 50.0, 10.0), (" \t", 1.0, 0.0, 10.0, 50.0, 20.0), ("two\u00a0", 0.5, 0.0, 20.0, 50.0, 30.0), ("", 0.1, 200.0, 0.0, 250.0, 10.0))).orderBy("place").collect()
    assert [(r.text, r.n_lines) for r in got] == [("one two", 3), ("", 1)] and got[1].confidence == 0.0


def test_groups_by_a_slow_reading_of_the_rules(spark):
    """Every line against the last lines of all paragraphs, over random pages."""
    rnd = random.Random(4)
    rows = []
    for page in range(40):
        for k in range(rnd.randrange(1, 60)):
            x, y = rnd.choice([0, 100, 200]) + rnd.random() * 30, rnd.random() * 200
            rows.append((f"d{page % 7}", page, k, f"w{k}", rnd.random(), x, y, x + rnd.choice([0, 30, 90]), y + rnd.choice([0, 8, 10, 11])))
    df = spark.createDataFrame(rows, "document_id string, page int, position int, text string, confidence double, x0 double, y0 double, x1 double, y1 double")
    got = {(r.document_id, r.page, r.place): (r.text, r.n_lines) for r in L.group_lines(df.repartition(5)).collect()}
    want = {}
    for key in {r[:2] for r in rows}:
        own = sorted((r for r in rows if r[:2] == key), key=lambda r: (round(r[6]), r[5], r[2]))
        high = sorted(r[8] - r[6] for r in own if r[8] > r[6])
        h = ((high[(len(high) - 1) // 2] + high[len(high) // 2]) / 2) if high else 1.0
        told = []
        for r in own:
            ranked = []
            for i, p in enumerate(told):
                _, _, _, _, _, x0, y0, x1, y1 = p[-1]
                width = min(x1 - x0, r[7] - r[5])
                share = (min(x1, r[7]) - max(x0, r[5])) / width if width > 0 else 0
                if -h <= r[6] - y1 <= 0.6 * h and share >= 0.15:
                    ranked.append((r[6] - y1, i))
            if ranked:
                told[min(ranked)[1]].append(r)
            else:
                told.append([r])
        told.sort(key=lambda p: (round(min(r[6] for r in p)), min(r[5] for r in p)))
        want |= {(*key, k + 1): (" ".join(r[3] for r in p), len(p)) for k, p in enumerate(told)}
    assert got == want and max(n for _, n in want.values()) > 3


def test_paragraph_confidence_is_weighted_by_length(spark):
    got = L.group_lines(lines(spark, ("aaaa", 1.0, 0.0, 0.0, 9.0, 9.0), ("b", 0.0, 0.0, 9.0, 9.0, 18.0))).collect()[0]
    assert got.confidence == pytest.approx(0.8) and (got.y1, got.n_lines) == (18.0, 2)
    page = L.text_line_pages(L.group_lines(lines(spark, ("aaaa", 0.5, 0.0, 0.0, 9.0, 9.0)))).collect()[0]
    assert page.confidence == 0.5 and page.reasons == ["ocr"]


def test_prediction_lines(spark):
    quad = [[1.0, 2.0], [9.0, 1.0], [10.0, 6.0], [2.0, 7.0]]
    rows = [("d", ["tilted", " ", "no score", "no quad"], [1.5, 0.9], [quad, quad, quad])]
    got = L.prediction_lines(spark.createDataFrame(rows, "document_id string, texts array<string>, scores array<double>, polys array<array<array<double>>>")).collect()
    assert [(r.text, r.confidence) for r in got] == [("tilted", 1.0), ("no score", 0.0)]
    assert (got[0].x0, got[0].y0, got[0].x1, got[0].y1) == (1.0, 1.0, 10.0, 7.0)


def test_widths(spark):
    rows = [("d", 1, 0.0, 10.0, 5.0, 12.0, "a"), ("d", 1, 7.0, 10.2, 0.0, 12.0, "bb"), ("d", 1, 20.0, 10.0, 0.0, 12.0, "ccc")]
    got = L.effective_widths(spark.createDataFrame(rows, "document_id string, page int, x double, y double, width double, font_size double, text string"))
    assert {r.text: (r.effective_width, r.estimated) for r in got.collect()} == {"a": (5.0, False), "bb": (12.0, True), "ccc": (18.0, True)}


def test_boxes(spark):
    df = spark.createDataFrame([(0.0, 0.0, 200.0, 100.0), (5.0, 5.0, 5.0, 9.0)], "x0 double, y0 double, x1 double, y1 double")
    got = [r[0] for r in df.select(L.raster_bbox(*map(F.col, ("x0", "y0", "x1", "y1")), F.lit(2.0), F.lit(792.0))).collect()]
    assert got[0].asDict() == {"x": 0.0, "y": 742.0, "width": 100.0, "height": 50.0} and got[1] is None
    items = spark.createDataFrame([("a", 0.0, 0.0, 5.0, 5.0), ("a", 10.0, 2.0, 5.0, 5.0), ("b", 1.0, 1.0, 0.0, 0.0)], "k string, x double, y double, width double, height double")
    union = {r.k: r.bbox for r in L.bbox_union(items, ["k"]).collect()}
    assert union["a"].asDict() == {"x": 0.0, "y": 0.0, "width": 15.0, "height": 7.0} and union["b"] is None


def test_labels(spark):
    df = spark.createDataFrame([("doc_title", 0), ("chart_title", 0), ("seal", 0), ("odd", 0), ("text", 9), ("table", 2), ("equation", None)], "l string, n int")
    got = df.select(L.layout_type(F.col("l")), L.layout_level(F.col("l")), L.vision_type(F.col("l"), F.col("n")), L.vision_level(F.col("l"), F.col("n"))).collect()
    assert [tuple(r) for r in got] == [
        ("heading", 1, "paragraph", None), ("heading", 2, "paragraph", None), ("image", None, "paragraph", None), ("paragraph", None, "paragraph", None),
        ("paragraph", None, "heading", 6), ("table", None, "table", None), ("paragraph", None, "formula", None),
    ]


def test_regions(spark):
    regions = spark.createDataFrame([("d", 1, 1, 0.0, 0.0, 10.0, 10.0, 0.7), ("d", 1, 2, 50.0, 50.0, 60.0, 60.0, 0.3)], "document_id string, page int, region_id int, x0 double, y0 double, x1 double, y1 double, det_score double")
    got = L.region_confidence(regions, lines(spark, ("aaa", 1.0, 0.0, 0.0, 10.0, 10.0), ("b", 0.2, 8.0, 8.0, 12.0, 12.0), ("c", 0.0, 9.0, 9.0, 79.0, 79.0)))
    assert {r.region_id: round(r.confidence, 6) for r in got.collect()} == {1: 0.8, 2: 0.3}
    raw = spark.createDataFrame([("t", [9.0, 8.0, 1.0, 2.0], "3"), (" ", [0.0, 0.0, 1.0, 1.0], "1"), ("u", [0.0], "1"), ("v", [0.0, 0.0, 1.0, 1.0], "x")], "label string, box array<double>, ord string")
    assert [(r.label, r.x0, r.y0, r.x1, r.y1, r.ord) for r in L.normalise_regions(raw).collect()] == [("t", 1.0, 2.0, 9.0, 8.0, 3), ("v", 0.0, 0.0, 1.0, 1.0, None)]


def test_reading_order_needs_every_order(spark):
    rows = [("d", 1, 0, 5), ("d", 1, 1, 2), ("e", 1, 0, 5), ("e", 1, 1, None)]
    got = {(r.document_id, r.position): r.place for r in L.reading_order(spark.createDataFrame(rows, "document_id string, page int, position int, ord int")).collect()}
    assert got == {("d", 0): 2, ("d", 1): 1, ("e", 0): 1, ("e", 1): 2}


def test_boxes_are_found_by_text(spark):
    blocks = spark.createDataFrame([("d", 1, "b0", 0, "heading", "Ti tle"), ("d", 1, "b1", 1, "paragraph", "same"), ("d", 1, "b2", 2, "paragraph", "same"), ("d", 1, "b3", 3, "table", "same"), ("d", 1, "b4", 4, "code", "absent")], "document_id string, page int, block_id string, place int, type string, text string")
    glyphs = spark.createDataFrame([("d", 1, k, t, 10.0 * k, 5.0, 8.0, 9.0) for k, t in enumerate(["Tit", "le", "sa", "me", "same"])], "document_id string, page int, position int, text string, x double, y double, width double, height double")
    got = {r.block_id: (r.bbox.x, r.bbox.width) for r in L.attach_boxes(blocks, glyphs).collect()}
    assert got == {"b0": (0.0, 18.0), "b1": (20.0, 18.0), "b2": (40.0, 8.0)}


@pytest.mark.parametrize(
    ("html", "size", "headers"),
    [
        ("<table><tr><th>a</th><th>b</th></tr><tr><td>1</td><td>2</td></tr></table>", (2, 2), 1),
        ("<thead><tr><td>a</td></tr></thead><tr><td>1</td></tr>", (2, 1), 1),
        ("<tr><td rowspan=2>a</td><td>b</td></tr><tr><td>c</td></tr>", (2, 2), 0),
        ("<tr><td>a</td></tr><tr><td>b</td><td>c</td></tr>", (2, 2), 0),
        ("<td>loose</td>", (1, 1), 0),
        ("<tr><td colspan='x'>a", (0, 0), 0),
        ("", (0, 0), 0),
        (None, (0, 0), 0),
        ("<tr><th>a</th><td>b</td></tr>", (1, 2), 0),
        ("<tr><td>a</td>", (1, 1), 0),
        ("<tr><td>lost<td>b</td></tr><tr>", (1, 1), 0),
        ("<tr><td rowspan=3>a</td></tr><tr><td colspan=2>b</td></tr>", (3, 3), 0),
        ("<thead><tr><td>a</td></tr><tr><th>b</th></tr></thead><tr><th>c</th></tr><tr><td>d</td><th>e</th></tr>", (4, 2), 3),
    ],
)
def test_grids(html, size, headers):
    slots, got = t.grid_of(html)
    assert (max((s["row"] + 1 for s in slots), default=0), max((s["col"] + 1 for s in slots), default=0)) == size
    assert len(slots) == size[0] * size[1] and got == headers


def test_grid_texts_and_covered_places():
    slots, _ = t.grid_of("<tr><td rowspan=2 colspan=2> a&amp;b<br>c </td><td>x</td></tr><tr><td><b>y</b></td></tr>")
    at = {(s["row"], s["col"]): s for s in slots}
    assert at[0, 0]["text"] == "a&b c" and at[1, 2]["text"] == "y"
    assert all((at[p]["covered_row"], at[p]["covered_col"]) == (0, 0) for p in ((0, 1), (1, 0), (1, 1)))
    assert t.grid_of("<tr><td rowspan=99999999 colspan=99999999>a</td></tr>")[0][0]["text"] == "a"
    huge, _ = t.grid_of("<tr><td rowspan=3000>a</td><td colspan=3000>b</td></tr><tr><td>c</td></tr>")
    assert [(s["row"], s["col"], s["row_span"], s["col_span"], s["text"]) for s in huge] == [(0, 0, 3000, 1, "a"), (0, 1, 1, 3000, "b"), (1, 1, 1, 1, "c")]
    both, _ = t.grid_of("<tr><td>a</td><td rowspan=3>b</td></tr><tr><td colspan=2>c</td></tr><tr><td>d</td></tr>")
    at = {(s["row"], s["col"]): s for s in both}
    assert (at[1, 1]["covered_row"], at[1, 1]["covered_col"]) == (1, 0) and (at[2, 1]["covered_row"], at[2, 1]["covered_col"]) == (0, 1)


def test_what_is_made_of_grids(spark):
    html = spark.createDataFrame([(1, "<tr><td>a</td></tr><tr><td> </td></tr><tr><td>b</td></tr>"), (2, "<tr><td colspan=2>c</td><td>d</td></tr><tr><td>e</td></tr>")], "id int, html string")
    cells = t.cells_of(html).cache()
    assert {r.id: r.text for r in t.table_text(cells, ["id"]).collect()} == {1: "a\nb", 2: "c d\ne"}
    assert sorted((r.id, r.row, r.text) for r in t.flatten_single_column(cells, ["id"]).collect()) == [(1, 0, "a"), (1, 2, "b")]
    assert [(r.place, r.text) for r in t.string_grid(cells, ["id"]).where("id = 2 and row = 0").orderBy("place").collect()] == [(0, "c"), (1, "d")]
