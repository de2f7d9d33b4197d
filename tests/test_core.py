"""Fixed checks, properties and edge rows of the core operators."""

import json
import math
import os
import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from airgrid.functions import geo
from airgrid.functions import scalars as S
from airgrid.operators import airspace, graph, normalize, reports, risk, smoothing, tracks, traffic
from airgrid.operators.grid import Grid, edges, locate
from airgrid.plans import registry, routes
from airgrid.sinks import writers
from airgrid.sources import constants as K
from airgrid.sources import readers

SMALL = Grid(-88.0, 41.7, -87.97, 41.72)


def test_grid_shape_and_endpoints():
    assert Grid().shape == (183, 219)
    nx, ny = Grid().shape
    assert nx * ny == 40_077


def test_endpoint_cells(spark):
    p = spark.createDataFrame([("clow", *K.START), *K.DESTINATIONS], "n string, lat double, lon double")
    got = {r["n"]: divmod(r["c"], Grid().shape[1]) for r in p.select("n", Grid().cell_id(F.col("lon"), F.col("lat")).alias("c")).collect()}
    assert got == {"clow": (47, 64), "union_station": (156, 118), "ohare": (95, 148), "midway": (130, 91)}


def test_edges_touch_both_ways_once(spark):
    c = SMALL.cells(spark)
    nx, ny = SMALL.shape
    e = [(r["src"], r["dst"]) for r in edges(c).collect()]
    assert len(e) == len(set(e)) == 4 * nx * ny - 3 * nx - 3 * ny + 2
    assert all(a < b or b // ny > a // ny for a, b in e)


def test_locate_outside_takes_nearest(spark):
    p = spark.createDataFrame([("in", 41.71, -87.99), ("sw", 41.0, -89.0), ("ne", 42.5, -87.0)], "k string, lat double, lon double")
    got = {r["k"]: (r["cell_id"], r["inside"]) for r in locate(p, SMALL.cells(spark), SMALL).collect()}
    nx, ny = SMALL.shape
    assert got["sw"] == (0, False) and got["ne"] == (nx * ny - 1, False) and got["in"][1]


def test_airspace_counts():
    named = airspace.rings()
    assert {r: len(v) > 3 for r, v in named.items()} == dict.fromkeys(named, True)
    x0, y0, x1, y1 = Grid().corners
    nx, ny = Grid().shape
    cells = [((x0 + 500 * i + min(x0 + 500 * i + 500, x1)) / 2, (y0 + 500 * j + min(y0 + 500 * j + 500, y1)) / 2) for i in range(0, nx, 1) for j in range(0, ny, 1)]
    count = lambda r, step=1: sum(airspace.inside(p, r, named) for p in cells[::step])
    assert count("area_a") == 2531
    assert count("area_b") == 6999


def test_risk_grid_classes(spark):
    got = {r["air_class"]: r["n"] for r in routes.risk_cells(spark, Grid()).groupBy("air_class").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert abs(got["High"] - 5358) <= 2 and abs(got["Medium"] - 10491) <= 25 and sum(got.values()) == 40_077


def test_distance_only_route(spark):
    g = Grid()
    e = edges(g.cells(spark)).withColumn("weight", F.col("distance_m") / (500 * math.sqrt(2))).withColumn("k", F.lit("x"))
    got = {r["destination"]: (len(r["path"]), round(r["total_cost"], 6)) for r in graph.shortest_paths(e, routes.ends(spark, g), ["k"]).collect()}
    assert got == {"union_station": (110, 92.890873), "ohare": (85, 73.455844), "midway": (84, 66.59798)}


def test_dijkstra_and_turns():
    roads = graph._adjacency(*zip(*[(a, b, w) for a, b, w in K.ROADS], strict=True))
    cost, path = graph.dijkstra(roads, "Bolingbrook", {"Chicago"})["Chicago"]
    assert cost == 30 and path[0] == "Bolingbrook" and path[-1] == "Chicago"
    for angle, want in ((45, 0.09375), (90, 0.375), (135, 0.84375), (180, 1.5)):
        t = math.radians(angle)
        assert graph.turn_cost(0, 0, 1, 0, 1 + math.cos(t), math.sin(t), 1.5) == pytest.approx(want)


def test_turn_search_prefers_straight(spark):
    g = SMALL
    c = g.cells(spark)
    end = lambda n, k: c.select(F.col("cell_id").alias(n), F.col("cx").alias(f"x{k}"), F.col("cy").alias(f"y{k}"))
    e = edges(c).withColumn("weight", F.col("distance_m") / 707.1).withColumn("k", F.lit(1)).join(end("src", 1), "src").join(end("dst", 2), "dst")
    ny = g.shape[1]
    goal = spark.createDataFrame([(0, 3 * ny + 1, "g")], "start long, goal long, destination string")
    turned, plain = graph.turn_paths(e, goal, ["k"]).first(), graph.shortest_paths(e, goal, ["k"]).first()
    assert turned["total_cost"] >= plain["total_cost"] and turned["path"][0] == 0 and turned["path"][-1] == 3 * ny + 1


def test_day_windows_over_clock_changes(spark):
    d = spark.createDataFrame([("2026-03-08",), ("2026-11-01",), ("2026-03-07",)], "d string")
    a, b = S.day_window(F.col("d"), "America/Chicago")
    assert {r["d"]: r["h"] for r in d.select("d", ((b - a) / 3600).alias("h")).collect()} == {"2026-03-08": 23, "2026-11-01": 25, "2026-03-07": 24}


def test_numbers_and_missing(spark):
    d = spark.createDataFrame([(x,) for x in ("1.5", "1d", "nan", "NA", "abc", None, " 2 ", "1e3", "")], "x string")
    assert [r["v"] for r in d.select(S.number("x").alias("v")).collect()] == [1.5, None, None, None, None, None, 2.0, 1000.0, None]


def test_normalize_guards(spark):
    d = spark.createDataFrame([(0.0,), (-1.0,), (0.0,)], "x double")
    assert {r["y"] for r in normalize.normalize(d, "x", "y", percentile=99).collect()} == {0.0}
    values = [random.Random(1).uniform(-5, 50) for _ in range(200)]
    got = [r["y"] for r in normalize.normalize(spark.createDataFrame([(v,) for v in values], "x double"), "x", "y", 95, True, 0.75).collect()]
    x = np.log1p(np.maximum(values, 0))
    assert np.allclose(sorted(got), sorted(np.minimum(1, x / np.percentile(x[x > 0], 95)) ** 0.75))


def test_interpolation_edges(spark):
    rows = [("a", 0, 0.0), ("a", 5, 5.0), ("a", 11, 11.0), ("a", 191, 191.0), ("a", 372, 372.0), ("b", 7, 1.0)]
    d = spark.createDataFrame(rows, "icao24 string, time long, lat double").withColumns({"lon": F.col("lat"), "altitude_agl_ft": F.col("lat")})
    got = sorted((r["icao24"], r["time"], r["lat"]) for r in tracks.interpolate(d).collect())
    want = [("a", 0), ("a", 5), ("a", 10), *[("a", t) for t in range(11, 191, 5)], ("a", 191), ("a", 372), ("b", 7)]
    assert [(a, t) for a, t, _ in got] == want
    assert all(a == "b" or abs(t - v) < 1e-9 for a, t, v in got)
    assert tracks.interpolate(d, 0).count() == 6


def test_horizons_are_monotone(spark):
    d = spark.createDataFrame([(t, "x", 41.8, -87.9) for t in range(0, 90_000, 900)], "time long, icao24 string, lat double, lon double")
    n = [r["n"] for r in traffic.anchored(d).groupBy("hours").agg(F.count(F.lit(1)).alias("n")).orderBy("hours").collect()]
    assert n == [4, 12, 24, 36, 48, 96]


def test_spline_keeps_ends_and_short_lines(spark):
    pts = [("a", i, float(i), float(i % 3)) for i in range(5)] + [("b", i, float(i), 0.0) for i in range(3)]
    out = smoothing.catmull_rom(spark.createDataFrame(pts, "k string, pos long, x double, y double"), ["k"]).orderBy("k", "pos").collect()
    a, b = [r for r in out if r["k"] == "a"], [r for r in out if r["k"] == "b"]
    assert len(a) == 6 * 4 + 1 and (a[0]["x"], a[-1]["x"]) == (0.0, 4.0) and len(b) == 3


def test_rescore_bridges_gaps(spark):
    c = SMALL.cells(spark)
    e = edges(c).withColumn("weight", F.lit(1.0)).withColumn("d", F.lit("x"))
    x0, y0, *_ = SMALL.corners
    pts = spark.createDataFrame([("x", "r", 0, x0 + 250, y0 + 250), ("x", "r", 1, x0 + 2250, y0 + 250)], "d string, r string, pos long, x double, y double")
    row = smoothing.rescore(pts, ["d", "r"], SMALL, e, ["d"], spacing=5000.0).first()
    assert (row["final_combined_cost"], row["final_path_nodes"]) == (4.0, 5)


def test_simplify(spark):
    pts = spark.createDataFrame([("a", i, float(i), 0.001 * (i % 2)) for i in range(10)], "k string, pos long, x double, y double")
    assert smoothing.simplify(pts, ["k"], 0.1).count() == 2 and smoothing.simplify(pts, ["k"], 0.0).count() == 10


def test_density_and_classes(spark):
    d = spark.createDataFrame([("1", 0), ("2", 1_000_000)], "GEOID string, ALAND long")
    p = spark.createDataFrame([("1500000US1", "5"), ("1500000US2", "5"), ("Geography", "x")], "GEO_ID string, B01003_001E string")
    got = {r["GEOID"]: (r["density_p_km2"], r["density_risk"]) for r in risk.quantile_risk(risk.population_join(d, p)).collect()}
    assert got == {"1": (None, "low"), "2": (5.0, "high")}


def test_cells_in_polygons(spark):
    c = SMALL.cells(spark)
    x0, y0, x1, y1 = SMALL.corners
    half = (x0 + x1) / 2
    ring = lambda a, b: [(a, y0), (b, y0), (b, y1), (a, y1)]
    polys = spark.createDataFrame([("w", ring(x0, half)), ("e", ring(half, x1))], "polygon_id string, ring array<struct<x: double, y: double>>")
    got = {r["cell_id"]: r["polygon_id"] for r in routes.cells_in_polygons(c, polys).collect()}
    want = {r["cell_id"]: "w" if r["cx"] < half else "e" for r in c.collect()}
    assert got == want
    with pytest.raises(Exception, match="two polygons"):
        routes.cells_in_polygons(c, polys.union(polys)).collect()


def test_airspace_geometry_columns(spark):
    row = spark.range(1).select(geo.east_line_circle(41.80, *K.MDW, 18520.0)[1].alias("lon"), geo.bearing_deg(0, 0, 1, 0).alias("north"), geo.bearing_deg(0, 0, 0, -1).alias("west")).first()
    assert row["lon"] > K.MDW[1] and row["north"] == 0 and row["west"] == 270
    with pytest.raises(Exception, match="does not meet"):
        spark.range(1).select(geo.east_line_circle(50.0, *K.MDW, 18520.0)[1]).collect()


@pytest.mark.parametrize("encoding,bom", [("utf-8", b""), ("utf-8", b"\xef\xbb\xbf"), ("utf-16-le", b"\xff\xfe")])
def test_csv_encodings(spark, tmp_path, encoding, bom):
    f = tmp_path / "x.csv"
    f.write_bytes(bom + "time,lat,lon,baroaltitude,icao24\n1,41.5,-88,100,abc\n2,1d,-88,100,abc\n3,41.6,-88,,é\n".encode(encoding))
    raw = readers.state_vectors(spark, str(f))
    assert raw.count() == 3
    assert [tuple(r) for r in traffic.cleaned(raw).collect()] == [(1, 41.5, -88.0, 100.0, "abc")]
    assert traffic.cleaned(raw, ("lat", "lon")).count() == 2


def test_geojson_round_trip(spark, tmp_path):
    r = spark.createDataFrame([("a", 1.5, [(1.0, 2.0), (3.0, 4.0)])], "name string, total_cost double, geometry array<struct<x: double, y: double>>")
    text = writers.feature_collection(reports.features(r)).first()["collection"]
    assert json.loads(text)["features"][0]["geometry"]["coordinates"] == [[1.0, 2.0], [3.0, 4.0]]
    (tmp_path / "x.geojson").write_text(text)
    back = readers.geojson(spark, str(tmp_path / "x.geojson"), "name: string, total_cost: double", "array<array<double>>").first()
    assert (back["name"], back["total_cost"], back["coordinates"]) == ("a", 1.5, [[1.0, 2.0], [3.0, 4.0]])


def test_writers(spark, tmp_path):
    d = spark.createDataFrame([(1, "x")], "a int, b string")
    writers.write_csv(d, str(tmp_path / "o"), ["b", "a"], single=True)
    with pytest.raises(Exception, match="(?i)exists"):
        writers.write_csv(d, str(tmp_path / "o"))
    (tmp_path / "t.csv").write_text("")
    assert writers.free_path(spark, str(tmp_path / "t.csv")).endswith("t_1.csv")
    assert writers.page("t", {"a": "</script>"}).count("</script>") == 2 and "<\\/script>" in writers.page("t", {"a": "</script>"})


def test_shapefile(spark, tmp_path):
    ring = [(0.0, 0.0), (0.0, 1.0), (1.0, 1.0), (0.0, 0.0)]
    body = struct.pack("<i4d", 5, 0, 0, 1, 1) + struct.pack("<iii", 1, 4, 0) + b"".join(struct.pack("<2d", *p) for p in ring)
    (tmp_path / "g.shp").write_bytes(b"\0" * 100 + struct.pack(">ii", 1, len(body) // 2) + body)
    (tmp_path / "g.shx").write_bytes(b"\0" * 100 + struct.pack(">ii", 50, len(body) // 2))
    field = lambda n, k, size: n.encode().ljust(11, b"\0") + k.encode() + b"\0" * 4 + bytes([size]) + b"\0" * 15
    (tmp_path / "g.dbf").write_bytes(struct.pack("<B3sIHH20x", 3, b"\0\0\0", 1, 32 + 64 + 1, 16) + field("GEOID", "C", 5) + field("ALAND", "N", 10) + b"\r" + b" 17031" + b"      1234")
    readers.register(spark)
    row = spark.read.format("shapefile").schema("GEOID string, ALAND long, geometry array<array<struct<x: double, y: double>>>").load(str(tmp_path / "g.shp")).first()
    assert (row["GEOID"], row["ALAND"], [tuple(p) for p in row["geometry"][0]]) == ("17031", 1234, ring)
    for kind in ("shp", "shx", "dbf"):
        (tmp_path / f"h.{kind}").write_bytes((tmp_path / f"g.{kind}").read_bytes())
    both = readers.shapefiles(spark, f"file://{tmp_path}/*", "GEOID string, ALAND long, geometry array<array<struct<x: double, y: double>>>").collect()
    assert [(r["GEOID"], r["ALAND"], [tuple(p) for p in r["geometry"][0]]) for r in both] == [("17031", 1234, ring)] * 2


def test_newest_and_guards(spark, tmp_path):
    for n in ("a_2026-01-10.csv", "b_2026-03-07.csv"):
        (tmp_path / n).write_text("x")
    assert readers.newest(spark, str(tmp_path / "*.csv")).endswith("b_2026-03-07.csv")
    assert readers.first_that_exists(spark, str(tmp_path / "none"), str(tmp_path)) == str(tmp_path)
    with pytest.raises(ValueError, match="no rows"):
        readers.require_rows(spark.range(0), "x")
    with pytest.raises(ValueError, match="missing routes"):
        reports.complete(spark.createDataFrame([("a", "combined")], "dataset_slug string, route_name string"), ["a", "b"], ["combined"])


def test_breakdown_check_raises(spark):
    d = spark.createDataFrame([(1.0, 1.0, 1.0, 1.0, 5.0)], "distance_cost double, population_cost double, airspace_cost double, traffic_cost double, total_cost double")
    with pytest.raises(Exception, match="do not sum"):
        reports.checked(d).collect()


def test_streams(spark, tmp_path):
    from airgrid.streaming import traffic_stream

    src = tmp_path / "in"
    d = spark.createDataFrame([("a", 1000, 41.71, -87.99, 100.0), ("a", 1020, 41.712, -87.99, 300.0), ("b", 1005, 41.0, -87.99, 0.0)], "icao24 string, time long, lat double, lon double, alt double")
    d.coalesce(1).write.parquet(str(src))
    stream = spark.readStream.schema(d.schema).parquet(str(src))
    filled = traffic_stream.fill_gaps(stream, 5, 180, columns=("lat", "lon", "alt"))
    for name, df, mode in (("counts", traffic_stream.cell_counts(stream, SMALL), "complete"), ("filled", filled, "append")):
        q = df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(120)
        q.stop()
    assert spark.sql("SELECT sum(traffic) AS n FROM counts").first()["n"] == 2
    assert sorted((r["icao24"], r["time"], r["alt"]) for r in spark.sql("SELECT * FROM filled").collect()) == [("a", 1000, 100.0), ("a", 1005, 150.0), ("a", 1010, 200.0), ("a", 1015, 250.0), ("a", 1020, 300.0), ("b", 1005, 0.0)]
    late = traffic_stream.windowed_counts(d.withColumn("ts", F.timestamp_seconds("time")), SMALL)
    assert late.agg(F.sum("traffic")).first()[0] == 2


def test_stream_state_expires(spark, tmp_path):
    """Rows of one aircraft over micro-batches; its state goes once the watermark has passed the longest gap."""
    from airgrid.streaming import traffic_stream

    src = tmp_path / "in"
    batches = [[("a", 1000, 0.0, 0.0), ("c", 1000, 0.0, 0.0)], [("a", 1020, 2.0, 0.0)], [("b", 100_000, 0.0, 0.0)], [("b", 100_010, 0.0, 0.0)]]
    schema = "icao24 string, time long, lat double, lon double"
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(src))
        q = traffic_stream.fill_gaps(spark.readStream.schema(schema).parquet(str(src)), 5, 180, late="1 second").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        q.awaitTermination(120)
        held = sum(o.numRowsTotal for o in q.lastProgress.stateOperators) if q.lastProgress else None
        q.stop()
        assert k < 3 or held in (1, None)
    got = sorted((r["icao24"], r["time"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [("a", 1000), ("a", 1005), ("a", 1010), ("a", 1015), ("a", 1020), ("b", 100_000), ("b", 100_005), ("b", 100_010), ("c", 1000)]


def test_quantiles_equal_sorted_values(spark):
    """Of small brackets and open ones, of groups, ties, one value and none."""
    import numpy as np

    from airgrid.operators.quantiles import exact_quantiles

    rng = np.random.default_rng(0)
    rows = [(g, float(v)) for g, n in (("a", 3000), ("b", 1), ("c", 500)) for v in np.round(rng.exponential(10, n), 1 if g == "c" else 6)] + [(None, 4.0), (None, 6.0), ("d", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(7)
    for shares in ([0.5], [0.0, 0.7, 1.0], [0.95, 0.25]):
        got = {r["g0"]: [r[f"q{k}"] for k in range(len(shares))] for r in exact_quantiles(df, F.col("v"), shares, ["g"], accuracy=50).collect()}
        assert got.keys() == {"a", "b", "c", None}
        for g, q in got.items():
            assert q == pytest.approx(np.quantile([v for k, v in rows if k == g], shares).tolist())
    whole = exact_quantiles(df, F.col("v"), [0.9], accuracy=200).first()["q0"]
    assert whole == pytest.approx(np.quantile([v for _, v in rows if v is not None], 0.9))
    assert [r["q0"] for r in exact_quantiles(df.where("v < 0"), F.col("v"), [0.9]).collect()] == [None]


def test_inner_names_do_not_clash(spark):
    from airgrid.operators import traffic

    df = spark.createDataFrame([("a", 1.0, 5, 7), ("b", 3.0, 6, 8)], "k string, v double, scale int, Scale_Top int")
    assert normalize.normalize(df, "v", "out").columns == ["k", "v", "scale", "Scale_Top", "out"]
    assert {r["k"]: r["out"] for r in normalize.normalize(df, "v", "out", percentile=100).collect()} == pytest.approx({"a": 1 / 3, "b": 1.0})
    assert normalize.normalize(df.withColumn("k", F.lit(None).cast("string")), "v", "out", by=["k"]).count() == 2
    obs = spark.createDataFrame([(0, 1, "x"), (7200, 2, "y")], "time long, t0 int, T0_ string")
    cells = SMALL.cells(spark).withColumns({"hit": F.lit("mine"), "land": F.lit("mine"), "risk_cost": F.lit(0.0), "risk_class": F.lit("Low")})
    named = airspace.rings()
    flagged = airspace.memberships(cells, airspace.ring_segments(spark, named), named)
    assert {r["land"] for r in flagged.collect()} == {"mine"} and flagged.columns == [*cells.columns, *[f"in_{r}" for r in airspace.REGIONS]]
    blocked = risk.no_fly(cells, spark.createDataFrame([(0.0, 0.0, 1.0)], "sx double, sy double, radius_m double"))
    assert sorted(blocked.columns) == sorted(cells.columns) and {r["hit"] for r in blocked.collect()} == {"mine"}
    assert reports.legend(spark.createDataFrame([("a", 1), ("a", 2)], "label string, place int"), "place").collect() == [("a", 1)]
    assert sorted(traffic.anchored(obs, (1, 3)).columns) == ["T0_", "hours", "t0", "time"] and traffic.anchored(obs, (1, 3)).count() == 3


def test_searches_agree(spark):
    """With and without a bound, for every preset, against the plain search; both its bounds and the empty cases."""
    import numpy as np

    g = SMALL
    c = g.cells(spark)
    nodes = c.select("cell_id", *[(F.pmod(F.col("cell_id") * k, F.lit(m)) / m).alias(t) for t, k, m in (("population", 13, 101), ("airspace", 7, 97), ("traffic", 3, 89))])
    terms = graph.edge_terms(edges(c), nodes).withColumn("k", F.lit("x"))
    ny = g.shape[1]
    ends = spark.createDataFrame([(0, 3 * ny + 1, "p"), (0, 4 * ny + 2, "q"), (0, 10_000, "nowhere")], "start long, goal long, destination string")
    presets = graph.presets(spark)
    key = lambda df: {(r["route_name"], r["destination"]): (round(r["total_cost"], 9), r["path"][0], r["path"][-1]) for r in df.collect()}
    with_bound, without = key(graph.preset_paths(terms, presets, ends, ["k"], g.centres)), key(graph.preset_paths(terms, presets, ends, ["k"]))
    plain = key(graph.shortest_paths(graph.weigh(terms, presets), ends, ["k", "route_name"]))
    assert with_bound == without == plain and len(plain) == 2 * presets.count()
    x, y = g.centres(np.arange(g.shape[0] * ny))
    want = {r["cell_id"]: (r["cx"], r["cy"]) for r in c.collect()}
    assert all((a, b) == pytest.approx(want[k]) for k, (a, b) in enumerate(zip(x, y, strict=True)))
    bound = graph.heuristic(x, y, [5], 0.6, 707.1)
    assert bound[5] == 0 and bound.max() <= 0.6 * max(math.hypot(a - x[5], b - y[5]) for a, b in zip(x, y, strict=True)) / 707.1
    assert graph.heuristic(x, y, [5], 0.0, 707.1) is None


def test_relax_equals_search_on_a_grid(spark):
    """The relational search over a grid of some hundred cells, against the grouped one."""
    g = Grid(cell=6000.0)
    e = edges(g.cells(spark)).withColumn("weight", F.col("distance_m") * (1 + F.pmod(F.col("src") * 7 + F.col("dst") * 3, F.lit(11)) / 11.0))
    roads = graph._adjacency(*zip(*[(r["src"], r["dst"], r["weight"]) for r in e.collect()], strict=True))
    want = {k: v[0] for k, v in graph.dijkstra(roads, 0, set(roads)).items()}
    assert {r["node"]: r["cost"] for r in graph.relax(e, 0).collect()} == pytest.approx(want)


def test_values_of_another_grid(spark):
    from airgrid.operators.grid import from_other

    fine, coarse = Grid(cell=2000.0), Grid(cell=5000.0)
    values = coarse.cells(spark).select("cell_id", F.col("cell_id").cast("double").alias("density_p_km2"))
    out = from_other(fine.cells(spark), coarse, values.where("cell_id % 2 = 0"), ["density_p_km2"])
    assert out.count() == fine.shape[0] * fine.shape[1]
    x0, y0, *_ = fine.corners
    for r in out.collect():
        held = int((r["cx"] - x0) // 5000) * coarse.shape[1] + int((r["cy"] - y0) // 5000)
        assert r["density_p_km2"] == (held if held % 2 == 0 else None)


def test_pages(spark):
    import json
    import re

    rows = spark.createDataFrame([("2026-03-07", "combined", "ohare", 1.5, [(1.0, 2.0), (3.0, 4.0)])], "dataset_slug string, route_name string, destination string, total_cost double, geometry array<struct<x: double, y: double>>")
    heat = spark.createDataFrame([(1, 41.0, -87.0, 3, 0.5), (3, 41.0, -87.0, 6, 1.0)], "hours int, lat double, lon double, count long, intensity double")
    text = writers.map_page("A </script> page", [*writers.route_layers(rows), *writers.heat_layers(heat)])
    data = json.loads(re.search(r"id='data'>(.*?)</script>", text, re.S)[1])
    assert data["steps"] == ["1 h", "3 h"] and [layer["step"] for layer in data["layers"]] == [None, "1 h", "3 h"]
    assert data["layers"][0]["groups"] == {"date": "2026-03-07", "route": "combined", "destination": "ohare"} and data["layers"][0]["shapes"][0]["at"] == [[1.0, 2.0], [3.0, 4.0]]
    assert "http" not in text.replace("http-equiv", "") and "A </script>" not in text
    with pytest.raises(ValueError, match="more than"):
        writers.route_layers(rows, limit=0)


def test_charts():
    import xml.etree.ElementTree as ET

    colors = {"distance": "#111111", "traffic": "#222222"}
    pie = ET.fromstring(writers.pies("a & b", {"x": {"distance": 3.0, "traffic": 1.0}, "y": {"distance": 2.0, "traffic": 0.0}, "z": {}}, colors))
    tags = [e.tag.rsplit("}")[-1] for e in pie]
    assert tags.count("path") == 2 and tags.count("circle") == 1 and tags.count("text") == 3
    assert [e[0].text for e in pie if e.tag.endswith("path")] == ["distance 75.0%", "traffic 25.0%"]
    bar = ET.fromstring(writers.bars("t", {"d1": {"distance": 2.0, "traffic": 1.0}, "d2": {"distance": 4.0}}, colors, height=260))
    assert [float(e.get("height")) for e in bar if e.tag.endswith("rect")] == [100.0, 50.0, 200.0]
    image = ET.fromstring(writers.cells_image("t", [(0, 0, 0.5), (2, 1, 2.0)], side=2))
    assert [(e.get("x"), e.get("y"), e.get("fill-opacity")) for e in image if e.tag.endswith("rect")] == [("0", "22", "0.500"), ("4", "20", "1.000")]
    assert ET.fromstring(writers.bars("t", {}, {})).tag.endswith("svg")


def test_jobs(spark, tmp_path, monkeypatch):
    """Each job from its command line on a small export."""
    from airgrid import jobs

    rows = [(t * 60, 41.6 + 0.001 * t, -87.9 + 0.002 * t, 1000.0 + t, f"a{k}") for t in range(30) for k in range(3)]
    obs = spark.createDataFrame(rows, "time long, lat double, lon double, baroaltitude double, icao24 string")
    obs.coalesce(1).write.option("header", True).csv(str(tmp_path / "in"))
    dates = ["2026-03-07", "2026-03-09"]
    for date in dates:
        obs.coalesce(1).write.option("header", True).csv(str(tmp_path / f"opensky_{date}"))
    for name, more in (("routes", [str(tmp_path / f"opensky_{date}") for date in dates] + ["--cell", "5000"]), ("density", [str(tmp_path / "in")]), ("heatmap", [str(tmp_path / "in"), "--cell", "5000"])):
        jobs.main([name, "--out", str(tmp_path / name), "--traffic", *more])
    with pytest.raises(ValueError, match="no date"):
        jobs.main(["routes", "--out", "x", "--traffic", str(tmp_path / "in")])
    assert "combined" in (tmp_path / "routes" / "routes.html").read_text() and "hours" not in (tmp_path / "heatmap" / "heat.html").read_text()[:50]
    assert spark.read.parquet(str(tmp_path / "routes/routes")).count() == len(dates) * len(K.PRESETS) * len(K.DESTINATIONS)
    assert spark.read.option("header", True).csv(str(tmp_path / "routes/costs")).count() == len(dates) * len(K.DESTINATIONS)
    assert spark.read.option("header", True).csv(str(tmp_path / "density/costs")).count() > 0
    vectors = obs.withColumn("time", F.col("time") + 1_704_175_200).withColumn("hour", F.expr("time - time % 3600"))
    vectors.write.parquet(str(tmp_path / "vectors"))
    jobs.main(["export", "--vectors", str(tmp_path / "vectors"), "--day", "2024-01-02", "--out", str(tmp_path / "day")])
    assert spark.read.option("header", True).csv(str(tmp_path / "day/opensky_2024-01-02")).count() == 90


def test_entry(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).limit(1).count() == 1


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="driver tables are absent")
def test_smoothed_routes_cover_every_date(spark):
    got = registry.QUERIES["turn_penalty_routes"](spark, "/root/testdata/sf0.001").collect()
    assert {(r["dataset_slug"], r["technique"], r["destination"]) for r in got} == {(s, t, d[0]) for s in K.DATASETS for t in ("turn_penalty", "spline", "turn_penalty_spline") for d in K.DESTINATIONS}
    combined = graph.presets(spark).where("route_name = 'combined'")
    edges_ = routes.weighted_edges(spark, registry.observed(spark, "/root/testdata/sf0.001"), Grid(), combined, K.DATASETS)
    want = {(r["dataset_slug"], r["destination"]): r["total_cost"] for r in graph.shortest_paths(edges_, routes.ends(spark, Grid()), ["dataset_slug"]).collect()}
    assert {(r["dataset_slug"], r["destination"]): r["total_cost"] for r in got if r["technique"] == "spline"} == pytest.approx(want)
