import datetime as dt
import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hubloom.operators import lookup as K
from hubloom.operators import validate as V
from hubloom.sources import readers as R
from hubloom.sources import sinks as W
from hubloom.streaming import demand as D


def test_resolve():
    assert R.resolve(["A", "node_id"], ("Node", "NODE_ID")) == "node_id" and R.resolve(["A"], ("x",)) is None and R.resolve(["pop_2050_x"], ("POP",), partly=True) == "pop_2050_x"


def test_nodes_in_hebrew_encoding(spark, tmp_path):
    p = tmp_path / "nodes.csv"
    p.write_bytes("node,LINE_ID,X,Y\n1001,קו 1,180000,660000\n12.0,b,x,\n".encode("windows-1255"))
    got = R.transit_nodes(spark, str(p)).collect()
    assert [(r.node, r.line_id, r.x, r.y) for r in got] == [(1001, "קו 1", 180000.0, 660000.0), (12, "b", None, None)]
    assert R.sniff_encoding(spark, str(p), ["LINE_ID"]) in ("windows-1255", "utf-8")
    bad = tmp_path / "bad.csv"
    bad.write_text("node,X\n1,2\n")
    with pytest.raises(V.ValidationError):
        R.transit_nodes(spark, str(bad))


def test_lines_and_sheets(spark, tmp_path):
    p = tmp_path / "l.csv"
    p.write_text("Line_ModelName,Mode_Planned\na,Bus\n", encoding="utf-8")
    assert [tuple(r) for r in R.lines_modes(spark, str(p), "utf-8").collect()] == [("a", "Bus", None)]
    (tmp_path / "s.csv").write_text("Node,Boardings\n1,2\n")
    (tmp_path / "t.csv").write_text("ID,On\n3,4\n")
    got = R.demand_sheets(spark, {"National": str(tmp_path / "s.csv"), "x": str(tmp_path / "t.csv"), "gone": str(tmp_path / "none.csv")})
    assert {r.model: (r.Node, r.ID) for r in got.collect()} == {"Rail": ("1", None), "x": (None, "3")}
    with pytest.raises(V.ValidationError):
        R.demand_sheets(spark, {})


def test_geojson_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, "POINT (1.5 2)"), (2, "POLYGON ((0 0, 1 0, 1 1, 0 0), (0.1 0.1, 0.2 0.1, 0.2 0.2, 0.1 0.1))"), (3, "MULTIPOLYGON (((0 0, 1 0, 1 1, 0 0)), ((5 5, 6 5, 6 6, 5 5)))"), (4, None)], "id int, geometry string")
    lines = [json.loads(r.value) for r in W.features(df).collect()]
    assert lines[0]["geometry"] == {"type": "Point", "coordinates": [1.5, 2]} and lines[3]["geometry"] is None
    assert len(lines[1]["geometry"]["coordinates"]) == 2 and len(lines[2]["geometry"]["coordinates"]) == 2 and lines[0]["properties"] == {"id": 1}
    p = tmp_path / "x.geojson"
    p.write_text(json.dumps({"type": "FeatureCollection", "features": lines[:3]}))
    back = R.table_by_suffix(spark, str(p)).collect()
    assert back[0].geometry == "POINT (1.5 2)" and back[1].geometry.startswith("POLYGON ((0 0, 1 0") and back[2].geometry.startswith("MULTIPOLYGON (((0 0, 1 0") and back[0].properties["id"] == "1"


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, ["a", "b"], 'x "y"', 1.23456789)], "id int, l array<string>, s string, d double")
    W.write_csv(df, str(tmp_path / "c"))
    assert R.csv(spark, str(tmp_path / "c")).first().asDict() == {"id": "1", "l": "a,b", "s": 'x "y"', "d": "1.23456789"}
    assert W.write_by_suffix(df.withColumn("geometry", F.lit("POINT (1 2)")), str(tmp_path / "g")).endswith(".geojson")
    for suffix in ("parquet", "json", "csv"):
        at = W.write_by_suffix(df, str(tmp_path / f"t.{suffix}"))
        assert R.table_by_suffix(spark, at).count() == 1
    with pytest.raises(ValueError):
        R.table_by_suffix(spark, "a.xyz")
    r = W.with_run_metadata(df, 3, seed=42).first()
    assert r.d == 1.235 and r.seed == 42 and r.written_at
    assert W.ordered_columns(df, ["s", "gone"], "id").columns == ["s", "id", "l", "d"]


def test_zones_experts_and_paths(spark, tmp_path):
    z = R.taz_zones(spark.createDataFrame([("5", None)], "Pop_2050_total string, x string")).first()
    assert z.pop_2050 == 5.0 and z.empl_2050 == 0.0
    m = R.expert_comparisons(spark.createDataFrame([("a", "1", "2"), ("b", "0.5", "1")], "c string, a string, b string"), "e")
    assert [tuple(r) for r in m.collect()] == [("e", "a", "b", 2.0)]
    long = spark.createDataFrame([("e", "a", "b", "3")], "expert string, criterion_a string, criterion_b string, value string")
    assert R.expert_comparisons(long).first().value == 3.0
    assert R.first_existing(spark, [str(tmp_path / "no"), str(tmp_path)]) == str(tmp_path) and R.optional(R.csv, spark, str(tmp_path / "no")) is None


def test_stream(spark, tmp_path):
    schema = T.StructType([T.StructField(n, t) for n, t in (("model", T.StringType()), ("node", T.LongType()), ("demand", T.DoubleType()), ("transfers", T.DoubleType()), ("at", T.TimestampType()))])
    t0 = dt.datetime(2025, 1, 1)
    src, out, state = (str(tmp_path / n) for n in ("src", "out", "state"))
    def put(rows):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(src)

    def run():
        D.upsert_totals(D.demand_totals(D.read_files(spark, src, schema)), out, state).awaitTermination()
        return {(r.model, r.node): (r.demand, r.transfers) for r in D.latest(spark, out).collect()}

    put([("m", 1, 2.0, None, t0), ("m", None, 9.0, 1.0, t0), ("n", 1, 1.0, 1.0, t0)])
    assert run() == {("m", 1): (2.0, 0.0), ("n", 1): (1.0, 1.0)}
    put([("m", 1, 3.0, 4.0, t0)])
    assert run() == {("m", 1): (5.0, 4.0), ("n", 1): (1.0, 1.0)}
    w = D.windowed_demand(D.read_files(spark, src, schema), "at")
    q = w.writeStream.format("memory").queryName("windows").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {r.model: r.n for r in spark.table("windows").collect()} == {"m": 3, "n": 1}


def test_validation(spark):
    df = spark.createDataFrame([(1, 5.0, "POLYGON ((0 0, 1 0, 1 1))"), (1, None, None), (2, 11.0, "POINT (1 1)")], "k int, s double, g string")
    V.require_columns(df, ["k"])
    with pytest.raises(V.ValidationError):
        V.require_columns(df, ["k", "zz"])
    assert V.in_range(df, ["s"], 1, 10, strict=False) == ["s"]
    with pytest.raises(V.ValidationError):
        V.in_range(df, ["s"], 1, 10)
    r = V.ranges(df, ["s"]).first()
    assert (r.missing, r.least, r.most, r.incomplete) == (1, 5.0, 11.0, True)
    assert [tuple(x) for x in V.duplicates(df, "k").collect()] == [(1, 2)]
    assert V.geometry_counts(df, "g").first().asDict() == {"n_rows": 3, "missing": 1, "open_rings": 1}
    assert V.count_between(df, 1, 3) and not V.count_between(df, 4, 9) and V.any_null(df, ["s", "g"]).count() == 1
    assert V.validate(df, ["g"], "k", ["s"], 1, 12) == {"duplicate_keys": 1, "incomplete": ["s"]}


def test_lookups(spark):
    nodes = spark.createDataFrame([("h", 1, "A"), ("h", 2, "A"), ("g", 3, "B")], "hub string, node long, area string")
    demand = K.demand_by_node(spark.createDataFrame([("a", 1, 5.0, 1.0), ("a", 1, None, None), ("b", 1, 7.0, 0.0), ("o", 2, 9.0, 2.0), ("a", 2, 1.0, 0.0), (None, 1, 3.0, 3.0), ("a", None, 3.0, 3.0)], "model string, node long, demand double, transfers double"))
    got = K.prioritised_lookup(nodes, demand, "hub", "node", F.lit("b,a,o"), ["o"])
    assert {r.hub: (r.demand, r.transfers) for r in got.collect()} == {"h": (16.0, 2.0)}
    more = K.additive_lookup(nodes, demand, "hub", "node", F.lit("b"), ["o"])
    assert {r.hub: r.demand for r in more.collect()} == {"h": 7.0 + 1.0 + 9.0, "g": 0.0}
    over = spark.createDataFrame([(1, 1, 10.0), (2, 2, 20.0), (1, 3, 30.0)], "node long, n int, v double")
    assert {r.hub: r.v for r in K.override_last_wins(nodes, over, "hub", "node", "n", "v").collect()} == {"h": 30.0, "g": None}


def test_written_tables(spark):
    from hubloom import session as H

    df, path = H.written(spark.range(5))
    assert df.count() == 5 and H.exists(spark, path)
    H.drop_written(spark, path)
    assert not H.exists(spark, path)
    at = H.written_by(spark.range(4).withColumn("k", F.col("id") % 2), "k")
    assert H.exists(spark, f"{at}/k=0")
    H.drop_all_written()
    assert not H.exists(spark, at)


def test_shared_folder():
    from types import SimpleNamespace as N

    from hubloom import session as H

    def fake(master, folder=None):
        conf = N(get=lambda *_: folder)
        return N(sparkContext=N(getConf=lambda: conf, master=master, applicationId="app"), conf=conf)

    assert H.shared_dir(fake("spark://x:7077", "hdfs://y/z/")) == "hdfs://y/z"
    with pytest.raises(RuntimeError):
        H.shared_dir(fake("spark://x:7077"))
    assert H.shared_dir(fake("local[2]")).startswith("file:///")


def test_sql_functions(spark):
    from hubloom.functions import hexgrid as X
    from hubloom.functions import udf

    udf.register(spark)
    df = spark.createDataFrame([(1234.5, -777.25), (0.0, 0.0), (98765.4, 43210.9)], "x double, y double")
    q, r = X.axial(F.col("x"), F.col("y"))
    assert df.where(F.expr("hex_cell(x, y)") != X.cell_id(q, r)).count() == 0
    assert spark.sql("SELECT * FROM hex_ring(0L, 0L, 2)").count() == 19 and spark.sql("SELECT saaty(-3D)").first()[0] == 0.25
    assert spark.sql("SELECT tier_of_demand(double('NaN')), hebrew_ratio('אב c')").first()[1] == pytest.approx(2 / 3)


def test_runs_and_reports(spark):
    from hubloom.operators import workflow as O
    from hubloom.plans.simulation import example

    df = spark.createDataFrame([(i, float(i), float(9 - i), 1.0 + i) for i in range(9)], "id int, a double, b double, c double")
    t = O.report_tables(df, "id", "a", "b", 3)
    assert [r.id for r in t["top_a"].collect()] == [8, 7, 6] and t["averages"].first().a == 4.0 and t["top_combined"].count() == 3
    scored, told = O.ahp_run(df, example(spark), {"activity": "a", "service": "b", "unknown": "c"})
    assert sum(told["weights"].values()) == pytest.approx(1) and told["weights"]["unknown"] == 0 and told["inconsistent"] == []
    assert scored.where("ahp_rank = 1").first().id == 8
    with pytest.raises(ValueError):
        O.ahp_run(df, example(spark), {"none": "a"})
    rows = {r.criterion: r.weight for r in O.expert_export(example(spark), "urban_economist").collect()}
    assert rows["_expert"] == "urban_economist" and float(rows["_consistency_ratio"]) == pytest.approx(0.003845, abs=1e-5)
    over = O.with_builtin_overrides(spark.createDataFrame([(400424, 1, 5.0, 6.0)], "node long, row_no long, demand double, transfers double"))
    assert over.groupBy("node").agg(F.max_by("demand", "row_no").alias("d")).where("node = 400424").first().d == 64985.0
    assert O.with_demand_columns(df).columns[-2:] == ["TotalDemand", "TotalTransfers"]
    notes = spark.createDataFrame([(1, "5, 6"), (2, "7"), (3, None)], "id int, t string")
    assert {tuple(r) for r in O.group_notes(notes, "t", "id").collect()} == {(1, 5), (1, 6)}
