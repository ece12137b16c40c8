import json
import math
from dataclasses import replace
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from citeloom.functions import layout
from citeloom.operators import graph
from citeloom.plans import pipeline
from citeloom.sources import citations, drawings, export
from citeloom.streaming import edges as stream


def corpus(spark):
    rows = [(f"l{i}", f"m{j}") for i in range(6) for j in range(6) if (i + j) % 2 == 0 or i == j] + [(f"m{j}", f"r{k}") for j in range(6) for k in range(3) if (j + k) % 2 == 0 or k == 0] + [("m0", "m1"), ("m1", "m2")]
    cites = spark.createDataFrame(rows, "SR string, SR_ref string")
    names = sorted({n for r in rows for n in r})
    words = ["growth market", "network trust", "market network model"]
    arts = [(n, f"{words[i % 3]} {n}", words[(i + 1) % 3], "J", "S", 2000 + i, float(i)) for i, n in enumerate(names)]
    arts.append(("new", "market growth", "network", "J", "S", 2020, 50.0))
    return cites, spark.createDataFrame(arts, "id string, title string, abstract string, journal string, source_title string, year int, cited_by double")


@pytest.fixture(scope="module")
def planned(spark, tmp_path_factory):
    """The whole plan, run once: its tables and the folder of its exports."""
    cites, arts = corpus(spark)
    settings = pipeline.Settings(2020, max_roots=3, max_leaves=4, max_trunk=4, max_branch_size=5, recent_years=19, topic_terms=("market",), compare_algorithms=True)
    settings = replace(settings, leaf_experiments=True, target_leaves=5, w_topics=0.2, canopy_path="M 0 0 H 600 V 400 H 0 Z")
    out = tmp_path_factory.mktemp("plan") / "out"
    topics = spark.createDataFrame([("r1", "r0", 0.9), ("r0", "r1", 0.5)], "a string, b string, similarity double")
    return pipeline.run(spark, cites, arts, settings, out, topic_pairs=topics), out


def test_all_stages_and_exports(spark, planned):
    t, out = planned
    kinds = {r.role for r in t["labels"].select("role").distinct().collect()}
    assert {"root", "trunk", "leaf"} <= kinds
    assert "new" in {r.id for r in t["fruits"].collect()}
    assert (out / "index.html").read_text().startswith("<!DOCTYPE html>")
    nodes, edges = citations.gexf(spark, str(out / "network.gexf"))
    assert nodes.count() == t["labels"].count() and edges.count() == t["edges"].count()
    degrees = {r.id: (r.in_degree, r.out_degree) for r in graph.degrees(t["edges"]).collect()}
    assert {r.id: (r.in_degree, r.out_degree) for r in nodes.collect()} == degrees
    assert {r.attributes["role"] for r in nodes.collect()} == kinds


def test_exports_of_the_whole_plan(planned):
    t, out = planned
    assert {"roots.svg", "trunk.svg", "leaves_labelled.svg", "branches.svg", "gephi_nodes.csv", "gephi_edges.csv", "leaf_like.md", "roots_nodes_only.gexf", "branch_emergence.csv", "branch_comparison.csv", "figures"} <= {p.name for p in out.iterdir()}
    assert "<viz:color" in (out / "roots_nodes_only.gexf").read_text() and "<edge " not in (out / "roots_nodes_only.gexf").read_text()
    members = {r.id: r for r in t["branch_members"].collect()}
    assert set(members) == {r.id for r in t["branches"].collect()} and all(r.branch_member_role in ("core", "peripheral", "background_methodological", "missing_metadata") for r in members.values())
    assert all(r.pid == f"branch_{r.branch}_{r.position:02d}" for r in members.values())
    assert sorted(r.display_position for r in members.values()) == list(range(1, len(members) + 1))
    compared = t["branch_comparison"].collect()
    assert {r.algorithm for r in compared} == {f"{a}_{s}" for a in ("louvain", "leiden") for s in ("current", "cohesive")} and all(r.selected_node_count <= 5 for r in compared)
    data = json.loads((out / "index.html").read_text().split("const rows=")[1].split(",fields=")[0].replace("<\\/", "</"))
    assert {"root", "trunk", "leaf", "fruit"} <= {r["role"] for r in data} and all(r["title"] for r in data)
    assert not {r["id"] for r in data if r["role"] == "leaf"} & {r["id"] for r in data if r["role"] == "fruit"}
    ids = [r.pid for r in t["root_papers"].orderBy("position").collect()]
    assert ids == [f"root_{i + 1:02d}" for i in range(len(ids))]


def test_leaf_experiments_topic_weights_and_canopy(spark, planned, tmp_path):
    t, out = planned
    runs = {}
    for r in t["leaf_runs"].collect():
        runs.setdefault(r.run, {})[r.id] = r
    assert set(runs) == {"top_4", "top_5", "added_5_5"} and len(runs["top_4"]) == 4 and len(runs["top_5"]) == 5
    assert set(runs["added_5_5"]) == set(runs["top_5"]) - set(runs["top_4"]) and all(r.in_baseline == (i in runs["top_4"]) for i, r in runs["top_5"].items())
    counts = {r.run: r for r in t["leaf_run_summary"].collect()}
    assert counts["top_5"].leaf_count == 5 and counts["top_5"].metadata_share == 1.0 and counts["added_5_5"].min_year == counts["added_5_5"].max_year
    leaves = sorted(t["frontier_leaves"].collect(), key=lambda r: r.leaf_rank)
    assert [r.leaf_rank for r in leaves] == list(range(1, 6)) and [r.leaf for r in leaves] == sorted((r.leaf for r in leaves), reverse=True)
    [facts] = t["frontier_summary"].collect()
    assert (facts.sap_leaf_count, facts.selected_frontier_leaf_count, facts.combined_leaf_count, facts.min_year) == (5, 0, 5, None)
    assert (out / "frontier_leaves.md").read_text().count("sap_leaf; out-degree") == 5 and (out / "leaf_runs.csv").exists()
    assert (out / "leaf_like_canopy.svg").read_text().count("<title>") == t["leaf_like"].count()
    pairs = {(r.a, r.b): r for r in t["root_pairs"].collect()}
    assert pairs["r0", "r1"].topics == 0.9 and pairs["r0", "r2"].topics == 0.0
    r = pairs["r0", "r1"]
    assert r.combined == pytest.approx((0.45 * r.text + 0.35 * r.cocitation + 0.2 * r.structural + 0.2 * 0.9) / 1.2, abs=1e-6)
    path = tmp_path / "pairs.csv"
    assert citations.optional_csv(spark, str(path), a="x").collect() == []
    path.write_text("source_root_id,target_root_id,ntf_topic_similarity\nB,A,0.5\nA,A,1\n,A,1\n")
    read = citations.optional_csv(spark, str(path), a="source_root_id", b="target_root_id", similarity="ntf_topic_similarity")
    assert [tuple(r) for r in citations.pairs_of(read).collect()] == [("A", "B", 0.5)]
    with pytest.raises(ValueError, match="lacks"):
        citations.optional_csv(spark, str(path), a="nothing")


def test_frontier_leaves_fill_up_in_order(spark):
    from citeloom.operators import experiments

    edges = spark.createDataFrame([("a", "m"), ("m", "r"), ("f1", "m"), ("f2", "m"), ("f2", "r"), ("f3", "r"), ("old", "r"), ("none", "r"), ("fruit", "r")], "src string, dst string")
    arts = spark.createDataFrame([("a", 2020, 1.0), ("f1", 2020, 9.0), ("f2", 2020, None), ("f3", 2021, 0.0), ("old", 2000, 99.0), ("fruit", 2021, 5.0), ("m", 2010, 1.0)], "id string, year int, cited_by double")
    arts = arts.withColumns({"title": F.lit(None).cast("string"), "abstract": F.lit("x")})
    zero = spark.createDataFrame([(x, 1 if x == "a" else 0, 7) for x in ("a", "m", "r", "f1", "f2", "f3", "old", "none", "fruit")], "id string, leaf int, sap int")
    taken = spark.createDataFrame([("r",), ("m",), ("fruit",)], "id string")
    found, candidates = experiments.frontier_leaves(zero, edges, arts, taken, target=3)
    assert [(r.id, r.leaf_type, r.frontier_rank) for r in found.orderBy("leaf_rank").collect()] == [("a", "sap_leaf", None), ("f3", "frontier_leaf", 1), ("f2", "frontier_leaf", 2)]
    [facts] = experiments.frontier_summary(found, candidates, 3).collect()
    assert (facts.frontier_candidate_count, facts.min_year, facts.max_year, facts.min_out_degree, facts.max_out_degree) == (3, 2020, 2021, 1, 2)
    assert experiments.frontier_leaves(zero, edges, arts, taken, target=0)[0].count() == 1


def test_run_on_files(spark, tmp_path):
    cites, arts = corpus(spark)
    (tmp_path / "c.csv").write_text("SR,SR_ref\n" + "\n".join(f"{r.SR},{r.SR_ref}" for r in cites.collect()))
    lines = [f"{r.id},{r.title},{r.abstract},J,S,{r.year},,{r.cited_by}" for r in arts.collect()]
    lines += ["l0 old,,,,,,10.1/x,", "gone,t,a,J,S,2020,10.9/z,999"]
    (tmp_path / "a.csv").write_text("SR,title,Abstract,journal,source_title,YEAR,doi,Cited_By\n" + "\n".join(lines))
    settings = pipeline.Settings(2020, max_roots=3, max_leaves=4, max_trunk=4, max_branch_size=5, recent_years=19, article_replacements={"l0 old": "l0"}, dropped_dois=("10.9/z",), article_overrides={"r0": {"title": "By hand"}, "r9": {"title": "Added"}})
    t = pipeline.run_files(spark, str(tmp_path / "c.csv"), str(tmp_path / "a.csv"), settings, end=7, template=str(tmp_path / "none.xlsx"))
    titles = {r.id: r.title for r in t["articles"].collect()}
    assert titles["r0"] == "By hand" and titles["r9"] == "Added" and "gone" not in titles and "l0 old" not in titles
    fruits = {r.id: r for r in t["fruits"].collect()}
    assert fruits["new"].cited_by == 50.0 and fruits["new"].fruit_signal_type == "external_signal_not_matched_in_graph"
    assert any(r.fruit_signal_type != "recent_no_external_signal" for r in fruits.values())


def test_spreadsheets(spark, tmp_path, monkeypatch):
    import pandas as pd

    (tmp_path / "a.csv").write_text("SR,x\nA,1\n")
    assert citations.article_source(spark, str(tmp_path / "a.csv"), str(tmp_path / "no.xlsx")).collect()[0].x == "1"
    (tmp_path / "t.xlsx").write_bytes(b"")
    monkeypatch.setattr(pd, "read_excel", lambda path, sheet_name, dtype: pd.DataFrame({"SR": ["B"], "x": [sheet_name]}))
    assert tuple(citations.article_source(spark, str(tmp_path / "a.csv"), str(tmp_path / "t.xlsx"), sheet="s").collect()[0]) == ("B", "s")

    def missing(*a, **k):
        raise ImportError("openpyxl")

    monkeypatch.setattr(pd, "read_excel", missing)
    with pytest.raises(RuntimeError, match="CSV"):
        citations.article_source(spark, str(tmp_path / "a.csv"), str(tmp_path / "t.xlsx"))


def test_stored_tables_go(spark, tmp_path):
    from pathlib import Path

    from citeloom import storage

    df = storage.stored(spark.range(3), "three")
    path = Path(df._stored_at.removeprefix("file://").removeprefix("file:"))
    assert path.exists() and df.count() == 3 and path.is_relative_to(storage.own_dir(spark).removeprefix("file://").removeprefix("file:"))
    storage.forget(df)
    assert not path.exists()


def test_a_cluster_needs_a_shared_folder():
    from types import SimpleNamespace as N

    from citeloom import storage

    context = lambda master: N(master=master, getConf=lambda: N(get=lambda k: None), _jsc=N(sc=lambda: N(getCheckpointDir=lambda: N(isDefined=lambda: False))))
    for master in ("yarn", "spark://h:7077", "local-cluster[2,1,1024]"):
        with pytest.raises(RuntimeError, match="all machines share"):
            storage.shared_dir(N(conf=N(get=lambda k, d: None), sparkContext=context(master)))


def test_changed_tables_are_read_anew(spark, tmp_path):
    from citeloom.sources.driver_tables import kept

    made = []
    spark.range(1).write.parquet(f"{tmp_path}/t.parquet")
    for _ in range(2):
        kept(spark, str(tmp_path), "x", lambda: made.append(1))
    assert len(made) == 1
    spark.range(2).write.mode("overwrite").parquet(f"{tmp_path}/t.parquet")
    kept(spark, str(tmp_path), "x", lambda: made.append(1))
    assert len(made) == 2


def test_dry_run_and_selection(spark, capsys):
    assert pipeline.run(spark, None, None, pipeline.Settings(2020), dry_run=True, end=2) == {"citations": None, "articles": None}
    assert "2. build the citation graph" in capsys.readouterr().out
    with pytest.raises(SystemExit):
        pipeline.selected(4, 2)


def test_settings_file(tmp_path):
    p = tmp_path / "s.json"
    p.write_text(json.dumps({"max-roots": 7, "w-text": None}))
    assert pipeline.load_settings(p, 2020).max_roots == 7
    assert pipeline.load_settings(None, 2020) == pipeline.Settings(2020)
    p.write_text(json.dumps({"nonsense": 1}))
    with pytest.raises(ValueError):
        pipeline.load_settings(p, 2020)


def test_csv_sources(spark, tmp_path):
    (tmp_path / "c.csv").write_text('SR,SR_ref\n" A ",B\nA,B\n,B\n')
    assert [tuple(r) for r in citations.citations(spark, str(tmp_path / "c.csv")).collect()] == [("A", "B")]
    (tmp_path / "a.csv").write_text('SR,title,year,extra\nA,"one ""x""\nline",2001.0,z\nA,two,2002,z\nB,,n/a,z\n')
    got = {r.SR: (r.title, r.year, r.orcid) for r in citations.articles(spark, str(tmp_path / "a.csv")).collect()}
    assert got == {"A": ('one "x"\nline', 2001, None), "B": (None, None, None)}
    assert citations.optional(spark, str(tmp_path / "none"), "a int").count() == 0


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("a", None, 1.23456789), ("b", " T&<> ", None)], "id string, title string, v double")
    assert [r.Label for r in export.gephi_nodes(rows).orderBy("Id").collect()] == ["a", " T&<> "]
    assert export.write_csv(rows, tmp_path / "r.csv") == 2
    export.write_markdown(tmp_path / "r.md", "Nodes", rows.select("id", F.lit(2000).alias("year"), "title", F.lit("n").alias("note")), "id")
    assert "1. **a** (2000) - No title [n]" in (tmp_path / "r.md").read_text()
    page = export.html_page(export.svg([export.circle(1, 2, 3, "#FFF", "<x>"), export.leaf(0, 0, 4, 2, 10, "#000")], 10, 10), rows.withColumn("role", F.lit("</script>")), ["title"])
    assert "<\\/script>" in page and "&lt;x&gt;" in page
    pairs = spark.createDataFrame([("a", "b", 0.5), ("a", "z", 0.9)], "a string, b string, combined double")
    assert export.gephi_edges(pairs, rows.select("id")).count() == 1


def test_layout():
    square = layout.path_polygon("M 0 0 H 10 V 10 h -10 Z")
    assert layout.inside(5, 5, square) and not layout.inside(11, 5, square)
    assert len(layout.path_polygon("M0 0 C 0 1 1 1 1 0")) == 9
    with pytest.raises(ValueError):
        layout.path_polygon("M 0 0 A 1 1")
    assert layout.path_polygon("M 0 0 H 10 V 10 Z l 5 5") == [(0, 0), (10, 0), (10, 10), (0, 0), (5, 5)]
    assert layout.path_polygon("m 1 1 l 2 0 z m 1 0 h 3") == [(1, 1), (3, 1), (1, 1), (2, 1), (5, 1)]
    with pytest.raises(RuntimeError):
        layout.canopy_places([1.0], [(0.0, 0.0), (1.0, 1.0), (2.0, 2.0)])
    places = layout.canopy_places([2.0] * 10, square, seed=3)
    assert places == layout.canopy_places([2.0] * 10, square, seed=3) and all(layout.inside(x, y, square) for x, y, _ in places)
    assert min(math.hypot(a[0] - b[0], a[1] - b[1]) for a in places for b in places if a != b) >= 2.0 * 1.18 * 0.68
    wide = layout.path_polygon("M 0 0 H 900 V 900 H 0 Z")
    apart = layout.canopy_places([40.0, 10.0], wide, seed=1)
    assert math.hypot(apart[0][0] - apart[1][0], apart[0][1] - apart[1][1]) >= (40 + 10) / 2 * 1.18
    assert all(abs((turn - math.degrees(math.atan2(y - 450, x - 450)) + 180) % 360 - 180) <= 42 for x, y, turn in apart)
    assert len(layout.canopy_places([30.0] * 6, square, seed=2)) == 6  # crowded: no distance holds
    assert layout.fan(1, (0, 0), (10, 10))[0] == pytest.approx((5, 10 * math.sin(math.radians(60))))
    assert layout.radius_px(25.4) == pytest.approx(48)
    assert len(layout.leaf_places(5)) == 5 and layout.arc(3, 0, 0, 1)[0] == (0, 0)
    assert layout.columns([["a"], ["b", "c"]])["c"] == (460, 210)
    assert math.isclose(layout.diagonal(3, (0, 0), (1, 2))[2][1], 4)


def test_gexf_round_trip_of_parts(spark, tmp_path, monkeypatch):
    from pyspark.sql import DataFrame
    from xml.etree import ElementTree

    odd = [("a&b", 'say "x" <y>', "#0A0B0C", 1.5, None), ("c'\td\n", None, "#FFFFFF", 2.0, 7), ("é", "", "#000000", 0.25, 8)]
    nodes = spark.createDataFrame(odd + [(f"n{i}", f"t{i}", "#102030", 1.0, i) for i in range(200)], "id string, title string, color string, size double, year int").repartition(5)
    links = [("a&b", "é", 0.5), ("c'\td\n", "a&b", 2.0)] + [(f"n{i}", f"n{i + 1}", 1.0) for i in range(199)]
    edges = spark.createDataFrame(links, "src string, dst string, weight double").repartition(4)
    monkeypatch.setattr(DataFrame, "toLocalIterator", lambda *_: pytest.fail("rows come to the driver"))
    for _ in range(2):  # the second one replaces the first
        export.write_gexf(tmp_path / "graph.gexf", nodes, edges, label="title", color="color", size="size")
    assert [p.name for p in tmp_path.iterdir()] == ["graph.gexf"]
    space = "{http://www.gexf.net/1.2draft}"
    root = ElementTree.parse(tmp_path / "graph.gexf").getroot()
    found = {n.get("id"): (n.get("label"), [v.get("value") for v in n.iter(f"{space}attvalue")]) for n in root.iter(f"{space}node")}
    assert found == {r.id: (r.title or r.id, [r.title or "", "" if r.year is None else str(r.year)]) for r in nodes.collect()}
    assert {(e.get("source"), e.get("target"), float(e.get("weight"))) for e in root.iter(f"{space}edge")} == set(links)
    assert len({e.get("id") for e in root.iter(f"{space}edge")}) == len(links)
    color = next(root.iter(space.replace("}", "/viz}color")))
    assert {int(color.get(c)) for c in "rgb"} <= {10, 11, 12, 255, 0, 16, 32, 48}
    back, pairs = citations.gexf(spark, str(tmp_path / "graph.gexf"))
    assert back.count() == 203 and pairs.count() == len(links)
    export.write_gexf(tmp_path / "none.gexf", nodes.limit(0), None)
    assert "<node " not in (tmp_path / "none.gexf").read_text()


def test_labels_of_drawings_are_escaped():
    from xml.etree import ElementTree

    page = drawings.workflow(["A & B", "<c>"])
    assert "A & B" in "".join(ElementTree.fromstring(page).itertext())


def test_kept_tables_are_made_anew_after_a_release(spark, tmp_path):
    from pathlib import Path

    from citeloom import storage
    from citeloom.sources import driver_tables

    made = []

    def make():
        made.append(storage.stored(spark.range(3), "three"))
        return made[-1]

    ask = lambda: driver_tables.kept(spark, str(tmp_path), "three", make).count()
    here = lambda df: Path(df._stored_at.removeprefix("file:")).exists()
    assert ask() == ask() == 3 and len(made) == 1
    storage.release(spark)
    assert not here(made[0]) and ask() == 3 and len(made) == 2
    (tmp_path / "another").write_text("x")  # the tables changed
    assert ask() == 3 and len(made) == 3 and here(made[2]) and not here(made[1])


def test_streams(spark, tmp_path):
    src = str(tmp_path / "in")
    schema = "src string, dst string"
    spark.createDataFrame([("a", "x"), ("b", "x")], schema).write.parquet(f"{src}/1")
    q = stream.keep_degrees(spark.readStream.schema(schema).parquet(f"{src}/*"), str(tmp_path / "deg"), str(tmp_path / "ck"))
    q.awaitTermination(60)
    spark.createDataFrame([("c", "x"), ("c", "y")], schema).write.parquet(f"{src}/2")
    stream.keep_degrees(spark.readStream.schema(schema).parquet(f"{src}/*"), str(tmp_path / "deg"), str(tmp_path / "ck")).awaitTermination(60)
    assert sorted(map(tuple, stream.degrees(spark, str(tmp_path / "deg")).collect())) == [("x", 3), ("y", 1)]
    ev = spark.createDataFrame([(datetime(2024, 1, 1, 0, 5), 1, "x"), (datetime(2024, 1, 1, 0, 6), 1, "x"), (datetime(2024, 1, 1, 9), 2, "y")], "ts timestamp, event_id long, dst string")
    ev.write.parquet(str(tmp_path / "ev"))
    out = stream.velocity(spark.readStream.schema(ev.schema).parquet(str(tmp_path / "ev"))).writeStream.format("memory").queryName("velocity").outputMode("append").trigger(availableNow=True).start()
    out.awaitTermination(60)
    assert [(r.dst, r.citations) for r in spark.sql("SELECT * FROM velocity").collect()] == [("x", 1)]


def test_drawings(spark, tmp_path):
    from citeloom.sources import drawings

    rows = [(f"N{i}, 200{i}", f"c{i % 2}", 0.1 * i, 2000 + i, float(i), 14.0, "#C4AE97", "core" if i < 2 else "peripheral", 20.0, 8.6, "#7D932D", 22.0) for i in range(5)]
    df = spark.createDataFrame(rows, "id string, cluster string, anchor_score double, year int, sap double, size double, color string, branch_member_role string, leaf_length double, leaf_width double, leaf_color string, radius double")
    df = df.withColumn("fruit_score", F.col("anchor_score")).withColumn("grp", F.col("cluster"))
    clustered = df.withColumn("cluster_order", F.when(F.col("cluster") == "c0", 1).otherwise(2)).withColumn("citations_received", F.col("sap"))
    page = drawings.roots(clustered, labels=True)
    assert page.count("<circle") == 5 and "Cluster 2" in page and 'cx="840.00"' in page  # the second cluster's first slot of two
    many = df.withColumn("cluster_order", F.lit(1)).withColumn("citations_received", F.col("sap")).crossJoin(spark.range(2).toDF("n"))
    assert drawings.roots(many).count("<circle") == 10
    cards = drawings.role_cards(df.withColumn("branch_core_score", F.col("anchor_score")))
    assert set(cards) == {"c0", "c1"} and "core (1)" in cards["c0"] and "N2, 2002" in cards["c0"]
    overview = drawings.branch_overview(spark.createDataFrame([("branch_2", 3, 0.5, 1, "weak_or_preliminary_candidate"), ("branch_1", 4, 0.25, 2, "x")], "grp string, paper_count int, branch_emergence_score double, branch_emergence_rank int, branch_emergence_type string"))
    assert overview.index("branch_2 (3)") < overview.index("branch_1 (4)") and 'width="200.0"' in overview
    assert drawings.leaves(df, labels=True).count("<text") == 5 and drawings.workflow(["a", "b"]).count("<rect") == 2
    assert drawings.trunk(df, ["c1"]).count("<circle") == 2
    assert {k: v.count("<circle") for k, v in drawings.branches(df).items()} == {"c0": 3, "c1": 2}
    assert drawings.leaves(df, exclude=["N1, 2001"]).count("<path") == 4
    assert drawings.canopy(df, "M 0 0 H 200 V 200 H 0 Z").count("<path") == 5
    assert drawings.fruits(df.limit(3)).count("<circle") == 3 and drawings.fruits(df).count("<circle") == 5
    assert "root" in drawings.legend([("root", "#000")])
    assert not drawings.copy_if_exists(tmp_path / "no", tmp_path / "x") and drawings.copy_if_exists(__file__, tmp_path / "a" / "b.py")
