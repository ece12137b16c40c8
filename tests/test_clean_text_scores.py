import math

import pytest
from pyspark.sql import functions as F

from citeloom.functions import columns as C
from citeloom.operators import clean, graph, scores, similarity, text, topics


def one(spark, column):
    return spark.range(1).select(column).first()[0]


def test_columns(spark):
    assert one(spark, C.trim_ws(F.lit("\t a b\n"))) == "a b"
    assert one(spark, C.semicolon_parts(F.lit(" a ;; b;"))) == ["a", "b"]
    assert one(spark, C.tokens(F.lit("The Café of data-driven Marketing is ok"))) == ["caf", "driven", "marketing"]
    assert one(spark, C.year_in_word(F.lit("SMITH J, 1999, J 20011"))) == 1999
    assert one(spark, C.year_in_digits(F.lit("x12003y2004"))) == 2004
    assert one(spark, C.year_in_word(F.lit("none"))) is None
    assert one(spark, C.mixed_color(F.lit(0.5), ("#000000", "#FFFFFF"))) == "#808080"
    assert one(spark, C.short_label(F.lit("SMITH J, 1999, JOURNAL"))) == "SMITH J, 1999"
    assert one(spark, C.number(F.lit("x"))) is None
    assert C.weights(1, 3) == [0.25, 0.75]
    with pytest.raises(ValueError):
        C.weights(0, 0)


def test_minmax_constant_is_one(spark):
    df = spark.createDataFrame([(2.0,), (2.0,), (None,)], "v double")
    assert [r[0] for r in df.select(C.minmax(F.col("v"))).collect()] == [1.0, 1.0, None]


def test_corrections_and_nulls(spark):
    df = spark.createDataFrame([(" A ", "B"), ("A", "B\n"), (None, "B"), ("ANONYMOUS, 1", "B"), ("", "B"), ("X", "A")], "SR string, SR_ref string")
    assert sorted(map(tuple, clean.correct_citations(df, {"A": "X"}).collect())) == [("X", "B"), ("X", "X")]
    assert ("nan", "B") in set(map(tuple, clean.correct_citations(df, {}, legacy_nan_id=True).collect()))
    with pytest.raises(ValueError, match="missing columns"):
        clean.correct_citations(df.drop("SR"), {})


def test_coalescing_prefers_the_canonical_row(spark):
    rows = [("B", None, "x", "10.1;10.2", 0), ("A", "title", " ", "10.2", 1), ("C", "other", "z", "10.3", 2), ("D", "d", "d", "9", 3)]
    df = spark.createDataFrame(rows, "SR string, title string, journal string, doi string, n int")
    out = clean.coalesce_records(df, "SR", "n", {"B": "A", "C": "A"}, merged_lists={"doi": ["A"]}, dropped=F.col("SR") == "D")
    assert [tuple(r) for r in out.select("SR", "title", "journal", "doi").collect()] == [("A", "title", "x", "10.2;10.1;10.3")]
    preferred = clean.coalesce_records(df.filter("SR IN ('B', 'C')"), "SR", "n", {"B": "A", "C": "A"}, preferred={"A": "C"})
    assert preferred.first()["title"] == "other"


def test_override_and_main_articles(spark):
    rows = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    changes = spark.createDataFrame([("b", 9), ("c", 3)], "k string, v int")
    assert sorted(map(tuple, clean.override(rows, changes, "k").collect())) == [("a", 1), ("b", 9), ("c", 3)]
    flagged = spark.createDataFrame([("a", "Yes"), ("b", None), ("c", "0")], "k string, ismain_wos string")
    assert [r.k for r in clean.main_articles(flagged).collect()] == ["a"]
    assert clean.main_articles(rows).count() == 2
    assert clean.normalize_columns(rows.withColumnRenamed("k", "TITLE")).columns == ["title", "v"]


def test_tfidf_counts_empty_documents_and_cosine(spark):
    docs = spark.createDataFrame([("a", ["x", "x", "y"]), ("b", ["x"]), ("c", [])], "doc string, tokens array<string>")
    v = {(r.doc, r.term): r.w for r in text.tfidf(docs).collect()}
    assert v["a", "x"] == pytest.approx(2 / 3 * (math.log(4 / 3) + 1))
    assert v["a", "y"] == pytest.approx(1 / 3 * (math.log(4 / 2) + 1))
    got = {(r.a, r.b): r.similarity for r in text.cosine_pairs(text.tfidf(docs), docs).collect()}
    norm = math.hypot(v["a", "x"], v["a", "y"])
    assert got["a", "b"] == pytest.approx(v["a", "x"] / norm)
    assert got["a", "c"] == got["b", "c"] == 0.0
    groups = docs.withColumn("grp", F.lit("g"))
    mean = text.mean_pairwise(text.tfidf_by_group(groups), groups.select("doc", "grp")).first()
    assert mean.mean_similarity == pytest.approx(got["a", "b"] / 3)


def test_overlap_combine_and_matrix(spark):
    papers = spark.createDataFrame([("p",), ("q",), ("r",)], "doc string")
    sets = spark.createDataFrame([("p", 1), ("p", 2), ("q", 2)], "doc string, member int")
    pairs = similarity.overlap_pairs(sets, papers)
    got = {(r.a, r.b): (r.cosine, r.jaccard) for r in pairs.collect()}
    assert got == {("p", "q"): (0.707107, 0.5), ("p", "r"): (0.0, 0.0), ("q", "r"): (0.0, 0.0)}
    both = similarity.combine(papers, {"x": pairs.select("a", "b", "cosine"), "y": pairs.select("a", "b", "jaccard")}, {"x": 3, "y": 1})
    assert both.filter("a = 'p' AND b = 'q'").first()["combined"] == pytest.approx(0.655330)
    wide = {r.id: (r.p, r.q) for r in similarity.matrix(pairs, "jaccard", ["p", "q"]).collect()}
    assert wide["p"] == (1.0, 0.5)
    labels = similarity.shared_members(sets, papers.withColumn("community", F.when(F.col("doc") == "r", "two").otherwise("one")))
    assert {r.community: r.label for r in labels.collect()} == {"one": "2; 1", "two": "isolated_root"}


def test_published_cluster_and_fruit_numbers(spark):
    assert round(67 / 70, 6) == 0.957143
    rows = spark.createDataFrame([("a", 9.0, 0.7, "fruit_candidate"), ("b", 4.0, 0.5, "external_fruit_underabsorbed"), ("c", 2.0, 0.6, "fruit_candidate")], "id string, external_velocity double, fruit_score double, fruit_signal_type string")
    out = {r.id: r.radius for r in scores.top_fruits(rows).collect()}
    assert out == {"a": 34.0, "b": 34.0, "c": 20.0}


def test_confidence_and_paths(spark):
    got = spark.createDataFrame([(0.25,), (0.08,), (0.01,), (0.0,)], "s double").select(scores.confidence(F.col("s"))).collect()
    assert [r[0] for r in got] == ["strong", "moderate", "weak", "unassigned"]
    d = spark.createDataFrame([("x", "p", 0), ("y", "p", 2), ("z", "p", 4)], "id string, parent string, distance int")
    assert sorted((r.id, r.proximity) for r in scores.path_proximity(d).collect()) == [("x", 1.0), ("y", 0.5)]


def test_growth_counts_empty_years(spark):
    m = spark.createDataFrame([("g", 2000), ("g", 2000), ("g", 2002)], "grp string, year int")
    # 2 -> 0: -1; 0 -> 1: 1; 1 -> 0: -1
    assert scores.growth(m, 2003).first()["growth_rate"] == pytest.approx(-1 / 3)


def test_reference_novelty_window(spark):
    refs = spark.createDataFrame([("f", "r1"), ("f", "r2"), ("c", "r1"), ("late", "r1"), ("old", "r2")], "src string, dst string")
    years = spark.createDataFrame([("f", 2010), ("c", 2005), ("late", 2012), ("old", 1990)], "id string, year int")
    out = scores.reference_novelty(spark.createDataFrame([("f",), ("none",)], "id string"), refs, years)
    got = {r.id: (r.reference_count, r.candidate_count, r.reference_novelty, r.supported) for r in out.collect()}
    assert got == {"f": (2, 1, 0.5, False), "none": (0, 0, None, False)}
    assert scores.windowed_references(refs, years).count() == 5
    assert scores.windowed_references(refs, years.union(spark.createDataFrame([("r1", 1980), ("r2", 2009)], "id string, year int"))).count() == 1


def test_hot_references_in_blocks_equal_the_plain_join(spark):
    import random

    rng = random.Random(4)
    refs = sorted({(f"p{i}", f"r{min(rng.randrange(12), rng.randrange(12))}") for i in range(60) for _ in range(4)})
    year = {f"p{i}": rng.choice([None, *range(1990, 2010)]) for i in range(60)}
    edges, years = spark.createDataFrame(refs, "src string, dst string"), spark.createDataFrame(list(year.items()), "id string, year int")
    focal = years.select("id").filter("id < 'p4'")
    for window in (10, None):
        plain, blocks = ({tuple(r) for r in scores.reference_novelty(focal, edges, years, window, hot_citers=n).collect()} for n in (1000, 5))
        assert plain == blocks and len(plain) == focal.count()
    of = {p: {r for q, r in refs if q == p} for p in year}
    for r in scores.reference_novelty(focal, edges, years, 10, hot_citers=5).collect():
        y = year[r.id]
        cands = [c for c in year if c != r.id and of[c] & of[r.id] and (y is None or year[c] is not None and y - 10 <= year[c] < y)]
        mean = sum(len(of[c] & of[r.id]) / len(of[c] | of[r.id]) for c in cands) / len(cands) if cands else None
        assert r.candidate_count == len(cands) and (mean is None and r.mean_overlap is None or r.mean_overlap == pytest.approx(mean, abs=1e-6))


def test_topics_separate_two_vocabularies(spark):
    rows = [(f"d{i}", ["aaa", "bbb"] * 3 if i < 3 else ["ccc", "ddd"] * 3) for i in range(6)]
    docs = spark.createDataFrame(rows, "doc string, tokens array<string>")
    found = topics.topics(topics.tensor(text.term_counts(docs), docs, bins=1), rank=2, iterations=100, bins=1)
    best = {r.doc: r.topic for r in found.filter("dominant").collect()}
    assert len({best[f"d{i}"] for i in range(3)}) == 1 and best["d0"] != best["d5"]
    assert {(r.a, r.b): r.similarity for r in topics.topic_pairs(found).collect()}["d0", "d1"] == pytest.approx(1.0, abs=1e-3)


def dense_factors(x, rank, iterations, seed):
    """The multiplicative updates on the dense tensor."""
    import numpy as np

    rng = np.random.default_rng(seed)
    parts = [rng.random((n, rank)) + 0.1 for n in x.shape]
    for _ in range(iterations):
        for mode, form in enumerate(("ijk,jr,kr->ir", "ijk,ir,kr->jr", "ijk,ir,jr->kr")):
            y, z = (parts[m] for m in range(3) if m != mode)
            parts[mode] *= np.einsum(form, x, y, z) / np.maximum(parts[mode] @ ((y.T @ y) * (z.T @ z)), 1e-10)
        scale = np.maximum(np.linalg.norm(parts[1], axis=0), 1e-10)
        parts[1] /= scale
        parts[0] *= scale
    return parts


def test_factors_by_rounds_equal_those_of_the_dense_tensor(spark):
    import numpy as np

    rng = np.random.default_rng(5)
    x = rng.random((7, 12, 3)) * (rng.random((7, 12, 3)) < 0.4)
    x[:, :, 0] += 0.1 * (np.arange(12) % 3 == 0)
    where = np.argwhere(x)
    cells = spark.createDataFrame([(f"d{i}", f"t{j:02}", int(k), float(x[i, j, k])) for i, j, k in where], "doc string, term string, bin int, v double").repartition(3)
    want = dense_factors(x, 3, 4, 9)
    found = topics.factorize((*where.T, x[tuple(where.T)]), x.shape, 3, 4, 9)
    assert all(np.allclose(a, b, rtol=0, atol=1e-9) for a, b in zip(found, want, strict=True))
    docs, terms = graph.places(cells, "doc"), graph.places(cells, "term")
    assert [(r.doc, r.n) for r in docs.orderBy("doc").collect()] == [(f"d{i}", i) for i in range(7)]
    rows = cells.join(docs.withColumnRenamed("n", "i"), "doc").join(terms.withColumnRenamed("n", "j"), "term").select("i", "j", F.col("bin").alias("k"), "v")
    for df, factor in zip(topics.factorize_rounds(rows, docs, terms, 3, 3, 4, 9), want, strict=False):
        assert np.allclose([tuple(r) for r in df.orderBy("n").select("f0", "f1", "f2").collect()], factor, rtol=0, atol=1e-9)
    key = lambda r: (r.doc, r.topic)
    one, many = (sorted(topics.topics(cells, 3, 4, 9, n_terms=2, task_cells=n).collect(), key=key) for n in (10**6, 0))
    assert [(r.doc, r.topic, r.dominant, r.terms) for r in one] == [(r.doc, r.topic, r.dominant, r.terms) for r in many] and len(one) == 21
    assert [r.weight for r in one] == pytest.approx([r.weight for r in many], abs=1e-9)
    share = want[0] / want[0].sum(axis=1, keepdims=True)
    assert [r.weight for r in one] == pytest.approx(share.reshape(-1).tolist(), abs=1e-9)
    assert all(r.confidence == pytest.approx(share[int(r.doc[1:])].max(), abs=1e-9) for r in one)
    assert topics.topics(cells.limit(0)).count() == 0


def test_article_tidy(spark):
    rows = [(0, "A ", "ta", None, "10.1/a;10.1/b"), (1, "B", "tb", "jb", "10.1/b; 10.1/c"), (2, "C", "", "jc", None), (3, "ANONYMOUS, 2", "x", "x", None), (4, "D", "gone", "x", " 10.9/Z "), (5, None, "x", "x", None), (6, "E", None, None, None)]
    df = spark.createDataFrame(rows, "_row long, SR string, title string, journal string, doi string")
    by_hand = spark.createDataFrame([("E", "hand", None), ("N", "new", "jn")], "SR string, title string, journal string")
    pairs = spark.createDataFrame([("B", "A"), ("C", "A")], "SR string, canonical string")
    for mapping in ({"B": "A", "C": "A"}, pairs):
        out = clean.tidy_articles(df, "_row", mapping, multi_doi=("A",), dropped_dois=("10.9/z",), overrides=by_hand)
        got = {r.SR: (r.title, r.journal, r.doi) for r in out.collect()}
        assert got == {"A": ("ta", "jb", "10.1/a;10.1/b;10.1/c"), "E": ("hand", None, None), "N": ("new", "jn", None)}


def test_publications(spark):
    rows = [("A ", "2019", "3", "yes"), ("A", "2018", "9", "TRUE"), ("B", "n/a", "5", "1"), ("C", "2010", "5", "1"), ("D", "2020", "x", "1"), (None, "2020", "1", "1"), ("E", "2020", "7", "no")]
    df = spark.createDataFrame(rows, "`sr ` string, Year string, cited_BY string, ismain_wos string")
    got = {r.SR: (r.year, r.cited_by) for r in clean.publications(df, 2020, 5).collect()}
    assert got == {"A": (2018, 9.0), "D": (2020, 0.0)}
    assert "E" in {r.SR for r in clean.publications(df, 2020, 5, include_non_main=True).collect()}
    with pytest.raises(ValueError, match="cited_by"):
        clean.publications(df.drop("cited_BY"), 2020)


def test_modes_ids_and_order(spark):
    df = spark.createDataFrame([("g", "b"), ("g", "a"), ("g", "b"), ("g", "a"), ("h", "z"), ("h", None), ("h", None)], "grp string, parent string")
    assert {r.grp: r.m for r in scores.mode(df, "grp", "parent", "m").collect()} == {"g": "a", "h": "z"}
    rows = [(f"p{i}", f"branch_{1 + i % 2}", ["core", "peripheral", "odd", "missing_metadata"][i % 4], 0.1 * (i % 3), None if i == 5 else 2000 + i, float(i)) for i in range(12)]
    members = spark.createDataFrame(rows, "id string, grp string, branch_member_role string, branch_core_score double, year int, citations_received double")
    order = {"core": 1, "peripheral": 2, "background_methodological": 3, "missing_metadata": 4}
    expected = [r[0] for r in sorted(rows, key=lambda r: (int(r[1][7:]), order.get(r[2], 5), -r[3], -(r[4] or -1), -r[5], r[0]))]
    assert [r.id for r in scores.display_order(members).orderBy("display_position").collect()] == expected
    ids = {r.id: r.pid for r in scores.positional_ids(members.withColumn("b", F.substring("grp", 8, 1)), "branch", F.col("id"), group="b").collect()}
    assert ids["p0"] == "branch_1_01" and ids["p1"] == "branch_2_01" and len(set(ids.values())) == 12
    many = scores.positional_ids(spark.range(120).select(F.col("id").cast("string")), "root", F.col("id").cast("int"))
    assert [r.pid for r in many.orderBy("position").collect()][::50] == ["root_01", "root_51", "root_101"]


def test_publication_years(spark):
    df = spark.createDataFrame([("SMITH J, 1999, J", "2001"), ("SMITH J, 1999, J", None), ("SMITH 19991", "n/a")], "id string, year string")
    assert [(r.year, r.metadata_year, r.year_from_id, r.year_source) for r in scores.publication_years(df).collect()] == [(2001, 2001, 1999, "metadata"), (1999, None, 1999, "node_id"), (None, None, None, "missing")]


def test_index_answers_as_a_full_scan(spark):
    from citeloom.operators import search

    rng = __import__("random").Random(3)
    names = ["Éa bcd", "aaa", "AAAA", "b", None, "x y", "日本語の", "a_b%c", "ab", ""]
    rows = [(f"i{k}", rng.choice(names), rng.choice(names), rng.choice([None, 1999, 2001]), rng.choice([*search.ROLES, None]), rng.choice(["s", "t", None])) for k in range(120)]
    df = spark.createDataFrame(rows, "id string, title string, journal string, year int, role string, subgroup string")
    index, whole = search.Index(df), df.withColumn("haystack", search.haystack(df))
    for query, role, subgroup in (("", None, None), ("a", None, None), ("AA", "leaf", None), ("aaa", None, "s"), ("é", None, None), ("本語", "root", "t"), ("a bcd", None, None), ("bcd  ", None, None), ("1999", "trunk", None), ("_b%", None, None), ("zzz", None, None), ("", "fruit", "t"), ("i11", None, None)):
        want = [r.id for r in search.ranked(whole.filter(search.matches(whole, query, role, subgroup))).orderBy("rank").collect()]
        assert [r.id for r in index.search(query, role, subgroup).orderBy("rank").collect()] == want, query
    assert [r.id for r in index.search("i11").collect()].count("i11") == 1 and index.search("q" * 50).count() == 0
    assert search.Index(df.limit(0)).search("a").count() == 0


def test_novelty_by_kinds_of_citers_equals_novelty_by_pairs(spark):
    import random

    rng = random.Random(5)
    edges = spark.createDataFrame(sorted({(rng.randrange(80), 100 + rng.randrange(25)) for _ in range(300)}), "src long, dst long")
    years = spark.createDataFrame([(n, None if n % 9 == 0 else 1990 + n % 14) for n in range(80)], "id long, year int")
    focal = spark.createDataFrame([(n,) for n in range(85)], "id long")
    made = []
    for window in (10, None):
        own = edges.join(years.select(F.col("id").alias("src"), F.col("year").alias("fy")), "src").withColumnRenamed("src", "id")
        other = edges.join(years.select(F.col("id").alias("src"), F.col("year").alias("cy")), "src").withColumnRenamed("src", "cand")
        sizes, citers = edges.groupBy("src").agg(F.count("*").alias("size")), edges.groupBy("dst").agg(F.count("*").alias("n"))
        fits = (F.col("cy") < F.col("fy")) & (F.lit(True) if window is None else F.col("cy") >= F.col("fy") - window)
        few, pairs = scores._overlaps(own, other, sizes, edges, fits), scores._met(own, other, sizes, citers, fits, 1, 5)
        rounded = lambda rows: {(r.id, r.candidate_count, round(r.overlap, 9)) for r in rows.collect()}
        assert rounded(few) == rounded(pairs)
        made.append({r.id: r.candidate_count for r in scores.reference_novelty(focal, edges, years, window).collect()})
        assert {k: v for k, v in made[-1].items() if v} == {r.id: r.candidate_count for r in pairs.collect()}
