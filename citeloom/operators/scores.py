"""Composite scores and rule classes of roots, trunk, branches, members, leaves and fruits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.columns import ACTIVE_GREENS, BROWNS, DORMANT_BROWNS, FRUIT_REDS, LEAF_GREENS, ROOT_SIZES, age, contains_any, joined, minmax, mixed_color, number, scaled, size_level, trim_ws, year_in_word
from ..storage import stored
from . import graph

# Phrases that mark sources and topics of branch members.
METHOD_TERMS = ("bibliometric", "checklist", "equation", "method", "methodological", "methodology", "modeling", "modelling", "qualitative", "reporting", "research method", "structural equation")
NON_SCHOLARLY_TERMS = ("guardian", "newspaper")
ROLE_ORDER = ("core", "peripheral", "background_methodological", "missing_metadata")
#: Lifts what would be a tie in rounding but for the order of a sum.
TIE = 1e-12


# --- sizes and colours ---------------------------------------------------------------------------


def velocity_color(df: DataFrame, current_year: int, scale: tuple[str, str] = BROWNS, citations: str = "citations_received", year: str = "year") -> DataFrame:
    """Adds citation_velocity, citation_velocity_score, color and its channels."""
    out = df.withColumn("citation_velocity", F.col(citations) / age(F.col(year), current_year))
    out = scaled(out, citation_velocity_score=F.log1p("citation_velocity")).withColumn("color", mixed_color(F.col("citation_velocity_score"), scale))
    return out.withColumns({f"color_{c}": F.conv(F.substring("color", i, 2), 16, 10).cast("int") for c, i in (("r", 2), ("g", 4), ("b", 6))})


def root_sizes(df: DataFrame, group: str, local: float = 0.7, overall: float = 0.3, sizes: Sequence[float] = ROOT_SIZES) -> DataFrame:
    """Adds final_root_size_score, visual_size_level and size: discrete classes of a score mixed from cluster and whole."""
    log = F.log1p("citations_received")
    out = scaled(df, _overall=log)
    out = out.withColumn("final_root_size_score", local * minmax(log, W.partitionBy(group)) + overall * F.col("_overall"))
    out = scaled(out, _level=0.5 * F.col("final_root_size_score") + 0.5 * F.sqrt("final_root_size_score"))
    out = out.withColumn("visual_size_level", size_level(F.col("_level")))
    return out.withColumn("size", F.element_at(F.array(*map(F.lit, sizes)), F.col("visual_size_level"))).drop("_overall", "_level")


def continuous_sizes(df: DataFrame, low: float = 6.0, high: float = 25.0) -> DataFrame:
    """Adds citation_size_score and size, by the square root of the score (trunk and branch nodes)."""
    out = scaled(df, citation_size_score=F.log1p("citations_received"))
    return out.withColumn("size", low + F.sqrt("citation_size_score") * (high - low))


def leaf_metrics(df: DataFrame, degree: str = "in_degree", low: float = 19.0, high: float = 34.0, colored: bool = False) -> DataFrame:
    """Adds year_score, leaf_length, leaf_width and leaf_color (unless ``colored``). df: year, and the degree that gives the size. A missing year counts as the oldest."""
    oldest = df.agg(F.min("year").alias("_oldest"))
    out = df.crossJoin(F.broadcast(oldest))  # one row
    out = scaled(out, year_score=F.coalesce("year", "_oldest").cast("double"), citation_size_score=F.log1p(F.col(degree).cast("double"))).drop("_oldest")
    out = out.withColumn("leaf_length", low + F.col("citation_size_score") * (high - low)).withColumn("leaf_width", F.col("leaf_length") * 0.43)
    return out if colored else out.withColumn("leaf_color", mixed_color(F.col("year_score"), LEAF_GREENS))


def temporal_leaves(df: DataFrame, recent_years: int = 5) -> DataFrame:
    """Adds leaf_age, leaf_temporal_class and leaf_color by age from the newest year of all."""
    bounds = df.agg(F.max("year").alias("_new"), F.min("year").alias("_old"))
    out = df.crossJoin(F.broadcast(bounds)).withColumn("leaf_age", F.col("_new") - F.col("year"))  # one row
    out = out.withColumn("_span", F.greatest(F.lit(1.0), (F.col("_new") - recent_years - F.col("_old")).cast("double")))
    recent = F.col("leaf_age") <= recent_years
    kind = F.when(F.col("year").isNull(), "unknown_year_leaf").when(F.col("leaf_age") == 0, "fresh_frontier_leaf").when(recent, "recent_dark_green_leaf").otherwise("dormant_leaf")
    fresh = mixed_color(1.0 - F.col("leaf_age") / float(recent_years), ACTIVE_GREENS)
    old = mixed_color((F.col("year") - F.col("_old")).cast("double") / F.col("_span"), DORMANT_BROWNS)
    color = F.when(F.col("year").isNull(), DORMANT_BROWNS[0]).when(recent, fresh).otherwise(old)
    return out.withColumn("leaf_temporal_class", kind).withColumn("leaf_color", color).drop("_span", "_old", "_new")


# --- root clusters -------------------------------------------------------------------------------


def cluster_metrics(pairs: DataFrame, clusters: DataFrame, influence: DataFrame, supporters: DataFrame, shares: tuple[float, float, float] = (0.45, 0.25, 0.30)) -> DataFrame:
    """Per cluster: member_count, cohesion, external_strength, separation, support, supported, strength.

    pairs: a, b, combined. clusters: doc, cluster. influence: seed, id (who reaches a root).
    supporters: id (trunk and leaf nodes). Separation is 1 minus the mean pair across the cluster's rim.
    """
    ca, cb = clusters.select(F.col("doc").alias("a"), F.col("cluster").alias("ca")), clusters.select(F.col("doc").alias("b"), F.col("cluster").alias("cb"))
    tied = pairs.join(ca, "a").join(cb, "b")
    inner = tied.filter("ca = cb").groupBy(F.col("ca").alias("cluster")).agg(F.avg("combined").alias("cohesion"))
    rim = tied.filter("ca <> cb").select(F.explode(F.array("ca", "cb")).alias("cluster"), "combined").groupBy("cluster").agg(F.avg("combined").alias("external"))
    reached = influence.join(supporters.select("id"), "id").filter("seed <> id").join(clusters.withColumnRenamed("doc", "seed"), "seed").groupBy("cluster").agg(F.countDistinct("id").alias("supported"))
    total = supporters.agg(F.count(F.lit(1)).alias("total"))
    out = clusters.groupBy("cluster").agg(F.count(F.lit(1)).alias("member_count")).join(inner, "cluster", "left").join(rim, "cluster", "left").join(reached, "cluster", "left").crossJoin(F.broadcast(total))  # one row
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    out = out.withColumn("supported", F.coalesce("supported", F.lit(0))).withColumn("support", F.coalesce(F.col("supported") / F.nullif("total", F.lit(0)), F.lit(0.0)))
    strength = shares[0] * zero("cohesion") + shares[1] * (1.0 - zero("external")) + shares[2] * F.col("support")
    r = lambda c: F.round(c, 6)
    return out.select("cluster", "member_count", r(zero("cohesion")).alias("cohesion"), r(zero("external")).alias("external_strength"), r(1.0 - zero("external")).alias("separation"), r(F.col("support")).alias("support"), "supported", r(strength).alias("strength"))


def root_anchors(papers: DataFrame, pairs: DataFrame, clusters: DataFrame) -> DataFrame:
    """root_anchor_score: 0.6 of the min-max of sap and 0.4 of the mean tie within the cluster. papers: doc, sap."""
    both = pairs.select("a", "b", "combined").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "combined"))
    tied = both.join(clusters.select(F.col("doc").alias("a"), F.col("cluster").alias("ca")), "a").join(clusters.select(F.col("doc").alias("b"), F.col("cluster").alias("cb")), "b").filter("ca = cb")
    ties = tied.groupBy(F.col("a").alias("doc")).agg(F.sum("combined").alias("ties"))
    size = F.count(F.lit(1)).over(W.partitionBy("cluster"))
    out = papers.join(clusters, "doc").join(ties, "doc", "left").withColumn("others", size - 1)
    tie = F.when(F.col("others") > 0, F.coalesce("ties", F.lit(0.0)) / F.col("others")).otherwise(0.0)
    out = out.withColumn("within", tie).withColumn("normalized_sap", minmax(F.col("sap").cast("double")))
    return out.select("cluster", "doc", F.round("normalized_sap", 6).alias("normalized_sap"), F.round("within", 6).alias("within_strength"), F.round(0.6 * F.col("normalized_sap") + 0.4 * F.col("within"), 6).alias("anchor_score"))


def display_clusters(metrics: DataFrame, n: int = 3) -> DataFrame:
    return metrics.filter("member_count > 1").orderBy(F.col("strength").desc(), F.col("member_count").desc(), "cluster").limit(n)


# --- branches ------------------------------------------------------------------------------------


def confidence(score: Column) -> Column:
    return F.when(score >= 0.25, "strong").when(score >= 0.08, "moderate").when(score > 0, "weak").otherwise("unassigned")


def path_proximity(distances: DataFrame, max_depth: int = 3) -> DataFrame:
    """(id, parent, distance, proximity) from distances (id, parent, distance): 1/distance of the nearest member, 1 where a paper is a member itself."""
    near = distances.filter(F.col("distance") <= max_depth).groupBy("id", "parent").agg(F.min("distance").alias("distance"))
    return near.withColumn("proximity", F.when(F.col("distance") == 0, 1.0).otherwise(F.lit(1.0) / F.nullif("distance", F.lit(0))))


def assign(papers: DataFrame, parents: DataFrame, path: DataFrame, text: DataFrame, references: DataFrame, shares: tuple[float, float, float] = (0.40, 0.35, 0.25)) -> DataFrame:
    """Each paper's best parent: id, parent, score, proximity, text_similarity, reference_similarity, confidence.

    papers: id. parents: parent (a handful). path: id, parent, proximity. text and references: id,
    parent, value. Ties by proximity, text, then parent.
    """
    rows = papers.select("id").crossJoin(F.broadcast(parents.select("parent")))
    for name, df in (("proximity", path), ("text_similarity", text), ("reference_similarity", references)):
        value = "proximity" if "proximity" in df.columns else "value"
        rows = rows.join(df.select("id", "parent", F.col(value).alias(name)), ["id", "parent"], "left").withColumn(name, F.round(F.coalesce(name, F.lit(0.0)), 6))
    # parts have 6 digits and shares 2, so 8 digits hold the sum itself
    rows = rows.withColumn("score", F.round(shares[0] * F.col("proximity") + shares[1] * F.col("text_similarity") + shares[2] * F.col("reference_similarity"), 8))
    order = W.partitionBy("id").orderBy(F.col("score").desc(), F.col("proximity").desc(), F.col("text_similarity").desc(), "parent")
    return rows.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n").withColumn("confidence", confidence(F.col("score")))


def assignment_summary(assignments: DataFrame) -> DataFrame:
    """Per parent: counts by confidence, means and members."""
    kinds = {f"n_{k}": F.count_if(F.col("confidence") == k) for k in ("strong", "moderate", "weak", "unassigned")}
    return assignments.groupBy("parent").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("score"), 6).alias("mean_score"), F.round(F.avg("proximity"), 6).alias("mean_proximity"), *(c.alias(n) for n, c in kinds.items()), joined(F.collect_list(F.struct(F.col("id").alias("v")))).alias("members")
    )


def parent_distribution(assignments: DataFrame) -> DataFrame:
    """Per branch (grp, parent, score, confidence): dominant and heaviest parent, concentration, share of firm assignments, distributions."""
    per = assignments.groupBy("grp", "parent").agg(F.count(F.lit(1)).alias("c"), F.sum("score").alias("s"))
    w = W.partitionBy("grp")
    per = per.withColumn("by_score", F.row_number().over(w.orderBy(F.round("s", 9).desc(), "parent")))
    total, heaviest = F.sum("s"), F.max(F.when(F.col("by_score") == 1, F.col("s")))
    out = per.groupBy("grp").agg(
        F.max(F.when(F.col("by_score") == 1, F.col("parent"))).alias("heaviest_parent"),
        F.round(F.when(total > 0, heaviest / F.nullif(total, F.lit(0.0))).otherwise(0.0), 6).alias("concentration"),
        joined(F.collect_list(F.struct("parent", F.concat_ws(":", F.col("parent").cast("string"), F.col("c").cast("string")).alias("v")))).alias("count_distribution"),
        joined(F.collect_list(F.struct("by_score", F.concat_ws(":", F.col("parent").cast("string"), F.format_string("%.6f", "s")).alias("v")))).alias("score_distribution"),
    )
    firm = assignments.groupBy("grp").agg(F.round(F.avg(F.col("confidence").isin("strong", "moderate").cast("int")), 6).alias("firm_share"))
    return out.join(mode(assignments, "grp", "parent", "dominant_parent"), "grp").join(firm, "grp")


def mode(rows: DataFrame, group: str, value: str, name: str) -> DataFrame:
    """(group, name): the most frequent value of each group, of equally frequent ones the smallest; nulls don't count."""
    return rows.groupBy(group).agg(F.mode(value, True).alias(name))


def positional_ids(rows: DataFrame, prefix: str, *order: Column, group: str | None = None) -> DataFrame:
    """Adds position (from 1, in the order given, within each group if one is named) and pid: root_01, or branch_1_03 with the group's number between.

    For role tables, whose size is a parameter.
    """
    w = W.partitionBy(*([group] if group else [])).orderBy(*order)
    parts = [F.lit(prefix), *([F.col(group).cast("string")] if group else [])]
    out = rows.withColumn("position", F.row_number().over(w))
    digits = F.when(F.col("position") < 10, F.lpad(F.col("position").cast("string"), 2, "0")).otherwise(F.col("position").cast("string"))
    return out.withColumn("pid", F.concat_ws("_", *parts, digits))


def display_order(members: DataFrame) -> DataFrame:
    """Adds display_position: branches by number, then roles from core on, then greatest core score, newest, most cited, id.

    members: id, grp (branch_N), branch_member_role, branch_core_score, year, citations_received.
    """
    number = F.regexp_extract("grp", r"(\d+)", 1).try_cast("int")
    role = F.coalesce(F.array_position(F.array(*(F.lit(r) for r in ROLE_ORDER)), F.col("branch_member_role")), F.lit(0))
    place = F.when(role == 0, len(ROLE_ORDER) + 1).otherwise(role)
    order = [number, place, F.col("branch_core_score").desc_nulls_last(), F.col("year").desc_nulls_last(), F.col("citations_received").desc_nulls_last(), "id"]
    return members.withColumn("display_position", F.row_number().over(W.orderBy(*order)))


def publication_years(rows: DataFrame) -> DataFrame:
    """Adds metadata_year, year_from_id, year (the first where there is one, else the second) and year_source: metadata, node_id or missing. rows: id, year."""
    out = rows.withColumn("metadata_year", number(F.col("year")).cast("int")).withColumn("year_from_id", year_in_word(F.col("id")))
    source = F.when(F.col("metadata_year").isNotNull(), "metadata").when(F.col("year_from_id").isNotNull(), "node_id").otherwise("missing")
    return out.withColumns({"year": F.coalesce("metadata_year", "year_from_id"), "year_source": source})


def growth(members: DataFrame, current_year: int) -> DataFrame:
    """Per group (grp, year): average growth rate over every year from the first to the current one; after an empty year growth is the count."""
    counts = members.groupBy("grp", "year").agg(F.count(F.lit(1)).alias("n"))
    span = counts.groupBy("grp").agg(F.min("year").alias("first")).select("grp", F.explode(F.sequence(F.col("first"), F.greatest(F.col("first"), F.lit(current_year)))).alias("year"))
    dense = span.join(counts, ["grp", "year"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    dense = dense.withColumn("prev", F.lag("n").over(W.partitionBy("grp").orderBy("year")))
    rate = F.when(F.col("prev") == 0, F.col("n").cast("double")).otherwise((F.col("n") - F.col("prev")) / F.nullif("prev", F.lit(0)))
    return dense.groupBy("grp").agg(F.coalesce(F.avg(F.when(F.col("prev").isNotNull(), rate)), F.lit(0.0)).alias("growth_rate"))


def windows(members: DataFrame, current_year: int, years: int = 5) -> DataFrame:
    """Per group (grp, year): papers, recent and previous window counts, recent share and growth, years covered."""
    recent, previous = current_year - years + 1, current_year - 2 * years + 1
    y = F.col("year")
    out = members.groupBy("grp").agg(
        F.count(F.lit(1)).alias("paper_count"), F.count_if(y >= recent).alias("recent_count"), F.count_if((y >= previous) & (y < recent)).alias("previous_count"),
        F.avg("year").alias("mean_year"), F.max("year").alias("newest_year"), F.min("year").alias("oldest_year"), F.countDistinct("year").alias("active_years"),
    )
    out = out.withColumn("recent_share", F.col("recent_count") / F.col("paper_count"))
    out = out.withColumn("recent_growth", (F.col("recent_count") - F.col("previous_count")) / F.greatest("previous_count", F.lit(1)))
    return out.withColumn("active_share", F.col("active_years") / (F.greatest(F.lit(current_year), F.col("oldest_year")) - F.col("oldest_year") + 1))


def trend(branches: DataFrame, shares: tuple[float, float, float, float] = (0.30, 0.25, 0.25, 0.20)) -> DataFrame:
    """Adds branch_trend_score and branch_trend_rank. branches: grp, structural, semantic, recent, velocity."""
    parts = [minmax(F.col("structural")), minmax(F.col("semantic")), minmax(F.col("recent")), minmax(F.log1p("velocity"))]
    out = branches.withColumn("branch_trend_score", F.round(sum((w * p for w, p in zip(shares, parts, strict=True)), F.lit(0.0)), 6))
    return out.withColumn("branch_trend_rank", F.row_number().over(W.orderBy(F.col("branch_trend_score").desc(), "grp")))


def recent_activity(year: Column, current_year: int, years: int = 7) -> Column:
    """1 in the current year, falling to 0 over the window; a missing year counts as the current one."""
    old = F.greatest(F.lit(current_year) - F.coalesce(year, F.lit(current_year)), F.lit(0))
    return F.greatest(F.lit(0.0), 1.0 - old / float(max(years, 1)))


def emergence(
    branches: DataFrame, shares: tuple[float, float, float, float, float] = (0.35, 0.25, 0.25, 0.15, 0.0), min_coherence: float = 0.05, min_share: float = 0.25, min_growth: float = 0.0
) -> DataFrame:
    """Adds the five dimension scores, branch_emergence_score, its rank and branch_emergence_type.

    branches: grp, recent_share, recent_growth, mean_year, semantic, density, active_share, velocity,
    citations, trunk_score, concentration, firm_share, impact, novelty.
    """
    m = lambda c: minmax(c if isinstance(c, Column) else F.coalesce(F.col(c).cast("double"), F.lit(0.0)))
    out = branches.withColumns({
        "novelty_growth": 0.40 * m("recent_share") + 0.40 * m("recent_growth") + 0.20 * m("mean_year"),
        "persistence": 0.50 * m("semantic") + 0.25 * m("density") + 0.25 * m("active_share"),
        "scientific_impact": 0.40 * m(F.log1p("velocity")) + 0.30 * m(F.log1p("citations")) + 0.30 * m("trunk_score"),
        "uncertainty_reduction": 0.40 * m("concentration") + 0.40 * m("firm_share") + 0.20 * m("impact"),
        "reference_novelty_score": m("novelty"),
    })
    dims = ("novelty_growth", "persistence", "scientific_impact", "uncertainty_reduction", "reference_novelty_score")
    out = out.withColumns({d: F.round(d, 6) for d in dims})
    out = out.withColumn("branch_emergence_score", F.round(sum((w * F.col(d) for w, d in zip(shares, dims, strict=True)), F.lit(0.0)), 6))
    c = F.col
    coherent = c("semantic") >= min_coherence
    kind = (
        F.when((c("novelty_growth") >= 0.65) & ~coherent, "active_but_heterogeneous_candidate")
        .when((c("branch_emergence_score") >= 0.65) & (c("novelty_growth") >= 0.45) & (c("persistence") >= 0.45) & coherent & (c("recent_share") >= min_share) & (c("recent_growth") >= min_growth), "emerging_research_direction")
        .when((c("recent_share") <= 0.20) & (c("density") >= 0.15) & (c("semantic") >= 0.04), "mature_niche_or_specialized_domain")
        .when((c("novelty_growth") >= 0.65) & (c("persistence") < 0.35), "active_but_heterogeneous_candidate")
        .when((c("scientific_impact") >= 0.65) & (c("novelty_growth") < 0.45), "established_structural_trajectory")
        .otherwise("weak_or_preliminary_candidate")
    )
    out = out.withColumn("branch_emergence_type", kind)
    return out.withColumn("branch_emergence_rank", F.row_number().over(W.orderBy(c("branch_emergence_score").desc(), "grp")))


def member_roles(
    members: DataFrame, topic_terms: Sequence[str], current_year: int, recent_years: int = 5, min_tokens: int = 4, shares: tuple[float, float, float] = (0.5, 0.3, 0.2), core_score: float = 0.55, min_similarity: float = 0.03
) -> DataFrame:
    """Adds metadata_quality, branch_core_score and branch_member_role.

    members: grp, id, year, title, abstract, journal, source_title, token_count, similarity,
    trunk_score, confidence.
    """
    blank = lambda c: trim_ws(F.coalesce(F.col(c), F.lit(""))) == ""
    text = lambda *cs: F.concat_ws(" ", *(F.coalesce(F.col(c), F.lit("")) for c in cs))
    low = F.coalesce("token_count", F.lit(0)) < min_tokens
    weak = blank("title") | low
    old = F.lit(current_year) - F.col("year")
    out = members.withColumn("metadata_quality", F.when(weak, "weak").when(blank("abstract"), "title_only").otherwise("complete"))
    grp = W.partitionBy("grp")
    out = out.withColumn("semantic_local", minmax(F.col("similarity"), grp)).withColumn("recency", F.coalesce(((old >= 0) & (old <= recent_years - 1)).cast("double"), F.lit(0.0)))
    out = out.withColumn("trunk_local", minmax(F.coalesce(F.col("trunk_score").cast("double"), F.lit(0.0)), grp))
    out = out.withColumn("branch_core_score", F.round(shares[0] * F.col("semantic_local") + shares[1] * F.col("recency") + shares[2] * F.col("trunk_local"), 6))
    place = text("title", "journal", "source_title")
    topical = contains_any(text("title", "abstract", "journal", "source_title"), topic_terms)
    fits = F.col("similarity") >= min_similarity
    core = topical & (
        ((F.col("branch_core_score") >= core_score) & fits) | ((F.col("semantic_local") >= 0.50) & fits) | ((F.col("similarity") >= 0.20) & (F.col("branch_core_score") >= 0.20)) | (F.coalesce(F.col("confidence").isin("strong", "moderate"), F.lit(False)) & fits)
    )
    role = F.when(weak, "missing_metadata").when(contains_any(place, NON_SCHOLARLY_TERMS) | contains_any(place, METHOD_TERMS), "background_methodological").when(core, "core").otherwise("peripheral")
    return out.withColumn("branch_member_role", role)


def summarize_roles(roles: DataFrame) -> DataFrame:
    role = F.col("branch_member_role")
    kinds = {f"{k}_count": F.count_if(role == k) for k in ("core", "peripheral", "background_methodological", "missing_metadata")}
    return roles.groupBy("grp").agg(
        F.count(F.lit(1)).alias("paper_count"), *(c.alias(n) for n, c in kinds.items()), F.round(F.avg((role == "core").cast("int")), 6).alias("core_share"), F.round(F.avg("branch_core_score"), 6).alias("mean_core_score"),
        joined(F.collect_list(F.when(role == "core", F.struct(F.col("id").alias("v"))))).alias("core_ids"),
    )


# --- reference novelty ---------------------------------------------------------------------------


def windowed_references(edges: DataFrame, years: DataFrame, window: int | None = 10, include_missing: bool = True) -> DataFrame:
    """(src, dst) kept as references: cited at most ``window`` years before; years (id, year) null where unknown."""
    rows = edges.join(years.select(F.col("id").alias("src"), F.col("year").alias("sy")), "src", "left").join(years.select(F.col("id").alias("dst"), F.col("year").alias("dy")), "dst", "left")
    if window is None:
        return rows.select("src", "dst")
    inside = F.col("dy").between(F.col("sy") - window, F.col("sy"))
    return rows.filter(F.col("sy").isNull() | F.coalesce(inside, F.lit(include_missing))).select("src", "dst")


#: A reference that more papers cite is hot: its citers meet in blocks of about so many.
HOT_CITERS = 4096


def _shared_by_blocks(own: DataFrame, other: DataFrame, hot: DataFrame, fits: Column, block: int) -> DataFrame:
    """(id, cand) for each hot reference that both cite. hot: dst, n. Citing papers of a year, and focal papers, are cut
    into blocks of about ``block``; every pair of blocks within the window is a key of its own, so no task holds more than one."""
    rows = other.join(hot.select("dst"), "dst", "left_semi").withColumn("y", F.coalesce("cy", F.lit(-1)))
    keys = rows.groupBy("dst", "y").agg(F.max("cy").alias("cy"), F.ceil(F.count(F.lit(1)) / block).cast("int").alias("cn"))
    keys = stored(keys.join(hot.select("dst", F.ceil(F.col("n") / block).cast("int").alias("own_n")), "dst"), "blocks")
    every = lambda n, name: F.explode(F.sequence(F.lit(0), F.col(n) - 1)).alias(name)
    place = lambda c, n, name: F.pmod(F.xxhash64(c), F.col(n)).cast("int").alias(name)
    left = own.join(keys, "dst").filter(F.col("fy").isNull() | F.coalesce(fits, F.lit(False))).select("id", "dst", "y", place("id", "own_n", "x"), every("cn", "z"))
    right = rows.drop("cy").join(keys, ["dst", "y"]).select("cand", "dst", "y", place("cand", "cn", "z"), every("own_n", "x"))
    return left.join(right, ["dst", "y", "x", "z"]).filter("id <> cand").select("id", "cand")


def _overlaps(own: DataFrame, other: DataFrame, sizes: DataFrame, refs: DataFrame, fits: Column) -> DataFrame:
    """(id, candidate_count, overlap) of papers that share a reference, without a row for each two of them.

    Were every candidate to share one reference only, a paper's count and sum over them would follow from how many citers of each size
    and year its references have. Only pairs of papers that share two or more, which are found by their pairs of references, are
    joined, and what the first sums hold too much or too little of them is made good.
    """
    size = lambda c, n: sizes.select(F.col("src").alias(c), F.col("size").alias(n))
    kinds = other.join(size("cand", "nb"), "cand").groupBy("dst", "cy", "nb").agg(F.count(F.lit(1)).alias("m"))
    met = own.join(kinds, "dst").filter(F.col("fy").isNull() | F.coalesce(fits, F.lit(False)))
    once = met.groupBy("id", "dst", "nb").agg(F.sum("m").alias("m"), F.first("fy").alias("fy")).join(size("id", "na"), "id")
    one = 1 / (F.col("na") + F.col("nb") - 1)
    itself = F.when(F.col("fy").isNull() & (F.col("na") == F.col("nb")), 1).otherwise(0)  # with a year, a paper isn't earlier than itself
    first = once.groupBy("id").agg(F.sum(F.col("m") - itself).alias("n"), F.sum((F.col("m") - itself) * one).alias("total"))

    twos = refs.select("src", F.col("dst").alias("d")).join(refs.select("src", F.col("dst").alias("e")), "src").filter("d < e").select("src", "d", "e")
    common = stored(twos.groupBy("d", "e").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("d", "e"), "common")
    members = stored(twos.join(common, ["d", "e"], "left_semi"), "members")
    both = members.withColumnRenamed("src", "id").join(members.withColumnRenamed("src", "cand"), ["d", "e"]).filter("id <> cand")
    pairs = both.groupBy("id", "cand").agg(F.count(F.lit(1)).alias("c"))
    pairs = pairs.select("id", "cand", F.rint((1 + F.sqrt(1 + 8 * F.col("c"))) / 2).cast("long").alias("s"))  # s references make s (s - 1) / 2 pairs
    years = lambda rows, c, y: rows.select(c, y).distinct()
    pairs = pairs.join(years(own, "id", "fy"), "id").join(years(other, "cand", "cy"), "cand").filter(F.col("fy").isNull() | F.coalesce(fits, F.lit(False)))
    pairs = pairs.join(size("id", "na"), "id").join(size("cand", "nb"), "cand")
    more = F.col("s") / (F.col("na") + F.col("nb") - F.col("s")) - F.col("s") * one
    rows = first.unionByName(pairs.select("id", (1 - F.col("s")).alias("n"), more.alias("total")))
    found = rows.groupBy("id").agg(F.sum("n").alias("candidate_count"), F.sum("total").alias("total")).filter("candidate_count > 0")
    return found.select("id", "candidate_count", (F.col("total") / F.col("candidate_count")).alias("overlap"))


def _met(own: DataFrame, other: DataFrame, sizes: DataFrame, citers: DataFrame, fits: Column, min_shared: int, hot_citers: int) -> DataFrame:
    """(id, candidate_count, overlap) by a row for each two papers and each reference that they share."""
    hot = stored(citers.filter(F.col("n") > hot_citers), "hot")  # one row for each hot_citers edges at most
    blocked = None if hot.isEmpty() else _shared_by_blocks(own, other, hot, fits, hot_citers)
    cold = own if blocked is None else own.join(hot, "dst", "left_anti")
    both = cold.join(other, "dst").filter((F.col("id") != F.col("cand")) & (F.col("fy").isNull() | F.coalesce(fits, F.lit(False)))).select("id", "cand")
    shared = (both if blocked is None else both.unionByName(blocked)).groupBy("id", "cand").agg(F.count(F.lit(1)).alias("shared")).filter(F.col("shared") >= min_shared)
    shared = shared.join(sizes.select(F.col("src").alias("id"), F.col("size").alias("na")), "id").join(sizes.select(F.col("src").alias("cand"), F.col("size").alias("nb")), "cand")
    return shared.groupBy("id").agg(F.count(F.lit(1)).alias("candidate_count"), F.avg(F.col("shared") / (F.col("na") + F.col("nb") - F.col("shared"))).alias("overlap"))


def reference_novelty(focal: DataFrame, references: DataFrame, years: DataFrame, co_citing_window: int | None = 10, min_shared: int = 1, min_candidates: int = 3, hot_citers: int = HOT_CITERS) -> DataFrame:
    """id, reference_count, candidate_count, mean_overlap, reference_novelty, supported for each focal paper (id).

    Candidates are earlier papers, at most co_citing_window years, that share min_shared references;
    novelty is 1 minus the mean Jaccard overlap with them. Pairs of references within papers, and pairs of papers at references, are
    counted first. If there are fewer of the former, no row for each pair of papers is made (see _overlaps); else, or if more than one
    reference has to be shared, candidates come by an equi-join on the shared reference with the years as a further condition, and for
    references of more than hot_citers citers by one on pairs of blocks of them. Distinct references of numbers are taken as they are.
    """
    numbers = references.schema["src"].dataType.typeName() == "long"
    if numbers:
        refs, year = references, years.withColumnRenamed("id", "n").select("n", "year")
    else:
        ids, refs = graph.numbered(references)  # pairs of papers are many, and numbers are short
        year = years.join(ids, "id").select("n", "year")
        plain, focal = focal, focal.join(ids, "id").select(F.col("n").alias("id"))
    sizes = stored(refs.groupBy("src").agg(F.count(F.lit(1)).alias("size")), "sizes")
    own = refs.join(focal.select(F.col("id").alias("src")), "src").join(year.select(F.col("n").alias("src"), F.col("year").alias("fy")), "src", "left").select(F.col("src").alias("id"), "dst", "fy")
    other = refs.join(year.select(F.col("n").alias("src"), F.col("year").alias("cy")), "src", "left").select(F.col("src").alias("cand"), "dst", "cy")
    fits = (F.col("cy") < F.col("fy")) & (F.lit(True) if co_citing_window is None else F.col("cy") >= F.col("fy") - co_citing_window)
    citers = refs.groupBy("dst").agg(F.count(F.lit(1)).alias("n"))
    square = lambda c: F.sum(F.col(c).cast("double") * F.col(c) / 2)
    within, across = sizes.agg(square("size")).first()[0] or 0, citers.agg(square("n")).first()[0] or 0
    if min_shared == 1 and within < across:
        found = _overlaps(own, other, sizes, refs, fits)
    else:
        found = _met(own, other, sizes, citers, fits, min_shared, hot_citers)
    facts = sizes.withColumnRenamed("src", "id").join(found, "id", "left")
    if not numbers:
        facts, focal = facts.withColumnRenamed("id", "n").join(ids, "n").drop("n"), plain
    out = focal.select("id").join(facts, "id", "left")
    n = F.coalesce("candidate_count", F.lit(0))
    return out.select("id", F.coalesce("size", F.lit(0)).alias("reference_count"), n.alias("candidate_count"), F.round(F.col("overlap") + TIE, 6).alias("mean_overlap"), F.round(1 - F.col("overlap") + TIE, 6).alias("reference_novelty"), (n >= min_candidates).alias("supported"))


def novelty_summary(novelty: DataFrame, current_year: int, recent_years: int = 5, high: float = 0.80) -> DataFrame:
    """Per grp: counts and mean, median, max and recent mean of the supported papers' novelty, with min-max score. novelty: grp, year, reference_novelty, supported."""
    good = F.col("supported") & F.col("reference_novelty").isNotNull()
    v = F.when(good, F.col("reference_novelty"))
    recent = F.when(F.col("year") >= current_year - recent_years + 1, v)
    zero = lambda c: F.round(F.coalesce(c, F.lit(0.0)), 6)
    out = novelty.groupBy("grp").agg(
        F.count(F.lit(1)).alias("paper_count"), F.count_if(good).alias("supported_count"), zero(F.avg(v)).alias("mean_novelty"), zero(F.median(v)).alias("median_novelty"),
        zero(F.max(v)).alias("max_novelty"), zero(F.avg(recent)).alias("recent_mean_novelty"), zero(F.avg((v >= high).cast("int"))).alias("high_share"),
    )
    out = out.withColumn("novelty_score", F.round(minmax(F.col("recent_mean_novelty")), 6)).withColumn("support_share", F.round(F.col("supported_count") / F.greatest("paper_count", F.lit(1)), 6))
    return out.withColumn("effective_score", F.round(F.col("novelty_score") * F.col("support_share"), 6)).withColumn("novelty_rank", F.row_number().over(W.orderBy(F.col("novelty_score").desc(), "grp")))


# --- fruits --------------------------------------------------------------------------------------


def fruit_scores(candidates: DataFrame, current_year: int, shares: tuple[float, float, float, float] = (0.35, 0.35, 0.20, 0.10)) -> DataFrame:
    """Adds external_velocity, attention_gap, proximity, fruit_score and fruit_signal_type.

    candidates: id, year, cited_by, in_degree, in_graph, distance (null if beyond reach),
    field_neighbors, text_relevance.
    """
    total = sum(shares)
    out = candidates.withColumn("external_velocity", F.col("cited_by") / age(F.col("year"), current_year))
    log = lambda c: F.log1p(F.col(c).cast("double"))
    out = scaled(out, _outside=log("cited_by"), _inside=log("in_degree"), _velocity=log("external_velocity"), _neighbors=log("field_neighbors"), _text=F.col("text_relevance"))
    out = scaled(out, attention_gap=F.greatest(F.lit(0.0), F.col("_outside") - F.col("_inside")))
    near = F.coalesce(1.0 / (1.0 + F.col("distance")), F.lit(0.0))
    out = out.withColumn("proximity", 0.65 * near + 0.35 * F.col("_neighbors"))
    parts = [F.col(c) for c in ("_velocity", "attention_gap", "proximity", "_text")]
    out = out.withColumn("fruit_score", sum((w / total * p for w, p in zip(shares, parts, strict=True)), F.lit(0.0)))
    out = out.drop("_outside", "_inside", "_velocity", "_neighbors", "_text")
    kind = (
        F.when(F.col("cited_by") <= 0, "recent_no_external_signal")
        .when(~F.col("in_graph"), "external_signal_not_matched_in_graph")
        .when((F.col("in_degree") <= 1) & (F.col("attention_gap") >= 0.40), "external_fruit_underabsorbed")
        .when((F.col("in_degree") >= 5) & (F.col("attention_gap") <= 0.15), "already_absorbing_into_tree")
        .otherwise("fruit_candidate")
    )
    return out.withColumn("fruit_signal_type", kind)


def top_fruits(fruits: DataFrame, n: int = 3, low: float = 20.0, high: float = 34.0) -> DataFrame:
    """The n best, underabsorbed first, with radius and colour; the radius scale is capped at the second greatest velocity."""
    order = [(F.col("fruit_signal_type") == "external_fruit_underabsorbed").desc(), F.col("fruit_score").desc(), F.col("external_velocity").desc(), "id"]
    out = fruits.orderBy(*order).limit(n)
    w = W.partitionBy()
    least = F.min("external_velocity").over(w)
    second = F.coalesce(F.element_at(F.sort_array(F.collect_list("external_velocity").over(w), asc=False), 2) if n > 1 else F.max("external_velocity").over(w), least)
    ranked = out.withColumn("_low", least).withColumn("_cap", F.when(F.count(F.lit(1)).over(w) > 1, second).otherwise(F.max("external_velocity").over(w)))
    same = F.abs(F.col("_cap") - F.col("_low")) <= 1e-9 * F.greatest(F.abs("_cap"), F.abs("_low"))
    score = F.when(same, 1.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.col("external_velocity") - F.col("_low")) / F.nullif(F.col("_cap") - F.col("_low"), F.lit(0.0)))))
    ranked = ranked.withColumn("radius", low + score * (high - low)).withColumn("color", mixed_color(minmax(F.col("fruit_score")), FRUIT_REDS))
    return ranked.drop("_low", "_cap")
