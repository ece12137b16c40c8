"""Citation-graph operators over edges (src, dst): DataFrame loops whose rounds end in stored tables.

An edge points from the citing to the cited node. No operator brings nodes or edges to the driver.
The loops work on whole numbers: string ids are numbered once, in their order, so that the smallest
number is the smallest id, and edges of numbers are taken as they are.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable
from functools import reduce
from itertools import accumulate, count

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import forget, stored

BIG = "decimal(38,0)"  # path counts grow exponentially; an overflow raises


def build_edges(citations: DataFrame, src: str = "SR", dst: str = "SR_ref") -> DataFrame:
    """Distinct (src, dst) of a citation table; rows with a missing end go."""
    return citations.select(F.col(src).alias("src"), F.col(dst).alias("dst")).filter("src IS NOT NULL AND dst IS NOT NULL").distinct()


def drop_self_loops(edges: DataFrame) -> DataFrame:
    return edges.filter("src <> dst")


def vertices(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()


def degrees(edges: DataFrame) -> DataFrame:
    """id, in_degree, out_degree of every node of the edges: one aggregation over both ends."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("src").alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o")), F.struct(F.col("dst").alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o")))).alias("e"))
    return ends.groupBy("e.id").agg(F.sum("e.i").alias("in_degree"), F.sum("e.o").alias("out_degree"))


def undirected(edges: DataFrame) -> DataFrame:
    """Each pair of linked nodes once, as (a, b) with a < b."""
    return edges.filter("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()


def numbered(edges: DataFrame, nodes: DataFrame | None = None, *others: str) -> tuple[DataFrame, DataFrame]:
    """(ids, edges): ids has id and n, numbers that grow with the id; the edges' src and dst are numbers. nodes (id) adds nodes; the edges keep their columns ``others``."""
    every = vertices(edges) if nodes is None else nodes.select("id").unionByName(vertices(edges)).distinct()
    ids = stored(every.repartitionByRange("id").sortWithinPartitions("id").select("id", F.monotonically_increasing_id().alias("n")), "ids")
    out = edges.join(ids.select(F.col("id").alias("src"), F.col("n").alias("s")), "src").join(ids.select(F.col("id").alias("dst"), F.col("n").alias("d")), "dst")
    return ids, stored(out.select(F.col("s").alias("src"), F.col("d").alias("dst"), *others), "edges")


def _named(rows: DataFrame, ids: DataFrame, *columns: str) -> DataFrame:
    """rows with the ids in place of the numbers in columns."""
    for c in columns:
        rows = rows.join(ids.select(F.col("n").alias(c), F.col("id").alias("_name")), c).withColumn(c, F.col("_name")).drop("_name")
    return rows


def _are_numbers(edges: DataFrame) -> bool:
    return edges.schema["src"].dataType.typeName() == "long"


def _trees(pairs: DataFrame) -> DataFrame:
    """(v, p) for every node of pairs (a, b): the root of the tree in which each node hangs on its smallest neighbour, if smaller."""
    both = pairs.select(F.col("a").alias("v"), F.col("b").alias("w")).unionByName(pairs.select(F.col("b").alias("v"), F.col("a").alias("w")))
    parent = stored(both.groupBy("v").agg(F.min("w").alias("w")).select("v", F.least("v", "w").alias("p")), "parents")
    while True:  # pointers double in length, so a path of length n takes log n rounds
        up = parent.select(F.col("v").alias("p"), F.col("p").alias("far"))
        step = stored(parent.join(up, "p", "left").select("v", F.col("p").alias("was"), F.coalesce("far", "p").alias("p")), "parents")
        forget(parent)
        parent = step
        if step.filter("was <> p").isEmpty():
            return parent


def components(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """Weakly connected components: (id, component), the component being its smallest id.

    By contraction: every node hangs on its smallest neighbour, trees become single nodes, and the
    distinct edges between them are all that the next round sees, at most half as many nodes. nodes
    (id) adds nodes that no edge touches.
    """
    if not _are_numbers(edges):
        ids, links = numbered(edges, nodes)
        return _named(components(links, ids.select(F.col("n").alias("id"))), ids, "id", "component")
    given = edges if hasattr(edges, "_stored_at") else stored(edges.select("src", "dst"), "pairs")
    left, rounds = given.select(F.col("src").alias("a"), F.col("dst").alias("b")), []
    while not left.isEmpty():
        tree = _trees(left)
        rounds.append(tree)
        a, b = tree.select(F.col("v").alias("a"), F.col("p").alias("x")), tree.select(F.col("v").alias("b"), F.col("p").alias("y"))
        between = left.join(a, "a").join(b, "b").filter("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
        was, left = left, stored(between, "pairs")
        if len(rounds) > 1:
            forget(was)
    every = rounds[0].select(F.col("v").alias("id")) if rounds else vertices(edges)  # the first trees hold every node
    every = every if nodes is None else nodes.select("id").unionByName(every).distinct()
    out = every.withColumn("component", F.col("id"))
    if nodes is None and rounds:
        out, rounds = rounds[0].select(F.col("v").alias("id"), F.col("p").alias("component")), rounds[1:]
    for tree in rounds:  # later rounds are small
        out = out.join(tree.select(F.col("v").alias("component"), "p"), "component", "left").select("id", F.coalesce("p", "component").alias("component"))
    return out


def giant_component(edges: DataFrame, name: Callable[[Column], Column] | None = None) -> DataFrame:
    """Edges of the largest component; of equal ones that with the smallest id, or the smallest ``name`` of one."""
    edges = edges if hasattr(edges, "_stored_at") else stored(edges, "edges")
    labels = stored(components(edges), "components")
    sizes = stored(labels.groupBy("component").count(), "sizes")
    most = sizes.agg(F.max("count")).first()[0]
    top = sizes.filter(F.col("count") == F.lit(most)).select("component")
    if name is not None and top.count() > 1:
        top = labels.join(top, "component").groupBy("component").agg(F.min(name(F.col("id"))).alias("first")).orderBy("first").limit(1).select("component")
    top = top.orderBy("component").limit(1)
    # what lies outside is mostly little, and a small stored table is broadcast
    outside = stored(labels.join(F.broadcast(top), "component", "left_anti").select(F.col("id").alias("src")), "outside")
    return edges.join(outside, "src", "left_anti")


def prune_terminal(edges: DataFrame) -> DataFrame:
    """Without the nodes cited once that cite nothing; one pass, by the degrees before it."""
    ends = stored(degrees(edges).filter("in_degree = 1 AND out_degree = 0").select(F.col("id").alias("dst")), "ends")
    return edges.join(ends, "dst", "left_anti").select("src", "dst")


#: Tables that a loop only adds to are folded into one when so many have come together.
FOLD = 16


def _union(tables: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, tables)


def _folded(tables: list[DataFrame], by: Callable[[DataFrame], DataFrame] | None = None) -> list[DataFrame]:
    """tables, or if there are FOLD of them, one that holds them all (aggregated by ``by``)."""
    if len(tables) < FOLD:
        return tables
    whole = _union(tables)
    out = stored(by(whole) if by else whole, "folded")
    forget(*tables)
    return [out]


def _within(rows: DataFrame, column: str, ids: DataFrame) -> DataFrame | None:
    """rows whose column lies between the smallest and the largest of ids (id); none if there are no ids. A round's ids are often of one kind, and kinds are ranges of numbers."""
    low, high = ids.agg(F.min("id"), F.max("id")).first()
    return None if low is None else rows.filter(F.col(column).between(low, high))


#: Trimming goes on for so many rounds; of what it leaves, chains are taken out first.
TRIMMED = 6


def _trim(left: DataFrame, rounds: int | None = None) -> DataFrame:
    """Edges without the nodes that have no predecessor or no successor, again and again until all have both, or for so many rounds.

    By a work list: degrees are counted once; a round reads the edges of the nodes that went in the last one (those out of a node
    without predecessor, those into one without successor: it has no others), writes down how many each neighbour loses, and takes
    those out of which none is left. Edges are written once, at the end, so what is written grows with the edges, whatever the number of layers.
    """
    degree = stored(degrees(left), "degrees")
    gone = stored(degree.filter("in_degree = 0 OR out_degree = 0").select("id", (F.col("in_degree") == 0).alias("first")), "gone")
    n_gone, n = gone.count(), degree.count()
    if not n_gone:
        forget(degree, gone)
        return left
    removed, losses, none = [gone], [], F.lit(0).cast("long")
    total = lambda rows: rows.groupBy("id").agg(F.sum("i").alias("i"), F.sum("o").alias("o"))
    for k in count():
        if n_gone == n or k == rounds or gone.isEmpty():  # of all nodes nothing is left to lose
            break
        first, last = gone.filter("first").select("id"), gone.filter("NOT first").select("id")
        below, above = _within(left, "src", first), _within(left, "dst", last)
        parts = []
        if below is not None:
            parts.append(below.join(first.withColumnRenamed("id", "src"), "src").select(F.col("dst").alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o")))
        if above is not None:
            parts.append(above.join(last.withColumnRenamed("id", "dst"), "dst").select(F.col("src").alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o")))
        loss = stored(total(_union(parts)), "loss")
        touched = loss.withColumnsRenamed({"i": "now_i", "o": "now_o"}).join(degree, "id")
        if losses:
            touched = touched.join(total(_union(losses).join(loss.select("id"), "id", "left_semi")), "id", "left")
        else:
            touched = touched.withColumns({"i": none, "o": none})
        i, o = F.col("in_degree") - F.coalesce("i", none), F.col("out_degree") - F.coalesce("o", none)
        here = (i > 0) & (o > 0)  # before this round; what went earlier is touched again, but doesn't go again
        gone = stored(touched.filter(here & ((i == F.col("now_i")) | (o == F.col("now_o")))).select("id", (i == F.col("now_i")).alias("first")), "gone")
        losses, removed = _folded([*losses, loss], total), [*_folded(removed), gone]
        n_gone += gone.count()
    if n_gone == n:
        out = left.limit(0)
    else:
        lost = stored(_union(removed).select("id"), "removed")
        out = left.join(lost.withColumnRenamed("id", "src"), "src", "left_anti").join(lost.withColumnRenamed("id", "dst"), "dst", "left_anti").select("src", "dst")
        out = stored(out, "left")
        forget(lost)
    forget(degree, *losses, *removed)
    return out


def _without_inner_chains(links: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """links without the nodes that have one link in and one out: each chain of them is a link from what leads in to where it leads.

    Also parts (id, component), the chains, and ways (component, src, dst), their ends; a component without one is a ring.
    """
    ends = _ends(links.select(F.col("src").alias("p"), F.col("dst").alias("r")))
    chain = stored(ends.filter("i = 1 AND o = 1").select("id"), "chain")
    of = lambda c: chain.select(F.col("id").alias(c), F.lit(True).alias(f"{c}_in"))
    told = links.join(of("src"), "src", "left").join(of("dst"), "dst", "left")
    told = stored(told.select("src", "dst", F.coalesce("src_in", F.lit(False)).alias("src_in"), F.coalesce("dst_in", F.lit(False)).alias("dst_in")), "told")
    parts = stored(components(told.filter("src_in AND dst_in").select("src", "dst"), chain), "parts")
    at = lambda c: parts.select(F.col("id").alias(c), "component")
    into = told.filter("dst_in AND NOT src_in").join(at("dst"), "dst").select("component", "src")
    on = told.filter("src_in AND NOT dst_in").join(at("src"), "src").select("component", "dst")
    ways = stored(into.join(on, "component").select("component", "src", "dst"), "ways")
    few = told.filter("NOT src_in AND NOT dst_in").select("src", "dst").unionByName(ways.select("src", "dst").filter("src <> dst")).distinct()
    few = stored(few, "links")
    forget(chain, told)
    return few, parts, ways


def _with_inner_chains(found: DataFrame, parts: DataFrame, ways: DataFrame) -> DataFrame:
    """found (id, scc) with what the taken chains add: a chain belongs to its ends' component if that is the same, or with an end that is both; a ring is one of its own."""
    at = lambda c: found.select(F.col("id").alias(c), F.col("scc").alias(f"{c}_scc"))
    same = F.when(F.col("src") == F.col("dst"), F.coalesce("src_scc", "src")).when(F.col("src_scc") == F.col("dst_scc"), F.col("src_scc"))
    told = stored(ways.join(at("src"), "src", "left").join(at("dst"), "dst", "left").select("component", "src", "src_scc", same.alias("scc")).filter("scc IS NOT NULL"), "told")
    rings = parts.join(ways.select("component"), "component", "left_anti").select("id", F.col("component").alias("scc"))
    inner = parts.join(told.select("component", "scc"), "component").select("id", "scc")
    turns = told.filter("src_scc IS NULL").select(F.col("src").alias("id"), "scc").distinct()
    return stored(_union([found.select("id", "scc"), rings, inner, turns]), "scc")


#: Weakly connected parts of up to so many links, counted first, are searched for cycles by one task each.
TASK_LINKS = 200_000


def _one_way(links: DataFrame) -> bool:
    """Whether all links lead to smaller numbers, or all to larger ones; then there is no cycle."""
    down, up = links.agg(F.max(F.col("src") > F.col("dst")), F.max(F.col("src") < F.col("dst"))).first()
    return not (down and up)


def _searched(table: pa.Table) -> pa.Table:
    """(id, scc) of the strongly connected components of two or more nodes among one part's links, by one depth-first search."""
    near: dict[int, list[int]] = defaultdict(list)
    for a, b in zip(table.column("src").to_pylist(), table.column("dst").to_pylist(), strict=True):
        near[a].append(b)
    place: dict[int, int] = {}
    low: dict[int, int] = {}
    path: list[int] = []
    closed: set[int] = set()
    found: list[tuple[int, int]] = []
    for start in list(near):
        work = [] if start in place else [(start, iter(near[start]))]
        while work:
            v, rest = work[-1]
            if v not in place:
                place[v] = low[v] = len(place)
                path.append(v)
            for w in rest:
                if w not in place:
                    work.append((w, iter(near.get(w, ()))))
                    break
                if w not in closed:
                    low[v] = min(low[v], place[w])
            else:
                work.pop()
                if work:
                    u = work[-1][0]
                    low[u] = min(low[u], low[v])
                if low[v] == place[v]:
                    at = len(path) - 1
                    while path[at] != v:
                        at -= 1
                    members = path[at:]
                    del path[at:]
                    closed.update(members)
                    if len(members) > 1:
                        last = max(members)
                        found += [(m, last) for m in members]
    return pa.table([pa.array([x for x, _ in found], pa.int64()), pa.array([x for _, x in found], pa.int64())], ["id", "scc"])


def strong_components(edges: DataFrame, task_links: int = TASK_LINKS) -> DataFrame:
    """Strongly connected components of two or more nodes: (id, scc), the scc named by its largest id.

    Links that all lead to smaller numbers have none. Weakly connected parts of up to ``task_links`` links are one task's work each;
    larger ones go by rounds (see _by_rounds), to the same result.
    """
    if not _are_numbers(edges):
        ids, links = numbered(edges)
        return _named(strong_components(links, task_links), ids, "id", "scc")
    links = edges.filter("src <> dst").select("src", "dst")
    empty = vertices(edges.limit(0)).select("id", F.col("id").alias("scc"))
    if _one_way(links):
        return empty
    if not task_links:
        return _by_rounds(links, empty)
    links = stored(links, "links")
    parts = components(links)
    told = stored(links.join(parts.withColumnRenamed("id", "src"), "src"), "told")
    large = stored(told.groupBy("component").count().filter(F.col("count") > task_links).select("component"), "large")
    found = told.join(large, "component", "left_anti").groupBy("component").applyInArrow(_searched, "id long, scc long")
    if large.isEmpty():
        return found
    rest = stored(told.join(large, "component", "left_semi").select("src", "dst"), "links")
    return found.unionByName(_by_rounds(rest, empty))


def _by_rounds(links: DataFrame, empty: DataFrame) -> DataFrame:
    """strong_components of links of any number.

    Nodes without a predecessor or a successor are alone, and are trimmed again and again; chains of nodes with one link in and one
    out become single links, as long as that takes a quarter of the links, so that a long way isn't gone step by step. On what is left
    every node takes the largest id that reaches it; the nodes of one colour from which its id is reached back are one component, and go.
    """
    left = _trim(links, TRIMMED)
    if left.isEmpty():
        return empty
    left, waits = stored(left.distinct(), "left"), []
    n = left.count()
    while n:
        few, *wait = _without_inner_chains(left)
        waits.append(wait)
        left = _trim(few, TRIMMED)
        was, n = n, left.count()
        if n > 0.75 * was:
            break
    found = _colored(_trim(left)) if n else empty
    for parts, ways in reversed(waits):
        found = _with_inner_chains(found, parts, ways)
    last = found.groupBy("scc").agg(F.max("id").alias("last"))
    return found.join(last, "scc").select("id", F.col("last").alias("scc"))


def _colored(left: DataFrame) -> DataFrame:
    """strong_components by colours alone, of a stored graph whose nodes have predecessors and successors; components may have any of their ids as name."""
    found, empty = None, vertices(left.limit(0)).select("id", F.col("id").alias("scc"))
    while not left.isEmpty():
        colors = last = stored(vertices(left).select("id", F.col("id").alias("color")), "colors")
        while True:
            heard = left.join(colors.withColumnRenamed("id", "src"), "src").groupBy(F.col("dst").alias("id")).agg(F.max("color").alias("heard"))
            step = stored(colors.join(heard, "id", "left").select("id", F.col("color").alias("was"), F.greatest("color", F.coalesce("heard", "color")).alias("color")), "colors")
            forget(last)
            last, colors = step, step.select("id", "color")
            if step.filter("was <> color").isEmpty():
                break
        same = left.join(colors.withColumnRenamed("id", "src"), "src").join(colors.select(F.col("id").alias("dst"), F.col("color").alias("c2")), "dst").filter("color = c2").select("src", "dst", "color")
        same = stored(same, "same")
        frontier = stored(colors.filter("id = color"), "reached")
        parts = [frontier]
        while True:
            back = same.join(frontier.select(F.col("id").alias("dst"), "color"), ["dst", "color"]).select(F.col("src").alias("id"), "color").distinct()
            frontier = stored(back.join(_union(parts), ["id", "color"], "left_anti"), "reached")
            if frontier.isEmpty():
                break
            parts = [*_folded(parts), frontier]
        reached = stored(_union(parts), "reached")
        forget(same, last, frontier, *parts)
        groups = reached.groupBy("color").count().filter("count > 1").select("color")
        members = stored(reached.join(groups, "color").select("id", F.col("color").alias("scc")), "scc")
        found = members if found is None else found.unionByName(members)
        gone = reached.select("id")
        left = stored(left.join(gone.withColumnRenamed("id", "src"), "src", "left_anti").join(gone.withColumnRenamed("id", "dst"), "dst", "left_anti").select("src", "dst"), "left")
        forget(reached)
        left = _trim(left)
    return empty if found is None else found


def break_cycles(edges: DataFrame) -> DataFrame:
    """Without the edges inside strongly connected components of two or more nodes."""
    scc = stored(strong_components(edges), "scc")
    if scc.isEmpty():
        return edges
    out = edges.join(scc.select(F.col("id").alias("src"), F.col("scc").alias("s1")), "src", "left").join(scc.select(F.col("id").alias("dst"), F.col("scc").alias("s2")), "dst", "left")
    return out.filter("NOT coalesce(s1 = s2, false)").select("src", "dst")


def clean_graph(edges: DataFrame, name: Callable[[Column], Column] | None = None) -> DataFrame:
    """Distinct edges, no self-loops, the giant component, no terminal single-cited nodes, no cycles. name: what a number stands for, if its order isn't that of the ids."""
    distinct = stored(drop_self_loops(edges).select("src", "dst").distinct(), "edges")
    if not _are_numbers(edges):
        ids, links = numbered(distinct)
        return stored(_named(clean_graph(links), ids, "src", "dst"), "clean")
    pruned = stored(prune_terminal(giant_component(distinct, name)), "pruned")
    kept = break_cycles(pruned)
    return pruned if kept is pruned else stored(kept, "clean")


def _folded_levels(levels: list[DataFrame], values: tuple[str, ...]) -> list[DataFrame]:
    """levels, or if there are FOLD of them, their sums in one table; the newest, which the next round reads, isn't among them."""
    if len(levels) < FOLD:
        return levels
    whole = _union(levels).groupBy("id").agg(*(F.sum(v).cast(BIG).alias(v) for v in values))
    out = stored(whole, "levels")
    forget(*levels)
    return [out]


#: Path sums go by path length for so many rounds; a deeper graph is shrunk first.
PATIENCE = 32


def path_sums(edges: DataFrame, seeds: DataFrame, *values: str, backward: bool = True) -> DataFrame:
    """Sum the seeds' values over all directed paths: (id, *values), seeds included.

    backward: from each node along citations to the seeds (seeds are cited); else from the seeds on.
    edges must be free of cycles. One round per path length, each storing only its frontier. What PATIENCE rounds leave is
    the same sum from the last frontier on, over edges that are contracted first as far as they shrink (see _shrunk).
    """
    to, of = ("src", "dst") if backward else ("dst", "src")
    links = edges.select(F.col(of).alias("p"), F.col(to).alias("r"))
    level = stored(seeds.select("id", *(F.col(v).cast(BIG).alias(v) for v in values)), "level")
    done, level = _by_length(links, level, values, PATIENCE)
    if level is not None:
        few, base, late = _shrunk(stored(links.groupBy("p", "r").agg(F.count(F.lit(1)).cast(BIG).alias("m")), "links"), level, values)
        parts, _ = _by_length(few, base, values)
        rest = _sum_by_id(_union(parts), values)
        for step in reversed(late):
            rest = stored(_sum_by_id(rest.unionByName(_pushed(step, rest, values)), values), "restored")
        done.append(rest)
    return _sum_by_id(_union(done), values)


def _sum_by_id(rows: DataFrame, values: tuple[str, ...]) -> DataFrame:
    return rows.groupBy("id").agg(*(F.sum(v).cast(BIG).alias(v) for v in values))


def _times(m: Column, value: Column) -> Column:
    """m * value; an m too large for its type is null, and an error where it would count."""
    return F.when(m.isNull() & (value != 0), F.raise_error(F.lit("path counts overflow"))).otherwise((F.coalesce(m, F.lit(0).cast(BIG)) * value).cast(BIG))


def _pushed(links: DataFrame, rows: DataFrame, values: tuple[str, ...]) -> DataFrame:
    """What links (p, r, m if there are several of a kind) carry from rows (id, *values) to their receivers: (id, *values)."""
    met = links.join(rows.withColumnRenamed("id", "p"), "p")
    weighed = [_times(F.col("m"), F.col(v)).alias(v) if "m" in links.columns else v for v in values]
    return _sum_by_id(met.select(F.col("r").alias("id"), *weighed), values)


def _by_length(links: DataFrame, level: DataFrame, values: tuple[str, ...], rounds: int | None = None) -> tuple[list[DataFrame], DataFrame | None]:
    """Sums by path length: tables whose sum they are, and the frontier that isn't in them, if ``rounds`` didn't suffice."""
    levels: list[DataFrame] = []
    for _ in count() if rounds is None else range(rounds):
        near = _within(links, "p", level)
        if near is None:
            return levels, None
        nxt = stored(_pushed(near, level, values), "level")
        levels, level = [*_folded_levels(levels, values), level], nxt
    return (levels, None) if level.isEmpty() else (levels, level)


def _shrunk(links: DataFrame, base: DataFrame, values: tuple[str, ...]) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """A smaller graph with the same sums: links (p, r, m), base (id, *values), and links to apply afterwards, the last first.

    Each round takes out the nodes that nothing comes to, once they have passed on what they have; the nodes from which nothing goes on,
    whose links wait; and the chains of nodes with one link in and one out, found by doubling pointers: their ends become
    one link with a multiplier, what starts within a chain is given to its end, and their inner nodes' links to the chain's start wait. Links
    of the same ends add up, so a chain of diamonds, too, becomes a chain. It stops when a round takes less than a quarter of
    the links, so what is written grows with the links alone.
    """
    late: list[DataFrame] = []
    n = links.count()
    while n:
        ends = stored(_ends(links), "ends")
        first, last = ends.filter("i = 0").select("id"), ends.filter("i > 0 AND o = 0").select("id")
        starting = links.join(first.withColumnRenamed("id", "p"), "p", "left_semi")
        before, base = base, stored(_sum_by_id(base.unionByName(_pushed(starting, base, values)), values), "base")
        inner = links.join(first.withColumnRenamed("id", "p"), "p", "left_anti")
        late.append(stored(inner.join(last.withColumnRenamed("id", "r"), "r", "left_semi").select("p", "r", "m"), "late"))
        inner = stored(inner.join(last.withColumnRenamed("id", "r"), "r", "left_anti").select("p", "r", "m"), "links")
        forget(links, ends, before)
        chain = stored(_ends(inner).filter("i = 1 AND o = 1").select("id"), "chain")
        links, base, waits = _without_chains(inner, chain, base, values)
        late.append(waits)
        was, n = n, links.count()
        if n > 0.75 * was:
            break
    return links, base, late


def _ends(links: DataFrame) -> DataFrame:
    """id, i (links in), o (links out)."""
    one, none = F.lit(1), F.lit(0)
    rows = links.select(F.col("p").alias("id"), none.alias("i"), one.alias("o")).unionByName(links.select(F.col("r").alias("id"), one.alias("i"), none.alias("o")))
    return rows.groupBy("id").agg(F.sum("i").alias("i"), F.sum("o").alias("o"))


def _without_chains(links: DataFrame, chain: DataFrame, base: DataFrame, values: tuple[str, ...]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """links and base without the nodes of chain (id), which have one link in and one out; and the links from each one's chain's start to it."""
    own = base.join(chain, "id", "left_semi")
    # of each inner node: p, how far the pointer has come; m, the paths from there; inside, whether p is an inner node, too
    up = links.join(chain.withColumnRenamed("id", "r"), "r").select(F.col("r").alias("id"), "p", "m")
    up = up.join(own, "id", "left").join(chain.select(F.col("id").alias("p"), F.lit(True).alias("inside")), "p", "left")
    up = stored(up.select("id", "p", "m", F.coalesce("inside", F.lit(False)).alias("inside"), *values), "chains")
    while not up.filter("inside").isEmpty():
        far = up.select(F.col("id").alias("p"), F.col("p").alias("p2"), F.col("m").alias("m2"), F.col("inside").alias("inside2"), *(F.col(v).alias(f"{v}_2") for v in values))
        met = up.filter("inside").join(far, "p")
        sums = [F.coalesce(F.col(v) + _times(F.col("m"), F.col(f"{v}_2")), F.col(v), _times(F.col("m"), F.col(f"{v}_2"))).cast(BIG).alias(v) for v in values]
        step = met.select("id", F.col("p2").alias("p"), F.try_multiply("m", "m2").cast(BIG).alias("m"), F.col("inside2").alias("inside"), *sums)
        was, up = up, stored(step.unionByName(up.filter("NOT inside")), "chains")
        forget(was)
    carried = up.filter(F.col(values[0]).isNotNull()).select("id", *values)
    out = links.join(chain.withColumnRenamed("id", "r"), "r", "left_anti").select("p", "r", "m")
    through = out.join(up.select(F.col("id").alias("p"), F.col("p").alias("start"), F.col("m").alias("m2")), "p", "left")
    through = through.select(F.coalesce("start", "p").alias("p"), "r", F.when(F.col("start").isNull(), F.col("m")).otherwise(F.try_multiply("m", "m2").cast(BIG)).alias("m"))
    # a sum with a null in it, a multiplier too large, is null as well
    fewer = through.groupBy("p", "r").agg(F.when(F.count("m") == F.count(F.lit(1)), F.try_sum("m")).cast(BIG).alias("m"))
    kept = base.join(chain, "id", "left_anti").unionByName(carried)
    after = stored(_sum_by_id(kept.unionByName(_pushed(out, carried, values)), values), "base")
    result = stored(fewer, "links"), after, stored(up.select("p", F.col("id").alias("r"), "m"), "late")
    forget(links, up, base, chain)
    return result


def places(values: DataFrame, name: str) -> DataFrame:
    """The distinct values of a column with their places from 0 on, in order: (name, n)."""
    rows = stored(values.select(name).distinct().repartitionByRange(name).sortWithinPartitions(name).select(name, F.monotonically_increasing_id().alias("m")), "places")
    sizes = sorted((r.p, r["count"]) for r in rows.groupBy(F.shiftright("m", 33).alias("p")).count().collect())  # a row a partition
    before = list(zip([p for p, _ in sizes], accumulate((c for _, c in sizes), initial=0), strict=False))
    starts = values.sparkSession.createDataFrame(before, "p long, start long")
    placed = rows.join(F.broadcast(starts), F.shiftright("m", 33) == F.col("p"))
    return stored(placed.select(name, (F.col("start") + F.col("m").bitwiseAND(F.lit((1 << 33) - 1))).alias("n")), "places")


#: A mask of seeds is so many whole numbers of 63 bits at most; more seeds are worked off in turns.
MASK_WORDS = 16


def reach(edges: DataFrame, seeds: DataFrame, max_depth: int | None = None, backward: bool = True) -> DataFrame:
    """All (seed, id, distance) within max_depth steps, the seed itself at 0. seeds: id.

    backward finds the nodes that can reach the seed (its influence set). A node is one row with a mask of the seeds that
    it has met; each round spreads only the bits that are new, so what is exchanged grows with nodes, not with seeds times nodes.
    """
    at = places(seeds, "id")
    out, first, n = [], 0, at.count()
    while first < n or not out:
        own = at.filter(F.col("n").between(first, first + 63 * MASK_WORDS - 1)).select("id", (F.col("n") - first).alias("n"))
        words = max(1, -(-min(n - first, 63 * MASK_WORDS) // 63))
        for distance, part in enumerate(_spread(edges, own, words, max_depth, backward)):
            for k in range(words):
                seed = F.explode(_bits(F.col(f"m{k}"), 63 * k + first))
                out.append(part.filter(F.col(f"m{k}") != 0).select(seed.alias("n"), F.col("id"), F.lit(distance).alias("distance")))
        first += 63 * MASK_WORDS
    while len(out) > FOLD:  # a plan of a few tables, however far the seeds reach
        out = [stored(_union(out[i : i + FOLD]), "reached") for i in range(0, len(out), FOLD)]
    return _union(out).join(at.withColumnRenamed("id", "seed"), "n").select("seed", "id", "distance")


def _bits(mask: Column, first: int) -> Column:
    """The numbers of the bits that are set, counted from ``first``."""
    return F.transform(F.filter(F.sequence(F.lit(0), F.lit(62)), lambda b: F.getbit(mask, b) == 1), lambda b: (b + first).cast("long"))


def _spread(edges: DataFrame, seeds: DataFrame, words: int, max_depth: int | None, backward: bool) -> list[DataFrame]:
    """For each distance the nodes first met by some seeds there: id, m0, m1, ... seeds: id, n (the bit)."""
    to, of = ("src", "dst") if backward else ("dst", "src")
    masks = [f"m{k}" for k in range(words)]
    zero = F.lit(0).cast("long")
    bit = F.expr("shiftleft(1L, CAST(n % 63 AS INT))")
    found = [stored(seeds.select("id", *(F.when(F.floor(F.col("n") / 63) == k, bit).otherwise(zero).alias(m) for k, m in enumerate(masks))), "met")]
    met = found[:]
    while max_depth is None or len(found) <= max_depth:
        near = _within(edges, of, found[-1])
        if near is None:
            break
        came = near.join(found[-1].withColumnRenamed("id", of), of).groupBy(F.col(to).alias("id")).agg(*(F.bit_or(m).alias(m) for m in masks))
        rows = came.select("id", *masks, *(zero.alias(f"old{k}") for k in range(words)))
        rows = rows.unionByName(_union(met).select("id", *(zero.alias(m) for m in masks), *(F.col(m).alias(f"old{k}") for k, m in enumerate(masks))))
        new = rows.groupBy("id").agg(*(F.bit_or(m).bitwiseAND(F.bitwise_not(F.bit_or(f"old{k}"))).alias(m) for k, m in enumerate(masks)))
        new = stored(new.filter(reduce(lambda a, b: a | b, (F.col(m) != 0 for m in masks))), "met")
        if new.isEmpty():
            break
        found.append(new)
        met.append(new)
        if len(met) >= FOLD:
            met = [stored(_union(met).groupBy("id").agg(*(F.bit_or(m).alias(m) for m in masks)), "met")]
    return found


def field_distance(edges: DataFrame, field: DataFrame, cutoff: int) -> DataFrame:
    """Undirected distance (id, distance) to the nearest of the field nodes (id), up to cutoff. A round reads the edges as they are stored, from either end."""
    edges = edges if hasattr(edges, "_stored_at") else stored(edges.select("src", "dst"), "edges")
    seen = stored(field.select("id", F.lit(0).alias("distance")).distinct(), "seen")
    frontier = seen
    for depth in range(1, cutoff + 1):
        sides = [(to, of, _within(edges, of, frontier)) for to, of in (("dst", "src"), ("src", "dst"))]
        if sides[0][2] is None:
            break
        nxt = _union([near.join(frontier.select(F.col("id").alias(of)), of).select(F.col(to).alias("id")) for to, of, near in sides]).distinct()
        frontier = stored(nxt.join(seen, "id", "left_anti").withColumn("distance", F.lit(depth)), "frontier")
        seen = seen.unionByName(frontier)
    return seen


def field_neighbors(edges: DataFrame, field: DataFrame) -> DataFrame:
    """How many distinct direct neighbours of each node are field nodes: (id, field_neighbors); nodes with none are absent."""
    both = edges.select(F.col("src").alias("id"), F.col("dst").alias("n")).unionByName(edges.select(F.col("dst").alias("id"), F.col("src").alias("n"))).distinct()
    return both.join(field.select(F.col("id").alias("n")).distinct(), "n").groupBy("id").agg(F.count(F.lit(1)).alias("field_neighbors"))


def _numbered_for(copies: int, edges: DataFrame, nodes: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """numbered, but numbers that leave room for so many copies of each are taken as they are."""
    if _are_numbers(edges):
        every = vertices(edges) if nodes is None else nodes.select("id").unionByName(vertices(edges)).distinct()
        every = stored(every.select("id", F.col("id").alias("n")), "ids")
        low, high = every.agg(F.min("n"), F.max("n")).first()
        if low is None or (low >= 0 and (high + 1) * copies < 1 << 63):
            return every, edges
    return numbered(edges, nodes)


def subgraph_quality(edges: DataFrame, members: DataFrame) -> DataFrame:
    """Per group of members (grp, id): n_nodes, internal_edges, density, n_components, largest_fraction."""
    pairs = undirected(edges)
    inner = pairs.join(members.select(F.col("id").alias("a"), "grp"), "a").join(members.select(F.col("id").alias("b"), F.col("grp").alias("g2")), "b").filter("grp = g2").select("grp", "a", "b")
    inner = stored(inner, "inner")
    groups = stored(places(members, "grp").withColumnRenamed("n", "g"), "groups")
    n_groups = max(1, groups.count())
    ids, _ = _numbered_for(n_groups, inner.select(F.col("a").alias("src"), F.col("b").alias("dst")), members)
    tag = lambda c: (F.col(c) * n_groups + F.col("g")).alias(c)
    own = stored(members.select("grp", "id").distinct().join(ids, "id").join(groups, "grp").select("grp", "g", tag("n")).withColumnRenamed("n", "id"), "own")
    number = lambda c: ids.select(F.col("id").alias(c), F.col("n").alias(f"{c}_n"))
    linked = inner.join(number("a"), "a").join(number("b"), "b").join(groups, "grp").select("g", F.col("a_n").alias("src"), F.col("b_n").alias("dst"))
    parts = components(linked.select(tag("src"), tag("dst")), own.select("id")).join(own, "id")
    sizes = parts.groupBy("grp", "component").count().groupBy("grp").agg(F.count(F.lit(1)).alias("n_components"), F.max("count").alias("largest"), F.sum("count").alias("n_nodes"))
    edges_in = inner.groupBy("grp").agg(F.count(F.lit(1)).alias("internal_edges"))
    out = sizes.join(edges_in, "grp", "left").withColumn("internal_edges", F.coalesce("internal_edges", F.lit(0)))
    n = F.col("n_nodes")
    density = F.when(n > 1, 2.0 * F.col("internal_edges") / (n * (n - 1))).otherwise(0.0)
    return out.select("grp", "n_nodes", "internal_edges", F.round(density, 6).alias("density"), "n_components", F.round(F.col("largest") / n, 6).alias("largest_fraction"))


def removal_impact(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """What taking nodes (id) out does: component_delta, giant_loss (beyond the nodes themselves). One row.

    Components are searched once, without the nodes. The whole graph's are those, as single nodes, and the nodes' own links.
    """
    taken = stored(nodes.select("id").distinct(), "taken")
    if _are_numbers(edges):
        links, out = edges if hasattr(edges, "_stored_at") else stored(edges.select("src", "dst"), "edges"), taken.withColumnRenamed("id", "n")
    else:
        ids, links = numbered(edges)
        out = stored(taken.join(ids, "id").select("n"), "taken")
    end = lambda c: out.withColumnRenamed("n", c)
    free = stored(links.join(end("src"), "src", "left_anti").join(end("dst"), "dst", "left_anti").select("src", "dst"), "free")
    touching = links.join(end("src"), "src", "left_semi").select("src", "dst").unionByName(links.join(end("dst"), "dst", "left_semi").select("src", "dst"))
    touching = stored(touching.distinct(), "touching")
    ends = vertices(touching)
    parts = stored(components(free, ends.join(end("id"), "id", "left_anti")), "parts")
    after = stored(parts.groupBy(F.col("component").alias("id")).agg(F.count(F.lit(1)).alias("w")), "sizes")
    of = lambda c: parts.select(F.col("id").alias(c), F.col("component").alias(f"{c}_part"))
    contracted = touching.join(of("src"), "src", "left").join(of("dst"), "dst", "left").select(F.coalesce("src_part", "src").alias("src"), F.coalesce("dst_part", "dst").alias("dst")).distinct()
    every = stored(after.unionByName(ends.join(end("id"), "id", "left_semi").select("id", F.lit(1).cast("long").alias("w"))), "nodes")
    before = components(contracted, every.select("id")).join(every, "id").groupBy("component").agg(F.sum("w").alias("w"))
    told = lambda sizes, name: sizes.agg(F.count(F.lit(1)).alias(f"n_{name}"), F.coalesce(F.max("w"), F.lit(0)).alias(f"giant_{name}"))
    rows = told(before, "before").crossJoin(told(after, "after")).crossJoin(taken.agg(F.count(F.lit(1)).alias("n")))  # one row each
    return rows.select((F.col("n_after") - F.col("n_before")).alias("component_delta"), F.greatest(F.lit(0), F.col("giant_before") - F.col("giant_after") - F.col("n")).alias("giant_loss"))


def removal_impacts(edges: DataFrame, members: DataFrame) -> DataFrame:
    """What taking each group of members (grp, id) out does: grp, component_delta, giant_loss (beyond the members themselves).

    What no group touches is contracted once: each of its components becomes one node that weighs as much. A member linked to one of these
    stays with it whenever it is there itself, so it is counted there. Only what is left, the links between such nodes and members
    without one, each pair once for the groups of its ends, is copied for each group (and once more for the whole graph), without that group's members.
    """
    groups = stored(places(members, "grp").withColumnRenamed("n", "g"), "groups")
    n_groups = groups.count()
    ids, links = _numbered_for(n_groups + 1, edges)
    pairs = stored(undirected(links), "pairs")
    own = stored(members.join(ids, "id").join(groups, "grp").select("g", "n").distinct(), "members")
    touched = stored(own.select("n").distinct(), "touched")
    end = lambda c: touched.withColumnRenamed("n", c)
    free = pairs.join(end("a"), "a", "left_anti").join(end("b"), "b", "left_anti").select(F.col("a").alias("src"), F.col("b").alias("dst"))
    parts = stored(components(free, ids.select(F.col("n").alias("id")).join(end("id"), "id", "left_anti")), "parts")
    of = lambda c: parts.select(F.col("id").alias(c), F.col("component").alias(f"{c}_part"))
    both = pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).join(end("a"), "a")
    left = both.join(of("b"), "b", "left").filter("b_part IS NOT NULL OR a < b")  # links of two members once
    left = stored(left.select("a", F.coalesce("b_part", "b").alias("b"), F.col("b_part").isNotNull().alias("free")).distinct(), "left")
    anchors = left.filter("free").groupBy(F.col("a").alias("n")).agg(F.min("b").alias("label"))
    labels = own.groupBy("n").agg(F.sort_array(F.collect_set("g")).alias("gs")).join(anchors, "n", "left").select("n", F.coalesce("label", "n").alias("label"), "gs")
    labels = stored(labels, "labels")
    at = lambda c: labels.select(F.col("n").alias(c), F.col("label").alias(f"{c}_label"), F.col("gs").alias(f"{c}_gs"))
    always = F.array().cast("array<bigint>")
    direct = left.filter("free").join(at("a"), "a").select(F.col("a_label").alias("a"), "b", "a_gs", always.alias("b_gs"))
    among = left.filter("NOT free").join(at("a"), "a").join(at("b"), "b").select(F.col("a_label").alias("a"), F.col("b_label").alias("b"), "a_gs", "b_gs")
    linked = stored(direct.filter("a <> b").unionByName(among.filter("a <> b")).distinct(), "contracted")
    weight = parts.groupBy(F.col("component").alias("id")).agg(F.count(F.lit(1)).alias("w"))
    near = left.filter("free").select(F.col("b").alias("id")).distinct()
    counted = labels.groupBy(F.col("label").alias("id"), "gs").agg(F.count(F.lit(1)).alias("w"))
    nodes = stored(counted.unionByName(weight.join(near, "id", "left_semi").select("id", always.alias("gs"), "w")), "nodes")
    apart = weight.join(near, "id", "left_anti").agg(F.count(F.lit(1)).alias("n_apart"), F.coalesce(F.max("w"), F.lit(0)).alias("most_apart"))
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_groups).cast("long"))).alias("g")  # the last stands for the whole graph
    tag = lambda c: (F.col(c) * (n_groups + 1) + F.col("g")).alias(c)
    there = lambda c: ~F.array_contains(c, F.col("g"))
    copies = linked.select("a", "b", "a_gs", "b_gs", every).filter(there("a_gs") & there("b_gs"))
    copied = nodes.select("id", "gs", "w", every).filter(there("gs")).groupBy("g", "id").agg(F.sum("w").alias("w"))
    copied = stored(copied.select("g", tag("id"), "w"), "copied")
    found = components(copies.select(tag("a"), tag("b")).withColumnsRenamed({"a": "src", "b": "dst"}), copied.select("id")).join(copied, "id")
    sizes = found.groupBy("g", "component").agg(F.sum("w").alias("w")).groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.max("w").alias("most"))
    facts = stored(sizes, "sizes")
    whole = apart.join(facts.filter(F.col("g") == n_groups).select(F.col("n").alias("n_whole"), F.col("most").alias("most_whole")), how="left")  # one row each
    size = own.groupBy("g").agg(F.count(F.lit(1)).alias("taken"))
    out = groups.join(facts, "g", "left").join(size, "g", "left").crossJoin(F.broadcast(whole))  # one row
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    loss = F.greatest(zero("most_whole"), F.col("most_apart")) - F.greatest(zero("most"), F.col("most_apart")) - zero("taken")
    return out.select("grp", (zero("n") - zero("n_whole")).alias("component_delta"), F.greatest(F.lit(0), loss).alias("giant_loss"))
