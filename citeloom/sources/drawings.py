"""Drawings of roles from metric tables: tens or hundreds of symbols, placed and written on the driver."""

from __future__ import annotations

import shutil
from collections.abc import Sequence
from html import escape
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import layout
from ..functions.columns import short_label
from ..operators.scores import ROLE_ORDER
from .export import circle, leaf, svg

# Where side members stand: start index and distance of each role.
SIDE_ROLES = {"peripheral": (1, 95.0), "background_methodological": (2, 155.0), "missing_metadata": (3, 185.0)}
# Where clusters of roots stand (by how many), and the roots of one around its middle (by how many).
ROOT_CENTERS = {1: [(650.0, 400.0)], 2: [(380.0, 430.0), (920.0, 430.0)], 3: [(250.0, 470.0), (650.0, 290.0), (1050.0, 470.0)]}
ROOT_SLOTS = {
    1: [(0.0, 0.0)],
    2: [(-80.0, 0.0), (80.0, 0.0)],
    3: [(0.0, -10.0), (-95.0, 95.0), (95.0, 95.0)],
    4: [(0.0, -20.0), (-115.0, 75.0), (115.0, 75.0), (0.0, 165.0)],
    5: [(0.0, -25.0), (-120.0, 65.0), (120.0, 65.0), (-82.0, 175.0), (82.0, 175.0)],
    6: [(0.0, -35.0), (-125.0, 40.0), (125.0, 40.0), (-140.0, 165.0), (0.0, 195.0), (140.0, 165.0)],
}
LEGEND = (("Roots", "#5C3317"), ("Trunk", "#8B5A2B"), ("Branches", "#A9743E"), ("Leaves", "#2E7D32"), ("Fruits", "#C62828"))
FRUIT_PLACES = {1: [(320.0, 200.0)], 2: [(230.0, 200.0), (410.0, 200.0)], 3: [(180.0, 220.0), (320.0, 160.0), (460.0, 220.0)]}


def _groups(rows: list, key: str) -> list[list]:
    out: dict = {}
    for r in rows:
        out.setdefault(r[key], []).append(r)
    return [out[k] for k in sorted(out)]


def _label(x: float, y: float, text: str) -> str:
    return f'<text x="{x:.1f}" y="{y:.1f}" font-size="14">{escape(text)}</text>'


def roots(nodes: DataFrame, labels: bool = False) -> str:
    """nodes: id, cluster, cluster_order, anchor_score, citations_received, size, color. Each cluster around a centre of its own, the strongest anchor first."""
    rows = nodes.withColumn("short", short_label(F.col("id"))).orderBy("cluster_order", F.col("anchor_score").desc(), F.col("citations_received").desc(), "id").collect()
    shapes, groups = [], _groups(rows, "cluster_order")
    centers = ROOT_CENTERS.get(max(1, min(3, len(groups))))
    for i, group in enumerate(groups):
        x0, y0 = centers[i % len(centers)][0], centers[i % len(centers)][1] + 620 * (i // len(centers))
        shapes.append(_label(x0 - 40, y0 - 135, f"Cluster {i + 1}"))
        slots = ROOT_SLOTS.get(len(group)) or [(0.0, 0.0), *layout.fan(len(group) - 1, (0.0, 125.0), (165.0, 135.0))]
        for r, (dx, dy) in zip(group, slots, strict=True):
            shapes.append(circle(x0 + dx, y0 + dy, layout.radius_px(r["size"]) / 2, r["color"], r["id"]))
            shapes += [_label(x0 + dx, y0 + dy, r["short"])] if labels else []
    return svg(shapes, 1300, 800 + 620 * max(0, (len(groups) - 1) // 3))


def trunk(nodes: DataFrame, order: Sequence[str], labels: bool = False) -> str:
    """nodes: id, cluster, year, sap, size, color. A column for each cluster of ``order``; other clusters are not drawn."""
    rows = nodes.filter(F.col("cluster").isin(*order)).withColumn("short", short_label(F.col("id"))).orderBy(F.col("year").desc_nulls_last(), F.col("sap").desc(), "id").collect()
    groups = [[r for r in rows if r["cluster"] == c] for c in order]
    places = layout.columns([[r["id"] for r in g] for g in groups])
    shapes = [circle(*places[r["id"]], layout.radius_px(r["size"]) / 2, r["color"], r["id"]) for r in rows]
    shapes += [_label(*places[r["id"]], r["short"]) for r in rows] if labels else []
    return svg(shapes, 300 * len(order) + 20, 120 + 90 * max([1, *map(len, groups)]))


def branches(nodes: DataFrame) -> dict[str, str]:
    """nodes: id, grp, branch_member_role, year, size, color. One drawing per branch: core papers on a diagonal by year, others beside it."""
    out = {}
    for group in _groups(nodes.orderBy("grp", F.col("year").asc_nulls_last(), "id").collect(), "grp"):
        core = [r for r in group if r["branch_member_role"] == "core"]
        shapes = [circle(x, y, layout.radius_px(r["size"]) / 2, r["color"], r["id"]) for r, (x, y) in zip(core, layout.diagonal(len(core), (120, 520), (75, -45)), strict=True)]
        for role, (start, away) in SIDE_ROLES.items():
            for k, r in enumerate(x for x in group if x["branch_member_role"] == role):
                at, side = start + k, away * (1 if k % 2 == 0 else -0.65)
                shapes.append(circle(120 + 75 * at + side * 0.5, 520 - 45 * at + side, layout.radius_px(r["size"]) / 2, r["color"], r["id"]))
        out[str(group[0]["grp"])] = svg(shapes, 900, 760)
    return out


def role_cards(nodes: DataFrame) -> dict[str, str]:
    """nodes: id, grp, branch_member_role, branch_core_score, title. One drawing per branch: a card for each role with its papers, best first."""
    out = {}
    order = [F.col("grp"), F.col("branch_core_score").desc_nulls_last(), "id"]
    for group in _groups(nodes.withColumn("short", short_label(F.col("id"))).orderBy(*order).collect(), "grp"):
        shapes, lowest = [], 0
        for i, role in enumerate(ROLE_ORDER):
            own, x = [r for r in group if r["branch_member_role"] == role], 20 + 300 * i
            shapes.append(f'<rect x="{x}" y="20" width="280" height="{60 + 24 * len(own)}" rx="10" fill="#F4EFE6" />')
            shapes.append(_label(x + 14, 46, f"{role.replace('_', ' ')} ({len(own)})"))
            shapes += [_label(x + 14, 74 + 24 * k, r["short"]) for k, r in enumerate(own)]
            lowest = max(lowest, len(own))
        out[str(group[0]["grp"])] = svg(shapes, 40 + 300 * len(ROLE_ORDER), 120 + 24 * lowest)
    return out


def branch_overview(branches: DataFrame) -> str:
    """branches: grp, paper_count, branch_emergence_score, branch_emergence_rank, branch_emergence_type. A bar for each branch, the best first."""
    shapes = []
    for i, r in enumerate(branches.orderBy("branch_emergence_rank").collect()):
        y = 30 + 60 * i
        shapes.append(f'<rect x="170" y="{y}" width="{400 * max(0.0, min(1.0, r["branch_emergence_score"])):.1f}" height="26" fill="#A9743E" />')
        shapes.append(_label(20, y + 19, f"{r['grp']} ({r['paper_count']})"))
        shapes.append(_label(170, y + 44, f"{r['branch_emergence_score']:.3f} {r['branch_emergence_type'].replace('_', ' ')}"))
    return svg(shapes, 640, 40 + 60 * max(1, len(shapes) // 3))


def leaves(nodes: DataFrame, exclude: Sequence[str] = (), labels: bool = False) -> str:
    """nodes: id, year, sap, leaf_length, leaf_width, leaf_color; newest first over the ellipses. ``exclude``: top fruits."""
    nodes = nodes.withColumn("short", short_label(F.col("id")))
    rows = nodes.filter(~F.col("id").isin(*exclude)) if exclude else nodes
    rows = rows.orderBy(F.col("year").desc_nulls_last(), F.col("sap").desc(), "id").collect()
    places = layout.leaf_places(len(rows))
    shapes = [leaf(x, y, r["leaf_length"], r["leaf_width"], turn, r["leaf_color"], r["id"]) for r, (x, y, turn) in zip(rows, places, strict=True)]
    shapes += [_label(x, y + 22, r["short"]) for r, (x, y, _) in zip(rows, places, strict=True)] if labels else []
    return svg(shapes, 1280, 560)


def canopy(nodes: DataFrame, shape_path: str, seed: int = 42, then: str = "sap") -> str:
    """The newest first, then those of most ``then``. nodes: id, year, sap, leaf_length, leaf_width, leaf_color; leaves at random places of a closed path, kept apart by their lengths and turned outwards."""
    polygon = layout.path_polygon(shape_path)
    rows = nodes.orderBy(F.col("year").desc_nulls_last(), F.col(then).desc(), F.col("sap").desc(), "id").collect()
    places = layout.canopy_places([r["leaf_length"] for r in rows], polygon, seed)
    shapes = [leaf(x, y, r["leaf_length"], r["leaf_width"], turn, r["leaf_color"], r["id"]) for r, (x, y, turn) in zip(rows, places, strict=True)]
    return svg(shapes, max(p[0] for p in polygon), max(p[1] for p in polygon))


def fruits(nodes: DataFrame) -> str:
    """nodes: id, fruit_score, radius, color."""
    rows = nodes.orderBy(F.col("fruit_score").desc(), "id").collect()
    places = FRUIT_PLACES.get(len(rows)) or layout.arc(len(rows), 320, 200, 150)
    return svg([circle(x, y, r["radius"], r["color"], r["id"]) for r, (x, y) in zip(rows, places, strict=True)], 640, 400)


def legend(entries: Sequence[tuple[str, str]]) -> str:
    """(label, colour) of each role."""
    shapes = [circle(30, 30 + 36 * i, 12, color) + _label(54, 35 + 36 * i, label) for i, (label, color) in enumerate(entries)]
    return svg(shapes, 320, 24 + 36 * len(entries))


def workflow(steps: Sequence[str]) -> str:
    """The stages as boxes, one below the other."""
    shapes = []
    for i, step in enumerate(steps):
        shapes.append(f'<rect x="20" y="{20 + 60 * i}" width="320" height="40" rx="8" fill="#F4EFE6" stroke="#5C3317" />')
        shapes.append(_label(34, 45 + 60 * i, f"{i + 1}. {step}"))
        if i:
            shapes.append(f'<path d="M 180 {60 * i} v 20" stroke="#5C3317" />')
    return svg(shapes, 360, 40 + 60 * len(steps))


def copy_if_exists(source: str | Path, target: str | Path) -> bool:
    if not Path(source).exists():
        return False
    Path(target).parent.mkdir(parents=True, exist_ok=True)
    shutil.copyfile(source, target)
    return True
