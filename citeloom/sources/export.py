"""Sinks: CSV, GEXF, Gephi tables, Markdown, SVG, and one HTML page with search.

CSV, Markdown and HTML files are for people, and their rows stream to the driver one partition at a time. A graph's file is
written by the tasks, in parts that are joined.
"""

from __future__ import annotations

import csv
import json
from collections.abc import Iterable, Sequence
from pathlib import Path
from xml.sax.saxutils import escape, quoteattr

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import filled
from ..storage import scratch

GEXF_HEAD = '<?xml version="1.0" encoding="utf-8"?>\n<gexf xmlns="http://www.gexf.net/1.2draft" xmlns:viz="http://www.gexf.net/1.2draft/viz" version="1.2">\n<graph mode="static" defaultedgetype="directed">\n'


def write_csv(df: DataFrame, path: str | Path) -> int:
    """One CSV file; returns how many rows it has."""
    n = 0
    with Path(path).open("w", newline="", encoding="utf-8") as out:
        to = csv.writer(out)
        to.writerow(df.columns)
        for row in df.toLocalIterator():
            to.writerow(["" if v is None else v for v in row])
            n += 1
    return n


def _quoted(c: Column) -> Column:
    """A text as an XML attribute."""
    out = F.coalesce(c.cast("string"), F.lit(""))
    for char, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("\n", "&#10;"), ("\r", "&#13;"), ("\t", "&#9;")):
        out = F.replace(out, F.lit(char), F.lit(name))
    return F.concat(F.lit('"'), out, F.lit('"'))


def _joined(spark: SparkSession, path: str | Path, pieces: Sequence[str | DataFrame]) -> None:
    """One text file of texts and of lines (one column each). Tasks write the lines as parts, in the shared folder; the
    parts are then joined file to file, and the whole takes its name when it is complete. No line comes to the driver's Python."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    held = scratch(spark, "lines")
    parts: list[str | list] = []
    for i, piece in enumerate(pieces):
        if isinstance(piece, str):
            parts.append(piece)
            continue
        piece.write.text(f"{held}/{i}")
        folder = jvm.org.apache.hadoop.fs.Path(f"{held}/{i}")
        files = folder.getFileSystem(conf).listStatus(folder)
        parts.append(sorted((f.getPath() for f in files if f.getPath().getName().startswith("part-")), key=lambda p: p.getName()))
    place = str(path) if "://" in str(path) else Path(path).resolve().as_uri()
    to, draft = (jvm.org.apache.hadoop.fs.Path(f"{place}{end}") for end in ("", ".draft"))
    store = to.getFileSystem(conf)
    store.setWriteChecksum(False)
    out = store.create(draft, True)
    for part in parts:
        if isinstance(part, str):
            out.write(bytearray(part, "utf-8"))
            continue
        for file in part:
            read = file.getFileSystem(conf).open(file)
            jvm.org.apache.hadoop.io.IOUtils.copyBytes(read, out, 1 << 16, False)
            read.close()
    out.close()
    store.setWriteChecksum(True)
    store.delete(to, False)
    store.rename(draft, to)
    gone = jvm.org.apache.hadoop.fs.Path(held)
    gone.getFileSystem(conf).delete(gone, True)


def write_gexf(path: str | Path, nodes: DataFrame, edges: DataFrame | None = None, label: str = "id", color: str | None = None, size: str | None = None) -> None:
    """nodes: id and attributes (null becomes empty); edges: src, dst[, weight]; colour and size as viz elements.

    Every element is a line made by column expressions and written by the tasks.
    """
    text = lambda *xs: F.concat(*(F.lit(x) if isinstance(x, str) else x for x in xs))
    names = [c for c in nodes.columns if c not in ("id", color, size)]
    name = F.coalesce(F.when(F.col(label).cast("string") != "", F.col(label).cast("string")), F.col("id").cast("string"))
    line = [text("<node id=", _quoted(F.col("id")), " label=", _quoted(name), "><attvalues>")]
    line += [text(f'<attvalue for="{i}" value=', _quoted(F.col(n)), " />") for i, n in enumerate(names)] + [F.lit("</attvalues>")]
    if color:
        parts = (F.conv(F.substring(color, at, 2), 16, 10) for at in (2, 4, 6))
        line.append(text(*(x for c, p in zip("rgb", parts, strict=True) for x in (f'{"<viz:color " if c == "r" else " "}{c}="', p, '"')), " />"))
    if size:
        line.append(text('<viz:size value="', F.col(size).cast("string"), '" />'))
    head = GEXF_HEAD + '<attributes class="node" mode="static">\n' + "".join(f'<attribute id="{i}" title={quoteattr(n)} type="string" />\n' for i, n in enumerate(names)) + "</attributes>\n<nodes>\n"
    pieces: list[str | DataFrame] = [head, nodes.select(F.concat(*line, F.lit("</node>")).alias("value")), "</nodes>\n<edges>\n"]
    if edges is not None:
        weight = [' weight="', F.col("weight").cast("string"), '"'] if "weight" in edges.columns else []
        pieces.append(edges.select(text('<edge id="', F.monotonically_increasing_id().cast("string"), '" source=', _quoted(F.col("src")), " target=", _quoted(F.col("dst")), *weight, " />").alias("value")))
    _joined(nodes.sparkSession, path, [*pieces, "</edges>\n</graph>\n</gexf>\n"])


def gephi_nodes(nodes: DataFrame, title: str = "title") -> DataFrame:
    """Id, Label (the id where the title is blank), numbers rounded to 6."""
    rest = [F.round(c, 6).alias(c) if kind == "double" else F.col(c) for c, kind in nodes.dtypes if c not in ("id", title)]
    return nodes.select(F.col("id").alias("Id"), F.coalesce(filled(F.col(title)), F.col("id")).alias("Label"), *rest)


def gephi_edges(pairs: DataFrame, chosen: DataFrame) -> DataFrame:
    """Source, Target, Type, Weight among the chosen nodes (id), strongest first. pairs: a, b, combined."""
    a, b = chosen.select(F.col("id").alias("a")), chosen.select(F.col("id").alias("b"))
    own = pairs.join(a, "a", "left_semi").join(b, "b", "left_semi")
    return own.select(F.col("a").alias("Source"), F.col("b").alias("Target"), F.lit("Undirected").alias("Type"), F.round("combined", 6).alias("Weight")).orderBy(F.col("Weight").desc(), "Source", "Target")


def write_markdown(path: str | Path, title: str, rows: DataFrame, *order) -> None:
    """A numbered list of nodes. rows: id, year, title, note."""
    with Path(path).open("w", encoding="utf-8") as out:
        out.write(f"# {title}\n\nTotal nodes: {rows.count()}\n\n")
        for i, r in enumerate(rows.orderBy(*order).toLocalIterator(), 1):
            out.write(f"{i}. **{r['id']}** ({r['year'] or ''}) - {r['title'] or 'No title'} [{r['note']}]\n")


def svg(shapes: Iterable[str], width: float, height: float, background: str = "none") -> str:
    ground = "" if background == "none" else f'<rect width="100%" height="100%" fill="{background}" />'
    return f'<svg xmlns="http://www.w3.org/2000/svg" width="{width:g}" height="{height:g}" viewBox="0 0 {width:g} {height:g}">{ground}{"".join(shapes)}</svg>'


def circle(x: float, y: float, r: float, color: str, tip: str = "") -> str:
    return f'<circle cx="{x:.2f}" cy="{y:.2f}" r="{r:.2f}" fill="{color}"><title>{escape(tip)}</title></circle>'


def leaf(x: float, y: float, length: float, width: float, turn: float, color: str, tip: str = "") -> str:
    """A pointed oval around its own middle, turned."""
    h, w = length / 2, width / 2
    return f'<path transform="translate({x:.2f} {y:.2f}) rotate({turn:.2f})" d="M {-h:.2f} 0 Q 0 {-w * 2:.2f} {h:.2f} 0 Q 0 {w * 2:.2f} {-h:.2f} 0 Z" fill="{color}"><title>{escape(tip)}</title></path>'


def html_page(drawing: str, records: DataFrame, fields: Sequence[str]) -> str:
    """A page with the drawing and a list of records that filters by role and by text in the given fields."""
    rows = (r["row"] for r in records.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("row")).toLocalIterator())
    data = f"[{','.join(rows)}]".replace("</", "<\\/")
    script = """
const q=document.getElementById('q'),role=document.getElementById('role'),sub=document.getElementById('sub'),list=document.getElementById('list'),count=document.getElementById('count');
const roles=[...new Set(rows.map(r=>r.role))];roles.forEach(x=>role.add(new Option((rows.find(r=>r.role===x).role_label??x)+' ('+rows.filter(r=>r.role===x).length+')',x)));
function groups(){sub.replaceChildren(new Option('all',''));[...new Set(rows.filter(r=>!role.value||r.role===role.value).map(r=>r.subgroup).filter(x=>x))].forEach(x=>sub.add(new Option(x,x)));}
function draw(){const t=q.value.toLowerCase();const own=rows.filter(r=>(!role.value||r.role===role.value)&&(!sub.value||r.subgroup===sub.value)&&fields.map(f=>r[f]??'').join(' ').toLowerCase().includes(t));
 count.textContent=own.length+' of '+rows.length;
 list.replaceChildren(...own.map(r=>Object.assign(document.createElement('li'),{textContent:r.role+': '+(r.title||r.id)+' ('+(r.year??'year unknown')+')'+(r.subgroup_label?' - '+r.subgroup_label:'')})));}
q.oninput=sub.onchange=draw;role.onchange=()=>{groups();draw();};groups();draw();"""
    return f'<!DOCTYPE html><meta charset="utf-8"><title>Citation tree</title>{drawing}<p><input id="q" placeholder="search"><select id="role"><option value="">all</option></select><select id="sub"></select> <span id="count"></span></p><ol id="list"></ol><script>const rows={data},fields={json.dumps(list(fields))};{script}</script>'
