"""SVG, DOT and GraphML as rows of text: graph_id, part, at, line. Written in order of (graph_id, part, at) they are
documents; `write_text` does that with one folder for each graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from vertexloom.operators.ingest import with_ends
from vertexloom.sources.graphs import Graph


def escape_xml(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def quote_dot(text: Column) -> Column:
    """A DOT id: as it is when it is an identifier or a number, else quoted."""
    quoted = F.concat(F.lit('"'), F.replace(F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n")), F.lit('"'))
    return F.when(text.rlike("^([A-Za-z_][A-Za-z0-9_]*|[0-9]+)$"), text).otherwise(quoted)


def _number(value: Column, digits: int) -> Column:
    return F.format_string(f"%.{digits}f", F.floor(value * 10**digits + 0.5) / 10**digits + 0.0)


def _rows(df: DataFrame, part: int, at: Column | None, line: Column) -> DataFrame:
    return df.select("graph_id", F.lit(part).alias("part"), (F.lit(0).cast("long") if at is None else at.cast("long")).alias("at"), line.alias("line"))


def _name() -> Column:
    return F.coalesce("label", F.col("idx").cast("string"))


def to_svg(g: Graph, padding: float = 40.0, radius: float = 20.0, node_color: str = "#3f7fbf", node_stroke: str = "#24527a", stroke_width: float = 2.0, edge_color: str = "#5a6470", edge_width: float = 1.5, labels: bool = True, label_color: str = "#000000", font_size: float = 12.0, font: str = "sans-serif", shape: str = "circle") -> DataFrame:
    """Edges as lines, nodes as circles (or rounded boxes of their size), labels in their centres."""
    half = lambda c: F.coalesce(F.col(c), F.lit(2 * radius)) / 2
    box = g.nodes.groupBy("graph_id").agg(*(f(F.col(c) + s * half(o)).alias(n) for f, c, s, o, n in ((F.min, "x", -1, "width", "x0"), (F.min, "y", -1, "height", "y0"), (F.max, "x", 1, "width", "x1"), (F.max, "y", 1, "height", "y1"))))
    shift = box.select("graph_id", (padding - F.col("x0")).alias("ox"), (padding - F.col("y0")).alias("oy"), (F.col("x1") - F.col("x0") + 2 * padding).alias("w"), (F.col("y1") - F.col("y0") + 2 * padding).alias("h"))
    nodes = g.nodes.join(shift, "graph_id")
    n = lambda c: _number(c, 2)
    head = _rows(shift, 0, None, F.format_string('<svg xmlns="http://www.w3.org/2000/svg" width="%s" height="%s" viewBox="0 0 %s %s">', n(F.col("w")), n(F.col("h")), n(F.col("w")), n(F.col("h"))))
    lines = with_ends(g.edges, nodes, "x", "y", "ox", "oy")
    edges = _rows(lines, 1, F.col("eid"), F.format_string(f'<line x1="%s" y1="%s" x2="%s" y2="%s" stroke="{edge_color}" stroke-width="{edge_width}"/>', n(F.col("a_x") + F.col("a_ox")), n(F.col("a_y") + F.col("a_oy")), n(F.col("b_x") + F.col("b_ox")), n(F.col("b_y") + F.col("b_oy"))))
    x, y = F.col("x") + F.col("ox"), F.col("y") + F.col("oy")
    paint = f'fill="{node_color}" stroke="{node_stroke}" stroke-width="{stroke_width}"'
    if shape == "circle":
        form = F.format_string(f'<circle cx="%s" cy="%s" r="%s" {paint}/>', n(x), n(y), n(F.least(half("width"), half("height"))))
    else:
        form = F.format_string(f'<rect x="%s" y="%s" width="%s" height="%s" rx="4" {paint}/>', n(x - half("width")), n(y - half("height")), n(2 * half("width")), n(2 * half("height")))
    parts = [head, edges, _rows(nodes, 2, F.col("idx"), form)]
    if labels:
        parts.append(_rows(nodes, 3, F.col("idx"), F.format_string(f'<text x="%s" y="%s" text-anchor="middle" dominant-baseline="central" font-family="{font}" font-size="{font_size}" fill="{label_color}">%s</text>', n(x), n(y), escape_xml(_name()))))
    return _stacked([*parts, _rows(shift, 4, None, F.lit("</svg>"))])


def _stacked(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def to_dot(g: Graph, name: str = "G", directed: bool = False, positions: bool = True, shape: str = "ellipse") -> DataFrame:
    """Graphviz text; positions are in inches with y upward, pinned."""
    graphs = g.nodes.select("graph_id").distinct()
    arrow = "->" if directed else "--"
    at = F.format_string(', pos="%s,%s!"', _number(F.col("x") / 72, 4), _number(-F.col("y") / 72, 4)) if positions else F.lit("")
    label = F.concat(F.lit('label="'), F.replace(F.replace(_name(), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))
    node = F.concat(F.lit("  "), quote_dot(F.col("idx").cast("string")), F.lit(" ["), label, at, F.lit("];"))
    weight = F.when(F.col("weight").isNotNull(), F.concat(F.lit(" [weight="), _number(F.col("weight"), 2), F.lit("]"))).otherwise("")
    edge = F.concat(F.lit("  "), F.col("src").cast("string"), F.lit(f" {arrow} "), F.col("dst").cast("string"), weight, F.lit(";"))
    head = F.lit(f"{'digraph' if directed else 'graph'} {name} {{\n  node [shape={shape}];")
    return _stacked([_rows(graphs, 0, None, head), _rows(g.nodes, 1, F.col("idx"), node), _rows(g.edges.where("src is not null and dst is not null"), 2, F.col("eid"), edge), _rows(graphs, 3, None, F.lit("}"))])


def to_graphml(g: Graph, name: str = "G", directed: bool = False) -> DataFrame:
    """GraphML with typed keys for positions, sizes, labels, weights and lengths; six decimals."""
    keys = [("x", "node", "double"), ("y", "node", "double"), ("width", "node", "double"), ("height", "node", "double"), ("label", "node", "string"), ("weight", "edge", "double"), ("length", "edge", "double")]
    head = '<?xml version="1.0" encoding="UTF-8"?>\n<graphml xmlns="http://graphml.graphdrawing.org/xmlns">\n' + "".join(f'<key id="{k}" for="{o}" attr.name="{k}" attr.type="{t}"/>\n' for k, o, t in keys) + f'<graph id="{name}" edgedefault="{"directed" if directed else "undirected"}">'
    data = lambda owner: F.concat(*(F.when(F.col(k).isNotNull(), F.concat(F.lit(f'<data key="{k}">'), _number(F.col(k), 6) if t == "double" else escape_xml(F.col(k)), F.lit("</data>"))).otherwise("") for k, o, t in keys if o == owner))
    graphs = g.nodes.select("graph_id").distinct()
    node = F.concat(F.format_string('<node id="n%d">', "idx"), data("node"), F.lit("</node>"))
    edge = F.concat(F.format_string('<edge id="e%d" source="n%d" target="n%d">', "eid", "src", "dst"), data("edge"), F.lit("</edge>"))
    return _stacked([_rows(graphs, 0, None, F.lit(head)), _rows(g.nodes, 1, F.col("idx"), node), _rows(g.edges.where("src is not null and dst is not null"), 2, F.col("eid"), edge), _rows(graphs, 3, None, F.lit("</graph>\n</graphml>"))])


def documents(lines: DataFrame) -> DataFrame:
    """graph_id, text: one document for each graph. Meant for graphs that fit a row; else `write_text`."""
    return lines.groupBy("graph_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "at", "line"))), lambda r: r.line), "\n").alias("text"))


def write_text(lines: DataFrame, path: str) -> None:
    """One folder graph_id=... for each graph; its files, read in order of name, are the document."""
    lines.repartitionByRange("graph_id", "part", "at").sortWithinPartitions("graph_id", "part", "at").select("graph_id", F.col("line").alias("value")).write.partitionBy("graph_id").text(path)


def line_numbers(lines: DataFrame) -> DataFrame:
    """lines with their number within the graph's document, from 1."""
    return lines.withColumn("number", F.row_number().over(W.Window.partitionBy("graph_id").orderBy("part", "at")))


def _bends() -> Column:
    """The points of a route (points) between its ends; an edge without a route has none."""
    return F.coalesce(F.slice("points", 2, F.greatest(F.size("points") - 2, F.lit(0))), F.array().cast("array<struct<x:double,y:double>>"))


def _routed(g: Graph, routed: DataFrame) -> DataFrame:
    """Edges between nodes with their route, which is null where there is none."""
    ends = with_ends(g.edges, g.nodes, "x", "y")
    return ends.join(routed.select("graph_id", "eid", "points"), ["graph_id", "eid"], "left")


def to_svg_orthogonal(
    g: Graph, routed: DataFrame, padding: float = 40.0, node_color: str = "#3f7fbf", node_stroke: str = "#24527a", stroke_width: float = 2.0, edge_color: str = "#5a6470", edge_width: float = 1.5,
    labels: bool = True, label_color: str = "#000000", font_size: float = 12.0, font: str = "sans-serif", background: str | None = None,
) -> DataFrame:
    """Nodes as boxes of their size and edges as polylines along their routes (graph_id, eid, points), straight where they have
    none; the picture holds all bends. A graph without nodes has no rows."""
    half = lambda c: F.coalesce(F.col(c), F.lit(0.0)) / 2
    corner = lambda s: F.struct((F.col("x") + s * half("width")).alias("x"), (F.col("y") + s * half("height")).alias("y"))
    spots = g.nodes.select("graph_id", F.explode(F.array(corner(-1), corner(1))).alias("p")).unionByName(_routed(g, routed).select("graph_id", F.explode(_bends()).alias("p")))
    box = spots.groupBy("graph_id").agg(F.min("p.x").alias("x0"), F.min("p.y").alias("y0"), F.max("p.x").alias("x1"), F.max("p.y").alias("y1"))
    shift = box.select("graph_id", (padding - F.col("x0")).alias("ox"), (padding - F.col("y0")).alias("oy"), (F.col("x1") - F.col("x0") + 2 * padding).alias("w"), (F.col("y1") - F.col("y0") + 2 * padding).alias("h"))
    n = lambda c: _number(c, 2)
    head = F.format_string('<svg xmlns="http://www.w3.org/2000/svg" width="%s" height="%s" viewBox="0 0 %s %s">', n(F.col("w")), n(F.col("h")), n(F.col("w")), n(F.col("h")))
    if background:
        head = F.concat(head, F.lit("\n"), F.lit('<rect width="100%" height="100%" fill="'), escape_xml(F.lit(background)), F.lit('"/>'))
    line = _routed(g, routed).join(shift, "graph_id")
    both = F.array(F.struct(F.col("a_x").alias("x"), F.col("a_y").alias("y")), F.struct(F.col("b_x").alias("x"), F.col("b_y").alias("y")))
    spot = lambda p: F.concat(n(p["x"] + F.col("ox")), F.lit(","), n(p["y"] + F.col("oy")))
    path = F.array_join(F.transform(F.coalesce("points", both), spot), " ")
    edges = _rows(line, 1, F.col("eid"), F.format_string(f'<polyline points="%s" fill="none" stroke="{edge_color}" stroke-width="{edge_width}"/>', path))
    nodes = g.nodes.join(shift, "graph_id")
    x, y = F.col("x") + F.col("ox"), F.col("y") + F.col("oy")
    paint = f'fill="{node_color}" stroke="{node_stroke}" stroke-width="{stroke_width}"'
    rects = _rows(nodes, 2, F.col("idx"), F.format_string(f'<rect x="%s" y="%s" width="%s" height="%s" {paint}/>', n(x - half("width")), n(y - half("height")), n(2 * half("width")), n(2 * half("height"))))
    parts = [_rows(shift, 0, None, head), edges, rects]
    if labels:
        style = f'text-anchor="middle" dominant-baseline="central" font-family="{font}" font-size="{font_size}" fill="{label_color}"'
        parts.append(_rows(nodes, 3, F.col("idx"), F.format_string(f'<text x="%s" y="%s" {style}>%s</text>', n(x), n(y), escape_xml(_name()))))
    return _stacked([*parts, _rows(shift, 4, None, F.lit("</svg>"))])


def to_dot_orthogonal(g: Graph, routed: DataFrame, name: str = "G", directed: bool = False, positions: bool = True, shape: str = "box") -> DataFrame:
    """Graphviz text with boxes of fixed size (inches, 72 points each), pinned places and right-angled splines; an edge tells its
    number of bends in a comment, as DOT holds no bends."""
    graphs = g.nodes.select("graph_id").distinct()
    escaped = F.replace(F.replace(_name(), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    size = lambda c: _number(F.coalesce(F.col(c), F.lit(0.0)) / 72, 2)
    at = F.format_string(', pos="%s,%s!"', _number(F.col("x"), 2), _number(-F.col("y"), 2)) if positions else F.lit("")
    node = F.concat(F.lit("  "), F.col("idx").cast("string"), F.lit(' [label="'), escaped, F.lit('"'), at, F.lit(', width="'), size("width"), F.lit('", height="'), size("height"), F.lit('"];'))
    bends = F.size(_bends())
    comment = F.when(bends > 0, F.format_string(' [comment="bends: %d"]', bends)).otherwise("")
    edge = F.concat(F.lit("  "), F.col("src").cast("string"), F.lit(" -> " if directed else " -- "), F.col("dst").cast("string"), comment, F.lit(";"))
    head = F.concat(F.lit("digraph " if directed else "graph "), quote_dot(F.lit(name)), F.lit(f" {{\n  graph [splines=ortho];\n  node [shape={shape}, fixedsize=true];"))
    return _stacked([_rows(graphs, 0, None, head), _rows(g.nodes, 1, F.col("idx"), node), _rows(_routed(g, routed), 2, F.col("eid"), edge), _rows(graphs, 3, None, F.lit("}"))])


def to_graphml_orthogonal(g: Graph, routed: DataFrame, sides: DataFrame | None = None, name: str = "G", directed: bool = False) -> DataFrame:
    """GraphML with boxes' places and sizes, and for edges their bends ("x,y;x,y", two decimals) and, from `sides` (graph_id, eid,
    end, side, as `orthogonal.ports` gives them), the sides that they leave and enter."""
    keys = [("x", "node", "double"), ("y", "node", "double"), ("width", "node", "double"), ("height", "node", "double"), ("label", "node", "string"), ("bends", "edge", "string"), ("source_side", "edge", "string"), ("target_side", "edge", "string")]
    head = '<?xml version="1.0" encoding="UTF-8"?>\n<graphml xmlns="http://graphml.graphdrawing.org/xmlns">\n' + "".join(f'<key id="{k}" for="{o}" attr.name="{k}" attr.type="{t}"/>\n' for k, o, t in keys)
    head = F.concat(F.lit(head + '<graph id="'), escape_xml(F.lit(name)), F.lit(f'" edgedefault="{"directed" if directed else "undirected"}">'))
    data = lambda key, value: F.when(value.isNotNull(), F.concat(F.lit(f'<data key="{key}">'), value, F.lit("</data>"))).otherwise("")
    graphs = g.nodes.select("graph_id").distinct()
    node = F.concat(F.format_string('<node id="%d">', "idx"), *(data(c, _number(F.col(c), 6)) for c in ("x", "y", "width", "height")), data("label", escape_xml(_name())), F.lit("</node>"))
    own = _routed(g, routed)
    for end, key in (("src", "source_side"), ("dst", "target_side")):
        own = own.withColumn(key, F.lit(None).cast("string")) if sides is None else own.join(sides.where(F.col("end") == end).select("graph_id", "eid", F.col("side").alias(key)), ["graph_id", "eid"], "left")
    bends = F.when(F.size(_bends()) > 0, F.array_join(F.transform(_bends(), lambda p: F.concat(_number(p["x"], 2), F.lit(","), _number(p["y"], 2))), ";"))
    edge = F.concat(F.format_string('<edge id="e%d" source="%d" target="%d">', "eid", "src", "dst"), data("bends", bends), data("source_side", F.col("source_side")), data("target_side", F.col("target_side")), F.lit("</edge>"))
    return _stacked([_rows(graphs, 0, None, head), _rows(g.nodes, 1, F.col("idx"), node), _rows(own, 2, F.col("eid"), edge), _rows(graphs, 3, None, F.lit("</graph>\n</graphml>"))])
