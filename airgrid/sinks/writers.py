"""Writers: CSV, GeoJSON, and self-contained pages."""

from __future__ import annotations

import html
import json
import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_csv(df: DataFrame, path: str, columns: list[str] | None = None, single: bool = False) -> None:
    """CSV with a header in a fixed column order; an existing path is an error, never overwritten. single: one file, for reports."""
    out = df.select(*columns) if columns else df
    (out.coalesce(1) if single else out).write.mode("errorifexists").option("header", True).csv(path)


def free_path(spark, path: str, most: int = 999) -> str:
    """path, or path_1 to path_999 if it is taken."""
    stem, dot, kind = path.rpartition(".") if "." in path.rsplit("/", 1)[-1] else (path, "", "")
    for k in range(most + 1):
        name = path if not k else f"{stem}_{k}{dot}{kind}"
        at = spark._jvm.org.apache.hadoop.fs.Path(name)
        if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
            return name
    raise FileExistsError(path)


def write_features(features: DataFrame, path: str) -> None:
    """Newline-delimited GeoJSON features (column feature): written and read in parallel."""
    features.select("feature").write.mode("errorifexists").text(path)


def feature_collection(features: DataFrame) -> DataFrame:
    """One FeatureCollection text, for results of report size."""
    return features.agg(F.concat(F.lit('{"type":"FeatureCollection","features":['), F.array_join(F.collect_list("feature"), ","), F.lit("]}")).alias("collection"))


def page(title: str, payload: dict) -> str:
    """A self-contained page that carries its data; rendering is the reader's."""
    return f"<!doctype html><meta charset='utf-8'><title>{html.escape(title)}</title>{_data(payload)}<pre id='out'></pre><script>document.getElementById('out').textContent=document.getElementById('data').textContent</script>"


def _data(payload: dict) -> str:
    return "<script type='application/json' id='data'>" + json.dumps(payload, default=str).replace("</", "<\\/") + "</script>"


#: Draws the layers' lines, points and boxes in lon/lat on an SVG; a box ticks each group of layers, a slider picks the step.
_MAP = """
const data = JSON.parse(document.getElementById('data').textContent), svg = document.getElementById('map'), NS = svg.namespaceURI;
const mercator = ([lon, lat]) => [lon, -Math.log(Math.tan(Math.PI / 4 + lat * Math.PI / 360)) * 180 / Math.PI];
const all = data.layers.flatMap(l => l.shapes.flatMap(s => s.at.map(mercator)));
const edge = (k, f) => all.reduce((a, p) => f(a, p[k]), f === Math.min ? 1e9 : -1e9);
const x0 = edge(0, Math.min), x1 = edge(0, Math.max), y0 = edge(1, Math.min), y1 = edge(1, Math.max), pad = Math.max(x1 - x0, y1 - y0, 1e-6) / 20;
if (all.length) svg.setAttribute('viewBox', [x0 - pad, y0 - pad, x1 - x0 + 2 * pad, y1 - y0 + 2 * pad].join(' '));
const hidden = new Set(), slider = document.getElementById('step'), steps = data.steps;
function draw() {
  svg.replaceChildren();
  document.getElementById('now').textContent = steps.length ? steps[slider.value] : '';
  for (const layer of data.layers) {
    if (Object.entries(layer.groups).some(([k, v]) => hidden.has(k + '=' + v))) continue;
    if (layer.step !== null && layer.step !== steps[slider.value]) continue;
    for (const s of layer.shapes) {
      const at = s.at.map(mercator), one = at.length === 1, e = document.createElementNS(NS, one ? 'circle' : s.filled ? 'polygon' : 'polyline');
      if (one) { e.setAttribute('cx', at[0][0]); e.setAttribute('cy', at[0][1]); e.setAttribute('r', (s.size || 1) * pad / 12); }
      else e.setAttribute('points', at.map(p => p.join(',')).join(' '));
      e.setAttribute('fill', one || s.filled ? s.color : 'none');
      e.setAttribute('fill-opacity', s.opacity ?? 0.7);
      e.setAttribute('stroke', one || s.filled ? 'none' : s.color);
      e.setAttribute('stroke-width', pad / 10);
      const name = document.createElementNS(NS, 'title');
      name.textContent = s.label || layer.label;
      e.append(name);
      svg.append(e);
    }
  }
}
const groups = {};
for (const l of data.layers) for (const [k, v] of Object.entries(l.groups)) (groups[k] ??= new Map()).set(v, l.color);
for (const [k, values] of Object.entries(groups)) {
  const set = document.createElement('fieldset'), legend = document.createElement('legend');
  legend.textContent = k;
  set.append(legend);
  for (const [v, color] of values) {
    const label = document.createElement('label'), box = document.createElement('input'), dot = document.createElement('i');
    box.type = 'checkbox'; box.checked = true;
    box.onchange = () => { box.checked ? hidden.delete(k + '=' + v) : hidden.add(k + '=' + v); draw(); };
    dot.style.background = color || 'transparent';
    label.append(box, dot, v);
    set.append(label);
  }
  document.getElementById('groups').append(set);
}
slider.max = Math.max(0, steps.length - 1);
slider.hidden = !steps.length;
slider.oninput = draw;
draw();
"""


def map_page(title: str, layers: list[dict]) -> str:
    """A self-contained page with a map: layers are {label, groups: {kind: value}, color, step or None, shapes: [{at: [[lon, lat], ...],
    color, label, filled, opacity, size}]}. Every kind of group (date, route, ...) gets boxes to tick, steps (horizons) a slider. For
    results of report size, which it carries whole."""
    steps = list(dict.fromkeys(layer["step"] for layer in layers if layer.get("step") is not None))
    whole = [{"label": "", "groups": {}, "color": None, "step": None} | layer for layer in layers]
    style = "body{margin:0;display:flex;font:14px sans-serif}#side{width:16em;padding:1em}svg{flex:1;height:100vh;background:#f4f4f0}label{display:block}i{display:inline-block;width:.8em;height:.8em;margin:0 .4em}"
    body = "<div id='side'><h1></h1><input type='range' id='step' min='0' value='0'><span id='now'></span><div id='groups'></div></div><svg id='map'></svg>".replace("<h1></h1>", f"<h1>{html.escape(title)}</h1>")
    return f"<!doctype html><meta charset='utf-8'><title>{html.escape(title)}</title><style>{style}</style>{body}{_data({'layers': whole, 'steps': steps})}<script>{_MAP}</script>"


def route_layers(routes: DataFrame, limit: int = 100_000) -> list[dict]:
    """Layers of routes (dataset_slug, route_name, destination, geometry in lon/lat, maybe color and total_cost), one each; more than
    limit is an error, a page is no place for them."""
    rows = routes.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} routes for a page")
    out = []
    for r in rows:
        have = r.asDict()
        color = have.get("color") or "#1f77b4"
        label = f"{r['route_name']} {r['dataset_slug']} {r['destination']}" + (f": {have['total_cost']:.3f}" if have.get("total_cost") is not None else "")
        out.append({"label": label, "groups": {"date": r["dataset_slug"], "route": r["route_name"], "destination": r["destination"]}, "color": color, "step": None, "shapes": [{"at": [[p["x"], p["y"]] for p in r["geometry"]], "color": color}]})
    return out


def heat_layers(bins: DataFrame, limit: int = 100_000) -> list[dict]:
    """Layers of points (hours, lat, lon, intensity or count), one per horizon."""
    rows = bins.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} points for a page")
    by: dict = {}
    for r in rows:
        by.setdefault(r["hours"], []).append({"at": [[r["lon"], r["lat"]]], "color": "#d7191c", "opacity": float(r.asDict().get("intensity") or 0.7), "label": str(r["count"])})
    return [{"label": f"{h} h", "groups": {}, "color": "#d7191c", "step": f"{h} h", "shapes": by[h]} for h in sorted(by)]


def pies(title: str, shares: dict[str, dict[str, float]], colors: dict[str, str], size: int = 240) -> str:
    """An SVG of pies, one per name, whose slices are the parts' shares of its sum."""
    out = []
    for k, (name, parts) in enumerate(shares.items()):
        total, at, cx, cy, r = sum(parts.values()), 0.0, size * (k + 0.5), size * 0.6, size * 0.4
        for part, value in parts.items():
            share = value / total if total else 0.0
            if share <= 0:
                continue
            ends = [(cx + r * math.sin(2 * math.pi * t), cy - r * math.cos(2 * math.pi * t)) for t in (at, at + share)]
            path = f"M{cx:.2f} {cy:.2f}L{ends[0][0]:.2f} {ends[0][1]:.2f}A{r:.2f} {r:.2f} 0 {int(share > 0.5)} 1 {ends[1][0]:.2f} {ends[1][1]:.2f}Z"
            shape = f"<circle cx='{cx:.2f}' cy='{cy:.2f}' r='{r:.2f}'" if share > 1 - 1e-9 else f"<path d='{path}'"
            out.append(f"{shape} fill='{colors.get(part, '#888888')}'><title>{html.escape(part)} {share:.1%}</title></{'circle' if share > 1 - 1e-9 else 'path'}>")
            at += share
        out.append(f"<text x='{cx:.2f}' y='{size * 0.14:.2f}' text-anchor='middle'>{html.escape(name)}</text>")
    return _svg(title, size * max(1, len(shares)), int(size * 1.1), out)


def bars(title: str, values: dict[str, dict[str, float]], colors: dict[str, str], width: int = 900, height: int = 360) -> str:
    """An SVG of bars grouped by name, a series for each part, heights by the largest value."""
    top = max([v for parts in values.values() for v in parts.values()], default=0.0) or 1.0
    group, out = width / max(1, len(values)), []
    for k, (name, parts) in enumerate(values.items()):
        each = group * 0.8 / max(1, len(parts))
        for j, (part, v) in enumerate(parts.items()):
            tall = (height - 60) * v / top
            out.append(f"<rect x='{group * (k + 0.1) + each * j:.2f}' y='{height - 30 - tall:.2f}' width='{each * 0.9:.2f}' height='{tall:.2f}' fill='{colors.get(part, '#888888')}'><title>{html.escape(f'{name} {part}: {v:.3f}')}</title></rect>")
        out.append(f"<text x='{group * (k + 0.5):.2f}' y='{height - 10}' text-anchor='middle'>{html.escape(name)}</text>")
    return _svg(title, width, height, out)


def cells_image(title: str, cells: list[tuple[int, int, float]], side: int = 3) -> str:
    """An SVG of cells (column, row from the south, share from 0 to 1), the denser the darker."""
    rows = max((y for _, y, _ in cells), default=0) + 1
    out = [f"<rect x='{x * side}' y='{(rows - 1 - y) * side + 20}' width='{side}' height='{side}' fill='#7f0000' fill-opacity='{max(0.0, min(1.0, v)):.3f}'/>" for x, y, v in cells]
    return _svg(title, (max((x for x, _, _ in cells), default=0) + 1) * side, rows * side + 20, out)


def _svg(title: str, width: int, height: int, parts: list[str]) -> str:
    return f"<svg xmlns='http://www.w3.org/2000/svg' width='{width}' height='{height}' font-family='sans-serif' font-size='12'><title>{html.escape(title)}</title>{''.join(parts)}</svg>"


def write_text(spark, path: str, text: str) -> None:
    """A text file by Hadoop's file system, so that a path may lie in any store; an existing one is an error."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at, False)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
