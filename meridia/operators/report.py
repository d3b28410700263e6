"""HTML reports of small collected frames."""

from __future__ import annotations

import html
import math
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame

_STYLE = "nav{position:fixed;right:1em;top:1em;max-width:14em;font-size:13px}@media(prefers-color-scheme:dark){body{background:#181818;color:#ddd}}@media(max-width:90em){nav{position:static}}body{font:15px sans-serif;margin:2em;max-width:70em}table{border-collapse:collapse}td,th{border:1px solid #ccc;padding:.3em .6em;text-align:right}"


def shown(value: object, digits: int = 4) -> str:
    if value is None or isinstance(value, float) and not math.isfinite(value):
        return "N/A"
    return f"{value:.{digits}f}" if isinstance(value, float) else html.escape(str(value))


def table(frame: DataFrame, most: int = 500) -> str:
    """An HTML table; ``most`` is how long a table of a report may be, and it says where there is more."""
    rows = frame.limit(most).collect()
    more = _more(frame, len(rows), most)
    head = "".join(f"<th>{html.escape(c)}</th>" for c in frame.columns)
    body = "".join("<tr>" + "".join(f"<td>{shown(v)}</td>" for v in r) + "</tr>" for r in rows)
    return f"<table><tr>{head}</tr>{body}</table>{more}"


def _more(frame: DataFrame, shown: int, most: int) -> str:
    """A line that says how much of a frame isn't on the page; nothing if all is."""
    if shown < most:
        return ""
    total = frame.count()
    return f"<p class='cut'>{shown} of {total} rows shown</p>" if total > shown else ""


def rows_table(rows: Sequence[Mapping[str, object]]) -> str:
    """An HTML table of rows that are here already."""
    names = list(dict.fromkeys(k for r in rows for k in r))
    head = "".join(f"<th>{html.escape(c)}</th>" for c in names)
    body = "".join("<tr>" + "".join(f"<td>{shown(r.get(c))}</td>" for c in names) + "</tr>" for r in rows)
    return f"<table><tr>{head}</tr>{body}</table>"


#: Metrics that are shown as percentages.
RATES = frozenset("cagr ann_return ann_vol max_drawdown alpha var cvar ret vol total_return tracking_error avg_drawdown roll_vol".split())


def formatted(values: Mapping[str, object]) -> dict[str, str]:
    """Rates as percentages, other numbers with two digits, N/A for what isn't finite."""

    def one(name: str, value: object) -> str:
        if value is None or isinstance(value, float) and not math.isfinite(value):
            return "N/A"
        if not isinstance(value, float):
            return str(value)
        return f"{value:.2%}" if name in RATES else f"{value:.2f}"

    return {k: one(k, v) for k, v in values.items()}


def bar_chart(values: Mapping[str, float], width: int = 640, row: int = 22) -> str:
    """An SVG of horizontal bars, those below 0 to the left of the axis."""
    known = {k: v for k, v in values.items() if v is not None and math.isfinite(v)}
    if not known:
        return "<p>no data</p>"
    low, high = min(0.0, *known.values()), max(0.0, *known.values())
    span, room = (high - low) or 1.0, width - 160
    at = lambda v: 150 + (v - low) / span * room
    bars = [
        f'<text x="0" y="{i * row + 15}" font-size="12">{html.escape(k)}</text><rect x="{min(at(0), at(v)):.1f}" y="{i * row + 3}" width="{abs(at(v) - at(0)):.1f}" height="{row - 6}" fill="hsl({210 if v >= 0 else 0},60%,50%)"><title>{v:.4f}</title></rect>'
        for i, (k, v) in enumerate(known.items())
    ]
    return f'<svg viewBox="0 0 {width} {row * len(known)}" width="{width}">{"".join(bars)}</svg>'


def heatmap(frame: DataFrame, row: str, columns: Sequence[str], most: int = 500) -> str:
    """A table whose cells are shaded by their value, red below 0 and blue above."""
    rows = frame.orderBy(row).limit(most).collect()
    peak = max((abs(r[c]) for r in rows for c in columns if r[c] is not None and math.isfinite(r[c])), default=0.0) or 1.0

    def cell(v: float | None) -> str:
        if v is None or not math.isfinite(v):
            return "<td></td>"
        return f'<td style="background:hsla({210 if v >= 0 else 0},70%,50%,{abs(v) / peak:.2f})">{v:.3f}</td>'

    head = "".join(f"<th>{html.escape(c)}</th>" for c in columns)
    return f"<table><tr><th>{html.escape(row)}</th>{head}</tr>{''.join(f'<tr><th>{shown(r[row])}</th>' + ''.join(cell(r[c]) for c in columns) + '</tr>' for r in rows)}</table>"


def lines(frame: DataFrame, by: str, value: str, order: str = "date", most: int = 100_000) -> str:
    """A chart of a line a value of ``by``; ``most`` is how many points a report may draw, and it says where there are more."""
    out: dict[str, list[float]] = {}
    rows = frame.select(by, order, value).orderBy(by, order).limit(most).collect()
    for r in rows:
        out.setdefault(str(r[0]), []).append(r[2])
    return line_chart(out) + _more(frame, len(rows), most)


def bars(frame: DataFrame, name: str, value: str, most: int = 200) -> str:
    rows = frame.select(name, value).limit(most).collect()
    return bar_chart({str(r[0]): r[1] for r in rows}) + _more(frame, len(rows), most)


def _parts(frame: DataFrame, group: str, part: str, value: str, most: int) -> tuple[dict[str, dict[str, float]], list[str], str]:
    """Group to part to value, the parts' names in order, and what is to be said of rows that are left out."""
    rows = frame.select(group, part, value).orderBy(group, part).limit(most).collect()
    out: dict[str, dict[str, float]] = {}
    for r in rows:
        if r[2] is not None and math.isfinite(r[2]):
            out.setdefault(str(r[0]), {})[str(r[1])] = r[2]
    return out, sorted({p for x in out.values() for p in x}), _more(frame, len(rows), most)


def _colour(i: int) -> str:
    return f"hsl({i * 67 % 360},60%,50%)"


def _legend(names: Sequence[str]) -> str:
    return "".join(f'<span style="color:{_colour(i)}">&#9632; {html.escape(n)}</span> ' for i, n in enumerate(names))


def stacked_areas(frame: DataFrame, by: str, value: str, order: str = "date", most: int = 100_000, width: int = 640, height: int = 220) -> str:
    """Areas of each value of ``by`` on top of each other along ``order``; what a date doesn't have is 0."""
    at, names, more = _parts(frame, order, by, value, most)
    if not at:
        return "<p>no data</p>"
    tops = {d: sum(max(v, 0.0) for v in x.values()) for d, x in at.items()}
    peak, step = max(tops.values()) or 1.0, width / max(1, len(at) - 1)
    floor, areas = [0.0] * len(at), []
    for i, name in enumerate(names):
        roof = [f + max(x.get(name, 0.0), 0.0) for f, x in zip(floor, at.values(), strict=True)]
        edge = [*enumerate(roof), *reversed(list(enumerate(floor)))]
        points = " ".join(f"{x * step:.1f},{height - v / peak * height:.1f}" for x, v in edge)
        areas.append(f'<polygon fill="{_colour(i)}" points="{points}"><title>{html.escape(name)}</title></polygon>')
        floor = roof
    return f'<svg viewBox="0 0 {width} {height}" width="{width}">{"".join(areas)}</svg><p>{_legend(names)}</p>{more}'


def stacked_bars(frame: DataFrame, group: str, part: str, value: str, most: int = 5_000, width: int = 640, row: int = 22) -> str:
    """A bar of 100 % a group, cut into the shares of its parts; parts below 0 count by their size and are drawn lighter."""
    groups, names, more = _parts(frame, group, part, value, most)
    if not groups:
        return "<p>no data</p>"
    out, room = [], width - 160
    for k, (name, parts) in enumerate(groups.items()):
        total, left = sum(map(abs, parts.values())) or 1.0, 150.0
        out.append(f'<text x="0" y="{k * row + 15}" font-size="12">{html.escape(name)}</text>')
        for i, p in enumerate(names):
            if v := parts.get(p, 0.0):
                size = abs(v) / total * room
                out.append(f'<rect x="{left:.1f}" y="{k * row + 3}" width="{size:.1f}" height="{row - 6}" fill="{_colour(i)}" opacity="{1 if v > 0 else 0.4}"><title>{html.escape(p)}: {v:.4f}</title></rect>')
                left += size
    return f'<svg viewBox="0 0 {width} {row * len(groups)}" width="{width}">{"".join(out)}</svg><p>{_legend(names)}</p>{more}'


def pies(frame: DataFrame, group: str, part: str, value: str, most: int = 5_000, size: int = 150) -> str:
    """A pie a group: the shares of its parts that are above 0."""
    groups, names, more = _parts(frame, group, part, value, most)
    if not groups:
        return "<p>no data</p>"
    out, r = [], size / 2 - 5
    for name, parts in groups.items():
        held = {p: v for p, v in parts.items() if v > 0}
        total, turn, slices = sum(held.values()) or 1.0, 0.0, []
        for p, v in held.items():
            ends = [(size / 2 + r * math.sin(t), size / 2 - r * math.cos(t)) for t in (turn * 2 * math.pi, (turn + v / total) * 2 * math.pi)]
            turn += v / total
            title, colour = f"<title>{html.escape(p)}: {v:.4f}</title>", _colour(names.index(p))
            if v >= total * (1 - 1e-9):
                slices.append(f'<circle cx="{size / 2}" cy="{size / 2}" r="{r}" fill="{colour}">{title}</circle>')
            else:
                (x0, y0), (x1, y1) = ends
                slices.append(f'<path d="M{size / 2},{size / 2} L{x0:.1f},{y0:.1f} A{r},{r} 0 {int(v / total > 0.5)} 1 {x1:.1f},{y1:.1f} Z" fill="{colour}">{title}</path>')
        out.append(f'<figure style="display:inline-block;margin:.5em"><svg viewBox="0 0 {size} {size}" width="{size}">{"".join(slices)}</svg><figcaption>{html.escape(name)}</figcaption></figure>')
    return f"{''.join(out)}<p>{_legend(names)}</p>{more}"


def scatter(points: DataFrame, x: str, y: str, colour: str, *, curve: DataFrame | None = None, marks: DataFrame | None = None, most: int = 5_000, width: int = 640, height: int = 320) -> str:
    """Points on a colour scale from blue (least) to red (most), with a curve of the same columns and named marks (name, x, y)."""
    seen = points.select(x, y, colour).limit(most).collect()
    rows = [tuple(r) for r in seen if all(v is not None and math.isfinite(v) for v in r)]
    line = [tuple(r) for r in curve.select(x, y).orderBy(y).collect()] if curve is not None else []
    named = [tuple(r) for r in marks.select("name", x, y).collect()] if marks is not None else []
    both = [(a, b) for a, b, _ in rows] + line + [(a, b) for _, a, b in named]
    if not both:
        return "<p>no data</p>"
    (left, right), (low, high) = ((min(v), max(v)) for v in zip(*both, strict=True))
    place = lambda a, b: (10 + (a - left) / ((right - left) or 1.0) * (width - 20), height - 10 - (b - low) / ((high - low) or 1.0) * (height - 20))
    least, span = (min(r[2] for r in rows), (max(r[2] for r in rows) - min(r[2] for r in rows)) or 1.0) if rows else (0.0, 1.0)
    dots = "".join(f'<circle cx="{px:.1f}" cy="{py:.1f}" r="2" fill="hsl({240 * (1 - (c - least) / span):.0f},70%,50%)"/>' for a, b, c in rows for px, py in [place(a, b)])
    path = " ".join(f"{px:.1f},{py:.1f}" for a, b in line for px, py in [place(a, b)])
    labels = "".join(f'<text x="{px:.1f}" y="{py:.1f}" font-size="11">&#9670; {html.escape(str(n))}</text>' for n, a, b in named for px, py in [place(a, b)])
    drawn = f'<polyline fill="none" stroke="black" points="{path}"/>' if line else ""
    return f'<svg viewBox="0 0 {width} {height}" width="{width}">{dots}{drawn}{labels}</svg><p>{html.escape(x)} to the right, {html.escape(y)} upwards, colour: {html.escape(colour)}</p>{_more(points, len(seen), most)}'


def fan(bands: Sequence[Mapping[str, float]], outer: tuple[str, str], inner: tuple[str, str], middle: str, *, paths: Sequence[Sequence[float]] = (), width: int = 640, height: int = 220) -> str:
    """Two bands and the middle line over rows in order, with single paths in the background."""
    if not bands:
        return "<p>no data</p>"
    values = [r[c] for r in bands for c in outer] + [v for p in paths for v in p]
    low, span = min(values), (max(values) - min(values)) or 1.0
    at = lambda i, v: f"{i * width / max(1, len(bands) - 1):.1f},{height - (v - low) / span * height:.1f}"
    area = lambda pair, opacity: '<polygon fill="hsl(210,60%,50%)" opacity="{}" points="{}"/>'.format(opacity, " ".join([at(i, r[pair[1]]) for i, r in enumerate(bands)] + [at(i, bands[i][pair[0]]) for i in reversed(range(len(bands)))]))
    single = "".join(f'<polyline fill="none" stroke="#999" stroke-width="0.5" points="{" ".join(at(i, v) for i, v in enumerate(p))}"/>' for p in paths)
    return f'<svg viewBox="0 0 {width} {height}" width="{width}">{single}{area(outer, 0.25)}{area(inner, 0.4)}<polyline fill="none" stroke="hsl(210,80%,30%)" points="{" ".join(at(i, r[middle]) for i, r in enumerate(bands))}"/></svg>'


def failure(heading: str, why: Exception) -> tuple[str, str]:
    """A section that says what went wrong in the one it stands for."""
    return heading, f"<p class='failed'>This part failed: {html.escape(type(why).__name__)}: {html.escape(str(why)[:500])}</p>"


def line_chart(series: Mapping[str, Sequence[float]], width: int = 640, height: int = 220) -> str:
    """An SVG of lines over their row numbers."""
    values = [v for s in series.values() for v in s if v is not None and math.isfinite(v)]
    if not values:
        return "<p>no data</p>"
    low, span = min(values), (max(values) - min(values)) or 1.0
    lines = []
    for i, (name, s) in enumerate(series.items()):
        points = " ".join(f"{x * width / max(1, len(s) - 1):.1f},{height - (v - low) / span * height:.1f}" for x, v in enumerate(s) if v is not None and math.isfinite(v))
        lines.append(f'<polyline fill="none" stroke="hsl({i * 67 % 360},60%,40%)" points="{points}"><title>{html.escape(name)}</title></polyline>')
    return f'<svg viewBox="0 0 {width} {height}" width="{width}">{"".join(lines)}</svg>'


def page(title: str, sections: Sequence[tuple[str, str]]) -> str:
    """A page of (heading, HTML) sections; of those with the same heading the first stays."""
    first: dict[str, str] = {}
    for heading, body in sections:
        first.setdefault(heading, body)
    toc = "".join(f'<li><a href="#s{i}">{html.escape(h)}</a></li>' for i, h in enumerate(first))
    # headings are the contents, beside the text where there is room
    parts = "".join(f'<h2 id="s{i}">{html.escape(h)}</h2>{b}' for i, (h, b) in enumerate(first.items()))
    return f"<!DOCTYPE html><html><head><meta charset='utf-8'><title>{html.escape(title)}</title><style>{_STYLE}</style></head><body><h1>{html.escape(title)}</h1><nav><ul>{toc}</ul></nav>{parts}</body></html>"


def write(path: str, title: str, sections: Sequence[tuple[str, str]]) -> None:
    with open(path, "w", encoding="utf-8") as out:
        out.write(page(title, sections))
