"""SVG pages of aggregated results: data set, models, sessions and the field of one response.

What is drawn comes to the driver as one row for each session or model, and the drawn stretch of one
trace; rows are reduced by Spark before. Pages grow with the number of their entries, none is left out.
"""

from __future__ import annotations

import html
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from photonloom.operators.splits import GlobalSplit

ROW, HEAD, WIDE = 22, 58, 460
_STYLE = "text{font:12px sans-serif}.h{font-size:16px}.n{fill:#666}.up{fill:#2a78a8}.down{fill:#c0623a}.train{fill:#2a78a8}.validation{fill:#e0a030}.test{fill:#4f9a58}.same{fill:#9cc4dd}.box{fill:none;stroke:#999}.a{fill:none;stroke:#999}.b{fill:none;stroke:#2a78a8;stroke-width:2}"


@dataclass
class Panel:
    """A titled part of a page; y of what is put in counts from below the title."""

    title: str
    note: str = ""
    width: int = WIDE
    height: int = 0
    parts: list[str] = field(default_factory=list)

    def grown(self, y: float) -> None:
        self.height = max(self.height, int(y))

    def text(self, x: float, y: float, s: str) -> None:
        self.parts.append(f'<text x="{x:.1f}" y="{y:.1f}">{html.escape(s)}</text>')
        self.grown(y + 6)

    def rect(self, x: float, y: float, w: float, h: float, kind: str, tip: str = "") -> None:
        self.parts.append(f'<rect class="{kind}" x="{x:.1f}" y="{y:.1f}" width="{w:.1f}" height="{h:.1f}"><title>{html.escape(tip)}</title></rect>')
        self.grown(y + h + 6)

    def curve(self, xs: list[float], ys: list[float], box: tuple[float, float, float, float], low: float, high: float, kind: str) -> None:
        """A line scaled to the box by the ends of xs and by low and high."""
        left, top, w, h = box
        span, rise = (xs[-1] - xs[0] if xs else 0.0) or 1.0, (high - low) or 1.0
        points = " ".join(f"{left + w * (x - xs[0]) / span:.1f},{top + h * (high - y) / rise:.1f}" for x, y in zip(xs, ys))
        self.parts.append(f'<polyline class="{kind}" points="{points}"/>')
        self.grown(top + h + 6)

    def bars(self, values: list[tuple[str, float | None]], digits: int = 2, least: float = 0.0) -> "Panel":
        """One bar an entry from a common zero, to the left for negative values; the scale spans at least least on both sides."""
        known = [v for _, v in values if v is not None]
        low, high = min([0.0, -least, *known]), max([0.0, least, *known])
        names, room = 150, self.width - 230
        at = lambda v: names + room * (v - low) / ((high - low) or 1.0)
        for k, (name, v) in enumerate(values):
            self.text(0, k * ROW + 12, name)
            if v is not None:
                self.rect(min(at(0), at(v)), k * ROW + 1, abs(at(v) - at(0)), ROW - 8, "down" if v < 0 else "up", name)
            self.text(self.width - 70, k * ROW + 12, "undefined" if v is None else f"{v:,.{digits}f}")
        if low < 0:
            self.parts.append(f'<line class="box" x1="{at(0):.1f}" x2="{at(0):.1f}" y1="0" y2="{len(values) * ROW}"/>')
        return self


def page(title: str, panels: list[Panel], columns: int = 2) -> str:
    """The panels in rows, each row as high as its highest panel."""
    out, y, widest = [], 50, 0
    for first in range(0, len(panels), columns):
        x, row = 20, panels[first : first + columns]
        for p in row:
            out.append(f'<g transform="translate({x},{y})"><text class="h" y="14">{html.escape(p.title)}</text><text class="n" y="34">{html.escape(p.note)}</text><g transform="translate(0,{HEAD - 12})">{"".join(p.parts)}</g></g>')
            x += p.width + 30
        widest, y = max(widest, x), y + HEAD + max(p.height for p in row) + 14
    return f'<svg xmlns="http://www.w3.org/2000/svg" width="{widest}" height="{y}"><style>{_STYLE}</style><rect width="100%" height="100%" fill="#fff"/><text class="h" x="20" y="28">{html.escape(title)}</text>{"".join(out)}</svg>'


def dataset_page(title: str, facts: DataFrame, split: GlobalSplit, updates: int, stimuli: DataFrame, responsive: DataFrame, by: str = "fly") -> str:
    """Eight panels of a data set.

    facts is of dataset_diagnostics, stimuli (by, digest) tells what each session was shown, and responsive
    (by, selected) has a row for each response. A session missing in one of them has an undefined entry.
    """
    rows = facts.orderBy(by).collect()
    shown = {r[by]: r.digest for r in stimuli.groupBy(by).agg(F.max("digest").alias("digest")).collect()}
    chosen = {r[by]: r.share for r in responsive.groupBy(by).agg(F.avg(F.col("selected").cast("double")).alias("share")).collect()}
    of = lambda name: [(str(r[by]), None if r[name] is None else float(r[name])) for r in rows]
    panels = [
        Panel("Observations", "rows of all responses").bars(of("observations"), 0),
        Panel("Responses", "distinct in each session").bars(of("rois"), 0),
        Panel("Response scale", "median spread on training rows").bars(of("median_train_sd"), 3),
        Panel("Drift", "median change from the first to the last quarter of training rows").bars(of("median_drift"), 3),
        Panel("Responsive share", "chosen on training rows").bars([(str(r[by]), chosen.get(r[by])) for r in rows], 2, 0.0),
    ]
    blocks = Panel("Split", "blocks of updates common to all sessions; gaps keep histories apart")
    for k, (name, (start, stop)) in enumerate((n, b) for n, b in split.intervals().items() if not n.startswith("purge")):
        blocks.rect(WIDE * start / max(updates, 1), 4, WIDE * (stop - start) / max(updates, 1), 28, name, f"{name} {start} to {stop}")
        blocks.text(150 * k, 54, f"{name} {start:,} to {stop:,}")
    common = shown.get(rows[0][by]) if rows else None
    same = Panel("Stimulus", "sessions that saw the updates of the first one")
    for k, r in enumerate(rows):
        same.text(0, k * ROW + 12, str(r[by]))
        alike = common is not None and shown.get(r[by]) == common
        same.rect(150, k * ROW + 1, WIDE - 230, ROW - 8, "same" if alike else "down", str(shown.get(r[by])))
        same.text(WIDE - 70, k * ROW + 12, "same" if alike else "differs" if r[by] in shown else "undefined")
    tree = Panel("Hierarchy", "what holds what")
    counts = (len({v for v in shown.values() if v is not None}), "stimuli"), (len(rows), "sessions"), (sum(r.rois for r in rows), "responses"), (sum(r.observations for r in rows), "observations")
    for k, (n, what) in enumerate(counts):
        tree.text(20 * k, k * ROW + 12, f"{n:,} {what}")
    return page(title, [*panels, blocks, same, tree])


def model_page(title: str, models: DataFrame, model: str = "model", r2: str = "median_r2") -> str:
    """Held-out scores of models by falling score, negative ones included; models without a score come last, as undefined."""
    rows = models.select(model, r2).orderBy(F.desc_nulls_last(r2), model).collect()
    return page(title, [Panel("Held-out R²", "zero predicts the mean of the test rows", 860).bars([(str(r[0]), r[1]) for r in rows], 3, 0.1)], 1)


def session_page(title: str, scores: DataFrame, by: str = "session", r2: str = "median_r2", members: str = "members", note: str = "median over responses") -> str:
    """Held-out scores of a model by session, with the number of responses, or of members of a population target."""
    rows = scores.select(by, members, r2).orderBy(by).collect()
    return page(title, [Panel("Held-out R² by session", note, 760).bars([(f"{r[0]} ({r[1]})", r[2]) for r in rows], 3, 0.1)], 1)


def response_page(title: str, pixel: tuple[int, int], shape: tuple[int, int], weights: list[float], step: float, trace: DataFrame) -> str:
    """The field of one response: its pixel, its filter in time, and the recorded and predicted trace.

    trace has (seconds, y, projection), step is the seconds between two weights.
    """
    rows = trace.orderBy("seconds").collect()
    where = Panel("Pixel", f"row {pixel[0]}, column {pixel[1]}", 220)
    cell = 200 / max(shape)
    where.rect(0, 0, cell * shape[1], cell * shape[0], "box")
    where.rect(cell * pixel[1], cell * pixel[0], cell, cell, "up", "chosen on training rows")
    kernel = Panel("Filter", f"weights at 0 to {step * max(0, len(weights) - 1):.2f} s after an update", 280)
    kernel.rect(0, 0, 270, 200, "box")
    kernel.curve([step * k for k in range(len(weights))], weights, (0, 0, 270, 200), min([0.0, *weights]), max([0.0, *weights]), "b")
    held = Panel("Held-out response", "grey recorded, blue predicted", 460)
    held.rect(0, 0, 450, 200, "box")
    both = [v for r in rows for v in (r.y, r.projection)]
    for name, kind in (("y", "a"), ("projection", "b")):
        held.curve([r.seconds for r in rows], [r[name] for r in rows], (0, 0, 450, 200), min(both, default=0.0), max(both, default=1.0), kind)
    return page(title, [where, kernel, held], 3)
