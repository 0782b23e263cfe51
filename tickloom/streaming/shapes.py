"""Triangles and rectangles of a moving window, and the rows that leave them: keyed state, a bounded number of swings a key."""

from __future__ import annotations

from tickloom.streaming.keyed import Machine


def line(points: list[list[float]]) -> tuple[float, float, float]:
    """(slope, value at 0, correlation) of the least-squares line through (place, value); 0 where all values are equal."""
    n = len(points)
    mx, my = sum(p[0] for p in points) / n, sum(p[1] for p in points) / n
    xx, yy = sum((p[0] - mx) ** 2 for p in points), sum((p[1] - my) ** 2 for p in points)
    xy = sum((p[0] - mx) * (p[1] - my) for p in points)
    slope = xy / xx
    return slope, my - slope * mx, xy / (xx * yy) ** 0.5 if yy > 0 else 0.0


def shapes(window: int = 60, reach: int = 3, least: int = 30, past_line: float = 0.005, box: int = 50, narrow: int = 15, height: float = 0.1, touch: float = 0.005, past_box: float = 0.003, key: str = "symbol", order: str = "ts") -> Machine:
    """Breakouts from triangles and rectangles; rows (ts, high, low, close).

    A swing is a high above the `reach` rows before and not below the `reach` after, lows mirrored. Triangle: lines through at least two highs and two lows of the last `window`
    rows, the upper one falling, the lower one rising by more than a thousandth between them; a close `past_line` beyond a line's value at this row breaks out,
    aimed the lines' distance further, stopped at the other line. Rectangle: the range of the last `box` rows before this one, at least `narrow` of them, no higher
    than `height` of its top, with two rows within `touch` of each edge; a high or low `past_box` beyond breaks out, aimed the range
    further, stopped at the other edge. Gives ts, kind, direction, level, entry, target, stop, width in rows, touches, the correlations of the lines
    (null for rectangles) and sure: 100 times the weaker correlation, or 70. Rows with a null price are passed over.
    """

    def fresh() -> dict:
        return {"n": 0, "high": [], "low": [], "tops": [], "bottoms": []}

    def step(state: dict, row: tuple) -> list[tuple]:
        ts, high, low, close = row
        if high is None or low is None or close is None:
            return []
        i = state["n"]
        state["n"] = i + 1
        out = []
        tops, bottoms = state["high"][-box:], state["low"][-box:]
        for values, value, swings, sign in ((state["high"], high, state["tops"], 1), (state["low"], low, state["bottoms"], -1)):
            values.append(value)
            del values[: -max(box, 2 * reach + 1)]
            part = values[-2 * reach - 1 :]
            if len(part) == 2 * reach + 1 and all(v * sign < part[reach] * sign for v in part[:reach]) and all(v * sign <= part[reach] * sign for v in part[reach + 1 :]):
                swings.append([i - reach, part[reach]])
            while swings and swings[0][0] <= i - window:
                swings.pop(0)
        if i + 1 >= least and len(state["tops"]) >= 2 and len(state["bottoms"]) >= 2:
            (fall, a, high_r), (rise, b, low_r) = line(state["tops"]), line(state["bottoms"])
            if fall < 0 < rise and rise - fall > 0.001:
                top, bottom = fall * i + a, rise * i + b
                width = int(i - min(state["tops"][0][0], state["bottoms"][0][0]))
                common = (width, len(state["tops"]) + len(state["bottoms"]), high_r, low_r, min(abs(high_r), abs(low_r)) * 100)
                if close > top * (1 + past_line):
                    out.append((ts, "triangle", "UP", top, close, top + (top - bottom), bottom, *common))
                elif close < bottom * (1 - past_line):
                    out.append((ts, "triangle", "DOWN", bottom, close, bottom - (top - bottom), top, *common))
        if len(tops) >= narrow:
            top, bottom = max(tops), min(bottoms)
            touches = [sum(v >= top * (1 - touch) for v in tops), sum(v <= bottom * (1 + touch) for v in bottoms)]
            if top > 0 and (top - bottom) / top <= height and min(touches) >= 2:
                common = (len(tops), sum(touches), None, None, 70.0)
                if high > top * (1 + past_box):
                    out.append((ts, "rectangle", "UP", top, close, top + (top - bottom), bottom, *common))
                elif low < bottom * (1 - past_box):
                    out.append((ts, "rectangle", "DOWN", bottom, close, bottom - (top - bottom), top, *common))
        return out

    gives = f"`{order}` timestamp_ntz, kind string, direction string, level double, entry double, target double, stop double, width long, touches long, high_r double, low_r double, sure double"
    return Machine(("high", "low", "close"), gives, fresh, step, key, order)
