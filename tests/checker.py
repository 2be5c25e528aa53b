"""The rules of detection and repair restated row by row, for tests only.

Pings are dicts of one vehicle in time order.
"""

import math
import statistics


def drop_rows(rows, threshold=100):
    found = []
    for i in range(1, len(rows)):
        a, b = rows[i - 1]["distanz"], rows[i]["distanz"]
        if a is not None and b is not None and b - a < -threshold:
            found.append(i)
    return found


def window_size(vehicles, threshold=100):
    gaps = []
    for rows in vehicles:
        d = drop_rows(rows, threshold)
        gaps += [b - a for a, b in zip(d, d[1:])]
    if not gaps:
        return 5
    return int(min(10, max(3, statistics.median(gaps) / 2)))


def turns(rows, first, last, lax=False):
    """(row, kind) of door turns into rows first..last."""
    for i in range(max(first, 1), last + 1):
        a, b = rows[i - 1]["door"], rows[i]["door"]
        if a is False and b is True:
            yield i, "open"
        if a is True and (b is False or (lax and b is None)):
            yield i, "close"


def detect(rows, n, threshold=100):
    d = drop_rows(rows, threshold)
    events = []
    for k, row in enumerate(d):
        lo, hi = max(0, row - n), min(len(rows) - 1, row + n)
        if k > 0:
            lo = max(lo, d[k - 1] + 1)
        if k + 1 < len(d):
            hi = min(hi, d[k + 1] - 1)
        opens, closes, last_close = [], 0, None
        for i, kind in turns(rows, lo + 1, hi):
            if kind == "open":
                opens.append(i)
            else:
                closes += 1
                if opens:
                    last_close = i
        near = any(rows[i]["door"] for i in (row - 1, row, row + 1) if 0 <= i < len(rows))
        multi = len(opens) >= 2 and len({r["trip"] for r in rows[lo : hi + 1]}) == 1
        if multi:
            for a, b in zip(opens, opens[1:]):
                between = [rows[i]["distanz"] for i in range(a, b + 1)]
                steps = [q - p for p, q in zip(between, between[1:])]
                if min(steps) < -30 or max(between) - min(between) >= threshold:
                    multi = False
        arrival = rows[opens[0]]["ts"] if opens else rows[row]["ts"]
        departure = rows[last_close]["ts"] if last_close is not None else arrival
        if not opens and not near:
            status = "no_door"
        elif len(opens) >= 2 and multi:
            status = "multi_door"
        else:
            status = "normal"
        events.append(
            {"row": row, "lo": lo, "hi": hi, "opens": len(opens), "closes": closes, "near": near, "multi": multi,
             "arrival": arrival, "departure": departure, "status": status, "drop_time": rows[row]["ts"]}
        )
    return events


def rescue(rows, events):
    d = [e["row"] for e in events]
    out = []
    for k, e in enumerate(events):
        e = dict(e)
        first = d[k - 1] + 1 if k > 0 else 0
        last = d[k + 1] - 1 if k + 1 < len(d) else len(rows) - 1
        if e["status"] != "no_door" and e["arrival"] == e["departure"]:
            if e["arrival"] == e["drop_time"]:
                opened = closed = None
                for i, kind in turns(rows, first + 1, last, lax=True):
                    if kind == "open" and opened is None:
                        opened = i
                    if kind == "close" and opened is not None:
                        closed = i
                if opened is None:
                    e["status"] = "no_door"
                else:
                    e["arrival"] = rows[opened]["ts"]
                    e["departure"] = rows[closed if closed is not None else opened]["ts"]
            else:
                at = max(i for i, r in enumerate(rows) if r["ts"] == e["arrival"])
                open_, closed = True, None  # the door counts as open at the end of that instant
                for i in range(at + 1, last + 1):
                    if open_ and not rows[i]["door"]:
                        closed = i
                    open_ = rows[i]["door"]
                if closed is not None:
                    e["departure"] = rows[closed]["ts"]
        out.append(e)
    return out


def quantile(values, q):
    values = sorted(values)
    at = q * (len(values) - 1)
    low, high = math.floor(at), math.ceil(at)
    return values[low] + (values[high] - values[low]) * (at - low)
