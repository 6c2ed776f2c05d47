"""A plain-Python model of page sorting, one page at a time, to hold the DataFrame form against."""

from __future__ import annotations

import math

A = {"question type", "question number", "second_question_number"}
C = {"question text", "list", "choices", "figure", "table", "flowchart"}
V = {"figure", "table", "flowchart"}


def cx(e):
    return e["x"] + e["w"] / 2


def cy(e):
    return e["y"] + e["h"] / 2


def two_means(values):
    v = sorted(values)
    n, total = len(v), sum(v)
    best, left = None, 0.0
    for k in range(1, n):
        left += v[k - 1]
        score = round(left * left / k + (total - left) ** 2 / (n - k), 6)
        if best is None or score > best[0]:
            best = score, left / k, (total - left) / (n - k)
    return best and best[1:]


def pstd(v):
    m = sum(v) / len(v)
    return math.sqrt(sum((x - m) ** 2 for x in v) / len(v))


def detect(elements, width, height):
    anchors = [e for e in elements if e["c"] in A]
    if len(anchors) < 2:
        return "STANDARD_1_COLUMN"
    if any(e["c"] == "question type" and e["y"] < 0.15 * height and width > 0 and e["w"] / width >= 0.8 for e in elements):
        return "HORIZONTAL_SEP_PRESENT"
    xs = [cx(a) for a in anchors]
    c = two_means(xs)
    if len(set(xs)) < 2 or c[1] - c[0] < 50:
        return "STANDARD_1_COLUMN"
    top, bottom = [cx(a) for a in anchors if cy(a) < 0.4 * height], [cx(a) for a in anchors if cy(a) >= 0.4 * height]
    if not top or not bottom:
        return "STANDARD_2_COLUMN"
    many = lambda s: len(s) > 1 and pstd(s) > 0.1 * width
    return {(0, 1): "MIXED_TOP1_BOTTOM2", (1, 0): "MIXED_TOP2_BOTTOM1", (1, 1): "STANDARD_2_COLUMN", (0, 0): "UNKNOWN"}[int(many(top)), int(many(bottom))]


def by_separator(z, elements):
    seps = [e for e in elements if e["c"] == "question type" and z[2] - z[0] > 0 and e["w"] / (z[2] - z[0]) >= 0.8]
    if not seps:
        return None
    s = min(seps, key=lambda e: (e["y"], e["id"]))
    if not (z[1] < s["y"] < z[3]) or s["y"] + s["h"] >= z[3]:
        return None
    rest = [e for e in elements if e is not s]
    return [((z[0], z[1], z[2], s["y"]), [e for e in rest if cy(e) < cy(s)]), s, ((z[0], s["y"] + s["h"], z[2], z[3]), [e for e in rest if cy(e) >= cy(s)])]


def by_gap(z, elements):
    a = sorted((e for e in elements if e["c"] in A), key=lambda e: (e["y"], e["id"]))
    if len(a) < 2:
        return None
    hs = [e["h"] for e in a if e["h"] > 0]
    gaps = [cy(q) - cy(p) for p, q in zip(a, a[1:], strict=False)]
    k = gaps.index(max(gaps))
    if gaps[k] < max(1.5 * (sum(hs) / len(hs) if hs else 30), 100):
        return None
    y = (a[k]["y"] + a[k]["h"] + a[k + 1]["y"]) / 2
    if not z[1] < y < z[3]:
        return None
    return [((z[0], z[1], z[2], int(y)), [e for e in elements if cy(e) < y]), ((z[0], int(y), z[2], z[3]), [e for e in elements if cy(e) >= y])]


def by_columns(z, elements):
    xs = [cx(e) for e in elements if e["c"] in A]
    if len(set(xs)) < 2:
        return None
    c = two_means(xs)
    g = c[1] - 20
    if c[1] - c[0] < 50 or not z[0] < g < z[2]:
        return None
    return [((z[0], z[1], int(g), z[3]), [e for e in elements if cx(e) < g]), ((int(g), z[1], z[2], z[3]), [e for e in elements if cx(e) >= g])]


def reassign(groups):
    moves = {}
    for i, g in enumerate(groups):
        if not g[0]:
            continue
        for ch in g[1]:
            if ch["c"] not in V:
                continue
            d, best = ch["y"] - g[0]["y"], None
            for j in (i + 1, i + 2):
                if j < len(groups) and groups[j][0]:
                    e = abs(ch["y"] - groups[j][0]["y"])
                    if d > 75 and e < 0.5 * d and (best is None or e <= best[0]):
                        best = e, j
            if best:
                moves[ch["id"]] = best[1], ch
    for g in groups:
        g[1][:] = [c for c in g[1] if c["id"] not in moves]
    for j, ch in moves.values():
        groups[j][1].append(ch)
    return groups


def base_case(z, elements, mixed):
    anchors = sorted((e for e in elements if e["c"] in A), key=lambda e: (e["y"], e["id"]))
    children = sorted((e for e in elements if e["c"] in C), key=lambda e: e["id"])
    owner = {}
    if not mixed:
        for a in anchors:
            best = None
            for c in children:
                if c["id"] in owner:
                    continue
                dy = abs(cy(a) - cy(c))
                if dy >= (a["h"] + c["h"]) / 2 * 0.7:
                    continue
                if (abs(c["x"] - a["x"] - a["w"]) < 50 or abs(a["x"] - c["x"] - c["w"]) < 50) and (best is None or dy < best[0]):
                    best = dy, c["id"]
            if best:
                owner[best[1]] = a["id"]
        for c in children:
            if c["id"] in owner or not anchors:
                continue
            if c["y"] < z[1] + 0.15 * (z[3] - z[1]) and cy(c) < anchors[0]["y"] - 125:
                continue
            best = None
            for a in anchors:
                if cy(c) < cy(a):
                    continue
                d = math.sqrt((0.2 * (cx(c) - cx(a))) ** 2 + (cy(c) - cy(a)) ** 2)
                if best is None or d < best[0]:
                    best = d, a["id"]
            if best and best[0] < 250:
                owner[c["id"]] = best[1]
    order = sorted(anchors + [c for c in children if c["id"] not in owner], key=lambda e: (e["y"], e["x"], e["c"] not in A, e["id"]))
    limit = z[1] + (z[3] - z[1]) * (0.4 if mixed else 0.15)
    kids, top, bottom, last = {a["id"]: [] for a in anchors}, [], [], None
    for e in order:
        if e["c"] in A:
            if last is None:
                kids[e["id"]] += bottom
                bottom = []
            last = e
        elif last is not None:
            kids[last["id"]].append(e)
        elif (cy(e) if mixed else e["y"]) < limit:
            top.append(e)
        else:
            bottom.append(e)
    for c in children:
        if c["id"] in owner:
            kids[owner[c["id"]]].append(c)
    groups = [(a, kids[a["id"]]) for a in anchors] + [(None, g) for g in (top, bottom) if g]
    groups.sort(key=lambda g: (g[0]["y"], g[0]["x"], 1, g[0]["id"]) if g[0] else (min(c["y"] for c in g[1]), -1, 0, 0))
    return reassign(groups)


def recurse(z, elements, kind, depth=0):
    if not elements:
        return []
    if kind == "STANDARD_2_COLUMN":
        parts = by_columns(z, elements)
        return sum((base_case(zz, ee, False) for zz, ee in parts), []) if parts else base_case(z, elements, False)
    ways = {"STANDARD_1_COLUMN": []}.get(kind, [by_gap, by_separator, by_columns] if kind.startswith("MIXED") else [by_separator, by_columns, by_gap])
    for way in ways if len(elements) > 1 else []:
        if parts := way(z, elements):
            out = []
            for p in parts:
                if isinstance(p, dict):
                    out.append((p, []))
                else:
                    out += recurse(p[0], p[1], detect(p[1], p[0][2] - p[0][0], p[0][3] - p[0][1]) if p[1] else "UNKNOWN", depth + 1)
            return out
    return base_case(z, elements, kind.startswith("MIXED"))


def sort_page(elements, width, height):
    """[(element id, group, order in group)] in reading order."""
    kept = [e for e in elements if e["c"] in A | C and e["w"] * e["h"] > 0]
    groups = recurse((0, 0, width, height), kept, detect(kept, width, height))
    anchored = reassign([g for g in groups if g[0]])
    orphans = sorted((g for g in groups if not g[0]), key=lambda g: min(c["y"] for c in g[1]))
    out = []
    for k, (a, ch) in enumerate(orphans + anchored):
        for i, e in enumerate(([a] if a else []) + sorted(ch, key=lambda e: (e["y"], e["x"], e["id"]))):
            out.append((e["id"], k, i))
    return out
