"""A small building drawn at a known scale."""

K = 14.17  # points per metre


def plan(plan_id="p", more=False):
    """``more``: a raft named by a stamp beside the building, a hatched wall between border lines, a bent wall, a wall in
    two touching pieces, and an expansion joint."""
    paths, texts = [], []

    def rect_items(x0, y0, x1, y1):
        return [{"kind": "re", "pts": [{"x": x * K, "y": y * K} for x, y in ((x0, y0), (x1, y0), (x1, y1), (x0, y1))]}]

    def add(kind, items, pen=0.5):
        pts = [p for i in items for p in i["pts"]]
        r = {"x0": min(p["x"] for p in pts), "y0": min(p["y"] for p in pts), "x1": max(p["x"] for p in pts), "y1": max(p["y"] for p in pts)}
        paths.append((plan_id, len(paths), kind, kind != "s", pen, r, items))

    def line(ax, ay, bx, by, pen=0.5):
        add("s", [{"kind": "l", "pts": [{"x": ax * K, "y": ay * K}, {"x": bx * K, "y": by * K}]}], pen)

    def text(s, cx, cy, w=1.2, h=0.3):
        texts.append((plan_id, len(texts), s, {"x0": (cx - w / 2) * K, "y0": (cy - h / 2) * K, "x1": (cx + w / 2) * K, "y1": (cy + h / 2) * K}))

    for i in range(6):
        for j in range(4):
            x, y = 8 * i, 8 * j
            add("f", rect_items(x, y, x + 0.5, y + 0.4))
            text("P1/128", x + 0.25, y - 0.35)
            add("s", rect_items(x - 1.0, y - 0.9, x + 1.5, y + 1.3), 0.3)
            text("S7 (250x220x60)", x + 0.25, y + 1.33)
    for i in range(5):
        add("f", rect_items(8 * i + 2.5, 3.0, 8 * i + 6.0, 3.25))
        if i < 4:
            text("V3/128", 8 * i + 4.0, 3.1)
    for j in range(4):  # beams: two lines 0.40 m apart
        for y in (8 * j + 4.5, 8 * j + 4.9):
            line(1, y, 39, y, 0.7)
        text("LG-40x15", 20, 8 * j + 4.7)
        text("LG-40x15", 30, 8 * j + 4.7)
    for n in range(14):  # dimension lines, each carrying its value, drawn a little shorter
        value = 2 + 0.75 * n
        y = 40 + n
        line(0, y, value - 3.0 / K, y, 0.1)
        text(f"{value:.2f}".replace(".", ","), value / 2, y - 0.1, 0.8, 0.3)
    if more:
        corners = [(50, 5), (58, 5), (58, 13), (50, 13)]
        for (ax, ay), (bx, by) in zip(corners, corners[1:] + corners[:1]):
            line(ax, ay, bx, by, 0.4)
        circle = [{"kind": "c", "pts": [{"x": (54 + 0.4 * x) * K, "y": (9 + 0.4 * y) * K} for x, y in q]} for q in ([(1, 0), (1, 0.55), (0.55, 1), (0, 1)], [(0, 1), (-1, 0.55), (-1, 0), (0, -1)])]
        add("s", circle, 0.2)
        for x, y in corners:
            line(54 + (x - 54) * 0.1, 9 + (y - 9) * 0.1, x, y, 0.2)
        text("Radier 60 CM", 54, 9.05)
        for y in (34.0, 34.3):  # a hatched wall
            line(8, y, 14, y, 0.6)
        for i in range(118):
            x = 8.05 + 0.05 * i
            line(x, 34.02, x + 0.05, 34.28, 0.15)
        bent = [(20, 34), (26, 34), (26, 34.25), (20.25, 34.25), (20.25, 38), (20, 38)]
        add("f", [{"kind": "l", "pts": [{"x": a * K, "y": b * K}, {"x": c * K, "y": d * K}]} for (a, b), (c, d) in zip(bent, bent[1:] + bent[:1])])
        add("f", rect_items(30, 34, 32, 34.25))
        add("f", rect_items(32, 34, 34, 34.25))
        for x in (19.0, 19.08):
            line(x, -1.5, x, 26, 0.9)
    return paths, texts
