"""Boxes, points and crop windows as column expressions; rounding is half to even."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from trackframe.functions.lets import let


def box(x: Column, y: Column, width: Column, height: Column) -> Column:
    return F.struct(x.cast("int").alias("x"), y.cast("int").alias("y"), width.cast("int").alias("width"), height.cast("int").alias("height"))


def centre(b: Column) -> Column:
    return F.struct((b["x"] + b["width"] / 2).alias("x"), (b["y"] + b["height"] / 2).alias("y"))


def area(b: Column) -> Column:
    return b["width"].cast("long") * b["height"]


def iou(a: Column, b: Column) -> Column:
    """Intersection over union, 0 without overlap or area."""
    side = lambda at, size: F.greatest(F.lit(0), F.least(a[at] + a[size], b[at] + b[size]) - F.greatest(a[at], b[at])).cast("long")
    common = side("x", "width") * side("y", "height")
    union = area(a) + area(b) - common
    return F.when((common > 0) & (union > 0), common / union).otherwise(F.lit(0.0))


def pixel_box(x_rel: Column, y_rel: Column, w_rel: Column, h_rel: Column, width: Column, height: Column) -> Column:
    """Relative to pixel coordinates; null where a side is not positive."""
    made = box(F.rint(x_rel * width), F.rint(y_rel * height), F.rint(w_rel * width), F.rint(h_rel * height))
    return F.when((made["width"] > 0) & (made["height"] > 0), made)


def pixel_points(points: Column, width: Column, height: Column) -> Column:
    return F.transform(points, lambda p: F.struct((p["x"] * width).alias("x"), (p["y"] * height).alias("y")))


def distance(a: Column, b: Column) -> Column:
    return F.sqrt((a["x"] - b["x"]) * (a["x"] - b["x"]) + (a["y"] - b["y"]) * (a["y"] - b["y"]))


# Mesh indices of the eyes' outer corners, the lips' middle and corners, and the lips' outline.
EYES, LIPS, CORNERS = (33, 263), (13, 14), (78, 308)
OUTLINE = (61, 146, 91, 181, 84, 17, 314, 405, 321, 375, 291, 409, 270, 269, 267, 0, 37, 39, 40, 185)


def mouth_shape(points: Column, eyes: tuple[int, int] = EYES, lips: tuple[int, int] = LIPS, corners: tuple[int, int] = CORNERS, outline: tuple[int, ...] = OUTLINE) -> Column:
    """(aperture, width, centre, contour, interocular) of mesh points; null if the eyes are less than a pixel apart."""
    at = lambda i: points[i]
    between = distance(at(eyes[0]), at(eyes[1]))
    upper, lower = at(lips[0]), at(lips[1])
    shape = F.struct(
        (distance(upper, lower) / between).alias("aperture"),
        (distance(at(corners[0]), at(corners[1])) / between).alias("width"),
        F.struct(((upper["x"] + lower["x"]) / 2).alias("x"), ((upper["y"] + lower["y"]) / 2).alias("y")).alias("centre"),
        F.array(*(at(i) for i in outline)).alias("contour"),
        between.alias("interocular"),
    )
    return F.when(between >= 1, shape)


def contour_box(contour: Column) -> Column:
    """The smallest box around points, rounded outwards, of at least one pixel."""
    low = {k: F.floor(F.array_min(F.transform(contour, lambda p: p[k]))) for k in "xy"}
    high = {k: F.ceil(F.array_max(F.transform(contour, lambda p: p[k]))) for k in "xy"}
    return box(low["x"], low["y"], F.greatest(F.lit(1), high["x"] - low["x"]), F.greatest(F.lit(1), high["y"] - low["y"]))


def mouth_box(point: Column, face: Column) -> Column:
    """A box about a mouth point, sized by the face."""
    w, h = F.greatest(F.lit(8.0), F.rint(face["width"] * 0.45)), F.greatest(F.lit(8.0), F.rint(face["height"] * 0.28))
    return box(F.rint(point["x"] - w / 2), F.rint(point["y"] - h / 2), w, h)


def fit_long_side(width: Column, height: Column, limit: int) -> Column:
    """Dimensions scaled so that the longer is at most ``limit``, at least one pixel each."""
    longest = F.greatest(width, height)
    scaled = lambda n: F.when(longest <= limit, n.cast("double")).otherwise(F.greatest(F.lit(1.0), F.rint(n * (F.lit(limit) / longest)))).cast("int")
    return F.struct(scaled(width).alias("width"), scaled(height).alias("height"))


def transform_points(points: Column, m: Column) -> Column:
    """Points under an affine map (a, b, tx, c, d, ty)."""
    return F.transform(points, lambda p: F.struct((m["a"] * p["x"] + m["b"] * p["y"] + m["tx"]).alias("x"), (m["c"] * p["x"] + m["d"] * p["y"] + m["ty"]).alias("y")))


def crop_window(x: Column, y: Column, size: int, width: Column, height: Column) -> Column:
    """Clipped bounds of a square crop, and how much each side must be padded."""
    half = size // 2
    low = {"x": F.rint(x - half), "y": F.rint(y - half)}
    high = {"x": F.rint(x + half), "y": F.rint(y + half)}
    limit = {"x": width, "y": height}
    parts = []
    for k in "xy":
        parts += [
            F.greatest(F.lit(0.0), low[k]).cast("int").alias(f"{k}0"),
            F.least(limit[k], high[k]).cast("int").alias(f"{k}1"),
            F.greatest(F.lit(0.0), -low[k]).cast("int").alias(f"pad_{k}0"),
            F.greatest(F.lit(0.0), high[k] - limit[k]).cast("int").alias(f"pad_{k}1"),
        ]
    return F.struct(*parts)


def similarity_fit(points: Column, reference: Column) -> Column:
    """Least-squares rotation, uniform scale and shift from ``points`` to ``reference``; null where the points coincide.

    Both are arrays of (x, y) of one length. Closed form from centred sums.
    """
    n = F.size(points)
    total = lambda a, f: F.aggregate(a, F.lit(0.0), lambda s, p: s + f(p))
    mean = lambda a, k: total(a, lambda p: p[k]) / n
    pairs = F.arrays_zip(points.alias("p"), reference.alias("q"))
    means = F.struct(mean(points, "x").alias("px"), mean(points, "y").alias("py"), mean(reference, "x").alias("qx"), mean(reference, "y").alias("qy"))

    def fitted(m: Column) -> Column:
        dx, dy = lambda z: z["p"]["x"] - m["px"], lambda z: z["p"]["y"] - m["py"]
        u, v = lambda z: z["q"]["x"] - m["qx"], lambda z: z["q"]["y"] - m["qy"]
        square = total(pairs, lambda z: dx(z) * dx(z) + dy(z) * dy(z))
        dot = total(pairs, lambda z: dx(z) * u(z) + dy(z) * v(z))
        cross = total(pairs, lambda z: dx(z) * v(z) - dy(z) * u(z))
        sums = F.struct(square.alias("square"), dot.alias("dot"), cross.alias("cross"))

        def solved(s: Column) -> Column:
            a, c = s["dot"] / s["square"], s["cross"] / s["square"]
            found = F.struct(a.alias("a"), (-c).alias("b"), (m["qx"] - a * m["px"] + c * m["py"]).alias("tx"), c.alias("c"), a.alias("d"), (m["qy"] - c * m["px"] - a * m["py"]).alias("ty"))
            return F.when(s["square"] > 1e-12, found)

        return let(sums, solved)

    return let(means, fitted)


def robust_fit(points: Column, reference: Column, n: int) -> Column:
    """The similarity of the pair of points whose median residual over all ``n`` is smallest, refitted on the points near it.

    Deterministic least median of squares: every pair is tried, the first of equal
    medians wins. Near are points within 2.5 robust deviations. Null where no pair is apart.
    """
    square = lambda m: F.transform(
        F.arrays_zip(transform_points(points, m).alias("p"), reference.alias("q")),
        lambda z: (z["p"]["x"] - z["q"]["x"]) * (z["p"]["x"] - z["q"]["x"]) + (z["p"]["y"] - z["q"]["y"]) * (z["p"]["y"] - z["q"]["y"]),
    )
    middle = lambda a: let(F.array_sort(a), lambda s: (F.element_at(s, (n + 1) // 2) + F.element_at(s, n // 2 + 1)) / 2)
    tried = [
        let(similarity_fit(F.array(points[i], points[j]), F.array(reference[i], reference[j])), lambda m, k=k: F.when(m.isNotNull(), F.struct(middle(square(m)).alias("median"), F.lit(k).alias("order"), m.alias("m"))))
        for k, (i, j) in enumerate((i, j) for i in range(n) for j in range(i + 1, n))
    ]

    def refitted(best: Column) -> Column:
        limit = F.greatest(best["median"] * (2.5 * 1.4826) ** 2, F.lit(1e-9))
        near = F.filter(F.arrays_zip(points.alias("p"), reference.alias("q"), square(best["m"]).alias("r")), lambda z: z["r"] <= limit)
        return let(near, lambda z: similarity_fit(z["p"], z["q"]))

    best = F.array_min(F.transform(F.filter(F.array(*tried), lambda x: x.isNotNull()), lambda x: x))
    return let(best, lambda b: F.when(b.isNotNull(), refitted(b)))


# Which of 68 face landmarks make the right eye, the left eye, the nose and the mouth (first, past the last).
GROUPS = ((36, 42), (42, 48), (31, 36), (48, 68))


def reference_points(landmarks: Column, groups: tuple[tuple[int, int], ...] = GROUPS, reference_size: int = 256, target_size: int = 256) -> Column:
    """The mean point of each group of landmarks, moved to the middle of a frame of ``target_size``."""
    shift = (reference_size - target_size) / 2
    mean = lambda part, k: F.aggregate(part, F.lit(0.0), lambda a, p: a + p[k]) / F.size(part) - shift
    parts = [F.slice(landmarks, a + 1, b - a) for a, b in groups]
    return F.array(*(F.struct(mean(part, "x").alias("x"), mean(part, "y").alias("y")) for part in parts))


def best_mouth_box(contour: Column, point: Column, face: Column) -> Column:
    """The measured box, else the approximate one."""
    return F.coalesce(F.when(contour.isNotNull(), contour_box(contour)), mouth_box(point, face))


def status_json(detected: Column, energy: Column, face: Column, mouth: Column, height: Column, width: Column) -> Column:
    """A frame's status as JSON; nulls stay, energy has four digits."""
    row = F.struct(detected.alias("mouth_detected"), F.bround(energy, 4).alias("energy"), face.alias("face_box"), mouth.alias("mouth_box"), height.alias("frame_height"), width.alias("frame_width"))
    return F.to_json(row, {"ignoreNullFields": "false"})
