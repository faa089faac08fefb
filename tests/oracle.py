"""Step-by-step versions in plain Python that the Column expressions are held against."""

import math


def line(x, y, x2, y2):
    """Walks the longer side, stepping the shorter one whenever the running remainder is full."""
    w, h = x2 - x, y2 - y
    n, m = max(abs(w), abs(h)), min(abs(w), abs(h))
    sx, sy = (w > 0) - (w < 0), (h > 0) - (h < 0)
    flat = abs(w) > abs(h)
    rest, out = n >> 1, []
    for _ in range(n + 1):
        out.append((x, y))
        rest += m
        both = n and rest >= n
        if both:
            rest -= n
        if flat or both:
            x += sx
        if not flat or both:
            y += sy
    return out


def project(lon, lat, z, r):
    n = 2**z
    x = int((lon + 180) / 360 * n)
    phi = math.radians(lat)
    y = int((1 - math.log(math.tan(phi) + 1 / math.cos(phi)) / math.pi) / 2 * n)
    top = math.degrees(math.atan(math.sinh(math.pi - 2 * math.pi * y / n)))
    bottom = math.degrees(math.atan(math.sinh(math.pi - 2 * math.pi * (y + 1) / n)))
    left = x / n * 360 - 180
    return x, y, int((lon - left) / (360 / n / r)), int((top - lat) / ((top - bottom) / r))
