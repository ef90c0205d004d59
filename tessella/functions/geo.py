"""Directions on the sphere and the icosahedron around it."""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessella.functions.binding import let


def _icosahedron() -> tuple[list[tuple[float, float, float]], list[tuple[int, int, int]]]:
    """Unit vertices by the golden-ratio rectangles, and the 20 triples of mutually nearest vertices in rising order."""
    g = (1 + math.sqrt(5)) / 2
    n = math.sqrt(1 + g * g)
    corners = [(a / n, b * g / n) for a in (-1, 1) for b in (-1, 1)]
    vertices = [v for a, b in corners for v in ((0.0, a, b), (a, b, 0.0), (b, 0.0, a))]
    edge = min(math.dist(vertices[0], v) for v in vertices[1:]) * 1.001
    faces = [f for f in itertools.combinations(range(12), 3) if all(math.dist(vertices[i], vertices[j]) < edge for i, j in itertools.combinations(f, 2))]
    return vertices, faces


VERTICES, FACES = _icosahedron()
#: Unit vectors to the middles of the faces.
CENTROIDS = [tuple(sum(VERTICES[i][k] for i in f) / math.dist((0, 0, 0), [sum(VERTICES[i][q] for i in f) for q in range(3)]) for k in range(3)) for f in FACES]


def to_xyz(lat: Column, lon: Column) -> Column:
    """struct<x, y, z> of the unit vector of degrees (G1)."""
    a, b = F.radians(lat), F.radians(lon)
    return F.struct((F.cos(a) * F.cos(b)).alias("x"), (F.cos(a) * F.sin(b)).alias("y"), F.sin(a).alias("z"))


def to_lat_lon(x: Column, y: Column, z: Column) -> Column:
    """struct<lat, lon> in degrees of a direction, which need not have unit length (G1)."""
    return F.struct(F.degrees(F.atan2(z, F.sqrt(x * x + y * y))).alias("lat"), F.degrees(F.atan2(y, x)).alias("lon"))


def face_dots(x: Column, y: Column, z: Column) -> Column:
    """Nearness of a direction to the middle of each face."""
    return F.array(*[x * a + y * b + z * c for a, b, c in CENTROIDS])


def nearest_face(dots: Column) -> Column:
    """Number of the face with the largest of face_dots; the smallest one on edges."""
    return (F.array_position(dots, F.array_max(dots)) - 1).cast("int")


def closest_face(x: Column, y: Column, z: Column) -> Column:
    """Number of the face whose middle is nearest in direction; the smallest one on edges."""
    return nearest_face(face_dots(x, y, z))


def _inverse(face: tuple[int, int, int]) -> list[float]:
    """Rows that turn a direction into its weights on the corners of a face, up to a common factor."""
    a, b, c = (VERTICES[i] for i in face)
    cross = lambda p, q: (p[1] * q[2] - p[2] * q[1], p[2] * q[0] - p[0] * q[2], p[0] * q[1] - p[1] * q[0])
    volume = sum(x * y for x, y in zip(a, cross(b, c)))
    return [x / volume for row in (cross(b, c), cross(c, a), cross(a, b)) for x in row]


_INVERSES = [_inverse(f) for f in FACES]


def by_face(values: list[list[float]], face: Column) -> Column:
    """The face's entry of a table of numbers."""
    return F.element_at(F.array(*[F.array(*map(F.lit, row)) for row in values]), face + 1)


def weights_on(x: Column, y: Column, z: Column, face: Column) -> Column:
    """Weights of a face's corners for a direction, up to a common factor."""
    m = by_face(_INVERSES, face)
    return F.array(*[m[3 * i] * x + m[3 * i + 1] * y + m[3 * i + 2] * z for i in range(3)])


def shares(w: Column) -> Column:
    """struct<u, v, w> of three weights that sum to 1."""
    return F.struct(*[(w[i] / (w[0] + w[1] + w[2])).alias(k) for i, k in enumerate("uvw")])


def barycentric(x: Column, y: Column, z: Column, face: Column) -> Column:
    """struct<u, v, w>: weights of the face's corners where the direction meets its plane; they sum to 1."""
    return let(weights_on(x, y, z, face), shares)


def display_position(lat: Column, lon: Column) -> Column:
    """(12.345678°N, 98.765432°W), with the letters the signs call for."""
    part = lambda x, plus, minus: F.concat(F.format_string("%.6f", F.abs(x)), F.lit("°"), F.when(x < 0, minus).otherwise(plus))
    return F.concat(F.lit("("), part(lat, "N", "S"), F.lit(", "), part(lon, "E", "W"), F.lit(")"))
