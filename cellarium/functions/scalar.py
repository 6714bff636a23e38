"""Scalar functions of the domain as columns."""

from __future__ import annotations

from functools import reduce
from math import pi, tan

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MASK = 0xFFFFFFFF


def softplus(x: Column, beta: float = 10.0) -> Column:
    return F.when(beta * x > 20, x).otherwise(F.log1p(F.exp(F.least(beta * x, F.lit(20.0)))) / beta)


def inverse_softplus(y: Column, beta: float = 10.0) -> Column:
    return F.when(beta * y > 20, y).otherwise(F.log(F.expm1(F.least(beta * y, F.lit(20.0)))) / beta)


def opacity(density: Column, extent: Column) -> Column:
    return -F.expm1(-density * extent)


def times32(x: Column, k: int) -> Column:
    """x·k modulo 2^32 for x under 2^32, in two halves so that no product leaves 64 bits."""
    lo, hi = x.bitwiseAND(F.lit(0xFFFF)), F.shiftrightunsigned(x, 16)
    return (lo * k + F.shiftleft((hi * k).bitwiseAND(F.lit(0xFFFF)), 16)).bitwiseAND(F.lit(MASK))


# The shifts and odd factors of the mixer, its last shift, and what a seed is crossed with.
MIX, MIX_LAST, SEED = ((17, 0xED5AD4BB), (11, 0xAC4C1B51), (15, 0x31848BAB)), 14, 0x2815DB5B


def once(x: Column, f) -> Column:
    """f(x), where f has x several times: x is written into the plan once."""
    return F.element_at(F.transform(F.array(x), f), 1)


def mix32(x: Column) -> Column:
    """A 32-bit mixer: xor with the own right shift and times an odd number, three times, and a last shift."""
    x = x.bitwiseAND(F.lit(MASK))
    for s, k in MIX:
        x = once(once(x, lambda h: h.bitwiseXOR(F.shiftrightunsigned(h, s))), lambda h: times32(h, k))  # noqa: B023
    return once(x, lambda h: h.bitwiseXOR(F.shiftrightunsigned(h, MIX_LAST)))


def seeded(seed: Column) -> Column:
    """The first number, under 2^32, of the generator with a seed; seeds count modulo 2^32."""
    return mix32(seed.cast("long").bitwiseAND(F.lit(MASK)).bitwiseXOR(F.lit(SEED)))


def following(number: Column) -> Column:
    """The number after another one."""
    return mix32(number + 1)


def below(number: Column, n: Column) -> Column:
    """A number under n, n under 2^32, from a generator's number."""
    return F.least(F.floor(number / F.floor(F.lit(MASK) / n)), n - 1)  # both quotients are exact enough: numbers have 32 bits


def fraction(number: Column) -> Column:
    return number / float(MASK)


def normal(number: Column) -> Column:
    """Box-Muller from a number and the one after it."""
    # Fixed value: the least normal number of single precision.
    return once(number, lambda g: F.sqrt(-2 * F.log(F.greatest(fraction(g), F.lit(1.1754943508222875e-38)))) * F.cos(2 * pi * fraction(following(g))))


def morton(x: Column, y: Column, z: Column, bits: int = 10) -> Column:
    """Interleaved bits of three integers, x lowest."""
    parts = [F.shiftleft(F.shiftright(c.cast("long"), b).bitwiseAND(F.lit(1)), 3 * b + k) for b in range(bits) for k, c in enumerate((x, y, z))]
    return reduce(lambda a, b: a.bitwiseOR(b), parts)


def unmorton(code: Column, axis: int, bits: int = 10) -> Column:
    return reduce(lambda a, b: a.bitwiseOR(b), [F.shiftleft(F.shiftright(code, 3 * b + axis).bitwiseAND(F.lit(1)), b) for b in range(bits)])


def rgba8(r: Column, g: Column, b: Column, a: Column) -> Column:
    """Four channels from 0 to 1 in one number, red lowest."""
    byte = lambda c: F.floor(255 * F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0)))
    return byte(r) + 256 * byte(g) + 65536 * byte(b) + 16777216 * byte(a)


def pack_id(view: Column, mask: Column) -> Column:
    return F.when(mask >= 0, view * 1024 + mask).otherwise(-1)


def unpack_id(packed: Column) -> tuple[Column, Column]:
    return F.when(packed >= 0, F.floor(packed / 1024)), F.when(packed >= 0, packed % 1024)


def hue(label: Column) -> Column:
    return (label * 0.618033988749895) % 1


def orient(a: list[Column], b: list[Column], c: list[Column], d: list[Column]) -> Column:
    """Six times the signed volume of a tetrahedron."""
    u, v, w = ([p[i] - a[i] for i in range(3)] for p in (b, c, d))
    return u[0] * (v[1] * w[2] - v[2] * w[1]) - u[1] * (v[0] * w[2] - v[2] * w[0]) + u[2] * (v[0] * w[1] - v[1] * w[0])


# Real spherical harmonics of degrees 0 to 3, as (factor, polynomial of the direction), in their usual order.
SH = [
    (0.28209479177387814, lambda x, y, z: 1.0),
    (-0.4886025119029199, lambda x, y, z: y), (0.4886025119029199, lambda x, y, z: z), (-0.4886025119029199, lambda x, y, z: x),
    (1.0925484305920792, lambda x, y, z: x * y), (-1.0925484305920792, lambda x, y, z: y * z), (0.31539156525252005, lambda x, y, z: 2 * z * z - x * x - y * y),
    (-1.0925484305920792, lambda x, y, z: x * z), (0.5462742152960396, lambda x, y, z: x * x - y * y),
    (-0.5900435899266435, lambda x, y, z: y * (3 * x * x - y * y)), (2.890611442640554, lambda x, y, z: x * y * z), (-0.4570457994644658, lambda x, y, z: y * (4 * z * z - x * x - y * y)),
    (0.3731763325901154, lambda x, y, z: z * (2 * z * z - 3 * x * x - 3 * y * y)), (-0.4570457994644658, lambda x, y, z: x * (4 * z * z - x * x - y * y)),
    (1.445305721320277, lambda x, y, z: z * (x * x - y * y)), (-0.5900435899266435, lambda x, y, z: x * (x * x - 3 * y * y)),
]


def sh_colour(coefficients: Column, x: Column, y: Column, z: Column, degree: int = 3) -> Column:
    """max(0, 0.5 + the harmonics' sum) for a unit direction; coefficients: an array of (degree + 1) squared numbers."""
    total = F.lit(0.5)
    for i, (k, p) in enumerate(SH[: (degree + 1) ** 2]):
        total = total + F.element_at(coefficients, i + 1) * k * p(x, y, z)
    return F.greatest(total, F.lit(0.0))


def log2_floor(x: Column) -> Column:
    """Of a positive integer: one less than its number of binary digits."""
    return F.length(F.bin(x)) - 1


def next_power_of_two(x: Column) -> Column:
    return F.when(x <= 1, 1).otherwise(F.pow(F.lit(2.0), log2_floor(x - 1) + 1)).cast("long")


def cross(a: list[Column], b: list[Column]) -> list[Column]:
    return [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]


def unit(a: list[Column]) -> list[Column]:
    """Of length one; the zero vector stays."""
    n = F.sqrt(a[0] * a[0] + a[1] * a[1] + a[2] * a[2])
    return [F.when(n > 0, x / n).otherwise(0.0) for x in a]


def vector(name: str) -> list[Column]:
    return [F.col(f"{name}{c}") for c in "xyz"]


def with_vector(rows: DataFrame, name: str, a: list[Column]) -> DataFrame:
    """rows with columns name + x, y, z. Vectors become columns step by step: written into each other, expressions would multiply."""
    return rows.withColumns({f"{name}{c}": x for c, x in zip("xyz", a, strict=True)})


def look_at(rows: DataFrame, position: list[Column], target: list[Column], above: list[Column]) -> DataFrame:
    """rows with the unit vectors forward_, right_ and up_ of a camera at a position that looks at a target."""
    rows = with_vector(rows, "forward_", [t - p for p, t in zip(position, target, strict=True)])
    rows = with_vector(rows, "forward_", unit(vector("forward_")))
    rows = with_vector(rows, "right_", cross(vector("forward_"), above))
    rows = with_vector(rows, "right_", unit(vector("right_")))
    rows = with_vector(rows, "up_", cross(vector("right_"), vector("forward_")))
    return with_vector(rows, "up_", unit(vector("up_")))


def cast_ray(rows: DataFrame, px: Column, py: Column, width: int, height: int, field: float, fisheye: bool = False) -> DataFrame:
    """rows of `look_at` with ray_: a pixel's ray, a unit vector; a fisheye's is zero where its angle from the axis is half a turn or more."""
    right, up, forward = vector("right_"), vector("up_"), vector("forward_")
    rows = rows.withColumns({"u_": (2 * px / width - 1) * (width / height), "v_": 1 - 2 * py / height})
    u, v = F.col("u_"), F.col("v_")
    if not fisheye:
        rows = with_vector(rows, "ray_", [forward[i] / tan(field / 2) + u * right[i] + v * up[i] for i in range(3)])
        return with_vector(rows, "ray_", unit(vector("ray_"))).drop("u_", "v_")
    rows = rows.withColumn("r_", F.sqrt(u * u + v * v)).withColumn("angle_", field * F.col("r_"))
    rows = rows.withColumn("side_", F.when(F.col("r_") > 0, F.sin("angle_") / F.col("r_")).otherwise(0.0))
    ray = [F.cos("angle_") * forward[i] + F.col("side_") * (u * right[i] + v * up[i]) for i in range(3)]
    return with_vector(rows, "ray_", [F.when(F.col("angle_") < pi, x).otherwise(0.0) for x in ray]).drop("u_", "v_", "r_", "angle_", "side_")


def log_linear(step: Column, first: float, last: float, steps: int) -> Column:
    """A rate that falls evenly on a logarithmic scale; zero beyond its steps."""
    share = F.least(F.greatest(step / steps, F.lit(0.0)), F.lit(1.0))
    return F.when(step > steps, 0.0).otherwise(F.exp((1 - share) * F.log(F.lit(first)) + share * F.log(F.lit(last))))
