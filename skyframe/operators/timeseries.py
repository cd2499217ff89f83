"""As-of neighbours and interpolation on irregular series.

Points and probes meet by union, not by join: each lands in a (key, time bucket)
and looks at its neighbours there; what lies in other buckets is carried in from
one summary row per bucket.  So a single long series is spread over its buckets,
rows are shuffled once, and no row is multiplied.  Inside a bucket the windows only
grow, so the work is in proportion to its rows, but for sorting them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import lerp, lerp_angle

#: Length of a bucket: an hour of micros.
BUCKET_US = 3_600_000_000


def bracket(
    points: DataFrame,
    probes: DataFrame,
    key: str,
    time: str,
    values: list[str],
    order: str | None = None,
    bucket_us: int = BUCKET_US,
) -> DataFrame:
    """``probes`` with structs ``lo`` and ``hi`` (``t`` and the values), ``first_t``
    and ``last_t`` of the key's series.

    ``lo`` is the last point strictly before the probe's time, ``hi`` the first at
    or after it; null where there is none.  Of points of one time, the first in
    ``order`` (nulls first) serves as ``hi`` and the last as ``lo``; at the series'
    last time, the last serves as ``hi`` too.  Points without key or time are passed
    over; probes without one have no neighbours.
    """
    ordinal = F.col(order) if order else F.lit(0)
    point = F.struct(F.col(time).alias("t"), *[F.col(v).alias(v) for v in values])
    # neither can be null, so that no filter on them tells the two uses of the rows apart
    owner = F.struct(F.col(key).alias("k"))
    bucket = F.coalesce(F.floor(F.col(time) / bucket_us).cast("bigint"), F.lit(0).cast("bigint"))
    known = points.where(F.col(key).isNotNull() & F.col(time).isNotNull())
    known = known.select(owner.alias("_key"), bucket.alias("_bucket"), F.col(time).alias("_t"), ordinal.alias("_o"), point.alias("_point"))
    kind = F.struct(*[F.col(f"`{c}`") for c in probes.columns])
    # probes without a key or time have no neighbours: dealt to buckets of their own
    comparable = [F.col(f"`{f.name}`") for f in probes.schema if "map<" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()]
    aside = F.lit(-(1 << 62)).cast("bigint") + F.pmod(F.xxhash64(*comparable), F.lit(1024))
    placed = F.col(key).isNotNull() & F.col(time).isNotNull()
    asked = probes.select(owner.alias("_key"), F.when(placed, bucket).otherwise(aside).alias("_bucket"), F.when(placed, F.col(time)).alias("_t"), kind.alias("_probe"))
    none = lambda of, c: F.lit(None).cast(of.schema[c].dataType).alias(c)
    rows = known.select("*", none(asked, "_probe")).unionByName(asked.select("_key", "_bucket", "_t", none(known, "_o"), none(known, "_point"), "_probe"))
    rows = rows.repartition("_key", "_bucket")  # one exchange serves the summary and the windows

    place = F.struct("_t", "_o")
    summary = rows.groupBy("_key", "_bucket").agg(
        F.min_by("_point", F.when(F.col("_point").isNotNull(), place)).alias("_opens"),
        F.max_by("_point", F.when(F.col("_point").isNotNull(), place)).alias("_closes"),
        F.count("_probe").alias("_asked"),
    )
    ever = Window.partitionBy("_k")
    earlier = ever.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    later = ever.orderBy(F.desc("_b")).rowsBetween(Window.unboundedPreceding, -1)
    carried = summary.withColumnsRenamed({"_key": "_k", "_bucket": "_b"}).select(
        "_k",
        "_b",
        F.last("_closes", ignorenulls=True).over(earlier).alias("_before"),
        F.last("_opens", ignorenulls=True).over(later).alias("_after"),
        F.min("_opens.t").over(ever).alias("first_t"),
        F.max_by("_closes", F.when(F.col("_closes").isNotNull(), F.col("_b"))).over(ever).alias("_final"),
        "_asked",
    )
    # frames only ever grow, so each row is looked at once: forward, a probe comes before
    # the points of its time, backward after them
    inside = Window.partitionBy("_key", "_bucket")
    is_point = F.col("_point").isNotNull()
    upward = inside.orderBy("_t", is_point, "_o").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    downward = inside.orderBy(F.desc("_t"), is_point.desc(), F.desc("_o")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = rows.withColumns({"_lo": F.last("_point", ignorenulls=True).over(upward), "_hi": F.last("_point", ignorenulls=True).over(downward)}).where("_probe is not null")
    carried = carried.where((F.col("_b") >= F.lit(-(1 << 61))) & (F.col("_asked") > 0)).drop("_asked")
    out = seen.join(carried, (F.col("_key") == F.col("_k")) & (F.col("_bucket") == F.col("_b")), "left")
    hi = F.when(F.col("_t") == F.col("_final.t"), F.col("_final")).otherwise(F.coalesce("_hi", "_after"))
    return out.select("_probe.*", F.coalesce("_lo", "_before").alias("lo"), hi.alias("hi"), "first_t", F.col("_final.t").alias("last_t"))


def fraction(time: Column, lo: Column, hi: Column) -> Column:
    """Place between two points, 0 to 1; null without both."""
    gap = (hi["t"] - lo["t"]).cast("double")
    return F.when(gap > 0, (time - lo["t"]).cast("double") / gap)


def clamped(time: Column, lo: Column, hi: Column, first_t: Column, last_t: Column, value: str, angle: bool = False) -> Column:
    """A value at a time: the end points' own beyond the series, else interpolated."""
    between = (lerp_angle if angle else lerp)(lo[value], hi[value], fraction(time, lo, hi))
    return F.when(time <= first_t, hi[value]).when(time > last_t, lo[value]).when(time == last_t, hi[value]).otherwise(between)


def interpolate(
    points: DataFrame,
    probes: DataFrame,
    key: str,
    time: str,
    linear: list[str],
    angular: list[str] = (),
    order: str | None = None,
    bucket_us: int = BUCKET_US,
) -> DataFrame:
    """``probes`` with each value at the probe's time, null where a key has no
    points; beyond the ends the end points' values, not reduced to 0-360."""
    found = bracket(points, probes, key, time, [*linear, *angular], order, bucket_us)
    lo, hi, t = F.col("lo"), F.col("hi"), F.col(time)
    kept = [c for c in probes.columns if c not in linear and c not in angular]
    values = [clamped(t, lo, hi, F.col("first_t"), F.col("last_t"), v, v in angular).alias(v) for v in [*linear, *angular]]
    return found.select(*kept, *values)


def anchor_ends(anchors: DataFrame, key: str, x: str, y: str) -> DataFrame:
    """Per key, the two first and two last anchors in time order, ties by value:
    ``key, n, head (array of 2), tail (array of 2)``; only four rows a key are kept
    on the way, in bounded lists."""
    up, down = Window.partitionBy(key).orderBy(F.col(x), F.col(y)), Window.partitionBy(key).orderBy(F.col(x).desc(), F.col(y).desc())
    pair = F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    heads = anchors.select(key, pair.alias("p"), F.row_number().over(up).alias("r")).where("r <= 2").groupBy(key).agg(F.sort_array(F.collect_list("p")).alias("head"))
    tails = anchors.select(key, pair.alias("p"), F.row_number().over(down).alias("r")).where("r <= 2").groupBy(key).agg(F.sort_array(F.collect_list("p")).alias("tail"))
    return heads.join(tails, key)


def _free(columns: list[str], *names: str) -> list[str]:
    """The names, made longer until no column has them."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def time_base(anchors: DataFrame, rows: DataFrame, key: str, x: str, y: str = "utc_us", out: str = "utc_us", bucket_us: int = BUCKET_US) -> DataFrame:
    """``rows`` with the time ``out`` (micros) that anchors (x, y) give to each x:
    linear between neighbours, from the two end anchors beyond them, constant for a
    single anchor, null without anchors or x.  Seconds are computed as doubles."""
    points = anchors.select(F.col(key), F.col(x), (F.col(y) / F.lit(1_000_000)).alias("_sec"))
    first, last, owner, packed = _free([key, x], "head", "tail", "_owner", "_row")
    asked = rows.select(key, x, F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias(packed))
    found = bracket(points, asked, key, x, ["_sec"], "_sec", bucket_us)
    ends = anchor_ends(points.where(F.col(x).isNotNull()), key, x, "_sec").withColumnsRenamed({key: owner, "head": first, "tail": last})
    joined = found.join(ends, F.col(key) == F.col(owner), "left")  # one row a key
    head, tail, t = F.col(first), F.col(last), F.col(x)

    def along(a: Column, b: Column) -> Column:
        gap = (b["x"] - a["x"]).cast("double")
        return F.when(gap == 0, a["y"]).otherwise(a["y"] + (t - a["x"]).cast("double") / gap * (b["y"] - a["y"]))

    lo, hi = F.col("lo"), F.col("hi")
    inner = along(F.struct(lo["t"].alias("x"), lo["_sec"].alias("y")), F.struct(hi["t"].alias("x"), hi["_sec"].alias("y")))
    seconds = (
        F.when(head.isNull() | t.isNull(), F.lit(None).cast("double"))
        .when(F.size(head) == 1, head[0]["y"])
        .when(lo.isNull(), along(head[0], head[1]))
        .when(hi.isNull(), along(tail[0], tail[1]))
        .otherwise(inner)
    )
    micros = F.bround(seconds * 1_000_000).cast("bigint")
    return joined.select(*[F.col(f"{packed}.`{c}`").alias(c) for c in rows.columns if c != out], micros.alias(out))


def fuse_navigation(probes: DataFrame, ahr: DataFrame, gps: DataFrame, imu: DataFrame, key: str = "flight", time: str = "t", order: str | None = "line_no", bucket_us: int = BUCKET_US) -> DataFrame:
    """``probes`` with position, attitude, speed and turn rate: latitude, longitude
    and altitude from the attitude series where neither null nor zero, else from the
    GPS series; each series interpolated on its own."""
    position = ["latitude", "longitude", "altitude_m"]
    a = interpolate(ahr, probes, key, time, [*position, "roll_deg", "pitch_deg"], ["yaw_deg"], order, bucket_us)
    a = a.withColumnsRenamed({p: f"_ahr_{p}" for p in position})
    g = interpolate(gps, a, key, time, [*position, "gps_speed_mps"], ["gps_course_deg"], order, bucket_us)
    out = interpolate(imu, g, key, time, ["imu_gyro_magnitude"], [], order, bucket_us)
    truthy = {p: F.when(F.col(f"_ahr_{p}") != 0, F.col(f"_ahr_{p}")) for p in position}
    fused = out.withColumns({p: F.coalesce(truthy[p], F.col(p)) for p in position})
    return fused.drop(*[f"_ahr_{p}" for p in position])
