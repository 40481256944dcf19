"""Robot poses, trajectories and commands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placetrail.operators.prefix import row_numbers

MARKER = "[position:"
#: Lines behind the marker that hold each field.
FIELDS = {"x": 1, "y": 2, "z": 3, "rx": 5, "ry": 6, "rz": 7, "rw": 8}


def parse_poses(lines: DataFrame, markers: tuple[str, ...] = (MARKER,)) -> DataFrame:
    """Poses of text logs: log, seq_no (from 0), pos, and the seven fields.

    ``lines`` has log, pos (line number) and value. A pose starts at a line that is a marker once stripped; a field is the
    second of the items that single spaces separate on its stripped line. A field that is no number is null.
    """
    # lines are numbered over ranges and each marker asks for the lines behind it, so no log is in one task
    stripped = lines.select("log", "pos", F.trim("value").alias("value"))
    numbered = row_numbers(stripped, ["pos"], "n", ["log"])
    marks = row_numbers(numbered.where(F.col("value").isin(*markers)).select("log", "pos", "n"), ["pos"], "seq_no", ["log"])
    asked = F.explode(F.array(*(F.struct(F.lit(c).alias("field"), (F.col("n") + k).alias("n")) for c, k in FIELDS.items())))
    asked = marks.select("log", "seq_no", "pos", asked.alias("a")).select("log", "seq_no", "pos", "a.*")
    of = numbered.select(F.col("log").alias("_log"), F.col("n").alias("_n"), "value")
    found = asked.join(of, F.col("log").eqNullSafe(F.col("_log")) & (F.col("n") == F.col("_n")), "left")
    number = F.get(F.split("value", " "), 1).try_cast("double")
    each = [F.max(F.when(F.col("field") == c, number)).alias(c) for c in FIELDS]
    return found.groupBy("log", "seq_no", "pos").agg(*each).select("log", "seq_no", "pos", *FIELDS)


def remap(poses: DataFrame) -> DataFrame:
    """The trajectory frame: x, y, and z taken from rw."""
    return poses.select("log", "seq_no", "x", "y", F.col("rw").alias("z"))


def to_scene(trajectory: DataFrame) -> DataFrame:
    """Pixel coordinates over the scene image."""
    return trajectory.withColumn("px", F.col("x") * 38 + 640).withColumn("py", F.col("y") * -37 + 490)


def velocity(key: Column) -> Column:
    """axis, speed and hold_s of a command key; other keys publish nothing (nulls)."""
    def command(axis: str, speed: float, hold: int) -> Column:
        return F.struct(F.lit(axis).alias("axis"), F.lit(speed).alias("speed"), F.lit(hold).alias("hold_s"))

    return (
        F.when(key == "w", command("linear", 1.5, 2))
        .when(key == "s", command("linear", -1.5, 2))
        .when(key == "a", command("angular", 1.0, 1))
        .when(key == "d", command("angular", -1.0, 1))
    )


def messages(commands: DataFrame, *keep: str) -> DataFrame:
    """What is published for each command (key): its velocity at once, and a stop of the same axis after it was held.

    Columns ``keep``, step (0, 1), axis, speed, at_s (seconds after the command). Keys without a velocity publish nothing.
    """
    v = velocity(F.col("key"))
    stop = F.struct(F.lit(1).alias("step"), v["axis"].alias("axis"), F.lit(0.0).alias("speed"), v["hold_s"].alias("at_s"))
    go = F.struct(F.lit(0).alias("step"), v["axis"].alias("axis"), v["speed"].alias("speed"), F.lit(0).alias("at_s"))
    return commands.where(v.isNotNull()).select(*keep, F.explode(F.array(go, stop)).alias("m")).select(*keep, "m.*")


def latest(df: DataFrame, key: str, order: list[str], *columns: str) -> DataFrame:
    """Of each key the row that comes last; maxima are combined before the shuffle."""
    return df.groupBy(key).agg(F.max_by(F.struct(*columns), F.struct(*order)).alias("m")).select(key, "m.*")


def throttle(df: DataFrame, keys: list[str], at: str, order: str, seconds: int = 4) -> DataFrame:
    """The first row of each tumbling window of each key."""
    slot = F.window(at, f"{seconds} seconds")
    columns = [c for c in df.columns if c not in keys]
    first = df.withColumn("_slot", slot["start"]).groupBy(*keys, "_slot").agg(F.min_by(F.struct(*columns), F.struct(at, order)).alias("m"))
    return first.select(*keys, "m.*")
