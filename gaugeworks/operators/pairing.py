"""Paired comparisons, ranks with ties, and weights within groups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..sources.shared import cut
from .quantiles import finite, linear_quantiles
from .statistics import global_rank, median


def paired(before: DataFrame, after: DataFrame, key: Sequence[str], value: str) -> DataFrame:
    """n, geometric mean of before / after, and wins (after below before), over keys in both with positive, finite values.

    Of several rows of a key on a side the least such value counts. A null key is paired with nothing. Without pairs n is 0 and the ratio null.
    """
    v = F.col(value).cast("double")
    side = lambda df, name: df.where(finite(v) & (v > 0)).groupBy(*key).agg(F.min(v).alias(name))
    both = side(before, "_a").join(side(after, "_b"), list(key))
    return both.agg(F.count("*").alias("n"), F.exp(F.avg(F.ln(F.col("_a") / F.col("_b")))).alias("ratio"), F.count_if(F.col("_b") < F.col("_a")).alias("wins"))


def sign_test(wins: Column, n: Column) -> Column:
    """Exact two-sided sign test; 1 without pairs. Binomial terms in logarithms, so n may be hundreds."""
    k = F.least(wins, n - wins)
    start = F.struct((-n * F.log(F.lit(2.0))).alias("t"), F.exp(-n * F.log(F.lit(2.0))).alias("s"))

    def step(acc: Column, i: Column) -> Column:
        t = acc["t"] + F.ln((n - i + 1).cast("double")) - F.ln(i.cast("double"))
        return F.struct(t.alias("t"), (acc["s"] + F.exp(t)).alias("s"))

    tail = F.when(k > 0, F.aggregate(F.sequence(F.lit(1).cast("long"), F.greatest(k, F.lit(1)).cast("long")), start, step)["s"]).otherwise(F.exp(-n * F.log(F.lit(2.0))))
    return F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), 2 * tail))


def worst(df: DataFrame, by: Sequence[str], name: str, value: str) -> DataFrame:
    """The row with the greatest finite value of each group; of equal ones the first name. Groups without one give no row."""
    firsts = df.where(finite(F.col(value).cast("double"))).groupBy(*by, value).agg(F.min(name).alias(name))
    return firsts.groupBy(*by).agg(F.max_by(F.struct(name, value), value).alias("_w")).select(*by, F.col(f"_w.{name}").alias(name), F.col(f"_w.{value}").alias(value))


def top(df: DataFrame, by: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    return df.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("place") <= k)


def normalised(df: DataFrame, by: Sequence[str], weight: str, alias: str) -> DataFrame:
    """Weights that sum to 1 in each group; 0 where a group has no weight. A null weight counts as none and stays null."""
    total = F.sum(weight).over(Window.partitionBy(*by))
    return df.withColumn(alias, F.when(total > 0, F.col(weight) / F.when(total > 0, total)).otherwise(0.0))


def ratio_to_control(df: DataFrame, arm: str, value: str, control: str) -> DataFrame:
    """arm, n, median of its finite values, and the ratio to the control's; null where that is 0 or missing."""
    medians = median(df, [arm], value)
    base = medians.where(F.col(arm) == control).agg(F.max("median").alias("_c"))
    return medians.crossJoin(F.broadcast(base)).withColumn("ratio", F.try_divide("median", F.col("_c"))).drop("_c")  # one row


def differences(old: DataFrame, new: DataFrame, key: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """(key, change): added, removed or changed rows between two snapshots.

    Nulls equal each other, in the key too. A key that repeats is compared
    with each of its rows on the other side.
    """
    a = old.select(*(F.col(k).alias(f"_a{i}") for i, k in enumerate(key)), F.struct(*columns).alias("_a"))
    b = new.select(*(F.col(k).alias(f"_b{i}") for i, k in enumerate(key)), F.struct(*columns).alias("_b"))
    j = a.join(b, [F.col(f"_a{i}").eqNullSafe(F.col(f"_b{i}")) for i in range(len(key))], "full")
    change = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").when(~F.col("_a").eqNullSafe(F.col("_b")), "changed")
    names = [F.when(F.col("_a").isNull(), F.col(f"_b{i}")).otherwise(F.col(f"_a{i}")).alias(k) for i, k in enumerate(key)]
    return j.select(*names, change.alias("change")).where("change IS NOT NULL")


def paired_arms(df: DataFrame, by: Sequence[str], arm: str, value: str, arms: Sequence[str]) -> DataFrame:
    """``by`` and one column of values for each arm, for the keys that all arms have with a finite value: one aggregate, no self-join.

    Of several values of an arm the least counts. Other arms are ignored.
    """
    x = F.when(finite(F.col(value).cast("double")), F.col(value).cast("double"))
    wide = df.where(F.col(arm).isin(*arms)).groupBy(*by).agg(*(F.min(F.when(F.col(arm) == a, x)).alias(a) for a in arms))
    return wide.dropna(subset=list(arms))


def summarise_scopes(df: DataFrame, scope: str, arm: str, value: str, control: str) -> DataFrame:
    """For each scope, and over all (``all``), each arm: n, dropped (values that aren't finite), median, and its ratio to the control's."""
    scopes = df.select(F.explode(F.array(F.col(scope).cast("string"), F.lit("all"))).alias("scope"), F.col(arm).alias("arm"), F.col(value).cast("double").alias("_value"))
    found = median(scopes, ["scope", "arm"], "_value", also=[(F.count("*") - F.count("_x")).alias("dropped")])
    base = F.max(F.when(F.col("arm") == control, F.col("median"))).over(Window.partitionBy("scope"))  # a row an arm
    return found.withColumn("ratio", F.try_divide("median", base))


def worst_pair(df: DataFrame, by: Sequence[str], name: str, value: str) -> DataFrame:
    """``by``, i, j and the gap of the two rows of a group whose values are furthest apart, i < j by name.

    They are the rows with the least and the greatest value, so no pairs are
    formed; of equal values the first name counts. Groups of fewer than two
    rows with a finite value give no row.
    """
    x = F.col(value).cast("double")
    kept = df.where(finite(x) & F.col(name).isNotNull()).select(*by, F.col(name).alias("_n"), x.alias("_v"))
    firsts = kept.groupBy(*by, "_v").agg(F.min("_n").alias("_n"), F.max("_n").alias("_last"), F.count("*").alias("_c"))
    ends = firsts.groupBy(*by).agg(F.sum("_c").alias("_rows"), F.min_by("_n", "_v").alias("_low"), F.max_by("_n", "_v").alias("_high"), F.max_by("_last", "_v").alias("_other"), (F.max("_v") - F.min("_v")).alias("gap"))
    high = F.when(F.col("_low") == F.col("_high"), F.col("_other")).otherwise(F.col("_high"))
    return ends.where("_rows > 1").select(*by, F.least(F.col("_low"), high).alias("i"), F.greatest(F.col("_low"), high).alias("j"), "gap")


def usable_groups(df: DataFrame, by: Sequence[str], least: int, bad: Column) -> DataFrame:
    """``by``, n of the groups of at least ``least`` rows of which none is bad; a null verdict isn't bad."""
    g = df.groupBy(*by).agg(F.count("*").alias("n"), F.bool_or(F.coalesce(bad, F.lit(False))).alias("_bad"))
    return g.where((F.col("n") >= least) & ~F.col("_bad")).drop("_bad")


def repeated_signatures(df: DataFrame, value: str, name: str) -> DataFrame:
    """(signature, n, first): SHA-256 of the texts that several rows have, how many, and the least name. Nulls have no signature."""
    g = df.where(F.col(value).isNotNull()).groupBy(F.sha2(value, 256).alias("signature")).agg(F.count("*").alias("n"), F.min(name).alias("first"))
    return g.where("n > 1")


def cluster_sums(df: DataFrame, cluster: str, value: str) -> DataFrame:
    """(i, num, den): sum and count of each cluster, numbered by cluster from 0."""
    sums = df.where(finite(F.col(value).cast("double"))).groupBy(F.col(cluster).alias("_k")).agg(F.sum(value).alias("num"), F.count("*").alias("den"))
    return global_rank(sums.withColumn("_one", F.lit(0.0)), "_one", ["_k"], "i", "_n").select("i", "num", "den")


def cluster_bootstrap(df: DataFrame, cluster: str, value: str, draws: int = 200, seed: int = 12345) -> DataFrame:
    """(rep, ratio): means of the rows of as many clusters as there are, drawn with replacement, ``draws`` times.

    Draws are a fixed arithmetic of (rep, slot, seed), so every engine and
    every run draws the same. The sums of the clusters are joined by number.
    """
    clusters = cut(cluster_sums(df, cluster, value))
    one = clusters.agg(F.count("*").alias("n"))
    slots = df.sparkSession.range(draws).withColumnRenamed("id", "rep").crossJoin(F.broadcast(one)).where("n > 0").withColumn("slot", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))  # one: one row
    drawn = slots.select("rep", F.expr(f"((rep * 7919 + slot * 104729 + {int(seed)}) * 1103515245 % 2147483648) div 1024 % n").alias("i"))
    return drawn.join(clusters, "i").groupBy("rep").agg((F.sum("num") / F.sum("den")).alias("ratio"))


def bootstrap_interval(reps: DataFrame, value: str = "ratio", share: float = 0.95) -> DataFrame:
    """n, the median of the draws, and the linear quantiles low and high that hold ``share`` of them."""
    tail = (1 - share) / 2
    return linear_quantiles(reps, [], value, {"low": tail, "median": 0.5, "high": 1 - tail})


def matched_errors(found: DataFrame, truth: DataFrame, key: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """``key`` and ``error_<column>`` = found - truth, over the keys that both have."""
    a = found.select(*key, *(F.col(c).cast("double").alias(f"_a_{c}") for c in columns))
    b = truth.select(*key, *(F.col(c).cast("double").alias(f"_b_{c}") for c in columns))
    return a.join(b, list(key)).select(*key, *((F.col(f"_a_{c}") - F.col(f"_b_{c}")).alias(f"error_{c}") for c in columns))


def intrinsics_errors(found: DataFrame, truth: DataFrame, key: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """One row: n and the greatest absolute error of each column (NaN if any is, null without a pair)."""
    e = matched_errors(found, truth, key, columns)
    return e.agg(F.count("*").alias("n"), *(F.max(F.abs(f"error_{c}")).alias(f"max_{c}") for c in columns))


def pose_errors(found: DataFrame, truth: DataFrame, key: Sequence[str]) -> DataFrame:
    """``key``, position_mm, rotation_deg and the signed parts of pose errors: dx_mm, dy_mm, dz_mm, yaw_deg, pitch_deg, roll_deg.

    Poses are columns x, y, z (metres), yaw, pitch, roll (degrees); angles
    wrap to -180..180; rotation_deg is the angle of the relative rotation.
    """
    turn, move = ("yaw", "pitch", "roll"), ("x", "y", "z")
    a = found.select(*key, *(F.col(c).cast("double").alias(f"_a_{c}") for c in (*move, *turn)))
    b = truth.select(*key, *(F.col(c).cast("double").alias(f"_b_{c}") for c in (*move, *turn)))
    j = a.join(b, list(key))
    gap = {c: F.col(f"_a_{c}") - F.col(f"_b_{c}") for c in (*move, *turn)}
    matrix = lambda side: G.rotation_matrix(*(F.col(f"_{side}_{c}") for c in turn))
    position = F.sqrt(sum((gap[c] * 1000 * gap[c] * 1000 for c in move), F.lit(0.0)))
    return j.select(*key, position.alias("position_mm"), G.rotation_angle(matrix("a"), matrix("b")).alias("rotation_deg"), *((gap[c] * 1000).alias(f"d{c}_mm") for c in move), *(G.wrap180(gap[c]).alias(f"{c}_deg") for c in turn))


def pose_summary(errors: DataFrame, by: Sequence[str]) -> DataFrame:
    """n, greatest and root mean square position and rotation error; NaN wins as the greatest."""
    rms = lambda c: F.sqrt(F.avg(F.col(c) * F.col(c)))
    return errors.groupBy(*by).agg(F.count("*").alias("n"), F.max("position_mm").alias("max_position_mm"), F.max("rotation_deg").alias("max_rotation_deg"), rms("position_mm").alias("rms_position_mm"), rms("rotation_deg").alias("rms_rotation_deg"))
