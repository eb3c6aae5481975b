"""Completeness, uniqueness, hashes, manifests and comparisons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def exact_duplicates(df: DataFrame, key: str, content: Column) -> DataFrame:
    """sha256, n, first_id and id: a row for each row whose content occurs n times, more than once; NULL content doesn't count.

    A group of copies may hold much of the table, so its ids stay rows; first_id, the least, stands for the group.
    """
    hashed = df.select(F.col(key).alias("id"), F.sha2(content.cast("binary"), 256).alias("sha256")).where("sha256 is not null")
    many = hashed.groupBy("sha256").agg(F.count("*").alias("n"), F.min("id").alias("first_id")).where("n > 1")
    return hashed.join(many, "sha256").select("sha256", "n", "first_id", "id")


def remaining(rows: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """What is still to be done: rows whose key isn't among done, whatever the outcome recorded there."""
    return rows.join(done.select(key).distinct(), key, "left_anti")


def sampled(rows: DataFrame, sample: DataFrame, key: str) -> DataFrame:
    """rows whose key is in the sample."""
    return rows.join(sample.select(key), key, "left_semi")


def completeness(expected: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """One row: how many keys are missing from found, extra in it, and in both, and whether the sets are equal."""
    a, b = expected.select(key).distinct().withColumn("a", F.lit(1)), found.select(key).distinct().withColumn("b", F.lit(1))
    both = a.join(b, key, "full_outer")
    out = both.agg(F.count_if(F.col("b").isNull()).alias("missing"), F.count_if(F.col("a").isNull()).alias("extra"), F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("common"))
    return out.withColumn("complete", (F.col("missing") == 0) & (F.col("extra") == 0))


def differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of either side that the other doesn't hold, with the side: a set difference both ways."""
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))


def mismatches(rows: DataFrame, reference: DataFrame, key: str, blocking: list[str], compared: list[str]) -> DataFrame:
    """key, reason, actual, expected: one row per column that differs, NULLs being equal; a blocking difference hides the rest."""
    other = reference.select(key, *[F.col(c).alias(f"{c}__") for c in [*blocking, *compared]])
    joined = rows.select(key, *blocking, *compared).join(other, key)

    def found(c: str) -> Column:
        differs = ~F.col(c).eqNullSafe(F.col(f"{c}__"))
        return F.when(differs, F.struct(F.lit(c).alias("reason"), F.col(c).cast("string").alias("actual"), F.col(f"{c}__").cast("string").alias("expected")))

    first = F.array_compact(F.array(*[found(c) for c in blocking]))
    rest = F.array_compact(F.array(*[found(c) for c in compared]))
    out = joined.select(key, F.explode(F.when(F.size(first) > 0, first).otherwise(rest)).alias("x"))
    return out.select(key, "x.*")


def agreement(sample: DataFrame, full: DataFrame, key: str, compared: list[str]) -> DataFrame:
    """One row: of the sample's records, how many the full log holds, agrees with in all compared columns (NULLs being equal), or lacks."""
    other = full.select(key, *[F.col(c).alias(f"{c}_in_full") for c in compared], F.lit(True).alias("held"))
    joined = sample.select(key, *compared).join(other, key, "left")
    same = F.lit(True)
    for c in compared:
        same = same & F.col(c).eqNullSafe(F.col(f"{c}_in_full"))
    return joined.agg(F.count_if("held").alias("compared"), F.count_if(F.col("held") & same).alias("matched"), F.count_if(F.col("held").isNull()).alias("missing"))


def not_unique(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once, and how often: empty if the keys are unique."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def fingerprint(manifest: DataFrame, path: str = "path", sha256: str = "sha256") -> DataFrame:
    """One row: the first 16 digits of the SHA-256 of the manifest's canonical JSON, keys sorted.

    A manifest lists the files of a release, a few dozen rows.
    """
    entries = F.array_sort(F.collect_list(F.struct(F.col(path).alias("p"), F.col(sha256).alias("h"))))
    text = F.concat(F.lit("{"), F.array_join(F.transform(entries, lambda e: F.concat(F.lit('"'), e["p"], F.lit('": "'), e["h"], F.lit('"'))), ", "), F.lit("}"))
    return manifest.agg(F.substring(F.sha2(text, 256), 1, 16).alias("fingerprint"))


def manifest_check(recorded: DataFrame, actual: DataFrame) -> DataFrame:
    """path and problem (missing, changed or extra) of files that differ from the recorded manifest."""
    a, b = recorded.select("path", F.col("sha256").alias("want")), actual.select("path", F.col("sha256").alias("have"))
    problem = F.when(F.col("have").isNull(), "missing").when(F.col("want").isNull(), "extra").when(F.col("want") != F.col("have"), "changed")
    return a.join(b, "path", "full_outer").select("path", problem.alias("problem")).where("problem is not null")


def close(a: Column, b: Column, rtol: float = 1e-11, atol: float = 1e-8) -> Column:
    """Whether two numbers agree within tolerance, NULLs being equal."""
    return F.when(a.isNull() | b.isNull(), a.isNull() & b.isNull()).otherwise(F.abs(a - b) <= atol + rtol * F.abs(b))


def table_differences(actual: DataFrame, expected: DataFrame, keys: list[str], rtol: float = 1e-11, atol: float = 1e-8) -> DataFrame:
    """keys and the names of columns that disagree; rows that only one side has name all columns. Numbers have a tolerance."""
    columns = [c for c in expected.columns if c not in keys]
    kinds = dict(expected.dtypes)
    a = actual.select(*keys, *columns, F.lit(True).alias("in_a"))
    b = expected.select(*keys, *[F.col(c).alias(f"{c}__") for c in columns], F.lit(True).alias("in_b"))
    tests = []
    for c in columns:
        same = close(F.col(c).cast("double"), F.col(f"{c}__").cast("double"), rtol, atol) if kinds[c] in ("double", "float") else F.col(c).eqNullSafe(F.col(f"{c}__"))
        tests.append(F.when(F.col("in_a").isNull() | F.col("in_b").isNull() | ~same, F.lit(c)))
    out = a.join(b, keys, "full_outer").select(*keys, F.array_compact(F.array(*tests)).alias("columns"))
    return out.where(F.size("columns") > 0)


def published_nulls(frames: DataFrame, accepted: DataFrame, counts: list[str], never: list[str]) -> DataFrame:
    """One row: how many counts of groups that aren't accepted, and of columns that are never published, aren't NULL. Both must be 0."""
    joined = frames.join(accepted.select("grp", "accepted"), "grp", "left")
    failed = ~F.coalesce("accepted", F.lit(False))
    some = F.greatest(*[F.col(c).isNotNull() for c in counts], F.lit(False))
    always = F.greatest(*[F.col(c).isNotNull() for c in never], F.lit(False))
    return joined.agg(F.count_if(failed & some).alias("published_of_failed_groups"), F.count_if(always).alias("never_published"))


def bad_hashes(df: DataFrame, column: str = "sha256") -> DataFrame:
    """Rows whose hash isn't 64 lower-case hexadecimal digits; a missing one is bad."""
    return df.where(~F.coalesce(F.col(column).rlike("^[0-9a-f]{64}$"), F.lit(False)))
