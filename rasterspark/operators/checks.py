"""Quality of labels, and issues of samples and predictions as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def label_quality(cells: DataFrame, *by: str, classes=(0, 1, 2, 3), nodata: int = 255, least_valid: float = 0.7, most_open: float = 0.5, least_pixels: int = 5, least_score: float = 0.5) -> DataFrame:
    """Valid and unclassified shares, classes seen, score and verdict of each patch."""
    seen = [F.count_if(F.col("class_id") == k) >= least_pixels for k in classes]
    rows = cells.groupBy(*by).agg(
        F.avg(F.coalesce(F.col("class_id").isin(*classes), F.lit(False)).cast("double")).alias("valid_ratio"),
        F.avg(F.coalesce(F.col("class_id") == nodata, F.lit(False)).cast("double")).alias("open_ratio"),
        sum((s.cast("int") for s in seen), F.lit(0)).alias("n_classes"),
    )
    score = 0.5 * F.least(F.col("valid_ratio") / max(least_valid, 1e-8), F.lit(1.0)) + 0.3 * F.greatest(1 - F.col("open_ratio") / max(most_open, 1e-8), F.lit(0.0)) + 0.2 * F.col("n_classes") / len(classes)
    issues = F.array_compact(F.array(
        F.when(F.col("valid_ratio") < least_valid, "too few valid pixels"), F.when(F.col("open_ratio") > most_open, "too many unclassified pixels"), F.when(F.col("n_classes") == 0, "no class covers enough pixels"),
    ))
    rows = rows.withColumn("score", F.round(F.least(score, F.lit(1.0)), 4)).withColumn("issues", issues)
    return rows.withColumn("acceptable", (F.size("issues") == 0) & (F.col("score") >= least_score))


def cell_issues(cells: DataFrame, bands, *by: str, class_col: str = "class_id", n_classes: int = 4, ignore: int = 255) -> DataFrame:
    """(by, issue, n): values that are not finite, and ids outside the classes."""
    broken = F.lit(False)
    for b in bands:
        broken = broken | F.coalesce(F.isnan(b) | (F.abs(b) == float("inf")), F.lit(False))
    outside = F.coalesce((F.col(class_col) != ignore) & ~F.col(class_col).between(0, n_classes - 1), F.lit(False))
    wide = cells.groupBy(*by).agg(F.count_if(broken).alias("not finite"), F.count_if(outside).alias("id outside the classes"))
    return wide.unpivot(list(by), ["not finite", "id outside the classes"], "issue", "n").where("n > 0")


def file_issues(samples: DataFrame, files: DataFrame, columns=("patch_path", "mask_path"), key: str = "sample_id") -> DataFrame:
    """(id, issue): samples whose patch or mask is in no listing of ``files`` (path)."""
    named = samples.select(key, F.explode(F.array(*[F.struct(F.lit(c.replace("_path", "")).alias("kind"), F.col(c).alias("path")) for c in columns])).alias("f")).select(key, "f.kind", "f.path")
    return named.join(files.select("path").distinct(), "path", "left_anti").select(key, F.concat(F.lit("missing "), "kind", F.lit(" file")).alias("issue"))


def low_ratios(samples: DataFrame, ratio: str = "valid_ratio", least: float = 0.5) -> DataFrame:
    """Number and share of samples below the least valid share."""
    low = F.coalesce(F.col(ratio) < least, F.lit(True))
    return samples.agg(F.count_if(low).alias("n_low"), F.coalesce(F.avg(low.cast("double")), F.lit(0.0)).alias("share_low"))


def too_few(samples: DataFrame, issues: DataFrame, least: int = 10, key: str = "sample_id") -> DataFrame:
    """(issue, value): fewer sound samples than ``least``."""
    sound = samples.join(issues.select(key).distinct(), key, "left_anti").agg(F.count("*").alias("value"))
    return sound.where(F.col("value") < least).select(F.lit("too few samples").alias("issue"), "value")


def mask_issues(cells: DataFrame, *by: str, classes=(0, 1, 2, 3), nodata: int = 255, most_nodata: float = 0.5, reject_single: bool = False) -> DataFrame:
    """(by, issue, value): ids that are no class, too much without data, one class only."""
    seen = cells.groupBy(*by).agg(
        F.count_if(~F.col("class_id").isin(*classes, nodata)).cast("double").alias("invalid id"),
        F.avg(F.coalesce(F.col("class_id") == nodata, F.lit(True)).cast("double")).alias("too much nodata"),
        F.count_distinct(F.when(F.col("class_id").isin(*classes), F.col("class_id"))).cast("double").alias("single class"),
    )
    rows = seen.unpivot(list(by), ["invalid id", "too much nodata", "single class"], "issue", "value")
    return rows.where(((F.col("issue") == "invalid id") & (F.col("value") > 0)) | ((F.col("issue") == "too much nodata") & (F.col("value") > most_nodata)) | ((F.col("issue") == "single class") & (F.col("value") == 1) & F.lit(reject_single)))


def band_report(rasters: DataFrame, bands, *by: str) -> DataFrame:
    """Per raster and band: share of values that are numbers, least, greatest, and how many are not."""
    long = rasters.unpivot(list(by), list(bands), "band", "x")
    number = F.when(~F.isnan("x"), F.col("x"))
    return long.groupBy(*by, "band").agg(F.avg(number.isNotNull().cast("double")).alias("valid_share"), F.min(number).alias("least"), F.max(number).alias("most"), F.count_if(number.isNull()).alias("n_missing"))


#: What to do about an issue of a data set.
ADVICE = {"leakage": "split by scene or area", "split_size": "gather more samples", "class_balance": "weight classes or sample rare ones", "crs": "bring all patches to one reference system"}


def recommendations(issues: DataFrame) -> DataFrame:
    """``issues`` (of ``quality_issues`` or ``crs_issues``) with what to do."""
    table = F.create_map(*[F.lit(x) for pair in ADVICE.items() for x in pair])
    return issues.withColumn("advice", F.try_element_at(table, F.col("category")))


def crs_issues(samples: DataFrame, crs: str = "crs") -> DataFrame:
    """An issue (severity, category, subject, value) if samples have several reference systems."""
    found = samples.agg(F.count_distinct(crs).alias("n"), F.array_join(F.array_sort(F.collect_set(crs)), ",").alias("subject"))
    return found.where("n > 1").select(F.lit("ERROR").alias("severity"), F.lit("crs").alias("category"), "subject", F.col("n").cast("double").alias("value"))


def sample_issues(samples: DataFrame, key: str = "sample_id", crs: str | None = None, expected_crs: str | None = None, ratio: str = "valid_ratio", least_ratio: float = 0.7) -> DataFrame:
    """(id, issue): repeated ids, a foreign reference system, too few valid pixels."""
    twice = samples.groupBy(key).agg(F.count("*").alias("n")).where("n > 1").select(key, F.lit("repeated id").alias("issue"))
    low = samples.where(F.coalesce(F.col(ratio) < least_ratio, F.lit(True))).select(key, F.lit("too few valid pixels").alias("issue"))
    out = twice.unionByName(low)
    return out.unionByName(samples.where(~F.col(crs).eqNullSafe(F.lit(expected_crs))).select(key, F.lit("other reference system").alias("issue"))) if crs else out


def quality_issues(samples: DataFrame, statistics: DataFrame, leaks: DataFrame, least: int = 10, most_imbalance: float = 10.0) -> DataFrame:
    """(severity, category, subject, value): leaking ids by kind, small splits, uneven classes of training and validation.

    ``statistics`` is from ``dataset.split_statistics``, ``leaks`` from ``dataset.leakage``.
    """
    def rows(found, severity, category, subject, value):
        return found.select(F.lit(severity).alias("severity"), F.lit(category).alias("category"), F.col(subject).alias("subject"), F.col(value).cast("double").alias("value"))

    leaking = rows(leaks.groupBy("kind").agg(F.count("*").alias("n")), "ERROR", "leakage", "kind", "n")
    small = rows(samples.groupBy("split").agg(F.count("*").alias("n")).where(F.col("n") < least), "WARN", "split_size", "split", "n")
    uneven = statistics.where(F.col("split").isin("train", "validation")).groupBy("split").agg(F.max("imbalance").alias("n")).where(F.col("n") > most_imbalance)
    return leaking.unionByName(small).unionByName(rows(uneven, "WARN", "class_balance", "split", "n"))


def grid_issues(labels: DataFrame, patches: DataFrame, key: str = "patch_id", tolerance: float = 1e-6) -> DataFrame:
    """(key, issue): label masks whose reference system, transform (struct of numbers) or size differs from their patch's."""
    both = labels.alias("l").join(patches.alias("p"), key)
    moved = F.lit(False)
    for f in patches.schema["transform"].dataType.names:
        moved = moved | ~F.coalesce(F.abs(F.col(f"l.transform.{f}") - F.col(f"p.transform.{f}")) <= tolerance, F.lit(False))
    differs = lambda c: ~F.col(f"l.{c}").eqNullSafe(F.col(f"p.{c}"))
    issues = F.array_compact(F.array(F.when(differs("crs"), "other reference system"), F.when(moved, "other transform"), F.when(differs("width") | differs("height"), "other size")))
    return both.select(key, F.explode(issues).alias("issue"))


def band_issues(observed: DataFrame, expected: DataFrame, key: str = "raster_id", most: int = 100_000) -> DataFrame:
    """(key, band, issue): bands that a raster lacks or has beyond those of ``expected`` (band); an error above ``most`` of those."""
    bands = expected.select("band").distinct().orderBy("band")
    if (n := bands.count()) > most:
        raise ValueError(f"{n} expected bands, at most {most} can be checked")
    wanted = [r["band"] for r in bands.collect()]
    names = F.array(*map(F.lit, wanted)).cast("array<string>")
    own = observed.groupBy(key).agg(F.collect_set("band").alias("have"))
    told = lambda missing, issue: F.transform(missing, lambda b: F.struct(b.alias("band"), F.lit(issue).alias("issue")))
    return own.select(key, F.explode(F.concat(told(F.array_except(names, "have"), "missing band"), told(F.array_except("have", names), "unexpected band"))).alias("x")).select(key, "x.band", "x.issue")


def prediction_issues(samples: DataFrame, cells: DataFrame, key: str = "sample_id") -> DataFrame:
    """(key, issue): samples without a mask, and those with a confidence that is no number."""
    bare = samples.select(key).distinct().join(cells, key, "left_anti").select(key, F.lit("no mask").alias("issue"))
    broken = cells.where(F.isnan("confidence")).select(key).distinct().withColumn("issue", F.lit("confidence is not a number"))
    return bare.unionByName(broken)


def prepared_issues(samples: DataFrame, statistics: DataFrame, n_bands: int) -> DataFrame:
    """(issue, value) of a prepared data set: no training sample, another number of bands, deviations not above 0."""
    train = samples.agg(F.count_if(F.col("split") == "train").alias("value")).where("value = 0").select(F.lit("no training sample").alias("issue"), "value")
    bands = statistics.agg(F.count("*").alias("value")).where(F.col("value") != n_bands).select(F.lit("other number of bands").alias("issue"), "value")
    flat = statistics.agg(F.count_if(F.col("std") <= 0).alias("value")).where("value > 0").select(F.lit("deviation not above 0").alias("issue"), "value")
    return train.unionByName(bands).unionByName(flat)
