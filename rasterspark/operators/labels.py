"""Labels of patches from rules: generation, confidence, agreement, validity and statistics."""

from __future__ import annotations

import itertools
from dataclasses import replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import checks, classify
from .classify import NODATA, STANDARD_RULES, Rule, Term

# Class names, the ratios and the share of bare sediment that statistics give.
CLASS_NAMES = {0: "background", 1: "water", 2: "sand", 3: "vegetation"}
RATIOS = {"water_sand_ratio": ("water", "sand"), "vegetation_sand_ratio": ("vegetation", "sand")}
SEDIMENT = (("sand",), ("water", "sand", "vegetation"))
BRIGHT_BANDS = ("Blue", "Green", "Red", "NIR")


def brightness(columns) -> Column:
    """Mean of those of Blue, Green, Red and NIR that a table has; missing where one of them is."""
    have = [b for b in BRIGHT_BANDS if b in columns]
    return reduce(Column.__add__, [F.col(b) for b in have]) / len(have) if have else F.lit(None).cast("double")


def with_terms(rule: Rule, *terms: Term) -> Rule:
    """A rule with further terms, such as the optional ones of sand."""
    return replace(rule, terms=(*rule.terms, *terms))


def enabled(rules=STANDARD_RULES, names=None) -> tuple[Rule, ...]:
    """The rules of some names, in their own order."""
    return tuple(r for r in rules if names is None or r.name in names)


def bands_used(rules=STANDARD_RULES) -> list[str]:
    return sorted({t.band for r in rules for t in r.terms})


def class_id(name: str, names=None) -> int:
    """Id of a class name; an unknown one is an error."""
    return {v: k for k, v in (names or CLASS_NAMES).items()}[name]


def with_class_names(cells: DataFrame, names=None, out: str = "class_name") -> DataFrame:
    """``cells`` plus the class name; NULL for ids that are no class."""
    table = F.create_map(*[F.lit(x) for pair in (names or CLASS_NAMES).items() for x in pair])
    return cells.withColumn(out, F.try_element_at(table, F.col("class_id")))


def confidence(cells: DataFrame, *by: str) -> DataFrame:
    """Mean confidence over valid cells (a class, and some band seen), 0 without one, to 4 places."""
    valid = (F.col("class_id") != NODATA) & ~F.col("nodata")
    return cells.groupBy(*by).agg(F.round(F.coalesce(F.avg(F.when(valid, F.col("confidence"))), F.lit(0.0)), 4).alias("mask_confidence"))


def agreement(cells: DataFrame, *by: str, rules=STANDARD_RULES) -> DataFrame:
    """Largest share of valid cells on which two rules of one class both speak for the winning class; 0 without two such rules."""
    bands, valid = set(cells.columns), (F.col("class_id") != NODATA) & ~F.col("nodata")
    pairs = [(a, b) for a, b in itertools.combinations(rules, 2) if a.class_id == b.class_id]
    both = lambda a, b: valid & (F.col("class_id") == a.class_id) & (a.confidence(bands) > 0) & (b.confidence(bands) > 0)
    counts = [F.count_if(both(a, b)) for a, b in pairs]
    most = F.greatest(*counts) if len(counts) > 1 else counts[0] if counts else F.lit(0)
    return cells.groupBy(*by).agg(F.round(F.coalesce(F.try_divide(most, F.count_if(valid)), F.lit(0.0)), 4).alias("agreement_score"))


def generate(pixels: DataFrame, *by: str, rules=STANDARD_RULES, strategy=None, clean=None, least_confidence: float = 0.30, **quality) -> DataFrame:
    """Quality, confidence and verdict of the labels that rules give each patch, in one pass over all patches.

    ``strategy`` may be a function of the user's from pixels to class cells
    (class_id, confidence, unclassified, nodata) in place of the rules, ``clean``
    one of the class cells (such as ``cleaning.per_patch``).
    """
    cells = strategy(pixels) if strategy else classify.classify(pixels, rules)
    if clean:
        cells = clean(cells)
    cells = classify.with_nodata(cells)
    found = checks.label_quality(cells, *by, **quality).join(confidence(cells, *by), list(by))
    return found.withColumn("acceptable", F.col("acceptable") & (F.col("mask_confidence") >= least_confidence))


def with_validity(labels: DataFrame, mask_issues: Column, date_issues: Column, label_issues: Column, acceptable: Column) -> DataFrame:
    """``labels`` plus is_valid (no issue of mask or date, and acceptable) and all issues in that order."""
    valid = (F.size(mask_issues) == 0) & (F.size(date_issues) == 0) & acceptable
    return labels.withColumn("is_valid", valid).withColumn("validation_issues", F.concat(mask_issues, date_issues, label_issues))


def statistics(labels: DataFrame, cells: DataFrame, names=None, ratios=None, sediment=SEDIMENT, key: str = "patch_id") -> DataFrame:
    """(kind, name, value) of a set of labels (key, mask_ok, season, year) and their cells.

    Pixels, seasons and years count for labels whose mask is sound, whatever the
    verdict on the label.  Ratios are NULL where a class is missing.
    """
    names, ratios = names or CLASS_NAMES, RATIOS if ratios is None else ratios
    rows = lambda df, kind, name, value: df.select(F.lit(kind).alias("kind"), F.col(name).cast("string").alias("name"), F.col(value).cast("double").alias("value"))
    sound = labels.where("mask_ok")
    totals = labels.agg(F.count("*").alias("total"), F.count_if(F.col("mask_ok")).alias("valid"), F.count_if(~F.col("mask_ok")).alias("rejected")).unpivot([], ["total", "valid", "rejected"], "name", "value")
    counts = cells.join(sound.select(key), key, "left_semi").where(F.col("class_id").isin(*names)).groupBy("class_id").agg(F.count("*").alias("n"))
    wide = counts.agg(*[F.coalesce(F.sum(F.when(F.col("class_id") == k, F.col("n"))), F.lit(0)).alias(v) for k, v in names.items()])
    each = [F.col(v) for v in names.values()]
    some = [F.when(c > 0, c) for c in each]
    n_some = reduce(Column.__add__, [(c > 0).cast("int") for c in each])
    parts = {f"pixels:{v}": F.col(v) for v in names.values()}
    parts |= {f"percent:{v}": F.coalesce(F.try_divide(F.col(v) * 100.0, reduce(Column.__add__, each)), F.lit(0.0)) for v in names.values()}
    parts["imbalance"] = F.when(n_some >= 2, F.greatest(*some) / F.least(*some)).otherwise(1.0)
    parts |= {name: F.try_divide(F.col(a), F.col(b)) for name, (a, b) in ratios.items()}
    parts["bare_sediment"] = F.try_divide(reduce(Column.__add__, [F.col(c) for c in sediment[0]]), reduce(Column.__add__, [F.col(c) for c in sediment[1]]))
    figures = wide.select(*[c.cast("double").alias(k.replace(":", "__")) for k, c in parts.items()])
    figures = figures.unpivot([], figures.columns, "name", "value").withColumn("name", F.replace("name", F.lit("__"), F.lit(":")))
    out = [rows(totals, "labels", "name", "value"), rows(figures, "classes", "name", "value")]
    out += [rows(sound.groupBy(c).agg(F.count("*").alias("n")), kind, c, "n") for kind, c in (("season", "season"), ("year", "year"))]
    return reduce(DataFrame.unionByName, out)
