"""Rule-based classes of pixels from spectral indices."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NODATA = 255


def evidence(x: Column, threshold: float, scale: float, above: bool = True) -> Column:
    """Soft step at the threshold: 0.5 on it; missing gives 0."""
    z = (1.25 / max(scale, 1e-8)) * (x - threshold)
    z = F.least(F.greatest(z if above else -z, F.lit(-88.0)), F.lit(88.0))
    return F.when(x.isNotNull(), 1 / (1 + F.exp(-z))).otherwise(0.0)


@dataclass(frozen=True)
class Term:
    band: str
    threshold: float
    weight: float
    above: bool = True


@dataclass(frozen=True)
class Rule:
    """A class with weighted terms; ``gate`` must hold too (a function of the present bands)."""

    name: str
    class_id: int
    terms: tuple[Term, ...] = ()
    scale: float = 0.3
    least: float = 0.0
    gate: object = None
    constant: float | None = None
    order: int = field(default=0)

    def confidence(self, bands: set[str]) -> Column:
        if self.constant is not None:
            return F.lit(self.constant)
        used = [t for t in self.terms if t.band in bands and t.weight > 0]
        total = sum(t.weight for t in used)
        if not total:
            return F.lit(0.0)
        return sum((evidence(F.col(t.band), t.threshold, self.scale, t.above) * t.weight for t in used), F.lit(0.0)) / total

    def eligible(self, bands: set[str], confidence: Column | None = None) -> Column:
        passed = (self.confidence(bands) if confidence is None else confidence) >= self.least
        return passed & self.gate(bands) if self.gate else passed


def _not_wet(bands):
    return ~F.coalesce(F.col("MNDWI") > 0.0, F.lit(False)) if "MNDWI" in bands else F.lit(True)


def _green(bands):
    return F.coalesce(F.col("NDVI") >= 0.20, F.lit(False)) if "NDVI" in bands else F.lit(False)


# Thresholds and weights of the standard rules.
STANDARD_RULES = (
    Rule("water", 1, (Term("MNDWI", 0.2, 0.40), Term("NDWI", 0.0, 0.20), Term("AWEI_nsh", 0.0, 0.15), Term("AWEI_sh", 0.0, 0.05), Term("NDVI", 0.05, 0.20, False)), 0.30, 0.40),
    Rule("sand", 2, (Term("MNDWI", 0.0, 0.30, False), Term("BSI", 0.0, 0.35), Term("NDVI", 0.25, 0.25, False), Term("NDWI", 0.0, 0.10, False)), 0.30, 0.30, _not_wet),
    Rule("vegetation", 3, (Term("NDVI", 0.20, 0.50), Term("SAVI", 0.10, 0.30), Term("NDMI", 0.0, 0.20)), 0.25, 0.35, _green),
    Rule("background", 0, constant=0.10),
)


def classify(pixels: DataFrame, rules=STANDARD_RULES, strategy: str = "highest_confidence", priority: dict[int, int] | None = None) -> DataFrame:
    """``pixels`` plus class_id, confidence, unclassified and nodata.

    highest_confidence: the eligible rule with most confidence, the earlier one
    on ties.  priority_order: the eligible rule of least priority number.
    """
    bands = set(pixels.columns)
    pixels = pixels.withColumns({f"_conf{k}": r.confidence(bands) for k, r in enumerate(rules)})
    scored = [F.when(r.eligible(bands, F.col(f"_conf{k}")), F.struct(F.col(f"_conf{k}").alias("confidence"), F.lit(-k).alias("order"), F.lit(r.class_id).alias("class_id"))) for k, r in enumerate(rules)]
    if strategy == "highest_confidence":
        best = F.greatest(*scored) if len(scored) > 1 else scored[0]
    elif strategy == "priority_order":
        if not priority or len(set(priority.values())) < len(priority):
            raise ValueError("each class needs a priority of its own")
        best = F.coalesce(*[s for _, s in sorted(zip([priority[r.class_id] for r in rules], scored, strict=True), key=lambda x: x[0])])
    else:
        raise ValueError("strategy is highest_confidence or priority_order")
    used = sorted({t.band for r in rules for t in r.terms} & bands)
    out = pixels.withColumn("_best", best)
    return out.withColumns({
        "class_id": F.coalesce("_best.class_id", F.lit(0)),
        "confidence": F.coalesce("_best.confidence", F.lit(0.0)),
        "unclassified": F.coalesce(F.col("_best.confidence") == 0, F.lit(True)),
        "nodata": F.coalesce(*[F.col(b).cast("double") for b in used]).isNull() if used else F.lit(False),
    }).drop("_best", *[f"_conf{k}" for k in range(len(rules))])


def with_nodata(classified: DataFrame) -> DataFrame:
    """Class 0 becomes the nodata code where nothing was seen or decided."""
    return classified.withColumn("class_id", F.when((F.col("class_id") == 0) & (F.col("nodata") | F.col("unclassified")), NODATA).otherwise(F.col("class_id")))


def shares(classified: DataFrame, *by: str, n_classes: int = 4, pixel_area: float = 900.0, low: float = 0.5) -> DataFrame:
    """Per group and class: pixels, fraction, area, mean confidence, and area weighted by confidence; absent classes count 0."""
    counts = classified.groupBy(*by, "class_id").agg(F.count("*").alias("pixels"), F.avg("confidence").alias("mean_confidence"), F.count_if(F.col("confidence") < low).alias("low_pixels"), F.sum("confidence").alias("weighted_pixels"))
    totals = counts.groupBy(*by).agg(F.sum("pixels").alias("total"))
    grid = totals.withColumn("class_id", F.explode(F.sequence(F.lit(0), F.lit(n_classes - 1))))
    full = grid.join(counts, [*by, "class_id"], "left")
    return full.select(
        *by, "class_id", F.coalesce("pixels", F.lit(0)).alias("pixels"), (F.coalesce("pixels", F.lit(0)) / F.col("total")).alias("fraction"),
        (F.coalesce("pixels", F.lit(0)) * pixel_area).alias("area_m2"), F.coalesce("mean_confidence", F.lit(0.0)).alias("mean_confidence"), F.coalesce("low_pixels", F.lit(0)).alias("low_pixels"),
        (F.coalesce("weighted_pixels", F.lit(0.0)) * pixel_area).alias("weighted_area_m2"),
    )
