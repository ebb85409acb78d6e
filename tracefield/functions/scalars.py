"""Small scoring rules as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracefield.functions import fixed_values as fv


def lookup(table: dict, key: Column, default) -> Column:
    chain = None
    for k, v in table.items():
        chain = F.when(key == k, v) if chain is None else chain.when(key == k, v)
    return chain.otherwise(default)


def format_size(size: Column) -> Column:
    """``12.3 MB``: divided by 1024 up to PB, one decimal, ties to even."""
    chain = None
    for i, unit in enumerate(("B", "KB", "MB", "GB", "TB")):
        value = F.format_string(f"%.1f {unit}", F.bround(size / (1024.0**i), 1))
        cond = size < 1024.0 ** (i + 1)
        chain = F.when(cond, value) if chain is None else chain.when(cond, value)
    return chain.otherwise(F.format_string("%.1f PB", F.bround(size / 1024.0**5, 1)))


def confidence_level(x: Column) -> Column:
    return (
        F.when(x >= 0.95, "CERTAIN").when(x >= 0.80, "VERY_HIGH").when(x >= 0.60, "HIGH")
        .when(x >= 0.40, "MEDIUM").when(x >= 0.20, "LOW").otherwise("VERY_LOW")
    )


LOW_LEVELS = ("LOW", "VERY_LOW")


def severity_overall(score: Column) -> Column:
    return F.when(score >= 0.8, "minimal").when(score >= 0.6, "mild").when(score >= 0.3, "moderate").otherwise("severe")


def severity_five(score: Column) -> Column:
    return (
        F.when(score >= 0.95, "minimal").when(score >= 0.85, "mild").when(score >= 0.60, "moderate")
        .when(score >= 0.30, "severe").otherwise("critical")
    )


def corruption_score(issues: Column) -> Column:
    """Sum of issue weights, repeats counted."""
    return F.aggregate(
        issues, F.lit(0.0), lambda a, i: a + lookup(fv.ISSUE_WEIGHTS, i, fv.OTHER_ISSUE_WEIGHT)
    )


def repairable(issues: Column, pct: Column) -> Column:
    both = F.array_contains(issues, "HEADER_DAMAGE") & F.array_contains(issues, "CONTAINER_STRUCTURE")
    return ~((pct > 80.0) | both)


def file_risk(
    confidence: Column, category: Column, size: Column, header_entropy: Column, encrypted: Column, hidden: Column
) -> Column:
    """Scored last, when the detection flags are known."""
    cat = F.lower(category)
    kind = (
        F.when(F.contains(cat, F.lit("executable")) | F.contains(cat, F.lit("script")), 0.4)
        .when(F.contains(cat, F.lit("archive")) | F.contains(cat, F.lit("compressed")), 0.2)
        .otherwise(0.0)
    )
    bulk = F.when(size == 0, 0.3).when(size > 1024**3, 0.1).otherwise(0.0)
    flag = lambda c, w: F.when(c, w).otherwise(0.0)
    total = (1.0 - confidence) * 0.3 + kind + bulk + flag(header_entropy > 7.5, 0.2) + flag(encrypted, 0.3) + flag(hidden, 0.4)
    return F.least(F.lit(1.0), total)


def suspicious(risk: Column, level: Column) -> Column:
    return (risk > 0.7) | (level.isin(*LOW_LEVELS) & (risk > 0.3))


def manual_review(risk: Column, level: Column, hidden: Column) -> Column:
    return suspicious(risk, level) | level.isin(*LOW_LEVELS) | hidden


def forensic_importance(confidence: Column, category: Column, deepfake: Column, tags: Column) -> Column:
    kind = (
        F.when(category.isin("ILLEGAL_DRUGS", "CHILD_EXPLOITATION", "TERRORISM"), 0.8)
        .when(category.isin("VIOLENCE", "WEAPONS"), 0.6)
        .when(category.isin("FRAUD", "MALWARE"), 0.4)
        .otherwise(0.0)
    )
    return F.least(F.lit(1.0), confidence * 0.3 + kind + F.when(deepfake, 0.7).otherwise(0.0) + F.size(tags) * 0.1)


def priority_of(importance: Column) -> Column:
    return F.when(importance >= 0.8, "URGENT").when(importance >= 0.6, "HIGH").when(importance >= 0.3, "NORMAL").otherwise("LOW")


def centred(a: Column) -> Column:
    m = F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / F.size(a)
    return F.transform(a, lambda x: x - m)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def masked_ncc(a: Column, b: Column, mask: Column) -> Column:
    """Centred normalised correlation over positions with mask 0; 0 under 5 positions or without spread."""
    keep = lambda v: F.filter(
        F.zip_with(v, mask, lambda x, m: F.when(m == 0, x.cast("double"))), lambda x: x.isNotNull()
    )
    ca, cb = centred(keep(a)), centred(keep(b))
    na, nb = F.sqrt(dot(ca, ca)), F.sqrt(dot(cb, cb))
    return F.when((F.size(keep(a)) < 5) | (na == 0) | (nb == 0), 0.0).otherwise(dot(ca, cb) / (na * nb + 1e-6))
