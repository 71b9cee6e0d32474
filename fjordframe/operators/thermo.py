"""Two-state folding thermodynamics over a table of scenarios and variants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def folding_free_energy(t: Column, tm: Column, dh: Column, dcp: Column) -> Column:
    """Gibbs-Helmholtz unfolding free energy at temperature t."""
    return dh + dcp * (t - tm) - t * (dh / tm + dcp * F.ln(t / tm))


def folded_fraction(scenarios: DataFrame, temperatures: DataFrame, r: float) -> DataFrame:
    """One row per scenario variant and temperature with dg, keq and pf.

    scenarios has scenario, mutant, tm, dh and dcp; temperatures has t. The pairing is a cross product by
    definition and both inputs are small: scenarios are parameters, temperatures whole degrees of a fixed range.
    """
    dg = folding_free_energy(F.col("t"), F.col("tm"), F.col("dh"), F.col("dcp"))
    return (
        scenarios.crossJoin(temperatures)
        .withColumn("dg", dg)
        .withColumn("keq", F.exp(-F.col("dg") / (F.lit(r) * F.col("t"))))
        .withColumn("pf", 1 / (1 + F.col("keq")))
    )


def fraction_spread(fractions: DataFrame) -> DataFrame:
    """Sample standard deviation of pf over the variants, for each scenario and temperature."""
    return fractions.groupBy("scenario", "t").agg(F.stddev_samp("pf").alias("pf_std"))
