"""Thermodynamic scenario queries: the scenario model at the temperatures that the frames are at.

A frame's temperature is 278 K and its value modulo 91, in whole degrees.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fjordframe.operators.thermo import folded_fraction, fraction_spread
from fjordframe.plans.standin import FRAMES, frames

# Fixed values of the scenario model.
GAS_CONSTANT = 0.008314
TEMPERATURES = (278, 368)
MELTING = (333.0, 333.0, 313.0, 313.0, 313.0)
ENTHALPY = (2.9 * 67, 1.45 * 67, 1.45 * 67, 2.9 * 67, 2.9 * 67)
HEAT_CAPACITY = 0.04 * 67
VARIANT_SHIFT = 4.0
LAST_SCENARIO_SCALE = (1.0, 0.9, 0.8, 0.7, 0.6)


def scenario_rows() -> str:
    """The scenario table as a SQL VALUES list, shared by Spark and DuckDB."""
    rows = []
    for s, (tm, dh) in enumerate(zip(MELTING, ENTHALPY, strict=True), 1):
        for m, scale in enumerate(LAST_SCENARIO_SCALE, 1):
            scaled = dh * scale if s == len(MELTING) else dh
            rows.append(f"({s}, {m}, {tm - VARIANT_SHIFT * (m - 1)}D, {scaled!r}D, {HEAT_CAPACITY!r}D)")
    return "(VALUES " + ", ".join(rows) + ") AS v(scenario, mutant, tm, dh, dcp)"


def _temperatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(t, n): the temperatures that occur, 91 at most, and how many frames are at each."""
    lo, hi = TEMPERATURES
    degrees = lo + F.pmod(F.floor("x"), F.lit(hi - lo + 1))
    return frames(spark, sf_dir).where("x IS NOT NULL").groupBy(degrees.cast("double").alias("t")).agg(F.count("*").alias("n"))


def thermo_pf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folded fraction for every scenario, variant and temperature."""
    scenarios = spark.sql(f"SELECT * FROM {scenario_rows()}")
    temperatures = _temperatures(spark, sf_dir)
    out = folded_fraction(scenarios, temperatures.select("t"), GAS_CONSTANT).join(temperatures, "t")
    return out.selectExpr("scenario", "mutant", "t", "n", "round(dg, 9) AS dg", "round(pf, 9) AS pf")


def thermo_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spread of the folded fraction over variants."""
    scenarios = spark.sql(f"SELECT * FROM {scenario_rows()}")
    out = fraction_spread(folded_fraction(scenarios, _temperatures(spark, sf_dir).select("t"), GAS_CONSTANT))
    return out.selectExpr("scenario", "t", "round(pf_std, 9) AS pf_std")


_PF = f"""SELECT scenario, mutant, t, n, dg, 1 / (1 + exp(-dg / ({GAS_CONSTANT} * t))) AS pf FROM (
SELECT *, dh + dcp * (t - tm) - t * (dh / tm + dcp * ln(t / tm)) AS dg FROM (
SELECT v.*, r.t, r.n FROM {scenario_rows().replace("D,", "::DOUBLE,").replace("D)", "::DOUBLE)")},
(SELECT ({TEMPERATURES[0]} + floor(x) % {TEMPERATURES[1] - TEMPERATURES[0] + 1})::DOUBLE AS t, count(*) AS n FROM {FRAMES} WHERE x IS NOT NULL GROUP BY 1) AS r))"""

QUERIES = {"thermo_pf": thermo_pf, "thermo_spread": thermo_spread}
ORACLES = {
    "thermo_pf": f"SELECT scenario, mutant, t, n, round(dg, 9) AS dg, round(pf, 9) AS pf FROM ({_PF})",
    "thermo_spread": f"SELECT scenario, t, round(stddev_samp(pf), 9) AS pf_std FROM ({_PF}) GROUP BY ALL",
}
