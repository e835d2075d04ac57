"""From results to curves, fits, crossovers and figure data in one job.

The runs are read once: the curve is written to the scratch folder and everything later
works on it and on the equally small fits.
"""

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from curvekit import fixed_values as fv
from curvekit.operators.crossover import crossover_keys, crossovers
from curvekit.operators.curves import learning_curve
from curvekit.operators.fit import SHIPPED_BOUNDS, Bounds, fit_written_curve
from curvekit.operators.flatten import expand_metrics, flatten_runs, metric_names
from curvekit.operators.series import figure_series
from curvekit.session import materialize
from curvekit.sources.readers import RUN_FILES, scan_runs


@dataclass(frozen=True)
class Analysis:
    curve: DataFrame
    fits: DataFrame
    crossovers: DataFrame

    @property
    def summary(self) -> DataFrame:
        """One row per group: parameters, fit quality and crossover with the baseline."""
        by = [c for c in self.crossovers.columns if c not in ("baseline", "n_cross", "degenerate")]
        keep = [*by, "fit_status", "a", "b", "c", "r2", "n_points"]
        return self.fits.select(*keep).join(self.crossovers.select(*by, "n_cross"), by, "left")

    @property
    def figure_series(self) -> DataFrame:
        by = [c for c in self.crossovers.columns if c not in ("method", "baseline", "n_cross", "degenerate")]
        return figure_series(self.curve, self.fits, crossover_keys(self.crossovers), by)


def analyse(
    runs: DataFrame,
    by: Sequence[str] = (),
    bounds: Bounds = SHIPPED_BOUNDS,
    baseline: str = fv.BASELINE_METHOD,
    metric: str = "primary_metric",
) -> Analysis:
    """Curves, fits and crossovers of every method within each `by` group."""
    keys = [*by, "method"]
    curve = materialize(learning_curve(runs, keys, metric=metric), "curve")
    fits = materialize(fit_written_curve(curve, keys, bounds), "fits")
    return Analysis(curve, fits, crossovers(fits, by, baseline))


def aggregate_runs(
    spark: SparkSession, root: str, files: str = RUN_FILES, one_per_file: bool = True
) -> DataFrame:
    """Run files to the results table with one column per metric.

    The files are parsed once: finding the metric names and building the columns both
    read the written flat table.
    """
    flat = materialize(flatten_runs(scan_runs(spark, root, files, one_per_file)), "flat-runs")
    return expand_metrics(flat, metric_names(flat, "source_file"))
