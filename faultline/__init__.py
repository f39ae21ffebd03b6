"""faultline — predictive-maintenance analytics as Spark DataFrame operators.

Physics features, imbalanced-data preparation, a three-layer anomaly guard,
a two-stage detector/diagnoser cascade, evaluation tables and what-if drift
projections, all expressed as DataFrame / SQL / MLlib plans so that the same
definitions run on a laptop and on a cluster.
"""

from faultline.session import get_spark, checkpoint_dir  # noqa: F401

__version__ = "0.1.0"
