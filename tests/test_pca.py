"""PCA from one aggregate against numpy on the same rows."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from faultline.plans.q_forest import pca_view
from faultline.schema import GUARD_FEATURES, LABEL
from faultline.sources.telemetry import telemetry


@pytest.mark.parametrize("healthy", [True, False])
def test_pca_equals_numpy(spark, healthy):
    t = telemetry(spark, SF_SMALL).select("unit_id", LABEL, *GUARD_FEATURES)
    view, share = pca_view(t, fit=F.col(LABEL) == 0 if healthy else None)
    pdf = t.toPandas().sort_values("unit_id")
    x = pdf[list(GUARD_FEATURES)].to_numpy()
    z = (x - x.mean(axis=0)) / x.std(axis=0, ddof=1)
    h = z[pdf[LABEL].to_numpy() == 0] if healthy else z
    values, vectors = np.linalg.eigh(np.cov(h.T))
    values, vectors = values[::-1], vectors[:, ::-1]
    assert np.allclose(share, (values / values.sum())[:2])
    got = view.toPandas().sort_values("unit_id")[["pc1", "pc2"]].to_numpy()
    want = (z - h.mean(axis=0)) @ vectors[:, :2]
    assert np.allclose(np.abs(got), np.abs(want), atol=1e-6)
