"""Explicit failure rules layered over model output (batch-scoring semantics).

Precedence: overstrain over heat over the model. All rules are Column
expressions, so a scored frame gets its overrides inside the same stage.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.functions.physics import nan_to_null

# Fixed rule thresholds (equal to the original dashboard's batch rules).
HEAT_GAP_K = 7.0
OSF_WEAR_HIGH, OSF_TORQUE = 200.0, 45.0
OSF_WEAR_MID, OSF_STRAIN = 180.0, 11000.0
HEAT_TYPE, OSF_TYPE = 1, 3
DETECTION_THRESHOLD = 0.25
HEAT_FLOOR, OSF_FLOOR = 0.26, 0.75


def heat_rule(cols) -> Column:
    if "temp_diff_k" not in cols:
        return F.lit(False)
    return F.coalesce(nan_to_null("temp_diff_k") < F.lit(HEAT_GAP_K), F.lit(False))


def overstrain_rule(cols) -> Column:
    """(wear>200 AND torque>45) OR (wear>180 AND strain>11000); absent columns drop their clause.

    Without a torque column the first clause is ``wear > 200`` alone; without
    a strain column only the first clause applies; without wear the rule is off.
    """
    cols = set(cols)
    if "tool_wear_min" not in cols or not ({"torque_nm", "strain_load"} & cols):
        return F.lit(False)
    wear = nan_to_null("tool_wear_min")
    first = wear > F.lit(OSF_WEAR_HIGH)
    if "torque_nm" in cols:
        first = first & (nan_to_null("torque_nm") > F.lit(OSF_TORQUE))
    rule = first
    if "strain_load" in cols:
        rule = rule | ((wear > F.lit(OSF_WEAR_MID)) & (nan_to_null("strain_load") > F.lit(OSF_STRAIN)))
    return F.coalesce(rule, F.lit(False))


def rule_flags(df: DataFrame) -> DataFrame:
    return df.withColumns({"heat_rule": heat_rule(df.columns), "overstrain_rule": overstrain_rule(df.columns)})


def rule_prediction(df: DataFrame, out: str = "pred") -> DataFrame:
    """Deterministic rule-only prediction: heat OR overstrain (INT 0/1)."""
    return df.withColumn(out, (heat_rule(df.columns) | overstrain_rule(df.columns)).cast("int"))


def apply_overrides(df: DataFrame, pred: str = "detector_pred", code: str = "diagnosis",
                    prob: str | None = "detector_prob") -> DataFrame:
    """Force flagged rows and failure types: overstrain (type 3) > heat (type 1) > model.

    ``final_pred`` is 1 when the model or any rule fires; ``final_type`` is the
    rule type when a rule fires, else the model's diagnosis for flagged rows,
    NULL for rows nobody flagged. ``display_prob`` is the re-aimed displayed
    risk: deterministic floors 0.26 (heat) and 0.75 (overstrain).
    """
    heat, osf = heat_rule(df.columns), overstrain_rule(df.columns)
    final_pred = F.when(osf | heat, F.lit(1)).otherwise(F.col(pred).cast("int"))
    diag = F.col(code) if code in df.columns else F.lit(None).cast("int")
    final_type = (F.when(osf, F.lit(OSF_TYPE)).when(heat, F.lit(HEAT_TYPE))
                  .when(F.col(pred) == 1, diag.cast("int")).otherwise(F.lit(None).cast("int")))
    cols = {"heat_rule": heat, "overstrain_rule": osf, "final_pred": final_pred, "final_type": final_type}
    if prob and prob in df.columns:
        p = F.col(prob)
        cols["display_prob"] = (F.when(osf, F.greatest(p, F.lit(OSF_FLOOR)))
                                .when(heat, F.greatest(p, F.lit(HEAT_FLOOR))).otherwise(p))
    return df.withColumns(cols)
