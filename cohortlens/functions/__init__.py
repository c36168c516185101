from .primitives import PRIMITIVES, PrimitiveContext, primitive, default_for
from .scaling import age_years, minmax_scale, affine_with_overrides, recode_text
from .time import ts_ntz, seconds_between, whole_days_between, days_since_epoch

__all__ = ["PRIMITIVES", "PrimitiveContext", "primitive", "default_for", "age_years",
           "minmax_scale", "affine_with_overrides", "recode_text", "ts_ntz",
           "seconds_between", "whole_days_between", "days_since_epoch"]
