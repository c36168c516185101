"""cohortlens — per-person features and timelines over related patient tables, on Spark."""

from .plans import (ChildConfig, FeatureConfig, FeatureSpec, REFERENCE_CONFIG, feature_matrix,
                    gen_feature_matrix, patient_info, patient_measurements, patient_timeline, plan_features)
from .sources import EntitySet, load_csv, load_dictionary, load_parquet, save

__all__ = [n for n in dir() if not n.startswith("_")]
