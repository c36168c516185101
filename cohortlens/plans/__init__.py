from .explorer import (Facet, MEASUREMENT_FACETS, TIMELINE_FACETS, patient_info,
                       patient_measurements, patient_timeline)
from .features import (ChildConfig, FeatureConfig, FeatureResult, FeatureSpec, REFERENCE_CONFIG,
                       defs_from_json, defs_to_json, feature_matrix, gen_feature_matrix,
                       plan_features)

__all__ = [n for n in dir() if not n.startswith("_")]
