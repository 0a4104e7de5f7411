"""Feature engineering, target encoding and cross-validated scoring as Spark jobs."""

from stratafold.plans.fold_matrix import encode_fold_features
from stratafold.plans.matrix import build_feature_matrices
from stratafold.plans.training import cross_validated_fit

__all__ = ["build_feature_matrices", "cross_validated_fit", "encode_fold_features"]
