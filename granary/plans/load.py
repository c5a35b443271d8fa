"""All query modules."""

from granary.plans import q_evaluate, q_features, q_mining, q_models, q_profile, q_quality, q_similarity, q_tasks  # noqa: F401
from granary.plans.catalog import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
