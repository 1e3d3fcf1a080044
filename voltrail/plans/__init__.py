"""The registered queries; importing the package fills the registry."""

from voltrail.plans import forecasting, history, modelling, profiling, reporting
from voltrail.plans.registry import REGISTRY

__all__ = ["REGISTRY", "forecasting", "history", "modelling", "profiling", "reporting"]
