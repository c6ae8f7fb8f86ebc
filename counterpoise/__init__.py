"""Comparison groups, representative samples and training-data operators as Spark plans."""

from counterpoise.config import MatchConfig, SamplingConfig
from counterpoise.operators.coverage import CapacityReport, InsufficientStratumCapacityWarning
from counterpoise.operators.profile import DataReport, InsufficientControlPoolWarning
from counterpoise.plans.matching import ControlMatcher, MatchResult, Report
from counterpoise.plans.sampling import DownsampleReport, DownsampleResult, random_downsample

__all__ = [
    "CapacityReport",
    "ControlMatcher",
    "DataReport",
    "DownsampleReport",
    "DownsampleResult",
    "InsufficientControlPoolWarning",
    "InsufficientStratumCapacityWarning",
    "MatchConfig",
    "MatchResult",
    "Report",
    "SamplingConfig",
    "random_downsample",
]
