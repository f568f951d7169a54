"""tidewatch: sales-risk analytics as Spark DataFrame jobs."""

from tidewatch.config import RiskConfig

__all__ = ["RiskConfig"]
