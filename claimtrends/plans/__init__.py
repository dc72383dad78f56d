from .pipeline import (
    Dashboard,
    Stages,
    aggregates_from_claims,
    dashboard,
    forecast,
    product_features,
    quality_checked,
    risks_from_features,
    run,
    series_features,
    stages_from_claims,
)
from .refresh import read_stages, refresh

__all__ = [
    "Dashboard", "Stages", "aggregates_from_claims", "dashboard", "forecast", "product_features", "quality_checked",
    "read_stages", "refresh", "risks_from_features", "run", "series_features", "stages_from_claims",
]
