"""Table operators: a DataFrame goes in, a DataFrame comes out."""
from tablescope.operators import (  # noqa: F401
    charts,
    clean,
    describe,
    features,
    filters,
    ingest,
    insights,
    isolation,
    outliers,
    profile,
    relate,
    semantics,
    supervised,
    timeseries,
    unsupervised,
)
