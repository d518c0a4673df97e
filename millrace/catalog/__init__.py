"""Every operator as a query over the test tables, with the SQL that checks it."""

from millrace.catalog.registry import ORACLE, QUERIES  # noqa: F401
from millrace.catalog import (  # noqa: F401  (each module registers its queries)
    aggregates, basics, custom, feature_set, joins, models, order, plots, series, streams, text,
)
