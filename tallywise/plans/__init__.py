"""Ready-made queries over the benchmark tables, each with an equivalent SQL statement."""

from . import crosstabs, distribution, files, rows
from .query import Query

CATALOGUE: dict[str, Query] = {
    **rows.QUERIES,
    **crosstabs.QUERIES,
    **distribution.QUERIES,
    **files.QUERIES,
}
