"""All registered queries; importing the catalogs fills the registry."""

from phasefold.plans import catalog_maps, catalog_rows, catalog_scores, catalog_space  # noqa: F401
from phasefold.plans.fixtures import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
