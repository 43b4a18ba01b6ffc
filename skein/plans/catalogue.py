"""All queries."""

from skein.plans import bibliography, datasets, labelling, modelling, texts  # noqa: F401
from skein.plans.registry import ORACLE_SQL, QUERIES  # noqa: F401
