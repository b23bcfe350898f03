"""All registered queries by name, with the SQL that checks them."""

from __future__ import annotations

from . import bytes_and_schemas, catalogue_texts, extras, files, geo, grids, learning, marks, models, neighbourhood, radiometric, raster, records, scenes, search, strings, tiles  # noqa: F401
from .registry import ORACLE_SQL, QUERIES  # noqa: F401
