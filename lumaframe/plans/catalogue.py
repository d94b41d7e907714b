"""Registry of the queries over the driver tables and their SQL oracles."""

from . import archive, extras, ledger, light, more, records, scout, sky, stores, wording  # noqa: F401

# the modules share one registry
QUERIES = dict(archive.QUERIES)
ORACLES = dict(archive.ORACLES)
