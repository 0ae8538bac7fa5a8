"""All queries by area; importing this registers them."""

from evalquarry.catalog import audit, codecs, comparing, evidence, files, more, reports, retrieval, runs, scalar, stores, telemetry  # noqa: F401
