"""Table sources, the fact store, sinks and the audit table."""

from assaybook.sources.tables import Sources  # noqa: F401
