"""Registered queries; importing the package registers them all."""

from listmill.plans import details, feeds, pages, records, registry  # noqa: F401
