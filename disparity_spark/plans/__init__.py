"""Registered queries of the library and their SQL."""

from . import audits, campaigns, synthetics

QUERIES = audits.QUERIES | synthetics.QUERIES | campaigns.QUERIES
ORACLES = audits.ORACLES | synthetics.ORACLES | campaigns.ORACLES
