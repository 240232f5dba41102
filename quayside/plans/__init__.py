"""Registered queries; importing the package registers them all."""

from . import addresses, documents, file_cases, find, lookup_cases, offers, payloads, rules, search, state, store_cases, streams, upkeep, view_cases, web  # noqa: F401
