"""Imports every module that registers queries."""

from quorumlake.functions import queries  # noqa: F401
from quorumlake.operators import aggregates, badge_actions, changes, coverage, readers, search, sequences, surface, vote_matching  # noqa: F401
from quorumlake.plans.registry import add_aliases
from quorumlake.sources import adapters, listings, minutes, pages, trees  # noqa: F401
from quorumlake.streaming import web  # noqa: F401

add_aliases()
