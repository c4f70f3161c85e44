"""Registered queries: importing the modules fills the registry."""

from __future__ import annotations

import functools

from agentguard.plans import auditing, detection, events, fleets, policies, streams, tables  # noqa: F401
from agentguard.plans.base import REGISTRY
from agentguard.session import SESSION_CONF, ship_package

__all__ = ["REGISTRY", "prepare"]


def prepare(run):
    """Run a query in a session whose result-changing settings are fixed and whose workers have the package."""

    @functools.wraps(run)
    def wrapped(spark, sf):
        ship_package(spark)
        for key, value in SESSION_CONF.items():
            spark.conf.set(key, value)
        return run(spark, sf)

    return wrapped
