"""Registered queries with their SQL."""

from . import campaigns, columns, graph, messages, reports, training

PLANS = (campaigns, columns, graph, messages, reports, training)
