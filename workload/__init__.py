"""Registered queries over the test tables, each with the SQL that gives the same rows."""

from . import (
    edge_cases,
    histories,
    incident_flows,
    lineages,
    monitor_checks,
    profiles,
    root_causes,
    statistics,
    streams,
    suites,
)

AREAS = (
    suites, statistics, monitor_checks, profiles, histories, root_causes, incident_flows, lineages, streams,
    edge_cases,
)

QUERIES = {name: fn for area in AREAS for name, fn in area.QUERIES.items()}
ORACLE = {name: sql for area in AREAS for name, sql in area.ORACLE.items()}
