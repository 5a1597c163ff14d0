"""Queries over the given tables, each with the SQL it is checked against."""


def all_registries():
    from checks import audit, preparation, scoring, search

    return [preparation.R, scoring.R, audit.R, search.R]
