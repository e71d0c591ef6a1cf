"""All registered queries and their SQL, by name."""

from cohortlake.plans.driver_tables import University

QUERIES, ORACLES = {}, {}


def register(name: str, sql: str | None = None, gold: bool = False):
    """Register a function of a University under a name, with the SQL that must give the same rows.

    ``gold``: a report over derived frames, which reads them from the shared folder.
    """
    def keep(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = lambda spark, folder: fn(University(spark, folder, gold))
        if sql:
            ORACLES[name] = sql
        return fn
    return keep
