"""Names under which queries are registered."""

from __future__ import annotations

from panelspark.plans.fixtures import Inputs

QUERIES = {}


def query(name: str):
    """Register a function of :class:`Inputs` as a query of (session, data folder)."""

    def add(build):
        def run(spark, sf_dir):
            return build(Inputs(spark, sf_dir))

        run.__doc__ = build.__doc__
        QUERIES[name] = run
        return build

    return add


def rounded(df, digits=6, **overrides):
    """Round every double column so that summation order does not show in comparisons.

    ``None`` leaves a column as it is: prices are exact in every engine.
    """
    from pyspark.sql import functions as F

    cols = {}
    for field in df.schema.fields:
        places = overrides.get(field.name, digits)
        if field.dataType.typeName() == "double" and places is not None:
            cols[field.name] = F.round(F.col(f"`{field.name}`"), places) + F.lit(0.0)
    return df.withColumns(cols) if cols else df
