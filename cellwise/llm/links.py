"""Connected components of link tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def components(links: DataFrame) -> DataFrame:
    """(node, label) of every node of ``links`` (u, v): the smallest node that it reaches.

    Each round passes the smallest label over the links and then follows the label once more, so paths halve. Labels
    are stored between rounds. Joins carry two narrow columns, which AQE splits where one node holds many links;
    minima are combined before they are shuffled. An empty table gives an empty table.
    """
    both = stored(links.select("u", "v").union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
                  .where("u <> v").distinct())
    labels = stored(both.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("m"))
                    .select("node", F.least("node", "m").alias("label")))
    while True:
        seen = both.join(labels.withColumnRenamed("node", "v"), "v").groupBy(F.col("u").alias("node")).agg(F.min("label").alias("m"))
        passed = stored(labels.join(seen, "node").select("node", "label", F.least("label", "m").alias("next")))
        jump = passed.select(F.col("node").alias("next"), F.col("next").alias("far"))
        new = stored(passed.join(jump, "next", "left")
                     .select("node", "label", F.least("next", F.coalesce("far", "next")).alias("new")))
        changed = new.where("label <> new").limit(1).count()
        labels = new.select("node", F.col("new").alias("label"))
        if not changed:
            return labels


#: Components of table ``link`` (a, b; both directions) over ``node`` (id), to follow those definitions in SQL.
COMPONENT_SQL = """
reach(id, far) as (select id, id from node union select reach.id, link.b from reach join link on reach.far = link.a),
component as (select id, min(far) as component_id from reach group by 1)
"""
