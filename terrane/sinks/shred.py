"""Nested documents as a parent table and child tables with ordinals, and put together again exactly.

An absent list and an empty one aren't told apart by child rows: ``missing`` has a reason for a field that is absent, or the
parent keeps a mark for it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# child table -> the array it comes from
CHILDREN = {
    "applicant": "applicants", "inventor": "inventors", "cpc": "cpc", "ipc": "ipc", "priority": "priorities", "family_member": "family_members", "backward_citation": "backward_citations",
}


def shred(docs: DataFrame, key: str) -> tuple[DataFrame, dict[str, DataFrame]]:
    """(parents, children by name). A parent has all other columns and the names of the lists that are there."""
    lists = {child: c for child, c in CHILDREN.items() if c in docs.columns}
    there = F.array_compact(F.array(*[F.when(F.col(c).isNotNull(), F.lit(c)) for c in lists.values()]))
    parents = docs.withColumn("present", there).drop(*lists.values())
    return parents, {child: docs.select(key, F.posexplode(c).alias("ordinal", "value")).withColumn("ordinal", F.col("ordinal") + 1) for child, c in lists.items()}


def reassemble(parents: DataFrame, children: dict[str, DataFrame], key: str) -> DataFrame:
    """The documents: children in the order of their ordinals. A list is as long as one document's."""
    out = parents
    for child, rows in children.items():
        c = CHILDREN[child]
        kind = rows.schema["value"].dataType.simpleString()
        put = F.transform(F.array_sort(F.collect_list(F.struct("ordinal", F.struct("value").alias("v")))), lambda x: x["v"]["value"])
        out = out.join(rows.groupBy(key).agg(put.alias(c)), key, "left")
        out = out.withColumn(c, F.when(F.array_contains("present", c), F.coalesce(c, F.array().cast(f"array<{kind}>"))))
    return out.drop("present")
