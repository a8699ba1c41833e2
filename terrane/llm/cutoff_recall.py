"""Recall of the cut-off operator on planted cuts: python -m terrane.llm.cutoff_recall FOLDER [PART [LEAST ENDS OPEN_LEAST]]

Of the complete texts of ten words or more, one in fifty is cut at a random letter. PART (0 or 1) says which half of the
documents, by hash, is used, so that parameters can be fitted on half 0 and measured on half 1. Complete texts that are
flagged only with the planted ones in the corpus count as false.
"""

from __future__ import annotations

import sys

from pyspark.sql import functions as F

from terrane.llm import cutoff
from terrane.runtime import Scratch, session


def main(folder: str, part: int = 0, *how: float) -> None:
    spark = session("cutoff-recall", "local[8]")
    scratch = Scratch(spark, "recall")
    names = dict(zip(("least", "ends", "open_least"), how))
    if names:
        names |= {k: int(names[k]) for k in ("least", "open_least") if k in names}
    docs = spark.read.parquet(f"{folder}/documents.parquet").where(F.pmod(F.xxhash64("doc_id"), F.lit(2)) == part)
    before = scratch.save(cutoff.judged(docs, **names).select("doc_id", F.col("cut").alias("before")).distinct())
    mine = F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(50)) == 0
    at = (F.length("text") * (0.2 + 0.8 * F.pmod(F.xxhash64("doc_id", F.lit(12)), F.lit(1000)) / 1000)).cast("int")
    docs = docs.join(before, "doc_id", "left").withColumn("planted", mine & F.col("before").isNull() & (F.size(F.split("text", " ")) >= 10) & F.col("text").substr(at - 1, F.lit(3)).rlike(r"^[\p{L} ]{3}$"))
    docs = docs.withColumn("planted", F.coalesce("planted", F.lit(False)))
    docs = scratch.save(docs.withColumn("text", F.when(F.col("planted"), F.col("text").substr(F.lit(1), at)).otherwise(F.col("text"))))
    after = docs.join(cutoff.judged(docs, **names).select("doc_id", "cut").distinct(), "doc_id", "left")
    kind = F.when(F.col("section").isin("title", "signs"), F.col("section")).otherwise("prose")
    rows = after.groupBy(kind.alias("kind")).agg(
        F.count_if("planted").alias("planted"), F.count_if(F.col("planted") & F.col("cut").isNotNull()).alias("found"),
        F.count_if(~F.col("planted") & F.col("before").isNull() & F.col("cut").isNotNull()).alias("false"), F.count_if(~F.col("planted") & F.col("before").isNotNull()).alias("cut before"),
    ).orderBy("kind").collect()
    for r in rows:
        print(*(f"{k}={v}" for k, v in r.asDict().items()))
    print("recall", round(sum(r["found"] for r in rows) / max(1, sum(r["planted"] for r in rows)), 4))
    if "-v" in sys.argv:
        for r in after.where("planted and cut is null").limit(70).collect():
            print(r["section"], repr(r["text"][-80:]))


if __name__ == "__main__":
    args = [a for a in sys.argv[1:] if a != "-v"]
    main(args[0], *map(int, args[1:2]), *map(float, args[2:]))
