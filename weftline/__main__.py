"""python -m weftline run CONFIG INPUT OUTPUT | profile INPUT FIELD... | clusters OUTPUT"""

from __future__ import annotations

import sys


def main(args: list[str]) -> int:
    if len(args) < 2 or args[0] not in ("run", "profile", "clusters"):
        print(__doc__)
        return 2
    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    from .operators.learning import profile
    from .plans.pipeline import Config, run, run_stats
    from .sources.writers import export_clusters, write_table

    spark = SparkSession.builder.appName("weftline").getOrCreate()
    if args[0] == "run":
        df = spark.read.parquet(args[2])
        out = run(df, Config.load(args[1]))
        for name in ("edges", "members", *(["golden"] if "golden" in out else [])):
            write_table(out[name], f"{args[3]}/{name}")
        export_clusters(out["members"], f"{args[3]}/clusters")
        run_stats(df, out).show(truncate=False)
    elif args[0] == "profile":
        profile(spark.read.parquet(args[1]), args[2:]).show(truncate=False)
    else:
        spark.read.json(f"{args[1]}/clusters/json").orderBy(F.desc("size"), "cluster_id").show(truncate=False)
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
