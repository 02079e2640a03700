"""python -m postingflow index PARQUET FOLDER | search FOLDER QUERY"""

from __future__ import annotations

import sys

from pyspark.sql import SparkSession

from .operators.index import build_index, load
from .operators.ranges import text_ranges
from .operators.search import search
from .sources.documents import from_parquet


def main(args: list[str]) -> int:
    if len(args) != 3 or args[0] not in ("index", "search"):
        print(__doc__, file=sys.stderr)
        return 2
    spark = SparkSession.builder.appName("postingflow").getOrCreate()
    if args[0] == "index":
        build_index(from_parquet(spark, args[1])).save(args[2])
    else:
        index = load(spark, args[1])
        text_ranges(index, search(index, args[2])).orderBy("doc_id", "hit_index").show(truncate=False)
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
