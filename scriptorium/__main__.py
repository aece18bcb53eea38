"""``python -m scriptorium FOLDER search WORDS | library [WORDS] | open ID | status | query NAME``"""

import sys

from pyspark.sql import SparkSession

from scriptorium import api
from scriptorium.plans import registry


def main(args: list[str]) -> int:
    if len(args) < 2:
        print(__doc__)
        return 2
    folder, command, rest = args[0], args[1], " ".join(args[2:])
    spark = SparkSession.builder.appName("scriptorium").getOrCreate()
    actions = {
        "search": lambda: api.search(spark, folder, rest), "library": lambda: api.library(spark, folder, rest), "open": lambda: api.article(spark, folder, int(rest)),
        "status": lambda: api.status(spark, folder), "query": lambda: registry.QUERIES[rest](spark, folder),
    }
    actions[command]().show(50, truncate=100)
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
