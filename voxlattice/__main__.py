"""Read a JSON document, shift it by ten cells of zoom 25 along x, write it again.

``python -m voxlattice INPUT.json OUTPUT_FOLDER [VALUE_TYPE]``
"""

import sys

from pyspark.sql import SparkSession

from voxlattice.plans.query import Query
from voxlattice.sources import jsonio


def main(args: list[str]) -> int:
    if len(args) not in (2, 3):
        print(__doc__)
        return 2
    spark = SparkSession.builder.appName("voxlattice").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    cells = jsonio.read_frame(spark, args[0], 25, args[2] if len(args) == 3 else "bigint")
    jsonio.write_document(Query.of(cells).shift_x(25, 10).run(), args[1])
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
