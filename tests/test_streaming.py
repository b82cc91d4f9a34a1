"""The streaming composite against the batch operator, with files that arrive out of order."""

import random

from pyspark.sql import functions as F

from geoexposure.operators import raster
from geoexposure.streaming import composite

SCHEMA = "row int, col int, k int, value double, cloud int"


def test_late_files_replace_what_was_kept(spark, tmp_path):
    rnd = random.Random(3)
    rows = [(r, c, k, rnd.uniform(0, 9), rnd.randrange(4)) for k in range(12) for r in range(8) for c in range(9) if rnd.random() < 0.7]
    (tmp_path / "in").mkdir()
    granules = list(range(12))
    rnd.shuffle(granules)
    seen = composite.first_clear_stream(composite.stream_cells(spark, str(tmp_path / "in"), SCHEMA, 1), ["k"], F.col("cloud") < 2)
    replaced = []
    for part in (granules[:7], granules[7:]):  # the second part arrives after a restart
        for k in part:
            spark.createDataFrame([r for r in rows if r[2] == k], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        query = composite.follow(seen, str(tmp_path / "out"), str(tmp_path / "check"))
        query.awaitTermination(120)
        assert query.exception() is None
        got = sorted(map(tuple, composite.current(spark, str(tmp_path / "out")).select("row", "col", "k", "value", "cloud").collect()))
        here = [r for r in rows if r[2] in (part if not replaced else granules)]
        batch = raster.first_clear_observation(spark.createDataFrame(here, SCHEMA), ["k"], F.col("cloud") < 2)
        assert got == sorted(map(tuple, batch.select("row", "col", "k", "value", "cloud").collect()))
        replaced.append(got)
    early, late = ({r[:2]: r[2] for r in got} for got in replaced)
    assert any(late[c] < early[c] for c in early) and len(late) > 60
