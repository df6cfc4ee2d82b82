"""Small frames for tests."""

from voxlattice.frame import cells_frame


def frame(spark, rows, z=20, value="bigint", timed=False):
    """``rows``: (f, x, y[, t0, t1], value)."""
    time = "t0 long, t1 long, " if timed else ""
    return cells_frame(spark.createDataFrame(rows, f"f int, x int, y int, {time}value {value}"), z)


def as_dict(frame):
    """{key: value} of a frame; a repeated key fails."""
    rows = frame.df.collect()
    out = {tuple(r[k] for k in frame.keys): r["value"] for r in rows}
    assert len(out) == len(rows)
    return out


def along_x(frame):
    return {k[1]: v for k, v in as_dict(frame).items()}
