import pytest

from framelake.operators import tracks

CLIP = "id long, ref long, kind string, num long, den long, origin long, offset long"


def clips(spark, rows):
    return spark.createDataFrame([(i, ref, kind, 25, 1, 1, 0) for i, ref, kind in rows], CLIP)


def test_long_chains_keep_their_rows(spark):
    df = clips(spark, [(0, None, "tape"), *((i, i - 1, "file") for i in range(1, 41)), (50, 50, "file"), (51, 50, "file"), (52, 99, "file")])
    got = {r.start: (r.target, r.offset, r.hops) for r in tracks.resolve_chain(spark, df, "tape").collect()}
    assert got == {i: (0, i, i) for i in range(1, 41)}


def test_circles_raise(spark):
    with pytest.raises(ValueError, match="comes back"):
        tracks.resolve_chain(spark, clips(spark, [(0, None, "tape"), (1, 2, "file"), (2, 3, "file"), (3, 1, "file"), (4, 1, "file")]), "tape")
    through = clips(spark, [(0, 1, "tape"), (1, 0, "file")])  # a tape ends the chain of 1 and is the start of another
    assert {(r.start, r.target) for r in tracks.resolve_chain(spark, through, "tape").collect()} == {(1, 0), (0, 0)}
