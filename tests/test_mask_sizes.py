"""Set operations on masks with a check of sizes: masks that one side lacks are empty there, different sizes are an error."""

import pytest

from rasterloom.operators import masks


def test_sizes(spark):
    sizes = lambda rows: spark.createDataFrame(rows, "mask_id long, width int, height int")
    mask = lambda rows: spark.createDataFrame(rows, "mask_id long, x int, y int")
    a, b = mask([(1, 0, 0), (1, 1, 0), (2, 3, 3)]), mask([(1, 1, 0), (3, 2, 2)])
    sa, sb = sizes([(1, 4, 4), (2, 5, 5)]), sizes([(1, 4, 4), (3, 6, 6)])
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(masks.union(a, b, (sa, sb))) == [(1, 0, 0), (1, 1, 0), (2, 3, 3), (3, 2, 2)]
    assert rows(masks.intersect(a, b, (sa, sb))) == [(1, 1, 0)]
    assert rows(masks.subtract(a, b, (sa, sb))) == [(1, 0, 0), (2, 3, 3)]
    assert rows(masks.check_sizes(sa, sb)) == [(1, 4, 4), (2, 5, 5), (3, 6, 6)]
    with pytest.raises(Exception, match="mask sizes differ"):
        masks.union(a, b, (sa, sizes([(1, 4, 3)]))).collect()
