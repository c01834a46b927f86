import inspect

from pitwright import catalog
from pitwright.operators import stress

SF = "/root/testdata/sf0.001"


def test_overfitting_takes_all_splits_of_16_blocks(spark):
    (row,) = catalog.QUERIES["a03_overfitting"](spark, SF).collect()
    assert row.partitions == 12870 and 0 <= row.pbo <= 1


def test_mixture_has_8_restarts_of_200_steps():
    given = inspect.signature(stress.fit_mixture).parameters
    assert (given["restarts"].default, given["steps"].default) == (8, 200)
