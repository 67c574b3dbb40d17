"""Rules with parameters: the usual values give the rules of the catalogue."""

import pytest
from pyspark.sql import functions as F

from tickloom.catalog.registry import laid, laid_in_chunks
from tickloom.operators.rules import RULES
from tickloom.operators.variants import PARAMETERS, Variant, grid, random_search, variant_signals
from tickloom.plans.backtest import signals
from tickloom.plans.layout import own_rows


def test_every_rule_has_parameters():
    assert set(PARAMETERS) == set(RULES)


@pytest.mark.parametrize("chunked", [False, True])
def test_usual_values(spark, folder, chunked):
    variants = [Variant.of(name) for name in RULES]
    bars = (lambda: laid_in_chunks(spark, folder, 1_700)) if chunked else (lambda: laid(spark, folder))
    columns = ["symbol", "strategy", "ts", F.col("entry").cast("int").alias("entry"), F.col("exit").cast("int").alias("exit")]
    got = own_rows(*variant_signals(*bars(), variants)).select(*columns)
    wanted = own_rows(*signals(*laid(spark, folder))).select(*columns)
    assert got.exceptAll(wanted).count() == 0 and wanted.exceptAll(got).count() == 0


def test_choices():
    assert len(grid("GoldenCross", fast=[10, 20], slow=[50, 100])) == 4
    drawn = random_search("DonchianTurtle", 5, 1, period=range(5, 50))
    assert len(set(drawn)) == 5 and drawn == random_search("DonchianTurtle", 5, 1, period=range(5, 50))
    assert len(random_search("DonchianTurtle", 9, 1, period=[1, 2])) == 2
    with pytest.raises(ValueError):
        Variant.of("BuyAndHold", period=3)
