"""Files, configuration and rule selection."""

import pytest
from pyspark.sql import functions as F

from tickloom.operators import rules
from tickloom.operators.risk import split_valid
from tickloom.operators.selection import unknown_strategies
from tickloom.operators.targets import TARGETS, default_targets
from tickloom.sources import files


def test_file_names_tell_symbol_and_minutes(spark, tmp_path):
    header = "Date,Open,High,Low,Close,Volume\n"
    (tmp_path / "T.csv").write_text(header + "2024-07-31,5.9000,5.9300,5.7600,5.7897,4654669\n")
    (tmp_path / "TLT_adj.csv").write_text(header + "2024-07-31,1,2,0.5,1.5,10\n")
    (tmp_path / "T_5m.csv").write_text(header + "2024-07-31 09:35:00,1,2,0.5,1.5,10\n")
    rows = {(r.symbol, r.minutes): r for r in files.scan_bars_csv(spark, str(tmp_path)).collect()}
    assert set(rows) == {("T", None), ("TLT", None), ("T", 5)}
    assert rows["T", None].close == 5.7897 and rows["T", None].volume == 4654669
    assert (rows["T", 5].ts.hour, rows["T", 5].ts.minute) == (9, 35)


def test_targets_with_blank_lines_and_spaces(spark, tmp_path):
    lines = ["indicator,minimal target,good target,best target"]
    lines += [f"{n},{a},{b},{c}" for n, a, b, c in TARGETS[:-1]] + ["", "", " Sortino, 1,1.5,2", ""]
    path = tmp_path / "targets.csv"
    path.write_text("\n".join(lines))
    got = sorted(map(tuple, files.scan_targets(spark, str(path)).collect()))
    assert got == sorted(map(tuple, default_targets(spark).collect()))


def test_resolve_rules():
    assert rules.resolve(None) == rules.resolve("all") == rules.resolve("*") == list(rules.RULES)
    assert list(rules.RULES) == sorted(rules.RULES) and len(rules.RULES) == 18
    assert rules.resolve(["Rsi2", "SmaCross", "Rsi2"]) == ["Rsi2", "SmaCross"]
    with pytest.raises(ValueError, match="Nope"):
        rules.resolve(["Nope"])
    with pytest.raises(TypeError):
        rules.resolve([3])


def test_unknown_strategies(spark):
    asked = spark.createDataFrame([("Rsi2",), ("Nope",), ("Nope",)], "strategy string")
    assert [r.strategy for r in unknown_strategies(asked).collect()] == ["Nope"]


def test_own_rule(spark):
    @rules.register("Mine")
    def mine():
        return rules.Signal(("close",), F.col("close") > 1, F.col("close") < 1)

    try:
        df = spark.createDataFrame([(2.0,), (0.5,), (None,)], "close double")
        got = rules.stack_rules(df, ["Mine"], ["close"]).collect()
        assert [(r.entry, r.exit) for r in got] == [(True, False), (False, True), (False, False)]
        with pytest.raises(ValueError):
            rules.register("Mine")(mine)
    finally:
        del rules.RULES["Mine"]


def test_split_valid_names_the_reason(spark):
    schema = "symbol string, ts timestamp, open double, high double, low double, close double, volume long"
    import datetime as dt

    day = dt.datetime(2024, 1, 1)
    rows = [
        ("A", day, 1.0, 2.0, 0.5, 1.5, 1), ("A", day, 1.0, 2.0, 0.5, 1.5, 1), ("B", day, 1.0, None, 0.5, 1.5, 1),
        ("C", day, 1.0, 1.2, 0.5, 1.5, 1), ("D", day, 1.0, 2.0, -0.5, 1.5, 1), ("E", day, 1.0, 2.0, 0.5, 1.5, None),
        (None, day, 1.0, 2.0, 0.5, 1.5, 1),
    ]
    clean, rejected = split_valid(spark.createDataFrame(rows, schema))
    assert [r.symbol for r in clean.collect()] == ["A"]
    assert {(r.symbol, r.reason) for r in rejected.collect()} == {
        ("B", "no price"), ("C", "range broken"), ("D", "price not positive"), ("E", "bad volume"), (None, "no key"),
    }
