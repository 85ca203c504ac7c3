import datetime as dt

import pytest
from pyspark.sql import functions as F

from fathomgrid.operators import panel as P
from fathomgrid.sources import files, stores

FACTORS = """This file was made by hand
with two lines before

,Mkt-RF,SMB,HML,RMW,CMA,RF
196307,   -0.39,   -0.41,   -0.97,    0.68,   -1.18,    0.27
196308,    5.07,   -0.80,    1.80,  -99.99,   -0.35,    0.25

 Annual Factors
,Mkt-RF,SMB,HML,RMW,CMA,RF
  1964,   12.54,    0.40,    9.82,   -2.76,    6.75,    3.54
"""
MOMENTUM = """preamble

,Mom
196307,  1.00
196308,  -99.9900
196309,  0.16

  1963,  22.00
"""
MACRO = '''yyyymm,Index,D12,E12,b/m,ntis,svar,tbl,infl,BAA,AAA,lty
196306,"1,069.37",2.1,3.9,0.5,0.01,0.001,0.03,0.002,0.048,0.042,0.04
196307,69.13,NaN,3.9,0.5,0.01,0.001,0.03,0.002,0.048,0.042,0.04
'''
PORTFOLIOS = """Some text
  Average Value Weighted Returns -- Monthly
,SMALL LoBM , ME1 BM2
196307,   1.13,  -999
196308,   4.21,   1.16

  Average Equal Weighted Returns -- Monthly
,SMALL LoBM , ME1 BM2
196307,   9.99,   9.99
"""


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("raw")
    for name, text in (("five.csv", FACTORS), ("mom.csv", MOMENTUM), ("macro.csv", MACRO), ("cut.csv", PORTFOLIOS.split("\n\n")[0])):
        (d / name).write_text(text)
    for name in files.UNIVERSES.values():
        (d / name).write_text(PORTFOLIOS)
    return d


def test_five_factors(spark, folder):
    df = files.load_five_factors(spark, str(folder / "five.csv"))
    rows = df.orderBy("month").collect()
    assert df.columns == ["month", "Mkt-RF", "SMB", "HML", "RMW", "CMA", "RF"]
    assert [r["month"] for r in rows] == [dt.date(1963, 7, 1), dt.date(1963, 8, 1)]
    assert rows[0]["Mkt-RF"] == pytest.approx(-0.0039) and rows[1]["RMW"] is None


def test_momentum_and_join(spark, folder):
    m = files.load_momentum(spark, str(folder / "mom.csv")).orderBy("month").collect()
    assert [r["UMD"] for r in m] == [pytest.approx(0.01), None, pytest.approx(0.0016)]
    both = files.load_factors(spark, str(folder / "five.csv"), str(folder / "mom.csv"))
    assert both.count() == 2 and "RF" in both.columns and "UMD" in both.columns


def test_macro(spark, folder):
    rows = files.load_macro(spark, str(folder / "macro.csv")).orderBy("month").collect()
    assert rows[0]["Index"] == pytest.approx(1069.37) and rows[1]["D12"] is None
    made = P.macro_features(files.load_macro(spark, str(folder / "macro.csv"))).orderBy("month").collect()
    assert made[0]["DY"] is None and made[1]["DY"] is None and made[0]["DFY"] == pytest.approx(0.006)


def test_portfolios(spark, folder):
    df = files.load_portfolios(spark, "size_bm_25", str(folder))
    got = {(r["asset"], r["month"].month): r["ret"] for r in df.collect()}
    assert got == {("SMALL LoBM", 7): pytest.approx(0.0113), ("ME1 BM2", 7): None, ("SMALL LoBM", 8): pytest.approx(0.0421), ("ME1 BM2", 8): pytest.approx(0.0116)}
    assert files.load_all_portfolios(spark, str(folder)).select("universe").distinct().count() == 3
    with pytest.raises(ValueError):
        files.load_portfolios(spark, "size_bm_7", str(folder))


def test_section_without_blank_end(spark, folder):
    names, rows = files.section(spark, str(folder / "cut.csv"), F.contains("line", F.lit(files.PORTFOLIO_MARKER)), 1)
    assert names == ["SMALL LoBM", "ME1 BM2"] and rows.count() == 2
    with pytest.raises(ValueError):
        files.section(spark, str(folder / "cut.csv"), F.startswith("line", F.lit("nothing")))


def test_restricted_fails_on_missing_months(spark, folder):
    df = files.load_five_factors(spark, str(folder / "five.csv"))
    assert P.restricted(df, df).count() == 2
    with pytest.raises(Exception, match="months are missing"):
        P.restricted(df, files.load_momentum(spark, str(folder / "mom.csv"))).count()


def test_stores(spark, tmp_path):
    panel = spark.createDataFrame([("u", "a", dt.date(2000, m, 1), m - 1, [1.0, m / 10]) for m in (1, 2, 3)], "universe string, asset string, month date, t int, f array<double>")
    stores.save_panel(panel, str(tmp_path / "p"), ["intercept", "x"], ["z"])
    assert stores.load_panel(spark, str(tmp_path / "p"), "u").count() == 3 and stores.load_panel(spark, str(tmp_path / "p"), "v").count() == 0
    assert stores.load_predictor_names(spark, str(tmp_path / "p"), "u", 2) == ["intercept", "x"]
    assert stores.load_predictor_names(spark, str(tmp_path / "p"), "u", 3) == ["x0", "x1", "x2"]
    assert stores.load_predictor_names(spark, str(tmp_path / "none"), "u", 1) == ["x0"]
    draws = spark.createDataFrame([("u", "m", "s", c, d, "B", 0, 0, float(d)) for c in (1, 2, 10) for d in (0, 1)], "universe string, model string, setting string, chain int, draw int, field string, i int, j int, value double")
    stores.save_draws(draws, str(tmp_path / "d"), ["tau"])
    chains = stores.load_chains(spark, str(tmp_path / "d"), "u", "m", "s")
    assert stores.chain_numbers(chains) == [1, 2, 10] and stores.absent_fields(spark, str(tmp_path / "d"), "u", "m", "s") == ["tau"]
    assert stores.load_draws(spark, str(tmp_path / "d"), "u", "m", "s", 10).count() == 2
    with pytest.raises(FileNotFoundError, match="there are s"):
        stores.load_chains(spark, str(tmp_path / "d"), "u", "m", "other")
    f = spark.createDataFrame([("u", "m", "s", "a", 3, 3, 0.1, 0.2, 0.3)], "universe string, model string, setting string, asset string, t int, t_refit int, predicted double, realised double, benchmark double")
    stores.save_backtest(f, str(tmp_path / "b"))
    assert stores.load_backtest(spark, str(tmp_path / "b"), "u", "m", "s").count() == 1
    stores.save_csv(f, str(tmp_path / "c"))
    assert spark.read.csv(str(tmp_path / "c"), header=True).count() == 1
    assert r"0.100" in stores.latex_table(f.select("universe", "predicted"))
    with pytest.raises(ValueError):
        stores.latex_table(spark.range(5), most=3)
