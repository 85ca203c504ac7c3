"""The production panel from raw files: load, align, delete listwise, features, z-scores, interactions, assembly."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fathomgrid.operators import features as X
from fathomgrid.operators import panel as P
from fathomgrid.sources import files

MACRO = ["BM", "NTIS", "SVAR", "TBL", "CPI", "DY", "EP", "DFY", "TMS"]
FACTORS = ["Mkt-RF", "SMB", "HML", "RMW", "CMA", "UMD"]
#: Rows of each asset that go before its z-scores are steady.
STABILISATION = 30


def clean(spark: SparkSession, universe: str, folder: str, five: str, momentum: str, macro: str, dropped: list[str] = ()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Excess returns, factors (without RF) and macro columns over the common range, restricted to retained months."""
    factors = files.load_factors(spark, five, momentum)
    excess = P.excess_returns(files.load_portfolios(spark, universe, folder), factors)
    excess, factors, rates = P.common_range(excess, factors, files.load_macro(spark, macro))
    excess = P.listwise(excess, drop=list(dropped))
    months = excess.select("month").distinct()
    return excess, P.restricted(factors.drop("RF"), months), P.restricted(rates, months)


def build(excess: DataFrame, factors: DataFrame, macro: DataFrame, stabilisation: int = STABILISATION) -> tuple[DataFrame, list[str]]:
    """The panel (universe, asset, month, t, r_next, f) and its predictors' names.

    Z-scores are taken over all rows, before any are dropped; the stabilisation is counted before rows with nulls go.
    """
    common = [*MACRO, *FACTORS]
    shared = X.expanding_zscore(P.macro_features(macro).join(factors, "month"), common, ())
    own = X.lead_response(X.expanding_zscore(X.own_history(excess), X.OWN))
    rows = P.complete(P.stabilised(own, stabilisation).join(shared, "month"), [*common, *X.OWN, "r_next"])
    return X.numbered(P.assembled(rows, common, X.OWN, ["universe", "asset", "month", "r_next"])), P.predictor_names(common, X.OWN)
