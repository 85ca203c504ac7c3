import numpy as np
import pytest

from fathomgrid import cli
from fathomgrid.operators.features import OWN
from fathomgrid.plans import dataset
from fathomgrid.sources import files, stores


def raw_files(folder, months=180):
    rng = np.random.default_rng(0)
    when = [f"{1970 + m // 12}{m % 12 + 1:02d}" for m in range(months)]
    cell = lambda n, sd=3.0: ",".join(f"{x:7.2f}" for x in rng.normal(0.5, sd, n))
    body = lambda n: "\n".join(f"{w},{cell(n)}" for w in when)
    (folder / "five.csv").write_text(f"text\n\n,Mkt-RF,SMB,HML,RMW,CMA,RF\n{body(6)}\n\n1999,1\n")
    (folder / "mom.csv").write_text(f",Mom\n{body(1)}\n\n")
    names = "Index,D12,E12,b/m,ntis,svar,tbl,infl,BAA,AAA,lty"
    (folder / "macro.csv").write_text(f"yyyymm,{names}\n" + "\n".join(f"{w}," + ",".join(f"{x:.4f}" for x in np.abs(rng.normal(2, 0.3, 11))) for w in when))
    for u in ("size_bm_25", "size_op_25"):
        (folder / files.UNIVERSES[u]).write_text(f"x\nAverage Value Weighted Returns -- Monthly\n,A,B,C\n{body(3)}\n\nother\n")


def test_from_raw_files_to_statistics(spark, tmp_path, monkeypatch, capsys):
    monkeypatch.setattr(cli, "local", lambda cores: spark)
    raw_files(tmp_path)
    store = str(tmp_path / "store")
    cli.main(["build", "--store", store, "--universe", "size_bm_25", "size_op_25", "--folder", str(tmp_path), "--five", f"{tmp_path}/five.csv", "--momentum", f"{tmp_path}/mom.csv", "--macro", f"{tmp_path}/macro.csv"])
    panel = stores.load_panel(spark, f"{store}/size_bm_25")
    row = panel.first()
    assert len(row["f"]) == 144 == len(stores.load_predictor_names(spark, f"{store}/size_bm_25", "size_bm_25", 144)) and row["f"][0] == 1.0
    assert panel.count() == 3 * (180 - 1 - 30) and len(dataset.MACRO) + len(dataset.FACTORS) == 15 and len(OWN) == 8
    for u in ("size_bm_25", "size_op_25"):
        for model in ("ridge", "gaussian"):
            cli.main(["backtest", "--store", store, "--universe", u, "--model", model, "--start", "120", "--draws", "6", "--burn", "2", "--skip-lookahead"])
    assert '"r2"' in capsys.readouterr().out
    cli.main(["cross-sort", "--store", store, "--model", "ridge"])
    cli.main(["sharpe-test", "--store", store, "--pairs", "ridge:gaussian", "--replicates", "49"])
    cli.main(["summary", "--store", store, "--universe", "size_bm_25", "--ranges"])
    text = capsys.readouterr().out
    assert "stacked" in text and r"\begin{tabular}" in text
    cli.main(["fit", "--store", store, "--universe", "size_bm_25", "--model", "gaussian", "--chains", "2", "--draws", "12", "--burn", "2"])
    cli.main(["diagnose", "--store", store, "--universe", "size_bm_25", "--model", "gaussian", "--fields", "b_bar"])
    assert "max_rhat" in capsys.readouterr().out
    fit = ["fit", "--store", store, "--universe", "size_bm_25", "--chains", "2", "--draws", "10", "--burn", "2", "--model"]
    cli.main([*fit, "gaussian", "--setting", "given", "--prior", "default", "--sequential"])
    cli.main([*fit, "regularised", "--p0", "5", "--nu", "5", "--slab-scale", "0.3", "--n-choice", "NT"])
    cli.main(["diagnose", "--store", store, "--universe", "size_bm_25", "--model", "regularised", "--setting", "main", "gaussian:main", "gaussian:given", "--fields", "b_bar", "tau", "--p0", "5", "--top", "4"])
    text = capsys.readouterr().out
    for name in ("median_overlap", "n_settings", "prior_excluded", "mean_ratio", "interaction", "rho"):
        assert name in text
    for bad in (["lasso", "--p0", "5"], ["lasso", "--sequential"]):
        with pytest.raises(SystemExit):
            cli.main([*fit, *bad])
    with pytest.raises(SystemExit):
        cli.main(["backtest"])
