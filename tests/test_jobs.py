from barloom.operators import evolve as ev
from barloom.operators import leaderboard as bd
from barloom.plans import jobs
from barloom.sources.bars import hourly_bars


def test_discover_and_grade(spark, tmp_path):
    bars = hourly_bars(spark, "/root/testdata/sf0.01").persist()
    small = ev.Settings(population=40, generations=2, phases=(1, 1, 0))
    meta, wins = jobs.discover(bars, "click", small, generations=2, horizon=20, window=100, out=str(tmp_path / "run"), seed=5)
    rows = meta.orderBy("fold").collect()
    assert [r["fold"] for r in rows] == [1, 2] and all(r["winner"] == (r["fail_reason"] is None) for r in rows)
    again, _ = jobs.discover(bars, "click", small, generations=1, horizon=20, window=100, seed=5)
    assert again.first()["formula"] == rows[0]["formula"]
    assert spark.read.parquet(str(tmp_path / "run" / "generations")).count() == 2
    fits = meta.selectExpr("*").fillna(1.0)
    board = jobs.grade(fits.fillna(0, ["n_long", "n_short"]), meta, ["feat_icp"], str(tmp_path / "board"), "random_walk")
    assert board.count() == 2 and set(bd.WINS) <= set(board.columns)


def test_audit(spark, tmp_path):
    bars = hourly_bars(spark, "/root/testdata/sf0.01")
    reports = jobs.audit(bars, str(tmp_path / "audit"), horizon=20)
    text = "\n".join(r[0] for r in spark.read.text(str(tmp_path / "audit" / "audit_text")).collect())
    assert all(f"## {name}" in text for name in reports)
