"""Versioned model store, restart of a run from its finished tables, clean-up, load metrics."""

import datetime as dt
import os

import pytest

from provend import files
from provend.plans import pipeline
from provend.plans.staging import Staging
from provend.session import ensure_checkpoint_dir, materialize, scratch_folder, stage_table
from provend.sources import vouchers as vs
from provend.sources.store import DamagedVersion, Store

HEADER = "Date,Vch/Bill No,Particulars,Item Details,Qty.,Price,Amount,Unit"


def ids(version, name="t"):
    return sorted(r.id for r in version.table(name).collect())


def test_versions_and_pointer(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    assert store.current() is None
    with store.new_version(settings="a") as v:
        v.add_table("t", spark.range(3))
    first = store.current()
    assert ids(first) == [0, 1, 2] and first.rows == {"t": 3} and first.info == {"settings": "a"}
    with store.new_version() as v:
        v.add_table("t", spark.range(5))
    assert ids(store.current()) == list(range(5)) and ids(first) == [0, 1, 2]  # readers keep what they opened
    with store.new_version() as v:
        v.add_table("t", spark.range(1))
    assert len(files.names(spark, f"{store.root}/versions")) == 2 and ids(store.current()) == [0]


def test_a_write_that_fails_half_way_leaves_the_version_before(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    with store.new_version() as v:
        v.add_table("t", spark.range(3))
    with pytest.raises(RuntimeError, match="lost"):
        with store.new_version() as v:
            v.add_table("t", spark.range(9))
            raise RuntimeError("lost")
    assert ids(store.current()) == [0, 1, 2] and len(files.names(spark, f"{store.root}/versions")) == 1
    # a driver that dies leaves a folder without manifest: no version, deleted by the next write
    spark.range(7).write.parquet(f"{store.root}/versions/{0:020d}-dead/t")
    assert ids(store.current()) == [0, 1, 2]
    with store.new_version() as v:
        v.add_table("t", spark.range(4))
    assert ids(store.current()) == [0, 1, 2, 3] and not any("dead" in n for n in files.names(spark, f"{store.root}/versions"))


@pytest.mark.parametrize("damage", ["manifest.json", "t", "part", "forest"])
def test_a_damaged_version_raises(spark, tmp_path, damage):
    store = Store(spark, str(tmp_path / "store"))
    with store.new_version() as v:
        v.add_table("t", spark.range(100, numPartitions=2))
        files.write_text(spark, v.add_folder("forest") + "/x", "x")
    path = store.current().path
    if damage == "part":
        part = next(n for n in files.names(spark, f"{path}/t") if n.startswith("part-"))
        files.delete(spark, f"{path}/t/{part}")
    else:
        files.delete(spark, f"{path}/{damage}")
    with pytest.raises(DamagedVersion):
        store.current()


def invoices(spark, n=40):
    rows = [(dt.date(2021 + k // 12, k % 12 + 1, 3), f"V{k}", "s", "i", 10.0 + k % 12, 1.0, 10.0 + k % 12, "u") for k in range(n)]
    return {"pv": spark.createDataFrame(rows, "doc_date date, voucher_no string, supplier string, item string, qty double, "
                                              "price double, amount double, unit string")}


def test_training_publishes_versions(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "models")
    assert pipeline.load_models(spark, path) is None
    pipeline.train(invoices(spark), out_path=path)
    assert pipeline.load_models(spark, path).count() == 1
    monkeypatch.setattr(pipeline.boosting, "train_models", lambda *a: spark.sql("SELECT raise_error('no') AS x"))
    with pytest.raises(Exception, match="no"):
        pipeline.train(invoices(spark), out_path=path)
    assert pipeline.load_models(spark, path).count() == 1


def test_lead_time_model_is_retrained_only_if_there_is_none(spark, tmp_path):
    from provend.operators import aggregates as agg
    from provend.operators import leadtime
    rows = [(dt.date(2023, 1 + i % 12, 1), f"P{i}", f"s{i % 3}", f"i{i % 5}", float(1 + i % 7 * (i % 2)),
             dt.date(2023, 1 + i % 12, 20), f"G{i}", 1.0, (1 + i % 7 * (i % 2)) * 2) for i in range(300)]
    links = spark.createDataFrame(rows, "pov_date date, pov_no string, supplier string, item string, pov_qty double, "
                                        "grn_date date, grn_no string, grn_qty double, lead_time_days int")
    stats, path = agg.lead_time_stats(links), str(tmp_path / "lead")
    summary, model = leadtime.load_or_train(links, stats, path, n_trees=5)
    assert summary.first().kept and model is not None
    assert leadtime.load_or_train(links, stats, path)[0] is None
    version = Store(spark, path).current().path
    files.delete(spark, f"{version}/forest/metadata")
    with pytest.raises(DamagedVersion):
        leadtime.load_or_train(links, stats, path)


def test_lead_times_are_trained_from_documents_by_the_configuration(spark, tmp_path, monkeypatch):
    docs = pipeline.prepare(spark, exports(tmp_path))
    seen = {}
    real = pipeline.leadtime.train_lead_time_model
    monkeypatch.setattr(pipeline.leadtime, "train_lead_time_model", lambda *a, **k: seen.update(k) or real(*a, **k))
    cfg = pipeline.Config(lead_time_trees=3, lead_time_depth=4, lead_time_bins=16, lead_time_min_rows=20)
    summary, _ = pipeline.train_lead_times(docs, str(tmp_path / "lead"), cfg)
    row = summary.first()
    assert row.n_rows >= 60 and row.status in ("kept", "baseline")
    assert (seen["n_trees"], seen["max_depth"], seen["max_bins"], seen["min_rows"]) == (3, 4, 16, 20)


def exports(tmp_path):
    lines = ["m"] * 6 + [HEADER]
    for v in range(60):
        lines.append(f"{1 + v % 28:02d}-{1 + v % 12:02d}-2023,V{v},Sup{v % 4} (up),Item{v % 5},{1 + v % 7},2,{2 * (1 + v % 7)},Pcs")
    lines += ["31-04-2023,B1,Sup0,Item0,abc,2,n/a,Pcs", ",,,Freight,1,x,1,Pcs", ",,,Item9,1,1,1,-", ",,,,2,1,1,Pcs"]
    paths = {}
    for kind in ("pov", "grn", "pv"):
        (tmp_path / kind).mkdir()
        (tmp_path / kind / "export.csv").write_text("\n".join(lines) + "\n")
        paths[f"{kind}_path"] = str(tmp_path / kind)
    return paths


def test_load_metrics(spark, tmp_path):
    cfg = pipeline.Config(null_keys="keep")
    docs = pipeline.prepare(spark, exports(tmp_path), cfg=cfg)
    report = {r.document: r for r in docs["load_report"].collect()}
    pv = report["PV"]
    assert (pv.lines, pv.unparsed_dates, pv.unparsed_numbers, pv.dropped_rows) == (64, 1, 2, 2)  # n/a is no number but a missing cell
    assert (pv.missing_suppliers, pv.missing_items) == (0, 1) and pv.seconds > 0
    assert docs["pv"].count() == 62 and set(report) == {"PV", "POV", "GRN"}


def test_a_stopped_run_goes_on_from_its_finished_tables(spark, tmp_path, monkeypatch):
    paths, folder = exports(tmp_path), str(tmp_path / "run")
    cfg = pipeline.Config(use_models=False)
    reads = []
    real = vs.read_vouchers
    monkeypatch.setattr(vs, "read_vouchers", lambda *a, **k: reads.append(a[2]) or real(*a, **k))

    def start(cfg=cfg, stop=False):
        staging = Staging(spark, folder)
        docs = pipeline.prepare(spark, paths, cfg=cfg, staging=staging)
        with monkeypatch.context() as m:
            if stop:
                m.setattr(pipeline.agg, "lead_time_stats", lambda *a: 1 / 0)
            return staging, docs, pipeline.run(spark, docs, cfg, staging=staging)

    with pytest.raises(ZeroDivisionError):
        start(stop=True)
    assert reads == ["pov", "grn", "pv"]
    staging, docs, results = start()
    assert reads == ["pov", "grn", "pv"] and staging.made == ["classified"]  # neither inputs nor links again
    assert docs["load_report"].where("lines = 64").count() == 3
    want = sorted(map(tuple, results["lead_times"].collect()))
    assert start()[0].made == []
    assert set(start(pipeline.Config(use_models=False, day_window=3))[0].made) == {"links", "classified"}
    os.utime(os.path.join(paths["grn_path"], "export.csv"), (1, 1))
    again, _, results = start()
    assert again.made == ["clean-grn", "links"] and sorted(map(tuple, results["lead_times"].collect())) == want
    again.finish()
    assert not os.path.exists(folder)


def test_scratch_is_deleted(spark):
    base = ensure_checkpoint_dir(spark)
    with scratch_folder(spark) as folder:
        a, b = stage_table(spark.range(5), "x"), materialize(spark.range(6))
        assert a.count() + b.count() == 11 and files.names(spark, folder)
    assert not files.exists(spark, folder) and ensure_checkpoint_dir(spark).startswith(base)
    assert stage_table(spark.range(2), "y").count() == 2


def test_cli_leaves_no_scratch_and_reads_the_store(spark, tmp_path):
    from provend.__main__ import main
    paths, base = exports(tmp_path), ensure_checkpoint_dir(spark)
    common = ["--pov", paths["pov_path"], "--grn", paths["grn_path"], "--pv", paths["pv_path"], "--models", str(tmp_path / "m")]
    stock = tmp_path / "stock.csv"
    stock.write_text("Item Details,Particulars,Period,Closing Qty\nItem0,Sup0 (up),15-01-2023,5000\n")
    before = set(files.names(spark, base))
    assert main(["train", *common]) == 0
    assert main(["run", *common, "--out", str(tmp_path / "out"), "--stock", str(stock), "--resume", str(tmp_path / "run")]) == 0
    assert not [n for n in set(files.names(spark, base)) - before if n.startswith("run-")]
    assert not (tmp_path / "run").exists()
    out = spark.read.parquet(str(tmp_path / "out" / "abc_classification"))
    rows = {(r.item, r.supplier): r for r in out.collect()}
    assert rows["item0", "sup0 (up)"].monthly_reorder_qty == 0.0  # covered by the stock
    assert any(r.monthly_reorder_qty > 0 for r in rows.values())
    assert spark.read.parquet(str(tmp_path / "out" / "load_report")).count() == 3
