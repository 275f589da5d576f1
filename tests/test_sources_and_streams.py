import datetime

import pytest
from pyspark.sql import functions as F

from causeway.operators import evaluate as E
from causeway.operators import joins as J
from causeway.operators import validate as V
from causeway.sources import store
from causeway.sources import transfers as T
from causeway.streaming import replay as R

LINES = [
    "2023/03/04 07:20,077,Q51X0A,077,Q51X0A,412.75,US Dollar,412.75,US Dollar,Reinvestment,0",
    "2023/03/04 07:01,034,7E31,34,7E31,0.25,Euro,0.25,Euro,Cheque,1",
    "2023/03/04 07:01,034,7E31,34,7E31,0.25,Euro,0.25,Euro,Cheque,1",
    "2023/03/05 10:00,,A,3,B,5,Euro,6,US Dollar,ACH,0",
]


def test_raw_log(spark, tmp_path):
    path = tmp_path / "log.csv"
    path.write_text("﻿" + ",".join(store.RAW_HEADER) + "\n" + "\n".join(LINES) + "\n")
    raw = store.read_raw(spark, str(path))
    rows = raw.orderBy("row_id").collect()
    assert [r.row_id for r in rows] == [0, 1, 2, 3]
    assert rows[1].from_bank == "034" and rows[1].to_bank == "34" and rows[1].from_account == "7E31" and rows[3].from_bank == ""
    typed = store.parsed(raw).orderBy("row_id").collect()
    assert typed[0].ts == datetime.datetime(2023, 3, 4, 7, 20) and typed[0].amount_paid == 412.75
    path.write_text("a,b\n1,2\n")
    with pytest.raises(ValueError):
        store.read_raw(spark, str(path))
    bad = tmp_path / "bad.csv"
    bad.write_text(",".join(store.RAW_HEADER) + "\n" + LINES[0].replace("412.75,US", "x,US", 1) + "\n")
    with pytest.raises(Exception):
        store.parsed(store.read_raw(spark, str(bad))).collect()


def test_patterns_and_labels(spark, tmp_path):
    text = "\r\n".join(["﻿BEGIN LAUNDERING ATTEMPT - FAN-OUT:  Max 3-degree Fan-Out", LINES[1], "END LAUNDERING ATTEMPT - FAN-OUT", "", "BEGIN LAUNDERING ATTEMPT - CYCLE", LINES[2], "END LAUNDERING ATTEMPT - CYCLE"])
    lines = spark.createDataFrame([(i, line + "\r") for i, line in enumerate(text.split("\r\n"))], "line_no long, line string")
    p = store.pattern_rows(lines)
    got = p.orderBy("line_no").collect()
    assert [(r.attempt_id, r.typology, r.detail) for r in got] == [(0, "FAN-OUT", "Max 3-degree Fan-Out"), (1, "CYCLE", None)]
    path = tmp_path / "log.csv"
    path.write_text(",".join(store.RAW_HEADER) + "\n" + "\n".join(LINES) + "\n")
    labels = store.attempt_labels(store.read_raw(spark, str(path)), p).orderBy("row_id").collect()
    assert [(r.is_laundering, r.attempt_id, r.typology) for r in labels] == [(0, None, None), (1, 0, "FAN-OUT"), (1, 1, "CYCLE"), (0, None, None)]
    with pytest.raises(Exception, match="outside a block"):
        store.pattern_rows(lines.where("line_no > 0")).collect()


def test_idempotent_sink_and_digest(spark, tmp_path):
    path = str(tmp_path / "out")
    a = spark.range(10).select(F.col("id").alias("row_id"), (F.col("id") * 2).alias("x"))
    store.append_new(a, path)
    store.append_new(a.union(spark.range(10, 12).select("id", F.col("id") * 2)), path)
    assert sorted(r.row_id for r in spark.read.parquet(path).collect()) == list(range(12))
    d = lambda df: tuple(store.digest(df).first())
    assert d(a) == d(a.orderBy(F.desc("row_id")).repartition(3)) != d(a.withColumn("x", F.col("x") + 1))


def test_numbered_and_band_join(spark):
    d = spark.range(500).select((F.col("id") * 7919 % 500).alias("v")).repartition(7)
    assert all(r.v == r.rank for r in J.numbered(d, [F.col("v")]).collect())
    left = spark.createDataFrame([(i, i % 3, i * 2) for i in range(40)], "a long, k long, t long")
    right = spark.createDataFrame([(i, i % 3, i * 3 - 20) for i in range(40)], "b long, q long, u long")
    want = {(x.a, y.b) for x in left.collect() for y in right.collect() if x.k == y.q and -5 <= y.u - x.t <= 4}
    got = [(r.a, r.b) for r in J.band_join(left, right, [("k", "q")], "t", "u", -5, 4).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    semi = {r.a for r in J.band_join(left, right, [("k", "q")], "t", "u", -5, 4, "left_semi").collect()}
    anti = {r.a for r in J.band_join(left, right, [("k", "q")], "t", "u", -5, 4, "left_anti").collect()}
    assert semi == {a for a, _ in want} and semi | anti == set(range(40)) and not semi & anti


def test_metrics_by_hand(spark):
    s = spark.createDataFrame([(0.9, 1), (0.8, 0), (0.8, 1), (0.3, 0)], "score double, y int")
    assert E.pr_auc(s).first()[0] == pytest.approx(0.5 * 1 + 0.5 * 2 / 3)
    assert E.roc_auc(s).first()[0] == pytest.approx(0.875)
    assert tuple(E.best_f1(s).first()) == (0.8, pytest.approx(0.8))
    assert E.threshold_for_rate(s, 0.5).first()[0] == 0.9  # the tie at 0.8 doesn't fit
    assert E.threshold_for_rate(s, 0.0).first()[0] is None
    none = E.prf(s.withColumn("flag", F.lit(False))).first()
    assert none.precision is None and none.recall == 0
    assert E.pr_auc(s.where("y = 0")).first()[0] is None
    r = spark.createDataFrame([("a", 1, 3), ("a", 4, 5), ("a", 9, 9), ("a", 2, 2), ("b", 1, 1)], "grp string, lo long, hi long")
    assert sorted(map(tuple, E.merged_ranges(r).collect())) == [("a", 1, 5), ("a", 9, 9), ("b", 1, 1)]


def test_bootstrap_is_seeded_and_centred(spark):
    c = spark.createDataFrame([("s", i, 2, i % 2, 1) for i in range(300)], "stratum string, cluster long, alerts int, tp int, pos int")
    boot = lambda d: E.bootstrap(d, ["tp", "pos"], 300, 0).withColumn("recall", F.col("tp") / F.col("pos"))
    a = E.interval(boot(c), "recall").first()
    assert a == E.interval(boot(c.repartition(5)), "recall").first()
    assert 0.4 < a.low < 0.5 < a.high < 0.6 and boot(c).count() == 300


def test_fx(spark):
    rows = [("Euro", "US Dollar", 10.0, 11.0), ("Euro", "US Dollar", 20.0, 22.0), ("Yen", "Euro", 1500.0, 10.0), ("US Dollar", "US Dollar", 1.0, 1.0)]
    tx = spark.createDataFrame([(*r, "train") for r in rows], "payment_currency string, receiving_currency string, amount_paid double, amount_received double, split string")
    got = {r.currency: r.rate for r in V.fx_rates(tx, "US Dollar").collect()}
    assert got["US Dollar"] == 1.0 and got["Euro"] == pytest.approx(1 / 1.1) and got["Yen"] == pytest.approx(150 / 1.1)
    with pytest.raises(ValueError):
        V.fx_rates(tx.where("payment_currency = 'Yen'"), "US Dollar")


def test_splits():
    with pytest.raises(ValueError):
        T.check_splits({"a": (1, 3), "b": (3, 4)})
    with pytest.raises(ValueError):
        T.check_splits({"a": (1, 3), "b": (5, 6)})


def test_order_is_checked(spark):
    b = lambda rows: spark.createDataFrame(rows, "rank long, minute long")
    assert R.check_order(b([(0, 1), (1, 1), (2, 5)]), None) == (2, 5)
    for rows, clock in (([(0, 1), (2, 1)], None), ([(0, 5), (1, 4)], None), ([(4, 9)], (2, 5)), ([(3, 5)], (2, 5)), ([(3, 4)], (2, 5))):
        with pytest.raises(R.OrderError):
            R.check_order(b(rows), clock)


def test_codec(spark):
    good = '{"v":1,"rank":0,"row_id":7,"minute":3,"src":1,"dst":2,"amount_usd":1.5,"amount_paid":2.5,"payment_format":"ACH","payment_currency":"Euro","receiving_currency":"Yen","from_bank":"01","to_bank":"1"}'
    m = lambda v: spark.createDataFrame([(v,)], "value string")
    r = R.decode(m(good)).first()
    assert (r.row_id, r.from_bank, r.amount_paid) == (7, "01", 2.5)
    for bad in (good.replace('"v":1', '"v":2'), good.replace('"src":1,', ""), "{"):
        with pytest.raises(Exception):
            R.decode(m(bad)).collect()


def test_late_transfer_stops_the_stream(spark, tmp_path):
    rows = lambda r: spark.createDataFrame(r, "row_id long, rank long, minute long")
    rows([(0, 0, 5), (1, 1, 6)]).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = lambda: R.files_as_stream(spark, str(tmp_path / "in"), rows([(0, 0, 0)]).schema)
    run = lambda: R.score_stream(source(), str(tmp_path / "h"), str(tmp_path / "o"), str(tmp_path / "c"), lambda t: t.select("row_id", "minute"), 10).awaitTermination()
    run()
    assert spark.read.parquet(str(tmp_path / "o")).count() == 2
    rows([(2, 2, 4)]).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    with pytest.raises(Exception, match="OrderError|minute 4"):
        run()
    assert spark.read.parquet(str(tmp_path / "o")).count() == 2


def test_bootstrap_draws_as_many_clusters_and_pairs_models(spark):
    rows = [("a", k, 1, 2 * (k % 2), k % 2) for k in range(40)] + [("b", k, 1, 0, 0) for k in range(7)] + [("a", 0, 0, 5, 5)]
    df = spark.createDataFrame(rows, "stratum string, cluster int, one int, x int, y int")
    got = E.bootstrap(df, ["one", "x", "y"], 200, 3).collect()
    assert len(got) == 200 and {r.one for r in got} == {47.0} and len({r.x for r in got}) > 20
    assert sorted(map(tuple, got)) == sorted(map(tuple, E.bootstrap(df.repartition(3), ["one", "x", "y"], 200, 3).collect()))
    assert abs(sum(r.x for r in got) / 200 - 45) < 3  # 20 clusters of 2 and one that has 5 more


def test_mismatches_are_found(spark):
    a = spark.createDataFrame([(1, 1.0, "x"), (2, 2.0, None), (3, 3.0, "z")], "k int, v double, w string")
    b = spark.createDataFrame([(1, 1.0 + 1e-9, "x"), (2, 2.5, None), (4, 3.0, "z")], "k int, v double, w string")
    assert sorted((r.k, r.side, r.differs) for r in E.mismatches(a, b, "k", ["v", "w"], {"v": 1e-6}).where("side = 'both'").collect()) == [(2, "both", ["v"])]
    p = E.parity(a, b, "k", ["v", "w"]).first()
    assert (p.n, p.only_left, p.only_right, p.v_differs, p.w_differs) == (3, 1, 1, 2, 0)


def test_pattern_errors(spark):
    row = ",".join("abcdefghijk")
    good = ["BEGIN LAUNDERING ATTEMPT - CYCLE: max 3", row, "END LAUNDERING ATTEMPT - CYCLE", "", "BEGIN LAUNDERING ATTEMPT - STACK", row, "END LAUNDERING ATTEMPT - STACK"]
    frame = lambda lines: spark.createDataFrame(list(enumerate(lines)), "line_no long, line string")
    assert store.pattern_rows(frame(good)).count() == 2
    for k, line in ((0, "BEGIN LAUNDERING ATTEMPT - SPIRAL"), (2, "BEGIN LAUNDERING ATTEMPT - CYCLE"), (2, "END LAUNDERING ATTEMPT - STACK"), (1, row + ",l"), (3, row), (6, "")):
        with pytest.raises(ValueError):
            store.pattern_rows(frame([*good[:k], line, *good[k + 1 :]]))


def test_json_lines(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None)], "k long, v string")
    store.write_json(df, str(tmp_path / "j"))
    assert sorted(map(tuple, store.read_json(spark, str(tmp_path / "j"), df.schema).collect())) == [(1, "a"), (2, None)]
    with pytest.raises(Exception, match="no rate"):
        V.with_usd(spark.createDataFrame([(1.0, "Euro")], "amount_paid double, payment_currency string"), spark.createDataFrame([], "currency string, rate double")).collect()
