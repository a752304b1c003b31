"""Readers, writers and the stream, round trip."""

import gzip
import json

import pytest
from pyspark.sql import functions as F

from millrace.operators import enrichment as E
from millrace.sources import readers as R
from millrace.sources import runs as U
from millrace.sources import writers as W
from millrace.streaming import series as Q


def test_json_archive(spark, tmp_path):
    rows = [{"metadata": {"date": "2016-01-01", "tags": ["a", "b"], "title": "t"}, "text": "x\ny"}, {"metadata": {"date": None}, "text": None}]
    with gzip.open(tmp_path / "a.jsonl.gz", "wt") as f:
        f.writelines(json.dumps(r) + "\n" for r in rows)
    raw = R.json_lines(spark, str(tmp_path / "a.jsonl.gz"), R.RAW_ARCHIVE, partitions=2)
    flat = R.flatten_metadata(raw).orderBy(F.col("date").asc_nulls_last()).collect()
    assert flat[0].tags == "a|b" and flat[0].text == "x\ny" and flat[1].date is None
    assert R.head(raw, 1).count() == 1
    plain = spark.createDataFrame([(("x", [1, 2]), "t")], "metadata struct<tags: string, ids: array<int>>, text string")
    assert [tuple(r) for r in R.flatten_metadata(plain).collect()] == [("x", "1|2", "t")]


def test_csv(spark, tmp_path):
    df = spark.createDataFrame([("a", 'he said "x",\nthen', [1, 2]), ("b", None, None)], "k string, t string, l array<int>")
    W.csv(df, str(tmp_path / "c"))
    back = R.csv(spark, str(tmp_path / "c"), "k string, t string, l string").orderBy("k").collect()
    assert (back[0].t, back[0].l, back[1].t) == ('he said "x",\nthen', "[1,2]", None)
    (tmp_path / "e.csv").write_text("# events\nstart,event\n2016-01-01,x\n# no\n2016-01-02,y\n")
    assert R.csv(spark, str(tmp_path / "e.csv"), "start date, event string", ["event"], comment="#").count() == 2


def test_parquet(spark, tmp_path):
    df = E.shard_ids(spark.range(23).withColumnRenamed("id", "article_id"), ["article_id"], size=10)
    W.parquet(df, str(tmp_path / "p"), sort_by="article_id", partition_by="shard_id")
    back = R.parquet_shards(spark, str(tmp_path / "p"), ["article_id", "shard_id"])
    assert {r.shard_id: r["count"] for r in back.groupBy("shard_id").count().collect()} == {0: 10, 1: 10, 2: 3}
    assert json.loads(W.summary(df.agg(F.count("*").alias("n")))) == {"n": 23}
    assert E.todo(df, df.where("article_id < 20")).count() == 3


def test_journals(spark, tmp_path):
    (tmp_path / "j.jsonl").write_text('{"k": "a", "v": 1}\n{"k": "b", "v": 2}\n{"k": "c", "v"\n{"k": "a", "v": 9}\n')
    whole = R.journal(spark, str(tmp_path / "j.jsonl"), "k string, v int")
    assert sorted(tuple(r) for r in whole.collect()) == [("a", 1), ("b", 2)]
    last = R.cache(spark, str(tmp_path / "j.jsonl"), "k string, v int", "k")
    assert sorted(tuple(r) for r in last.collect()) == [("a", 9), ("b", 2)]
    out = str(tmp_path / "out")
    for _ in range(2):
        W.journal(whole, out)
    assert R.json_lines(spark, out, "k string, v int").count() == 4


def test_columns_and_union(spark):
    a, b = spark.createDataFrame([("1", None)], "x string, y string"), spark.createDataFrame([("2",)], "x string")
    assert [tuple(r) for r in R.with_columns(a, ["x", "y", "z"]).collect()] == [("1", "", "")]
    assert R.merged(a, b).count() == 2
    twice = R.in_batches(spark.range(5), lambda p: p.assign(id=p.id * 2), "id long")
    assert sorted(r.id for r in twice.collect()) == [0, 2, 4, 6, 8]


def test_stream(spark, tmp_path):
    schema = "ts timestamp, label string"
    rows = [("2024-01-01 10:00:00", "a"), ("2024-01-01 11:00:00", "a"), ("2024-01-02 01:00:00", "b"), ("2024-01-09 01:00:00", "c")]
    frame = spark.createDataFrame(rows, "ts string, label string").select(F.to_timestamp("ts").alias("ts"), "label")
    frame.write.mode("append").parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    Q.run_available(Q.daily_counts(stream()), str(tmp_path / "out"), str(tmp_path / "cp"))
    got = sorted((str(r.day), r.label, r.articles) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [("2024-01-01", "a", 2), ("2024-01-02", "b", 1)]
    late = frame.limit(1)
    late.write.mode("append").parquet(str(tmp_path / "in"))
    Q.run_available(Q.daily_counts(stream()), str(tmp_path / "out"), str(tmp_path / "cp"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


@pytest.mark.parametrize("size", [0, 3])
def test_numbering_is_total(spark, size):
    assert E.shard_ids(spark.range(size), ["id"]).count() == size


def test_journal_read_in_splits(spark, tmp_path):
    """Several splits of one file and several files: lines up to each file's first torn one, the last of a key."""
    for name, torn in (("a", 3000), ("b", None)):
        lines = [json.dumps({"k": f"{name}{i % 500}", "v": i}) for i in range(4000)]
        if torn is not None:
            lines[torn] = lines[torn][:5]
        (tmp_path / f"{name}.jsonl").write_text("\n".join(lines) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20k")
    spark.conf.set("spark.sql.files.openCostInBytes", "1k")
    try:
        path = str(tmp_path)
        assert spark.read.text(path).rdd.getNumPartitions() > 4
        got = sorted(tuple(r) for r in R.journal(spark, path, "k string, v int").collect())
        assert got == sorted([(f"a{i % 500}", i) for i in range(3000)] + [(f"b{i % 500}", i) for i in range(4000)])
        last = {r.k: r.v for r in R.cache(spark, path, "k string, v int", "k").collect()}
        assert last["a0"] == 3500 and last["a499"] == 3999 and last["b7"] == 3507 and len(last) == 1000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_prompts_and_keys():
    assert U.template('{"a": 1} {topics}; {event_types}', topics=("x", "y"), event_types=("z",)) == '{"a": 1} x, y; z'
    with pytest.raises(ValueError, match="topics"):
        U.template("none", topics=("x",))
    assert U.canonical_json({"b": [1, {"d": None, "c": "ё"}], "a": 1.5}) == '{"a":1.5,"b":[1,{"c":"ё","d":null}]}'
    assert U.request_key("m", {"a": 1, "b": 2}) == U.request_key("m", {"b": 2, "a": 1}) != U.request_key("m", {"a": 1, "b": 3})


def test_run_parameters_are_kept(spark, tmp_path):
    path = str(tmp_path / "meta")
    U.guard(spark, path, {"version": "1", "shard": 5000, "ids": (1, 2)})
    U.guard(spark, path, {"version": "1", "shard": 5000, "ids": (1, 2)})
    with pytest.raises(ValueError, match="shard, version"):
        U.guard(spark, path, {"version": "2", "shard": 10, "ids": (1, 2)})
    U.guard(spark, path, {"version": "2"}, force=True)
    U.guard(spark, path, {"version": "2"})


def test_calls_are_tried_again_and_ordered():
    tried = []

    def flaky(inputs):
        tried.append(len(inputs))
        if len(tried) < 3:
            raise U.ServerError(429 if len(tried) == 1 else None)
        return [{"index": i, "v": x.upper()} for i, x in reversed(list(enumerate(inputs)))]

    assert [a["v"] for a in U.called(flaky, ["a", "b", "c"], wait=0)] == ["A", "B", "C"] and tried == [3, 3, 3]
    tried.clear()

    def refused(inputs):
        tried.append(1)
        raise U.ServerError(400)

    with pytest.raises(U.ServerError):
        U.called(refused, ["a"], wait=0)
    assert len(tried) == 1
    with pytest.raises(U.ServerError, match="indexes"):
        U.called(lambda inputs: [{"index": 0}], ["a", "b"], tries=2, wait=0)


def test_served_rows(spark):
    def call(inputs):
        if "bad" in inputs:
            raise U.ServerError(500, "down")
        return [{"index": i, "size": len(x)} for i, x in enumerate(inputs)]

    df = spark.createDataFrame([(i, "bad" if i == 5 else "x" * i) for i in range(10)], "id long, input string").coalesce(1)
    rows = {r.id: r for r in U.served(df, call, "size long", batch=4, tries=2, wait=0).collect()}
    assert [rows[i].size for i in range(10)] == [0, 1, 2, 3, None, None, None, None, 8, 9]
    assert {i for i in rows if rows[i].error} == {4, 5, 6, 7} and rows[4].error == "down"
    assert U.served(df.limit(0), call, "size long").count() == 0
    todo = U.unanswered(df.withColumn("key", F.col("id").cast("string")), spark.createDataFrame([("1",), ("1",), ("x",)], "key string"))
    assert todo.count() == 9


def test_no_local_folder_on_a_cluster(monkeypatch):
    from millrace import session

    class Unset:
        def isEmpty(self):
            return True

    class Context:
        master = "spark://somewhere:7077"

        class _jsc:
            @staticmethod
            def sc():
                return type("S", (), {"getCheckpointDir": lambda self: Unset()})()

    fake = type("Session", (), {"sparkContext": Context(), "conf": type("C", (), {"get": staticmethod(lambda k, d=None: d)})()})()
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.ensure_checkpoint_dir(fake)


def test_settle_keeps_clashing_names(spark):
    from millrace.session import settle

    df = spark.range(3).select(F.col("id").alias("a"), F.col("id").alias("A"), F.array("id").alias("a"))
    back = settle(df)
    assert back.columns == ["a", "A", "a"] and sorted(tuple(r) for r in back.collect()) == [(i, i, [i]) for i in range(3)]
    assert settle(df.limit(0)).count() == 0


def test_settled_tables_can_be_released(spark):
    import os

    from millrace import session

    session.settle(spark.range(3))
    path = session._SETTLED[-1].removeprefix("file:")
    assert os.path.isdir(path)
    kept, session._SETTLED[:] = session._SETTLED[:-1], session._SETTLED[-1:]
    assert session.release(spark) == 1 and not os.path.exists(path)
    session._SETTLED[:] = kept
