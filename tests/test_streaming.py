import json

import pytest
from pyspark.sql import functions as F

from checks import queries
from tariffscope import session
from tariffscope.plans.batch import store_answers
from tariffscope.sources import store
from tariffscope.sources.store import read_table as read_stored
from tariffscope.streaming import intake
from tariffscope.streaming.intake import start_document_intake, start_intake
from tests.test_ingest import GOOD


def drop(folder, name, *records):
    folder.mkdir(exist_ok=True)
    lines = [json.dumps({"record_id": i, "source_file": f"{i}.pdf", "payload": json.dumps(r)}) for i, r in records]
    (folder / name).write_text("\n".join(lines))


def take_in(spark, root):
    start_intake(spark, f"{root}/in", f"{root}/store", f"{root}/checkpoint", files_per_batch=1).awaitTermination()


def count(spark, root, table):
    return read_stored(spark, f"{root}/store", table).count()


def test_each_file_is_stored_once_and_ids_hold_across_batches(spark, tmp_path):
    drop(tmp_path / "in", "1.json", ("a", GOOD), ("b", {**GOOD, "total_amount_due": 0}))
    take_in(spark, tmp_path)
    assert (count(spark, tmp_path, "bills"), count(spark, tmp_path, "quarantine")) == (1, 1)
    take_in(spark, tmp_path)  # nothing new
    assert count(spark, tmp_path, "bills") == 1
    drop(tmp_path / "in", "2.json", ("c", GOOD), ("d", {**GOOD, "account_number": "55555555"}))
    take_in(spark, tmp_path)
    assert count(spark, tmp_path, "bills") == 3 and count(spark, tmp_path, "vendors") == 1
    accounts = read_stored(spark, f"{tmp_path}/store", "accounts")
    bills = read_stored(spark, f"{tmp_path}/store", "bills")
    assert accounts.count() == 2 and bills.join(accounts, "account_id").count() == 3
    items = read_stored(spark, f"{tmp_path}/store", "line_items")
    assert items.count() == 9 and items.join(bills, "bill_id").count() == 9


def test_repeated_batch_replaces_itself(spark, tmp_path):
    drop(tmp_path / "in", "1.json", ("a", GOOD))
    take_in(spark, tmp_path)
    before = sorted(read_stored(spark, f"{tmp_path}/store", "bills").drop("audit_timestamp").collect())
    answers = spark.read.schema("record_id string, source_file string, payload string").json(f"{tmp_path}/in")
    store_answers(answers, 0, f"{tmp_path}/store")
    after = sorted(read_stored(spark, f"{tmp_path}/store", "bills").drop("audit_timestamp").collect())
    assert before == after and count(spark, tmp_path, "accounts") == 1


def test_a_record_in_two_files_is_stored_once(spark, tmp_path, monkeypatch):
    """Over many batches, so that what is known has been folded twice; a rejected record may come again."""
    monkeypatch.setattr(store, "FOLD_EVERY", 2)
    bad = {**GOOD, "total_amount_due": 0}
    for number, records in enumerate([[("a", GOOD), ("b", bad)], [("c", GOOD)], [("a", GOOD), ("a", {**GOOD, "rate_code": "X"})], [("b", GOOD)], [("c", GOOD), ("d", GOOD), ("d", GOOD)]]):
        drop(tmp_path / "in", f"{number}.json", *records)
        take_in(spark, tmp_path)
    bills = read_stored(spark, f"{tmp_path}/store", "bills")
    assert bills.count() == 4 == bills.select("bill_id").distinct().count() and count(spark, tmp_path, "accounts") == 1
    log = spark.read.parquet(f"{tmp_path}/store/processed").groupBy("status").count().collect()
    assert {r["status"]: r["count"] for r in log} == {"accepted": 4, "rejected": 1, "repeated": 3}
    known = store.known_rows(spark, f"{tmp_path}/store", "taken", 5)
    assert sorted(r[0] for r in known.collect()) == ["a", "b", "c", "d"]
    folders = {f.split("/store/")[1].rsplit("/", 1)[0] for f in known.inputFiles()}
    assert folders <= {"folded/taken/upto=4", "taken/batch_id=4"}


SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@pytest.mark.parametrize("name", ["stream_ingest", "stream_repeats"])
def test_a_stream_keeps_neither_its_source_nor_its_shuffles(spark, sample, tmp_path, monkeypatch, name):
    """Disk held what was staged, a plain-text inbox and every shuffle to the end of the query."""
    monkeypatch.setattr(queries, "staging_root", lambda _: str(tmp_path))
    session.drop_staged(spark)
    seen, stored = [], store.write_batch
    monkeypatch.setattr("tariffscope.plans.batch.write_batch", lambda rows, *a: seen.append(rows.sparkSession.conf.get(SHUFFLES_GO)) or stored(rows, *a))
    assert queries.QUERIES[name].run(spark, sample).count() in (4, 5)
    assert not session._STAGED and set(seen) == {"true"} and spark.conf.get(SHUFFLES_GO) == "false"
    inbox = [f.name for f in tmp_path.glob("stream-*/inbox/**/part-*")]
    assert inbox and all(n.endswith(".json.gz") for n in inbox)


def test_only_the_tables_read_are_dropped(spark):
    kept, gone = session.staged(spark.range(3), "kept"), session.staged(spark.range(5), "gone")
    session.drop_read(gone.filter("id > 1"))
    assert kept.count() == 3 and not any("/gone-" in p for p in session._STAGED)
    session.drop_read(kept)


def test_a_run_of_many_batches_is_one_run(spark, sample, monkeypatch):
    """Runs were told by the batch's number, so that more than a batch of files came out as further runs."""
    whole = {(r["paper"], r["run"]) for r in queries.QUERIES["file_intake"].run(spark, sample).collect()}

    def small(*given, **named):
        return start_document_intake(*given, **{**named, "files_per_batch": 9})

    monkeypatch.setattr(queries, "start_document_intake", small)
    found = {(r["paper"], r["run"]) for r in queries.QUERIES["file_intake"].run(spark, sample).collect()}
    assert int(spark.conf.get(intake.LISTING)) == 4 * spark.sparkContext.defaultParallelism
    assert found == whole and {run for _, run in found} == {0, 1} and all(int(paper) % 2 == run for paper, run in found)


def test_small_files_are_read_by_few_tasks(spark, tmp_path, monkeypatch):
    """Each file counts four megabytes for Spark, so a batch of many was a task for every few files."""
    monkeypatch.setattr(intake, "TASKS_PER_CORE", 1)
    for k in range(40):
        (tmp_path / f"{k}.txt").write_text(f"text {k}")
    conf = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4m")
    try:
        files = spark.read.text(str(tmp_path), wholetext=True).select(F.col("value"))
        assert files.rdd.getNumPartitions() == 40
        fewer = intake.in_fewer_tasks(files)
        assert fewer.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
        assert sorted(r[0] for r in fewer.collect()) == sorted(f"text {k}" for k in range(40))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", conf)
