"""Runs that commit as they go, and topics that do not depend on the order of arrival."""

import json
import sys

import pandas as pd
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from themescope.plans import model_runs, phrase_state
from themescope.plans.full_run import RunOptions, extract_topics
from themescope.streaming.incremental import run_chunks, write_chunks

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def recorder(log, dies_at=None):
    """A model that notes each call in a file and dies when it meets a certain complaint."""
    def hook(batches):
        for batch in batches:
            out = []
            for row in batch.itertuples():
                if dies_at is not None and row.complaint_id == dies_at:
                    raise RuntimeError("the service is gone")
                with open(f"{log}/{row.complaint_id}", "a") as f:
                    f.write("x")
                good = row.complaint_id % 10 != 3
                raw = json.dumps({"topics": [f"t{row.complaint_id}"]}) if good else "[]"
                out.append((row.dataset_id, row.complaint_id, "m", 0, 0, 200 if good else 404,
                            None if good else "NotFoundError", raw, 7, 2))
            yield pd.DataFrame(out, columns=[
                "dataset_id", "complaint_id", "model", "model_rank", "attempt", "status", "error_type", "raw",
                "prompt_tokens", "completion_tokens"])
    return hook


@pytest.fixture()
def rows(spark):
    return spark.range(430).select(
        F.col("id").alias("complaint_id"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("narrative"))


def calls(log):
    return {int(p.name): len(p.read_text()) for p in log.iterdir()}


def test_a_dying_hook_costs_one_chunk(spark, rows, tmp_path):
    log = tmp_path / "log"
    log.mkdir()
    base = str(tmp_path / "run")
    with pytest.raises(Exception, match="the service is gone"):
        extract_topics(rows, RunOptions(base, extract_hook=recorder(str(log), dies_at=257)))
    died = calls(log)
    assert len(model_runs.unfinished(spark, base)) == 1
    topics, ledger = extract_topics(rows, RunOptions(base, extract_hook=recorder(str(log))))
    asked = calls(log)
    assert set(asked) == set(range(430))
    again = [i for i, n in asked.items() if n > 1]
    assert len(again) <= 100 and max(asked.values()) == 2 and set(again) <= set(died)
    assert {r.complaint_id for r in topics.collect()} == {i for i in range(430) if i % 10 != 3}
    assert (ledger["rows_in"], ledger["rows_out"], ledger["newly_processed"], ledger["failed"]) == (430, 387, 387, 43)
    assert (ledger["prompt_tokens"], ledger["completion_tokens"]) == (387 * 7, 387 * 2)  # failed answers are not billed
    assert ledger["failure_samples"] == ["m - NotFoundError"] * 3 and ledger["model_usage"] == {"m": 387}
    assert model_runs.unfinished(spark, base) == []

    # Failed rows are asked for again by the next call, the others are not.
    _, third = extract_topics(rows, RunOptions(base, extract_hook=recorder(str(log))))
    assert (third["resumed_from"], third["newly_processed"], third["failed"]) == (387, 0, 43)
    assert all(calls(log)[i] == asked[i] + (i % 10 == 3) for i in asked)

    _, fresh = extract_topics(rows, RunOptions(base, extract_hook=recorder(str(log)), resume=False, commit_chunks=5))
    assert (fresh["resumed_from"], fresh["newly_processed"], fresh["rows_out"]) == (0, 387, 387)


def test_finishing_twice_adds_nothing(spark, rows, tmp_path):
    """A process that died after its rows were appended, before the run was noted as ended."""
    log = tmp_path / "log"
    log.mkdir()
    base, hook = str(tmp_path / "run"), recorder(str(log))
    todo = rows.withColumn("dataset_id", F.lit("d"))
    run = model_runs.start_run(todo, base, 100)
    for _ in range(2):
        model_runs.finish_run(spark, base, run, hook, f"{base}/topics")
    assert spark.read.parquet(f"{base}/topics").count() == 387
    assert max(calls(log).values()) == 1
    assert model_runs.start_run(todo.limit(0), base, 100) is None


def test_chunks_are_replaced_not_repeated(spark, rows, tmp_path):
    """The checkpoint is lost: batches are written again to the same folders."""
    work, sink = str(tmp_path / "work"), str(tmp_path / "sink")
    write_chunks(rows.repartition(3), ["complaint_id"], work, 50)
    for progress in ("a", "b"):
        read = run_chunks(spark, work, rows.schema, lambda b: b.select("complaint_id"), sink, str(tmp_path / progress), 2)
        assert read == 430
    stored = spark.read.parquet(sink)
    assert stored.count() == stored.distinct().count() == 430
    assert stored.groupBy("batch").count().agg(F.max("count")).first()[0] <= 100


TEXTS = [
    "late fees late fees charged again", "late fees again today", "other late fees today again", "", "ab cd",
    "nothing here nothing here nothing there", "charged again today charged again", "other late charges today again",
    None, "nothing here today", "late fees charged today late fees", "there nothing here",
]


def lists(df):
    return {r.complaint_id: r.all_topics_discussed for r in df.collect()}


@pytest.mark.parametrize("cuts", [(6, 12), (1, 2, 7, 12), (12, 12), (4, 5, 12)])
def test_parts_end_like_the_whole(spark, tmp_path, cuts):
    rows = spark.createDataFrame(list(enumerate(TEXTS)), "complaint_id long, narrative string").withColumn(
        "dataset_id", F.lit("d"))
    whole, _ = phrase_state.extract_default(rows, str(tmp_path / "whole"), "d")
    done = []
    for cut in cuts:
        part, ledger = phrase_state.extract_default(rows.filter(F.col("complaint_id") < cut), str(tmp_path / "parts"), "d")
        done.append(ledger)
    assert lists(part) == lists(whole) and part.columns == whole.columns
    assert sum(d["new"] for d in done) == len(TEXTS)
    other, _ = phrase_state.extract_default(rows.limit(3), str(tmp_path / "parts"), "e")
    assert other.count() == 3  # another data set has counts of its own


def test_a_cut_off_revision_is_written_again(spark, tmp_path):
    rows = spark.createDataFrame(list(enumerate(TEXTS)), "complaint_id long, narrative string").withColumn(
        "dataset_id", F.lit("d"))
    whole, _ = phrase_state.extract_default(rows, str(tmp_path / "whole"), "d")
    base = str(tmp_path / "parts")
    phrase_state.extract_default(rows.limit(5), base, "d")
    state = phrase_state.PhraseState(spark, base, "d")
    state.put(rows.select("complaint_id"), "seen", 2)  # what a process left that died before noting revision 2
    state.put(spark.createDataFrame([(1, "late fees", 9)], "complaint_id long, phrase string, _tf long"), "counts", 2)
    part, ledger = phrase_state.extract_default(rows, base, "d")
    assert lists(part) == lists(whole) and ledger["new"] == 7
    again, _ = phrase_state.extract_default(rows, base, "d", resume=False)
    assert lists(again) == lists(whole)


def test_only_touched_texts_are_ranked_again(spark, tmp_path):
    texts = ["alpha bravo charlie", "delta echo foxtrot", "golf hotel india golf hotel", "alpha bravo kilo"]
    rows = spark.createDataFrame(list(enumerate(texts)), "complaint_id long, narrative string").withColumn(
        "dataset_id", F.lit("d"))
    phrase_state.extract_default(rows.filter("complaint_id < 3"), str(tmp_path), "d")
    state = phrase_state.PhraseState(spark, str(tmp_path), "d")
    before = state.table("counts", 1)
    told = spark.createDataFrame([(3, "alpha bravo", 1), (3, "bravo kilo", 1)], "complaint_id long, phrase string, _tf long")
    frequencies = spark.createDataFrame([("alpha bravo", 2)], "phrase string, documents long")
    assert {r[0] for r in state._touched(before, told, frequencies).collect()} == {0, 2}


def test_nothing_to_do(spark, tmp_path):
    none = spark.createDataFrame([], "complaint_id long, narrative string, dataset_id string")
    topics, done = phrase_state.extract_default(none, str(tmp_path), "d")
    assert topics.collect() == [] and done["new"] == 0 and "all_topics_discussed" in topics.columns


def test_what_ended_stays_when_the_job_fails(spark, tmp_path):
    """All batches are tasks of one job, each of which commits for itself."""
    work, sink, progress = (str(tmp_path / name) for name in ("work", "sink", "progress"))
    rows = spark.range(430)
    write_chunks(rows.repartition(3), ["id"], work, 25)
    jobs = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("dies", "a run that dies late")

    def dies(batches):
        for batch in batches:
            if (batch["id"] >= 300).any():
                raise RuntimeError("the service is gone")
            yield batch

    try:
        with pytest.raises(Exception, match="the service is gone"):
            run_chunks(spark, work, rows.schema, lambda b: b.mapInPandas(dies, "id long"), sink, progress)
        assert len(jobs.getJobIdsForGroup("dies")) < 15  # the 12 batches before the failure were one job, not 12 or more
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    held = {r.id for r in spark.read.parquet(sink).collect()}
    assert set(range(300 - 25)) <= held and max(held) < 325
    assert run_chunks(spark, work, rows.schema, lambda b: b, sink, progress, 4) == 430 - len(held)
    stored = spark.read.parquet(sink)
    assert sorted(r.id for r in stored.collect()) == list(range(430))
    assert run_chunks(spark, work, rows.schema, lambda b: b, sink, progress, 4) == 0


def test_a_call_ranks_its_phrases_once(spark, tmp_path, monkeypatch):
    rows = spark.createDataFrame(list(enumerate(TEXTS)), "complaint_id long, narrative string").withColumn(
        "dataset_id", F.lit("d"))
    ranked = spark.sparkContext.accumulator(0)
    count = F.udf(lambda key: ranked.add(1) or key, "long").asNondeterministic()
    rank = phrase_state.ex.rank_phrases

    def counted(told, *rest):
        return rank(told.withColumn("complaint_id", count("complaint_id")), *rest)

    monkeypatch.setattr(phrase_state.ex, "rank_phrases", counted)
    base = str(tmp_path / "parts")
    phrase_state.extract_default(rows.filter("complaint_id < 6"), base, "d")
    before = ranked.value
    phrase_state.extract_default(rows, base, "d")
    held = phrase_state.PhraseState(spark, base, "d").table("counts", 2).count()
    assert before > 0 and ranked.value - before <= held


def test_long_tasks_store_their_slices(spark, tmp_path):
    """A process that is killed costs a batch at most, though tasks are few and Spark commits none of those cut off."""
    log, base = tmp_path / "log", str(tmp_path / "run")
    log.mkdir()
    rows = spark.range(2000).select(
        F.col("id").alias("complaint_id"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("narrative"))

    def killed(batches):
        import os
        import time

        for batch in batches:
            for answers in recorder(str(log))(iter([batch])):
                if (batch["complaint_id"] == 30).any():
                    time.sleep(1)
                    os._exit(9)
                yield answers

    with pytest.raises(Exception):
        extract_topics(rows, RunOptions(base, extract_hook=killed, commit_rows=100))
    died = calls(log)
    topics, ledger = extract_topics(rows, RunOptions(base, extract_hook=recorder(str(log)), commit_rows=100))
    asked = calls(log)
    again = [i for i, n in asked.items() if n > 1]
    assert set(asked) == set(range(2000)) and len(died) > 100
    assert len(again) <= 100 and max(asked.values()) == 2 and set(again) <= set(died)
    assert (ledger["rows_out"], ledger["newly_processed"]) == (1800, 1800)
    attempts = next((tmp_path / "run" / "run").glob("*/attempts"))
    assert spark.read.parquet(str(attempts)).groupBy("complaint_id").count().agg(F.max("count")).first()[0] == 1
    assert len(list(attempts.glob("*.parquet"))) <= 2 * 8 * 4 + 10  # not one for each slice of 11 rows
    assert not list(attempts.parent.glob("slices/*/"))


def test_a_cut_off_slice_file_is_read_to_its_end(tmp_path):
    import pyarrow as pa

    from themescope.streaming import slices

    path = tmp_path / "file"
    batch = pa.RecordBatch.from_pydict({"a": list(range(1000))})
    with open(path, "wb") as file, pa.ipc.new_stream(file, batch.schema) as stream:
        for _ in range(3):
            stream.write_batch(batch)
    whole = path.read_bytes()
    for size, found in ((len(whole), 3), (len(whole) - 4000, 2), (10, 0), (0, 0)):
        path.write_bytes(whole[:size])
        assert len(list(slices._stored(str(path)))) == found


def test_a_call_counts_and_ranks_in_one_exchange(spark, tmp_path, monkeypatch, plan):
    rows = spark.createDataFrame(list(enumerate(TEXTS)), "complaint_id long, narrative string").withColumn(
        "dataset_id", F.lit("d"))
    plans, rank = [], phrase_state.ex.rank_phrases

    def seen(*args):
        ranked = rank(*args)
        plans.append(plan(ranked))
        return ranked

    monkeypatch.setattr(phrase_state.ex, "rank_phrases", seen)
    base = str(tmp_path / "parts")
    phrase_state.extract_default(rows.filter("complaint_id < 6"), base, "d")
    phrase_state.extract_default(rows, base, "d")
    assert len(plans) == 2
    for text in plans:
        assert text.count("Arguments: hashpartitioning(phrase") == 1
    assert not list((tmp_path / "parts" / "phrases").glob("*/frequencies"))


def test_a_few_new_texts_end_like_the_whole(spark, tmp_path):
    texts = [f"{a} {b} common words here {b} {a}" for a in ("late", "charged", "other", "today", "again", "fees")
             for b in ("nothing", "there", "never", "billing", "letter", "credit", "phone")]
    rows = spark.createDataFrame(list(enumerate([*texts, "late nothing common words"])),
                                 "complaint_id long, narrative string").withColumn("dataset_id", F.lit("d"))
    whole, _ = phrase_state.extract_default(rows, str(tmp_path / "whole"), "d")
    phrase_state.extract_default(rows.filter(F.col("complaint_id") < len(texts)), str(tmp_path / "parts"), "d")
    part, ledger = phrase_state.extract_default(rows, str(tmp_path / "parts"), "d")
    assert ledger["new"] == 1 and len(texts) > phrase_state._FEW and lists(part) == lists(whole)
