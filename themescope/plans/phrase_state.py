"""Default topics that do not depend on how the rows arrived.

Which phrases of a text are its topics depends on how many texts hold each phrase.  So the phrase counts of
every text are kept.  A call with new rows makes the next revision: where they are many, all texts are counted and
ranked in one exchange by phrase; where they are few, of the texts stored before only those are ranked again whose
order of phrases can have changed.  A revision counts once it is noted; one that was cut off is simply written again.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession, functions as F

from themescope import fixed_values as fv
from themescope.operators import extraction as ex, joins
from themescope.session import cut_lineage
from themescope.sources.readers import read_table, try_read
from themescope.sources.writers import append_run

KEY = "complaint_id"
REVISIONS = "revision int, rows long, ranked long"
#: Scores are compared to six digits.  Up to this frequency two different ones are further apart than that.
_APART = 100_000
#: With one new text to so many stored ones, or more, nearly all stored texts share a phrase with the new ones.
_FEW = 20


class PhraseState:
    """The stored counts of one data set."""

    def __init__(self, spark: SparkSession, folder: str, dataset_id: str):
        self.spark = spark
        self.base = f"{folder}/phrases/{hashlib.sha1(dataset_id.encode()).hexdigest()[:16]}"

    def start_fresh(self) -> None:
        if try_read(self.spark, f"{self.base}/revisions") is not None:
            self.spark.createDataFrame([], REVISIONS).write.mode("overwrite").parquet(f"{self.base}/revisions")

    def last(self) -> tuple[int, int]:
        """The last revision noted, and how many texts it counts; (0, 0) before the first."""
        noted = try_read(self.spark, f"{self.base}/revisions")
        row = None if noted is None else noted.agg(F.max_by(F.struct("revision", "rows"), "revision").alias("r")).first()
        return (row.r.revision, row.r.rows) if row and row.r else (0, 0)

    def table(self, name: str, upto: int) -> DataFrame | None:
        """Rows of a stored table up to a revision."""
        if not upto:
            return None
        return read_table(self.spark, f"{self.base}/{name}").filter(F.col("revision") <= upto)

    def put(self, df: DataFrame, name: str, revision: int) -> DataFrame:
        """The part of a table that belongs to a revision; written again it replaces itself."""
        path = f"{self.base}/{name}/revision={revision}"
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        return read_table(self.spark, path, df.schema)

    def seen(self) -> DataFrame | None:
        return self.table("seen", self.last()[0])

    def current(self) -> DataFrame | None:
        """The latest topics of every text that has any: its row of the highest revision."""
        last = self.last()[0]
        held = self.table("topics", last)
        if held is None:
            return None
        if last == 1:  # nothing is stored twice
            return held.drop("revision")
        newest = F.max("revision").over(ex.W.partitionBy(KEY))
        return held.withColumn("_newest", newest).filter("revision = _newest").drop("_newest", "revision")

    def advance(self, todo: DataFrame, text: str = "narrative") -> dict[str, int]:
        """Count and rank the new rows, rank again what they change, and note the revision.

        ``todo`` holds rows not seen before; its other columns are kept with the topics.
        """
        last, rows_before = self.last()
        number = last + 1
        new_rows = self.put(todo.select(KEY), "seen", number)
        new = new_rows.count()  # the files' footers know it
        if not new:
            return {"new": 0, "ranked_again": 0}
        told = self.put(ex.row_phrases(todo, KEY, text), "counts", number)
        before, frequencies = self.table("counts", last), None
        if before is not None:
            before = before.drop("revision")
            every = told.unionByName(before)
            if _FEW * new < rows_before:
                counted = cut_lineage(ex.rarity(every))
                again = cut_lineage(self._touched(before, told, counted))
                if 2 * again.count() < rows_before:
                    frequencies, every = counted, told.unionByName(before.join(again, KEY, "left_semi"))
            # If most texts are touched it costs less to rank all of them: the lists of the others come out the same.
            told = every
        # Both new and changed topics are made from the lists, so they are ranked once and stored.
        lists = cut_lineage(ex.topic_lists(ex.rank_phrases(told, frequencies, rows_before + new, KEY), KEY))
        topics = ex.default_answers(todo, KEY, text).join(lists, KEY)
        if before is not None:
            # Only lists that are different now are written again, with the columns of their row.
            held = self.current()
            changed = held.join(lists.withColumnRenamed("all_topics_discussed", "_now"), KEY).filter(
                F.col("all_topics_discussed") != F.col("_now"))
            topics = topics.unionByName(changed.withColumn("all_topics_discussed", F.col("_now")).select(*topics.columns))
        written = self.put(topics, "topics", number).select(KEY)
        changed_rows = 0 if before is None else written.join(new_rows, KEY, "left_anti").count()
        append_run(self.spark.createDataFrame([(number, rows_before + new, changed_rows)], REVISIONS).coalesce(1),
                   f"{self.base}/revisions")
        return {"new": new, "ranked_again": changed_rows}

    def _touched(self, before: DataFrame, told: DataFrame, frequencies: DataFrame) -> DataFrame:
        """Keys of stored texts whose order of phrases can differ now.

        With all phrases counted once the score is one logarithm less another: more texts shift all of them
        alike, and their order stays unless the frequency of a phrase changed.  A text with a phrase counted
        twice, one that shares a phrase with the new texts, and one with a phrase so frequent that two scores
        may agree to six digits, are ranked again.
        """
        moved = told.select("phrase").distinct().unionByName(
            frequencies.filter(F.col("documents") >= _APART).select("phrase")).distinct()
        twice = before.filter("_tf > 1").select(KEY)
        return before.join(moved, "phrase", "left_semi").select(KEY).unionByName(twice).distinct()


def extract_default(chosen: DataFrame, folder: str, dataset_id: str, resume: bool = True) -> tuple[DataFrame, dict]:
    """Default topics of all rows of a data set seen so far, and what this call did.

    Halves that arrive one after the other end with the topics of the whole.  A text without a phrase has no
    topics; it counts as seen and is not tried again.
    """
    state = PhraseState(chosen.sparkSession, folder, dataset_id)
    if not resume:
        state.start_fresh()
    seen, before = state.seen(), state.current()
    resumed = 0 if before is None else before.count()
    todo = chosen if seen is None else joins.not_done(chosen, seen, [KEY])
    done = state.advance(todo.withColumn("process_time", F.date_trunc("second", F.current_timestamp())))
    topics = state.current()
    if topics is None:  # nothing was ever seen: an empty table of the right shape
        empty = chosen.limit(0).withColumn("process_time", F.current_timestamp())
        topics = ex.default_answers(empty, KEY, "narrative").withColumn(
            "all_topics_discussed", F.array().cast("array<string>"))
    return topics, {**done, "resumed_from": resumed}
