"""Model windows of the sequences that are new: takes the files that arrived since the last run, once.

    python jobs/new_sequences.py --input FOLDER --out FOLDER --checkpoint FOLDER [--config FILE]

The input is a stream of Parquet files. Of the new ones, sequences are cleaned, sequences that earlier batches or smaller ids have given are left
out, and the others are cut into overlapping windows with their composition. A sequence's windows all go to train or to val, by a hash of
the sequence, so a later copy can't leak from one into the other.

OUT is a Parquet table partitioned by batch and split. A batch writes its own partitions only: one that was broken off is done again by the next run,
with the same files, and replaces them. What has been taken is known to the checkpoint alone; with a new checkpoint
the job starts over, and its first batch replaces the whole table.

Rows without an id or whose cleaned sequence is empty give no window and are counted in the log. Files may arrive in any order and with any age; columns beyond the
config's schema are ignored, ones that a file lacks are null.
"""

from __future__ import annotations

import os
import sys

sys.path[:0] = [os.path.dirname(os.path.dirname(os.path.abspath(__file__)))] if __name__ == "__main__" else []

from pyspark.sql import DataFrame, SparkSession, functions as F  # noqa: E402

from helixmill.functions import sequence as seq  # noqa: E402
from helixmill.operators import rows, sampling  # noqa: E402
from jobs.common import LOG, command, counted, counts, shaped  # noqa: E402

#: The input's schema, columns by SQL expression, windows, the share of sequences for validation, and the files taken at once (null: all).
DEFAULTS = {"schema": "id long, source string, sequence string", "columns": {c: c for c in ("id", "source", "sequence")}, "width": 203, "stride": 100, "val_percent": 10, "files_a_batch": None}
SCHEMA = "id long, source string, key string, len_nt int, win_index int, window string, gc_pct double, n_count int, hexamer boolean, batch long, split string"


def read(spark: SparkSession, out: str) -> DataFrame:
    """The job's windows."""
    return spark.read.schema(SCHEMA).parquet(out)


def unseen(new: DataFrame, earlier: DataFrame) -> DataFrame:
    """Rows of new whose key earlier doesn't have. The keys of a batch are few beside all earlier ones, so they choose from those first: what is
    shuffled of the whole table are the keys that recur, if the batch is small enough to be broadcast."""
    recurring = earlier.where("win_index = 0").select("key").join(new.select("key"), "key", "left_semi")
    return rows.remainder(new, recurring, "key")


def windows(sequences: DataFrame, config: dict) -> DataFrame:
    """One row a window. The split is drawn from the key."""
    w = F.col("window")
    t = sequences.select("id", "source", "key", F.length("sequence").alias("len_nt"), F.posexplode(seq.sliding_windows(F.col("sequence"), config["width"], config["stride"])).alias("win_index", "window"))
    b = seq.composition(F.translate(w, "T", "U"))
    t = t.withColumns({"gc_pct": b["GC_pct"], "n_count": b["N_count"], "hexamer": seq.has_hexamer(w)})
    return t.withColumn("split", F.when(sampling.whole_number(F.col("key"), "split", 100) < config["val_percent"], "val").otherwise("train"))


def run(spark: SparkSession, source: str, out: str, checkpoint: str, config: dict) -> None:
    """Take what is new in `source`, and end."""
    config = DEFAULTS | config

    def take(batch: DataFrame, number: int) -> None:
        session, seen = batch.sparkSession, {}
        t = counted(shaped(batch, config["columns"]), "read", seen).withColumn("sequence", seq.clean(F.col("sequence")))
        t = counted(t.where("id is not null and sequence <> ''"), "with id and sequence", seen)
        t = t.withColumn("key", F.sha1("sequence"))
        one = counted(rows.keep_first(t, ["key"], ["id", "source"]), "distinct in the batch", seen)
        new = one if number == 0 else unseen(one, read(session, out).where(F.col("batch") < number))
        made = counted(windows(counted(new, "new", seen), config), "windows written", seen).withColumn("batch", F.lit(number).cast("long"))
        mode = "static" if number == 0 else "dynamic"
        made.select(*(c.split()[0] for c in SCHEMA.split(", "))).write.mode("overwrite").option("partitionOverwriteMode", mode).partitionBy("batch", "split").parquet(out)
        LOG.info("batch %d of %s: %s", number, source, ", ".join(f"{what} {n}" for what, n in counts(seen).items()))

    stream = spark.readStream.schema(config["schema"]).option("maxFileAge", "36500d")
    if config["files_a_batch"]:
        stream = stream.option("maxFilesPerTrigger", config["files_a_batch"])
    query = stream.parquet(source).writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    LOG.info("all files of %s are in %s", source, out)


if __name__ == "__main__":
    command(__doc__.split("\n")[0], "new_sequences.json", {"input": "folder of Parquet files", "out": "folder of the table", "checkpoint": "folder of the checkpoint"}, run, DEFAULTS)
