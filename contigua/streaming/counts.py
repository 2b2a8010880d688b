"""Extension counts over a stream of reads."""

from __future__ import annotations

from pyspark.sql import DataFrame

from contigua.config import Config
from contigua.operators import growing, kmers, superkmers
from contigua.operators.storage import remove


def stream_extension_counts(reads: DataFrame, cfg: Config) -> DataFrame:
    """The counts of extension_counts() over all reads so far; for the output modes update and complete.

    The state has a row for each k-mer. Reads have no time, so nothing in it grows old and there is no watermark.
    """
    return kmers.extension_counts(kmers.canonicalised(kmers.good_quality(kmers.extract(reads, cfg, strands=True), cfg)), cfg)


def count_available(reads: DataFrame, path: str, state: str, cfg: Config, buckets: int = growing.BUCKETS) -> DataFrame:
    """Counts what a stream of reads has now, on top of what an earlier call with the same state counted, and returns the sums so far.

    The state's checkpoint has the offsets of the reads: a call that was interrupted is made up for by the next one, and no read counts twice. The reads of a
    batch are counted alone and merged with the sums of the batch before, which lie in `buckets` buckets and are not exchanged. Sums are written to `path`, a folder for
    each batch; those of the last one are whole. A batch that is repeated reads the one before it again, so it must not be deleted before the next one is whole.
    """
    spark = reads.sparkSession
    last: list[str] = []

    def put(rows: DataFrame, batch: int) -> None:
        last[:] = [f"{path}/batch-{batch}"]
        remove(spark, last[0])  # what an interrupted run of this batch left
        if batch:
            growing.grow(growing.opened(spark, f"{path}/batch-{batch - 1}", buckets), rows, last[0], cfg, buckets)
        else:
            growing.store(superkmers.extension_counts(rows, cfg), last[0], buckets)

    reads.writeStream.trigger(availableNow=True).option("checkpointLocation", state).foreachBatch(put).start().awaitTermination()
    if not last:
        raise ValueError("the stream had nothing that was not counted before")
    return spark.read.schema(growing.SCHEMA).parquet(last[0])
