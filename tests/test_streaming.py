from glossarium.operators.pairs import candidates
from glossarium.streaming.counts import current_counts, start_candidate_counts


def test_counts_follow_the_stream(spark, tmp_path):
    """Batches, a stop, and a batch that was written but not committed before it: the sums are those of all arcs."""
    schema = "noun string, verb string"
    rows = [("a", "v"), ("a", "v"), ("b", "v")]
    stream = lambda: spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")

    def run(*more):
        for name in more:
            spark.createDataFrame(rows[:1] if name else rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{name}")
        query = start_candidate_counts(stream(), f"{tmp_path}/counts", f"{tmp_path}/state")
        try:
            query.processAllAvailable()
        finally:
            query.stop()
        whole = candidates(spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in"))
        assert {tuple(r) for r in current_counts(spark, f"{tmp_path}/counts").collect()} == {tuple(r) for r in whole.collect()}

    (tmp_path / "in").mkdir()
    run(0)
    run(1, 2)
    last = max((tmp_path / "state" / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    last.unlink()  # as if the process had ended between the write and the commit
    (last.parent / f".{last.name}.crc").unlink(missing_ok=True)
    run(3)
