from pyspark.sql import functions as F

from readloom.plans import compile as compiler
from readloom.plans import synthetic as syn
from readloom.streaming import decode_stream as ds


def plan():
    codec = {f"@{w}": {"barcode": [w], "concentration": c} for w, c in zip(syn.WORDS, syn.CONCENTRATIONS, strict=True)}
    return compiler.compile_job({"input": ["a.fastq", "b.fastq", "c.fastq"], "sample": {"algorithm": "pamld", "noise": syn.NOISE, "codec": codec, "transform": {"token": ["1::8"]}}})


def test_stream_equals_batch(spark, sf_dir, tmp_path):
    reads = syn.reads(spark, sf_dir)
    reads.repartition(3).write.parquet(str(tmp_path / "in"))
    job = plan()
    stream = ds.decode_stream(ds.read_stream(spark, str(tmp_path / "in"), reads.schema, 1), job)
    counts = ds.class_counts(stream, job.decoders[0]).writeStream.outputMode("complete").format("memory").queryName("counts").start()
    counts.processAllAvailable()
    counts.stop()
    batch = ds.class_counts(ds.decode_stream(reads, job), job.decoders[0])
    key = lambda rows: sorted((r["barcode_index"], r["best_index"], r["count"], r["pf_count"]) for r in rows)
    assert key(spark.table("counts").collect()) == key(batch.collect())

    stream = ds.decode_stream(ds.read_stream(spark, str(tmp_path / "in"), reads.schema, 1), job)
    written = ds.write_channels(stream, job, str(tmp_path / "out"), str(tmp_path / "check")).start()
    written.processAllAvailable()
    written.stop()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3 * reads.count()


def test_windows(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    reads = syn.reads_of(events).join(events.select(F.col("event_id").alias("read_index"), "ts"), "read_index")
    reads.write.parquet(str(tmp_path / "in"))
    job = plan()
    stream = ds.decode_stream(ds.read_stream(spark, str(tmp_path / "in"), reads.schema), job)
    out = ds.windowed_counts(stream, job.decoders[0], "ts").writeStream.outputMode("update").format("memory").queryName("windows").start()
    out.processAllAvailable()
    out.stop()
    assert spark.table("windows").agg(F.sum("count")).first()[0] >= reads.count()
