"""Jobs from the command line: spark-submit or `python -m crowdlens <job> --help`."""

from __future__ import annotations

import argparse
import signal
from functools import partial

from crowdlens.operators.labels import vocabulary_list
from crowdlens.operators.split import bounded_sample
from crowdlens.params import LabelParams, QueueParams, TextParams, from_conf
from crowdlens.plans import baselines, labelled_table, review_queue, scoring_parity, stream_scoring
from crowdlens.session import get_spark
from crowdlens.sources import events, lake, raw
from crowdlens.sources.schemas import SCHEMAS
from crowdlens.streaming import drain, offset_log, progress


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="crowdlens")
    top.add_argument("--master", help="Spark master; left to spark-submit by default")
    jobs = top.add_subparsers(dest="job", required=True)

    def job(name: str, *paths: str) -> argparse.ArgumentParser:
        sub = jobs.add_parser(name)
        for path in paths:
            sub.add_argument(f"--{path}", required=True)
        return sub

    ingest = job("ingest", "raw", "out")
    ingest.add_argument("--only", nargs="+", choices=sorted(SCHEMAS), default=sorted(SCHEMAS))
    job("features", "tables", "out")
    queue = job("queue", "tables", "out")
    queue.add_argument("--top", type=int, default=200)
    queue.add_argument("--rank-by", choices=["queue_score", "anomaly_score"], default="queue_score")
    job("parity", "out")
    fit = job("baselines", "features", "out")
    fit.add_argument("--arms", nargs="+", choices=baselines.ARMS, default=["linear_tfidf"])
    fit.add_argument("--sweep", nargs="*", type=int, default=[])
    land = job("land", "source", "target")
    land.add_argument("--dry-run", action="store_true", help="only write files and bytes per partition to target/_manifest")
    replay = job("replay", "features", "target")
    replay.add_argument("--split", choices=["train", "test"], default="test")
    replay.add_argument("--limit", type=int, help="so many events, spread over the whole table; all by default")
    replay.add_argument("--log", action="store_true", help="append to the message log `target`, partitioned by business")
    replay.add_argument("--broker", help="Kafka bootstrap servers; without it JSON lines are written to the target")
    stream = job("stream", "model", "out", "checkpoint")
    stream.add_argument("--path", help="folder of JSON lines")
    stream.add_argument("--broker")
    stream.add_argument("--topic")
    stream.add_argument("--from-beginning", action="store_true")
    stream.add_argument("--log", help="folder of a message log")
    stream.add_argument("--max-per-batch", type=int)
    stream.add_argument("--min-per-batch", type=int, help="wait for so many messages, or --max-delay-ms")
    stream.add_argument("--max-delay-ms", type=int)
    stream.add_argument("--max-events", type=int, help="stop after the micro-batch that reaches so many; the default is no bound")
    stream.add_argument("--wait", help="trigger interval; without it the job stops when it has caught up")
    stream.add_argument("--top-k", type=int, default=3)
    stream.add_argument("--publish-to", help="topic or folder for scored events as keyed messages")
    return top


def main(arguments: list[str] | None = None) -> None:
    args = parser().parse_args(arguments)
    spark = get_spark(f"crowdlens-{args.job}", args.master)
    if args.job == "ingest":
        for result in raw.ingest(spark, {name: f"{args.raw}/{name}.json" for name in args.only}, args.out):
            print(result)
    elif args.job == "features":
        labelled_table.run(spark, args.tables, args.out, from_conf(spark, LabelParams())).show()
    elif args.job == "queue":
        review_queue.run(
            spark, f"{args.tables}/review", f"{args.tables}/user", args.out, from_conf(spark, QueueParams()), args.top,
            args.rank_by,
        ).show(15, truncate=False)
    elif args.job == "parity":
        scoring_parity.run(spark, args.out).show()
    elif args.job == "baselines":
        names = vocabulary_list(spark.read.parquet(f"{args.features}/category_vocab"))
        baselines.run(
            spark, f"{args.features}/review_labeled", args.out, names, args.arms, from_conf(spark, TextParams()), args.sweep
        ).show()
    elif args.job == "land":
        if args.dry_run:
            lake.landing_manifest(spark, args.source).write.mode("overwrite").json(f"{args.target}/_manifest")
            spark.read.json(f"{args.target}/_manifest").show(200, truncate=False)  # what it wrote, as far as a screen holds it
        else:
            lake.land(spark, args.source, args.target)
    elif args.job == "replay":
        labelled = spark.read.parquet(f"{args.features}/review_labeled").where(f"split = '{args.split}'")
        labelled = bounded_sample(labelled, "review_id", args.limit)
        kafka = {"kafka.bootstrap.servers": args.broker} if args.broker else None
        messages = events.as_messages(events.review_events(labelled), "business_id")
        if args.log:
            offset_log.append(messages, args.target)
        else:
            events.write_messages(messages, args.target, kafka)
    elif args.job == "stream":
        kafka = {"kafka.bootstrap.servers": args.broker, "subscribe": args.topic} if args.broker else None
        log = progress.ProgressLog(echo=True, head=partial(offset_log.head, args.log) if args.log else None)
        stop = drain.Drain(args.max_events)
        spark.streams.addListener(log)
        running = stream_scoring.run(
            spark, args.model, args.out, args.checkpoint, args.path, kafka, args.from_beginning, args.max_per_batch,
            args.wait, args.top_k, args.publish_to, args.min_per_batch, args.max_delay_ms, args.log, stop,
        )
        restore = stop.on_signals(signal.SIGINT, signal.SIGTERM)
        try:
            stop.wait(running)
        finally:  # also of a run that was interrupted
            restore()
            report = log.report(spark, running)
            report.write.mode("append").json(f"{args.out}/run_report")
            report.show(truncate=False)


if __name__ == "__main__":
    main()
