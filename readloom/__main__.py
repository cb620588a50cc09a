"""Command line: `python -m readloom mux --config job.json`."""

from __future__ import annotations

import argparse
import json
import shlex
import sys

from readloom.functions.tokens import PlanError
from readloom.plans import compile as compiler
from readloom.plans import config, engine, report, tools


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="readloom", description="Classify and re-multiplex sequencing reads.")
    actions = top.add_subparsers(dest="action", required=True)
    mux = actions.add_parser("mux", help="decode, annotate and route reads")
    add = mux.add_argument
    add("-i", "--input", action="append", help="an input file; repeat for more segments")
    add("-o", "--output", action="append", help="an output file")
    add("-c", "--config", help="a job document")
    add("-R", "--report", dest="report url", help="where the report goes")
    add("-I", "--base-input", dest="base input url", help="folder of relative inputs")
    add("-O", "--base-output", dest="base output url", help="folder of relative outputs")
    add("-s", "--sense-input", action="store_true", help="find the segments of input files by their first records")
    add("-n", "--no-output-npf", dest="filter outgoing qc fail", action="store_true", default=None, help="do not write failed reads")
    add("-N", "--no-input-npf", dest="filter incoming qc fail", action="store_true", default=None, help="drop reads that came failed")
    add("-l", "--leading-segment", dest="leading segment index", type=int, help="the segment whose flag counts")
    add("-F", "--format", dest="default output format", choices=compiler.FORMATS, help="format of outputs without an extension")
    add("-Z", "--compression", dest="default output compression", help="compression of outputs")
    add("-L", "--level", dest="default output compression level", help="compression level")
    add("-T", "--token", action="append", help="a template token; repeat for more")
    add("-P", "--platform", choices=compiler.PLATFORMS, help="sequencing platform")
    add("-q", "--quality", dest="enable quality control", action="store_true", default=None, help="add quality profiles to the report")
    add("-V", "--validate", action="store_true", help="describe the compiled job and stop")
    add("-D", "--distance", action="store_true", help="show barcode distances when validating")
    add("-C", "--compile", action="store_true", help="print the compiled job and stop")
    add("-S", "--static", action="store_true", help="print the job with imports and inheritance resolved and stop")
    add("-j", "--job", dest="include compiled job", action="store_true", default=None, help="add the compiled job to the report")
    add("-t", "--threads", type=int, help="local cores")
    add("--decoding-threads", dest="decoding threads", type=int, help="accepted for compatibility; Spark schedules tasks")
    add("--htslib-threads", dest="htslib threads", type=int, help="accepted for compatibility")
    add("-B", "--buffer", dest="buffer capacity", type=int, help="accepted for compatibility")
    add("--precision", dest="float precision", type=int, help="decimals of the report")
    add("--prior", dest="prior adjusted job url", help="where to write the job with estimated priors")
    return top


#: Options that are not keys of a job.
_LOCAL = ("action", "config", "sense_input", "token", "validate", "distance", "compile", "static")


def job_of(options: argparse.Namespace) -> dict:
    given = {k: v for k, v in vars(options).items() if k not in _LOCAL and v is not None}
    return config.overlay(given, config.load(options.config)) if options.config else given


def compiled_document(plan: compiler.Plan) -> dict:
    """The plan as a document: the job with defaults and every decoder's classes filled in."""
    out = {k: v for k, v in plan.document.items() if k not in ("decoder", *compiler.TOPICS)}
    for d in plan.decoders:
        row = {"index": d.number, "algorithm": d.algorithm, "transform": d.transform.document(), "noise": d.noise, "confidence threshold": d.confidence_threshold, "high quality threshold": d.high_quality_threshold, "high quality distance threshold": d.high_quality_distance_threshold, "corrected quality": d.corrected_quality, "quality masking threshold": d.quality_masking_threshold, "multiplexing classifier": d.multiplexing, "segment cardinality": len(d.transform.knit)}
        row["codec"] = {b.key: {"barcode": list(b.segments), "concentration": b.concentration, "index": i + 1} | b.attributes for i, b in enumerate(d.barcodes)}
        row["undetermined"] = {"concentration": d.noise, "index": 0} | d.undetermined.attributes
        if d.topic == "sample":
            out["sample"] = row
        else:
            out.setdefault(d.topic, []).append(row)
    return config.sort_keys(config.clean(out) or {})


def main(arguments: list[str] | None = None) -> int:
    options = parser().parse_args(arguments)
    try:
        job = job_of(options)
        if options.static:
            print(json.dumps(config.sort_keys(config.clean(job)), indent=4))
            return 0
        inputs = [compiler.Url.parse(u, job.get("base input url", "")) for u in job.get("input") or []]
        job = {"application name": "readloom", "full command": shlex.join(["readloom", *(sys.argv[1:] if arguments is None else arguments)])} | job
        plan = compiler.compile_job(job, engine.sense(inputs) if options.sense_input else None, options.token)
        if options.validate:
            print(compiler.describe(plan), end="")
            return 0
        if options.compile:
            print(json.dumps(compiled_document(plan), indent=4))
            return 0
        compiler.check_access(plan)
        from pyspark.sql import SparkSession

        spark = SparkSession.builder.master(f"local[{options.threads or '*'}]").appName("readloom").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
        result = engine.run(spark, plan)
        document = result.report | ({"job": compiled_document(plan)} if plan.document.get("include compiled job") else {})
        text = report.text(document, int(plan.document["float precision"]))
        target = plan.document["report url"]
        if target in ("/dev/stderr", "/dev/stdout"):
            (sys.stderr if target == "/dev/stderr" else sys.stdout).write(text)
        else:
            with open(target, "w", encoding="utf-8") as file:
                file.write(text)
        if adjusted := job.get("prior adjusted job url"):
            with open(adjusted, "w", encoding="utf-8") as file:
                file.write(json.dumps(config.sort_keys(report.adjust_priors(job, result.report)), indent=4) + "\n")
        return 0
    except (PlanError, FileNotFoundError) as error:
        print(f"readloom: {error}", file=sys.stderr)
        return 1


__all__ = ["compiled_document", "job_of", "main", "parser", "tools"]

if __name__ == "__main__":
    sys.exit(main())
