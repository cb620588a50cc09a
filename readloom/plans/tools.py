"""Companion tools: output layouts, two-pass prior estimation, and jobs from an instrument's run folder."""

from __future__ import annotations

import csv
import io
import os
import xml.etree.ElementTree as ElementTree
from copy import deepcopy

from pyspark.sql import SparkSession

from readloom.plans import compile as compiler
from readloom.plans import config, engine, report

_TOPICS = ("sample", "molecular", "cellular")


def estimate_priors(spark: SparkSession, job: dict) -> dict:
    """Run a job without outputs and return it with the priors that the run estimated."""
    plan = compiler.compile_job(report.without_outputs(job))
    return report.adjust_priors(job, engine.run(spark, plan).report)


def name_outputs(job: dict, split_libraries: bool, split_segments: bool, segments: int, kind: str = "sam", compression: str = "", prefix: str = "") -> dict:
    """The job with output names per library, per segment, both or neither. Names are prefix, library and segment joined by `_`."""
    job = deepcopy(job)
    packed = {"gz": ".gz", "bgzf": ".bgzf"}.get(compression, "")

    def names(library: str | None) -> list[str]:
        stem = "_".join(filter(None, [prefix, library])) or "output"
        return [f"{stem}_s{i + 1:0>2}.{kind}{packed}" for i in range(segments)] if split_segments else [f"{stem}.{kind}{packed}"]

    sample = job.setdefault("sample", {})
    base = config.inherit(job.get("decoder", {}), sample["base"]) if "base" in sample else {}
    if not split_libraries:
        job["output"] = names(None)
        return job
    job.pop("output", None)
    for key, entry in config.merge(base.get("codec") or {}, sample.get("codec") or {}).items():
        library = entry.get("LB") or "".join(entry.get("barcode", ())) or key.lstrip("@")
        sample.setdefault("codec", {}).setdefault(key, {})["output"] = names(str(library).replace(" ", "_"))
    sample.setdefault("undetermined", {})["output"] = names("undetermined")
    return job


def parse_sample_sheet(text: str) -> dict:
    """Sections of a sample sheet: Data as a list of rows by column, others as key to value."""
    sections: dict = {}
    name, rows = None, []

    def close() -> None:
        if name is None:
            return
        if name == "Data":
            sections[name] = list(csv.DictReader(io.StringIO("\n".join(rows))))
        else:
            sections[name] = {k: v for k, _, v in (r.partition(",") for r in rows if r.strip(","))}

    for line in text.splitlines():
        line = line.strip()
        if line.startswith("["):
            close()
            name, rows = line[1 : line.index("]")], []
        elif name is not None and line:
            rows.append(line)
    close()
    return sections


def parse_run_info(text: str) -> dict:
    """Flowcell, instrument, lanes and reads (cycles, is index) of RunInfo.xml."""
    run = ElementTree.fromstring(text).find("Run")
    reads = [{"cycles": int(r.get("NumCycles")), "index": r.get("IsIndexedRead") == "Y"} for r in run.iter("Read")]
    layout = run.find("FlowcellLayout")
    return {"id": run.get("Id"), "flowcell id": run.findtext("Flowcell"), "instrument": run.findtext("Instrument"), "date": run.findtext("Date"), "lanes": int(layout.get("LaneCount")) if layout is not None else 1, "reads": reads}


def parse_run_parameters(text: str) -> dict:
    """Cycle counts and platform text of RunParameters.xml, by the names of its elements."""
    root = ElementTree.fromstring(text)
    wanted = ("Read1NumberOfCycles", "IndexRead1NumberOfCycles", "IndexRead2NumberOfCycles", "Read2NumberOfCycles", "ApplicationName", "RunStartDate", "FlowCellSerialBarcode")
    return {e.tag: e.text for e in root.iter() if e.tag in wanted}


def core_job(sheet: dict, run: dict, lane: int, center: str = "", platform: str = "ILLUMINA") -> dict:
    """The decoder repository of a lane: a sample decoder over the index reads, a barcode per row of the sheet."""
    rows = [r for r in sheet.get("Data", []) if int(r.get("Lane") or lane) == lane]
    index_reads = [i for i, r in enumerate(run["reads"]) if r["index"]]
    codec = {}
    for r in rows:
        words = [w for w in (r.get("index"), r.get("index2")) if w]
        codec["@" + "".join(words)] = {"barcode": words, "LB": r.get("Sample_Name") or r.get("Sample_ID")} | ({"SM": r["Sample_Project"]} if r.get("Sample_Project") else {})
    n = len(next(iter(codec.values()))["barcode"]) if codec else 0
    tokens = [f"{i}::{len(next(iter(codec.values()))['barcode'][k])}" for k, i in enumerate(index_reads[:n])]
    name = f"{run['flowcell id']}_l{lane:0>2}_sample"
    job = {"PL": platform, "flowcell id": run["flowcell id"], "flowcell lane number": lane, "decoder": {name: {"codec": codec, "transform": {"token": tokens, "knit": [str(i) for i in range(len(tokens))]}}}}
    return job | ({"CN": center} if center else {})


def lane_inputs(run: dict, lane: int) -> list[str]:
    return [f"{run['flowcell id']}_l{lane:0>2}_s{i + 1:0>2}.fastq.gz" for i in range(len(run["reads"]))]


def sample_job(run: dict, lane: int, core: str) -> dict:
    """A lane's decoding job: biological segments out, likelihood decoding of the sample barcode."""
    biological = [i for i, r in enumerate(run["reads"]) if not r["index"]]
    return {
        "import": [core], "input": lane_inputs(run, lane), "template": {"transform": {"token": [f"{i}::" for i in biological]}},
        "sample": {"base": f"{run['flowcell id']}_l{lane:0>2}_sample", "algorithm": "pamld", "confidence threshold": 0.95, "noise": 0.05},
    }


def estimate_job(run: dict, lane: int, core: str) -> dict:
    """A lane's prior estimation: index segments only, nothing written."""
    index_reads = [i for i, r in enumerate(run["reads"]) if r["index"]]
    inputs = lane_inputs(run, lane)
    job = sample_job(run, lane, core)
    return job | {"input": [inputs[i] for i in index_reads], "output": ["/dev/null"], "template": {"transform": {"token": [f"{k}::" for k in range(len(index_reads))]}}}


def interleave_job(run: dict, lane: int, core: str) -> dict:
    """All segments of a lane in one file, undecoded."""
    return {"import": [core], "input": lane_inputs(run, lane), "output": [f"{run['flowcell id']}_l{lane:0>2}.bam"]}


def run_folder_jobs(folder: str) -> dict[str, dict]:
    """Jobs of every lane of a run folder, by file name."""
    read = lambda n: open(os.path.join(folder, n), encoding="utf-8").read()  # noqa: E731, SIM115
    sheet, run = parse_sample_sheet(read("SampleSheet.csv")), parse_run_info(read("RunInfo.xml"))
    out = {}
    for lane in range(1, run["lanes"] + 1):
        stem = f"{run['flowcell id']}_l{lane:0>2}"
        core = f"{stem}_core.json"
        out[core] = core_job(sheet, run, lane)
        out[f"{stem}_sample.json"] = sample_job(run, lane, core)
        out[f"{stem}_estimate.json"] = estimate_job(run, lane, core)
        out[f"{stem}_interleave.json"] = interleave_job(run, lane, core)
    return out
