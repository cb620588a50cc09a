"""The JSON report of a run, and jobs with adjusted priors."""

from __future__ import annotations

import json
import math
from copy import deepcopy

from readloom.functions import sequences
from readloom.operators.stats import DecoderReport
from readloom.plans import config


def truncated(value, digits: int = 15):
    """Floats with their decimals cut, not rounded."""
    if isinstance(value, dict):
        return {k: truncated(v, digits) for k, v in value.items()}
    if isinstance(value, list):
        return [truncated(v, digits) for v in value]
    if isinstance(value, float) and math.isfinite(value):
        scale = 10**digits
        return math.trunc(value * scale) / scale if abs(value) < 1e3 else value
    return None if isinstance(value, float) else value


def decoder_document(report: DecoderReport) -> dict:
    """Totals, classes in codec order and the unclassified of one decoder."""
    d = report.decoder
    groups = d.topic == "sample"
    classified = []
    for i, b in enumerate(d.barcodes):
        row = {"index": i + 1, "barcode": list(b.segments), "concentration": b.concentration} | report.row(i + 1)
        classified.append((b.attributes if groups else {}) | row)
    out = {"index": d.number} | report.totals() | {"unclassified": (d.undetermined.attributes if groups else {}) | {"index": 0} | report.row(0)}
    return out | ({"classified": classified} if classified else {})


def run_document(incoming: dict, outgoing: dict, reports: list[DecoderReport], profile: list[dict] | None = None) -> dict:
    out: dict = {"incoming": incoming, "outgoing": outgoing}
    for r in reports:
        document = decoder_document(r)
        if r.decoder.topic == "sample":
            out["sample"] = document
        else:
            out.setdefault(r.decoder.topic, []).append(document)
    if profile:
        out["multiplex"] = profile
    return out


def text(document: dict, digits: int = 15) -> str:
    return json.dumps(config.sort_keys(truncated(document, digits)), indent=4, ensure_ascii=False) + "\n"


#: Names of a cycle's statistics, fixed by the report's format.
_CYCLE = {
    "count": "cycle count", "q1": "cycle quality first quartile", "q3": "cycle quality third quartile", "iqr": "cycle quality interquartile range", "left_whisker": "cycle quality left whisker",
    "right_whisker": "cycle quality right whisker", "min_quality": "cycle quality min", "max_quality": "cycle quality max", "mean_quality": "cycle quality mean", "median_quality": "cycle quality median",
}


def quality_document(channels: int, segments: int, lengths: list, averages: list, cycles: list) -> list[dict]:
    """Quality reports by channel and segment. lengths: a row (channel, segment) with shortest, longest, mean and highest average quality; averages: reads by bin of average quality; cycles: statistics by cycle and base ('*': all bases). What no read reached is 0."""
    measured = {(r["channel"], r["segment"]): r for r in lengths}
    bins: dict[tuple, list[int]] = {}
    for r in averages:
        bins.setdefault((r["channel"], r["segment"]), [0] * sequences.PHRED_BINS)[r["bin"]] += r["count"]
    by_base: dict[tuple, dict[str, dict[int, dict]]] = {}
    for r in cycles:
        by_base.setdefault((r["channel"], r["segment"]), {}).setdefault(r["base"], {})[r["cycle"]] = r.asDict()

    def distribution(found: dict[int, dict], width: int) -> dict:
        return {"cycle quality distribution": {name: [found.get(c, {}).get(k, 0) for c in range(width)] for k, name in _CYCLE.items()}}

    def of_segment(key: tuple) -> dict:
        m, bases = measured.get(key), by_base.get(key, {})
        width = m["longest"] if m else 0
        named = [
            {"nucleotide": base, "nucleotide count": sum(c["count"] for c in bases[base].values())} | distribution(bases[base], width)
            for base in sorted((b for b in bases if b != "*"), key=_ORDER.index)
        ]
        return {
            "min sequence length": m["shortest"] if m else 0, "max sequence length": width, "quality control by nucleotide": named,
            "quality control by cycle": distribution(bases["*"], width) if "*" in bases else {},
            "average phred score report": {"average phred score min": 0, "average phred score max": (m["highest"] or 0) if m else 0, "average phred score mean": (m["mean"] or 0) if m else 0, "average phred score distribution": bins.get(key, [0] * sequences.PHRED_BINS)},
        }

    return [{"quality control by segment": [of_segment((c, s + 1)) for s in range(segments)]} for c in range(channels)]


#: Order of bases in the report, that of their codes in the binary format (fixed).
_ORDER = "=ACMGRSVTWYHKDBN"


def adjust_priors(job: dict, document: dict) -> dict:
    """The job with noise and concentrations as a report estimated them; a class without an estimate gets 0."""
    job = deepcopy(job)
    for topic in ("sample", "molecular", "cellular"):
        given, found = job.get(topic), document.get(topic)
        if not given or not found:
            continue
        many = isinstance(given, list)
        for decoder, result in zip(given if many else [given], found if isinstance(found, list) else [found], strict=False):
            if "classified" not in result:
                continue
            decoder["noise"] = result.get("estimated noise", 0)
            estimate = {tuple(c["barcode"]): c.get("estimated concentration", 0) for c in result["classified"]}
            base = config.inherit(job.get("decoder", {}), decoder["base"]).get("codec", {}) if "base" in decoder else {}
            codec = config.merge(base, decoder.get("codec") or {})
            for entry in codec.values():
                entry["concentration"] = estimate.get(tuple(entry.get("barcode", ())), 0)
            decoder["codec"] = codec
    return job


def without_outputs(job: dict) -> dict:
    """The job for a pass that only estimates priors: no output is written."""
    job = deepcopy(job)
    job["output"] = ["/dev/null"]
    job.pop("template", None)
    for topic in ("sample", "molecular", "cellular"):
        for decoder in job[topic] if isinstance(job.get(topic), list) else filter(None, [job.get(topic)]):
            decoder.pop("output", None)
            for entry in [*(decoder.get("codec") or {}).values(), decoder.get("undetermined") or {}]:
                entry.pop("output", None)
    return job
