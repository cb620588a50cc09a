import json
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from readloom import __main__ as cli
from readloom.functions.tokens import PlanError
from readloom.plans import compile as compiler
from readloom.plans import config, engine, tools
from readloom.plans import synthetic as syn

scalars = st.one_of(st.none(), st.booleans(), st.integers(-3, 3), st.text("ab", max_size=2), st.lists(st.integers(0, 2), max_size=2))
documents = st.recursive(st.dictionaries(st.sampled_from("abc"), scalars, max_size=3), lambda c: st.dictionaries(st.sampled_from("xyz"), c, max_size=3), max_leaves=6)


@given(documents, documents)
@settings(max_examples=80, deadline=None)
def test_merge_laws(a, b):
    assert config.merge({}, a) == a == config.merge(a, {}) == config.merge(a, a)
    try:
        merged = config.merge(a, b)
    except PlanError:
        return
    assert set(merged) == set(a) | set(b)
    assert config.merge(a, merged) == merged
    assert config.clean(config.clean(a)) == config.clean(a)
    assert config.sort_keys(merged) == merged


def test_algebra():
    assert config.merge({"a": {"x": 1, "y": 2}, "l": [1]}, {"a": {"x": 5}, "l": [2]}) == {"a": {"x": 5, "y": 2}, "l": [2]}
    with pytest.raises(PlanError):
        config.merge({"a": {}}, {"a": 1})
    assert config.clean({"a": None, "b": False, "c": "", "d": [], "e": {"f": {}}, "g": 0, "h": 0.0}) == {"g": 0, "h": 0.0}
    assert config.project({"a": 1, "b": {"c": 2}}, {"a": 5, "b": {"c": 6, "d": 7}, "z": 1}) == {"a": 5, "b": {"c": 6}}
    assert config.remove_disabled({"a": {"disabled": True}, "b": [{"disabled": True}, {"x": 1}]}) == {"b": [{"x": 1}]}
    with pytest.raises(PlanError):
        config.inherit({"a": {"base": "b"}, "b": {"base": "a"}}, "a")
    with pytest.raises(PlanError):
        config.inherit({"a": {"base": "c"}}, "a")


def test_imports(tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "deep.json").write_text('{"a": 1, "b": 1, "c": 1}')
    (tmp_path / "sub/one.json").write_text('{"import": ["../deep.json"], "b": 2, "d": 2}')
    (tmp_path / "two.json").write_text('{"d": 3}')
    (tmp_path / "job.json").write_text('{"import": ["sub/one.json", "two.json", "job.json"], "c": 4}')
    assert config.load(str(tmp_path / "job.json")) == {"a": 1, "b": 2, "c": 4, "d": 3}


def job(**changes):
    codec = {f"@{w}": {"barcode": [w], "concentration": 1 + i} for i, w in enumerate(syn.WORDS[:4])}
    out = {
        "input": ["a.fastq", "b.fastq"], "flowcell id": "FC", "flowcell lane number": 2, "SM": "s", "decoder": {"base": {"codec": codec, "transform": {"token": ["1::8"]}}},
        "sample": {"base": "base", "algorithm": "pamld", "noise": 0.04, "codec": {f"@{syn.WORDS[0]}": {"LB": "lib"}}}, "template": {"transform": {"token": ["0::"]}},
    }
    return out | changes


def test_compile():
    plan = compiler.compile_job(job())
    (d,) = plan.decoders
    assert sum(b.concentration for b in d.barcodes) == pytest.approx(0.96)
    assert d.multiplexing and plan.segments == 2 and [d.flat for d in d.barcodes] == sorted(syn.WORDS[:4])
    first = next(b for b in d.barcodes if b.flat == syn.WORDS[0])
    assert first.attributes == {"SM": "s", "LB": "lib", "BC": syn.WORDS[0], "PU": f"FC:2:{syn.WORDS[0]}", "ID": f"FC:2:{syn.WORDS[0]}"}
    assert plan.read_groups[0]["ID"] == "FC:2:undetermined"
    assert "distances" in compiler.describe(plan)
    assert compiler.compile_job({"input": ["a.fastq", "a.fastq"]}).layout[0][1] == 2


@pytest.mark.parametrize(
    "changes",
    [
        {"sample": {"base": "none"}}, {"sample": {"base": "base", "algorithm": "odd"}}, {"sample": {"base": "base", "noise": 2}}, {"min input length": [1]}, {"min input length": [0, 300]},
        {"input phred offset": 200}, {"platform": "ODD"}, {"input": ["/dev/null", "b.fastq"]}, {"output": ["a.fastq"]}, {"output": ["x.sam", "y.sam"]}, {"report url": "a.fastq"},
        {"sample": {"algorithm": "mdd", "base": "base", "distance tolerance": [9]}}, {"template": {"transform": {"token": ["7::"]}}}, {"sample": {"base": "base", "transform": {"token": ["1::"]}}},
        {"sample": {"base": "base", "codec": {"@x": {"barcode": ["ACG"]}}}}, {"sample": {"base": "base", "codec": {"@x": {"barcode": [syn.WORDS[0]]}}}}, {"sample": {"algorithm": "pamld"}},
    ],
)
def test_compile_errors(changes):
    with pytest.raises(PlanError):
        compiler.compile_job(job(**changes))


@pytest.fixture
def lane(tmp_path):
    rng = random.Random(5)
    with open(tmp_path / "a.fastq", "w") as a, open(tmp_path / "b.fastq", "w") as b:
        for i in range(120):
            word = rng.choice(syn.WORDS[:4]) if i % 10 else "NNNNNNNN"
            seq = "".join(rng.choice("ACGT") for _ in range(20))
            a.write(f"@r{i} 1:{'Y' if i % 7 == 0 else 'N'}:0:\n{seq}\n+\n{'I' * 20}\n")
            b.write(f"@r{i} 2:N:0:\n{word}\n+\n{'I' * 8}\n")
    return tmp_path


@pytest.mark.parametrize("kind", ["sam", "fastq", "bam"])
def test_run(spark, lane, kind):
    document = job(**{"base input url": str(lane), "base output url": str(lane / "out")})
    document["sample"]["codec"] |= {f"@{w}": {"output": [f"{w}.{kind}"]} for w in syn.WORDS[:4]}
    document["sample"]["undetermined"] = {"output": [f"rest.{kind}"]}
    result = engine.run(spark, compiler.compile_job(document))
    sample = result.report["sample"]
    assert result.report["incoming"] == {"count": 120, "pf count": 102, "pf fraction": 102 / 120}
    assert sample["unclassified"]["count"] == 12 and sample["count"] == 120
    assert len(result.files) == 5
    by_word = {"".join(c["barcode"]): c["count"] for c in sample["classified"]}
    for word, n in {**by_word, "rest": 12}.items():
        path = lane / "out" / f"{word}.{kind}"
        if kind == "bam":
            from readloom.sources import bam

            assert sum(1 for _ in bam.records(str(path))) == n
        else:
            lines = [x for x in path.read_text().splitlines() if kind == "fastq" or not x.startswith("@")]
            assert len(lines) == n * (4 if kind == "fastq" else 1)
            if kind == "sam":
                order = [int(x.split("\t")[0][1:]) for x in lines]
                assert order == sorted(order) and all(f"BC:Z:{word}" in x or word == "rest" for x in lines)


def test_segments_out_of_step(spark, lane):
    text = (lane / "b.fastq").read_text().replace("@r5 ", "@other ")
    (lane / "b.fastq").write_text(text)
    plan = compiler.compile_job(job(**{"base input url": str(lane), "output": ["/dev/null"]}))
    with pytest.raises(Exception, match="out of step"):
        engine.read_inputs(spark, plan).collect()


def test_filters_profile_and_priors(spark, lane):
    document = job(**{"base input url": str(lane), "output": ["/dev/null"], "filter incoming qc fail": True, "enable quality control": True})
    result = engine.run(spark, compiler.compile_job(document))
    assert result.files == [] and result.report["outgoing"]["count"] == 102
    segment = result.report["multiplex"][0]["quality control by segment"][0]
    cycles = segment["quality control by cycle"]["cycle quality distribution"]
    assert segment["max sequence length"] == 20 and len(cycles["cycle count"]) == 20 and set(cycles["cycle quality median"]) == {40}
    n = result.report["sample"]["unclassified"]["count"]
    assert sum(b["nucleotide count"] for b in segment["quality control by nucleotide"]) == 20 * n and segment["average phred score report"]["average phred score distribution"][40] == n
    adjusted = tools.estimate_priors(spark, document)
    estimated = {k: v["concentration"] for k, v in adjusted["sample"]["codec"].items()}
    assert sum(estimated.values()) == pytest.approx(1 - adjusted["sample"]["noise"])


def test_command_line(lane, capsys, tmp_path):
    path = tmp_path / "job.json"
    path.write_text(json.dumps(job(**{"base input url": str(lane)})))
    assert cli.main(["mux", "-c", str(path), "--validate"]) == 0
    assert "Sample decoder 0" in capsys.readouterr().out
    assert cli.main(["mux", "-c", str(path), "--compile", "-T", "0::4"]) == 0
    compiled = json.loads(capsys.readouterr().out)
    assert compiled["sample"]["multiplexing classifier"] is True and compiled["template"]["transform"]["token"] == ["0::4"]
    assert cli.main(["mux", "-c", str(path), "--static", "-n"]) == 0
    assert json.loads(capsys.readouterr().out)["filter outgoing qc fail"] is True
    assert cli.main(["mux", "-c", str(tmp_path / "none.json")]) == 1


def test_access(lane):
    compiler.check_access(compiler.compile_job(job(**{"base input url": str(lane), "base output url": str(lane / "new/folder"), "output": ["x.sam"]})))
    with pytest.raises(PlanError):
        compiler.check_access(compiler.compile_job(job(**{"base input url": "/nowhere"})))


def test_output_names():
    named = tools.name_outputs(job(), True, True, 2, "fastq", "gz", "p")
    assert named["sample"]["codec"][f"@{syn.WORDS[0]}"]["output"] == ["p_lib_s01.fastq.gz", "p_lib_s02.fastq.gz"]
    assert tools.name_outputs(job(), False, False, 2)["output"] == ["output.sam"]


def test_run_folder(tmp_path):
    (tmp_path / "SampleSheet.csv").write_text("[Header]\nDate,2018\n[Data]\nLane,Sample_ID,Sample_Name,index,index2,Sample_Project\n1,1,one,ACGTACGT,TTTTCCCC,p\n1,2,two,CCGTACGT,TTTTCCAA,p\n2,3,three,GGGTACGT,TTTTCCCC,\n")
    (tmp_path / "RunInfo.xml").write_text('<RunInfo><Run Id="x"><Flowcell>FC</Flowcell><Instrument>A</Instrument><Date>1</Date><Reads><Read Number="1" NumCycles="151" IsIndexedRead="N"/><Read Number="2" NumCycles="8" IsIndexedRead="Y"/><Read Number="3" NumCycles="8" IsIndexedRead="Y"/><Read Number="4" NumCycles="151" IsIndexedRead="N"/></Reads><FlowcellLayout LaneCount="2"/></Run></RunInfo>')
    jobs = tools.run_folder_jobs(str(tmp_path))
    for name, document in jobs.items():
        (tmp_path / name).write_text(json.dumps(document))
    assert len(jobs) == 8
    plan = compiler.compile_job(config.load(str(tmp_path / "FC_l01_sample.json")))
    assert [b.segments for b in plan.decoders[0].barcodes] == [("ACGTACGT", "TTTTCCCC"), ("CCGTACGT", "TTTTCCAA")]
    assert plan.decoders[0].transform.widths() == (8, 8)
    assert jobs["FC_l02_estimate.json"]["input"] == ["FC_l02_s02.fastq.gz", "FC_l02_s03.fastq.gz"]
