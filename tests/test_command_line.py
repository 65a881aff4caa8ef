"""The command line on small folders: what it prints, and its status."""

import json

import pytest

from sparkfolio.__main__ import main
from sparkfolio.sources.expansion import expand, notes, strict


@pytest.fixture()
def folder(tmp_path):
    (tmp_path / "in" / "sub").mkdir(parents=True)
    (tmp_path / "in" / "plan.txt").write_text("VS-NfD\n\nThe boat lies in the harbour.\n")
    (tmp_path / "in" / "sub" / "note.md").write_text("# Title\n\nNothing, but a boat and boat\n")
    (tmp_path / "in" / "bad.docx").write_bytes(b"no package")
    (tmp_path / "in" / "x.unknown").write_text("?")
    (tmp_path / "boats.txt").write_text("boat\n")
    return tmp_path


def run(spark, capsys, *argv):
    status = main([str(x) for x in argv], spark)
    return status, capsys.readouterr().out


def test_sources_are_expanded(spark, folder):
    got = expand(spark, [f"{folder}/in", f"{folder}/in/*.txt", f"{folder}/none", f"{folder}/in/*.pdf", f"{folder}/in/x.unknown", f"{folder}/in"])
    assert [p.rsplit("/", 1)[-1] for p in got.paths] == ["in", "plan.txt"]
    assert sorted((k.rsplit("/", 1)[-1], v) for k, v in got.missing.items()) == [("*.pdf", "nothing matches"), ("none", "no such file"), ("x.unknown", "unsupported: unknown")]
    rows = {r["path"].rsplit("/", 1)[-1]: (r["status"], r["error_kind"]) for r in notes(spark, [f"{folder}/in", f"{folder}/none"], b"a,b\n1,2\n", "t.csv").collect()}
    assert rows == {"plan.txt": ("ok", None), "note.md": ("ok", None), "bad.docx": ("error", "unreadable"), "none": ("error", "missing"), "t.csv": ("ok", None)}
    with pytest.raises(Exception, match=r"bad\.docx"):
        strict(notes(spark, [f"{folder}/in"])).collect()
    assert notes(spark, []).collect() == []


def test_terms_and_gates(spark, capsys, folder):
    status, out = run(spark, capsys, "find", folder / "in" / "plan.txt", folder / "in" / "sub", "--profile", folder / "boats.txt", "--format", "jsonl")
    found = {x["source"].rsplit("/", 1)[-1]: [f["match"] for f in x.get("findings", [])] for x in map(json.loads, out.splitlines())}
    assert status == 3 and found == {"plan.txt": ["boat"], "note.md": ["boat", "boat"]}
    assert run(spark, capsys, "find", folder / "in" / "plan.txt", "--profile", folder / "boats.txt", "--fail-on", "none")[0] == 0
    assert run(spark, capsys, "find", folder / "in", "--profile", folder / "boats.txt", "--fail-on", "severity", "--least", "critical")[0] == 1
    status, out = run(spark, capsys, "find", folder / "in", "--profile", folder / "boats.txt", "--format", "csv")
    rows = out.splitlines()
    assert rows[0].startswith("source,status,page,kind") and len(rows) == 5 and any(",error," in r for r in rows)


def test_markings_and_summary(spark, capsys, folder):
    status, out = run(spark, capsys, "vs", folder / "in", "--format", "json", "--least", "geheim")
    said = json.loads(out.splitlines()[0])
    assert status == 1 and said["by_label"] == {"VS-NfD": 1} and said["summary"] == {"files": 3, "marked": 1, "with_hits": 0, "unreadable": 1, "clean": 1, "tripped": 0}
    assert run(spark, capsys, "vs", folder / "in" / "plan.txt")[0] == 3
    status, out = run(spark, capsys, "vs", folder / "in" / "sub", "--format", "text")
    assert status == 0 and out.strip().endswith("note.md: clean")


def test_scan_and_notes(spark, capsys, folder):
    status, out = run(spark, capsys, "scan", folder / "in" / "sub", folder / "nowhere")
    rows = {r["path"].rsplit("/", 1)[-1]: r for r in map(json.loads, out.splitlines())}
    assert status == 1 and rows["note.md"]["title"] == "Title" and rows["nowhere"]["error"] == "no such file"
    assert run(spark, capsys, "scan", folder / "in" / "sub", "--out", folder / "out")[0] == 0 and list((folder / "out").glob("*.json"))
    assert run(spark, capsys, "markdown", folder / "in", folder / "notes")[0] == 0 and (folder / "notes" / "sub" / "note.md").exists()


def test_wrong_arguments(spark, capsys, folder):
    assert [main(x) for x in (["find", "x"], ["nothing"], ["vs", "x", "--least", "huge"], ["find", "x", "--profile", str(folder / "gone")], ["find", "x", "--profile", str(folder / "boats.txt"), "--fail-on", "severity", "--least", "huge"])] == [2] * 5
    assert main(["languages"]) == main(["formats"]) == 0 and "hocr" in capsys.readouterr().out
