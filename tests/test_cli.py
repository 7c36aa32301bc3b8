import json

from fernweave import cli


def test_build_and_search(spark, tmp_path, capsys):
    issues = [{"identifier": "AB-1", "title": "Retry queue", "labels": {"nodes": [{"name": "Perf"}]}, "comments": [{"body": "# build-up-learnings\nbackoff", "user": {"name": "ann"}}]}]
    (tmp_path / "t.json").write_text(json.dumps(issues))
    g, v = f"{tmp_path}/graph", f"{tmp_path}/vectors"
    run = lambda *a: (cli.main([*a, "--graph", g, "--vectors", v]), capsys.readouterr().out)
    code, out = run("build", "--tracker", f"file://{tmp_path}/t.json")
    assert code == 0 and json.loads(out)["quads"] > 10
    assert run("build", "--tracker", f"file://{tmp_path}/missing.json")[0] == 1
    assert run("build", "--tracker", f"file://{tmp_path}/t.json")[0] == 0
    assert "AB-1 build-up learnings" in run("retry")[1]
    assert "no index" in run("search", "retry", "--semantic")[1]
    assert json.loads(run("search", "retry", "--hybrid", "--json")[1].splitlines()[0])["degraded"] is True
    assert json.loads(run("embed")[1])["written"]
    assert "semantic" in run("search", "retry", "--hybrid", "--json")[1]
    iri = "https://example.org/kg/resource/comment/AB-1/0"
    assert "wasDerivedFrom" in run("search", iri, "--neighbors")[1]
    assert run("path", iri, "https://example.org/kg/resource/topic/perf")[1].strip()
    assert "Graph digest" in run("digest")[1] and "Retry" in run("preflight", "retry")[1]
    a, b = f"{tmp_path}/a", f"{tmp_path}/b"
    assert run("parts", a)[0] == 0 and run("parts", b)[0] == 0
    assert cli.main(["guard", f"file://{a}", f"file://{b}", "--issue-count", "1"]) == 0
    (tmp_path / "b" / "comment.nt").write_text("")
    assert cli.main(["guard", f"file://{a}", f"file://{b}", "--issue-count", "1"]) == 3


def test_manifest_check(tmp_path, capsys):
    (tmp_path / "m.yml").write_text("code_repo: bad\n")
    assert cli.main(["check", f"{tmp_path}/m.yml"]) == 1 and "owner/name" in capsys.readouterr().out
