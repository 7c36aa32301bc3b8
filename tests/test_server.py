import io
import json
import threading
import urllib.request

import pytest

from fernweave.plans.construct import Construct
from fernweave.server import answer, http_server, loaded, serve_lines
from fernweave.sources import ntriples


@pytest.fixture(scope="module")
def own(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("g") / "graph")
    repo = spark.createDataFrame([("o/n", "main", True, "abc", None)], "slug string, history_branch string, is_default_branch boolean, snapshot_ref string, docs_url string")
    log = spark.createDataFrame([("o/n", "s1", "ann", "a@x", "2024-01-01T00:00:00Z", "fix AB-1 retry")], "slug string, sha string, author string, email string, date string, subject string")
    c = Construct()
    ntriples.write_quads(ntriples.empty_graph(spark).added(c.repos(repo), c.commits(log)), path)
    return loaded(spark, path, path + "-none")


def call(own, name, **a):
    return answer(own, {"id": 1, "method": "tools/call", "params": {"name": name, "arguments": a}})


def test_tools(own):
    assert len(answer(own, {"method": "tools/list"})["result"]["tools"]) == 7
    r = call(own, "kg_search", term="o/n")["result"]
    assert r["count"] == 1 and r["results"][0]["type"] == "Repo"
    assert call(own, "kg_semantic_search", query="x")["result"]["error"]
    assert call(own, "kg_hybrid_search", query="o/n")["result"]["degraded"]
    commit, issue = "https://example.org/kg/resource/commit/o%2Fn/s1", "https://example.org/kg/resource/issue/AB-1"
    p = call(own, "kg_path", start=commit, goal=issue)["result"]
    assert p["length"] == 1 and p["path"][0]["predicate"] in ("references", "addressedBy")
    assert call(own, "kg_provenance", iri=commit)["result"]["types"] == ["Commit"]
    assert call(own, "kg_neighbors", iri=issue)["result"]["count"] > 2
    assert call(own, "kg_repo_history", repo="o/n", kind="commit")["result"]["results"][0]["sha"] == "s1"


def test_errors(own):
    assert call(own, "kg_neighbors", iri="x")["error"]["code"] == -32602
    assert call(own, "nothing")["error"]["code"] == -32601


def test_lines_and_http(own):
    out = io.StringIO()
    serve_lines(own, io.StringIO('{"id": 7, "method": "tools/list"}\n\n'), out)
    assert json.loads(out.getvalue())["id"] == 7
    s = http_server(own, 0)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{s.server_address[1]}"
    post = lambda data: json.loads(urllib.request.urlopen(urllib.request.Request(url, data, method="POST"), timeout=60).read())
    assert post(b'{"id": 3, "method": "tools/call", "params": {"name": "kg_search", "arguments": {"term": "o/n"}}}')["result"]["count"] == 1
    with pytest.raises(urllib.error.HTTPError):
        post(b"no")
    s.shutdown()
