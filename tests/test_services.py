"""Calls with retries, the chat client, the association source and presets, against a server in this process."""

import json
import threading
import urllib.error
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest

from loomgraph.operators import strategies
from loomgraph.sources import services


class Handler(BaseHTTPRequestHandler):
    def log_message(self, *args):
        pass

    def _answer(self, status, content=None):
        data = json.dumps(content).encode()
        self.send_response(status)
        self.send_header("Content-Length", str(len(data)))
        self.end_headers()
        if self.command != "HEAD":
            self.wfile.write(data)

    def do_HEAD(self):
        self._answer(200)

    def do_GET(self):
        s = self.server
        s.asked.append(self.path)
        if self.path.startswith("/busy") and len(s.asked) < 3:
            self._answer(503)
        elif self.path.startswith("/gone"):
            self._answer(404)
        elif self.path.startswith("/network"):
            import urllib.parse

            names = urllib.parse.parse_qs(urllib.parse.urlsplit(self.path).query)["identifiers"][0].split(",")
            self._answer(200, [{"a": n, "b": n.lower(), "score": i / 10 if i else None} for i, n in enumerate(names)])
        elif self.path.startswith("/xrefs/"):
            name = self.path.split("/")[2].split("?")[0]
            self._answer(200, [{"type": "transcript", "id": "ENST1"}, {"type": "gene", "id": "LRG"}, {"type": "gene", "id": f"ENSG-{name}"}, {"type": "gene", "id": "ENSG-2"}] if name != "B" else [])
        elif self.path.startswith("/pathways/"):
            self._answer(200, {"pathways": [{"stId": "R-1", "name": "one", "entities": {"fdr": 0.5}}, {"dbId": 7}, {"name": "none"}, {"stId": "R-3"}]})
        elif self.path.startswith("/proteins"):
            self._answer(200, {"results": [{"primaryAccession": "P1"}, {"primaryAccession": "P2"}]} if "gene_exact%3AA+" in self.path else {"results": []})
        else:
            self._answer(200, {"ok": True})

    def do_POST(self):
        s = self.server
        body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
        if self.path == "/graphql":
            rows = [{"drug": {"id": "D1", "name": "d", "maximumClinicalTrialPhase": 4}, "disease": None, "mechanismOfAction": "m"}, {"drug": None, "disease": {"name": "x"}}]
            return self._answer(200, {"data": {"target": {"knownDrugs": {"rows": rows}} if body["variables"]["id"] == "E1" else None}})
        s.asked.append((self.headers.get("Authorization"), body))
        if len(s.asked) == 1:
            self._answer(429)
        elif len(s.asked) == 2:
            self._answer(200, {"choices": [{"message": {"content": "<think>so</think> "}}]})
        else:
            self._answer(200, {"choices": [{"message": {"content": "<think>x</think>" + body["messages"][-1]["content"].upper()}}]})


@pytest.fixture
def server():
    s = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    s.asked = []
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield s
    s.shutdown()


def url(server):
    return f"http://127.0.0.1:{server.server_address[1]}"


def test_retries(server):
    assert services.open_json(url(server) + "/busy", first=0.001) == {"ok": True} and len(server.asked) == 3
    with pytest.raises(urllib.error.HTTPError):
        services.open_json(url(server) + "/gone", first=0.001)
    assert len(server.asked) == 4  # what will not pass is not tried again
    with pytest.raises(urllib.error.URLError):
        services.open_json("http://127.0.0.1:1/", first=0.001, tries=2)
    assert services.head_ok(url(server)) and not services.head_ok("http://127.0.0.1:1/", 1) and services.host_resolves("http://localhost/")
    assert 0.5 <= services.pause(0) <= 0.625 and 20 <= services.pause(99) <= 25


def test_chat(server, monkeypatch):
    monkeypatch.setenv("A_KEY", "secret")
    c = services.client("http", url=url(server), model="m", key_variable="A_KEY", first=0.001)
    assert c.complete("why", "be short") == "WHY"  # after a refusal and an answer without content
    key, body = server.asked[-1]
    assert key == "Bearer secret" and [m["role"] for m in body["messages"]] == ["system", "user"] and "secret" not in repr(vars(c))
    made = []
    local = services.client("local", name="t", load=lambda: made.append(1) or services.client())
    assert local.complete("a") == services.client().complete("a") == local.complete("a") and len(made) == 1
    with pytest.raises(ValueError):
        services.client("none")


def test_chat_on_executors(spark, server):
    server.asked += [1, 1]
    df = spark.createDataFrame([(1, "one"), (2, "two")], "id int, prompt string")
    out = strategies.baseline(df, services.client("http", url=url(server), model="m", first=0.001)).collect()
    assert {r["id"]: r["final"] for r in out} == {1: "ONE", 2: "TWO"}


def test_association_source(spark, server):
    got = services.associations(spark, url(server) + "/network", ["A", "B", "C"], batch="2")
    assert sorted(map(tuple, got.collect()), key=repr) == [("A", "a", None), ("B", "b", 0.1), ("C", "c", None)] and got.rdd.getNumPartitions() == 2
    assert services.associations(spark, url(server) + "/network", []).count() == 0


def test_lookups(spark, server):
    keys = spark.createDataFrame([("A",), (" A ",), ("B",), ("",), (None,)], "gene string")
    rows = lambda lookup, df=keys, key="gene": sorted(map(tuple, services.looked_up(df, key, lookup).collect()), key=repr)
    assert rows(services.GeneIds(url(server) + "/xrefs")) == [("A", "ENSG-A")]
    assert [r for r in rows(services.Pathways(url(server) + "/pathways", 3)) if r[0] == "A"] == [("A", 0, "R-1", "one", 0.5), ("A", 1, "7", "", None)]
    assert rows(services.Accessions(url(server) + "/proteins")) == [("A", "P1")]
    ids = spark.createDataFrame([("E1",), ("E2",)], "gene_id string")
    assert rows(services.Drugs(url(server) + "/graphql"), ids, "gene_id") == [("E1", 0, "D1", "d", 4.0, "m", None), ("E1", 1, None, None, None, None, "x")]


def test_cached_lookup(spark, server):
    asked = spark.createDataFrame([("A",), ("B",), ("C",)], "gene string")
    cache = spark.createDataFrame([("C", "ENSG-old")], "gene string, gene_id string")
    told, fresh = services.cached_lookup(asked, cache, services.GeneIds(url(server) + "/xrefs"), "gene")
    assert {r["gene"]: r["gene_id"] for r in told.collect()} == {"A": "ENSG-A", "B": None, "C": "ENSG-old"} and [tuple(r) for r in fresh.collect()] == [("A", "ENSG-A")]
    assert sum("/xrefs/" in str(p) for p in server.asked) == 2  # once for each key that the cache lacks
    told, fresh = services.cached_lookup(asked, cache, services.GeneIds("http://127.0.0.1:1/"), "gene")
    assert fresh.count() == 0 and {r["gene"]: r["gene_id"] for r in told.collect()} == {"A": None, "B": None, "C": "ENSG-old"}


def test_presets(tmp_path):
    p = tmp_path / "presets.json"
    p.write_text(json.dumps({"small": {"k": 2}, "odd": {"q": 1}}))
    assert services.preset(str(p), "small", {"k": 1, "n": 5}) == {"k": 2, "n": 5}
    with pytest.raises(KeyError):
        services.preset(str(p), "none", {})
    with pytest.raises(ValueError):
        services.preset(str(p), "odd", {"k": 1})
