"""Settings, prompts, scenario files, connectors (against a server of this process), the command line's evaluation."""

import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest

from engram.evals import suite
from engram.functions.prompts import Prompt
from engram.settings import Settings
from engram.sources import connectors


def test_settings(monkeypatch):
    assert Settings().rrf_k == 60
    monkeypatch.setenv("ENGRAM_RRF_K", "7")
    monkeypatch.setenv("ENGRAM_ADD_MIN", "0.5")
    assert (Settings.from_environment().rrf_k, Settings.from_environment().add_min) == (7, 0.5)


def test_prompts(tmp_path):
    file = tmp_path / "extract.txt"
    file.write_text("--- system ---\nBe {{how}}.\n--- user ---\n{{text}} {{text}}\n")
    prompt = Prompt.read(file)
    assert prompt.fill(how="brief", text="x") == ("Be brief.", "x x") and prompt.ref.startswith("extract@") and len(prompt.ref) == 20
    with pytest.raises(KeyError):
        prompt.fill(how="brief")
    file.write_text("nothing")
    with pytest.raises(ValueError, match="system and a user"):
        Prompt.read(file)


def test_yaml_scenarios(tmp_path):
    (tmp_path / "b.yaml").write_text("turns:\n- {at: 2026-01-01, text: Ich mag Tee.}\ncheckpoints:\n- {after: 1, query: 'Was?', expect_present: [Tee], expect_absent: [Rum]}\nerasure: {after: 1, residue: [Tee]}\n")
    (tmp_path / "a.yaml").write_text("id: first\nturns: []\n")
    found = suite.load(tmp_path)
    assert [s["id"] for s in found] == ["first", "b"] and [s["id"] for s in suite.load(tmp_path, "fir")] == ["first"]
    assert [(k, o) for _, k, _, o in suite.probes_of(found[1])] == [("update_recall", "pass"), ("stale", "unsupported"), ("erasure", "pass")]


@pytest.mark.parametrize(("url", "fine"), [("https://x.org", True), ("http://127.0.0.1:1", True), ("http://localhost", True), ("http://10.0.0.1", False), ("http://x.org", False), ("ftp://localhost", False)])
def test_transport_guard(url, fine):
    if fine:
        assert connectors.guard(url) == url
    else:
        with pytest.raises(ValueError, match="plain text"):
            connectors.guard(url)


@pytest.fixture
def server():
    seen = []

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            seen.append(body)
            if "dimensions" in body:
                return self.send_error(400)
            if len(seen) == 1:
                return self.send_error(503)
            if "messages" in body and body["messages"][1]["content"] == "bad":
                return self.send_error(401)
            answer = {"choices": [{"message": {"content": body["messages"][1]["content"].upper()}}]} if "messages" in body else {"data": [{"index": k, "embedding": [3.0, 4.0]} for k in range(len(body["input"]))]}
            self.send_response(200)
            self.end_headers()
            self.wfile.write(json.dumps(answer).encode())
            return None

        def log_message(self, *args):
            pass

    http = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=http.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{http.server_port}"
    http.shutdown()


def test_connectors(spark, server):
    asked = spark.createDataFrame([(1, "s", "hi"), (2, "s", "bad")], "id long, system string, user string").coalesce(1)
    got = {r.id: r for r in connectors.complete(asked, server, "m", wait=0.01).collect()}
    assert got[1].answer == "HI" and got[1].error is None and got[2].answer is None and "401" in got[2].error
    texts = spark.createDataFrame([(1, "a"), (2, None)], "id long, text string").coalesce(1)
    vectors = connectors.embed(texts, server, "m", 2, wait=0.01).collect()
    assert [[round(x, 6) for x in r.embedding] for r in vectors] == [[0.6, 0.8]] * 2
