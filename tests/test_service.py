import json

import numpy as np
import pytest

from notequarry import __main__ as cli
from notequarry import plugins
from notequarry.plans import service
from notequarry.plans.knowledge import KnowledgeBase


@pytest.fixture(scope="module")
def root(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("service") / "kb")
    assert cli.run(spark, ["--root", at, "seed"]) == ""
    return at


def asked(kb, root, method, **params):
    return service.answer(kb, json.dumps({"jsonrpc": "2.0", "id": 1, "method": method, "params": params}), root)["result"]


def test_commands(spark, root):
    def run(*words, form="json"):
        return cli.run(spark, ["--root", root, "--format", form, *words])

    assert json.loads(run("stats"))[0]["nodes"] == 44
    assert run("search", "Lathe", "-k", "2", "--depth", "0", form="table").splitlines()[0].split() == ["score", "type", "label", "content"]
    assert run("path", "Lathe", "Oak").startswith("Lathe -> ") and run("path", "Lathe", "Oak", "--max-depth", "1") in ("Lathe -> Oak", "no path")
    assert all(r["type"] == "note" for r in json.loads(run("fts", "Oak", "--notes-only")))
    assert len(json.loads(run("similar", "--label", "Note 3", "-k", "2"))) == 2
    assert "answer" in json.loads(run("ask", "What is a lathe?"))
    assert json.loads(run("graph", "Lathe", "--depth", "1"))
    with pytest.raises(SystemExit):
        run("similar")
    with pytest.raises(ValueError):
        run("graph", "Nobody")
    found = json.loads(run("detect", "--resolution", "0.3"))
    assert found and KnowledgeBase.open(spark, root).communities.count() == len(found)


def test_build_and_reset(spark, tmp_path):
    (tmp_path / "vault").mkdir()
    (tmp_path / "vault" / "a.md").write_text("---\ntitle: A\n---\n# A\n\n" + "Words about something. " * 5)
    at = ["--root", str(tmp_path / "kb")]
    assert json.loads(cli.run(spark, [*at, "build", str(tmp_path / "vault")]))["files"] == 1
    assert json.loads(cli.run(spark, [*at, "build", str(tmp_path / "vault")]))["files"] == 0
    cli.run(spark, [*at, "reset"])
    assert json.loads(cli.run(spark, [*at, "stats"]))[0]["nodes"] == 0


def test_schemas_and_uris(spark, root, monkeypatch):
    kb = KnowledgeBase.open(spark, root)
    schemas = {x["name"]: x["inputSchema"] for x in asked(kb, root, "tools/list")["tools"]}
    assert schemas["search"]["required"] == ["query"] and schemas["search"]["properties"]["filters"] == {"type": "array", "items": {"type": "string"}}
    assert schemas["search"]["properties"]["alpha"] == {"type": "number"} and {"build", "seed", "community_detect", "community_summarize"} <= set(schemas)
    assert "build" not in service.tools(kb)
    assert asked(kb, root, "resources/templates/list")["resourceTemplates"][0]["uriTemplate"].endswith("communities/{id}")
    uris = [x["uri"] for x in asked(kb, root, "resources/list")["resources"]]
    assert "notequarry://nodes" in uris
    monkeypatch.setattr(service, "PAGE", 30)
    first = asked(kb, root, "resources/read", uri="notequarry://nodes")
    rest = asked(kb, root, "resources/read", uri="notequarry://nodes", cursor=str(first[-1]["id"]))
    assert len(first) == 30 and sorted({r["id"] for r in first + rest}) == list(range(1, 45))
    asked(kb, root, "tools/call", name="community_detect", arguments={"resolution": 0.3})
    one = KnowledgeBase.open(spark, root).communities.first()["id"]
    assert [r["id"] for r in asked(kb, root, "resources/read", uri=f"notequarry://communities/{one}")] == [one]


def test_embedders_are_checked():
    class Short(plugins.HashingEmbedder):
        def embed(self, texts):
            return np.zeros((len(texts), 3))

    class Silent(plugins.HashingEmbedder):
        def embed(self, texts):
            raise OSError("refused")

    assert plugins.checked(plugins.HashingEmbedder()) is None
    assert "not a vector of 256" in plugins.checked(Short()) and "refused" in plugins.checked(Silent())
