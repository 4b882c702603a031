"""Engines, models and the OCR pass, with fakes for whatever is outside."""

import dataclasses
import io
import json
import sys
import urllib.error

import pytest
from pyspark import cloudpickle

from lodestar.config import Settings
from lodestar.functions.embedding import hashing_encoder
from lodestar.operators import dedup
from lodestar.plans import recognise
from lodestar.plans.question import Answer, answer_question
from lodestar.sources import engines, files, readers, snapshots

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers can't import this file


class Reply(io.BytesIO):
    def __enter__(self):
        return self

    def __exit__(self, *_):
        return False


@pytest.fixture
def net(monkeypatch):
    """Requests that were made; what they get back is in ``net.body``."""

    class Net(list):
        body = b"{}"

    seen = Net()

    def urlopen(request, timeout):
        seen.append((request.full_url, dict(request.header_items()), json.loads(request.data), timeout))
        if isinstance(seen.body, Exception):
            raise seen.body
        return Reply(seen.body)

    monkeypatch.setattr(engines.urllib.request, "urlopen", urlopen)
    return seen


def test_chat_model(net):
    net.body = json.dumps({"message": {"content": "Answer [1]"}}).encode()
    model, doubt = engines.select_model({"llm_backend": "ollama", "llm_ollama_timeout": 9})
    assert doubt is None and model.available() and model.complete("SYS", "USER") == "Answer [1]"
    url, _, body, timeout = net[0]
    assert url == "http://localhost:11434/api/chat" and timeout == 9 and body["stream"] is False
    assert [m["content"] for m in body["messages"]] == ["SYS", "USER"]


def test_messages_model(net, monkeypatch):
    net.body = json.dumps({"content": [{"text": "Answer "}, {"text": "[2]"}]}).encode()
    own = {"llm_hosted_url": "https://models.example/v1/messages", "llm_hosted_model": "m", "llm_hosted_api_key_env": "A_KEY", "llm_hosted_header_x_version": "7"}
    model, _ = engines.select_model(own | {"llm_backend": "hosted"})
    monkeypatch.delenv("A_KEY", raising=False)
    assert not model.available()
    monkeypatch.setenv("A_KEY", "secret")
    assert model.available() and model.complete("SYS", "USER") == "Answer [2]"
    url, headers, body, _ = net[0]
    assert headers["X-api-key"] == "secret" and headers["X-version"] == "7" and body["system"] == "SYS" and body["max_tokens"] == 1024


def test_backends():
    assert engines.select_model({}) == (None, None) == engines.select_model({"llm_backend": "ollama"}, "none")
    model, doubt = engines.select_model({"llm_backend": "olama"})
    assert isinstance(model, engines.ChatModel) and "olama" in doubt


@pytest.mark.parametrize("fault, said", [(urllib.error.HTTPError("u", 401, "no", {}, io.BytesIO(b"denied")), "401"), (urllib.error.URLError("down"), "cannot reach"), (b"not json", "malformed JSON")])
def test_faults_are_service_errors(net, fault, said):
    net.body = fault
    with pytest.raises(engines.ServiceError, match=said):
        engines.post_json("http://x", {}, {}, 1)


def test_replies_of_other_shapes():
    assert [engines.reply_text(x) for x in ({"response": "a"}, {}, "nope", {"content": "plain"}, {"message": {"content": None}})] == ["a", "", "", "plain", ""]


@dataclasses.dataclass
class Model:
    says: object
    name: str = "fake"
    there: bool = True

    def available(self):
        return self.there

    def complete(self, system, prompt):
        self.prompt = prompt
        if isinstance(self.says, Exception):
            raise self.says
        return self.says


@pytest.fixture(scope="module")
def chunks(spark):
    vector = hashing_encoder()(["the fees are due in march", "unrelated words"])
    rows = [(f"c{i}", t, "a.pdf", i + 1, None, "pdf", v.tolist()) for i, (t, v) in enumerate(zip(["the fees are due in march", "unrelated words"], vector, strict=True))]
    return spark.createDataFrame(rows, "chunk_id string, text string, source string, page int, section string, file_type string, embedding array<float>")


def test_answers(chunks):
    probe = hashing_encoder()(["the fees are due"])[0].tolist()
    ask = lambda model: answer_question(chunks, "fees?", probe, Settings(), model)
    model = Model("March [1] or [9].")
    found = ask(model)
    assert (found.mode, found.cited, found.error) == ("llm", [1], None) and any("[9]" in w for w in found.warnings)
    assert "[1] a.pdf, p.1" in model.prompt and "fees?" in model.prompt and "[cited]" in found.as_text(True) and "        the fees" in found.as_text(True)
    for model, said in ((Model(engines.ServiceError("exploded")), "exploded"), (Model(" "), "empty"), (Model("x", there=False), "not configured")):
        found = ask(model)
        assert found.mode == "extractive" and found.answer.startswith("[1] a.pdf, p.1") and any(said in w for w in found.warnings)
    found = ask(None)
    assert (found.mode, found.error, found.exit_code) == ("extractive", None, 0)
    nothing = answer_question(chunks, "  ", probe, Settings())
    assert (nothing.mode, nothing.exit_code) == ("none", 2) and "Nothing" in nothing.as_text()
    assert json.loads(Answer("q", "", "none").as_json())["hits"] == []


# -- OCR


@dataclasses.dataclass
class Engine:
    """Reads a page's picture, which is its text; some pictures are a fault, some are hard."""

    name: str
    hard: str = ""

    def ocr_image(self, image):
        text = image.decode()
        if "broken" in text:
            raise TimeoutError("no answer")
        return text[:4] if self.hard and self.hard in text else text


class Renderer:
    """A file's lines are its pages; an empty line can't be rendered, and one that begins with an X can't be opened."""

    def open(self, content):
        if content.startswith(b"X"):
            raise ValueError("encrypted")
        return content.split(b"\n")

    def render(self, opened, number):
        return opened[number - 1] or None


@pytest.fixture
def scans(spark, tmp_path):
    bodies = {"a.pdf": b"first page of a, quite long\nhard second page, read by the other engine\n \nbroken", "b.pdf": b"X", "c.pdf": b"one\n\nthree", "d.pdf": b"text"}
    (tmp_path / "docs").mkdir()
    for name, body in bodies.items():
        (tmp_path / "docs" / name).write_bytes(body)
    entries = spark.createDataFrame([(n, str(tmp_path / "docs"), f"h{n}") for n in bodies], "path string, root string, content_hash string")
    rows = [(n, i, i + 1, None, "x" * 80 if n == "d.pdf" else "", True, None) for n, b in bodies.items() for i in range(b.count(b"\n") + 1)]
    return entries, spark.createDataFrame(rows, readers.PAGES), str(tmp_path / "cache")


def pass_of(spark, scans, **kw):
    entries, pages, cache = scans
    how = recognise.Recognition([Engine("local", hard="hard"), Engine("api")], Renderer(), dataclasses.replace(Settings(), ocr_escalate_below_chars=10, ocr_max_pages_per_file=kw.pop("cap", 500)), cache=cache, **kw)
    texts, per = recognise.filled(spark, entries, pages, how)
    return how, {(r["path"], r["page"]): r["text"] for r in texts.collect()}, {r["path"]: r for r in per.collect()}


def test_ocr_pass(spark, scans):
    how, texts, per = pass_of(spark, scans)
    assert texts["a.pdf", 1].startswith("first page") and texts["a.pdf", 2].startswith("hard second") and texts["a.pdf", 3] == "" and texts["c.pdf", 3] == "three" and texts["d.pdf", 1] == "x" * 80
    assert set(per) == {"a.pdf", "b.pdf", "c.pdf"}
    assert (per["a.pdf"]["errors"], per["a.pdf"]["ocr_pages"], per["a.pdf"]["fatal"]) == (1, 2, None) and "still without text" in per["a.pdf"]["ocr_note"]
    assert "encrypted" in per["b.pdf"]["fatal"] and "could not be rendered" in per["c.pdf"]["ocr_note"]
    c = how.counters
    assert (c["pages_ocred"], c["pages_attempted"], c["failures"], c["render_errors"], c["deferred"], c["cache_hits"]) == (4, 6, 1, 2, 0, 0)
    assert c["escalations"] == c["api_pages"] == 5 and c["engine_calls"] == 11 and c["est_cost"] == 0.0005
    again, texts, per = pass_of(spark, scans)
    assert again.counters["cache_hits"] == 5 and again.counters["pages_attempted"] == 1 and texts["c.pdf", 3] == "three"
    assert snapshots.current(spark, scans[2]).count() == 5


def test_ocr_limits(spark, scans):
    how, _, per = pass_of(spark, scans, limit=2)
    assert how.counters["deferred"] == 6 and per["a.pdf"]["incomplete"] and per["a.pdf"]["ocr_pages"] == 2
    how, _, per = pass_of(spark, scans, cap=1)
    assert per["a.pdf"]["incomplete"] and "beyond the cap" in per["a.pdf"]["ocr_note"] and recognise.report(how, True)[0].startswith("OCR read")
    assert recognise.report(None, True) and recognise.report(None, False) == []


def test_a_changed_file_loses_its_cache(spark):
    old = spark.createDataFrame([("a", "h1", "f", 1, "x"), ("b", "h", "f", 1, "y")], recognise.CACHE)
    fresh = spark.createDataFrame([("a", "h2", "f", 2, "z")], recognise.CACHE)
    assert sorted(tuple(r) for r in recognise.merged_cache(old, fresh).collect()) == [("a", "h2", "f", 2, "z"), ("b", "h", "f", 1, "y")]


# -- listing and signatures


def test_listing_sees_every_file_once(spark, tmp_path):
    for name, body in {"a b+c%20[1].txt": "x", "empty.txt": "", "ü.md": "yy", "sub/z.md": "zzz"}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(body)
    found, missing = files.listing(spark, [str(tmp_path), str(tmp_path / "none")])
    assert {(r["path"], r["size"]) for r in found.collect()} == {("a b+c%20[1].txt", 1), ("empty.txt", 0), ("ü.md", 2), ("sub/z.md", 3)} and len(missing) == 1
    gone = found.unionByName(found.where("path = 'ü.md'").withColumns({c: files.F.concat(c, files.F.lit(".gone")) for c in ("path", "uri")}))
    hashes = {r["path"]: r["content_hash"] for r in files.hashed(spark, gone).collect()}
    assert len(hashes) == 5 and hashes["ü.md.gone"] is None and sum(h is not None for h in hashes.values()) == 4


def test_signatures_by_type(spark):
    sizes = spark.createDataFrame([(p, 5) for p in ("a.pdf", "b.pdf", "c.txt", "d.TXT", "e.xlsx", "f.pdf")], "path string, size long")
    rows = [("a.pdf", 0, "one"), ("a.pdf", 1, "two"), ("b.pdf", 0, "one"), ("b.pdf", 1, "two"), ("c.txt", 0, "same"), ("d.TXT", 0, "same"), ("e.xlsx", 0, "same"), ("f.pdf", 0, "same")]
    got = {r["path"]: r["signature"] for r in dedup.file_signatures(sizes, spark.createDataFrame(rows, "path string, page_idx int, text string"), 300).collect()}
    assert got["a.pdf"] == got["b.pdf"] and got["c.txt"] == got["d.TXT"] and len(set(got.values())) == 4
