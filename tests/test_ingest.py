"""Runs over small folders: what changes, what is read and what the store holds."""

import io
import json
import zipfile

import pytest

from lodestar.config import Settings
from lodestar.functions import text
from lodestar.plans.ingest import ingest
from lodestar.plans.question import answer_question
from lodestar.functions.embedding import hashing_encoder
from lodestar.sources import files, readers, snapshots

SMALL = dict(chunk_size=300, chunk_overlap=50, min_chunk_chars=50)


def body(n=4, word="supply"):
    return "\n".join(f"Rule {i}.1 Clause {i}.\n" + f"The {word} shall be metered and billed each month. " * 5 for i in range(1, n + 1))


@pytest.fixture
def place(tmp_path):
    root = tmp_path / "docs"
    root.mkdir()
    for name in ("a.txt", "b.md", "c.txt"):
        (root / name).write_text(body(word=name[0] * 4), encoding="utf-8")
    (root / "~$lock.txt").write_text("x")
    (root / "skip.exe").write_text("x")
    return root, str(tmp_path / "manifest"), str(tmp_path / "store")


def run(spark, place, **kw):
    root, manifest, store = place
    return ingest(spark, Settings(docs_source=(str(root),), **SMALL), manifest, store, **kw)


def test_life_of_a_corpus(spark, place):
    root, manifest, store = place
    dry = run(spark, place, dry_run=True)
    assert dry.changes["NEW"] == 3 and snapshots.version(spark, store) is None
    first = run(spark, place)
    assert first.changes["NEW"] == 3 and first.statuses == {"indexed": 3} and first.scan["lock_files"] == 1
    held = snapshots.current(spark, store)
    ids = {r["chunk_id"] for r in held.collect()}
    assert {r["source"] for r in held.select("source").distinct().collect()} == {"a.txt", "b.md", "c.txt"}
    again = run(spark, place)
    assert again.changes == {"NEW": 0, "MODIFIED": 0, "MOVED": 0, "DELETED": 0, "UNCHANGED": 3}
    assert {r["chunk_id"] for r in snapshots.current(spark, store).collect()} == ids
    (root / "a.txt").rename(root / "moved.txt")
    (root / "c.txt").unlink()
    (root / "b.md").write_text(body(2, "changed"), encoding="utf-8")
    third = run(spark, place)
    assert (third.changes["MOVED"], third.changes["DELETED"], third.changes["MODIFIED"]) == (1, 1, 1)
    after = snapshots.current(spark, store)
    assert {r["source"] for r in after.select("source").distinct().collect()} == {"moved.txt", "b.md"}
    assert {r["chunk_id"] for r in after.where("source = 'moved.txt'").collect()} <= ids
    found = answer_question(after, "changed metered", hashing_encoder()(["changed metered"])[0].tolist(), Settings())
    assert found.mode == "extractive" and found.hits[0].rank == 1 and json.loads(found.as_json())["hits"]


def test_empty_and_unsupported(spark, place):
    root, *_ = place
    (root / "empty.txt").write_text("")
    (root / "scan.pdf").write_bytes(b"%PDF-1.4")
    done = run(spark, place, strict=True)
    assert done.statuses["empty"] == 1 and done.statuses.get("unsupported", 0) + done.statuses.get("error", 0) == 1


def test_readers():
    assert readers.read("x.txt", b"a\r\nb\xff\rc", 9)[0] == [(None, None, "a\nb\nc")]
    pages, supported, note = readers.read("x.csv", "﻿a,b\n,\n c ,\n1,2\n".encode(), 2)
    assert pages == [(None, None, "a | b\nc")] and supported and note == "1 row(s) dropped beyond 2"
    assert readers.read("x.docx", b"no zip", 9)[2].startswith("error: ")
    assert readers.read("x.rtf", b"", 9)[1] is False
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body><w:p><w:r><w:t>One</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>x</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>y</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>')
    assert readers.read("x.docx", out.getvalue(), 9)[0] == [(None, None, "One\nx | y")]


def test_chunks():
    made = text.chunks(body(6), None, 300, 50, 50)
    assert all(len(c) <= 300 + 50 + 1 + 50 for c, _ in made) and made[0][1] == "Rule 1.1 Clause 1."
    assert text.chunks("  \n ", None, 300, 50, 50) == []
    assert text.pieces("a. " * 200, 50)[0] == ("a. " * 17).strip()[:50]
    assert text.blocks("x\nSECTION 1 scope\nmore") == [(None, "x"), ("SECTION 1 scope", "SECTION 1 scope\nmore")]


def test_newer_manifest_is_refused(spark, tmp_path):
    path = tmp_path / "m.json"
    path.write_text(json.dumps({"schema_version": 99, "files": {}}))
    with pytest.raises(files.ManifestVersionError):
        files.manifest_of_json(spark, str(path))
    path.write_text(json.dumps({"b.txt": {"size": 3}, "a.txt": {"size": 4}}))
    assert [r["path"] for r in files.manifest_of_json(spark, str(path)).collect()] == ["a.txt", "b.txt"]
