import json

import pytest

from quire import cli


def test_commands(spark, tmp_path, capsys):
    (tmp_path / "a.md").write_text("# One\n\ntext  \n12\n## Two\nmore\n")
    out = str(tmp_path / "out")
    assert cli.main(["version"]) == 0 and cli.main(["convert", str(tmp_path / "no"), "--out", out], spark) == 2
    assert cli.main(["convert", str(tmp_path / "a.md"), "--out", out, "--toc", "--skip", "code_blocks"], spark) == 0
    row = spark.read.parquet(out).first()
    assert "- [Two](#two)" in row["clean_text"] and "12" not in row["clean_text"] and row["words"] > 3
    with pytest.raises(Exception, match="exist"):
        cli.main(["convert", str(tmp_path / "a.md"), "--out", out], spark)
    (tmp_path / "b.xyz").write_text("?")
    assert cli.main(["batch", str(tmp_path / "b.xyz"), "--out", out, "--force", "--skip", "code_blocks"], spark) == 3
    capsys.readouterr()
    assert cli.main(["toc", str(tmp_path / "a.md")], spark) == 0 and capsys.readouterr().out == "One\n  Two\n"
    assert cli.main(["inspect", str(tmp_path / "a.md")], spark) == 0 and json.loads(capsys.readouterr().out)["pages"] == 1
    assert cli.main(["config"]) == 0 and json.loads(capsys.readouterr().out)["values"]["strict"] is False


def test_paths_and_hooks(tmp_path):
    (tmp_path / "a.md").write_text("")
    assert cli.free_path(tmp_path / "a.md", suffix=True).name == "a-2.md" and cli.free_path(tmp_path / "a.md", force=True).name == "a.md"
    with pytest.raises(FileExistsError):
        cli.free_path(tmp_path / "a.md")
    assert cli.hook("echo hi", {}) == (0, "hi") and cli.hook("/no/such", {})[0] == -1 and cli.hook(None, {}) == (0, "")


def test_chapters_trees_caches_and_hooks(spark, tmp_path, capsys):
    from tests.test_operators import epub

    (tmp_path / "in").mkdir()
    book = tmp_path / "in" / "My Book.epub"
    book.write_bytes(epub())
    out, cache = str(tmp_path / "out"), str(tmp_path / "cache")
    run = lambda *more: cli.main(["convert", str(book), "--out", out, "--force", *more], spark)
    assert run("--chapter", "first", "--tree", "--raw", "--study", "--tag", "x", "--cache", cache, "--registry", str(tmp_path / "registry"), "--post", f"touch {tmp_path}/done") == 0
    assert (tmp_path / "done").exists() and spark.read.parquet(out).first()["text"].startswith("# A")
    text = (tmp_path / "out-tree" / "my-book" / "chapter-first" / "text.md").read_text()
    assert text.startswith('---\ntitle: "A"\nbook: "my-book"\n') and "## Dudas" in text
    assert json.loads((tmp_path / "out-tree" / "my-book" / "chapter-first" / "metadata.json").read_text())["schema_version"] == 2
    assert [(r["title"], r["toc"][1]["title"]) for r in spark.read.parquet(str(tmp_path / "registry" / "v=1")).collect()] == [("my-book", "First")]
    assert spark.read.parquet(f"{cache}/entries").count() == 1
    assert run("--chapter", "first", "--cache", cache) == 0 and "stats" in spark.read.parquet(out).columns and spark.read.parquet(out).first()["stats"] is None
    assert run("--chapter", "nothing") == 4 and run("--pages", "9") == 4 and run("--chapter", "2") == 0
    assert cli.main(["batch", str(book), "--out", out, "--force", "--chapters", "1-3", "--tree"], spark) == 4
    assert {r["path"][-10:]: r["status"][:13] for r in spark.read.parquet(out).collect()} == {"chapter-01": "ok", "chapter-02": "ok", "chapter-03": "out of bounds"}
    assert (tmp_path / "out-tree" / "my-book" / "chapter-02" / "text.md").exists()
    capsys.readouterr()
    assert cli.main(["outline", str(book)], spark) == 0 and "2. First (p. 2)" in capsys.readouterr().out
    (tmp_path / "c.toml").write_text('only = "lists"\n')
    assert cli.main(["config", str(tmp_path / "c.toml")]) == 0 and json.loads(capsys.readouterr().out)["origin"]["only"] == "project"
    assert cli.main(["watch", str(tmp_path / "in"), "--out", str(tmp_path / "w"), "--state", str(tmp_path / "s"), "--settle", "0", "--once"], spark) == 0
    assert spark.read.parquet(str(tmp_path / "w")).count() == 2


def test_standard_input(spark, tmp_path, monkeypatch):
    import io
    import types

    monkeypatch.setattr("sys.stdin", types.SimpleNamespace(buffer=io.BytesIO(b"# T\n\nconti-\nnuation continuation continuation continuation\n")))
    assert cli.main(["convert", "-", "--ext", "md", "--out", str(tmp_path / "o")], spark) == 0
    assert spark.read.parquet(str(tmp_path / "o")).first()["clean_text"].split()[2] == "continuation"
