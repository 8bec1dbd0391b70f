"""Folders loaded again from a snapshot against a full load."""
from quillon.engine import Engine
from quillon.sources import snapshots


def put(folder, name, words, described="d"):
    folder.mkdir(parents=True, exist_ok=True)
    (folder / "SKILL.md").write_text(f"---\nname: {name}\ndescription: {described}\nmetadata:\n  domain: x\n  triggers: a, b\n---\n# {name}\n{words}\n")


def rows_of(engine):
    return sorted(tuple(r) for r in engine.skills.select("name", "description", "content").collect())


def test_reload_reads_only_what_changed(spark, tmp_path, monkeypatch):
    a, b = tmp_path / "one", tmp_path / "two"
    for i in range(6):
        put(a / f"sp ace {i}" if i % 2 else a / f"k{{{i}}}*", f"n{i}", f"text é {i}", "from a")
    put(b / "k0", "n0", "other", "from b")
    put(b / "k9", "n9", "nine", "from b")
    monkeypatch.setattr(snapshots, "FILES_AT_ONCE", 2)
    folders = [str(a), str(b)]
    engine = Engine.from_folders(spark, *folders, snapshot=f"file://{tmp_path}/snapshot")
    assert engine.loaded == {"listed": 8, "read": 8, "added": 8, "changed": 0, "same": 0, "removed": 0}
    full = lambda *f: rows_of(Engine.from_folders(spark, *f))
    assert rows_of(engine) == full(*folders) and len(rows_of(engine)) == 7
    assert engine.reload().loaded == {"listed": 8, "read": 0, "added": 0, "changed": 0, "same": 0, "removed": 0}

    put(a / "sp ace 1", "n1", "edited, and longer", "from a")  # one edited, one added, one removed, one whose name changes
    put(a / "new", "n7", "seven", "from a")
    (a / "sp ace 3" / "SKILL.md").unlink()
    put(b / "k9", "n2", "takes another's name", "from b")
    assert engine.reload().loaded == {"listed": 8, "read": 3, "added": 1, "changed": 2, "same": 0, "removed": 1}
    assert rows_of(engine) == full(*folders)

    turned = Engine.from_folders(spark, *reversed(folders), snapshot=f"file://{tmp_path}/snapshot")
    assert turned.loaded["read"] == 0 and rows_of(turned) == full(*reversed(folders)) != rows_of(engine)
    turned.snapshot.compact()
    turned.snapshot.vacuum()
    put(a / "sp ace 3", "n3", "back again", "from a")
    assert engine.reload().loaded["added"] == 1 and rows_of(engine) == full(*folders)
    only = Engine.from_folders(spark, folders[1], snapshot=f"file://{tmp_path}/snapshot")
    assert only.loaded["removed"] == 0 and rows_of(only) == full(folders[1])
