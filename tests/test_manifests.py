"""Folders kept alike: missing, changed and surplus files, and copies that break off."""

import os

import pytest

from threadloom.sources import manifests as M


def put(root, files):
    for name, text in files.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(text)


def held(root):
    found = {}
    for folder, _, names in os.walk(root):
        rel = os.path.relpath(folder, root)
        if not rel.startswith(("_", ".")) or rel == ".":
            found |= {os.path.normpath(f"{rel}/{n}"): open(os.path.join(folder, n), "rb").read() for n in names if not n.startswith((".", "_"))}
    return found


def states(df):
    return {r.path: r.state for r in df.collect()}


FILES = {"a.csv": b"one", "deep/er/b c.bin": bytes(range(256)), "deep/é.txt": b"e", "z.csv": b"last"}


def test_two_steps(spark, tmp_path):
    source, target = tmp_path / "in", tmp_path / "out"
    put(source, FILES)
    put(target, {"other.txt": b"keep", "a.csv": b"old"})
    first = M.sync(spark, str(source), str(target))
    assert states(first) == {"a.csv": "changed", "deep/er/b c.bin": "missing", "deep/é.txt": "missing", "z.csv": "missing", "other.txt": "surplus"}
    assert held(target) == FILES | {"other.txt": b"keep"}
    # the same length and another content, one more, one gone
    put(source, {"a.csv": b"two", "new/n": b"n"})
    os.utime(source / "a.csv", (2_000_000_000, 2_000_000_000))
    (source / "z.csv").unlink()
    second = M.sync(spark, str(source), str(target))
    assert states(second) == {"a.csv": "changed", "new/n": "missing", "deep/er/b c.bin": "same", "deep/é.txt": "same", "z.csv": "surplus", "other.txt": "surplus"}
    third = M.sync(spark, str(source), str(target), drop_surplus=True)
    assert set(states(third).values()) == {"same", "surplus"}
    assert held(target) == held(source)
    assert M.read_manifest(spark, str(target)).count() == len(held(source))
    assert set(states(M.sync(spark, str(source), str(target))).values()) == {"same"}


def test_known_files_are_not_read_again(spark, tmp_path, monkeypatch):
    source, target = tmp_path / "in", tmp_path / "out"
    put(source, FILES)
    M.sync(spark, str(source), str(target))
    read = []
    contents = M._contents
    monkeypatch.setattr(M, "_contents", lambda s, paths: read.append(len(paths)) or contents(s, paths))
    M.sync(spark, str(source), str(target))
    assert read == [0, 0, 0]
    # what changed in the target without the manifest's knowledge is found, too
    put(target, {"z.csv": b"evil"})
    os.utime(target / "z.csv", (1_900_000_000, 1_900_000_000))
    assert states(M.sync(spark, str(source), str(target)))["z.csv"] == "changed"
    assert held(target) == FILES


def test_a_copy_that_breaks_off(spark, tmp_path, monkeypatch):
    source, target = tmp_path / "in", tmp_path / "out"
    put(source, FILES)
    put(target, {"a.csv": b"old"})
    put_one = M._put

    def broken(root):
        def run(rows):
            def some():
                for row in rows:
                    if row.path in ("a.csv", "z.csv"):
                        yield type(row)(**{**row.asDict(), "content": row.content[:1]})
                    else:
                        yield row

            put_one(root)(some())

        return run

    monkeypatch.setattr(M, "_put", broken)
    with pytest.raises(Exception, match="changed while it was copied"):
        M.sync(spark, str(source), str(target))
    # nothing half: the old file or none, and no manifest
    left = held(target)
    assert left["a.csv"] == b"old" and "z.csv" not in left
    assert all(FILES[n] == t for n, t in left.items() if n != "a.csv") and M._versions(spark, str(target)) == []
    monkeypatch.setattr(M, "_put", put_one)
    M.sync(spark, str(source), str(target))
    assert held(target) == FILES and M._versions(spark, str(target)) == [1]
    # a manifest that was not finished does not count
    os.remove(target / "_manifest/v1/_SUCCESS")
    assert set(states(M.sync(spark, str(source), str(target))).values()) == {"same"}


def test_empty_and_missing_folders(spark, tmp_path):
    (tmp_path / "in").mkdir()
    assert M.sync(spark, str(tmp_path / "in"), str(tmp_path / "out")).count() == 0
    assert M.sync(spark, str(tmp_path / "none"), str(tmp_path / "out")).count() == 0
