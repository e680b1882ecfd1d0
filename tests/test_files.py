"""The listing of a workspace against os.walk."""

import os

import pytest

from corvane.config import Config
from corvane.sources import files


def walked(root, dirs):
    out = []
    for top in dirs:
        for folder, below, names in os.walk(os.path.join(root, top)):
            below[:] = [d for d in below if not d.startswith(".")]
            out += [os.path.relpath(os.path.join(folder, n), root) for n in names if not n.startswith(".") and os.path.isfile(os.path.join(folder, n))]
    return sorted(out)


@pytest.fixture
def tree(tmp_path):
    for a in range(4):
        for b in range(3):
            at = tmp_path / f"src/a{a}/b{b}/c/d/e/f"
            at.mkdir(parents=True)
            (at / f"deep{b}.ts").write_text("x")
            (tmp_path / f"src/a{a}/b{b}/_x.md").write_text("x")
        (tmp_path / f"src/a{a}/.hidden").mkdir()
        (tmp_path / f"src/a{a}/.hidden/no.ts").write_text("x")
    (tmp_path / "src/top.ts").write_text("x")
    (tmp_path / "src/.dot").write_text("x")
    (tmp_path / "src/linked").symlink_to(tmp_path / "src/a0", target_is_directory=True)
    (tmp_path / "src/link.ts").symlink_to(tmp_path / "src/top.ts")
    (tmp_path / "src/broken.ts").symlink_to(tmp_path / "nowhere")
    (tmp_path / "docs").mkdir()
    return tmp_path


@pytest.mark.parametrize("parts", [1, 3, 10, 1000])
def test_a_listing_has_what_a_walk_has(spark, tree, parts):
    spark.dataSource.register(files.WorkspaceFiles)
    for dirs in (["src", "docs", "missing"], ["src", "src/a1"], [""]):
        want = walked(str(tree), dirs)
        for root in (str(tree), f"file://{tree}"):
            got = spark.read.format("workspace_files").option("path", root).option("dirs", str(dirs).replace("'", '"')).option("parts", parts).load()
            found = sorted(r["file_path"].removeprefix("./") for r in got.collect())
            if root.startswith("file:"):  # Arrow follows links to folders, and names them as files where they are
                found, near = [p for p in found if "linked" not in p], [p for p in want if "linked" not in p]
                assert found == near
            else:
                assert found == want


def test_the_driver_lists_few_folders(tree, monkeypatch):
    seen = []
    real = files._look

    def counted(root):
        look = real(root)
        return lambda folder: (seen.append(folder), look(folder))[1]

    monkeypatch.setattr(files, "_look", counted)
    parts = files._Listing(str(tree), ["src"], 4).partitions()
    assert seen == ["src"] and {p.folder for p in parts if not p.flat} == {f"src/a{k}" for k in range(4)}
    found = sorted(p for part in parts for batch in files._Listing(str(tree), [], 0).read(part) for p in batch.column("file_path").to_pylist())
    assert found == walked(str(tree), ["src"])


def test_times_are_told_in_milliseconds(spark, tree):
    os.utime(tree / "src/top.ts", ns=(0, 1_700_000_000_123_999_999))
    rows = {r["file_path"]: r for r in files.walk_files(spark, Config(workspace_root=str(tree))).collect()}
    assert rows["src/top.ts"]["last_modified"] == "2023-11-14T22:13:20.123Z" and rows["src/top.ts"]["module"] == "src" and rows["src/top.ts"]["language"] == "typescript"
