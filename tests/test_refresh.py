import hashlib
from pathlib import Path

import pytest

from groundline.streaming.refresh import NO_PAGES, NOT_UTF8, current, manifest, refresh, skipped


def deliver(root, day, files):
    folder = Path(root, "in", day)
    folder.mkdir(parents=True)
    for name, content in files.items():
        Path(folder, name).write_bytes(content if isinstance(content, bytes) else content.encode())


def texts(spark, root):
    return {(r["document"], r["content"]) for r in current(spark, f"{root}/store").parents.select("document", "content").collect()}


def run(spark, root, **more):
    refresh(spark, f"{root}/in", f"{root}/store", f"{root}/progress", **more)


def test_only_changed_files_are_written(spark, tmp_path):
    first = {f"Puerto{i}_memoria_anual_2024.md": f"El muelle {i} movió {i}00 contenedores en el año." for i in range(5)}
    deliver(tmp_path, "d1", first)
    run(spark, tmp_path)
    assert len(texts(spark, tmp_path)) == 5
    before = {p: p.stat().st_mtime_ns for p in Path(tmp_path, "store").rglob("*.parquet")}

    # One file changed, one sent again as it was, one new.
    changed, same = "Puerto3_memoria_anual_2024.md", "Puerto1_memoria_anual_2024.md"
    deliver(tmp_path, "d2", {changed: "El muelle 3 cerró con 777 contenedores.", same: first[same], "Faro_memoria_anual_2024.md": "Nuevo faro 42."})
    run(spark, tmp_path)
    after = {p: p.stat().st_mtime_ns for p in Path(tmp_path, "store").rglob("*.parquet")}
    assert all(after[p] == t for p, t in before.items())
    new = spark.read.parquet(f"{tmp_path}/store/parents/generation=1")
    assert {r["document"] for r in new.collect()} == {changed, "Faro_memoria_anual_2024.md"}

    rows = texts(spark, tmp_path)
    assert len(rows) == 6 and (changed, "El muelle 3 cerró con 777 contenedores.") in rows
    corpus = current(spark, f"{tmp_path}/store")
    assert corpus.number_index.where("number = '777'").count() == 1 and corpus.number_index.where("number = '300'").isEmpty()
    digests = {r["file"]: r["sha256"] for r in manifest(spark, f"{tmp_path}/store").collect()}
    assert digests[changed] == hashlib.sha256("El muelle 3 cerró con 777 contenedores.".encode()).hexdigest()


def test_nothing_new_writes_nothing(spark, tmp_path):
    deliver(tmp_path, "d1", {"a.md": "Texto 10."})
    run(spark, tmp_path)
    run(spark, tmp_path)
    deliver(tmp_path, "d2", {"a.md": "Texto 10."})
    run(spark, tmp_path)
    assert [p.name for p in Path(tmp_path, "store", "parents").iterdir() if p.is_dir()] == ["generation=0"]


def test_unreadable_version_keeps_the_stored_one(spark, tmp_path):
    deliver(tmp_path, "d1", {"a.md": "Texto 10.", "b.md": b"\xff\xfe\xff", "c.md": "  "})
    run(spark, tmp_path)
    deliver(tmp_path, "d2", {"a.md": b"\xff\xff"})
    run(spark, tmp_path)
    assert texts(spark, tmp_path) == {("a.md", "Texto 10.")}
    assert {(r["file"], r["reason"]) for r in skipped(spark, f"{tmp_path}/store").collect()} == {("a.md", NOT_UTF8), ("b.md", NOT_UTF8), ("c.md", NO_PAGES)}


def test_latest_of_a_batch_and_small_batches(spark, tmp_path):
    import os

    deliver(tmp_path, "d1", {"a.md": "Viejo 1.", "b.md": "Otro 5."})
    deliver(tmp_path, "d2", {"a.md": "Nuevo 2."})
    for day, when in (("d1", 1_700_000_000), ("d2", 1_700_000_100)):
        for p in Path(tmp_path, "in", day).iterdir():
            os.utime(p, (when, when))
    run(spark, tmp_path)
    assert texts(spark, tmp_path) == {("a.md", "Nuevo 2."), ("b.md", "Otro 5.")}
    other = tmp_path / "one"
    deliver(other, "d1", {"x.md": "Uno 1.", "y.md": "Dos 2.", "z.md": "Tres 3."})
    run(spark, other, files_per_batch=1)
    assert len(texts(spark, other)) == 3


def test_empty_store(spark, tmp_path):
    with pytest.raises(ValueError):
        current(spark, f"{tmp_path}/none")
    assert manifest(spark, f"{tmp_path}/none").isEmpty() and skipped(spark, f"{tmp_path}/none").isEmpty()
