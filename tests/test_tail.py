"""The tail source: a folder that grows in steps equals one read of it, over restarts, half lines and rotation."""

import os
import random

from tidemark.sources import tail


def run(spark, folder, root, split=64):
    """One run to the end of what is there; a new run starts from the checkpoint."""
    stream = spark.readStream.format("tail").option("path", folder).option("splitBytes", str(split)).load()
    stream.writeStream.format("parquet").option("checkpointLocation", f"{root}/check").option("path", f"{root}/out").trigger(availableNow=True).start().awaitTermination(120)
    return sorted((os.path.basename(r.file), r.start_byte, r.raw) for r in spark.read.parquet(f"{root}/out").collect())


def test_splits_cover_each_line_once(tmp_path):
    r, path = random.Random(1), str(tmp_path / "f")
    lines = ["x" * r.choice([0, 1, 5, 40, 200]) + str(k) for k in range(300)]
    with open(path, "w") as f:
        f.write("\n".join(lines) + "\nhalf a line")
    size = tail.whole_bytes(path)
    for most in (1, 7, 64, 10**6):
        for low in (0, len(lines[0]) + 1):
            got = [line.decode() for s in tail.splits(path, low, size, most) for _, line in tail.lines_of(s)]
            assert got == (lines if low == 0 else lines[1:])


def test_growing_folder(spark, tmp_path):
    tail.register(spark)
    folder, root = tmp_path / "logs" / "site", str(tmp_path)
    folder.mkdir(parents=True)
    (folder / "a.log").write_text("one\ntwo\nthr")
    (folder / "b.log").write_text("b one\n")
    top = str(tmp_path / "logs")
    want = [("a.log", 0, "one"), ("a.log", 4, "two"), ("b.log", 0, "b one")]
    assert run(spark, top, root) == want
    with open(folder / "a.log", "a") as f:
        f.write("ee\r\n\nfo\xfcr \U0001f600\n" + "".join(f"line {k}\n" for k in range(50)))
    (folder / "c.log").write_text("no end yet")
    want += [("a.log", 8, "three"), ("a.log", 15, ""), ("a.log", 16, "fo\xfcr \U0001f600")]
    at = 16 + len("fo\xfcr \U0001f600\n".encode())
    for k in range(50):
        want.append(("a.log", at, f"line {k}"))
        at += len(f"line {k}\n")
    assert run(spark, top, root) == sorted(want)
    assert run(spark, top, root) == sorted(want)  # a restart repeats nothing
    os.replace(folder / "a.log", tmp_path / "gone")  # rotated: another file under the same name, longer than what was read
    (folder / "a.log").write_text("".join(f"new {k}\n" for k in range(120)))
    (folder / "b.log").write_text("b 1\n")  # cut short and written anew
    (folder / "c.log").write_text("no end yet, now it has\n")
    starts = [sum(len(f"new {j}\n") for j in range(k)) for k in range(120)]
    want += [("a.log", s, f"new {k}") for k, s in enumerate(starts)] + [("b.log", 0, "b 1"), ("c.log", 0, "no end yet, now it has")]
    assert run(spark, top, root) == sorted(want)
