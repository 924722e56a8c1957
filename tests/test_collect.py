"""Continuation lines over pieces of a file, and the collection of a growing folder over restarts."""

import random
from datetime import datetime

from tidemark.operators import carry
from tidemark.operators.combine import line_times
from tidemark.streaming import collect

LINE = "site_id string, env string, container_id string, log_type string, raw_file_id string, raw_line_no long, raw string"


def php(k):
    return f"[05-Jan-2024 {k // 3600:02d}:{k // 60 % 60:02d}:{k % 60:02d} UTC] PHP Warning: w{k}"


def some_lines(r, n=400):
    out = []
    for file, share in (("a", 0.05), ("b", 0.5), ("c", 0.0)):
        for k in range(n):
            raw = php(k) if r.random() < share else r.choice(["#0 trace", "  at x()", "", "Stack"]) + f" {k}" * (k % 3)
            out.append(("s", None if file == "b" else "live", "c", "php-error", file, k, raw))
    out += [("s", "live", "c", "nginx-access", "acc", k, '1.2.3.4 - - [05/Jan/2024:00:00:07 +0000] "GET / HTTP/1.1" 200 1' if k % 2 else "no time") for k in range(20)]
    return out + [("s", "live", "c", "php-error", None, 1, "no file"), ("s", "live", "c", "php-error", None, 2, php(9))]


def times(df):
    return sorted((tuple(r) for r in df.select(*carry.FILE, "raw_line_no", "raw", "ts").collect()), key=repr)


def test_pieces_give_what_the_whole_gives(spark):
    r = random.Random(5)
    lines = some_lines(r)
    want = times(line_times(spark.createDataFrame(lines, LINE)))
    for span in (1, 7, 1 << 20):
        last, got = spark.createDataFrame([], carry.LAST), []
        for low, high in ((0, 3), (3, 150), (150, 151), (151, 400)):
            piece = spark.createDataFrame([x for x in lines if low <= x[5] < high], LINE)
            got += times(carry.carried_times(piece, last, span))
            last = spark.createDataFrame(carry.last_times(piece, last, span).collect(), carry.LAST)
        assert sorted(got, key=repr) == want


def test_empty_tables_and_other_columns(spark):
    none, start = spark.createDataFrame([], LINE), spark.createDataFrame([], carry.LAST)
    assert carry.carried_times(none, start).count() == carry.last_times(none, start).count() == 0
    old = spark.createDataFrame([("s", "e", "c", "php-error", "f", 9, datetime(2024, 1, 5))], carry.LAST)
    assert carry.last_times(none, old).collect() == old.collect()
    piece = spark.createDataFrame([("s", "e", "c", "php-error", "f", 10, "trace", 1, 2)] * 2, LINE + ", last_ts long, b long")
    got = carry.carried_times(piece, old).collect()
    assert [(x.ts, x.last_ts, x.b) for x in got] == [(datetime(2024, 1, 5), 1, 2)] * 2


def test_a_new_file_under_an_old_name_takes_nothing_over(spark):
    old = spark.createDataFrame([("s", "e", "c", "php-error", "f", 900, datetime(2024, 1, 5))], carry.LAST)
    piece = spark.createDataFrame([("s", "e", "c", "php-error", "f", k, "trace" if k < 40 else php(60)) for k in (0, 20, 40, 2000)], LINE)
    assert [r.ts and str(r.ts) for r in carry.carried_times(piece, old, 16).orderBy("raw_line_no").collect()] == [None, None, *["2024-01-05 00:01:00"] * 2]
    assert carry.last_times(piece, old, 16).first().last_place == 2000


def test_old_files_are_forgotten(spark):
    rows = [("s", "e", "c", "php-error", str(day), 1, datetime(2024, 1, day)) for day in (1, 20, 30)]
    kept = carry.last_times(spark.createDataFrame([], LINE), spark.createDataFrame(rows, carry.LAST), keep_days=10)
    assert sorted(r.raw_file_id for r in kept.collect()) == ["20", "30"]


def test_folder_in_three_pieces(spark, tmp_path):
    folder, root = tmp_path / "logs" / "site" / "live" / "c1", str(tmp_path / "out")
    folder.mkdir(parents=True)
    access = '1.2.3.4 - - [05/Jan/2024:00:00:0{} +0000] "GET /p{} HTTP/1.1" 200 1 "-" "curl/8"\n'
    php_lines = ["orphan", php(1), "#0 first", "#1 second", php(2), "#0 third", "#0 fourth", php(3), "end"]
    pieces = [php_lines[:3], php_lines[3:6], php_lines[6:]]
    run = lambda: collect.collect(spark, str(tmp_path / "logs"), root, ("rollup_1m",), split_bytes=32, span=16).awaitTermination(200)
    for k, piece in enumerate(pieces):
        with open(folder / "php-error.log", "a") as f:
            f.write("\n".join(piece) + "\n")
        with open(folder / "nginx-access.log", "a") as f:
            f.write(access.format(k, k))
        run()  # each run is a restart
    run()
    read = lambda: sorted((r.message, r.ts.second) for r in spark.read.parquet(f"{root}/log_events").collect())
    want = sorted([("PHP Warning: w1", 1), ("#0 first", 1), ("#1 second", 1), ("PHP Warning: w2", 2), ("#0 third", 2), ("#0 fourth", 2), ("PHP Warning: w3", 3), ("end", 3)])
    assert read() == want
    assert [r.raw for r in spark.read.parquet(f"{root}/quarantine").collect()] == ["orphan"]
    assert spark.read.parquet(f"{root}/access_events").count() == spark.read.parquet(f"{root}/rollup_1m").selectExpr("sum(requests)").first()[0] == 3
    state = sorted(p.name for p in (tmp_path / "out" / "_last_times").iterdir())
    assert state == ["1", "2"]
    last = spark.read.parquet(f"{root}/_lines/2")
    collect.keep_logs(last.where("log_type = 'php-error'"), 2, root, 16)  # the last batch once more, as after a failure
    assert read() == want
