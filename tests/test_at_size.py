"""Work that must not grow with what repeats: counted on small tables."""

from spanloom.operators import addresses, boxes, fuzzy, graph, jobs, shots
from spanloom.plans.catalog import QUERIES

SF = "/root/testdata/sf0.01"


def test_texts_that_repeat_are_read_once_and_by_many_tasks(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"old almnd Brand#{i % 3 + 11}".lower()) for i in range(300)], "id long, s string").coalesce(1)
    names = spark.createDataFrame([("almond",), ("brand12",)], "name string")
    got = fuzzy.named_in(rows, names, "id", "s")
    assert {(r.id, r.name, r.edits) for r in got.collect()} == {(i, "almond", 1) for i in range(300)} | {(i, "brand12", int(i % 3 != 1)) for i in range(300)}
    plan = QUERIES["platform_names"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan


def test_only_what_hangs_together_takes_part_in_rounds(spark, monkeypatch):
    """Ids of one neighbour stay out of the rounds, and may still name the component."""
    held, real = [], graph.joined_up
    monkeypatch.setattr(graph, "joined_up", lambda edges, rounds: held.append(edges.count()) or real(edges, rounds))
    pairs = [(100 + i, 1000 + 10 * i + j) for i in range(20) for j in range(5)] + [(101, 1000), (103, 7), (1000, 5000), (5000, 104), (9, 9)]
    got = {r.id: r.component for r in graph.connected(spark.createDataFrame(pairs, "a long, b long")).collect()}
    left, want = {x for p in pairs if p[0] != p[1] for x in p}, {}
    while left:
        part, new = set(), {min(left)}
        while new:
            part |= new
            new = {y for p in pairs for x, y in (p, p[::-1]) if x in part} - part
        want |= dict.fromkeys(part, min(part))
        left -= part
    assert got == want and held[0] <= 6


def test_boxes_that_cannot_win_are_not_compared(spark, monkeypatch):
    """One image is decided by its leading boxes, one has no region, in one the best is none of the leading ones."""
    rows = [(1, i, i, 0, i + 10, 10, "x", 0.5, 100, 100, True) for i in range(40)] + [(2, 50, 0, 0, 10, 10, "x", 0.5, 100, 100, False), (2, 51, 0, 0, 10, 10, "x", 0.9, 100, 100, False)]
    rows += [(3, 60 + i, 80, 80, 90, 90, "x", 0.9, 100, 100, True) for i in range(5)] + [(3, 70, 0, 0, 20, 6, "x", 0.1, 100, 100, False)]
    found = spark.createDataFrame(rows, "image int, id int, x1 int, y1 int, x2 int, y2 int, label string, score double, width int, height int, focused boolean")
    regions = spark.createDataFrame([(1, 0, 0, 60, 20), (3, 0, 0, 12, 8)], "image int, x1 int, y1 int, x2 int, y2 int")
    tiled, real = [], jobs._tiled
    monkeypatch.setattr(jobs, "_tiled", lambda df, p, tile: (tiled.append(df.count()) if p == "l_" else None) or real(df, p, tile))
    got = {(r.image, r.id, round(r.overlap, 3)) for r in jobs.grounding_fallback(found, regions, "image", 16, 3).collect()}
    assert got == {(1, 0, 1.0), (2, 51, 0.0), (3, 70, 0.75)}
    assert tiled[1] == 6  # only the third image is compared whole


def test_reads_are_not_shuffled_and_long_keys_meet_on_long_anchors(spark):
    keys = ["examplecom", "exampl", "examplecom" * 3, "examplecom" * 3 + "x", "abcdefghijklmn", "short", "münchen"]
    reads = [(1, ["www.example.com!", None, "x"]), (2, ["example.com" * 3 + "y"]), (3, ["Abc-defghijklmn", "exampl"]), (4, ["none of them"]), (5, None), (6, ["münchen short"])]
    tracks = spark.createDataFrame(reads, "track_id int, texts array<string>")
    out = addresses.remembered_in(tracks, spark.createDataFrame([(k,) for k in keys], "key string"))
    assert {r.track_id: r.remembered for r in out.collect()} == {1: ["exampl", "examplecom"], 2: ["exampl", "examplecom", "examplecom" * 3], 3: ["abcdefghijklmn", "exampl"]}
    assert "hashpartitioning(read" not in out._jdf.queryExecution().executedPlan().toString()
    assert addresses.remembered_in(tracks, spark.createDataFrame([], "key string")).count() == 0


def test_boxes_meet_in_many_tasks_and_in_the_tile_of_what_they_share(spark):
    rows = [(i, i % 2, i * 7 % 40, i * 5 % 30, i * 7 % 40 + 5 + i % 11, i * 5 % 30 + 5 + i % 7) for i in range(150)] + [(900, 0, 3, 3, 3, 9)]
    out = boxes.overlapping(spark.createDataFrame(rows, "id int, kind int, x1 int, y1 int, x2 int, y2 int"), ["kind"], 0.3, 8)

    def share(a, b):
        common = max(0, min(a[4], b[4]) - max(a[2], b[2])) * max(0, min(a[5], b[5]) - max(a[3], b[3]))
        return common / max(1, (a[4] - a[2]) * (a[5] - a[3]) + (b[4] - b[2]) * (b[5] - b[3]) - common)

    got = [(r.l_id, r.r_id) for r in out.collect()]
    want = {(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and a[1] == b[1] and share(a, b) >= 0.3}
    assert len(got) == len(set(got)) and set(got) == want and want
    assert "REPARTITION_BY_NUM" in out._jdf.queryExecution().executedPlan().toString()


def test_all_pairs_of_a_kind_are_made_in_cells(spark):
    """One kind has nearly all rows; each pair comes once, and no task is given a kind whole."""
    rows = [(i, int(i % 50 == 0), i * 7 % 40) for i in range(300)]
    out = boxes.paired(spark.createDataFrame(rows, "id int, kind int, x int"), "kind", 3)
    got = [tuple(r) for r in out.select("l_id", "r_id", "l_kind", "r_kind", "l_x", "r_x").collect()]
    assert sorted(got) == sorted((a[0], b[0], a[1], b[1], a[2], b[2]) for a in rows for b in rows if a[0] < b[0] and a[1] == b[1])
    plan = QUERIES["box_relations"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan and "Broadcast" not in plan


def test_blocks_of_pairs_are_bounded_and_odd_ids_are_paired(spark, monkeypatch):
    """Ids lie unevenly, repeat or are missing; a key gets as many blocks as its rows need."""
    monkeypatch.setattr(boxes, "BLOCK", 20)
    monkeypatch.setattr(boxes, "STRIP", 8)
    rows = [(i**3 - 9000, 0, i * 7 % 13) for i in range(200)] + [(5, 1, i) for i in range(3)] + [(6, 1, 0), (None, 1, 1), (8, None, 2), (9, None, 3), (1, 2, 1)]
    out = boxes.paired(spark.createDataFrame(rows, "id long, kind int, x int"), "kind", 2, (["x"], ["x"]))
    got = [tuple(r) for r in out.select("l_id", "r_id", "l_kind", "r_kind", "l_x", "r_x").collect()]
    known = [r for r in rows if None not in r]
    assert sorted(got) == sorted((a[0], b[0], a[1], b[1], a[2], b[2]) for a in known for b in known if a[0] < b[0] and a[1] == b[1])
    assert out.schema["l_id"].dataType.simpleString() == "bigint" and boxes.paired(spark.createDataFrame([], "id long, kind int, x int"), "kind").count() == 0
    seen, real = [], boxes.dealt
    monkeypatch.setattr(boxes, "dealt", lambda rows, *by: seen.append(rows) or real(rows, *by))
    boxes.paired(spark.createDataFrame(rows, "id long, kind int, x int"), "kind", 2)
    cells = [len(r.l_rows) for r in seen[0].collect()]
    assert 0 < max(cells) <= 2 * boxes.BLOCK


def test_pairs_are_written_in_few_bytes(spark, tmp_path):
    """The result is the square of its input, so what a written row takes decides whether it fits the disk."""
    spark.range(1200).selectExpr("id AS p_partkey", "7 AS p_size").write.parquet(f"{tmp_path}/part.parquet")
    QUERIES["box_relations"](spark, str(tmp_path)).write.parquet(f"{tmp_path}/out")
    assert spark.read.parquet(f"{tmp_path}/out").count() == 1200 * 1199 // 2
    assert sum(f.stat().st_size for f in (tmp_path / "out").glob("*.parquet")) < 3.3 * 1200 * 1199 / 2


def test_edges_that_are_settled_are_not_copied_to_buckets(spark, monkeypatch):
    """Of three intervals two edges are at the limits and three have no seeds nearby; one looks for a cut."""
    spans = spark.createDataFrame([("a", 1, 0.0, 10.0, 900.0), ("a", 2, 100.0, 110.0, 900.0), ("a", 3, 500.0, 900.0, 900.0)], "k string, interval_id int, start double, end double, duration double")
    samples = spark.createDataFrame([("a", 100.0 + i / 2, 1.0) for i in range(5)], "k string, t double, score double")
    cuts = spark.createDataFrame([("a", 96.0), ("a", 104.0)], "k string, t double")
    bounded, real = [], shots.counted_in
    monkeypatch.setattr(shots, "counted_in", lambda windows, *rest: bounded.append(windows.where("low is not null")) or real(windows, *rest))
    got = {r.interval_id: tuple(r)[1:] for r in shots.shot_context(spans, samples, cuts, "k", 0.9, 0.5, 1.0, seeds=5).collect()}
    assert got[1] == (0.0, 10.0, "at_video_start", "too_few_seeds_nearby") and got[3] == (500.0, 900.0, "too_few_seeds_nearby", "at_video_end")
    assert got[2][0] == 96.0 and got[2][2] == "extended"
    assert [w.count() for w in bounded][0] == 4 and bounded[1].where("interval_id <> 2").count() == 0
