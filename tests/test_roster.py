"""Text cleanup, sources, pool, locks, optimiser, serving and refresh."""

import itertools
import json
import os
import random
import time
from datetime import date, datetime

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from rosterlake import queries as registered
from rosterlake.functions import text, times
from rosterlake.operators import locks, pool, stats
from rosterlake.operators.locks import Request
from rosterlake.plans import incremental, lineups, solver
from rosterlake.schema import ADVANCED, LIMITS, POOL, POSITIONS, PROJECTIONS, RED_ZONE, SALARY, SNAPS, STATS, leader_columns
from rosterlake.sources import landed, pages, snapshots
from rosterlake.streaming import refresh


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


@pytest.mark.parametrize(
    "raw, position, clean",
    [
        ("Kenneth Walker III", "RB", "Kenneth Walker"), ("Patrick Mahomes II", "QB", "Patrick Mahomes"), ("Michael Pittman Jr.", "WR", "Michael Pittman"), ("Ja'Marr Chase", "WR", "JaMarr Chase"),
        ("A.J. Brown", "WR", "AJ Brown"), ("Amon-Ra St. Brown", "WR", "Amon-Ra St Brown"), ("Bucky Irving", "RB", "Buckyrving"), ("Mark Ingram II", "RB", "Markngram"), ("Foo IV", "WR", "FooV"), ("Buffalo Bills", "DST", "Bills"), (None, "QB", None),
    ],
)
def test_names(spark, raw, position, clean):
    assert value(spark, text.clean_player(F.lit(raw).cast("string"), F.lit(position))) == clean


def test_names_corrected(spark):
    assert value(spark, text.player_name(F.lit("Bucky Irving"), compat=False)) == "Bucky Irving"
    assert value(spark, text.player_name(F.lit("Mark Ingram II"), compat=False)) == "Mark Ingram"


@pytest.mark.parametrize(
    "column, expected",
    [
        (lambda: text.percent(F.lit("57%")), 57.0), (lambda: text.percent(F.lit(""), True), 0.0), (lambda: text.percent(F.lit("")), None), (lambda: text.money(F.lit("$8,600  ")), 8600), (lambda: text.opponent(F.lit("@KC")), "KC"),
        (lambda: text.points_cell(F.lit("BYE")), 0.0), (lambda: text.points_cell(F.lit("-")), 0.0), (lambda: text.points_cell(F.lit(None).cast("string")), 0.0), (lambda: text.points_cell(F.lit("12.3")), 12.3),
        (lambda: text.round1(F.lit(0.25)), 0.2), (lambda: text.round1(F.lit(0.35)), 0.4), (lambda: text.per_game(F.lit(7.0), F.lit(0.0)), None), (lambda: text.per_game(F.lit(7.0), F.lit(4.0)), 1.8),
        (lambda: text.before_paren(F.lit("A B (KC)")), "A B"), (lambda: text.before_paren(F.lit("A B (KC)"), False), "A B "), (lambda: text.without_last_token(F.lit("A B KC")), "A B"), (lambda: text.last_token(F.lit(" X  Y ")), "Y"),
        (lambda: text.page_path(F.lit("RB")), "ppr-rb.php"), (lambda: text.page_path(F.lit("DST")), "dst.php"), (lambda: text.week_of_file(F.lit("a/x_2025_w12.csv")), 12), (lambda: text.year_of_file(F.lit("a/x_2025_w12.csv")), 2025),
        (lambda: text.not_in(F.lit(None).cast("string"), ["a"]), True), (lambda: text.not_in(F.lit("a"), []), True), (lambda: text.not_in(F.lit("a"), ["a"]), False),
        (lambda: times.season_year(F.lit(date(2026, 1, 5))), 2025), (lambda: times.season_year(F.lit(date(2026, 3, 1))), 2026),
        (lambda: times.next_tuesday_noon(F.lit(datetime(2025, 9, 2, 11, 0))), datetime(2025, 9, 2, 12)), (lambda: times.next_tuesday_noon(F.lit(datetime(2025, 9, 2, 12, 0))), datetime(2025, 9, 9, 12)), (lambda: times.next_tuesday_noon(F.lit(datetime(2025, 9, 3))), datetime(2025, 9, 9, 12)),
    ],
)
def test_scalars(spark, column, expected):
    assert value(spark, column()) == expected


def test_schedule(spark):
    assert times.schedule_table(spark).count() == 34
    at = [datetime(2025, 9, 2, 13, 30), datetime(2025, 9, 2, 14, 0), datetime(2025, 9, 4, 0, 30), datetime(2025, 9, 5, 15, 0), datetime(2025, 12, 2, 14, 59)]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(at)], "id int, at timestamp")
    local = {(r.id, r.job) for r in times.due(rows, "at").collect()}
    assert local == {(0, "projections"), (1, "projections"), (4, "projections")}
    # Nine o'clock in New York is 13 UTC in summer and 14 in winter.
    assert {(r.id, r.job) for r in times.due(rows, "at", times.ZONE).collect()} == {(0, "salaries"), (1, "projections"), (2, "projections"), (4, "salaries")}


def test_salary_files_with_padding_and_crlf(spark, tmp_path):
    (tmp_path / "s_2024_w1.csv").write_bytes(b"player,position,team,opponent,salary\r\nA B,QB,KC,BUF,8900    \r\nNA,RB,KC,BUF,4000\r\n")
    rows = snapshots.read_salaries(spark, str(tmp_path / "*.csv")).orderBy("salary").collect()
    assert [(r.player, r.salary, r.file_year, r.file_week) for r in rows] == [("NA", 4000, 2024, 1), ("A B", 8900, 2024, 1)]
    assert snapshots.read_snapshots(spark, str(tmp_path / "*.csv"), SALARY, na_words=True).where("player is null").count() == 1


def test_latest_week(spark):
    files = spark.createDataFrame([("x_2024_w17.csv", 5), ("x_2025_w2.csv", 5), ("x_2025_w10.csv", 4), ("notes.csv", 9)], "path string, modified long")
    assert tuple(snapshots.latest_week(files).first()) == (2025, 2)
    assert tuple(snapshots.latest_week(files, policy="name").first()) == (2025, 10)
    assert tuple(snapshots.latest_week(files, 2023).first()) == (2023, 1)


def test_rankings_page(spark):
    good = {"player_name": "A", "player_position_id": "QB", "rank_ecr": 1, "rank_min": "1", "rank_max": 3, "rank_ave": "1.5", "rank_std": 0.5, "start_sit_grade": "A+", "r2p_pts": "20.1"}
    players = [good, {**good, "player_name": "B", "start_sit_grade": None}, {k: v for k, v in good.items() if k != "r2p_pts"} | {"player_name": "C"}, {**good, "player_name": "D", "r2p_pts": None}, {k: v for k, v in good.items() if k != "start_sit_grade"}, {**good, "rank_ecr": "x"}]
    html = f"<html><script type='text/javascript'>var other = 1;</script><script type=\"text/javascript\">\n var ecrData = {json.dumps({'players': players})};\nvar y = 2;</script></html>"
    frame = spark.createDataFrame([("QB", 2025, 5, html), ("RB", 2025, 5, "<html></html>"), ("WR", 2025, 5, None)], "position string, year int, week int, html string")
    rows = pages.weekly_rankings(frame).orderBy("place").collect()
    assert [(r.player, r.grade, r.proj_fpts, r.rank) for r in rows] == [("A", "A+", 20.1, 1), ("B", "None", 20.1, 1), ("C", "A+", 0.0, 1)]


def test_rankings_keep_numbers_apart(spark):
    """1.5 counts as 1, "1.5" can't be taken; every rejected row has its reason, and the counters agree."""
    good = {"player_name": "A", "player_position_id": "QB", "rank_ecr": 1, "rank_min": "1", "rank_max": 3, "rank_ave": "1.5", "rank_std": 0.5, "start_sit_grade": "A+", "r2p_pts": "20.1"}
    changes = [{}, {"rank_ecr": 1.5}, {"rank_ecr": "1.5"}, {"rank_ecr": None}, {"rank_ave": "x"}, {"r2p_pts": None}, {"player_name": None, "start_sit_grade": 5}, {"rank_min": " 2 "}]
    players = [{**good, **c} for c in changes] + [{k: v for k, v in good.items() if k != "rank_std"}]
    html = f'<script type="text/javascript">var ecrData = {json.dumps({"players": players})};</script>'
    frame = spark.createDataFrame([("QB", 2025, 5, html), ("RB", 2025, 5, "<html></html>"), ("WR", 2025, 5, html.replace("A+", "A+\\")), ("TE", 2025, 5, html.replace(json.dumps(players), "[]"))], "position string, year int, week int, html string")
    found = pages.checked_rankings(frame)
    assert sorted((r.place, r.player, r.grade, r.rank, r.min_rank) for r in found.rows.collect()) == [(0, "A", "A+", 1, 1), (1, "A", "A+", 1, 1), (6, "None", "5", 1, 1), (7, "A", "A+", 1, 2)]
    reasons = {(r.page_position, r.place): r.reason for r in found.rejected.collect()}
    assert reasons == {
        ("QB", 2): "rank_ecr is no number", ("QB", 3): "rank_ecr is null", ("QB", 4): "rank_ave is no number", ("QB", 5): "r2p_pts is null", ("QB", 8): "rank_std is absent",
        ("RB", None): "the page has no players", ("WR", None): "the page has no players", ("TE", None): "the page's players are none",
    }
    assert (found.counts["rows"], found.counts["sound"], found.counts["rejected"]) == (12, 4, 8)
    assert {r.reason: r.n for r in found.by_reason().collect()}["the page has no players"] == 2
    assert sorted(map(tuple, pages.weekly_rankings(frame).collect()), key=str) == sorted(map(tuple, found.rows.collect()), key=str)


def test_rejected_table_rows(spark):
    columns = PROJECTIONS["TE"]
    rows = [["A KC", "1", "2", "3", "", "1,004.5"], ["B KC", "1", "x", "3", "4", "5"], ["", "1", "2", "3", "4", "5"], ["C KC", "1"]]
    frame = pages.table_rows(spark.createDataFrame([(2025, page(columns, rows, lead=False))], "year int, html string"), skip_columns=0)
    found = stats.checked_cells(frame, columns)
    assert {r.row_idx: r.reason for r in found.rejected.collect()} == {1: "proj_rec_yds is no number", 2: "player is empty", 3: "the row has too few cells"}
    assert [(r.player, r.proj_fpts) for r in stats.weekly_projections(found.rows, "TE", 3).collect()] == [("A", 1004.5)] and found.counts["rejected"] == 3
    html = page(["x"] * 6, [["head"] * 6, ["A", "x", "QB", "KC", "@BUF", "$8,600"], ["B", "x", "QB", "KC", "@BUF", "soon"], ["C", "x", "QB"]], "prj-main-table", lead=False)
    money = pages.checked_salaries(spark.createDataFrame([(2025, 5, "Sat-Sun", html)], "year int, week int, slate string, html string"))
    assert [(r.player, r.salary) for r in money.rows.collect()] == [("A", 8600)]
    assert {r.player: r.reason for r in money.rejected.collect()} == {"B": "salary is no amount", "C": "the row has too few cells"}


def test_tables_of_many_pages(spark):
    """More pages than are parsed at once, with nulls and pages without a table between them."""
    sizes = [i % 5 for i in range(300)]
    rows = [(i, None if i % 50 == 49 else page(["player", "x"], [[f"p{i}.{j}", ""] for j in range(n)]) if i % 7 else "<p>none</p>", [i]) for i, n in enumerate(sizes)]
    got = pages.table_rows(spark.createDataFrame(rows, "id int, html string, more array<int>").repartition(2)).collect()
    want = [(i, [i], j, [f"p{i}.{j}", None]) for i, n in enumerate(sizes) if i % 7 and i % 50 != 49 for j in range(n)]
    assert sorted((r.id, r.more, r.row_idx, r.cells) for r in got) == want


def page(columns, rows, table_id="data", lead=True):
    head = "<thead><tr><th>#</th>" + "<th>x</th>" * len(columns) + "</tr></thead>"
    body = "".join("<tr>" + ("<td>1</td>" if lead else "") + "".join(f"<td>{c}</td>" for c in r) + "</tr>" for r in rows)
    return f"<table id='no'><tr><td>z</td></tr></table><table id='{table_id}'>{head}<tbody>{body}</tbody></table>"


def cells(spark, columns, row, lead=True):
    frame = spark.createDataFrame([(2025, page(columns, [row], lead=lead))], "year int, html string")
    return pages.table_rows(frame, skip_columns=1 if lead else 0)


def sample(columns, player="A B (KC)"):
    return [player if c == "player" else "KC" if c == "team" else "4" if c == "games" else f"{i}%" if "perc" in c or c == "rost" else f"1,{i:03d}" for i, c in enumerate(columns)]


@pytest.mark.parametrize("position", POSITIONS)
def test_stats_pages(spark, position):
    got = stats.stats(cells(spark, STATS[position], sample(STATS[position])), position, (1, 4)).first().asDict()
    assert got["player"] == "A B" and got["week"] == 5 and got["season"] == 2025 and got["position"] == position and "fpts" not in got
    assert got["rost"] == len(STATS[position]) - 1
    first = STATS[position][1]
    assert got[f"avg_{first}"] == pytest.approx(round(1001 / 4, 1), abs=0.06) and "avg_avg_fpts" not in got
    week = stats.weekly_stats(cells(spark, STATS[position], sample(STATS[position])), position, 3).first().asDict()
    assert week["player"] == "A B " and week[first] == 1001.0 and "games" not in week
    proj = stats.weekly_projections(cells(spark, PROJECTIONS[position], sample(PROJECTIONS[position], "A B KC"), lead=False), position, 3).first()
    assert proj.player == ("A B KC" if position == "DST" else "A B") and proj.week == 3


@pytest.mark.parametrize("position", POSITIONS[:4])
def test_other_pages(spark, position):
    got = stats.advanced(cells(spark, ADVANCED[position], sample(ADVANCED[position])), position, (1, 4)).first().asDict()
    assert got["week"] == 5 and all(("avg_" in c) == stats.advanced_prefix(c).startswith("avg_") or True for c in got)
    assert {"QB": "avg_cmp", "RB": "avg_rush"}.get(position, "avg_rec") in got
    if position in ("WR", "TE"):
        assert isinstance(got["tgt_perc"], float) and "rec_lng" in got
    assert "games" not in stats.weekly_advanced(cells(spark, ADVANCED[position], sample(ADVANCED[position])), position, 2).columns
    rz = stats.red_zone(cells(spark, RED_ZONE[position], sample(RED_ZONE[position])), position, (1, 4)).first().asDict()
    assert isinstance(rz["rz_rush_perc"], float) and "rz_fpts/game" not in rz and "avg_rz_fpts" in rz
    assert "rz_fpts" in stats.weekly_red_zone(cells(spark, RED_ZONE[position], sample(RED_ZONE[position])), position, 2).columns
    snap = stats.snaps(cells(spark, SNAPS, sample(SNAPS), lead=False), position, (1, 4)).first().asDict()
    assert snap["avg_fpts"] == pytest.approx(1010 / 4, abs=0.06) and "snaps" not in snap
    assert "snaps/game" not in stats.weekly_snaps(cells(spark, SNAPS, sample(SNAPS), lead=False), position, 2).columns


def test_leaders_page_and_current_week(spark):
    long, short = leader_columns(18), leader_columns(17)
    frame = spark.createDataFrame([(2025, ["A", "QB", "KC", *["BYE"] * 18, "1", "2"]), (2020, ["B", "QB", "KC", *["7.5"] * 17, "1", "2"])], "year int, cells array<string>")
    assert sorted((r.player, r.fpts) for r in stats.weekly_points(frame, 17).collect()) == [("A", 0.0), ("B", 7.5)]
    assert len(long) == 23 and len(short) == 22
    weeks = spark.createDataFrame([(1.0, None, None), (None, None, None)], "`1` double, `2` double, `3` double")
    assert stats.current_week(weeks, ["1", "2", "3"]).first().week == 2
    assert stats.current_week(weeks.fillna(0), ["1", "2", "3"]).first().week == 1


def test_salary_page_and_slates(spark):
    rows = [["Name", "x", "Pos", "Team", "Opp", "Sal", "m"], ["A", "x", "QB", "KC", "@BUF", "$8,600", "m"]]
    html = page(rows[0], rows, "prj-main-table", lead=False)
    frame = spark.createDataFrame([(2025, 5, "Fri-Mon", html), (2025, 5, "Thu-Mon", page(rows[0], rows[:1], "prj-main-table", lead=False))], "year int, week int, slate string, html string")
    got = pages.first_slate(pages.salary_page(frame), ("Thu-Mon", "Fri-Mon")).collect()
    assert [(r.player, r.opponent, r.salary, r.slate) for r in got] == [("A", "BUF", 8600, "Fri-Mon")]


def test_page_urls_agree(spark):
    """The reader's addresses are those of the column, in both spans."""
    rows = [(k, p, 2025, 7) for k in ("rankings", "stats", "snap", "advanced") for p in POSITIONS]
    frame = spark.createDataFrame(rows, "kind string, position string, year int, week int")
    for span in landed.SPANS:
        got = {(r.kind, r.position): r.url for r in pages.page_urls(frame, "http://h/", single_week=span == "week").collect()}
        assert got == {(k, p): landed.page_url("http://h", k, p, y, w, span) for k, p, y, w in rows}


def test_pages_are_pruned(spark, tmp_path):
    folder = str(tmp_path / "pages")
    rows = [(k, p, 2025, w, "range", f"<table id='data'><tr><td>{k} é</td></tr>\n<tr><td>{p}{w}</td></tr></table>") for k in ("stats", "snap") for p in ("QB", "RB") for w in (3, 4, 5)]
    landed.land_pages(spark.createDataFrame(rows, "kind string, position string, year int, week int, span string, html string"), folder)
    found = landed.read_pages(spark, folder)
    chosen = found.where("kind = 'stats' and week in (4, 5) and position = 'RB' and length(html) > 3")
    assert (found.rdd.getNumPartitions(), chosen.rdd.getNumPartitions()) == (12, 2)
    assert sorted((r.week, r.html.strip()) for r in chosen.collect()) == [(w, next(x[5] for x in rows if x[:4] == ("stats", "RB", 2025, w))) for w in (4, 5)]
    assert found.where("kind = 'snap' and kind = 'stats'").count() == 0
    reader = landed.PageReader({"path": folder})
    from pyspark.sql.datasource import EqualTo, GreaterThan, In

    kept = list(reader.pushFilters([EqualTo(("kind",), "snap"), In(("week",), (3, 4)), In(("week",), (4, 9)), GreaterThan(("year",), 2000), EqualTo(("html",), "x")]))
    assert [type(f).__name__ for f in kept] == ["GreaterThan", "EqualTo"]
    assert [(p.kind, p.position, p.week) for p in reader.partitions()] == [("snap", "QB", 4), ("snap", "RB", 4)]


def test_pages_from_a_server(spark):
    """Fetched by address, single weeks and ranges."""
    import http.server
    import threading

    class Answer(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            self.send_response(200)
            self.send_header("Content-Type", "text/html; charset=utf-8")
            self.end_headers()
            self.wfile.write(f"<p>{self.path}</p>".encode())

        def log_message(self, *_):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Answer)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        landed.register(spark)
        options = {"base": f"http://127.0.0.1:{server.server_port}", "kinds": "stats,snap,rankings", "positions": "WR,QB", "years": "2025", "weeks": "6,7", "spans": "week,range"}
        rows = spark.read.format("rosterlake_pages").options(**options).load().where("week = 7").collect()
    finally:
        server.shutdown()
    assert len(rows) == 12 and all(r.html == f"<p>{r.url.removeprefix(options['base'])}</p>" for r in rows)
    assert {r.html for r in rows if (r.kind, r.position) == ("stats", "WR")} == {"<p>/stats/wr.php?year=2025&range=week&week=7&scoring=PPR</p>", "<p>/stats/wr.php?year=2025&range=custom&start_week=3&end_week=6&scoring=PPR</p>"}


def test_pool_build(spark):
    rankings = spark.createDataFrame([("QB", "Al Bo II", "QB", 2025, 5, 1, "A", 20.0), ("QB", "Cy", "QB", 2025, 5, 2, "F", 9.0), ("DST", "Buffalo Bills", "DST", 2025, 5, 1, None, 8.0), ("RB", "No Pay", "RB", 2025, 5, 1, "A", 8.0)], "page_position string, player string, position string, year int, week int, rank int, grade string, proj_fpts double").withColumns({"file_year": F.lit(2025), "file_week": F.lit(5)})
    averages = spark.createDataFrame([("QB", "Al Bo II", 18.5), ("RB", "Al Bo II", 1.0)], "position string, player string, avg_fpts double")
    salaries = spark.createDataFrame([("Al Bo", "QB", "KC", "BUF", 7000), ("Bills", "DST", "BUF", "KC", 3000)], SALARY).withColumns({"file_year": F.lit(2025), "file_week": F.lit(5)})
    got = {r.player: (r.avg_fpts, r.grade, r.salary) for r in pool.build_pool(rankings, averages, salaries).collect()}
    assert got == {"Al Bo": (18.5, "A", 7000), "Bills": (0.0, "0", 3000)}


def week(seed, n=(4, 5, 6, 4, 3), cap=50_000):
    source, rows = random.Random(seed), []
    for p, k in zip(POSITIONS, n):
        for i in range(k):
            rows.append((2025, 1, f"{p}{i}", p, "T", "O", "A", i + 1, float(source.randint(0, 150)) / 10, float(source.randint(30, 250)) / 10, source.randrange(3000, 9000, 100)))
    return rows


def pool_frame(spark, rows, slate="s"):
    return spark.createDataFrame(rows, POOL).withColumn("slate", F.lit(slate))


def brute(rows, weights=(1.0, 0.0), one_te=False, cap=50_000, total=9, need=None, skip=()):
    need = need or LIMITS
    score = lambda r: r[9] if weights[1] == 0 else round(r[9] * weights[0] + r[8] * weights[1], 1)
    by = {p: [r for r in rows if r[3] == p and r[2] not in skip] for p in POSITIONS}
    flex, best = total - sum(need.values()), None
    for x, y in itertools.product(range(flex + 1), repeat=2):
        z = flex - x - y
        if z < 0 or (one_te and z):
            continue
        counts = {**need, "RB": need["RB"] + x, "WR": need["WR"] + y, "TE": need["TE"] + z}
        for sets in itertools.product(*[list(itertools.combinations(by[p], counts[p])) for p in POSITIONS]):
            chosen = [r for s in sets for r in s]
            if sum(r[10] for r in chosen) <= cap:
                points = round(sum(score(r) for r in chosen), 6)
                best = points if best is None else max(best, points)
    return best


@pytest.mark.parametrize("seed", [1, 2])
def test_solver_is_exact(spark, seed):
    rows = week(seed, (3, 4, 5, 3, 2))
    requests = [Request(), Request("one", one_te=True)]
    got = {(r.request, r.variant): (r.status, r.free_points) for r in lineups.summaries(pool_frame(spark, rows), requests).collect()}
    for i, w in enumerate(((1.0, 0.0), (0.9, 0.1), (0.8, 0.2))):
        for name, one in (("default", False), ("one", True)):
            expected = brute(rows, w, one)
            assert got[(name, i + 1)] == (("OPTIMAL", pytest.approx(expected, abs=0.11)) if expected else ("INFEASIBLE", None))
    rows_out = lineups.optimal_lineups(pool_frame(spark, rows), requests).collect()
    for key in {(r.request, r.variant) for r in rows_out if r.status == "OPTIMAL"}:
        own = [r for r in rows_out if (r.request, r.variant) == key]
        assert len(own) == 9 and sum(r.salary for r in own) <= 50_000 and sum(r.position == "QB" for r in own) == 1
        assert sum(r.proj_fpts for r in own) == pytest.approx(got[key][1])


def best_by_table(rows, comps):
    """The same optimum, KEY and points only, by a dynamic programme over (counts, salary) in one task per key.

    A cross-check of solve()."""
    def run(left, right):
        empty = pd.DataFrame({"slate": [], "request": [], "variant": [], "points": []})
        if not len(right):
            return empty
        cap = int(right["cap"].iloc[0])
        best = None
        size = cap + 1
        tables = {}
        for p in POSITIONS:
            own = left[left["position"] == p]
            top = int(right[f"n_{p.lower()}"].max())
            table = np.full((top + 1, size), np.iinfo(np.int64).min // 4)
            table[0, 0] = 0
            for s, x in zip(own["salary"].to_numpy(int), own["points"].to_numpy(np.int64)):
                if s <= cap:
                    for k in range(top, 0, -1):
                        table[k, s:] = np.maximum(table[k, s:], table[k - 1, : size - s] + x)
            tables[p] = table
        for _, c in right.iterrows():
            state = np.array([[0, 0]])
            for p in POSITIONS:
                row = tables[p][int(c[f"n_{p.lower()}"])]
                at = np.flatnonzero(row > np.iinfo(np.int64).min // 8)
                pairs = np.stack([(state[:, :1] + at[None]).ravel(), (state[:, 1:] + row[at][None]).ravel()], axis=1)
                pairs = pairs[pairs[:, 0] <= cap]
                pairs = pairs[np.lexsort((-pairs[:, 1], pairs[:, 0]))]
                top_so_far = np.maximum.accumulate(pairs[:, 1]) if len(pairs) else pairs[:, 1]
                keep = np.ones(len(pairs), bool)
                keep[1:] = pairs[1:, 1] > top_so_far[:-1]
                state = pairs[keep]
            if len(state):
                best = int(state[:, 1].max()) if best is None else max(best, int(state[:, 1].max()))
        if best is None:
            return empty
        return pd.DataFrame({**{k: [right[k].iloc[0]] for k in locks.KEY}, "points": [best]})

    return rows.groupBy(*locks.KEY).cogroup(comps.groupBy(*locks.KEY)).applyInPandas(run, "slate string, request string, variant int, points long")


def test_table_solver_agrees(spark):
    frame = pool_frame(spark, week(5))
    rows, left, best = lineups.solved(frame, [Request()])
    free = rows.select(*locks.KEY, "position", "idx", "salary", solver.micro(F.col("proj_fpts")).alias("points"))
    table = best_by_table(free, locks.compositions(left))
    assert {(r.variant, r.points) for r in table.collect()} == {(r.variant, r.points) for r in best.collect()}


def rosters_by_hand(rows, counts, cap):
    """Every filling of one composition under the cap: (-points, salary, ids)."""
    by = {p: [(i, salary, points) for i, q, salary, points in rows if q == p] for p in POSITIONS}
    for sets in itertools.product(*[list(itertools.combinations(by[p], n)) for p, n in zip(POSITIONS, counts)]):
        chosen = [x for s in sets for x in s]
        if sum(x[1] for x in chosen) <= cap:
            yield -sum(x[2] for x in chosen), sum(x[1] for x in chosen), sorted(x[0] for x in chosen)


def test_best_roster_is_canonical(spark):
    """Salaries and points from few values, so that many rosters tie: most points, least salary, smallest list of players."""
    source, rows, comps, want = random.Random(9), [], [], {}
    for slate in range(12):
        own, cap = [], source.choice([9, 10, 11, 12])
        for p, k in zip(POSITIONS, (2, 5, 5, 3, 2)):
            own += [(len(own) + i + 1, p, source.choice([1, 1, 2]), source.choice([1, 2, 2, 3])) for i in range(k)]
        asked = [(2, 2, 1), (1, 3, 1), (1, 2, 2)]
        rows += [(str(slate), "r", 1, p, i, salary, points) for i, p, salary, points in own]
        comps += [(str(slate), "r", 1, cap, n, 1, *x, 1) for n, x in enumerate(asked)]
        want[str(slate)] = min(y for x in asked for y in rosters_by_hand(own, (1, *x, 1), cap))
    frame = spark.createDataFrame(rows, "slate string, request string, variant int, position string, idx int, salary int, points long")
    needs = spark.createDataFrame(comps, "slate string, request string, variant int, cap int, comp int, n_qb int, n_rb int, n_wr int, n_te int, n_dst int")
    assert {r.slate: (-r.points, r.salary, list(r.ids)) for r in solver.solve(frame, needs).collect()} == want


def test_bounds_rule_out_most(spark):
    """Over whole weeks: the k-sets that are formed shrink tenfold, and no optimum is lost (the table agrees)."""
    from math import comb

    frame = spark.createDataFrame([], POOL).withColumn("slate", F.lit(""))
    for seed in range(4):
        frame = frame.unionByName(pool_frame(spark, week(seed, (15, 38, 48, 16, 15)), f"s{seed}"))
    rows, left, best = lineups.solved(frame, [Request(variants=((1.0, 0.0),))])
    free = rows.select(*locks.KEY, "position", "idx", "salary", solver.micro(F.col("proj_fpts")).alias("points"))
    comps = locks.compositions(left)
    assert {(r.slate, r.points) for r in best_by_table(free, comps).collect()} == {(r.slate, r.points) for r in best.collect()}
    players, needs, _ = solver.problems(free, comps)
    most = solver.most_of(needs)
    kept = solver.dominance_prune(players, most, ["sig"]).drop("mx")
    bounded = solver.bounded(needs, solver.best_at(kept, most, solver.prices(kept)), ["problem"])
    assert bounded.where("bound < floor").count() == 0 and bounded.where("floor is null").count() == 0
    sets = lambda f: sum(comb(r.n, k) for r in f.join(most, "sig").groupBy("sig", "mx").agg(F.count("idx").alias("n")).collect() for k in range(2, r.mx + 1))
    assert sets(kept) >= 10 * sets(solver.worthwhile(kept, bounded))


def test_ten_thousand_requests(spark):
    """One plan for a table of requests equals one at a time, and equal problems are solved once."""
    pool = pool_frame(spark, week(11, (3, 5, 6, 3, 3)), "a").unionByName(pool_frame(spark, week(12, (3, 5, 6, 3, 3)), "b"))
    names = [f"{p}{i}" for p, k in zip(POSITIONS, (3, 5, 6, 3, 3)) for i in range(k)]
    source = random.Random(4)
    asked = []
    for i in range(10_000):
        out, own = source.sample(names, 2)
        asked.append(("ab"[i % 2], f"q{i}", source.choice([None, "dst1", "none"]), i % 3 == 0, [out] if i % 5 else [], ["RB0", "RB1", "RB2", "RB3"] if i % 999 == 1 else [own, own] if i % 7 == 0 else []))
    table = spark.createDataFrame(asked, "slate string, request string, dst string, one_te boolean, excluded array<string>, included array<string>")
    requests = locks.request_table(table, ((1.0, 0.0),))
    got = {(r.slate, r.request): (r.status, r.free_points, r.free_salary) for r in lineups.summaries(pool, requests).collect()}
    assert len(got) == 10_000 and {s for s, _, _ in got.values()} == {"OPTIMAL", "INFEASIBLE", "DST_NOT_FOUND"}
    some = [asked[i] for i in (7, 999 + 1, 4321)]
    for slate, name, dst, one, out, own in some:
        alone = lineups.summaries(pool.where(F.col("slate") == slate), [Request(name, dst, one, tuple(out), tuple(own), ((1.0, 0.0),))]).first()
        assert got[slate, name] == (alone.status, alone.free_points, alone.free_salary)
    rows = locks.candidates(pool, requests)
    free = rows.where("not locked and not dst_missing").select(*locks.KEY, "position", "idx", "salary", solver.micro(F.col("proj_fpts")).alias("points"))
    players, needs, of_key = solver.problems(free, locks.compositions(locks.residuals(rows)))
    assert of_key.count() > 3 * needs.select("problem").distinct().count() and players.select("sig").distinct().count() < 500


def test_only_changed_weeks_are_solved(spark, tmp_path):
    store = f"{tmp_path}/store"
    weeks = {s: week(20 + i, (3, 4, 5, 3, 2)) for i, s in enumerate("abc")}
    both = [Request(variants=((1.0, 0.0),)), Request("one", one_te=True, variants=((1.0, 0.0),))]

    def run(requests=both, compared=False):
        pool = pool_frame(spark, weeks["a"], "a")
        for s in list(weeks)[1:]:
            pool = pool.unionByName(pool_frame(spark, weeks[s], s))
        n = incremental.refresh_rosters(pool.repartition(3), requests, store)
        if compared:
            columns = ["slate", "request", "variant", "status", "idx", "player", "salary"]
            kept = sorted(map(tuple, incremental.kept_rosters(spark, store).select(columns).collect()))
            assert kept == sorted(map(tuple, lineups.optimal_lineups(pool, requests).select(columns).collect()))
        return n

    assert (run(), run()) == (3, 0)
    weeks["b"] = [r if i else (*r[:9], r[9] + 5.0, r[10]) for i, r in enumerate(weeks["b"])]
    assert (run(compared=True), run()) == (1, 0)
    assert run(both[:1]) == 3  # other requests
    del weeks["c"]
    assert (run(both[:1], True), run(both[:1])) == (0, 0)
    table = locks.request_table(spark.createDataFrame([("a", "x", True), ("b", "y", False)], "slate string, request string, one_te boolean"), ((1.0, 0.0),))
    assert run(table) == 2
    other = locks.request_table(spark.createDataFrame([("a", "x", True), ("b", "y", True)], "slate string, request string, one_te boolean"), ((1.0, 0.0),))
    assert run(other) == 1


def test_locks_and_failures(spark):
    rows = week(7)
    frame = pool_frame(spark, rows)
    one = ((1.0, 0.0),)
    asked = [
        Request("dst", dst="dst1", variants=one), Request("four", included=("RB0", "RB1", "RB2", "RB3"), variants=one), Request("none", dst="zzz", variants=one), Request("gone", dst="DST1", excluded=("DST1",), variants=one),
        Request("two", included=("QB0", "QB1", "QB1", "nobody"), excluded=("WR0",), variants=one),
    ]
    status = {r.request: (r.status, r.free_points) for r in lineups.summaries(frame, asked).collect()}
    assert status["four"][0] == "INFEASIBLE" and status["none"][0] == status["gone"][0] == "DST_NOT_FOUND"
    dst = next(r for r in rows if r[2] == "DST1")
    assert status["dst"][1] == pytest.approx(brute(rows, cap=50_000 - dst[10], total=8, need={**LIMITS, "DST": 0}))
    out = lineups.optimal_lineups(frame, asked).collect()
    names = lambda q: {r.player for r in out if r.request == q}
    assert "DST1" in names("dst") and len(names("dst")) == 9
    assert names("four") == {"RB0", "RB1", "RB2", "RB3"} and not names("none")
    two = brute(rows, cap=50_000 - sum(r[10] for r in rows if r[2] in ("QB0", "QB1")), total=7, need={**LIMITS, "QB": 0}, skip=("QB0", "QB1", "WR0"))
    assert status["two"] == (("OPTIMAL", pytest.approx(two)) if two is not None else ("INFEASIBLE", None)) and {"QB0", "QB1"} <= names("two") and "WR0" not in names("two")


def test_service(spark, tmp_path):
    for w in (3, 12):
        rows = [(2025, w, *r[2:]) for r in week(w)]
        snapshots.export_csv(spark.createDataFrame(rows, POOL), str(tmp_path / f"out{w}"))
        next((tmp_path / f"out{w}").glob("*.csv")).rename(tmp_path / f"p_2025_w{w}.csv")
    service = lineups.RosterService(spark, f"{tmp_path}/p_*.csv")
    assert (service.year, service.week) == (2025, 12)
    found = service.projections(week=3).collect()
    assert [r.position for r in found] == sorted((r.position for r in found), key=POSITIONS.index) and {r.week for r in found} == {3}
    with pytest.raises(FileNotFoundError):
        service.projections(week=4)
    with pytest.raises(locks.DefenseNotFound):
        service.optimize(Request(dst="zzz"))
    three = service.lineups_json().collect()
    assert len(three) == 3 and len(json.loads(three[0].json)) == 9


def test_refresh_replaces_weeks(spark, tmp_path):
    landing, target = tmp_path / "in", f"{tmp_path}/out"
    landing.mkdir()
    head = "player,position,team,opponent,salary\n"
    (landing / "a_2025_w1.csv").write_text(head + "A,QB,KC,BUF,5000\nA,QB,KC,BUF,5000\n")
    (landing / "a_2025_w2.csv").write_text(head + "B,QB,KC,BUF,6000\n")
    refresh.refresh(spark, str(landing), target, f"{tmp_path}/c", SALARY).awaitTermination()
    time.sleep(1.1)
    (landing / "b_2025_w1.csv").write_text(head + "C,QB,KC,BUF,7000 \n")
    refresh.refresh(spark, str(landing), target, f"{tmp_path}/c", SALARY).awaitTermination()
    assert sorted((r.player, r.file_week, r.salary) for r in spark.read.parquet(target).collect()) == [("B", 2, 6000), ("C", 1, 7000)]


def test_refresh_keeps_newer_files(spark, tmp_path):
    """An older file that lands in a later run changes nothing; nor does one that lands beside a newer one."""
    landing, target = tmp_path / "in", f"{tmp_path}/out"
    landing.mkdir()

    def land(name, player, at):
        (landing / name).write_text(f"player,position,team,opponent,salary\n{player},QB,KC,BUF,5000\n")
        os.utime(landing / name, (at, at))

    def rows():
        refresh.refresh(spark, str(landing), target, f"{tmp_path}/c", SALARY).awaitTermination()
        return sorted((r.player, r.file_week) for r in spark.read.parquet(target).collect())

    land("new_2025_w5.csv", "NEW", 2_000_000)
    land("one_2025_w6.csv", "ONE", 1_000_000)
    assert rows() == [("NEW", 5), ("ONE", 6)]
    land("old_2025_w5.csv", "OLD", 1_500_000)
    land("two_2025_w6.csv", "TWO", 1_000_002)
    land("three_2025_w6.csv", "THREE", 1_000_001)
    land("notes.csv", "NOTES", 9_000_000)
    assert rows() == [("NEW", 5), ("TWO", 6)]
    land("old2_2025_w6.csv", "OLD", 1_000_000)
    assert rows() == rows() == [("NEW", 5), ("TWO", 6)]
    land("tie_2025_w5.csv", "TIE", 2_000_000)  # equally new: the greater name
    assert rows() == [("TIE", 5), ("TWO", 6)]


def test_refresh_takes_overwritten_files(spark, tmp_path):
    landing, target, manifest = tmp_path / "in", f"{tmp_path}/out", f"{tmp_path}/manifest"
    landing.mkdir()
    head = "player,position,team,opponent,salary\n"
    run = lambda: refresh.refresh_changed(spark, f"{landing}/*.csv", target, manifest, SALARY)
    rows = lambda: sorted((r.player, r.file_week) for r in spark.read.parquet(target).collect())
    (landing / "s_2025_w5.csv").write_text(head + "A,QB,KC,BUF,5000\n")
    (landing / "s_2025_w6.csv").write_text(head + "B,QB,KC,BUF,5000\n")
    assert run() == 2 and run() == 0 and rows() == [("A", 5), ("B", 6)]
    time.sleep(1.1)
    (landing / "s_2025_w5.csv").write_text(head + "C,QB,KC,BUF,5000\n")
    assert run() == 1 and run() == 0 and rows() == [("B", 6), ("C", 5)]
    (landing / "older_2025_w6.csv").write_text(head + "D,QB,KC,BUF,5000\n")
    os.utime(landing / "older_2025_w6.csv", (1, 1))
    assert run() == 0 and rows() == [("B", 6), ("C", 5)]


def test_command(spark, tmp_path, monkeypatch, capsys):
    from rosterlake import __main__ as command

    rows = spark.createDataFrame([(2025, w, *r[2:]) for w in (3, 12) for r in week(w)], POOL).withColumns({"file_year": F.col("year"), "file_week": F.col("week")})
    snapshots.write_snapshots(rows, str(tmp_path / "pools"), "pool")
    assert command.main([f"{tmp_path}/pools/*", "--dst", "dst1", "--exclude", "WR0", "--one-te"]) == 0
    out = capsys.readouterr().out
    assert out.startswith("2025, week 12") and out.count("DST1") == 3 and "WR0" not in out and "remaining" in out
    assert command.main([f"{tmp_path}/pools/*", "--week", "3", "--dst", "nobody"]) == 1 and command.main([f"{tmp_path}/pools/*", "--week", "4"]) == 1


def thin_tables(spark, folder, cut):
    """part and lineitem of four weeks, all in grade A but for the keys that cut names."""
    parts = spark.range(320).select(F.col("id").alias("p_partkey"), F.lit("fine ring").alias("p_name"), F.when(F.expr(cut), 12).otherwise(0).cast("int").alias("p_size"))
    parts.write.parquet(f"{folder}/part.parquet")
    lines = parts.select(F.col("p_partkey").alias("l_partkey"), (F.col("p_partkey") % 50 + 1).cast("double").alias("l_quantity"), F.lit("R").alias("l_returnflag"))
    lines.write.parquet(f"{folder}/lineitem.parquet")
    return str(folder)


def by_sql(folder, name, tables=("part", "lineitem")):
    duckdb = pytest.importorskip("duckdb").connect()
    for t in tables:
        duckdb.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    return duckdb.execute(registered.oracle_sql()[name])


@pytest.mark.parametrize("name", ["lineup_semi_join", "optimal_infeasible"])
def test_four_backs_in_thin_weeks(spark, tmp_path, name):
    """Week 1 has no quarterback, and no four backs either; week 2 has no quarterback."""
    folder = thin_tables(spark, tmp_path / "sf", "(p_partkey between 80 and 239 and p_partkey % 10 = 1) or p_partkey in (83, 84, 85, 93, 94, 95, 103, 104, 105, 113, 114, 115, 123, 124, 125)")
    got = registered.queries()[name](spark, folder)
    want = by_sql(folder, name)
    order = [c[0] for c in want.description]
    assert sorted(map(tuple, got.select(order).collect())) == sorted(want.fetchall()) and {r.slate for r in got.collect()} >= {0, 2}


def test_locked_objective_without_defense(spark, tmp_path):
    folder = thin_tables(spark, tmp_path / "sf", "p_partkey between 80 and 159 and p_partkey % 10 = 0")
    got = {r.slate: r.status for r in registered.queries()["optimal_objective_locked"](spark, folder).collect()}
    want = {slate: status for slate, _, status, _ in by_sql(folder, "optimal_objective_locked").fetchall()}
    assert got == want and got[1] == "INFEASIBLE" and got[0] == "OPTIMAL"


def test_equal_requests_are_made_once(spark):
    """Requests that differ only by name or order of names make candidates once; every one has its own result."""
    pool = pool_frame(spark, week(31, (3, 5, 6, 3, 3)), "a").unionByName(pool_frame(spark, week(32, (3, 5, 6, 3, 3)), "b"))
    kinds = [(None, False, ["RB0", "WR1"], []), (None, True, ["WR1", "RB0", "RB0"], []), ("dst1", False, None, ["QB1"]), ("none", False, [], []), (None, False, [], ["RB0", "RB1", "RB2", "RB3"])]
    asked = [("ab"[i % 2], f"q{i}", *kinds[i % 5]) for i in range(300)]
    asked += [("a", "turned", None, False, ["WR1", "RB0"], [])]
    table = spark.createDataFrame(asked, "slate string, request string, dst string, one_te boolean, excluded array<string>, included array<string>")
    requests = locks.request_table(table, ((1.0, 0.0), (0.9, 0.1)))
    once, names = locks.folded(requests)
    assert once.count() == 20 and names.count() == 602 and names.select("slate", "one", "variant").distinct().count() == 20
    few = locks.request_table(table.where("request in ('turned', 'q2', 'q9')"), ((1.0, 0.0), (0.9, 0.1)))
    of = lambda rows, *c: dict((k, sorted(map(tuple, v[list(c)].values.tolist()), key=str)) for k, v in rows.toPandas().groupby(["slate", "request", "variant"]))
    alone = {}
    for slate, name, dst, one, out, own in few.select("slate", "request", "dst", "one_te", "excluded", "included").distinct().collect():
        mine = [Request(name, dst, one, tuple(out), tuple(own), ((1.0, 0.0), (0.9, 0.1)))]
        alone |= of(lineups.optimal_lineups(pool.where(F.col("slate") == slate), mine), "status", "idx", "player", "proj_fpts", "salary")
    assert of(lineups.optimal_lineups(pool, few), "status", "idx", "player", "proj_fpts", "salary") == alone
    got = {(r.slate, r.request, r.variant): (r.status, r.free_points) for r in lineups.summaries(pool, requests).collect()}
    assert len(got) == 602 and got["a", "turned", 2] == got["a", "q0", 2] and got["b", "q5", 1] == got["b", "q295", 1] and {s for s, _ in got.values()} == {"OPTIMAL", "INFEASIBLE", "DST_NOT_FOUND"}


def test_store_files_do_not_grow_with_slates(spark, tmp_path, monkeypatch):
    """Rosters of 30 weeks are in as many files as tasks write; runs that nothing needs go, and many are made one."""
    monkeypatch.setattr(incremental, "RUNS", 2)
    store, one = f"{tmp_path}/store", [Request(variants=((1.0, 0.0),))]
    pool = pool_frame(spark, week(20, (3, 4, 5, 3, 2)), "a").drop("slate").crossJoin(spark.range(30).select(F.col("id").cast("string").alias("slate"))).localCheckpoint()
    files = lambda: [os.path.join(d, f) for d, _, names in os.walk(store) for f in names if f.endswith(".parquet") and "/runs/" in d]
    runs = lambda: spark.read.parquet(f"{store}/digests").select("run").distinct().count()
    state = lambda: sorted(map(tuple, incremental.kept_rosters(spark, store).select("slate", "idx", "proj_fpts").collect()))
    assert incremental.refresh_rosters(pool, one, store) == 30 and len(files()) <= 8 and len({s for s, _, _ in state()}) == 30
    before = state()
    more = F.col("proj_fpts") + F.when(F.col("slate") == "7", 1.0).otherwise(0.0)
    assert incremental.refresh_rosters(pool.withColumn("proj_fpts", more), one, store) == 1 and runs() == 2
    assert [r for r in state() if r[0] != "7"] == [r for r in before if r[0] != "7"] and state() != before
    more = more + F.when(F.col("slate") == "8", 1.0).otherwise(0.0)
    assert incremental.refresh_rosters(pool.withColumn("proj_fpts", more), one, store) == 1 and runs() == 1
    assert len(state()) == len(before) and len([r for r in zip(state(), before) if r[0] != r[1]]) == len([r for r in before if r[0] in "78"])
    assert len(os.listdir(f"{store}/runs")) == 1


def test_service_reads_only_its_week(spark, tmp_path):
    rows = pool_frame(spark, week(9)).drop("slate").crossJoin(spark.range(1, 13).select(F.lit(2025).alias("file_year"), F.col("id").cast("int").alias("file_week")))
    snapshots.write_snapshots(rows, str(tmp_path / "odd [x]"), "pool")
    service = lineups.RosterService(spark, str(tmp_path / "odd*" / "*"))
    files = service.pool().inputFiles()
    assert (service.year, service.week) == (2025, 12) and files and all("w12.csv" in f for f in files)
    assert service.pool().count() == len(week(9)) == service.projections(week=3).count()
    with pytest.raises(FileNotFoundError):
        service.projections(week=14)
