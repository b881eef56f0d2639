import io
import os
import zipfile

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from riskloom.operators import weekly as W
from riskloom.plans import fixtures as FX
from riskloom.session import work_path
from riskloom.sources import buckets as SB
from riskloom.sources import files as SF
from riskloom.sources import links as SL
from tests.conftest import SMALL, rows


def test_link_harvest_own_html(spark):
    html = '<a href="a.zip">x</a><a href="b.csv">y</a><a href="c.zip">z</a>'
    pages = spark.createDataFrame([(1, "u", html)], "page_id long, url string, html string")
    assert [r["href"] for r in SL.link_harvest(pages, only_matching=True).orderBy("pos").collect()] == ["a.zip", "c.zip"]
    stored = spark.createDataFrame([("a.zip",)], "name string")
    listing = SL.link_harvest(pages, only_matching=True).selectExpr("href as name")
    assert SL.new_file_count(listing, stored).first()["new_files"] == 1


def _zip(path, member, lines):
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as zf:
        zf.writestr(member, "\n".join(lines) + "\n")
    with open(path, "wb") as fh:
        fh.write(buf.getvalue())


def test_same_member_last_archive_wins(spark):  # E20
    d = work_path(spark, "zips").replace("file:", "")
    os.makedirs(d)
    _zip(os.path.join(d, "a.zip"), "m.tsv", ["old"])
    _zip(os.path.join(d, "b.zip"), "m.tsv", ["new1", "new2"])
    got = sorted(r["line"] for r in SF.expand_archives(spark, d).collect())
    assert got == ["new1", "new2"]
    seen = spark.createDataFrame([("m.tsv",)], "member string")
    assert SF.expand_archives(spark, d, expanded=seen).count() == 0


def test_nothing_is_decompressed_but_what_is_wanted(spark):
    d = work_path(spark, "zips").replace("file:", "")
    os.makedirs(d)
    _zip(os.path.join(d, "a.zip"), "old.tsv", ["x"])
    _zip(os.path.join(d, "b.zip"), "new.tsv", ["y"])
    with open(os.path.join(d, "a.zip"), "r+b") as fh:  # the bytes of old.tsv are damaged, its directory isn't
        raw = fh.read()
        at = raw.index(b"old.tsv") + len("old.tsv")
        fh.seek(at)
        fh.write(b"\xff\xff")
    assert sorted((r.archive[-5:], r.member, r["size"]) for r in SF.archive_members(spark, d).collect()) == [("a.zip", "old.tsv", 2), ("b.zip", "new.tsv", 2)]
    seen = spark.createDataFrame([("old.tsv",)], "member string")
    assert [r.line for r in SF.expand_archives(spark, d, expanded=seen).collect()] == ["y"]
    with pytest.raises(Exception):  # noqa: B017 - unwanted, it was not read; wanted, it fails
        SF.expand_archives(spark, d).collect()


def test_bad_row_fails_load(spark):  # E21
    d = work_path(spark, "bad").replace("file:", "")
    os.makedirs(d)
    with open(os.path.join(d, "x.csv"), "w") as fh:
        fh.write("1\t20240101\t14\tXX\tnot-a-number\t1\t1\t0.5\t0.5\n")
    with pytest.raises(Exception):
        SF.read_tsv(spark, d).collect()


def test_append_twice_no_duplicates(spark):  # E22
    d = work_path(spark, "tsv").replace("file:", "")
    os.makedirs(d)
    with open(os.path.join(d, "x.csv"), "w") as fh:
        fh.write("1\t20240101\t14\t\t3\t1\t1\t0.5\t0.5\n")
    table = work_path(spark, "tbl")
    rows = SF.read_tsv(spark, d)
    assert SF.append_events(rows, table) == 1
    assert SF.append_events(rows, table) == 0
    got = SF.read_events(spark, table).collect()
    assert len(got) == 1 and got[0]["country"] is None  # E9: empty field reads as NULL
    assert SF.canonical_events(SF.read_events(spark, table), empty_country="keep").first()["country"] == ""


def test_a_reload_reads_names_and_a_crash_changes_nothing(spark, monkeypatch):
    table = work_path(spark, "tbl")
    rows = spark.createDataFrame([("f1", 1), ("f1", 2), ("f2", 3)], "source_file string, x int")
    with monkeypatch.context() as m:
        m.setattr(SF.TableLog, "commit", lambda *a, **k: (_ for _ in ()).throw(RuntimeError("crash before the commit")))
        with pytest.raises(RuntimeError):
            SF.append_events(rows, table)
    assert SF.loaded_files(spark, table) is None
    assert SF.append_events(rows, table) == 2
    more = rows.unionByName(spark.createDataFrame([("f3", 4)], "source_file string, x int"))
    assert SF.append_events(more, table) == 1
    assert sorted(r.x for r in SF.read_events(spark, table).collect()) == [1, 2, 3, 4]
    assert all("/files/" in f or "/_log/" in f for f in SF.loaded_files(spark, table).inputFiles())


def test_loads_and_refreshes_at_once(spark, monkeypatch):
    from concurrent.futures import ThreadPoolExecutor

    table, root = work_path(spark, "tbl"), work_path(spark, "refresh")
    commit, tries = SF.TableLog.commit, []

    def slow(self, version, **entry):  # both writers look before either commits
        import time

        tries.append(version)
        time.sleep(1.0 if len(tries) <= 2 else 0.0)
        return commit(self, version, **entry)

    monkeypatch.setattr(SF.TableLog, "commit", slow)
    a = spark.createDataFrame([("f1", 1), ("f2", 2)], "source_file string, x int")
    b = spark.createDataFrame([("f2", 2), ("f3", 3)], "source_file string, x int")
    with ThreadPoolExecutor(2) as pool:
        list(pool.map(lambda df: SF.append_events(df, table), (a, b)))
    assert sorted(r.x for r in SF.read_events(spark, table).collect()) == [1, 2, 3]
    with ThreadPoolExecutor(2) as pool:
        done = list(pool.map(lambda n: SF.refresh_table(spark.range(n), root), (3, 5)))
    assert len(set(done)) == 2 and SF.TableLog(spark, root).latest() == 2
    assert SF.read_current(spark, root).count() in (3, 5)


def test_manifest_loads_only_its_files(spark):
    d = work_path(spark, "man").replace("file:", "")
    os.makedirs(d + "/sub dir")
    line = "{}\t20240101\t14\tXX\t3\t1\t1\t0.5\t0.5\n"
    for i, name in enumerate(["a+b.csv", "c.csv", "sub dir/d.csv"]):
        with open(os.path.join(d, name), "w") as fh:
            fh.write(line.format(i))
    urls = [f"file://{d}/a+b.csv", f"file:{d}/sub%20dir/d.csv"]
    lines, document = work_path(spark, "m1"), work_path(spark, "m2")
    spark.createDataFrame([(u, True) for u in urls], "url string, mandatory boolean").write.json(lines)
    spark.createDataFrame([([(u, True) for u in urls],)], "entries array<struct<url:string,mandatory:boolean>>").coalesce(1).write.json(document)
    for manifest in (lines, document):
        assert sorted(r.event_id for r in SF.load_manifest(spark, manifest, d).collect()) == [0, 2]
    SF.write_manifest(spark, d, lines)
    assert SF.read_manifest(spark, lines).count() == 3
    assert sorted(r.event_id for r in SF.load_manifest(spark, lines, d).collect()) == [0, 1, 2]
    with open(os.path.join(d, "c.csv"), "w") as fh:
        fh.write("short\n")
    with pytest.raises(Exception):  # noqa: B017 - a bad row fails the load
        SF.load_manifest(spark, lines, d).collect()
    os.remove(os.path.join(d, "c.csv"))
    with pytest.raises(FileNotFoundError):
        SF.load_manifest(spark, lines, d)


def test_json_files_keep_their_order(spark):
    d = work_path(spark, "json").replace("file:", "")
    os.makedirs(d + "/requests")
    with open(d + "/codes.json", "w") as fh:
        fh.write('{\n "ZZ": "Same",\n "AA": "Same", "B": "O\\"ther"}')
    assert [tuple(r) for r in SF.read_dictionary(spark, d + "/codes.json").collect()] == [(0, "ZZ", "Same"), (1, "AA", "Same"), (2, "B", 'O"ther')]
    from riskloom.operators import sourcing as X
    assert {r.name: r.code for r in X.country_code_of(SF.read_dictionary(spark, d + "/codes.json")).collect()} == {"Same": "ZZ", 'O"ther': "B"}
    with open(d + "/bad.json", "w") as fh:
        fh.write("[1, 2")
    with pytest.raises(Exception):  # noqa: B017
        SF.read_dictionary(spark, d + "/bad.json").collect()
    good = '{"items": [{"B": [{"C2": 2}, {"C1": 1}]}, {"A": [{"C3": 3}]}], "risk_aversion": "Low"}'
    for name, text in (("a.json", good), ("b.json", "not json"), ("c.json", '{"risk_aversion": "Low"}'), ("d.json", "")):
        with open(f"{d}/requests/{name}", "w") as fh:
            fh.write(text)
    requests, aside = SF.read_requests(spark, d + "/requests")
    assert [r.json for r in requests.collect()] == [good] and {r.source_file[-6:] for r in aside.collect()} >= {"b.json", "c.json"}
    assert [(r.item, r.country) for r in X.offers_long(requests).orderBy("item_pos", "offer_pos").collect()] == [("B", "C2"), ("B", "C1"), ("A", "C3")]


def test_refresh_switches_versions(spark):
    root = work_path(spark, "refresh")
    SF.refresh_table(spark.range(3), root)
    SF.refresh_table(spark.range(5), root)
    assert SF.read_current(spark, root).count() == 5


def test_entry_and_contract(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert set(df.columns) == {"country", "week", "total_mentions", "total_sources", "total_articles",
                               "center_tone", "center_goldstein"}
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q) and len(q) >= 60


def test_stored_events_prune_weeks(spark):
    from riskloom.operators import weekly as W
    d = work_path(spark, "ev-tsv").replace("file:", "")
    os.makedirs(d)
    with open(os.path.join(d, "x.csv"), "w") as fh:
        for i, day in enumerate(["20240101", "20240108", "20240305", "20240306"]):
            fh.write(f"{i}\t{day}\t14\tXX\t3\t1\t1\t0.5\t0.5\n")
    table = work_path(spark, "events")
    assert SF.store_events(SF.read_tsv(spark, d), table) == 1
    stored = SF.read_events(spark, table)
    out = W.weekly_metrics(stored, "2024-03-10", -1, strategy="window")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(week" in plan and "week#" in plan
    got = out.collect()
    assert len(got) == 1 and str(got[0]["week"]) == "2024-03-04" and got[0]["total_mentions"] == 6


def test_registered_names():
    import re

    from riskloom.plans.registry import QUERIES
    names = set(E.queries())
    # these names are kept for the optional subpackage
    assert not [n for n in QUERIES if "pipeline" in n or re.match(r"op\d+_", n)]
    assert set(QUERIES) <= names and set(E.oracle_sql()) <= names


def test_raw_58_column_layout(spark):
    d = work_path(spark, "raw").replace("file:", "")
    os.makedirs(d)
    fields = [""] * SF.GDELT_WIDTH
    values = {"event_id": "42", "sqldate": "20240305", "root_code": "14", "goldstein": "-6.5",
              "num_mentions": "7", "num_sources": "2", "num_articles": "5", "avg_tone": "-3.25", "country": "FR"}
    for name, pos in SF.GDELT_POSITIONS.items():
        fields[pos - 1] = values[name]
    with open(os.path.join(d, "day.CSV"), "w") as fh:
        fh.write("\t".join(fields) + "\n")
    table = work_path(spark, "raw-events")
    assert SF.store_events(SF.read_gdelt_events(spark, d), table) == 1
    r = SF.read_events(spark, table).first()
    assert (r["event_id"], r["country"], r["num_mentions"], r["avg_tone"], str(r["event_date"]), str(r["week"])) == \
        (42, "FR", 7, -3.25, "2024-03-05", "2024-03-04")


def test_a_failed_read_is_not_an_empty_table(spark):
    from riskloom.session import clear_work, read_if_exists

    assert read_if_exists(spark, work_path(spark, "absent")) is None
    broken = work_path(spark, "broken").replace("file:", "")
    rows = spark.createDataFrame([("f1", 1)], "source_file string, x int")
    assert SF.append_events(rows, broken) == 1
    for folder, _, names in os.walk(broken + "/files"):
        for name in names:
            if name.endswith(".parquet"):
                with open(os.path.join(folder, name), "w") as fh:
                    fh.write("not parquet")
    with pytest.raises(Exception):  # noqa: B017 - whatever the reader raises, nothing may be committed
        SF.append_events(rows, broken)
    assert SF.TableLog(spark, broken).latest() == 1
    root = work_path(spark, "versions")
    for n in (1, 2, 3):
        SF.refresh_table(spark.range(n), root)
        assert SF.read_current(spark, root).count() == n
    clear_work(spark)
    assert not os.path.exists(broken)


# ------------------------------------------------------------------ bucketed layout

@pytest.fixture(scope="module")
def bucketed(spark):
    root = work_path(spark, "bucket-test")
    SB.store_bucketed(FX.events(spark, SMALL), root, buckets=4)
    return root, SB.read_bucketed(spark, root)


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_bucketed_weekly_plans_have_no_exchange(spark, bucketed):
    ev, stored = FX.events(spark, SMALL), bucketed[1]
    forms = [lambda e: W.weekly_totals(e, FX.AS_OF, -2),
             lambda e: W.weekly_metrics(e, FX.AS_OF, -2, key=FX.EVENT_KEY, strategy="window")]
    for form in forms:
        assert "Exchange" in _plan(form(ev))
        plan = _plan(form(stored))
        assert "Exchange" not in plan and "PartitionFilters: [isnotnull(week_folder" in plan
        columns = form(ev).columns
        assert rows(form(stored), *columns) == rows(form(ev), *columns)


def test_bucketed_rows_survive_and_versions_follow_each_other(spark, bucketed):
    root, stored = bucketed
    ev = FX.events(spark, SMALL)
    assert stored.select(ev.columns).exceptAll(ev).isEmpty() and ev.exceptAll(stored.select(ev.columns)).isEmpty()
    with pytest.raises(FileNotFoundError):
        SB.read_bucketed(spark, work_path(spark, "no-buckets"))
    with pytest.raises(ValueError):
        SB.store_bucketed(ev, root, buckets=0)
    other = work_path(spark, "bucket-versions")
    SB.store_bucketed(ev.limit(0), other, buckets=2)
    assert SB.read_bucketed(spark, other).count() == 0
    odd = ev.limit(3).selectExpr("* except (country, event_date)", "cast(null as string) country",
                                 "if(num_mentions is null, event_date, null) event_date", "1 as `a b`")
    SB.store_bucketed(odd, other, buckets=3)  # neither country nor date
    assert SB.read_bucketed(spark, other).count() == 3


def test_archives_of_fewer_members_than_partitions(spark):
    path = work_path(spark, "few")
    df = spark.createDataFrame([("a", 1), ("b", 2), ("a", 3)], "name string, n long")
    parts = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "16")  # most tasks have no row
    try:
        FX.write_archives(df, path, df["name"], "p-")
        FX.write_archives(df.limit(0), path, df["name"], "q-")
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", parts)
    assert rows(SF.archive_members(spark, path), "member", "size") == [("a.tsv", 8), ("b.tsv", 4)]
    assert rows(SF.expand_archives(spark, path), "member", "line") == [("a.tsv", "a\t1"), ("a.tsv", "a\t3"), ("b.tsv", "b\t2")]


def test_buckets_grow_with_the_rows(spark):
    import datetime

    root, day = work_path(spark, "many"), datetime.date(2001, 1, 1)
    data = [(f"C{i % 7}", day + datetime.timedelta(days=i % 100), i) for i in range(1000)]
    ev = spark.createDataFrame(data, "country string, event_date date, n int")
    SB.store_bucketed(ev, root, buckets=2, bucket_rows=100)
    back = SB.read_bucketed(spark, root)
    assert back.groupBy("country", "week").count().rdd.getNumPartitions() == 10  # one task each
    assert rows(back, "country", "event_date", "n") == sorted(data)


def test_requests_are_dealt_once(spark):
    plan = FX.requests(spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 4  # the joins', the prices' and the requests' own
    assert plan.count("lineitem.parquet") == 1


def _oddly_named_archives(spark):
    d = work_path(spark, "in place").replace("file:", "")
    os.makedirs(d)
    names = ["a b.zip", "c%20+#?.zip", "y.zip", "z\u00e9.zip"]
    for i, name in enumerate(names):
        _zip(os.path.join(d, name), f"{i}.tsv", [f"{i}-{k}" for k in range(1000)])
    return d, names


def _no_archive_in_a_row(spark, fn):
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", "100")
    try:
        return fn()
    finally:
        spark.conf.unset("spark.sql.sources.binaryFile.maxLength")


def test_archives_are_expanded_in_place(spark, monkeypatch):
    d, _ = _oddly_named_archives(spark)
    want = sorted((f"{i}.tsv", f"{i}-{k}") for i in range(4) for k in range(1000))
    assert _no_archive_in_a_row(spark, lambda: rows(SF.expand_archives(spark, d), "member", "line")) == want
    monkeypatch.setattr(SF, "_opens", lambda path: False)  # a store that only Spark's readers know
    assert rows(SF.expand_archives(spark, d), "member", "line") == want


def test_archives_are_listed_in_place(spark, monkeypatch):
    d, names = _oddly_named_archives(spark)
    got = _no_archive_in_a_row(spark, lambda: rows(SF.archive_members(spark, d)))
    assert [(a.rsplit("/", 1)[1], m, n) for a, m, n in got] == [(a, f"{i}.tsv", 5890) for i, a in enumerate(names)]
    monkeypatch.setattr(SF, "_opens", lambda path: False)
    assert rows(SF.archive_members(spark, d)) == got


def test_more_archives_than_a_broadcast_holds(spark, monkeypatch):
    d = work_path(spark, "many").replace("file:", "")
    os.makedirs(d)
    for i in range(12):
        _zip(os.path.join(d, f"{i}.zip"), f"{i}.tsv", [f"{i}"])
    monkeypatch.setattr(SF, "BROADCAST_ROW_LIMIT", 1)
    lines = SF.expand_archives(spark, d)
    assert rows(lines, "line") == sorted((f"{i}",) for i in range(12))
    assert lines.select(F.spark_partition_id()).distinct().count() > 1  # not all in one task, short as their rows are
