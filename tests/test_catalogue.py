import hashlib
import json
import os

import duckdb
import pytest
from cairnflow.functions import labels as L
from cairnflow.operators import catalogue
from cairnflow.plans import views
from cairnflow.plans.rank import global_rank
from cairnflow.sources import artifacts as A
from pyspark.sql import functions as F
from test_operators import SF, plain


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


@pytest.mark.parametrize("name", ["fast_path", "feed_batches", "label_lists", "turn_themes", "random_model", "appended_events", "series_keys", "cursors", "quality_rank"])
def test_oracle(spark, name):
    con = duckdb.connect()
    for x in os.listdir(SF):
        con.execute(f"create view {x.split('.')[0]} as select * from '{SF}/{x}'")
    found = con.execute(catalogue.ORACLES[name])
    names, want, got = [d[0] for d in found.description], found.fetchall(), catalogue.QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(names)
    cols = sorted(names)
    assert plain(got.collect(), [got.columns.index(c) for c in cols]) == plain(want, [names.index(c) for c in cols])


@pytest.mark.parametrize("expected", [1, 12])
def test_random_model_is_whole_when_few_lie_below_the_bound(spark, monkeypatch, expected):
    monkeypatch.setattr(catalogue, "EXPECTED", expected)
    test_oracle(spark, "random_model")


def test_labels(spark):
    lit = F.lit
    assert one(spark, *L.split_category(lit("Theme::Isekai Isekai")), *L.split_category(lit("Action Action")), L.metadata_token(lit("theme"), lit("Slice of Life")), L.metadata_token(lit("x"), lit("--"))) == ("theme", "Isekai", "genre", "Action", "theme_slice_of_life", "")
    assert one(spark, L.split_labels(lit("A, b,a ,, B B,C")), L.split_labels(lit("Unknown")), L.split_labels(lit(None).cast("string"))) == (["A", "b", "C"], [], [])
    assert one(spark, *L.date_range(lit("Apr 3, 1998 to Apr 24, 1999")), *L.date_range(lit("2001"))) == ("Apr 3, 1998", "Apr 24, 1999", "2001", None)
    assert one(spark, L.staff_role(lit("Stunts, music/Director")), L.staff_role(lit("Stunts")), L.character_role(lit("Music")), L.character_role(lit("main")), L.character_role(lit("odd"))) == ("Director", None, None, "Main", "Unknown")
    assert one(spark, L.natural_join(F.array(lit("a"), lit(None), lit("b"), lit(""), lit("c"))), L.natural_join(F.array().cast("array<string>"))) == ("a, b, and c", "")
    assert one(spark, L.score_map([lit("5"), lit("x"), lit("7.0")])) == ({"1": 5, "3": 7},)
    for title, key in (("The Big Show: part two", "big"), ("Blue Rose Season 2", "blue rose"), ("Blue Rose 2nd Act", "blue rose"), ("12 Days", "12 days"), ("Star - Fall", "star"), ("", "")):
        assert one(spark, L.series_key(lit(title))) == (key,), title
    assert one(spark, L.story_themes(lit("A rainy city; the student's club")))[0] == ["school life", "coming of age", "city and countryside"]
    assert one(spark, L.json_object(lit('so ```json {"a": 1} ``` {"b": 2}')), L.json_object(lit('x {"b": 2} y')), L.json_object(lit("{broken")), L.json_object(lit("[1]"))) == ('{"a": 1}', '{"b": 2}', None, None)
    mark = hashlib.sha256(b"{}").hexdigest()[:32]
    cursor = L.encode_cursor(L.fingerprint(lit("{}")), lit(40))
    assert one(spark, L.decode_cursor(cursor)["mark"], L.decode_cursor(cursor)["offset"], L.decode_cursor(lit("nonsense")), L.decode_cursor(L.encode_cursor(lit(mark), lit(-1)))) == (mark, 40, None, None)


def test_cursors_of_large_event_ids_come_back(spark, tmp_path):
    ids = [0, 100_000, 100_001, 2**40]
    spark.createDataFrame([(i, "view", 7) for i in ids], "event_id long, event_type string, user_id long").write.parquet(str(tmp_path / "events.parquet"))
    got = catalogue.cursors(spark, str(tmp_path)).collect()
    assert sorted(r["offset"] for r in got) == ids and all(r.refused and len(r.mark) == 32 for r in got)


def test_global_rank_is_the_order(spark):
    rows = spark.createDataFrame([(i, (i * 7919) % 50) for i in range(500)], "id long, x long").repartition(5)
    got = {r.id: (r.place, r.n) for r in global_rank(rows, [F.desc("x"), F.asc("id")], "place", "n").collect()}
    assert got == {i: (k, 500) for k, i in enumerate(sorted(range(500), key=lambda i: (-((i * 7919) % 50), i)), 1)}
    assert global_rank(rows.where("false"), [F.desc("x")], "place", "n").count() == 0


def test_names_are_resolved_in_stages(spark):
    names = spark.createDataFrame([(1, "Green Almond"), (2, "Rose Water"), (3, "green almond!"), (4, "Blue Steel Ring")], "item_id long, name string")
    asked = spark.createDataFrame([(10, "GREEN ALMOND"), (11, "Water, Rose"), (12, "Blue Stel Ring"), (13, "zzz")], "query_id long, query string")
    got = {r.query_id: (r.item_id, r.how, r.n) for r in catalogue.resolve_names(names, asked).collect()}
    assert got == {10: (1, "exact", 2), 11: (2, "variant", 1), 12: (4, "fuzzy", 1)}


def test_sources(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"data": [{"id": 1, "title": "x", "n": 2}, {"id": 2}]}))
    (tmp_path / "b.json").write_text(json.dumps([{"id": 3, "title": "y"}]))
    (tmp_path / "c.csv").write_bytes("﻿id,title\n4,\"two\nlines\"\nbad,z\n".encode())
    got = [sorted(map(tuple, A.id_keyed(spark, str(tmp_path / f), "id", ["id", "title", "gone"]).collect())) for f in ("a.json", "b.json", "c.csv")]
    assert got == [[(1, "x", None), (2, None, None)], [(3, "y", None)], [(4, "two\nlines", None)]]
    assert A.discover(spark, [str(tmp_path / "no"), str(tmp_path)], ["a.json", "c.csv"]) == str(tmp_path)
    with pytest.raises(FileNotFoundError):
        A.discover(spark, [str(tmp_path)], ["zzz"])


def test_published_tables_survive_failed_jobs(spark, tmp_path):
    path, rows = str(tmp_path / "t"), spark.range(5)
    for n in (5, 6, 7):
        A.publish(spark.range(n), path)
    assert spark.read.parquet(A.published(spark, path)).count() == 7 and len([x for x in os.listdir(path) if x.startswith("v")]) == 2
    with pytest.raises(Exception):  # noqa: B017
        A.publish(rows.select(F.raise_error(F.lit("no"))), path)
    assert spark.read.parquet(A.published(spark, path)).count() == 7
    built = []

    def build():
        built.append(1)
        return spark.range(3)

    def missing():
        raise FileNotFoundError("none")

    other = str(tmp_path / "u")
    assert [A.load_or_build(spark, other, [missing, build]).count() for _ in range(2)] == [3, 3] and built == [1]


def test_vectors_are_checked(spark):
    catalog = spark.range(10).withColumnRenamed("id", "item_id")
    rows = [(i, [1.0, float(i)]) for i in range(10)]
    ok = lambda rows: A.checked_vectors(spark.createDataFrame(rows, "item_id long, vec array<double>"), catalog)
    assert ok(rows).count() == 10
    for bad in ([], rows + rows[:1], rows[:8], rows[:9] + [(9, [1.0])], rows[:9] + [(9, [1.0, float("nan")])], rows[:9] + [(None, [1.0, 2.0])]):
        with pytest.raises(ValueError):
            ok(bad)


def test_digests_are_of_the_stream(spark):
    df = spark.createDataFrame([(3, "c"), (1, "a"), (2, None), (3, "c")], "id long, t string").repartition(3)
    assert A.ids_digest(df, "id").first()[0] == hashlib.sha256(b"1\n2\n3\n").hexdigest() and A.joined_ids_digest(df, "id").first()[0] == hashlib.sha256(b"1\x002\x003\x00").hexdigest()
    assert A.story_digest(df.distinct(), "id", "t").first()[0] == hashlib.sha256(b"1\0a\x002\0\x003\0c\0").hexdigest()


def test_split_store(spark, tmp_path):
    source, path = tmp_path / "r.csv", str(tmp_path / "split")
    source.write_text("user_id\n1\n")
    split = spark.createDataFrame([(1, 2, "train"), (1, 3, "test"), (2, 2, "train")], "user_id long, item_id long, fold string")
    config = {"seed": "42"}
    assert not A.split_matches(spark, path, str(source), config)
    A.write_split(split, path, str(source), config)
    assert A.split_matches(spark, path, str(source), config) and not A.split_matches(spark, path, str(source), {"seed": "43"})
    assert A.read_split(spark, path, spark.createDataFrame([(1,)], "user_id long")).count() == 2
    source.write_text("user_id\n1\n2\n")
    assert not A.split_matches(spark, path, str(source), config)
    A.report(split, str(tmp_path / "out"))
    assert A.markdown(split.orderBy("user_id", "item_id")).splitlines()[2] == "| 1 | 2 | train |"


def test_facts_are_written_again_when_a_source_changes_or_they_are_gone(spark, tmp_path):
    import shutil

    folder = tmp_path / "sf"
    shutil.copytree(SF, folder, copy_function=shutil.copyfile)
    os.chmod(folder, 0o755)  # a copy of a read-only folder
    count = lambda: views.run_sql(spark, str(folder), f"WITH {views.RATINGS}, {views.SPLIT} SELECT count(*) AS n FROM ratings").first().n
    before = count()
    held = views.facts(spark, str(folder), False)["ratings"]
    assert views.facts(spark, str(folder), False)["ratings"] is held
    spark.read.parquet(f"{SF}/lineitem.parquet").where("l_orderkey % 2 = 0").write.parquet(str(tmp_path / "half"))
    os.remove(folder / "lineitem.parquet")
    shutil.copytree(tmp_path / "half", folder / "lineitem.parquet")
    assert 0 < count() < before
    shutil.rmtree(spark.sparkContext.getCheckpointDir().removeprefix("file:"))
    assert 0 < count() < before
