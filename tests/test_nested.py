"""Walks over nested schemas, archives and caches."""

import io
import tarfile

from pyspark.sql import functions as F

from recordmill.functions import nested as N
from recordmill.sources import files as W

SCHEMA = "id long, r struct<name string, gold_label string, inner struct<TargetValue double, note string>, tags array<struct<t string, n long>>>, m map<string, string>"


def rows(spark):
    return spark.createDataFrame([(1, ("a", "g", (1.0, "x"), [("p", 1), (None, 2)]), {"k": "v", "the_target": "z"}), (2, None, None), (3, (None, None, None, []), {})], SCHEMA)


def test_drop_fields(spark):
    got = N.drop_fields(rows(spark), {"gold_label"}, ("target",))
    assert N.structure_signature(got.drop("m")) == [("id", "bigint"), ("r.inner.note", "string"), ("r.name", "string"), ("r.tags[].n", "bigint"), ("r.tags[].t", "string")]
    first = got.orderBy("id").first().asDict(True)
    assert first == {"id": 1, "r": {"name": "a", "inner": {"note": "x"}, "tags": [{"t": "p", "n": 1}, {"t": None, "n": 2}]}, "m": {"k": "v"}}


def test_change_strings_and_overlay(spark):
    up = N.change_strings(rows(spark), F.upper, ["r"])
    assert [r.asDict(True)["r"] for r in up.orderBy("id").collect()] == [{"name": "A", "gold_label": "G", "inner": {"TargetValue": 1.0, "note": "X"}, "tags": [{"t": "P", "n": 1}, {"t": None, "n": 2}]}, None, {"name": None, "gold_label": None, "inner": None, "tags": []}]
    mixed = N.overlay(rows(spark).drop("m"), up.drop("m"), "id", lambda c: c.isin("a", "p"))
    assert mixed.orderBy("id").first().asDict(True)["r"] == {"name": "A", "gold_label": "g", "inner": {"TargetValue": 1.0, "note": "x"}, "tags": [{"t": "P", "n": 1}, {"t": None, "n": 2}]}


def test_frozen_arrays(spark):
    df = spark.createDataFrame([([2, 1, None],), ([None, 1, 2],), ([1],)], "a array<long>")
    assert df.select(N.frozen(F.col("a"))).distinct().count() == 2


def test_archive_and_cache(spark, tmp_path):
    with tarfile.open(tmp_path / "x.tar.gz", "w:gz") as tar:
        for name, body in (("d/a.jsonl", b'{"id": 1}\n\n{"id": 2}\n'), ("d/b.txt", b"no")):
            info = tarfile.TarInfo(name)
            info.size = len(body)
            tar.addfile(info, io.BytesIO(body))
    assert sorted(r.id for r in W.read_archive(spark, f"{tmp_path}/*.tar.gz", ".jsonl", "id long").collect()) == [1, 2]
    df = spark.createDataFrame([("k", 1, "old"), ("k", 2, "new"), ("j", 1, "only")], "key string, at long, v string")
    assert sorted((r.key, r.v) for r in W.latest(df, "key", ["at"]).collect()) == [("j", "only"), ("k", "new")]


def test_near_neighbour_split_keeps_components(spark):
    from recordmill.plans.catalogue import queries

    rows = queries()["near_neighbour_free_split"](spark, "/root/testdata/sf0.001").collect()
    assert len(rows) == 200 and len({(r.component, r.split) for r in rows}) == len({r.component for r in rows}) and len({r.split for r in rows}) == 3
