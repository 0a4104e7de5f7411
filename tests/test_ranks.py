"""The stored rank index against direct counting."""

import math
import random

import pytest
from pyspark.sql import functions as F

from stratafold.operators.ranks import RankIndex


def frames(spark, seed):
    rng = random.Random(seed)
    number = lambda: rng.choice([None, float("nan"), 0.0, -0.0, float("inf"), float("-inf"), *[round(rng.gauss(0, 3), 1) for _ in range(9)]])
    reference = [(rng.choice(["a", "b", "c", None]), number(), rng.random() < 0.4) for _ in range(300)]
    probes = [(n, rng.choice(["a", "b", "z", None]), number()) for n in range(200)] + [(1000 + n, "a", 100.0 + n) for n in range(300)]
    return (
        spark.createDataFrame(reference, "g string, v double, chosen boolean"), spark.createDataFrame(probes, "id long, g string, v double"),
        reference, probes,
    )


def share(reference, value):
    held = [v for v in reference if v is not None and not math.isnan(v)]
    if value is None or math.isnan(value) or not held:
        return 0.0
    return sum(v < value for v in held) / len(held)


@pytest.mark.parametrize("width", [1, 13])
def test_ranks_equal_direct_counts(spark, tmp_path, partitions, width):
    partitions(width)
    reference, probes, held, asked = frames(spark, width)
    RankIndex.fit(reference, "v", {"all": F.lit(True), "some": F.col("chosen"), "none": F.lit(False)}).save(f"{tmp_path}/whole")
    RankIndex.fit(reference, "v", {"own": F.lit(True)}, "g").save(f"{tmp_path}/grouped")
    partitions(5)
    found = RankIndex.load(spark, f"{tmp_path}/whole").apply(probes, "v")
    found = RankIndex.load(spark, f"{tmp_path}/grouped").apply(found, "v")
    assert found.columns == ["id", "g", "v", "all", "some", "none", "own"]
    got = {r["id"]: r for r in found.collect()}
    assert len(got) == len(asked)
    for key, group, value in asked:
        row = got[key]
        assert row["all"] == pytest.approx(share([v for _, v, _ in held], value), abs=1e-6)
        assert row["some"] == pytest.approx(share([v for _, v, chosen in held if chosen], value), abs=1e-6)
        assert row["none"] == 0.0
        assert row["own"] == pytest.approx(share([v for g, v, _ in held if g == group and group is not None], value), abs=1e-6)


def test_every_join_gives_the_same(spark):
    reference, probes, _, _ = frames(spark, 3)
    index = RankIndex.fit(reference, "v", {"own": F.lit(True)}, "g")
    one = {r["id"]: r["own"] for r in index.apply(probes, "v").collect()}
    assert one == {r["id"]: r["own"] for r in index.apply(probes, "v", broadcast_bytes=0).collect()}


def test_empty_reference_and_no_rows(spark):
    reference, probes, _, _ = frames(spark, 4)
    empty = RankIndex.fit(reference.where("false"), "v", {"all": F.lit(True)})
    assert empty.apply(probes, "v").agg(F.max("all")).first()[0] == 0.0
    assert RankIndex.fit(reference, "v", {"all": F.lit(True)}).apply(probes.where("false"), "v").collect() == []


def test_an_index_is_never_replaced(spark, tmp_path):
    index = RankIndex.fit(frames(spark, 5)[0], "v", {"all": F.lit(True)})
    index.save(f"{tmp_path}/index")
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS|already exists"):
        index.save(f"{tmp_path}/index")
