"""Work on pictures and pages is dealt over tasks in small batches, wherever the rows lie."""

import numpy as np
import pytest

from millrace.functions import pages, script
from millrace.operators import draw, generate, pixels, stems, variation
from millrace.plans.registry import PICTURES, pieces
from millrace.sources import queries
from millrace.streaming import series

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("made", [lambda s: pixels._squares(s, SF), lambda s: stems._stones(s, SF), lambda s: variation._masks(s, SF), lambda s: variation._grainy(s, SF), lambda s: pages._made(s, SF)])
def test_rows_of_one_row_group_are_worked_on_by_many_tasks(spark, made):
    frame = made(spark)
    sizes = frame.select(frame.columns[0]).rdd.glom().map(len).collect()
    assert len(sizes) >= 4 * spark.sparkContext.defaultParallelism and max(sizes) <= 2 * sum(sizes) / len(sizes) + 4


def test_batches_are_small(spark):
    import pyarrow as pa

    assert [b.num_rows for b in pieces([pa.RecordBatch.from_arrays([pa.array(range(150))], ["a"])])] == [64, 64, 22]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 10_000)
    rows = pixels.run_steps(spark.range(1000).coalesce(1).selectExpr("id", "1 AS height", "1 AS width", "1 AS channels", "X'07' AS pixels"), [("grey", {})])
    assert rows.count() == 1000 and int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= PICTURES


def test_no_picture_is_shuffled(spark):
    for name in ("pictures_weather", "pictures_freeform", "pictures_combined"):
        plan = variation.GROUP.queries[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
        joins = [line for line in plan.splitlines() if "Join" in line]
        assert len(joins) == 2


def test_strokes_of_one_shape_are_the_same_wherever_they_lie():
    draw._stroke.cache_clear()
    line = (20.5, 10.0, 14.25, 33.125)
    far = draw.inked(60, 160, [tuple(v + (100 if i % 2 == 0 else 9) for i, v in enumerate(line))], 3)
    near = draw.inked(60, 160, [line], 3)
    assert draw._stroke.cache_info().misses == 1 and (far[9:, 100:] == near[:-9, :-100]).all() and (near < 240).any()
    # cut off at the border as a stroke drawn there is
    assert (draw.inked(20, 16, [line], 3) == near[:20, :16]).all()
    upright = draw.inked(40, 9, [(4, 10, 4, 30)], 2, 0, 255)[:, :, 0]
    assert abs((255 - upright.astype(float)).sum() / 255 - 40) < 0.5


def test_tiles_of_a_picture_smaller_than_the_grid():
    for shape in ((1, 1), (3, 5), (7, 90), (160, 160)):
        x = np.random.default_rng(1).integers(0, 256, shape).astype(np.uint8)
        assert pixels.clahe(x).shape == shape


def test_letters_are_told_apart_before_they_are_described(spark):
    plan = script.GROUP.queries["character_info"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    keys = [line.split("[", 1)[1].split("]")[0] for line in plan.splitlines() if "Aggregate [" in line]
    assert len(keys) == 1 and keys[0].count("#") == 2


def test_draws_of_a_brand_leave_in_pieces(spark):
    plan = generate.GROUP.queries["batch_draws"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression" in plan and "preset" in plan and "easy#" not in plan.split("MapInArrow")[-1]
    whole, cut = generate.Sampler("medium", 5), generate.Sampler("medium", 5)
    assert whole.batch(40) == cut.batch(13) + cut.batch(27)


def test_parts_of_a_log_are_written_by_all_tasks(spark, tmp_path):
    rows = spark.range(0, 300, 1, 3).selectExpr("id % 7 AS key", "id AS step", "CAST(300 - id AS DOUBLE) AS value")
    told = queries._streamed(spark, rows, [99, 199], f"file://{tmp_path}", series.Progress)
    assert told.count() == 300 and told.filter("improved").count() == 300
    mixed = rows.repartition(3, "value")
    told = queries._streamed(spark, mixed, [99, 199], f"file://{tmp_path}/mixed", series.Progress)
    assert told.count() == 300 and len(list((tmp_path / "mixed/log").glob("*.json"))) > 3
