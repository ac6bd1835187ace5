"""Operators against DuckDB, and kernels against small arrays with known answers."""

import pytest

from alphaloom.functions import pixel as px
from alphaloom.plans import registry
from alphaloom.plans.relation import duck_text, rows, table

SAMPLE = ["x03_threshold_gate", "p18_green_despill", "p33_effect_layer", "f07_region_classify_all", "a08_ratio_stats", "a05_bg_classify", "a19_candidate_quality", "r05_fusion_gate", "w10_queue_submit", "j05_manifest_merge", "j06_temporal_model_antijoin",
          "n01_uncertain_edge", "n02_speckle", "n03_hole", "n10_median_despeckle", "n12_luminous_restore", "f24_cyan_halo_band", "f29_trimap", "p06_chroma_key", "p11_black_key", "p25_prop_projection", "p50_green_generate", "u13_black_path", "u16_refine", "a01_alpha_quality", "a18_p0_report",
          "x35_risk_signal_rounding", "a24_black_effect_history", "a27_screen_color_median", "w02_ema", "w03_adaptive_bidirectional", "r02_standalone_best", "r03_region_select", "r04_selection_guard", "r07_fusion_risk_guard", "r20_selection_payload", "u12_green_path", "p27_black_despill", "f20_background_evidence", "f22_luminous_reconstruct", "r01_region_rank", "w07_mask_tracking", "k03_compose_output", "s04_sequence_scan",
          "x02_flatten_metrics", "x10_exception_rules", "x34_manifest_build_sample", "a07_region_supervision", "k06_regression_markdown"]


def same(spark, duck, sf_dir, relation):
    df = relation.frame(spark, sf_dir)
    other = duck.sql(relation.sql()).arrow() if not hasattr(duck.sql("select 1"), "to_arrow_table") else duck.sql(relation.sql()).to_arrow_table()
    names = sorted(df.columns)
    assert names == sorted(other.column_names)
    key = lambda data: sorted(tuple(repr(r[n]) for n in names) for r in data)
    assert key(df.toArrow().to_pylist()) == key(other.to_pylist())


@pytest.mark.parametrize("name", SAMPLE)
def test_against_sql(spark, duck, sf_dir, name):
    same(spark, duck, sf_dir, registry._relations()[name])


@pytest.fixture(scope="module")
def even_screens(tmp_path_factory):
    """Frames whose green and blue excess are equal but for the order of summing, in which numpy's mean and a running sum choose different screens."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.parquet as pq

    data = (np.random.default_rng(5).integers(-8, 9, (20_000, 64)) / 32).astype(np.float32)
    r, g, b = [np.floor(255 * np.clip(0.5 + 2 * np.roll(data.astype(float), -k, axis=1), 0, 1)) / 255 for k in (0, 21, 42)]
    green, blue = np.maximum(0, g - np.maximum(r, b)), np.maximum(0, b - np.maximum(r, g))
    running = np.add.accumulate(blue, axis=1)[:, -1] > np.add.accumulate(green, axis=1)[:, -1]
    odd = np.array([x.reshape(8, 8).mean() > y.reshape(8, 8).mean() for x, y in zip(blue, green)]) != running
    assert odd.sum() > 3
    at = tmp_path_factory.mktemp("even")
    rows_ = data[odd]
    pq.write_table(pa.table({"vec_id": pa.array(range(len(rows_)), pa.int64()), "embedding": pa.array(list(rows_), pa.list_(pa.float32())), "label": pa.array([0] * len(rows_), pa.int32())}), at / "embeddings.parquet")
    return str(at)


@pytest.mark.parametrize("name", ["p06_chroma_key", "p50_green_generate", "u05_traditional_candidate"])
def test_screen_of_nearly_equal_colours_against_sql(spark, even_screens, name):
    import duckdb

    c = duckdb.connect()
    c.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{even_screens}/embeddings.parquet'")
    same(spark, c, even_screens, registry._relations()[name])


@pytest.fixture(scope="module")
def half_way_risks(tmp_path_factory):
    """Suppliers with risks and baselines half-way between two numbers of three digits (n / 16 * 1.8, and balances of 12.5 and 25 more each)."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    at = tmp_path_factory.mktemp("half")
    keys = range(400)
    lines = [(k, 1.0 if i < 9 + k % 8 else 30.0) for k in keys for i in range(16)]
    n = len(lines)
    pq.write_table(pa.table({"l_suppkey": [k for k, _ in lines], "l_quantity": [q for _, q in lines], "l_discount": [0.05] * n, "l_tax": [0.02] * n, "l_returnflag": ["N"] * n, "l_linestatus": ["F"] * n, "l_extendedprice": [1.0] * n, "l_shipdate": pa.nulls(n, pa.timestamp("us"))}), at / "lineitem.parquet")
    pq.write_table(pa.table({"s_suppkey": list(keys), "s_acctbal": [12.5 + 25 * k for k in keys]}), at / "supplier.parquet")
    return str(at)


def test_risk_gate_at_half_way_values_against_sql(spark, half_way_risks):
    import duckdb

    c = duckdb.connect()
    for t in ("lineitem", "supplier"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{half_way_risks}/{t}.parquet'")
    same(spark, c, half_way_risks, registry._relations()["x04_p0_gate"])


def test_every_query_has_columns_and_sql():
    queries, sql = registry.queries(), registry.oracle_sql()
    assert len(queries) > 200 and set(sql) <= set(queries)
    assert all("SELECT" in text for text in sql.values())


def test_translation_of_names():
    assert duck_text("count_if(a > (b + 1))") == "count(case when a > (b + 1) then 1 end)"
    assert duck_text("size(array(1))") == "len(list_value(1))"


def test_smoothstep_known_values(spark):
    df = spark.range(1).selectExpr(f"{px.smoothstep('0.5e0', 0.0, 1.0)} a", f"{px.smoothstep('2e0', 0.0, 1.0)} b", f"{px.smoothstep('0.4e0', 0.5, 0.5)} c", f"{px.clip('-1e0')} d")
    assert tuple(df.first()) == (0.5, 1.0, 0.0, 0.0)


def test_literal_rows_and_joins(spark, duck, sf_dir):
    left, right = rows("id long, v string", (1, "a"), (2, None), (3, "c")), rows("id long, w boolean", (1, True), (4, False))
    for how in ("inner", "left", "semi", "anti", "outer"):
        same(spark, duck, sf_dir, left.join(right, "id", how))


def test_filters_and_columns_reach_the_scan(spark, sf_dir):
    plan = table("events", "user_id", "value").where("value > 5e0").agg("user_id", n="count(*)").frame(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(value,5.0)" in plan and "props" not in plan.split("ReadSchema")[1].split("\n")[0]
