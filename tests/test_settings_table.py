"""Setting texts as rows, equal to the driver's own parser line by line."""

from sparkwright.functions.conf import parse_settings, settings_table


def test_lines_equal_parser(spark):
    texts = ["spark.a.b = 1\nnote\n  spark.sql.shuffle.partitions=8  ", "", None, "x spark.c = 2\r\nspark.sql.warehouse.dir = a = b", "spark.d ="]
    got = settings_table(spark.createDataFrame(list(enumerate(texts)), "id int, settings string")).orderBy("id", "line").collect()
    assert [(r.id, r.key, r.value) for r in got] == [(i, *kv) for i, t in enumerate(texts) for kv in parse_settings(t or "")]
    assert {r.key for r in got if r.modifiable} == {"spark.sql.shuffle.partitions"}
