"""Clean rows of a large batch: ids that come once are not shuffled, the batch is stored slice by slice."""

from test_pipeline import aliases, listings, offer, servers

from tidemark.operators import quality
from tidemark.operators.scale import maybe, repeated
from tidemark.session import new_path
from tidemark.streaming import jobs

TITLE = "Firemaw [EU - Anniversary] - Horde"


def several(spark):
    rows = [offer(str(i % 7), title=TITLE, raw=0.5 + i) for i in range(11)]
    return listings(spark, *rows, offer("20", title="nothing"), offer("20", title=TITLE), (None, *offer("30", title=TITLE)[1:]),
                    (None, *offer("30", title=TITLE, raw=9.0)[1:]))


def normalized(spark, rows):
    return quality.normalize(rows, aliases(spark), servers(spark))


def taken(rows):
    return sorted(map(str, rows.collect()))


def test_rows_of_ids_that_come_once_stay_where_they_are(spark):
    rows = listings(spark, offer("1", title=TITLE), offer("2", title=TITLE), offer("3", title="nothing"))
    [whole] = normalized(spark, rows).sliced(rows)
    clean = whole.clean_of("id", "server_id")
    assert taken(clean.select("id")) == ["Row(id='1')", "Row(id='2')"]
    assert "Window" not in clean._jdf.queryExecution().executedPlan().toString()


def test_slices_hold_the_clean_rows(spark, monkeypatch):
    rows = several(spark)
    out = normalized(spark, rows)
    wanted = taken(out.clean_of(*rows.columns))
    assert len(wanted) == 9
    monkeypatch.setattr(quality, "SLICE_ROWS", 8)
    parts = out.sliced(rows)
    assert len(parts) == 2
    assert sorted(r for part in parts for r in taken(part.clean_of(*rows.columns))) == wanted


def test_repeated_keys_are_marked_null_or_not(spark):
    rows = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b"), (None, "a"), (None, "a"), (None, None)], "n int, t string")
    bits, total = repeated(rows, "n", "t")
    marked = {(r["n"], r["t"]) for r in maybe(rows, bits, "n", "t").filter("_may").collect()}
    assert total == 6 and marked >= {(1, "a"), (None, "a")} and (None, None) not in marked
    assert repeated(rows.filter("n = 9"), "n", "t")[1] == 0


def test_a_repeated_batch_changes_nothing(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(quality, "SLICE_ROWS", 8)
    rows, source = several(spark), str(tmp_path / "in")
    rows.write.parquet(source)
    clean, rejected = new_path(spark, "clean"), new_path(spark, "rejected")
    for _ in range(2):  # from a new checkpoint: the same batch, under the same number
        stream = spark.readStream.schema(rows.schema).parquet(source)
        jobs.start_normalizer(stream, aliases(spark), servers(spark), clean, rejected,
                              new_path(spark, "cp")).awaitTermination()
        stored = spark.read.parquet(clean)
        assert taken(stored.select(rows.columns)) == taken(normalized(spark, rows).clean_of(*rows.columns))
        assert spark.read.parquet(rejected).count() == 1
