from threading import Event, Thread

from tapewright.llm.common import scratch, staged


def test_a_query_beside_another_keeps_its_tables(spark):
    inside, made, kept = Event(), Event(), []

    def beside():
        inside.wait(60)
        kept.append(staged(spark.range(10).toDF("x"), "beside"))
        made.set()

    thread = Thread(target=beside)
    thread.start()
    with scratch() as own:
        mine = staged(spark.range(5).toDF("x"), "mine")
        inside.set()
        assert made.wait(60)
        with scratch() as inner:
            staged(spark.range(3).toDF("x"), "inner")
            assert len(inner) == 1
        assert own == [mine] and mine.count() == 5
    thread.join()
    assert mine.staged_at is None and kept[0].count() == 10
