from folio.operators.sequential import circuit_breaker
from folio.streaming import streams


def test_breaker_as_a_stream_gives_the_states_of_the_batch(spark, sf_dir):
    key = lambda df: sorted(map(tuple, df.select("instance_id", "request_id", "us", "state").collect()))
    assert key(streams.stream_breaker(spark, sf_dir)) == key(circuit_breaker(spark, sf_dir))


def test_invalid_messages_go_to_the_topic_of_errors(spark, sf_dir):
    rows = streams.stream_validated(spark, sf_dir)
    assert rows.where("NOT valid AND topic <> 'error-handling'").isEmpty()
    assert rows.count() == spark.read.parquet(f"{sf_dir}/events.parquet").count()
