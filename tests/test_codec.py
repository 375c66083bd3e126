"""Wire forms: numbers that do not fit make a whole message malformed."""

import json

import pytest

from tidewake.sources import codec


@pytest.mark.parametrize(
    ("fields", "kept"),
    [({"kind": 255}, 2), ({"kind": 256}, 0), ({"kind": -1}, 0), ({"process_id": 2**31 - 1}, 2), ({"process_id": 2**31}, 0), ({"process_id": -(2**31)}, 2), ({"kind": None}, 2), ({}, 2)],
)
def test_numbers_out_of_range_make_a_message_malformed(spark, fields, kept):
    sound = {"device_id": "d", "events": [{"device_id": "d", "kind": 1, "process_id": 7}]}
    odd = {"device_id": "d", "events": [{"device_id": "d", "kind": 2}, {"device_id": "d", **fields}]}
    messages = spark.createDataFrame([("d", json.dumps(m)) for m in (sound, odd)], "key string, value string")
    got = codec.decode_batches(messages)
    assert dict(got.dtypes)["kind"] == dict(got.dtypes)["process_id"] == "int"
    assert got.count() == 1 + kept


def test_messages_without_events_or_sense_give_no_rows(spark):
    messages = spark.createDataFrame([("d", "{"), ("d", '{"device_id": "d"}'), ("d", '{"device_id": "d", "events": []}'), ("d", None)], "key string, value string")
    assert codec.decode_batches(messages).count() == 0
