from __future__ import annotations

from urllib.parse import quote

import pytest
from pyspark.sql import functions as F

from playlens.sources import ingest

COLUMNS = "event_id bigint, ts timestamp_ntz, user_header string, request_uri string"


def requests(spark, *rows):
    data = [(i, None, header, uri) for i, (header, uri) in enumerate(rows, start=1)]
    return spark.createDataFrame(data, COLUMNS)


def uri(payload: str, rest: str = "&_t=1") -> str:
    return "/telemetry?d=" + quote(payload) + rest


def parsed(spark, *rows):
    good, bad = ingest.ingest_requests(requests(spark, *rows))
    return {row["event_id"]: row for row in good.collect()}, sorted(row["event_id"] for row in bad.collect())


def test_payload_may_stand_anywhere_in_the_query(spark):
    rows = [
        ("", uri('{"event":"coin"}')),
        ("", "/telemetry?_t=5&d=" + quote('{"event":"coin"}')),
        ("", "/telemetry/x?d=&d=" + quote('{"event":"coin"}') + "#frag&d=no"),
        ("", "http://host:80/telemetry?d=" + quote('{"event":"coin"}')),
        ("", '/telemetry?d={"event":"coin"}'),
    ]
    good, bad = parsed(spark, *rows)
    assert {row["name"] for row in good.values()} == {"game.coin"} and len(good) == 5 and bad == []


@pytest.mark.parametrize("path", ["/whoami?d=%7B%7D", "/telemetry", "/telemetry?_t=1", "/telemetry?d=&_t=1", "/x?y=/telemetry?d=1", "/telemetry?id=5"])
def test_other_requests_make_no_event(spark, path):
    assert parsed(spark, ("", path)) == ({}, [])


@pytest.mark.parametrize(
    "payload", ["{bad", "[1]", "5", '"text"', "null", '{"a":1}x', '{"a":1} {"b":2}', '{"a":1},{"b":2}', "{'a':1}", '{"a":1,"b":', '],[{"a":1}']
)
def test_what_is_not_one_object_is_set_aside(spark, payload):
    assert parsed(spark, ("", uri(payload))) == ({}, [1])


def test_undecodable_text_is_set_aside(spark):
    assert parsed(spark, ("", "/telemetry?d=%7B%ZZ")) == ({}, [1])


def test_a_bad_request_does_not_stop_the_others(spark):
    good, bad = parsed(spark, ("", uri("{bad")), ("", uri('{"event":"coin"}')))
    assert list(good) == [2] and bad == [1]


def test_player_priority(spark):
    rows = [
        ("", uri('{"event":"coin"}')),
        ("   ", uri('{"event":"coin","player_name":""}')),
        (None, uri('{"event":"coin","player_name":null}')),
        ("", uri('{"event":"coin","player_name":"web"}')),
        (" head ", uri('{"event":"coin","player_name":"web"}')),
    ]
    good, _ = parsed(spark, *rows)
    assert [good[i]["player_name"] for i in range(1, 6)] == ["unknown", "unknown", "unknown", "web", "head"]
    assert good[5]["attributes"]["player_name"] == "head"


def test_attributes_are_texts_without_the_event(spark):
    good, _ = parsed(spark, ("", uri('{"event":"death","lives":2,"large":true,"x":1.5,"n":null,"o":{"p":[1]}}')))
    assert good[1]["attributes"] == {
        "lives": "2",
        "large": "true",
        "x": "1.5",
        "n": None,
        "o": '{"p":[1]}',
        "player_name": "unknown",
    }


def test_last_of_repeated_members_counts(spark):
    good, bad = parsed(spark, ("", uri('{"event":"coin","event":"death","a":1,"a":2}')))
    assert bad == [] and good[1]["name"] == "game.death" and good[1]["attributes"]["a"] == "2"


def test_missing_event_name(spark):
    good, _ = parsed(spark, ("", uri("{}")), ("", uri('{"event":null}')))
    assert {row["name"] for row in good.values()} == {"game.unknown"}


def test_known_and_unknown_events(spark):
    good, _ = ingest.ingest_requests(requests(spark, ("", uri('{"event":"coin"}')), ("", uri('{"event":"zap"}'))))
    routed = ingest.route_known_events(good).select("name", "known")
    assert dict(map(tuple, routed.collect())) == {"game.coin": True, "game.zap": False}


def test_spans_read_back_through_the_event_table(spark):
    from playlens.operators import projections

    table = ingest.build_spans(requests(spark, ("", uri('{"event":"death","level":"1-2","coins":7,"lives":"x"}'))))
    row = projections.spans(table).first()
    assert (row["event_type"], row["level"], row["coins"], row["lives"]) == ("game.death", "1-2", 7, None)
    assert table.select(F.col("record_type")).first()[0] == "SPAN"


def posted(spark, *rows):
    """Rows of (method, header, uri, body)."""
    data = [(i, None, header, uri, method, body) for i, (method, header, uri, body) in enumerate(rows, start=1)]
    good, bad = ingest.ingest_requests(spark.createDataFrame(data, COLUMNS + ", method string, body string"))
    return {row["event_id"]: row for row in good.collect()}, sorted(row["event_id"] for row in bad.collect())


def test_posts_carry_their_body_as_it_is(spark):
    body = '{"event":"death","level":"100%25","player_name":"web"}'
    good, bad = posted(spark, ("POST", "", "/telemetry", body), ("POST", None, "http://host/telemetry/x?d=%7B", body))
    assert {row["name"] for row in good.values()} == {"game.death"} and len(good) == 2 and bad == []
    assert good[1]["attributes"]["level"] == "100%25"


def test_player_of_a_post_comes_from_the_header_alone(spark):
    body = '{"event":"coin","player_name":"web"}'
    rows = [("POST", " head ", "/telemetry", body), ("POST", "", "/telemetry", body), ("GET", "", uri(body), None), (None, "", uri(body), body)]
    good, _ = posted(spark, *rows)
    assert [good[i]["player_name"] for i in (1, 2, 3, 4)] == ["head", "unknown", "web", "web"]
    assert good[2]["attributes"]["player_name"] == "unknown"


def test_posts_that_are_no_object_or_go_elsewhere(spark):
    body = '{"event":"coin"}'
    rows = [("POST", "", "/telemetry", text) for text in ("", None, "[1]", "{bad")]
    rows += [("POST", "", "/whoami", body), ("OPTIONS", "", "/telemetry", body), ("PUT", "", uri(body), body), ("post", "", "/telemetry", body)]
    assert posted(spark, *rows) == ({}, [1, 2, 3, 4])
