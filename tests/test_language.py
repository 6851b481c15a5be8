import pytest

from tidewell.functions.durations import duration_ms, instant_ms, parameter_ms
from tidewell.functions.numbers import general_text
from tidewell.plans.builder import describe
from tidewell.plans.language import QueryError, parse

NOW = 1_700_000_000_000
HOUR = 3_600_000


def test_examples():
    q = parse('SELECT cpu{host="a",zone="b"} [30m] DOWNSAMPLE 5m MAX', NOW)
    assert (q.metric, q.labels, q.start, q.end, q.downsample, q.function) == ("cpu", {"host": "a", "zone": "b"}, NOW - 1_800_000, NOW, 300_000, "MAX")
    assert q.series_key == 'cpu{host="a",zone="b"}'
    assert parse('cpu{z="1",a="2"}', NOW).series_key == 'cpu{a="2",z="1"}'
    assert "Downsample" in describe(q)


def test_default_range_and_suffix():
    q = parse("cpu avg", NOW)
    assert (q.start, q.end, q.function) == (NOW - HOUR, NOW, "AVG")
    assert parse("AVG", NOW).metric == "AVG"


@pytest.mark.parametrize("text", ["cpu [1h] AVG DOWNSAMPLE 5m", "cpu SUM AVG", "cpu DOWNSAMPLE 5M", "cpu DOWNSAMPLE 5ms", "cpu [ 1h ]", "cpu []", 'cpu {h="a"}', 'cpu{h="}"}', 'cpu{h!="a"}', 'cpu{h=~"a"}', "", "1cpu", "cpu [99999999999999d]"])
def test_errors(text):
    with pytest.raises(QueryError):
        parse(text, NOW)


def test_lenient_matchers_and_odd_places():
    assert parse('cpu{h!="a"}', NOW, strict=False).series_key == "cpu"
    assert parse("cpu{}", NOW).series_key == "cpu"
    assert parse('cpu{a="1",a="2"}', NOW).labels == {"a": "2"}
    q = parse('cpu[1h]{host="a"}', NOW)
    assert q.labels == {"host": "a"} and q.start == NOW - HOUR
    assert parse("cpu DOWNSAMPLE 0m", NOW).downsample == 0


def test_ranges():
    q = parse("cpu [2024-01-01 : 2024-01-02]", NOW)
    assert q.end - q.start == 86_400_000
    q = parse("cpu [2024-01-01T00:00:00Z:2024-01-01T01:00:00+00:00]", NOW)
    assert q.end - q.start == HOUR
    assert parse("cpu [1:1000000000001]", NOW).start == 1000
    assert parse("cpu [-1h]", NOW).start > parse("cpu [-1h]", NOW).end


def test_instants_and_numbers():
    assert instant_ms("1000000000000") == 10**15
    assert instant_ms("1000000000001") == 1000000000001
    assert instant_ms("-5") == -5000
    assert duration_ms("2d") == 172_800_000
    assert parameter_ms("1.5") == 1500 and parameter_ms("1970-01-01T00:00:01Z") == 1000
    for bad in ("x", "2024-13-01", "5w"):
        with pytest.raises(ValueError):
            instant_ms(bad)
    assert [general_text(x) for x in (72.5, 1.0, 0.00001, 1e21, -0.0, 123456789.0, float("inf"))] == ["72.5", "1", "1e-05", "1e+21", "-0", "123456789", "+Inf"]
    assert general_text(1e6, plain_below=6) == "1e+06"
