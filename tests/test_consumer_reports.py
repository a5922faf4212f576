import json

from tidemark.metrics import ConsumerReporter


def test_consumer_reports(tmp_path):
    now = [100.0]
    r = ConsumerReporter(str(tmp_path / "c.jsonl"), clock=lambda: now[0])
    now[0] = 102.0
    for sequence, ms in ((1, 101_000), (2, 99_000), (2, 99_000), (3, None), (4, 103_000)):
        r.event(sequence, 10, ms)
    r.acknowledgement(0.25)
    line = r.report()
    assert (line["events_total"], line["redeliveries_total"], line["last_sequence"], line["payload_bytes_total"]) == (4, 1, 4, 40)
    assert line["events_per_second"] == 2.0 and line["missing_commit_timestamps_total"] == 1 and line["clock_skew_samples_total"] == 1
    assert line["end_to_end_latency_ms"]["samples"] == 2 and line["end_to_end_latency_ms"]["max"] == 3000.0
    assert line["acknowledgement_latency_ms"]["p50"] == 250.0
    now[0] = 103.0
    last = r.report(final=True)
    assert last["final"] and last["events_per_second"] == 0.0 and last["events_total"] == 4 and last["end_to_end_latency_ms"]["samples"] == 0
    assert [json.loads(x) for x in (tmp_path / "c.jsonl").read_text().splitlines()] == [line, last]
