import random

import pytest

from tableferry.operators import stage_metrics as m
from tableferry.sources import read_event_log

LOG = "transfer_id bigint, component string, thread bigint, event string, ts_us bigint, seq bigint"


def step_by_step(events):
    """The measures of one thread, one event after the other."""
    start = push = pop = end = None
    wait = proc = blocks = 0
    for kind, ts in events:
        if kind == "start":
            start = ts
        elif kind == "pop":
            wait += ts - push if push is not None else ts - start if start is not None else 0
            pop = ts
        elif kind == "push":
            push = ts
            if pop is not None:
                proc += ts - pop
                blocks += 1
        elif kind == "end":
            end = ts
            if pop is not None and push is not None:
                proc += ts - push
    overall = end - start if end is not None and start is not None else events[-1][1] - events[0][1]
    return wait // 1000, proc // 1000, overall // 1000, blocks


def log_of(threads):
    """Interleaved log of several threads: ``{key: [(event, ts)]}`` ordered by time."""
    merged = sorted((ts, n, key, kind) for key, events in threads.items() for n, (kind, ts) in enumerate(events))
    return [(*key, kind, ts, seq) for seq, (ts, _, key, kind) in enumerate(merged)]


def measured(spark, rows, chunk):
    df = spark.createDataFrame(rows, LOG).repartition(3)
    out = m.combine_summaries(m.chunk_summaries(df, chunk)).collect()
    return {(r.transfer_id, r.component, r.thread): (r.waiting_ms, r.processing_ms, r.overall_ms, r.blocks) for r in out}


def ms(*pairs):
    return [(kind, at * 1000) for kind, at in pairs]


CASES = {
    "normal": (ms(("start", 0), ("pop", 5), ("push", 9), ("pop", 12), ("push", 20), ("end", 21)), (8, 13, 21, 2)),
    "double push": (ms(("start", 0), ("pop", 2), ("push", 4), ("push", 7), ("end", 7)), (2, 7, 7, 2)),
    "push before pop": (ms(("start", 0), ("push", 1), ("pop", 3), ("push", 5), ("end", 6)), (2, 3, 6, 1)),
    "no start or end": (ms(("pop", 2), ("push", 6)), (0, 4, 4, 1)),
    "pop, no push": (ms(("start", 0), ("pop", 4), ("end", 9)), (4, 0, 9, 0)),
}


@pytest.mark.parametrize("chunk", [1, 2, 3, 100])
def test_hand_made_logs(spark, chunk):
    threads = {(i, "rcv", 0): events for i, (events, _) in enumerate(CASES.values())}
    wanted = {(i, "rcv", 0): result for i, (_, result) in enumerate(CASES.values())}
    assert measured(spark, log_of(threads), chunk) == wanted


@pytest.mark.parametrize("chunk, seed", [(1, 1), (5, 2), (17, 3), (1000, 4)])
def test_chunks_equal_the_loop(spark, chunk, seed):
    """60 random threads and one that owns most of the log; times are those of a real clock."""
    rng = random.Random(seed)
    threads = {}
    for i in range(60):
        at, events = 1_700_000_000_000_000, []
        for _ in range(rng.randrange(1, 400 if i == 0 else 12)):
            at += rng.randrange(1, 9_000_000)
            events.append((rng.choice(["pop", "push", "pop", "push", "start", "end"]), at))
        threads[(i % 4, "write", i)] = events
    wanted = {key: step_by_step(events) for key, events in threads.items()}
    assert measured(spark, log_of(threads), chunk) == wanted


def test_no_task_gets_a_whole_thread(spark):
    """Rows that meet in one window are bounded by the chunk, whatever the thread's share."""
    rows = log_of({(0, "rcv", 0): [("pop" if i % 2 else "push", i * 10) for i in range(1000)]})
    chunks = m.chunk_summaries(spark.createDataFrame(rows, LOG), 50).collect()
    assert len(chunks) == 20 and all(r.last_seq - r.first_seq < 50 for r in chunks)


def test_throughput_and_rollup(spark):
    rows = log_of({(0, "rcv", 0): CASES["normal"][0], (0, "rcv", 1): CASES["pop, no push"][0]})
    threads = m.thread_metrics(spark.createDataFrame(rows, LOG), 1024)
    by_thread = {r.thread: r for r in threads.collect()}
    assert by_thread[0].throughput == pytest.approx(2 / 0.021)
    assert by_thread[0].throughput_pb == pytest.approx(2 / 0.013)
    assert by_thread[1].throughput == 0 and by_thread[1].throughput_pb == 0
    loose = m.component_metrics(threads).first()
    strict = m.component_metrics(threads, strict=True).first()
    total = 2 / 0.021
    assert loose.waiting_ms == 6 and loose.throughput == pytest.approx(total)
    assert loose.throughput_sd == pytest.approx((((total - total) ** 2 + total**2) / 2) ** 0.5)
    assert strict.throughput_sd == pytest.approx(total / 2)


def test_logs_without_numbers(spark, tmp_path):
    events = [("start", 0), ("pop", 5), ("push", 9), ("pop", 9), ("push", 9), ("end", 41)]  # ties are told by the order
    rows = [(1, "ser", 0, kind, at * 1000, i) for i, (kind, at) in enumerate(events)]
    log = spark.createDataFrame(rows, "transfer_id bigint, component string, thread bigint, event string, ts_us bigint, seq bigint")
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "a.csv").write_text("".join(f"1,ser,0,{kind},{at * 1000}\n" for kind, at in events[:2]))
    (tmp_path / "t" / "b.csv").write_text("".join(f"1,ser,0,{kind},{at * 1000}\n" for kind, at in events[2:]))
    log.drop("seq").coalesce(1).write.parquet(str(tmp_path / "p"))
    for read in (read_event_log(spark, str(tmp_path / "t"), range_bytes=20),
                 read_event_log(spark, str(tmp_path / "p"), "parquet")):
        assert sorted(map(tuple, read.select(*log.columns).collect())) == sorted(rows)
        assert m.combine_summaries(m.chunk_summaries(read)).collect() == m.combine_summaries(m.chunk_summaries(log)).collect()
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "c.csv").write_text("1,ser,zero,pop,5\n")
    with pytest.raises(Exception):
        read_event_log(spark, str(tmp_path / "bad")).collect()
