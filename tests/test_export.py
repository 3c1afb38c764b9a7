import json
import random
import re

import pytest
from pyspark.sql import functions as F

from loomquill.functions import columns as X
from loomquill.functions.config import PackConfig
from loomquill.operators import extract, pack, render, stats, turns
from loomquill.plans import export
from loomquill.sources import transcripts


def entry(kind, content, uid="", ts=""):
    return json.dumps({"type": kind, "timestamp": ts, "uuid": uid, "message": {"role": kind, "content": content}, "extra": {"x": [1]}}, ensure_ascii=False)


def write(path, lines, end="\n"):
    path.write_text("\n".join(lines) + end, encoding="utf-8")
    return str(path)


def parts(spark, tmp_path, blocks, kind="assistant"):
    file = write(tmp_path / "s.jsonl", [entry(kind, blocks)])
    rows = extract.content_parts(extract.keep_conversation(transcripts.entries(transcripts.decode(transcripts.read_lines(spark, file))))).collect()
    return [tuple(p) for p in rows[0].parts]


def test_lines_keep_their_numbers(spark, tmp_path):
    file = write(tmp_path / "a.jsonl", ["", entry("user", "hi"), "{broken", "[1, 2]", "  ", entry("mode", "x"), entry("assistant", "[not a list]")])
    decoded = transcripts.decode(transcripts.read_lines(spark, file))
    assert {r.line_num: r.malformed for r in decoded.collect()} == {0: False, 1: False, 2: True, 3: True, 4: False, 5: False, 6: False}
    got = extract.content_parts(extract.keep_conversation(transcripts.entries(decoded))).orderBy("line_num").collect()
    assert [(r.line_num, r.type, r.parts[0].text) for r in got] == [(1, "user", "hi"), (6, "assistant", "[not a list]")]
    assert stats.counters(decoded).first().asDict() == {"total_entries": 5, "processed_entries": 3, "filtered_entries": 2, "malformed_lines": 2}
    assert [r.line_num for r in transcripts.slice_lines(transcripts.read_lines(spark, file), 2, 4).collect()] == [2, 3]


def test_thinking_and_results_are_cut(spark, tmp_path):
    blocks = [{"type": "thinking", "thinking": c * n} for c, n in (("a", 400), ("𝔸", 401))]
    blocks += [{"type": "tool_result", "content": "b" * n, "is_error": e} for n, e in ((600, False), (601, False), (601, True))]
    blocks += [{"type": "tool_result", "content": [{"type": "text", "text": "one"}, {"type": "image"}, {"type": "text", "text": "two"}]}, {"type": "image"}, "loose", {"type": "text", "text": "end"}]
    got = parts(spark, tmp_path, [b for b in blocks if isinstance(b, dict)])
    assert got[0] == ("thinking", "a" * 400, False, None)
    assert got[1] == ("thinking", "𝔸" * 200 + "\n[...omitted...]\n" + "𝔸" * 100, True, None)
    assert got[2] == ("tool_result", "b" * 600, False, False)
    assert got[3] == ("tool_result", "b" * 500 + "\n[...omitted...]", True, False)
    assert got[4] == ("tool_result", "b" * 500 + "\n[...error info...]\n" + "b" * 200, True, True)
    assert got[5] == ("tool_result", "one\ntwo", False, False)
    assert got[6:] == [("text", "end", False, None)]


def test_tool_inputs(spark, tmp_path):
    calls = [
        ("Bash", {"command": "c" * 500}, "Command: " + "c" * 500), ("Bash", {"command": "c" * 501}, "Command: " + "c" * 500 + "..."), ("Edit", {"file_path": "f", "old_string": "o", "new_string": "n"}, "File: f\nOld: o...\nNew: n..."),
        ("Write", {"file_path": "f", "content": "x" * 300}, "File: f\nContent: " + "x" * 200 + "..."), ("Read", {"file_path": "f"}, "File: f"), ("Agent", {"prompt": "p" * 400}, "Prompt: " + "p" * 300), ("Grep", {"b": {"y": 1}, "a": "é"}, 'Input: {"b":{"y":1},"a":"é"}'),
    ]
    got = parts(spark, tmp_path, [{"type": "tool_use", "name": n, "input": i} for n, i, _ in calls] + [{"type": "tool_use", "input": {}}])
    assert [p[1] for p in got] == [f"[Tool: {n}]\n{t}" for n, _, t in calls] + ["[Tool: unknown]\nInput: {}"]
    assert all(p[2] for p in got)


@pytest.mark.parametrize(("text", "tokens"), [("", 0), (None, 0), ("abc", 0), ("abcd", 1), ("中文", 2), ("中abc", 1), ("中文abcd", 3), ("가나다라", 1)])
def test_token_estimates(spark, text, tokens):
    assert spark.createDataFrame([(text,)], "t string").select(X.estimate_tokens(F.col("t"))).first()[0] == tokens


def chunks(spark, turn_tokens, config=PackConfig(90, 200, 40)):
    """Packs turns given as lists of entry sizes; returns chunks as lists of entry sizes."""
    rows = [(1, k, t, n) for k, (t, n) in enumerate((t, n) for t, e in enumerate(turn_tokens) for n in (e if isinstance(e, list) else [e]))]
    df = spark.createDataFrame(rows, "file int, line_num int, turn_id int, tokens long")
    out: dict[int, list] = {}
    for r in pack.pack(df, "file", "line_num", config).orderBy("line_num").collect():
        out.setdefault(r.chunk_id, []).append(r.tokens)
    assert sorted(out) == list(range(len(out)))
    return [out[k] for k in sorted(out)]


def test_packing_cases(spark):
    cases = {(50, 40): [[50, 40]], (50, 41): [[50], [41]], (80, 30): [[80, 30]], (50, 45, 10): [[50], [45, 10]], (30, 85): [[30], [85]], (10,): [[10]], (150,): [[150]], (200, 39): [[200], [39]], (): []}
    for given, want in cases.items():
        assert chunks(spark, list(given)) == want, given
    assert chunks(spark, [10, [200, 50]]) == [[10], [200], [50]]
    assert chunks(spark, [80, 30, [150, 150]]) == [[80, 30], [150], [150]]
    assert chunks(spark, [[300], 20]) == [[300], [20]]


def test_packing_keeps_entries_order_and_limit(spark):
    random.seed(4)
    for _ in range(3):
        given = [[random.randint(1, 120) for _ in range(random.randint(1, 4))] for _ in range(60)]
        got = chunks(spark, given)
        assert [n for c in got for n in c] == [n for t in given for n in t]
        assert all(sum(c) <= 200 or len(c) == 1 for c in got)


def test_turns_literal_and_paired(spark, tmp_path):
    result = [{"type": "tool_result", "content": "ok"}]
    file = write(tmp_path / "t.jsonl", [entry("assistant", "lead"), entry("user", "a"), entry("assistant", [{"type": "tool_use", "name": "Read", "input": {}}]), entry("user", result), entry("user", "b")])
    e = extract.content_parts(extract.keep_conversation(transcripts.entries(transcripts.decode(transcripts.read_lines(spark, file)))))
    assert [r.turn_id for r in turns.number_turns(e).orderBy("line_num").collect()] == [0, 1, 1, 2, 3]
    assert [r.turn_id for r in turns.number_turns(e, paired=True).orderBy("line_num").collect()] == [0, 1, 1, 1, 2]
    assert {r.name: r.n for r in stats.tool_distribution(e).collect()} == {"Read": 1}


def test_full_then_incremental(spark, tmp_path):
    first = write(tmp_path / "one.jsonl", [entry("user", f"question {k}", f"u{k}", f"t{k}") for k in range(5)])
    store = export.Store(spark, str(tmp_path / "store"))
    made = export.full(store, [first])
    assert json.loads(made.result.first()[0])["processed_entries"] == 5
    assert [r.state for r in export.status(store, [first]).collect()] == ["unchanged"]
    assert export.incremental(store, [first]).packed.count() == 0
    with open(first, "a") as f:
        f.write(entry("assistant", "answer", "u5", "t5") + "\n")
    second = write(tmp_path / "two.jsonl", [entry("user", "new file", "v0", "t")])
    assert {r.state for r in export.status(store, [first, second]).collect()} == {"grown", "new"}
    rows = export.build(spark, [first, second], "incremental", store.cursors()).packed.collect()
    assert sorted(r.line_num for r in rows) == [0, 5]
    export.incremental(store, [first, second])
    assert {r.state for r in export.status(store, [first, second]).collect()} == {"unchanged"}
    write(tmp_path / "one.jsonl", [entry("user", "shorter", "u0", "t0")])
    write(tmp_path / "two.jsonl", [entry("user", "other", "w0", "t")])
    assert {r.state for r in export.status(store, [first, second]).collect()} == {"truncated", "changed"}
    totals = stats.history_totals(store.history()).first()
    assert (totals.exports, totals.full, totals.incremental) == (3, 1, 2)
    assert export.cleanup(store) > 0 and export.cleanup(store) == 0
    (tmp_path / "store" / "cursors" / "CURRENT").write_text("gone")
    with pytest.warns(UserWarning, match="broken"):
        assert store.cursors().count() == 0
    with pytest.raises(export.NoTranscripts):
        export.build(spark, [])


def test_rendered_chunk(spark, tmp_path):
    file = write(tmp_path / "r.jsonl", [entry("user", "What?", "a", "T1"), entry("assistant", [{"type": "thinking", "thinking": "hm"}, {"type": "text", "text": "This."}], "b", "T2")])
    made = export.build(spark, [file])
    assert [r.text for r in render.render_turns(made.packed).collect()] == ["## [Turn 1] T1\n\n### User:\nWhat?\n\n### Assistant:\n[thinking]\nhm\n\nThis.\n\n---\n"]
    assert render.render_headers(made.stats).first().text.startswith("# Conversation History Export - Chunk 0/0\n\n> Time range: T1 ~ T2\n> Estimated tokens: ~2\n> Conversation turns: 1\n")
    render.write_chunks(made.packed, made.stats, str(tmp_path / "out"))
    files = list((tmp_path / "out").rglob("*.txt"))
    assert len(files) == 1 and files[0].read_text().startswith("# Conversation") and "\r" not in files[0].read_text()


def test_fallback_levels(spark, tmp_path):
    file = write(tmp_path / "f.jsonl", [entry("assistant", [{"type": "thinking", "thinking": "t" * 400}, {"type": "text", "text": "x" * 40}])])
    assert export.build(spark, [file], budget=50).packed.first().tokens == 10
    assert export.build(spark, [file], budget=500).packed.first().tokens == 110
    with pytest.raises(export.ExportError):
        export.build(spark, [file], budget=5)


def test_discovery(tmp_path):
    (tmp_path / "-a-b").mkdir()
    (tmp_path / "-a-b" / "x.jsonl").write_text("")
    (tmp_path / "-a-b" / "y.jsonl").write_text("")
    import os

    os.utime(tmp_path / "-a-b" / "y.jsonl", (1, 1))
    assert [p[-7:] for p in transcripts.discover("/a/b", str(tmp_path))] == ["x.jsonl", "y.jsonl"]
    assert len(transcripts.discover("/a/b", str(tmp_path), latest_only=True)) == 1
    assert transcripts.discover("/zzz", str(tmp_path / "none")) == []
    assert transcripts.path_candidates("C:\\Work\\App") == ["C-Work-App", "c-work-app", "C-Work-App-"]


def test_tail_stream_sees_appended_lines(spark, tmp_path):
    from loomquill.streaming.tail import TranscriptTail

    src = tmp_path / "src"
    src.mkdir()
    write(src / "a.jsonl", ["one", "two"])
    spark.dataSource.register(TranscriptTail)
    stream = spark.readStream.format("transcript_tail").option("path", str(src)).load()

    def drain():
        q = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ckpt")).trigger(availableNow=True).start()
        q.awaitTermination(120)
        return sorted(r.line for r in spark.read.parquet(str(tmp_path / "out")).collect())

    assert drain() == ["one", "two"]
    with open(src / "a.jsonl", "a") as f:
        f.write("three\npart")
    write(src / "b.jsonl", ["other"])
    assert drain() == ["one", "other", "three", "two"]


def lines_of(store):
    return sorted(re.findall(r"question \d+|late \d+", "".join(f.read_text() for f in (store.root / "chunks").rglob("*.txt"))))


def test_lines_appended_while_an_export_writes_are_exported_once(spark, tmp_path, monkeypatch):
    file = write(tmp_path / "one.jsonl", [entry("user", f"question {k}", f"u{k}", f"t{k}") for k in range(2)])
    store = export.Store(spark, str(tmp_path / "store"))
    written = render.write_chunks

    def slow(*args, **options):
        written(*args, **options)
        with open(file, "a") as f:
            f.write(entry("user", "late 0", "l0", "t8") + "\n" + entry("user", "late 1", "l1", "t9")[:20])

    monkeypatch.setattr(render, "write_chunks", slow)
    made = export.full(store, [file])
    monkeypatch.undo()
    assert lines_of(store) == ["question 0", "question 1"] and store.cursors().first().line_number == 2
    assert json.loads(made.result.first()[0])["sync_state"][0]["last_uuid"] == "u1"
    # The line that is still being written is left, too, until it ends.
    export.incremental(store, [file])
    assert lines_of(store) == ["late 0", "question 0", "question 1"] and store.cursors().first().line_number == 3
    with open(file, "a") as f:
        f.write(entry("user", "late 1", "l1", "t9")[20:] + "\n")
    export.incremental(store, [file])
    assert lines_of(store) == ["late 0", "late 1", "question 0", "question 1"]
    assert export.incremental(store, [file]).packed.count() == 0


def test_cut_files_warn_and_failures_keep_the_state(spark, tmp_path, monkeypatch):
    one = write(tmp_path / "one.jsonl", [entry("user", f"question {k}", f"u{k}", f"t{k}") for k in range(3)])
    two = write(tmp_path / "two.jsonl", [entry("user", "question 9", "v", "t")])
    store = export.Store(spark, str(tmp_path / "store"))
    export.full(store, [one, two])
    write(tmp_path / "one.jsonl", [entry("user", "question 0", "u0", "t0"), "{broken"])
    with pytest.warns(UserWarning, match="truncated since the last export.*full export is recommended"):
        made = export.incremental(store, [one, two])
    record = json.loads(made.result.first()[0])
    assert record["status"] == "partial" and len(record["warnings"]) == 2
    assert store.cursors().count() == 2
    # A read that fails for any other reason is no first run.
    monkeypatch.setattr(type(spark), "read", property(lambda self: (_ for _ in ()).throw(OSError("the disk is away"))))
    with pytest.raises(OSError, match="away"):
        store.cursors()
    monkeypatch.undo()
    before = lines_of(store)
    monkeypatch.setattr(render, "write_chunks", lambda *a, **k: (_ for _ in ()).throw(OSError("full")))
    with pytest.raises(export.WriteFailed):
        export.full(store, [one, two])
    monkeypatch.undo()
    assert lines_of(store) == before and store.cursors().count() == 2


def test_error_matrix(spark, tmp_path, monkeypatch):
    store = export.Store(spark, str(tmp_path / "store"))
    with pytest.raises(export.MissingTranscript):
        export.full(store, [str(tmp_path / "none.jsonl")])
    (tmp_path / "empty.jsonl").write_text("")
    with pytest.warns(UserWarning, match="no conversation history"):
        made = export.full(store, [str(tmp_path / "empty.jsonl")])
    assert json.loads(made.result.first()[0])["status"] == "empty" and made.packed.count() == 0
    file = write(tmp_path / "a.jsonl", [entry("user", "question 1")])
    monkeypatch.setattr(export.shutil, "disk_usage", lambda p: type("U", (), {"free": 3}))
    with pytest.raises(export.NoSpace):
        export.full(store, [file])
    monkeypatch.undo()
    with pytest.raises(export.ExportError):
        export.check_python((3, 7, 1))
    (tmp_path / "roots" / "-other-place").mkdir(parents=True)
    with pytest.raises(export.NoProject) as e:
        export.locate("/a/b", str(tmp_path / "roots"))
    assert e.value.candidates == ["-other-place"]
    assert export.locate("/a/b", "", [file]) == [file]
    assert transcripts.path_candidates("/root/app", ["-root", "-ro", "-root-app-more", "x"]) == ["-root-app", "-root-app-", "-root", "-root-app-more"]
    made = export.build(spark, [file])
    made.counters = made.counters.withColumn("filtered_entries", F.lit(7).cast("long"))
    with pytest.raises(export.NotConserved):
        export.validate(made)


def test_sources_without_files_and_latest(spark, tmp_path):
    rows = spark.createDataFrame([(0, "user", "hi"), (1, "assistant", "yes")], "line_num int, type string, content string")
    got = extract.content_parts(transcripts.from_memory(rows)).orderBy("line_num").collect()
    assert [(r.file, r.type, r.parts[0].text) for r in got] == [("memory", "user", "hi"), ("memory", "assistant", "yes")]
    (tmp_path / "conversation-20240102-003.md").write_text("said")
    (tmp_path / "notes.md").write_text("x")
    assert [(str(r.day), r.number, r.text) for r in transcripts.read_history(spark, str(tmp_path)).collect()] == [("2024-01-02", 3, "said")]
    facts = spark.createDataFrame([("a", 1), ("c", 2), ("b", 2)], "file string, last_modified int")
    assert transcripts.latest_file(facts).first().file == "c"
