import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from loomquill.operators import knowledge as K
from loomquill.operators import tickets
from loomquill.plans import export
from loomquill.plans import queries as Q
from loomquill.sources import knowledge as S

OLD, NOW = dt.datetime(2024, 1, 1), dt.datetime(2024, 6, 1)
SCHEMA = S.SCHEMA + ", fact_key string, fact_value string"


def row(category, title, body, status="D", key=None, value=None):
    return category, "", status, title, body, OLD, OLD, key, value


def merged(spark, old, new, **options):
    kb = spark.createDataFrame(old, SCHEMA)
    return K.merge(kb, spark.createDataFrame(new, SCHEMA), F.lit(NOW), **options)


def state(df):
    return sorted((r.title, r.status, r.body, r.updated_at == NOW) for r in df.collect())


def test_merge_rules(spark):
    long = "a b c d e f g h i j k l m n o p q r s t"
    old = [row("facts", "Same", long), row("facts", "More", "first detail"), row("facts", "Port", "8080", key="port", value="8080"), row("facts", "Sure", "9090", "V", "p2", "9090"), row("facts", "Gone", "x", "X")]
    new = [row("facts", "same", long), row("facts", "More", "second detail"), row("facts", "Port", "8081", key="port", value="8081"), row("facts", "Sure", "9091", "D", "p2", "9091"), row("facts", "Gone", "x again"), row("state", "Fresh", "new")]
    got = merged(spark, old, new)
    want = [
        ("Same", "D", long, True), ("More", "D", "first detail\nsecond detail", True), ("Port", "X", "8080", True), ("Port", "D", "8081", True), ("Sure", "V", "9090", False), ("Sure", "D", "9091", True),
        ("Gone", "X", "x", False), ("Gone", "D", "x again", True), ("Fresh", "D", "new", True),
    ]
    assert state(got) == sorted(want)
    assert ("Sure", "X", "9090", True) in state(merged(spark, old, new, deprecate_verified=True))


def test_merging_twice_changes_nothing(spark):
    old = [row("facts", "More", "first detail"), row("facts", "Sure", "9090", "V", "p2", "9090")]
    new = [row("facts", "More", "second detail"), row("state", "Fresh", "new"), row("facts", "Sure", "9091", "D", "p2", "9091")]
    once = merged(spark, old, new)
    twice = K.merge(once, spark.createDataFrame(new, SCHEMA), F.lit(NOW))
    assert [x[:3] for x in state(once)] == [x[:3] for x in state(twice)]


def test_visibility_routing_and_winners(spark):
    kb = spark.createDataFrame([row("facts", "t", "d"), row("facts", "t", "v", "V"), row("facts", "t", "x", "X"), row("pitfalls", "p", "q")], SCHEMA)
    seen = {r.body: (r.unverified, r.safe_for_high_risk) for r in K.visible(kb).collect()}
    assert seen == {"d": (True, False), "v": (False, True), "q": (True, False)}
    assert {r.category for r in K.route(kb, "errors").collect()} == {"pitfalls"}
    with pytest.raises(ValueError):
        K.route(kb, "errors", "progress", "learning")
    assert [r.body for r in K.winners(kb.filter("category = 'facts'"), "title", tie="body").collect()] == ["v"]
    assert {(r.category, r.entries) for r in K.index(kb).collect()} == {("facts", 2), ("pitfalls", 1), (None, 3)}
    assert [r.line.split(" | ")[0] for r in K.render_index(kb).orderBy("n").collect()] == ["| facts", "| pitfalls", "| total"]
    done = K.promote(kb, spark.createDataFrame([("pitfalls", "p", "tool"), ("facts", "t", "guess")], "category string, title string, kind string"))
    assert {r.status for r in done.filter("category = 'pitfalls'").collect()} == {"V"} and done.filter("status = 'V'").count() == 2
    finished = K.finish(kb, spark.createDataFrame([("pitfalls", "p")], "category string, title string"))
    assert {(r.category, r.open, r.done) for r in K.section_counts(finished).collect()} == {("facts", 2, 0), ("pitfalls", 0, 1)}


def test_similarity_is_strict(spark):
    words = [f"w{k}" for k in range(19)]
    rows = [(1, " ".join(words[:18])), (2, " ".join(words[:18] + ["z"])), (3, " ".join(words[:9])), (4, " ".join(words[:10])), (5, "u v"), (6, "u  v "), (7, "u v")]
    got = {(r.id_a, r.id_b) for r in K.similar_pairs(spark.createDataFrame(rows, "id int, text string").withColumn("b", F.lit(1)), "b").collect()}
    assert got == {(1, 2), (5, 6)}  # 9 of 10 words is 0.90, not over it; equal texts are one


def test_markdown_round_trip_and_snapshots(spark, tmp_path):
    md = tmp_path / "md"
    md.mkdir()
    (md / "facts.md").write_text("# Facts\n\n## Environment\n\n### [V] Port\n\n8080\nopen\n\n### Unmarked\n\nbody\n\n## Empty\n")
    (md / "state.md").write_text("# State\n\n## Progress\n")
    (md / "other.md").write_text("### [D] No\n\nnot a category\n")
    got = S.read_markdown(spark, str(md))
    want = {("facts", "Environment", "V", "Port", "8080\nopen"), ("facts", "Environment", "D", "Unmarked", "body")}
    assert {tuple(r) for r in got.select("category", "section", "status", "title", "body").collect()} == want
    again = S.parse_markdown(S.to_markdown(got))
    assert {tuple(r) for r in again.collect()} == want
    root = str(tmp_path / "kb")
    assert S.read_snapshot(spark, root).count() == 0
    stamped = got.withColumns({"created_at": F.lit(OLD), "updated_at": F.lit(OLD)})
    S.write_snapshot(stamped, root)
    S.write_snapshot(S.read_snapshot(spark, root), root)
    assert S.read_snapshot(spark, root).count() == 2 and S.drop_old_snapshots(root) == 1
    plan = S.read_snapshot(spark, root).filter("category = 'facts'")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(category" in plan


def test_tickets(spark, tmp_path):
    for name, text in {"01-a.md": "Status: resolved\nType: research\n", "02-b.md": "Type: task\nBlocked by: 01\n", "03-c.md": "Blocked by: 01, 02\n", "04-d.md": "Status: claimed\n", "map.md": "x"}.items():
        (tmp_path / name).write_text(text)
    t = S.read_tickets(spark, str(tmp_path))
    assert {(r.number, r.status, tuple(r.blocked_by)) for r in t.collect()} == {(1, "resolved", ()), (2, "open", (1,)), (3, "open", (1, 2)), (4, "claimed", ())}
    assert [r.number for r in tickets.next_ticket(t).collect()] == [2]
    assert [r.number for r in tickets.next_ticket(tickets.set_status(t, 2, "resolved")).collect()] == [3]


def test_extractor(spark):
    rows = spark.createDataFrame([("facts: Port - 8080\nnothing here\n- pitfalls: Trap - avoid",)], "text string")
    assert {tuple(r) for r in export.extract_knowledge(rows).collect()} == {("facts", "", "Port", "8080")} | ({("pitfalls", "", "Trap", "avoid")})


def test_near_dup_pairs_against_brute_force(spark, tmp_path):
    base = [f"w{k}" for k in range(60)]
    texts = [("en", " ".join(base)), ("en", "Other " + " ".join(base[1:])), ("de", " ".join(base[:-1])), ("en", "HEADER: a long line before the very same words " + " ".join(base[:20])), ("fr", " ".join(base)), ("en", " ".join(f"u{k}" for k in range(30))), ("en", "x " + " ".join(f"u{k}" for k in range(30))), (None, " ".join(reversed(base)) + " more")]
    spark.createDataFrame([(i, lang, x) for i, (lang, x) in enumerate(texts)], "doc_id long, lang string, text string").write.parquet(str(tmp_path / "documents.parquet"))
    first = {}
    for i, (_, x) in enumerate(texts):
        first.setdefault(x, i)
    words = {i: set(x.lower().split()) for x, i in first.items()}
    want = {(a, b) for a in words for b in words if a < b and len(words[a] & words[b]) / len(words[a] | words[b]) > 0.9}
    assert len(want) > 3
    assert {(r.id_a, r.id_b) for r in Q.near_dup_pairs(spark, str(tmp_path)).collect()} == want


def test_conversation_bounds(spark, tmp_path):
    said = [(1, 0, "user", "a" * 4 * 600), (2, 0, "user", "a" * 4 * 50), (3, 0, "user", "a" * 4 * 300)]
    spark.createDataFrame(said, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    assert tuple(Q.conversation_bounds(spark, str(tmp_path)).first()) == (3, 1, 1)


def test_an_index_of_too_many_lines_raises(spark):
    kb = spark.createDataFrame([(f"c{k:03d}", "", "D", "t", "b", OLD, OLD, None, None) for k in range(250)], SCHEMA)
    with pytest.raises(ValueError, match="251 lines"):
        K.render_index(kb)
    assert K.render_index(kb, most=252).count() == 251


def test_scoped_syncs_and_incremental_extraction(spark, tmp_path):
    root, now = str(tmp_path / "kb"), F.lit(NOW)
    first = spark.createDataFrame([("facts: Port - 8080\nstate: Build - red",), ("facts: Port - 8080\ngrowth-notes: Read - more",)], "text string")
    drafts = export.union_extractions(export.extract_knowledge(first.limit(1)), export.extract_knowledge(first))
    assert drafts.count() == 3
    assert {(r.category, r.new) for r in export.sync_kb(spark, root, drafts, now).collect()} == {("facts", 1), ("state", 1)}
    assert {(r.category, r.new) for r in export.sync_growth(spark, root, drafts, now).collect()} == {("growth-notes", 1)}
    assert export.sync_alignment(spark, root, drafts, now).count() == 0
    kb = S.read_snapshot(spark, root)
    assert {(r.category, r.title, r.body) for r in kb.collect()} == {("facts", "Port", "8080"), ("state", "Build", "red"), ("growth-notes", "Read", "more")}
    later = spark.createDataFrame([("facts: Port - 8080\nstate: Build - green\nfacts: Host - local",)], "text string")
    new, changed = export.extract_incremental(later, kb)
    assert {tuple(r) for r in new.collect()} == {("facts", "", "Host", "local")} and {tuple(r) for r in changed.collect()} == {("state", "", "Build", "green")}
    told = export.sync(spark, root, new, now, changes=changed)
    assert {(r.category, r.new) for r in told.collect()} == {("facts", 1)}
    kb = S.read_snapshot(spark, root)
    assert {(r.category, r.title, r.body) for r in kb.collect()} == {("facts", "Port", "8080"), ("facts", "Host", "local"), ("state", "Build", "green"), ("growth-notes", "Read", "more")}


def test_near_dup_pairs_deals_out_few_bytes(spark, tmp_path):
    """Words that make no pair stay where they are: less is shuffled than the texts are long."""
    rng = random.Random(5)
    texts = [" ".join(f"{rng.choice('abcdefgh')}{int(rng.paretovariate(0.5)) % 100000}" for _ in range(200)) for _ in range(1500)]
    texts += [x + " more" for x in texts[:40]]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4).write.parquet(str(tmp_path / "documents.parquet"))
    written = lambda: spark.sparkContext._jsc.sc().statusStore().executorList(False).apply(0).totalShuffleWrite()
    before = written()
    got = {(r.id_a, r.id_b) for r in Q.near_dup_pairs(spark, str(tmp_path)).collect()}
    assert got == {(k, 1500 + k) for k in range(40)}
    assert written() - before < sum(map(len, texts))


def test_pairs_that_may_be_similar_lose_none(spark):
    """Sizes at the bound of each length, words that only one text has, and wordless texts."""
    texts = ["", "   ", "one"]
    for n in (9, 10, 11, 19, 20, 21, 40, 95, 190):
        base = [f"n{n}w{k}" for k in range(n)]
        texts += [" ".join(base[: n - cut] + [f"n{n}x{extra}{k}" for k in range(extra)]) for cut in range(4) for extra in range(4)]
    words = [set(x.split()) for x in texts]
    want = {(a, b) for a in range(len(texts)) for b in range(a + 1, len(texts)) if words[a] and words[b] and len(words[a] & words[b]) / len(words[a] | words[b]) > 0.9}
    got = K.similar_pairs(spark.createDataFrame(list(enumerate(texts)), "id long, text string")).collect()
    assert len(want) > 50 and {(r.id_a, r.id_b) for r in got} == want
